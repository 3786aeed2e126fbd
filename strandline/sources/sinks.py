"""Where results go: named sinks that a caller registers and that rows are delivered to, in batch or from a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


class Sinks:
    """Sinks by name; a sink takes a DataFrame and the number of its batch (None outside of streams)."""

    def __init__(self):
        self._known: dict[str, Callable[[DataFrame, int | None], None]] = {}

    def register(self, name: str, write: Callable[[DataFrame, int | None], None]) -> None:
        if name in self._known:
            raise ValueError(f"{name} is registered")
        self._known[name] = write

    def table(self, name: str, path: str) -> None:
        """A sink that appends Parquet; a batch of a stream that is delivered again replaces what it wrote."""

        def write(rows: DataFrame, batch: int | None) -> None:
            if batch is None:
                rows.write.mode("append").parquet(path)
            else:
                rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

        self.register(name, write)

    def deliver(self, name: str, rows: DataFrame, batch: int | None = None) -> None:
        if name not in self._known:
            raise KeyError(f"no sink {name}")
        self._known[name](rows, batch)

    def route(self, rows: DataFrame, by: str, to: dict[str, str], batch: int | None = None) -> None:
        """Rows by a column: those of each value to the sink that `to` names for it; other values go nowhere."""
        for value, name in to.items():
            self.deliver(name, rows.where(rows[by] == value), batch)

    def start(self, stream: DataFrame, by: str, to: dict[str, str], checkpoint: str, mode: str = "update"):
        """The query that delivers a stream, batch by batch."""
        return stream.writeStream.outputMode(mode).foreachBatch(lambda rows, batch: self.route(rows, by, to, batch)).option("checkpointLocation", checkpoint)
