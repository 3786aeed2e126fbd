"""Flows: state machines over messages, timers, idle sessions, and segment reassembly."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.wire_decode import evaluate
from ..plans.wire_text import Machine

# Numbers of state names in reports.
STATE_IDS = {"IDLE": 0, "CLOSED": 0, "PENDING": 1, "SYN_SENT": 1, "ESTABLISHED": 1, "FIN_WAIT": 2}
SEGMENT_LIMIT = 1 << 20


def state_id(state: Column) -> Column:
    out = F.lit(0)
    for name, n in STATE_IDS.items():
        out = F.when(state == name, n).otherwise(out)
    return out


@dataclass
class Session:
    state: str
    variables: dict = field(default_factory=dict)
    timers: list = field(default_factory=list)  # (deadline, number, name)
    last: int = 0


class Sessions:
    """A machine over the messages of many flows."""

    def __init__(self, machine: Machine, capacity: int | None = None):
        self.machine, self.capacity, self.flows, self.made, self.clock = machine, capacity, {}, 0, 0

    def feed(self, key, message: str, context: dict[str, int], now: int = 0) -> tuple[str, str, list[str]]:
        """State before and after, and what was emitted."""
        own = self.flows.get(key)
        self.clock += 1
        if own is None:
            if self.capacity and len(self.flows) >= self.capacity:
                del self.flows[min(self.flows, key=lambda k: self.flows[k].last)]
            own = self.flows[key] = Session(self.machine.initial)
        own.last = self.clock
        before, emitted = own.state, []
        for t in self.machine.states.get(own.state, ()):
            get = lambda n: own.variables.get(n, context.get(n, 0))
            if t.message != message or t.guard is not None and not evaluate(t.guard, get):
                continue
            own.state = t.to
            for a in t.actions:
                if a[0] == "set":
                    own.variables[a[1]] = evaluate(a[2], get)
                elif a[0] == "emit":
                    emitted.append(a[1])
                elif a[0] == "start":
                    self.schedule(key, a[1], now + evaluate(a[2], get))
                else:
                    own.timers = [x for x in own.timers if x[2] != a[1]]
            break
        return before, own.state, emitted

    def schedule(self, key, name: str, deadline: int) -> None:
        self.made += 1
        self.flows[key].timers.append((deadline, self.made, name))

    def advance(self, now: int) -> list[tuple]:
        """Timers that are due, by deadline and then by age; each is fed as timer:<name>."""
        due = sorted((t, n, key, name) for key, s in self.flows.items() for t, n, name in s.timers if t <= now)
        for s in self.flows.values():
            s.timers = [x for x in s.timers if x[0] > now]
        return [(key, name, *self.feed(key, f"timer:{name}", {}, now)) for _, _, key, name in due]

    def expire(self, timeout: int) -> list:
        gone = [k for k, s in self.flows.items() if s.last < self.clock - timeout]
        for k in gone:
            del self.flows[k]
        return gone


def run_machine(messages: DataFrame, machine: Machine, key: str, order: list[str], message: str, context: list[str], idle: int | None = None) -> DataFrame:
    """Each message with the state of its flow before and after it, what it emitted, and whether a session expired before it.

    idle: a gap of order[0] (a number) above it ends a session: state, variables and timers start anew.

    Flows stream by in their order, one after the other; a task holds one batch of rows and one session, however long a
    flow is.  One flow is the work of one task, as a machine with variables is sequential.
    """
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in messages.schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, sessions = None, 0, None
        for batch in batches:
            found: tuple[list, list, list, list] = ([], [], [], [])
            values = [batch.column(c).to_pylist() for c in context]
            times = batch.column(order[0]).to_pylist() if idle is not None else [0] * batch.num_rows
            for k, t, kind, *given in zip(batch.column(key).to_pylist(), times, batch.column(message).to_pylist(), *values):
                new = sessions is None or k != at
                over = not new and idle is not None and t - last > idle
                if new or over:
                    at, sessions = k, Sessions(machine)
                last = t
                step = sessions.feed(0, kind, {c: int(v) for c, v in zip(context, given) if v is not None})
                for out, value in zip(found, (*step[:2], ",".join(step[2]), over)):
                    out.append(value)
            texts = [pa.array(c, pa.string()) for c in found[:3]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *texts, pa.array(found[3], pa.bool_())], [*batch.schema.names, "state_before", "state_after", "emitted", "expired"])

    dealt = messages.repartition(int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key, *order)
    return dealt.mapInArrow(fold, f"{names}, state_before string, state_after string, emitted string, expired boolean")


def table_machine(messages: DataFrame, key: list[str], order: list[str], symbol: Column, moves: dict[str, dict[str, str]], initial: str, slot: Column) -> DataFrame:
    """The last state of each flow under a machine without variables, without a task that sees a whole flow.

    Every slot of a flow becomes a function from state to state, and functions of slots are composed.
    """
    states = sorted({initial, *moves, *(t for m in moves.values() for t in m.values())})
    rows = messages.withColumn("_sym", symbol).withColumn("_slot", slot)
    items = rows.groupBy(*key, "_slot").agg(F.array_sort(F.collect_list(F.struct(*order, "_sym"))).alias("_items"))
    table = F.create_map(*[x for s, m in moves.items() for sym, t in m.items() for x in (F.lit(f"{s}|{sym}"), F.lit(t))])
    step = lambda s, sym: F.coalesce(table[F.concat(s, F.lit("|"), sym)], s)
    ends = F.map_from_arrays(F.array(*map(F.lit, states)), F.array(*[F.aggregate("_items", F.lit(s), lambda a, i: step(a, i["_sym"])) for s in states]))
    slots = items.select(*key, "_slot", ends.alias("_f"), F.size("_items").alias("_n"))
    whole = slots.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_slot", F.map_entries("_f").alias("f")))).alias("fs"), F.sum("_n").alias("n_messages"))
    final = F.aggregate("fs", F.lit(initial), lambda s, f: F.map_from_entries(f["f"])[s])
    return whole.select(*key, final.alias("state"), "n_messages")


def idle_sessions(events: DataFrame, key: list[str], time: str, order: str, timeout: int) -> DataFrame:
    """A row for each session: key, session (from 1), first, last, n.  A gap above the timeout ends one."""
    w = Window.partitionBy(*key).orderBy(time, order)
    new = F.when(F.coalesce(F.col(time) - F.lag(time).over(w) > timeout, F.lit(True)), 1).otherwise(0)
    rows = events.withColumn("_new", new).withColumn("session", F.sum("_new").over(w).cast("long"))
    return rows.groupBy(*key, "session").agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("n"))


def due_timers(started: DataFrame, cancelled: DataFrame, key: list[str], time: str, delay: int) -> DataFrame:
    """Timers that fire: started, and not cancelled for the same key at or before the deadline.  Adds deadline."""
    timers = started.withColumn("deadline", F.col(time) + delay)
    stop = cancelled.select(*[F.col(k).alias(f"_{k}") for k in key], F.col(time).alias("_t"))
    same = [F.col(k) == F.col(f"_{k}") for k in key]
    on = (F.col("_t") > F.col(time)) & (F.col("_t") <= F.col("deadline"))
    for c in same:
        on = on & c
    return timers.join(stop, on, "left_anti")


class Reassembler:
    """In-order bytes of one direction; of segments with the same number the longer stays."""

    def __init__(self, start: int, limit: int = SEGMENT_LIMIT):
        self.next, self.limit, self.data, self.waiting = start, limit, bytearray(), {}

    def push(self, number: int, data: bytes) -> None:
        if len(self.data) + len(data) > self.limit:
            raise ValueError("the buffer is full")
        if number > self.next:
            if len(self.waiting.get(number, b"")) < len(data):
                self.waiting[number] = data
            return
        if number == self.next:
            self._append(data)

    def _append(self, data: bytes) -> None:
        self.data += data
        self.next += len(data)
        while self.next in self.waiting:
            more = self.waiting.pop(self.next)
            self.data += more
            self.next += len(more)

    def needed(self, upto: int) -> int:
        return max(0, upto - len(self.data))

    def compact(self, keep: int) -> None:
        del self.data[: max(0, len(self.data) - keep)]


def contiguous(segments: DataFrame, key: list[str], start: str, number: str, data: str, limit: int = SEGMENT_LIMIT) -> DataFrame:
    """The bytes of each flow up to the first gap: key, n_segments, payload.

    One segment of a number stays (the longest, of equals the greater in bytes).  In their order a segment belongs where it begins at the end of those
    before it, is passed over where it begins earlier, and ends the run where it begins later or would make the payload
    longer than limit.  Numbers are those of one turn of the counter (see unwrapped).  A flow gathers the numbers and lengths of at most
    limit segments, and then the payload.
    """
    near = segments.where((F.col(number) >= F.col(start)) & (F.col(number) - F.col(start) <= limit))
    longest = near.groupBy(*key, number).agg(F.max_by(data, F.struct(F.octet_length(data), data)).alias(data), F.min(start).alias("_start"))
    sizes = longest.groupBy(*key).agg(
        F.min("_start").cast("long").alias("_start"), F.array_sort(F.collect_list(F.struct(F.col(number).cast("long").alias("at"), F.octet_length(data).cast("long").alias("size")))).alias("_p")
    )
    over = lambda a, p: (p["at"] > a["next"]) | ((p["at"] == a["next"]) & (a["next"] + p["size"] - F.col("_start") > limit))
    walked = F.aggregate(
        "_p",
        F.struct(F.col("_start").alias("next"), F.lit(False).alias("done"), F.array().cast("array<bigint>").alias("kept")),
        lambda a, p: F.when(a["done"] | (p["at"] < a["next"]), a)
        .when(over(a, p), F.struct(a["next"].alias("next"), F.lit(True).alias("done"), a["kept"].alias("kept")))
        .otherwise(F.struct((a["next"] + p["size"]).alias("next"), F.lit(False).alias("done"), F.concat(a["kept"], F.array(p["at"])).alias("kept"))),
    )
    kept = sizes.select(*[F.col(k).alias(f"_{k}") for k in key], F.explode(walked["kept"]).alias("_at"))
    on = F.col(number) == F.col("_at")
    for k in key:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    parts = longest.join(kept, on).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(number, data))).alias("_p"))
    return parts.select(*key, F.size("_p").cast("long").alias("n_segments"), F.unhex(F.array_join(F.transform("_p", lambda p: F.hex(p[data])), "")).alias("payload"))


def unwrapped(number: Column, start: Column) -> Column:
    """A 32-bit number as one that goes on rising past 2**32, counted from the start of its flow: up to 2**31 ahead of it."""
    ahead = F.pmod(number - start, F.lit(1 << 32))
    return start + F.when(ahead < 1 << 31, ahead).otherwise(ahead - (1 << 32))
