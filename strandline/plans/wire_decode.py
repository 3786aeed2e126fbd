"""Decoding: any protocol over Arrow batches, message by message or a batch at once, and straight layouts as column expressions.

Values are unsigned 64-bit.  A datagram that is too short gives 0 for the field and does not move on; a stream asks for
more.  Names that are not known are errors when a protocol is compiled, and 0 with compat=True, as are __count and
__rem, which otherwise are the turn of the loop and the bytes that are left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import unsigned
from ..functions.names import Plugins
from .wire_batch import can_batch, decoded_arrays
from .wire_text import Field, Let, Loop, Match, Protocol, Validate

MASK = (1 << 64) - 1
STEPS, TURNS, NAMES, DEPTH = 100_000, 10_000, 1024, 8


class Invalid(ValueError):
    """The message is not valid, or a limit is reached."""


class NeedMore(Exception):
    """A stream that ends inside a field, which needs so many bytes more."""

    def __init__(self, needed: int = 1):
        super().__init__(f"{needed} more bytes are needed")
        self.needed = needed


def compute(op: str, a: int, b: int) -> int:
    if op == "-":
        return max(0, a - b)
    if op in ("/", "%"):
        return 0 if b == 0 else a // b if op == "/" else a % b
    if op in ("<<", ">>"):
        return (a << (b & 63)) & MASK if op == "<<" else a >> (b & 63)
    if op in ("and", "or"):
        return int(bool(a and b) if op == "and" else bool(a or b))
    if op in ("==", "!=", "<", "<=", ">", ">="):
        return int({"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op])
    return ({"+": a + b, "*": a * b, "&": a & b, "|": a | b, "^": a ^ b}[op]) & MASK


def evaluate(e: tuple, get) -> int:
    op = e[0]
    if op in ("int", "ms"):
        return e[1] & MASK
    if op == "bool":
        return int(e[1])
    if op == "name":
        return get(e[1])
    if op == "not":
        return int(evaluate(e[1], get) == 0)
    if op in ("inv", "neg"):
        x = evaluate(e[1], get)
        return (~x if op == "inv" else -x) & MASK
    if op == "if":
        return evaluate(e[2] if evaluate(e[1], get) else e[3], get)
    if op == "??":
        return evaluate(e[1], get) or evaluate(e[2], get)
    if op == "call":
        return 0
    return compute(op, evaluate(e[1], get), evaluate(e[2], get))


@dataclass
class Decoded:
    fields: dict[str, int]
    emitted: list[tuple[str, int]]
    consumed: int
    error: str | None = None
    payload: tuple[int, int] | None = None


class Decoder:
    def __init__(self, protocol: Protocol, compat: bool = False, plugins: Plugins | None = None):
        self.protocol, self.compat, self.plugins = protocol, compat, plugins or Plugins()

    def decode(self, data: bytes, message: str | None = None) -> Decoded:
        """Fields by dotted name (loops keep the last turn), all values in the order of reading, bytes used."""
        self.data, self.at, self.bit, self.steps, self.count = data, 0, 0, 0, 0
        self.fields, self.emitted, self.rest, self.locals = {}, [], None, {}
        error = None
        try:
            self._body(self.protocol.messages[message or self.protocol.root], "", 0)
            if len(self.fields) > NAMES:
                raise Invalid("too many fields")
        except Invalid as why:
            error = str(why)
        return Decoded({**self.fields, "__current_offset": self.at}, self.emitted, self.at, error, self.rest)

    def layers(self, data: bytes) -> dict[str, int]:
        """The root's fields and, where a bind of this protocol holds, those of the layer in its rest, one level deep."""
        got = self.decode(data)
        out = dict(got.fields)
        if got.error or got.payload is None:
            return out
        start, end = got.payload
        for _, inner, condition in self.protocol.binds:
            if inner in self.protocol.messages and evaluate(condition, lambda n: out.get(n, 0)):
                below = Decoder(self.protocol, self.compat, self.plugins).decode(data[start:end], inner)
                if not below.error:
                    out |= {f"{inner}.{k}": v for k, v in below.fields.items()}
        return out

    def _get(self, prefix: str):
        def get(name: str) -> int:
            own = prefix + name
            if own in self.locals:
                return self.locals[own]
            if own in self.fields:
                return self.fields[own]
            if name == "__current_offset":
                return self.at
            if name in ("__count", "__rem") and not self.compat:
                return self.count if name == "__count" else max(0, len(self.data) - self.at)
            at = prefix
            while True:
                for known in (self.locals, self.fields):
                    if at + name in known:
                        return known[at + name]
                if not at:
                    break
                at = at.rstrip(".").rpartition(".")[0]
                at = at + "." if at else ""
            base, _, last = name.rpartition(".")
            if base:
                for part in (last, base):
                    if part in self.fields:
                        return self.fields[part]
            if self.compat or name.startswith("__") or base:
                return 0
            # A field that was skipped has no value; what no message names is an error.
            if any(name == getattr(s, "name", None) for m in self.protocol.messages.values() for s in m):
                return 0
            raise Invalid(f"unknown name {name}")

        return get

    def _step(self) -> None:
        self.steps += 1
        if self.steps > STEPS:
            raise Invalid("too many steps")

    def _body(self, body: tuple, prefix: str, depth: int) -> None:
        get = self._get(prefix)
        for s in body:
            self._step()
            if isinstance(s, Field):
                if s.when is None or evaluate(s.when, get):
                    self._field(s, prefix, depth, get)
            elif isinstance(s, Let):
                if s.value[0] == "call" and s.value[1] == "invoke":
                    self._invoke(s, prefix, get)
                else:
                    self.locals[prefix + s.name] = evaluate(s.value, get)
                    self.fields[prefix + s.name] = self.locals[prefix + s.name]
            elif isinstance(s, Validate):
                if not evaluate(s.value, get):
                    raise Invalid(s.message)
            elif isinstance(s, Match):
                value = evaluate(s.value, get)
                self._body(next((b for case, b in s.cases if evaluate(case, get) == value), s.default or ()), prefix, depth)
            else:
                self._loop(s, prefix, depth, get)

    def _invoke(self, s: Let, prefix: str, get) -> None:
        name, *args = s.value[2]
        values = [self.at if a == ("name", "__root_offset") else evaluate(a, get) for a in args if a != ("name", "__root_buffer")]
        got = self.plugins.invoke(name[1], self.data, *values)
        if isinstance(got, tuple):
            text, size, status = got
            if status != "ok":
                raise Invalid(f"{name[1]}: {status}")
            self.locals[f"{prefix}{s.name}.wire_len"] = size
        else:
            self.locals[prefix + s.name] = int(got)

    def _field(self, s: Field, prefix: str, depth: int, get) -> None:
        if s.kind not in ("bits", "number", "bytes", "rest"):
            if s.kind not in self.protocol.messages:
                raise Invalid(f"no message {s.kind}")
            if depth >= DEPTH:
                value = self._number(1, False)
                self.fields[prefix + s.name] = value
                return
            self._body(self.protocol.messages[s.kind], f"{prefix}{s.name}.", depth + 1)
            return
        if s.kind == "bits":
            value = self._bits(s.size)
        else:
            if self.bit:
                self.at, self.bit = self.at + 1, 0
            if s.kind == "number":
                value = self._number(s.size, self.protocol.little if s.little is None else s.little)
            elif s.kind == "rest":
                value = max(0, len(self.data) - self.at)
                self.rest = (self.at, len(self.data))
                self.at = max(self.at, len(self.data))
            else:
                size = evaluate(s.size, get)
                if self.protocol.stream and self.at + size > len(self.data):
                    raise NeedMore(self.at + size - len(self.data))
                value = int.from_bytes(self.data[self.at : self.at + min(size, 8)], "big")
                self.rest = (self.at, min(len(self.data), self.at + size))
                self.at += size
        self.fields[prefix + s.name] = value
        self.emitted.append((s.name, value))

    def _number(self, size: int, little: bool) -> int:
        if self.at + size > len(self.data):
            if self.protocol.stream:
                raise NeedMore(self.at + size - len(self.data))
            return 0
        self.at += size
        return int.from_bytes(self.data[self.at - size : self.at], "little" if little else "big")

    def _bits(self, count: int) -> int:
        value = 0
        for _ in range(count):
            if self.at >= len(self.data):
                if self.protocol.stream:
                    raise NeedMore
                break
            value = value << 1 | (self.data[self.at] >> (7 - self.bit)) & 1
            self.bit += 1
            if self.bit == 8:
                self.at, self.bit = self.at + 1, 0
        return value

    def _loop(self, s: Loop, prefix: str, depth: int, get) -> None:
        inner = f"{prefix}{s.name}."
        own = self._get(inner)
        for name, first in s.carries:
            self.locals[inner + name] = evaluate(first, get)
        outer, self.count = self.count, 0
        while evaluate(s.condition, own):
            before = self.at
            self._body(s.body, inner, depth)
            for name, value in s.nexts:
                self.locals[inner + name] = evaluate(value, own)
            self.count += 1
            self._step()
            if self.count > TURNS or (not s.nexts and self.at == before) or (self.at >= len(self.data) and self.at == before):
                raise Invalid("a loop that does not end")
        self.count = outer
        for name, _ in s.carries:
            self.fields[f"{prefix}{s.name}.carries.{name}"] = self.locals[inner + name]


class Resumable:
    """Messages of a stream that comes in pieces.  What is not decoded yet is kept, and decoded again with the next piece.

    A message decodes to the same fields however the stream is cut, as decoding looks at nothing but its bytes.  More than
    limit bytes of one message are an error; after an error nothing is decoded any more.
    """

    def __init__(self, protocol: Protocol, compat: bool = False, limit: int = 1 << 20):
        self.decoder, self.limit, self.data, self.needed, self.error = Decoder(protocol, compat), limit, b"", 1, None

    def feed(self, piece: bytes) -> list[Decoded]:
        """The messages that end in this piece; needed is then the least number of bytes until the next field."""
        found: list[Decoded] = []
        self.data += piece
        while self.data and not self.error:
            try:
                got = self.decoder.decode(self.data)
            except NeedMore as why:
                self.needed = why.needed
                if len(self.data) > self.limit:
                    self.error = "the buffer is full"
                return found
            if got.error or not got.consumed:
                self.error = got.error or "a message without bytes"
                break
            found.append(got)
            self.data, self.needed = self.data[got.consumed :], 1
        return found


def resume_column(df: DataFrame, key: str, order: list[str], buffer: str, protocol: Protocol, compat: bool = False, limit: int = 1 << 20) -> DataFrame:
    """df with done (the fields of each message that ends in the row's piece), needed (bytes until the next field, null
    after an error) and error; pieces of a flow (key) follow one another in order.

    Flows stream by; a task holds one batch, and of one flow what is not decoded yet.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stream = None, None
        for batch in batches:
            done, needed, errors = [], [], []
            for k, piece in zip(batch.column(key).to_pylist(), batch.column(buffer).to_pylist()):
                if stream is None or k != at:
                    at, stream = k, Resumable(protocol, compat, limit)
                done.append([list({n: Decimal(v) for n, v in got.fields.items()}.items()) for got in stream.feed(piece or b"")])
                needed.append(None if stream.error else stream.needed)
                errors.append(stream.error)
            kind = pa.list_(pa.map_(pa.string(), pa.decimal128(20, 0)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(done, kind), pa.array(needed, pa.int64()), pa.array(errors, pa.string())], [*batch.schema.names, "done", "needed", "error"])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    dealt = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key, *order)
    return dealt.mapInArrow(fold, f"{names}, done array<map<string,decimal(20,0)>>, needed long, error string")


def decode_column(df: DataFrame, buffer: str, protocol: Protocol, compat: bool = False, layers: bool = False) -> DataFrame:
    """df with fields (map of decimals), emitted (array of name and value), consumed and error, decoded over Arrow batches.

    A batch is decoded at once (wire_batch), save for streams and formats with plugins, which go message by message.
    """
    number = pa.decimal128(20, 0)
    added = ["fields", "emitted", "consumed", "error"]

    def numbers(values: list[int]) -> pa.Array:
        return pa.array(np.array(values, dtype=np.uint64)).cast(number)

    def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *decoded_arrays(protocol, compat, batch.column(buffer), layers, limits)], [*batch.schema.names, *added])

    limits = (STEPS, TURNS, NAMES, DEPTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(protocol, compat)
        for batch in batches:
            keys, values, ends = [], [], [0]
            names, read, stops = [], [], [0]
            consumed, errors = [], []
            for data in batch.column(buffer).to_pylist():
                try:
                    got = decoder.decode(data or b"")
                    fields = decoder.layers(data or b"") if layers else got.fields
                    keys.extend(fields)
                    values.extend(fields.values())
                    for name, value in got.emitted:
                        names.append(name)
                        read.append(value)
                    consumed.append(got.consumed)
                    errors.append(got.error)
                except NeedMore:
                    consumed.append(0)
                    errors.append("more bytes are needed")
                ends.append(len(keys))
                stops.append(len(names))
            found = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys, pa.string()), numbers(values))
            order = pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.StructArray.from_arrays([pa.array(names, pa.string()), numbers(read)], ["name", "value"]))
            yield pa.RecordBatch.from_arrays([*batch.columns, found, order, pa.array(consumed, pa.int64()), pa.array(errors, pa.string())], [*batch.schema.names, *added])

    # A table of few large files would be decoded by as few tasks.
    wide = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df if df.isStreaming or df.rdd.getNumPartitions() >= wide else df.repartition(wide)
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(at_once if can_batch(protocol) else run, f"{names}, fields map<string,decimal(20,0)>, emitted array<struct<name:string,value:decimal(20,0)>>, consumed long, error string")


def columns(protocol: Protocol, buffer: Column, message: str | None = None) -> dict[str, Column]:
    """Fields as expressions over a binary column, for layouts without loops; __error is the first failed check.

    Offsets are a constant and one term for each part of varying size, so expressions do not grow with the number of
    fields before them.  Fields beyond the end of a short buffer are 0; __complete tells whether there are none.
    """
    out: dict[str, Column] = {}
    errors: list[Column] = []
    state = {"fixed": 0, "terms": [], "bit": 0}
    zero, far = unsigned.literal(0), 1 << 30

    def within(size: Column, most: int) -> Column:
        """An unsigned size as an int, at most the given one."""
        return F.when((size < 0) | (size > most), F.lit(most)).otherwise(size).cast("int")

    def offset() -> Column:
        at = F.lit(state["fixed"]).cast("long")
        for t in state["terms"]:
            at = at + t
        return within(at, far)

    def value(e: tuple, prefix: str) -> Column:
        op = e[0]
        if op in ("int", "ms", "bool"):
            return unsigned.literal(int(e[1]))
        if op == "name":
            if e[1] == "__current_offset":
                return offset().cast("long")
            for name in (prefix + e[1], e[1], e[1].rpartition(".")[2]):
                if name in out:
                    return F.coalesce(out[name], zero)
            raise Invalid(f"unknown name {e[1]}")
        if op in ("not", "inv", "neg"):
            return unsigned.unary(op, value(e[1], prefix))
        if op == "if":
            return F.when(value(e[1], prefix) != 0, value(e[2], prefix)).otherwise(value(e[3], prefix))
        if op == "??":
            return F.when(value(e[1], prefix) != 0, value(e[1], prefix)).otherwise(value(e[2], prefix))
        return unsigned.binary(op, value(e[1], prefix), value(e[2], prefix))

    def move(size, when: Column | None) -> None:
        if when is None and isinstance(size, int):
            state["fixed"] += size
        else:
            size = F.lit(size) if isinstance(size, int) else within(size, far)
            state["terms"].append(F.when(when, size).otherwise(0) if when is not None else size)

    def visit(body: tuple, prefix: str, when: Column | None) -> None:
        for s in body:
            here = when
            if isinstance(s, Field):
                if s.when is not None:
                    true = value(s.when, prefix) != 0
                    here = true if when is None else when & true
                if s.kind == "bits":
                    if here is not None:
                        raise Invalid("bits under a condition are decoded row by row")
                    first = state["bit"]
                    start = offset()
                    whole = F.substring(buffer, start + 1, F.lit((first + s.size + 7) // 8))
                    got = unsigned.bits(whole, first, s.size)
                    state["fixed"], state["bit"] = state["fixed"] + (first + s.size) // 8, (first + s.size) % 8
                else:
                    if state["bit"]:
                        state["fixed"], state["bit"] = state["fixed"] + 1, 0
                    start = offset()
                    if s.kind == "number":
                        read = unsigned.little_endian if (protocol.little if s.little is None else s.little) else unsigned.big_endian
                        got = F.when(start + s.size <= F.octet_length(buffer), read(buffer, start, s.size)).otherwise(zero)
                        move(s.size, here)
                    elif s.kind == "rest":
                        left = F.greatest(F.octet_length(buffer) - start, F.lit(0))
                        got = left.cast("long")
                        move(left, here)
                    elif s.kind == "bytes":
                        size = value(s.size, prefix)
                        head = F.substring(buffer, start + 1, within(size, 8))
                        got = F.when(F.octet_length(head) > 0, unsigned.of_bytes(head)).otherwise(zero)
                        move(size, here)
                    else:
                        visit(protocol.messages[s.kind], f"{prefix}{s.name}.", here)
                        continue
                out[prefix + s.name] = got if here is None else F.when(here, got)
            elif isinstance(s, Let):
                out[prefix + s.name] = value(s.value, prefix)
            elif isinstance(s, Validate):
                failed = value(s.value, prefix) == 0
                errors.append(F.when(failed if when is None else when & failed, F.lit(s.message)))
            elif isinstance(s, Match):
                chosen, done = value(s.value, prefix), F.lit(False)
                for case, body in s.cases:
                    true = chosen == value(case, prefix)
                    visit(body, prefix, (true & ~done) if when is None else when & true & ~done)
                    done = done | true
                visit(s.default or (), prefix, ~done if when is None else when & ~done)
            else:
                raise Invalid("loops are decoded row by row")

    visit(protocol.messages[message or protocol.root], "", None)
    out = {name: unsigned.number(c) for name, c in out.items()}
    out["__error"] = F.coalesce(*errors, F.lit(None).cast("string")) if errors else F.lit(None).cast("string")
    out["__complete"] = offset() <= F.octet_length(buffer)
    return out
