"""Domain names with compression pointers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

JUMPS = 16


def dns_name(root: bytes, offset: int) -> tuple[str | None, int, str]:
    """Name, bytes that it takes on the wire at offset, and ok or what is wrong.  A label may have up to 191 bytes."""
    labels, at, wire, jumps, seen = [], offset, None, 0, set()
    while True:
        if at >= len(root) or at < 0:
            return None, 0, "truncated"
        size = root[at]
        if size == 0:
            return ".".join(labels), (at + 1 - offset) if wire is None else wire, "ok"
        if size & 0xC0 == 0xC0:
            if at + 1 >= len(root):
                return None, 0, "truncated"
            wire = at + 2 - offset if wire is None else wire
            jumps += 1
            target = (size & 0x3F) << 8 | root[at + 1]
            if target in seen or jumps > JUMPS:
                return None, 0, "loop"
            seen.add(target)
            at = target
            continue
        if at + 1 + size > len(root):
            return None, 0, "truncated"
        labels.append(root[at + 1 : at + 1 + size].decode("utf-8", "replace"))
        at += 1 + size


@F.pandas_udf(T.StructType().add("name", "string").add("wire_len", "integer").add("status", "string"))
def dns_names(root: pd.Series, offset: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([dns_name(bytes(r), int(o)) for r, o in zip(root, offset)], columns=["name", "wire_len", "status"])


class Plugins:
    """Functions that formats may call: name, number of arguments, and the function over (root, *arguments)."""

    def __init__(self):
        self._known: dict[str, tuple[int, object]] = {"dns_decompress": (1, dns_name)}

    def register(self, name: str, arity: int, function) -> None:
        if name in self._known:
            raise ValueError(f"{name} is registered")
        self._known[name] = (arity, function)

    def invoke(self, name: str, root: bytes, *args):
        if name not in self._known:
            raise KeyError(f"no plugin {name}")
        arity, function = self._known[name]
        if len(args) != arity:
            raise TypeError(f"{name} takes {arity} arguments")
        return function(root, *args)
