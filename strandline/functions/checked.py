"""Rule arithmetic: 64-bit with errors beside values, comparisons and logic in three values (null is unknown)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Checked:
    """error is true where the value could not be computed; a predicate with an error does not hold."""

    value: Column
    error: Column

    def holds(self) -> Column:
        return F.coalesce(self.value, F.lit(False)) & ~self.error


def exact(value: Column) -> Checked:
    return Checked(value, F.lit(False))


def arithmetic(op: str, a: Checked, b: Checked) -> Checked:
    x, y = a.value.cast("long"), b.value.cast("long")
    zero = y == 0
    least = (x == F.lit(-(1 << 63))) & (y == -1)
    if op == "/":
        value = F.when(zero | least, F.lit(None)).otherwise(F.call_function("div", x, F.when(zero | least, F.lit(1)).otherwise(y)))
    elif op == "%":
        value = F.when(zero | least, F.lit(None)).otherwise(F.try_mod(x, y))
    else:
        value = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y)
    failed = x.isNotNull() & y.isNotNull() & value.isNull()
    return Checked(value.cast("long"), a.error | b.error | failed)


def compare(op: str, a: Checked, b: Checked) -> Checked:
    x, y = a.value, b.value
    value = {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    return Checked(value, a.error | b.error)


def logic(op: str, a: Checked, b: Checked) -> Checked:
    """Kleene; both sides are evaluated, so an error on either counts."""
    return Checked(a.value & b.value if op == "and" else a.value | b.value, a.error | b.error)


def negate(a: Checked) -> Checked:
    return Checked(~a.value, a.error)


def presence(state: Column, wanted: str) -> Checked:
    """state: Bound, Absent or Unknown."""
    yes, no = ("Bound", "Absent") if wanted == "present" else ("Absent", "Bound")
    return exact(F.when(state == yes, True).when(state == no, False))
