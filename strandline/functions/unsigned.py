"""Wire arithmetic on unsigned 64-bit values, which travel as the same 64 bits in a BIGINT.

number() reads such bits out as DECIMAL(20,0), and raw() takes a decimal in.  Sums and products are put together from halves, as
BIGINT arithmetic refuses to wrap; only division by or of values with the top bit set goes through decimals.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KIND = "decimal(20,0)"
RANGE = "18446744073709551616"
LEAST, ONES = -(1 << 63), (1 << 32) - 1


def literal(value: int) -> Column:
    value %= 1 << 64
    return F.lit(value - (1 << 64) if value >> 63 else value).cast("long")


def raw(c: Column) -> Column:
    """The bits of a decimal."""
    top = F.lit(str(1 << 63)).cast(KIND)
    return F.when(c >= top, (c.cast("decimal(38,0)") - F.lit(RANGE).cast("decimal(38,0)")).cast("long")).otherwise(F.when(c < top, c).cast("long"))


def number(c: Column) -> Column:
    """Bits as a decimal."""
    value = c.cast(KIND)
    return F.when(c < 0, (value + F.lit(RANGE).cast(KIND)).cast(KIND)).otherwise(value)


def _shift(name: str, c: Column, by: int | Column) -> Column:
    return F.call_function(name, c, F.lit(by) if isinstance(by, int) else by)


def _low(c: Column) -> Column:
    return c.bitwiseAND(F.lit(ONES))


def _high(c: Column) -> Column:
    return _shift("shiftrightunsigned", c, 32)


def _joined(high: Column, low: Column) -> Column:
    return _shift("shiftleft", high, 32).bitwiseOR(_low(low))


def _plus(x: Column, y: Column) -> Column:
    low = _low(x) + _low(y)
    return _joined(_high(x) + _high(y) + _high(low), low)


def _minus(x: Column, y: Column) -> Column:
    low = _low(x) - _low(y)
    return _joined(_high(x) - _high(y) + _shift("shiftright", low, 32), low)


def _times(x: Column, y: Column) -> Column:
    """Of four products of halves two count only by their low half; factors of 16 bits keep each product below 2**63."""
    below = lambda a: a.bitwiseAND(F.lit(0xFFFF))
    above = lambda a: _shift("shiftrightunsigned", a, 16)
    half = lambda a, b: _shift("shiftleft", below(above(a) * b), 16) + below(a) * b
    xl, xh, yl, yh = _low(x), _high(x), _low(y), _high(y)
    whole = _plus(_shift("shiftleft", above(xl) * yl, 16), below(xl) * yl)
    return _plus(whole, _shift("shiftleft", _low(half(xh, yl) + half(xl, yh)), 32))


def _divided(x: Column, y: Column, remainder: bool) -> Column:
    safe = F.when(y == 0, F.lit(1).cast("long")).otherwise(y)
    a, b = number(x).cast("decimal(38,0)"), number(safe).cast("decimal(38,0)")
    rest = F.pmod(a, b)
    # Decimal division rounds, so only multiples are divided.
    large = rest if remainder else F.round((a - rest) / b, 0)
    small = x % safe if remainder else F.call_function("div", x, safe)
    return F.when(y == 0, F.lit(0).cast("long")).when(x.bitwiseOR(y) >= 0, small).otherwise(raw(large.cast(KIND)))


def below(x: Column, y: Column) -> Column:
    flip = lambda c: c.bitwiseXOR(F.lit(LEAST))
    return flip(x) < flip(y)


def binary(op: str, a: Column, b: Column) -> Column:
    """Subtraction stops at 0, division by 0 gives 0, sums and products wrap, comparisons give 0 or 1."""
    x, y = a.cast("long"), b.cast("long")
    if op == "-":
        return F.when(below(x, y), F.lit(0).cast("long")).otherwise(_minus(x, y))
    if op in ("/", "%"):
        return _divided(x, y, op == "%")
    if op in ("+", "*"):
        return _plus(x, y) if op == "+" else _times(x, y)
    if op in ("<<", ">>"):
        return _shift("shiftleft" if op == "<<" else "shiftrightunsigned", x, y.bitwiseAND(F.lit(63)).cast("int"))
    if op in ("&", "|", "^"):
        return {"&": x.bitwiseAND, "|": x.bitwiseOR, "^": x.bitwiseXOR}[op](y)
    true = {
        "==": lambda: x == y, "!=": lambda: x != y, "<": lambda: below(x, y), "<=": lambda: ~below(y, x), ">": lambda: below(y, x), ">=": lambda: ~below(x, y),
        "and": lambda: (x != 0) & (y != 0), "or": lambda: (x != 0) | (y != 0),
    }[op]()
    return F.when(true, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))


def unary(op: str, a: Column) -> Column:
    x = a.cast("long")
    if op == "not":
        return F.when(x == 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
    return F.bitwise_not(x) if op == "inv" else _minus(F.lit(0).cast("long"), x)


def of_bytes(c: Column) -> Column:
    """Up to 8 bytes, the most significant first."""
    return F.conv(F.hex(c), 16, -10).cast("long")


def big_endian(buffer: Column, at: Column | int, size: int) -> Column:
    """size bytes (up to 8) at a 0-based offset as a number."""
    at = F.lit(at) if isinstance(at, int) else at
    return of_bytes(F.substring(buffer, at + 1, F.lit(size)))


def little_endian(buffer: Column, at: Column | int, size: int) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return of_bytes(F.concat(*[F.substring(buffer, at + 1 + i, F.lit(1)) for i in reversed(range(size))]))


def bits(buffer: Column, first: int, count: int) -> Column:
    """count bits (up to 56, or 64 on a byte boundary), the most significant first, from bit number first."""
    start, end = first // 8, (first + count + 7) // 8
    value = big_endian(buffer, start, end - start)
    drop = end * 8 - first - count
    if drop:
        value = _shift("shiftrightunsigned", value, drop)
    return value if count == 64 else value.bitwiseAND(F.lit((1 << count) - 1))
