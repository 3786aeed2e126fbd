"""Keys of scopes and flows.  Hashes are 64 bits in a BIGINT (see unsigned); all of it is column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import unsigned

# FNV-1a with 64 bits.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
# Scope types by number, and their names in reports.
SCOPES = {"Session": "session", "Port": "port", "ClientMac": "client_mac", "Vlan": "vlan", "AccessPoint": "access_point", "Global": "global"}


def fnv(data: Column) -> Column:
    """FNV-1a-64 of a binary column."""
    digits, size = F.hex(data), F.octet_length(data)
    byte = lambda i: F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("long")
    found = F.when(size > 0, F.transform(F.sequence(F.lit(0), F.greatest(size, F.lit(1)) - 1), byte)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(found, unsigned.literal(FNV_BASIS), lambda h, b: unsigned.binary("*", h.bitwiseXOR(b), unsigned.literal(FNV_PRIME)))


def hex64(h: Column) -> Column:
    """A hash as 16 hexadecimal digits."""
    return F.lower(F.lpad(F.hex(h), 16, F.lit("0")))


def fnv_hex(text: Column) -> Column:
    """FNV-1a-64 of the text in UTF-8, as 16 hexadecimal digits."""
    return hex64(fnv(text.cast("binary")))


def _bytes(c: Column) -> Column:
    return F.unhex(F.lpad(F.hex(c.cast("long")), 16, F.lit("0")))


def address(c: Column) -> Column:
    """An address of 4 or 16 bytes as 16, a short one as mapped into the long ones."""
    return F.when(F.octet_length(c) == 4, F.concat(F.unhex(F.lit("00000000000000000000FFFF")), c)).otherwise(c)


def scope_key(scope: str, *parts: Column) -> Column:
    """The key of a scope: of a Port switch and port, of a ClientMac or AccessPoint the address, of a Vlan its number (all BIGINT).

    Of a Session its ends (see session_key); Global has none.
    """
    return unsigned.literal(0) if scope == "Global" else fnv(F.concat(*map(_bytes, parts)))


def session_key(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """The key of a session between two ends of address (4 or 16 bytes) and port, in either direction."""
    x, y = (F.concat(address(ip), _bytes(port)) for ip, port in (a, b))
    return fnv(F.when(x <= y, F.concat(x, y)).otherwise(F.concat(y, x)))


def scope_hash(scope: Column, key: Column) -> Column:
    """Type and key in one hash."""
    number = F.lit(None).cast("string")
    for i, name in enumerate(SCOPES):
        number = F.when(scope == name, f"{i:02X}").otherwise(number)
    return fnv(F.concat(F.unhex(number), _bytes(key)))


def scope_name(scope: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, shown in SCOPES.items():
        out = F.when(scope == name, shown).otherwise(out)
    return out


def both_ways(a: Column, b: Column) -> Column:
    """One key for a conversation in either direction: both ends, the smaller first, eight bytes each."""
    return F.concat(_bytes(F.least(a, b)), _bytes(F.greatest(a, b)))


def endpoints(a: tuple[Column, ...], b: tuple[Column, ...], compat: bool = False) -> Column:
    """Ends of several parts each, sorted as wholes.  compat keeps only the first 16 bytes, which is the smaller end."""
    parts = lambda e: F.concat(*map(_bytes, e))
    x, y = parts(a), parts(b)
    key = F.when(F.hex(x) <= F.hex(y), F.concat(x, y)).otherwise(F.concat(y, x))
    return F.substring(key, 1, 16) if compat else key
