"""Records of an archive of stored members as column expressions, and checksums of joined parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the archive format: signatures, versions, the date 1980-01-01, marks of 64-bit fields.
LOCAL, ENTRY, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
VERSION, VERSION64, DATE = 20, 45, 0x0021
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
CRC_POLYNOMIAL = 0xEDB88320

LOCAL_BYTES, ENTRY_BYTES, OFFSET64_BYTES = 30, 46, 12


def _field(value: Column | int, size: int) -> Column | str:
    """The hexadecimal digits of ``value`` as ``size`` bytes, least first."""
    if isinstance(value, int):
        return value.to_bytes(size, "little").hex()
    bytes_ = "".join(f"(?<b{i}>..)" for i in range(size))
    turned = "".join(f"${{b{i}}}" for i in reversed(range(size)))
    return F.regexp_replace(F.lpad(F.hex(value.cast("long")), 2 * size, "0"), bytes_, turned)


def _record(*fields: tuple[Column | int, int]) -> Column:
    """The bytes of (value, size) fields; what is constant becomes one literal."""
    parts: list = []
    for part in (_field(*f) for f in fields):
        if isinstance(part, str) and parts and isinstance(parts[-1], str):
            parts[-1] += part
        else:
            parts.append(part)
    return F.unhex(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))


def _bytes(text: Column) -> Column:
    return text.cast("binary")


def local_header(name: Column, crc: Column, size: Column) -> Column:
    """What stands before a stored member."""
    fields = [(LOCAL, 4), (VERSION, 2), (0, 6), (DATE, 2), (crc, 4), (size, 4), (size, 4), (F.octet_length(name), 2), (0, 2)]
    return F.concat(_record(*fields), _bytes(name))


def local_size(name: Column, size: Column) -> Column:
    return F.lit(LOCAL_BYTES) + F.octet_length(name) + size


def entry(name: Column, crc: Column, size: Column, at: Column) -> Column:
    """A member's entry in the directory; a start beyond 32 bits goes to an extra field."""
    far = at >= FULL32
    made, needed = (VERSION64, 2), (F.when(far, VERSION64).otherwise(VERSION), 2)
    fields = [(ENTRY, 4), made, needed, (0, 6), (DATE, 2), (crc, 4), (size, 4), (size, 4), (F.octet_length(name), 2)]
    fields += [(F.when(far, OFFSET64_BYTES).otherwise(0), 2), (0, 10), (F.least(at, F.lit(FULL32)), 4)]
    extra = F.when(far, _record((1, 2), (8, 2), (at, 8))).otherwise(F.lit(b""))
    return F.concat(_record(*fields), _bytes(name), extra)


def entry_size(name: Column, at: Column) -> Column:
    return F.lit(ENTRY_BYTES) + F.octet_length(name) + F.when(at >= FULL32, OFFSET64_BYTES).otherwise(0)


def ending(members: Column, size: Column, at: Column) -> Column:
    """What ends an archive whose directory has ``size`` bytes from ``at`` on."""
    large = (members >= FULL16) | (at >= FULL32) | (size >= FULL32)
    wide = [(END64, 4), (44, 8), (VERSION64, 2), (VERSION64, 2), (0, 8), (members, 8), (members, 8), (size, 8), (at, 8)]
    wide += [(LOCATOR64, 4), (0, 4), (at + size, 8), (1, 4)]
    count = F.least(members, F.lit(FULL16))
    short = [(END, 4), (0, 4), (count, 2), (count, 2), (F.least(size, F.lit(FULL32)), 4), (F.least(at, F.lit(FULL32)), 4), (0, 2)]
    return F.concat(F.when(large, _record(*wide)).otherwise(F.lit(b"")), _record(*short))


def _times(a: int, b: int) -> int:
    """Product of two polynomials, lowest power in the top bit, modulo that of crc32."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (CRC_POLYNOMIAL if b & 1 else 0)
    return out


def joined_crc(first: int, second: int, size: int) -> int:
    """crc32 of two parts one after another, the second of ``size`` bytes."""
    power, shift = 1 << 23, 1 << 31  # x^8 and 1
    while size:
        if size & 1:
            shift = _times(shift, power)
        power = _times(power, power)
        size >>= 1
    return _times(first, shift) ^ second
