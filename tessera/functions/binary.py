"""Tests on binary columns, and the same tests on Python's bytes."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What files of each format have at which places.
SIGNATURES: dict[str, tuple[tuple[int, bytes], ...]] = {
    "jpeg": ((0, b"\xff\xd8\xff"),),
    "png": ((0, b"\x89PNG\r\n\x1a\n"),),
    "gif": ((0, b"GIF8"),),
    "webp": ((0, b"RIFF"), (8, b"WEBP")),
}
#: Bytes from which a signature counts, and over which anything passes.
SHORTEST, UNSIGNED = 32, 1024


def is_valid_image(data: Column) -> Column:
    """True for SHORTEST bytes or more with a known signature, or for more than UNSIGNED bytes of anything."""
    has = lambda at, mark: F.substring(data, at + 1, len(mark)) == F.lit(bytearray(mark))
    signed = reduce(or_, (reduce(and_, (has(*part) for part in parts)) for parts in SIGNATURES.values()))
    size = F.octet_length(data)
    return F.coalesce((size > UNSIGNED) | ((size >= SHORTEST) & signed), F.lit(False))


def valid_image(data: bytes) -> bool:
    """is_valid_image() of one value."""
    signed = any(all(data[at : at + len(mark)] == mark for at, mark in parts) for parts in SIGNATURES.values())
    return len(data) > UNSIGNED or (len(data) >= SHORTEST and signed)
