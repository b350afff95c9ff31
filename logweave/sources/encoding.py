"""Encodings of byte strings: detection and decoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that a user may choose from; the last two are one encoding.
ENCODINGS = ("UTF-8", "UTF-16LE", "UTF-16BE", "windows-1252", "ISO-8859-1")


def whole_characters(data: Column, size: int) -> Column:
    """The first ``size`` bytes, less a UTF-8 character that the cut would break."""
    head = F.substring(data, 1, size)
    cut = [F.substring(data, 1, size - k) for k in (1, 2, 3)]
    whole = F.when(F.octet_length(data) <= size, head)
    for part in (head, *cut):
        whole = whole.when(F.is_valid_utf8(part.cast("string")), part)
    return whole.otherwise(head)


def detect(data: Column, sniff: int | None = None) -> Column:
    """By byte-order mark, else UTF-8 if the bytes are valid, else windows-1252."""
    seen = data if sniff is None else whole_characters(data, sniff)
    start = F.hex(F.substring(data, 1, 3))
    found = F.when(start == "EFBBBF", "UTF-8").when(start.startswith("FFFE"), "UTF-16LE").when(start.startswith("FEFF"), "UTF-16BE")
    return found.when(F.is_valid_utf8(seen.cast("string")), "UTF-8").otherwise("windows-1252")


def decoded_range(data: Column, start: int, end: int) -> Column:
    """Bytes [start, end) as UTF-8, with marks in place of what is not valid; empty if the range is."""
    if start >= end:
        return F.lit("")
    return F.make_valid_utf8(F.substring(data, start + 1, end - start).cast("string"))
