"""Schemas, kinds, limits and errors of a versioned key-value table."""

from __future__ import annotations

import base64

from pyspark.sql import Column
from pyspark.sql import functions as F

PUT, DELETE = 0, 1
MAX_SEQ = (1 << 56) - 1
MAX_BYTES = 1 << 30  # of a key with its value, and of a batch
TTL_BYTES = 8  # what a deadline adds to a value's size
NEVER = 0

MUTATIONS = "seq bigint, kind int, key binary, value binary, expires_at bigint, batch_seq bigint"
RANGE_DELETES = "start_key binary, end_key binary, seq bigint"


class TableError(Exception):
    """Base of all errors of a table."""


class NotFound(TableError, KeyError):
    pass


class Closed(TableError):
    pass


class ReadOnly(TableError):
    pass


class EmptyKey(TableError, ValueError):
    pass


class EntryTooLarge(TableError, ValueError):
    pass


class BatchTooLarge(TableError, ValueError):
    pass


class InvalidTTL(TableError, ValueError):
    pass


class InvalidRange(TableError, ValueError):
    pass


class RangeDeletesInFile(TableError, ValueError):
    """A file to ingest holds range deletes."""


class RetentionExpired(TableError):
    """Changes that were asked for are no longer kept."""


class Corruption(TableError):
    pass


class SequenceExhausted(TableError):
    pass


def live_at(expires_at: Column, now: int | Column) -> Column:
    """A deadline has passed once it is reached; 0 never passes."""
    return (expires_at == NEVER) | (expires_at > (F.lit(now) if isinstance(now, int) else now))


def in_bounds(key: Column, start, end) -> Column:
    """start <= key < end; None leaves a side open, an empty end holds nothing."""
    out = F.lit(True)
    if start is not None:
        out = out & (key >= F.lit(start))
    if end is not None:
        out = out & (key < F.lit(end))
    return out


def size_of(value: Column) -> Column:
    return F.coalesce(F.octet_length(value), F.lit(0)).cast("bigint")


#: How much of a long key is shown.
SHOWN, HEAD, TAIL = 128, 112, 8


def shown(key: bytes) -> str:
    """Bytes for a log: as they are if they can be printed, else in URL-safe base64; the middle of long ones is left out."""
    plain = lambda b: b.decode() if all(0x20 <= c <= 0x7E for c in b) else base64.urlsafe_b64encode(b).decode().rstrip("=")
    return plain(key) if len(key) <= SHOWN else f"{plain(key[:HEAD])}..({len(key)}B)..{plain(key[-TAIL:])}"
