"""Reproducible keys, ids and choices derived from hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def piped(*parts: Column) -> Column:
    """Parts joined by ``|``; NULL when any part is NULL, so two different keys never share one text."""
    joined: list[Column] = []
    for i, part in enumerate(parts):
        joined += [F.lit("|")] * (i > 0) + [part.cast("string")]
    return F.concat(*joined)


def sample_key(entity_id: Column, seed: int) -> Column:
    """Order key of the seeded sample."""
    return F.md5(piped(entity_id, F.lit(str(seed))))


def digest_id(prefix: str, length: int, *parts: Column) -> Column:
    """Stable id: prefix and the first hex digits of SHA-256 over the piped parts."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(piped(*parts), 256), 1, length))


def digest_byte(hex_digest: Column, index: int) -> Column:
    """Byte ``index`` of a hex digest as an int in 0..255."""
    return F.conv(F.substring(hex_digest, 2 * index + 1, 2), 16, 10).cast("int")


def choose(options: Sequence[str], number: Column) -> Column:
    """Option at ``number`` modulo the number of options; NULL for a NULL number.

    ``get`` rather than ``element_at``: under ANSI mode the latter treats a NULL index as never NULL.
    """
    return F.get(F.array(*[F.lit(o) for o in options]), (number % len(options)).cast("int"))


def row_digest(columns: Sequence[Column]) -> tuple[Column, Column]:
    """Both halves of a row's md5 as numbers; every cell carries its length, so no cell can imitate another row."""
    cells = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    digest = F.md5(F.concat_ws(",", *cells))
    return tuple(F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)") for at in (1, 17))
