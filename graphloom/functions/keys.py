"""Normal form of record keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every character that Unicode calls white space.
SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def key(c: Column | str) -> Column:
    """The key without outer white space, in lower case; null when nothing is left."""
    bare = F.lower(F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(SPACE)))
    return F.when(bare != "", bare)


def prefix_of(c: Column | str) -> Column:
    """What stands before the first underscore; the whole string without one; '' for null."""
    return F.substring_index(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), "_", 1)


def is_deleted(status: Column | str) -> Column:
    """Whether a status says deleted, case and outer white space aside; never null."""
    return F.coalesce(key(status) == "deleted", F.lit(False))
