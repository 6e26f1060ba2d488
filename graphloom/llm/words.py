"""Words as 64-bit numbers, on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_numbers(text: Column | str) -> Column:
    """Hashes of the runs of letters or digits in lower case, in order; null text gives none."""
    low = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    return F.transform(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0)), lambda w: F.xxhash64(w))
