"""Columns that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftframe.sources.store import cut, forget, shared_folder, stored  # noqa: F401

#: Runs of the characters that separate words.
SPLIT = r"[\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text as long; 0 for null. Splitting a text that starts or
    ends with a separator gives an empty part there, which is taken off."""
    parts = F.split(text, SPLIT)
    edges = F.when(F.substring(text, 1, 1).rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0) + F.when(text.rlike(r"[\x20\x09-\x0D]\z"), 1).otherwise(0)
    blank = F.regexp_replace(text, SPLIT, "") == ""
    return F.when(text.isNull() | blank, F.lit(0)).otherwise(F.size(parts) - edges).cast("long")
