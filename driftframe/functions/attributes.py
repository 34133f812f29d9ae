"""Attributes of columns: descriptions, cell methods, and flags with their values and meanings."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftframe.functions import stats


def described(df: DataFrame, column: str, long_name: str | None = None, units: str | None = None, **more: str) -> DataFrame:
    """A column with its description as metadata."""
    given = {"long_name": long_name, "units": units, **more}
    return df.withMetadata(column, {**df.schema[column].metadata, **{k: v for k, v in given.items() if v is not None}})


def modified(df: DataFrame, column: str, modifier: str, cell: str | None = None) -> DataFrame:
    """The names in a column's metadata with a word put before them, and how the cells of ``cell`` were summed up."""
    new = {k: f"{modifier} {v}" if k in ("long_name", "standard_name") else v for k, v in df.schema[column].metadata.items()}
    if cell:
        new["cell_methods"] = f"area: {modifier} where {cell}"
    return df.withMetadata(column, new)


def flag_table(spark: SparkSession, values: str, meanings: str) -> DataFrame:
    """``value, meaning`` of a flag from its attributes: values like ``0b 1b 2b``, meanings like ``0:clear 1:water`` or
    ``clear water``."""
    v = [int(x) for x in re.findall(r"-?\d+", values)]
    m = [x.split(":", 1)[-1] for x in meanings.split()]
    return spark.createDataFrame(list(zip(v, m, strict=True)), "value int, meaning string")


def named_stats(df: DataFrame, dim: str, fields: list[str], weight: str) -> DataFrame:
    """``{dim}_{field}_{mean,std,min,max}`` for each ``dim`` and field, with the four error columns as well for fields
    that have ``{field}_uncertainty``."""
    out = df.select(dim).distinct()
    for f in fields:
        prefix = f"{dim}_{f}_"
        if f"{f}_uncertainty" in df.columns:
            one = stats.weighted_stats_and_uncertainties(df, [dim], f, f"{f}_uncertainty", weight, prefix)
        else:
            one = stats.weighted_stats(df, [dim], f, weight, prefix, unbiased=True)
        out = out.join(one, dim, "left")
    return out


def named_proportions(df: DataFrame, dim: str, flag: str, weight: str, flags: DataFrame) -> DataFrame:
    """``{dim}, meaning, {dim}_{flag}_proportion`` for every value of a flag, 0 where a label has none of it."""
    share = stats.weighted_proportions(df, [dim], flag, weight).withColumnRenamed(flag, "value")
    every = df.select(dim).distinct().join(F.broadcast(flags))  # a few values
    return every.join(share, [dim, "value"], "left").select(dim, "meaning", F.coalesce("proportion", F.lit(0.0)).alias(f"{dim}_{flag}_proportion"))
