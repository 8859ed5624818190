"""Data-quality checks as DataFrames of violations; `demand` raises when one is not empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand more than once: keys, n."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing_keys(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    return expected.select(key).distinct().join(actual.select(key).distinct(), key, "left_anti")


def out_of_range(rows: DataFrame, key: str, listed: Column, n: Column) -> DataFrame:
    """List entries that are no place of their sequence: key, entry."""
    return rows.select(key, F.explode(F.filter(listed, lambda x: x.isNotNull())).alias("entry"), n.alias("_n")).where("entry < 0 or entry >= _n").select(key, "entry")


def not_subset(rows: DataFrame, key: str, part: Column, whole: Column) -> DataFrame:
    """Rows whose list holds entries that the other list lacks: key, extra."""
    return rows.select(key, F.size(F.array_except(F.coalesce(part, F.array().cast("array<bigint>")), F.coalesce(whole, F.array().cast("array<bigint>")))).alias("extra")).where("extra > 0")


def broken(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """Rows that break named rules, in one pass: key, rule."""
    flags = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return rows.select(key, F.explode(flags).alias("rule"))


def demand(violations: DataFrame, what: str) -> None:
    """Raise with a few examples when there is any violation."""
    found = violations.take(5)
    if found:
        raise ValueError(f"{what}: {[r.asDict() for r in found]}")
