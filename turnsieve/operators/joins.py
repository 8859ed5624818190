"""Join policies: resume, deduplicated requests, strict pairing, merges, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import hot_join


def unseen(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key the sink does not hold yet; the sink is reduced to its keys before it moves."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def keep_listed(rows: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(listed.select(*keys).distinct(), keys, "left_semi")


def fingerprints(rows: DataFrame, parts: list[str], name: str = "fingerprint") -> DataFrame:
    """Rows with the SHA-256 of the JSON of their parts: equal work has an equal fingerprint."""
    return rows.withColumn(name, F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256))


def reusable(cache: DataFrame, key: str, answer: str) -> DataFrame:
    """Cached answers that do not conflict: key, answer, n_cached."""
    agg = cache.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(answer).alias(answer), F.max(answer).alias("_max"), F.count("*").alias("n_cached"))
    return agg.where(F.col(answer).isNotNull() & (F.col(answer) == F.col("_max"))).drop("_max")


def expand(rows: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Every row with the one answer of its key; missing answers stay null."""
    return hot_join(rows, answers, key)


def merge_replace(base: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Base rows whose key stands in `new` take its columns, others keep theirs. `new` has unique keys."""
    patch = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = base.join(patch, keys, "left")
    return joined.withColumns({c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}).withColumn("replaced", F.coalesce("_hit", F.lit(False))).drop("_hit", *[f"_new_{c}" for c in columns])


def strict_violations(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that break a one-to-one join: kind (`duplicate_left`, `duplicate_right`, `missing`,
    `unknown`), n_keys. One full join of counts, whatever the number of repeats."""
    a, b = left.groupBy(key).agg(F.count("*").alias("nl")), right.groupBy(key).agg(F.count("*").alias("nr"))
    both = a.join(b, key, "full_outer")
    kinds = F.array(
        F.when(F.col("nl") > 1, "duplicate_left"), F.when(F.col("nr") > 1, "duplicate_right"), F.when(F.col("nl").isNull(), "unknown"), F.when(F.col("nr").isNull(), "missing")
    )
    return both.select(F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind")).groupBy("kind").agg(F.count("*").alias("n_keys"))


def coverage(needed: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Distinct needed keys split into cached and missing: state, n_keys."""
    distinct = needed.select(key).distinct()
    flagged = distinct.join(cached.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    return flagged.groupBy(F.when(F.col("_hit"), "cached").otherwise("missing").alias("state")).agg(F.count("*").alias("n_keys"))


def complete_items(rows: DataFrame, item: str, condition: str, wanted: list[str]) -> DataFrame:
    """Items that have exactly the wanted conditions."""
    have = rows.groupBy(item).agg(F.array_sort(F.collect_set(condition)).alias("have"))
    return have.where(F.col("have") == F.array(*[F.lit(w) for w in sorted(wanted)])).select(item)
