"""Ranks, resampling and tests over scored cells.

Resampling works on cluster sums, never on rows: clusters are added up first, each cluster draws its
weights for all replicates from hashes of its name, and every task adds up its clusters, so that only tasks
x groups x replicates partial sums are shuffled. Weights are Poisson draws, which is the form of redrawing
clusters that needs no knowledge of the others; results do not depend on how the data are partitioned.
Exact small-sample versions are beside them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cumulative probabilities of a Poisson variable with mean 1 (fixed values).
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975, 0.99999887, 0.99999989, 0.99999999)
#: Discordant counts up to which binomial coefficients and their products stay whole numbers in a double.
EXACT_N = 46
#: Standard normal quantile of the intervals (fixed value).
Z = 1.96


def mid_rank(value: Column, partition: list[str]) -> Column:
    """Rank from the highest value, ties share their mean rank."""
    best = Window.partitionBy(*partition).orderBy(value.desc())
    return F.rank().over(best) + (F.count("*").over(Window.partitionBy(*partition, value)) - 1) / 2


def _intervals(per: DataFrame, by: list[str]) -> DataFrame:
    own, drew = F.col("rep") < 0, F.when(F.col("rep") >= 0, F.col("stat"))
    rounded = lambda c: F.round(c, 6) + F.lit(0.0)
    return per.groupBy(*by).agg(
        rounded(F.max(F.when(own, F.col("stat")))).alias("mean"), F.max(F.when(own, F.col("n"))).alias("n_clusters"), rounded(F.percentile(drew, F.lit(0.025))).alias("lower"), rounded(F.percentile(drew, F.lit(0.975))).alias("upper")
    )


#: Draws that one hash gives: words of 32 bits in a SHA-256 digest.
DRAWS = 8


def cluster_weights(cluster: str, replicates: int) -> np.ndarray:
    """Poisson weights of a cluster in all replicates. The hash of block and cluster gives DRAWS of them."""
    blocks = b"".join(hashlib.sha256(f"{b}|{cluster}".encode()).digest() for b in range(-(-replicates // DRAWS)))
    u = np.frombuffer(blocks, dtype=">u4")[:replicates].astype(np.float64) / 4294967296.0
    return np.searchsorted(np.array(POISSON), u, side="right").astype(np.float64)


def bootstrap_ratio(sums: DataFrame, by: list[str], cluster: str, total: str, count: str, replicates: int) -> DataFrame:
    """Mean and percentile interval of sum/count with clusters redrawn: by, mean, n_clusters, lower, upper.
    A cluster draws its weights once, for all groups. A replicate that draws no cluster of a group has
    no value. A null cluster is one cluster."""
    kinds = dict(sums.dtypes)

    def run(batches):
        made: dict[tuple, list] = {}
        for rows in batches:
            rows = rows.assign(_c=rows[cluster].fillna("").astype(str))
            names = rows["_c"].unique()
            for at in range(0, len(names), 128):
                block = names[at : at + 128]
                place = {c: i for i, c in enumerate(block)}
                weights = np.stack([cluster_weights(c, replicates) for c in block], axis=1)
                for group, own in rows[rows["_c"].isin(place)].groupby(by, dropna=False):
                    values = own[[total, count]].to_numpy(dtype=np.float64)
                    each = np.zeros((len(block), 2))
                    np.add.at(each, own["_c"].map(place).to_numpy(), values)
                    plain, n, drawn = made.setdefault(group, [np.zeros(2), 0, np.zeros((replicates, 2))])
                    made[group] = [plain + values.sum(axis=0), n + len(own), drawn + weights @ each]
        for group, (plain, n, drawn) in made.items():
            out = pd.DataFrame(np.vstack([plain, drawn]), columns=["s", "c"])
            out.insert(0, "rep", np.arange(-1, replicates))
            out["n"] = n
            for i, name in enumerate(by):
                out.insert(i, name, group[i])
            yield out

    cores = sums.sparkSession.sparkContext.defaultParallelism
    placed = sums.select(*by, cluster, total, count).repartition(cores, cluster).sortWithinPartitions(cluster)
    parts = placed.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", rep int, s double, c double, n bigint")
    return _intervals(parts.groupBy(*by, "rep").agg(F.try_divide(F.sum("s"), F.sum("c")).alias("stat"), F.sum("n").alias("n")), by)


def tall(rows: DataFrame, keys: list[str], metrics: list[str], weight: Column | None = None) -> DataFrame:
    """Metrics under each other: keys, metric, v (and w, the row's weight); null metrics give no row."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])
    out = rows.select(*keys, *([weight.alias("w")] if weight is not None else []), F.inline(each))
    return out.where("v is not null")


def seed_balanced(rows: DataFrame, by: list[str], seed: str, cluster: str, metrics: list[str], replicates: int) -> DataFrame:
    """Means in which every seed of a group weighs the same, with cluster intervals: by, metric, mean,
    n_clusters, lower, upper. A row weighs one by the number of rows of its seed in the group."""
    each = tall(rows, [*by, seed, cluster], metrics)
    cells = each.groupBy(*by, "metric", seed, cluster).agg(F.sum("v").alias("v"), F.count("*").alias("n"))
    sizes = cells.groupBy(*by, "metric", seed).agg(F.sum("n").alias("of_seed"))
    weighted = cells.join(sizes, [*by, "metric", seed])
    sums = weighted.groupBy(*by, "metric", cluster).agg(F.round(F.sum(F.col("v") / F.col("of_seed")), 12).alias("total"), F.round(F.sum(F.col("n") / F.col("of_seed")), 12).alias("n"))
    return bootstrap_ratio(sums, [*by, "metric"], cluster, "total", "n", replicates)


def judged_clusters(rows: DataFrame, by: list[str], cluster: str, label: str, judges: list[str]) -> DataFrame:
    """Sums that accuracies and balanced accuracies of judges are ratios of, by cluster and judge: n, pos,
    neg, right, tp, tn. Rows without a label are left out; an undecided judge is never right."""
    each = F.array(*[F.struct(F.lit(j).alias("judge"), F.col(j).alias("p")) for j in judges])
    y, p = F.col(label), F.coalesce("p", ~F.col(label))
    told = rows.where(y.isNotNull()).select(*by, cluster, label, F.inline(each))
    return told.groupBy(*by, "judge", cluster).agg(F.count("*").alias("n"), F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"), F.count_if(p == y).alias("right"), F.count_if(y & p).alias("tp"), F.count_if(~y & ~p).alias("tn"))


def cluster_bootstrap(sums: DataFrame, by: list[str], cluster: str, columns: list[str], stats: dict[str, Column], replicates: int) -> DataFrame:
    """Statistics of several cluster sums over replicates, with percentile intervals: by, statistic, value,
    lower, upper. `stats` are expressions over the summed columns; a null statistic is left out of the interval."""
    kinds = dict(sums.dtypes)

    def run(batches):
        made: dict[tuple, np.ndarray] = {}
        for rows in batches:
            for key, own in rows.fillna({cluster: ""}).groupby([*by, cluster], dropna=False):
                weights = np.concatenate([[1.0], cluster_weights(str(key[-1]), replicates)])
                add = np.outer(weights, own[columns].to_numpy(dtype=np.float64).sum(axis=0))
                made[key[:-1]] = made[key[:-1]] + add if key[:-1] in made else add
        for group, total in made.items():
            out = pd.DataFrame(total, columns=columns)
            out.insert(0, "rep", np.arange(-1, replicates))
            for i, name in enumerate(by):
                out.insert(i, name, group[i])
            yield out

    cores = sums.sparkSession.sparkContext.defaultParallelism
    placed = sums.select(*by, cluster, *columns).repartition(cores, cluster).sortWithinPartitions(cluster)
    parts = placed.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", rep int, " + ", ".join(f"{c} double" for c in columns))
    per = parts.groupBy(*by, "rep").agg(*[F.sum(c).alias(c) for c in columns])
    each = per.select(*by, "rep", F.inline(F.array(*[F.struct(F.lit(n).alias("statistic"), x.cast("double").alias("v")) for n, x in stats.items()])))
    drew = F.when(F.col("rep") >= 0, F.col("v"))
    return each.groupBy(*by, "statistic").agg(F.round(F.max(F.when(F.col("rep") < 0, F.col("v"))), 6).alias("value"), F.round(F.percentile(drew, F.lit(0.025)), 6).alias("lower"), F.round(F.percentile(drew, F.lit(0.975)), 6).alias("upper"))


def consolidated_seeds(rows: DataFrame) -> DataFrame:
    """From dataset, dialogue_id, seed, acc (one row each): mean of the dialogue means over the
    dialogues that all seeds of the dataset share, null where there is none, beside mean and
    deviation of the seed means over all dialogues of each seed (deviation 0 for one seed)."""
    seeds = rows.groupBy("dataset", "seed").agg(F.avg("acc").alias("m")).groupBy("dataset").agg(F.count("*").alias("n_seeds"), F.round(F.avg("m"), 6).alias("seed_mean"), F.round(F.coalesce(F.stddev_samp("m"), F.lit(0.0)), 6).alias("seed_sd"))
    each = rows.groupBy("dataset", "dialogue_id").agg(F.count("*").alias("have"), F.avg("acc").alias("mean")).join(F.broadcast(seeds), "dataset")
    shared = F.col("have") == F.col("n_seeds")
    return each.groupBy("dataset", "n_seeds", "seed_mean", "seed_sd").agg(F.count_if(shared).alias("n_dialogues"), F.round(F.avg(F.when(shared, F.col("mean"))), 6).alias("mean"))


def wilson(successes: Column, n: Column) -> tuple[Column, Column]:
    """Score interval of a share; null for n = 0."""
    p = successes / n
    centre, spread = p + Z * Z / (2 * n), Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))
    scale = 1 + Z * Z / n
    return (centre - spread) / scale, (centre + spread) / scale


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided test of discordant counts.

    Up to EXACT_N counts the binomial terms are integers below 2^53 and the only rounding is one
    division; beyond, terms are taken in log space from the recurrence C(n, i + 1) = C(n, i) (n - i) / (i + 1).
    """
    n, k = (b + c).cast("double"), F.least(b, c).cast("int")
    start = lambda first: F.struct(F.lit(0.0).alias("sum"), first.alias("term"))
    steps = F.sequence(F.lit(0), k)
    whole = F.aggregate(steps, start(F.lit(1.0)), lambda acc, i: F.struct((acc["sum"] + acc["term"]).alias("sum"), F.round(acc["term"] * (n - i) / (i + 1)).alias("term")), lambda acc: acc["sum"] / F.pow(F.lit(2.0), n))
    logs = F.aggregate(steps, start(n * F.lit(float(np.log(0.5)))), lambda acc, i: F.struct((acc["sum"] + F.exp(acc["term"])).alias("sum"), (acc["term"] + F.log(F.greatest(n - i, F.lit(1.0))) - F.log(i + 1)).alias("term")), lambda acc: acc["sum"])
    return F.least(F.lit(1.0), 2 * F.when(n <= EXACT_N, whole).otherwise(logs))


def mcnemar_exact(b: int, c: int) -> float:
    from math import comb

    n = b + c
    return min(1.0, 2 * sum(comb(n, i) for i in range(min(b, c) + 1)) / 2**n) if n else 1.0


def bootstrap_exact(sums: np.ndarray, counts: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Ratio of redrawn cluster sums by numpy's generator, for one cell whose clusters fit in memory."""
    rng = np.random.default_rng(seed)
    out = np.empty(replicates)
    for at in range(0, replicates, 256):
        draws = rng.integers(0, len(sums), size=(min(256, replicates - at), len(sums)))
        out[at : at + len(draws)] = sums[draws].sum(axis=1) / counts[draws].sum(axis=1)
    return out
