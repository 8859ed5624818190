"""Turn selection under a budget: which turns of a dialogue a compressed context keeps.

A dialogue's turns are numbered from 0, so positional selectors need only the turn's number and
the dialogue's length; they shuffle counts, never texts. Ranked selectors order turns inside a
dialogue; a dialogue that holds very many rows is ranked over all tasks (`ranked`).

Defined results: re-delivered turns count once, by their latest delivery; null texts are kept as
turns and rendered empty; budgets are at least one turn; an empty table gives no rows.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.strings import normalize_value, user_speaker
from ..runtime import checkpointed, hot_join, hot_keys


def clean_turns(turns: DataFrame) -> DataFrame:
    """Each turn once with a uniform speaker: dialogue_id, turn_id, speaker, text, belief.

    Keyed by dialogue and turn, so that a long dialogue is spread over all tasks.
    """
    latest = turns.where("dialogue_id is not null and turn_id is not null").groupBy("dialogue_id", "turn_id").agg(F.max_by(F.struct("speaker", "text", "belief"), F.struct("loaded_at", "text")).alias("t"))
    return latest.select("dialogue_id", "turn_id", user_speaker("t.speaker", "turn_id").alias("speaker"), "t.text", "t.belief")


def with_length(turns: DataFrame) -> DataFrame:
    """Turns beside their dialogue's number of turns `n`."""
    lengths = turns.groupBy("dialogue_id").agg(F.count("*").alias("n"))
    return hot_join(turns, lengths, "dialogue_id", counts=lengths)


def budget(ratio: float) -> Column:
    """Turns to keep: the share of the length rounded half to even, at least one."""
    return F.greatest(F.lit(1), F.rint(F.col("n") * F.lit(float(ratio))).cast("int"))


def budget_floor(ratio: float) -> Column:
    return F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(float(ratio))).cast("int"))


def stride_indices(n: Column, k: Column) -> Column:
    """Evenly spaced places, rounded half to even; all places when the budget reaches the length."""
    spaced = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.least(n.cast("int") - 1, F.rint(i * (n / k)).cast("int")))
    return F.array_distinct(F.when(k >= n, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(spaced))


def hash_order(seed: int) -> Column:
    """Portable random order: SHA-256 of seed, dialogue and turn."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), "dialogue_id", F.col("turn_id").cast("string")), 256)


def positional(turns: DataFrame, ratio: float) -> DataFrame:
    """Turns kept by the positional selectors in one pass: method, dialogue_id, turn_id.

    `turns` are clean turns. All methods are conditions on one row, so a single scan and one
    shuffle of counts serve them all.
    """
    rows = with_length(turns.select("dialogue_id", "turn_id")).withColumn("k", budget(ratio))
    i, n, k = F.col("turn_id"), F.col("n"), F.col("k")
    keeps = {
        "full_context": F.lit(True),
        "recency": i >= n - k,
        "first_n": i < k,
        "uniform_stride": F.array_contains(stride_indices(n, k), i),
        "streamingllm": (i < F.least(k, F.lit(2))) | (i >= n - F.greatest(k - 2, F.lit(0))),
    }
    flags = F.filter(F.array(*[F.when(c, F.lit(m)) for m, c in keeps.items()]), lambda m: m.isNotNull())
    return rows.select(F.explode(flags).alias("method"), "dialogue_id", "turn_id")


def ranked(df: DataFrame, key: str, order: list[str], name: str = "rank", hot: list | None = None) -> DataFrame:
    """Number the rows of each key from 1 in the order of the columns `order` (all ascending).

    Ordinary keys use a window. Rows of hot keys are range-partitioned by their order instead,
    counted by partition, and numbered by the partition's offset plus a count inside it, so that
    no key is sorted in one task. Order columns must make rows distinct. `hot` saves looking for the
    hot keys where the caller has found them in a smaller plan.
    """
    window = Window.partitionBy(key).orderBy(*order)
    hot = hot_keys(df, key) if hot is None else hot
    if not hot:
        return df.withColumn(name, F.row_number().over(window))
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    cold = df.where(~is_hot).withColumn(name, F.row_number().over(window))
    spread = checkpointed(df.where(is_hot).repartitionByRange(key, *order).sortWithinPartitions(key, *order)).withColumn("_pid", F.spark_partition_id())
    inside = spread.withColumn(name, F.row_number().over(Window.partitionBy("_pid", key).orderBy(*order)))
    counts = spread.groupBy("_pid", key).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", key, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    warm = inside.join(offsets, ["_pid", key]).withColumn(name, (F.col(name) + F.col("_before")).cast("int")).drop("_pid", "_before")
    return cold.unionByName(warm.select(*cold.columns))


def lagged(df: DataFrame, key: str, order: list[str], column: str, name: str) -> DataFrame:
    """Each row with `column` of the row before it inside its key; null for the first.

    Ordinary keys use a window; hot keys are numbered over all tasks and joined with their own
    rows shifted by one.
    """
    plain = F.lag(column).over(Window.partitionBy(key).orderBy(*order))
    hot = hot_keys(df, key)
    if not hot:
        return df.withColumn(name, plain)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    numbered = checkpointed(ranked(df.where(is_hot), key, order, "_no", hot))
    before = numbered.select(key, (F.col("_no") + 1).alias("_no"), F.col(column).alias(name))
    warm = numbered.join(before, [key, "_no"], "left").drop("_no")
    cold = df.where(~is_hot).withColumn(name, plain)
    return cold.unionByName(warm.select(*cold.columns))


def top_by(turns: DataFrame, order: list[Column], ratio: float, floor: bool = False) -> DataFrame:
    """The best `k` turns of each dialogue by the given order, ties to the earlier turn."""
    keys = [f"_o{j}" for j in range(len(order))]
    rows = with_length(turns).withColumn("k", budget_floor(ratio) if floor else budget(ratio)).withColumns(dict(zip(keys, order)))
    return ranked(rows, "dialogue_id", [*keys, "turn_id"], hot=hot_keys(turns, "dialogue_id")).where("rank <= k").select("dialogue_id", "turn_id")


def hash_random(turns: DataFrame, ratio: float, seed: int) -> DataFrame:
    return top_by(turns.select("dialogue_id", "turn_id"), [hash_order(seed)], ratio)


def top_score(turns: DataFrame, score: Column, ratio: float, floor: bool = False) -> DataFrame:
    """Highest scores first, ties keep the earlier turn."""
    return top_by(turns.select("dialogue_id", "turn_id", score.alias("score")), [-F.col("score")], ratio, floor)


def first_user_recent(turns: DataFrame, ratio: float) -> DataFrame:
    """The first user turn and the latest others."""
    first = turns.where("speaker = 'USER'").groupBy("dialogue_id").agg(F.min("turn_id").alias("first_user"))
    rows = hot_join(turns.select("dialogue_id", "turn_id"), first, "dialogue_id")
    return top_by(rows, [F.when(F.col("turn_id") == F.col("first_user"), 0).otherwise(1), -F.col("turn_id")], ratio)


def chunk_retention(turns: DataFrame, score: Column, length: int, dropped: float) -> DataFrame:
    """Whole chunks of turns with the best mean score; a short chunk at the end counts as one."""
    chunked = turns.select("dialogue_id", "turn_id", F.floor(F.col("turn_id") / length).cast("int").alias("chunk"), score.alias("score"))
    means = chunked.groupBy("dialogue_id", "chunk").agg(F.avg("score").alias("mean"))
    sized = hot_join(means, means.groupBy("dialogue_id").agg(F.count("*").alias("chunks")), "dialogue_id")
    keep = F.greatest(F.lit(1), F.floor(F.col("chunks") * F.lit(1.0 - dropped)).cast("int"))
    best = ranked(sized.withColumn("_m", -F.round("mean", 9)), "dialogue_id", ["_m", "chunk"]).where(F.col("rank") <= keep).select("dialogue_id", "chunk")
    return chunked.join(best, ["dialogue_id", "chunk"], "left_semi").select("dialogue_id", "turn_id", "chunk")


def render(turns: DataFrame, kept: DataFrame, joiner: str = "\n") -> DataFrame:
    """Contexts from kept turns: `[T<i>] SPEAKER: text` in turn order; a missing text is empty."""
    block = F.concat(F.lit("[T"), F.col("turn_id").cast("string"), F.lit("] "), "speaker", F.lit(": "), F.coalesce("text", F.lit("")))
    rows = turns.join(kept, ["dialogue_id", "turn_id"]).select(*[c for c in kept.columns if c != "turn_id"], "turn_id", block.alias("block"))
    keys = [c for c in kept.columns if c != "turn_id"]
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn_id", "block"))), lambda x: x["block"])
    return rows.groupBy(*keys).agg(F.count("*").alias("n_kept"), F.array_join(parts, joiner).alias("context"))


def parse_blocks(contexts: DataFrame, text: str) -> DataFrame:
    """Turns of rendered contexts: split before each tag, number, role and text of every block."""
    blocks = F.filter(F.split(F.col(text), r"\n(?=\[T\d+\] (?:USER|SYSTEM): )"), lambda b: F.regexp_like(b, F.lit(r"^\[T\d+\] (?:USER|SYSTEM): ")))
    return contexts.withColumn("block", F.explode(blocks)).select(
        *contexts.columns, F.regexp_extract("block", r"^\[T(\d+)\]", 1).cast("int").alias("turn_id"), F.regexp_extract("block", r"^\[T\d+\] (USER|SYSTEM)", 1).alias("role"), F.regexp_replace("block", r"^\[T\d+\] (?:USER|SYSTEM): ", "").alias("said")
    )


def delete_turns(turns: DataFrame, gone: DataFrame) -> DataFrame:
    """All turns but the named ones."""
    return turns.join(gone, ["dialogue_id", "turn_id"], "left_anti")


def matched_control(turns: DataFrame, labels: DataFrame) -> DataFrame:
    """For the turn of each final update the most similar other turn that mentions neither value.

    Same speaker, least difference in words, then in place, then lowest number: dialogue_id,
    target, control. One candidate join on the dialogue and one `min` over the triple, which
    combines before the shuffle.
    """
    words = F.size(F.split(F.trim(F.coalesce("text", F.lit(""))), " +"))
    rows = turns.select("dialogue_id", "turn_id", "speaker", words.alias("words"), normalize_value("text").alias("norm"))
    wanted = labels.groupBy("dialogue_id").agg(F.min_by(F.struct("final_slot_update_turn_id", "old_value", "new_value"), F.struct("slot", "final_slot_update_turn_id")).alias("l"))
    wanted = wanted.select("dialogue_id", F.col("l.final_slot_update_turn_id").alias("target"), normalize_value("l.old_value").alias("old_norm"), normalize_value("l.new_value").alias("new_norm"))
    target = rows.select("dialogue_id", F.col("turn_id").alias("target"), F.col("speaker").alias("target_speaker"), F.col("words").alias("target_words"))
    wanted = wanted.join(target, ["dialogue_id", "target"])
    pairs = hot_join(rows, wanted, "dialogue_id").where("target is not null and turn_id <> target and speaker = target_speaker")
    clean = pairs.where(~(F.col("norm").contains(F.col("old_norm")) & (F.col("old_norm") != "")) & ~(F.col("norm").contains(F.col("new_norm")) & (F.col("new_norm") != "")))
    nearness = F.struct(F.abs(F.col("words") - F.col("target_words")).alias("dw"), F.abs(F.col("turn_id") - F.col("target")).alias("dp"), F.col("turn_id").alias("id"))
    return clean.groupBy("dialogue_id", "target").agg(F.min(nearness)["id"].alias("control"))


def transitions(turns: DataFrame) -> DataFrame:
    """Changes of slot values: dialogue_id, slot, turn_id, old_value, new_value.

    Blank values neither change a slot nor reset it; the first value is no change.
    """
    values = turns.where("belief is not null").select("dialogue_id", "turn_id", F.explode("belief").alias("slot", "value")).where(F.trim(F.coalesce("value", F.lit(""))) != "")
    keyed = values.withColumn("_key", F.concat_ws("\u0001", "dialogue_id", "slot"))
    changed = lagged(keyed, "_key", ["turn_id"], "value", "old_value").where("old_value is not null and old_value <> value")
    return changed.select("dialogue_id", "slot", "turn_id", "old_value", F.col("value").alias("new_value"))


def latest_transitions(changes: DataFrame) -> DataFrame:
    """The last change of each dialogue, ties to the first slot by name; combines before the shuffle."""
    picked = changes.groupBy("dialogue_id", "turn_id").agg(F.min_by(F.struct("slot", "old_value", "new_value"), "slot").alias("s"))
    top = picked.groupBy("dialogue_id").agg(F.max_by(F.struct("s", "turn_id"), "turn_id").alias("t"))
    return top.select("dialogue_id", "t.s.slot", "t.turn_id", "t.s.old_value", "t.s.new_value")


def pooled_scores(turns: DataFrame, score: Column, reach: int = 2) -> DataFrame:
    """Scores averaged over the turns around each, missing neighbours as zero: dialogue_id, turn_id,
    pooled. Every score is sent to its neighbours' keys, so no dialogue is gathered."""
    rows = turns.select("dialogue_id", "turn_id", score.cast("double").alias("s"))
    sent = rows.select("dialogue_id", F.explode(F.sequence(F.col("turn_id") - reach, F.col("turn_id") + reach)).alias("turn_id"), "s", F.lit(0).alias("own"))
    own = rows.select("dialogue_id", "turn_id", F.lit(0.0).alias("s"), F.lit(1).alias("own"))
    agg = sent.unionByName(own).groupBy("dialogue_id", "turn_id").agg(F.sum("s").alias("s"), F.max("own").alias("own"))
    return agg.where("own = 1").select("dialogue_id", "turn_id", F.round(F.col("s") / (2 * reach + 1), 6).alias("pooled"))


def scaled_scores(turns: DataFrame, score: Column) -> DataFrame:
    """Scores scaled to 0..1 inside a dialogue; equal scores become one share each."""
    rows = turns.select("dialogue_id", "turn_id", score.cast("double").alias("s"))
    bounds = rows.groupBy("dialogue_id").agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.count("*").alias("n"))
    flat = F.col("hi") == F.col("lo")
    return hot_join(rows, bounds, "dialogue_id").select("dialogue_id", "turn_id", F.round(F.when(flat, 1.0 / F.col("n")).otherwise((F.col("s") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))), 6).alias("scaled"))


def matched_controls(turns: DataFrame, targets: DataFrame, values: DataFrame, rounds: int) -> DataFrame:
    """Controls for several targets of a dialogue, in order and without replacement.

    `targets`: dialogue_id, place (from 0), target; `values`: dialogue_id, old_value, new_value, one
    row a dialogue. Each round joins its targets with the turns still free and takes the nearest.
    Targets are never controls. dialogue_id, place, target, control.
    """
    words = F.size(F.split(F.trim(F.coalesce("text", F.lit(""))), " +"))
    rows = turns.select("dialogue_id", "turn_id", "speaker", words.alias("words"), normalize_value("text").alias("norm"))
    said = values.select("dialogue_id", normalize_value("old_value").alias("o"), normalize_value("new_value").alias("v"))
    mentions = ((F.col("o") != "") & F.col("norm").contains(F.col("o"))) | ((F.col("v") != "") & F.col("norm").contains(F.col("v")))
    usable = hot_join(rows, said, "dialogue_id").where(~F.coalesce(mentions, F.lit(False))).drop("norm", "o", "v")
    taken = targets.select("dialogue_id", F.col("target").alias("turn_id"))
    out = None
    for place in range(rounds):
        own = targets.where(F.col("place") == place).join(rows.select("dialogue_id", F.col("turn_id").alias("target"), F.col("speaker").alias("ts"), F.col("words").alias("tw")), ["dialogue_id", "target"])
        free = usable.join(taken, ["dialogue_id", "turn_id"], "left_anti")
        pairs = hot_join(free, own, "dialogue_id").where("target is not null and speaker = ts")
        nearest = F.min(F.struct(F.abs(F.col("words") - F.col("tw")).alias("a"), F.abs(F.col("turn_id") - F.col("target")).alias("b"), F.col("turn_id").alias("id")))
        found = checkpointed(pairs.groupBy("dialogue_id", "place", "target").agg(nearest["id"].alias("control")))
        taken = taken.unionByName(found.select("dialogue_id", F.col("control").alias("turn_id")))
        out = found if out is None else out.unionByName(found)
    return out


# --- selectors that no set expression states ----------------------------------------------------


def sample_exact(n: int, k: int, seed: int, dialogue_id: str) -> list[int]:
    """Indices of the standard library's generator, seeded by the hash of seed and dialogue."""
    import hashlib

    digest = hashlib.sha256(f"{seed}|{dialogue_id}".encode()).digest()
    return sorted(random.Random(int.from_bytes(digest[:8], "big") & 0xFFFFFFFF).sample(range(n), min(k, n)))


def random_fixed(turns: DataFrame, ratio: float, seed: int) -> DataFrame:
    """The generator reseeded for each dialogue by the run's seed alone: dialogues of one length and
    budget keep the same places. Each (length, budget) is drawn once."""
    lengths = turns.groupBy("dialogue_id").agg(F.count("*").alias("n")).withColumn("k", budget_floor(ratio))

    @F.pandas_udf("array<int>")
    def pick(n: pd.Series, k: pd.Series) -> pd.Series:
        known = {(a, b): sorted(random.Random(seed).sample(range(a), b)) for a, b in set(zip(n.astype(int), k.astype(int)))}
        return pd.Series([known[a, b] for a, b in zip(n.astype(int), k.astype(int))])

    return lengths.select("dialogue_id", F.explode(pick("n", "k")).alias("turn_id"))


def random_exact(turns: DataFrame, ratio: float, seed: int) -> DataFrame:
    """Kept indices by the exact generator: dialogue_id, turn_id. One row a dialogue reaches Python."""
    lengths = turns.groupBy("dialogue_id").agg(F.count("*").alias("n")).withColumn("k", budget(ratio))

    @F.pandas_udf("array<int>")
    def pick(n: pd.Series, k: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([sample_exact(int(a), int(b), seed, c) for a, b, c in zip(n, k, d)])

    return lengths.select("dialogue_id", F.explode(pick("n", "k", "dialogue_id")).alias("turn_id"))


def mmr_order(vectors: np.ndarray, k: int, weight: float = 0.5) -> list[int]:
    """Greedy relevance against redundancy: cosine to the mean vector less cosine to what is kept."""
    v = np.asarray(vectors, dtype=np.float64)
    norms = np.linalg.norm(v, axis=1)
    query = v.mean(axis=0)
    relevance = v @ query / (norms * np.linalg.norm(query) + 1e-9)
    worst = np.full(len(v), -np.inf)
    free = np.ones(len(v), dtype=bool)
    kept: list[int] = []
    for _ in range(min(k, len(v))):
        penalty = np.where(np.isneginf(worst), 0.0, worst)
        score = np.where(free, weight * relevance - (1 - weight) * penalty, -np.inf)
        best = int(np.argmax(score))
        kept.append(best)
        free[best] = False
        worst = np.maximum(worst, v @ v[best] / (norms * norms[best] + 1e-9))
    return sorted(kept)


def mmr(vectors: DataFrame, group: str, item: str, vector: str, ratio: float, one_task: int = 32_768, candidates: int = 4096) -> DataFrame:
    """Items kept by greedy relevance and diversity: group, item.

    Exact for every size, with one mean and one budget a group. A group of at most `one_task` items
    is one task's work; larger groups stay spread out, see `_mmr_spread`. Items are unique in a group.
    """
    sizes = vectors.groupBy(group).agg(F.count("*").alias("n"))
    large = [(r[0], r["n"]) for r in sizes.where(F.col("n") > one_task).orderBy(group).collect()]

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(item)
        k = max(1, int(len(rows) * ratio))
        return rows.iloc[mmr_order(np.stack(rows[vector].to_numpy()), k)][[group, item]]

    kinds = dict(vectors.dtypes)
    own = lambda g: F.col(group).eqNullSafe(F.lit(g))
    rest = vectors.select(group, item, vector)
    for g, _ in large:
        rest = rest.where(~own(g))
    out = rest.groupBy(group).applyInPandas(pick, f"{group} {kinds[group]}, {item} {kinds[item]}")
    for g, n in large:
        out = out.unionByName(_mmr_spread(vectors.where(own(g)).select(group, item, vector), group, item, vector, max(1, int(n * ratio)), candidates))
    return out


def _mmr_spread(rows: DataFrame, group: str, item: str, vector: str, k: int, candidates: int) -> DataFrame:
    """The greedy choice over one group's partitions: each round every partition gives its leaders
    and the first item behind them. A score only falls once something is kept, so a leader ahead of
    all items behind is the greedy choice; the round ends where that is no longer certain, and what
    it kept is brought to all partitions. At most `candidates` leaders reach the driver (one a
    partition at least), and a round keeps at least one item.
    """
    weight = 0.5
    kinds = dict(rows.dtypes)
    means = rows.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m")).orderBy("i").collect()
    query = np.array([r["m"] for r in means])
    length = np.linalg.norm(query)

    def dots(v: np.ndarray, to: np.ndarray) -> np.ndarray:
        return np.einsum("ij,j->i", v, to)

    def stacked(part: pd.DataFrame) -> np.ndarray:
        return np.stack(part[vector].to_numpy()).astype(np.float64)

    def begin(parts):
        for part in parts:
            if len(part):
                v = stacked(part)
                yield part.assign(_rel=dots(v, query) / (np.linalg.norm(v, axis=1) * length + 1e-9), _worst=0.0, _kept=False)

    def keeping(kept: list, ids: set, first: bool):
        def run(parts):
            for part in parts:
                if len(part):
                    v, worst = stacked(part), part["_worst"].to_numpy()
                    norms = np.linalg.norm(v, axis=1)
                    for at, to in enumerate(kept):
                        near = dots(v, to) / (norms * np.linalg.norm(to) + 1e-9)
                        worst = near if first and not at else np.maximum(worst, near)
                    yield part.assign(_worst=worst, _kept=part["_kept"] | part[item].isin(ids))

        return run

    def leaders(count: int):
        def run(parts):
            best = None
            for part in parts:
                part = part[~part["_kept"]]
                part = part.assign(_score=weight * part["_rel"] - (1 - weight) * part["_worst"])
                best = part if best is None else pd.concat([best, part])
                best = best.sort_values(["_score", item], ascending=[False, True]).head(count + 1)
            if best is not None and len(best):
                yield best.assign(_behind=np.arange(len(best)) == count)[[item, vector, "_rel", "_worst", "_score", "_behind"]]

        return run

    shape = f"{group} {kinds[group]}, {item} {kinds[item]}, {vector} {kinds[vector]}, _rel double, _worst double, _kept boolean"
    shown = f"{item} {kinds[item]}, {vector} {kinds[vector]}, _rel double, _worst double, _score double, _behind boolean"
    cores = rows.sparkSession.sparkContext.defaultParallelism
    state = checkpointed(rows.repartition(cores, item).mapInPandas(begin, shape))
    each = max(1, candidates // state.rdd.getNumPartitions())
    done = 0
    while done < k:
        top = state.mapInPandas(leaders(each), shown).toPandas().sort_values(item).reset_index(drop=True)
        behind = min(((-s, i) for s, i in top.loc[top["_behind"], ["_score", item]].itertuples(index=False)), default=None)
        top = top[~top["_behind"]]
        ids, v, worst = top[item].tolist(), stacked(top), top["_worst"].to_numpy().copy()
        norms, rel, free = np.linalg.norm(v, axis=1), top["_rel"].to_numpy(), np.ones(len(top), dtype=bool)
        taken: list[int] = []
        while done + len(taken) < k and free.any():
            score = np.where(free, weight * rel - (1 - weight) * worst, -np.inf)
            at = int(np.argmax(score))
            if behind is not None and (-score[at], ids[at]) > behind:
                break
            taken.append(at)
            free[at] = False
            if not done:  # with nothing kept there is no penalty; from then on scores only fall
                break
            worst = np.maximum(worst, dots(v, v[at]) / (norms * norms[at] + 1e-9))
        state = checkpointed(state.mapInPandas(keeping([v[i] for i in taken], {ids[i] for i in taken}, not done), shape))
        done += len(taken)
    return state.where("_kept").select(group, item)
