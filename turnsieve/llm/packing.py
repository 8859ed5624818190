"""Problem 7: items of varying length in containers of fixed capacity, by bin completion.

Sizes are whole token counts, so items of one size are interchangeable and the search runs on the
histogram of sizes, which has at most `capacity` entries however large the corpus is. Around the
largest item left, undominated fillings of the rest of its container are enumerated and pruned by
their waste; the best one is taken as often as the counts allow. Best-fit gives the incumbent that
the search has to beat. Documents then find their place by their rank within their size.

Defined results for hard input: a text longer than the capacity fills whole containers and its
rest is an item; null and empty texts have size 0 and lie in container 0, whatever it holds;
repeated texts are items of their own; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import checkpointed, map_rows
from .bpe import NAME, VOCABULARIES
from .tokens import sized

#: Nodes of the search for one filling before its sums are counted out, and fillings a node of the
#: branch and bound looks at.
NODES = 400
#: Items up to which a solution above the lower bound is searched further, and nodes of that search.
SEARCH_ITEMS, SEARCH_NODES = 200, 4000


def best_filling(room: int, sizes: list[int], left: dict[int, int], exact: bool = True) -> tuple[int, ...]:
    """The filling of `room` with least waste, larger items first among equals.

    Depth-first over sizes in descending order. A branch ends when its waste bound, the room less
    all that could still be added, cannot beat the incumbent; a filling without waste ends the
    search. Where NODES nodes do not settle it, the sums that fit are counted out instead, or, if not
    `exact`, the best so far is taken.
    """
    beyond = [0] * (len(sizes) + 1)
    for i in range(len(sizes) - 1, -1, -1):
        beyond[i] = beyond[i + 1] + sizes[i] * left[sizes[i]]
    best: tuple[int, tuple[int, ...]] = (room + 1, ())
    nodes = 0
    at = _first_at_most(sizes, room)
    stack: list[tuple[int, int, tuple[int, ...], int]] = [(at, room, (), 0)]
    while stack:
        if nodes >= NODES:
            return _exact_filling(room, sizes, left) if exact else best[1]
        i, free, chosen, used = stack.pop()
        nodes += 1
        if free < best[0]:
            best = (free, chosen)
            if not free:
                break
        while i < len(sizes) and (sizes[i] > free or left[sizes[i]] <= (used if chosen and chosen[-1] == sizes[i] else 0)):
            i = _first_at_most(sizes, free, i) if sizes[i] > free else i + 1
            used = 0
        if i >= len(sizes) or free - beyond[i] >= best[0]:
            continue
        size = sizes[i]
        have = used if chosen and chosen[-1] == size else 0
        stack.append((i + 1, free, chosen, 0))
        stack.append((i, free - size, (*chosen, size), have + 1))
    return best[1]


def _exact_filling(room: int, sizes: list[int], left: dict[int, int]) -> tuple[int, ...]:
    """As best_filling, by the sums that are reachable with the sizes from each one on (bits of an int)."""
    usable = [s for s in sizes if s <= room and left[s] > 0]
    mask = (1 << (room + 1)) - 1
    reach = [1] * (len(usable) + 1)
    for i in range(len(usable) - 1, -1, -1):
        s, r = usable[i], reach[i + 1]
        k, step = min(left[s], room // s), 1
        while k:
            t = min(step, k)
            r |= (r << (s * t)) & mask
            k -= t
            step *= 2
        reach[i] = r
    rest = reach[0].bit_length() - 1
    chosen: list[int] = []
    for i, s in enumerate(usable):
        k = min(left[s], rest // s)
        while not reach[i + 1] >> (rest - s * k) & 1:
            k -= 1
        chosen += [s] * k
        rest -= s * k
    return tuple(chosen)


def _first_at_most(sizes: list[int], room: int, start: int = 0) -> int:
    """Place of the first size not above `room` in a descending list."""
    return bisect_left(sizes, -room, lo=start, key=lambda s: -s)


Patterns = list[tuple[dict[int, int], int]]


def pack_sizes(counts: dict[int, int], capacity: int) -> Patterns:
    """Container patterns (items by size) and how often each is used; every item is used once.

    Best-fit is the incumbent that bin completion has to equal or beat; while the lower bound is
    missed, completion with fillings of near least waste is tried too, at most SEARCH_ITEMS items are
    searched by branch and bound, and of more items those in the containers with most waste are.
    """
    left = {s: n for s, n in counts.items() if n > 0 and 0 < s <= capacity}
    least = lower_bound(left, capacity)
    best = best_fit(left, capacity)
    best = complete_bins(left, capacity, _used(best)) or best
    if _used(best) > least:
        best = complete_bins(left, capacity, _used(best) - 1, exact=False) or best
    if _used(best) > least and sum(left.values()) <= SEARCH_ITEMS:
        return _branch_and_bound(left, capacity, best, least)
    while _used(best) > least:
        better = _repacked(best, capacity)
        if _used(better) == _used(best):
            break
        best = better
    return best


def _repacked(best: Patterns, capacity: int) -> Patterns:
    """The packing with its most wasteful containers, of at most SEARCH_ITEMS items, searched anew."""
    kept: Patterns = []
    again: Patterns = []
    room = SEARCH_ITEMS
    for pattern, times in sorted(best, key=lambda p: sum(s * k for s, k in p[0].items())):
        t = min(times, room // sum(pattern.values()))
        room -= t * sum(pattern.values())
        again += [(pattern, 1)] * t
        kept += [(pattern, times - t)] * (t < times)
    items: Counter = Counter()
    for pattern, _ in again:
        items.update(pattern)
    return kept + _branch_and_bound(dict(items), capacity, again, lower_bound(items, capacity))


def lower_bound(left: dict[int, int], capacity: int) -> int:
    """Containers that no packing can do without: by volume, and by items above half the capacity."""
    volume = sum(s * n for s, n in left.items())
    return max(-(-volume // capacity), sum(n for s, n in left.items() if 2 * s > capacity))


def _used(patterns: Patterns) -> int:
    return sum(times for _, times in patterns)


def complete_bins(counts: dict[int, int], capacity: int, most: int, exact: bool = True) -> Patterns | None:
    """Fill containers one pattern at a time around the largest item left; None once more than
    `most` containers are certain by volume."""
    left = dict(counts)
    volume, used = sum(s * n for s, n in counts.items()), 0
    sizes = sorted(left, reverse=True)
    out: Patterns = []
    while sizes:
        largest = sizes[0]
        left[largest] -= 1
        filling = best_filling(capacity - largest, sizes, left, exact)
        left[largest] += 1
        pattern = dict(Counter((largest, *filling)))
        times = min(left[s] // k for s, k in pattern.items())
        for s, k in pattern.items():
            left[s] -= k * times
        out.append((pattern, times))
        used += times
        volume -= times * sum(s * k for s, k in pattern.items())
        if used + -(-volume // capacity) > most:
            return None
        sizes = [s for s in sizes if left[s]]
    return out


def best_fit(counts: dict[int, int], capacity: int) -> Patterns:
    """Largest items first, each into the fullest containers that hold it; equal containers are
    filled together."""
    groups: list[tuple[int, dict[int, int], int]] = []  # room, pattern, containers; by room
    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            at = bisect_left(groups, s, key=lambda g: g[0])
            room, pattern, c = groups.pop(at) if at < len(groups) else (capacity, {}, n)
            k = min(room // s, n)
            t = min(c, n // k)
            if t < c and pattern:
                groups.insert(bisect_left(groups, room, key=lambda g: g[0]), (room, pattern, c - t))
            insort(groups, (room - s * k, pattern | {s: k}, t), key=lambda g: g[0])
            n -= k * t
    return [(pattern, c) for _, pattern, c in groups]


def _branch_and_bound(counts: dict[int, int], capacity: int, best: Patterns, least: int) -> Patterns:
    """Depth-first over the undominated fillings around the largest item left, pruned by volume."""
    state = {"best": best, "nodes": 0}
    left = dict(counts)

    def search(taken: Patterns) -> None:
        sizes = sorted((s for s, n in left.items() if n), reverse=True)
        if not sizes:
            state["best"] = list(taken)
            return
        if len(taken) + lower_bound(left, capacity) >= _used(state["best"]):
            return
        left[sizes[0]] -= 1
        options = sorted(_fillings(capacity - sizes[0], sizes, left), key=sum, reverse=True)
        left[sizes[0]] += 1
        for filling in options:
            state["nodes"] += 1
            if state["nodes"] > SEARCH_NODES or _used(state["best"]) == least:
                return
            pattern = dict(Counter((sizes[0], *filling)))
            for s, k in pattern.items():
                left[s] -= k
            search([*taken, (pattern, 1)])
            for s, k in pattern.items():
                left[s] += k

    search([])
    return state["best"]


def _fillings(room: int, sizes: list[int], left: dict[int, int]) -> list[tuple[int, ...]]:
    """Undominated fillings of a room: nothing that is left over still fits. At most NODES of them."""
    out: list[tuple[int, ...]] = []

    def grow(i: int, free: int, chosen: tuple[int, ...]) -> None:
        if len(out) >= NODES:
            return
        while i < len(sizes) and sizes[i] > free:
            i += 1
        if i == len(sizes):
            have = Counter(chosen)
            if not any(s <= free and left[s] > have[s] for s in sizes):
                out.append(chosen)
            return
        s = sizes[i]
        for k in range(min(left[s], free // s), -1, -1):
            grow(i + 1, free - s * k, (*chosen, *[s] * k))

    grow(0, room, ())
    return out


def items_of(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Items of every target: whole-container parts of long texts and the rests, with partition id."""
    t = F.broadcast(targets.select("target_id", F.col("capacity_tokens").alias("capacity")).where("capacity_tokens > 0"))
    each = sizes.withColumn("pid", F.spark_partition_id()).crossJoin(t)
    parts = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.col("capacity")).cast("int"))
    part = each.select("pid", "target_id", "capacity", "doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part_no"))
    return part.select("pid", "target_id", "capacity", "doc_id", "part_no", F.least("capacity", F.col("n_tokens") - F.col("part_no") * F.col("capacity")).alias("size"))


def pack(documents: DataFrame, targets: DataFrame, folder: str = VOCABULARIES, name: str = NAME) -> DataFrame:
    """Every text's containers: target_id, container_id, doc_id, part_no, n_tokens.

    Ranks within a size are a partition's offset plus a count inside the partition, so that no
    size, however common, is gathered into one task. `targets` is a fixed small table.
    """
    sizes = checkpointed(sized(documents, folder, name))
    items = items_of(sizes, targets)
    local = items.groupBy("pid", "target_id", "capacity", "size").agg(F.count("*").alias("n"))
    before = Window.partitionBy("target_id", "size").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = local.select("pid", "target_id", "size", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    histogram = local.groupBy("target_id", "capacity", "size").agg(F.sum("n").alias("n"))
    slots = histogram.groupBy("target_id").applyInPandas(_slots, "target_id bigint, size bigint, starts array<bigint>, per array<bigint>, firsts array<bigint>")

    ranked = items.drop("capacity").mapInArrow(_rank_inside, "pid int, target_id bigint, doc_id bigint, part_no int, size bigint, inside bigint")
    placed = (
        ranked.join(offsets, ["pid", "target_id", "size"])
        .join(F.broadcast(slots), ["target_id", "size"], "left")
        .select("target_id", "doc_id", "part_no", "size", (F.col("inside") + F.col("offset")).alias("rank"), "starts", "per", "firsts")
    )
    return map_rows(placed, _container, "target_id bigint, container_id bigint, doc_id bigint, part_no int, n_tokens bigint")


def _rank_inside(batches):
    import pyarrow as pa

    seen: dict[tuple[int, int], int] = {}
    for batch in batches:
        keys = zip(batch.column(1).to_pylist(), batch.column(4).to_pylist())
        inside = []
        for key in keys:
            n = seen.get(key, 0)
            inside.append(n)
            seen[key] = n + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(inside, pa.int64())], names=[*batch.schema.names, "inside"])


def _slots(rows: pd.DataFrame) -> pd.DataFrame:
    """Patterns of one target as places by size: from which rank on, how many a container, which."""
    capacity = int(rows["capacity"].iloc[0])
    counts = {int(s): int(n) for s, n in zip(rows["size"], rows["n"])}
    found: dict[int, tuple[list[int], list[int], list[int]]] = {}
    filled = dict.fromkeys(counts, 0)
    first = 0
    for pattern, times in pack_sizes(counts, capacity):
        for s, k in pattern.items():
            starts, per, firsts = found.setdefault(s, ([], [], []))
            starts.append(filled[s])
            per.append(k)
            firsts.append(first)
            filled[s] += k * times
        first += times
    target = int(rows["target_id"].iloc[0])
    return pd.DataFrame([(target, s, *x) for s, x in found.items()], columns=["target_id", "size", "starts", "per", "firsts"])


def _container(cols: list[list]) -> list[list]:
    targets, docs, parts, sizes, ranks, starts, per, firsts = cols
    out = []
    for rank, s, k, f in zip(ranks, starts, per, firsts):
        if s is None:
            out.append(0)
        else:
            i = bisect_right(s, rank) - 1
            out.append(f[i] + (rank - s[i]) // k[i])
    return [targets, out, docs, parts, sizes]


def fill_report(assignments: DataFrame, targets: DataFrame) -> DataFrame:
    """Containers, tokens, least possible containers and share of unused space by target."""
    per = assignments.where("n_tokens > 0").groupBy("target_id", "container_id").agg(F.sum("n_tokens").alias("used"))
    total = per.groupBy("target_id").agg(F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"))
    space = F.col("n_containers") * F.col("capacity_tokens")
    return total.join(F.broadcast(targets.select("target_id", "target_name", "capacity_tokens")), "target_id").select(
        "target_id", "target_name", "capacity_tokens", "n_containers", "n_tokens", "fullest", F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least_containers"), F.round(1 - F.col("n_tokens") / space, 6).alias("unused_share")
    )
