"""Problem 5: deeply nested records as related flat tables, by shared inlining of the schema graph.

The graph has one node for each element name, with an edge for every parent it occurs under and
whether it occurs once or many times there. An element becomes a table when it is the root, is
repeated, is recursive, or has members and several parents; every other element is inlined into
the nearest table above it. Rows carry the key of their record, their own number, the number of their
parent row, and their place in the list they came from.

Defined results for hard input: null and incomplete JSON give no rows; null list entries keep
their place and give no turn; a list given as an object keeps the stated places; a lone value has
place 0; a JSON text inside a string, such as a doubly encoded member, is read as the object it
holds; unknown members are ignored; columns of other names, also clashing ones, are never read.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import map_rows, spread

#: Lists of turns that a probe may carry, wherever they stand.
TURN_LISTS = ("s_origin", "s_evidence", "s_transition_support", "control_origin", "control_transition_support")
#: An entry that names a turn in text: a number, alone or in a turn's tag.
_TURN = re.compile(r"\s*(?:\[\s*T\s*)?([+-]?\d{1,18})(?:\s*\])?\s*")
_NUMBERED = re.compile(r"\d+")
#: Members by which an object is a probe, and members that stand apart: no probe and no turn list of one is there.
MARKS, APART = ("meta", *TURN_LISTS), ("turns", "delivery", "notes")
#: Between the names of a path in a column's name.
STEP = "__"
ROW = "table_name string, record_id bigint, row_no int, parent_table string, parent_no int, list_pos bigint, probe_no int, is_probe boolean, of_probe boolean, method string, probe_type string, turn_id bigint, cells map<string,string>"


@dataclass
class Element:
    """Node of the schema graph."""

    parents: set[str] = field(default_factory=set)
    repeated: bool = False
    recursive: bool = False


def schema_graph(edges: list[tuple[str, str, bool]], root: str = "record") -> dict[str, Element]:
    """Graph of elements from (parent, child, repeated) facts."""
    graph: dict[str, Element] = defaultdict(Element)
    graph[root]
    for parent, child, many in edges:
        graph[child].parents.add(parent)
        graph[child].repeated |= many
        graph[parent]
    for name, node in graph.items():
        above, seen = list(node.parents), set()
        while above:
            p = above.pop()
            if p == name:
                node.recursive = True
                break
            if p not in seen:
                seen.add(p)
                above.extend(graph[p].parents)
    return dict(graph)


def shared_inlining(graph: dict[str, Element], root: str = "record", forced: frozenset[str] = frozenset()) -> dict[str, str]:
    """For every element the table it goes to: its own name, or that of the table it is inlined in.
    Elements of `forced` always have a table."""
    inner = {p for e in graph.values() for p in e.parents}
    own = {n for n, e in graph.items() if n == root or n in forced or e.repeated or e.recursive or len(e.parents) > 1 and n in inner}
    table: dict[str, str] = {}
    for name in graph:
        at = name
        while at not in own:
            at = min(graph[at].parents)
        table[name] = at
    return table


def probe_holders(edges: list[tuple[str, str, bool]], root: str = "record") -> frozenset[str]:
    """Elements that are probes somewhere: they carry meta or a list of turns and are not part of one."""
    below: dict[str, set[str]] = defaultdict(set)
    for parent, child, _ in edges:
        below[parent].add(child)
    seen, todo = {root}, [root]
    while todo:
        new = below[todo.pop()] - seen - {*MARKS, *APART}
        seen |= new
        todo.extend(new)
    return frozenset(n for n in seen if below[n] & {*MARKS})


def table_columns(edges: list[tuple[str, str, bool]], tables: dict[str, str]) -> dict[str, list[str]]:
    """For every table the paths of the elements inlined in it; `value` holds entries without members."""
    below: dict[str, set[str]] = defaultdict(set)
    for parent, child, _ in edges:
        below[parent].add(child)

    def paths(element: str, above: str) -> list[str]:
        return [p for c in sorted(below[element]) if tables[c] != c for p in (above + c, *paths(c, f"{above}{c}{STEP}"))]

    return {t: ["value", *paths(t, "")] for t in sorted({*tables.values()})}


def _edges(value, parent: str, out: set) -> None:
    value = _decoded(value)
    if isinstance(value, dict):
        for key, x in value.items():
            if _NUMBERED.fullmatch(key) or "::" in key:
                _edges(x, parent, out)
            else:
                entries, many = _members(key, x)
                out.add((parent, key, many))
                for _, y, _ in entries:
                    _edges(y, key, out)
    elif isinstance(value, list):
        for x in value:
            _edges(x, parent, out)


def observed_edges(records: DataFrame, payload: str) -> DataFrame:
    """Distinct (parent, child, repeated) facts of all payloads: bounded by the member names."""

    def run(cols: list[list]) -> list[list]:
        facts: set = set()
        for text in cols[0]:
            value = _parsed(text)
            if value is not None:
                _edges(value, "record", facts)
        return [list(x) for x in zip(*sorted(facts))] or [[], [], []]

    return map_rows(records.select(payload), run, "parent string, child string, repeated boolean").distinct()


def _parsed(text: str | None):
    """Value of a complete JSON text that is an object or list, else None."""
    if text is None:
        return None
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, (dict, list)) else None


def _decoded(value):
    """The object, or list of objects, that a text holds; every other value as it is."""
    if isinstance(value, str) and value[:1] in ("{", "["):
        inner = _parsed(value)
        if isinstance(inner, dict) or isinstance(inner, list) and any(isinstance(x, (dict, list)) for x in inner):
            return inner
    return value


def _members(key: str, value) -> tuple[list[tuple[int | None, object, dict]], bool]:
    """What stands under a member as (place, entry, scalars said by its key), and whether it is a list."""
    if key in TURN_LISTS:
        return [(_stated_place(y, at), y, {}) for at, y in _entries(value)], True
    value = _decoded(value)
    if isinstance(value, list):
        return [(at, y, {}) for at, y in enumerate(value)], True
    if isinstance(value, dict) and value:
        if all(_NUMBERED.fullmatch(k) for k in value):
            return [(at, y, {}) for at, y in sorted(((int(k), x) for k, x in value.items()), key=lambda e: e[0])], True
        if any("::" in k for k in value):
            each = [(at, x, _said(k)) for at, (k, x) in enumerate(value.items()) if "::" in k]
            rest = {k: x for k, x in value.items() if "::" not in k}
            return each + [(None, rest, {})] * bool(rest), True
    return [(None, value, {})], False


def _said(key: str) -> dict:
    method, _, kind = key.partition("::")
    return {"method": method, "probe_type": kind}


def _entries(value) -> list[tuple[int, object]]:
    """Entries of a list with their places, in any of the layouts a list is delivered in."""
    if isinstance(value, str) and value.lstrip()[:1] in ("[", "{"):
        inner = _parsed(value)
        if inner is not None:
            return _entries(inner)
    if isinstance(value, list):
        return list(enumerate(value))
    if isinstance(value, dict) and not any(k in value for k in ("turn_id", "turn")):
        if all(_NUMBERED.fullmatch(k) for k in value):
            return sorted((int(k), x) for k, x in value.items())
        if set(value) & {"entries", "items", "values"}:
            return _entries(next(value[k] for k in ("entries", "items", "values") if k in value))
    return [] if value is None else [(0, value)]


def turn_of(entry) -> int | None:
    """The integer that an entry names: a number, a text or tag with one, or an object's turn_id."""
    if isinstance(entry, dict):
        entry = entry.get("turn_id", entry.get("turn"))
        if isinstance(entry, dict):
            return None
    if isinstance(entry, bool) or entry is None:
        return None
    if isinstance(entry, int):
        return entry
    if isinstance(entry, float):
        return int(entry) if entry.is_integer() else None
    if isinstance(entry, str):
        found = _TURN.fullmatch(entry)
        return int(found[1]) if found else None
    return None


def _stated_place(entry, place: int) -> int:
    if isinstance(entry, dict):
        for key in ("pos", "position", "index", "list_pos"):
            if isinstance(entry.get(key), int) and not isinstance(entry.get(key), bool):
                return entry[key]
    return place


def probes_of(payload: str | None) -> list[dict]:
    """The probes of one payload as flat rows, each with its turn references.

    Tests hold the generated tables against this walk by hand. Scalars found above a probe (method, probe_type) are inherited, the
    key `method::probe_type` of an object of probes is split, wrappers are inlined.
    """
    value = _parsed(payload)
    out: list[dict] = []
    if value is not None:
        _walk(value, {}, out)
    return out


def _walk(value, above: dict, out: list[dict]) -> None:
    if isinstance(value, list):
        for x in value:
            _walk(x, above, out)
        return
    if not isinstance(value, dict):
        return
    known = above | {k: value[k] for k in ("method", "probe_type") if isinstance(value.get(k), str)}
    refs: list[tuple[str, int, int | None]] = []
    scalars: dict = {}
    if any(k in value for k in ("meta", *TURN_LISTS)):
        _collect(value, refs, scalars)
        out.append({"method": known.get("method"), "probe_type": known.get("probe_type"), "refs": refs, **scalars})
        return
    for key, x in value.items():
        if "::" in key:
            method, _, kind = key.partition("::")
            _walk(x, known | {"method": method, "probe_type": kind}, out)
        elif key not in ("turns", "delivery", "notes"):
            _walk(x, known, out)


def _collect(value: dict, refs: list, scalars: dict) -> None:
    for key, x in value.items():
        if key in TURN_LISTS:
            refs.extend((key, _stated_place(y, at), turn_of(y)) for at, y in _entries(x))
        elif isinstance(x, dict):
            _collect(x, refs, scalars)
        elif isinstance(x, str) and x[:1] == "{" and isinstance(inner := _parsed(x), dict):
            _collect(inner, refs, scalars)
        elif isinstance(x, (int, float, str, bool)):
            scalars.setdefault(key, x)


def rows_of(payload: str | None, tables: dict[str, str]) -> list[list]:
    """Rows of one payload in the tables of the mapping, in the order of ROW without the record.

    Cells are JSON texts by the path of their element, so that "3", 3 and null stay apart; an
    inlined object leaves {}. Rows are numbered over the record. `of_probe` tells that a row is
    the probe or a lone member of it, the values of which are the probe's own.
    """
    out: list[list] = []
    probes = [0]

    def open_row(element, entry, place, above, known, probe, direct, apart) -> None:
        counted = element in TURN_LISTS and probe is not None and not apart
        link = probe or (None, None, None)
        row = [tables[element], len(out), out[above][0] if above is not None else None, above, place, link[0], False, direct, link[1], link[2], turn_of(entry) if counted else None, {}]
        out.append(row)
        fill(entry, element, "", row, known, probe, direct, apart or element in TURN_LISTS)

    def fill(value, element, path, row, known, probe, direct, apart) -> None:
        if element not in TURN_LISTS:
            value = _decoded(value)
        if isinstance(value, list) and not path and element not in TURN_LISTS:
            for at, x in enumerate(value):
                open_row(element, x, at, row[1], known, probe, False, apart)
            return
        if not isinstance(value, dict):
            row[-1][path or "value"] = json.dumps(value, ensure_ascii=False)
            return
        if path:
            row[-1][path] = "{}"
        known = known | {k: value[k] for k in ("method", "probe_type") if isinstance(value.get(k), str)}
        if probe is None and not apart and any(k in value for k in MARKS):
            probe, direct = (probes[0], known.get("method"), known.get("probe_type")), True
            probes[0] += 1
            row[5:10] = [probe[0], True, True, *probe[1:]]
        for at, (key, x) in enumerate(value.items()):
            if "::" in key:
                open_row(element, x, at, row[1], known | _said(key), probe, direct, apart)
            elif _NUMBERED.fullmatch(key):
                open_row(element, x, int(key), row[1], known, probe, direct, apart)
            elif tables[key] != key:
                fill(x, key, f"{path}{STEP}{key}" if path else key, row, known, probe, direct, apart or key in APART)
            else:
                entries, many = _members(key, x)
                for place, y, said in entries:
                    if many or y is not None:
                        open_row(key, y, place, row[1], known | said, probe, direct and not many, apart or key in APART)

    value = _parsed(payload)
    if value is not None:
        open_row("record", value, None, None, {}, None, False, False)
    return out


def mapping_of(records: DataFrame) -> tuple[dict[str, str], dict[str, list[str]]]:
    """Table of every element, and columns of every table, from the edges of all payloads."""
    edges = [tuple(r) for r in observed_edges(spread(records), "payload").groupBy("parent", "child").agg(F.max("repeated").alias("repeated")).collect()]
    tables = shared_inlining(schema_graph(edges), forced=probe_holders(edges))
    return tables, table_columns(edges, tables)


def shredded(records: DataFrame, tables: dict[str, str]) -> DataFrame:
    """Rows of all payloads over all tables of the mapping, with their keys: columns of ROW."""

    def run(cols: list[list]) -> list[list]:
        rows = [(row[0], rid, *row[1:-1], list(row[-1].items())) for rid, text in zip(*cols) for row in rows_of(text, tables)]
        return [list(x) for x in zip(*rows)] or [[] for _ in range(13)]

    return map_rows(spread(records.select("record_id", "payload")), run, ROW)


def nested_tables(records: DataFrame) -> dict[str, DataFrame]:
    """The generated tables by name: record_id, row_no, parent_table, parent_no, list_pos, probe_no,
    and a column for each element that is inlined there."""
    tables, columns = mapping_of(records)
    rows = shredded(records, tables)
    keys = ("record_id", "row_no", "parent_table", "parent_no", "list_pos", "probe_no")
    out = {}
    for name, paths in columns.items():
        taken, made = set(keys), []
        for path in paths:
            alias = path
            while alias.lower() in taken:
                alias += "_"
            taken.add(alias.lower())
            made.append(F.col("cells")[path].alias(alias))
        out[name] = rows.where(F.col("table_name") == name).select(*keys, *made)
    return out


def table_catalog(records: DataFrame) -> DataFrame:
    """Columns of the generated tables and the tables their parent_no points to: table_name,
    column_name, parent_tables."""
    tables, columns = mapping_of(records)
    links = shredded(records, tables).groupBy("table_name").agg(F.array_join(F.array_sort(F.collect_set("parent_table")), ",").alias("parent_tables"))
    named = records.sparkSession.createDataFrame([(t, c) for t, cs in columns.items() for c in cs], "table_name string, column_name string")
    return named.join(links, "table_name", "left")


def probe_table(records: DataFrame) -> DataFrame:
    """Flat probes of all payloads: record_id, probe_no, method, probe_type, slot, n_turns, k_turns,
    ratio, sample_seed, origin_turn_id, final_slot_update_turn_id, control_status. A probe's values
    stand in its own row and in those of its lone members that have a table; the first one counts."""
    names = ("method", "probe_type", "slot", "n_turns", "k_turns", "ratio", "sample_seed", "origin_turn_id", "final_slot_update_turn_id", "transition_support_control_status")
    rows = shredded(records, mapping_of(records)[0]).where("probe_no is not null and of_probe")

    def first(name: str):
        said = F.filter(F.map_entries("cells"), lambda e: (F.element_at(F.split(e["key"], STEP), -1) == name) & ~e["value"].isin("null", "{}") & ~F.startswith(e["value"], F.lit("[")))
        return F.try_element_at(said, F.lit(1))["value"]

    told = rows.select("record_id", "probe_no", "row_no", F.when(F.col("is_probe"), F.col("method")).alias("m"), F.when(F.col("is_probe"), F.col("probe_type")).alias("t"), *[first(n).alias(f"c{i}") for i, n in enumerate(names)])
    each = told.groupBy("record_id", "probe_no").agg(F.max("m").alias("m"), F.max("t").alias("t"), *[F.min_by(f"c{i}", F.when(F.col(f"c{i}").isNotNull(), F.col("row_no"))).alias(f"c{i}") for i in range(len(names))])

    def run(cols: list[list]) -> list[list]:
        rid, no, m, t, *cells = cols
        made = [[None if x is None else json.loads(x) for x in c] for c in cells]
        made[:2] = [[a if a is not None else b for a, b in zip(c, known)] for c, known in zip(made, (m, t))]
        whole = {3, 4, 6, 7, 8}
        return [rid, no, *([_whole(x) if i in whole else _real(x) if i == 5 else x if x is None else str(x) for x in c] for i, c in enumerate(made))]

    schema = "record_id bigint, probe_no int, method string, probe_type string, slot string, n_turns bigint, k_turns bigint, ratio double, sample_seed bigint, origin_turn_id bigint, final_slot_update_turn_id bigint, control_status string"
    return map_rows(each, run, schema)


def _whole(x) -> int | None:
    return int(x) if isinstance(x, (int, float)) and float(x).is_integer() else None


def _real(x) -> float | None:
    return float(x) if isinstance(x, (int, float)) else None


def reference_table(records: DataFrame) -> DataFrame:
    """The tables of the five lists under each other, linked to record and probe: record_id, probe_no,
    method, probe_type, list_name, list_pos, turn_id (null where the entry names no turn)."""
    rows = shredded(records, mapping_of(records)[0]).where(F.col("table_name").isin(*TURN_LISTS) & F.col("probe_no").isNotNull())
    return rows.select("record_id", "probe_no", "method", "probe_type", F.col("table_name").alias("list_name"), "list_pos", "turn_id")


def meta_references(probes: DataFrame) -> DataFrame:
    """Turn references of the probes table's own meta: parent_id, method, probe_type, list_name,
    list_pos, turn_id; the five lists are stacked and unnested in one pass without a shuffle."""
    lists = F.array(*[F.struct(F.lit(n).alias("list_name"), F.col(f"meta.{n}").alias("entries")) for n in TURN_LISTS])
    each = probes.select(F.col("row_id").alias("parent_id"), "method", "probe_type", F.inline(lists))
    return each.select("parent_id", "method", "probe_type", "list_name", F.posexplode("entries").alias("list_pos", "turn_id")).select(
        "parent_id", "method", "probe_type", "list_name", F.col("list_pos").cast("bigint").alias("list_pos"), F.col("turn_id").cast("bigint").alias("turn_id")
    )


def turn_references(probes: DataFrame, records: DataFrame) -> DataFrame:
    """All list entries that name a turn, with their links: source_table, parent_id, method,
    probe_type, list_name, list_pos, turn_id. Equal entries of one record come once."""
    own = meta_references(probes).where("turn_id is not null").select(F.lit("probes").alias("source_table"), "*")

    named = reference_table(records).where("turn_id is not null")
    sent = named.select(F.lit("raw_probe_records").alias("source_table"), F.col("record_id").alias("parent_id"), "method", "probe_type", "list_name", "list_pos", "turn_id").distinct()
    return own.unionByName(sent)
