"""Core queries: name -> function of (spark, sf_dir), and the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nested
from ..runtime import table
from . import extra, scoring, selection, tables, wider

LISTS = ("s_origin", "s_evidence", "s_transition_support", "control_origin", "control_transition_support")


def p5_found(spark, d):
    return nested.turn_references(table(spark, d, "probes"), table(spark, d, "raw_probe_records"))


def p5_probe_table(spark, d):
    return nested.probe_table(table(spark, d, "raw_probe_records"))


def p5_schema_edges(spark, d):
    return nested.observed_edges(table(spark, d, "raw_probe_records"), "payload")


def p5_probe_members(spark, d):
    """The generated table of probes, with a column for every member seen in it."""
    return nested.nested_tables(table(spark, d, "raw_probe_records"))["probes"]


def p5_list_entries(spark, d):
    return nested.reference_table(table(spark, d, "raw_probe_records"))


def p5_nested_rows(spark, d):
    """Rows of all generated tables with their keys; cells by path."""
    records = table(spark, d, "raw_probe_records")
    rows = nested.shredded(records, nested.mapping_of(records)[0])
    return rows.select("table_name", "record_id", "row_no", "parent_table", "parent_no", "list_pos", "probe_no", F.to_json("cells").alias("cells"))


def p5_table_catalog(spark, d):
    return nested.table_catalog(table(spark, d, "raw_probe_records"))


def p5_meta_references(spark, d):
    return nested.meta_references(table(spark, d, "probes"))


QUERIES = {f.__name__: f for f in (p5_found, p5_probe_table, p5_schema_edges, p5_probe_members, p5_list_entries, p5_nested_rows, p5_table_catalog, p5_meta_references)} | selection.QUERIES | scoring.QUERIES | tables.QUERIES | extra.QUERIES | wider.QUERIES
ORACLE: dict[str, str] = {
    "p5_meta_references": " union all ".join(
        f"select row_id as parent_id, method, probe_type, '{n}' as list_name, p::bigint as list_pos, (meta.{n})[p + 1] as turn_id from probes, unnest(range(0, len(meta.{n}))) u(p) where meta.{n} is not null" for n in LISTS
    )
} | selection.ORACLE | scoring.ORACLE | tables.ORACLE | extra.ORACLE | wider.ORACLE
