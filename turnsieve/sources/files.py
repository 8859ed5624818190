"""File sources and sinks: JSON lines, whole documents of varying shape, resumable and audited output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.joins import unseen


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines under a declared schema; blank lines are skipped, broken lines give nulls."""
    return spark.read.schema(schema).json(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON documents as text: one row a file with its name."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("document"))


def dialogues_of(documents: DataFrame, entry: str) -> DataFrame:
    """Entries of documents that hold a list, an object with `dialogues`, `data` or `instances`, or
    an object of entries by id: file_name, key, entry (of the given DDL type)."""
    listed = [F.from_json("document", f"array<{entry}>")] + [F.from_json("document", f"{k} array<{entry}>")[k] for k in ("dialogues", "data", "instances")]
    by_id = F.from_json("document", f"map<string,{entry}>")
    head = F.substring(F.ltrim("document"), 1, 1)
    as_list = F.when(head == "[", listed[0]).otherwise(F.coalesce(*listed[1:]))
    with_key = F.when(as_list.isNotNull(), F.transform(as_list, lambda e, i: F.struct(i.cast("string").alias("key"), e.alias("entry")))).otherwise(F.transform(F.map_entries(by_id), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("entry"))))
    return documents.select("file_name", F.inline(with_key))


def file_parts(files: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """Columns from the groups of a pattern over file names; a name that does not fit gives nulls."""
    got = [F.when(F.regexp_like("file_name", F.lit(pattern)), F.nullif(F.regexp_extract("file_name", pattern, i), F.lit(""))).alias(n) for i, n in enumerate(names, 1)]
    return files.select("*", *got)


def write_jsonl(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, UTF-8 as it is."""
    rows.write.mode(mode).json(path)


def write_document(rows: DataFrame, path: str, group: str) -> None:
    """One aggregate document a group, as a JSON line: group and its rows in order of their columns."""
    rest = [c for c in rows.columns if c != group]
    rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("rows")).write.mode("overwrite").json(path)


def append_new(rows: DataFrame, path: str, key: str, schema: StructType | str) -> None:
    """Append rows whose key the sink lacks; a second run of the same rows adds nothing. Of the sink only the
    key column is read."""
    spark = rows.sparkSession
    try:
        fresh = unseen(rows, spark.read.schema(schema).parquet(path), key)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        fresh = rows
    fresh.dropDuplicates([key]).write.mode("append").parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and SHA-256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def markdown(rows: DataFrame, limit: int = 200) -> str:
    """A small report as a Markdown table; refuses tables above the limit."""
    found = rows.limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError("a report has at most %d rows" % limit)
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in found])
