"""Problems 2 and 6: token budgets and whole-corpus encoding under a public vocabulary.

Defined results for hard input: null and empty texts have no tokens (an empty list, count 0) and
still count as texts; missing languages, domains and sources form the slice `unknown`; repeated
rows count as often as they stand; an empty table gives no rows. Texts are read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import dataset_name
from ..runtime import map_rows, spread
from .bpe import NAME, VOCABULARIES, encoder

#: Piece counts a worker gathers before it hands them on.
FLUSH = 200_000


def lang_name(x: str) -> Column:
    """Primary language subtag in lower case; `unknown` for null, blank, `und` and unreadable tags."""
    tag = F.lower(F.regexp_extract(F.col(x), r"^\s*([A-Za-z]{2,3})(?:$|[-_\s])", 1))
    return F.when(F.coalesce(tag, F.lit("")).isin("", "und"), "unknown").otherwise(tag)


def named(x: str) -> Column:
    return F.coalesce(F.nullif(F.trim(F.col(x)), F.lit("")), F.lit("unknown"))


def encode_corpus(documents: DataFrame, folder: str = VOCABULARIES, name: str = NAME) -> DataFrame:
    """Ids of every text: doc_id bigint, ids array<int>; no ids for null and empty texts."""

    def run(cols: list[list]) -> list[list]:
        encode = encoder(folder, name).encode
        return [cols[0], [encode(t) for t in cols[1]]]

    return map_rows(spread(documents.select("doc_id", "text")), run, "doc_id bigint, ids array<int>")


def sized(documents: DataFrame, folder: str = VOCABULARIES, name: str = NAME) -> DataFrame:
    """Token count of every document: doc_id bigint, n_tokens bigint."""

    def run(cols: list[list]) -> list[list]:
        count = encoder(folder, name).count
        return [cols[0], [count(t) for t in cols[1]]]

    return map_rows(spread(documents.select("doc_id", "text")), run, "doc_id bigint, n_tokens bigint")


def prompt_texts(probes: DataFrame, datasets: DataFrame) -> DataFrame:
    """Prompts with their slice; the five datasets are a fixed table."""
    langs = datasets.select(dataset_name("dataset").alias("slice"), lang_name("lang").alias("lang")).dropDuplicates(["slice"])
    return (
        probes.select("row_id", F.coalesce(dataset_name("dataset"), F.lit("unknown")).alias("slice"), named("domain").alias("domain"), F.col("prompt_user").alias("text"))
        .join(F.broadcast(langs), "slice", "left")
        .select(F.lit("probes").alias("source_table"), F.col("row_id").alias("row_key"), "slice", F.coalesce("lang", F.lit("unknown")).alias("lang"), "domain", "text")
    )


def document_texts(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.lit("documents").alias("source_table"), F.col("doc_id").alias("row_key"), named("source").alias("slice"), lang_name("lang").alias("lang"), named("domain").alias("domain"), "text"
    )


def text_tokens(texts: DataFrame, folder: str = VOCABULARIES, name: str = NAME) -> DataFrame:
    """Token count of each text beside its slice; every worker tokenizes a distinct piece once."""

    def run(cols: list[list]) -> list[list]:
        count = encoder(folder, name).count
        return [*cols[:5], [count(t) for t in cols[5]]]

    schema = "source_table string, row_key bigint, slice string, lang string, domain string, n_tokens bigint"
    return map_rows(spread(texts.select("source_table", "row_key", "slice", "lang", "domain", "text")), run, schema)


def piece_counts(texts: DataFrame, folder: str = VOCABULARIES, name: str = NAME) -> DataFrame:
    """Pre-split pieces with their frequency by slice, combined before anything is shuffled.

    The row with a null piece holds the number of texts of the slice.
    """
    schema = pa.schema([(c, pa.string()) for c in ("source_table", "slice", "lang", "domain", "piece")] + [("freq", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(folder, name).pieces
        counts: dict[tuple, Counter] = {}
        held = 0

        def out() -> pa.RecordBatch:
            rows = [(*k, p, n) for k, c in counts.items() for p, n in c.items()]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * 6, schema)], schema=schema)

        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(4)))
            for key, text in zip(keys, batch.column(4).to_pylist()):
                own = counts.setdefault(key, Counter())
                before = len(own)
                own[None] += 1
                if text:
                    own.update(pieces(text))
                held += len(own) - before
                if held > FLUSH:
                    yield out()
                    counts.clear()
                    held = 0
        yield out()

    return spread(texts.select("source_table", "slice", "lang", "domain", "text")).mapInArrow(run, "source_table string, slice string, lang string, domain string, piece string, freq bigint")


def slice_totals(texts: DataFrame, folder: str = VOCABULARIES, name: str = NAME) -> DataFrame:
    """Texts and tokens by slice: source_table, slice, lang, domain, n_texts, n_tokens.

    Pieces are brought together by one shuffle, so that each distinct piece of the corpus is
    tokenized once, where its length then meets its frequencies in every slice.
    """
    keys = ["source_table", "slice", "lang", "domain"]
    together = piece_counts(texts, folder, name).groupBy(*keys, "piece").agg(F.sum("freq").alias("freq")).repartition("piece")

    def run(cols: list[list]) -> list[list]:
        coder = encoder(folder, name)
        lengths = {p: len(coder.piece_ids(p)) for p in set(cols[4]) if p is not None}
        return [*cols[:4], [0 if p is None else n * lengths[p] for p, n in zip(cols[4], cols[5])], [n if p is None else 0 for p, n in zip(cols[4], cols[5])]]

    parts = map_rows(together.select(*keys, "piece", "freq"), run, "source_table string, slice string, lang string, domain string, tokens bigint, texts bigint")
    return parts.groupBy(*keys).agg(F.sum("texts").alias("n_texts"), F.sum("tokens").alias("n_tokens"))


def reader_counts(probes: DataFrame, answers: DataFrame) -> DataFrame:
    """The readers' own token counts by dataset and domain: median of the positive counts of each
    request, taken for each probe that uses it: slice, domain, reader_tokens, n_reader_texts."""
    by_request = answers.where("input_tokens > 0 and id is not null").groupBy("id").agg(F.median("input_tokens").alias("tokens"))
    asked = (
        probes.where("request_id is not null")
        .groupBy(F.col("request_id").alias("id"), F.coalesce(dataset_name("dataset"), F.lit("unknown")).alias("slice"), named("domain").alias("domain"))
        .agg(F.count("*").alias("n"))
    )
    return asked.join(by_request, "id").groupBy("slice", "domain").agg(F.sum(F.col("n") * F.col("tokens")).cast("bigint").alias("reader_tokens"), F.sum("n").alias("n_reader_texts"))


def token_budget(probes: DataFrame, datasets: DataFrame, answers: DataFrame, documents: DataFrame, folder: str = VOCABULARIES, name: str = NAME) -> DataFrame:
    """Totals of both corpora by slice, prompts beside the readers' own counts (null for documents)."""
    texts = prompt_texts(probes, datasets).unionByName(document_texts(documents))
    own = reader_counts(probes, answers).withColumn("source_table", F.lit("probes"))
    return slice_totals(texts, folder, name).join(own, ["source_table", "slice", "domain"], "left").select("source_table", "slice", "lang", "domain", "n_texts", "n_tokens", "n_reader_texts", "reader_tokens")
