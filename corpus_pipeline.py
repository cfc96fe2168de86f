"""Corpus pipeline: language ID, near-dedup, decontamination, secret scan, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that the
stage before kept; all but the last return the columns of documents.

Nulls and edge cases: stages act on rows, which they name themselves, so a row
with a null doc_id is judged and dropped like any other, and rows that share a
doc_id each by their own text; of equal rows near-dedup keeps one. A null or
empty text has no language and goes at the first stage. An empty table gives
empty results; a table with further columns keeps them to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import decontaminate, langid, neardup, packing, secrets
from corvane.llm.common import drop_table, materialise, only, scratch, table
from corvane.llm.queries import tokenizer_path

ORACLE_SQL = None


class Rows:
    """The documents with a number for each row, by which stages drop: doc_id may be null or repeated.

    They are written, so that every use sees the same numbers.
    """

    def __init__(self, docs: DataFrame):
        self.columns, self.name = docs.columns, "row_name"
        while self.name in docs.columns:
            self.name += "_"
        self.table = materialise(docs.withColumn(self.name, F.monotonically_increasing_id()), "named")

    def by_row(self) -> DataFrame:
        """Row names as doc_id, and texts, for operators that answer by doc_id."""
        return self.table.select(F.col(self.name).alias("doc_id"), "text")

    def chosen(self, names: DataFrame, how: str) -> DataFrame:
        """The rows with the given names (one column; left_semi), or all but those (left_anti)."""
        names = names.select(F.col(names.columns[0]).alias(self.name)).distinct()
        return only(self.table, materialise(names, "names"), self.name, how).select(*self.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without any language: no text, no letter, or no language fits."""
    rows = Rows(docs)
    found = langid.identify(rows.by_row(), langid.labelled_samples(docs))
    return rows.chosen(found.where(F.col("lang_pred") == langid.UNKNOWN).select("doc_id"), "left_anti")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the least document of each group of near duplicates; those without an id come last."""
    rows = Rows(docs)
    groups = neardup.near_duplicates(rows.by_row()).select(F.col("doc_id").alias(rows.name), "component_id")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", rows.name)
    ranked = groups.join(rows.table.select(rows.name, "doc_id"), rows.name).select("component_id", rank.alias("rank"))
    shared = ranked.groupBy("component_id").agg(F.min("rank").alias("least"), F.count("*").alias("n")).where("n > 1")
    # those that go are fewer than those that stay
    gone = ranked.join(materialise(shared.select("component_id", "least"), "groups"), "component_id").where("rank <> least")
    return rows.chosen(gone.select(f"rank.{rows.name}"), "left_anti")


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark passage."""
    rows = Rows(docs)
    found = decontaminate.contaminated(rows.by_row(), table(spark, sf_dir, "benchmark"))
    return rows.chosen(found.select("doc_id"), "left_anti")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; all documents stay."""
    return secrets.redact(docs, secrets.SecretModel(secrets.labelled_samples(docs)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed into sequences."""
    return packing.pack(packing.token_pieces(docs, tokenizer_path()))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("secret_scan", mask_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each keeps is a written table for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch() as temporary:
            kept = materialise(stage(spark, docs, sf_dir), name)
            temporary.keep(kept)
        drop_table(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
