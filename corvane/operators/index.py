"""Inverted index: postings, document lengths, corpus statistics, trigrams."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.parse import FIELDS
from . import store

#: What a posting carries of its document.
LENGTHS = ("path", *(f"len_{f}" for f in FIELDS))


def tokenised(texts: DataFrame) -> DataFrame:
    """path, the terms of each field, and their numbers; other columns stay."""
    out = texts
    for f in FIELDS:
        out = out.withColumn(f"t_{f}", X.tokens(F.col(f)))
    return out.withColumns({f"len_{f}": F.size(f"t_{f}") for f in FIELDS})


def occurrences(tokenised_: DataFrame, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """A row for each word of each field: path (or the columns to keep), field, term."""

    def of(f: str) -> Column:
        return F.transform(f"t_{f}", lambda t: F.struct(F.lit(f).alias("field"), t.alias("term")))

    each = F.concat(*map(of, FIELDS))
    return tokenised_.select(*keep, F.explode(each).alias("o")).select(*keep, "o.field", "o.term")


def postings(tokenised_: DataFrame, terms: DataFrame | None = None, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """term, path, tf_title, tf_meta, tf_body; only of ``terms`` if given, before anything is shuffled."""
    rows = occurrences(tokenised_, keep)
    if terms is not None:
        rows = rows.join(terms.select("term").distinct(), "term", "left_semi")
    return rows.groupBy("term", *keep).agg(*(F.sum((F.col("field") == f).cast("int")).cast("int").alias(f"tf_{f}") for f in FIELDS))


def lengths(tokenised_: DataFrame) -> DataFrame:
    return tokenised_.select("path", *(f"len_{f}" for f in FIELDS))


def corpus_stats(lengths_: DataFrame) -> DataFrame:
    """One row: documents and mean field lengths, which are 1 where null or 0."""

    def mean(f: str) -> Column:
        return F.coalesce(F.nullif(F.avg(f"len_{f}"), F.lit(0.0)), F.lit(1.0)).alias(f"avg_{f}")

    return lengths_.agg(F.count("*").alias("n_docs"), *(mean(f) for f in FIELDS))


def document_frequency(tokenised_: DataFrame) -> DataFrame:
    """term and the number of documents that hold it in any field."""
    all_terms = F.array_distinct(F.concat(*(F.col(f"t_{f}") for f in FIELDS)))
    return tokenised_.select(F.explode(all_terms).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def vocabulary(tokenised_: DataFrame) -> DataFrame:
    return document_frequency(tokenised_).select("term")


def trigram_index(terms: DataFrame) -> DataFrame:
    """tri, term for each distinct trigram of each term."""
    return terms.select("term", F.explode(X.trigrams(F.col("term"))).alias("tri")).select("tri", "term")


# -- the stored index -------------------------------------------------------
@dataclass(frozen=True)
class Index:
    """What ranking reads: postings with field lengths, terms with document frequencies, corpus statistics, trigrams."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    trigrams: DataFrame
    path: str = ""
    #: The postings of listed terms with their hashes, if the store has a shorter way to them.
    find: Callable[[list[tuple[str, int]]], DataFrame] | None = None
    #: The documents' rows (path, lengths, terms and their counts), if they are stored, and whether postings are too.
    rows: DataFrame | None = None
    inverted: bool = True


def live(tokenised_: DataFrame) -> Index:
    """An index that nothing stores: each use reads the texts again."""
    df = document_frequency(tokenised_)
    return Index(postings(tokenised_, keep=LENGTHS), df, corpus_stats(lengths(tokenised_)), trigram_index(df))


#: Indexes of this session by what they were made of; the oldest goes when there are more than a few.
_stored: dict[tuple, Index] = {}
STORED = 4


def stored(documents: DataFrame, inverted: bool = True) -> Index:
    """The index of a corpus, written at its first use and read from then on while the files it comes from are the same.

    Not ``inverted`` it may be one of the documents' rows, which costs a
    fraction to build and is read whole by each search: for a search or two,
    and for many queries at once.
    """
    spark = documents.sparkSession
    key = (spark.sparkContext.applicationId, documents.select("path", *FIELDS).semanticHash(), store.file_states(documents))
    if (*key, True) in _stored:
        return _stored[*key, True]
    key = (*key, inverted)
    if key not in _stored:
        for old in list(_stored)[: max(0, len(_stored) - STORED + 1)]:
            gone = _stored.pop(old)
            if old[0] == key[0]:
                store.delete(spark, gone.path)
        from .segments import Segments  # which stores what this module defines

        own = Segments(spark, store.new_dir(spark, "index"))
        _stored[key] = own.open(own.build(documents, inverted))
    return _stored[key]


#: Query terms that are listed in the filter of the postings, so that the scan prunes by them; more are joined.
LISTED = 1000


def listed(terms: DataFrame, name: str = "term") -> list[str] | None:
    """The distinct terms if they are LISTED at most."""
    few = [r[0] for r in terms.select(name).distinct().limit(LISTED + 1).collect()]
    return few if len(few) <= LISTED else None


def local(spark: SparkSession, values: list[str], name: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def few_rows(rows: DataFrame, most: int) -> DataFrame | None:
    """The rows as a table of the driver's, if there are ``most`` at most."""
    few = rows.limit(most + 1).toArrow()
    return rows.sparkSession.createDataFrame(few, rows.schema) if few.num_rows <= most else None


def of_terms(index: Index, terms: DataFrame) -> DataFrame:
    """The postings of the given terms."""
    if index.find is None:
        return index.postings.join(terms.select("term").distinct(), "term", "left_semi")
    few = [(r["term"], r["h"]) for r in terms.select("term", F.xxhash64("term").alias("h")).distinct().limit(LISTED + 1).collect()]
    if len(few) <= LISTED:
        return index.find(few)
    return index.postings.join(terms.select("term").distinct(), "term", "left_semi")


def upserted(stored_: DataFrame, changed: DataFrame, removed: DataFrame, named: DataFrame | None = None, key: str = "path") -> DataFrame:
    """The stored rows with those of changed keys replaced and those of removed keys gone.

    ``named`` holds the changed keys where ``changed`` may have no row for one.
    """
    gone = (changed if named is None else named).select(key).union(removed.select(key)).distinct()
    return stored_.join(gone, key, "left_anti").unionByName(changed)


def index_stats(lengths_: DataFrame, postings_: DataFrame, trigrams_: DataFrame) -> DataFrame:
    """Counts of documents, postings, distinct terms and trigrams."""
    p = postings_.agg(F.count("*").alias("postings"), F.countDistinct("term").alias("terms"))
    return lengths_.agg(F.count("*").alias("docs")).join(p).join(trigrams_.agg(F.count("*").alias("trigrams")))
