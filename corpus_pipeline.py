"""The corpus pipeline over `documents`: filter by quality, drop boilerplate lines, drop near duplicates, mix sources, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, further ones of any name among them, with n_chars following the
text. Very long texts are read whole; nulls, repeated rows and empty tables are dealt with as each stage's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbstone.llm.common import delete, keep, keep_table, new_folder, table
from curbstone.llm.lines import dedup_lines
from curbstone.llm.mixing import mixed_documents
from curbstone.llm.near import near_duplicates
from curbstone.llm.packing import pack
from curbstone.llm.quality import classify, train
from curbstone.llm.queries import VOCABULARY

#: Dropped doc_ids up to which they are sent to all executors (about 50 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 500_000


def _aside(docs: DataFrame, *used: str) -> DataFrame:
    """docs with the columns that an operator reads; the others, whatever their names, are the struct __row."""
    return docs.select(*used, F.struct(*(c for c in docs.columns if c not in used)).alias("__row"))


def _back(rows: DataFrame, docs: DataFrame, *used: str) -> DataFrame:
    """The columns of docs from rows that _aside() began."""
    return rows.select(*(F.col(c) if c in used else F.col("__row")[c].alias(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier and its site and path posteriors call good and not toxic; source is the site, lang the path.

    A null text is an empty document. Equal rows share their fate. Without labels all stay; an empty table gives none.
    """
    used = ("source", "lang", "text")
    rated = classify(_aside(docs, *used), train(docs, table(spark, sf_dir, "labels")))
    return _back(rated.filter("keep"), docs, *used)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that are boilerplate of their source.

    A null text stays null and a null source is a site. Equal rows are so many pages of it; an empty table gives no rows.
    """
    used = [c for c in ("source", "text", "n_chars") if c in docs.columns]
    out = dedup_lines(_aside(docs, *used))
    if "n_chars" in docs.columns:
        length = F.coalesce(F.char_length("text"), F.lit(0)).cast(dict(docs.dtypes)["n_chars"])
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, length).otherwise(F.col("n_chars")))
    return _back(out, docs, *used)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near duplicates.

    Rows that share a doc_id are one document and stay or go together. Rows without doc_id stay, and so do null and blank
    texts, which are like nothing. An empty table gives no rows.
    """
    dropped = keep(near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct())
    if dropped.count() <= BROADCAST_IDS:
        dropped = F.broadcast(dropped)
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes, a row for each time that it takes a document, in the order of the schedule.

    The files of the result are consecutive parts of the mix. Documents without words, null texts among them, aren't taken; a null
    source is a source; equal rows are taken separately; an empty table gives no rows.
    """
    return mixed_documents(docs)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, with their ids, in the order in which the mix lies in its files.

    A null text is its end id alone; equal rows are packed separately; an empty table gives no rows.
    """
    return pack(docs, VOCABULARY, with_ids=True, as_it_lies=True)


STAGES = [("quality", quality), ("line dedup", lines), ("near dedup", near), ("mix", mix), ("pack", windows)]
#: SQL can't express MinHash bands, the trained classifier or tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the tables between stages are in the shared folder, each until the next is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = new_folder(spark)
        docs = keep_table(stage(spark, docs, sf_dir), path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
