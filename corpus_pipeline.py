"""Training-corpus pipeline: STAGES of (name, function), run in order.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``.  All but the last return
the columns of ``documents``.  Texts are whole everywhere.  Columns that docs
have besides those of ``documents`` pass through the filtering stages, whatever
their names; nulls, empty texts, repeated rows and empty tables are treated as
the operators of ``tidewright.llm`` say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.decontaminate import contaminations
from tidewright.llm.gru_lang import keep_identified
from tidewright.llm.line_dedup import row_key
from tidewright.llm.near_dedup import near_duplicates
from tidewright.llm.source_mix import taken_words
from tidewright.llm.store import keep, shared_path
from tidewright.llm.token_files import read_token_files, write_token_files

LEAST_SCORE = 0.34  # mean probability of the language, over all positions of a text
END = 2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language go: no letter, or no language with probability LEAST_SCORE."""
    return keep_identified(docs, LEAST_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id.

    A document's id is its doc_id.  Rows that repeat a doc_id with different
    texts are documents of their own: the text with the smallest hash goes by
    the doc_id and each other one by a hash of doc_id and text.  Rows that
    repeat doc_id and text are copies, of which the one with the smallest hash
    over all columns stays.  Rows without a doc_id are in no group and stay.
    """
    hidden = F.struct(*[F.col(c) for c in docs.columns]).alias("columns")  # so that no caller's column can clash
    rows = docs.select(F.col("doc_id").alias("id"), row_key().alias("text_key"), hidden)
    groups = rows.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n"), F.min("text_key").alias("first_key"))
    groups = keep(groups.where("n > 1").select(F.col("id").alias("group_id"), "first_key"), "repeated-ids")
    repeated = rows.join(groups, rows["id"] == groups["group_id"])
    copy_key = F.xxhash64(F.to_json("columns", {"ignoreNullFields": "false"}))
    repeated = repeated.groupBy("id", "text_key").agg(F.first("first_key").alias("first_key"), F.min_by("columns", copy_key).alias("columns"))
    own = F.when(F.col("text_key") == F.col("first_key"), F.col("id")).otherwise(F.xxhash64("id", "text_key"))
    single = rows.where("id IS NOT NULL").join(groups, rows["id"] == groups["group_id"], "left_anti")
    known = single.select("id", "columns").unionByName(repeated.select(own.alias("id"), "columns"))
    if not groups.isEmpty():
        known = keep(known, "own-ids")
    texts = known.select(F.col("id").alias("doc_id"), F.col("columns.text").alias("text"))
    kept = near_duplicates(texts).where("kept").select(F.col("doc_id").alias("kept_id"))
    stay = known.join(kept, known["id"] == kept["kept_id"], "left_semi").select("columns")
    return stay.unionByName(rows.where("id IS NULL").select("columns")).select("columns.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    found = keep(contaminations(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "contaminated")
    bad = found.select(F.col("row").alias("bad_row")).distinct()
    return docs.join(bad, row_key().eqNullSafe(bad["bad_row"]), "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as the schedule takes its words, 0 to 2 times.

    A document enters whole; the one at the end of a source's stream, which the
    last block cuts, enters if at least half of it is taken.  Texts without a
    word are never taken.
    """
    often = F.round(F.sum("taken") / F.sum("size")).cast("int").alias("mix_copies")
    taken = taken_words(docs).where("size > 0").groupBy(F.col("doc_id").alias("mix_id"), F.col("row").alias("mix_row")).agg(often)
    taken = taken.where("mix_copies > 0").select("mix_id", "mix_row", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))  # a row a copy
    same = docs["doc_id"].eqNullSafe(taken["mix_id"]) & (row_key() == taken["mix_row"])
    return docs.join(taken, same).select(*[docs[c] for c in docs.columns])


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files in ascending doc_id order, read back: doc_id, start, n_tokens, ids_crc32."""
    folder, vocabulary = shared_path(spark, "corpus"), public_tokenizers.path("byte_bpe_50k.json")
    return read_token_files(keep(write_token_files(docs, folder, vocabulary, END), "corpus-manifest"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]
ORACLE_SQL = None  # the network and the tokenizer have no SQL; tests compare each stage with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
