"""Lines that repeat across documents, as run-length keep bitmaps.

Every document lists its distinct long keys once.  Their hashes are counted per
salt before the shuffle, range-partitioned by hash and sorted by (hash, document
descending): a key has at most SALTS rows there however common it is.  Streaming
over a key's rows, the first occurrence is the document that keeps the line, and
the sum is the number of documents.  Lines meet their keys in an equi-join, very
common keys in a bounded broadcast.  What a document loses comes back as
positions and leaves as runs: kept, dropped, kept, ... lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import keep, look_up
from .url_rules import LOWER, UPPER

BLANKS = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS, SALTS = 20, 3, 64


def lines_of(text: Column) -> Column:
    """The lines between ``\\n``; null and empty texts are one empty line."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(BLANKS)), UPPER, LOWER)


def _hashes(key: Column) -> tuple[Column, Column]:
    """128 bits of two independently seeded hashes."""
    return F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(20), key).alias("h2")


def keep_runs(n_lines: Column, dropped: Column) -> Column:
    """Run lengths, kept first, from the ascending positions that go."""
    n = F.size(dropped)
    first = F.filter(dropped, lambda x, i: (i == 0) | (F.get(dropped, i - 1) != x - 1))
    last = F.filter(dropped, lambda x, i: (i == n - 1) | (F.get(dropped, i + 1) != x + 1))
    pairs = F.transform(
        first,
        lambda x, i: F.array(x - F.when(i == 0, F.lit(0)).otherwise(F.get(last, i - 1) + 1), F.get(last, i) - x + 1),
    )
    end = F.coalesce(F.get(last, F.size(last) - 1) + 1, F.lit(0))
    return F.concat(F.flatten(pairs), F.array(n_lines.cast("int") - end))


def apply_runs(lines: Column, runs: Column) -> Column:
    """The kept lines."""
    flags = F.flatten(F.transform(runs, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    kept = F.filter(F.arrays_zip(lines.alias("line"), flags.alias("keep")), lambda x: x["keep"])
    return F.transform(kept, lambda x: x["line"])


def row_key(text: str = "text") -> Column:
    """Tells apart the rows of one doc_id by their text."""
    return F.xxhash64(F.lit(6), F.col(text).cast("string"))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs(doc_id, text)`` to ``doc_id, row, n_dropped, keep_runs``, a row per distinct (doc_id, text) that loses lines.

    A key is a line without blanks at both ends, A-Z lower-cased.  Keys of at
    least ``min_chars`` code points in at least ``min_docs`` documents lose all
    their lines except those in the largest doc_id that holds the key.  ``row``
    is :func:`row_key` of the text.  Null and empty texts have one empty line,
    kept.  Rows that repeat a doc_id count as one document.  Rows with a null
    doc_id keep all lines and count for nothing.  Other columns are not read.
    """
    rows = docs.select("doc_id", row_key().alias("row"), lines_of(F.col("text")).alias("lines")).withColumn(
        "keys", F.transform("lines", line_key)
    )
    held = rows.select(
        "doc_id", "row", F.size("lines").cast("long").alias("n_lines"), F.posexplode_outer("keys").alias("at", "key")
    ).where(F.length("key") >= min_chars)
    held = keep(held.select("doc_id", "row", "n_lines", "at", *_hashes(F.col("key"))), "lines")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")
    in_docs = held.where("doc_id IS NOT NULL").select("h1", "h2", "doc_id", salt).distinct()
    counted = in_docs.groupBy("h1", "h2", "salt").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    ranged = counted.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", F.desc("last"))
    stream = Window.partitionBy("h1", "h2").orderBy(F.desc("last"))
    total = F.sum("n").over(Window.partitionBy("h1", "h2").orderBy(F.desc("last")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    keys = ranged.withColumn("first", F.row_number().over(stream)).withColumn("n_docs", total)
    keys = keys.where((F.col("first") == 1) & (F.col("n_docs") >= min_docs)).select(F.struct("h1", "h2").alias("key"), "n_docs", "last")
    at_lines = held.withColumn("key", F.struct("h1", "h2")).drop("h1", "h2")
    gone = look_up(at_lines, keep(keys, "common-lines"), "key", "n_docs", F.col("doc_id")).where("doc_id < last")
    gone = gone.groupBy("doc_id", "row").agg(F.first("n_lines").alias("n_lines"), F.array_sort(F.collect_set("at")).alias("dropped"))
    return gone.select(
        "doc_id", "row", F.size("dropped").cast("long").alias("n_dropped"), keep_runs(F.col("n_lines"), F.col("dropped")).alias("keep_runs")
    )


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped``: each input row with the lines that its bitmap keeps."""
    maps = keep_bitmaps(docs, min_chars, min_docs).withColumnRenamed("doc_id", "of_doc").withColumnRenamed("row", "of_row")
    texts = docs.select("doc_id", "text")
    both = texts.join(maps, (F.col("doc_id") == F.col("of_doc")) & (row_key() == F.col("of_row")), "left")
    lines = lines_of(F.col("text"))
    left = F.when(F.col("keep_runs").isNull(), F.coalesce(F.col("text").cast("string"), F.lit(""))).otherwise(
        F.array_join(apply_runs(lines, F.col("keep_runs")), "\n")
    )
    return both.select(
        "doc_id",
        left.alias("text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
    )
