"""Importance resampling of documents towards a target's distribution of n-grams.

A batch of texts is joined into one buffer with a separator between documents;
one regular expression finds all its words, a binary search in the documents'
offsets tells whose they are, and n-grams that would cross from one document
into the next are masked before they are counted.  Documents are drawn without
replacement by adding Gumbel noise to their weights and taking the highest.
"""

from __future__ import annotations

import math
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.validation import POSITION, positions
from .store import keep, slices

BLOCK = 1 << 20  # bytes of joined text whose words are in memory at once
#: Words are made of digits, a-z and all bytes from 0x80 on; A-Z count as a-z, and any other byte separates.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORDS = re.compile(rb" [^ ]+").findall


def blocks(buffer: bytes, size: int):
    """Ends of pieces of about ``size`` bytes, each cut before a separator."""
    at = 0
    while at < len(buffer):
        cut = buffer.find(b" ", at + size) if at + size < len(buffer) else -1
        end = len(buffer) if cut < 0 else cut
        yield at, end
        at = end


def runs(texts: list[bytes], n: int, size: int = BLOCK):
    """``k, document, crc32`` of all runs of k = 1 to n words of the texts, in pieces.

    A run is its words with one space between.  Runs stop at a document's end,
    and go on from one piece of the buffer to the next.
    """
    buffer = b" " + b" ".join(texts).translate(LETTERS)
    offsets = np.cumsum([1] + [len(t) + 1 for t in texts])[:-1]
    behind, last = np.full(n - 1, -1), [0] * (n + 1)  # documents of the n - 1 words before the piece; the last run of each length
    for begin, end in blocks(buffer, size):
        piece = buffer[begin:end]
        words = WORDS(piece)
        if not words:
            continue
        gap = np.frombuffer(piece, np.uint8) == 32
        document = np.searchsorted(offsets, np.flatnonzero(gap[:-1] & ~gap[1:]) + begin + 1, "right") - 1
        owners = np.r_[behind, document]
        crcs = list(map(crc32, [w[1:] for w in words]))
        for k in range(1, n + 1):
            if k > 1:
                crcs = list(map(crc32, words, previous))
            whole = owners[n - k : n - k + len(document)] == document
            yield k, document[whole], np.array(crcs, np.uint32)[whole]
            previous, last[k] = [last[k], *crcs[:-1]], crcs[-1]
        behind = owners[len(document) :]


def _bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.large_string()).cast(pa.large_binary()).fill_null(b"").to_pylist()


def bucket_counts(texts: DataFrame, n: int, buckets: int) -> np.ndarray:
    """How many features of ``texts(text)`` fall into each bucket; a task sends a row a bucket at most, and so does the cluster."""

    def run(batches):
        counts = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            for _, _, crcs in runs(_bytes(batch.column("text")), n):
                counts += np.bincount(crcs % buckets, minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used])], ["bucket", "n"])

    counts = np.zeros(buckets, np.int64)
    for row in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of the target's share of each bucket over the corpus's, smoothed by one a bucket; floored."""
    all_s, all_t = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1) * all_s / ((s + 1) * all_t))) for s, t in zip(map(float, corpus), map(float, target))], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, n: int) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row: the floored mean gain of its features (none: 0)."""

    def run(batches):
        for batch in slices(batches):
            rows = batch.num_rows
            words, features, total = (np.zeros(rows, np.int64) for _ in range(3))
            for k, document, crcs in runs(_bytes(batch.column("text")), n):
                found = np.bincount(document, minlength=rows)
                features += found
                words += found * (k == 1)
                total += np.bincount(document, gain[crcs % len(gain)], rows).astype(np.int64)  # sums of integers, exact
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (words, features, total // np.maximum(features, 1)))], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel value, floored: the same for one doc_id at every run."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10)
    return F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0))).cast("long")


def importance_draw(docs: DataFrame, target: DataFrame, share: int = 25, least: int = 20, n: int = 2, buckets: int = 10000, seed: int = 7) -> DataFrame:
    """``docs(doc_id, text)`` to ``doc_id, n_words, n_features, weight, score, rank``, one row per input row.

    Features are all runs of 1 to ``n`` words, repeats counted, in ``buckets``
    by CRC-32.  Of the rows with at least ``least`` words the ``share`` percent
    (floored) with the highest scores are drawn; ``rank`` counts them from 1 and
    is null for the others.  Equal scores go by smaller doc_id, null first; rows
    that repeat a doc_id each count and are ranked by fewer features, then in the
    order in which they were written.  Null and empty texts have no feature and
    weight 0; without a target all shares are the smoothing's.  Other columns of
    ``docs`` and ``target`` are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gain = gains(bucket_counts(texts, n, buckets), bucket_counts(target.select(F.col("text").cast("string").alias("text")), n, buckets))
    scored = weighed(texts, gain, n).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = keep(scored.withColumn("row", F.monotonically_increasing_id()), "scores")
    fit = F.col("n_words") >= least
    drawn = share * scored.where(fit).count() // 100
    placed = positions(scored.where(fit), [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features").asc(), F.col("row").asc()])
    rank = F.when(F.col(POSITION) < drawn, F.col(POSITION) + 1)
    others = scored.where(~fit).withColumn("rank", F.lit(None).cast("long"))
    return placed.withColumn("rank", rank).drop(POSITION, "row").unionByName(others.drop("row"))


def drawn_documents(docs: DataFrame, ranked: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id was drawn."""
    return docs.join(ranked.where("rank IS NOT NULL").select("doc_id").distinct(), "doc_id", "left_semi")
