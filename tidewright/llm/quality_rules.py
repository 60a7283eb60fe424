"""Quality rules whose thresholds follow each language and source.

Ratios of the base counts go into quantile sketches: counts in buckets of 1/32
relative width, which merge by adding.  Each (language, source) takes its fences
from its own sketch, or where that holds few documents from the merged sketch of
the language, or of everything.  Documents are then joined with their fences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import keep, slices
from .words import shingles, text_buffers, word_hashes

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
#: ratio: (counted, per, units per 1, slack in units, has a lower fence)
RATIOS = {
    "word_length": ("word_chars", "n_words", 100, 100, True),
    "symbols": ("n_symbols", "n_words", 10_000, 500, False),
    "dup_lines": ("n_dup_lines", "n_lines", 10_000, 5000, False),
    "repeats": ("n_repeat_words", "n_words", 10_000, 2000, False),
}
REACH, ENOUGH = 3, 200  # times the inter-quartile range; documents of a sketch that stands alone


def repeated_words(words: np.ndarray) -> int:
    """Words in 5-word windows that are found twice or more."""
    if len(words) < 6:
        return 0
    windows = shingles(words, 5)
    _, at, n = np.unique(windows, return_inverse=True, return_counts=True)
    if n.max() < 2:
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    twice = np.flatnonzero(n[at] > 1)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + 5, -1)
    return int((np.cumsum(edge) > 0).sum())


def base_counts(docs: DataFrame) -> DataFrame:
    """The input's other columns and COUNTS of every whole text (null: none), in place of ``text``."""
    names = [c for c in docs.columns if c != "text"]
    schema = docs.select(*names).schema
    for c in COUNTS:
        schema = schema.add(c, "long")

    def run(batches):
        for batch in slices(batches):
            texts = batch.column("text").fill_null("")
            hashes, at = word_hashes(*text_buffers(texts), fold=False)
            rows = []
            for i, t in enumerate(texts.to_pylist()):
                lines = [x for x in t.split("\n") if x.strip(BLANKS)]
                rows.append(
                    (
                        int(at[i + 1] - at[i]),
                        len(t) - sum(map(t.count, BLANKS)),
                        sum(map(t.count, SYMBOLS)),
                        len(lines) - len(set(lines)),
                        repeated_words(hashes[at[i] : at[i + 1]]),
                        len(lines),
                    )
                )
            counts = np.array(rows, np.int64).reshape(-1, len(COUNTS))
            columns = [batch.column(c) for c in names] + [pa.array(counts[:, k]) for k in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays(columns, names + COUNTS)

    return docs.select(*names, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def bucket(value: Column) -> Column:
    """Lower bound of the sketch's bucket: five bits after the leading one are kept."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    width = F.pow(F.lit(2.0), shift).cast("long")
    return value - value % width


def ratio(name: str) -> Column:
    counted, per, units, _, _ = RATIOS[name]
    return F.when(F.col("n_words") > 0, F.expr(f"({units} * {counted}) div {per}"))


def sketches(counts: DataFrame, by: list[str]) -> DataFrame:
    """``by..., ratio, bucket, n``: one mergeable sketch per group and ratio."""
    values = F.explode(F.map_from_arrays(F.array(*map(F.lit, RATIOS)), F.array(*map(ratio, RATIOS)))).alias("ratio", "value")
    rows = counts.where("n_words > 0").select(*by, values)
    return rows.select(*by, "ratio", bucket(F.col("value")).alias("bucket")).groupBy(*by, "ratio", "bucket").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, by: list[str], reach: int = REACH, slacks: dict[str, int] | None = None) -> DataFrame:
    """``by..., ratio, documents, low, high`` from the quartiles of each sketch."""
    group = Window.partitionBy(*by, "ratio")
    upto = F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    rows = sketch.withColumn("upto", upto).withColumn("documents", F.sum("n").over(group))
    quartile = [F.min(F.when(4 * F.col("upto") >= k * F.col("documents"), F.col("bucket"))).alias(f"q{k}") for k in (1, 3)]
    rows = rows.groupBy(*by, "ratio").agg(F.max("documents").alias("documents"), *quartile)
    slack = {k: r[3] for k, r in RATIOS.items()} | (slacks or {})
    slack = F.element_at(F.create_map(*[F.lit(x) for pair in slack.items() for x in pair]), F.col("ratio"))
    far = reach * (F.col("q3") - F.col("q1")) + slack
    return rows.select(*by, "ratio", "documents", (F.col("q1") - far).alias("low"), (F.col("q3") + far).alias("high"))


def adaptive_fences(counts: DataFrame, reach: int = REACH, enough: int = ENOUGH, slacks: dict[str, int] | None = None) -> DataFrame:
    """A row per (lang, source) with ``<ratio>_low, <ratio>_high``."""
    own = keep(sketches(counts, ["lang", "source"]), "sketches")
    merged = own.groupBy("lang", "ratio", "bucket").agg(F.sum("n").alias("n"))
    every = merged.groupBy("ratio", "bucket").agg(F.sum("n").alias("n"))
    a = fences(own, ["lang", "source"], reach, slacks)
    b = fences(merged, ["lang"], reach, slacks).select(F.col("lang").alias("l"), F.col("ratio").alias("r"), *[F.col(c).alias(f"b_{c}") for c in ("documents", "low", "high")])
    c = fences(every, [], reach, slacks).select(F.col("ratio").alias("r2"), *[F.col(x).alias(f"c_{x}") for x in ("low", "high")])
    rows = a.join(b, F.col("lang").eqNullSafe(F.col("l")) & (F.col("ratio") == F.col("r"))).join(c, F.col("ratio") == F.col("r2"))
    pick = lambda x: F.when(F.col("documents") >= enough, F.col(x)).when(F.col("b_documents") >= enough, F.col(f"b_{x}")).otherwise(F.col(f"c_{x}"))
    rows = rows.select("lang", "source", "ratio", pick("low").alias("low"), pick("high").alias("high"))
    return rows.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("ratio") == r, F.col(x))).alias(f"{r}_{x}") for r in RATIOS for x in ("low", "high")]
    )


def judge_quality(docs: DataFrame, reach: int = REACH, enough: int = ENOUGH, slacks: dict[str, int] | None = None) -> DataFrame:
    """``docs(doc_id, text, lang, source)`` to ``doc_id, n_words, ..., base_failed, kept``, one row per input row.

    A fence lies ``reach`` inter-quartile ranges and the ratio's slack (RATIOS,
    or ``slacks`` for the ratios that it names) outside the quartiles.  A
    (language, source) of fewer than ``enough`` documents takes the fences of its
    language, and those of everything where the language has fewer too.
    Null texts have no words and fail the base rules.  A null language or source
    is a value like any other; repeated rows are judged alike and all returned.
    An empty table gives an empty one.  Other columns are not read.
    """
    counts = keep(base_counts(docs.select("doc_id", "text", "lang", "source")), "base-counts")
    limits = adaptive_fences(counts, reach, enough, slacks).withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    rows = counts.join(limits, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    inside = F.lit(True)
    for name, (_, _, _, _, lower) in RATIOS.items():
        inside = inside & (ratio(name) <= F.col(f"{name}_high"))
        if lower:
            inside = inside & (ratio(name) >= F.col(f"{name}_low"))
    rows = rows.withColumn("base_failed", failed)
    return rows.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"))
