"""Mixing sources to target weights with a low-discrepancy schedule of blocks.

Slot k of the schedule is the golden-ratio point frac((k + 1) / phi) mapped
through the sources' cumulative target shares, so every stretch of slots holds
each source about in proportion.  A source's documents, in a shuffled order, are
one stream of words that starts again after its end; blocks of equal word counts
are cut from it and the source's r-th slot takes its r-th block.  Ranks and
stream positions are prefix sums in two levels (chunks, then rows in a chunk),
so that a source with a third of all rows is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .line_dedup import row_key
from .store import keep, look_up

WEIGHTS = (3, 1, 2)
CHUNK = 2048  # rows, or slots, of a chunk
BLOCK = 2048  # words of a slot
CELLS = 1 << 16
SEED = 7
#: Fixed value: 2**64 divided by the golden ratio, made odd.
GOLDEN = 0x9E3779B97F4A7C15
_BEFORE = (Window.unboundedPreceding, -1)


def count_words(text: Column) -> Column:
    """Runs of other than ``[\\x20\\x09-\\x0D]`` in the whole text (null: 0)."""
    squeezed = F.trim(F.translate(F.coalesce(text.cast("string"), F.lit("")), "\t\n\x0b\x0c\r", "     "))
    return F.when(squeezed == "", F.lit(0)).otherwise(F.size(F.split(squeezed, " +"))).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size`` to ``..., target``, by filling up to ``most`` times each source's size.

    The level t with sum(min(weight * t, most * size)) = share * total is found
    over the sources in the order in which they fill up.  One row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.array(*[F.lit(float(w)) for w in weights])
    rows = sources.withColumn("weight", F.get(pick, (F.row_number().over(by_name) - 1) % len(weights)))
    rows = rows.withColumn("limit", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    rows = rows.withColumn("full_before", F.coalesce(F.sum("limit").over(order.rowsBetween(*_BEFORE)), F.lit(0.0)))
    rows = rows.withColumn("open_weight", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    rows = rows.withColumn("level", (F.col("total") - F.col("full_before")) / F.col("open_weight"))
    level = F.max(F.when(F.col("weight") * F.col("level") <= F.col("limit"), F.col("level"))).over(everything)
    rows = rows.withColumn("target", F.least(F.col("limit"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight")))
    return rows.select("source", "source_size", "target")


def _name(source: str | Column = "source") -> Column:
    """A source's name as a join key that is never null."""
    source = F.col(source) if isinstance(source, str) else source
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def stream_order(doc_id: Column, seed: int) -> Column:
    """60 bits that shuffle a source's documents, from the MD5 of ``seed:doc_id``."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def stream_positions(docs: DataFrame, goals: DataFrame, seed: int) -> DataFrame:
    """Adds ``source_size``, ``target`` and ``start``: the words of the source before the document, in shuffled order.

    ``docs(doc_id, source, size, row, tie)``; documents of one place in the order
    follow each other by doc_id, row and tie.  A chunk is a range of the order;
    a source has one for about CHUNK rows.
    """
    many = docs.groupBy("source").agg(F.count("*").alias("n"))
    bits = F.ceil(F.log2(F.greatest(F.col("n") / CHUNK, F.lit(1.0)))).cast("int").alias("bits")
    many = many.select(_name().alias("name"), "n", bits)
    about = many.join(goals.select(_name().alias("name"), "source_size", "target"), "name")
    rows = docs.select("*", stream_order(F.col("doc_id"), seed).alias("order"), _name().alias("name"))
    rows = look_up(rows, keep(about, "sources"), "name", "n", F.col("order"))
    rows = rows.withColumn("chunk", F.expr("shiftright(order, 60 - bits)"))
    sums = rows.groupBy("name", "chunk").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("name").orderBy("chunk").rowsBetween(*_BEFORE))
    sums = sums.select("name", "chunk", F.coalesce(before, F.lit(0)).alias("chunk_start"))
    inside = Window.partitionBy("name", "chunk").orderBy("order", "doc_id", "row", "tie").rowsBetween(*_BEFORE)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["name", "chunk"])
    return rows.withColumn("start", F.col("chunk_start") + F.col("inside")).select(*docs.columns, "source_size", "target", "start")


def schedule(goals: DataFrame, block: int) -> DataFrame:
    """``slot, source, rank``: every source has exactly ceil(target / block) slots.

    The golden-ratio points come within a few slots of that; a source that they
    leave short gets its last slots at the end of the schedule, and slots over
    its target are left out.  Slots meet sources in an equi-join on CELLS cells
    of the unit interval; a source lies in the cells that its share covers, so
    that the table has at most CELLS rows more than there are sources.
    """
    wanted = F.ceil(F.round("target") / block).cast("long")
    goals = goals.where("target > 0").select("source", "target", wanted.alias("wanted"))
    some = goals.agg(F.sum("target").alias("total"), F.count("*").alias("n")).first()
    total, n = some["total"] or 0.0, some["n"]
    slots = max(1, round(total / block)) if n else 0
    order = Window.orderBy(F.col("source").asc_nulls_last())  # a row per source
    upto = F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.lit(total or 1.0)
    names = goals.select("source", "wanted", (F.row_number().over(order) - 1).cast("long").alias("index"), upto.alias("upto"))
    low = F.coalesce(F.lag("upto").over(Window.orderBy("index")), F.lit(0.0))
    names = names.select("source", "wanted", "index", low.alias("low"), F.when(F.col("index") == n - 1, F.lit(1.0)).otherwise(F.col("upto")).alias("high"))
    names = keep(names, "shares")
    cell = lambda x: F.least(F.floor(x * CELLS), F.lit(CELLS - 1)).cast("long")
    cells = names.select("*", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"))
    # frac((k + 1) / phi) as the top 32 bits of (k + 1) * GOLDEN modulo 2**64, in two exact halves
    lower = (F.col("slot") + 1) * F.lit(GOLDEN & 0xFFFFFFFF)
    upper = (F.col("slot") + 1) * F.lit(GOLDEN >> 32) + F.shiftrightunsigned(lower, 32)
    point = upper.bitwiseAND(F.lit(0xFFFFFFFF)) / F.lit(float(1 << 32))
    plan = goals.sparkSession.range(slots).withColumnRenamed("id", "slot").withColumn("point", point)
    plan = plan.withColumn("cell", cell(F.col("point"))).join(cells, "cell").where("low <= point AND point < high")
    plan = plan.select("slot", F.floor(F.col("slot") / CHUNK).alias("chunk"), "index", "source", "wanted")
    counts = plan.groupBy("index", "chunk").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("index").orderBy("chunk").rowsBetween(*_BEFORE))
    counts = counts.select("index", "chunk", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("index", "chunk").orderBy("slot")) - 1
    ranked = plan.withColumn("inside", inside).join(counts, ["index", "chunk"])
    ranked = ranked.select("slot", "source", (F.col("before") + F.col("inside")).cast("long").alias("rank"), "wanted")
    have = plan.groupBy("index").agg(F.count("*").alias("have"))
    short = names.join(have, "index", "left").withColumn("have", F.coalesce("have", F.lit(0).cast("long")))
    short = short.where("have < wanted").select("index", "source", F.explode(F.sequence("have", F.col("wanted") - 1)).alias("rank"))
    tail = short.select((F.lit(slots) + F.col("rank") * n + F.col("index")).cast("long").alias("slot"), "source", "rank")
    return ranked.where("rank < wanted").drop("wanted").union(tail)


def mix_sources(
    docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = SEED, block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """The mix of ``docs(doc_id, text, source)``: ``(pieces, documents)``.

    ``pieces``: ``slot, source, place, doc_id, row, tie, first_word, n_words``, the
    words of a document that a slot's block of ``block`` words takes, ordered by
    slot and ``place``.  ``documents``: a row per input row with ``size,
    source_size, target, start``.  Null texts have size 0 and are never taken; a
    null source is a source, the last one.  Rows that repeat are documents of
    their own (``row`` is the hash of the text, ``tie`` counts the rows with one
    doc_id and text).  No words at all, or no rows, give an empty mix.  Other
    columns are not read.
    """
    size = count_words(F.col("text"))
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), row_key().alias("row"))
    tie = F.row_number().over(Window.partitionBy("doc_id", "row").orderBy("source"))
    rows = keep(rows.withColumn("tie", tie), "sizes")
    goals = keep(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    plan = keep(schedule(goals, block), "schedule")
    documents = keep(stream_positions(rows, goals, seed), "placed")
    # The stream runs up to ``most`` times; a document lies in each run, and each place is cut into blocks.
    again = documents.where("size > 0").withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(int(-(-most // 1)) - 1))))
    again = again.withColumn("from", F.col("start") + F.col("run") * F.col("source_size"))
    again = again.withColumn("to", F.least(F.col("from") + F.col("size"), F.round("target").cast("long"))).where("from < to")
    ranks = F.sequence(F.floor(F.col("from") / block).cast("long"), F.floor((F.col("to") - 1) / block).cast("long"))
    cut = again.select("source", "doc_id", "row", "tie", "from", "to", F.explode(ranks).alias("rank"))
    begin, end = F.greatest(F.col("from"), F.col("rank") * block), F.least(F.col("to"), (F.col("rank") + 1) * block)
    cut = cut.select(
        "source", "rank", "doc_id", "row", "tie", begin.alias("place"), (begin - F.col("from")).alias("first_word"), (end - begin).alias("n_words")
    )
    slots = plan.select("slot", _name().alias("of"), F.col("rank").alias("at"))
    pieces = cut.join(slots, (_name() == F.col("of")) & (F.col("rank") == F.col("at"))).drop("of", "at")
    return pieces.select("slot", "source", "place", "doc_id", "row", "tie", "first_word", "n_words"), documents


def taken_words(docs: DataFrame) -> DataFrame:
    """``doc_id, row, tie, size, source_size, target, taken`` per row of ``docs``, from the mix's pieces."""
    pieces, documents = mix_sources(docs)
    words = pieces.groupBy(F.col("doc_id").alias("d"), F.col("row").alias("r"), F.col("tie").alias("t")).agg(F.sum("n_words").alias("n"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")) & (F.col("tie") == F.col("t"))
    taken = F.coalesce("n", F.lit(0)).cast("long").alias("taken")
    return documents.join(words, same, "left").select("doc_id", "row", "tie", "size", "source_size", "target", taken)
