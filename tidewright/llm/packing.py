"""Documents packed into sequences of a fixed capacity by bulk-synchronous best fit.

Pieces are placed in classes of falling length.  In a sweep, open sequences
(gaps) and the pieces of a class are range-sorted by size, and every piece takes
the tightest gap that no larger piece has taken: seen from the largest size down,
gaps are opening and pieces closing brackets.  Each range matches its own
brackets; what is left of a range closes first and then opens, so that the depth
(a gap's or a piece's rank among those that compete) follows from the ranges'
totals, and the brackets of one depth meet across ranges.  Then the gaps are
updated and the sweep is repeated; pieces that no gap can hold open sequences.
Only keys and lengths take part; no task sees more than its range.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .store import keep, slices

RANGE_ROWS = 1 << 14  # rows of a range, more only where there would be over MOST_RANGES of them
MOST_RANGES = 20_000
SWEEPS = 2  # of a class; a piece that lost its gap to another one tries again
#: A class's pieces are at most this share of the capacity, so that so many always fit an empty sequence.
CLASSES = [1 / 2, 5 / 12, 1 / 3, 1 / 4, 1 / 5, 1 / 6, 1 / 8, 1 / 12, 1 / 16, 1 / 32, 1 / 64, 1 / 128]
PIECES = "doc_id long, piece int, start long, length long, ids binary"


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """``docs(doc_id, text)`` as token ids with ``end_id`` after each: ``doc_id, piece, start, length, ids``.

    ``ids`` holds little-endian unsigned 32-bit integers.  A document of more
    than ``capacity`` ids is cut; its first piece is the shorter one.
    """

    def run(batches):
        encode, end = encoder(tokenizer_path).ids, np.array([end_id], "<u4")
        for batch in slices(batches):
            out, size = [], 0
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist())):
                ids = np.concatenate([ids.astype("<u4", copy=False), end])
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                out += [(doc_id, k, a, b - a, ids[a:b].tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
                size += len(ids)
                if size > 1 << 20:
                    yield _record(out)
                    out, size = [], 0
            yield _record(out)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, PIECES)


def _record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds)], [n for n, _ in kinds])


def brackets(piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the gaps and of the pieces (True) that match: each piece and the nearest free gap before it."""
    depth = np.cumsum(np.where(piece, -1, 1)) + piece
    order = np.argsort(depth, kind="stable")
    same = (depth[order][1:] == depth[order][:-1]) & piece[order][1:] & ~piece[order][:-1]
    at = np.flatnonzero(same)
    return order[at], order[at + 1]


class Plan:
    """Ranges of one sweep: slots and pieces by falling size, slots before pieces of their size.

    ``slots`` and ``wanted`` count rows by size, so at most two numbers a size come
    to the driver.  Neighbouring groups of one kind and size share a range; a
    large group takes several, dealt by ``id``, whose rows are counted by a job.
    """

    def __init__(self, both: DataFrame, slots: dict[int, int], wanted: dict[int, int]):
        target = max(RANGE_ROWS, (sum(slots.values()) + sum(wanted.values())) // MOST_RANGES)
        groups, change, held, wide = [], [0], 0, False  # change: of the depth, by range; held: rows in the last one
        for size in sorted({*slots, *wanted}, reverse=True):
            for kind, n in enumerate((slots.get(size, 0), wanted.get(size, 0))):
                if held and held + n > target:
                    change.append(0)
                    held = 0
                split = max(1, -(-n // target))
                groups.append((size, kind == 1, len(change) - 1, split))
                change[-1] += n if kind == 0 else -n
                change += [0] * (split - 1)
                held, wide = held + n, wide or split > 1
        self.ranges = len(change)
        table = both.sparkSession.createDataFrame(groups, "size long, piece boolean, first long, split long")  # two rows a size
        dealt = both.withColumn("piece", F.col("seq").isNull()).join(F.broadcast(table), ["size", "piece"])
        self.rows = dealt.withColumn("range", (F.col("first") + F.pmod(F.xxhash64("seq", "slot", "key"), "split")).cast("int"))
        if wide:
            for row in self.rows.groupBy("range").agg(F.sum(F.when(F.col("piece"), -1).otherwise(1)).alias("n")).collect():  # a row per range
                change[row["range"]] = row["n"]
        self.depth = np.cumsum([0, *change]).tolist()  # before each range


def _match_ranges(depth: list[int]):
    """Of each range, sorted: its matched slots, then what stays with its ``depth``."""

    def run(batches):
        table = pa.Table.from_batches(batches)
        if not len(table):
            return
        part = TaskContext.get().partitionId()
        piece = table.column("seq").is_null().to_numpy()
        slot, taken = brackets(piece)
        key, length = table.column("key").to_numpy().copy(), table.column("length").to_numpy().copy()
        key[slot], length[slot] = key[taken], length[taken]
        left, free = np.ones(len(piece), bool), ~piece
        left[taken] = False
        free[slot] = False
        closes = piece & left
        at = np.where(piece, depth[part] - np.cumsum(closes) + 1, depth[part] - closes.sum() + np.cumsum(free))
        matched = ~piece & ~free
        columns = [
            table.column("seq"), table.column("slot"), table.column("used"),
            pa.array(key, pa.int64(), mask=free), pa.array(length, pa.int64(), mask=free),
            pa.array(np.full(len(piece), part), pa.int64()), pa.array(at, pa.int64(), mask=matched),
        ]
        out = pa.table(columns, names=["seq", "slot", "used", "key", "length", "range", "depth"]).filter(pa.array(left))
        yield from out.to_batches(max_chunksize=1 << 16)

    return run


def sweep(gaps: DataFrame, wanted: DataFrame, open_rooms: Counter, lengths: Counter, most: int, capacity: int, name: str) -> DataFrame:
    """One sweep of ``wanted(key, length)``, none longer than ``most``, over ``gaps(seq, used)``; written.

    ``open_rooms`` and ``lengths`` count the gaps by room and the pieces by length.
    A gap that is sure to hold several pieces of the class counts as so many
    slots.  Rows of the result: a slot (seq, slot, used as it is now) with the
    piece it holds (key, length, offset) or none, and a piece that found none
    (key, length, and its ``rank`` from 0 by falling length).
    """
    slots: Counter = Counter()
    for room, n in open_rooms.items():
        slots[room // max(1, room // most)] += n * max(1, room // most)
    room = F.lit(capacity) - F.col("used")
    many = F.greatest(F.lit(1), F.floor(room / most)).cast("long")
    zero, nothing = F.lit(0).cast("long"), F.lit(None).cast("long")
    rows = gaps.select("seq", "used", F.explode(F.sequence(zero, many - 1)).alias("slot"), F.floor(room / many).cast("long").alias("size"))
    both = rows.select("size", "seq", "slot", "used", zero.alias("key"), zero.alias("length")).unionByName(
        wanted.select(F.col("length").alias("size"), nothing.alias("seq"), nothing.alias("slot"), nothing.alias("used"), "key", "length")
    )
    plan = Plan(both, slots, lengths)
    order = [F.col("size").desc(), F.col("seq").asc_nulls_last(), F.col("slot"), F.col("key")]
    dealt = plan.rows.repartitionById(plan.ranges, "range").sortWithinPartitions(*order).select("seq", "slot", "used", "key", "length")
    local = dealt.mapInArrow(_match_ranges(plan.depth), "seq long, slot long, used long, key long, length long, range long, depth long")
    # A depth has two rows of a range at most; a slot that is matched already stands alone.
    line = Window.partitionBy("depth", F.when(F.col("depth").isNull(), F.col("key"))).orderBy("range", F.col("seq").isNotNull())
    met = local.withColumns({"_next": F.lead(F.struct("seq", "key", "length")).over(line), "_found": F.lag("seq").over(line).isNotNull()})
    met = met.where("seq IS NOT NULL OR NOT _found")
    takes = F.col("depth").isNotNull() & F.col("seq").isNotNull() & F.col("_next").isNotNull() & F.col("_next.seq").isNull()
    held = {c: F.when(takes, F.col(f"_next.{c}")).otherwise(F.col(c)) for c in ("key", "length")}
    met = met.withColumns(held).withColumn("rank", F.when(F.col("seq").isNull(), -F.col("depth")))
    # A sequence has as many slots as pieces that fit it; a piece without one stands alone.
    group = Window.partitionBy("seq", F.when(F.col("seq").isNull(), F.col("key")))
    earlier = F.coalesce(F.sum("length").over(group.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), zero)
    after = F.col("used") + F.coalesce(F.sum("length").over(group), zero)
    return keep(met.select("seq", "slot", after.alias("used"), "key", "length", (F.col("used") + earlier).alias("offset"), "rank"), name)


def opened_rooms(lengths: Counter, each: int, capacity: int) -> Counter:
    """Rooms of new sequences that take ``each`` pieces in turn by falling length; counted by runs of equal ones."""
    rooms, held, used = Counter(), 0, 0
    for length in sorted(lengths, reverse=True):
        n = lengths[length]
        while n:
            many = min(n, each - held)
            held, used, n = held + many, used + many * length, n - many
            if held == each:
                rooms[capacity - used] += 1
                held = used = 0
                rooms[capacity - each * length] += n // each
                n %= each
    if held:
        rooms[capacity - used] += 1
    return +rooms


def best_fit(lengths: DataFrame, capacity: int) -> DataFrame:
    """``lengths(key, length)``, keys unique, not negative, and lengths 1 to ``capacity``, to ``key, seq, offset``.

    A piece of more than half the capacity opens a sequence, as no two of them
    fit together.  The classes of shorter pieces then follow, each in at most
    ``SWEEPS`` sweeps.  A gap that no remaining piece fits is closed.  An empty
    table gives no row.  Keep ``lengths`` before use: it is read once a class.
    """
    counts = Counter({r["length"]: r["n"] for r in lengths.groupBy("length").agg(F.count("*").alias("n")).collect()})  # a row a length
    bounds = sorted({int(capacity * c) for c in CLASSES} | {0}, reverse=True)
    alone = lengths.where(F.col("length") > bounds[0]).select("key", F.col("key").alias("seq"), F.lit(0).cast("long").alias("offset"), "length")
    done, gaps = [alone.drop("length")], alone.select("seq", F.col("length").alias("used"))
    rooms = Counter({capacity - length: n for length, n in counts.items() if length > bounds[0]})
    for number, (most, least) in enumerate(zip(bounds, bounds[1:])):
        here = Counter({length: n for length, n in counts.items() if least < length <= most})
        wanted = lengths.where((F.col("length") > least) & (F.col("length") <= most)).select("key", "length")
        for turn in range(SWEEPS):
            if not here:
                break
            gaps, rooms = gaps.where(F.col("used") <= capacity - min(counts)), Counter({r: n for r, n in rooms.items() if r >= min(counts)})
            swept = sweep(gaps, wanted, rooms, here, most, capacity, f"sweep-{number}-{turn}")
            done.append(swept.where("seq IS NOT NULL AND key IS NOT NULL").select("key", "seq", "offset"))
            gaps, wanted = swept.where("slot = 0").select("seq", "used"), swept.where("seq IS NULL").select("key", "length", "rank")
            was, here, rooms = here.total(), Counter(), Counter()
            stays = F.when(F.col("seq").isNull(), F.col("length")).alias("length")
            for row in swept.where("seq IS NULL OR slot = 0").groupBy(stays, F.when(F.col("seq").isNotNull(), F.col("used")).alias("used")).count().collect():  # two rows a size
                if row["used"] is None:
                    here[row["length"]] = row["count"]
                else:
                    rooms[capacity - row["used"]] = row["count"]
            if here.total() == was:
                break
        if here:
            # By rank, so many that always fit share a new sequence; its number is negative, so it is no piece's key.
            each = capacity // most
            seq = -(F.lit((number + 1) << 48) + F.floor(F.col("rank") / each))
            upto = F.sum("length").over(Window.partitionBy("seq").orderBy("rank"))
            opened = wanted.withColumn("seq", seq).withColumn("upto", upto)
            done.append(opened.select("key", "seq", (F.col("upto") - F.col("length")).alias("offset")))
            gaps = gaps.unionByName(opened.groupBy("seq").agg(F.sum("length").alias("used")))
            rooms += opened_rooms(here, each, capacity)
    return reduce(DataFrame.unionByName, done)


def cut(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """The pieces of ``docs(doc_id, text)``, written, with a ``key`` each."""
    rows = pieces(docs, tokenizer_path, end_id, capacity).withColumn("key", F.monotonically_increasing_id())
    return keep(rows, "pieces", compression="zstd")


def placed(cut_pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``key, sequence_id, offset`` of every piece; full ones fill a sequence of their own."""
    short = keep(cut_pieces.where(F.col("length") < capacity).select("key", "length"), "lengths")
    full = cut_pieces.where(F.col("length") == capacity).select("key", F.col("key").alias("seq"), F.lit(0).cast("long").alias("offset"))
    return best_fit(short, capacity).unionByName(full).withColumnRenamed("seq", "sequence_id")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """``docs(doc_id, text)`` to ``doc_id, piece, start, length, ids, sequence_id, offset``, a row per piece.

    Every document is its ids and ``end_id``; null and empty texts are the end id
    alone.  Rows that repeat a doc_id are packed each; null doc_ids too.  Full
    pieces fill a sequence of their own.  An empty table gives no row.  Other
    columns of ``docs`` are not read.
    """
    rows = cut(docs, tokenizer_path, end_id, capacity)
    return rows.join(placed(rows, capacity), "key").drop("key")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, doc_ids, starts`` of packed pieces: the training rows, at most ``capacity`` ids each."""
    row = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    rows = packed.groupBy("sequence_id").agg(row.alias("r"))
    ids = F.aggregate("r", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return rows.select("sequence_id", ids.alias("ids"), F.col("r.doc_id").alias("doc_ids"), F.col("r.offset").alias("starts"))
