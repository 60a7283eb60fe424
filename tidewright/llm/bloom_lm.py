"""Bigram language model in log-frequency Bloom filters, one to a shard of contexts.

A count c is kept as its quantised logarithm q = 1 + floor(log_BASE(c)): the key
is inserted with each of 1..q, and a reader probes 1, 2, ... until a miss.  Keys
are made of 64-bit word hashes, so every training word and every training
bigram is in the model.  p(w | h) spends what a context's bigrams leave on the
word's own probability, the one of ``base_score``.

One job builds the filters from the training rows and writes them; another deals
the tokens to be scored to the shard of their context and answers from its
filter alone.  Beside the filter a shard keeps, for each of its contexts, the sum
of what the filter tells of its bigrams and their number, so the probabilities of a
context add up to one but for false members.  The first level takes more
probes the larger the vocabulary is, which keeps the false members of a context
under a hundredth of one over all words; the higher levels take PROBES.

A shard stands for SHARD_BYTES of text, so that bits per key and memory per task
stay the same at every size.  Contexts of more than HEAVY tokens are spread over
all shards by bigram; what the shards add to their sums is broadcast.  Frequent
words have a broadcast table (at most VOCABULARY entries), which only saves work:
tokens of all other words join the full counts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import arrow_rows, keep, slices
from .words import mix64, text_buffers, word_hashes

BASE, PROBES, BITS_A_KEY = 1.4, 5, 8
BLOCK_BITS = 15  # all bits of a key lie in one block of the filter
SPARE = 7  # false members that a context may have over all words: 2 ** -SPARE
VOCABULARY = 1 << 18
SHARD_BYTES = 8 << 20  # of text
CHUNK = 1 << 21  # tokens that a task sends to the shards at once
HEAVY = 1 << 20  # tokens of a context that is spread over all shards
END = np.uint64(0x656E64)  # the token that closes every text
HELD_OUT = 1
PIECE = 1 << 18  # tokens that a shard's filter answers at once
MOST_TASKS = 10_000  # shards beyond this number share tasks, one after another
_TASK_KEYS = 1 << 21  # keys that a task gathers before it hands them on
_FILTER, _ROWS, _TOKENS = 0, 1, 2  # what reaches a shard: its filter, a chunk's documents, a chunk's tokens
_DOC_BITS, _CHUNK_BITS = 22, 20  # of a row number: document in the chunk, chunk in the task


def in_training(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) != HELD_OUT


def tokens(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and the end token of every row, and the row offsets."""
    words, at = word_hashes(*text_buffers(column))
    n = len(at) - 1
    ends = at[1:] + np.arange(n)
    out = np.empty(len(words) + n, np.uint64)
    is_end = np.zeros(len(out), bool)
    is_end[ends] = True
    out[is_end], out[~is_end] = END, words
    return out, np.r_[0, ends + 1]


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], (np.add.reduceat(counts, first) if len(first) else counts)


def count_keys(docs: DataFrame, keys_of) -> DataFrame:
    """``key, n`` over all rows; ``keys_of(text column)`` gives an array of keys. Tasks sum before the shuffle."""

    def run(batches):
        held, size = [], 0

        def table():
            keys, n = _summed(held)
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n)], ["key", "n"])

        for batch in slices(batches):
            if batch.num_rows:
                held.append(np.unique(keys_of(batch.column("text")), return_counts=True))
                size += len(held[-1][0])
            if size > 2 * _TASK_KEYS:
                held = [_summed(held)]
                size = len(held[0][0])
                if size > _TASK_KEYS:
                    yield table()
                    held, size = [], 0
        if held:
            yield table()

    return docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


@dataclass
class Words:
    """The frequent words in ascending order of hash, with exact training counts."""

    hashes: np.ndarray
    counts: np.ndarray

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """1-based position of each hash; 0: none of these words."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        return np.where(self.hashes[at] == hashes, at + 1, 0) if len(self.hashes) else np.zeros(len(hashes), np.int64)


def frequent_words(counts: DataFrame, most: int = VOCABULARY) -> Words:
    """All words above the smallest count that at most ``most`` words reach."""
    level = F.floor(F.log2("n") * 8).alias("level")  # eighths of an octave: a bounded number of levels
    levels = counts.groupBy(level).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect()
    least, total = None, 0
    for row in sorted(levels, key=lambda r: -r["level"]):
        total += row["words"]
        if total > most:
            break
        least = row["least"]
    if least is None:
        return Words(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    got = counts.where(F.col("n") >= least).toArrow()
    hashes = got.column("key").to_numpy().astype(np.uint64)
    order = np.argsort(hashes)
    return Words(hashes[order], got.column("n").to_numpy()[order])


def _before(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The context of every token: the one before it; the end token opens each text."""
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[at[:-1]] = END
    return before


def _pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix64(left * np.uint64(0x9E3779B97F4A7C15) + right)


def _block(keys: np.ndarray, blocks: int) -> np.ndarray:
    return ((mix64(keys) >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def _spots(keys: np.ndarray, level: int, number: int) -> np.ndarray:
    """Four positions inside the key's block, for the probes 4 * number to 4 * number + 3 of a level."""
    mixed = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + np.uint64((level << 8) + number + 1))
    return np.stack([(mixed >> np.uint64(BLOCK_BITS * j)) & np.uint64((1 << BLOCK_BITS) - 1) for j in range(4)]).astype(np.int64)


def _levels(n: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(n) / math.log(BASE) + 1e-9).astype(np.int64)


def _value(level: int) -> float:
    """The mean of the counts of a level, 0 for none."""
    low, high = math.ceil(BASE ** (level - 1) - 1e-9), math.ceil(BASE**level - 1e-9) - 1
    return 0.0 if level < 1 else (low + high) / 2 if low <= high else BASE ** (level - 0.5)


_VALUES = np.array([_value(q) for q in range(202)])  # BASE ** 200 is past any count


def filter_of(keys: np.ndarray, n: np.ndarray, first: int = PROBES) -> tuple[np.ndarray, int]:
    """The filter over keys and their counts, n >= 1, half full; ``first`` probes for the first level."""
    levels = _levels(n)
    bits = len(keys) * math.ceil(first / math.log(2)) + (int(levels.sum()) - len(keys)) * BITS_A_KEY
    blocks = max(1, math.ceil(bits / (1 << BLOCK_BITS)))
    table = np.zeros((blocks, 1 << (BLOCK_BITS - 6)), np.uint64)
    block = _block(keys, blocks)
    order = np.argsort(block, kind="stable")
    keys, levels, block = keys[order], levels[order], block[order]
    for start in range(0, blocks, 256):  # a byte a bit, some blocks at a time
        stop = min(start + 256, blocks)
        i, j = np.searchsorted(block, [start, stop])
        mine, high, at = keys[i:j], levels[i:j], (block[i:j] - start) << BLOCK_BITS
        spread, level = np.zeros((stop - start) << BLOCK_BITS, np.uint8), 1
        while len(mine):
            probes = first if level == 1 else PROBES
            for k in range(0, probes, 4):
                for spot in _spots(mine, level, k // 4)[: probes - k]:
                    spread[at + spot] = 1
            more = high > level
            mine, high, at, level = mine[more], high[more], at[more], level + 1
        table[start:stop] = np.packbits(spread, bitorder="little").view(np.uint64).reshape(stop - start, -1)
    return table, first


def build_filter(stats: DataFrame) -> tuple[np.ndarray, int]:
    """The filter over a small table ``stats(key, n)``, n >= 1."""
    got = stats.select("key", "n").toArrow()
    return filter_of(got.column("key").to_numpy().astype(np.uint64), got.column("n").to_numpy())


def probe(table: np.ndarray, first: int, keys: np.ndarray) -> np.ndarray:
    """Quantised count of each key (0: absent), by probing level after level until a miss."""
    level, open_, block = np.zeros(len(keys), np.int64), np.arange(len(keys)), _block(keys, len(table))
    k = 1
    while len(open_) and k < len(_VALUES):
        probes = first if k == 1 else PROBES
        for j in range(0, probes, 4):  # a miss ends a key's probes
            hit = np.ones(len(open_), bool)
            for spot in _spots(keys[open_], k, j // 4)[: probes - j]:
                hit &= (table[block[open_], spot >> 6] >> (spot & 63).astype(np.uint64)) & np.uint64(1) == 1
            open_ = open_[hit]
        level[open_] = k
        k += 1
    return _VALUES[level]


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed byte planes, after their lengths."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays]
    raw = np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(planes)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(data: bytes, *types) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), np.uint8)
    at, out = 8 * len(types), []
    for n, t in zip(raw[:at].view(np.int64).tolist(), map(np.dtype, types)):
        out.append(np.ascontiguousarray(raw[at : at + n * t.itemsize].reshape(t.itemsize, n).T).view(t).reshape(n))
        at += n * t.itemsize
    return out


@dataclass
class Shard:
    """What answers for a shard of contexts: the filter of their bigrams, and each context's sum and number of bigrams."""

    table: np.ndarray
    first: int
    contexts: np.ndarray
    sums: np.ndarray  # of what the filter tells of their bigrams
    kinds: np.ndarray

    @staticmethod
    def of(left: np.ndarray, pairs: np.ndarray, n: np.ndarray, first: int) -> Shard:
        """From distinct bigrams, their contexts and their counts."""
        contexts, at = np.unique(left, return_inverse=True)
        table, _ = filter_of(pairs, n, first)
        sums = np.bincount(at, weights=probe(table, first, pairs), minlength=len(contexts))
        return Shard(table, first, contexts, sums, np.bincount(at, minlength=len(contexts)).astype(np.int64))

    def pack(self) -> bytes:
        return _pack(self.table.ravel(), self.contexts, self.sums, self.kinds)

    @staticmethod
    def unpack(body: bytes, first: int) -> Shard:
        table, *rest = _unpack(body, np.uint64, np.uint64, np.float64, np.int64)
        return Shard(table.reshape(-1, 1 << (BLOCK_BITS - 6)), first, *rest)

    def context(self, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum and kinds of each context; 0 for one without training bigrams."""
        at = Words(self.contexts, self.kinds).ids(left)
        return np.r_[0.0, self.sums][at], np.r_[0, self.kinds][at]


@dataclass
class Model:
    """What every task knows: the frequent words, the heavy contexts in order of hash, and the totals."""

    words: Words
    heavy: np.ndarray
    heavy_sums: np.ndarray  # of what the filters tell of their bigrams
    heavy_kinds: np.ndarray  # their distinct bigrams
    n: int  # training tokens
    v: int  # distinct training tokens
    shards: int

    def heavy_at(self, hashes: np.ndarray) -> np.ndarray:
        """1-based position among the heavy contexts; 0: none of these."""
        return Words(self.heavy, self.heavy).ids(hashes)

    @property
    def first(self) -> int:
        """Probes of the first level: false members of a context are 2 ** -SPARE or fewer over all words."""
        return SPARE + math.ceil(math.log2(self.v + 2))

    def alone(self, n):
        """Probability of a word of n training tokens, by itself."""
        return (n + 0.5) / (self.n + 0.5 * (self.v + 1))

    def deal(self, left: np.ndarray, right: np.ndarray, number: np.ndarray):
        """``shard, body``: bigrams and a number of each, dealt by context."""
        route = np.where(self.heavy_at(left) > 0, _pair_keys(left, right), mix64(left))
        shard = ((route >> np.uint64(32)) * np.uint64(self.shards)) >> np.uint64(32)
        order = np.argsort(shard.astype(np.uint16 if self.shards <= 1 << 16 else np.int64), kind="stable")
        shard, left, right, number = shard[order], left[order], right[order], number[order].astype(np.int32)
        ids = [self.words.ids(x).astype(np.int32) for x in (left, right)]
        edges = np.r_[0, np.flatnonzero(shard[1:] != shard[:-1]) + 1, len(shard)]
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
            others = [x[i:j][k[i:j] == 0] for x, k in zip((left, right), ids)]
            yield int(shard[i]), _pack(number[i:j], ids[0][i:j], ids[1][i:j], *others)

    def dealt(self, bodies: list[bytes]):
        """The numbers, contexts, words and positions of words among the frequent ones, and each body's length."""
        parts = [_unpack(b, np.int32, np.int32, np.int32, np.uint64, np.uint64) for b in bodies]
        number, left_id, right_id, left_other, right_other = (np.concatenate(x) for x in zip(*parts))
        hashes = np.r_[np.uint64(0), self.words.hashes]
        left, right = hashes[left_id], hashes[right_id]
        left[left_id == 0], right[right_id == 0] = left_other, right_other
        return number, left, right, right_id, np.array([len(p[0]) for p in parts])

    def build(self, bodies: list[bytes]):
        """The shard of some counted bigrams, and what they add to heavy contexts: position, sum, kinds."""
        count, left, right, _, _ = self.dealt(bodies)
        pairs, first, where = np.unique(_pair_keys(left, right), return_index=True, return_inverse=True)
        n = np.bincount(where, weights=count, minlength=len(pairs)).astype(np.int64)
        shard = Shard.of(left[first], pairs, n, self.first)
        place = self.heavy_at(shard.contexts)
        added = place[place > 0], shard.sums[place > 0], shard.kinds[place > 0]
        shard.contexts, shard.sums, shard.kinds = (x[place == 0] for x in (shard.contexts, shard.sums, shard.kinds))
        return shard, added

    def smoothed(self, shard: Shard, left: np.ndarray, right: np.ndarray):
        """``pair, back, seen`` of bigrams: p(w | h) = (pair + back * alone(w)) / (seen + back)."""
        seen, kinds = shard.context(left)
        place = self.heavy_at(left)
        seen = np.where(place > 0, np.r_[0.0, self.heavy_sums][place], seen)
        kinds = np.where(place > 0, np.r_[0, self.heavy_kinds][place], kinds)
        return np.minimum(probe(shard.table, shard.first, _pair_keys(left, right)), seen), kinds + 1.0, seen

    def answers(self, shard: Shard, chunks: np.ndarray, bodies: list[bytes]):
        """Scores tokens from their shard's filter: ``(chunk, body)`` of sums, and the columns of other words' tokens."""
        doc, left, right, right_id, sizes = self.dealt(bodies)
        _, first, where = np.unique(_pair_keys(left, right), return_index=True, return_inverse=True)
        c, back, seen = (x[where] for x in self.smoothed(shard, left[first], right[first]))
        known = right_id > 0
        alone = self.alone(np.r_[0, self.words.counts])[right_id]
        term = np.where(known, np.log10((c + back * alone) / (seen + back)), 0.0)
        starts = np.cumsum(sizes) - sizes
        edges = np.union1d(np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]), starts)
        total, rows, cut = np.add.reduceat(term, edges).astype(np.float32), doc[edges], np.searchsorted(edges, np.r_[starts, len(doc)])
        sent = [(k, _pack(rows[i:j], total[i:j])) for k, i, j in zip(chunks.tolist(), cut[:-1], cut[1:])]
        at = np.flatnonzero(~known)
        row = (np.repeat(chunks, sizes)[at] << _DOC_BITS) | doc[at]
        return sent, (row, right[at].astype(np.int64), *(x[at].astype(np.float32) for x in (c, back, seen)))


@dataclass
class Trained:
    """A model with its written tables: exact word counts ``key, n``, and a filter a shard (``shard, body``)."""

    model: Model
    counts: DataFrame
    filters: DataFrame


def _to_shards(sent: DataFrame, shards: int) -> DataFrame:
    """Rows to the task of their shard, in order of shard and kind."""
    tasks = min(shards, MOST_TASKS)
    return sent.repartitionById(tasks, F.pmod(F.col("shard"), F.lit(tasks))).sortWithinPartitions("shard", "kind")


def _bundles(batches, size: int):
    """Token arrays of Arrow batches, joined to ``size`` tokens or more: ``rows, hashes, offsets``."""
    held, total = [], 0

    def joined():
        at = np.r_[0, np.cumsum(np.concatenate([np.diff(a) for _, _, a in held]))]
        return pa.Table.from_batches([b for b, _, _ in held]), np.concatenate([h for _, h, _ in held]), at

    for batch in slices(batches):
        if batch.num_rows:
            hashes, at = tokens(batch.column("text"))
            held.append((batch.drop_columns(["text"]), hashes, at))
            total += len(hashes)
        if total >= size:
            yield joined()
            held, total = [], 0
    if held:
        yield joined()


def build_filters(rows: DataFrame, model: Model) -> DataFrame:
    """``shard, body`` per shard with training text, and ``place, value, kinds``: what a shard adds to a heavy context."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    size = CHUNK

    def count(batches):
        for _, hashes, at in _bundles(batches, size):
            left = _before(hashes, at)
            _, first, n = np.unique(_pair_keys(left, hashes), return_index=True, return_counts=True)
            order = np.argsort(left[first])
            first, n = first[order], n[order]
            sent = list(shared.value.deal(left[first], hashes[first], n))
            yield pa.RecordBatch.from_arrays(
                [pa.array([s for s, _ in sent], pa.int32()), pa.array([_TOKENS] * len(sent), pa.int32()), pa.array([b for _, b in sent], pa.binary())],
                ["shard", "kind", "body"],
            )

    def built(shard, bodies):
        mine, (place, value, kinds) = shared.value.build(bodies)
        n = len(place)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([shard] * (n + 1), pa.int32()),
                pa.array([mine.pack()] + [None] * n, pa.binary()),
                pa.array([None, *place.tolist()], pa.int64()),
                pa.array([None, *value.tolist()], pa.float64()),
                pa.array([None, *kinds.tolist()], pa.int64()),
            ],
            ["shard", "body", "place", "value", "kinds"],
        )

    def build(batches):
        now, bodies = None, []
        for batch in batches:
            for shard, body in zip(batch.column("shard").to_pylist(), batch.column("body").to_pylist()):
                if shard != now and bodies:
                    yield built(now, bodies)
                    bodies = []
                now = shard
                bodies.append(body)
        if bodies:
            yield built(now, bodies)

    sent = rows.select("text").mapInArrow(count, "shard int, kind int, body binary")
    return _to_shards(sent, model.shards).mapInArrow(build, "shard int, body binary, place long, value double, kinds long")


def train(docs: DataFrame) -> Trained:
    """The model of all training rows of ``docs(doc_id, text)``."""
    rows = docs.where(in_training(F.col("doc_id"))).select(F.col("text").cast("string").alias("text"))
    with arrow_rows(docs.sparkSession):
        counts = keep(count_keys(rows, lambda column: tokens(column)[0]), "word-counts")
        total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
        size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")) + 1)).first()[0] or 1
        heavy = np.sort(counts.where(F.col("n") > HEAVY).select("key").toArrow().column("key").to_numpy().astype(np.uint64))
        none = np.zeros(len(heavy))
        model = Model(frequent_words(counts), heavy, none, none.astype(np.int64), int(total["n"]), int(total["v"]), math.ceil(size / SHARD_BYTES))
        filters = keep(build_filters(rows, model), "filters")
    added = filters.where("place IS NOT NULL").groupBy("place").agg(F.sum("value").alias("value"), F.sum("kinds").alias("kinds"))
    for r in added.collect() if len(heavy) else []:
        model.heavy_sums[r["place"] - 1], model.heavy_kinds[r["place"] - 1] = r["value"], r["kinds"]
    return Trained(model, counts, filters.where("body IS NOT NULL").select("shard", "body"))


_SENT = "shard int, chunk long, kind int, body binary"
_SERVED = "chunk long, kind int, body binary, row long, key long, pair float, back float, seen float"
_ROW_TYPES = (np.int64, np.uint8, np.int32, np.int32, np.float64)  # doc_id, is it null, tokens, known ones, base


def score_documents(docs: DataFrame, repeats: bool = False) -> DataFrame:
    """``docs(doc_id, text)`` to ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    One row per input row.  Null and empty texts are the end token alone.  A
    null doc_id is neither in training nor held out (null).  Without training
    rows every token is unknown.  ``base_score`` is exact: frequent words are
    looked up in the broadcast table, all others join the full counts.  Other
    columns are not read.  Rows are numbered by task, so an input is written first
    unless it ``repeats``: gives the same partitions when a lost task reads it
    again, as the scan of a table does.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs if repeats else keep(docs, "texts")
    return score(docs, train(docs))


def score(docs: DataFrame, trained: Trained) -> DataFrame:
    """Scores of ``docs(doc_id long, text string)``, whose partitions repeat, by a trained model; columns as above."""
    spark, model, counts = docs.sparkSession, trained.model, trained.counts
    shared = spark.sparkContext.broadcast(model)
    size, piece = CHUNK, PIECE

    def send(batches):
        m, task = shared.value, TaskContext.get().partitionId()
        base = np.log10(m.alone(np.r_[0, m.words.counts]))
        for number, (of, hashes, at) in enumerate(_bundles(batches, size)):
            ids = m.words.ids(hashes)
            add = lambda x, t: np.add.reduceat(x, at[:-1], dtype=t)  # noqa: B023, E731  every row has its end token
            doc_id = of.column("doc_id")
            body = _pack(
                doc_id.fill_null(0).to_numpy(),
                doc_id.is_null().to_numpy().astype(np.uint8),
                np.diff(at).astype(np.int32),
                add(ids > 0, np.int32),
                add(np.where(ids > 0, base[ids], 0.0), np.float64),
            )
            del ids
            name, doc = (task << _CHUNK_BITS) | number, np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
            sent = [(name % m.shards, _ROWS, body)]
            sent += [(s, _TOKENS, b) for s, b in m.deal(_before(hashes, at), hashes, doc)]
            columns = [
                pa.array([s for s, _, _ in sent], pa.int32()),
                pa.array([name] * len(sent), pa.int64()),
                pa.array([k for _, k, _ in sent], pa.int32()),
                pa.array([b for _, _, b in sent], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "chunk", "kind", "body"])

    def serve(batches):
        m = shared.value
        types = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.float32(), pa.float32(), pa.float32()]
        names = ["chunk", "kind", "body", "row", "key", "pair", "back", "seen"]
        nothing = np.zeros(0, np.uint64)

        def out(n, *columns):
            arrays = [pa.nulls(n, t) if c is None else pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names)

        def scored(mine, held):
            sent, other = m.answers(mine, np.array([k for k, _ in held], np.int64), [b for _, b in held])
            yield out(len(sent), [k for k, _ in sent], [_TOKENS] * len(sent), [b for _, b in sent], *[None] * 5)
            yield out(len(other[0]), None, None, None, *other)

        now, mine, held, total = None, None, [], 0
        for batch in batches:
            for shard, chunk, kind, body in zip(*(batch.column(c).to_pylist() for c in ("shard", "chunk", "kind", "body"))):
                if held and (shard != now or total >= piece):
                    yield from scored(mine, held)
                    held, total = [], 0
                if shard != now:
                    now, mine = shard, Shard.of(nothing, nothing, np.zeros(0, np.int64), m.first)
                if kind == _FILTER:
                    mine = Shard.unpack(body, m.first)
                elif kind == _ROWS:
                    yield out(1, [chunk], [kind], [body], *[None] * 5)
                else:
                    held.append((chunk, body))
                    total += int.from_bytes(body[:8], "little") // 12  # bytes of a token before compression
        if held:
            yield from scored(mine, held)

    def gather(batches):
        rows, scores = {}, {}
        for batch in batches:
            for chunk, kind, body in zip(*(batch.column(c).to_pylist() for c in ("chunk", "kind", "body"))):
                if kind == _ROWS:
                    rows[chunk] = body
                    continue
                doc, total = _unpack(body, np.int32, np.float32)
                have = scores.get(chunk, np.zeros(0))
                if len(have) <= doc[-1]:
                    have = np.r_[have, np.zeros(max(int(doc[-1]) + 1 - len(have), len(have)))]
                have[doc] += total
                scores[chunk] = have
        for chunk, body in rows.items():
            doc_id, null, n, known, base = _unpack(body, *_ROW_TYPES)
            columns = [
                pa.array((chunk << _DOC_BITS) | np.arange(len(n))),
                pa.array(doc_id, mask=null.astype(bool)),
                pa.array(n.astype(np.int64)),
                pa.array(known.astype(np.int64)),
                pa.array(base),
                pa.array(scores[chunk][: len(n)]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_tokens", "known", "base", "first"])

    filters = trained.filters.select("shard", F.lit(0).cast("long").alias("chunk"), F.lit(_FILTER).alias("kind"), "body")
    sent = _to_shards(docs.select("doc_id", "text").mapInArrow(send, _SENT).unionByName(filters), model.shards)
    with arrow_rows(spark):
        served = keep(sent.mapInArrow(serve, _SERVED), "served")
    rows = served.where("body IS NOT NULL").select("chunk", "kind", "body").repartition("chunk")
    rows = rows.mapInArrow(gather, "row long, doc_id long, n_tokens long, known long, base double, first double")
    n, v = float(model.n), float(model.v)
    alone = (F.coalesce("n", F.lit(0)) + 0.5) / F.lit(n + 0.5 * (v + 1))
    found = served.where("body IS NULL").select("row", "key", "pair", "back", "seen").join(counts, "key", "left")
    found = found.withColumn("alone", alone).groupBy("row").agg(
        F.count("n").alias("other_known"),
        F.sum(F.log10("alone")).alias("other_base"),
        F.sum(F.log10((F.col("pair") + F.col("back") * F.col("alone")) / (F.col("seen") + F.col("back")))).alias("other"),
    )
    rows = rows.join(found, "row", "left")
    return rows.select(
        "doc_id",
        (~in_training(F.col("doc_id"))).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("other_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("other_base", F.lit(0.0))).alias("base_score"),
        (F.col("first") + F.coalesce("other", F.lit(0.0))).alias("score"),
    )
