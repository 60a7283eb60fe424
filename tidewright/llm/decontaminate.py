"""Benchmark passages in documents, by an embedding of edit distance and LSH.

Texts are words (runs of letters, digits and non-ASCII bytes; A-Z lower-cased).
The CGK embedding walks over a window: step t emits the word under the cursor
and moves on if bit t of that word's hash is set, so windows at a small edit
distance emit the same words at most steps.  Each repetition has bits of its own
and samples SAMPLED + 1 steps, the first one included.  It reads the window
cyclically from its own start word, so step 0 is one of the item's words and the
windows to look at are those with that word in that place.  Windows have the
item's size.  A window that agrees with its item in all sampled steps of any
repetition goes to the exact check: the smallest word edit distance between the
item and any stretch near the window, at most EDITS of the item's words.  Steps
are sampled in the first SPAN of a walk, where it is still aligned however long
the item is; the number of repetitions follows, for each size of items, from the
recall that is asked for at that distance.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .line_dedup import row_key
from .store import keep, slices
from .words import text_buffers, word_hashes

SAMPLED, EDITS, RECALL = 2, 0.2, 0.98
MOST_REPEATS = 64
SPAN = 40  # steps of a walk that are sampled
#: Sizes whose repetitions are simulated, each at int(edits * size) edits; an item goes by the largest that it reaches.
SIZES = (5, 10, 15, 20, 30, 40, 60)
EARLY = 6  # the first sampled step lies before this one, so that few windows are walked on
#: Items and words of items that are broadcast at once, some 100 MB; more take more passes over the documents.
ITEMS_A_BLOCK, WORDS_A_BLOCK = 20_000, 4_000_000
_WINDOWS = 1 << 18  # windows that a task walks at once, however many items share a start word
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 0x20


def plain_words(column) -> tuple[np.ndarray, np.ndarray]:
    data, at = text_buffers(column)
    return word_hashes(_PLAIN[data], at)


def edit_distance(item: np.ndarray, words: np.ndarray) -> int:
    """Smallest edit distance between ``item`` and any stretch of ``words``, a row of the table at a time."""
    place = np.arange(len(words) + 1)
    row = np.zeros(len(words) + 1, np.int64)
    for i, word in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        np.minimum(row[:-1] + (words != word), row[1:] + 1, out=new[1:])
        row = np.minimum.accumulate(new - place) + place  # insertions
    return int(row.min())


def edited(words: np.ndarray, share: float, rng: np.random.Generator) -> np.ndarray:
    """``words`` with int(share * size) random substitutions, insertions and deletions by new words."""
    out = list(words)
    for _ in range(int(share * len(words))):
        at, new = int(rng.integers(0, max(len(out), 1))), rng.integers(1, 1 << 63, dtype=np.uint64)
        out[at : at + 1] = [[new], [], [*out[at : at + 1], new]][int(rng.integers(0, 3))]
    return np.array(out, np.uint64)


@lru_cache
def repeats_for(recall: float, edits: float, size: int = 40, sampled: int = SAMPLED, trials: int = 1000) -> int:
    """Repetitions that find ``recall`` of simulated items of ``size`` words at the largest distance, ``edits`` of them.

    Longer items are found at least as often: their walks are sampled in the same
    SPAN.  A recall that MOST_REPEATS repetitions do not reach raises.
    """
    rng = np.random.default_rng(12)
    items = [rng.integers(1, 1 << 63, size, dtype=np.uint64) for _ in range(trials)]
    index = Index(list(range(trials)), items, MOST_REPEATS, sampled)
    first = np.full(trials, MOST_REPEATS)
    for k, item in enumerate(items):
        words = edited(item, edits, rng)
        low, high = np.searchsorted(index.word, words, "left"), np.searchsorted(index.word, words, "right")
        entry = np.concatenate([np.arange(i, j) for i, j in zip(low, high)] or [np.zeros(0, np.int64)])
        spot = np.repeat(np.arange(len(words)), high - low)
        hit = entry[index.walk(entry, spot, words, np.array([0, len(words)]))]
        first[k] = index.repeat[hit].min(initial=MOST_REPEATS)
    found = np.cumsum(np.bincount(first, minlength=MOST_REPEATS + 1))[:MOST_REPEATS] / trials
    enough = np.flatnonzero(found >= recall + (1 - recall) / 4)  # a margin for the simulation's own chance
    if not len(enough):
        raise ValueError(f"{MOST_REPEATS} repetitions find {found[-1]:.3f} of items of {size} words at {edits:.0%} edits, not {recall}")
    return int(enough[0]) + 1


def repeats_of(recall: float, edits: float):
    """The repetitions of an item by its number of words; below the smallest size, an edit is no longer within ``edits``."""

    def of(words: int) -> int:
        sizes = [s for s in SIZES if s <= words and int(edits * s)]
        return repeats_for(recall, edits, sizes[-1]) if sizes else 2

    return of


class Index:
    """Start words and sampled steps of all repetitions of a block of items."""

    def __init__(self, names: list[int], items: list[np.ndarray], repeats, sampled: int = SAMPLED, seed: int = 3):
        """``repeats``: the repetitions of every item, or a function of its number of words."""
        of = repeats if callable(repeats) else lambda _: repeats
        rng = np.random.default_rng(seed)
        self.names = names
        self.items = items
        self.sizes = np.array([len(w) for w in items], np.int64)
        entries = []
        known, held_by = np.unique(np.concatenate([np.unique(w) for w in items] or [np.zeros(0, np.uint64)]), return_counts=True)
        for k, words in enumerate(items):
            m = len(words)
            # The half of the words that fewest items hold start the repetitions: more words than EDITS can change.
            order = np.lexsort((rng.random(m), held_by[np.searchsorted(known, words)]))
            starts = order[: max(min(m, 2), (m + 1) // 2)]
            for r in range(of(m)):
                steps = np.sort([rng.integers(1, max(2, min(EARLY, m))), *rng.integers(1, max(2, min(2 * m - 2, SPAN)), sampled - 1)])
                entries.append((words[starts[r % len(starts)]], k, starts[r % len(starts)], r, steps))
        entries.sort(key=lambda e: int(e[0]))
        self.word = np.array([e[0] for e in entries], np.uint64)
        self.item, self.start, self.repeat = (np.array([e[c] for e in entries], np.int64) for c in (1, 2, 3))
        self.steps = np.array([e[4] for e in entries], np.int64).reshape(-1, sampled)
        flat, first = np.concatenate(self.items or [np.zeros(0, np.uint64)]), np.cumsum(self.sizes) - self.sizes
        every = np.arange(len(entries))
        self.expected = np.zeros((len(entries), sampled), np.uint64)
        self._walk(every, lambda alive, place: flat[first[self.item[alive]] + place], learn=True)
        self.mask = np.zeros(1 << 16, bool)
        self.mask[(self.word & np.uint64(0xFFFF)).astype(np.int64)] = True

    def _walk(self, entry: np.ndarray, words_at, learn: bool = False) -> np.ndarray:
        """Which windows emit the expected words at the sampled steps.

        ``words_at(positions into entry, places in the window)``.  Windows that
        fail are dropped on the way.  ``learn``: the words are those to expect.
        """
        alive = np.arange(len(entry))
        cursor = np.zeros(len(entry), np.int64)
        last = int(self.steps[entry].max()) if len(entry) else -1
        for t in range(last + 1):
            e = entry[alive]
            size, steps = self.sizes[self.item[e]], self.steps[e]
            word = np.where(cursor < size, words_at(alive, (self.start[e] + cursor) % size), np.uint64(0))
            good = np.ones(len(alive), bool)
            for s in range(steps.shape[1]):
                now = steps[:, s] == t
                if learn:
                    self.expected[e[now], s] = word[now]
                else:
                    good[now] &= word[now] == self.expected[e[now], s]
            bit = (word >> ((t * 11 + self.repeat[e] * 5) % 64).astype(np.uint64)) & np.uint64(1)
            cursor = np.minimum(cursor + bit.astype(np.int64), size)
            if not good.all():
                alive, cursor = alive[good], cursor[good]
            if not len(alive):
                break
        return alive

    def walk(self, entry: np.ndarray, spot: np.ndarray, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which (entry, position of its start word) agree in all sampled steps."""
        row = np.searchsorted(at, spot, "right") - 1
        begin = spot - self.start[entry]

        def words_at(alive, place):
            p = begin[alive] + place
            inside = (p >= at[row[alive]]) & (p < at[row[alive] + 1])
            return np.where(inside, words[np.where(inside, p, 0)], np.uint64(0))

        return self._walk(entry, words_at)

    def candidates(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """``row, item, window start`` of windows that agree with an item in a repetition."""
        spots = np.flatnonzero(self.mask[(words & np.uint64(0xFFFF)).astype(np.int64)])
        low, high = np.searchsorted(self.word, words[spots], "left"), np.searchsorted(self.word, words[spots], "right")
        upto = np.cumsum(high - low)
        found = [np.zeros((0, 3), np.int64)]
        # _WINDOWS at a time, also within the entries of one frequent start word
        for first in range(0, int(upto[-1]) if len(upto) else 0, _WINDOWS):
            number = np.arange(first, min(first + _WINDOWS, int(upto[-1])))
            place = np.searchsorted(upto, number, "right")
            entry = high[place] - (upto[place] - number)
            spot = spots[place]
            agree = self.walk(entry, spot, words, at)
            entry, spot = entry[agree], spot[agree]
            rows = np.searchsorted(at, spot, "right") - 1
            found.append(np.unique(np.stack([rows, self.item[entry], spot - self.start[entry]], axis=1), axis=0))
        return np.unique(np.concatenate(found), axis=0)

    def matches(self, words: np.ndarray, at: np.ndarray, edits: float = EDITS):
        """``row, name, edits, first word`` of every item that a row holds, the best window of each."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for row, k, begin in self.candidates(words, at):
            item, most = self.items[k], int(edits * self.sizes[k])
            low, high = max(begin - most, at[row]), min(begin + len(item) + most, at[row + 1])
            whole = words[max(begin, low) : begin + len(item)]
            if len(whole) == len(item) and begin >= low and (whole == item).all():
                distance = 0
            elif (row, k) in best and best[row, k][0] == 0:
                continue
            else:
                distance = edit_distance(item, words[low:high])
            if distance <= most:
                best[row, k] = min(best.get((row, k), (distance, begin)), (distance, begin))
        for (row, k), (distance, begin) in sorted(best.items()):
            yield int(row), self.names[k], int(distance), max(0, int(begin - at[row]))


def contaminations(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, recall: float = RECALL) -> DataFrame:
    """``doc_id, row, item_id, edits, first_word``: a row for each item that a row of ``docs`` holds.

    ``docs(doc_id, text)`` against ``benchmark(item_id, text)``: passages within
    ``edits`` of the item's words, at that distance ``recall`` of them, nearer ones
    more often, whole ones always.  ``row`` is the hash of the row's text, for
    joins where doc_ids repeat or are null.  Null and wordless texts hold nothing;
    null and wordless items are in nothing; of items that share an item_id each
    counts.  Rows that repeat are all reported.  No items or no rows give no rows.
    Other columns are not read.  The benchmark passes through the driver in
    blocks of bounded size, one after another: a block is broadcast to one scan,
    whose rows are written, and given back.  A recall that cannot be reached raises.
    """
    spark = docs.sparkSession
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("text"))
    texts = docs.select(F.col("doc_id").cast("long"), row_key().alias("row"), F.col("text").cast("string"))
    schema = "doc_id long, row long, item_id long, edits long, first_word long"
    out = spark.createDataFrame([], schema)
    block, size = [], 0
    for item in items.toLocalIterator():
        words, _ = plain_words(pa.array([item.text], pa.string()))
        if len(words):
            block.append((item.item_id, words))
            size += len(words)
        if len(block) == ITEMS_A_BLOCK or size >= WORDS_A_BLOCK:
            out, block, size = out.union(_in_block(texts, block, edits, recall, schema)), [], 0
    return out.union(_in_block(texts, block, edits, recall, schema)) if block else out


def _in_block(texts: DataFrame, block: list, edits: float, recall: float, schema: str) -> DataFrame:
    block.sort(key=lambda b: (b[0] is None, b[0] or 0, b[1].tolist()))
    index = Index([name for name, _ in block], [words for _, words in block], repeats_of(recall, edits))
    shared = texts.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        for batch in slices(batches):
            found = list(shared.value.matches(*plain_words(batch.column("text")), edits))
            if found:
                rows = pa.array([f[0] for f in found], pa.int64())
                columns = [batch.column("doc_id").take(rows), batch.column("row").take(rows)]
                columns += [pa.array([f[c] for f in found], pa.int64()) for c in (1, 2, 3)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "item_id", "edits", "first_word"])

    found = keep(texts.mapInArrow(run, schema), "found-items")
    shared.destroy()
    return found
