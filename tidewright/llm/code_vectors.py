"""Compression of vectors to one code per part, by active-entry Lloyd rounds.

Components become integers, so that all distances and means are exact.  Each
part position has a codebook of at most ``entries`` rows.  A round knows which
entries the last update moved: a part whose assigned entry stayed where it was
compares only the moved entries with its stored distance (every other entry lost
to it before and is still no nearer), and any other part looks at all entries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Scratch, keep

ROWS = 2048  # vectors compared at once in a worker
STATE = "vec_id long, label string, ints array<int>, code array<int>, error array<long>"
MOST = 1 << 27  # an integer component is below this, so that a part's distance fits 64 bits


def squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``x`` to those of ``book``, in integers."""
    total = np.zeros((len(x), len(book)), np.int64)
    for j in range(x.shape[1]):
        gap = x[:, j, None] - book[None, :, j]
        total += gap * gap
    return total


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index (the lowest of equals) and squared distance of each row's nearest entry."""
    far = squared(x, book)
    at = far.argmin(1)
    return at, far[np.arange(len(x)), at]


def reassign(x: np.ndarray, book: np.ndarray, moved: np.ndarray, code: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """``code, error`` against ``book``, whose entries ``moved`` changed since; and the number of distances taken."""
    code, error = code.copy(), error.copy()
    stays = ~moved[code]
    again = np.flatnonzero(~stays)
    if len(again):
        code[again], error[again] = nearest(x[again], book)
    active, still = np.flatnonzero(moved), np.flatnonzero(stays)
    if len(active) and len(still):
        at, far = nearest(x[still], book[active])
        at = active[at]
        wins = (far < error[still]) | ((far == error[still]) & (at < code[still]))
        code[still[wins]], error[still[wins]] = at[wins], far[wins]
    return code, error, len(again) * len(book) + len(still) * len(active)


def _wide(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, max(1, rows.shape[1]), dtype=np.int32)[: len(rows) + 1]), pa.array(rows.ravel(), kind))


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    ints = np.floor(scale * vectors.astype(np.float64))
    if ints.size and np.abs(ints).max() >= MOST:
        raise ValueError(f"a component times {scale} is {MOST} or more: its distances would not fit 64 bits")
    return ints.astype(np.int64)


def _batches(batches):
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def _state(batch: pa.RecordBatch, ints: np.ndarray, code: np.ndarray, error: np.ndarray) -> pa.RecordBatch:
    columns = [batch.column("vec_id"), batch.column("label"), _lists(ints, pa.int32()), _lists(code, pa.int32()), _lists(error, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "ints", "code", "error"])


def assign(vectors: DataFrame, books: list[np.ndarray], scale: int) -> DataFrame:
    """The first assignment of ``vectors(vec_id, label, embedding)``: every part looks at every entry."""
    parts, step = len(books), books[0].shape[1]

    def run(batches):
        for batch in _batches(batches):
            lengths = batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
            if (lengths != parts * step).any():
                raise ValueError("vectors must have one length")
            ints = integers(_wide(batch.column("embedding"), parts * step), scale)
            best = [nearest(ints[:, p * step : (p + 1) * step], books[p]) for p in range(parts)]
            yield _state(batch, ints, np.stack([c for c, _ in best], 1), np.stack([e for _, e in best], 1))

    return vectors.mapInArrow(run, STATE)


def assign_again(state: DataFrame, books: list[np.ndarray], moved: list[np.ndarray]) -> DataFrame:
    """The next assignment, from the stored one and the entries that moved."""
    parts, step = len(books), books[0].shape[1]

    def run(batches):
        for batch in _batches(batches):
            ints = _wide(batch.column("ints"), parts * step).astype(np.int64)
            code, error = _wide(batch.column("code"), parts).astype(np.int64), _wide(batch.column("error"), parts)
            best = [reassign(ints[:, p * step : (p + 1) * step], books[p], moved[p], code[:, p], error[:, p]) for p in range(parts)]
            yield _state(batch, ints, np.stack([b[0] for b in best], 1), np.stack([b[1] for b in best], 1))

    return state.mapInArrow(run, STATE)


def update(state: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Each used entry becomes the floor of the mean of its parts; the others stay.

    A task adds up its own rows first: at most one row for each component of the
    codebooks leaves it, and as many reach the driver, however many vectors there are.
    """
    parts, step = len(books), books[0].shape[1]

    def run(batches):
        n = np.zeros((parts, len(books[0])), np.int64)
        sums = np.zeros((parts, len(books[0]), step), np.int64)
        for batch in batches:
            ints = _wide(batch.column("ints"), parts * step).astype(np.int64)
            code = _wide(batch.column("code"), parts)
            for p in range(parts):
                n[p] += np.bincount(code[:, p], minlength=n.shape[1])
                np.add.at(sums[p], code[:, p], ints[:, p * step : (p + 1) * step])
        part, entry = np.nonzero(n)
        for at in range(step):
            columns = [pa.array(c, pa.int64()) for c in (part, entry, np.full(len(part), at), n[part, entry], sums[part, entry, at])]
            yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "at", "n", "s"])

    totals = state.select("ints", "code").mapInArrow(run, "part long, entry long, at long, n long, s long")
    totals = totals.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    new = [b.copy() for b in books]
    for row in totals.collect():  # a row per component of the codebooks
        new[row["part"]][row["entry"], row["at"]] = int(row["s"]) // row["n"]
    return new


def finite(vector: Column) -> Column:
    """Whether a vector has components, and finite ones only."""
    component = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return (F.coalesce(F.size(vector), F.lit(0)) > 0) & F.coalesce(F.forall(vector, component), F.lit(False))


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, list[np.ndarray]]:
    """``vectors(vec_id, label, embedding)`` to ``vec_id, label, code, error`` and the final codebooks.

    ``code`` has an index for each part and ``error`` is the sum of the parts'
    squared distances.  Rows whose vector is null or empty, or holds a null or
    non-finite component, go.  A codebook begins as the parts of the ``entries`` smallest
    vec_ids (null last; of rows that repeat one, those with the smaller vector
    first), so with fewer rows it is shorter, and with none it is empty and so is
    the result.  Rows that repeat a vec_id are all returned.  All vectors must
    have one length that ``parts`` divides and components below 2**27 / scale;
    others raise.  Other columns of ``vectors`` are not read.
    """
    held = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>")).where(finite(F.col("embedding")))
    first = held.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()  # a codebook's rows
    result = "vec_id long, label string, code array<int>, error long"
    if not first:
        return vectors.sparkSession.createDataFrame([], result), [np.zeros((0, 0), np.int64)] * parts
    width = len(first[0]["embedding"])
    if width % parts:
        raise ValueError(f"vectors must have a length that {parts} divides")
    books = np.split(integers(np.array([r["embedding"] for r in first]).reshape(len(first), width), scale), parts, 1)
    before = Scratch(vectors.sparkSession)
    state = before.keep(assign(held, books, scale), "codes")
    for k in range(rounds):
        new = update(state, books)
        moved = [(a != b).any(1) for a, b in zip(books, new)]
        books, last = new, before
        next_state = assign_again(state, books, moved)
        if k + 1 < rounds:
            before = Scratch(vectors.sparkSession)
            state = before.keep(next_state, "codes")
        else:
            state = keep(next_state.select("vec_id", "label", "code", F.aggregate("error", F.lit(0).cast("long"), lambda a, x: a + x).alias("error")), "codes")
        last.clear()  # its rows are in the table after it
    return state, books
