"""MinHash near-duplicate links through an inverted table of signature coordinates.

Method.  A document's set holds its distinct five-word shingles.  Documents with
one and the same set form a class, and only one representative goes on.  Each
representative posts its id under (coordinate, value) pairs of its signature.
Two sets above the similarity agree in at least ``match`` of ``coords``
coordinates (but for a chance of 4.4e-5 right at the threshold), so every
such pair shares one of any ``coords - match + 1`` pairs of a common order:
only that prefix, rarest pairs first, is posted, and the frequent pairs are
skipped.  The order comes from a count table of fixed size.

No list of postings is expanded into pairs.  Each list names its smallest
member, the hub; lists with one hub merge into one group.  First every member is
compared with its hub (linear work) and the links give components.  What is still
split over components merges its posting lists: a member takes the lists of its
coordinate-value pairs among the others of its group from the shortest on,
counts collisions in the first ``coords - match + 1`` of them, and skips the rest
for every candidate that can no longer reach ``match``.  A task has the lists of
``RUN`` x ``RUN`` members of a group, so that large groups are shared by many
tasks; members of one component are not merged.  Only candidates above the
threshold read their full sets to confirm; links alone leave a task, so no pair
is lost and none is emitted unverified.

Steps that are read more than once are kept, so that no job's plan has more than
about 120 operators: the driver plans a job anew whenever one of its stages ends.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .store import arrow_rows, keep, look_up, slices
from .words import mix64, shingles, text_buffers, word_hashes

COORDS, MATCH, SIMILARITY = 64, 34, 75
CELLS = 1 << 20  # of the count table: 4 MB on the driver and in a broadcast, whatever the input
BITS = 1 << 22  # of the filter of wanted documents, in the same way
RUN = 256  # members of a group whose lists one task merges with those of RUN others
RUN_BYTES = 16 << 20  # of the sets of these members, as a mean; fewer members where sets are larger
_WIDE = 1 << 19  # postings that are merged at once
_CHUNK_ROWS = 128

SKETCH = "doc_id long, n_shingles long, digest binary, signature binary"


def multipliers(coords: int) -> np.ndarray:
    odd = mix64(np.arange(1, coords + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return odd | np.uint64(1)


def signature(hashes: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Minimum of each random order, top 32 bits; long sets go in pieces."""
    low = np.full(len(by), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 8192):
        np.minimum(low, (by[:, None] * hashes[None, k : k + 8192]).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def _digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def document_sets(column, size: int):
    """The sorted distinct shingle hashes of each row of a string column."""
    for k in range(0, len(column), _CHUNK_ROWS):
        words, at = word_hashes(*text_buffers(column.slice(k, _CHUNK_ROWS)))
        for i in range(len(at) - 1):
            yield np.unique(shingles(words[at[i] : at[i + 1]], size))


def sketch(docs: DataFrame, size: int = 5, coords: int = COORDS) -> DataFrame:
    """Per row: set size, 128-bit digest of the set, signature (empty set: null)."""

    def run(batches):
        by = multipliers(coords)
        for batch in slices(batches):
            n, digest, sig = [], [], []
            for s in document_sets(batch.column("text"), size):
                n.append(len(s))
                digest.append(_digest(s))
                sig.append(signature(s, by).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())],
                ["doc_id", "n_shingles", "digest", "signature"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SKETCH)


def _cells(tokens: np.ndarray) -> np.ndarray:
    return (mix64(tokens) % np.uint64(CELLS)).astype(np.int64)


def _tokens(column, coords: int) -> np.ndarray:
    values = np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, coords)
    return (np.arange(coords, dtype=np.uint64)[None, :] << np.uint64(32)) | values


def _count_table(reps: DataFrame, coords: int) -> np.ndarray:
    """How often each cell is posted; the table has CELLS numbers at any input size."""

    def cells(batches):
        for batch in batches:
            if batch.num_rows:
                cell, n = np.unique(_cells(_tokens(batch.column("signature"), coords)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], ["cell", "n"])

    counts = reps.select("signature").mapInArrow(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    table = np.zeros(CELLS, np.int64)
    got = counts.toArrow()
    table[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return table


def postings(reps: DataFrame, coords: int, match: int) -> DataFrame:
    """``rep, n, token`` for the rarest ``coords - match + 1`` coordinate-value pairs; ``n`` is the set's size."""
    table = reps.sparkSession.sparkContext.broadcast(_count_table(reps, coords).astype(np.uint32))

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            tokens = _tokens(batch.column("signature"), coords)
            often = table.value[_cells(tokens)]
            order = np.lexsort((tokens, often), axis=1)[:, : coords - match + 1]
            tokens, often = np.take_along_axis(tokens, order, 1), np.take_along_axis(often, order, 1)
            shared = often > 1  # a cell that is posted once holds a pair that nobody shares
            rep, n = (np.repeat(batch.column(c).to_numpy(), shared.sum(axis=1)) for c in ("rep", "n"))
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(n), pa.array(tokens[shared].astype(np.int64))], ["rep", "n", "token"])

    return reps.select("rep", "n", "signature").mapInArrow(run, "rep long, n long, token long")


def _similar(a: np.ndarray, b: np.ndarray, similarity: int) -> bool:
    if 100 * min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= similarity * (len(a) + len(b) - both)


def _groups(batches, keys: list[str]):
    """Tables of the rows with equal keys, from batches that are sorted by them."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        rest = table if rest is None else pa.concat_tables([rest, table])
        if rest.num_rows == 0:
            continue
        codes = np.stack([rest.column(k).to_numpy() for k in keys])
        cuts = np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(axis=0)) + 1
        for i, j in zip(np.r_[0, cuts[:-1]], cuts):
            yield rest.slice(i, j - i)
        rest = rest.slice(cuts[-1] if len(cuts) else 0)
    if rest is not None and rest.num_rows:
        yield rest


def _links_table(found: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _signatures(column, coords: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, coords)


def _alike_hubs(members: DataFrame, reps: DataFrame, coords: int, match: int) -> DataFrame:
    """The ``hub, rep`` whose signatures collide in at least ``match`` coordinates."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (_signatures(batch.column(c), coords) for c in ("signature", "hub_signature"))
                near = pa.array((a == b).sum(axis=1) >= match)
                yield batch.select(["hub", "rep"]).filter(near)

    of_hub = reps.select(F.col("rep").alias("hub"), F.col("signature").alias("hub_signature"))
    hubs = keep(members.groupBy("hub").agg(F.count("*").alias("members")).join(of_hub, "hub"), "hubs")
    both = look_up(members.select("hub", "rep").join(reps.select("rep", "signature"), "rep"), hubs, "hub", "members", F.col("rep"))
    return both.mapInArrow(run, "hub long, rep long")


def _hub_links(members: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Verified links between each hub and its members; a large group is salted over runs."""
    blocks = members.groupBy("hub").agg(F.count("*").alias("members"), F.ceil(F.count("*") / RUN).cast("long").alias("n"))
    blocks = keep(blocks, "hub-blocks")
    salted = look_up(members, blocks, "hub", "members", F.col("rep")).select(
        "hub", F.pmod(F.xxhash64("rep"), F.col("n")).alias("block"), "rep", F.lit(False).alias("is_hub")
    )
    hubs = blocks.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("block"))
    rows = salted.unionByName(hubs.select("hub", "block", F.col("hub").alias("rep"), F.lit(True).alias("is_hub")))

    def run(batches):
        """The hub's row comes first in its block; then one member's set at a time is looked at, where it lies."""
        at = hub = whole = None
        for batch in batches:
            found = []
            keys = zip(*(batch.column(c).to_pylist() for c in ("hub", "block")))
            for i, (key, rep) in enumerate(zip(keys, batch.column("rep").to_pylist())):
                mine = np.frombuffer(batch.column("hashes")[i].as_buffer(), np.uint64)
                if key != at:
                    at, hub, whole = key, rep, mine.copy()
                elif _similar(whole, mine, similarity):
                    found.append((hub, rep))
            if found:
                yield _links_table(found)

    ready = rows.join(sets, "rep").repartition("hub", "block").sortWithinPartitions("hub", "block", F.desc("is_hub"))
    return ready.select("hub", "block", "rep", "hashes").mapInArrow(run, "a long, b long")


def _run_rows(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``hub, left, right, rep, n, component, own``: each group dealt over pairs of runs of members.

    ``members`` has the hub itself as a member.  The hub's component is the main
    part of its group; pairs inside it are connected already and take no work.
    """
    known = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "hub", "rep", "n", F.coalesce("component", "rep").alias("component")
    )
    of_hub = members.groupBy("hub").agg(F.count("*").alias("members"))
    of_hub = of_hub.join(labels.select(F.col("node").alias("hub"), F.col("component").alias("hub_component")), "hub", "left")
    known = look_up(known, keep(of_hub, "hub-labels"), "hub", "members", F.col("rep")).select(
        "hub", "rep", "n", "component", (F.col("component") == F.coalesce("hub_component", "hub")).alias("main")
    )
    known = keep(known, "run-members")
    runs = lambda main: F.greatest(
        F.ceil(F.count_if(main) / RUN), F.ceil(F.sum(F.when(main, F.col("n")).otherwise(0)) * 8 / RUN_BYTES)
    ).cast("long")
    size = known.groupBy("hub").agg(F.count("*").alias("members"), runs(F.col("main")).alias("mains"), runs(~F.col("main")).alias("others"))
    spread = look_up(known, keep(size, "run-sizes"), "hub", "members", F.col("rep")).where("others > 0").select(
        "*", F.pmod(F.xxhash64("rep"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("others"))).alias("own")
    )
    zero = F.lit(0).cast("long")
    # Others meet others in runs (lower, upper) and the main part in runs (own, -1 - main run).
    with_others = F.transform(
        F.sequence(zero, F.col("others") - 1),
        lambda j: F.struct(F.least("own", j).alias("left"), F.greatest("own", j).alias("right")),
    )
    with_main = F.transform(
        F.sequence(zero, F.col("mains") - 1), lambda j: F.struct(F.col("own").alias("left"), (-1 - j).alias("right"))
    )
    of_main = F.transform(
        F.sequence(zero, F.col("others") - 1), lambda j: F.struct(j.alias("left"), (-1 - F.col("own")).alias("right"))
    )
    meets = F.when(F.col("main"), of_main).otherwise(F.concat(with_others, with_main))
    rows = spread.select("hub", "rep", "n", "component", "main", "own", F.explode(meets).alias("at"))
    side = F.when(F.col("main"), -1 - F.col("own")).otherwise(F.col("own"))
    return rows.select("hub", "at.left", "at.right", "rep", "n", "component", side.alias("own"))


def merge_lists(left: np.ndarray, right: np.ndarray, match: int, apart=None) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of two signature tables that collide in at least ``match`` coordinates.

    Posting lists of ``right``: per coordinate, its rows in order of value.  Row i
    merges its ``coords - match + 1`` shortest lists, which hold every j that can
    reach ``match``; the longer lists are only looked at for candidates with
    enough collisions so far.  ``apart(i, j)``: which candidates matter.
    """
    coords = left.shape[1]
    order = np.argsort(right, axis=0, kind="stable")
    low, high = np.empty((2, *left.shape), np.int64)
    for c in range(coords):
        values = right[order[:, c], c]
        low[:, c], high[:, c] = np.searchsorted(values, left[:, c], "left"), np.searchsorted(values, left[:, c], "right")
    length = high - low
    by_length = np.argsort(length, axis=1, kind="stable")
    prefix = by_length[:, : coords - match + 1]
    work = np.cumsum(np.take_along_axis(length, prefix, 1).sum(axis=1))
    found, begin = [np.zeros((2, 0), np.int64)], 0
    while begin < len(left):  # as many rows at once as _WIDE postings allow
        before = work[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(work, before + _WIDE, "right")))
        mine = prefix[begin:end].ravel()
        row = np.repeat(np.arange(begin, end), prefix.shape[1])
        many = length[row, mine]
        at = np.repeat(high[row, mine] - np.cumsum(many), many) + np.arange(many.sum())
        pair, n = np.unique(np.repeat(row, many) * len(right) + order[at, np.repeat(mine, many)], return_counts=True)
        i, j = np.divmod(pair, len(right))
        if apart is not None:
            keep_ = apart(i, j)
            i, j, n = i[keep_], j[keep_], n[keep_]
        for step in range(coords - match + 1, coords):
            alive = n + (coords - step) >= match
            i, j, n = i[alive], j[alive], n[alive]
            c = by_length[i, step]
            n = n + (left[i, c] == right[j, c])
        alive = n >= match
        found.append(np.stack([i[alive], j[alive]]))
        begin = end
    return tuple(np.concatenate(found, axis=1))


def _collisions(group: pa.Table, coords: int, match: int):
    """Positions (i, j) of members in two components whose signatures reach ``match``."""
    own, label = group.column("own").to_numpy(), group.column("component").to_numpy()
    left = np.flatnonzero(own == group.column("left")[0].as_py())
    right = np.flatnonzero(own == group.column("right")[0].as_py())
    sig = _signatures(group.column("signature"), coords)
    i, j = merge_lists(sig[left], sig[right], match, lambda i, j: label[left[i]] != label[right[j]])
    return left[i], right[j]


_RUN_KEYS = ["hub", "left", "right"]


def _alike_runs(rows: DataFrame, reps: DataFrame, coords: int, match: int) -> DataFrame:
    """The ``hub, rep, n`` that collide with a member of another component."""

    def run(batches):
        for group in _groups(batches, _RUN_KEYS):
            found = np.unique(np.concatenate(_collisions(group, coords, match)))
            if len(found):
                part = group.select(["hub", "rep", "n"]).take(found)
                yield from part.combine_chunks().to_batches()

    ready = rows.join(reps.select("rep", "signature"), "rep").repartition(*_RUN_KEYS).sortWithinPartitions(*_RUN_KEYS)
    found = ready.select(*_RUN_KEYS, "rep", "n", "component", "own", "signature").mapInArrow(run, "hub long, rep long, n long")
    return found.distinct()


def _run_links(rows: DataFrame, sets: DataFrame, coords: int, match: int, similarity: int) -> DataFrame:
    """Verified links between members of one group that are in different components."""

    def run(batches):
        for group in _groups(batches, _RUN_KEYS):
            rep, label = group.column("rep").to_numpy(), group.column("component").to_numpy().copy()
            bits = group.column("hashes")
            of = lambda i: np.frombuffer(bits[int(i)].as_buffer(), np.uint64)
            found = []
            for i, j in zip(*_collisions(group, coords, match)):
                if label[i] == label[j]:
                    continue
                if _similar(of(i), of(j), similarity):
                    found.append((rep[i], rep[j]))
                    label[label == label[j]] = label[i]
            if found:
                yield _links_table(found)

    ready = rows.join(sets, "rep").repartition(*_RUN_KEYS).sortWithinPartitions(*_RUN_KEYS)
    names = [*_RUN_KEYS, "rep", "component", "own", "hashes", "signature"]
    return ready.select(*names).mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, size: int = 5, similarity: int = SIMILARITY, coords: int = COORDS, match: int = MATCH
) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``doc_id, n_shingles, component_id, kept``.

    Links join documents with 100 * intersection >= ``similarity`` * union of
    their shingle sets; component_id is the smallest doc_id reachable.
    Null or wordless texts have no set and are linked with nothing.  Rows that
    repeat a doc_id are one document, linked through one of its texts (the one
    with the smallest set digest).  A null doc_id is in no group: component_id
    null, kept true.  An empty table gives an empty one.  Other columns of
    ``docs`` are not read.
    """
    with arrow_rows(docs.sparkSession):  # batches of sets and texts lie in the executor and in its worker; all jobs with workers run in here
        rows = keep(sketch(docs, size, coords), "sketch")
        known = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
        ids = keep(known.groupBy("doc_id").agg(F.min("digest").alias("digest")), "ids")
        classes = ids.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
        # One set, one signature: both sides have a row per class, so that no class is a hot key.
        signatures = known.groupBy("digest").agg(F.first("signature").alias("signature"), F.first("n_shingles").alias("n"))
        classes = keep(classes.join(signatures, "digest"), "classes")
        reps = classes.select("rep", "n", "digest", "signature")
        posted = keep(postings(reps, coords, match), "postings")
        lists = posted.groupBy("token").agg(F.min(F.struct("rep", "n")).alias("h"), F.max("rep").alias("last"), F.count("*").alias("postings"))
        lists = keep(lists.where("h.rep < last").select("token", "postings", F.col("h.rep").alias("hub"), F.col("h.n").alias("hub_n")), "lists")
        members = look_up(posted, lists, "token", "postings", F.col("rep")).where("hub IS NOT NULL AND hub <> rep")
        members = members.select("hub", "hub_n", "rep", "n").distinct()
        members = keep(members, "members")
        near = keep(_alike_hubs(members, reps, coords, match), "near-hubs")
        links = keep(_hub_links(near, _sets_of(docs, near, reps, size, coords), similarity), "hub-links")
        labels = connected_components(links)
        with_hubs = members.drop("hub_n").union(members.select("hub", F.col("hub").alias("rep"), F.col("hub_n").alias("n")).distinct())
        with_hubs = keep(with_hubs, "with-hubs")
        apart = keep(_alike_runs(_run_rows(with_hubs, labels), reps, coords, match), "near-runs")
        own_n = members.select("hub", F.col("hub_n").alias("n")).distinct()
        apart = apart.unionByName(apart.select("hub").distinct().join(own_n, "hub").withColumn("rep", F.col("hub"))).distinct()
        apart = keep(apart, "apart")
        sets = _sets_of(docs, apart, reps, size, coords)
        more = keep(_run_links(_run_rows(apart, labels), sets, coords, match, similarity), "run-links")
        labels = connected_components(links.union(more))
    component = F.coalesce("component", "rep").alias("component_id")
    final = classes.select("rep", "digest", "copies").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("digest", "copies", component)
    of_doc = look_up(ids, keep(final, "final"), "digest", "copies", F.col("doc_id")).select("doc_id", "component_id")
    out = rows.select("doc_id", "n_shingles").join(of_doc, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def _positions(ids: np.ndarray) -> np.ndarray:
    return (mix64(ids.astype(np.uint64)) % np.uint64(BITS)).astype(np.int64)


def _sets_of(docs: DataFrame, pairs: DataFrame, reps: DataFrame, size: int, coords: int) -> DataFrame:
    """``rep, hashes, signature`` of the representatives that ``pairs(hub, rep)`` names.

    The scan makes sets only where a filter of BITS bits may know the document,
    so that texts are not shuffled; the join with the digests is exact.
    """
    wanted = pairs.select(F.explode(F.array("hub", "rep")).alias("rep")).distinct().join(reps.select("rep", "digest"), "rep")
    wanted = keep(wanted, "wanted")

    def positions(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_positions(batch.column("rep").to_numpy()))], ["at"])

    at = wanted.select("rep").mapInArrow(positions, "at long").distinct().toArrow()
    bits = np.zeros(BITS, bool)
    bits[at.column("at").to_numpy()] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def run(batches):
        by, known = multipliers(coords), np.unpackbits(shared.value).view(bool)
        for batch in slices(batches):
            batch = batch.filter(pa.array(known[_positions(batch.column("rep").to_numpy(zero_copy_only=False))]))
            for k in range(0, batch.num_rows, _CHUNK_ROWS):
                part = batch.slice(k, _CHUNK_ROWS)
                found = [(r, s) for r, s in zip(part.column("rep").to_pylist(), document_sets(part.column("text"), size)) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r for r, _ in found], pa.int64()),
                        pa.array([_digest(s) for _, s in found], pa.binary()),
                        pa.array([s.tobytes() for _, s in found], pa.binary()),
                        pa.array([signature(s, by).tobytes() for _, s in found], pa.binary()),
                    ],
                    ["rep", "digest", "hashes", "signature"],
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    made = texts.where("rep IS NOT NULL").mapInArrow(run, "rep long, digest binary, hashes binary, signature binary")
    return made.join(wanted, ["rep", "digest"]).select("rep", "hashes", "signature")
