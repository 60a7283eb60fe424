"""Vector codes, importance draws and packing against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidewright.functions.shared import Scratch, keep
from tidewright.llm import bloom_lm, bpe, code_vectors, decontaminate, importance, near_dedup, op11_vector_codes, packing, token_files

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
VECTORS = "vec_id long, embedding array<float>, label int, code string, error long, of string"
DOCS = "doc_id long, text string, score long, rank long, key long, seq string"


def brute_codes(rows, parts=16, entries=64, rounds=2):
    """The contract, in plain Python."""
    held = sorted(((v, [math.floor(256 * x) for x in e], label) for v, e, label in rows if e and all(x is not None and math.isfinite(x) for x in e)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not held:
        return [], ""
    w = len(held[0][1]) // parts
    cut = lambda e, p: e[p * w : (p + 1) * w]
    books = [[cut(e, p) for _, e, _ in held[:entries]] for p in range(parts)]

    def best(e, p):
        return min((sum((a - b) ** 2 for a, b in zip(cut(e, p), c)), k) for k, c in enumerate(books[p]))

    for _ in range(rounds):
        at = [[best(e, p)[1] for p in range(parts)] for _, e, _ in held]
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [cut(e, p) for (_, e, _), a in zip(held, at) if a[p] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    last = [[best(e, p) for p in range(parts)] for _, e, _ in held]
    errors = [sum(d for d, _ in b) for b in last]
    of = Counter()
    for (_, _, label), e in zip(held, errors):
        of[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted((str(v), "".join(f"{k:02x}" for _, k in b), e, of[label], digest) for (v, _, label), b, e in zip(held, last, errors)), digest


def vectors(n, seed=1):
    r = random.Random(seed)
    centres = [[r.uniform(-1, 1) for _ in range(32)] for _ in range(9)]
    rows = [(k * 3, [float(np.float32(x + r.gauss(0, 0.05))) for x in r.choice(centres)], r.choice([0, 0, 0, 1, None])) for k in range(n)]
    odd = [(1, None, 1), (2, [None] + [0.5] * 31, 1), (4, [math.nan] * 32, 2), (5, [math.inf] + [0.0] * 31, 0), (8, [], 0), (None, [0.25] * 32, None)]
    return rows + rows[5:9] + [(7, rows[2][1], 0), (10, rows[2][1], 1)] + odd


@pytest.mark.parametrize("n", [150, 20])
def test_vector_codes(spark, n):
    rows = vectors(n)
    frame = spark.createDataFrame([(v, e, label, "c", 1, "o") for v, e, label in rows], VECTORS).repartition(5)
    got = sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in op11_vector_codes.vector_codes(frame).collect())
    assert got == brute_codes(rows)[0]


def test_vector_codes_of_nothing(spark):
    assert op11_vector_codes.vector_codes(spark.createDataFrame([], VECTORS)).collect() == []
    with pytest.raises(ValueError):
        code_vectors.compress(spark.createDataFrame([(1, [0.5] * 17, 1, "", 1, "")], VECTORS))


def test_reassign_compares_moved_entries_only():
    rng = np.random.default_rng(3)
    x, old = rng.integers(-9, 9, (500, 3)), rng.integers(-9, 9, (20, 3))
    code, error = code_vectors.nearest(x, old)
    for change in ([], [4], [0, 4, 19], range(20)):
        new, moved = old.copy(), np.zeros(20, bool)
        for k in change:
            new[k] = rng.integers(-9, 9, 3)
            moved[k] = (new[k] != old[k]).any()
        got = code_vectors.reassign(x, new, moved, code, error)
        want = code_vectors.nearest(x, new)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
        assert got[2] == moved[code].sum() * 20 + (~moved[code]).sum() * moved.sum()
        assert moved.all() or got[2] < 500 * 20 or not len(change)


def brute_draw(rows, target, share=25, least=20, buckets=10000):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    features = lambda w: w + [f"{a} {b}" for a, b in zip(w, w[1:])]
    place = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(place, features(words(text))))
    for text in target:
        t.update(map(place, features(words(text))))
    out = []
    for doc_id, text in rows:
        w = words(text)
        f = features(w)
        gain = [math.floor(1000 * math.log((t[place(x)] + 1) * (s.total() + buckets) / ((s[place(x)] + 1) * (t.total() + buckets)))) for x in f]
        weight = sum(gain) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2]))
    for k, r in enumerate(fit[: share * len(fit) // 100], 1):
        r[5] = k
    return sorted(map(tuple, out), key=repr)


def prose(r, n):
    return "".join(r.choice(["Alpha", "beta", "g4mma", "ÑandÚ", "漢字", "ZZ"]) + r.choice([" ", "  ", "\n", "-", "_'"]) for _ in range(n))


def test_importance_draw(spark):
    r = random.Random(8)
    rows = [(k, prose(r, r.choice([3, 19, 20, 21, 60, 400]))) for k in range(120)]
    rows += [(500, None), (501, ""), (502, " \x00-- "), (503, "x" * 70000 + " y" * 30), (None, prose(r, 50)), *rows[:7], (504, "abc" * 900_000), (505, prose(r, 300_000))]
    target = [prose(r, 40).replace("Alpha", "beta"), None, "beta beta"]
    docs = spark.createDataFrame([(d, t, 1, 1, 1, "s") for d, t in rows], DOCS).repartition(7)
    got = importance.importance_draw(docs, spark.createDataFrame([(t,) for t in target], "text string"))
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_draw(rows, target)
    assert importance.drawn_documents(docs, got).count() > 20
    nothing = importance.importance_draw(docs.limit(0), spark.createDataFrame([], "text string"))
    assert nothing.collect() == []


@pytest.mark.parametrize("size", [1, 16, 1 << 20])
@pytest.mark.parametrize("n", [1, 2, 3])
def test_runs_do_not_cross_documents_nor_depend_on_pieces(n, size):
    texts = [b"a b c", b"", b" d", b"E  f-g", b"h" * 50 + b" i", b"...", b"j"]
    got = Counter((int(d), int(c)) for _, ds, cs in importance.runs(texts, n, size) for d, c in zip(ds, cs))
    want = Counter()
    for d, t in enumerate(texts):
        w = re.findall(rb"[a-z]+", t.lower())
        want.update((d, zlib.crc32(b" ".join(w[k : k + m]))) for m in range(1, n + 1) for k in range(len(w) - m + 1))
    assert got == want


def one_by_one(lengths, capacity):
    """Best fit of the sorted pieces, one at a time."""
    rooms = Counter()
    for length in sorted(lengths, reverse=True):
        room = min((r for r, n in rooms.items() if n and r >= length), default=capacity)
        rooms[room] -= room < capacity or bool(rooms[room])
        rooms[room - length] += 1
    return sum(n for n in rooms.values() if n > 0)


def checked(rows, capacity):
    """Sequences used; pieces must lie in them without a gap."""
    of = {}
    for r in rows:
        of.setdefault(r.seq, []).append((r.offset, r.length))
    for pieces in of.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(of)


@pytest.mark.parametrize("kind", ["mixed", "small", "equal", "hot"])
def test_best_fit(spark, monkeypatch, kind):
    monkeypatch.setattr(packing, "RANGE_ROWS", 50)  # many ranges, and groups of one size that take several
    r = random.Random(kind)
    lengths = {"mixed": [r.randint(1, 128) for _ in range(700)], "small": [r.randint(1, 9) for _ in range(600)], "equal": [33] * 400, "hot": [40] * 300 + [r.randint(1, 127) for _ in range(500)]}[kind]
    table = keep(spark.createDataFrame(list(enumerate(lengths)), "key long, length long").repartition(3), "t")
    placed = packing.best_fit(table, 128).join(table, "key").collect()
    assert sorted(p.key for p in placed) == list(range(len(lengths)))
    used = checked(placed, 128)
    assert used <= one_by_one(lengths, 128) * 1.03 + 1


def test_brackets_match_the_nearest_free_gap():
    r = random.Random(2)
    for _ in range(50):
        piece = np.array([r.random() < 0.5 for _ in range(r.randint(1, 40))])
        stack, want = [], []
        for k, p in enumerate(piece):
            if not p:
                stack.append(k)
            elif stack:
                want.append((stack.pop(), k))
        assert sorted(zip(*map(np.ndarray.tolist, packing.brackets(piece)))) == sorted(want)


def test_opened_rooms():
    lengths = Counter({9: 7, 8: 1, 3: 11})
    flat = sorted(lengths.elements(), reverse=True)
    assert packing.opened_rooms(lengths, 3, 30) == Counter(30 - sum(flat[k : k + 3]) for k in range(0, len(flat), 3))


def test_pack_round_trip(spark):
    r = random.Random(5)
    texts = [None, "", "x<|endoftext|>y", prose(r, 3000), *[prose(r, r.randint(1, 200)) for _ in range(60)]]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, "no id")]
    docs = spark.createDataFrame([(d, t, 1, 1, 1, "s") for d, t in rows], DOCS).repartition(4)
    tokenizer = Tokenizer.from_file(VOCABULARY)
    with Scratch(spark):
        packed = packing.pack(docs, VOCABULARY, 0, 512)
        assert packed.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
        got = packed.collect()
        whole = packing.sequences(packed).collect()
    want = Counter()
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 512 or 512
        cuts = [0, *range(first, len(ids) + 1, 512)]
        want.update((doc_id, k, a, b - a, np.array(ids[a:b], "<u4").tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((p.doc_id, p.piece, p.start, p.length, bytes(p.ids)) for p in got) == want
    assert checked([type(p)(**{"seq": p.sequence_id, "offset": p.offset, "length": p.length}) for p in got], 512) == len(whole)
    ids = {s.sequence_id: np.frombuffer(s.ids, "<u4") for s in whole}
    for p in got:
        assert ids[p.sequence_id][p.offset : p.offset + p.length].tobytes() == bytes(p.ids)
    assert packing.pack(docs.limit(0), VOCABULARY).collect() == []




@pytest.mark.parametrize("size", [10, 60, 200, 400, 1000])
def test_recall_of_edited_passages_at_every_size(size):
    """Items that the simulation never saw, at exactly 20 % edits, inside other text."""
    rng = np.random.default_rng(1000 + size)
    new = lambda n: rng.integers(1, 1 << 63, n, dtype=np.uint64)
    items = [new(size) for _ in range(200)]
    index = decontaminate.Index(list(range(200)), items, decontaminate.repeats_of(0.98, 0.2))
    found = 0
    for k, item in enumerate(items):
        words = np.concatenate([new(40), decontaminate.edited(item, 0.2, rng), new(40)])
        found += k in {int(r[1]) for r in index.candidates(words, np.array([0, len(words)]))}
    assert found >= 0.98 * 200


def test_a_recall_out_of_reach_raises():
    with pytest.raises(ValueError):
        decontaminate.repeats_for(0.98, 0.95, 60)


def test_found_items_leave_no_broadcast(spark):
    docs = spark.createDataFrame([(k, f"lead {k} one two three four five six seven eight nine ten", 1, 1, 1, "s") for k in range(5)], DOCS)
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, "never said at all in any text")], "item_id long, text string")
    with Scratch(spark) as own:
        assert {(r.doc_id, r.item_id) for r in decontaminate.contaminations(docs, bench).collect()} == {(k, 1) for k in range(5)}
        assert own.paths


def test_near_duplicates_of_very_long_texts(spark, monkeypatch):
    """One group of texts whose sets do not fit a run together: runs follow their bytes."""
    monkeypatch.setattr(near_dedup, "RUN_BYTES", 1 << 20)
    r = random.Random(6)
    words = [f"w{r.randint(0, 10**6)}" for _ in range(60_000)]
    rows = []
    for k in range(12):
        mine = list(words)
        for at in r.sample(range(60_000), 300 + 150 * k):
            mine[at] = f"x{k}_{at}"
        rows.append((k, " ".join(mine), 1, 1, 1, "s"))
    rows += [(100 + k, f"short text number {k} of its own kind here", 1, 1, 1, "s") for k in range(30)]
    sets = {}
    for d, t, *_ in rows:
        mine = t.split()
        sets[d] = set(zip(mine, mine[1:], mine[2:], mine[3:], mine[4:]))
    label = {d: d for d in sets}
    for a in range(12):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {d: low if x == high else x for d, x in label.items()}
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(4)).collect()}
    assert {d: c for d, c in got.items() if d < 100} == {d: c for d, c in label.items() if d < 100}
    assert near_dedup._run_rows(spark.createDataFrame([(0, k, 60_000) for k in range(12)], "hub long, rep long, n long"), spark.createDataFrame([], "node long, component long")).select("left", "right").distinct().count() > 3


def test_a_change_of_the_splitter_is_another_version(monkeypatch):
    bpe.version_digest.cache_clear()
    before = bpe.version_digest(VOCABULARY)
    for name in ("SPLITTER", "PATTERN", "PLAIN"):
        with monkeypatch.context() as patch:
            patch.setattr(bpe, name, getattr(bpe, name) + "x")
            bpe.version_digest.cache_clear()
            assert bpe.version_digest(VOCABULARY) != before
    bpe.version_digest.cache_clear()
    assert bpe.version_digest(VOCABULARY) == before


def test_requests_are_searched_and_not_joined_by_range(spark, tmp_path):
    docs = spark.createDataFrame([(k * 2, f"text {k}", 1, 1, 1, "s") for k in range(300)], DOCS)
    manifest = keep(token_files.write_token_files(docs, str(tmp_path / "ids"), VOCABULARY, 2), "manifest")
    found = token_files.read_documents(manifest, spark.createDataFrame([(x,) for x in (-5, 0, 3, 4, 598, 600, None, 4)], "doc_id long"))
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    assert sorted(r.doc_id for r in found.collect()) == [0, 4, 598]
    assert token_files.read_documents(manifest.limit(0), spark.createDataFrame([(1,)], "doc_id long")).collect() == []


def test_a_contexts_probabilities_add_up_to_one():
    """Over all words and the unknown one, from quantised counts and a filter with its false members."""
    r = np.random.default_rng(5)
    words = r.integers(1, 2**63, 20_000).astype(np.uint64)
    text = words[np.minimum(r.zipf(1.3, 200_000) - 1, len(words) - 1)]
    left, right = text[:-1], text[1:]
    pairs, first, n = np.unique(bloom_lm._pair_keys(left, right), return_index=True, return_counts=True)
    known, counts = np.unique(text, return_counts=True)
    none = np.zeros(0, np.uint64)
    model = bloom_lm.Model(bloom_lm.Words(known, counts), none, np.zeros(0), np.zeros(0, np.int64), len(text), len(known), 1)
    made = bloom_lm.Shard.of(left[first], pairs, n, model.first)
    shard = bloom_lm.Shard.unpack(made.pack(), model.first)
    told = bloom_lm.probe(shard.table, shard.first, pairs) / n
    assert told.min() > 0.7 and (told < 1.3).mean() > 0.95 and (told[n == 1] == 1).mean() > 0.9
    alone = np.r_[model.alone(counts), model.alone(0)]
    assert alone.sum() == pytest.approx(1)
    every = np.r_[known, np.uint64(7)]  # a word that training has not seen closes the list
    contexts = np.r_[r.permutation(np.unique(left))[:300], words[:20], np.uint64(9)]
    sums = []
    for h in contexts:
        pair, back, seen = model.smoothed(shard, np.full(len(every), h), every)
        sums.append(((pair + back * alone) / (seen + back)).sum())
    assert (abs(np.array(sums) - 1) < 0.01).mean() > 0.95 and np.mean(sums) == pytest.approx(1, abs=0.01)


def test_a_trained_model_scores_other_documents(spark):
    rows = [(k, "the cat sat on the mat " * 5 if k % 2 else "a dog ran off " * 7) for k in range(60)]
    trained = bloom_lm.train(spark.createDataFrame(rows, "doc_id long, text string"))
    other = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "mat the on sat cat the"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in bloom_lm.score(other, trained).collect()}
    assert set(got) == {1, 2, 3} and got[1] > got[2] + 1
