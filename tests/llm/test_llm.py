"""The training-data operators against brute force, on small tables with odd rows."""

import collections
import hashlib
import math
import os
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewright.llm import bloom_lm, bpe, decontaminate, frames, gru_lang, line_dedup, near_dedup, quality_rules, source_mix, store, token_counts, token_files, url_rules, words
from tidewright.llm.store import shared_path

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep long, key string, row string"
rng = random.Random(4)
VOCAB = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def texts():
    """Nulls, empty and blank texts, copies, near copies, ties, a long text, special strings."""
    long = prose(9000, 1)
    base = [prose(60, k) for k in range(2, 14)]
    near = [t.replace(t.split()[30], "zzz", 1) for t in base[:5]]
    return [None, "", " \n\t ", "a b", "a b", "A  b", long, long + " end", *base, *base[:4], *near, "x<|endoftext|>y", "漢字 ñ\u00a0é ½\r\n", "1 2 3 4 5 6", None]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, ["en", "fr", None][k % 3], ["s0", "s0", "s1", None][k % 4], len(t or ""), 1, "k", "r") for k, t in enumerate(texts())]
    return spark.createDataFrame(rows + rows[9:10] + [(None, "a null id", "en", "s0", 9, 1, "k", "r")], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    column = pa.array(texts())
    whole, at = words.word_hashes(*words.text_buffers(column))
    assert [int(n) for n in np.diff(at)] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts()]
    monkeypatch.setattr(words, "BLOCK", 64)
    again, _ = words.word_hashes(*words.text_buffers(column.slice(1)))
    assert (again == whole).all()


def test_encoder_equals_the_library():
    library = Tokenizer.from_file(VOCABULARY)
    odd = [t or "" for t in texts()] + ["it's we'll I'M", "x\x1c y\x85z", "🙂 a\u00adb ﬁ ʰ ٣", " \n  b", "\t\tq"]
    want = [e.ids for e in library.encode_batch(odd, add_special_tokens=False)]
    encoder = bpe.Encoder(VOCABULARY)
    assert [i.tolist() for i in encoder.ids(odd)] == want and list(encoder.counts(odd)) == [len(w) for w in want]


def test_token_counts(spark, docs, empty, monkeypatch):
    library = Tokenizer.from_file(VOCABULARY)
    cache = shared_path(spark, "cache")
    for again in (False, True):
        if again:  # the second run finds every count in the cache
            monkeypatch.setattr(token_counts, "encode_counts", lambda *_: pytest.fail("encoded again"))
        got = token_counts.token_counts(docs, cache, VOCABULARY).collect()
        assert len(got) == docs.count()
        plain = {r.doc_id: r.text or "" for r in docs.collect()}
        assert all(r.n_tokens == len(library.encode(plain[r.doc_id], add_special_tokens=False).ids) for r in got)
        assert all(r.n_bytes == len(plain[r.doc_id].encode()) for r in got)
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == len(set(plain.values()))
    assert token_counts.token_counts(empty, cache, VOCABULARY).count() == 0


def brute_quality(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    n = collections.Counter(windows)
    repeated = {k + j for k, x in enumerate(windows) if n[x] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated)


def test_quality(docs, empty):
    got = quality_rules.judge_quality(docs).collect()
    plain = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(plain[r.doc_id])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    assert quality_rules.judge_quality(empty).count() == 0


def _texts_of(n, source, word, start):
    """n clean texts of 40 different words of one length."""
    return [(start + i, " ".join(f"{word}{i:04d}{k:02d}" for k in range(40)), "en", source) for i in range(n)]


@pytest.mark.parametrize("enough, own", [(30, True), (31, False), (10_000, False)])
def test_small_groups_take_merged_fences(spark, enough, own):
    """30 texts of long words beside 300 of short ones: with fences of its own the small source stays."""
    rows = _texts_of(300, "short", "ab", 0) + _texts_of(30, "long", "abcdefghijkl", 1000)
    got = quality_rules.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), enough=enough).collect()
    assert all(r.kept == (own or r.doc_id < 1000) for r in got) and len(got) == 330


def test_outliers_of_each_ratio(spark):
    """With slacks below the base rule a text outside its group's quartiles goes, whichever ratio it is."""
    rows = _texts_of(60, "a", "ab", 0)
    words = rows[0][1].split(" ")
    planted = {
        100: ("word_length", " ".join(w * 4 for w in words)),
        101: ("symbols", " ".join([w + "#" for w in words[:8]] + words[8:])),
        102: ("dup_lines", "\n".join([*words, words[0], words[1], words[2], words[3], words[4]]).replace("\n" + words[1], " x\n" + words[1], 1)),
        103: ("repeats", " ".join([*words, *words[:6], *(f"z{k}" for k in range(30))])),
    }
    table = spark.createDataFrame(rows + [(k, t, "en", "a") for k, (_, t) in planted.items()], "doc_id long, text string, lang string, source string")
    tight = {"word_length": 50, "symbols": 100, "dup_lines": 100, "repeats": 100}
    for doc, (ratio, _) in planted.items():
        slacks = {k: 10**6 for k in tight} | {ratio: tight[ratio]}
        got = {r.doc_id: r for r in quality_rules.judge_quality(table, enough=10, slacks=slacks).collect()}
        assert not got[doc].base_failed and not got[doc].kept and all(got[k].kept for k in range(60)), ratio


def test_quantile_sketch_merges(spark):
    values = [rng.randint(0, 10**6) for _ in range(3000)]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select(quality_rules.bucket(F.col("v")).alias("b"), "v").collect()
    assert all(r.b <= r.v and r.v - r.b <= r.v / 32 + 1 for r in rows)


def test_token_files_round_trip(spark, docs, empty):
    library = Tokenizer.from_file(VOCABULARY)
    manifest = token_files.write_token_files(docs, shared_path(spark, "ids"), VOCABULARY, 2).persist()
    got = token_files.read_token_files(manifest).orderBy("start").collect()
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    start = 0
    for r, g in zip(rows, got, strict=True):
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [2]
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    none = token_files.write_token_files(empty, shared_path(spark, "ids"), VOCABULARY, 2).persist()
    assert token_files.read_token_files(none).count() == 0


def test_cache_is_found_again_by_its_version(spark, tmp_path):
    assert token_counts.cache_folder(spark, VOCABULARY) == token_counts.cache_folder(spark, VOCABULARY)
    other = tmp_path / "v.json"
    other.write_bytes(open(VOCABULARY, "rb").read() + b" ")
    assert token_counts.cache_folder(spark, str(other)) != token_counts.cache_folder(spark, VOCABULARY)


def test_hot_keys_are_looked_up(spark, monkeypatch):
    """A key with most rows, cold keys, unknown and null keys give what a plain left join gives."""
    rows = spark.createDataFrame([(k, "hot" if k % 3 else f"c{k % 40}" if k % 5 else None) for k in range(600)], "row long, key string")
    table = rows.where("key IS NOT NULL AND key <> 'c3'").groupBy("key").agg(F.count("*").alias("n"), F.max("row").alias("v"))
    want = {(r.row, r.key, r.v) for r in rows.join(table, "key", "left").collect()}
    for share in (1, 5, 10**9):
        monkeypatch.setattr(store, "HOT_KEYS", share)
        got = store.look_up(rows, table, "key", "n", F.col("row")).collect()
        assert len(got) == 600 and {(r.row, r.key, r.v) for r in got} == want


def test_requested_documents_are_read_alone(spark, monkeypatch):
    library = Tokenizer.from_file(VOCABULARY)
    monkeypatch.setattr(token_files, "FRAME_IDS", 400)
    rows = [(3 * k, prose(80, k)) for k in range(120)] + [(30, "another thirty"), (None, "no id")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = store.keep(token_files.write_token_files(table, shared_path(spark, "ids"), VOCABULARY, 2), "manifest")
    asked = spark.createDataFrame([(30,), (30,), (357,), (31,), (None,)], "doc_id long")
    got = token_files.read_documents(manifest, asked).collect()
    encode = lambda t: library.encode(t, add_special_tokens=False).ids + [2]
    assert sorted((r.doc_id, r.ids) for r in got) == sorted((i, encode(t)) for i, t in rows if i in (30, 357))
    frames_read = {(r.path, r.frame): r.frame_bytes for r in got}
    whole = sum(os.path.getsize(r.path.removeprefix("file:").replace("///", "/")) for r in manifest.select("path").distinct().collect())
    assert len(frames_read) <= 3 and manifest.count() > 20 and sum(frames_read.values()) < whole / 5
    assert token_files.read_documents(manifest.where("false"), asked).count() == 0


def test_frames_read_only_what_is_asked():
    import io

    sink = io.BytesIO()
    writer = frames.Writer(sink)
    many = [[np.arange(k * 10, dtype=np.uint32), np.zeros(0, np.uint32)] for k in range(5)]
    for k, d in enumerate(many):
        writer.add([k, None], d)
    writer.finish()
    data, read = sink.getvalue(), []
    reader = frames.Reader(lambda n, at: read.append(n) or data[at : at + n], len(data))
    before = sum(read)
    (a, x), (b, y) = reader.frame(3)
    assert (a, b, x.tolist(), len(y)) == (3, None, list(range(30)), 0) and sum(read) - before == int(reader.table[3, 0])
    broken = bytearray(data)
    broken[int(reader.starts[2]) + 12] ^= 255
    with pytest.raises(Exception):  # noqa: B017  the checksum or the frame itself
        frames.Reader(lambda n, at: bytes(broken[at : at + n]), len(broken)).frame(2)
    import zstandard

    assert zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()  # a plain reader skips the table


def test_language_model(docs, empty):
    got = bloom_lm.score_documents(docs).collect()
    rows = docs.collect()
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    c = collections.Counter(w for r in rows if r.doc_id is not None and not held(r.doc_id) for w in tokens(r.text))
    n, v = sum(c.values()), len(c)
    plain = {r.doc_id: r.text for r in rows}
    assert len(got) == len(rows)
    for r in got:
        mine = tokens(plain[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(mine), sum(w in c for w in mine), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in mine))
        assert r.held_out == (None if r.doc_id is None else held(r.doc_id)) and r.score < 0
    assert bloom_lm.score_documents(empty).count() == 0


def test_filter_keeps_quantised_counts(spark):
    counts = {int(k): int(rng.expovariate(0.01)) + 1 for k in range(2000)}
    table, bits = bloom_lm.build_filter(spark.createDataFrame(list(counts.items()), "key long, n long"))
    keys = np.arange(6000, dtype=np.uint64)
    got = bloom_lm.probe(table, bits, keys)
    exact = sum(counts[k] / got[k] < 1.5 and got[k] / counts[k] < 1.5 for k in counts)
    assert exact > 0.95 * len(counts) and (got[2000:] > 0).mean() < 0.1 and all(got[k] >= counts[k] / 1.5 for k in counts)


def exact_scores(rows, held):
    """Bigram scores from exact counts, smoothed like the model's."""
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    mine = [tokens(t) for i, t in rows if not held(i)]
    c = collections.Counter(w for t in mine for w in t)
    pairs = collections.Counter(x for t in mine for x in zip([None, *t], t))
    kinds = collections.Counter(h for h, _ in pairs)
    n, v = sum(c.values()), len(c)
    alone = lambda w: (c[w] + 0.5) / (n + 0.5 * (v + 1))
    term = lambda h, w: math.log10((pairs[h, w] + (kinds[h] + 1) * alone(w)) / (c[h] + kinds[h] + 1))
    return {i: sum(term(h, w) for h, w in zip([None, *tokens(t)], tokens(t))) for i, t in rows}


def scored(spark, rows):
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r.doc_id: r.score for r in bloom_lm.score_documents(table).collect()}


@pytest.mark.parametrize("heavy", [1 << 20, 150])
def test_language_model_keeps_its_bits_at_every_size(spark, monkeypatch, heavy):
    """Many shards, each with its own filter, and contexts spread over them, give the scores of exact counts."""
    rows = [(k, prose(60, 100 + k // 2)) for k in range(300)]  # 300 words, every text twice
    want = exact_scores(rows, lambda i: zlib.crc32(str(i).encode()) % 5 == 1)
    for name, value in (("SHARD_BYTES", 3000), ("CHUNK", 2000), ("HEAVY", heavy)):
        monkeypatch.setattr(bloom_lm, name, value)
    got = scored(spark, rows)
    assert set(got) == set(want) and all(got[i] == pytest.approx(want[i], rel=0.07) for i in want)
    sizes = [bloom_lm.filter_of(np.arange(n, dtype=np.uint64), np.ones(n, np.int64))[0].size * 64 / n for n in (100_000, 5_000_000)]
    assert all(8 <= x <= 16 for x in sizes)


def test_language_model_tells_all_words_apart(spark, monkeypatch):
    """Words outside the frequent table, here nearly or all of them, keep their own bigrams."""
    rows = [(k, prose(60, 100 + k // 2)) for k in range(300)]
    want = exact_scores(rows, lambda i: zlib.crc32(str(i).encode()) % 5 == 1)
    frequent = bloom_lm.frequent_words
    for most in (20, 0):
        monkeypatch.setattr(bloom_lm, "frequent_words", lambda counts: frequent(counts, most))  # noqa: B023
        got = scored(spark, rows)
        assert all(got[i] == pytest.approx(want[i], rel=0.07) for i in want)


def test_language_model_counts_single_bigrams(spark):
    """A held-out copy of a single training document scores like that document, not like its words in another order."""
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    rows = [(k, prose(40, 5000 + k)) for k in range(200) if not held(k)]
    copy, other = [k for k in range(200, 300) if held(k)][:2]
    text = rows[7][1]
    rows += [(copy, text), (other, " ".join(sorted(text.split())))]
    got, want = scored(spark, rows), exact_scores(rows, held)
    assert got[copy] == pytest.approx(got[rows[7][0]]) and got[copy] > 0.9 * want[copy] + 0.1 * want[other] > got[other]
    assert all(got[i] == pytest.approx(want[i], rel=0.07) for i in want)


def slow_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_decontamination(spark, empty):
    items = [prose(n, 1000 + n) for n in (6, 15, 30, 55)]
    r = random.Random(9)

    def edited(text, share):
        w = text.split()
        for _ in range(int(share * len(w))):
            p = r.randrange(len(w))
            w[p : p + 1] = [["zq" + str(r.random())[2:5]], [], [w[p], "qz"]][r.randrange(3)]
        return " ".join(w)

    planted = [(k, e) for k in range(4) for e in (0, 0.1, 0.2) for _ in range(6)]
    rows = [(i, f"{prose(40, i)} {edited(items[k], e).upper()}! {prose(30, i + 500)}") for i, (k, e) in enumerate(planted)]
    rows += [(900 + i, prose(200, 7000 + i)) for i in range(30)] + [(990, None), (991, ""), (None, items[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (7, None), (8, "")], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.edits for x in decontaminate.contaminations(docs, bench).collect()}
    plain = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    number = collections.defaultdict(lambda: len(number))
    want = {}
    for i, t in rows:
        for k, item in enumerate(items):
            d = slow_distance([number[w] for w in plain(item)], [number[w] for w in plain(t)])
            assert d == decontaminate.edit_distance(np.array([number[w] for w in plain(item)]), np.array([number[w] for w in plain(t)]))
            if d <= int(0.2 * len(plain(item))):
                want[i, k] = d
    assert set(got) <= set(want) and len(set(want) & set(got)) >= 0.97 * len(want)
    assert all(got[x] == want[x] for x in got)
    assert all((i, k) in got for i, (k, e) in enumerate(planted) if e == 0) and (None, 2) in got
    assert decontaminate.contaminations(empty, bench).count() == decontaminate.contaminations(docs, bench.where("false")).count() == 0


def test_repetitions_follow_the_recall():
    n = [decontaminate.repeats_for(x, 0.2) for x in (0.5, 0.9, 0.98)]
    assert n == sorted(n) and 1 <= n[0] < n[2] <= decontaminate.MOST_REPEATS and decontaminate.repeats_for(0.98, 0.05) < n[2]


def test_items_that_share_their_words(monkeypatch):
    """Every word starts entries of every item: windows are walked in pieces and nothing is lost."""
    r = random.Random(5)
    few = [f"w{k}" for k in range(12)]
    items = [" ".join(r.sample(few, 12)) for _ in range(200)]
    hashed, at = decontaminate.plain_words(pa.array(items))
    index = decontaminate.Index(list(range(200)), [hashed[i:j] for i, j in zip(at, at[1:])], 10)
    data, rows = decontaminate.plain_words(pa.array([f"x {items[3]} y", None, items[150]]))
    walked, walk = [], decontaminate.Index.walk
    monkeypatch.setattr(decontaminate.Index, "walk", lambda self, entry, *more: walked.append(len(entry)) or walk(self, entry, *more))
    whole = list(index.matches(data, rows, 0.1))
    monkeypatch.setattr(decontaminate, "_WINDOWS", 500)
    walked.clear()
    assert list(index.matches(data, rows, 0.1)) == whole and max(walked) <= 500 < sum(walked)
    assert {(0, 3, 0, 1), (2, 150, 0, 0)} <= set(whole)


@pytest.mark.parametrize("share", [1, 1000])
def test_very_common_lines(spark, monkeypatch, share):
    """Every third line of all is one key, with keys above and below the look-up's share; more often than once in a text."""
    monkeypatch.setattr(store, "HOT_KEYS", share)
    common, rare = "the one line that all of them hold", "a line held by three or four only"
    rows = [(i, f"{common}\nown line number {i} of this text\n{' ' + common.upper() if i % 2 else rare if i % 50 == 0 else 'z'}") for i in range(200)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        gone = {common} if i < 199 else set()
        gone |= {rare} if i < 150 else set()
        kept = [x for x in text.split("\n") if x.strip().lower() not in gone]
        assert got[i].text == "\n".join(kept) and got[i].n_dropped == 3 - len(kept)


def test_line_dedup(spark, docs, empty):
    common, rare = "This line is found in many documents", "this one is in two documents only"
    rows = [(k, f"own {k}\n  {common.upper() if k % 2 else common} \n{rare if k < 2 else ''}\nshort") for k in range(6)]
    rows += [(6, None), (7, ""), (8, f"{common}\n{common}\n\n"), (None, common)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(table).collect()}
    assert got[0].text == f"own 0\n{rare}\nshort" and got[0].n_dropped == 1 and got[5].text == "own 5\n\nshort"
    assert got[8].text == rows[8][1] and got[6].text == got[7].text == "" and got[7].n_lines == 1 and got[None].text == common
    maps = {r.doc_id: r.keep_runs for r in line_dedup.keep_bitmaps(table).collect()}
    assert maps[0] == [1, 1, 2] and 8 not in maps
    assert line_dedup.dedup_lines(docs).count() == docs.count() and line_dedup.dedup_lines(empty).count() == 0


def test_source_mix(spark, empty):
    r = random.Random(2)
    names = ["b", "a", "Z", None, "one"]
    rows = [(k, prose(r.randint(0, 60), k) if k % 17 else None, r.choice(names[:4]) if k else "one") for k in range(500)]
    table = spark.createDataFrame(rows + rows[5:7], "doc_id long, text string, source string")
    got = source_mix.taken_words(table).collect()
    assert got == source_mix.taken_words(table.repartition(7)).collect() or sorted(map(str, got)) == sorted(map(str, source_mix.taken_words(table.repartition(7)).collect()))
    assert len(got) == 502
    size, source = collections.Counter(), {k: s for k, _, s in rows}
    for k, t, s in rows + rows[5:7]:
        size[s] += len((t or "").split())
    taken, target = collections.Counter(), {}
    for x in got:
        assert x.source_size == size[source[x.doc_id]] and x.taken <= 2 * x["size"]
        taken[source[x.doc_id]] += x.taken
        target[source[x.doc_id]] = x.target
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    assert all(target[s] <= 2 * size[s] + 1e-6 and abs(taken[s] - target[s]) <= 1 for s in target)
    # the same in plain Python: each source's shuffled stream, its first target words
    place = lambda i: (int(hashlib.md5(f"7:{i}".encode()).hexdigest()[:15], 16), i)
    once = {}
    for s in target:
        stream = [w for k in sorted((k for k, _, x in rows if x == s and k not in (5, 6)), key=place) for w in [k] * len((rows[k][1] or "").split())]
        stream = stream if s not in (source[5], source[6]) else None
        for w in (stream * 2)[: int(target[s] + 0.5)] if stream else []:
            once[w] = once.get(w, 0) + 1
    plain = [s for s in target if s not in (source[5], source[6])]
    assert plain and [(x.doc_id, x.taken, once.get(x.doc_id, 0)) for x in got if source[x.doc_id] in plain and x.taken != once.get(x.doc_id, 0)] == []
    assert source_mix.taken_words(empty).count() == 0


def test_blocks_of_the_schedule_cover_what_is_taken(spark):
    """Any block size takes the same words; the pieces of a source follow its stream without gap or overlap."""
    rows = [(k, prose(random.Random(k).randint(0, 50), k), f"s{k % 7}") for k in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sums = []
    for block in (10, 2048):
        pieces, documents = source_mix.mix_sources(table, block=block)
        got = pieces.orderBy("source", "place").collect()
        assert all(b.place == a.place + a.n_words for a, b in zip(got, got[1:]) if a.source == b.source)
        sums.append(sorted((r.doc_id, r["sum(n_words)"]) for r in pieces.groupBy("doc_id").sum("n_words").collect()))
    assert sums[0] == sums[1]


def test_very_many_sources(spark):
    goals = spark.range(20_000).select(F.concat(F.lit("s"), "id").alias("source"), F.lit(50).alias("source_size"), F.lit(60.0).alias("target"))
    plan = source_mix.schedule(goals, 10)
    assert plan.count() == plan.select("source", "rank").distinct().count() == 120_000


def test_schedule_is_even(spark):
    goals = spark.createDataFrame([("a", 100, 6000.0), ("b", 100, 3000.0), (None, 100, 1000.0)], "source string, source_size long, target double")
    rows = source_mix.schedule(goals, 1).orderBy("slot").collect()
    n = collections.Counter()
    for k, r in enumerate(rows[:9900]):
        assert r["rank"] == n[r.source]
        n[r.source] += 1
        assert all(abs(n[s] - (k + 1) * w) < 12 for s, w in (("a", 0.6), ("b", 0.3), (None, 0.1)))
    assert collections.Counter(r.source for r in rows) == {"a": 6000, "b": 3000, None: 1000}
    want = [((k + 1) * source_mix.GOLDEN % 2**64) / 2**64 for k in range(100)]
    assert [r.source for r in rows[:100]] == ["a" if u < 0.6 else "b" if u < 0.9 else None for u in want]


def test_gradients():
    net = gru_lang.Network(["x", "y"], seed=1)
    for p in net.parameters():
        p *= 1.5
    batch, labels = [b"abc", b"de", b"fghij"], np.array([0, 1, 1])

    def loss():
        p, (_, _, mask, *_) = net.run(batch)
        return -(np.log(p[:, np.arange(3), labels]) * mask).sum() / mask.sum()

    grads = net.gradients(batch, labels)
    for p, g in zip(net.parameters(), grads):
        for at in list(np.ndindex(p.shape))[:: max(1, p.size // 40)] + [np.unravel_index(np.abs(g).argmax(), p.shape)]:
            was, step = p[at], 2e-2
            p[at] = was + step
            up = loss()
            p[at] = was - step
            down = loss()
            p[at] = was
            assert g[at] == pytest.approx((up - down) / (2 * step), abs=3e-3)


def test_windows_label_every_position_once():
    texts = ["", "a", "é" * 100, prose(30, 1), "漢字" * 40]
    data, at = words.text_buffers(pa.array(texts))
    text, begin, end, low, high = gru_lang.windows(data, at, 16, 5)
    for k in range(len(texts)):
        mine = np.flatnonzero(text == k)
        covered = [p for w in mine for p in range(low[w], high[w])]
        assert covered == list(range(at[k], at[k + 1])) and all(at[k] <= begin[w] <= low[w] and high[w] <= end[w] <= at[k + 1] for w in mine)
    assert all(bytes(data[i:j]).decode() for i, j in zip(low, high))  # cut between characters


def test_reading_equals_the_trained_network():
    """Windows with enough context give what one pass over the whole text gives, blanks and digits included."""
    net = gru_lang.Network(["x", "y", "z"], seed=4)
    texts = [prose(40, 1) + " 12 !?", "É " * 30, "a"]
    data, at = words.text_buffers(pa.array(texts))
    want = []
    for t in texts:
        p, _ = net.run([gru_lang._FOLD[np.frombuffer(t.encode(), np.uint8)].tobytes()])
        want.append(p[:, 0].mean(axis=0))
    assert net.pooled(data, at, core=1 << 20) == pytest.approx(np.array(want), abs=1e-5)
    assert net.pooled(data, at, core=32, context=64) == pytest.approx(np.array(want), abs=1e-3)


def test_what_is_no_letter():
    assert not any(map(gru_lang.has_letter, ["", "12 ²½Ⅷ① _-!", "\u0301"])) and all(map(gru_lang.has_letter, ["漢", "1é", "x", "ª"]))


def test_languages(spark, docs, empty, monkeypatch):
    r = random.Random(3)
    make = lambda letters, n: " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(n))
    rows = [(k, make("abcdeimno" if k % 2 else "rstuvwxyz", r.randint(3, 60)), "p" if k % 2 else "q") for k in range(200)]
    rows += [(900, None, "p"), (901, "12 ²½Ⅷ① !?", "q"), (902, "ABC dem", None)]
    got = {x.doc_id: x for x in gru_lang.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [x for x in got.values() if x.held_out and x.doc_id < 900]
    assert held and all(x.lang_pred == ("p" if x.doc_id % 2 else "q") for x in held)
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "p" and all(0 <= x.score <= 1 for x in got.values())
    assert {x.held_out for x in got.values()} == {True, False}
    assert gru_lang.identify_languages(empty).count() == 0
    assert {x.lang_pred for x in gru_lang.identify_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_url_rules(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("x.test", "/ab", "block"), (None, "/", "block")]
    urls = ["http://A.example.NET/en/1?x#y", "https://b.example.net/de/", "http://example.com/de/x", "http://notexample.com/de/x", "http://example.com/de", "ftp://net", "http://x.test/abc/d", "nothing", None, "http://org/fr/#", "http://a.b.c.net/x://y"]
    pages = spark.createDataFrame([*enumerate(urls), (0, urls[0]), (None, urls[1])], "page_id long, url string")
    table = spark.createDataFrame(rules, "host string, path string, action string")
    want = {}
    for u in urls:
        after = u.split("://", 1)[1] if u and "://" in u else None
        host = re.match(r"[^/?#]*", after)[0].lower() if after is not None else ""
        path = re.match(r"[^/?#]*([^?#]*)", after)[1] if after is not None else ""
        fit = [(len(h + p), h + p, a) for h, p, a in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        want[u] = (host, path, *(max(fit)[1:] if fit else (None, "allow")))
    got = url_rules.judge_urls(pages, table).collect()
    assert sorted(map(str, ((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got))) == sorted(map(str, ((r.page_id, *want[r.url]) for r in pages.collect())))
    small, url_rules.SMALL_RULES = url_rules.SMALL_RULES, 1
    try:
        assert sorted(map(str, url_rules.judge_urls(pages, table).collect())) == sorted(map(str, got))
    finally:
        url_rules.SMALL_RULES = small
    assert url_rules.judge_urls(pages.where("false"), table).count() == 0 and url_rules.judge_urls(pages, table.where("false")).where("verdict = 'allow'").count() == 13


def test_very_long_and_very_common_urls(spark):
    rules = spark.createDataFrame([("net", "/", "block"), ("a.net", "/s/s", "allow"), ("ab", "c", "block")], "host string, path string, action string")
    long = f"http://{'a.' * 10_000}net/{'s/' * 10_000}"
    pages = spark.createDataFrame([(1, long), (2, "http://abc"), *[(k, "http://x.net/1") for k in range(3, 400)]], "page_id long, url string")
    url_rules.judge_urls(pages.where("page_id > 1"), rules).collect()
    began = time.perf_counter()
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge_urls(pages, rules).collect()}
    assert time.perf_counter() - began < 20  # no expression for each pair of a label and a segment
    assert got[1] == ("a.net/s/s", "allow") and got[2] == (None, "allow") and all(got[k] == ("net/", "block") for k in range(3, 400))


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return sets, {i: find(i) for i in ids}


@pytest.mark.parametrize("run", [256, 4])
def test_near_duplicates(spark, docs, empty, monkeypatch, run):
    monkeypatch.setattr(near_dedup, "RUN", run)
    r = random.Random(6)
    rows = list(enumerate(texts()))
    for k in range(40):  # one family in which few pairs are close and the rest are not quite
        w = prose(80, 77).split()
        for _ in range(r.randint(0, 4)):
            w[r.randrange(80)] = f"n{r.random()}"
        rows.append((500 + k, " ".join(w)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets, component = brute_components(rows)
    assert {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in got} == {i: (len(s), component[i], component[i] == i) for i, s in sets.items()}
    if run == 256:
        odd = near_dedup.near_duplicates(docs).collect()
        assert len(odd) == docs.count() and [x for x in odd if x.doc_id is None][0].kept
        assert near_dedup.near_duplicates(empty).count() == 0


def test_merged_lists_are_the_collisions():
    r = np.random.default_rng(3)
    left = r.integers(0, 3, (70, 16)).astype(np.uint32)
    right = np.concatenate([left[:30], r.integers(0, 3, (40, 16)).astype(np.uint32)])
    for match in (1, 6, 9, 16):
        want = np.argwhere((left[:, None, :] == right[None]).sum(axis=2) >= match).tolist()
        for wide in (1 << 21, 50):
            with pytest.MonkeyPatch.context() as patch:
                patch.setattr(near_dedup, "_WIDE", wide)
                i, j = near_dedup.merge_lists(left, right, match)
            assert sorted(zip(i.tolist(), j.tolist())) == sorted(map(tuple, want))


def test_near_duplicates_in_a_group_of_thousands(spark):
    """Edits of one text at all distances, so that hub, members and chains of links all matter."""
    r, base, rows = random.Random(8), prose(60, 9).split(), []
    for k in range(2000):
        w = list(base)
        for _ in range(r.choice((0, 1, 1, 2, 2, 3, 4, 6))):
            w[r.randrange(60)] = f"n{r.random()}"
        rows.append((k, " ".join(w)))
    sets = [shingle_set(t) for _, t in rows]
    number = {x: k for k, x in enumerate(sorted(set().union(*sets)))}
    held = np.zeros((2000, len(number)), np.float32)
    for k, x in enumerate(sets):
        held[k, [number[y] for y in x]] = 1
    both, size = np.rint(held @ held.T).astype(int), held.sum(axis=1).astype(int)
    linked = 100 * both >= 75 * (size[:, None] + size[None, :] - both)
    component = np.arange(2000)
    while True:
        new = np.where(linked, component[None, :], 2000).min(axis=1)
        if (new == component).all():
            break
        component = new
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(set(component)) > 100 and got == dict(enumerate(component.tolist()))


def test_digest_of_the_kept_text(spark):
    table = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    row = line_dedup.dedup_lines(table).select(F.sha2(F.col("text").cast("binary"), 256).alias("h")).first()
    assert row.h == hashlib.sha256(b"a\nb").hexdigest()


def test_the_sessions_batch_size_stays(spark, docs):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    bloom_lm.score_documents(docs).count()
    assert spark.conf.get(name) == before


def _peak(call):
    """Bytes of the arrays that ``call`` has at once."""
    tracemalloc.start()
    try:
        call()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_language_windows_are_added_up_in_small_pieces():
    net, text = gru_lang.Network(["de", "en", "fr", "nl"]), np.full(gru_lang.CORE * 256, 97, np.uint8)
    readings = 2 * 4 * 4 * 256 * (gru_lang.CORE + 2 * gru_lang.CONTEXT)  # both, float32, four languages
    assert _peak(lambda: net.pooled(text, np.array([0, len(text)]))) < readings + (8 << 20)


def test_one_list_for_all_members_is_merged_in_small_pieces():
    sig = np.random.default_rng(3).integers(0, 2**32, (512, 64), dtype=np.uint32)
    sig[:, :60] = 7  # every member is on 60 lists with all others
    assert _peak(lambda: near_dedup.merge_lists(sig, sig, 34)) < 64 << 20


def test_near_duplicates_run_with_small_batches(spark, docs, monkeypatch):
    name, used = "spark.sql.execution.arrow.maxRecordsPerBatch", {}
    before, keep = spark.conf.get(name), near_dedup.keep
    monkeypatch.setattr(near_dedup, "keep", lambda df, table: (used.setdefault(table, spark.conf.get(name)), keep(df, table))[1])
    near_dedup.near_duplicates(docs).count()
    with_workers = ("sketch", "postings", "near-hubs", "hub-links", "near-runs", "run-links")
    assert {used[t] for t in with_workers} == {"512"} and spark.conf.get(name) == before


def test_near_duplicates_have_small_plans(spark, docs, monkeypatch):
    """The driver's memory follows the largest plan (368 operators before steps that are read twice were kept)."""
    joins, keep = {}, near_dedup.keep

    def counted(df, table):
        joins[table] = df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
        return keep(df, table)

    monkeypatch.setattr(near_dedup, "keep", counted)
    near_dedup.near_duplicates(docs).count()
    assert {"hub-links", "near-runs", "run-links"} <= set(joins) and max(joins.values()) <= 6, joins


def test_closed_and_open_gates_are_read_as_they_are_trained():
    """Sums far beyond what exp can hold give gates of 0 and 1, and no warning or NaN."""
    net = gru_lang.Network(["x", "y"], seed=4)
    for way in net.ways:
        way.inputs *= 500
    data, at = words.text_buffers(pa.array([prose(40, 1), "a"]))
    want = [net.run([gru_lang._FOLD[data[i:j]].tobytes()])[0][:, 0].mean(axis=0) for i, j in zip(at, at[1:])]
    with np.errstate(invalid="raise", divide="raise"):
        assert net.pooled(data, at, core=1 << 20) == pytest.approx(np.array(want), abs=1e-4)


def test_reading_takes_no_tanh(monkeypatch):
    """numpy's tanh takes twice the time of its exp, and was two fifths of the reading."""
    net = gru_lang.Network(["x", "y"], seed=4)
    monkeypatch.setattr(np, "tanh", lambda *_, **__: pytest.fail("tanh"))
    assert net.pooled(*words.text_buffers(pa.array(["abc"]))).sum() == pytest.approx(1)
