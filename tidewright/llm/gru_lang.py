"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of the whole text forward and backward, labels
every byte (of words, blanks, digits and signs alike), and a document's
probabilities are the means over all its positions.  It is trained by
backpropagation through time in numpy.  Texts are read in windows of CORE bytes,
cut between characters, each with up to CONTEXT bytes before and after it, in
which the states warm up and which are not counted: so a text of any length is
many windows of one batch instead of one long chain of steps.

Training draws spans from whole texts of a bounded sample of labelled rows:
DOCS_A_LANGUAGE documents of each language, chosen by hash over all rows, up to
the one with which BYTES_A_LANGUAGE are reached.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import slices
from .words import text_buffers

DOCS_A_LANGUAGE, BYTES_A_LANGUAGE = 300, 4 << 20
HIDDEN, STEPS, BATCH, SPAN, RATE = 12, 200, 160, 48, 0.02
CORE, CONTEXT = 1024, 64
WINDOWS = 512  # that are read at once
MERGED = 32  # of these whose two readings are added at once
HELD_OUT = 2
UNDETERMINED = "und"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32  # A-Z count as a-z
_LATIN = re.compile("[A-Za-z]").search


def has_letter(text: str) -> bool:
    """Whether a character is a letter (Unicode categories L*; digits, numerals and signs are none)."""
    return _LATIN(text) is not None or any(map(str.isalpha, text))


def in_training(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) != HELD_OUT


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Gru:
    """One direction: byte rows for the three gates, recurrent weights, candidate weights."""

    inputs: np.ndarray  # 256 x 3H: update, reset, candidate
    gates: np.ndarray  # H x 2H
    candidate: np.ndarray  # H x H

    def forward(self, codes: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
        """States T x B x H of codes T x B; masked steps keep the state."""
        t, b = codes.shape
        size = self.candidate.shape[0]
        h, states, tape = np.zeros((b, size), np.float32), np.empty((t, b, size), np.float32), []
        for k in range(t):
            x = self.inputs[codes[k]]
            zr = _sigmoid(x[:, : 2 * size] + h @ self.gates)
            z, r = zr[:, :size], zr[:, size:]
            c = np.tanh(x[:, 2 * size :] + (r * h) @ self.candidate)
            new = np.where(mask[k][:, None], (1 - z) * h + z * c, h)
            tape.append((h, z, r, c))
            states[k] = h = new
        return states, tape

    def read(self, data: np.ndarray, begin: np.ndarray, step: int, active: list[int], out: np.ndarray) -> np.ndarray:
        """The states times ``out``, step after step: inference without a tape.

        Window k starts at byte ``begin[k]`` and moves by ``step`` (1 or -1);
        ``active[t]`` windows, the first ones, are longer than t.
        """
        size, b = self.candidate.shape[0], len(begin)
        # sigmoid(x) = 1 / (1 + exp(-x)), tanh(x) = 2 / (1 + exp(-2x)) - 1: numpy's exp takes half the time of its tanh
        signs = [np.float32(k) for k in (-1, -1, -2)]
        tables = [np.ascontiguousarray(self.inputs[:, k * size : (k + 1) * size]) * sign for k, sign in enumerate(signs)]
        update, reset = (np.ascontiguousarray(self.gates[:, k * size : (k + 1) * size]) * signs[k] for k in range(2))
        candidate = self.candidate * signs[2]
        h, zs, rs, cs, xs = np.zeros((5, b, size), np.float32)
        sums, done = np.empty((sum(active), out.shape[1]), np.float32), 0
        for t, n in enumerate(active):
            code = data[begin[:n] + step * t].astype(np.intp)
            hn, z, r, c, x = h[:n], zs[:n], rs[:n], cs[:n], xs[:n]
            for gate, weights, table in ((z, update, tables[0]), (r, reset, tables[1])):
                np.matmul(hn, weights, out=gate)
                gate += table.take(code, axis=0, out=x, mode="clip")
                np.exp(gate, out=gate)
                gate += 1
            np.divide(hn, r, out=r)
            np.matmul(r, candidate, out=c)
            c += tables[2].take(code, axis=0, out=x, mode="clip")
            np.exp(c, out=c)
            c += 1
            np.divide(2, c, out=c)
            c -= 1
            c -= hn
            c /= z
            hn += c
            np.matmul(hn, out, out=sums[done : done + n])
            done += n
        return sums

    def backward(self, codes: np.ndarray, mask: np.ndarray, tape: list, grads: np.ndarray) -> list[np.ndarray]:
        """Gradients of the three arrays, from those of the states."""
        size = self.candidate.shape[0]
        d_x, d_g, d_c = np.empty((*codes.shape, 3 * size), np.float32), np.zeros_like(self.gates), np.zeros_like(self.candidate)
        carry = np.zeros_like(grads[0])
        for k in range(len(codes) - 1, -1, -1):
            h, z, r, c = tape[k]
            m = mask[k][:, None]
            d = (carry + grads[k]) * m
            keep_ = (carry + grads[k]) * ~m
            dc = d * z * (1 - c * c)
            dz = d * (c - h) * z * (1 - z)
            drh = dc @ self.candidate.T
            dr = drh * h * r * (1 - r)
            dzr = np.concatenate([dz, dr], axis=1)
            d_c += (r * h).T @ dc
            d_g += h.T @ dzr
            d_x[k, :, : 2 * size], d_x[k, :, 2 * size :] = dzr, dc
            carry = d * (1 - z) + drh * r + dzr @ self.gates.T + keep_
        # the rows of one byte are summed as a run of their sorted order
        order = np.argsort(codes, axis=None, kind="stable")
        known, first = np.unique(codes.ravel()[order], return_index=True)
        d_in = np.zeros_like(self.inputs)
        d_in[known] = np.add.reduceat(d_x.reshape(-1, 3 * size)[order], first, axis=0)
        return [d_in, d_g, d_c]


def _padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes and mask, T x B, and the same codes read backward."""
    t = max(map(len, words))
    codes, back = np.zeros((t, len(words)), np.uint8), np.zeros((t, len(words)), np.uint8)
    mask = np.zeros((t, len(words)), bool)
    for k, w in enumerate(words):
        row = np.frombuffer(w, np.uint8)
        codes[: len(w), k], back[: len(w), k], mask[: len(w), k] = row, row[::-1], True
    return codes, back, mask


def _unreverse(states: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """States of the backward reading at the positions of the forward one (and the other way round)."""
    t = np.arange(len(states))[:, None]
    at = np.where(t < lengths[None, :], lengths[None, :] - 1 - t, t)
    return np.take_along_axis(states, at[:, :, None], axis=0)


class Network:
    def __init__(self, languages: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        size = HIDDEN
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.languages = languages
        self.ways = [Gru(normal(256, 3 * size, scale=0.3), normal(size, 2 * size, scale=0.25), normal(size, size, scale=0.25)) for _ in range(2)]
        self.out = normal(2 * size, len(languages), scale=0.2)
        self.bias = np.zeros(len(languages), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [p for way in self.ways for p in (way.inputs, way.gates, way.candidate)] + [self.out, self.bias]

    def run(self, words: list[bytes]):
        codes, back, mask = _padded(words)
        lengths = mask.sum(axis=0)
        ahead, tape_a = self.ways[0].forward(codes, mask)
        behind, tape_b = self.ways[1].forward(back, mask)
        states = np.concatenate([ahead, _unreverse(behind, lengths)], axis=2)
        logits = states @ self.out + self.bias
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        return e / e.sum(axis=2, keepdims=True), (codes, back, mask, lengths, states, tape_a, tape_b)

    def gradients(self, words: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy over all positions."""
        p, (codes, back, mask, lengths, states, tape_a, tape_b) = self.run(words)
        p[:, np.arange(len(words)), labels] -= 1
        p *= mask[:, :, None] / mask.sum()
        d_states = p @ self.out.T
        size = HIDDEN
        ga = self.ways[0].backward(codes, mask, tape_a, d_states[:, :, :size])
        gb = self.ways[1].backward(back, mask, tape_b, _unreverse(d_states[:, :, size:], lengths))
        flat = states.reshape(-1, 2 * size).T @ p.reshape(-1, p.shape[2])
        return [*ga, *gb, flat, p.sum(axis=(0, 1))]

    def train(self, texts: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = 5) -> None:
        """Adam over random spans of the texts, every byte of a language equally often, every language equally often."""
        rng = np.random.default_rng(seed)
        data = _FOLD[np.frombuffer(b"".join(texts), np.uint8)].tobytes()
        ends = np.cumsum([len(t) for t in texts])
        starts = ends - [len(t) for t in texts]
        groups = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        groups = [(g, np.cumsum(ends[g] - starts[g])) for g in groups if len(g)]
        params = self.parameters()
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            spans, span_labels = [], []
            for g, upto in groups:
                for at in rng.integers(0, upto[-1], BATCH // len(groups) + 1).tolist():
                    k = int(np.searchsorted(upto, at, "right"))
                    centre = int(ends[g[k]]) - (int(upto[k]) - at)
                    begin = max(int(starts[g[k]]), min(centre, int(ends[g[k]]) - SPAN))
                    spans.append(data[begin : min(begin + SPAN, int(ends[g[k]]))])
                    span_labels.append(labels[g[k]])
            grads = self.gradients(spans, np.array(span_labels))
            rate = RATE * (1 - 0.9 * step / steps) / (1 - 0.9**step)
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * m / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    def pooled(self, data: np.ndarray, at: np.ndarray, core: int = CORE, context: int = CONTEXT) -> np.ndarray:
        """Mean probabilities over all positions of each text (empty: zeros); text k is bytes at[k] to at[k + 1]."""
        data = _FOLD[data]
        table = np.stack(windows(data, at, core, context))
        table = table[:, np.argsort(table[1] - table[2], kind="stable")]  # long windows first
        out = np.zeros((len(at) - 1, len(self.languages)))
        for k in range(0, table.shape[1], WINDOWS):  # memory follows WINDOWS, however long a text is
            text, *edges = table[:, k : k + WINDOWS]
            np.add.at(out, text, self._core_sums(data, *edges))
        return out / np.maximum(np.diff(at), 1)[:, None]

    def _core_sums(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Summed probabilities over the core of each window; long windows come first."""
        length, size = end - begin, HIDDEN
        active = np.searchsorted(-length, -np.arange(int(length[0])), "left")
        before = np.cumsum(active) - active  # where each step's rows begin
        with np.errstate(over="ignore"):  # a gate whose exp is infinite is closed
            ahead = self.ways[0].read(data, begin, 1, active.tolist(), self.out[:size])
            behind = self.ways[1].read(data, end - 1, -1, active.tolist(), self.out[size:])
        # position i of window k is step i forward and step length - 1 - i backward; cores only
        return np.concatenate(
            [self._merged(ahead, behind, before, begin, length, low, high, k, k + MERGED) for k in range(0, len(begin), MERGED)]
        )

    def _merged(self, ahead, behind, before, begin, length, low, high, first: int, last: int) -> np.ndarray:
        """Summed probabilities of windows first to last; memory follows their number."""
        begin, length, low, count = begin[first:last], length[first:last], low[first:last], (high - low)[first:last]
        window = np.repeat(np.arange(len(begin)), count)
        edges = np.cumsum(count) - count
        i = np.arange(len(window)) - np.repeat(edges - (low - begin), count)
        logits = ahead.take(before[i] + first + window, axis=0)
        logits += behind.take(before[length[window] - 1 - i] + first + window, axis=0)
        logits += self.bias
        logits -= reduce(np.maximum, logits.T)[:, None]  # column by column: numpy reduces short rows slowly
        np.exp(logits, out=logits)
        logits /= reduce(np.add, logits.T)[:, None]
        return np.add.reduceat(logits, edges, axis=0, dtype=np.float64)


def windows(data: np.ndarray, at: np.ndarray, core: int, context: int):
    """``text, begin, end, low, high`` of the windows of all texts: [low, high) is the core, cut between characters."""
    size = np.diff(at)
    n = -(-size // core)
    text = np.repeat(np.arange(len(size)), n)
    number = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    low = at[:-1][text] + number * core
    inner = number > 0
    for _ in range(3):  # at most three bytes before it belong to the character
        inside = inner & (data[np.minimum(low, len(data) - 1)] & 0xC0 == 0x80)
        low = np.where(inside, low - 1, low)
    last = np.r_[text[1:] != text[:-1], True] if len(text) else np.zeros(0, bool)
    high = np.where(last, at[1:][text], np.r_[low[1:], 0][: len(low)])
    return text, np.maximum(low - context, at[:-1][text]), np.minimum(high + context, at[1:][text]), low, high


def training_sample(docs: DataFrame) -> DataFrame:
    """``lang, text``: the sample of ``docs(doc_id, text, lang)``; lengths are ranked, then its whole texts are read."""
    labelled = docs.where(F.col("lang").isNotNull() & in_training(F.col("doc_id")) & (F.octet_length("text") > 0))
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = labelled.select("lang", "doc_id", F.octet_length("text").alias("size")).withColumn("place", F.row_number().over(by_hash))
    chosen = chosen.where(F.col("place") <= DOCS_A_LANGUAGE)
    before = F.coalesce(F.sum("size").over(by_hash.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = chosen.withColumn("before", before).where(F.col("before") < BYTES_A_LANGUAGE)
    chosen = chosen.select(F.col("lang").alias("l"), F.col("doc_id").alias("d")).distinct()
    # at most DOCS_A_LANGUAGE keys of each language: a bounded side
    same = (F.col("lang") == F.col("l")) & (F.col("doc_id") == F.col("d"))
    return labelled.join(F.broadcast(chosen), same, "left_semi").select("lang", "text")


def train_network(docs: DataFrame) -> Network | None:
    """The network for the languages of the labelled rows; None where there are none."""
    rows = sorted((r.lang, r.text) for r in training_sample(docs).collect() if has_letter(r.text))  # the same order whatever the tasks'
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return None
    number = {lang: k for k, lang in enumerate(languages)}
    net = Network(languages)
    net.train([text.encode() for _, text in rows], np.array([number[lang] for lang, _ in rows]))
    return net


def _judge(net: Network | None, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    lettered = np.array([t is not None and has_letter(t) for t in column.to_pylist()], bool)
    names, scores = [UNDETERMINED] * len(column), np.zeros(len(column))
    if net is None or not lettered.any():
        return names, scores
    p = net.pooled(*text_buffers(column))
    for k in np.flatnonzero(lettered).tolist():
        names[k], scores[k] = net.languages[int(p[k].argmax())], min(float(p[k].max()), 1.0)
    return names, scores


def keep_identified(docs: DataFrame, least_score: float) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language with ``least_score`` or more.

    Null texts and texts without a letter go; where no labelled row can be
    learned from, every other row stays.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(train_network(docs.select("doc_id", "text", "lang")))

    def run(batches):
        for batch in slices(batches):
            if shared.value is None:
                good = [t is not None and has_letter(t) for t in batch.column("text").to_pylist()]
            else:
                names, scores = _judge(shared.value, batch.column("text"))
                good = [n != UNDETERMINED and s >= least_score for n, s in zip(names, scores)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify_languages(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, lang)`` to ``doc_id, held_out, lang_pred, score``, one row per input row.

    Null texts and texts without a letter are ``und`` with score 0, and so is
    everything where no labelled row can be learned from.  A null doc_id is
    neither in training nor held out (null).  Repeated rows are all returned.
    Other columns are not read; ``lang`` serves as a label in training only.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(train_network(docs.select("doc_id", "text", "lang")))

    def run(batches):
        for batch in slices(batches):
            names, scores = _judge(shared.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = texts.mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "lang_pred", "score")
