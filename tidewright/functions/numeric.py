"""Sequential helpers on one key's arrays; numpy only."""

from __future__ import annotations

import numpy as np


SCALE = 1_000_000  # amounts and prices in whole millionths, so that sums are exact wherever a series is cut


def bar_starts(amounts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where bars end, for every place at which one could begin: ``sums, last, bars``.

    From a bar that begins at b, ``bars[b]`` bars are completed in these amounts
    and ``last[b]`` is where the unfinished one begins.  A bar is full when its
    amounts, added up one by one, reach the threshold; where the prefix sums are
    too near to it to tell, they are added up.  The table of next beginnings is
    composed with itself until nothing changes (pointer doubling).
    """
    sums, n = np.cumsum(amounts, dtype=np.longdouble), len(amounts)
    before = np.r_[0, sums]
    slack = 2 * (n + 1) * (np.finfo(float).eps * threshold + np.finfo(np.longdouble).eps * (sums[-1] + threshold))  # more than both kinds of sums round
    end, sure = (np.searchsorted(sums, before + (threshold + x)) + 1 for x in (-slack, slack))
    for b in np.flatnonzero(end < sure):
        end[b] = b + np.searchsorted(np.cumsum(amounts[b : sure[b]], dtype=float), threshold) + 1
    done = end <= n
    last, bars = np.where(done, end, np.arange(n + 1)), done.astype(np.int64)
    while (last[last] != last).any():
        bars = bars + bars[last]
        last = last[last]
    return sums, last, bars


def bar_function(amounts: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """What a chunk makes of an amount that enters it: ``need, bars, left, total``.

    An amount of at least ``need[k]`` (falling) and of no earlier entry completes
    ``bars[k]`` bars and leaves ``left[k]``; one that reaches none leaves itself
    and ``total``.  There are as many entries as amounts in the first bar, fewer
    where neighbours come to the same.
    """
    sums, last, bars = bar_starts(amounts, threshold)
    first = min(int(np.searchsorted(sums, threshold)) + 1, len(sums))
    need, after = threshold - sums[:first], np.arange(1, first + 1)
    made, left = 1 + bars[after], sums[-1] - np.r_[0, sums][last[after]]
    ends = np.r_[(np.diff(made) != 0) | (np.diff(left) != 0), True]  # of equal neighbours, the last asks least
    return need[ends], made[ends], left[ends], int(sums[-1])


def bar_links(amounts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a chunk is to an amount that enters it: ``head, bars, left, tail``.

    The bar that enters is full with one of ``head`` or lasts beyond the chunk.
    If ``head[i]`` fills it, ``bars[i]`` bars are completed and the unfinished one
    has the last ``left[i]`` of ``tail``.  Both are as long as a bar at most, and
    hold the amounts themselves, so that sums run on as if nothing were cut.
    """
    amounts = amounts[amounts != 0]
    if not len(amounts):
        return amounts, *np.zeros((2, 0), np.int64), amounts
    _, last, bars = bar_starts(amounts, threshold)
    after = np.arange(1, min(int(np.searchsorted(np.cumsum(amounts), threshold)) + 1, len(amounts)) + 1)
    return amounts[: len(after)], 1 + bars[after], len(amounts) - last[after], amounts[last[after].min() :]


def bar_numbers(amounts: np.ndarray, threshold: float, entering: float = 0.0) -> np.ndarray:
    """Number of the bar of each trade from 0, the unfinished last one too. An amount restarts at 0 after a bar.

    Amounts are added up one by one from a bar's beginning, over stretches that grow while it is not full.
    """
    ids, begin, k, held, look = np.empty(len(amounts), np.int64), 0, 0, entering, 64
    while begin < len(amounts):
        sums = amounts[begin : begin + look].astype(float)
        sums[0] += held
        sums = np.cumsum(sums)
        end = int(np.searchsorted(sums, threshold))
        ids[begin : begin + end + 1] = k
        if end < len(sums):
            begin, k, held, look = begin + end + 1, k + 1, 0.0, max(64, 2 * (end + 1))
        else:
            begin, held, look = begin + end, sums[-1], 2 * look
    return ids


def is_full(amounts: np.ndarray, threshold: float) -> bool:
    return bool(np.cumsum(amounts)[-1] >= threshold)


def bar_ids(amounts: np.ndarray, threshold: float) -> np.ndarray:
    """As ``bar_numbers``, but -1 in the unfinished last bar."""
    ids = bar_numbers(amounts, threshold)
    return np.where((ids == ids[-1]) & (not is_full(amounts[ids == ids[-1]], threshold)), -1, ids) if len(ids) else ids


def cusum_hits(values: np.ndarray, h: float) -> np.ndarray:
    """Where the symmetric CUSUM of the differences passes ``h``."""
    return cusum_walk(values, h)[0]


def cusum_walk(values: np.ndarray, h: float, up: int = 0, down: int = 0) -> tuple[np.ndarray, int, int]:
    """Where the sum of rises since its lowest point passes ``h``, or that of falls; the one that does restarts at 0.

    ``up, down`` are the sums on entering, and are returned as they leave.  From
    hit to hit over stretches that grow while none is found, so that work follows
    the values and the hits, without a step per value.
    """
    moves = np.diff(values)
    hit = np.zeros(len(values), bool)
    at, look = 0, 64
    while at < len(moves):
        part = np.cumsum(moves[at : at + look])
        rise, fall = part + up, part + down
        rise = rise - np.minimum.accumulate(np.minimum(rise, 0))
        fall = fall - np.maximum.accumulate(np.maximum(fall, 0))
        passed = (fall < -h) | (rise > h)
        end = int(passed.argmax()) if passed.any() else len(part) - 1
        up, down = rise[end].item(), fall[end].item()
        if passed.any():
            hit[at + end + 1] = True
            if down < -h:
                down = 0
            else:
                up = 0
            look = max(64, 2 * (end + 1))
        else:
            look *= 2
        at += end + 1
    return hit, up, down


class SumTree:
    """Weights under a tree of sums: a run of weights is changed, and a weight is found by its cumulative sum."""

    FAN = 32

    def __init__(self, weights: np.ndarray):
        self.levels = [self._whole(weights)]
        while len(self.levels[-1]) > self.FAN:
            self.levels.append(self._whole(self.levels[-1].reshape(-1, self.FAN).sum(1)))

    def _whole(self, x: np.ndarray) -> np.ndarray:
        return np.r_[x, np.zeros(-len(x) % self.FAN)]

    def change(self, begin: int, weights: np.ndarray) -> None:
        end = begin + len(weights)
        self.levels[0][begin:end] = weights
        for low, high in zip(self.levels, self.levels[1:]):
            begin, end = begin // self.FAN, -(-end // self.FAN)
            high[begin:end] = low[begin * self.FAN : end * self.FAN].reshape(-1, self.FAN).sum(1)

    def find(self, share: float) -> int:
        """The weight in which this share of all weights ends."""
        at, rest = 0, share * float(self.levels[-1].sum())
        for level in reversed(self.levels):
            sums = level[at * self.FAN : (at + 1) * self.FAN].cumsum()
            k = min(int(np.searchsorted(sums, rest, "right")), int(np.flatnonzero(np.diff(sums, prepend=0.0) > 0)[-1]))
            rest -= float(sums[k - 1]) if k else 0.0
            at = at * self.FAN + k
        return at


def draw_sequential(first: np.ndarray, last: np.ndarray, draws: int, rng: np.random.Generator) -> np.ndarray:
    """Events drawn with probabilities in proportion to their uniqueness among those drawn before.

    A drawn event changes the uniqueness of those that overlap it and of no
    others: in order of their first bar they lie between the first event that
    reaches it and the last one that begins in it, so a draw costs that stretch
    and a path down the tree, not a pass over all events and bars.
    """
    order = np.argsort(first, kind="stable")
    begins, ends = first[order], last[order]
    reach = np.maximum.accumulate(ends)
    span = (ends - begins + 1).astype(float)
    depth = np.zeros(int(last.max()) + 1)
    tree = SumTree(np.ones(len(first)))  # alone, every event is unique
    drawn = np.empty(draws, np.int64)
    for k in range(draws):
        at = tree.find(rng.random())
        a, b = begins[at], ends[at]
        depth[a : b + 1] += 1
        low, high = np.searchsorted(reach, a), np.searchsorted(begins, b, "right")
        left = begins[low]
        inverse = np.r_[0.0, np.cumsum(1 / (depth[left : reach[high - 1] + 1] + 1))]
        tree.change(low, (inverse[ends[low:high] + 1 - left] - inverse[begins[low:high] - left]) / span[low:high])
        drawn[k] = order[at]
    return drawn


def mean_uniqueness(first: np.ndarray, last: np.ndarray, drawn: np.ndarray) -> float:
    depth = np.zeros(int(last.max()) + 2)
    np.add.at(depth, first[drawn], 1)
    np.add.at(depth, last[drawn] + 1, -1)
    inverse = np.r_[0.0, np.cumsum(1 / np.maximum(np.cumsum(depth)[:-1], 1))]
    return float(((inverse[last + 1] - inverse[first]) / (last - first + 1))[drawn].mean())


def respected_lines(high: np.ndarray, at: np.ndarray, price: np.ndarray, since: int, tol: float, max_span: int | None, tail: tuple) -> list[tuple]:
    """Falling or flat lines between peaks ``at, price`` that end at bar ``since`` or later, clear every inner bar by ``tol`` and touch a peak.

    From an end, slopes to the bars before it are taken once; their running
    maximum drops the starts behind a bar that stands out, up to rounding, and
    the exact test runs on the lines that are left.
    """
    out = []
    for e in np.flatnonzero(at >= since):
        begin = 0 if max_span is None else int(np.searchsorted(at, at[e] - max_span))
        starts = np.arange(begin, e)[::-1]
        starts = starts[price[starts] >= price[e]]
        if not len(starts):
            continue
        low = at[starts[-1]]
        back = np.arange(at[e] - 1, low, -1)
        steepest = np.maximum.accumulate(np.r_[-np.inf, (high[back] - price[e] - tol) / (at[e] - back)])
        slope = (price[starts] - price[e]) / (at[e] - at[starts])
        for s in starts[steepest[at[e] - 1 - at[starts]] < slope + 1e-6 * (1 + slope)]:
            rate = (price[e] - price[s]) / (at[e] - at[s])
            inside = np.arange(at[s] + 1, at[e])
            if (high[inside] - (price[s] + rate * (inside - at[s])) < tol).all():
                between = slice(s + 1, e)
                touches = int((np.abs(high[at[between]] - (price[s] + rate * (at[between] - at[s]))) < tol).sum())
                if touches:
                    out.append((int(at[s]), int(at[e]), float(price[s]), float(price[e]), int(at[e] - at[s]), int(e - s), float(rate), *tail, touches))
    return out


def convolved(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """All sums of products of two series: ``np.convolve``, which rounds least, and by Fourier transform where that is slow."""
    if len(x) * len(w) <= 1 << 24:
        return np.convolve(x, w)
    n = len(x) + len(w) - 1
    size = 1 << (n - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(w, size), size)[:n]


def closest(q: np.ndarray, at: np.ndarray, reach: np.ndarray, x: np.ndarray, dist: np.ndarray, ids: np.ndarray, k: int, leave: np.ndarray | None = None, pairs: int = 1 << 22) -> tuple:
    """Of each row of ``q`` the ``k`` nearest rows of ``x`` within its ``reach``, ties by id: ``i, j, d`` (squared), and the distances taken.

    ``at`` and ``dist`` (rising) are distances to one point, from which the
    triangle inequality tells rows that are too far.  A matrix product gives the
    other distances up to rounding (single precision, ``pairs`` at once), and what
    can be among the nearest with more slack than that is summed in doubles,
    component by component.  Row i does not count the id ``leave[i]``.
    """
    more, width = k + (leave is not None), x.shape[1]
    middle = x.mean(0)
    a, b = q - middle, x - middle
    aa, bb = (a * a).sum(1), (b * b).sum(1)
    unit = max(aa.max(), bb.max(), np.finfo(float).tiny)  # so that nothing overflows
    slack = 4 * (width + 10) * np.finfo(np.float32).eps * (np.sqrt(aa / unit) + np.sqrt(bb.max() / unit)) ** 2 + 1e-30
    limit = np.minimum(reach * reach / unit + slack, 5.0).astype(np.float32)  # no distance is over 4 units
    left = np.c_[a / np.sqrt(unit), aa / unit, np.ones(len(a))].astype(np.float32)
    right = np.c_[b * (-2 / np.sqrt(unit)), np.ones(len(b)), bb / unit].astype(np.float32)
    order, out, tested = np.argsort(at, kind="stable"), [], 0
    step = max(1, min(1024, pairs // len(x)))
    for s in range(0, len(order), step):
        part = order[s : s + step]
        low, high = np.searchsorted(dist, (at - reach)[part].min()), np.searchsorted(dist, (at + reach)[part].max(), "right")
        if low == high:
            continue
        tested += len(part) * int(high - low)
        near = left[part] @ right[low:high].T
        close = near <= limit[part, None]
        crowded = np.flatnonzero(np.bitwise_count(np.packbits(close, axis=1)).sum(1, dtype=np.int64) > 4 * more)
        if len(crowded):
            some = near[crowded]
            kth = np.partition(some, more - 1, axis=1)[:, more - 1]
            close[crowded] &= some <= (kth + 2 * slack[part[crowded]]).astype(np.float32)[:, None]
        i, j = np.divmod(np.flatnonzero(close), high - low)
        i, j = part[i], low + j
        if leave is not None:
            others = ids[j] != leave[i]
            i, j = i[others], j[others]
        d, some = np.empty(len(i)), max(1, (1 << 21) // width)
        for t in range(0, len(i), some):
            d[t : t + some] = np.cumsum((q[i[t : t + some]] - x[j[t : t + some]]) ** 2, axis=1)[:, -1]
        nearest = np.lexsort((ids[j], d, i))
        i, j, d = i[nearest], j[nearest], d[nearest]
        best = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((i[best], j[best], d[best]))
    return *(np.concatenate(c) for c in zip((np.empty(0, int), np.empty(0, int), np.empty(0)), *out)), tested


def first_copies(x: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Of all equal rows of ``x`` the ``n`` with the smallest ids: their positions."""
    same = np.unique(np.ascontiguousarray(x + 0.0).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_inverse=True)[1]
    order = np.lexsort((ids, same))
    return order[np.arange(len(x)) - np.searchsorted(same[order], same[order]) < n]


def _first_passed(running: np.ndarray, barriers: np.ndarray) -> np.ndarray:
    """For rising rows and sorted barriers: the column at which a row first exceeds each barrier, else its length."""
    rows, width = running.shape
    level = np.searchsorted(barriers, running.ravel(), "left") + np.repeat(np.arange(rows), width) * (len(barriers) + 1)
    counts = np.bincount(level, minlength=rows * (len(barriers) + 1)).reshape(rows, -1)
    return counts.cumsum(1)[:, :-1]  # columns that exceed no more than the barriers before


def grid_sums(moves: list, takes: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Numbers, sums and squares of the exit moves of all rules (take, stop), both sorted: an array (3, takes, stops).

    A path passes ``takes[i]`` before ``stops[j]`` for all j from some one on, and
    the other way round, so each barrier adds its move at the beginning of a run
    of rules and running sums do the rest.
    """
    length = np.array([len(m) for m in moves])
    path = np.full((len(moves), length.max() + 1), np.nan)  # the last column stays empty
    path[np.arange(path.shape[1])[None, :] < length[:, None]] = np.concatenate(moves)
    final = path[np.arange(len(path)), length - 1]
    filled = np.where(np.isnan(path), final[:, None], path)
    up, down = np.maximum.accumulate(filled, 1), np.maximum.accumulate(-filled, 1)
    take, stop = _first_passed(up, takes), _first_passed(down, stops)
    never = path.shape[1]
    total = np.zeros((3, len(takes) + 1, len(stops) + 1))
    add = lambda i, j, gain: [np.add.at(part, (i, j), x) for part, x in zip(total, (np.ones(len(gain)), gain, gain * gain))]
    out = np.zeros((3, len(takes), len(stops)))
    for i in range(len(takes)):
        row = np.flatnonzero(take[:, i] < never)
        add(np.full(len(row), i), (stop[row] < take[row, i][:, None]).sum(1), filled[row, take[row, i]])
    out += total[:, :-1, :].cumsum(2)[:, :, :-1]
    total[:] = 0
    for j in range(len(stops)):
        row = np.flatnonzero(stop[:, j] < never)
        add((take[row] <= stop[row, j][:, None]).sum(1), np.full(len(row), j), filled[row, stop[row, j]])
    out += total[:, :, :-1].cumsum(1)[:, :-1, :]
    total[:] = 0
    add((take < never).sum(1), (stop < never).sum(1), final)
    return out + total.cumsum(1).cumsum(2)[:, :-1, :-1]
