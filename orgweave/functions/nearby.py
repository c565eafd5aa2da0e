"""All pairs of two lists of texts from a similarity on, without loss: bounds over arrays rule pairs out, what they leave is scored exactly.

Letters that two texts have in common (``_Block.common``) bound each score from above; no pair is left out unless its score can't reach the limit.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import numpy as np

from orgweave.functions import similarity

#: Tolerance of the bounds, so that rounding never rules out a pair; pairs matched together; letters of a text whose subsequences are told by bits.
EPS, BATCH, LONG = 1e-4, 200_000, 256


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts one after the other, and the text that each belongs to."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), "<u4"), np.repeat(np.arange(len(texts)), [len(t) for t in texts])


def _letters(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of letters, by letter and text, of both lists."""
    (x, i), (y, j) = _codes(a), _codes(b)
    alphabet = np.union1d(x, y)
    kind = np.uint8 if max(map(len, a + b)) < 256 else np.uint32
    count = lambda c, o, n: np.bincount(np.searchsorted(alphabet, c) * n + o, minlength=len(alphabet) * n).reshape(len(alphabet), n).astype(kind)
    return count(x, i, len(a)), count(y, j, len(b))


class _Block:
    def __init__(self, a: list[str], b: list[str]):
        self.a, self.b = a, b
        self.la, self.lb = (np.array([len(t) for t in s]) for s in (a, b))
        self.ca, self.cb = _letters(a, b)

    def common(self, i: int) -> np.ndarray:
        """Letters in common, counted as often as both have them, of text i of a with each of b: an upper bound of any matching."""
        return _common(self.ca[:, i], self.cb)


def _common(one: np.ndarray, every: np.ndarray) -> np.ndarray:
    own = np.flatnonzero(one)
    return np.minimum(every[own], one[own, None]).sum(axis=0, dtype=every.dtype).astype("i4")


def _ratio(d: _Block, least: float) -> Iterator[tuple[int, int, float]]:
    for i, a in enumerate(d.a):
        for j in np.flatnonzero(200.0 * d.common(i) >= least * (d.la[i] + d.lb) - EPS).tolist():
            if (s := similarity.ratio(a, d.b[j])) >= least:
                yield i, j, s


def _matched(d: _Block) -> callable:
    """Function of arrays of places in a and b, for texts of 64 letters at most: of how many of each pair's letters Jaro's windows match, less
    the share out of order, as m/|a| + m/|b| - swaps/m, whether that is at least ``need``."""
    (x, i), (y, j) = _codes(d.a), _codes(d.b)
    alphabet, one = np.union1d(x, y), np.uint64(1)
    at = lambda o: np.arange(len(o)) - np.searchsorted(o, o)
    of_a, of_b = (np.full((len(t), 64), len(alphabet)) for t in (d.a, d.b))
    masks = np.zeros((len(d.b), len(alphabet) + 1), "u8")
    p, q = at(i), at(j)
    of_a[i[p < 64], p[p < 64]] = np.searchsorted(alphabet, x[p < 64])
    of_b[j[q < 64], q[q < 64]] = np.searchsorted(alphabet, y[q < 64])
    np.bitwise_or.at(masks, (j[q < 64], np.searchsorted(alphabet, y[q < 64])), one << q[q < 64].astype("u8"))
    windows = np.array([[sum(1 << k for k in range(max(0, n - reach), min(63, n + reach) + 1)) for n in range(64)] for reach in range(32)], "u8")

    def run(ia: np.ndarray, ib: np.ndarray, need: np.ndarray) -> np.ndarray:
        mine, used, reach = np.zeros(len(ia), "u8"), np.zeros(len(ia), "u8"), np.maximum(0, np.maximum(d.la[ia], d.lb[ib]) // 2 - 1)
        for n in range(int(d.la[ia].max())):
            hit = masks[ib, of_a[ia, n]] & ~used & windows[reach, n]
            used |= hit & (~hit + one)
            mine |= (hit != 0).astype("u8") << np.uint64(n)
        m = np.bitwise_count(used).astype("f8")
        share = m * (1.0 / d.la[ia] + 1.0 / d.lb[ib])
        left = np.flatnonzero((share >= need) & (m > 0))
        mine, used, swaps = mine[left], used[left], np.zeros(len(left), "i8")
        for _ in range(int(m[left].max(initial=0))):
            low, high = mine & (~mine + one), used & (~used + one)
            # a pair whose letters are used up compares the first place of both, masked out
            swaps += (of_a[ia[left], np.bitwise_count(low - (low != 0))] != of_b[ib[left], np.bitwise_count(high - (high != 0))]) & (low != 0)
            mine, used = mine & ~low, used & ~high
        good = np.zeros(len(ia), bool)
        good[left] = share[left] - (swaps // 2) / m[left] >= need[left]
        return good

    return run


def _jaro_winkler(d: _Block, least: float) -> Iterator[tuple[int, int, float]]:
    # with the first s letters equal, Jaro must reach (least - s/10) / (1 - s/10); m matched letters give (m/|a| + m/|b| + 1) / 3 at most
    need = np.array([max(0.0, 3 * (least - s / 10) / (1 - s / 10) - 1) for s in range(5)])
    head = lambda texts: np.array([[ord(c) for c in t[:4]] + [-1 - k] * (4 - len(t[:4])) for k, t in ((side, t) for side, s in texts for t in s)]).T
    ha, hb, matched = head([(0, d.a)]), head([(1, d.b)]), _matched(d)

    def bound(i: np.ndarray | int, j: np.ndarray | slice) -> np.ndarray:
        start, same = 0, True
        for k in range(4):
            same = same & (ha[k, i] == hb[k, j])
            start = start + same
        return need[start] - EPS

    def settle(found: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, int, float]]:
        ia, ib = np.repeat([i for i, _ in found], [len(j) for _, j in found]), np.concatenate([j for _, j in found])
        short = (d.la[ia] <= 64) & (d.lb[ib] <= 64)
        sa, sb = ia[short], ib[short]
        near = matched(sa, sb, bound(sa, sb)) if len(sa) else np.zeros(0, bool)
        for i, j in zip(np.concatenate([sa[near], ia[~short]]).tolist(), np.concatenate([sb[near], ib[~short]]).tolist()):
            if (s := similarity.jaro_winkler(d.a[i], d.b[j])) >= least:
                yield i, j, s

    waiting, n, each = [], 0, 1.0 / d.lb
    for i in range(len(d.a)):
        j = np.flatnonzero(d.common(i) * (1.0 / d.la[i] + each) >= bound(i, slice(None)))
        if len(j):
            waiting.append((i, j))
            n += len(j)
        if n >= BATCH:
            yield from settle(waiting)
            waiting, n = [], 0
    if waiting:
        yield from settle(waiting)


class _Bits:
    """Letters in common by bits: one bit for each letter and each time both lists have it, the most frequent first; a text's share is a few words."""

    def __init__(self, ca: np.ndarray, cb: np.ndarray, most: int):
        times = np.minimum(ca.max(axis=1, initial=0), cb.max(axis=1, initial=0))
        bits = [(np.count_nonzero(cb[r] >= n), r, n) for r, m in enumerate(times.tolist()) for n in range(1, m + 1)]
        self.a, self.b = (np.zeros((-(-len(bits) // 64), c.shape[1]), "u8") for c in (ca, cb))
        for q, (_, r, n) in enumerate(sorted(bits, reverse=True)):
            for mine, c in ((self.a, ca), (self.b, cb)):
                mine[q // 64] |= (c[r] >= n).astype("u8") << np.uint64(q % 64)
        self.kind = "u1" if most < 256 else "u4"

    def common(self, i: int, of: np.ndarray | slice = slice(None)) -> np.ndarray:
        parts = [np.bitwise_count(self.b[w, of] & self.a[w, i]) for w in np.flatnonzero(self.a[:, i])]
        if not parts:
            return np.zeros(self.b.shape[1], self.kind)[of]
        total = parts[0].astype(self.kind, copy=False)
        for x in parts[1:]:
            total += x
        return total


def _pair_bits(texts: list[str]) -> np.ndarray:
    """Of each text which pairs of neighbouring letters of a word it has, hashed to 256 bits."""
    x, i = _codes(texts)
    at = np.flatnonzero((i[:-1] == i[1:]) & (x[:-1] != 32) & (x[1:] != 32)) if len(x) else np.zeros(0, "i8")
    bit = ((x[at].astype("u8") * np.uint64(0x9E3779B97F4A7C15) + x[at + 1]) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(56)
    out = np.zeros((4, len(texts)), "u8")
    np.bitwise_or.at(out, ((bit >> np.uint64(6)).astype("i8"), i[at]), np.uint64(1) << (bit & np.uint64(63)))
    return out


class _Subsequences:
    """Longest common subsequences of pairs, by bit-parallel rows over all pairs at once, for texts of 64 letters of a and of LONG of b at most."""

    def __init__(self, a: list[str], b: list[str]):
        self.sizes, (x, i), (y, j) = np.array([len(t) for t in a]), _codes(a), _codes(b)
        alphabet, at = np.unique(x), lambda o: np.arange(len(o)) - np.searchsorted(o, o)
        self.width, p, q = len(alphabet) + 1, at(i), at(j)
        masks = np.zeros((len(a), self.width), "u8")
        low = p < 64
        np.bitwise_or.at(masks, (i[low], np.searchsorted(alphabet, x[low])), np.uint64(1) << p[low].astype("u8"))
        self.masks, self.lengths = masks.ravel(), np.array([min(len(t), LONG) for t in b])
        spot = np.minimum(np.searchsorted(alphabet, y), self.width - 2)
        self.of_b = np.full((int(self.lengths.max()), len(b)), self.width - 1, "i4")  # the last column has no letter
        low = q < LONG
        self.of_b[q[low], j[low]] = np.where(alphabet[spot] == y, spot, self.width - 1)[low]

    def run(self, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
        n, base = self.sizes[ia], ia * self.width
        full = np.full(len(ia), 2**64 - 1, "u8") >> (64 - n).astype("u8")
        row = full.copy()
        for k in range(int(self.lengths[ib].max(initial=0))):
            hit = row & self.masks[base + self.of_b[k, ib]]
            row = ((row + hit) | (row - hit)) & full
        return n - np.bitwise_count(row)


def _wratio(d: _Block, least: float, k: int | None) -> Iterator[tuple[int, int, float]]:
    """Unlike lengths with a word in common score 95 x weight whatever the rest, unless a partial match scores more: of these the first k of b are
    enough, and where there are k only pairs that can reach that score count besides. Pairs that letters in common don't rule out are bounded
    again by their longest common subsequences, many pairs at once; without a word in common and of like lengths these are the score."""
    words_a, words_b = [t.split() for t in d.a], [t.split() for t in d.b]
    odd_a, odd_b = (np.array([t != " ".join(w) for t, w in zip(s, words)]) for s, words in ((d.a, words_a), (d.b, words_b)))
    set_a, set_b = [sorted(set(w)) for w in words_a], [sorted(set(w)) for w in words_b]
    joined_a, joined_b = [" ".join(w) for w in set_a], [" ".join(w) for w in set_b]
    da, db = (np.array([len(t) for t in s]) for s in (joined_a, joined_b))
    twice_a, twice_b = (np.array([len(w) != len(s) for w, s in zip(*x)]) for x in ((words_a, set_a), (words_b, set_b)))
    bits, most = _Bits(d.ca, d.cb, max(d.la.max(), d.lb.max())), 255 if max(d.la.max(), d.lb.max()) < 256 else 2**32 - 1
    repeated = _Bits(*_letters(joined_a, joined_b), max(da.max(), db.max())) if (twice_a.any() or twice_b.any()) and da.any() and db.any() else None
    two_a, two_b = _pair_bits(d.a), _pair_bits(d.b)
    plain = _Subsequences(d.a, d.b)
    ordered = _Subsequences([" ".join(sorted(w)) for w in words_a], [" ".join(sorted(w)) for w in words_b]) if any(words_a) and any(words_b) else plain
    known, has = {w for s in set_a for w in s}, {}
    for j, s in enumerate(set_b):
        for w in s:
            if w in known:
                has.setdefault(w, []).append(j)
    has = {w: np.array(j) for w, j in has.items()}
    odd_of_b, twice_of_b = np.flatnonzero(odd_b), np.flatnonzero(twice_b)

    def kinds(la: np.ndarray | int, lb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shorter length, whether the lengths are alike, and the weight of partial matches."""
        short = np.minimum(la, lb)
        lengths = np.maximum(la, lb) / short
        return short, lengths < 1.5, np.where(lengths < 8, 0.9, 0.6)

    tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    needs: dict[tuple[int, float], np.ndarray] = {}

    def need(la: int, t: float) -> np.ndarray:
        """Letters in common that a pair needs at least for ``t``, but for the score of words in common. A partial match of p has 2 x matched >= p x (short + window)."""
        if (la, t) not in needs:
            short, like, weight = kinds(la, d.lb)
            p = t / (100.0 * weight)
            part = np.where(like | (p > 1 + EPS), np.inf, short * np.minimum(p, 1) / (2 - np.minimum(p, 1)))
            needs[la, t] = np.clip(np.ceil(np.minimum(t * (la + d.lb) / 200.0, part) - EPS), 0, most).astype(bits.kind)
        return needs[la, t]

    def settle(waiting: list[tuple]) -> Iterator[tuple[int, int, float]]:
        ia = np.repeat([w[0] for w in waiting], [len(w[1]) for w in waiting])
        t = np.repeat([w[2] for w in waiting], [len(w[1]) for w in waiting])
        ib, c, both = (np.concatenate([w[n] for w in waiting]) for n in (1, 3, 4))
        la, lb = d.la[ia], d.lb[ib]
        short, like, weight = kinds(la, lb)
        hard, twice = odd_a[ia] | odd_b[ib] | (la > 64) | (lb > LONG), twice_a[ia] | twice_b[ib]
        # few of the shorter text's pairs of letters are missing in the longer
        lost = np.floor((1.0 - np.minimum(t / (100.0 * weight), 2.0 - 1e-9)) * 2 * short + EPS)
        one, two = two_a[:, ia], two_b[:, ib]
        missing = np.bitwise_count(np.where(la < lb, one & ~two, two & ~one)).sum(axis=0, dtype="i4")
        left = np.flatnonzero(hard | like | (200.0 * c >= t * (la + lb) - EPS) | (missing <= 2 * lost + EPS))
        ia, ib, t, c, both, la, lb, short, like, weight, hard, twice = (v[left] for v in (ia, ib, t, c, both, la, lb, short, like, weight, hard, twice))
        n, m = plain.run(ia, ib), ordered.run(ia, ib)
        r, s = 200.0 * n / (la + lb), 200.0 * m / (la + lb)
        sure = like & (both == 0) & ~twice & ~hard
        score = np.maximum(r, 0.95 * s)
        done: dict[int, list[float]] = {}  # scores of each text of a, negative and rising
        for x in np.flatnonzero(sure & (score >= least)).tolist():
            insort(done.setdefault(int(ia[x]), []), -float(score[x]))
            yield int(ia[x]), int(ib[x]), float(score[x])
        joint = np.where(both > 0, 190.0 * both / (both + np.minimum(da[ia], db[ib])), 0.0)
        whole = np.maximum(np.maximum(score, joint), np.where(both > 0, 190.0 * c / (la + lb), 0.0))
        partial = np.maximum(r, weight * np.maximum(200.0 * n / (short + n), 190.0 * m / (short + m)))
        reach = np.where(hard | (like & twice), 101.0, np.where(like, whole, partial))
        open_ = np.flatnonzero(~sure & (reach >= t - EPS))
        open_ = open_[np.lexsort((-reach[open_], ia[open_]))]
        for i, j, most_of in zip(ia[open_].tolist(), ib[open_].tolist(), reach[open_].tolist()):
            mine = done.setdefault(i, [])
            if k is not None and len(mine) >= k and -mine[k - 1] > most_of + EPS:
                continue
            if (x := similarity.wratio(d.a[i], d.b[j])) >= least:
                insort(mine, -x)
                yield i, j, x

    letters, waiting, size = np.zeros(len(d.b), "i4"), [], 0  # letters and spaces of the words in common, and one
    for i, la in enumerate(d.la.tolist()):
        words = [w for w in set_a[i] if w in has]
        t, more = least, [odd_of_b]
        if words:
            for w in words:
                letters[has[w]] += len(w) + 1
            at = has[words[0]] if len(words) == 1 else np.flatnonzero(letters)
            both = letters[at] - 1
            if la not in tables:
                tables[la] = kinds(la, d.lb)[1:]
            like, weight = (v[at] for v in tables[la])
            more.append(at[like & (190.0 * both >= least * (both + np.minimum(da[i], db[at])) - EPS)])
            flats = []
            for x in (0.9, 0.6):
                flat = 0.95 * x * 100.0
                if flat >= least:
                    first = at[~like & (weight == x)][:k]
                    flats += [flat] * len(first)
                    for j in first.tolist():
                        yield i, j, flat
            if k is not None and len(flats) >= k:
                t = max(t, flats[k - 1])
        c = bits.common(i)
        if odd_a[i]:
            at = np.arange(len(d.b))
        else:
            at = np.flatnonzero(c >= need(la, t))
            if repeated:
                of = np.arange(len(d.b)) if twice_a[i] else twice_of_b
                more.append(of[190.0 * repeated.common(i, of) >= least * (da[i] + db[of]) - EPS])
            if any(map(len, more)):
                at = np.unique(np.concatenate([at, *more]))
        if len(at):
            waiting.append((i, at, t, c[at], np.maximum(letters[at] - 1, 0)))
            size += len(at)
        for w in words:
            letters[has[w]] = 0
        if size >= BATCH:
            yield from settle(waiting)
            waiting, size = [], 0
    if waiting:
        yield from settle(waiting)


def near(a: list[str], b: list[str], score: str, least: float, k: int | None = None) -> list[tuple[int, int, float]]:
    """Places in a and b, and the score (ratio, wratio or jaro_winkler), of all pairs of nonempty texts that score ``least`` or more; with k of each
    text of a only the k best, of equal ones those that come first in b."""
    if not a or not b:
        return []
    d = _Block(a, b)
    if score == "wratio":
        best: dict[tuple[int, int], float] = {}
        for i, j, x in _wratio(d, least, k):  # a pair may come with its words' score and again with that of the rest
            best[i, j] = max(x, best.get((i, j), 0.0))
        found = ((i, j, x) for (i, j), x in best.items())
    else:
        found = {"ratio": _ratio, "jaro_winkler": _jaro_winkler}[score](d, least)
    if k is None:
        return list(found)
    out: list[tuple[int, int, float]] = []
    mine: list[tuple[int, int, float]] = []
    for row in sorted(found, key=lambda x: (x[0], -x[2], x[1])):
        if mine and mine[0][0] != row[0]:
            mine = []
        mine.append(row)
        if len(mine) <= k:
            out.append(row)
    return out
