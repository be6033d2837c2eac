"""Suffix arrays by linear grouping: suffixes are first put into groups by the Lyndon word they begin with, in descending order
of the groups, by pointers to the previous smaller suffix; then one pass emits the order, without renaming and recursion.

`repeats` uses them for passages: a text is cut into phrases behind local marks, the phrases are the symbols, and windows of
a fixed length are compared from the first mark inside them on."""
from __future__ import annotations

import numpy as np


def suffix_array(s: list[int]) -> list[int]:
    """The order of all suffixes of s, whose last symbol occurs once and is the least."""
    n = len(s)
    names = {c: g for g, c in enumerate(sorted(set(s)))}
    members: list[list[int]] = [[] for _ in names]
    group = [names[c] for c in s]
    for i, g in enumerate(group):
        members[g].append(i)
    below = list(range(-1, len(members) - 1))
    above = list(range(1, len(members) + 1))
    above[-1] = -1
    size = [0] * len(members)
    prev, done = [-1] * n, bytearray(n)
    g = len(members) - 1
    while g >= 0:  # descending
        own = [i for i in members[g] if group[i] == g]
        members[g] = []
        size[g] = len(own)
        if own:
            own.sort()
            for i in own:
                done[i] = 1
            times: dict[int, int] = {}
            for i in own:
                j = i - 1
                while j >= 0 and done[j]:
                    j = prev[j]
                prev[i] = j
                if j >= 0:
                    times[j] = times.get(j, 0) + 1
            # a suffix that several of the group point to is larger than one that fewer point to
            shared = max(times.values(), default=0)
            for k in range(shared, 0, -1):
                moved: dict[int, list[int]] = {}
                for j, t in times.items():
                    if t == k:
                        moved.setdefault(group[j], []).append(j)
                for old, some in moved.items():
                    new = len(members)
                    members.append(some)
                    size.append(0)
                    below.append(old)
                    above.append(above[old])
                    if above[old] >= 0:
                        below[above[old]] = new
                    above[old] = new
                    for j in some:
                        group[j] = new
        g = below[g]
    start, at, g = [0] * len(members), 0, 0
    while g >= 0:  # ascending; group 0 never leaves the lowest place
        start[g] = at
        at += size[g]
        g = above[g]
    order, placed = [-1] * n, bytearray(n)
    order[0], placed[n - 1] = n - 1, 1
    for i in range(n):
        j = order[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            order[start[g]] = j
            start[g] += 1
            placed[j] = 1
            j = prev[j]
    return order


PRIMES = (2147483629, 2147483587)


def powers(base: int, n: int, prime: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done, step = 1, base
    while done < n:
        more = min(done, n - done)
        out[done:done + more] = out[:more] * np.uint64(step) % np.uint64(prime)
        done, step = done + more, step * step % prime
    return out


class Spans:
    """Hashes of 62 bits of any span of a text."""

    def __init__(self, data: np.ndarray):
        self.parts = []
        for base, prime in zip((911382323, 972663749), PRIMES):
            p = powers(base, len(data) + 1, prime)
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:-1] % np.uint64(prime), dtype=np.uint64)))
            self.parts.append((total, p, np.uint64(prime)))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.uint64)
        for total, p, prime in self.parts:  # each sum is moved to the power of the last place, so that places do not count
            h = (total[b] - total[a]) % prime * p[len(total) - 1 - a] % prime
            out = (out << np.uint64(31)) | h
        return out


def marks(data: np.ndarray) -> np.ndarray:
    """The places behind a space whose two letters before fall into a quarter of all pairs. The three bytes decide alone, and
    no two marks can share one of them, so no phrase is the beginning of another one."""
    if len(data) < 3:
        return np.empty(0, np.int64)
    a, b, c = data[:-2], data[1:-1], data[2:]
    few = ((a.astype(np.uint32) * 131 + b) * np.uint32(2654435761)) >> np.uint32(30) == 0
    return np.flatnonzero((c == 32) & (a != 32) & (b != 32) & few) + 3


def common(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common beginning of the suffixes at a and b, up to `most`."""
    out = np.zeros(len(a), np.int64)
    width = 64
    padded = np.concatenate((data, np.zeros(width, np.uint8)))
    live = np.flatnonzero(most > 0)
    while len(live):
        for at in range(0, len(live), 1 << 14):
            i = live[at:at + (1 << 14)]
            x = np.lib.stride_tricks.sliding_window_view(padded, width)
            # a suffix that ended is cut off by `most`
            n = len(data)
            differ = x[np.minimum(a[i] + out[i], n)] != x[np.minimum(b[i] + out[i], n)]
            out[i] = out[i] + np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        full = (out[live] < most[live]) & (data_equal(padded, a, b, out, live, len(data)))
        live = live[full]
    return np.minimum(out, most)


def data_equal(padded: np.ndarray, a: np.ndarray, b: np.ndarray, out: np.ndarray, live: np.ndarray, n: int) -> np.ndarray:
    return padded[np.minimum(a[live] + out[live], n)] == padded[np.minimum(b[live] + out[live], n)]


def repeats(pieces: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """(piece, from, to): the windows of `length` bytes that start in [from, to) of the piece and also start elsewhere."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum([len(p) for p in pieces])
    firsts = ends - [len(p) for p in pieces]
    cuts = [marks(data[a:z]) + a for a, z in zip(firsts.tolist(), ends.tolist())]
    cut = np.concatenate(cuts) if cuts else np.empty(0, np.int64)
    # symbols: the phrases in order of their bytes, and behind each piece one of its own that is less than all phrases
    symbols: list = []
    places: list[int] = []
    known: dict[bytes, int] = {}
    for p, (piece, first, c) in enumerate(zip(pieces, firsts.tolist(), cuts)):
        bounds = np.unique(np.concatenate(([0], c - first, [len(piece)]))).tolist()
        for x, y in zip(bounds, bounds[1:]):
            phrase = piece[x:y]
            symbols.append(known.setdefault(phrase, len(known)))
            places.append(first + x)
        symbols.append(-1 - p)
        places.append(first + len(piece))
    rank = np.empty(len(known), np.int64)
    rank[[known[x] for x in sorted(known)]] = np.arange(len(known)) + len(pieces)
    coded = np.array(symbols, np.int64)
    coded = np.where(coded >= 0, rank[np.maximum(coded, 0)], len(pieces) + coded)   # the last piece's end is the least
    place = np.array(places, np.int64)
    order = np.array(suffix_array(coded.tolist()), np.int64)
    of_symbol = np.empty(len(order), np.int64)
    of_symbol[order] = np.arange(len(order))
    stop = np.repeat(ends, np.diff(np.concatenate((np.flatnonzero(np.concatenate(([True], coded[:-1] < len(pieces)))), [len(coded)]))))
    at, left = place[order], np.minimum((stop - place)[order], length)
    shared = np.concatenate(([0], common(data, at[:-1], at[1:], np.minimum(left[:-1], left[1:])), [0]))  # with the one before
    best = np.maximum(shared[:-1], shared[1:])

    # windows: from p to the first mark that lies in them whole, and from there on by the order of suffixes
    counts = np.maximum(ends - firsts - length + 1, 0)
    p = np.repeat(firsts, counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    if not len(p):
        return []
    after = np.searchsorted(cut, p + 3)
    b = np.where(after < len(cut), cut[np.minimum(after, max(len(cut) - 1, 0))] if len(cut) else 0, len(data) + length)
    inside = b < p + length
    need = np.where(inside, p + length - b, 0)
    symbol = np.searchsorted(place, np.where(inside, b, 0), "right") - 1  # an end and the start of the next piece share a place
    r = np.where(inside, of_symbol[symbol], 0)
    go = best[r] >= need
    p, need, r = p[go], need[go], r[go]
    key = Spans(data).of(p, p + length - need) * np.uint64(2 * length + 1) + need.astype(np.uint64)
    by = np.lexsort((r, key))
    p, need, r, key = p[by], need[by], r[by], key[by]
    lo, hi = r[:-1], r[1:]
    same = np.flatnonzero(key[:-1] == key[1:])
    least = range_least(shared, lo[same] + 1, hi[same] + 1)
    same = same[(need[same] == 0) | (least >= need[same])]
    hit = np.zeros(len(data) + 1, bool)
    hit[p[same]] = hit[p[same + 1]] = True
    out = []
    edges = np.flatnonzero(hit[1:] != hit[:-1]) + 1
    if hit[0]:
        edges = np.concatenate(([0], edges))
    for a, z in zip(edges[::2].tolist(), edges[1::2].tolist()):
        while a < z:  # runs of neighbouring pieces may touch only in pieces of exactly one window
            i = int(np.searchsorted(ends, a, "right"))
            to = min(z, int(ends[i]))
            out.append((i, a - int(firsts[i]), to - int(firsts[i])))
            a = to
    return out


def range_least(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of values[a:b] for each pair; a large number where a = b."""
    levels = [values.astype(np.int32)]
    while 1 << len(levels) <= len(values):
        half, x = 1 << (len(levels) - 1), levels[-1]
        levels.append(np.minimum(x[:-half], x[half:]))
    out = np.full(len(a), 1 << 30)
    width = b - a
    for k, x in enumerate(levels):
        of = np.flatnonzero((width >= 1 << k) & (width < 2 << k))
        out[of] = np.minimum(x[a[of]], x[b[of] - (1 << k)])
    return out
