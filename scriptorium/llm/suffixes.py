"""External induced suffix sorting with common prefixes (numpy over files).

Suffix types split positions into S and L. The leftmost S positions are sorted by their substrings and named; the string of
names is sorted by recursion (or in memory, once it is short), which orders them as suffixes, and all other suffixes are
induced: scanning suffixes in order, each pushes the one before it into a queue by its first symbol. The sorting of the
substrings is induced in the same way. The queues are disk-backed: monotone priority queues with the key (symbol, order of
arrival), whose tuples (position, common prefix) spill to a file beyond a bound of memory. A pushed common prefix is one more
than the least one scanned since the last push with that symbol.

Text, types, names, what is induced on the way and the result are arrays in files beyond a bound of memory, and are read and
written in stretches; the text may be given as such an array. Positions are looked up at random in the text and its types, as
in every induced sorting, through mapped pages that the system may drop.
"""

from __future__ import annotations

import tempfile
from bisect import bisect_left
from collections import deque

import numpy as np

#: Common prefixes are exact up to this length and never overstated beyond it; a parameter.
DEPTH = 64
#: Tuples that a queue keeps in memory; names that are sorted in memory; bytes of an array beyond which it is in a file; elements at once.
QUEUE, IN_MEMORY, MEMORY, AT_ONCE = 250_000, 2_000_000, 64 << 20, 1 << 20


def array(n: int, dtype, memory: int = MEMORY) -> np.ndarray:
    """An empty array, in an unnamed file if it takes more than memory bytes."""
    if n * np.dtype(dtype).itemsize <= memory:
        return np.zeros(n, dtype)
    return np.memmap(tempfile.TemporaryFile(), dtype, "w+", shape=n)  # noqa: SIM115  goes with the array


class DiskQueue:
    """First in, first out for each symbol; symbols are popped in one direction. What waits for symbols far off lies by range.

    With up to RANGES symbols a range is one symbol, whose parts are popped one by one; else a range is brought in as its
    first symbol is reached.
    """

    RANGES = 1024

    def __init__(self, limit: int, symbols: int = RANGES):
        self.limit, self.held, self.file = limit, 0, None
        self.width = -(-symbols // self.RANGES)
        self.far: dict[int, deque] = {}
        self.near: dict[int, deque] = {}
        self.now = None

    def push(self, symbol: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        part = np.stack([np.full(len(pos), symbol), pos, lcp])
        self.held += part.shape[1]
        if symbol // self.width == self.now:
            own = self.near.setdefault(symbol, deque())
        else:
            own = self.far.setdefault(symbol // self.width, deque())
        if own and isinstance(own[-1], list) and own[-1][0] < 4096:
            own[-1][0] += part.shape[1]
            own[-1].append(part)
        else:
            own.append([part.shape[1], part])
        if self.held > self.limit:
            self.spill()

    def spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()  # noqa: SIM115  goes with this object
        self.file.seek(0, 2)
        for own in (*self.far.values(), *self.near.values()):
            for k, part in enumerate(own):
                if isinstance(part, list):
                    own[k] = (self.file.tell(), part[0])
                    self.file.write(np.ascontiguousarray(np.concatenate(part[1:], axis=1)).tobytes())
        self.held = 0

    def read(self, part) -> np.ndarray:
        if isinstance(part, list):
            self.held -= part[0]
            return np.concatenate(part[1:], axis=1)
        self.file.seek(part[0])
        return np.frombuffer(self.file.read(24 * part[1]), np.int64).reshape(3, -1).copy()

    def pop(self, symbol: int) -> np.ndarray | None:
        """The oldest part of a symbol (positions, common prefixes), or None."""
        here = symbol // self.width
        if here != self.now:
            self.now, self.near, waiting = here, {}, self.far.pop(here, None)
            if waiting and self.width == 1:
                self.near[symbol] = waiting
            elif waiting:
                every = np.concatenate([self.read(part) for part in waiting], axis=1)
                every = every[:, np.argsort(every[0], kind="stable")]
                start = np.flatnonzero(np.append(True, every[0, 1:] != every[0, :-1]))
                for part in np.split(every, start[1:], axis=1):
                    self.near[int(part[0, 0])] = deque([[part.shape[1], part]])
                self.held += every.shape[1]
        own = self.near.get(symbol)
        if not own:
            self.near.pop(symbol, None)
            return None
        return self.read(own.popleft())[1:]

    def close(self) -> None:
        if self.file:
            self.file.close()


class Spool:
    """Tuples that are written by ascending symbol and read backwards."""

    def __init__(self, n: int, symbols: int, memory: int):
        self.pos, self.lcp, self.count, self.at = array(n, np.int64, memory), array(n, np.int32, memory), array(symbols, np.int64, memory), 0

    def add(self, symbol: int, part: np.ndarray) -> None:
        m = part.shape[1]
        self.pos[self.at : self.at + m], self.lcp[self.at : self.at + m] = part
        self.count[symbol] += m
        self.at += m

    def backwards(self, symbol: int):
        left = int(self.count[symbol])
        while left:
            m = min(left, AT_ONCE)
            yield np.asarray(self.pos[self.at - m : self.at]), self.lcp[self.at - m : self.at].astype(np.int64)
            left, self.at = left - m, self.at - m


def _stretches(n: int, size: int = AT_ONCE):
    for a in range(0, n, size):
        yield a, min(n, a + size)


def _types(t: np.ndarray, s: np.ndarray, runs: np.ndarray) -> None:
    """Fills s (true for S: the suffix is smaller than the next one; the end counts as smallest) and runs (how often the symbol follows in a row)."""
    kind, run, after = False, 0, -1
    for a, b in reversed(list(_stretches(len(t)))):
        x = np.asarray(t[a:b]).astype(np.int64)
        y = np.append(x[1:], after)
        index, n = np.arange(len(x)), len(x)
        stop = np.minimum.accumulate(np.where(x != y, index, n)[::-1])[::-1]
        there = stop < n
        at = np.minimum(stop, n - 1)
        s[a:b] = np.where(there, x[at] < y[at], kind)
        runs[a:b] = np.where(there, stop - index + 1, n - index + run)
        kind, run, after = bool(s[a]), int(runs[a]), int(x[0])


def _leftmost(s: np.ndarray, memory: int) -> np.ndarray:
    """Positions of S after L, in order."""
    found, n = [], 0
    for a, b in _stretches(len(s)):
        before = np.append(s[a - 1] if a else True, s[a : b - 1])
        found.append((np.flatnonzero(s[a:b] & ~before) + a).astype(np.int64))
        n += len(found[-1])
        if n * 8 > memory:
            break
    else:
        return np.concatenate(found) if found else np.zeros(0, np.int64)
    out = array(len(s) // 2 + 1, np.int64, memory)
    n = 0
    for a, b in _stretches(len(s)):
        before = np.append(s[a - 1] if a else True, s[a : b - 1])
        own = np.flatnonzero(s[a:b] & ~before) + a
        out[n : n + len(own)] = own
        n += len(own)
    return out[:n]


def _names(t: np.ndarray, s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Ranks of the substrings between leftmost S positions, in memory; equal substrings share one."""
    n = len(t)
    end = np.append(lms[1:], n)
    g, live, step, width = np.zeros(len(lms), np.int64), np.arange(len(lms)), 0, 2 * int(t.max()) + 4
    while len(live):
        at = lms[live] + step
        inside = np.minimum(at, n - 1)
        k = np.where(at < n, 2 * t[inside].astype(np.int64) + s[inside], -1)
        order = np.argsort(g[live] * width + k + 1)  # ties have one name
        live, k = live[order], k[order]
        old = g[live]
        new_group = np.append(True, old[1:] != old[:-1])
        new_run = new_group | np.append(True, k[1:] != k[:-1])
        index = np.arange(len(live))
        first_run = index[new_run][np.cumsum(new_run) - 1]
        g[live] = old + first_run - index[new_group][np.cumsum(new_group) - 1]
        size = np.diff(np.append(np.flatnonzero(new_run), len(live)))[np.cumsum(new_run) - 1]
        live = live[(size > 1) & (lms[live] + step < end[live])]
        step += 1
    return np.unique(g, return_inverse=True)[1]


def _doubled(names: np.ndarray) -> np.ndarray:
    """Suffix order of a string of names that fits in memory, by prefix doubling."""
    rank, n, step = names.astype(np.int64), len(names), 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:]
        key = rank * (n + 1) + after + 1
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, key[1:] != key[:-1]))
        step *= 2
        if rank[order[-1]] == n - 1 or step >= 2 * n:
            return order


def _common(t: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefixes of suffixes a and b, up to depth."""
    out, live, n = np.zeros(len(a), np.int64), np.arange(len(a)), len(t)
    for k in range(depth):
        x, y = a[live] + k, b[live] + k
        inside = (x < n) & (y < n)
        live, x, y = live[inside], x[inside], y[inside]
        live = live[t[x] == t[y]]
        if not len(live):
            break
        out[live] = k + 1
    return out


class _Scan:
    """One pass of induction; kind: the type that is induced (False: L, upwards; True: S, downwards)."""

    def __init__(self, t, s, kind, symbols, limit, memory, depth):
        self.t, self.s, self.kind, self.queue, self.depth = t, s, kind, DiskQueue(limit, symbols), depth
        # Least common prefixes of the feeds so far, as an ascending stack: the first entry from a feed on is the least since.
        self.feeds, self.at, self.least = 0, [], []
        # By symbol: the first feed after its last push, and the least after that push in its own feed.
        self.since, self.tail = array(symbols, np.int64, memory), array(symbols, np.int32, memory)

    def feed(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        before = pos - 1
        good = np.flatnonzero((before >= 0) & (self.s[np.maximum(before, 0)] == self.kind))
        symbols = np.asarray(self.t[before[good]])
        order = np.argsort(symbols, kind="stable")
        good, symbols = good[order], symbols[order]
        edges = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1])).tolist() if len(symbols) else []
        for e, f in zip(edges, [*edges[1:], len(symbols)]):
            symbol, at = int(symbols[e]), good[e:f]
            least = np.minimum.reduceat(lcp[: at[-1] + 1], np.append(0, at[:-1] + 1))
            since = int(self.since[symbol])  # 0 before the first push, whose own common prefix is set where it is popped
            k = bisect_left(self.at, since)
            least[0] = min(least[0], int(self.tail[symbol]) if since else self.depth, self.least[k] if k < len(self.at) else self.depth)
            self.queue.push(symbol, before[at], np.minimum(least + 1, self.depth))
            self.since[symbol] = self.feeds + 1
            self.tail[symbol] = lcp[at[-1] + 1 :].min() if at[-1] + 1 < len(lcp) else self.depth
        low = int(lcp.min())
        while self.least and self.least[-1] >= low:
            self.least.pop()
            self.at.pop()
        self.least.append(low)
        self.at.append(self.feeds)
        self.feeds += 1


def _induced(t, s, runs, lms, lms_lcp, symbols, limit, memory, depth):
    """(order, common prefixes) of all suffixes from those of the leftmost S positions, sorted by symbol at least."""
    n, large = len(t), Spool(len(t), symbols, memory)
    sa, lcps = array(n, np.int64, memory), array(n + 1, np.int32, memory)
    up = _Scan(t, s, False, symbols, limit, memory, depth)
    up.feed(np.array([n]), np.zeros(1, np.int64))
    at = 0
    for c in range(symbols):
        last = None
        while (got := up.queue.pop(c)) is not None:
            if last is None:
                got[1, 0] = 0
            up.feed(got[0], got[1])
            large.add(c, got)
            last = got[0, -1]
        while at < len(lms):
            pos = np.asarray(lms[at : at + AT_ONCE])
            pos = pos[: np.searchsorted(t[pos], c, side="right")]
            if not len(pos):
                break
            lcp = np.asarray(lms_lcp[at : at + len(pos)]).astype(np.int64)
            if at == 0 or t[lms[at - 1]] != c:
                lcp[0] = 0 if last is None else min(runs[last], runs[pos[0]])
            up.feed(pos, lcp)
            at += len(pos)
    up.queue.close()
    down, at = _Scan(t, s, True, symbols, limit, memory, depth), n
    for c in range(symbols - 1, -1, -1):
        last, join = None, 0
        while (got := down.queue.pop(c)) is not None:
            if last is None:
                got[1, 0] = 0
            down.feed(got[0], got[1])
            m = got.shape[1]
            sa[at - m : at], lcps[at - m + 1 : at + 1] = got[0, ::-1], got[1, ::-1]  # each one's prefix is shared with the next larger
            at, last = at - m, got[0, -1]
        for k, (pos, lcp) in enumerate(large.backwards(c)):
            if k == 0:
                join = 0 if last is None else min(runs[last], runs[pos[-1]], depth)
                lcps[at] = join
            down.feed(pos[::-1], np.append(join, lcp[:0:-1]))
            m = len(pos)
            sa[at - m : at], lcps[at - m : at], join = pos, lcp, lcp[0]
            at -= m
    down.queue.close()
    return sa, lcps[:n]


def _named(t, s, runs, lms, symbols, limit, memory, depth) -> tuple[np.ndarray, int]:
    """Names of the substrings from each leftmost S position to the next, in the order of positions, and the number of names.

    The substrings are sorted by induction from their first symbols; neighbours are then compared.
    """
    by_symbol = array(len(lms), np.int64, memory)
    count = np.zeros(symbols + 1, np.int64)
    for a, b in _stretches(len(lms)):
        count[1:] += np.bincount(t[lms[a:b]], minlength=symbols)
    place = np.cumsum(count)[:-1]
    for a, b in _stretches(len(lms)):
        own = np.asarray(t[lms[a:b]])
        order = np.argsort(own, kind="stable")
        own = own[order]
        start = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        size = np.diff(np.append(start, len(own)))
        by_symbol[np.repeat(place[own[start]], size) + np.arange(len(own)) - np.repeat(start, size)] = np.asarray(lms[a:b])[order]
        place[own[start]] += size
    order = _induced(t, s, runs, by_symbol, array(len(lms), np.int8, memory), symbols, limit, memory, depth)[0]
    names, name, last, n = array(len(lms), np.int64, memory), -1, None, len(t)
    for a, b in _stretches(n):
        pos = np.asarray(order[a:b])
        pos = pos[(pos > 0) & s[pos] & ~s[np.maximum(pos - 1, 0)]]
        if not len(pos):
            continue
        pair = pos if last is None else np.append(last, pos)
        at = np.searchsorted(lms, pair)
        end = np.where(at + 1 < len(lms), lms[np.minimum(at + 1, len(lms) - 1)], n)
        length = end - pair
        new, live, step = length[1:] != length[:-1], np.flatnonzero(length[1:] == length[:-1]), 0
        whole = end < n  # what runs into the end of the text is like no other
        new[~(whole[1:] & whole[:-1])] = True
        live = live[~new[live]]
        while len(live):
            x, y = pair[1:][live] + step, pair[:-1][live] + step
            differs = (t[x] != t[y]) | (s[x] != s[y])
            new[live[differs]] = True
            live = live[~differs & (step < length[1:][live])]
            step += 1
        if last is None:
            name, new = 0, np.append(False, new)
            at = np.append(-1, at)
        own = name + np.cumsum(new)
        names[at[1:]] = own
        name, last = int(own[-1]), pos[-1]
    return names, name + 1


def suffix_sort(text: np.ndarray, queue: int = QUEUE, in_memory: int = IN_MEMORY, memory: int = MEMORY, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of text (whole numbers from 0) and the common prefix of each suffix with the one before it, exact up to depth."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    most = max(int(text[a:b].max()) for a, b in _stretches(n))
    seen = array(most + 1, np.bool_, memory)
    for a, b in _stretches(n):
        seen[text[a:b]] = True
    symbols = int(np.count_nonzero(seen))
    t = text
    if symbols <= most:
        rank = np.cumsum(seen) - 1
        t = array(n, np.uint16 if symbols < 1 << 16 else np.int32, memory)
        for a, b in _stretches(n):
            t[a:b] = rank[text[a:b]]
    s, runs = array(n, np.bool_, memory), array(n, np.int32, memory)
    _types(t, s, runs)
    lms = _leftmost(s, memory)
    if len(lms) > 1:
        if len(lms) <= max(in_memory, 2):
            order = _doubled(_names(t, s, lms))
        else:
            names, different = _named(t, s, runs, lms, symbols, queue, memory, depth)
            if different == len(lms):
                order = array(len(lms), np.int64, memory)
                for a, b in _stretches(len(lms)):
                    order[names[a:b]] = np.arange(a, b)
            else:
                order = suffix_sort(names, queue, in_memory, memory, depth)[0]
        by_order = array(len(lms), np.int64, memory)
        for a, b in _stretches(len(lms)):
            by_order[a:b] = lms[order[a:b]]
        lms = by_order
    lcp = array(len(lms), np.int32, memory)
    for a, b in _stretches(len(lms)):
        own = np.asarray(lms[max(a - 1, 0) : b])
        lcp[a + (a == 0) : b] = _common(t, own[1:], own[:-1], depth)
    return _induced(t, s, runs, lms, lcp, symbols, queue, memory, depth)
