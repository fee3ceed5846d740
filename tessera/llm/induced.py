"""External induced sorting of the suffixes of an integer string.

The classes of suffixes, the naming of the substrings between local minima and the recursion on their names are those of induced
sorting. Text, classes, names, counts and orders of more than most entries are files that are mapped, and every step reads and writes
them in parts of most entries. Names come from rounds of external sorting with bounded merges.

Induction doesn't walk an array of buckets: suffix tuples (first symbol, place) wait in a queue that keeps runs on disk. Tuples are
pushed in the order of the suffixes that induce them, so those of one symbol come out first in, first out. A range of symbols that fits
in memory comes out at once, and what its suffixes induce inside the same range is ordered there; a symbol of more suffixes than that is
handed out in parts, and what it induces of its own kind is queued behind them.

Common prefixes are not carried through the induction: whoever uses the order compares neighbours up to the length needed, which for a
limit of 200 bytes is cheaper than range minima over the lengths of every level (see suffix.repeats).
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterator

import numpy as np

MEMORY = 500_000


def array(n: int, kind: type, most: int) -> np.ndarray:
    """Zeros, in a temporary file if they are more than most."""
    if n <= most:
        return np.zeros(n, kind)
    with tempfile.TemporaryFile() as file:
        file.truncate(n * np.dtype(kind).itemsize)
        return np.memmap(file, kind, "r+", shape=(n,))


def spans(n: int, most: int) -> Iterator[slice]:
    for low in range(0, n, most):
        yield slice(low, min(n, low + most))


class Sink:
    """Values that are appended; beyond most of them, to a temporary file."""

    def __init__(self, kind: type, most: int):
        self.kind, self.most, self.held, self.waiting, self.size, self.file = kind, most, [], 0, 0, None

    def add(self, values: np.ndarray) -> None:
        if not len(values):
            return
        self.held.append(np.array(values, self.kind))
        self.waiting += len(values)
        self.size += len(values)
        if self.waiting > self.most:
            self._write()

    def _write(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        for values in self.held:
            self.file.write(values.data)
        self.held, self.waiting = [], 0

    def array(self) -> np.ndarray:
        if self.file is None:
            return np.concatenate(self.held) if self.held else np.zeros(0, self.kind)
        self._write()
        self.file.flush()
        with self.file as file:
            return np.memmap(file, self.kind, "r", shape=(self.size,))


def _run(rows: np.ndarray) -> np.ndarray:
    """rows as a mapped file that holds no descriptor."""
    with tempfile.TemporaryFile() as file:
        rows.tofile(file)
        file.flush()
        return np.frombuffer(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False), np.int64).reshape(rows.shape)


class Sorter:
    """Rows of integers in order of their first one or two columns, by runs on disk that are merged block by block."""

    def __init__(self, most: int, keys: int):
        self.most, self.keys, self.held, self.size, self.runs = most, keys, [], 0, []

    def add(self, *columns: np.ndarray) -> None:
        self.held.append(np.stack(columns).astype(np.int64))
        self.size += self.held[-1].shape[1]
        if self.size > self.most:
            self.runs.append(_run(self._sorted()))

    def _sorted(self) -> np.ndarray:
        rows = np.concatenate(self.held, axis=1)
        self.held, self.size = [], 0
        return self._ordered(rows)

    def _ordered(self, rows: np.ndarray) -> np.ndarray:
        return rows[:, np.lexsort(rows[: self.keys][::-1])]

    def merged(self) -> Iterator[np.ndarray]:
        if self.held:
            rows = self._sorted()
            if not self.runs:
                yield rows
                return
            self.runs.append(_run(rows))
        block = max(1, self.most // max(1, len(self.runs)))
        at = [0] * len(self.runs)
        parts = [np.array(r[:, :block]) for r in self.runs]
        while True:
            live = [k for k, p in enumerate(parts) if p.shape[1]]
            if not live:
                return
            # All rows up to the least last key of a block are in memory, but for equal ones, which come next.
            bound = min(tuple(parts[k][: self.keys, -1].tolist()) for k in live)
            out = []
            for k in live:
                p = parts[k]
                i = int(np.searchsorted(p[0], bound[0], "right"))
                if self.keys == 2:
                    low = int(np.searchsorted(p[0], bound[0]))
                    i = low + int(np.searchsorted(p[1, low:i], bound[1], "right"))
                if i:
                    out.append(p[:, :i])
                    parts[k] = p[:, i:]
                    if i == p.shape[1]:
                        at[k] += block
                        parts[k] = np.array(self.runs[k][:, at[k] : at[k] + block])
            yield self._ordered(np.concatenate(out, axis=1))


class BulkQueue:
    """Tuples (symbol, place), taken out by symbol and, of one symbol, in the order in which they came. Beyond limit tuples, runs go to temporary files."""

    def __init__(self, limit: int = MEMORY):
        self.limit, self.held, self.size, self.runs = limit, [], 0, []

    def push(self, symbol: np.ndarray, place: np.ndarray) -> None:
        if not len(symbol):
            return
        self.held.append(np.stack((symbol, place)).astype(np.int64))
        self.size += len(symbol)
        if self.size > self.limit:
            rows = np.concatenate(self.held, axis=1)
            self.runs.append([_run(rows[:, np.argsort(rows[0], kind="stable")]), 0])
            self.held, self.size = [], 0

    def _held(self, below: int) -> np.ndarray:
        """Takes out what is in memory and below the bound."""
        if not self.held:
            return np.zeros((2, 0), np.int64)
        rows = np.concatenate(self.held, axis=1) if len(self.held) > 1 else self.held[0]
        now = rows[0] < below
        rest = rows[:, ~now]
        self.held, self.size = ([rest], rest.shape[1]) if rest.shape[1] else ([], 0)
        return rows[:, now]

    def pop(self, below: int) -> np.ndarray:
        """Places of all tuples with a symbol below the bound."""
        out = []
        for run in self.runs:
            end = run[1] + int(np.searchsorted(run[0][0, run[1] :], below))
            out.append(np.array(run[0][:, run[1] : end]))
            run[1] = end
        self.runs = [r for r in self.runs if r[1] < r[0].shape[1]]
        rows = np.concatenate([*out, self._held(below)], axis=1)
        return rows[1, np.argsort(rows[0], kind="stable")]

    def parts(self, symbol: int) -> Iterator[np.ndarray]:
        """Places of all tuples of the symbol, the least there is, in parts; also of those pushed meanwhile."""
        while self.runs or self.held:
            k = 0
            while k < len(self.runs):
                run = self.runs[k]
                part = run[0][:, run[1] : run[1] + self.limit]
                n = int(np.searchsorted(part[0], symbol, "right"))
                if not n:
                    k += 1
                    continue
                run[1] += n
                places = np.array(part[1, :n])
                if run[1] == run[0].shape[1]:
                    del self.runs[k]
                yield places
            last = self._held(symbol + 1)[1]
            if not len(last):
                return
            yield last


def _ranges(start: np.ndarray, most: int, flip: bool) -> Iterator[tuple[int, int]]:
    """Ranges of symbols of at most most suffixes each, or of one symbol; start: suffixes of all symbols before each. flip: with the symbols in reverse."""
    symbols = len(start) - 1
    for k in spans(symbols, most):
        total = start[-1] - start[symbols - k.stop : symbols - k.start + 1][::-1] if flip else np.array(start[k.start : k.stop + 1])
        begin = 0
        while begin < len(total) - 1:
            end = max(begin + 1, int(np.searchsorted(total, total[begin] + most, "right")) - 1)
            if total[end] > total[begin]:
                yield k.start + begin, k.start + end
            begin = end


def _induced(text: np.ndarray, small: np.ndarray, flip: bool, seeds: np.ndarray, top: int, start: np.ndarray, most: int) -> np.ndarray:
    """The member suffixes in ascending order, from the sorted seeds. A member stands before the seeds of its symbol. flip: of the small suffixes, with the symbols in reverse."""
    queue, out, seeded = BulkQueue(most), Sink(np.int64, most), 0

    def symbols(at: np.ndarray) -> np.ndarray:
        s = text[at].astype(np.int64)
        return top - s if flip else s

    def before(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Members before the places, their symbols, and which places have one."""
        left = at - 1
        ok = np.flatnonzero(left >= 0)
        ok = ok[small[left[ok]] == flip]
        return left[ok], symbols(left[ok]), ok

    seed_symbol = array(len(seeds), np.int64, most)
    for k in spans(len(seeds), most):
        seed_symbol[k] = symbols(seeds[k])

    for low, high in _ranges(start, most, flip):
        if high == low + 1:
            own = BulkQueue(most)
            for of in (queue, own):
                for place in of.parts(low):
                    out.add(place)
                    left, symbol, _ = before(place)
                    same = symbol == low
                    own.push(symbol[same], left[same])
                    queue.push(symbol[~same], left[~same])
            n = 1
            while n:
                n = int(np.searchsorted(seed_symbol[seeded : seeded + most], high))
                left, symbol, _ = before(np.array(seeds[seeded : seeded + n]))
                queue.push(symbol, left)
                seeded += n
            continue
        place = queue.pop(high)
        n_seed = int(np.searchsorted(seed_symbol[seeded : seeded + most], high))
        started = np.array(seeds[seeded : seeded + n_seed])
        seeded += n_seed
        n_pop = len(place)
        places = [place, started]
        parents = [np.full(n_pop + n_seed, -1, np.int64)]
        front, ids = np.concatenate((place, started)), np.arange(n_pop + n_seed)
        total = n_pop + n_seed
        while len(front):
            left, symbol, ok = before(front)
            inside = symbol < high
            front, up = left[inside], ids[ok[inside]]
            ids = np.arange(total, total + len(front))
            total += len(front)
            places.append(front)
            parents.append(up)
        pos, parent = np.concatenate(places), np.concatenate(parents)
        symbol = symbols(pos)
        # A suffix induced by one of its own symbol stands in a run of that symbol: its order is that of the run's end, after all shorter runs.
        depth, head = np.zeros(total, np.int64), np.arange(total)
        at = n_pop + n_seed
        for level in places[2:]:
            k = slice(at, at + len(level))
            same = symbol[k] == symbol[parent[k]]
            depth[k] = np.where(same, depth[parent[k]] + 1, 0)
            head[k] = np.where(same, head[parent[k]], head[k])
            at += len(level)
        depth[n_pop : n_pop + n_seed] = 2**20 - 1
        major = (symbol << 21) | np.minimum(depth, 2**20 - 2 + (depth == 2**20 - 1))
        minor = np.empty(total, np.int64)
        minor[:n_pop] = np.arange(n_pop)
        minor[n_pop : n_pop + n_seed] = np.arange(n_seed)
        inner = parent[head] >= 0
        own_minor = minor[head[~inner]]
        # One number for both keys: the dense rank of the major one, then the minor one.
        dense = np.unique(major, return_inverse=True)[1] * np.int64(n_pop + total + 1)
        order = place_of = None
        inner_up = parent[head[inner]]
        for _ in range(total + 1):
            minor[~inner] = own_minor
            minor[inner] = n_pop + (0 if place_of is None else place_of[inner_up])
            new = np.argsort(dense + minor)
            if order is not None and np.array_equal(new, order):
                break
            order = new
            place_of = np.empty(total, np.int64)
            place_of[order] = np.arange(total)
            if not inner.any():
                break
        pos = pos[order]
        is_member = np.ones(total, bool)
        is_member[n_pop : n_pop + n_seed] = False
        out.add(pos[is_member[order]])
        left, symbol, _ = before(pos)
        queue.push(symbol[symbol >= high], left[symbol >= high])
    return out.array()


def _names(text: np.ndarray, small: np.ndarray, lms: np.ndarray, top: int, most: int) -> tuple[np.ndarray, int]:
    """Order-keeping names of the substrings from each local minimum to the next, and their number.

    A round sorts the substrings of equal rank by as many further symbols as a number holds; those that differ from all others, or have ended, leave.
    """
    n = len(lms)
    bits = (2 * top + 1).bit_length()
    wide = max(1, 62 // bits)
    ended, at = Sorter(most, 1), 0
    rank, which = array(n, np.int64, most), None

    def size(i: np.ndarray) -> np.ndarray:
        return np.where(i + 1 < n, lms[np.minimum(i + 1, n - 1)] - lms[i] + 1, 1)

    while len(rank):
        sorter = Sorter(most, 2)
        for k in spans(len(rank), most):
            i = np.arange(k.start, k.stop) if which is None else np.array(which[k])
            first, left = lms[i] + at, size(i) - at
            key = np.zeros(len(i), np.int64)
            for j in range(wide):
                place = np.minimum(first + j, len(text) - 1)
                key = (key << bits) | np.where(left > j, text[place].astype(np.int64) * 2 + small[place], 0)
            sorter.add(rank[k], key, i)
        at += wide
        next_rank, next_which = Sink(np.int64, most), Sink(np.int64, most)

        def part(r: np.ndarray, i: np.ndarray, alone: np.ndarray) -> None:
            go = ~alone & (size(i) > at)
            next_rank.add(r[go])
            next_which.add(i[go])
            ended.add(r[~go], i[~go])

        carry, seen, group, same = None, 0, 0, 0
        for r, key, i in sorter.merged():
            index = seen + np.arange(len(r))
            new_group = np.concatenate(([carry is None or r[0] != carry[0]], r[1:] != r[:-1]))
            new = new_group | np.concatenate(([carry is None or key[0] != carry[1]], key[1:] != key[:-1]))
            begin = np.maximum.accumulate(np.where(new, index, same))
            groups = np.maximum.accumulate(np.where(new_group, index, group))
            got = r + begin - groups
            seen, group, same = seen + len(r), int(groups[-1]), int(begin[-1])
            last = (int(r[-1]), int(key[-1]), int(got[-1]), int(i[-1]), bool(new[-1]))
            if carry is not None:
                got, i, new = np.append(carry[2], got), np.append(carry[3], i), np.append(carry[4], new)
            part(got[:-1], i[:-1], new[:-1] & new[1:])
            carry = last
        part(np.array([carry[2]]), np.array([carry[3]]), np.array([carry[4]]))
        rank, which = next_rank.array(), next_which.array()

    by_place, names, last = Sorter(most, 1), -1, -1
    for r, i in ended.merged():
        new = np.concatenate(([r[0] != last], r[1:] != r[:-1]))
        name = names + np.cumsum(new)
        by_place.add(i, name)
        names, last = int(name[-1]), int(r[-1])
    out = Sink(np.int64, most)
    for _, name in by_place.merged():
        out.add(name)
    return out.array(), names + 1


def suffix_order(text: np.ndarray, most: int = MEMORY) -> np.ndarray:
    """Places of all suffixes in ascending order. The last symbol must be the only 0."""
    n = len(text)
    if n <= 2:
        return np.arange(n)[::-1].copy()
    top = max(int(text[k].max()) for k in spans(n, most))
    small = array(n, bool, most)  # smaller than the suffix after it
    small[n - 1] = True
    for high in range(n - 1, 0, -most):
        low = max(0, high - most)
        step = np.sign(np.diff(text[low : high + 1].astype(np.int64)))
        known = np.where(step != 0, np.arange(high - low), high - low)
        after = np.minimum.accumulate(known[::-1])[::-1]
        small[low:high] = np.append(step > 0, small[high])[after]
    # Of every symbol, the number of large and of small suffixes before it, without the last one of all.
    start = [array(top + 2, np.int64, most) for _ in range(2)]
    minima = Sink(np.int64, most)
    for k in spans(n - 1, most):
        for s, of in enumerate(start):
            symbol = text[k][small[k] == bool(s)]
            if top < most:
                of[1:] += np.bincount(symbol, minlength=top + 1)
            else:
                symbol, count = np.unique(symbol, return_counts=True)
                of[symbol.astype(np.int64) + 1] += count
    for k in spans(n - 1, most):
        minima.add(np.flatnonzero(small[k.start + 1 : k.stop + 1] & ~small[k]) + k.start + 1)
    for of in start:
        before = 0
        for k in spans(len(of), most):
            of[k] = before + np.cumsum(of[k])
            before = int(of[k.stop - 1])
    every = array(top + 2, np.int64, most)
    for k in spans(top + 2, most):
        every[k] = start[0][k] + start[1][k] + (np.arange(k.start, k.stop) > 0)  # with the last suffix
    lms = minima.array()
    name, names = _names(text, small, lms, top, most)
    seeds = array(len(lms), np.int64, most)
    if names == len(lms):
        for k in spans(len(lms), most):
            seeds[name[k]] = lms[k]
    else:
        order = suffix_order(name, most)
        for k in spans(len(lms), most):
            seeds[k] = lms[order[k]]
        del order
    del name
    large = _induced(text, small, False, seeds, top, every, most)
    from_ = Sink(np.int64, most)
    for k in spans(len(large), most):
        back = large[len(large) - k.stop : len(large) - k.start][::-1]
        from_.add(back[(back > 0) & small[np.maximum(back - 1, 0)]])
    up = _induced(text, small, True, from_.array(), top, every, most)
    out = array(n, np.int64, most)
    out[0] = n - 1
    for k in spans(len(large), most):
        out[1 + np.arange(k.start, k.stop) + start[1][text[large[k]].astype(np.int64)]] = large[k]
    for k in spans(len(up), most):
        out[len(up) - np.arange(k.start, k.stop) + start[0][text[up[k]].astype(np.int64) + 1]] = up[k]
    return out
