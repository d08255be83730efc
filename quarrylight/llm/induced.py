"""External induced sorting of suffixes, with disk-backed priority queues of suffix tuples.

A text of symbols is sorted so, whatever its size beside the memory budget:

1. the suffixes at LMS positions (an S-type after an L-type) are the base. Their LMS substrings are sorted and named; where names
   repeat, the text of names is sorted by this same procedure, one level down;
2. a pass up the symbols takes the least suffixes from a priority queue and puts the suffix before each, if it is L-type, back
   into the queue; a pass down does the same for S-types. The queue is monotone: it deals tuples to blocks of symbols, each a
   first-in-first-out store that lives in memory up to the budget and on disk beyond; a block is put in order when its turn comes;
3. a tuple is (position, the word of symbols before it, first symbol, common prefix with the tuple before, run of its first
   symbol), so a suffix's predecessor is known without a look at the text; one tuple in a word's symbols reads the next word.

Common prefixes, up to `depth` bytes, are measured between neighbours of the sorted base only. All others are carried: a suffix
pushed to a bucket shares one symbol more with the bucket's last one than the suffixes that pushed them, which is the least value
visited in between; where L-types and S-types of a symbol meet, it is the shorter of their runs.

Strings matter to `depth` bytes, so names are told apart to that depth and the recursion ends where a symbol spans as many.
Texts, names and positions lie in scratch files mapped into memory where they pass the budget. Scratch files lie in the folders
that Spark itself spills to (SPARK_LOCAL_DIRS), and are gone when the sort ends; a task that is run again makes its own.
"""

from __future__ import annotations

import bisect
import os
import tempfile
from array import array
from collections.abc import Iterator

import numpy as np

END = 0xFF
#: Tuples that are gone through at once.
CHUNK = 1 << 17
#: Tuples of a block of several symbols.
BLOCK = 1 << 18
#: Bytes that an array takes beside its records.
PART = 128
SUFFIX = np.dtype([("pos", "<i8"), ("word", "<u8"), ("sym", "<u4"), ("lcp", "u1"), ("run", "u1"), ("spare", "<u2")])


def scratch():  # noqa: ANN201
    """A file without a name in the first folder that Spark spills to; it is gone once closed."""
    return tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None, buffering=0)


class Budget:
    """Bytes that all queues and arrays of a sort together may hold in memory; beyond, the largest queues go to disk."""

    def __init__(self, limit: int):
        self.limit, self.used, self.spilled, self.queues = limit, 0, 0, set()

    def array(self, n: int, kind: np.dtype) -> np.ndarray:
        """Zeros: in memory if they take no more than a quarter of the budget, else a mapped scratch file."""
        size = n * np.dtype(kind).itemsize
        if 4 * size <= self.limit:
            return np.zeros(n, kind)
        self.spilled += size
        return np.memmap(scratch(), kind, "w+", shape=(max(n, 1),))[:n]

    def hold(self, n: int) -> None:
        self.used += n
        if self.used > self.limit:
            for queue in sorted(self.queues, key=lambda q: -q.bytes):
                queue.spill()
                if 2 * self.used <= self.limit:
                    break


class Store:
    """A scratch file that a family of queues shares, opened when the first of them spills."""

    def __init__(self) -> None:
        self.file, self.size = None, 0

    def write(self, x: np.ndarray) -> int:
        self.file = self.file or scratch()
        at, self.size = self.size, self.size + x.nbytes
        self.file.seek(at)
        self.file.write(x.tobytes())
        return at

    def read(self, at: int, n: int, kind: np.dtype) -> np.ndarray:
        self.file.seek(at)
        return np.frombuffer(self.file.read(n * kind.itemsize), kind)


class Queue:
    """Records, first in first out, in memory or in segments of a store."""

    def __init__(self, budget: Budget, kind: np.dtype = SUFFIX, store: Store | None = None):
        self.budget, self.kind, self.store, self.size, self.bytes = budget, np.dtype(kind), store or Store(), 0, 0
        self.held = []
        # first records of the parts in the store, then of those held; where the former lie in the store
        self.starts, self.filed = array("q"), array("q")
        budget.queues.add(self)

    def append(self, x: np.ndarray) -> None:
        if len(x):
            self.held.append(x)
            self.starts.append(self.size)
            self.size += len(x)
            self.bytes += x.nbytes + PART
            self.budget.hold(x.nbytes + PART)

    def spill(self) -> None:
        if self.held:
            x = self.held[0] if len(self.held) == 1 else np.concatenate(self.held)
            del self.starts[len(self.filed) + 1 :]
            self.filed.append(self.store.write(x))
            self.budget.used -= self.bytes
            self.budget.spilled += x.nbytes
            self.held, self.bytes = [], 0

    def part(self, lo: int, hi: int) -> np.ndarray:
        """Records lo..hi (hi not included), wherever they are now."""
        found, i = [], bisect.bisect_right(self.starts, lo) - 1
        while lo < hi:
            skip = lo - self.starts[i]
            if i < len(self.filed):
                end = min(hi, self.starts[i + 1] if i + 1 < len(self.starts) else self.size)
                found.append(self.store.read(self.filed[i] + skip * self.kind.itemsize, end - lo, self.kind))
            else:
                found.append(self.held[i - len(self.filed)][skip : skip + hi - lo])
            lo, i = lo + len(found[-1]), i + 1
        if len(found) < 2:
            return found[0] if found else np.zeros(0, self.kind)
        plain = np.dtype(("V", self.kind.itemsize))  # records are joined as bytes, which is faster than field by field
        return np.concatenate([x.view(plain) for x in found]).view(self.kind)

    def chunks(self) -> Iterator[np.ndarray]:
        """In order, at most CHUNK records at once; what is appended meanwhile comes too."""
        done = 0
        while done < self.size:
            x = self.part(done, min(done + CHUNK, self.size))
            done += len(x)
            yield x

    def backwards(self) -> Iterator[np.ndarray]:
        """The records from the last to the first."""
        for hi in range(self.size, 0, -CHUNK):
            yield self.part(max(0, hi - CHUNK), hi)[::-1]

    def all(self) -> np.ndarray:
        return self.part(0, self.size)

    def drop(self) -> None:
        self.budget.used -= self.bytes
        self.budget.queues.discard(self)
        self.held, self.filed, self.starts, self.size, self.bytes = [], array("q"), array("q"), 0, 0


def family(budget: Budget, n: int, kind: np.dtype = SUFFIX) -> list[Queue]:
    """n queues that share a scratch file."""
    store = Store()
    return [Queue(budget, kind, store) for _ in range(n)]


class Symbols:
    """A text of n symbols of `width` bits, with spare symbols behind it so that whole words can be read anywhere."""

    def __init__(self, budget: Budget, n: int, width: int):
        self.n, self.width, self.per = n, width, 64 // width
        self.data = budget.array(-(-n // self.per) * self.per + 4 * self.per, "u1" if width == 8 else "<u4")
        self.mask = np.uint64((1 << width) - 1)

    def words(self, index: np.ndarray) -> np.ndarray:
        """The aligned words that hold the symbols at `index`."""
        return self.data.view("<u8")[index // self.per]

    def before(self, x: np.ndarray) -> np.ndarray:
        """The symbol before each tuple's position, from the word that it carries; position 0 has none that counts."""
        shift = ((x["pos"] - 1) % self.per * self.width).astype(np.uint64)
        return ((x["word"] >> shift) & self.mask).astype(np.uint32)

    def tuples(self, pos: np.ndarray) -> np.ndarray:
        out = np.zeros(len(pos), SUFFIX)
        out["pos"], out["sym"] = pos, self.data[pos]
        out["word"] = self.words(np.maximum(pos - 1, 0))
        return out

    def key(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A word's symbols from `start`, the first one highest; symbols after `end` count as greatest."""
        if self.width == 8:
            found = np.ndarray(len(self.data) - 8, ">u8", self.data.data, 0, (1,))[start].astype(np.uint64)
        else:
            found = (self.data[start].astype(np.uint64) << np.uint64(32)) | self.data[start + 1]
        over = np.clip(self.per - 1 - (end - start), 0, self.per) * self.width
        fill = (np.uint64(1) << (over % 64).astype(np.uint64)) - np.uint64(1)
        return np.where(over >= 64, np.uint64(0xFFFFFFFFFFFFFFFF), found | fill)

    def lms(self) -> Iterator[np.ndarray]:
        """LMS positions, from the last to the first, a stretch of the text at a time."""
        next_symbol, next_is_s = -1, True  # behind the text stands a symbol less than all
        after = None  # the first position of the stretch to the right, if it is S-type
        for lo in range((self.n - 1) // (8 * CHUNK) * 8 * CHUNK, -1, -8 * CHUNK):
            x = self.data[lo : min(lo + 8 * CHUNK, self.n)].astype(np.int64)
            rises = np.sign(np.append(x[1:], next_symbol) - x)
            if rises[-1] == 0:
                rises[-1] = 1 if next_is_s else -1
            at = np.where(rises != 0, np.arange(len(x)), len(x))
            s_type = rises[np.minimum.accumulate(at[::-1])[::-1]] > 0
            found = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1 + lo
            if after is not None and not s_type[-1]:
                found = np.append(found, after)
            yield found[::-1]
            next_symbol, next_is_s = int(x[0]), bool(s_type[0])
            after = lo if next_is_s else None


def range_minima(v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of v[lo..hi] (both included, lo <= hi), by a table of minima of powers of two."""
    levels = [v]
    while 2 << (len(levels) - 1) <= len(v):
        step = 1 << (len(levels) - 1)
        x = v.copy()
        x[: len(v) - step] = np.minimum(levels[-1][: len(v) - step], levels[-1][step:])
        levels.append(x)
    table = np.concatenate(levels)
    k = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    at = k * len(v)
    return np.minimum(table[at + lo], table[at + hi + 1 - (1 << k)])


class Sorter:
    """Sorts the suffixes of one text of symbols; `span` bytes are the least a symbol stands for."""

    def __init__(self, text: Symbols, budget: Budget, depth: int, span: int, cuts: np.ndarray):
        """cuts: where blocks of symbols begin, and the number of symbols. Each byte is a block; names come together."""
        self.text, self.budget, self.depth, self.span, self.cuts = text, budget, depth, span, cuts
        self.blocks = len(cuts) - 1
        self.carried = text.width == 8  # whether common prefixes are carried

    # the base

    def base(self) -> Iterator[np.ndarray]:
        """LMS positions in the order of their suffixes, to `depth` bytes."""
        backwards = Queue(self.budget, np.int64)
        for x in self.text.lms():
            backwards.append(x)
        m = backwards.size
        position = self.budget.array(m + 1, np.int64)
        at = 0
        for x in backwards.backwards():
            position[at : at + len(x)] = x
            at += len(x)
        backwards.drop()
        position[m] = self.text.n - 1
        names = Symbols(self.budget, m, 32)
        order, cuts = self._named(position, names)
        if cuts[-1] < m and 2 * self.span < self.depth:
            order.drop()
            deeper = Sorter(names, self.budget, self.depth, 2 * self.span, cuts)
            order = Queue(self.budget, np.int64)
            for x, _ in deeper.descending():
                order.append(x)
            for x in order.backwards():
                yield position[x]
        else:
            for x in order.chunks():
                yield position[x]
        order.drop()

    def _named(self, position: np.ndarray, names: Symbols) -> tuple[Queue, np.ndarray]:
        """Numbers the LMS substrings in order: fills `names`, returns the order and where blocks of names begin: names of about
        BLOCK occurrences together, one that has half as many for itself."""
        m, kind = names.n, np.dtype([("key", "<u8"), ("k", "<i8")])
        order, cuts, at, total = Queue(self.budget, np.int64), [np.zeros(1, np.int64)], 0, 0
        # records are dealt by ranges of their first word, so that a range fits the budget
        parts = max(1, -(-m * 96 // self.budget.limit))
        step = max(1, m // (64 * parts))
        sample = np.sort(self.text.key(position[:m:step], position[1 : m + 1 : step])) if parts > 1 else np.zeros(0, np.uint64)
        splits = np.unique(sample[np.linspace(0, len(sample), parts, endpoint=False).astype(np.int64)[1:]]) if parts > 1 else sample
        ranges = family(self.budget, len(splits) + 1, kind)
        for lo in range(0, m, 8 * CHUNK):
            k = np.arange(lo, min(lo + 8 * CHUNK, m))
            x = np.zeros(len(k), kind)
            x["key"], x["k"] = self.text.key(position[k], position[k + 1]), k
            to = np.searchsorted(splits, x["key"], side="right")
            for r in np.unique(to).tolist() if len(ranges) > 1 else [0]:
                ranges[r].append(x[to == r] if len(ranges) > 1 else x)
        for held in ranges:
            x = held.all()
            held.drop()
            if not len(x):
                continue
            k, new = self._in_order(x["key"], x["k"], position)
            name = np.cumsum(new) - 1
            names.data[k] = at + name
            n = np.bincount(name)
            full = (total + np.cumsum(n) - n) // BLOCK
            heavy = np.flatnonzero(2 * n > BLOCK)
            cuts += [at + np.flatnonzero(np.diff(full, prepend=full[0])), at + heavy, at + heavy + 1]
            at, total = at + len(n), total + len(k)
            order.append(k)
        return order, np.unique(np.concatenate([*cuts, [at]]))

    def _in_order(self, key: np.ndarray, k: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """LMS numbers in the order of their substrings, and whether each differs from the one before. The first word sorts
        nearly all; only longer substrings with an equal word look at the next."""
        sort = np.argsort(key, kind="stable")
        key, k = key[sort], k[sort]
        new = np.ones(len(k), bool)
        new[1:] = key[1:] != key[:-1]
        per, words = self.text.per, -(-self.depth // (self.span * self.text.per)) + 1
        length = position[k + 1] - position[k] + 1
        for j in range(1, words):
            alone = new & np.append(new[1:], True)
            group = np.cumsum(new)
            longer = np.zeros(group[-1] + 1, bool)
            longer[group[length > j * per]] = True
            left = np.flatnonzero(longer[group] & ~alone)
            if not len(left):
                break
            start = np.minimum(position[k[left]] + j * per, position[k[left] + 1] + 1)
            word = self.text.key(start, position[k[left] + 1])
            sort = np.lexsort((word, group[left]))
            k[left], length[left], word = k[left][sort], length[left][sort], word[sort]
            new[left[1:]] |= word[1:] != word[:-1]
        return k, new

    def _base_tuples(self) -> Iterator[np.ndarray]:
        last = None
        for pos in self.base():
            x = self.text.tuples(pos)
            if self.carried:
                x["lcp"] = self._measured(np.append(pos[:1] if last is None else last, pos[:-1]), pos)
                if last is None:
                    x["lcp"][0] = 0
                x["run"] = self._runs(pos)
            last = pos[-1:] if len(pos) else last
            yield x

    def _measured(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of suffixes a and b, to `depth`."""
        out = np.zeros(len(a), np.uint8)
        left, last = np.arange(len(a)), self.text.n - 1
        for o in range(0, self.depth, 8):
            x, y = (self.text.key(np.minimum(p[left] + o, last + 1), np.full(len(left), last)) for p in (a, b))
            d = x ^ y
            out[left] += sum((d >> np.uint64(s) == 0).astype(np.uint8) for s in range(56, -8, -8))
            left = left[d == 0]
            if not len(left):
                break
        return np.minimum(out, self.depth)

    def _runs(self, pos: np.ndarray) -> np.ndarray:
        out = np.ones(len(pos), np.uint8)
        left, sym = np.arange(len(pos)), self.text.data[pos]
        for o in range(1, self.depth):
            left = left[(pos[left] + o < self.text.n) & (self.text.data[np.minimum(pos[left] + o, self.text.n)] == sym[left])]
            if not len(left):
                break
            out[left] += 1
        return out

    # the passes

    def descending(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All suffixes from the greatest to the least: positions, and the common prefix of each with the one before it."""
        low = self._up()
        self._begin(up=False)
        for b in range(self.blocks - 1, -1, -1):
            lesser = low[b]
            if self._is_one(b):
                last = None  # the last tuple that was visited in this block
                for x in self.queue[b].chunks():
                    yield self._visit(x, x["lcp"], lambda prev, sym: prev <= sym)
                    last = x[-1]
                held = None
                for x in lesser.backwards():
                    seam = (0 if last is None else min(last["run"], x["run"][0])) if held is None else held
                    v = np.append(np.uint8(seam), x["lcp"][:-1])
                    held = x["lcp"][-1]
                    yield self._visit(x, v, lambda prev, sym: prev < sym)
            else:
                x = self._settle(b, self.queue[b].all(), lesser.all()[::-1])
                yield x["pos"], x["lcp"]
            self.queue[b].drop()
            lesser.drop()

    def _up(self) -> list[Queue]:
        """The pass up: L-types in order, by block."""
        base = family(self.budget, self.blocks)
        for x in self._base_tuples():
            self._deal(base, x)
        self._begin(up=True)
        end = self.text.tuples(np.array([self.text.n - 1]))
        end["run"] = 1
        self._deal(self.queue, end)
        if self.carried:
            self.seen[end["sym"]] = True
        low, store = [], Store()
        for b in range(self.blocks):
            if self._is_one(b):
                last = None
                for x in self.queue[b].chunks():
                    self._visit(x, x["lcp"], lambda prev, sym: prev >= sym)
                    last = x[-1]
                low.append(self.queue[b])
                for x in base[b].chunks():
                    v = x["lcp"]
                    if last is not None:
                        v = np.append(np.uint8(min(last["run"], x["run"][0])), v[1:])
                        last = None
                    self._visit(x, v, lambda prev, sym: prev > sym)
            else:
                x = self._settle(b, self.queue[b].all(), base[b].all())
                self.queue[b].drop()
                low.append(Queue(self.budget, SUFFIX, store))
                low[-1].append(x[x["spare"] == 0])
            base[b].drop()
        return low

    def _begin(self, up: bool) -> None:
        self.up, self.queue = up, family(self.budget, self.blocks)
        self.pending, self.seen = np.zeros(256, np.uint8), np.zeros(256, bool)

    def _is_one(self, b: int) -> bool:
        return self.cuts[b + 1] - self.cuts[b] == 1

    def _deal(self, queues: list[Queue], x: np.ndarray, ordered: bool = False) -> None:
        """Append tuples to the queues of their blocks, keeping their order; `ordered` ones are by block already."""
        if len(x):
            to = x["sym"].astype(np.uint8) if self.carried else np.searchsorted(self.cuts, x["sym"], side="right") - 1
            if not ordered:
                order = np.argsort(to, kind="stable")
                to, x = to[order], x[order]
            ends = np.flatnonzero(to[1:] != to[:-1]) + 1
            for lo, hi in zip([0, *ends.tolist()], [*ends.tolist(), len(x)], strict=True):
                queues[int(to[lo])].append(x[lo:hi].copy())  # a view would keep all of x alive

    def _induced(self, x: np.ndarray, which: np.ndarray, prev: np.ndarray) -> np.ndarray:
        """Tuples of the suffixes before x[which]."""
        out = x[which]
        out["run"] = np.where(prev[which] == out["sym"], np.minimum(out["run"], 254) + 1, 1)
        out["pos"] -= 1
        out["sym"] = prev[which]
        refill = np.flatnonzero((out["pos"] % self.text.per == 0) & (out["pos"] > 0))
        out["word"][refill] = self.text.words(out["pos"][refill] - 1)
        return out

    def _visit(self, x: np.ndarray, v: np.ndarray, rule) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
        """Goes through tuples of one symbol in order and pushes what they induce; v: common prefixes with the tuple before."""
        prev = self.text.before(x)
        which = np.flatnonzero(rule(prev, x["sym"]) & (x["pos"] > 0))
        out = self._induced(x, which, prev)
        if self.carried:
            least = v.min()
            if len(which):
                order = np.argsort(out["sym"].astype(np.uint8), kind="stable")
                out, at, sym = out[order], which[order], out["sym"][order]
                first = np.append(True, sym[1:] != sym[:-1])
                lo = np.where(first, 0, np.append(0, at[:-1] + 1))
                m = range_minima(v, lo, at)
                begin = np.flatnonzero(first)
                m[begin] = np.minimum(m[begin], self.pending[sym[begin]])
                out["lcp"] = np.minimum(m, self.depth - 1) + 1
                out["lcp"][begin[~self.seen[sym[begin]]]] = 0
                self.seen[sym[begin]] = True
                self.pending = np.minimum(self.pending, least)
                last = at[np.append(begin[1:], len(at)) - 1]
                rest = np.full(len(last), self.depth, np.uint8)
                has = last + 1 < len(v)
                rest[has] = range_minima(v, last[has] + 1, np.full(has.sum(), len(v) - 1))
                self.pending[sym[begin]] = rest
            else:
                self.pending = np.minimum(self.pending, least)
        self._deal(self.queue, out, ordered=self.carried)
        return x["pos"], v

    def _settle(self, b: int, pushed: np.ndarray, others: np.ndarray) -> np.ndarray:
        """A block of several symbols in the order of the pass: what was pushed, what that induces inside the block, and the
        others (of the type that comes later in a symbol). Their field `spare` is 1 for the others. What they induce in later
        blocks is pushed.

        A tuple induced inside the block goes by its symbol, then by the place of the tuple that induced it: places are found
        by doubling along these chains, a sort for each power of two of the longest chain.
        """
        lo, hi = int(self.cuts[b]), int(self.cuts[b + 1])
        x = np.concatenate([pushed, others])
        x["spare"] = np.append(np.zeros(len(pushed), np.uint16), np.ones(len(others), np.uint16))
        roots = len(x)
        successor, parts, fresh, offset, longest = [np.arange(roots)], [x], x, 0, 0
        while True:
            prev = self.text.before(fresh)
            inside = np.flatnonzero(self._induces(fresh, prev) & (prev >= lo) & (prev < hi))
            if not len(inside):
                break
            successor.append(inside + offset)
            offset += len(fresh)
            fresh = self._induced(fresh, inside, prev)
            fresh["spare"] = 0
            parts.append(fresh)
            longest += 1
        x, succ = np.concatenate(parts), np.concatenate(successor)
        sym = x["sym"].astype(np.uint64)
        sym = sym - np.uint64(lo) if self.up else np.uint64(hi - 1) - sym
        late = 2 * x["spare"].astype(np.uint64)
        late[roots:] = 1
        number = np.arange(len(x), dtype=np.uint64)
        number[roots:] = 0
        place = np.unique((sym << np.uint64(34)) | (late << np.uint64(32)) | number, return_inverse=True)[1]
        step = 1
        while step <= longest:
            place = np.unique(place * len(x) + place[succ], return_inverse=True)[1]
            succ, step = succ[succ], 2 * step
        out = np.empty_like(x)
        out[place] = x
        prev = self.text.before(out)
        beyond = self._induces(out, prev) & ((prev >= hi) if self.up else (prev < lo))
        pushed = self._induced(out, np.flatnonzero(beyond), prev)
        pushed["spare"] = 0
        self._deal(self.queue, pushed)
        return out

    def _induces(self, x: np.ndarray, prev: np.ndarray) -> np.ndarray:
        same_type = x["spare"] == 0
        more = prev > x["sym"] if self.up else prev < x["sym"]
        return (more | (same_type & (prev == x["sym"]))) & (x["pos"] > 0)


def sorted_suffixes(text: Symbols, budget: Budget, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all suffixes of a text of bytes from the greatest to the least, each with its common prefix with the one
    before, both to `depth` bytes. The text ends with the byte END."""
    return Sorter(text, budget, depth, 1, np.arange(257)).descending()


def equal_runs(found: Iterator[tuple[np.ndarray, np.ndarray]], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in runs of two or more with a common prefix of `depth`, and the number of each one's run; a run is never cut,
    so that what comes at once is at least one run."""
    held = np.zeros(0, np.int64)
    for pos, v in found:
        same = v >= depth
        if not len(pos):
            continue
        if same.all():
            held = np.append(held, pos)
            continue
        ends = np.flatnonzero(~same)
        yield from _numbered(np.append(held, pos[: ends[-1]]), np.append(np.arange(len(held)) > 0, same[: ends[-1]]))
        held = pos[ends[-1] :]
    yield from _numbered(held, np.arange(len(held)) > 0)


def _numbered(pos: np.ndarray, same: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    several = same | np.append(same[1:], False)[: len(same)]
    if several.any():
        run = np.cumsum(~same)
        yield pos[several], run[several]
