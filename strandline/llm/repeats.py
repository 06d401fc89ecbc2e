"""Runs of periodically repeated words, by the linear tandem-repeat method of Gusfield and Stoye.

A square is a word sequence followed by itself; a run is a longest stretch that
one period rules. The steps, over whole words:

1. The text is cut into Lempel-Ziv blocks. Around the border of each block,
   extensions to both sides give squares that cover the leftmost occurrence of
   every kind of square (a kind is covered by its left neighbours' rotations).
2. In the suffix tree, each of these is followed along suffix links to its
   rotations, until a rotation does not occur or has been seen. What is marked
   is the complete vocabulary of squares.
3. The leaves below a marked place are the occurrences of its kind; occurrences
   of one period that begin next to each other are one run.

Only squares whose half is not itself a repetition are followed: rotations of
such are such again, and a run's least period is one of theirs.

Texts of a batch are laid end to end with separators of their own, so all of a
batch is one text with one suffix tree. Before that, stretches are found
outside of which no run can be: every few words of a wanted run come again one
period further on or back, so a stretch without such twins holds none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import kernels

#: A run has at least so many words, and at least so many periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4

_WORD = kernels.member_table(lambda b: b != 32 and not 9 <= b <= 13)
_U = np.uint64


class Names:
    """Names of all stretches of 1, 2, 4 ... words: equal stretches have equal names, and names have the stretches' order.

    The first and the last code, and those that part texts, occur once.
    """

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        level = np.unique(codes, return_inverse=True)[1]
        self.levels = [level.astype(np.int32)]
        while int(level.max()) + 1 < n:
            step = 1 << (len(self.levels) - 1)
            after = np.zeros(n, np.int64)
            after[: n - step] = level[step:] + 1
            level = np.unique(level * np.int64(n + 1) + after, return_inverse=True)[1]
            self.levels.append(level.astype(np.int32))
        self.n, self.rank = n, self.levels[-1]
        self.order = np.empty(n, np.int64)
        self.order[self.rank] = np.arange(n)

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from places a and b on are equal; a and b differ."""
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for t in range(len(self.levels) - 2, -1, -1):
            step = (self.levels[t][a] == self.levels[t][b]).astype(np.int64) << t
            a, b, out = a + step, b + step, out + step
        return out

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from places a and b back are equal; a and b differ, and may be before the text."""
        a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for t in range(len(self.levels) - 2, -1, -1):
            x, y = a - (1 << t) + 1, b - (1 << t) + 1
            inside = (x >= 0) & (y >= 0)
            level = self.levels[t]
            step = (inside & (level[np.maximum(x, 0)] == level[np.maximum(y, 0)])).astype(np.int64) << t
            a, b, out = a - step, b - step, out + step
        return out

    def kind(self, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two names that, with the size, tell stretches apart."""
        left, right = np.zeros(len(at), np.int32), np.zeros(len(at), np.int32)
        power = np.minimum(np.frexp(size.astype(np.float64))[1] - 1, len(self.levels) - 1)
        for t in np.unique(power).tolist():
            here = power == t
            left[here] = self.levels[t][at[here]]
            right[here] = self.levels[t][at[here] + size[here] - (1 << t)]
        return left, right


def blocks(names: Names) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks, and the end: each block is the longest that begins earlier too, or one word."""
    n, rank = names.n, names.rank.tolist()
    low, high = [-1] * n, [n] * n
    up, down = list(range(-1, n - 1)), list(range(1, n + 1))
    for i in range(n - 1, -1, -1):  # of the suffixes that begin earlier, the neighbours in order
        r = rank[i]
        p, q = up[r], down[r]
        low[i], high[i] = p, q
        if p >= 0:
            down[p] = q
        if q < n:
            up[q] = p
    longest, at = np.zeros(n, np.int64), np.arange(n)
    for side in (np.array(low), np.array(high)):
        ok = (side >= 0) & (side < n)
        longest[ok] = np.maximum(longest[ok], names.forward(at[ok], names.order[side[ok]]))
    starts, sizes, h = [], np.maximum(longest, 1).tolist(), 0
    while h < n:
        starts.append(h)
        h += sizes[h]
    return np.array([*starts, n])


def covering_squares(names: Names) -> tuple[np.ndarray, np.ndarray]:
    """(starts, periods) of squares that cover the leftmost occurrence of every kind."""
    n, codes = names.n, names.levels[0]
    cut = blocks(names)
    start, end = cut[:-1], cut[1:]
    far = np.append(end[1:], n)

    def tried(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(block, k) for k = 1 .. count of each block."""
        block = np.repeat(np.arange(len(count)), count)
        return block, np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count) + 1

    # squares that begin in a block and hold the first word of the next in their right half
    block, k = tried(np.where(end < n, end - start, 0))
    border = end[block]
    twin = border - k
    ok = codes[border] == codes[twin]
    k, border, twin = k[ok], border[ok], twin[ok]
    right, left = names.forward(border, twin), names.backward(border - 1, twin - 1)
    ok = right + left >= k
    first = [np.maximum(twin - left, twin - k + 1)[ok]]
    period = [k[ok]]
    # squares that begin before a block, hold its first word in their left half and end their left half in it
    block, k = tried(np.where(start > 0, far - start, 0))
    border = start[block]
    twin = border + k
    ok = twin < n
    ok[ok] = codes[border[ok]] == codes[twin[ok]]
    ok[ok] &= codes[border[ok] - 1] == codes[twin[ok] - 1]
    block, k, border, twin = block[ok], k[ok], border[ok], twin[ok]
    right, left = names.forward(border, twin), names.backward(border - 1, twin - 1)
    at = np.maximum(border - left, border - k + 1)
    ok = (right + left >= k) & (at + k <= end[block])
    first.append(at[ok])
    period.append(k[ok])
    return np.concatenate(first), np.concatenate(period)


def primitive(names: Names, at: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether the squares' halves are no repetitions themselves."""
    ok = np.ones(len(at), bool)
    if not len(at):
        return ok
    top = int(period.max())
    factor = np.arange(top + 1)  # a prime factor of each number
    for p in range(2, int(top**0.5) + 1):
        if factor[p] == p:
            factor[p * p :: p] = p
    rest = period.copy()
    while (live := np.flatnonzero(ok & (rest > 1))).size:
        p = factor[rest[live]]
        shorter = period[live] // p
        ok[live] &= names.forward(at[live], at[live] + shorter) < 2 * period[live] - shorter
        rest[live] //= p
    return ok


class SuffixTree:
    """The suffix tree of a text, as nested ranges of its ordered suffixes, with pointers for climbing."""

    def __init__(self, names: Names):
        n = names.n
        self.order, self.rank, self.codes = names.order.tolist(), names.rank.tolist(), names.levels[0].tolist()
        shared = np.zeros(n, np.int64)
        shared[1:] = names.forward(names.order[:-1], names.order[1:])
        depth, parent, low, high = [0], [0], [0], [n - 1]
        above, open_ = [0] * n, [0]
        for r, d in enumerate(shared.tolist()):
            last = -1
            while depth[open_[-1]] > d:
                last = open_.pop()
                high[last] = r - 1
                parent[last] = open_[-1]
            if depth[open_[-1]] < d:
                new = len(depth)
                depth.append(d)
                parent.append(open_[-1])
                low.append(r - 1 if last < 0 else low[last])
                high.append(n - 1)
                if last < 0:
                    above[r - 1] = new
                else:
                    parent[last] = new
                open_.append(new)
            above[r] = open_[-1]
        self.depth, self.parent, self.low, self.high, self.above = depth, parent, low, high, above
        # pointers that skip ancestors, of lengths such that any ancestor is a logarithm of them away
        jump, steps = [0] * len(depth), [0] * len(depth)
        for v in np.argsort(np.array(depth), kind="stable").tolist()[1:]:
            p = parent[v]
            steps[v] = steps[p] + 1
            j = jump[p]
            jump[v] = jump[j] if steps[p] - steps[j] == steps[j] - steps[jump[j]] else p
        self.jump = jump

    def place(self, at: int, size: int) -> tuple[int, int]:
        """The range of suffixes that begin like the one at ``at`` for ``size`` words."""
        r, depth, parent, jump = self.rank[at], self.depth, self.parent, self.jump
        v = self.above[r]
        if depth[v] < size:
            return r, r
        while depth[parent[v]] >= size:
            v = jump[v] if depth[jump[v]] >= size else parent[v]
        return self.low[v], self.high[v]

    def rotation(self, at: int, size: int) -> int | None:
        """Where the stretch of ``size`` words at ``at`` occurs with its first word put last, if it does."""
        codes, order = self.codes, self.order
        first = codes[at]
        if codes[at + size] == first:
            return at + 1
        low, high = self.place(at + 1, size - 1)  # the suffix link; then down the branch of the first word
        end = high + 1
        while low < end:
            mid = (low + end) // 2
            if codes[order[mid] + size - 1] < first:
                low = mid + 1
            else:
                end = mid
        return order[low] if low <= high and codes[order[low] + size - 1] == first else None


def vocabulary(names: Names) -> list[tuple[int, int, int]]:
    """(period, low, high) of every kind of square with a primitive half: the range of suffixes that begin with it."""
    at, period = covering_squares(names)
    ok = primitive(names, at, period)
    at, period = at[ok], period[ok]
    if not len(at):
        return []
    kinds = np.stack([period, *names.kind(at, 2 * period)])
    one = np.unique(kinds, axis=1, return_index=True)[1]
    tree, seen, out = SuffixTree(names), set(), []
    for i, q in zip(at[one].tolist(), period[one].tolist(), strict=True):
        while i is not None:
            low, high = tree.place(i, 2 * q)
            if (low, q) in seen:
                break
            seen.add((low, q))
            out.append((q, low, high))
            i = tree.rotation(i, 2 * q)
    return out


def all_runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every run of a text of codes, of two periods at least; texts are parted by codes that occur once."""
    names = Names(codes)
    kinds = np.array(vocabulary(names), np.int64).reshape(-1, 3)
    period, low, count = kinds[:, 0], kinds[:, 1], kinds[:, 2] - kinds[:, 1] + 1
    q = np.repeat(period, count)
    at = names.order[np.repeat(low - np.cumsum(count) + count, count) + np.arange(int(count.sum()))]
    key = np.sort(q * (names.n + 1) + at)
    first = np.flatnonzero(np.diff(key, prepend=-2) != 1)
    last = np.append(first[1:], len(key)) - 1 if len(key) else first
    q, start = np.divmod(key[first], names.n + 1)
    return start, key[last] - key[first] + 2 * q, q


def twin_size(least: int, periods: int) -> int:
    """The greatest k so that every k words of a run with the least length come again a period further on or back within it."""
    return max(1, min(max(least, periods * q) - 2 * q + 1 for q in range(1, least + 1)))


def stretches(hashes: np.ndarray, offs: np.ndarray, least: int, periods: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of stretches of words that hold all runs; ``offs`` are the texts' first words, and the end."""
    k = twin_size(least, periods)
    n, size = len(hashes), np.diff(offs)
    text = np.repeat(np.arange(len(size)), size)
    at = np.flatnonzero(np.arange(n) + k <= offs[text + 1]) if n else np.zeros(0, np.int64)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = text[at].astype(np.uint64)
    for j in range(k):
        h = kernels.mix((h ^ hashes[at + j]) + _U(0x9E3779B97F4A7C15))
    order = np.argsort(h, kind="stable")
    gap = np.diff(at[order])
    gap[h[order[1:]] != h[order[:-1]]] = n + 1
    near = np.full(len(at), n + 1)
    near[order[1:]] = gap
    near[order[:-1]] = np.minimum(near[order[:-1]], gap)
    # a period is at most a run's length over the periods
    ok = near * periods <= size[text[at]]
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at[ok], 1)
    np.add.at(change, at[ok] + k, -1)
    first, end = kernels.runs(np.cumsum(change[:-1]) > 0, offs)
    nearest = np.full(n, n + 1)
    nearest[at[ok]] = near[ok]
    closest = np.minimum.reduceat(nearest, first) if len(first) else first
    ok = (end - first >= least) & (closest * periods <= end - first)
    return first[ok], end[ok]


def runs_of_texts(col: pa.Array, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text of a column, by start and period."""
    data, offs = kernels.text_buffer(col)
    first, end = kernels.runs(_WORD[data], offs)
    lo, _ = kernels.per_document(first, offs)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(col))]
    bounds = np.append(lo, len(first))
    a, b = stretches(kernels.span_hashes(data, first, end), bounds, least, periods)
    if not len(a):
        return out
    # words as numbers by their bytes, and a separator before each stretch and at the end
    known: dict[bytes, int] = {}
    words = np.repeat(a - np.cumsum(b - a) + (b - a), b - a) + np.arange(int((b - a).sum()))
    numbers = [known.setdefault(data[s:e].tobytes(), len(known)) for s, e in zip(first[words].tolist(), end[words].tolist(), strict=True)]
    where = np.cumsum(b - a + 1) - (b - a)  # where each stretch begins in the codes
    codes = np.full(len(words) + len(a) + 1, -1, np.int64)
    place = np.arange(len(words)) + np.repeat(np.arange(1, len(a) + 1), b - a)
    codes[place] = numbers
    codes[codes < 0] = len(known) + np.arange(len(a) + 1)
    start, length, period = all_runs(codes)
    ok = length >= np.maximum(least, periods * period)
    start, length, period = start[ok], length[ok], period[ok]
    stretch = np.searchsorted(where, start, "right") - 1
    start = start - where[stretch] + a[stretch]
    text = np.searchsorted(bounds, start, "right") - 1
    for t, s, n, q in sorted(zip(text.tolist(), (start - bounds[text]).tolist(), length.tolist(), period.tolist(), strict=True), key=lambda r: (r[0], r[1], r[3])):
        out[t].append((s, n, q))
    return out


def collapsed(text: str | None, runs: list[tuple[int, int, int]]) -> bytes:
    """The words of a text joined by one space, without those that a run contains after its first period."""
    words = (text or "").encode().split()
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
    return b" ".join(words)


def _scan(df: DataFrame, id_col: str, text_col: str, least: int, periods: int, schema: str, make) -> DataFrame:
    """Rows that ``make`` gives from (doc_id, text, runs) of each row."""
    if least < 2 or periods < 2:
        raise ValueError("a run has at least two words and two periods")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in kernels.slices(b, "text"):
                found = runs_of_texts(s.column("text"), least, periods)
                rows = [make(i, t, r) for i, t, r in zip(s.column("doc_id").to_pylist(), s.column("text").to_pylist(), found, strict=True)]
                yield pa.RecordBatch.from_pylist(rows, schema=made)
        kernels.give_back()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    made = to_arrow_schema(StructType.fromDDL(schema))
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def find_runs(df: DataFrame, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, period of every run of each row's words (maximal stretches of anything but ASCII white space).

    A run is a longest stretch with a least period, of at least ``least`` words
    and ``periods`` periods. A null or empty text has none; repeated rows each
    give theirs; a null id is kept; an empty table gives an empty result; extra
    columns are not read.
    """
    schema = "doc_id bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>"
    made = _scan(df, id_col, text_col, least, periods, schema, lambda i, t, runs: {"doc_id": i, "runs": [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs]})
    return made.select("doc_id", F.explode("runs").alias("r")).select("doc_id", "r.*")


def collapse_runs(df: DataFrame, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text of each row, its words joined by one space, of each run only the first period. A null text becomes empty; rows as in :func:`find_runs`."""
    return _scan(df, id_col, text_col, least, periods, "doc_id bigint, text string", lambda i, t, runs: {"doc_id": i, "text": collapsed(t, runs).decode()})


def run_digests(df: DataFrame, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_runs, the run of the greatest length over period (ties: least start, then period; nulls without runs) with its exponent in thousandths, and digests of all runs and of the collapsed text; rows as in :func:`find_runs`."""

    def make(i: int | None, t: str | None, runs: list[tuple[int, int, int]]) -> dict:
        start, length, period = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None, None, None)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        return {
            "doc_id": i, "n_runs": len(runs), "start": start, "length": length, "period": period, "exponent_milli": 1000 * length // period if runs else None,
            "runs_sha256": hashlib.sha256(listed.encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(collapsed(t, runs)).hexdigest(),
        }

    schema = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
    return _scan(df, id_col, text_col, least, periods, schema, make)
