"""Similarity of two texts or token sets as Column builders; only edit distances and bags of words leave the JVM, in Arrow batches of which one pair at a time is unpacked."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def banded(where: dict[int, int], m: int, y: list[int], most: int) -> int:
    """The Levenshtein distance of a sequence of m symbols, at the bits of `where`, to y, or more than `most` if it is.

    Bit-parallel over the diagonals at most `most` away from the main one: the
    band moves down with every symbol of y, so a step costs a few operations on
    integers of 2 * most bits, however long the sequences are.
    """
    width = 2 * most + 2
    full, top = (1 << width) - 1, width - 1
    up, down, out = full ^ ((1 << (width - most - 1)) - 1), 0, most
    diagonal, start = 1 << top, most + 1 - width
    turn = m - most
    for j, s in enumerate(y):
        bits = where.get(s, 0)
        here = (bits >> start if start >= 0 else bits << -start) & full
        zero = ((((here & up) + up) ^ up) | here | down) & full
        more = down | (full ^ (zero | up))
        less = zero & up
        if j < turn:
            out += not zero & diagonal
        else:
            edge = top - 1 - (j - turn)
            if edge < 0:
                break
            out += (more >> edge & 1) - (less >> edge & 1)
        shifted = zero >> 1
        up = less | (full ^ (shifted | more))
        down = shifted & more
        start += 1
    return out


#: Steps of the plain way by what they cost (symbols to go on by on both sides, that many symbols agree behind them); where none do, a symbol is taken for another.
_STEPS = [(4 * agree, c, 4 * i, 4 * j) for c in range(1, 5) for agree in (8, 3) for i, j in [(c, c), *[p for k in range(c - 1, -1, -1) for p in ((k, c), (c, k))]]] + [(0, 1, 4, 4)]


def _rows(x: Sequence, y: Sequence) -> int:
    """The distance by rows, for a few symbols."""
    row = list(range(len(y) + 1))
    for i, s in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, t in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (s != t))
    return row[-1]


def likely(x: bytes, y: bytes, most: int) -> int | None:
    """What the steps of a plain way from one sequence to the other cost (symbols of four bytes), which is never less than the distance; None if that is more than `most`.

    Equal stretches are compared as bytes, so this takes a few microseconds for
    each place where the two differ, however long they are.
    """
    m, n, i, j, cost = len(x), len(y), 0, 0, 0
    while cost <= most:
        size = 256
        while i < m and j < n and (stretch := x[i : i + size]) == y[j : j + len(stretch)]:
            i, j, size = i + len(stretch), j + len(stretch), 2 * size
        while size >= 8:
            size //= 2
            if i + size <= m and x[i : i + size] == y[j : j + size]:
                i, j = i + size, j + size
        left, right = m - i, n - j
        if not left or not right:
            return cost + max(left, right) // 4
        if left <= 64 and right <= 64:
            return cost + _rows(memoryview(x[i:]).cast("i"), memoryview(y[j:]).cast("i"))
        for agree, c, di, dj in _STEPS:
            a = x[i + di : i + di + agree]
            if len(a) == agree and a == y[j + dj : j + dj + agree]:
                cost, i, j = cost + c, i + di, j + dj
                break
    return None


def _numbers(a: Sequence, b: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """Two sequences as whole numbers, equal ones for equal symbols."""
    if isinstance(a, str) and isinstance(b, str):
        return tuple(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.int32) for s in (a, b))
    number: dict = {}
    return tuple(np.fromiter((number.setdefault(s, len(number)) for s in seq), np.int32, len(seq)) for seq in (a, b))


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Levenshtein distance of two sequences of hashable symbols, common ends cut off.

    Where a plain way costs as much as the symbols' counts ask for at least, that
    is the distance; else it is found in a band around the diagonal, widened
    until the distance fits.
    """
    if a == b:
        return 0
    x, y = _numbers(a, b)
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    start = int(differ[0]) if len(differ) else n
    x, y = x[start:], y[start:]
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[::-1][:n] != y[::-1][:n])
    end = int(differ[0]) if len(differ) else n
    x, y = x[: len(x) - end], y[: len(y) - end]
    if len(x) < len(y):
        x, y = y, x
    m, n = len(x), len(y)
    if not n:
        return m
    if max(x.max(), y.max()) >= 4096:
        z = np.unique(np.concatenate([x, y]), return_inverse=True)[1].astype(np.int32)
        x, y = z[:m], z[m:]
    size = int(max(x.max(), y.max())) + 1
    of_x, of_y = np.bincount(x, minlength=size), np.bincount(y, minlength=size)
    gap = of_x - of_y
    # Symbols that one side has more of cost at least one step each.
    least = int(max(gap[gap > 0].sum(), -gap[gap < 0].sum()))
    if (m == n and np.count_nonzero(x != y) == least) or likely(x.tobytes(), y.tobytes(), least) == least:
        return least
    both = np.flatnonzero((of_x > 0) & (of_y > 0))
    order = np.argsort(x, kind="stable")
    edge = np.searchsorted(x[order], np.arange(size + 1))
    where = {}
    for s in both.tolist():
        at = np.zeros(m, bool)
        at[order[edge[s] : edge[s + 1]]] = True
        where[s] = int.from_bytes(np.packbits(at, bitorder="little").tobytes(), "little")
    symbols = y.tolist()
    most = min(m, max(8, m - n, least + least // 8 + 2))
    while True:
        found = banded(where, m, symbols, most)
        if found <= most or most >= m:
            return found
        most = min(m, 2 * most)


def _pairs(a: pa.Array, b: pa.Array) -> Iterator[tuple[str | None, str | None]]:
    """The texts of two columns, one pair at a time: a batch's are never held at once."""
    for i in range(len(a)):
        yield a[i].as_py(), b[i].as_py()


@F.arrow_udf(T.IntegerType())
def distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """Levenshtein distance of two texts in characters; null if either is. The JVM's own form is quadratic in long texts even with a bound."""
    return pa.array([None if x is None or y is None else edit_distance(x, y) for x, y in _pairs(a, b)], pa.int32())


#: How two texts differ, and how many words each has.
_COUNTED = T.StructType([T.StructField(k, T.IntegerType()) for k in ("differ", "reference", "candidate")])


def _counted(a: pa.Array, b: pa.Array, differ: Callable[[list[str], list[str]], int]) -> pa.Array:
    out = []
    for x, y in _pairs(a, b):
        p, q = (None if t is None else t.split() for t in (x, y))
        out.append((None if p is None or q is None else differ(p, q), None if p is None else len(p), None if q is None else len(q)))
    return pa.StructArray.from_arrays([pa.array([r[k] for r in out], pa.int32()) for k in range(3)], names=_COUNTED.names)


def _bag_gap(p: list[str], q: list[str]) -> int:
    more = Counter(p)
    more.subtract(q)
    return sum(map(abs, more.values()))


@F.arrow_udf(_COUNTED)
def word_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """Levenshtein distance of two texts in words between white space."""
    return _counted(a, b, edit_distance)


@F.arrow_udf(_COUNTED)
def bag_difference(a: pa.Array, b: pa.Array) -> pa.Array:
    """Size of the difference of the multisets of two texts' words."""
    return _counted(a, b, _bag_gap)


def _ratio(d: Column, longest: Column) -> Column:
    return F.when(longest == 0, 1.0).otherwise(1 - d / longest)


def chars(reference: Column, candidate: Column) -> Column:
    return _ratio(distance(reference, candidate), F.greatest(F.length(reference), F.length(candidate)))


def words(reference: Column, candidate: Column) -> Column:
    """Levenshtein ratio of two texts' words."""
    found = word_distance(reference, candidate)
    return _ratio(found["differ"], F.greatest(found["reference"], found["candidate"]))


def bag(reference: Column, candidate: Column) -> Column:
    """1 - |multiset difference| / |multiset sum| of two texts' words."""
    found = bag_difference(reference, candidate)
    return _ratio(found["differ"], found["reference"] + found["candidate"])


def precision(reference: Column, candidate: Column) -> Column:
    return F.coalesce(F.when(F.size(candidate) > 0, F.size(F.array_intersect(reference, candidate)) / F.size(candidate)), F.lit(0.0))


def recall(reference: Column, candidate: Column) -> Column:
    """Null for an empty reference; such a pair isn't evaluated."""
    return F.when(F.size(reference) > 0, F.size(F.array_intersect(reference, candidate)) / F.size(reference))


def fmeasure(reference: Column, candidate: Column) -> Column:
    """The harmonic mean of precision and recall, 2 |R & C| / (|R| + |C|); 0 where there is nothing in common."""
    both = F.size(F.array_intersect(reference, candidate))
    return F.coalesce(2 * both / F.nullif(F.size(reference) + F.size(candidate), F.lit(0)), F.lit(0.0))


def percent(ratio: Column, places: int = 2) -> Column:
    """The ratio in percent, rounded half to even."""
    return F.bround(100 * ratio, places)
