"""Vectorised text primitives over Arrow string buffers.

Everything that scans whole texts works here on the concatenated UTF-8 bytes of
many documents at once: word boundaries, word hashes, word n-gram hashes and
packed integer columns.  No function keeps state between calls, so a lost task
is simply run again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_P = U(0x9E3779B97F4A7C15 | 1)
_PINV = U(pow(int(_P), -1, 1 << 64))
_Q = U(0xD6E8FEB86659FD93)

#: Bytes that belong to words: ASCII letters and digits and every non-ASCII byte.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True

#: The same word definition as a regular expression of separators (RE2 and Java):
#: ASCII other than letters and digits, U+0080-U+00BF without the letters in it,
#: general punctuation U+2000-U+206F and CJK punctuation U+3000-U+303F.
SEPARATORS = "[\\x{00}-\\x{2f}\\x{3a}-\\x{40}\\x{5b}-\\x{60}\\x{7b}-\\x{a9}\\x{ab}-\\x{b4}\\x{b6}-\\x{b9}\\x{bb}-\\x{bf}\\x{2000}-\\x{206f}\\x{3000}-\\x{303f}]+"

_powers: dict[str, np.ndarray] = {}


def _power(base: U, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, U)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with well spread bits."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def slices(table: pa.RecordBatch | pa.Table, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Row ranges whose texts hold about `most` bytes; a longer text comes alone."""
    for batch in table.to_batches() if isinstance(table, pa.Table) else [table]:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        end = np.cumsum(size)
        a = 0
        while a < len(size):
            b = max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + most, "right")))
            yield batch.slice(a, b - a)
            a = b


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null counts as an empty text."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type):
        off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    else:
        off = np.frombuffer(arr.buffers()[1], np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and len(off) and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0] if len(off) else np.zeros(1, np.int64)


def word_mask(data: np.ndarray) -> np.ndarray:
    word = _WORD[data]
    lead = np.flatnonzero((data == 0xC2) | (data == 0xE2) | (data == 0xE3))
    lead = lead[lead + 1 < len(data)]
    if len(lead):
        first, second = data[lead], data[lead + 1]
        third = data[np.minimum(lead + 2, len(data) - 1)]
        two = lead[(first == 0xC2) & ~np.isin(second, (0xAA, 0xB5, 0xBA))]
        three = lead[((first == 0xE2) & ((second == 0x80) | ((second == 0x81) & (third <= 0xAF)))) | ((first == 0xE3) & (second == 0x80))]
        word[two] = word[two + 1] = False
        for k in range(3):
            word[np.minimum(three + k, len(data) - 1)] = False
    return word


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every word; words never cross documents."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return none, none, none
    word = word_mask(data)
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(word & (~before | cut[:-1]))
    after = np.empty_like(word)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of every span, from one polynomial prefix sum."""
    if not len(starts):
        return np.zeros(0, U)
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * _power(_P, len(data), "p"), out=total[1:])
    return mix((total[ends] - total[starts]) * _power(_PINV, len(data) + 1, "i")[starts] + (ends - starts).astype(U) * _Q)


def ngrams(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of every n-gram of words inside a document."""
    if len(h) < n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    out = h[: len(h) - n + 1] * U(n)
    for k in range(1, n):
        out = mix(out) + h[k : len(h) - n + 1 + k]
    at = np.flatnonzero(doc[: len(h) - n + 1] == doc[n - 1 :])
    return mix(out[at]), at


def folded(arr: pa.Array) -> pa.Array:
    """Lower case, the one form that all operators compare texts in: letter by letter, so the words stay the same in number and order, and training, patterns and texts agree."""
    return pc.utf8_lower(arr)


def lower(batch: pa.RecordBatch, column: str) -> pa.Array:
    return folded(batch.column(column))


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of all word n-grams; a shorter text with words is one shingle of all its words."""
    data, off = buffers(texts)
    s, e, doc = words(data, off)
    h = span_hashes(data, s, e)
    g, at = ngrams(h, doc, n)
    d = doc[at]
    count = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        first = np.cumsum(count) - count
        extra = np.zeros(len(short), U)
        for k in range(n):
            has = count[short] > k
            extra[has] = mix(extra[has] + h[first[short[has]] + k] + U(k + 1))
        g, d = np.concatenate([g, extra]), np.concatenate([d, short])
        order = np.argsort(d, kind="stable")
        g, d = g[order], d[order]
    return g, d


def pack(a: np.ndarray) -> bytes:
    """An ascending array of uint64 as byte planes of its differences (the shuffle's codec removes the empty planes' bytes)."""
    if not len(a):
        return b""
    d = np.empty(len(a), U)
    d[0] = a[0]
    d[1:] = a[1:] - a[:-1]
    top = max(1, (int(d[1:].max()).bit_length() + 7) // 8) if len(a) > 1 else 1
    body = d.copy()
    body[0] = 0
    planes = body.view(np.uint8).reshape(len(a), 8)[:, :top].T
    return bytes([top]) + int(a[0]).to_bytes(8, "little") + np.ascontiguousarray(planes).tobytes()


def unpack(b: bytes) -> np.ndarray:
    if not b:
        return np.zeros(0, U)
    top = b[0]
    planes = np.frombuffer(b, np.uint8, offset=9).reshape(top, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :top] = planes.T
    out = out.reshape(-1).view(U)
    out[0] = int.from_bytes(b[1:9], "little")
    return np.cumsum(out, dtype=U)


def runs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the runs of equal values in a sorted array."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    return start, np.diff(np.concatenate([start, [len(a)]]))
