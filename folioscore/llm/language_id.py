"""Language identification with one bit-sliced Bloom filter over character n-grams.

Every slot of the filter is a bitmask with one bit per language.  Looking up an
n-gram is the AND of its ``k`` slots and returns all languages that contain it
at once.  A document's hits per language are popcounts over its n-grams; a hit
rate h of a language whose slots answer wrongly at rate f stands for a true
rate (h - f) / (1 - f), and the language with the largest corrected rate wins
unless that rate is below ``min_rate``, which rejects the document.

Training takes at most ``sample`` labelled documents per language (those whose
hashed id is smallest, so the choice doesn't depend on the layout), a bound that
is a parameter.  An n-gram belongs to a language if ``support`` of them hold it;
all such n-grams enter the filter, whose size follows their number.  Scoring
covers the whole text of every document.

Defined results: a row without text, and one without any n-gram of letters, is
rejected (language null, rate 0); a row without doc_id is scored like others;
repeated rows are scored each; ties go to the language first in order; an empty
table or one without labels rejects all rows.  Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .textblocks import U, buffers, folded, lower, mix, slices

WIDTH = 4
SCORES = "doc_id bigint, language string, rate double, margin double, grams bigint"

_LETTER = np.full(256, 32, np.uint8)
for _c in [*range(97, 123), *range(128, 256)]:
    _LETTER[_c] = _c
for _c in range(65, 91):
    _LETTER[_c] = _c + 32


def gram_keys(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, document) of every run of WIDTH bytes of a text between two blanks; no run starts inside a character or holds two blanks in a row."""
    count = len(off) - 1
    size = np.diff(off)
    d = np.full(len(data) + 2 * count, 32, np.uint8)
    d[np.arange(len(data)) + np.repeat(2 * np.arange(count) + 1, size)] = _LETTER[data]
    n = len(d) - WIDTH + 1
    if n < 1:
        return np.zeros(0, U), np.zeros(0, np.int64)
    blank = d == 32
    twice = blank.copy()
    twice[:-1] &= blank[1:]
    bad = (d[:n] & 0xC0) == 0x80
    for k in range(WIDTH - 1):
        bad |= twice[k : k + n]
    at = np.flatnonzero(~bad)
    key = np.zeros(len(at), U)
    for k in range(WIDTH):
        key = (key << U(8)) | d[at + k].astype(U)
    return key, np.repeat(np.arange(count), np.diff(np.searchsorted(at, off + 2 * np.arange(count + 1))))


class LanguageFilter:
    """The bit-sliced filter; a few MB, whatever the corpus."""

    def __init__(self, names: list[str], keys: list[np.ndarray], k: int = 3) -> None:
        if len(names) > 64:
            raise ValueError("at most 64 languages")
        # Sixteen slots and more for each n-gram of the largest language.
        bits = max(16, int(16 * max([len(own) for own in keys], default=1)).bit_length())
        self.names, self.bits, self.k = names, bits, k
        self.kind = np.uint8 if len(names) <= 8 else np.uint16 if len(names) <= 16 else np.uint32 if len(names) <= 32 else np.uint64
        self.slots = np.zeros(1 << bits, self.kind)
        for i, own in enumerate(keys):
            for at in self._places(own):
                self.slots[at] |= self.kind(1 << i)
        fill = [float(np.mean((self.slots >> self.kind(i)) & self.kind(1))) for i in range(len(names))]
        self.wrong = np.array([f**k for f in fill])

    def _places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        h = mix(keys)
        for j in range(self.k):
            yield mix(h + U(j)) >> U(64 - self.bits)

    def masks(self, keys: np.ndarray) -> np.ndarray:
        out = None
        for at in self._places(keys):
            got = self.slots[at.astype(np.int64)]
            out = got if out is None else out & got
        return out

    def rates(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(corrected rate per document and language, n-grams per document)."""
        keys, owner = gram_keys(data, off)
        n = np.bincount(owner, minlength=len(off) - 1)
        if not len(keys):
            return np.zeros((len(off) - 1, len(self.names))), n
        masks = self.masks(keys)
        hits = np.empty((len(off) - 1, len(self.names)))
        edge = np.concatenate([[0], np.cumsum(n)])
        for i in range(len(self.names)):
            one = np.concatenate([[0], np.cumsum((masks >> self.kind(i)) & self.kind(1), dtype=np.int64)])
            hits[:, i] = one[edge[1:]] - one[edge[:-1]]
        rate = hits / np.maximum(n, 1)[:, None]
        return np.clip((rate - self.wrong) / (1 - self.wrong), 0, 1), n


def train(docs: DataFrame, sample: int = 400, support: int = 2, label: str = "lang") -> LanguageFilter:
    """The filter of the languages in `label`; the rows that reach the driver are at most `sample` per language."""
    rows = docs.where(F.col("text").isNotNull() & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    order = F.xxhash64("doc_id")
    pick = rows.select("doc_id", F.col(label).alias("l"), F.row_number().over(Window.partitionBy(label).orderBy(order, "doc_id")).alias("r")).where(F.col("r") <= sample)
    ids = [r[0] for r in pick.select("doc_id").distinct().collect()]
    got = rows.where(F.col("doc_id").isin(ids)).select("doc_id", F.col(label).alias("l"), "text").orderBy("l", "doc_id").collect() if ids else []
    names = sorted({r["l"] for r in got})
    keys = []
    for name in names:
        texts = [r["text"] for r in got if r["l"] == name]
        k, owner = gram_keys(*buffers(folded(pa.array(texts, pa.string()))))
        pair = np.unique(np.stack([k, owner.astype(U)]), axis=1) if len(k) else np.zeros((2, 0), U)
        uniq, held = np.unique(pair[0], return_counts=True)
        keys.append(uniq[held >= min(support, len(texts))])
    return LanguageFilter(names, keys)


def identify(docs: DataFrame, model: LanguageFilter, min_rate: float = 0.3) -> DataFrame:
    """(doc_id, language, rate, margin, grams) for every row: the winner, its corrected rate, its lead over the second and the n-grams looked up; language null where rejected."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                rate, n = m.rates(*buffers(lower(part, "text")))
                if m.names:
                    best = rate.argmax(1)
                    top = rate.max(1)
                    second = np.sort(rate, 1)[:, -2] if len(m.names) > 1 else np.zeros(len(rate))
                else:
                    best, top, second = np.zeros(part.num_rows, int), np.zeros(part.num_rows), np.zeros(part.num_rows)
                keep = (n > 0) & (top >= min_rate) & bool(m.names)
                language = pa.array([m.names[b] if k else None for b, k in zip(best, keep, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), language, pa.array(top), pa.array(top - second), pa.array(n.astype(np.int64))], ["doc_id", "language", "rate", "margin", "grams"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(score, SCORES)


def keep_identified(docs: DataFrame, model: LanguageFilter, min_rate: float = 0.3) -> DataFrame:
    """docs, all columns, without the rows whose text is in none of the model's languages; the test is made on the row itself."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            plain = pa.RecordBatch.from_arrays(batch.columns, [f"c{i}" for i in range(batch.num_columns)])
            for part in slices(plain, f"c{at}", 1 << 20):
                rate, n = m.rates(*buffers(lower(part, f"c{at}")))
                ok = (n > 0) & (rate.max(1, initial=0) >= min_rate)
                if ok.any():
                    yield pa.RecordBatch.from_arrays(part.filter(pa.array(ok)).columns, batch.schema.names)

    return docs.mapInArrow(keep, docs.schema)
