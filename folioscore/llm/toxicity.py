"""Toxicity by compression distance: two zstandard dictionaries, one trained on toxic and one on ordinary text.

Texts are lower-cased and cut into windows of ``window`` words.  A window's
saving is the bytes that it takes with the ordinary dictionary less those that
it takes with the toxic one.  Both dictionaries end in the same ordinary text,
so what both know costs the same: a base of ``base`` bytes, trained on ordinary
windows, and before it a head of ``ordinary_head`` bytes, trained on the
ordinary spans that the toxic head alone would save, so what that happens to
hold of ordinary text cancels out.  They differ in what comes first: the toxic
head of ``head`` bytes, in the ordinary dictionary as many bytes of the base
again.  The toxic head is refined in turns: it is trained again on the spans of
``span`` words that save ``least`` bytes or more, at most a share of them.
Toxic texts are in two halves, and a head trained on one chooses among the
spans of the other, so a span must save by what it shares with other texts and
not by itself; the last turn chooses among both.  Spans are chosen at a level
that also finds short matches.  All of it comes from zstandard's own training.

Savings are calibrated by window on labelled documents held out from the
dictionaries.  A document of n windows, k of which save s bytes or more, is as
unlikely among ordinary ones as k or more hits in n draws at the rate that the
held-out ordinary windows show for s (beta-binomial, so few of them claim
little; beyond their largest saving the rate falls exponentially); its score is -log10 of the least such probability over all s.  So what
is expected of an ordinary text of its length counts for nothing.  It is flagged
from the score that a share of ``false_rate`` of other held-out ordinary
documents reaches.

Of training texts that are nearly the same only the first counts.  Training uses at most ``toxic_sample`` and ``ordinary_sample`` labelled rows
(smallest hashed ids) and ``windows`` windows of each class, documented bounds;
scoring covers whole texts of all rows.  Defined results: rows without doc_id or
text take no part; a document whose labels disagree counts as toxic; a text
without words scores 0; repeated rows give one result, ties are all flagged;
with fewer than three texts of a class nothing is flagged; other columns aren't
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts
from .textblocks import U, buffers, folded, mix, ngrams, slices, span_hashes, words

LEVEL = 9
CHOICE_LEVEL = 12  # spans to train on are chosen at this one


def window_spans(folded_: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, text) of all windows of `window` words; the last of a text may be shorter."""
    data, off = buffers(folded_)
    s, e, doc = words(data, off)
    place = np.arange(len(s)) - np.searchsorted(doc, doc)
    first = np.flatnonzero(place % window == 0)
    last = np.append(first[1:], len(s)) - 1
    return data, s[first], e[last], doc[first]


def unlike(sample: list[tuple[int, str]], share: float = 0.3, sketch: int = 16) -> list[tuple[int, str]]:
    """The (class, text) in order without those of whose word 5-grams a share occurred before: near copies would teach the dictionaries their own text, not their class.  One 5-gram in `sketch`, by hash, stands for all."""
    seen: set[int] = set()
    out = []
    for a in range(0, len(sample), 200):
        part = sample[a : a + 200]
        data, off = buffers(folded(pa.array([t for _, t in part], pa.string())))
        s, e, doc = words(data, off)
        grams, at = ngrams(span_hashes(data, s, e), doc, 5)
        chosen = grams % U(sketch) == 0
        grams, owner = grams[chosen], doc[at][chosen]
        edge = np.searchsorted(owner, np.arange(len(part) + 1))
        for i, x in enumerate(part):
            own = set(grams[edge[i] : edge[i + 1]].tolist())
            if len(own & seen) <= share * len(own):
                out.append(x)
                seen |= own
    return out


def windows_of(sample: list[str], window: int, most: int) -> list[bytes]:
    """The different windows of texts, the `most` of the smallest hashes."""
    out: dict[bytes, None] = {}
    for k in range(0, len(sample), 500):
        data, s, e, _ = window_spans(folded(pa.array(sample[k : k + 500], pa.string())), window)
        raw = data.tobytes()
        out.update(dict.fromkeys(raw[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)))
    kept = list(out)
    order = np.argsort(mix(np.array([number_of(w) for w in kept], U)), kind="stable")[:most] if kept else []
    return [kept[k] for k in order]


def number_of(w: bytes) -> int:
    """A number that depends on the bytes only, not on the process."""
    return int.from_bytes(w[:4] + w[-4:], "little") * 31 + len(w) & ((1 << 64) - 1)


def trained(sample: list[bytes], size: int, segment: int, piece: int = 8) -> bytes:
    """A dictionary of zstandard's training; the samples' own last bytes where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, sample, k=segment, d=piece).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(sample)[-size:]


def compressor(content: bytes, level: int = LEVEL) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)


def pair(head: bytes, rest: bytes) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary: a head, or as many bytes of the rest again, before the rest."""
    again = rest * (len(head) // max(1, len(rest)) + 1)
    return head + rest, again[len(again) - len(head) :] + rest


def saving(spans: list[bytes], toxic: bytes, ordinary: bytes, least: int) -> list[bytes]:
    """The spans that save `least` bytes or more, those that save most first; at least the first 20."""
    t, o = compressor(toxic, CHOICE_LEVEL), compressor(ordinary, CHOICE_LEVEL)
    saved = np.array([len(o.compress(x)) - len(t.compress(x)) for x in spans])
    order = np.argsort(-saved, kind="stable")[: max(20, int((saved >= least).sum()))]
    return [spans[i] for i in order]


def dictionaries(
    toxic: list[str], ordinary: list[str], window: int, windows: int, base: int, head: int, ordinary_head: int, span: int, turns: int, share: float, least: int
) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary from texts of the classes."""
    plain = windows_of(ordinary, window, windows)
    common = trained(plain, base, 200)
    halves = [windows_of(toxic[k::2], span, windows) for k in (0, 1)]
    spans = windows_of(ordinary, span, windows)

    def cancelling(first: bytes) -> bytes:
        return trained(saving(spans, *pair(first, common), 1)[:20_000], ordinary_head, 24, 6)

    # The first heads are larger: what is rare in a class must get in before it can be chosen.
    first = trained(windows_of(toxic[::2], window, windows), 16 * head, 16, 6)
    for turn in range(turns):
        own = halves[(turn + 1) % 2] if turn < turns - 1 else halves[0] + halves[1]
        chosen = saving(own, *pair(first, cancelling(first) + common), least)
        first = trained(chosen[: max(300, int(share * len(own)))], head if turn else 8 * head, 16, 6)
    return pair(first, cancelling(first) + common)


def tail(n: int, k: int, hits: float, misses: float) -> float:
    """The natural logarithm of the probability of k or more hits in n draws, at a rate of which `hits` and `misses` are known (beta-binomial)."""
    if k * (hits + misses) <= n * hits:
        return 0.0

    def beta(a: float, b: float) -> float:
        return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)

    first = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + beta(k + hits, n - k + misses) - beta(hits, misses)
    j = np.arange(k, n)
    steps = np.log((n - j) * (j + hits) / ((j + 1) * (n - j - 1 + misses)))
    return min(0.0, first + math.log1p(float(np.exp(np.cumsum(steps)).sum())))


@dataclass
class CompressionClassifier:
    toxic: bytes
    ordinary: bytes
    window: int
    threshold: float = float("inf")
    calm: np.ndarray = field(default_factory=lambda: np.zeros(0))  # savings of held-out ordinary windows, ascending

    def savings(self, folded_: pa.Array) -> list[np.ndarray]:
        """The bytes that the toxic dictionary saves in every window of every text."""
        self._pair = getattr(self, "_pair", None) or (compressor(self.ordinary), compressor(self.toxic))
        ordinary, toxic = self._pair
        data, s, e, doc = window_spans(folded_, self.window)
        raw = memoryview(data.tobytes())
        saved = np.array([len(ordinary.compress(raw[a:b])) - len(toxic.compress(raw[a:b])) for a, b in zip(s.tolist(), e.tolist(), strict=True)], np.int64)
        edge = np.searchsorted(doc, np.arange(len(folded_) + 1))
        return [saved[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]

    def unlikely(self, saved: np.ndarray) -> float:
        """The score of a text whose windows save `saved` bytes."""
        best = 0.0
        top = float(self.calm[-1]) if len(self.calm) else 0.0
        above = self.calm[self.calm > 0]
        scale = max(1.0, float(above.mean())) if len(above) else 1.0
        for s in np.unique(saved[saved > 0]).tolist():
            below = int(np.searchsorted(self.calm, s))
            # Beyond what was ever seen the rate falls on exponentially.
            hits = len(self.calm) - below + 0.5 * math.exp(-max(0.0, s - top) / scale)
            best = max(best, -tail(len(saved), int((saved >= s).sum()), hits, below + 0.5) / math.log(10))
        return best

    def scores(self, folded_: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(score, windows) of every text."""
        each = self.savings(folded_)
        return np.array([self.unlikely(saved) for saved in each], np.float64), np.array([len(saved) for saved in each], np.int64)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_pair"}


def train(
    docs: DataFrame, labels: DataFrame, toxic_sample: int = 1500, ordinary_sample: int = 6000, windows: int = 60_000, window: int = 12, base: int = 100_000, head: int = 2048, ordinary_head: int = 16_384, span: int = 3, turns: int = 4, share: float = 0.1, least: int = 3, false_rate: float = 0.03
) -> CompressionClassifier:
    """The classifier of labelled documents: the toxic ones and two thirds of the ordinary ones train the dictionaries, of the other third one half calibrates the windows and one the documents."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = {y: [r[0] for r in known.where(F.col("y") == y).orderBy(*order).limit(n).select("doc_id").collect()] for y, n in ((1, toxic_sample), (0, ordinary_sample))}
    wanted = docs.sparkSession.createDataFrame([(d, y) for y in ids for d in ids[y]], "doc_id bigint, y int")
    got = texts(docs).join(F.broadcast(wanted), "doc_id").select("y", "text", *order).distinct().collect()
    got = sorted(got, key=lambda r: (r[2], r[3], r[1]))
    alone = unlike([(r["y"], r["text"]) for r in got])
    part = {y: [t for k, t in alone if k == y] for y in (0, 1)}
    if len(part[1]) < 3 or len(part[0]) < 3:
        return CompressionClassifier(b"", b"", window)
    fit = [t for k, t in enumerate(part[0]) if k % 3 != 2]
    held = [t for k, t in enumerate(part[0]) if k % 3 == 2]
    model = CompressionClassifier(*dictionaries(part[1], fit, window, windows, base, head, ordinary_head, span, turns, share, least), window)
    calm, other = (folded(pa.array(held[k::2] or held, pa.string())) for k in (0, 1))
    model.calm = np.sort(np.concatenate(model.savings(calm)))
    reached = np.sort(model.scores(other)[0])
    # The least score that no more than the allowed share of them reaches; below what so few documents can tell, none does.
    model.threshold = max(float(np.nextafter(reached[len(reached) - 1 - int(false_rate * len(reached))], np.inf)), -math.log10(max(false_rate, 1 / (len(reached) + 1))))
    return model


def toxic_documents(docs: DataFrame, model: CompressionClassifier) -> DataFrame:
    """(doc_id, score, windows) of the documents whose score reaches the model's threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches if m.toxic else ():
            for part in slices(batch, "text", 1 << 20):
                s, n = m.scores(folded(part.column("text")))
                hit = np.flatnonzero(s >= m.threshold)
                if len(hit):
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(hit)), pa.array(s[hit]), pa.array(n[hit])], ["doc_id", "score", "windows"])

    return texts(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(score, "doc_id bigint, score double, windows bigint").distinct()
