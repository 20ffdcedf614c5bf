"""Stupid-backoff language-model scores from n-gram counts of the whole corpus.

S(w | u v) = c(u v w) / c(u v) where the trigram occurs at least ``min_count``
times, else ``alpha`` * S(w | v), with S(w | v) = c(v w) / c(v) under the same
condition, else ``alpha`` * c(w) / N.  The first word of a text has no context
and no penalty, the second has one word of it.  A document's score is the sum
of log S over its words.

Counting and scoring are one exchange.  Every load of some megabytes sends its
distinct n-grams with its own counts, each order for itself, to the buckets of
their hashes; a bucket is one hash partition of the n-gram count table.  It adds
up and answers every load with the counts of the n-grams that the load asked
for, in the same order.  That is the relational plan (n-grams exploded, counted
by hash partition, joined, summed by document) in packed form: a frequent n-gram
is one entry per load, so there is no hot key.  A load's texts and answers meet
in one task, which looks the exploded n-grams up and adds up each document's
terms.

N-grams are told apart by 64-bit hashes, at any size: of N different n-grams,
one is counted with another at a probability of N / 2**64.  A context that a
collision left without a count makes its n-gram back off; no score is infinite.

Defined results: every row with a text gives a row, also a repeated one; rows
without doc_id or text take no part, nor in the counts; a text without words
has n_words 0 and score 0; an empty table gives no row; other columns aren't
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .common import buckets, keyed_texts, materialise
from .exchange import planes, unplanes
from .textblocks import buffers, folded, mix, ngrams, pack, runs, span_hashes, unpack, words

TERMS = "doc_id bigint, n_words bigint, partial double, by_trigram bigint, by_bigram bigint, by_unigram bigint"


def grams(h: np.ndarray, doc: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the last word) of the n-grams of an order."""
    g, at = ngrams(h, doc, order) if order > 1 else (mix(h), np.arange(len(h)))
    return g, at + order - 1


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of all words."""
    data, off = buffers(folded(texts))
    s, e, doc = words(data, off)
    return span_hashes(data, s, e), doc


def count_table(asked: DataFrame, min_count: int) -> DataFrame:
    """The answers to the loads: the counts of the whole corpus for what each load asked, from 2-grams on 0 below min_count."""

    def reply(table: pa.Table) -> pa.Table:
        out = []
        for order in (1, 2, 3):
            mine = table.filter(pc.equal(table.column("part"), order))
            if not mine.num_rows:
                continue
            got = [exchange.split(b.as_py()) for b in mine.column("body")]
            asked = [unpack(f) for f, _ in got]
            every = np.concatenate(asked)
            held = np.concatenate([unplanes(c, 4) for _, c in got]).astype(np.int64)
            by = np.argsort(every, kind="stable")
            start, length = runs(every[by])
            total = np.empty(len(every), np.int64)
            total[by] = np.repeat(np.add.reduceat(held[by], start), length)
            if order > 1:
                total[total < min_count] = 0
            at = 0
            for bucket, load, f in zip(mine.column("bucket").to_pylist(), mine.column("load").to_pylist(), asked, strict=True):
                out.append((bucket, load, order, exchange.join([planes(total[at : at + len(f)], 6)])))
                at += len(f)
        return pa.Table.from_batches([exchange.batch(out)])

    return asked.groupBy("bucket").applyInArrow(reply, exchange.ROWS)


def terms(doc: np.ndarray, docs: int, one: np.ndarray, two: np.ndarray, three: np.ndarray, alpha: float) -> list[np.ndarray]:
    """Words, log score without the corpus size, and words scored by each order, of every document, from the counts of the n-grams that end at each word."""
    n = len(doc)
    place = np.arange(n) - np.searchsorted(doc, doc) if n else np.zeros(0, np.int64)
    before = lambda a: np.concatenate([[0], a[:-1]]) if n else a
    context, previous = before(two), before(one)
    tri = (place >= 2) & (three > 0) & (context > 0)
    bi = ~tri & (place >= 1) & (two > 0) & (previous > 0)
    uni = ~tri & ~bi
    term = np.zeros(n)
    term[tri] = np.log(three[tri]) - np.log(context[tri])
    term[bi] = np.log(two[bi]) - np.log(previous[bi]) + math.log(alpha) * (place[bi] >= 2)
    term[uni] = np.log(one[uni]) + math.log(alpha) * np.minimum(place[uni], 2)
    return [np.bincount(doc, w, minlength=docs) if n else np.zeros(docs) for w in (None, term, tri, bi, uni)]


def scores(docs: DataFrame, alpha: float = 0.4, min_count: int = 2) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score, by_trigram, by_bigram, by_unigram): the score and how many words each order scored; scores rounded to four places."""
    plain = keyed_texts(docs)
    if any(x in plain._jdf.queryExecution().executedPlan().toString() for x in ("Exchange", "MapIn", "Nondeterministic")):
        plain = materialise(plain)  # the two scans below must see the same partitions
    count = buckets(docs, 6 << 20)
    cut = exchange.edges(count)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for load, parts in exchange.loads(batches):
            each = [hashed(p.column("text")) for p in parts]
            rows_before = np.cumsum([0, *[p.num_rows for p in parts]])
            h, d = np.concatenate([x for x, _ in each]), np.concatenate([x + r for (_, x), r in zip(each, rows_before[:-1], strict=True)])
            for order in (1, 2, 3):
                g = np.sort(grams(h, d, order)[0])
                start, length = runs(g)
                g = g[start]
                at = np.concatenate([[0], np.searchsorted(g, cut), [len(g)]])
                rows = [(k, load, order, exchange.join([pack(g[at[k] : at[k + 1]]), planes(length[at[k] : at[k + 1]], 4)])) for k in range(count) if at[k + 1] > at[k]]
                if rows:
                    yield exchange.batch(rows)

    def score(table: pa.Table) -> pa.Table:
        part = table.column("part").to_pylist()
        own = [b for b, p in zip(table.column("body").to_pylist(), part, strict=True) if p == -1]
        answers = []
        for order in (1, 2, 3):
            rows = table.filter(pc.equal(table.column("part"), order))
            # Loads with equal texts have one name, and each of them got the same answer.
            first = dict(zip(rows.column("bucket").to_pylist(), rows.column("body").to_pylist(), strict=True))
            answers.append(np.concatenate([unplanes(exchange.split(first[k])[0], 6) for k in sorted(first)]).astype(np.int64) if first else np.zeros(0, np.int64))
        out = []
        for body in own:
            docs_ = exchange.open_load(body)
            h, d = hashed(docs_.column("text"))
            found = np.zeros((4, len(h)), np.int64)
            for order, totals in zip((1, 2, 3), answers, strict=True):
                g, last = grams(h, d, order)
                known, inverse = np.unique(g, return_inverse=True)
                if len(known) != len(totals):
                    raise RuntimeError("the documents came in other partitions than when they were counted")
                if len(known):
                    found[order, last] = totals[inverse]
            n, partial, *orders = terms(d, docs_.num_rows, found[1], found[2], found[3], alpha)
            out.append(pa.Table.from_arrays([docs_.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(partial.astype(float)), *[pa.array(x.astype(np.int64)) for x in orders]], ["doc_id", "n_words", "partial", "by_trigram", "by_bigram", "by_unigram"]))
        return pa.concat_tables(out) if out else pa.Table.from_arrays([pa.array([], k) for k in (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())], ["doc_id", "n_words", "partial", "by_trigram", "by_bigram", "by_unigram"])

    answers = count_table(plain.mapInArrow(ask, exchange.ROWS), min_count)
    meeting = exchange.whole_loads(plain).unionByName(answers)
    scored = materialise(meeting.groupBy("load").applyInArrow(score, TERMS))
    corpus = scored.agg(F.sum("n_words")).first()[0] or 1
    total = F.col("partial") - F.col("by_unigram") * math.log(corpus)
    mean = F.when(F.col("n_words") > 0, total / F.col("n_words")).otherwise(0.0)
    return scored.select("doc_id", "n_words", F.round(total, 4).alias("log_score"), F.round(mean, 4).alias("mean_log_score"), "by_trigram", "by_bigram", "by_unigram")
