"""Documents whose sets of word n-grams have a Jaccard similarity of at least t.

Prefix filtering with adaptive multi-match prefixes.  All n-grams have one
order, from rare to frequent.  Two documents whose sets overlap enough share at
least L n-grams among the first |x| - ceil(t |x|) + L of each, for every L.
Each document chooses its own L from 1 to ``most``: a longer prefix has more
postings to read but asks for more shared n-grams, so fewer candidates come to
verification.  With the postings P(L) of a prefix, at most P(L) / L documents
share L of its n-grams, so the estimated cost is P(L) plus |x| P(L) / L times
``verify_cost``.  A pair must share as many prefix n-grams as the smaller of
its two L; the claim above, for that L, makes this lossless.

Only n-grams that several documents have matter (`exchange` finds them); a
document that shares fewer than ceil(t |x|) with anyone drops out before any
pair is formed.  Documents with equal sets are folded into one, by two 64-bit
sums of the hashes of their n-grams.  Sets meet by *anchor*: n-grams that the
same documents share have the same anchor, so a pair meets at one or two
places, not at each n-gram, with both sets at hand; it is verified there and
counted at the first common anchor only.  An anchor with many sets is cut into
blocks, and pairs of blocks are tasks.

N-grams are told apart by 64-bit hashes.  What other documents hold can't change
the overlap of a pair; it is wrong only where two n-grams of that pair collide,
with a probability of at most |x| |y| 2**-64, whatever the size of the corpus.

Results don't expand copies into pairs: `similar_documents` has one row for
each document that is similar to another, with its class, the documents
connected to it by links, and the number of its links.  Every link counts, also
those between different texts of one class.

Defined results: rows without doc_id or text, and texts without words, are
similar to nothing (nor to each other); a text of fewer than n words is one
n-gram; a repeated row is one document, and so are rows of one doc_id whose
n-grams are the same; rows that share a doc_id but not the n-grams are
documents of their own, each with a row, and may be linked with each other; an
empty table gives no row; other columns aren't read.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .common import buckets, keyed_texts, materialise, without
from .components import components
from .textblocks import U, lower, mix, shingles, unpack

SETS = "doc_id bigint, text_key bigint, size int, key_a bigint, key_b bigint, ell int, low binary, anchors array<bigint>"
BLOCK = 512


def distinct_shingles(part: pa.RecordBatch, n: int) -> list[np.ndarray]:
    g, d = shingles(lower(part, "text"), n)
    edge = np.searchsorted(d, np.arange(part.num_rows + 1))
    return [np.unique(g[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def least_overlap(size: int, t: Fraction) -> int:
    return -(-size * t.numerator // t.denominator)


def choose(size: int, counts: np.ndarray, t: Fraction, most: int, verify_cost: float) -> int:
    """L of a set of `size` n-grams whose shared ones, rare first, are in `counts` documents each."""
    need = least_overlap(size, t)
    alone = size - len(counts)
    read = np.concatenate([[0.0], np.cumsum(counts - 1.0)])
    best, cost = 1, None
    for ell in range(1, min(most, need) + 1):
        postings = read[min(max(size - need + ell - alone, 0), len(counts))]
        c = postings + verify_cost * size * postings / ell
        if cost is None or c < cost:
            best, cost = ell, c
    return best


def shared_sets(docs: DataFrame, n: int, t: Fraction, most: int, verify_cost: float) -> DataFrame:
    """SETS of the documents that may have a partner: `low` holds the shared n-grams in order, its first part being the prefix."""

    def meta(parts: list[pa.RecordBatch], held: list[np.ndarray]) -> list[np.ndarray]:
        a = np.array([mix(h).sum(dtype=U) if len(h) else U(0) for h in held], U)
        b = np.array([mix(h ^ U(0x5851F42D4C957F2D)).sum(dtype=U) if len(h) else U(0) for h in held], U)
        own = [np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("doc_id", "text_key")]
        return [*own, np.array([len(h) for h in held], np.int32), a, b]

    sent = exchange.send(keyed_texts(docs), lambda part: distinct_shingles(part, n), buckets(docs, 6 << 20), meta)

    def gather(table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        prints, numbers, classes, anchors, info = [], [], [], [], None
        for part, body in zip(table.column("part").to_pylist(), table.column("body").to_pylist(), strict=True):
            if part == 1:
                info = exchange.split(body)
                continue
            f, d, c, w = exchange.split(body)
            prints.append(unpack(f))
            numbers.append(exchange.unplanes(d, 2))
            classes.append(np.frombuffer(c, np.uint8))
            anchors.append(exchange.unplanes(w, 5))
        if prints and info is not None:
            ids, keys, size, ka, kb = (np.frombuffer(x, kind) for x, kind in zip(info, (np.int64, np.int64, np.int32, np.int64, np.int64), strict=True))
            f, d, c, w = np.concatenate(prints), np.concatenate(numbers), np.concatenate(classes), np.concatenate(anchors)
            order = np.lexsort((f, c, d))
            f, d, c, w = f[order], d[order], c[order], w[order]
            fresh = np.concatenate([[True], (f[1:] != f[:-1]) | (d[1:] != d[:-1])])  # two equal loads have one name
            f, d, c, w = f[fresh], d[fresh], c[fresh], w[fresh]
            edge = np.searchsorted(d, np.arange(len(ids) + 1, dtype=U))
            for i in range(len(ids)):
                a, b = edge[i], edge[i + 1]
                need = least_overlap(int(size[i]), t)
                if size[i] and b - a >= need:
                    ell = choose(int(size[i]), np.exp2(c[a:b] / 8.0), t, most, verify_cost)
                    k = prefix(int(size[i]), int(b - a), t, ell)
                    out.append((int(ids[i]), int(keys[i]), int(size[i]), int(ka[i]), int(kb[i]), ell, f[a:b].tobytes(), np.unique(w[a : a + k]).tolist()))
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), KINDS, strict=True)], NAMES) if out else EMPTY

    return exchange.shared(sent).groupBy("load").applyInArrow(gather, SETS)


KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
NAMES = ["doc_id", "text_key", "size", "key_a", "key_b", "ell", "low", "anchors"]
EMPTY = pa.Table.from_arrays([pa.array([], k) for k in KINDS], NAMES)


def prefix(size: int, shared: int, t: Fraction, ell: int) -> int:
    """How many of the shared n-grams lie in the prefix for `ell`; the unshared ones come first."""
    return min(shared, max(0, size - least_overlap(size, t) + ell - (size - shared)))


def overlaps(sets: list[np.ndarray], others: list[np.ndarray] | None = None) -> np.ndarray:
    """The matrix of overlaps of sets of integers, by products of 0/1 matrices over slices of the elements that two sets have."""
    both = sets if others is None else sets + others
    owner = np.repeat(np.arange(len(both)), [len(s) for s in both])
    value, column, count = np.unique(np.concatenate(both) if both else np.zeros(0, U), return_inverse=True, return_counts=True)
    keep = count[column] > 1
    number = np.cumsum(count > 1) - 1
    column, owner = number[column[keep]], owner[keep]
    m = len(sets)
    out = np.zeros((m, m if others is None else len(others)), np.float32)
    shared = int((count > 1).sum())
    width = min(shared, max(256, (8 << 20) // max(1, 4 * len(both))))
    for a in range(0, shared, max(width, 1)):
        now = (column >= a) & (column < a + width)
        x = np.zeros((len(both), width), np.float32)
        x[owner[now], column[now] - a] = 1
        out += x[:m] @ (x[:m] if others is None else x[m:]).T
    return out


def meet(groups: DataFrame, t: Fraction, counts: bool) -> DataFrame:
    """What (anchor, block, block) groups verify, as rows (a, b, links): links between sets, as many as connect the same sets (a, b), and, with `counts`, how many documents are similar to those of a set (a, links)."""

    def verify(table: pa.Table) -> pa.Table:
        rows = table.select(["side", "node", "size", "ell", "low", "anchors", "weight"]).to_pydict()
        here = table.column("anchor")[0].as_py()
        order = sorted(range(table.num_rows), key=lambda k: (rows["side"][k], rows["node"][k]))
        left = [k for k in order if rows["side"][k] == 0]
        right = [k for k in order if rows["side"][k] == 1]
        low = [np.frombuffer(b, U) for b in rows["low"]]
        size, ell, weight = np.array(rows["size"]), np.array(rows["ell"]), np.array(rows["weight"])
        head = [f[: prefix(int(s), len(f), t, int(e))] for f, s, e in zip(low, size, ell, strict=True)]
        one = not right
        a, b = left, left if one else right
        out: list[tuple] = []
        if a and b and (len(a) > 1 or not one):
            matched = overlaps([head[k] for k in a], None if one else [head[k] for k in b])
            want = np.minimum(ell[a][:, None], ell[b][None, :])
            sa, sb = size[a][:, None], size[b][None, :]
            # Size filter and multi-match filter, then exact verification.
            candidate = (matched >= want) & (np.minimum(sa, sb) * t.denominator >= np.maximum(sa, sb) * t.numerator)
            if one:
                candidate &= np.tri(len(a), k=-1, dtype=bool).T
            at_a, at_b = np.nonzero(candidate)
            if len(at_a):
                if len(at_a) > 4 * (len(a) + len(b)):
                    common = overlaps([low[k] for k in a], None if one else [low[k] for k in b])[at_a, at_b].astype(np.int64)
                else:
                    common = np.array([len(np.intersect1d(low[a[i]], low[b[j]], assume_unique=True)) for i, j in zip(at_a, at_b, strict=True)], np.int64)
                union = size[a][at_a] + size[b][at_b] - common
                good = common * t.denominator >= union * t.numerator
                anchor_sets = [set(x) for x in rows["anchors"]]
                total: dict[int, int] = {}
                parent = list(range(table.num_rows))

                def root(x: int) -> int:
                    while parent[x] != x:
                        parent[x] = parent[parent[x]]
                        x = parent[x]
                    return x

                for i, j in zip(at_a[good].tolist(), at_b[good].tolist(), strict=True):
                    p, q = a[i], b[j]
                    rp, rq = root(p), root(q)
                    if rp != rq:
                        parent[rp] = rq
                        out.append((rows["node"][p], rows["node"][q], None))
                    if counts and (len(anchor_sets[p]) == 1 or len(anchor_sets[q]) == 1 or min(anchor_sets[p] & anchor_sets[q]) == here):
                        total[p] = total.get(p, 0) + int(weight[q])
                        total[q] = total.get(q, 0) + int(weight[p])
                out += [(rows["node"][k], None, v) for k, v in total.items()]
        return pa.Table.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64()))], ["a", "b", "links"])

    return groups.groupBy("anchor", "block_a", "block_b").applyInArrow(verify, "a string, b string, links bigint")


def _prepared(docs: DataFrame, n: int, t: Fraction, most: int, verify_cost: float) -> tuple[DataFrame, DataFrame]:
    """(members, groups): (node, doc_id, text_key) of the documents by their sets, and the sets at each anchor and pair of blocks."""
    node = F.concat(F.lpad(F.hex("key_a"), 16, "0"), F.lpad(F.hex("key_b"), 16, "0"))
    sets = materialise(shared_sets(docs, n, t, most, verify_cost).withColumn("node", node))
    members = sets.select("node", "doc_id", "text_key").distinct()
    weights = members.select("node", "doc_id").distinct().groupBy("node").agg(F.count("*").alias("weight"))
    # Documents with equal sets have equal n-grams in common with others, so any of their rows will do.
    whole = sets.groupBy("node").agg(*[F.first(c).alias(c) for c in ("size", "ell", "low", "anchors")])
    at = whole.select("node", F.explode("anchors").alias("anchor"))
    crowd = at.groupBy("anchor").agg(F.count("*").alias("crowd")).where("crowd > 1")
    placed = at.join(crowd, "anchor").groupBy("node").agg(F.collect_list(F.struct("anchor", "crowd")).alias("places"))
    rows = whole.join(placed, "node").join(weights, "node")
    blocks = F.ceil(F.col("place.crowd") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node", F.lit(7)), blocks).cast("int")
    spread = rows.select("*", F.explode("places").alias("place")).withColumn("blocks", blocks).withColumn("mine", mine)
    pairs = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = pairs.select(
        F.col("place.anchor").alias("anchor"),
        F.least("mine", "other").alias("block_a"),
        F.greatest("mine", "other").alias("block_b"),
        F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"),
        "node", "size", "ell", "low", "anchors", "weight",
    )
    return members, groups


def _classes(members: DataFrame, links: DataFrame) -> DataFrame:
    """members with `class`, the first of the nodes connected to a document's own."""
    roots = components(links.where("b is not null"), "a", "b")
    return members.join(roots, "node", "left").withColumn("class", F.coalesce("root", "node")).drop("root")


def similar_documents(docs: DataFrame, n: int = 5, threshold: float = 0.4, most: int = 4, verify_cost: float = 0.05) -> DataFrame:
    """(doc_id, class_id, links) of every document that is similar to another: the smallest doc_id of its class and the number of documents with a similarity of at least the threshold."""
    t = Fraction(threshold).limit_denominator(10_000)
    members, groups = _prepared(docs, n, t, most, verify_cost)
    links = materialise(meet(groups, t, counts=True))
    classed = _classes(members.select("node", "doc_id").distinct(), links)
    smallest = classed.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    others = links.where("links is not null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n"))
    copies = classed.groupBy("node").agg((F.count("*") - 1).alias("copies"))
    counted = copies.join(others, "node", "left").select("node", (F.col("copies") + F.coalesce("n", F.lit(0))).alias("links")).where("links > 0")
    return classed.join(counted, "node").join(smallest, "class").select("doc_id", "class_id", "links")


def near_copies(docs: DataFrame, n: int = 5, threshold: float = 0.4, most: int = 4, verify_cost: float = 0.05) -> DataFrame:
    """(doc_id, text_key) of every document that has another of its class before it, by doc_id and text_key."""
    t = Fraction(threshold).limit_denominator(10_000)
    members, groups = _prepared(docs, n, t, most, verify_cost)
    classed = _classes(members, materialise(meet(groups, t, counts=False)))
    first = classed.groupBy("class").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    return classed.join(first, "class").where(F.struct("doc_id", "text_key") != F.col("first")).select("doc_id", "text_key")


def keep_one_of_each(docs: DataFrame, **how: float) -> DataFrame:
    """docs with one document, the first by doc_id, of every group of near duplicates; all columns and repeated rows of it stay, as does every row without doc_id or text.  The decision is made for (doc_id, text)."""
    return without(docs, near_copies(docs, **how))
