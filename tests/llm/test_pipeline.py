"""The pipeline's stages, one by one, against brute force on a small corpus."""

import random
import re
from collections import Counter

import corpus_pipeline
import pytest
from test_operators import DE, EN, prose, shingle_sets

from folioscore.llm.packing import token_counts


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    rows = [(k, prose(k, 60 + k % 50, EN if k % 2 else DE), "en" if k % 2 else "de", f"s{k % 3}") for k in range(120)]
    base = rows[7][1].split()
    rows += [(200, rows[3][1], "en", "s0"), (3, rows[3][1], "en", "s0"), (201, " ".join([*base[:20], "new", *base[21:]]), "en", "s1")]
    rows += [(210, "qzxv kjwq zzxq vvkk qqjz", "en", "s0"), (211, "12 34 ..", "en", "s0"), (212, None, "en", "s0"), (213, "", "en", "s0"), (None, rows[9][1], "en", "s0")]
    item = " ".join(f"bench{''.join(random.Random(j).choices('aeio', k=3))}" for j in range(10))
    rows += [(220, prose(220, 60, EN) + " " + item, "en", "s2"), (221, prose(221, 60, EN) + " " + " ".join(item.split()[:7]), "en", "s2")]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    documents.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    out, docs = [documents], documents
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, str(folder)))
        out.append(docs)
    return str(folder), item, [[tuple(r) for r in d.collect()] for d in out[:-1]], out


def ids(rows):
    return Counter(r[0] for r in rows)


def test_stages_keep_the_columns_and_only_remove_rows(stages):
    _, _, rows, out = stages
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    for before, after, a, b in zip(rows, rows[1:], out, out[1:-1], strict=False):
        assert a.columns == b.columns and not Counter(after) - Counter(before) and len(after) < len(before)


def test_language_id_rejects_junk_only(stages):
    _, _, rows, _ = stages
    assert ids(rows[0]) - ids(rows[1]) == Counter({210: 1, 211: 1, 212: 1, 213: 1})


def test_exact_copies_go(stages):
    _, _, rows, _ = stages
    first = {}
    for d, t, *_ in rows[1]:
        if d is not None:
            first[t] = min(d, first.get(t, d))
    assert ids(rows[2]) == Counter([*first.values(), None])


def test_near_copies_go(stages):
    _, _, rows, _ = stages
    sets = [(d, s) for d, s in shingle_sets(rows[2])]
    gone = {b for a, x in sets for b, y in sets if a < b and len(x & y) >= corpus_pipeline.NEAR * len(x | y)}
    assert gone == {201} and ids(rows[3]) == ids(rows[2]) - Counter(gone)


def test_benchmark_windows_go(stages):
    _, item, rows, _ = stages
    words = item.split()
    windows = [" ".join(words[k : k + 8]) for k in range(len(words) - 7)]
    gone = {d for d, t, *_ in rows[3] if d is not None and any(w in " ".join(re.findall(r"\w+", t.lower())) for w in windows)}
    assert gone == {220} and ids(rows[4]) == ids(rows[3]) - Counter(gone)


def test_packing_holds_every_token_once_and_run_gives_the_same(stages, spark):
    folder, _, rows, out = stages
    parts = [tuple(r) for r in out[-1].collect()]
    tokens = {r["doc_id"]: r["tokens"] for r in token_counts(out[-2]).collect()}
    spans = {}
    for _, _, d, _, a, b in parts:
        spans.setdefault(d, []).append((a, b))
    assert set(spans) == {r[0] for r in rows[4] if r[0] is not None}
    for d, s in spans.items():
        s.sort()
        assert s[0][0] == 0 and s[-1][1] == tokens[d] and all(x[1] == y[0] for x, y in zip(s, s[1:]))
    assert sorted(parts) == sorted(tuple(r) for r in corpus_pipeline.run(spark, folder).collect())
