from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscore.functions import geometry, names, similarity, text
from folioscore.operators import aggregate, lines, metrics


def brute(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abcä", max_size=70), st.text("abcä", max_size=70))
def test_edit_distance_matches_dynamic_programming(a, b):
    assert similarity.edit_distance(a, b) == brute(a, b)


def test_metrics_of_nulls_empty_and_equal_texts(spark):
    rows = [(1, "the cat sat", "the bat sat"), (2, None, "a"), (3, "", ""), (4, "same", "same"), (5, "", "x")]
    pairs = spark.createDataFrame(rows, "doc_id int, reference string, candidate string")
    got = {r["doc_id"]: r for r in metrics.score(pairs, ["Cs", "Ws", "BoWs", "Rec"]).collect()}
    assert got[1]["Cs"]["value"] == 90.91 and got[1]["Ws"]["value"] == 66.67 and got[1]["BoWs"]["value"] == 66.67
    assert got[2]["Cs"]["value"] is None
    assert got[3]["Cs"]["value"] == 100.0 and got[3]["Rec"]["value"] is None
    assert got[4]["Ws"]["n_ref"] == 1 and got[5]["Cs"]["value"] == 0.0


def test_dimension_keys_name_their_dimension(spark):
    df = spark.createDataFrame([("Cs", "eng", None), ("Cs", "ger", "1867")], "m string, lang string, year string")
    keys = df.select("lang", aggregate.dimension_keys(F.col("m"), [("lang", F.col("lang"), False), ("year", F.col("year"), False)], hierarchical=True).alias("k")).collect()
    got = {r[0]: r[1] for r in keys}
    assert got == {"eng": ["Cs@lang:eng"], "ger": ["Cs@lang:ger", "Cs@year:1867", "Cs@lang:ger/year:1867"]}


def test_cleaned_statistics_use_the_lower_quartile_for_both_fences(spark):
    values = [10.0, 11.0, 12.0, 13.0, 14.0, 15.0, 90.0]
    df = spark.createDataFrame([("a", v, 1) for v in values] + [("b", 5.0, 1)], "key string, value double, n_ref int")
    got = {r["key"]: r for r in aggregate.cleaned_statistics(df).collect()}
    # median 13, quartiles 11 and 15: values from 5 to 17 stay
    assert got["a"]["n_cleaned"] == 6 and got["a"]["mean_cleaned"] == 12.5
    assert got["b"]["n_cleaned"] is None and got["b"]["std"] == 0.0


def test_names_and_dates(spark):
    df = spark.createDataFrame([("x/root/a/b/p1.art.gt.xml", "1867-05"), ("p.gt.xml", "bad"), ("q.gt.foo.xml", "1911")], "path string, d string")
    c = F.col
    got = df.select(names.groundtruth_type(c("path")), names.domains(c("path"), F.lit("root")), names.decade(c("d")), names.century(c("d"))).collect()
    assert [r[0] for r in got] == ["article", "n.a.", "n.a."]
    assert got[0][1] == ["b", "a", "root"]
    assert [r[2] for r in got] == ["1860s", None, "1910s"] and [r[3] for r in got] == ["19th", None, "20th"]


def test_hyphens_join_over_lines(spark):
    got = spark.createDataFrame([(["foo-", "bar baz", "end"],), ([],)], "l array<string>").select(text.join_hyphenated(F.col("l"))).collect()
    assert got[0][0] == ["foobar", "baz", "end"] and got[1][0] == []


def test_geometry(spark):
    assert geometry.strictly_in_hull(__import__("numpy").array([(0, 0), (4, 0), (4, 4), (0, 4)]), 2, 2)
    assert not geometry.strictly_in_hull(__import__("numpy").array([(0, 0), (4, 0), (4, 4), (0, 4)]), 4, 2)
    df = spark.createDataFrame([("1,2 3,4",), ("a b",)], "p string").select(geometry.parse_points(F.col("p")).alias("p"))
    got = [r[0] for r in df.collect()]
    assert [(q["x"], q["y"]) for q in got[0]] == [(1, 2), (3, 2), (3, 4), (1, 4)] and got[1] is None


def test_strings_without_space_between_are_one_word(spark):
    rows = [("l", 0, False, "a", "(Sand"), ("l", 1, True, None, ""), ("l", 2, False, "b", "Gate"), ("l", 3, False, "c", "),"), ("m", 0, False, "d", "x"), ("m", 1, False, "e", "y"), ("m", 2, False, "f", " ")]
    got = lines.merge_strings(spark.createDataFrame(rows, "line_id string, pos int, is_space boolean, id string, text string")).collect()
    assert sorted((r["line_id"], r["id"], r["text"]) for r in got) == [("l", "a", "(Sand"), ("l", "b", "Gate),"), ("m", "d", "x"), ("m", "e", "y")]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "rn", "tion ", "q", "long word ", "x" * 20]), max_size=14), st.data())
def test_edit_distance_of_damaged_texts_and_words_matches_dynamic_programming(parts, data):
    other = [p if data.draw(st.integers(0, 3)) else data.draw(st.sampled_from(["", "m", "tiou ", "g", "yy"])) for p in parts]
    a, b = "".join(parts), "".join(other)
    assert similarity.edit_distance(a, b) == brute(a, b)
    assert similarity.edit_distance(a.split(), b.split()) == brute(a.split(), b.split())


def test_long_texts_with_few_errors_need_no_band(monkeypatch):
    def never(*_):
        raise AssertionError("banded")

    monkeypatch.setattr(similarity, "banded", never)
    reference = "".join(f"the question of return number {k} in the nation of turnips, \u0142\U0001f600 " for k in range(2000))
    candidate = reference.replace("tion", "tiou").replace("rn", "m").replace("qu", "gu")
    assert similarity.edit_distance(reference, candidate) == reference.count("tion") + 2 * reference.count("rn") + reference.count("qu")
    assert similarity.edit_distance(reference.split(), candidate.split()) == sum(x != y for x, y in zip(reference.split(), candidate.split(), strict=True))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_normal_forms_are_as_python_has_them_and_stay_in_the_jvm(spark):
    import unicodedata

    texts = ["e\u0301 \u00e9 \ufb01 \u212b q\u0323\u0307 \u1100\u1161\u11a8 \uac01 \u0344 \U0001d15e \u2126", "", "plain", None, "".join(map(chr, [*range(0x20, 0xD800), *range(0xE000, 0x11000)]))]
    # characters that Python's tables don't have yet are left out
    texts[-1] = "".join(c for c in texts[-1] if unicodedata.category(c) != "Cn")
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    for form in ("NFC", "NFD", "NFKC", "NFKD"):
        out = df.select("k", text.normalise(F.col("t"), form).alias("t"))
        assert {r["k"]: r["t"] for r in out.collect()} == {k: None if t is None else unicodedata.normalize(form, t) for k, t in enumerate(texts)}
        assert "Python" not in _plan(out)


def test_words_are_as_python_splits_them(spark):
    t = "".join(f"a{chr(c)}" for c in range(1, 0x3100) if chr(c).isspace() or c in (0x200B, 0x180E, 0xFEFF)) + "  b "
    got = spark.createDataFrame([(t,), ("",), (" \n",)], "t string").select(text.tokens(F.col("t"))).collect()
    assert [r[0] for r in got] == [t.split(), [], []]


def test_scores_send_texts_to_python_once_and_split_them_only_there(spark):
    pairs = spark.createDataFrame([(1, "a b", "a c")], "doc_id int, reference string, candidate string")
    for key in ("Cs", "Ls", "Ws", "BoWs"):
        plan = _plan(metrics.score(pairs, [key]).select("doc_id", f"{similarity_label(key)}.value", f"{similarity_label(key)}.n_ref"))
        assert plan.count("ArrowEvalPython") == 1 and "split(" not in plan
    for key in ("Pre", "Rec", "FMeasure"):
        assert "Python" not in _plan(metrics.score(pairs, [key]))


def similarity_label(key):
    return metrics.registry()[key].label


def folded(lines):
    """What joining over hyphens means, a line at a time."""
    out, held = [], None
    for line in lines:
        if held is None:
            held = line
        elif held[-1:] in text.HYPHENS and line.split():
            out, held = [*out, held[:-1] + line.split()[0]], " ".join(line.split()[1:])
        else:
            out, held = [*out, held], line
    return out if held is None else [*out, held]


def test_hyphens_join_over_many_lines_in_one_pass(spark):
    cases = [["a-", "b-", "c"], ["a-", "", "b"], ["a-", "b c-", " d e "], ["a- ", "b"], ["x⸗", "\u00a0y", "z—", "w"], [], ["-", "-", "-"], None, [f"word{k} cut-" for k in range(20000)]]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, l array<string>")
    out = df.select("k", text.join_hyphenated(F.col("l")).alias("j"), text.dictionary_text(F.col("l")).alias("d"))
    plan = _plan(out)
    assert plan.count("ArrowEvalPython") == 1 and plan.count("join_hyphenated(") == 1 and "aggregate(" not in plan
    got = {r["k"]: r for r in out.collect()}
    for k, c in enumerate(cases):
        assert got[k]["j"] == (None if c is None else folded(c))
    assert got[0]["j"] == ["ab-", "", "c"] and got[0]["d"] == "ab"
    assert got[2]["d"] == "ab cd" and got[7]["d"] is None and got[5]["d"] == ""
