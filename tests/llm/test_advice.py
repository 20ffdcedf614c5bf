
import random

import corpus_pipeline
from test_operators import docs

from folioscore.llm import secret_scan, toxicity


def prose(seed, n, size=2000):
    r = random.Random(seed)
    return [f"w{r.randrange(size)}" for _ in range(n)]


def test_pipeline_drops_near_copies_with_scattered_edits(spark):
    base = prose(1, 650)
    edited = list(base)
    for k in range(24, 650, 16):
        edited[k] = f"x{k}"
    half = base[:200] + prose(2, 450)
    rows = [(1, " ".join(base), "en", "s"), (2, " ".join(edited), "en", "s"), (3, " ".join(half), "en", "s"), (4, " ".join(prose(3, 650)), "en", "s")]
    kept = corpus_pipeline.drop_near_copies(spark, docs(spark, rows), "")
    assert {r["doc_id"] for r in kept.collect()} == {1, 3, 4}


def test_long_clean_texts_are_not_toxic_by_length(spark):
    bad = [f"vile{k}" for k in range(12)]
    r = random.Random(5)
    text = {}
    for k in range(300):
        t = prose(k, 90, 60)
        if k % 3 == 0:
            t += [r.choice(bad) for _ in range(12)]
        elif k % 20 == 1:
            t.insert(40, r.choice(bad))
        text[k] = " ".join(t)
    clean = " ".join(text[k] for k in range(300) if k % 3)
    rows = [(k, t, "en", "s") for k, t in text.items()] + [(900, " ".join([clean] * 3), "en", "s"), (901, clean + " " + " ".join(text[k] for k in range(0, 60, 3)), "en", "s")]
    df = docs(spark, rows)
    model = toxicity.train(df, spark.createDataFrame([(k, 0, int(k % 3 == 0)) for k in range(200)], "doc_id bigint, quality int, toxic int"))
    got = {x["doc_id"] for x in toxicity.toxic_documents(df, model).collect()}
    held = set(range(201, 300, 3))
    assert 900 not in got and 901 in got
    assert len(got & held) >= 0.9 * len(held)


def test_short_and_inflected_toxic_words_are_told_from_ordinary_text(spark):
    r = random.Random(7)
    parts = [a + b for a in "bdghlmnrstw" for b in ("a", "en", "ou", "ing", "ra", "sh")]

    def word():
        return "".join(r.choice(parts) for _ in range(r.randrange(1, 5)))

    def foreign():
        return "".join(r.choice("vkzxqjfpcy") + r.choice("aeiou") for _ in range(2)) + r.choice("tlmpk")

    short, stems = [foreign() for _ in range(10)], [foreign() for _ in range(4)]
    text = {}
    for k in range(900):
        t = [word() for _ in range(r.randrange(100, 300))]
        if k % 3 == 0:
            for _ in range(3):
                t[r.randrange(len(t))] = r.choice(short) if k % 2 else r.choice(stems) + word()
        text[k] = " ".join(t)
    labels = spark.createDataFrame([(k, 0, int(k % 3 == 0)) for k in range(600)], "doc_id bigint, quality int, toxic int")
    df = docs(spark, [(k, t, "en", "s") for k, t in text.items()])
    got = {x["doc_id"] for x in toxicity.toxic_documents(df, toxicity.train(df, labels)).collect()}
    held, clean = set(range(600, 900, 3)), {k for k in range(600, 900) if k % 3}
    assert len(got & held) >= 0.9 * len(held) and len(got & clean) <= 0.1 * len(clean)


def test_secret_values_go_up_to_the_closing_quote():
    for text, want in (
        ('password="correct horse battery staple" and', "correct horse battery staple"),
        ("token: 'Xk9;q<W,2>z' end", "Xk9;q<W,2>z"),
        ('"api_key"  :        "a b\\"c d"', 'a b\\"c d'),
        ("secret          =          Zq81kd0x, next", "Zq81kd0x"),
        ('pwd = "unclosed value', "unclosed"),
        ("password: 'first\nsecond'", "first"),
    ):
        assert [text[a:b] for a, b, _ in secret_scan.find(text)] == [want]
