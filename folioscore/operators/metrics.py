"""The metrics by their keys: how a pair's texts are prepared and compared, and the reference's size."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity, text

#: Stop words that Spark doesn't bring: a short list of Arabic function words.
ARABIC = "في من على إلى عن أن إن لا ما هذا هذه ذلك التي الذي كان كانت قد لقد هو هي هم نحن أنا أنت كل بعض عند بين حتى ثم أو و".split()
DEFAULT_LANGUAGES = ("german", "english", "arabic", "russian")


def stop_words(languages: tuple[str, ...] = DEFAULT_LANGUAGES) -> list[str]:
    """The words of the languages; needs a running session."""
    out: list[str] = []
    for name in languages:
        out += ARABIC if name == "arabic" else StopWordsRemover.loadDefaultStopWords(name)
    return sorted(set(out))


@dataclass(frozen=True)
class Metric:
    label: str
    prepare: Callable[[Column], Column]
    compare: Callable[[Column, Column], Column]
    size: Callable[[Column, Column], Column]


def registry(languages: tuple[str, ...] = DEFAULT_LANGUAGES) -> dict[str, Metric]:
    words = stop_words(languages)
    chosen = lambda c: text.token_set(c, words)
    metrics = {
        ("Cs", "Characters"): Metric("Cs", lambda c: c, similarity.chars, lambda r, c: F.length(r)),
        ("Ls", "Letters"): Metric("Ls", text.letters, similarity.chars, lambda r, c: F.length(r)),
        ("Ws", "Words"): Metric("Ws", lambda c: c, similarity.words, lambda r, c: similarity.word_distance(r, c)["reference"]),
        ("BoWs", "BagOfWords"): Metric("BoWs", lambda c: c, similarity.bag, lambda r, c: similarity.bag_difference(r, c)["reference"]),
        ("IRPre", "Pre", "Precision"): Metric("Pre", chosen, similarity.precision, lambda r, c: F.size(r)),
        ("IRRec", "Rec"): Metric("Rec", chosen, similarity.recall, lambda r, c: F.size(r)),
        ("IRF", "FMeasure"): Metric("FM", chosen, similarity.fmeasure, lambda r, c: F.size(r)),
    }
    return {k: m for keys, m in metrics.items() for k in keys}


def score(pairs: DataFrame, keys: list[str], languages: tuple[str, ...] = DEFAULT_LANGUAGES, form: str | None = "NFC") -> DataFrame:
    """pairs with a column per metric: struct(value in percent, n_ref, ratio); texts are normalised once for all metrics.

    A null text gives null scores; unknown keys raise KeyError before anything runs.
    """
    known = registry(languages)
    chosen = [known[k] for k in keys]
    for side in ("reference", "candidate"):
        if form is not None:
            pairs = pairs.withColumn(side, text.normalise(F.col(side), form))
    # Prepared once as columns of their own: used several times, they aren't folded into the comparison.
    kept = pairs.columns
    pairs = pairs.select("*", *[m.prepare(F.col(side)).alias(f"__{m.label}_{side}") for m in chosen for side in ("reference", "candidate")])
    ratios = []
    for m in chosen:
        r, c = F.col(f"__{m.label}_reference"), F.col(f"__{m.label}_candidate")
        there = F.col("reference").isNotNull() & F.col("candidate").isNotNull()
        ratios += [F.when(there, m.compare(r, c)).alias(f"__{m.label}_ratio"), m.size(r, c).cast("bigint").alias(f"__{m.label}_size")]
    pairs = pairs.select(*kept, *ratios)
    out = []
    for m in chosen:
        ratio = F.col(f"__{m.label}_ratio")
        out.append(F.struct(similarity.percent(ratio).alias("value"), F.col(f"__{m.label}_size").alias("n_ref"), ratio.alias("ratio")).alias(m.label))
    return pairs.select(*kept, *out)


def long_form(scored: DataFrame, labels: list[str], keep: list[str]) -> DataFrame:
    """One row per pair and metric: (keep..., metric, value, n_ref); rows without a value aren't evaluated."""
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m)["value"].alias("value"), F.col(m)["n_ref"].alias("n_ref")) for m in labels]))
    return scored.select(*keep, rows.alias("s")).select(*keep, "s.metric", "s.value", "s.n_ref").where("value is not null")


def score_dictionary(pairs: DataFrame, dictionary: DataFrame, form: str | None = "NFC") -> DataFrame:
    """pairs (doc_id, candidate) with DictLT, the share of words that a dictionary (word) has, as `score` gives it: the metric of the key DictLT or DictionaryLangTool, whose dictionary is a table."""
    prepared = text.ligatures(text.normalise(F.col("candidate"), form) if form else F.col("candidate"))
    words = pairs.select("doc_id", F.explode(text.tokens(prepared)).alias("word"))
    found = unknown_words(words, dictionary)
    n, errors = F.coalesce("n_words", F.lit(0)), F.coalesce("errors", F.lit(0))
    ratio = F.when(n == 0, 1.0).otherwise(1 - errors / n)
    return pairs.join(found, "doc_id", "left").withColumn("DictLT", F.struct(similarity.percent(ratio).alias("value"), n.alias("n_ref"), ratio.alias("ratio"))).drop("n_words", "errors")


def unknown_words(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(doc_id, n_words, errors) from (doc_id, word) and (word): words that the dictionary lacks, at most as many as there are."""
    missing = words.join(dictionary.select("word").distinct().withColumn("known", F.lit(1)), "word", "left")
    return missing.groupBy("doc_id").agg(F.count("*").alias("n_words"), F.least(F.count_if(F.col("known").isNull()), F.count("*")).alias("errors"))
