"""Queries of pair evaluation: texts, metrics, keys, statistics and reports over documents, labels and orders.

A pair is a document's text and the same text with typical recognition errors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, text
from ..operators import aggregate, lines, metrics
from .tables import register, table

ERRORS = (("tion", "tiou"), ("rn", "m"), ("qu", "gu"))
SPACE = "[\\x{09}-\\x{0d}\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


def literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def damaged(c: Column) -> Column:
    for a, b in ERRORS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def damaged_sql(x: str) -> str:
    for a, b in ERRORS:
        x = f"replace({x}, {literal(a)}, {literal(b)})"
    return x


def tokens_sql(x: str) -> str:
    return f"[t FOR t IN regexp_split_to_array({x}, '{SPACE}') IF t <> '']"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, reference, candidate, path, directory) of every document with a text."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    path = F.concat_ws("/", F.lit("root"), "source", "lang", F.concat(F.lit("page"), F.col("doc_id").cast("string"), F.lit(".xml")))
    return d.select("doc_id", F.col("text").alias("reference"), damaged(F.col("text")).alias("candidate"), path.alias("path"), "source", "lang")


PAIRS = f"""pairs AS (SELECT doc_id, text AS reference, {damaged_sql("text")} AS candidate, concat_ws('/', 'root', source, lang, 'page' || doc_id || '.xml') AS path, source, lang FROM documents WHERE text IS NOT NULL)"""


@register(f"WITH {PAIRS} SELECT doc_id, reference, candidate, path FROM pairs", name="pairs")
def pairs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("doc_id", "reference", "candidate", "path")


@register("SELECT doc_id, nfc_normalize(replace(text, 'é', 'e' || chr(769))) AS text FROM documents")
def nfc_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.normalise(F.replace("text", F.lit("é"), F.lit("é"))).alias("text"))


@register()
def nfkd_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.normalise(F.col("text"), "NFKD").alias("text"))


@register(f"SELECT doc_id, translate(text, {literal(text.NON_LETTERS)}, '') AS letters FROM documents")
def letters_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.letters(F.col("text")).alias("letters"))


@register(f"SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS joined FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents WHERE text IS NOT NULL)")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.array_join("t", " ").alias("joined"))


def _stop_sql() -> str:
    return "[" + ", ".join(map(literal, metrics.stop_words())) + "]"


def _set_sql(x: str) -> str:
    return f"[w FOR w IN list_distinct({tokens_sql(x)}) IF NOT list_contains({_stop_sql()}, w)]"


@register(lambda: f"SELECT doc_id, len(s) AS n_set, array_to_string(list_sort(s), ' ') AS joined FROM (SELECT doc_id, {_set_sql('text')} AS s FROM documents WHERE text IS NOT NULL)")
def token_set_stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.token_set(F.col("text"), metrics.stop_words()).alias("s"))
    return s.select("doc_id", F.size("s").cast("bigint").alias("n_set"), F.array_join(F.array_sort("s"), " ").alias("joined"))


_MARKED = "replace(replace(text, 'a', 'a' || chr(868)), 'U', 'U' || chr(868))"


@register(f"SELECT doc_id, replace(regexp_replace(regexp_replace(regexp_replace({_MARKED}, '[Aa]' || chr(868), 'ä', 'g'), '[Oo]' || chr(868), 'ö', 'g'), '[Uu]' || chr(868), 'ü', 'g'), chr(868), '') AS text FROM documents")
def umlaut_ligatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.replace(F.replace("text", F.lit("a"), F.lit("aͤ")), F.lit("U"), F.lit("Uͤ"))
    return table(spark, sf_dir, "documents").select("doc_id", text.ligatures(marked).alias("text"))


@register()
def dehyphenate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are made to end in a hyphen where they end in a full stop."""
    cut = F.split(F.regexp_replace("text", r"\.\n", "-\n"), "\n")
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.array_join(text.join_hyphenated(cut), "\n").alias("text"), text.dictionary_text(cut).alias("dictionary_text"))


@register(f"SELECT doc_id, array_to_string([t FOR t IN {tokens_sql(f'translate(text, {literal(text.DICTIONARY_NOISE)}, {literal('')})')} IF length(t) > 1], ' ') AS text FROM documents WHERE text IS NOT NULL")
def sanitize_dict_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.dictionary_line(F.col("text")).alias("text"))


def _one(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    label = metrics.registry()[key].label
    scored = metrics.score(pairs(spark, sf_dir), [key])
    return scored.select("doc_id", F.col(label)["value"].alias("value"), F.col(label)["n_ref"].alias("n_ref"))


#: Levenshtein counts bytes in SQL, so the letters beyond ASCII are mapped to control characters, one to one.
_BEYOND = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöüáúàâîôûëïùÁ"
_CONTROL = "".join(chr(i) for i in [*range(1, 9), *range(11, 32)] if i != 13)
_ONE_BYTE = lambda x: f"translate({x}, {literal(_BEYOND[: len(_CONTROL)])}, {literal(_CONTROL[: len(_BEYOND)])})"


def _edit_sql(prepare: str) -> str:
    return f"""WITH {PAIRS}, p AS (SELECT doc_id, {prepare.format(x="reference")} AS r, {prepare.format(x="candidate")} AS c FROM pairs)
SELECT doc_id, round_even(100 * CASE WHEN greatest(length(r), length(c)) = 0 THEN 1.0 ELSE 1 - levenshtein({_ONE_BYTE("r")}, {_ONE_BYTE("c")}) / greatest(length(r), length(c)) END, 2) AS value, length(r) AS n_ref FROM p"""


@register(_edit_sql("{x}"))
def char_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, sf_dir, "Cs")


@register(_edit_sql(f"translate({{x}}, {literal(text.NON_LETTERS).replace('{', '{{').replace('}', '}}')}, '')"))
def letter_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, sf_dir, "Ls")


@register()
def word_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, sf_dir, "Ws")


@register(f"""WITH {PAIRS}, r AS (SELECT doc_id, unnest({tokens_sql("reference")}) AS t FROM pairs), c AS (SELECT doc_id, unnest({tokens_sql("candidate")}) AS t FROM pairs),
k AS (SELECT doc_id, t, sum(a) AS a, sum(b) AS b FROM (SELECT doc_id, t, 1 AS a, 0 AS b FROM r UNION ALL SELECT doc_id, t, 0, 1 FROM c) GROUP BY doc_id, t),
s AS (SELECT doc_id, sum(abs(a - b)) AS d, sum(a) AS n, sum(a + b) AS total FROM k GROUP BY doc_id)
SELECT p.doc_id, round_even(100 * coalesce(1 - d / total, 1.0), 2) AS value, CAST(coalesce(n, 0) AS BIGINT) AS n_ref FROM pairs p LEFT JOIN s USING (doc_id)""")
def bag_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, sf_dir, "BoWs")


def _ir_sql(value: str, where: str = "") -> str:
    return f"""WITH {PAIRS}, s AS (SELECT doc_id, {_set_sql("reference")} AS r, {_set_sql("candidate")} AS c FROM pairs),
n AS (SELECT doc_id, len(r) AS nr, len(c) AS nc, len(list_intersect(r, c)) AS nb FROM s)
SELECT doc_id, round_even(100 * ({value}), 2) AS value, nr AS n_ref FROM n {where}"""


@register(lambda: _ir_sql("CASE WHEN nc > 0 THEN nb / nc ELSE 0.0 END"))
def ir_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, sf_dir, "Pre")


@register(lambda: _ir_sql("CASE WHEN nr > 0 THEN nb / nr END"))
def ir_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, sf_dir, "Rec")


@register(lambda: _ir_sql("CASE WHEN nr > 0 AND nc > 0 AND nb > 0 THEN 2 * (nb / nc) * (nb / nr) / (nb / nc + nb / nr) ELSE 0.0 END"))
def ir_fmeasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, sf_dir, "FMeasure")


@register(f"""WITH w AS (SELECT doc_id, unnest({tokens_sql("text")}) AS word FROM documents WHERE text IS NOT NULL), b AS (SELECT DISTINCT unnest({tokens_sql("text")}) AS word FROM benchmark WHERE text IS NOT NULL)
SELECT doc_id, count(*) AS n_words, count(CASE WHEN b.word IS NULL THEN 1 END) AS errors FROM w LEFT JOIN b USING (word) GROUP BY doc_id""")
def dict_unknown_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the benchmark serve as the dictionary."""
    split = lambda t: F.explode(text.tokens(F.col(t))).alias("word")
    return metrics.unknown_words(table(spark, sf_dir, "documents").select("doc_id", split("text")), table(spark, sf_dir, "benchmark").select(split("text")))


def bag_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, metric, value, n_ref, source, lang, path, quality): the scores that the key queries group."""
    scored = metrics.score(pairs(spark, sf_dir), ["BoWs", "Pre"])
    flat = metrics.long_form(scored, ["BoWs", "Pre"], ["doc_id", "source", "lang", "path"])
    kind = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return flat.join(kind, "doc_id", "left")


SCORES = lambda: f"""{PAIRS}, r AS (SELECT doc_id, unnest({tokens_sql("reference")}) AS t FROM pairs), c AS (SELECT doc_id, unnest({tokens_sql("candidate")}) AS t FROM pairs),
k AS (SELECT doc_id, t, sum(a) AS a, sum(b) AS b FROM (SELECT doc_id, t, 1 AS a, 0 AS b FROM r UNION ALL SELECT doc_id, t, 0, 1 FROM c) GROUP BY doc_id, t),
s AS (SELECT doc_id, sum(abs(a - b)) AS d, sum(a) AS n, sum(a + b) AS total FROM k GROUP BY doc_id),
t2 AS (SELECT doc_id, {_set_sql("reference")} AS r, {_set_sql("candidate")} AS c FROM pairs),
q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
scores AS (SELECT x.*, p.source, p.lang, p.path, q.quality FROM (
  SELECT p.doc_id, 'BoWs' AS metric, round_even(100 * coalesce(1 - d / total, 1.0), 2) AS value, CAST(coalesce(n, 0) AS BIGINT) AS n_ref FROM pairs p LEFT JOIN s USING (doc_id)
  UNION ALL SELECT doc_id, 'Pre', round_even(100 * CASE WHEN len(c) > 0 THEN len(list_intersect(r, c)) / len(c) ELSE 0.0 END, 2), len(r) FROM t2) x JOIN pairs p USING (doc_id) LEFT JOIN q USING (doc_id))"""  # noqa: E731


@register(lambda: f"WITH {SCORES()} SELECT doc_id, metric, value, n_ref FROM scores")
def scores_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_scores(spark, sf_dir).select("doc_id", "metric", "value", "n_ref")


def rounded(stats: DataFrame) -> DataFrame:
    """Means and deviations to eight places, so that the order of addition doesn't show."""
    return stats.select(*[F.round(c, 8).alias(c) if c.split("_")[0] in ("mean", "std", "median") else F.col(c).cast("bigint").alias(c) if c.startswith("n_") else F.col(c) for c in stats.columns])


STATS = "count(*) AS n_total, round(avg(value), 8) AS mean, round(median(value), 8) AS median, round(stddev_pop(value), 8) AS std, CAST(sum(n_ref) AS BIGINT) AS n_ref"


def _type(c: Column) -> Column:
    return F.when(c == 1, "article").when(c == 0, "announcement")


_TYPE = "CASE quality WHEN 1 THEN 'article' WHEN 0 THEN 'announcement' END"


def _by(scores: DataFrame, keys: Column) -> DataFrame:
    return rounded(aggregate.statistics(scores.select(F.explode(keys).alias("key"), "value", "n_ref")))


@register(lambda: f"WITH {SCORES()}, keyed AS (SELECT unnest([metric || '@' || lang, metric || '@' || source, metric || '@root']) AS key, value, n_ref FROM scores) SELECT key, {STATS} FROM keyed GROUP BY key")
def agg_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = bag_scores(spark, sf_dir)
    return _by(s, aggregate.legacy_keys(F.col("metric"), names.domains(F.col("path"), F.lit("root")), F.lit("root")))


@register(lambda: f"WITH {SCORES()}, keyed AS (SELECT unnest(list_concat([metric || '@' || lang, metric || '@' || source, metric || '@root'], CASE WHEN quality IS NULL THEN [] ELSE [metric || '@root@' || {_TYPE}] END)) AS key, value, n_ref FROM scores) SELECT key, {STATS} FROM keyed GROUP BY key")
def agg_directory_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = bag_scores(spark, sf_dir)
    return _by(s, aggregate.legacy_keys(F.col("metric"), names.domains(F.col("path"), F.lit("root")), F.lit("root"), _type(F.col("quality"))))


def _dimensions() -> list[tuple[str, Column, bool]]:
    return [("directory_1", names.directory_level(names.domains(F.col("path"), F.lit("root")), 1), False), ("type", _type(F.col("quality")), False), ("pattern", names.pattern_group(names.base_name(F.col("path")), r"page(\d)"), False)]


_FLAT = f"[metric || '@directory_1:' || source, metric || '@type:' || {_TYPE}, metric || '@pattern:' || regexp_extract(path, 'page(\\d)[^/]*$', 1)]"
_WHOLE = f"metric || '@directory_1:' || source || '/type:' || {_TYPE} || '/pattern:' || regexp_extract(path, 'page(\\d)[^/]*$', 1)"


@register(lambda: f"WITH {SCORES()}, keyed AS (SELECT unnest({_FLAT}) AS key, value, n_ref FROM scores) SELECT key, {STATS} FROM keyed WHERE key IS NOT NULL GROUP BY key")
def agg_flat_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by(bag_scores(spark, sf_dir), aggregate.dimension_keys(F.col("metric"), _dimensions()))


@register(lambda: f"WITH {SCORES()}, keyed AS (SELECT unnest(list_concat({_FLAT}, [{_WHOLE}])) AS key, value, n_ref FROM scores) SELECT key, {STATS} FROM keyed WHERE key IS NOT NULL GROUP BY key")
def agg_hierarchical_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by(bag_scores(spark, sf_dir), aggregate.dimension_keys(F.col("metric"), _dimensions(), hierarchical=True))


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.concat_ws("@", F.lit("Cs"), "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("key"), (F.col("l_extendedprice") / 1000).alias("value"), F.col("l_quantity").cast("bigint").alias("n_ref"))


_PRICES = "p AS (SELECT concat_ws('@', 'Cs', l_returnflag, l_linestatus, CAST(l_linenumber AS VARCHAR)) AS key, l_extendedprice / 1000 AS value, CAST(l_quantity AS BIGINT) AS n_ref FROM lineitem)"


@register(f"WITH {_PRICES} SELECT key, {STATS} FROM p GROUP BY key")
def stats_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregate.statistics(_prices(spark, sf_dir)))


@register(f"""WITH {_PRICES}, s AS (SELECT key, count(*) AS n, median(value) AS m, stddev_pop(value) AS sd FROM p GROUP BY key),
q AS (SELECT p.key, median(CASE WHEN value < m THEN value END) AS q1, median(CASE WHEN value > m THEN value END) AS q3 FROM p JOIN s USING (key) WHERE n > 1 AND sd >= 1 GROUP BY p.key),
c AS (SELECT p.key, count(*) AS n_cleaned, round(avg(value), 8) AS mean_cleaned, round(median(value), 8) AS median_cleaned, round(stddev_pop(value), 8) AS std_cleaned, CAST(sum(n_ref) AS BIGINT) AS n_ref_cleaned FROM p JOIN q USING (key) WHERE value >= q1 - 1.5 * (q3 - q1) AND value <= q1 + 1.5 * (q3 - q1) GROUP BY p.key),
t AS (SELECT key, {STATS} FROM p GROUP BY key)
SELECT t.*, CASE WHEN q.key IS NOT NULL AND coalesce(n_cleaned, 0) < n_total THEN coalesce(n_cleaned, 0) END AS n_cleaned,
CASE WHEN coalesce(n_cleaned, 0) < n_total THEN mean_cleaned END AS mean_cleaned, CASE WHEN coalesce(n_cleaned, 0) < n_total THEN median_cleaned END AS median_cleaned,
CASE WHEN coalesce(n_cleaned, 0) < n_total THEN std_cleaned END AS std_cleaned, CASE WHEN coalesce(n_cleaned, 0) < n_total THEN n_ref_cleaned END AS n_ref_cleaned
FROM t LEFT JOIN q USING (key) LEFT JOIN c USING (key)""")
def iqr_cleaned_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(aggregate.cleaned_statistics(_prices(spark, sf_dir)))


@register(f"WITH {_PRICES} SELECT key, printf('%s n:%d refs:%d mean:%.2f [median:%.2f std:%.2f]', key, count(*), CAST(sum(n_ref) AS BIGINT), avg(value), median(value), stddev_pop(value)) AS line FROM p GROUP BY key")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.report(aggregate.statistics(_prices(spark, sf_dir)))


@register(lambda: f"WITH {PAIRS.replace('reference', 'reference')}, p AS (SELECT lang, reference AS r, candidate AS c FROM pairs), s AS (SELECT 'Cs@lang:' || lang AS key, CASE WHEN greatest(length(r), length(c)) = 0 THEN 1.0 ELSE 1 - levenshtein({_ONE_BYTE('r')}, {_ONE_BYTE('c')}) / greatest(length(r), length(c)) END AS ratio, length(r) AS n_ref FROM p), v AS (SELECT key, round_even(100 * ratio, 2) AS value, n_ref FROM s) SELECT key, {STATS} FROM v GROUP BY key")
def char_similarity_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: character similarity of all pairs by language."""
    scored = metrics.score(pairs(spark, sf_dir), ["Cs"])
    flat = metrics.long_form(scored, ["Cs"], ["lang"])
    return _by(flat, aggregate.dimension_keys(F.col("metric"), [("lang", F.col("lang"), False)]))


@register("""WITH l AS (SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, string_agg(text, ' ' ORDER BY turn, text) AS text FROM l GROUP BY conv_id""")
def line_transcription(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.transcription(table(spark, sf_dir, "conversations").where("text is not null"), "conv_id", "turn")


@register("SELECT conv_id, turn, text FROM conversations WHERE length(trim(text, ' ')) >= 40")
def lines_min_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.long_enough(table(spark, sf_dir, "conversations"), 40).select("conv_id", "turn", "text")


@register(f"SELECT conv_id, turn, array_to_string(list_reverse({tokens_sql('text')}), ' ') AS text FROM conversations WHERE text IS NOT NULL")
def rtl_word_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", text.line_text(text.tokens(F.col("text")), reorder=True).alias("text"))
