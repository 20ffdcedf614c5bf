"""Personal identifiers by bootstrapped contextual extraction.

Candidates are all tokens that may be identifiers: e-mail addresses, grouped
numbers, and words with digits.  Seed entities are those that a strict rule
proves: well-formed addresses, numbers with a valid check digit, international
telephone numbers, dotted IPv4 numbers, grouped social security numbers.  Years,
version numbers, short counts, access keys and hexadecimal digests are known not
to be personal and count against a pattern.

A candidate's lexical patterns are the words around it with and without its
shape, and the shape alone.  Pattern and instance scores are computed in turns
over the graph of distinct (pattern, value) pairs: a pattern's confidence is
the score of its known values over that score plus its counter-examples plus
``doubt`` times its unknown values, given at least ``support`` in score; a
value's score is 1 minus the product of (1 - confidence) over its patterns of
at least ``trust``.  Values that reach ``accept`` are known in the next turn, so
good patterns find unseen identifiers, and those further patterns, until a turn
changes no score by a thousandth, or for ``turns`` turns.

Defined results: rows without doc_id or text take no part; empty texts have no
candidates; whole texts are searched, however long; repeated rows give their
mentions once and don't add weight; without seeds nothing is found; an empty
table gives no row; other columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release, texts

#: Addresses and grouped numbers, and runs of word characters and inner signs with a digit; each starts where no earlier one could, so a search passes over every character a bounded number of times.
CANDIDATE = re.compile(
    r"""(?P<mail>(?<![\w.+\-])[\w.+\-]+@[\w\-]+(?:\.[\w\-]+)+)
    |(?<![\w.])(?P<grouped>\d{1,5}(?:\.\d{1,5})+|\+?(?:\(\d{1,5}\)|\d{1,8})(?:[ \-/]?\(\d{1,5}\)|[ \-/]\d{1,8})+)(?![\w(]|[.\-/]\d)
    |(?<![\w\-./])(?P<run>[\w\-./]*\d[\w\-./]*)""",
    re.VERBOSE,
)
_PART = re.compile(r"\w{2,}(?:[\-./]\w+)*")
_WORDS = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"\w+")
MENTIONS = "doc_id bigint, start bigint, end bigint, value bigint, shape string, left1 string, left2 string, right1 string, seed int"


def luhn(digits: str) -> bool:
    total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits)))
    return total % 10 == 0


def iban(s: str) -> bool:
    s = s.replace(" ", "").upper()
    if not re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", s):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def shape(s: str) -> str:
    """Runs of up to three digits are d, longer ones 9{n}; letters a or A; mixed runs X{n}; signs stay."""
    if "@" in s:
        return "w@w" + ".w" * s.rsplit("@", 1)[1].count(".")

    def run(m: re.Match) -> str:
        r = m[0]
        if r.isdigit():
            return "d" if len(r) <= 3 else f"9{{{len(r)}}}"
        if not any(c.isdigit() for c in r):
            return "A" if r.isupper() else "a"
        return f"X{{{len(r)}}}"

    return _RUN.sub(run, s)


def seed(kind: str, s: str, before: str) -> int:
    """1: proved personal, -1: known not to be, 0: unknown."""
    digits = re.sub(r"\D", "", s)
    if kind == "mail":
        return 1 if re.fullmatch(r"[A-Za-z0-9._%+\-]{1,64}@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,24}", s) else 0
    if re.search(r"[=:]\s*[\"']?$", before) and re.fullmatch(r"\w{12,}", s) and not digits == s:
        return -1
    if re.fullmatch(r"(?:[0-9a-f]{16,}|[0-9A-F]{16,})", s) and not s.isdigit():
        return -1
    if re.fullmatch(r"(?:AKIA|ASIA|ghp_|sk_)\w{12,}", s):
        return -1
    if re.fullmatch(r"(?:[vV]\d+|\d{1,3}(?:\.\d{1,3}){1,2}|\d{1,4})", s) or re.fullmatch(r"(?:1[5-9]|20)\d\d", s):
        return -1
    if re.fullmatch(r"\d{1,3}(?:\.\d{1,3}){3}", s):
        return 1 if all(int(x) < 256 for x in s.split(".")) else 0
    if s.startswith("+") and 9 <= len(digits) <= 15:
        return 1
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", s):
        return 1
    if re.fullmatch(r"[\d \-]+", s) and 13 <= len(digits) <= 19 and len(set(digits)) > 2 and luhn(digits):
        return 1
    return 1 if iban(s) else 0


def candidates(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of all tokens that may be identifiers, in order."""
    for m in CANDIDATE.finditer(text):
        if m.lastgroup != "run":
            yield m.lastgroup, *m.span()
            continue
        for p in _PART.finditer(text, m.start(), m.end()):
            if any(c.isdigit() for c in p[0]):
                yield "word", *p.span()


class _Context:
    """The words around candidates that come in order; no part of the text is read more than twice."""

    def __init__(self, text: str) -> None:
        self.text, self.at, self.left, self.right = text, 0, [], None

    def before(self, a: int) -> list[str]:
        """The last two words before a, near ones looked for first."""
        reach = 64
        while True:
            low = max(self.at, a - reach)
            while self.at < low and self.text[low - 1].isalpha() and self.text[low].isalpha():
                low -= 1
            found = _WORDS.findall(self.text, low, a)
            if len(found) >= 2 or low == self.at:
                break
            reach *= 4
        self.left = [*self.left, *found][-2:]
        self.at = a
        return self.left

    def after(self, b: int) -> str | None:
        if self.right is None or (self.right[0] is not None and self.right[0] < b):
            m = _WORDS.search(self.text, b)
            self.right = (m.start(), m[0]) if m else (None, None)
        return self.right[1]


def mentions_of(text: str) -> list[tuple]:
    out = []
    context = _Context(text)
    for kind, a, b in candidates(text):
        s = text[a:b]
        low = [w.lower() for w in context.before(a)]
        right = context.after(b)
        out.append((a, b, shape(s), low[-1] if low else "^", low[-2] if len(low) > 1 else "^", right.lower() if right else "$", seed(kind, s, text[max(0, a - 4) : a]), s))
    return out


def mentions(docs: DataFrame) -> DataFrame:
    """MENTIONS: every candidate with its surroundings; value is a hash of its text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pc.match_substring_regex(batch.column("text"), "[0-9@]"))
            rows = [(d, a, b, s, sh, l1, l2, r1, k) for d, t in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist(), strict=True) for a, b, sh, l1, l2, r1, k, s in mentions_of(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) if k == 8 else pa.array(c) for k, c in enumerate(zip(*rows, strict=True))], ["doc_id", "start", "end", "value", "shape", "left1", "left2", "right1", "seed"])

    found = texts(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(scan, MENTIONS.replace("value bigint", "value string"))
    return found.withColumn("value", F.xxhash64("value")).distinct()


def patterns(found: DataFrame) -> DataFrame:
    """(value, seed, pattern): the distinct lexical patterns of every value."""
    s = F.col("shape")
    each = F.array(
        F.concat(F.lit("S|"), s),
        F.concat_ws("|", F.lit("L1S"), "left1", s),
        F.concat_ws("|", F.lit("L2S"), "left2", "left1", s),
        F.concat_ws("|", F.lit("RS"), s, "right1"),
        F.concat_ws("|", F.lit("L2"), "left2", "left1"),
        F.concat_ws("|", F.lit("LR"), "left1", "right1"),
    )
    return found.select("value", "seed", F.explode(each).alias("pattern")).groupBy("value", "pattern").agg(F.max("seed").alias("seed"))


def bootstrap(found: DataFrame, turns: int = 8, trust: float = 0.7, accept: float = 0.8, doubt: float = 0.02, support: float = 3.0) -> DataFrame:
    """(value, score, pattern): the accepted values with their best pattern; seeds score 1."""
    edges = materialise(patterns(found))
    seeds = found.groupBy("value").agg(F.max("seed").alias("seed"))
    known = seeds.where("seed = 1").select("value", F.lit(1.0).alias("score"))
    last = None
    for _ in range(turns):
        scored = edges.join(known.select("value", "score"), "value", "left")
        right = F.sum(F.when(F.col("seed") >= 0, F.coalesce("score", F.lit(0.0))).otherwise(0.0))
        wrong = F.count_if(F.col("seed") < 0)
        open_ = F.count_if((F.col("seed") == 0) & F.col("score").isNull())
        confident = scored.groupBy("pattern").agg(right.alias("right"), wrong.alias("wrong"), open_.alias("open"))
        confident = confident.withColumn("confidence", F.col("right") / (F.col("right") + F.col("wrong") + doubt * F.col("open"))).where((F.col("right") >= support) & (F.col("confidence") >= trust))
        weight = F.log(1 - F.least(F.col("confidence"), F.lit(0.999)))
        votes = edges.where("seed >= 0").join(confident, "pattern").groupBy("value").agg((1 - F.exp(F.sum(weight))).alias("score"), F.max(F.struct("confidence", "pattern")).alias("best"), F.max("seed").alias("seed"))
        reached = votes.where((F.col("score") >= accept) | (F.col("seed") == 1)).select("value", F.when(F.col("seed") == 1, 1.0).otherwise(F.round("score", 6)).alias("score"), F.col("best.pattern").alias("pattern"))
        kept = reached.select("value", "score").unionByName(seeds.where("seed = 1").select("value", F.lit(1.0).alias("score"))).groupBy("value").agg(F.max("score").alias("score"))
        step = materialise(kept.join(reached.select("value", "pattern"), "value", "left"))
        if last is not None:
            release(known)
        known = step
        mark = known.agg(F.count("*"), F.sum(F.xxhash64("value", F.round("score", 3)).cast("decimal(38,0)"))).first()
        if mark == last:
            break
        last = mark
    return known if turns else known.withColumn("pattern", F.lit(None).cast("string"))


def identifiers(docs: DataFrame, **how: float) -> DataFrame:
    """(doc_id, start, end, shape, seed, score, pattern): every mention of an accepted value, end exclusive."""
    found = materialise(mentions(docs))
    return found.join(bootstrap(found, **how), "value").where("seed >= 0").select("doc_id", "start", "end", "shape", (F.col("seed") == 1).alias("seed"), "score", "pattern")
