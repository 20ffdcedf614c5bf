"""Secrets in credential contexts, rated by the least number of guesses that finds them.

A value is taken where a text names a credential and assigns it (``password=…``,
``token: "…"``, ``api_key => …``) or where a value carries the prefix of an
access key.  Its guess cost is the minimum over all segmentations of the sum of
log10 guesses of the segments plus a charge per further segment:

* words of up to 32 letters: rank in a frequency list, also reversed, with
  look-alike characters (4 for a, 0 for o, ...) and capitals, each of which
  multiplies the guesses.  The list is every word of the corpus, ranked by its
  occurrences in all documents, before which some well-known passwords come;
* dates: day, month and year with or without separators, and single years;
* repeats: a run of two or more equal units costs its unit times the count;
* keyboard walks: neighbours on the keyboard, and runs up or down the alphabet;
* brute force: the size of the smallest alphabet of the span per character.

Dynamic programming over end positions finds the minimum exactly, over the whole
value: words and dates are bounded, brute-force spans are carried on by their
alphabet, and of the starts of walks and repeats those that others beat for good
are left out, so a long value takes a time about in proportion to its length.

Words are looked up by a join of the values' own letter spans with the counts of
the corpus' words, so no list is cut and none is broadcast.

A value in quotes goes up to its closing quote in the same line, blanks and
signs included; without that, up to the first blank or sign of ``"'<>,;``.

Defined results: rows without doc_id or text take no part, nor in the counts;
empty texts have no value; repeated rows give their values once (and count once
each); words that occur equally often have the same rank; other columns aren't
read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, texts
from .textblocks import buffers, folded, slices, words

#: Names of credentials, then an assignment, then the value.
CONTEXT = r"""(?i)(?:pass(?:word|wd|phrase)?|pwd|secret(?:[_\- ]?key)?|(?:auth|access|bearer|refresh|api)?[_\- ]?token|api[_\- ]?key|access[_\- ]?key|private[_\- ]?key|client[_\- ]?secret|credentials?)["']?[ \t]*(?:=>|:=|==|=|:)[ \t]*(?:"((?:[^"\\\r\n]|\\.){4,})"|'((?:[^'\\\r\n]|\\.){4,})'|["']?([^\s"'<>,;]{4,}))"""
PREFIXED = r"\b((?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abpr]-[0-9A-Za-z-]{10,}|sk_live_[0-9A-Za-z]{16,})\b"
_CONTEXT, _PREFIXED = re.compile(CONTEXT), re.compile(PREFIXED)
#: Literal parts without which neither pattern matches; plain searches that spare most texts the regular expressions.
_HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk_live_")

WORDS = (
    "password 123456 12345678 qwerty letmein admin welcome monkey login master hello dragon sunshine princess football shadow michael jennifer iloveyou trustno1 superman batman "
    "secret access token user root test guest default changeme example sample temp pass love baseball jordan summer winter spring autumn spider tiger silver golden orange purple "
    "computer internet server database system network company office manager service account private public public house world money power happy magic star moon sun blue green red black white "
    "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday "
    "correct horse battery staple open sesame simple strong weak number letter word key code pin foo bar baz qux demo dev prod stage config"
).split()

_KEYBOARD = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_PLACE = {c: (x + 0.5 * y, y) for y, row in enumerate(_KEYBOARD) for x, c in enumerate(row)}
_LEET = str.maketrans("40135$7@!", "aoiessta" + "i")
_DATE = re.compile(r"(?:(\d{1,2})([-/._]?)(\d{1,2})\2((?:19|20)?\d\d)|((?:19|20)\d\d)([-/._]?)(\d{1,2})\6(\d{1,2}))")


def _beside(a: str, b: str) -> bool:
    p, q = _PLACE.get(a), _PLACE.get(b)
    return p is not None and q is not None and abs(p[1] - q[1]) <= 1 and abs(p[0] - q[0]) <= 1 and a != b


WORD, BRUTE = 32, {1: 26, 2: 26, 4: 10, 8: 33, 16: 100}


def _class(c: str) -> int:
    """The part of the alphabet that a character is in: lower, upper, digit, sign, other."""
    return 1 if "a" <= c <= "z" else 2 if "A" <= c <= "Z" else 4 if "0" <= c <= "9" else 16 if ord(c) > 126 else 8


def alphabets(s: str) -> list[tuple[int, str | None, float]]:
    """(classes, characters, log10 of the size) of the alphabets that spans of s may be tried in."""
    present = 0
    for c in set(s):
        present |= _class(c)
    masks = [m for m in range(1, 32) if m & present == m]
    out: list[tuple[int, str | None, float]] = [(m, None, math.log10(max(10, sum(n for bit, n in BRUTE.items() if m & bit)))) for m in masks]
    return out + [(0, "0123456789abcdef", math.log10(16)), (0, "0123456789ABCDEF", math.log10(16))]


def repeats(s: str) -> list[tuple[int, int, int]]:
    """(start, end, period) of the longest stretches in which s repeats with a period that has no shorter one."""
    out: list[tuple[int, int, int]] = []
    n = len(s)
    for p in range(1, n // 2 + 1):
        h, left = 0, 0
        while h + p < n:  # a stretch of p equal pairs holds a multiple of p
            if s[h] != s[h + p]:
                h += p
                continue
            over = next((r for q0, r, q in out if p % q == 0 and q0 <= h and h + p < r), 0)
            if over:
                left = max(left, over - p)
                h += max(p, (over - p - h) // p * p)
                continue
            a, b = h, h + 1
            while a > left and s[a - 1] == s[a - 1 + p]:
                a -= 1
            while b + p < n and s[b] == s[b + p]:
                b += 1
            if b - a >= p:
                out.append((a, b + p, p))
            left = b
            h += max(p, -(-(b - h) // p) * p)
    return out


class _Starts:
    """Starts of segments whose cost is a start's value plus log10 of their length; those that others beat at every later end are left out."""

    def __init__(self, least: int) -> None:
        self.least, self.kept = least, []

    def add(self, value: float, at: int) -> None:
        while self.kept and self.kept[-1][0] >= value:
            self.kept.pop()
        if not self.kept or value - self.kept[-1][0] < math.log10((at - self.kept[-1][1] + self.least) / self.least):
            self.kept.append((value, at))

    def best(self, end: int, unit: int = 1) -> float:
        return min((v + math.log10((end - at) / unit) for v, at in self.kept), default=math.inf)


class GuessCost:
    """log10 of the guesses that a value takes. `words` is ordered from frequent to rare, or maps each word to its rank."""

    def __init__(self, words: list[str] | dict[str, int] | None = None, charge: float = 0.5) -> None:
        if isinstance(words, dict):
            self.rank = dict(words)
        else:
            self.rank = {}
            for w in words if words is not None else WORDS:
                self.rank.setdefault(w.lower(), len(self.rank) + 1)
        self.longest_word = min(WORD, max(map(len, self.rank), default=0))
        self.charge = charge

    def word(self, s: str) -> float | None:
        low = s.lower()
        case = 1 if s == low else 2 if s[1:] == low[1:] or s == low.upper() else 2 ** sum(c.isupper() for c in s)
        best = None
        for form, factor in ((low, 1), (low[::-1], 2), (low.translate(_LEET), 2), (low.translate(_LEET)[::-1], 4)):
            r = self.rank.get(form)
            if r is not None and (best is None or r * factor < best):
                best = r * factor
        return None if best is None else math.log10(best * case)

    def date(self, s: str) -> float | None:
        if len(s) == 4 and s.isdigit() and s[:2] in ("19", "20"):
            return math.log10(200)
        m = _DATE.fullmatch(s) if 4 < len(s) <= 10 else None
        if not m:
            return None
        a, b = (int(m[1]), int(m[3])) if m[1] else (int(m[8]), int(m[7]))
        if not ((1 <= a <= 31 and 1 <= b <= 12) or (1 <= a <= 12 and 1 <= b <= 31)):
            return None
        return math.log10(365 * 200 * (4 if m[2] or m[6] else 1))

    def __call__(self, s: str) -> float:
        return self._least(s, {})

    def _least(self, s: str, inner: dict[str, float]) -> float:
        if s in inner:
            return inner[s]
        n = len(s)
        low = s.lower() if len(s.lower()) == n else s
        kinds = alphabets(s)
        fits = {c: [m & _class(c) != 0 if chars is None else c in chars for m, chars, _ in kinds] for c in set(s)}
        spans = [math.inf] * len(kinds)
        stretches = [(a, b, p, [_Starts(2) for _ in range(p)]) for a, b, p in repeats(s)]
        opening: dict[int, list] = {}
        for r in stretches:
            opening.setdefault(r[0] + 2 * r[2], []).append(r)
        running: list[tuple[int, int, int, list[_Starts]]] = []
        best = [0.0] + [math.inf] * n
        from_here = lambda i: best[i] + (self.charge if i else 0.0)
        step, climb, climb_from = 0, _Starts(3), 0
        walk, walk_from, turns = _Starts(3), 0, [0] * (n + 1)
        per_turn, keys = math.log10(4), math.log10(len(_PLACE))
        for j in range(1, n + 1):
            c = s[j - 1]
            found = math.inf
            start = from_here(j - 1)
            ok = fits[c]
            for k, (_, _, size) in enumerate(kinds):
                spans[k] = min(spans[k], start) + size if ok[k] else math.inf
                found = min(found, spans[k])
            for i in range(max(0, j - self.longest_word), j):
                w = self.word(s[i:j])
                if w is not None:
                    found = min(found, from_here(i) + w)
            for i in range(max(0, j - 10), j - 3):
                d = self.date(s[i:j])
                if d is not None:
                    found = min(found, from_here(i) + d)
            # Runs up or down by one, from climb_from on.
            if j >= 2:
                now = ord(low[j - 1]) - ord(low[j - 2])
                if abs(now) != 1 or not (low[j - 1].isalnum() and low[j - 2].isalnum()):
                    step, climb_from, climb = 0, j - 1, _Starts(3)
                elif now != step:
                    step, climb_from, climb = now, j - 2, _Starts(3)
                if j - 3 >= climb_from and step:
                    climb.add(from_here(j - 3), j - 3)
                    found = min(found, climb.best(j) + math.log10(40))
                # Neighbours on the keyboard, from walk_from on; turns[k]: turns up to character k.
                turns[j - 1] = turns[j - 2] + (j >= 3 and (ord(low[j - 2]) - ord(low[j - 3])) * (ord(low[j - 1]) - ord(low[j - 2])) < 0)
                if not _beside(low[j - 2], low[j - 1]):
                    walk_from, walk = j - 1, _Starts(3)
                elif j - 3 >= walk_from:
                    walk.add(from_here(j - 3) - turns[j - 2] * per_turn, j - 3)
                    found = min(found, walk.best(j) + keys + (1 + turns[j - 1]) * per_turn)
            running = [r for r in running if r[1] >= j] + opening.get(j, [])
            for a, _, p, starts in running:
                i = j - 2 * p
                own = starts[(i - a) % p]
                own.add(from_here(i), i)
                found = min(found, own.best(j, p) + self._least(s[i : i + p], inner))
            best[j] = found
        inner[s] = best[n]
        return best[n]


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, context) of the values of a text, in order."""
    low = text.lower()
    if not any(h in low for h in _HINTS):
        return []
    seen: dict[tuple[int, int], str] = {}
    for m in _CONTEXT.finditer(text):
        seen[m.span(m.lastindex)] = "assigned"
    for m in _PREFIXED.finditer(text):
        seen.setdefault(m.span(1), "prefixed")
    return [(a, b, k) for (a, b), k in sorted(seen.items())]


def mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, context, value, times) of every credential value; a repeated row counts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maybe = batch.filter(pc.match_substring_regex(batch.column("text"), "|".join(_HINTS), ignore_case=True))
            rows = [(d, s, e, k, t[s:e]) for d, t in zip(maybe.column("doc_id").to_pylist(), maybe.column("text").to_pylist(), strict=True) for s, e, k in find(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["doc_id", "start", "end", "context", "value"])

    plain = texts(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return plain.mapInArrow(scan, "doc_id bigint, start bigint, end bigint, context string, value string").groupBy("doc_id", "start", "end", "context", "value").agg(F.count("*").alias("times"))


def word_counts(docs: DataFrame, held: int = 16 << 20) -> DataFrame:
    """(word, count): every word of letters, of 3 to WORD letters, and its occurrences in all texts; added up by tasks in pieces of `held` bytes before anything is moved."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        size = 0

        def total() -> Iterator[pa.RecordBatch]:
            if parts:
                t = pa.concat_tables(parts).group_by("word").aggregate([("count", "sum")]).rename_columns(["word", "count"])
                length = pc.utf8_length(t.column("word"))
                yield from t.filter(pc.and_(pc.and_(pc.greater_equal(length, 3), pc.less_equal(length, WORD)), pc.utf8_is_alpha(t.column("word")))).to_batches()

        for batch in batches:
            for part in slices(batch, "text"):
                data, off = buffers(folded(part.column("text")))
                s, e, _ = words(data, off)
                if not len(s):
                    continue
                inside = np.zeros(len(data) + 1, np.int8)
                inside[s] += 1
                inside[e] -= 1
                joined = data[np.cumsum(inside[:-1]) > 0] if not (e[:-1] == s[1:]).any() else np.concatenate([data[a:b] for a, b in zip(s, e, strict=True)])
                found = pa.Array.from_buffers(pa.string(), len(s), [None, pa.py_buffer(np.append(0, np.cumsum(e - s)).astype(np.int32)), pa.py_buffer(joined)]).value_counts()
                parts.append(pa.table({"word": found.field("values"), "count": found.field("counts")}))
                size += part.nbytes
                if size > held:
                    yield from total()
                    parts, size = [], 0
        yield from total()

    return texts(docs).select("text").mapInArrow(count, "word string, count bigint").groupBy("word").agg(F.sum("count").alias("count"))


def forms(value: str) -> set[str]:
    """The spans of letters of a value that a word list may hold: as they are, reversed, and with look-alikes."""
    out: set[str] = set()
    low = value.lower()
    for whole in {low, low.translate(_LEET)}:
        for m in re.finditer(r"[^\W\d_]{3,}", whole):
            run = m[0]
            for i in range(len(run) - 2):
                for j in range(i + 3, min(len(run), i + WORD) + 1):
                    out.update((run[i:j], run[i:j][::-1]))
    return out


def _ranks(values: DataFrame, docs: DataFrame, found: DataFrame) -> DataFrame:
    """(value, words): the words of the corpus that a value's spans are, with their ranks: one more than the words that occur more often.

    What occurs in credential values themselves doesn't count, so a secret isn't a word because it is written somewhere.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for v in batch.column("value").to_pylist():
                f = sorted(forms(v))
                yield pa.RecordBatch.from_arrays([pa.array([v] * len(f), pa.string()), pa.array(f, pa.string())], ["value", "word"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(folded(batch.column("value")))
            s, e, doc = words(data, off)
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([raw[a:b].decode() for a, b in zip(s.tolist(), e.tolist(), strict=True)], pa.string()), batch.column("times").take(pa.array(doc))], ["word", "n"])

    secret = found.select("value", "times").mapInArrow(own, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialise(word_counts(docs).join(secret.hint("merge"), "word", "left").select("word", (F.col("count") - F.coalesce("n", F.lit(0))).alias("count")).where("count > 0"))
    # As many rows as there are different counts, which is less than the root of twice the words.
    above = Window.orderBy(F.col("count").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rank = counts.groupBy("count").agg(F.count("*").alias("n")).select("count", (F.coalesce(F.sum("n").over(above), F.lit(0)) + 1).alias("rank"))
    # The optimizer takes the spans for as small as the values are; both sides grow with the input and are shuffled.
    hits = values.mapInArrow(split, "value string, word string").hint("merge").join(counts, "word").join(rank, "count")
    return hits.groupBy("value").agg(F.collect_list(F.struct("word", "rank")).alias("words"))


def secrets(docs: DataFrame, threshold: float = 8.0, words: list[str] | None = None) -> DataFrame:
    """(doc_id, start, end, context, log10_guesses, strong): every credential value; ``strong`` where the cost reaches the threshold, the others are placeholders and weak passwords.  `words` takes the place of the corpus' own words."""
    found = materialise(mentions(docs))
    values = found.select("value").distinct()
    ranked = values.withColumn("words", F.lit(None).cast("array<struct<word: string, rank: bigint>>")) if words is not None else values.join(_ranks(values, docs, found), "value", "left")
    base = GuessCost(words).rank

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, own in zip(batch.column("value").to_pylist(), batch.column("words").to_pylist(), strict=True):
                known = {w["word"]: int(w["rank"]) for w in own or ()}
                out.append(round(GuessCost({**known, **{w: min(r, known.get(w, r)) for w, r in base.items()}})(value), 6))
            yield pa.RecordBatch.from_arrays([batch.column("value"), pa.array(out, pa.float64())], ["value", "log10_guesses"])

    rated = ranked.mapInArrow(rate, "value string, log10_guesses double")
    return found.join(rated.hint("merge"), "value").select("doc_id", "start", "end", "context", "log10_guesses", (F.col("log10_guesses") >= threshold).alias("strong"))
