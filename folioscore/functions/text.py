"""Text normalisation and tokenising as Column builders."""

from __future__ import annotations

import string

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPACES = "    　" + "".join(map(chr, range(0x2000, 0x200B)))
_DASHES_QUOTES = "".join(map(chr, range(0x2012, 0x2020))) + "⸗"
_DIGITS = string.digits + "".join(map(chr, [*range(0x660, 0x66A), *range(0x6F0, 0x6FA)]))
#: Everything that isn't a letter for the letter metric, each character once.
NON_LETTERS = "".join(dict.fromkeys(string.whitespace + string.punctuation + _DASHES_QUOTES + _SPACES + _DIGITS))
#: What dictionary texts leave out.
DICTIONARY_NOISE = string.digits + "“„\"'?!*.;:-=[]()|"
#: White space as Python's split sees it, but for the blank.
WHITE = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
DIRECTION_MARKS = "‎‏‪‫‬"
HYPHENS = ("⸗", "-", "—")


#: Methods of ICU, which Spark brings, for the normal forms.
_FORMS = {"NFC": ("compose", False), "NFKC": ("compose", True), "NFD": ("decompose", False), "NFKD": ("decompose", True)}


def normalise(text: Column, form: str = "NFC") -> Column:
    """Unicode normal form; null stays null.

    It runs in the JVM, so no text goes to Python for it.  Spark takes the call
    for one that isn't deterministic: it has to be a column of its own before it
    is aggregated.
    """
    if form not in _FORMS:
        raise ValueError(f"unknown normal form {form}")
    method, compatible = _FORMS[form]
    return F.when(text.isNotNull(), F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit(method), text, F.lit(compatible)))


def letters(text: Column) -> Column:
    return F.translate(text, NON_LETTERS, "")


def tokens(text: Column) -> Column:
    """Words between white space, in order."""
    return F.array_remove(F.split(F.translate(text, WHITE, " " * len(WHITE)), " "), "")


def token_set(text: Column, stop_words: list[str]) -> Column:
    """Distinct words without stop words; upper and lower case differ."""
    return F.array_except(F.array_distinct(tokens(text)), F.array(*map(F.lit, stop_words)) if stop_words else F.array().cast("array<string>"))


def ligatures(text: Column) -> Column:
    """A vowel with a small e above becomes the umlaut, in lower case; the sign alone goes."""
    for base, umlaut in (("[Aa]", "ä"), ("[Oo]", "ö"), ("[Uu]", "ü")):
        text = F.regexp_replace(text, base + "ͤ", umlaut)
    return F.regexp_replace(text, "ͤ", "")


def ligature_error(text: Column) -> Column:
    """Whether the sign stands on another letter, which the strict form refuses."""
    return text.rlike("[^AaOoUu]ͤ")


def dictionary_line(text: Column) -> Column:
    """A line without digits and signs, and without words of one character."""
    return F.array_join(F.filter(tokens(F.translate(text, DICTIONARY_NOISE, "")), lambda t: F.length(t) > 1), " ")


def _joined(lines: list[str | None] | None) -> list[str] | None:
    if lines is None:
        return None
    out: list[str] = []
    held = None
    for line in lines:
        if held is not None:
            words = line.split() if line is not None else []
            if words and held.endswith(HYPHENS):
                out.append(held[:-1] + words[0])
                held = " ".join(words[1:])
                continue
            out.append(held)
        held = line
    return out if held is None else [*out, held]


@F.arrow_udf(T.ArrayType(T.StringType()))
def join_hyphenated(lines: pa.Array) -> pa.Array:
    """Lines where a word cut by a hyphen at the end took its rest from the next line's first word.

    The next line loses that word before it is looked at itself; an empty next
    line leaves the hyphen.  In Python, as it takes one pass over the lines,
    where a fold in the JVM copies all lines so far for each one.
    """
    kind = pa.list_(pa.string())
    parts = [pa.array([_joined(lines[k].as_py()) for k in range(at, min(at + 256, len(lines)))], kind) for at in range(0, len(lines), 256)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def dictionary_text(lines: Column) -> Column:
    """Lines joined over hyphens, cleaned, without empty ones, as one text: lines end at white space, so all are cleaned as one."""
    return dictionary_line(F.array_join(join_hyphenated(lines), "\n"))


def line_text(words: Column, reorder: bool = False) -> Column:
    """Words joined by a blank; reversed for scripts that run from right to left."""
    return F.array_join(F.reverse(words) if reorder else words, " ")


def strip_marks(word: Column) -> Column:
    """A word without the five directional marks; all of them, where the surveyed tool leaves all but the last kind in by an oversight."""
    return F.translate(F.trim(word), DIRECTION_MARKS, "")
