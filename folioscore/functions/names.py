"""What file names, paths, dates and metadata values tell, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNSET = "n.a."
IGNORED_DIRECTORIES = ("GT-PAGE",)
_LANGUAGES = r"([a-z]{3}(?:\+[a-z]{3})*)"
#: <urn>-p<page>_<languages>.xml, and <urn>-fp<page>.xml for a fragment.
_PAGE = r"^(urn\+nbn\+de\+\w+\+\d+\+[\d\-]+-p\d+(?:-\d+)?)_" + _LANGUAGES + r"(?:\.gt)?\.xml$"
_FRAGMENT = r"^(urn\+nbn\+de\+\w+\+\d+\+[\d\-]*\d[x\d]*)-fp-?(\d+)(?:_" + _LANGUAGES + r"(?:\.gt)?)?\.xml$"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(name: Column) -> Column:
    """A file name without its last suffix."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def groundtruth_type(name: Column) -> Column:
    """The type between gt and xml, or before gt, that a groundtruth's name tells: article, announcement, or "n.a." for any other or none.

    As ever, the signs before gt and xml may be any.
    """
    after, before = F.regexp_extract(name, r"^.*gt.(\w{3,}).xml$", 1), F.regexp_extract(name, r"^.*\.(\w{3,})\.gt\.xml$", 1)
    raw = F.when(after != "", after).when(before != "", before)
    return F.when(raw.startswith("art"), "article").when(raw.startswith("ann"), "announcement").otherwise(UNSET)


def domains(path: Column, root: Column) -> Column:
    """The directories above a file from the nearest up to and with the first of the root's name, ignored ones left out."""
    up = F.reverse(F.split(path, "/"))
    up = F.slice(up, 2, F.greatest(F.size(up) - 1, F.lit(1)))
    at = F.array_position(up, root)
    up = F.when(at > 0, F.slice(up, F.lit(1), at.cast("int"))).otherwise(up)
    return F.filter(up, lambda d: (d != "") & ~d.isin(*IGNORED_DIRECTORIES))


def directory_level(dirs: Column, level: int | None) -> Column:
    """All directories (None), the nearest (-1) or the n-th below the root (0)."""
    if level is None:
        return dirs
    at = F.lit(1) if level == -1 else F.size(dirs) - level
    return F.when((at >= 1) & (at <= F.size(dirs)), F.element_at(dirs, F.greatest(at, F.lit(1)).cast("int")))


def pattern_group(name: Column, pattern: str, group: int = 1) -> Column:
    return F.when(name.rlike(pattern), F.regexp_extract(name, pattern, group))


def _year(value: Column) -> Column:
    return F.substring(F.trim(value), 1, 4).try_cast("int")


def decade(value: Column) -> Column:
    """1867-05 becomes 1860s; anything but a year is null."""
    return F.concat((F.floor(_year(value) / 10) * 10).cast("string"), F.lit("s"))


def century(value: Column) -> Column:
    """1867 becomes 19th and 1900 becomes 20th."""
    n = (F.floor(_year(value) / 100) + 1).cast("int")
    ten = F.pmod(n, F.lit(10))
    teen = F.pmod(n, F.lit(100)).between(11, 13)
    ending = F.when(teen, "th").when(ten == 1, "st").when(ten == 2, "nd").when(ten == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), ending)


def urn_resource(name: Column) -> Column:
    """(identifier, languages) of a resource's file name; null for names of another form, which are skipped."""
    plain = lambda c: F.translate(c, "+", ":")
    page = F.struct(plain(F.regexp_extract(name, _PAGE, 1)).alias("identifier"), F.split(F.regexp_extract(name, _PAGE, 2), r"\+").alias("languages"))
    whole = F.translate(F.concat(plain(F.regexp_extract(name, _FRAGMENT, 1)), F.lit("/fragment/page="), F.regexp_extract(name, _FRAGMENT, 2)), "x", "X")
    fragment = F.struct(whole.alias("identifier"), F.array().cast("array<string>").alias("languages"))
    return F.when(name.rlike(_PAGE), page).when(name.rlike(_FRAGMENT), fragment)


def page_label(name: Column) -> Column:
    """A stem of digits only is a page number."""
    return F.when(name.rlike(r"^\d+$"), F.concat(F.lit("page"), name.cast("int").cast("string"))).otherwise(name)
