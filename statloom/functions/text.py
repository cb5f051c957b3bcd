"""Tokenisers, matchers and extractors as Column expressions; no Python sees a row.

The four tokenisers differ on purpose. Nulls give null, empty texts the empty array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, spelled out because regex engines disagree on ``\\s``.
SPACE = r"[\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"

# Korean particles that may trail a query word.
PARTICLES = (
    "으로서 이라면 이지만 이라고 에서의 으로부터 로부터 에게서 이라는 이란 라는 란 에서 에게 으로 이나 라면 지만 라고 의 은 는 이 가 을 를 로 와 과 도 만 나"
).split()
#: The lazy head keeps at least two characters and leaves the longest particle to the tail.
PARTICLE_TAIL = "^(.{2,}?)(" + "|".join(sorted(PARTICLES, key=len, reverse=True)) + ")$"
CLAIM_MARKS = r"[.,!?\"'()\[\]{}:;]"
#: White space within a line.
INLINE_SPACE = SPACE.replace(r"\n", "")
# Fixed value: a reference to an article, with the name of its statute where it stands before it.
CITATION = (
    r"(?:(?:[가-힣A-Za-z0-9·ㆍ]+" + INLINE_SPACE + r"){0,2}[가-힣A-Za-z0-9·ㆍ]*(?:법률|법|규칙|조례|시행령|시행규칙)" + INLINE_SPACE + r"*)?"
    r"제\d+(?:-\d+)?조(?:의\d+)?(?:\([^)\n]{1,24}\))?"
)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` worked out once for each row, even if it is used within lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def utrim(text: Column | str) -> Column:
    """Trim of Unicode white space."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def non_empty(text: Column | str) -> Column:
    """Trimmed, null if nothing is left."""
    return F.nullif(utrim(text), F.lit(""))


def _filled(parts: Column) -> Column:
    return F.filter(parts, lambda x: x != "")


def words(text: Column | str) -> Column:
    """Lower-cased words between white space; marks and repeats stay."""
    return _filled(F.split(F.lower(text), f"{SPACE}+"))


def strip_particle(token: Column) -> Column:
    return F.regexp_replace(token, PARTICLE_TAIL, "$1")


def query_terms(text: Column | str) -> Column:
    """``words`` without closing marks and one trailing particle."""
    return F.transform(_filled(F.transform(words(text), lambda x: F.regexp_replace(x, r"[?!.,]+$", ""))), strip_particle)


def letter_runs(text: Column | str) -> Column:
    """Lower-cased runs of letters and digits."""
    return _filled(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))


def claim_terms(text: Column | str) -> Column:
    """Lower-cased words with marks taken as blanks."""
    return _filled(F.split(F.lower(F.regexp_replace(text, CLAIM_MARKS, " ")), f"{SPACE}+"))


def claims(text: Column | str) -> Column:
    """Sentences: parts between full stops, question and exclamation marks and line ends."""
    return _filled(F.transform(F.split(text, r"[.!?\n]+"), utrim))


def citations(text: Column | str) -> Column:
    """Distinct article references in the order of their first appearance."""
    found = F.regexp_extract_all(text, F.lit(CITATION), F.lit(0))
    return F.array_distinct(_filled(F.transform(found, lambda x: utrim(F.regexp_replace(x, r"[*_`]", "")))))


def citation_segments(text: Column | str) -> Column:
    """The whole text as array<struct<text, is_citation>>, cut at its references."""
    between = F.split(text, CITATION)
    found = F.regexp_extract_all(text, F.lit(CITATION), F.lit(0))
    both = F.zip_with(
        between,
        found,
        lambda gap, ref: F.array(F.struct(gap.alias("text"), F.lit(False).alias("is_citation")), F.struct(ref.alias("text"), F.lit(True).alias("is_citation"))),
    )
    return F.filter(F.flatten(both), lambda s: s["text"] != "")


def first_line(text: Column | str) -> Column:
    """The first line that is not blank, trimmed; '' if there is none."""
    lines = _filled(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), utrim))
    return F.coalesce(F.get(lines, 0), F.lit(""))


def statute_prefix(document_id: Column | str) -> Column:
    return F.substring_index(document_id, ":", 1)


def leading_number(text: Column | str) -> Column:
    """The number a value begins with, without leading zeros; the value itself if there is none."""
    digits = F.regexp_extract(text, r"^([+-]?\d+)", 1)
    return F.when(digits == "", utrim(text)).otherwise(digits.cast("decimal(38,0)").cast("string"))


def padded_digits(text: Column | str, width: int) -> Column:
    """The right-most ``width`` digits, padded with zeros."""
    return F.right(F.concat(F.repeat(F.lit("0"), width), F.regexp_replace(text, r"\D", "")), F.lit(width))
