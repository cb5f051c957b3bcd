"""Texts that were cut on their way, and how often each source cuts.

1. *Lengths.* Each text is measured under several encodings and escapings that a store may have counted in. Grouped by
   source, measure and length, texts heap up at hidden storage limits.
2. *Endings.* What a whole ending is, is counted in all texts: how often lines of a kind (their first token, and how the
   line of that kind before ended) end without a full stop, and how often a word stands before one. Lines inside a text
   were not cut, so they show how lines of their kind end.
3. *Limits.* A heap is a limit if many of its texts stop inside a sentence. A text that stands at one was cut
   there, unless its ending is plainly whole.
4. *Elsewhere* a text was cut mid-transfer if its ending is plainly none; an unclear one counts as whole.

Defined cases
- Null, empty and blank texts are whole. Blanks, invisible characters and ellipses after the stop are not part of it; a
  replacement character there is the rest of a character that was cut.
- Texts that end with a list entry, heading, table row or closing note, or lack only the last full stop, are whole.
- Kinds of lines and words that are hardly seen are judged by their form (see WEIGHT), as in a table of few rows.
- Null sources form a source of their own. Repeated ids are read one by one; the result is distinct.
"""

from __future__ import annotations

import html
import json
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.llm.lookalike import LINE_ENDS, one_form
from statloom.session import written


def _line_ends(text: str, as_long_as: int) -> int:
    """By how much ``text`` grows when every line end takes ``as_long_as`` characters."""
    pairs = text.count("\r\n")
    ends = text.count("\n") + text.count("\r") - pairs
    return ends * as_long_as - (ends + pairs)


MEASURES = {
    "code_points": len,
    "utf16_units": lambda x: len(x.encode("utf-16-le", "replace")) // 2,
    "utf8_bytes": lambda x: len(x.encode("utf-8", "replace")),
    "cp949_bytes": lambda x: len(x.encode("cp949", "replace")),
    "entity_escaped": lambda x: len(html.escape(x)),
    "json_escaped": lambda x: len(json.dumps(x, ensure_ascii=False)) - 2,
    "json_ascii": lambda x: len(json.dumps(x)) - 2,
    "crlf_code_points": lambda x: len(x) + _line_ends(x, 2),
    "lf_code_points": lambda x: len(x) + _line_ends(x, 1),
    "crlf_utf8_bytes": lambda x: len(x.encode("utf-8", "replace")) + _line_ends(x, 2),
}

#: A limit counts in units of up to this many; a text whose next character did not fit stays below it by less.
UNIT = 4
#: How many texts must stand at a limit, by how much more than around it, and the share of them that end in no whole way.
LEAST_AT_LIMIT, NEIGHBOURS, TIMES_MORE, SHARE_AT_LIMIT = 5, 64, 4, 0.25
#: How many lines or words the form of an ending weighs as much as, beside what was counted.
WEIGHT = 16
#: Share of a kind's lines without a full stop from which such an end is whole, and below which it is plainly none.
OPEN_KIND, STOP_KIND = 0.5, 0.2
#: Share of a word's places before a full stop from which a text after it lacks only that stop, off a limit and at one.
FINAL_WORD, FINAL_WORD_AT_LIMIT = 0.5, 0.9
#: First tokens of lines that a worker remembers; it bounds memory, not what is counted.
COUNTED = 100_000

# How lines look that are no sentences, and how Korean sentences end.
_NO_SENTENCE = regex.compile(
    r"""
      .*\s\|\s.*                                                       # table row
    | (?:\d+(?:의\d+)?|[가-하]|[a-z])\.\s.*                             # list entry
    | [-*•·]\s.*
    | 제\s?\d+\s?조(?:의\s?\d+)?\s?\([^()]*\)                          # heading
    | 제\s?\d+\s?(?:편|장|절|관)(?:의\s?\d+)?(?:\s[^.]{1,40})?
    | (?:Article|Chapter|Section|Annex|Schedule|Appendix)\s\S+(?:\s?\([^()]*\))?
    | (?:[\[(<【].*[\])>】])                                            # note in brackets
    | .*(?:<[^<>]*>|\[[^\[\]]*\]|【[^【】]*】)
    | (?:※|☎|붙임|별표|별지|비고|근거|재판장|판사|담당|출처|참고).*
    | (?:법령명|조문|조문\s제목|공포일자|시행일자|사건|사건번호|제목)\s?:.*
    | (?:이상|끝|이하\s여백|以上|End)\.?
    | [^\p{L}\p{N}]+ | \p{Extended_Pictographic}.*                       # marks and pictures only
    """,
    regex.VERBOSE,
)
_NUMBERED = regex.compile(r"\d+\.\s")
_KOREAN_FINAL = regex.compile(r"(?:(?<![가-힣])(?!마다|보다|다|에다)[가-힣]+다|나요|까요|세요|지요|어요|아요|네요|데요|시오|없음|있음|않음|였음|하였음|바람)['\"”’)\]]*$")
_OPEN = regex.compile(r"[\[<(【][^\])>】]*$")
_FULL_STOP = regex.compile(r"[.?!。]['\"”’)\]」』]*$")
_LINES = regex.compile(f"[{LINE_ENDS}\n]+")
_BLANK = regex.compile(r"[\s\p{Cf}\p{Cc}]")
_UNSEEN = regex.compile(r"^[\s\p{Cf}\p{Cc}]+|[\s\p{Cf}\p{Cc}]+$")
_NUMBER_STOP = regex.compile(r"(?:^|[\s.])\d+\.$")
_DIGITS = regex.compile(r"\p{Nd}+")
_LETTERED = regex.compile(r"(?:[가-힣]|\p{Ll})\.$")
# Marks that close a sentence, quotes after them, and brackets.
STOPS, QUOTES = ".?!。", "'\"”’」』"
BRACKETS = {")": "(", "]": "[", ">": "<", "】": "【"}


def where_it_stops(text: str) -> int:
    """Length of ``text`` without the blanks, invisible characters and ellipses at its end."""
    at = len(text)
    while at:
        if _BLANK.match(text[at - 1]) or text[at - 1] == "…":
            at -= 1
        elif text.endswith("..", 0, at):
            at = len(text[:at].rstrip("."))
        else:
            break
    return at


def _last_line(stop: str) -> str:
    return one_form(stop[max(stop.rfind("\n"), stop.rfind("\r")) + 1 :]).strip()


def ending(text: str) -> str:
    """``inside`` a sentence, ``whole``, or ``unclear``, by the form of the ending alone."""
    stop = text[: where_it_stops(text)]
    if not stop:
        return "whole"
    if stop.endswith("�"):
        return "inside"
    last = _last_line(stop)
    # numbered paragraphs of a decision are sentences, numbered lines elsewhere entries
    sentences = "【" in text
    if sentences and (numbered := _NUMBERED.match(last)):
        last = last[numbered.end() :]
    if _NO_SENTENCE.fullmatch(last):
        return "unclear" if _OPEN.search(last) else "whole"
    if _FULL_STOP.search(last):
        return "inside" if _NUMBER_STOP.search(last) else "whole"
    return "whole" if _KOREAN_FINAL.search(last) else "inside"


def _without_notes(line: str) -> str:
    """``line`` without quotes and whole brackets at its end."""
    line = line.rstrip(QUOTES + " ")
    while line and line[-1] in BRACKETS and (start := line.rfind(BRACKETS[line[-1]])) >= 0:
        line = line[:start].rstrip(QUOTES + " ")
    return line


@lru_cache(COUNTED)
def _token_kind(token: str) -> str:
    token = one_form(token)
    if token and "①" <= token[0] <= "⑳":
        return "①"
    token = _DIGITS.sub("0", token)
    if _LETTERED.match(token):
        return "가." if token[0] >= "가" else "a."
    bracket = token.find("(", 1)
    return token[: bracket + 1] if bracket > 0 else token


def line_kind(line: str) -> str:
    """What ``line`` begins with, apart from its numbers; a row of a table, or a line of one token, is a kind of its own."""
    if " | " in line:
        return "|"
    kind = _token_kind(line.split(maxsplit=1)[0][:24])
    return kind if " " in line and " " in _without_notes(line) else kind + "$"


def ends_open(line: str) -> bool:
    """Does ``line`` end without a full stop? That of a number or date is none; a note in brackets may follow it."""
    bare = _without_notes(line)
    return not bare or bare[-1] not in STOPS or bool(_NUMBER_STOP.search(bare))


def lines_of(text: str) -> list[tuple[str, str, bool, str]]:
    """(kind, how the line of that kind before ended, or what stands before the first, open end, line) of each line that is not blank."""
    out, ended, above = [], {}, "^"
    for line in _LINES.split(text):
        if line := _UNSEEN.sub("", line):
            kind, is_open = line_kind(line), ends_open(line)
            out.append((kind, ended.get(kind, f"after {above}"), is_open, line))
            ended[kind] = "open" if is_open else "closed"
            above = "letters" if kind[:1].isalpha() else kind
    return out


def _bare(word: str) -> str:
    """A word as words are counted: the last two syllables of a Korean one, others whole, without their figures."""
    bare = word.lower().rstrip(STOPS + ",;:" + QUOTES)
    return bare[-2:] if bare[-1:] >= "가" else _DIGITS.sub("0", bare)


def final_word(line: str) -> str:
    return _bare((_without_notes(line).split()[-1:] or [""])[0])


# what is said of a text's ending, what was counted, and the lengths
_TOLD = {
    "kind": pa.string(), "before": pa.string(), "word": pa.string(), "is_open": pa.bool_(), "torn": pa.bool_(), "unclosed": pa.bool_(), "no_sentence": pa.float64(), "is_final": pa.float64(),
    "n": pa.int64(), "n_hit": pa.int64(), **dict.fromkeys(MEASURES, pa.int32()),
}
_TOLD_DDL = ", ".join(f"{c} {({pa.string(): 'string', pa.bool_(): 'boolean', pa.float64(): 'double', pa.int64(): 'long', pa.int32(): 'int'})[t]}" for c, t in _TOLD.items())


def _shown(text: str, lines: list[tuple[str, str, bool, str]]) -> tuple:
    """The values of _TOLD that the ending of a text gives."""
    if not lines:
        return "", "", "", False, False, False, 1.0, 1.0
    kind, before, is_open, line = lines[-1]
    form, line = ending(text), one_form(line)
    is_final = bool(_KOREAN_FINAL.search(line))
    return kind, before, final_word(line), is_open, text[: where_it_stops(text)].endswith("\ufffd"), bool(_OPEN.search(line)), float(form != "inside" and not is_final), float(is_final)


def _told(rows: DataFrame) -> DataFrame:
    """``rows`` (key, source, text) read once: sort ``text`` for each text, ``line`` and ``word`` for what a task counted in all of them."""

    def tell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sources, texts = batch.columns
            texts = [x if x and not x.isspace() else None for x in texts.to_pylist()]
            lines = [lines_of(x[: where_it_stops(x)]) if x else None for x in texts]
            n, n_open, tokens = Counter(), Counter(), Counter()
            for x, of in zip(texts, lines, strict=True):
                if x:
                    tokens.update(x.split())
                    for kind, before, is_open, _ in of:
                        n[kind, before] += 1
                        n_open[kind, before] += is_open
            words, final = Counter(), Counter()
            for token, times in tokens.items():
                word = token.rstrip(QUOTES + "".join(BRACKETS))
                if bare := _bare(word):
                    words[bare] += times
                    final[bare] += times * (word[-1] in STOPS)
            none = [None] * len(_TOLD)
            ends = [(*_shown(x, of), None, None, *(f(x) for f in MEASURES.values())) if x else none for x, of in zip(texts, lines, strict=True)]
            counts = [("line", (k, b, *none[2:8], n[k, b], n_open[k, b], *none[10:])) for k, b in n]
            counts += [("word", (None, None, w, *none[3:8], words[w], final[w], *none[10:])) for w in words]
            ends += [c for _, c in counts]
            sorts = pa.array(["text"] * len(texts) + [s for s, _ in counts], pa.string())
            first = [pa.concat_arrays([c, pa.nulls(len(counts), c.type)]) for c in (keys, sources)]
            columns = [pa.array([e[i] for e in ends], t) for i, t in enumerate(_TOLD.values())]
            yield pa.RecordBatch.from_arrays([sorts, *first, *columns], names=["sort", "key", "source", *_TOLD])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(tell, f"sort string, key {kinds['key']}, source {kinds['source']}, {_TOLD_DDL}")


def readings(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """(key, source, ending, final_share and one column for each measure), written to the checkpoint folder: several steps read it.

    ``ending`` is ``whole``, ``final`` (only the full stop may lack), ``inside`` or ``unclear``, judged by how all texts end
    their lines; null for blank texts. ``final_share`` is how often the last word stands before a full stop. The form of an
    ending weighs as much as WEIGHT lines or words, so that it decides where a kind is hardly seen.
    """
    told = written(_told(df.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).cast("string").alias("text"))))
    lines = told.filter("sort = 'line'").groupBy("kind", "before").agg(F.sum("n").alias("n_exact"), F.sum("n_hit").alias("open_exact"))
    kinds = told.filter("sort = 'line'").groupBy("kind").agg(F.sum("n").alias("n_kind"), F.sum("n_hit").alias("open_kind"))
    words = told.filter("sort = 'word'").groupBy("word").agg(F.sum("n").alias("n_word"), F.sum("n_hit").alias("n_final"))
    read = told.filter("sort = 'text'").drop("sort", "n", "n_hit")
    # only open ends are judged by what was counted; a kind or word that half of them share is no more than a key of small tables
    is_open = read.filter("is_open and not torn")
    joined = is_open.join(lines, ["kind", "before"], "left").join(kinds, "kind", "left").join(words, "word", "left")
    weighed = lambda hits, of, prior: (hits + WEIGHT * prior) / (of + WEIGHT)
    # an open last line is among what was counted, but shows nothing about itself
    others = lambda n: F.greatest(F.coalesce(n, F.lit(0)) - 1, F.lit(0))
    share = weighed(others("open_exact"), others("n_exact"), weighed(others("open_kind"), others("n_kind"), F.col("no_sentence")))
    final = weighed(F.coalesce("n_final", F.lit(0)), F.coalesce("n_word", F.lit(0)), F.col("is_final"))
    ending = (
        F.when(share >= OPEN_KIND, F.when(F.col("unclosed"), "unclear").otherwise("whole"))
        .when(final >= FINAL_WORD, "final")
        .when(share >= STOP_KIND, "unclear")
        .otherwise("inside")
    )
    judged = joined.select("key", "source", ending.alias("ending"), final.alias("final_share"), *MEASURES)
    plain = F.when(F.col("torn"), "inside").when(~F.col("is_open"), "whole")
    rest = read.filter("not coalesce(is_open and not torn, false)").select("key", "source", plain.alias("ending"), F.lit(0.0).alias("final_share"), *MEASURES)
    return written(judged.unionAll(rest))


def _at_lengths(read: DataFrame) -> DataFrame:
    lengths = F.array(*(F.struct(F.lit(n).alias("measure"), F.col(n).alias("length")) for n in MEASURES))
    return read.filter("ending is not null").select("key", "source", "ending", "final_share", F.inline(lengths))


def storage_limits(read: DataFrame) -> DataFrame:
    """(source, measure, storage_limit, n_at, n_inside): lengths at which texts of a source heap up and stop inside sentences.

    Counted by length first, so that what meets in a window is one row for each length of a source, not its texts.
    """
    counted = _at_lengths(read).groupBy("source", "measure", "length").agg(F.count("*").alias("n"), F.count_if(F.col("ending") != "whole").alias("n_in"))
    w = Window.partitionBy("source", "measure").orderBy("length")
    total = lambda c, a, b: F.coalesce(F.sum(c).over(w.rangeBetween(a, b)), F.lit(0))
    enough = (F.col("n_at") >= LEAST_AT_LIMIT) & (F.col("n_at") >= TIMES_MORE * F.col("around") * UNIT / NEIGHBOURS)
    return (
        counted.withColumn("n_at", total("n", 1 - UNIT, 0))
        .withColumn("n_inside", total("n_in", 1 - UNIT, 0))
        .withColumn("around", total("n", -NEIGHBOURS // 2, -UNIT) + total("n", UNIT, NEIGHBOURS // 2))
        .filter((F.col("n_in") > 0) & enough & (F.col("n_inside") >= SHARE_AT_LIMIT * F.col("n_at")))
        .select("source", "measure", F.col("length").alias("storage_limit"), "n_at", "n_inside")
    )


def cuts(read: DataFrame) -> DataFrame:
    """(key, source, step) of each text that was cut: ``limit`` where it stands at a storage limit, else ``transfer``."""
    limits = storage_limits(read).select(F.col("source").alias("l_source"), F.col("measure").alias("l_measure"), "storage_limit")
    # a word that may well end a sentence does not excuse a text that stands at a limit
    open_ends = _at_lengths(read).filter(F.col("ending").isin("inside", "unclear") | ((F.col("ending") == "final") & (F.col("final_share") < FINAL_WORD_AT_LIMIT)))
    at_limit = open_ends.join(
        limits,
        F.col("source").eqNullSafe(F.col("l_source")) & (F.col("measure") == F.col("l_measure")) & F.col("length").between(F.col("storage_limit") - UNIT + 1, F.col("storage_limit")),
        "left_semi",
    ).select("key", "source", F.lit("limit").alias("step"))
    elsewhere = read.filter("ending = 'inside'").select("key", "source", F.lit("transfer").alias("step"))
    # "limit" comes first
    return at_limit.unionAll(elsewhere).groupBy("key", "source").agg(F.min("step").alias("step"))


def truncated(read: DataFrame) -> DataFrame:
    """(key, source) of the texts that were cut."""
    return cuts(read).select("key", "source")


def cuts_by_step(read: DataFrame) -> DataFrame:
    """(source, step, n): how many of a source's texts each step found."""
    return cuts(read).groupBy("source", "step").agg(F.count("*").alias("n"))


def truncation_by_source(read: DataFrame) -> DataFrame:
    """(source, n_texts, n_cut, share): of a source's texts that are not blank, those that were cut."""
    texts = read.filter("ending is not null").groupBy("source").agg(F.count("*").alias("n_texts"))
    cut = truncated(read).groupBy(F.col("source").alias("c_source")).agg(F.count("*").alias("n_cut"))
    return texts.join(cut, F.col("source").eqNullSafe(F.col("c_source")), "left").select(
        "source", "n_texts", F.coalesce("n_cut", F.lit(0)).alias("n_cut"), (F.coalesce("n_cut", F.lit(0)) / F.col("n_texts")).alias("share")
    )
