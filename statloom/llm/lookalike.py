"""One form for texts that look the same.

Characters of other width, composition or invisibility, kinds of blanks, dots, dashes and compatibility Hanja are
replaced one by one. Letters are settled token by token: the scripts that a letter can be spelled in (its own, and those
with a letter of the same shape) are intersected over the token. If the result has a script, the token is spelled in the
preferred one (whole-script confusables, mixed tokens with a consistent spelling); otherwise each letter takes the
preferred spelling of its own. Hangul, Hanja and Kana never take part: Korean mixes them with Latin as a matter of course.

Defined cases
- Case, accents, raised, enclosed or squared figures, unit signs, brackets, and the number of blanks and marks stay.
- Null stays null and is equal to null only; empty stays empty. Repeated rows of a document count once. A text of only
  invisible characters becomes empty.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.session import cut_lineage

# Letters of the same shape. Columns are scripts in order of preference; "." where a script has none.
SCRIPTS = ("Latin", "Greek", "Cyrillic", "Armenian", "Cherokee", "Coptic")
SAME_SHAPE = """
A Α А .
B Β В .
C Ϲ С .
E Ε Е .
G . Ԍ .
H Η Н .
I Ι І .
J Ϳ Ј .
K Κ К .
M Μ М .
N Ν . .
O Ο О Օ
P Ρ Р .
Q . Ԛ .
S . Ѕ Տ
T Τ Т .
W . Ԝ .
X Χ Х .
Y Υ Ү .
Z Ζ . .
a . а .
c ϲ с .
d . ԁ .
e . е .
h . һ հ
i . і .
j ϳ ј յ
n . . ո
o ο о օ
p ρ р .
q . ԛ գ
s . ѕ .
u . . ս
v ν ѵ .
V . Ѵ .
l . ӏ .
w . ԝ .
x . х .
y . у .
. Γ Г .
. Π П .
. Φ Ф .
. κ к .
"""
# Further letters of the same shape as a Latin one: Latin, Cherokee, Coptic.
SAME_SHAPE_AS_LATIN = """
A Ꭺ .
B Ᏼ Ⲃ
C Ꮯ Ⲥ
D Ꭰ .
E Ꭼ Ⲉ
H Ꮋ Ⲏ
J Ꭻ .
K Ꮶ Ⲕ
L Ꮮ .
M Ꮇ Ⲙ
N . Ⲛ
O . Ⲟ
P Ꮲ Ⲣ
R Ꭱ .
S Ꮪ .
T Ꭲ Ⲧ
V Ꮩ .
W Ꮃ .
X . Ⲭ
Y . Ⲩ
Z Ꮓ Ⲍ
c . ⲥ
o . ⲟ
p . ⲣ
x . ⲭ
"""
# Marks of the same shape; the first of a line stands for all.
SAME_MARKS = """
· 00B7 0387 1427 16EB 2022 2027 2219 22C5 30FB 318D 119E FF65 A78F
- 002D 2010 2011 2012 2013 2043 2212 FE58 FE63 FF0D 02D7 06D4
— 2014 2015 2500 2501 FE31
"""
# What shows nothing, beside format and control characters.
INVISIBLE = "034F 115F 1160 17B4 17B5 180B 180C 180D 3164 FFA0"
LINE_ENDS = "\r\n\x0b\x0c\x85\u2028\u2029"

_OTHER_SCRIPTS = regex.compile(r"[\p{Greek}\p{Cyrillic}\p{Armenian}\p{Cherokee}\p{Coptic}]")
_TOKEN = regex.compile(r"[\p{Latin}\p{Greek}\p{Cyrillic}\p{Armenian}\p{Cherokee}\p{Coptic}\p{M}]*[\p{Greek}\p{Cyrillic}\p{Armenian}\p{Cherokee}\p{Coptic}][\p{Latin}\p{Greek}\p{Cyrillic}\p{Armenian}\p{Cherokee}\p{Coptic}\p{M}]*")


@cache
def spellings() -> dict[str, dict[str, str]]:
    """letter -> {script: letter of that script with the same shape}."""
    table = {}
    for line in SAME_SHAPE.split("\n"):
        row = {script: x for script, x in zip(SCRIPTS, line.split(), strict=False) if x != "."}
        table |= {x: row for x in row.values()}
    for line in SAME_SHAPE_AS_LATIN.split("\n"):
        if line:
            latin, cherokee, coptic = line.split()
            row = table.get(latin, {"Latin": latin}) | {s: x for s, x in (("Cherokee", cherokee), ("Coptic", coptic)) if x != "."}
            table |= {x: row for x in row.values()}
    return table


@cache
def own_scripts(letter: str) -> frozenset[str]:
    """Scripts by extension; empty for common and inherited characters, which fit any."""
    return frozenset(s for s in SCRIPTS if regex.match(rf"\p{{scx={s}}}", letter) and not regex.match(r"\p{scx=Common}|\p{scx=Inherited}", letter))


def settle(token: str) -> str:
    """``token`` spelled in one script, as far as its letters allow."""
    letters = unicodedata.normalize("NFD", token)
    table = spellings()
    resolved = frozenset(SCRIPTS)
    for x in letters:
        if own := own_scripts(x):
            resolved &= own | table.get(x, {}).keys()
    if resolved:
        script = next(s for s in SCRIPTS if s in resolved)
        out = "".join(table[x].get(script, x) if x in table else x for x in letters)
    else:
        out = "".join(next(iter(table[x].values())) if x in table else x for x in letters)
    return unicodedata.normalize("NFC", out)


class _Marks(dict):
    """Translation of single characters, worked out when first met."""

    def __init__(self) -> None:
        super().__init__({0x0A: "\n"})
        for line in SAME_MARKS.split("\n"):
            if line:
                mark, *codes = line.split()
                self.update({int(c, 16): mark for c in codes})
        self.update({int(c, 16): None for c in INVISIBLE.split()})
        self.update({ord(c): "\n" for c in LINE_ENDS})

    def __missing__(self, code: int):
        c = chr(code)
        kind = unicodedata.category(c)
        shape, _, parts = unicodedata.decomposition(c).partition(" ")
        if kind == "Zs" or c == "\t":
            to = " "
        elif kind in ("Cf", "Cc") or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
            to = None
        elif shape in ("<wide>", "<narrow>", "<noBreak>"):
            plain = "".join(chr(int(p, 16)) for p in parts.split())
            to = plain.translate(self)
        elif shape == "<compat>" and 0x2E80 <= code <= 0x2FDF:
            to = chr(int(parts, 16))
        else:
            to = c
        self[code] = to
        return to


_marks = _Marks()


def one_form(text: str) -> str:
    """The form that all texts which look like ``text`` share."""
    if text.isascii():
        return text.translate(_marks) if not text.isprintable() else text
    # composition comes first, so that a lone conjoining vowel is not taken for a dot inside a syllable
    text = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).replace("\r\n", "\n").translate(_marks))
    return _TOKEN.sub(lambda m: settle(m[0]), text) if _OTHER_SCRIPTS.search(text) else text


def in_one_form(text: Column | str) -> Column:
    """Column of :func:`one_form` of a text column."""

    @F.arrow_udf("string")
    def form(texts: pa.Array) -> pa.Array:
        return pa.array([x and one_form(x) for x in texts.to_pylist()], pa.string())

    return form(text)


def _digest(*columns: Column | str) -> Column:
    return F.unhex(F.md5(F.concat(*(F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in columns))))


def _looks(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, look, form), distinct: digests of what a row looks like and of how it is stored."""
    return df.select(F.col(key).alias("key"), _digest(*(in_one_form(c) for c in columns)).alias("look"), _digest(*columns).alias("form")).distinct()


def same_looking(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, representative, n_forms), one row for each key and look: the smallest key that looks the same, and in how many stored forms that look occurs.

    Linear in the rows, whatever their number of one look: looks are aggregated before they are shuffled. A row that
    looks like no other represents itself; a null key is represented, but represents only where there is no other.
    """
    docs = cut_lineage(_looks(df, key, columns))
    forms = docs.groupBy("look", "form").agg(F.min("key").alias("first"))
    looks = forms.groupBy("look").agg(F.min("first").alias("representative"), F.count("*").alias("n_forms"))
    return docs.select("key", "look").distinct().join(looks, "look").select("key", "representative", "n_forms")


def same_looking_pairs(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(a, b), a < b: keys whose rows look the same in all columns and differ as stored in at least one.

    Pairs are sought between distinct stored forms of one look, never between rows: a look with a single stored form,
    however often it is repeated, costs one row. Only keys and digests are shuffled; they are written to the checkpoint
    folder because three steps read them.
    """
    docs = cut_lineage(_looks(df, key, columns))
    forms = docs.select("look", "form").distinct()
    pairs = forms.alias("x").join(forms.alias("y"), (F.col("x.look") == F.col("y.look")) & (F.col("x.form") < F.col("y.form"))).select("x.look", F.col("x.form").alias("form_x"), F.col("y.form").alias("form_y"))
    left = docs.select(F.col("key").alias("key_x"), F.col("look").alias("look_x"), F.col("form").alias("form_of_x"))
    right = docs.select(F.col("key").alias("key_y"), F.col("look").alias("look_y"), F.col("form").alias("form_of_y"))
    return (
        pairs.join(left, (F.col("look") == F.col("look_x")) & (F.col("form_x") == F.col("form_of_x")))
        .join(right, (F.col("look") == F.col("look_y")) & (F.col("form_y") == F.col("form_of_y")))
        .filter("key_x <> key_y")
        .select(F.least("key_x", "key_y").alias("a"), F.greatest("key_x", "key_y").alias("b"))
        .distinct()
    )
