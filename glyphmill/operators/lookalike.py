"""Look-alike repair: words that mix Latin, Greek and Cyrillic letters get the letters of one script, or are split.

All of it is a Column expression: letters are counted by the length of what a pattern leaves, mapped by translate, and a word is
split by one replacement whose pattern holds both runs. Words of one script pass untouched. Null stays null.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that look alike, a row each.
ROWS = """
A Α А
B Β В
C Ϲ С
E Ε Е
H Η Н
I Ι І
K Κ К
M Μ М
N Ν
O Ο О
P Ρ Р
S Ѕ
T Τ Т
X Χ Х
Y Υ У
Z Ζ
a а
c с
d Ԁ
e е
h һ
i і
j ϳ ј
o ο о
p ρ р
s ѕ
u υ
x х
y у
È Ѐ
Ë Ё
Ə Ә
Ï Ϊ
Ö Ӧ
Ÿ Ϋ
è ѐ
ë ё
ə ә
ï ϊ ї
ö ӧ
ü ϋ
Γ Г
Π П
Φ Ф
ϴ Ө
κ к
"""
#: Words that are kept as Latin or as Cyrillic.
LATIN_WORDS = "SpA USA".split()
CYRILLIC_WORDS = "әр Әр әрі сі Сі іс Іс ісі ірі".split()
#: Ranges of the three scripts, as the inside of a class.
SCRIPTS = {
    "Latin": r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2AF}\x{2C60}-\x{2C7F}\x{A720}-\x{A7FF}\x{AB30}-\x{AB6F}",
    "Greek": r"\x{370}-\x{3FF}\x{1F00}-\x{1FFF}",
    "Cyrillic": r"\x{400}-\x{52F}\x{1C80}-\x{1C8F}\x{2DE0}-\x{2DFF}\x{A640}-\x{A69F}",
}
ROMAN = "^(?=..)(?:X{0,3}|XL|LX{0,2}|XC)(?:I{0,3}|IV|VI{0,3}|IX)$"


def script(ch: str) -> str | None:
    """Latin, Greek, Cyrillic or None."""
    c = ord(ch)
    if ch.isascii() and ch.isalpha() or 0xC0 <= c <= 0x2AF and c not in (0xD7, 0xF7) or 0x2C60 <= c <= 0x2C7F or 0xA720 <= c <= 0xA7FF or 0xAB30 <= c <= 0xAB6F:
        return "Latin"
    if 0x370 <= c <= 0x3FF or 0x1F00 <= c <= 0x1FFF:
        return "Greek"
    return "Cyrillic" if 0x400 <= c <= 0x52F or 0x1C80 <= c <= 0x1C8F or 0x2DE0 <= c <= 0x2DFF or 0xA640 <= c <= 0xA69F else None


def pairs(rows: Iterable[str]) -> dict[tuple[str, str], dict[str, str]]:
    """(from script, to script): letter to letter, by the first letter of each script in a row."""
    out: dict[tuple[str, str], dict[str, str]] = {(a, b): {} for a in SCRIPTS for b in SCRIPTS if a != b}
    for row in rows:
        first: dict[str, str] = {}
        for ch in row.split():
            if (s := script(ch)) is not None:
                first.setdefault(s, ch)
        for a, x in first.items():
            for b, y in first.items():
                if a != b:
                    out[a, b][x] = y
    return out


def gate(c: Column) -> Column:
    """Letters of at least two of the scripts occur."""
    l, g, k = (c.rlike(f"[{v}]") for v in SCRIPTS.values())
    return (l & g) | (l & k) | (g & k)


def split_points() -> str:
    """A run of three or more of one script that ends before two letters of another and one more character."""
    return "|".join(f"[{a}][{a}./_-]+[{a}](?={'|'.join(f'[{b}]{{2}}[^ ]' for k, b in SCRIPTS.items() if b != a)})" for a in SCRIPTS.values())


def mapped(x: Column, table: dict, *keys: tuple[str, str]) -> Column:
    t = {k: v for key in keys for k, v in table[key].items()}
    return F.translate(x, "".join(t), "".join(t.values()))


def target_of(x: Column, table: dict) -> Column:
    """The script that a mixed word is mapped to; null for none."""

    def count(inside: str) -> Column:
        return F.length(F.regexp_replace(x, F.lit(f"[^{inside}]"), F.lit("")))

    latin, cyrillic = count(SCRIPTS["Latin"]), count(SCRIPTS["Cyrillic"])
    to_latin, to_cyrillic = count("".join(table["Cyrillic", "Latin"])), count("".join(table["Latin", "Cyrillic"]))
    as_latin, as_cyrillic = mapped(x, table, ("Cyrillic", "Latin")), mapped(x, table, ("Latin", "Cyrillic"))
    return (
        F.when((to_latin == cyrillic) & (to_cyrillic < latin), "Latin")
        .when((to_cyrillic == latin) & (to_latin < cyrillic), "Cyrillic")
        .when((cyrillic == 1) & (to_latin == 1) & (latin >= 3), "Latin")
        .when((latin == 1) & (to_cyrillic == 1) & (cyrillic >= 3), "Cyrillic")
        .when(as_cyrillic.isin(CYRILLIC_WORDS), "Cyrillic")
        .when(as_latin.isin(LATIN_WORDS) | as_latin.rlike(ROMAN), "Latin")
    )


def split(x: Column) -> Column:
    return F.regexp_replace(x, F.lit(split_points()), F.lit("$0 "))


def _table(rows: Iterable[str] | None) -> dict:
    return pairs(ROWS.strip().split("\n") if rows is None else rows)


def repaired(c: Column, rows: Iterable[str] | None = None) -> Column:
    """The text with mixed words repaired; rows of look-alikes may be given."""
    table = _table(rows)

    def word(x: Column) -> Column:
        target = target_of(x, table)
        whole = {s: mapped(x, table, *((a, s) for a in SCRIPTS if a != s)) for s in ("Latin", "Cyrillic")}
        return F.when(target == "Latin", whole["Latin"]).when(target == "Cyrillic", whole["Cyrillic"]).otherwise(split(x))

    parts = F.regexp_extract_all(c, F.lit(r"\s+|\S+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(gate(x), word(x)).otherwise(x)), "")


def outcomes(c: Column, rows: Iterable[str] | None = None) -> Column:
    """word, kind of each mixed word in order: what becomes of it, to-Latin, to-Cyrillic, split or unchanged. No rule leads to Greek."""
    table = _table(rows)
    words = F.filter(F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0)), gate)
    kind = lambda x: F.coalesce(F.concat(F.lit("to-"), target_of(x, table)), F.when(split(x) != x, "split").otherwise("unchanged"))
    return F.transform(words, lambda x: F.struct(x.alias("word"), kind(x).alias("kind")))
