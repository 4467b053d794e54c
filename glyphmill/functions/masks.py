"""What kinds of characters a text holds, as one number: a bit for each class, from one pass over its characters beyond ASCII.

mask(text) takes those characters out, maps each by one translate to the letter of its combination of classes, and ors the bits of
the combinations that occur. The few classes with ASCII members are searched for in the text, mostly to the first hit. Gates of the
normalization read that number and never the text.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions import mappings as M

#: Ranges that are tried one by one.
FEW = 4
CONTROL = M.span((0, 8), 0x0B, 0x0C, (0x0E, 0x1F), 0x7F, (0x80, 0x9F), (0xFE00, 0xFE0F), (0xE0100, 0xE01EF))
WIDTHLESS = M.span((0x200B, 0x200F), 0xFEFF)
ARABIC = M.span((0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFE))
PRESENTED = M.span((0xFB50, 0xFDFF), (0xFE70, 0xFEFE))
GEORGIAN = M.span((0x10A0, 0x10FE), (0x1C90, 0x1CBE), (0x2D00, 0x2D2E))
NUKTA = M.span(0x093C, 0x09BC, 0x0A3C, 0x0ABC, 0x0B3C, 0x0CBC, 0x1C37, 0x110BA, 0x11173, 0x111CA, 0x11236, 0x112E9, 0x1133C, 0x11446, 0x114C3, 0x115C0, 0x116B7, 0x1183A, 0x11943, 0x11D42, 0x1E94A)
LATIN = M.span((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x2AF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xAB30, 0xAB6F))
GREEK = M.span((0x370, 0x3FF), (0x1F00, 0x1FFF))
CYRILLIC = M.span((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))


@cache
def classes() -> dict[str, frozenset[str]]:
    """Characters by class; the k-th class has the bit 1 << k."""
    first = lambda table: (k[0] for k in table)
    made, apart = M.composing()
    return {
        name: frozenset(chars)
        for name, chars in {
            "broken": M.span((0x80, 0x9F), 0xC2, 0xC3, 0xC5, 0xC6, 0xCB, 0xE2),
            "control": [*CONTROL, *WIDTHLESS],
            "tatweel": M.TATWEEL,
            "arabic mark": M.ARABIC_MARKS,
            "hebrew point": M.HEBREW_POINTS,
            "core": first(M.core()),
            "presented": PRESENTED,
            "ligature": [*M.LIGATURES, *"ำຳໜໝ"],
            "sign": M.SIGNS,
            "cjk": first(M.cjk()),
            "width": M.span((0xFF01, 0xFFEE)),
            "font": first(M.font()),
            "enclosure": first(M.enclosure()),
            "jamo vowel": M.span((0x1161, 0x1175)),
            "nukta": NUKTA,
            "anchor": first(made),
            "mark": (k[1] for k in made),
            "apart": first(apart),
            "arabic punctuation": [*M.PUNCT_ARABIC, *M.ARABIC_MARKS],
            "cjk punctuation": M.PUNCT_CJK,
            "greek punctuation": M.PUNCT_GREEK,
            "other punctuation": M.PUNCT_MISC,
            "dash": [*M.DASHES, *"­︱︲﹘﹣－"],
            "space": M.SPACES,
            "digit": first(M.digits()),
            "arabic": ARABIC,
            "farsi": M.FARSI,
            "pashto": M.PASHTO,
            "arabic letter": M.ARABIC,
            "georgian": GEORGIAN,
            "latin": LATIN,
            "greek": GREEK,
            "cyrillic": CYRILLIC,
            "ampersand": "&",
            "semicolon": ";",
            "percent": "%",
            "detached": "0123456789-_+*|%",
        }.items()
    }


@cache
def bits() -> dict[str, int]:
    return {name: 1 << k for k, name in enumerate(classes())}


@cache
def combinations() -> dict[int, str]:
    """Characters beyond ASCII by the bits of all their classes."""
    of: dict[str, int] = {}
    for name, chars in classes().items():
        for c in chars:
            if c > "\x7f":
                of[c] = of.get(c, 0) | bits()[name]
    out: dict[int, list[str]] = {}
    for c in sorted(of):
        out.setdefault(of[c], []).append(c)
    return {m: "".join(chars) for m, chars in out.items()}


def ranges(chars: Iterable[str]) -> list[tuple[int, int]]:
    """Code points as inclusive ranges."""
    out: list[list[int]] = []
    for c in sorted({ord(c) for c in chars}):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return [(a, z) for a, z in out]


def class_of(chars: Iterable[str]) -> str:
    """A regular expression's class of single characters, as ranges. Java tries a class's ranges one by one, so many are told apart by
    a tree: of the ranges around them, FEW at most in a class, those within are tried where a character lies in them."""

    def inside(found: list[tuple[int, int]]) -> str:
        if len(found) <= FEW:
            return "".join(rf"\x{{{a:X}}}" + (rf"-\x{{{z:X}}}" if z > a else "") for a, z in found)
        size = FEW ** max(1, math.ceil(math.log(len(found), FEW) - 1e-9) - 1)
        parts = [found[k : k + size] for k in range(0, len(found), size)]
        return "".join(rf"[\x{{{p[0][0]:X}}}-\x{{{p[-1][1]:X}}}&&[{inside(p)}]]" for p in parts)

    return f"[{inside(ranges(chars))}]"


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, however often body names it: expressions grow with the steps, not as their power."""
    return F.element_at(F.transform(F.array(value), body), 1)


def mask(text: Column, wanted: Iterable[str] | None = None) -> Column:
    """The bits of all wanted classes (all of them without) with a character in the text; null for null."""
    asked = sum(bits()[name] for name in (classes() if wanted is None else set(wanted)))
    seen = [(m & asked, chars) for m, chars in combinations().items() if m & asked]
    merged: dict[int, str] = {}
    for m, chars in seen:
        merged[m] = merged.get(m, "") + chars
    signs = [chr(c) for c in range(1, 0x80)]  # no ASCII is left of the text, so these stand for combinations alone
    if len(merged) > len(signs):
        raise ValueError("more combinations of classes than signs")
    flags = []
    if merged:
        of = dict(zip(merged, signs))
        beyond = F.regexp_replace(text, F.lit(r"[\x00-\x7F]+"), F.lit(""))
        found = F.translate(beyond, "".join(merged.values()), "".join(of[m] * len(chars) for m, chars in merged.items()))
        flags.append(F.when(beyond == "", F.lit(0).cast("long")).otherwise(let(found, lambda x: reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.contains(x, F.lit(s)), F.lit(m)).otherwise(0).cast("long") for m, s in of.items())))))
    for name, chars in classes().items():
        if bits()[name] & asked and (low := [c for c in chars if c <= "\x7f"]):
            hit = F.contains(text, F.lit(low[0])) if len(low) == 1 else text.rlike(class_of(low))
            flags.append(F.when(hit, F.lit(bits()[name])).otherwise(0).cast("long"))
    return reduce(lambda a, b: a.bitwiseOR(b), flags) if flags else F.when(text.isNotNull(), F.lit(0).cast("long"))


def holds(m: Column, *names: str) -> Column:
    """Whether a mask has any of the classes."""
    return m.bitwiseAND(F.lit(sum(bits()[n] for n in names)).cast("long")) != 0
