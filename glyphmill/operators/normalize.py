"""Normalization as Column expressions: named steps, each behind a gate on the original text.

Every step is a JVM expression (translate, regexp_replace, or a lookup over extracted pieces), applied only where its gate is open;
gates read one mask of the original's characters. Runs of ASCII are passed over whole by the steps whose sources lie beyond it.
Steps that are not enabled are not in the plan. Null stays null.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import mappings as M
from glyphmill.functions import masks, tries
from glyphmill.functions.masks import class_of, let
from glyphmill.operators import lookalike

# Fixed value: the steps of the preset default.
DEFAULT = frozenset("repair-encoding-errors del-surrogate del-ctrl-char del-tatweel core-compat pres-form hangul repair-combining combining-compose combining-decompose repair-xml repair-url-escapes".split())


#: Separates the entries of tables in one literal; a code point that is never assigned.
SEPARATOR = "\uffff"


def strings(values: Iterable[str]) -> Column:
    """An array of strings from one literal, made when the plan is optimized; a literal an entry would make the plan as long as the table."""
    return F.split(F.lit(SEPARATOR.join(values)), SEPARATOR)


def looked_up(c: Column, table: dict[str, str]) -> Column:
    """Replaces single characters by their targets: one to one by translate, others piece by piece, where runs of ASCII are a piece."""
    one = {k: v for k, v in table.items() if len(v) == 1}
    more = {k: v for k, v in table.items() if len(v) > 1}
    gone = [k for k, v in table.items() if not v]
    rest = lambda x: F.translate(x, "".join([*one, *gone]), "".join(one.values())) if one or gone else x
    if not more:
        return rest(c) if one else F.regexp_replace(c, F.lit(f"{class_of(gone)}+"), F.lit("")) if gone else c
    # a source's place in the table, as a character that translate gives, is where its target is
    keys, base = sorted(more), 0x4E00
    places = "".join(chr(base + k) for k in range(len(keys)))
    targets = strings(more[k] for k in keys)
    inside = class_of(more)[1:]
    # what lies between two sources is one piece; ASCII in it is passed over without a look at the class
    between = f"(?:[\\x00-\\x7F]++|[^\\x00-\\x7F{inside}++)++" if min(more) > "\x7f" else f"[^{inside}++"
    parts = F.regexp_extract_all(c, F.lit(f"{between}|[{inside}"), F.lit(0))
    found = lambda x: F.get(targets, F.ascii(F.translate(x, "".join(keys), places)) - base)
    return F.array_join(F.transform(parts, lambda x: F.when((F.length(x) == 1) & x.rlike(f"^[{inside}"), found(x)).otherwise(rest(x))), "")


def pieces(c: Column, pattern: str, table: dict[str, str], rest: str) -> Column:
    """Looks up each match of the pattern; rest matches runs in which no match can begin, which stay as one piece."""
    keys = sorted(table)
    found = F.map_from_arrays(strings(keys), strings(table[k] for k in keys))
    parts = F.regexp_extract_all(c, F.lit(f"{pattern}|{rest}|[\\s\\S]"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(f"^(?:{pattern})$"), F.coalesce(F.try_element_at(found, x), x)).otherwise(x)), "")


def replaced(*rules: tuple[str, str]) -> Callable[[Column], Column]:
    def apply(c: Column) -> Column:
        for pattern, by in rules:
            c = F.regexp_replace(c, F.lit(pattern), F.lit(by))
        return c

    return apply


class TableStep:
    """A lookup of the characters in the given ranges (all of the table's without), in the tables one after the other."""

    def __init__(self, *lookups: tuple[Callable[[], dict[str, str]] | dict[str, str], tuple]):
        self.lookups = lookups

    def tables(self) -> list[dict[str, str]]:
        out = []
        for table, ranges in self.lookups:
            t = table() if callable(table) else table
            allowed = set(M.span(*ranges)) if ranges else t.keys()
            out.append({k: v for k, v in t.items() if k in allowed})
        return out

    def sources(self) -> frozenset[str]:
        return frozenset(k for t in self.tables() for k in t)

    def __call__(self, c: Column) -> Column:
        for t in self.tables():
            c = looked_up(c, t)
        return c


def table_step(table: Callable[[], dict[str, str]] | dict[str, str], *ranges) -> TableStep:
    return TableStep((table, ranges))


@dataclass(frozen=True)
class Gate:
    """A test of the mask of a text's characters (see masks) and of its language; classes: those it asks for."""

    classes: frozenset[str]
    test: Callable[[Column, str], Column]

    def __call__(self, m: Column, lang: str) -> Column:
        return self.test(m, lang)


def has(*names: str) -> Gate:
    """Any of the classes occurs."""
    return Gate(frozenset(names), lambda m, lang: masks.holds(m, *names))


def both(*gates: Gate) -> Gate:
    return Gate(frozenset().union(*(g.classes for g in gates)), lambda m, lang: reduce(Column.__and__, (g(m, lang) for g in gates)))


def spoken(*langs: str, other: bool = False) -> Gate:
    return Gate(frozenset(), lambda m, lang: F.lit((lang in langs) != other))


def _two_scripts(m: Column, lang: str) -> Column:
    latin, greek, cyrillic = (masks.holds(m, x) for x in ("latin", "greek", "cyrillic"))
    return (latin & greek) | (latin & cyrillic) | (greek & cyrillic)


two_scripts = Gate(frozenset({"latin", "greek", "cyrillic"}), _two_scripts)


def everything() -> dict[str, str]:
    """All single-character targets, later tables over earlier ones."""
    return M.literal() | M.core() | M.presentation() | M.cjk() | M.composing()[1] | M.enclosure() | M.font()


#: Vowel signs (first, last) and nukta by script.
NUKTA_ORDER = [("ा", "्", "़"), ("া", "্", "়"), ("ਾ", "੍", "਼"), ("ા", "્", "઼"), ("ା", "୍", "଼"), ("ಾ", "್", "಼"), ("ᰦ", "ᰬ", "᰷"), ("\U000110b0", "\U000110b8", "\U000110ba"), ("\U000111b3", "\U000111c0", "\U000111ca"), ("\U0001122c", "\U00011235", "\U00011236"), ("\U000112e0", "\U000112e8", "\U000112e9"), ("\U0001133e", "\U0001134d", "\U0001133c"), ("\U00011435", "\U00011442", "\U00011446"), ("\U000114b0", "\U000114c2", "\U000114c3"), ("\U000115af", "\U000115bf", "\U000115c0"), ("\U000116ad", "\U000116b6", "\U000116b7"), ("\U0001182c", "\U00011839", "\U0001183a"), ("\U00011930", "\U0001193e", "\U00011943"), ("\U00011d31", "\U00011d3f", "\U00011d42")]
ACCENTS, INDIC = r"[\x{300}-\x{36F}\x{653}-\x{655}\x{3099}\x{309A}]", r"[\x{93C}\x{9BE}-\x{102E}\x{1B35}\x{11000}-\x{115FF}]"


def nuktas(c: Column) -> Column:
    """A nukta goes before vowel signs and stands once. The scripts share no character, so one look at the text does for all of them."""
    many = [n for _, _, n in NUKTA_ORDER if ord(n) < 0x1000]
    swaps = [f"([{first}-{last}])({nukta}{'+' if nukta in many else ''})" for first, last, nukta in NUKTA_ORDER]
    signs = "".join(f"{first}-{last}" for first, last, _ in NUKTA_ORDER)
    # groups of the scripts that do not match are empty
    swapped = "".join(f"${2 * k + 2}${2 * k + 1}" for k in range(len(swaps)))
    return replaced((f"(?=[{signs}])(?:{'|'.join(swaps)})", swapped), (f"([{''.join(many)}])\\1+", "$1"))(c)


def composed(c: Column) -> Column:
    made = M.composing()[0]
    for n in (3, 2, 1):
        c = pieces(c, rf"[^\n]{ACCENTS}{{{n}}}", {k: v for k, v in made.items() if len(k) == n + 1 and re.fullmatch(r"[̀-ͯٓ-゙゚ٕ]+", k[1:])}, rf"[^{ACCENTS[1:]}+(?!{ACCENTS})")
    c = pieces(c, rf"[^\n]{INDIC}", {k: v for k, v in made.items() if len(k) == 2 and re.fullmatch("[़া-ီᬵ\U00011000-\U000115ff]", k[1])}, rf"[^{INDIC[1:]}+(?!{INDIC})")
    return F.replace(c, F.lit("եւ"), F.lit("և"))


def syllables(c: Column) -> Column:
    """Leading, vowel and trailing jamo to one syllable, by code point arithmetic."""
    parts = F.regexp_extract_all(c, F.lit(r"[\x{1100}-\x{1112}][\x{1161}-\x{1175}][\x{11A8}-\x{11C2}]?|[^\x{1100}-\x{1112}]+|[\s\S]"), F.lit(0))

    def join(x: Column) -> Column:
        at = lambda k: F.ascii(F.substring(x, k, 1))  # noqa: E731  the code point
        tail = F.when(F.length(x) > 2, at(3) - 0x11A7).otherwise(0)
        cp = 0xAC00 + (at(1) - 0x1100) * 588 + (at(2) - 0x1161) * 28 + tail
        return F.when(x.rlike(r"^[\x{1100}-\x{1112}][\x{1161}-\x{1175}]"), F.decode(F.unhex(F.hex(cp)), "UTF-16BE")).otherwise(x)

    return F.array_join(F.transform(parts, join), "")


def unbroken(c: Column) -> Column:
    """Mojibake of three, two and one characters."""
    t = M.mojibake()
    by = {n: {k: v for k, v in t.items() if len(k) == n} for n in (1, 2, 3)}
    c = pieces(c, r"\x{E2}[\x{80}-\x{BF}]{2}", by[3], r"[^\x{E2}]+")
    c = pieces(c, r"[\x{C2}\x{C3}\x{C5}\x{C6}\x{CB}][\x{80}-\x{2FF}\x{2000}-\x{21FF}]", by[2], r"[^\x{C2}\x{C3}\x{C5}\x{C6}\x{CB}]+")
    return pieces(c, r"[\x{80}-\x{9F}]", by[1], r"[^\x{80}-\x{9F}]+")


def georgian(c: Column) -> Column:
    src = M.span((0x1C90, 0x1CBA), (0x1CBD, 0x1CBF), (0x10A0, 0x10C5), 0x10C7, 0x10CD, (0x2D00, 0x2D25), 0x2D27, 0x2D2D)
    to = M.span((0x10D0, 0x10FA), (0x10FD, 0x10FF), (0x10D0, 0x10F5), 0x10F7, 0x10FD, (0x10D0, 0x10F5), 0x10F7, 0x10FD)
    c = F.translate(c, "".join(src), "".join(to))
    for k, v in M.GEORGIAN_OLD.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


@dataclass(frozen=True)
class Step:
    name: str
    opens: Gate
    apply: Callable[[Column], Column]
    #: characters of which one stands in each word (between blanks and ends of lines) that the step changes; a table step's are its sources
    touches: tuple = ()

    def sources(self) -> frozenset[str]:
        """Those characters."""
        return frozenset(M.span(*self.touches)) if self.touches else self.apply.sources()

    def gate(self, text: Column, lang: str) -> Column:
        """Whether the step is called on a text."""
        return let(masks.mask(text, self.opens.classes), lambda m: self.opens(m, lang))


#: Ranges of Greek and Cyrillic letters: a word of two scripts has one of them.
MIXING = ((0x370, 0x3FF), (0x1F00, 0x1FFF), (0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))
#: In order of application.
STEPS = [
    Step("repair-encoding-errors", has("broken"), unbroken, ((0x80, 0x9F), 0xC2, 0xC3, 0xC5, 0xC6, 0xCB, 0xE2)),
    Step("del-ctrl-char", has("control"), replaced((class_of(M.span((0, 8), 0x0B, 0x0C, (0x0E, 0x1F), 0x7F, (0x80, 0x9F))), ""), (r"(?<=[\x{0}-\x{218F}])[\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]", "")), ((0, 8), 0x0B, 0x0C, (0x0E, 0x1F), 0x7F, (0x80, 0x9F), (0xFE00, 0xFE0F), (0xE0100, 0xE01EF))),
    Step("del-zero-width", has("control"), table_step(dict.fromkeys(M.ZERO_WIDTH, ""))),
    Step("del-tatweel", has("tatweel"), table_step({M.TATWEEL: ""})),
    Step("del-arabic-diacr", has("arabic mark"), table_step(dict.fromkeys(M.ARABIC_MARKS, ""))),
    Step("del-hebrew-diacr", has("hebrew point"), table_step(dict.fromkeys(M.HEBREW_POINTS, ""))),
    Step("core-compat", has("core"), table_step(everything, (0x2160, 0x217F), (0x3131, 0x318E), 0x0E33, 0x0EB3, 0x0EDC, 0x0EDD)),
    Step("pres-form", has("presented"), table_step(everything, (0xFB50, 0xFDFF), (0xFE70, 0xFEFC))),
    Step("ligatures", has("ligature"), table_step(M.LIGATURES)),
    Step("signs-and-symbols", has("sign"), table_step(M.SIGNS)),
    Step("cjk", has("cjk"), table_step(everything, (0x2F00, 0x2FDF), (0x3038, 0x303A), 0x3250, (0x32C0, 0x33FF), (0xF900, 0xFAFF), 0x1F190, 0x1F200, (0x2F800, 0x2FA1F))),
    Step("width", has("width"), table_step(everything, (0xFF01, 0xFFEE))),
    Step("font", has("font"), table_step(everything, (0x2102, 0x2149), (0xFB20, 0xFB29), (0x1D400, 0x1D7FF), (0x1EE00, 0x1EEBB), (0x1FBF0, 0x1FBF9))),
    Step("small", has("font"), table_step(everything, (0xFE50, 0xFE6F))),
    Step("vertical", has("font"), table_step(everything, 0x309F, 0x30FF, (0xFE10, 0xFE19), (0xFE30, 0xFE48))),
    Step("enclosure", has("enclosure"), table_step(everything, (0x2460, 0x2488), (0x249C, 0x2500), 0x3036, (0x3200, 0x32C0), (0x32D0, 0x32FF), (0x1F110, 0x1F16A), (0x1F201, 0x1F260))),
    Step("hangul", has("jamo vowel"), syllables, ((0x1161, 0x1175),)),
    Step("repair-combining", has("nukta"), nuktas, tuple(ord(n) for _, _, n in NUKTA_ORDER)),
    Step("combining-compose", both(has("anchor"), has("mark")), composed, ((0x300, 0x36F), (0x653, 0x655), 0x3099, 0x309A, 0x93C, (0x9BE, 0x102E), 0x1B35, (0x11000, 0x115FF), 0x582)),
    Step("combining-decompose", has("apart"), table_step(everything, 0x0344, (0x0958, 0x095F), (0x09DC, 0x0B5D), (0x0F43, 0x0FB9), 0x2ADC, (0xFB1D, 0xFB4E), (0x1D100, 0x1D1FF))),
    Step("punct", has("core"), TableStep((M.PUNCT, ()), (everything, (0x2011, (0x2024, 0x2026), (0x2033, 0x203C), (0x2047, 0x2057), 0x2329, 0x232A, (0x2A74, 0x2A76), (0x222C, 0x2230), 0x2A0C, (0x2488, 0x249B), (0x1F100, 0x1F10A))))),
    Step("punct-arabic", has("arabic punctuation"), table_step(M.PUNCT_ARABIC)),
    Step("punct-cjk", has("cjk punctuation"), table_step(M.PUNCT_CJK)),
    Step("punct-greek", has("greek punctuation"), table_step(M.PUNCT_GREEK)),
    Step("punct-misc-f", has("other punctuation"), table_step(M.PUNCT_MISC)),
    Step("punct-dash", has("dash"), table_step(M.DASHES)),
    Step("space", has("space"), table_step(M.SPACES)),
    Step("digit", has("digit"), table_step(M.digits)),
    Step("farsi-char", both(spoken("fas"), has("arabic"), has("farsi", "presented")), table_step(M.FARSI)),
    Step("pashto-char", both(spoken("pas"), has("arabic"), has("pashto", "presented")), table_step(M.PASHTO)),
    Step("arabic-char", both(spoken("fas", "pas", other=True), has("arabic"), has("arabic letter", "presented")), table_step(M.ARABIC)),
    Step("georgian-char", has("georgian"), georgian, ((0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F))),
    Step("look-alike", two_scripts, lookalike.repaired, MIXING),
    Step("repair-xml", both(has("ampersand"), has("semicolon")), replaced((r"(?i)(?<=&)(?:amp;)+(?=(?:amp|apos|gt|lt|nbsp|quot|#\d{1,6}|#x[0-9A-F]{1,5});)", "")), (0x26,)),
    Step("repair-url-escapes", has("percent"), replaced((r"%25([CD][0-9A-F]%)25([89AB][0-9A-F])", "%$1$2"), (r"%25(E[0-9A-F]%)25([89AB][0-9A-F]%)25([89AB][0-9A-F])", "%$1$2$3")), (0x25,)),
    Step("repair-token", both(has("arabic"), has("detached", "digit")), replaced((r"([-_+*|%0-9]+)([\x{600}-\x{6FF}])", "$1 $2"), (r"([\x{600}-\x{6FF}])([-_+*|%0-9]+)", "$1 $2")), ((0x600, 0x6FF),)),
]
NAMES = [s.name for s in STEPS]
#: Applied whatever is chosen.
ALWAYS = frozenset({"repair-url-escapes"})


def chosen(base: str = "default", add=(), skip=()) -> frozenset[str]:
    """Names of the enabled steps: of base none, default or all, without skip, with add (which beats skip)."""
    start = {"none": frozenset(), "default": DEFAULT, "all": frozenset(NAMES)}[base.lower()]
    return (start - frozenset(skip)) | frozenset(add)


def with_look_alikes(rows: Iterable[str] | None) -> list[Step]:
    """The steps, look-alike by the given rows (the built-in ones without)."""
    if rows is None:
        return STEPS
    rows = list(rows)
    return [Step(s.name, s.opens, lambda c: lookalike.repaired(c, rows), MIXING) if s.name == "look-alike" else s for s in STEPS]


def mapping(table: dict[str, str]) -> Step:
    """The step `mapping`, which comes after all others and is called on every text."""
    if not all(table):
        raise ValueError("a source must have a character")
    return Step("mapping", Gate(frozenset(), lambda m, lang: F.lit(True)), lambda x: F.when(x.rlike(class_of(k[0] for k in table)), tries.replaced(x, table)).otherwise(x))


#: Below it, characters that no step touches are told by a short class.
LOW = 0x250


def odd_words(steps: Iterable[Step]) -> str:
    """A pattern of a run of words (group 1, which may be empty) that some of the steps may change, and of the text up to the next such word
    (group 2), from where the match before ended. A word lies between blanks and ends of lines and has the one blank before it with it:
    no step looks further. Every part of the pattern is possessive, so it takes one pass and no stack."""
    touched = frozenset().union(*(s.sources() for s in steps))
    if "\n" in touched or " " in touched:
        raise ValueError("a step may not change blanks or ends of lines")
    low = [c for c in map(chr, range(LOW)) if c not in touched and c not in " \n"]
    kept = f"(?:{class_of(low)}++|[^\\x{{0}}-\\x{{{LOW - 1:X}}}{class_of(c for c in touched if ord(c) >= LOW)[1:]}++)*+"
    return rf"\G((?: ?+{kept}[^ \n]++)*+)((?=[\s\S])(?:\n| ?+{kept}(?![^ \n]))++)"


def collapsed(text: Column, steps: Iterable[Step]) -> Column:
    """The words that some of the steps may change, and one end of line for all that stands between two runs of them."""
    return F.regexp_replace(text, F.lit(odd_words(steps)), F.lit("$1\n"))


def nothing_odd(words: Column) -> Column:
    """Whether a collapsed text holds no word."""
    return words.isin("", "\n")


def restored(words: Column, text: Column, steps: Iterable[Step]) -> Column:
    """The text with its collapsed words, as they are now, in their places."""
    between = F.regexp_extract_all(text, F.lit(odd_words(steps)), F.lit(2))
    return F.array_join(F.zip_with(F.split(words, "\n"), between, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def normalize(text: Column, steps: frozenset[str] | None = None, lang: str = "", look_alikes: Iterable[str] | None = None, table: dict[str, str] | None = None) -> Column:
    """The normalized text. Gates look at the original, steps at what the steps before have made of it.

    look_alikes: rows for the step look-alike. table: sources of one or more characters and their targets, looked up after all steps from
    left to right, the longest source first."""
    steps = DEFAULT if steps is None else steps
    mine = [s for s in with_look_alikes(look_alikes) if s.name in steps or s.name in ALWAYS]

    def guarded(s: Step, m: Column) -> Callable[[Column], Column]:
        return lambda now: F.when(s.opens(m, lang), s.apply(now)).otherwise(now)

    def chain(x: Column, m: Column) -> Column:
        for s in mine:
            x = let(x, guarded(s, m))
        return x

    def by_words(x: Column, m: Column) -> Column:
        return let(collapsed(x, mine), lambda words: F.when(nothing_odd(words), x).otherwise(restored(chain(words, m), x, mine)))

    # a text without a character of any class is left as it is; of others only the words that hold one go through the steps
    asked = frozenset().union(*(s.opens.classes for s in mine))
    out = let(text, lambda x: let(masks.mask(x, asked), lambda m: F.when(m == 0, x).otherwise(by_words(x, m))))
    if table:
        out = let(out, lambda x: mapping(table).apply(x))
    return F.regexp_replace(out, "(?<! ) ++(?=[\t\n]|$(?![\\s\\S]))", "")

