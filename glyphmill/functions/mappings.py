"""Character tables of the normalization steps: fixed values, and tables made by rule from the Unicode data.

A table maps one source (one to four characters) to its target. All targets are closed: what the core table maps does not
occur in them.
"""

from __future__ import annotations

import unicodedata as ud
from collections.abc import Iterable
from functools import cache

# Deletions.
ZERO_WIDTH = "­​‌‍‎‏﻿"
TATWEEL = "ـ"
ARABIC_MARKS = "ًٌٍَُِّْ"
HEBREW_POINTS = "ְֱֲֳִֵֶַָׇֹֺֻּֽֿׁׂ"
# Ligatures.
LIGATURES = {
    "Ĳ": "IJ", "ĳ": "ij", "Ŀ": "L·", "ŀ": "l·", "ŉ": "ʼn", "ſ": "s", "Ǆ": "DŽ", "ǅ": "Dž", "ǆ": "dž",
    "Ǉ": "LJ", "ǈ": "Lj", "ǉ": "lj", "Ǌ": "NJ", "ǋ": "Nj", "ǌ": "nj", "Ǳ": "DZ", "ǲ": "Dz", "ǳ": "dz", "ẛ": "ṡ",
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ﬓ": "մն", "ﬔ": "մե",
    "ﬕ": "մի", "ﬖ": "վն", "ﬗ": "մխ", "שּ": "שּ", "ﭏ": "אל",
}
# Signs and symbols.
SIGNS = {
    "µ": "μ", "ϐ": "β", "ϑ": "θ", "ϒ": "Υ", "ϓ": "Ύ", "ϔ": "Ϋ", "ϕ": "φ", "ϖ": "π", "ϰ": "κ",
    "ϱ": "ρ", "ϲ": "ς", "ϴ": "Θ", "ϵ": "ε", "Ϲ": "Σ", "₨": "Rs", "℃": "°C", "ℇ": "Ɛ", "℉": "°F",
    "№": "No.", "Ω": "Ω", "K": "K", "Å": "Å", "ℵ": "א", "ℶ": "ב", "ℷ": "ג", "ℸ": "ד", "℻": "FAX",
}
# Punctuation.
PUNCT = {
    "«": "“", "»": "”", "‚": "‘", "‛": "‘", "„": "“", "‟": "“", "‹": "‘", "›": "’",
    "−": "-", "∕": "/", "∖": "\\", "∗": "*", "∘": "◦", "∙": "•", "∣": "|", "∶": ":", "≔": ":=", "≕": "=:", "⋅": "·",
}
PUNCT_ARABIC = {"ـ": "", "،": ",", "؍": "/", "؛": ";", "؟": "?", "٪": "%", "٫": ".", "٬": ",", "٭": "*", "۔": "."}
PUNCT_GREEK = {"̀": "̀", "́": "́", "̓": "̓", "ʹ": "ʹ", ";": ";", "·": "·"}
PUNCT_CJK = dict(zip("、。〈〉《》「」『』【】〔〕〖〗〘〙〚〛", ",.<>“”“”“”[][][][][]"))
PUNCT_MISC = {"༌": "་"}
DASHES = dict.fromkeys("‐‑‒–—―−─━⸺⸻", "-")
SPACES = dict.fromkeys("              　", " ")
# Letters by language.
FARSI = {"ي": "ی", "ى": "ی", "ۍ": "ی", "ك": "ک", "ګ": "گ", "ټ": "ت", "ډ": "د", "ړ": "ر", "ڼ": "ن"}
PASHTO = {"ى": "ی", "ۍ": "ی", "ك": "ک"}
ARABIC = {"ک": "ك", "ی": "ي", "ٵ": "أ", "ٶ": "ؤ", "ٸ": "ئ", "ټ": "ت", "ډ": "د", "ړ": "ر", "ګ": "گ", "ڼ": "ن", "ۍ": "ي"}
GEORGIAN_OLD = {"ჱ": "ე", "ჲ": "ი", "ჳ": "ვი", "ჴ": "ხე", "ჵ": "ჰოი"}
# Decimal digits of later Unicode versions, which stay as they are (their zeros).
LATER_ZEROS = (0x11950, 0x11F50, 0x16AC0, 0x1E140, 0x1E2F0, 0x1E4F0)


def span(*ranges: int | tuple[int, int]) -> list[str]:
    """Characters of inclusive ranges."""
    return [chr(c) for r in ranges for c in (range(r[0], r[1] + 1) if isinstance(r, tuple) else (r,))]


def raw(ch: str, tags: tuple[str, ...] | None) -> str | None:
    """One level of decomposition if its tag is wanted ('' for canonical; None for any)."""
    d = ud.decomposition(ch).split()
    tag = d.pop(0)[1:-1] if d and d[0][0] == "<" else ""
    return "".join(chr(int(x, 16)) for x in d) if d and (tags is None or tag in tags) else None


def closed(target: str, *tables: dict[str, str]) -> str:
    """Rewrites a target by the tables, longest match first, until nothing changes."""
    for _ in range(8):
        out, k = "", 0
        while k < len(target):
            for n in (3, 2, 1):
                hit = next((t[target[k : k + n]] for t in tables if target[k : k + n] in t), None)
                if hit is not None:
                    break
            out, k = (out + hit, k + n) if hit is not None else (out + target[k], k + 1)
        if out == target:
            break
        target = out
    return target


@cache
def literal() -> dict[str, str]:
    """The fixed tables that apply everywhere, as one."""
    out: dict[str, str] = dict.fromkeys(ZERO_WIDTH[1:] + TATWEEL + ARABIC_MARKS + HEBREW_POINTS, "")
    for t in (LIGATURES, SIGNS, PUNCT, PUNCT_ARABIC, PUNCT_GREEK, PUNCT_CJK, PUNCT_MISC, DASHES, SPACES):
        out |= t
    return out | {"­": "-"}


@cache
def core() -> dict[str, str]:
    """Roman numerals, compatibility jamo, Thai and Lao vowels, compound punctuation and numbered marks."""
    out = {}
    for ch in span((0x2160, 0x217F), (0x3131, 0x318E), 0x0E33, 0x0EB3, 0x0EDC, 0x0EDD, 0x0F73, (0x0F75, 0x0F79), 0x0F81, 0x2011, (0x2024, 0x2026), (0x2033, 0x203C), (0x2047, 0x2057), 0x2329, 0x232A, (0x2A74, 0x2A76), (0x222C, 0x2230), 0x2A0C, (0x2488, 0x249B), (0x1F100, 0x1F10A)):
        if (d := raw(ch, None)) is not None:
            out[ch] = d
    return {k: closed(v, literal(), {x: y for x, y in out.items() if x != k}) for k, v in out.items()}


def ruled(chars: Iterable[str], tags: tuple[str, ...], form=lambda tag, d, ch: d) -> dict[str, str]:
    out = {}
    for ch in chars:
        for tag in tags:
            if (d := raw(ch, (tag,))) is not None and (t := form(tag, d, ch)) is not None:
                out[ch] = t
    done: dict[str, str] = {}
    for ch, t in out.items():
        for m in ARABIC_MARKS:
            t = t.replace(" " + m, "")
        done[ch] = jamo_joined(closed(t, literal(), core(), {k: v for k, v in out.items() if k != ch}))
    return done


def jamo_joined(s: str) -> str:
    """Composes leading, vowel and trailing jamo to syllables."""
    out = ""
    for ch in s:
        if out and 0x1161 <= ord(ch) <= 0x1175 and 0x1100 <= ord(out[-1]) <= 0x1112 or out and 0x11A8 <= ord(ch) <= 0x11C2 and 0xAC00 <= ord(out[-1]) <= 0xD7A3 and (ord(out[-1]) - 0xAC00) % 28 == 0:
            out = out[:-1] + ud.normalize("NFC", out[-1] + ch)
        else:
            out += ch
    return out


@cache
def presentation() -> dict[str, str]:
    return ruled(span((0xFB50, 0xFDFF), (0xFE70, 0xFEFC)), ("initial", "medial", "final", "isolated"))


@cache
def cjk() -> dict[str, str]:
    t = ruled(span((0x2F00, 0x2FDF), (0x3038, 0x303A), 0x3250, (0x32C0, 0x33FF), (0xF900, 0xFAFF), (0xFF01, 0xFFEE), 0x1F190, 0x1F200, (0x2F800, 0x2FA1F)), ("compat", "square", "wide", "narrow", ""))
    return {k: v.replace("ℓ", "l") for k, v in t.items()}


@cache
def font() -> dict[str, str]:
    return ruled(span((0x2100, 0x214F), 0x309F, 0x30FF, (0xFB20, 0xFB29), (0xFE10, 0xFE6F), (0x1D400, 0x1D7FF), (0x1EE00, 0x1EEBF), (0x1FBF0, 0x1FBF9)), ("font", "small", "vertical"))


@cache
def enclosure() -> dict[str, str]:
    def form(tag: str, d: str, ch: str) -> str | None:
        name = ud.name(ch, "")
        if "TORTOISE" in name:
            return d if d[:1] == "〔" else f"〔{d}〕"
        if tag == "circle":
            return f"({d})"
        if tag == "square":
            return f"[{d}]"
        if "CIRCLED" in name or "PARENTHESIZED" in name:
            return d if d[:1] == "(" else f"({d})"
        return None

    return ruled(span((0x2460, 0x2487), (0x249C, 0x24FF), 0x3036, (0x3200, 0x324F), (0x3251, 0x32BF), (0x32D0, 0x32FE), (0x1F110, 0x1F169), (0x1F201, 0x1F25F)), ("circle", "square", "compat"), form)


@cache
def digits() -> dict[str, str]:
    later = {chr(z + k) for z in LATER_ZEROS for k in range(10)}
    names = tuple(f" DIGIT {n}" for n in "ZERO ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT NINE".split())
    out = {}
    for c in range(0x80, 0x20000):
        ch = chr(c)
        name = ud.name(ch, "")
        if name.endswith(names) and not ud.decomposition(ch) and "SEGMENTED" not in name and ud.digit(ch, None) is not None and ch not in later and not any(x in name for x in ("CIRCLED", "PARENTHESIZED", "ETHIOPIC", "KHAROSHTHI", "RUMI")):
            out[ch] = str(ud.digit(ch))
    return out


@cache
def composing() -> tuple[dict[str, str], dict[str, str]]:
    """(compositions by base and marks, decompositions of characters that are not to be composed)."""
    made, apart = {"եւ": "և"}, {}
    for c in (*range(0xC0, 0x3100), *range(0xFB1D, 0xFB50), *range(0x11000, 0x11600), *range(0x1D100, 0x1D200)):
        ch = chr(c)
        d = raw(ch, ("",))
        if d is None or len(d) < 2 and c != 0x0344:
            continue
        if ud.normalize("NFC", ch) != ch:
            apart[ch] = d
            continue
        made[d] = ch
        full = d
        while (more := raw(full[0], ("",))) is not None and len(more) > 1:
            full = more + full[1:]
            made[full] = ch
    return made, {k: closed(v, apart) for k, v in apart.items()}


@cache
def mojibake() -> dict[str, str]:
    """UTF-8 read as Latin-1 or Windows-1252, and lone C1 controls."""
    irregular = {}
    for b in range(0x80, 0xA0):
        try:
            irregular[chr(b)] = bytes([b]).decode("cp1252")
        except UnicodeDecodeError:
            irregular[chr(b)] = ""
    out = {ch.encode().decode("latin-1"): closed(ch, literal(), core()) for ch in irregular.values() if ch}
    for ch in span((0x80, 0xFF)):
        latin = ch.encode().decode("latin-1")
        for x in {latin, "".join(irregular.get(c) or c for c in latin)}:
            out[x] = "-" if ch == "­" else closed(irregular.get(ch, ch), literal(), core())
    return out | {c: closed(w, literal(), core()) for c, w in irregular.items()}
