"""Unicode blocks of characters as the analysis groups them, and the scripts these blocks belong to."""

from __future__ import annotations

import re
import unicodedata as ud

# Characters grouped apart from their Unicode block.
GROUPS: dict[str, str] = {
    "SUPERSCRIPT_DIGIT": "⁰¹²³⁴⁵⁶⁷⁸⁹",
    "SUBSCRIPT_DIGIT": "₀₁₂₃₄₅₆₇₈₉",
    "SUPERSCRIPTS_AND_SUBSCRIPTS": "ªº",
    "SPACE": "\u0020\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f",
    "ZERO_WIDTH": "\u00ad\u200b\u200c\u200d\ufeff",
    "DIRECTIONAL": "\u200e\u200f",
    "CURRENCY_SYMBOLS": "$¢£¤¥",
    "LATIN": "ʌɓɗɖɛəɡɠɨᵻɟᴋɫɲⁿɔɵᵽɹʃʉʋʊʒɣɩʔ",
    "LATIN_SUPERSCRIPT_LETTER": "ᵉⁱᵏᵘ",
    "CYRILLIC": "ᵸ",
    "CJK": "々",
    "REPLACEMENT": "\ufffd",
    "ARCHAIC_CLAUDIAN_LETTER": "ↄ",
    "LETTERLIKE_SYMBOLS": "µ",
}
# Groups that are ranges of code points, first and last.
RANGES: list[tuple[str, int, int]] = [
    ("C0_CONTROL", 0x00, 0x1F),
    ("ASCII_DIGIT", 0x30, 0x39),
    ("C0_CONTROL", 0x7F, 0x7F),
    ("C1_CONTROL", 0x80, 0x9F),
    ("VULGAR_FRACTION", 0xBC, 0xBE),
    ("ARABIC_INDIC_DIGIT", 0x660, 0x669),
    ("EXTENDED_ARABIC_INDIC_DIGIT", 0x6F0, 0x6F9),
    ("GEORGIAN", 0x1C90, 0x1CBF),
    ("LATIN_SUBSCRIPT_LETTER", 0x1D62, 0x1D65),
    ("VULGAR_FRACTION", 0x2150, 0x215F),
    ("ROMAN_NUMERAL", 0x2160, 0x217F),
    ("ARCHAIC_ROMAN_NUMERAL", 0x2180, 0x2188),
    ("VULGAR_FRACTION", 0x2189, 0x2189),
    ("TURNED_DIGIT", 0x218A, 0x218B),
    ("GEORGIAN", 0x2D00, 0x2D2F),
    ("LATIN_ALPHABETIC_PRESENTATION_FORMS", 0xFB00, 0xFB0F),
    ("ARMENIAN_ALPHABETIC_PRESENTATION_FORMS", 0xFB10, 0xFB1F),
    ("HEBREW_ALPHABETIC_PRESENTATION_FORMS", 0xFB20, 0xFB4E),
    ("FULLWIDTH_DIGIT", 0xFF10, 0xFF19),
    ("FULLWIDTH_LATIN", 0xFF21, 0xFF3A),
    ("FULLWIDTH_LATIN", 0xFF41, 0xFF5A),
    ("OTHER", 0x1EE00, 0x1EEFF),
]
SINGLE = {c: name for name, chars in GROUPS.items() for c in chars}
BEFORE = re.compile(r"^(?:BASIC|SUPPLEMENTAL)_")
AFTER = re.compile(r"_(?:SUPPLEMENTARY|ADDITIONAL|SUPPLEMENT|EXTENDED(?:_LETTER)?|EXTENSION|(?:ALPHABETIC_)?PRESENTATION_FORMS)(?:_[A-Z])?$")
MERGED = {"CJK_UNIFIED_IDEOGRAPHS": "CJK", "CJK_COMPATIBILITY_IDEOGRAPHS": "CJK", "ENCLOSED_ALPHANUMERIC": "ENCLOSED_ALPHANUMERICS"}
#: Letters of these blocks count as other characters.
NO_LETTERS = ("SPACING_MODIFIER_LETTERS", "MODIFIER_TONE_LETTERS")


def block_of(ch: str, block: str) -> str:
    """The group of a character that lies in this Unicode block."""
    cp, category = ord(ch), ud.category(ch)
    if ch in SINGLE:
        return SINGLE[ch]
    for name, first, last in RANGES:
        if first <= cp <= last:
            return name
    if cp < 0x100 and category[0] in "PS":
        return "ASCII_PUNCTUATION" if cp < 0x80 else "GENERAL_PUNCTUATION"
    if block == "LATIN_1_SUPPLEMENT" and category[0] == "L":
        return "LATIN_EXTENDED_LETTER"
    return block


def script_of(block: str) -> str:
    """The block's name without what marks it as an addition to another."""
    script = BEFORE.sub("", block)
    while (shorter := AFTER.sub("", script)) != script:
        script = shorter
    return MERGED.get(script, script)


def kind_of(ch: str, block: str) -> tuple[str, str]:
    """letter, number or other, and the script that the character counts for."""
    category, script = ud.category(ch)[0], script_of(block)
    if category == "L" and block not in NO_LETTERS:
        return "letter", script
    if category == "N":
        return "number", script
    if category == "M" and not any(w in script for w in ("MODIFIER", "MARK", "SELECTOR")):
        return "other", f"{script}_MODIFIERS"
    if category == "P" and "PUNCT" not in script:
        return "other", f"{script}_PUNCTUATION"
    return "other", script
