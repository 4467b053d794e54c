"""Registered queries of the normalization steps and of presets, and SQL that does the steps anew.

Texts get odd pieces by their id, so that every source of a step's table stands in some text. The SQL uses none of the library's
tables: compatibility characters follow Unicode normalization form KC and the exceptions stated here, the rest patterns. Presets
put the SQL of their steps one after the other; their pieces hold something for each step, so that every gate is open.
"""

from __future__ import annotations

import re
import unicodedata as ud
from collections.abc import Callable, Iterable
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import mappings as M
from glyphmill.functions import register
from glyphmill.operators import bytesafe, lookalike, normalize

#: Sources in a piece.
CHUNK = 32


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def kc(*ranges: int | tuple[int, int], but: dict[str, str] | None = None) -> dict[str, str]:
    """Characters of ranges that form KC changes, and what punctuation of East Asia, dashes and signs among them become."""
    plain = str.maketrans("、。〔〕【】〖〗〈〉《》「」『』—–∕", ",.[][][]<>“”“”“”--/")
    out = {c: n.translate(plain) for c in M.span(*ranges) if (n := ud.normalize("NFKC", c)) != c}
    return out | (but or {})


def enclosed() -> dict[str, str]:
    """Circled in round brackets, squared and in tortoise shells in square ones, where form KC has none."""
    out = {}
    for c, n in kc((0x2460, 0x2487), (0x249C, 0x24FF), 0x3036, (0x3200, 0x324F), (0x3251, 0x32BF), (0x32D0, 0x32FE), (0x1F110, 0x1F169), (0x1F201, 0x1F25F)).items():
        tag = ud.decomposition(c).split(" ")[0]
        out[c] = f"({n})" if tag == "<circle>" else f"[{n}]" if tag == "<square>" else n
    return out | {"〶": "(〒)", "㉐": "PTE", "㋿": "令和"}


def georgian() -> dict[str, str]:
    """Capitals and old small letters become the letter of their name."""
    out = {}
    for c in M.span((0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)):
        if (m := re.fullmatch("GEORGIAN (?:MTAVRULI CAPITAL|CAPITAL|SMALL) LETTER (.*)", ud.name(c, ""))) and m[1] not in ("TURNED GAN", "AIN"):
            out[c] = ud.lookup(f"GEORGIAN LETTER {m[1]}")
    old = {"ჱ": "ე", "ჲ": "ი", "ჳ": "ვი", "ჴ": "ხე", "ჵ": "ჰოი"}
    return {c: old.get(t, t) for c, t in out.items()} | old


def decimal() -> dict[str, str]:
    """Decimal digits that form KC leaves, but for those of later scripts."""
    later = M.span((0x11950, 0x11959), (0x11F50, 0x11F59), (0x16AC0, 0x16AC9), (0x1E140, 0x1E149), (0x1E2F0, 0x1E2F9), (0x1E4F0, 0x1E4F9))
    found = {c: str(ud.decimal(c)) for c in map(chr, range(0x80, 0x20000)) if ud.category(c) == "Nd" and ud.normalize("NFKC", c) == c}
    return {c: t for c, t in found.items() if c not in later} | {"᧚": "1"}


def broken() -> dict[str, str]:
    """UTF-8 read as Latin-1 and as Windows-1252: letters and the euro sign."""
    out = {}
    for c in (*M.span((0xC0, 0xFF)), "€"):
        for second in ("latin-1", "cp1252"):
            key = "".join(bytes([b]).decode(second, "ignore") or chr(b) for b in c.encode())
            if c != "€" or second == "latin-1":
                out[key] = c
    return out


#: Lone bytes of Windows-1252 as they come out, quotes and dashes plain.
LONE = dict(zip("\u0080\u0083\u0086\u0087\u0089\u008a\u008c\u008e\u0091\u0092\u0093\u0094\u0095\u0099\u009a\u009c\u009e\u009f", "€ƒ†‡‰ŠŒŽ‘’“”•™šœžŸ"))
CASE_KEPT = {c: c for c in "℅℆℠℡™"}
PUNCT_COMPAT = (0x2011, (0x2024, 0x2026), (0x2033, 0x203C), (0x2047, 0x2057), 0x2329, 0x232A, (0x2A74, 0x2A76), (0x222C, 0x2230), 0x2A0C, (0x2488, 0x249B), (0x1F100, 0x1F10A))

#: What the SQL of a table's step looks up.
LOOKUPS: dict[str, Callable[[], dict[str, str]]] = {
    "core-compat": lambda: kc((0x2160, 0x217F), (0x3131, 0x318E), 0x0E33, 0x0EB3, 0x0EDC, 0x0EDD),
    "pres-form": lambda: {c: re.sub("[ ـ]*[ً-ْ]", "", n) for c, n in kc((0xFB50, 0xFDFF), (0xFE70, 0xFEFC), but={"ﯝ": "ٷ"}).items()},
    "ligatures": lambda: kc(0x132, 0x133, 0x13F, 0x140, 0x149, 0x17F, (0x1C4, 0x1CC), (0x1F1, 0x1F3), 0x1E9B, (0xFB00, 0xFB06), (0xFB13, 0xFB17), 0xFB49, 0xFB4F),
    "signs-and-symbols": lambda: kc(0xB5, (0x3D0, 0x3D6), 0x3F0, 0x3F1, 0x3F2, 0x3F4, 0x3F5, 0x3F9, 0x20A8, 0x2103, 0x2107, 0x2109, 0x2116, 0x2126, 0x212A, 0x212B, (0x2135, 0x2138), 0x213B, but={"№": "No."}),
    "cjk": lambda: kc((0x2F00, 0x2FDF), (0x3038, 0x303A), 0x3250, (0x32C0, 0x32CF), (0x32FF, 0x33FF), (0xF900, 0xFAFF), 0x1F190, 0x1F200, (0x2F800, 0x2FA1F), but=dict(zip("㍸㍹㎟㎠㎡㎢㎣㎤㎥㎦㎨㎯", "dm² dm³ mm² cm² m² km² mm³ cm³ m³ km³ m/s² rad/s²".split()))),
    "width": lambda: kc((0xFF01, 0xFFEE), but={"￣": "¯"}),
    "font": lambda: kc((0x2102, 0x2149), (0xFB20, 0xFB29), (0x1D400, 0x1D7FF), (0x1EE00, 0x1EEBB), (0x1FBF0, 0x1FBF9), but={"№": "No."} | CASE_KEPT),
    "small": lambda: kc((0xFE50, 0xFE6F)),
    "vertical": lambda: kc(0x309F, 0x30FF, (0xFE10, 0xFE19), (0xFE30, 0xFE48)),
    "enclosure": enclosed,
    "combining-decompose": lambda: {c: ud.normalize("NFD", c) for c in M.span(0x0344, (0x0958, 0x095F), (0x09DC, 0x0B5D), (0x0F43, 0x0FB9), 0x2ADC, (0xFB1D, 0xFB4E), (0x1D100, 0x1D1FF)) if len(ud.normalize("NFC", c)) > 1},
    "digit": decimal,
    "georgian-char": georgian,
}
#: Steps by pattern or by translation: sources, SQL of {t}.
WRITTEN: dict[str, tuple[str, str]] = {
    "del-zero-width": ("­​‌‍‎‏﻿", r"regexp_replace({t}, '[\x{AD}\x{200B}-\x{200F}\x{FEFF}]', '', 'g')"),
    "del-tatweel": ("ـ", "replace({t}, chr(1600), '')"),
    "del-arabic-diacr": ("".join(M.span((0x64B, 0x652))), r"regexp_replace({t}, '[\x{64B}-\x{652}]', '', 'g')"),
    "del-hebrew-diacr": ("".join(M.span((0x5B0, 0x5BD), 0x5BF, 0x5C1, 0x5C2)), r"regexp_replace({t}, '[\x{5B0}-\x{5BD}\x{5BF}\x{5C1}\x{5C2}]', '', 'g')"),
    "punct-arabic": ("ـ،؍؛؟٪٫٬٭۔", "translate({t}, '،؍؛؟٪٫٬٭۔ـ', ',/;?%.,*.')"),
    "punct-cjk": ("、。〈〉《》「」『』【】〔〕〖〗〘〙〚〛", "translate({t}, '、。〈〉《》「」『』【】〔〕〖〗〘〙〚〛', ',.<>“”“”“”[][][][][]')"),
    "punct-greek": ("̀́̓ʹ;·", "translate({t}, chr(832) || chr(833) || chr(835) || chr(884) || chr(894) || chr(903), chr(768) || chr(769) || chr(787) || chr(697) || ';' || chr(183))"),
    "punct-misc-f": ("༌", "replace({t}, chr(3852), chr(3851))"),
    "punct-dash": ("‐‑‒–—―−─━⸺⸻", r"regexp_replace({t}, '[\x{2010}-\x{2015}\x{2212}\x{2500}\x{2501}\x{2E3A}\x{2E3B}]', '-', 'g')"),
    "space": ("".join(M.span(0xA0, (0x2000, 0x200A), 0x202F, 0x205F, 0x3000)), r"regexp_replace({t}, '[\x{A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]', ' ', 'g')"),
    "farsi-char": ("يىۍكګټډړڼ", "translate({t}, 'يىۍكګټډړڼ', 'یییکگتدرن')"),
    "pashto-char": ("ىۍك", "translate({t}, 'ىۍك', 'ییک')"),
    "arabic-char": ("کیٵٶٸټډړګڼۍ", "translate({t}, 'کیٵٶٸټډړګڼۍ', 'كيأؤئتدرگني')"),
}
LANGS = {"farsi-char": "fas", "pashto-char": "pas", "arabic-char": "ara"}
ENTITY = r"amp|apos|gt|lt|nbsp|quot|#\d{1,6}|#x[0-9A-F]{1,5}"
_JAMO, _MARKS = r"[\x{1100}-\x{1112}][\x{1161}-\x{1175}]", r"[\x{300}-\x{36F}]"
#: Vowel signs and nukta of scripts whose pieces are made.
SIGNS_NUKTA = [("93E", "94D", "93C"), ("9BE", "9CD", "9BC"), ("A3E", "A4D", "A3C"), ("ABE", "ACD", "ABC"), ("B3E", "B4D", "B3C"), ("CBE", "CCD", "CBC")]


def _mapped(t: str, by: dict[str, str]) -> str:
    table = ", ".join(f"{q(k)}: {q(v)}" for k, v in by.items())
    return f"array_to_string(list_transform(string_split({t}, ''), lambda c: CASE WHEN ord(c) < 128 THEN c ELSE coalesce(MAP {{{table}}}[c], c) END), '')"


def _replaced(t: str, by: dict[str, str]) -> str:
    for k, v in by.items():
        t = f"replace({t}, {q(k)}, {q(v)})"
    return t


def _joined(t: str, pattern: str, changed: str) -> str:
    """Pieces x by a pattern, changed by an expression, put together again."""
    return f"array_to_string(list_transform(regexp_extract_all({t}, {q(pattern)}), lambda x: {changed}), '')"


def _nuktas(t: str) -> str:
    for first, last, nukta in SIGNS_NUKTA:
        t = rf"regexp_replace(regexp_replace({t}, '([\x{{{first}}}-\x{{{last}}}])(\x{{{nukta}}}+)', '\2\1', 'g'), '(\x{{{nukta}}})\x{{{nukta}}}+', '\1', 'g')"
    return t


_CYRILLIC, _LATIN = "асеһіорхуАВСЕНІКМОРТХУәјѕ", "acehiopxyABCEHIKMOPTXYəjs"


def _look_alike(t: str) -> str:
    """Words of Latin and Cyrillic letters: to the script whose look-alikes the other letters all are, or split."""
    latin, cyrillic = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2AF}", r"\x{400}-\x{52F}"
    count = lambda inside: f"length(regexp_replace(x, '[^{inside}]', '', 'g'))"
    n_lat, n_cyr, to_lat, to_cyr = count(latin), count(cyrillic), count(_CYRILLIC), count(_LATIN)
    as_lat, as_cyr = f"translate(x, '{_CYRILLIC}', '{_LATIN}')", f"translate(x, '{_LATIN}', '{_CYRILLIC}')"
    parted = "x"
    for a, b in ((latin, cyrillic), (cyrillic, latin)):
        parted = rf"regexp_replace({parted}, '([{a}][{a}./_-]+[{a}])([{b}][{b}][^ ])', '\1 \2', 'g')"
    roman = f"length(x) > 1 AND regexp_matches({as_lat}, '^(X{{0,3}}|XL|LX{{0,2}}|XC)(I{{0,3}}|IV|VI{{0,3}}|IX)$')"
    word = f"""CASE WHEN {n_lat} = 0 OR {n_cyr} = 0 THEN x WHEN {to_lat} = {n_cyr} AND {to_cyr} < {n_lat} THEN {as_lat} WHEN {to_cyr} = {n_lat} AND {to_lat} < {n_cyr} THEN {as_cyr}
        WHEN {n_cyr} = 1 AND {to_lat} = 1 AND {n_lat} >= 3 THEN {as_lat} WHEN {n_lat} = 1 AND {to_cyr} = 1 AND {n_cyr} >= 3 THEN {as_cyr}
        WHEN {as_cyr} IN ('әр', 'Әр', 'әрі', 'сі', 'Сі', 'іс', 'Іс', 'ісі', 'ірі') THEN {as_cyr} WHEN {as_lat} IN ('SpA', 'USA') OR {roman} THEN {as_lat} ELSE {parted} END"""
    return _joined(t, r"\s+|\S+", f"CASE WHEN ord(x) < 33 OR NOT regexp_matches(x, '[{cyrillic}]') THEN x ELSE {word} END")


def sql_step(name: str, t: str) -> str:
    """SQL of a step on the text t."""
    if name == "punct":
        quotes = r"translate({t}, '«»‚‛„‟‹›−∕∖∗∘∙∣∶⋅', '“”‘‘““‘’-/\*◦•|:·')".replace("{t}", t)
        return _mapped(quotes, {"≔": ":=", "≕": "=:"} | kc(*PUNCT_COMPAT, but={"‑": "-"}))
    if name in LOOKUPS:
        return _mapped(t, LOOKUPS[name]())
    if name in WRITTEN:
        return WRITTEN[name][1].replace("{t}", t)
    return {
        "repair-encoding-errors": lambda: _replaced(t, broken() | LONE),
        "del-ctrl-char": lambda: rf"regexp_replace(regexp_replace({t}, '[\x01-\x08\x0B\x0C\x0E-\x1F\x7F\x{{80}}-\x{{9F}}]', '', 'g'), '([\x01-\x{{218F}}])[\x{{FE00}}-\x{{FE0F}}]', '\1', 'g')",
        "hangul": lambda: _joined(t, rf"{_JAMO}[\x{{11A8}}-\x{{11C2}}]?|[^\x{{1100}}-\x{{1112}}]+|(?s:.)", f"CASE WHEN regexp_matches(x, '^{_JAMO}') THEN nfc_normalize(x) ELSE x END"),
        "repair-combining": lambda: _nuktas(t),
        "combining-compose": lambda: _joined(t, f"(?s:.){_MARKS}*", "CASE WHEN length(nfc_normalize(x)) < length(x) THEN nfc_normalize(x) ELSE x END"),
        "look-alike": lambda: _look_alike(t),
        "repair-xml": lambda: rf"regexp_replace({t}, '(?i)&(?:amp;)+((?:{ENTITY});)', '&\1', 'g')",
        "repair-url-escapes": lambda: rf"regexp_replace(regexp_replace({t}, '%25([CD][0-9A-F])%25([89AB][0-9A-F])', '%\1%\2', 'g'), '%25(E[0-9A-F])%25([89AB][0-9A-F])%25([89AB][0-9A-F])', '%\1%\2%\3', 'g')",
        "repair-token": lambda: r"regexp_replace(regexp_replace({t}, '([-_+*|%0-9]+)([\x{600}-\x{6FF}])', '\1 \2', 'g'), '([\x{600}-\x{6FF}])([-_+*|%0-9]+)', '\1 \2', 'g')".replace("{t}", t),
    }[name]()


def _chunks(sources: Iterable[str]) -> list[str]:
    s = list(sources)
    return [" " + " ".join(s[k : k + CHUNK]) for k in range(0, len(s), CHUNK)]


def _decomposed() -> list[str]:
    found = [c for c in M.span((0xC0, 0x17F), (0x1CD, 0x1DC), (0x1E00, 0x1E99), (0x1EA0, 0x1EF9), (0x386, 0x3CE), (0x400, 0x45F)) if ud.normalize("NFC", c) == c and len(ud.normalize("NFD", c)) > 1]
    return _chunks(ud.normalize("NFD", c) for c in found)


def pieces_of(name: str) -> list[str]:
    """What texts get, by id, to try a step."""
    if name == "punct":
        return [f"{x} …" for x in _chunks("«»‚‛„‟‹›−∕∖∗∘∙∣∶⋅≔≕") + _chunks(kc(*PUNCT_COMPAT))]
    if name == "vertical":  # its gate asks for a character of the font table
        return _chunks([*LOOKUPS[name]()])
    if name in LOOKUPS:
        return _chunks(LOOKUPS[name]())
    if name in WRITTEN:
        return [" x" + "x".join(WRITTEN[name][0]) + "x"]
    return {
        "repair-encoding-errors": lambda: _chunks([*broken(), *LONE]),
        "del-ctrl-char": lambda: [f" a{c}b{v}c" for c, v in zip(M.span((1, 8), 11, 12, (14, 31), (0x7F, 0x9F)), 5 * M.span((0xFE00, 0xFE0F)))],
        "hangul": lambda: _chunks("".join(x) for x in product(M.span((0x1100, 0x1112)), "ᅡᅩᅵ", ["", "ᆨ", "ᇂ"])),
        "repair-combining": lambda: [" x" + chr(int(f, 16)) + n * chr(int(k, 16)) + " " + chr(int(e, 16)) + chr(int(k, 16)) for f, e, k in SIGNS_NUKTA for n in (1, 2, 3)],
        "combining-compose": _decomposed,
        "look-alike": lambda: [f" {w}" for w in "Austіn жəне CTVтелеарнасына XІ wоrd кoд Мoscow приeм ok ок".split()],
        "repair-xml": lambda: [f" &{'amp;' * k}{e}; &{'AMP;' * k}x;" for k in range(3) for e in "amp apos gt lt nbsp quot #39 #x2F zzz".split()],
        "repair-url-escapes": lambda: [" " + "".join(f"%25{b:02X}" for b in c.encode()) for c in "éßØ€अ한xй"],
        "repair-token": lambda: [f" {a}{b}{a}" for a in ("12", "-", "%|", "x") for b in "بج"],
    }[name]()


def pieced(spark: SparkSession, sf_dir: str, pieces: list[str]) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    piece = F.element_at(F.array(*map(F.lit, pieces)), (F.col("doc_id") % len(pieces) + 1).cast("int"))
    return docs.select("doc_id", F.concat("text", piece).alias("text"))


def _query(steps: frozenset[str], lang: str, pieces: Callable[[], list[str]]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: pieced(spark, sf_dir, pieces()).select("doc_id", normalize.normalize(F.col("text"), steps, lang).alias("normalized"))


def start(pieces: list[str]) -> str:
    return f"SELECT doc_id, text || list_extract([{', '.join(map(q, pieces))}], (doc_id % {len(pieces)} + 1)::INT) AS t FROM documents"


def _runs(steps: frozenset[str], lang: str) -> list[str]:
    """Names of the steps that run, in order."""
    other = {"farsi-char": lang == "fas", "pashto-char": lang == "pas", "arabic-char": lang not in ("fas", "pas")}
    return [n for n in normalize.NAMES if (n in steps or n in normalize.ALWAYS) and other.get(n, True)]


def sql_chain(steps: frozenset[str], lang: str, pieces: list[str]) -> str:
    """SQL of the steps, each on what the one before has made."""
    with_ = [f"s0 AS ({start(pieces)})"]
    for k, name in enumerate(_runs(steps, lang)):
        with_.append(f"s{k + 1} AS MATERIALIZED (SELECT doc_id, {sql_step(name, 't')} AS t FROM s{k})")
    return f"WITH {', '.join(with_)} SELECT doc_id, regexp_replace(t, ' +(\\t|\\n|$)', '\\1', 'g') AS normalized FROM s{len(with_) - 1}"


def unmapped_pieces() -> list[str]:
    """The same, each with a mixed word that no rule maps or splits."""
    words = "aжz qщw Жbщz fдgл aжz".split()
    return [f"{p} {words[k % len(words)]}" for k, p in enumerate(mixed_pieces())]


def _logged_sql(run: list[str], pieces: list[str]) -> list[str]:
    """Tables s0 ... of the lines after each step: line_no, o (the line), t (now), c (whether each step changed it)."""
    lines = f"SELECT doc_id * 1000000 + i AS line_no, parts[i] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(t, chr(10)) AS parts FROM ({start(pieces)})))"
    with_ = [f"s0 AS (SELECT line_no, line AS o, line AS t, []::BOOLEAN[] AS c FROM ({lines}))"]
    for k, name in enumerate(run):
        with_.append(f"s{k + 1} AS MATERIALIZED (SELECT line_no, o, n AS t, list_append(c, n <> t) AS c FROM (SELECT line_no, o, t, c, {sql_step(name, 't')} AS n FROM s{k}))")
    return with_


def sql_first_lines(steps: frozenset[str], lang: str, k: int = 20) -> str:
    """SQL of the first lines that each step changes."""
    run = _runs(steps, lang)
    rows = " UNION ALL ".join(f"SELECT '{name}' AS step, line_no FROM s{len(run)} WHERE c[{n + 1}]" for n, name in enumerate(run))
    return f"WITH {', '.join(_logged_sql(run, mixed_pieces()))} SELECT step, string_agg(line_no, ',' ORDER BY line_no) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY line_no) AS r FROM ({rows})) WHERE r <= {k} GROUP BY step"


def sql_unchanged_words(steps: frozenset[str], lang: str, k: int = 100) -> str:
    """SQL of the words of Latin and Cyrillic letters that the look-alike step leaves; it takes those of Latin and Greek as Latin."""
    run = _runs(steps, lang)
    at = run.index("look-alike")

    def mixed(c: str) -> str:
        has = {x: f"regexp_matches({c}, '[{v}]')" for x, v in lookalike.SCRIPTS.items()}
        return " OR ".join(f"({has[x]} AND {has[y]})" for x, y in (("Latin", "Greek"), ("Latin", "Cyrillic"), ("Greek", "Cyrillic")))

    return f"WITH {', '.join(_logged_sql(run[:at], unmapped_pieces()))} SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(t, '[^\\t-\\r ]+')) AS word FROM s{at} WHERE {mixed('o')}) WHERE regexp_matches(word, '[{lookalike.SCRIPTS['Latin']}]') AND regexp_matches(word, '[{lookalike.SCRIPTS['Cyrillic']}]') AND {sql_step('look-alike', 'word')} = word GROUP BY word ORDER BY n DESC, word LIMIT {k}"


def sql_changed(steps: frozenset[str], lang: str) -> str:
    """SQL of the lines that each step changes, and of all that change."""
    run = _runs(steps, lang)
    with_ = _logged_sql(run, mixed_pieces())
    rows = [f"SELECT 'all' AS step, count(*) FILTER (o <> t) AS n_changed FROM s{len(run)}"]
    for name in normalize.NAMES:
        if name in run:
            rows.append(f"SELECT '{name}', count(*) FILTER (c[{run.index(name) + 1}]) FROM s{len(run)}")
        elif name in steps:
            rows.append(f"SELECT '{name}', 0")
    return f"WITH {', '.join(with_)} {' UNION ALL '.join(rows)}"


#: Queries of single steps, in order of application.
STEPS = [n for n in normalize.NAMES if n in LOOKUPS or n in WRITTEN or n not in LANGS]
PRESETS: dict[str, tuple[frozenset[str], str]] = {
    "norm_default": (normalize.DEFAULT, ""),
    "norm_all": (normalize.chosen("all"), ""),
    "norm_lang_fas": (normalize.chosen("default", add=["farsi-char"]), "fas"),
    "norm_lang_pas": (normalize.chosen("default", add=["pashto-char"]), "pas"),
    "norm_add_skip": (normalize.chosen("default", add=["space", "digit"], skip=["del-tatweel"]), ""),
    "norm_only": (normalize.chosen("none", add=["space"]), ""),
}


def mixed_pieces() -> list[str]:
    """Each with a short piece of every step."""
    found = [pieces_of(n) for n in STEPS]
    return ["".join(" " + " ".join(p[k % len(p)].split(" ")[:9]) for p in found) for k in range(16)]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _name in STEPS:
    _key, _lang = "norm_" + _name.replace("-", "_"), LANGS.get(_name, "")
    QUERIES[_key] = _query(frozenset({_name}), _lang, lambda n=_name: pieces_of(n))
    ORACLE_SQL[_key] = sql_chain(frozenset({_name}), _lang, pieces_of(_name))
for _key, (_steps, _lang) in PRESETS.items():
    QUERIES[_key] = _query(_steps, _lang, mixed_pieces)
    ORACLE_SQL[_key] = sql_chain(_steps, _lang, mixed_pieces())


def by_function(name: str, pieces: Callable[[], list[str]]) -> Callable[[SparkSession, str], DataFrame]:
    """A step or preset through its SQL function."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        (made,) = register.register(spark, [name])
        return pieced(spark, sf_dir, pieces()).selectExpr("doc_id", f"{made}(text) AS normalized")

    return query


for _name in ("default", "space", "digit", "hangul"):
    _key = f"sql_function_{_name}"
    QUERIES[_key] = by_function(_name, mixed_pieces if _name == "default" else lambda n=_name: pieces_of(n))
    ORACLE_SQL[_key] = ORACLE_SQL[f"norm_{_name}"]


def del_surrogate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts as bytes with ill-formed ones before, amid and after them, read without these."""
    half = F.expr("length(text) div 2")
    raw = F.concat(F.unhex(F.lit("80")), F.encode(F.substring("text", F.lit(1), half), "UTF-8"), F.unhex(F.lit("E282")), F.encode(F.substring("text", half + 1, F.length("text")), "UTF-8"), F.unhex(F.lit("C3FF")))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", bytesafe.text_of(raw, repair=False).alias("normalized"))


# Pairs of hexadecimal digits: well-formed sequences stay, any other byte goes.
_TAIL = "[89AB][0-9A-F]"
_WELL = f"[0-7][0-9A-F]|(?:C[2-9A-F]|D[0-9A-F]){_TAIL}|E0[AB][0-9A-F]{_TAIL}|(?:E[1-9A-CEF]{_TAIL}|ED[89][0-9A-F]){_TAIL}|(?:F0[9AB][0-9A-F]|F[1-3]{_TAIL}|F48[0-9A-F]){_TAIL}{_TAIL}"
QUERIES["norm_del_surrogate"] = del_surrogate
ORACLE_SQL["norm_del_surrogate"] = f"SELECT doc_id, decode(unhex(regexp_replace('80' || hex(encode(substr(text, 1, length(text) // 2))) || 'E282' || hex(encode(substr(text, length(text) // 2 + 1))) || 'C3FF', '({_WELL})|..', '\\1', 'g'))) AS normalized FROM documents"
