"""The analysis of numbered lines with examples: sections as tables, as one nested document, as the report to read.

An example is a text and the number of its line; each row has the first few, in order of line and place. Which lines can give
examples is settled by a ranking that the engine limits before the shuffle; only these are searched. What goes to the driver
to be written is bounded: `cases` rows a group, `k` examples a row.
"""

from __future__ import annotations

import json
import re
import unicodedata as ud
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphmill.functions import masks
from glyphmill.operators import analyze, lonebytes, report, scripts

# Blocks that are shown first, in this order; others follow by their first character.
BLOCK_ORDER = """LOW_SURROGATES REPLACEMENT C0_CONTROL C1_CONTROL ZERO_WIDTH DIRECTIONAL VARIATION_SELECTORS VARIATION_SELECTORS_SUPPLEMENT
    ASCII_PUNCTUATION GENERAL_PUNCTUATION CURRENCY_SYMBOLS SPACE ASCII_DIGIT FULLWIDTH_DIGIT VULGAR_FRACTION ROMAN_NUMERAL
    ARABIC_INDIC_DIGIT EXTENDED_ARABIC_INDIC_DIGIT NUMBER_FORMS SUPERSCRIPT_DIGIT SUBSCRIPT_DIGIT SUPERSCRIPTS_AND_SUBSCRIPTS
    COMBINING_DIACRITICAL_MARKS BASIC_LATIN LATIN_EXTENDED_LETTER LATIN_EXTENDED_A LATIN_EXTENDED_B LATIN_EXTENDED_C LATIN_EXTENDED_D
    LATIN_ALPHABETIC_PRESENTATION_FORMS LATIN IPA_EXTENSIONS LETTERLIKE_SYMBOLS FULLWIDTH_LATIN CYRILLIC ARMENIAN
    ARMENIAN_ALPHABETIC_PRESENTATION_FORMS GREEK GREEK_EXTENDED ARABIC ARABIC_PRESENTATION_FORMS_A ARABIC_PRESENTATION_FORMS_B HEBREW
    HEBREW_ALPHABETIC_PRESENTATION_FORMS HEBREW_PRESENTATION_FORMS""".split()
# Groups whose characters can't be seen.
UNSEEN = ("C0_CONTROL", "C1_CONTROL", "SPACE", "ZERO_WIDTH", "DIRECTIONAL", "VARIATION_SELECTORS", "LOW_SURROGATES")
#: Goes before what holds letters that run from right to left.
LEFT_TO_RIGHT = "‎"
RIGHT_TO_LEFT = re.compile("[\u0590-\u07bf\u0860-\u08ff\ufb1d-\ufdff\ufe70-\ufefc\U0001ee00-\U0001eeff]")
EXAMPLE = "array<struct<text: string, line_no: bigint>>"


def first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """by, ex: the first k different (text, line_no) of found(by, text, line_no, pos)."""
    different = found.groupBy(*by, "text", "line_no").agg(F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("line_no", "pos", "text"))
    kept = different.withColumn("r", rank).where(F.col("r") <= k)
    ex = F.transform(F.array_sort(F.collect_list(F.struct("r", "text", F.col("line_no").cast("long").alias("line_no")))), lambda x: F.struct(x["text"].alias("text"), x["line_no"].alias("line_no")))
    return kept.groupBy(*by).agg(ex.alias("ex"))


def characters(lines: DataFrame, k: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """block, ch, code_point, name, n, ex: of a letter or mark the run of letters around it, of a number the run of numbers, else
    the character itself."""
    counts = analyze.char_counts(lines, by=by)
    different = counts.groupBy("ch").agg(F.sum("n").alias("n"))
    # each of a character's first k lines gives at least one example
    near = analyze.first_holding(lines, k, "line_no", by=by)
    run = r"(?:\p{L}\p{M}*|\x{FFFD})*"
    around = F.concat(F.lit(run + r"\p{M}*"), F.col("ch"), F.lit(r"\p{M}*" + run))
    number = F.concat(F.lit(r"\p{N}*"), F.col("ch"), F.lit(r"\p{N}*"))
    texts = F.when(F.col("ch").rlike(r"[\p{L}\p{M}\x{FFFD}]"), F.regexp_extract_all("text", around, F.lit(0))).when(F.col("ch").rlike(r"\p{N}"), F.regexp_extract_all("text", number, F.lit(0))).otherwise(F.array("ch"))
    found = near.join(lines.select(*by, "line_no", "text"), [*by, "line_no"]).select(*by, "ch", "line_no", F.posexplode(texts).alias("pos", "text"))
    dim = analyze.char_dim(different).select("ch", "code_point", "name")
    blocks = scripts.described(different).select("block", "ch").join(dim, "ch")
    return counts.join(blocks, "ch").join(first(found, [*by, "ch"], k), [*by, "ch"]).select(*by, "block", "ch", "code_point", "name", "n", "ex")


def notable(lines: DataFrame, k: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """heading, token, n, ex of escapes and of words of several scripts."""
    kinds = report.notable(lines, by=by)
    none = F.array().cast("array<string>")
    tokens = analyze.exploded(lines, F.concat(F.coalesce(report.escapes(F.col("text")), none), F.coalesce(report.words_beyond(F.col("text")), none)), "token", *by, "line_no")
    found = tokens.join(kinds.select(*by, "token"), [*by, "token"], "left_semi").select(*by, "token", F.col("token").alias("text"), "line_no", F.lit(0).alias("pos"))
    return kinds.join(first(found, [*by, "token"], k), [*by, "token"]).select(*by, "heading", "token", "n", "ex")


def patterns(lines: DataFrame, k: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """pattern, n, ex, first (place of its first token) of tokens with a character of interest or an orphan mark."""
    # outer: an inner one has a filter that finds the tokens again
    tokens = lines.select(*by, "line_no", F.posexplode_outer(F.regexp_extract_all("text", F.lit(r"(?U)\S+"), F.lit(0))).alias("pos", "text"))
    kept = tokens.where("text is not null").where(report.of_interest(F.col("text")))
    both = lambda p: F.array_distinct(F.array(p, F.regexp_replace(p, "(?:Word)+ـ+(?:Word)+", "Word")))
    found = kept.select(*by, "line_no", "pos", "text", F.explode_outer(masks.let(report.pattern_of(F.col("text")), both)).alias("pattern"))
    counts = found.groupBy(*by, "pattern").agg(F.count("*").alias("n"), F.min(F.struct("line_no", "pos")).alias("first"))
    return counts.join(first(found, [*by, "pattern"], k), [*by, "pattern"])


def grouped_patterns(lines: DataFrame, k: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """heading, pattern, n, ex, first."""
    marks = F.array(*[F.struct(F.lit(c).alias("ch"), F.lit(f"TOKENS WITH {c} (U+{ord(c):04X} {analyze.name_of(c)})").alias("heading")) for c in dict.fromkeys(report.OF_INTEREST)])
    held = F.transform(F.filter(marks, lambda m: F.contains(F.col("pattern"), m["ch"])), lambda m: m["heading"])
    orphan = F.when(F.contains(F.col("pattern"), F.lit("Modifier")), F.array(F.lit("TOKENS WITH ORPHAN MODIFIER"))).otherwise(F.array().cast("array<string>"))
    return patterns(lines, k, by).select(*by, F.explode(F.concat(held, orphan)).alias("heading"), "pattern", "n", "ex", "first")


def sections(lines: DataFrame, k: int = 5, by: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Section to table, of lines (line_no, text; as they were read, unstripped; with raw, their bytes, ill-formed ones are characters
    of a block too), of all or by columns; nothing runs until one is read."""
    block = lambda found: found.unionByName(lonebytes.table(lines, k, by)) if "raw" in lines.columns else found
    # most lines neither begin nor end with white space
    ends = F.concat(F.substring("text", 1, 1), F.substring("text", -1, 1)).rlike(r"(?U)[\s\x{1C}-\x{1F}]")
    bare = F.when(ends, F.regexp_replace("text", r"^(?U)[\s\x{1C}-\x{1F}]+|(?U)[\s\x{1C}-\x{1F}]+$", "")).otherwise(F.col("text"))
    inner = lines.select(*by, "line_no", bare.alias("text")).where("text <> '<range>'")
    return {
        "overview": analyze.overview(lines, by=by),
        "script": scripts.script_rows(inner, by=by),
        "non-canonical": report.non_canonical(inner, by=by),
        "char-conflict": analyze.char_conflicts(inner, by=by),
        "notable-token": notable(inner, k, by),
        "pattern": grouped_patterns(inner, k, by),
        "block": block(characters(inner, k, by)),
    }


def _capped(t: DataFrame, group: str, order: list[Column], cases: int | None) -> list:
    if cases is None:
        return t.collect()
    return t.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= cases + 1).drop("_r").collect()


def nested(lines: DataFrame, k: int = 5, cases: int | None = None, final_newline: bool = True) -> dict:
    """The whole analysis as one document; of each group at most cases + 1 entries if cases is given."""
    s = sections(lines, k)
    size = s["overview"].first()
    out: dict = {"n_lines": size.n_lines, "n_characters": size.n_characters - (not final_newline)}
    rows = s["script"].collect()
    for kind in ("letter", "number", "other"):
        mine = sorted((r for r in rows if r.kind == kind), key=lambda r: (-r.n, r.first_char))
        out[f"{kind}-script"] = {r.script: {"count": r.n} | ({} if r.ex is None else {"ex": r.ex}) for r in mine}
    found = sorted(s["non-canonical"].collect(), key=lambda r: r.orig)
    clause = lambda f: f"{f}, " if f else ""
    out["non-canonical"] = {r.orig: {"orig": r.orig, "norm": r.norm, "orig-count": r.orig_count, "norm-count": r.norm_count, "orig-form": clause(r.orig_form), "norm-form": clause(r.norm_form), "changes": list(r.changes)} for r in found}
    pairs = {"kaf": "كک", "yeh": "يی"}
    of = {(r.key, r.ch): r.n for r in s["char-conflict"].collect()}
    out["char-conflict"] = {"/".join(chars): [{"char": c, "id": f"U+{ord(c):04X}", "name": analyze.name_of(c), "count": of[key, c]} for c in chars] for key, chars in pairs.items() if (key, chars[0]) in of}
    ex = lambda r: [[x.text, x.line_no] for x in r.ex]
    out["notable-token"] = defaultdict(dict)
    for r in sorted(_capped(s["notable-token"], "heading", [F.col("token")], cases), key=lambda r: r.token):
        out["notable-token"][r.heading][r.token] = {"token": r.token, "count": r.n, "ex": ex(r)}
    out["pattern"] = defaultdict(dict)
    for r in sorted(_capped(s["pattern"], "heading", [F.desc("n"), F.col("first")], cases), key=lambda r: tuple(r.first)):
        out["pattern"][r.heading][r.pattern] = {"pattern": visible(r.pattern), "count": r.n, "ex": ex(r)}
    blocks: dict = defaultdict(dict)
    for r in sorted(_capped(s["block"], "block", [F.col("ch")], cases), key=lambda r: r.ch):
        blocks[r.block][r.ch] = {"char": r.ch, "id": r.code_point, "name": r.name, "count": r.n, "ex": ex(r)}
    place = {b: n for n, b in enumerate(BLOCK_ORDER)}
    out["block"] = {b: blocks[b] for b in sorted(blocks, key=lambda b: (place.get(b, len(place)), min(blocks[b])))}
    return out | {"notable-token": dict(out["notable-token"]), "pattern": dict(out["pattern"])}


def as_document(lines: DataFrame, **options) -> str:
    """The nested document as JSON, on one line."""
    return json.dumps(nested(lines, **options))


def visible(s: str) -> str:
    """Controls, separators and marks by their code points."""
    return "".join(f"<U+{ord(c):04X}>" if ud.category(c)[0] in "CZM" else c for c in s)


def spaced(s: str) -> str:
    """A blank before each mark."""
    return "".join(f" {c}" if ud.category(c)[0] == "M" else c for c in s)


def plural(n: int, noun: str) -> str:
    return f"{n} {noun if n == 1 else noun[:-1] + 'ies' if noun.endswith('y') else noun + 's'}"


def examples(ex: list, own: str, refs: dict[int, str] | None = None) -> str:
    """Examples by text, with their lines or the ids of these; lines alone if the only text is the row's own."""
    lines: dict[str, list[str]] = defaultdict(list)
    named = False
    for text, n in ex:
        ref = refs.get(n) if refs else None
        named |= bool(ref)
        where = (str(n), ref or f"l.{n}")
        if where not in lines[text]:
            lines[text].append(where)
    if list(lines) == [own] and not named:
        return f"line{'s' if len(lines[own]) > 1 else ''}: {', '.join(n for n, _ in lines[own])}"
    shown = [f"{text} ({', '.join(r for _, r in at)})" if named else f"{text} (l.{', '.join(n for n, _ in at)})" for text, at in lines.items()]
    return f"example{'s' if len(shown) > 1 else ''}: {', '.join(shown)}"


def written(doc: dict, cases: int = 100, refs: dict[int, str] | None = None) -> str:
    """The report of a nested document."""
    out: list[str] = []

    def row(text: str) -> None:
        out.append(f"{LEFT_TO_RIGHT if any(ud.category(c)[0] == 'L' for c in RIGHT_TO_LEFT.findall(text)) else ''}    {text}")

    def listed(rows: list[str]) -> None:
        for text in rows[:cases]:
            row(text)
        if len(rows) > cases:
            out.append("    ...")

    out += ["OVERVIEW:", f"File size: {plural(doc['n_lines'], 'line')}, {plural(doc['n_characters'], 'character')}"]
    for title, key in (("Letter scripts", "letter-script"), ("Number scripts", "number-script"), ("Other character groups", "other-script")):
        out.append(f"{title}: {len(doc[key])}")
        for script, d in doc[key].items():
            shown = f": {spaced(d['ex'])}" if d.get("ex") and script not in UNSEEN else ""
            out.append(f"    {script} ({plural(d['count'], 'instance')}){shown}")
    odd, conflicts = doc["non-canonical"], doc["char-conflict"]
    out += [f"Non-canonical character combinations: {len(odd)}"] * bool(odd) + [f"Character conflict sets: {len(conflicts)}"] * bool(conflicts)
    kinds: dict[str, list[int]] = {}
    for heading in sorted(doc["notable-token"]):
        group = doc["notable-token"][heading]
        total = kinds.setdefault("XML escape tokens" if "XML" in heading else "Words with characters from multiple scripts", [0, 0, 0])
        for j, n in enumerate((1, len(group), sum(d["count"] for d in group.values()))):
            total[j] += n
    out += [f"{kind}: {plural(a, 'category')}, {plural(b, 'unique type')}, {plural(c, 'instance')}" for kind, (a, b, c) in kinds.items()]
    out += ["", "DETAILS:", f"Non-canonical character combinations: {len(odd)}"]
    for d in odd.values():
        forms = [f"{what}: {d[x]} ({d[f'{x}-form']}{' + '.join(d[x])}, count: {d[f'{x}-count']})" for what, x in (("Non-canonical", "orig"), ("Canonical", "norm"))]
        row("  ".join(forms) + ("" if d["norm-form"] or not d["changes"] else f"  Changes: {', '.join(d['changes'])}"))
    out.append(f"Character conflict sets: {len(conflicts)}")
    for chars in conflicts.values():
        row("; ".join(f"{d['char']} {d['id']} ({d['name']}) count: {d['count']}" for d in chars))
    if n := doc["block"].get("ARABIC", {}).get("ـ", {}).get("count"):
        out.append(f"Number of Arabic tatweel characters: {n}")
    for heading in sorted(doc["notable-token"]):
        out.append(f"{heading}:")
        listed([f"{d['token']} count: {d['count']}, {examples(d['ex'], t, refs)}" for t, d in doc["notable-token"][heading].items()])
    for block, chars in doc["block"].items():
        out.append(f"{block} characters:")
        listed([f"{spaced(d['char'])} {d['id']} {d['name']} count: {d['count']}, {examples(d['ex'], c, refs)}{singleton(c)}" for c, d in chars.items()])
    for heading in sorted(doc["pattern"]):
        out.append(f"{heading}:")
        listed([f"{d['pattern']} count: {d['count']}, {examples(d['ex'], p, refs)}" for p, d in sorted(doc["pattern"][heading].items(), key=lambda x: -x[1]["count"])])
    return "\n".join(out) + "\n"


def singleton(ch: str) -> str:
    """A note of the one character that ch is canonically the same as."""
    d = ud.decomposition(ch)
    return f", decomposition: {chr(int(d, 16))} ({analyze.name_of(chr(int(d, 16)))})" if re.fullmatch("[0-9A-F]{4,}", d) else ""


# What a heading or script is flagged as in the line of issues.
FLAGGED = [("^XML ESCAPE", "XML escape token"), ("^REPLACEMENT", "Replacement character"), ("ORPHAN.?MODIFIER", "Orphan modifier"), ("VARIATION.?SELECTOR", "Variation selector"), ("IPA.?EXTENSION", "IPA character"), ("WORDS.?WITH.?CHARACTERS.?FROM.?MULTIPLE.?SCRIPTS", "multi-script word"), ("PRIVATE.?USE", "Private use character"), ("SURROGATES", "Surrogate")]


def line_of_issues(doc: dict) -> str:
    """The one line of a nested document."""
    out = []
    for kind in ("letter", "number"):
        found = doc[f"{kind}-script"]
        if len(found) >= 2 and not (kind == "number" and list(found) == ["ASCII_DIGIT", "VULGAR_FRACTION"]):
            shown = [f"{s} ({spaced(d['ex']) if kind == 'letter' else d['ex']})" if d.get("ex") and len(d["ex"]) < 10 else s for s, d in found.items()]
            out.append(f"{plural(len(found), f'{kind} script')}: {', '.join(shown)}")
    out += [c for c in ("C0_CONTROL", "C1_CONTROL") if c in doc["other-script"]]
    if odd := doc["non-canonical"]:
        out.append(f"{plural(len(odd), 'non-canonical character combination')} ({plural(sum(d['orig-count'] for d in odd.values()), 'instance')})")
    if doc["char-conflict"]:
        out.append(plural(len(doc["char-conflict"]), "character set conflict"))
    flags: dict[str, None] = {}
    for key in sorted([*doc["notable-token"], *doc["pattern"], *doc["letter-script"], *doc["other-script"]]):
        flags |= {name: None for pattern, name in FLAGGED if re.search(pattern, key)}
    return "; ".join([*out, *flags, *(["Tatweel"] if "ـ" in doc["block"].get("ARABIC", {}) else [])])

