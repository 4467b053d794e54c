"""Analysis beyond counts: token patterns, non-canonical forms, grouped escapes and mixed words, character examples, summaries.

Tokens are counted first and classified after, so that every costly expression runs once per distinct token. Examples are the
first few by id and place, kept by a ranking that the engine limits before the shuffle.
"""

from __future__ import annotations

import unicodedata as ud
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import blocks
from glyphmill.operators import analyze, normalize

# Characters whose tokens are reported by pattern.
OF_INTEREST = "-‐‑−‒–—―+~*_.,:;!¡?/§'‘’ʼˊˋˈˀˆˉ、。@#&%$€£¥₪¢¤₨₹µ‌¦|‍ـ"
ORPHAN = r"(^|[^\p{L}\p{M}])\p{M}"
#: Stand-ins for an escape and for a tatweel while words are replaced.
MARK, STRETCH = "\u0092", "\u0093"
# Headings of escapes and what falls under them.
XML_GROUPS = [
    ("XML ESCAPE TOKENS (BASIC)", r"(?i)^&(?:amp|apos|gt|lt|nbsp|quot);$"),
    ("XML ESCAPE TOKENS (EXTENDED)", r"(?i)^&[a-z]{1,6};$"),
    ("XML ESCAPE TOKENS (DECIMAL)", r"^&#\d{1,7};$"),
    ("XML ESCAPE TOKENS (HEX)", r"(?i)^&#x[0-9a-f]{1,6};$"),
    ("XML ESCAPE TOKENS (NESTED)", r"(?i)^&(?:amp;)+(?:#x[0-9a-f]{1,6}|#\d{1,7}|[a-z]{1,6});$"),
]
# What a text is flagged for, in the order of the line of issues.
FLAGS = [
    (r"[\x{0}-\x{8}\x{B}-\x{1F}\x{7F}]", "C0_CONTROL"),
    (r"[\x{80}-\x{9F}]", "C1_CONTROL"),
    (r"(?i)&(?:amp;)*(?:#\d{1,7}|#x[0-9a-f]{1,6}|[a-z]{1,6});", "XML escape token"),
    (r"\x{FFFD}", "Replacement character"),
    (ORPHAN, "Orphan modifier"),
    (r"[\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]", "Variation selector"),
    (r"[\x{250}-\x{2AF}]", "IPA character"),
    (r"\p{Co}", "Private use character"),
    ("ـ", "Tatweel"),
]
#: The canonical-form steps, each as its change is called.
CANON = [("arabic-presentation", "pres-form"), ("ligature", "ligatures"), ("hangul", "hangul"), ("moved-nukta", "repair-combining"), ("compose", "combining-compose"), ("decompose", "combining-decompose")]


def _all(c: Column, *patterns: str) -> Column:
    return F.concat(*[F.regexp_extract_all(c, F.lit(p), F.lit(0)) for p in patterns])


def pattern_of(token: Column) -> Column:
    """The token's shape: words, numbers, marks and escapes by name, other characters as they are. Only the first two escapes of
    a kind collapse."""
    c = F.regexp_replace(token, MARK + "|" + STRETCH, "")
    c = F.replace(c, F.lit("ـ"), F.lit(STRETCH))
    for escape, by in ((r"&(?:[aA][mM][pP];)*(?:#[xX][0-9A-Fa-f]{1,6}|#\d{1,7}|[A-Za-z]{1,6});", f"&{MARK};"), (r"(?:%(?:25)*[0-9A-Fa-f]{2}){2,}", f"%{MARK}")):
        for _ in range(2):
            c = F.regexp_replace(c, F.lit(f"(?s)^(.*?){escape}"), F.lit(f"$1{by}"))
    for pattern, name in ((r"(?:\p{L}\p{M}*)+", "Word"), (r"\p{M}{2,}", "Modifiers"), (r"\p{M}", "Modifier"), (r"\p{N}+", "Number"), (MARK, "Xml"), (STRETCH, "ـ")):
        c = F.regexp_replace(c, F.lit(pattern), F.lit(name))
    return c


def of_interest(token: Column) -> Column:
    """Whether a token holds a character of interest or an orphan mark, which is beyond ASCII."""
    return token.rlike(normalize.class_of(OF_INTEREST)) | (F.octet_length(token) > F.length(token)) & token.rlike(ORPHAN)


def escapes(text: Column) -> Column:
    """All escapes of a text, as an array; null where it holds no `&`."""
    return F.when(text.contains("&"), _all(text, *analyze.XML.values(), analyze.NESTED))


def words_beyond(text: Column) -> Column:
    """All words of a text with a letter or mark beyond ASCII, as an array; null where the text has none."""
    words = F.regexp_extract_all(text, F.lit(analyze.WORD), F.lit(0))
    return F.when(F.octet_length(text) > F.length(text), F.filter(words, lambda w: F.octet_length(w) > F.length(w)))


def patterns(df: DataFrame, text_col: str = "text") -> DataFrame:
    """pattern, n: shapes of the tokens that hold a character of interest or an orphan mark; a word with tatweels inside counts
    with them and without."""
    t = analyze.tokens(df, r"\S+", text_col).where(of_interest(F.col("token")))
    shape = t.select("n", pattern_of(F.col("token")).alias("p"))
    both = F.array_distinct(F.array("p", F.regexp_replace("p", "(?:Word)+ـ+(?:Word)+", "Word")))
    return shape.select("n", F.explode(both).alias("pattern")).groupBy("pattern").agg(F.sum("n").alias("n"))


def pattern_groups(df: DataFrame, text_col: str = "text") -> DataFrame:
    """heading, pattern, n: each pattern under every character of interest it holds."""
    marks = F.array(*[F.struct(F.lit(c).alias("ch"), F.lit(f"TOKENS WITH {c} (U+{ord(c):04X} {ud.name(c, '')})").alias("heading")) for c in sorted(set(OF_INTEREST))])
    held = F.transform(F.filter(marks, lambda m: F.contains(F.col("pattern"), m["ch"])), lambda m: m["heading"])
    orphan = F.when(F.contains(F.col("pattern"), F.lit("Modifier")), F.array(F.lit("TOKENS WITH ORPHAN MODIFIER"))).otherwise(F.array().cast("array<string>"))
    return patterns(df, text_col).select(F.explode(F.concat(held, orphan)).alias("heading"), "pattern", "n")


def notable(df: DataFrame, text_col: str = "text", by: Sequence[str] = ()) -> DataFrame:
    """heading, token, n: escapes by kind, and words of several scripts, of all rows or by columns."""
    t = analyze.exploded(df, escapes(F.col(text_col)), "token", *by).groupBy(*by, "token").agg(F.count("*").alias("n"))
    kind = F.coalesce(*[F.when(F.col("token").rlike(p), h) for h, p in XML_GROUPS])
    return t.select(*by, kind.alias("heading"), "token", "n").where("heading is not null").unionByName(mixed(df, text_col, by))


def mixed(df: DataFrame, text_col: str = "text", by: Sequence[str] = ()) -> DataFrame:
    """heading, token, n: words whose letters are of two scripts or more, under the sorted names of these; a script is that of the
    letter's block. Modifier and tone letters are named, but count for none."""
    t = analyze.exploded(df, words_beyond(F.col(text_col)), "token", *by).groupBy(*by, "token").agg(F.count("*").alias("n"))
    letters = t.select(*by, "token", "n", F.explode(F.array_distinct(F.regexp_extract_all("token", F.lit(r"\p{L}"), F.lit(0)))).alias("ch"))
    raw = F.java_method(F.lit("java.lang.Character$UnicodeBlock"), F.lit("of"), F.ascii("ch"))

    def named(it):
        for pdf in it:
            pdf["script"] = [blocks.script_of(blocks.block_of(c, "OTHER" if b == "null" else b)) for c, b in zip(pdf["ch"], pdf["block"])]
            yield pdf[["ch", "script"]]

    dim = letters.select("ch").distinct().select("ch", raw.alias("block")).mapInPandas(named, "ch string, script string")
    found = letters.join(dim, "ch").groupBy(*by, "token", "n").agg(F.array_sort(F.collect_set("script")).alias("s"))
    found = found.where(F.size(F.array_except("s", F.array(*map(F.lit, blocks.NO_LETTERS)))) >= 2)
    return found.select(*by, F.concat(F.lit("WORDS WITH CHARACTERS FROM MULTIPLE SCRIPTS ("), F.array_join("s", ", "), F.lit(")")).alias("heading"), "token", "n")


def non_canonical(df: DataFrame, text_col: str = "text", by: Sequence[str] = ()) -> DataFrame:
    """orig, norm, orig_count, norm_count, changes, orig_form, norm_form of letters and letters with marks that are not in their
    canonical form. norm_count is that of the canonical form in the same texts."""
    text = F.col(text_col)
    marked = F.when(F.octet_length(text) > F.length(text), F.regexp_extract_all(text, F.lit(analyze.COMPLEX), F.lit(0))).otherwise(F.array().cast("array<string>"))
    pieces = analyze.exploded(df, F.concat(marked, F.split(text_col, "")), "orig", *by)
    # counted first: a condition on the count as well stays above it, so that each different piece is looked at once
    letter = F.when(F.col("orig_count") > 0, F.col("orig")).rlike(r"^\p{L}\p{M}*$")
    t = pieces.groupBy(*by, "orig").agg(F.count("*").alias("orig_count")).where(letter)
    steps = {s.name: s.apply for s in normalize.STEPS}

    def forms(x: Column, left: list[str], seen: list[Column]) -> Column:
        """All forms from x on; each is a bound variable, so the expression grows with the steps alone."""
        if not left:
            return F.array(*seen, x)
        return normalize.let(steps[left[0]](x), lambda y: forms(y, left[1:], [*seen, x]))

    names = F.array(*[F.lit(name) for name, _ in CANON])
    done = t.select(*by, "orig", "orig_count", forms(F.col("orig"), [s for _, s in CANON], []).alias("f"))
    # Written into the plan as an array that is exploded: a filter on it does not repeat the steps.
    one = done.select(*by, "orig", "orig_count", F.explode(F.array("f")).alias("f"))
    changes = F.filter(names, lambda name, k: F.get("f", k) != F.get("f", k + 1))
    found = one.where(F.get("f", F.lit(len(CANON))) != F.col("orig")).select(*by, "orig", F.get("f", F.lit(len(CANON))).alias("norm"), "orig_count", changes.alias("changes"))
    found = found.join(t.select(*by, F.col("orig").alias("norm"), F.col("orig_count").alias("norm_count")), [*by, "norm"], "left")

    def labelled(it):
        for pdf in it:
            forms = [_forms(*x) for x in zip(pdf["orig"], pdf["norm"], pdf["changes"])]
            pdf["orig_form"], pdf["norm_form"] = [f[0] for f in forms], [f[1] for f in forms]
            yield pdf

    cols = found.select(*by, "orig", "norm", "orig_count", F.coalesce("norm_count", F.lit(0)).alias("norm_count"), "changes")
    keys = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in cols.schema if f.name in by)
    return cols.mapInPandas(labelled, keys + "orig string, norm string, orig_count long, norm_count long, changes array<string>, orig_form string, norm_form string")


def _form(s: str) -> str | None:
    """The first normal form that leaves s as it is."""
    return next((f for f in ("NFC", "NFD", "NFKC", "NFKD") if ud.normalize(f, s) == s), None)


def _forms(orig: str, norm: str, changes) -> tuple[str | None, str | None]:
    a, b, changes = _form(orig), _form(norm), list(changes)
    if sorted(orig) == sorted(norm):
        return None, "REORDERED"
    if set(orig) == set(norm):
        return None, "REMOVED-DUPLICATE-DIACRITIC"
    named = {("arabic-presentation",): "NORM-ARABIC-PRES-FORM", ("moved-nukta", "compose"): "REORDERED-AND-COMPOSED"}.get(tuple(changes))
    return (None, named) if named else (a, b)


def char_examples(df: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ch, code_point, name, n, ex: each character and the first k rows that hold it."""
    first = analyze.first_holding(df, k, id_col, text_col)
    ex = first.groupBy("ch").agg(F.array_sort(F.collect_list(id_col)).alias("ex"))
    counts = analyze.char_counts(df, text_col)
    return counts.join(analyze.char_dim(counts), "ch").join(ex, "ch").select("ch", "code_point", "name", "n", "ex")


def issues(df: DataFrame, by: str = "doc_id", text_col: str = "text") -> DataFrame:
    """by, issues: the quick line of each document, of 16 letter scripts and FLAGS alone; summary.issues gives all."""
    c = F.col(text_col)
    scripts = F.filter(F.array(*[F.when(c.rlike(rf"\p{{Is{s}}}"), s.upper()) for s in ("Latin", "Greek", "Cyrillic", "Arabic", "Hebrew", "Devanagari", "Bengali", "Thai", "Hangul", "Han", "Hiragana", "Katakana", "Georgian", "Armenian", "Ethiopic", "Tamil")]), lambda x: x.isNotNull())
    several = F.when(F.size(scripts) >= 2, F.concat(F.size(scripts).cast("string"), F.lit(" letter scripts: "), F.array_join(scripts, ", ")))
    conflict = F.when((c.contains("ك") & c.contains("ک")) | (c.contains("ي") & c.contains("ی")), "character set conflict")
    words = F.exists(F.regexp_extract_all(c, F.lit(analyze.WORD), F.lit(0)), lambda w: sum((w.rlike(rf"\p{{Is{s}}}").cast("int") for s in ("Latin", "Greek", "Cyrillic")), F.lit(0)) >= 2)
    # Words are looked at only where the text has letters of two of these scripts.
    multi = F.when(F.when(F.size(scripts) >= 2, words).otherwise(False), "multi-script word")
    return df.select(by, F.concat_ws("; ", several, conflict, *[F.when(c.rlike(p), name) for p, name in FLAGS], multi).alias("issues"))
