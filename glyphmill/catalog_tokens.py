"""Registered queries of issue tags and of the analysis with examples, and their SQL.

The test texts hold few odd tokens, so each text gets some more by its id. The SQL takes the fixed patterns of shapes and words and
states anew how they work together: by unions of conditions on tokens, by BETWEEN for characters, by recursion for lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import tagdata
from glyphmill.operators import analyze, tags
from glyphmill.plans import cases

#: Appended to texts by id.
TOKENS = [
    "", "don't cannot John's nations' we'll", "12. e.g. U.S. Dr. 3.14 1,000 etc.,", "a@b.org www.abc.com http://abc.de/x #hash @handle x.com/1 http:x",
    "well-known -x --1 9,a end) 'd 1/2 10:30 24-12-2020", "counterrevolutionary abcdefghijklmnopqrstuvwxyzabcd abcdefghijklmnopqrstuv $5 €7", "&amp; &#39; &#x41; &bullet; x&lt;y",
    "été œuvre ĳ ß", "Привет прив.ет .да да. да! Oк", "  –— → ■ ™ ∑ ☀", "كکيی الabc ١ 一a あ", "﻿​ �  Ａ ́ 한",
]


def _odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = F.element_at(F.array(*map(F.lit, TOKENS)), (F.col("doc_id") % len(TOKENS) + 1).cast("int"))
    return docs.select("doc_id", F.concat_ws(" ", "text", more).alias("text"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with numbers of their own over all documents."""
    return analyze.lines(_odd(spark, sf_dir)).select((F.col("doc_id") * 1_000_000 + F.col("line_no")).alias("line_no"), "line")


def _text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).withColumnRenamed("line", "text")


def _tags(kinds: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: tags.counts(_lines(spark, sf_dir), only=frozenset(kinds.split()))


def _shown(ex: str = "ex"):
    return F.array_join(F.transform(ex, lambda x: F.concat(x["text"], F.lit("@"), x["line_no"].cast("string"))), "|")


def _ends() -> list[str]:
    """First, middle and last characters of all ranges of classes, in pieces of eight; and some of no range."""
    found = [chr(c) for a, z, _ in tagdata.ranges() for c in sorted({a, (a + z) // 2, z})] + ["ɐ", "ʹ", "܀", "℀", "\U0001f600", "\U00101fff"]
    return ["".join(found[k : k + 8]) for k in range(0, len(found), 8)]


#: Lines appended to texts by id.
BROKEN = [
    "", "see http : / / www . abc . com / page now", "http : / / abc . de . org / x / y . html and www . abc . net", "https @:/@ @/@ www . a-b . com x", "http : / / ab-c.de.com / x",
    "the file abc / def . pdf and notes . txt", "john . smith @ abc . org , mary @ abc @-@ x . com", "a . b @ c1 . d2 . xx", "www x . y com z w v", "x y. @ z . w com v",
    'a & amp ; b & lt ; c &amp; &#39; &#x41; & nbsp ;', 'he said \\ " yes \\ " &bullet;', "http://a.b &amp;lt; &#x1F; HTTP : / / WWW . ABC . COM / X . HTML", "& AMP ; http", " @ x @ y @",
]
#: Tokens with shapes and scripts that TOKENS lacks.
SHAPES = [
    "", "o'clock 'll don't. can't, mary's boys' -ed --5 a,b", "A. B.C. U.S.A. a.m. 1.234.567 =1,234 Prof. PROF. Sept. http://www.abc.com x@abc.com",
    "10/12/20 5-6 -3.5 10:30-11 7:15:00 23:59pm ::source:: ::article end-of-article ::snt-type", "https://t.co/abcdEFGH12 http://ab.cd.de/x.pdf www.ab-c.de/x/y.html @Émile_1 #été https:/x",
    "क़ ख़ाक ऩर ऱ क़ि कि़ ड़ ढ़ बाज़ार", "ⴀⴁ. .აბ აბ! აბ,გდ «აბ aბ", "كتاب والabc بx وب12 كکيیabc مكتب123", "日本語a 日本 ー語 日x!", "aaaaaaaaaaaaaaaaaaaa ééééééééééé counterrevolutionaries Институционализация",
    "$5 x$ [a] \"b\" {c} ~d e| -:- \"/\" @-@ @/@ ^ a_b", "\x01a \x1fb\x7f x\u0085y", "–a—b– ––x— \u2003x\u2003 →→a ■b■", "﻿﻿a a﻿ ی يي کكك ككی",
]


def _with(pieces: list[str], sep: str) -> Callable[[SparkSession, str], DataFrame]:
    """Lines of documents, with the pieces at the ends of the texts, under numbers of their own."""

    def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
        more = F.element_at(F.array(*map(F.lit, pieces)), (F.col("doc_id") % len(pieces) + 1).cast("int"))
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat_ws(sep, "text", more).alias("text"))
        return analyze.lines(docs).select((F.col("doc_id") * 1_000_000 + F.col("line_no")).alias("line_no"), "line")

    return lines


#: Pieces of every kind: tokens, then a line.
EVERY = [f"{TOKENS[k % len(TOKENS)]} {SHAPES[k % len(SHAPES)]} {_ends()[k % len(_ends())]}\n{BROKEN[k % len(BROKEN)]}" for k in range(60)]
_every = _with(EVERY, " ")


def _shown_tags(found: DataFrame) -> DataFrame:
    return found.withColumn("places", F.array_join(F.transform("places", lambda x: x.cast("string")), ","))


MIXES = "MIXED_CYRILLIC_LATIN PUNCT_CYRILLIC CYRILLIC_PUNCT CYRILLIC_PLUS_PERIOD MIXED_CYRILLIC_PUNCT MIXED_CJK_ASCII ARABIC_PREFIX_ASCII MIXED_ARABIC_ASCII"
ESCAPED = "XML_ESC_DEC XML_ESC_HEX XML_ESC_STD XML_ESC_ABC"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "class_tags": lambda spark, sf_dir: tags.class_counts(_with(_ends(), "")(spark, sf_dir), "line"),
    "tags_of_whole_tokens": lambda spark, sf_dir: tags.whole_counts(_every(spark, sf_dir)),
    "tags_of_characters": lambda spark, sf_dir: tags.character_counts(_every(spark, sf_dir)),
    "tags_of_mixed_tokens": _tags(MIXES),
    "tags_of_escapes": _tags(ESCAPED),
    "tags_of_broken_lines": lambda spark, sf_dir: tags.line_tags(tags.collapsed_lines(_with(BROKEN, "\n")(spark, sf_dir))).groupBy("tag", "example").agg(F.count("*").alias("n")),
    "tags_all": lambda spark, sf_dir: tags.counts(_every(spark, sf_dir)),
    "tag_examples": lambda spark, sf_dir: _shown_tags(tags.issues(_every(spark, sf_dir))),
    "character_examples": lambda spark, sf_dir: cases.characters(_text_lines(spark, sf_dir)).select("ch", "n", _shown().alias("ex")).where(F.col("ch").rlike(r"^[0-9!?;:()\x{2192}\x{25A0}]$")),
    "notable_examples": lambda spark, sf_dir: cases.notable(_text_lines(spark, sf_dir)).select("heading", "token", "n", _shown().alias("ex")).where("heading like 'XML%'"),
    "pattern_examples": lambda spark, sf_dir: cases.patterns(_text_lines(spark, sf_dir)).select("pattern", "n", _shown().alias("ex")),
}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_LINES = "l AS (SELECT doc_id * 1000000 + i AS line_no, parts[i] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(concat_ws(' ', text, list_extract([" + ", ".join(map(_q, TOKENS)) + f"], (doc_id % {len(TOKENS)} + 1)::INT)), chr(10)) AS parts FROM documents)))"
_TOKENS = f"WITH {_LINES}, t AS (SELECT token, count(*) AS n FROM (SELECT unnest(list_filter(string_split_regex(line, '[ \\t-\\r]+'), lambda w: w <> '')) AS token FROM l) GROUP BY token)"


def _counted(conditions: list[tuple[str, str]]) -> str:
    """SQL that counts tokens by (tag, condition over token)."""
    rows = " UNION ALL ".join(f"SELECT '{tag}' AS tag, sum(n)::BIGINT AS n FROM t WHERE {c} HAVING count(*) > 0" for tag, c in conditions)
    return f"{_TOKENS} SELECT tag, sum(n)::BIGINT AS n FROM ({rows}) GROUP BY tag"


def _m(p: str) -> str:
    return f"regexp_matches(token, {_q(p)})"


def _code(low: int, high: int) -> str:
    return f"regexp_matches(token, '[\\x{{{low:X}}}-\\x{{{high:X}}}]')"


_PUNCT = r"[!-/:-@\[-`{-~]"
ORACLE_SQL: dict[str, str] = {
    "tags_of_mixed_tokens": _counted([
        ("MIXED_CYRILLIC_LATIN", f"{_m('[A-Za-z]')} AND {_code(0x400, 0x52F)}"),
        ("PUNCT_CYRILLIC", _m(rf"^{_PUNCT}+[\x{{400}}-\x{{52F}}]")),
        ("CYRILLIC_PLUS_PERIOD", _m(r"[\x{400}-\x{52F}]\.$") + " AND NOT " + _m(rf"^{_PUNCT}")),
        ("CYRILLIC_PUNCT", _m(r"[\x{400}-\x{52F}][!-\-/:-@]+$") + " AND NOT " + _m(rf"^{_PUNCT}")),
        ("MIXED_CYRILLIC_PUNCT", _m(r"^[\x{400}-\x{52F}]+[.][\x{400}-\x{52F}]+$")),
        ("MIXED_CJK_ASCII", f"{_m('[!-~]')} AND {_code(0x4E00, 0x9FFF)}"),
        ("ARABIC_PREFIX_ASCII", _m(r"^\x{627}\x{644}[a-z]+$")),
    ]),
    "tags_of_escapes": f"WITH {_LINES}, x AS (SELECT unnest(regexp_extract_all(line, '(?i)&(?:#[0-9]{{1,7}}|#x[0-9a-f]{{1,6}}|[a-z]{{1,6}});')) AS e FROM l) SELECT CASE WHEN e ~ '&#[0-9]+;' THEN 'XML_ESC_DEC' WHEN e LIKE '&#%' THEN 'XML_ESC_HEX' WHEN lower(e) IN ('&amp;', '&apos;', '&gt;', '&lt;', '&quot;') THEN 'XML_ESC_STD' ELSE 'XML_ESC_ABC' END AS tag, count(*) AS n FROM x GROUP BY 1",
    "character_examples": f"WITH {_LINES}, runs AS (SELECT line_no, unnest(range(len(r))) AS pos, unnest(r) AS run FROM (SELECT line_no, regexp_extract_all(line, '\\pN+|[^\\pN]') AS r FROM l)), c AS (SELECT line_no, pos, run, ch FROM (SELECT line_no, pos, run, unnest(string_split(run, '')) AS ch FROM runs) WHERE regexp_matches(ch, '^[0-9!?;:()→■]$')), n AS (SELECT ch, count(*) AS n FROM c GROUP BY ch), e AS (SELECT ch, run, line_no, min(pos) AS pos FROM c GROUP BY ch, run, line_no), k AS (SELECT *, row_number() OVER (PARTITION BY ch ORDER BY line_no, pos) AS r FROM e) SELECT ch, any_value(n.n) AS n, string_agg(run || '@' || line_no, '|' ORDER BY r) AS ex FROM k JOIN n USING (ch) WHERE r <= 5 GROUP BY ch",
}


def _piece(pieces: list[str]) -> str:
    return "list_extract([" + ", ".join(map(_q, pieces)) + f"], (doc_id % {len(pieces)} + 1)::INT)"


def _with_sql(pieces: list[str], sep: str) -> str:
    """l(line_no, line): the lines of _with()."""
    text = f"concat_ws({_q(sep)}, text, {_piece(pieces)})"
    return f"l AS MATERIALIZED (SELECT doc_id * 1000000 + i AS line_no, parts[i] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split({text}, chr(10)) AS parts FROM documents)))"


#: Tokens with their places, and each different one with how often it occurs.
_PLACES = r"""k AS MATERIALIZED (SELECT line_no, trim(regexp_replace(line, '[ \t-\r]+', ' ', 'g'), ' ') AS line FROM l WHERE trim(regexp_replace(line, '[ \t-\r]+', ' ', 'g'), ' ') <> ''),
    places AS MATERIALIZED (SELECT line_no, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT line_no, string_split(line, ' ') AS w FROM k)),
    t AS MATERIALIZED (SELECT token, count(*) AS n FROM places GROUP BY token)"""


def _whole_sql() -> str:
    """whole(token, tag, example, times), and f, the tokens whose characters are to be looked at."""
    kind = "CASE " + " ".join(f"WHEN {_m(p)} THEN '{k}'" for k, p in tags.SPECIAL) + " ELSE '' END"
    choice = "CASE WHEN kind IN ('URL', 'EMAIL', 'HASHTAG', 'HANDLE') THEN kind WHEN " + _m(r"^(www\.|https?:)\S|\S\.(com|org)") + " THEN 'SUSPICIOUS_URL' WHEN " + _m("[.,;!?].|.[.,;!?]") + " THEN CASE WHEN " + _m(r"^\d+\.$") + " THEN 'NUM_UNSPLIT_PERIOD' WHEN " + " OR ".join(map(_m, tags.BENIGN_PERIOD)) + " THEN 'BEN_UNSPLIT_PERIOD' ELSE 'UNSPLIT_PERIOD' END "
    choice += " ".join(f"WHEN {_m(p)} THEN '{tag}'" for tag, p, langs in tags.BENIGN if not langs)
    choice += " WHEN " + _m(r"[!-/:-@\[\\\]^_`{|}~]") + " AND size >= 2 AND NOT " + _m('^@?[-:/"]@?$') + " THEN 'UNSPLIT_PUNCT' END"
    usual = "kind = '' AND NOT " + _m("(?i)^[a-z]+-+|^[a-z]+n't|^[a-z]+('s|s')$")
    prefix = _m(rf"^({tagdata.PREFIXES})(\d+(\.\d+)?|([a-z{tags.LATIN}]|[\x{{100}}-\x{{23F}}])+)$")
    mixed = f"{_m('[!-~]')} AND {_m('[؀-ۿ]')}"
    separate = tags.SEPARATE
    rules = [
        ("'CONTROL_CHAR'", _m(r"[\x00-\x1F\x7F]")), ("'CURRENCY'", "contains(token, '$')"), ("'UNSPLIT_PUNCT_ALPHA_HYPHEN'", _m("(?i)^[a-z]+-+") + " AND kind = ''"),
        *[("'UNSPLIT_PUNCT'", f"{usual} AND {_m(p)}") for p in tags.UNSPLIT],
        ("'UNSPLIT_APO_S'", _m("(?i)[a-z]('s|s')$")), ("'UNSPLIT_APO_V'", _m("(?i)[a-z]'(d|ll|m|ve)$")), ("'UNSPLIT_NOT'", _m("(?i)[a-z]n't$")), ("'UNSPLIT_NOT'", _m("(?i)^cannot$")), (choice, f"({choice}) IS NOT NULL"),
        ("'ARABIC_PREFIX_ASCII'", f"{mixed} AND {prefix}"), ("'MIXED_ARABIC_ASCII'", f"{mixed} AND NOT {prefix}"), ("'MIXED_CJK_ASCII'", f"{_m('[!-~]')} AND {_code(0x4E00, 0x9FFF)}"),
        ("'MIXED_CYRILLIC_LATIN'", _m(r"[A-Za-z\x{C0}-\x{24F}]") + " AND " + _code(0x400, 0x52F)),
    ]
    for name, script in (("CYRILLIC", tags.CYRILLIC), ("GEORGIAN", tags.GEORGIAN)):
        period = rf"[{script}]\.$" if name == "CYRILLIC" else r"\.$"
        which = f"CASE WHEN {_m(f'^[{tags.PUNCT}]+[{script}]')} THEN 'PUNCT_{name}' WHEN {_m(period)} THEN '{name}_PLUS_PERIOD' WHEN {_m(f'[{script}][{tags.PUNCT}]+$')} THEN '{name}_PUNCT' ELSE 'MIXED_{name}_PUNCT' END"
        rules.append((which, f"{_m(f'[{tags.PUNCT}]')} AND {_m(f'[{script}]')}"))
    devanagari = _code(0x900, 0x97F)
    rules += [
        ("'STD_SEP_NUKTA'", f"{devanagari} AND {_m(separate)}"), ("'ALT_SEP_NUKTA'", f"{devanagari} AND contains(regexp_replace(token, {_q(separate)}, '', 'g'), chr(2364))"),
        ("'STD_CMP_NUKTA'", _m(r"[\x{929}\x{931}\x{934}]")), ("'ALT_CMP_NUKTA'", _code(0x958, 0x95F)), ("'DIS_VSGN_NUKTA'", _m(r"[\x{93E}-\x{94D}]\x{93C}")),
        ("'LONG_TOKEN_30'", "kind = '' AND length(token) >= 30"), ("'LONG_TOKEN_20'", "kind = '' AND length(token) BETWEEN 20 AND 29 AND NOT " + _m(rf"(?i)^({tagdata.LONG_WORDS})$")), ("'ASCII_LETTER'", _m("[A-Za-z]")),
    ]
    found = " UNION ALL ".join(f"SELECT token, {tag} AS tag FROM looked WHERE {c}" for tag, c in rules)
    letters, none, arabic, cjk = _m("^[A-Za-z]+$") + " AND strlen(token) < 20", _m("^([0-9]+|[-_+*=\"`':;.?!%()])$"), _m(r"^[\x{621}-\x{63A}\x{641}-\x{64A}]+$") + " AND length(token) < 20", _m(r"^[\x{4E00}-\x{9FFF}]+$") + " AND length(token) < 20"
    return f"""looked AS MATERIALIZED (SELECT token, strlen(token) AS size, {kind} AS kind FROM t WHERE NOT ({letters}) AND NOT {none} AND NOT ({arabic}) AND NOT ({cjk})),
    f AS (SELECT token FROM looked WHERE {_m(r'[^\x00-\x7F]')}),
    whole AS MATERIALIZED (SELECT token, tag, token AS example, 1 AS times FROM (SELECT token, 'ASCII_LETTER' AS tag FROM t WHERE {letters} UNION ALL SELECT token, 'UNSPLIT_NOT' FROM t WHERE lower(token) = 'cannot'
        UNION ALL SELECT token, 'ARABIC_LETTER' FROM t WHERE {arabic} UNION ALL SELECT token, 'CJK' FROM t WHERE {cjk} UNION ALL {found.replace("SELECT token, 'UNSPLIT_NOT' AS tag FROM looked WHERE " + _m('(?i)^cannot$') + ' UNION ALL ', '')}))"""


def _classes_sql(chars: str) -> str:
    """ch, tag of the characters of a table chars(ch), by the first range that holds them."""
    ranges = ", ".join(f"({k}, {a}, {z}, '{tag}')" for k, (a, z, tag) in enumerate(tagdata.ranges()))
    return f"SELECT ch, coalesce(min_by(tag, k), 'OTHER_CHAR') AS tag FROM (SELECT DISTINCT ch FROM {chars}) LEFT JOIN (VALUES {ranges}) AS r(k, lo, hi, tag) ON ord(ch) BETWEEN lo AND hi GROUP BY ch"


def _chars_sql() -> str:
    """inside(token, tag, example, times): the tags of the characters of f."""
    own, letters = ", ".join(map(_q, tagdata.BY_CHARACTER)), ", ".join(f"({_q(c)}, '{tag}')" for c, tag in tagdata.LETTERS.items())
    return f"""chars AS MATERIALIZED (SELECT token, unnest(c) AS ch, generate_subscripts(c, 1) AS pos FROM (SELECT token, regexp_extract_all(token, '[^\\x00-\\x7F]') AS c FROM f)),
    kinds AS ({_classes_sql('chars')}),
    known AS MATERIALIZED (SELECT token, pos, ch, CASE WHEN ord(ch) = 65279 AND pos = 1 THEN 'INITIAL_BYTE_ORDER_MARK' ELSE tag END AS tag FROM chars JOIN kinds USING (ch)),
    single AS (SELECT token, tag, ch, pos, row_number() OVER (PARTITION BY token, tag ORDER BY pos) AS r, min(pos) OVER (PARTITION BY token, tag) AS head FROM known WHERE tag IN ({own}) AND NOT regexp_matches(ch, {_q(tagdata.NOT_BY_CHARACTER)})),
    inside AS MATERIALIZED (SELECT DISTINCT token, tag, token AS example, 1 AS times FROM known UNION ALL SELECT token, tag || '_CHAR', ch, 1 FROM single WHERE r = 1 OR r = 2 AND head = 1
        UNION ALL SELECT token, l.tag, token, least(count(*), CASE WHEN min(pos) = 1 THEN 2 ELSE 1 END) FROM chars JOIN (VALUES {letters}) AS l(ch, tag) USING (ch) GROUP BY token, l.tag)"""


def _lines_sql() -> str:
    """found(tag, example, line_no, pos): what is broken or escaped in the lines k, by recursion where they are suspect."""
    rules = [(tag, f"(?i)(?:^| )({p})(?: |$)", f"(?i)(^| )(?:{p})( |$)", "\\1  \\2", more) for tag, p, more in tags.APART]
    rules += [(tag, f"(?i)({p})", f"(?i){p}", "  ", ()) for tag, p in tags.ANYWHERE] + [("UNUSUAL_PUNCT_COMB", r'(?:^| )(\\ ")(?: |$)', r'(^| )\\ "( |$)', "\\1  \\2", ())]
    first = " ".join(f"WHEN regexp_extract(rest, {_q(get)}, 1) <> ''" + "".join(f" AND regexp_matches(regexp_extract(rest, {_q(get)}, 1), {_q(x)})" for x in more) + f" THEN {k}" for k, (_, get, _, _, more) in enumerate(rules))
    tag = " ".join(f"WHEN {k} THEN '{r[0]}'" for k, r in enumerate(rules))
    example = " ".join(f"WHEN {k} THEN regexp_extract(rest, {_q(r[1])}, 1)" for k, r in enumerate(rules))
    blanked = " ".join(f"WHEN {k} THEN regexp_replace(rest, {_q(r[2])}, {_q(r[3])})" for k, r in enumerate(rules))
    suspect = f"regexp_matches(line, {_q(tags.SUSPECT)})"
    dec, hex_, std, abc = ("(?i)" + p for _, p in tags.ANYWHERE)
    plain = " || ".join(f"[{{'tag': '{name}', 'example': e}} FOR e IN regexp_extract_all(line, {_q(p)})]" for name, p in zip(("XML_ESC_DEC", "XML_ESC_HEX", "XML_ESC_STD"), (dec, hex_, std)))
    plain += f" || [{{'tag': 'XML_ESC_ABC', 'example': e}} FOR e IN list_filter(regexp_extract_all(line, {_q(abc)}), lambda e: NOT regexp_matches(e, {_q(std)}))]"
    return f"""cascade AS (SELECT line_no, 0 AS step, line AS rest, NULL::VARCHAR AS tag, NULL::VARCHAR AS example FROM k WHERE {suspect}
        UNION ALL SELECT line_no, step + 1, CASE rule {blanked} END, CASE rule {tag} END, CASE rule {example} END FROM (SELECT line_no, step, rest, CASE {first} END AS rule FROM cascade) WHERE rule IS NOT NULL),
    found AS MATERIALIZED (SELECT tag, example, line_no, step - 1 - 1000000 AS pos FROM cascade WHERE step > 0
        UNION ALL SELECT e.tag, e.example, line_no, i - 1 - 1000000 FROM (SELECT line_no, unnest(es) AS e, generate_subscripts(es, 1) AS i FROM (SELECT line_no, {plain} AS es FROM k WHERE NOT {suspect} AND contains(line, '&'))))"""


_EVERY = f"WITH RECURSIVE {_with_sql(EVERY, ' ')}, {_PLACES}, {_whole_sql()}, {_chars_sql()}, {_lines_sql()}"
_IN_TOKENS = "SELECT tag, n * times AS n FROM (SELECT * FROM whole UNION ALL SELECT * FROM inside) JOIN t USING (token)"
ORACLE_SQL |= {
    "class_tags": f"WITH {_with_sql(_ends(), '')}, chars AS (SELECT ch, count(*) AS n FROM (SELECT unnest(regexp_extract_all(line, '[^\\x00-\\x7F]')) AS ch FROM l) GROUP BY ch) SELECT tag, ch, n FROM chars JOIN ({_classes_sql('chars')}) USING (ch)",
    "tags_of_whole_tokens": f"{_EVERY} SELECT tag, sum(n)::BIGINT AS n FROM whole JOIN t USING (token) GROUP BY tag",
    "tags_of_characters": f"{_EVERY} SELECT tag, sum(n * times)::BIGINT AS n FROM inside JOIN t USING (token) GROUP BY tag",
    "tags_of_broken_lines": f"WITH RECURSIVE {_with_sql(BROKEN, chr(10))}, {_PLACES}, {_lines_sql()} SELECT tag, example, count(*) AS n FROM found GROUP BY tag, example",
    "tags_all": f"{_EVERY} SELECT tag, sum(n)::BIGINT AS n FROM ({_IN_TOKENS} UNION ALL SELECT tag, 1 FROM found) GROUP BY tag",
    "tag_examples": f"""{_EVERY},
    first AS (SELECT token, min((line_no, pos)) AS first FROM places GROUP BY token),
    tagged AS MATERIALIZED (SELECT token, tag, example, sum(times) AS times FROM (SELECT * FROM whole UNION ALL SELECT * FROM inside) GROUP BY ALL),
    ex AS (SELECT tag, example, sum(n)::BIGINT AS n, min(first) AS first FROM (SELECT tag, example, n * times AS n, first FROM tagged JOIN t USING (token) JOIN first USING (token) UNION ALL SELECT tag, example, 1, (line_no, pos) FROM found) GROUP BY tag, example),
    ranked AS (SELECT tag, example, n AS n_example, row_number() OVER (PARTITION BY tag ORDER BY first, example) AS rank, sum(n) OVER (PARTITION BY tag) AS n, count(*) OVER (PARTITION BY tag) AS n_examples FROM ex),
    seen AS (SELECT tag, example, line_no, pos, unnest(range(times::BIGINT)) AS again FROM (SELECT * FROM places QUALIFY row_number() OVER (PARTITION BY token ORDER BY line_no, pos) <= 10) JOIN tagged USING (token) UNION ALL SELECT tag, example, line_no, pos, 0 FROM found),
    shown AS (SELECT tag, example, string_agg(line_no, ',' ORDER BY line_no, pos) AS places FROM (SELECT * FROM seen QUALIFY row_number() OVER (PARTITION BY tag, example ORDER BY line_no, pos) <= 10) GROUP BY tag, example)
    SELECT tag, n::BIGINT AS n, n_examples, rank::INT AS rank, example, n_example, shown.places FROM ranked LEFT JOIN shown USING (tag, example) WHERE rank <= 20""",
}
