"""Issue tags of tokens and lines: 158 tags, each with its count, its first examples and their first places.

Tokens are counted first. A tag of a token follows from the token alone, so each different token is tagged once, by conditions over
Columns and by a table of the tags of its characters; counts and places are joined to it. Lines that hold broken addresses or
escapes are looked at one by one: what a rule finds is blanked before the next rule looks.

A tag can count several times for a token: `times`. Examples are kept in the order of their first place, places in order of line.
Ill-formed bytes do not exist in strings; of lines that come with their bytes, tokens that hold some are tagged NON_UTF8 or
UTF8_NON_SHORTEST (see lonebytes).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from glyphmill.functions import tagdata as D
from glyphmill.functions.masks import let
from glyphmill.operators import intervals, lonebytes

LONG, EXAMPLES, PLACES = 20, 20, 10
TAG = "struct<tag: string, example: string, times: int>"
LATIN = "À-ÖØ-öø-ÿ"
ABROAD = f"[-a-z0-9_{LATIN}]"
PAGE = r"\.(aspx?|docx?|html?|pdf|php|ppt|xml)"
# Shapes of whole tokens.
SPECIAL = [
    ("EMAIL", r"(?i)^[a-z][-a-z0-9_]+(\.[a-z][-a-z0-9_]+)*@[a-z][-a-z0-9_]+(\.[a-z][-a-z0-9_]+)*$"),
    ("URL", rf"(?i)^www(\.[a-z0-9]{ABROAD}+)+\.([a-z]{{2}}|{D.DOMAINS})(/(\.{{1,3}}|[a-z0-9][-a-z0-9_%{LATIN}]+))*(/[a-z0-9_][-a-z0-9_]+{PAGE})?$"),
    ("URL", rf"(?i)^https?://(|[a-z]\.)([a-z0-9]{ABROAD}+\.)+[a-z]{{2,}}(/(\.{{1,3}}|[-a-z0-9_%{LATIN}]+))*(/[a-z_][-a-z0-9_]+\.(aspx?|docx?|html?|pdf|php|ppt|xml|mp3|mp4))?$"),
    ("URL", r"^https?://t\.co/[A-Za-z0-9]{8,12}$"),
    ("URL", rf"(?i)^[a-z][-a-z0-9_]+(\.[a-z][-a-z0-9_]+)*\.({D.DOMAINS})(/[a-z0-9][-a-z0-9_%{LATIN}]+)*(/[a-z][-a-z0-9_]+{PAGE})?$"),
    ("HASHTAG", rf"(?i)^#[a-z{LATIN}][_a-z0-9{LATIN}]*[a-z0-9{LATIN}]$"),
    ("HANDLE", rf"(?i)^@[a-z{LATIN}][_a-z0-9{LATIN}]*[a-z0-9{LATIN}]$"),
    ("XML", rf"^&({D.ESCAPES});$"),
    ("INFO", r"^(::snt-type|end-of-article)$"),
]
# Punctuation that is not split off, periods and other punctuation that belong to a token, tokens done with by one look.
UNSPLIT = [r"(?i)[a-z'`]-[a-z'`]", r"(?i)^-[a-z'`]", r"-{2,}\d", r"(?i)[a-z0-9][-:\";,!?()/%]+$", r"(?i)\d,[a-z]"]
BENIGN_PERIOD = [
    r"^([A-Z]\.|[A-Z](?:\.[A-Z])+)\.?$",
    r"^(a\.m\.|p\.m\.|i\.e\.|vs\.|v\.)$",
    r"^(-?\d{1,3}(?:\.\d{3,3})+|-?\d{1,3}\.\d{1,3})$",
    r"^(=?\d{1,3}(?:,\d{3,3})+|-?\d{1,3},\d{1,3})$",
    rf"^({D.TITLES})\.$",
    rf"^({D.TITLES.upper()})\.$",
    rf"^({D.MONTHS})\.$",
    r"^((https?://)?www(\.[a-z]{2,})+\.(com|edu|gov|net|org|fr|rw)|izuba\.org\.rw)$",
    r"(?i)^([a-z][-a-z0-9.]*[a-z0-9]@[a-z]{3,}\.(com|edu|gov|net|org|fr|rw))$",
]
#: (tag, pattern, languages; none for all), of which the first counts, where no shape and no period has been found.
BENIGN = [
    ("BEN_UNSPLIT_APO", rf"(?i)^({D.CLITICS})'$", ("kin",)),
    ("BEN_UNSPLIT_APO", r"(?i)(ak|ik|ok|n|tr)'$|^(mah)'$", ("mlg",)),
    ("BEN_UNSPLIT_APO", r"(?i)^(o'clock)$", ("eng",)),
    ("BEN_UNSPLIT_APO", r"(?i)^('d|'ll|'m|n't|'re|'s|'ve|c'|d'|l')$", ()),
    ("BEN_UNSPLIT_PUNCT", r"(?i)^(\d+-\d+|\d+/\d+|\d\d?/\d\d?/\d\d(\d\d)?|\d\d?-\d\d?-\d\d(\d\d)?|-\d+(\.\d+)?|\d+:\d+(-\d+)?|\d+:\d\d:\d\d)$", ()),
    ("BEN_UNSPLIT_PUNCT", r"(?i)^((\d|0\d|1\d|2[0-3]):[0-5]\d(am|pm))$", ()),
    ("BEN_UNSPLIT_PUNCT", r"(?i)^::(article|emphasis|genre|snt-type|source|strong)$", ()),
    ("BEN_UNSPLIT_PUNCT", r"(?i)^(end-of-article)$", ()),
    ("BEN_UNSPLIT_PUNCT", r"(?i)^(?=.*([aeiouy]'|'[aeiou]))[a-z]+'[a-z]+$", ("som",)),
]
PUNCT = r"!-/:-@\[-`{-~\x{2000}-\x{2BFF}\x{A0}-\x{BF}\x{D7}\x{F7}\x{3000}-\x{3011}\x{3014}-\x{301F}\x{3030}\x{303B}-\x{303D}\x{FE10}-\x{FE19}\x{FE30}-\x{FE6B}\x{FF5B}-\x{FF64}\x{1F800}-\x{1F8FF}"
CYRILLIC, GEORGIAN = r"\x{400}-\x{52F}", r"\x{10A0}-\x{10FF}\x{1C90}-\x{1CBF}\x{2D00}-\x{2D2F}"
NUKTA, SIGN = r"\x{93C}", r"[\x{93E}-\x{94D}]"
SEPARATE = rf"[\x{{915}}\x{{916}}\x{{917}}\x{{91C}}\x{{921}}\x{{922}}\x{{92B}}\x{{92F}}]{SIGN}?{NUKTA}"
#: Tokens that are done with by one look.
PLAIN = [("ASCII_LETTER", r"^[A-Za-z]+$", None), ("", r"^([0-9]+|[-_+*=\"`':;.?!%()])$", 0), ("ARABIC_LETTER", r"^[\x{621}-\x{63A}\x{641}-\x{64A}]+$", 20), ("CJK", r"^[\x{4E00}-\x{9FFF}]+$", 20)]


def collapsed(line: Column) -> Column:
    """The line without outer white space, every run of it inside as one blank."""
    return F.trim(F.when(line.rlike(r"[\t-\r]|  "), F.regexp_replace(line, r"[ \t-\r]+", " ")).otherwise(line))


def token_tags(t: Column, lang: str = "", long_min: int = LONG) -> Column:
    """The tags of a token but for those of its characters, as an array of TAG. What several rules ask for is found once, and tokens
    without a character that a group of rules needs pass by the group."""
    size = F.octet_length(t)
    none = F.array().cast(f"array<{TAG}>")

    def row(name: Column, when: Column) -> Column:
        return F.when(when, F.struct(name.alias("tag"), t.alias("example"), F.lit(1).alias("times")))

    def tag(name: str, when: Column) -> Column:
        return row(F.lit(name), when)

    def of(*tags: Column) -> Column:
        return F.array_compact(F.array(*tags))

    def any_of(patterns: list[str]) -> Column:
        found = F.lit(False)
        for p in patterns:
            found = found | t.rlike(p)
        return found

    shape = F.coalesce(*[F.when(t.rlike(p), k) for k, p in SPECIAL], F.lit(""))
    # every shape has one of these
    kind_of = F.when(t.rlike("[.@&#:]|^end"), shape).otherwise("")
    address = t.rlike(r"^(www\.|https?:)\S|\S\.(com|org)")
    benign = any_of(BENIGN_PERIOD) | (t.rlike(rf"^({D.BIBLE})\.$") if lang == "mlg" else F.lit(False))

    def choice_of(kind: Column) -> Column:
        choice = F.when(kind.isin("URL", "EMAIL", "HASHTAG", "HANDLE"), kind).when(address, "SUSPICIOUS_URL")
        choice = choice.when(t.rlike(r"[.,;!?].|.[.,;!?]"), F.when(t.rlike(r"^\d+\.$"), "NUM_UNSPLIT_PERIOD").when(benign, "BEN_UNSPLIT_PERIOD").otherwise("UNSPLIT_PERIOD"))
        for name, p, langs in BENIGN:
            if not langs or lang in langs:
                choice = choice.when(t.rlike(p), name)
        return choice.when(t.rlike(r"[!-/:-@\[\\\]^_`{|}~]") & (size >= 2) & ~t.rlike(r"^@?[-:/\"]@?$"), "UNSPLIT_PUNCT")

    def beside(script: str, name: str) -> Column:
        """A script's letters with punctuation before, after or among them."""
        has = t.rlike(f"[{script}]") & t.rlike(f"[{PUNCT}]")
        period = rf"[{script}]\.$" if name == "CYRILLIC" else rf"(?:[{script}]|)\.$"
        which = F.when(t.rlike(f"^[{PUNCT}]+[{script}]"), f"PUNCT_{name}").when(t.rlike(period), f"{name}_PLUS_PERIOD").when(t.rlike(f"[{script}][{PUNCT}]+$"), f"{name}_PUNCT").otherwise(f"MIXED_{name}_PUNCT")
        return row(which, has)

    ascii_, arabic = t.rlike("[!-~]"), t.rlike(r"[\x{600}-\x{6FF}]")
    prefix = t.rlike(rf"^({D.PREFIXES})(\d+(\.\d+)?|([a-z{LATIN}]|[\x{{100}}-\x{{23F}}])+)$")
    letters = r"A-Za-z\x{C0}-\x{24F}"

    def signed(kind: Column) -> Column:
        """Tags that ask for a sign of ASCII."""
        usual = (kind == "") & ~t.rlike(r"(?i)^[a-z]+-+|^[a-z]+n't|^[a-z]+('s|s')$")
        return F.concat(
            of(tag("CONTROL_CHAR", t.rlike(r"[\x00-\x1F\x7F]")), tag("CURRENCY", t.contains("$")), tag("UNSPLIT_PUNCT_ALPHA_HYPHEN", (kind == "") & t.rlike(r"(?i)^[a-z]+-+"))),
            let(usual, lambda u: of(*[tag("UNSPLIT_PUNCT", u & t.rlike(p)) for p in UNSPLIT])),
            F.when(t.contains("'"), of(tag("UNSPLIT_APO_S", t.rlike(r"(?i)[a-z]('s|s')$")), tag("UNSPLIT_APO_V", t.rlike(r"(?i)[a-z]'(d|ll|m|ve)$")), tag("UNSPLIT_NOT", t.rlike(r"(?i)[a-z]n't$")))).otherwise(none),
        )

    mixed = [
        tag("ARABIC_PREFIX_ASCII", ascii_ & arabic & prefix),
        tag("MIXED_ARABIC_ASCII", ascii_ & arabic & ~prefix),
        tag("MIXED_CJK_ASCII", ascii_ & t.rlike(r"[\x{4E00}-\x{9FFF}]")),
        tag("MIXED_CYRILLIC_LATIN", t.rlike(f"[{CYRILLIC}]") & t.rlike(f"[{letters}]")),
        beside(CYRILLIC, "CYRILLIC"),
        beside(GEORGIAN, "GEORGIAN"),
    ]
    nuktas = [
        tag("STD_SEP_NUKTA", t.rlike(SEPARATE)),
        tag("ALT_SEP_NUKTA", F.regexp_replace(t, F.lit(SEPARATE), F.lit("")).rlike(NUKTA)),
        tag("STD_CMP_NUKTA", t.rlike(r"[\x{929}\x{931}\x{934}]")),
        tag("ALT_CMP_NUKTA", t.rlike(r"[\x{958}-\x{95F}]")),
        tag("DIS_VSGN_NUKTA", t.rlike(SIGN + NUKTA)),
    ]
    # the letters of these scripts stand from U+0400 on
    beyond = F.when(t.rlike(r"[^\x{0}-\x{3FF}]"), F.concat(of(*mixed), F.when(t.rlike(r"[\x{900}-\x{97F}]"), of(*nuktas)).otherwise(none))).otherwise(none)

    def looked(kind: Column) -> Column:
        long = (size >= long_min) & (kind == "")
        lengths = [
            tag("LONG_TOKEN_30", long & (F.length(t) >= 30)),
            tag("LONG_TOKEN_20", long & (F.length(t) >= long_min) & (F.length(t) < 30) & ~t.rlike(rf"(?i)^({D.LONG_WORDS})$")),
            tag("UNSPLIT_NOT", t.rlike(r"(?i)^cannot$")),
            tag("ASCII_LETTER", t.rlike("[A-Za-z]")),
        ]
        # letters and digits of ASCII and what is no ASCII have none of it
        signs = F.when(t.rlike(r"[\x00-/:-@\[-`{-\x7F]"), F.concat(let(choice_of(kind), lambda c: of(row(c, c.isNotNull()))), signed(kind)))
        return F.concat(of(*lengths), signs.otherwise(none), F.when(size > F.length(t), beyond).otherwise(none))

    plain = F.when(t.rlike(PLAIN[0][1]) & (size < long_min), of(tag("UNSPLIT_NOT", t.rlike("(?i)^cannot$")), tag("ASCII_LETTER", F.lit(True))))
    plain = plain.when(t.rlike(PLAIN[1][1]), none)
    for name, p, most in PLAIN[2:]:
        plain = plain.when(t.rlike(p) & (F.length(t) < most), of(tag(name, F.lit(True))))
    return plain.otherwise(let(kind_of, looked))


def looked_into(t: Column, long_min: int = LONG) -> Column:
    """Whether a token's characters are to be looked at: some are beyond ASCII, and one look has not done with it."""
    done = t.rlike(PLAIN[0][1]) & (F.octet_length(t) < long_min) | t.rlike(PLAIN[1][1])
    for _, p, most in PLAIN[2:]:
        done = done | (t.rlike(p) & (F.length(t) < most))
    return (F.octet_length(t) > F.length(t)) & ~done


def classes(chars: DataFrame) -> DataFrame:
    """ch, tag of characters beyond ASCII (ch, all different): the class whose range holds them, by a range join."""
    known = intervals.table(chars.sparkSession, intervals.disjoint(D.ranges()))
    found = intervals.joined(chars.select("ch", F.ascii("ch").cast("long").alias("cp")), known, "cp")
    return found.select("ch", F.coalesce("name", F.lit("OTHER_CHAR")).alias("tag"))


def class_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """tag, ch, n: characters beyond ASCII by the class of their range."""
    counts = df.select(F.explode(F.regexp_extract_all(text_col, F.lit(r"[^\x00-\x7F]"), F.lit(0))).alias("ch")).groupBy("ch").agg(F.count("*").alias("n"))
    return classes(counts.select("ch")).join(counts, "ch").select("tag", "ch", "n")


def char_tags(tokens: DataFrame, lang: str = "", long_min: int | None = None) -> DataFrame:
    """The columns of tokens (token, all different, and others that follow from it), tag, example, times of the characters beyond ASCII in
    tokens. A tag counts once a token, whichever of its characters show it; for a character on its own account twice if the token's first
    character beyond ASCII is the first of them. Rows of tokens that lie together by token stay where they are. With long_min, only of
    tokens that one look has not done with."""
    whole = tokens.columns
    found = F.regexp_extract_all("token", F.lit(r"[^\x00-\x7F]"), F.lit(0))
    # not by a filter, which would go below the counting of tokens, so that whole tokens and characters would each count them;
    # outer: an inner explode has a filter that finds the characters again
    found = found if long_min is None else F.when(looked_into(F.col("token"), long_min), found)
    chars = tokens.select(*whole, F.posexplode_outer(found).alias("pos", "ch")).where("ch is not null")
    known = F.broadcast(intervals.table(tokens.sparkSession, intervals.disjoint(D.ranges())))
    kinds = intervals.joined(chars.withColumn("cp", F.ascii("ch").cast("long")), known, "cp", width=64)
    tag = F.coalesce("name", F.lit("OTHER_CHAR"))
    usual = "".join(chars_ for langs, chars_ in D.USUAL.items() if lang in langs)
    if usual:
        tag = F.when(F.col("ch").isin(*usual), "LANGUAGE_SPECIFIC").otherwise(tag)
    # a byte-order mark that is the first such character has a tag of its own
    tag = F.when((F.col("ch") == "\ufeff") & (F.col("pos") == 0), "INITIAL_BYTE_ORDER_MARK").otherwise(tag)
    letter = F.coalesce(*[F.when(F.col("ch") == c, name) for c, name in D.LETTERS.items()])
    shown = F.array_compact(F.array(F.struct(tag.alias("tag"), F.lit(False).alias("letter")), F.when(F.col("ch").isin(*D.LETTERS), F.struct(letter.alias("tag"), F.lit(True).alias("letter")))))
    rows = kinds.select(*whole, "pos", "ch", F.explode_outer(shown).alias("x")).select(*whole, "pos", "ch", "x.tag", "x.letter")
    own = ~F.col("letter") & F.col("tag").isin(*D.BY_CHARACTER) & ~F.col("ch").rlike(D.NOT_BY_CHARACTER)
    place = F.struct("pos", "ch")
    seen = rows.groupBy(*whole, "tag", "letter").agg(F.count("*").alias("m"), F.min("pos").alias("at"), F.min(F.when(own, place)).alias("one"), F.min(F.when(own & (F.col("pos") > 0), place)).alias("two"))

    def entry(tag: Column, example: Column, times: Column, when: Column) -> Column:
        return F.when(when, F.struct(tag.alias("tag"), example.alias("example"), times.cast("int").alias("times")))

    by_char, once = F.concat("tag", F.lit("_CHAR")), F.lit(1)
    entries = [
        entry(F.col("tag"), F.col("token"), F.when(F.col("letter"), F.least("m", F.when(F.col("at") == 0, 2).otherwise(1))).otherwise(1), F.lit(True)),
        entry(by_char, F.col("one.ch"), once, F.col("one").isNotNull()),
        entry(by_char, F.col("two.ch"), once, (F.col("one.pos") == 0) & F.col("two").isNotNull()),
    ]
    return seen.select(*whole, F.explode_outer(F.array_compact(F.array(*entries))).alias("x")).select(*whole, "x.*")


WEB = r"https? (?:@?://@? |: @/@ @/@ |: / / |% 3 a % 2 f % 2 f)"
NAME, DOTTED = "[a-z][a-z0-9_]+", r"(?: (?:\.|@-@) [a-z][a-z0-9_]+)*"
TAIL = rf"(?: @?/@? [a-z][a-z0-9_]+)*(?: \. (?:{D.FILES}))?"
# What is looked for in a line, in this order: tag, pattern, what else it must hold; between blanks or anywhere.
APART = [
    ("BROKEN_URL", rf"{WEB}www \. {NAME}{DOTTED}{TAIL}", ()),
    ("BROKEN_URL", rf"{WEB}{NAME}{DOTTED} \. (?:{D.DOMAINS}){TAIL}", ()),
    ("BROKEN_URL", rf"www \. {NAME}{DOTTED}{TAIL}", ()),
    ("BROKEN_URL", rf"{WEB}[a-z][-a-z0-9_]+(?:\.[a-z][-a-z0-9_]+)+{TAIL}", ()),
    ("BROKEN_FILENAME", rf"{NAME}(?: @?/@? [a-z][a-z0-9_]+)* \. (?:{D.FILES})", ()),
    ("BROKEN_EMAIL", rf"{NAME} (?:(?:\.|@-@) [a-z][a-z0-9_]+ )*@ {NAME}{DOTTED} \. [a-z]{{2,}}", ()),
    ("BROKEN_EMAIL", rf"{NAME} (?:(?:\.|@-@) [a-z][a-z0-9_]+ )*(?:\. )?@ {NAME}{DOTTED} \. (?:{D.DOMAINS})", ()),
    ("BROKEN_URL_FUZZY", r"(?:https?|www)(?: \S+){4,8}", (r" \. ", r"(?i)( com\b| org\b|http.*www\b|http.*[a-z][-a-z0-9_]+\.[a-z][-a-z0-9_]| \. [a-z]{2,} )")),
    ("BROKEN_EMAIL_FUZZY", r"(?:\S+ ){1,3}@(?: \S+){1,8}", (r" \. ", r"(?i) (com|org)\b")),
    ("SPLIT_XML", rf"& (?:{D.ESCAPES}) ;", ()),
]
ANYWHERE = [("XML_ESC_DEC", r"&#\d{1,7};"), ("XML_ESC_HEX", "&#X[0-9A-F]{1,6};"), ("XML_ESC_STD", "&(?:amp|apos|gt|lt|quot);"), ("XML_ESC_ABC", "&[a-z]{1,6};")]
# Fixed value: lines that may hold any of it.
SUSPECT = r'(http|www| @ |& \S+ ;|\\ ")'
BETWEEN_BLANKS = r"(?:^|(?<= ))(?:{})(?= |$)"
#: (tag, pattern, what a find must hold) in order.
RULES = [(tag, f"(?i){BETWEEN_BLANKS.format(p)}", more) for tag, p, more in APART] + [(tag, f"(?i){p}", ()) for tag, p in ANYWHERE] + [("UNUSUAL_PUNCT_COMB", BETWEEN_BLANKS.format(r'\\ "'), ())]
FIND = "struct<tag: string, example: string, at: int>"


def first_find(left: Column) -> Column:
    """The find (FIND) of the first rule that has one in a text; null for none. Rules after it are not tried, nor rules for which the
    text lacks what each of their finds holds."""

    def by(tag: str, pattern: str, more: tuple[str, ...], low: Column) -> Column:
        def held(m: Column) -> Column:
            good = m != ""
            for q in more:
                good = good & m.rlike(q)
            return F.when(good, F.struct(F.lit(tag).alias("tag"), m.alias("example"), F.regexp_instr(left, F.lit(pattern)).cast("int").alias("at")))

        return F.when(needed(tag, pattern, low), let(F.regexp_extract(left, pattern, 0), held))

    return let(F.lower(left), lambda low: F.coalesce(*[by(*rule, low) for rule in RULES]))


def needed(tag: str, pattern: str, low: Column) -> Column:
    """Whether a text in lower case holds what every find of a rule holds."""
    if WEB in pattern:
        return low.contains("http ") | low.contains("https ")
    every = {"BROKEN_URL": ["www . "], "BROKEN_FILENAME": [" . "], "BROKEN_EMAIL": [" @ ", " . "], "BROKEN_URL_FUZZY": [" . "], "BROKEN_EMAIL_FUZZY": [" @ ", " . "], "SPLIT_XML": ["& ", " ;"], "XML_ESC_DEC": ["&#"], "XML_ESC_HEX": ["&#x"], "XML_ESC_STD": ["&"], "XML_ESC_ABC": ["&"], "UNUSUAL_PUNCT_COMB": ['\\ "']}
    return reduce(lambda a, b: a & b, [low.contains(x) for x in every[tag]])


def broken(line: Column) -> Column:
    """What is broken in a line, as an array of FIND: the find of the first rule that has one is blanked, and so on until no rule has any.
    A fold over as many steps as a line can have finds, of which those after the last do nothing; each find holds one of four signs."""
    steps = F.sequence(F.lit(0), F.regexp_count(line, F.lit(r"[.@&\\]")))

    def blanked(state: Column, find: Column) -> Column:
        rest = F.substr(state["left"], find["at"] + F.length(find["example"]))
        return F.concat(F.substring(state["left"], F.lit(1), find["at"] - 1), F.lit("  "), rest)

    def step(state: Column, _: Column) -> Column:
        def after(find: Column) -> Column:
            found = F.concat(state["found"], F.array(find))
            return F.when(find.isNull(), F.struct(state["left"].alias("left"), state["found"].alias("found"), F.lit(False).alias("open"))).otherwise(F.struct(blanked(state, find).alias("left"), found.alias("found"), F.lit(True).alias("open")))

        return F.when(state["open"], let(first_find(state["left"]), after)).otherwise(state)

    start = F.struct(line.alias("left"), F.array().cast(f"array<{FIND}>").alias("found"), F.lit(True).alias("open"))
    return F.aggregate(steps, start, step, lambda state: state["found"])


def line_tags(lines: DataFrame, line_col: str = "line", no_col: str = "line_no") -> DataFrame:
    """tag, example, line_no, pos (below 0, in order) of what is broken or escaped in lines."""
    line = F.col(line_col)
    def named(found: Column, tag: str) -> Column:
        return F.transform(found, lambda x: F.struct(F.lit(tag).alias("tag"), x.alias("example")))

    escapes = [named(F.regexp_extract_all(line, F.lit(f"(?i){p}"), F.lit(0)), tag) for tag, p in ANYWHERE[:3]]
    other = F.filter(F.regexp_extract_all(line, F.lit(f"(?i){ANYWHERE[3][1]}"), F.lit(0)), lambda x: ~x.rlike(f"(?i)^{ANYWHERE[2][1]}$"))
    escapes.append(named(other, ANYWHERE[3][0]))
    kind = "array<struct<tag: string, example: string>>"
    odd = F.transform(broken(line), lambda x: F.struct(x["tag"], x["example"])).cast(kind)
    found = F.when(line.rlike(SUSPECT), odd).when(line.contains("&"), F.concat(*escapes).cast(kind))
    # outer: an inner one has a filter that searches the lines again
    every = lines.select(F.col(no_col).alias("line_no"), F.posexplode_outer(found).alias("k", "x")).where("x is not null")
    return every.select("x.tag", "x.example", "line_no", (F.col("k") - 1_000_000).alias("pos"))


def issues(lines: DataFrame, lang: str = "", long_min: int = LONG, examples: int = EXAMPLES, places: int = PLACES, line_col: str = "line", no_col: str = "line_no", raw_col: str | None = None) -> DataFrame:
    """With raw_col, the lines' bytes, tokens with ill-formed ones are told too. tag, n (of the tag), example, n_example, places (of the example, the first ones in order), rank (of the example by its first
    place); examples beyond the limit have no row, so that a tag with more has rank up to it and n_examples above."""
    rows = collapsed_lines(lines, line_col, no_col)
    tokens = rows.select(F.col(no_col).alias("line_no"), F.posexplode(F.split(line_col, " ")).alias("pos", "token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("n"), F.min(F.struct("line_no", "pos")).alias("first"))
    whole = counts.select("token", F.explode_outer(token_tags(F.col("token"), lang, long_min)).alias("x")).where("x is not null").select("token", "x.*")
    tagged = whole.unionByName(char_tags(counts.select("token"), lang, long_min)).groupBy("token", "tag", "example").agg(F.sum("times").alias("times"))
    if raw_col is not None:
        # kept like what follows: their bytes are read once
        odd = lonebytes.tokens(lines, raw_col, no_col).persist()
        tagged, tokens = tagged.unionByName(lonebytes.tagged(odd)), tokens.unionByName(odd)
        counts = tokens.groupBy("token").agg(F.count("*").alias("n"), F.min(F.struct("line_no", "pos")).alias("first"))
    # asked for several times below: kept in memory and on disk, so that no token is tagged and no line searched twice
    tagged, in_lines = tagged.persist(), line_tags(rows, line_col, no_col).persist()
    found = tagged.join(counts, "token").groupBy("tag", "example").agg(F.sum(F.col("n") * F.col("times")).alias("n"), F.min("first").alias("first"))
    found = found.unionByName(in_lines.groupBy("tag", "example").agg(F.count("*").alias("n"), F.min(F.struct("line_no", "pos")).alias("first")))
    found = found.persist()
    totals = found.groupBy("tag").agg(F.sum("n").alias("n"), F.count("*").alias("n_examples"))
    rank = F.row_number().over(Window.partitionBy("tag").orderBy("first", "example"))
    shown = found.select("tag", "example", F.col("n").alias("n_example"), rank.alias("rank")).where(F.col("rank") <= examples)
    order = Window.partitionBy("token").orderBy("line_no", "pos")
    # only tokens of shown examples are asked for places; the examples are few, their tokens (all that hold a character) need not be
    wanted = tagged.join(F.broadcast(shown.select("tag", "example")), ["tag", "example"], "left_semi")
    near = tokens.join(wanted.select("token"), "token", "left_semi").withColumn("r", F.row_number().over(order)).where(F.col("r") <= places)
    seen = near.join(wanted, "token").select("tag", "example", "line_no", "pos", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("_")).drop("_")
    seen = seen.unionByName(in_lines.join(shown, ["tag", "example"], "left_semi"))
    at = seen.withColumn("r", F.row_number().over(Window.partitionBy("tag", "example").orderBy("line_no", "pos"))).where(F.col("r") <= places)
    at = at.groupBy("tag", "example").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "line_no"))), lambda x: x["line_no"]).alias("places"))
    return shown.join(at, ["tag", "example"], "left").join(totals, "tag").select("tag", "n", "n_examples", "rank", "example", "n_example", "places")


def collapsed_lines(lines: DataFrame, line_col: str = "line", no_col: str = "line_no") -> DataFrame:
    """Lines with something in them, collapsed."""
    return lines.select(F.col(no_col).alias(no_col), collapsed(F.col(line_col)).alias(line_col)).where(F.col(line_col) != "")


def _distinct(lines: DataFrame, line_col: str, only_beyond: bool = False) -> DataFrame:
    """token, n; only_beyond: of tokens with a character beyond ASCII."""
    tokens = lines.select(F.explode_outer(F.split(line_col, " ")).alias("token"))
    if only_beyond:
        tokens = tokens.where(F.octet_length("token") > F.length("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("n"))


def _whole(tokens: DataFrame, lang: str, long_min: int) -> DataFrame:
    """tag, n, times of tokens as a whole."""
    # an outer explode has no filter that tags the tokens again
    return tokens.select("n", F.explode_outer(token_tags(F.col("token"), lang, long_min)).alias("x")).where("x is not null").select("x.tag", "n", "x.times")


def _inside(tokens: DataFrame, lang: str, long_min: int) -> DataFrame:
    """tag, n, times of characters in tokens."""
    return char_tags(tokens, lang, long_min).select("tag", "n", "times")


def _summed(found: DataFrame) -> DataFrame:
    return found.groupBy("tag").agg(F.sum(F.col("n") * F.col("times")).alias("n"))


def whole_counts(lines: DataFrame, lang: str = "", long_min: int = LONG, line_col: str = "line", no_col: str = "line_no") -> DataFrame:
    """tag, n of tokens as a whole."""
    return _summed(_whole(_distinct(collapsed_lines(lines, line_col, no_col), line_col), lang, long_min))


def character_counts(lines: DataFrame, lang: str = "", long_min: int = LONG, line_col: str = "line", no_col: str = "line_no") -> DataFrame:
    """tag, n of the characters beyond ASCII in tokens that are not done with by one look."""
    # a token without such a character is not counted
    rows = collapsed_lines(lines, line_col, no_col)
    return _summed(_inside(_distinct(rows.where(F.octet_length(line_col) > F.length(line_col)), line_col, only_beyond=True), lang, long_min))


def inside_names() -> frozenset[str]:
    """Tags that char_tags() can give."""
    kinds = {tag for _, _, tag in D.ranges()} | {"OTHER_CHAR", "LANGUAGE_SPECIFIC", "INITIAL_BYTE_ORDER_MARK"}
    return frozenset(kinds | {f"{tag}_CHAR" for tag in kinds} | set(D.LETTERS.values()))


#: Tags that line_tags() gives; those of whole tokens are others.
LINE_TAGS = frozenset(tag for tag, _, _ in RULES)


def counts(lines: DataFrame, lang: str = "", long_min: int = LONG, line_col: str = "line", no_col: str = "line_no", only: frozenset[str] | None = None) -> DataFrame:
    """tag, n: how often each tag counts. only: these tags alone, so that what can give none of them is not looked at."""
    rows = collapsed_lines(lines, line_col, no_col)
    asked = (lambda names: True) if only is None else (lambda names: bool(only & names))
    parts = []
    if only is None or only - LINE_TAGS:
        tokens = _distinct(rows, line_col)
        parts.append(_whole(tokens, lang, long_min))
        if asked(inside_names()):
            parts.append(_inside(tokens, lang, long_min))
    if asked(LINE_TAGS) or not parts:
        parts.append(line_tags(rows, line_col, no_col).select("tag", F.lit(1).cast("long").alias("n"), F.lit(1).alias("times")))
    found = reduce(DataFrame.unionByName, parts)
    return _summed(found if only is None else found.where(F.col("tag").isin(*only)))


def ill_formed(raw: DataFrame, raw_col: str = "raw") -> DataFrame:
    """tag, n of tokens with ill-formed bytes, from lines as bytes: NON_UTF8, and UTF8_NON_SHORTEST for over-long forms."""
    odd = lonebytes.tokens(raw.select(F.lit(0).alias("line_no"), raw_col), raw_col)
    return odd.join(lonebytes.tagged(odd), "token").groupBy("tag").agg(F.count("*").alias("n"))


def printed(found: DataFrame, lang: str = "", all_tags: bool = False, long_min: int = LONG, examples: int = EXAMPLES, places: int = PLACES, ids: bool = False, n_tokens: int = 0, n_lines: int = 0) -> str:
    """The report of issues(): at most `examples` rows a tag come to the driver. ids: places are ids, not line numbers."""
    rows: dict[str, list] = {}
    for r in found.collect():
        rows.setdefault(r.tag, []).append(r)

    def counted(n: int, noun: str) -> str:
        return f"{n} {noun}" if n == 1 else f"{n} {noun}s"

    out = ["Encoding, script, and tokenization analysis:", f"Analysed {n_tokens} tokens in {n_lines} lines" + (f" (language code: {lang})" if lang else "")]
    for tag, text in D.TAGS.items():
        text = text.format(long_min=long_min)
        if tag not in rows:
            if all_tags:
                out += ["", f"{text} (0 instances)"]
            continue
        out += ["", f"{text} ({counted(rows[tag][0].n, 'instance')})"]
        if lang in D.NORMAL.get(tag, "").split():
            out.append(f"Note: such characters are normal for specified language ({lang})" if all_tags else f"  No examples shown, as such characters are normal for specified language ({lang})")
            if not all_tags:
                continue
        for r in sorted(rows[tag], key=lambda r: (-r.n_example, r.example.lower())):
            where = ", ".join(map(str, r.places or []))
            where = f"; {'' if ids else 'lines ' if ', ' in where else 'line '}{where}{', ...' if r.n_example > places else ''}" if where and places else ""
            out.append(f"  {r.example} ({counted(r.n_example, 'instance')}{where})")
        if rows[tag][0].n_examples > examples:
            out.append("  ...")
    return "\n".join(out) + "\n"
