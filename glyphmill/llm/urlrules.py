"""URL filters (5), native: association rules over URL tokens, mined by FP-growth from labelled pages.

mine(pages, labels) makes a transaction of each labelled URL (the tokens of host, path and the rest, marked h:, p:, q:) and
of the item BLOCKED where its label says so (quality 0 or toxic 1), mines frequent sets with Spark's FP-growth, and
keeps the minimal rules tokens -> BLOCKED of MIN_CONFIDENCE, MIN_SUPPORT (and MIN_COUNT URLs) and LIFT or more: a rule that a
smaller one makes needless is not kept. What can't be in a minimal rule is not mined, so that many tokens in common (a
trap's parameters) make few sets: tokens in too few blocked URLs, tokens that are a rule alone, and of tokens that always
occur together all but one, which stands for the set. judge(pages, rules) matches rules by an inverted index: a rule stands under its rarest token, a URL's tokens are joined to the index, and the rule fits if the URL
has all of its tokens, once for each different URL. What is known of URLs with many rows is broadcast to these (see common.lookup). Fixed rules for a host and its subdomains and a path prefix go first; the longest wins.

Only DataFrame and ML functions of the JVM run here. The rules are broadcast if they are RULES_BROADCAST at most, else
joined by shuffle. Null URLs are in no join.

Cases. Null URL or no `://`: host and path empty, no tokens, allowed. Null ids: never learned from, judged by URL. Labels given
twice: blocked if any says so. No labels, or no rule: all that no fixed rule fits is allowed. Repeated rows: a row each.
Equal longest rules: the first given. Very long URLs: each different token once. Empty tables: no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import Scratch, lookup, stored

MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE, LIFT, RULES_BROADCAST = 0.002, 8, 0.6, 1.5, 50_000
BLOCKED = "=blocked"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES_SCHEMA = "tokens array<string>, confidence double, lift double, support double, token string"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct marked tokens."""
    rest = F.regexp_extract(url, r"://[^?#]*(.*)", 1)
    def marked(mark: str, x: Column) -> Column:
        return F.transform(F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda t: F.concat(F.lit(mark), t))

    parts = [marked("h:", host_of(url)), marked("p:", path_of(url)), marked("q:", rest)]
    return F.coalesce(F.array_distinct(F.concat(*parts)), F.array().cast("array<string>"))


def mine(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", blocked: Column | None = None, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE, lift: float = LIFT) -> DataFrame:
    """Rules: tokens, confidence, lift, support, token (the rarest). blocked: a condition on a label row."""
    blocked = (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))) if blocked is None else blocked
    marked = labels.select(F.col(label_id).alias("id"), blocked.alias("bad")).where("id is not null").groupBy("id").agg(F.max("bad").alias("bad"))
    urls = pages.select(F.col(id_col).alias("id"), tokens_of(F.col(url_col)).alias("tokens")).where("id is not null and size(tokens) > 0")
    bad = F.col("bad")
    with Scratch(pages.sparkSession) as t:
        rows = t.stored(urls.join(marked, "id").select(F.monotonically_increasing_id().alias("row"), "tokens", "bad"), "baskets")
        n, blocked_rows = rows.agg(F.count("*"), F.sum(bad.cast("long"))).first()
        if not blocked_rows:
            return pages.sparkSession.createDataFrame([], RULES_SCHEMA)
        least = max(min_support * n, min_count)
        confidence, lifted = F.col("both") / F.col("freq"), F.col("both") / F.col("freq") / (blocked_rows / n)
        good = (confidence >= min_confidence) & (lifted >= lift)
        each = rows.select("row", "bad", F.explode("tokens").alias("token"))
        # tokens of the same rows have the same count and sums of hashes of the rows
        sums = F.count("*").alias("freq"), F.sum(bad.cast("long")).alias("both"), F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y")
        items = each.groupBy("token").agg(*sums).where(F.col("both") >= least).groupBy("freq", "both", "x", "y").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
        items = t.stored(items.select(F.col("tokens")[0].alias("token"), "tokens", "freq", "both", good.alias("rule")), "items")
        alone = items.where("rule").select(F.array("token").alias("set"), "freq", "both")
        kept = each.join(items.where("not rule").select("token"), "token").groupBy("row", "bad").agg(F.collect_list("token").alias("tokens"))
        baskets = t.stored(kept.select(F.when(bad, F.array_append("tokens", F.lit(BLOCKED))).otherwise(F.col("tokens")).alias("items")), "baskets")
        found = alone
        if not baskets.isEmpty():
            # the support is a share of the baskets that are left
            sets = t.stored(FPGrowth(itemsCol="items", minSupport=min(1.0, least / baskets.count()), minConfidence=min_confidence).fit(baskets).freqItemsets, "sets")
            with_label = sets.where(F.array_contains("items", BLOCKED) & (F.size("items") > 2)).select(F.array_sort(F.array_remove("items", BLOCKED)).alias("set"), F.col("freq").alias("both"))
            of = sets.where(~F.array_contains("items", BLOCKED)).select(F.array_sort("items").alias("set"), "freq")
            found = found.unionByName(with_label.join(of, "set").where(good).select("set", "freq", "both"))
        found = t.stored(found, "found")
        member = found.select("set", F.explode("set").alias("token"))
        # a rule within another is found by the tokens they share
        pairs = member.join(member.select("token", F.col("set").alias("other")), "token").where("size(other) < size(set)").groupBy("set", "other").agg(F.count("*").alias("shared")).where("shared = size(other)")
        minimal = found.join(pairs.select("set").distinct(), "set", "left_anti")
        whole = minimal.select("set", "freq", "both", F.explode("set").alias("token")).join(items.select("token", "tokens", F.col("freq").alias("of")), "token")
        rules = whole.groupBy("set", "freq", "both").agg(F.array_sort(F.flatten(F.collect_list("tokens"))).alias("tokens"), F.min(F.struct("of", "token")).alias("r"))
        return stored(rules.select("tokens", confidence.alias("confidence"), lifted.alias("lift"), (F.col("both") / n).alias("support"), F.col("r.token").alias("token")), "rules")


def judge(pages: DataFrame, rules: DataFrame, fixed: Sequence[tuple[str, str, str]] = (), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, confidence per row. fixed: (verdict, host, path prefix)."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    index = F.broadcast(rules) if rules.limit(RULES_BROADCAST + 1).count() <= RULES_BROADCAST else rules
    urls = stored(rows.where("url is not null").groupBy("url").agg(F.count("*").alias("times")), "urls")
    asked = urls.select("url", tokens_of(F.col("url")).alias("has")).select("url", "has", F.explode("has").alias("token"))
    hits = asked.join(index, "token").where(F.forall("tokens", lambda t: F.array_contains("has", t))).groupBy("url").agg(F.max("confidence").alias("confidence"))
    known = stored(urls.join(hits, "url", "left"), "judged")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, host, path in sorted(reversed(fixed), key=lambda r: len(r[1] + r[2])):  # the longest, of these the first, is put outermost
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    judged = lookup(rows.where("url is not null"), known, "url", "times").drop("times").unionByName(rows.where("url is null").withColumn("confidence", F.lit(None).cast("double")))
    out = judged.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "confidence")
    mined = F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, mined).alias("verdict"), "confidence")
