"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import bfd, collocations, decontam, fim, langid, license, lm, media, minhash, packing, toxicity, urlrules, warc
from glyphmill.llm.common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.resolved(warc.read(warc.write(table(spark, sf_dir, "pages")), payloads=False))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm.score(table(spark, sf_dir, "documents"))
    return scores.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op3_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=~toxicity.held_out("id"))
    return toxicity.score(docs, model, held_out=toxicity.held_out())


def op4_best_fit_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bfd.write(table(spark, sf_dir, "documents")).select("doc_ids", "doc_starts", "cu_seqlens", "position_resets", "n_tokens", "ids_crc32")


#: The fixed rules: verdict, host, path prefix.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op5_association_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urlrules.judge(pages, urlrules.mine(pages, table(spark, sf_dir, "labels")), URL_RULES)


def op6_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_nearest_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, learn=~langid.held_out())
    return langid.identify(docs, model, held_out=langid.held_out())


def op8_avi_motion_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.to_media(table(spark, sf_dir, "documents")))


def op9_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, sf_dir, "documents")))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.components(table(spark, sf_dir, "documents"))


def op11_license_containment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scanned(table(spark, sf_dir, "documents")).drop("found")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.transformed(table(spark, sf_dir, "documents")))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mined(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_warc, op2_stupid_backoff, op3_counterfactual_toxicity, op4_best_fit_packed_ids, op5_association_url_rules, op6_cgk_decontamination, op7_nearest_centroid_language, op8_avi_motion_jpeg, op9_sum_of_squares_packing, op10_minhash_near_dedup, op11_license_containment_join, op12_fill_in_middle, op13_phrase_collocations)}
#: Trigrams by joins, without chunks: each place takes the longest context that is seen.
_STUPID_BACKOFF = r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w FROM documents),
        p AS (SELECT r, i, w[i] AS a, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS c FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
        n1 AS (SELECT a, count(*) AS n FROM p GROUP BY a),
        n2 AS (SELECT b, a, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY b, a),
        n3 AS (SELECT c, b, a, count(*) AS n FROM p WHERE c IS NOT NULL GROUP BY c, b, a),
        s AS (SELECT r, CASE WHEN n3.n >= 1 THEN ln(n3.n / context.n) ELSE CASE WHEN p.c IS NULL THEN 0 ELSE ln(0.4) END
                + CASE WHEN n2.n >= 1 THEN ln(n2.n / before.n) ELSE CASE WHEN p.b IS NULL THEN 0 ELSE ln(0.4) END + ln(n1.n / (SELECT count(*) FROM p)) END END AS s
            FROM p JOIN n1 USING (a) LEFT JOIN n2 ON n2.a = p.a AND n2.b = p.b LEFT JOIN n3 ON n3.a = p.a AND n3.b = p.b AND n3.c = p.c
                LEFT JOIN n1 AS before ON before.a = p.b LEFT JOIN n2 AS context ON context.a = p.b AND context.b = p.c)
        SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, round(coalesce(t.s, 0), 4) AS log_score, round(t.s / len(w), 6) AS mean_log_score
            FROM d LEFT JOIN (SELECT r, sum(s) AS s FROM s GROUP BY r) AS t USING (r)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _values(rows: list[tuple[str, str]]) -> str:
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in rows)


def _words(text: str) -> str:
    return rf"regexp_extract_all(translate({text}, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


#: Every block held against every template, without the filters.
_LICENSES = f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
        p AS (SELECT label, {_words('phrase')} AS words FROM (VALUES {_values(license.BASE)}) AS x(phrase, label)),
        b AS (SELECT r, label, i - 1 AS place FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d) JOIN p ON w[i] = words[1] AND w[i:i + len(words) - 1] = words),
        t AS (SELECT label, list_distinct(words) AS words, (2 ** ceil(log2(len(words))))::INT AS n FROM (SELECT label, {_words('text')} AS words FROM (VALUES {_values(license.TEMPLATES)}) AS x(label, text))),
        k AS (SELECT r, label, len(list_intersect(w[place + 1:place + 2 * n], words)) AS shared, len(words) AS size FROM (SELECT r, w, label, words, n, unnest(range(0, len(w), n)) AS place FROM d, t)),
        m AS (SELECT * FROM k WHERE 100 * shared >= {license.THRESHOLD} * size),
        bd AS (SELECT r, count(*) AS n, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM b GROUP BY r),
        l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM b UNION ALL SELECT r, label FROM m) GROUP BY r),
        s AS (SELECT r, max(shared / size) AS score FROM m GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(bd.n, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(bd.labels, '') AS base_labels,
            coalesce(l.labels, '') AS labels, CASE WHEN bd.n > 0 THEN 1.0::DOUBLE ELSE coalesce(s.score, 0)::DOUBLE END AS score
            FROM d LEFT JOIN bd USING (r) LEFT JOIN l USING (r) LEFT JOIN s USING (r)"""
_FILL_IN_MIDDLE = r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
        u AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units, [('0x' || substr(x, 8 * k + 1, 8))::BIGINT FOR k IN range(4)] AS h FROM d),
        c AS (SELECT *, len(units) AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS a, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS z,
            CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
        p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:z], '') AS middle, array_to_string(units[z + 1:], '') AS suffix FROM c)
        SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
            sha256(text) AS restored_sha256 FROM p"""
#: Phrases by windows of words, without pointers or prefixes.
_COLLOCATIONS = rf"""
        WITH pieces AS (SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
        words AS (SELECT p, lang, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM pieces),
        places AS (SELECT lang, x, lead(x) OVER piece AS y, lead(x, 2) OVER piece AS z FROM words WINDOW piece AS (PARTITION BY p ORDER BY i)),
        f AS (SELECT lang, x AS phrase, 1 AS m, count(*) AS f FROM places GROUP BY ALL
            UNION ALL SELECT lang, x || ' ' || y AS phrase, 2 AS m, count(*) AS f FROM places WHERE y IS NOT NULL GROUP BY ALL
            UNION ALL SELECT lang, x || ' ' || y || ' ' || z AS phrase, 3 AS m, count(*) AS f FROM places WHERE z IS NOT NULL GROUP BY ALL),
        n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
        cand AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 10),
        cuts AS (SELECT lang, phrase, m, a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp FROM cand, (VALUES (1), (2)) AS x(k) WHERE k < m),
        s AS (SELECT cuts.lang, cuts.phrase, cuts.m, a, k, lf.f AS l, rf.f AS r, ((1000000::HUGEINT * a * a) // (lf.f::HUGEINT * rf.f))::BIGINT AS score
            FROM cuts JOIN f AS lf ON lf.lang = cuts.lang AND lf.phrase = lp JOIN f AS rf ON rf.lang = cuts.lang AND rf.phrase = rp),
        low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        longer AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM cand WHERE m = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' ') AS phrase, a FROM cand WHERE m = 3) GROUP BY lang, phrase),
        kept AS (SELECT low.* FROM low LEFT JOIN longer USING (lang, phrase) WHERE longer.a IS NULL OR 100 * longer.a < 50 * low.a)
        SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang) WHERE rank <= 2000"""
ORACLE_SQL: dict[str, str] = {
    "op11_license_containment_join": _LICENSES,
    "op12_fill_in_middle": _FILL_IN_MIDDLE,
    "op13_phrase_collocations": _COLLOCATIONS,
    "op2_stupid_backoff": _STUPID_BACKOFF,
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x FROM p),
        g AS (SELECT *, count(*) OVER (PARTITION BY x) AS n, max(page_id) OVER (PARTITION BY x) AS last FROM d),
        bits AS (SELECT page_id, i, list_sum([CASE WHEN substr(bin, 5 * i + k, 1) = '1' THEN 1 << (5 - k) ELSE 0 END FOR k IN [1, 2, 3, 4, 5]])::INT AS v
            FROM (SELECT page_id, array_to_string([lpad(bin(('0x' || substr(x, c, 1))::INT), 4, '0') FOR c IN range(1, 41)], '') AS bin FROM d), range(32) t(i)),
        s AS (SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v + 1, 1), '' ORDER BY i) AS payload_digest FROM bits GROUP BY page_id)
        SELECT g.page_id, payload_bytes, payload_digest, CASE WHEN n > 1 AND g.page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN n > 1 AND g.page_id <> last THEN last END AS refers_to FROM g JOIN s USING (page_id)""",
}
