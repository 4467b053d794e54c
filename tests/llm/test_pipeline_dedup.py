import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def kept(spark, rows):
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], SCHEMA)
    return sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()), key=str)


def words(name, n):
    return " ".join(f"{name}{k}" for k in range(n))


def test_near_dedup_takes_five_words_and_80_percent(spark):
    """40 words after 200: 196 of 236 shingles of five words in common."""
    long = words("a", 200) + " " + words("more", 40)
    assert kept(spark, [(1, words("a", 200)), (2, long), (3, words("a", 200) + " " + words("x", 60))]) == [(1, words("a", 200)), (3, words("a", 200) + " " + words("x", 60))]
    short = words("b", 100).split()
    other = [*short]
    for k in (20, 50, 80):
        other[k] = "x"
    # three of 100 words differ: 3-word J 89 / 107, 5-word J 81 / 111
    assert len(kept(spark, [(4, " ".join(short)), (5, " ".join(other))])) == 2


def test_near_dedup_of_clashing_and_null_ids(spark):
    """A text goes only with a copy of it: ids that clash take no other text along, and copies under null ids go."""
    a, b, c, d, e = (words(x, 40) for x in "abcde")
    assert kept(spark, [(1, a), (2, a + " more"), (2, b), (3, c), (3, d), (3, d), (None, e), (None, e), (None, c), (None, words("f", 40)), (4, "")]) == sorted([(1, a), (2, b), (3, c), (3, d), (None, e), (None, words("f", 40)), (4, "")], key=str)


def test_columns_with_the_names_that_stages_use(spark, tmp_path):
    """Extra columns stay, and clash with nothing; of rows equal in id and text the first by its columns stays."""
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, words("item", 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = "_key key _gone again _language _toxic group component_id n cls".split()
    texts = [words("a", 40), words("a", 40), words("b", 40), words("b", 40), words("c", 3) + " " + words("item", 30)]
    rows = [(k // 2 if k in (2, 3) else k, t, "en", "s", k, *[f"{k}{c}" for c in names]) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA + "".join(f", {c} string" for c in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    got = corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_chars, r["_key"], r["_gone"]) for r in got) == [(0, 0, "0_key", "0_gone"), (1, 2, "2_key", "2_gone"), (4, 4, "4_key", "4_gone")]
    clean = corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()
    assert sorted(r.n_chars for r in clean) == [0, 1, 2, 3]
