import random

import corpus_pipeline
from glyphmill.llm.tokens import Encoder


def test_stages_take_out_what_they_should(spark, tmp_path):
    r = random.Random(12)
    en, de = "the and of to in is that it was for on with they this have from".split(), "der die und in den von zu das mit sich des auf für ist nicht über".split()
    rows, labels = [], []
    for k in range(160):
        w = [r.choice(en if k % 3 else de) + r.choice(["", "", "ly", "er"]) for _ in range(r.randint(30, 80))]
        toxic = k % 5 == 0
        if toxic:
            w[4:4] = ["vile"] * 2
        rows.append((k, " ".join(w), "en" if k % 3 else "de", "s", 1))
        labels.append((k, 1, int(toxic)))
    items = [(k, " ".join(f"item{k}x{j}" for j in range(30))) for k in range(3)]
    clean = {k for k in range(160) if k % 5}
    rows += [(200, rows[1][1], "en", "s", 1), (201, rows[1][1] + " more", "en", "s", 1), (202, "the of and it " + items[0][1] + " they have the of", "en", "s", 1), (203, None, "en", "s", 1), (204, "12 34", "en", "s", 1), (1, rows[1][1], "en", "s", 1)]
    for name, data, schema in (("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in got} == clean
    e = Encoder()
    text = {k: t for k, t, *_ in rows}
    for k in clean:
        assert sum(x.length for x in got if x.doc_id == k) == len(e.ids(text[k]))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == list(corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long"), str(tmp_path)).count() == 0
