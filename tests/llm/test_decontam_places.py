from glyphmill.llm import decontam


def test_adjacent_places_have_a_row_each():
    words = [f"w{k}" for k in range(20)]
    item = " ".join(words)
    near = " ".join(["x", *words[1:10], "y", *words[11:]])
    index = decontam.Index([(7, item)])
    assert index.find((item + " ") * 300) == [(7, 0, 20 * k, 20) for k in range(1, 301)]
    assert index.find(near + " " + item) == [(7, 2, 20, 20), (7, 0, 40, 20)]
    assert index.find(f"a b {item} c {item}") == [(7, 0, 22, 20), (7, 0, 43, 20)]
    assert index.find(f"a {near} b") == [(7, 2, 21, 20)]


def test_short_items_are_held_where_their_words_stand(spark):
    items = spark.createDataFrame([(1, "one two three four"), (2, "Two"), (3, "x x"), (4, " "), (5, "four five")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so one TWO three four five"), (2, "x x x x x two"), (3, "one two three and four"), (4, "five four")], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.distance, r.end_word) for r in decontam.matches(docs, items).collect())
    assert got == [(1, 1, 0, 5), (1, 2, 0, 3), (1, 5, 0, 6), (2, 2, 0, 6), (2, 3, 0, 2), (2, 3, 0, 4), (3, 2, 0, 2)]
    assert [r.doc_id for r in decontam.clean(docs, items).collect()] == [4]
