from glyphmill.operators import summary

CASES = [
    ("e\u0301 e\u0301 plain", "1 non-canonical character combination (2 instances)"),
    ("e\u0301 \u1112\u1161\u11ab", "2 letter scripts: HANGUL_JAMO, LATIN; 1 non-canonical character combination (1 instance)"),
    ("5 \u0663", "2 number scripts: ASCII_DIGIT, ARABIC_INDIC_DIGIT"),
    ("5 5 \u00bd", ""),
    ("ab\u0915\u0916\u0917", "2 letter scripts: DEVANAGARI, LATIN; multi-script word"),
    ("ab \u0c15\u0c16\u0c17", "2 letter scripts: TELUGU, LATIN"),
    ("\u0a95 \u1780 \u0d9a \u1000", "4 letter scripts: GUJARATI, SINHALA, MYANMAR, KHMER"),
    ("a \u0640", "Tatweel"),
    ("\u0643 \u06a9", "1 character set conflict"),
    ("\u0001&lt;", "C0_CONTROL; XML escape token"),
    (None, ""),
    ("", ""),
    ("plain", ""),
]


def test_line_of_each_row(spark):
    """Rows with equal or null ids keep a line each."""
    df = spark.createDataFrame([(k or None, t) for k, (t, _) in enumerate(CASES)] + [(1, "plain")], "doc_id long, text string")
    got = summary.issues(df).collect()
    assert [r.issues for r in got] == [x for _, x in CASES] + [""]
    assert [r.doc_id for r in got] == [None, *range(1, len(CASES)), 1]


def test_line_of_a_document_in_lines(spark):
    rows = [("x", "ab 5"), ("x", "\u0436\u0437\u0438 \u0663"), ("x", "e\u0301"), ("x", "\u0643"), ("x", "\u06a9 e\u0301"), ("y", "plain"), ("y", None), ("z", "")]
    got = {r.doc_id: r.issues for r in summary.by_document(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"x": "3 letter scripts: LATIN, CYRILLIC, ARABIC; 2 number scripts: ASCII_DIGIT, ARABIC_INDIC_DIGIT; 1 non-canonical character combination (2 instances); 1 character set conflict", "y": "", "z": ""}
