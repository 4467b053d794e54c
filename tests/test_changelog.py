from pyspark.sql import functions as F

from glyphmill import __main__ as program
from glyphmill import catalog, catalog_steps
from glyphmill.operators import changelog, normalize

LINES = [catalog_steps.mixed_pieces()[0], "plain", "", None, "a\u0640b  \t", "\u06a9\u0643\u064a\u06cc 12\u0628", "Aust\u0456n \u0436\u0259\u043d\u0435 CTV\u0442\u0435\u043b\u0435\u0430\u0440\u043d\u0430\u0441\u044b\u043d\u0430 X\u0406 ab.\u0433\u0434\u0436", "x &amp;lt; %25C3%25AB"]


def stepwise(spark, lines, lang):
    """Calls and changes by one job a step, each on the rows that the job before it gave."""
    rows, out = [(k, t, t) for k, t in enumerate(lines) if t is not None], {}
    for s in normalize.STEPS:
        df = spark.createDataFrame(rows, "k int, orig string, now string")
        got = df.select("k", "orig", "now", s.gate(F.col("orig"), lang).alias("open"), s.apply(F.col("now")).alias("new")).collect()
        out[s.name] = (sum(r.open for r in got), sum(r.open and r.new != r.now for r in got))
        rows = [(r.k, r.orig, r.new if r.open else r.now) for r in got]
    return out | {"all": (len(rows), sum(o != n for _, o, n in rows))}


def test_log_of_every_step(spark):
    for lang, idle in (("", {"farsi-char", "pashto-char"}), ("fas", {"arabic-char", "pashto-char"}), ("pas", {"arabic-char", "farsi-char"})):
        df = spark.createDataFrame([(t,) for t in LINES], "text string")
        log = changelog.change_log(df, normalize.chosen("all"), lang).orderBy("place").collect()
        got = {r.step: (r.n_calls, r.n_changed) for r in log if not r.step.startswith("look-alike ")}
        assert list(got) == ["all", *normalize.NAMES] and got == stepwise(spark, LINES, lang)
        assert {s for s, (_, changed) in got.items() if not changed} == idle


def test_look_alike_words_by_outcome(spark):
    df = spark.createDataFrame([(LINES[6],), ("plain",)], "text string")
    log = changelog.change_log(df, frozenset({"look-alike"}))
    assert {r.step: (r.n_calls, r.n_changed) for r in log.collect()} == {"all": (2, 1), "look-alike": (1, 1), "look-alike to-Latin": (5, 2), "look-alike to-Cyrillic": (5, 1), "look-alike to-Greek": (5, 0), "look-alike split": (5, 1), "look-alike unchanged": (5, 1), "repair-url-escapes": (0, 0)}
    assert changelog.printed(log) == "1 out of 2 line changed; look-alike in 1/1 line (2/1/0/1/1 L/C/G/S/-)"
    assert {r.step: (r.n_calls, r.n_changed) for r in changelog.change_log(df.limit(0), frozenset()).collect()} == {"all": (0, 0), "repair-url-escapes": (0, 0)}


def test_registered_log_covers_all_steps(spark, tmp_path):
    spark.createDataFrame([(2, "x\ny"), (3, "a\u0640b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.step: (r.n_calls, r.n_changed) for r in catalog.QUERIES["change_log_by_step"](spark, str(tmp_path)).collect()}
    assert set(normalize.NAMES) < got.keys() and got["all"] == (3, 2) and got["del-tatweel"] == (2, 2) and got["hangul"][1] == 2


def test_program_prints_the_log(spark, tmp_path, capsys):
    (tmp_path / "t.txt").write_text("a\u0640b &amp;lt;\nplain \n")
    program.main(["norm", str(tmp_path / "t.txt"), str(tmp_path / "out"), "-v"])
    assert "1 out of 2 line changed; del-tatweel in 1/1 line; repair-xml in 1/1 line" in capsys.readouterr().out


def test_lines_of_the_same_words_go_through_the_steps_once(spark):
    """Lines whose odd words and classes of characters are the same, whatever else they hold, are counted and numbered one by one."""
    rows = [(k, f"line {k} of a\u0640b") for k in range(30)] + [(30, "\u0430b\u0434\u0436 x"), (31, "a\u0640b &amp;lt;"), (5, "a\u0640b"), (40, "plain"), (41, None)] + [(50 + k, "y \u0430b\u0434\u0436") for k in range(3)]
    df = spark.createDataFrame(rows, "line_no long, text string")
    states, _ = changelog._states(df, normalize.chosen("all"), "", "text", None)
    assert sorted((r.n, r._text.strip()) for r in states.select("n", "_text").collect()) == [(1, ""), (1, "a\u0640b"), (1, "a\u0640b &amp;lt;"), (1, "\u0430b\u0434\u0436"), (3, "\u0430b\u0434\u0436"), (30, "a\u0640b")]
    log = {r.step: (r.n_calls, r.n_changed) for r in changelog.change_log(df, normalize.chosen("all")).collect()}
    assert (log["all"], log["del-tatweel"], log["repair-xml"], log["look-alike unchanged"]) == ((37, 32), (32, 32), (1, 1), (4, 4))
    first = {r.step: r.lines for r in changelog.first_lines(df, normalize.chosen("all"), k=7).collect()}
    assert first["del-tatweel"] == [0, 1, 2, 3, 4, 5, 5] and first["repair-xml"] == [31]
    assert [(r.word, r.n) for r in changelog.unchanged_words(df, normalize.chosen("all")).collect()] == [("\u0430b\u0434\u0436", 4)]
