from pyspark.sql import functions as F

from weftline.functions import text as tx


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "text string").select(expr(F.col("text")).alias("x")).first()["x"]


def test_headings(spark):
    level = lambda s: one(spark, s, tx.heading_level)
    assert [level(s) for s in ("# A", "### A b ##", "1 Intro here", "1.2.3 Deep one", "plain", "2020 was a year", "#no", "1.2 ab", None)] == [1, 3, 1, 3, None, 1, None, None, None]
    assert one(spark, "## Title ##", tx.heading_title) == "Title"
    assert one(spark, "1.2 Some part", tx.heading_title) == "1.2 Some part"


def test_strategy(spark):
    assert one(spark, "# A\nx\n# B", lambda c: tx.select_strategy(c, True)) == "structural"
    assert one(spark, "# A\nx", lambda c: tx.select_strategy(c, True)) == "semantic"
    assert one(spark, None, lambda c: tx.select_strategy(c, False)) == "structural"


def test_references_and_keys(spark):
    text = "See [1, 2] and [2;3], (Smith et al. 2019), doi:10.1234/AbC and https://x.org/a). Again https://x.org/a"
    assert one(spark, text, tx.extract_references) == ["[1, 2]", "(Smith et al. 2019)", "doi:10.1234/AbC", "https://x.org/a"]
    assert sorted(one(spark, text, tx.citation_keys)) == ["doi:10.1234/abc", "ref:1", "ref:2", "ref:3", "url:https://x.org/a"]
    assert one(spark, None, tx.citation_keys) == []


def test_parsers(spark):
    assert one(spark, "1. What?\n\n- Why?\n3) How?", lambda c: tx.parse_questions(c, 2)) == ["What?", "Why?"]
    assert one(spark, '{"concepts": [" B ", "a", "b", null]}', tx.parse_concepts) == ["a", "b"]
    assert one(spark, "not json", tx.parse_concepts) == []
    got = one(spark, "Ada Lovelace | PERSON\nnothing\nX|Y|Z", tx.parse_entities)
    assert [(e["text"], e["label"], e["normalized"]) for e in got] == [("Ada Lovelace", "PERSON", "ada lovelace"), ("X", "Y|Z", "x")]


def test_small_functions(spark):
    assert one(spark, "/a/b/c.TXT", tx.suffix) == ".txt"
    assert one(spark, "/a/b/c.TXT", tx.basename) == "c.TXT"
    assert one(spark, "fr", tx.language_name) == "French" and one(spark, "xx", tx.language_name) == "xx"
    assert one(spark, "der Hund und die Katze mit dem Ball", tx.detect_language) == "de"
    assert one(spark, "kurz", tx.detect_language) == "en"
    rows = spark.createDataFrame([([["a", None], ["", " "], ["b", "c "]],)], "r array<array<string>>")
    assert rows.select(tx.table_to_md(F.col("r")).alias("x")).first()["x"] == "a | \nb | c"
    sections = spark.createDataFrame([(["A", "B"], "d", 3), ([], "d", 3), ([], None, 3)], "p array<string>, d string, i int")
    assert [r[0] for r in sections.select(tx.section_label(F.col("p"), F.col("d"), F.col("i"))).collect()] == ["B", "d", "chunk 3"]
