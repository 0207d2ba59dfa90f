"""Functions on strings and columns, by hand and against other engines."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from millrace.functions import identifiers as I
from millrace.functions import text as X
from millrace.functions import vectors as V
from millrace.functions.stemming import analyzed


@pytest.mark.parametrize(
    ("query", "out"),
    [
        ("getUserName", "get User Name getUserName"),
        ("XMLParser", "XML Parser XMLParser"),
        ("get_user_name", "get user name get_user_name"),
        ("React.useState", "React use State React.useState"),
        ("plain words", "plain words"),
        ("find getUser now", "find get User getUser now"),
        ("", ""),
        ("_private", "_private"),
        ("a..b", "a  b a..b"),
    ],
)
def test_expansion(query, out):
    assert I.expand(query) == out


def test_expansion_of_columns(spark):
    words = ["getUserName", "XMLParser", "get_user_name", "plain", "_private", "HTTPServer2"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(I.expanded(F.col("w"))).collect()] == [I.expand(w) for w in words]
    assert [r[0] for r in df.select(I.identifier_flag(F.col("w"))).collect()] == [I.is_identifier(w) for w in words]


def test_match_strings():
    assert I.search_terms('foo AND "bar" (baz) don\'t snake_case') == ["foo", "AND", "bar", "baz", "don't", "snake_case"]
    assert I.match("a b", "and").fts() == '"a" "b"' and I.match("a b", "or").fts() == '"a" OR "b"'
    assert I.match("a", "or") == I.match("a", "and") and I.match(" ?! ", "or") is None


def test_content_types(spark):
    paths = ["a.ts", "b.TSX", "c.mjs", "readme.md", "noext", "x.ts.txt", "dir.js/file"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(I.content_type_column(F.col("p"))).collect()] == [I.content_type(p) for p in paths] == ["code", "code", "code", "markdown", "markdown", "markdown", "markdown"]


def test_stems_equal_a_full_text_engine():
    words = "running ponies caresses relational conditional hopping falling filing agreed plastered motoring sky happy cement replacement adoption probate rate cease controlling roll analogies operator feudalism hopefulness sensibility triplicate electricity electrical goodness revival allowance inference adjustable irritant dependent homologou activate bowdlerize über naïve straße ünïts the oed sing trouble generalizations don't snake_case x1y2".split()
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x, tokenize='porter unicode61')")
    db.execute("create virtual table v using fts5vocab(t, 'row')")
    for w in words:
        db.execute("delete from t")
        db.execute("insert into t values (?)", (w,))
        assert sorted(set(analyzed(w))) == [r[0] for r in db.execute("select term from v order by term")], w


def test_headings(spark):
    text = "# One\ntext\n```\n# code\n```\n##  Two \n#none\n####### seven\n### Three"
    assert spark.createDataFrame([(text,)], "t string").select(X.headings(F.col("t"))).first()[0] == "One\nTwo \nThree"


SEVEN = "one\ntwo\nthree\nfour auth token\nfive\nsix\nseven"


@pytest.mark.parametrize(
    ("text", "query", "snippet", "marks"),
    [
        (SEVEN, "auth", "two\nthree\nfour auth token\nfive\nsix", ["auth"]),
        (SEVEN, "absent", "one\ntwo\nthree\nfour auth token\nfive", []),
        ("short auth", "auth (x+", "short auth", ["auth"]),
        ("a\nb", "of", "a\nb", []),
        (SEVEN, "seven", "five\nsix\nseven", ["seven"]),
        ("", "auth", "", []),
        (None, "auth", "", []),
    ],
)
def test_snippets(spark, text, query, snippet, marks):
    df = spark.createDataFrame([(text,)], "t string").withColumn("s", X.term_scores(F.col("t"), query))
    row = df.select(X.snippet(F.col("t"), F.col("s"), query), X.highlights(F.col("s"))).first()
    assert (row[0], row[1]) == (snippet, marks)


def test_term_scores_by_formula(spark):
    text = "Token token auth with with with the end"
    rows = spark.createDataFrame([(text,)], "t string").select(X.term_scores(F.col("t"), "token with auth token absent")).first()[0]
    size = len(text)

    def score(tf, word, damp):
        return tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / 500)) * damp * min(len(word) / 5, 1.5)

    want = sorted([("token", score(2, "token", 1), 0), ("with", score(3, "with", 0.1), 1), ("auth", score(1, "auth", 1), 2), ("token", score(2, "token", 1), 3)], key=lambda r: -r[1])
    assert [(r["term"], r["place"]) for r in rows] == [(t, p) for t, _, p in want]
    assert [r["score"] for r in rows] == pytest.approx([s for _, s, _ in want])


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 0.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    row = df.select(V.l2(a, b), V.cosine(a, b), V.negative_inner(a, b), V.norm(a), V.normalized(a)).first()
    assert row[:4] == pytest.approx((4.0, 0.4, -9.0, 5.0)) and row[4] == pytest.approx([0.6, 0.8])
    scores = df.select(V.keyword_score(F.lit(-3.0)), V.l2_score(F.lit(1.0)), V.cosine_score(F.lit(1.5)), V.ip_score(F.lit(-0.5)), V.ip_score(F.lit(-9.0))).first()
    assert scores[:] == pytest.approx((0.25, 0.5, 0.0, 0.25, 0.0))
    with pytest.raises(Exception, match="expected 3 dimensions, got 2"):
        df.select(V.same_width(a, 3)).collect()


def test_lines_and_hashes(spark):
    df = spark.createDataFrame([("a\nbc\n\nd",)], "t string")
    assert [df.select(X.line_at(F.col("t"), F.lit(k))).first()[0] for k in (0, 1, 2, 5, 6, 7)] == [1, 1, 2, 3, 4, 4]
    assert df.select(X.content_hash(F.lit("abc"))).first()[0].startswith("ba7816bf")
