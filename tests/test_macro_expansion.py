"""Line markers, anchors and expansions."""

from pyspark.sql import functions as F

from quarrygraph.operators import macro_expansion as mx

PRE = ["before", '# 1 "a.c"', "int x;", '# 7 "b.h" 1', "int y;", "int z;", '# 3 "a.c" 2', "    p = USED;", "end"]


def test_annotate(spark):
    df = spark.createDataFrame([("f", i + 1, line) for i, line in enumerate(PRE)], "path string, raw_no int, line string")
    assert [tuple(r)[2:] for r in mx.annotate(df).orderBy("raw_no").collect()] == [("??", 1, "before"), ("a.c", 1, "int x;"), ("b.h", 7, "int y;"), ("b.h", 8, "int z;"), ("a.c", 3, "    p = USED;"), ("a.c", 4, "end")]


def test_expand_and_errors(spark):
    df = spark.createDataFrame([("f", i + 1, line) for i, line in enumerate(PRE)], "path string, raw_no int, line string")
    source = spark.createDataFrame([("/s/a.c", 3, "    p = M(1);"), ("/s/a.c", 4, "    q = M(1);"), ("/s/a.c", 50, "x")], "file string, line int, content string")
    uses = spark.createDataFrame([("/s/a.c", 3, 9, 13), ("/s/a.c", 4, 9, 13), ("/s/a.c", 50, 1, 2)], "file string, line int, start_col int, end_col int")
    got = {r["line"]: (r["macro"], r["expansion"], r["status"]) for r in mx.expand_uses(mx.annotate(df), uses, source).collect()}
    assert got == {3: ("M(1)", "USED", "ok"), 4: ("M(1)", None, "no_anchor"), 50: ("x", None, "no_line")}


def test_between_takes_first_and_last(spark):
    one = spark.range(1)
    f = lambda line, a, b: tuple(one.select(mx.between(F.lit(line), F.lit(a), F.lit(b)).alias("x")).first()["x"])
    assert f("a = b = c ; d ;", "=", ";") == ("b = c ; d", "ok")
    assert f("; x =", "=", ";") == (None, "overlap")
    assert f("x y", "=", ";") == (None, "no_anchor")
    assert f("xs x s", "x", "s") == ("", "ok")


def test_commands(spark):
    df = spark.createDataFrame([(["gcc", "-c", "-Wall", "-o", "a.o", "a.c"], "/w/a.c")], "a array<string>, f string")
    assert df.select(mx.preprocess_arguments(F.col("a"), F.col("f"), "t")).first()[0] == ["gcc", "-E", "-Wall", "-o", "t/a.i", "/w/a.c"]
    assert df.select(mx.macro_dump_command(F.col("a"), F.lit("s.c"), F.lit("o.i"))).first()[0] == ["gcc", "-Wall", "a.c", "-E", "-dD", "s.c", "-o", "o.i"]
    assert df.select(mx.mirror_path(F.col("f"), "t")).first()[0] == "t/w/a.c.i"


def test_the_same_path_wins_over_the_same_base_name(spark):
    seen = [("u1.i", 500, "/x/a.c", 10, "v = RIGHT;"), ("u2.i", 3, "/y/a.c", 10, "v = WRONG;"), ("u1.i", 2, "/z/b.c", 4, "w = LATER;"), ("u0.i", 9, "/q/b.c", 4, "w = FIRST;"), ("u0.i", 8, "/q/b.c", 5, "; w =")]
    annotated = spark.createDataFrame(seen, "path string, raw_no int, src_file string, src_line int, content string")
    source = spark.createDataFrame([("/x/a.c", 10, "v = M;"), ("/r/b.c", 4, "w = M;"), ("/r/b.c", 5, "w = M;")], "file string, line int, content string")
    uses = spark.createDataFrame([("/x/a.c", 10, 5, 6)] * 2 + [("/r/b.c", 4, 5, 6), ("/r/b.c", 5, 5, 6), ("/none.c", 1, 1, 2)], "file string, line int, start_col int, end_col int")
    got = {(r["file"], r["line"]): (r["expansion"], r["status"]) for r in mx.expand_uses(annotated, uses, source).collect()}
    assert got == {("/x/a.c", 10): ("RIGHT", "ok"), ("/r/b.c", 4): ("FIRST", "ok"), ("/r/b.c", 5): (None, "overlap"), ("/none.c", 1): (None, "no_line")}


def test_annotated_text_and_words(spark):
    df = spark.createDataFrame([("f", i + 1, line) for i, line in enumerate(PRE)], "path string, raw_no int, line string")
    assert [r["value"] for r in mx.annotated_text(mx.annotate(df)).collect()][:3] == ["??:1\tbefore", "a.c:1\tint x;", "b.h:7\tint y;"]
    one = spark.createDataFrame([("a.b ab", "ab", True), ("a.b", "ab", False), ("x+=y", "+=", True), ("xy", "x", False), ("(p)->q", "->", True)], "line string, token string, found boolean")
    assert all(r["found"] == r["t"] for r in one.withColumn("t", mx.token_in_line(F.col("line"), F.col("token"))).collect())
