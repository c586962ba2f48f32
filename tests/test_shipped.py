"""Shipped queries make no product of files that they don't give."""

import os

import pytest
from pyspark.sql import functions as F

from quarrygraph.operators import graph_build
from quarrygraph.plans import registry, synth

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables")


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_calls(spark):
    """F2, src_calls_shipped."""
    calls = registry.QUERIES["src_calls_shipped"](spark, DIR)
    assert "Join Cross" not in optimized(calls) and "everywhere" not in str(calls.inputFiles()) and calls.count() > 0
    # and the graph behind it has none written: a function, two parameters and a local would be there once for each file
    g = synth.graph(spark, DIR, "shipped")
    assert {r["type"] for r in g.stated.select("type").distinct().collect()} == {"CALLS", "ASSIGNED_TO", "RETURNS"}


def test_entity_ids(spark):
    """F3, src_entity_ids_shipped: the tables of the graph have a few rows an entity, whatever the number of files."""
    n = registry.QUERIES["src_entity_ids_shipped"](spark, DIR).count()
    g = synth.graph(spark, DIR, "shipped")
    assert g.files.count() > 1 and g.stated.count() + g.everywhere.count() + g.files.count() <= 2 * n


def test_returns(spark):
    """F7, src_returns_shipped."""
    returns = registry.QUERIES["src_returns_shipped"](spark, DIR)
    assert "Join Cross" not in optimized(returns) and "everywhere" not in str(returns.inputFiles())
    assert returns.count() == synth.parts(spark, DIR).count()


@pytest.fixture
def tables(monkeypatch):
    """Tags and frames of the tables that a graph writes, made anew."""
    made = []
    real = graph_build.kept
    monkeypatch.setattr(graph_build, "kept", lambda df, tag: made.append((tag, df)) or real(df, tag))
    synth.forget()
    yield made
    synth.forget()


def types(made) -> list[set[str]]:
    return [{r["type"] for r in df.select("type").distinct().collect()} for tag, df in made if tag == "relations"]


def test_calls_alone(spark, tables):
    """calls make no other relations, and what is asked for later fits to them."""
    calls = registry.QUERIES["src_calls_shipped"](spark, DIR)
    assert types(tables) == [{"CALLS"}] and "sides" not in dict(tables)
    assert calls.count() == 220
    for mode in ("shipped", "intended"):
        parts, whole = synth.graph(spark, DIR, mode), graph_build.extract(synth.files(spark, DIR), synth.macros(spark, DIR), mode)
        parts.stated_of("CALLS"), parts.named_edges("RETURNS", "CONTAINS")
        rows = lambda df: sorted(map(str, df.collect()))
        assert rows(parts.stated) == rows(whole.stated) and len(whole._stated) == 1 < len(parts._stated)
        assert rows(parts.named_edges("CONTAINS", "CALLS")) == rows(whole.named_edges().where("type in ('CONTAINS', 'CALLS')"))
    assert parts.named_edges("HAS_MEMBER").count() == 600 and synth.graph(spark, DIR, "shipped").named_edges("HAS_MEMBER").count() == 0


def test_entity_ids_alone(spark, tables):
    """entities need no relations."""
    assert registry.QUERIES["src_entity_ids_shipped"](spark, DIR).count() > 0
    assert [tag for tag, _ in tables] == ["facts", "ranges", "entities"]


def test_entity_ids_of_repeated_names(spark, tables):
    """ids are dense by file, kind and place, also for a file without a line and for names that repeat."""
    texts = [("b.c", "int x; int f(int a) { return a; }"), ("a.c", ""), ("c.c", "struct s { int x; }; int f(int a) { int x = a; return x; }"), ("d.c", None)]
    files = spark.createDataFrame([(f, None if t is None else bytearray(t.encode())) for f, t in texts], "file string, content binary")
    e = graph_build.extract(files, None, "shipped").entities.orderBy("gid").collect()
    assert [r["gid"] for r in e] == list(range(1, 13))
    assert [(r["file"], r["kind"], r["name"]) for r in e] == [
        ("a.c", "FILE", "a.c"), ("b.c", "FILE", "b.c"), ("b.c", "FUNCTION", "f"), ("b.c", "VARIABLE", "x"), ("b.c", "PARAM", "a"), ("c.c", "FILE", "c.c"), ("c.c", "FUNCTION", "f"),
        ("c.c", "STRUCT", "s"), ("c.c", "VARIABLE", "x"), ("c.c", "PARAM", "a"), ("c.c", "FIELD", "x"), ("d.c", "FILE", "d.c"),
    ]


def test_returns_alone(spark, tables):
    """returns make no other relations and read no macros."""
    assert registry.QUERIES["src_returns_shipped"](spark, DIR).count() > 0
    assert types(tables) == [{"RETURNS"}]
    assert "part.parquet" not in str([df.inputFiles() for tag, df in tables if tag == "relations"])


def test_contains_is_small_on_disk(spark, tmp_path):
    """F1, src_contains_shipped: the product's names stay in dictionaries, though there are more files than rows in a page of Parquet (20,000, here 900)."""
    n, m = 1_000, 2_000
    files = spark.range(n).select(F.concat(F.lit("src/f"), "id", F.lit(".c")).alias("file")).withColumn("own", F.col("file"))
    rows = spark.range(m).select(F.lit(None).cast("string").alias("head"), F.concat(F.lit("fn_"), "id").alias("tail"), F.lit("CONTAINS").alias("type"), F.col("id").alias("seq"))
    made = graph_build.for_every_file(rows, files).where("type = 'CONTAINS'").select("head", "tail")
    made.write.option("parquet.page.row.count.limit", 900).parquet(at := str(tmp_path / "made"))
    out = spark.read.parquet(at)
    assert out.count() == n * m == out.distinct().count()
    assert out.agg(F.count_distinct("head"), F.count_distinct("tail")).first() == (n, m)
    assert sum(f.stat().st_size for f in (tmp_path / "made").glob("*.parquet")) < n * m  # under a byte a row


def test_pieces_of_products(spark, monkeypatch):
    """every row meets every file, whatever the pieces, and no piece has more files or rows than it may."""
    monkeypatch.setattr(graph_build, "FILES_A_BLOCK", 3)
    monkeypatch.setattr(graph_build, "ROWS_A_TASK", 7)
    files = spark.range(20).select(F.concat(F.lit("f"), "id").alias("file"), F.array(F.col("id").cast("string")).alias("own"))
    rows = spark.createDataFrame([(["h"] if t != "CONTAINS" else None, [f"t{i}"], t, i) for t in ("CONTAINS", "HAS_VARIABLE") for i in range(30)], "head array<string>, tail array<string>, type string, seq long")
    made = graph_build.for_every_file(rows, files)
    want = sorted((["h"] if t != "CONTAINS" else [str(f)], [f"t{i}"], t, graph_build.RELATIONS.index(t), f"f{f}", i) for t in ("CONTAINS", "HAS_VARIABLE") for i in range(30) for f in range(20))
    assert sorted(map(tuple, made.collect())) == want
    piece = made.where("type = 'CONTAINS'").groupBy(F.spark_partition_id()).agg(F.count_distinct("tail").alias("rows"), F.count("*").alias("n"))
    assert all(r["rows"] <= 7 for r in piece.collect()) and piece.count() > 20
    assert graph_build.for_every_file(rows, files.where("false")).isEmpty() and graph_build.for_every_file(rows.where("false"), files).isEmpty()
