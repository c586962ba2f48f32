"""The graph over several files: cross-file links, macros, ids, modes, and invariants."""

import json

import pytest
from pyspark.sql import functions as F

from quarrygraph.operators import graph_queries
from quarrygraph.operators.graph_build import extract
from quarrygraph.sources import readers, writers

A = b"""#define pick(x) do_##x

int do_one() {}
int do_two() {}

struct Box {
    int size;
    int (*open)();
    struct Lid *lid;
};

int flag = 1;
struct Lid shared_lid;

int size_of(struct Box *box) {
    return box->size;
}

void wire(struct Box *box) {
    box->open = pick(one);
    box->open();
    int got = size_of(box);
    later();
}
"""
B = b"""struct Lid {
    int level;
};

int later() {
    return flag;
}

void use() {
    int n;
    struct Lid *l = &alias;
}
"""


@pytest.fixture(scope="module")
def graphs(spark):
    files = spark.createDataFrame([("/s/a.c", A), ("/s/b.c", B)], "file string, content binary")
    uses = spark.createDataFrame([(0, "./a.c", [20, 17, 20, 26], "pick(one)", "do_one"), (1, "b.c", [11, 22, 11, 27], "alias", "shared_lid"), (2, "./a.c", [99, 1, 99, 5], "x", "y")], "ord int, file string, location array<int>, name string, macro string")
    macros = readers.macro_table(uses, "/s")
    return {m: extract(files, macros, m) for m in ("shipped", "intended")}


def named(graph) -> set:
    n = {r["gid"]: r["name"].rpartition("/")[2] for r in graph.entities.select("gid", "name").collect()}
    return {(n[r["head"]], n[r["tail"]], r["type"]) for r in graph.edges().collect()}


def test_ids_are_dense_and_in_order(graphs):
    for g in graphs.values():
        rows = g.entities.orderBy("gid").select("gid", "file", "kind", "seq").collect()
        assert [r["gid"] for r in rows] == list(range(1, len(rows) + 1))
        order = ["FILE", "FUNCTION", "STRUCT", "VARIABLE", "PARAM", "FIELD"]
        keys = [(r["file"], order.index(r["kind"]), r["seq"]) for r in rows]
        assert keys == sorted(keys)


def test_intended_edges(graphs):
    got = named(graphs["intended"])
    assert {e for e in got if e[2] == "CALLS"} == {("wire", "do_one", "CALLS"), ("wire", "open", "CALLS"), ("wire", "size_of", "CALLS"), ("wire", "later", "CALLS")}
    assert {e for e in got if e[2] == "ASSIGNED_TO"} == {("open", "do_one", "ASSIGNED_TO"), ("got", "size_of", "ASSIGNED_TO"), ("l", "shared_lid", "ASSIGNED_TO")}
    assert {e for e in got if e[2] == "RETURNS"} == {("size_of", "size", "RETURNS"), ("later", "flag", "RETURNS")}
    assert ("lid", "Lid", "TYPE_OF") in got and ("shared_lid", "Lid", "TYPE_OF") in got and ("box", "Box", "TYPE_OF") in got
    assert ("Box", "size", "HAS_MEMBER") in got and ("b.c", "later", "CONTAINS") in got and ("a.c", "later", "CONTAINS") not in got


def test_shipped_quirks(graphs):
    g = graphs["shipped"]
    counts = {r["type"]: r["n"] for r in graph_queries.histogram(g.links).collect()}
    assert "HAS_MEMBER" not in counts and "TYPE_OF" not in counts
    assert counts["CONTAINS"] == 2 * (6 + 2 + 2)
    assert counts["HAS_PARAMETER"] == 2 * 2 and counts["HAS_VARIABLE"] == 2 * 3
    assert ("wire", "box", "CALLS") in named(g)
    lists = [r["head"] for r in g.relations.where("type = 'ASSIGNED_TO'").collect()]
    assert all(isinstance(h, list) for h in lists)


def test_every_end_is_an_entity_and_partitions_do_not_matter(spark, graphs):
    for g in graphs.values():
        assert graph_queries.dangling(g.edges().select("head", "tail", "type"), g.entities.select(F.col("gid").alias("id"))).count() == 0
    files = spark.createDataFrame([("/s/b.c", B), ("/s/a.c", A)], "file string, content binary").repartition(3)
    again = extract(files, None, "intended")
    assert again.entities.select("gid", "name").orderBy("gid").collect() == graphs["intended"].entities.select("gid", "name").orderBy("gid").collect()


def test_empty_corpus(spark):
    g = extract(spark.createDataFrame([], "file string, content binary"))
    assert g.entities.count() == 0 and g.relations.count() == 0


def test_sinks_round_trip(spark, graphs, tmp_path):
    g = graphs["shipped"]
    writers.write_graph(g, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p/entities")).count() == g.entities.count()
    rows = [json.loads(r["value"]) for r in writers.relation_json(g).collect()]
    (tmp_path / "r.json").write_text(json.dumps(rows))
    back = readers.read_relations(spark, str(tmp_path / "r.json"))
    assert sorted((tuple(r["head"]), tuple(r["tail"]), r["type"]) for r in back.collect()) == sorted((tuple(r["head"]), tuple(r["tail"]), r["type"]) for r in g.relations.collect())
    entities = [json.loads(r["value"]) for r in writers.entity_json(g).collect()]
    assert list(entities[0]) == ["id", "name", "type"] and "source_file" in entities[2]
    (tmp_path / "e.json").write_text(json.dumps(entities))
    assert readers.read_entities(spark, str(tmp_path / "e.json")).count() == len(entities)
    lines = [r["value"] for r in writers.dot_lines(*graph_queries.styled(g.public_entities(), g.edges().select("head", "tail", "type"))).collect()]
    assert lines[0].startswith("digraph") and lines[-1] == "}"


def test_file_source(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/x.C").write_bytes(b"int a;")
    (tmp_path / "y.h").write_bytes(b"int b;")
    (tmp_path / "z.txt").write_bytes(b"int c;")
    assert sorted(r["file"].rpartition("/")[2] for r in readers.c_files(spark, str(tmp_path)).collect()) == ["x.C", "y.h"]


def test_normal_paths(spark):
    df = spark.createDataFrame([("./a/../b.c",), ("/x//y/./z.h",), ("../q",)], "p string")
    assert [r[0] for r in df.select(readers.normal_path(F.col("p"), "/base/in")).collect()] == ["/base/in/b.c", "/x/y/z.h", "/base/q"]


def test_table_function(spark):
    from quarrygraph.functions import udtf

    udtf.register(spark)
    spark.createDataFrame([("a.c", A)], "file string, content binary").createOrReplaceTempView("c_sources")
    got = spark.sql("SELECT e.kind, e.name FROM c_sources, LATERAL c_entities(file, content) e WHERE e.kind = 'STRUCT'").collect()
    assert [tuple(r) for r in got] == [("STRUCT", "Box")]


def test_csv_export(spark, graphs, tmp_path):
    writers.write_csv(graphs["intended"], str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c/nodes")).columns[0] == "id:ID"


def test_stream_upsert(spark, tmp_path):
    from quarrygraph.operators.cst import file_facts
    from quarrygraph.streaming.ingest import upsert_facts

    at = str(tmp_path / "facts")
    both = spark.createDataFrame([("a.c", b"int a;"), ("b.c", b"int b;")], "file string, content binary")
    upsert_facts(file_facts(both), at)
    upsert_facts(file_facts(spark.createDataFrame([("b.c", b"int c; int d;")], "file string, content binary")), at)
    assert sorted((r["file"], r["name"]) for r in spark.read.parquet(at).collect()) == [("a.c", "a"), ("b.c", "c"), ("b.c", "d")]


def test_per_file_shelves(spark, graphs, tmp_path):
    g = graphs["intended"]
    writers.write_per_file(g, str(tmp_path / "f"))
    back = writers.read_one_file(spark, str(tmp_path / "f"), "/s/b.c").collect()
    assert [r["id"] for r in back] == [r["id"] for r in g.entities.where("file = '/s/b.c'").orderBy("gid").collect()]
    assert len(list((tmp_path / "f").glob("shelf=*"))) <= 2


def test_json_that_is_not_json_is_an_error(spark, tmp_path):
    (tmp_path / "m.json").write_text('[{"file": "a.c", "location": [1, 2')
    with pytest.raises(Exception):
        readers.read_macros(spark, str(tmp_path / "m.json"), "/b").collect()
    with pytest.raises(Exception):
        readers.read_relations(spark, str(tmp_path / "none.json")).collect()
    (tmp_path / "c.json").write_text('[{"arguments": ["cc", "-c", "x.c"], "directory": "/d", "file": "/d/x.c"}, {"arguments": [], "directory": "/d", "file": "/d/y.c"}]')
    both = readers.read_compile_commands(spark, str(tmp_path / "c.json"))
    assert [r["file"] for r in both.orderBy("ord").collect()] == ["/d/x.c", "/d/y.c"]
    assert [r["file"] for r in readers.read_compile_commands(spark, str(tmp_path / "c.json"), first_only=True).collect()] == ["/d/x.c"]


def test_tree_of_files(spark, tmp_path):
    df = spark.createDataFrame([("a/b.c", bytearray(b"int x;")), ("c.h", None), ("a/b.c", bytearray(b"int x;"))], "file string, content binary")
    made = writers.write_tree(df, str(tmp_path / "t"))
    assert sorted((r["file"], r["bytes"]) for r in made.collect()) == [("a/b.c", 6), ("a/b.c", 6), ("c.h", 0)]
    assert sorted(p.name for p in (tmp_path / "t").rglob("*") if p.is_file()) == ["b.c", "c.h"]


def test_upsert_of_files_without_facts(spark, tmp_path):
    from quarrygraph.operators.cst import file_facts
    from quarrygraph.streaming.ingest import upsert_facts

    at = str(tmp_path / "facts")
    of = lambda *rows: file_facts(spark.createDataFrame([(n, bytearray(c)) for n, c in rows], "file string, content binary"))
    upsert_facts(of(*[(f"f{i}.c", b"int a;") for i in range(30)]), at)
    upsert_facts(of(("f3.c", b"int b, c;")), at, spark.createDataFrame([("f4.c",)], "file string"))
    got = sorted((r["file"], r["name"]) for r in spark.read.parquet(at).collect())
    assert got == sorted([(f"f{i}.c", "a") for i in range(30) if i not in (3, 4)] + [("f3.c", "b"), ("f3.c", "c")])


SHELF = b"""typedef struct Slot Slot;
struct Slot {
    int width;
    Slot *after;
    int (*check)(int, int);
};
union Value {
    int whole;
    char *words;
};
enum Mood { CALM, LOUD };
int total = 3;
int check_all(Slot *slot, int limit) {
    int seen = total;
    slot->check = check_one;
    seen = slot->check(limit, seen);
    return seen;
}
"""
BACK = b"""int check_one(int a, int b) {
    total = a;
    return total;
}
void start() {
    check_all(0, 1);
}
"""


@pytest.fixture(scope="module")
def whole(spark):
    files = spark.createDataFrame([("/m/shelf.c", bytearray(SHELF)), ("/m/back.c", bytearray(BACK))], "file string, content binary")
    return {m: extract(files, None, m) for m in ("shipped", "intended")}


def test_a_whole_graph_as_shipped(whole):
    """Every entity in order and every relation of two files, worked out by hand."""
    g = whole["shipped"]
    got = [(r["name"].rpartition("/")[2], r["type"], r["scope"], r["start_line"]) for r in g.entities.orderBy("gid").collect()]
    assert got == [
        ("back.c", "FILE", None, None), ("check_one", "FUNCTION", None, 1), ("start", "FUNCTION", None, 5), ("a", "VARIABLE", "check_one", 1), ("b", "VARIABLE", "check_one", 1),
        ("shelf.c", "FILE", None, None), ("check_all", "FUNCTION", None, 13), ("Slot", "STRUCT", "global", 2), ("Value", "STRUCT", "global", 7), ("total", "VARIABLE", "global", 12), ("seen", "VARIABLE", "check_all", 14),
        ("slot", "VARIABLE", "check_all", 13), ("limit", "VARIABLE", "check_all", 13), ("width", "FIELD", "Slot", 3), ("after", "FIELD", "Slot", 4), ("check", "FIELD", "Slot", 5), ("whole", "FIELD", "Value", 8), ("words", "FIELD", "Value", 9),
    ]
    name = {r["gid"]: r["name"].rpartition("/")[2] for r in g.entities.collect()}
    edges = sorted((r["type"], name[r["head"]], name[r["tail"]]) for r in g.edges().collect())
    every = ["check_one", "start", "check_all", "Slot", "Value", "total"]
    want = [("CALLS", "start", "check_all"), ("CALLS", "check_all", "slot"), ("RETURNS", "check_one", "total"), ("RETURNS", "check_all", "seen")]
    want += [("ASSIGNED_TO", "seen", "total"), ("ASSIGNED_TO", "check", "check_one"), ("ASSIGNED_TO", "seen", "check"), ("ASSIGNED_TO", "total", "a")]
    want += [("CONTAINS", f, x) for f in ("back.c", "shelf.c") for x in every]
    want += [("HAS_PARAMETER", h, x) for h, x in (("check_one", "a"), ("check_one", "b"), ("check_all", "slot"), ("check_all", "limit")) for _ in range(2)]
    want += [("HAS_VARIABLE", "check_all", "seen")] * 2
    assert edges == sorted(want)
    # the JSON output: entities by kind, fields as lists, and the later types file by file
    kinds = [json.loads(r["value"])["type"] for r in writers.entity_json(g).collect()]
    assert kinds == ["FILE"] * 2 + ["FUNCTION"] * 3 + ["STRUCT"] * 2 + ["VARIABLE"] * 6 + ["FIELD"] * 5
    out = [json.loads(r["value"]) for r in writers.relation_json(g).collect()]
    ids = {v: str(k) for k, v in name.items()}
    assert {"head": [ids["check"]], "tail": ids["check_one"], "type": "ASSIGNED_TO"} in out
    assert [r["tail"] for r in out if r["type"] == "CONTAINS"][:6] == [ids[x] for x in every]
    late = [r["type"] for r in out if r["type"] not in ("CALLS", "ASSIGNED_TO", "CONTAINS")]
    assert late == (["HAS_PARAMETER"] * 4 + ["HAS_VARIABLE", "RETURNS"]) * 2


def test_a_whole_graph_as_intended(whole):
    g = whole["intended"]
    kinds = {(r["name"], r["type"], r["scope"]) for r in g.entities.where("kind in ('TYPEDEF', 'ENUM', 'STRUCT')").collect()}
    assert kinds == {("Slot", "TYPEDEF", "global"), ("Mood", "ENUM", "global"), ("Slot", "STRUCT", "global"), ("Value", "STRUCT", "global")}
    got = named(g)
    assert {e for e in got if e[2] == "CALLS"} == {("start", "check_all", "CALLS"), ("check_all", "check", "CALLS")}
    assert {e for e in got if e[2] == "TYPE_OF"} == {("after", "Slot", "TYPE_OF"), ("slot", "Slot", "TYPE_OF")}
    assert {e for e in got if e[2] == "CONTAINS"} == {("back.c", "check_one", "CONTAINS"), ("back.c", "start", "CONTAINS")} | {("shelf.c", x, "CONTAINS") for x in ("check_all", "Slot", "Value", "Mood", "total")}
    assert len([1 for e in got if e[2] == "HAS_MEMBER"]) == 5


@pytest.fixture(scope="module")
def many(spark):
    """A shipped graph of 30 files with two functions each."""
    text = lambda i: f"int one_{i}(int p)\n{{\n    int n = p;\n    return n;\n}}\nint two_{i}(void)\n{{\n    one_{i}(1);\n    return 0;\n}}\n".encode()
    files = spark.createDataFrame([(f"/t/{i:02}.c", bytearray(text(i))) for i in range(30)], "file string, content binary")
    return extract(files, None, "shipped")


def products(df) -> int:
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("Join Cross")


def test_shipped_products_are_not_written_or_made_for_other_types(many):
    """F1, src_assigned_to_shipped: what holds once for every file is kept once."""
    counts = {r["type"]: r["n"] for r in graph_queries.histogram(many.links).collect()}
    assert counts == {"CALLS": 30, "ASSIGNED_TO": 30, "RETURNS": 30, "CONTAINS": 30 * 60, "HAS_PARAMETER": 30 * 30, "HAS_VARIABLE": 30 * 30}
    assert many.stated.count() == 90 and many.everywhere.count() == 120
    some = many.edges().where("type = 'ASSIGNED_TO'")
    assert some.count() == 30 and products(some) == 0 and products(many.edges()) == 3


def test_names_are_found_before_products_are_made(many):
    """F4, src_contains_shipped: no join of the files' products, and every file with every target."""
    some = many.named_edges().where("type = 'CONTAINS'")
    lines = some._jdf.queryExecution().optimizedPlan().toString().split("\n")
    deep = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    (at,) = [i for i, x in enumerate(lines) if "Join Cross" in x]
    above = [lines[i] for i in range(at) if deep[i] < min(deep[i + 1 : at + 1])]
    assert above and not any("Join" in x for x in above)
    want = {(f"/t/{i:02}.c", f"{name}_{j}") for i in range(30) for j in range(30) for name in ("one", "two")}
    got = [(r["head_name"], r["tail_name"]) for r in some.collect()]
    assert len(got) == len(want) and set(got) == want
    assert {tuple(r) for r in many.named_edges().where("type = 'CALLS'").collect()} == {(f"two_{i}", f"one_{i}", "CALLS") for i in range(30)}


def test_named_edges_are_the_edges(many):
    names = {r["gid"]: r["name"] for r in many.entities.collect()}
    got = sorted((names[r["head"]], names[r["tail"]], r["type"]) for r in many.edges().collect())
    assert got == sorted(tuple(r) for r in many.named_edges().collect())


def test_differences_are_counted_without_products(spark, graphs, many):
    """F6, src_mode_diff: the counts of diff(), whatever of both graphs is a product."""
    other = extract(spark.createDataFrame([("/t/00.c", bytearray(b"int one(int p) { return p; }")), ("/t/01.c", bytearray(b"int two(void) { return one(1); }"))], "file string, content binary"), None, "shipped")
    for before, after in ((graphs["shipped"], graphs["intended"]), (graphs["intended"], graphs["shipped"]), (many, other), (other, other)):
        rows = graph_queries.diff(before.edges(), after.edges()).groupBy("type", "change").count().collect()
        counted = graph_queries.diff_histogram(before, after)
        assert sorted(tuple(r) for r in counted.collect()) == sorted(tuple(r) for r in rows)
        assert "own#" not in counted._jdf.queryExecution().optimizedPlan().toString()  # heads of products


def test_parquet_keeps_products_as_factors_and_gives_all_back(spark, graphs, many, tmp_path):
    """F5, src_graph_parquet: a shipped graph is written without its products, read with them, and leaves nothing behind."""
    at = str(tmp_path / "g")
    plain = lambda rows: sorted((tuple(r["head"]), tuple(r["tail"]), r["type"]) for r in rows.collect())
    writers.write_graph(many, at)
    entities, relations = readers.read_graph(spark, at)
    assert spark.read.parquet(f"{at}/relations").count() + spark.read.parquet(f"{at}/everywhere").count() == 210
    assert entities.count() == many.entities.count() and relations.count() == 90 + 30 * 120
    assert plain(relations) == plain(many.relations)
    writers.write_graph(graphs["intended"], at)
    assert plain(readers.read_graph(spark, at)[1]) == plain(graphs["intended"].relations)


def test_token_class_needs_no_join(spark):
    """F8, src_token_class: a node's row has its parent's type, so that no tree is joined with itself or sent to the driver."""
    from quarrygraph.operators import cst

    files = spark.createDataFrame([("x.c", bytearray(b"int f(int a) { return g(a) + b->c; }\n#define M(x) x\n")), ("empty.c", None)], "file string, content binary")
    t = cst.parse_files(files)
    made = cst.token_class(t)
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    parents = t.alias("a").join(t.alias("b"), F.expr("a.file = b.file and a.parent_pre = b.pre"), "left").select("a.file", "a.pre", F.col("b.type").alias("want"), "a.parent_type")
    assert parents.where("not want <=> parent_type").isEmpty() and parents.where("want is not null").count() > 20
    text = {(r["file"], r["pre"]): r["text"] for r in t.collect()}
    got = [(text[r["file"], r["pre"]], r["class"]) for r in made.orderBy("file", "pre").collect()]
    assert got[:5] == [("int", "type"), ("f", "function"), ("int", "type"), ("a", "variable"), ("g", "function")]
    assert ("c", "property") in got and ("M", "function.special") in got
