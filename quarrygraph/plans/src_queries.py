"""Queries over the graph of the sources rendered from the part table; every oracle is arithmetic on part keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cst as trees
from ..operators import graph_queries, macro_expansion
from ..sources.scratch import kept
from . import synth

P = """WITH n AS (SELECT count(*) AS n FROM part),
p AS (SELECT p_partkey AS k, 'src/f' || (p_partkey // 50) || '.c' AS file, p_partkey % 50 AS i, (p_partkey * 7 + 1) % n AS a, (p_partkey * 3 + 2) % n AS b, (p_partkey * 11 + 3) % n AS c FROM part, n)
"""


#: The rendered blocks as text, of both kinds.
TEXT = """, b AS (SELECT file, k, i, replace(replace(replace(replace('%s', '{k}', k::VARCHAR), '{a}', a::VARCHAR), '{b}', b::VARCHAR), '{use}', CASE WHEN k %% 10 = 0 THEN 'TARGET_' || k || '(p, q)' ELSE '(void)q' END) AS text FROM p),
rb AS (SELECT replace(file, '/f', '/r') AS file, k, i, replace(replace('%s', '{k}', k::VARCHAR), '{a}', a::VARCHAR) AS text FROM p)""" % (synth.BLOCK, synth.RICH)
RELATIONS = P + """, rel(head_name, tail_name, type) AS (
  SELECT 'fn_' || k, 'fn_' || a, 'CALLS' FROM p UNION ALL SELECT 'fn_' || k, 'fn_' || c, 'CALLS' FROM p WHERE k % 10 = 0
  UNION ALL SELECT 'local_' || k, 'q', 'ASSIGNED_TO' FROM p UNION ALL SELECT 'op_' || k, 'fn_' || b, 'ASSIGNED_TO' FROM p UNION ALL SELECT 'counter_' || k, 'local_' || k, 'ASSIGNED_TO' FROM p
  UNION ALL SELECT file, name || k, 'CONTAINS' FROM p, (VALUES ('fn_'), ('part_'), ('counter_')) v(name)
  UNION ALL SELECT 'part_' || k, name || k, 'HAS_MEMBER' FROM p, (VALUES ('size_'), ('price_'), ('op_')) v(name)
  UNION ALL SELECT 'fn_' || k, name, 'HAS_PARAMETER' FROM p, (VALUES ('p'), ('q')) v(name)
  UNION ALL SELECT 'fn_' || k, 'local_' || k, 'HAS_VARIABLE' FROM p UNION ALL SELECT 'fn_' || k, 'local_' || k, 'RETURNS' FROM p UNION ALL SELECT 'p', 'part_' || k, 'TYPE_OF' FROM p)"""
FULL_ENTITIES = P + """, full_e AS (SELECT row_number() OVER (ORDER BY file, r, k, m) AS id, file, name, type, scope, role, CASE WHEN r > 0 THEN i * 16 + l END::BIGINT AS start_line, CASE WHEN r > 0 THEN i * 16 + e END::BIGINT AS end_line FROM (
  SELECT file, 0 AS r, -1 AS k, 0 AS m, file AS name, 'FILE' AS type, NULL AS scope, NULL AS role, 0 AS i, 0 AS l, 0 AS e FROM p GROUP BY file
  UNION ALL SELECT file, 1, k, 0, 'fn_' || k, 'FUNCTION', NULL, NULL, i, 7, 15 FROM p UNION ALL SELECT file, 2, k, 0, 'part_' || k, 'STRUCT', 'global', NULL, i, 1, 5 FROM p
  UNION ALL SELECT file, 3, k, 0, 'counter_' || k, 'VARIABLE', 'global', NULL, i, 6, 6 FROM p UNION ALL SELECT file, 3, k, 1, 'local_' || k, 'VARIABLE', 'fn_' || k, NULL, i, 9, 9 FROM p
  UNION ALL SELECT file, 4, k, x, v, 'VARIABLE', 'fn_' || k, 'param', i, 7, 7 FROM p, (VALUES ('p', 0), ('q', 1)) v(v, x)
  UNION ALL SELECT file, 5, k, x, f || k, 'FIELD', 'part_' || k, NULL, i, x, x FROM p, (VALUES ('size_', 2), ('price_', 3), ('op_', 4)) v(f, x)))"""


def _entities(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = synth.graph(spark, sf_dir).entities.where(F.col("kind") == kind)
        return e.select("name", "type", "scope", "role", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "file")

    return run


def _edges(type_: str, mode: str = "intended"):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return synth.graph(spark, sf_dir, mode).named_edges(type_).select("head_name", "tail_name")

    return run


def src_file_entities(spark, sf_dir):
    return synth.graph(spark, sf_dir).entities.where("kind = 'FILE'").select("name", "type")


def src_entity_ids(spark, sf_dir):
    return synth.graph(spark, sf_dir).entities.select(F.col("gid").alias("id"), "name", "type", "file")


def src_entity_ids_shipped(spark, sf_dir):
    return synth.graph(spark, sf_dir, "shipped").entities.select(F.col("gid").alias("id"), "name", "type", "file")


def src_relation_histogram(spark, sf_dir):
    return graph_queries.histogram(synth.graph(spark, sf_dir).links)


def src_cst_types(spark, sf_dir):
    """All nodes of both kinds of sources, by type."""
    t = trees.parse_files(synth.files(spark, sf_dir).unionByName(synth.rich_files(spark, sf_dir)))
    return t.groupBy("type").agg(F.count("*").alias("n"))


def src_cst_navigation(spark, sf_dir):
    """Each call's callee, found by first child and first descendant, and the function around it."""
    # a table, so lost executors cost no parse
    t = kept(trees.parse_files(synth.files(spark, sf_dir)), "tree")
    calls = t.where("type = 'call_expression'").select("file", "pre", "last")
    callee = trees.field_child(t, calls, "function").select("file", F.col("pre").alias("call"), F.col("child").alias("pre"))
    callee = callee.join(t.select("file", "pre", "last"), ["file", "pre"])
    names = trees.first_descendant(t, callee.select("file", "pre", "last"), "identifier").join(callee, ["file", "pre"]).select("file", "call", F.col("name").alias("callee"))
    outer = trees.enclosing(t, calls, "function_definition").select("file", F.col("pre").alias("call"), F.col("outer").alias("pre"))
    header = trees.field_child(t, outer.select("file", "pre").distinct(), "declarator").select("file", F.col("pre").alias("outer"), F.col("child").alias("pre")).join(t.select("file", "pre", "last"), ["file", "pre"])
    caller = trees.first_descendant(t, header.select("file", "pre", "last"), "identifier").join(header, ["file", "pre"]).select("file", F.col("outer").alias("pre"), F.col("name").alias("caller"))
    return names.join(outer, ["file", "call"]).join(caller, ["file", "pre"]).select("caller", "callee")


def src_token_class(spark, sf_dir):
    return trees.token_class(trees.parse_files(synth.files(spark, sf_dir))).groupBy("class").agg(F.count("*").alias("n"))


def src_lexeme_class(spark, sf_dir):
    """Keywords, operators and delimiters."""
    return trees.lexeme_class(trees.lexemes(synth.files(spark, sf_dir))).groupBy("class", "text").agg(F.count("*").alias("n"))


def src_without_bodies(spark, sf_dir):
    t = trees.parse_files(synth.files(spark, sf_dir))
    return trees.without_subtrees(t, "compound_statement").groupBy("type").agg(F.count("*").alias("n"))


def _rich_tree(spark, sf_dir):
    """The tree of the rarer kinds, parsed once and kept as a table, which several joins read."""
    return kept(trees.parse_files(synth.rich_files(spark, sf_dir)), "tree")


def src_first_of_type(spark, sf_dir):
    """The first field name in every struct or union, at any depth."""
    t = _rich_tree(spark, sf_dir)
    return trees.first_descendant(t, t.where("type in ('struct_specifier', 'union_specifier')").select("file", "pre", "last"), "field_identifier").select("file", "name")


def src_child_of_type(spark, sf_dir):
    """Types with a body: the body's first and last line."""
    t = _rich_tree(spark, sf_dir)
    body = trees.child_of_type(t, t.where("type in ('struct_specifier', 'union_specifier', 'enum_specifier')").select("file", "pre"), "field_declaration_list", "enumerator_list")
    at = t.select("file", F.col("pre").alias("child"), "type", (F.col("start_row") + 1).cast("long").alias("first"), (F.col("end_row") + 1).cast("long").alias("last"))
    return body.join(at, ["file", "child"]).select("file", "type", "first", "last")


def src_declarator_chain(spark, sf_dir):
    """Where declarators' chains end, and how long they are."""
    t = kept(trees.parse_files(synth.files(spark, sf_dir).unionByName(synth.rich_files(spark, sf_dir))), "tree")
    heads = t.where("type in ('declaration', 'field_declaration', 'parameter_declaration', 'function_definition', 'type_definition')").select("file", "pre")
    ends = trees.declarator_chain(t, heads).join(t.select("file", F.col("pre").alias("end"), "type"), ["file", "end"])
    return ends.groupBy("type", F.col("steps").cast("long").alias("steps")).agg(F.count("*").alias("n"))


def src_declarator_names(spark, sf_dir):
    """The name of every field, behind pointers and parentheses too."""
    t = kept(trees.parse_files(synth.files(spark, sf_dir)), "tree")
    declarators = trees.field_child(t, t.where("type = 'field_declaration'").select("file", "pre"), "declarator").select("file", F.col("child").alias("pre"))
    return trees.declarator_name(t, declarators.join(t.select("file", "pre", "last"), ["file", "pre"])).select("file", "name")


def src_enclosing_struct(spark, sf_dir):
    """Field names with the innermost struct or union around them, unnamed ones too."""
    t = _rich_tree(spark, sf_dir)
    fields = t.where("type = 'field_identifier' and field_name = 'declarator'").select("file", "pre", "text")
    outer = trees.enclosing(t, fields.select("file", "pre"), "struct_specifier", "union_specifier").select("file", "pre", F.col("outer"))
    at = t.select("file", F.col("pre").alias("outer"), F.col("type").alias("outer_type"), (F.col("start_row") + 1).cast("long").alias("outer_line"))
    return outer.join(fields, ["file", "pre"]).join(at, ["file", "outer"]).select("file", F.col("text").alias("field"), "outer_type", "outer_line")


def src_macro_first_match(spark, sf_dir):
    """Call sides that hold a macro use, and what it expands to."""
    from ..operators.graph_build import macro_in_side

    facts = synth.graph(spark, sf_dir).facts.where("kind = 'CALL'").select("file", "kind", "seq", "fn", F.posexplode("sides").alias("s", "side"), F.element_at("sides", -1).alias("callee")).where("s = 0")
    return macro_in_side(facts, synth.macros(spark, sf_dir), True).where("expanded is not null").select("fn", "expanded")


def src_call_closure(spark, sf_dir):
    """Functions within three calls of fn_0, with the fewest steps."""
    e = _edges("CALLS")(spark, sf_dir).select(F.col("head_name").alias("head"), F.col("tail_name").alias("tail"))
    return graph_queries.k_hop(e, spark.range(1).select(F.lit("fn_0").alias("source")), 3).select("node", F.col("hops").cast("long").alias("hops"))


def src_call_paths(spark, sf_dir):
    e = _edges("CALLS")(spark, sf_dir).select(F.col("head_name").alias("head"), F.col("tail_name").alias("tail"))
    return graph_queries.paths(e, spark.range(1).select(F.lit("fn_0").alias("source")), 3).select(F.array_join("path", ">").alias("path"))


def src_call_neighbors(spark, sf_dir):
    e = _edges("CALLS")(spark, sf_dir).select(F.col("head_name").alias("head"), F.col("tail_name").alias("tail"), F.lit("CALLS").alias("type"))
    return graph_queries.neighbors(e, "fn_0", "CALLS", "both")


def src_line_annotate(spark, sf_dir):
    """Rendered lines behind markers come back with their own places."""
    lines = synth.files(spark, sf_dir).select(F.col("file").alias("path"), F.split(F.decode("content", "UTF-8"), "\n").alias("l"))
    marked = lines.select("path", F.concat(F.array(F.lit("int before;"), F.concat(F.lit('# 1 "'), F.col("path"), F.lit('" 2'))), F.col("l")).alias("l"))
    pre = marked.select("path", F.posexplode("l").alias("i", "line")).select("path", (F.col("i") + 1).alias("raw_no"), "line")
    return macro_expansion.annotate(pre).select("src_file", F.col("src_line").cast("long").alias("src_line"), "content")


def src_anchor_tokens(spark, sf_dir):
    p = synth.parts(spark, sf_dir)
    line = F.concat(F.lit("    p->op_"), F.col("k"), F.lit(" = USE("), F.col("k"), F.lit("); // end"))
    start = F.char_length(F.concat(F.lit("    p->op_"), F.col("k"), F.lit(" = "))) + 1
    a = macro_expansion.anchors(line, start, start + F.char_length(F.concat(F.lit("USE("), F.col("k"), F.lit(")"))))
    return p.select("k", a.alias("a")).select("k", "a.before", "a.macro", "a.after")


def src_expand(spark, sf_dir):
    """Macro uses of one line each, looked up in three units with files of one base name.

    By key modulo 4: found, anchors the wrong way round, no anchors, no such line; where the own path is missing (4
    modulo 8), the first unit's line of the same base name counts, though it stands later in its unit.
    """
    p = synth.parts(spark, sf_dir)
    line = (F.col("i") * 16 + 11).cast("int")
    text = lambda body: F.concat(F.lit("    p->op = "), body, F.lit(";"))
    use = F.concat(F.lit("USE("), F.col("k"), F.lit(")"))
    own = F.concat(F.lit("/build/"), F.col("file"))
    source = p.select(own.alias("file"), line.alias("line"), text(use).alias("content"))
    row = lambda unit, at, folder, content: F.struct(F.lit(unit).alias("path"), F.lit(at).alias("raw_no"), F.concat(F.lit(folder), F.col("file")).alias("src_file"), line.alias("src_line"), content.alias("content"))
    mine = F.when(F.col("k") % 4 == 0, text(F.concat(F.lit("fn_"), "b"))).when(F.col("k") % 4 == 1, F.lit("    ; p->op =")).otherwise(F.lit("    p->op fn"))
    others = [row("u1.i", 9, "/other/", text(F.concat(F.lit("fn_"), "a"))), row("u2.i", 1, "/more/", text(F.concat(F.lit("fn_"), "c")))]
    seen = p.where("k % 4 <> 3").select(F.explode(F.when(F.col("k") % 8 == 4, F.array(*others)).otherwise(F.array(row("u3.i", 20, "/build/", mine), *others))).alias("s")).select("s.*")
    uses = p.select(own.alias("file"), line.alias("line"), F.lit(13).alias("start_col"), (F.lit(13) + F.char_length(use)).alias("end_col"))
    out = macro_expansion.expand_uses(seen, uses, source)
    return out.select("file", F.col("line").cast("long").alias("line"), "macro", "expansion", "status")


#: Binary operators from the loosest to the tightest.
BINARY = ("||", "&&", "|", "^", "&", "==", "<", "<<", "+", "*")


def _one_per_key(spark, sf_dir, text):
    """A file for each 50 keys, with the text of every key in order."""
    p = synth.parts(spark, sf_dir).select(F.replace(F.col("file"), F.lit("/f"), F.lit("/g")).alias("file"), "k", text.alias("text"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "text"))), lambda b: b["text"]), "\n")
    return p.groupBy("file").agg(F.encode(whole, "UTF-8").alias("content"))


def src_precedence(spark, sf_dir):
    """What stands left and right of the loosest operator of a OP b OP c, for every pair of operators."""
    op = lambda i: F.element_at(F.array(*[F.lit(x) for x in BINARY]), (i % len(BINARY)).cast("int") + 1)
    text = F.concat(F.lit("int f(void) { return a "), op(F.col("k")), F.lit(" b "), op(F.expr("k div 10")), F.lit(" c; }"))
    t = kept(trees.parse_files(_one_per_key(spark, sf_dir, text)), "tree")
    back = t.where("type = 'return_statement'").select("file", F.col("pre").alias("parent_pre"))
    tops = t.where("type = 'binary_expression'").join(back, ["file", "parent_pre"]).select("file", "pre", (F.col("start_row") + 1).cast("long").alias("line"))
    out = tops
    for side in ("left", "right"):
        kinds = t.select("file", F.col("pre").alias("child"), F.col("type").alias(side))
        out = out.join(trees.field_child(t, tops.select("file", "pre"), side).join(kinds, ["file", "child"]).select("file", "pre", side), ["file", "pre"])
    return out.select("file", "line", "left", "right")


def src_conditional_functions(spark, sf_dir):
    """Functions of every branch of a condition, and the branch they stand in."""
    branch = lambda head, name: f"{head}\nint {name}_{{k}}(void) {{ return 1; }}\n"
    text = F.replace(F.lit(branch("#if A_{k}", "one") + branch("#elif B_{k}", "two") + branch("#else", "three") + "#endif"), F.lit("{k}"), F.col("k").cast("string"))
    t = kept(trees.parse_files(_one_per_key(spark, sf_dir, text)), "tree")
    functions = t.where("type = 'function_definition'").select("file", "pre", "last")
    names = trees.first_descendant(t, functions, "identifier")
    around = trees.enclosing(t, functions.select("file", "pre"), "preproc_if", "preproc_elif", "preproc_else").join(t.select("file", F.col("pre").alias("outer"), "type"), ["file", "outer"])
    return names.join(around, ["file", "pre"]).select("file", "name", F.col("type").alias("branch"))


def src_ambiguous_statements(spark, sf_dir):
    """A product that nobody uses is a declaration, a call is a call; comments stand anywhere; lines may be spliced."""
    text = F.replace(F.lit("void g_{k}(void) { a_{k} * b_{k}; f_{k}(x); int \\\n c_{k}; return /* {k} */; } // {k}"), F.lit("{k}"), F.col("k").cast("string"))
    t = trees.parse_files(_one_per_key(spark, sf_dir, text))
    return t.groupBy("type").agg(F.count("*").alias("n"))


def src_token_in_line(spark, sf_dir):
    """Which tokens stand in a line: words only whole, other tokens anywhere."""
    p = synth.parts(spark, sf_dir)
    line = F.concat(F.lit("int local_"), "k", F.lit("= q->next;"))
    tokens = F.array(F.concat(F.lit("local_"), "k"), F.concat(F.lit("local_"), F.col("k") % 10), F.lit("local_"), F.lit("= q"), F.lit("->"), F.lit("q"), F.lit("ext"))
    each = p.select("k", line.alias("line"), F.posexplode(tokens).alias("j", "token"))
    return each.select("k", F.col("j").cast("long").alias("j"), macro_expansion.token_in_line(F.col("line"), F.col("token")).alias("found"))


def src_dangling(spark, sf_dir):
    """Edges with an end among the fields, which are kept out of the entities here, by type; with all entities, none."""
    g = synth.graph(spark, sf_dir)
    ends = g.edges().select("head", "tail", "type")
    some = graph_queries.dangling(ends, g.entities.where("kind <> 'FIELD'").select(F.col("gid").alias("id")))
    none = graph_queries.dangling(ends, g.entities.select(F.col("gid").alias("id"))).withColumn("type", F.lit("any of all"))
    return some.unionByName(none).groupBy("type").agg(F.count("*").alias("n"))


def src_rich_entities(spark, sf_dir):
    """Entities of the rarer kinds: typedefs, unions, nested structs, enums, several declarators, conditions."""
    e = synth.rich_graph(spark, sf_dir).entities.where("file like 'src/r%' and kind <> 'FILE'")
    return e.select("file", "name", "type", "scope", "role", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


def src_rich_relations(spark, sf_dir):
    """Relations of the rarer kinds: types of fields and variables, members of unions, calls with several macros."""
    g = synth.rich_graph(spark, sf_dir)
    named = g.entities.select("gid", "name")
    e = g.edges().where("file like 'src/r%'").join(named.select(F.col("gid").alias("head"), F.col("name").alias("head_name")), "head")
    return e.join(named.select(F.col("gid").alias("tail"), F.col("name").alias("tail_name")), "tail").select("file", "head_name", "tail_name", "type")


def src_rich_shipped(spark, sf_dir):
    """What the shipped mode says of the same sources: one declarator each, a nested type in every scope, no fields of
    typedef'd unnamed types."""
    f = trees.file_facts(synth.rich_files(spark, sf_dir), "shipped").where("kind in ('STRUCT', 'FIELD', 'VARIABLE')")
    return f.select("file", "kind", "name", "scope", F.col("start_line").cast("long").alias("start_line"))


def src_rich_first_macro(spark, sf_dir):
    """Sides that hold several macros: the first of the table counts, in the intended mode for calls only one that begins
    with the callee."""
    from ..operators.graph_build import macro_in_side

    facts = synth.rich_graph(spark, sf_dir).facts.where("kind in ('CALL', 'ASSIGN') and file like 'src/r%'").select("file", "kind", "seq", "fn", F.posexplode("sides").alias("s", "side"), F.element_at("sides", -1).alias("callee"))
    facts = facts.where("kind <> 'CALL' or s = 0")
    out = None
    for mode, callee_end in (("shipped", False), ("intended", True)):
        some = macro_in_side(facts, synth.rich_macros(spark, sf_dir), callee_end).where("expanded is not null").select(F.lit(mode).alias("mode"), "kind", "fn", "expanded")
        out = some if out is None else out.unionByName(some)
    return out


def src_mode_diff(spark, sf_dir):
    """What the intended mode adds to and takes from the shipped one, by type."""
    return graph_queries.diff_histogram(*[synth.graph(spark, sf_dir, m) for m in ("shipped", "intended")])


def src_stream_entities(spark, sf_dir):
    """Functions of files that arrive as a stream."""
    from ..streaming.ingest import functions_of_stream

    return functions_of_stream(spark, synth.files(spark, sf_dir))


QUERIES = {
    "src_file_entities": src_file_entities,
    "src_function_entities": _entities("FUNCTION"),
    "src_variable_entities": _entities("VARIABLE"),
    "src_param_entities": _entities("PARAM"),
    "src_struct_entities": _entities("STRUCT"),
    "src_field_entities": _entities("FIELD"),
    "src_entity_ids": src_entity_ids,
    "src_entity_ids_shipped": src_entity_ids_shipped,
    "src_calls": _edges("CALLS"),
    "src_assigned_to": _edges("ASSIGNED_TO"),
    "src_returns": _edges("RETURNS"),
    "src_type_of": _edges("TYPE_OF"),
    "src_has_member": _edges("HAS_MEMBER"),
    "src_has_parameter": _edges("HAS_PARAMETER"),
    "src_has_variable": _edges("HAS_VARIABLE"),
    "src_contains": _edges("CONTAINS"),
    "src_calls_shipped": _edges("CALLS", "shipped"),
    "src_assigned_to_shipped": _edges("ASSIGNED_TO", "shipped"),
    "src_returns_shipped": _edges("RETURNS", "shipped"),
    "src_relation_histogram": src_relation_histogram,
    "src_cst_types": src_cst_types,
    "src_cst_navigation": src_cst_navigation,
    "src_token_class": src_token_class,
    "src_without_bodies": src_without_bodies,
    "src_macro_first_match": src_macro_first_match,
    "src_call_closure": src_call_closure,
    "src_call_paths": src_call_paths,
    "src_call_neighbors": src_call_neighbors,
    "src_line_annotate": src_line_annotate,
    "src_anchor_tokens": src_anchor_tokens,
    "src_expand": src_expand,
    "src_dangling": src_dangling,
    "src_mode_diff": src_mode_diff,
    "src_stream_entities": src_stream_entities,
    "src_contains_shipped": _edges("CONTAINS", "shipped"),
    "src_lexeme_class": src_lexeme_class,
    "src_first_of_type": src_first_of_type,
    "src_child_of_type": src_child_of_type,
    "src_declarator_chain": src_declarator_chain,
    "src_declarator_names": src_declarator_names,
    "src_enclosing_struct": src_enclosing_struct,
    "src_token_in_line": src_token_in_line,
    "src_precedence": src_precedence,
    "src_conditional_functions": src_conditional_functions,
    "src_ambiguous_statements": src_ambiguous_statements,
    "src_rich_entities": src_rich_entities,
    "src_rich_relations": src_rich_relations,
    "src_rich_shipped": src_rich_shipped,
    "src_rich_first_macro": src_rich_first_macro,
}

_ENT = lambda name, type_, scope, role, start, end: P + f"SELECT {name} AS name, '{type_}' AS type, {scope} AS scope, {role} AS role, (i * 16 + {start})::BIGINT AS start_line, (i * 16 + {end})::BIGINT AS end_line, file FROM p"
_PAIR = lambda head, tail, where="true": f"SELECT {head} AS head_name, {tail} AS tail_name FROM p WHERE {where}"
_CALLS = _PAIR("'fn_' || k", "'fn_' || a") + " UNION ALL " + _PAIR("'fn_' || k", "'fn_' || c", "k % 10 = 0")
_ASSIGNED = _PAIR("'local_' || k", "'q'") + " UNION ALL " + _PAIR("'op_' || k", "'fn_' || b") + " UNION ALL " + _PAIR("'counter_' || k", "'local_' || k")
_FIELDS = "('size_', 2), ('price_', 3), ('op_', 4)"
_IDS = P + """, e AS (
  SELECT file, 0 AS r, -1 AS k, 0 AS m, file AS name, 'FILE' AS type FROM p GROUP BY file
  UNION ALL SELECT file, 1, k, 0, 'fn_' || k, 'FUNCTION' FROM p UNION ALL SELECT file, 2, k, 0, 'part_' || k, 'STRUCT' FROM p
  UNION ALL SELECT file, 3, k, 0, 'counter_' || k, 'VARIABLE' FROM p UNION ALL SELECT file, 3, k, 1, 'local_' || k, 'VARIABLE' FROM p
  UNION ALL SELECT file, 4, k, 0, 'p', 'VARIABLE' FROM p UNION ALL SELECT file, 4, k, 1, 'q', 'VARIABLE' FROM p
  UNION ALL SELECT file, 5, k, x, f || k, 'FIELD' FROM p, (VALUES %s) v(f, x))
SELECT row_number() OVER (ORDER BY file, r, k, m) AS id, name, type, file FROM e""" % _FIELDS



def _per(block: str, rich: str = "", column: str = "type") -> str:
    """SQL counts of what occurs so often in a block, in a block of a tenth key (after +), in a file (after f)."""
    made = {}
    for text, more in ((block, ""), (rich, "")):
        for item in text.split():
            name, _, times = item.partition(":")
            plain, _, files = times.partition("f")
            always, _, tenth = plain.partition("+")
            a, b, c = made.get(name, (0, 0, 0))
            made[name] = (a + int(always or 0), b + int(tenth or 0), c + int(files or 0))
    rows = ", ".join(f"('{k}', {a}, {b}, {c})" for k, (a, b, c) in made.items())
    return f", t(name, a, b, c) AS (VALUES {rows}), m AS (SELECT count(*) FILTER (k % 10 = 0) AS tenth, count(DISTINCT file) AS files FROM p) SELECT name AS {column}, (a * n + b * tenth + c * files)::BIGINT AS n FROM t, n, m"


_BLOCK_NODES = """argument_list:1+1 assignment_expression:2 call_expression:1+1 cast_expression:1+-1 compound_statement:1 declaration:2 expression_statement:4 field_declaration:3 field_declaration_list:1
  field_expression:1 field_identifier:4 function_declarator:2 function_definition:1 identifier:15+2 init_declarator:1 parameter_declaration:3 parameter_list:2 parenthesized_declarator:1
  pointer_declarator:2 primitive_type:9+-1 return_statement:1 storage_class_specifier:1 struct_specifier:2 translation_unit:f1 type_descriptor:1+-1 type_identifier:2"""
_RICH_NODES = """argument_list:3 assignment_expression:2 call_expression:3 compound_statement:1 declaration:2 enum_specifier:1 enumerator:2 enumerator_list:1 expression_statement:3 field_declaration:5
  field_declaration_list:3 field_expression:3 field_identifier:8 function_declarator:1 function_definition:1 identifier:19 parameter_declaration:2 parameter_list:1 pointer_declarator:3 preproc_if:1
  primitive_type:4 return_statement:1 storage_class_specifier:1 struct_specifier:3 translation_unit:f1 type_definition:1 type_identifier:9 union_specifier:2"""
_R = "replace(file, '/f', '/r') AS file"
ORACLES = {
    "src_file_entities": P + "SELECT DISTINCT file AS name, 'FILE' AS type FROM p",
    "src_function_entities": _ENT("'fn_' || k", "FUNCTION", "NULL::VARCHAR", "NULL::VARCHAR", 7, 15),
    "src_variable_entities": _ENT("'counter_' || k", "VARIABLE", "'global'", "NULL::VARCHAR", 6, 6) + " UNION ALL SELECT 'local_' || k, 'VARIABLE', 'fn_' || k, NULL, (i * 16 + 9)::BIGINT, (i * 16 + 9)::BIGINT, file FROM p",
    "src_param_entities": P + "SELECT name, 'VARIABLE' AS type, 'fn_' || k AS scope, 'param' AS role, (i * 16 + 7)::BIGINT AS start_line, (i * 16 + 7)::BIGINT AS end_line, file FROM p, (VALUES ('p'), ('q')) v(name)",
    "src_struct_entities": _ENT("'part_' || k", "STRUCT", "'global'", "NULL::VARCHAR", 1, 5),
    "src_field_entities": P + f"SELECT f || k AS name, 'FIELD' AS type, 'part_' || k AS scope, NULL::VARCHAR AS role, (i * 16 + x)::BIGINT AS start_line, (i * 16 + x)::BIGINT AS end_line, file FROM p, (VALUES {_FIELDS}) v(f, x)",
    "src_entity_ids": _IDS,
    "src_entity_ids_shipped": _IDS,
    "src_calls": P + _CALLS,
    "src_assigned_to": P + _ASSIGNED,
    "src_returns": P + _PAIR("'fn_' || k", "'local_' || k"),
    "src_type_of": P + _PAIR("'p'", "'part_' || k"),
    "src_has_member": P + f"SELECT 'part_' || k AS head_name, f || k AS tail_name FROM p, (VALUES {_FIELDS}) v(f, x)",
    "src_has_parameter": P + "SELECT 'fn_' || k AS head_name, name AS tail_name FROM p, (VALUES ('p'), ('q')) v(name)",
    "src_has_variable": P + _PAIR("'fn_' || k", "'local_' || k"),
    "src_contains": P + "SELECT file AS head_name, name || k AS tail_name FROM p, (VALUES ('fn_'), ('part_'), ('counter_')) v(name)",
    "src_calls_shipped": P + _CALLS,
    "src_assigned_to_shipped": P + _ASSIGNED,
    "src_returns_shipped": P + _PAIR("'fn_' || k", "'local_' || k"),
    "src_relation_histogram": P + """, t(type, times) AS (VALUES ('ASSIGNED_TO', 3), ('CONTAINS', 3), ('HAS_MEMBER', 3), ('HAS_PARAMETER', 2), ('HAS_VARIABLE', 1), ('RETURNS', 1), ('TYPE_OF', 1))
SELECT type, (times * n)::BIGINT AS n FROM t, n UNION ALL SELECT 'CALLS', count(*) + count(*) FILTER (k % 10 = 0) FROM p""",
    "src_cst_types": P + _per(_BLOCK_NODES, _RICH_NODES),
    "src_cst_navigation": P + "SELECT 'fn_' || k AS caller, 'fn_' || a AS callee FROM p UNION ALL SELECT 'fn_' || k, 'TARGET_' || k FROM p WHERE k % 10 = 0",
    "src_token_class": P + _per("property:4 function:2+1 type:11+-1 variable:13+1", column="class"),
    "src_without_bodies": P + _per("""declaration:1 field_declaration:3 field_declaration_list:1 field_identifier:3 function_declarator:2 function_definition:1 identifier:4 parameter_declaration:3 parameter_list:2
  parenthesized_declarator:1 pointer_declarator:2 primitive_type:7 storage_class_specifier:1 struct_specifier:2 translation_unit:f1 type_identifier:2"""),
    "src_macro_first_match": P + "SELECT 'fn_' || k AS fn, 'fn_' || c AS expanded FROM p WHERE k % 10 = 0",
    "src_call_closure": P.replace("WITH", "WITH RECURSIVE", 1) + ", e AS (" + _CALLS + "), r AS (SELECT 'fn_0' AS node, 0 AS hops UNION SELECT tail_name, hops + 1 FROM r JOIN e ON node = head_name WHERE hops < 3) SELECT node, min(hops)::BIGINT AS hops FROM r GROUP BY node",
    "src_call_paths": P.replace("WITH", "WITH RECURSIVE", 1) + ", e AS (SELECT DISTINCT * FROM (" + _CALLS + ")), r AS (SELECT 'fn_0' AS node, ['fn_0'] AS path UNION ALL SELECT tail_name, list_append(path, tail_name) FROM r JOIN e ON node = head_name WHERE len(path) <= 3 AND NOT list_contains(path, tail_name)) SELECT array_to_string(path, '>') AS path FROM r WHERE len(path) > 1",
    "src_call_neighbors": P + ", e AS (" + _CALLS + ") SELECT tail_name AS node FROM e WHERE head_name = 'fn_0' UNION SELECT head_name FROM e WHERE tail_name = 'fn_0'",
    "src_line_annotate": P + TEXT + " SELECT '??' AS src_file, 1::BIGINT AS src_line, 'int before;' AS content FROM (SELECT DISTINCT file FROM p) UNION ALL SELECT file, (i * 16 + x)::BIGINT, l[x] FROM (SELECT file, i, string_split(text, chr(10)) AS l, unnest(range(1, 17)) AS x FROM b)",
    "src_anchor_tokens": P + "SELECT k, '=' AS before, 'USE(' || k || ')' AS macro, ';' AS after FROM p",
    "src_expand": P + """SELECT '/build/' || file AS file, (i * 16 + 11)::BIGINT AS line, 'USE(' || k || ')' AS macro,
  CASE WHEN k % 8 = 4 THEN 'fn_' || a WHEN k % 4 = 0 THEN 'fn_' || b END AS expansion, ['ok', 'overlap', 'no_anchor', 'no_line'][(k % 4 + 1)::INT] AS status FROM p""",
    "src_dangling": P + "SELECT 'ASSIGNED_TO' AS type, n::BIGINT AS n FROM n UNION ALL SELECT 'HAS_MEMBER', 3 * n FROM n",
    "src_mode_diff": P + ", f AS (SELECT count(DISTINCT file) AS files FROM p) SELECT 'HAS_MEMBER' AS type, 'added' AS change, (3 * n)::BIGINT AS n FROM n UNION ALL SELECT 'TYPE_OF', 'added', n FROM n UNION ALL SELECT 'CONTAINS', 'removed', (files * (2 * n + (SELECT count(*) FROM p WHERE file = (SELECT max(file) FROM p))) - 2 * n - (SELECT count(*) FROM p WHERE file = (SELECT max(file) FROM p)))::BIGINT FROM n, f UNION ALL SELECT 'CONTAINS', 'added', (SELECT count(*) FROM p WHERE file <> (SELECT max(file) FROM p))::BIGINT",
    "src_stream_entities": P + "SELECT file, 'fn_' || k AS name, (i * 16 + 7)::BIGINT AS start_line FROM p",
    "src_contains_shipped": P + """, f AS (SELECT DISTINCT file FROM p), t AS (SELECT 'fn_' || k AS name FROM p UNION ALL SELECT 'part_' || k FROM p UNION ALL SELECT 'counter_' || k FROM p WHERE file = (SELECT max(file) FROM p))
SELECT file AS head_name, name AS tail_name FROM f CROSS JOIN t""",
    "src_lexeme_class": P + TEXT + r""", w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|->|[*=;]')) AS text FROM b)
SELECT CASE WHEN text = ';' THEN 'delimiter' WHEN text IN ('->', '*', '=') THEN 'operator' ELSE 'keyword' END AS class, text, count(*) AS n FROM w WHERE text IN (';', '->', '*', '=', 'struct', 'static', 'return') GROUP BY ALL""",
    "src_first_of_type": P + f"SELECT {_R}, name || k AS name FROM p, (VALUES ('lo_'), ('deep_'), ('deep_')) v(name)",
    "src_child_of_type": P + f"SELECT {_R}, t AS type, (i * 23 + x)::BIGINT AS first, (i * 23 + y)::BIGINT AS last FROM p, (VALUES ('field_declaration_list', 1, 4), ('field_declaration_list', 5, 10), ('field_declaration_list', 6, 8), ('enumerator_list', 11, 11)) v(t, x, y)",
    "src_declarator_chain": P + "SELECT type, steps::BIGINT AS steps, (times * n)::BIGINT AS n FROM n, (VALUES ('field_identifier', 1, 6), ('field_identifier', 2, 1), ('identifier', 1, 5), ('identifier', 2, 5), ('parenthesized_declarator', 2, 1), ('type_identifier', 1, 1)) v(type, steps, times)",
    "src_declarator_names": P + "SELECT file, name || k AS name FROM p, (VALUES ('size_'), ('price_'), ('op_')) v(name)",
    "src_enclosing_struct": P + f"SELECT {_R}, name || k AS field, t || '_specifier' AS outer_type, (i * 23 + x)::BIGINT AS outer_line FROM p, (VALUES ('lo_', 'struct', 1), ('next_', 'struct', 1), ('deep_', 'struct', 6), ('in_', 'union', 5), ('range_', 'union', 5)) v(name, t, x)",
    "src_token_in_line": P + "SELECT k, j::BIGINT AS j, CASE j WHEN 0 THEN true WHEN 1 THEN k < 10 WHEN 2 THEN false WHEN 3 THEN true WHEN 4 THEN true WHEN 5 THEN true ELSE false END AS found FROM p, (VALUES (0), (1), (2), (3), (4), (5), (6)) v(j)",
    "src_rich_entities": P + f"""SELECT {_R}, name, type, scope, role, (i * 23 + x)::BIGINT AS start_line, (i * 23 + y)::BIGINT AS end_line FROM (
  SELECT file, i, unnest([{{'name': 'run_' || k, 'type': 'FUNCTION', 'scope': NULL, 'role': NULL, 'x': 15, 'y': 22}}, {{'name': 'span_' || k, 'type': 'STRUCT', 'scope': 'global', 'role': NULL, 'x': 1, 'y': 4}},
  {{'name': 'any_' || k, 'type': 'STRUCT', 'scope': 'global', 'role': NULL, 'x': 5, 'y': 10}}, {{'name': 'inner_' || k, 'type': 'STRUCT', 'scope': 'any_' || k, 'role': NULL, 'x': 6, 'y': 8}},
  {{'name': 'table_' || k, 'type': 'VARIABLE', 'scope': 'global', 'role': NULL, 'x': 13, 'y': 13}}, {{'name': 'cursor_' || k, 'type': 'VARIABLE', 'scope': 'global', 'role': NULL, 'x': 13, 'y': 13}},
  {{'name': 'here_' || k, 'type': 'VARIABLE', 'scope': 'run_' || k, 'role': NULL, 'x': 17, 'y': 17}}, {{'name': 'u', 'type': 'VARIABLE', 'scope': 'run_' || k, 'role': 'param', 'x': 15, 'y': 15}},
  {{'name': 'n', 'type': 'VARIABLE', 'scope': 'run_' || k, 'role': 'param', 'x': 15, 'y': 15}}, {{'name': 'lo_' || k, 'type': 'FIELD', 'scope': 'span_' || k, 'role': NULL, 'x': 2, 'y': 2}},
  {{'name': 'next_' || k, 'type': 'FIELD', 'scope': 'span_' || k, 'role': NULL, 'x': 3, 'y': 3}}, {{'name': 'in_' || k, 'type': 'FIELD', 'scope': 'any_' || k, 'role': NULL, 'x': 6, 'y': 8}},
  {{'name': 'range_' || k, 'type': 'FIELD', 'scope': 'any_' || k, 'role': NULL, 'x': 9, 'y': 9}}, {{'name': 'deep_' || k, 'type': 'FIELD', 'scope': 'inner_' || k, 'role': NULL, 'x': 7, 'y': 7}},
  {{'name': 'span_' || k, 'type': 'TYPEDEF', 'scope': 'global', 'role': NULL, 'x': 1, 'y': 4}}, {{'name': 'tone_' || k, 'type': 'ENUM', 'scope': 'global', 'role': NULL, 'x': 11, 'y': 11}}], recursive := true) FROM p)""",
    "src_rich_relations": P + """SELECT replace(file, '/f', '/r') AS file, h AS head_name, t AS tail_name, y AS type FROM (
  SELECT file, 'run_' || k AS h, 'fn_' || b AS t, 'CALLS' AS y FROM p UNION ALL SELECT file, 'run_' || k, 'fn_' || c, 'CALLS' FROM p UNION ALL SELECT file, 'run_' || k, 'fn_' || a, 'CALLS' FROM p
  UNION ALL SELECT file, 'cursor_' || k, 'fn_' || b, 'ASSIGNED_TO' FROM p UNION ALL SELECT file, 'deep_' || k, 'n', 'ASSIGNED_TO' FROM p
  UNION ALL SELECT file, replace(file, '/f', '/r'), v || k, 'CONTAINS' FROM p, (VALUES ('run_'), ('span_'), ('span_'), ('any_'), ('inner_'), ('tone_'), ('table_'), ('cursor_')) x(v)
  UNION ALL SELECT file, v || k, w || k, 'HAS_MEMBER' FROM p, (VALUES ('span_', 'lo_'), ('span_', 'next_'), ('any_', 'in_'), ('any_', 'range_'), ('inner_', 'deep_')) x(v, w)
  UNION ALL SELECT file, 'run_' || k, v, 'HAS_PARAMETER' FROM p, (VALUES ('u'), ('n')) x(v) UNION ALL SELECT file, 'run_' || k, 'here_' || k, 'HAS_VARIABLE' FROM p UNION ALL SELECT file, 'run_' || k, 'range_' || k, 'RETURNS' FROM p
  UNION ALL SELECT file, v || k, w || k, 'TYPE_OF' FROM p, (VALUES ('cursor_', 'span_'), ('table_', 'span_'), ('here_', 'span_'), ('in_', 'inner_'), ('range_', 'span_')) x(v, w)
  UNION ALL SELECT file, 'u', 'any_' || k, 'TYPE_OF' FROM p UNION ALL SELECT file, 'next_' || k, 'part_' || a, 'TYPE_OF' FROM p)""",
    "src_rich_shipped": P + f"""SELECT {_R}, kind, name || k AS name, CASE WHEN scope = 'global' THEN scope ELSE scope || k END AS scope, (i * 23 + x)::BIGINT AS start_line FROM p, (VALUES
  ('VARIABLE', 'table_', 'global', 13), ('VARIABLE', 'here_', 'run_', 17), ('STRUCT', 'span_', 'global', 1), ('STRUCT', 'any_', 'global', 5), ('STRUCT', 'inner_', 'any_', 6), ('STRUCT', 'inner_', 'global', 6),
  ('FIELD', 'deep_', 'any_', 7), ('FIELD', 'in_', 'any_', 6), ('FIELD', 'range_', 'any_', 9), ('FIELD', 'deep_', 'inner_', 7)) v(kind, name, scope, x)""",
    "src_rich_first_macro": P + """SELECT mode, kind, 'run_' || k AS fn, 'fn_' || CASE WHEN first THEN c ELSE b END AS expanded FROM p, (VALUES
  ('shipped', 'CALL', false), ('shipped', 'CALL', false), ('shipped', 'CALL', false), ('shipped', 'ASSIGN', false), ('intended', 'CALL', true), ('intended', 'CALL', false), ('intended', 'ASSIGN', false)) v(mode, kind, first)""",
    "src_precedence": P + """SELECT replace(file, '/f', '/g') AS file, (i + 1)::BIGINT AS line, CASE WHEN first >= second THEN 'binary_expression' ELSE 'identifier' END AS left, CASE WHEN first >= second THEN 'identifier' ELSE 'binary_expression' END AS right
FROM (SELECT file, i, k % 10 AS first, (k // 10) % 10 AS second FROM p)""",
    "src_conditional_functions": P + "SELECT replace(file, '/f', '/g') AS file, name || '_' || k AS name, branch FROM p, (VALUES ('one', 'preproc_if'), ('two', 'preproc_elif'), ('three', 'preproc_else')) v(name, branch)",
    "src_ambiguous_statements": P + _per("""function_definition:1 primitive_type:3 function_declarator:1 identifier:5 parameter_list:1 parameter_declaration:1 compound_statement:1 declaration:2 type_identifier:1
  pointer_declarator:1 expression_statement:1 call_expression:1 argument_list:1 return_statement:1 comment:2 translation_unit:f1"""),
}
