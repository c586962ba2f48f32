"""The syntax-tree table: one row per named node, numbered so that a subtree is an interval."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cfacts import COLUMNS, facts
from ..functions.clexer import lex
from ..functions.cparser import parse
from ..sources.scratch import kept
from ..sources.shipping import ship
from .intervals import holding

#: Width of a bin in joins of nodes with the subtrees around them.
NODES_A_BIN = 256

CST = "file string, pre int, last int, parent_pre int, depth int, child_ix int, type string, field_name string, start_byte int, end_byte int, start_row int, start_col int, end_row int, end_col int, text string, parent_type string"


def node_rows(file: str, content: bytes) -> Iterator[tuple]:
    root, lines = parse(content), [0]
    lines += [i + 1 for i, b in enumerate(content) if b == 10]
    rows: list[list] = []
    stack = [(root, -1, 0, 0)]
    while stack:
        node, parent, depth, ix = stack.pop()
        pre = len(rows)
        a, b = bisect_right(lines, node.start) - 1, bisect_right(lines, node.end) - 1
        text = content[node.start : node.end].decode("utf-8", "ignore") if not node.kids or node.field == "type" else None
        rows.append([file, pre, pre, parent if parent >= 0 else None, depth, ix, node.type, node.field, node.start, node.end, a, node.start - lines[a], b, node.end - lines[b], text, rows[parent][6] if parent >= 0 else None])
        stack.extend((k, pre, depth + 1, i) for i, k in reversed(list(enumerate(node.kids))))
    for row in reversed(rows):
        if row[3] is not None:
            rows[row[3]][2] = max(rows[row[3]][2], row[2])
    return map(tuple, rows)


def _per_file(files: DataFrame, schema: str, rows_of) -> DataFrame:
    ship(files.sparkSession)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        for batch in batches:
            out: list[tuple] = []
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out.extend(rows_of(file, content or b""))
                if len(out) >= 20_000:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)

    return files.select(F.col("file").cast("string"), F.col("content").cast("binary")).mapInArrow(run, schema)


def parse_files(files: DataFrame) -> DataFrame:
    """(file, content) to the syntax-tree table.  Null contents are empty files; unparsable stretches are ERROR nodes."""
    return _per_file(files, CST, node_rows)


def file_facts(files: DataFrame, mode: str = "intended") -> DataFrame:
    """(file, content) to what each file says by itself: entities and unresolved references."""
    if mode not in ("shipped", "intended"):
        raise ValueError("mode is shipped or intended")
    return _per_file(files, COLUMNS, lambda file, content: facts(file, content, mode))


def first_descendant(cst: DataFrame, of: DataFrame, *types: str) -> DataFrame:
    """For nodes (file, pre, last) the text of the first descendant-or-self of the types: rows file, pre, name."""
    d = cst.where(F.col("type").isin(*types)).select(F.col("file").alias("f"), F.col("pre").alias("p"), "text")
    inside = holding(d, of, F.col("file") == F.col("f"), F.col("p").between(F.col("pre"), F.col("last")), F.col("p"), F.col("pre"), F.col("last"), NODES_A_BIN)
    return inside.groupBy("file", "pre").agg(F.min_by("text", "p").alias("name"))


def enclosing(cst: DataFrame, of: DataFrame, *types: str) -> DataFrame:
    """For nodes (file, pre) the pre of the innermost node of the types around them: rows file, pre, outer."""
    o = cst.where(F.col("type").isin(*types)).select(F.col("file").alias("f"), F.col("pre").alias("p"), F.col("last").alias("l"))
    around = holding(of, o, F.col("file") == F.col("f"), (F.col("p") < F.col("pre")) & (F.col("pre") <= F.col("l")), F.col("pre"), F.col("p"), F.col("l"), NODES_A_BIN)
    return around.groupBy("file", "pre").agg(F.max("p").alias("outer"))


def field_child(cst: DataFrame, of: DataFrame, field: str) -> DataFrame:
    """For nodes (file, pre) their first child with the field: rows file, pre, child."""
    c = cst.where(F.col("field_name") == field).select("file", F.col("parent_pre").alias("pre"), F.col("pre").alias("child"), "child_ix")
    return of.join(c, ["file", "pre"]).groupBy("file", "pre").agg(F.min_by("child", "child_ix").alias("child"))


def child_of_type(cst: DataFrame, of: DataFrame, *types: str) -> DataFrame:
    """For nodes (file, pre) their first direct child of the types: rows file, pre, child."""
    c = cst.where(F.col("type").isin(*types)).select("file", F.col("parent_pre").alias("pre"), F.col("pre").alias("child"), "child_ix")
    return of.join(c, ["file", "pre"]).groupBy("file", "pre").agg(F.min_by("child", "child_ix").alias("child"))


def declarator_chain(cst: DataFrame, of: DataFrame) -> DataFrame:
    """For nodes (file, pre) the end of their chain of declarator fields: rows file, pre, end, steps; those without one are
    left out.

    A chain ends at the first node without such a child, a parenthesized declarator for one.  A step looks two, four,
    eight ... links ahead, so there are as many joins as the longest chain has binary digits.
    """
    link = cst.where("field_name = 'declarator'").groupBy("file", F.col("parent_pre").alias("pre")).agg(F.min_by(F.struct("pre", "child_ix"), "child_ix")["pre"].alias("end"))
    link = kept(link.withColumn("steps", F.lit(1)), "chain")
    while True:
        ahead = link.select("file", F.col("pre").alias("end"), F.col("end").alias("next"), F.col("steps").alias("more"))
        joined = link.join(ahead, ["file", "end"], "left")
        longer = kept(joined.select("file", "pre", F.coalesce("next", "end").alias("end"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNotNull().alias("moved")), "chain")
        link = longer.drop("moved")
        if longer.where("moved").isEmpty():
            break
    return of.select("file", "pre").join(link, ["file", "pre"])


def declarator_name(cst: DataFrame, of: DataFrame) -> DataFrame:
    """For declarators (file, pre, last) the first identifier or field identifier in them: rows file, pre, name."""
    return first_descendant(cst, of, "identifier", "field_identifier")


#: Words, operators and delimiters that the highlight classes name.
KEYWORDS = (
    "break", "case", "const", "continue", "default", "do", "else", "enum", "extern", "for", "if", "inline", "return", "sizeof", "static", "struct",
    "switch", "typedef", "union", "volatile", "while",
)
OPERATORS = ("--", "-", "-=", "->", "=", "!=", "*", "&", "&&", "+", "++", "+=", "<", "==", ">", "||")
DELIMITERS = (".", ";")

LEXEMES = "file string, start_byte int, end_byte int, kind string, text string"


def _lexemes(file: str, content: bytes) -> Iterator[tuple]:
    for t in lex(content.decode("latin-1"))[0]:
        if t.kind != "eol":
            word = t.start if t.kind in ("id", "num", "str", "chr", "op") else None
            text = content[t.start : t.end] if word is not None else t.text.encode("latin-1")
            yield file, t.start, t.end, t.kind if word is not None else "directive", text.decode("utf-8", "ignore")


def lexemes(files: DataFrame) -> DataFrame:
    """(file, content) to the tokens of the text, those without a node of their own too: file, start_byte, end_byte, kind
    (id, num, str, chr, op, directive), text; a directive's text is its first word."""
    return _per_file(files, LEXEMES, _lexemes)


def lexeme_class(tokens: DataFrame) -> DataFrame:
    """Highlight classes of lexemes, as token_class() has those of nodes: file, start_byte, text, class."""
    t = F.col("text")
    made = (
        F.when((F.col("kind") == "id") & t.isin(*KEYWORDS), "keyword")
        .when(F.col("kind") == "directive", "keyword")
        .when((F.col("kind") == "op") & t.isin(*OPERATORS), "operator")
        .when((F.col("kind") == "op") & t.isin(*DELIMITERS), "delimiter")
    )
    return tokens.select("file", "start_byte", "text", made.alias("class")).where("class is not null")


def without_subtrees(cst: DataFrame, *types: str) -> DataFrame:
    """The tree without the nodes of the types and all below them."""
    cut = cst.where(F.col("type").isin(*types)).select(F.col("file").alias("f"), F.col("pre").alias("p"), F.col("last").alias("l"))
    return holding(cst, cut, F.col("file") == F.col("f"), F.col("pre").between(F.col("p"), F.col("l")), F.col("pre"), F.col("p"), F.col("l"), NODES_A_BIN, "left_anti")


def token_class(cst: DataFrame) -> DataFrame:
    """Highlight classes of nodes: file, pre, class."""
    t = F.col("type")
    made = (
        F.when((t == "identifier") & (F.col("parent_type") == "call_expression") & (F.col("field_name") == "function"), "function")
        .when((t == "field_identifier") & (F.col("parent_type") == "field_expression"), "property")
        .when((t == "identifier") & (F.col("parent_type") == "function_declarator"), "function")
        .when((t == "identifier") & (F.col("parent_type") == "preproc_function_def") & (F.col("field_name") == "name"), "function.special")
        .when(t == "field_identifier", "property")
        .when(t == "statement_identifier", "label")
        .when(t.isin("type_identifier", "primitive_type", "sized_type_specifier"), "type")
        .when(t.isin("string_literal", "system_lib_string"), "string")
        .when(t.isin("number_literal", "char_literal"), "number")
        .when(t == "null", "constant")
        .when(t == "comment", "comment")
        .when((t == "identifier") & F.col("text").rlike("^[A-Z][A-Z0-9_]*$"), "constant")
        .when(t == "identifier", "variable")
    )
    return cst.select("file", "pre", made.alias("class")).where("class is not null")
