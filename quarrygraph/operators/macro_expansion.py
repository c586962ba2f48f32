"""Preprocessor line mapping and the expansion text of macro uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: a line marker of preprocessed text.
MARKER = r'^#\s*([0-9]+)\s+"([^"]+)"'


def _without_output(arguments: Column) -> Column:
    """Arguments without -c and without -o and the value after it."""
    return F.filter(arguments, lambda a, i: (a != "-c") & (a != "-o") & ((i == 0) | (F.element_at(arguments, F.greatest(i, F.lit(1))) != "-o")))


def preprocess_arguments(arguments: Column, file: Column, out_dir: str) -> Column:
    """Compiler arguments that stop after preprocessing: -E after the compiler unless it is there, the last argument (the
    source) dropped, then the output ``out_dir``/<name>.i and the entry's own file."""
    kept = _without_output(arguments)
    asked = F.when(F.array_contains(kept, "-E"), kept).otherwise(F.concat(F.slice(kept, 1, 1), F.array(F.lit("-E")), F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0)))))
    name = F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"(?<=.)\.[^.]*$", "")
    return F.concat(F.slice(asked, 1, F.size(asked) - 1), F.array(F.lit("-o"), F.concat(F.lit(out_dir.rstrip("/") + "/"), name, F.lit(".i")), file))


def macro_dump_command(arguments: Column, source: Column, out: Column) -> Column:
    """The alternate command, which keeps macro definitions: -E -dD, source and output at the end; no arguments are an error."""
    made = F.concat(_without_output(arguments), F.array(F.lit("-E"), F.lit("-dD"), source, F.lit("-o"), out))
    return F.when(F.size(arguments) > 0, made).otherwise(F.raise_error(F.lit("no arguments in the compile command")))


def mirror_path(file: Column, out_dir: str) -> Column:
    """Where a source's preprocessed text goes in a mirrored tree."""
    return F.concat(F.lit(out_dir.rstrip("/") + "/"), F.regexp_replace(file, "^/+", ""), F.lit(".i"))


def annotate(lines: DataFrame) -> DataFrame:
    """(path, raw_no, line) of preprocessed text to (path, raw_no, src_file, src_line, content): each line's own source place.

    A marker gives the place of the line after it and is dropped itself; lines before any marker are line 1 of ``??``.
    """
    number, name = F.regexp_extract("line", MARKER, 1), F.regexp_extract("line", MARKER, 2)
    mark = F.when(F.col("line").rlike(MARKER), F.struct(number.cast("int").alias("no"), name.alias("file"), F.col("raw_no").alias("at")))
    carried = F.last("mark", ignorenulls=True).over(Window.partitionBy("path").orderBy("raw_no"))
    out = lines.withColumn("mark", mark).withColumn("last", carried).where("mark is null")
    place = F.coalesce(F.col("last.no") + F.col("raw_no") - F.col("last.at") - 1, F.lit(1)).cast("int")
    return out.select("path", "raw_no", F.coalesce("last.file", F.lit("??")).alias("src_file"), place.alias("src_line"), F.col("line").alias("content"))


def annotated_text(annotated: DataFrame) -> DataFrame:
    """Lines ``file:line<TAB>content`` in order."""
    return annotated.orderBy("path", "raw_no").select(F.concat(F.col("src_file"), F.lit(":"), F.col("src_line"), F.lit("\t"), F.col("content")).alias("value"))


def anchors(line: Column, start_col: Column, end_col: Column) -> Column:
    """struct<before, macro, after> of a use in a line, columns from 1, end exclusive: the last run without white space
    before it, its text, and the first run after it; missing ones are null."""
    before = F.regexp_extract_all(F.substring(line, 1, start_col - 1), F.lit(r"\S+"), F.lit(0))
    after = F.regexp_extract_all(F.substring(line, end_col, F.lit(1 << 30)), F.lit(r"\S+"), F.lit(0))
    return F.struct(F.try_element_at(before, F.lit(-1)).alias("before"), F.substring(line, start_col, end_col - start_col).alias("macro"), F.try_element_at(after, F.lit(1)).alias("after"))


def is_word(token: Column) -> Column:
    return F.coalesce(token.rlike(r"^[A-Za-z_]\w*$"), F.lit(False))


def quoted(token: Column) -> Column:
    """A token as a regular expression that matches it: words at word borders."""
    safe = F.regexp_replace(token, r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")
    return F.when(is_word(token), F.concat(F.lit(r"\b"), safe, F.lit(r"\b"))).otherwise(safe)


def token_in_line(line: Column, token: Column) -> Column:
    return F.regexp_instr(line, quoted(token)) > 0


def between(line: Column, before: Column, after: Column) -> Column:
    """struct<text, status>: what stands between the first match of before and the last match of after, trimmed.

    status is ok, no_anchor or overlap.  A null anchor is the line's own end.
    """
    first = F.when(before.isNull(), F.lit(1)).otherwise(F.regexp_instr(line, quoted(before)))
    left = F.when(before.isNull(), F.lit(1)).otherwise(first + F.char_length(before))
    # the last match begins after all but the last of the parts that matches of after separate
    parts = F.split(line, quoted(after), -1)
    right = F.when(after.isNull(), F.char_length(line) + 1).otherwise(F.char_length(line) - F.char_length(F.element_at(parts, -1)) - F.char_length(after) + 1)
    found = (first > 0) & (after.isNull() | (F.size(parts) > 1))
    status = F.when(~found, "no_anchor").when(right < left, "overlap").otherwise("ok")
    return F.struct(F.when(found & (right >= left), F.trim(F.substring(line, left, right - left))).alias("text"), status.alias("status"))


def expand_uses(annotated: DataFrame, uses: DataFrame, source_lines: DataFrame) -> DataFrame:
    """The expansion of every macro use: (file, line, start_col, end_col, macro, expansion, status).

    uses: file, line, start_col, end_col.  source_lines: file, line, content.  A use's line is looked up among annotated
    lines (path, raw_no, src_file, src_line, content) with its number: first those of the same path, and where there are
    none those of the same base name; of several the first one counts, by unit (path) and place in it (raw_no).  Repeated
    uses are one row; a line without a use's source text has no anchors.  status is ok, no_line, no_anchor or overlap.

    Annotated lines are first brought down to one for each source place, so a header that many units include, or a base
    name that many files have, meets a use once.
    """
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    order = F.struct("path", "raw_no", "content")
    exact = annotated.groupBy(F.col("src_file").alias("file"), F.col("src_line").alias("line")).agg(F.min(order).alias("exact"))
    near = exact.groupBy(base(F.col("file")).alias("base"), "line").agg(F.min("exact").alias("near"))
    text = source_lines.groupBy("file", "line").agg(F.min("content").alias("content"))
    keys = ["file", "line", "start_col", "end_col"]
    asked = uses.select(*keys).distinct().join(text, ["file", "line"], "left").withColumn("base", base(F.col("file")))
    found = asked.join(exact, ["file", "line"], "left").join(near, ["base", "line"], "left")
    one = found.select(*keys, anchors(F.col("content"), F.col("start_col"), F.col("end_col")).alias("a"), F.coalesce("exact", "near")["content"].alias("seen"))
    made = between(F.col("seen"), F.col("a.before"), F.col("a.after"))
    return one.select(*keys, F.col("a.macro").alias("macro"), F.when(F.col("seen").isNotNull(), made["text"]).alias("expansion"), F.when(F.col("seen").isNull(), "no_line").otherwise(made["status"]).alias("status"))
