"""Entities with dense ids and relations between them, from the facts of all files."""

from __future__ import annotations

import math
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import kept
from .cst import file_facts
from .intervals import holding

#: Width of a bin in the join of macro uses with the sides around them.
LINES_A_BIN = 64

#: The order of entity kinds within a file (the last two only in the intended mode), and of relation types in the output.
KINDS = ("FILE", "FUNCTION", "STRUCT", "VARIABLE", "PARAM", "FIELD", "TYPEDEF", "ENUM")
RELATIONS = ("CALLS", "ASSIGNED_TO", "CONTAINS", "HAS_MEMBER", "HAS_PARAMETER", "HAS_VARIABLE", "RETURNS", "TYPE_OF")
ENTITY_COLUMNS = ("id", "name", "type", "scope", "role", "start_line", "end_line", "source_file")


#: Relations that the shipped mode states once for each file.
EVERYWHERE = ("CONTAINS", "HAS_PARAMETER", "HAS_VARIABLE")
#: Their products are made in pieces of so many files, about, and so many rows at most: places in a block mostly take a byte, and the names
#: of a piece stay under the megabyte beyond which Parquet gives a dictionary up.
FILES_A_BLOCK, ROWS_A_TASK = 200, 20_000
#: Relations that come of the sides of references, with the kind of their facts and the ends that fields may be.
SOURCES_OF_SIDES = {"CALLS": "CALL", "ASSIGNED_TO": "ASSIGN", "RETURNS": "RETURN"}
FIELD_ENDS = {"CALLS": ("tail",), "ASSIGNED_TO": ("head", "tail"), "RETURNS": ("tail",)}


def for_every_file(rows: DataFrame, files: DataFrame, counts: dict[str, int] | None = None) -> DataFrame:
    """rows (head, tail, type, seq; a null head is the file itself) once for each of the files (file, own), own being a file
    as a head: head, tail, type, phase, file, seq.  counts: of rows by type, where they are known.

    A type at a time, so that a filter on types leaves the products of the others unmade.  A task makes some rows with one
    block of files, the files of a row next to each other: what is written of it holds few names, each again and again, so
    that columnar files keep their dictionaries and become small.
    """
    spark = rows.sparkSession
    counts = counts_of(rows) if counts is None else counts
    # numbers of our own, as a product takes far longer than the bytes behind it let Spark expect
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = max(1, math.ceil(files.count() / FILES_A_BLOCK))
    dealt = files.groupBy(F.pmod(F.xxhash64("file"), F.lit(blocks)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("file", "own"))).alias("files"))
    dealt = dealt.repartitionByRange(blocks, "block").select("files").hint("shuffle_replicate_nl")  # each with each partition of rows
    out = None
    for t in EVERYWHERE:
        parts = max(math.ceil(tasks / blocks), math.ceil(counts.get(t, 0) / ROWS_A_TASK))
        made = rows.where(F.col("type") == t).select("head", "tail", "seq").repartition(parts).crossJoin(dealt).select("head", "tail", "seq", F.inline("files"))
        some = made.select(F.coalesce("head", "own").alias("head"), "tail", F.lit(t).alias("type"), F.lit(RELATIONS.index(t)).alias("phase"), "file", "seq")
        out = some if out is None else out.unionByName(some)
    return out


def counts_of(rows: DataFrame) -> dict[str, int]:
    return {r["type"]: r["count"] for r in rows.groupBy("type").count().collect()}


class Graph:
    """entities: ENTITY_COLUMNS and the internal gid (long), file, kind, seq, type_text.  stated: head and tail, each an id or
    the name of all fields it stands for (struct<id:long, field:string>), type, and phase, file, seq for the output order.

    everywhere: what the shipped mode states again for each file, kept once, as for_every_file() takes it; ``links``,
    ``relations``, ``edges()`` and ``named_edges()`` have all of it.  files: file, gid.

    Relations are made when they are first read, and only of the types asked for; what is missing of them in one pass."""

    def __init__(self, entities: DataFrame, facts: DataFrame, macros: DataFrame | None, mode: str):
        self.entities, self.facts, self.macros, self.mode = entities, facts, macros, mode
        self.symbols = Symbols(entities, mode)
        self._stated: list[tuple[set[str], DataFrame]] = []  # types and the table that has all of them

    def stated_of(self, *types: str) -> DataFrame:
        """Stated links of the types."""
        missing = [t for t in types if not any(t in made for made, _ in self._stated)]
        if missing:
            self._stated.append((set(missing), kept(stated_relations_of(self.facts, self.symbols, self.macros, missing), "relations")))
        used = [(made, table) for made, table in self._stated if made & set(types)]
        return reduce(DataFrame.unionByName, [table if made <= set(types) else table.where(F.col("type").isin(*types)) for made, table in used])

    @property
    def stated_types(self) -> tuple[str, ...]:
        """What stated has; the shipped mode finds no members and no types."""
        return tuple(SOURCES_OF_SIDES) if self.mode == "shipped" else RELATIONS

    @property
    def stated(self) -> DataFrame:
        return self.stated_of(*self.stated_types)

    @cached_property
    def everywhere(self) -> DataFrame | None:
        return kept(relations_everywhere_of(self.symbols), "everywhere") if self.mode == "shipped" else None

    @cached_property
    def _counts(self) -> dict[str, int]:
        return counts_of(self.everywhere)

    @cached_property
    def files(self) -> DataFrame:
        return kept(self.entities.where("kind = 'FILE'").select("file", "gid"), "files")

    def _each_file(self, rows: DataFrame, own: Column) -> DataFrame:
        """rows once for each file; ``own`` makes a head of a file."""
        return for_every_file(rows, self.files.select("file", own.alias("own")), self._counts)

    @property
    def links(self) -> DataFrame:
        """All links in the form of stated."""
        return self.stated if self.everywhere is None else self.stated.unionByName(self._each_file(self.everywhere, one(F.col("gid"))))

    def public_entities(self) -> DataFrame:
        return self.entities.select(*ENTITY_COLUMNS)

    def fields(self) -> DataFrame:
        """(field, gid) of all fields by name."""
        return self.entities.where("kind = 'FIELD'").select(F.col("name").alias("field"), "gid")

    @property
    def relations(self) -> DataFrame:
        """head, tail (arrays of id strings), type, phase, file, seq, head_list, tail_list: as the JSON output has them, where a
        field's name stands for the list of all fields of that name, and is a list there even if it's one."""
        out = self.stated_relations()
        if self.everywhere is None:
            return out
        more = self._each_file(self.relations_everywhere(), F.array(F.col("gid").cast("string")))
        return out.unionByName(more.withColumns({"head_list": F.lit(False), "tail_list": F.lit(False)}))

    def stated_relations(self) -> DataFrame:
        """Stated links as relations has them."""
        lists = self.fields().groupBy("field").agg(F.transform(F.sort_array(F.collect_list("gid")), lambda x: x.cast("string")).alias("ids"))
        out = self.stated
        for end in ("head", "tail"):
            named = lists.select(F.col("field").alias(f"__{end}"), F.col("ids").alias(f"__{end}_ids"))
            out = out.join(named, F.col(f"{end}.field") == F.col(f"__{end}"), "left")
        ids = lambda end: F.coalesce(f"__{end}_ids", F.array(F.col(f"{end}.id").cast("string"))).alias(end)
        return out.select(ids("head"), ids("tail"), "type", "phase", "file", "seq", F.col("head.field").isNotNull().alias("head_list"), F.col("tail.field").isNotNull().alias("tail_list"))

    def relations_everywhere(self) -> DataFrame:
        """everywhere with arrays of id strings for ends: head (null: the file), tail, type, seq.  No ends of these are fields."""
        alone = lambda end: F.when(F.col(end).isNotNull(), F.array(F.col(f"{end}.id").cast("string"))).alias(end)
        return self.everywhere.select(alone("head"), alone("tail"), "type", "seq")

    def stated_edges(self, *types: str) -> DataFrame:
        """Stated links, of the types alone if there are any, as edges() has them."""
        types = types or self.stated_types
        out, ends = self.stated_of(*types), {"head": F.col("head.id"), "tail": F.col("tail.id")}
        for end in ends:
            if any(end in FIELD_ENDS.get(t, ()) for t in types):
                named = self.fields().select(F.col("field").alias(f"__{end}"), F.col("gid").alias(f"__{end}_gid"))
                out = out.join(named, F.col(f"{end}.field") == F.col(f"__{end}"), "left")
                ends[end] = F.coalesce(ends[end], f"__{end}_gid")
        return out.select(ends["head"].alias("head"), ends["tail"].alias("tail"), "type", "phase", "file", "seq")

    def edges_everywhere(self) -> DataFrame:
        """everywhere with ids for ends: head (null: the file), tail, type, seq."""
        return self.everywhere.select(F.col("head.id").alias("head"), F.col("tail.id").alias("tail"), "type", "seq")

    def edges(self) -> DataFrame:
        """One row (head, tail, type) per pair of ids, as longs; a field's name joins its fields as rows."""
        out = self.stated_edges()
        return out if self.everywhere is None else out.unionByName(self._each_file(self.edges_everywhere(), F.col("gid")))

    def named_edges(self, *types: str) -> DataFrame:
        """edges(), of the types alone if there are any, with names for ids: head_name, tail_name, type.  Names are found
        before products are made."""
        types = types or RELATIONS

        def name(rows: DataFrame, how: str) -> DataFrame:
            for end, join in (("head", how), ("tail", "inner")):
                rows = rows.join(self.entities.select(F.col("gid").alias(end), F.col("name").alias(f"{end}_name")), end, join)
            return rows

        stated = [t for t in types if t in self.stated_types]
        parts = [name(self.stated_edges(*stated), "inner").select("head_name", "tail_name", "type")] if stated else []
        if self.mode == "shipped" and set(types) & set(EVERYWHERE):
            more = name(self.edges_everywhere().where(F.col("type").isin(*types)), "left").select(F.col("head_name").alias("head"), F.col("tail_name").alias("tail"), "type", "seq")
            # a file's name is the file
            parts.append(self._each_file(more, F.col("file")).where(F.col("type").isin(*types)).select("head", "tail", "type"))
        if not parts:
            return self.entities.sparkSession.createDataFrame([], "head_name string, tail_name string, type string")
        return reduce(DataFrame.union, parts).toDF("head_name", "tail_name", "type")


#: The type of the ends of links.
END = "struct<id:long,field:string>"


def one(gid: Column) -> Column:
    """The end of a link that is one entity."""
    return F.struct(gid.cast("long").alias("id"), F.lit(None).cast("string").alias("field"))


def entities_of(facts: DataFrame, files: DataFrame) -> DataFrame:
    """Entities with dense ids by (file, kind, place): the running sum of counts per file, and a number within.

    Files' counts are dealt by ranges of file names; running sums are taken within a range and over the ranges' totals,
    so only one row per range meets in one window.  The entities are numbered file by file.
    """
    own = facts.where(F.col("kind").isin(*KINDS)).select("file", "kind", "seq", "name", "scope", "role", "start_line", "end_line", "type_text")
    each = files.select("file").distinct().select("file", F.lit("FILE").alias("kind"), F.lit(0).cast("long").alias("seq"), F.col("file").alias("name"))
    every = own.unionByName(each, allowMissingColumns=True)
    ranges = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a file's range must be the same in both uses
    dealt = kept(every.groupBy("file").agg(F.count("*").alias("n")).repartitionByRange(ranges, "file").withColumn("range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("range").agg(F.sum("n").alias("n"))
    totals = totals.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("earlier"))
    place = F.sum("n").over(Window.partitionBy("range").orderBy("file")) - F.col("n")
    starts = dealt.withColumn("place", place).join(totals, "range").select("file", (F.col("earlier") + F.col("place")).alias("start"))
    numbered = every.withColumn("within", F.row_number().over(Window.partitionBy("file").orderBy(kind_rank(F.col("kind")), "seq"))).join(starts, "file")
    gid = F.col("start") + F.col("within")
    type_ = F.when(F.col("kind") == "PARAM", "VARIABLE").otherwise(F.col("kind"))
    return numbered.select(gid.cast("string").alias("id"), "name", type_.alias("type"), "scope", "role", "start_line", "end_line", F.when(F.col("kind") != "FILE", F.col("file")).alias("source_file"), gid.cast("long").alias("gid"), "file", "kind", "seq", "type_text")


#: Room for the ids of one kind in the order of a file's content.
KIND_PLACES = 1 << 48


def kind_place(kind: str) -> int:
    return KINDS.index(kind) * KIND_PLACES


def kind_rank(kind: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, k in enumerate(KINDS):
        out = F.when(kind == k, i).otherwise(out)
    return out


class Symbols:
    """Names to ids over the whole corpus.  Plain equi joins: adaptive execution broadcasts what turns out small."""

    def __init__(self, entities: DataFrame, mode: str):
        self.shipped = mode == "shipped"
        self.of = of = lambda *kinds: entities.where(F.col("kind").isin(*kinds))
        self.functions = of("FUNCTION").groupBy("name").agg(F.max("gid").alias("id"))
        self.own_functions = of("FUNCTION").groupBy("file", "name").agg(F.max("gid").alias("id"))
        latest = F.max_by("gid", F.struct(F.col("kind") == "PARAM", F.col("gid"))).alias("id")  # a parameter wins
        self.variables = of("VARIABLE", "PARAM").groupBy("name", "scope").agg(latest)
        self.own_variables = of("VARIABLE", "PARAM").groupBy("file", "name", "scope").agg(latest)
        self.fields = of("FIELD").select("name").distinct()
        preferred = F.max_by("gid", F.struct(F.col("scope") == "global", F.col("gid"))).alias("id")
        self.structs = of("STRUCT").groupBy("name").agg(preferred)
        self.own_structs = of("STRUCT").groupBy("file", "name").agg(preferred)

    def function(self, df: DataFrame, name: str, out: str) -> DataFrame:
        return self._one(df, self.functions, self.own_functions, [(name, "name")], out)

    def variable(self, df: DataFrame, name: str, scope: Column, out: str) -> DataFrame:
        df = df.withColumn("__scope", scope)
        return self._one(df, self.variables, self.own_variables, [(name, "name"), ("__scope", "scope")], out).drop("__scope")

    def struct(self, df: DataFrame, name: str, out: str) -> DataFrame:
        return self._one(df, self.structs, self.own_structs, [(name, "name")], out)

    def _one(self, df: DataFrame, everywhere: DataFrame, own: DataFrame, keys: list, out: str) -> DataFrame:
        """Left join; in intended mode a definition of the same file comes before any other."""
        rename = lambda t, result: t.select(*[F.col(b).alias(f"__k{i}") for i, (_, b) in enumerate(keys)], *(["file"] if "file" in t.columns else []), F.col("id").alias(result))
        on = lambda: [F.col(a) == F.col(f"__k{i}") for i, (a, _) in enumerate(keys)]
        drop = [f"__k{i}" for i in range(len(keys))]
        cond = on()
        joined = df.join(rename(everywhere, "__any"), _all(cond), "left").drop(*drop)
        if self.shipped:
            return joined.withColumnRenamed("__any", out)
        local = rename(own, "__own").withColumnRenamed("file", "__file")
        joined = joined.join(local, _all([*on(), F.col("file") == F.col("__file")]), "left").drop(*drop, "__file")
        return joined.withColumn(out, F.coalesce("__own", "__any")).drop("__own", "__any")

    def resolve(self, df: DataFrame, kinds: set[str]) -> DataFrame:
        """Candidates (file, kind, fn, name, is_field), all of the kinds, with ``end``: the first of function, variable here, global variable,
        fields by name.  Returned names are never functions or, by name alone, fields; shipped calls don't look at globals.
        Fields stay a name, as a reference stands for all of that name.  Tables that no such kind looks into aren't joined."""
        called, returned, none = F.col("kind") == "CALL", F.col("kind") == "RETURN", F.lit(None).cast("long")
        out = self.function(df, "name", "__f") if kinds != {"RETURN"} else df.withColumn("__f", none)
        out = self.variable(out, "name", F.col("fn"), "__v")
        out = self.variable(out, "name", F.lit("global"), "__g") if not self.shipped or kinds != {"CALL"} else out.withColumn("__g", none)
        out = out.join(self.fields.select(F.col("name").alias("__n")), F.col("name") == F.col("__n"), "left")
        found = F.coalesce(F.when(~returned, F.col("__f")), F.col("__v"), F.when(~called if self.shipped else F.lit(True), F.col("__g")))
        id_ = F.when(~F.col("is_field"), found)
        field = F.when(id_.isNull() & (F.col("is_field") | ~returned), F.col("__n"))
        end = F.when(id_.isNotNull() | field.isNotNull(), F.struct(id_.cast("long").alias("id"), field.alias("field")))
        return out.withColumn("end", end).drop("__f", "__v", "__g", "__n")


def _all(conditions: list) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def macro_in_side(sides: DataFrame, macros: DataFrame | None, callee_end: bool) -> DataFrame:
    """sides with ``expanded``: the text of the first macro entry that lies inside the side's range, in the same file.

    A range join on the file and bins of lines, with containment as its residual.  With ``callee_end`` a call's macro must also begin
    before the end of the callee.
    """
    if macros is None:
        return sides.withColumn("expanded", F.lit(None).cast("string"))
    m = macros.select(F.col("file").alias("__file"), "ord", F.col("start").alias("__start"), F.col("end").alias("__end"), F.col("expanded").alias("__text"))
    at = lambda line, col: F.struct(F.col(line).alias("line"), F.col(col).alias("col"))
    inside = (at("side.start_line", "side.start_col") <= F.col("__start")) & (F.col("__end") <= at("side.end_line", "side.end_col"))
    if callee_end:
        inside = inside & ((F.col("kind") != "CALL") | (F.col("__start") < at("callee.end_line", "callee.end_col")))
    # a macro use begins on one line, a side spans few
    hits = holding(m, sides, F.col("file") == F.col("__file"), inside, F.col("__start.line"), F.col("side.start_line"), F.col("side.end_line"), LINES_A_BIN).groupBy("file", "kind", "seq", "s").agg(F.min_by("__text", "ord").alias("expanded"))
    return sides.join(hits, ["file", "kind", "seq", "s"], "left").withColumn("expanded", F.when(F.col("expanded") != "", F.col("expanded")))


def resolve_references(facts: DataFrame, symbols: Symbols, macros: DataFrame | None, kinds: set[str]) -> DataFrame:
    """Sides of the kinds of references (calls, assignments, returns) with ``end``: what the side resolves to; and ``owner``,
    the function around it.  One pass of joins serves all kinds."""
    refs = facts.where(F.col("kind").isin(*kinds)).select("file", "kind", "seq", "fn", F.posexplode("sides").alias("s", "side"), F.element_at("sides", -1).alias("callee"))
    refs = refs.where("kind <> 'CALL' or s = 0")
    # what is returned is not looked up among macros
    looked = macro_in_side(refs, macros if kinds != {"RETURN"} else None, callee_end=not symbols.shipped)
    expanded = F.when(F.col("kind") != "RETURN", F.col("expanded"))
    cands = F.when(expanded.isNotNull(), F.array(F.struct(expanded.alias("name"), F.lit(False).alias("is_field")))).otherwise(F.col("side.cands"))
    each = looked.select("file", "kind", "seq", "fn", "s", F.posexplode(cands).alias("pos", "c")).select("file", "kind", "seq", "fn", "s", "pos", "c.name", "c.is_field")
    found = symbols.resolve(each, kinds).where("end is not null").groupBy("file", "kind", "seq", "fn", "s").agg(F.min_by("end", "pos").alias("end"))
    return symbols.function(found, "fn", "owner")


def _relation(df: DataFrame, head: Column, tail: Column, type_: str, seq: Column | None = None) -> DataFrame:
    return df.select(head.alias("head"), tail.alias("tail"), F.lit(type_).alias("type"), F.lit(RELATIONS.index(type_)).alias("phase"), F.col("file"), (F.col("seq") if seq is None else seq).cast("long").alias("seq"))


def _owned(symbols: Symbols, type_: str) -> DataFrame:
    """HAS_PARAMETER or HAS_VARIABLE, as stated in the file of what is owned."""
    rows = symbols.of("PARAM") if type_ == "HAS_PARAMETER" else symbols.of("VARIABLE").where("scope <> 'global'")
    linked = symbols.function(rows.select("file", "scope", "gid", F.col("gid").alias("seq")), "scope", "head").where("head is not null")
    return _relation(linked, one(F.col("head")), one(F.col("gid")), type_)


def stated_relations_of(facts: DataFrame, symbols: Symbols, macros: DataFrame | None, types: list[str]) -> DataFrame:
    """Relations of the types, as Graph.stated has them."""
    of, parts = symbols.of, []
    kinds = {SOURCES_OF_SIDES[t] for t in types if t in SOURCES_OF_SIDES}
    sides = resolve_references(facts, symbols, macros, kinds) if kinds else None
    if len(kinds) > 1:
        sides = kept(sides, "sides")
    for type_ in types:
        if type_ in ("CALLS", "RETURNS"):
            rows = _relation(sides.where((F.col("kind") == SOURCES_OF_SIDES[type_]) & F.col("owner").isNotNull()), one(F.col("owner")), F.col("end"), type_)
        elif type_ == "ASSIGNED_TO":
            both = sides.where("kind = 'ASSIGN'").groupBy("file", "seq").agg(F.max(F.when(F.col("s") == 0, F.col("end"))).alias("l"), F.max(F.when(F.col("s") == 1, F.col("end"))).alias("r"))
            rows = _relation(both.where("l is not null and r is not null"), F.col("l"), F.col("r"), type_)
        elif type_ == "CONTAINS":
            # by kind and id within a file
            inside = of("FUNCTION", "STRUCT", "TYPEDEF", "ENUM").unionByName(of("VARIABLE").where("scope = 'global'"))
            file_ids = of("FILE").select(F.col("file").alias("f"), F.col("gid").alias("file_id"))
            contained = inside.join(file_ids, F.col("file") == F.col("f")).select("file", "file_id", "gid", (kind_rank(F.col("kind")).cast("long") * KIND_PLACES + F.col("gid")).alias("seq"))
            rows = _relation(contained, one(F.col("file_id")), one(F.col("gid")), type_)
        elif type_ == "HAS_MEMBER":
            members = symbols.struct(of("FIELD").select("file", "scope", "gid", F.col("gid").alias("seq")), "scope", "head").where("head is not null")
            rows = _relation(members, one(F.col("head")), one(F.col("gid")), type_)
        elif type_ == "TYPE_OF":
            typed = symbols.struct(of("VARIABLE", "PARAM", "FIELD").where("type_text is not null").select("file", "type_text", "gid", F.col("gid").alias("seq")), "type_text", "tail").where("tail is not null")
            rows = _relation(typed, one(F.col("gid")), one(F.col("tail")), type_)
        else:
            rows = _owned(symbols, type_)
        parts.append(rows)
    return reduce(DataFrame.unionByName, parts)


def relations_everywhere_of(symbols: Symbols) -> DataFrame:
    """What the shipped mode states for every file, as Graph.everywhere has it."""
    of = symbols.of
    # of several definitions the last counts, at the place of the first
    place = lambda kind, gid: (F.lit(kind_place(kind)) + gid).alias("seq")
    named = of("FUNCTION").groupBy("name").agg(F.max("gid").alias("gid"), place("FUNCTION", F.min("gid"))).select("gid", "seq")
    structs = of("STRUCT").groupBy("name", "scope").agg(F.max("gid").alias("gid"), place("STRUCT", F.min("gid"))).select("gid", "seq")
    with_globals = of("VARIABLE").where("scope = 'global'")
    last = with_globals.agg(F.max("file").alias("f"))
    targets = named.union(structs).union(with_globals.join(last, F.col("file") == F.col("f"), "left_semi").select("gid", place("VARIABLE", F.col("gid"))))
    # every file with everything: a quirk to keep
    contains = targets.select(F.lit(None).cast(END).alias("head"), one(F.col("gid")).alias("tail"), F.lit("CONTAINS").alias("type"), "seq")
    # once for each file: a quirk to keep
    return reduce(DataFrame.unionByName, [contains, *[_owned(symbols, t).select("head", "tail", "type", "seq") for t in ("HAS_PARAMETER", "HAS_VARIABLE")]])


def extract(files: DataFrame, macros: DataFrame | None = None, mode: str = "intended") -> Graph:
    """The graph of a corpus (file, content); macros as sources.macro_table() gives them.

    Facts and entities are written to the shared folder here, relations when they are first read; scratch.clear() deletes
    them.  macros is read with the relations.
    """
    facts = kept(file_facts(files, mode), "facts")  # parsed once, read by every extractor
    return Graph(kept(entities_of(facts, files), "entities"), facts, macros, mode)  # numbered once, read by every symbol table
