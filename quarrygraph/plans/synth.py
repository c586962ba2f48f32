"""C sources rendered from the part table, so that every extractor has input with results in closed form.

File ``src/f<k div 50>.c`` holds a block of 16 lines for each of its 50 part keys k, in order of k: a struct with a function pointer,
a static counter, and a function with a parameter, a local, a direct call, assignments, at every tenth key a call
through a macro, and a return.  File ``src/r<k div 50>.c`` holds a block of 23 lines of the rarer kinds: a typedef'd unnamed
struct, a union with a nested struct, an enum, a condition, several declarators, and calls with several macros each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph_build import Graph, extract

KEYS_A_FILE, LINES = 50, 16
BLOCK = """struct part_{k} {
    int size_{k};
    int price_{k};
    int (*op_{k})(int);
};
static int counter_{k};
int fn_{k}(struct part_{k} *p, int q)
{
    int local_{k} = q;
    fn_{a}(p, q);
    p->op_{k} = fn_{b};
    counter_{k} = local_{k};
    {use};
    return local_{k};
}
"""

RICH_LINES = 23
RICH = """typedef struct {
    int lo_{k};
    struct part_{a} *next_{k};
} span_{k};
union any_{k} {
    struct inner_{k} {
        int deep_{k};
    } in_{k};
    span_{k} range_{k};
};
enum tone_{k} { LOW_{k}, HIGH_{k} };
#if WITH_{k}
static span_{k} table_{k}, *cursor_{k};
#endif
int run_{k}(union any_{k} *u, int n)
{
    span_{k} here_{k};
    cursor_{k} = FIRST_{k}(SECOND_{k}(n));
    u->in_{k}.deep_{k} = n;
    fn_{a}(FIRST_{k}, SECOND_{k});
    return u->range_{k};
}
"""


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, file, i (place of the block in its file, from 0), and the targets a, b, c of calls."""
    keys = _keys(spark, sf_dir)
    return parts_of(keys, keys.count())


def parts_of(keys: DataFrame, count: int) -> DataFrame:
    """parts() of keys k, of which there are so many."""
    n = F.lit(count)
    file = F.concat(F.lit("src/f"), F.expr(f"k div {KEYS_A_FILE}"), F.lit(".c"))
    return keys.select("k", file.alias("file"), (F.col("k") % KEYS_A_FILE).alias("i"), ((F.col("k") * 7 + 1) % n).alias("a"), ((F.col("k") * 3 + 2) % n).alias("b"), ((F.col("k") * 11 + 3) % n).alias("c"))


def _filled(template: str) -> Column:
    text = F.lit(template)
    use = F.when(F.col("k") % 10 == 0, F.concat(F.lit("TARGET_"), F.col("k"), F.lit("(p, q)"))).otherwise(F.lit("(void)q"))
    for mark, value in (("{k}", F.col("k").cast("string")), ("{a}", F.col("a").cast("string")), ("{b}", F.col("b").cast("string")), ("{use}", use)):
        text = F.replace(text, F.lit(mark), value)
    return text


def _rendered(parts: DataFrame, template: str) -> DataFrame:
    spark = parts.sparkSession
    # a number of our own, as parsing takes far longer than the bytes behind it let adaptive execution expect
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = parts.repartition(tasks, "file").select("file", "k", _filled(template).alias("text"))  # filled by all tasks, not those of the few bytes of keys
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "text"))), lambda b: b["text"]), "\n")
    return blocks.groupBy("file").agg(whole.alias("content")).select("file", F.encode("content", "UTF-8").alias("content"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, content)."""
    return _rendered(parts(spark, sf_dir), BLOCK)


def rich_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).withColumn("file", F.replace(F.col("file"), F.lit("/f"), F.lit("/r")))


def rich_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, content) of the rarer kinds."""
    return _rendered(rich_parts(spark, sf_dir), RICH)


def macros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The macro table of the rendered uses."""
    return macros_of(parts(spark, sf_dir))


def macros_of(parts: DataFrame) -> DataFrame:
    line = (F.col("i") * LINES + 13).cast("int")
    name = F.concat(F.lit("TARGET_"), F.col("k"))
    spot = lambda col: F.struct(line.alias("line"), col.cast("int").alias("col"))
    return parts.where("k % 10 = 0").select("file", F.col("k").cast("int").alias("ord"), spot(F.lit(5)).alias("start"), spot(F.lit(5) + F.char_length(name)).alias("end"), F.concat(F.lit("fn_"), F.col("c")).alias("expanded"), name.alias("original"))


def rich_macros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The macro table of the rarer kinds: two uses in each of two lines, the one that stands second first in the table."""
    digits = F.char_length(F.col("k").cast("string"))
    first, second = F.concat(F.lit("FIRST_"), F.col("k")), F.concat(F.lit("SECOND_"), F.col("k"))
    uses = []  # line in the block, column, name, target
    for line, at, gap in ((18, F.lit(4 + 7 + 3 + 1) + digits, 1), (20, F.lit(4 + 3 + 1 + 1) + F.char_length(F.col("a").cast("string")), 2)):
        uses += [(line, at + F.char_length(first) + gap, second, F.col("b")), (line, at, first, F.col("c"))]
    one = F.array(*[F.struct((F.col("i") * RICH_LINES + line).cast("int").alias("line"), col.cast("int").alias("col"), name.alias("name"), target.alias("target")) for line, col, name, target in uses])
    each = rich_parts(spark, sf_dir).select("file", "k", F.posexplode(one).alias("j", "u"))
    spot = lambda col: F.struct(F.col("u.line").alias("line"), col.cast("int").alias("col"))
    return each.select("file", (F.col("k") * 4 + F.col("j")).cast("int").alias("ord"), spot(F.col("u.col")).alias("start"), spot(F.col("u.col") + F.char_length("u.name")).alias("end"), F.concat(F.lit("fn_"), F.col("u.target")).alias("expanded"), F.col("u.name").alias("original"))


_graphs: dict[tuple, Graph] = {}


def _state(keys: DataFrame) -> tuple:
    """What the rendered sources hang on, so that a changed table gives a new graph: the number of keys, and a sum."""
    return tuple(keys.agg(F.count("*"), F.sum(F.xxhash64("k").cast("decimal(38,0)"))).first())


def graph(spark: SparkSession, sf_dir: str, mode: str = "intended") -> Graph:
    """The graph of the rendered sources, parsed once per session, table and mode."""
    keys = _keys(spark, sf_dir)
    state = _state(keys)
    key = (spark.sparkContext.applicationId, sf_dir, mode, state)
    if key not in _graphs:
        made = parts_of(keys, state[0])
        _graphs[key] = extract(_rendered(made, BLOCK), macros_of(made), mode)
    return _graphs[key]


def rich_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of both kinds of rendered sources, in the intended mode."""
    key = (spark.sparkContext.applicationId, sf_dir, "rich", _state(_keys(spark, sf_dir)))
    if key not in _graphs:
        both = files(spark, sf_dir).unionByName(rich_files(spark, sf_dir))
        _graphs[key] = extract(both, macros(spark, sf_dir).unionByName(rich_macros(spark, sf_dir)), "intended")
    return _graphs[key]


def forget() -> None:
    """Graphs are made anew from here on."""
    _graphs.clear()
