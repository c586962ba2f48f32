"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

#: Fixed value: what counts as a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, null last, repeating.
WEIGHTS = (3, 1, 2)
HASH_BITS, LEVEL_BITS = 60, 10
MAX_BROADCAST_SOURCES = 20_000


def words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def doc_hash(doc_id, text):
    """60 bits of an MD5 of id and text, as a long; the same in every engine."""
    plain = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(F.encode(plain, "UTF-8")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source (rows source, source_size) its target: weighted shares of ``share`` times all, stopping at ``most``
    times the source's size, the excess shared anew by weight until none is above.

    Sources are numbered within ranges of their names, so only a row for each range meets in one task.  The level that all
    open sources share rises as sources stop: each round is one sum over the sources, until none stops any more.  No
    source or an empty table gives no rows.
    """
    spark = sizes.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("source").isNull(), F.col("source")]
    dealt = shared.materialize(sizes.select("source", "source_size").repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), "sources")
    before = dealt.groupBy("range").agg(F.count("*").alias("n"))
    before = before.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    ranked = dealt.join(before, "range").withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(*order)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS))).cast("int") + 1)
    table = shared.materialize(ranked.select("source", "source_size", weight.alias("weight"), (F.lit(most) * F.col("source_size")).alias("stop")), "sources")
    budget = share * float(table.agg(F.sum("source_size")).first()[0] or 0)
    level, last = 0.0, -1
    while True:
        open_ = F.col("stop") / F.col("weight") >= F.lit(level)
        stopped, weights, n = table.agg(F.sum(F.when(~open_, F.col("stop"))), F.sum(F.when(open_, F.col("weight"))), F.count_if(open_)).first()
        if not n:
            level = float("inf")
        if not n or n == last:
            break
        level, last = (budget - (stopped or 0.0)) / weights, n
    return table.select("source", "source_size", F.least(F.col("stop"), F.col("weight") * F.lit(level)).alias("target"))


def mix(rows: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Rows (doc_id, text, source and any more) with size, source_size, target and ``copies`` (0 to ``most``).

    A source's whole multiples come as copies of every document; what remains of its target is filled by the documents
    whose hash lies below the source's threshold.  The threshold comes from histograms: sizes are summed by source and
    the top bits of the hash, cumulative sums find the bucket in which the budget ends, and only the rows of that
    bucket are summed again by the next bits, until it holds one hash.  No rows are sorted, none are sampled.
    The last hash is taken or left, whichever comes nearer; of equal rows (one source, id and text) at the threshold as many
    are taken as come nearest, so a source's words come within half a document of its target, however the rows are
    dealt; which of several equal rows that is, is open.  Null texts have size 0, null sources are a source, and an
    empty table stays empty.  Columns of rows named like an added one give way to it.
    """
    rows = rows.drop("size", "source_size", "target", "copies")
    key = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("source"))
    hashed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("__row"), words(F.col("text")).alias("__size"), doc_hash(F.col("doc_id"), F.col("text")).alias("__h"), key.alias("__source"))
    # the slim table that every level reads: rows of one source and hash are one row, so a hot document is no load
    slim = shared.materialize(hashed.groupBy("__source", "__h").agg(F.sum("__size").alias("__size"), F.count("*").alias("__n")), "mix")
    sizes = slim.groupBy("__source").agg(F.sum("__size").alias("source_size"))
    named = sizes.select(F.when(~F.col("__source.none"), F.col("__source.source")).alias("source"), "source_size")
    targets = source_targets(named, share, most).select(key.alias("__source"), "source_size", "target")
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(most)))).otherwise(F.lit(0)).cast("int")
    plan = targets.withColumn("__whole", whole).withColumn("__need", F.col("target") - F.col("__whole") * F.col("source_size"))
    # low: start of the hash range in which the budget ends; need: what is left of it there
    plan = shared.materialize(plan.withColumn("__low", F.lit(0).cast("long")), "mix")
    n_sources = plan.count()
    near = (lambda df: F.broadcast(df)) if n_sources <= MAX_BROADCAST_SOURCES else (lambda df: df)
    rest = slim
    for level in range(HASH_BITS // LEVEL_BITS):
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        bucket = F.shiftright(F.col("__h"), shift)
        inside = rest.join(near(plan.select("__source", "__low", "__need")), "__source")
        inside = inside.where((F.shiftright("__h", shift + LEVEL_BITS) == F.shiftright("__low", shift + LEVEL_BITS)) & (F.col("__need") > 0))
        bars = inside.groupBy("__source", bucket.alias("bucket")).agg(F.sum("__size").alias("bar"), F.count("*").alias("hashes"), F.first("__need").alias("__need"))
        # at most 2 ** LEVEL_BITS bars a source
        upto = F.sum("bar").over(Window.partitionBy("__source").orderBy("bucket"))
        edge = bars.withColumn("upto", upto).where(F.col("upto") >= F.col("__need")).groupBy("__source").agg(F.min_by(F.struct("bucket", (F.col("__need") - (F.col("upto") - F.col("bar"))).alias("need"), "hashes"), "bucket").alias("e"))
        refined = plan.join(edge, "__source", "left").select("__source", "source_size", "target", "__whole", F.coalesce(F.col("e.need"), F.when(F.col("__need") > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))).alias("__need"), F.when(F.col("e").isNotNull(), F.shiftleft(F.col("e.bucket"), shift)).when(F.col("__need") > 0, F.lit(1 << HASH_BITS)).otherwise(F.col("__low")).alias("__low"), F.col("e.hashes").alias("__hashes"))
        plan = shared.materialize(refined, "mix")
        if (plan.agg(F.max(F.coalesce("__hashes", F.lit(0)))).first()[0] or 0) <= 1:
            break
        plan = plan.drop("__hashes")
    # the boundary hash itself: the whole range at low of this level's width holds one hash at most
    bound = rest.join(near(plan.select("__source", "__low", "__need")), "__source").where((F.col("__need") > 0) & (F.shiftright("__h", shift) == F.shiftright("__low", shift)))
    bound = bound.groupBy("__source").agg(F.max("__h").alias("__edge"), F.sum("__size").alias("__edge_size"), F.sum("__n").alias("__edge_n"))
    ready = shared.materialize(plan.drop("__hashes").join(bound, "__source", "left"), "mix")
    out = hashed.join(near(ready), "__source")
    at_edge = F.coalesce(F.col("__h") == F.col("__edge"), F.lit(False))
    tied = at_edge & (F.col("__edge_n") > 1)
    # so many of the equal rows of the boundary hash come nearest to what is left
    take = F.ceil(F.col("__need") * F.col("__edge_n") / F.col("__edge_size") - 0.5)
    parts = [out.withColumn("__extra", F.when(F.col("__h") < F.col("__low"), 1).when(at_edge, take.cast("int")).otherwise(0))]
    if ready.agg(F.max("__edge_n")).first()[0] not in (None, 1):
        parts[0] = parts[0].where(~tied)
        # equal rows are counted through, file by file of a table of their own, so no task sees them all
        part = F.shiftright("__at", 33)
        same = shared.materialize(out.where(tied).withColumn("take", take).withColumn("__at", F.monotonically_increasing_id()), "mix").withColumn("__part", part)
        held = same.groupBy("__source", "__part").agg(F.count("*").alias("__held"))
        held = held.withColumn("__before", F.sum("__held").over(Window.partitionBy("__source").orderBy("__part")) - F.col("__held")).drop("__held")
        number = F.col("__before") + F.row_number().over(Window.partitionBy("__source", "__part").orderBy("__at"))
        parts.append(same.join(held, ["__source", "__part"]).withColumn("__extra", (number <= F.col("take")).cast("int")))
    copies = F.least(F.col("__whole") + F.col("__extra"), F.lit(int(most))).cast("int").alias("copies")
    done = [x.select(*[F.col(f"__row.`{c}`").alias(c) for c in rows.columns], F.col("__size").alias("size"), "source_size", "target", copies) for x in parts]
    return done[0] if len(done) == 1 else done[0].unionByName(done[1])


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed 3 : 1 : 2 to 150 % of their words."""
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


#: The same result by sorting: a document is taken once more when its hash's prefix sum ends nearer to the budget with it.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS rank FROM s),
w AS (SELECT *, [3.0, 1.0, 2.0][((rank - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS stop FROM r),
o AS (SELECT *, coalesce(sum(stop) OVER (ORDER BY stop / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS stopped,
        sum(weight) OVER (ORDER BY stop / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS open,
        (sum(source_size) OVER ())::DOUBLE AS everything FROM w),
l AS (SELECT *, CASE WHEN (1.5::DOUBLE * everything - stopped) / open <= stop / weight THEN (1.5::DOUBLE * everything - stopped) / open END AS level FROM o),
t AS (SELECT source, source_size, least(stop, weight * coalesce(max(level) OVER (), 'inf'::DOUBLE)) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END::BIGINT AS whole FROM t),
c AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS need,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  (size * least(2, whole + CASE WHEN upto < need THEN 1 WHEN upto - size >= need THEN 0 WHEN (need - (upto - size)) / nullif(size, 0) > 0.5 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
