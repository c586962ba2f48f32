"""Two-pass external shuffle into shards of equal counts, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared


#: Starts of buckets are broadcast up to so many buckets (16 bytes each), beyond that joined by a shuffle.
MAX_BROADCAST_BUCKETS = 1 << 20


def two_pass_shuffle(rows: DataFrame, n_shards: int, bucket_bytes: int = 16 << 20, seed: int = 17, weight=None, stored: bool = False) -> DataFrame:
    """The rows in uniformly random order, dealt into ``n_shards`` shards whose counts differ by one at most.

    Pass one scatters records to memory-sized buckets by a seeded hash of their place in the input, a task for each
    bucket.  Pass two brings a bucket into the order of its places, Fisher-Yates shuffles it (Spark's shuffle() of the
    bucket's array, whose generator is seeded by the seed and the task's number, which is the bucket's) and writes it, a
    file for each bucket.  Buckets follow one another, so a record's global place is its bucket's start plus its place there,
    and shards are equal stretches of places.  The result reads the written buckets.  It depends on the rows' places, the seed
    and the bytes, not on shuffle partitions or on which tasks run again.

    The hash takes the record's place, not its content, so repeated rows, null ids and hot keys spread like any others.
    ``weight``: bytes of a row (null: 0), by which buckets are sized to fit memory; a row larger than a bucket makes its bucket larger.
    ``stored``: rows come straight from files, whose order is fixed; other rows are written once, to fix their places.
    All columns stay, but for ones named like the added ``shard`` int and ``slot`` long, which give way.  An empty table stays empty.
    """
    rows = rows.drop("shard", "slot")
    columns = rows.columns
    weight = F.lit(1024) if weight is None else weight
    held = rows.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.coalesce(weight.cast("long"), F.lit(0)).alias("bytes"), F.monotonically_increasing_id().alias("at"))
    if not stored:
        held = shared.materialize(held, "places")
    n, total = held.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    buckets = max(1, -(-total // bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.lit(seed), "at"), F.lit(buckets)).cast("int")
    scattered = held.select(bucket.alias("bucket"), F.struct("at", "row").alias("one")).repartitionById(buckets, "bucket")
    arrays = scattered.groupBy("bucket").agg(F.sort_array(F.collect_list("one")).alias("all"))
    shuffled = shared.materialize(arrays.select("bucket", F.posexplode(F.shuffle("all", F.lit(seed))).alias("i", "one")).select("bucket", "i", F.col("one.row").alias("row")), "buckets")
    # starts of buckets: sums within blocks of 4096 buckets and of the blocks before, so no window sees them all
    counts = shuffled.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("block", F.expr("bucket div 4096"))
    blocks = counts.groupBy("block").agg(F.sum("n").alias("block_n"))
    blocks = blocks.select("block", (F.sum("block_n").over(Window.orderBy("block")) - F.col("block_n")).alias("block_start"))
    inside = F.sum("n").over(Window.partitionBy("block").orderBy("bucket")) - F.col("n")
    starts = counts.withColumn("inside", inside).join(blocks, "block").select("bucket", (F.col("block_start") + F.col("inside")).alias("start"))
    starts = F.broadcast(starts) if buckets <= MAX_BROADCAST_BUCKETS else starts
    place = F.col("start") + F.col("i")
    # the first n % n_shards shards have one more
    small, more = n // n_shards, n % n_shards
    edge = more * (small + 1)
    shard = F.when(place < edge, F.floor(place / F.lit(small + 1))).otherwise(more + F.floor((place - edge) / F.lit(max(small, 1))))
    first = F.when(shard < more, shard * (small + 1)).otherwise(edge + (shard - more) * small)
    return shuffled.join(starts, "bucket").select(*[F.col(f"row.`{c}`").alias(c) for c in columns], shard.cast("int").alias("shard"), (place - first).cast("long").alias("slot"))


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards under the law `rows`: counts at most one apart."""
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    out = two_pass_shuffle(docs, 8, weight=size, stored=True)
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return out.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
