"""Near-duplicate documents by BagMinHash signatures of word-shingle multisets, banded and verified exactly."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

BANDS, BAND_ROWS = 24, 5
REGISTERS = BANDS * BAND_ROWS
#: A pair whose estimate from byte sketches is lower is not verified: 4.4 standard deviations under a similarity of 0.8.
ESTIMATE_SLACK = 0.16
#: Size of the broadcast that thins out texts before they are moved for verification.
NEED_BUCKETS = 1 << 20


def _mix(x):
    """SplitMix64's finalizer on an array of unsigned 64-bit integers."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _unit(x):
    """Uniform in (0, 1]."""
    import numpy as np

    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


class Shingler:
    """Multisets of hashed word shingles of whole texts."""

    def __init__(self, words: int = 5, max_words: int = 200_000):
        self.n, self.max_words, self.seen = words, max_words, {}

    def bag(self, text: str):
        """Distinct shingle hashes in ascending order, and their counts.  Texts of fewer words are one shingle, empty ones none."""
        import numpy as np
        import xxhash

        words = text.split()
        if not words:
            return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        seen = self.seen
        try:
            h = np.array([seen[w] for w in words], dtype=np.uint64)
        except KeyError:
            if len(seen) > self.max_words:
                seen.clear()
            h = np.array([seen[w] if w in seen else seen.setdefault(w, xxhash.xxh64_intdigest(w)) for w in words], dtype=np.uint64)
        n = min(self.n, len(h))
        s = np.full(len(h) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            s = _mix(s * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
        return np.unique(s, return_counts=True)


def similarity(a, b) -> float:
    """Weighted Jaccard of two bags: sum of minima by sum of maxima; two empty bags are equal."""
    import numpy as np

    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = int(np.minimum(a[1][i], b[1][j]).sum())
    return low / (total - low)


def signatures(bags: list, m: int = REGISTERS):
    """An (n, m) array of unsigned 64-bit registers; two agree in a register with the bags' weighted Jaccard as chance.

    Weights are discretised at the integers.  Every element has a Poisson process of points (time, register, level)
    over its levels, built from dyadic blocks (0, 1], (1, 2], (2, 4], ...: a block's process is one of rate m times its
    length, and its halves are told apart by the point's level, so a weight that ends inside a block uses the points
    below it.  A register keeps its earliest point.  Blocks give their points in order of time, and only those that come
    before the time by which all registers of the bag are filled are made: about m (ln m + 4) points whatever
    the bag's size.  Bags whose registers are not full by then go again with twice the time.
    """
    import numpy as np

    out = np.zeros((len(bags), m), dtype=np.uint64)
    left, stretch = [i for i, b in enumerate(bags) if len(b[0])], np.log(m) + 4
    while left:
        sizes = [len(bags[i][0]) for i in left]
        doc = np.repeat(np.arange(len(left)), sizes)
        element = np.concatenate([bags[i][0] for i in left])
        weight = np.concatenate([bags[i][1] for i in left])
        until = stretch / np.array([bags[i][1].sum() for i in left], dtype=np.float64)
        low, length, key = np.zeros(len(doc), dtype=np.int64), np.ones(len(doc), dtype=np.int64), _mix(element)
        parts = [(doc, weight, low, length, key)]
        block = 1
        while (more := weight > block).any():
            parts.append((doc[more], weight[more], np.full(more.sum(), block), np.full(more.sum(), block), _mix(element[more] + np.uint64(block * 0xD6E8FEB86659FD93 % (1 << 64)))))
            block *= 2
        doc, weight, low, length, key = (np.concatenate(c) for c in zip(*parts))
        best = np.full(len(left) * m, np.inf)
        time, rate, step = np.zeros(len(doc)), m * length.astype(np.float64), 0
        limit = until[doc]
        while len(doc):
            step += 1
            draw = _mix(key + np.uint64(step * 0x9E3779B97F4A7C15 % (1 << 64)))
            time = time - np.log(_unit(draw)) / rate
            on = time <= limit
            doc, weight, low, length, key, rate, limit, time, draw = (x[on] for x in (doc, weight, low, length, key, rate, limit, time, draw))
            spot = _mix(draw ^ np.uint64(0xA0761D6478BD642F))
            level = low + 1 + ((spot >> np.uint64(32)).astype(np.int64) * length >> 32)
            inside = level <= weight
            register = (spot & np.uint64(0xFFFFFFFF)).astype(np.int64) * m >> 32
            np.minimum.at(best, (doc * m + register)[inside], time[inside])
        best = best.reshape(len(left), m)
        full = np.isfinite(best).all(1)
        out[np.asarray(left)[full]] = _mix(best[full].view(np.uint64))
        left, stretch = [i for i, f in zip(left, full) if not f], stretch * 2
    return out


def _bands(sig):
    """Band hashes (n, BANDS) as signed 64-bit integers, and byte sketches."""
    import numpy as np

    x = np.zeros((len(sig), BANDS), dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(BAND_ROWS):
        x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + sig[:, i::BAND_ROWS])
    return x.view(np.int64), (sig & np.uint64(0xFF)).astype(np.uint8)


def text_key(text) -> list:
    """128 bits of a text as columns k1 and k2; a null text is empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, k1 and k2 (hash of the text), bands array<long>, sketch binary: one narrow pass over whole texts."""
    shared.ship(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shingler = Shingler()
        for b in batches:
            keys, texts = b.columns[:3], b.column(3)
            for at in range(0, len(texts), 256):
                bands, sketch = _bands(signatures([shingler.bag(x) for x in texts.slice(at, 256).to_pylist()]))
                lists = pa.ListArray.from_arrays(pa.array(range(0, bands.size + 1, BANDS), pa.int32()), pa.array(bands.ravel()))
                yield pa.RecordBatch.from_arrays([*(c[at : at + 256] for c in keys), lists, pa.array([s.tobytes() for s in sketch], pa.binary())], names=["doc_id", "k1", "k2", "bands", "sketch"])
        shared.trim()

    few = docs.select(F.col("doc_id").cast("long"), *text_key(F.col("text")), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return few.mapInArrow(run, "doc_id long, k1 long, k2 long, bands array<long>, sketch binary")


def _texts(needed: DataFrame, unique: DataFrame, docs: DataFrame) -> DataFrame:
    """(t, text) of the texts numbered in needed (a column t, which may repeat), each once."""
    named = needed.select("t").distinct().join(unique.select("t", "k1", "k2"), "t")
    # at most NEED_BUCKETS rows, so this broadcast has a bound; a saturated one just thins out nothing
    wanted = F.broadcast(named.select(F.pmod("k1", F.lit(NEED_BUCKETS)).alias("bucket")).distinct())
    texts = docs.select(*text_key(F.col("text")), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(wanted, F.pmod("k1", F.lit(NEED_BUCKETS)) == F.col("bucket"), "left_semi").dropDuplicates(["k1", "k2"]).join(named, ["k1", "k2"]).select("t", "text")


def _verified(pairs: DataFrame, unique: DataFrame, docs: DataFrame, threshold: float, block_rows: int = 512) -> DataFrame:
    """The pairs (a, b) of text numbers whose texts have at least the similarity, by their whole multisets.

    The a of one b come in blocks, and b's text goes to each block once, ahead of theirs, not to each a.
    """
    parts = _tasks(pairs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shingler, bag_b, good = Shingler(), None, ([], [])
        for batch in batches:
            for b, a, text in zip(*[c.to_pylist() for c in batch.select(["b", "a", "text"]).columns]):
                if a is None:
                    bag_b = shingler.bag(text)
                elif similarity(shingler.bag(text), bag_b) >= threshold:
                    good[0].append(a)
                    good[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in good], names=["a", "b"])
            good = ([], [])
        shared.trim()

    texts = shared.materialize(_texts(pairs.select(F.col("a").alias("t")).union(pairs.select(F.col("b").alias("t"))), unique, docs), "texts")
    counts = shared.materialize(pairs.groupBy("b").agg(F.ceil(F.count("*") / F.lit(float(block_rows))).cast("int").alias("blocks")), "counts")
    heads = counts.join(texts.withColumnRenamed("t", "b"), "b").select("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("long").alias("a"), "text")
    block = F.pmod(F.xxhash64(F.lit(5), "a"), F.col("blocks")).cast("int")
    rows = pairs.join(counts, "b").select("b", block.alias("block"), "a").join(texts.withColumnRenamed("t", "a"), "a").select("b", "block", "a", "text")
    dealt = heads.unionByName(rows).repartition(parts, "b", "block").sortWithinPartitions("b", "block", F.col("a").asc_nulls_first())
    return dealt.mapInArrow(run, "a long, b long")


def _tasks(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _blocks_of(batches: Iterator, work) -> Iterator:
    """Rows come sorted by bucket, i and j; work gets the rows of one such block pair at a time and gives (a, b) arrays."""
    import numpy as np
    import pyarrow as pa

    def out(parts: list):
        a, b = (np.concatenate(c) for c in zip(*parts))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    held, at = [], None
    for batch in batches:
        parts = []
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if held and at != row[:3]:
                parts.append(work(held))
                held = []
            at = row[:3]
            held.append(row)
        if parts:
            yield out(parts)
    if held:
        yield out([work(held)])


def _leftover_links(members: DataFrame, unique: DataFrame, docs: DataFrame, threshold: float, block_rows: int = 512) -> DataFrame:
    """Links (a, b) that connect members (bucket, t, component, sketch) of one bucket and different components.

    A bucket is cut into blocks of bounded size.  First sketches are compared, each pair of blocks by array operations,
    and the members with a partner that may be similar enough stay; then their whole texts' multisets are compared, a pair
    of blocks by one product, so the decision is exact.  Both give a row per member, never a row per pair.
    """
    parts = _tasks(members.sparkSession)
    # a table of its own, so the join with it is a plain one that adaptive execution splits at hot buckets
    counts = shared.materialize(members.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(float(block_rows))).cast("int").alias("blocks")), "counts")
    own = F.pmod(F.xxhash64(F.lit(3), "t"), F.col("blocks")).cast("int")
    spread = members.join(counts, "bucket").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "t", "component", "sketch")
    dealt = lambda df: df.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "t")

    def apart(block: list, at: slice):
        """Pairs (some rows, all rows) of different components that this pair of blocks is there to compare."""
        import numpy as np

        own, comp = np.array([r[3] for r in block]), np.array([r[5] for r in block])
        pairs = comp[at, None] != comp[None]
        if block[0][1] != block[0][2]:
            pairs &= own[at, None] != own[None]
        return pairs

    def sketched(block: list):
        import numpy as np

        t, hit = np.array([r[4] for r in block]), np.zeros(len(block), dtype=bool)
        sketch = np.frombuffer(b"".join(r[6] for r in block), dtype=np.uint8).reshape(len(block), -1)
        for at in range(0, len(t), 64):
            some = slice(at, at + 64)
            agree = (sketch[some, None, :] == sketch[None]).sum(2) >= (threshold - ESTIMATE_SLACK) * REGISTERS
            hit[some] = (agree & apart(block, some)).any(1)
        return np.full(hit.sum(), block[0][0]), t[hit]

    near = dealt(spread).mapInArrow(lambda batches: _blocks_of(batches, sketched), "a long, b long").distinct()
    near = shared.materialize(near.select(F.col("a").alias("bucket"), F.col("b").alias("t")), "near")
    # blocks anew, of what is left
    texts = _texts(near, unique, docs)
    left = shared.materialize(members.select("bucket", "t", "component").join(near, ["bucket", "t"]), "left")
    counts = shared.materialize(left.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(float(block_rows))).cast("int").alias("blocks")), "counts")
    spread = left.join(counts, "bucket").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "t", "component").join(texts, "t")
    spread = spread.select("bucket", "i", "j", "own", "t", "component", "text")

    def linked(batches: Iterator) -> Iterator:
        import numpy as np

        shingler = Shingler()

        def exact(block: list):
            bags = [shingler.bag(r[6]) for r in block]
            t, total = np.array([r[4] for r in block]), np.array([b[1].sum() for b in bags])
            # a shingle met w times is w elements, so a common element counts once for each unit of the lesser weight
            row = np.repeat(np.arange(len(bags)), total)
            first = np.concatenate([np.repeat(b[0], b[1]) for b in bags])
            unit = np.concatenate([np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w) for _, w in bags])
            _, column, met = np.unique(_mix(first + unit.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), return_inverse=True, return_counts=True)
            common = met[column] > 1
            _, column = np.unique(column[common], return_inverse=True)
            row, both = row[common], np.zeros((len(bags), len(bags)), dtype=np.float32)
            order = np.argsort(column, kind="stable")
            row, column = row[order], column[order]
            for low in range(0, int(column.max(initial=-1)) + 1, 4096):
                a, b = np.searchsorted(column, (low, low + 4096))
                part = np.zeros((len(bags), 4096), dtype=np.float32)
                part[row[a:b], column[a:b] - low] = 1
                both += part @ part.T
            link = (both >= threshold * (total[:, None] + total[None] - both)) & apart(block, slice(None))
            low = np.arange(len(bags))  # rows are in ascending t
            while True:
                lower = np.minimum(low, np.where(link, low[None], len(bags)).min(1))
                lower = lower[lower]
                if (lower == low).all():
                    break
                low = lower
            some = low != np.arange(len(bags))
            return t[some], t[low[some]]

        yield from _blocks_of(batches, exact)
        shared.trim()

    return dealt(spread).mapInArrow(linked, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Per row: doc_id, k1 and k2 (hash of its text), class_id, kept.

    Texts link when the weighted Jaccard of their multisets of five-word shingles is at least ``threshold``; classes are
    what links connect, equal texts included, and ``class_id`` is the smallest doc_id of the class (null only if all
    are null); ``kept`` marks the rows with that id and one text of the class, the least hash of those that occur with it,
    so only rows repeated in id and text are kept together.  Null texts are empty, empty texts are equal; very long texts
    are read whole, one at a time; an empty table gives no rows; other columns, whatever their names, are not read.

    Signatures come from one narrow pass; equal texts (by 128 bits) are one node from there on, with a number of its own.
    In each bucket of each band every text is first compared with the bucket's least (a text's best such partner is
    verified), which joins most groups in time linear in their size; then members of one bucket that are still in
    different components are compared with each other in bounded blocks, by sketches and then exactly.  So no link between
    texts that share a bucket is lost but those whose sketches agree in 0.16 less than ``threshold`` (4.4 standard
    deviations, so one link in 10^5 at the threshold, rarer above), no bucket's pairs are emitted, and a pair at the
    threshold shares a bucket with chance 0.9999.
    """
    with shared.few_records(docs.sparkSession, shared.TEXT_RECORDS):
        signed = shared.materialize(sign(docs), "signed")
    unique = signed.groupBy("k1", "k2").agg(F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("least"))
    unique = shared.materialize(unique.withColumn("t", F.monotonically_increasing_id()), "unique")
    in_band = unique.select("t", F.explode("bands").alias("bucket"))
    # tables of their own, so the joins with them are plain ones that adaptive execution splits at hot buckets
    crowded = shared.materialize(in_band.groupBy("bucket").agg(F.min("t").alias("rep"), F.max("t").alias("last")).where("rep < last").select("bucket", "rep"), "crowded")
    members = shared.materialize(in_band.join(crowded, "bucket"), "members")
    sketches = unique.select("t", "sketch")
    pairs = members.where("t <> rep").select("t", "rep").distinct()
    pairs = pairs.join(sketches, "t").join(sketches.select(F.col("t").alias("rep"), F.col("sketch").alias("sketch_rep")), "rep")
    agree = F.aggregate(F.sequence(F.lit(0), F.lit(REGISTERS - 1)), F.lit(0), lambda acc, i: acc + F.when(F.substring(F.col("sketch"), i + 1, 1) == F.substring(F.col("sketch_rep"), i + 1, 1), 1).otherwise(0))
    best = pairs.select("t", "rep", agree.alias("agree")).where(F.col("agree") >= (threshold - ESTIMATE_SLACK) * REGISTERS)
    best = best.groupBy("t").agg(F.max_by("rep", F.struct("agree", "rep")).alias("rep"))
    first = shared.materialize(best.select(F.col("t").alias("a"), F.col("rep").alias("b")), "pairs")
    with shared.few_records(docs.sparkSession, shared.TEXT_RECORDS):
        links = shared.materialize(_verified(first, unique, docs, threshold), "verified")
    groups = shared.materialize(shared.components(links), "groups")
    labelled = members.select("bucket", "t").join(groups.withColumnRenamed("id", "t"), "t", "left").withColumn("component", F.coalesce("component", "t"))
    labelled = shared.materialize(labelled, "labelled")
    mixed = shared.materialize(labelled.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("bucket"), "buckets")
    rest = shared.materialize(labelled.join(mixed, "bucket").join(sketches, "t"), "mixed")
    with shared.few_records(docs.sparkSession, shared.TEXT_RECORDS):
        more = shared.materialize(_leftover_links(rest, unique, docs, threshold), "verified")
    groups = shared.components(links.union(more))
    judged = unique.select("t", "k1", "k2", "least").join(groups.withColumnRenamed("id", "t"), "t", "left").withColumn("component", F.coalesce("component", "t"))
    classes = judged.groupBy("component").agg(F.min("least").alias("class_id"), F.min(F.struct(F.col("least").isNull(), "least", "k1", "k2", "t"))["t"].alias("chosen"))
    named = judged.join(classes, "component").select("k1", "k2", "class_id", (F.col("t") == F.col("chosen")).alias("chosen"))
    return signed.select("doc_id", "k1", "k2").join(named, ["k1", "k2"]).select("doc_id", "k1", "k2", "class_id", (F.col("chosen") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"))


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of docs, one of each class: that with the smallest doc_id; of several texts with that id and of repeated rows one."""
    kept = near_duplicates(docs, threshold).where("kept").select(F.col("doc_id").alias("__kept"), F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).distinct()
    k1, k2 = text_key(F.col("text"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), k1.alias("__a"), k2.alias("__b"), F.col("doc_id").cast("long").alias("__id"))
    out = rows.join(kept, (F.col("__a") == F.col("__k1")) & (F.col("__b") == F.col("__k2")) & F.col("__id").eqNullSafe(F.col("__kept"))).dropDuplicates(["__a", "__b", "__id"])
    return out.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def op6_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return near_duplicates(shared.table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")
