"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products within cells, one representative per group."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, vectors


def spherical_kmeans(x, k: int, rounds: int = 8, seed: int = 11):
    """k unit centres for unit rows x."""
    import numpy as np

    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        home = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-12), centres)
    return centres


def linked_pairs(a, b, threshold: float, same: bool):
    """Places (i, j) of the unit rows of a and b whose product in double precision is at least ``threshold``; of one
    block with itself each pair once.  Products in single precision leave out what is clearly less."""
    import numpy as np

    single_a, single_b, found = a.astype(np.float32), b.astype(np.float32), [np.empty((2, 0), dtype=np.int32)]
    for low in range(0, len(a), 512):
        i, j = np.nonzero(single_a[low : low + 512] @ single_b.T >= np.float32(threshold - 1e-4))
        i += low
        if same:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), 32_768):
            x, y = i[at : at + 32_768], j[at : at + 32_768]
            good = np.einsum("nd,nd->n", a[x], b[y]) >= threshold
            found.append(np.stack([x[good], y[good]]).astype(np.int32))
    return np.concatenate(found, axis=1)


def local_groups(n: int, i, j):
    """For each of n nodes the least one that the edges (i, j) connect it with."""
    import numpy as np

    low = np.arange(n)
    while len(i):
        least, before = np.minimum(low[i], low[j]), low.copy()
        np.minimum.at(low, i, least)
        np.minimum.at(low, j, least)
        low = low[low]
        if (low == before).all():
            break
    return low


def near_duplicates(rows: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", cell_rows: int = 2048, block_rows: int = 2048, sample_rows: int = 20_000) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.

    Rows link when labels are equal and not null and the cosine in double precision is at least ``threshold``.  Cells
    come from k-means on at most ``sample_rows`` vectors (a bounded fit), so many that a cell holds about ``cell_rows`` of
    the largest label; every row is assigned.  A cell's rows of a label are packed into blocks of about ``block_rows``, a
    row each, and a block pair is one product.  No link is lost at a border: a vector x of cell c has partners in c'
    only if x.c - x.c' <= d |c - c'|, d the longest distance at which two unit vectors still link; block pairs in which one
    side's least such difference is larger are not made.  Where vectors don't cluster that leaves out little, so the work
    is then quadratic in a label's rows, at a row for each pair of blocks.  Equal vectors are one member with a count, so
    their pairs are never made; products give a count and one edge to the least of its local group for each row that
    links, not pairs.

    Vectors that are null, zero or hold null or non-finite components, null labels and null ids link with nothing:
    0 links, a component of their own.  A repeated row links with its copies; a repeated id is as many vectors as it has.  Vectors of other lengths than most form a
    cell for each length.  An empty table stays empty; other columns, whatever their names, are not read.
    """
    spark = rows.sparkSession
    shared.ship(spark)
    code = "<f4" if vectors.is_single(rows, vector) else "<f8"
    base = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("v"), F.col(label).cast("string").alias("label"))
    base = base.withColumn("v", F.when(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & vectors.usable("v"), F.col("v")))
    key = F.struct(F.xxhash64("label", "v").alias("a"), F.xxhash64(F.lit(1), "label", "v").alias("b"))
    members = base.where(F.col("v").isNotNull()).groupBy(key.alias("key"), "label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    members = shared.materialize(members.withColumn("gid", F.monotonically_increasing_id()), "vectors")
    largest = members.groupBy("label").count().agg(F.max("count")).first()[0]
    if not largest:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    import numpy as np

    usual = members.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()["dim"]
    sample = members.where(F.size("v") == usual).orderBy(F.xxhash64("key"), "key").limit(sample_rows).select("v").toPandas()["v"]
    x = np.stack([np.asarray(v, dtype=np.float64) for v in sample])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    k = max(1, min(-(-largest // cell_rows), len(x) // 16 or 1))
    centres = spherical_kmeans(x, k)
    reach = math.sqrt(2 - 2 * threshold) + 1e-9
    apart = reach * np.linalg.norm(centres[:, None] - centres[None], axis=2)

    def unit(raw: list):
        v = np.stack([np.frombuffer(r, dtype=code) for r in raw]).astype(np.float64)
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    def assign(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            raw = [np.asarray(w, dtype=code).tobytes() for w in batch.column(3).to_numpy(zero_copy_only=False)]
            dims = np.array([len(r) // int(code[2]) for r in raw])
            cell = (-dims).astype(np.int32)  # vectors of other lengths than the centres' are one cell each length
            at = np.flatnonzero(dims == centres.shape[1])
            if len(at):
                cell[at] = (unit([raw[i] for i in at]) @ centres.T).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cell), pa.array(raw, pa.binary())], names=["gid", "copies", "label", "cell", "raw"])

    placed = members.select("gid", "copies", "label", "v").mapInArrow(assign, "gid long, copies long, label string, cell int, raw binary")
    placed = shared.materialize(placed, "cells")
    # a table of its own, so the join with it is a plain one that adaptive execution splits at hot cells
    counts = shared.materialize(placed.groupBy("label", "cell").agg(F.ceil(F.count("*") / F.lit(float(block_rows))).cast("int").alias("blocks")), "counts")
    placed = placed.join(counts, ["label", "cell"]).withColumn("own", F.pmod(F.xxhash64(F.lit(2), "gid"), F.col("blocks")).cast("int"))

    def pack(t):
        """One block: its rows' ids, counts and vectors, and the cells where they may have partners."""
        import pyarrow as pa

        raw, cell = t["raw"].to_pylist(), t["cell"][0].as_py()
        cells = [cell]
        if cell >= 0:
            near = unit(raw) @ centres.T
            cells = np.flatnonzero((near[:, cell, None] - near).min(0) <= apart[cell]).astype(np.int32)
        body = (t["gid"].to_numpy().astype("<i8").tobytes(), t["copies"].to_numpy().astype("<i8").tobytes(), b"".join(raw))
        return pa.table({"label": t["label"][:1], "cell": pa.array([cell], pa.int32()), "cells": pa.array([cells], pa.list_(pa.int32())), "gids": [body[0]], "counts": [body[1]], "body": [body[2]]})

    blocks = placed.groupBy("label", "cell", "own").applyInArrow(pack, "label string, cell int, cells array<int>, gids binary, counts binary, body binary")
    blocks = shared.materialize(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")
    seeking = blocks.select("label", "cell", "block", F.explode("cells").alias("other")).where("other >= cell")
    there = blocks.select("label", F.col("cell").alias("other"), F.col("block").alias("block_b"), F.col("cells").alias("cells_b"))
    meet = seeking.join(there, ["label", "other"]).where(F.when(F.col("cell") == F.col("other"), F.col("block") <= F.col("block_b")).otherwise(F.array_contains("cells_b", F.col("cell"))))
    bodies = blocks.select("block", "gids", "counts", "body")
    other = bodies.select(*[F.col(c).alias(f"{c}_b") for c in bodies.columns])
    pairs = meet.select("block", "block_b").join(bodies, "block").join(other, "block_b").select("block", "gids", "counts", "body", "block_b", "gids_b", "counts_b", "body_b")

    def product(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def loaded(gids: bytes, counts: bytes, body: bytes):
            gids = np.frombuffer(gids, dtype="<i8")
            v = np.frombuffer(body, dtype=code).reshape(len(gids), -1).astype(np.float64)
            return gids, np.frombuffer(counts, dtype="<i8"), v / np.linalg.norm(v, axis=1, keepdims=True)

        for batch in batches:
            for block, *a, block_b, b0, b1, b2 in zip(*[c.to_pylist() for c in batch.columns]):
                same = block == block_b
                gid, copies, u = loaded(*a)
                gid_b, copies_b, w = (gid, copies, u) if same else loaded(b0, b1, b2)
                i, j = linked_pairs(u, w, threshold, same)
                if not same:
                    j = j + len(gid)
                    gid, copies = np.concatenate([gid, gid_b]), np.concatenate([copies, copies_b])
                links = np.bincount(i, copies[j], len(gid)) + np.bincount(j, copies[i], len(gid))
                order = np.argsort(gid, kind="stable")  # places by ascending gid, so the least place is the least gid
                place = np.empty(len(gid), dtype=np.int64)
                place[order] = np.arange(len(gid))
                low = gid[order][local_groups(len(gid), place[i], place[j])][place]
                some = np.unique(np.concatenate([i, j]))
                yield pa.RecordBatch.from_arrays([pa.array(gid[some]), pa.array(links[some].astype(np.int64)), pa.array(low[some])], names=["gid", "links", "low"])

    with shared.few_records(spark, 4):
        found = shared.materialize(pairs.mapInArrow(product, "gid long, links long, low long"), "links")
    total = found.groupBy("gid").agg(F.sum("links").alias("links"))
    groups = shared.components(found.select(F.col("gid").alias("a"), F.col("low").alias("b")))
    judged = members.select("key", "gid", "least", "copies").join(total, "gid", "left").join(groups.withColumnRenamed("id", "gid"), "gid", "left")
    judged = judged.select("key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "gid").alias("group"), "least")
    judged = judged.join(judged.groupBy("group").agg(F.min("least").alias("component")), "group").drop("group", "least")
    out = base.withColumn("key", F.when(F.col("v").isNotNull(), key)).drop("v", "label").join(judged, "key", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op9_vector_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups among all embeddings of a label at cosine 0.93."""
    return near_duplicates(shared.table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS id, vec_id AS seen FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON r.seen = l.a)
SELECT id AS vec_id, (SELECT count(*) FROM l WHERE l.a = id)::BIGINT AS n_links, min(seen) AS component_id, id = min(seen) AS kept FROM r GROUP BY id
"""
