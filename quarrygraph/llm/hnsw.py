"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph per shard, results merged."""

from __future__ import annotations

import io
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared, vectors

NEIGHBOURS, BUILD_WIDTH = 16, 48
#: Rows of a graph that are inserted at a time.
BATCH = 512
#: Rows that a step of a search of the lowest level expands for each query: the best of those not expanded yet.
EXPAND = 8
#: Bytes of a piece of a shard's arrays, and vectors of a query block: the rows that tasks exchange.
PIECE, QUERY_ROWS = 1 << 20, 1024
#: Shards that any index has, so that its building and small query sets are spread over tasks.
SHARDS = 6


class Graph:
    """A graph over a matrix.  Inner products become distances by one more component that gives all rows one length.

    ``links[l]`` is an array of neighbour rows of the nodes of level l, filled up with -1, at most NEIGHBOURS of them, on
    level 0 twice as many; ``slot[l]`` is a row's line there (on level 0 its own number).  Rows are inserted in batches that
    grow with the graph up to BATCH rows: each descends through the levels built so far by greedy search, on its own levels
    takes a diverse choice of the nearest that a beam search finds there and of the batch's own rows, and the chosen
    rows link back and choose anew.  So a row costs a search, not products with all rows.
    """

    def __init__(self, rows, seed: int = 5):
        import numpy as np

        x = np.asarray(rows, dtype=np.float32)
        n = len(x)
        square = (x.astype(np.float64) ** 2).sum(1)
        self.x = np.concatenate([x, np.sqrt(np.maximum(square.max(initial=0) - square, 0)).astype(np.float32)[:, None]], axis=1)
        draw = np.random.default_rng(seed).random(n)
        level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(NEIGHBOURS)).astype(np.int8), 6)
        if n:
            level[0] = level.max()  # the entry point
        self.links, self.slot = [], []
        for at in range(int(level.max(initial=0)) + 1):
            nodes = np.flatnonzero(level >= at)
            slot = np.full(n, -1, dtype=np.int32)
            slot[nodes] = np.arange(len(nodes))
            self.slot.append(slot)
            self.links.append(np.full((len(nodes), NEIGHBOURS * (1 if at else 2)), -1, dtype=np.int32))
        done = min(n, 1)
        while done < n:
            batch = np.arange(done, min(n, done + min(BATCH, max(32, done // 4))))
            self._insert(batch, level)
            done += len(batch)

    def _insert(self, batch, level) -> None:
        import numpy as np

        q = self.x[batch]
        entry = np.zeros((len(batch), 1), dtype=np.int32)
        for at in range(len(self.links) - 1, -1, -1):
            on = level[batch] >= at
            found = np.full((len(batch), BUILD_WIDTH if on.any() else 8), -1, dtype=np.int32)
            if on.any():
                found[on] = self._beam(q[on], entry[on], at, BUILD_WIDTH)
            if not on.all():
                found[~on, :8] = self._beam(q[~on], entry[~on], at, 8)
            rows = batch[on]
            if len(rows):
                # of the batch's own rows the nearest, as the graph doesn't hold them yet
                near = q[on] @ q[on].T
                np.fill_diagonal(near, -np.inf)
                most = min(NEIGHBOURS, len(rows) - 1)
                top = np.argpartition(-near, most - 1, axis=1)[:, :most] if most else np.empty((len(rows), 0), dtype=np.int64)
                self._link(at, rows, self._choose(rows, np.concatenate([found[on], rows[top].astype(np.int32)], axis=1), NEIGHBOURS))
            entry = found[:, :8]

    def _link(self, at: int, rows, chosen) -> None:
        """Lines of new rows, and the lines of those they chose with the new rows added."""
        import numpy as np

        links, slot, most = self.links[at], self.slot[at], self.links[at].shape[1]
        links[slot[rows], : chosen.shape[1]] = chosen
        to, back = chosen.ravel(), np.repeat(rows, chosen.shape[1]).astype(np.int32)
        to, back = to[to >= 0], back[to >= 0]
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        ends, first, count = np.unique(to, return_index=True, return_counts=True)
        for low in range(0, len(ends), 2048):
            e, c = ends[low : low + 2048], count[low : low + 2048]
            added = np.full((len(e), c.max()), -1, dtype=np.int32)
            line = np.repeat(np.arange(len(e)), c)
            within = np.arange(len(line)) - np.repeat(np.cumsum(c) - c, c)
            start = first[low]
            added[line, within] = back[start : start + len(line)]
            both = np.concatenate([links[slot[e]], added], axis=1)
            full = (both >= 0).sum(1) > most
            if full.any():
                links[slot[e[full]]] = self._choose(e[full], both[full], most)
            some = ~full
            if some.any():
                packed = np.take_along_axis(both[some], np.argsort(both[some] < 0, axis=1, kind="stable"), 1)
                links[slot[e[some]]] = packed[:, :most]

    def _choose(self, rows, found, most: int):
        """For each row, of its candidates (-1: none) in order of nearness, those that are nearer to the row than to any chosen
        before, then the nearest rest: an array of at most ``most`` columns filled up with -1."""
        import numpy as np

        out = np.full((len(rows), min(most, found.shape[1])), -1, dtype=np.int32)
        for low in range(0, len(rows), 256):
            r, f = rows[low : low + 256], np.sort(found[low : low + 256], axis=1)
            f[:, 1:][f[:, 1:] == f[:, :-1]] = -1  # rows found twice
            f[f == r[:, None]] = -1
            v = self.x[np.maximum(f, 0)]
            near = np.where(f >= 0, np.einsum("rcd,rd->rc", v, self.x[r]), -np.inf)
            order = np.argsort(-near, axis=1, kind="stable")
            f, near, v = np.take_along_axis(f, order, 1), np.take_along_axis(near, order, 1), np.take_along_axis(v, order[..., None], 1)
            between = v @ v.transpose(0, 2, 1)
            left, chosen, count = f >= 0, np.zeros(f.shape, dtype=bool), np.zeros(len(r), dtype=np.int64)
            for i in range(f.shape[1]):
                take = left[:, i] & (count < most)
                chosen[:, i] = take
                count += take
                left &= ~(take[:, None] & (between[:, i] > near))
            rank = np.where(chosen, 0, np.where(f >= 0, 1, 2))
            f = np.take_along_axis(f, np.argsort(rank, axis=1, kind="stable"), 1)
            out[low : low + 256] = f[:, : out.shape[1]]
        return out

    def search(self, queries, width: int):
        """For each query the rows found (-1 fills up), for a block of queries at a time."""
        import numpy as np

        q = np.concatenate([np.asarray(queries, dtype=np.float32), np.zeros((len(queries), 1), dtype=np.float32)], axis=1)
        at = np.zeros((len(q), 1), dtype=np.int32)
        for level in range(len(self.links) - 1, 0, -1):
            at = self._beam(q, at, level, 8)
        return self._beam(q, at, 0, width, EXPAND)

    def _beam(self, q, entry, level: int, width: int, expand: int = 1):
        """The ``width`` best rows of a level met from the entry rows on, best first; -1 fills up."""
        import numpy as np

        links, slot = self.links[level], self.slot[level]
        n_q, rows = len(q), np.arange(len(q))
        visited = np.zeros((n_q, len(links)), dtype=bool)
        ids, done = np.full((n_q, width), -1, dtype=np.int32), np.ones((n_q, width), dtype=bool)
        score = np.full((n_q, width), -np.inf, dtype=np.float32)
        k = min(entry.shape[1], width)
        ids[:, :k] = entry[:, :k]
        score[:, :k] = np.where(ids[:, :k] >= 0, np.einsum("qkd,qd->qk", self.x[np.maximum(ids[:, :k], 0)], q), -np.inf)
        done[:, :k] = ids[:, :k] < 0
        for j in range(k):
            visited[rows, slot[np.maximum(ids[:, j], 0)]] |= ids[:, j] >= 0
        step = min(expand, width)
        while True:
            pending = np.where(done, -np.inf, score)
            live = np.flatnonzero(pending.max(1) > -np.inf)
            if not len(live):
                return np.take_along_axis(ids, np.argsort(-score, axis=1, kind="stable"), 1)
            pick = pending[live].argmax(1)[:, None] if step == 1 else np.argpartition(-pending[live], step - 1, axis=1)[:, :step]
            good = np.take_along_axis(pending[live], pick, 1) > -np.inf
            done[live[:, None], pick] = True
            near = np.where(good[..., None], links[slot[np.maximum(ids[live[:, None], pick], 0)]], -1).reshape(len(live), -1)
            line, column = np.nonzero(near >= 0)
            row = near[line, column]
            # only rows not met before are compared, and those that several of the expanded ones link to once
            fresh = ~visited[live[line], slot[row]]
            line, row = line[fresh], row[fresh]
            if step > 1:
                _, once = np.unique(line * np.int64(len(self.x)) + row, return_index=True)
                line, row = line[once], row[once]
            visited[live[line], slot[row]] = True
            count = np.bincount(line, minlength=len(live))
            within = np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count)
            found, s = np.full((len(live), count.max(initial=0)), -1, dtype=np.int32), np.full((len(live), count.max(initial=0)), -np.inf, dtype=np.float32)
            found[line, within] = row
            s[line, within] = np.einsum("nd,nd->n", self.x[row], q[live[line]])
            all_ids, all_s = np.concatenate([ids[live], found], 1), np.concatenate([score[live], s], 1)
            all_done = np.concatenate([done[live], found < 0], 1)
            top = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
            ids[live], score[live], done[live] = (np.take_along_axis(z, top, 1) for z in (all_ids, all_s, all_done))

    def arrays(self) -> dict:
        return {"x": self.x} | {f"links{i}": a for i, a in enumerate(self.links)} | {f"slot{i}": a for i, a in enumerate(self.slot)}

    @classmethod
    def of(cls, arrays) -> Graph:
        graph = cls.__new__(cls)
        graph.x = arrays["x"]
        levels = sum(k.startswith("links") for k in arrays)
        graph.links, graph.slot = [arrays[f"links{i}"] for i in range(levels)], [arrays[f"slot{i}"] for i in range(levels)]
        return graph


class Shard:
    """A graph over the distinct vectors of a shard, the vectors as they were, and the ids that have each.

    Equal vectors are one node with its ``keep`` smallest distinct ids: a search can return no more of them.
    """

    def __init__(self, ids, x, keep: int):
        import numpy as np

        order = np.lexsort([ids, *(x.T[::-1])])
        ids, x = ids[order], x[order]
        new = np.ones(len(x), dtype=bool)
        new[1:] = (x[1:] != x[:-1]).any(1)
        once = new.copy()
        once[1:] |= ids[1:] != ids[:-1]
        ids, x, new = ids[once], x[once], new[once]
        group = np.cumsum(new) - 1
        rank = np.arange(len(x)) - np.flatnonzero(new)[group]
        few = rank < keep
        x, ids, group = x[new], ids[few], group[few]
        # the order of insertion is random, so early rows reach across the shard
        mix = np.random.default_rng(3).permutation(len(x))
        where = np.empty(len(x), dtype=np.int64)
        where[mix] = np.arange(len(x))
        x, group = x[mix], where[group]
        order = np.lexsort([ids, group])
        self.x, self.ids, self.starts = x, ids[order], np.searchsorted(group[order], np.arange(len(x) + 1))
        self.graph = Graph(x)

    def dump(self) -> bytes:
        import numpy as np

        out = io.BytesIO()
        np.savez(out, vectors=self.x, ids=self.ids, starts=self.starts, **{f"graph_{k}": v for k, v in self.graph.arrays().items()})
        return out.getvalue()

    @classmethod
    def load(cls, body: bytes) -> Shard:
        import numpy as np

        arrays = dict(np.load(io.BytesIO(body)))
        shard = cls.__new__(cls)
        shard.x, shard.ids, shard.starts = arrays["vectors"], arrays["ids"], arrays["starts"]
        shard.graph = Graph.of({k.removeprefix("graph_"): v for k, v in arrays.items() if k.startswith("graph_")})
        shard.known = set(shard.ids.tolist())
        return shard

    def nearest(self, q_ids, q, k: int, width: int):
        """(query ids, ids, scores) of each query's k best distinct ids but its own, scores in double precision."""
        import numpy as np

        out: tuple[list, list, list] = ([], [], [])
        for at in range(0, len(q), 512):
            some = q[at : at + 512].astype(np.float64)
            for i, nodes in enumerate(self.graph.search(some, max(width, k + 1))):
                query, nodes = int(q_ids[at + i]), nodes[nodes >= 0]
                score = self.x[nodes].astype(np.float64) @ some[i]
                own = np.concatenate([self.ids[self.starts[r] : self.starts[r + 1]] for r in nodes]) if len(nodes) else self.ids[:0]
                best, score = best_ids(own, np.repeat(score, self.starts[nodes + 1] - self.starts[nodes]), query, k)
                if len(best) < min(k, len(self.known) - (query in self.known)):
                    best, score = best_ids(self.ids, np.repeat(self.x.astype(np.float64) @ some[i], np.diff(self.starts)), query, k)
                out[0].append(np.full(len(best), query, dtype=np.int64))
                out[1].append(best)
                out[2].append(score)
        return tuple(np.concatenate(c) for c in out)


def build_index(rows: DataFrame, id_col: str, vector: str, shards: int, keep: int) -> DataFrame:
    """The shards' bodies in pieces: rows (dim, shard, piece, body).  Distinct pairs of id and vector are dealt evenly by
    their hash; vectors of one length share shards only with their like."""

    def build(key, batches):
        import numpy as np
        import pyarrow as pa

        t = pa.Table.from_batches(list(batches)) if not isinstance(batches, pa.Table) else batches
        dim, shard = (x.as_py() for x in key)
        x = vectors.matrix(t["v"].combine_chunks(), dim)
        body = Shard(t["id"].to_numpy(), np.asarray(x), keep).dump()
        pieces = [body[at : at + PIECE] for at in range(0, len(body), PIECE)]
        return pa.table({"dim": pa.array([dim] * len(pieces), pa.int32()), "shard": pa.array([shard] * len(pieces), pa.int32()), "piece": pa.array(range(len(pieces)), pa.int32()), "body": pa.array(pieces, pa.binary())})

    dealt = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")).distinct()
    dealt = dealt.withColumn("dim", F.size("v")).withColumn("shard", F.pmod(F.xxhash64(F.lit(4), "id", "v"), F.lit(shards)).cast("int"))
    return dealt.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, piece int, body binary")


def best_ids(ids, score, own: int, k: int):
    """The k best distinct ids but ``own``, each with its best score, from the best down; of equal ones the smaller id first."""
    import numpy as np

    order = np.lexsort([ids, -score])
    order = order[ids[order] != own]
    first = np.sort(np.unique(ids[order], return_index=True)[1])[:k]
    return ids[order[first]], score[order[first]]


def nearest(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", shard_rows: int = 65_536, query_group: int = 65_536, width: int = 128) -> DataFrame:
    """Each query's k nearest rows by inner product, its own id left out: query_id, rank, vec_id, score (double).

    Vectors that are null, zero or hold null or non-finite components take no part, nor do null ids; a query's
    candidates are the vectors of its length.  Ties go to the smaller id; rows with the query's id are not candidates.
    An id is one neighbour with its best score, however many rows and vectors it has; where the rows a search finds
    in a shard are of fewer than k ids though the shard has more, all of the shard's rows are compared.  An empty table or
    no queries give an empty result; other columns are not read.

    There are SHARDS shards, and more only where a shard would hold over ``shard_rows`` rows, as a
    search of a larger shard costs hardly more.  Every query meets every shard: queries come in groups of about
    ``query_group``, and a task reads a shard's body once for a whole group, then its queries as a stream.
    """
    spark = rows.sparkSession
    shared.ship(spark)
    usable = lambda df: df.where(vectors.usable(vector) & F.col(id_col).isNotNull())
    ready = usable(rows)
    n = ready.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards = max(SHARDS, -(-n // shard_rows))
    index = shared.materialize(build_index(ready, id_col, vector, shards, k + 1), "hnsw")
    code = "<f4" if vectors.is_single(rows, vector) else "<f8"
    asked = usable(queries).select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")).distinct()

    def pack(batches: Iterator) -> Iterator:
        """Queries in blocks of one length."""
        import numpy as np
        import pyarrow as pa

        held: dict[int, list] = {}

        def flush(dim: int) -> pa.RecordBatch:
            ids, raw = zip(*held.pop(dim))
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([np.asarray(ids, dtype="<i8").tobytes()]), pa.array([b"".join(raw)])], names=["dim", "ids", "body"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)):
                held.setdefault(len(v), []).append((i, np.asarray(v, dtype=code).tobytes()))
                if len(held[len(v)]) == QUERY_ROWS:
                    yield flush(len(v))
        for dim in list(held):
            yield flush(dim)

    blocks = shared.materialize(asked.mapInArrow(pack, "dim int, ids binary, body binary"), "queries")
    groups = max(1, -(-blocks.count() * QUERY_ROWS // query_group))
    group = F.pmod(F.xxhash64(F.lit(6), "ids"), F.lit(groups)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    none = F.lit(None).cast("binary")
    streams = index.select("dim", "shard", every(groups).alias("group"), "piece", none.alias("ids"), "body").unionByName(blocks.select("dim", every(shards).alias("shard"), group.alias("group"), F.lit(1 << 30).alias("piece"), "ids", "body"))
    parts = min(shards * groups, max(shards, 8 * spark.sparkContext.defaultParallelism))
    streams = streams.repartition(parts, "dim", "shard", "group").sortWithinPartitions("dim", "shard", "group", "piece")

    def search(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        at, pieces, shard = None, [], None
        for batch in batches:
            for dim, number, part, _, ids, body in zip(*[c.to_pylist() for c in batch.columns]):
                if at != (dim, number, part):
                    at, pieces, shard = (dim, number, part), [], None
                if ids is None:
                    pieces.append(body)
                    continue
                if shard is None:
                    if not pieces:
                        continue  # no row of the shard has this length
                    shard, pieces = Shard.load(b"".join(pieces)), []
                found = shard.nearest(np.frombuffer(ids, dtype="<i8"), np.frombuffer(body, dtype=code).reshape(-1, dim), k, width)
                for low in range(0, len(found[0]), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[low : low + 10_000]) for c in found], names=["query_id", "vec_id", "score"])

    with shared.few_records(spark, 8):
        found = shared.materialize(streams.mapInArrow(search, "query_id long, vec_id long, score double"), "found")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every vector whose vec_id is divisible by 20 its 20 nearest among all others."""
    rows = shared.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.where(F.col("vec_id") % 20 == 0), k=20)
