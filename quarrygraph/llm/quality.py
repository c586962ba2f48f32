"""A byte-level convolutional quality classifier in numpy."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

CHUNK, WIDTH, DEPTH, FILTERS, HIDDEN, PAD = 96, 8, 4, 24, 16, 256
#: Chunks overlap by a filter's width less one, so every window of a text lies in just one of them.
STRIDE = CHUNK - WIDTH + 1
#: Chunks that are convolved at a time: what they need fits a core's cache, whatever the texts' lengths.
BLOCK = 40


def chunks(raw: bytes):
    """Overlapping chunks that cover all bytes, as an (n, CHUNK) array of byte values; the last one ends with the text, and
    PAD fills up a text that is shorter than one."""
    import numpy as np

    if len(raw) <= CHUNK:
        one = np.full((1, CHUNK), PAD, dtype=np.int16)
        one[0, : len(raw)] = np.frombuffer(raw, dtype=np.uint8)
        return one
    starts = np.minimum(np.arange(-(-(len(raw) - CHUNK) // STRIDE) + 1) * STRIDE, len(raw) - CHUNK)
    return np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, dtype=np.uint8), CHUNK)[starts].astype(np.int16)


class Network:
    """Bytes are embedded; filters of WIDTH bytes meet every window of every chunk and are max-pooled in each chunk.  A
    document is the largest and the least of each filter's maxima over its chunks, rectified (the least tells of a stretch
    that lacks what the rest has); a hidden layer combines them into one log odds, so one probability."""

    def __init__(self, seed: int = 1):
        import numpy as np

        rng = np.random.default_rng(seed)
        width = WIDTH * DEPTH
        draw = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
        self.p = {
            "embed": draw(PAD + 1, DEPTH) * 0.5, "filters": draw(width, FILTERS) / np.sqrt(width), "bias": np.zeros(2 * FILTERS, np.float32),
            "hidden": draw(2 * FILTERS, HIDDEN) / np.sqrt(2 * FILTERS), "hidden_bias": np.zeros(HIDDEN, np.float32), "out": draw(HIDDEN) / np.sqrt(HIDDEN), "out_bias": np.zeros(1, np.float32),
        }
        self.p["embed"][PAD] = 0

    def responses(self, x, starts, where: bool = False):
        """For each document the largest and the least of each filter's maxima in its chunks, (documents, 2 FILTERS); with
        ``where`` also the chunk and the window they come from.  Of a block of chunks only these stay."""
        import numpy as np

        pooled = np.repeat(np.array([[-np.inf], [np.inf]], dtype=self.p["filters"].dtype), FILTERS, axis=1)
        pooled = np.repeat(pooled[:, None], len(starts), axis=1)  # (2, documents, FILTERS)
        chunk, place = np.zeros(pooled.shape, dtype=np.int64), np.zeros(pooled.shape, dtype=np.int64)
        every = np.arange(FILTERS)
        for low in range(0, len(x), BLOCK):
            e = self.p["embed"].take(x[low : low + BLOCK], axis=0).reshape(-1, CHUNK * DEPTH)
            windows = np.lib.stride_tricks.sliding_window_view(e, WIDTH * DEPTH, axis=1)[:, ::DEPTH]
            h = (windows.reshape(-1, WIDTH * DEPTH) @ self.p["filters"]).reshape(len(e), -1, FILTERS)
            m = h.max(1)
            first, last = np.searchsorted(starts, [low, low + len(e) - 1], side="right") - 1
            cuts = np.maximum(starts[first : last + 1], low) - low
            for i, (pool, winner) in enumerate(((np.maximum, np.argmax), (np.minimum, np.argmin))):
                here, known = pool.reduceat(m, cuts), pooled[i, first : last + 1]
                if where:
                    won = np.stack([a + winner(m[a:b], axis=0) for a, b in zip(cuts, [*cuts[1:], len(e)])])
                    better = here > known if i == 0 else here < known
                    line, column = np.nonzero(better)
                    chunk[i, first + line, column] = low + won[line, column]
                    place[i, first + line, column] = h[won[line, column], :, every[column]].argmax(1)
                pooled[i, first : last + 1] = pool(known, here)
        return tuple(np.concatenate(list(z), axis=1) for z in (pooled, chunk, place))

    def forward(self, x, starts, keep: bool = False):
        """Log odds of each document; its chunks begin in x at ``starts``; with keep also what backward() needs."""
        import numpy as np

        p = self.p
        top, chunk, place = self.responses(x, starts, keep)
        pooled = np.maximum(top + p["bias"], 0)
        hidden = np.maximum(pooled @ p["hidden"] + p["hidden_bias"], 0)
        odds = hidden @ p["out"] + p["out_bias"][0]
        return (odds, (x, chunk, place, pooled, hidden)) if keep else odds

    def backward(self, held, d_odds) -> dict:
        import numpy as np

        p, (x, chunk, place, pooled, hidden) = self.p, held
        g = {"out": hidden.T @ d_odds, "out_bias": d_odds.sum(keepdims=True)}
        d_hidden = d_odds[:, None] * p["out"] * (hidden > 0)
        g["hidden"], g["hidden_bias"] = pooled.T @ d_hidden, d_hidden.sum(0)
        d_top = (d_hidden @ p["hidden"].T) * (pooled > 0)
        g["bias"] = d_top.sum(0)
        # only the window that gave what was pooled counts
        seen = x[chunk[..., None], place[..., None] + np.arange(WIDTH)]  # (documents, 2 FILTERS, WIDTH) bytes
        e = p["embed"][seen].reshape(*chunk.shape, WIDTH * DEPTH)
        g["filters"] = np.einsum("df,dfk->kf", d_top, e).reshape(-1, 2, FILTERS).sum(1)
        d_e = (d_top[..., None] * np.tile(p["filters"].T, (2, 1))).reshape(-1, DEPTH)
        g["embed"] = np.stack([np.bincount(seen.ravel(), d_e[:, i], PAD + 1) for i in range(DEPTH)], axis=1).astype(np.float32)
        g["embed"][PAD] = 0
        return g


def _joined(rows: list):
    """Chunks of several documents in one array, and where each document's begin."""
    import numpy as np

    return np.concatenate(rows), np.cumsum([0, *[len(r) for r in rows[:-1]]])


def train(texts: list[str], labels: list[int], epochs: int = 8, batch: int = 32, rate: float = 6e-3, seed: int = 2, least_steps: int = 500) -> Network:
    """Fit a network by Adam; every epoch sees every chunk of every text; few texts get more epochs, to ``least_steps``."""
    import numpy as np

    net, rng = Network(), np.random.default_rng(seed)
    if not texts or len(set(labels)) < 2:  # nothing to tell apart
        net.p["out"][:] = 0
        net.p["out_bias"][0] = 4 * (1 if not labels else 2 * labels[0] - 1)
        return net
    rows, y = [chunks(t.encode("utf-8")) for t in texts], np.asarray(labels, dtype=np.float32)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** 0.5
    epochs = max(epochs, -(-least_steps // -(-len(rows) // batch)))
    m, v, step, total = {k: np.zeros_like(a) for k, a in net.p.items()}, {k: np.zeros_like(a) for k, a in net.p.items()}, 0, epochs * -(-len(rows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            odds, held = net.forward(*_joined([rows[i] for i in some]), keep=True)
            grads = net.backward(held, (weight[some] * (1 / (1 + np.exp(-odds)) - y[some]) / len(some)).astype(np.float32))
            step += 1
            now = rate * (1 - step / (total + 1))
            for k, g in grads.items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                net.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def score_texts(net: Network, texts: list[str]) -> list[float]:
    """Probability of label 1 from all bytes of each text."""
    import numpy as np

    if not texts:
        return []
    odds = net.forward(*_joined([chunks(t.encode("utf-8")) for t in texts]))
    return (1 / (1 + np.exp(-np.clip(odds.astype(np.float64), -40, 40)))).tolist()


def held_out(doc_id):
    """Rows never learned from: crc32 of the id's text leaves 2 modulo 4; a null id isn't one."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = 3000, sample_bytes: int = 32 << 20) -> Network:
    """A network from whole texts of at most ``sample_docs`` labelled documents that are not held out.

    The sample is the labels with the smallest hashes of their id, so it is bounded, even and the same every time; in that
    order texts are taken while they hold at most ``sample_bytes`` together, and those that don't fit are left out.
    Labels that are null or without a document are left out; a null text is empty; of several texts with one id the
    least counts, of several labels the best.  Without labels of two kinds (no rows, say) all texts get one score.
    """
    labelled = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = F.broadcast(labelled.select("doc_id", "quality", F.xxhash64(F.lit(9), "doc_id").alias("h")).orderBy("h", "doc_id").limit(sample_docs))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sizes = texts.join(chosen, "doc_id").groupBy("doc_id", "quality", "h").agg(F.min(F.struct("text"))["text"].alias("text")).select("doc_id", "quality", "h", F.octet_length("text").alias("bytes")).collect()
    taken, left = {}, sample_bytes
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
        if r["bytes"] <= left:
            taken[r["doc_id"]], left = int(r["quality"]), left - r["bytes"]
    if not taken:
        return train([], [])
    wanted = docs.sparkSession.createDataFrame([(d,) for d in taken], labelled.select("doc_id").schema)
    rows = texts.join(F.broadcast(wanted), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return train([r["text"] for r in rows], [taken[r["doc_id"]] for r in rows])


def score(docs: DataFrame, net: Network) -> DataFrame:
    """docs with ``score``: narrow, whole texts, null texts as empty; other columns stay, but for one named ``score``, which
    gives way; equal texts get equal scores to within float rounding; an empty table stays empty."""
    shared.ship(docs.sparkSession)
    docs = docs.drop("score")
    net_p = net.p

    import pyarrow as pa

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Network.__new__(Network)
        own.p = net_p
        for texts in batches:
            out: list[float] = []
            for at in range(0, len(texts), 32):  # few texts at a time are Python strings
                out += score_texts(own, [t or "" for t in texts.slice(at, 32).to_pylist()])
            yield pa.array(out, pa.float64())
        shared.trim()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn("score", F.arrow_udf(run, "double")(F.col("text")))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learned from the labels that are not held out."""
    docs = shared.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, shared.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
