"""Best-fit packing of token pieces into fixed-length sequences with certified bin counts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from . import shared


def tokenize_pieces(docs: DataFrame, vocabulary: str, seq_len: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids (binary, little-endian unsigned 32-bit).

    A null or empty text is just ``end_id``; null and repeated doc_ids are kept as they are.  Documents of more than
    ``seq_len`` ids are cut so that all pieces but the first are full.  An empty table gives no pieces.  Other columns
    of docs are ignored.  A control string of the vocabulary inside a text is its control id, as the library reads it.
    """
    shared.ship(docs.sparkSession)
    odd = shared.odd_entries(vocabulary)

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        enc, end = shared.encoder(vocabulary, odd), np.asarray([end_id], dtype="<u4").tobytes()
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

        def flush(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            rows, held = [], 0
            for at in range(0, len(ids), 256):
                coded = enc.encode([t or "" for t in texts.slice(at, 256).to_pylist()])
                for d, raw in zip(ids[at : at + 256], coded):
                    raw += end
                    n = len(raw) // 4
                    first = n if n <= seq_len else (n % seq_len or seq_len)
                    start, piece = 0, 0
                    while start < n:
                        size = first if piece == 0 else seq_len
                        rows.append((d, piece, start, size, raw[4 * start : 4 * (start + size)]))
                        start, piece = start + size, piece + 1
                    held += 4 * n
                if held > 4_000_000:
                    yield flush(rows)
                    rows, held = [], 0
            if rows:
                yield flush(rows)
        shared.trim()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


def lower_bound(sizes, counts, capacity: int) -> int:
    """No packing of this histogram of lengths needs fewer bins: the area bound and two families of dual-feasible functions.

    A dual-feasible function maps sizes so that what fits a bin before still sums to at most one bin after; the mapped
    sizes' area is then a bound too.  Tried are the threshold functions (sizes under t vanish, those over 1 - t count
    as whole bins) and the rounding functions u_k.
    """
    import numpy as np

    sizes, counts = np.asarray(sizes, dtype=np.int64), np.asarray(counts, dtype=np.int64)
    if not len(sizes):
        return 0
    best = -(-int((sizes * counts).sum()) // capacity)
    for t in sizes[sizes <= capacity // 2]:
        mapped = np.where(sizes > capacity - t, capacity, np.where(sizes < t, 0, sizes))
        best = max(best, -(-int((mapped * counts).sum()) // capacity))
    for k in range(1, 21):  # in units of 1 / (k (k + 1)) bins
        scaled = sizes * (k + 1)
        mapped = np.where(scaled % capacity == 0, scaled // capacity * k, scaled // capacity * (k + 1))
        best = max(best, -(-int((mapped * counts).sum()) // (k * (k + 1))))
    return best


def best_fit_decreasing(lengths, capacity: int):
    """Bin and offset for each length (given in descending order), and the bins' fills.  Ties go to the newest bin."""
    import numpy as np

    bins, offsets, fills = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64), []
    by_space: dict[int, list[int]] = {}
    spaces = 0  # bit r: an open bin has exactly r tokens of space
    for i, n in enumerate(map(int, lengths)):
        fitting = spaces >> n
        if fitting:
            space = n + (fitting & -fitting).bit_length() - 1
            stack = by_space[space]
            b = stack.pop()
            if not stack:
                spaces ^= 1 << space
        else:
            b, space = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        left = space - n
        if left:
            stack = by_space.setdefault(left, [])
            if not stack:
                spaces |= 1 << left
            stack.append(b)
    return bins, offsets, np.asarray(fills, dtype=np.int64)


@dataclass
class Packed:
    """rows: the pieces with sequence_id and offset.  bins and bound: the sequences made, and what no packing can beat."""

    rows: DataFrame
    bins: int
    bound: int


def pack(pieces: DataFrame, seq_len: int = 2048, rows_per_partition: int = 100_000, slack: int = 0, max_rounds: int = 6) -> Packed:
    """Pack pieces (columns doc_id, piece, length and any more) into sequences of at most ``seq_len``.

    Round by round: the pieces are dealt evenly, each partition packs best-fit decreasing and takes the dual-feasible
    lower bound of its own lengths.  A partition that meets its bound is certified: it keeps its bins but for those with
    over a sixteenth of space, which others' documents may fill.  The others give up all bins with more than ``slack`` of space.
    What is given up is exchanged into fewer, new partitions and packed again, until the total meets the bound of all
    lengths, nothing more is given up, a round leaves as many open bins as the one before, or
    ``max_rounds`` are over.  Partitions hold at most about ``rows_per_partition`` rows, whatever the input, so rows should
    be slim (no token ids).  A single partition packs all it has, so there is nothing to exchange.  Lengths must be 1 to
    ``seq_len``, else it's a ValueError; null and repeated ids are pieces like others; an empty input gives an empty
    result.  Columns named like an added one (sequence_id, offset, given_up) give way to it.
    """
    spark = pieces.sparkSession
    shared.ship(spark)
    pieces = pieces.drop("sequence_id", "offset", "given_up")
    with shared.few_records(spark, shared.TEXT_RECORDS):  # pieces may come from texts only now
        pieces = shared.materialize(pieces, "pack")
    added = StructType([StructField("sequence_id", LongType()), StructField("offset", LongType()), StructField("given_up", BooleanType())])
    schema = StructType(pieces.schema.fields + added.fields)
    histogram = pieces.groupBy("length").count()  # at most seq_len rows
    known = [(r["length"], r["count"]) for r in histogram.collect()]
    if any(not n or not 0 < n <= seq_len for n, _ in known):
        raise ValueError(f"lengths must lie in 1..{seq_len}")
    total = sum(c for _, c in known)
    bound = lower_bound([n for n, _ in known], [c for _, c in known], seq_len)

    def run(number: int):
        def one(batches: Iterator) -> Iterator:
            import numpy as np
            import pyarrow as pa
            from pyspark import TaskContext

            # Arrow throughout, so that nulls beside large ids and columns of any type come back as they were
            part = TaskContext.get().partitionId()
            held = [b for b in batches if b.num_rows]
            if not held:
                return
            rows = pa.Table.from_batches(held)
            rows = rows.take(rows.select(["length", "doc_id", "piece"]).append_column("at", pa.array(np.arange(len(rows)))).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("at", "ascending")])["at"])
            lengths = rows["length"].to_numpy()
            bins, offsets, fills = best_fit_decreasing(lengths, seq_len)
            gappy = seq_len - fills > slack
            certified = len(fills) == lower_bound(*np.unique(lengths, return_counts=True), seq_len)
            given_up = (seq_len - fills > seq_len // 16 if certified else gappy)[bins]
            for name, values in (("sequence_id", (np.int64(number) << 56) | (np.int64(part) << 32) | bins), ("offset", offsets), ("given_up", given_up)):
                rows = rows.append_column(name, pa.array(values))
            yield from rows.to_batches(max_chunksize=20_000)

        return one

    done, rest, kept_bins, number, last = [], pieces, 0, 0, None
    while total:
        parts = -(-total // rows_per_partition)
        out = shared.materialize(rest.repartition(parts).mapInArrow(run(number), schema), "pack")
        # bins are counted once, at offset 0
        counts = {r["given_up"]: (r["bins"], r["rows"]) for r in out.groupBy("given_up").agg(F.sum((F.col("offset") == 0).cast("long")).alias("bins"), F.count("*").alias("rows")).collect()}
        kept, (open_bins, open_rows) = counts.get(False, (0, 0))[0], counts.get(True, (0, 0))
        number += 1
        # one partition alone can't gain by an exchange, nor can a round that left as many gappy bins as the one before
        if kept_bins + kept + open_bins <= bound or not open_rows or parts == 1 or number >= max_rounds or last == open_bins:
            done.append(out)
            kept_bins += kept + open_bins
            break
        done.append(out.where("not given_up"))
        kept_bins += kept
        rest, total, last = out.where("given_up").drop("sequence_id", "offset", "given_up"), open_rows, open_bins
    if not done:
        done = [pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})]
    rows = done[0].drop("given_up")
    for x in done[1:]:
        rows = rows.unionByName(x.drop("given_up"))
    return Packed(rows, kept_bins, bound)


def op1_pack(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens of byte_bpe_50k, each document closed by id 0; every row also tells how
    many sequences there are, and how many no packing can do without."""
    pieces = tokenize_pieces(shared.table(spark, sf_dir, "documents"), shared.tokenizer_path("byte_bpe_50k.json"))
    packed = pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    rows = packed.rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    return rows.withColumns({"sequences": F.lit(packed.bins).cast("long"), "sequences_bound": F.lit(packed.bound).cast("long")})
