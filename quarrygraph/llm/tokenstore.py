"""Token-id shards: one zstandard frame per document, a document index and a trailing seek table with checksums.

A shard is a sequence of independent zstandard frames, then one skippable frame with the document index, then one
skippable frame with the seek table of the public zstd seekable format (sizes and the low 32 bits of each frame's
xxHash64).  A reader needs the file's tail and the frames it was asked for, nothing else.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Fixed values of the zstd seekable format: skippable frame magic of the seek table, its footer magic, descriptor with checksums.
SEEK_FRAME, SEEK_FOOTER, WITH_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
#: Fixed value: skippable frame magic of our document index.
INDEX_FRAME = 0x184D2A50
#: Fixed value: stands for a null doc_id in the index.
NO_ID = -(1 << 63)


class ShardWriter:
    """Appends documents' ids to an open binary stream; close() adds index and seek table."""

    def __init__(self, stream, level: int = 3):
        import zstandard

        self.stream, self.zip = stream, zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int]] = []

    def add(self, doc_id: int | None, raw: bytes) -> None:
        """raw: ids as little-endian unsigned 32-bit integers."""
        import xxhash

        frame = self.zip.compress(raw)
        self.stream.write(frame)
        self.frames.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.docs.append((NO_ID if doc_id is None else doc_id, len(raw) // 4))

    def close(self) -> None:
        index = b"".join(struct.pack("<qq", *x) for x in self.docs)
        self.stream.write(struct.pack("<II", INDEX_FRAME, len(index)) + index)
        table = b"".join(struct.pack("<III", *x) for x in [*self.frames, (8 + len(index), 0, 0)])
        table += struct.pack("<IBI", len(self.frames) + 1, WITH_CHECKSUMS, SEEK_FOOTER)
        self.stream.write(struct.pack("<II", SEEK_FRAME, len(table)) + table)
        self.stream.close()


class ShardReader:
    """Random access to a shard in a seekable binary stream."""

    def __init__(self, stream):
        import zstandard

        self.stream, self.unzip = stream, zstandard.ZstdDecompressor()
        end = stream.seek(0, 2)
        stream.seek(end - 9)
        n, descriptor, magic = struct.unpack("<IBI", stream.read(9))
        if magic != SEEK_FOOTER or descriptor != WITH_CHECKSUMS:
            raise ValueError("no seek table at the end of the shard")
        stream.seek(end - 9 - 12 * n)
        entries = [struct.unpack_from("<III", raw, 12 * i) for raw in [stream.read(12 * n)] for i in range(n)]
        self.frames, at = [], 0
        for packed, plain, check in entries[:-1]:
            self.frames.append((at, packed, plain, check))
            at += packed
        stream.seek(at + 8)
        raw = stream.read(entries[-1][0] - 8)
        self.docs = [(None if d == NO_ID else d, k) for d, k in struct.iter_unpack("<qq", raw)]

    def read(self, i: int) -> bytes:
        """Ids of the i-th document of the shard, checked against the seek table."""
        import xxhash

        at, packed, plain, check = self.frames[i]
        self.stream.seek(at)
        raw = self.unzip.decompress(self.stream.read(packed), max_output_size=plain) if plain else b""
        if len(raw) != plain or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"document {i} of the shard doesn't match its checksum")
        return raw

    def find(self, doc_id: int) -> list[int]:
        """Places of a document's rows in the shard."""
        return [i for i, (d, _) in enumerate(self.docs) if d == doc_id]


def _open(path: str, mode: str):
    """A stream at a URI or path of any store that pyarrow reaches."""
    from pyarrow import fs

    at, inside = fs.FileSystem.from_uri(path if "://" in path or path.startswith(("file:", "/")) else f"/{path}")
    return (at.open_output_stream(inside) if mode == "w" else at.open_input_file(inside)), at, inside


def write_token_shards(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2, shard_docs: int = 8192, shard_bytes: int = 8 << 20) -> DataFrame:
    """Encode every whole text, append ``end_id``, write shards in ascending doc_id order; returns the manifest.

    Manifest rows: shard int (in doc_id order), path, n_docs, n_tokens, first_token (tokens of all shards before).
    A null text is empty; null doc_ids come first; rows with one doc_id are ordered by text.  A shard is written under
    a name of its own attempt and moved into place, so a lost task leaves no half shard.  An empty table gives an
    empty manifest.  Shards hold about ``shard_docs`` documents or ``shard_bytes`` of text, whichever is less, so a task's share
    doesn't grow with the input; a very long text is one document of its shard.
    """
    spark = docs.sparkSession
    shared.ship(spark)
    few = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    odd = shared.odd_entries(vocabulary)
    n, held = few.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = max(spark.sparkContext.defaultParallelism, -(-n // shard_docs), -(-held // shard_bytes))

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard  # noqa: F401
        from array import array
        from pyspark import TaskContext

        task, enc, end = TaskContext.get(), shared.encoder(vocabulary, odd), array("I", [end_id]).tobytes()
        writer, n_docs, n_tokens = None, 0, 0
        final = f"{folder}/shard-{task.partitionId():06d}.tok"
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 256):
                if writer is None:
                    stream, store, inside = _open(f"{final}.{task.taskAttemptId()}", "w")
                    writer = ShardWriter(stream)
                for d, raw in zip(ids[at : at + 256], enc.encode(texts.slice(at, 256).to_pylist())):
                    writer.add(d, raw + end)
                    n_docs, n_tokens = n_docs + 1, n_tokens + len(raw) // 4 + 1
        if writer is not None:
            writer.close()
            store.move(inside, inside.rpartition(".")[0])
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([final]), pa.array([n_docs], pa.int64()), pa.array([n_tokens], pa.int64())], names=["shard", "path", "n_docs", "n_tokens"])

    spark.createDataFrame([], "shard int").write.mode("overwrite").parquet(folder)  # makes the folder in whatever store it is
    dealt = few.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    with shared.few_records(spark, shared.TEXT_RECORDS):
        wrote = shared.materialize(dealt.mapInArrow(write, "shard int, path string, n_docs long, n_tokens long"), "manifest")
    # a shard is thousands of documents, so this list is short even for a very large corpus
    from pyspark.sql import Window

    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return wrote.withColumn("first_token", before.cast("long"))


def read_token_shards(manifest: DataFrame) -> DataFrame:
    """Rows doc_id, start (ids of all documents before), n_tokens, ids (binary) of every document, from the files alone."""
    shared.ship(manifest.sparkSession)
    n = manifest.sparkSession.sparkContext.defaultParallelism

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                stream, _, _ = _open(path, "r")
                with stream:
                    shard = ShardReader(stream)
                    for at in range(0, len(shard.docs), 512):
                        some = range(at, min(at + 512, len(shard.docs)))
                        rows = []
                        for i in some:
                            rows.append((shard.docs[i][0], first, shard.docs[i][1], shard.read(i)))
                            first += shard.docs[i][1]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "start", "n_tokens", "ids"])

    return manifest.select("path", "first_token").repartition(max(n, 3 * n)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as word_bpe_49k ids in seekable zstandard shards, read back."""
    manifest = write_token_shards(shared.table(spark, sf_dir, "documents"), shared.scratch_path(spark, "tokens"), shared.tokenizer_path("word_bpe_49k.json"))
    return read_token_shards(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
