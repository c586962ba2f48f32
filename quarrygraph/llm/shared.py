"""What the training-data operators share: shared scratch tables, cached token encoding, components."""

from __future__ import annotations

import os
import tempfile
import uuid
from array import array
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shipping import ship  # noqa: F401

_own_scratch: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder all nodes share: spark.checkpoint.dir, or a folder of our own on a local master where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app not in _own_scratch:
            _own_scratch[app] = "file://" + tempfile.mkdtemp(prefix="quarrygraph-scratch-")
        at = _own_scratch[app]
    return f"{at.rstrip('/')}/quarrygraph-{app}"


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: a cut of lineage that outlives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


@contextmanager
def few_records(spark: SparkSession, n: int) -> Iterator[None]:
    """Tables written inside hand Python ``n`` rows at a time: for rows that are blocks of megabytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Texts that a pass over whole texts hands to Python at a time.
TEXT_RECORDS = 2_000


def trim() -> None:
    """Give memory that a pass no longer uses back to the system, as Python workers live on after their tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


def discard(df: DataFrame) -> None:
    """Delete the table behind a frame that materialize() returned and that nothing reads any more."""
    path = getattr(df, "_quarry_path", None)
    if path:
        delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Delete every scratch table of this application; results read from them must be consumed before."""
    delete_path(spark, scratch_root(spark))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: Fixed value: what the pre-tokenizer of the byte-level vocabularies splits by.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: the suffix of a word's last symbol in the vocabularies with word ends.
WORD_END = "</w>"


class Vocabulary:
    """A BPE vocabulary file of the tokenizers library as byte ranks, and what is needed to encode by ranks exactly.

    Encoding by ranks joins any two neighbours whose bytes are an entry, the library only pairs it lists.  ``odd`` holds
    the entries whose own making, by ranks from single bytes, takes an unlisted pair or doesn't end in the entry.  All
    joins inside a token of a result are those of the token's own making, so a result without odd tokens took listed pairs
    only, in the library's order, and is the library's result; other texts go to the library.  In vocabularies with word
    ends a zero byte closes each word; it joins with the byte before it first of all, as the suffix does.
    ``ranks`` is None where the file isn't of a form this holds for; then the library encodes every text.
    """

    def __init__(self, path: str):
        import json

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.word_ends = model.get("end_of_word_suffix") == WORD_END
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        bare = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        known = self.word_ends or (spec["pre_tokenizer"] == bare and spec["normalizer"] is None)
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        order = [model["vocab"].get("".join(p)) for p in pairs]
        ascending = None not in order and all(a < b for a, b in zip(order, order[1:]))
        self.ranks = self._ranks(model["vocab"]) if plain and known and ascending else None
        self.merges = pairs

    def _letters(self) -> dict[str, int]:
        """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}

    def _bytes(self, token: str, letters: dict[str, int]) -> bytes:
        if self.word_ends and token.endswith(WORD_END):
            return bytes(letters[c] for c in token[: -len(WORD_END)]) + b"\0"
        return bytes(letters[c] for c in token)

    def _ranks(self, vocab: dict[str, int]) -> dict[bytes, int] | None:
        letters = self._letters()
        ranks = {self._bytes(t, letters): i for t, i in vocab.items() if t not in self.specials}
        single = [ranks.get(bytes([b, *end])) for b in range(256) for end in ((b"", b"\0") if self.word_ends else (b"",))]
        # what single bytes are, closed or not, comes before all that is joined
        return None if None in single or sorted(single) != sorted(ranks.values())[: len(single)] else ranks

    def odd(self) -> list[int]:
        """Ids of the entries that are not made of listed pairs."""
        if self.ranks is None:
            return []
        letters, ranks, out = self._letters(), self.ranks, []
        listed = {(self._bytes(a, letters), self._bytes(b, letters)) for a, b in self.merges}
        if self.word_ends:
            listed |= {(bytes([b]), b"\0") for b in range(256)}
        for entry, i in ranks.items():
            parts, good = [entry[j : j + 1] for j in range(len(entry))], True
            while len(parts) > 1:
                best = min(range(len(parts) - 1), key=lambda j: ranks.get(parts[j] + parts[j + 1], 1 << 31))
                if parts[best] + parts[best + 1] not in ranks:
                    break
                good &= (parts[best], parts[best + 1]) in listed
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            if len(parts) > 1 or not good:
                out.append(i)
        return out


class Encoder:
    """Token ids of whole texts as the tokenizers library gives them, nothing remembered between texts.

    Texts are encoded by byte ranks where that is provably the library's result (see Vocabulary), else by the library:
    texts with a control string of the vocabulary, results with an odd token, and, for vocabularies with word ends, texts
    with a zero byte or characters beyond the Latin ones whose lower case and classes are fixed.
    """

    def __init__(self, path: str, odd: list[int]):
        import re

        import numpy as np
        import tiktoken

        self.path, self.tok = path, None
        v = Vocabulary(path)
        self.specials, self.word_ends, self.ranks = v.specials, v.word_ends, v.ranks is not None
        if not self.ranks:
            return
        pattern = r"[^\x00]+\x00" if v.word_ends else BYTE_PATTERN
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=v.ranks, special_tokens={})._core_bpe
        self.odd = np.zeros(max(v.ranks.values()) + 1, dtype=bool)
        self.odd[odd] = True
        if v.word_ends:
            import unicodedata

            kind = lambda c: unicodedata.category(chr(c))[0]
            latin = [c for c in range(1, 0x250) if len(low := chr(c).lower()) == 1 and ord(low) < 0x250]
            letters, digits = ("".join(re.escape(chr(c)) for c in latin if kind(c) == k) for k in "LN")
            space = "\t-\r \x85\xa0"
            self.foreign = re.compile("[^" + "".join(re.escape(chr(c)) for c in latin) + "]").search
            self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{space}{letters}{digits}]+").findall

    def _library(self, text: str) -> bytes:
        if self.tok is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self.tok = Tokenizer.from_file(self.path)
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _one(self, text: str) -> bytes:
        import numpy as np

        if not text:
            return b""
        if not self.ranks or any(s in text for s in self.specials):
            return self._library(text)
        if self.word_ends:
            if ("\0" in text) if text.isascii() else self.foreign(text):
                return self._library(text)
            text = "\0".join(self.words(text.lower())) + "\0"
            if text == "\0":
                return b""
        raw = bytes(self.core.encode_to_tiktoken_buffer(text, set()))
        return self._library(text) if self.odd[np.frombuffer(raw, dtype=np.uint32)].any() else raw

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers."""
        return [self._one(t) for t in texts]


_encoders: dict[str, Encoder] = {}
_odd: dict[str, list[int]] = {}


def odd_entries(path: str) -> list[int]:
    """Vocabulary.odd(), worked out once by the driver and sent along with the tasks."""
    if path not in _odd:
        _odd[path] = Vocabulary(path).odd()
    return _odd[path]


def encoder(path: str, odd: list[int]) -> Encoder:
    """This process's encoder for a vocabulary file; its size doesn't depend on the texts."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, odd)
    return _encoders[path]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b), both long: rows (id, component), component the smallest id reached.

    Alternating large-star and small-star rounds over tables in the shared folder; nothing is collected to the driver.
    Minima are combined before the exchange, so a hub's many edges don't meet in one task, and the joins back are
    plain shuffle joins, which adaptive execution splits where one hub holds many edges.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    for _ in range(max_rounds):
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large-star: larger neighbours of a hang below the least of a and its neighbours
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small-star: a and its smaller neighbours hang below the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        nxt = materialize(small.where("a <> b").distinct(), "cc")
        before, after = (x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() for x in (e, nxt))
        discard(e)
        e = nxt
        if before == after:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
