"""The ten operators against plain versions, on hostile rows: nulls, empty and long texts, ties, repeats, no rows, clashing names."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrygraph.llm import bagminhash, chat, hnsw, mixing, packing, quality, secrets, shared, sharding, tokenstore, vectordups

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, secrets string, shard int, `a.b` int"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeorst") for _ in range(r.randint(2, 8))) for _ in range(n))


def make_docs(spark, rows):
    return spark.createDataFrame([(d, t, lang, s, None, 1.0, 7, "x", 3, 4) for d, t, lang, s in rows], DOCS).repartition(3)


def hostile():
    rows = [(1, None, "en", "a"), (2, "", None, None), (None, "lone text here", "en", "a"), (3, "x", "en", "b"), (3, "x", "en", "b"), (4, " \n\t ", "en", "b"), (5, words(5, 20_000), "en", "c"), (6, "Été déjà vu 你好 🎉 🎉", "fr", "c"), (7, "a" * 70_000, "en", "a")]
    return rows + [(10 + i, words(i, 5 + 17 * i), "en", "abc"[i % 3]) for i in range(60)] + [(100, "same text again and again", "en", "a")] * 40


@pytest.fixture(scope="module")
def docs(spark):
    return make_docs(spark, hostile()).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# packing


def plain_ids(name: str, texts: list, **k) -> list:
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(shared.tokenizer_path(name))
    return [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


TRICKY = ["", " ", "a  b", " a b\n c", "\n\nx y", "a \tb", "x <|endoftext|> y", "a\x1cb c", "x  y", "é ́a b", "it's we'll DON'T", "a\nb", "\na b", "ab.\n", "x!?*** y,z 12 3a", "ünï Çé ßẞ İ ΑΣ ﬁ", "word" * 40, None]


TRICKY += ["<|startoftext|>a", "a\0b", "a" * 5000, "ƪ Ʃ ẞ ß² ½x", "'S 's'S x'll", "\x85 a\xa0b", "中文 and more", "".join(map(chr, range(1, 0x250)))]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_gives_the_tokenizers_ids(name):
    rng = random.Random(4)
    texts = [t or "" for t in TRICKY] + [words(i, 200).title() for i in range(30)]
    for i in range(600):
        texts.append("".join(chr(rng.randint(1, 0x24F if i % 3 else 0xD7FF)) for _ in range(rng.randint(1, 14))))
    path = shared.tokenizer_path(name)
    enc = shared.Encoder(path, shared.odd_entries(path))
    assert enc.ranks
    assert [np.frombuffer(b, dtype="<u4").tolist() for b in enc.encode(texts)] == plain_ids(name, texts)


def test_encoder_leaves_odd_entries_to_the_library(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    letters = sorted(pre_tokenizers.ByteLevel.alphabet())
    vocab = {c: i for i, c in enumerate(letters)}
    merges = [("a", "b"), ("b", "c"), ("a", "bc"), ("Ġ", "x")]
    vocab |= {x + y: 256 + i for i, (x, y) in enumerate(merges)}
    tok = Tokenizer(models.BPE(vocab=vocab, merges=merges))
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    tok.save(str(tmp_path / "v.json"))
    odd = shared.Vocabulary(str(tmp_path / "v.json")).odd()
    assert odd == [258]  # by ranks ab and c join, which isn't listed
    enc = shared.Encoder(str(tmp_path / "v.json"), odd)
    for text in ("abc", "xbc abc", "bcab x", "cab"):
        assert np.frombuffer(enc.encode([text])[0], dtype="<u4").tolist() == tok.encode(text).ids


def test_pack(spark, docs, empty):
    pieces = packing.tokenize_pieces(docs, shared.tokenizer_path("byte_bpe_50k.json"))
    rows = pieces.collect()
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], zlib.crc32(r["ids"])) for r in rows)
    want: Counter = Counter()
    for (d, *_), ids in zip(hostile(), plain_ids("byte_bpe_50k.json", [r[1] for r in hostile()])):
        ids, start, piece = [*ids, 0], 0, 0
        while start < len(ids):
            size = len(ids) if len(ids) <= 2048 else (len(ids) % 2048 or 2048) if piece == 0 else 2048
            want[d, piece, start, size, zlib.crc32(np.asarray(ids[start : start + size], dtype="<u4").tobytes())] += 1
            start, piece = start + size, piece + 1
    assert got == want
    packed = packing.pack(pieces.withColumn("offset", F.lit("mine")), rows_per_partition=40)
    bins = defaultdict(list)
    for r in packed.rows.collect():
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(map(len, bins.values())) == len(rows)
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 2048
    assert len(bins) == packed.bins >= packed.bound
    assert packed.bins <= packed.bound + 1
    assert packing.pack(packing.tokenize_pieces(empty, shared.tokenizer_path("byte_bpe_50k.json"))).rows.count() == 0


def test_pack_keeps_other_columns_exactly(spark):
    big = 2**60 + 1
    rows = [(big, 0, 5, None, "a"), (None, 0, 7, big, "b"), (big + 2, 0, 2048, 3, None), (None, 0, 7, big, "b")]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, length long, `my col` long, `a:b, c` string"))
    assert packed.rows.columns[3:5] == ["my col", "a:b, c"]
    assert Counter(tuple(r)[:5] for r in packed.rows.collect()) == Counter(rows)


def optimal(lengths, capacity):
    best = [len(lengths)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + lengths[i] <= capacity and bins[b] not in bins[:b]:
                bins[b] += lengths[i]
                place(i + 1, bins)
                bins[b] -= lengths[i]
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best[0]


def test_bounds_are_below_the_optimum():
    r = random.Random(4)
    for _ in range(60):
        lengths = sorted((r.randint(1, 20) for _ in range(r.randint(1, 9))), reverse=True)
        best = optimal(lengths, 20)
        bound = packing.lower_bound(*np.unique(lengths, return_counts=True), 20)
        bins, offsets, fills = packing.best_fit_decreasing(lengths, 20)
        assert bound <= best <= len(fills) and fills.max() <= 20
    assert packing.lower_bound([11, 9], [4, 2], 20) == 4


# nearest neighbours


def vector_rows():
    r = np.random.default_rng(0)
    centres = r.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.3 * r.normal(size=16)).astype("f4").tolist(), int(i % 3)) for i in range(900)]
    rows += [(2000 + i, rows[0][1], 0) for i in range(60)] + [(3000, None, 1), (3001, [0.0] * 16, 1), (3002, [math.nan] * 16, 1), (3003, [None] + [1.0] * 15, 1), (None, rows[1][1], 1), (3004, rows[2][1], None), (5, rows[5][1], 2)]
    return rows


@pytest.fixture(scope="module")
def vecs(spark):
    return spark.createDataFrame(vector_rows(), "vec_id long, embedding array<float>, label int").repartition(3).persist()


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)


def test_hnsw(spark, vecs):
    k = 20
    got = defaultdict(list)
    for r in hnsw.nearest(vecs, vecs.where("vec_id % 20 = 0"), k, shard_rows=400).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    rows = [(i, np.asarray(v, dtype=np.float32).astype(float)) for i, v, _ in vector_rows() if i is not None and good(v)]
    hit = total = 0
    for q, v in {i: v for i, v in rows if i % 20 == 0}.items():
        best = {}
        for i, w in rows:
            if i != q:
                best[i] = max(best.get(i, -9), float(w @ v))
        order = sorted(best, key=lambda i: (-round(best[i], 9), i))[:k]
        mine = got[q]
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1)) and len(mine) == k and q not in [m[1] for m in mine]
        assert all(abs(m[2] - best[m[1]]) < 1e-9 for m in mine)
        assert [(-m[2], m[1]) for m in mine] == sorted((-m[2], m[1]) for m in mine)
        hit, total = hit + len(set(order) & {m[1] for m in mine}), total + k
    assert hit / total >= 0.9
    few = vecs.where("vec_id < 5")
    assert hnsw.nearest(few, few.where("vec_id = 0"), k).count() == 4
    assert hnsw.nearest(vecs.limit(0), vecs, k).count() == 0


@pytest.mark.parametrize("kind", ["every row twice", "one id with one vector", "one id with many vectors"])
def test_hnsw_counts_ids_not_rows(spark, kind):
    g, k = np.random.default_rng(4), 20
    x = g.normal(size=(600, 8)).astype("f4")
    rows = list(enumerate(x))
    if kind == "every row twice":
        rows += rows
    else:  # a third of all rows, near every vector as they hold its greatest ones
        x[0] *= 4
        rows += [(7, x[0] if kind == "one id with one vector" else 6 * v) for v in g.normal(size=(300, 8)).astype("f4")]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<float>").repartition(3)
    for shard_rows in (8192, 300):
        got = defaultdict(list)
        for r in hnsw.nearest(df, df.where("vec_id % 20 = 0 or vec_id = 7"), k, shard_rows=shard_rows, width=32).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["vec_id"], r["score"]))
        hit = total = 0
        for q in {i for i, _ in rows if i % 20 == 0 or i == 7}:
            best: dict = {}
            for v in {v.tobytes(): v for i, v in rows if i == q}.values():
                for i, w in rows:
                    if i != q:
                        best[i] = max(best.get(i, -math.inf), float(v.astype(float) @ w.astype(float)))
            want = sorted(best, key=lambda i: (-best[i], i))[:k]
            assert len({i for i, _ in got[q]}) == len(got[q]) == k
            if q != 7:
                assert all(abs(s - best[i]) < 1e-4 for i, s in got[q])
            hit, total = hit + len(set(want) & {i for i, _ in got[q]}), total + k
        assert hit / total >= 0.9


def test_hnsw_meets_only_vectors_of_one_length(spark):
    g = np.random.default_rng(8)
    rows = [(i, g.normal(size=3 + i % 2).tolist()) for i in range(200)] + [(500, [1.0] * 9), (501, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, shard string")
    got = defaultdict(list)
    for r in hnsw.nearest(df, df.where("vec_id % 10 < 2 or vec_id > 400"), 5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got.keys() == {i for i in range(200) if i % 10 < 2}
    for q, found in got.items():
        want = sorted(((i, float(np.dot(rows[q][1], v))) for i, v in rows if i != q and len(v) == len(rows[q][1])), key=lambda x: (-x[1], x[0]))[:5]
        assert [i for i, _ in found] == [i for i, _ in want] and all(abs(a[1] - b[1]) < 1e-12 for a, b in zip(found, want))


def test_vector_dups(spark, vecs):
    got = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectordups.near_duplicates(vecs, cell_rows=100, block_rows=64).collect())
    rows = vector_rows()
    unit = [np.asarray(v, dtype=np.float32).astype(float) / np.linalg.norm(np.asarray(v, dtype=np.float32).astype(float)) if i is not None and label is not None and good(v) else None for i, v, label in rows]
    links = defaultdict(set)
    for a in range(len(rows)):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and unit[a] @ unit[b] >= 0.93:
                links[a].add(b)
                links[b].add(a)
    want: Counter = Counter()
    for a, (i, _, _) in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        low = min((rows[b][0] for b in seen if rows[b][0] is not None), default=None)
        want[i, len(links[a]), low, i == low if i is not None else True] += 1
    assert got == want
    assert vectordups.near_duplicates(vecs.limit(0)).count() == 0


def test_vector_dups_with_repeated_ids_lengths_and_not_finite_vectors(spark):
    e, f = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(7, e, 1), (7, f, 1), (8, e, 1), (9, f, 1), (9, f, 1), (9, e, 2), (3, f, 2), (4, [1.0, 0.0], 1), (5, [2.0, 0.0], 1), (6, [0.0, 1.0], 1), (10, [math.inf, 0.0, 0.0], 1), (11, [math.inf, 0.0, 0.0], 1), (12, [], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, gid string")
    got = Counter(tuple(r) for r in vectordups.near_duplicates(df, block_rows=1).collect())
    want = [(7, 1, 7, True), (8, 1, 7, False), (7, 2, 7, True), (9, 2, 7, False), (9, 2, 7, False), (9, 0, 9, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 0, 6, True), (10, 0, 10, True), (11, 0, 11, True), (12, 0, 12, True)]
    assert got == Counter(want)


def test_no_link_is_lost_between_cells(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 3)).astype("f4")
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (u @ u.T >= 0.93).sum(1) - 1
    assert {r["vec_id"]: r["n_links"] for r in vectordups.near_duplicates(df, cell_rows=40, block_rows=32).collect()} == dict(enumerate(want.tolist()))


# quality


def test_quality(spark, docs, empty):
    r = random.Random(2)
    rows = [(i, words(i, 60) if i % 2 else " ".join(w + r.choice(["***", "###", "$$$"]) for w in words(i, 60).split()), "en", "a") for i in range(400)]
    df = make_docs(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)] + [(None, 1, 0), (9999, None, 0)], "doc_id long, quality int, toxic int")
    net = quality.fit(df, labels, sample_docs=200)
    scored = quality.score(df, net).withColumn("h", quality.held_out(F.col("doc_id"))).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in scored)
    out = [r for r in scored if r["h"]]
    assert sum((r["score"] >= 0.7) == r["doc_id"] % 2 for r in out) / len(out) > 0.95
    every = quality.score(docs, net).collect()
    assert len(every) == len(hostile()) and all(0 <= r["score"] <= 1 for r in every)
    assert quality.score(empty, net).count() == 0
    assert quality.fit(empty, labels).p is not None
    text = words(1, 3000).encode()
    got = quality.chunks(text)
    assert got[0, : quality.CHUNK].astype(np.uint8).tobytes() == text[: quality.CHUNK] and (got != quality.PAD).sum() >= len(text)


def slow_score(net, text):
    """One filter and one byte of it at a time; chunks are looked at one by one."""
    raw = list(text.encode())
    raw += [quality.PAD] * (quality.CHUNK - len(raw))
    starts = [*range(0, len(raw) - quality.CHUNK, quality.STRIDE), len(raw) - quality.CHUNK]
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    e, largest, least = p["embed"][raw], [], []
    for f in range(quality.FILTERS):
        response = np.zeros(len(raw) - quality.WIDTH + 1)
        for j in range(quality.WIDTH):
            for d in range(quality.DEPTH):
                response += e[j : j + len(response), d] * p["filters"][j * quality.DEPTH + d, f]
        tops = [response[s : s + quality.CHUNK - quality.WIDTH + 1].max() for s in starts]
        largest.append(max(tops))
        least.append(min(tops))
    pooled = [max(0.0, x + b) for x, b in zip(largest + least, p["bias"])]
    hidden = [max(0.0, sum(x * p["hidden"][f, h] for f, x in enumerate(pooled)) + p["hidden_bias"][h]) for h in range(quality.HIDDEN)]
    odds = sum(x * w for x, w in zip(hidden, p["out"])) + p["out_bias"][0]
    return 1 / (1 + math.exp(-odds))


def test_scores_equal_a_slow_loop_over_filters():
    net = quality.Network(seed=7)
    net.p["bias"] += np.linspace(-0.5, 0.5, 2 * quality.FILTERS, dtype=np.float32)
    edge = [quality.CHUNK + k * quality.STRIDE + d for k in (0, 1, 2, 200) for d in (-1, 0, 1)]
    texts = ["", "x", "é", *[words(n, 40_000)[:n] for n in edge], words(5, 200_000)[:1_000_000], "same" * 9, "same" * 9]
    got = quality.score_texts(net, texts)
    assert max(abs(g - slow_score(net, t)) for g, t in zip(got, texts)) < 1e-5 and abs(got[-1] - got[-2]) < 1e-6
    assert quality.score_texts(net, []) == []


def test_quality_sample_is_bounded_in_rows_and_bytes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "train", lambda texts, labels, **k: seen.append((texts, labels)))
    df = spark.createDataFrame([(i, "x" * (10 if i != 5 else 10_000)) for i in range(40)] + [(7, "a second text"), (7, "x" * 10), (None, "y")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(8, 1), (None, 1), (9, None)], "doc_id long, quality int")
    quality.fit(df, labels, sample_docs=1000, sample_bytes=150)
    quality.fit(df, labels, sample_docs=1000, sample_bytes=150)
    quality.fit(df, labels, sample_docs=12)
    quality.fit(df, labels)
    learnt = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert seen[0] == seen[1] and len(seen[0][0]) == 15 and len(seen[2][0]) <= 12
    assert len(seen[3][0]) == len(learnt) and sorted(map(len, seen[3][0])) == sorted(13 if i == 7 else 10_000 if i == 5 else 10 for i in learnt)
    assert sum(seen[3][1]) == sum(i % 2 or i == 8 for i in learnt)


def test_gradients():
    net = quality.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, starts = quality._joined([quality.chunks(words(i, 60 * i).encode()) for i in (1, 4, 2)])
    odds, held = net.forward(x, starts, keep=True)
    grads = net.backward(held, np.ones(3))
    for k, at in (("out", (3,)), ("hidden", (5, 2)), ("filters", (7, 3)), ("filters", (2, 1)), ("embed", (101, 2)), ("bias", (4,)), ("hidden_bias", (1,))):
        before = net.p[k][at]
        sums = []
        for step in (1e-6, -1e-6):
            net.p[k][at] = before + step
            sums.append(net.forward(x, starts).sum())
        net.p[k][at] = before
        assert abs((sums[0] - sums[1]) / 2e-6 - grads[k][at]) < 1e-3 * max(1, abs(grads[k][at]))


# secrets

SECRET_TEXTS = [
    (1, "token = abcdef; é Password: 'hunter22' secret: token: abcdef", "en", "a"), (2, "AKIA" + "B7" * 10 + " AKIAshort", "en", "a"), (3, "0123456789abcdef01234567 x deadbeef", "en", "a"),
    (4, "api-key=zz apikey=q.w+e/r_t-y= key", "en", "b"), (5, "Zx9Qw8Er7Ty6Ui5Op4As3 alone", "en", "a"), (6, "Common1Example2Value3Here", "en", "a"), (7, "Common1Example2Value3Here", "en", "b"), (8, "Common1Example2Value3Here", "de", "c"),
    (9, "🎉 token=Zx9Qw8Er7Ty6Ui5Op4As3", None, None), (10, None, "en", "a"), (11, "", "en", "a"), (9, "🎉 token=Zx9Qw8Er7Ty6Ui5Op4As3", None, None), (None, "secret=" + "y" * 50_000, "en", "z"),
]


def base_spans(text):
    out = []
    for k, (kind, pattern, least, group) in enumerate((("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2), ("access", r"AKIA[A-Z0-9]+", 20, 0), ("hex", r"[0-9a-f]+", 24, 0))):
        out += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text or "", re.A) if len(m[group]) >= least]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out)]


def test_secrets(spark, docs, empty):
    df = make_docs(spark, SECRET_TEXTS)
    found = secrets.find_secrets(df)
    assert found.count() == len(SECRET_TEXTS) and "a.b" in found.columns
    got = Counter()
    by_doc = {}
    for r in found.collect():
        got[r["doc_id"], tuple(f"{s['kind']}:{s['start']}:{s['end']}" for s in r["secrets"] if s["kind"] != "opaque")] += 1
        by_doc[r["doc_id"]] = r["secrets"]
    assert got == Counter((d, tuple(base_spans(t))) for d, t, *_ in SECRET_TEXTS)
    assert [s["kind"] for s in by_doc[5]] == ["opaque"] and by_doc[5][0]["live"] and by_doc[5][0]["owners"] == 2
    assert by_doc[6] == [] and by_doc[7] == []
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(found).collect()}
    assert clean[1] == "<secret>; é <secret>' secret: token: abcdef" and clean[9] == "🎉 <secret>" and clean[10] is None and clean[11] == "" and clean[6] == "Common1Example2Value3Here"
    assert secrets.find_secrets(empty).count() == 0
    assert secrets.find_secrets(docs).count() == len(hostile())


def test_secrets_with_very_many_matches(spark):
    rng = random.Random(6)
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    gap = lambda: "".join(rng.choice("xyzéß🎉 \n") for _ in range(rng.choice([1, 1, 3, 9000 if rng.random() < 0.001 else 2])))
    many = "".join(f" {key(24)} {gap()}" + (f"token={key(30)}{gap()}" if i % 7 == 0 else "") for i in range(16_000))
    rows = [(1, many, "en", "a"), (1, many, "en", "a"), (2, many[:5000], "en", "b"), (3, "z" * 4096 + " secret=abcdefgh " + "z" * 4080 + " secret=abcdefgh", "en", "a")]
    df = make_docs(spark, rows).repartition(2)
    began = time.time()
    found = shared.materialize(secrets.find_secrets(df), "many")
    took = time.time() - began
    out = {r["doc_id"]: (r["secrets"], r["text"]) for r in found.collect()}
    for d, text, *_ in rows:
        assert [f"{s['kind']}:{s['start']}:{s['end']}" for s in out[d][0] if s["kind"] != "opaque"] == base_spans(text)
    assert {s["owners"] for s in out[2][0]} == {2} and {s["owners"] for s in out[3][0]} == {1}
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(found).collect()}
    for d, text, *_ in rows:
        plain, at = [], 0
        for s in sorted(out[d][0], key=lambda s: (s["start"], s["end"])):
            if s["start"] >= at:
                plain.append(text[at : s["start"]] + "<secret>")
            at = max(at, s["end"])
        assert clean[d] == "".join(plain) + text[at:]
    assert took < 20


# sharding


def test_sharding(spark, docs, empty):
    rows = sharding.two_pass_shuffle(docs, 8, bucket_bytes=50_000, weight=F.coalesce(F.octet_length("text"), F.lit(0)) + 1).collect()
    per = defaultdict(list)
    for r in rows:
        per[r["shard"]].append(r["slot"])
    counts = [len(per[s]) for s in range(8)]
    assert sum(counts) == len(hostile()) and max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r[0], r[1]) for r in hostile())
    assert sharding.two_pass_shuffle(empty, 8).count() == 0
    assert sorted(r["shard"] for r in sharding.two_pass_shuffle(docs.limit(3), 8).collect()) == [0, 1, 2]


def test_sharding_against_plain_buckets(spark):
    """Buckets by the hash worked out here; the same order whatever the shuffle partitions; order within buckets mixed."""
    df = spark.range(0, 3000, 1, 3).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 90).alias("text"), F.lit(1).alias("shard"))
    weight = F.octet_length("text") + 10
    runs = []
    for partitions in ("4", "9"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            runs.append({(r["shard"], r["slot"]): r["doc_id"] for r in sharding.two_pass_shuffle(df, 7, bucket_bytes=30_000, seed=3, weight=weight).collect()})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    assert runs[0] == runs[1] and sorted(runs[0].values()) == list(range(3000))
    order = [runs[0][k] for k in sorted(runs[0])]

    def bucket(i):  # a row's place is its partition's number and its place there
        import struct

        import xxhash

        salt = xxhash.xxh64_intdigest(struct.pack("<i", 3), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<q", (i // 1000 << 33) + i % 1000), salt)
        return (h - (1 << 64) if h >> 63 else h) % 10

    assert [bucket(i) for i in order] == sorted(bucket(i) for i in range(3000))
    for b in range(10):
        inside = [i for i in order if bucket(i) == b]
        assert abs(np.corrcoef(inside, np.arange(len(inside)))[0, 1]) < 0.25


# near duplicates


def bag(text):
    w = (text or "").split()
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()


def jaccard(a, b):
    low, total = sum((a & b).values()), sum(a.values()) + sum(b.values())
    return 1.0 if not total else low / (total - low)


def near_rows():
    r = random.Random(3)
    base, rows = words(900, 150).split(), hostile()
    for i in range(120):  # a large group around one text
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
        rows.append((1000 + i, " ".join(w), "en", "a"))
    for i in range(60):  # a common passage in otherwise different texts
        rows.append((2000 + i, words(900, 150) + " " + words(5000 + i, 160), "en", "a"))
    rows += [(3000, "buy now " * 50, "en", "a"), (3001, "buy now " * 52, "en", "a"), (3002, "buy now " * 90, "en", "a")]
    return rows


def test_near_dups(spark, empty):
    rows = near_rows()
    got = Counter((r["doc_id"], r["class_id"], r["kept"]) for r in bagminhash.near_duplicates(make_docs(spark, rows)).collect())
    bags = [bag(t) for _, t, *_ in rows]
    links = defaultdict(set)
    for a in range(len(rows)):
        for b in range(a):
            if jaccard(bags[a], bags[b]) >= 0.8:
                links[a].add(b)
                links[b].add(a)
    want: Counter = Counter()
    for a, row in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        low = min((rows[b][0] for b in seen if rows[b][0] is not None), default=None)
        want[row[0], low, row[0] == low] += 1
    assert got == want
    kept = bagminhash.keep_one(make_docs(spark, rows))
    assert kept.count() == len({k[1] for k in want}) and kept.columns == empty.columns
    assert bagminhash.near_duplicates(empty).count() == 0 and bagminhash.keep_one(empty).count() == 0


def test_one_row_of_a_class_stays_when_ids_repeat(spark):
    a, b = words(70, 200), words(71, 200)
    rows = [(8, a, "en", "a"), (8, a + " x", "en", "a"), (8, a + " x", "en", "a"), (9, a + " y", "en", "a"), (None, b, "en", "a"), (None, b + " x", "en", "a"), (None, b + " y", "en", "a")]
    docs = make_docs(spark, rows)
    per = defaultdict(set)
    for r in bagminhash.near_duplicates(docs).collect():
        if r["kept"]:
            per[r["class_id"]].add((r["doc_id"], (r["k1"], r["k2"])))
    assert {c: len(v) for c, v in per.items()} == {8: 1, None: 1} and {d for v in per.values() for d, _ in v} == {8, None}
    kept = [(r["doc_id"], r["text"]) for r in bagminhash.keep_one(docs).collect()]
    assert len(kept) == 2 and {d for d, _ in kept} == {8, None} and {(d, t) for d, t, *_ in rows} >= set(kept)


def test_signatures_estimate_weighted_jaccard():
    r = random.Random(5)
    s = bagminhash.Shingler(words=1)
    for _ in range(6):
        a, b = ([f"w{r.randrange(12)}" for _ in range(60)] for _ in range(2))
        x, y = s.bag(" ".join(a)), s.bag(" ".join(b))
        m = 4000
        sig = bagminhash.signatures([x, y], m)
        want = jaccard(Counter(a), Counter(b))
        assert abs(bagminhash.similarity(x, y) - want) < 1e-12
        assert abs((sig[0] == sig[1]).mean() - want) < 4 * math.sqrt(want * (1 - want) / m) + 1e-9


def test_components(spark):
    r = random.Random(6)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 5001 + i) for i in range(200)]
    got = {x["id"]: x["component"] for x in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in {v for a, b in edges if a != b for v in (a, b)}}


# token shards


def test_token_shards(spark, docs, empty, tmp_path):
    manifest = tokenstore.write_token_shards(docs, "file://" + str(tmp_path / "t"), shared.tokenizer_path("word_bpe_49k.json"), shard_docs=16)
    got = [(r["doc_id"], r["start"], r["n_tokens"], np.frombuffer(r["ids"], dtype="<u4").tolist()) for r in tokenstore.read_token_shards(manifest).orderBy("start").collect()]
    want = sorted(((d if d is not None else -1, ids + [2]) for (d, *_), ids in zip(hostile(), plain_ids("word_bpe_49k.json", [r[1] for r in hostile()]))), key=lambda x: x[0])
    assert [g[0] if g[0] is not None else -1 for g in got] == [w[0] for w in want]
    at = 0
    for g in got:
        assert g[1] == at and g[2] == len(g[3])
        at += g[2]
    assert sorted(g[3] for g in got) == sorted(w[1] for w in want)
    none = tokenstore.write_token_shards(empty, "file://" + str(tmp_path / "e"), shared.tokenizer_path("word_bpe_49k.json"))
    assert tokenstore.read_token_shards(none).count() == 0


def test_shard_file(tmp_path):
    bodies = [np.arange(n, dtype="<u4").tobytes() for n in (0, 1, 5000)]
    with open(tmp_path / "s", "wb") as f:
        w = tokenstore.ShardWriter(f)
        for d, b in zip((None, 7, 7), bodies):
            w.add(d, b)
        w.close()
    with open(tmp_path / "s", "rb") as f:
        r = tokenstore.ShardReader(f)
        assert [d for d, _ in r.docs] == [None, 7, 7] and r.find(7) == [1, 2]
        assert [r.read(i) for i in (2, 0, 1)] == [bodies[i] for i in (2, 0, 1)]
    raw = bytearray((tmp_path / "s").read_bytes())
    at, packed, _, _ = r.frames[2]
    raw[at + packed // 2] ^= 0xFF
    (tmp_path / "bad").write_bytes(bytes(raw))
    with open(tmp_path / "bad", "rb") as f:
        r = tokenstore.ShardReader(f)
        assert r.read(1) == bodies[1]
        with pytest.raises(Exception):
            r.read(2)


# chat

SAID = "\\### Assistant: </turn> ok"
TURNS = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 3, "assistant", "c <|end|> \\<| <\\| \\\\"), (1, 3, "assistant", "c <|end|> \\<| <\\| \\\\"), (1, None, "system", None), (2, 1, None, "x"), (2, 1, "user", "<|role|>user<|text|>"), (None, 1, "user", ""), (3, 1, "assistant", "y" * 50_000), (3, 2, "<|role|>", "\n<|more|>\n"), (-7, 0, "user", SAID), (-7, 1, "assistant", SAID)]


def test_chat(spark):
    df = spark.createDataFrame([(*t, 1, "z") for t in TURNS], "conv_id long, turn long, role string, text string, segments int, t string").repartition(3)
    out = chat.format_conversations(df)
    rows = out.select("conv_id", "formatted", "n_turns", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"), "segments").collect()
    per = defaultdict(list)
    for c, turn, role, text in TURNS:
        per[c].append((turn if turn is not None else -(10**9), role or "", text or ""))
    assert len(rows) == len(per)
    for r in rows:
        want = sorted(per[r["conv_id"]])
        assert [(t["role"], t["text"]) for t in r["turns"]] == [w[1:] for w in want] and r["n_turns"] == len(want)
        assert r["loss"] == "".join(w[2] for w in want if w[1] == "assistant")
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        assert r["formatted"].count("<|end|>") == sum(i == 0 or want[i][1] != want[i - 1][1] for i in range(len(want)))
    assert chat.format_conversations(df.limit(0)).count() == 0
    long = "a <| b \\ " * 100_000
    many = spark.createDataFrame([(1, 1, "user", long), (1, 2, "assistant", long), *((2, i, "assistant", "<|end|>") for i in range(5000))], "conv_id long, turn long, role string, text string")
    back = {r["conv_id"]: r for r in chat.format_conversations(many).select("conv_id", "n_turns", chat.loss_text(F.col("segments")).alias("loss"), chat.parse(F.col("formatted")).alias("turns")).collect()}
    assert back[1]["loss"] == long and [t["text"] for t in back[1]["turns"]] == [long, long]
    assert back[2]["n_turns"] == 5000 and back[2]["loss"] == "<|end|>" * 5000


# mixing


def test_mixing(spark, docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(hostile())
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sums = Counter()
    for _, t, _, s in hostile():
        sums[s] += size(t)
    order = sorted((s for s in sums if s is not None)) + [None] * (None in sums)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, rest, live = {}, 1.5 * sum(sums.values()), set(order)
    while live:
        share = {s: rest * weight[s] / sum(weight[x] for x in live) for s in live}
        over = [s for s in live if share[s] > 2 * sums[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * sums[s]
            rest -= target[s]
            live.remove(s)
    taken = Counter()
    for r in rows:
        assert r["size"] == size(r["text"]) and r["source_size"] == sums[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, target[r["source"]])
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
    biggest = defaultdict(int)
    for _, t, _, s in hostile():
        biggest[s] = max(biggest[s], size(t))
    assert all(abs(taken[s] - target[s]) <= biggest[s] / 2 + 40 * 5 for s in order)
    again = mixing.mix(docs).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))
    assert mixing.mix(empty).count() == 0
    nothing = make_docs(spark, [(1, None, "en", "a"), (2, "", "en", "b")])
    assert [r["copies"] for r in mixing.mix(nothing).collect()] == [0, 0]


def test_mixing_takes_as_many_equal_rows_however_they_are_dealt(spark):
    rows = [(5, "w " * 50, "en", "a")] * 400 + [(i, "v " * (1 + i % 9), "en", "b") for i in range(3000)] + [(None, "u " * 7, None, None)] * 9
    totals = set()
    for parts in (1, 3, 7):
        out = mixing.mix(make_docs(spark, rows).repartition(parts)).collect()
        assert len(out) == len(rows)
        taken = Counter()
        for r in out:
            taken[r["source"]] += r["copies"] * r["size"]
        target = {r["source"]: r["target"] for r in out}
        assert abs(taken["a"] - target["a"]) <= 25 and abs(taken["b"] - target["b"]) <= 5 and abs(taken[None] - target[None]) <= 4
        totals.add((taken["a"], taken["b"], taken[None]))
    assert len(totals) == 1
