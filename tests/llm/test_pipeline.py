"""The pipeline's stages on the smallest tables, each against a plain version of its decision."""

import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarrygraph.llm import quality, shared

from .test_ops import bag, base_spans, jaccard

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables")
def test_stages(spark):
    docs = shared.table(spark, DIR, "documents")
    columns, at = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, shared.materialize(stage(spark, docs, DIR), "test")
        at[name] = (before, docs)
        assert name == "packing" or docs.columns == columns
    net = quality.fit(at["quality"][0], shared.table(spark, DIR, "labels"))
    kept = quality.score(at["quality"][0], net).where(F.col("score") >= corpus_pipeline.REJECT_BELOW)
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in at["quality"][1].collect()}

    rows = [(r["doc_id"], bag(r["text"])) for r in at["near_dedup"][0].collect()]
    up = {d: d for d, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if jaccard(x, y) >= 0.8:
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    assert {r["doc_id"] for r in at["near_dedup"][1].collect()} == {find(d) for d, _ in rows}

    before, after = ({r["doc_id"]: r for r in df.collect()} for df in at["secrets"])
    assert before.keys() == after.keys()
    for d, r in before.items():
        if base_spans(r["text"]):
            assert not base_spans(re.sub("<(example-)?secret>", "", after[d]["text"])) and after[d]["n_chars"] == len(after[d]["text"])
        else:
            assert after[d]["text"] == r["text"] or "secret>" in after[d]["text"]

    copies = Counter(r["doc_id"] for r in at["mixing"][1].collect())
    assert max(copies.values()) <= 2 and copies.keys() <= {r["doc_id"] for r in at["mixing"][0].collect()}
    pieces = at["packing"][1].collect()
    assert Counter(r["doc_id"] for r in pieces if r["piece"] == 0) == copies
    fill = Counter()
    for r in pieces:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 1


CLASHING = "score double, size long, secrets string, shard int, copies int, class_id long, kept string, k1 string, k2 string, t int, owner string, found string, bucket string, target string, sequence_id string, piece string"


def folder(spark, tmp_path, rows, labels):
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
    extra = (0.5, 1, "s", 2, 3, 4, "kept", "k1", "k2", 5, "o", "f", "b", "t", "q", "p")
    spark.createDataFrame([(*r, *extra) for r in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def through(spark, at):
    docs, out = shared.table(spark, at, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, shared.materialize(stage(spark, docs, at), "test")
        out[name] = (before.collect(), docs.collect())
        assert name == "packing" or docs.columns == before.columns
    return out


def test_stages_on_hostile_rows(spark, tmp_path):
    same = " ".join(f"word{i}" for i in range(60))
    rows = [(1, None, "en", "a", None), (2, "", None, None, 0), (None, same, "en", "a", len(same)), (3, same, "en", "a", len(same)), (3, same, "en", "a", len(same)), (4, same + " more", None, "b", None)]
    rows += [(5, "token = abcdefgh12 and " + " ".join(f"other{i}" for i in range(30)), "en", "b", 9), (None, None, None, None, None), (6, "x " * 30_000, "de", "c", 60_000), (7, " ".join(f"long{i}" for i in range(20_000)), "de", "c", 1)]
    rows += [(10 + i, " ".join(f"w{i}x{j}" for j in range(40)), "en", "abc"[i % 3], 5) for i in range(20)]
    at = folder(spark, tmp_path, rows, [])  # without labels nothing is rejected
    out = through(spark, at)
    assert len(out["quality"][1]) == len(rows)
    assert Counter(r["doc_id"] for r in out["near_dedup"][1]) == Counter([1, 3, 5, 6, 7, *range(10, 30)])
    five = next(r for r in out["secrets"][1] if r["doc_id"] == 5)
    assert five["text"].startswith("<secret> and other0") and five["n_chars"] == len(five["text"]) and five["secrets"] == "s"
    assert all(a == b for a, b in zip(sorted(out["secrets"][0], key=repr), sorted(out["secrets"][1], key=repr)) if a["doc_id"] not in (5, None))
    taken = Counter(r["doc_id"] for r in out["mixing"][1])
    assert taken.keys() <= {r["doc_id"] for r in out["mixing"][0]} and max(taken.values()) <= 2
    assert Counter(r["doc_id"] for r in out["packing"][1] if r["piece"] == 0) == taken


def test_stages_on_labelled_and_empty_tables(spark, tmp_path):
    good, bad = (lambda i: " ".join(f"plain{i}x{j} reads" for j in range(25))), (lambda i: " ".join(f"#{i}$%{j}@@" for j in range(25)))
    rows = [(i, good(i) if i % 2 else bad(i), "en", "a", 1) for i in range(240)]
    at = folder(spark, tmp_path / "some", rows, [(i, i % 2, 0) for i in range(200)] + [(None, None, None)])
    out = through(spark, at)
    assert {r["doc_id"] for r in out["quality"][1]} == {i for i in range(240) if i % 2}
    none = folder(spark, tmp_path / "none", [], [])
    assert all(after == [] for _, after in through(spark, none).values())
