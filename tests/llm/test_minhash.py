"""MinHash near-dedup against all pairs of full sets, with small and large buckets."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaweave.llm import minhash as M
from mediaweave.llm.queries import ORACLES
from tests.test_oracles import SF_DIR, rows
from tests.test_oracles import duck as duck  # a fixture


def shingles(text: str | None, n: int = 5) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset([" ".join(words)] if 0 < len(words) < n else (" ".join(words[i : i + n]) for i in range(len(words) - n + 1)))


def brute_force(docs: list[tuple]) -> list[tuple]:
    """All pairs, then the closure; rows are told apart by place."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if root[i] != root[j] and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    out = []
    for i, (doc_id, _) in enumerate(docs):
        least = min((d for (d, _), r in zip(docs, root, strict=True) if r == root[i] and d is not None), default=None)
        out.append((doc_id, len(sets[i]), least, doc_id == least))
    return sorted(out, key=repr)


def varied(seed: int) -> list[tuple]:
    """Near copies around the threshold, copies that differ in case and space, a passage that many unlike texts share, chains."""
    draw = random.Random(seed)
    text = lambda n: [f"w{draw.randrange(5000)}" for _ in range(n)]
    passage, out = text(60), []
    for _ in range(6):
        base = text(draw.choice([8, 30, 100, 300]))
        for edits in (0, 0, 1, 1, 2, 3, 5, 8):
            copy = list(base)
            for _ in range(edits):
                copy[draw.choice([0, -1, draw.randrange(len(copy))])] = "new"
            out.append(" ".join(copy))
        out += [" ".join(base).upper(), "  " + "\t".join(base)]
    chain = text(120)
    for k in range(8):  # each is near the next, the ends aren't
        out.append(" ".join(chain[k * 4 :] + [f"x{i}" for i in range(k * 4)]))
    for _ in range(40):
        at, own = draw.randrange(20), text(20)
        out.append(" ".join(own[:at] + passage + own[at:]))
    out += [None, None, "", " \n", "one two", "One  two", "a b c d e", "a b c d e f"]
    draw.shuffle(out)
    return list(enumerate(out)) + [(None, "one two"), (None, "alone as it is"), (None, "alone as it is"), (3, out[3])]


@pytest.mark.parametrize("crowd", [M.CROWD, 1500])
def test_all_links_are_found_in_small_and_large_buckets(spark, crowd):
    docs = varied(crowd % 7)  # the small one deals buckets again and cuts them into blocks
    got = M.near_sets(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), crowd=crowd)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_force(docs)


def test_blocks_of_a_bucket_meet_two_by_two(spark):
    met = spark.range(300).select(F.lit(1).cast("long").alias("key"), F.col("id").alias("node"), F.lit(10).cast("long").alias("size"), F.col("id").alias("part"), F.lit(24000).cast("long").alias("bytes"))
    buckets = M.blocks(met, 4000).groupBy("key").agg(F.collect_set("node").alias("nodes"), F.sum("size").alias("size")).collect()
    together = {(a, b) for r in buckets for a in r.nodes for b in r.nodes}
    assert len(together) == 300 * 300 and len(buckets) == 12 * 11 // 2 and max(r["size"] for r in buckets) < 1000


def test_signatures_agree_as_often_as_sets_overlap():
    draw = np.random.default_rng(5)
    for n in (7, 40, 1000):
        agree = []
        for _ in range(300):
            whole = np.unique(draw.integers(0, 2**64, n, dtype=np.uint64))
            part = np.sort(draw.permutation(whole)[: int(0.85 * n + 1)])
            agree.append((M.signature(whole) == M.signature(part)).mean() - len(part) / n)
        assert abs(np.mean(agree)) < 0.01
    one = M.signature(np.array([12345], np.uint64))  # a set of one fills every bin
    assert (one == 12345).all()


def test_very_long_texts_empty_tables_and_other_columns(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    docs = spark.createDataFrame([(1, long, "x", "y"), (2, long + " end", "x", "y"), (3, long[: len(long) // 2], "x", "y")], "doc_id long, text string, keys string, node string")
    got = {r.doc_id: r for r in M.near_sets(docs).collect()}
    assert [got[i].component_id for i in (1, 2, 3)] == [1, 1, 3] and got[1].n_shingles == len(shingles(long))
    assert M.near_sets(docs.limit(0)).collect() == []


def test_query_against_sql(spark, duck):
    assert rows(M.op13_minhash(spark, SF_DIR).toPandas()) == rows(duck.execute(ORACLES["op13_minhash"]).df())
