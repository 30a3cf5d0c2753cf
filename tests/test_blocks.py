"""Searches by blocks against brute force; what they write."""

import numpy as np
import pytest

from quarryloom.operators import blocks, retrieval


def brute(v, k):
    norm = np.linalg.norm(v, axis=1)
    score = np.round((v @ v.T) / np.where(norm > 0, norm, 1)[:, None] / np.where(norm > 0, norm, 1), 9) + 0.0
    out = []
    for i in np.flatnonzero(norm > 0):
        best = [j for j in np.lexsort((np.arange(len(v)), -score[i])) if norm[j] > 0][:k]
        out += [(int(i), int(j), float(score[i, j]), n + 1) for n, j in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block, kind", [(64, float), (4096, float), (64, np.float32)])
def test_blocks_give_what_brute_force_gives(spark, block, kind):
    rng = np.random.default_rng(5)
    v = rng.normal(0, 1, (700, 12)).astype(kind).astype(float)
    v[100:300] = v[99]  # ties beyond k
    v[400:420] = v[399] * 1e6
    v[0] = v[650] = 0
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    held = spark.createDataFrame(rows, "chunk_id long, v array<double>").repartition(3)
    own = retrieval.vector_search(held.withColumnRenamed("chunk_id", "query_id"), held, 7, block=block)
    got = sorted((r.query_id, r.chunk_id, r.score, r["rank"]) for r in own.collect())
    want = brute(v, 7)
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
    assert max(abs(g[2] - w[2]) for g, w in zip(got, want, strict=True)) < 2e-9
    plan = own._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" not in plan and "Generate" not in plan  # no block is copied to its pairs


def test_a_few_queries_ids_of_text_and_nothing(spark):
    held = spark.createDataFrame([(f"c{i % 50:02d}{i}", [float(i % 7), 1.0]) for i in range(300)], "chunk_id string, v array<double>")
    asked = spark.createDataFrame([(1, [0.0, 2.0])], "query_id int, v array<double>")
    want = sorted(f"c{i % 50:02d}{i}" for i in range(300) if i % 7 == 0)[:5]
    assert [r.chunk_id for r in retrieval.vector_search(asked, held, 5, block=64).orderBy("rank").collect()] == want
    assert retrieval.vector_search(asked.limit(0), held, 5).collect() == [] and retrieval.vector_search(asked, held.limit(0), 5).collect() == []


def test_a_block_takes_half_the_room_where_single_precision_holds_it():
    import pyarrow as pa

    v = np.random.default_rng(1).normal(0, 1, (1000, 64))
    ids = pa.array(range(1000))
    single = blocks.packed(ids, v.astype(np.float32).astype(float))
    assert len(single) < 0.6 * len(blocks.packed(ids, v))
    assert (blocks.unpacked(single)[1] == v.astype(np.float32)).all() and (blocks.unpacked(blocks.packed(ids, v))[1] == v).all()


def test_the_best_chunks_are_found_without_a_row_for_every_pair(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(2)
    monkeypatch.setattr(retrieval, "CELLS", 60)
    names = [f"w{i}" for i in range(40)]
    rows = [(rng.choice(["a", "b", None]), i, " ".join(rng.choices(names, k=rng.randint(0, 12)))) for i in range(400)] + [("a", 1000 + i, "w1 w2") for i in range(30)] + [("c", 5, None)]
    chunks = spark.createDataFrame(rows, "kb_id string, chunk_id long, text string").where("kb_id is not null").repartition(3)
    asked = spark.createDataFrame([(i, " ".join(rng.choices(names, k=6))) for i in range(9)] + [(20, "w1 w2"), (21, None), (22, "nothing")], "query_id int, text string")
    want = retrieval.top_k(retrieval.search_bm25(asked, chunks), 4, per=("query_id", "kb_id"), places=9)
    own = retrieval.top_bm25(asked, chunks, 4)
    found = lambda df: sorted((r.query_id, r.kb_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in df.collect())
    assert found(own) == found(want) and len(found(own)) > 70
    assert "query_id" not in own._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[-1].split("\n", 1)[1]  # queries meet chunks in the task only
    assert retrieval.top_bm25(asked.limit(0), chunks).collect() == [] and retrieval.top_bm25(asked, chunks.limit(0)).collect() == []
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 5)
    assert found(retrieval.top_bm25(asked, chunks, 4)) == found(want)
    by_kb = asked.withColumn("kb_id", F.lit("b"))
    assert {r.kb_id for r in retrieval.top_bm25(by_kb, chunks).collect()} == {"b"}
