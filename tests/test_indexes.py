"""The stored postings index against a search of everything, cells against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryloom.operators import cells, postings, retrieval

CHUNKS = "kb_id string, chunk_id long, text string, term string"


def corpus(rng, n):
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(400)]
    out = []
    for i in range(n):
        words = [rng.choice(common) for _ in range(rng.randint(0, 30))] + [rng.choice(rare) for _ in range(rng.randint(0, 4))]
        rng.shuffle(words)
        out.append(("hot" if i % 3 else f"k{i % 5}", i, " ".join(words), "clash"))
    return out


def found(df):
    return sorted((r.query_id, r.kb_id, r.chunk_id, round(r.score, 6)) for r in df.collect())


def test_the_index_gives_what_a_search_of_everything_gives(spark, tmp_path):
    rng = random.Random(8)
    rows = [*corpus(rng, 900), (None, 5000, "c1 r1", "x"), ("hot", 5001, None, "x"), ("hot", 5002, "", "x")]
    rows += [("hot", 6000 + i, "r1 r2 r3", "x") for i in range(40)]  # copies: ties at every rank
    chunks = spark.createDataFrame(rows, CHUNKS)
    path = f"file://{tmp_path}/index"
    for batch in ("chunk_id % 3 = 0", "chunk_id % 3 = 1", "chunk_id % 3 = 2", "false"):
        postings.add_to_index(chunks.where(batch), path, buckets=16, block=4)
    index = postings.read_index(spark, path)
    asked = [(1, "r1 r2 r3"), (2, "c1 c2 c3 c1"), (3, "c5 r77 r200"), (4, ""), (5, None), (6, "nothing"), (7, " ".join(r[2] for r in rows[:1]))]
    everywhere = spark.createDataFrame(asked, "query_id int, text string")
    own = spark.createDataFrame([(q, k, t) for q, t in asked for k in ("hot", "k3", "none")], "query_id int, kb_id string, text string")
    whole = chunks.where("kb_id is not null")
    for queries, k in ((everywhere, 2), (everywhere, 20), (own, 3)):
        want = retrieval.top_k(retrieval.search_bm25(queries, whole).withColumn("score", F.round("score", 9)), k, per=("query_id", "kb_id"))
        assert found(postings.search_index(queries, index, k, buckets=16)) == found(want)
    assert found(postings.search_index(everywhere.limit(0), index, buckets=16)) == []


def test_bounds_rule_blocks_out_and_other_buckets_are_not_read(spark, tmp_path):
    rng = random.Random(9)
    chunks = spark.createDataFrame(corpus(rng, 2000), CHUNKS)
    path = f"file://{tmp_path}/index"
    postings.add_to_index(chunks, path, buckets=16, block=4)
    index = postings.read_index(spark, path)
    terms = retrieval.terms_of(spark.createDataFrame([(1, "c1 r10 r11")], "query_id int, text string"))
    lists = postings.bounded_lists(terms, index, 16)
    _, rest, blocks = postings.split_blocks(lists, postings.buckets_of(index, terms, 16), 3)
    assert 0 < rest.count() < 0.5 * blocks.count()
    scans = postings.buckets_of(index, terms, 16)._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")
    assert len(scans) == 2 and "bucket" in scans[1].split("]")[0] and " IN (" in scans[1].split("]")[0]


def test_an_index_of_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    postings.add_to_index(spark.createDataFrame([], CHUNKS), path)
    asked = spark.createDataFrame([(1, "c1")], "query_id int, text string")
    assert postings.search_index(asked, postings.read_index(spark, path)).collect() == []


def clustered(rng, n, dim=16, groups=40):
    centres = rng.normal(0, 1, (groups, dim))
    return centres[rng.integers(0, groups, n)] + rng.normal(0, 0.35, (n, dim))


@pytest.mark.parametrize("structured", [True, False])
def test_cells_reach_the_wanted_recall(spark, structured):
    rng = np.random.default_rng(3)
    v = clustered(rng, 3000) if structured else rng.normal(0, 1, (1500, 16))
    v[500:900] = v[499]  # a cell with a large share of all rows, and ties
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(9000, [0.0] * 16), (9001, None)]
    held = spark.createDataFrame(rows, "chunk_id long, v array<double>")
    asked = held.withColumnRenamed("chunk_id", "query_id")
    got = cells.cell_search(asked, held, 10, part=256).collect()
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    exact = np.round(unit @ unit.T, 9)
    of = {}
    for r in got:
        assert abs(r.score - exact[r.query_id, r.chunk_id]) < 2e-9
        of.setdefault(r.query_id, set()).add(r.chunk_id)
    assert set(of) == set(range(len(v)))
    hit = sum(len(of[i] & set(np.lexsort((np.arange(len(v)), -exact[i]))[:10].tolist())) for i in range(len(v)))
    assert hit >= 0.9 * 10 * len(v)
    if structured:
        model = cells.fit_cells(cells.with_direction(held, "chunk_id"), len(v))
        near = cells.in_cells(cells.with_direction(held, "chunk_id"), "chunk_id", model, 1)
        assert cells.cells_for(cells.with_direction(asked, "query_id"), near, model, 10, 0.95, 64) < 0.3 * len(model)


def test_cells_of_nothing_and_of_one(spark):
    held = spark.createDataFrame([(1, [1.0, 0.0])], "chunk_id long, v array<double>")
    asked = held.withColumnRenamed("chunk_id", "query_id")
    assert [(r.query_id, r.chunk_id, r.score) for r in cells.cell_search(asked, held).collect()] == [(1, 1, 1.0)]
    assert cells.cell_search(asked.limit(0), held).collect() == [] and cells.cell_search(asked, held.limit(0)).collect() == []
    with pytest.raises(ValueError):
        cells.cell_search(asked, spark.createDataFrame([(1, [1.0])], "chunk_id long, v array<double>"))
