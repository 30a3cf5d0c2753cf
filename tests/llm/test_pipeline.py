"""The pipeline's stages: each takes what the one before kept; the end is whole."""

import numpy as np
import pyarrow.parquet as pq
import pyarrow as pa

import corpus_pipeline
from quarryloom.llm import op1_near_dedup as near

from .test_edges import rows_of_joins
from .test_operators import frame, random_words


def test_stages_on_a_small_corpus(spark, tmp_path):
    rng = np.random.default_rng(1)
    words = lambda n: " ".join(f"word{i}" for i in rng.integers(0, 4000, n))
    passage = words(60)
    good = [words(80) + "." for _ in range(60)]
    texts = good + ["*** " * 40 for _ in range(30)] + [good[0], good[1] + " more"] + [words(40) + " " + passage, words(50) + " " + passage, None]
    rows = {"doc_id": list(range(len(texts))), "text": texts, "lang": ["en"] * len(texts), "source": ["s"] * len(texts), "n_chars": [len(t or "") for t in texts]}
    pq.write_table(pa.table(rows), tmp_path / "documents.parquet")
    labels = {"doc_id": list(range(90)), "quality": [1] * 60 + [0] * 30, "toxic": [0] * 90}
    pq.write_table(pa.table(labels), tmp_path / "labels.parquet")
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).checkpoint()
        kept[name] = docs
        if name != "packing":
            assert docs.columns == columns
    ids = lambda n: {r.doc_id for r in kept[n].collect()}
    assert not ids("quality_classifier") & set(range(60, 90)) and set(range(60)) <= ids("quality_classifier")
    assert set(range(60)) <= ids("language_id") and 94 not in ids("language_id")
    assert ids("near_dedup") == ids("language_id") - {90, 91}
    last = {r.doc_id: r.text for r in kept["substring_dedup"].collect()}
    assert passage in last[92] and passage not in last[93] and last[5] == good[5]
    assert {r.doc_id for r in kept["packing"].collect()} == set(last)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in whole.collect()} == set(last)


def test_near_duplicates_of_large_buckets_join_in_proportion(spark, monkeypatch):
    """The stage keeps texts that share a passage only, and twice of them make about twice the rows in its joins."""
    monkeypatch.setattr(near, "BLOCK", 4)
    rng = np.random.default_rng(17)
    passage, made = random_words(rng, 60, 10**6), []
    for n in (40, 80):
        docs = frame(spark, [" ".join(random_words(rng, 20, 10**6) + passage) for _ in range(n)])
        before = spark._jsparkSession.sharedState().statusStore().executionsList().size()
        assert corpus_pipeline.near_duplicates(spark, docs, "").count() == n
        made.append(rows_of_joins(spark, before))
    assert 0 < made[1] <= 2.6 * made[0], made
