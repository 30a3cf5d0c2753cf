"""Greedy clusters, similar sets and near-equal texts against plain loops."""

import random

from pyspark.sql import functions as F

from quarryloom.operators import similarity, templates


def plain_greedy(sets, threshold):
    own, common = [], []
    for s in map(set, sets):
        at = next((i for i, c in enumerate(common) if len(c & s) / len(c | s) >= threshold), None)
        if at is None:
            at = len(common)
            common.append(s)
        else:
            common[at] = common[at] & s or common[at]
        own.append(at)
    return own, [sorted(c) for c in common]


def test_clusters_equal_the_plain_loop():
    rng = random.Random(1)
    for _ in range(200):
        names = [f"t{i}" for i in range(rng.randint(3, 90))]
        sets = [sorted(rng.sample(names, rng.randint(1, min(25, len(names))))) for _ in range(rng.randint(1, 60))]
        threshold = rng.choice([0.01, 0.3, 0.5, 0.7, 0.8, 1.0])
        clusters = templates.Clusters(threshold, sets)
        assert ([clusters.add(s) for s in sets], clusters.common()) == plain_greedy(sets, threshold)


def test_similar_sets_compare_few_pairs_and_lose_none(spark):
    rng = random.Random(4)
    base = [[f"t{rng.randint(0, 400)}" for _ in range(20)] for _ in range(60)]
    sets = [("g" if i % 3 else "h", sorted({"html", "body", *(t for t in rng.choice(base) if rng.random() < 0.95)})) for i in range(400)] + [("g", []), ("g", ["html"]), ("g", ["html"])]
    frame = spark.createDataFrame(sets, "site string, tokens array<string>")
    for threshold in (0.5, 0.7, 0.9):
        distinct = sorted({(g, tuple(s)) for g, s in sets if s})
        want = {(g, frozenset([a, b])) for i, (g, a) in enumerate(distinct) for h, b in distinct[i + 1 :] if g == h and len(set(a) & set(b)) / len(set(a) | set(b)) >= threshold}
        got = similarity.similar_sets(frame, ["site"], "tokens", threshold).collect()
        assert {(r.site, frozenset([tuple(r.a), tuple(r.b)])) for r in got} == want and len(got) == len(want)
        pairs = sum(g == h for i, (g, _) in enumerate(distinct) for h, _ in distinct[i + 1 :])
        assert similarity.candidates(frame, ["site"], "tokens", threshold).count() < 0.2 * pairs


def test_sets_of_few_tokens_are_compared_by_blocks(spark, monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(similarity, "BLOCK", 16)
    monkeypatch.setattr(similarity, "SLICE", 7)
    names = [f"{c}{i}" for c in "abcde" for i in range(4)]
    sets = [(rng.choice("gh"), sorted(rng.sample(names, rng.randint(12, 20)))) for _ in range(120)] + [("g", ["a\1b"]), ("g", ["a", "b"]), ("g", []), (None, ["a0"]), ("only", ["a0"])]
    frame = spark.createDataFrame(sets, "site string, tokens array<string>").repartition(3)
    distinct = sorted({(g, tuple(s)) for g, s in sets if s and g})
    key = "\1".join
    want = {}
    for i, (g, a) in enumerate(distinct):
        for h, b in distinct[i + 1 :]:
            x = len(set(a) & set(b)) / len(set(a) | set(b))
            if g == h and x >= 0.7:
                want[(g, *sorted(map(key, (a, b))))] = x
    got = similarity.similar_sets(frame, ["site"], "tokens", 0.7).collect()
    assert {(r.site, key(r.a), key(r.b)): r.similarity for r in got} == want and len(got) == len(want) > 500
    named = similarity.similar_sets(frame, ["site"], "tokens", 0.7, lambda c: F.sha2(F.array_join(c, "\1"), 256))
    assert named._jdf.queryExecution().optimizedPlan().toString().count("sha2") <= 4  # once a set of blocks, not once a pair
    assert named.count() == len(want) and "FlatMapCoGroupsInArrow" in named._jdf.queryExecution().optimizedPlan().toString()


def test_near_equal_texts(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    texts = {}
    for i in range(40):
        own = [rng.choice(words) for _ in range(60)]
        texts[10 * i] = " ".join(own)
        if i % 2:
            texts[10 * i + 1] = " ".join(own[:-2])
            texts[10 * i + 2] = " ".join(own).upper() + " \n"
        if i % 5 == 0:
            texts[10 * i + 3] = " ".join(w for j, w in enumerate(own) if j % 4)
    texts |= {1000: None, 1001: "", 1002: " \t", 1003: "short", 1004: "Sh ort", 1005: "shore"}
    body = {k: "".join(t.split()).lower() for k, t in texts.items() if t and t.strip()}
    grams = {k: {b[i : i + 9] for i in range(max(1, len(b) - 8))} for k, b in body.items()}
    near = lambda a, b: len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.8
    of = {k: {j for j in body if near(k, j)} for k in body}
    want = {}
    for k in body:
        seen, todo = {k}, [k]
        while todo:
            new = of[todo.pop()] - seen
            seen |= new
            todo += new
        if len({body[j] for j in seen}) > 1:
            want[k] = (min(seen), k == min(j for j in body if body[j] == body[k]))
    docs = spark.createDataFrame([(k, t, "clash") for k, t in texts.items()] + [(None, texts[0], "clash")], "id long, text string, body string")
    got = {r.key: (r["class"], r.stands) for r in similarity.near_duplicates(docs, "id", "text").collect()}
    assert got == want and len(want) > 40
    assert similarity.near_duplicates(docs.limit(0), "id", "text").collect() == []


def test_long_chains_are_one_class(spark):
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.range(1000, 1010).select("id", F.lit(2000)))
    got = {r.key: r["class"] for r in similarity.connected(links).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{i: 1000 for i in [*range(1000, 1010), 2000]}}


def test_shingles_are_compared_truly_and_signatures_agree():
    rng = random.Random(7)
    plain = lambda t: {t[i : i + 9] for i in range(len(t) - 8)}
    for alphabet in ("ab", "abcdefghij ", [chr(i) for i in range(0x4E00, 0x5200)], [chr(i) for i in range(0x1F300, 0x1F3FF)] + ["a"]):
        for _ in range(20):
            a = "".join(rng.choice(alphabet) for _ in range(rng.randint(5, 300)))
            at = rng.randint(0, len(a))
            b = rng.choice([a[:at] + rng.choice(alphabet) + a[at:], a[at:] + a[:at], a[:8], a + a])
            x, y = similarity.shingles(a, b)
            assert (len(x), len(y), len(set(x.tolist()) & set(y.tolist()))) == (len(plain(a)), len(plain(b)), len(plain(a) & plain(b)))
            both = plain(a) | plain(b)
            assert similarity.near_equal(a, b, 0.8) == (bool(plain(a) and plain(b)) and len(plain(a) & plain(b)) >= 0.8 * len(both))
    shared = 0
    for _ in range(300):
        a = "".join(rng.choice("abcdefghijklmnop") for _ in range(900))
        b = a[:405] + "".join(rng.choice("qrst") for _ in range(90)) + a[495:]
        shared += bool(set(similarity.band_values(a, 20, 4).tolist()) & set(similarity.band_values(b, 20, 4).tolist()))
        assert not set(similarity.band_values(a, 20, 4).tolist()) & set(similarity.band_values(a[::-1], 20, 4).tolist())
    assert shared >= 299 and len(similarity.band_values("abcdefgh", 20, 4)) == 0  # a similarity of 0.8: a chance above 0.9999 each
