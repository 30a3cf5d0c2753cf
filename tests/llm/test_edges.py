"""Words that weak hashes take for one another, hot groups, repeated and null ids, empty tables, damaged streams, models by hand."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quarryloom.llm import bpe, common
from quarryloom.llm import op1_near_dedup as near
from quarryloom.llm import op2_substring_dedup as repeats
from quarryloom.llm import op3_packing as packing
from quarryloom.llm import op4_nearest as nearest
from quarryloom.llm import op5_quality as quality
from quarryloom.llm import op6_token_counts as tokens
from quarryloom.llm import op7_language_id as language
from quarryloom.llm import op8_media_columns as media
from quarryloom.llm import op9_bpe_codec as codec
from quarryloom.llm import op10_main_text as pages

from .test_operators import BYTES, ODD, WORDS, brute_repeats, frame, random_words


def thue_morse(x: str = "a", y: str = "b", doublings: int = 10) -> tuple[list[str], list[str]]:
    """Two sequences that polynomial hashes modulo a power of two can't tell apart."""
    a, b = [x], [y]
    for _ in range(doublings):
        a, b = a + b, b + a
    return a, b


TWINS = ["".join(t) for t in thue_morse()]


@pytest.mark.parametrize("path", [BYTES, WORDS])
@pytest.mark.parametrize("weak", [False, True])
def test_words_with_equal_hashes_stay_apart(path, weak, monkeypatch):
    if weak:  # nearly all hashes meet
        monkeypatch.setattr(bpe, "key_hashes", lambda low, high: (low ^ high) & np.uint64(7))
    model, lib = bpe.VectorBPE.compile(path), Tokenizer.from_file(path)
    rng = np.random.default_rng(0)
    texts = [*TWINS, *["".join(rng.choice(["a", "b"], int(2 ** rng.uniform(0, 12)))) for _ in range(200 if weak else 1500)]]
    raw, off = common.buffer_of(pa.array(texts))
    got = []
    for i, j in common.slices(off, 20_000):
        ids, first = bpe.encode_slice(model, raw[off[i] : off[j]], off[i : j + 1] - off[i])
        got += [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
    assert got == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_operators_on_twin_words(spark):
    docs, lib = frame(spark, TWINS), Tokenizer.from_file(WORDS)
    want = [lib.encode(t, add_special_tokens=False).ids for t in TWINS]
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs, WORDS).collect()} == {i: len(x) for i, x in enumerate(want)}
    assert {r.doc_id: r.ids for r in codec.encode_decode(docs, WORDS, 1, outputs=True).collect()} == dict(enumerate(want))
    own, pieces = Tokenizer.from_file(BYTES), defaultdict(list)
    for r in sorted(packing.pack(docs, BYTES, 256, with_ids=True).collect(), key=lambda r: r.start):
        pieces[r.doc_id] += r.ids
    assert dict(pieces) == {i: own.encode(t, add_special_tokens=False).ids + [1] for i, t in enumerate(TWINS)}


def test_lexicon_is_bounded_and_frequent(spark):
    rows = [(f"w{i}".encode(), n) for i, n in enumerate([100, 90, 50, 50, 50, 3, 3, 1, 1, 1])]
    counts = spark.createDataFrame(rows, "word binary, n long")
    for size in range(12):
        got = {bytes(r.word) for r in codec.frequent(counts, size).collect()}
        assert len(got) <= size and all(n >= max([m for w, m in rows if w not in got], default=0) for w, n in rows if w in got)


def test_repeats_of_twin_sequences_and_hot_windows(spark):
    a, b = (" ".join(t) for t in thue_morse("left", "right"))
    rng = np.random.default_rng(3)
    passage = random_words(rng, 20)
    texts = [a, b, *[" ".join(random_words(rng, 6, 10**6) + passage + random_words(rng, 6, 10**6)) for _ in range(40)]]
    for hot in (0, 5, 1000):
        got = repeats.remove_repeats(frame(spark, texts), 12, 4, hot).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == brute_repeats(list(enumerate(texts)), 12)


def test_repeats_look_at_equal_hot_strings_once(spark, monkeypatch):
    """Copies of a text make no windows of their own; what they lose stays the same."""
    rng = np.random.default_rng(16)
    text, part = random_words(rng, 60, 10**6), random_words(rng, 6, 10**6)
    texts = [" ".join(text)] * 30 + [" ".join(text[:30] + part)] + [" ".join(part + text[20:])] + [" ".join(text)] * 10
    seen, by_window = [], repeats.ranges_by_window

    def counted(strings, window):
        seen.append(strings.count())
        return by_window(strings, window)

    monkeypatch.setattr(repeats, "ranges_by_window", counted)
    got = repeats.remove_repeats(frame(spark, texts), 12, 4, 5).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == brute_repeats(list(enumerate(texts)), 12)
    assert 0 < seen[0] <= 3 * 60


def classes_of(df):
    return {(r.doc_id, r.version): r.class_id for r in df.collect()}


def test_near_duplicates_with_one_common_passage(spark):
    """Texts that share a passage and nothing else stay apart, near copies among them are found, pairs stay few."""
    rng = np.random.default_rng(12)
    passage = random_words(rng, 40, 10**6)
    texts = [" ".join(random_words(rng, 20, 10**6) + passage + random_words(rng, 30, 10**6)) for _ in range(400)]
    for i in range(0, 100, 5):
        w = texts[i].split()
        w[::12] = [f"new{k}" for k in range(len(w[::12]))]
        texts.append(" ".join(w))
    calls, aligned = [], near.aligned

    def counted(pairs, docs, least):
        calls.append(pairs.count())
        return aligned(pairs, docs, least)

    near.aligned = counted
    try:
        got = {r.doc_id: r.class_id for r in near.near_classes(frame(spark, texts)).collect()}
    finally:
        near.aligned = aligned
    assert [got[i] for i in range(400)] == list(range(400))
    assert sum(got[400 + k] == 5 * k for k in range(20)) >= 19
    assert sum(calls) <= 48 * len(texts)


def test_near_duplicates_when_all_buckets_are_large(spark):
    """With buckets split from two members on, short texts lose no link and long ones next to none."""
    rng = np.random.default_rng(13)
    texts = []
    for n in [*range(2, 16)] * 3 + [40] * 20:
        base = random_words(rng, n, 12 if n < 16 else 10**6)
        texts.append(" ".join(base))
        for _ in range(3):
            w = list(base)
            w[int(rng.integers(0, n))] = f"new{rng.integers(0, 9)}"
            texts.append(" ".join(w))
    words, up = [t.split() for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if near.matched(words[i], words[j], near.needed(len(words[i]) + len(words[j]), 0.8)) is not None:
                x, y = sorted((up[i], up[j]))
                up = [x if u == y else u for u in up]
    got = {r.doc_id: r.class_id for r in near.near_classes(frame(spark, texts), together=1).collect()}
    assert [got[i] for i in range(len(texts))] == up


def test_near_duplicates_in_large_buckets_lose_no_pair(spark, monkeypatch):
    """Every pair that agrees in any sketch is compared, however many texts share that sketch."""
    rng = np.random.default_rng(15)
    passage, texts = random_words(rng, 40, 10**6), []
    for _ in range(60):
        own = random_words(rng, 20, 10**6)
        texts.append(" ".join(own + passage))
        w = own + passage
        for k in rng.permutation(20)[:11]:
            w[k] = f"new{rng.integers(0, 10**9)}"
        texts.append(" ".join(w))
    words, up = [t.split() for t in texts], list(range(len(texts)))
    agree = {r.doc_id: np.array(r.sketches) for r in near.sketch(frame(spark, texts).selectExpr("doc_id", "xxhash64(text) as version", "text")).collect()}
    for i in range(len(texts)):
        for j in range(i):
            if (agree[i] == agree[j]).any() and near.matched(words[i], words[j], near.needed(len(words[i]) + len(words[j]), 0.8)) is not None:
                x, y = sorted((up[i], up[j]))
                up = [x if u == y else u for u in up]
    assert 0 < sum(u != i for i, u in enumerate(up)) <= 70
    for block in (512, 16):
        monkeypatch.setattr(near, "BLOCK", block, raising=False)
        got = {r.doc_id: r.class_id for r in near.near_classes(frame(spark, texts), together=2).collect()}
        assert [got[i] for i in range(len(texts))] == up


def rows_of_joins(spark, since: int) -> int:
    """Rows that joins have made in the executions from number ``since`` on."""
    store, total = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    for run in (runs.apply(i).executionId() for i in range(int(since), runs.size())):
        plan, values = store.planGraph(run).allNodes(), store.executionMetrics(run)
        for node in (plan.apply(i) for i in range(plan.size())):
            metrics = [node.metrics().apply(i) for i in range(node.metrics().size())] if "Join" in node.name() else []
            found = [values.get(m.accumulatorId()) for m in metrics if m.name() == "number of output rows"]
            total += sum(int(v.get().replace(",", "")) for v in found if v.isDefined())
    return total


def test_near_duplicates_fetch_a_node_of_large_buckets_once(spark, monkeypatch):
    """Twice the members of a bucket make about twice the rows in joins, however many blocks they are dealt out to."""
    monkeypatch.setattr(near, "BLOCK", 4)
    rng = np.random.default_rng(16)
    passage, made = random_words(rng, 60, 10**6), []
    for n in (40, 80):
        texts = [" ".join(random_words(rng, 30, 10**6) + passage) for _ in range(n)]
        rows = spark.createDataFrame([(i, i) for i in range(n)], "node long, class long").withColumn("key", near.F.lit(7)).withColumn("last", near.F.lit(-1))
        docs = frame(spark, texts).selectExpr("doc_id", "xxhash64(text) as version", "text")
        nodes = near.sketch(docs).withColumn("node", near.F.col("doc_id"))
        before = spark._jsparkSession.sharedState().statusStore().executionsList().size()
        assert near.within_blocks(rows, nodes, docs, 0.8).collect() == []
        made.append(rows_of_joins(spark, before))
    assert 0 < made[1] <= 2.5 * made[0], made


def test_near_duplicates_of_odd_rows(spark):
    rng = np.random.default_rng(14)
    t, u = (" ".join(random_words(rng, 60, 10**6)) for _ in range(2))
    twins = [" ".join(x) for x in thue_morse("left", "right")]
    long = " ".join(random_words(rng, 30_000, 10**6))
    rows = [(5, t), (5, u), (6, t + " more"), (7, u + " more"), (7, u + " more"), (None, t), (None, "alone here"), (None, None), (8, ""), (20, twins[0]), (21, twins[1] + " " + " ".join(["x"] * 2000)), (30, long), (31, long + " end"), (32, long[: len(long) // 2])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = defaultdict(set)
    for r in near.near_classes(df).collect():
        got[r.doc_id].add(r.class_id)
    assert got[5] == {5} and got[6] == {5} and got[7] == {5} and got[None] == {5, None, 8} and got[8] == {8}
    assert (got[20], got[21], got[30], got[31], got[32]) == ({20}, {21}, {30}, {30}, {32})
    # rows of one id count each by its text: 6 and 7 are in two classes though both are 5's
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame([(1, t), (2, t), (2, u)], "doc_id long, text string"), "").collect()
    assert {(r.doc_id, r.text) for r in kept} == {(1, t), (2, u)}


def test_backoff_against_dictionaries(spark):
    rng = np.random.default_rng(15)
    stems = {"en": ["walk", "talk", "house", "garden"], "de": ["haus", "garten", "straße", "schiff"], "fr": ["jardin", "maison", "éçole", "rue"]}
    rows = [(" ".join(rng.choice(own, 12)) + (" fin" if lang == "fr" else ""), lang) for lang, own in stems.items() for _ in range(5)] + [("none", None), (None, "en")]
    train = spark.createDataFrame(rows, "text string, lang string")
    langs, words = sorted(stems), defaultdict(Counter)
    for text, lang in rows:
        for w in (text or "").split() if lang else []:
            words[w][lang] += 1
    grams = [defaultdict(Counter) for _ in range(6)]
    for w, n in words.items():
        m = f" {w} "
        for size in range(1, 6):
            for i in range(len(m) - size + 1):
                if m[i : i + size] != " ":
                    grams[size][m[i : i + size]].update(n)

    def log(counts, key):
        total = Counter()
        for c in counts.values():
            total.update(c)
        return np.array([np.log((counts[key][x] + 0.5) / (total[x] + 0.5 * (len(counts) + 1))) for x in langs])

    def score(word):
        if word in words:
            return log(words, word)
        m = f" {word} "
        for size in range(5, 0, -1):
            known = [log(grams[size], m[i : i + size]) for i in range(len(m) - size + 1) if m[i : i + size] in grams[size]]
            if known:
                return np.mean(known, 0)
        return np.zeros(len(langs))

    texts = ["walking gartenhaus", "HOUSE", "rues et jardins", "xyz", "ßß", "zzz qqq walk", "haus garten walk", "漢字", "éçoles", "1 2 3", None]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(frame(spark, texts), language.fit(train)).collect()}
    for i, t in enumerate(texts):
        own = [w for w in (t or "").lower().split() if w.isalpha()]
        if not own:
            assert got[i] == ("und", 0.0)
            continue
        total = sum(score(w) for w in own) * min(len(own), language.EVIDENCE) / len(own)
        p = np.exp(total - total.max())
        p /= p.sum()
        assert got[i][0] == langs[int(p.argmax())] and abs(got[i][1] - p.max()) < 1e-5, (t, got[i], p)


def test_language_sample_is_bounded(spark):
    rows = [(f"word{i} text", "en", i) for i in range(4000)] + [("mot rare", "fr", 9000 + i) for i in range(7)]
    got = Counter(r.lang for r in language.sampled(spark.createDataFrame(rows, "text string, lang string, doc_id long"), 500).collect())
    assert got["fr"] == 7 and 400 < got["en"] < 600


def test_isotonic_never_falls():
    rng = np.random.default_rng(16)
    for _ in range(300):
        n = rng.integers(1, 1000, int(rng.integers(1, 30)))
        y = np.array([rng.integers(0, k + 1) for k in n])
        x, p = quality.isotonic(np.arange(len(n)) / len(n), y, n)
        assert (np.diff(x) > 0).all() and (np.diff(p) >= 0).all() and (p > 0).all() and (p < 1).all()
    x, p = quality.isotonic(np.array([0.1, 0.5, 0.9]), np.array([100, 990, 1]), np.array([1000, 1000, 1]))
    assert p[0] < p[1] < p[2]


def test_quality_against_plain_ridge(spark):
    rng = np.random.default_rng(17)
    texts = [" ".join(random_words(rng, int(rng.integers(5, 80)), 500)) + ("." if i % 2 else "!!!") for i in range(120)]
    labels = [int(i % 2 or i % 5 == 0) for i in range(120)]
    train = spark.createDataFrame(list(zip(texts, map(float, labels), strict=True)), "text string, label double")
    model = quality.fit(train)
    raw, off = common.buffer_of(pa.array(texts))
    x = quality.statistics(raw, off)
    kernel = quality.Kernel(x.mean(0), x.std(0))
    z = np.clip((x - kernel.mean) / kernel.std, -6, 6)
    phi = np.array([[np.sqrt(2 / 256) * np.cos(sum(a * b for a, b in zip(row, kernel.w[:, j], strict=True)) + kernel.b[j]) for j in range(256)] + [1.0] for row in z])
    ridge = np.eye(257) * quality.RIDGE
    ridge[-1, -1] = 1e-6
    weights = np.linalg.solve(phi.T @ phi + ridge, phi.T @ np.array(labels, float))
    assert np.allclose(model.raw(x), phi @ weights, atol=1e-6)
    assert (np.diff(model.score(x)[np.argsort(model.raw(x))]) >= 0).all()
    # all rows of one label are copies of one text, and fall into one half
    copies = spark.createDataFrame([("bad *** " * 9, 0.0)] * 20 + [(" ".join(random_words(rng, 40, 500)), 1.0) for _ in range(40)], "text string, label double")
    own = quality.fit(copies)
    scored = {r.doc_id: r.score for r in quality.score(frame(spark, ["bad *** " * 9, " ".join(random_words(rng, 40, 500))]), own).collect()}
    assert scored[0] < 0.3 < scored[1]


def test_damaged_streams_are_reported():
    payload = media.padded(b"some text " * 40)
    stream = media.mux(payload)
    for at in range(len(stream)):
        for flip in (0x01, 0x80, 0xFF):
            damaged = bytearray(stream)
            damaged[at] ^= flip
            try:
                media.demux(bytes(damaged))
            except media.Broken:
                pass
    empty = media.table_packet(media.PAT_PID, media.section(0, 1, b""))
    for data in (empty.tobytes(), bytes([0x47, 0x40, 0, 0x10, 250]).ljust(188, b"\xff"), b"G" * 188, b""):
        with pytest.raises(media.Broken):
            media.demux(data)


def test_media_digests(spark):
    got = {r.doc_id: r for r in media.read(media.store(frame(spark, ODD)), digests_only=True).collect()}
    for i, t in enumerate(ODD):
        payload = media.padded((t or "").encode())
        stream, r = media.mux(payload), got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(stream), hashlib.sha256(stream).hexdigest()) and "program=1" in r.feature


def test_nearest_by_codes_alone(spark):
    """What is reranked is a twentieth of the table, over clustered vectors."""
    rng = np.random.default_rng(18)
    centres = rng.normal(0, 1, (50, 32))
    v = centres[rng.integers(0, 50, 8000)] + rng.normal(0, 0.35, (8000, 32))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in nearest.nearest(df, nearest.F.col("vec_id") % 100 == 0, 20, rerank=400).collect():
        got[r.query_id].add(r.vec_id)
    hit = 0
    for q in range(0, 8000, 100):
        s = v @ v[q]
        s[q] = -np.inf
        hit += len(got[q] & set(np.argsort(-s, kind="stable")[:20].tolist()))
    assert len(got) == 80 and hit >= 0.9 * 1600, hit


def test_empty_tables(spark):
    none = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    html = spark.createDataFrame([], "page_id long, url string, html string")
    for out in (
        near.near_classes(none), repeats.remove_repeats(none), packing.pack(none, BYTES), quality.score(none, quality.train(none, labels)), tokens.count_tokens(none, WORDS),
        language.identify(none, language.fit(language.training_rows(none))), media.read(media.store(none), digests_only=True), codec.encode_decode(none, WORDS), pages.extract(html),
    ):
        assert out.count() == 0


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Null and repeated ids, columns with a dot, an empty table."""
    rng = np.random.default_rng(19)
    text = " ".join(random_words(rng, 80, 5000))
    rows = [(1, text, "en", "x"), (None, text, "en", "y"), (1, text, "en", "x"), (2, None, None, "z"), (3, text + " tail", "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, `a.b` string").withColumn("n_chars", near.F.length("text").cast("long"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, docs.limit(0)):
        out = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, str(tmp_path)).checkpoint()
            assert out.columns == docs.columns
        last = corpus_pipeline.STAGES[-1][1](spark, out, str(tmp_path))
        assert (last.count() > 0) == (table is docs)
        if table is docs:
            assert sorted((r.doc_id or 0, (r.text or "")[-4:]) for r in out.collect()) == [(1, text[-4:])]
