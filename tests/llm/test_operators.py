"""Every operator against brute force on small texts: nulls, empty and long texts, ties, repeats, empty tables."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

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
from quarryloom.llm import bpe
from quarryloom.llm.bpe import VectorBPE, encode_slice
from quarryloom.llm.common import buffer_of, slices

BYTES, WORDS = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
ODD = [
    None, "", " ", "\n", "it's they're we'll I'd 'shello ''s 's", "don't DON'T  'LL 've", "a<|endoftext|>b <|startoftext|>X", "x" * 400 + " " + "héllo" * 100,
    "ΣΑΣ İstanbul ½ 漢字 한글 ́é ٣1", "tab\tand　wide space", "!!!... --- '''", "the the the the", "the the the the", "😀 ok\r\n\r\n12345",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string"


def frame(spark, texts, first=0):
    rows = [(first + i, t, "en", "s", len(t or ""), 0.5, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def random_words(rng, n, vocabulary=300):
    return [f"w{i}" for i in rng.integers(0, vocabulary, n)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_bpe_equals_the_library(path):
    model, lib = VectorBPE.compile(path), Tokenizer.from_file(path)
    rng = np.random.default_rng(3)
    alphabet = list("abcdefstrvml  \n\t'''ABCÉéßΣσİ 123٣½—“…!!.. 　́漢한")
    texts = [t or "" for t in ODD] + ["".join(rng.choice(alphabet, rng.integers(0, 60))) for _ in range(400)]
    raw, off = buffer_of(pa.array(texts))
    got = []
    for i, j in slices(off, 2000):
        ids, first = encode_slice(model, raw[off[i] : off[j]], off[i : j + 1] - off[i])
        got += [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
    assert got == [lib.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("path", [BYTES, WORDS])
@pytest.mark.parametrize("form", ["a{}", "e{}\u0301", "{0}\u0345{0}b1"])
def test_every_code_point_is_read_as_the_library_reads_it(path, form):
    model, lib = VectorBPE.compile(path), Tokenizer.from_file(path)
    texts = [form.format(chr(c)) for c in [*range(0xD800), *range(0xE000, 0x32400), *range(0x32400, 0x110000, 997)]]
    raw, off = buffer_of(pa.array(texts))
    got = []
    for i, j in slices(off):
        own, at = raw[off[i] : off[j]], off[i : j + 1] - off[i]
        ids, first = encode_slice(model, own, at)
        got += [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
        if path == WORDS:
            assert tokens.cut_by_states(own, at).starts.tolist() == bpe.cut(own, at, False).starts.tolist()
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, a, b in zip(texts, got, want, strict=True) if a != b] == []


def test_token_counts_and_codec(spark):
    docs, lib = frame(spark, ODD), Tokenizer.from_file(WORDS)
    want = {i: lib.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(ODD)}
    for r in tokens.count_tokens(docs, WORDS, limit=20).collect():
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (len(want[r.doc_id]), len((ODD[r.doc_id] or "").encode()), len(want[r.doc_id]) > 20)
    for size in (0, 5, 1000):
        for r in codec.encode_decode(docs, WORDS, size, outputs=True).collect():
            ids = want[r.doc_id]
            assert r.ids == ids and r.decoded == lib.decode(ids, skip_special_tokens=False)
            assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_minimal_automaton_shares_suffixes():
    from quarryloom.llm.automaton import Automaton, minimal

    words = sorted({b"walking", b"talking", b"talk", b"walk", b"w", b"balking"})
    a = Automaton.map(minimal(words).pack())
    assert len(a.final) < 1 + sum(map(len, words)) / 2
    texts = [*words, b"wal", b"walkingx", b"zebra"]
    ends = np.cumsum([len(t) for t in texts])
    ok, number = a.walk(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], ends[:-1]]), ends)
    assert ok.tolist() == [True] * len(words) + [False] * 3 and number[: len(words)].tolist() == list(range(len(words)))


def test_packing_is_whole_and_dense(spark):
    rng = np.random.default_rng(1)
    texts = ODD + [" ".join(random_words(rng, n)) for n in rng.integers(0, 900, 60)]
    lib, window = Tokenizer.from_file(BYTES), 256
    rows = packing.pack(frame(spark, texts).coalesce(2), BYTES, window, with_ids=True).collect()
    fill, pieces = {}, {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0) and len(r.ids) == r.length
        fill[r.sequence_id] = r.offset + r.length
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.ids, r.doc_tokens))
    for i, t in enumerate(texts):
        own = sorted(pieces[i])
        assert sum((p[1] for p in own), []) == lib.encode(t or "", add_special_tokens=False).ids + [1]
        assert all(p[2] == sum(len(q[1]) for q in own) for p in own)
    assert max(fill.values()) <= window and sum(v < window for v in fill.values()) <= 2


def brute_repeats(texts, window):
    seen, out = {}, {}
    words = {i: (t or "").encode().split() for i, t in texts}
    for i, w in sorted(words.items()):
        for s in range(len(w) - window + 1):
            seen.setdefault(tuple(w[s : s + window]), i)
    for i, w in words.items():
        gone = set()
        for s in range(len(w) - window + 1):
            if seen[tuple(w[s : s + window])] < i:
                gone.update(range(s, s + window))
        out[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    return out


@pytest.mark.parametrize("hot", [0, 3, 1000])
def test_repeats_against_brute_force(spark, hot):
    rng = np.random.default_rng(5)
    passage = random_words(rng, 30)
    texts = [None, "", "one two", " ".join(["a"] * 40), " ".join(["a"] * 25)]
    for _ in range(40):
        w = random_words(rng, int(rng.integers(0, 60)))
        at = int(rng.integers(0, len(w) + 1))
        lo = int(rng.integers(0, 12))
        texts.append("\t".join(w[:at] + passage[lo : lo + int(rng.integers(5, 30))] + w[at:]))
    texts += texts[10:14]
    got = repeats.remove_repeats(frame(spark, texts), 12, 4, hot, carry=["kept", "text"]).collect()
    want = brute_repeats(list(enumerate(texts)), 12)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == want
    assert {r.carried.kept for r in got} == {"clash"} and any(v[1] for v in want.values())
    assert repeats.remove_repeats(frame(spark, []), 12, 4).count() == 0


def test_repeats_with_null_and_equal_ids(spark):
    text = " ".join(map(str, range(20)))
    rows = [(None, text), (3, text), (3, text), (7, text), (7, "x " + text)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 12, 4).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_removed) for r in got) == [(-1, 0), (3, 0), (3, 0), (7, 20), (7, 20)]


def test_alignment_against_dynamic_programming():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a = rng.integers(0, 6, rng.integers(0, 30)).tolist()
        b = rng.integers(0, 6, rng.integers(0, 30)).tolist()
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        best = table[-1][-1]
        assert near.matched(a, b, best) == best and near.matched(a, b, best + 1) is None


def brute_classes(texts, threshold):
    words = [(t or "").encode().split() for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = words[i], words[j]
            grams = lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
            if a == b or (grams(a) & grams(b) and near.matched(a, b, near.needed(len(a) + len(b), threshold)) is not None):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return [root(i) for i in range(len(texts))]


def test_near_duplicates_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    texts = [None, "", "  ", "one", "one", "a b c"]
    for _ in range(12):
        base = random_words(rng, int(rng.integers(30, 120)), 4000)
        texts.append(" ".join(base))
        for _ in range(int(rng.integers(0, 5))):
            w = list(base)
            for k in rng.integers(0, len(w), max(1, len(w) // 30)):
                w[k] = f"new{rng.integers(0, 10**6)}"
            texts.append(" ".join(w))
        texts.append(texts[-1].replace(" ", "\n"))
    got = {r.doc_id: r.class_id for r in near.near_classes(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts, 0.8)
    assert near.near_classes(frame(spark, [])).count() == 0


def test_near_duplicates_of_short_texts_against_all_pairs(spark):
    rng = np.random.default_rng(9)
    texts = []
    for n in [*range(1, 23)] * 3:
        base = random_words(rng, n, 60)
        texts.append(" ".join(base))
        for _ in range(3):
            w = list(base)
            for _ in range(int(rng.integers(1, 2 + n // 6))):
                at = int(rng.integers(0, len(w)))
                w[at : at + int(rng.integers(0, 2))] = [f"new{rng.integers(0, 10**6)}"] * int(rng.integers(0, 2))
                w = w or ["new"]
            texts.append(" ".join(w))
    texts += ["a b c d e f g h i j", "a b c d X f g h i j", "p q r s t", "p q r s t u", "k l m n o", "k l Y n o"]
    words, up = [t.split() for t in texts], list(range(len(texts)))
    for i in range(len(texts)):  # all pairs, whether or not they share a k-mer
        for j in range(i):
            if near.matched(words[i], words[j], near.needed(len(words[i]) + len(words[j]), 0.8)) is not None:
                x, y = sorted((up[i], up[j]))
                up = [x if u == y else u for u in up]
    got = {r.doc_id: r.class_id for r in near.near_classes(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == up


def test_near_duplicates_near_the_threshold(spark):
    rng = np.random.default_rng(10)
    texts, cases = [], [(n, share) for n in (30, 60, 150) for share in (0.1, 0.15, 0.2)] * 20
    for n, share in cases:
        base = random_words(rng, n, 10**6)
        w = list(base)
        for k in rng.permutation(n)[: round(n * share - 1e-9)]:
            w[k] = f"new{rng.integers(0, 10**9)}"
        texts += [" ".join(base), " ".join(w)]
    got = {r.doc_id: r.class_id for r in near.near_classes(frame(spark, texts)).collect()}
    for share in (0.1, 0.15, 0.2):
        found = [got[2 * i] == got[2 * i + 1] for i, c in enumerate(cases) if c[1] == share]
        assert sum(found) / len(found) >= 0.97, (share, sum(found), len(found))


def test_nearest_has_high_recall_and_exact_scores(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(0, 1, (400, 16))
    v[50:60] = v[49]
    rows = [(i, x.tolist(), i) for i, x in enumerate(v)] + [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [1.0], 0), (1004, [None] * 16, 0), (None, [1.0] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = nearest.nearest(df, nearest.F.col("vec_id") % 20 == 0, 10, rerank=100).collect()
    assert {r.query_id for r in got} == set(range(0, 400, 20))
    hit = 0
    for q in range(0, 400, 20):
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        s = v @ v[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(400), -s))[:10]
        hit += len({r.vec_id for r in own} & set(want.tolist()))
        assert [r["rank"] for r in own] == list(range(1, 11))
        assert all(abs(r.score - s[r.vec_id]) < 1e-9 for r in own)
    assert hit >= 0.9 * 200
    assert nearest.nearest(df.limit(0), nearest.F.col("vec_id") % 20 == 0).count() == 0
    assert nearest.nearest(df.where("vec_id < 3"), nearest.F.col("vec_id") == 0).count() == 2


def test_nearest_reranks_as_many_as_the_recall_takes(spark):
    rng = np.random.default_rng(14)
    v = rng.normal(0, 1, (6000, 48))  # no structure: estimates mean little
    v[100:400] = v[99]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    is_query = nearest.F.col("vec_id") % 60 == 0

    def recall(**how):
        of = {}
        for r in nearest.nearest(df, is_query, 20, sample=600, rerank=40, block=2000, **how).collect():
            of.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
        hit = 0
        for q in range(0, 6000, 60):
            s = v @ v[q]
            s[q] = -np.inf
            own = sorted(of[q])
            assert [r for r, _ in own] == list(range(1, 21))
            hit += len({i for _, i in own} & set(np.lexsort((np.arange(6000), -s))[:20].tolist()))
        return hit / 2000

    fixed, measured = recall(recall=0), recall(recall=0.95)
    assert fixed < 0.9 <= measured, (fixed, measured)


def test_quality_learns_and_scores_everything(spark):
    rng = np.random.default_rng(6)
    good = [" ".join(random_words(rng, 60, 5000)) + "." for _ in range(80)]
    bad = [" ".join(w + "***" for w in random_words(rng, 60, 20)) for _ in range(80)]
    docs = frame(spark, good + bad + [None, "", "x" * 5000])
    labels = spark.createDataFrame([(i, int(i < 80), 0) for i in range(160)] + [(None, 1, 0), (5, None, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert len(got) == 163 and all(0 <= s <= 1 for s in got.values())
    held = [i for i in range(160) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.3) == (i < 80) for i in held]) > 0.95
    none = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.keep(docs, quality.train(docs, labels)).columns == docs.columns


def test_language_backs_off_to_ngrams(spark):
    train = spark.createDataFrame([("the house and the garden", "en"), ("the walking and talking", "en"), ("das haus und der garten", "de"), ("die straße und das schiff", "de"), ("ignored", None)], "text string, lang string")
    model = language.fit(train)
    docs = frame(spark, ["the garden", "das haus", "gartenschiff", "housewalking", None, "", "123 !!", "THE GARDEN"])
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, model).collect()}
    assert [got[i][0] for i in range(8)] == ["en", "de", "de", "en", "und", "und", "und", "en"]
    assert all(0 <= s <= 1 for _, s in got.values()) and got[0] == got[7]
    assert {r.lang_pred for r in language.identify(docs, language.fit(train.limit(0))).collect()} == {"und"}
    assert language.keep(docs, model, 0.4).columns == docs.columns


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 9215, 9216, 9217, 27488, 100_000])
def test_transport_stream_round_trip(n):
    text = bytes(np.random.default_rng(n).integers(33, 127, n, dtype=np.uint8))
    payload = media.padded(text)
    stream = media.mux(payload)
    back, facts = media.demux(stream)
    assert back == payload and len(payload) % 192 == 0 and len(payload) >= max(192, n) and len(stream) % 188 == 0
    assert facts["stamps"] == sorted(facts["stamps"]) and facts["points"][0][0] == 0
    for at in (1, len(stream) // 376 * 188 + 3):  # a lost packet or a damaged header is found
        broken = bytearray(stream)
        broken[at] ^= 0x0F
        with pytest.raises(media.Broken):
            assert media.demux(bytes(broken))[0] != payload
            raise media.Broken("payload differs")


def test_media_column_of_odd_texts(spark):
    got = media.read(media.store(frame(spark, ODD))).collect()
    for r in got:
        t = (ODD[r.doc_id] or "").encode()
        assert bytes(r.payload) == media.padded(t) and r.problem is None and r.n_bytes == len(t)
    bad = spark.createDataFrame([(1, 2, bytearray(b"xx")), (2, 0, None)], "doc_id long, n_bytes long, media binary")
    assert {r.problem for r in media.read(bad).collect()} == {"not whole packets"}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">Menu item, one.</a><li><a>Two</a></ul></nav><!-- x <p>no</p> -->
<div class="cookie-notice"><p>We use cookies, really, and much more text about them than you would ever want to read.</p></div>
<div id="content"><article><h2>Head &amp; line</h2><p>First&nbsp;paragraph, with <b>bold</b> text.<br>And a second line. It goes on, and on.
<p>Second paragraph a &lt; b; it has, like all, punctuation. <div class="ad">Buy now, buy more, buy everything.</div><ul><li>point one, yes</li><li>point two</li></ul></article>
<section class="comments"><p>Reader says: nice, very nice, a long comment with, many, commas. And more.</p></section></div>
<aside><p>Related, stories, with text that is, of course, quite long too.</p></aside><form><label>Name</label><textarea>x</textarea></form><footer>&copy; 2024, all rights</footer></body></html>"""


def test_main_text_of_a_page(spark):
    want = "Head & line\nFirst paragraph, with bold text. And a second line. It goes on, and on.\nSecond paragraph a < b; it has, like all, punctuation.\npoint one, yes\npoint two"
    assert pages.main_text(PAGE) == want
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>only"), (5, "u", "plain, text"), (6, "u", "<div><p>cut off, here <a href='x"), (7, "u", PAGE)]
    got = {r.page_id: r for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i].text for i in (2, 3, 4, 5, 6)] == ["", "", "only", "plain, text", "cut off, here"]
    assert got[1].text == got[7].text and got[1].n_chars == len(want)


def test_main_text_without_article_and_with_telling_classes():
    intro = "The intro says, in short, what follows; it has 1 mark, or 2, too."
    body = [f"Body paragraph {i} goes on, with commas, for a while; it ends here. " * 2 for i in range(4)]
    clean = [" ".join(b.split()) for b in body]
    paragraphs = "".join(f"<p>{b}</p>" for b in body)
    page = f"<body><div class=menu><a>Home</a></div><h1>Title</h1><div class=intro><p>{intro}</p></div><h2>Part</h2><div class=body>{paragraphs}</div><div class=comments><p>I like it, a lot.</p></div></body>"
    assert pages.main_text(page) == "\n".join(["Title", intro, "Part", *clean])
    for tag, name in (("article", "post has-comments"), ("main", "content with-sidebar"), ("article", "comment"), ("div", "post has-comments"), ("div", "main sidebar-left")):
        assert pages.main_text(f"<body><{tag} class='{name}'>{paragraphs}</{tag}></body>") == "\n".join(clean), (tag, name)
    # comments longer than the article stay apart
    assert pages.main_text(f"<body><article><p>{clean[0]}</p></article><div id=comments>{paragraphs}</div></body>") == clean[0]
    assert pages.main_text("<article><p>So, <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> holds.</p></article>") == "So, x=1 holds."
