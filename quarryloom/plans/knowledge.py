"""Queries over documents, embeddings, conversations and events: corpus, retrieval, answers, stores, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import answers, cells, corpus, postings, retrieval, similarity
from ..session import checkpoint_ready, shared_folder
from ..sources import pages as sources
from ..sources import stores
from ..streaming import jobs
from .catalog import query, table

NUMBERED = "case when doc_id % 6 = 0 then ' 闽教学〔2024〕' || doc_id || '号' else '' end"
DOCS = f"docs as (select lang as kb_id, doc_id, source as type, text || {NUMBERED} as text, doc_id % 4 = 0 as scanned, doc_id % 5 as tables from documents)"


def documents(spark, sf):
    d = table(spark, sf, "documents")
    number = F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit(" 闽教学〔2024〕"), F.col("doc_id").cast("string"), F.lit("号"))).otherwise("")
    return d.select(F.col("lang").alias("kb_id"), "doc_id", F.col("source").alias("type"), F.concat("text", number).alias("text"), (F.col("doc_id") % 4 == 0).alias("scanned"), (F.col("doc_id") % 5).alias("tables"))


# --- sources and stores ---


@query("src_pages", "select event_id as url, 'HTTP ' || (400 + event_id % 120) as reason from events where event_type = 'error'")
def _(spark, sf):
    e = table(spark, sf, "events")
    _, failed = sources.split_outcomes(e.select(F.col("event_id").alias("url"), F.when(F.col("event_type") == "error", (400 + F.col("event_id") % 120)).otherwise(200).alias("status")))
    return failed


@query("src_decode", "select doc_id, sha256(text) as digest from documents where text is not null")
def _(spark, sf):
    d = table(spark, sf, "documents").where("text is not null")
    # a third as Latin-1 where that can hold the text, a third with a stated charset, a third by its header
    kind = F.when((F.col("doc_id") % 3 == 1) & F.col("text").rlike(r"^[\x00-\xff]*\z"), 1).when(F.col("doc_id") % 3 == 2, 2).otherwise(0)
    meta = F.when(kind == 0, "<meta charset=utf-8>").when(kind == 1, "<meta charset='iso-8859-1'>").otherwise("")
    body = F.concat(F.encode(meta, "UTF-8"), F.when(kind == 1, F.encode(F.when(kind == 1, F.col("text")), "ISO-8859-1")).otherwise(F.encode("text", "UTF-8")))
    own = d.select("doc_id", F.length(meta).alias("n"), sources.decode_html(body, F.when(kind == 2, "utf-8")).alias("t"))
    return own.select("doc_id", F.sha2(F.expr("substring(t, n + 1)"), 256).alias("digest"))


@query("src_sniff", "select doc_id, case doc_id % 5 when 0 then 'pdf' when 1 then 'html' when 2 then 'ole' when 3 then 'docx' else 'text' end as type from documents")
def _(spark, sf):
    d, k = table(spark, sf, "documents"), F.col("doc_id") % 5
    content = F.when(k == 0, F.concat(F.unhex(F.lit("255044462D312E37")), F.encode("text", "UTF-8"))).when(k == 1, F.encode(F.concat(F.lit("<!DOCTYPE html><p>"), "text"), "UTF-8")).when(k == 2, F.concat(F.unhex(F.lit("D0CF11E0A1B11AE1")), F.encode("text", "UTF-8"))).when(k == 3, F.concat(F.unhex(F.lit("504B0304")), F.encode("text", "UTF-8"), F.encode(F.lit("word/document.xml"), "UTF-8"))).otherwise(F.encode(F.concat(F.lit("x"), "text"), "UTF-8"))
    return d.select("doc_id", sources.sniff_type(content).alias("type"))


@query("src_folder")
def _(spark, sf):
    files = sources.read_folder(spark, sf, include=[r"(pages|labels)\.parquet"], exclude=["_SUCCESS"])
    return files.select("path", "bytes", sources.sniff_type(F.col("content")).alias("type"))


UNIFIED = "select 'kb' as kb_id, url as source, 'web' as source_kind, sha256(html) as content_hash from pages union all select 'kb', 'docs/' || doc_id || '.txt', 'file', sha256(text) from documents"


def unified(spark, sf):
    pages = table(spark, sf, "pages").select("url", F.col("html").alias("text"))
    files = table(spark, sf, "documents").select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    return sources.unify_documents(pages, files, "kb").select("kb_id", "source", "source_kind", "content_hash")


@query("src_unify", UNIFIED)
def _(spark, sf):
    return unified(spark, sf)


@query("set_union", f"select source_kind, count(*) as n from ({UNIFIED}) group by source_kind")
def _(spark, sf):
    return unified(spark, sf).groupBy("source_kind").agg(F.count("*").alias("n"))


def scratch(spark) -> str:
    """A new folder in the place that the cluster shares."""
    return f"{shared_folder(spark).rstrip('/')}/quarryloom-{uuid.uuid4().hex}"


@query("snk_version", "select doc_id, lang from documents where lang <> 'en'")
def _(spark, sf):
    root, d = scratch(spark), table(spark, sf, "documents").select("doc_id", "lang")
    stores.publish_version(d.where("lang = 'en'"), root, "v1")
    stores.publish_version(d.where("lang <> 'en'"), root, "v2")
    return stores.read_current(spark, root)


@query("snk_kb", "select doc_id, lang as kb_id from documents where lang = 'de'")
def _(spark, sf):
    root = scratch(spark)
    stores.write_kb(table(spark, sf, "documents").select("doc_id", F.col("lang").alias("kb_id")), root)
    return stores.read_kb(spark, root, "de").select("doc_id", "kb_id")


@query("kb_ids", "select doc_id, regexp_full_match(k, '[A-Za-z0-9][A-Za-z0-9_-]*') and length(k) <= 64 as ok from (select doc_id, case when doc_id % 3 = 0 then source || '_' || lang when doc_id % 3 = 1 then left(text, 12) else repeat(source, 20) end as k from documents)")
def _(spark, sf):
    d = table(spark, sf, "documents")
    k = F.when(F.col("doc_id") % 3 == 0, F.concat_ws("_", "source", "lang")).when(F.col("doc_id") % 3 == 1, F.substring("text", 1, 12)).otherwise(F.repeat("source", F.lit(20)))
    return d.select("doc_id", stores.valid_kb_id(k).alias("ok"))


@query("snk_draft", "select doc_id from documents where doc_id % 2 = 0")
def _(spark, sf):
    root, d = scratch(spark), table(spark, sf, "documents").select("doc_id")
    stores.write_drafts(d.where("doc_id % 2 = 1"), f"{root}/draft")
    return spark.read.parquet(stores.write_drafts(d.where("doc_id % 2 = 0"), f"{root}/draft"))


# --- documents ---


@query("flt_short_body", "select doc_id, case when length(trim(text)) < 50 then 'extraction_failed' else 'ok' end as status from documents")
def _(spark, sf):
    return corpus.mark_short_bodies(table(spark, sf, "documents")).select("doc_id", "status")


@query("flt_table_flags", "select doc_id, (doc_id % 5)::int as tables, doc_id % 5 >= 3 as table_dense from documents")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat("text", F.expr("repeat('\\n\\n| a | b |\\n| --- | --- |\\n| c | d |', int(doc_id % 5))")).alias("markdown"))
    return corpus.table_flags(d).select("doc_id", "tables", "table_dense")


#: the test pages in Markdown: without head, navigation and footer, cut at blocks, a heading marked, tags taken out
MARKDOWN = """
with cut as (select page_id, string_split_regex(replace(regexp_replace(html, '<head>.*?</head>|<nav>.*?</nav>|<footer>.*?</footer>|<!--.*?-->|<!DOCTYPE html>', '', 'gs'), '<h1>', '<p>' || chr(1)), '</?(?:p|br|h1|div|article|body|html)(?: [^>]*)?>') as parts from pages),
blocks as (select page_id, list_filter(list_transform(parts, lambda x: trim(regexp_replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g'))), lambda x: x <> '') as b from cut)
select page_id, sha256(replace(array_to_string(b, chr(10) || chr(10)), chr(1), '# ')) as digest, 0 as tables, false as flat from blocks"""


@query("md_convert", MARKDOWN)
def _(spark, sf):
    own = corpus.to_markdown(table(spark, sf, "pages"), ["page_id"])
    return own.select("page_id", F.sha2("markdown", 256).alias("digest"), "tables", "flat")


@query("md_chunk")
def _(spark, sf):
    own = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("markdown"))
    return corpus.chunk_documents(own, "doc_id")


@query("chunk_meta")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", F.array("source").alias("attachments"), F.col("text").alias("markdown"))
    return corpus.with_metadata(corpus.chunk_documents(d, "doc_id"), d, "doc_id").select("doc_id", "chunk_no", "lang", "source", "attachments")


@query("chunk_meta_docs", "select doc_id, lang, source, source as attachments, 0 as first from documents where trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def _(spark, sf):
    """What the chunks of each document say about it: one set of metadata, and numbers from 0 without a gap."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", F.array("source").alias("attachments"), F.col("text").alias("markdown"))
    own = corpus.with_metadata(corpus.chunk_documents(d, "doc_id"), d, "doc_id")
    each = own.groupBy("doc_id", "lang", "source", F.array_join("attachments", ",").alias("attachments")).agg(F.min("chunk_no").alias("first"), F.max("chunk_no").alias("last"), F.count("*").alias("n"))
    return each.where("last - first + 1 = n").select("doc_id", "lang", "source", "attachments", F.col("first").cast("int").alias("first"))


# --- profile ---

KEY = "sha256(regexp_replace(lower(text), '[0-9\\s 　]+', '', 'g'))"
NUMBER = "([一-鿿]{1,8}[〔\\[（(][0-9]{4}[〕\\]）)][0-9]+号|[A-Z]{2,}-?[0-9]{2,})"


@query("prof_types", f"with {DOCS} select kb_id, type, count(*) as n, round(count(*) / sum(count(*)) over (partition by kb_id), 6)::double as share from docs group by kb_id, type")
def _(spark, sf):
    return corpus.type_distribution(documents(spark, sf)).select("kb_id", "type", "n", F.round("share", 6).alias("share"))


@query("prof_lengths", f"with {DOCS} select kb_id, min(length(text))::int as least, quantile_cont(length(text), 0.25)::double as q25, quantile_cont(length(text), 0.5)::double as q50, quantile_cont(length(text), 0.75)::double as q75, max(length(text))::int as most from docs group by kb_id")
def _(spark, sf):
    return corpus.length_distribution(documents(spark, sf))


@query("prof_histogram", f"with {DOCS} select kb_id, least(length(text) // 1000 + 1, 11)::bigint as bucket, count(*) as n from docs group by all")
def _(spark, sf):
    return corpus.length_histogram(documents(spark, sf))


@query("prof_duplicates", f"with {DOCS} select kb_id, {KEY} as key, count(*) as n, min(doc_id) as first from docs group by all having count(*) > 1")
def _(spark, sf):
    return corpus.duplicate_groups(documents(spark, sf))


#: all pairs of texts of near sizes, by the very shingles; classes by the least document that is reached
NEAR = """
own as (select doc_id, lower(regexp_replace(text, '\\s+', '', 'g')) as body from documents where regexp_replace(text, '\\s+', '', 'g') <> ''),
texts as (select min(doc_id) as id, body, list_distinct(list_transform(range(1, greatest(2, length(body) - 7)), lambda i: substr(body, i, 9))) as s from own group by body),
links as (
  select a, b from (
    select a.id as a, b.id as b, len(a.s) as x, len(b.s) as y, len(list_intersect(a.s, b.s)) as c from texts a join texts b on a.id < b.id and len(a.s) >= 0.8 * len(b.s) and len(b.s) >= 0.8 * len(a.s)
  ) where c >= 0.8 * (x + y - c)
),
ways as (select a, b from links union all select b, a from links),
reach(id, class) as (select distinct a, a from ways union select b, class from reach join ways on a = id where class < b)"""


@query("prof_near_duplicates", f"with recursive {NEAR} select doc_id, class, doc_id = id as stands from own join texts using (body) join (select id, min(class) as class from reach group by id) using (id)")
def _(spark, sf):
    checkpoint_ready(spark)
    return similarity.near_duplicates(table(spark, sf, "documents"), "doc_id", "text").select(F.col("key").alias("doc_id"), "class", "stands")


@query("prof_docnum", f"with {DOCS}, n as (select kb_id, regexp_extract_all(text, '{NUMBER}', 1) as f from docs), s as (select kb_id, list_sort(list_distinct(flatten(list(f))))[1:3] as samples from n group by kb_id) select kb_id, count(*) as docs, count(*) filter (len(f) > 0) as with_numbers, round(count(*) filter (len(f) > 0) / count(*), 6) as density, any_value(array_to_string(samples, ',')) as samples from n join s using (kb_id) group by kb_id")
def _(spark, sf):
    return corpus.doc_number_density(documents(spark, sf)).select("kb_id", "docs", "with_numbers", F.round("density", 6).alias("density"), F.array_join("samples", ",").alias("samples"))


PROFILE = f"with {DOCS}, kbs as (select distinct kb_id from docs union all select 'empty'), g as (select kb_id, sum(n) as n, count(*) as groups from (select kb_id, count(*) as n from docs group by kb_id, {KEY} having count(*) > 1) group by kb_id), d as (select kb_id, count(*) as docs, count(*) filter (scanned) as scanned, count(*) filter (tables >= 3) as dense, count(*) filter (regexp_matches(text, '{NUMBER}')) as numbered, max(length(text)) as most_chars, quantile_cont(length(text), 0.5)::double as median from docs group by kb_id)"


def profiles(spark, sf):
    d = documents(spark, sf)
    return corpus.profile(d, d.select("kb_id").distinct().union(spark.range(1).select(F.lit("empty"))))


@query("prof_profile", f"{PROFILE} select kb_id, case when docs is null then 'no_corpus' else 'ok' end as status, docs, round(scanned / docs, 6) as scanned_share, round(dense / docs, 6) as table_share, round(coalesce(n, 0) / docs, 6)::double as duplicate_share, case when docs is not null then coalesce(groups, 0) end as duplicate_groups, round(numbered / docs, 6) as number_density, most_chars::int as most_chars, median as median_chars, types from kbs left join d using (kb_id) left join g using (kb_id) left join (select kb_id, string_agg(type || ':' || n, ',' order by type) as types from (select kb_id, type, count(*) as n from docs group by all) group by kb_id) using (kb_id)")
def _(spark, sf):
    p = profiles(spark, sf)
    return p.select("kb_id", "status", "docs", *[F.round(c, 6).alias(c) for c in ("scanned_share", "table_share", "duplicate_share")], "duplicate_groups", F.round("number_density", 6).alias("number_density"), "most_chars", "median_chars", F.array_join(F.transform("types", lambda t: F.concat(t["type"], F.lit(":"), t["n"].cast("string"))), ",").alias("types"))


@query("prof_recommend", f"{PROFILE} select kb_id, setting, case when setting = 'rerank' and kb_id = 'en' then 'on' when setting = 'ocr' then case when scanned / docs >= 0.2 then 'on' else 'off' end when setting = 'retrieval_mode' then case when numbered / docs >= 0.1 then 'hybrid' else 'vector' end when setting = 'dedupe_first' then case when coalesce(n, 0) / docs >= 0.3 then 'on' else 'off' end when setting = 'chunk_max' then case when median < 500 then '500' when median > 5000 then '1500' else '1000' end when setting = 'chunk_overlap' then case when median < 500 then '60' when median > 5000 then '180' else '120' end else 'user must choose' end as value, setting = 'rerank' and kb_id = 'en' as overridden from d left join g using (kb_id), (values ('ocr'), ('retrieval_mode'), ('dedupe_first'), ('chunk_max'), ('chunk_overlap'), ('rerank'), ('top_k')) s(setting)")
def _(spark, sf):
    own = profiles(spark, sf).where("kb_id = 'en'").select("kb_id", F.lit("rerank").alias("setting"), F.lit("on").alias("value"))
    return corpus.recommend(profiles(spark, sf), own).select("kb_id", "setting", "value", "overridden")


# --- retrieval ---

TOKENS = "regexp_extract_all(lower({0}), '([\\p{{L}}\\p{{Nd}}]+)', 1)"
BM25 = f"""
c as (select lang as kb_id, doc_id as chunk_id, {TOKENS.format('text')} as t from documents),
stats as (select kb_id, count(*) as chunks, avg(len(t)) as avg_len from c group by kb_id),
tf as (select kb_id, chunk_id, len(t) as n, term, count(*) as tf from (select kb_id, chunk_id, t, unnest(t) as term from c) group by all),
df as (select kb_id, term, count(*) as df from tf group by all),
q as (select distinct item_id as query_id, unnest({TOKENS.format('text')}) as term from benchmark),
s as (select query_id, tf.kb_id, chunk_id, sum(ln(1 + (chunks - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / avg_len))) as score from q join tf using (term) join df on df.kb_id = tf.kb_id and df.term = q.term join stats on stats.kb_id = tf.kb_id group by all)"""


def chunks(spark, sf):
    return table(spark, sf, "documents").select(F.col("lang").alias("kb_id"), F.col("doc_id").alias("chunk_id"), "text")


def keyword(spark, sf):
    """Every benchmark row, asked of every kb."""
    c = chunks(spark, sf).where("kb_id is not null")
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.top_bm25(asked, c).select("query_id", "kb_id", "chunk_id", F.round("score", 6).alias("score"))


@query("ret_tokens", f"select doc_id, len(t)::bigint as n, sha256(array_to_string(t, ' ')) as digest from (select doc_id, {TOKENS.format('text')} as t from documents)")
def _(spark, sf):
    own = table(spark, sf, "documents").select("doc_id", retrieval.words(F.col("text")).alias("t"))
    return own.select("doc_id", F.size("t").cast("long").alias("n"), F.sha2(F.array_join("t", " "), 256).alias("digest"))


@query("ret_tokens_cjk", "select o_orderkey, '教学,见,闽教,闽教学〔' || year(o_orderdate) || '〕' || o_orderkey || '号' as tokens from orders")
def _(spark, sf):
    line = F.concat(F.lit("见 闽教学〔"), F.year("o_orderdate").cast("string"), F.lit("〕"), F.col("o_orderkey").cast("string"), F.lit("号"))
    t = F.array_sort(F.filter(F.array_distinct(retrieval.tokenize(line)), lambda x: ~x.rlike("^[0-9]+$|^号$")))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(t, ",").alias("tokens"))


@query("ret_postings", f"with {BM25} select tf.kb_id, count(*) as postings, sum(tf)::bigint as tokens, max(df)::bigint as most_common from tf join df on tf.kb_id = df.kb_id and tf.term = df.term group by tf.kb_id")
def _(spark, sf):
    own, _ = retrieval.build_bm25(chunks(spark, sf))
    return own.groupBy("kb_id").agg(F.count("*").alias("postings"), F.sum("tf").alias("tokens"), F.max("df").alias("most_common"))


@query("ret_bm25", f"with {BM25} select query_id, kb_id, chunk_id, round(score, 6) as score from s qualify row_number() over (partition by query_id, kb_id order by round(score, 9) desc, chunk_id) <= 5")
def _(spark, sf):
    return keyword(spark, sf)


WHOLE = "['2024', {0}::varchar, '闽教', '教学', '号', '闽教学〔2024〕' || {0} || '号']"


@query("ret_bm25_numbers", f"with {BM25.replace(TOKENS.format('text') + ' as t from documents', TOKENS.format('text') + ' || case when doc_id % 6 = 0 then ' + WHOLE.format('doc_id') + ' else [] end as t from documents').replace('unnest(' + TOKENS.format('text') + ') as term from benchmark', 'unnest(' + WHOLE.format('item_id') + ') as term from benchmark')} select query_id, kb_id, chunk_id, round(score, 6) as score from s qualify row_number() over (partition by query_id, kb_id order by round(score, 9) desc, chunk_id) <= 3")
def _(spark, sf):
    """Exact document numbers asked of documents that end with one: the whole number counts beside its pieces."""
    c = documents(spark, sf).select("kb_id", F.col("doc_id").alias("chunk_id"), "text").where("kb_id is not null")
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("闽教学〔2024〕"), F.col("item_id").cast("string"), F.lit("号")).alias("text"))
    return retrieval.top_bm25(asked, c, 3, retrieval.tokenize).select("query_id", "kb_id", "chunk_id", F.round("score", 6).alias("score"))


@query("ret_bm25_index", f"with {BM25} select query_id, kb_id, chunk_id, round(score, 6) as score from s qualify row_number() over (partition by query_id, kb_id order by round(score, 9) desc, chunk_id) <= 5")
def _(spark, sf):
    """The same from a stored index, to which documents came in two batches."""
    path, c = scratch(spark), chunks(spark, sf)
    for batch in ("chunk_id % 2 = 0 or chunk_id is null", "chunk_id % 2 <> 0"):
        postings.add_to_index(c.where(batch), path)
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return postings.search_index(asked, postings.read_index(spark, path)).select("query_id", "kb_id", "chunk_id", F.round("score", 6).alias("score"))


#: the name under which the same was first registered
query("ret_bm25_all")(keyword)


VECTOR = "v as (select a.vec_id as query_id, b.vec_id as chunk_id, a.label as q_label, b.label as c_label, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) as score from embeddings a, embeddings b where a.vec_id % 50 = 0), vtop as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from v qualify rank <= 20)"


#: the stated query set of a search: rows whose id is divisible by 50, against all rows
FEW = "vec_id % 50 = 0"


def search(name, sql):
    """Registers a search of the stated query set, and as NAME_all that of every vector, without SQL."""

    def add(f):
        query(name, sql)(lambda spark, sf: f(spark, sf, FEW))
        query(f"{name}_all")(lambda spark, sf: f(spark, sf, "true"))
        return f

    return add


def vectors(spark, sf, k=20, asked=FEW):
    e = table(spark, sf, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double")).alias("v")
    own = retrieval.vector_search(e.where(asked).select(F.col("vec_id").alias("query_id"), v), e.select(F.col("vec_id").alias("chunk_id"), v), k)
    return own.withColumn("score", F.round("score", 9))


@search("ret_vector", f"with {VECTOR} select query_id, chunk_id, rank from vtop where rank <= 5")
def _(spark, sf, asked):
    return vectors(spark, sf, 5, asked).select("query_id", "chunk_id", F.col("rank").cast("long"))


@query("ret_vector_cells")
def _(spark, sf):
    """Every vector by cells, a recall of 0.95 measured on the way."""
    e, v = table(spark, sf, "embeddings"), F.transform("embedding", lambda x: x.cast("double")).alias("v")
    own = cells.cell_search(e.select(F.col("vec_id").alias("query_id"), v), e.select(F.col("vec_id").alias("chunk_id"), v))
    return own.select("query_id", "chunk_id", F.col("rank").cast("long"))


@search("udf_kernel", f"with {VECTOR} select query_id, chunk_id, rank from vtop where rank <= 5 and score >= 0.3")
def _(spark, sf, asked):
    return retrieval.get_kernel("vector")(vector=vectors(spark, sf, asked=asked).drop("rank")).select("query_id", "chunk_id", F.col("rank").cast("long"))


@query("udf_kernel_store", "select lang as kb_id, source, doc_id, case when doc_id % 3 = 0 then length(text) + 1 else length(text) end as n from documents d where source is not null and lang is not null and not (lang = 'en' and source = 'src1') and (doc_id % 3 = 0 or not exists (select 1 from documents e where e.lang = d.lang and e.source = d.source and e.doc_id % 3 = 0))")
def _(spark, sf):
    """A third of the documents comes in anew and replaces what their sources had; one source is deleted."""
    d = table(spark, sf, "documents").where("source is not null and lang is not null").select(F.col("lang").alias("kb_id"), "source", "doc_id", F.length("text").alias("n"))
    kernel = retrieval.get_kernel("vector")
    own = kernel.ingest(d, d.where("doc_id % 3 = 0").withColumn("n", F.col("n") + 1))
    return kernel.delete(own, own.where("kb_id = 'en' and source = 'src1'").select("kb_id", "source"))


@search("win_topk", f"with {VECTOR} select query_id, chunk_id from v where score >= 0.2 qualify row_number() over (partition by query_id order by score desc, chunk_id) <= 5")
def _(spark, sf, asked):
    return retrieval.top_k(vectors(spark, sf, 50, asked).drop("rank"), 5, 0.2).select("query_id", "chunk_id")


HYBRID = f"""
{BM25},
ch as (select c.kb_id, c.chunk_id, embedding from c join embeddings on vec_id = c.chunk_id),
bq as (select b.item_id as query_id, c.kb_id, e.embedding from benchmark b join embeddings e on e.vec_id = b.item_id join c on c.chunk_id = b.item_id),
cos as (select query_id, ch.chunk_id, round(list_cosine_similarity(bq.embedding::double[], ch.embedding::double[]), 9) as score from bq join ch using (kb_id) qualify row_number() over (partition by query_id order by score desc, ch.chunk_id) <= 20),
kw as (select s.query_id, s.chunk_id, round(s.score, 9) as score from s join bq on bq.query_id = s.query_id and bq.kb_id = s.kb_id join ch on ch.kb_id = s.kb_id and ch.chunk_id = s.chunk_id qualify row_number() over (partition by s.query_id order by round(s.score, 9) desc, s.chunk_id) <= 20),
b as (select query_id, chunk_id, score / max(score) over (partition by query_id) as b from kw),
fused as (select coalesce(a.query_id, b.query_id) as query_id, coalesce(a.chunk_id, b.chunk_id) as chunk_id, round(0.5 * greatest(least(coalesce(a.score, 0), 1), 0) + 0.5 * coalesce(b, 0), 9) as score from cos a full join b on a.query_id = b.query_id and a.chunk_id = b.chunk_id),
hits as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from fused where score >= 0.3 qualify rank <= 5)"""


def hybrid(spark, sf):
    """Benchmark rows against the documents that have a vector, in the kb of the document with the row's id: cosine and
    BM25 (counted over all documents of the kb) of the same chunks."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    c = chunks(spark, sf).where("kb_id is not null")
    held = c.select("kb_id", "chunk_id").join(e, "chunk_id")
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text").join(held.withColumnRenamed("chunk_id", "query_id"), "query_id")
    cosine = retrieval.vector_search(q.select("query_id", "kb_id", "v"), held, retrieval.CANDIDATE_K, within="kb_id").select("query_id", "chunk_id", F.round("score", 9).alias("score"))
    bm25 = retrieval.search_bm25(q.select("query_id", "kb_id", "text"), c).join(held.select("kb_id", "chunk_id"), ["kb_id", "chunk_id"], "left_semi")
    hits = retrieval.retrieve("hybrid", cosine, bm25.select("query_id", "chunk_id", F.round("score", 9).alias("score")))
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long"))


query("ret_hybrid", f"with {HYBRID} select query_id, chunk_id, round(score, 6) as score, rank from hits")(hybrid)
query("ret_hybrid_all")(hybrid)


@search("rerank_apply", f"with {VECTOR}, r as (select query_id, chunk_id, (chunk_id * 7919 % 1009) / 1009.0::double as score from vtop) select query_id, chunk_id, row_number() over (partition by query_id order by score desc, chunk_id) as rank from r qualify rank <= 5")
def _(spark, sf, asked):
    v = vectors(spark, sf, asked=asked)
    return retrieval.rerank(v, v.select("query_id", "chunk_id", (F.col("chunk_id") * 7919 % 1009 / 1009.0).alias("score"))).select("query_id", "chunk_id", F.col("rank").cast("long"))


@search("ret_reach", f"with {VECTOR}, h as (select query_id, max(score) as best, arg_min(chunk_id, (-score, chunk_id)) as best_chunk from v where chunk_id <> query_id and query_id % 3 <> 0 group by query_id) select q.query_id as question_id, case when best is null then 'no_candidate' when best < 0.33 then 'low_score' else 'hit' end as outcome, best_chunk from (select distinct query_id from v) q left join h using (query_id)")
def _(spark, sf, asked):
    v = vectors(spark, sf, asked=asked)
    made_up = " and query_id % 3 <> 0" if asked == FEW else ""  # the SQL has questions without a candidate
    return retrieval.reachability(v.select("query_id").distinct(), v.where(f"chunk_id <> query_id{made_up}"), 0.33).select("question_id", "outcome", "best_chunk")


@query("eval_recall", f"with {VECTOR}, want as (select distinct a.vec_id as case_id, b.vec_id as s from embeddings a join embeddings b on a.label = b.label where a.vec_id % 50 = 0), found as (select query_id as case_id, chunk_id as s from vtop), n as (select case_id, count(*) as n from want group by case_id), f as (select case_id, count(*) as f from want join found using (case_id, s) group by case_id) select vec_id as case_id, case when n > 0 then round(coalesce(f, 0) / n, 6) end as recall from (select vec_id from embeddings where vec_id % 50 = 0) left join n on case_id = vec_id left join f on f.case_id = vec_id")
def _(spark, sf):
    return recall(spark, sf, FEW)


@query("eval_recall_all")
def _(spark, sf):
    return recall(spark, sf, "true")


def recall(spark, sf, asked):
    e = table(spark, sf, "embeddings")
    hits = vectors(spark, sf, asked=asked).select(F.col("query_id").alias("case_id"), F.col("chunk_id").alias("source"))
    own = answers.context_recall(e.where(asked).select(F.col("vec_id").alias("case_id"), "label"), e.select(F.col("vec_id").alias("source"), "label"), hits)
    return own.select("case_id", F.round("recall", 6).alias("recall"))


def lengths_and_as(batch: list[str]) -> list[list[float]]:
    """A stand-in model: the length of a text and how often it holds an a."""
    return [[float(len(t)), float(t.count("a"))] for t in batch]


@query("udf_embed", "select doc_id, length(text)::double as x, (length(text) - length(replace(text, 'a', '')))::double as y from documents where trim(text) <> ''")
def _(spark, sf):
    d = table(spark, sf, "documents").where("trim(text) <> ''").select("doc_id", "text")
    own = retrieval.embed_texts(d, lengths_and_as)
    return own.select("doc_id", F.col("v")[0].cast("double").alias("x"), F.col("v")[1].cast("double").alias("y"))


# --- questions, answers, evaluation ---


def questions(spark, sf):
    c = table(spark, sf, "conversations").where("role = 'user'")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), "text", F.when(F.col("conv_id") % 9 == 0, "other").otherwise("kb").alias("kb_id"), "conv_id", "turn")


QUESTIONS = "q as (select conv_id * 1000 + turn as question_id, text, case when conv_id % 9 = 0 then 'other' else 'kb' end as kb_id, conv_id, turn from conversations where role = 'user')"


@query("flt_question", f"with {QUESTIONS} select question_id, case when trim(text) = '' then 'empty question' when length(text) > 200 then 'question has ' || length(text) || ' characters, at most 200' end as error from q")
def _(spark, sf):
    return answers.validate_questions(questions(spark, sf), 200).select("question_id", "error")


ANSWERS = f"{QUESTIONS}, h as (select question_id, kb_id, r as rank, (conv_id + r) % 50 as chunk_id, 't' || (conv_id % 3) as title, 's' || ((conv_id + r) % 4) as source, case when r % 2 = 0 then ['a' || (conv_id % 5), 'b'] end as files from q, range(1, 4) t(r) where conv_id % 4 <> 3), u as (select * from h where rank <= 2)"


def answer_rows(spark, sf):
    q = questions(spark, sf)
    r = F.col("rank")
    hits = q.where("conv_id % 4 <> 3").select("question_id", "conv_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("rank")).select("question_id", "rank", ((F.col("conv_id") + r) % 50).alias("chunk_id"), F.concat(F.lit("t"), (F.col("conv_id") % 3).cast("string")).alias("title"), F.concat(F.lit("s"), ((F.col("conv_id") + r) % 4).cast("string")).alias("source"), F.when(r % 2 == 0, F.array(F.concat(F.lit("a"), (F.col("conv_id") % 5).cast("string")), F.lit("b"))).alias("attachments"))
    return q, hits


@query("qa_assemble", f"with {ANSWERS}, s as (select question_id, string_agg(distinct title || ' | ' || source, ',') as n, count(distinct title || ' | ' || source) as sources from u group by question_id) select q.question_id, case when q.kb_id <> 'kb' then 'error' when sources is null then 'refused' else 'answered' end as status, case when q.kb_id <> 'kb' then 0 else coalesce(sources, 0) end::bigint as sources, case when q.kb_id <> 'kb' then 'no index for other' end as error from q left join s using (question_id)")
def _(spark, sf):
    q, hits = answer_rows(spark, sf)
    used = hits.where("rank <= 2").select("question_id", "chunk_id")
    out = answers.assemble_answers(q, hits, used, q.where("kb_id = 'kb'").select("kb_id").distinct())
    return out.select("question_id", "status", F.size("sources").cast("long").alias("sources"), "error")


@query("set_attach_dedupe", f"with {ANSWERS}, f as (select question_id, list_sort(list_distinct(flatten(list(coalesce(files, []))))) as files from h group by question_id) select question_id, array_to_string(files, ',') as attachments from f")
def _(spark, sf):
    own = answers.answer_attachments(answer_rows(spark, sf)[1])
    return own.select("question_id", F.array_join(F.array_sort("attachments"), ",").alias("attachments"))


@query("eval_attachment", f"with {ANSWERS}, f as (select question_id as case_id, list_distinct(flatten(list(coalesce(files, [])))) as files from h group by question_id) select q.question_id as case_id, list_contains(coalesce(files, []), 'b') as ok from q left join f on case_id = question_id")
def _(spark, sf):
    q, hits = answer_rows(spark, sf)
    got = answers.answer_attachments(hits).withColumnRenamed("question_id", "case_id")
    cases = q.select(F.col("question_id").alias("case_id"), F.array(F.lit("b")).alias("expected_attachments"))
    return answers.attachment_hits(cases, got).select("case_id", "ok")


@query("eval_load", "select conv_id * 1000 + turn as case_id, f as field from conversations, (values ('question'), ('points')) v(f) where role = 'user' and ((f = 'question' and turn % 5 = 0) or (f = 'points' and conv_id % 3 = 0))")
def _(spark, sf):
    q = questions(spark, sf)
    cases = q.select(F.col("question_id").alias("case_id"), F.when(F.col("turn") % 5 != 0, F.col("text")).alias("question"), F.when(F.col("conv_id") % 3 != 0, F.array("text")).alias("points"))
    return answers.validate_cases(cases)


@query("eval_origin", f"with {QUESTIONS} select question_id as case_id, case when conv_id % 4 = 0 then 'human' else 'synthetic' end as origin, sha256(case when conv_id % 4 = 0 then text || '!' else text end) as question from q")
def _(spark, sf):
    q = questions(spark, sf)
    cases = q.select(F.col("question_id").alias("case_id"), F.col("text").alias("question"), F.lit("synthetic").alias("origin"))
    edits = q.where("conv_id % 4 = 0").select(F.col("question_id").alias("case_id"), F.concat("text", F.lit("!")).alias("question"))
    return answers.merge_cases(cases, edits).select("case_id", "origin", F.sha2("question", 256).alias("question"))


@query("eval_append", f"with {QUESTIONS} select question_id as case_id, case when conv_id % 2 = 0 then 'synthetic' else 'human' end as origin from q")
def _(spark, sf):
    root, q = scratch(spark), questions(spark, sf).select(F.col("question_id").alias("case_id"), F.col("text").alias("question"), "conv_id")
    q.where("conv_id % 2 = 0").withColumn("origin", F.lit("synthetic")).write.parquet(root)
    answers.append_cases(root, q.where("conv_id % 2 = 1"))
    return spark.read.parquet(root).select("case_id", "origin")


SCORES = "s as (select doc_id as case_id, m as metric, case m when 'quality' then quality else 1 - toxic end::double as value from labels, (values ('quality'), ('clean')) v(m)), r as (select metric, avg(value) as value, count(*) as cases from s group by metric)"


def scores(spark, sf):
    x = table(spark, sf, "labels")
    each = F.explode(F.array(F.struct(F.lit("quality").alias("metric"), F.col("quality").cast("double").alias("value")), F.struct(F.lit("clean").alias("metric"), (1 - F.col("toxic")).cast("double").alias("value"))))
    return x.select(F.col("doc_id").alias("case_id"), each.alias("e")).select("case_id", "e.*")


def thresholds(spark, sf):
    return table(spark, sf, "labels").limit(1).select(F.explode(F.array(F.struct(F.lit("quality").alias("metric"), F.lit(0.9).alias("threshold")), F.struct(F.lit("clean").alias("metric"), F.lit(0.5).alias("threshold")))).alias("t")).select("t.*")


@query("eval_overall", f"with {SCORES} select metric, round(value, 6) as value, cases from r")
def _(spark, sf):
    return answers.eval_report(scores(spark, sf)).select("metric", F.round("value", 6).alias("value"), "cases")


@query("eval_failing", f"with {SCORES} select case_id, metric, value from s where value < case metric when 'quality' then 0.9 else 0.5 end")
def _(spark, sf):
    return answers.failing_cases(scores(spark, sf), thresholds(spark, sf)).select("case_id", "metric", "value")


@query("eval_gate", f"with {SCORES} select bool_and(value >= case metric when 'quality' then 0.9 else 0.5 end) as passed, coalesce(string_agg(metric, ',' order by metric) filter (value < case metric when 'quality' then 0.9 else 0.5 end), '') as below from r")
def _(spark, sf):
    return answers.eval_gate(answers.eval_report(scores(spark, sf)), thresholds(spark, sf)).select("passed", F.array_join("below", ",").alias("below"))


# --- streams: the table is read as a stream until its end ---


def event_stream(spark, sf, *columns):
    path = f"{sf}/events.parquet"
    schema = table(spark, sf, "events").schema
    folder = path if spark.read.format("binaryFile").load(path).limit(2).count() > 1 else sf
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet" if folder == path else "events.parquet").parquet(folder)
    return stream.withColumn("at", F.col("ts").cast("timestamp"))


def run_stream(spark, df, mode="append"):
    root = scratch(spark)
    job = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start(f"{root}/out")
    job.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/out")


@query("st_dedupe", "select distinct user_id as source, event_type as content_hash from events")
def _(spark, sf):
    s = event_stream(spark, sf).select(F.col("user_id").alias("source"), F.col("event_type").alias("content_hash"), "at")
    return run_stream(spark, jobs.stream_new_pages(s, "3650 days")).select("source", "content_hash")


@query("st_rate", "with m as (select user_id % 5 as caller, date_trunc('minute', ts) as minute, count(*) as n from events group by all) select caller, minute, n, n > 2 as over from m where minute + interval 1 minute <= (select max(ts) - interval 2 minute from events)")
def _(spark, sf):
    s = event_stream(spark, sf).select((F.col("user_id") % 5).alias("caller"), "at")
    return run_stream(spark, jobs.stream_rate_limit(s, 2)).select("caller", F.col("minute").cast("timestamp_ntz").alias("minute"), "n", "over")


@query("st_throttle", "with r as (select user_id as origin, epoch_us(ts) / 1e6 as t, event_id as seq from events), n as (select *, (row_number() over (partition by origin order by t, seq) - 1) * 36000.0::double as i from r) select seq, round(i + max(t - i) over (partition by origin order by t, seq rows unbounded preceding) - t, 3) as delay from n")
def _(spark, sf):
    s = event_stream(spark, sf).select(F.col("user_id").alias("origin"), (F.unix_micros("at") / 1e6).alias("at"), F.col("event_id").alias("seq"))
    return run_stream(spark, jobs.stream_throttle(s, 36000.0)).select("seq", F.round("delay", 3).alias("delay"))
