"""Documents: Markdown, chunks, the profile of a corpus and the settings it speaks for."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import duplicate_key, extract_doc_numbers
from .dom import Page, parse

SCANNED, DUPLICATES, DOC_NUMBERS, TABLES = 0.2, 0.3, 0.1, 3
MAX_CHARS, OVERLAP, MIN_CHARS, MIN_BODY = 1000, 120, 80, 50
APART = {"nav", "footer", "script", "style", "head", "noscript", "aside", "form"}
HEADINGS = {f"h{i}": i for i in range(1, 7)}


# --- Markdown ---


def _table(p: Page, i: int) -> tuple[str, bool]:
    """(lines, whether cells are merged: then the rows stay HTML)."""
    cells = [j for j in range(i, p.last[i]) if p.tag[j] in ("td", "th")]
    merged = any(p.attrs[j].get(k, "1") not in ("", "1") for j in cells for k in ("colspan", "rowspan"))
    rows = [[j for j in cells if r < j < p.last[r]] for r in range(i, p.last[i]) if p.tag[r] == "tr"]
    if merged:
        cell = lambda j: "".join(["<", p.tag[j], *(f' {k}="{p.attrs[j][k]}"' for k in ("colspan", "rowspan") if k in p.attrs[j]), ">", p.text(j), "</", p.tag[j], ">"])
        return "<table>" + "".join("<tr>" + "".join(map(cell, r)) + "</tr>" for r in rows) + "</table>", True
    lines = ["| " + " | ".join(p.text(j).replace("|", "\\|") for j in r) + " |" for r in rows if r]
    if lines:
        lines.insert(1, "|" + " --- |" * len(rows[0]))
    return "\n".join(lines), False


def markdown_of(p: Page | None) -> tuple[str, int, int, bool]:
    """(Markdown, tables, tables with merged cells, no headings)."""
    if p is None:
        return "", 0, 0, True
    blocks, tables, merged, headings = [], 0, 0, 0
    words: list[str] = []
    stops = {"p", "div", "li", "br", "article", "section", "main", "table", "ul", "ol", "td", "tr", "body", "html", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6"}

    def flush() -> None:
        text = " ".join("".join(words).split())
        if text:
            blocks.append(text)
        words.clear()

    # pages may be nested deeply, so the way through the elements is a stack: go in, say text, come out
    todo: list[tuple[str, int, int]] = [("in", r, 0) for r in reversed(list(p.roots()))]
    while todo:
        step, i, had = todo.pop()
        if step == "say":
            words.append(p.pieces[i])
            continue
        tag = p.tag[i]
        if step == "out":
            if tag == "li" and len(blocks) == had:
                text = " ".join("".join(words).split())
                words.clear()
                if text:
                    blocks.append("- " + text)
            elif tag in stops:
                flush()
            continue
        if tag in APART or any(w in p.marker[i] for w in ("nav", "footer")):
            continue
        if tag in stops:
            flush()
        if tag in HEADINGS:
            if p.text(i):
                headings += 1
                blocks.append("#" * HEADINGS[tag] + " " + p.text(i))
            continue
        if tag == "table":
            text, odd = _table(p, i)
            if text:
                tables, merged = tables + 1, merged + odd
                blocks.append(text)
            continue
        own = [(p.piece_from[k], "in", k) for k in p.children(i)] + [(n, "", n) for n in range(p.piece_from[i], p.piece_to[i]) if p.owner[n] == i]
        todo.append(("out", i, len(blocks)))
        todo += [(kind or "say", n, 0) for _, kind, n in sorted(own, reverse=True)]
    flush()
    return "\n\n".join(blocks), tables, merged, headings == 0


def to_markdown(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, html) → keys, markdown, tables, complex_tables, flat. Navigation and footers are dropped."""
    names = [*keys, "markdown", "tables", "complex_tables", "flat"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), 200):
                part = frame.iloc[i : i + 200]
                done = [markdown_of(parse(h)) for h in part.html]
                yield pd.concat([part[keys].reset_index(drop=True), pd.DataFrame(done, columns=names[len(keys) :])], axis=1)

    kinds = dict(pages.dtypes)
    return pages.select(*keys, "html").mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "markdown string, tables int, complex_tables int, flat boolean"]))


def mark_short_bodies(docs: DataFrame, min_chars: int = MIN_BODY) -> DataFrame:
    """Adds ``status`` and ``reason``: an empty or short body is an extraction that failed."""
    n = F.length(F.trim(F.coalesce("text", F.lit(""))))
    short = n < min_chars
    return docs.withColumn("status", F.when(short, "extraction_failed").otherwise("ok")).withColumn("reason", F.when(short, F.format_string("body has %d characters, at least %d are needed", n, F.lit(min_chars))))


def table_flags(docs: DataFrame, text: str = "markdown", dense: int = TABLES) -> DataFrame:
    """Adds tables, table_dense and complex_tables counted in Markdown."""
    simple = F.size(F.regexp_extract_all(text, F.lit(r"(?m)^(\|(?: --- \|)+)$"), F.lit(1)))
    merged = F.size(F.regexp_extract_all(text, F.lit("(<table>)"), F.lit(1)))
    return docs.withColumn("complex_tables", merged).withColumn("tables", simple + merged).withColumn("table_dense", F.col("tables") >= dense)


# --- chunks ---

SENTENCE = re.compile(r"[^。！？!?.\n]*(?:[。！？!?]+|\.(?=\s|$)|\n|$)\s*")


def _split(text: str, size: int, overlap: int) -> list[str]:
    """A paragraph over the limit by sentences, by length where one sentence is too long; pieces overlap."""
    parts = [s for s in SENTENCE.findall(text) if s]
    parts = [s[i : i + size] for s in parts for i in range(0, len(s), size)]
    out: list[list[str]] = [[]]
    for s in parts:
        if out[-1] and sum(map(len, out[-1])) + len(s) > size:
            tail, n = [], 0
            for t in reversed(out[-1]):
                if n + len(t) > overlap or n + len(t) + len(s) > size:
                    break
                tail.insert(0, t)
                n += len(t)
            out.append(tail)
        out[-1].append(s)
    return ["".join(p).strip() for p in out if "".join(p).strip()]


def _split_table(text: str, size: int) -> list[str]:
    """A table over the limit by rows, each piece with the header."""
    lines = text.split("\n")
    head, rows = lines[:2], lines[2:]
    out, now = [], []
    for r in rows:
        if now and len("\n".join([*head, *now, r])) > size:
            out.append("\n".join([*head, *now]))
            now = []
        now.append(r)
    return [*out, "\n".join([*head, *now])] if now else out or [text]


def chunks_of(markdown: str, size: int = MAX_CHARS, overlap: int = OVERLAP, least: int = MIN_CHARS) -> list[tuple[list[str], str]]:
    """(headings above, text) of the chunks: along headings, then paragraphs, then sentences; tables stay whole."""
    out: list[tuple[list[str], str]] = []
    path: list[str] = []
    now: list[str] = []

    def flush() -> None:
        if now:
            out.append((list(path), "\n\n".join(now)))
            now.clear()

    for block in re.split(r"\n\s*\n", markdown or ""):
        block = block.strip()
        m = re.match(r"(#{1,6}) (.+)", block)
        if not block:
            continue
        if m:
            flush()
            del path[len(m[1]) - 1 :]
            path.append(m[2].strip())
            continue
        table = block.startswith(("| ", "<table>"))
        if now and len("\n\n".join([*now, block])) > size:
            flush()
        if len(block) <= size:
            now.append(block)
            continue
        flush()
        pieces = [block] if block.startswith("<table>") else _split_table(block, size) if table else _split(block, size, overlap)
        if len(pieces) > 1 and len(pieces[-1]) < least and not table:
            last = pieces.pop()
            shared = next((k for k in range(min(len(last), len(pieces[-1])), 0, -1) if pieces[-1].endswith(last[:k])), 0)
            pieces[-1] += last[shared:]
        out += [(list(path), p) for p in pieces]
    flush()
    merged: list[tuple[list[str], str]] = []
    for p, t in out:
        if merged and len(t) < least and merged[-1][0] == p and not t.startswith("| ") and not merged[-1][1].startswith("| ") and len(merged[-1][1]) + len(t) + 2 <= size + least:
            merged[-1] = (p, merged[-1][1] + "\n\n" + t)
        else:
            merged.append((p, t))
    return merged


def chunk_documents(docs: DataFrame, key: str, size: int = MAX_CHARS, overlap: int = OVERLAP, least: int = MIN_CHARS) -> DataFrame:
    """(key, markdown) → (key, chunk_no, heading_path, text), without a shuffle."""
    if overlap >= size or least > size:
        raise ValueError("overlap and least size must stay below the chunk size")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), 200):
                rows = [(k, n, p, t) for k, m in frame.iloc[i : i + 200].itertuples(index=False) for n, (p, t) in enumerate(chunks_of(m, size, overlap, least))]
                yield pd.DataFrame(rows, columns=[key, "chunk_no", "heading_path", "text"])

    return docs.select(key, "markdown").mapInPandas(run, f"{key} {dict(docs.dtypes)[key]}, chunk_no int, heading_path array<string>, text string")


def with_metadata(chunks: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """Every chunk with all metadata of its document, attachments included."""
    return chunks.join(docs.drop("text", "markdown"), key)


# --- profile ---


def type_distribution(docs: DataFrame) -> DataFrame:
    n = docs.groupBy("kb_id", "type").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("kb_id")))


def length_distribution(docs: DataFrame) -> DataFrame:
    """Least, quartiles and greatest body length: exact, from counts of each length (of which there are few)."""
    each = docs.groupBy("kb_id", F.length(F.coalesce("text", F.lit(""))).alias("n")).agg(F.count("*").alias("docs"))
    quartiles = [F.percentile("n", q, F.col("docs")).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)]
    return each.groupBy("kb_id").agg(F.min("n").alias("least"), *quartiles, F.max("n").alias("most"))


def length_histogram(docs: DataFrame, upto: int = 10_000, buckets: int = 10) -> DataFrame:
    n = F.length(F.coalesce("text", F.lit("")))
    return docs.select("kb_id", F.width_bucket(n, F.lit(0), F.lit(upto), F.lit(buckets)).alias("bucket")).groupBy("kb_id", "bucket").agg(F.count("*").alias("n"))


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """Groups of documents that differ in case, digits and white space only: (kb_id, key, n, first)."""
    keyed = docs.select("kb_id", "doc_id", duplicate_key(F.col("text")).alias("key"))
    return keyed.groupBy("kb_id", "key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


def doc_number_density(docs: DataFrame) -> DataFrame:
    """Share of documents with a document number, and the first three numbers in order."""
    numbered = docs.select("kb_id", F.array_distinct(extract_doc_numbers(F.col("text"))).alias("found"))
    density = numbered.groupBy("kb_id").agg(F.count("*").alias("docs"), F.count_if(F.size("found") > 0).alias("with_numbers"))
    each = numbered.select("kb_id", F.explode("found").alias("number")).distinct()
    turn = F.row_number().over(Window.partitionBy("kb_id").orderBy("number"))
    some = each.withColumn("_n", turn).where("_n <= 3").groupBy("kb_id").agg(F.array_sort(F.collect_list("number")).alias("samples"))
    return density.join(some, "kb_id", "left").select("kb_id", "docs", "with_numbers", (F.col("with_numbers") / F.col("docs")).alias("density"), F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def profile(docs: DataFrame, kbs: DataFrame) -> DataFrame:
    """One row per knowledge base of (kb_id, doc_id, type, text, scanned, tables); one without documents: no_corpus."""
    own = docs.groupBy("kb_id").agg(
        F.count("*").alias("docs"), F.count_if(F.col("scanned")).alias("scanned"), F.count_if(F.col("tables") >= TABLES).alias("table_dense"),
        F.count_if(F.size(extract_doc_numbers(F.col("text"))) > 0).alias("numbered"),
    )
    kinds = type_distribution(docs).groupBy("kb_id").agg(F.array_sort(F.collect_list(F.struct("type", "n", "share"))).alias("types"))
    lengths = length_distribution(docs).withColumnsRenamed({"least": "least_chars", "q25": "q25_chars", "q50": "median_chars", "q75": "q75_chars", "most": "most_chars"})
    copies = duplicate_groups(docs).groupBy("kb_id").agg(F.sum("n").alias("in_groups"), F.count("*").alias("groups"))
    out = kbs.select("kb_id").distinct().join(own, "kb_id", "left").join(copies, "kb_id", "left").join(kinds, "kb_id", "left").join(lengths, "kb_id", "left")
    share = lambda c: F.coalesce(c, F.lit(0)) / F.col("docs")
    none = F.col("docs").isNull()
    return out.select(
        "kb_id", F.when(none, "no_corpus").otherwise("ok").alias("status"), "docs", share(F.col("scanned")).alias("scanned_share"), share(F.col("table_dense")).alias("table_share"),
        share(F.col("in_groups")).alias("duplicate_share"), F.when(~none, F.coalesce("groups", F.lit(0))).alias("duplicate_groups"), share(F.col("numbered")).alias("number_density"), "types", *lengths.columns[1:],
    )


def recommend(profiles: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(kb_id, setting, value, reason, overridden, heuristic) of profiles that have a corpus.

    What depends on the questions to come is left to the user. overrides (kb_id, setting, value) win and are flagged.
    """
    percent = lambda c: F.concat(F.round(F.col(c) * 100, 1).cast("string"), F.lit("%"))

    def rule(setting: str, on, yes: str, no: str, reason) -> F.Column:
        return F.struct(F.lit(setting).alias("setting"), F.when(on, yes).otherwise(no).alias("value"), reason.alias("reason"))

    chunk = F.when(F.col("median_chars") < 500, "500").when(F.col("median_chars") > 5000, "1500").otherwise(str(MAX_CHARS))
    rules = F.array(
        rule("ocr", F.col("scanned_share") >= SCANNED, "on", "off", F.concat(F.lit("scanned share "), percent("scanned_share"), F.lit(f", threshold {SCANNED}"))),
        rule("retrieval_mode", F.col("number_density") >= DOC_NUMBERS, "hybrid", "vector", F.concat(F.lit("documents with numbers "), percent("number_density"), F.lit(f", threshold {DOC_NUMBERS}"))),
        rule("dedupe_first", F.col("duplicate_share") >= DUPLICATES, "on", "off", F.concat(F.lit("suspected duplicates "), percent("duplicate_share"), F.lit(f", threshold {DUPLICATES}"))),
        F.struct(F.lit("chunk_max").alias("setting"), chunk.alias("value"), F.concat(F.lit("median body length "), F.col("median_chars").cast("string")).alias("reason")),
        F.struct(F.lit("chunk_overlap").alias("setting"), (chunk.cast("int") * OVERLAP / MAX_CHARS).cast("int").cast("string").alias("value"), F.lit("12 % of the chunk size").alias("reason")),
        F.struct(F.lit("rerank").alias("setting"), F.lit("user must choose").alias("value"), F.lit("depends on the questions").alias("reason")),
        F.struct(F.lit("top_k").alias("setting"), F.lit("user must choose").alias("value"), F.lit("depends on the questions").alias("reason")),
    )
    out = profiles.where("status = 'ok'").select("kb_id", F.explode(rules).alias("r")).select("kb_id", "r.*")
    if overrides is None:
        return out.withColumns({"overridden": F.lit(False), "heuristic": F.lit(True)})
    own = overrides.select("kb_id", "setting", F.col("value").alias("_own"))
    return out.join(own, ["kb_id", "setting"], "left").select("kb_id", "setting", F.coalesce("_own", "value").alias("value"), "reason", F.col("_own").isNotNull().alias("overridden"), F.col("_own").isNull().alias("heuristic"))
