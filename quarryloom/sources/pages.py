"""Reading pages, sitemaps and folders; one document schema for all of them."""

from __future__ import annotations

import re
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

CHARSET = re.compile(rb"charset\s*=\s*[\"']?\s*([\w-]+)", re.I)
SNIFF, FALLBACKS = 2048, ("utf-8", "gb18030")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page snapshots (url, status, text) of a parquet or JSON folder."""
    return spark.read.json(path) if path.rstrip("/").endswith((".json", ".jsonl")) else spark.read.parquet(path)


def split_outcomes(fetches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, failures): status below 400; the rest with reason ``HTTP <status>``, or that there was no answer."""
    ok = F.coalesce(F.col("status") < 400, F.lit(False))
    reason = F.coalesce(F.concat(F.lit("HTTP "), F.col("status").cast("string")), F.lit("no answer"))
    return fetches.where(ok), fetches.where(~ok).select("url", reason.alias("reason"))


def decode_bytes(body: bytes | None, declared: str | None) -> str | None:
    """Text by the charset that the page names, the header's, UTF-8, GB18030, or UTF-8 with replacements."""
    if body is None:
        return None
    named = CHARSET.search(body[:SNIFF])
    for encoding in (named[1].decode("ascii", "ignore") if named else None, declared, *FALLBACKS):
        if encoding:
            try:
                return body.decode(encoding)
            except (UnicodeDecodeError, LookupError):
                pass
    return body.decode("utf-8", "replace")


@F.pandas_udf(StringType())
def decode_html(body: pd.Series, declared: pd.Series) -> pd.Series:
    return pd.Series([decode_bytes(b, d) for b, d in zip(body, declared, strict=True)], dtype=object)


def sitemap_locations(xml: str | None) -> dict | None:
    """The kind of a sitemap file and its locations in order; None if it is malformed or something else."""
    try:
        root = ElementTree.fromstring((xml or "").strip())
    except (ElementTree.ParseError, ValueError):
        return None
    kind = root.tag.rpartition("}")[2]
    if kind not in ("urlset", "sitemapindex"):
        return None
    found = ("".join(e.itertext()).strip() for e in root.iter() if isinstance(e.tag, str) and e.tag.rpartition("}")[2] == "loc")
    return {"kind": kind, "locations": [u for u in found if u]}


@F.pandas_udf(StructType().add("kind", StringType()).add("locations", ArrayType(StringType())))
def parse_sitemap(xml: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([sitemap_locations(x) or {"kind": None, "locations": None} for x in xml], columns=["kind", "locations"])


def read_sitemaps(texts: DataFrame) -> DataFrame:
    """(site, base_url, xml) → (site, base_url, pos, target, is_index); malformed XML gives no rows.

    A row is one file (the format allows 50,000 addresses in it), read by an XML parser in its task.
    """
    read = texts.select("site", "base_url", parse_sitemap("xml").alias("x"))
    return read.select("site", "base_url", F.posexplode("x.locations").alias("pos", "target"), (F.col("x.kind") == "sitemapindex").alias("is_index"))


def read_folder(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Files below a folder: (path relative to it, bytes, modified, content). An unreadable root is Spark's error.

    The rules are put to a listing without contents first; only files that they want are then opened. (Spark has the
    names of all files below the folder on the driver in any case.) Of no file that is wanted no rows.
    """
    at = "^.*?" + re.escape(root.rstrip("/").rpartition("://")[2]) + "/"
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace(F.col("path"), at, "")
    wanted = listed.select("path", path.alias("short"))
    for p in include or []:
        wanted = wanted.where(F.col("short").rlike(p))
    for p in exclude or []:
        wanted = wanted.where(~F.col("short").rlike(p))
    paths = [r.path for r in wanted.select("path").collect()] if include or exclude else [root]
    # brackets and such in a name are no pattern
    plain = [re.sub(r"([\\*?\[\]{}])", r"\\\1", p) for p in paths] if include or exclude else paths
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(plain) if paths else listed.limit(0)
    return files.select(path.alias("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), "content")


def sniff_type(content: Column) -> Column:
    """File type by content, ``unsupported`` if none fits. Names inside an archive are looked for as bytes, in place."""
    head = F.hex(F.substring(content, 1, 8))
    text = F.lower(F.substring(content, 1, 1024).cast("string"))
    holds = lambda some: F.contains(content, F.lit(some))
    archive = head.startswith("504B0304")
    return (
        F.when(head.startswith("25504446"), "pdf")
        .when(head.startswith("D0CF11E0A1B11AE1"), "ole")
        .when(archive & holds(b"word/"), "docx")
        .when(archive & holds(b"xl/"), "xlsx")
        .when(archive & holds(b"ppt/"), "pptx")
        .when(text.rlike(r"<!doctype html|<html"), "html")
        .when(text.startswith("{") | text.startswith("["), "json")
        .when((F.length(content) > 0) & ~holds(b"\0"), "text")
        .otherwise("unsupported")
    )


def unify_documents(pages: DataFrame, files: DataFrame, kb_id: str) -> DataFrame:
    """Crawled pages (url, text) and imported files (path, text) as one table with content hashes."""
    one = lambda df, source, kind: df.select(F.lit(kb_id).alias("kb_id"), F.col(source).alias("source"), F.lit(kind).alias("source_kind"), "text", F.sha2("text", 256).alias("content_hash"))
    return one(pages, "url", "web").unionByName(one(files, "path", "file"))
