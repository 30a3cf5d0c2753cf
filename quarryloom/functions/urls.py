"""Column functions over URLs. Built-in expressions, but for joining relative URLs."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: fixed values: what begins a reference that is no page
NOT_PAGES = ("#", "javascript:", "mailto:", "tel:")


def _null_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def origin_of(url: Column) -> Column:
    """``scheme://host[:port]`` of an http(s) URL, else null."""
    return _null_if_empty(F.regexp_extract(url, r"^(https?://[^/?#]+)", 1))


def host_of(url: Column) -> Column:
    return _null_if_empty(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """The path, empty if there is none; query and fragment are left out."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def url_shape(url: Column) -> Column:
    """The path with ``#`` for each segment that holds a digit."""
    return F.array_join(F.transform(F.split(path_of(url), "/"), lambda s: F.when(s.rlike("[0-9]"), "#").otherwise(s)), "/")


def is_homepage_like(url: Column, base: Column) -> Column:
    """No path, or the same leaf as the entry page."""
    path, leaf = path_of(url), F.substring_index(path_of(base), "/", -1)
    return path.isin("", "/") | ((leaf != "") & (F.substring_index(path, "/", -1) == leaf))


def page_number(href: Column) -> Column:
    """The last run of digits of the last path part before its first dot; null for scripts and if there is none."""
    leaf = F.substring_index(F.substring_index(href, "/", -1), ".", 1)
    digits = F.regexp_extract(leaf, r"([0-9]+)[^0-9]*$", 1)
    return F.when(~href.startswith("javascript:") & (digits != ""), digits.cast("long"))


def is_attachment(href: Column, extensions: Sequence[str]) -> Column:
    bare = F.lower(F.substring_index(href, "?", 1))
    return bare.rlike(r"\.(" + "|".join(e.lower().lstrip(".") for e in extensions) + ")$")


def resolve(base: str, href: str | None) -> str | None:
    """One absolute http(s) URL without fragment, or None."""
    text = (href or "").strip()
    if not base or not text or text.startswith(NOT_PAGES):
        return None
    try:
        url = urldefrag(urljoin(base, text)).url
    except ValueError:
        return None
    return url if url.startswith(("http://", "https://")) else None


@F.pandas_udf(StringType())
def resolve_link(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([resolve(b, h) for b, h in zip(base, href, strict=True)], dtype=object)
