"""Column functions over text. Character classes are written out: Java's \\s and \\d know ASCII only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
BLANKS = r"[\s\u0085   -     　]"
DATE = r"(?:19|20)[0-9]{2}\s*[-/年]\s*[0-9]{1,2}\s*[-/月]\s*[0-9]{1,2}"
DEPARTMENTS = "处 院 系 部 办公室 中心 科 馆 所".split()
OFFICIAL, FORM = r"[一-鿿]{1,8}[〔\[（(][0-9]{4}[〕\]）)][0-9]+号", "[A-Z]{2,}-?[0-9]{2,}"
DOC_NUMBER = f"{OFFICIAL}|{FORM}"
NOISE_WORDS = "nav menu header footer sidebar side breadcrumb copyright banner topbar crumb".split()


def text_norm(c: Column) -> Column:
    """White space runs become one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, BLANKS + "+", " "))


def text_squeeze(c: Column) -> Column:
    """All white space removed."""
    return F.regexp_replace(c, BLANKS + "+", "")


def find_date(c: Column) -> Column:
    found = F.regexp_extract(c, f"({DATE})", 1)
    return F.when(found != "", found)


def is_department(c: Column) -> Column:
    """Ends with a department word, 2 to 40 characters."""
    return c.rlike(f"(?:{'|'.join(DEPARTMENTS)})$") & F.length(c).between(2, 40)


def extract_doc_numbers(c: Column, alone: str | None = None) -> Column:
    """All document numbers and form codes, in order; with ``alone`` no codes next to a character of that class."""
    own = DOC_NUMBER if alone is None else f"{OFFICIAL}|(?<!{alone}){FORM}(?!{alone})"
    return F.regexp_extract_all(c, F.lit(f"({own})"), F.lit(1))


def is_noise(classes: Column, element_id: Column) -> Column:
    """Class or id holds a word of structural noise (a substring test)."""
    marker = F.lower(F.concat_ws(" ", F.coalesce(classes, F.lit("")), F.coalesce(element_id, F.lit(""))))
    return marker.rlike("|".join(NOISE_WORDS))


def duplicate_key(c: Column) -> Column:
    """Documents that differ in case, digits or white space only have the same key."""
    return F.sha2(F.regexp_replace(F.lower(c), r"[0-9\s 　]+", ""), 256)
