"""Text cleaning and text measures as column expressions.

White space follows Unicode (``(?U)``); HTML entities are the one thing that
Spark has no function for, so they alone go through an Arrow UDF.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textmill.workers import reach

# The patterns that decide what is markup, a signature or
# boilerplate.
TAG = "<[^>]+>"
BBCODE = r"\[/?[a-zA-Z][^\]]*\]"
SIGNATURE = (
    r"\n--\s*\n.*$",
    r"\nMit freundlichen Gr[uü]ssen.*$",
    r"\nMit freundlichen Gr[uü]ßen.*$",
    r"\nBest regards.*$",
    r"\nKind regards.*$",
    r"\nFreundliche Gr[uü]sse.*$",
)
BOILERPLATE = (r"^\d+$", r"(?i)^Copyright\s+©", r"(?i)^©\s*\d{4}", r"(?i)^Seite\s+\d+")
WORD = "[a-zäöüß0-9]+"
CAPTION = r"(?i)Tabelle\s+\d"
MOJIBAKE = "�|â€|Ã\\S"
REPLY = r"(?i)^(re\s*:\s*)+"


@F.pandas_udf(StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def unescape(text: Column) -> Column:
    """Character references to characters, by HTML's rules. Texts without an
    ampersand stay as they are and do not leave the JVM."""
    reach(SparkSession.active())
    return F.coalesce(_unescape(F.when(F.contains(text, F.lit("&")), text)), text)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once per row. A generator keeps the
    optimizer from copying the expression into lambdas that read it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(~text.rlike(r"(?U)\S"), F.lit(True))


def clean_markup(text: Column, entities: bool = True) -> Column:
    """Tags, entities, BBCode, runs of spaces, runs of newlines - in this
    order, so an escaped tag survives as a tag."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), TAG, "")
    t = unescape(t) if entities else t
    t = F.regexp_replace(F.regexp_replace(t, BBCODE, ""), "[ \t]+", " ")
    return strip(F.regexp_replace(t, "\n+", "\n"))


def normalize_space(text: Column) -> Column:
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "[ \t]+", " ")
    return strip(F.regexp_replace(t, "\n{2,}", "\n"))


def remove_signature(text: Column) -> Column:
    return strip(F.regexp_replace(text, "(?isu)" + "|".join(SIGNATURE), ""))


def clean_ticket(text: Column, entities: bool = True) -> Column:
    t = F.regexp_replace(F.coalesce(text, F.lit("")), TAG, "")
    return normalize_space(unescape(t) if entities else t)


def remove_boilerplate(text: Column) -> Column:
    """Without the lines that are page numbers, page marks or copyright."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\R")
    bad = lambda line: F.array_contains(F.array(*[strip(line).rlike(p) for p in BOILERPLATE]), True)
    return strip(F.array_join(F.filter(lines, lambda line: ~bad(line)), "\n"))


def normalize_page(text: Column) -> Column:
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "[ \t]+", " ")
    return strip(F.regexp_replace(t, "\n{3,}", "\n\n"))


def stem(name: Column) -> Column:
    """File name without directories and its last suffix; a leading dot is
    part of the stem."""
    base = F.regexp_extract(name, r"([^/]*)/*$", 1)
    return F.regexp_replace(base, r"(?<=[^/])\.[^./]+$", "")


def doc_id_of(path: Column) -> Column:
    return F.btrim(F.lower(F.regexp_replace(stem(path), "[^a-zA-Z0-9]+", "_")), F.lit("_"))


def doc_title(name: Column) -> Column:
    return F.replace(stem(F.coalesce(name, F.lit(""))), F.lit("_"), F.lit(" "))


def module_of(doc_id: Column) -> Column:
    """The second ``_`` token, capitalised; too short or absent: empty."""
    token = F.coalesce(F.get(F.split(doc_id, "_"), 1), F.lit(""))
    return F.when(F.length(token) < 3, "").otherwise(F.concat(F.upper(F.left(token, F.lit(1))), F.lower(F.substring(token, 2, 1 << 30))))


def outline_path(path: Column) -> Column:
    return F.coalesce(F.array_join(path, " > "), F.lit(""))


def doc_id_of_chunk(chunk_id: Column, source_type: Column) -> Column:
    """The document part of a chunk id; empty if the source doesn't match."""
    prefix = F.concat(source_type, F.lit("__"))
    body = F.substring(chunk_id, F.length(prefix) + 1, F.length(chunk_id))
    rest = r"(_(h[234]_\d{4}|page_\d{4}|overflow|nooutline)_recursive_\d{4}|_h[234]_\d{4}|_page_\d{4})$"
    return F.when(F.startswith(chunk_id, prefix), F.regexp_replace(body, rest, "")).otherwise("")


def valid_keywords(keywords: Column, least: int = 2, most: int = 60) -> Column:
    return F.filter(keywords, lambda k: F.length(strip(k)).between(least, most))


def joined_keywords(keywords: Column) -> Column:
    return F.array_join(F.transform(keywords, strip), ",")


def terms(text: Column) -> Column:
    """Lower-cased search terms, repeats kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def epoch_date(seconds: Column) -> Column:
    """ISO date (UTC) of epoch seconds; out of range: empty."""
    ok = seconds.between(-62135596800, 253402300799)
    return F.coalesce(F.when(ok, F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")), "yyyy-MM-dd")), F.lit(""))


def iso_date(text: Column) -> Column:
    """Date of the first ten characters if they are YYYY-MM-DD, else null."""
    t = F.substring(strip(text), 1, 10)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd"))


def is_missing(value: Column) -> Column:
    v = value.try_cast("double")
    return v.isNull() | F.isnan(v)


def signed_percent(value: Column) -> Column:
    return F.when(value == 0, "0.0%").when(value > 0, F.format_string("+%.1f%%", value)).when(value < 0, F.format_string("%.1f%%", value))


def split_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(split_words(text))


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(split_words(text), 1, n), " ")


def uninformative_subject(subject: Column) -> Column:
    s = strip(F.coalesce(subject, F.lit("")))
    return (s == "") | (F.length(strip(F.regexp_replace(s, REPLY, ""))) < 3)


def has_mojibake(text: Column) -> Column:
    return F.coalesce(text.rlike(MOJIBAKE), F.lit(False))


def has_caption(text: Column) -> Column:
    return F.coalesce(text.rlike(CAPTION), F.lit(False))


def slug(text: Column, most: int = 30) -> Column:
    s = F.btrim(F.substring(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), 1, most), F.lit("_"))
    return F.when(s == "", "query").otherwise(s)


def data_url(kind: Column, payload: Column) -> Column:
    return F.concat(F.lit("data:image/"), kind, F.lit(";base64,"), F.base64(payload))


def relative_path(path: Column, root: str) -> Column:
    root = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(root)), F.replace(F.substring(path, len(root) + 1, 1 << 30), F.lit("\\"), F.lit("/"))).otherwise(path)


def aspect_ratio(width: Column, height: Column) -> Column:
    return F.round(width / F.greatest(height, F.lit(1)), 2)


def is_relevant_image(width: Column, height: Column, least: int = 300) -> Column:
    return F.greatest(width, height) >= least
