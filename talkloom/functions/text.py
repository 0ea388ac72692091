"""Text and time expressions. All are Spark columns but similarity(), which needs longest-matching-block semantics."""

from __future__ import annotations

import difflib
import html

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

# fixed values: Python's letter and word classes in Java's syntax
LETTERS = r"([\p{L}\p{No}\p{Nl}]+)"
# fixed values: how a remark of a model, in place of a correction, begins
COMMENTARY = "^(here (is|are)|sure[,!]|corrected|note:|i )"
WORDS = r"([\p{L}\p{N}_]+)"
ON_SCREEN = r"([\p{L}\p{No}\p{Nl}][\p{L}\p{N}_./-]{2,})"
# fixed values: words that mark a line as holding a credential
CREDENTIAL = r"(?i)\b(password|passwd|heslo|token|api[_-]?key|secret|bearer|authorization|client[_-]?secret|private[_-]?key)\b"


def letter_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(LETTERS), F.lit(1))


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(1))


def screen_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ON_SCREEN), F.lit(1))


def split_words(text: Column) -> Column:
    """White-space words; none for an empty text."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clock(ms: Column) -> Column:
    """HH:MM:SS of milliseconds, rounded half to even, 0 at least."""
    s = F.greatest(F.lit(0), F.bround(ms / 1000).cast("long"))
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def timestamp(ms: Column) -> Column:
    """HH:MM:SS.mmm of milliseconds."""
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms % 3600000 / 60000), F.floor(ms % 60000 / 1000), ms % 1000)


def duration_line(full: Column, used: Column, start: Column) -> Column:
    """What a transcript covers: the recording's length, or which part of it; milliseconds."""
    part = F.concat(clock(used), F.lit(" transcribed ("), clock(start), F.lit("–"), clock(start + used), F.lit(" of "), clock(full), F.lit(")"))
    return F.when((full > 0) & (used > 0) & (F.abs(used - full) > 1000), part).otherwise(clock(full))


def wrapped(words: Column, width: int = 42) -> Column:
    """Words on two lines: as many as fit on the first, the others on the second."""
    fits = lambda a, w: (a["b"] == "") & ((a["a"] == "") | (F.length(a["a"]) + 1 + F.length(w) <= width))
    add = lambda x, w: F.when(x == "", w).otherwise(F.concat(x, F.lit(" "), w))
    empty = F.struct(F.lit("").alias("a"), F.lit("").alias("b"))
    step = lambda a, w: F.struct(F.when(fits(a, w), add(a["a"], w)).otherwise(a["a"]).alias("a"), F.when(fits(a, w), a["b"]).otherwise(add(a["b"], w)).alias("b"))
    return F.aggregate(words, empty, step, lambda a: F.when(a["b"] == "", a["a"]).otherwise(F.concat(a["a"], F.lit("\n"), a["b"])))


def chunked(words: Column, budget: int = 84) -> Column:
    """Words in chunks of at most budget characters, first come first served."""
    last = lambda a: F.coalesce(F.get(a, F.size(a) - 1), F.lit(""))
    none = F.array().cast("array<string>")
    fits = lambda a, w: (F.size(a) > 0) & (F.length(last(a)) + 1 + F.length(w) <= budget)
    grown = lambda a, w: F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.concat(last(a), F.lit(" "), w)))
    return F.aggregate(words, none, lambda a, w: F.when(fits(a, w), grown(a, w)).otherwise(F.concat(a, F.array(w))))


def parse_timestamp(text: Column) -> Column:
    part = lambda i: F.regexp_extract(text, r"(\d{2}):(\d{2}):(\d{2})[.,](\d{3})", i).cast("long")
    return ((part(1) * 60 + part(2)) * 60 + part(3)) * 1000 + part(4)


def slug(text: Column) -> Column:
    s = F.regexp_replace(F.lower(text), r"[^a-z0-9\s_-]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[\s_]+", "-"), "-+", "-")
    s = F.regexp_replace(s, "^-|-$", "")
    return F.when(s == "", "recording").otherwise(s)


def _unescaped(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else html.unescape(x))


def unescape(text: Column) -> Column:
    """All entities of mark-up, named and numbered, once. Texts without an ampersand aren't sent to Python's table."""
    return F.coalesce(F.pandas_udf(_unescaped, "string")(F.when(F.contains(text, F.lit("&")), text)), text)


def split_terms(text: Column) -> Column:
    """Terms of a list with commas or line feeds between them: trimmed, each once, in order; no empty ones."""
    return F.array_distinct(F.filter(F.transform(F.split(text, r"[,\n]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != ""))


def escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape_marks(text: Column) -> Column:
    """What escape() writes, read back; other entities, and those without a semicolon, stay."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def safe_name(text: Column) -> Column:
    """A name without characters that have a meaning in the artifacts."""
    return squeeze(F.translate(text, "<>`\r\n", ""))


def clean_name(text: Column) -> Column:
    """safe_name() of a speaker's name in mark-up."""
    return safe_name(unescape(text))


def new_language(language: str, order) -> Column:
    """True where a language is known and another than the last known one before, by the window order."""
    last = F.last(F.nullif(language, F.lit("")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(F.col(language) != "", F.lit(False)) & ~F.col(language).eqNullSafe(last)


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


def strip_label(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s*[AB]\s*:\s*", "")


#: What a line with an entropic word has somewhere.
ENTROPIC_RUN = "[A-Za-z0-9+/_-]{20}"


def is_entropic(token: Column) -> Column:
    return token.rlike("^[A-Za-z0-9+/_-]{20,}$") & token.rlike("[0-9]") & token.rlike("[A-Za-z]")


def is_secret(token: Column, line: Column) -> Column:
    return line.rlike(CREDENTIAL) | is_entropic(token)


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def ratio(a: str, b: str) -> float:
    """Twice the characters in matching blocks over all characters."""
    return difflib.SequenceMatcher(None, a, b).ratio()


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


def similarity(a, b) -> Column:
    return F.pandas_udf(_ratios, "double")(a, b)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)
