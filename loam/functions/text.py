"""Scalar text functions as Columns. Regular expressions are in Java's dialect; (?U) makes \\s, \\d and \\b Unicode-aware."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DEVANAGARI = "[\\x{0900}-\\x{097F}]"
#: Unicode's category Zs, which trim() takes in SQL; Spark's takes U+0020 only.
SPACE_SEPARATORS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
CJK = "[\\x{3040}-\\x{30FF}\\x{3400}-\\x{9FFF}\\x{AC00}-\\x{D7AF}]"


def words(text: Column) -> Column:
    """Words between white space; none for blank text."""
    return F.filter(F.split(text, "(?U)\\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def normalized(text: Column) -> Column:
    """Lower case with single spaces: the form in which texts count as equal."""
    return F.trim(F.regexp_replace(F.lower(text), "\\s+", " "))


def dedupe_key(text: Column) -> Column:
    return F.md5(normalized(text))


def text_hash(text: Column) -> Column:
    """First 20 hex digits of SHA-1."""
    return F.substring(F.sha1(text.cast("binary")), 1, 20)


def join_lines(text: Column) -> Column:
    """Words cut at a line end are joined, lines become one paragraph, runs of spaces one space."""
    text = F.regexp_replace(text, "([a-z])-\\n([a-z])", "$1$2")
    text = F.regexp_replace(text, "\\s*\\n\\s*", " ")
    return F.trim(F.regexp_replace(text, "\\s{2,}", " "))


def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))


def nfkc(text: Column) -> Column:
    """Unicode compatibility form; Spark has no function for it."""
    return F.pandas_udf(_nfkc, "string")(text)


def clean_block(text: Column) -> Column:
    """nfkc() then join_lines(); texts that are ASCII need no NFKC but pass the same way."""
    return join_lines(nfkc(text))


def edge_key(text: Column) -> Column:
    """Comparable form of a header or footer: numbers become #, 80 characters."""
    return F.substring(F.trim(F.regexp_replace(F.lower(text), "\\d+", "#")), 1, 80)


def visible_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "(?U)\\s", ""))


def share(text: Column, pattern: str) -> Column:
    """Share of visible characters that the pattern matches; 0 without any."""
    n = visible_length(text)
    return F.when(n > 0, F.regexp_count(text, F.lit(pattern)) / n).otherwise(0.0)


def page_language(text: Column) -> Column:
    """'' for a blank page, other for mainly CJK, ne for Devanagari, else en."""
    return F.when(visible_length(text) == 0, "").when(share(text, CJK) >= 0.2, "other").when(share(text, DEVANAGARI) >= 0.3, "ne").otherwise("en")


def has_legacy_font(text: Column) -> Column:
    """Garbled words as old non-Unicode fonts give them: 15 % of at least 20 words."""
    own = words(text)
    bad = F.size(F.filter(own, lambda w: w.rlike("[A-Za-z][\\]\\[;{}|][A-Za-z]")))
    return (F.size(own) >= 20) & (bad / F.size(own) >= 0.15)


def token_estimate(text: Column) -> Column:
    """Tokens without a tokenizer: 4 characters each, 2 in Devanagari, 1 at least."""
    d = F.regexp_count(text, F.lit(DEVANAGARI))
    return F.greatest(F.lit(1), F.floor((F.length(text) - d) / 4) + F.floor(d / 2)).cast("long")


def readable(name: Column) -> Column:
    """'01_Floods_GLOFs' becomes 'Floods GLOFs'; an extension goes."""
    name = F.regexp_replace(name, "(?<=[^.])\\.[^.]*$", "")
    return F.trim(F.translate(F.regexp_replace(name, "^\\d+_", ""), "_", " "))


def clean_year(year: Column) -> Column:
    """'0' and '1970' stand for unknown."""
    return F.when(F.trim(year).isin("0", "1970"), "").otherwise(F.trim(year))


def year_number(year: Column) -> Column:
    return F.when(year.rlike("^[0-9]+$"), year.cast("int")).otherwise(0)


def human_size(size: Column) -> Column:
    """1024-steps from B to PB, one decimal."""
    units = ["B", "KB", "MB", "GB", "TB"]
    out = F.lit(None)
    for k in reversed(range(5)):
        out = F.when(size < 1024 ** (k + 1), F.format_string(f"%.1f {units[k]}", size / 1024**k)).otherwise(out if k < 4 else F.format_string("%.1f PB", size / 1024**5))
    return out


def safe_name(name: Column) -> Column:
    """Characters that file systems refuse become _."""
    return F.regexp_replace(name, '[<>:"/\\\\|?*\\x00-\\x1F]', "_")


def local_path(path: Column) -> Column:
    """Parts made safe one by one; trailing spaces and dots go, an empty part becomes _."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    cleaned = F.transform(parts, lambda p: F.regexp_replace(safe_name(p), "[ .]+$", ""))
    return F.array_join(F.transform(cleaned, lambda p: F.when(p == "", "_").otherwise(p)), "/")


def html_escape(text: Column, quote: bool = True) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + [('"', "&quot;"), ("'", "&#x27;")] * quote
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def snippet(text: Column, limit: int = 600) -> Column:
    """One line of at most `limit` characters, cut at a space, escaped."""
    flat = F.trim(F.regexp_replace(text, "\\s+", " "))
    cut = F.concat(F.regexp_replace(F.substring(flat, 1, limit), "\\s\\S*$", ""), F.lit("…"))
    return html_escape(F.when(F.length(flat) > limit, cut).otherwise(flat))


def search_terms(text: Column) -> Column:
    """Runs of letters and digits, joined by spaces, for keyword search."""
    return F.array_join(F.filter(F.split(text, "(?U)[^\\w]+"), lambda w: w != ""), " ")


def guess_year(text: Column, name: Column) -> Column:
    """Largest year 1970-2030 in the first 2000 characters and the name; null if none. `_` is a word character."""
    found = F.regexp_extract_all(F.concat(F.substring(text, 1, 2000), F.lit(" "), name), F.lit("\\b((?:19|20)\\d{2})\\b"), F.lit(1))
    return F.array_max(F.filter(F.transform(found, lambda y: y.cast("int")), lambda y: y.between(1970, 2030)))


def guess_title(text: Column, name: Column) -> Column:
    """First of the first ten lines that is longer than 20 characters and no boilerplate, at most 200 characters."""
    # Not F.trim itself, which would take a line's number as the characters to trim.
    lines = F.slice(F.filter(F.transform(F.split(text, "\\n"), lambda x: F.trim(x, F.lit(SPACE_SEPARATORS))), lambda x: x != ""), 1, 10)
    # Java gives İ two characters in lower case, SQL an i.
    plain = lambda x: ~F.lower(F.translate(x, "İ", "i")).rlike("^(abstract|keywords|introduction)")
    return F.coalesce(F.substring(F.get(F.filter(lines, lambda x: (F.length(x) > 20) & plain(x)), F.lit(0)), 1, 200), name)


def present(text: Column, vocabulary: list[str]) -> Column:
    """The entries that stand in the text as substrings, in the vocabulary's order."""
    return F.filter(F.array(*map(F.lit, vocabulary)), lambda t: F.contains(text, t))


def themes(text: Column, keywords: dict[str, list[str]]) -> Column:
    """Themes of which some keyword stands in the text, in order."""
    flags = [F.when(F.greatest(*(F.contains(text, F.lit(k)) for k in ks), F.lit(False)), F.lit(name)) for name, ks in keywords.items()]
    return F.array_compact(F.array(*flags))
