"""Text keys and normal forms, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(s: Column) -> Column:
    return F.when(F.trim(s) != "", s)


def canonical_name(s: Column) -> Column:
    """Lower case; letters, digits and commas stay, any other run is one blank. Null becomes empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), r"[^\p{L}\p{Nd},]+", " "))


def supplier_key(s: Column) -> Column:
    """Letters and digits in lower case."""
    return F.regexp_replace(F.lower(s), r"[^\p{L}\p{Nd}]+", "")


def score_norm(s: Column) -> Column:
    """Trimmed, lower case, single blanks."""
    return F.lower(F.trim(F.regexp_replace(s, r"\s+", " ")))


def heading_norm(s: Column) -> Column:
    """Lower case without anything but letters and digits, single blanks."""
    return F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{Nd}]+", " "))


def fold_german(s: Column) -> Column:
    """Umlauts spelled out, then only a-z and 0-9."""
    t = F.lower(s)
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.regexp_replace(t, "[^a-z0-9]+", "")


def title_if_upper(s: Column) -> Column:
    """Text without lower-case letters in title case: the first letter of each run of letters stays large."""
    runs = F.regexp_extract_all(s, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.when(s.rlike(r"\p{Ll}"), s).otherwise(F.array_join(F.transform(runs, lambda r: F.concat(F.substring(r, 1, 1), F.lower(F.substring(r, 2, 1_000_000)))), ""))


def search_terms(haystack: Column, terms: str) -> Column:
    """Whether every blank-separated term is contained, ignoring case; no term matches everything."""
    low, out = F.lower(haystack), F.lit(True)
    for t in terms.lower().split():
        out = out & F.contains(low, F.lit(t))
    return out


def edit_distance(a: Column, b: Column, most: int | None = None) -> Column:
    """Levenshtein distance; -1 beyond `most`."""
    return F.levenshtein(a, b) if most is None else F.levenshtein(a, b, most)


def one_edit(a: Column, b: Column) -> Column:
    return edit_distance(a, b, 1) >= 0


def split_of(key: Column, share: float = 0.1) -> Column:
    """'val' for the given share of keys by SHA-256, else 'train'; the same key always falls the same way."""
    bucket = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 12), 16, 10).cast("bigint") % 1000
    return F.when(bucket < int(share * 1000), "val").otherwise("train")


def valid_code(s: Column) -> Column:
    """Trade code: up to five digits, one more with one decimal."""
    return s.rlike(r"^\d{1,5}(\d\.\d)?$")


def valid_id(s: Column) -> Column:
    return s.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$") & ~F.contains(s, F.lit(".."))
