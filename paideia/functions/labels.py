"""Label and title normalisation, ids and lexical similarity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tokens that labels drop.
STOP_TOKENS = ("the", "a", "an", "of", "and", "di", "del", "della", "delle", "dei", "degli", "la", "il", "lo", "le", "i", "gli", "un", "una", "s")


def tokens(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda t: t != "")


def normalize_label(label: Column) -> Column:
    plain = F.regexp_replace(F.lower(label), "’", "'")
    plain = F.regexp_replace(plain, r"'s(?![\p{L}\p{N}_])", "")
    plain = F.regexp_replace(plain, "[^a-z0-9àèéìòù]+", " ")
    return F.array_join(F.filter(F.split(plain, " "), lambda t: (t != "") & ~t.isin(*STOP_TOKENS)), " ")


def node_id(kind: Column, label: Column) -> Column:
    """Kind and twelve digits of a hash; labels without a normal form are told apart by themselves."""
    normal = normalize_label(label)
    name = F.when(normal == "", label).otherwise(normal)
    return F.concat(kind, F.lit(":"), F.substring(F.sha1(F.concat(kind, F.lit(":"), name).cast("binary")), 1, 12))


def normalize_text(value: Column) -> Column:
    """The form in which fields are searched."""
    plain = F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"[^\p{L}\p{N}_\s=+\-*/^().,]", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def lexical_similarity(a: Column, b: Column) -> Column:
    """Similarity of two normal forms: equal, contained, or shared tokens."""
    longer = F.greatest(F.length(a), F.length(b))
    shorter = F.least(F.length(a), F.length(b))
    s, t = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    shared = F.size(F.array_intersect(s, t)) / F.size(F.array_union(s, t))
    return (
        F.when((a == "") | (b == ""), 0.0)
        .when(a == b, 1.0)
        .when(a.contains(b) | b.contains(a), F.greatest(F.lit(0.86), shorter / longer))
        .otherwise(shared)
    )


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def token_estimate(text: Column) -> Column:
    words = word_count(text)
    return F.when(words == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(words * 0.75).cast("int")))


def sanitize_title(title: Column) -> Column:
    flat = stripped(F.regexp_replace(F.regexp_replace(title, r"[\r\n]", " "), r"\s{2,}", " "))
    return F.when(flat == "", "Untitled").otherwise(F.substring(flat, 1, 120))


def short_hash(text: Column, digits: int) -> Column:
    return F.substring(F.sha1(text.cast("binary")), 1, digits)


def doc_id(title: Column) -> Column:
    """From a title or path: its last part without a suffix, and a hash of the whole."""
    name = F.regexp_replace(F.regexp_extract(title, "([^/]*)/*$", 1), r"^(.+)\.[^.]+$", "$1")
    stem = F.substring(F.regexp_replace(F.lower(name), " ", "_"), 1, 40)
    return F.concat(F.when(stem == "", "document").otherwise(stem), F.lit("_"), short_hash(title, 8))


def csv_items(text: Column) -> Column:
    """The items of a comma-separated argument, trimmed, without empty ones; null for null and empty text."""
    items = F.filter(F.transform(F.split(text, ","), stripped), lambda t: t != "")
    return F.when(F.coalesce(text, F.lit("")) != "", items)


def parse_iso(text: Column) -> Column:
    """A timestamp from ISO 8601 text (Z or an offset allowed); null for anything else."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(text), "Z$", "+00:00"))
