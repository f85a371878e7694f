"""Text normalisers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    """Drop leading and trailing white space of any kind."""
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def refuse(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """``df``, or a failed job where the condition holds, whatever columns are read later."""
    return df.filter(F.when(condition, F.raise_error(F.lit(message)).cast("boolean")).otherwise(True))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def citation_slug(c: Column) -> Column:
    """FN6: comparable slug of a citation in display or slug form."""
    text = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "§", " ")
    text = F.regexp_replace(text, r"(?U)\bu\s*\.?\s*s\s*\.?\s*c\.?", "usc")
    text = F.regexp_replace(text, r"(?U)\bc\s*\.?\s*f\s*\.?\s*r\.?", "cfr")
    return F.regexp_replace(F.regexp_replace(text, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def is_echoed(source_title: Column, source_text: Column, target_citation: Column) -> Column:
    """FN7: the whole target slug occurs in the slug of the source title and text."""
    needle = citation_slug(target_citation)
    body = F.concat(F.coalesce(source_title, F.lit("")), F.lit("\n"), F.coalesce(source_text, F.lit("")))
    return (needle != "") & F.contains(citation_slug(body), needle)


def tokens(c: Column) -> Column:
    """FN8: lower-case alphanumeric runs."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def token_count(c: Column) -> Column:
    """FN8: how many tokens, without the array of them."""
    return F.regexp_count(F.lower(c), F.lit("[a-z0-9]+"))


def counted(values: Column) -> Column:
    """Distinct values of an array with their counts, (term, tf); null if it is empty."""

    def runs(ordered: Column) -> Column:
        starts = F.array_compact(F.transform(ordered, lambda t, i: F.when((i == 0) | (t != F.get(ordered, i - 1)), i)))
        ends = lambda at: F.concat(F.slice(at, 2, F.size(at)), F.array(F.size(ordered)))
        one = lambda i, j: F.struct(F.get(ordered, i).alias("term"), (j - i).cast("long").alias("tf"))
        return F.when(F.size(ordered) > 0, let(starts, lambda at: F.zip_with(at, ends(at), one)))

    return let(F.sort_array(values), runs)


def norm_id(c: Column) -> Column:
    """FN9: trimmed upper-case identifier."""
    return F.upper(strip(c))


# Spellings of one licence and their common form.
LICENSE_SPELLINGS = ("cc-by-sa-4.0", "cc by-sa 4.0", "cc-by-sa-4")
LICENSE_FORM = "CC-BY-SA-4.0"


def norm_license(c: Column, form: str = LICENSE_FORM) -> Column:
    """FN9: known spellings to one form, others trimmed. For a list pass its first item."""
    key = F.regexp_replace(F.lower(strip(c)), "_", "-")
    return F.when(key.isin(*LICENSE_SPELLINGS), form).otherwise(strip(c))


# Public dataset names and their report groups.
SOURCE_PREFIXES = {"cais/mmlu:": "MMLU (8 subjects)"}
SOURCE_NAMES = {"allenai/ai2_arc:ARC-Easy": "ARC-Easy (pairwise)", "openai/gsm8k:main": "GSM8K"}


def source_group(
    c: Column, prefixes: Mapping[str, str] = SOURCE_PREFIXES, names: Mapping[str, str] = SOURCE_NAMES
) -> Column:
    """FN12: report group of a dataset name; an unknown name fails the job."""
    out = F.when(c.isNull(), F.raise_error("source name is missing").cast("string"))
    for prefix, group in prefixes.items():
        out = out.when(F.startswith(c, F.lit(prefix)), group)
    for name, group in names.items():
        out = out.when(c == name, group)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown source: "), c)).cast("string"))
