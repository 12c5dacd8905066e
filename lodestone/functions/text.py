"""Name normalisers and text similarity for entity matching."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that are written several ways, and digits of other scripts.
_FOLD_FROM, _FOLD_TO = "أإآٱىة٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "اااايه01234567890123456789"
_MARKS = "[ً-ْٰـ]"  # vowel signs and the lengthening stroke


def strict_name(c: Column) -> Column:
    """Lower case, folded letters and digits, other characters to single blanks."""
    t = F.translate(F.regexp_replace(F.lower(c.cast("string")), _MARKS, ""), _FOLD_FROM, _FOLD_TO)
    return F.nullif(F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " ")), F.lit(""))


def bare_name(c: Column) -> Column:
    """``strict_name`` whose words lack the definite article."""
    words = F.transform(F.split(strict_name(c), " "), lambda w: F.when(F.length(w) > 3, F.regexp_replace(w, "^ال", "")).otherwise(w))
    return F.array_join(words, " ")


def family_name(c: Column) -> Column:
    """``strict_name`` without its numbers, and the first of them behind ``#``."""
    s = strict_name(c)
    number = F.nullif(F.regexp_extract(s, r"(\d+)", 1), F.lit(""))
    base = F.trim(F.regexp_replace(F.regexp_replace(s, r"\d+", " "), " +", " "))
    return F.concat(base, F.coalesce(F.concat(F.lit("#"), number), F.lit("")))


def nfkc(c: Column) -> Column:
    """Unicode compatibility composition, which Spark has no function for."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: unicodedata.normalize("NFKC", x) if isinstance(x, str) else None)

    return run(c)


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words; 0 where there are none."""
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def sequence_ratio(a: Column, b: Column, autojunk: bool = False) -> Column:
    """Ratio of matching blocks (Ratcliff and Obershelp), by Arrow batches."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([SequenceMatcher(None, i, j, autojunk).ratio() if isinstance(i, str) and isinstance(j, str) else None for i, j in zip(x, y, strict=True)])

    return run(a, b)


def name_similarity(a: Column, b: Column) -> Column:
    """The best of sequence ratio and word overlap, with and without articles."""
    return F.greatest(sequence_ratio(strict_name(a), strict_name(b)), token_jaccard(strict_name(a), strict_name(b)), sequence_ratio(bare_name(a), bare_name(b)), token_jaccard(bare_name(a), bare_name(b)))
