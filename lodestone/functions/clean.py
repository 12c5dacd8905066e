"""Column builders for cleaning: identifiers, text, typed casts, flags, small rules.

Missing values are NULL throughout; nothing here makes or keeps a NaN.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the key of what has none.
MISSING_KEY = "__MISSING__"
# Text that stands for nothing.
NULL_TOKENS = ("", "nan", "none", "null", "<na>")
# Fixed values of the policy rules.
HIGH_CREDITS, MAX_CREDITS, MAX_ITEMS, FAIL_CAP = 24, 25, 8, 120


def nan_to_null(c: Column) -> Column:
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def normalize_names(df: DataFrame) -> DataFrame:
    """Column names trimmed, other characters to ``_``, lower case; raises when two become equal."""
    import re

    names = [re.sub(r"[^0-9a-zA-Z]+", "_", c.strip()).strip("_").lower() for c in df.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"column names collide: {twice}")
    return df.toDF(*names)


def clean_text(c: Column) -> Column:
    """Trimmed text; blank is NULL."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def clean_code(c: Column) -> Column:
    """Trimmed upper-case code; text that stands for nothing is NULL."""
    t = F.trim(c.cast("string"))
    return F.when(F.lower(t).isin(*NULL_TOKENS), None).otherwise(F.upper(t))


def clean_id(c: Column) -> Column:
    """Identifier text without a useless decimal zero: ``123.0`` is ``123``, ``15.111`` stays."""
    t = clean_text(c)
    t = F.when(F.lower(t).isin(*NULL_TOKENS), None).otherwise(t)
    return F.regexp_replace(t, r"^([+-]?\d+)\.0+$", "$1")


def clean_numeric_id(c: Column) -> Column:
    """Identifier text of a number, written without an exponent."""
    return F.regexp_replace(c.cast("decimal(38,6)").cast("string"), r"\.?0+$", "")


def light_id(c: Column) -> Column:
    return F.regexp_replace(F.trim(c.cast("string")), r"\.0+$", "")


def sentinel_key(c: Column) -> Column:
    """A key that groups and joins when missing."""
    return F.coalesce(clean_text(c), F.lit(MISSING_KEY))


def id_parts(c: Column) -> Column:
    """Struct of raw, base and suffix of a dotted identifier."""
    t = clean_id(c)
    return F.struct(t.alias("raw"), F.substring_index(t, ".", 1).alias("base"), F.nullif(F.regexp_extract(t, r"\.(.+)$", 1), F.lit("")).alias("suffix"))


def id_suffix(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c.cast("string"), r"\.([^.]+)$", 1), F.lit(""))


def owner_from_ids(ids: Sequence[Column]) -> Column:
    """The first suffix found in dotted identifiers, in order."""
    return F.coalesce(*[id_suffix(c) for c in ids])


def owner_conflict(ids: Sequence[Column]) -> Column:
    """Whether the identifiers' suffixes differ."""
    return F.size(F.array_distinct(F.array_compact(F.array(*[id_suffix(c) for c in ids])))) > 1


def strict_int(c: Column) -> Column:
    """Nullable integer; NULL where the value isn't integral (count those with ``not_integral``)."""
    d = c.cast("string").try_cast("double")
    return F.when(F.abs(d - F.round(d)) <= 1e-9, F.round(d).cast("long"))


def not_integral(c: Column) -> Column:
    d = c.cast("string").try_cast("double")
    return clean_text(c).isNotNull() & (d.isNull() | (F.abs(d - F.round(d)) > 1e-9))


def lenient_double(c: Column) -> Column:
    return nan_to_null(c.cast("string").try_cast("double"))


def column_or(df: DataFrame, name: str, default, kind: str = "double") -> Column:
    """A column if the frame has it, else a constant."""
    return F.col(name).cast("string").try_cast(kind) if name in df.columns else F.lit(default).cast(kind)


def append_reason(reasons: Column, mask: Column, reason: str) -> Column:
    """``reasons`` with one more, `` | `` between."""
    return F.nullif(F.concat_ws(" | ", F.nullif(reasons, F.lit("")), F.when(mask, F.lit(reason))), F.lit(""))


def composite_key(*parts: Column) -> Column:
    """Parts joined by ``__``; NULL if any part is."""
    out = [parts[0].cast("string")]
    for p in parts[1:]:
        out += [F.lit("__"), p.cast("string")]
    return F.concat(*out)


def last_of_key(key: Column) -> Column:
    return F.substring_index(key, "__", -1)


def period_parts(c: Column) -> tuple[Column, Column]:
    """Year and term of a period code."""
    year = F.nullif(F.regexp_extract(c.cast("string"), r"(\d{4})\D*(\d+)", 1), F.lit(""))
    term = F.nullif(F.regexp_extract(c.cast("string"), r"(\d{4})\D*(\d+)", 2), F.lit(""))
    return year.cast("int"), term.cast("int")


def level_ordinal(text: Column, names: dict[str, int] | None = None, numeric: Column | None = None) -> Column:
    """Level 1..6: the first digit of the text (in Arabic-Indic figures too), a known name, a number, else 0."""
    t = F.translate(text.cast("string"), "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")
    found = [F.nullif(F.regexp_extract(t, "([1-6])", 1), F.lit("")).cast("int")]
    if names:
        by_name = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
        found.append(F.try_element_at(by_name, F.lower(F.trim(t))))
    if numeric is not None:
        found.append(F.when(numeric >= 0, numeric.cast("int")))
    return F.coalesce(*found, F.lit(0))


def requirement_share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def requirement_bucket(credits: Column) -> Column:
    """Right-closed size buckets: 0, to 12, to 24, to 60, above."""
    return F.when(credits.isNull() | (credits <= -0.01), None).when(credits <= 0, "none").when(credits <= 12, "small").when(credits <= 24, "medium").when(credits <= 60, "large").otherwise("very_large")


def fail_ratio(failed: Column, start: Column) -> Column:
    """Capped failed share of all credits; 0 without credits."""
    f = F.least(F.greatest(F.coalesce(failed, F.lit(0.0)), F.lit(0.0)), F.lit(float(FAIL_CAP)))
    whole = F.coalesce(start, F.lit(0.0)) + f
    return F.when(whole > 0, f / whole).otherwise(F.lit(0.0))


def policy_flags(item_credits: Column, period_credits: Column, period_items: Column, failed: Column) -> dict[str, Column]:
    """Policy and capped-history columns."""
    f = F.coalesce(failed, F.lit(0))
    over_c, over_n = F.coalesce(period_credits > MAX_CREDITS, F.lit(False)), F.coalesce(period_items > MAX_ITEMS, F.lit(False))
    return {
        "is_high_credit": F.coalesce(item_credits == HIGH_CREDITS, F.lit(False)).cast("int"),
        "over_credits": over_c.cast("int"),
        "over_items": over_n.cast("int"),
        "excluded": (over_c | over_n).cast("int"),
        "is_extreme_fail": (f > FAIL_CAP).cast("int"),
        "failed_capped": F.least(F.greatest(f, F.lit(0)), F.lit(FAIL_CAP)),
    }


def first_positive(named: Sequence[tuple[str, Column]]) -> tuple[Column, Column]:
    """The first value above 0 and its name; 0 and ``zero_fallback`` where there is none."""
    value, source = F.lit(0.0), F.lit("zero_fallback")
    for name, c in reversed(list(named)):
        has = F.coalesce(c > 0, F.lit(False))
        value, source = F.when(has, c).otherwise(value), F.when(has, F.lit(name)).otherwise(source)
    return value, source


def outcome(status: Column) -> Column:
    """P is passed; F, FE and FA are failed."""
    return F.when(status == "P", "passed").when(status.isin("F", "FE", "FA"), "failed")


def positive_flag(x: Column) -> Column:
    """1 or 0; NULL where unknown."""
    return (x > 0).cast("int")


def tri_state_changed(before: Column, after: Column) -> Column:
    return F.when(before.isNull() | after.isNull(), None).otherwise(before != after)


def allowed(flag: Column) -> Column:
    return F.coalesce(flag == "Y", F.lit(False))


def natural_key(c: Column) -> Column:
    """Sorts dotted identifiers by their numbers: numeric parts padded and before others."""
    part = lambda p: F.when(p.rlike(r"^\d+$"), F.concat(F.lit("0"), F.lpad(p, 20, "0"))).otherwise(F.concat(F.lit("1"), p))
    return F.transform(F.split(c, r"\."), part)


def split_of(period: Column, train_to: int = 20233, valid: tuple[int, int] = (20241, 20243), test: Iterable[int] = (20251,)) -> tuple[Column, Column]:
    """Split of a period, and why one is excluded."""
    split = F.when(period <= train_to, "train").when(period.between(*valid), "valid").when(period.isin(*test), "test").otherwise("excluded")
    reason = F.when(period.isNull(), "period_missing").when(split == "excluded", F.when(period > max(test), "after_test").otherwise("between_splits"))
    return F.when(period.isNull(), "excluded").otherwise(split), reason
