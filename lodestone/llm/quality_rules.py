"""Quality rules with adaptive thresholds, in DataFrame expressions only.

Each text gets integer features.  Their distribution is kept per (language,
source) as a histogram sketch: a value below 128 counts in a bucket of its own,
a larger one in one of 64 buckets between two powers of two (relative error at
most 1/64).  Two sketches merge by adding counts, so partial aggregation,
salting and the merge from sources to languages to the whole corpus are plain
sums, and the result doesn't depend on the order of the rows.

A feature fails a text if it lies beyond the median of its group by more than
``SPREADS`` times the group's spread on the inner side of the median (not less
than a floor).  The median and its inner spread hold still while under half of
a group is junk.  Groups of fewer than ``MIN_DOCS`` texts use the sketch of
their language, and languages of fewer that of the corpus.

Defined results: a null text has no words; a text of few words or mostly
repeated windows fails the base rule and stays out of the sketches; null
languages and sources are groups of their own; every input row gives one output
row, repeated rows included; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPACE, let, saved, sized

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MIN_DOCS, SPREADS = 30, 4

#: Feature: (least spread, whether low values fail as well as high ones).
#: Shares are in hundredths of a percent, the mean word length in hundredths of a character.
FLOORS = {
    "symbol_share": (200, False),
    "dup_line_share": (1000, False),
    "repeat_share": (1000, False),
    "word_length": (75, True),
}
LEVELS = (("lang", "source"), ("lang",), ())


def _repeat_words(words: Column) -> Column:
    """Words covered by three-word windows that occur twice or more; windows are told apart by a 64-bit hash."""

    def covered(grams):
        order = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def count(s):
            twice = F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["g"] == x["g"], F.lit(False)))
            at = F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
            return F.size(F.array_distinct(at))

        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), 0).otherwise(let(order, count))

    grams = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, 0).otherwise(let(grams, covered))


def text_features(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long) of one text."""
    text = F.coalesce(text, F.lit(""))
    bare = lambda s: F.translate(s, WORD_SPACE, "")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: bare(x) != "")
    by_words = let(words, lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r")))
    by_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    return let(
        F.struct(by_words.alias("w"), by_lines.alias("l")),
        lambda b: F.struct(
            b["w"]["n"].cast("long").alias("n_words"),
            F.length(bare(text)).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            b["l"]["n"].cast("long").alias("n_lines"),
            b["l"]["d"].cast("long").alias("n_dup_lines"),
            b["w"]["r"].cast("long").alias("n_repeat_words"),
        ),
    )


def base_failed(f: Column) -> Column:
    return (f["n_words"] < MIN_WORDS) | (f["n_repeat_words"] * 100 > f["n_words"] * MAX_REPEAT_PERCENT)


def _share(part: Column, whole: Column, scale: int) -> Column:
    return F.when(whole > 0, F.floor(part * scale / whole)).otherwise(0).cast("long")


def _measures(f: Column) -> dict[str, Column]:
    return {
        "symbol_share": _share(f["n_symbols"], f["word_chars"], 10_000),
        "dup_line_share": _share(f["n_dup_lines"], f["n_lines"], 10_000),
        "repeat_share": _share(f["n_repeat_words"], f["n_words"], 10_000),
        "word_length": _share(f["word_chars"], f["n_words"], 100),
    }


def bucket(v: Column) -> Column:
    """The smallest value of the sketch bucket that holds ``v``."""
    shift = F.greatest(F.length(F.bin(v)) - 7, F.lit(0))
    unit = F.call_function("shiftleft", F.lit(1).cast("long"), shift)
    return v - F.pmod(v, unit)


def sketches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Histogram sketches ``keys, feature, value, n`` of the columns named in FLOORS."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), bucket(F.col(k)).alias("value")) for k in FLOORS]))
    return rows.select(*keys, pairs.alias("p")).groupBy(*keys, "p.feature", "p.value").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups."""
    return sketch.groupBy(*keys, "feature", "value").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, number of texts, and a low and high fence a feature, from a sketch."""
    from pyspark.sql import Window

    group = Window.partitionBy(*keys, "feature")
    upto = group.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = sketch.withColumn("total", F.sum("n").over(group)).withColumn("upto", F.sum("n").over(upto))
    at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("value")))
    quart = seen.groupBy(*keys, "feature").agg(F.max("total").alias("n_docs"), at(1).alias("q1"), at(2).alias("q2"), at(3).alias("q3"))
    cols = [F.max("n_docs").alias("n_docs")]
    for name, (floor, both) in FLOORS.items():
        mine = lambda c, name=name: F.max(F.when(F.col("feature") == name, c))
        cols.append(mine(F.col("q2") + SPREADS * F.greatest(F.col("q2") - F.col("q1"), F.lit(floor))).alias(f"{name}_high"))
        low = F.col("q2") - SPREADS * F.greatest(F.col("q3") - F.col("q2"), F.lit(floor)) if both else F.lit(0)
        cols.append(mine(low.cast("long")).alias(f"{name}_low"))
    return quart.groupBy(*keys).agg(*cols)


def thresholds(measured: DataFrame) -> list[DataFrame]:
    """Fences by (lang, source), by lang, and of the corpus; ``measured`` lacks base failures."""
    finest = sketches(measured, list(LEVELS[0]))
    finest = saved(finest, "quality-sketches")
    return [fences(merged(finest, list(keys)) if keys != LEVELS[0] else finest, list(keys)) for keys in LEVELS]


def with_verdict(measured: DataFrame, by_level: list[DataFrame]) -> DataFrame:
    """``measured`` with ``kept``; it has lang, source, base_failed and the features."""
    out = measured
    for i, (keys, f) in enumerate(zip(LEVELS, by_level, strict=True)):
        cols = [c for c in f.columns if c not in keys]
        f = sized(f.select(*[F.col(k).alias(f"_k{i}_{k}") for k in keys], F.struct(*cols).alias(f"_f{i}")))
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_k{i}_{k}"))
        out = out.join(F.broadcast(f) if not keys else f, on, "left").drop(*[f"_k{i}_{k}" for k in keys])
    enough = [F.when(F.col(f"_f{i}.n_docs") >= (MIN_DOCS if keys else 0), F.col(f"_f{i}")) for i, keys in enumerate(LEVELS)]
    fence = F.coalesce(*enough)
    ok = F.lit(True)
    for name, (_, both) in FLOORS.items():
        ok = ok & (F.col(name) <= fence[f"{name}_high"])
        ok = ok & (F.col(name) >= fence[f"{name}_low"]) if both else ok
    # one CASE, so that no part of it is pushed below the projection that computes the features
    kept = F.when(F.col("base_failed"), False).otherwise(F.coalesce(ok, F.lit(True)))
    return out.withColumn("kept", kept).drop(*[f"_f{i}" for i in range(len(LEVELS))])


def _measured(docs: DataFrame, *carry: Column) -> DataFrame:
    f = F.col("_f")
    return (
        docs.select(*carry, F.col("lang").alias("lang"), F.col("source").alias("source"), text_features(F.col("text")).alias("_f"))
        .select("*", *[c.alias(k) for k, c in _measures(f).items()], base_failed(f).alias("base_failed"))
    )


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per document: its features, ``base_failed`` and ``kept``.

    The texts are read once: the features go to a narrow table in the shared
    folder, from which the sketches and the verdicts are made.
    """
    rows = saved(_measured(docs, F.col("doc_id")).select("doc_id", "lang", "source", "_f.*", *FLOORS, "base_failed"), "quality-features")
    return with_verdict(rows, thresholds(rows.where(~F.col("base_failed"))))


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns they had.

    The features are computed once: the rows are written to the shared folder
    with their features beside them, and the sketches and verdicts are made from
    that table.  Rows aren't shuffled.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = saved(_measured(docs, whole).drop("_f"), "quality-rows")
    return with_verdict(rows, thresholds(rows.where(~F.col("base_failed")))).where("kept").select("_row.*")
