"""Secret scans with corpus-wide ownership.

Each text is scanned for three kinds of secrets by pattern (the base spans) and
for long mixed tokens that might be credentials (candidates).  The digests of
all found values are counted over the whole corpus by distinct repository and
owner: a value that several owners hold is a copied example, one that a single
owner holds looks live.  Candidates become spans (kind ``owned``) only if one
owner holds them; base spans always stay, and the report counts how many of a
document's spans look live and how many are shared.

``documents`` names no repositories and owners: unless other columns are given,
``source`` stands in for the owner and source and language for the repository.

Defined results: a null text is empty; a repeated row is a row of its own and
adds no owner; a null source is an owner of its own; an empty table gives an
empty result; positions are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_join, saved

KINDS = ("assign", "access", "hex", "owned")
OWNED = 3
ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # greedy: the runs of [0-9a-f]+ that have 24 or more
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
ASSIGN_CHARS, ACCESS_CHARS = 6, 20
#: Candidates need digits, letters and this many bits a character; a value of more owners is an example.
CANDIDATE_BITS, LIVE_OWNERS = 3.5, 1

SPAN = "array<struct<start:int,kind:int,end:int,digest:string>>"
SCANNED = f"base {SPAN}, extra {SPAN}"


def digest(value: str) -> str:
    return xxhash.xxh3_128_hexdigest(value.encode("utf-8", "surrogatepass"))


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) by start, then kind."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def _bits(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def candidate_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Mixed tokens that touch no assignment or access key and aren't within a hex run; one that is longer than its hex run is one."""
    named = [(s, e) for s, k, e, _ in base if k < 2]
    starts, reach = [s for s, _ in named], list(accumulate((e for _, e in named), max))
    runs = [(s, e) for s, k, e, _ in base if k == 2]
    out = []
    for m in CANDIDATE.finditer(text):
        at = bisect_left(starts, m.end())
        if at and reach[at - 1] > m.start():
            continue
        at = bisect_right(runs, (m.start(), len(text)))
        if at and runs[at - 1][1] >= m.end():
            continue
        v = m[0]
        if _DIGIT.search(v) and _LETTER.search(v) and _bits(v) >= CANDIDATE_BITS:
            out.append((m.start(), 3, m.end(), v))
    return out


def _scan_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    hashed = lambda spans: [{"start": s, "kind": k, "end": e, "digest": digest(v)} for s, k, e, v in spans]
    for texts in batches:
        rows = []
        for t in texts:
            t = t if isinstance(t, str) else ""
            base = base_spans(t)
            rows.append((hashed(base), hashed(candidate_spans(t, base))))
        yield pd.DataFrame(rows, columns=["base", "extra"])


def _scan(text: Column) -> Column:
    # not deterministic to the planner: a filter on its result must not run it a second time
    return F.pandas_udf(_scan_batches, SCANNED).asNondeterministic()(text)


def scanned(docs: DataFrame, *carry: Column, text: str = "text", repo: Column | None = None, owner: Column | None = None) -> DataFrame:
    """``carry`` columns, ``_repo``, ``_owner``, and the base and extra spans of each text."""
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", F.col("source"), F.col("lang")) if repo is None else repo
    none = F.lit("\x00")
    return docs.select(*carry, F.coalesce(repo, none).alias("_repo"), F.coalesce(owner, none).alias("_owner"), _scan(F.col(text)).alias("_s")).select(
        "*", F.col("_s.base").alias("base"), F.col("_s.extra").alias("extra")
    ).drop("_s")


def ownership(found: DataFrame) -> DataFrame:
    """``digest, n_repos, n_owners, n_spans, live`` of every found value.

    Grouped by (digest, owner, repository) first, so a value that a third of
    all rows hold is one row a task before it is shuffled.
    """
    values = found.select("_repo", "_owner", F.explode(F.concat("base", "extra")).alias("v"))
    held = values.groupBy(F.col("v.digest").alias("digest"), "_owner", "_repo").agg(F.count("*").alias("n"))
    owners = held.groupBy("digest", "_owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return owners.groupBy("digest").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"), F.sum("n").alias("n_spans")).withColumn("live", F.col("n_owners") <= LIVE_OWNERS)


def spans_string(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), one), ",")


def with_owned(found: DataFrame, owners: DataFrame, counted: bool = False) -> DataFrame:
    """``found``, a saved table, with ``owned``: the extra spans that one owner holds.

    With ``counted`` also ``n_live`` and ``n_shared``: the document's base and
    owned spans whose value one owner holds, and its spans whose value several
    do.  Rows without such spans don't take part in the join, in which a value
    that many rows hold is dealt to several tasks.
    """
    some = F.size("extra") + (F.size("base") if counted else F.lit(0)) > 0
    none = F.expr(f"cast(array() as {SPAN})")
    rest = found.where(~some).withColumn("owned", none)
    named = saved(found.where(some).withColumn("_uid", F.monotonically_increasing_id()), "secret-rows")
    spans = F.concat("base", "extra") if counted else F.col("extra")
    each = named.select("_uid", F.explode(spans).alias("x")).withColumn("digest", F.col("x.digest"))
    each = hot_join(each, owners.select("digest", "live"), "digest")
    own = F.collect_list(F.when(F.col("live") & (F.col("x.kind") == OWNED), F.col("x")))
    back = each.groupBy("_uid").agg(F.array_sort(own).alias("owned"), F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_shared"))
    out = named.join(back, "_uid").drop("_uid")
    if not counted:
        return rest.unionByName(out.drop("n_live", "n_shared"))
    zero = F.lit(0).cast("long")
    return rest.withColumn("n_live", zero).withColumn("n_shared", zero).unionByName(out)


def secret_report(docs: DataFrame) -> DataFrame:
    """One row per document: counts of base spans, their digest, all spans, and how many of the values look live or are shared."""
    found = saved(scanned(docs, F.col("doc_id")), "secrets")
    rows = with_owned(found, saved(ownership(found), "secret-owners"), counted=True)
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return rows.select("doc_id", n(0), n(1), n(2), F.sha2(spans_string(F.col("base")), 256).alias("base_sha256"), spans_string(F.concat("base", "owned")).alias("spans"), "n_live", "n_shared")


def findings(docs: DataFrame) -> DataFrame:
    """One row per span: doc_id, kind, start, end, digest, n_repos, n_owners, live."""
    found = saved(scanned(docs, F.col("doc_id")), "secrets")
    owners = saved(ownership(found), "secret-owners")
    spans = with_owned(found, owners).select("doc_id", F.explode(F.concat("base", "owned")).alias("v"))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    flat = spans.select("doc_id", F.get(kinds, F.col("v.kind")).alias("kind"), "v.start", "v.end", F.col("v.digest").alias("digest"))
    return hot_join(flat, owners, "digest").select("doc_id", "kind", "start", "end", "digest", "n_repos", "n_owners", "live")


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each (start, kind, end) replaced by ``[REDACTED:kind]``; overlapping spans become one, of the first's kind."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[REDACTED:{KINDS[kind]}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _redact(text: Column, spans: Column) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series([redacted(t, list(zip(s.tolist(), k.tolist(), e.tolist(), strict=True))) for t, s, k, e in zip(*columns, strict=True)])

    return run(text, F.transform(spans, lambda s: s["start"]), F.transform(spans, lambda s: s["kind"]), F.transform(spans, lambda s: s["end"]))


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with all spans of ``text`` redacted and ``n_chars`` set anew where a text changed.

    Texts are scanned once: rows are written to the shared folder with their
    spans beside them.  They aren't shuffled, but for those that hold candidates.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = saved(scanned(docs, whole), "secrets")
    rows = with_owned(rows, saved(ownership(rows), "secret-owners"))
    some = F.size("base") + F.size("owned") > 0
    changed = rows.where(some).withColumn("_new", _redact(F.col("_row.text"), F.concat("base", "owned")))
    rows = rows.where(~some).withColumn("_new", F.col("_row.text")).unionByName(changed)
    put = {c: F.col(f"_row.`{c}`") for c in docs.columns}
    put["text"] = F.col("_new")
    if "n_chars" in put:
        put["n_chars"] = F.when(F.col("_new").eqNullSafe(F.col("_row.text")), put["n_chars"]).otherwise(F.length("_new")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[c.alias(k) for k, c in put.items()])
