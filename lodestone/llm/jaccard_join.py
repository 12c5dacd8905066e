"""Near-duplicate texts by Jaccard similarity of word shingles: a MinHash LSH forest, then exact verification.

Texts with equal shingle sets are one class.  Each class has ``TREES`` labels of
``MAX_DEPTH`` MinHash values.  A label is one number, the tree in its highest
bits and then value after value, so labels in order are the tree's prefix trie:
a node of some depth is a stretch of labels that agree in their first bits, and
a prefix is shortened by clearing bits.

Matching begins at whole labels.  The classes under one node are verified on
their whole sets, each pair in the first tree where it meets.  From the
similarities found, and the chance that a pair of such similarity meets at the
present depths, follows how many pairs were missed: the measured recall.  While
it is below the target, prefixes are shortened, tree by tree, as far as the
target needs, and only pairs that didn't meet before are verified.  No prefix is
shorter than the depth at which even a pair at the threshold meets with the
target recall.  A node that holds the same classes as one of an earlier tree or
round is left out, and so are the classes of a node that meet nobody new there.

Words are ``[^\\x20\\x09-\\x0D]+``, as they stand.  Defined results: a text of
fewer words than a shingle has one shingle of all its words; a null text or one
without words links with nothing; repeated rows count as documents; a null id
never names a class unless it is alone; an empty table gives an empty result;
other columns are ignored (or carried on by ``drop_near_copies``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, released, saved, sized
from .components import connected_components
from .tiles import FOUND, dealt, each_group, found_rows, pairs_of

WORDS, THRESHOLD = 5, 0.8
TREES, MAX_DEPTH, TARGET_RECALL = 24, 8, 0.9999
#: Of a label's 64 bits: the tree, and each value below the least depth; the values down to that depth share the rest.
TREE_BITS, VALUE_BITS = 5, 8
BINS = 20  # of similarity, from the threshold to 1
_WORD = re.compile("[^\x20\x09-\x0d]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)
_CELLS = 8_000_000  # of the matrix that a tile is verified with at a time


def forest_recall(threshold: float, depth: int, trees: int) -> float:
    """The chance that a pair of this similarity shares a prefix of ``depth`` values in some tree."""
    return 1 - (1 - threshold**depth) ** trees


def forest_depth(threshold: float, trees: int = TREES, max_depth: int = MAX_DEPTH, target: float = TARGET_RECALL) -> int:
    """The longest prefix that reaches the target recall."""
    depth = max_depth
    while depth > 1 and forest_recall(threshold, depth, trees) < target:
        depth -= 1
    return depth


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit shingle hashes of a text."""
    words = _WORD.findall(text) if text else []
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, np.uint64(k))
    for i in range(k):
        h = h * _MULT + w[i : len(w) - k + 1 + i]
    return np.unique(_mix(h))


def hash_functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of the MinHash functions, the same in every run."""
    rng = np.random.Generator(np.random.PCG64(20_240_817))
    return rng.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, count, dtype=np.uint64)


def minhash(s: np.ndarray, mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The MinHash values of a set of hashes."""
    least = np.full(len(mult), np.iinfo(np.uint64).max)
    for at in range(0, len(s), 2048):
        least = np.minimum(least, (mult[:, None] * s[None, at : at + 2048] + add[:, None]).min(axis=1))
    return least


def labels(values: np.ndarray, least: int, trees: int) -> np.ndarray:
    """One label a tree: its number, its first ``least`` values together, and its other values."""
    v = (values >> np.uint64(20)).reshape(trees, -1)
    rest = v.shape[1] - least
    key = np.arange(1, trees + 1, dtype=np.uint64)
    for d in range(least):
        key = _mix(key * _MULT + v[:, d])
    below = np.uint64(VALUE_BITS * rest)
    key = (key >> np.uint64(TREE_BITS) >> below << below) | (np.arange(trees, dtype=np.uint64) << np.uint64(64 - TREE_BITS))
    for d in range(rest):
        key |= (_mix(v[:, least + d]) >> np.uint64(64 - VALUE_BITS)) << np.uint64(VALUE_BITS * (rest - 1 - d))
    return key.view(np.int64)


def _shifts(depths: list[int], max_depth: int) -> np.ndarray:
    """How many bits of each tree's labels lie below its depth."""
    return np.array([VALUE_BITS * (max_depth - d) for d in depths], np.int64)


def _node(key, depths: list[int], max_depth: int):
    """The label's prefix at its tree's depth."""
    shift = F.element_at(F.array(*[F.lit(int(s)) for s in _shifts(depths, max_depth)]), (F.shiftrightunsigned(key, 64 - TREE_BITS) + 1).cast("int"))
    return F.call_function("shiftleft", F.call_function("shiftright", key, shift), shift)


def meeting_chance(s: np.ndarray, depths: list[int]) -> np.ndarray:
    """The chance that a pair of similarity ``s`` shares a prefix of the given depth in some tree."""
    return 1 - np.prod([1 - s**d for d in depths], axis=0)


def measured_recall(found: np.ndarray, at: np.ndarray, depths: list[int], new: list[int] | None = None) -> float:
    """Share of all pairs that meet at the depths ``new``, if ``found`` pairs of similarity ``at`` met at ``depths``."""
    every = found / meeting_chance(at, depths)
    met = found if new is None else every * meeting_chance(at, new)
    return float(met.sum() / every.sum()) if every.sum() else 0.0


def shortened(found: np.ndarray, at: np.ndarray, depths: list[int], least: int, target: float) -> list[int]:
    """Depths at which half of what the target may miss is missed; one less everywhere where nothing was found."""
    if not found.sum():
        return [max(least, d - 1) for d in depths]
    new = list(depths)
    while measured_recall(found, at, depths, new) < (1 + target) / 2 and max(new) > least:
        new[len(new) - 1 - new[::-1].index(max(new))] -= 1
    return new


def signed(docs: DataFrame, least: int, words: int = WORDS, trees: int = TREES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``doc_id, tkey`` (hash of the text), ``skey`` (digest of the shingle set, null if empty), ``keys`` (labels)."""
    if trees > 1 << TREE_BITS or VALUE_BITS * (max_depth - least) > 32:
        raise ValueError("labels have no room for so many trees or so deep ones")
    mult, add = hash_functions(trees * max_depth)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            skeys, keys = [], []
            for text in b["text"]:
                s = shingles(text if isinstance(text, str) else None, words)
                if len(s):
                    skeys.append(xxhash.xxh3_128_digest(s.tobytes()))
                    keys.append(labels(minhash(s, mult, add), least, trees))
                else:
                    skeys.append(None)
                    keys.append(None)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "tkey": b["tkey"], "skey": pd.Series(skeys, dtype=object, index=b.index), "keys": pd.Series(keys, dtype=object, index=b.index)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tkey"), F.col("text").alias("text"))
    return rows.mapInPandas(released(sign), "doc_id long, tkey long, skey binary, keys array<long>")


def _new_pairs(tile: pd.DataFrame, i: np.ndarray, j: np.ndarray, before: np.ndarray | None, now: np.ndarray) -> np.ndarray:
    """Which pairs of a tile meet in no earlier round, and in no earlier tree of this one."""
    keys, tree = np.stack(tile["keys"].to_numpy()).view(np.uint64), int(tile["node"].iat[0]) >> (64 - TREE_BITS) & ((1 << TREE_BITS) - 1)
    new = np.ones(len(i), bool)
    for shifts, trees in ((before, keys.shape[1]), (now, tree)):
        if shifts is not None:
            for t in range(trees):
                prefix = keys[:, t] >> np.uint64(shifts[t])
                new &= prefix[i] != prefix[j]
    return new


def _similar(tile: pd.DataFrame, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of a tile at the threshold or above, and their similarity, from their whole sets."""
    sets = [np.frombuffer(x, np.uint64) for x in tile["shingles"]]
    n = np.array([len(s) for s in sets])
    values, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n)
    shared = count[inverse] > 1
    row, col = row[shared], (np.cumsum(count > 1) - 1)[inverse[shared]]
    width, step = int((count > 1).sum()), max(1, _CELLS // len(sets))
    both = np.zeros((len(sets), len(sets)), np.float64)
    order = np.argsort(col, kind="stable") if width > step else slice(None)
    row, col = row[order], col[order]
    for at in range(0, width, step):
        part = slice(*np.searchsorted(col, [at, at + step])) if width > step else slice(None)
        m = np.zeros((len(sets), min(step, width - at)), np.float32)
        m[row[part], col[part] - at] = 1
        both += m @ m.T
    union = n[:, None] + n[None, :] - both
    i, j = np.nonzero(np.triu(both >= threshold * union - 1e-9, 1))
    return i, j, both[i, j] / union[i, j]


def classes(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, trees: int = TREES, max_depth: int = MAX_DEPTH, target: float = TARGET_RECALL) -> tuple[DataFrame, DataFrame]:
    """The signed documents, and one row per shingle set: ``skey, size, links, component, class_id``.

    ``links`` is the number of documents with another set at the threshold or
    above, ``class_id`` the smallest id that links lead to.
    """
    least = forest_depth(threshold, trees, max_depth, target)
    rows = saved(signed(docs, least, words, trees, max_depth), "signed")
    reps = (
        rows.where(F.col("skey").isNotNull())
        .groupBy("skey", "keys")
        .agg(F.count("*").alias("size"), F.min("doc_id").alias("min_id"), F.min(F.struct("tkey", "doc_id")).alias("pick"))
        .withColumn("rid", F.monotonically_increasing_id())
    )
    reps = saved(reps, "shingle-sets")

    # the labels under nodes of the least depth that hold several; all classes are dealt by narrow rows only
    top = _node(F.col("key"), [least] * trees, max_depth).alias("top")
    trie = reps.select("rid", F.explode("keys").alias("key")).select("rid", "key", top)
    shared = saved(trie.groupBy("top").agg(F.count("*").alias("n")).where("n > 1").select("top"), "trie-nodes")
    trie = saved(trie.join(sized(shared), "top").select("key", "rid"), "trie")

    compared = saved(trie.select("rid").distinct().join(reps, "rid").select("rid", "size", "keys", "skey", F.col("pick.tkey").alias("tkey"), F.col("pick.doc_id").alias("pick_id")), "compared")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tkey"), "text")
    wanted = sized(compared.select(F.col("tkey").alias("k"), F.col("pick_id"), "rid", "skey"))
    texts = texts.join(wanted, (texts["tkey"] == wanted["k"]) & texts["doc_id"].eqNullSafe(wanted["pick_id"])).select("rid", "skey", "text")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()  # a repeated row gives its set once a task
        for b in batches:
            out = []
            for rid, skey, text in zip(b["rid"].tolist(), b["skey"], b["text"], strict=True):
                if rid not in seen:
                    found = shingles(text, words).tobytes()
                    if xxhash.xxh3_128_digest(found) == skey:
                        seen.add(rid)
                        out.append((rid, found))
            yield pd.DataFrame(out, columns=["rid", "shingles"])

    full = saved(texts.mapInPandas(released(sets), "rid long, shingles binary"), "compared-sets")
    narrow = compared.select("rid", "size", "keys")

    def nodes(depths: list[int]) -> DataFrame:
        """``node, tree, n, x, y`` of the nodes that hold several classes; x and y stand for the classes."""
        node = _node(F.col("key"), depths, max_depth)
        per = trie.select("rid", node.alias("node")).groupBy("node").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("rid")).alias("x"), F.bit_xor(F.xxhash64("rid", F.lit(1))).alias("y"))
        return per.where("n > 1").withColumn("tree", F.shiftrightunsigned("node", 64 - TREE_BITS))

    def matched(before: list[int] | None, depths: list[int]) -> DataFrame:
        """Links and edges of the pairs that meet at ``depths`` and not at those ``before``; rows (null, bin, n) count similarities."""
        now, then = _shifts(depths, max_depth), None if before is None else _shifts(before, max_depth)
        first = nodes(depths).groupBy("n", "x", "y").agg(F.min(F.struct("tree", "node")).alias("at"))
        if before is not None:
            first = first.join(nodes(before).select("n", "x", "y").distinct(), ["n", "x", "y"], "left_anti")
        first = saved(first.select("at.node", "n"), "first-nodes")
        members = trie.select("rid", _node(F.col("key"), depths, max_depth).alias("node")).join(sized(first), "node")

        def meeting(tile: pd.DataFrame) -> pd.DataFrame | None:
            if len(tile) < 2:
                return None
            i, j = pairs_of(tile, lambda t: np.triu_indices(len(t), 1))
            new = _new_pairs(tile, i, j, then, now)
            at = np.unique(np.concatenate([i[new], j[new]]))
            return tile.iloc[at][["node", "rid"]] if len(at) else None

        tiles = dealt(members.join(narrow, "rid"), ["node"], F.col("n"), "rid")
        left = saved(each_group(tiles, ["node", "ti", "tj"], meeting, "node long, rid long").distinct(), "meeting")
        n = left.groupBy("node").agg(F.count("*").alias("n"))
        whole = full.join(sized(saved(left.join(n, "node").join(narrow, "rid"), "members")), "rid")

        def verified(tile: pd.DataFrame) -> pd.DataFrame | None:
            tile = tile.drop_duplicates("rid")
            if len(tile) < 2:
                return None
            how: list[np.ndarray] = []

            def compare(t: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
                i, j, s = _similar(t, threshold)
                new = _new_pairs(t, i, j, then, now)
                if t["ti"].iat[0] != t["tj"].iat[0]:
                    chunk = t["chunk"].to_numpy()
                    new &= chunk[i] != chunk[j]
                how.append(s[new])
                return i[new], j[new]

            i, j = pairs_of(tile, compare)
            if not len(i):
                return None
            bins = np.bincount(np.clip(((how[0] - threshold) / (1 - threshold) * BINS).astype(int), 0, BINS - 1), minlength=BINS)
            at = np.flatnonzero(bins)
            counts = pd.DataFrame({"a": pd.array([None] * len(at), dtype="Int64"), "b": pd.array(at, dtype="Int64"), "w": pd.array(bins[at], dtype="Int64")})
            return pd.concat([found_rows(tile, i, j, "rid", "size"), counts])

        return saved(each_group(dealt(whole, ["node"], F.col("n"), "rid"), ["node", "ti", "tj"], verified, FOUND), "links")

    at, count = np.linspace(threshold, 1, BINS, endpoint=False), np.zeros(BINS)
    before, depths, found = None, [max_depth] * trees, None
    while True:
        new = matched(before, depths)
        for r in new.where(F.col("a").isNull()).groupBy("b").agg(F.sum("w").alias("w")).collect():  # at most BINS rows
            count[r["b"]] += r["w"]
        found = new if found is None else found.unionByName(new)
        if max(depths) <= least or count.sum() and measured_recall(count, at, depths) >= target:
            break
        before, depths = depths, shortened(count, at, depths, least, target)

    found = found.where(F.col("a").isNotNull())
    links = found.where(F.col("b").isNull()).groupBy(F.col("a").alias("rid")).agg(F.sum("w").alias("links"))
    parts = connected_components(found.where(F.col("b").isNotNull()))
    named = reps.select("rid", "skey", "size", "min_id").join(parts.withColumnRenamed("node", "rid"), "rid", "left")
    names = saved(named.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("min_id").alias("class_id")), "class-names")
    out = hot_join(named.join(links, "rid", "left"), names, "component")
    alone = F.col("component").isNull()
    out = out.select("skey", "size", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rid").alias("component"), F.when(alone, F.col("min_id")).otherwise(F.col("class_id")).alias("class_id"))
    return rows, saved(out, "classes")


def near_copies(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """One row per document: ``doc_id, class_id, n_links, kept``.

    ``class_id`` is the smallest id of the document's class, ``n_links`` the
    number of other documents that it is linked with directly.
    """
    rows, sets = classes(docs, threshold, words)
    out = rows.select("doc_id", "skey").join(sets, "skey", "left")
    named = F.when(F.col("skey").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return out.select(
        "doc_id",
        named.alias("class_id"),
        F.coalesce(F.col("links") + F.col("size") - 1, F.lit(0)).alias("n_links"),
        F.col("doc_id").eqNullSafe(named).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """``docs`` with one document of each class, that of the smallest id, and its columns.

    Of rows with that id and text, one stays; documents without words stay.
    """
    rows, sets = classes(docs, threshold, words)
    named = rows.join(sets, "skey").groupBy("doc_id", "tkey", "component", "class_id").agg(F.count("*").alias("n"))
    first = F.col("doc_id").eqNullSafe(F.col("class_id"))
    # ids may repeat: of the texts of a class with its id, the first by hash stays
    named = saved(named, "class-members")
    best = saved(named.where(first).groupBy("component").agg(F.min("tkey").alias("best")), "class-firsts")
    named = saved(hot_join(named, best, "component").select("doc_id", "tkey", "n", (first & (F.col("tkey") == F.col("best"))).alias("stays")), "named")
    named = named.withColumn("stays", F.coalesce("stays", F.col("doc_id").isNull()))
    key = lambda d: d.select(F.col("doc_id").alias("_id"), F.col("tkey").alias("_tkey"))
    gone, twice = named.where(~F.col("stays")), named.where(F.col("stays") & (F.col("n") > 1))

    def matches(side: DataFrame):
        return F.col("doc_id").cast("long").eqNullSafe(side["_id"]) & (F.xxhash64("text") == side["_tkey"])

    g, t = sized(key(gone)), sized(key(twice))
    left = docs.join(g, matches(g), "left_anti")
    if not twice.limit(1).count():
        return left
    again = left.join(t, matches(t), "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(t, matches(t), "left_anti").unionByName(again)
