"""Op 8 and op 3 against brute force over all pairs, and their edge cases."""

import math
import re

import numpy as np
import pytest

from lodestone.llm import embedding_dedup, jaccard_join
from lodestone.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string"


def brute_links(texts, threshold=0.8, k=5):
    sets = []
    for t in texts:
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        n = min(k, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    out = set()
    by_shingle = {}
    for i, s in enumerate(sets):
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    seen = {}
    for ids in by_shingle.values():
        for a, i in enumerate(ids):
            for j in ids[a + 1 :]:
                seen[i, j] = seen.get((i, j), 0) + 1
    for (i, j), both in seen.items():
        if both >= threshold * (len(sets[i]) + len(sets[j]) - both):
            out.add((i, j))
    return out


def groups(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_near_copies_equal_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
    ids, texts = zip(*rows, strict=True)
    links = brute_links(texts)
    part = groups(len(ids), links)
    n = [0] * len(ids)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    want = {(ids[i], ids[part[i]], n[i], part[i] == i) for i in range(len(ids))}
    got = {tuple(r) for r in jaccard_join.near_copies(docs).collect()}
    assert len(links) > 50
    assert got == want
    kept = jaccard_join.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(ids[i] for i in range(len(ids)) if part[i] == i)


def test_large_group_of_near_copies_meets_in_tiles(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(150):
        t = list(base)
        for p in rng.choice(300, 4, replace=False):
            t[p] = f"x{rng.integers(10**9)}"
        texts.append(" ".join(t))
    texts += texts[:40]
    monkeypatch.setattr("lodestone.llm.tiles.TILE", 32)
    links = brute_links(texts)
    n = np.zeros(len(texts), int)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "") for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r for r in jaccard_join.near_copies(docs).collect()}
    assert [got[i].n_links for i in range(len(texts))] == n.tolist()
    assert {r.class_id for r in got.values()} == {0}


def test_near_copies_edge_cases(spark):
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [
        (1, None, None, None, None, None),
        (2, "", "en", "s", 0, ""),
        (3, " \n\t ", "en", "s", 0, ""),
        (4, "one two", "en", "s", 0, ""),
        (5, "one  two", "en", "s", 0, ""),
        (6, long, "en", "s", 0, ""),
        (7, long + " more", "en", "s", 0, ""),
        (7, long + " more", "en", "s", 0, ""),
        (8, "a b c d e f", "en", "s", 0, ""),
        (8, "g h i j k l", "en", "s", 0, ""),
        (None, "g h i j k l", "en", "s", 0, ""),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted((r.doc_id or 0, r.class_id, r.n_links) for r in jaccard_join.near_copies(docs).collect())
    assert got == [(0, 8, 1), (1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 1), (5, 4, 1), (6, 6, 2), (7, 6, 2), (7, 6, 2), (8, 8, 0), (8, 8, 1)]
    kept = sorted((r.doc_id, (r.text or "")[:7]) for r in jaccard_join.drop_near_copies(docs).collect())
    assert kept == [(1, ""), (2, ""), (3, " \n\t "), (4, "one two"), (6, "word0 w"), (8, "a b c d"), (8, "g h i j")]
    twice = spark.createDataFrame([rows[7], rows[7]], DOCS)
    assert jaccard_join.drop_near_copies(twice).count() == 1
    empty = spark.createDataFrame([], DOCS)
    assert jaccard_join.near_copies(empty).count() == 0
    assert jaccard_join.drop_near_copies(empty).columns == empty.columns


def test_forest_depth_reaches_the_target():
    d = jaccard_join.forest_depth(0.8)
    assert jaccard_join.forest_recall(0.8, d, jaccard_join.TREES) >= jaccard_join.TARGET_RECALL
    assert jaccard_join.forest_recall(0.8, d + 1, jaccard_join.TREES) < jaccard_join.TARGET_RECALL


def test_components(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200 + i, 200) for i in range(1, 50)] + [(300, 300), (None, 1)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(101)} | {200 + i: 200 for i in range(50)}


def brute_vectors(rows, threshold=0.93):
    n = [0] * len(rows)
    links = []
    for i, (_, x, a) in enumerate(rows):
        for j in range(i):
            _, y, b = rows[j]
            if a is None or a != b or x is None or y is None or len(x) != len(y):
                continue
            if any(v is None or not math.isfinite(v) for v in [*x, *y]) or not any(x) or not any(y):
                continue
            x64, y64 = np.array(x, float), np.array(y, float)
            if x64 @ y64 / np.linalg.norm(x64) / np.linalg.norm(y64) >= threshold:
                links.append((j, i))
                n[i] += 1
                n[j] += 1
    return links, n


@pytest.mark.parametrize("noise", [0.02, 0.045])
def test_near_vectors_against_brute_force(spark, noise):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, 500, 5):
        x[i + 1 : i + 4] = x[i] + noise * rng.normal(size=(3, 64))
    x[600:650] = x[600] + 0.01 * rng.normal(size=(50, 64))
    x[660:670] = x[660] * 3
    label = [int(v) for v in rng.integers(0, 3, 700)]
    label[600:650] = [1] * 50
    rows = [(i, [float(np.float32(v)) for v in x[i]], label[i // 5 * 5] if i < 500 else label[i]) for i in range(700)]
    rows += [(700, None, 1), (701, [0.0] * 64, 1), (702, [None] * 64, 1), (703, [float("nan")] * 64, 1), (704, rows[0][1], None), (705, [1.0, 2.0], 1), (706, [2.0, 4.0], 1), (707, [], 1), (None, rows[1][1], rows[1][2])]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "vec_id long, embedding array<float>, label int, size string")
    links, n = brute_vectors(rows)
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(df).collect()}
    assert len(got) == len(rows)
    found = sum(got[r[0]].n_links for r in rows)
    assert found >= 0.995 * sum(n)
    assert all(got[r[0]].n_links <= k for r, k in zip(rows, n, strict=True))
    if found == sum(n):
        part = groups(len(rows), links)
        name = {}
        for i, p in enumerate(part):
            if rows[i][0] is not None:
                name[p] = min(name.get(p, 10**9), rows[i][0])
        assert all(got[rows[i][0]].component_id == name[p] for i, p in enumerate(part))


def test_near_vectors_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_vectors(empty).collect() == []


def test_table_plan_reaches_the_target():
    for n in (10, 5_000, 1_000_000):
        width, tables, rotations = embedding_dedup.plan_tables(n, target=0.99)
        agree = 1 - math.acos(0.93) / math.pi
        assert rotations == embedding_dedup.MAX_ROTATIONS or 1 - (1 - agree**width) ** (tables * rotations) >= 0.99


@pytest.mark.parametrize("bits", [2, 8, 12, 16, 32, 64])
def test_table_plan_reaches_the_target_at_any_size(bits):
    for n in (10, 5_000, 1_000_000, 5_000_000, 100_000_000, 10**10):
        width, tables, rotations = embedding_dedup.plan_tables(n, bits)
        agree = 1 - math.acos(embedding_dedup.THRESHOLD) / math.pi
        assert width * tables <= bits
        assert 1 - (1 - agree**width) ** (tables * rotations) >= embedding_dedup.TARGET_RECALL


def test_near_vectors_around_a_common_mean(spark):
    """Centred on the mean, near pairs are far apart in angle."""
    rng = np.random.default_rng(3)
    x = 0.35 * rng.normal(size=(400, 32)) / np.sqrt(32)
    x[:, 0] += 1
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    links, n = brute_vectors(rows)
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert len(links) > 1000
    assert sum(got.values()) >= 0.995 * sum(n)
    assert all(got[i] <= k for i, k in enumerate(n))


def test_prefixes_are_shortened_by_what_was_found():
    trees, least = 24, jaccard_join.forest_depth(0.8)
    at = np.linspace(0.8, 1, jaccard_join.BINS, endpoint=False)
    whole = [jaccard_join.MAX_DEPTH] * trees
    near_one, near_threshold = np.eye(jaccard_join.BINS)[-1] * 1000, np.eye(jaccard_join.BINS)[0] * 1000
    assert jaccard_join.measured_recall(near_one, at, whole) > jaccard_join.TARGET_RECALL
    assert jaccard_join.measured_recall(near_threshold, at, whole) < 0.99
    new = jaccard_join.shortened(near_threshold, at, whole, least, jaccard_join.TARGET_RECALL)
    assert min(new) >= least and max(new) < jaccard_join.MAX_DEPTH
    some = jaccard_join.shortened(near_one + near_threshold / 100, at, whole, least, jaccard_join.TARGET_RECALL)
    assert sum(some) > sum(new)  # less is missed, so less is shortened
    assert jaccard_join.shortened(np.zeros(jaccard_join.BINS), at, whole, least, 0.9999) == [jaccard_join.MAX_DEPTH - 1] * trees


def test_labels_are_prefix_tries():
    values = np.random.default_rng(5).integers(0, 2**63, (4, 192), dtype=np.uint64)
    values[1, 6:8] = 1  # of the first tree, the first six values agree
    values[1, :6] = values[0, :6]
    keys = np.stack([jaccard_join.labels(v, 5, 24) for v in values]).view(np.uint64)
    assert (keys >> np.uint64(59) == np.arange(24, dtype=np.uint64)).all()
    assert keys[0, 0] >> np.uint64(16) == keys[1, 0] >> np.uint64(16) and keys[0, 0] != keys[1, 0]
    assert (keys[0, 1:] >> np.uint64(24) != keys[1, 1:] >> np.uint64(24)).all()
    with pytest.raises(ValueError):
        jaccard_join.signed(None, 5, trees=33)
