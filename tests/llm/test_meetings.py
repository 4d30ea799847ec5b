"""Which texts meet in the n-gram join."""

import numpy as np
import pytest

NONE = (np.empty(0, np.uint64), np.empty(0, np.uint8))


def linked(rows, words, percent):
    """Components of (doc_id, text) by comparing all pairs."""
    sets = [(i, {tuple(w[k : k + words]) for k in range(len(w) - words + 1)}) for i, t in rows for w in [t.split()]]
    low = {i: i for i, _ in rows}
    for i, x in sets:
        for j, y in sets:
            if low[i] != low[j] and 100 * len(x & y) >= percent * len(x | y):
                a, b = sorted((low[i], low[j]))
                low = {k: a if v == b else v for k, v in low.items()}
    return low


def test_sketches_never_part_similar_sets():
    from faintdip.llm.ngram_join import alike, apart, sketches

    rng = np.random.default_rng(1)
    for n in (1, 9, 40, 300, 3000):
        base = rng.integers(0, 1 << 60, 2 * n + 40, dtype=np.uint64)
        sets = [base[:n], base[: n - n // 10], base[n // 20 : n + n // 20], base[n : 2 * n], base[: n // 2]]
        at = np.cumsum([0, *map(len, sets)])
        some = sketches(np.concatenate(sets), at)
        for i in range(5):
            gap = apart(some[[i] * 5], some)
            assert all(g <= len(np.setxor1d(sets[i], y)) for g, y in zip(gap, sets))
        size = np.array([len(x) for x in sets])
        classes = np.floor(np.log(np.maximum(size, 1)) / np.log(100 / 90) + 1e-9).astype(np.int64)
        order = np.argsort(classes, kind="stable")
        a, b = alike(np.zeros(5, int), classes[order], some[order], 90)
        met = {frozenset(x) for x in zip(order[a].tolist(), order[b].tolist())}
        for i in range(5):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if size[i] and size[j] and 100 * both >= 90 * (size[i] + size[j] - both):
                    assert {i, j} in met
        if n in (40, 300):  # larger sets may differ by more than a sketch can show
            assert {0, 3} not in met


def test_texts_that_share_a_shingle_by_chance_stay_apart(spark):
    """A chain of unlike texts, each with a shingle of the one before; it would make one cluster."""
    from faintdip.llm.ngram_join import meetings

    text = lambda i: " ".join(f"w{i}x{k}" for k in range(80)) + " " + " ".join(f"c{j}x{k}" for j in (i, i + 1) for k in range(20))
    rows = [(i, text(i)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    met = meetings(docs, 1, 90, 8, NONE).collect()
    assert not met
    near = spark.createDataFrame([*rows, (99, text(7) + " more")], "doc_id long, text string").coalesce(2)
    assert {(r["a"], r["b"]) for r in meetings(near, 1, 90, 8, NONE).collect()} == {(99, 7)}


@pytest.mark.parametrize("percent", [80, 90])
def test_copies_in_any_order_keep_their_links(spark, percent):
    """The first of equal texts that a task meets need not be the one with the smallest id."""
    from faintdip.llm.ngram_join import jaccard_components

    text = lambda i: " ".join(f"w{i}x{k}" for k in range(100))
    rows = [(i + 10 * c, text(i) + " more" * (c == 2)) for c in (3, 1, 2, 0) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {r["doc_id"]: r["component_id"] for r in jaccard_components(docs, words=3, percent=percent).collect()} == linked(rows, 3, percent)


@pytest.mark.parametrize("alike, compared", [(1, 2), (2, 4), (16, 512)])
def test_all_pairs_of_random_near_copies(spark, monkeypatch, alike, compared):
    from faintdip.llm import ngram_join

    monkeypatch.setattr(ngram_join, "ALIKE", alike)
    monkeypatch.setattr(ngram_join, "COMPARED", compared)
    rng = np.random.default_rng(alike)
    bases = [[f"v{x}" for x in rng.integers(0, 400, n)] for n in rng.integers(3, 120, 12)]
    rows = []
    for i in rng.permutation(150).tolist():
        w = list(bases[int(rng.integers(12))])
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(len(w)))] = f"n{rng.integers(50)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for percent in (80, 90):
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs, words=2, percent=percent).collect()}
        assert got == linked(rows, 2, percent)


def test_texts_that_share_a_shingle_by_chance_stay_apart_without_sketches(spark):
    """The same chain below the percentage of sketches: two shared shingles are fewer than similar texts share."""
    from faintdip.llm.ngram_join import meetings

    text = lambda i: " ".join(f"w{i}x{k}" for k in range(80)) + " " + " ".join(f"c{j}" for j in (i, i + 1))
    rows = [(i + (i % 3 << 40), text(i)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    assert not meetings(docs, 1, 80, 8, NONE).collect()
    near = spark.createDataFrame([*rows, (1 << 50, text(7) + " more")], "doc_id long, text string").coalesce(2)
    assert {(r["a"], r["b"]) for r in meetings(near, 1, 80, 8, NONE).collect()} == {(1 << 50, rows[7][0])}


@pytest.mark.parametrize("shared, paired, counted", [(1, 32, 1), (3, 2, 1), (4, 64, 1 << 20)])
def test_counted_pairs_of_random_near_copies(spark, monkeypatch, shared, paired, counted):
    from faintdip.llm import ngram_join

    for name, value in (("SHARED", shared), ("PAIRED", paired), ("COUNTED", counted), ("ALIKE", 2)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = np.random.default_rng(shared)
    bases = [[f"v{x}" for x in rng.integers(0, 90, n)] for n in rng.integers(3, 90, 12)]
    rows = []
    for i in rng.permutation(150).tolist():
        w = list(bases[int(rng.integers(12))])
        for _ in range(int(rng.integers(0, 1 + len(w) // 9))):
            w[int(rng.integers(len(w)))] = f"n{rng.integers(50)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for percent in (60, 80):
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs, words=2, percent=percent).collect()}
        assert got == linked(rows, 2, percent)
