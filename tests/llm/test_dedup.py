"""Near-duplicates of documents and of embeddings, and components."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loomline.llm import embedding_dedup, near_dedup
from loomline.llm.common import runs
from loomline.llm.components import connected_components
from tests.llm.conftest import SCHEMA, passage


class Union(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def plain_set(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def plain_groups(rows, percent):
    """{place of a row: (set size, least id)} by comparing all rows that share a shingle."""
    sets = [plain_set(t) for _, t in rows]
    where: dict = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    union = Union()
    for i, s in enumerate(sets):
        for j, both in Counter(j for g in s for j in where[g] if j < i).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                union.join(i, j)
    least: dict = {}
    for i, (doc_id, _) in enumerate(rows):
        root = union.find(i)
        least[root] = min([x for x in (least.get(root), doc_id) if x is not None], default=None)
    return [(len(s), least[union.find(i)]) for i, s in enumerate(sets)]


def check(frame, percent):
    rows = [tuple(r) for r in frame.select("doc_id", "text").collect()]
    expected = Counter((i, *g, i == g[1]) for (i, _), g in zip(rows, plain_groups(rows, percent)))
    got = near_dedup.near_duplicates(frame, percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == expected


def test_op7(documents):
    check(documents, 85)


@pytest.mark.parametrize("percent", [80, 85])
def test_odd_rows(odd, percent):
    check(odd, percent)


def test_op7_empty(empty):
    assert near_dedup.near_duplicates(empty).collect() == []


@pytest.mark.parametrize("cells", [{}, {"OUTSIDE": 2, "MET": 8, "STAR": 3}])
def test_families_of_near_copies(spark, cells, monkeypatch):
    """Chains and families around the threshold, one of them large, with copies, in cells of any size."""
    for name, value in cells.items():
        monkeypatch.setattr(near_dedup, name, value)
    rng = random.Random(4)
    rows = []
    for family in range(12):
        words = passage(family, 120).split()
        for _ in range(60 if family == 0 else 12):
            rows.append((len(rows) * 3 % 1009, " ".join(words), None, None, None))
            if family % 3 == 0:  # each differs from the family's first
                words = passage(family, 120).split()
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    rows += rows[:40]
    check(spark.createDataFrame(rows, SCHEMA), 85)


def test_posterior_bounds():
    from math import comb

    for n in (30, 90, 150):
        m = near_dedup.least_matches(n, 85)
        tail = lambda k: sum(comb(n + 1, i) * 0.85**i * 0.15 ** (n + 1 - i) for i in range(k + 1))
        assert tail(m) >= near_dedup.MISS > tail(m - 1)
    assert (1 - 0.85**near_dedup.ROWS) ** near_dedup.bands_for(85) <= near_dedup.MISS


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    both, left, right = (np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (850, 75, 75))
    sig = near_dedup._signatures([np.concatenate([both, left]), np.concatenate([both, right])], 600)
    assert abs((sig[0] == sig[1]).mean() - 0.85) < 0.06


def test_signatures_of_large_sets_do_not_saturate():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1_000_000, 1_000_000, 120_000, 100_000)]
    sig = near_dedup._signatures(sets, 120)
    assert max((sig[i] == sig[j]).sum() for i in range(4) for j in range(i)) <= 1


def test_long_texts(spark):
    """Texts of over 100,000 words: two unlike ones, and a copy of each with one word in forty or in a thousand changed."""
    rows = []
    for seed in (1, 2):
        words = [f"w{seed}x{i * i % 999_983}" for i in range(110_000)]
        rows += [(10 * seed, " ".join(words)), (10 * seed + 1, " ".join("other" if i % 1000 == 0 else w for i, w in enumerate(words))), (10 * seed + 2, " ".join("other" if i % 40 == 0 else w for i, w in enumerate(words)))]
    check(spark.createDataFrame(rows, "doc_id long, text string"), 85)


def test_a_large_star_and_many_copies(spark, monkeypatch):
    # One family around its first text, more copies of it than are joined by shuffle, null and repeated ids.
    monkeypatch.setattr(near_dedup, "COPIES", 20)
    words = passage(5, 200).split()
    rows = [(i, " ".join(words)) for i in range(100, 140)] + [(None, " ".join(words))] * 30 + [(7, passage(6))] * 40 + [(7, " ".join(words))]
    rows += [(1000 + i, " ".join([*words[: i % 190], f"x{i}", *words[i % 190 + 1 :]])) for i in range(1500)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), 85)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)] + [(7, 7), (None, 3), (5, 4)]
    union = Union()
    for a, b in edges:
        if a is not None and a != b:
            union.join(a, b)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: union.find(x) for x in union}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


# Embeddings

VECTORS = "vec_id long, embedding array<float>, label int"


def plain_links(rows, threshold=0.93):
    good = {}
    for i, (vec_id, v, label) in enumerate(rows):
        if vec_id is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            good[i] = (label, len(v), x / np.linalg.norm(x))
    union, links = Union(), Counter()
    for i in range(len(rows)):
        union.find(i)
        for j in range(i):
            if i in good and j in good and good[i][:2] == good[j][:2] and good[i][2] @ good[j][2] >= threshold:
                union.join(i, j)
                links[i] += 1
                links[j] += 1
    least: dict = {}
    for i, (vec_id, *_) in enumerate(rows):
        root = union.find(i)
        least[root] = vec_id if root not in least else min(least[root], vec_id)
    return [(links[i], least[union.find(i)]) for i in range(len(rows))]


def check_vectors(frame):
    rows = [tuple(r) for r in frame.select("vec_id", "embedding", "label").collect()]
    expected = Counter((r[0], *g, r[0] == g[1]) for r, g in zip(rows, plain_links(rows)))
    got = embedding_dedup.near_duplicate_vectors(frame).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == expected


def test_op8(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).tolist(), i % 3) for i in range(300)]
    for family, spread in enumerate((0.02, 0.05, 0.08)):  # the first family is larger than a list
        centre = rng.normal(size=16)
        rows += [(1000 + family * 100 + i, (centre + spread * rng.normal(size=16) * np.linalg.norm(centre) / 4).tolist(), 1) for i in range(40)]
    rows += [(2000 + i, rows[5][1], rows[5][2]) for i in range(25)] + [(5000, rows[5][1], 99), (2001, rows[5][1], rows[5][2])]
    rows += [(6000, None, 1), (6001, [0.0] * 16, 1), (6002, [float("nan")] + [1.0] * 15, 1), (6003, [None] + [1.0] * 15, 1), (6004, rows[5][1], None), (6005, [], 1), (6006, [1.0, 2.0], 1), (6007, [2.0, 4.0], 1)]
    frame = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS node", "2 AS space", "3 AS u", "4 AS v", "5 AS sim", "6 AS root", "7 AS copies")
    check_vectors(frame)
    assert embedding_dedup.near_duplicate_vectors(frame.limit(0)).collect() == []


def at_cosine(rng, x, cosine):
    """A unit vector at this cosine to the unit vector x."""
    y = rng.normal(size=len(x))
    y -= (y @ x) * x
    return cosine * x + math.sqrt(1 - cosine * cosine) * y / np.linalg.norm(y)


def test_op8_isolated_pairs_beside_a_hot_family(spark):
    # The family fills an audit of links; the pairs lie in one large label that random cells divide.
    rng = np.random.default_rng(11)
    common = rng.normal(size=64)
    rows, pairs = [], 400
    for i in range(pairs):
        x = rng.normal(size=64) + common
        x /= np.linalg.norm(x)
        rows += [(2 * i, x.tolist(), 1), (2 * i + 1, at_cosine(rng, x, 0.94).tolist(), 1)]
    centre = rng.normal(size=64)
    rows += [(10_000 + i, (centre + 0.05 * rng.normal(size=64)).tolist(), 1) for i in range(1500)]
    rows += [(20_000 + i, (rng.normal(size=64) + common).tolist(), 1) for i in range(2200)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicate_vectors(frame).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.93).sum(1) - 1
    assert [got[r[0]].n_links for r in rows] == links.tolist()
    assert all(got[2 * i + 1].component_id == got[2 * i].component_id for i in range(pairs))


def test_op8_families_with_full_lists(spark):
    # Every node has more than a list's length of nearer neighbours in its own family; few links cross.
    rng = np.random.default_rng(12)
    centre = np.eye(64)[0]
    other = at_cosine(rng, centre, 0.92)
    x = np.concatenate([c + 0.015 * rng.normal(size=(500, 64)) for c in (centre, other)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.93
    assert 0 < linked[:500, 500:].sum() < 0.02 * linked.sum()
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = sorted(embedding_dedup.near_duplicate_vectors(frame).collect(), key=lambda r: r.vec_id)
    assert [r.n_links for r in got] == (linked.sum(1) - 1).tolist() and {r.component_id for r in got} == {0}


def test_op8_null_ids(spark):
    frame = spark.createDataFrame([(None, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (2, [1.0, 0.1], 1)], VECTORS)
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicate_vectors(frame).collect()}
    assert got == {(None, 0, None, True), (3, 1, 2, False), (2, 1, 2, True)}


def test_op8_failed_audits_end_in_an_exact_comparison(spark, monkeypatch):
    # Cells so small and few that the search misses links, blocks of several parts, and a recall that no search reaches.
    for name, value in {"CELL": 8, "AGAIN": 0, "MISS": 0.9, "DRAWS": 1, "ROUNDS": 1, "BLOCK": 16, "BALLS": 6, "PARTNERS": 50, "MEET": 4}.items():
        monkeypatch.setattr(embedding_dedup, name, value)
    rng = np.random.default_rng(21)
    rows = []
    for family in range(30):
        centre = rng.normal(size=12)
        rows += [(len(rows) + i, (centre + 0.1 * rng.normal(size=12)).tolist(), family % 2) for i in range(1 + family)]
    report = {}
    frame = spark.createDataFrame(rows, VECTORS)
    got = embedding_dedup.near_duplicate_vectors(frame, recall=1.01, report=report).collect()
    expected = Counter((r[0], *g, r[0] == g[1]) for r, g in zip(rows, plain_links(rows)))
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == expected
    assert report["exact"] and report["searches"] == embedding_dedup.SEARCHES and report["recall"] == 1


@pytest.mark.parametrize("largest", [64, 500])
def test_op8_labels_that_fit_in_a_cell_are_compared_whole(spark, monkeypatch, largest):
    # One draw, no refinement and no repeated search: only what lies in one cell is found, however large other labels are.
    for name, value in {"CELL": 64, "AGAIN": 0, "MISS": 0.9, "DRAWS": 1, "ROUNDS": 0}.items():
        monkeypatch.setattr(embedding_dedup, name, value)
    rng = np.random.default_rng(31)
    rows = []
    for label in range(40):
        for _ in range(32):
            x = rng.normal(size=16)
            x /= np.linalg.norm(x)
            rows += [(len(rows), x.tolist(), label), (len(rows) + 1, at_cosine(rng, x, 0.94).tolist(), label)]
    rows += [(len(rows) + i, rng.normal(size=16).tolist(), 99) for i in range(largest)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(7)
    report = {}
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicate_vectors(frame, recall=0.0, report=report).collect()}
    assert report["searches"] == 1 and not report["exact"]
    small = [r for r in rows if r[2] != 99]
    assert [got[r[0]] for r in small] == plain_links(small)


def test_op8_enlarged_lists_and_full_nodes(spark, monkeypatch):
    # Families smaller and larger than a list, an enlarged list and a block; one part of a label's partners for 300.
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    monkeypatch.setattr(embedding_dedup, "PARTNERS", 300)
    rng = np.random.default_rng(22)
    rows = []
    for size in (1, 2, 9, 11, 12, 30, 40, 41, 42, 43, 60, 200, 700):
        centre = rng.normal(size=24)
        rows += [(5000 - len(rows) - i, (centre + rng.uniform(0.05, 0.35) * rng.normal(size=24)).tolist(), 1) for i in range(size)]
    report = {}
    check_vectors(spark.createDataFrame(rows, VECTORS))
    embedding_dedup.near_duplicate_vectors(spark.createDataFrame(rows, VECTORS), report=report).collect()
    assert report["recall"] >= embedding_dedup.RECALL and not report["exact"]


def test_runs_in_parts():
    batches = [pa.RecordBatch.from_pydict({"k": k, "v": [*range(len(k))]}) for k in ([1, 1, None], [None, 2, 2, 2], [], [2, 2, 3])]
    found = [(key, rows.num_rows) for key, rows in runs(iter(batches), ["k"], 2)]
    assert found == [((1,), 2), ((None,), 2), ((2,), 2), ((2,), 2), ((2,), 1), ((3,), 1)]
    assert [(k, r.num_rows) for k, r in runs(iter(batches), ["k"])] == [((1,), 2), ((None,), 2), ((2,), 5), ((3,), 1)]
