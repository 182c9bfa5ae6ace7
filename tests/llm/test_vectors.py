import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dealflow.llm.vector_dedup import exceeding, filter_plan, near_vectors
from dealflow.llm.vector_search import hilbert_keys, search
from llm_fixtures import SF_SMALL, shipped  # noqa: F401

SCHEMA = "vec_id bigint, embedding array<double>, label int, node int, filter string, rank int, a int"
ODD = [
    (None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.01], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None),
    (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1), (8, [float("nan"), 1.0], 1), (9, [float("inf"), 1.0], 1), (10, [None, 1.0], 1),
    (20, [0.0, 3.0], 1), (40, [1e-200, 1e-200], 1), (60, [1.0, 0.0, 0.0], 1), (80, [-1.0, 0.0], None), (11, [0.02, 5.0], 1),
]


def _unit(x):
    return x / np.linalg.norm(x, axis=1)[:, None]


def _groups(rng, n, dims=64):
    """Random vectors, small groups at cosines around the threshold, and a large dense group; labels 0 and 1."""
    base = _unit(rng.standard_normal((n, dims)))
    rows = [base]
    for cosine in (0.90, 0.925, 0.94, 0.97):
        side = rng.standard_normal((40, dims))
        side = _unit(side - (side * base[:40]).sum(1)[:, None] * base[:40])
        rows.append(cosine * base[:40] + math.sqrt(1 - cosine ** 2) * side)
    rows.append(_unit(base[50] + 0.1 / 8 * rng.standard_normal((120, dims))))
    x = np.concatenate(rows)
    return x, rng.integers(0, 2, len(x)) * (np.arange(len(x)) < n // 2)


def brute(x, label, cosine=0.93):
    u = _unit(x)
    link = (u @ u.T >= cosine) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    root = np.arange(len(x))
    while True:
        new = np.where(link, root[None, :], len(x)).min(axis=1)
        new = np.minimum(root, new)
        if (new == root).all():
            return link.sum(axis=1), root
        root = new


def test_links_against_all_pairs(spark):
    x, label = _groups(np.random.default_rng(4), 300)
    order = np.random.default_rng(5).permutation(len(x))
    x, label = x[order], label[order]
    rows = [(i, v.tolist(), int(k), 0, "", 0, 0) for i, (v, k) in enumerate(zip(x, label))]
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    links, root = brute(x, label)
    assert links.max() > 100
    assert [got[i].n_links for i in range(len(x))] == links.tolist()
    assert [got[i].component_id for i in range(len(x))] == root.tolist()
    assert all(got[i].kept == (i == root[i]) for i in range(len(x)))


def test_list_decoding_finds_all_exceeding_directions():
    from dealflow.llm import vector_dedup as v

    rows = _unit(np.random.default_rng(1).standard_normal((20, 9)))
    at, filters = exceeding(rows, 5, 1.0 / 3)
    half, want = 5, set()
    for table in range(v.TABLES):
        turned = rows @ v._rotation(9, table)
        one, two = v._codewords(half, 5, 2 * table + 100), v._codewords(4, 5, 2 * table + 101)
        for i in range(5):
            for j in range(5):
                direction = np.concatenate([one[i], two[j]]) / math.sqrt(2)
                want |= {(r, (table * 5 + i) * 5 + j) for r in np.flatnonzero(turned @ direction >= 1.0 / math.sqrt(9))}
    assert set(zip(at.tolist(), filters.tolist())) == want and len(at) == len(want)
    assert filter_plan(10 ** 6, 64)[0] > filter_plan(10 ** 4, 64)[0]


def test_odd_vectors(spark):
    df = spark.createDataFrame([(*r, 0, "", 0, 0) for r in ODD], SCHEMA)
    got = sorted(((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect()))
    one = [(1, 3, 1, True)] * 2 + [(2, 3, 1, False), (-1, 3, 1, False)]
    rest = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 40, 60, 80)]
    assert got == sorted(one + rest + [(11, 1, 11, True), (20, 1, 11, False)])
    assert near_vectors(df.limit(0)).count() == 0
    found = search(df.filter("vec_id % 20 = 0"), df, k=3, block_rows=4).collect()
    by = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(by) == {20, 40, 80}
    assert by[20] == [(11, 15.0), (2, 0.03), (40, 3e-200)] and by[80][0] == (20, 0.0) or by[80][:1] == [(11, -0.02)]
    assert search(df.limit(0), df).count() == 0 and search(df, df.limit(0)).count() == 0


def test_search_recall_and_scores(spark):
    x = np.random.default_rng(6).standard_normal((3000, 64)) * np.random.default_rng(7).uniform(0.5, 1.5, (3000, 1))
    x[1500:1530] = x[0]  # many equal candidates: ties go to smaller ids
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    found = search(df.filter("vec_id % 20 = 0"), df, block_rows=256, query_rows=40).collect()
    by = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append(r)
    hits = 0
    for q in range(0, 3000, 20):
        score = x @ x[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(3000), -score))[:20]
        assert [r["rank"] for r in by[q]] == list(range(1, 21))
        assert np.allclose([r.score for r in by[q]], score[[r.vec_id for r in by[q]]], rtol=1e-12)
        assert all((a.score, -a.vec_id) > (b.score, -b.vec_id) for a, b in zip(by[q], by[q][1:]))
        hits += len({r.vec_id for r in by[q]} & set(best.tolist()))
    assert hits >= 0.9 * 20 * 150


def test_search_recall_with_mixed_norms(spark):
    rng = np.random.default_rng(12)
    x = _unit(rng.standard_normal((6000, 64))) * rng.uniform(0.5, 1.5, (6000, 1))
    x[7] *= 1000  # one long vector
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    found = {(r.query_id, r.vec_id) for r in search(df.filter("vec_id % 20 = 0"), df, block_rows=64).collect()}
    hits = 0
    for q in range(0, 6000, 20):
        score = x @ x[q]
        score[q] = -np.inf
        hits += sum((q, int(r)) in found for r in np.argsort(-score)[:20])
    assert hits >= 0.9 * 20 * 300


def test_search_with_the_whole_table_in_its_windows_is_exact(spark):
    x = np.random.default_rng(13).standard_normal((1500, 32))
    ids = [i if i < 1400 else 3 for i in range(1500)]  # 101 rows of one id count as one
    x[1400:] = x[3] * 5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id bigint, embedding array<double>")
    for given, least in (({}, 1.0), ({"curves": 3, "window": 0.3}, 0.6)):
        found = {(r.query_id, r["rank"], r.vec_id) for r in search(df.filter("vec_id % 20 = 0"), df, k=5, block_rows=100, **given).collect()}
        want = set()
        for q in range(0, 1400, 20):
            score = x[:1400] @ x[q]
            score[3] *= 5 if score[3] > 0 else 1
            score[q] = -np.inf
            want |= {(q, n + 1, int(r)) for n, r in enumerate(np.argsort(-score)[:5])}
        pairs, near = ({(q, r) for q, _, r in side} for side in (found, want))
        assert len(found) == len(want) and len(pairs & near) >= least * len(near)
        assert least < 1 or found == want


def test_search_at_its_defaults_goes_by_the_curves(spark, monkeypatch):
    from dealflow.llm import vector_search as v

    placed, ranked = [], v._ranked
    monkeypatch.setattr(v, "_ranked", lambda rows, dims, curves: placed.append(ranked(rows, dims, curves)) or placed[-1])
    x = np.random.default_rng(14).standard_normal((600, 16))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    found = {(r.query_id, r.vec_id) for r in v.search(df.filter("vec_id % 20 = 0"), df, k=5, block_rows=50, query_rows=7).collect()}
    assert len(placed) == 1
    # every row has a place on each of the four curves
    held = placed[0].groupBy("curve").agg(F.count_if(F.col("role") == 0).alias("n"), F.min("rank").alias("low"), F.max("rank").alias("high")).collect()
    assert sorted((r.curve, r.n, r.low, r.high) for r in held) == [(c, 600, 0, 629) for c in range(4)]
    for q in range(0, 600, 20):  # and the check that follows leaves none out
        score = x @ x[q]
        score[q] = -np.inf
        assert {r for p, r in found if p == q} == set(np.argsort(-score)[:5].tolist())


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (6, 2)])
def test_hilbert_keys_walk_the_grid(dims, bits):
    side = 1 << bits
    points = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    order = np.argsort(hilbert_keys(points, bits))
    assert sorted(hilbert_keys(points, bits).tolist()) == list(range(side ** dims))
    assert (np.abs(np.diff(points[order], axis=0)).sum(axis=1) == 1).all()  # neighbours on the curve are neighbours in the grid


def test_queries(spark):
    from dealflow.llm.queries import QUERIES

    rows = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    assert QUERIES["op8_vector_dedup"](spark, SF_SMALL).count() == rows.count()
    asked = rows.filter("vec_id % 20 = 0").count()
    assert QUERIES["op10_vector_search"](spark, SF_SMALL).count() == 20 * asked
