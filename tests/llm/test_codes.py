import hashlib
import math

import duckdb
import numpy as np

import dealflow.llm.queries as q
from dealflow.llm.vector_codes import compress, distinct, nearest, pack, unpack
from llm_fixtures import SF_SMALL, shipped  # noqa: F401

import pyarrow as pa

SCHEMA = "vec_id bigint, embedding array<double>, label int, code int, error string, position int, vector int, of_label int"


def brute(rows, n_parts, n_entries, rounds):
    """Python integers, every part against every entry."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, [math.floor(256 * x) for x in r[1]]))
    whole = [[math.floor(256 * x) for x in v] for _, v, _ in rows]
    width = len(whole[0]) // n_parts
    parts = [[tuple(w[p * width:(p + 1) * width]) for w in whole] for p in range(n_parts)]
    books = [list(own[:n_entries]) for own in parts]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(n_parts):
            groups = {}
            for x in parts[p]:
                groups.setdefault(near(p, x)[1], []).append(x)
            for k, held in groups.items():
                books[p][k] = tuple(sum(c) // len(held) for c in zip(*held))
    out = []
    for i, (vec_id, _, label) in enumerate(rows):
        found = [near(p, parts[p][i]) for p in range(n_parts)]
        out.append((vec_id, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    sums = {}
    for _, _, error, label in out:
        sums[label] = sums.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, c, e, sums[la], digest, la) for i, c, e, la in out), key=repr)


def test_trie_against_every_entry():
    rng = np.random.default_rng(1)
    for width in (1, 2, 5):
        parts, copies, place = distinct(rng.integers(-4, 4, (900, width)))
        entries = rng.integers(-4, 4, (7, width))  # with ties
        all_distances = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
        for leaves in (1, 13, 10_000):
            codes, errors = nearest(parts, entries, leaves)
            assert (codes == all_distances.argmin(axis=1)).all() and (errors == all_distances.min(axis=1)).all()
        assert copies.sum() == 900 and len(place) == 900
        packed = pack(parts)
        assert (unpack(packed, width) == parts).all() and packed.to_pylist() == sorted(packed.to_pylist())


def test_codes_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal((150, 12)), np.repeat(rng.standard_normal((2, 12)), 60, axis=0)])
    rows = [(int(i), v.tolist(), None if i % 7 == 0 else int(i % 3)) for i, v in zip(rng.permutation(len(x)), x)]
    rows += [(None, [0.5] * 12, 1), (3, [0.0] * 12, 2), (3, [0.0] * 12, 2)]
    df = spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in rows], SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in compress(df, n_parts=4, n_entries=16).collect()), key=repr)
    assert got == brute(rows, 4, 16, 2)


def test_odd_vectors(spark):
    rows = [(1, [1.0] * 4, 1), (2, None, 1), (3, [], 1), (4, [math.nan] + [0.0] * 3, 1), (5, [math.inf] + [0.0] * 3, 1), (6, [None, 1.0, 1.0, 1.0], 1),
            (7, [1.0] * 3, 1), (8, [1e300, -1e300, 0.0, 0.0], None), (9, [0.0] * 4, None), (None, [0.25] * 4, None)]
    got = {r.vec_id: r for r in compress(spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in rows], SCHEMA), n_parts=4).collect()}
    assert set(got) == {1, 8, 9, None}  # fewer rows than entries: each is an entry of its own
    assert all(r.error == 0 and r.label_error == 0 for r in got.values())
    assert compress(spark.createDataFrame([], SCHEMA)).count() == 0
    assert compress(spark.createDataFrame([(1, None, 1, 1, "x", 2, 3, 4)], SCHEMA)).count() == 0


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF_SMALL}/embeddings.parquet')")
    got = q.QUERIES["op11_vector_codes"](spark, SF_SMALL)
    want = con.sql(q.ORACLES["op11_vector_codes"])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
