import math
import re

import duckdb
import numpy as np

import dealflow.llm.queries as q
from dealflow.llm.lexical import TERM, _Items, best_in_block, build_index, counted, rank_documents, rest_bounds, search
from llm_fixtures import SF_SMALL, no_docs, odd_docs, shipped  # noqa: F401

ITEM = "item_id bigint, text string, term int, block int, id int, at int, docs int, rank int"


def items(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6) for r in rows], ITEM)


def terms(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in re.findall(TERM, text or "")]


def brute(docs, asked, k=10):
    docs = [(d, terms(t)) for d, t in docs if terms(t)]
    n_docs, n_terms = len(docs), sum(len(t) for _, t in docs)
    df = {}
    for _, t in docs:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in asked:
        found = []
        for doc, t in docs:
            m, score = 10 + 90 * len(t) * n_docs // n_terms, 0
            for x in set(terms(text)) & set(t):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1)))
                score += w * (10 ** 9 * t.count(x) // (1000 * t.count(x) + 8 * m))
            if score > 0:
                found.append((-score, math.inf if doc is None else doc))
        out += [(item, i + 1, None if d == math.inf else d, -s) for i, (s, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def words(rng, n, top=60):
    """Words with common and rare ones, some in capitals, some non-ASCII."""
    return " ".join(("Éa" if w % 11 == 0 else "W" if w % 3 else "w") + str(w) for w in np.minimum(rng.zipf(1.3, n), top))


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(3)
    docs = [(i, words(rng, int(rng.integers(1, 60)))) for i in range(700)]
    docs += [(1000 + i, docs[5][1]) for i in range(40)] + [(2000, words(rng, 4000)), (2001, " ".join(docs[7][1].split()[:9]))]
    asked = [(i, words(rng, int(rng.integers(1, 25)))) for i in range(30)] + [(100, docs[5][1]), (101, "nowhere"), (102, "w1 W1 w1!"), (103, docs[2000 - 1260][1])]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    folder = build_index(frame, block_docs=32, block_bytes=4000)
    want = brute(docs, asked)
    for at_once in (200_000, 50):  # one group of items, and several
        got = search(spark, folder, items(spark, asked), terms_at_once=at_once)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    asked = [(1, "The QUICK dog"), (None, "der hund"), (2, None), (3, ""), (4, "!!"), (5, "é 漢字 one"), (6, "x" * 30000)]
    got = rank_documents(odd_docs, items(spark, asked + asked[:2]))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, asked)
    assert rank_documents(no_docs, items(spark, asked)).count() == 0
    assert rank_documents(odd_docs, items(spark, [])).count() == 0


def test_bounds_hold_and_skip():
    """No document scores more than its bound; pair bounds lie below the sum of the maxima."""
    rng = np.random.default_rng(4)
    group = _Items([0], [list(range(12))], {t: 100 - t for t in range(12)})
    impacts = rng.integers(1, 1000, (12, 200)) * (rng.random((12, 200)) < 0.1)
    chain = group.chains[0]
    largest = {t: int(impacts[t].max()) for t in chain if impacts[t].any()}
    joint = [int((impacts[a] + impacts[b])[(impacts[a] > 0) & (impacts[b] > 0)].max(initial=0)) for a, b in group.pairs]
    bounds = rest_bounds(chain, largest, joint, group.pairs)
    scores = impacts.sum(axis=0)
    for i in range(len(chain)):
        assert impacts[chain[i:]].sum(axis=0).max() <= bounds[i] <= sum(largest.get(t, 0) for t in chain[i:])
    assert bounds[0] < sum(largest.values())
    lists = {t: (np.flatnonzero(impacts[t]).astype(np.int32), impacts[t][impacts[t] > 0]) for t in chain if impacts[t].any()}
    docs = np.arange(200)
    for least in (1, int(np.sort(scores)[-10]), int(scores.max()), bounds[0] + 1):
        want = sorted((d, int(s)) for d, s in enumerate(scores) if s >= least)
        want = sorted(want, key=lambda x: (-x[1], x[0]))[:10]
        assert best_in_block(chain, lists, bounds, docs, least, 10) == want


def test_terms():
    assert counted("The the, THE_x1 É é".encode()) == {b"the": 3, b"x1": 1, "É".encode(): 1, "é".encode(): 1}
    assert counted(b"") == {} and counted(b"-- !") == {}
    text = "".join(map(chr, range(0x300))) + "漢字🙂A"  # every boundary of the pattern
    assert {t.decode() for t in counted(text.encode())} == set(terms(text))


def test_query_matches_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    got = q.QUERIES["op12_lexical_search"](spark, SF_SMALL)
    want = con.sql(q.ORACLES["op12_lexical_search"])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
