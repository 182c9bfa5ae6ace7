import random
import re

import numpy as np

from dealflow.llm import links
from dealflow.llm.links import components
from dealflow.llm.near_dedup import deduplicate, near_duplicates
from dealflow.llm.shingles import bands, shingle_set, sketch, word_hashes
from llm_fixtures import SF_SMALL, no_docs, odd_docs, shipped  # noqa: F401

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingles(text, width):
    words = WORDS.findall((text or "").translate(LOWER))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width, percent=80):
    """(set size, least linked id) of each (id, text), by comparing all pairs."""
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [(len(s), least.get(find(i)) if s else rows[i][0]) for i, s in enumerate(sets)]


def _corpus():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, base = [], [[rng.choice(vocabulary) for _ in range(rng.choice((3, 4, 5, 6, 12, 60, 200)))] for _ in range(40)]
    for words in base:
        rows.append(words)
        for _ in range(rng.randint(0, 4)):
            near = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            rows.append(near)
    big = [rng.choice(vocabulary) for _ in range(150)]
    for i in range(150):  # a large group around one text, whose members differ more from each other
        near = list(big)
        near[rng.randrange(150)] = f"x{i}"
        rows.append(near)
    for i in range(60):  # far variants of that text, which share bands but no link, each with a near copy of its own
        far = list(big)
        for k, at in enumerate(rng.sample(range(150), 9)):
            far[at] = f"y{i}.{k}"
        rows += [far, far[:20] + [f"z{i}"] + far[21:]]
    inner = [big[a:a + 70] for a in range(0, 60, 6)]  # parts of it, which link with each other inside it
    rows += inner
    texts = [" ".join(r) for r in rows]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(links, "SMALL", 16)
    rows = _corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(
        spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), width=4).collect()}
    for (doc, _), (size, component) in zip(rows, brute(rows, 4)):
        assert got[doc] == (size, component, doc == component)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = sorted(zip([(-1 if d is None else d) for d, _ in rows], brute(rows, 5)), key=repr)
    got = near_duplicates(odd_docs).collect()
    assert sorted([(-1 if r.doc_id is None else r.doc_id, (r.n_shingles, r.component_id)) for r in got], key=repr) == want
    assert near_duplicates(no_docs).count() == 0 and deduplicate(no_docs).count() == 0
    kept = deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect())
    assert ids == [-1, 1, 1, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 13, 14, 15]  # both equal rows of document 1, no copy of it


def test_words_and_sets():
    text = "Aa b c\td\x0bÉ  e\x1cf " + "g" * 300
    assert len(word_hashes(text)) == len(WORDS.findall(text))
    assert word_hashes("AA bb").tolist() == word_hashes("aa BB").tolist() != word_hashes("aa bB b").tolist()
    assert word_hashes("É").tolist() != word_hashes("é").tolist()
    for t in ("", " ", "a", "a b", "a b c d", "a b c d e a b c d", text):
        assert len(shingle_set(t, 4)) == len(shingles(t, 4))


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(0)
    for size in (1, 3, 20, 400, 3000):
        items = np.unique(rng.integers(1, 1 << 62, size).astype(np.uint64))
        assert (sketch(items, 96) != np.uint64((1 << 64) - 1)).all()
    agree = []
    for _ in range(60):
        items = rng.integers(1, 1 << 62, 1100).astype(np.uint64)
        a, b = np.unique(items[:1000]), np.unique(items[100:])
        agree.append((sketch(a, 96) == sketch(b, 96)).mean())
        assert len(np.intersect1d(a, b)) == 900
    assert abs(np.mean(agree) - 900 / 1100) < 0.02 and np.std(agree) < 0.06
    assert len(set(bands(sketch(a, 96), 4).tolist())) == 24


def test_components_of_a_path_and_stars(spark):
    n = 40
    edges = [(i, i + 1) for i in range(n)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (210, 200), (205, 210), (200, 210)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(3)).collect()}
    assert got == {**{i: 0 for i in range(1, n + 1)}, **{100 + i: 100 for i in range(1, 30)}, 205: 200, 210: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
