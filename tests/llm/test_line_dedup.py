import random

import numpy as np

from dealflow.llm import line_dedup, links
from dealflow.llm.line_dedup import dedup_lines, edit_within, probes, segments
from llm_fixtures import SF_SMALL, no_docs, odd_docs, shipped  # noqa: F401


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def changed(rng, text, n, letters="abé "):
    out = list(text)
    for _ in range(n):
        at, kind = rng.randrange(len(out)), rng.random()
        if kind < 0.3:
            out.insert(at, rng.choice(letters))
        elif kind < 0.6 and len(out) > 5:
            out.pop(at)
        else:
            out[at] = rng.choice(letters)
    return "".join(out)


def test_edit_distance_and_segments():
    rng = random.Random(2)
    for d in (1, 2, 3):
        a = ["".join(rng.choice("abé") for _ in range(rng.randint(d + 1, 15))) for _ in range(1500)]
        b = [changed(rng, x, rng.randint(0, d + 2), "abé") for x in a]
        b = [x if len(x) > d else "a" * (d + 1) for x in b]
        want = [distance(x, y) <= d for x, y in zip(a, b)]
        assert edit_within(a, b, d).tolist() == want
        for x, y, near in zip(a, b, want):
            if near:  # a segment of the shorter line is found where a probe looks
                short, long = sorted((x, y), key=len)
                parts = segments(len(short), d)
                assert any(long[at:at + n] == short[parts[i][0]:parts[i][0] + n] for i, at, n in probes(len(long), len(short), d))
    assert edit_within([], [], 2).tolist() == []
    assert segments(10, 2) == [(0, 3), (3, 3), (6, 4)]


def expected(rows, d=2, least=20, short_copies=False):
    """Texts without dropped lines, by comparing all pairs of lines; rows are in document order.

    Lines under ``least`` characters stay, or with ``short_copies`` are compared for equality.
    """
    lines = [(line.strip(), doc, place) for doc, (_, text) in enumerate(rows) for place, line in enumerate((text or "").split("\n"))]
    lines = [x for x in lines if len(x[0]) >= (1 if short_copies else least)]
    root = list(range(len(lines)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(lines)):
        for j in range(i):
            x, y = lines[i][0], lines[j][0]
            if x == y or (min(len(x), len(y)) >= least and abs(len(x) - len(y)) <= d and distance(x, y) <= d):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    gone = {(lines[i][1], lines[i][2]) for i in range(len(lines)) if find(i) != i}
    return ["\n".join(x for k, x in enumerate((t or "").split("\n")) if (doc, k) not in gone) for doc, (_, t) in enumerate(rows)]


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(links, "SMALL", 4)  # so that shared segments are cut out and the rests split again
    rng = random.Random(8)
    base = ["".join(rng.choice("abé ") for _ in range(rng.randint(18, 34))).strip().ljust(18, "z") for _ in range(25)]
    rows = []
    for i in range(40):
        picked = [changed(rng, rng.choice(base), rng.randint(0, 3)) for _ in range(rng.randint(0, 3))]
        rows.append((i, "\n".join(picked + [f"  {rng.choice(base)} ", "short"])))
    head = "a common first third of lines, "
    for i in range(40, 60):  # a segment that many lines share, some of them near copies
        tail = "".join(rng.choice("abé ") for _ in range(2 * len(head) - 2))
        rows.append((i, "\n".join(head + changed(rng, tail, n) + "zz" for n in (0, 1, 3))))
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    want = expected(rows)
    assert [got[i].text for i, _ in rows] == want
    assert all(got[i].n_lines - got[i].n_dropped == (len(w.split("\n")) if w else got[i].n_lines - got[i].n_dropped) for (i, _), w in zip(rows, want))


def test_rests_of_unequal_length(spark):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    rows = []
    for end in (" is the code of your order", " is your code"):  # many lines share the template; the codes are what is left
        for _ in range(30):
            code = "".join(rng.choice(letters) for _ in range(rng.randint(4, 5) if len(end) > 20 else rng.randint(7, 9)))
            near = code
            for _ in range(rng.randint(1, 2)):
                at = rng.randrange(len(near) + 1)
                near = near[:at] + rng.choice(letters) + near[at:]
            rows += [(len(rows), code + end), (len(rows) + 1, near + end)]
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    assert [got[i] for i, _ in rows] == expected(rows)


def test_copies_of_short_lines(spark):
    long = "a line that is long enough for the edit join"
    rows = [(1, f"And ornd.\n{long}\n\n}}"), (2, f"  And ornd. \n\nAnd orne.\n{long}s"), (3, "}\nAnd ornd.\n \nAnd ornd."), (4, None)]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), short_copies=True).collect()}
    assert {i: (r.text, r.n_dropped) for i, r in got.items()} == {
        1: (rows[0][1], 0), 2: ("\nAnd orne.", 2), 3: (" ", 3), 4: ("", 0)}


def test_query_drops_copies_of_short_lines(spark):
    from dealflow.llm.queries import QUERIES

    kept = [x.strip() for r in QUERIES["op4_line_dedup"](spark, SF_SMALL).collect() for x in r.text.split("\n")]
    kept = [x for x in kept if x]
    assert len(kept) == len(set(kept))


def test_odd_rows(spark, odd_docs, no_docs):
    got = dedup_lines(odd_docs).collect()
    assert len(got) == odd_docs.count() and set(got[0].asDict()) == {*odd_docs.columns, "n_lines", "n_dropped"}
    line = "the quick brown fox jumps over the lazy dog and runs away from here today"
    texts = sorted(((-1 if r.doc_id is None else r.doc_id), r.text) for r in got)
    assert texts.count((1, line)) == 2  # equal rows are one document and stay together
    assert (2, "") in texts and (14, "") in texts and (4, "") in texts  # a copy, a near copy, a null text
    assert (3, line.upper()) in texts and (15, "one two") in texts and (16, "one two") in texts
    assert (11, line + " again\n") in texts  # 400 equal lines, and the empty one at the end
    assert dedup_lines(no_docs).count() == 0


def test_keys_and_hashed_distance():
    rng = random.Random(4)
    some = lambda n, letters="abé": "".join(rng.choice(letters) for _ in range(n))
    first = [some(rng.randint(1, 25)) for _ in range(1500)]
    second = [changed(rng, x, rng.randint(0, 4), "abé") for x in first]
    at = np.arange(1500)
    near = line_dedup._Hashed(first + second).within_two(at, at + 1500)
    assert near.tolist() == [distance(x, y) <= 2 for x, y in zip(first, second)]
    for d, least in ((1, 4), (2, 3), (2, 20), (3, 5)):
        for _ in range(500):
            x = some(rng.randint(least, 5 * least))
            y = changed(rng, x, rng.randint(0, d), "abcd")
            if len(y) >= least:  # lines within the distance meet in a bucket, one of them by a segment of its own
                row, _, _, key, hub = line_dedup._Hashed([x, y]).keys(least, d)
                own, all_ = ([{k for r, k, h in zip(row, key, hub) if r == i and (h or not only)} for i in (0, 1)] for only in (True, False))
                assert own[0] & all_[1] or own[1] & all_[0]
    for d in (1, 2, 3):
        for _ in range(500):
            x, y = some(rng.randint(1, 6), "ab"), some(rng.randint(1, 6), "ab")
            one, two = ({k: (extra, cap) for k, extra, cap in line_dedup._shortened(z, d)} for z in (x, y))
            assert any(one[k][0] + two[k][0] <= one[k][1] for k in one.keys() & two.keys()) == (distance(x, y) <= d)


def test_lines_have_few_entries(spark):
    rng = random.Random(6)
    rows = [(i, "\n".join("".join(rng.choice("abcdé ") for _ in range(rng.randint(100, 300))) for _ in range(20))) for i in range(20)]
    entries = line_dedup._entries(spark.createDataFrame(rows, "doc_id bigint, text string"), 2, 20)
    assert entries.count() <= 5 * 400


def test_crowds_are_split(spark, monkeypatch):
    solved = []
    monkeypatch.setattr(links, "CROWD", 6)
    made = links.written
    monkeypatch.setattr(links, "written", lambda df, what: solved.append(what) or made(df, what))
    rng = random.Random(3)
    rows = [(i, f"Order number {rng.randrange(100000):05}") for i in range(60)]  # last buckets, larger than a crowd
    base = "".join(rng.choice("abcdefgh ") for _ in range(120))
    rows += [(60 + i, "\n".join(changed(rng, base, rng.randint(0, 5)) for _ in range(2))) for i in range(30)]
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    assert [got[i] for i, _ in rows] == expected(rows)
    assert solved.count("finer") >= 2
