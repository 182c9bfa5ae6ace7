"""Near-duplicate lines by a segment-partition edit join (operator 4).

Two lines are linked if their edit distance is at most ``distance`` (2).  Lines
are classed by length (classes overlap by the distance), and in a class each line is split into distance + 1
segments of fixed length, the first half counted from its start, the rest from its end; if two
lines are within the distance, one segment of one occurs unchanged in the other, at a
place that the edits left and right of it allow.  So every line puts its own
segments into an index (by class, segment number and segment) and probes the index with
the few substrings that can match: 4 entries and some more where classes overlap.  Entries
meet in a shuffle on the key's hash.

Equal lines are one node of the join however often they occur.  Lines that meet in a
bucket of bounded size come together in one task, which compares them by hashes of their pieces
(what two lines begin and end with, and what lies between two edits) and verifies links by a banded
bit-parallel edit distance.  A segment that more lines share is cut out, and
the rests of these lines are split again (``link_refined``), by ``segments`` and ``probes`` of each length.

Linked lines form groups; of a group the first line (by ``doc_id``, then
place) stays and all others are dropped, copies within one document too.  A line is taken without
its outer blanks.  One shorter than ``min_chars`` (20) takes no part in the edit
join: with ``short_copies`` it is linked to lines equal to it, without it always stays.
Blank lines always stay.

Null and odd input: a null or empty text has no lines to drop and becomes the
empty text.  Rows equal in doc_id and text are one document: their lines stay
or go together.  A null ``doc_id`` comes last in order.  Extra columns are
kept, except that ``n_lines`` and ``n_dropped`` are replaced.  An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import PIECE, packed, slices, written
from .links import link_refined, with_roots


def segments(length: int, distance: int) -> list[tuple[int, int]]:
    """(start, length) of distance + 1 segments; the later ones are one longer where it doesn't divide."""
    parts = distance + 1
    short, longer = length // parts, length % parts
    out, start = [], 0
    for i in range(parts):
        n = short + (i >= parts - longer)
        out.append((start, n))
        start += n
    return out


def probes(length: int, indexed: int, distance: int) -> list[tuple[int, int, int]]:
    """(segment, start, length) of the substrings of a line of ``length`` that can match a segment of an ``indexed`` one.

    Edits before segment i are at most i and those after it at most
    distance - i, or an earlier or later segment is unchanged as well.
    """
    gap, out = length - indexed, []
    for i, (start, n) in enumerate(segments(indexed, distance)):
        low = max(start - i, start + gap - (distance - i), 0)
        high = min(start + i, start + gap + (distance - i), length - n)
        out += [(i, at, n) for at in range(low, high + 1)]
    return out


def _padded(lines: list[str], before: int, after: int, blank: int) -> np.ndarray:
    """Code points, a row for each line, with ``blank`` around them."""
    points = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in lines]
    out = np.full((len(lines), before + max(map(len, points), default=0) + after), blank, np.uint32)
    for row, x in zip(out, points):
        row[before:before + len(x)] = x
    return out


def edit_within(first: list[str], second: list[str], distance: int) -> np.ndarray:
    """Whether the edit distance of each pair (each line longer than ``distance``) is at most ``distance``.

    The banded bit-parallel algorithm, for many pairs at a time.  In step i
    (character i of ``second``) a word holds the vertical differences of the
    rows around row i of the table; its top bit is row i + distance + 1.  The
    score is followed down the band's lower diagonal to the last row, then along that row.
    """
    width = 2 * distance + 2
    n1, n2 = (np.array([len(x) for x in side], np.int64) for side in (first, second))
    if not len(n1):
        return np.zeros(0, bool)
    steps = int(n2.max())
    a = _padded(first, width - distance - 1, steps + width, 0xFFFFFFFE)
    b = _padded(second, 0, 0, 0xFFFFFFFF)
    full, one, top = np.uint64((1 << width) - 1), np.uint64(1), np.uint64(width - 1)
    shifts = np.arange(width, dtype=np.uint64)
    up = np.full(len(n1), full ^ np.uint64((1 << (width - distance - 1)) - 1), np.uint64)
    down = np.zeros(len(n1), np.uint64)
    score = np.full(len(n1), distance, np.int64)
    turn = n1 - distance  # from this step on the last row is inside the band
    for i in range(steps):
        match = ((a[:, i:i + width] == b[:, i, None]).astype(np.uint64) << shifts).sum(axis=1, dtype=np.uint64)
        same = ((((match & up) + up) ^ up) | match | down) & full  # diagonal difference is 0
        right_up = (down | ~(same | up)) & full
        right_down = same & up
        past = i - turn
        bit = np.clip(width - 2 - past, 0, width - 1).astype(np.uint64)
        along = ((right_up >> bit) & one).astype(np.int64) - ((right_down >> bit) & one).astype(np.int64)
        score += np.where(i < n2, np.where(past < 0, 1 - ((same >> top) & one).astype(np.int64), along), 0)
        moved = same >> one
        up, down = (right_down | ~(moved | right_up)) & full, moved & right_up
    return (np.abs(n1 - n2) <= distance) & (score <= distance)


def _lines(text: str | None, min_chars: int) -> list[tuple[int, str]]:
    """Place and stripped line of those long enough to be compared."""
    out = []
    for place, line in enumerate((text or "").split("\n")):
        line = line.strip()
        if len(line) >= min_chars:
            out.append((place, line))
    return out


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())


def _hash(line: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(line.encode("utf-8", "replace"), seed)


def _occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """node, check (two hashes of the line), doc_id, text_key and place of every line that is compared."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE):
            rows, nodes, checks, places = [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                for place, line in _lines(text, min_chars):
                    rows.append(row), places.append(place), nodes.append(_hash(line)), checks.append(_hash(line, 1))
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [_signed(nodes), _signed(checks), batch.column("doc_id").take(rows), batch.column("text_key").take(rows),
                 pa.array(places, pa.int32())], ["node", "check", "doc_id", "text_key", "place"])

    return _keyed(docs).mapInArrow(run, "node bigint, check bigint, doc_id bigint, text_key bigint, place int")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def _plan(n: int, distance: int, plans: dict[int, list]) -> list[tuple[int, int, int, bool]]:
    """(seed, begin, end, indexed) of the entries of a line of n characters; the seed tells indexed length and segment."""
    if n not in plans:
        own = [(n, i, at, m) for i, (at, m) in enumerate(segments(n, distance))]
        others = [(k, i, at, m) for k in range(max(1, n - distance), n + 1) for i, at, m in probes(n, k, distance)]
        plans[n] = [(k * (distance + 1) + i, at, at + m, (k, i, at, m) in own) for k, i, at, m in dict.fromkeys(own + others)]
    return plans[n]


def _classes(longest: int, least: int, distance: int) -> list[int]:
    """Least lengths of the length classes up to that of ``longest``, each about an eighth wide."""
    out = [least]
    while out[-1] <= longest:
        out.append(out[-1] + max(2 * distance, out[-1] // 8))
    return out


def _views(least: int, distance: int) -> list[tuple[int, int, int, int]]:
    """(segment, start, length, shift) of the entries of a line of ``least`` characters or more; a negative start counts from the end.

    Of a line's distance + 1 segments, the first half lies at its start, the rest at its
    end.  Of two lines within the distance, one has a segment i that is unchanged in the other,
    with exactly i edits left of it and at most distance - i right of it (else some segment had none).  So
    it is moved by at most i, or distance - i counted from the end.  Up to a distance of 2
    it is moved by one edit at most, to the right as seen from one of the two lines.
    """
    out = []
    for i, (at, n) in enumerate(segments(least, distance)):
        back = i > distance // 2
        most = distance - i if back else i
        out += [(i, at - least if back else at, n, shift) for shift in range(0 if distance <= 2 else -most, most + 1)]
    return out


class _Hashed:
    """Lines end to end, with hashes of any of their pieces: a polynomial of the characters, modulo 2**64."""

    base = 0x9E3779B97F4A7C15
    powers = inverses = np.ones(1, np.uint64)

    def __init__(self, lines: list[str]):
        codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.length = np.array([len(x) for x in lines], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        if len(self.powers) <= len(codes):
            for name, factor in (("powers", self.base), ("inverses", pow(self.base, -1, 1 << 64))):
                series = np.full(len(codes) + 1, factor, np.uint64)
                series[0] = 1
                setattr(_Hashed, name, np.cumprod(series, dtype=np.uint64))
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes + np.uint64(1)) * self.powers[:len(codes)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[begin]) * self.inverses[begin]

    def keys(self, least: int, distance: int) -> tuple[np.ndarray, ...]:
        """line, begin, end (in the line), key and hub of all entries of the lines, each of ``least`` characters or more."""
        bounds = _classes(int(self.length.max(initial=0)), least, distance)
        own = np.searchsorted(bounds, self.length, "right") - 1
        next_too = self.length >= np.array(bounds)[own + 1] - distance
        out = []
        for k in range(len(bounds)):
            lines = np.flatnonzero((own == k) | next_too & (own == k - 1))
            if not len(lines):
                continue
            for i, at, n, shift in _views(bounds[k] - distance * (k > 0), distance):
                begin = (at if at >= 0 else self.length[lines] + at) + np.full(len(lines), shift)
                inside = (begin >= 0) & (begin + n <= self.length[lines])
                row, begin = lines[inside], begin[inside]
                x = self.of(self.begin[row] + begin, self.begin[row] + begin + n)
                x ^= np.uint64((k * (distance + 1) + i + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1)
                x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
                x ^= x >> np.uint64(29)
                out.append((row, begin, begin + n, x, np.full(len(row), shift == 0)))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3 + (
            np.zeros(0, np.uint64), np.zeros(0, bool))

    def within_two(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the edit distance of each pair of lines is at most 2, as far as hashes tell (no linked pair is missed).

        Without what both begin and end with, two lines differ in their first and in their
        last character: one edit is there, the other here, and what is between them is equal.
        """
        nx, ny = self.length[x], self.length[y]
        x, y = self.begin[x], self.begin[y]

        def common(most: np.ndarray, equal) -> np.ndarray:
            low, high = np.zeros_like(most), most
            while (low < high).any():
                mid = (low + high + 1) // 2
                same = equal(mid)
                low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
            return low

        head = common(np.minimum(nx, ny), lambda n: self.of(x, x + n) == self.of(y, y + n))
        tail = common(np.minimum(nx, ny) - head, lambda n: self.of(x + nx - n, x + nx) == self.of(y + ny - n, y + ny))
        x, y, nx, ny = x + head, y + head, nx - head - tail, ny - head - tail
        found = np.maximum(nx, ny) <= 2
        edits = ((1, 1), (1, 0), (0, 1))
        for left_x, left_y in edits:
            for right_x, right_y in edits:
                n = nx - left_x - right_x
                at = np.flatnonzero(~found & (n >= 0) & (n == ny - left_y - right_y))
                a, b, n = x[at] + left_x, y[at] + left_y, n[at]
                found[at] = self.of(a, a + n) == self.of(b, b + n)
        return found


def _entries(docs: DataFrame, distance: int, min_chars: int) -> DataFrame:
    """bucket, node, hub, size: index entries (hub) and probe entries of the distinct lines of each piece of a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE):  # hashes take many times the room of their lines
            lines = list(dict.fromkeys(line for text in batch.column("text").to_pylist() for _, line in _lines(text, min_chars)))
            hashed, nodes = _Hashed(lines), np.array([_hash(x) for x in lines], np.uint64).view(np.int64)
            row, _, _, key, hub = hashed.keys(min_chars, distance)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(nodes[row]), pa.array(hub), pa.array(hashed.length[row].astype(np.int32))],
                ["bucket", "node", "hub", "size"])

    return _keyed(docs).select("text").mapInArrow(run, "bucket bigint, node bigint, hub boolean, size int")


def _pairs(buckets: np.ndarray, most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of rows with equal buckets, which lie together; about ``most`` at a time."""
    starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
    sizes = np.diff(np.r_[starts, len(buckets)])
    for size in np.unique(sizes[sizes > 1]).tolist():
        first, second = (x.astype(np.int64) for x in np.triu_indices(size, 1))
        at = starts[sizes == size]
        step = max(1, most // len(first))
        for k in range(0, len(at), step):
            for m in range(0, len(first), most):
                yield (at[k:k + step, None] + first[m:m + most]).ravel(), (at[k:k + step, None] + second[m:m + most]).ravel()


def _confirmed(lines: list[str], x: np.ndarray, y: np.ndarray, distance: int) -> np.ndarray:
    """Whether the edit distance of each pair is at most ``distance``; pairs of near lengths are compared together."""
    out, most = np.zeros(len(x), bool), 1 << 18
    lengths = np.array([len(lines[i]) for i in x], np.int64)
    order = np.argsort(lengths, kind="stable")
    while len(order):
        held = np.cumsum(lengths[order])
        n = max(1, int(np.searchsorted(held, most, "right")))
        part, order = order[:n], order[n:]
        out[part] = edit_within([lines[i] for i in x[part]], [lines[i] for i in y[part]], distance)
    return out


class _Groups:
    """Nodes joined by pairs; the least of a group is its root."""

    def __init__(self, root: dict[int, int]):
        self.root = root

    def find(self, i: int) -> int:
        while (above := self.root.setdefault(i, i)) != i:
            self.root[i] = i = self.root[above]
        return i

    def join(self, x: np.ndarray, y: np.ndarray) -> list[int]:
        """Join pairs of nodes; the places of those that were apart."""
        out = []
        for k, (a, b) in enumerate(zip(x.tolist(), y.tolist())):
            a, b = self.find(a), self.find(b)
            if a != b:
                self.root[max(a, b)] = min(a, b)
                out.append(k)
        return out


def _solved(nodes: list[int], buckets: list[int], hubs: list[bool], lines: list[str], distance: int) -> list[tuple[int, int]]:
    """(least, other) of the nodes that links inside the buckets connect; rows of a bucket lie together."""
    nodes, hubs, hashed, groups = np.array(nodes, np.int64), np.array(hubs, bool), _Hashed(lines), _Groups({})
    for x, y in _pairs(np.array(buckets, np.int64)):
        likely = (hubs[x] | hubs[y]) & (nodes[x] != nodes[y]) & (np.abs(hashed.length[x] - hashed.length[y]) <= distance)
        x, y = x[likely], y[likely]
        if distance <= 2:
            near = hashed.within_two(x, y)
            x, y = x[near], y[near]
        joined = _Groups(dict(groups.root))
        once = joined.join(nodes[x], nodes[y])
        if distance != 2 or not _confirmed(lines, x[once], y[once], distance).all():
            # a hash has said too much, or says nothing of this distance
            linked, joined = _confirmed(lines, x, y, distance), groups
            joined.join(nodes[x[linked]], nodes[y[linked]])
        groups = joined
    return [(groups.find(i), i) for i in list(groups.root) if groups.find(i) != i]


def _shortened(text: str, distance: int) -> set[tuple[str, int, int]]:
    """(key, extra, cap) of what up to ``distance`` deletions leave of a text; see ``_finer``."""
    out = set()
    for n in range(min(distance, len(text)) + 1):
        for gone in combinations(range(len(text)), n):
            left = "".join(x for i, x in enumerate(text) if i not in gone)
            gaps = [i - k for k, i in enumerate(gone)]  # places in what is left
            for m in range(n + 1):
                out |= {(f"{','.join(map(str, changed))}:{left}", n - m, distance - m) for changed in combinations(gaps, m)}
    return out


def _finer(distance: int, min_chars: int):
    """Entries of what is left of a bucket's lines without the segment they share.

    Linked lines are within the distance outside a segment they share as well,
    so they meet again by a segment of the rest.  A rest too short to be split
    goes to last buckets, as does one up to ``distance`` longer, to meet those too short.  Such a bucket is for what
    deletions leave of a rest, and for those places of them (``changed``) where the other rest has another
    character; the deletions at other places are ``extra``.  So two rests of a bucket are as many
    edits apart as it has changed places and they have extra ones, and rests within the distance share such a bucket.
    """
    least = 2 * (distance + 1)

    def cut(buckets: list[int], parents: list[int], rests: list[str]) -> Iterator[tuple[int, str]]:
        """Row and rest without what the row's bucket stands for."""
        first = [i for i, parent in enumerate(parents) if not parent]
        hashed = _Hashed([rests[i] for i in first])
        row, begin, end, key, _ = hashed.keys(min_chars, distance)
        same = key.view(np.int64) == np.array([buckets[i] for i in first], np.int64)[row]
        found = {(first[i], rests[first[i]][:b] + rests[first[i]][e:])
                 for i, b, e in zip(row[same].tolist(), begin[same].tolist(), end[same].tolist())}
        plans: dict[int, list] = {}
        for i, (bucket, parent, rest) in enumerate(zip(buckets, parents, rests)):
            if parent:
                key = bucket & ((1 << 64) - 1)
                found |= {(i, rest[:b] + rest[e:]) for seed, b, e, _ in _plan(len(rest), distance, plans)
                          if _hash(f"{parent}:{rest[b:e]}", seed) == key}
        yield from sorted(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans: dict[int, list] = {}
        for batch in slices(batches, "rest", 1 << 14):  # a short rest has a hundred entries and more
            out = []
            buckets, nodes, parents, rests = (batch.column(c).to_pylist() for c in ("bucket", "node", "parent", "rest"))
            for i, left in cut(buckets, parents, rests):
                bucket, node = buckets[i], nodes[i]
                if len(left) < least + distance:
                    out += [(_hash(f"{bucket}:-{some}"), node, True, len(left), bucket, left, True, extra, cap)
                            for some, extra, cap in _shortened(left, distance)]
                if len(left) >= least:
                    out += [(_hash(f"{bucket}:{left[b:e]}", seed), node, hub, len(left), bucket, left, False, 0, 0)
                            for seed, b, e, hub in _plan(len(left), distance, plans)]
            columns = list(zip(*out)) if out else [()] * 9
            types = [pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([_signed(list(columns[0]))] + [pa.array(x, t) for x, t in zip(columns[1:], types)],
                                             ["bucket", "node", "hub", "size", "parent", "rest", "last", "extra", "cap"])

    def finer(crowded: DataFrame) -> DataFrame:
        return crowded.select("bucket", "node", "parent", "rest").distinct().mapInArrow(
            run, "bucket bigint, node bigint, hub boolean, size int, parent bigint, rest string, last boolean, extra int, cap int").distinct()

    return finer


def _met(entries: DataFrame) -> DataFrame:
    """Entries of buckets that hold an index entry and more; read in a stream, bucket by bucket."""
    inside = Window.partitionBy("bucket").orderBy(F.desc("hub"), "node")
    entries = (entries.withColumn("indexed", F.first("hub").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
               .withColumn("last", F.lag(F.struct("hub", "node")).over(inside)).withColumn("next", F.lead("node").over(inside)))
    repeated = F.coalesce(F.col("last") == F.struct("hub", "node"), F.lit(False))
    alone = F.col("last").isNull() & F.col("next").isNull()
    return entries.filter(F.col("indexed") & ~repeated & ~alone).select("bucket", "node", "hub", "size")


def _comparer(docs: DataFrame, distance: int, min_chars: int):
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE):
            lines = list(dict.fromkeys(line for text in batch.column("text").to_pylist() for _, line in _lines(text, min_chars)))
            yield pa.RecordBatch.from_arrays([_signed([_hash(x) for x in lines]), pa.array(lines, pa.string())], ["node", "line"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "line_a", 1 << 18):
            linked = edit_within(batch.column("line_a").to_pylist(), batch.column("line_b").to_pylist(), distance)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked)], ["a", "b", "linked"])

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, ...] = ([], [], [], [])  # rows of the last bucket, which may go on in the next batch

        def edges(rows: tuple[list, ...]) -> pa.RecordBatch:
            found = _solved(*rows, distance)
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())],
                                              ["a", "b"])

        for batch in slices(batches, "line", 1 << 19):
            rows = tuple(x + batch.column(c).to_pylist() for x, c in zip(held, ("node", "bucket", "hub", "line")))
            end = next(i for i in range(len(rows[1]), 0, -1) if i == 1 or rows[1][i - 2] != rows[1][-1]) - 1
            held = tuple(x[end:] for x in rows)
            if end:
                yield edges(tuple(x[:end] for x in rows))
        if held[0]:
            yield edges(held)

    def prepare(nodes: DataFrame):
        lines = _keyed(docs).select("text").mapInArrow(texts, "node bigint, line string")
        # one plan at any size: texts move once, by node, and stay where the join leaves them
        lines = lines.join(nodes.hint("shuffle_hash"), "node", "left_semi")
        lines = written(packed(lines.dropDuplicates(["node", "line"])), "line-texts")
        split = _finer(distance, min_chars)

        def solve(members: DataFrame) -> DataFrame:
            return members.join(lines, "node").repartition("bucket").sortWithinPartitions("bucket") \
                .select("node", "bucket", "hub", "line").mapInArrow(solved, "a bigint, b bigint")

        def finer(crowded: DataFrame) -> DataFrame:
            if "rest" not in crowded.columns:
                crowded = crowded.join(lines.withColumnRenamed("line", "rest"), "node").withColumn("parent", F.lit(0).cast("bigint"))
            return split(crowded)

        def compare(pairs: DataFrame) -> DataFrame:
            # near lengths together: the longest line of a piece sets its number of steps
            both = (pairs.join(lines.select(F.col("node").alias("a"), F.col("line").alias("line_a")), "a")
                    .join(lines.select(F.col("node").alias("b"), F.col("line").alias("line_b")), "b")
                    .select("a", "b", "line_a", "line_b", F.length("line_a").alias("n")).sortWithinPartitions("n").drop("n"))
            return both.mapInArrow(run, "a bigint, b bigint, linked boolean")

        return solve, compare, finer

    return prepare


def line_groups(docs: DataFrame, distance: int = 2, min_chars: int = 20, short_copies: bool = False) -> tuple[DataFrame, DataFrame]:
    """Occurrences of compared lines, and for each line that is not alone the first place of its group.

    With ``short_copies``, lines under ``min_chars`` are compared too, for equality.

    The second has node, check and ``first`` (a struct in document order).  Two
    lines with one ``node`` hash are told apart by ``check``.
    """
    if min_chars <= distance:
        raise ValueError("min_chars must exceed distance")
    occurrences = written(packed(_occurrences(docs, 1 if short_copies else min_chars)), "occurrences")
    met = written(packed(_met(_entries(docs, distance, min_chars))), "line-entries")
    roots = link_refined(met, _comparer(docs, distance, min_chars))
    place = _place()
    lines = written(packed(occurrences.groupBy("node", "check").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))), "lines")
    rooted = with_roots(lines, roots)
    # a line in no link is a group of its own under (node, check)
    rooted = rooted.join(roots.select(F.col("root").alias("__linked")).distinct(), F.col("root") == F.col("__linked"), "left")
    group = ["root", F.when(F.col("__linked").isNull(), F.col("check")).alias("own")]
    grouped = rooted.select(*group, "node", "check", "first", "n")
    firsts = grouped.groupBy("root", "own").agg(F.min("first").alias("group_first"), F.sum("n").alias("group_n")) \
        .filter("group_n > 1").select(F.col("root").alias("r"), F.col("own").alias("o"), "group_first")
    named = grouped.join(firsts, (F.col("root") == F.col("r")) & F.col("own").eqNullSafe(F.col("o")))
    return occurrences, named.select("node", "check", F.col("group_first").alias("first"))


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "place")


def dedup_lines(docs: DataFrame, distance: int = 2, min_chars: int = 20, short_copies: bool = False) -> DataFrame:
    """``docs`` with the text of kept lines, ``n_lines`` and ``n_dropped``; a row for every row of ``docs``."""
    occurrences, groups = line_groups(docs, distance, min_chars, short_copies)
    groups = written(packed(groups), "line-groups")
    dropped = occurrences.join(groups, ["node", "check"]).filter(_place() != F.col("first")) \
        .select("doc_id", "text_key", "place").distinct()
    by_doc = dropped.groupBy("doc_id", "text_key").agg(F.collect_list("place").alias("__places")) \
        .select(F.col("doc_id").alias("__doc_id"), F.col("text_key").alias("__text_key"), "__places")
    plain = docs.drop("n_lines", "n_dropped")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = plain.withColumn("text", text).withColumn("__key", F.xxhash64(text))
    rows = rows.join(by_doc, F.col("doc_id").cast("bigint").eqNullSafe(F.col("__doc_id"))
                     & (F.col("__key") == F.col("__text_key")), "left").select(*(F.col(f"`{c}`") for c in plain.columns), "__places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", PIECE):
            kept, n_lines, n_dropped = [], [], []
            for value, places in zip(batch.column("text").to_pylist(), batch.column("__places").to_pylist()):
                lines = value.split("\n") if value else []
                gone = set(places or ())
                kept.append("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else value)
                n_lines.append(len(lines)), n_dropped.append(len(gone))
            at = batch.schema.get_field_index("text")
            rest = batch.set_column(at, "text", pa.array(kept, pa.string())).drop_columns("__places")
            yield pa.RecordBatch.from_arrays(rest.columns + [pa.array(n_lines, pa.int32()), pa.array(n_dropped, pa.int32())],
                                             rest.schema.names + ["n_lines", "n_dropped"])

    schema = ", ".join(f"`{f.name}` {'string' if f.name == 'text' else f.dataType.simpleString()}" for f in plain.schema)
    return rows.mapInArrow(run, f"{schema}, n_lines int, n_dropped int")
