"""Connected components, and linking by buckets without all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges with a < b: every b is given its least neighbour, and so are its other smaller neighbours."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(least.select(F.col("m").alias("a"), "b")).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every larger end has one edge and is nowhere the smaller end."""
    ends = edges.select(F.col("a").alias("n"), F.lit(0).alias("larger"), F.lit(1).alias("smaller")).union(
        edges.select("b", F.lit(1), F.lit(0)))
    ends = ends.groupBy("n").agg(F.sum("larger").alias("larger"), F.max("smaller").alias("smaller"))
    return ends.filter("larger > 1 or (larger = 1 and smaller = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node with an edge that isn't its own root; root is the component's least node.

    ``edges`` has long columns a and b, in any order and with repeats.
    Alternates large and small stars (each edge moves to its least neighbour)
    until the edges are the stars of the result; each round is a written table.
    """
    edges = written(packed(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()),
                    "edges")
    while not _are_stars(edges):
        edges = written(packed(_small_star(_large_star(edges))), "stars")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def with_roots(nodes: DataFrame, roots: DataFrame, node: str = "node", root: str = "root") -> DataFrame:
    """Add ``root`` to rows with a node; a node without an edge is its own root."""
    roots = roots.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    return nodes.join(roots, F.col(node) == F.col("__node"), "left") \
        .withColumn(root, F.coalesce("__root", node)).drop("__node", "__root")


#: Buckets of at most so many members are compared pair by pair after their hub.
SMALL = 32


def _crowds(members: DataFrame) -> DataFrame:
    """Members of buckets with two nodes or more and a hub, with the least hub (``low``) and whether there are many (``large``)."""
    buckets = members.groupBy("bucket").agg(
        F.min(F.when(F.col("hub"), F.col("node"))).alias("low"), F.min("node").alias("first"), F.max("node").alias("final"),
        F.count(F.lit(1)).alias("n")).filter("low is not null and first <> final") \
        .select("bucket", "low", (F.col("n") > SMALL).alias("large"))
    return members.join(buckets, "bucket")


#: Buckets of more members, or of more than two with so many characters in all, are split before they are solved.
CROWD, CROWD_SIZE = 1024, 1 << 20


def link_refined(members: DataFrame, comparer: Callable[[DataFrame], tuple[Callable, Callable, Callable]]) -> DataFrame:
    """node, root of the components that links between a hub and another member of a bucket make.

    ``members``: bucket, node (longs), hub (boolean: of a pair, one is a hub) and size (int).
    ``comparer(nodes)`` prepares the nodes that share a bucket and returns three functions:
    solve(members) gives edges a, b that connect what is linked inside each of the
    buckets; compare(pairs) gives a, b, linked for pairs (a, b); and finer(members)
    puts members of one bucket into finer ones that bring all linked members together again.
    Its result has columns of its own and, for buckets that can't be split,
    ``last`` with ``extra`` and ``cap``: there two members are linked if their ``extra`` make at most ``cap``.

    A bucket is solved where it meets, if its size is bounded (``CROWD``).  A larger one is
    split for as long as its members are in several components.  In a last bucket
    a member with the least ``extra`` is linked to all that are linked at all.
    """
    level, edges, tools = members.withColumns({"last": F.lit(False), "extra": F.lit(0), "cap": F.lit(0)}), None, None
    while True:
        buckets = level.groupBy("bucket").agg(
            F.max("hub").alias("any_hub"), F.min("node").alias("first"), F.max("node").alias("final"),
            F.count(F.lit(1)).alias("n"), F.sum("size").alias("chars"), F.min(F.struct("extra", "node")).alias("low")) \
            .filter("any_hub and first <> final") \
            .select("bucket", "low", ((F.col("n") > CROWD) | (F.col("n") > 2) & (F.col("chars") > CROWD_SIZE)).alias("large"))
        shared = written(packed(level.join(buckets, "bucket")), "buckets")
        tools = tools or comparer(shared.select("node").distinct())
        solve, compare, finer = tools
        found = solve(shared.filter("not large and not last").select("bucket", "node", "hub"))
        if edges is not None:
            stars = shared.filter("last and node <> low.node and extra + low.extra <= cap") \
                .select(F.col("low.node").alias("a"), F.col("node").alias("b")).distinct()
            found = edges.union(found).union(compare(stars).filter("linked").select("a", "b"))
        edges = written(packed(found), "linked")
        roots = components(edges)
        crowded = shared.filter("large and not last")
        if crowded.isEmpty():
            return roots
        mixed = with_roots(crowded.select("bucket", "node"), roots).groupBy("bucket") \
            .agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("bucket")
        level = written(packed(finer(crowded.drop("low", "large", "last", "extra", "cap").join(mixed, "bucket"))), "finer")


def link_buckets(members: DataFrame, payload: list[str], may_link: Callable[[str, str], Column],
                 comparer: Callable[[DataFrame], Callable[[DataFrame], DataFrame]],
                 bounded: Callable[[str, str], Column]) -> DataFrame:
    """node, root of the components that links between members of a bucket make.

    ``members``: bucket, node (longs) and the columns of ``payload``.
    ``may_link(x, y)`` is a cheap condition on payload columns with these
    prefixes, true for every link.  ``comparer(nodes)`` prepares the nodes that
    share a bucket and returns compare(pairs), which gives a, b, split, linked for pairs
    (a, b, split) and, where split, columns by which ``bounded(x, y)`` tells of two
    nodes compared with one a whether they can link; it is true for every link.

    Every member of a bucket is compared with the bucket's least node, which
    unites near copies by as many comparisons as there are members.  What still
    lies in several components is compared pair by pair: members of a small bucket, and
    those of a large one's hub that may link and for which ``bounded`` holds.
    So no link between components is lost; of a large group's pairs only those are
    made that the bound can't rule out.
    """
    shared = written(packed(_crowds(members.withColumn("hub", F.lit(True)))), "buckets")
    info = written(packed(shared.groupBy("node").agg(*(F.first(c).alias(c) for c in payload))), "bucket-nodes")

    def described(pairs: DataFrame, side: str, prefix: str) -> DataFrame:
        return pairs.join(info.select(F.col("node").alias(side), *(F.col(c).alias(prefix + c) for c in payload)), side)

    def likely(pairs: DataFrame) -> DataFrame:
        """Distinct pairs that may link; those with the hub of a large bucket stay in any case."""
        pairs = pairs.groupBy("a", "b").agg(F.max("split").alias("split"))
        pairs = described(described(pairs, "a", "x_"), "b", "y_")
        return pairs.filter(F.col("split") | may_link("x_", "y_")).select("a", "b", "split")

    compare = comparer(info.select("node"))
    seen = written(packed(compare(likely(shared.filter("low <> node").select(
        F.col("low").alias("a"), F.col("node").alias("b"), F.col("large").alias("split"))))), "compared")
    edges = seen.filter("linked").select("a", "b")
    roots = components(edges)

    small = _across(with_roots(shared.filter("not large").select("bucket", "node", "hub"), roots))
    groups = with_roots(with_roots(seen.filter("split").drop("split", "linked"), roots, "b", "rb"), roots, "a", "ra")
    mixed = groups.groupBy("a").agg(F.max(F.col("ra") != F.col("rb")).alias("mixed")).filter("mixed").select("a")
    groups = written(packed(described(groups.join(mixed, "a").drop("ra"), "b", "")), "groups")
    x, y = (groups.select("a", *(F.col(c).alias(p + c) for c in groups.columns if c != "a")) for p in ("x_", "y_"))
    large = x.join(y, "a").filter((F.col("x_b") < F.col("y_b")) & (F.col("x_rb") != F.col("y_rb"))
                                  & may_link("x_", "y_") & bounded("x_", "y_"))
    large = large.select(F.col("x_b").alias("a"), F.col("y_b").alias("b"), F.lit(False).alias("split"))
    found = written(packed(compare(likely(small.union(large)))), "compared").filter("linked").select("a", "b")
    return roots if found.isEmpty() else components(edges.union(found))


def _across(rooted: DataFrame) -> DataFrame:
    """All pairs (a, b, split false) of a bucket's members (bucket, node, hub, root) in different components."""
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("bucket")
    rooted = rooted.join(mixed, "bucket")
    x = rooted.filter("hub").select("bucket", F.col("node").alias("x"), F.col("root").alias("xr"))
    y = rooted.select("bucket", F.col("node").alias("y"), F.col("root").alias("yr"), F.col("hub").alias("yh"))
    return x.join(y, "bucket").filter("xr <> yr and (not yh or x < y)") \
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(False).alias("split"))
