"""Connected groups from buckets of candidates, in DataFrame operations only.

``link_groups`` pairs off small buckets at once.  In a large one, a round compares every member
with one or a few of them, the hubs; members linked to each other, directly or not, are one group and need no further
comparison.  Hubs leave the bucket, having met all others, so a bucket of n near copies costs
n - 1 comparisons.  Once the members that are left would meet at most ``CROSS`` others each, on
the average, the rounds end: all pairs of different groups that are left meet at once, and no
link is lost.  Members meet in chunks of ``CHUNK``, so that no task has a large bucket whole,
and a cheap test of two members (``may_link``) is a condition of the join itself: a pair that
fails it is never a row.  ``link_near`` does without rounds, for pairs that are dear to verify.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.session import scratch, shuffles_removed

#: Buckets of up to so many members are paired off at once where a cheap test is given, else of two.
WHOLE = 128
#: Hubs of a large bucket in the second round, doubled each round.
SMALL = 4
#: The rounds end when a member of an open bucket has at most so many others there, on the average.
CROSS = 1024
#: Members of a bucket that meet in one group of rows.
CHUNK = 512
#: The same where members are small and a cheap test is made of each two of them.
GRID = 2048


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a compressed table in the shared folder, read back; its shuffle files go."""
    path = scratch(df.sparkSession, label)
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1") \
            .parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, label: str) -> DataFrame:
    """``row`` (unique, fixed) and all columns of ``df`` as ``doc``, as a stored table."""
    return stored(df.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")),
                  label)


def _is_forest_of_stars(e: DataFrame) -> bool:
    """Whether every node hangs on one root, and no root on another."""
    ends = e.select("u").unionByName(e.select(F.col("v").alias("u")).distinct())
    return not ends.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").head(1)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of ``edges`` (a, b); the root is the least node of the group.

    Alternating star contraction: first every larger neighbour, then every smaller one, is
    hung on the least neighbour, until each group is a star.  A contraction is one table
    written: a node's edges are sorted by its task, which spills if they are many.
    """
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
               .where("u != v").distinct(), "edges")
    least = F.min("v").over(Window.partitionBy("u"))
    while not _is_forest_of_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.select("u", "v", F.least("u", least).alias("m")).where("v > u") \
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
        # A node's own edge goes to its least neighbour, and so do its other neighbours.
        small = large.select("u", "v", least.alias("m"))
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                             F.col("m").alias("v"))
        e = stored(small.where("u != v").distinct(), "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _shared(members: DataFrame) -> DataFrame:
    """bucket, node, size, hub (the least node) of the members of buckets that hold two nodes or more."""
    whole = Window.partitionBy("bucket")
    told = members.withColumn("low", F.min("node").over(whole)).withColumn("high", F.max("node").over(whole)) \
        .withColumn("size", F.count(F.lit(1)).over(whole))
    return told.where("low != high").select("bucket", "node", "size", F.col("low").alias("hub"))


def chunked(members: DataFrame) -> DataFrame:
    """``members`` (bucket, size, ...) as often as there are chunks in their bucket.

    ``first`` and ``second`` (first <= second) name two chunks of the bucket that meet, ``own``
    the one of them that holds the member.  Every two members of a bucket meet exactly once.
    """
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    dealt = members.withColumn("own", F.pmod(F.xxhash64("node", F.lit(7)), chunks).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    return dealt.withColumn("first", F.least("own", "other")).withColumn("second", F.greatest("own", "other")) \
        .drop("other")


def _always(x: Column, y: Column) -> Column:
    return F.lit(True)


def _told(members: DataFrame, told: DataFrame | None) -> DataFrame:
    return members.withColumn("told", F.col("node")) if told is None else members.join(told, "node")


def cross_pairs(members: DataFrame, may_link: Callable[[Column, Column], Column]) -> DataFrame:
    """Distinct pairs (a, b), a < b, of ``members`` (bucket, size, node, root, told) of one bucket
    and different roots that ``may_link`` lets pass, by what is told of both."""
    dealt = chunked(members).select("bucket", "first", "second", "own", "node", "root", "told")
    x = dealt.where("own = first").drop("own")
    y = dealt.where("own = second").select(
        "bucket", "first", "second", F.col("node").alias("node_y"), F.col("root").alias("root_y"),
        F.col("told").alias("told_y"))
    pairs = x.join(y.hint("merge"), ["bucket", "first", "second"]).where(
        "root != root_y and (first < second or node < node_y)").where(may_link(F.col("told"), F.col("told_y")))
    return pairs.select(F.least("node", "node_y").alias("a"), F.greatest("node", "node_y").alias("b")).distinct()


def link_groups(members: DataFrame, verify: Callable[[DataFrame], DataFrame], told: DataFrame | None = None,
                may_link: Callable[[Column, Column], Column] | None = None,
                finish: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(links, groups) of ``members`` (bucket, node): pairs that ``verify`` keeps, and their groups.

    ``verify`` takes distinct pairs (a, b), a < b, and returns those that are alike.  ``may_link``
    is false only of two that are not, by what ``told`` (node, told) says of both; without it the
    node itself is told.  ``finish``, if given, takes the members (bucket, size, node, root) that
    are open after the first round and returns links enough to connect all that are alike.
    ``links`` (a, b) connect each group; ``groups`` (node, root) has the nodes with a link.
    """
    spark: SparkSession = members.sparkSession
    nothing = spark.createDataFrame([], "a long, b long")
    all_ = stored(_shared(members), "members")
    large = F.col("size") > (2 if may_link is None else WHOLE)
    # The first hub of a bucket is its least node.
    pairs = all_.where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b"), "size")
    if may_link is not None:
        pairs = pairs.where(large).select("a", "b").unionByName(
            cross_pairs(_told(all_.where(~large).withColumn("root", F.col("node")), told), may_link))
    tested, links = [stored(pairs.select("a", "b").distinct(), "pairs")], []
    links.append(stored(verify(tested[0]).select("a", "b"), "links"))
    groups = components(links[0])
    open_ = all_.where(large & (F.col("node") != F.col("hub"))).select("bucket", "node")
    round_ = 0
    while True:
        rooted, wide = _still_open(open_, groups)
        rows, most = wide.agg(F.sum("size"), F.sum(F.col("size").cast("double") * F.col("size"))).first()
        if not rows:
            break
        rooted = rooted.join(wide, "bucket")
        if finish is not None:
            links.append(stored(finish(rooted.select("bucket", "size", "node", "root")).select("a", "b"), "links"))
        elif most <= rows * CROSS:
            # What a hub has met already is not asked again.
            pairs = cross_pairs(_told(rooted, told), may_link or _always).join(union(tested), ["a", "b"], "left_anti")
            links.append(stored(verify(stored(pairs, "pairs")).select("a", "b"), "links"))
        if finish is not None or most <= rows * CROSS:
            groups = components(groups.select(F.col("node").alias("a"), F.col("root").alias("b"))
                                .unionByName(links[-1]))
            break
        # About SMALL hubs, doubled each round, and always the least node.
        share = F.greatest(F.ceil(F.col("size") / (SMALL * 2 ** round_)), F.lit(1))
        chosen = (F.col("size") <= SMALL) | (F.col("node") == F.col("first")) | (
            F.pmod(F.xxhash64("node", F.lit(round_)), share) == 0)
        rooted = stored(rooted.select("bucket", "node", "root", chosen.alias("hub")), "rooted")
        hubs = rooted.where("hub").select(
            "bucket", F.col("node").alias("other"), F.col("root").alias("other_root"))
        pairs = rooted.join(hubs, "bucket").where(
            "root != other_root and (not hub or other < node)").select(
            F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
        pairs = stored(pairs.join(union(tested), ["a", "b"], "left_anti"), "pairs")
        tested.append(pairs)
        links.append(stored(verify(pairs).select("a", "b"), "links"))
        # Groups are joined by the new links between them.
        groups = components(groups.select(F.col("node").alias("a"), F.col("root").alias("b"))
                            .unionByName(links[-1]))
        open_ = rooted.where("not hub").select("bucket", "node")
        round_ += 1
    return union([nothing, *links]), groups


def _against_hubs(members: DataFrame) -> DataFrame:
    """told_x, told_y and nodes x, y: each hub of ``members`` (bucket, node, hub, told) and the others there."""
    hubs = members.where("node = hub").select("bucket", F.col("node").alias("x"), F.col("told").alias("told_x"))
    rest = members.where("node != hub").select("bucket", F.col("node").alias("y"), F.col("told").alias("told_y"))
    return hubs.join(rest, "bucket")


def _still_apart(members: DataFrame) -> DataFrame:
    """told_x, told_y and nodes x, y of one bucket and different roots, but for pairs with its hub.

    ``members`` (bucket, node, size, hub, root, told) that the hub's group has not joined meet each
    other and those it has, in a grid of chunks; of that group no two meet, however many they are.
    """
    bucket = Window.partitionBy("bucket")
    rooted = members.where("size > 2").withColumn("main", F.min(F.struct("node", "root")).over(bucket)["root"] == F.col("root"))
    rooted = rooted.withColumn("strays", F.count_if(~F.col("main")).over(bucket)).where("strays > 0 and node != hub")
    of_x, of_y = (F.ceil(F.col(n) / GRID).cast("int") for n in ("strays", "size"))
    x = rooted.where("not main").select(
        "bucket", F.pmod(F.xxhash64("node", F.lit(7)), of_x).cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), of_y - 1)).alias("j"),
        F.col("node").alias("x"), F.col("root").alias("root_x"), F.col("told").alias("told_x"))
    y = rooted.select(
        "bucket", F.explode(F.sequence(F.lit(0), of_x - 1)).alias("i"),
        F.pmod(F.xxhash64("node", F.lit(7)), of_y).cast("int").alias("j"), "main",
        F.col("node").alias("y"), F.col("root").alias("root_y"), F.col("told").alias("told_y"))
    return x.join(y.hint("merge"), ["bucket", "i", "j"]).where("root_x != root_y and (main or x < y)")


def link_near(members: DataFrame, verify: Callable[[DataFrame], DataFrame], told: DataFrame,
              may_link: Callable[[Column, Column], Column], limit: Callable[[Column, Column], Column]) -> DataFrame:
    """The groups (node, root) of ``members`` (bucket, node), for pairs that are dear to verify.

    ``verify``, ``told`` and ``may_link`` are as in ``link_groups``; ``verify`` is given besides what
    ``limit`` makes of what is told of both nodes, as ``limit``.  First every bucket's members meet
    its hub only; what is then in different groups meets at once.  So a bucket of near copies brings
    a pair a member to be verified, whatever its size.
    """
    all_ = stored(stored(_shared(members), "members").join(told, "node"), "told")
    groups = None
    for meet in (_against_hubs, _still_apart):
        if groups is not None:
            all_ = all_.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
        both = F.col("told_x"), F.col("told_y")
        pairs = meet(all_).where(may_link(*both)).select(
            F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), limit(*both).alias("limit")).distinct()
        links = stored(verify(stored(pairs, "pairs")).select("a", "b"), "links")
        if groups is not None:
            links = links.unionByName(groups.select(F.col("node").alias("a"), F.col("root").alias("b")))
        groups = components(links)
    return groups


def _still_open(open_: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with their roots, and the buckets in which these differ: bucket, size, first."""
    rooted = stored(open_.join(groups, "node", "left").select(
        "bucket", "node", F.coalesce("root", "node").alias("root")), "rooted")
    wide = rooted.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("size"), F.min("root").alias("low"), F.max("root").alias("high"),
        F.min("node").alias("first")).where("low != high").drop("low", "high")
    return rooted, stored(wide, "open")
