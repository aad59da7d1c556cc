"""Connected components by distributed union-find (large star, small star)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import materialize

ROUNDS = 1   # meetings of nodes with heads of cells before all the others are compared
CELL = 4     # nodes in a cell, about
EARLIER = 8  # signatures before its own that a row of a node carries


def _hook(edges: DataFrame, name: str, larger_only: bool) -> DataFrame:
    """Hang every neighbour of a node on the least node among them and itself.

    The least neighbours come from partial aggregation and are written, so that
    both sides of the join are plain and Spark can split a node with very many
    links over several tasks.
    """
    least = materialize(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")), name)
    hung = edges.join(least, "a")
    if larger_only:
        return hung.where("b > a and b > least").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
    moved = hung.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    own = least.where("a <> least").select("a", F.col("least").alias("b"))
    return moved.union(own).distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): for each node of a link the least node it reaches.

    ``links`` has two columns of one ordered type; loops and repeats are
    allowed.  Every round is a written table, so a lost executor costs at most
    one round.  The number of rounds grows with the logarithm of the longest
    shortest path.
    """
    a, b = links.columns
    edges = materialize(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
                        .where("a is not null and b is not null and a <> b").distinct(), name)
    while True:
        # Done when only stars are left: no node hangs on two, none on one that hangs itself.
        ends = edges.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("out"), F.lit(0).alias("in"))
        ends = ends.union(edges.select(F.col("b").alias("node"), F.lit(0), F.lit(1)).distinct())
        hanging = ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("in").alias("in"))
        if hanging.where("out > 1 or (out > 0 and in > 0)").isEmpty():
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = materialize(_hook(both, name, larger_only=True), name)
        edges = materialize(_hook(large, name, larger_only=False), name)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _mixed(index: DataFrame, nodes: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """(signature, sid, component, main, n, traits) of the signatures in several components."""
    label = components(links, f"{name}-star")
    marked = materialize(index.join(label.withColumnRenamed("node", "sid"), "sid", "left").select(
        "signature", "sid", F.coalesce("component", "sid").alias("component")), f"{name}-marked")
    main = materialize(marked.groupBy("signature").agg(F.min("component").alias("main"), F.max("component").alias("last"),
                                                       F.count(F.lit(1)).alias("n"))
                       .where("main <> last").select("signature", "main", "n"), f"{name}-mixed")
    return materialize(marked.join(main, "signature").join(nodes, "sid"), f"{name}-open")


def _met(mixed: DataFrame, may_link: Callable[[str, str], Column], number: int, name: str) -> DataFrame:
    """(a, b, count): nodes with the head of their cell, if it is in another component and may link.

    A signature's nodes are dealt to cells of about ``CELL`` by a hash of the
    node, so similar nodes of several signatures mostly meet the same head, and
    a large group is many small ones.
    """
    cells = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("n") / CELL, F.lit(1.0))))).cast("long")
    dealt = mixed.withColumn("cell", F.xxhash64("sid", F.lit(number)).bitwiseAND(cells - 1))
    heads = materialize(dealt.groupBy("signature", "cell").agg(F.min_by(
        F.struct("sid", "component", "traits"), F.xxhash64("sid", F.lit(-1 - number))).alias("head")), f"{name}-cells")
    met = dealt.join(heads, ["signature", "cell"]).where(
        (F.col("component") != F.col("head.component")) & may_link("traits", "head.traits"))
    return met.groupBy(F.col("sid").alias("a"), F.col("head.sid").alias("b")).count()


def _with_earlier(mixed: DataFrame, name: str) -> DataFrame:
    """``mixed`` with ``earlier``: of each node's open signatures the ``EARLIER`` that come before this one."""
    listed = mixed.groupBy("sid").agg(
        F.any_value("component").alias("component"), F.any_value("traits").alias("traits"),
        F.sort_array(F.collect_list(F.struct("signature", "main"))).alias("all"))
    placed = listed.select("sid", "component", "traits", "all", F.posexplode("all").alias("at", "own"))
    start = F.greatest(F.col("at") - EARLIER, F.lit(0))
    return materialize(placed.select(
        "sid", "component", "traits", "own.signature", "own.main",
        F.slice("all", start + 1, F.col("at") - start)["signature"].alias("earlier")), f"{name}-strays")


def linked(index: DataFrame, nodes: DataFrame, may_link: Callable[[str, str], Column],
           plausible: Callable[[DataFrame], DataFrame], verified: Callable[[DataFrame], DataFrame],
           name: str) -> DataFrame:
    """``components`` of all verified links between nodes that share a signature.

    ``index`` has (signature, sid), without repeats.  Signatures with the same
    nodes say the same, so one of each is taken.  The pairs of a large group
    are not all looked at.  First every node meets, of the least nodes of its
    signatures, the plausible one that it shares most with, and then, if it is
    in another component, one of a second choice of nodes.  Then, for every
    signature whose nodes are still in different components, the nodes outside
    its least component meet all others of another component.  Pairs within a
    component need no link, so none is missed.

    ``nodes`` has (sid, traits), and ``may_link`` makes a cheap condition from
    the traits of two nodes; it is part of the join, so pairs that it excludes
    are never emitted.  ``plausible`` then drops pairs (a, b) that can't link
    and keeps other columns, ``verified`` drops those that don't.
    """
    members = index.groupBy("signature").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("sid")).alias("x"),
        F.bit_xor(F.xxhash64("sid", F.lit(1))).alias("y"), F.min("sid").alias("head")).where("n > 1")
    heads = materialize(members.groupBy("n", "x", "y").agg(
        F.min("signature").alias("signature"), F.min("head").alias("head")).select("signature", "head"), f"{name}-heads")
    index = materialize(index.join(heads, "signature").select("signature", "sid", "head"), f"{name}-index")
    first = (index.where("sid <> head")
             .groupBy(F.col("sid").alias("a"), F.col("head").alias("b")).count())
    best = (plausible(first).groupBy("a").agg(F.max(F.struct("count", "b")).alias("best"))
            .select("a", F.col("best.b").alias("b")))
    links = materialize(verified(best), f"{name}-links")
    mixed = _mixed(index, nodes, links, name)

    # More rounds with other nodes, now only those that may link: a large group seldom keeps together by one.
    for number in range(1, ROUNDS + 1):
        best = (plausible(_met(mixed, may_link, number, name)).groupBy("a").agg(F.max(F.struct("count", "b")).alias("best"))
                .select("a", F.col("best.b").alias("b")))
        links = materialize(links.union(verified(best)), f"{name}-links")
        mixed = _mixed(index, nodes, links, name)

    placed = _with_earlier(mixed, name)
    strays = placed.where("component <> main").select(
        "signature", F.col("sid").alias("a"), F.col("component").alias("component_a"), F.col("traits").alias("traits_a"),
        F.col("earlier").alias("earlier_a"))
    rest = strays.join(placed, "signature").where(
        (F.col("component_a") != F.col("component"))
        & ((F.col("component") == F.col("main")) | (F.col("a") < F.col("sid")))
        & may_link("traits_a", "traits") & ~F.arrays_overlap("earlier_a", "earlier")).select("a", F.col("sid").alias("b"))
    more = materialize(verified(plausible(rest.distinct())), f"{name}-more")
    return components(links.union(more), name)
