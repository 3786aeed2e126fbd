"""Topology relations in three values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def same(pairs: DataFrame, a: Column, b: Column, known: DataFrame, related: DataFrame, out: str = "_true") -> DataFrame:
    """Equal or related: true; both known: false; else null.  Relations go both ways and no further.

    known(node), related(a, b); both are as small as the network and are joined on their key.
    """
    rows = pairs.withColumn("_x", a).withColumn("_y", b)
    both = related.select(F.least("a", "b").alias("_lo"), F.greatest("a", "b").alias("_hi")).distinct().withColumn("_rel", F.lit(True))
    nodes = known.select("node").distinct()
    rows = rows.join(both, (F.least("_x", "_y") == F.col("_lo")) & (F.greatest("_x", "_y") == F.col("_hi")), "left")
    rows = rows.join(nodes.select(F.col("node").alias("_kx"), F.lit(True).alias("_has_x")), F.col("_x") == F.col("_kx"), "left")
    rows = rows.join(nodes.select(F.col("node").alias("_ky"), F.lit(True).alias("_has_y")), F.col("_y") == F.col("_ky"), "left")
    value = F.when(F.col("_x") == F.col("_y"), True).when(F.col("_rel"), True).when(F.col("_has_x") & F.col("_has_y"), False)
    return rows.withColumn(out, value).drop("_x", "_y", "_lo", "_hi", "_rel", "_kx", "_has_x", "_ky", "_has_y")


def upstream_of(edges: dict, known: set, up, down, hops: int = 16) -> tuple[bool | None, str | None]:
    """Whether up is met on the way up from down, with the code of a fault.

    edges: node -> nodes above it.  The same node is not upstream of itself; an unknown node gives None; a cycle
    anywhere on the way, or a way longer than hops, gives False with a code.  A node is compared before its hop counts.
    """
    if up == down:
        return False, None
    if up not in known or down not in known:
        return None, None
    found = cycle = long = False
    done: set = set()
    # (node, hops so far, whether its parents have been walked)
    path: list = []
    stack = [(down, 0, False)]
    while stack:
        node, n, left = stack.pop()
        if left:
            path.pop()
            done.add(node)
            continue
        if node in path:
            cycle = True
            continue
        if node in done:
            continue
        if n and node == up:
            found = True
        if n > hops:
            long = True
            continue
        path.append(node)
        stack.append((node, n, True))
        stack.extend((x, n + 1, False) for x in sorted(edges.get(node, ()), reverse=True))
    if cycle:
        return False, "ADGL3006"
    if long and not found:
        return False, "ADGL3006"
    return found, None


def upstream(pairs: DataFrame, up: Column, down: Column, known: DataFrame, edges: DataFrame, hops: int = 16, out: str = "_true") -> DataFrame:
    """pairs with whether up is met on the way up from down, in three values: as upstream_of, for whole tables.

    A node is not above itself; a pair with an unknown node is null; a way up that leads into a cycle is false, and so is one
    longer than hops steps to a node that is compared.  edges(up, down) and known(node) are as small as a topology.
    """
    above = reach(edges, hops + 1)
    direct = edges.select(F.col("up").alias("_u"), F.col("down").alias("_d")).distinct()
    # A node of a cycle is above a node that is above it, or above itself.
    turning = above.join(direct, (F.col("up") == F.col("_d")) & (F.col("down") == F.col("_u"))).select(F.col("up").alias("node")).unionByName(direct.where("_u = _d").select(F.col("_u").alias("node")))
    into = above.join(turning.distinct(), F.col("up") == F.col("node"), "left_semi").select(F.col("down").alias("_bad")).unionByName(turning.select(F.col("node").alias("_bad"))).distinct()
    nodes = known.select("node").distinct()
    rows = pairs.withColumn("_x", up).withColumn("_y", down)
    rows = rows.join(above.select(F.col("up").alias("_cu"), F.col("down").alias("_cd"), F.lit(True).alias("_met")), (F.col("_x") == F.col("_cu")) & (F.col("_y") == F.col("_cd")), "left")
    rows = rows.join(into.withColumn("_cycle", F.lit(True)), F.col("_y") == F.col("_bad"), "left")
    for side in "xy":
        rows = rows.join(nodes.select(F.col("node").alias(f"_k{side}"), F.lit(True).alias(f"_has_{side}")), F.col(f"_{side}") == F.col(f"_k{side}"), "left")
    value = F.when(F.col("_x") == F.col("_y"), False).when(F.col("_has_x").isNull() | F.col("_has_y").isNull(), F.lit(None).cast("boolean"))
    value = value.when(F.col("_cycle"), False).otherwise(F.coalesce("_met", F.lit(False)))
    return rows.withColumn(out, value).drop("_x", "_y", "_cu", "_cd", "_met", "_bad", "_cycle", "_kx", "_ky", "_has_x", "_has_y")


def reach(upstream: DataFrame, hops: int = 16, limit: int = 1_000_000) -> DataFrame:
    """(up, down, n): every node above a node, by a bounded walk of frontier joins; n is the least number of steps.

    A step keeps the pairs that are new, so cycles end.  More than limit pairs are an error: a topology is small.
    """
    seen = upstream.select("up", "down").where("up <> down").distinct().withColumn("n", F.lit(1))
    edges = upstream.select(F.col("up").alias("_up"), F.col("down").alias("_mid")).distinct()
    size = seen.count()
    for n in range(2, hops + 1):
        step = seen.join(edges, F.col("up") == F.col("_mid")).select(F.col("_up").alias("up"), "down").where("up <> down").distinct().withColumn("n", F.lit(n))
        seen = seen.unionByName(step).groupBy("up", "down").agg(F.min("n").alias("n"))
        new = seen.count()
        if new > limit:
            raise ValueError(f"the topology has more than {limit} pairs")
        if new == size:
            break
        size = new
    return seen
