"""Connected components by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame, functions as F

from hitlens.session import checkpoint


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Re-hang neighbours on the least node they see.

    Large star moves the greater neighbours of a node, small star its lesser ones and
    itself. The minimum combines map-side and is written out, so that the join back reads two
    plain inputs and adaptive execution can split a node with very many neighbours; no
    neighbour list is ever built.
    """
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hub = checkpoint(both.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("m")))
        moved = both.where(F.col("b") > F.col("a")).join(hub, F.col("a") == F.col("_a")).select(
            F.col("b").alias("a"), F.least("_a", "m").alias("b"))
        return moved.where(F.col("a") != F.col("b")).distinct()
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    hub = checkpoint(down.groupBy(F.col("a").alias("_a")).agg(F.min("b").alias("m")))
    moved = down.join(hub, F.col("a") == F.col("_a")).select(
        F.col("b").alias("a"), F.col("m").alias("b"))
    own = hub.select(F.col("_a").alias("a"), F.col("m").alias("b"))
    return moved.union(own).where(F.col("a") != F.col("b")).distinct()


def _fingerprint(edges: DataFrame):
    mixed = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(mixed, 20)),
                           F.sum(mixed.bitwiseAND(F.lit(0xFFFFF)))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) -> (node, component), the component being its least node.

    Converges in a number of rounds logarithmic in the longest chain. Every round ends in a
    reliable checkpoint, which also survives the loss of an executor.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    current = checkpoint(edges.where(F.col("a") != F.col("b")).distinct())
    seen = _fingerprint(current)
    while True:
        current = checkpoint(_star(checkpoint(_star(current, True)), False))
        now = _fingerprint(current)
        if now == seen:
            break
        seen = now
    return (nodes.join(current.withColumnsRenamed({"a": "node", "b": "component"}), "node", "left")
            .select("node", F.coalesce("component", "node").alias("component")))
