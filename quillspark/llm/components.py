"""Connected components of links that never leave the executors.

Each round hooks every vertex to its smallest neighbour, shortens the resulting chains by pointer
jumping, and renames the links by the roots; links inside a tree vanish, so the rest shrinks fast. Rounds
are written to the shared folder, and the renamings are composed at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component`` of every linked vertex; the component is its smallest vertex.

    Links may repeat, stand in either direction and link a vertex with itself; nulls are no links.
    """
    low, high = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    rest = materialise(links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(low.alias("a"), high.alias("b")).distinct(), "links")
    found: DataFrame | None = None
    while not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("root"))
        hook = materialise(hook, "hooks")
        jumped = _follow(hook, hook)
        root = materialise(_follow(jumped, jumped), "roots")
        before, found = found, root if found is None else materialise(_follow(found, root), "found")
        ends = rest.join(root.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a").join(root.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b")
        linked, rest = rest, materialise(ends.filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
        discard(linked, hook, before, root if before is not None else None)
    if found is None:
        return rest.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return found.select("id", F.col("root").alias("component"))


def _follow(one: DataFrame, two: DataFrame) -> DataFrame:
    """The second renaming applied after the first."""
    then = two.select(F.col("id").alias("root"), F.col("root").alias("end"))
    return one.join(then, "root", "left").select("id", F.coalesce("end", "root").alias("root"))
