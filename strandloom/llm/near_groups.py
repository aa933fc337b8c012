"""Classes of near-duplicates from buckets of candidates, without all pairs of a bucket.

Members of a bucket are compared with its centre, the member with the least id,
first; what is found joined needs no more comparisons among itself, since a
class is a connected component.  Buckets whose other members are still of
several classes are compared within, in groups of bounded size that hold both
sides of each pair, and give only the links that join classes.  So every pair of
a bucket is either compared or already connected: no link is lost, a bucket of n
copies costs n comparisons, and no step makes a row for each pair.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import maybe_broadcast, stored
from strandloom.llm.components import components

#: Members of a bucket on either side of a group in which all pairs meet, on average, if they come with texts.
CHUNK = 256


def with_centres(members: DataFrame) -> DataFrame:
    """(key, id, centre) of the members (key, id) of each bucket beside its centre, the least id."""
    buckets = members.groupBy("key").agg(F.min("id").alias("centre"), F.count("*").alias("n")).where("n > 1").drop("n")
    return members.join(buckets.hint("shuffle_hash"), "key").where("id <> centre").select("key", "id", "centre")


def near_classes(inside: DataFrame, verify: Callable[[DataFrame], DataFrame], within: Callable[[DataFrame], DataFrame], given: DataFrame | None = None, chunk: int = CHUNK, carried: list[str] | None = None) -> DataFrame:
    """(id, class) of all ids that are linked to another, as a stored table.

    inside: a stored table (key, id, centre, near): each key a bucket, its
    members beside its centre, and whether a member may be linked to the centre
    at all.  verify: of a stored table of pairs (a, b), those that are linked.
    within: of a stored table (key, part, id, class), links (a, b) that connect
    the classes of each (key, part) as all its links would.  given: links known
    already.  chunk: members on either side of such a group, on average.
    carried: columns of inside that within gets too.
    """
    star = inside.where("near").groupBy(F.col("centre").alias("a"), F.col("id").alias("b")).agg(F.count("*").alias("shared"))
    star = stored(star, "star")
    # first each id with that centre alone with which it shares most buckets
    first = stored(star.groupBy("b").agg(F.max(F.struct("shared", (-F.col("a")).alias("least"))).alias("best")).select((-F.col("best.least")).alias("a"), "b"), "pairs")
    edges = stored(verify(first) if given is None else verify(first).unionAll(given), "links")
    classes = stored(components(edges), "classes")
    # then with its other centres, if they are in another class
    apart = stored(across(star.select("a", "b").join(first, ["a", "b"], "left_anti"), classes), "pairs")
    if apart.take(1):
        edges = stored(edges.unionAll(verify(apart)), "links")
        classes = stored(components(edges), "classes")
    # then the members of a bucket beside its centre among themselves, where they are of several classes
    carried = carried or []
    placed = labelled(inside.select("key", "id", *carried), classes, "id")
    mixed = placed.groupBy("key").agg(F.min("id_class").alias("low"), F.max("id_class").alias("high"), F.count("*").alias("n")).where("low <> high")
    chunks = F.ceil(F.col("n") / chunk)
    rows = placed.join(mixed.select("key", chunks.alias("chunks")), "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    part = F.least("own", "other") * F.col("chunks") + F.greatest("own", "other")
    rest = stored(rows.select("key", part.alias("part"), "id", F.col("id_class").alias("class"), *carried), "mixed")
    if rest.take(1):
        edges = stored(edges.unionAll(within(rest)), "links")
        classes = stored(components(edges), "classes")
    return classes


class Joined:
    """Which members of a group are of one class so far."""

    def __init__(self, classes: list[int]):
        first: dict[int, int] = {}
        self.of = [first.setdefault(c, k) for k, c in enumerate(classes)]

    def root(self, k: int) -> int:
        while self.of[k] != k:
            self.of[k] = self.of[self.of[k]]
            k = self.of[k]
        return k

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.of[max(i, j)] = min(i, j)


def labelled(df: DataFrame, classes: DataFrame, name: str) -> DataFrame:
    """df with the class of the id in column name; an id without links is its own class."""
    own = classes.select(F.col("id").alias(name), F.col("class").alias(f"{name}_class"))
    return df.join(maybe_broadcast(own, 16), name, "left").withColumn(f"{name}_class", F.coalesce(f"{name}_class", name))


def across(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    return labelled(labelled(pairs, classes, "a"), classes, "b").where("a_class <> b_class").select("a", "b")
