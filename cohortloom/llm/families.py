"""Splits that keep related records together (problem 2)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cohortloom.functions.ids import hash_fraction
from cohortloom.llm.overlap import clean_split
from cohortloom.store import materialize

SHARES = (("train", 0.8), ("valid", 0.1), ("test", 0.1))
#: A component above this share of the total weight is placed by itself; there can be at most 1 / HEAVY of them.
HEAVY = 0.005
#: Ranges of the hash order whose weights are summed before the running sum within each.
RANGES = 1024


def clean_id(c: Column) -> Column:
    """Lower case without outer white space; blank is null."""
    s = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(s != "", s)


def _head(v: str, turn: int) -> Column:
    return F.xxhash64(F.col(v), F.lit(turn)).bitwiseAND(1) == 1


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) of an undirected graph given as (a, b); ``component`` is the smallest vertex of each.

    Random-mate contraction: in each round every vertex draws a coin from a hash of itself and the round; a tail with
    head neighbours collapses into the smallest of them, edges are rewritten by two joins, loops and repeats vanish.
    About a quarter of the remaining vertices go in a round, so rounds grow as the logarithm of the graph. The
    recorded moves form a forest, unwound by doubling. Nulls and loops are dropped, direction and repeats don't matter,
    an empty graph gives an empty result. Each round is written to the shared folder; nothing is collected.
    """
    spark = edges.sparkSession
    pairs = edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    e = materialize(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    vertices = e.select(F.col("a").alias("vertex")).distinct()
    moves: list[DataFrame] = []
    turn = 0
    while not e.isEmpty():
        move = materialize(e.where(~_head("a", turn) & _head("b", turn)).groupBy(F.col("a").alias("v")).agg(F.min("b").alias("to")))
        near, far = move.select(F.col("v").alias("a"), F.col("to").alias("a2")), move.select(F.col("v").alias("b"), F.col("to").alias("b2"))
        e = e.join(near, "a", "left").join(far, "b", "left").select(F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b"))
        e = materialize(e.where(F.col("a") != F.col("b")).distinct())
        moves.append(move)
        turn += 1
    if not moves:
        return spark.createDataFrame([], T.StructType([T.StructField("vertex", edges.schema["a"].dataType), T.StructField("component", edges.schema["a"].dataType)]))
    forest = reduce(DataFrame.unionByName, moves)
    for _ in range(max(1, turn.bit_length())):
        forest = materialize(forest)
        up = forest.select(F.col("v").alias("to"), F.col("to").alias("top"))
        forest = forest.join(up, "to", "left").select("v", F.coalesce("top", "to").alias("to"))
    rooted = vertices.join(forest.select(F.col("v").alias("vertex"), "to"), "vertex", "left").select("vertex", F.coalesce("to", "vertex").alias("root"))
    least = rooted.groupBy("root").agg(F.min("vertex").alias("component"))
    return rooted.join(least, "root").select("vertex", "component")


def families(groups: DataFrame, links: DataFrame) -> DataFrame:
    """(group, family) of every clean group id of ``groups`` (column ``group``) and of accepted links."""
    accepted = links.where(F.lower(F.trim("review_status")) == "accepted")
    joined = components(accepted.select(clean_id(F.col("left_group_id")).alias("a"), clean_id(F.col("right_group_id")).alias("b")))
    alone = groups.select(F.col("group").alias("vertex"))
    return alone.join(joined, "vertex", "full").select(F.col("vertex").alias("group"), F.coalesce("component", "vertex").alias("family"))


def assign(weights: DataFrame, seed: int = 42, shares: tuple = SHARES) -> DataFrame:
    """(family, assigned) for (family, weight), one row each: whole families, shares of the weight as given.

    Families heavier than HEAVY of the total, at most 1 / HEAVY in number, go one by one, heaviest first, to the split
    that lacks most. The rest are laid end to end in the order of a hash of seed and id, and cut where the cumulative
    weight reaches what each split still lacks; the running sum is taken within hash ranges, so that no task gets all.
    Equal weights are ordered by id; weights of null families are ignored.
    """
    spark = weights.sparkSession
    w = weights.where(F.col("family").isNotNull() & (F.col("weight") > 0))
    total = w.agg(F.sum("weight")).first()[0] or 0
    heavy = w.where(F.col("weight") > HEAVY * total).orderBy(F.desc("weight"), "family").collect()
    lack = {s: q * total for s, q in shares}
    placed = []
    for r in heavy:
        s = max(lack, key=lambda x: lack[x])
        lack[s] -= r.weight
        placed.append((r.family, s))
    big = spark.createDataFrame(placed, T.StructType([T.StructField("family", weights.schema["family"].dataType), T.StructField("assigned", T.StringType())]))
    small = w.where(F.col("weight") <= HEAVY * total).withColumn("order", hash_fraction(F.lit(str(seed)), F.col("family"))).withColumn("range", F.floor(F.col("order") * RANGES).cast("int"))
    sums = small.groupBy("range").agg(F.sum("weight").alias("sum"))
    before = sums.select("range", (F.sum("sum").over(Window.orderBy("range")) - F.col("sum")).alias("before"))
    run = small.join(F.broadcast(before), "range")  # RANGES rows at most
    at = F.col("before") + F.sum("weight").over(Window.partitionBy("range").orderBy("order", "family")) - F.col("weight") / 2
    rest = sum(max(0.0, x) for x in lack.values()) or 1.0
    left = total - sum(r.weight for r in heavy)
    out, edge = None, 0.0
    for s, _ in shares[:-1]:
        edge += max(0.0, lack[s]) / rest * left
        out = F.when(at < edge, s) if out is None else out.when(at < edge, s)
    return big.unionByName(run.select("family", out.otherwise(shares[-1][0]).alias("assigned")))


def trial_families(manifest: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(group, split, rows) counted per clean group and split, and (group, family)."""
    counted = materialize(manifest.groupBy(clean_id(F.col("split_group_id")).alias("group"), clean_split(F.col("split")).alias("split")).agg(F.count(F.lit(1)).alias("n")).where(F.col("group").isNotNull()))
    return counted, materialize(families(counted.select("group").distinct(), links))


def torn(counted: DataFrame, family: DataFrame) -> DataFrame:
    """Families with two or more splits: (family_id, splits, n_groups, n_rows). Null splits don't count."""
    x = counted.join(family, "group").groupBy("family").agg(F.array_sort(F.collect_set("split")).alias("splits"), F.countDistinct("group").alias("n_groups"), F.sum("n").alias("n_rows"))
    return x.where(F.size("splits") > 1).select(F.col("family").alias("family_id"), F.array_join("splits", "+").alias("splits"), "n_groups", "n_rows")
