"""Candidate pairs from the buckets of bands, linear in the rows of the buckets.

Every row of a bucket is tied to the bucket's leader. Besides the ties, the pairs of a bucket's other members across
components are open, also one between a member that passed against the leader and one that failed (members of one
component need no further link). Small buckets give out their open pairs themselves. Larger ones are split: all rows that
agree on two bands form a finer bucket, for every two bands, and finer buckets are resolved in the same way. Two similar
texts agree on several bands, so they meet in several finer buckets; dissimilar ones are mostly dealt apart. For the members
of large buckets that hold several components even then there is an exact rest: a prefix filter over what their texts are
made of gives every pair that can reach the threshold. So of the pairs that share a bucket, none over it is lost.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseworks.llm.common import materialize

#: Numbers of 64 parities each that an id of the exact rest has.
PARITIES = 16
#: Members (besides the leader) of a bucket that gives out its open pairs itself.
SMALL = 12


def _leader(what: Column) -> Column:
    """The least of a bucket in half of the buckets, the greatest in the others, so that a row has leaders of both kinds.
    The window can spill."""
    bucket = Window.partitionBy("band")
    return F.when(F.col("band") % 2 == 0, F.min(what).over(bucket)).otherwise(F.max(what).over(bucket))


def ties(rows: DataFrame, ends: bool = True) -> DataFrame:
    """(band, id, leader): every row (band, id) of a bucket but its leader, with the leader (ends False: always the
    least id)."""
    leader = _leader(F.col("id")) if ends else F.min("id").over(Window.partitionBy("band"))
    return rows.withColumn("leader", leader).where("id <> leader")


def labelled(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """rows (band, id) with c, the component of id: itself if parts (node, component) hasn't got it."""
    return rows.join(parts.select(F.col("node").alias("id"), F.col("component").alias("c")), "id", "left").select("band", "id", F.coalesce("c", "id").alias("c"))


def _across(rows: DataFrame) -> DataFrame:
    """Rows (band, id, c) of the buckets that hold two components or more, with their number n."""
    several = rows.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("band", "n")
    return rows.join(several, "band")


def _small_pairs(rows: DataFrame) -> DataFrame:
    """(member, leader): the open pairs of small buckets; SMALL bounds them by a few for each row."""
    few = rows.where(F.col("n") <= SMALL)
    a, b = few.select("band", F.col("id").alias("leader"), F.col("c").alias("ca")), few.select("band", F.col("id").alias("member"), F.col("c").alias("cb"))
    return a.join(b, "band").where("leader < member AND ca <> cb").select("member", "leader").distinct()


def _finer(rows: DataFrame) -> DataFrame:
    """(band, id, c) for every two of the large open buckets that a row is in."""
    large = rows.where(F.col("n") > SMALL)
    of = large.groupBy("id", "c").agg(F.sort_array(F.collect_set("band")).alias("bands"))  # as many as there are bands at most
    first = of.select("id", "c", "bands", F.posexplode("bands").alias("at", "one"))
    return first.select("id", "c", "one", F.explode(F.slice("bands", F.col("at") + 2, F.size("bands"))).alias("other")).select(F.xxhash64("one", "other").alias("band"), "id", "c")


def best_ties(tied: DataFrame) -> DataFrame:
    """(member, leader): of the leaders of each id, the one that it shares most buckets with."""
    shared = tied.groupBy("id", "leader").agg(F.count("*").alias("n"))
    return shared.groupBy("id").agg(F.max(F.struct("n", "leader")).alias("best")).select(F.col("id").alias("member"), "best.leader")


def _ties_across(tied: DataFrame, parts: DataFrame) -> DataFrame:
    """(member, leader): the ties between two components."""
    of = lambda end: parts.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    both = tied.select("id", "leader").distinct().join(of("id"), "id", "left").join(of("leader"), "leader", "left")
    return both.where(F.coalesce("of_id", "id") != F.coalesce("of_leader", "leader")).select(F.col("id").alias("member"), "leader")


def _prefix_pairs(parts: DataFrame, made_of: DataFrame, threshold: float) -> DataFrame:
    """(member, leader): pairs of ids of two components (id, c) whose weighted Jaccard similarity may reach the threshold.
    made_of: (id, token, weight).

    Tokens of an id stand in one order for all, rarest first. What a pair has in common lies from the first common token on in
    both, so this token is one from which on each holds threshold / (1 + threshold) of both weights. What only one of a pair
    has weighs (1 - threshold) / (1 + threshold) of both at most, and there are as many such tokens as the parities of the
    two ids differ in, or more: so members of a crowd that are alike but not over the threshold end inside the join.
    """
    made_of = materialize(made_of, "made-of")
    rare = made_of.groupBy("token").agg(F.count("*").alias("f"))
    order = Window.partitionBy("id").orderBy(F.desc("f"), F.desc("token"))
    upto = made_of.join(rare, "token").withColumns({"left": F.sum("weight").over(order), "all": F.sum("weight").over(Window.partitionBy("id"))})
    slack = 1 - 1e-4  # weights may be rounded
    first = upto.where((F.col("f") > 1) & (F.col("left") >= F.col("all") * threshold * slack)).select("id", "token", "left", "all")
    first = first.join(parts, "id").join(_parities(made_of), "id")
    a, b = (first.select("token", *[F.col(x).alias(f"{x}_{end}") for x in first.columns if x != "token"]) for end in "ab")
    both = F.col("all_a") + F.col("all_b")
    near = F.least("left_a", "left_b") >= both * (threshold / (1 + threshold) * slack)
    apart = reduce(add, [F.bit_count(F.col(f"p{k}_a").bitwiseXOR(F.col(f"p{k}_b"))) for k in range(PARITIES)])
    near &= apart * F.least("least_a", "least_b") <= both * (1 - 2 * threshold / (1 + threshold) * slack)
    return a.join(b, "token").where((F.col("id_a") < F.col("id_b")) & (F.col("c_a") != F.col("c_b")) & near).select(F.col("id_b").alias("member"), F.col("id_a").alias("leader")).distinct()


def _parities(made_of: DataFrame) -> DataFrame:
    """(id, least, p0, p1, ...): the least weight of an id's tokens, and for each of 64 * PARITIES hashes whether an odd number
    of its tokens has it."""
    h = F.xxhash64("token", F.lit(11))
    bit = F.expr("shiftleft(1L, h & 63)")
    rows = made_of.select("id", "weight", h.alias("h")).select("id", "weight", bit.alias("bit"), F.pmod(F.shiftright("h", 6), F.lit(PARITIES)).alias("k"))
    return rows.groupBy("id").agg(F.min("weight").alias("least"), *[F.bit_xor(F.when(F.col("k") == k, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"p{k}") for k in range(PARITIES)])


def resolve(tied: DataFrame, check: Callable[[DataFrame], None], parts: Callable[[], DataFrame], made_of: Callable[[DataFrame], DataFrame], threshold: float, unchecked: bool = False) -> None:
    """Check the open pairs of the buckets of tied (band, id, leader). check takes (member, leader) rows, skips those it
    has seen and adds what passes to the links; parts gives the components of the links so far; made_of gives (id, token,
    weight) of ids, whose weighted Jaccard similarity is what check measures. unchecked: some ties of tied haven't been
    checked; those between two components are."""
    first = parts()
    rows = materialize(_across(labelled(tied.select("band", "id"), first)), "open")
    if rows.isEmpty():
        if unchecked:
            check(_ties_across(tied, first))
        return
    finer = materialize(_finer(rows), "finer")
    lead = finer.withColumn("leader", _leader(F.struct("id", "c"))).where("c <> leader.c")
    lead = lead.select(F.greatest("id", "leader.id").alias("member"), F.least("id", "leader.id").alias("leader"))
    pairs = _small_pairs(rows).unionByName(lead)
    check((pairs.unionByName(_ties_across(tied, first)) if unchecked else pairs).distinct())
    if not finer.isEmpty():
        check(_small_pairs(_across(labelled(finer.select("band", "id"), parts()))))
    rest = materialize(_across(labelled(rows.select("band", "id"), parts())).where(F.col("n") > SMALL).select("id", "c").distinct(), "rest")
    if not rest.isEmpty():
        check(_prefix_pairs(rest, made_of(rest.select("id")), threshold))
