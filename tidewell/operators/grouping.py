"""Parsimony over sets: members are groups' evidence, as peptides are of proteins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def identical_sets(edges: DataFrame, owner: str, member: str) -> DataFrame:
    """(group_id, owners, members): owners of the same set of members are one group, named by its smallest owner."""
    sets = edges.groupBy(owner).agg(F.array_sort(F.collect_set(member)).alias("members"))
    return sets.groupBy("members").agg(F.min(owner).alias("group_id"), F.array_sort(F.collect_list(owner)).alias("owners")).select("group_id", "owners", "members")


def without_subsets(groups: DataFrame) -> DataFrame:
    """Groups whose members aren't all in another group.

    Only groups that share a group's rarest member can hold it whole, so groups meet by
    that member alone, not by all they share.
    """
    each = groups.select("group_id", F.size("members").alias("n"), F.explode("members").alias("member"))
    degree = each.groupBy("member").agg(F.count("*").alias("degree"))
    rarest = each.join(degree, "member").groupBy("group_id", "n").agg(F.min_by("member", F.struct("degree", "member")).alias("member"))
    larger = each.select(F.col("group_id").alias("other"), F.col("n").alias("other_n"), "member")
    candidates = rarest.join(larger, "member").filter("other_n > n").select("group_id", "other")
    mine = groups.select("group_id", F.col("members").alias("mine"))
    theirs = groups.select(F.col("group_id").alias("other"), F.col("members").alias("theirs"))
    held = candidates.join(mine, "group_id").join(theirs, "other").filter(F.size(F.array_except("mine", "theirs")) == 0)
    return groups.join(held.select("group_id").distinct(), "group_id", "left_anti")


def split_members(groups: DataFrame) -> DataFrame:
    """(group_id, n_unique, n_shared): members of this group only, and of others too."""
    each = groups.select("group_id", F.explode("members").alias("member"))
    owners = each.groupBy("member").agg(F.count("*").alias("owners"))
    return each.join(owners, "member").groupBy("group_id").agg(F.sum(F.when(F.col("owners") == 1, 1).otherwise(0)).cast("long").alias("n_unique"), F.sum(F.when(F.col("owners") > 1, 1).otherwise(0)).cast("long").alias("n_shared"))


def without_shared(groups: DataFrame) -> DataFrame:
    """(group_id, members): members that several groups have are left out of all; groups that have no others keep an empty list."""
    each = groups.select("group_id", F.explode("members").alias("member"))
    own = each.groupBy("member").agg(F.min("group_id").alias("group_id"), F.count("*").alias("owners")).filter("owners = 1")
    return _gathered(groups, own)


def razor(groups: DataFrame) -> DataFrame:
    """(group_id, members): every shared member goes to one group.

    In turns, of the groups that still share members, that with the most members of its
    own takes all it shares, the smallest id on a tie. A group that waits gains no member
    of its own, so the order of turns is known from the start: a member goes to the first
    of its owners in that order, and all turns are one aggregation.
    """
    each = groups.select("group_id", F.explode("members").alias("member"))
    owners = each.groupBy("member").agg(F.count("*").alias("owners"))
    own = each.join(owners, "member").groupBy("group_id").agg(F.count(F.when(F.col("owners") == 1, 1)).alias("own"))
    taken = each.join(own, "group_id").groupBy("member").agg(F.min_by("group_id", F.struct((-F.col("own")).alias("own"), "group_id")).alias("group_id"))
    return _gathered(groups, taken)


def _gathered(groups: DataFrame, owned: DataFrame) -> DataFrame:
    lists = owned.groupBy("group_id").agg(F.array_sort(F.collect_list("member")).alias("members"))
    none = F.array().cast(groups.schema["members"].dataType)
    return groups.select("group_id").join(lists, "group_id", "left").select("group_id", F.coalesce("members", none).alias("members"))
