"""Commits: ancestry, and the commits of a project."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import shared_folder


def _written(rows: DataFrame) -> DataFrame:
    """``rows`` cut off from what made them, by a checkpoint in the shared folder."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()


def _edges(commits: DataFrame) -> DataFrame:
    """(sha, at, parent): the parents of each commit in order; commits that are told twice count once."""
    return commits.select("sha", F.posexplode("parents").alias("at", "parent")).filter("parent <> ''").groupBy("sha", "parent").agg(F.min("at").alias("at"))


def chains(commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels (sha, chain, pos) of all commits, and the hops (chain, pos, to_chain, to_pos) between chains.

    A commit continues the chain of its first parent if of that one's children it has the smallest sha; ``pos``
    counts from the chain's oldest commit, after which the chain is named. Within a chain, what has a smaller pos is an
    ancestor; all other ways to a parent are hops. Positions are found by pointer doubling, in as many rounds as the
    longest chain's length has binary digits.
    """
    edges = _written(_edges(commits))
    nodes = commits.select("sha").unionByName(edges.select(F.col("parent").alias("sha"))).filter("sha IS NOT NULL").distinct()
    first = edges.groupBy("sha").agg(F.min_by("parent", "at").alias("parent"))
    link = first.groupBy("parent").agg(F.min("sha").alias("sha"))
    at = _written(nodes.join(link, "sha", "left").select("sha", F.coalesce("parent", "sha").alias("to"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("pos")))
    ended, moving = at.filter("pos = 0"), at.filter("pos > 0")
    while not moving.isEmpty():  # rows that point to the end of their chain are done, so no end is joined by all its chain
        then = ended.unionByName(moving).select(F.col("sha").alias("to"), F.col("to").alias("end"), F.col("pos").alias("more"))
        step = _written(moving.join(then, "to").select("sha", F.col("end").alias("to"), (F.col("pos") + F.col("more")).alias("pos"), (F.col("more") > 0).alias("moved")))
        ended, moving = ended.unionByName(step.filter("NOT moved").drop("moved")), step.filter("moved").drop("moved")
    labels = ended.select("sha", F.col("to").alias("chain"), "pos")
    of = lambda end, chain, pos: labels.select(F.col("sha").alias(end), F.col("chain").alias(chain), F.col("pos").alias(pos))
    both = edges.select("sha", "parent").join(of("sha", "chain", "pos"), "sha").join(of("parent", "to_chain", "to_pos"), "parent")
    return labels, _written(both.filter("chain <> to_chain").groupBy("chain", "pos", "to_chain").agg(F.max("to_pos").alias("to_pos")))


def _reached(hops: DataFrame, start: DataFrame, done: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """(tip, chain, upto): how far up each chain the ancestors of a tip go. ``done`` takes, from what is newly reached, the
    tips that need no more; there are as many rounds as a way has hops."""
    seen = fresh = _written(start)
    while True:
        step = fresh.join(hops, "chain").filter("pos <= upto").groupBy("tip", F.col("to_chain").alias("chain")).agg(F.max("to_pos").alias("upto"))
        known = seen.withColumnRenamed("upto", "before")
        fresh = _written(step.join(known, ["tip", "chain"], "left").filter("before IS NULL OR upto > before").select("tip", "chain", "upto"))
        if fresh.isEmpty():
            return seen
        seen = _written(seen.unionByName(fresh).groupBy("tip", "chain").agg(F.max("upto").alias("upto")))
        fresh = done(fresh, seen)


def ancestors(commits: DataFrame, tips: DataFrame) -> DataFrame:
    """(tip, sha): every commit reachable from each tip over ``parents``, the tip itself included. Histories may have any length."""
    labels, hops = chains(commits)
    start = tips.select(F.col("sha").alias("tip"), "sha").distinct().join(labels, "sha", "left").select("tip", F.coalesce("chain", "tip").alias("chain"), F.coalesce("pos", F.lit(0)).alias("upto"))
    seen = _reached(hops, start, lambda fresh, _: fresh)
    alone = seen.join(labels.select("chain"), "chain", "left_anti").select("tip", F.col("tip").alias("sha"))  # tips that no commit tells of
    return seen.join(labels, "chain").filter("pos <= upto").select("tip", "sha").unionByName(alone)


def is_ancestor(commits: DataFrame, pairs: DataFrame) -> DataFrame:
    """(ancestor, descendant, is_ancestor) of each pair; a commit is its own ancestor, unknown ones are none's.

    Two commits of one chain are told apart by their places. For other pairs chains are searched from the descendant on, until
    the ancestor is met; a search holds chains, never commits.
    """
    labels, hops = chains(commits)
    asked = pairs.select("ancestor", "descendant").distinct()
    named = lambda end, chain, pos: labels.select(F.col("sha").alias(end), F.col("chain").alias(chain), F.col("pos").alias(pos))
    told = commits.select(F.col("sha").alias("descendant")).distinct()
    placed = _written(asked.join(told, "descendant", "left_semi").join(named("ancestor", "a_chain", "a_pos"), "ancestor").join(named("descendant", "chain", "upto"), "descendant"))
    near = placed.filter("chain = a_chain AND a_pos <= upto").select("ancestor", "descendant")
    open_ones = placed.join(near, ["ancestor", "descendant"], "left_anti")
    goals = open_ones.select(F.col("descendant").alias("tip"), "ancestor", "a_chain", "a_pos")

    def met(seen: DataFrame) -> DataFrame:
        return goals.join(seen.withColumnRenamed("chain", "a_chain"), ["tip", "a_chain"]).filter("a_pos <= upto").select("tip", "ancestor")

    def still_open(fresh: DataFrame, seen: DataFrame) -> DataFrame:
        return fresh.join(goals.join(met(seen), ["tip", "ancestor"], "left_anti").select("tip"), "tip", "left_semi")

    seen = _reached(hops, open_ones.select(F.col("descendant").alias("tip"), "chain", "upto").distinct(), still_open)
    hit = near.unionByName(met(seen).select("ancestor", F.col("tip").alias("descendant"))).withColumn("hit", F.lit(True))
    return asked.join(hit, ["ancestor", "descendant"], "left").select("ancestor", "descendant", F.coalesce("hit", F.lit(False)).alias("is_ancestor"))


def project_commits(commits: DataFrame, repositories: DataFrame, project_id: str) -> DataFrame:
    """The commits of a project's repositories."""
    own = repositories.filter(F.col("project_id") == project_id).select("repository_id")
    return commits.join(own, "repository_id", "left_semi")
