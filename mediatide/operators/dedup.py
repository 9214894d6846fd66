"""Copies of the same recording: clusters by fingerprint and duration, the copy to keep, what a clean-up does.

A cluster is decided on the distinct durations of a fingerprint, not on its rows: rows are counted per fingerprint
and duration before anything is shuffled, so a fingerprint that holds a third of all rows is as small as any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.media import song_score
from ..session import cut
from .ordering import join_counted, numbered, ranked

TOLERANCE = 30.0


def valid_fingerprints(prints: DataFrame) -> DataFrame:
    """Rows that were fingerprinted: not failed, fingerprint neither null nor empty."""
    return prints.where((F.coalesce("is_failed", F.lit(0)) == 0) & F.col("fingerprint").isNotNull() & (F.col("fingerprint") != ""))


def cluster_ids(valid: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """``(fingerprint, duration, cid)``: durations chain while neighbours are no more than ``tolerance`` apart.

    A duration of 0 (or null) is unknown and never starts a new cluster.
    """
    points = valid.select("fingerprint", F.coalesce("duration", F.lit(0.0)).alias("duration")).distinct()
    return _with_cluster(points, Window.partitionBy("fingerprint").orderBy("duration"), tolerance)


def _with_cluster(points: DataFrame, w, tolerance: float) -> DataFrame:
    before = F.lag("duration").over(w)
    split = F.when((before > 0) & (F.col("duration") > 0) & (F.col("duration") - before > tolerance), 1).otherwise(0)
    return points.withColumn("_split", split).withColumn("cid", F.sum("_split").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint")).drop("_split")


def clustered(prints: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """``(fingerprint, duration, file_path, file_size, score, cid, song_count)`` of the valid rows whose cluster has two rows or more.

    The narrow rows that three steps read are written once.
    """
    score = song_score(*(F.col(c) for c in ("format", "bitrate", "sample_rate", "title", "artist", "album")))
    valid = cut(valid_fingerprints(prints).select("fingerprint", F.coalesce("duration", F.lit(0.0)).alias("duration"), "file_path", "file_size", score.alias("score")))
    counts = valid.groupBy("fingerprint", "duration").agg(F.count("*").alias("n"))
    w = Window.partitionBy("fingerprint").orderBy("duration")
    ids = _with_cluster(counts, w, tolerance)
    several = cut(ids.withColumn("song_count", F.sum("n").over(Window.partitionBy("fingerprint", "cid"))).where("song_count >= 2"))
    return join_counted(valid, several, ["fingerprint", "duration"], "n", valid.count()).drop("n")


def _best():
    """Highest score first, then the lower path: one comparable value."""
    return F.struct(-F.col("score"), F.col("file_path"))


def groups(prints: DataFrame, tolerance: float = TOLERANCE, number: bool = True) -> DataFrame:
    """One row per cluster: its size, bytes, the copy to keep and the bytes of all others, most wasteful first.

    Group numbers follow fingerprint and cluster, not the final order.
    """
    size = F.coalesce("file_size", F.lit(0))
    g = clustered(prints, tolerance).groupBy("fingerprint", "cid").agg(
        F.count("*").alias("song_count"), F.sum(size).alias("total_size"), F.min_by("file_path", _best()).alias("keep_path"), F.min_by(size, _best()).alias("keep_size"), F.max("score").alias("best_score")
    )
    g = g.withColumn("wasted_size", F.col("total_size") - F.col("keep_size"))
    if number:
        g = numbered(g, [F.asc("fingerprint"), F.asc("cid")], "group_no").withColumn("group_id", F.concat(F.lit("dup_grp_"), F.col("group_no").cast("string")))
        return g.orderBy(F.desc("wasted_size"), "group_no")
    return g.orderBy(F.desc("wasted_size"), "fingerprint", "cid")


def members(prints: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Every member with its rank in the cluster; rank 1 is the copy to keep.

    Highest score first, then the lower path; no task holds a whole cluster, whatever its scores. Rows of equal path
    count each.
    """
    m = ranked(clustered(prints, tolerance), ["fingerprint", "cid"], [F.desc("score"), F.asc("file_path")], "rank")
    return m.withColumn("is_recommended_keep", F.col("rank") == 1)


def group_songs(prints: DataFrame, tolerance: float = TOLERANCE, per_page: int = 1_000) -> DataFrame:
    """``(fingerprint, cid, page, songs)``: the songs of each group as an array, best first, so many a page.

    A group of any size comes out whole, on as many pages as it takes.
    """
    m = members(prints, tolerance).withColumn("page", F.floor((F.col("rank") - 1) / per_page).cast("bigint"))
    song = F.struct("rank", "file_path", "file_size", "duration", "score", "is_recommended_keep")
    return m.groupBy("fingerprint", "cid", "page").agg(F.array_sort(F.collect_list(song)).alias("songs"))


def summary(groups_: DataFrame) -> DataFrame:
    """One row over all groups."""
    return groups_.agg(F.count("*").alias("group_count"), F.coalesce(F.sum("song_count"), F.lit(0)).alias("total_duplicate_songs"), F.coalesce(F.sum("wasted_size"), F.lit(0)).alias("total_wasted_size"))


def clean_plan(members_: DataFrame, action: str = "recycle") -> DataFrame:
    """What cleaning the recommended copies away does: one row per copy that is not kept."""
    known = action in ("recycle", "delete")
    target = F.concat(F.lit("/output/_recycle_bin"), F.col("file_path")) if action == "recycle" else F.col("file_path")
    return members_.where(~F.col("is_recommended_keep")).select(
        "file_path", F.lit(action).alias("action"), F.lit(known).alias("success"), (target if known else F.lit("")).alias("target"), F.lit("" if known else "未知操作").alias("message")
    )


def survivors(prints: DataFrame, removed: DataFrame) -> DataFrame:
    """Valid rows whose path is not among the removed ones."""
    return valid_fingerprints(prints).join(removed.select("file_path").distinct(), "file_path", "left_anti")
