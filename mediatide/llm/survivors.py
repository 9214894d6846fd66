"""The best representative of each group of duplicate records, as a row and field by field.

All of it is built-in expressions and windows. Ranking keeps the top record of a group with a ``row_number``
filter, which Spark turns into a limit inside each task before the shuffle, so that a group of any size sends one
record per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: what is written for a format, without case, blanks, a leading dot or ``audio/``
FORMAT_MEANING = {
    "mp3": "mp3", "mpeg": "mp3", "mpeg audio layer iii": "mp3", "mpeg audio": "mp3", "mpeg-1 layer 3": "mp3", "x-mp3": "mp3",
    "flac": "flac", "x-flac": "flac", "free lossless audio codec": "flac", "wav": "wav", "wave": "wav", "x-wav": "wav", "vnd.wave": "wav", "pcm": "wav",
    "ape": "ape", "x-ape": "ape", "monkey's audio": "ape", "monkeys audio": "ape", "alac": "alac", "apple lossless": "alac", "m4a/alac": "alac", "alac (m4a)": "alac",
    "dsf": "dsf", "x-dsf": "dsf", "dsd": "dsf", "dff": "dff", "x-dff": "dff", "aiff": "aiff", "aif": "aiff", "aifc": "aiff", "x-aiff": "aiff",
    "wavpack": "wavpack", "wv": "wavpack", "x-wavpack": "wavpack", "m4a": "m4a", "mp4": "m4a", "aac": "m4a", "x-m4a": "m4a", "aac (m4a)": "m4a", "m4a/aac": "m4a",
    "ogg": "ogg", "vorbis": "ogg", "ogg vorbis": "ogg", "opus": "opus", "wma": "wma", "x-ms-wma": "wma", "windows media audio": "wma",
}
# fixed values: kinds that score as lossless
LOSSLESS = ("flac", "wav", "ape", "alac", "dsf", "dff", "aiff", "wavpack")
# fixed values: shortened sample rates whose usual full rate is not a round thousand
SHORT_RATES = {11: 11025, 22: 22050, 37: 37800, 44: 44100, 88: 88200, 176: 176400, 352: 352800, 705: 705600, 2822: 2822400, 5644: 5644800, 5645: 5644800, 11289: 11289600, 11290: 11289600}
#: Bits and samples a second beyond which a stated number is impossible.
MOST_BITRATE, MOST_RATE = 50_000_000, 12_288_000


def _lookup(key: Column, table: dict) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def meant_format(column: Column) -> Column:
    """The kind of file meant; what is in no table stays as written, null stays null."""
    key = F.regexp_replace(F.lower(F.trim(column)), r"^(?:audio/|\.)", "")
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in FORMAT_MEANING.items() for x in kv)), key), key)


def meant_bitrate(column: Column) -> Column:
    """Bits a second; null for a missing or impossible number."""
    full = F.when(column < 10_000, column.cast("long") * 1000).otherwise(column.cast("long"))
    return F.when((column > 0) & (full <= MOST_BITRATE), full)


def meant_rate(column: Column) -> Column:
    """Samples a second; null for a missing or impossible number."""
    n = column.cast("long")
    short = F.create_map(*(F.lit(x) for kv in SHORT_RATES.items() for x in kv))
    full = F.when(n < 1000, F.coalesce(F.try_element_at(short, n.cast("int")), n * 1000)).otherwise(F.coalesce(F.try_element_at(short, n.cast("int")), n))
    return F.when((n > 0) & (full <= MOST_RATE), full)


def with_meaning(songs: DataFrame) -> DataFrame:
    """``songs`` with the stated values read by their meaning and scored: kind, bits, rate, points."""
    filled = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    read = songs.withColumns({"_kind": meant_format(F.col("format")), "_bits": meant_bitrate(F.col("bitrate")), "_rate": meant_rate(F.col("sample_rate"))})
    points = (
        F.when(F.coalesce(F.col("_kind").isin(*LOSSLESS), F.lit(False)), 1_000_000).otherwise(0)
        + F.coalesce("_bits", F.lit(0))
        + (F.coalesce("_rate", F.lit(0)) * F.lit(0.1)).cast("long")
        + F.when(filled("title"), 500).otherwise(0)
        + F.when(filled("artist"), 500).otherwise(0)
        + F.when(filled("album"), 200).otherwise(0)
    )
    # a record without a group is a group of its own
    group = F.coalesce(F.concat(F.lit("g:"), F.col("group_id")), F.concat(F.lit("r:"), F.col("dup_id").cast("string")), F.lit("r:"))
    return read.withColumns({"_points": points, "_group": group})


def _ranking() -> list[Column]:
    return [F.desc("_points"), F.desc_nulls_last("checked_at"), F.asc_nulls_last("dup_id"), F.asc_nulls_last("file_path")]


def best_rows(songs: DataFrame) -> DataFrame:
    """The whole row of each group that ranks first.

    Order: points, then latest ``checked_at``, then lowest ``dup_id``, then ``file_path``. Rows whose group_id is
    null are kept, each as a group of its own. An empty table gives no row; repeated rows give one.
    """
    w = Window.partitionBy("_group").orderBy(*_ranking())
    return with_meaning(songs).withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def found(songs: DataFrame) -> DataFrame:
    """``(group_id, dup_id)`` of the surviving row of each group."""
    return best_rows(songs.select("dup_id", "group_id", "file_path", "format", "bitrate", "sample_rate", "title", "artist", "album", "checked_at")).select("group_id", "dup_id")


def build_survivors(songs: DataFrame) -> DataFrame:
    """One record per group, every field taken from the best ranked row that states it.

    The rank is one comparable struct, so each field is a ``min_by`` that is combined in the tasks before the
    shuffle. ``n_copies`` counts the rows and ``from_rows`` the rows that gave at least one field.
    """
    rank = F.struct(-F.col("_points"), -F.coalesce(F.unix_micros(F.col("checked_at").cast("timestamp")), F.lit(-(2**62))), F.coalesce("dup_id", F.lit(2**62)), F.coalesce("file_path", F.lit("")))
    stated = {
        "file_path": F.col("file_path"), "format": F.nullif("_kind", F.lit("")), "bitrate": F.col("_bits"), "sample_rate": F.col("_rate"),
        "channels": F.when(F.col("channels") > 0, F.col("channels")), "duration": F.when(F.col("duration") > 0, F.col("duration")),
        "title": F.nullif("title", F.lit("")), "artist": F.when(F.col("artist") != "未知歌手", F.nullif("artist", F.lit(""))), "album": F.nullif("album", F.lit("")),
        "file_size": F.when(F.col("file_size") > 0, F.col("file_size")),
    }
    ranked = with_meaning(songs).withColumn("_by", rank)
    picks = [F.min(F.when(v.isNotNull(), F.struct(F.col("_by"), F.col("dup_id").alias("row"), v.alias("v")))).alias(f"_p_{c}") for c, v in stated.items()]
    merged = ranked.groupBy("_group").agg(
        F.min("group_id").alias("group_id"), F.min_by("dup_id", "_by").alias("dup_id"), F.max("_points").alias("score"), F.count(F.lit(1)).alias("n_copies"), *picks
    )
    givers = F.size(F.array_distinct(F.filter(F.array(*(F.col(f"_p_{c}.row") for c in stated)), lambda x: x.isNotNull())))
    return merged.select("group_id", "dup_id", *(F.col(f"_p_{c}.v").alias(c) for c in stated), "score", "n_copies", givers.alias("from_rows"))
