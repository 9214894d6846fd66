"""Wanted songs found in a library: staged search, scoring, the best candidate.

A search is a case-insensitive substring of the title. It is an equality join, not a nested loop: a title is
indexed by its distinct 3-grams, and a query looks up the one of its own 3-grams that the fewest titles have; the
substring is checked on what that finds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.likeness import ENOUGH, GOOD, artist_form, artist_likeness, names_form, quality_bonus, title_form, title_likeness, total_score
from ..functions.text import clean_title, lower, primary_artist, strip
from ..session import cut, shuffled
from .ordering import ranked

GRAM = 3
# fixed values: hits taken from each stage's search
TOP = {1: 20, 2: 20, 3: 20, 4: 30}
NOT_FOUND, TOO_FAR = "本地曲库未找到匹配歌曲", "曲库候选歌曲相似度低于匹配阈值"


def _grams(text, size: int):
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - (size - 1))), lambda i: F.substring(text, i, size)))


@dataclass
class TitleIndex:
    """Lower-cased titles (``guid``, ``low``) and their distinct 3-grams (``gram``, ``guid``, ``low``)."""

    titles: DataFrame
    grams: DataFrame


def title_index(tracks: DataFrame) -> TitleIndex:
    """The index of the tracks' titles, written once; empty guids are left out."""
    low = cut(tracks.where(F.col("guid").isNotNull() & (F.col("guid") != "")).select("guid", lower(F.coalesce("title", F.lit(""))).alias("low")))
    return TitleIndex(low, cut(low.where(F.length("low") >= GRAM).select("guid", "low", F.explode(_grams(F.col("low"), GRAM)).alias("gram"))))


def search(queries: DataFrame, index: TitleIndex, top: dict[int, int] = TOP) -> DataFrame:
    """``(song_key, stage, pos, guid)``: the first titles (by guid) that contain each query, as many as its stage takes.

    ``queries`` has song_key, stage and query; empty queries find nothing. Each distinct query is searched once, for
    whatever songs and stages. Queries of one or two characters look for themselves among the titles' grams of that
    length; no more than are wanted of a query leave a task.
    """
    asked = queries.withColumn("query", lower(F.col("query"))).where(F.col("query") != "")
    q = asked.select("query").distinct()
    wanted = q.where(F.length("query") >= GRAM).select("query", F.explode(_grams(F.col("query"), GRAM)).alias("gram"))
    counts = index.grams.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = wanted.join(shuffled(counts), "gram", "left").groupBy("query").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("r")).select("query", F.col("r.gram").alias("gram"))
    hits = rarest.join(shuffled(index.grams), "gram").where(F.col("low").contains(F.col("query"))).select("query", "guid")
    short = q.where(F.length("query") < GRAM).select("query", F.col("query").alias("gram"))
    some = index.titles.select("guid", F.explode(F.array_distinct(F.concat(_grams(F.col("low"), 1), _grams(F.col("low"), 2)))).alias("gram"))
    hits = hits.unionByName(some.join(shuffled(short), "gram").select("query", "guid"))
    w = Window.partitionBy("query").orderBy("guid")
    best = hits.withColumn("pos", F.row_number().over(w).cast("bigint")).where(F.col("pos") <= max(top.values()))
    most = F.element_at(F.create_map(*(F.lit(x) for item in top.items() for x in item)), F.col("stage"))
    return asked.join(shuffled(best), "query").where(F.col("pos") <= most).select("song_key", "stage", "pos", "guid")


def _scored(found: DataFrame, songs: DataFrame, tracks: DataFrame) -> DataFrame:
    """Finds with their scores; the forms that are compared were made once per song and per track."""
    score = total_score(title_likeness(F.col("song_form"), F.col("title_form")), artist_likeness(F.col("artist_form"), F.col("names_form")), F.col("bonus"))
    wanted, there = songs.select("song_key", "song_form", "artist_form"), tracks.select("guid", "title_form", "names_form", "bonus")
    return found.join(shuffled(wanted), "song_key").join(shuffled(there), "guid").select("song_key", "stage", "pos", "guid", score.alias("score"))


def _needed(found: DataFrame) -> DataFrame:
    """The finds of stages that can count: the second next to fewer than five of the first, the last two if there is nothing before."""
    w = Window.partitionBy("song_key")
    n = [F.count_if(F.col("stage") == k).over(w) for k in TOP]
    counted = found.withColumns({f"n{k}": c for k, c in zip(TOP, n, strict=True)})
    out = counted.where((F.col("stage") == 1) | ((F.col("stage") == 2) & (F.col("n1") < 5)) | ((F.col("stage") == 3) & (F.col("n1") + F.col("n2") == 0)) | ((F.col("stage") == 4) & (F.col("n1") + F.col("n2") + F.col("n3") == 0)))
    return out.select(*found.columns)


def match_songs(songs: DataFrame, tracks: DataFrame) -> DataFrame:
    """One row per song: whether it was found, the track, its score, or why not.

    ``songs`` has song_key (unique), song_name, artist; ``tracks`` has guid (unique), title, names, format, bitrate.
    Stages: the cleaned title; the raw title, if it differs and fewer than five were found; title and artist, then
    the artist alone, if nothing was found. A stage's songs that are settled (score of 0.85 or more) leave. Equal
    scores go to the earlier find; a score of 0 never wins. Null names read as empty.
    """
    wishes = songs.select("song_key", F.coalesce("song_name", F.lit("")).alias("song_name"), F.coalesce("artist", F.lit("")).alias("artist"))
    # what is asked for again and again is looked for once, under the lowest of its keys
    songs = wishes.groupBy("song_name", "artist").agg(F.min("song_key").alias("song_key"))
    songs = cut(songs.withColumns({"clean": clean_title(F.col("song_name")), "first": primary_artist(F.col("artist")), "song_form": title_form(F.col("song_name")), "artist_form": artist_form(F.col("artist"))}))
    tracks = tracks.select("guid", F.coalesce("title", F.lit("")).alias("title"), F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda n: F.coalesce(n, F.lit(""))).alias("names"), "format", "bitrate")
    tracks = cut(tracks.select("guid", "title", title_form(F.col("title")).alias("title_form"), names_form(F.col("names")).alias("names_form"), quality_bonus(F.col("format"), F.col("bitrate")).alias("bonus")))
    # the queries of all stages are searched in one pass; which stages count is decided on what they found
    joined = strip(F.concat_ws(" ", "clean", "first"))
    has = F.col("first") != ""
    asked = songs.select("song_key", F.explode(F.array(
        F.struct(F.lit(1).alias("stage"), F.col("clean").alias("query")), F.struct(F.lit(2).alias("stage"), F.when(F.col("song_name") != F.col("clean"), F.col("song_name")).otherwise("").alias("query")),
        F.struct(F.lit(3).alias("stage"), F.when(has, joined).otherwise("").alias("query")), F.struct(F.lit(4).alias("stage"), F.col("first").alias("query")),
    )).alias("q")).select("song_key", "q.stage", "q.query")
    found = _scored(_needed(search(asked, title_index(tracks))), songs, tracks)
    finds = []
    for k in TOP:
        of = F.col("stage") == k
        finds += [F.count_if(of).alias(f"n{k}"), F.min(F.when(of, F.struct((-F.col("score")).alias("less"), "stage", "pos", "guid"))).alias(f"b{k}")]
    found = found.groupBy("song_key").agg(*finds)
    # the raw title is only asked for where the cleaned one found little and nothing good
    second = (F.col("n1") < 5) & (F.coalesce(-F.col("b1.less"), F.lit(0.0)) < GOOD)
    best = F.when(F.col("n1") > 0, F.least("b1", F.when(second, F.col("b2")))).when(F.col("n2") > 0, F.col("b2")).when(F.col("n3") > 0, F.col("b3")).otherwise(F.col("b4"))
    decided = songs.select("song_key", "song_name", "artist").join(shuffled(found.select("song_key", best.alias("b"))), "song_key", "left")
    out = wishes.join(shuffled(decided.drop("song_key")), ["song_name", "artist"])
    score = F.coalesce(-F.col("b.less"), F.lit(0.0))
    matched = (score >= ENOUGH) & F.col("b.guid").isNotNull()
    return out.select(
        "song_key", "song_name", "artist", matched.alias("matched"), F.when(matched, F.col("b.guid")).otherwise("").alias("track_guid"), score.alias("score"),
        F.when(F.col("b").isNull(), NOT_FOUND).when(~matched, TOO_FAR).otherwise("").alias("error"),
    )


def import_report(matches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Songs, matches and misses, in all or per key."""
    counts = [F.count("*").alias("total"), F.count_if("matched").alias("matched"), F.count_if(~F.col("matched")).alias("unmatched")]
    return matches.groupBy(*by).agg(*counts) if by else matches.agg(*counts)


def matched_lists(matches: DataFrame, by: str, order: str, per_page: int = 1_000) -> DataFrame:
    """``(by, page, guids)``: the tracks found for each list, in the order of its songs, so many a page."""
    hits = ranked(matches.where(F.col("matched")), [by], [F.asc(order)], "_n").withColumn("page", F.floor((F.col("_n") - 1) / per_page).cast("bigint"))
    inside = F.array_sort(F.collect_list(F.struct("_n", "track_guid")))
    return hits.groupBy(by, "page").agg(inside.alias("_g")).select(by, "page", F.array_join(F.transform("_g", lambda g: g["track_guid"]), ",").alias("guids"))


def unmatched_lines(matches: DataFrame, by: str, order: str) -> DataFrame:
    """``(by, no, line)``: what was not found in each list, numbered from 1, as ``1. song - artist``."""
    missing = ranked(matches.where(~F.col("matched")), [by], [F.asc(order)], "no")
    return missing.select(by, "no", F.concat(F.col("no").cast("string"), F.lit(". "), F.col("song_name"), F.lit(" - "), F.col("artist")).alias("line"))
