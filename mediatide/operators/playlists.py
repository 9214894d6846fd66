"""Song lists: parsing, shaping, histories, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_song_name, song_text

SONGS_SCHEMA = "array<struct<index:int,song_name:string,artist:string,full_text:string>>"
CHUNK, PAGE, MOST_SONGS = 400, 30, 10_000


def parse_songs(json: Column) -> Column:
    """The songs of a history's JSON; bad or missing JSON is an empty list."""
    return F.coalesce(F.from_json(json, SONGS_SCHEMA), F.from_json(F.lit("[]"), SONGS_SCHEMA))


def history_detail(history: DataFrame) -> DataFrame:
    """Each history with its songs as a list of texts and one text."""
    h = history.withColumn("songs", parse_songs(F.col("songs_json")))
    texts = F.transform("songs", lambda s: F.coalesce(s["full_text"], F.lit("")))
    return h.select("id", "platform", "title", F.coalesce("cover_url", F.lit("")).alias("cover_url"), F.size("songs").alias("parsed_count"), texts.alias("text_list"), F.array_join(texts, "\n").alias("raw_text"), "songs")


def history_recent(history: DataFrame, n: int = 30) -> DataFrame:
    """The latest histories without their songs; ``n`` of 0 or less reads as 50."""
    cols = ["id", "platform", "source_url", "title", F.coalesce("cover_url", F.lit("")).alias("cover_url"), "song_count", "created_at"]
    return history.select(*cols).orderBy(F.desc("created_at"), F.desc("id")).limit(n if n > 0 else 50)


def shaped(songs: DataFrame, style: str = "song-singer", detailed: bool = True) -> DataFrame:
    """Songs with the line that shows them; without ``detailed`` bracketed additions are removed from names."""
    name = F.coalesce("song_name", F.lit(""))
    name = name if detailed else clean_song_name(name)
    return songs.withColumn("line", song_text(name, F.coalesce("artist", F.lit("")), style))


def reversed_songs(songs: DataFrame, by: str, index: str) -> DataFrame:
    """Each list in reverse, numbered again from 1."""
    w = Window.partitionBy(by).orderBy(F.desc(index), F.desc("song_id"))
    return songs.withColumn("new_index", F.row_number().over(w).cast("bigint"))


def export_lines(songs: DataFrame, by: str, index: str, style: str = "song-singer") -> DataFrame:
    """``(by, no, line)``: the rows of a list's export, numbered from 1 in order."""
    w = Window.partitionBy(by).orderBy(index, "song_id")
    return shaped(songs, style).select(by, F.row_number().over(w).cast("bigint").alias("no"), "line")


def export_text(songs: DataFrame, by: str, index: str, style: str = "song-singer") -> DataFrame:
    """One text per list, a song a line."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(index), F.col("song_id"), F.col("line"))))
    return shaped(songs, style).groupBy(by).agg(F.array_join(F.transform(lines, lambda s: s["line"]), "\n").alias("raw_text"), F.count("*").alias("n_songs"))


def in_order(ids: DataFrame, details: DataFrame, by: str, at: str, key: str) -> DataFrame:
    """Details in the order of the id list; what has none is left out and its index stays free."""
    return ids.join(details, key).withColumn("index", (F.col(at) + 1).cast("bigint"))


def pages(total: Column) -> Column:
    """First index and size of each page of a list of ``total`` songs, 10,000 at most."""
    n = F.least(total, F.lit(MOST_SONGS))
    count = F.ceil(n / F.lit(PAGE)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda p: F.struct(p.alias("page"), (p * PAGE).alias("first"), F.least(F.lit(PAGE), n - p * PAGE).alias("size"))))


def page_of(df: DataFrame, page: int, size: int, order: list, default: int = 50) -> DataFrame:
    """One page in order; a page below 1 is the first, a size below 1 the default."""
    size = size if size > 0 else default
    return df.orderBy(*order).offset((max(page, 1) - 1) * size).limit(size)


def first_number(json: Column, keys: list[str]) -> Column:
    """The first of the keys that holds a JSON number; a number in quotes doesn't count; 0 without any."""
    raw = [F.get_json_object(json, f"$.{k}") for k in keys]
    # an object read as strings loses the quotes: the text itself shows which values had them
    quoted = [F.coalesce(json.rlike(rf'"{k}"\s*:\s*"'), F.lit(False)) for k in keys]
    return F.coalesce(*(F.when(~q, r.try_cast("bigint")) for r, q in zip(raw, quoted, strict=True)), F.lit(0).cast("bigint"))


def album_name(json: Column) -> Column:
    """The album of a field that is a string or an object: its name, else its title, else empty."""
    text = F.when(F.trim(json).startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), json, F.lit("}")), "$.v"))
    got = lambda k: F.nullif(F.get_json_object(json, f"$.{k}"), F.lit(""))
    return F.coalesce(text, got("name"), got("title"), F.lit(""))
