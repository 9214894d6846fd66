"""Queries of the operators in this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, table
from .survivors import FORMAT_MEANING, LOSSLESS, MOST_BITRATE, MOST_RATE, SHORT_RATES

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plainform import not_plain

    songs = spread(table(spark, sf_dir, "songs").select("song_id", "song_name"))
    tracks = spread(table(spark, sf_dir, "tracks").select("guid", "title"))
    return not_plain(songs, "songs", "song_id", "song_name").unionByName(not_plain(tracks, "tracks", "guid", "title"))


def p1_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plainform import consistent_texts

    songs = consistent_texts(spread(table(spark, sf_dir, "songs").select("song_id", "song_name")), "songs", "song_id", "song_name")
    return songs.unionByName(consistent_texts(spread(table(spark, sf_dir, "tracks").select("guid", "title")), "tracks", "guid", "title"))


def p2_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.multivalue import Grammar
    from .spellings import canonical_names, distinct_names, entities

    names = canonical_names(table(spark, sf_dir, "catalog_artists"), "name")
    typed = distinct_names([(table(spark, sf_dir, "songs"), "library_id", "artist"), (table(spark, sf_dir, "audio_fingerprints"), "library_id", "artist")])
    return entities(typed, Grammar.of(names), names).withColumnRenamed("scope", "library_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spellings import linked_pairs

    return linked_pairs(p2_entities(spark, sf_dir).withColumnRenamed("library_id", "scope"), "library_id")


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mojibake import damaged_fields, fit

    songs = table(spark, sf_dir, "catalog_songs")
    model = fit(spark, [(songs, "title"), (songs, "album"), (table(spark, sf_dir, "catalog_artists"), "name")])
    prints = spread(table(spark, sf_dir, "audio_fingerprints").select("rec_id", "title", "album"))
    probes = spread(table(spark, sf_dir, "audio_metadata").select("meta_id", "artist"))
    return damaged_fields(prints, "audio_fingerprints", "rec_id", ["title", "album"], model).unionByName(
        damaged_fields(probes, "audio_metadata", "meta_id", ["artist"], model)
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_restored(spark, sf_dir).select("src", "row_id", "field")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .catalogmatch import match_titles

    songs = table(spark, sf_dir, "songs").select(F.lit("songs").alias("src"), F.col("song_id").cast("string").alias("row_key"), F.col("song_name").alias("title"), "artist")
    tracks = table(spark, sf_dir, "tracks").select(F.lit("tracks").alias("src"), F.col("guid").alias("row_key"), "title", F.col("artists").getItem(0)["name"].alias("artist"))
    return match_titles(spark, songs.unionByName(tracks), table(spark, sf_dir, "catalog_songs").select("catalog_id", "title", "artist"))


def p5_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_found(spark, sf_dir).where("catalog_id = 0").select("src", "row_key")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .survivors import found

    return found(table(spark, sf_dir, "duplicate_songs"))


def p6_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .survivors import build_survivors

    return build_survivors(table(spark, sf_dir, "duplicate_songs"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .encoding import encode_corpus

    return encode_corpus(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import measured, pack

    kinds = [(r.container_kind, r.capacity_tokens) for r in table(spark, sf_dir, "containers").where("capacity_tokens > 0").orderBy("capacity_tokens").collect()]
    return pack(measured(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text"), "doc_id", kinds)


def p8_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each kind are, and how near on the curve what they hold."""
    from .packing import use

    return use(p8_packed(spark, sf_dir), table(spark, sf_dir, "containers"))


def p9_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .residue import fit, residue

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return residue(spread(docs), "doc_id", "text", fit(docs, "doc_id", "text"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_residue(spark, sf_dir).select("doc_id")


def p9_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that stay, by their ids."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(p9_found(spark, sf_dir), "doc_id", "left_anti")


def queries() -> dict[str, Query]:
    return {name: f for name, f in sorted(globals().items()) if name[0] == "p" and name[1].isdigit()}


_KINDS = " ".join(
    f"WHEN k IN ({', '.join(repr(x) for x in names)}) THEN {points}"
    for names, points in (
        (["flac", "x-flac", "wav", "wave", "ape", "x-ape", "alac", "apple lossless", "m4a/alac", "dsf", "dff", "aiff", "aif", "wavpack", "wv"], 1_000_000),
    )
)
P6_SQL = f"""SELECT group_id, dup_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY points DESC, checked_at DESC, dup_id) AS n FROM (
 SELECT *, (CASE {_KINDS} WHEN k = 'monkey''s audio' THEN 1000000 ELSE 0 END) + (CASE WHEN bitrate > 0 AND bitrate < 10000 THEN bitrate * 1000 WHEN bitrate > 0 AND bitrate <= 50000000 THEN bitrate ELSE 0 END)
  + trunc(0.1::DOUBLE * CASE sample_rate WHEN 44 THEN 44100 WHEN 88 THEN 88200 WHEN 176 THEN 176400 WHEN 22 THEN 22050 WHEN 11 THEN 11025 ELSE CASE WHEN sample_rate > 0 AND sample_rate < 1000 THEN sample_rate * 1000 WHEN sample_rate > 0 AND sample_rate <= 12288000 THEN sample_rate ELSE 0 END END)::BIGINT
  + (CASE WHEN coalesce(title, '') <> '' THEN 500 ELSE 0 END) + (CASE WHEN coalesce(artist, '') <> '' THEN 500 ELSE 0 END) + (CASE WHEN coalesce(album, '') <> '' THEN 200 ELSE 0 END) AS points
 FROM (SELECT *, regexp_replace(lower(trim(coalesce(format, ''))), '^(audio/|\\.)', '') AS k FROM duplicate_songs))) WHERE n = 1"""


def _case(column: str, table: dict, other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {_sql(k)} THEN {_sql(v)}" for k, v in table.items()) + f" ELSE {other} END"


def _sql(value) -> str:
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "''") + "'"


_STATED = {
    "file_path": ("file_path", "file_path IS NOT NULL"), "format": ("kind", "kind <> ''"), "bitrate": ("bits", "bits IS NOT NULL"), "sample_rate": ("rate", "rate IS NOT NULL"), "channels": ("channels", "channels > 0"),
    "duration": ("duration", "duration > 0"), "title": ("title", "title <> ''"), "artist": ("artist", "artist NOT IN ('', '未知歌手')"), "album": ("album", "album <> ''"), "file_size": ("file_size", "file_size > 0"),
}


def _survivors_sql() -> str:
    """Every field from the first row, in the order of the ranks, that states it."""
    kind = _case("k", FORMAT_MEANING, "k")
    rate = _case("sample_rate", SHORT_RATES, "CASE WHEN sample_rate < 1000 THEN sample_rate::BIGINT * 1000 ELSE sample_rate::BIGINT END")
    picks = ", ".join(f"arg_min({v}, n) FILTER ({w}) AS {c}" for c, (v, w) in _STATED.items())
    rows = ", ".join(f"arg_min(dup_id, n) FILTER ({w})" for _, w in _STATED.values())
    return f"""SELECT group_id, arg_min(dup_id, n) AS dup_id, {picks}, max(points)::BIGINT AS score, count(*) AS n_copies, len(list_distinct([{rows}]))::INT AS from_rows FROM (
 SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY points DESC, checked_at DESC NULLS LAST, dup_id) AS n FROM (
 SELECT *, (CASE WHEN kind IN ({", ".join(map(_sql, LOSSLESS))}) THEN 1000000 ELSE 0 END) + coalesce(bits, 0) + trunc(coalesce(rate, 0) * 0.1::DOUBLE)::BIGINT
  + (CASE WHEN coalesce(title, '') <> '' THEN 500 ELSE 0 END) + (CASE WHEN coalesce(artist, '') <> '' THEN 500 ELSE 0 END) + (CASE WHEN coalesce(album, '') <> '' THEN 200 ELSE 0 END) AS points
 FROM (SELECT *, {kind} AS kind, CASE WHEN bitrate > 0 AND (CASE WHEN bitrate < 10000 THEN bitrate::BIGINT * 1000 ELSE bitrate END) <= {MOST_BITRATE} THEN CASE WHEN bitrate < 10000 THEN bitrate::BIGINT * 1000 ELSE bitrate END END AS bits,
  CASE WHEN sample_rate > 0 AND ({rate}) <= {MOST_RATE} THEN {rate} END AS rate
 FROM (SELECT *, regexp_replace(lower(trim(format)), '^(audio/|\\.)', '') AS k FROM duplicate_songs)))) GROUP BY group_id"""


def oracle_sql() -> dict[str, str]:
    return {"p6_found": P6_SQL, "p6_survivors": _survivors_sql()}
