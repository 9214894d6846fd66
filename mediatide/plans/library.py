"""Queries on the file catalogue, formats, duplicates and lossless grades, with their SQL."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import media as M
from ..functions import text as X
from ..operators import catalog, dedup, fileplans, formats, lossless, store
from ..session import ensure_checkpoint_dir, table
from ..sources.local import HeaderSource, path_list_column, scan_folders

ROOTS = ["/vol1", "/vol2", "/vol3", "/vol4", "/vol9"]
OVERLAP = ["/vol1", "/vol1/lib0000001", "/vol2"]
OUT = "/vol3/lib0000001"
EXTS_SQL = "(" + ", ".join(f"'{e}'" for e in M.AUDIO_EXTENSIONS) + ")"
EXT_SQL = "lower(regexp_extract(file_path, '(\\.[^./]*)$', 1))"
NAME_SQL = "regexp_extract(file_path, '([^/]+)$', 1)"

# headers that stand for each kind of file, one a remainder of the row's id
HEADERS = [
    "664C614300000022", "524946462408000057415645", "464F524D0000000041494646", "464F524D0000000041494643", "4F676753" + "00" * 24 + "4F70757348656164", "4F676753" + "00" * 40,
    "00000020667479704D344120", "4944330300000000", "FFFB906400000000", "4D41432096000000", "7776706B00000000", "44534420 1C000000".replace(" ", ""), "3026B2758E66CF11A6D9",
    "3C21444F43545950452068746D6C3E3C68746D6C3E", "7B226572726F72223A3430337D", "0102030405060708", "6649",
]
_HEADER_SQL = "CASE " + " ".join(f"WHEN rec_id % {len(HEADERS)} = {k} THEN '{h}'" for k, h in enumerate(HEADERS)) + " END"
FILES_SQL = f"SELECT file_path, {_HEADER_SQL} AS h FROM (SELECT file_path, min(rec_id) AS rec_id FROM audio_fingerprints GROUP BY file_path)"
DETECT_SQL = """CASE WHEN length(h) < 8 THEN NULL
 WHEN starts_with(lower(unhex(h)::VARCHAR), '<!doctype html') OR starts_with(h, '7B226572726F72') THEN 'corrupt_or_text'
 WHEN starts_with(h, '664C6143') THEN 'flac'
 WHEN starts_with(h, '52494646') AND substr(h, 17, 8) = '57415645' THEN 'wav'
 WHEN starts_with(h, '464F524D') AND substr(h, 17, 8) IN ('41494646', '41494643') THEN 'aiff'
 WHEN starts_with(h, '4F676753') AND substr(h, 57, 16) = '4F70757348656164' THEN 'opus' WHEN starts_with(h, '4F676753') THEN 'ogg'
 WHEN substr(h, 9, 8) = '66747970' THEN 'm4a' WHEN starts_with(h, '494433') OR regexp_matches(h, '^FF[EF]') THEN 'mp3'
 WHEN starts_with(h, '4D414320') THEN 'ape' WHEN starts_with(h, '7776706B') THEN 'wavpack' WHEN starts_with(h, '44534420') THEN 'dsf' WHEN starts_with(h, '3026B2758E66CF11') THEN 'wma' END"""
_VALID_SQL = " OR ".join(f"(f = '{k}' AND current_ext IN ({', '.join(repr(e) for e in v)}))" for k, v in M.VALID_EXTENSIONS.items())
_PRIMARY_SQL = "CASE f " + " ".join(f"WHEN '{k}' THEN '{e}'" for k, e in M.PRIMARY_EXTENSION.items()) + " ELSE current_ext END"
CHECK_SQL = f"""SELECT file_path, file_name, current_ext, f AS detected_format, suggested_ext, is_mismatch, is_audio, CASE WHEN is_mismatch = 1 THEN 'detected' ELSE 'ok' END AS status FROM (
 SELECT *, CASE WHEN f = 'corrupt_or_text' THEN '.txt' ELSE {_PRIMARY_SQL} END AS suggested_ext,
  CASE WHEN f IN ('corrupt_or_text', 'unknown') THEN 1 WHEN {_VALID_SQL} THEN 0 ELSE 1 END AS is_mismatch, CASE WHEN f IN ('corrupt_or_text', 'unknown') THEN 0 ELSE 1 END AS is_audio
 FROM (SELECT file_path, {NAME_SQL} AS file_name, {EXT_SQL} AS current_ext, coalesce({DETECT_SQL}, 'unknown') AS f FROM ({FILES_SQL})))"""
RECORD_COLUMNS = ["file_path", "file_name", "current_ext", "detected_format", "suggested_ext", "is_mismatch", "is_audio", "status"]


def _prints(spark: SparkSession, sf: str) -> DataFrame:
    """The current row of each file: the delivery loaded last."""
    return store.latest(table(spark, sf, "audio_fingerprints"), ["file_path"], [F.desc("loaded_at"), F.desc("rec_id")])


PRINTS_SQL = "SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY loaded_at DESC, rec_id DESC) AS n FROM audio_fingerprints) WHERE n = 1"
SCORE_SQL = """((CASE WHEN lower(coalesce(format, '')) IN ('flac', 'wav', 'ape', 'alac', 'dsf', 'dff', 'aiff', 'wavpack') THEN 1000000 ELSE 0 END) + coalesce(bitrate, 0)::BIGINT + trunc(coalesce(sample_rate, 0) * 0.1::DOUBLE)::BIGINT
 + (CASE WHEN coalesce(title, '') <> '' THEN 500 ELSE 0 END) + (CASE WHEN coalesce(artist, '') <> '' THEN 500 ELSE 0 END) + (CASE WHEN coalesce(album, '') <> '' THEN 200 ELSE 0 END))::BIGINT"""
VALID_SQL = f"SELECT * REPLACE (coalesce(duration, 0) AS duration), {SCORE_SQL} AS score FROM ({PRINTS_SQL}) WHERE coalesce(is_failed, 0) = 0 AND fingerprint IS NOT NULL AND fingerprint <> ''"


def _clusters_sql(tolerance: float) -> str:
    return f"""SELECT *, sum(CASE WHEN before > 0 AND duration > 0 AND duration - before > {tolerance} THEN 1 ELSE 0 END) OVER (PARTITION BY fingerprint ORDER BY duration, file_path ROWS UNBOUNDED PRECEDING)::BIGINT AS cid
 FROM (SELECT *, lag(duration) OVER (PARTITION BY fingerprint ORDER BY duration, file_path) AS before FROM ({VALID_SQL}))"""


def _members_sql(tolerance: float) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY fingerprint, cid ORDER BY score DESC, file_path) AS rank, count(*) OVER (PARTITION BY fingerprint, cid) AS song_count FROM ({_clusters_sql(tolerance)}) QUALIFY song_count >= 2"


def _groups_sql(tolerance: float) -> str:
    return f"""SELECT fingerprint, cid, song_count, total_size, keep_path, best_score, total_size - keep_size AS wasted_size, 'dup_grp_' || (row_number() OVER (ORDER BY fingerprint, cid))::VARCHAR AS group_id FROM (
 SELECT fingerprint, cid, count(*) AS song_count, sum(coalesce(file_size, 0))::BIGINT AS total_size, min(file_path) FILTER (rank = 1) AS keep_path, min(coalesce(file_size, 0)) FILTER (rank = 1) AS keep_size, max(score) AS best_score
 FROM ({_members_sql(tolerance)}) GROUP BY fingerprint, cid)"""


def catalog_scan(spark, sf):
    return catalog.scan(table(spark, sf, "audio_fingerprints"), ROOTS, OUT)


def catalog_dir_stats(spark, sf):
    s = catalog.directory_stats(_prints(spark, sf), ROOTS)
    return s.withColumn("format_counts", catalog.histogram_text("format_counts"))


def catalog_multi_root_stats(spark, sf):
    return catalog.combined_stats(_prints(spark, sf), OVERLAP).withColumn("format_counts", catalog.histogram_text("format_counts"))


def catalog_top_extensions(spark, sf):
    return catalog.top_extensions(table(spark, sf, "audio_fingerprints"))


def lossless_candidates(spark, sf):
    return catalog.lossless_candidates(table(spark, sf, "audio_fingerprints"))


def path_lists(spark, sf):
    path = F.regexp_replace("file_path", "[;,]", "_")
    raw = F.concat(F.lit(" "), path, F.lit(';"'), F.regexp_extract("file_path", "^(/[^/]+)", 1), F.lit('",, '), path)
    return table(spark, sf, "duplicate_songs").select("dup_id", F.array_join(path_list_column(raw), "|").alias("paths"))


def _headers(spark, sf):
    files = table(spark, sf, "audio_fingerprints").groupBy("file_path").agg(F.min("rec_id").alias("rec_id"))
    return files.withColumn("header", F.unhex(F.element_at(F.array(*map(F.lit, HEADERS)), (F.col("rec_id") % len(HEADERS) + 1).cast("int"))))


def magic_detect(spark, sf):
    return _headers(spark, sf).select("file_path", M.format_of_header(F.col("header")).alias("detected"))


def _records(spark, sf):
    return formats.check(_headers(spark, sf)).select(*RECORD_COLUMNS)


def format_check(spark, sf):
    return _records(spark, sf)


def format_mismatch_report(spark, sf):
    return formats.report(formats.search(_records(spark, sf), mismatch_only=True))


def format_counters(spark, sf):
    return formats.counters(_records(spark, sf))


def format_records_search(spark, sf):
    return formats.search(_records(spark, sf), "The", ("file_name", "detected_format"), mismatch_only=True)


def format_search_totals(spark, sf):
    r = _records(spark, sf)
    return r.groupBy("detected_format").agg(F.count("*").alias("total"), F.count_if(F.col("is_mismatch") == 1).alias("filtered"))


def format_search_json(spark, sf):
    found = formats.search(_records(spark, sf), "m", ("file_name", "detected_format"), mismatch_only=True)
    return formats.search_pages(found.select("file_path", "file_name", "detected_format", "is_mismatch"), 500)


def _fixture(spark) -> str:
    """A folder with one small file for each kind of header, beside the checkpoints, where all tasks can read it."""
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/headers-{uuid.uuid4().hex}"
    jvm = spark._jvm
    for k, head in enumerate(HEADERS):
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/r{k % 3}/d/{k:02d}{'.mp3' if k % 2 else '.txt'}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
        out.write(bytes.fromhex(head) + b"\0" * (2000 + k))
        out.close()
    return re.sub("^file:/*", "/", root)


_FIXTURE_SQL = ', '.join(f"('{k:02d}{'.mp3' if k % 2 else '.txt'}', '{h}')" for k, h in enumerate(HEADERS))


def header_files(spark, sf):
    """The formats of real files by their first bytes: an extension of the table queries, which have made-up headers."""
    spark.dataSource.register(HeaderSource)
    # the file system may keep checksums in hidden files
    f = spark.read.format("file_headers").load(_fixture(spark)).where(~X.base_name(F.col("file_path")).startswith("."))
    return f.select(X.base_name(F.col("file_path")).alias("file_name"), F.length("header").alias("bytes"), M.format_of_header(F.col("header")).alias("detected"))


def folder_scan(spark, sf):
    """A walk over real folders, one of them missing and one left out."""
    root = _fixture(spark)
    found = scan_folders(spark, [f"{root}/r0", f"{root}/r1", f"{root}/none"], f"{root}/r1/d/e")
    return found.select(X.base_name(F.col("file_path")).alias("file_name"), "file_size")


def format_export_rows(spark, sf):
    return formats.export_rows(_records(spark, sf))


def probe_codec_normalise(spark, sf):
    p = table(spark, sf, "audio_fingerprints")
    codec, box = F.regexp_replace(F.lower(F.coalesce("format", F.lit(""))), "^audio/(x-)?", ""), F.when(F.col("rec_id") % 5 == 0, "mov,mp4,m4a").when(F.col("rec_id") % 5 == 1, "ogg").otherwise("")
    return p.select("rec_id", M.format_of_codec(codec, box).alias("kind"))


def probe_metadata(spark, sf):
    p = table(spark, sf, "audio_metadata")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("N/A"))
    tags = F.map_from_arrays(F.array(F.lit("TITLE"), F.lit("Artist"), F.lit("album")), F.array(*(F.coalesce(c, F.lit("")) for c in ("title", "artist", "album"))))
    json = F.to_json(F.struct(
        F.struct(F.lit("mp3").alias("format_name"), F.lit("N/A").alias("duration"), text("bitrate").alias("bit_rate"), tags.alias("tags")).alias("format"),
        F.array(F.struct(F.lit("video").alias("codec_type"), F.lit("png").alias("codec_name"), F.lit("1").alias("duration"), F.lit("2").alias("bit_rate"), F.lit("0").alias("sample_rate"), F.lit(0).alias("channels")),
                F.struct(F.lit("audio").alias("codec_type"), F.lit("mp3").alias("codec_name"), text("duration").alias("duration"), F.lit("64000").alias("bit_rate"), text("sample_rate").alias("sample_rate"), F.coalesce("channels", F.lit(0)).alias("channels"))).alias("streams"),
    ))
    r = formats.read_probe(p.select("meta_id", json.alias("j")), "j")
    return r.select("meta_id", "probe_format", "probe_duration", "probe_bitrate", "probe_sample_rate", "probe_channels", "probe_title", "probe_artist", "probe_album")


def image_kind(spark, sf):
    heads = ["89504E470D0A1A0A", "FFD8FFE000104A46", "524946460000000057454250", "474946383961", "474946383761", "3C68746D6C3E", "", "524946460000000057415645"]
    data = F.unhex(F.element_at(F.array(*map(F.lit, heads)), (F.col("doc_id") % len(heads) + 1).cast("int")))
    return table(spark, sf, "documents").select("doc_id", F.coalesce(M.image_of_header(data), F.lit("none")).alias("kind"))


def cover_status(spark, sf):
    """Covers of all kinds and sizes: at the limit, beyond it, empty."""
    heads = ["89504E470D0A1A0A", "FFD8FFE000104A46", "3C68746D6C3E"]
    data = F.unhex(F.element_at(F.array(*map(F.lit, heads)), (F.col("doc_id") % 3 + 1).cast("int")))
    size = F.element_at(F.array(*(F.lit(n) for n in (0, M.MOST_COVER_BYTES, M.MOST_COVER_BYTES + 1, 500))), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", M.cover_status(data, size).alias("status"))


def valid_fingerprints(spark, sf):
    return dedup.valid_fingerprints(_prints(spark, sf)).select("file_path", "fingerprint", "duration").orderBy("fingerprint", "duration")


def song_scores(spark, sf):
    p = table(spark, sf, "audio_fingerprints")
    return p.select("rec_id", M.song_score(*(F.col(c) for c in ("format", "bitrate", "sample_rate", "title", "artist", "album"))).alias("score"))


def duration_clusters(spark, sf):
    return dedup.clustered(_prints(spark, sf)).select("file_path", "fingerprint", "duration", "cid")


GROUP_COLUMNS = ["fingerprint", "cid", "song_count", "total_size", "keep_path", "best_score", "wasted_size", "group_id"]


def dedup_groups(spark, sf):
    return dedup.groups(_prints(spark, sf)).select(*GROUP_COLUMNS)


def dedup_tolerance_zero(spark, sf):
    return dedup.groups(_prints(spark, sf), 0.0).select(*GROUP_COLUMNS)


def dedup_members_ranked(spark, sf):
    return dedup.members(_prints(spark, sf)).select("fingerprint", "cid", "file_path", "score", "rank", "is_recommended_keep")


def dedup_group_songs(spark, sf):
    """The nested songs of every group, in a form that both engines write alike."""
    g = dedup.group_songs(_prints(spark, sf))
    shown = F.transform("songs", lambda x: F.concat(x["rank"].cast("string"), F.lit("|"), x["file_path"], F.lit("|"), x["score"].cast("string"), F.lit("|"), x["is_recommended_keep"].cast("string")))
    return g.select("fingerprint", "cid", "page", F.size("songs").cast("bigint").alias("n"), F.array_join(shown, ";").alias("songs"))


def dedup_summary(spark, sf):
    return dedup.summary(dedup.groups(_prints(spark, sf), number=False))


def dedup_clean_plan(spark, sf):
    return dedup.clean_plan(dedup.members(_prints(spark, sf)))


def dedup_survivors(spark, sf):
    p = _prints(spark, sf)
    return dedup.survivors(p, dedup.clean_plan(dedup.members(p))).select("file_path")


def fingerprint_preview(spark, sf):
    return table(spark, sf, "audio_fingerprints").select("rec_id", F.substring(F.coalesce("fingerprint", F.lit("")), 1, 16).alias("preview"))


def _bands(spark, sf):
    li = table(spark, sf, "lineitem")
    full = F.when(F.col("l_orderkey") % 97 == 0, F.lit(-999.0)).otherwise(-10 - 50 * F.col("l_discount"))
    b = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("file_name"), full.alias("full_db"), "l_quantity", "l_tax", F.when(F.col("l_linenumber") % 2 == 0, 96000).when(F.col("l_linenumber") == 1, 0).otherwise(44100).alias("sample_rate"))
    b = b.withColumn("b16", F.col("full_db") - F.lit(0.9) * F.col("l_quantity"))
    return b.withColumns({"b20": F.col("b16") - 100 * F.col("l_tax"), "b22": F.col("b16") - 120 * F.col("l_tax")})


BANDS_SQL = """SELECT *, b16 - 100 * l_tax AS b20, b16 - 120 * l_tax AS b22 FROM (SELECT *, full_db - 0.9::DOUBLE * l_quantity AS b16 FROM (
 SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS file_name, CASE WHEN l_orderkey % 97 = 0 THEN -999.0::DOUBLE ELSE -10 - 50 * l_discount END AS full_db, l_quantity, l_tax, CASE WHEN l_linenumber % 2 = 0 THEN 96000 ELSE 44100 END AS sample_rate FROM lineitem))"""
GRADED_SQL = f"""SELECT *, CASE grade WHEN 'unknown' THEN 0 WHEN 'fake_low_bitrate' THEN 15800 WHEN 'fake_320k' THEN 19800 WHEN 'true_hires' THEN sample_rate // 2 ELSE 22050 END AS cutoff_freq_hz,
 CASE grade WHEN 'unknown' THEN 0 WHEN 'fake_low_bitrate' THEN 95 WHEN 'fake_320k' THEN 88 WHEN 'true_hires' THEN 98 ELSE 92 END AS confidence,
 CASE grade {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in M.GRADE_TEXTS.items())} END AS grade_text, round(CASE grade WHEN 'unknown' THEN 0 ELSE full_db - b20 END, 6) AS high_freq_energy FROM (
 SELECT *, CASE WHEN full_db = -999 THEN 'unknown' WHEN b16 < -65 OR full_db - b16 > 42 THEN 'fake_low_bitrate' WHEN b20 < -62 OR full_db - b20 > 40 THEN 'fake_320k'
  WHEN sample_rate >= 88200 AND b22 > -55 AND full_db - b22 < 35 THEN 'true_hires' ELSE 'true_lossless' END AS grade FROM ({BANDS_SQL}))"""
_GRADE_COLUMNS = "file_name, grade, grade_text, cutoff_freq_hz, confidence, high_freq_energy"


def _graded(spark, sf):
    return lossless.grade(_bands(spark, sf)).withColumn("high_freq_energy", F.round("high_freq_energy", 6))


def lossless_grades(spark, sf):
    return _graded(spark, sf).select(*_GRADE_COLUMNS.split(", "))


def lossless_counters(spark, sf):
    return lossless.counters(_graded(spark, sf))


def lossless_records_fake(spark, sf):
    return lossless.records(_graded(spark, sf), "fake_only").select("file_name", "grade")


def lossless_records_true(spark, sf):
    return lossless.records(_graded(spark, sf), "true_only").select("file_name", "grade")


def lossless_export_rows(spark, sf):
    return _graded(spark, sf).select(F.col("file_name").alias("文件名"), F.col("grade_text").alias("无损判定"), F.col("cutoff_freq_hz").alias("高频截止频率(Hz)"), F.format_string("%d%%", F.col("confidence")).alias("置信度"))


def rms_parse(spark, sf):
    level = F.format_string("%.2f", -F.col("l_quantity"))
    line = lambda x: F.concat(F.lit("RMS level dB: "), x, F.lit("\n"))
    t = F.when(F.col("l_linenumber") == 1, line(F.lit("-inf"))).when(F.col("l_linenumber") == 2, F.lit("no level")).otherwise(F.concat(line(F.lit("-91.0")), F.lit("x\n"), line(level)))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", M.last_level(t).alias("level"))


def duration_parse(spark, sf):
    s = F.floor(F.coalesce("duration", F.lit(0.0))).cast("int")
    t = F.when(F.col("rec_id") % 7 == 0, F.lit("no duration here")).otherwise(F.concat(F.lit("  Duration: 00:"), F.lpad((s / 60).cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"), F.lit(".50, start: 0")))
    return table(spark, sf, "audio_fingerprints").select("rec_id", M.stated_duration(t).alias("seconds"))


def actual_duration(spark, sf):
    p, m = _prints(spark, sf), table(spark, sf, "audio_metadata").groupBy("file_path").agg(F.max(F.coalesce("duration", F.lit(0.0))).alias("probed"))
    d = F.coalesce("duration", F.lit(0.0))
    return p.join(m, "file_path", "left").select("file_path", F.when(d == 0, F.coalesce("probed", F.lit(0.0))).otherwise(d).alias("duration"))


def shown_values(spark, sf):
    p = table(spark, sf, "audio_fingerprints")
    kbps = F.when(F.coalesce("bitrate", F.lit(0)) <= 0, "-").otherwise(F.floor(F.col("bitrate") / 1000 + 0.5).cast("string"))
    khz = F.when(F.coalesce("sample_rate", F.lit(0)) <= 0, "-").otherwise(F.format_string("%.1f", F.col("sample_rate") / 1000))
    return p.select("rec_id", M.human_size(F.col("file_size")).alias("size"), M.clock(F.floor(F.col("duration")).cast("double")).alias("clock"), kbps.alias("kbps"), khz.alias("khz"))


def mime_types(spark, sf):
    return catalog.scan(table(spark, sf, "audio_fingerprints")).select("file_path", F.coalesce(M.lookup(F.col("ext"), M.MIME_TYPES), F.lit("")).alias("mime"))


def fingerprint_hashes(spark, sf):
    fp = F.coalesce("fingerprint", F.lit(""))
    return table(spark, sf, "audio_fingerprints").select(
        "rec_id", F.sha2(fp, 256).alias("sha"), F.base64(F.unhex(F.sha2(fp, 256))).alias("sha64"), F.base64(F.encode(fp, "UTF-8")).alias("b64"), F.sha2(F.concat(fp, F.lit(":"), F.col("rec_id").cast("string")), 256).alias("salted")
    )


def rename_plan(spark, sf):
    return fileplans.rename_plan(formats.search(_records(spark, sf), mismatch_only=True))


def copy_plan(spark, sf):
    return fileplans.transfer_plan(formats.search(_records(spark, sf), mismatch_only=True), "/vol1", "/output", "copy", keep_structure=False)


def move_plan(spark, sf):
    return fileplans.transfer_plan(formats.search(_records(spark, sf), mismatch_only=True), "/vol1", "/output", "move", fix_extension=False)


def recycle_plan(spark, sf):
    return fileplans.recycle_plan(_records(spark, sf).where(F.col("is_audio") == 0), "/vol2", "/output/_recycle_bin")


def plan_targets_apart(spark, sf):
    """All files copied into one folder in which some names are taken: how many names, and whether any is used twice or taken."""
    r = _records(spark, sf)
    plan = fileplans.transfer_plan(r, "/", "/output", keep_structure=False)
    there = plan.where(F.pmod(F.xxhash64("file_path"), F.lit(3)) == 0).select(F.col("target").alias("file_path"))
    made = fileplans.transfer_plan(r, "/", "/output", keep_structure=False, existing=there)
    flagged = made.join(there.distinct().select(F.col("file_path").alias("target"), F.lit(1).alias("taken")), "target", "left")
    return flagged.agg(F.count("*").alias("files"), F.countDistinct("target").alias("names"), F.count("taken").alias("taken"))


def records_after_rename(spark, sf):
    r = _records(spark, sf)
    return fileplans.rewrite_records(r, fileplans.rename_plan(formats.search(r, mismatch_only=True)), "rename_fix")


def records_after_copy(spark, sf):
    r = _records(spark, sf)
    return fileplans.rewrite_records(r, fileplans.transfer_plan(formats.search(r, mismatch_only=True), "/vol1", "/output", "copy"), "copy")


def merge_upsert(spark, sf):
    p = table(spark, sf, "audio_fingerprints")
    split = F.to_timestamp_ntz(F.lit("2024-06-01 00:00:00"))
    order = [F.desc("loaded_at"), F.desc("rec_id")]
    base = store.latest(p.where(F.col("loaded_at") < split), ["file_path"], order)
    return store.upsert(base, p.where(F.col("loaded_at") >= split), ["file_path"], order).select("file_path", "rec_id", "is_failed", "file_size")


def _catalog_now(spark, sf):
    return table(spark, sf, "audio_metadata").select("file_path").distinct()


def remove_missing(spark, sf):
    kept, gone = store.keep_present(_prints(spark, sf), _catalog_now(spark, sf))
    return kept.select("file_path", F.lit("kept").alias("fate")).unionByName(gone.select("file_path", F.lit("removed").alias("fate")))


def delete_by_key(spark, sf):
    gone = table(spark, sf, "duplicate_songs").where(~F.coalesce("is_recommended_keep", F.lit(True)))
    return store.delete_keys(_prints(spark, sf), gone, ["file_path"]).select("file_path", "rec_id")


def reset_failed(spark, sf):
    return store.reset_failed(table(spark, sf, "audio_fingerprints")).select("rec_id", "is_failed", "attempted_at", "error_msg")


def _refresh(mode):
    def run(spark, sf):
        cache = _prints(spark, sf).where(F.col("rec_id") % 3 != 0)
        return store.to_compute(table(spark, sf, "audio_fingerprints").select("file_path"), cache, mode)

    return run


def _refresh_sql(mode):
    need = "c.file_path IS NULL OR coalesce(c.fingerprint, '') = ''" + (" OR coalesce(c.is_failed, 0) = 1" if mode == "retry_failed" else "")
    if mode == "recompute_all":
        need = "true"
    return f"SELECT DISTINCT f.file_path FROM audio_fingerprints f LEFT JOIN (SELECT * FROM ({PRINTS_SQL}) WHERE rec_id % 3 <> 0) c ON f.file_path = c.file_path WHERE {need}"


def cache_hits(spark, sf):
    return store.cache_hits(table(spark, sf, "audio_fingerprints").select("rec_id", "file_path", "mtime", "file_size"), _prints(spark, sf)).select("rec_id")


def truncated(spark, sf):
    """What a store holds after it was emptied."""
    ensure_checkpoint_dir(spark)
    kept = store.ParquetStore(spark, f"{spark.sparkContext.getCheckpointDir()}/store-{uuid.uuid4().hex}", ["rec_id"], 4)
    kept.write(table(spark, sf, "audio_fingerprints").select("rec_id", "file_path"))
    kept.truncate()
    return kept.read()


def settings_upsert(spark, sf):
    rows = table(spark, sf, "region").select(F.lit(1).alias("id"), F.col("r_name").alias("server_url"), F.col("r_regionkey").alias("updated_at"))
    return store.upsert(rows.limit(0), rows, ["id"], [F.desc("updated_at")])


_PATH_SQL = f"regexp_replace(file_path, '\\.[^./]*$', '')"
_MISMATCH_SQL = f"SELECT * FROM ({CHECK_SQL}) WHERE is_mismatch = 1"
_BARE_SQL = "'/output/' || regexp_extract(regexp_replace(file_path, '\\.[^./]*$', ''), '([^/]+)$', 1)"


def _apart_sql(inner: str) -> str:
    return f"SELECT * REPLACE (CASE WHEN n = 1 THEN target ELSE regexp_replace(target, '\\.[^./]*$', '') || '_' || (n - 1)::VARCHAR || regexp_extract(target, '(\\.[^./]*)$', 1) END AS target) FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY file_path) AS n FROM ({inner}))"


_BELOW_SQL = "CASE WHEN starts_with(file_path, '{root}/') THEN substr(file_path, {n}) ELSE " + NAME_SQL.replace("{", "{{").replace("}", "}}") + " END"

QUERIES = {
    "catalog_scan": (catalog_scan, f"SELECT DISTINCT file_path, {NAME_SQL} AS file_name, {EXT_SQL} AS ext FROM audio_fingerprints WHERE {EXT_SQL} IN {EXTS_SQL} AND regexp_matches(file_path, '^/vol[12349]/') AND NOT starts_with(file_path, '{OUT}/')"),
    "catalog_dir_stats": (catalog_dir_stats, f"""SELECT r.root, t.total_files IS NOT NULL AS exists, coalesce(t.total_files, 0)::BIGINT AS total_files, coalesce(t.total_size, 0)::BIGINT AS total_size, coalesce(t.format_counts, '') AS format_counts
 FROM (VALUES {", ".join(f"('{r}')" for r in ROOTS)}) r(root) LEFT JOIN (SELECT root, sum(n) AS total_files, sum(size) AS total_size, string_agg(ext || ':' || n, ',' ORDER BY ext) AS format_counts FROM (
 SELECT regexp_extract(file_path, '^(/[^/]+)/', 1) AS root, {EXT_SQL} AS ext, count(*) AS n, sum(file_size) AS size FROM ({PRINTS_SQL}) WHERE {EXT_SQL} IN {EXTS_SQL} GROUP BY 1, 2) GROUP BY root) t ON r.root = t.root"""),
    "catalog_multi_root_stats": (catalog_multi_root_stats, f"""SELECT '{", ".join(OVERLAP)}' AS root, sum(n)::BIGINT AS total_files, sum(size)::BIGINT AS total_size, string_agg(ext || ':' || n, ',' ORDER BY ext) AS format_counts FROM (
 SELECT {EXT_SQL} AS ext, count(*) AS n, sum(file_size) AS size FROM ({PRINTS_SQL}), (VALUES {", ".join(f"('{r}')" for r in OVERLAP)}) r(root) WHERE starts_with(file_path, root || '/') AND {EXT_SQL} IN {EXTS_SQL} GROUP BY 1)"""),
    "catalog_top_extensions": (catalog_top_extensions, f"SELECT {EXT_SQL} AS ext, count(DISTINCT file_path) AS n FROM audio_fingerprints WHERE {EXT_SQL} IN {EXTS_SQL} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4"),
    "lossless_candidates": (lossless_candidates, f"SELECT DISTINCT file_path, {NAME_SQL} AS file_name, {EXT_SQL} AS ext FROM audio_fingerprints WHERE {EXT_SQL} IN ('.flac', '.ape', '.wav', '.wv', '.aiff', '.aif', '.alac')"),
    "path_lists": (path_lists, "SELECT dup_id, regexp_replace(file_path, '[;,]', '_', 'g') || '|' || regexp_extract(file_path, '^(/[^/]+)', 1) AS paths FROM duplicate_songs"),
    "magic_detect": (magic_detect, f"SELECT file_path, {DETECT_SQL} AS detected FROM ({FILES_SQL})"),
    "format_check": (format_check, CHECK_SQL),
    "format_mismatch_report": (format_mismatch_report, _MISMATCH_SQL + " ORDER BY is_mismatch DESC, file_name"),
    "format_counters": (format_counters, f"SELECT count(*) AS total, count(*) FILTER (is_mismatch = 1) AS mismatched, count(*) FILTER (is_mismatch = 1 AND is_audio = 0) AS fake_or_corrupt FROM ({CHECK_SQL})"),
    "format_records_search": (format_records_search, f"SELECT * FROM ({CHECK_SQL}) WHERE is_mismatch = 1 AND (contains(lower(file_name), 'the') OR contains(lower(detected_format), 'the'))"),
    "format_search_totals": (format_search_totals, f"SELECT detected_format, count(*) AS total, count(*) FILTER (is_mismatch = 1) AS filtered FROM ({CHECK_SQL}) GROUP BY 1"),
    "format_search_json": (format_search_json, f"""SELECT n // 500 AS page, '{{"total":' || any_value(total) || ',"records":[' || string_agg(to_json({{'file_path': file_path, 'file_name': file_name, 'detected_format': detected_format, 'is_mismatch': is_mismatch}})::VARCHAR, ',' ORDER BY n) || ']}}' AS json
 FROM (SELECT *, row_number() OVER (ORDER BY file_path) - 1 AS n, count(*) OVER () AS total FROM ({CHECK_SQL}) WHERE is_mismatch = 1 AND (contains(lower(file_name), 'm') OR contains(lower(detected_format), 'm'))) GROUP BY 1"""),
    "header_files": (header_files, f"SELECT file_name, 1024 AS bytes, {DETECT_SQL} AS detected FROM (SELECT file_name, rpad(h, 2048, '0') AS h FROM (VALUES {_FIXTURE_SQL}) v(file_name, h))"),
    "folder_scan": (folder_scan, "SELECT file_name, file_size::BIGINT AS file_size FROM (VALUES " + ", ".join(f"('{k:02d}.mp3', {2000 + k + len(h) // 2})" for k, h in enumerate(HEADERS) if k % 2 and k % 3 < 2) + ") v(file_name, file_size)"),
    "format_export_rows": (format_export_rows, f"""SELECT file_name AS "文件名", current_ext AS "当前后缀", detected_format AS "真实格式", suggested_ext AS "建议后缀", CASE is_mismatch WHEN 1 THEN '是' ELSE '否' END AS "是否不一致", CASE is_audio WHEN 1 THEN '是' ELSE '否' END AS "是否音频", file_path AS "路径", status AS "状态" FROM ({CHECK_SQL})"""),
    "probe_codec_normalise": (probe_codec_normalise, """SELECT rec_id, CASE WHEN contains(c, 'mp3') THEN 'mp3' WHEN contains(c, 'aac') OR contains(c, 'alac') OR rec_id % 5 = 0 THEN 'm4a' WHEN contains(c, 'flac') THEN 'flac' WHEN contains(c, 'pcm_') THEN 'wav' WHEN contains(c, 'opus') THEN 'opus'
 WHEN contains(c, 'vorbis') OR rec_id % 5 = 1 THEN 'ogg' WHEN contains(c, 'wmav') THEN 'wma' WHEN contains(c, 'ape') THEN 'ape' ELSE c END AS kind FROM (SELECT rec_id, regexp_replace(lower(coalesce(format, '')), '^audio/(x-)?', '') AS c FROM audio_fingerprints)"""),
    "probe_metadata": (probe_metadata, """SELECT meta_id, 'mp3' AS probe_format, coalesce(duration, 0) AS probe_duration, coalesce(nullif(bitrate, 0), 64000)::INT AS probe_bitrate, coalesce(sample_rate, 0)::INT AS probe_sample_rate, coalesce(channels, 0) AS probe_channels,
 regexp_replace(coalesce(title, ''), '^\\s+|\\s+$', '', 'g') AS probe_title, regexp_replace(coalesce(artist, ''), '^\\s+|\\s+$', '', 'g') AS probe_artist, regexp_replace(coalesce(album, ''), '^\\s+|\\s+$', '', 'g') AS probe_album FROM audio_metadata"""),
    "image_kind": (image_kind, "SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' WHEN 2 THEN 'webp' WHEN 3 THEN 'gif' WHEN 4 THEN 'gif' ELSE 'none' END AS kind FROM documents"),
    "cover_status": (cover_status, "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'empty' WHEN 2 THEN 'too_large' ELSE CASE doc_id % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' ELSE 'no_image' END END AS status FROM documents"),
    "valid_fingerprints": (valid_fingerprints, f"SELECT file_path, fingerprint, duration FROM ({PRINTS_SQL}) WHERE coalesce(is_failed, 0) = 0 AND fingerprint <> ''"),
    "song_scores": (song_scores, f"SELECT rec_id, {SCORE_SQL} AS score FROM audio_fingerprints"),
    "duration_clusters": (duration_clusters, f"SELECT file_path, fingerprint, duration, cid FROM ({_members_sql(30.0)})"),
    "dedup_groups": (dedup_groups, _groups_sql(30.0)),
    "dedup_tolerance_zero": (dedup_tolerance_zero, _groups_sql(0.0)),
    "dedup_members_ranked": (dedup_members_ranked, f"SELECT fingerprint, cid, file_path, score, rank, rank = 1 AS is_recommended_keep FROM ({_members_sql(30.0)})"),
    "dedup_group_songs": (dedup_group_songs, f"SELECT fingerprint, cid, (rank - 1) // 1000 AS page, count(*) AS n, string_agg(rank || '|' || file_path || '|' || score || '|' || (rank = 1)::VARCHAR, ';' ORDER BY rank) AS songs FROM ({_members_sql(30.0)}) GROUP BY 1, 2, 3"),
    "dedup_summary": (dedup_summary, f"SELECT count(*) AS group_count, sum(song_count)::BIGINT AS total_duplicate_songs, sum(wasted_size)::BIGINT AS total_wasted_size FROM ({_groups_sql(30.0)})"),
    "dedup_clean_plan": (dedup_clean_plan, f"SELECT file_path, 'recycle' AS action, true AS success, '/output/_recycle_bin' || file_path AS target, '' AS message FROM ({_members_sql(30.0)}) WHERE rank > 1"),
    "dedup_survivors": (dedup_survivors, f"SELECT file_path FROM ({VALID_SQL}) WHERE file_path NOT IN (SELECT file_path FROM ({_members_sql(30.0)}) WHERE rank > 1)"),
    "fingerprint_preview": (fingerprint_preview, "SELECT rec_id, substr(coalesce(fingerprint, ''), 1, 16) AS preview FROM audio_fingerprints"),
    "lossless_grade": (lossless_grades, f"SELECT {_GRADE_COLUMNS} FROM ({GRADED_SQL})"),
    "lossless_counters": (lossless_counters, f"SELECT count(*) AS total, count(*) FILTER (grade IN ('true_lossless', 'true_hires')) AS true_count, count(*) FILTER (starts_with(grade, 'fake')) AS fake_count, count(*) FILTER (grade = 'unknown') AS failed_count FROM ({GRADED_SQL})"),
    "lossless_records_fake": (lossless_records_fake, f"SELECT file_name, grade FROM ({GRADED_SQL}) WHERE starts_with(grade, 'fake')"),
    "lossless_records_true": (lossless_records_true, f"SELECT file_name, grade FROM ({GRADED_SQL}) WHERE starts_with(grade, 'true')"),
    "lossless_export_rows": (lossless_export_rows, f"""SELECT file_name AS "文件名", grade_text AS "无损判定", cutoff_freq_hz AS "高频截止频率(Hz)", confidence || '%' AS "置信度" FROM ({GRADED_SQL})"""),
    "rms_parse": (rms_parse, "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber <= 2 THEN -999.0::DOUBLE ELSE -l_quantity END AS level FROM lineitem"),
    "duration_parse": (duration_parse, "SELECT rec_id, CASE WHEN rec_id % 7 = 0 THEN 0.0::DOUBLE ELSE floor(coalesce(duration, 0)) + 0.5::DOUBLE END AS seconds FROM audio_fingerprints"),
    "actual_duration": (actual_duration, f"SELECT p.file_path, CASE WHEN coalesce(p.duration, 0) = 0 THEN coalesce(m.d, 0) ELSE p.duration END AS duration FROM ({PRINTS_SQL}) p LEFT JOIN (SELECT file_path, max(coalesce(duration, 0)) AS d FROM audio_metadata GROUP BY 1) m ON p.file_path = m.file_path"),
    "shown_values": (shown_values, """SELECT rec_id, CASE WHEN coalesce(file_size, 0) = 0 THEN '0 B' WHEN file_size < 1024 THEN file_size || ' B' WHEN file_size < 1048576 THEN regexp_replace(printf('%.2f', file_size / 1024.0::DOUBLE), '\\.?0+$', '') || ' KB'
 WHEN file_size < 1073741824 THEN regexp_replace(printf('%.2f', file_size / 1048576.0::DOUBLE), '\\.?0+$', '') || ' MB' ELSE regexp_replace(printf('%.2f', file_size / 1073741824.0::DOUBLE), '\\.?0+$', '') || ' GB' END AS size,
 CASE WHEN coalesce(floor(duration), 0) = 0 THEN '--:--' ELSE (floor(s / 60))::BIGINT || ':' || lpad((s % 60)::BIGINT::VARCHAR, 2, '0') END AS clock,
 CASE WHEN coalesce(bitrate, 0) <= 0 THEN '-' ELSE floor(bitrate / 1000.0::DOUBLE + 0.5::DOUBLE)::BIGINT::VARCHAR END AS kbps, CASE WHEN coalesce(sample_rate, 0) <= 0 THEN '-' ELSE printf('%.1f', sample_rate / 1000.0::DOUBLE) END AS khz
 FROM (SELECT *, CASE WHEN floor(duration) > 1000 THEN floor(floor(duration) / 1000) ELSE floor(duration) END AS s FROM audio_fingerprints)"""),
    "mime_types": (mime_types, f"SELECT DISTINCT file_path, CASE {EXT_SQL} {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in M.MIME_TYPES.items())} ELSE '' END AS mime FROM audio_fingerprints WHERE {EXT_SQL} IN {EXTS_SQL}"),
    "fingerprint_hashes": (fingerprint_hashes, "SELECT rec_id, sha256(coalesce(fingerprint, '')) AS sha, base64(unhex(sha256(coalesce(fingerprint, '')))) AS sha64, base64(encode(coalesce(fingerprint, ''))) AS b64, sha256(coalesce(fingerprint, '') || ':' || rec_id) AS salted FROM audio_fingerprints"),
    "rename_plan": (rename_plan, f"SELECT file_path, {_PATH_SQL} || suggested_ext AS target, true AS success, CASE WHEN {_PATH_SQL} || suggested_ext = file_path THEN '后缀已一致，无需重命名' ELSE '后缀纠正成功' END AS msg FROM ({_MISMATCH_SQL})"),
    "copy_plan": (copy_plan, "SELECT file_path, 'copy' AS action, target, true AS success, '已复制到输出目录' AS msg FROM (" + _apart_sql(f"SELECT file_path, {_BARE_SQL} || suggested_ext AS target FROM ({_MISMATCH_SQL})") + ")"),
    "move_plan": (move_plan, "SELECT file_path, 'move' AS action, target, true AS success, '已移动到输出目录' AS msg FROM (" + _apart_sql(f"SELECT file_path, '/output/' || {_BELOW_SQL.format(root='/vol1', n=7)} AS target FROM ({_MISMATCH_SQL})") + ")"),
    "recycle_plan": (recycle_plan, "SELECT file_path, target, true AS success, '已移入回收站' AS msg FROM (" + _apart_sql(f"SELECT file_path, '/output/_recycle_bin/' || {_BELOW_SQL.format(root='/vol2', n=7)} AS target FROM ({CHECK_SQL}) WHERE is_audio = 0") + ")"),
    "plan_targets_apart": (plan_targets_apart, f"SELECT count(*) AS files, count(*) AS names, 0::BIGINT AS taken FROM ({FILES_SQL})"),
    "records_after_rename": (records_after_rename, f"""SELECT CASE is_mismatch WHEN 1 THEN {_PATH_SQL} || suggested_ext ELSE file_path END AS file_path, CASE is_mismatch WHEN 1 THEN regexp_replace(file_name, '\\.[^./]*$', '') || suggested_ext ELSE file_name END AS file_name,
 CASE is_mismatch WHEN 1 THEN lower(suggested_ext) ELSE current_ext END AS current_ext, detected_format, suggested_ext, 0 AS is_mismatch, is_audio, CASE is_mismatch WHEN 1 THEN '已修正后缀' ELSE status END AS status FROM ({CHECK_SQL})"""),
    "records_after_copy": (records_after_copy, f"""SELECT c.file_path, c.file_name, current_ext, detected_format, suggested_ext, is_mismatch, is_audio, CASE WHEN t.target IS NULL THEN status ELSE '已复制到: ' || regexp_extract(t.target, '([^/]+)$', 1) END AS status FROM ({CHECK_SQL}) c
 LEFT JOIN ({_apart_sql(f"SELECT file_path, regexp_replace('/output/' || {_BELOW_SQL.format(root='/vol1', n=7)}, '[.][^./]*$', '') || suggested_ext AS target FROM ({_MISMATCH_SQL})")}) t ON c.file_path = t.file_path"""),
    "merge_upsert": (merge_upsert, f"SELECT file_path, rec_id, is_failed, file_size FROM ({PRINTS_SQL})"),
    "remove_missing": (remove_missing, f"SELECT file_path, CASE WHEN file_path IN (SELECT file_path FROM audio_metadata) THEN 'kept' ELSE 'removed' END AS fate FROM ({PRINTS_SQL})"),
    "delete_by_key": (delete_by_key, f"SELECT file_path, rec_id FROM ({PRINTS_SQL}) WHERE file_path NOT IN (SELECT file_path FROM duplicate_songs WHERE NOT coalesce(is_recommended_keep, true))"),
    "reset_failed": (reset_failed, "SELECT rec_id, CASE is_failed WHEN 1 THEN 0 ELSE is_failed END AS is_failed, CASE is_failed WHEN 1 THEN 0 ELSE attempted_at END AS attempted_at, CASE is_failed WHEN 1 THEN '' ELSE error_msg END AS error_msg FROM audio_fingerprints"),
    **{f"refresh_{m}": (_refresh(m), _refresh_sql(m)) for m in ("missing", "retry_failed", "recompute_all")},
    "cache_hits": (cache_hits, f"SELECT f.rec_id FROM audio_fingerprints f WHERE EXISTS (SELECT 1 FROM ({PRINTS_SQL}) c WHERE c.file_path = f.file_path AND c.mtime = f.mtime AND c.file_size = f.file_size AND coalesce(c.is_failed, 0) = 0 AND coalesce(c.fingerprint, '') <> '')"),
    "truncate_table": (truncated, "SELECT rec_id, file_path FROM audio_fingerprints WHERE false"),
    "settings_upsert": (settings_upsert, "SELECT 1 AS id, r_name AS server_url, r_regionkey AS updated_at FROM region ORDER BY r_regionkey DESC LIMIT 1"),
}
