"""What files are against what their names say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.media import PRIMARY_EXTENSION, extension_fits, format_of_codec, format_of_header, lookup
from ..functions.text import base_name, extension, strip
from .ordering import numbered


def check(files: DataFrame, probed: Column | None = None, readable: Column | None = None) -> DataFrame:
    """``files`` (file_path, header) with the detected format and whether the name fits it.

    Order: unreadable; text in disguise; what the probe says (``probed``); what the header says; unknown. A null
    header counts as unreadable unless ``readable`` says otherwise.
    """
    ok = readable if readable is not None else F.col("header").isNotNull()
    by_header = format_of_header(F.col("header"))
    detected = F.when(~ok, "error").when(by_header == "corrupt_or_text", by_header).otherwise(F.coalesce(probed if probed is not None else F.lit(None), by_header, F.lit("unknown")))
    f = files.withColumns({"file_name": base_name(F.col("file_path")), "current_ext": extension(F.col("file_path")), "detected_format": detected})
    bad = F.col("detected_format").isin("error", "corrupt_or_text", "unknown")
    suggested = F.when(F.col("detected_format") == "corrupt_or_text", ".txt").otherwise(F.coalesce(lookup(F.col("detected_format"), PRIMARY_EXTENSION), F.col("current_ext")))
    mismatch = F.when(bad, 1).otherwise(F.when(extension_fits(F.col("detected_format"), F.col("current_ext")), 0).otherwise(1))
    return f.withColumns({"suggested_ext": suggested, "is_mismatch": mismatch.cast("int"), "is_audio": F.when(bad, 0).otherwise(1).cast("int")}).withColumn(
        "status", F.when(F.col("is_mismatch") == 1, "detected").otherwise("ok")
    )


def counters(records: DataFrame) -> DataFrame:
    """One row: files, mismatched ones, and those among them that are no audio."""
    return records.agg(F.count("*").alias("total"), F.count_if(F.col("is_mismatch") == 1).alias("mismatched"), F.count_if((F.col("is_mismatch") == 1) & (F.col("is_audio") == 0)).alias("fake_or_corrupt"))


def search(records: DataFrame, text: str = "", columns: tuple[str, ...] = ("file_name",), mismatch_only: bool = False) -> DataFrame:
    """Records with ``text`` in any of the columns, whatever the case; an empty text filters nothing."""
    out = records.where(F.col("is_mismatch") == 1) if mismatch_only else records
    if not text:
        return out
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.coalesce(c, F.lit(""))).contains(text.lower())
    return out.where(hit)


def search_pages(found: DataFrame, per_page: int = 500) -> DataFrame:
    """``(page, json)``: what a search found as ``{"total": …, "records": […]}``, by path, so many records a page.

    Every page states the total of all; nothing found is one page without records.
    """
    total = found.count()
    if not total:
        return found.sparkSession.createDataFrame([(0, '{"total":0,"records":[]}')], "page bigint, json string")
    rows = numbered(found, [F.asc("file_path")], "_n", 0).withColumn("page", F.floor(F.col("_n") / per_page).cast("bigint"))
    record = F.struct(*found.columns)
    inside = F.transform(F.array_sort(F.collect_list(F.struct("_n", record.alias("r")))), lambda x: x["r"])
    return rows.groupBy("page").agg(inside.alias("records")).select("page", F.to_json(F.struct(F.lit(total).alias("total"), "records")).alias("json"))


def report(records: DataFrame) -> DataFrame:
    """All records, mismatched ones first, then by name."""
    return records.orderBy(F.desc("is_mismatch"), "file_name", "file_path")


def export_rows(records: DataFrame) -> DataFrame:
    """The rows of the CSV report, yes and no in words."""
    yes = lambda c: F.when(F.col(c) == 1, "是").otherwise("否")
    return records.select(
        F.col("file_name").alias("文件名"), F.col("current_ext").alias("当前后缀"), F.col("detected_format").alias("真实格式"), F.col("suggested_ext").alias("建议后缀"),
        yes("is_mismatch").alias("是否不一致"), yes("is_audio").alias("是否音频"), F.col("file_path").alias("路径"), F.col("status").alias("状态"),
    )


PROBE_SCHEMA = "struct<format:struct<format_name:string,duration:string,bit_rate:string,tags:map<string,string>>,streams:array<struct<codec_type:string,codec_name:string,duration:string,bit_rate:string,sample_rate:string,channels:int>>>"


def read_probe(rows: DataFrame, column: str) -> DataFrame:
    """A probe's JSON as columns, by the first audio stream; rows without one (or with bad JSON) have ``probe_ok`` false.

    Numbers of the container come before those of the stream; what is no number is 0; tags are found whatever the
    case of their names, the first of equal names winning.
    """
    p = F.from_json(column, PROBE_SCHEMA)
    stream = F.try_element_at(F.filter(F.col("_p.streams"), lambda s: s["codec_type"] == "audio"), F.lit(1))
    number = lambda c, kind: F.coalesce(F.nullif(c.try_cast(kind), F.lit(0).cast(kind)), F.lit(None))
    tag = lambda name: F.coalesce(F.try_element_at(F.map_values(F.map_filter(F.col("_p.format.tags"), lambda k, v: F.lower(k) == name)), F.lit(1)), F.lit(""))
    out = rows.withColumn("_p", p).withColumn("_s", stream)
    zero = lambda c, kind: F.coalesce(c, F.lit(0).cast(kind))
    return out.withColumns({
        "probe_ok": F.col("_s").isNotNull(),
        "probe_format": F.when(F.col("_s").isNotNull(), format_of_codec(F.coalesce("_s.codec_name", F.lit("")), F.coalesce("_p.format.format_name", F.lit("")))),
        "probe_duration": zero(F.coalesce(number(F.col("_p.format.duration"), "double"), number(F.col("_s.duration"), "double")), "double"),
        "probe_bitrate": zero(F.coalesce(number(F.col("_p.format.bit_rate"), "int"), number(F.col("_s.bit_rate"), "int")), "int"),
        "probe_sample_rate": zero(number(F.col("_s.sample_rate"), "int"), "int"),
        "probe_channels": zero(F.col("_s.channels"), "int"),
        "probe_title": strip(tag("title")), "probe_artist": strip(tag("artist")), "probe_album": strip(tag("album")),
    }).drop("_p", "_s")
