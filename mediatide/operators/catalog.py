"""The file catalogue: what is scanned, and what it adds up to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.media import AUDIO_EXTENSIONS, LOSSLESS_EXTENSIONS
from ..functions.text import base_name, extension


def scan(files: DataFrame, roots: list[str] | None = None, leave_out: str | None = None) -> DataFrame:
    """``(file_path, file_name, ext)`` of the audio files below ``roots``, each path once.

    Paths below ``leave_out`` are skipped; null paths are not files. A root that is missing gives nothing.
    """
    f = files.select("file_path").where(F.col("file_path").isNotNull())
    if roots is not None:
        inside = F.lit(False)
        for root in roots:
            inside = inside | F.col("file_path").startswith(root.rstrip("/") + "/")
        f = f.where(inside)
    if leave_out:
        f = f.where(~F.col("file_path").startswith(leave_out.rstrip("/") + "/"))
    f = f.withColumns({"file_name": base_name(F.col("file_path")), "ext": extension(F.col("file_path"))})
    return f.where(F.col("ext").isin(*AUDIO_EXTENSIONS)).dropDuplicates(["file_path"])


def lossless_candidates(files: DataFrame) -> DataFrame:
    return scan(files).where(F.col("ext").isin(*LOSSLESS_EXTENSIONS))


def _per_root(files: DataFrame, roots: list[str]) -> DataFrame:
    """Each file once per root above it: overlapping roots count it more than once."""
    list_ = F.filter(F.array(*map(F.lit, roots)), lambda r: F.col("file_path").startswith(F.concat(r, F.lit("/"))))
    sized = files.where(F.col("file_path").isNotNull()).withColumn("ext", extension(F.col("file_path"))).where(F.col("ext").isin(*AUDIO_EXTENSIONS))
    return sized.select(F.explode(list_).alias("root"), "ext", "file_size")


def _histogram(counts: DataFrame, by: list[str]) -> DataFrame:
    """Per key: files, bytes and a map extension to count, from one row per key and extension."""
    pairs = F.array_sort(F.collect_list(F.struct("ext", "n")))
    return counts.groupBy(*by).agg(F.sum("n").alias("total_files"), F.sum("size").alias("total_size"), F.map_from_entries(pairs).alias("format_counts"))


def directory_stats(files: DataFrame, roots: list[str]) -> DataFrame:
    """``(root, exists, total_files, total_size, format_counts)`` of each root; a root without files has zeros."""
    spark = files.sparkSession
    counts = _per_root(files, roots).groupBy("root", "ext").agg(F.count("*").alias("n"), F.sum("file_size").alias("size"))
    stats = _histogram(counts, ["root"])
    asked = spark.createDataFrame([(r,) for r in roots], "root string")
    return asked.join(stats, "root", "left").select(
        "root", F.col("total_files").isNotNull().alias("exists"), F.coalesce("total_files", F.lit(0)).alias("total_files"), F.coalesce("total_size", F.lit(0)).alias("total_size"),
        F.coalesce("format_counts", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))).alias("format_counts"),
    )


def combined_stats(files: DataFrame, roots: list[str]) -> DataFrame:
    """One row over all roots: sums and a merged histogram. A file below two roots counts twice, as the roots do."""
    counts = _per_root(files, roots).groupBy("ext").agg(F.count("*").alias("n"), F.sum("file_size").alias("size"))
    return _histogram(counts, []).withColumn("root", F.lit(", ".join(roots))).select("root", "total_files", "total_size", "format_counts")


def top_extensions(files: DataFrame, k: int = 4) -> DataFrame:
    """The ``k`` most frequent extensions; equal counts go by name."""
    return scan(files).groupBy("ext").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ext").limit(k)


def histogram_text(c: str):
    """A histogram as ``ext:count`` parts, sorted, for reports and comparisons."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
