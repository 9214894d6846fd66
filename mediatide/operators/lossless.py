"""Whether files that claim to be lossless are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.media import GRADE_TEXTS, confidence_of_grade, cutoff_of_grade, lookup, lossless_grade

FAKE, TRUE = ("fake_low_bitrate", "fake_320k"), ("true_lossless", "true_hires")


def grade(bands: DataFrame) -> DataFrame:
    """``bands`` (full_db, b16, b20, b22, sample_rate) with grade, text, cutoff, high-frequency loss and confidence.

    A missing or zero sample rate reads as 44100; null energies are -999, that is, not measured.
    """
    e = {c: F.coalesce(c, F.lit(-999.0)) for c in ("full_db", "b16", "b20", "b22")}
    b = bands.withColumns(e | {"sample_rate": F.when(F.coalesce("sample_rate", F.lit(0)) == 0, 44100).otherwise(F.col("sample_rate"))})
    b = b.withColumn("grade", lossless_grade(*(F.col(c) for c in ("full_db", "b16", "b20", "b22", "sample_rate"))))
    unknown = F.col("grade") == "unknown"
    return b.withColumns({
        "grade_text": lookup(F.col("grade"), GRADE_TEXTS), "cutoff_freq_hz": cutoff_of_grade(F.col("grade"), F.col("sample_rate")),
        "high_freq_energy": F.when(unknown, F.lit(0.0)).otherwise(F.col("full_db") - F.col("b20")), "confidence": confidence_of_grade(F.col("grade")),
        "details": F.when(unknown, "无法解码音频样本进行频谱分析").when(F.col("grade") == "fake_low_bitrate", F.format_string("16kHz 以上几乎无有效高频能量 (衰减 %.1fdB)，符合 128k~192k MP3 频谱硬截断特征", F.col("full_db") - F.col("b16")))
        .when(F.col("grade") == "fake_320k", F.format_string("20kHz 处存在陡峭频响截断 (20kHz 以上衰减 %.1fdB)，符合 320kbps MP3 典型截断线", F.col("full_db") - F.col("b20")))
        .when(F.col("grade") == "true_hires", F.format_string("采样率 %dHz，高频自然延伸超越 24kHz (22kHz 能量正常)，属真高解析母带", F.col("sample_rate")))
        .otherwise(F.format_string("20kHz~22kHz 频段泛音丰富连贯 (衰减 %.1fdB)，符合标准 CD 无损声学特征", F.col("full_db") - F.col("b20"))),
    })


def counters(graded: DataFrame) -> DataFrame:
    return graded.agg(F.count("*").alias("total"), F.count_if(F.col("grade").isin(*TRUE)).alias("true_count"), F.count_if(F.col("grade").isin(*FAKE)).alias("fake_count"), F.count_if(F.col("grade") == "unknown").alias("failed_count"))


def records(graded: DataFrame, only: str = "all") -> DataFrame:
    """``fake_only``, ``true_only`` or all; a file that could not be graded belongs to neither."""
    kinds = {"fake_only": FAKE, "true_only": TRUE}.get(only)
    return (graded.where(F.col("grade").isin(*kinds)) if kinds else graded).orderBy("grade", "file_name")
