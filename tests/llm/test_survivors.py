import datetime as dt

from pyspark.sql import functions as F

from mediatide.llm.survivors import build_survivors, found, meant_bitrate, meant_format, meant_rate

SCHEMA = "dup_id bigint, group_id string, file_path string, file_size bigint, duration double, format string, bitrate int, sample_rate int, channels int, title string, artist string, album string, is_recommended_keep boolean, score int, checked_at timestamp_ntz, _rank int"
T = [dt.datetime(2024, 1, d) for d in range(1, 10)]


def row(i, group, fmt, bits, rate, title="t", artist="a", album="l", at=0):
    return (i, group, f"/m/{i}", 100, 10.0, fmt, bits, rate, 2, title, artist, album, True, 9_999_999, T[at] if at is not None else None, 1)


def test_meanings(spark):
    df = spark.createDataFrame([(" Flac", 320, 44), ("audio/mpeg", 320000, 96000), ("Monkey's Audio", -1, 2822400), (".WAV", 2147483647, 0), (None, None, None), ("xyz", 1411, 88)], "f string, b int, r int")
    got = df.select(meant_format(F.col("f")), meant_bitrate(F.col("b")), meant_rate(F.col("r"))).collect()
    assert [tuple(r) for r in got] == [("flac", 320000, 44100), ("mp3", 320000, 96000), ("ape", None, 2822400), ("wav", None, None), (None, None, None), ("xyz", 1411000, 88200)]


def test_best(spark):
    rows = [
        row(1, "g", "mp3", 320, 44), row(2, "g", ".flac", 0, None, None, None, None), row(3, "g", "FLAC", 900, 44100, "", "", ""), row(4, "h", "mp3", 320000, 44100, at=1), row(5, "h", "MP3", 320, 44, at=2), row(6, "h", "mp3", 320, 44, at=2),
        row(7, None, None, None, None), row(8, None, "ogg", 1, 1), row(9, "n", None, None, None, None, None, None, None), row(9, "n", None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r.group_id or "", r.dup_id) for r in found(df).collect()) == [("", 7), ("", 8), ("g", 3), ("h", 5), ("n", 9)]
    assert found(df.limit(0)).count() == 0
    built = {r.dup_id: r for r in build_survivors(df).collect()}
    assert (built[3].title, built[3].bitrate, built[3].n_copies, built[3].from_rows) == ("t", 900000, 3, 2)
    assert built[9].title is None
    assert built[9].n_copies == 2
    assert build_survivors(df.limit(0)).count() == 0


def test_a_hot_group_is_cut_before_the_shuffle(spark):
    df = spark.range(20_000).select(F.col("id").alias("dup_id"), (F.col("id") % 1).cast("string").alias("group_id"), F.lit("/p").alias("file_path"), F.lit("mp3").alias("format"), (F.col("id") % 400).cast("int").alias("bitrate"), F.lit(44).alias("sample_rate"), F.lit("t").alias("title"), F.lit("a").alias("artist"), F.lit("b").alias("album"), F.lit(None).cast("timestamp_ntz").alias("checked_at"))
    assert found(df).first().dup_id == 399
    assert "WindowGroupLimit" in found(df)._jdf.queryExecution().executedPlan().toString()
