"""Cases stated for the column functions, replayed on small frames."""

import re

import pytest
from pyspark.sql import functions as F

from mediatide.functions.names import group_kind, group_pattern
from mediatide.functions import likeness as K
from mediatide.functions import media as M
from mediatide.functions import text as X
from mediatide.operators import playlists


def each(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_titles(spark):
    assert each(spark, ["七里香 (2024 Remaster HD)", "晴天 - Live现场版", "夜曲【伴奏】", "晴天 - 伴奏", "(Live)", ""], X.clean_title) == ["七里香", "晴天", "夜曲", "晴天 - 伴奏", "(Live)", ""]
    assert each(spark, ["晴天 (Live)", "夜曲 [2005 专辑版]", "稻香（feat. 群星）", "七里香【无损立体声】", "普通歌曲名"], X.clean_song_name) == ["晴天", "夜曲", "稻香", "七里香", "普通歌曲名"]
    assert each(spark, ["周杰伦 / 费玉清", "周杰伦 feat. 五月天", "周杰伦, 阿信", "/x"], X.primary_artist) == ["周杰伦", "周杰伦", "周杰伦", "/x"]


def test_links(spark):
    assert each(spark, ["", "  https://h/a.jpg ", "//host/a.jpg", "https://h/a.jpg?param=300y300"], X.cover_link) == ["", "https://h/a.jpg", "https://host/a.jpg", "https://h/a.jpg"]
    assert each(spark, ["https://music.163.com/playlist?id=24381616", "https://y.qq.com/n/playlist/789101112", "https://qishui.douyin.com/s/x", "https://else"], X.platform) == ["netease", "qq", "qishui", None]
    got = each(spark, ["https://y.qq.com/n/ryqq/playlist/789101112", "https://i.y.qq.com/playlist?id=123456", "https://i.y.qq.com/taoge.html?id=888888", "https://y.qq.com/"], lambda c: X.playlist_id(c, F.lit("qq")))
    assert got == ["789101112", "123456", "888888", None]
    assert each(spark, [" http://nas/music/api/v1/ ", "http://nas//"], X.server_link) == ["http://nas", "http://nas"]


def test_song_lines(spark):
    for style, want in (("song-singer", "晴天 - 周杰伦"), ("singer-song", "周杰伦 - 晴天"), ("song", "晴天")):
        assert each(spark, ["晴天"], lambda c, s=style: X.song_text(c, F.lit("周杰伦"), s)) == [want]
    assert each(spark, ["晴天"], lambda c: X.song_text(c, F.lit(""))) == ["晴天"]


@pytest.mark.parametrize(
    ("header", "kind"),
    [(b"fLaC\0\0\0", "flac"), (b"<!DOCTYPE html><html>", "corrupt_or_text"), (b"\0\0\0\x20ftypM4A ", "m4a"), (b"RIFF\0\0\0\0WAVE", "wav"), (b"OggS" + b"\0" * 24 + b"OpusHead", "opus"),
     (b"OggS" + b"\0" * 40, "ogg"), (b"\xff\xfb\x90\x64", "mp3"), (b"\xff\xf1\x50\x80", "mp3"), (b"MAC ", "ape"), (b"wvpk", "wavpack"), (b"DSD ", "dsf"), (b"abc", None), (b"abcd", None)],
)
def test_headers(spark, header, kind):
    df = spark.createDataFrame([(bytearray(header),)], "h binary")
    assert df.select(M.format_of_header(F.col("h"))).first()[0] == kind


def test_images(spark):
    data = [b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff\xe0", b"RIFF\0\0\0\0WEBP", b"GIF89a", b"<html>", b""]
    df = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], "i int, h binary")
    assert [r[0] for r in df.orderBy("i").select(M.image_of_header(F.col("h"))).collect()] == ["png", "jpg", "webp", "gif", None, None]


def test_scores(spark):
    row = spark.createDataFrame([("flac", 900000, 44100, "t", "", None), ("mp3", 320000, 44100, "t", None, "")], "f string, b int, s int, t string, a string, l string")
    assert [r[0] for r in row.select(M.song_score(*(F.col(c) for c in "fbstal"))).collect()] == [1904910, 324910]


def test_grades(spark):
    rows = [(-999.0, 0.0, 0.0, 0.0, 44100), (-20.0, -999.0, -30.0, -30.0, 44100), (-15.0, -30.0, -40.0, -45.0, 96000), (-20.0, -30.0, -61.0, -60.0, 44100), (-20.0, -30.0, -40.0, -60.0, 44100)]
    df = spark.createDataFrame(rows, "f double, a double, b double, c double, r int")
    got = [r[0] for r in df.select(M.lossless_grade(*(F.col(c) for c in "fabcr"))).collect()]
    assert got == ["unknown", "fake_low_bitrate", "true_hires", "fake_320k", "true_lossless"]


def test_parsing(spark):
    assert each(spark, ["RMS level dB: -12.5\nRMS level dB: -30.25", "RMS level dB: -inf", "nothing"], M.last_level) == [-30.25, -999.0, -999.0]
    assert each(spark, ["  Duration: 00:03:30.50, start", "no"], M.stated_duration) == [210.5, 0.0]
    assert each(spark, [0, 512, 1536, 5 << 20, 3 << 31], M.human_size, "bigint") == ["0 B", "512 B", "1.5 KB", "5 MB", "6 GB"]
    assert each(spark, [None, 0.0, 61.0, 210000.0], M.clock, "double") == ["--:--", "--:--", "1:01", "3:30"]


def test_likeness(spark):
    df = spark.createDataFrame([("晴天 (Live)", "周杰伦 / 蔡依林", "晴天", ["周杰伦"], "flac", 900000)], "s string, a string, t string, n array<string>, f string, b int")
    assert df.select(K.candidate_score(*(F.col(c) for c in "satnfb"))).first()[0] == pytest.approx(0.9725)
    assert each(spark, [""], lambda c: K.title_score(F.lit("abc"), c)) == [pytest.approx(0.80)]
    empty = spark.createDataFrame([([],)], "n array<string>")
    assert empty.select(K.artist_score(F.lit(""), F.col("n")), K.artist_score(F.lit("x"), F.col("n"))).first() == (0.7, 1.0)


def test_json(spark):
    keys = ["trackCount", "count"]
    assert each(spark, ['{"trackCount":"5","count":7}', '{"trackCount":3}', "{}", "bad"], lambda c: playlists.first_number(c, keys)) == [7, 3, 0, 0]
    assert each(spark, ['"若你碰到他"', '{"name":"a","title":"b"}', '{"name":"","title":"b"}', "{}"], playlists.album_name) == ["若你碰到他", "a", "b", ""]
    assert each(spark, ["123456"], lambda c: F.sha2(c, 256)) == ["8d969eef6ecad3c29a3a629280e686cf0c3f5d5a86aff3ca12020c923adc6c92"]


@pytest.mark.parametrize(
    ("short", "kind"),
    [("string quartet", "string quartet"), ("str qt", "string quartet"), ("sq", "string quartet"), ("jz 3o", "jazz trio"), ("brs bnd", "brass band"), ("chmbr ens", "chamber ensemble"), ("sym orch", "symphony orchestra"), ("phil", "philharmonic"), ("wnd qnt", "wind quintet"), ("pan", None), ("big bang", None), ("", None), ("a b", None)],
)
def test_kinds_of_ensembles(short, kind):
    assert group_kind(tuple(short.split())) == kind
    if kind:
        assert re.search(group_pattern(kind), f"garskall {short}")
