"""Column expressions on files: what they are, what they are worth, whether they are what they claim."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
AUDIO_EXTENSIONS = (".mp3", ".m4a", ".aac", ".flac", ".wav", ".ogg", ".opus", ".wma", ".ape", ".alac", ".aif", ".aiff", ".dsf", ".dff", ".mp4", ".m4b", ".wv", ".mpc", ".ac3", ".dts")
LOSSLESS_EXTENSIONS = (".flac", ".ape", ".wav", ".wv", ".aiff", ".aif", ".alac")
VALID_EXTENSIONS = {
    "mp3": (".mp3",), "m4a": (".m4a", ".aac", ".mp4", ".m4b", ".m4p", ".alac"), "flac": (".flac",), "wav": (".wav", ".wave"), "ogg": (".ogg", ".oga"), "opus": (".opus", ".ogg"),
    "wma": (".wma", ".asf"), "ape": (".ape",), "aiff": (".aiff", ".aif", ".aifc"), "wavpack": (".wv",), "musepack": (".mpc", ".mp+"), "dsf": (".dsf",), "dff": (".dff",), "ac3": (".ac3",), "dts": (".dts",),
}
PRIMARY_EXTENSION = {k: (".wv" if k == "wavpack" else ".mpc" if k == "musepack" else "." + k) for k in VALID_EXTENSIONS}
MIME_TYPES = {".mp3": "audio/mpeg", ".m4a": "audio/mp4", ".flac": "audio/flac", ".wav": "audio/wav", ".ogg": "audio/ogg", ".opus": "audio/opus"}
SCORED_LOSSLESS = ("flac", "wav", "ape", "alac", "dsf", "dff", "aiff", "wavpack")
TEXT_STARTS = ("<!doctype html", "<html", "<?xml", "{\n", '{"error', '{"code')
GRADE_TEXTS = {"fake_low_bitrate": "🚫 劣质假无损 (128k-192k 转压)", "fake_320k": "⚠️ 假无损 (疑似 320k MP3 转压)", "true_hires": "🏆 真 Hi-Res 高解析度无损", "true_lossless": "💎 真无损 (CD 音质)", "unknown": "检测失败"}
PLATFORM_NAMES = {"netease": "🔴 网易云音乐", "qq": "🟢 QQ音乐", "qishui": "🥤 汽水音乐"}
HEADER_BYTES = 1024


def lookup(key: Column, table: dict) -> Column:
    """The entry of a small fixed table, null if there is none."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def format_of_header(header: Column) -> Column:
    """The kind of file by its first bytes; null if unknown or shorter than four bytes."""
    h = F.hex(F.substring(header, 1, 36))
    text = F.lower(F.decode(F.substring(header, 1, 64), "ISO-8859-1"))
    at8 = F.substring(h, 17, 8)
    is_text = F.lit(False)
    for start in TEXT_STARTS:
        is_text = is_text | text.startswith(start)
    return F.when(
        F.length(header) >= 4,
        F.when(is_text, "corrupt_or_text")
        .when(h.startswith("664C6143"), "flac")
        .when(h.startswith("52494646") & (at8 == "57415645"), "wav")
        .when(h.startswith("464F524D") & at8.isin("41494646", "41494643"), "aiff")
        .when(h.startswith("4F676753"), F.when(F.substring(h, 57, 16) == "4F70757348656164", "opus").otherwise("ogg"))
        .when(F.substring(h, 9, 8) == "66747970", "m4a")
        .when(h.startswith("494433") | h.rlike("^FF[EF]"), "mp3")
        .when(h.startswith("4D414320"), "ape")
        .when(h.startswith("7776706B"), "wavpack")
        .when(h.startswith("44534420"), "dsf")
        .when(h.startswith("3026B2758E66CF11"), "wma"),
    )


#: Bytes of a cover beyond which it isn't taken.
MOST_COVER_BYTES = 8 << 20


def cover_status(data: Column, size: Column) -> Column:
    """What a cover's first bytes and its size come to: its kind, or ``empty``, ``too_large`` or ``no_image``."""
    return F.when(F.coalesce(size, F.lit(0)) == 0, "empty").when(size > MOST_COVER_BYTES, "too_large").otherwise(F.coalesce(image_of_header(data), F.lit("no_image")))


def image_of_header(data: Column) -> Column:
    """jpg, png, webp or gif; null for anything else, empty data too."""
    h = F.hex(F.substring(data, 1, 12))
    return (
        F.when(h.startswith("FFD8FF"), "jpg")
        .when(h.startswith("89504E47") & (F.length(data) >= 8), "png")
        .when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "webp")
        .when(h.startswith("474946383961") | h.startswith("474946383761"), "gif")
    )


def format_of_codec(codec: Column, container: Column) -> Column:
    """The kind of file by what a probe says, tried in this order; else the codec's own name."""
    c, f = F.lower(codec), F.lower(container)
    return (
        F.when(c.contains("mp3") | f.contains("mp3"), "mp3")
        .when(c.contains("aac") | c.contains("alac") | f.contains("mp4") | f.contains("mov") | f.contains("m4a"), "m4a")
        .when(c.contains("flac"), "flac")
        .when(f.contains("wav") | c.contains("pcm_"), "wav")
        .when(c.contains("opus"), "opus")
        .when(c.contains("vorbis") | f.contains("ogg"), "ogg")
        .when(c.contains("wmav") | f.contains("asf"), "wma")
        .when(c.contains("ape"), "ape")
        .otherwise(c)
    )


def extension_fits(kind: Column, ext: Column) -> Column:
    """Whether an extension is one of those of the kind; false for kinds without any."""
    table = F.create_map(*(x for k, v in VALID_EXTENSIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.coalesce(F.array_contains(F.try_element_at(table, kind), ext), F.lit(False))


def song_score(kind: Column, bitrate: Column, sample_rate: Column, title: Column, artist: Column, album: Column) -> Column:
    """What a copy is worth: lossless first, then rates, then tags. Null counts as missing."""
    has = lambda c, points: F.when(F.coalesce(c != "", F.lit(False)), points).otherwise(0)
    lossless = F.when(F.coalesce(F.lower(kind).isin(*SCORED_LOSSLESS), F.lit(False)), 1_000_000).otherwise(0)
    rates = F.coalesce(bitrate, F.lit(0)).cast("bigint") + (F.coalesce(sample_rate, F.lit(0)) * F.lit(0.1)).cast("bigint")
    return (lossless + rates + has(title, 500) + has(artist, 500) + has(album, 200)).cast("bigint")


def lossless_grade(full: Column, b16: Column, b20: Column, b22: Column, rate: Column) -> Column:
    """The grade of four band energies; a full band of -999 could not be measured."""
    return (
        F.when(full == -999, "unknown")
        .when((b16 < -65.0) | (full - b16 > 42.0), "fake_low_bitrate")
        .when((b20 < -62.0) | (full - b20 > 40.0), "fake_320k")
        .when((rate >= 88200) & (b22 > -55.0) & (full - b22 < 35.0), "true_hires")
        .otherwise("true_lossless")
    )


def cutoff_of_grade(grade: Column, rate: Column) -> Column:
    hires = (rate / 2).cast("int")
    return F.when(grade == "unknown", 0).when(grade == "fake_low_bitrate", 15800).when(grade == "fake_320k", 19800).when(grade == "true_hires", hires).otherwise(22050)


def confidence_of_grade(grade: Column) -> Column:
    return lookup(grade, {"unknown": 0, "fake_low_bitrate": 95, "fake_320k": 88, "true_hires": 98, "true_lossless": 92})


def last_level(text: Column, silence: float = -999.0) -> Column:
    """The last level a measuring tool printed; ``silence`` where there is none or it is no number."""
    all_ = F.regexp_extract_all(text, F.lit(r"RMS level dB:\s+([-\d.]+)"), 1)
    return F.coalesce(F.try_element_at(all_, F.lit(-1)).try_cast("double"), F.lit(silence))


def stated_duration(text: Column) -> Column:
    """Seconds of a ``Duration: h:m:s.fraction`` note; 0 without one."""
    part = lambda k: F.regexp_extract(text, r"Duration:\s+(\d+):(\d+):(\d+)\.(\d+)", k)
    number = lambda k: part(k).try_cast("double")
    return F.coalesce(number(1) * 3600 + number(2) * 60 + number(3) + number(4) / F.pow(F.lit(10.0), F.length(part(4))), F.lit(0.0))


def human_size(n: Column) -> Column:
    """``1.5 MB``: base 1024, at most two decimals, no unit past GB."""
    num = lambda d: F.regexp_replace(F.format_string("%.2f", n / F.lit(float(d))), r"\.?0+$", "")
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, "0 B").when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1 << 20, F.concat(num(1 << 10), F.lit(" KB"))).when(n < 1 << 30, F.concat(num(1 << 20), F.lit(" MB"))).otherwise(F.concat(num(1 << 30), F.lit(" GB")))
    )


def clock(seconds: Column) -> Column:
    """``m:ss``; ``--:--`` where missing; more than 1000 are milliseconds."""
    s = F.when(seconds > 1000, F.floor(seconds / 1000)).otherwise(seconds)
    return F.when(F.coalesce(seconds, F.lit(0.0)) == 0, "--:--").otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad(F.floor(s % 60).cast("string"), 2, "0")))
