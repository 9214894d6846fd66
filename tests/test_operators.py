"""Operators on records: clusters, stores, plans, lists, matching, streams."""

import datetime as dt
import json
import random
import time

import pytest
from pyspark import InheritableThread
from pyspark.sql import functions as F

from mediatide.operators import catalog, dedup, fileplans, formats, matching, playlists, progress, store
from mediatide.operators.ordering import _placed, numbered, ranked
from mediatide.sources.local import HeaderSource, Settings, path_list, scan_folders
from mediatide.sources import pages
from mediatide.sources.probes import extract, sample_hash
from mediatide.streaming.jobs import AlreadyRunning, Jobs

PRINTS = "file_path string, fingerprint string, duration double, format string, bitrate int, sample_rate int, title string, artist string, album string, file_size bigint, is_failed int"


def prints(spark, rows):
    return spark.createDataFrame([(p, f, d, "mp3", 320000, 44100, "t", "a", "l", 100, 0) for p, f, d in rows], PRINTS)


@pytest.mark.parametrize(
    ("durations", "tolerance", "sizes"),
    [([210.0, 212.5], 30, [2]), ([60.0, 240.0], 30, []), ([200.0, 215.0, 230.0], 30, [3]), ([210.0, 0.0], 30, [2]), ([200.0, 230.0], 30, [2]), ([0.0, 60.0, 240.0], 30, [2]), ([5.0, 5.0, 6.0], 0, [2])],
)
def test_clusters(spark, durations, tolerance, sizes):
    df = prints(spark, [(f"/m/{i}.mp3", "fp", d) for i, d in enumerate(durations)])
    assert [r.song_count for r in dedup.groups(df, float(tolerance)).collect()] == sizes


def test_clusters_do_not_depend_on_order(spark):
    rnd = random.Random(3)
    rows = [(f"/m/{i}.mp3", f"fp{i % 5}", rnd.choice([0.0, rnd.random() * 500])) for i in range(200)]
    seen = set()
    for _ in range(2):
        rnd.shuffle(rows)
        got = dedup.clustered(prints(spark, rows)).select("file_path", "fingerprint", "cid").collect()
        seen.add(frozenset(got))
    assert len(seen) == 1


def test_members_and_plan(spark):
    df = prints(spark, [("/m/a.mp3", "x", 10.0), ("/m/b.mp3", "x", 10.0), ("/m/c.mp3", "y", 10.0)]).withColumn("format", F.when(F.col("file_path") == "/m/b.mp3", "flac").otherwise("mp3"))
    m = {r.file_path: (r.rank, r.is_recommended_keep) for r in dedup.members(df).collect()}
    assert m == {"/m/b.mp3": (1, True), "/m/a.mp3": (2, False)}
    plan = dedup.clean_plan(dedup.members(df))
    assert [(r.file_path, r.target) for r in plan.collect()] == [("/m/a.mp3", "/output/_recycle_bin/m/a.mp3")]
    assert [r.success for r in dedup.clean_plan(dedup.members(df), "burn").collect()] == [False]
    assert {r.file_path for r in dedup.survivors(df, plan).collect()} == {"/m/b.mp3", "/m/c.mp3"}
    assert dedup.summary(dedup.groups(df.limit(0), number=False)).first() == (0, 0, 0)


def test_invalid_prints_take_no_part(spark):
    df = prints(spark, [("/a", None, 1.0), ("/b", "", 1.0), ("/c", "x", None), ("/d", "x", 0.0)])
    assert {r.file_path for r in dedup.clustered(df).collect()} == {"/c", "/d"}


def test_store(spark, tmp_path):
    base = spark.createDataFrame([("song.mp3", 1.0, "old")], "file_path string, mtime double, fingerprint string")
    new = spark.createDataFrame([("song.mp3", 2.0, "AQABc90"), ("song.mp3", 1.5, "late"), ("x.mp3", 1.0, "n")], base.schema)
    s = store.ParquetStore(spark, str(tmp_path / "t"))
    assert s.read() is None
    s.upsert(base, ["file_path"], [F.desc("mtime")])
    s.upsert(new, ["file_path"], [F.desc("mtime")])
    assert {r.file_path: r.fingerprint for r in s.read().collect()} == {"song.mp3": "AQABc90", "x.mp3": "n"}
    s.vacuum()
    assert s.read().count() == 2
    s.truncate()
    assert s.read().count() == 0
    assert store.migrate(base, {"cover_url": ""}).first().cover_url == ""
    assert store.delete_keys(base, base.limit(0), ["file_path"]).count() == 1


def test_store_keeps_what_a_broken_write_leaves(spark, tmp_path, monkeypatch):
    base = spark.createDataFrame([(f"k{i}", i) for i in range(200)], "file_path string, n int")
    s = store.ParquetStore(spark, str(tmp_path / "t"), buckets=8)
    s.upsert(base, ["file_path"], [F.desc("n")])
    before = s._current()[1]["parts"]
    one = spark.createDataFrame([("k7", 1000), ("new", 1)], base.schema)
    with monkeypatch.context() as m:
        m.setattr(s, "_announce", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError, match="killed"):
            s.upsert(one, ["file_path"], [F.desc("n")])
    assert s.read().count() == 200
    s.upsert(one, ["file_path"], [F.desc("n")])
    after = s._current()[1]["parts"]
    # only the buckets of the two keys were written again
    assert sum(before[b] != after[b] for b in before) <= 2
    rows = {r.file_path: r.n for r in s.read().collect()}
    assert len(rows) == 201
    assert rows["k7"] == 1000
    # of two writers that began at the same list the second fails
    other = store.ParquetStore(spark, str(tmp_path / "t"), buckets=8)
    number, current = other._current()
    s.upsert(one, ["file_path"], [F.desc("n")])
    with pytest.raises(RuntimeError, match="another writer"):
        other._announce(number + 1, current)
    s.vacuum()
    assert s.read().count() == 201


def test_refresh(spark):
    catalog_ = spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 1), ("c", 1.0, 1), ("d", 1.0, 1)], "file_path string, mtime double, file_size bigint")
    cache = spark.createDataFrame([("a", 1.0, 1, "x", 0), ("b", 1.0, 1, "x", 0), ("c", 1.0, 1, "", 1)], "file_path string, mtime double, file_size bigint, fingerprint string, is_failed int")
    got = lambda **k: {r[0] for r in store.to_compute(catalog_, cache, **k).collect()}
    assert got(mode="missing") == {"c", "d"}
    assert got(mode="missing", detect_changes=True) == {"b", "c", "d"}
    assert got(mode="recompute_all") == {"a", "b", "c", "d"}
    assert {r.file_path for r in store.cache_hits(catalog_, cache).collect()} == {"a"}


def test_plans(spark):
    r = spark.createDataFrame([("/m/x/fake.mp3", ".m4a"), ("/m/y/fake.wav", "m4a")], "file_path string, suggested_ext string")
    assert {p.target for p in fileplans.rename_plan(r).collect()} == {"/m/x/fake.m4a", "/m/y/fake.m4a"}
    flat = fileplans.transfer_plan(r, "/m", "/out", keep_structure=False).collect()
    assert {p.target for p in flat} == {"/out/fake.m4a", "/out/fake_1.m4a"}
    assert {p.target for p in fileplans.recycle_plan(r, "/m", "/out/_recycle_bin").collect()} == {"/out/_recycle_bin/x/fake.mp3", "/out/_recycle_bin/y/fake.wav"}
    assert {p.target for p in fileplans.transfer_plan(r, "/m", "/out", "look").collect()} == {"/m/x/fake.mp3", "/m/y/fake.wav"}


def test_carry_out(spark, tmp_path):
    (tmp_path / "a.mp3").write_bytes(b"x")
    plan = spark.createDataFrame([(str(tmp_path / "a.mp3"), str(tmp_path / "bin/a.mp3")), (str(tmp_path / "no"), str(tmp_path / "b"))], "file_path string, target string")
    done = {r.file_path: r.success for r in fileplans.carry_out(plan, "move").collect()}
    assert list(done.values()).count(True) == 1
    assert (tmp_path / "bin/a.mp3").exists()


def test_carry_out_overwrites_nothing(spark, tmp_path):
    for name, text in (("a", b"new"), ("b", b"old"), ("c", b"same"), ("d", b"same")):
        (tmp_path / name).write_bytes(text)
    plan = spark.createDataFrame([(str(tmp_path / "a"), str(tmp_path / "b")), (str(tmp_path / "c"), str(tmp_path / "d"))], "file_path string, target string")
    done = {r.file_path[-1]: r.success for r in fileplans.carry_out(plan, "copy").collect()}
    assert done == {"a": False, "c": True}
    assert (tmp_path / "b").read_bytes() == b"old"
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "b", "c", "d"]
    assert [r.success for r in fileplans.carry_out(plan.where(F.col("target").endswith("d")), "move").collect()] == [True]
    assert not (tmp_path / "c").exists()
    assert fileplans.carry_out(plan.limit(0), "copy").count() == 0


def test_targets_are_unique_whatever_is_wanted(spark):
    rnd = random.Random(7)
    stems = ["a", "a_1", "a_2", "a_1_1", "a_01", "a_3", "b", "b_", "_1", ""]
    for k in range(4):
        plan = [(f"/m/{i:04d}", f"/out/{rnd.choice(stems)}{rnd.choice(['.mp3', '.mp3', '', '.'])}", "x") for i in range(60 * k)]
        there = [(f"/out/{rnd.choice(stems)}.mp3",) for _ in range(5)] + [("/out/a_5.mp3",), ("/out/a_5.mp3",), (None,)]
        got = fileplans.apart(spark.createDataFrame(plan, "file_path string, target string, msg string"), spark.createDataFrame(there, "file_path string")).collect()
        targets = [r.target for r in got]
        assert len(set(targets)) == len(targets) == len(plan)
        assert not set(targets) & {t for (t,) in there}
        # a name is only changed where it must be, and to the lowest numbers that are free
        wanted = {t for _, t, _ in plan}
        assert wanted - {t for (t,) in there} <= set(targets)
        for r in got:
            want = dict((p, t) for p, t, _ in plan)[r.file_path]
            if r.target != want:
                dot = want.rfind(".") if "." in want else len(want)
                number = int(r.target[dot + 1 : len(r.target) - len(want) + dot])
                names = {f"{want[:dot]}_{j}{want[dot:]}" for j in range(1, number)}
                assert names <= set(targets) | {t for (t,) in there}


def test_three_files_and_a_numbered_one(spark):
    r = spark.createDataFrame([("/m/x/a.mp3", ""), ("/m/y/a.mp3", ""), ("/m/z/a_1.mp3", "")], "file_path string, suggested_ext string")
    assert sorted(p.target for p in fileplans.transfer_plan(r, "/m", "/out", keep_structure=False).collect()) == ["/out/a.mp3", "/out/a_1.mp3", "/out/a_2.mp3"]


def test_ranked_with_a_hot_key(spark):
    """Half of the rows have one key and one score: numbered right, and in many tasks."""
    n = 40_000
    # as little as this would be put together into one task
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.range(n).select(F.when(F.col("id") % 2 == 0, F.lit("hot")).when(F.col("id") % 7 == 1, F.lit(None)).otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("key"), F.concat(F.lit("/p"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("path"))
    got = ranked(df, ["key"], [F.asc("path")], "n").toPandas()
    got["key"] = got.key.fillna("null")
    want = got.sort_values("path").groupby("key").cumcount().sort_index() + 1
    assert (got.n == want).all()
    assert len(got) == n
    tasks = _placed(df, [F.col("key"), F.asc("path")]).groupBy("_part").count().toPandas()["count"]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) >= 3
    assert tasks.max() <= 3 * tasks.median()


def test_members_of_a_hot_fingerprint(spark):
    prints = spark.range(4000).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("f"), (F.col("id") % 300).cast("string"))).alias("fingerprint"), F.lit(100.0).alias("duration"), F.concat(F.lit("/m/"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("file_path"),
        F.lit(10).alias("file_size"), F.lit("mp3").alias("format"), F.lit(320000).alias("bitrate"), F.lit(44100).alias("sample_rate"), F.lit("t").alias("title"), F.lit("a").alias("artist"), F.lit("b").alias("album"), F.lit(0).alias("is_failed"),
    )
    m = dedup.members(prints).toPandas()
    assert len(m) == 4000
    assert (m["rank"] == m.sort_values("file_path").groupby("fingerprint").cumcount().sort_index() + 1).all()
    assert m.is_recommended_keep.sum() == m.fingerprint.nunique()


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = [(r.k, r.n) for r in numbered(df, [F.asc("k")], "n").collect()]
    assert sorted(got) == [(k, k + 1) for k in range(1000)]


def test_catalog(spark):
    files = spark.createDataFrame([("/a/x.MP3", 10), ("/a/b/y.flac", 5), ("/a/b/n.txt", 1), (None, 3), ("/a/x.MP3", 10)], "file_path string, file_size bigint")
    assert {r.ext for r in catalog.scan(files, ["/a"], "/a/b").collect()} == {".mp3"}
    stats = {r.root: (r.exists, r.total_files, r.total_size, r.format_counts) for r in catalog.directory_stats(files, ["/a", "/a/b", "/z"]).collect()}
    assert stats == {"/a": (True, 3, 25, {".flac": 1, ".mp3": 2}), "/a/b": (True, 1, 5, {".flac": 1}), "/z": (False, 0, 0, {})}
    assert catalog.combined_stats(files, ["/a", "/a/b"]).first().total_files == 4


def test_formats(spark):
    files = spark.createDataFrame([("/a/x.flac", bytearray(b"fLaC0000")), ("/a/y.mp3", bytearray(b"fLaC0000")), ("/a/z.mp3", None), ("/a/w.mp3", bytearray(b"<html>")), ("/a/u.mp3", bytearray(b"1234"))], "file_path string, header binary")
    got = {r.file_name: (r.detected_format, r.suggested_ext, r.is_mismatch, r.is_audio) for r in formats.check(files).collect()}
    assert got == {"x.flac": ("flac", ".flac", 0, 1), "y.mp3": ("flac", ".flac", 1, 1), "z.mp3": ("error", ".mp3", 1, 0), "w.mp3": ("corrupt_or_text", ".txt", 1, 0), "u.mp3": ("unknown", ".mp3", 1, 0)}
    assert formats.search(formats.check(files), "_%", ("file_name",)).count() == 0


def test_songs_found(spark):
    songs = spark.createDataFrame([(1, "红色高跟鞋", "蔡健雅"), (2, "不存在的歌曲", "某人"), (3, None, None), (4, "红色高跟鞋 (Live)", "蔡健雅")], "song_key bigint, song_name string, artist string")
    tracks = spark.createDataFrame([("guid-red-shoes", "红色高跟鞋", ["蔡健雅"], "flac", 900000), ("", "红色高跟鞋", ["x"], "mp3", 1), ("g2", None, None, None, None)], "guid string, title string, names array<string>, format string, bitrate int")
    got = {r.song_key: (r.matched, r.track_guid) for r in matching.match_songs(songs, tracks).collect()}
    assert got == {1: (True, "guid-red-shoes"), 2: (False, ""), 3: (False, ""), 4: (True, "guid-red-shoes")}


@pytest.mark.parametrize(("title", "asked"), [("ΝΎΧΤΑ ΚΑΙ ΦΩΣ", "Νύχτα και Φωσ (Remastered 2019)"), ("Kayıp İZ", "kayıp iz (Live)")])
def test_a_capital_is_read_alike_wherever_it_stands(spark, title, asked):
    """A sigma at a word's end, and a dotted capital, become the one letter that is asked for."""
    songs = spark.createDataFrame([(1, asked, "Anna")], "song_key bigint, song_name string, artist string")
    tracks = spark.createDataFrame([("a", title, ["Anna"], "mp3", 0), ("b", "Anna", ["Anna"], "mp3", 0)], "guid string, title string, names array<string>, format string, bitrate int")
    matches = matching.match_songs(songs, tracks).withColumn("history_id", F.lit(7))
    assert [tuple(r) for r in matching.matched_lists(matches, "history_id", "song_key").collect()] == [(7, 0, "a")]


def test_lines_leave_out_what_is_found_by_other_capitals(spark):
    songs = spark.createDataFrame([(1, "Φωσ", "Anna"), (2, "Blue", "Bert")], "song_key bigint, song_name string, artist string")
    tracks = spark.createDataFrame([("a", "ΦΩΣ", ["Anna"], "mp3", 0)], "guid string, title string, names array<string>, format string, bitrate int")
    matches = matching.match_songs(songs, tracks).withColumn("history_id", F.lit(7))
    assert [tuple(r) for r in matching.unmatched_lines(matches, "history_id", "song_key").collect()] == [(7, 1, "1. Blue - Bert")]


def test_search_equals_brute_force(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 9)))
    titles = [(f"g{i:03d}", word()) for i in range(80)]
    queries = [(i, word()[: rnd.randint(0, 5)]) for i in range(60)]
    got = matching.search(spark.createDataFrame(queries, "song_key bigint, query string").withColumn("stage", F.lit(1)), matching.title_index(spark.createDataFrame(titles, "guid string, title string")), {1: 5})
    want = {(k, g) for k, q in queries if q for g in sorted(g for g, t in titles if q in t)[:5]}
    assert {(r.song_key, r.guid) for r in got.collect()} == want


def test_history(spark):
    h = spark.createDataFrame([(1, '[{"index":1,"song_name":"a","artist":"b","full_text":"a - b"}]'), (2, "[{broken"), (3, None), (4, "")], "id bigint, songs_json string")
    h = h.withColumns({c: F.lit(None).cast("string") for c in ("platform", "title", "cover_url")})
    got = {r.id: (r.parsed_count, r.raw_text, r.cover_url) for r in playlists.history_detail(h).collect()}
    assert got == {1: (1, "a - b", ""), 2: (0, "", ""), 3: (0, "", ""), 4: (0, "", "")}


def test_roots(spark, tmp_path):
    assert path_list("/vol1/music,/vol2/backup;/vol3/flac") == ["/vol1/music", "/vol2/backup", "/vol3/flac"]
    assert path_list("  ") == []
    assert Settings.from_environment({"MUSIC_DIRS": "/a;/b", "MUSIC_DIR": "/b,/c"}).roots == ["/a", "/b", "/c"]
    assert Settings().asked("__ALL__") == ["/music"]
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.flac").write_bytes(b"fLaC" + b"0" * 5000)
    (tmp_path / "d/b.txt").write_bytes(b"x")
    got = scan_folders(spark, [str(tmp_path), str(tmp_path / "none")]).collect()
    assert [(r.file_path, r.file_size) for r in got] == [(str(tmp_path / "d/a.flac"), 5004)]
    assert scan_folders(spark, [str(tmp_path / "none")]).count() == 0
    spark.dataSource.register(HeaderSource)
    heads = {r.file_path.rsplit("/", 1)[1]: len(r.header) for r in spark.read.format("file_headers").load(str(tmp_path)).collect()}
    assert heads == {"a.flac": 1024, "b.txt": 1}


def _shared_page(title, author, songs):
    rows = "".join(f"<div><div><img></div><div><div><p>{n}</p></div><div><p>{a}</p></div></div></div>" for n, a in songs)
    head = f"<div><div>1</div><div>2</div><div><h1><p>{title}</p></h1><div><div><div>x</div><div><p>{author}</p></div></div></div></div></div>"
    return f'<html><body><div id="root"><div><div><div><div>{head}<div><div><div><div>{rows}</div></div></div></div></div></div></div></div></div></body></html>'


def test_shared_pages(spark):
    rows = [(1, _shared_page("Mine", "Ann", [("A &amp; B", "X • Album"), (" ", "Y"), ("C", "")])), (1, None), (2, "<h1>Bare</h1>"), (3, _shared_page("", "", [("D", "Z")])), (4, "<div><p>broken")]
    got = pages.page_songs(spark.createDataFrame(rows, "id bigint, html string"), "id", "html").collect()
    assert [tuple(r) for r in got] == [(1, "Mine - Ann", 1, "A & B", "X"), (1, "Mine - Ann", 2, "C", ""), (3, pages.UNTITLED, 1, "D", "Z")]
    assert pages.read_page("<h1>Bare</h1>") == ("Bare", [])
    assert pages.page_songs(spark.createDataFrame([], "id bigint, html string"), "id", "html").count() == 0


def test_paged_answers(spark):
    def page(names, title="", n=0):
        return json.dumps({"code": 0, "req_0": {"code": 0, "data": {"dirinfo": {"title": title, "songnum": n, "picurl": "//c/x.jpg"}, "songlist": [{"name": x, "singer": [{"name": "s"}, {"name": "t"}]} for x in names]}}})

    answers = [
        (7, 0, "android", page(["b"], "List", 61)), (7, 0, "-1", "x" * 108), (7, 0, "windows", page(["no"], "No", 1)), (7, 1, "-1", "broken but long enough to count as an answer, or so it seems"), (7, 2, "h5", page(["c"])), (7, 3, "-1", page(["beyond"])),
        (8, 0, "-1", "x" * 50), (8, 1, "-1", page(["no first page"])), (9, 0, "-1", page(["a", "b"])), (9, 0, "other", page(["z"])), (9, 0, "iphone", None),
    ]
    df = pages.first_usable(spark.createDataFrame(answers, "id bigint, page int, client string, body string"), "id", "page", "client", "body")
    songs = sorted((r.id, r["index"], r.song_name, r.artist) for r in pages.paged_songs(df, "body", "id", "page").collect())
    assert songs == [(7, 1, "b", "s / t"), (7, 2, "c", "s / t"), (9, 1, "a", "s / t"), (9, 2, "b", "s / t")]
    heads = {r.id: (r.title, r.cover, r.total) for r in pages.paged_lists(df, "body", "id", "page").collect()}
    assert heads == {7: ("List", "https://c/x.jpg", 61), 9: ("QQ音乐歌单_9", "https://c/x.jpg", 2)}


def test_extractors(spark):
    def fake(path):
        if path == "bad":
            raise OSError("no")
        return {"n": len(path)}

    got = {r.file_path: (r.n, r.is_failed) for r in extract(spark.createDataFrame([("abc",), ("bad",)], "file_path string"), fake, "n int", 2).collect()}
    assert got["abc"] == (3, 0)
    assert got["bad"][1] == 1
    with pytest.raises(ValueError, match="little"):
        sample_hash(b"x")


def test_probe_json(spark):
    j = '{"format":{"format_name":"mov,mp4","duration":"N/A","bit_rate":"320000","tags":{"TITLE":" T ","artist":"A"}},"streams":[{"codec_type":"video"},{"codec_type":"audio","codec_name":"alac","duration":"12.5","channels":2}]}'
    got = formats.read_probe(spark.createDataFrame([(1, j), (2, "broken"), (3, None)], "i int, j string"), "j").orderBy("i").collect()
    assert (got[0].probe_format, got[0].probe_duration, got[0].probe_bitrate, got[0].probe_title) == ("m4a", 12.5, 320000, "T")
    assert [r.probe_ok for r in got] == [True, False, False]


def test_streams(spark, tmp_path):
    from mediatide.streaming.ingest import files_as_they_come, live_counters, merge_into

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.mp3").write_bytes(b"1")
    s = store.ParquetStore(spark, str(tmp_path / "store"))
    files = files_as_they_come(spark, str(src)).select(F.col("path").alias("file_path"), F.col("length").alias("file_size"))
    for more in ("b.mp3", "c.mp3"):
        merge_into(files, s, ["file_path"], [F.desc("file_size")], str(tmp_path / "ck")).awaitTermination()
        (src / more).write_bytes(b"22")
    assert s.read().count() == 2
    rows = [(1, dt.datetime(2024, 1, 1, 0, m), o) for m, o in enumerate(["ok", "failed", "mismatched", "ok"])]
    e = spark.createDataFrame(rows, "job int, ts timestamp, outcome string")
    e.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "ev"))
    q = live_counters(stream, ["job"], "live_jobs")
    q.processAllAvailable()
    q.stop()
    assert spark.table("live_jobs").collect() == progress.counters(e, ["job"]).collect()
    assert progress.counters(e, ["job"]).first().percent == 75


def test_one_run_of_a_kind(spark):
    jobs = Jobs(spark.sparkContext)
    with jobs.only("scan"):
        assert jobs.running() == ["scan"]
        with pytest.raises(AlreadyRunning), jobs.only("scan"):
            pass
        with jobs.only("grade"):
            assert spark.range(10).count() == 10
    assert jobs.running() == []
    assert not jobs.cancel("scan")


def test_cancelled_run(spark):
    jobs, state = Jobs(spark.sparkContext), {}

    def work():
        with jobs.only("scan"):
            state["began"] = True
            try:
                spark.range(8, numPartitions=8).select(F.expr("java_method('java.lang.Thread', 'sleep', 20000L)")).collect()
            except Exception as e:  # noqa: BLE001 - what a cancelled job raises is Spark's matter
                state["error"] = e

    t = InheritableThread(target=work)
    t.start()
    while not spark.sparkContext.statusTracker().getActiveJobsIds():
        time.sleep(0.05)
    assert jobs.cancel("scan")
    t.join(15)
    assert "error" in state
    assert jobs.running() == []
    with jobs.only("scan"):
        assert spark.range(3).count() == 3


def test_pages_of_a_search_and_of_groups(spark):
    df = spark.createDataFrame([(f"/m/{k:03d}", k) for k in range(25)], "file_path string, n int")
    got = {r.page: json.loads(r.json) for r in formats.search_pages(df, 10).collect()}
    assert {p: (j["total"], len(j["records"])) for p, j in got.items()} == {0: (25, 10), 1: (25, 10), 2: (25, 5)}
    assert [r["n"] for p in range(3) for r in got[p]["records"]] == list(range(25))
    assert json.loads(formats.search_pages(df.limit(0)).first().json) == {"total": 0, "records": []}
    g = dedup.group_songs(prints(spark, [(f"/m/{k}", "f", 100.0) for k in range(7)]), per_page=3).orderBy("page").collect()
    assert [[s.rank for s in r.songs] for r in g] == [[1, 2, 3], [4, 5, 6], [7]]
