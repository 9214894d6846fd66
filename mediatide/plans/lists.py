"""Queries on song lists, matching and job progress, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import likeness as K
from ..functions import text as X
from ..functions.media import PLATFORM_NAMES, lookup
from ..operators import catalog, formats, matching, playlists, progress, store
from ..sources import pages
from ..session import shuffled, table
from ..streaming.ingest import run_to_end, table_stream

RUN_TS = 1_735_689_600
_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_NOISE = "(?i)\\s*(-|_|\\s)\\s*(live|remix|instrumental|cover|remaster|remastered|explicit|clean|伴奏|现场版|重制版|原声版|高保真|无损版)\\b.*$"


def _clean_sql(c: str) -> str:
    t = _TRIM.format(c)
    inner = f"regexp_replace({t}, '\\s*[\\(\\[（【<][^\\)\\]）】>]*[\\)\\]）】>]\\s*', ' ', 'g')"
    inner = f"regexp_replace({inner}, '{_NOISE}', '', 'g')"
    inner = _TRIM.format(f"regexp_replace({inner}, '\\s+', ' ', 'g')")
    return f"CASE WHEN {inner} = '' THEN {t} ELSE {inner} END"


def _name_sql(c: str) -> str:
    inner = _TRIM.format(f"regexp_replace({c}, '[([（【].*?[)\\]）】]', '', 'g')")
    return f"CASE WHEN {inner} = '' THEN {_TRIM.format(c)} ELSE {inner} END"


def _first_sql(c: str) -> str:
    inner = _TRIM.format(f"regexp_split_to_array({c}, '[/,&、+，]|(?i:\\s+feat\\.?\\s+|\\s+ft\\.?\\s+|\\s+vs\\.?\\s+)')[1]")
    return f"CASE WHEN {inner} = '' THEN {_TRIM.format(c)} ELSE {inner} END"


def _ascii(c):
    """Blanks of all kinds as one ordinary blank: engines differ in what else counts as a blank."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\S ]|[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]", " ")


_ASCII_SQL = "regexp_replace(coalesce({}, ''), '[\\t\\n\\f\\r\\x0B\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]', ' ', 'g')"
NAME, ARTIST = _ASCII_SQL.format("song_name"), _ASCII_SQL.format("artist")


def _songs(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "songs")
    return s.withColumns({"song_name": _ascii(F.col("song_name")), "artist": _ascii(F.col("artist"))})


SONGS_SQL = f"SELECT song_id, history_id, song_index, {NAME} AS song_name, {ARTIST} AS artist FROM songs"


def clean_title(spark, sf):
    return _songs(spark, sf).select("song_id", X.clean_title(F.col("song_name")).alias("cleaned"))


def clean_song_name(spark, sf):
    return _songs(spark, sf).select("song_id", X.clean_song_name(F.col("song_name")).alias("cleaned"))


def primary_artist(spark, sf):
    return _songs(spark, sf).select("song_id", X.primary_artist(F.col("artist")).alias("first"))


def normalize_cover_url(spark, sf):
    h = table(spark, sf, "playlist_history")
    u = F.coalesce("cover_url", F.lit(""))
    marked = F.when(F.col("id") % 3 == 0, F.concat(F.lit("  "), F.regexp_replace(u, "^https?:", ""), F.lit("?param=300y300"))).otherwise(u)
    return h.select("id", X.cover_link(marked).alias("cover"))


def normalize_server_url(spark, sf):
    h = table(spark, sf, "playlist_history")
    u = F.concat(F.lit(" http://nas"), F.col("library_id").cast("string"), F.when(F.col("id") % 2 == 0, "/music/api/v1//").otherwise("///"))
    return h.select("id", X.server_link(u).alias("server"))


def platform_classify(spark, sf):
    h = table(spark, sf, "playlist_history")
    return h.select("id", F.coalesce(X.platform(F.col("source_url")), F.lit("unknown")).alias("found"), X.is_short_link(F.col("source_url")).alias("short"))


PLATFORM_SQL = "CASE WHEN regexp_matches(source_url, '(163cn)|(\\.163\\.)') THEN 'netease' WHEN regexp_matches(source_url, '(\\.qq\\.)') THEN 'qq' WHEN regexp_matches(source_url, '(qishui)|(douyin)') THEN 'qishui' END"


def playlist_id_extract(spark, sf):
    h = table(spark, sf, "playlist_history")
    return h.select("id", F.coalesce(X.playlist_id(F.col("source_url"), X.platform(F.col("source_url"))), F.lit("")).alias("list_id"))


def share_links(spark, sf):
    h = table(spark, sf, "playlist_history")
    url = F.coalesce("source_url", F.lit(""))
    return h.select("id", X.share_link(F.concat(F.lit("听听这个 "), url, F.lit(" 复制打开"))).alias("link"))


def platform_names(spark, sf):
    h = table(spark, sf, "playlist_history")
    code = F.coalesce(X.platform(F.col("source_url")), F.col("platform"))
    return h.select("id", F.coalesce(lookup(code, PLATFORM_NAMES), code).alias("shown"))


def url_codec(spark, sf):
    s = _songs(spark, sf)
    return s.select("song_id", F.url_decode(F.url_encode("song_name")).alias("back"), F.length(F.url_encode(F.regexp_replace("song_name", "[^A-Za-z0-9 ]", ""))).alias("n"))


def _style(style):
    def run(spark, sf):
        return playlists.shaped(_songs(spark, sf), style).select("song_id", "line")

    return run


def _style_sql(style):
    line = {"song-singer": "song_name || ' - ' || artist", "singer-song": "artist || ' - ' || song_name", "song": "song_name"}[style]
    return f"SELECT song_id, CASE WHEN artist = '' THEN song_name ELSE {line} END AS line FROM ({SONGS_SQL})"


def undetailed_songs(spark, sf):
    return playlists.shaped(_songs(spark, sf), "song-singer", detailed=False).select("song_id", "line")


def reverse_playlist(spark, sf):
    return playlists.reversed_songs(_songs(spark, sf), "history_id", "song_index").select("song_id", "history_id", "new_index")


def playlist_csv_rows(spark, sf):
    r = playlists.export_lines(_songs(spark, sf), "history_id", "song_index")
    return r.select("history_id", F.col("no").alias("序号"), F.col("line").alias("歌曲信息"))


def playlist_text_export(spark, sf):
    return playlists.export_text(_songs(spark, sf), "history_id", "song_index")


def export_names(spark, sf):
    h = table(spark, sf, "playlist_history")
    t = F.when(F.coalesce("title", F.lit("")) == "", "playlist").otherwise(F.col("title"))
    return h.select("id", F.concat(F.regexp_replace(t, r"[/\\]", "_"), F.lit(".txt")).alias("file_name"))


def history_recent(spark, sf):
    return playlists.history_recent(table(spark, sf, "playlist_history"))


def history_detail(spark, sf):
    d = playlists.history_detail(table(spark, sf, "playlist_history"))
    return d.select("id", "title", "cover_url", "parsed_count", "raw_text")


_VALID_JSON = "coalesce(json_valid(songs_json) AND starts_with(ltrim(songs_json), '['), false)"


def history_json_roundtrip(spark, sf):
    h = table(spark, sf, "playlist_history")
    again = playlists.parse_songs(F.to_json(playlists.parse_songs(F.col("songs_json"))))
    return h.select("id", F.size(again).alias("n"), F.coalesce(F.try_element_at(again, F.lit(1))["song_name"], F.lit("")).alias("first_name"), F.coalesce(F.try_element_at(again, F.lit(-1))["index"], F.lit(0)).alias("last_index"))


def history_insert(spark, sf):
    h = table(spark, sf, "playlist_history").select("id", "title", "created_at")
    new = table(spark, sf, "nation").select(F.lit(0).cast("bigint").alias("id"), F.col("n_name").alias("title"), F.lit(RUN_TS).cast("bigint").alias("created_at"))
    return store.append_with_ids(h, new, [F.asc("title")])


def schema_migration(spark, sf):
    legacy = table(spark, sf, "playlist_history").drop("cover_url")
    return store.migrate(legacy, {"cover_url": "", "title": "never"}).select("id", "title", "cover_url")


def order_restoring_join(spark, sf):
    ids = table(spark, sf, "songs").select("history_id", (F.col("song_index") - 1).alias("at"), "song_id")
    details = table(spark, sf, "songs").where("song_id % 5 <> 0").select("song_id", "song_name").distinct()
    return playlists.in_order(ids, details, "history_id", "at", "song_id").select("history_id", "index", "song_id", "song_name")


def paged_union(spark, sf):
    s = _songs(spark, sf).withColumn("page", F.floor((F.col("song_index") - 1) / playlists.PAGE))
    good = s.where(F.col("page") % 4 != 3)
    from pyspark.sql import Window

    w = Window.partitionBy("history_id").orderBy("page", "song_index", "song_id")
    return good.select("history_id", F.row_number().over(w).cast("bigint").alias("no"), "song_id")


def page_ranges(spark, sf):
    h = table(spark, sf, "playlist_history").select("id", (F.coalesce("song_count", F.lit(0)) * 700).alias("total"))
    return h.select("id", F.explode(playlists.pages(F.col("total"))).alias("p")).select("id", "p.page", "p.first", F.col("p.size").cast("bigint").alias("size"))


def chunk_ids(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.floor(F.col("p_partkey") / playlists.CHUNK).cast("bigint").alias("chunk"))
    return p.groupBy("chunk").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"), F.max("p_partkey").alias("last"))


def page_slice(spark, sf):
    t = table(spark, sf, "tracks").select("guid", "title", "duration")
    return playlists.page_of(t, 3, 0, [F.asc("guid")])


def playlist_titles(spark, sf):
    return table(spark, sf, "playlist_history").select("id", pages.list_title(F.col("title"), F.col("id")).alias("shown"))


def track_totals(spark, sf):
    """What each platform's lists say they hold, corrected by what they are seen to hold."""
    h = table(spark, sf, "playlist_history")
    seen = table(spark, sf, "songs").groupBy(F.col("history_id").alias("id")).agg(F.count("*").alias("seen"))
    j = h.join(seen, "id", "left").withColumn("found", F.coalesce(X.platform(F.col("source_url")), F.lit("unknown")))
    return j.groupBy("found").agg(F.sum(F.coalesce("song_count", F.lit(0))).cast("bigint").alias("stated"), F.sum(F.coalesce("seen", F.col("song_count"), F.lit(0))).cast("bigint").alias("calibrated"))


def response_status(spark, sf):
    h = table(spark, sf, "playlist_history")
    code = F.when(F.col("id") % 7 == 0, 401).when(F.col("id") % 7 == 1, 404).otherwise(200)
    tracks = F.when(F.col("id") % 5 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1)))
    return h.select("id", pages.response_status(code, F.when(F.col("id") % 11 == 0, 0).otherwise(F.col("id")), tracks).alias("status"))


def _responses(spark, sf):
    """Saved list responses, one a history: every list's ids, details of all but every fifth song."""
    s = _songs(spark, sf)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("song_index", "song_id"))), lambda x: F.struct(x["song_id"].alias("id")))
    detail = F.struct(F.col("song_id").alias("id"), F.col("song_name").alias("name"), F.array(F.struct(F.col("artist").alias("name")), F.struct(F.lit("").alias("name"))).alias("ar"))
    songs = F.collect_list(F.when(F.col("song_id") % 5 != 0, detail))
    one = s.groupBy("history_id", "song_index").agg(F.min(F.struct("song_id", "song_name", "artist")).alias("s")).select("history_id", "song_index", "s.*")
    r = one.groupBy("history_id").agg(ids.alias("t"), songs.alias("songs"))
    return r.select(F.to_json(F.struct(F.lit(200).alias("code"), F.struct(F.col("history_id").alias("id"), F.concat(F.lit("List \""), F.col("history_id").cast("string"), F.lit("\" é")).alias("name"), F.lit("//c/i.jpg?param=300y300").alias("coverImgUrl"), F.col("t").alias("trackIds")).alias("playlist"), "songs")).alias("j"))


def listed_songs(spark, sf):
    """Songs read back from saved responses, at the places their lists give them."""
    return pages.listed_songs(_responses(spark, sf), "j").withColumn("index", F.col("index").cast("bigint"))


def listed_heads(spark, sf):
    return pages.listed_heads(_responses(spark, sf), "j").withColumn("total", F.col("total").cast("bigint"))


def _page_answers(spark, sf):
    """Saved answers of a paged list, a page of 30 songs each: the first client gets an error of fixed size, of every fourth page too little comes from all."""
    s = _songs(spark, sf)
    one = s.groupBy("history_id", "song_index").agg(F.min(F.struct("song_id", "song_name", "artist")).alias("s")).select("history_id", "song_index", "s.*")
    paged = one.withColumn("page", F.floor((F.col("song_index") - 1) / playlists.PAGE).cast("int"))
    song = F.struct("song_index", F.col("song_name").alias("name"), F.array(F.struct(F.col("artist").alias("name"))).alias("singer"))
    page = paged.groupBy("history_id", "page").agg(F.transform(F.array_sort(F.collect_list(song)), lambda x: F.struct(x["name"].alias("name"), x["singer"].alias("singer"))).alias("songlist"))
    head = F.struct(F.lit("").alias("title"), F.lit(600).alias("songnum"), F.lit("//c/x.jpg").alias("picurl"))
    body = F.to_json(F.struct(F.lit(0).alias("code"), F.struct(F.lit(0).alias("code"), F.struct(head.alias("dirinfo"), "songlist").alias("data")).alias("req_0")))
    answers = F.array(F.struct(F.lit("-1").alias("client"), F.rpad(F.lit("{"), 108, "x").alias("body")), F.struct(F.lit("h5").alias("client"), F.when(F.col("page") % 4 == 3, F.lit('{"code":0}')).otherwise(body).alias("body")), F.struct(F.lit("windows").alias("client"), F.rpad(F.lit("{"), 50, "y").alias("body")))
    return page.select("history_id", "page", F.explode(answers).alias("a")).select("history_id", "page", "a.client", "a.body")


def paged_answers(spark, sf):
    good = pages.first_usable(_page_answers(spark, sf), "history_id", "page", "client", "body")
    return pages.paged_songs(good, "body", "history_id", "page").select("history_id", F.col("index").cast("bigint").alias("no"), "song_name", "artist")


def paged_heads(spark, sf):
    good = pages.first_usable(_page_answers(spark, sf), "history_id", "page", "client", "body")
    return pages.paged_lists(good, "body", "history_id", "page")


def shared_pages(spark, sf):
    """Songs read back from shared pages, one page a list."""
    esc = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    row = F.concat(F.lit("<div><div><img></div><div><div><p>"), esc("song_name"), F.lit("</p></div><div><p>"), esc("artist"), F.lit(" • Album</p></div></div></div>"))
    rows = _songs(spark, sf).select("history_id", F.struct("song_index", "song_id", row.alias("row")).alias("r")).groupBy("history_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["row"]), "").alias("rows"))
    head = F.concat(F.lit("<div><div>1</div><div>2</div><div><h1><p>List "), F.col("history_id").cast("string"), F.lit("</p></h1></div></div>"))
    html = F.concat(F.lit('<html><body><div id="root"><div><div><div><div>'), head, F.lit("<div><div><div><div>"), "rows", F.lit("</div></div></div></div></div></div></div></div></div></body></html>"))
    got = pages.page_songs(rows.select("history_id", html.alias("html")), "history_id", "html")
    return got.select("history_id", "page_title", F.col("index").cast("bigint").alias("no"), "song_name", "artist")


def songs_search(spark, sf):
    """Songs and lists that hold a text in any of their shown fields, whatever the case."""
    songs = formats.search(_songs(spark, sf).select("song_id", "song_name", "artist"), "RIVER", ("song_name", "artist")).select(F.lit("song").alias("kind"), F.col("song_id").alias("id"))
    lists = formats.search(table(spark, sf, "playlist_history").select("id", "title", "platform"), "QQ", ("title", "platform")).select(F.lit("list").alias("kind"), "id")
    return songs.unionByName(lists)


def first_numeric_key(spark, sf):
    h = table(spark, sf, "playlist_history")
    j = F.when(F.col("id") % 3 == 0, F.to_json(F.struct(F.col("song_count").cast("string").alias("trackCount"), F.lit(7).alias("count")))).when(F.col("id") % 3 == 1, F.to_json(F.struct(F.col("id").alias("songCount")))).otherwise(F.lit('{"name":"x"}'))
    return h.select("id", playlists.first_number(j, ["trackCount", "count", "songCount", "itemCount", "total"]).alias("n"))


def album_polymorphic(spark, sf):
    t = table(spark, sf, "tracks")
    kind = F.ascii(F.substring("guid", -1, 1)) % 2
    j = F.when(F.col("album").isNull(), F.lit("{}")).when(kind == 0, F.to_json("album")).otherwise(F.concat(F.lit('"'), F.regexp_replace(F.coalesce("album.title", F.lit("")), r'(["\\])', r"\\$1"), F.lit('"')))
    return t.select("guid", playlists.album_name(j).alias("name"))


def track_artists(spark, sf):
    t = table(spark, sf, "tracks")
    return t.select("guid", F.coalesce(pages.artists_joined(F.transform("artists", lambda a: a["name"])), F.lit("")).alias("artists"))


def map_merge(spark, sf):
    """Histograms of two roots added entry by entry."""
    p = table(spark, sf, "audio_fingerprints")
    a, b = (catalog.combined_stats(p, [r]).select(F.col("format_counts").alias(n), F.lit(1).alias("k")) for r, n in (("/vol1", "a"), ("/vol2", "b")))
    both = a.join(b, "k").select(F.map_zip_with("a", "b", lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))).alias("m"))
    return both.select(catalog.histogram_text("m").alias("counts"))


# tracks and wishes made of parts: all letters ASCII, where both engines count an edit alike
def _part_tracks(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").cast("string").alias("guid"), F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("title"), F.array("p_brand").alias("names"), F.when(F.col("p_partkey") % 3 == 0, "flac").otherwise("mp3").alias("format"), F.when(F.col("p_partkey") % 2 == 0, 320000).otherwise(128000).alias("bitrate"))


def _part_songs(spark, sf, asked=False):
    """Wishes of all parts; ``asked``: the query set of a search, the ids divisible by 50."""
    p = table(spark, sf, "part")
    p = p.where("p_partkey % 50 = 0") if asked else p
    t = F.concat("p_name", F.lit(" "), F.lower("p_type"))
    name = F.when(F.col("p_partkey") % 40 == 0, F.concat(t, F.lit(" (Live)"))).when(F.col("p_partkey") % 40 == 10, t).when(F.col("p_partkey") % 10 == 3, F.concat(t, F.lit("s"))).when(F.col("p_partkey") % 40 == 20, F.concat(F.substring(t, 2, 99), F.lit("q"))).otherwise(F.concat(F.lit("zz "), t))
    return p.select(F.col("p_partkey").alias("song_key"), name.alias("song_name"), F.when(F.col("p_partkey") % 250 == 0, "").otherwise(F.concat("p_brand", F.lit(" feat. Nobody"))).alias("artist"))


def _library_songs(spark, sf):
    """The query set of the typed songs: ids divisible by 50."""
    return _songs(spark, sf).where("song_id % 50 = 0").select(F.col("song_id").alias("song_key"), "history_id", "song_name", "artist")


def _library_tracks(spark, sf):
    t = table(spark, sf, "tracks")
    return t.select("guid", _ascii(F.col("title")).alias("title"), F.transform("artists", lambda a: a["name"]).alias("names"), F.col("audiospec.format").alias("format"), F.col("audiospec.bitrate").alias("bitrate"))


TRACKS_SQL = "SELECT p_partkey::VARCHAR AS guid, p_name || ' ' || lower(p_type) AS title, [p_brand] AS names, CASE WHEN p_partkey % 3 = 0 THEN 'flac' ELSE 'mp3' END AS format, CASE WHEN p_partkey % 2 = 0 THEN 320000 ELSE 128000 END AS bitrate FROM part"
_T = "p_name || ' ' || lower(p_type)"


def _wishes_sql(asked: bool) -> str:
    return f"""SELECT *, {_clean_sql('song_name')} AS clean, {_first_sql('artist')} AS first FROM (SELECT p_partkey AS song_key, CASE WHEN p_partkey % 40 = 0 THEN {_T} || ' (Live)' WHEN p_partkey % 40 = 10 THEN {_T} WHEN p_partkey % 10 = 3 THEN {_T} || 's' WHEN p_partkey % 40 = 20 THEN substr({_T}, 2, 99) || 'q' ELSE 'zz ' || {_T} END AS song_name,
 CASE WHEN p_partkey % 250 = 0 THEN '' ELSE p_brand || ' feat. Nobody' END AS artist FROM part {"WHERE p_partkey % 50 = 0" if asked else ""})"""


LIBRARY_TRACKS_SQL = f"SELECT guid, {_ASCII_SQL.format('title')} AS title, coalesce(list_transform(artists, lambda a: coalesce(a.name, '')), []) AS names, audiospec.format AS format, audiospec.bitrate AS bitrate FROM tracks"
LIBRARY_WISHES_SQL = f"SELECT *, {_clean_sql('song_name')} AS clean, {_first_sql('artist')} AS first FROM (SELECT song_id AS song_key, history_id, {NAME} AS song_name, {ARTIST} AS artist FROM songs WHERE song_id % 50 = 0)"


def _edits_sql(a: str, b: str) -> str:
    """The edit distance in characters: the function counts bytes, so each text is written anew with one byte for each different character of both."""
    letters = f"list_distinct(string_split({a} || {b}, ''))"
    byte = lambda x: f"array_to_string(list_transform(string_split({x}, ''), lambda ch: chr((32 + list_position({letters}, ch))::INT)), '')"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN greatest(length({a}), length({b})) ELSE levenshtein({byte(a)}, {byte(b)}) END"


def _title_score_sql(a: str, b: str) -> str:
    ca, cb = _clean_sql(a), _clean_sql(b)
    return f"""CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN {ca} = {cb} AND {ca} <> '' THEN 0.95::DOUBLE
 WHEN contains({a}, {b}) OR contains({b}, {a}) OR ({ca} <> '' AND (contains({ca}, {cb}) OR contains({cb}, {ca}))) THEN 0.80::DOUBLE + 0.15::DOUBLE * least(length({a}), length({b})) / greatest(length({a}), length({b}))
 ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - ({_edits_sql(a, b)})::DOUBLE / greatest(length({a}), length({b}))) END"""


_ARTIST_SCORE = f"""CASE WHEN q = '' THEN 0.7::DOUBLE WHEN contains(c, q) OR contains(q, c) THEN 1.0::DOUBLE WHEN f <> '' AND (contains(c, f) OR contains(f, c)) THEN 0.92::DOUBLE
 ELSE coalesce(list_max(list_transform(list_filter(ns, lambda n: n <> ''), lambda n: greatest(0.0::DOUBLE, 1.0::DOUBLE - ({_edits_sql('f', 'n')})::DOUBLE / greatest(length(f), length(n))))), 0.0::DOUBLE) END"""


def _scored_sql(pairs: str) -> str:
    """Pairs with song_key, song_name, artist, guid, title, names, format, bitrate and the stage they were found in."""
    return f"""SELECT *, least(1.0::DOUBLE, ts * 0.55::DOUBLE + ars * 0.40::DOUBLE + CASE WHEN lower(format) IN ('flac', 'ape', 'wav', 'alac', 'dsf', 'dff') THEN 0.05::DOUBLE WHEN bitrate >= 320000 OR bitrate = 320 THEN 0.03::DOUBLE ELSE 0.0::DOUBLE END) AS score FROM (
 SELECT *, {_title_score_sql('a', 'b')} AS ts, {_ARTIST_SCORE} AS ars FROM (SELECT *, array_to_string(ns, ' ') AS c FROM (SELECT *, lower({_TRIM.format('song_name')}) AS a, lower({_TRIM.format('title')}) AS b, lower({_TRIM.format('artist')}) AS q,
  list_transform(names, lambda n: lower({_TRIM.format('n')})) AS ns, lower({_first_sql('lower(artist)')}) AS f FROM ({pairs}))))"""


# keys are joined in blocks of 2 to this power; ten keys in a row lie in two blocks at most
NEAR_BITS = 4


def _neighbours(spark, sf):
    """Each wish beside ten tracks of nearby keys; the forms that are compared are made once per wish and per track."""
    s, t = _part_songs(spark, sf), _part_tracks(spark, sf)
    s = s.withColumns({"song_form": K.title_form(F.col("song_name")), "artist_form": K.artist_form(F.col("artist"))})
    t = t.withColumns({"at": F.col("guid").cast("bigint"), "title_form": K.title_form(F.col("title")), "names_form": K.names_form(F.col("names")), "bonus": K.quality_bonus(F.col("format"), F.col("bitrate"))})
    block = lambda c: F.shiftright(c, NEAR_BITS)
    near = s.withColumn("block", F.explode(F.array_distinct(F.array(block(F.col("song_key") - 3), block(F.col("song_key") + 6)))))
    return near.join(shuffled(t.withColumn("block", block(F.col("at")))), "block").where(F.col("at").between(F.col("song_key") - 3, F.col("song_key") + 6))


NEAR_SQL = f"SELECT s.*, t.* FROM ({_wishes_sql(False)}) s JOIN ({TRACKS_SQL}) t ON t.guid::BIGINT BETWEEN s.song_key - 3 AND s.song_key + 6"


def title_score(spark, sf):
    return _neighbours(spark, sf).select("song_key", "guid", F.round(K.title_likeness(F.col("song_form"), F.col("title_form")), 6).alias("score"))


def artist_score(spark, sf):
    return _neighbours(spark, sf).select("song_key", "guid", F.round(K.artist_score(F.col("artist"), F.col("names")), 6).alias("score"))


def score_candidate(spark, sf):
    score = K.total_score(K.title_likeness(F.col("song_form"), F.col("title_form")), K.artist_likeness(F.col("artist_form"), F.col("names_form")), F.col("bonus"))
    return _neighbours(spark, sf).select("song_key", "guid", F.round(score, 6).alias("score"))


def candidate_topk(spark, sf):
    songs, tracks = _part_songs(spark, sf, True), _part_tracks(spark, sf)
    found = matching.search(songs.select("song_key", F.lit(1).alias("stage"), X.clean_title(F.col("song_name")).alias("query")), matching.title_index(tracks))
    return found.select("song_key", "pos", "guid")


def _stage_sql(stage: int, source: str, query: str, tracks: str = TRACKS_SQL) -> str:
    return f"SELECT * FROM (SELECT s.song_key, {stage} AS stage, row_number() OVER (PARTITION BY s.song_key ORDER BY t.guid) AS pos, s.song_name, s.artist, t.* FROM ({source}) s JOIN ({tracks}) t ON contains(lower(t.title), lower({query})) WHERE {query} <> '') WHERE pos <= {matching.TOP[stage]}"


def _match_sql(wishes: str, tracks: str) -> str:
    """The stages one after the other, as they are described; the result is ``m``."""
    return f"""WITH w AS ({wishes}), s1 AS ({_scored_sql(_stage_sql(1, 'SELECT * FROM w', 's.clean', tracks))}),
 st AS (SELECT w.*, coalesce(n, 0) AS n, coalesce(best, 0) AS best FROM w LEFT JOIN (SELECT song_key, count(*) AS n, max(score) AS best FROM s1 GROUP BY 1) x ON w.song_key = x.song_key),
 s2 AS ({_scored_sql(_stage_sql(2, 'SELECT * FROM st WHERE best < 0.85 AND n < 5 AND song_name <> clean', 's.song_name', tracks))}),
 n3 AS (SELECT * FROM w WHERE first <> '' AND song_key NOT IN (SELECT song_key FROM s1) AND song_key NOT IN (SELECT song_key FROM s2)),
 s3 AS ({_scored_sql(_stage_sql(3, 'SELECT * FROM n3', "trim(s.clean || ' ' || s.first)", tracks))}),
 s4 AS ({_scored_sql(_stage_sql(4, 'SELECT * FROM n3 WHERE song_key NOT IN (SELECT song_key FROM s3)', 's.first', tracks))}),
 al AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4),
 be AS (SELECT song_key, guid, score FROM al QUALIFY row_number() OVER (PARTITION BY song_key ORDER BY score DESC, stage, pos) = 1),
 m AS (SELECT w.*, coalesce(be.score, 0) >= 0.65 AS matched, CASE WHEN coalesce(be.score, 0) >= 0.65 THEN be.guid ELSE '' END AS track_guid, round(coalesce(be.score, 0), 6) AS score,
  CASE WHEN be.guid IS NULL THEN '{matching.NOT_FOUND}' WHEN be.score < 0.65 THEN '{matching.TOO_FAR}' ELSE '' END AS error FROM w LEFT JOIN be ON w.song_key = be.song_key)"""


MATCH_CTES = _match_sql(_wishes_sql(True), TRACKS_SQL)
LIBRARY_CTES = _match_sql(LIBRARY_WISHES_SQL, LIBRARY_TRACKS_SQL)
_MATCH_COLUMNS = "song_key, song_name, artist, matched, track_guid, score, error"


def _matches(spark, sf):
    return matching.match_songs(_part_songs(spark, sf, True), _part_tracks(spark, sf))


def match_songs(spark, sf):
    return _matches(spark, sf).withColumn("score", F.round("score", 6))


def import_report(spark, sf):
    return matching.import_report(_matches(spark, sf))


def unmatched_list(spark, sf):
    m = _matches(spark, sf).withColumn("bucket", F.col("song_key") % 100)
    return matching.unmatched_lines(m, "bucket", "song_key")


def library_matches(spark, sf):
    """Typed songs against all of the library's own tracks, in whatever script."""
    return matching.match_songs(_library_songs(spark, sf), _library_tracks(spark, sf)).withColumn("score", F.round("score", 6))


def _library_lists(spark, sf):
    return library_matches(spark, sf).join(shuffled(_library_songs(spark, sf).select("song_key", "history_id")), "song_key")


def library_report(spark, sf):
    return matching.import_report(_library_lists(spark, sf), ["history_id"])


def library_matched_ids(spark, sf):
    return matching.matched_lists(_library_lists(spark, sf), "history_id", "song_key")


def library_unmatched(spark, sf):
    return matching.unmatched_lines(_library_lists(spark, sf), "history_id", "song_key")


def library_all_matches(spark, sf):
    """All typed songs against all tracks; too many pairs for nested SQL."""
    songs = _songs(spark, sf).select(F.col("song_id").alias("song_key"), "song_name", "artist")
    return matching.match_songs(songs, _library_tracks(spark, sf)).withColumn("score", F.round("score", 6))


def _events(spark, sf):
    return table(spark, sf, "events").select("user_id", "ts", progress.outcome(F.col("event_type")).alias("outcome"))


OUTCOME_SQL = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'mismatched' ELSE 'ok' END"


def progress_counters(spark, sf):
    return progress.counters(_events(spark, sf), ["user_id"])


def progress_windowed(spark, sf):
    """An extension: counts per hour."""
    e = _events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return progress.windowed(e).select(F.unix_timestamp("window_start").alias("start_s"), "outcome", "n")


def stream_progress(spark, sf):
    """The same counts per hour by a stream over the table's files; there are as many as hours, whatever the rows."""
    e = table_stream(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), progress.outcome(F.col("event_type")).alias("outcome"))
    return run_to_end(progress.windowed(e)).select(F.unix_timestamp("window_start").alias("start_s"), "outcome", "n")


def shown_dates(spark, sf):
    h = table(spark, sf, "playlist_history")
    at = F.timestamp_seconds(F.coalesce("created_at", F.lit(0)))
    return h.select("id", F.date_format(at, "MM/dd HH:mm").alias("short"), F.concat(F.lit("导入歌单 "), F.date_format(at, "yyyy-MM-dd HH:mm")).alias("name"), (F.lit(RUN_TS) - F.coalesce("created_at", F.lit(0))).cast("bigint").alias("age"))


QUERIES = {
    "clean_title": (clean_title, f"SELECT song_id, {_clean_sql('song_name')} AS cleaned FROM ({SONGS_SQL})"),
    "clean_song_name": (clean_song_name, f"SELECT song_id, {_name_sql('song_name')} AS cleaned FROM ({SONGS_SQL})"),
    "primary_artist": (primary_artist, f"SELECT song_id, {_first_sql('artist')} AS first FROM ({SONGS_SQL})"),
    "normalize_cover_url": (normalize_cover_url, "SELECT id, CASE WHEN u = '' AND id % 3 <> 0 THEN '' WHEN id % 3 = 0 THEN (CASE WHEN starts_with(regexp_replace(u, '^https?:', ''), '//') THEN 'https:' ELSE '' END) || split_part(regexp_replace(u, '^https?:', ''), '?param=', 1) ELSE split_part(CASE WHEN starts_with(trim(u), '//') THEN 'https:' || trim(u) ELSE trim(u) END, '?param=', 1) END AS cover FROM (SELECT id, coalesce(cover_url, '') AS u FROM playlist_history)"),
    "normalize_server_url": (normalize_server_url, "SELECT id, 'http://nas' || library_id AS server FROM playlist_history"),
    "platform_classify": (platform_classify, f"SELECT id, coalesce({PLATFORM_SQL}, 'unknown') AS found, coalesce(regexp_matches(source_url, '163cn\\.tv|y\\.music\\.163\\.com|fcgi-bin|i\\.y\\.qq\\.com|c6\\.y\\.qq\\.com'), false) AS short FROM playlist_history"),
    "playlist_id_extract": (playlist_id_extract, f"SELECT id, coalesce(CASE {PLATFORM_SQL} WHEN 'netease' THEN regexp_extract(source_url, 'id=(\\d+)', 1) WHEN 'qq' THEN coalesce(nullif(regexp_extract(source_url, '.*playlist/(\\d+)', 1), ''), nullif(regexp_extract(source_url, 'id=(\\d+)', 1), ''), regexp_extract(source_url, '(?:tid|id)=([0-9]+)', 1)) END, '') AS list_id FROM playlist_history"),
    "share_links": (share_links, "SELECT id, coalesce(nullif(regexp_extract(t, 'https?://qishui\\.douyin\\.com/s/[a-zA-Z0-9]+/?'), ''), nullif(regexp_extract(t, 'https?://[a-zA-Z0-9./?=&_%-]+'), ''), t) AS link FROM (SELECT id, '听听这个 ' || coalesce(source_url, '') || ' 复制打开' AS t FROM playlist_history)"),
    "platform_names": (platform_names, f"SELECT id, CASE p {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in PLATFORM_NAMES.items())} ELSE p END AS shown FROM (SELECT id, coalesce({PLATFORM_SQL}, platform) AS p FROM playlist_history)"),
    "url_codec": (url_codec, f"SELECT song_id, song_name AS back, length(regexp_replace(song_name, '[^A-Za-z0-9 ]', '', 'g'))::INT AS n FROM ({SONGS_SQL})"),
    **{f"format_song_text_{s.replace('-', '_')}": (_style(s), _style_sql(s)) for s in ("song-singer", "singer-song", "song")},
    "undetailed_songs": (undetailed_songs, f"SELECT song_id, CASE WHEN artist = '' THEN n ELSE n || ' - ' || artist END AS line FROM (SELECT *, {_name_sql('song_name')} AS n FROM ({SONGS_SQL}))"),
    "reverse_playlist": (reverse_playlist, "SELECT song_id, history_id, row_number() OVER (PARTITION BY history_id ORDER BY song_index DESC, song_id DESC) AS new_index FROM songs"),
    "playlist_csv_rows": (playlist_csv_rows, f"""SELECT history_id, row_number() OVER (PARTITION BY history_id ORDER BY song_index, song_id) AS "序号", CASE WHEN artist = '' THEN song_name ELSE song_name || ' - ' || artist END AS "歌曲信息" FROM ({SONGS_SQL})"""),
    "playlist_text_export": (playlist_text_export, f"SELECT history_id, string_agg(CASE WHEN artist = '' THEN song_name ELSE song_name || ' - ' || artist END, chr(10) ORDER BY song_index, song_id) AS raw_text, count(*) AS n_songs FROM ({SONGS_SQL}) GROUP BY 1"),
    "export_names": (export_names, "SELECT id, replace(replace(CASE WHEN coalesce(title, '') = '' THEN 'playlist' ELSE title END, '/', '_'), '\\', '_') || '.txt' AS file_name FROM playlist_history"),
    "history_recent": (history_recent, "SELECT id, platform, source_url, title, coalesce(cover_url, '') AS cover_url, song_count, created_at FROM playlist_history ORDER BY created_at DESC, id DESC LIMIT 30"),
    "history_detail": (history_detail, f"SELECT id, title, coalesce(cover_url, '') AS cover_url, CASE WHEN ok THEN json_array_length(songs_json)::INT ELSE 0 END AS parsed_count, CASE WHEN ok THEN coalesce(list_aggregate(list_transform(from_json(songs_json, '[{{\"full_text\":\"VARCHAR\"}}]'), lambda x: coalesce(x.full_text, '')), 'string_agg', chr(10)), '') ELSE '' END AS raw_text FROM (SELECT *, {_VALID_JSON} AS ok FROM playlist_history)"),
    "history_json_roundtrip": (history_json_roundtrip, f"SELECT id, CASE WHEN ok THEN json_array_length(songs_json)::INT ELSE 0 END AS n, CASE WHEN ok THEN coalesce(songs_json->0->>'song_name', '') ELSE '' END AS first_name, CASE WHEN ok THEN coalesce((songs_json->-1->>'index')::INT, 0) ELSE 0 END AS last_index FROM (SELECT *, {_VALID_JSON} AS ok FROM playlist_history)"),
    "history_insert": (history_insert, f"SELECT id, title, created_at FROM playlist_history UNION ALL SELECT (SELECT max(id) FROM playlist_history) + row_number() OVER (ORDER BY n_name), n_name, {RUN_TS} FROM nation"),
    "schema_migration": (schema_migration, "SELECT id, title, '' AS cover_url FROM playlist_history"),
    "order_restoring_join": (order_restoring_join, "SELECT history_id, song_index::BIGINT AS index, song_id, song_name FROM songs WHERE song_id % 5 <> 0"),
    "paged_union": (paged_union, "SELECT history_id, row_number() OVER (PARTITION BY history_id ORDER BY song_index, song_id) AS no, song_id FROM songs WHERE ((song_index - 1) // 30) % 4 <> 3"),
    "page_ranges": (page_ranges, "SELECT id, p::INT AS page, (p * 30)::INT AS first, least(30, n - p * 30)::BIGINT AS size FROM (SELECT id, n, unnest(range(0, (n + 29) // 30)) AS p FROM (SELECT id, least(coalesce(song_count, 0) * 700, 10000) AS n FROM playlist_history))"),
    "chunk_ids": (chunk_ids, "SELECT p_partkey // 400 AS chunk, count(*) AS n, min(p_partkey) AS first, max(p_partkey) AS last FROM part GROUP BY 1"),
    "page_slice": (page_slice, "SELECT guid, title, duration FROM tracks ORDER BY guid LIMIT 50 OFFSET 100"),
    "playlist_titles": (playlist_titles, "SELECT id, CASE WHEN coalesce(title, '') = '' THEN 'QQ音乐歌单_' || id ELSE title END AS shown FROM playlist_history"),
    "track_totals": (track_totals, f"SELECT coalesce({PLATFORM_SQL}, 'unknown') AS found, sum(coalesce(song_count, 0))::BIGINT AS stated, sum(coalesce(n, song_count, 0))::BIGINT AS calibrated FROM playlist_history LEFT JOIN (SELECT history_id, count(*) AS n FROM songs GROUP BY 1) s ON id = s.history_id GROUP BY 1"),
    "response_status": (response_status, "SELECT id, CASE WHEN id % 7 = 0 THEN 'private' WHEN id % 7 = 1 OR id % 11 = 0 THEN 'not_found' WHEN id % 5 = 0 THEN 'empty' ELSE 'ok' END AS status FROM playlist_history"),
    "listed_songs": (listed_songs, f"SELECT history_id AS list_id, index, s.song_name AS song_name, s.artist AS artist FROM (SELECT *, row_number() OVER (PARTITION BY history_id ORDER BY song_index) AS index FROM (SELECT history_id, song_index, arg_min({{'song_id': song_id, 'song_name': song_name, 'artist': artist}}, song_id) AS s FROM ({SONGS_SQL}) GROUP BY 1, 2)) WHERE s.song_id % 5 <> 0"),
    "listed_heads": (listed_heads, "SELECT history_id AS list_id, 'List \"' || history_id || '\" é' AS title, 'https://c/i.jpg' AS cover, count(DISTINCT song_index) AS total, 'ok' AS status FROM songs GROUP BY history_id"),
    "paged_answers": (paged_answers, f"SELECT history_id, row_number() OVER (PARTITION BY history_id ORDER BY song_index) AS no, s.song_name AS song_name, s.artist AS artist FROM (SELECT history_id, song_index, arg_min({{'song_name': song_name, 'artist': artist}}, song_id) AS s FROM ({SONGS_SQL}) GROUP BY 1, 2) WHERE ((song_index - 1) // 30) % 4 <> 3 AND (song_index - 1) // 30 < 20 AND history_id IN (SELECT history_id FROM songs WHERE song_index <= 30)"),
    "paged_heads": (paged_heads, "SELECT DISTINCT history_id, 'QQ音乐歌单_' || history_id AS title, 'https://c/x.jpg' AS cover, 600 AS total FROM songs WHERE song_index <= 30"),
    "shared_pages": (shared_pages, f"SELECT history_id, 'List ' || history_id AS page_title, row_number() OVER (PARTITION BY history_id ORDER BY song_index, song_id) AS no, n AS song_name, {_TRIM.format("split_part(artist, '•', 1)")} AS artist FROM (SELECT *, {_TRIM.format('song_name')} AS n FROM ({SONGS_SQL})) WHERE n <> ''"),
    "songs_search": (songs_search, f"SELECT 'song' AS kind, song_id AS id FROM ({SONGS_SQL}) WHERE contains(lower(song_name), 'river') OR contains(lower(artist), 'river') UNION ALL SELECT 'list', id FROM playlist_history WHERE contains(lower(coalesce(title, '')), 'qq') OR contains(lower(coalesce(platform, '')), 'qq')"),
    "first_numeric_key": (first_numeric_key, "SELECT id, CASE id % 3 WHEN 0 THEN 7 WHEN 1 THEN id ELSE 0 END AS n FROM playlist_history"),
    "album_polymorphic": (album_polymorphic, "SELECT guid, CASE WHEN album IS NULL THEN '' WHEN ascii(right(guid, 1)) % 2 = 0 THEN coalesce(nullif(album.name, ''), nullif(album.title, ''), '') ELSE coalesce(album.title, '') END AS name FROM tracks"),
    "track_artists": (track_artists, "SELECT guid, coalesce(list_aggregate(list_filter(list_transform(artists, lambda a: a.name), lambda n: n IS NOT NULL AND n <> ''), 'string_agg', ' / '), '') AS artists FROM tracks"),
    "map_merge": (map_merge, "SELECT string_agg(ext || ':' || n, ',' ORDER BY ext) AS counts FROM (SELECT lower(regexp_extract(file_path, '(\\.[^./]*)$', 1)) AS ext, count(*) AS n FROM audio_fingerprints WHERE regexp_matches(file_path, '^/vol[12]/') GROUP BY 1) WHERE ext IN ('.mp3', '.m4a', '.aac', '.flac', '.wav', '.ogg', '.opus', '.wma', '.ape', '.alac', '.aif', '.aiff', '.dsf', '.dff', '.mp4', '.m4b', '.wv', '.mpc', '.ac3', '.dts')"),
    "title_score": (title_score, f"SELECT song_key, guid, round(ts, 6) AS score FROM ({_scored_sql(NEAR_SQL)})"),
    "artist_score": (artist_score, f"SELECT song_key, guid, round(ars, 6) AS score FROM ({_scored_sql(NEAR_SQL)})"),
    "score_candidate": (score_candidate, f"SELECT song_key, guid, round(score, 6) AS score FROM ({_scored_sql(NEAR_SQL)})"),
    "candidate_topk": (candidate_topk, f"SELECT song_key, pos, guid FROM ({_stage_sql(1, _wishes_sql(True), 's.clean')})"),
    "match_songs": (match_songs, f"{MATCH_CTES} SELECT {_MATCH_COLUMNS} FROM m"),
    "import_report": (import_report, MATCH_CTES + " SELECT count(*) AS total, count(*) FILTER (matched) AS matched, count(*) FILTER (NOT matched) AS unmatched FROM m"),
    "unmatched_list": (unmatched_list, MATCH_CTES + " SELECT bucket, no, no || '. ' || song_name || ' - ' || artist AS line FROM (SELECT song_key % 100 AS bucket, row_number() OVER (PARTITION BY song_key % 100 ORDER BY song_key) AS no, song_name, artist FROM m WHERE NOT matched)"),
    "library_matches": (library_matches, f"{LIBRARY_CTES} SELECT {_MATCH_COLUMNS} FROM m"),
    "library_report": (library_report, LIBRARY_CTES + " SELECT history_id, count(*) AS total, count(*) FILTER (matched) AS matched, count(*) FILTER (NOT matched) AS unmatched FROM m GROUP BY 1"),
    "library_matched_ids": (library_matched_ids, LIBRARY_CTES + " SELECT history_id, 0::BIGINT AS page, string_agg(track_guid, ',' ORDER BY song_key) AS guids FROM m WHERE matched GROUP BY 1"),
    "library_unmatched": (library_unmatched, LIBRARY_CTES + " SELECT history_id, no, no || '. ' || song_name || ' - ' || artist AS line FROM (SELECT history_id, row_number() OVER (PARTITION BY history_id ORDER BY song_key) AS no, song_name, artist FROM m WHERE NOT matched)"),
    "library_all_matches": (library_all_matches, None),
    "progress_counters": (progress_counters, f"SELECT user_id, total, mismatched, failed, greatest(0, total - mismatched - failed) AS ok, floor((total - failed) * 100.0::DOUBLE / total + 0.5::DOUBLE)::BIGINT AS percent FROM (SELECT user_id, count(*) AS total, count(*) FILTER (o = 'mismatched') AS mismatched, count(*) FILTER (o = 'failed') AS failed FROM (SELECT user_id, {OUTCOME_SQL} AS o FROM events) GROUP BY 1)"),
    "progress_windowed": (progress_windowed, f"SELECT epoch(date_trunc('hour', ts))::BIGINT AS start_s, {OUTCOME_SQL} AS outcome, count(*) AS n FROM events GROUP BY 1, 2"),
    "stream_progress": (stream_progress, f"SELECT epoch(date_trunc('hour', ts))::BIGINT AS start_s, {OUTCOME_SQL} AS outcome, count(*) AS n FROM events GROUP BY 1, 2"),
    "shown_dates": (shown_dates, f"SELECT id, strftime(make_timestamp(coalesce(created_at, 0) * 1000000), '%m/%d %H:%M') AS short, '导入歌单 ' || strftime(make_timestamp(coalesce(created_at, 0) * 1000000), '%Y-%m-%d %H:%M') AS name, {RUN_TS} - coalesce(created_at, 0) AS age FROM playlist_history"),
}
