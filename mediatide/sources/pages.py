"""Song lists in saved pages and responses of platforms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cover_link
from ..operators.playlists import MOST_SONGS, PAGE

LIST_SCHEMA = "struct<code:int,playlist:struct<id:bigint,name:string,coverImgUrl:string,trackIds:array<struct<id:bigint>>>,songs:array<struct<id:bigint,name:string,ar:array<struct<name:string>>>>>"
PAGED_SCHEMA = "struct<code:int,req_0:struct<code:int,data:struct<dirinfo:struct<title:string,songnum:int,picurl:string>,songlist:array<struct<name:string,singer:array<struct<name:string>>>>>>>"
# fixed values: the clients a page is asked for as, in order; the size of the answer that means an error, and the least size of one that is used
ATTEMPTS = ("-1", "android", "iphone", "h5", "wxfshare", "iphone_wx", "windows")
ERROR_BYTES, LEAST_BYTES = 108, 51
# fixed values: where a shared page keeps the title, its author, the songs, and a song's name and artist; the title of a page without
_ROOT = "#root div div div div "
TITLE_AT, AUTHOR_AT, SONGS_AT = _ROOT + "div:1 div:3 h1 p", _ROOT + "div:1 div:3 div div div:2 p", _ROOT + "div:2 div div div div div"
NAME_AT, ARTIST_AT = "div:2 div:1 p", "div:2 div:2 p"
UNTITLED = "汽水音乐歌单"


def artists_joined(names: Column) -> Column:
    """Artists' names in one text, empty ones left out."""
    return F.array_join(F.filter(names, lambda n: n.isNotNull() & (n != "")), " / ")


def response_status(code: Column, id_: Column, tracks: Column) -> Column:
    """What a list's response means: ok, private, not_found or empty."""
    return F.when(code == 401, "private").when((code != 200) | F.coalesce(id_ == 0, F.lit(True)), "not_found").when(F.coalesce(F.size(tracks), F.lit(0)) <= 0, "empty").otherwise("ok")


def listed_heads(responses: DataFrame, column: str) -> DataFrame:
    """``(list_id, title, cover, total, status)`` of list responses; what can't be read has nulls and is not found."""
    r = responses.select(F.from_json(column, LIST_SCHEMA).alias("_r"))
    head = F.col("_r.playlist")
    return r.select(head["id"].alias("list_id"), head["name"].alias("title"), cover_link(F.coalesce(head["coverImgUrl"], F.lit(""))).alias("cover"), F.greatest(F.size(head["trackIds"]), F.lit(0)).alias("total"), response_status(F.col("_r.code"), head["id"], head["trackIds"]).alias("status"))


def listed_songs(responses: DataFrame, column: str) -> DataFrame:
    """Songs of list responses, in the order of their ids; ids without details leave their index free."""
    r = responses.withColumn("_r", F.from_json(column, LIST_SCHEMA))
    ids = r.select(F.col("_r.playlist.id").alias("list_id"), F.posexplode("_r.playlist.trackIds.id").alias("at", "id"))
    details = r.select(F.col("_r.playlist.id").alias("list_id"), F.explode("_r.songs").alias("s")).select("list_id", "s.id", F.col("s.name").alias("song_name"), artists_joined(F.col("s.ar.name")).alias("artist"))
    return ids.join(details, ["list_id", "id"]).select("list_id", (F.col("at") + 1).alias("index"), "song_name", "artist")


def usable(body: Column) -> Column:
    """Whether an answer is one: long enough, and not of the size of the error that comes without a code."""
    n = F.octet_length(body)
    return F.coalesce((n != ERROR_BYTES) & (n >= LEAST_BYTES), F.lit(False))


def first_usable(answers: DataFrame, list_id: str, page: str, attempt: str, body: str) -> DataFrame:
    """``(list_id, page, body)``: for each page the first usable answer in the order of ``ATTEMPTS``; pages without are left out."""
    place = F.array_position(F.array(*map(F.lit, ATTEMPTS)), F.col(attempt))
    good = answers.where(usable(F.col(body)) & (place > 0))
    return good.groupBy(list_id, page).agg(F.min_by(body, place).alias(body))


def _first_pages(read: DataFrame, list_id: str, page: str) -> DataFrame:
    """Title, cover and number of songs of each list, from its first page."""
    head = F.col("_r.req_0.data.dirinfo")
    n = F.when(F.coalesce(head["songnum"], F.lit(0)) != 0, head["songnum"]).otherwise(F.greatest(F.size("_r.req_0.data.songlist"), F.lit(0)))
    return read.where((F.col(page) == 0) & F.col("_r").isNotNull()).select(list_id, F.coalesce(head["title"], F.lit("")).alias("title"), cover_link(F.coalesce(head["picurl"], F.lit(""))).alias("cover"), F.least(n, F.lit(MOST_SONGS)).alias("total"))


def paged_lists(responses: DataFrame, column: str, list_id: str, page: str) -> DataFrame:
    """``(list_id, title, cover, total)`` of every list whose first page can be read."""
    read = responses.withColumn("_r", F.from_json(column, PAGED_SCHEMA))
    return _first_pages(read, list_id, page).withColumn("title", list_title(F.col("title"), F.col(list_id)))


def paged_songs(responses: DataFrame, column: str, list_id: str, page: str) -> DataFrame:
    """Songs of paged responses, pages in order, numbered without gaps.

    A list is known by its first page (0): without it there are no songs. Pages beyond the list's end are not read,
    others that can't be read are left out.
    """
    from pyspark.sql import Window

    read = responses.withColumn("_r", F.from_json(column, PAGED_SCHEMA))
    ends = _first_pages(read, list_id, page).select(list_id, F.greatest(F.lit(1), F.ceil(F.col("total") / PAGE)).alias("_pages"))
    songs = read.join(ends, list_id).where(F.col(page) < F.col("_pages")).select(list_id, page, F.posexplode("_r.req_0.data.songlist").alias("at", "s"))
    w = Window.partitionBy(list_id).orderBy(page, "at")
    singers = F.array_join(F.transform("s.singer", lambda x: F.coalesce(x["name"], F.lit(""))), " / ")
    return songs.select(list_id, F.row_number().over(w).alias("index"), F.coalesce("s.name", F.lit("")).alias("song_name"), F.coalesce(singers, F.lit("")).alias("artist"))


def list_title(title: Column, id_: Column, prefix: str = "QQ音乐歌单_") -> Column:
    """A list's title, or a made-up one with its id."""
    return F.when(F.coalesce(title, F.lit("")) == "", F.concat(F.lit(prefix), id_.cast("string"))).otherwise(title)


@dataclass
class _Node:
    """An element: its parent, its number among the parent's elements, and the text below it."""

    tag: str
    id: str
    parent: _Node | None
    number: int
    text: list[str] = field(default_factory=list)
    elements: int = 0

    def is_at(self, steps: list[str]) -> bool:
        """Whether the path from above ends with these steps: ``tag``, ``tag:number`` or ``#id``."""
        node: _Node | None = self
        for step in reversed(steps):
            tag, _, number = step.partition(":")
            if node is None or (node.id != tag[1:] if tag[0] == "#" else node.tag != tag) or number and node.number != int(number):
                return False
            node = node.parent
        return True

    def within(self, other: _Node) -> bool:
        node = self.parent
        while node is not None and node is not other:
            node = node.parent
        return node is other


class _Page(HTMLParser):
    """The elements of a page in order; text counts for all elements around it that may be asked for."""

    EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, html: str):
        super().__init__()
        self.root = _Node("", "", None, 1)
        self.open, self.nodes = [self.root], []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        above = self.open[-1]
        above.elements += 1
        node = _Node(tag, dict(attrs).get("id") or "", above, above.elements)
        self.nodes.append(node)
        if tag not in self.EMPTY:
            self.open.append(node)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        for node in self.open:
            if node.tag in ("p", "h1"):
                node.text.append(data)

    def texts(self, where: str) -> str:
        steps = where.split()
        return "".join("".join(n.text) for n in self.nodes if n.is_at(steps)).strip()


def read_page(html: str | None) -> tuple[str, list[tuple[str, str]]]:
    """The title of a shared page and its songs (name, artist): the artist ends at a bullet, songs without a name are left out."""
    page = _Page(html or "")
    title, author = page.texts(TITLE_AT), page.texts(AUTHOR_AT)
    if not title:
        title = next(("".join(n.text) for n in page.nodes if n.tag == "h1"), "").strip()
    title = f"{title} - {author}" if title and author else title or UNTITLED
    rows = [n for n in page.nodes if n.is_at(SONGS_AT.split())]
    place = {id(n): k for k, n in enumerate(rows)}
    found: list[tuple[list[str], list[str]]] = [([], []) for _ in rows]
    names, artists = NAME_AT.split(), ARTIST_AT.split()
    for n in page.nodes:
        if n.tag == "p":
            kind = 0 if n.is_at(names) else 1 if n.is_at(artists) else None
            above = n.parent
            while kind is not None and above is not None:
                if id(above) in place:
                    found[place[id(above)]][kind].append("".join(n.text))
                above = above.parent
    songs = [("".join(a).strip(), "".join(b).split("•")[0].strip()) for a, b in found]
    return title, [s for s in songs if s[0]]


def page_songs(pages: DataFrame, key: str, column: str) -> DataFrame:
    """``(key, page_title, index, song_name, artist)`` of saved shared pages, a batch of pages at a time; pages without songs give no row."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [read_page(h) for h in batch.column(1).to_pylist()]
            at = [k for k, (_, songs) in enumerate(read) for _ in songs]
            flat = [(title, n, *song) for title, songs in read for n, song in enumerate(songs, 1)]
            cols = list(zip(*flat, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True))],
                names=[key, "page_title", "index", "song_name", "artist"],
            )

    return pages.select(key, column).mapInArrow(run, f"{key} {kind}, page_title string, index int, song_name string, artist string")
