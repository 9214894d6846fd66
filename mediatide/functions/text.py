"""Column expressions on titles, artists, links and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word boundary that counts ASCII letters only: a boundary lies inside "Live现场版" but not after "伴奏".
ASCII_EDGE = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
# fixed values: the patterns that decide what is noise in a title and what parts artists
BRACKETED = r"\s*[(\[（【<][^)\]）】>]*[)\]）】>]\s*"
NOISE_WORDS = "live|remix|instrumental|cover|remaster|remastered|explicit|clean|伴奏|现场版|重制版|原声版|高保真|无损版"
NOISE_SUFFIX = rf"(?d)(?i)\s*(-|_|\s)\s*({NOISE_WORDS}){ASCII_EDGE}.*\z"
BRACKETED_LAZY = r"(?d)[(\[（【].*?[)\]）】]"
ARTIST_BREAK = r"[/,&、+，]|(?i)\s+feat\.?\s+|\s+ft\.?\s+|\s+vs\.?\s+"
SHORT_LINKS = {"netease": r"163cn\.tv|y\.music\.163\.com", "qq": r"fcgi-bin|i\.y\.qq\.com|c6\.y\.qq\.com"}
# fixed values: platforms by what their links contain, tried in this order
PLATFORMS = (("netease", r"163cn|\.163\."), ("qq", r"\.qq\."), ("qishui", "qishui|douyin"))
SHARE_LINK = r"(https?://qishui\.douyin\.com/s/[a-zA-Z0-9]+/?)"
ANY_LINK = r"(https?://[a-zA-Z0-9./?=&_%-]+)"


def strip(c: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def lower(c: Column) -> Column:
    """Lower case, letter by letter: a capital becomes one letter and the same one wherever it stands, a sigma at a word's end too."""
    return F.lower(F.translate(c, "Σİ", "σi"))


def _or_stripped(cleaned: Column, raw: Column) -> Column:
    return F.when(cleaned == "", strip(raw)).otherwise(cleaned)


def clean_title(c: Column) -> Column:
    """A title without bracketed additions and version notes, or as it was if nothing is left."""
    t = F.regexp_replace(F.regexp_replace(strip(c), BRACKETED, " "), NOISE_SUFFIX, "")
    return _or_stripped(strip(F.regexp_replace(t, r"(?U)\s+", " ")), c)


def clean_song_name(c: Column) -> Column:
    """A song's name without bracketed spans; no blank is put in their place."""
    return _or_stripped(strip(F.regexp_replace(c, BRACKETED_LAZY, "")), c)


def primary_artist(c: Column) -> Column:
    """The first artist of a field, or the whole field if the first is empty."""
    first = strip(F.split(c, ARTIST_BREAK, -1)[0])
    return F.when(first == "", strip(c)).otherwise(first)


def cover_link(c: Column) -> Column:
    """A cover's address: protocol added, size parameter cut."""
    u = strip(c)
    u = F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).otherwise(u)
    return F.substring_index(u, "?param=", 1)


def server_link(c: Column) -> Column:
    """A server's address without the API path and slashes at its end."""
    bare = F.regexp_replace(strip(c), "/+$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"/music/api/v1$", ""), "/+$", "")


def platform(c: Column) -> Column:
    """The platform of a link; null if it is of none."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(PLATFORMS):
        out = F.when(c.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def _found(c: Column, pattern: str) -> Column:
    got = F.regexp_extract(c, pattern, 1)
    return F.when(got != "", got)


def playlist_id(link: Column, of: Column) -> Column:
    """The list's id in a link of platform ``of``; null if there is none."""
    return F.when(of == "netease", _found(link, r"id=(\d+)")).when(
        of == "qq", F.coalesce(_found(link, r".*playlist/(\d+)"), _found(link, r"id=(\d+)"), _found(link, r"(?:tid|id)=([0-9]+)"))
    )


def share_link(c: Column) -> Column:
    """The link in a shared text: the platform's short link first, else any link, else the text."""
    return F.coalesce(_found(c, SHARE_LINK), _found(c, ANY_LINK), c)


def is_short_link(c: Column) -> Column:
    return F.coalesce(c.rlike("|".join(SHORT_LINKS.values())), F.lit(False))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def swap_extension(path: Column, to: Column) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit("."), F.regexp_replace(to, r"^\.", ""))


def below(path: Column, root: str, out: str, keep_structure: bool = True) -> Column:
    """The path's place under ``out``: its path below ``root``, or its bare name."""
    if not keep_structure:
        return F.concat(F.lit(out.rstrip("/") + "/"), base_name(path))
    lead = root.rstrip("/") + "/"
    inside = F.when(path.startswith(lead), F.substring(path, len(lead) + 1, 1 << 20)).otherwise(base_name(path))
    return F.concat(F.lit(out.rstrip("/") + "/"), inside)


def song_text(name: Column, artist: Column, style: str = "song-singer") -> Column:
    """A song in one line; without an artist the name alone."""
    if style == "song":
        return name
    parts = (artist, name) if style == "singer-song" else (name, artist)
    return F.when(artist == "", name).otherwise(F.concat(parts[0], F.lit(" - "), parts[1]))
