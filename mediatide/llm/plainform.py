"""Text that looks the same but consists of other characters, brought to one form.

Every token is resolved to the set of scripts it could be written in: each letter contributes the scripts that
have a letter of its looks, and the sets are intersected over the token. A token whose letters are of several
scripts is mixed; a token of one script whose set also holds the script of its surroundings is a whole-script
confusable. Both are respelt in the consistent script; letters that are only nearly alike (к and k) count where no
other script holds the whole token, and a token that none holds stays as it is and is reported. The rest (full-width and other compatibility forms, loose
combining marks, odd blanks, invisible characters) is normalised; whole emoji and CJK brackets are left alone.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: letters of the same looks in Latin, Cyrillic and Greek (a dot where a script has none)
_ALIKE = (
    "AАΑ BВΒ CСϹ EЕΕ G Ԍ. HНΗ IІΙ JЈ. KКΚ MМΜ N.Ν OОΟ PРΡ QԚ. SЅ. TТΤ VѴ. WԜ. XХΧ YҮΥ YУΥ Z.Ζ "
    "aаα cсϲ eе. hһ. iіι jјϳ k.κ lӏ. n.η oоο pрρ sѕ. u.υ vѵν xхχ yуγ dԁ. qԛ. wԝ."
).replace("G Ԍ", "GԌ")
# fixed values: letters that are taken for each other within a word of another script, though they differ alone
_NEARLY = "kк. tтτ mм. bв. hн. rг. nп. uи. eєε wшω oσσ fғ. FҒϜ NИ. RЯ. UЏ."
# fixed values: capitals of Cherokee, Lisu and Armenian with the looks of Latin letters
_OTHER = "ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᎡR ᏚS ᎢT ᏙV ᎳW ᏃZ ꓮA ꓐB ꓚC ꓓD ꓰE ꓝF ꓖG ꓧH ꓲI ꓙJ ꓗK ꓡL ꓟM ꓠN ꓳO ꓑP ꓣR ꓢS ꓔT ꓴU ꓦV ꓪW ꓫX ꓬY ꓜZ օo սu հh ոn ցg զq ՏS ՍU ՕO"
# fixed values: letters that are read as others but that nothing is respelt with
_RARE = "ϲϹϳԌҮԚԜѴѵԁԛԝӏһҒғϜЏ"
_SCRIPTS = "LCG"
MOST_PASSES = 6
#: For each letter the scripts that have one like it, that letter, and whether it is only nearly like it.
_LIKE: dict[str, dict[str, tuple[str, bool]]] = {}
for _rows, _weak in ((_ALIKE, False), (_NEARLY, True)):
    for _cells in _rows.split():
        for _s, _c in zip(_SCRIPTS, _cells, strict=True):
            if _c != ".":
                for _t, _d in zip(_SCRIPTS, _cells, strict=True):
                    if _d != "." and _d not in _RARE and _t != _s:
                        _LIKE.setdefault(_c, {}).setdefault(_t, (_d, _weak))
_LIKE |= {pair[0]: {"L": (pair[1], False)} for pair in _OTHER.split()}
#: Latin letters of odd shape for the ordinary ones: small capitals by their Unicode names, and script forms.
_ODD_LATIN = {"ɡ": "g", "ɑ": "a"} | {
    c: m[1].lower() for c in map(chr, (*range(0x250, 0x2B0), *range(0x1D00, 0x1D26), *range(0xA730, 0xA732), 0xA7AF)) if (m := re.fullmatch("LATIN LETTER SMALL CAPITAL ([A-Z])", unicodedata.name(c, "")))
}
#: Letters that compatibility normalisation would turn into others before their script is known.
_EARLY = frozenset(c for c in _LIKE if unicodedata.normalize("NFKC", c) != c)

_BLANK = re.compile("[\t\n\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_UNSEEN = re.compile(
    "[\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f\xad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f"
    "\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff0-\ufffb\U000e0000-\U000e0fff]"
)
_PICTURE = "[\xa9\xae\u203c-\u2bff\U0001f000-\U0001faff]"
_STYLED = "[\ufe0f\U0001f3fb-\U0001f3ff]*"
_EMOJI = re.compile(f"{_PICTURE}{_STYLED}(?:\u200d{_PICTURE}{_STYLED})*|[#*0-9]\ufe0f\u20e3")
_TOKEN = re.compile(r"[^\W\d_]+")
#: Compatibility characters that are ordinary for what is seen.
_KEEP = set("և（）｛｝…™©®ªº²³¹№℃°·～。、・ー") | {chr(c) for c in range(0x3131, 0x318F)}
_DASHES = {"\u2010": "-", "\u2011": "-", "\u2012": "-"}
#: The letters of each of the scripts, those without a look-alike included.
_LETTERS = [re.compile(r) for r in ("[A-Za-z\xaa\xb5\xba\xc0-\u02af\u1d00-\u1dbf\u1e00-\u1eff\u2071-\u209c\u212a\u212b\u2c60-\u2c7f\ua720-\ua7ff\uab30-\uab6f\ufb00-\ufb06\uff21-\uff5a]", "[\u0400-\u052f\u1c80-\u1c8f\u2de0-\u2dff\ua640-\ua69f]", "[\u0370-\u03ff\u1f00-\u1fff]", "[\u0530-\u058f\u13a0-\u13ff\uab70-\uabbf\ua4d0-\ua4ff]")]
_TURKIC = re.compile("[ğĞşŞİ]")
_WIDE = re.compile("[\uff01-\uff07\uff0a-\uff5a\u3000]")


@lru_cache(maxsize=1 << 14)
def _script(c: str) -> str:
    """L, C or G; O for the other scripts with letters of Latin looks; empty for a letter of any other script."""
    o = ord(c)
    if o < 0x250:
        return "L" if c.isalpha() else ""
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "G"
    if 0x400 <= o < 0x530 or 0x1C80 <= o < 0x1C90 or 0x2DE0 <= o < 0x2E00 or 0xA640 <= o < 0xA6A0:
        return "C"
    if 0x530 <= o < 0x590 or 0x13A0 <= o < 0x1400 or 0xAB70 <= o < 0xABC0 or 0xA4D0 <= o < 0xA500:
        return "O"
    return "L" if unicodedata.name(c, "").startswith("LATIN") else ""


@lru_cache(maxsize=1 << 14)
def _ordinary(c: str) -> str:
    """The ordinary character or characters for one compatibility character."""
    if c in _DASHES:
        return _DASHES[c]
    return _ODD_LATIN.get(c, c) if c in _KEEP or c in _ODD_LATIN else unicodedata.normalize("NFKC", c)


@lru_cache(maxsize=1 << 12)
def _could_be(c: str) -> dict[str, tuple[str, bool]]:
    """The scripts that have a letter of the looks of ``c``, as in ``_LIKE``; accents don't change the script."""
    own = {_script(c): (c, False)}
    return own if len(unicodedata.normalize("NFD", c)) > 1 else own | _LIKE.get(c, {})


class _Token:
    """A token's letters of the scripts concerned, and what the intersection of their script sets leaves."""

    def __init__(self, text: str, start: int):
        self.text, self.start = text, start
        letters = [c for c in text if _script(c)]
        self.used = {_script(c) for c in letters}
        could = [_could_be(c) for c in letters]
        #: for each script that the whole token could be in: letters that are only nearly alike, and letters to respell
        self.whole = {
            s: (sum(can[s][1] for can in could), sum(_script(c) != s for c in letters)) for s in _SCRIPTS if could and all(s in can for can in could)
        }
        #: the scripts that have every letter exactly
        self.exact = [s for s, (weak, _) in self.whole.items() if not weak]

    def spelt(self, script: str) -> str:
        return "".join(_could_be(c)[script][0] if _script(c) not in ("", script) else c for c in self.text)

    def resolved(self, sure: dict[str, int]) -> str | None:
        """The script the token is to be spelt in, or None if it is consistent or no script holds all of it."""
        if len(self.used) > 1:
            if len(self.exact) > 1:
                return max(self.exact, key=lambda s: (sure.get(s, 0), -self.whole[s][1]))
            # a letter that is only nearly alike counts as three
            return min(self.whole, key=lambda s: (2 * self.whole[s][0] + self.whole[s][1], -sure.get(s, 0))) if self.whole else None
        (own,) = self.used
        if len(self.exact) < 2 or own in sure or own == "L" and len(self.text) < 2:
            return None
        near = [s for s in self.exact if s in sure]
        return max(near, key=lambda s: sure[s]) if near else None


def _one_script(text: str) -> bool:
    """Whether letters of at most one of the scripts concerned are in the text: then no token can be mixed or confused."""
    return sum(bool(p.search(text)) for p in _LETTERS) < 2


def _tokens(text: str) -> list[_Token]:
    found = [_Token(m[0], m.start()) for m in _TOKEN.finditer(text)]
    return [t for t in found if t.used]


def _consistent(text: str, only: frozenset[str] | None = None) -> str:
    """The text with mixed and whole-script confusable tokens respelt; with ``only`` those that hold such a letter.

    A respelt token is of one script; a mixed token that no script holds all of is left as it is.
    """
    if _one_script(text):
        return _dotted(text)
    tokens = _tokens(text)
    # scripts that the surroundings fix beyond doubt
    sure: dict[str, int] = {}
    for t in tokens:
        if len(t.used) == 1 and len(t.exact) == 1 and t.exact[0] in t.used:
            (s,) = t.used
            sure[s] = sure.get(s, 0) + len(t.text)
    out, at = [], 0
    for t in tokens:
        to = t.resolved(sure) if only is None or not only.isdisjoint(t.text) else None
        if to:
            out += [text[at : t.start], t.spelt(to)]
            at = t.start + len(t.text)
    out = "".join(out) + text[at:]
    return _dotted(out)


def _dotted(text: str) -> str:
    """Dotless i for the ordinary one, unless other letters or a second one show that the text is Turkic."""
    if "ı" not in text or _TURKIC.search(text) or any(m[0].count("ı") > 1 for m in _TOKEN.finditer(text)):
        return text
    return text.replace("ı", "i")


def still_mixed(text: str) -> bool:
    """Whether a token of Latin, Cyrillic and Greek letters is of several scripts."""
    return not _one_script(text) and any(len(t.used) > 1 for t in _tokens(text))


def plain(text: str) -> str:
    """The one consistent form of a text. Blanks keep their number; an empty text stays empty."""
    if text.isascii() and text.isprintable():
        return text
    if not _EARLY.isdisjoint(text):
        text = _consistent(text, _EARLY)
    parts, at = [], 0
    for m in _EMOJI.finditer(text):
        if unicodedata.category(m[0][0]) != "So" and "\ufe0f" not in m[0]:
            continue
        parts += [_plain_span(text[at : m.start()]), m[0]]
        at = m.end()
    parts.append(_plain_span(text[at:]))
    form, before = "".join(parts), ""
    # a respelt token may be what settles another, and its letters may take up an accent
    for _ in range(MOST_PASSES):
        if form == before:
            break
        form, before = unicodedata.normalize("NFC", _consistent(form)), form
    return form


def _plain_span(text: str) -> str:
    if not text or text.isascii() and text.isprintable():
        return text
    if _odd_brackets(text):
        text = text.translate({0xFF08: "(", 0xFF09: ")", 0xFF5B: "{", 0xFF5D: "}"})
    text = _BLANK.sub(" ", _UNSEEN.sub("", text))
    return unicodedata.normalize("NFC", "".join(c if c < "\x80" else _ordinary(c) for c in text))


def _odd_brackets(text: str) -> bool:
    """Whether full-width brackets are no CJK brackets here: unpaired, or amid other full-width forms."""
    return text.count("（") != text.count("）") or bool(_WIDE.search(text))


def plain_udf(column: Column) -> Column:
    """``plain`` over a column, a batch at a time; null stays null."""

    @F.pandas_udf("string")
    def run(batches: Iterator) -> Iterator:
        for texts in batches:
            yield texts.map(lambda t: t if t is None or t.isascii() and t.isprintable() else plain(t))

    return run(column)


def _judged(df: DataFrame, src: str, key: str, column: str) -> DataFrame:
    """``(src, row_key, original, plain_text, mixed)``; each different text of a batch is looked at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            texts = coded.dictionary.to_pylist()
            form = [t if t.isascii() and t.isprintable() else plain(t) for t in texts]
            mixed = [not f.isascii() and still_mixed(f) for f in form]
            yield pa.RecordBatch.from_arrays(
                [pa.array([src] * batch.num_rows, pa.string()), batch.column(0), batch.column(1), pa.array(form, pa.string()).take(coded.indices), pa.array(mixed, pa.bool_()).take(coded.indices)],
                names=["src", "row_key", "original", "plain_text", "mixed"],
            )

    cols = df.select(F.col(key).cast("string").alias("row_key"), F.col(column).alias("original"))
    return cols.mapInArrow(run, "src string, row_key string, original string, plain_text string, mixed boolean")


def consistent_texts(df: DataFrame, src: str, key: str, column: str) -> DataFrame:
    """``(src, row_key, original, plain_text)`` of every row of ``df``; null and empty texts come out unchanged.

    Extra columns are not read. Repeated rows come out each for themselves.
    """
    return _judged(df, src, key, column).drop("mixed")


def not_plain(df: DataFrame, src: str, key: str, column: str) -> DataFrame:
    """``(src, row_key)`` of the rows whose text is not in its plain form, or has none as a word stays mixed.

    A text of printable ASCII is always plain and never leaves the JVM.
    """
    odd = df.where(F.col(column).rlike(r"[^\x20-\x7e]"))
    return _judged(odd, src, key, column).where(~F.col("original").eqNullSafe(F.col("plain_text")) | F.col("mixed")).select("src", "row_key")
