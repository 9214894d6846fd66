"""Typed song titles mapped to a canonical list, in SQL only.

A partition-based pigeonhole join: a canonical title that may take ``k`` errors is cut into ``k + 1`` segments, and
a typed title within ``k`` errors holds at least one of them unchanged, at a place that differs from its own by no
more than the errors allow. Segments and positional substrings meet in an equality join; the built-in
``levenshtein`` verifies. What is left without an entry is reported through an anti-join. Work is done once per
distinct title and artist, per distinct name and per distinct pair of names, not per row.
"""

from __future__ import annotations

import unicodedata
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..functions.names import GIVEN_SHORT_FORMS, GIVEN_TWO_WAYS, GROUP_KINDS, group_pattern
from ..session import cut
from .roman import CYRILLIC, GREEK, HANGUL, KANA, KANJI_WORDS, KOREAN_WORDS, LATIN, PINYIN, SIMPLIFIED, romanise

#: What is typed, in a value of fixed size: rows of equal title and artist are one wish.
WISH = "unhex(md5(concat(length(title), ' ', title, coalesce(concat('|', artist), ''))))"
#: Beyond this many entries the canonical list's segments are joined by shuffle instead of broadcast.
MAX_BROADCAST_ENTRIES = 50_000


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _fold_table() -> dict[str, str]:
    """Single characters to what they look like or stand for: built by rule from Unicode, then lower-case look-alikes."""
    table: dict[str, str] = {}
    for a, b in ((0xFF01, 0xFF5F), (0xC0, 0x250), (0x1E00, 0x1F00), (0x3040, 0x3100), (0xFF66, 0xFF9E), (0x2F00, 0x2FD6), (0x386, 0x3CF), (0x400, 0x460), (0xFB00, 0xFB07)):
        for o in range(a, b):
            c = chr(o)
            to = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", c))[:1].lower()
            if to and to != c:
                table[c] = to
    table |= {c: to for c, to in LATIN.items() if len(to) == 1} | {"Đ": "d", "Ø": "o", "Ł": "l"}
    for c in "               　\t_":
        table[c] = " "
    table |= dict.fromkeys("‐‑‒–—", "-") | {"＿": " "}
    # fixed values: lower-case letters of other scripts that look like Latin ones
    alike = dict(zip("аеорсхуіјѕһвнмткαορνικχυτμηεζβγ", "aeopcxyijshbhmtkaopvikxutmhezby", strict=True))
    for c, to in list(table.items()):
        table[c] = alike.get(to, SIMPLIFIED.get(to, to))
    for c, to in (alike | SIMPLIFIED).items():
        table.setdefault(c, to)
        table.setdefault(c.upper(), to)
    return {c: t for c, t in table.items() if len(c) == 1 and c != t}


_FOLD = _fold_table()
_INVISIBLE = r"[\\p{Cf}\\p{Mn}\\u034f\\u115f\\u1160\\u3164\\u180e]"
# fixed values: notes on version or quality at the end of a title
_NOTES = "live|live版|hq|hi-?res|flac|mp3|wav|ape|dsd|320k|128k|无损|完整版|现场|现场版|伴奏|原声带|专辑版|demo|radio edit|remaster(?:ed)?(?: \\\\d{4})?|official (?:audio|video)|acoustic(?: version)?|bonus track|mv|hd|lyrics"
_NUMBER = r"(?<![\\p{L}\\p{N}])\\d+(?![\\p{L}\\p{N}])"
_EAST = r"[\\u3040-\\u30ff\\u3400-\\u9fff\\uac00-\\ud7a3]"


def fold_sql(column: str) -> str:
    """Lower case, one character for all that look alike, nothing invisible."""
    return f"lower(translate(regexp_replace({column}, '{_INVISIBLE}', ''), {_quote(''.join(_FOLD))}, {_quote(''.join(_FOLD.values()))}))"


def key_sql(column: str) -> str:
    """Letters and digits without stand-alone numbers and a leading article."""
    return f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({column}, '\\\\bpart\\\\b', 'pt'), '^\\\\s*the ', ''), '{_NUMBER}', ''), '[^\\\\p{{L}}\\\\p{{N}}]', '')"


def numbers_sql(column: str) -> str:
    """The stand-alone numbers, in order."""
    return f"array_join(regexp_extract_all({column}, '({_NUMBER})', 1), ' ')"


_ERRORS = "CASE WHEN {n} <= 2 THEN 0 WHEN {n} = 3 THEN 1 ELSE 2 END"


def _roman_sql(column: str) -> str:
    """Latin letters for every other script, by lookup of single characters."""
    table = {c: r for c, r in (PINYIN | KANA).items()} | CYRILLIC | GREEK | LATIN
    known, readings = _quote("".join(table)), "array(" + ", ".join(map(_quote, table.values())) + ")"
    initial, vowel, final = ("array(" + ", ".join(_quote(x) for x in part) + ")" for part in HANGUL)
    o = "(ascii(c) - 44032)"
    hangul = f"concat(element_at({initial}, cast({o} div 588 as int) + 1), element_at({vowel}, cast(({o} % 588) div 28 as int) + 1), element_at({final}, cast({o} % 28 as int) + 1))"
    # letters of Hangul written loose: initials, vowels and finals have ranges of their own
    jamo = f"WHEN ascii(c) BETWEEN 4352 AND 4370 THEN element_at({initial}, cast(ascii(c) - 4351 as int)) WHEN ascii(c) BETWEEN 4449 AND 4469 THEN element_at({vowel}, cast(ascii(c) - 4448 as int)) WHEN ascii(c) BETWEEN 4520 AND 4546 THEN element_at({final}, cast(ascii(c) - 4518 as int))"
    letters = f"array_join(transform(split({{s}}, ''), c -> CASE WHEN ascii(c) < 128 THEN c WHEN ascii(c) BETWEEN 44032 AND 55203 THEN {hangul} {jamo} ELSE coalesce(try_element_at({readings}, nullif(instr({known}, c), 0)), c) END), '')"
    words = column
    for w, r in KOREAN_WORDS.items():
        words = f"replace({words}, {_quote(w)}, {_quote(r)})"
    kana = words
    for w, r in KANJI_WORDS.items():
        kana = f"replace({kana}, {_quote(w)}, {_quote(r)})"
    words = f"CASE WHEN {column} RLIKE '[\\\\u30a1-\\\\u30f6]' THEN {kana} ELSE {words} END"
    return f"CASE WHEN {column} RLIKE '^[\\\\x00-\\\\x7f]*$' THEN {column} ELSE {letters.format(s=f'({words})')} END"


def _name_sql(column: str) -> str:
    """A typed name in lower case with simplified characters, without accents on Latin letters, brackets and outer marks."""
    accents = {c: unicodedata.normalize("NFD", c)[0].lower() for a, b in ((0xC0, 0x250), (0x1E00, 0x1F00)) for c in map(chr, range(a, b)) if unicodedata.normalize("NFD", c)[0] != c}
    table = accents | SIMPLIFIED | {"ø": "o", "Ø": "o", "đ": "d", "Đ": "d", " ": " ", "　": " "}
    spaced = f"regexp_replace({column}, '(?<=[a-zà-ÿа-яё])(?=[A-ZÀ-ÞА-ЯЁ])', ' ')"
    return f"lower(translate({spaced}, {_quote(''.join(table))}, {_quote(''.join(table.values()))}))"


def _words_sql(column: str) -> str:
    """Sorted words of a romanised name, short forms written out."""
    groups = column
    for kind in GROUP_KINDS:
        pattern = group_pattern(kind).replace("\\", "\\\\")
        groups = f"regexp_replace({groups}, '{pattern}', {_quote(kind)})"
    short = {romanise(k): romanise(GIVEN_TWO_WAYS.get(k, (v,))[0]) for k, v in GIVEN_SHORT_FORMS.items()}
    table = ", ".join(f"{_quote(a)}, {_quote(b)}" for a, b in short.items())
    words = f"filter(split({groups}, '[^a-z0-9\\\\u3400-\\\\u9fff]+'), w -> w <> '' AND w NOT IN ('the', 'of', 'and'))"
    return f"array_sort(transform({words}, w -> coalesce(try_element_at(map({table}), w), w)))"


_MARKS = r"\\s*(?:[;|/\\t、，；｜]|\\\\\\\\|\\s[&+]\\s|\\s(?:feat\\.?|ft\\.?|featuring|vs\\.?|x)\\s|[\\(\\[](?:with|feat\\.?|ft\\.?|featuring)\\s)"


def match_titles(spark: SparkSession, typed: DataFrame, catalog: DataFrame) -> DataFrame:
    """``(src, row_key, catalog_id)``: for each typed row the entry it means, 0 if there is none.

    ``typed`` has src, row_key, title and artist (the field as typed; its first value counts); rows whose title is
    null or empty give no row. ``catalog`` has catalog_id, title, artist. An entry is meant if the titles agree
    within the errors allowed for their length, in every stand-alone number, and the artists agree in some
    spelling; without an artist (null, empty or ``未知歌手``) the title decides. Nearer titles win, then the lower id.
    """
    few = catalog.select("catalog_id").limit(MAX_BROADCAST_ENTRIES + 1).count() <= MAX_BROADCAST_ENTRIES
    views = {name: f"_titles_{uuid.uuid4().hex}_{name}" for name in ("typed", "catalog", *STEPS)}
    typed.where("title IS NOT NULL AND title <> ''").createOrReplaceTempView(views["typed"])
    catalog.createOrReplaceTempView(views["catalog"])
    out = typed
    for name in STEPS:
        out = spark.sql(statement(name, views, few))
        # what later steps read more than once is written once; this also keeps every plan small
        out = out if name in ("entry", "found") else cut(out)
        out.createOrReplaceTempView(views[name])
    for view in views.values():
        spark.catalog.dropTempView(view)
    return out


STEPS = ("entry", "reading", "close", "candidate", "spelling", "agreed", "meant", "found")


def statement(name: str, views: dict[str, str], few: bool = True) -> str:
    """The SQL of one step over the views of the steps before; ``few``: the catalog may be broadcast."""
    typed, catalog, entry, reading, close, candidate, spelling, agreed, meant = (views[n] for n in ("typed", "catalog", *STEPS[:-1]))
    hint = "/*+ BROADCAST(s) */" if few else ""
    hint_c = "/*+ BROADCAST(e) */" if few else ""
    hint_e = "/*+ BROADCAST(y) */" if few else ""
    if name == "entry":
        return f"""SELECT DISTINCT catalog_id, entry_artist, entry_text, ref, numbers FROM (
    SELECT catalog_id, artist AS entry_artist, f AS entry_text, {key_sql('f')} AS ref1, {numbers_sql('f')} AS numbers FROM (SELECT catalog_id, artist, {fold_sql('title')} AS f FROM {catalog})
  ) LATERAL VIEW explode(CASE WHEN ref1 RLIKE '[\\uac00-\\ud7a3]' THEN array(ref1, {_roman_sql('ref1')}) ELSE array(ref1) END) x AS ref"""
    if name == "reading":
        return f"""WITH folded AS (
  SELECT wish, artist, trim(regexp_replace(regexp_replace({fold_sql('title')}, '\\\\s+', ' '), '^\\\\s*\\\\d{{1,3}}\\\\s*(?:[.)、]|-\\\\s)\\\\s*', '')) AS a
  FROM (SELECT DISTINCT {WISH} AS wish, title, artist FROM {typed})
), bare AS (
  SELECT *, trim(regexp_replace(a, '[\\\\(\\\\[（【《〈{{][^\\\\)\\\\]）】》〉}}]*[\\\\)\\\\]）】》〉}}]', ' ')) AS b FROM folded
), noted AS (
  SELECT wish, artist, regexp_replace(CASE WHEN b RLIKE '[\\\\p{{L}}\\\\p{{N}}]' THEN b ELSE a END, '(?:[\\\\s\\\\-]+(?:{_NOTES}))+[^\\\\p{{L}}\\\\p{{N}}]*$', '') AS c FROM bare
)
SELECT wish, x.a AS artist, x.v AS v, CASE WHEN x.v RLIKE '[\\u1100-\\u11ff]' THEN {_roman_sql(key_sql('x.v'))} ELSE {key_sql('x.v')} END AS q, {numbers_sql('x.v')} AS numbers
  FROM noted LATERAL VIEW explode(array_distinct(array(
    struct(c AS v, artist AS a), struct(regexp_replace(c, '^.*? - ', '') AS v, artist AS a),
    -- what stands behind the dash tells the artist where the field doesn't
    struct(regexp_replace(c, ' - .*$', '') AS v, CASE WHEN coalesce(artist, '') = '' AND c LIKE '% - %' THEN regexp_replace(c, '^.*? - ', '') ELSE artist END AS a),
    struct(CASE WHEN levenshtein(split(c, ' ')[0], 'the', 1) >= 0 OR split(c, ' ')[0] IN ('teh', 'hte') THEN regexp_replace(c, '^[^ ]+ ', '') ELSE c END AS v, artist AS a)
  ))) t AS x"""
    if name == "close":
        return f"""WITH ref AS (
  SELECT DISTINCT ref, length(ref) AS n, {_ERRORS.format(n='length(ref)')} AS k FROM {entry} WHERE ref <> ''
), segment AS (
  SELECT ref, n, k, i, substring(ref, cast(floor(i * n / (k + 1)) as int) + 1, cast(floor((i + 1) * n / (k + 1)) - floor(i * n / (k + 1)) as int)) AS piece
  FROM ref LATERAL VIEW explode(sequence(0, k)) x AS i
), query AS (
  SELECT DISTINCT q, length(q) AS m FROM {reading} WHERE q <> ''
), place AS (
  SELECT q, m, n, i, s, cast(floor(i * n / (k + 1)) as int) AS at, cast(floor((i + 1) * n / (k + 1)) - floor(i * n / (k + 1)) as int) AS size
  FROM (SELECT q, m, n, {_ERRORS.format(n='n')} AS k FROM query LATERAL VIEW explode(sequence(greatest(1, m - 2), m + 2)) x AS n)
  LATERAL VIEW explode(sequence(0, k)) y AS i LATERAL VIEW explode(sequence(-k, k)) z AS s
  WHERE abs(m - n) <= k AND abs(s) + abs(m - n - s) <= k
), near AS (
  SELECT DISTINCT q, ref FROM (
    SELECT {hint} p.q, s.ref, s.k FROM place p JOIN segment s ON p.n = s.n AND p.i = s.i AND substring(p.q, p.at + p.s + 1, p.size) = s.piece
    WHERE p.at + p.s >= 0 AND p.at + p.s + p.size <= p.m
  ) WHERE levenshtein(q, ref, k) >= 0
)
SELECT q, ref, d FROM (
    SELECT q, ref, levenshtein(q, ref) AS d, ref RLIKE '{_EAST}' AS east, length(ref) AS n,
      array_sort(split(q, '')) = array_sort(split(ref, '')) AS swapped FROM near
  ) WHERE d <= CASE WHEN east OR n < 6 THEN 1 ELSE 2 END OR swapped"""
    if name == "candidate":
        return f"""SELECT {hint_c} r.wish, r.artist, r.v, e.catalog_id, e.entry_artist, e.entry_text, c.d
  FROM {reading} r JOIN {close} c ON r.q = c.q JOIN {entry} e ON c.ref = e.ref AND r.numbers = e.numbers"""
    if name == "spelling":
        # every name once: as typed, and as the catalogue has it
        return f"""WITH name AS (
  SELECT DISTINCT artist AS name, true AS typed FROM {candidate} WHERE artist <> '' UNION ALL SELECT DISTINCT entry_artist AS name, false AS typed FROM {candidate} WHERE artist <> ''
), plain AS (
  SELECT typed, name, {_name_sql("CASE WHEN typed THEN regexp_replace(name, '^[^\\\\p{L}\\\\p{N}]+', '') ELSE name END")} AS x FROM name
), first AS (
  SELECT typed, name, regexp_replace(x, '[^\\\\p{{L}}\\\\p{{N}}]', '') AS letters, explode(CASE WHEN typed THEN array_distinct(array(x0, split(x0, ',')[0])) ELSE array(x) END) AS x
  FROM (SELECT *, regexp_replace(split(x, '{_MARKS}')[0], '\\\\s*[\\\\(（].*$|["\\']', '') AS x0 FROM plain)
), latin AS (
  SELECT typed, name, letters, {_roman_sql('x')} AS x FROM first
)
SELECT typed, name, letters, regexp_replace(x, '[^a-z0-9\\\\u3400-\\\\u9fff]|^the ', '') AS run, {_words_sql('x')} AS words FROM latin"""
    if name == "agreed":
        return f"""WITH pair AS (
  SELECT DISTINCT artist, entry_artist FROM {candidate} WHERE artist <> ''
), shaped AS (
  SELECT {hint_e} p.artist, p.entry_artist, x.letters AS x_all, y.letters AS y_all, x.run AS x1, y.run AS y1, y.words AS yw,
    array_join(x.words, '') AS x2, array_join(y.words, '') AS y2, array_join(filter(x.words, w -> length(w) > 1), '') AS x3,
    try_element_at(filter(x.words, w -> length(w) = 1), 1) AS letter, filter(x.words, w -> length(w) > 1) AS long
  FROM pair p JOIN (SELECT * FROM {spelling} WHERE typed) x ON p.artist = x.name JOIN (SELECT * FROM {spelling} WHERE NOT typed) y ON p.entry_artist = y.name
)
SELECT DISTINCT artist, entry_artist FROM shaped
  WHERE x1 = y1 OR x2 = y2 OR x3 = y2
    OR length(y1) > 3 AND startswith(x_all, y_all) AND length(y_all) > 3
    OR levenshtein(x1, y1, CASE WHEN length(y1) < 5 THEN 0 WHEN length(y1) < 8 THEN 1 ELSE 2 END) >= 0
    OR levenshtein(x2, y2, CASE WHEN length(y2) < 5 THEN 0 WHEN length(y2) < 8 THEN 1 ELSE 2 END) >= 0
    OR levenshtein(x3, y2, CASE WHEN length(y2) < 5 THEN 0 WHEN length(y2) < 8 THEN 1 ELSE 2 END) >= 0
    OR (letter IS NOT NULL AND size(long) = 1 AND size(yw) = 2 AND exists(yw, w -> levenshtein(w, try_element_at(long, 1), 1) >= 0 AND exists(yw, u -> u <> w AND startswith(u, letter))))"""
    if name == "meant":
        # two errors that make another word of the catalogue are no slip; joins on the words find such readings
        return f"""WITH word AS (
  SELECT DISTINCT w FROM (SELECT explode(split(entry_text, '[^\\\\p{{L}}]+')) AS w FROM {entry}) WHERE length(w) > 2
), changed AS (
  SELECT v, entry_text, explode(array_except(split(v, '[^\\\\p{{L}}]+'), split(entry_text, '[^\\\\p{{L}}]+'))) AS w FROM (SELECT DISTINCT v, entry_text FROM {candidate} WHERE d >= 2)
), wrong AS (
  SELECT DISTINCT v, entry_text FROM changed c LEFT SEMI JOIN word ON c.w = word.w
), kept AS (
  SELECT wish, artist, entry_artist, catalog_id, d FROM {candidate} WHERE d < 2
  UNION ALL SELECT c.wish, c.artist, c.entry_artist, c.catalog_id, c.d FROM {candidate} c LEFT ANTI JOIN wrong w ON c.v = w.v AND c.entry_text = w.entry_text WHERE c.d >= 2
)
SELECT c.wish, min(struct(c.d, c.catalog_id)) AS best
  FROM kept c LEFT JOIN {agreed} g ON c.artist = g.artist AND c.entry_artist = g.entry_artist
  WHERE c.artist IS NULL OR c.artist IN ('', '未知歌手') OR g.artist IS NOT NULL
  GROUP BY c.wish"""
    # wishes are mapped or reported, then all rows of one get its entry; where a wish holds very many rows the adaptive
    # join splits them
    return f"""SELECT t.src, t.row_key, o.catalog_id FROM (SELECT src, row_key, {WISH} AS wish FROM {typed}) t JOIN (
  SELECT wish, best.catalog_id AS catalog_id FROM {meant}
  UNION ALL
  SELECT r.wish, 0L AS catalog_id FROM (SELECT DISTINCT wish FROM {reading}) r LEFT ANTI JOIN {meant} m ON r.wish = m.wish
) o ON t.wish = o.wish
"""
