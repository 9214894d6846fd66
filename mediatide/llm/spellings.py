"""Typed spellings of the same name, linked within a scope (a library).

1. The distinct names of a scope are read into a comparable form: one script, one order of parts, short forms of
   given names and of kinds of ensembles written out. The longest suffix of a form is the form itself: the names of
   that block have a ratio of 1 and are one form from then on.
2. Suffix blocking: suffixes of each part (and of the part read backwards, for errors at its end) above a minimum
   length are indexed. A suffix that too many forms share is not dropped but refined with the initial of the other
   part. Where that isn't enough, the block is refined with all of the other part and with what is left of this part
   without one letter: two parts that one wrong letter tells apart always share that, so nothing is lost, and how
   many forms can share it doesn't grow with the data. Every block is compared completely.
3. Pairs are compared by the ratio of the longest common subsequence, part by part: a part may differ by what one
   wrong letter costs in a part of its length, the other part must be the same or its initial. Two forms that are
   both canonical are never taken for slips of each other; how many scopes a form is found in decides nothing, as
   that grows with the data.
4. Every form points to its best more frequent partner; pointers are followed to the end. Names whose forms end at
   the same one are spellings of one entity.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import GIVEN_SHORT_FORMS, GIVEN_TWO_WAYS, group_kind
from ..operators.multivalue import MAX_PROTECTED, Grammar, split_fields
from ..session import cut
from .roman import romanise, simplify

#: Shortest suffix indexed, and number of forms beyond which a suffix is refined.
LEAST_SUFFIX, COMMON = 2, 48
#: So many keys of refined suffixes are handed to every task; beyond that they are joined by shuffle.
MAX_BROADCAST_KEYS = 200_000
#: Letters of a name without parts that may hold two wrong ones.
LONG = range(14, 65)
#: What a fitting initial is worth beside a given name written out.
INITIAL = 0.6
UNKNOWN = ("", "未知歌手")

_CAMEL = re.compile(r"(?<=[a-zà-ÿа-яё])(?=[A-ZÀ-ÞА-ЯЁ])")
_BRACKET = re.compile(r"\s*[(（][^()（）]*[)）]\s*$")
_EASTERN = re.compile(r"[㐀-鿿ァ-ヶ가-힣]")
_FULL = {romanise(k): tuple(romanise(x) for x in GIVEN_TWO_WAYS.get(k, (v,))) for k, v in GIVEN_SHORT_FORMS.items()}


def givens_of(names: list[str]) -> frozenset[str]:
    """Given names (romanised) of a canonical list: first parts of names of two parts."""
    two = [n.split() for n in names if n and len(n.split()) == 2 and not _EASTERN.search(n)]
    firsts: dict[str, set[str]] = {}
    for a, b in two:
        firsts.setdefault(romanise(a), set()).add(b)
    known = {g for g, seconds in firsts.items() if len(seconds) >= 2 and g != "the"}
    return frozenset(known | {x for v in _FULL.values() for x in v})


def read_name(name: str, givens: frozenset[str]) -> tuple[str, str, str]:
    """``(form, given, rest)``: the comparable form, and for people the given name (alternatives by ``|``) and the rest."""
    text = unicodedata.normalize("NFKC", name).strip().strip("\"'")
    bare = _BRACKET.sub("", text)
    text = bare or text
    text = simplify(text)
    if _EASTERN.search(text):
        joined = re.sub(r"[\s・·.\-]+", "", text)
        form = re.sub(r"[^0-9a-z㐀-鿿]", "", romanise(joined))
        return form, "", form
    parts = text.split()
    if len(parts) >= 3 and all(len(p) == 1 for p in parts):
        text = "".join(parts)
    text = _CAMEL.sub(" ", text)
    head, comma, tail = text.partition(",")
    if comma and head.strip() and tail.strip() and "," not in tail:
        text = f"{tail.strip()} {head.strip()}"
    low = romanise(text.replace("&", " and "))
    words = [w for w in re.split(r"[^0-9a-z']+", low.replace("-", "" if re.search("[а-яё]", text, re.I) or not _romaji(low) else " ")) if w]
    if "of" in words[1:-1]:
        k = words.index("of")
        if group_kind(tuple(words[:k])):
            words = words[k + 1 :] + words[:k]
    if len(words) > 1 and (words[0] == "the" or len(words) > 2 and 1 < len(words[0]) < 5 and alike(words[0], "the") and not _given_like(words[0], givens)):
        words = words[1:]
    if not words:
        return low.strip(), "", low.strip()
    for k in range(1, len(words)):
        full = group_kind(tuple(words[k:])) if len(words) - k < 3 else None
        if full:
            form = ("".join(words[:k]) + full).replace(" ", "")
            return form, "", form
    if 2 <= len(words) <= 3:
        core = [words[0], *[w for w in words[1:-1] if len(w) > 1], words[-1]]
        if len(core) == 2:
            a, b = core
            sure_a, sure_b = len(a) == 1 or _given_like(a, givens), len(b) == 1 or _given_like(b, givens)
            if not sure_a and not sure_b:
                sure_a, sure_b = _given_slip(a, givens), _given_slip(b, givens)
            if sure_b and not sure_a or len(b) == 1 < len(a):
                a, b = b, a
            if len(b) > 1 and (sure_a or sure_b):
                given = "|".join(_FULL.get(a, (a,)))
                return f"{given} {b}", given, b
    form = "".join(words)
    return form, "", form


def _romaji(low: str) -> bool:
    return bool(re.search(r"-(?:gakudan|koubou|shoukai|kurabu|za|zu|akdan|hapchangdan|club|band)\b", low))


def _given_like(word: str, givens: frozenset[str]) -> bool:
    return word in givens or word in _FULL


@lru_cache(maxsize=4)
def _given_index(givens: frozenset[str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for g in givens:
        for key in without_one(g):
            out.setdefault(key, []).append(g)
    return out


def _given_slip(word: str, givens: frozenset[str]) -> bool:
    if not 3 <= len(word) <= 1 + max(map(len, givens), default=0):
        return False
    index = _given_index(givens)
    return any(g != word and alike(word, g) for key in without_one(word) for g in index.get(key, ()))


def lcs_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over the summed lengths, by bit vectors."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    both = len(a) + len(b)
    # what both begin and end with is in some longest common subsequence
    k, most = 0, min(len(a), len(b))
    while k < most and a[k] == b[k]:
        k += 1
    e, most = 0, most - k
    while e < most and a[-1 - e] == b[-1 - e]:
        e += 1
    a, b = a[k : len(a) - e], b[k : len(b) - e]
    mask: dict[str, int] = {}
    for i, c in enumerate(a):
        mask[c] = mask.get(c, 0) | 1 << i
    s = full = (1 << len(a)) - 1
    for c in b:
        u = s & mask.get(c, 0)
        s = (s + u | s - u) & full
    return 2 * (k + e + len(a) - s.bit_count()) / both


def alike(a: str, b: str, errors: int = 1) -> float:
    """The ratio of the longest common subsequence of two parts, 0 if it is less than ``errors`` wrong letters leave."""
    if abs(len(a) - len(b)) > errors:
        return 0.0
    ratio = lcs_ratio(a, b)
    return ratio if ratio >= 1 - errors / max(len(a), len(b), 1) - 1e-9 else 0.0


def without_one(part: str, errors: int = 1) -> list[str]:
    """What is left of a part without up to ``errors`` letters; two parts within as many wrong letters share one of these."""
    if len(part) > 64:
        # by a digest, so that what is kept doesn't grow with the square of the part; one wrong letter is all that is allowed
        begin, out = hashlib.blake2b(digest_size=12), []
        for i, c in enumerate(part):
            if i + 1 == len(part) or part[i + 1] != c:
                h = begin.copy()
                h.update(part[i + 1 :].encode())
                out.append(h.hexdigest())
            begin.update(c.encode())
        return [*out, begin.hexdigest()]
    left = {part}
    for _ in range(errors):
        left |= {p[:i] + p[i + 1 :] for p in left for i in range(len(p))}
    return [p if len(p) < 64 else hashlib.blake2b(p.encode(), digest_size=12).hexdigest() for p in left]


def _errors(part: str, given: str) -> int:
    return 2 if not given and len(part) in LONG else 1


Form = tuple[str, str, str]


def likeness(a: Form, b: Form, settled: bool) -> float:
    """How well form ``a`` reads as another spelling of ``b``; 0 if it doesn't. ``settled``: both are canonical."""
    (fa, ga, ra), (fb, gb, rb) = a, b
    if settled and not (ga and gb and (len(ga) == 1 or len(gb) == 1)):
        return 0.0
    if bool(ga) != bool(gb):
        # one was read as a given name and a rest, the other as one word
        return max(alike(x, y) for x in _joined(a) for y in _joined(b)) * 0.8
    if not ga:
        return alike(fa, fb, min(_errors(fa, ga), _errors(fb, gb))) if min(len(fa), len(fb)) >= 4 else 0.0
    alts_a, alts_b = ga.split("|"), gb.split("|")
    rest = alike(ra, rb)
    if not rest:
        return 0.0
    if set(alts_a) & set(alts_b):
        return rest - 0.02 * (len(alts_a) + len(alts_b) - 2) if not settled and min(len(ra), len(rb)) >= 3 else 0.0
    if min(map(len, alts_a)) == 1 or min(map(len, alts_b)) == 1:
        return INITIAL * rest if {x[0] for x in alts_a} & {x[0] for x in alts_b} else 0.0
    return max(alike(x, y) for x in alts_a for y in alts_b) * 0.95 if ra == rb and not settled else 0.0


def _joined(form: Form) -> list[str]:
    full, given, rest = form
    return [g + rest for g in given.split("|")] if given else [full.replace(" ", "")]


def _parts(form: Form) -> list[tuple[str, str]]:
    """``(part, other)`` of a form: each part that is indexed, and the other part."""
    _, given, rest = form
    whole = [(w, "") for w in _joined(form)]
    if not given:
        return whole
    alts = given.split("|")
    return whole + [(rest, g) for g in alts] + [(g, rest) for g in alts if len(g) > 1]


def suffixes(part: str) -> list[str]:
    """The indexed suffixes of a part, and those of the part read backwards.

    About half of the part: two parts that one wrong letter tells apart share one or the other. Two lengths, as a
    letter more or less moves the half.
    """
    n = len(part)
    least = min(n, max(LEAST_SUFFIX, (n - 2) // 2))
    return [k for size in range(least, min(n, least + 1) + 1) for k in (">" + part[n - size :], "<" + part[:size])]


def _forms(names: DataFrame, grammar: Grammar, givens: frozenset[str]) -> DataFrame:
    """``(scope, name, weight, form, given, rest)`` of the names that hold one value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = split_fields(batch.column(1), grammar)
            size = np.diff(lists.offsets.to_numpy())
            one = batch.filter(pa.array(size == 1))
            read = [read_name(n, givens) for n in one.column(1).to_pylist()]
            cols = [pa.array([r[k] for r in read], pa.string()) for k in range(3)]
            keep = pa.array([bool(r[0]) for r in read], pa.bool_())
            yield pa.RecordBatch.from_arrays([*one.columns, *cols], names=["scope", "name", "weight", "form", "given", "rest"]).filter(keep)

    return names.mapInArrow(run, "scope bigint, name string, weight bigint, form string, given string, rest string")


_ROW = "scope bigint, form string, given string, rest string, weight bigint, official boolean"
_FIELDS = ["scope", "form", "given", "rest", "weight", "official"]


def _indexed(forms: DataFrame, known: set[str]) -> DataFrame:
    """The suffixes of each form's parts: the form's fields, ``suffix``, ``part`` and ``other``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, form in enumerate(zip(*(batch.column(c).to_pylist() for c in ("form", "given", "rest")), strict=True)):
                rows += [(k, s, part, other) for part, other in _parts(form) for s in suffixes(part)]
            at = pa.array([r[0] for r in rows], pa.int64())
            official = pa.array([f in known for f in batch.column("form").to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in _FIELDS[:5]), official.take(at), *(pa.array([r[k] for r in rows], pa.string()) for k in (1, 2, 3))], names=[*_FIELDS, "suffix", "part", "other"])

    return forms.select(*_FIELDS[:5]).mapInArrow(run, f"{_ROW}, suffix string, part string, other string")


def _left_over(rows: DataFrame) -> DataFrame:
    """The blocks of forms whose suffix even an initial leaves too common: all of the other part and this part without a
    letter. ``i|`` blocks are those of the other part's initial, where only bare initials are compared with the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for k, (part, other, given) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("part", "other", "given")), strict=True)):
                left = without_one(part, _errors(part, given))
                keys += [(k, f"d|{other}|{x}") for x in left]
                if other and other in given.split("|"):
                    keys += [(k, f"i|{other[:1]}|{x}") for x in left]
            at = pa.array([k for k, _ in keys], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in _FIELDS), pa.array([x for _, x in keys], pa.string())], names=[*_FIELDS, "key"])

    return rows.select(*_FIELDS, "part", "other").distinct().mapInArrow(run, f"{_ROW}, key string")


def compare_block(rows: list[tuple], bare: list[tuple] | None = None) -> Iterator[tuple]:
    """``(form, to, to weight, score)`` of the rows of a block that are alike, the less frequent pointing to the other.

    Rows are ``(form, given, rest, weight, official)``. With ``bare`` only rows against those.
    """

    def rank(r: tuple) -> tuple:
        return (not r[4], -r[3], r[0])

    rows = sorted(rows, key=rank)
    for i, x in enumerate(rows):
        for y in rows[:i] if bare is None else bare:
            if x[0] != y[0]:
                score = likeness(x[:3], y[:3], x[4] and y[4])
                if score:
                    lower, upper = (x, y) if rank(y) < rank(x) else (y, x)
                    yield lower[0], upper[0], upper[3], score


def _compared(keyed: DataFrame) -> DataFrame:
    """The likely links of all blocks. Blocks are bounded but for those of initials, which are passed through beside the
    few bare initials, and every form in them meets only those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, bare, found = None, [], [], []

        def send() -> pa.RecordBatch:
            cols = list(zip(*found, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64())
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["scope", "form", "to", "to_weight", "score"])

        for batch in batches:
            for scope, key, *row in zip(*(batch.column(c).to_pylist() for c in ("scope", "key", *_FIELDS[1:])), strict=True):
                if at != (scope, key):
                    if len(held) > 1:
                        found += [(at[0], *f) for f in compare_block(held)]
                    at, held, bare = (scope, key), [], []
                if key[0] != "i":
                    held.append(row)
                elif len(row[1]) == 1:
                    bare.append(row)
                elif bare:
                    found += [(scope, *f) for f in compare_block([row], bare)]
            if len(found) > 10_000:
                yield send()
        if len(held) > 1:
            found += [(at[0], *f) for f in compare_block(held)]
        yield send()

    placed = keyed.repartition("scope", "key").sortWithinPartitions("scope", "key", F.length("given") != 1)
    return placed.mapInArrow(run, "scope bigint, form string, to string, to_weight bigint, score double")


def likely_links(forms: DataFrame, known: set[str]) -> DataFrame:
    """``(scope, form, to, to_weight, score)``: every two forms that are alike, maybe more than once."""
    indexed = cut(_indexed(forms, known))
    initial = F.substring("other", 1, 1)
    # counted before anything is shuffled; only the suffixes that are too common go back to the index
    counts = indexed.groupBy("scope", "suffix", initial.alias("initial")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("scope", "suffix"))
    common = cut(counts.withColumn("total", total).where(F.col("total") > COMMON).select("scope", "suffix", "initial", (F.col("n") > COMMON).alias("over")))
    few = common.limit(MAX_BROADCAST_KEYS + 1).count() <= MAX_BROADCAST_KEYS
    met = indexed.withColumn("initial", initial).join(F.broadcast(common) if few else common, ["scope", "suffix", "initial"], "left")
    plain = met.where(F.col("over").isNull()).select(*_FIELDS, F.concat(F.lit("s|"), "suffix").alias("key"))
    refined = met.where(~F.col("over")).select(*_FIELDS, F.concat(F.lit("s|"), "initial", F.lit("|"), "suffix").alias("key"))
    return _compared(plain.unionByName(refined).unionByName(_left_over(met.where("over"))))


def entities(names: DataFrame, grammar: Grammar, canonical: list[str]) -> DataFrame:
    """``(scope, name, weight, form, entity)``: every name of one value with the form its entity is known by.

    ``names`` has ``scope`` (bigint), ``name`` and ``weight`` (rows). Null, empty and unknown names and names of
    several values take no part; names without letters or digits neither. A repeated name counts once.
    """
    givens = givens_of(canonical)
    known = {read_name(n, givens)[0] for n in canonical if n}
    read = cut(_forms(names, grammar, givens))
    forms = read.groupBy("scope", "form").agg(F.sum("weight").alias("weight"), F.first("given").alias("given"), F.first("rest").alias("rest"))
    best = likely_links(forms, known).groupBy("scope", "form").agg(F.max(F.struct("score", "to_weight", "to")).alias("b"))
    links = cut(best.select("scope", "form", F.col("b.to").alias("to")))
    # follow the pointers to their ends; each round doubles the reach
    while True:
        onward = links.select("scope", F.col("form").alias("to"), F.col("to").alias("end"))
        further = cut(links.join(onward, ["scope", "to"], "left").select("scope", "form", F.coalesce("end", "to").alias("to"), F.col("end").isNotNull().alias("moved")))
        if not further.where("moved").limit(1).count():
            break
        links = further.select("scope", "form", "to")
    return read.join(links, ["scope", "form"], "left").select("scope", "name", "weight", "form", F.coalesce("to", "form").alias("entity"))


def canonical_names(df: DataFrame, column: str) -> list[str]:
    """The names of a canonical list, which is bounded (see ``read_grammar``)."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(MAX_PROTECTED + 1).collect()
    if len(rows) > MAX_PROTECTED:
        raise ValueError(f"more than {MAX_PROTECTED} names in the canonical list")
    return sorted(r[0] for r in rows)


def distinct_names(tables: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """``(scope, name, weight)`` of the non-empty names of several tables, given as (table, scope column, name column)."""
    out = None
    for df, scope, name in tables:
        part = df.where(F.col(scope).isNotNull() & F.col(name).isNotNull() & ~F.col(name).isin(*UNKNOWN)).select(F.col(scope).cast("bigint").alias("scope"), F.col(name).alias("name"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("scope", "name").agg(F.count("*").alias("weight"))


def linked_pairs(found: DataFrame, scope: str) -> DataFrame:
    """``(scope, name_a, name_b)`` for all different spellings of an entity, ``name_a`` first in byte order.

    All pairs are what is asked for; the names of an entity are distinct, so the rows behind them don't count.
    """
    a = found.select("scope", "entity", F.col("name").alias("name_a"))
    b = found.select("scope", "entity", F.col("name").alias("name_b"))
    return a.join(b, ["scope", "entity"]).where(F.col("name_a") < F.col("name_b")).select(F.col("scope").alias(scope), "name_a", "name_b")
