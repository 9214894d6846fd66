"""Fields that hold several values: one row per value, position kept.

The text column of an Arrow batch is scanned as one byte buffer. Masks over the bytes say where a quoted
stretch runs (quote parity, by cumulative counts per row), where a protected name lies and where a delimiter
stands; from the masks follow the child offsets of a list array, which is flattened with its parent's ordinal.
No row is visited in Python except the few whose only delimiter is one comma (``Surname, Given`` or two names)
or whose short text may be a misspelt protected name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import GIVEN_SHORT_FORMS, GROUP_WORDS, squeeze

#: Protected names are collected to the driver; beyond this many the caller has named the wrong table.
MAX_PROTECTED = 20_000

# fixed values: delimiters between artists in one field
_SINGLE = b";|/,\t&+\n"
_MULTI = ("；", "、", "，", "｜", "／")
_WORDS = re.compile(
    rb"\s*[(\[](?:with|feat\.?|ft\.?|featuring)\s+|\s+(?:featuring|feat\.?|ft\.?|vs\.?|x)\s+|\s*\\{2}\s*", re.I
)
_AND = re.compile(rb"\s+and\s+", re.I)
_MARKS = re.compile(r"[;|/,\t&+\n；、，｜／\"]|\bx\b|\bfeat|\band\b|\\", re.I)


@dataclass
class Grammar:
    """What splitting needs to know of the list of known names, indexed so that the list's length doesn't count."""

    protected: list[str] = field(default_factory=list)
    singles: frozenset[str] = frozenset()
    given: frozenset[str] = frozenset()

    @classmethod
    def of(cls, names: list[str]) -> Grammar:
        people = [n.split() for n in names if n and len(n.split()) == 2 and not _MARKS.search(n)]
        given = {p[0].casefold() for p in people if p[0].casefold() != "the"} | set(GIVEN_SHORT_FORMS)
        return cls(
            sorted({n for n in names if n and _MARKS.search(n)}, key=lambda n: (-len(n), n)),
            frozenset(n.casefold() for n in names if n),
            frozenset(given),
        )

    @cached_property
    def finder(self):
        """One automaton for all protected names in all written forms, over bytes; None without names."""
        import ahocorasick

        found = ahocorasick.Automaton()
        for rank, name in enumerate(self.protected):
            b = name.encode().lower()
            for form in {b, b.replace(b'"', b'""'), b.replace(b'"', b'\\"')}:
                key = form.decode("latin-1")
                if key not in found:
                    found.add_word(key, (rank, len(form)))
        if not len(found):
            return None
        found.make_automaton()
        return found

    @cached_property
    def squeezed(self) -> dict[tuple[int, int, str], list[tuple[str, int]]]:
        """Letters of the protected names, and which there are, by length, number of a part, and that part."""
        out: dict[tuple[int, int, str], list[tuple[str, int]]] = {}
        for key in {squeeze(p) for p in self.protected}:
            for i, (a, b) in enumerate(_name_parts(len(key))):
                out.setdefault((len(key), i, key[a:b]), []).append((key, _letters(key)))
        return out

    @cached_property
    def longest(self) -> int:
        return max((len(p.encode()) for p in self.protected), default=0)

    @cached_property
    def given_left(self) -> dict[str, list[str]]:
        """Given names by what is left of them without one letter."""
        out: dict[str, list[str]] = {}
        for g in self.given:
            for x in _without_one(g):
                out.setdefault(x, []).append(g)
        return out

    def near_protected(self, text: str) -> bool:
        """Whether the letters of a text are those of a protected name but for one slip, or two in a longer name.

        A slip touches two parts of a name at most (a swap at their border), so one of three parts is left as it is by
        one slip and one of five by two, at most two places from where it was.
        """
        key = squeeze(text)
        n = len(key)
        if n < 4:
            return False
        have = _letters(key)
        for m in range(max(1, n - 2), n + 3):
            most = 1 if m < 8 else 2
            for i, (a, b) in enumerate(_name_parts(m)):
                for shift in range(-2, 3):
                    if a + shift >= 0 and b + shift <= n:
                        for name, there in self.squeezed.get((m, i, key[a + shift : b + shift]), ()):
                            # a slip brings in one letter and takes away one at most
                            if (have ^ there).bit_count() <= 2 * most and _edit_within(key, name, most):
                                return True
        return False


def _letters(key: str) -> int:
    out = 0
    for c in key:
        out |= 1 << (ord(c) & 63)
    return out


def _name_parts(n: int) -> list[tuple[int, int]]:
    k = 3 if n < 8 else 5
    return [(i * n // k, (i + 1) * n // k) for i in range(k)]


def _without_one(word: str) -> set[str]:
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


def _edit_within(a: str, b: str, most: int) -> bool:
    """Whether the restricted edit distance (with swaps) of two short strings is at most ``most``."""
    if abs(len(a) - len(b)) > most:
        return False
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return False
    return row[-1] <= most


def _given_like(word: str, grammar: Grammar) -> bool:
    w = word.casefold()
    if w in grammar.given or re.fullmatch(r"\w\.?", w):
        return True
    if not 4 <= len(w) <= 64:
        return False
    near = {g for x in _without_one(w) for g in grammar.given_left.get(x, ())}
    return any(_edit_within(w, g, 1) for g in near)


def turned_name(left: str, right: str, grammar: Grammar) -> bool:
    """Whether ``left, right`` is one name written with its last part first."""
    left, right = left.strip(), right.strip()
    if not left or not right:
        return False
    if right.casefold() == "the":
        return True
    head, tail = left.split(), right.split()
    if squeeze(left) in GROUP_WORDS and len(tail) == 1:
        return True
    if left.casefold() in grammar.singles or right.casefold() in grammar.singles:
        return False
    if len(head) != 1 or len(tail) > 2:
        return False
    return _given_like(tail[0], grammar) and all(re.fullmatch(r"\w\.?", t) for t in tail[1:])


def split_fields(texts: pa.Array, grammar: Grammar) -> pa.ListArray:
    """The values of each text. Null, empty and blank texts give an empty list."""
    texts = pa.array(texts.to_pylist(), pa.string()) if texts.offset else texts.cast(pa.string())
    n = len(texts)
    if not n:
        return pa.array([], pa.list_(pa.string()))
    offsets = np.frombuffer(texts.buffers()[1], np.int32, n + 1).astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8, offsets[-1]) if raw is not None and offsets[-1] else np.zeros(0, np.uint8)
    size = len(data)
    if not size:
        return pa.array([[]] * n, pa.list_(pa.string()))
    buf = data.tobytes()
    low = buf.lower()
    row = np.repeat(np.arange(n), np.diff(offsets))
    starts, ends = offsets[:-1], offsets[1:]

    def inside_one_row(a: int, b: int) -> bool:
        return row[a] == row[b - 1]

    # protected names
    free = np.ones(size, bool)
    if grammar.finder is not None:
        # all names in one pass over the bytes; the longer name comes first where two overlap
        hits = sorted((rank, at - length + 1, length) for at, (rank, length) in grammar.finder.iter(low.decode("latin-1")))
        for _, at, length in hits:
            end = at + length
            # a name is protected where it stands as a whole word
            if inside_one_row(at, end) and free[at:end].all():
                before = at == starts[row[at]] or not buf[max(at - 4, 0) : at].decode("utf-8", "ignore")[-1:].isalnum()
                after = end == ends[row[at]] or not buf[end : end + 4].decode("utf-8", "ignore")[:1].isalnum()
                if before and after:
                    free[at:end] = False

    # quote parity; a row with an odd number of quotes has none that count
    quote = (data == 34) & free
    escaped = np.zeros(size, bool)
    escaped[1:] = (data[:-1] == 92) & (row[1:] == row[:-1])
    quote &= ~escaped
    count = np.concatenate(([0], np.cumsum(quote)))
    per_row = count[ends] - count[starts]
    parity = (count[1:] - count[starts[row]]) & 1
    quoted = (parity == 1) & (per_row[row] % 2 == 0)
    open_ = free & ~quoted & ~quote

    # delimiters
    cut = np.isin(data, np.frombuffer(_SINGLE, np.uint8)) & open_
    comma_only = cut.copy()
    for mark in _MULTI:
        b = np.frombuffer(mark.encode(), np.uint8)
        hit = np.zeros(size, bool)
        if size >= len(b):
            hit[: size - len(b) + 1] = np.logical_and.reduce([data[i : size - len(b) + 1 + i] == b[i] for i in range(len(b))])
        hit &= open_
        for i in range(len(b)):
            cut[i:] |= hit[: size - i] if i else hit
    plain_cut = cut.copy()
    closers = np.zeros(n, bool)
    for m in _WORDS.finditer(buf):
        a, b = m.span()
        # the mark may sit beside a protected or quoted stretch, but its own letters must be free
        core = slice(a + (len(m[0]) - len(m[0].lstrip())), b - (len(m[0]) - len(m[0].rstrip())))
        if inside_one_row(a, b) and open_[core].all() and a > starts[row[a]]:
            cut[a:b] = True
            closers[row[a]] |= m[0].lstrip()[:1] in (b"(", b"[")
    commas = np.concatenate(([0], np.cumsum((data == 44) & plain_cut)))
    for m in _AND.finditer(buf):
        a, b = m.span()
        if inside_one_row(a, b) and open_[a:b].all():
            r = row[a]
            if commas[a] > commas[starts[r]] and commas[ends[r]] == commas[b]:
                cut[a:b] = True
    filled = ends > starts
    last = np.where(filled, ends - 1, 0)
    first = np.where(filled, starts, 0)
    listed = filled & (data[first] == 91) & (data[last] == 93) & (per_row >= 2)
    cut[first[listed]] = True
    cut[last[listed]] = True
    blank = (data == 32) | (data == 9) | (data == 10) | (data == 13)
    solid = np.flatnonzero(~blank)
    for r in np.flatnonzero(closers):
        k = np.searchsorted(solid, ends[r]) - 1
        if k >= 0 and solid[k] >= starts[r] and data[solid[k]] in (41, 93):
            cut[solid[k]] = True

    # child offsets: maximal runs of bytes that are not cut, inside one row
    keep = ~cut
    edge = np.empty(size, bool)
    edge[0] = True
    edge[1:] = (keep[1:] != keep[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(edge)
    stop = np.append(begin[1:], size)
    of_value = keep[begin]
    begin, stop = begin[of_value], stop[of_value]
    # trim blanks and outer quotes
    trim = blank | quote | ((data == 39) & _outer_single(data, row, cut, blank))
    core = np.flatnonzero(~trim)
    lo = np.searchsorted(core, begin)
    hi = np.searchsorted(core, stop) - 1
    ok = (lo <= hi) & (lo < len(core))
    begin, stop = core[lo[ok]], core[hi[ok]] + 1
    parent = row[begin]

    per = np.bincount(parent, minlength=n)
    values = _gather(data, begin, stop)
    named = np.zeros(n, bool)
    named[row[~free]] = True
    whole = _single_rows(texts, per, grammar, cut, named, data, starts, ends)
    if whole:
        return _with_wholes(values, per, whole)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per))), pa.int32()), values)


def _outer_single(data: np.ndarray, row: np.ndarray, cut: np.ndarray, blank: np.ndarray) -> np.ndarray:
    """Single quotes that touch a delimiter, a blank beside one, or the row's end: outer quotes, not apostrophes."""
    size = len(data)
    rim = cut | blank
    before = np.ones(size, bool)
    before[1:] = rim[:-1] | (row[1:] != row[:-1])
    after = np.ones(size, bool)
    after[:-1] = rim[1:] | (row[1:] != row[:-1])
    return before | after


def _gather(data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> pa.Array:
    """The string array of the given byte ranges, unescaped where they hold escapes."""
    size = stop - begin
    offs = np.concatenate(([0], np.cumsum(size)))
    at = np.repeat(begin - offs[:-1], size) + np.arange(offs[-1])
    out = data[at]
    values = pa.StringArray.from_buffers(len(begin), pa.py_buffer(offs.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes()))
    if (out == 92).any() or (out[:-1][out[1:] == 34] == 34).any():
        return pa.array([re.sub(r"\\(.)", r"\1", v).replace('""', '"') if "\\" in v or '""' in v else v for v in values.to_pylist()], pa.string())
    return values


def _single_rows(texts: pa.Array, per: np.ndarray, grammar: Grammar, cut: np.ndarray, named: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[int, str]:
    """Rows that look split but hold one name: last part first, or a misspelt protected name."""
    whole: dict[int, str] = {}
    marks = np.concatenate(([0], np.cumsum(cut)))
    cuts = marks[ends] - marks[starts]
    commas = np.concatenate(([0], np.cumsum((data == 44) & cut)))
    two = (per == 2) & (cuts == 1) & (commas[ends] - commas[starts] == 1)
    short = (per >= 2) & (ends - starts <= grammar.longest + 8) & ~named
    for r in np.flatnonzero(two | short):
        text = texts[int(r)].as_py()
        if two[r]:
            left, _, right = text.partition(",")
            if turned_name(left, right, grammar):
                whole[int(r)] = text.strip()
                continue
        if short[r] and grammar.near_protected(text):
            whole[int(r)] = text.strip()
    return whole


def _with_wholes(values: pa.Array, per: np.ndarray, whole: dict[int, str]) -> pa.ListArray:
    offs = np.concatenate(([0], np.cumsum(per)))
    drop = np.ones(offs[-1], bool)
    first = {}
    for r in whole:
        drop[offs[r] + 1 : offs[r + 1]] = False
        first[int(offs[r])] = whole[r]
    at = np.fromiter(first, np.int64, len(first))
    flag = np.zeros(offs[-1], bool)
    flag[at] = True
    order = np.argsort(at)
    values = pa.compute.replace_with_mask(values, pa.array(flag), pa.array([first[int(a)] for a in at[order]], pa.string()))
    values = values.filter(pa.array(drop))
    size = per.copy()
    for r in whole:
        size[r] = 1
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), values)


def read_grammar(names: DataFrame, column: str = "name") -> Grammar:
    """The grammar of a canonical list. The list is bounded: more than ``MAX_PROTECTED`` names are refused."""
    rows = names.select(column).where(F.col(column).isNotNull()).distinct().limit(MAX_PROTECTED + 1).collect()
    if len(rows) > MAX_PROTECTED:
        raise ValueError(f"more than {MAX_PROTECTED} names in the canonical list")
    return Grammar.of([r[0] for r in rows])


def split_values(df: DataFrame, key: str, column: str, grammar: Grammar, at_least: int = 1) -> DataFrame:
    """One row ``(key, pos, value)`` per value of ``column``, for fields of ``at_least`` values or more.

    ``pos`` counts from 1 over the non-empty values. Null, empty and blank fields give no row. Repeated rows are
    split each for themselves. No shuffle: a field's values stay in the partition of the field.
    """
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("pos", T.IntegerType()), T.StructField("value", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = split_fields(batch.column(1), grammar)
            offs = lists.offsets.to_numpy().astype(np.int64)
            size = np.diff(offs)
            parent = np.repeat(np.arange(len(size)), size)
            pos = np.arange(offs[-1]) - np.repeat(offs[:-1], size) + 1
            take = size[parent] >= at_least
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(parent[take])), pa.array(pos[take], pa.int32()), lists.values.filter(pa.array(take))],
                names=[key, "pos", "value"],
            )

    text = df.select(F.col(key), F.col(column).alias("_text")).where(F.col(column).isNotNull() & (F.col(column) != ""))
    return text.mapInArrow(run, schema)
