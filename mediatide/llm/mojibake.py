"""Text that was decoded with the wrong encoding: found, its chain of encodings named, and restored.

A multinomial classifier on hashed byte bigrams is trained on canonical strings garbled by every known chain of
encodings, next to the strings as they are. For each text it ranks the chains. A chain counts only if it can be
inverted strictly (every byte encodes and decodes) and a character model of the canonical strings finds the result
more likely than the text. Where single bytes were lost, or a replacement character shows that they were, the text
is damaged but can't be restored. Fields that join several names are looked at as a whole and name by name.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1 << 14
#: How many of the best ranked chains are tried, and the gain in log likelihood a character that a reading needs.
TRIED, GAIN = 10, 0.6
#: Lead of the class of clean texts, in log likelihood, from which a text is not looked at further.
CLEAR = 4.0
#: Gain in log likelihood a character that a reading with lost bytes needs.
LOSSY = 0.8
#: Texts that a worker remembers; one value usually recurs in many rows.
REMEMBERED = 200_000

# fixed values: chains, each step read as (real encoding, encoding used instead)
CHAINS: dict[str, tuple[tuple[str, str], ...]] = {
    **{f"utf-8 as {w}": (("utf-8", w),) for w in ("latin-1", "web-1252", "cp437", "cp850", "mac-roman", "cp1251", "koi8-r", "cp866", "gb18030", "cp932", "cp949", "cp950", "cp1250", "cp1253")},
    **{f"latin-1 as {w}": (("web-1252", w),) for w in ("gb18030", "cp1251", "mac-roman", "cp437", "cp850", "koi8-r")},
    **{f"gbk as {w}": (("gb18030", w),) for w in ("latin-1", "web-1252", "cp1251", "cp950", "cp949", "cp932", "koi8-r", "cp437", "mac-roman")},
    **{f"big5 as {w}": (("cp950", w),) for w in ("latin-1", "web-1252", "gb18030", "cp1251")},
    **{f"shift-jis as {w}": (("cp932", w),) for w in ("latin-1", "web-1252", "gb18030", "cp1251", "mac-roman", "cp437", "cp949")},
    **{f"euc-jp as {w}": (("euc-jp", w),) for w in ("latin-1", "web-1252", "gb18030", "cp932", "cp1251")},
    **{f"euc-kr as {w}": (("cp949", w),) for w in ("latin-1", "web-1252", "gb18030", "cp1251", "cp932")},
    **{f"cp1251 as {w}": (("cp1251", w),) for w in ("latin-1", "web-1252", "koi8-r", "cp866", "gb18030", "mac-roman", "cp437", "cp850")},
    **{f"koi8-r as {w}": (("koi8-r", w),) for w in ("latin-1", "web-1252", "cp1251", "cp866", "gb18030")},
    **{f"cp866 as {w}": (("cp866", w),) for w in ("latin-1", "web-1252", "cp1251", "koi8-r")},
    **{f"greek as {w}": (("cp1253", w),) for w in ("latin-1", "web-1252", "cp1251", "gb18030")},
    "utf-8 twice as latin-1": (("utf-8", "latin-1"), ("utf-8", "latin-1")),
    "utf-8 twice as web-1252": (("utf-8", "web-1252"), ("utf-8", "web-1252")),
    "utf-8 as latin-1, then as web-1252": (("utf-8", "latin-1"), ("utf-8", "web-1252")),
    "utf-8 twice as cp1251": (("utf-8", "cp1251"), ("utf-8", "cp1251")),
}
_C1 = {c: bytes([c]) for c in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _encode(text: str, encoding: str, errors: str = "strict") -> bytes:
    """``web-1252`` is cp1252 whose five free bytes are control characters; cp1251 and cp1253 keep theirs too."""
    if encoding == "web-1252":
        encoding = "cp1252"
    elif encoding not in ("cp1251", "cp1253", "cp1250"):
        return text.encode(encoding, errors)
    try:
        return text.encode(encoding, "strict")
    except UnicodeEncodeError:
        return b"".join(bytes([ord(c)]) if "\x80" <= c <= "\x9f" or c == "\xa0" else c.encode(encoding, errors) for c in text)


def _decode(data: bytes, encoding: str, errors: str = "strict") -> str:
    if encoding == "web-1252":
        encoding = "cp1252"
    elif encoding not in ("cp1251", "cp1253", "cp1250"):
        return data.decode(encoding, errors)
    try:
        return data.decode(encoding, "strict")
    except UnicodeDecodeError:
        out = []
        for b in data:
            try:
                out.append(bytes([b]).decode(encoding))
            except UnicodeDecodeError:
                out.append(chr(b))
        return "".join(out)


def garble(text: str, chain: str, errors: str = "strict") -> str | None:
    """``text`` as it comes out of the chain; None where it can't go through."""
    try:
        for real, wrong in CHAINS[chain]:
            text = _decode(_encode(text, real), wrong, errors)
        return text
    except UnicodeError:
        return None


def restore(text: str, chain: str, errors: str = "strict") -> str | None:
    """The text before the chain; None where the chain can't be inverted strictly.

    With ``errors="replace"`` bytes that make no character in the real encoding become replacement characters.
    """
    try:
        for real, wrong in reversed(CHAINS[chain]):
            text = _decode(_encode(text, wrong), real, errors)
        return text
    except UnicodeError:
        return None


def _buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed bigrams of the UTF-8 bytes of each text and where each text's begin.

    Bigrams of two ASCII bytes say nothing of the encoding and are left out; the first bucket of every text is a
    neutral one, so that no text is without.
    """
    data = [b"\x01" + t.encode("utf-8", "replace") + b"\x02" for t in texts]
    size = np.fromiter(map(len, data), np.int64, len(data))
    flat = np.frombuffer(b"".join(data), np.uint8).astype(np.uint32)
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    bucket = (((flat[:-1] << 8 | flat[1:]) * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)
    keep = (flat[:-1] | flat[1:]) >= 128
    keep[first] = True
    bucket[first] = BUCKETS
    keep[np.cumsum(size)[:-1] - 1] = False
    at = np.flatnonzero(keep)
    return bucket[at], np.searchsorted(at, first)


@dataclass
class Model:
    """Log probabilities: ``weights[class, bucket]`` of the classifier, and of characters after characters."""

    names: list[str]
    weights: np.ndarray
    single: dict[str, float]
    pair: dict[str, float]
    block: dict[int, float]
    #: What this process has already found with this model; empty where the model is handed on.
    known: dict = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def likelihood(self, text: str) -> float:
        """Mean log likelihood a character; blocks stand in for unseen characters."""
        total, before = 0.0, " "
        low = text.casefold()
        for c in low:
            p = self.pair.get(before + c)
            if p is None:
                p = self.single.get(c)
                p = p - 1.0 if p is not None else self.block.get(_block(c), -14.0)
            total += p
            before = c
        return total / max(1, len(low))


def _block(c: str) -> int:
    o = ord(c)
    if 0x4E00 <= o < 0xA000:
        return 0x4E00
    if 0xAC00 <= o < 0xD7B0:
        return 0xAC00
    return o >> 6


# fixed values: notes on versions that stand beside titles
_NOTES = ["(Live版)", "【现场】", "(版)", "[2007 专辑版]", "(伴奏)", "【无损】", "《原声带》", "完整版", "现场版", "伴奏", "专辑版"]


def _variants(text: str) -> list[str]:
    """A canonical string as it is and as people also write it, joined with others by wide punctuation too."""
    return [text, text.upper(), f"{text} (Live)", f"{text} 2", f"{text}，{text}", f"{text}；X", f"X、{text}"]


def _counted(texts: list[str]) -> np.ndarray:
    """How often each bucket occurs in all texts, those never seen a little."""
    n = np.zeros(BUCKETS + 1, np.int64)
    for at in range(0, len(texts), 10_000):
        n += np.bincount(_buckets(texts[at : at + 10_000])[0], minlength=BUCKETS + 1)
    return n[:BUCKETS] + 0.1


def train(texts: list[str]) -> Model:
    """Fit on canonical strings; the garbled records are made from them, one class a chain."""
    texts = sorted({t for t in texts if t}) + 20 * _NOTES
    odd = [v for t in texts if not t.isascii() for v in _variants(t)]
    names, counts = ["clean"], [_counted(odd + [t for t in texts if t.isascii()])]
    for chain in CHAINS:
        # of one chain at a time: all garbled records are many times the canonical strings
        got = {g for t in odd for g in (garble(t, chain),) if g and g != t and not g.isascii()}
        if got:
            names.append(chain)
            counts.append(_counted(list(got)))
    weights = np.zeros((len(names), BUCKETS + 1), np.float32)
    for k, n in enumerate(counts):
        weights[k, :BUCKETS] = np.log(n / n.sum())
    single: dict[str, float] = {}
    pair: dict[str, float] = {}
    block: dict[int, float] = {}
    # joined strings of all texts, which weigh as much as those of 500 to 1,000 texts
    share = 1 / max(1, len(texts) // 500)
    for t, w in [(t, 1) for t in texts] + [(v, share) for t in texts for v in _variants(t)[4:]]:
        before = " "
        for c in t.casefold():
            single[c] = single.get(c, 0) + w
            pair[before + c] = pair.get(before + c, 0) + w
            block[_block(c)] = block.get(_block(c), 0) + w
            before = c
    whole = sum(single.values())
    pair = {k: float(np.log(0.7 * n / single.get(k[0], whole) + 0.3 * single[k[1]] / whole)) for k, n in pair.items()}
    block = {b: float(np.log(n / whole / (20_000 if b in (0x4E00, 0xAC00) else 64))) - 2.0 for b, n in block.items()}
    return Model(names, weights, {c: float(np.log(n / whole)) for c, n in single.items()}, pair, block)


_PARTS = re.compile(r"\s*[;,/|&+，；、\t]\s*|\\\\|\s+(?:feat\.?|ft\.?|featuring|vs\.?|x|and)\s+|\s*[(\[【《](?:with|feat\.?|ft\.?)?\s*|[)\]】》]", re.I)


@dataclass
class Finding:
    chain: str | None
    restored: str | None


def judge(texts: list[str], model: Model) -> list[Finding | None]:
    """What is wrong with each text; None for a text that is well."""
    odd = [k for k, t in enumerate(texts) if not t.isascii()]
    out: list[Finding | None] = [None] * len(texts)
    if not odd:
        return out
    buckets, begin = _buckets([texts[k] for k in odd])
    scores = np.add.reduceat(model.weights[:, buckets], begin, axis=1)
    ranked = np.argsort(-scores, axis=0)
    again: list[tuple[int, str]] = []
    for j, k in enumerate(odd):
        text = texts[k]
        if "\ufffd" in text:
            out[k] = Finding("bytes lost", None)
            continue
        out[k] = _decide(text, ranked[:, j], scores[:, j], model)
        if out[k] is None or out[k].restored is None:
            parts = [p for p in dict.fromkeys(_PARTS.split(text)) if p and p != text and not p.isascii()]
            again += [(k, p) for p in parts]
    if again:
        whole = {k: texts[k] for k, _ in again}
        for (k, part), found in zip(again, _judge_parts([p for _, p in again], model), strict=True):
            if not found:
                continue
            if found.restored is None:
                whole[k] = None
                out[k] = out[k] or found
            elif whole[k] is not None:
                whole[k] = whole[k].replace(part, found.restored)
                out[k] = Finding(found.chain, whole[k])
        for k, text in whole.items():
            if text is None and out[k]:
                out[k] = Finding(out[k].chain, None)
    return out


def _judge_parts(parts: list[str], model: Model) -> list[Finding | None]:
    buckets, begin = _buckets(parts)
    scores = np.add.reduceat(model.weights[:, buckets], begin, axis=1)
    ranked = np.argsort(-scores, axis=0)
    return [_decide(p, ranked[:, j], scores[:, j], model) for j, p in enumerate(parts)]


def _unlikely(text: str) -> bool:
    """Whether a reading holds characters that no text has: lost ones, controls, private or unassigned ones."""
    return any(c > "~" and (c == "\ufffd" or unicodedata.category(c) in ("Cc", "Co", "Cn", "Cs")) for c in text)


def _decide(text: str, ranked: np.ndarray, scores: np.ndarray, model: Model) -> Finding | None:
    if ranked[0] == 0 and scores[0] - scores[ranked[1]] > CLEAR:
        return None
    here = model.likelihood(text) * len(text)
    odd = sum(not c.isascii() for c in text)
    best: tuple[float, str, str] | None = None
    for c in ranked[:TRIED]:
        if c == 0:
            continue
        got = restore(text, model.names[c])
        if got is None or got == text or not got.strip() or _unlikely(got):
            continue
        gain = model.likelihood(got) * len(got) - here
        if gain > max(3.0, GAIN * odd) and (best is None or gain > best[0]):
            best = (gain, model.names[c], got)
    if best:
        return Finding(best[1], best[2])
    if ranked[0] != 0 and scores[ranked[0]] - scores[0] > 4:
        # single bytes may be lost on the way: the rest must come out likely
        for c in ranked[:4]:
            got = restore(text, model.names[c], "replace") if c else None
            if got and (lost := got.count("\ufffd")):
                kept = got.replace("\ufffd", "")
                read = sum(not x.isascii() for x in kept)
                if lost <= max(3, len(kept) // 3) and (read >= 2 or read and any("\x80" <= x <= "\x9f" for x in text) or lost == 1 and len(kept) > 3) and model.likelihood(kept) > here / len(text) + LOSSY and not _unlikely(kept):
                    return Finding(model.names[c], None)
    if any("\x80" <= c <= "\x9f" for c in text):
        return Finding("control characters", None)
    return None


def canonical_texts(tables: list[tuple[DataFrame, str]]) -> list[str]:
    """All distinct strings of the given columns, those of each in the order of their hash."""
    out: list[str] = []
    for df, column in tables:
        rows = df.select(F.col(column).alias("t")).where("t is not null and t <> ''").distinct().orderBy(F.xxhash64("t"), "t")
        out += [r.t for r in rows.collect()]
    return out


def damaged_fields(df: DataFrame, src: str, key: str, columns: list[str], model) -> DataFrame:
    """``(src, row_id, field, original, chain, restored)`` of the damaged fields among ``columns``.

    ``model`` is a broadcast :class:`Model`. ``restored`` is null where bytes were lost. Null, empty and ASCII
    fields are never damaged and don't leave the JVM unless another field of their row does. Repeated rows come out
    each; extra columns are not read; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        known = m.known
        for batch in batches:
            ids = batch.column(0)
            for n, field in enumerate(columns, 1):
                code = batch.column(n).dictionary_encode()
                values = code.dictionary.to_pylist()
                new = [v for v in values if v is not None and not v.isascii() and v not in known]
                if len(known) + len(new) > REMEMBERED:
                    known.clear()
                    new = [v for v in values if v is not None and not v.isascii()]
                known.update(zip(new, judge(new, m), strict=True))
                hits = [None if v is None else known.get(v) for v in values]
                bad = np.fromiter((h is not None for h in hits), bool, len(hits))
                if not bad.any():
                    continue
                at = code.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                rows = np.flatnonzero((at >= 0) & bad[at])
                which = at[rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([src] * len(rows), pa.string()), ids.take(pa.array(rows)).cast(pa.int64()), pa.array([field] * len(rows), pa.string()),
                     batch.column(n).take(pa.array(rows)), pa.array([hits[w].chain for w in which], pa.string()), pa.array([hits[w].restored for w in which], pa.string())],
                    names=["src", "row_id", "field", "original", "chain", "restored"],
                )

    odd = " or ".join(f"`{c}` rlike '[^\\\\x00-\\\\x7f]'" for c in columns)
    rows = df.select(key, *columns).where(odd)
    return rows.mapInArrow(run, "src string, row_id bigint, field string, original string, chain string, restored string")


def fit(spark: SparkSession, tables: list[tuple[DataFrame, str]]):
    """Train on the canonical columns and hand the model to the executors (a few MB, as many as the canonical list has buckets and pairs of characters)."""
    return spark.sparkContext.broadcast(_trained(tuple(canonical_texts(tables))))


@lru_cache(maxsize=2)
def _trained(texts: tuple[str, ...]) -> Model:
    """The same texts give the same model, which is fitted once a session."""
    return train(list(texts))
