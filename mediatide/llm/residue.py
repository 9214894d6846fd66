"""Template residue, filler, error pages and script notices in place of real content: found and left out.

Character n-gram models are fitted for natural prose (on all different texts of the corpus, where they lie), for prose that speaks
about such things, and for template slots, filler, and error or script notices (on seed texts). Every position of
a text has a log-likelihood ratio of residue against prose; summed over windows it localises the residue, and a
document is left out when residue covers enough characters. Sentences that read as prose about templates or
errors don't count. The first fit knows only seed texts, which are written by rule and taken from no document; rounds of
self-training then learn how the corpus itself puts such things. All positions of all texts are scored with array operations on whole batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .residue_seeds import MARKS, ORDINARY, SLOTS, STYLES, errors, fillers, lines, mentions

BITS = 18
#: Rows in which a task hands on its counts of one order, and what a text in capitals weighs: one in so many, as titles often are.
SLICES, CAPITALS = 16, 20
#: Characters of a text that are looked at in one go, and how far from there a sentence's end is looked for.
MOST_CHARS, NEAR = 2_000_000, 20_000
ORDERS = (2, 4, 6)
#: Characters of a window of slots, and of one of filler or notices.
WINDOW, NOTICE_WINDOW = 6, 12
#: Probability kept for n-grams never seen.
FLOOR = 0.05
#: Log-likelihood ratio a window needs, and a sentence a character, to count as residue; and the characters to cover.
HOT_WINDOW, HOT_MEAN, COVERED = 4.0, 0.6, WINDOW
#: The ratio a window of filler or notices needs.
HOT_NOTICE = 16.0
#: The window's ratio from which a text is kept out of natural prose.
SUSPICIOUS = 0.5
#: A sentence's ratio a character, by the seed texts alone, from which it isn't in the first fit of natural prose.
LIKE_SEEDS = 0.7
#: Rounds of fitting, and the ratio a character from which a sentence is residue beyond doubt.
ROUNDS, SURE = 3, 1.0
#: How far, a character, the prose about such things may stay behind ordinary prose and still be taken for it.
MENTION_LAG = 1.0
CLASSES = ("natural", "mention", "slot", "filler", "error")

_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？；])|\n+|<br>|</?p>|\r")


def _codes(text: str) -> np.ndarray:
    """Code points, case folded roughly (ASCII, Latin and Cyrillic letters kept apart from capitals), digits as 0."""
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).copy()
    c[(c >= 49) & (c <= 57)] = 48
    return c


def _hashes(codes: np.ndarray) -> dict[int, np.ndarray]:
    """By order the bucket of the n-gram that ends at each position; positions before the first full one use what is there."""
    p, c = 1099511628211, codes.astype(np.uint64)
    pair = c * np.uint64(p)
    pair[1:] += c[:-1]
    out, whole = {}, pair
    # an n-gram's sum is made of that of two characters less
    for order in range(2, max(ORDERS) + 1, 2):
        if order > 2:
            whole = whole * np.uint64(p * p % (1 << 64))
            whole[order - 2 :] += pair[: max(0, len(codes) - order + 2)]
        h = whole * np.uint64(0x9E3779B97F4A7C15) + np.uint64(sum(order * pow(p, k, 1 << 64) for k in range(order)) % (1 << 64))
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        out[order] = (h >> np.uint64(64 - BITS)).astype(np.int64)
    return out


@dataclass
class Models:
    """``tables[order][bucket, class]``: log probabilities of n-grams."""

    tables: dict[int, np.ndarray]

    def score(self, codes: np.ndarray) -> np.ndarray:
        """Mean over the orders of the log probability at each position, one column a class."""
        total = np.zeros((len(codes), len(CLASSES)), np.float32)
        hashes = _hashes(codes)
        for order, table in self.tables.items():
            total += table[hashes[order]]
        return total / len(self.tables)


def _rendered() -> list[str]:
    """Template slots amid neutral text."""
    slots = [style % slot for style in STYLES for slot in SLOTS] + MARKS * 20
    around = [" %s ", "《%s》", '"%s"', " %s.", "于%s年", "在%s的", "«%s»", " %s, ", "『%s』", "到%s以"]
    return [form.replace("%s", s) for k, s in enumerate(slots) for form in (around[0], around[k % 10], around[(k * 7 + 3) % 10], around[(k // 10) % 10])]


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    """Texts in blocks of about a million characters, which keep the arrays in cache-friendly size; endless texts in stretches."""
    block, size = [], 0
    for text in (t[a:b] for t in texts if t for a, b in _stretches(t)):
        if block and size + len(text) > 1_000_000:
            yield block
            block, size = [], 0
        block.append(text)
        size += len(text)
    if block:
        yield block


def _gapped(block: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts in one, as many line ends around each as a window is wide (none sees two); their begins and ends."""
    gap = "\n" * WINDOW
    sizes = np.fromiter((len(t) for t in block), np.int64, len(block))
    begins = WINDOW + np.concatenate(([0], np.cumsum(sizes + WINDOW)[:-1]))
    return gap + gap.join(block) + gap, begins, begins + sizes


def _count(texts: list[str]) -> np.ndarray:
    """How often each bucket comes, a row an order, over the n-grams of each text between a line end before and one after it."""
    n = np.zeros((len(ORDERS), 1 << BITS), np.int64)
    for block in _blocks(texts):
        joined, begins, ends = _gapped(block)
        hashes = _hashes(_codes(joined))
        for k, order in enumerate(ORDERS):
            first, change = begins + order - 2, np.zeros(len(joined) + 1, np.int8)
            full = first <= ends
            change[first[full]] += 1
            change[ends[full] + 1] -= 1
            n[k] += np.bincount(hashes[order][np.cumsum(change[:-1], dtype=np.int8) > 0], minlength=1 << BITS)
    return n


def _count_prose(texts: list[str]) -> np.ndarray:
    """Counts of prose: some of it counts as in capitals."""
    return CAPITALS * _count(texts) + _count([t.upper() for t in texts if t])


@cache
def _seed_counts() -> dict[str, np.ndarray]:
    return {"natural": _count_prose(lines(ORDINARY) * 2), "mention": _count(mentions() * 3), "slot": _count(_rendered()), "filler": _count(fillers() * 2), "error": _count(errors() * 2)}


def _fitted(counts: dict[str, np.ndarray]) -> Models:
    """The models of the seed texts and of what the corpus adds to some classes."""
    tables = {}
    for k, order in enumerate(ORDERS):
        table = np.empty((1 << BITS, len(CLASSES)), np.float32)
        for j, c in enumerate(CLASSES):
            n = (_seed_counts()[c][k] + counts[c][k] if c in counts else _seed_counts()[c][k]).astype(np.float64)
            # the same floor for every class, however much text it was fitted on
            table[:, j] = np.log((1 - FLOOR) * n / n.sum() + FLOOR / (1 << BITS))
        tables[order] = table
    return Models(tables)


def _sentences(texts: list[str], models: Models) -> Iterator[list[tuple[str, np.ndarray]]]:
    """For each text (or stretch of an endless one) its sentences and the mean log probability of each by class."""
    for block in _blocks(texts):
        joined, begins, ends = _gapped(block)
        score = models.score(_codes(joined))
        starts = [[0, *(m.end() for m in _SENTENCE.finditer(t) if 0 < m.end() < len(t))] for t in block]
        # the end of each text is a cut as well: the gap belongs to no sentence
        cuts = np.concatenate([np.array([*s, len(t)]) + b for s, t, b in zip(starts, block, begins, strict=True)])
        mean = np.add.reduceat(score, cuts, axis=0) / np.diff(np.append(cuts, len(joined)))[:, None]
        at = 0
        for s, t in zip(starts, block, strict=True):
            yield [(t[a:b], mean[at + k]) for k, (a, b) in enumerate(zip(s, [*s[1:], len(t)], strict=True))]
            at += len(s) + 1


def _by_seeds(texts: list[str], models: Models) -> tuple[np.ndarray, dict[str, set[str]]]:
    """Counts of the sentences that don't read like residue to models that know only the seed texts."""
    return _count_prose(["".join(s for s, m in found if max(m[2:]) - max(m[:2]) <= LIKE_SEEDS) for found in _sentences(texts, models)]), {}


def _sorted_out(texts: list[str], models: Models) -> tuple[np.ndarray, dict[str, set[str]]]:
    """Counts of the texts without residue, and by class the sentences of the others that are residue beyond doubt."""
    more = {"filler": set(), "error": set()}
    # at half the usual threshold: what is even suspicious must not count as prose
    found = inspect(texts, models, hot=SUSPICIOUS)
    for sentences in _sentences([t for t, f in zip(texts, found, strict=True) if f], models):
        for sentence, m in sentences:
            best = max(m[3:])
            if len(sentence) > NOTICE_WINDOW and best - max(m[:3]) > SURE:
                more["filler" if m[3] == best else "error"].add(sentence.strip())
    return _count_prose([t for t, f in zip(texts, found, strict=True) if not f]), more


def _all(texts: list[str], models: Models | None) -> tuple[np.ndarray, dict[str, set[str]]]:
    return _count_prose(texts), {}


def _train(over: Callable) -> Models:
    """Fit all classes; ``over`` puts one of the steps above to all texts and gives the counts of prose and of each class of sentences.

    The first fit knows the seed texts alone: corpus sentences that read like residue to it aren't fitted as prose, as
    residue that is much of the corpus would count as prose and not be found by any later fit. Then, in rounds, texts
    with residue are left out, and sentences that are residue beyond doubt teach their own class how this corpus
    puts such things, each once.
    """
    models = _fitted({"natural": _count_prose(lines(ORDINARY) * 2 + mentions())})
    for step in [_by_seeds] + [_sorted_out] * ROUNDS:
        counts = over(step, models)
        if not counts["natural"].any():
            counts["natural"] = over(_all, None)["natural"]
        models = _fitted(counts)
    return models


def train(natural: list[str]) -> Models:
    """Fit all classes to texts that are at hand; :func:`fit` does the same to a frame, where it lies."""
    texts = [t for t in natural if t]

    def over(step, models):
        prose, more = step(texts, models)
        return {"natural": prose} | {c: _count(sorted(t)) for c, t in more.items()}

    return _train(over)


@dataclass
class Spans:
    """Residue of one document: characters covered, its kind, and where the first window begins."""

    covered: int
    kind: str
    start: int


def inspect(texts: list[str | None], models: Models, hot: float = HOT_WINDOW) -> list[Spans | None]:
    """The residue of each text; None for texts without (null, empty and blank ones too).

    Texts beyond ``MOST_CHARS`` characters are looked at in stretches, all of them, cut between sentences where there are any.
    """
    out: list[Spans | None] = [None] * len(texts)
    use = [k for k, t in enumerate(texts) if t and not t.isspace() and len(t) <= MOST_CHARS]
    for k in (k for k, t in enumerate(texts) if t and len(t) > MOST_CHARS):
        found = [(a, f) for a, b in _stretches(texts[k]) for f in inspect([texts[k][a:b]], models, hot) if f]
        if found:
            out[k] = Spans(sum(f.covered for _, f in found), found[0][1].kind, found[0][0] + found[0][1].start)
    at = 0
    while at < len(use):
        # blocks of about a million characters keep the arrays in cache-friendly size
        size, to = 0, at
        while to < len(use) and (to == at or size < 1_000_000):
            size += len(texts[use[to]])
            to += 1
        _inspect_block([(k, texts[k]) for k in use[at:to]], models, out, hot)
        at = to
    return out


def _stretches(text: str) -> Iterator[tuple[int, int]]:
    a = 0
    while len(text) - a > MOST_CHARS:
        last = None
        for last in _SENTENCE.finditer(text, a + MOST_CHARS - min(NEAR, MOST_CHARS // 2), a + MOST_CHARS):
            pass
        b = last.end() if last and last.end() > a else a + MOST_CHARS
        yield a, b
        a = b
    yield a, len(text)


def _windows(gain: np.ndarray, size: int) -> np.ndarray:
    """Sum over the window that ends at each position."""
    run = np.concatenate(([0.0], np.cumsum(gain, dtype=np.float64)))
    out = np.full(len(gain), -np.inf)
    out[size - 1 :] = run[size:] - run[: len(run) - size]
    return out


def _spread(hot: np.ndarray, size: int) -> np.ndarray:
    """The positions of all windows that end at a hot one."""
    return np.convolve(hot, np.ones(size, np.int8))[size - 1 :][: len(hot)] > 0


def _inspect_block(block: list[tuple[int, str]], models: Models, out: list[Spans | None], threshold: float) -> None:
    joined, begins, ends = _gapped([t for _, t in block])
    codes = _codes(joined)
    score = models.score(codes)
    # sentences: cut at ends of sentences and lines; every document begins one
    # and ends before the gap, which else counts in the mean of its last sentence
    cuts = {m.end() for m in _SENTENCE.finditer(joined)} | set(begins.tolist()) | set(ends.tolist()) | {0}
    start = np.array(sorted(c for c in cuts if c < len(codes)))
    length = np.diff(np.append(start, len(codes)))
    total = np.add.reduceat(score, start, axis=0)
    mean = total / length[:, None]
    # a sentence that reads as a mention doesn't count at all, so windows are held against ordinary prose alone
    prose = score[:, 0]
    mention = (mean[:, 1] > mean[:, 0] - MENTION_LAG) & (mean[:, 1] > np.max(mean[:, 2:], axis=1))
    # whole sentences of filler or notices
    ratio = np.maximum(mean[:, 3], mean[:, 4]) - np.maximum(mean[:, 0], mean[:, 1])
    whole = (ratio > HOT_MEAN) & ~mention
    # windows of slots anywhere in a sentence
    sentence = np.repeat(np.arange(len(start)), length)
    hot = (_windows(score[:, 2] - prose, WINDOW) > threshold) & ~mention[sentence]
    # windows of filler or notices, each within one sentence: what a mention quotes doesn't reach into the next
    within = np.zeros(len(codes), bool)
    within[NOTICE_WINDOW - 1 :] = sentence[NOTICE_WINDOW - 1 :] == sentence[: len(codes) - NOTICE_WINDOW + 1]
    other = np.maximum(prose, score[:, 1])
    notice = (np.maximum(_windows(score[:, 3] - other, NOTICE_WINDOW), _windows(score[:, 4] - other, NOTICE_WINDOW)) > HOT_NOTICE) & within & ~mention[sentence]
    covered = _spread(hot, WINDOW) | _spread(notice, NOTICE_WINDOW) | whole[sentence]
    doc = np.searchsorted(begins, np.arange(len(codes)), side="right") - 1
    doc = np.maximum(doc, 0)
    # the gaps between documents belong to none
    at = np.arange(len(codes))
    covered &= (at >= begins[doc]) & (at < ends[doc])
    per = np.bincount(doc[covered], minlength=len(block))
    for j in np.flatnonzero(per >= COVERED):
        spot = np.flatnonzero(covered & (doc == j)) if len(block) < 4 else np.flatnonzero(covered[begins[j] : begins[j] + len(block[j][1])]) + begins[j]
        kind = CLASSES[2 + int(np.argmax(score[spot, 2:].sum(axis=0)))]
        out[block[j][0]] = Spans(int(per[j]), kind, int(spot[0] - begins[j]))


def natural_sample(docs: DataFrame, key: str, column: str) -> list[str]:
    """All texts of a small frame, for :func:`train`, in the order of the keys' hashes."""
    rows = docs.where(F.length(F.trim(column)) > 0).select(F.col(column).alias("t"), F.xxhash64(F.col(key)).alias("h"))
    return [r.t for r in rows.orderBy("h", "t").select("t").collect()]


def distinct_texts(docs: DataFrame, column: str) -> DataFrame:
    """``(text_hash, column)``: all different texts, whole, each once however many copies there are."""
    texts = docs.where(F.length(F.trim(column)) > 0).select(column).distinct()
    return cut(texts.select(F.xxhash64(column).alias("text_hash"), column))


_COUNTS = "cls string, slice int, n binary, sentence string"


def _rows(cls: str, n: np.ndarray) -> pa.RecordBatch:
    """A task's counts in slices, so that no one gets those of all tasks."""
    parts = n.reshape(-1, (1 << BITS) // SLICES)
    return pa.RecordBatch.from_arrays([pa.array([cls] * len(parts)), pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary()), pa.nulls(len(parts), pa.string())], names=["cls", "slice", "n", "sentence"])


def _summed(counts: DataFrame) -> dict[str, np.ndarray]:
    """The counts of all tasks by class: added up by slices among the executors, one table a class in the end."""

    def add(key, table):
        total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in table.column("n"))
        return pa.table({"cls": pa.array([key[0].as_py()], pa.string()), "slice": pa.array([key[1].as_py()], pa.int32()), "n": pa.array([total.tobytes()], pa.binary())})

    out: dict[str, np.ndarray] = {}
    for r in counts.select("cls", "slice", "n").groupBy("cls", "slice").applyInArrow(add, "cls string, slice int, n binary").collect():
        out.setdefault(r.cls, np.zeros((len(ORDERS) * SLICES, (1 << BITS) // SLICES), np.int64))[r.slice] = np.frombuffer(r.n, np.int64)
    return {c: n.reshape(len(ORDERS), -1) for c, n in out.items()}


def _train_over(texts: DataFrame, column: str) -> Models:
    """:func:`train` over all texts of a frame; tasks count, and the driver gets sums whose size is that of the models."""
    sc = texts.sparkSession.sparkContext

    def over(step, models):
        shared = sc.broadcast(models)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            prose, said = np.zeros((len(ORDERS), 1 << BITS), np.int64), set()
            for batch in batches:
                for at in range(0, batch.num_rows, 2_000):
                    n, more = step(batch.slice(at, 2_000).column(0).to_pylist(), shared.value)
                    prose += n
                    # what a task has given once it doesn't give again; copies from other tasks go below
                    new = sorted({(c, t) for c, found in more.items() for t in found} - said)
                    said.update(new[: max(0, 10_000 - len(said))])
                    if new:
                        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in new]), pa.nulls(len(new), pa.int32()), pa.nulls(len(new), pa.binary()), pa.array([t for _, t in new])], names=["cls", "slice", "n", "sentence"])
            yield _rows("natural", prose)

        def run_sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n: dict[str, np.ndarray] = {}
            for batch in batches:
                found = batch.to_pylist()
                for c in {r["cls"] for r in found}:
                    n[c] = n.get(c, 0) + _count([r["sentence"] for r in found if r["cls"] == c])
            for c in sorted(n):
                yield _rows(c, n[c])

        done = cut(texts.select(column).mapInArrow(run, _COUNTS))
        shared.destroy()
        told = done.where("sentence is not null").select("cls", "sentence").distinct().mapInArrow(run_sentences, _COUNTS)
        none = np.zeros((len(ORDERS), 1 << BITS), np.int64)
        return {"natural": none} | _summed(done.where("slice is not null")) | _summed(told)

    return _train(over)


_FITTED: dict[tuple, Models] = {}


def fit(docs: DataFrame, key: str, column: str):
    """Train on all different texts and hand the models to the executors; their size is fixed by the number of buckets."""
    texts = distinct_texts(docs, column)
    # the same texts give the same models, which are fitted once a session
    same = tuple(texts.agg(F.count("*"), F.sum(F.col("text_hash").cast("decimal(20,0)")), F.bit_xor(F.xxhash64(F.lit(1), column))).first())
    if same not in _FITTED:
        _FITTED.clear()
        _FITTED[same] = _train_over(texts, column)
    return docs.sparkSession.sparkContext.broadcast(_FITTED[same])


def residue(docs: DataFrame, key: str, column: str, models) -> DataFrame:
    """``(key, kind, covered, start, share)`` of every document with residue; whole texts are scored.

    Null, empty and blank texts have none. Repeated rows come out each; extra columns are not read; nothing is
    shuffled.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Models = models.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                texts = part.column(1).to_pylist()
                found = inspect(texts, m)
                rows = [k for k, f in enumerate(found) if f]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int64())), pa.array([found[k].kind for k in rows], pa.string()), pa.array([found[k].covered for k in rows], pa.int32()),
                     pa.array([found[k].start for k in rows], pa.int32()), pa.array([min(1.0, found[k].covered / len(texts[k])) for k in rows], pa.float64())],
                    names=[key, "kind", "covered", "start", "share"],
                )

    return docs.select(key, F.col(column).alias("_text")).mapInArrow(run, f"{key} {kind}, kind string, covered int, start int, share double")
