"""Token ids of a whole corpus by a public byte-level BPE vocabulary.

Most texts are encoded in one call. A text longer than ``SPLIT`` characters is cut into parts that are rows of
their own and are encoded in parallel: between two words of the vocabulary's own pre-tokenisation where there is
such a place (then the ids are simply joined), and inside a word where a single word is longer than ``LEAF``
characters. Parts of one word are joined pair by pair up a tree: the tokens around a join are encoded again in a
window that grows until its first and last token are the tokens that both sides already have there. A sequence of
BPE tokens is the encoding of its text if every two neighbours are, so from then on the whole sequence agrees.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Folder of the public vocabulary files.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Characters beyond which a text is cut into parts, and beyond which a single word is cut.
SPLIT, LEAF = 16_384, 4_096
# fixed value: the vocabulary's pre-tokenisation
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoder(folder: str = TOKENIZERS, file: str = VOCABULARY):
    """The encoder of a rank file; loaded once a process."""
    import tiktoken

    with open(os.path.join(folder, file), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _words():
    import regex

    return regex.compile(PATTERN)


def cut_text(text: str, split: int = SPLIT, leaf: int = LEAF) -> list[tuple[str, bool, bool]]:
    """The parts of a text: each with whether it goes on inside the word of the part before, and whether it is a
    stretch of one word, to be encoded without pre-tokenisation.

    A blank before a cut would be tokenised differently at a part's end, so blanks there are parts of their own.
    """
    parts: list[tuple[str, bool, bool]] = []
    start = 0
    blanks: list[tuple[int, int]] = []

    def flush(end: int) -> None:
        body = blanks[0][0] if blanks else end
        if body > start:
            parts.append((text[start:body], False, False))
        parts.extend((text[a:b], False, True) for a, b in blanks)
        blanks.clear()

    for m in _words().finditer(text):
        a, b = m.span()
        if b - a > leaf:
            flush(a)
            parts += [(text[i : min(i + leaf, b)], i > a, True) for i in range(a, b, leaf)]
            start = b
            continue
        if b - start > split and a > start:
            flush(a)
            start = a
        if m[0].isspace():
            blanks.append((a, b))
        else:
            blanks.clear()
    if start < len(text):
        parts.append((text[start:], False, False))
    return parts


def encode_piece(text: str, enc) -> list[int]:
    """Ids of a stretch inside one word: no pre-tokenisation, merges only."""
    return enc._core_bpe.encode_single_piece(text.encode("utf-8", "replace"))


def join_ids(left: list[int], right: list[int], enc) -> list[int]:
    """Ids of the joined text of two neighbouring stretches of one word."""
    if not left or not right:
        return left or right
    i, j = min(4, len(left)), min(4, len(right))
    core = enc._core_bpe
    while True:
        window = b"".join(map(enc.decode_single_token_bytes, left[-i:] + right[:j]))
        ids = core.encode_single_piece(window)
        left_ok = i == len(left) or ids[0] == left[-i]
        right_ok = j == len(right) or ids[-1] == right[j - 1]
        if left_ok and right_ok:
            return left[:-i] + ids + right[j:]
        if not left_ok:
            i = min(2 * i, len(left))
        if not right_ok:
            j = min(2 * j, len(right))


def _clean(text: str | None) -> str:
    return text or ""


def encode_corpus(df: DataFrame, key: str, column: str, folder: str = TOKENIZERS, split: int = SPLIT, leaf: int = LEAF) -> DataFrame:
    """``(key, ids)`` of every row of ``df``. Null and empty texts have an empty list; repeated rows come out each.

    Special tokens' names in a text are ordinary text. Extra columns are not read. Only the parts of long texts are
    shuffled; the group of one text holds that text's ids and nothing else.
    """
    text = df.select(F.col(key), F.col(column).alias("_text"))
    kind = df.schema[key].dataType.simpleString()
    ids = "array<int>"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                # one call a text: a batch call goes through a thread pool, which costs more than it saves in a worker of one core
                lists = pa.array([enc.encode_ordinary(_clean(t)) for t in part.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[key, "ids"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                one = batch.slice(r, 1)
                parts = cut_text(one.column("_text")[0].as_py(), split, leaf)
                n = len(parts)
                # the first part of the word that a part is of, its place there, and how many parts the word has
                first = np.maximum.accumulate(np.where([not p[1] for p in parts], np.arange(n), 0))
                size = np.bincount(first, minlength=n)[first]
                yield pa.RecordBatch.from_arrays(
                    [one.column("_row").take(pa.array([0] * n)), one.column(key).take(pa.array([0] * n)), pa.array(first, pa.int32()), pa.array(np.arange(n) - first, pa.int32()), pa.array(size, pa.int32()),
                     pa.array([p[2] for p in parts]), pa.array([p[0] for p in parts], pa.string())],
                    names=["_row", key, "word", "seq", "size", "inside", "piece"],
                )

    def encode_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder)
        for batch in batches:
            texts, inside = batch.column("piece").to_pylist(), batch.column("inside").to_pylist()
            got = [encode_piece(t, enc) if w else enc.encode_ordinary(t) for t, w in zip(texts, inside, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("_row", key, "word", "seq", "size")] + [pa.array(got, pa.list_(pa.int32()))],
                names=["_row", key, "word", "seq", "size", "ids"],
            )

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One level of the tree: neighbours, which stand one after the other, become one part."""
        enc = encoder(folder)
        kinds = None

        def row(held: tuple) -> pa.RecordBatch:
            r, k, word, seq, size, ids = held
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((r, k, word, seq // 2, size, ids), kinds, strict=True)], names=["_row", key, "word", "seq", "size", "ids"])

        held = None
        for batch in batches:
            kinds = batch.schema.types
            for now in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is not None and held[0] == now[0] and held[2] == now[2] and held[3] // 2 == now[3] // 2:
                    held = (*held[:5], join_ids(held[5], now[5], enc))
                    continue
                if held is not None:
                    yield row(held)
                held = now
        if held is not None:
            yield row(held)

    def join(table: pa.Table) -> pa.Table:
        """The ids of a text: its words and the parts between them in order."""
        ids = table.sort_by("word").column("ids").combine_chunks().flatten()
        return pa.table({key: table.column(key).slice(0, 1), "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)})

    short = text.where(F.col("_text").isNull() | (F.length("_text") <= split)).mapInArrow(whole, f"{key} {kind}, ids {ids}")
    long = text.where(F.length("_text") > split).withColumn("_row", F.monotonically_increasing_id())
    parted = long.select("_row", key, "_text").mapInArrow(pieces, f"_row long, {key} {kind}, word int, seq int, size int, inside boolean, piece string")
    shape = f"_row long, {key} {kind}, word int, seq int, size int, ids {ids}"
    done = cut(parted.repartition("_row", "word", "seq").mapInArrow(encode_parts, shape))
    # the parts of very long words are joined up a tree, each level by all tasks; most corpora have no such word
    most = done.agg(F.max("size")).first()[0] or 1
    if most > 1:
        tree = done.where("size > 1")
        while most > 1:
            pair = (F.col("seq") / 2).cast("int")
            tree = tree.repartition("_row", "word", pair).sortWithinPartitions("_row", "word", "seq").mapInArrow(pairs, shape)
            most = (most + 1) // 2
        done = done.where("size = 1").unionByName(tree)
    return short.unionByName(done.groupBy("_row").applyInArrow(join, f"{key} {kind}, ids {ids}"))


def count_tokens(df: DataFrame, keep: list[str], column: str, folder: str = TOKENIZERS) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` (0 for null and empty texts) of every row; nothing is shuffled."""
    cols = df.select(*keep, F.col(column).alias("_text"))
    schema = ", ".join(f"`{c}` {cols.schema[c].dataType.simpleString()}" for c in keep) + ", n_tokens int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder)
        for batch in batches:
            texts = pc.fill_null(batch.column(len(keep)), "").to_pylist()
            size = [len(enc.encode_ordinary(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(size, pa.int32())], names=[*keep, "n_tokens"])

    return cols.mapInArrow(run, schema)
