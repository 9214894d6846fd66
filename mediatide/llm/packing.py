"""Items of varying length packed into containers of fixed capacity, neighbours in content together.

Each document becomes a hashed vector of its character n-grams, projected to a few dimensions; its place on a
Hilbert curve through that space is its sort key. Documents are range-sorted by the key across the cluster and packed
in that order: every container begins with the first document that has no place yet and is filled from the documents
that follow it on the curve. Which of them fill it is found exactly, by the sums that subsets of the nearest can
reach; the window is widened only while the container is not full enough. Only an item larger than the capacity is
split: into full containers and a rest that is packed like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .encoding import TOKENIZERS, encoder

#: Dimensions of the projected space and bits of each on the curve.
DIMENSIONS, BITS = 4, 8
#: Buckets of the hashed n-gram vector.
BUCKETS = 1 << 12
#: Documents a partition of the curve has at least, where there are as many.
LEAST_PART = 2_048
#: Documents of a partition that are held at once; what is left open at a stretch's end is closed there.
STRETCH = 65_536
#: Documents after the first of a container that it may be filled from: at once, and at most.
NEAR, FAR = 32, 512
#: Share of a container that is full enough.
FULL = 0.995
#: Characters that are looked at in one go.
MOST_CHARS = 2_000_000


def hilbert_index(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Distance along the Hilbert curve of each row of integer coordinates (transpose method, all rows at once)."""
    x = points.astype(np.uint32).copy()
    n = x.shape[1]
    q = np.uint32(1 << (bits - 1))
    while q > 1:
        p = np.uint32(q - 1)
        for i in range(n):
            on = (x[:, i] & q) != 0
            x[on, 0] ^= p
            t = (x[~on, 0] ^ x[~on, i]) & p
            x[~on, 0] ^= t
            x[~on, i] ^= t
        q >>= np.uint32(1)
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.uint32)
    q = np.uint32(1 << (bits - 1))
    while q > 1:
        on = (x[:, n - 1] & q) != 0
        t[on] ^= np.uint32(q - 1)
        q >>= np.uint32(1)
    x ^= t[:, None]
    out = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[:, i] >> np.uint32(b) & 1).astype(np.int64)
    return out


def _projection() -> np.ndarray:
    """Fixed random signs, one row a bucket: the same on every executor."""
    return np.random.default_rng(20240229).choice(np.array([-1.0, 1.0], np.float32), size=(BUCKETS, DIMENSIONS))


def _gram_buckets(codes: np.ndarray) -> np.ndarray:
    h = codes[:-3] * np.uint32(2654435761) ^ codes[1:-2] * np.uint32(2246822519) ^ codes[2:-1] * np.uint32(3266489917) ^ codes[3:] * np.uint32(668265263)
    return (h >> np.uint32(20)).astype(np.int64) & (BUCKETS - 1)


def curve_keys(texts: list[str], signs: np.ndarray) -> np.ndarray:
    """Place on the curve of each text: hashed character 4-grams, signs summed, squashed to the grid."""
    if len(texts) == 1 and len(texts[0]) > MOST_CHARS:
        # a text beyond all measure is counted bucket by bucket, a stretch at a time
        total = np.zeros(BUCKETS, np.int64)
        for at in range(0, len(texts[0]) - 3, MOST_CHARS):
            codes = np.frombuffer(texts[0][at : at + MOST_CHARS + 3].encode("utf-32-le", "replace"), np.uint32)
            total += np.bincount(_gram_buckets(codes), minlength=BUCKETS)
        return _places((total @ signs.astype(np.float64) / np.sqrt(len(texts[0])))[None])
    size = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    out = np.zeros((len(texts), DIMENSIONS), np.float64)
    if len(codes) >= 4:
        vectors = signs[_gram_buckets(codes)]
        run = np.concatenate((np.zeros((1, DIMENSIONS)), np.cumsum(vectors, axis=0, dtype=np.float64)))
        ends = np.cumsum(size)
        begins = ends - size
        last = np.maximum(begins, np.minimum(ends - 3, len(run) - 1))
        has = size >= 4
        out[has] = (run[last[has]] - run[begins[has]]) / np.sqrt(size[has])[:, None]
    return _places(out)


def _places(out: np.ndarray) -> np.ndarray:
    grid = np.clip((np.tanh(out / 3) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.uint32)
    return hilbert_index(grid)


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of at most 512 rows and about ``MOST_CHARS`` characters; a longer text is a slice of its own."""
    size = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    at, chars = 0, 0
    for k, n in enumerate(size):
        if k > at and (k - at >= 512 or chars + n > MOST_CHARS):
            yield batch.slice(at, k - at)
            at, chars = k, 0
        chars += int(n)
    if len(size) > at:
        yield batch.slice(at)


def measured(docs: DataFrame, key: str, column: str, folder: str = TOKENIZERS) -> DataFrame:
    """``(key, n_tokens, place)`` of every row: its size in tokens and its place on the curve.

    Null and empty texts have size 0. Repeated rows come out each; nothing is shuffled.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, signs = encoder(folder), _projection()
        for batch in batches:
            for part in _portions(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                n = [len(enc.encode_ordinary(t)) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int32()), pa.array(curve_keys(texts, signs))], names=[key, "n_tokens", "place"])

    return docs.select(key, F.col(column).alias("_text")).mapInArrow(run, f"{key} {kind}, n_tokens int, place long")


def fill(sizes: list[int], room: int, enough: int) -> list[int]:
    """The positions of a subset whose sum comes to ``enough``, made of the first items that can, or else is as near to ``room`` as can be.

    Bit ``s`` of a number says that the sum ``s`` can be reached; one shift adds an item to all sums at once.
    """
    mask, reach, seen = (1 << room + 1) - 1, 1, [1]
    for size in sizes:
        reach |= reach << size & mask if size <= room else 0
        seen.append(reach)
        if reach >> enough:
            break
    best, out = reach.bit_length() - 1, []
    for k in range(len(seen) - 1, 0, -1):
        # an item is only used where the ones before it don't reach the sum
        if not seen[k - 1] >> best & 1:
            out.append(k - 1)
            best -= sizes[k - 1]
    return out[::-1]


def along_curve(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item, numbered from 0 in the order of their first items; sizes are between 0 and ``capacity``.

    Items of size 0 go where the item before them is (the first ones into the first container).
    """
    which = np.full(len(sizes), -1, np.int64)
    solid = np.flatnonzero(sizes > 0)
    size = sizes[solid].tolist()
    enough = int(np.ceil(capacity * FULL))
    # the items without a container among the next ones, in order
    open_: list[int] = []
    at = count = 0
    while open_ or at < len(size):
        window = NEAR
        while True:
            while len(open_) <= window and at < len(size):
                open_.append(at)
                at += 1
            room = capacity - size[open_[0]]
            others = [k + 1 for k in fill([size[k] for k in open_[1 : window + 1]], room, max(0, room - capacity + enough))]
            held = capacity - room + sum(size[open_[k]] for k in others)
            if held >= enough or window >= FAR or window >= len(open_) and at == len(size):
                break
            window *= 4
        taken = {0, *others}
        for k in taken:
            which[solid[open_[k]]] = count
        open_ = [x for k, x in enumerate(open_) if k not in taken]
        count += 1
    # items of size 0: where the item before them is
    last = np.maximum.accumulate(np.where(which >= 0, np.arange(len(which)), -1)) if len(which) else which
    return np.where(last >= 0, which[np.maximum(last, 0)], 0)


def pack(sized: DataFrame, key: str, capacities: list[tuple[str, int]]) -> DataFrame:
    """``(container_kind, container_id, key, piece, from_token, n_tokens, curve_rank)``: every item in containers of every kind.

    ``sized`` has key, n_tokens and place. An item that fits is one piece (0); a larger one is cut into pieces of
    the full capacity, numbered in order, and a rest. Container ids are unique within a kind. An item of size 0
    gets a container too and takes no room. The same row twice counts as two items. ``curve_rank`` rises along the
    curve, by one from item to item within a partition, which the lower 40 bits count.
    """
    kind = sized.schema[key].dataType.simpleString()
    cores = sized.sparkSession.sparkContext.defaultParallelism
    # equal places are kept apart by the key's hash: no text, however often it recurs, makes one partition
    ranked = cut(sized.withColumn("_tie", F.xxhash64(key)))
    n = ranked.count()
    # a few tasks a core, and more where there are so many documents that a stretch is shorter than a task's share
    parts = max(1, min(n // LEAST_PART, max(cores * 3, n // STRETCH)))
    sorted_ = ranked.repartitionByRange(parts, "place", "_tie").sortWithinPartitions("place", "_tie", key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, stretch, rank = TaskContext.get().partitionId(), 0, 0
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            while rows >= 2 * STRETCH:
                table = pa.Table.from_batches(held)
                yield from one(table.slice(0, STRETCH), part, stretch, rank)
                held, rows, stretch, rank = table.slice(STRETCH).to_batches(), rows - STRETCH, stretch + 1, rank + STRETCH
        if rows:
            yield from one(pa.Table.from_batches(held), part, stretch, rank)

    def one(table: pa.Table, part: int, stretch: int, rank: int) -> Iterator[pa.RecordBatch]:
        sizes = table.column("n_tokens").to_numpy().astype(np.int64)
        for name, capacity in capacities:
            pieces = np.maximum(1, -(-sizes // capacity))
            item = np.repeat(np.arange(len(sizes)), pieces)
            number = np.arange(len(item)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = number * capacity
            length = np.minimum(sizes[item] - begin, capacity)
            ids = ((np.int64(part) << 40) | (np.int64(stretch) << 24)) + along_curve(length, capacity)
            for at in range(0, len(item), 20_000):
                s = slice(at, at + 20_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(item[s]), pa.string()), pa.array(ids[s]), table.column(key).take(pa.array(item[s])).combine_chunks(), pa.array(number[s], pa.int32()),
                     pa.array(begin[s], pa.int32()), pa.array(length[s], pa.int32()), pa.array((np.int64(part) << 40) + rank + item[s])],
                    names=["container_kind", "container_id", key, "piece", "from_token", "n_tokens", "curve_rank"],
                )

    return sorted_.select(key, "n_tokens").mapInArrow(run, f"container_kind string, container_id long, {key} {kind}, piece int, from_token int, n_tokens int, curve_rank long")


def use(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """One row a kind: how many containers, their tokens, the share of them that is filled, and how far along the curve
    the items of a container lie apart (``median_span``, in items; containers of several items only)."""
    span = F.max("curve_rank") - F.min("curve_rank") + 1
    held = packed.groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("used"), F.when(F.count("*") > 1, span).alias("span"))
    sums = held.groupBy("container_kind").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.percentile_approx("span", 0.5, 10_000).alias("median_span"))
    room = F.col("containers") * F.col("capacity_tokens")
    return sums.join(F.broadcast(containers), "container_kind").select("container_kind", "capacity_tokens", "containers", "tokens", (F.col("tokens") / room).alias("filled"), "median_span")
