"""Helpers of the corpus operators: words of whole texts, ranks, files in the shared folder."""

import json
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillscope.functions.staging import ship

#: A word, as a Java regular expression: no ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Bytes of text that are worked on at a time; a longer text is one piece.
CHUNK = 4 << 20
#: Rows that are combined at a time, by a task that deals to shards and by a shard's.
GATHERED = 1 << 18
#: Rows that a task holds before it combines them; what is more than half of that then goes to the shards.
HELD = 3 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[ord("A"):ord("Z") + 1] += 32
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def documents(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/documents.parquet")


def learns(by: int, rest: int) -> Column:
    """True for the documents whose crc32(doc_id as text) mod ``by`` is not ``rest``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % by != rest


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            full = np.full(n, base, np.uint64)
            full[0] = 1
            _powers[k] = np.cumprod(full, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that equal stay equal and any bits may serve as a hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Sums that give the hash of any run of values by ``run_hash``."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def run_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((prefix[end] - prefix[start]) * powers(len(prefix))[1][start])


class Words(NamedTuple):
    """Words of several texts: bytes of all texts, where texts start, and each word's place, text and 64-bit hash."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray

    def first(self) -> np.ndarray:
        """Number of the first word of each text, and the number of words at the end."""
        return np.searchsorted(self.doc, np.arange(len(self.offsets)))

    def bytes_of(self, which: np.ndarray, gap: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the chosen words one after another, each followed by ``gap``; where each starts, and the end."""
        size = self.end[which] - self.start[which] + (gap is not None)
        at = np.concatenate([[0], np.cumsum(size)])
        index = np.arange(at[-1]) + np.repeat(self.start[which] - at[:-1], size)
        out = self.data[np.minimum(index, len(self.data) - 1)] if at[-1] else np.zeros(0, np.uint8)
        if gap is not None:
            out[at[1:] - 1] = gap
        return out, at


def chunks(texts: pa.Array, limit: int = CHUNK):
    """(data, offsets) of consecutive texts, about ``limit`` bytes at a time; null is an empty text."""
    texts = (pc.fill_null(texts, "") if texts.null_count else texts).cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    yield from cut(data, offsets, limit)


def cut(data: np.ndarray, offsets: np.ndarray, limit: int):
    """(data, offsets) of consecutive texts among these, about ``limit`` bytes at a time."""
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> Words:
    n = len(data)
    data = (_LOWER if lower else _SAME)[data]
    space = _SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = edge[n] = True
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    start = np.flatnonzero(~space & (before | edge[:n]))
    end = np.flatnonzero(~space & (after | edge[1:])) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    return Words(data, offsets, start, end, doc, run_hash(prefix_hash(data.astype(np.uint64) + np.uint64(1)), start, end))


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run of ``size``, all runs one after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """Unsigned values with ``width`` bits each, lowest bit first; the rest of the last byte is zero."""
    bits = np.unpackbits(np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits[:, :width], bitorder="little").tobytes()


def unpack_bits(data, width: int, count: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=width * count, bitorder="little").reshape(count, width)
    wide = np.zeros((count, 8), np.uint8)
    packed = np.packbits(bits, axis=1, bitorder="little")
    wide[:, :packed.shape[1]] = packed
    return wide.view("<u8").ravel()


def rank_within(df: DataFrame, keys: list[str], bucket: Column, order: list, name: str) -> DataFrame:
    """Add the place, from 0, of each row among those with its keys: by bucket, then by ``order``.

    Rows of one key and bucket meet in one task, so ``bucket`` has to spread
    the rows of a large key. ``df`` is read twice and should be staged.
    """
    df = df.withColumn("_bucket", bucket)
    count = df.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    count = count.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_bucket").alias("_k_bucket"),
                         F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = df.withColumn("_row", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_bucket") == F.col("_k_bucket")]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return (rows.join(count, on).withColumn(name, F.col("_before") + F.col("_row") - 1)
            .drop("_bucket", "_row", "_before", "_k_bucket", *(f"_k_{k}" for k in keys)))


def components(edges: DataFrame, save) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) can reach.

    Alternates large-star and small-star steps; each is one aggregate and one
    join, and is written by ``save``. It ends where a large-star step changes
    nothing and leaves each node one smaller neighbour: then that neighbour has
    none itself, or the step would have moved the edge.
    """
    edges = save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while True:
        mark = _mark(edges)
        if not mark[0]:
            break
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = save(both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.col("a")).alias("m")))
        # at most one row for each edge, so repeated rows can wait for the small-star step
        large = save(both.join(low, F.col("a") == F.col("n")).where("b > a and m <> b").select(F.col("m").alias("a"), "b"))
        low = save(large.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("m"), F.count("*").alias("rows")))
        if low.agg(F.max("rows")).first()[0] == 1 and _mark(large) == mark:
            break
        near = large.join(low, F.col("b") == F.col("n"))
        small = near.select(F.col("m").alias("a"), "b").union(near.select(F.col("m").alias("a"), F.col("a").alias("b")))
        edges = save(small.where("a <> b").distinct())
    star = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
    return star.union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _mark(edges: DataFrame):
    """Number of edges and the sum of their hashes: equal for equal edges."""
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def opened(uri: str):
    """(file system, path) of a path or URI in a folder that tasks share."""
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def save_arrays(uri: str, arrays: dict[str, np.ndarray], **more) -> None:
    """One file: arrays one after another at multiples of 64 bytes, a JSON footer, its size. Appears whole or not at all."""
    store, path = opened(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    part, told, at = f"{path}.{uuid.uuid4().hex}.tmp", {}, 0
    with store.open_output_stream(part) as out:
        for name, a in arrays.items():
            a = np.ascontiguousarray(a)
            told[name] = (str(a.dtype), a.shape, at)
            pad = -a.nbytes % 64
            out.write(a.tobytes())
            out.write(b"\0" * pad)
            at += a.nbytes + pad
        foot = json.dumps({"arrays": told, "more": more}).encode()
        out.write(foot)
        out.write(len(foot).to_bytes(8, "little"))
    store.move(part, path)


def load_arrays(uri: str) -> tuple[dict[str, np.ndarray], dict]:
    """Arrays of ``save_arrays``, mapped into memory where the store is a file system of the machine."""
    store, path = opened(uri)
    import pyarrow.fs as fs

    data = np.memmap(path, np.uint8, "r") if isinstance(store, fs.LocalFileSystem) else np.frombuffer(store.open_input_file(path).read(), np.uint8)
    size = int.from_bytes(data[-8:].tobytes(), "little")
    foot = json.loads(data[-8 - size:-8].tobytes())
    out = {}
    for name, (kind, shape, at) in foot["arrays"].items():
        n = int(np.prod(shape)) * np.dtype(kind).itemsize
        out[name] = data[at:at + n].view(kind).reshape(shape)
    return out, foot["more"]


def shard_count(df: DataFrame) -> int:
    """Parts of a sorted index over ``df``: a power of two, about one for each partition that is read."""
    return 1 << max(0, df.rdd.getNumPartitions() - 1).bit_length()


def by_range(parts: list, rows: int):
    """``parts``, tuples of arrays sorted by the first, cut at the same keys: lists of tuples with about ``rows`` rows, more only where one key has them."""
    total = sum(len(p[0]) for p in parts)
    step = max(1, rows // (2 * len(parts)))
    some = np.sort(np.concatenate([p[0][step - 1::step] for p in parts]))  # every step-th key, so at most a step of each part lies between two
    keys = np.unique(some[max(1, rows // (2 * step))::max(1, rows // (2 * step))]) if total > rows else some[:0]
    cuts = [[0, *np.searchsorted(p[0], keys).tolist(), len(p[0])] for p in parts]
    for k in range(len(keys) + 1):
        if any(own[k] < own[k + 1] for own in cuts):
            yield [[c[own[k]:own[k + 1]] for c in p] for p, own in zip(parts, cuts)]


def combined(parts: list, combine) -> list:
    """``combine`` on ``parts``, ``GATHERED`` rows at a time: tuples of arrays whose keys lie apart and in order."""
    return [combine([np.concatenate(c) for c in zip(*piece)]) for piece in by_range(parts, GATHERED)]


def dealt(found, combine, shard_of):
    """Tuples of arrays, sorted by the first, as (shard, columns) of one row per key; a task's rows beyond ``HELD`` go out before its end."""
    def out(parts):
        for columns in combined(parts, combine):
            shard = shard_of(columns[0]).astype(np.int64)
            cuts = np.flatnonzero(np.diff(shard)) + 1  # sorted by key, so each shard is one run
            for a, b in zip([0, *cuts], [*cuts, len(shard)]):
                if a < b:
                    yield int(shard[a]), [c[a:b] for c in columns]

    held, size = [], 0
    for columns in found:
        held.append(columns)
        size += len(columns[0])
        if size > HELD:
            held = combined(held, combine)
            size = sum(len(p[0]) for p in held)
            if size > HELD // 2:
                yield from out(held)
                held, size = [], 0
    if held:
        yield from out(held)


def in_shards(df: DataFrame, pairs, combine, shard_of, finish, schema: str, shards: int) -> DataFrame:
    """Exchange numbers as packed arrays, and run ``finish`` on the arrays of each shard, in a task of its own.

    pairs(batches): yields tuples of equally long arrays, the key first and sorted.
    combine(columns): the tuple with one row per key, sorted; applied as soon
    as a task holds many rows and once at its end, so that a frequent key costs
    few rows a task. finish(shard, columns): a dictionary with a row of ``schema``.
    What tasks sent to a shard is combined by ranges of keys, ``GATHERED`` rows at a time.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    told = to_arrow_schema(T.StructType.fromDDL(schema))

    def deal(batches):
        for shard, columns in dealt(pairs(batches), combine, shard_of):
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "payload": pa.array([b"".join(c.astype("<u8").tobytes() for c in columns)], pa.binary()), "width": pa.array([len(columns)], pa.int32())})

    def gather(batches):
        sent = {}
        for batch in batches:
            for shard, payload, width in zip(*(batch.column(x) for x in ("shard", "payload", "width"))):
                sent.setdefault(shard.as_py(), []).append(np.frombuffer(payload.as_buffer(), "<u8").reshape(width.as_py(), -1))
        batch = payload = None  # so that what was sent goes when it is combined
        for shard in sorted(sent):
            pieces = [list(p) for p in combined(sent.pop(shard), combine)]
            columns = []
            for k in range(len(pieces[0])):
                columns.append(np.concatenate([p[k] for p in pieces]))
                for p in pieces:
                    p[k] = None
            yield pa.RecordBatch.from_pylist([finish(shard, columns)], told)

    return df.mapInArrow(deal, "shard int, payload binary, width int").repartitionById(shards, "shard").mapInArrow(gather, schema)


class Sorted:
    """Membership in sorted arrays of 64-bit keys, one file per range of their upper bits; files open when first needed."""

    def __init__(self, folder: str, shards: int, sizes: dict[int, int], name: str = "key"):
        self.folder, self.bits, self.name, self.open = folder, shards.bit_length() - 1, name, {}
        self.sizes = np.array([sizes.get(s, 0) for s in range(shards)], np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.sizes)])

    def shard(self, s: int) -> dict[str, np.ndarray]:
        if s not in self.open:
            self.open[s] = load_arrays(f"{self.folder}/{s:06d}")[0]
        return self.open[s]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each of the sorted ``keys`` among all keys, -1 where it is missing."""
        out = np.full(len(keys), -1, np.int64)
        top = (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        cuts = np.searchsorted(top, np.arange(len(self.sizes) + 1))
        for s in np.flatnonzero((np.diff(cuts) > 0) & (self.sizes > 0)).tolist():
            own, table = slice(cuts[s], cuts[s + 1]), self.shard(s)[self.name]
            at = np.minimum(np.searchsorted(table, keys[own]), len(table) - 1)
            out[own] = np.where(table[at] == keys[own], at + self.offset[s], -1)
        return out


def top_bits(shards: int):
    bits = shards.bit_length() - 1
    return lambda key: (key >> np.uint64(64 - bits)) if bits else np.zeros(len(key), np.uint64)
