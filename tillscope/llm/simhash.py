"""SimHash near-duplicates: Golay-code keys of fingerprint segments, pigeonhole join, exact verification.

The 64 bits form segments of 23, 23 and 18 bits (the last padded with zeros).
If two fingerprints differ in at most three bits, the two segments with the
fewest errors have at most one each. In the perfect [23, 12, 7] code a word is
within three bits of one codeword; its neighbour at one bit is then within
four. So the index of the nearest codeword of one fingerprint is among the
indices within four bits of the other: one primary key per pair of segments on
one side, up to 49 on the other, and no link is lost.

Cases: a null or empty text has no words and the fingerprint zero, linked like
any other. Equal fingerprints are one node however many documents carry them.
A null doc_id takes part; the component id is the smallest id that is not null.
"""

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tillscope.functions.staging import stage
from tillscope.llm.common import chunks, components, documents, words

SHINGLE, DISTANCE = 3, 3
#: Fixed value: generator polynomial of the binary Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
#: First bit and width of the segments of a fingerprint.
SEGMENTS = ((0, 23), (23, 23), (46, 18))


@cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: indices of the error patterns that lead to the nearest codeword, and to those within four bits.

    Returns (patterns, index): ``patterns[s]`` holds the up to six error words
    with syndrome s, nearest first, padded with the nearest; ``index`` maps the
    upper twelve bits of a codeword to its number (they are its number).
    """
    from itertools import combinations

    found: dict[int, list[int]] = {}
    for weight in range(5):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            found.setdefault(int(syndrome(np.array([e]))[0]), []).append(e)
    table = np.zeros((2048, 7), np.int64)
    count = np.zeros(2048, np.int64)
    for s, errors in found.items():
        table[s, :len(errors)], count[s] = errors, len(errors)
    return table, count


def syndrome(word: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words as polynomials by the generator."""
    word = word.copy()
    for bit in range(22, 10, -1):
        word ^= np.where(word >> bit & 1, GENERATOR << (bit - 11), 0)
    return word


def nearby(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 7) numbers of the codewords within four bits, nearest first, and how many there are."""
    table, count = golay()
    s = syndrome(word)
    return (word[:, None] ^ table[s]) >> 11, count[s]


def _hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Fingerprints of the texts."""
    w = words(data, offsets)
    first = w.first()
    joined, at = w.bytes_of(np.arange(len(w.doc)), gap=0x20)
    raw = joined.tobytes()
    # a shingle starts at each word that has two more behind it in its text, and at the first word of a shorter text
    n = np.diff(first)
    starts = np.flatnonzero(np.arange(len(w.doc)) <= np.maximum(first[1:] - SHINGLE, first[:-1])[w.doc])
    stops = np.minimum(starts + SHINGLE, first[1:][w.doc[starts]])
    hashed = xxhash.xxh64_intdigest
    h = np.fromiter((hashed(raw[s:e], 42) for s, e in zip(at[starts].tolist(), (at[stops] - 1).tolist())), np.uint64, len(starts))
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    begin = np.searchsorted(starts, first[some])
    for lo in range(0, len(some), 512):  # 64 counters for each shingle of some texts at a time
        b = begin[lo:lo + 512]
        stop = begin[lo + 512] if lo + 512 < len(some) else len(starts)
        bits = np.unpackbits(h[b[0]:stop].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, b - b[0], axis=0, dtype=np.int64)
        size = np.diff(np.append(b, stop))
        over = (2 * ones > size[:, None]).astype(np.uint8)
        out[some[lo:lo + 512]] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fingerprints(text: pa.Array) -> pa.Array:
    parts = [_hashes(*c) for c in chunks(text)]
    return pa.array(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64))


def fingerprint(text: str) -> Column:
    """The fingerprint of a whole text, its 64 bits as a signed number."""
    return arrow_udf(_fingerprints, "bigint")(text)


def _keys(fp: pa.Array) -> pa.Array:
    """Keys of each pair of segments: the primary one, and all combinations within four bits."""
    x = fp.to_numpy(zero_copy_only=False).view(np.uint64)
    near = [nearby((x >> np.uint64(a) & np.uint64((1 << size) - 1)).astype(np.int64)) for a, size in SEGMENTS]
    one, many, valid = [], [], []
    for tag, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        (ka, na), (kb, nb) = near[a], near[b]
        grid = (tag << 24 | ka[:, :, None] << 12 | kb[:, None, :]).reshape(len(x), 49)
        ok = (np.arange(7) < na[:, None])[:, :, None] & (np.arange(7) < nb[:, None])[:, None, :]
        one.append(grid[:, 0]), many.append(grid), valid.append(ok.reshape(len(x), 49))
    many, valid = np.concatenate(many, 1), np.concatenate(valid, 1)
    ends = np.concatenate([[0], np.cumsum(valid.sum(1))])
    return pa.StructArray.from_arrays([
        pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * len(x) + 1, 3), pa.int32()), pa.array(np.stack(one, 1).ravel())),
        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(many[valid])),
    ], ["one", "many"])


def keys(fp: str) -> Column:
    return arrow_udf(_keys, "struct<one:array<bigint>,many:array<bigint>>")(fp)


def link(fingerprints: DataFrame) -> DataFrame:
    """(fp, root) for the fingerprints (fp, distinct) that link to another: root is the smallest that each can reach.

    A key's smallest holder stands for it; every fingerprint is first linked to
    the representatives of its keys that are near enough, which settles dense
    groups in one row per member and key. Only then are pairs compared, and of
    those just the ones whose ends are in different components so far.
    """
    save = lambda df: stage(df, "links")
    keyed = stage(fingerprints.select("fp", keys("fp").alias("k")).select("fp", "k.*"), "keys")
    one = keyed.select(F.col("fp").alias("a"), F.explode("one").alias("key"))
    many = keyed.select(F.col("fp").alias("b"), F.explode("many").alias("key_b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    first = save(one.groupBy("key").agg(F.min("a").alias("a")))
    edges = many.join(first.hint("shuffle_hash"), (F.col("key") == F.col("key_b")) & near & (F.col("a") != F.col("b"))).select("a", "b").distinct()
    root = save(components(edges, save))
    # pairs across components; a key whose holders are all in one component can't give any
    named = save(fingerprints.join(root, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root")))
    one = named.join(keyed.select(F.col("fp").alias("_fp"), "one"), F.col("fp") == F.col("_fp")).select(F.col("fp").alias("a"), F.col("root").alias("root_a"), F.explode("one").alias("key"))
    many = named.join(keyed.select(F.col("fp").alias("_fp"), "many"), F.col("fp") == F.col("_fp")).select(F.col("fp").alias("b"), F.col("root").alias("root_b"), F.explode("many").alias("key_b"))
    across = many.join(one.hint("shuffle_hash"), (F.col("key") == F.col("key_b")) & (F.col("root_a") != F.col("root_b")) & near)
    more = save(across.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct())
    merged = components(more, save)
    both = named.join(merged.withColumnRenamed("root", "top"), F.col("root") == F.col("node"), "left")
    return save(both.select("fp", F.coalesce("top", "root").alias("root")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for each document; documents link at up to three differing bits."""
    prints = stage(docs.select("doc_id", fingerprint("text").alias("fp")), "prints")
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    root = link(nodes.select("fp"))
    least = nodes.join(root.withColumnRenamed("fp", "_fp"), F.col("fp") == F.col("_fp")).groupBy("root").agg(F.min("least").alias("component_id"))
    ids = stage(root.join(least.withColumnRenamed("root", "_root"), F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "component_id"), "ids")
    return prints.join(ids, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, inside: str = "") -> DataFrame:
    """The documents, less all but one of each group of near-duplicates: the one with the smallest id, null last.

    Where several rows share that id, the one with the smallest hash of its
    text stays, and of rows equal in both any one. ``inside`` is put before the
    names of columns, where these are fields of a struct.
    """
    doc_id, text = F.col(f"{inside}doc_id"), f"{inside}text"
    prints = stage(docs.select(doc_id.alias("doc_id"), F.xxhash64(text).alias("h"), fingerprint(text).alias("fp")), "prints")
    root = link(prints.select("fp").distinct()).withColumnRenamed("fp", "_fp")
    first = (prints.join(root, F.col("fp") == F.col("_fp"))
             .groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")).alias("k")))
    first = stage(first.select(F.col("k.doc_id").alias("_id"), F.col("k.h").alias("_h")), "first")
    kept = docs.withColumn("_hash", F.xxhash64(text)).withColumn("_doc", doc_id)
    kept = kept.join(first, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h")), "left_semi")
    one = Window.partitionBy("_doc", "_hash").orderBy("_doc")
    return kept.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n", "_hash", "_doc")


def op6_simhash_golay(spark, folder: str) -> DataFrame:
    out = near_duplicates(documents(spark, folder))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
