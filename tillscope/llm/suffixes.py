"""Repeated passages across documents, by sparse suffix arrays.

Suffixes are kept only where a 5-word gram is the least of ``SPAN``
neighbouring ones, so any two equal passages keep the same suffixes, about one
in ten. A passage of ``LENGTH`` words has a kept suffix among its first
``SPAN`` words, so at least ``LENGTH`` − ``SPAN`` + 1 words of it follow there.

First, kept suffixes are dealt into ranges by a hash of those first words, and
only first words that two documents have go on. Then each range sorts its
suffixes by first words and the words behind them, compares neighbours, and
extends matches: to the right by the words that neighbours share, to the left
by sorting anew within suffixes that share one word more before them, since the
partner that agrees longest to the right need not be the one that does to the
left. Both ends go as far as a passage of ``LENGTH`` words around the suffix can; the next kept suffix takes over from there.
Equal suffixes with equal words before them are one row for each task, so copies
of a document, however many, are not compared one by one. Last, the texts are read
again, each kept suffix looks up how far it goes, and what overlaps or touches
is one passage.

Words are compared by 64-bit hashes, the first words by one hash of them all.
The sorted results are files in the shared folder, split by ranges and mapped into
memory; whole texts are read three times and never moved.

Words are taken with A-Z in lower case. Cases: a null or empty text, or one
shorter than a passage, has no passages. Rows with one doc_id and one text are
one document. Copies of a document repeat it as a whole.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tillscope.functions.staging import shared_path, stage
from tillscope.llm.common import Sorted, chunks, documents, in_shards, load_arrays, mixed, prefix_hash, run_hash, save_arrays, shard_count, top_bits, words

LENGTH, SPAN, GRAM = 50, 20, 5
#: Bytes of text that are worked on at a time; a longer text is one piece.
PIECE = 1 << 20
#: Ranges of extents for each range of first words, and suffixes that are sorted at a time, or as many as share their first words.
FINER, BLOCK = 4, 1 << 15


def windows(data: np.ndarray, offsets: np.ndarray, length: int):
    """(words, starts of all windows of ``length`` words, each one's kept suffix, prefix hashes of the words)."""
    w = words(data, offsets)
    first = w.first()
    n = len(w.doc)
    start = np.flatnonzero(np.arange(n) <= first[1:][w.doc] - length) if n else np.zeros(0, int)
    prefix = prefix_hash(w.hash)
    if not len(start):
        return w, start, start, prefix
    grams = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    at = np.arange(max(0, n - GRAM + 1))
    grams[:len(at)] = run_hash(prefix, at, at + GRAM)
    kept = np.empty(len(start), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, min(SPAN, n))
    for lo in range(0, len(start), 1 << 17):
        kept[lo:lo + (1 << 17)] = start[lo:lo + (1 << 17)] + view[start[lo:lo + (1 << 17)]].argmin(1)
    return w, start, kept, prefix


def _spread(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row per key, sorted, with the least and the greatest document."""
    key, low, high = columns
    order = np.argsort(key, kind="stable")
    key, low, high = key[order], low[order], high[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    return (key[at], np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)) if len(at) else (key, low, high)


def _index(docs: DataFrame, keys, name: str) -> tuple[str, int, dict[int, int]]:
    """Write the sorted keys that two documents have; keys(data, offsets) gives (key, text number) of some texts."""
    folder, shards = shared_path(docs.sparkSession, name), shard_count(docs)

    def pairs(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            who, at = batch.column("who").to_numpy(zero_copy_only=False).view(np.uint64), 0
            for data, offsets in chunks(batch.column("text"), PIECE):
                key, doc = keys(data, offsets)
                yield _spread([key, who[at + doc], who[at + doc]])
                at += len(offsets) - 1

    def finish(shard: int, columns) -> dict:
        key, low, high = columns
        key = key[low != high]
        save_arrays(f"{folder}/{shard:06d}", {"key": key})
        return {"shard": shard, "n": len(key)}

    done = in_shards(docs, pairs, _spread, top_bits(shards), finish, "shard long, n long", shards)
    return folder, shards, dict(stage(done, name).where("n > 0").collect())


def neighbours(first: np.ndarray, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray, have: np.ndarray, base: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """How many words to the left and from its place to the right the repeated passages of each suffix go; 0, 0 without one.

    ``first``: hash of the first ``base`` words; ``left``, ``right``: words before
    the place, nearest first, and behind the first words; ``have``: how many of
    them there are; ``low``, ``high``: least and greatest document with that suffix.
    """
    n, span = left.shape
    out_left, out_right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    shared = low != high
    # sort suffixes by their words; ``rank`` stands for the order of the words behind the first ones
    rank = np.empty(n, np.int64)
    rank[np.lexsort((*right.T[::-1],))] = np.arange(n)
    group, met = first.copy(), np.ones(n, bool)
    for words_left in range(span + 1):
        if words_left:  # suffixes that share one more word to the left
            group = mixed(group * np.uint64(0x9E3779B97F4A7C15) + left[:, words_left - 1])
            met &= have[:, 0] >= words_left
        own = np.flatnonzero(met)
        order = own[np.lexsort((rank[own], group[own]))]
        together = group[order][1:] == group[order][:-1]
        same = right[order][1:] == right[order][:-1]
        common = np.where(together, np.where(same.all(1), span, same.argmin(1)), -1)
        # the nearest suffix of another document to each side; one that several have is another's and its own
        doc = np.where(shared[order], np.uint64(0), low[order])
        best = np.where(shared[order], span, -1)
        for step in (1, -1):
            c = np.concatenate([[-1], common]) if step == 1 else np.concatenate([[-1], common[::-1]])
            d, s = doc[::step], shared[order][::step]
            apart = np.ones(len(d), bool)
            apart[1:] = (d[1:] != d[:-1]) | s[1:] | s[:-1]
            run = pd.Series(c).groupby(np.cumsum(apart)).cummin().to_numpy()  # back to before the run of one document
            best = np.maximum(best, run[::step])
        reach = base + np.minimum(best, have[order, 1])
        good = (best >= 0) & (words_left + reach >= length)
        some = order[good]
        out_left[some] = words_left
        out_right[some] = np.maximum(out_right[some], reach[good])
    return out_left, out_right


def _contexts(w, at: np.ndarray, prefix: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the first ``base`` words, words before, words behind those, how many there are) of the suffixes at some words."""
    first, reach = w.first(), np.arange(SPAN - 1)
    before = np.minimum(at - first[w.doc[at]], SPAN - 1)
    behind = np.minimum(first[1:][w.doc[at]] - at - base, SPAN - 1)
    left = np.where(reach < before[:, None], w.hash[np.maximum(at[:, None] - 1 - reach, 0)], np.uint64(0))
    right = np.where(reach < behind[:, None], w.hash[np.minimum(at[:, None] + base + reach, len(w.hash) - 1)], np.uint64(0))
    return run_hash(prefix, at, at + base), left, right, np.stack([before, behind], 1)


def _name(first: np.ndarray, left: np.ndarray, right: np.ndarray, have: np.ndarray) -> np.ndarray:
    """Hash of a suffix with what is around it."""
    h = first.copy()
    for column in (*left.T, *right.T, *have.T.astype(np.uint64)):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + column)
    return h


def repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_words, n_repeated, passages) of every document; passages: places (start, end) in words, end exclusive."""
    base = length - SPAN + 1
    if base < 1:
        raise ValueError(f"passages have {SPAN} words at least")
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("who"))

    def suffixes(data, offsets):
        w, start, kept, prefix = windows(data, offsets, length)
        at = np.unique(kept)
        return run_hash(prefix, at, at + base), w.doc[at]

    first = _index(docs.select("who", "text"), suffixes, "suffixes")

    def met(index: Sorted, data, offsets):
        """Kept suffixes whose first words another document has too."""
        w, start, kept, prefix = windows(data, offsets, length)
        at = np.unique(kept)
        key, back = np.unique(run_hash(prefix, at, at + base), return_inverse=True)
        at = at[(index.find(key) >= 0)[back]] if len(at) else at
        return w, at, _contexts(w, at, prefix, base)

    folder, shards = shared_path(docs.sparkSession, "extents"), first[1] * FINER
    bits = shards.bit_length() - 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Sorted(*first)
        for batch in batches:
            who, row = batch.column("who").to_numpy(zero_copy_only=False).view(np.uint64), 0
            for data, offsets in chunks(batch.column("text"), PIECE):
                w, at, (key, left, right, have) = met(index, data, offsets)
                doc = who[row + w.doc[at]]
                row += len(offsets) - 1
                if not len(at):
                    continue
                rows = np.column_stack([key, _name(key, left, right, have), doc, doc, have.astype(np.uint64), left, right])
                rows = _distinct(rows)
                shard = (rows[:, 0] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(rows), np.int64)
                cuts = np.searchsorted(shard, np.arange(shards + 1))
                some = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([rows[cuts[s]:cuts[s + 1]].astype("<u8").tobytes() for s in some], pa.binary())], ["shard", "payload"])

    width = 6 + 2 * (SPAN - 1)

    def extend(key, table):
        shard = key[0].as_py()
        rows = _distinct(np.concatenate([np.frombuffer(x.as_buffer(), "<u8").reshape(-1, width) for x in table["payload"]]))
        left, right = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        starts = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))  # of suffixes with the same first words
        cuts = np.unique(starts[np.searchsorted(starts, np.arange(0, len(rows), BLOCK), side="right") - 1])
        for a, b in zip(cuts, [*cuts[1:], len(rows)]):
            some = rows[a:b]
            left[a:b], right[a:b] = neighbours(some[:, 0], some[:, 6:6 + SPAN - 1], some[:, 6 + SPAN - 1:], some[:, 2], some[:, 3], some[:, 4:6].astype(np.int64), base, length)
        found = np.flatnonzero(right)
        found = found[np.argsort(rows[found, 1])]
        save_arrays(f"{folder}/{shard:06d}", {"key": rows[found, 1], "left": left[found].astype(np.uint16), "right": right[found].astype(np.uint16)})
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(found)], pa.int64())})

    done = docs.select("who", "text").mapInArrow(deal, "shard int, payload binary").groupBy("shard").applyInArrow(extend, "shard int, n long")
    sizes = dict(stage(done, "extents").where("n > 0").collect())

    def passages(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        suffix, opened = Sorted(*first), {}
        for text in texts:
            n_words, n_repeated, begin, end, count = [], [], [], [], []
            for data, offsets in chunks(text, PIECE):
                w, at, (key, left, right, have) = met(suffix, data, offsets)
                name = _name(key, left, right, have)
                go = np.zeros((len(at), 2), np.int64)
                shard = (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(at), np.int64)
                for s in np.unique(shard).tolist():
                    if s in sizes:
                        if s not in opened:
                            opened[s] = load_arrays(f"{folder}/{s:06d}")[0]
                        own, table = np.flatnonzero(shard == s), opened[s]
                        place = np.minimum(np.searchsorted(table["key"], name[own]), len(table["key"]) - 1)
                        hit = table["key"][place] == name[own]
                        go[own[hit]] = np.stack([table["left"][place[hit]], table["right"][place[hit]]], 1)
                some = go[:, 1] > 0
                a, b, doc = (at - go[:, 0])[some], (at + go[:, 1])[some], w.doc[at[some]]
                order = np.lexsort((a, doc))
                a, b, doc = a[order], b[order], doc[order]
                # what overlaps or touches within a text is one passage; places grow from text to text, so ends do
                so_far = np.maximum.accumulate(b) if len(b) else b
                new = np.concatenate([[True], (a[1:] > so_far[:-1]) | (doc[1:] != doc[:-1])]) if len(a) else np.zeros(0, bool)
                last = np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1) if len(a) else np.zeros(0, int)
                a, b, doc = a[new], so_far[last], doc[new]
                first_word, n = w.first(), len(offsets) - 1
                n_words.append(np.diff(first_word))
                n_repeated.append(np.bincount(doc, weights=b - a, minlength=n).astype(np.int64))
                begin.append(a - first_word[doc]), end.append(b - first_word[doc])
                count.append(np.bincount(doc, minlength=n))
            flat = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
            places = pa.StructArray.from_arrays([pa.array(flat(begin)), pa.array(flat(end))], ["start", "end"])
            ends = np.concatenate([[0], np.cumsum(flat(count))])
            yield pa.StructArray.from_arrays([pa.array(flat(n_words)), pa.array(flat(n_repeated)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), places)], ["n_words", "n_repeated", "passages"])

    passages.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    found = arrow_udf(passages, "struct<n_words:bigint,n_repeated:bigint,passages:array<struct<start:bigint,end:bigint>>>")
    return docs.select("doc_id", found("text").alias("p")).select("doc_id", "p.*")


def _distinct(rows: np.ndarray) -> np.ndarray:
    """One row for each (first words, name), sorted, with the least and the greatest document of its copies."""
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    key, name = rows[order, 0], rows[order, 1]
    at = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (name[1:] != name[:-1])]))
    out = rows[order[at]]
    out[:, 2], out[:, 3] = np.minimum.reduceat(rows[order, 2], at), np.maximum.reduceat(rows[order, 3], at)
    return out


def op8_sparse_suffixes(spark, folder: str) -> DataFrame:
    """The documents with a passage that another document has too."""
    return repeated(documents(spark, folder)).where("n_repeated > 0")
