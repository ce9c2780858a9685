"""Scoring by an n-gram language model in an Elias-Fano trie.

The first level is the sorted hashes of all training tokens with their counts.
Each further level holds, for every n-gram of the level before as context, the
tokens that follow it at least ``LEAST`` times, which is all of them: an Elias-Fano sequence of
pointers to where each context's successors begin, an Elias-Fano sequence of
the successors themselves (made monotone by adding the last value of the
context before), and quantised probabilities. Levels are split by ranges of
n-grams into files of the shared folder, which tasks map into memory. A range
has about its share of the contexts and of their occurrences. The followers of
a frequent context lie in several ranges, by their numbers, which follow from
hashes: those files keep their counts, and the level has the context's weight.

Smoothing is Witten-Bell: with c(h) followers of a context, T(h) of them
distinct, p(w | h) = c(hw) / (c(h) + T(h)) + g(h) p(w | shorter h), where g(h)
takes what is left; followers seen less often than a higher ``least`` count here.
The shortest context is the base distribution of single tokens. Quantising
rounds down, so probabilities never sum to more than one. All counts cover all
training documents.

Cases: a null or empty text is the end token alone. A token not seen in
training has the base probability of a count of 0. Without training documents
every token has the same probability. Repeated rows count and score each.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tillscope.functions.staging import shared_path, stage
from tillscope.llm.common import Sorted, chunks, cut, documents, in_shards, learns, load_arrays, pack_bits, save_arrays, shard_count, top_bits, words

ORDER, LEAST = 3, 1
#: The end token's hash; a word has this hash with a chance of 2^-64.
END = np.uint64(0x0E0E0E0E0E0E0E0E)
#: Steps of quantised probabilities and weights: this many for a factor of ten.
STEPS = 32
#: Bytes of text whose tokens are looked up at a time, and that are parted into tokens at a time; a longer text is one piece.
PIECE, PARTED = 2 << 20, 1 << 19
#: Values that are packed at a time; a multiple of 8, so that pieces end with whole bytes.
PACKED = 1 << 16
#: Runs of n-grams whose occurrences each shard reports, besides each n-gram that has such a share alone.
RUNS = 64
#: Occurrences of contexts for each shard of a level, where there are more than shards of single tokens can share.
SHARE = 1 << 22
_NTH = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.int64)


class EliasFano:
    """A sequence of numbers that never falls: low bits packed, high bits as gaps in unary."""

    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        # as plain arrays: each slice of a mapped one is an object of its own
        low, high, self.zeros = (np.asarray(arrays[f"{name}_{x}"]) for x in ("low", "high", "zeros"))
        self.low = np.ndarray(len(low) - 7, "<u8", low, strides=1)  # the eight bytes from each byte on
        self.high = high.view("<u8")
        self.width, self.count = (int(x) for x in arrays[f"{name}_size"])

    @staticmethod
    def arrays(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = min(48, max(0, (top // max(n, 1)).bit_length() - 1))
        bits = np.zeros(-(-(n + (top >> width) + 2) // 64) * 64, np.uint8)
        for i in range(0, n, PACKED):
            own = (values[i:i + PACKED] >> np.uint64(width)).astype(np.int64)
            bits[own + np.arange(i, i + len(own))] = 1
        high = np.packbits(bits, bitorder="little")
        zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(high.view("<u8")).astype(np.int64))])
        low = np.frombuffer(b"".join(pack_bits(values[i:i + PACKED], width) for i in range(0, n if width else 0, PACKED)), np.uint8)
        return {f"{name}_low": np.append(low, np.zeros(8, np.uint8)), f"{name}_high": high, f"{name}_zeros": zeros, f"{name}_size": np.array([width, n])}

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Place of the k-th (from 0) one or zero."""
        upto = np.arange(len(self.zeros)) * 64 - self.zeros if ones else self.zeros
        word = np.searchsorted(upto, k, side="right") - 1
        raw = self.high[word] if ones else ~self.high[word]
        rest, place = k - upto[word], word * 64
        for half in (32, 16, 8):  # the half of the bits left that has it
            low = raw & np.uint64((1 << half) - 1)
            count = np.bitwise_count(low)
            above = rest >= count
            rest = rest - count * above
            place += above * half
            raw = np.where(above, raw >> np.uint64(half), low)
        return place + _NTH[raw.astype(np.int64), rest]

    def lows(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), np.int64)
        bit = at * self.width
        return (self.low[bit >> 3] >> (bit & 7).astype(np.uint64)).astype(np.int64) & ((1 << self.width) - 1)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return ((self._select(at, True) - at) << self.width) | self.lows(at)

    def search(self, value: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Place of each value between the places ``start`` and ``stop`` (exclusive), -1 where it is missing."""
        top = value >> self.width
        top = np.minimum(top, int(self.zeros[-1]) - 1)
        ends = self._select(np.concatenate([np.maximum(top - 1, 0), top]), False)
        lo = np.maximum(np.where(top > 0, ends[:len(top)] - (top - 1), 0), start)
        hi = np.minimum(ends[len(top):] - top, stop)
        limit, want = hi.copy(), value & ((1 << self.width) - 1)
        active = np.flatnonzero(lo < hi)
        while len(active):
            mid = (lo[active] + hi[active]) >> 1
            less = self.lows(mid) < want[active]
            lo[active] = np.where(less, mid + 1, lo[active])
            hi[active] = np.where(less, hi[active], mid)
            active = active[lo[active] < hi[active]]
        ok = np.flatnonzero((lo < limit) & ((value >> self.width) == top))
        out = np.full(len(value), -1, np.int64)
        out[ok] = np.where(self.lows(lo[ok]) == want[ok], lo[ok], -1)
        return out


class Level:
    """Successors of all contexts of one order, in files by ranges of n-grams.

    begins: context times ``size`` plus token of the first n-gram that each
    file may have, and the end. shared: (followers seen plus kinds
    of them, quantised weight) of each context that may lie in several files.
    """

    def __init__(self, folder: str, shards: int, begins: np.ndarray, sizes: dict[int, int], size: int, shared: dict[int, tuple[int, int]]):
        self.folder, self.shards, self.begins, self.size, self.shared, self.open = folder, shards, begins, size, shared, {}
        self.sizes = np.array([sizes.get(s, 0) for s in range(shards)], np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.sizes)])

    def shard_of(self, key: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, key, side="right") - 1

    def find(self, context: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node or -1, probability of the node, weight of the shorter context) for pairs sorted by context and token; token -1 is in no node."""
        node, p, g = np.full(len(context), -1, np.int64), np.zeros(len(context)), np.ones(len(context))
        shard = self.shard_of(context * self.size + np.maximum(token, 0))
        cuts = np.searchsorted(shard, np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            low, high, first, last = _ends(self.begins, s, self.size)
            if s not in self.open:
                arrays = load_arrays(f"{self.folder}/{s:06d}")[0]
                self.open[s] = (arrays, EliasFano(arrays, "pointer"), EliasFano(arrays, "next"))
            arrays, pointer, following = self.open[s]
            own = slice(cuts[s], cuts[s + 1])
            c = context[own] - low
            new = np.concatenate([[True], c[1:] != c[:-1]])
            c, back = c[new], np.cumsum(new) - 1
            weight = arrays["weight"][c]
            if first and c[0] == 0:
                weight[0] = self.shared[low][1]
            if last and c[-1] == high - 1 - low:
                weight[-1] = self.shared[high - 1][1]
            g[own] = (10.0 ** (weight / -STEPS))[back]
            if not following.count:
                continue
            ends = pointer[np.concatenate([c, c + 1])]
            a, b = ends[:len(c)], ends[len(c):]
            base = np.where(a > 0, following[np.maximum(a - 1, 0)], 0)
            ask = np.flatnonzero((a < b)[back] & (token[own] >= 0))
            back = back[ask]
            at = following.search(token[own][ask] + base[back], a[back], b[back])
            hit = at >= 0
            where, at = cuts[s] + ask[hit], at[hit]
            node[where] = at + self.offset[s]
            chance = arrays["chance"][at]
            for name, context_, begin in (("head", low, 0), ("tail", high - 1, following.count - len(arrays["tail"]))):
                counts = arrays[name]
                i, j = np.searchsorted(at, (begin, begin + len(counts)))  # the pairs are sorted, so their places are too
                if i < j:
                    chance[i:j] = _quantised(counts[at[i:j] - begin] / self.shared[context_][0])
            p[where] = 10.0 ** (chance / -STEPS)
        return node, p, g


def _ends(begins: np.ndarray, shard: int, size: int) -> tuple[int, int, bool, bool]:
    """(first context of a shard, the one after its last, if the first may lie in the shard before too, if the last may lie in the next too)."""
    begin, end = int(begins[shard]), int(begins[shard + 1])
    return begin // size, -(-end // size), begin % size > 0, end % size > 0


def _summed(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(columns[0], kind="stable")
    key, count = columns[0][order], columns[1][order]
    if not len(key):
        return key, count
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(count, first)


def _runs(count: np.ndarray) -> dict:
    """Ends of runs of n-grams that occur about equally often, and how often those up to each end do; a frequent n-gram is a run."""
    upto = np.cumsum(count.astype(np.int64))
    end = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, RUNS + 1) // RUNS)) if len(upto) else np.zeros(0, np.int64)
    end = np.union1d(end, end[end > 0] - 1)
    return {"ends": (end + 1).tolist(), "upto": upto[end].tolist()}


def _begins(rows: list, shards: int, size: int = 1) -> np.ndarray:
    """First n-gram times ``size`` of each shard of the next level, and the end: a shard has at most twice its share of n-grams or occurrences.

    Of an n-gram cut in two, each shard has the followers with a part of the ``size`` numbers.
    """
    node, seen, ends, upto = 0, 0, [0], [0]
    for r in sorted(rows, key=lambda r: r["shard"]):
        ends += [node + x for x in r["ends"]]
        upto += [seen + x for x in r["upto"]]
        node, seen = node + r["n"], upto[-1]
    if ends[-1] < node:
        ends, upto = [*ends, node], [*upto, seen]
    ends, upto = np.array(ends, np.int64), np.array(upto, np.int64)
    share = ends / max(node, 1) + upto / max(seen, 1)
    place = np.interp(np.arange(shards + 1) * 2 / shards, share, ends)
    whole = place.astype(np.int64)
    begins = whole * size + ((place - whole) * size).astype(np.int64)
    begins[0], begins[-1] = 0, node * size
    return begins


def _quantised(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(-np.log10(np.maximum(p, 1e-30)) * STEPS - 1e-9), 65_535).astype(np.uint16)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the tokens of all texts with their ends, place of the first token of each text and the end)."""
    w = words(data, offsets)
    n = len(offsets) - 1
    out = np.full(len(w.doc) + n, END, np.uint64)
    out[np.arange(len(w.doc)) + w.doc] = w.hash
    return out, w.first() + np.arange(n + 1)


class Trie:
    """The levels written so far; what a column function carries, and opens where it runs."""

    def __init__(self, vocabulary: tuple, total: int, levels: tuple = ()):
        self.vocabulary, self.total, self.levels, self.opened = vocabulary, total, levels, None

    def __getstate__(self):
        return self.__dict__ | {"opened": None}

    @property
    def size(self) -> int:
        return sum(self.vocabulary[2].values())

    def ready(self):
        if self.opened is None:
            self.opened = Sorted(*self.vocabulary), [Level(*x) for x in self.levels]
        return self.opened

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of each token or -1, its count)."""
        words_, _ = self.ready()
        key, back = np.unique(hashes, return_inverse=True)
        at = words_.find(key)
        count = np.zeros(len(key), np.int64)
        shard = np.searchsorted(words_.offset, at, side="right") - 1
        for s in np.unique(shard[at >= 0]).tolist():
            own = (shard == s) & (at >= 0)
            count[own] = words_.shard(s)["count"][at[own] - words_.offset[s]]
        return at[back], count[back]

    def base(self, count: np.ndarray) -> np.ndarray:
        return (count + 0.5) / (self.total + 0.5 * (self.size + 1))

    def walk(self, hashes: np.ndarray, first: np.ndarray):
        """Per order: (tokens' places, contexts, tokens' numbers, answers of the level or None where it isn't written yet)."""
        ids, count = self.ids(hashes)
        inner = np.ones(len(ids), bool)
        inner[first[:-1]] = False
        node = ids  # of the n-gram that ends at each token
        yield ids, count
        for level in [*self.ready()[1], None]:
            at = np.flatnonzero(inner)
            at = at[node[at - 1] >= 0]
            context, token = node[at - 1], ids[at]
            if level is None:
                yield at, context, token, None
                return
            v = np.uint64(self.size + 1)
            key, back = np.unique(context.astype(np.uint64) * v + (token + 1).astype(np.uint64), return_inverse=True)
            found = level.find((key // v).astype(np.int64), (key % v).astype(np.int64) - 1)
            found = tuple(x[back] for x in found)
            yield at, context, token, found
            node = np.full(len(ids), -1, np.int64)
            node[at] = found[0]

    def log10(self, hashes: np.ndarray, first: np.ndarray):
        """(log10 of the base and of the model's probability of each token, count of each token)."""
        steps = self.walk(hashes, first)
        _, count = next(steps)
        p = base = self.base(count)
        for at, _, _, found in steps:
            if found is not None:
                p = p.copy()
                p[at] = found[1] + found[2] * p[at]
        return np.log10(base), np.log10(p), count


def _batches(texts: pa.Array):
    """``tokens`` of consecutive texts, about ``PIECE`` bytes at a time."""
    for data, offsets in chunks(texts, PIECE):
        hashes, first = zip(*(tokens(*part) for part in cut(data, offsets, PARTED)))
        size = np.concatenate([np.diff(f) for f in first])
        yield np.concatenate(hashes), np.concatenate([[0], np.cumsum(size)])


def fit(texts: DataFrame, order: int = ORDER, least: int = LEAST) -> Trie:
    """Count the tokens of all ``texts`` (column text) and write the levels one after another."""
    spark, shards = texts.sparkSession, shard_count(texts)
    folder = shared_path(spark, "trie")

    def singles(batches):
        for batch in batches:
            for hashes, _ in _batches(batch.column("text")):
                key, count = np.unique(hashes, return_counts=True)
                yield key, count.astype(np.uint64)

    def save_singles(shard: int, columns) -> dict:
        save_arrays(f"{folder}/1/{shard:06d}", {"key": columns[0], "count": columns[1]})
        return {"shard": shard, "n": len(columns[0]), "total": int(columns[1].sum())} | _runs(columns[1])

    rows = stage(in_shards(texts, singles, _summed, top_bits(shards), save_singles, "shard long, n long, total long, ends array<long>, upto array<long>", shards), "level").collect()
    trie = Trie((f"{folder}/1", shards, {r["shard"]: r["n"] for r in rows}), sum(r["total"] for r in rows))
    for n in range(2, order + 1):
        if not any(r["n"] for r in rows):
            break
        trie, rows = _next(texts, trie, f"{folder}/{n}", rows, least)
    return trie


def _next(texts: DataFrame, trie: Trie, folder: str, rows: list, least: int) -> tuple[Trie, list]:
    """The trie with one more level, and what its shards tell. ``rows``: what those of the level before told."""
    size, contexts = max(trie.size, 1), sum(r["n"] for r in rows)
    if contexts * size >= 1 << 63:
        raise ValueError("a context and a token no longer fit one number")
    seen = sum(max(r["upto"], default=0) for r in rows)
    shards = max(trie.vocabulary[1], 1 << max(0, seen - 1 >> SHARE.bit_length() - 1).bit_length())
    begins = _begins(rows, shards, size)
    v, level = np.uint64(size), Level(folder, shards, begins, {}, size, {})

    def pairs(batches):
        for batch in batches:
            for own in _batches(batch.column("text")):
                *_, (at, context, token, _) = trie.walk(*own)
                key, count = np.unique(context.astype(np.uint64) * v + token.astype(np.uint64), return_counts=True)
                yield key, count.astype(np.uint64)

    def save(shard: int, columns) -> dict:
        key, count = columns
        low, high, first, last = _ends(begins, shard, size)
        pointer = np.searchsorted(key, np.arange(low, high + 1).astype(np.uint64) * v)
        total, kinds, rare = _sums(count, pointer), np.diff(pointer), np.zeros(high - low, np.int64)
        if least > 1:
            keep = count >= least
            rare = total - _sums(np.where(keep, count, 0), pointer)
            pointer = np.concatenate([[0], np.cumsum(keep)])[pointer]
            key, count = key[keep], count[keep]
        # the last token of each context so far, summed up: of the contexts that have any
        some = pointer[1:] > pointer[:-1]
        base = np.zeros(high - low + 1, np.uint64)
        base[1:][some] = key[pointer[1:][some] - 1] % v
        np.cumsum(base, out=base)
        following, chance, shown = np.empty(len(key), np.uint64), np.empty(len(key), np.uint16), total + kinds
        for i in range(0, len(key), PACKED):
            own = slice(i, i + PACKED)
            context = (key[own] // v).astype(np.int64) - low
            following[own] = key[own] % v + base[context]
            chance[own] = _quantised(count[own] / shown[context])
        # a context that lies in other shards too has its chances from the counts and from what all of them tell
        head, tail = int(pointer[1]) if first else 0, int(pointer[-2]) if last else len(key)
        ends = {low: 0} if first else {}
        ends |= {high - 1: high - 1 - low} if last else {}
        counts = {"head": count[:head], "tail": count[max(head, tail):]}
        save_arrays(f"{folder}/{shard:06d}", EliasFano.arrays(pointer.astype(np.uint64), "pointer") | EliasFano.arrays(following, "next")
                    | {"chance": chance, "weight": _weight(total, kinds, rare)} | {k: x.astype(np.min_scalar_type(x.max() if len(x) else 0)) for k, x in counts.items()})
        return {"shard": shard, "n": len(key), "shared": [int(x) for c, k in ends.items() for x in (c, total[k], kinds[k], rare[k])]} | _runs(count)

    def shard_of(key: np.ndarray) -> np.ndarray:
        return level.shard_of(key.astype(np.int64))

    rows = stage(in_shards(texts, pairs, _summed, shard_of, save, "shard long, n long, shared array<long>, ends array<long>, upto array<long>", shards), "level").collect()
    sizes = {r["shard"]: r["n"] for r in rows}
    for s in range(shards):  # contexts without any follower still need their range
        if s not in sizes:
            save(s, (np.zeros(0, np.uint64), np.zeros(0, np.uint64)))
    parts = {int(x) // size: np.zeros(3, np.int64) for x in begins if x % size}
    for r in rows:
        for context, *told in np.array(r["shared"], np.int64).reshape(-1, 4).tolist():
            parts[context] += told
    shared = {context: (int(total + kinds), int(_weight(*np.array([[total], [kinds], [rare]]))[0])) for context, (total, kinds, rare) in parts.items()}
    return Trie(trie.vocabulary, trie.total, (*trie.levels, (folder, shards, begins, sizes, size, shared))), rows


def _sums(count: np.ndarray, pointer: np.ndarray) -> np.ndarray:
    """Sums of ``count`` between neighbours in ``pointer``."""
    return np.diff(np.concatenate([[0], np.cumsum(count.astype(np.int64))])[pointer])


def _weight(total: np.ndarray, kinds: np.ndarray, rare: np.ndarray) -> np.ndarray:
    return _quantised(np.where(total > 0, (kinds + rare) / np.maximum(total + kinds, 1), 1.0))


def score(docs: DataFrame, trie: Trie, name: str = "lm") -> DataFrame:
    """``docs`` with a column ``name``: n_tokens, n_known, base_score and score of each whole text."""

    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in texts:
            parts = []
            for hashes, first in _batches(text):
                base, p, count = trie.log10(hashes, first)
                parts.append((np.diff(first), *(np.add.reduceat(x, first[:-1]) for x in ((count > 0).astype(np.int64), base, p))))
            n, known, base, p = (np.concatenate(x) for x in zip(*parts)) if parts else [np.zeros(0)] * 4
            yield pa.StructArray.from_arrays([pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(p)], ["n_tokens", "n_known", "base_score", "score"])

    scored.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(name, arrow_udf(scored, "struct<n_tokens:bigint,n_known:bigint,base_score:double,score:double>")("text"))


def op5_elias_fano_trie(spark, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    trie = fit(docs.where(learns(5, 1)).select("text"))
    out = score(docs.select("doc_id", "text"), trie)
    return out.select("doc_id", (~learns(5, 1)).alias("held_out"), "lm.n_tokens", "lm.n_known", F.lit(trie.total).cast("long").alias("train_tokens"), "lm.base_score", "lm.score")
