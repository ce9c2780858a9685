"""Cross-tokenizer alignment: links between the tokens of two vocabularies, counted through minimal perfect hashes.

A text behind one space is encoded by a byte-level vocabulary A and a piece
vocabulary B. Between two neighbouring token ends of either side lies one link:
the tokens of A and B that cover those bytes. Ends of both sides cut the tokens
into groups.

First pass: each task counts its distinct id pairs and writes them by range of
their hash. A tree of merges joins the distinct pairs of a range, and one task a
range builds a minimal perfect hash and keeps the pair of every index, so that
a stranger is noticed. Each branch of a second tree turns the pairs of some tasks into a
dense vector of counts, which are added up the tree. Second pass: texts are
aligned again and their links look up their counts in mapped files. The number
of pairs is bounded by the vocabularies, not by the corpus: so are all ranges,
vectors and files, and the highest count for each B id, which is broadcast.

Words are encoded once and remembered. A space between a character that is no
space and one that can't be white space parts tokens on both sides, which the
vocabularies are checked for when they are loaded. So a text longer than ``PIECE`` bytes is
worked on in pieces cut there, and memory depends on the piece, or on the longest run
without such a space.

Cases: a null or empty text has no tokens, like one whose token bytes differ
from its own; its row has zeros and empty groups, its links count nowhere. Null ids stay null and repeated
rows each count. An empty table gives an empty result. Other columns are not read.
"""

import hashlib
import json
import os
import re
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.functions.staging import shared_path, stage
from tillscope.llm.common import documents, load_arrays, mixed, prefix_hash, ragged, run_hash, save_arrays

#: Bytes of text that are aligned at a time.
PIECE = 1 << 20
#: Bytes of new words that are encoded at a time.
LESSON = 1 << 16
#: Distinct words that a Python worker remembers before it starts anew.
KNOWN_WORDS = 300_000
#: Ranges of pairs, and rows that meet in one step of a tree.
RANGES, FAN = 64, 32
_LEVEL = 0x9E3779B97F4A7C15
#: First bytes of characters that may be white space, beside ASCII: U+0085, U+00A0, U+1680, U+2000 to U+205F, U+3000.
_WIDE = (0xC2, 0xE1, 0xE2, 0xE3)
#: A space that parts tokens, with the byte before it, or the end behind it.
_OVER = re.compile(rb"[^ ] (?:[\x21-\x7e\x80-\xc1\xc3-\xe0\xe4-\xff]|\Z)")
#: Texts on whose parts, or in whose encodings, vocabularies are compared.
PROBES = ["a 'b", "it 's", "1 2a", "été x", "!? ?!", "a\t b", "a\n\n b", "<|endoftext|> z", "a中 0", "' s", "\U0001f600 \U0001f600", "a\u00a0 b"]


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: levels of bits, each set where just one key falls; keys verified.

    A key's index is the number of bits before its own. Keys that share a bit
    go on to the next level, which has twice as many bits as keys are left.
    """

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.words, self.before, self.sizes, self.keys = (arrays[k] for k in ("words", "before", "sizes", "keys"))
        self.offset = np.concatenate([[0], np.cumsum(self.sizes)])

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return mixed(keys + np.uint64(_LEVEL * (level + 1) % (1 << 64))) % np.uint64(size)

    @classmethod
    def build(cls, keys: np.ndarray) -> dict[str, np.ndarray]:
        left, sizes, bits = keys, [], []
        while len(left):
            size = -(-2 * len(left) // 64) * 64
            at = cls._place(left, len(sizes), size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            bits.append(alone)
            sizes.append(size)
            left = left[~alone[at]]
        words = np.packbits(np.concatenate(bits) if bits else np.zeros(0, bool), bitorder="little").view("<u8")
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]) if len(words) else np.zeros(0, np.int64)
        made = {"words": words, "before": before, "sizes": np.array(sizes, np.int64), "keys": keys}
        owner = cls(made)
        made["keys"] = np.empty_like(keys)
        made["keys"][owner._index(keys)] = keys
        return made

    def _index(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(rest):
                break
            at = self._place(keys[rest], level, size) + np.uint64(self.offset[level])
            word, bit = self.words[(at >> np.uint64(6)).astype(np.int64)], at & np.uint64(63)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[rest[hit]] = self.before[(at[hit] >> np.uint64(6)).astype(np.int64)] + below
            rest = rest[~hit]
        return out

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 for one that is not among the keys."""
        at = self._index(keys)
        return np.where((at >= 0) & (self.keys[at] == keys), at, -1) if len(self.keys) else np.full(len(keys), -1)


class Pair:
    """Two vocabularies as functions from text to ids, with the bytes of every id."""

    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.a, self.b = Tokenizer.from_file(byte_level), sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.a.encode_special_tokens, self.quick = True, None
        # the byte-level alphabet: printable bytes stand for themselves, the others follow from code point 256 on
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        others = [b for b in range(256) if b not in own]
        byte_of = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}
        if set(byte_of) != set(ByteLevel.alphabet()):
            raise ValueError("not a byte-level alphabet")
        self.size_a, self.size_b = self.a.get_vocab_size(), self.b.get_piece_size()
        named = {i: t for t, i in self.a.get_vocab().items()}
        table_a = [bytes(byte_of[c] for c in t) if (t := named.get(i, "")) and all(c in byte_of for c in t) else b"" for i in range(self.size_a)]
        table_b = []
        for i in range(self.size_b):
            piece = self.b.id_to_piece(i)
            table_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else piece.replace("▁", " ").encode())
        self.bytes_a, self.bytes_b = _arena(table_a), _arena(table_b)
        # a token that held a space after other characters would reach over the places where texts are cut
        self.parts = not any(_OVER.search(t) for t in table_a + table_b) and self._parts_at_spaces()
        self.quick = self._quick(byte_level, table_a)

    def _quick(self, byte_level: str, table: list[bytes]):
        """A's vocabulary as ranks of token bytes, which encodes faster; None where it might not give the same ids.

        It does where nothing happens before the pattern of byte-level
        vocabularies splits the text, and merges have the order of their ids.
        """
        import public_tokenizers
        import tiktoken

        told = json.loads(Path(byte_level).read_text())
        before, model = told["pre_tokenizer"], told["model"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        plain = (told["normalizer"] is None and before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and model["type"] == "BPE"
                 and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
                 and [model["vocab"][a + b] for a, b in pairs] == list(range(256, 256 + len(pairs))))
        if not plain:
            return None
        special = {t["id"] for t in told["added_tokens"]}
        quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(table) if i not in special}, special_tokens={})
        texts = [f" {p}{q}" for p in PROBES for q in (" 're x'll 12½ ﬁ\u0301", "\r\n\n \u3000x", "ΑΣ  \U0001f1e9\U0001f1ea\u200d")]
        return quick if all(quick.encode_ordinary(t) == self.ids_a(t) for t in texts) else None

    def _parts_at_spaces(self) -> bool:
        for encode in (lambda s: self.ids_a(" " + s), self.ids_b):
            for p in PROBES:
                left, right = p.split(" ")
                if encode(p) != encode(left) + encode(right):
                    return False
        return True

    def ids_a(self, text: str) -> list[int]:
        return self.quick.encode_ordinary(text) if self.quick else self.a.encode(text, add_special_tokens=False).ids

    def ids_b(self, text: str) -> list[int]:
        return self.b.encode(text)


def _arena(table: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all bytes, where each entry starts, its size)."""
    size = np.array([len(t) for t in table], np.int64)
    return np.frombuffer(b"".join(table), np.uint8), np.cumsum(size) - size, size


class Words(NamedTuple):
    """Words of slices of texts: the slice of each, and its place in the memory of the aligner."""

    slice: np.ndarray
    at: np.ndarray


def _borders(data: np.ndarray) -> np.ndarray:
    """Spaces that part tokens: after a byte that is no space, before one that starts no white space."""
    inner = np.flatnonzero(data[1:-1] == 0x20) + 1
    after = data[inner + 1]
    starts = (after > 0x20) & (after != 0x7F) & ~np.isin(after, _WIDE)
    return inner[(data[inner - 1] != 0x20) & starts]


def slices(texts: pa.Array, whole: bool) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """(first, end, slices): texts of about ``PIECE`` bytes together, or one longer text in several slices.

    A slice is (data, offsets) of texts. Unless ``whole``, a longer text is cut
    at spaces that part tokens; such a space belongs to neither slice.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, side="right")) - 1)
        own, ends = data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        if to > at + 1 or len(own) <= PIECE or whole:
            yield at, to, [(own, ends)]
        else:
            cuts, start = [], 0
            while len(own) - start > PIECE:
                look = start + PIECE
                found = np.zeros(0, np.int64)
                while not len(found) and look < len(own):  # the next space that parts
                    stop = min(len(own), look + PIECE)
                    found = _borders(own[look - 1:stop + 1]) + look - 1
                    look = stop
                if not len(found):
                    break
                cuts.append(int(found[0]))
                start = cuts[-1] + 1
            edges = zip([0, *(c + 1 for c in cuts)], [*cuts, len(own)])
            yield at, to, [(own[a:b], np.array([0, b - a])) for a, b in edges]
        at = to


class Aligner:
    """Words with their links and, with ``texts``, the text of their groups, remembered by a hash of their bytes."""

    def __init__(self, byte_level: str, pieces: str, texts: bool = True):
        self.pair, self.texts = Pair(byte_level, pieces), texts
        # a token's number and what follows it in the text of its groups
        self.told = [np.array([[f"{i}{end}" for end in ends] for i in range(n)], object) for n, ends in ((self.pair.size_a, ",|"), (self.pair.size_b, ",;"))]
        self.forget()

    def forget(self) -> None:
        self.hash, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.groups: list[str] = []
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        # of each word: tokens of A and B, groups, links, whether its bytes come back
        self.told_of = np.zeros((0, 5), np.int64)
        self.first = np.zeros(1, np.int64)
        self.links, self.used = np.zeros(1 << 16, np.uint64), 0

    def words(self, data: np.ndarray, offsets: np.ndarray) -> Words:
        """Words of the texts; an empty text has none."""
        edge = np.zeros(len(data) + 1, bool)
        if self.pair.parts and len(data) > 2:
            edge[_borders(data)] = True
            edge[offsets] = edge[offsets - 1] = False  # a text's first and last space have no neighbour
        gaps = np.flatnonzero(edge)
        some = np.flatnonzero(np.diff(offsets))
        start = np.sort(np.concatenate([offsets[some], gaps + 1]))
        end = np.sort(np.concatenate([offsets[some + 1], gaps]))
        of = np.searchsorted(offsets, start, side="right") - 1
        hashed = run_hash(prefix_hash(data.astype(np.uint64) + np.uint64(1)), start, end)
        distinct, example, inverse = np.unique(hashed, return_index=True, return_inverse=True)
        known = np.minimum(np.searchsorted(self.hash, distinct), max(0, len(self.hash) - 1))
        new = np.flatnonzero(self.hash[known] != distinct) if len(self.hash) else np.arange(len(distinct))
        if len(new):
            if len(self.hash) > KNOWN_WORDS:
                self.forget()
                new = np.arange(len(distinct))
            which, at = example[new], len(self.groups)
            cuts = np.flatnonzero(np.diff(np.cumsum(end[which] - start[which] + 1) // LESSON)) + 1
            for lesson in np.split(which, cuts):
                self._learn([data[a:b].tobytes() for a, b in zip(start[lesson].tolist(), end[lesson].tolist())])
            self._keep()
            into = np.searchsorted(self.hash, distinct[new])
            self.hash = np.insert(self.hash, into, distinct[new])
            self.place = np.insert(self.place, into, at + np.arange(len(new)))
            known = np.searchsorted(self.hash, distinct)
        return Words(of, self.place[known][inverse])

    def _learn(self, texts: list[bytes]) -> None:
        """Add the words, in order. Words that may stand in one text do, with spaces between."""
        plain = [t[:1] > b" " and t[:1] != b"\x7f" and t[0] not in _WIDE and t[-1:] != b" " for t in texts] if self.pair.parts else [False] * len(texts)
        at = 0
        while at < len(texts):
            to = at + 1
            while plain[at] and to < len(texts) and plain[to]:
                to += 1
            self._align(texts[at:to])
            at = to

    def _align(self, texts: list[bytes]) -> None:
        pair, joined = self.pair, b" ".join(texts)
        text = joined.decode()
        want = np.frombuffer(b" " + joined, np.uint8)
        tokens, ends, same = [], [], True
        for ids, (arena, start, size) in ((pair.ids_a(" " + text), pair.bytes_a), (pair.ids_b(text), pair.bytes_b)):
            ids = np.array(ids, np.int64)
            got = arena[ragged(start[ids], size[ids])]
            same = same and len(got) == len(want) and bool((got == want).all()) and bool((size[ids] > 0).all())
            tokens.append(ids)
            ends.append(np.cumsum(size[ids]))
        last = np.cumsum([len(t) + 1 for t in texts])
        if not (same and np.isin(last, ends[0]).all() and np.isin(last, ends[1]).all()):
            if len(texts) > 1:  # find the words whose bytes don't come back
                half = len(texts) // 2
                self._align(texts[:half])
                self._align(texts[half:])
            else:
                self._add(np.zeros((1, 5), np.int64), [""], np.zeros(0, np.uint64))
            return
        (a, b), (end_a, end_b) = tokens, ends
        # all ends and shared ends of tokens in the bytes; the group of each token, and whether it closes it
        near = np.searchsorted(end_b, end_a)
        shared = end_a[end_b[near] == end_a]  # the last ends are equal
        group_a, group_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
        closes_a, closes_b = shared[group_a] == end_a, shared[group_b] == end_b
        cut = np.sort(np.concatenate([end_a, end_b[~closes_b]]), kind="stable")
        links = a[np.searchsorted(end_a, cut)].astype(np.uint64) * np.uint64(pair.size_b) + b[np.searchsorted(end_b, cut)].astype(np.uint64)
        told = np.ones((len(texts), 5), np.int64)
        for j, of in enumerate((end_a, end_b, shared, cut)):
            told[:, j] = np.diff(np.searchsorted(of, last, side="right"), prepend=0)
        if not self.texts:
            self._add(told, [""] * len(texts), links)
            return
        # the text of the groups: a token of A comes behind the tokens of B in the groups before, one of B behind those of A in its own too
        through_a, through_b = np.searchsorted(end_a, shared, side="right"), np.searchsorted(end_b, shared, side="right")
        names = np.empty(len(a) + len(b), object)
        names[np.arange(len(a)) + np.concatenate([[0], through_b])[group_a]] = self.told[0][a, closes_a.astype(np.int64)]
        names[np.arange(len(b)) + through_a[group_b]] = self.told[1][b, closes_b.astype(np.int64)]
        names, until = names.tolist(), np.cumsum(told[:, 0] + told[:, 1]).tolist()
        self._add(told, ["".join(names[x:y])[:-1] for x, y in zip([0, *until], until)], links)

    def _add(self, told: np.ndarray, groups: list[str], links: np.ndarray) -> None:
        self.new.append((told, links))
        self.groups += groups

    def _keep(self) -> None:
        """Put the words just learned beside the others."""
        told, links = map(np.concatenate, zip(*self.new))
        self.new = []
        if self.used + len(links) > len(self.links):
            self.links = np.concatenate([self.links[:self.used], np.zeros(len(links) + len(self.links), np.uint64)])
        self.links[self.used:self.used + len(links)] = links
        self.first = np.concatenate([self.first, self.used + np.cumsum(told[:, 3])])
        self.used += len(links)
        self.told_of = np.concatenate([self.told_of, told])

    def links_of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(links of the words one after another, number of links of each)."""
        size = self.first[which + 1] - self.first[which]
        return self.links[ragged(self.first[which], size)], size


def _aligner(byte_level: str, pieces: str, texts: bool) -> Aligner:
    """The worker's own aligner; it lives on from task to task."""
    global _kept
    if globals().get("_kept", (None,))[0] != (byte_level, pieces, texts):
        _kept = ((byte_level, pieces, texts), Aligner(byte_level, pieces, texts))
    return _kept[1]


def _good(aligner: Aligner, parts, n: int) -> np.ndarray:
    """Whether each of n texts has tokens."""
    bad = np.zeros(n, bool)
    for data, offsets in parts:
        w = aligner.words(data, offsets)
        bad[w.slice[aligner.told_of[w.at, 4] == 0]] = True
    return ~bad


def _by_range(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys) % np.uint64(RANGES)).astype(np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def pair_counts(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """(part, range, keys, counts): each task's distinct id pairs with their links, packed by range."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner = _aligner(byte_level, pieces, False)
        held, size = [], 0
        for batch in batches:
            for at, to, parts in slices(batch.column(0), not aligner.pair.parts):
                good = _good(aligner, parts, to - at) if len(parts) > 1 else None
                for data, offsets in parts:
                    w = aligner.words(data, offsets)
                    if good is None:
                        good = np.ones(to - at, bool)
                        good[w.slice[aligner.told_of[w.at, 4] == 0]] = False
                    which, times = np.unique(w.at[good[w.slice]], return_counts=True)
                    links, n = aligner.links_of(which)
                    held.append(_summed(links, np.repeat(times, n)))
                    size += len(held[-1][0])
                if size > 1 << 21:
                    held = [_summed(*map(np.concatenate, zip(*held)))]
                    size = len(held[0][0]) // 2  # only new pairs count in full
        if held:
            keys, counts = _summed(*map(np.concatenate, zip(*held)))
            of = _by_range(keys)
            order = np.argsort(of, kind="stable")
            cuts = np.searchsorted(of[order], np.arange(RANGES + 1))
            rows = [(r, order[cuts[r]:cuts[r + 1]]) for r in range(RANGES) if cuts[r] < cuts[r + 1]]
            if rows:
                yield pa.RecordBatch.from_arrays([
                    pa.array([TaskContext.get().partitionId()] * len(rows), pa.int64()), pa.array([r for r, _ in rows], pa.int32()),
                    pa.array([keys[o].astype("<u8").tobytes() for _, o in rows], pa.binary()),
                    pa.array([counts[o].astype("<i8").tobytes() for _, o in rows], pa.binary())], ["part", "range", "keys", "counts"])

    return docs.select("text").mapInArrow(count, "part long, range int, keys binary, counts binary")


def _tree(rows: DataFrame, step, last, schema: str, name: str) -> DataFrame:
    """Combine the rows of each range, ``FAN`` at a time: ``step(range, table)`` on the way up, ``last`` where one is left."""
    parts = rows.agg(F.max("part")).first()[0]
    parts = 0 if parts is None else parts + 1

    def by(function):
        return lambda key, table: function(key[0].as_py(), key[1].as_py(), table)

    while True:
        top = parts <= FAN
        groups = rows.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("range", "part")
        done = groups.applyInArrow(by(last if top else step), schema if top else rows.schema)
        if top:
            return stage(done, name)
        rows, parts = stage(done, name), -(-parts // FAN)


def _arrays(column, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


class Counts(NamedTuple):
    """Where the pairs and their counts are, and the highest count of a link to each B id."""

    folder: str
    ranges: set[int]
    best: np.ndarray

    def of(self, keys: np.ndarray, opened: dict) -> np.ndarray:
        """Counts of distinct pairs; an error for one that was never counted."""
        out = np.zeros(len(keys), np.int64)
        which = _by_range(keys)
        order = np.argsort(which, kind="stable")
        cuts = np.searchsorted(which[order], np.arange(RANGES + 1))
        for r in np.flatnonzero(np.diff(cuts)).tolist():
            if r not in opened:
                opened[r] = (PerfectHash(load_arrays(f"{self.folder}/hash-{r:03d}")[0]), load_arrays(f"{self.folder}/counts-{r:03d}")[0]["counts"])
            own = order[cuts[r]:cuts[r + 1]]
            at = opened[r][0].index(keys[own])
            if (at < 0).any():
                raise ValueError("a pair of tokens was not counted")
            out[own] = opened[r][1][at]
        return out


def count_pairs(docs: DataFrame, byte_level: str, pieces: str, size_b: int) -> Counts:
    """First pass: the counts of all linked pairs, in files of the shared folder."""
    folder = shared_path(docs.sparkSession, "pairs")
    counted = stage(pair_counts(docs, byte_level, pieces), "pair-counts")

    def distinct(table) -> np.ndarray:
        return np.unique(np.concatenate(_arrays(table["keys"], "<u8")))

    def merge(r: int, part: int, table: pa.Table) -> pa.Table:
        return pa.table({"part": pa.array([part], pa.int64()), "range": pa.array([r], pa.int32()), "keys": pa.array([distinct(table).tobytes()], pa.binary())})

    def build(r: int, part: int, table: pa.Table) -> pa.Table:
        keys = distinct(table)
        save_arrays(f"{folder}/hash-{r:03d}", PerfectHash.build(keys))
        return pa.table({"range": pa.array([r], pa.int32()), "n": pa.array([len(keys)], pa.int64())})

    built = _tree(counted.select("part", "range", "keys"), merge, build, "range int, n long", "pair-keys")
    ranges = {r["range"] for r in built.collect()}  # at most RANGES rows

    def dense(r: int, table: pa.Table) -> np.ndarray:
        total = None
        index = None
        for keys, counts in zip(_arrays(table["keys"], "<u8"), _arrays(table["counts"], "<i8")):
            if len(keys):  # a task's own pairs, at the foot of the tree
                index = index or PerfectHash(load_arrays(f"{folder}/hash-{r:03d}")[0])
                total = np.zeros(len(index.keys), np.int64) if total is None else total
                total[index.index(keys)] += counts  # distinct within a row
            else:
                total = counts if total is None else total + counts
        return total

    def add(r: int, part: int, table: pa.Table) -> pa.Table:
        return pa.table({"part": pa.array([part], pa.int64()), "range": pa.array([r], pa.int32()), "keys": pa.array([b""], pa.binary()), "counts": pa.array([dense(r, table).tobytes()], pa.binary())})

    def finish(r: int, part: int, table: pa.Table) -> pa.Table:
        counts = dense(r, table)
        save_arrays(f"{folder}/counts-{r:03d}", {"counts": counts})
        best = np.zeros(size_b, np.int64)
        np.maximum.at(best, (load_arrays(f"{folder}/hash-{r:03d}")[0]["keys"] % np.uint64(size_b)).astype(np.int64), counts)
        return pa.table({"range": pa.array([r], pa.int32()), "best": pa.array([best.tobytes()], pa.binary())})

    best = _tree(counted, add, finish, "range int, best binary", "pair-vectors")

    def highest(table: pa.Table) -> pa.Table:
        return pa.table({"best": pa.array([np.maximum.reduce(_arrays(table["best"], "<i8")).tobytes()], pa.binary())})

    # at most RANGES rows of a number for each B id
    top = best.groupBy().applyInArrow(highest, "best binary").collect()
    return Counts(folder, ranges, np.frombuffer(top[0]["best"], "<i8") if top else np.zeros(size_b, np.int64))


RESULT = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align(docs: DataFrame, byte_level: str, pieces: str, groups: bool = False) -> DataFrame:
    """(doc_id, numbers of tokens, groups and links, best links, sum of counts, hash of groups) of each row of doc_id and text.

    ``groups`` adds the groups themselves, ``a1,a2|b1;a3|b2,b3``.
    """
    import sentencepiece

    spark = docs.sparkSession
    size_b = sentencepiece.SentencePieceProcessor(model_file=pieces).get_piece_size()
    counts = spark.sparkContext.broadcast(count_pairs(docs, byte_level, pieces, size_b))
    names = [c.split()[0] for c in RESULT.split(", ")] + ["groups"] * groups

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, told, opened = _aligner(byte_level, pieces, True), counts.value, {}
        for batch in batches:
            for at, to, parts in slices(batch.column(1), not aligner.pair.parts):
                n = to - at
                out, sha, texts = np.zeros((n, 6), np.int64), [None] * n, [[] for _ in range(n)]
                good = _good(aligner, parts, n) if len(parts) > 1 else None
                for data, offsets in parts:
                    w = aligner.words(data, offsets)
                    if good is None:
                        good = np.ones(n, bool)
                        good[w.slice[aligner.told_of[w.at, 4] == 0]] = False
                    which, back = np.unique(w.at, return_inverse=True)
                    links, size = aligner.links_of(which)
                    counted = np.repeat(np.isin(which, w.at[good[w.slice]]), size)  # of a word that some good text has
                    pairs, same = np.unique(links[counted], return_inverse=True)
                    told_pair = told.of(pairs, opened)
                    best = told_pair == told.best[(pairs % np.uint64(size_b)).astype(np.int64)]
                    per = np.zeros((len(links), 2), np.int64)
                    per[counted] = np.stack([best[same], told_pair[same]], 1)
                    ends = np.concatenate([[0], np.cumsum(size)])
                    sums = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(per, axis=0)])
                    own = np.concatenate([aligner.told_of[which, :4], sums[ends[1:]] - sums[ends[:-1]]], axis=1)[back]
                    cuts = np.searchsorted(w.slice, np.arange(n + 1))
                    run = np.concatenate([np.zeros((1, 6), np.int64), np.cumsum(own, axis=0)])
                    out += run[cuts[1:]] - run[cuts[:-1]]
                    said, place = aligner.groups, w.at.tolist()
                    for d in np.flatnonzero(good & (np.diff(cuts) > 0)).tolist():
                        text = ";".join([said[k] for k in place[cuts[d]:cuts[d + 1]]])
                        if sha[d] is None:
                            sha[d] = hashlib.sha256(text.encode())
                        else:
                            sha[d].update(b";" + text.encode())
                        if groups:
                            texts[d].append(text)
                out[~good] = 0
                columns = [pa.array(out[:, j]) for j in range(6)] + [pa.array(["" if h is None else h.hexdigest() for h in sha], pa.string())]
                columns += [pa.array([";".join(t) for t in texts], pa.string())] * groups
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), *columns], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(aligned, f"doc_id {kind}, {RESULT}" + ", groups string" * groups)


def op12_perfect_hash_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return align(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
