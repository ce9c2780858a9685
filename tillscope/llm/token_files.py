"""Token ids in bit-packed files.

Documents are dealt by ranges of doc_id, and each task writes one file with
its documents in order. A file holds blocks of ``BLOCK`` ids with the fewest
bits that the vocabulary needs, and a footer (NumPy arrays): byte offset of
each block, doc_id of each document and number of ids before it in the file.
Any id is found by its block's offset, and a block unpacks in a few NumPy
steps. File: blocks, footer, footer's size in eight bytes.

Cases: a null or empty text has just the end id. Null ids come first and keep
null. Rows with one id are in the order of a hash of their text; an empty
table writes no ids. A retried task writes a file of its own, and only files
named by the committed index are read.
"""

import io
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillscope.functions.staging import shared_path, stage
from tillscope.llm.common import Words, chunks, documents, opened, pack_bits, prefix_hash, ragged, run_hash, unpack_bits

BLOCK = 1 << 16
END = 1
#: Distinct units whose ids a Python worker remembers before it starts anew.
KNOWN_UNITS = 2_500_000
#: Marks that may be parted from letters and digits: no apostrophe, and none of the characters that special tokens have.
MARKS = ".,;:!?*$%&#()[]{}-_/\\\"=+@~^`"
_SPACE, _LETTER, _MARK, _DIGIT, _OTHER = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[[ord(c) for c in MARKS]] = _MARK
_KIND[range(48, 58)] = _DIGIT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Texts on which encoding by units has to agree with the vocabulary's own way, or texts are encoded whole.
PROBES = ["It's the END... of 12,345 (things)!", "don't you'LL we've 'S", "a\tb\n\nc\x0b\x0cd\re", "x\u0085y z\u00a0w\u3000v \u2028", "\x1c\x1f\x00", "<|endoftext|> x<|STARTOFTEXT|>y<|startoftext|>",
          "École ÀÉÎÕÜ Þß×÷ÿ ĀŽſŉĲ İstanbul ıIi", "e\u0301t E\u0301 A\u030a", "ΑΣ ΑΣ.Α", "\U0001f600\U0001f468\u200d\U0001f469 ok\U0001f600ok", "中文字 かな 한글", "½ ² ٣ 3rd x2y", "\uffff a\uffffb", "C++ a_b-c/d\\\\e [f]{g} \"h\" i=j@k~l^m`n", ""]


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    """(units of the texts with their hashes, whether each is letters only).

    A word of letters, digits and marks falls into its runs of each, in lower
    case; letters are those of ASCII, Latin-1 and Latin Extended-A. Any other
    word is one unit as it is.
    """
    n = len(data)
    kind, low = _KIND[data], _LOWER[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC5))
    after = data[np.minimum(lead + 1, max(n - 1, 0))]
    # not the signs × and ÷, nor İ, which is two characters in lower case
    fine = ~((data[lead] == 0xC3) & ((after == 0x97) | (after == 0xB7)) | (data[lead] == 0xC4) & (after == 0xB0))
    lead, after = lead[fine], after[fine]
    kind[lead] = kind[lead + 1] = _LETTER
    capital = lead[(data[lead] == 0xC3) & (after <= 0x9E)]
    low[capital + 1] += 0x20
    edge = np.zeros(n + 1, bool)
    edge[offsets] = edge[n] = True
    space = kind == _SPACE
    before, behind = np.ones(n, bool), np.ones(n, bool)
    before[1:], behind[:-1] = space[:-1], space[1:]
    start = np.flatnonzero(~space & (before | edge[:n]))
    end = np.flatnonzero(~space & (behind | edge[1:])) + 1
    whole = np.zeros(len(start), bool)
    whole[np.searchsorted(start, np.flatnonzero(kind == _OTHER), side="right") - 1] = True
    own = ragged(start[whole], (end - start)[whole])
    low[own] = data[own]
    turn = np.flatnonzero((kind[1:] != kind[:-1]) & ~space[1:] & ~space[:-1]) + 1
    turn = turn[~edge[turn]]
    turn = turn[~whole[np.searchsorted(start, turn, side="right") - 1]]
    first = np.sort(np.concatenate([start, turn]), kind="stable")
    word = np.searchsorted(start, first, side="right") - 1
    last = np.minimum(np.append(first[1:], n), end[word]) if len(first) else first
    doc = np.searchsorted(offsets, first, side="right") - 1
    hashed = run_hash(prefix_hash(low.astype(np.uint64) + np.uint64(1)), first, last)
    return Words(low, offsets, first, last, doc, hashed), ~whole[word] & (kind[first] == _LETTER)


class Encoder:
    """Ids of whole texts, put together from those of their units, each distinct unit encoded once.

    Where all special tokens have a character that keeps a word whole, and
    ``PROBES`` come out alike, the vocabulary parts texts at white space and
    between letters, digits and marks, and drops white space, so that the ids
    of a text are those of its units. Else, or with ``by_units=False``, whole
    texts are encoded.
    """

    def __init__(self, vocabulary: str, by_units: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        # a run of letters goes to the vocabulary's model without the steps before, its bytes as characters
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        self.chars = {b: b if b in own else None for b in range(256)}
        self.chars |= {b: 256 + k for k, b in enumerate(b for b in range(256) if self.chars[b] is None)}
        self.forget()
        self.by_units = by_units and self._parts()

    def _parts(self) -> bool:
        special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        if not all((_KIND[np.frombuffer(t, np.uint8)] == _OTHER).any() for t in special):
            return False
        self.by_units = True
        for text in PROBES:
            data = np.frombuffer(text.encode(), np.uint8)
            if self.encode(data, np.array([0, len(data)]))[0][:-1].tolist() != self.whole(text):
                return False
        return True

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def forget(self) -> None:
        self.hash, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def learn(self, hashes: np.ndarray, texts: list[bytes], letters: np.ndarray) -> None:
        size, flat, tokenize, chars = [], [], self.tokenizer.model.tokenize, self.chars
        for text, plain in zip(texts, letters.tolist()):
            if plain and (text.isascii() or b"\xc4" not in text and b"\xc5" not in text):  # in lower case already
                ids = [t.id for t in tokenize(text.decode("latin-1").translate(chars))]
            else:
                ids = self.whole(text.decode())
            size.append(len(ids))
            flat += ids
        size = np.array(size, np.int64)
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[:self.used], np.zeros(len(flat) + len(self.ids), np.uint32)])
        self.ids[self.used:self.used + len(flat)] = flat
        at = self.used + np.cumsum(size) - size
        self.used += len(flat)
        place = np.searchsorted(self.hash, hashes)
        self.hash, self.at, self.size = np.insert(self.hash, place, hashes), np.insert(self.at, place, at), np.insert(self.size, place, size)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with their ends, number of ids of each)."""
        n = len(offsets) - 1
        if not self.by_units:
            raw = data.tobytes()
            got = [e.ids for e in self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(offsets, offsets[1:])], add_special_tokens=False)]
            return np.concatenate([np.append(x, END) for x in got]).astype(np.uint32), np.array([len(x) + 1 for x in got])
        w, letters = units(data, offsets)
        distinct, example, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.hash, distinct), max(0, len(self.hash) - 1))
        new = np.flatnonzero(self.hash[place] != distinct) if len(self.hash) else np.arange(len(distinct))
        if len(new):
            if len(self.hash) > KNOWN_UNITS:
                self.forget()
                new = np.arange(len(distinct))  # all units of these texts, now that none is known
            raw, at = w.bytes_of(example[new])
            raw = raw.tobytes()
            self.learn(distinct[new], [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())], letters[example[new]])
            place = np.searchsorted(self.hash, distinct)
        start, size = self.at[place][inverse], self.size[place][inverse]
        per_doc = np.bincount(w.doc, weights=size, minlength=n).astype(np.int64)
        out = np.full(int(per_doc.sum()) + n, END, np.uint32)
        out[ragged(np.concatenate([[0], np.cumsum(per_doc + 1)[:-1]]), per_doc)] = self.ids[ragged(start, size)]
        return out, per_doc + 1


def write_file(uri: str, batches: Iterator[tuple[list, np.ndarray, np.ndarray]], width: int) -> tuple[int, int]:
    """Write one file from (doc ids, ids, ids per document); its numbers of documents and ids."""
    store, path = opened(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    rest, blocks, docs, sizes, at = np.zeros(0, np.uint32), [], [], [], 0
    with store.open_output_stream(path) as out:
        def put(ids: np.ndarray) -> None:
            nonlocal at
            blocks.append(at)
            at += out.write(pack_bits(ids.astype(np.uint64), width))

        for doc, ids, size in batches:
            docs.append(np.array([0 if d is None else d for d in doc], np.int64))
            sizes.append(np.stack([size, [d is None for d in doc]]))
            rest = np.concatenate([rest, ids])
            while len(rest) >= BLOCK:
                put(rest[:BLOCK])
                rest = rest[BLOCK:]
        if len(rest):
            put(rest)
        sizes = np.concatenate(sizes, 1) if sizes else np.zeros((2, 0), np.int64)
        before = np.concatenate([[0], np.cumsum(sizes[0])]).astype(np.int64)
        foot = io.BytesIO()
        np.savez(foot, width=width, blocks=np.array(blocks, np.int64), docs=np.concatenate(docs) if docs else np.zeros(0, np.int64), null=sizes[1].astype(bool), before=before)
        out.write(foot.getvalue())
        out.write(len(foot.getvalue()).to_bytes(8, "little"))
    return len(before) - 1, int(before[-1])


class TokenFile:
    """Random access to a file's ids."""

    def __init__(self, uri: str):
        store, path = opened(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        foot = int.from_bytes(self.file.read_at(8, size - 8), "little")
        self.foot = dict(np.load(io.BytesIO(self.file.read_at(foot, size - 8 - foot))))
        self.width, self.end = int(self.foot["width"]), size - 8 - foot
        self.count = int(self.foot["before"][-1])

    def block(self, b: int) -> np.ndarray:
        blocks = self.foot["blocks"]
        to = int(blocks[b + 1]) if b + 1 < len(blocks) else self.end
        return unpack_bits(self.file.read_at(to - int(blocks[b]), int(blocks[b])), self.width, min(BLOCK, self.count - b * BLOCK))

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids from ``start`` to ``end``; reads the blocks they are in."""
        if start >= end:
            return np.zeros(0, np.uint64)
        first = start // BLOCK
        got = np.concatenate([self.block(b) for b in range(first, (end - 1) // BLOCK + 1)])
        return got[start - first * BLOCK:end - first * BLOCK]


def write_tokens(docs: DataFrame, vocabulary: str, folder: str | None = None, by_units: bool = True) -> DataFrame:
    """Write the files; returns their index (part, path, n_docs, n_tokens, first_token), parts in the order of doc_id."""
    folder = folder or shared_path(docs.sparkSession, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        global _encoder
        key = (vocabulary, by_units)
        if globals().get("_encoder", (None,))[0] != key:
            _encoder = (key, Encoder(vocabulary, by_units))
        encoder = _encoder[1]

        def encoded():
            for batch in batches:
                ids, at = batch.column(0).to_pylist(), 0
                for data, offsets in chunks(batch.column(1)):
                    yield (ids[at:at + len(offsets) - 1], *encoder.encode(data, offsets))
                    at += len(offsets) - 1

        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.bin"
        width = max(1, int(encoder.tokenizer.get_vocab_size() - 1).bit_length())
        n_docs, n_tokens = write_file(path, encoded(), width)
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    rows = docs.select("doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    index = stage(rows.mapInArrow(write, "part long, path string, n_docs long, n_tokens long"), "token-index")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return stage(index.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))), "token-index")


def read_tokens(index: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file = TokenFile(row["path"])
                docs, null, before = file.foot["docs"], file.foot["null"], file.foot["before"]
                for lo in range(0, len(docs), 5_000):
                    hi = min(lo + 5_000, len(docs))
                    crc, a = [], int(before[lo])
                    got, base = np.zeros(0, "<u4"), a
                    for d in range(lo, hi):
                        a, b = int(before[d]), int(before[d + 1])
                        c = 0
                        for s in range(a, b, 1 << 20):  # a long document in pieces
                            e = min(b, s + (1 << 20))
                            if e > base + len(got):
                                base, got = s, file.ids(s, min(max(e, s + (1 << 20)), file.count)).astype("<u4")
                            c = zlib.crc32(got[s - base:e - base].tobytes(), c)
                        crc.append(c)
                    start = row["first_token"] + before[lo:hi]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(docs[lo:hi], mask=null[lo:hi]), "start": start, "n_tokens": np.diff(before[lo:hi + 1]), "ids_crc32": pa.array(crc, pa.int64())})

    spark = index.sparkSession
    spread = index.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), F.xxhash64("path"))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark, folder: str) -> DataFrame:
    import public_tokenizers

    return read_tokens(write_tokens(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json")))
