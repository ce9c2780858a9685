"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur in a text with up to ``RATE`` edits per character. It is
split into one piece more than it has edits, so that any such occurrence holds
a piece unchanged. An Aho-Corasick automaton finds the pieces in whole texts,
and Myers' bit-parallel distance verifies the surroundings of each.

Letters A-Z count as a-z and white space as blanks, so places are code points
of the original text. Cases: null or empty texts have no match; items that are
null or blank are not searched for; those too short for one edit match as whole
words, that is, no letter or digit may go on before or after them. Items with one
text are each reported.

Items come to the driver, and go to the tasks, in blocks of at most ``BLOCK``
items and ``BLOCK_CHARS`` code points (or one longer item). With more than one
block, each is searched for in a pass of its own over a staged copy of the documents,
so that one block at a time is in memory, however many items there are.
"""

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tillscope.functions.staging import stage
from tillscope.llm.common import chunks, documents

RATE, BLOCK, BLOCK_CHARS = 0.05, 5_000, 4_000_000
#: Code points that an occurrence has at least for the pipeline to drop its document; shorter ones are only reported.
PASSAGE = 25
MATCHES = "array<struct<item_id:bigint,start:bigint,end:bigint,distance:bigint>>"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A"):ord("Z") + 1] += 32
_FOLD[0x09:0x0E] = 0x20


def folded(text: str) -> str:
    return _FOLD[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)].tobytes().decode("utf-8", "surrogatepass")


def bordered(text: str, start: int, end: int) -> bool:
    """No word goes on before ``start`` or after ``end``."""
    return not (text[start - 1:start + 1].isalnum() and start) and not (text[end - 1:end + 1].isalnum() and end < len(text))


class Pattern:
    """Semi-global edit distance of one pattern; one machine word per text character, as Python's integers have any width."""

    def __init__(self, text: str):
        self.size, self.full = len(text), (1 << len(text)) - 1
        self.at = defaultdict(int)
        for i, c in enumerate(text):
            self.at[c] |= 1 << i

    def best_end(self, text: str, most: int) -> tuple[int, int]:
        """(distance, end) of the first nearest occurrence in ``text``; distance ``most`` + 1 if none is near enough."""
        plus, minus, score, high, full = self.full, 0, self.size, 1 << (self.size - 1), self.full
        best, end = most + 1, 0
        get = self.at.get
        for j, c in enumerate(text, 1):
            eq = get(c, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            ph = minus | (full & ~(xh | plus))
            mh = plus & xh
            if ph & high:
                score += 1
            elif mh & high:
                score -= 1
            ph <<= 1
            mh <<= 1
            plus = (mh & full) | (full & ~(xv | ph))
            minus = ph & xv & full
            if score < best:
                best, end = score, j
        return best, end


class Items:
    """Automaton over the pieces of some items."""

    def __init__(self, items: list[tuple[list[int], str]], rate: float):
        import ahocorasick

        self.items, pieces = [], defaultdict(list)
        for ids, text in items:
            k = int(len(text) * rate)
            self.items.append((ids, text, k, Pattern(text), Pattern(text[::-1])))
            cuts = [len(text) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces[text[a:b]].append((len(self.items) - 1, a))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in pieces.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, distance) of every occurrence, by start and item."""
        out, done, tried = [], {}, set()
        for last, (size, uses) in self.automaton.iter(text):
            for n, offset in uses:
                at = last + 1 - size - offset  # where the item would start without edits before the piece
                if (n, at) in tried or last < done.get(n, -1):
                    continue
                tried.add((n, at))
                ids, item, k, forward, backward = self.items[n]
                if not k and not bordered(text, at, last + 1):
                    continue
                low = max(0, at - k)
                window = text[low:max(low, at + len(item) + k)]
                distance, end = forward.best_end(window, k)
                if distance > k:
                    continue
                _, back = backward.best_end(window[:end][::-1], k)
                start, stop = low + end - back, low + end
                if start < done.get(n, -1):
                    continue
                done[n] = stop
                out += [(i, start, stop, distance) for i in ids]
        return sorted(out, key=lambda m: (m[1], m[0]))


def finder(items: list[tuple[list[int], str]], rate: float, spark):
    """A column function of text that gives the matches of these items."""
    packed = spark.sparkContext.broadcast(items)  # one block, of bounded size

    def found(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        search = Items(packed.value, rate)
        kind = pa.list_(pa.struct([(f, pa.int64()) for f in ("item_id", "start", "end", "distance")]))
        for text in texts:
            rows = []
            for data, offsets in chunks(text):
                raw, offsets = _FOLD[data].tobytes(), offsets.tolist()
                rows += [search.matches(raw[a:b].decode()) for a, b in zip(offsets, offsets[1:])]
            yield pa.array([[dict(zip(("item_id", "start", "end", "distance"), m)) for m in r] for r in rows], kind)

    found.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(found, MATCHES)


def blocks(benchmark: DataFrame, least: int = 1) -> Iterator[list[tuple[list[int], str]]]:
    """Distinct folded item texts with their ids, a block at a time."""
    same = (benchmark.where("item_id is not null and text is not null").select("item_id", F.trim(F.translate("text", "\t\n\x0b\f\r", "     ")).alias("text"))
            .where(F.length("text") >= least).groupBy("text").agg(F.sort_array(F.collect_set(F.col("item_id").cast("long"))).alias("ids")))
    block: dict[str, list[int]] = {}
    chars = 0
    for text, ids in same.orderBy("ids").toLocalIterator():
        if block and (len(block) == BLOCK or chars + len(text) > BLOCK_CHARS):
            yield [(v, k) for k, v in block.items()]
            block, chars = {}, 0
        block.setdefault(folded(text), []).extend(ids)
        chars += len(text)
    if block:
        yield [(v, k) for k, v in block.items()]


def find_items(docs: DataFrame, benchmark: DataFrame, name: str = "matches", rate: float = RATE, text: str = "text") -> DataFrame:
    """``docs`` with a column ``name``: all occurrences of items in the whole text."""
    none, done = F.expr(f"cast(array() as {MATCHES})"), False
    for block in blocks(benchmark):
        if done:
            docs = stage(docs, "matched")
        found = finder(block, rate, docs.sparkSession)(text)
        docs, done = docs.withColumn(name, F.concat(name, found) if done else found), True
    return docs if done else docs.withColumn(name, none)


def op7_edit_matches(spark, folder: str) -> DataFrame:
    docs, benchmark = documents(spark, folder).select("doc_id", "text"), spark.read.parquet(f"{folder}/benchmark.parquet")
    out = find_items(docs, benchmark).where("size(matches) > 0").select("doc_id", F.explode("matches").alias("m"))
    return out.select("doc_id", "m.*")
