"""Language identification by interpolated Kneser-Ney models of characters.

One model per language over the characters of a word, with its ends, up to
order ``ORDER``; all are kept in sorted hash arrays, one row per n-gram or
context and one column per language. The language with the lowest cross-entropy
per character wins; cross-entropies far above those of known texts of the
winner's language are rejected.

Cases: a null text or one without a letter is ``und`` with score 0 and is
rejected. Ties fall to the first language by code point. Without any learned
language all texts are ``und``. Rows of one text get equal results.
"""

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tillscope.llm.common import WORD, chunks, documents, learns, mixed, words

ORDER = 5
#: Distinct texts per language that a model is fitted on, and as many again, at most, that calibrate it.
FIT_TEXTS = 400
KNOWN_WORDS = 400_000
#: Bytes of text scored at a time; what a worker holds besides the model follows from it.
PIECE = 1 << 20
_STEP, _SEP = np.uint64(0x2545F4914F6CDD1D), 0xFFFF


def clean(text: str) -> str:
    """Text without the code point that ends words here, which is no character: the replacement character stands for it."""
    return text.replace(chr(_SEP), "\ufffd")


def _grams(text: str, order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(place of predicted characters, depth of each, hashes of the 1- to order-grams that end at every character).

    ``text``: words, each followed by the separator, after one at the start.
    """
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sep = c == _SEP
    at = np.arange(len(c))
    last = np.maximum.accumulate(np.where(sep, at, 0))
    depth = at - np.concatenate([[0], last[:-1]])  # characters back to the separator before
    h = [mixed(c + np.uint64(1))]
    for n in range(1, order):
        h.append(np.concatenate([np.zeros(1, np.uint64), h[-1][:-1]]) * _STEP + h[0] + np.uint64(n))
    return np.arange(1, len(c)), depth, h


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
    return at, (table[at] == keys) if len(table) else np.zeros(len(keys), bool)


def train(counts: dict[str, dict[str, int]], order: int = ORDER) -> dict:
    """Models of {language: {word: count}} as arrays: per order n-grams with log probabilities, contexts with log weights."""
    langs = sorted(counts)
    made = []
    for lang in langs:
        ws = sorted(counts[lang])
        text = chr(_SEP) + "".join(w + chr(_SEP) for w in ws)
        at, depth, h = _grams(text, order)
        weight = np.repeat([counts[lang][w] for w in ws], [len(w) + 1 for w in ws]).astype(np.float64)
        depth, here = depth[at], [x[at] for x in h]
        ctx = [None, *(x[at - 1] for x in h)]  # of the n-gram's first n - 1 characters
        levels, lower = [], None
        for n in range(1, order + 1):
            if n == order:
                use = depth >= n - 1
                key, example, inverse = np.unique(here[n - 1][use], return_index=True, return_inverse=True)
                c = np.bincount(inverse, weights=weight[use])
                example = np.flatnonzero(use)[example]
            else:
                # distinct characters before the n-gram; where it starts a word, how often it does
                more = depth >= n
                wide, first = np.unique(here[n][more], return_index=True)
                first = np.flatnonzero(more)[first]
                start = np.flatnonzero(depth == n - 1)
                keys = np.concatenate([here[n - 1][first], here[n - 1][start]])
                w = np.concatenate([np.ones(len(first)), weight[start]])
                from_ = np.concatenate([first, start])
                key, example, inverse = np.unique(keys, return_index=True, return_inverse=True)
                c, example = np.bincount(inverse, weights=w), from_[example]
            n1, n2 = (c == 1).sum(), (c == 2).sum()
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            if n == 1:
                total = c.sum()
                p = np.maximum(c - d, 0) / total + d * len(c) / total / (len(c) + 1)
                levels.append((key, p, None, np.log(d * len(c) / total / (len(c) + 1))))
            else:
                own, inverse = np.unique(ctx[n - 1][example], return_inverse=True)
                total, kinds = np.bincount(inverse, weights=c), np.bincount(inverse)
                back = d * kinds / total
                place, ok = _find(lower[0], here[n - 2][example])
                p = np.maximum(c - d, 0) / total[inverse] + back[inverse] * np.where(ok, lower[1][place], 1e-9)
                levels.append((key, p, (own, back), None))
            lower = (key, p)
        made.append(levels)
    model = {"langs": np.array(langs, dtype=str), "unseen": np.array([m[0][3] for m in made], np.float32)}
    for n in range(order):
        for name, own in (("gram", [(m[n][0], m[n][1]) for m in made]), *((("ctx", [m[n][2] for m in made]),) if n else ())):
            keys = np.unique(np.concatenate([k for k, _ in own])) if own else np.zeros(0, np.uint64)
            table = np.full((len(keys), len(langs)), np.nan, np.float32)
            for j, (k, v) in enumerate(own):
                table[np.searchsorted(keys, k), j] = np.log(v)
            model[f"{name}{n}"], model[f"{name}{n}_log"] = keys, table
    return model


def word_costs(model: dict, raw: str) -> tuple[np.ndarray, np.ndarray]:
    """(summed negative log probabilities per word and language, characters per word) of words that each end with the separator."""
    order = sum(k.startswith("gram") and not k.endswith("_log") for k in model)
    at, depth, h = _grams(chr(_SEP) + raw, order)
    place, ok = _find(model["gram0"], h[0][at])
    log = np.where(ok[:, None], model["gram0_log"][place], np.nan) if len(model["gram0"]) else np.full((len(at), len(model["langs"])), np.nan)
    log = np.where(np.isnan(log), model["unseen"], log)
    for n in range(1, order):
        deep = np.flatnonzero(depth[at] >= n)
        cp, c_ok = _find(model[f"ctx{n}"], h[n - 1][at[deep] - 1])
        deep, cp = deep[c_ok], cp[c_ok]
        gp, g_ok = _find(model[f"gram{n}"], h[n][at[deep]])
        back = model[f"ctx{n}_log"][cp]
        back = np.where(np.isnan(back), 0, back) + log[deep]
        seen = np.where(g_ok[:, None], model[f"gram{n}_log"][gp], np.nan)
        log[deep] = np.where(np.isnan(seen), back, seen)
    ends = np.flatnonzero(np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), "<u4") == _SEP)
    begin = np.concatenate([[0], ends[:-1] + 1]).astype(int)
    return -np.add.reduceat(log, begin, axis=0) if len(begin) else np.zeros((0, len(model["langs"]))), ends - begin + 1


class Scorer:
    """Cross-entropy per character of texts, in each language; the costs of words are remembered."""

    def __init__(self, model: dict):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.hash, self.cost = np.zeros(0, np.uint64), np.zeros((0, len(self.model["langs"]) + 1), np.float32)

    def entropies(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nats per character of each text and language, characters with word ends)."""
        w = words(data, offsets)
        distinct, example, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        place, ok = _find(self.hash, distinct)
        if not ok.all():
            if len(self.hash) > KNOWN_WORDS:
                self.forget()
                ok[:] = False
            new = np.flatnonzero(~ok)
            raw, _ = w.bytes_of(example[new], gap=0x20)
            costs, size = word_costs(self.model, clean(raw.tobytes().decode()).replace(" ", chr(_SEP)).lower()) if len(new) else (self.cost[:, :-1], [])
            place = np.searchsorted(self.hash, distinct[new])
            self.hash = np.insert(self.hash, place, distinct[new])
            self.cost = np.insert(self.cost, place, np.column_stack([costs, size]), axis=0)
            place = np.searchsorted(self.hash, distinct)
        n, k = len(offsets) - 1, self.cost.shape[1]
        total = np.zeros((n, k))
        for j in range(k):
            total[:, j] = np.bincount(w.doc, weights=self.cost[place, j][inverse], minlength=n)
        return total[:, :-1] / np.maximum(total[:, -1:], 1), total[:, -1]


def _udf(packed, calibration: dict | None):
    """A column function of text: with ``calibration`` its language, score and rejection, without it the cross-entropies."""

    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = dict(np.load(io.BytesIO(packed.value)))
        scorer, langs = Scorer(model), model["langs"].tolist()
        for text in texts:
            parts = [scorer.entropies(*c)[0] for c in chunks(text, PIECE)]
            e = np.concatenate(parts) if parts else np.zeros((0, len(langs)))
            if calibration is None:
                yield pa.ListArray.from_arrays(pa.array(np.arange(len(e) + 1) * len(langs), pa.int32()), pa.array(e.ravel()))
                continue
            best = e.argmin(1) if len(langs) else np.zeros(len(e), int)
            low = e[np.arange(len(e)), best]
            score = 1 / np.exp(-calibration["beta"] * (e - low[:, None])).sum(1)
            yield pa.StructArray.from_arrays([pa.array([langs[b] for b in best], pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(low),
                                              pa.array(low > np.array(calibration["limit"])[best])], ["lang", "score", "entropy", "far"])

    scored.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(scored, "array<double>" if calibration is None else "struct<lang:string,score:double,entropy:double,far:boolean>")


def fit(docs: DataFrame, per_language: int = FIT_TEXTS):
    """(broadcast model, calibration) from at most twice ``per_language`` distinct texts of each language, by a hash of the text.

    ``docs``: doc_id, text, lang; rows without a text or language don't count.
    """
    spark = docs.sparkSession
    known = docs.where("text is not null and lang is not null").select("lang", "text", F.xxhash64("text").alias("h"))
    size = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not size:
        return None, None
    # a hash below the limit keeps about three times as many distinct texts as are wanted, or all of few
    share = F.when(F.lit(False), 0.0)
    for lang, n in size.items():
        share = share.when(F.col("lang") == lang, min(1.0, 6 * per_language / max(n, 1)))
    few = known.where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)).groupBy("lang", "h").agg(F.first("text").alias("text"))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("h"), "h"))
    from tillscope.functions.staging import stage

    few = stage(few.withColumn("turn", turn).where(F.col("turn") <= 2 * per_language), "language-sample")
    word = F.explode(F.expr(f"regexp_extract_all(lower(text), r'{WORD}', 0)")).alias("word")
    counts: dict[str, dict[str, int]] = {lang: {} for lang in size}
    for lang, w, n in few.where("turn % 2 = 0 or turn = 1").select("lang", word).groupBy("lang", "word").count().toLocalIterator():
        counts[lang][clean(w)] = counts[lang].get(clean(w), 0) + n
    counts = {k: v for k, v in counts.items() if v}
    if not counts:
        return None, None
    out = io.BytesIO()
    model = train(counts)
    np.savez(out, **model)
    packed = spark.sparkContext.broadcast(out.getvalue())
    langs = model["langs"].tolist()
    held = few.where("turn % 2 = 1").select("lang", _udf(packed, None)("text").alias("e")).collect()
    e, truth = np.array([r["e"] for r in held]).reshape(-1, len(langs)), np.array([langs.index(r["lang"]) if r["lang"] in langs else -1 for r in held])
    e, truth = e[truth >= 0], truth[truth >= 0]
    # sharpness of the score: the one under which the known languages are most likely
    loss = lambda b: np.mean(b * (e[np.arange(len(e)), truth] - e.min(1)) + np.log(np.exp(-b * (e - e.min(1, keepdims=True))).sum(1))) if len(e) else 0
    beta = min((2.0 ** k for k in range(0, 9)), key=loss)
    limit = []
    for j in range(len(langs)):
        own = e[truth == j, j]
        mid, high = (np.median(own), np.quantile(own, 0.995)) if len(own) else (0.0, 20.0)
        limit.append(float(max(high + 4 * (high - mid), 2 * mid)))
    return packed, {"beta": float(beta), "limit": limit}


def identify(docs: DataFrame, known: DataFrame, name: str = "found", text: str = "text") -> DataFrame:
    """``docs`` with a column ``name``: lang, score, entropy and far (rejected) of each whole text, learned from ``known``."""
    packed, calibration = fit(known)
    und = F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("entropy"), F.lit(True).alias("far"))
    if packed is None:
        return docs.withColumn(name, und)
    found = _udf(packed, calibration)(text)
    return docs.withColumn(name, F.when(F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False)), found).otherwise(und))


def op4_kneser_ney(spark, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    out = identify(docs.select("doc_id", "text"), docs.where(learns(4, 2)).select("doc_id", "text", "lang"))
    return out.select("doc_id", (~learns(4, 2)).alias("held_out"), F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"), F.col("found.far").alias("rejected"), F.col("found.entropy").alias("entropy"))
