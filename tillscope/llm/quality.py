"""Quality rules: an ordered list of threshold conjunctions, learned by sequential covering from labelled statistics.

Cases: a null or empty text has no words, all counts zero, and fails the base
rule. Labels without a value, or for unknown documents, are not used; several
labels of one document count as the worst. Without any bad label no rule is
learned and only the base rule decides. Repeated documents each get their row.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tillscope.llm.common import chunks, prefix_hash, run_hash, words

#: Labelled documents that the rules are fitted on, at most; the choice follows a hash of doc_id.
FIT_ROWS = 10_000
SYMBOLS = "#*$%&|<>"
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_letters long, n_digits long, n_marks long, n_lines long"
#: Statistics per word or character that rules may test.
FEATURES = {
    "words": "n_words", "word_length": "word_chars / greatest(n_words, 1)", "symbols": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)", "repeats": "n_repeat_words / greatest(n_words, 1)",
    "upper": "n_upper / greatest(n_letters, 1)", "letters": "n_letters / greatest(word_chars, 1)",
    "digits": "n_digits / greatest(word_chars, 1)", "marks": "n_marks / greatest(word_chars, 1)",
}

_is = lambda test: np.array([test(chr(b)) for b in range(256)])
_SYMBOL = _is(lambda c: c in SYMBOLS)
_UPPER = _is(lambda c: "A" <= c <= "Z")
_LETTER = _is(lambda c: c.isascii() and c.isalpha()) | (np.arange(256) >= 0xC0)  # a lead byte stands for a letter beyond ASCII
_DIGIT = _is(lambda c: "0" <= c <= "9")
_MARK = _is(lambda c: c in "!?.,;:")
_LEAD = (np.arange(256) & 0xC0) != 0x80


def _counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    w = words(data, offsets, lower=False)
    first, n = w.first(), len(offsets) - 1

    def tally(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[offsets[1:]] - total[offsets[:-1]]

    spaces = np.isin(data, [0x20, *range(0x09, 0x0E)])
    # words in 5-word windows that the text holds twice or more
    at = np.flatnonzero(w.doc[4:] == w.doc[:-4]) if len(w.doc) > 4 else np.zeros(0, int)
    window = run_hash(prefix_hash(w.hash), at, at + 5)
    order = np.lexsort((window, w.doc[at]))
    same = (window[order][1:] == window[order][:-1]) & (w.doc[at][order][1:] == w.doc[at][order][:-1])
    twice = np.zeros(len(at) + 1, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cover = np.zeros(len(w.doc) + 1, int)
    np.add.at(cover, at[twice[:-1]], 1)
    np.add.at(cover, at[twice[:-1]] + 5, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    # lines with a word that equal an earlier line of the text
    cut = np.flatnonzero(data == 0x0A)
    begin = np.sort(np.concatenate([offsets[:-1], cut + 1]), kind="stable")
    line_doc = np.searchsorted(offsets[:-1], begin, side="right") - 1
    stop = np.sort(np.concatenate([cut, offsets[1:]]), kind="stable")
    dup, lines = np.zeros(n, int), np.zeros(n, int)
    seen, last = set(), -1
    for d, s, e in zip(line_doc.tolist(), begin.tolist(), stop.tolist()):
        if d != last:
            seen, last = set(), d
        line = data[s:e].tobytes()
        if line.strip(b" \t\n\v\f\r"):
            lines[d] += 1
            dup[d] += line in seen
            seen.add(line)
    return [np.diff(first), tally(_LEAD[data] & ~spaces), tally(_SYMBOL[data]), dup, covered[first[1:]] - covered[first[:-1]],
            tally(_UPPER[data]), tally(_LETTER[data]), tally(_DIGIT[data]), tally(_MARK[data]), lines]


def _stats(text: pa.Array) -> pa.Array:
    parts = [_counts(*c) for c in chunks(text)]
    names = [s.split()[0] for s in STATS.split(", ")]
    if not parts:
        return pa.StructArray.from_arrays([pa.array([], pa.int64())] * len(names), names)
    return pa.StructArray.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts)], names)


def stats(text: str) -> Column:
    return arrow_udf(_stats, f"struct<{STATS.replace(' long', ':bigint')}>")(text)


def text_stats(docs: DataFrame) -> DataFrame:
    """(doc_id, statistics of the whole text), one row per document."""
    return docs.select("doc_id", stats("text").alias("s")).select("doc_id", "s.*")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def learn(x: np.ndarray, bad: np.ndarray, cuts: int = 48, least: int = 5, pure: float = 0.98) -> list[list[tuple[int, str, float]]]:
    """Rules, each a conjunction of (column of x, "<=" or ">", threshold), that cover bad rows and hardly any good one.

    Two thirds of the rows grow a rule, one test after another by the gain in
    information on the bad rows covered; the rest prunes its last tests. A rule
    stays if at least ``least`` rows support it and ``pure`` of them are bad.
    """
    rules, side = [], np.arange(len(bad)) % 3 == 2
    left = np.ones(len(bad), bool)
    grid = [np.unique(np.quantile(x[:, j], np.linspace(0.01, 0.99, cuts))) for j in range(x.shape[1])] if len(x) else []
    while (left & bad & ~side).sum() >= least:
        rule, cover = [], left & ~side
        while (cover & ~bad).any() and len(rule) < 4:
            p, n = (cover & bad).sum(), (cover & ~bad).sum()
            best = (0.0, None)
            for j, steps in enumerate(grid):
                at = np.searchsorted(steps, x[cover, j], side="left")
                low_p = np.cumsum(np.bincount(at[bad[cover]], minlength=len(steps) + 1))[:-1]
                low_n = np.cumsum(np.bincount(at[~bad[cover]], minlength=len(steps) + 1))[:-1]
                for sign, cp, cn in (("<=", low_p, low_n), (">", p - low_p, n - low_n)):
                    gain = np.where(cp > 0, cp * (np.log2(np.maximum(cp, 1) / np.maximum(cp + cn, 1)) - np.log2(p / (p + n))), 0)
                    if gain.max(initial=0) > best[0] + 1e-9:
                        best = (gain.max(), (j, sign, float(steps[gain.argmax()])))
            if best[1] is None:
                break
            rule.append(best[1])
            cover = cover & _holds(x, rule[-1:])
        if not rule:
            break

        def worth(k: int) -> float:
            c = left & side & _holds(x, rule[:k])
            return ((c & bad).sum() - (c & ~bad).sum()) / max(1, c.sum())

        rule = rule[:max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))]
        c = left & _holds(x, rule)
        if not (c & bad & ~side).any():
            break
        if (c & bad).sum() < least or (c & bad).sum() < pure * c.sum():
            left &= ~(c & bad)  # these can't be told from good ones
            continue
        rules.append(rule)
        left &= ~c
    return rules


def _holds(x: np.ndarray, rule: list[tuple[int, str, float]]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, sign, t in rule:
        out &= x[:, j] <= t if sign == "<=" else x[:, j] > t
    return out


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> list[list[tuple[int, str, float]]]:
    """Learn rules from at most ``rows`` labelled documents (quality 0 is bad)."""
    chosen = (labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_good"))
              .orderBy(F.xxhash64("_id"), "_id").limit(rows))
    seen = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))  # at most ``rows`` rows of two numbers
    table = (seen.select("doc_id", "_good", stats("text").alias("s")).selectExpr("doc_id", "_good", "s.*")
             .where(~base_failed()).select("doc_id", "_good", *(F.expr(e).cast("double").alias(k) for k, e in FEATURES.items()))
             .orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).limit(2 * rows)).toPandas()
    return learn(table[list(FEATURES)].to_numpy(float), (table["_good"] == 0).to_numpy())


def decision(rules: list[list[tuple[int, str, float]]]) -> Column:
    """Number of the first rule that holds, from 1, as one conditional expression over the statistics; 0 if none does."""
    names = list(FEATURES.values())
    out = F.when(F.lit(False), F.lit(0))
    for k, rule in enumerate(rules, 1):
        out = out.when(F.expr(" AND ".join(f"({names[j]}) {sign} {t!r}D" for j, sign, t in rule)), F.lit(k))
    return out.otherwise(F.lit(0))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of every document, base verdict, the learned rule that rejects it (0: none) and the final verdict."""
    rules = fit(docs, labels)
    return (text_stats(docs).withColumn("base_failed", base_failed()).withColumn("rule", decision(rules))
            .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)))


def op10_quality_rules(spark, folder: str) -> DataFrame:
    from tillscope.llm.common import documents

    out = judge(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
