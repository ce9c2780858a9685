"""Corpus operators against plain Python on a small folder, and on tables of odd rows."""

import collections
import hashlib
import io
import math
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from tillscope.functions.staging import stage
from tillscope.llm import common, contamination, credentials, language, mixing, ngram_trie, quality, queries, shards, simhash, suffixes, token_files

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, size long, copies string, fp long, doc string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{FOLDER}/documents.parquet").set_index("doc_id").sort_index()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, and columns that operators might use themselves."""
    common.ship(spark)
    long = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))
    rows = [(1, "the cat sat on the mat and looked at the dog in the yard", "en", "a", 5, 1, 1, "x", 1, "d")] * 3
    rows += [(2, None, "en", "a", None, None, None, None, None, None), (None, "le chat est sur la table et regarde le chien", "fr", None, 1, 1, 1, "", 1, ""),
             (None, None, None, None, None, None, None, None, None, None), (3, "", "en", "b", 0, 0, 0, "", 0, ""), (4, " \n\t ", "fr", "b", 0, 0, 0, "", 0, ""),
             (5, long, "en", "c", 9, 9, 9, "9", 9, "9"), (6, "1234 5678 !!!", "fr", "c", 1, 1, 1, "1", 1, "1"), (7, "été \U0001F600 naïve", None, "a", 1, 1, 1, "", 1, ""),
             (8, "no\uffffchar and \uffff alone \ufffe \U0010ffff end", "en", "a", 1, 1, 1, "", 1, "")]
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def run(spark, name):
    return queries.QUERIES[name](spark, FOLDER).toPandas().set_index("doc_id").sort_index()


def test_shards(spark, docs):
    got = run(spark, "op1_label_propagation")
    assert (got["size"] == docs.text.map(lambda t: len(t.encode()) + 1)).all()
    assert (got.text_crc32 == docs.text.map(lambda t: zlib.crc32(t.encode()))).all()
    sizes = got.groupby("shard").size()
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    split = got.join(docs.text).groupby("text").shard.nunique()
    assert (split > 1).sum() <= 7


def test_shards_cut_far_fewer_links_than_dealing_at_random(spark):
    common.ship(spark)
    rng = np.random.default_rng(1)
    sizes = [int(x) for x in np.minimum(rng.zipf(1.6, 200) + 1, 60)]
    rows = [(k, f"group {g}") for k, g in enumerate(g for g, n in enumerate(sizes) for _ in range(n))]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    got = shards.shard_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).toPandas().merge(pd.DataFrame(rows, columns=["doc_id", "text"]))

    def cut(label):  # pairs of equal texts in different shards, counted by group
        n = got.groupby(["text", label]).size()
        return sum((s.sum() ** 2 - (s ** 2).sum()) // 2 for _, s in n.groupby("text"))

    got["random"] = rng.permutation(np.arange(len(got)) % 8)
    assert cut("shard") < 0.25 * cut("random")
    even = got.groupby("shard").size()
    assert even.max() - even.min() <= 1


def test_shards_stay_even_and_mostly_uncut_beside_a_hot_group(spark):
    common.ship(spark)
    hot = spark.range(800).selectExpr("id as doc_id", "if(id < 300, 'same', cast(id div 2 as string)) as text")
    got = shards.shard_rows(hot).toPandas()
    assert sorted(got.groupby("shard").size()) == [100] * 8
    pairs = got[got.doc_id >= 300].assign(pair=lambda x: x.doc_id // 2).groupby("pair").shard.nunique()
    assert (pairs > 1).mean() < 0.5  # quotas bind everywhere here, as no row is free to move


def test_token_files(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    got = run(spark, "op2_token_files")
    for doc_id, text in docs.text.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        assert tuple(got.loc[doc_id, ["start", "n_tokens", "ids_crc32"]]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_token_ids_by_units_are_those_of_whole_texts(monkeypatch):
    import public_tokenizers

    encoder = token_files.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert encoder.by_units
    rng = np.random.default_rng(4)
    bits = [*"aZé9É.,'<|> \t\n\u00a0\u0085×÷İĲſßΣ中½²_", "<|endoftext|>", "'S", "'ll", "e\u0301", "\U0001f600", "\uffff", "\x1c", "word", "ÀÉ", "12"]
    texts = ["".join(rng.choice(bits, int(rng.integers(0, 14)))) for _ in range(4000)]
    texts += pd.read_parquet("/root/testdata/sf0.01/documents.parquet").text.tolist()
    want = [[*e.ids, 1] for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(token_files, "KNOWN_UNITS", 20_000)  # so that some are forgotten
    got = []
    for data, offsets in common.chunks(pa.array(texts), 1 << 19):
        ids, size = encoder.encode(data, offsets)
        got += [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])]
    assert got == want


def test_other_vocabularies_encode_whole_texts():
    import public_tokenizers

    encoder = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))  # keeps white space
    data = np.frombuffer("one  Two\n three".encode(), np.uint8)
    assert not encoder.by_units and encoder.encode(data, np.array([0, len(data)]))[0][:-1].tolist() == encoder.whole("one  Two\n three")


@pytest.mark.parametrize("width", [1, 5, 16, 17, 33])
def test_bits_round_trip_and_random_access(tmp_path, width):
    ids = np.random.default_rng(width).integers(0, 1 << min(width, 31), 70_001).astype(np.uint32)
    path = str(tmp_path / "x.bin")
    assert token_files.write_file(path, iter([([1, None], ids[:70_000], np.array([3, 69_997])), ([7], ids[70_000:], np.array([1]))]), width) == (3, 70_001)
    file = token_files.TokenFile(path)
    assert (file.ids(65_530, 65_545) == ids[65_530:65_545]).all() and (file.ids(0, 70_001) == ids).all() and len(file.ids(5, 5)) == 0


def test_mixing(spark, docs):
    got = run(spark, "op3_entropy_mix")
    assert (got["size"] == docs.text.map(lambda t: len(words(t)))).all() and (got.taken <= 3 * got["size"]).all()
    by = got.join(docs.source).groupby("source").agg(total=("size", "sum"), said=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"), largest=("size", "max"))
    weight = pd.Series({s: 1 + k % 3 for k, s in enumerate(sorted(by.index))})
    want, capped = None, pd.Series(False, by.index)
    while want is None or (want > 3 * by.total * (1 + 1e-12)).any():
        if want is not None:
            capped |= want > 3 * by.total
        want = (weight * (by.total.sum() - 3 * by.total[capped].sum()) / weight[~capped].sum()).where(~capped, 3 * by.total)
    assert np.allclose(by.target, want) and (by.total == by.said).all() and ((by.taken - by.target).abs() <= by.largest).all()
    assert run(spark, "op3_entropy_mix").equals(got)


def test_mixing_rates_solve_the_dual(spark, docs):
    got = run(spark, "op3_entropy_mix").join(docs.source.rename("src"))
    for _, g in got.groupby("src"):
        size, target = g["size"].to_numpy(float), g.target.iloc[0]
        z = size / max(size.mean(), 1e-9)
        words_at = lambda lam: (size * np.minimum(3.0, np.exp(np.minimum(lam * z, 50)))).sum()
        low, high = -200.0, 200.0
        for _ in range(200):  # bisection
            mid = (low + high) / 2
            low, high = (mid, high) if words_at(mid) < target else (low, mid)
        want = np.minimum(3.0, np.exp(np.minimum(high * z, 50)))
        if target >= 3 * size.sum() * (1 - 1e-9):
            want = np.full(len(size), 3.0)
        some = size > 0
        assert np.allclose(g.rate[some], want[some], rtol=1e-5, atol=1e-9)
        # whole copies follow the rates: within one of their sums along sizes, and no document above the highest rate
        order = np.lexsort((-g.copies.to_numpy(), size))
        assert (g.copies <= 3).all() and np.abs(np.cumsum((g.copies.to_numpy() - g.rate.to_numpy())[order])[-1]) < 1.5


def test_language(spark, docs):
    got = run(spark, "op4_kneser_ney")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.index]).all()
    assert ((got.lang_pred == docs.lang)[got.held_out]).mean() > 0.9 and got.score.between(0, 1).all()


def plain_kneser_ney(counts, order):
    """log probability of a character of a word (ends included) by dictionaries: log_p(characters so far, character)."""
    sep = "\uffff"
    grams = [collections.Counter() for _ in range(order)]
    for word, n in counts.items():
        text = f"{sep}{word}{sep}"
        for at in range(1, len(text)):
            for k in range(1, min(order, at + 1) + 1):
                if k == order or at == k - 1:  # the longest, and those that start a word, by how often they occur
                    grams[k - 1][text[at - k + 1:at + 1]] += n
    for k in range(1, order):  # the others by the distinct characters before them
        longer = {f"{sep}{w}{sep}"[at - k:at + 1] for w in counts for at in range(k, len(w) + 2)}
        grams[k - 1].update(collections.Counter(g[1:] for g in longer))
    discount = []
    for g in grams:
        ones, twos = (sum(c == n for c in g.values()) for n in (1, 2))
        discount.append(ones / (ones + 2 * twos) if ones and twos else 0.5)
    total = [collections.Counter() for _ in range(order)]
    kinds = [collections.Counter() for _ in range(order)]
    for k, g in enumerate(grams):
        for gram, c in g.items():
            total[k][gram[:-1]] += c
            kinds[k][gram[:-1]] += 1

    def p(gram):
        k, d = len(gram) - 1, discount[len(gram) - 1]
        n = total[k][gram[:-1]]
        if k == 0:
            return max(grams[0][gram] - d, 0) / n + d * len(grams[0]) / n / (len(grams[0]) + 1)
        return p(gram[1:]) if not n else max(grams[k][gram] - d, 0) / n + d * kinds[k][gram[:-1]] / n * p(gram[1:])

    def cost(word):
        text = f"{sep}{word}{sep}"
        return -sum(math.log(p(text[max(0, at - order + 1):at + 1])) for at in range(1, len(text)))

    return cost


@pytest.mark.parametrize("order", [2, 3, 5])
def test_kneser_ney_against_dictionaries(order):
    rng = np.random.default_rng(order)
    counts = {lang: {"".join(rng.choice(list(chars), int(rng.integers(1, 9)))): int(rng.integers(1, 6)) for _ in range(150)} for lang, chars in (("x", "abcde"), ("y", "cdefgé\U0001f600"))}
    model = language.train(counts, order)
    asked = [*list(counts["x"])[:40], *list(counts["y"])[:40], "zzz", "abz", "", "edcba" * 4]
    costs, size = language.word_costs(model, "".join(f"{w}\uffff" for w in asked))
    for j, lang in enumerate(model["langs"].tolist()):
        plain = plain_kneser_ney(counts[lang], order)
        assert np.allclose(costs[:, j], [plain(w) for w in asked], rtol=1e-4)
    assert size.tolist() == [len(w) + 1 for w in asked]


def test_the_end_of_words_within_a_word_is_another_character():
    scorer = language.Scorer(language.train({"a": {"hello": 3, "world": 2, "wor\ufffdld": 1}, "b": {"foo": 1}}))
    texts = ["hello wor\uffffld foo", "hello wor\ufffdld foo", "\uffff", "", "\uffff\uffff hello"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    cost, size = scorer.entropies(data, np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]))
    assert (cost[0] == cost[1]).all() and size.tolist() == [17, 17, 2, 0, 9] and np.isfinite(cost).all()


def test_trie(spark, docs):
    got = run(spark, "op5_elias_fano_trie")
    count = collections.Counter()
    for i, t in docs.text.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            count.update([*words(t), None])
    n, v = sum(count.values()), len(count)
    for i, t in docs.text.items():
        own = [*words(t), None]
        base = sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in own)
        r = got.loc[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(count[x] > 0 for x in own), n) and abs(r.base_score - base) < 1e-6 * abs(base)
    assert got.score[got.held_out].sum() > got.base_score[got.held_out].sum() and (got.score < 0).all()


def test_trie_holds_ngrams_seen_once(spark):
    common.ship(spark)
    trie = ngram_trie.fit(spark.createDataFrame([("a b c",), ("a b d",)], "text string"))
    assert [sum(x[3].values()) for x in trie.levels] == [5, 4]  # ab bc bd c. d. and abc abd bc. bd.
    base = {x: (n + 0.5) / (8 + 0.5 * 6) for x, n in {"a": 2, "b": 2, "c": 1, ".": 2}.items()}
    ab = 2 / 3 + base["b"] / 3
    bc, c_end = 1 / 4 + base["c"] / 2, 1 / 2 + base["."] / 2
    want = math.log10(base["a"]) + math.log10(ab) + math.log10(1 / 4 + bc / 2) + math.log10(1 / 2 + c_end / 2)
    got = ngram_trie.score(spark.createDataFrame([("a b c",)], "text string"), trie).first().lm.score
    assert abs(got - want) < 4 * 2 / ngram_trie.STEPS


def test_quantised_chances_stay_apart_and_never_above():
    p = 10.0 ** -np.arange(0, 16.0)
    q = 10.0 ** (ngram_trie._quantised(p) / -ngram_trie.STEPS)
    assert (q <= p * (1 + 1e-6)).all() and (q > p * 0.9).all()


def test_elias_fano():
    rng = np.random.default_rng(1)
    for top in (3, 1000, 1 << 40):
        values = np.sort(rng.integers(0, top, 5000)).astype(np.uint64)
        ef = ngram_trie.EliasFano(ngram_trie.EliasFano.arrays(values, "x"), "x")
        at = rng.integers(0, 5000, 800)
        assert (ef[at] == values[at].astype(np.int64)).all()
        ask = rng.integers(0, top, 800)
        want = np.isin(ask, values.astype(np.int64))
        found = ef.search(ask, np.zeros(800, np.int64), np.full(800, 5000))
        assert ((found >= 0) == want).all() and (values[found[want]].astype(np.int64) == ask[want]).all()


def fingerprints(docs):
    for i, t in docs.text.items():
        w = words(t)
        shingles = [" ".join(w[k:k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
        ones = np.zeros(64, int)
        for s in shingles:
            h = xxhash.xxh64_intdigest(s.encode(), 42)
            ones += [h >> b & 1 for b in range(64)]
        yield i, sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def near(fps):
    """Smallest index that each can reach over at most three differing bits."""
    top = list(range(len(fps)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    return [root(x) for x in range(len(fps))]


def test_simhash(spark, docs):
    got = run(spark, "op6_simhash_golay")
    ids, fps = zip(*fingerprints(docs))
    assert list(got.fingerprint) == [f"{f:016x}" for f in fps]
    assert list(got.component_id) == [ids[r] for r in near(fps)]


def test_golay_keys_lose_no_link(spark):
    common.ship(spark)
    rng = np.random.default_rng(7)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    for f in fps[:40]:
        for n in (1, 2, 3, 4):
            fps.append(f ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False)))
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    got = {r["fp"]: r["root"] for r in simhash.link(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    want = near([f % (1 << 64) for f in fps])
    assert [got[f] for f in fps] == [fps[r] for r in want]


def test_near_duplicates_stage_keeps_one_of_each_group(spark, docs):
    rng, base = np.random.default_rng(5), [f"w{k}" for k in range(400)]
    texts = dict(docs.text.items())
    for n in range(60):  # copies with 0 to 2 words changed, and texts of their own
        w = list(base)
        for k in rng.choice(len(w), int(rng.integers(0, 3)), replace=False):
            w[k] = f"x{n}"
        texts[10_000 + 2 * n] = " ".join(w)
        texts[10_001 + 2 * n] = " ".join(f"y{n}z{k}" for k in range(40))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = corpus_pipeline.near_duplicates(spark, df, FOLDER)
    ids, fps = zip(*sorted(fingerprints(pd.DataFrame({"text": texts}))))
    want = sorted({ids[r] for r in near(fps)})
    assert len(want) < len(texts) - 50 and sorted(r["doc_id"] for r in got.select("doc_id").collect()) == want


def test_decontamination(spark, docs):
    items = pd.read_parquet(f"{FOLDER}/benchmark.parquet")
    want = {(i, k) for i, t in docs.text.items() for k, x in zip(items.item_id, items.text) if x.translate(LOWER) in t.translate(LOWER)}
    got = queries.QUERIES["op7_edit_matches"](spark, FOLDER).toPandas()
    assert set(zip(got.doc_id, got.item_id)) >= want and len(want) > 0


def test_edit_matches_against_dynamic_programming():
    rng = np.random.default_rng(3)
    for _ in range(60):
        item = "".join(rng.choice(list("abcd "), 60))
        text = list("".join(rng.choice(list("abcd "), 40)) + item + "".join(rng.choice(list("abcd "), 40)))
        for _ in range(int(rng.integers(0, 7))):
            text[int(rng.integers(0, len(text)))] = str(rng.choice(["x", "", "a"]))
        text = "".join(text)
        row = list(range(len(item) + 1))
        best = len(item)
        for c in text:
            new = [0]
            for j, d in enumerate(item, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
            row, best = new, min(best, new[-1])
        got = contamination.Items([([5], item)], 0.05).matches(text)
        assert bool(got) == (best <= 3) and (not got or min(m[3] for m in got) == best)


def test_short_items_match_exactly_at_word_borders(spark):
    common.ship(spark)
    texts = ["Is it Paris, then?", "comparison", "parisian", "Pariz", "paris", "", "what is\tC++? yes", "c++x", "abc c+", "x2 (c++)"]
    items = spark.createDataFrame([(1, " Paris "), (2, "C++"), (3, " ")], "item_id long, text string")
    got = rows_of(contamination.find_items(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), items))
    assert {r["doc_id"]: [(m["item_id"], m["start"], m["end"], m["distance"]) for m in r["matches"]] for r in got if r["matches"]} == {
        0: [(1, 6, 11, 0)], 4: [(1, 0, 5, 0)], 6: [(2, 8, 11, 0)], 7: [(2, 0, 3, 0)], 9: [(2, 4, 7, 0)]}


def test_items_in_blocks_give_the_same_matches(spark, docs, monkeypatch):
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").limit(60)
    spread = lambda df: {r["doc_id"]: sorted(map(str, r["matches"])) for r in rows_of(df)}
    whole = spread(contamination.find_items(frame, items))
    monkeypatch.setattr(contamination, "BLOCK", 1 + items.count() // 3)
    parts = list(contamination.blocks(items))
    assert len(parts) >= 3 and spread(contamination.find_items(frame, items)) == whole
    monkeypatch.setattr(contamination, "BLOCK_CHARS", 150)
    assert all(len(p) == 1 or sum(len(t) for _, t in p) <= 150 for p in contamination.blocks(items))


def test_decontamination_stage_drops_passages_only(spark, tmp_path):
    spark.createDataFrame([(1, "yes"), (2, "A question that is a passage, is it not?")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, "well, yes."), (2, "so: a question that is a pasage, is it not? yes"), (3, "no"), (4, None), (None, "yes")]
    left = corpus_pipeline.decontaminate(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "3", "4", "None"]


def plain_matches(texts, items, rate):
    """Documents with an occurrence of a whole item within its edits, by dynamic programming over all of each text."""
    found = set()
    for i, t in texts.items():
        t = contamination.folded(t or "")
        for item in items:
            item, row = contamination.folded(item).strip(), None
            column = np.arange(len(item) + 1)
            best = len(item)
            for c in t:  # one column at a time; deletions by a running minimum
                cost = np.minimum(column[:-1] + (np.frombuffer(item.encode("utf-32-le"), "<u4") != ord(c)), column[1:] + 1)
                new = np.concatenate([[0], cost])
                column = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
                best = min(best, int(column[-1]))
            if best <= int(len(item) * rate):
                found.add(i)
                break
    return found


def test_decontamination_stage_against_dynamic_programming(spark, docs):
    items = pd.read_parquet(f"{FOLDER}/benchmark.parquet").text.dropna().tolist()
    short = docs.text[docs.text.map(lambda t: len(t or "")) < 2500].iloc[:60]
    frame = spark.createDataFrame(list(short.items()), "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.decontaminate(spark, frame, FOLDER).collect()}
    assert set(short.index) - kept == plain_matches(short.to_dict(), items, contamination.RATE)


def test_repeated_passages(spark, docs):
    got = run(spark, "op8_sparse_suffixes")
    own, seen = {i: words(t) for i, t in docs.text.items()}, collections.defaultdict(set)
    for i, w in own.items():
        for k in range(len(w) - 49):
            seen[tuple(w[k:k + 50])].add(i)
    for i, w in own.items():
        cover = set()
        for k in range(len(w) - 49):
            if len(seen[tuple(w[k:k + 50])]) > 1:
                cover |= set(range(k, k + 50))
        assert (got.n_repeated.get(i, 0)) == len(cover)
        assert not cover or cover == {x for p in got.passages[i] for x in range(p["start"], p["end"])}


SECRETS = [("assign", re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A), 2, 6),
           ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]


def base_spans(text):
    return sorted((m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(SECRETS) for m in p.finditer(text or "") if len(m.group(g)) >= least)


def test_secrets(spark, docs):
    got = run(spark, "op9_credential_links")
    for i, t in docs.text.items():
        told = ",".join(f"{SECRETS[k][0]}:{a}:{b}" for a, k, b in base_spans(t))
        assert got.base_sha256[i] == hashlib.sha256(told.encode()).hexdigest()


def test_secrets_link_parts(spark):
    common.ship(spark)
    key, access = "Ab3" * 8, "AKIA" + "Z" * 16
    texts = [f"id {access} then {key} at https://host.example/x \U0001F600 token=token =abcdef9", f"only {key} here", "x" * 400 + f" user: bob {key}",
             " ".join(f"token=abc{i:05d}" for i in range(200)), f"{access} {'y ' * 400} {key}"]
    got = {r["doc_id"]: r for r in rows_of(credentials.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))}
    for i, t in enumerate(texts):
        spans = sorted((s["start"], s["k"], s["end"]) for k in credentials.BASE for s in got[i][f"{k}_spans"])
        assert spans == base_spans(t)
    kinds = {i: sorted(credentials.KINDS[s["k"]] for s in r["linked"]) for i, r in got.items()}
    assert kinds == {0: ["address", "random"], 1: [], 2: ["login", "random"], 3: [], 4: []}


def test_quality(spark, docs):
    got = run(spark, "op10_quality_rules")
    for i, t in docs.text.items():
        w = WORD.findall(t)
        seen, cover, lines, dup = collections.Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4)), set(), set(), 0
        for k in range(len(w) - 4):
            if seen[tuple(w[k:k + 5])] > 1:
                cover |= set(range(k, k + 5))
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in lines
                lines.add(line)
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(cover))
        r = got.loc[i]
        assert tuple(r[["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]]) == want
        assert r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w)) and not (r.base_failed and r.kept)


def test_learned_rules_separate():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    bad = ((x[:, 0] > 0.8) & (x[:, 2] <= 0.5)) | (x[:, 3] > 0.95)
    rules = quality.learn(x, bad)
    said = np.any([quality._holds(x, r) for r in rules], axis=0)
    assert (said & ~bad).sum() <= 30 and (said & bad).sum() > 0.8 * bad.sum()
    assert quality.learn(x[:0], bad[:0]) == [] and quality.learn(x, np.zeros(3000, bool)) == []


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows_have_defined_results(spark, odd, empty):
    docs = odd.limit(0) if empty else odd
    n = 0 if empty else 12
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 0), (9, None)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, "word3x3 word4x4 word5x5 word6x6"), (None, "x"), (2, None), (3, "")], "item_id long, text string")
    found = {
        "shards": shards.shard_rows(docs), "mix": mixing.mix(docs), "language": language.identify(docs, docs.where("doc_id is not null")).select("doc_id", "found.*"),
        "prints": simhash.near_duplicates(docs), "lm": ngram_trie.score(docs, ngram_trie.fit(docs.select("text"))).select("doc_id", "lm.*"), "passages": suffixes.repeated(docs),
        "items": contamination.find_items(docs, items), "secrets": credentials.scan(docs), "quality": quality.judge(docs, labels),
    }
    import public_tokenizers

    found["tokens"] = token_files.read_tokens(token_files.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json")))
    got = {k: rows_of(v) for k, v in found.items()}
    assert {k: len(v) for k, v in got.items()} == dict.fromkeys(found, n)
    if not empty:
        assert {r["lang"] for r in got["language"] if r["doc_id"] in (2, 3, 4, 6)} == {"und"}
        assert all(r["n_tokens"] == 1 for r in got["tokens"] if r["doc_id"] in (2, 3, 4)) and all(r["size"] == 0 and r["copies"] is not None for r in got["mix"] if r["doc_id"] in (2, 3, 4))
        assert {r["component_id"] for r in got["prints"] if r["doc_id"] in (2, 3, 4)} == {2}
        assert [len(r["matches"]) > 0 for r in got["items"] if r["doc_id"] == 5] == [True]


@pytest.mark.parametrize("empty", [False, True])
def test_stages_keep_columns(spark, odd, empty, tmp_path):
    spark.createDataFrame([(1, "word3x3 word4x4 word5x5 word6x6")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = odd.limit(0) if empty else odd
    left = {}
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        left[name] = sorted(str(r["doc_id"]) for r in out.collect())
    if not empty:
        assert "2" not in left["language"] and left["near_duplicates"].count("1") == 1 and "5" not in left["decontamination"]


def test_last_stages_against_plain_python(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    copies = {r["doc_id"]: r["copies"] for r in rows_of(mixing.mix(frame))}
    mixed = stage(corpus_pipeline.mix_sources(spark, frame, FOLDER), "mixed")
    assert collections.Counter(r["doc_id"] for r in mixed.select("doc_id").collect()) == {i: n for i, n in copies.items() if n}
    got = corpus_pipeline.tokens(spark, mixed, FOLDER).toPandas().sort_values("start")
    at = 0
    for r in got.itertuples():
        ids = [*tokenizer.encode(docs.text[r.doc_id], add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == sum(copies.values())
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, frame, FOLDER).collect()}
    found = {r["doc_id"]: r["far"] for r in rows_of(language.identify(frame, frame.where(common.learns(4, 2)).select("doc_id", "text", "lang")).select("doc_id", "found.*"))}
    assert kept == {i for i, far in found.items() if not far}


def test_pipeline(spark):
    got = corpus_pipeline.run(spark, FOLDER).toPandas().sort_values("start")
    assert (got.start.iloc[1:].to_numpy() == (got.start + got.n_tokens).iloc[:-1].to_numpy()).all() and got.start.iloc[0] == 0
    assert got.doc_id.is_monotonic_increasing


def test_neighbours_of_suffixes_against_all_pairs():
    rng = np.random.default_rng(6)
    span, base = suffixes.SPAN - 1, 31
    for length in (50, 40):
        n = 300
        left, right = rng.integers(1, 3, (n, span)).astype(np.uint64), rng.integers(1, 3, (n, span)).astype(np.uint64)
        for k in range(1, n):  # most share much with one before
            j = int(rng.integers(0, k))
            a, b = rng.integers(0, span + 1, 2)
            left[k, :a], right[k, :b] = left[j, :a], right[j, :b]
        first = rng.integers(0, 4, n).astype(np.uint64)
        low = rng.integers(0, 40, n).astype(np.uint64)
        high = np.where(rng.random(n) < 0.1, low + np.uint64(1), low)
        have = rng.integers(0, span + 1, (n, 2))
        for k in range(n):  # no words beyond the ends of a text
            left[k, have[k, 0]:], right[k, have[k, 1]:] = 0, 0
        got = suffixes.neighbours(first, left, right, low, high, have, base, length)
        for k in range(n):
            reach = np.full(span + 1, -1)
            for j in range(n):
                if first[j] == first[k] and (low[k] != high[k] if j == k else low[j] != high[j] or low[k] != high[k] or low[j] != low[k]):
                    same = left[j] == left[k]
                    a = min(span if same.all() else int(same.argmin()), have[k, 0], span if j == k else have[j, 0])
                    same = right[j] == right[k]
                    b = min(span if same.all() else int(same.argmin()), have[k, 1])
                    reach[:a + 1] = np.maximum(reach[:a + 1], b)
            fits = [(w, base + r) for w, r in enumerate(reach) if r >= 0 and w + base + r >= length]
            assert (got[0][k], got[1][k]) == ((max(w for w, _ in fits), max(r for _, r in fits)) if fits else (0, 0))


def test_language_scores_a_megabyte_of_text_at_a_time(spark, monkeypatch):
    out, sizes = io.BytesIO(), []
    np.savez(out, **language.train({"a": {"ab": 3, "ba": 1}, "b": {"xy": 2}}))
    entropies = language.Scorer.entropies
    monkeypatch.setattr(language.Scorer, "entropies", lambda self, data, offsets: sizes.append(len(data)) or entropies(self, data, offsets))
    packed = type("Packed", (), {"value": out.getvalue()})
    got = [*language._udf(packed, {"beta": 1.0, "limit": [9.0, 9.0]}).func(iter([pa.array(["ab ba " * 1000, "xy " * 2000, None] * 300)]))]
    assert [len(x) for x in got] == [900] and got[0].field("lang").to_pylist()[:2] == ["a", "b"]
    assert sum(sizes) == 12_000 * 300 and max(sizes) <= language.PIECE == 1 << 20


def test_elias_fano_reads_mapped_arrays_as_plain_ones(tmp_path):
    rng = np.random.default_rng(5)
    for values in (np.arange(1000), np.sort(rng.integers(0, 1 << 40, 1000)), np.repeat(rng.integers(0, 300, 40).cumsum(), 25), np.zeros(1, np.int64)):
        made = ngram_trie.EliasFano.arrays(values.astype(np.uint64), "x")
        for k, v in made.items():
            np.save(tmp_path / k, v)
        ef = ngram_trie.EliasFano({k: np.load(tmp_path / f"{k}.npy", mmap_mode="r") for k in made}, "x")
        assert type(ef.low) is type(ef.high) is type(ef.zeros) is np.ndarray
        assert (ef[np.arange(len(values))] == values).all()
        bits = np.unpackbits(ef.high.view(np.uint8), bitorder="little")
        for ones in (True, False):
            want = np.flatnonzero(bits == ones)
            assert (ef._select(np.arange(len(want)), ones) == want).all()


def test_what_a_shard_gets_is_combined_by_ranges_of_keys():
    rng = np.random.default_rng(8)
    parts = [[k, k + np.uint64(1)] for k in (np.sort(rng.integers(0, top, n)).astype(np.uint64) for top, n in ((50, 3000), (10 ** 6, 9000), (1, 700), (10 ** 6, 1)))]
    pieces = [*common.by_range(parts, 2000)]
    own = [np.concatenate([p[0] for p in piece]) for piece in pieces]
    assert len(own) > 4 and all(a.max() < b.min() for a, b in zip(own, own[1:]))
    assert all(len(x) <= 2000 or len(np.unique(x)) == 1 for x in own)
    assert np.sort(np.concatenate(own)).tolist() == np.sort(np.concatenate([p[0] for p in parts])).tolist()
    assert all((a + np.uint64(1) == b).all() for piece in pieces for a, b in piece)
    assert len([*common.by_range(parts, 20_000)]) == 1


def test_trie_shares_out_frequent_contexts(spark):
    """The followers of a few frequent contexts, whose numbers lie together, don't meet in one shard."""
    rows = [{"shard": s, "n": 1000} | ngram_trie._runs(np.where(np.arange(1000) < 100, 900 if s == 3 else 1, 1)) for s in range(8)]
    begins = ngram_trie._begins(rows, 8)
    count = np.concatenate([np.where(np.arange(1000) < 100, 900 if s == 3 else 1, 1) for s in range(8)])
    seen = np.add.reduceat(count, begins[:-1])
    assert begins[0] == 0 and begins[-1] == 8000 and (np.diff(begins) > 0).all()
    assert seen.max() < 2.2 * count.sum() / 8 and np.diff(begins).max() <= 2 * 1000
    assert ngram_trie._begins([], 4).tolist() == [0] * 5 and ngram_trie._begins([{"shard": 2, "n": 1, "ends": [1], "upto": [5]}], 2).tolist()[-1] == 1
    common.ship(spark)
    texts = spark.createDataFrame([(" ".join(f"the w{i % 97} the x{i * j % 41}" for i in range(60)),) for j in range(40)], "text string").repartition(4)
    many, one = ngram_trie.fit(texts), ngram_trie.fit(texts.coalesce(1))
    assert len(many.levels[0][2]) == 5 and len(one.levels[0][2]) == 2
    for a, b in zip(many.levels, one.levels):
        assert sum(a[3].values()) == sum(b[3].values())
    assert ngram_trie.score(texts, many).select("lm.*").exceptAll(ngram_trie.score(texts, one).select("lm.*")).isEmpty()


def test_trie_packs_low_bits_in_pieces(monkeypatch):
    values = np.sort(np.random.default_rng(3).integers(0, 1 << 40, 1000)).astype(np.uint64)
    whole = ngram_trie.EliasFano.arrays(values, "x")
    sizes, pack = [], ngram_trie.pack_bits
    monkeypatch.setattr(ngram_trie, "PACKED", 64)
    monkeypatch.setattr(ngram_trie, "pack_bits", lambda v, width: sizes.append(len(v)) or pack(v, width))
    pieces = ngram_trie.EliasFano.arrays(values, "x")
    assert max(sizes) == 64 and sum(sizes) == 1000 and all((whole[k] == pieces[k]).all() for k in whole)


def test_trie_deals_the_followers_of_one_context_to_several_shards(spark):
    common.ship(spark)
    texts = spark.createDataFrame([(" ".join(f"the w{i * 40 + j} the w{i % 7}" for i in range(60)),) for j in range(40)], "text string").repartition(8)
    one = texts.coalesce(1)
    for least in (1, 2):
        many, whole = ngram_trie.fit(texts, least=least), ngram_trie.fit(one, least=least)
        for a, b in zip(many.levels, whole.levels):
            assert sum(a[3].values()) == sum(b[3].values())
        assert ngram_trie.score(texts, many).select("lm.*").exceptAll(ngram_trie.score(texts, whole).select("lm.*")).isEmpty()
    sizes = ngram_trie.fit(texts).levels[0][3]
    assert len(sizes) == 8 and max(sizes.values()) < 2.2 * sum(sizes.values()) / 8  # "the" has half of all pairs


def test_a_task_sends_rows_before_its_end(monkeypatch):
    rng = np.random.default_rng(4)
    parts = [ngram_trie._summed([rng.integers(0, 5000, 300).astype(np.uint64), np.ones(300, np.uint64)]) for _ in range(40)]
    for held, calls in ((100_000, 1), (1000, 2)):
        monkeypatch.setattr(common, "HELD", held)
        taken, at = [], []
        for shard, (key, count) in common.dealt((at.append(len(taken)) or p for p in parts), ngram_trie._summed, lambda key: key >> np.uint64(11)):
            assert (np.diff(key.astype(np.int64)) > 0).all() and (key >> np.uint64(11) == shard).all()
            taken.append((key, count))
        assert len(set(at)) >= calls and (held > 1000 or len(taken) > 20)
        key, count = ngram_trie._summed([np.concatenate(c) for c in zip(*taken)])
        want = ngram_trie._summed([np.concatenate(c) for c in zip(*parts)])
        assert (key == want[0]).all() and (count == want[1]).all()
