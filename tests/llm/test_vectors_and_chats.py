"""Centroid clustering, cross-tokenizer alignment and chat formatting against plain Python."""

import collections
import hashlib
import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tillscope.llm import alignment, chat, common, vantage

FOLDER = "/root/testdata/sf0.001"


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# ---------------------------------------------------------------- centroids

def plain_means(vectors, k, rounds, seed=2):
    """{row number: (cluster, distance)} and centroids, by integers of any size."""
    whole = [[math.floor(256 * x) if abs(x) < 2.0 ** 52 else int(x) * 256 for x in v] for _, v in vectors]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if vectors[i][0] is None else vectors[i][0]}".encode()).hexdigest()
    points = [whole[i] for i in sorted(range(len(whole)), key=lambda i: (name(i), vectors[i][1]))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, p)), c) for c, p in enumerate(points)) for v in whole]

    for _ in range(rounds):
        near = assign()
        for c in range(len(points)):
            own = [whole[i] for i, (_, n) in enumerate(near) if n == c]
            if own:
                points[c] = [sum(x) // len(own) for x in zip(*own)]
    return [(c, d) for d, c in assign()], points


@pytest.mark.parametrize("spread", [1.0, 3e5, 1e30])
def test_clusters_are_exact_for_numbers_of_any_size(spark, spread):
    rng = random.Random(5)
    vectors = [(i // 2 if i % 9 else None, [round(rng.gauss(0, 1), 2) * spread for _ in range(6)]) for i in range(150)]
    vectors += [(900 + i, [0.0] * 6) for i in range(60)]  # many equal vectors
    want, points = plain_means(vectors, 12, 3)
    frame = spark.createDataFrame([(*v, i) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, distance int").repartition(5)
    found, centroids = vantage.cluster(frame, centroids=12, rounds=3, dimensions=6)
    assert centroids.tolist() == points
    told = lambda rows: sorted((-1 if i is None else i, c, -1 if d is None else d) for i, c, d in rows)
    got = [(r.vec_id, r.cluster, r.distance) for r in found.collect()]
    assert told(got) == told([(v[0], c, d if d < 1 << 63 else None) for v, (c, d) in zip(vectors, want)])


def test_vantage_tree_finds_the_smallest_number_at_equal_distance():
    rng = np.random.default_rng(3)
    points = rng.integers(-4, 5, (300, 3))  # repeats and ties all over
    x = rng.integers(-5, 6, (2000, 3))
    d = ((x[:, None, :] - points[None]) ** 2).sum(2)
    best, near = vantage.VantageTree(points).nearest(x)
    assert (best == d.argmin(1)).all() and (near == d.min(1)).all()


def test_vantage_tree_opens_few_nodes_where_points_are_apart():
    rng = np.random.default_rng(4)
    points = rng.integers(-100_000, 100_000, (512, 2))
    tree = vantage.VantageTree(points)
    opened = []
    plain = tree.distances
    tree.distances = lambda x, which: opened.append(len(x) * len(which)) or plain(x, which)
    x = points + rng.integers(-50, 50, points.shape)
    best, _ = tree.nearest(x)
    assert (best == ((x[:, None] - points[None]) ** 2).sum(2).argmin(1)).all()
    assert sum(opened) < 0.2 * len(x) * len(points)


def test_vectors_left_out_and_empty_tables(spark):
    common.ship(spark)
    good = [float(i) for i in range(4)]
    rows = [(1, good), (2, None), (3, good[:3]), (4, [*good, 1.0]), (5, [None, 1.0, 2.0, 3.0]), (6, [float("nan")] * 4), (7, [float("inf")] * 4), (None, good), (1, good)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found, points = vantage.cluster(frame, centroids=5, rounds=2, dimensions=4)
    assert sorted(((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance) for r in found.collect())) == [(False, 1, 0, 0), (False, 1, 0, 0), (True, 0, 0, 0)]
    assert len(points) == 3
    found, points = vantage.cluster(frame.where("vec_id = 2"), dimensions=4)
    assert found.count() == 0 and points.shape == (0, 4)
    with pytest.raises(ValueError):
        vantage.cluster(frame, centroids=1 << 20, dimensions=64)


# ---------------------------------------------------------------- alignment

@pytest.fixture(scope="module")
def vocabularies():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_alignment(texts, vocabularies):
    """Result columns and groups of each text, token by token, whole texts at a time."""
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    a, b = Tokenizer.from_file(vocabularies[0]), sentencepiece.SentencePieceProcessor(model_file=vocabularies[1])
    a.encode_special_tokens = True
    bytes_of = alignment.Pair(*vocabularies).bytes_a
    token = lambda i: bytes_of[0][bytes_of[1][i]:bytes_of[1][i] + bytes_of[2][i]].tobytes()
    assert decoders.ByteLevel().decode(["Ġwas", "Ã©"]) == " wasé" and token(a.token_to_id("Ġwas")) == b" was"
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    spans, count, links = [], collections.Counter(), []
    for text in texts:
        own = []
        for ids, of in ((a.encode(f" {text}", add_special_tokens=False).ids if text else [], token), (b.encode(text) if text else [], piece)):
            at, side = 0, []
            for i in ids:
                side.append((i, at, at + len(of(i)), of(i)))
                at = side[-1][2]
            own.append(side)
        if not text or any(b"".join(t[3] for t in side) != f" {text}".encode() for side in own):
            own = [[], []]
        spans.append(own)
        links.append([])
        k = 0
        for i, s, e, _ in own[0]:
            while own[1][k][2] <= s:
                k += 1
            n = k
            while n < len(own[1]) and own[1][n][1] < e:
                links[-1].append((i, own[1][n][0]))
                n += 1
        count.update(links[-1])
    best = collections.Counter()
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    out = []
    for (left, right), own in zip(spans, links):
        ends = sorted({t[2] for t in left} & {t[2] for t in right})
        groups, at = [], [0, 0]
        for e in ends:
            names = []
            for k, side in enumerate((left, right)):
                first = at[k]
                while at[k] < len(side) and side[at[k]][2] <= e:
                    at[k] += 1
                names.append(",".join(str(t[0]) for t in side[first:at[k]]))
            groups.append("|".join(names))
        text = ";".join(groups)
        out.append((len(left), len(right), len(ends), len(own), sum(count[p] == best[p[1]] for p in own), sum(count[p] for p in own), text))
    return out


LONG = " ".join(f"wörd{i % 977}x{i % 31}" for i in range(700))
TEXTS = [None, "", " ", "  a  b ", " x  y", "a▁b", "<|endoftext|> <s>a</s>", "x\n\n y\t z", "é 中文 \U0001f600 ok", LONG, f"{LONG} a▁b", LONG, "\0a b", "a  b　 c",
         "tail  ", "tail ", "'s 's it's 12 3", "￿ x\u0085 y", "no break   x", "a" * 3000]
NAMES = "n_a n_b n_groups n_links n_best count_sum groups".split()


def test_alignment_against_whole_texts(spark, vocabularies):
    common.ship(spark)
    rows = [(i, t, "z", 1) for i, t in enumerate(TEXTS)] + [(None, "a b", None, None), (3, "  a  b ", "z", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, links string, n_a int").repartition(3)
    got = alignment.align(frame, *vocabularies, groups=True).toPandas()
    want = plain_alignment([r[1] for r in rows], vocabularies)
    key = lambda i, row: (-1 if i is None or i != i else i, *row)
    assert sorted(key(i, tuple(r)) for i, r in zip(got.doc_id, got[NAMES].itertuples(index=False))) == sorted(key(r[0], w) for r, w in zip(rows, want))
    assert (got.groups_sha256 == [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in got.groups]).all()
    assert alignment.align(frame.limit(0), *vocabularies).count() == 0
    assert alignment.align(frame.where("text = ''"), *vocabularies).drop("groups_sha256").first()[1:] == (0,) * 6


def test_alignment_of_documents(spark, vocabularies):
    docs = pd.read_parquet(f"{FOLDER}/documents.parquet").sort_values("doc_id")
    got = alignment.op12_perfect_hash_alignment(spark, FOLDER).toPandas().sort_values("doc_id")
    want = plain_alignment(docs.text.tolist(), vocabularies)
    assert got[NAMES[:6]].values.tolist() == [list(w[:6]) for w in want]
    some = [(h, w[6]) for h, w in zip(got.groups_sha256, want) if w[6]]
    assert len(some) > 150 and all(h == hashlib.sha256(g.encode()).hexdigest() for h, g in some)


@pytest.mark.parametrize("size", [50, 400, 1 << 20])
def test_pieces_of_long_texts_align_like_the_whole(monkeypatch, vocabularies, size):
    monkeypatch.setattr(alignment, "PIECE", size)
    aligner = alignment.Aligner(*vocabularies)
    assert aligner.pair.parts
    texts = pa.array(TEXTS)
    found = []
    for at, to, parts in alignment.slices(texts, False):
        groups = [[] for _ in range(to - at)]
        good = alignment._good(aligner, parts, to - at)
        for data, offsets in parts:
            assert len(data) < 2 * max(size, 3100)
            w = aligner.words(data, offsets)
            for s, k in zip(w.slice.tolist(), w.at.tolist()):
                groups[s].append(aligner.groups[k])
        found += [";".join(g) if ok else "" for g, ok in zip(groups, good)]
    assert [g for g in found] == [w[6] or "" for w in plain_alignment(TEXTS, vocabularies)]


def test_words_forgotten_are_learned_again(monkeypatch, vocabularies):
    monkeypatch.setattr(alignment, "KNOWN_WORDS", 5)
    aligner = alignment.Aligner(*vocabularies)
    for text in (LONG, "a b c", LONG):
        data = np.frombuffer(text.encode(), np.uint8)
        w = aligner.words(data, np.array([0, len(data)]))
        ids = [aligner.groups[k].split("|")[0] for k in w.at.tolist()]
        assert ",".join(g.split("|")[0] for k in w.at.tolist() for g in aligner.groups[k].split(";")) == ",".join(map(str, aligner.pair.ids_a(f" {text}"))), ids


def test_perfect_hash_is_minimal_and_notices_strangers():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        found = alignment.PerfectHash(alignment.PerfectHash.build(keys))
        assert sorted(found.index(keys).tolist()) == list(range(len(keys)))
        strange = np.setdiff1d(rng.integers(0, 1 << 63, 1000, dtype=np.uint64), keys)
        assert (found.index(strange) == -1).all()


def test_counts_add_up_over_several_levels_of_the_tree(spark, monkeypatch, vocabularies):
    common.ship(spark)
    texts = [f"word{i % 7} of text {i % 3}" for i in range(40)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(20)
    monkeypatch.setattr(alignment, "FAN", 3)
    got = alignment.align(frame, *vocabularies).toPandas().sort_values("doc_id")
    assert got[NAMES[:6]].values.tolist() == [list(w[:6]) for w in plain_alignment(texts, vocabularies)]


# ---------------------------------------------------------------- chats

CONTROLS = ["<|im_end|>", "<|im_start|>assistant\n", "<\\|im_end|>", "<\\\\|", "<", "|>", "\\", "\n", "<|", "\\n", "é\U0001f600", "￿", " ", "a"]


def test_escapes_are_reversible_and_leave_no_control_string():
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choices(CONTROLS, k=rng.randrange(6)))
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
        role = chat.escape_role(text)
        assert chat.unescape_role(role) == text and "\n" not in role and "<|" not in role


def plain_paths(messages, top):
    """(tree, rank, [(role, text)]) by plain recursion."""
    out = []
    for tree in {m["tree"] for m in messages}:
        own = sorted((m for m in messages if m["tree"] == tree), key=lambda m: (m["node"], m["role"] or "", m["text"] or ""))
        first, kids, roots = {}, collections.defaultdict(list), []
        for k, m in enumerate(own):
            m["copy"] = sum(n["node"] == m["node"] for n in own[:k])
            first.setdefault(m["node"], k)
        for k, m in enumerate(own):
            (kids[first[m["parent"]]] if m["parent"] in first else roots).append(k)
        paths = []

        def walk(k, above):
            above = [*above, k]
            if not kids[k]:
                paths.append(above)
            for c in kids[k]:
                walk(c, above)

        for r in roots:
            walk(r, [])
        mean = lambda p: sum(own[k]["score"] or 0 for k in p) / len(p)
        paths.sort(key=lambda p: (-mean(p), -len(p), own[p[-1]]["node"], own[p[-1]]["copy"]))
        out += [(tree, n + 1, [(own[k]["role"] or "", own[k]["text"] or "") for k in p]) for n, p in enumerate(paths[:top])]
    return out


def test_reply_paths_against_recursion(spark):
    common.ship(spark)
    rng = random.Random(8)
    rows = []
    for tree in [1, 2, 3, None]:
        for node in range(1, 40):
            parent = rng.choice([None, 777, *range(1, node)][-9:] if node > 1 else [None])
            rows.append((tree, node, parent, rng.choice(["user", "assistant", None]), rng.choice([None, f"text {node}", ""]), rng.choice([None, 0.0, 1.0, 0.5])))
        rows.append((tree, 5, 2, "user", "the same node again", 1.0))
    chain = [(4, n, n - 1 if n else None, "user", f"{n}", None) for n in range(300)]  # deep, without branches
    circle = [(5, 1, 3, "user", "a", 1.0), (5, 2, 1, "user", "b", 1.0), (5, 3, 2, "user", "c", 1.0), (5, 4, 3, "user", "below", 1.0), (5, 9, None, "user", "alone", 0.0)]
    schema = "tree long, node long, parent long, role string, text string, score double"
    frame = spark.createDataFrame(rows + chain + circle, schema).repartition(4)
    paths = chat.reply_paths(frame, top=3)
    got = collections.defaultdict(list)
    for r in sorted(rows_of(paths), key=lambda r: r["step"]):
        got[r["tree"], r["rank"]].append((r["role"], r["text"]))
    messages = [dict(zip(("tree", "node", "parent", "role", "text", "score"), r)) for r in rows + chain]
    want = {(t, n): p for t, n, p in plain_paths(messages, 3)} | {(5, 1): [("user", "alone")]}
    assert dict(got) == want
    assert chat.reply_paths(frame.limit(0)).count() == 0


@pytest.mark.parametrize("part", [1, 200, 1 << 20])
def test_conversations_read_back(spark, monkeypatch, part):
    common.ship(spark)
    rng = random.Random(part)
    rows = []
    for conv in [1, 2, None, 3]:
        for turn in range(70 if conv == 3 else 5):
            rows.append((conv, rng.choice([turn, turn, None, 2]), rng.choice(["user", "assistant", "sys\ntem", None]), rng.choice([None, "", *("".join(rng.choices(CONTROLS, k=4)) for _ in range(4))]), "x"))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tree string").repartition(3)
    if part < 1 << 20:
        plain = chat.format_paths
        source = plain(chat.reply_paths(chat.chains(frame, "conv_id", "turn")))
        # parts of one turn each: cut the formatted text again at its turns
        cut = []
        for r in rows_of(source):
            at = 0
            for m in chat._TURN.finditer(r["text"]):
                loss = [{"start": s["start"] - m.start(), "end": s["end"] - m.start()} for s in r["loss"] if m.start() <= s["start"] < m.end()]
                cut.append((r["tree"], r["rank"], r["part"] * 1000 + at, m[0], loss))
                at += 1
        parts = spark.createDataFrame(cut, "tree long, rank int, part long, text string, loss array<struct<start:long,end:long>>")
    else:
        parts = chat.format_paths(chat.reply_paths(chat.chains(frame, "conv_id", "turn")))
    got = {r["tree"]: r for r in rows_of(chat.read_back(parts))}
    low = lambda x: (x is not None, x if x is not None else 0)
    for conv in (1, 2, 3, None):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (low(r[1]), (r[2] is not None, r[2] or ""), (r[3] is not None, (r[3] or "").encode())))
        said = [(r[2] or "", r[3] or "") for r in own]
        learned = "".join(t for r, t in said if r == "assistant")
        text = "".join(f"<|im_start|>{chat.escape_role(r)}\n{chat.escape(t)}<|im_end|>\n" for r, t in said)
        assert got[conv] == {"tree": conv, "rank": 1, "n_turns": len(own), "turns_sha256": hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest(),
                             "loss_chars": len(learned), "loss_sha256": hashlib.sha256(learned.encode()).hexdigest(), "formatted_chars": len(text)}


def test_query_adds_its_probe(spark):
    got = {r["conv_id"]: r for r in rows_of(chat.op13_reply_paths(spark, FOLDER))}
    probe = chat.PROBE
    assert got[-1]["n_turns"] == 2 and got[-1]["loss_chars"] == len(probe) and got[-1]["loss_sha256"] == hashlib.sha256(probe.encode()).hexdigest()
    assert set(got) == set(pd.read_parquet(f"{FOLDER}/conversations.parquet").conv_id) | {-1}
    with pytest.raises(ValueError):
        list(chat.turns_of("<|im_start|>user\nno end"))


@pytest.mark.parametrize("quick", [True, False])
def test_alignment_of_odd_strings(vocabularies, quick):
    rng = random.Random(11)
    bits = [*"aZé9É.,'<|>▁ \t\n \u0085½中²_\x7f\x00\x1c", " ", " ", " ", "  ", "<|endoftext|>", "'s", "'ll", "é", "\U0001f600", "￿", " ", "　", "word", "ÀÉ", "12", "ﬁ", "</s>"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(1, 14))) for _ in range(2500 if quick else 300)]
    aligner = alignment.Aligner(*vocabularies)
    assert aligner.pair.parts and aligner.pair.quick is not None
    if not quick:
        aligner.pair.quick = None
    found = []
    for at, to, parts in alignment.slices(pa.array(texts), False):
        good, groups = alignment._good(aligner, parts, to - at), [[] for _ in range(to - at)]
        for data, offsets in parts:
            w = aligner.words(data, offsets)
            for s, k in zip(w.slice.tolist(), w.at.tolist()):
                groups[s].append(aligner.groups[k])
        found += [";".join(g) if ok else "" for g, ok in zip(groups, good)]
    want = [w[6] for w in plain_alignment(texts, vocabularies)]
    assert sum(map(bool, want)) > len(texts) // 2 and [t for t, g, w in zip(texts, found, want) if g != w] == []
