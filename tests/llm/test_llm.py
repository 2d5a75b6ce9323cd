"""Each training-data operator against brute force, and on odd inputs."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkfolio.llm import alignment, ann, bpe, common, components, hashing, html, minhash, mixing, neardup, quality, sharding, substrings, suffixes

DOCS = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "é 😀 ß" * 3), (None, "no id"), (4, "one"), (4, "two words"), (9, "x" * 3000), (10, "a b " * 400)]


def corpus(seed=1, n=60):
    """Texts with exact and near copies, shared passages and shifts."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdeéß") for _ in range(draw.randint(1, 7)))
    passage = [word() for _ in range(70)]
    out = []
    for i in range(n):
        words = [word() for _ in range(draw.randint(0, 180))]
        if i % 4 == 0:
            at = draw.randint(0, len(words))
            words[at:at] = passage[draw.randint(0, 20) :]
        if out and i % 7 == 0:
            words = (out[draw.randrange(len(out))] or "").split()
            for _ in range(draw.randint(0, 4)):
                if words:
                    words[draw.randrange(len(words))] = word()
        out.append(" ".join(words))
    return list(enumerate(out))


# substrings


def brute_windows(docs, size=20):
    seen, out = set(), []
    for text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for i in range(len(words) - size + 1):
            key = tuple(words[i : i + size])
            if key in seen:
                gone[i : i + size] = [True] * size
            seen.add(key)
        out.append((len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g)))
    return out


def lost(row):
    return sum(s.end - s.start for s in row.removed)


@pytest.mark.parametrize("step", [500, 1 << 20])
def test_substrings(spark, monkeypatch, step):
    docs = corpus(2)
    got = {r.id: (r.n_words, lost(r), r.kept) for r in substrings.deduplicated(spark.createDataFrame(docs, DOCS).repartition(3)).collect()}
    assert [got[i] for i, _ in docs] == brute_windows([t for _, t in docs])


def test_substrings_odd(spark):
    docs = ODD + [(11, "a b " * 400), (12, "w" + " w" * 50)]
    rows = substrings.deduplicated(spark.createDataFrame(docs, DOCS)).collect()
    assert len(rows) == len(docs)
    order = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0, d[1] is not None, d[1] or ""))
    want = [(i, *w) for (i, _), w in zip(order, brute_windows([t for _, t in order]), strict=True)]
    assert sorted(map(repr, want)) == sorted(repr((r.id, r.n_words, lost(r), r.kept)) for r in rows)
    assert substrings.deduplicated(spark.createDataFrame([], DOCS)).collect() == []


def test_cleaned_keeps_columns(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text, "s", 7, 99), (2, "x  y", "s", 7, 4), (3, text, None, 7, 99)], "doc_id long, text string, source string, key int, n_chars long")
    rows = {r.doc_id: r for r in substrings.cleaned(df).collect()}
    assert [rows[i].text for i in (1, 2, 3)] == [text, "x  y", ""]
    assert (rows[3].n_chars, rows[3].key, rows[1].source, rows[3].source) == (0, 7, "s", None)


# suffixes


def brute_bytes(docs, size):
    raw = [(t or "").encode() for t in docs]
    count = collections.Counter(b[i : i + size] for b in raw for i in range(len(b) - size + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if count[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("length", [200, 40])
def test_suffixes(spark, length):
    docs = [*corpus(3, 40), (100, "ab" * 300), (101, "q" * 199), (102, "q" * 200), (103, None), (104, "")]
    rows = suffixes.deduplicated(spark.createDataFrame(docs, DOCS).repartition(3), length=length).collect()
    got = {r.id: (r.n_bytes, lost(r), len(r.removed), bytes(r.kept)) for r in rows}
    assert [got[i] for i, _ in docs] == brute_bytes([t for _, t in docs], length)


def test_suffixes_odd(spark):
    rows = suffixes.deduplicated(spark.createDataFrame([*ODD, (9, "x" * 3000)], DOCS)).collect()
    assert sorted(r.n_bytes - lost(r) for r in rows if r.id == 9) == [0, 0]
    assert len(rows) == len(ODD) + 1
    assert suffixes.deduplicated(spark.createDataFrame([], DOCS)).collect() == []


def test_loser_tree_merges_and_tells_shared_prefixes():
    draw = random.Random(4)
    runs = [sorted({bytes(draw.choices(b"ab\0", k=draw.randint(0, 6))) for _ in range(draw.randint(0, 30))}) for _ in range(5)]
    coded = []
    for run in runs:
        shared, rests = suffixes.front_coded(run)
        coded.append(suffixes.Run(shared, np.array([len(s) for s in run], np.uint16), rests))
    found = list(suffixes.merge(coded))
    assert [s for _, _, s, _ in found] == sorted(s for run in runs for s in run)
    for (_, _, a, _), (_, _, b, share) in zip(found, found[1:], strict=False):
        assert share == suffixes.common_prefix(a, b, 0)
    assert all(runs[r][i] == s for r, i, s, _ in found)


# near copies


def test_components(spark):
    draw = random.Random(5)
    edges = [(draw.randrange(80), draw.randrange(80)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(40)]
    own = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            own[a] = own[b] = min(own[a], own[b])
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {x: found.get(x, x) for x in own} == own
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_minhash(spark):
    docs = [d for d in corpus(6, 70) if len(d[1].split()) > 25]
    docs += [(500 + i, docs[0][1]) for i in range(20)] + [(600 + i, docs[1][1] + f" tail{i}") for i in range(20)]
    words = {i: t.split() for i, t in docs}
    own = {i: i for i in words}
    pairs = [(a, b) for a in words for b in words if a < b and min(map(len, (words[a], words[b]))) >= 0.8 * max(map(len, (words[a], words[b])))]
    links = [(a, b) for a, b in pairs if words[a] == words[b] or edits(words[a], words[b]) <= 0.2 * max(len(words[a]), len(words[b])) + 1e-9]
    for _ in range(8):
        for a, b in links:
            own[a] = own[b] = min(own[a], own[b])
    found = {r.id: r.class_id for r in minhash.classes(spark.createDataFrame(docs, DOCS)).collect()}
    assert found == own


def fixed_sketches(spark, monkeypatch, docs):
    """Classes of ``docs`` (id, text) where all sketches of a document are its first word."""

    def sketched(hashes, first, size=0, sketches=2):
        return np.repeat(hashes[first[:-1]][:, None], sketches, axis=1)

    monkeypatch.setattr(minhash, "sketched", sketched)  # goes to the workers with the closure
    return {r.id: r.class_id for r in minhash.classes(spark.createDataFrame(docs, DOCS), sketches=2).collect()}


def family(name, n=20):
    return [f"{name}{i}" for i in range(n)]


def test_minhash_bucket_of_many_families(spark, monkeypatch):
    texts = [" ".join(["b7", *family(name), tail]) for name in "pqrstu" for tail in "xy"]
    found = fixed_sketches(spark, monkeypatch, list(enumerate(texts, 1)))
    assert found == {i: i - 1 + i % 2 for i in range(1, 13)}


def test_minhash_round_without_links(spark, monkeypatch):
    texts = [" ".join(["b7", *family(name), tail]) for name, tail in ("px", "qx", "qy", "rx", "ry")]
    assert fixed_sketches(spark, monkeypatch, list(enumerate(texts, 1))) == {1: 1, 2: 2, 3: 2, 4: 4, 5: 4}


def test_minhash_links_of_a_leaders_class(spark, monkeypatch):
    # 1~2 and 2~3, but not 1~3: who is of the leader's class still meets the others
    w = ["b7", *family("p", 39)]
    two, three = w[:34] + family("q", 6), w[:28] + family("r", 6) + family("q", 6)
    assert fixed_sketches(spark, monkeypatch, [(i, " ".join(x)) for i, x in enumerate((w, two, three), 1)]) == {1: 1, 2: 1, 3: 1}


@pytest.mark.parametrize("low, high, least", [(0.8, 0.85, 0.98), (0.85, 0.9, 0.999), (0.9, 1.0, 1.0)])
def test_minhash_recall_by_similarity(low, high, least):
    draw, vocabulary = random.Random(12), [f"w{i}" for i in range(3000)]
    one, two = [], []
    for _ in range(1000):
        text = draw.choices(vocabulary, k=draw.randint(60, 300))
        edited = list(text)
        for at in draw.sample(range(len(text)), int((1 - draw.uniform(low, high)) * len(text))):
            edited[at] = draw.choice(vocabulary)
        one.append(" ".join(text))
        two.append(" ".join(edited))
    sketches = [minhash.sketched(*hashing.word_hashes(*hashing.text_buffer(pa.array(t)), 11)) for t in (one, two)]
    assert (sketches[0] == sketches[1]).any(axis=1).mean() >= least


def brute_classes(docs, links):
    own = {i: i for i, _ in docs}
    for _ in range(len(docs)):
        before = dict(own)
        for a, b in links:
            own[a] = own[b] = min(own[a], own[b])
        if own == before:
            return own


@pytest.mark.parametrize("block", [4096, 7])
def test_minhash_families_of_boilerplate(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    draw = random.Random(21)
    shared, docs = [f"b{i}" for i in range(140)], []
    for i in range(40):
        text = shared + [f"own{i}x{j}" for j in range(60)]
        docs.append((i, " ".join(text)))
        if i < 35:
            for at in draw.sample(range(200), 20):
                text[at] = f"new{i}x{at}"
            docs.append((100 + i, " ".join(text)))
    links = [(a, b) for n, (a, x) in enumerate(docs) for b, y in docs[:n] if alignment.banded(x.split(), y.split(), 40)]
    assert sum({a, b} == {i, 100 + i} for i in range(35) for a, b in links) == 35
    got = {r.id: r.class_id for r in minhash.classes(spark.createDataFrame(docs, DOCS).repartition(3)).collect()}
    assert got == brute_classes(docs, links)


def test_alignment():
    draw = random.Random(22)
    for _ in range(1500):
        letters = draw.choice([2, 3, 12])
        a = [draw.randrange(letters) for _ in range(draw.randint(0, 25))]
        b = [draw.randrange(letters) for _ in range(draw.randint(0, 25))] if draw.random() < 0.3 else list(a)
        for _ in range(draw.randint(0, 8)):
            at = draw.randint(0, len(b))
            b[at : at + draw.randint(0, 1)] = [draw.randrange(letters)] * draw.randint(0, 1)
        far = edits(a, b)
        for most in range(14):
            assert alignment.banded(a, b, most) == alignment.within(np.array(a, np.int64), np.array(b, np.int64), most) == (far <= most)
        values = np.array([x << 7 for x in (*a, *b)], np.uint64)
        bag = alignment.bags(values, np.array([0, len(a), len(a) + len(b)]))
        assert alignment.bag_distance(bag[:1], bag[1:])[0] <= far


def doubling(n):
    """Two words of ``n`` letters that hashes by sums of powers modulo 2**64 can't tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [512, 2048])
def test_words_of_complementary_doubling(spark, n):
    one, two = doubling(n)
    h, _ = hashing.word_hashes(*hashing.text_buffer(pa.array([f"{one} {two} {one}"])), 1)
    assert h[0] == h[2] != h[1]
    docs = [(i, " ".join([*family("p", 13), w, *family("q", 12)])) for i, w in enumerate((one, two, one))]
    got = {r.id: (r.n_words, lost(r), r.kept) for r in substrings.deduplicated(spark.createDataFrame(docs, DOCS)).collect()}
    assert [got[i] for i in range(3)] == brute_windows([t for _, t in docs])
    docs = [(i, "head " * 30 + w + " tail" * 30) for i, w in enumerate((one, two))]
    rows = suffixes.deduplicated(spark.createDataFrame(docs, DOCS)).collect()
    got = {r.id: (r.n_bytes, lost(r), len(r.removed), bytes(r.kept)) for r in rows}
    assert [got[i] for i in range(2)] == brute_bytes([t for _, t in docs], 200)


def test_string_classes_part_strings_of_one_hash(monkeypatch):
    monkeypatch.setattr(suffixes, "mix64", lambda x: np.zeros(len(x), np.uint64))  # all hashes agree
    draw = random.Random(23)
    data = bytes(draw.choice(b"ab") for _ in range(300))
    at, group = np.arange(290), np.repeat([0, 1], 145)
    same = suffixes.string_classes(np.frombuffer(data, np.uint8), at, group, 8).tolist()
    named = {}
    for i in range(290):
        assert named.setdefault(same[i], (group[i], data[i : i + 8])) == (group[i], data[i : i + 8])
    assert len(named) == len({(g, data[i : i + 8]) for i, g in zip(range(290), group.tolist(), strict=True)})


def test_long_text_is_hashed_in_pieces(monkeypatch):
    draw = random.Random(24)
    texts = [" ".join("w" * draw.randint(1, 30) + str(draw.randrange(50)) for _ in range(draw.choice([0, 3, 400]))) for _ in range(30)]
    whole = hashing.word_hashes(*hashing.text_buffer(pa.array(texts)), 1)
    monkeypatch.setattr(hashing, "PIECE_BYTES", 64)
    cut = hashing.word_hashes(*hashing.text_buffer(pa.array(texts)), 1)
    assert (whole[0] == cut[0]).all()
    assert (whole[1] == cut[1]).all()
    words = " ".join(texts).split()
    assert len(set(whole[0].tolist())) == len(set(words))


def test_minhash_odd(spark):
    rows = minhash.classes(spark.createDataFrame([*ODD, (20, ""), (21, "one"), (22, "a b " * 400 + "c")], DOCS)).collect()
    assert len(rows) == len(ODD) + 3
    classes = {(r.id, r.n_words): r.class_id for r in rows}
    assert classes[21, 1] == 4
    assert classes[20, 0] == 20
    assert classes[22, 801] == 10
    df = spark.createDataFrame([(1, "a b c", 5, "k"), (2, "a b c", 6, "k"), (2, "z", 7, None)], "doc_id long, text string, key int, row string")
    assert sorted((r.doc_id, r.text, r.key) for r in minhash.kept(df).collect()) == [(1, "a b c", 5), (2, "z", 7)]
    assert minhash.kept(df.limit(0)).count() == 0


# embeddings


def vectors(n=300, dims=24, seed=8):
    draw = np.random.default_rng(seed)
    x = draw.standard_normal((n, dims))
    x[50:80] = x[20] + 0.05 * draw.standard_normal((30, dims))
    x[100:110] = x[7]
    return x


def frame(spark, x, extra=()):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


BAD = [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [1.0] * 23 + [None]), (904, [float("inf")] * 24), (905, [1.0, 2.0]), (None, [1.0] * 24), (906, [])]


def test_neardup(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CELL", 40)
    x = vectors()
    got = {r.id: r for r in neardup.linked_rows(frame(spark, x, BAD), visits=6).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    own = np.arange(len(x))
    for _ in range(50):
        own = np.minimum(own, np.where(link, own, 1 << 40).min(axis=1))
    assert [got[i].n_links for i in range(len(x))] == link.sum(axis=1).tolist()
    assert [got[i].component_id for i in range(len(x))] == own.tolist()
    assert all(got[i].kept == (own[i] == i) for i in range(len(x)))
    for i, _ in BAD:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert neardup.linked_rows(frame(spark, x).limit(0)).collect() == []


def test_neardup_loses_no_link_at_many_cells(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CELL", 10)
    draw = np.random.default_rng(13)
    x = draw.standard_normal((1500, 64)) + 0.5 * draw.standard_normal((4, 64))[draw.integers(0, 4, 1500)]
    side = draw.standard_normal(x.shape)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    side -= (side * unit).sum(axis=1, keepdims=True) * unit
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    x = np.concatenate([unit, 0.901 * unit + np.sqrt(1 - 0.901**2) * side])  # each has a partner just over 0.9
    both = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = both @ both.T >= 0.9
    np.fill_diagonal(link, False)
    got = {r.id: r.n_links for r in neardup.linked_rows(frame(spark, x)).collect()}
    assert [got[i] for i in range(len(x))] == link.sum(axis=1).tolist()
    assert link.sum() >= len(x)


def test_ann(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 90)
    monkeypatch.setattr(ann, "CHUNK_QUERIES", 8)
    x = vectors()
    rows = ann.nearest(frame(spark, x, BAD), F.col("vec_id") % 20 == 0).collect()
    found = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append((r.id, r.score))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, len(x), 20):
        cosine = unit @ unit[q]
        order = [i for i in np.lexsort((np.arange(len(x)), -np.round(cosine, 12))).tolist() if i != q][:5]
        assert len(found[q]) == 5
        assert all(abs(s - cosine[i]) < 1e-9 for i, s in found[q])
        assert found[q] == sorted(found[q], key=lambda p: (-p[1], p[0]))
        hits += len({i for i, _ in found[q]} & set(order))
    assert hits >= 0.9 * 5 * len(found)
    assert [i for i, _ in found[100]] == [7, 101, 102, 103, 104]
    few = ann.nearest(frame(spark, x[:3]), F.col("vec_id") == 0).collect()
    assert sorted(r.id for r in few) == [1, 2]
    assert ann.nearest(frame(spark, x).limit(0), F.col("vec_id") == 0).collect() == []


def test_ann_probes_few_rows_where_neighbours_are_near():
    draw = np.random.default_rng(31)
    heads = draw.standard_normal((3000, 64))
    x = np.repeat(heads, 7, axis=0) + 0.15 * draw.standard_normal((21000, 64))
    coder = ann.fit(x[draw.permutation(len(x))[:8192]], 5)
    index, norms, unit = ann.Index(coder.codes(x)), np.sqrt((x * x).sum(axis=1)), x / np.linalg.norm(x, axis=1, keepdims=True)
    hits, probed, reranked = 0, 0, 0
    for q in range(0, 21000, 210):
        found, products, seen = ann._search(index, coder, x, norms, x[q], coder.codes(x[q : q + 1])[0], np.arange(len(x)) != q, 5)
        best = found[np.argsort(-products)[:5]]
        cosine = unit @ unit[q]
        cosine[q] = -2
        hits += len(set(best.tolist()) & set(np.argsort(-cosine)[:5].tolist()))
        probed, reranked = probed + seen, reranked + len(found)
    assert hits >= 0.9 * 500
    assert probed < 0.2 * 100 * len(x)
    assert reranked < 0.02 * 100 * len(x)


def test_ann_finds_all_codes_within_a_radius():
    draw = np.random.default_rng(32)
    codes = draw.integers(0, 1 << 63, 500, dtype=np.uint64) & draw.integers(0, 1 << 63, 500, dtype=np.uint64)
    seen: set[int] = set()
    for radius, rows in ann.Index(codes).grown(codes[7]):
        assert not seen & set(rows.tolist())
        seen |= set(rows.tolist())
        assert set(np.flatnonzero(ann.distances(codes, codes[7]) <= radius).tolist()) <= seen
    assert len(seen) == 500


def test_vectors_of_repeated_ids_and_dotted_names(spark):
    x = vectors(140)
    rows = [(i % 50, [float(v) for v in r], "k") for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string")
    dotted = df.toDF("vec.id", "the.vec", "id")
    for found in (ann.nearest(df, F.col("vec_id") < 3), ann.nearest(dotted, F.col("`vec.id`") < 3, id_col="vec.id", vec_col="the.vec")):
        got = found.collect()
        assert {r.query_id for r in got} == {0, 1, 2}
        assert all(r.id != r.query_id for r in got)
        assert collections.Counter(r.query_id for r in got) == dict.fromkeys(range(3), 5)
    same = [sorted(map(tuple, f.collect())) for f in (neardup.linked_rows(df), neardup.linked_rows(dotted, "vec.id", "the.vec"))]
    assert same[0] == same[1]
    assert len(same[0]) == 140


# quality


def test_quality(spark):
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7)))
    good = lambda: " ".join(word() for _ in range(80)).capitalize() + "."
    junk = [lambda: " ".join(word() + "###" for _ in range(80)), lambda: (word() + " ") * 80, lambda: " ".join(word().upper() + "!!" for _ in range(80))]
    docs = [(i, good() if i % 2 else junk[i % 3](), i % 2) for i in range(400)]
    df = spark.createDataFrame([(i, t, "extra") for i, t, _ in docs] + [(1000, None, None), (1001, "", None), (None, "x", None)], "doc_id long, text string, _label string")
    labels = spark.createDataFrame([(i, y) for i, _, y in docs if i < 200] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality.fit(df, labels, sample=60)
    assert len(model.labels) == 120
    got = {r.doc_id: r.s for r in quality.scored(df, model, name="s").collect()}
    assert sum((got[i] >= 0.5) == bool(y) for i, _, y in docs if i >= 200) >= 196
    assert all(0 <= s <= 1 for s in got.values())
    assert got[1000] == got[1001] == model.prior
    empty = quality.fit(df, labels.limit(0))
    assert {r.s for r in quality.scored(df, empty, name="s").collect()} == {0.5}
    assert quality.scored(df.limit(0), model, name="s").collect() == []
    assert quality.scored(df, model, name="text").columns == [*df.columns, "_text"]
    again = df.where("doc_id = 7").withColumn("text", F.explode(F.array([F.concat("text", F.lit(f" {i}")) for i in range(300)])))
    assert len(quality.fit(df.where("doc_id != 7").unionByName(again), labels, sample=60).labels) == 120
    votes = [r.s for r in quality.scored(df.where("doc_id < 20"), model, name="s").orderBy("doc_id").collect()]
    for (_, text, _), got_score in zip(docs[:20], votes, strict=True):  # the vote, one text at a time
        vector = model.project(quality.shares(quality.counts(*hashing.text_buffer(pa.array([text])))))[0].astype(float)
        cosine = [float(np.dot(vector, v.astype(float))) for v in model.vectors]
        best = sorted(range(120), key=lambda i: -cosine[i])[: quality.NEIGHBOURS]
        assert abs(sum(cosine[i] * model.labels[i] for i in best) / sum(cosine[i] for i in best) - got_score) < 1e-3


def test_quality_terms(monkeypatch):
    texts = ["a b a b", "", "xyz " * 50, "é" * 300, "one two"]
    whole = quality.counts(*hashing.text_buffer(pa.array(texts)))
    assert (whole[:, : quality.BINS].sum(axis=1) == [4, 0, 50, 1, 2]).all()
    assert (whole[:, quality.BINS : 2 * quality.BINS].sum(axis=1) == [max(len(t.encode()) - 3, 0) for t in texts]).all()
    monkeypatch.setattr(quality, "STEP_BYTES", 16)
    assert (quality.counts(*hashing.text_buffer(pa.array(texts))) == whole).all()


def test_quality_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = quality.query(spark, sf_dir).where("held_out").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    assert len(rows) > 50
    assert sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows)


# pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="no-sidebar"><nav><a href=/x>menu</a></nav>
<!-- c <p>no</p> --><div class="cookie-notice">eat</div><article><header><h1>Title &amp;&#33;</h1></header><p>One  <b>two<br><p>Three&nbsp;four<ul><li>a<li>b</ul>
<div class=ad>buy</div><section id="comments"><p>me too</p></section><form><input value="q"><button>go</button></form></article><aside>side</aside><footer>&copy; x</footer>"""


def test_html_marks():
    assert html.main_text(html.parsed(PAGE)) == "Title &!\nOne two\nThree four\na\nb"
    assert html.main_text(html.parsed("")) == ""
    assert html.main_text(html.parsed("just <i>te</i>xt < 3 <b")) == "just text < 3"
    assert html.main_text(html.parsed("<div>" * 5000 + "deep")) == "deep"
    assert html.main_text(html.parsed("<p>a</p><script>x")) == "a"
    assert html.main_text(html.parsed("<main><p>m</p></main><article><p>other</p></article>")) == "m"


BODY = "<p>" + "The article itself has a text of some length. " * 6 + "</p>"
KEPT = " ".join(["The article itself has a text of some length."] * 6)


@pytest.mark.parametrize(
    "page",
    [
        # reader comments as articles, within the main text and beside it
        f'<main>{BODY}<ol class="comment-list"><li class="comment even"><article id="div-comment-1" class="comment-body"><p>Nice post!</p></article></li></ol></main>',
        f'<article>{BODY}</article><section id="comments"><article class="comment-body"><p>Nice post, and a long answer to it. </p></article></section>',
        f'<main>{BODY}<article class="comment-body"><p>Nice post!</p></article></main>',
        # articles in sidebars, asides and lists of related posts
        f'<div class="sidebar"><article><p>Teaser</p></article></div><article>{BODY}</article>',
        f'<main>{BODY}<aside><article><p>Teaser</p></article></aside></main>',
        f'<article>{BODY}</article><section class="related-posts"><article><p>Teaser</p></article></section>',
        f'<main>{BODY}<section class="related-posts"><article><p>Teaser</p></article></section></main>',
        # a form around the page, with and without a marked main text
        f'<body><form id="aspnetForm"><div class="content">{BODY}</div></form></body>',
        f'<body><form id="aspnetForm"><nav>Home</nav><article>{BODY}</article><footer>2024</footer></form></body>',
        f'<body><nav>Home</nav><div class="content">{BODY}</div><form class="search"><label>Find</label></form><aside>More</aside></body>',
        f'<body><div class="content">{BODY}</div><aside><article><p>Teaser</p></article></aside></body>',
    ],
)
def test_main_text_beside_other_articles(page):
    assert html.main_text(html.parsed(page)) == KEPT


def test_all_articles_of_a_page_are_text():
    page = f"<div><article>{BODY}</article><section><article><p>Second, shorter.</p></article></section></div><nav><article>Menu</article></nav>"
    assert html.main_text(html.parsed(page)) == f"{KEPT}\nSecond, shorter."


def test_html_keeps_articles():
    text = lambda page: html.main_text(html.parsed(page))
    assert text('<div class="layout has-sidebar"><article><p>one</p></article></div>') == "one"
    assert text('<article><p>one</p><p class="share-price">two</p><p data-id="promo-1">three</p></article>') == "one\ntwo\nthree"
    assert text('<form id="page"><nav>menu</nav><main><p>one</p></main><main><p>two</p></main></form>') == "one\ntwo"
    assert text('<div class="widget"><p>all of the page is here</p></div><p>end</p>') == "all of the page is here\nend"
    assert text('<div id="sidebar"><main>body</main></div><div class="cookie-notice">eat</div>') == "body"
    assert text('<article><p>short</p><section class="comment-list"><p>a far longer remark by a reader</p></section><div class="x ad">buy</div></article>') == "short"
    assert text("<p>long " + "word " * 200_000 + "</p>").count("word") == 200_000


def brute_page(page):
    """The article's text by the standard library's parser, for pages that mark it."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.stack, self.lines, self.now = [], [], []

        def cut(self):
            if text := " ".join("".join(self.now).split()):
                self.lines.append(text)
            self.now = []

        def handle_starttag(self, tag, attrs):
            if tag == "br":
                self.handle_data(" ")
            if tag in html.BLOCK:
                self.cut()
            if tag not in html.VOID:
                self.stack.append((tag, dict(attrs).get("class") == "ad"))

        def handle_endtag(self, tag):
            if tag in html.BLOCK:
                self.cut()
            if any(t == tag for t, _ in self.stack):
                while self.stack.pop()[0] != tag:
                    pass

        def handle_data(self, data):
            tags = {t for t, _ in self.stack}
            if "article" in tags and not tags & html.NEVER and not any(ad for _, ad in self.stack):
                self.now.append(data)

    reader = Reader()
    reader.feed(page or "")
    reader.cut()
    return "\n".join(reader.lines)


def test_html_pages_against_another_parser(spark):
    rows = html.query(spark, "/root/testdata/sf0.001").collect()
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    assert len(rows) == len(pages)
    marked = [r for r in rows if "<article" in (pages[r.page_id] or "")]
    assert len(marked) > 0.5 * len(rows)
    assert [r.page_id for r in marked if r.text != brute_page(pages[r.page_id])] == []
    assert all(r.n_chars == len(r.text) for r in rows)


@pytest.mark.parametrize("most", [50_000, 0])
def test_html_templates_by_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(html, "BROADCAST_MOST", most)
    draw = random.Random(25)
    block = lambda: f"<div><p>{draw.choice('abcdef')} {draw.choice('xyz')}</p></div>"
    rows = [(i, f"http://h{draw.randrange(3)}.org/{i}", "<body>" + "".join(block() for _ in range(3)) + f"<p>own {i}</p></body>") for i in range(60)]
    hosts, seen = collections.Counter(), collections.Counter()
    for _, url, page in rows:
        host = url.split("/")[2]
        hosts[host] += 1
        seen.update({(host, b) for b in re.findall("<div>.*?</div>", page)})
    gone = {k for k, n in seen.items() if n >= 4 and n >= 0.3 * hosts[k[0]]}
    assert 0 < len(gone) < len(seen)
    want = {i: "\n".join([re.sub("<.*?>", "", b) for b in re.findall("<div>.*?</div>", page) if (url.split("/")[2], b) not in gone] + [f"own {i}"]) for i, url, page in rows}
    got = html.extracted(spark.createDataFrame(rows, "`page.id` long, url string, html string").repartition(4)).collect()
    assert {r["page.id"]: r.main_text for r in got} == want


def test_html_templates(spark):
    rows = [(i, f"http://Site.org/{i}", f"<body><div class=top><p>Our site</p></div><div><p>Own text {i}</p><p>Common words</p></div><div><p>Link list</p></div></body>") for i in range(10)]
    rows += [(20, "http://other.org/1", rows[0][2]), (21, None, None), (22, "odd", ""), (3, "http://site.org/3", rows[3][2])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, _template string")
    got = collections.defaultdict(list)
    for r in html.extracted(df).collect():
        got[r.page_id].append(r.main_text)
    assert got[4] == ["Own text 4"]
    assert got[3] == ["Own text 3"] * 2
    assert got[20] == ["Our site\nOwn text 0\nCommon words\nLink list"]
    assert got[21] == got[22] == [""]
    same = "<article><h1>Head</h1><p>Shared by all</p><div><ul><li>nav</li></ul></div></article>"
    again = spark.createDataFrame([(i, f"http://a.b/{i}", same) for i in range(6)], "page_id long, url string, html string")
    assert {r.main_text for r in html.extracted(again).collect()} == {"Head\nShared by all"}
    assert html.extracted(df.limit(0)).collect() == []


# BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(common.vocabulary_file("word_bpe_49k.json"))
    own.no_padding()
    own.no_truncation()
    return own


TEXTS = ["", "Hello, World's 42!", "a\x1cb \x85x", "ΑΣ ΟΔΟΣ", "<|endoftext|>hi<|startoftext|><|endoftext|>", "éa İx ǅ ﬁ ½ ٣", "x" * 5000, "ab" * 2000, "　 q​z", "😀👍🏽 ﻿\x00", "<|endoftext|", "don't we'LL " * 50]


def test_bpe_texts(library):
    own = bpe.Codec(common.vocabulary_file("word_bpe_49k.json"))
    for _ in range(2):
        for text, (n, ids, decoded) in zip(TEXTS, own.encode_texts(TEXTS), strict=True):
            want = library.encode(text, add_special_tokens=False).ids
            assert (n, ids) == (len(want), " ".join(map(str, want)))
            assert decoded == library.decode(want, skip_special_tokens=False) == own.decode(want)


def test_bpe_frame(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_MOST", 3)
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(TEXTS)] + [(None, None, None)], "doc_id long, text string, id string")
    for r in bpe.encoded(df).collect():
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(r.ids)
    assert bpe.encoded(df.withColumn("ids", F.lit(1))).limit(1).columns == [*df.columns, "ids", "n_tokens", "_ids", "decoded"]
    assert bpe.encoded(df.limit(0)).collect() == []


# mixing


def test_mixing(spark):
    draw = random.Random(11)
    docs = [(i, "abc"[i % 3] if i % 10 else "d", "w " * draw.randint(0, 60)) for i in range(900)] + [(1000 + i, None, "w w") for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    rows = mixing.mixed(df).collect()
    assert {tuple(r) for r in mixing.mixed(df.repartition(5)).collect()} == {tuple(r) for r in rows}
    sums = collections.defaultdict(lambda: [0, 0, 0.0, 0])
    for r in rows:
        assert r.mix_size == len(r.text.split())
        assert r.mix_taken == r.mix_copies * r.mix_size
        assert 0 <= r.mix_copies <= 3
        s = sums[r.source]
        s[0], s[1], s[2], s[3] = s[0] + r.mix_size, r.mix_source_size, r.mix_target, s[3] + r.mix_taken
    names = sorted(x for x in sums if x) + [None]
    weight = {x: 1 + i % 3 for i, x in enumerate(names)}
    total, capped = sum(s[0] for s in sums.values()), set()
    while True:
        rest = total - sum(3 * sums[x][0] for x in capped)
        free = sum(weight[x] for x in names if x not in capped)
        over = [x for x in names if x not in capped and rest * weight[x] / free > 3 * sums[x][0]]
        if not over:
            break
        capped |= set(over)
    assert capped
    for x in names:
        target = 3 * sums[x][0] if x in capped else rest * weight[x] / free
        assert sums[x][0] == sums[x][1]
        assert sums[x][2] == pytest.approx(target)
        assert abs(sums[x][3] - target) <= 60


def test_mixing_reruns_agree_with_repeated_ids(spark):
    draw = random.Random(26)
    docs = [(draw.choice([None, *range(40)]), draw.choice("ab"), "w " * draw.randint(0, 30)) for _ in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    mixes = [sorted(map(repr, mixing.mixed(df.repartition(n)).collect())) for n in (1, 7)]
    assert mixes[0] == mixes[1]


def test_mixing_odd(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "a", "x y"), (None, None, "z"), (2, "b", "")], "doc_id long, source string, text string")
    rows = mixing.mixed(df).collect()
    assert len(rows) == 4
    assert {(r.source, r.mix_size, r.mix_source_size) for r in rows} == {("a", 0, 2), ("a", 2, 2), (None, 1, 1), ("b", 0, 0)}
    assert mixing.mixed(df.limit(0)).collect() == []
    assert all(r.mix_taken == 0 for r in mixing.mixed(df.where("text IS NULL")).collect())
    more = df.withColumn("mix_copies", F.lit(7))
    assert mixing.mixed(more).columns[-2:] == ["_mix_copies", "_mix_taken"]
    again = mixing.repeated(mixing.mixed(more), more.columns)
    assert again.columns == more.columns
    assert {r.mix_copies for r in again.collect()} <= {7}


# shards


def test_sharding(spark, tmp_path):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    store = sharding.ShardedTable(spark, str(tmp_path / "t"), target_bytes=400_000, fanout=3, base_bytes=10_000)
    with pytest.raises(ValueError, match="no version"):
        store.read()
    for i in range(6):
        store.append(df.where(F.col("doc_id") % 6 == i).repartition(2))
    before = store.manifest()
    assert len(before["shards"]) == 12
    after = store.compact()
    assert len(after["shards"]) < 6
    assert max(s["bytes"] for s in after["shards"]) <= 600_000  # sizes add up nearly
    assert store.plan(after["shards"]) == []
    for version in (before["version"], None):
        found = store.read(version)
        assert found.count() == 4000
        assert found.exceptAll(df).count() == 0
    with pytest.raises(sharding.Conflict):
        store._commit(before, before["schema"], [])
    assert store.vacuum() == 12
    assert store.read().count() == 4000
    with pytest.raises(ValueError, match="columns"):
        store.append(df.select("doc_id"))
    store.append(df.limit(0))
    assert store.read().count() == 4000


def test_sharding_odd(spark, tmp_path):
    rows = [(None, None, 1), (1, "", 2), (1, "", 2), (2, "long " * 200_000, 3)]
    df = spark.createDataFrame(rows, "doc_id long, `te.xt` string, path int")
    store = sharding.ShardedTable(spark, str(tmp_path / "t"), fanout=2)
    for i in range(4):
        store.append(df.where(F.lit(i) < 2))
    store.compact()
    assert sorted(map(repr, map(tuple, store.read().collect()))) == sorted(map(repr, rows * 2))
    stray = store._written(df)
    assert store.sweep() == 0
    assert store.sweep(older_ms=0) >= len(stray)
    assert store.read().count() == 8


# the pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in pipeline.STAGES:
        docs = common.written(stage(spark, docs, sf_dir), "stage")
        seen[name] = docs
        if name != "encode":
            assert docs.columns == columns
    good, single, cut, mix, coded = (seen[n] for n, _ in pipeline.STAGES)
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert source.join(good, "doc_id", "left_anti").join(labels.where("quality = 1"), "doc_id").count() == 0
    assert good.join(labels.where("quality = 0"), "doc_id").count() == 0
    assert single.count() == single.select("text").distinct().count() < good.count()
    before = [(r.doc_id, r.text) for r in single.orderBy("doc_id").collect()]
    after = {r.doc_id: r.text for r in cut.collect()}
    for (i, text), (_, gone, kept) in zip(before, brute_windows([t for _, t in before]), strict=True):
        assert after[i] == (kept if gone else text)
    assert coded.count() == mix.count()
    assert {r.doc_id for r in mix.collect()} <= set(after)


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline as pipeline

    for name in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    out = pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "source", "n_tokens", "ids"]
    assert out.collect() == []
