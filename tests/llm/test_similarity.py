"""Near-duplicates, repeated passages and vectors against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import components as cc
from tidemark.llm import minhash, subspace, suffix_dedup

RNG = random.Random(11)
VOCABULARY = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(3000)]


def corpus():
    """Random texts, copies, chains of edits around the bound, one large cluster, and odd ones."""
    out = [" ".join(RNG.choice(VOCABULARY) for _ in range(RNG.randint(3, 150))) for _ in range(80)]
    for base in out[:12]:
        words = base.split()
        for _ in range(6):
            words = [RNG.choice(VOCABULARY) if RNG.random() < 0.04 else w for w in words]
            out.append(" ".join(words))
    base = [RNG.choice(VOCABULARY) for _ in range(120)]
    for _ in range(120):
        rate = RNG.choice([0.0, 0.02, 0.05, 0.1])
        out.append(" ".join(RNG.choice(VOCABULARY) if RNG.random() < rate else w for w in base))
    out += [out[0], out[0].upper(), out[0].replace(" ", "\n\t"), "", None, " \n", "solo", "SOLO", "é a", "É a", "a b", "b a"]
    return out


def brute(texts, size, percent=80):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(zip(*(w[k:] for k in range(size)), strict=False)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    up = list(range(len(texts)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kept string")


@pytest.mark.parametrize(("size", "one_task"), [(2, 1_000_000), (5, 0)])
def test_components(spark, monkeypatch, size, one_task):
    monkeypatch.setattr(cc.components, "__defaults__", (one_task,))
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "BROADCAST_NODES", 0 if size == 5 else 1_000_000)
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", 0 if size == 5 else 1_000_000)
    monkeypatch.setattr(minhash, "BROADCAST_GRIDS", 0 if size == 5 else 1_000_000)
    texts = corpus()
    got = sorted(minhash.near_duplicates(frame(spark, texts), size).collect())
    assert [(r.n_shingles, r.component_id) for r in got] == brute(texts, size)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_buckets_in_parts_lose_nothing(spark, monkeypatch):
    import functools

    texts = corpus()[-140:]
    monkeypatch.setattr(minhash, "_grouped", functools.partial(minhash._grouped, rows=7))
    got = sorted(minhash.near_duplicates(frame(spark, texts), 2).collect())
    assert [r.component_id for r in got] == [c for _, c in brute(texts, 2)]


def test_one_document_of_each_group_stays(spark):
    texts = corpus()[:90] + [None, None, "", "solo", "solo"]
    kept = {r.doc_id for r in minhash.deduplicate(frame(spark, texts), 5).collect()}
    assert kept == {c for _, c in brute(texts, 5)}
    null = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f")], "doc_id long, text string")
    assert [r.doc_id for r in minhash.deduplicate(null).collect()] == [7]
    assert minhash.deduplicate(null.limit(0)).count() == 0 and minhash.near_duplicates(null.limit(0), 2).count() == 0
    assert [r.component_id for r in minhash.near_duplicates(null, 2).collect()] == [7] * 4


def removed(texts, n=suffix_dedup.LENGTH):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + n] for b in raw for i in range(len(b) - n + 1))
    out = []
    for b in raw:
        gone, end = bytearray(len(b)), 0
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[max(i, end) : i + n] = b"\1" * (i + n - max(i, end))
                end = i + n
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(v for v, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def passages():
    line = lambda n: "".join(RNG.choice("abcdefgh é\n") for _ in range(n))
    shared = [line(k) for k in (150, 199, 200, 201, 260, 700)]
    out = [line(RNG.randint(0, 900)) for _ in range(25)]
    for _ in range(60):
        out.append(line(RNG.randint(0, 300)) + RNG.choice(shared) + line(RNG.randint(0, 300)) + RNG.choice([*shared, ""]))
    out += [None, "", "x" * 199, "y" * 200, "z" * 201, "w" * 1500, "ab" * 400, out[0] * 2, out[30], out[30], line(199), line(200)]
    return out


@pytest.mark.parametrize(("group", "piece", "limit"), [(4096, 1 << 21, 1_000_000), (3, 700, 0)])
def test_repeats(spark, monkeypatch, group, piece, limit):
    texts = passages()
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_TEXTS", limit)
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int")
    got = suffix_dedup.remove_repeats(df, with_text=True).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == removed(texts)
    assert all(hashlib.sha256(bytes(r.kept_text)).hexdigest() == r.kept_sha256 for r in got)


def test_ranks_are_the_order_of_bytes():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    data[200:300] = data[:100]
    for length in (8, 13, 40, 200):
        rank = suffix_dedup.suffix_ranks(data, length)
        whole = [(bytes(data) + bytes(length))[i : i + length] for i in range(len(data))]
        names = {w: k for k, w in enumerate(sorted(set(whole) | {(bytes(data) + bytes(2 * length))[i : i + length] for i in range(len(data), len(data) + length)}))}
        assert np.argsort(rank, kind="stable").tolist() == np.argsort([names[w] for w in whole], kind="stable").tolist()
        assert [a == b for a, b in zip(rank, rank[1:], strict=False)] == [a == b for a, b in zip(whole, whole[1:], strict=False)]


def test_factors_against_all_pairs():
    rng = np.random.default_rng(4)
    group, rank, position = rng.integers(0, 3, 60), rng.integers(0, 9, 60).astype(np.uint64), rng.permutation(60)
    previous, following = suffix_dedup.long_factors(group, rank, position)
    for i in range(60):
        twins = [position[j] for j in range(60) if j != i and group[j] == group[i] and rank[j] == rank[i]]
        assert previous[i] == any(p < position[i] for p in twins) and following[i] == any(p > position[i] for p in twins)


def test_repeats_edges(spark):
    df = spark.createDataFrame([(None, "q" * 300), (None, "q" * 300)], "doc_id long, text string")
    assert [r.n_removed for r in suffix_dedup.remove_repeats(df).collect()] == [300, 300]
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize(("chunk", "d", "dense"), [(8192, 64, 4), (9, 64, 3), (8192, 10, 4), (9, 64, 10_000), (30, 10, 2)])
def test_vectors(spark, monkeypatch, chunk, d, dense):
    monkeypatch.setattr(subspace, "CHUNK", chunk)
    monkeypatch.setattr(subspace, "CELL", 2 * chunk)
    monkeypatch.setattr(subspace, "DENSE", dense)
    rng = np.random.default_rng(d + chunk)
    base = rng.normal(size=(60, d))
    near = base[:12].repeat(6, axis=0) + rng.normal(size=(72, d)) * rng.choice([0.05, 0.3, 0.45], size=(72, 1))
    rows = [v.tolist() for v in np.concatenate([base, near, base[:3], base[:1], base[:2] * 7])]
    rows += [None, [], [0.0] * d, [float("nan")] + [1.0] * (d - 1), [None] + [1.0] * (d - 1), [float("inf")] * d, [1.0], [1.0]]
    df = spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, n_links int")
    ok = [v is not None and len(v) > 0 and None not in v and bool(np.isfinite(v).all()) and any(v) for v in rows]
    unit = [np.array(v) / np.sqrt((np.array(v) ** 2).sum()) if k else None for v, k in zip(rows, ok, strict=True)]
    n = len(rows)
    linked = [[j for j in range(n) if j != i and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9 - 1e-12] for i in range(n)]
    label = list(range(n))
    while True:
        new = [min([label[i], *(label[j] for j in linked[i])]) for i in range(n)]
        if new == label:
            break
        label = new
    got = subspace.near_vectors(df).orderBy("vec_id").collect()
    assert [(r.n_links, r.component_id, r.kept) for r in got] == [(len(linked[i]), label[i], label[i] == i) for i in range(n)]
    assert subspace.near_vectors(df.limit(0)).count() == 0


def test_vectors_of_a_large_group_are_dealt_once(spark, monkeypatch):
    monkeypatch.setattr(subspace, "CHUNK", 50)
    monkeypatch.setattr(subspace, "CELL", 100_000)
    rng, count = np.random.default_rng(5), {}
    base, other = rng.normal(size=64), rng.normal(size=(40, 64))
    for n in (200, 800):
        x = np.concatenate([base + rng.normal(size=(n, 64)) * 0.05, other])
        nodes = spark.createDataFrame([(i, 1, 64, v.tobytes()) for i, v in enumerate(x)], "node long, weight long, dim int, vec binary")
        layouts = subspace.layouts_of(nodes, 0.9)
        count[n] = subspace.dealt(nodes, layouts).count()
        found = subspace._met(nodes, 0.9, layouts).groupBy("node").sum("links").collect()
        assert sorted(r[1] for r in found) == [n - 1] * n
    # Members of a ball that nobody visits are not sent at all; the others meet in four blocks.
    assert count[200] == count[800] == 160


def test_a_large_group_is_dealt_in_proportion_without_balls(spark, monkeypatch):
    monkeypatch.setattr(subspace, "DENSE", 10_000)
    nodes = spark.createDataFrame([(i, 1, 64, v.tobytes()) for i, v in enumerate(np.random.default_rng(6).normal(size=(2000, 64)))], "node long, weight long, dim int, vec binary")
    assert subspace.dealt(nodes, subspace.layouts_of(nodes, 0.9)).count() == 4 * 2000


def test_rotation_keeps_distances():
    x = np.random.default_rng(1).normal(size=(20, 48))
    y = subspace.rotate(x)
    assert np.allclose(((x[0] - x) ** 2).sum(1), ((y[0] - y) ** 2).sum(1))


def test_stars_and_union_find_agree(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (300, 100), (5, 5)] + [(1000, k) for k in range(1001, 1100)]
    nodes = spark.createDataFrame([(k,) for k in {x for e in links for x in e} | {9999}], "node long")
    df = spark.createDataFrame(links, "a long, b long")
    assert sorted(cc.components(nodes, df, 0).collect()) == sorted(cc.components(nodes, df).collect())
