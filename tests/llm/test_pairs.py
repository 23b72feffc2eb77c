"""Near-duplicate operators against all pairs."""

import itertools
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import components, covertree, simhash, textspans

from .common import components as plain_components
from .common import corpus, frame, words


def fingerprint(text):
    w = words(text)
    shingles = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t\n　", max_size=80)), max_size=8), st.booleans())
def test_words_and_hashes(texts, squeeze):
    data, offsets = textspans.text_bytes(pa.array(texts, pa.string()))
    w = textspans.Words(data, offsets, squeeze=squeeze)
    want = [(r, x) for r, t in enumerate(texts) for x in words(t)]
    assert [(r, bytes(w.buf[s:e])) for r, s, e in zip(w.row, w.start, w.end, strict=True)] == want
    assert textspans.xxh64(w.buf, w.start, w.end - w.start).tolist() == [xxhash.xxh64_intdigest(x, 42) for _, x in want]


def test_long_spans_hash_alike():
    raw = bytes(range(256)) * 5 + bytes(textspans.PAD)
    size = np.arange(0, 1200, 7)
    got = textspans.xxh64(np.frombuffer(raw, np.uint8), np.full(len(size), 3), size, 9)
    assert got.tolist() == [xxhash.xxh64_intdigest(raw[3 : 3 + n], 9) for n in size]


def test_covering_family_misses_no_pair_within_the_radius():
    for second in (False, True):
        masks = [m % (1 << 64) for m in simhash.covering_masks(3, second=second)]
        assert len(masks) == 15
        rng = np.random.default_rng(0)
        for _ in range(3000):
            x = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
            assert any(x & m == 0 for m in masks)


def test_bucket_forest_connects_what_all_pairs_connect():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 2**63, 4, dtype=np.uint64)
    fp = np.unique(np.concatenate([c ^ np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(40)], np.uint64) for c in centre]))
    a, b = (np.searchsorted(fp, x) for x in simhash.bucket_edges(np.zeros((len(fp), 4), np.int64), fp, 3))
    near = [(i, j) for i, j in itertools.combinations(range(len(fp)), 2) if bin(int(fp[i] ^ fp[j])).count("1") <= 3]
    assert len(a) < len(fp) and plain_components(len(fp), zip(a, b, strict=True)) == plain_components(len(fp), near)


def test_simhash_groups(spark):
    rows = [r for r in corpus() if r[0] is not None]
    got = simhash.simhash_groups(frame(spark)).collect()
    prints = [fingerprint(r[1]) for r in rows]
    linked = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if bin(prints[i] ^ prints[j]).count("1") <= 3]
    label = plain_components(len(rows), linked)
    least = {c: min(r[0] for r, x in zip(rows, label, strict=True) if x == c) for c in label}
    assert sorted((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got if r.doc_id is not None) == sorted((r[0], p, least[c]) for r, p, c in zip(rows, prints, label, strict=True))
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    kept = simhash.first_of_groups(frame(spark))
    assert kept.columns == frame(spark).columns and sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [*((False, x) for x in sorted(least.values())), (True, None)]


def test_crowded_buckets_are_split(spark):
    rng = np.random.default_rng(8)
    centre = rng.integers(0, 2**63, 3, dtype=np.uint64)
    fp = np.unique(np.concatenate([c ^ np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(150)], np.uint64) for c in centre]))
    near = [(i, j) for i, j in itertools.combinations(range(len(fp)), 2) if bin(int(fp[i] ^ fp[j])).count("1") <= 3]
    classes = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    for large in (5, 4096):
        edges = simhash.near_edges(classes, large=large).collect()
        number = {int(x): k for k, x in enumerate(fp.view(np.int64))}
        assert plain_components(len(fp), [(number[e.a], number[e.b]) for e in edges]) == plain_components(len(fp), near)
    both = [m1 | m2 for m1 in simhash.covering_masks() for m2 in simhash.covering_masks(second=True)]
    assert min(bin(m % (1 << 64)).count("1") for m in both) >= 44


def test_simhash_of_nothing(spark):
    assert simhash.simhash_groups(frame(spark, [])).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 150)] + [(200, 200), (None, 3)]
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {k: 0 for k in range(31)} | {k: 100 for k in range(100, 150)}


@pytest.mark.parametrize("seed", [0, 1])
@pytest.mark.parametrize("dim", [3, 40])
def test_cover_tree_finds_all_pairs(seed, dim):
    rng = np.random.default_rng(seed)
    raw = np.concatenate([rng.normal(size=(150, dim)), rng.normal(size=(1, dim)) + 0.1 * rng.normal(size=(120, dim)), np.ones((1, dim)) + 0.001 * rng.normal(size=(80, dim))]).astype(np.float32)
    x, weight = covertree.unit(raw), rng.integers(1, 4, len(raw))
    near = x @ x.T >= 0.95
    tree = covertree.CoverTree(x)
    one = covertree.dual_traversal(tree, tree, weight, weight, 0.95, True)
    assert one.count.tolist() == (near * weight).sum(1).tolist()
    assert one.root(np.arange(len(x))).tolist() == plain_components(len(x), np.argwhere(near).tolist())
    left, right = covertree.CoverTree(x[:170]), covertree.unpack_tree(covertree.pack_tree(covertree.CoverTree(x[170:]), raw[170:], weight, weight))[0]
    two = covertree.dual_traversal(left, right, weight[:170], weight[170:], 0.95, False)
    assert two.count.tolist() == np.r_[(near[:170, 170:] * weight[170:]).sum(1), (near[:170, 170:] * weight[:170, None]).sum(0)].tolist()


@pytest.mark.parametrize("dim", [3, 40])
def test_forests_link_what_all_pairs_link(dim):
    rng = np.random.default_rng(5)
    raw = np.concatenate([rng.normal(size=(300, dim)), rng.normal(size=(1, dim)) + 0.1 * rng.normal(size=(150, dim)), np.ones((1, dim)) + 0.001 * rng.normal(size=(150, dim)), np.eye(dim)[:3]])
    x, weight = covertree.unit(raw[rng.permutation(len(raw))]), rng.integers(1, 4, len(raw))
    near = x @ x.T >= 0.95
    left, right = (covertree.Forest([covertree.CoverTree(x[a:b]) for a, b in itertools.pairwise(cut)]) for cut in ((0, 1, 120, 290), (290, 400, len(x))))
    basis = covertree.coordinates(x[:100])
    two = covertree.dual_traversal(left, right, weight[:290], weight[290:], 0.95, False, basis=basis)
    assert two.count.tolist() == np.r_[(near[:290, 290:] * weight[290:]).sum(1), (near[:290, 290:] * weight[:290, None]).sum(0)].tolist()
    one = covertree.dual_traversal(left, left, weight[:290], weight[:290], 0.95, True, lot=1 << 12, basis=basis)
    assert one.count.tolist() == (near[:290, :290] * weight[:290]).sum(1).tolist()
    assert one.root(np.arange(290)).tolist() == plain_components(290, np.argwhere(near[:290, :290]).tolist())


def test_a_traversal_costs_no_more_than_all_products():
    x = covertree.unit(np.random.default_rng(6).normal(size=(8192, 64)))
    left, right, one = covertree.CoverTree(x[:4096]), covertree.CoverTree(x[4096:]), np.ones(4096, np.int64)

    def least(run):
        took = []
        for _ in range(5):
            start = time.process_time()
            run()
            took.append(time.process_time() - start)
        return min(took)

    plain = least(lambda: np.flatnonzero(x[:4096] @ x[4096:].T >= 0.95))
    assert least(lambda: covertree.dual_traversal(left, right, one, one, 0.95, False)) < 1.5 * plain


def test_groups_of_blocks_meet(spark, monkeypatch):
    monkeypatch.setattr(covertree, "BLOCK", 16)
    monkeypatch.setattr(covertree, "GROUP_BYTES", 16 * 4 * 40 * 2)
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(200, 40)), rng.normal(size=(1, 40)) + 0.15 * rng.normal(size=(120, 40))]).astype(np.float32)
    got = covertree.vector_links(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()
    near = covertree.unit(x) @ covertree.unit(x).T >= 0.95
    label = plain_components(len(x), np.argwhere(near).tolist())
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(k, int(near[k].sum()) - 1, label[k]) for k in range(len(x))]


def test_cover_tree_levels_halve_and_cover():
    x = covertree.unit(np.random.default_rng(2).normal(size=(400, 3)))
    tree = covertree.CoverTree(x)
    for k, (points, _, cover, first, last) in enumerate(tree.levels):
        for p, c, a, b in zip(points, cover, first, last, strict=True):
            assert p in tree.order[a:b] and covertree.distances(x[p : p + 1], x[tree.order[a:b]]).max() <= c + covertree.SLACK
        if 0 < k < len(tree.levels) - 1:
            assert cover.max() <= 2.0 ** (2 - k) + covertree.SLACK
            apart = covertree.distances(x[points], x[points])
            assert apart[~np.eye(len(points), dtype=bool)].min() > 2.0 ** (1 - k) - covertree.SLACK
    for (above, *_), (points, parent, *_) in zip(tree.levels, tree.levels[1:], strict=False):
        assert (points[: len(above)] == above).all() and (parent[: len(above)] == np.arange(len(above))).all()
    assert sorted(tree.levels[-1][0].tolist()) == list(range(400))


def test_vector_links(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 5))
    rows = [(k, (base[k % 12] + (0.05 * rng.normal(size=5) if k >= 12 else 0)).tolist(), 0) for k in range(60)]
    rows += [(60, rows[0][1], 1), (61, None, 1), (62, [0.0] * 5, 1), (63, [1.0, float("nan"), 0.0, 0.0, 0.0], 1), (64, [1.0, None, 0.0, 0.0, 0.0], 1), (65, [], 1), (66, rows[1][1][:4], 1), (None, rows[0][1], 1), (67, [float("inf"), 0.0, 0.0, 0.0, 0.0], 1), (68, rows[2][1], 2), (68, rows[2][1], 2)]
    got = covertree.vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    good = [(i, np.array(v, np.float32)) for i, v, _ in rows if v and len(v) == 5 and None not in v and np.isfinite(v).all() and any(v)]
    x = covertree.unit(np.stack([v for _, v in good]))
    near = x @ x.T >= 0.95
    label = plain_components(len(good), np.argwhere(near).tolist())
    least = {c: min(good[k][0] for k in range(len(good)) if label[k] == c and good[k][0] is not None) for c in label}
    want = [(good[k][0], int(near[k].sum()) - 1, least[label[k]], good[k][0] == least[label[k]]) for k in range(len(good))]
    want += [(k, 0, k, True) for k in (61, 62, 63, 64, 65, 66, 67)]
    assert sorted(map(repr, got)) == sorted(f"Row(vec_id={w[0]}, n_links={w[1]}, component_id={w[2]}, kept={w[3]})" for w in want)


def test_vector_links_of_nothing(spark):
    assert covertree.vector_links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
