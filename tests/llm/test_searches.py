"""Lexical search, fingerprints and whitening against plain code."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import edge_rows

from rentlens.llm import lexical, segments, whitening
from rentlens.llm.common import stored


def plain_ranking(docs: list[tuple], items: list[tuple], top: int) -> list[tuple]:
    cut = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    counted = [(i, Counter(cut(t))) for i, t in docs]
    n_docs = sum(bool(c) for _, c in counted)
    n_terms = sum(sum(c.values()) for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    out = []
    for item, text in items:
        scores = []
        for doc, counts in counted:
            m = 75 + (25 * sum(counts.values()) * n_docs) // n_terms if n_terms else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * counts[w]) // (1000 * counts[w] + 12 * m)) for w in cut(text) if counts[w])
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if none else doc, -score) for rank, (score, none, doc) in enumerate(sorted(scores)[:top], 1)]
    return out


def as_key(rows) -> list[tuple]:
    return sorted(tuple((x is not None, x or 0) for x in r) for r in rows)


@pytest.mark.parametrize("bucket, entries, block, first", [(1024, 1 << 21, 1 << 20, 1 / 64), (2, 40, 8, 0.5)])
def test_ranking_is_exact(spark, docs, nothing, monkeypatch, bucket, entries, block, first):
    for name, value in (("BUCKET", bucket), ("CHUNK_ENTRIES", entries), ("FIRST", first)):
        monkeypatch.setattr(lexical, name, value)
    random = np.random.default_rng(5)
    words = [f"t{int(x)}" for x in random.zipf(1.4, 4000) % 300]
    more = [(100 + k, " ".join(words[40 * k % 3900 : 40 * k % 3900 + 10 + 7 * (k % 9)])) for k in range(120)]
    rows = [r[:2] for r in edge_rows()] + more
    items = [(1, "a PASSAGE of some Length"), (2, None), (None, "word5x5 changed"), (3, "Grüße, 日本語のテキスト!"), (4, "none of these: qqq"), (5, " ".join(words[:60])), (6, "t1 t1 t2 t3 t9 t17"), (6, "t1 t1 t2 t3 t9 t17")]
    queries = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = lexical.ranked(frame, queries, 7, block)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert as_key(found.collect()) == as_key(plain_ranking(rows, items, 7))
    assert lexical.ranked(nothing, queries).count() == 0 and lexical.ranked(docs, queries.limit(0)).count() == 0
    assert lexical.ranked(nothing, queries).columns == found.columns


def test_buckets_are_skipped():
    """Of documents that share little with a query, none is scored once there is a threshold."""
    queries = lexical.Queries(np.array([0, 1]), np.array([1, 1]), np.array([0, 2]), np.array([1]), np.array([9000, 10, 5000]), np.array([8 * 10**9]))
    best, added = lexical.Best(queries, 2), []
    best.add = lambda *x: added.append(x)
    terms, parts, bounds = np.array([1, 2, 1]), np.array([900_000, 900_000, 900_000]), np.array([0, 2, 3])
    lexical.search_bucket(queries, best, np.array([1, 2]), np.array([4.6e9, 9e6]), terms, parts, bounds)
    assert not added
    lexical.search_bucket(queries, best, np.array([3]), np.array([8.2e9]), np.array([0]), np.array([910_000]), np.array([0, 1]))
    assert [x[2].tolist() for x in added] == [[3]] and added[0][1].tolist() == [9000 * 910_000]


def plain_print(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints: list[int]) -> list[int]:
    label = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2 and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    return label


@pytest.mark.parametrize("crowd", [64, 1])
def test_components_of_fingerprints(spark, docs, nothing, crowd):
    rows = [r[:2] for r in edge_rows()]
    found = segments.near_classes(docs, crowd)
    labels = plain_components([plain_print(t) for _, t in rows])
    least = {x: min((i for (i, _), y in zip(rows, labels, strict=True) if x == y and i is not None), default=None) for x in labels}
    want = [(i, f"{plain_print(t):016x}", least[x]) for (i, t), x in zip(rows, labels, strict=True)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(want, key=key)
    assert segments.near_classes(nothing).count() == 0


@pytest.mark.parametrize("crowd", [64, 3])
def test_no_link_of_fingerprints_is_lost(spark, crowd, tmp_path):
    """Random fingerprints, clusters of near ones, and a crowd whose counts of bits are all alike."""
    random = np.random.default_rng(3)
    base = [int(x) for x in random.integers(0, 1 << 63, 60, dtype=np.uint64)]
    near = [b ^ sum(1 << int(k) for k in random.integers(0, 64, n)) for b in base[:20] for n in (1, 2, 2, 3, 4)]
    crowded = [sum(1 << (4 * s + int(k)) for s, k in enumerate(random.integers(0, 4, 16))) for _ in range(120)]
    crowded += [c ^ 3 for c in crowded[:30]]
    prints = sorted({*base, *near, *crowded, 0, 1, 3, 7, (1 << 64) - 1})
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    links = segments.links_of(spark.createDataFrame([(x,) for x in signed], "print long"), str(tmp_path / "links"), crowd).collect()
    place = {x: k for k, x in enumerate(signed)}
    assert all((prints[place[a]] ^ prints[place[b]]).bit_count() <= 2 for a, b in links)
    label = list(range(len(prints)))
    for a, b in links:
        low, high = sorted((label[place[a]], label[place[b]]))
        label = [low if x == high else x for x in label]
    assert label == plain_components(prints)


def test_cells_are_never_broadcast(spark, tmp_path, monkeypatch):
    """Spark's estimate of the cells is that of the fingerprints, whatever mapInArrow makes of them."""
    plans = []
    monkeypatch.setattr(segments, "stored", lambda frame, path: plans.append(frame._jdf.queryExecution().executedPlan().toString()) or stored(frame, path))
    pairs = segments.links_of(spark.createDataFrame([(x,) for x in range(40)], "print long"), str(tmp_path / "links"))
    plans.append(pairs._jdf.queryExecution().executedPlan().toString())
    assert [p.count("SortMergeJoin") > 0 and "Broadcast" not in p for p in plans] == [True, True]


def plain_whitening(rows: list[tuple]) -> dict:
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows], np.int64)
    n, total = len(x), x.sum(0)
    centred = x - total / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    deviation = ((n * x - total) ** 2).sum(1)
    return {"x": x, "values": values[::-1], "vectors": vectors[:, ::-1], "deviation": deviation, "centred": centred}


def test_whitening_against_eigh(spark):
    random = np.random.default_rng(8)
    rows = [(k, [float(c) for c in v]) for k, v in enumerate((random.standard_normal((300, 40)) @ random.standard_normal((40, 40)) + 50).astype(np.float32))]
    bad = [(-1, None), (-2, [None] * 40), (-3, [float("nan")] * 40), (-4, [1.0, float("inf")] * 20), (-5, [1.0] * 39), (-6, [])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows + bad], "vec_id long, embedding array<float>, vector string").repartition(5)
    found = whitening.whitened(frame).collect()
    want = plain_whitening(rows)
    assert len(found) == 300 * 32 and {r.n for r in found} == {300}
    assert {r.vec_id: r.deviation for r in found} == dict(zip([i for i, _ in rows], want["deviation"].tolist(), strict=True))
    z = np.zeros((300, 32))
    for r in found:
        z[r.vec_id, r.component - 1] = r.whitened
        assert abs(r.explained - want["values"][r.component - 1] / want["values"].sum()) < 1e-9
        assert r.identity_error < 1e-9
    expected = want["centred"] @ want["vectors"][:, :32] / np.sqrt(want["values"][:32])
    assert np.abs(np.abs(z) - np.abs(expected)).max() < 1e-6
    assert np.abs(np.cov(z.T, bias=True) - np.eye(32)).max() < 1e-9


def test_whitening_of_few_equal_and_huge_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0])] * 4, schema)).count() == 0
    few = whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0, 0.5]), (None, [3.0, 1.0, 0.5]), (1, [1.0, 2.0, 0.5])], schema)).collect()
    assert sorted(r.component for r in few) == [1, 1, 1] and few[0].explained == pytest.approx(1) and few[0].identity_error < 1e-12
    huge = whitening.whitened(spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 0.5]), (3, [0.0, 4.0])], schema)).collect()
    assert {r.deviation for r in huge} == {None} or all(r.deviation is None or r.deviation >= 0 for r in huge)
    assert all(math.isfinite(r.whitened) for r in huge)


@pytest.mark.parametrize("spectrum", [np.linspace(1, 50, 40), np.logspace(0, -14, 60), np.ones(30), np.r_[np.full(10, 5.0), np.full(20, 1e-3)], np.array([0, 0, 0, 1, 2.0])])
def test_eigenvectors(spectrum):
    n = len(spectrum)
    basis, _ = np.linalg.qr(np.random.default_rng(n).standard_normal((n, n)))
    matrix = basis * spectrum @ basis.T
    values, vectors = whitening.eigenvectors((matrix + matrix.T) / 2)
    assert np.abs(values - np.sort(spectrum)[::-1]).max() < 1e-13 * spectrum.max() * n
    assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-13
    assert np.abs(vectors * values @ vectors.T - matrix).max() < 1e-13 * spectrum.max() * n
