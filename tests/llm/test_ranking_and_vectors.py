"""Pair ranking, whitening and hard negatives against brute force and held-out labels, over nulls, ties, repeats, empty tables and odd names."""

import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadweave.llm import hard_negatives, pair_ranking, queries, whitening

DATA = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<double>, label int"


def plain_negatives(rows, positives=5, negatives=10):
    """All with all, in Python integers."""
    kept = []
    for vec_id, v, label in rows:
        if v is None or label is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        kept.append((vec_id, [math.floor(256 * c) for c in v], label))
    out, key = [], lambda i: (i is None, i or 0)
    for a, (anchor, v, label) in enumerate(kept):
        if anchor is None or anchor % 100:
            continue
        scores = [min(max(sum(x * y for x, y in zip(v, w, strict=True)), -(2**63)), 2**63 - 1) for _, w, _ in kept]
        own = sorted((-scores[j], key(kept[j][0]), j) for j in range(len(kept)) if j != a and kept[j][2] == label)[:positives]
        for p, _, j in own:
            other = sorted((-s, key(kept[k][0]), k) for k, s in enumerate(scores) if kept[k][2] != label and -30 * p <= 100 * s <= -90 * p)[:negatives]
            out += [(anchor, kept[j][0], r, kept[k][0], -p, -s) for r, (s, _, k) in enumerate(other, 1)]
    return sorted(out, key=str)


def mined(spark, rows):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives.mine(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 100 == 0, label)
    return sorted((tuple(r)[:6] for r in found.collect()), key=str)


def odd_vectors(seed, n, d, step=8.0, hot=0.4):
    """Coarse entries, so that scores tie; a label of many rows; repeated ids and rows; nulls of all kinds."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        v = (rng.integers(-4, 12, d) / step).tolist()
        rows.append((int(rng.integers(0, 4) * 100) if k % 9 == 0 else k, v, 3 if rng.random() < hot else int(rng.integers(0, 4))))
    rows += rows[:30] + [(None, rows[1][1], 3), (None, rows[2][1], 1), (700, None, 1), (701, [None, *rows[0][1][1:]], 1), (702, [float("nan"), *rows[0][1][1:]], 2), (703, [float("-inf"), *rows[0][1][1:]], 2), (800, rows[3][1], None), (900, [0.0] * d, 3)]
    return rows


def test_strassen_is_exact():
    rng = np.random.default_rng(1)
    for m, k, n in ((1, 1, 1), (33, 65, 70), (64, 128, 67), (130, 71, 90), (5, 200, 3)):
        for bound in (200, 2**29, 2**45):
            a, b = rng.integers(-bound, bound, (m, k)), rng.integers(-bound, bound, (k, n))
            assert (hard_negatives.product(a, b) == a.astype(object) @ b.astype(object)).all()


def test_hard_negatives_equal_brute_force(spark, monkeypatch):
    for n, d, tile in ((260, 6, 4096), (260, 70, 40)):
        monkeypatch.setattr(hard_negatives, "TILE_ROWS", tile)
        monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 16)
        monkeypatch.setattr(hard_negatives, "LANE_TILES", 3)
        rows = odd_vectors(n + d, n, d)
        assert mined(spark, rows) == plain_negatives(rows)
    vast = [(100 * k if k % 3 == 0 else k, [2.0 ** (22 + k % 5), float(k), 1.0], k % 2) for k in range(40)] + [(1, [1.0, 2.0, 3.0], 0)]
    assert mined(spark, vast) == plain_negatives(vast)
    assert mined(spark, []) == [] and mined(spark, [(100, [1.0], 1)]) == [] and mined(spark, [(100, [], 1), (101, [], 1)]) == []


def test_hard_negatives_of_repeated_anchors_are_told_apart(spark):
    rows = [(100, [1.0, 0.0], 1), (100, [0.0, 1.0], 1), *[(k, [1.0 - k / 50, k / 50], k % 2) for k in range(1, 40)]]
    found = hard_negatives.mine(spark.createDataFrame(rows, VECTORS), F.col("vec_id") == 100, F.col("label")).collect()
    assert len({(r["anchor_mark"], r["positive_rank"], r["rank"]) for r in found}) == len(found) > 0


def plain_whitening(rows):
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in rows]
    fit = np.array(sorted(set(map(tuple, x))), object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = ((n * fit - sums) / n).astype(float)
    e, v = np.linalg.eigh(centred.T @ centred / n)
    deviation = [sum((n * c - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x]
    return n, deviation, np.array([[(n * c - s) / n for c, s in zip(r, sums, strict=True)] for r in x], float), e[::-1], v[:, ::-1]


def whitened(spark, rows, **more):
    return whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, x long, v string"), **more).collect()


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    v = (rng.normal(size=(300, 20)) * np.linspace(3, 0.5, 20) + 1000).tolist()
    v += v[:100] + [v[7]] * 200  # one vector is a third of all rows
    rows = [(k // 2, x, 1, "a") for k, x in enumerate(v)] + [(None, v[0], 2, None), (1, None, 0, ""), (2, [None, *v[0][1:]], 0, ""), (3, [float("inf"), *v[0][1:]], 0, "")]
    n, deviation, centred, e, directions = plain_whitening([*v, v[0]])
    got = whitened(spark, rows)
    assert len(got) == 16 * len(deviation) and {r["n"] for r in got} == {n} == {300} and len({r["identity_error"] for r in got}) == 1
    assert got[0]["identity_error"] < 1e-10
    assert sorted(int(r["deviation"]) for r in got if r["component"] == 1) == sorted(deviation)
    for k in range(16):
        own = [r for r in got if r["component"] == k + 1]
        assert all(abs(r["explained"] - e[k] / e.sum()) < 1e-12 for r in own)
        want = np.sort((centred @ directions[:, k] / e[k] ** 0.5))
        have = np.sort([r["whitened"] for r in own])
        assert min(np.abs(have - want).max(), np.abs(have + want[::-1]).max()) < 1e-8


def test_whitening_of_few_directions(spark):
    rows = [(k, [float(k % 3), 5.0, float(k % 2), float(k % 3 + k % 2)], 0, "") for k in range(12)]
    got = whitened(spark, rows)
    _, _, _, e, _ = plain_whitening([r[1] for r in rows])
    assert {(r["component"], r["whitened"] is None) for r in got} == {(1, False), (2, False), (3, True), (4, True)} and got[0]["identity_error"] < 1e-10
    assert [r["explained"] for r in got[:4]] == pytest.approx((e / e.sum()).tolist(), abs=1e-12)
    got = whitened(spark, [(1, [2.0, 3.0], 0, "")] * 2)
    assert len(got) == 4 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 and r["n"] == 1 for r in got)
    assert whitened(spark, []) == [] and whitened(spark, [(1, [], 0, ""), (2, None, 0, "")]) == []
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        assert {r["vec_id"] for r in whitened(spark, [*rows, (99, [1.0], 0, "")], keep=2)} == set(range(12)) and any("another length" in str(w.message) for w in said)
    vast = whitened(spark, [(1, [1e300, 0.0], 0, ""), (2, [0.0, 1.0], 0, ""), (3, [1.0, -1e300], 0, "")])
    assert len(vast) == 6 and all(math.isfinite(r["whitened"]) for r in vast)


def test_shifted_cholesky_of_ill_conditioned_rows(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(-(10**6), 10**6, (400, 3)).astype(float)
    v = np.column_stack([base, base[:, 0] + rng.integers(0, 2, 400)]) / 64
    _, _, _, e, _ = plain_whitening(v.tolist())
    got = whitened(spark, [(k, x, 0, "") for k, x in enumerate(v.tolist())])
    assert [r["explained"] for r in got[:4]] == pytest.approx((e / e.sum()).tolist(), rel=1e-4) and got[0]["identity_error"] < 1e-4


def test_pair_weights_order_documents():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 6))
    chance = 1 / (1 + np.exp(-3 * (x[:, 0] - 2 * x[:, 3])))
    good = rng.random(900) < chance
    model = pair_ranking.learned(x[good].astype(np.float32), x[~good].astype(np.float32), 1 - good.mean())
    s = model.strengths(x)
    assert (s[good][:, None] > s[~good][None, :]).mean() > 0.93 and abs((model.chances(x) < 0.5).mean() - (1 - good.mean())) < 0.01
    assert abs(model.weights[3] / model.weights[0] + 2) < 0.4


def test_quality_on_held_out_documents(spark):
    got = queries.op11_pair_ranking(spark, DATA)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    held = got.filter("held_out").join(labels, "doc_id").collect()
    assert len(held) > 80 and np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95
    assert got.count() == spark.read.parquet(f"{DATA}/documents.parquet").count() and got.filter("score < 0 or score > 1 or score is null or predicted <> int(score >= 0.5)").isEmpty()


def test_quality_of_odd_texts_and_labels(spark):
    clean, noisy = "some words of a quiet text that goes on for a while, and ends.", "BUY!!! $$$ now### now### now### &&& ***"
    rows = [(k, f"{clean} {k}" if k % 2 else f"{noisy} {k}", "x", 1.0) for k in range(60)] + [(None, clean, "x", 0.0), (901, None, None, None), (902, "", "", 0.0), (903, "z" * 3_000_000, "", 0.0), (904, "some words of a long text, " * 100_000, "", 0.0), (5, noisy, "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, score double")
    said = [(k, k % 2) for k in range(50)] + [(1, 1), (3, 0), (3, 1), (None, 1), (7, None), (8, 9), (4000, 0)]
    labels = spark.createDataFrame(said, "doc_id long, quality int")
    model = pair_ranking.fit(docs, labels, F.lit(True))
    got = {(r["doc_id"]): r for r in pair_ranking.score(docs.dropDuplicates(["doc_id"]), model).collect()}
    assert len(got) == 65 and all(got[k]["predicted"] == k % 2 for k in range(50, 60)) and got[904]["predicted"] == 1
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[901]["score"] == got[902]["score"]
    assert {r["score"] for r in pair_ranking.score(docs, pair_ranking.fit(docs, labels.filter("quality = 0"), F.lit(True))).collect()} == {0.0}
    assert {r["score"] for r in pair_ranking.score(docs, pair_ranking.fit(docs, labels.limit(0), F.lit(True))).collect()} == {0.5}
    assert pair_ranking.score(docs.limit(0), model).collect() == []


def test_features_do_not_depend_on_chunks(monkeypatch):
    text = "Some words, SHOUTED!! and 123 | marks\nlines \U0001f600 é " * 50
    whole = pair_ranking.features(text)
    monkeypatch.setattr(pair_ranking, "CHUNK", 7)
    assert np.allclose(whole, pair_ranking.features(text), atol=1e-6)
