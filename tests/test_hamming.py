"""Hamming joins against brute force, with the fixture values of the survey."""

import random
import re

import pytest

from twinsieve.operators import groups, hamming


def signed(h):
    h &= (1 << 64) - 1
    return h - (1 << 64) if h >> 63 else h


def brute(rows, d):
    return {(a, b) for i, (a, x) in enumerate(rows) for b, y in rows[i + 1 :] if bin((x ^ y) & ((1 << 64) - 1)).count("1") <= d}


def found(spark, rows, d, strategy):
    df = spark.createDataFrame([(i, signed(h)) for i, h in rows], "id long, h long")
    return {(r.left_id, r.right_id) for r in hamming.hamming_pairs(df, d, strategy).collect()}


def test_probe_in_order(spark):
    index = spark.createDataFrame([(10, 0xFFFF), (20, 0xFFF0), (30, 0)], "id long, h long")
    asked = spark.createDataFrame([(1, 0xFFFF)], "q long, h long")
    hits = hamming.hamming_lists(asked, index, 4).first().hits
    assert [(h.distance, h.id) for h in hits] == [(0, 10), (4, 20)]


@pytest.mark.parametrize("strategy", ["theta", "bands", "slices"])
@pytest.mark.parametrize("d", [0, 2, 8, 11, 14])
def test_recall_is_one(spark, strategy, d):
    rows = [(i, 0x9E3779B97F4A7C15 * i ^ (i << 17)) for i in range(96)]
    rng = random.Random(5)
    rows += [(100 + i, rows[i][1] ^ sum(1 << b for b in rng.sample(range(64), d))) for i in range(0, 96, 4)]
    rows = [(i, h & ((1 << 64) - 1)) for i, h in rows]
    assert found(spark, rows, d, strategy) == brute(rows, d)


def test_eight_bits_one_in_each_slice_and_beyond(spark):
    far = sum(1 << b for b in (0, 8, 15, 22, 29, 36, 43, 50))
    assert found(spark, [(1, 0), (2, far)], 8, "slices") == {(1, 2)}
    assert found(spark, [(1, 0), (2, far)], 9, "bands") == {(1, 2)}


def test_equal_fingerprints_nulls_and_empty(spark):
    df = spark.createDataFrame([(10, 0xAA), (20, 0xAA), (30, 0xAA), (40, 0xAB), (50, None)], "id long, h long")
    assert {(r.left_id, r.right_id) for r in hamming.hamming_pairs(df, 0).collect()} == {(10, 20), (10, 30), (20, 30)}
    assert hamming.hamming_pairs(df.where("id < 0"), 3).count() == 0


def test_components_of_chain_star_and_ring(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    got = {r.node: r.root for r in groups.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + k: 100 for k in range(30)}, 200: 200, 201: 200, 202: 200}


def test_links_connect_as_all_pairs_do(spark):
    rows = [(i, 0xFF << (i // 5)) for i in range(25)]
    df = spark.createDataFrame([(i, signed(h)) for i, h in rows], "id long, h long")
    a = {(r.node, r.root) for r in groups.connected_components(hamming.hamming_links(df, 2)).collect()}
    b = {(r.node, r.root) for r in groups.connected_components(hamming.hamming_pairs(df, 2).selectExpr("left_id a", "right_id b")).collect()}
    assert a == b


def last_step(df):
    """The plan from the result down to the first join."""
    return df._jdf.queryExecution().executedPlan().toString().split("Join")[0].split("CartesianProduct")[0]


@pytest.mark.parametrize("strategy, d", [("theta", 3), ("bands", 3), ("slices", 3), ("bands", 8)])
def test_pairs_of_copies_are_not_exchanged(spark, strategy, d):
    rows = [(i, 0xFF << (i % 7)) for i in range(300)]
    df = spark.createDataFrame([(i, signed(h)) for i, h in rows], "id long, h long")
    out = hamming.hamming_pairs(df, d, strategy)
    top = last_step(out)
    assert "Exchange" not in top and "Aggregate" not in top
    assert sorted((r.left_id, r.right_id) for r in out.collect()) == sorted(brute(rows, d))


def test_slices_enumerate_only_what_the_distance_asks_for(spark):
    df = spark.createDataFrame([(i, i) for i in range(10)], "id long, h long")
    left, right = df.selectExpr("h x"), df.selectExpr("h y")
    made = lambda d: hamming._near_rows(left, right, d, "slices")._jdf.queryExecution().analyzed().toString()
    masks = lambda d: max(len(x.split(", ")) for x in re.findall(r"explode\(array\(([^()]*)\)", made(d)))
    assert (masks(3), masks(7)) == (1, 17)
    assert "Aggregate" not in made(3)


@pytest.mark.parametrize("d, block", [(10, 1 << 18), (10, 40), (14, 64)])
def test_far_pairs_are_compared_in_blocks_without_keys(spark, monkeypatch, d, block):
    monkeypatch.setattr(hamming, "THETA_ROWS_SLICES", 10)
    monkeypatch.setattr(hamming, "BLOCK", block, raising=False)
    rng = random.Random(8)
    rows = [(i, rng.getrandbits(64)) for i in range(60)]
    rows += [(100 + i, rows[i][1] ^ sum(1 << b for b in rng.sample(range(64), i % (d + 3)))) for i in range(60)]
    rows += [(200 + i, rows[3][1]) for i in range(40)] + [(300, None)]
    df = spark.createDataFrame([(i, None if h is None else signed(h)) for i, h in rows], "id long, h long")
    out = hamming.hamming_pairs(df, d)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Join" not in plan and "Cartesian" not in plan
    assert dict(out.dtypes) == {"left_id": "bigint", "right_id": "bigint", "distance": "int"}
    want = [(a, b, bin(x ^ y).count("1")) for k, (a, x) in enumerate(rows[:-1]) for b, y in rows[k + 1 : -1] if bin(x ^ y).count("1") <= d]
    assert sorted(map(tuple, out.collect())) == sorted(want)
    again = hamming.hamming_pairs(df.union(df.where("id < 50").selectExpr("id", "~h")), d).collect()
    both = [(i, h) for i, h in rows[:-1]] + [(i, h ^ ((1 << 64) - 1)) for i, h in rows[:50]]
    least = {}
    for k, (a, x) in enumerate(both):
        for b, y in both[k + 1 :]:
            if a != b and (n := bin(x ^ y).count("1")) <= d:
                least[min(a, b), max(a, b)] = min(n, least.get((min(a, b), max(a, b)), 64))
    assert {(r.left_id, r.right_id): r.distance for r in again} == least and len(again) == len(least)
    assert hamming.hamming_pairs(df.where("id < 0"), d).count() == 0


def test_far_pairs_are_sent_in_runs(spark):
    rng = random.Random(9)
    rows = [(i, 0xFFFF ^ sum(1 << b for b in rng.sample(range(60), 5))) for i in rng.sample(range(10_000), 500)]
    out = hamming.hamming_pairs(spark.createDataFrame(rows, "id long, h long"), 10).toPandas()
    assert len(out) == 500 * 499 // 2
    runs = {c: int((out[c] != out[c].shift()).sum()) for c in out.columns}
    assert runs["distance"] < len(out) / 4 and runs["left_id"] + runs["right_id"] < 1.2 * len(out)


def test_pairs_carry_columns_unless_ids_repeat(spark):
    df = spark.createDataFrame([(1, 7, "a"), (3, 7, "c"), (2, 6, "b"), (9, 1 << 40, "z")], "id long, h long, path string")
    got = {(r.left_id, r.right_id, r.left_path, r.right_path) for r in hamming.hamming_pairs(df, 1).collect()}
    assert got == {(1, 2, "a", "b"), (1, 3, "a", "c"), (2, 3, "b", "c")}
    again = df.union(spark.createDataFrame([(1, 1 << 40, "y")], df.schema))
    out = hamming.hamming_pairs(again, 1)
    assert out.columns == ["left_id", "right_id", "distance"]
    assert {(r.left_id, r.right_id) for r in out.collect()} == {(1, 2), (1, 3), (2, 3), (1, 9)}


def media_of(spark, rows):
    """Files (id, kind, h) whose other fingerprints are shifts of h, or none."""
    names = [f"{m}crop_{r}" for r in hamming.ASPECTS for m in ("", "mirror_")]
    return spark.createDataFrame([(i, k, h, h >> 9, *[h >> (5 + n) for n in range(6)]) for i, k, h in rows], "id long, kind int, h long, mirror long, " + ", ".join(f"{n} long" for n in names))


def test_variants_of_copies_are_scored_once_and_not_exchanged(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(62) for _ in range(6)] + [0]
    m = media_of(spark, [(i, 1 + i % 2, base[rng.randrange(7)] ^ (1 << rng.randrange(60) if i % 5 == 0 else 0)) for i in range(80)])
    cand = hamming.variant_candidates(m, 3)
    old = hamming.scored_pairs(m, cand, 95.0)
    got = hamming.variant_scores(m, 3, 95.0)
    assert "Exchange" not in last_step(cand) and "Exchange" not in last_step(got)
    assert cand.count() == cand.distinct().count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, old.collect()))


def test_sure_pairs_need_no_images(spark):
    from twinsieve.functions.vision import verified_pairs

    pairs = spark.createDataFrame([(1, 2, 0), (1, 3, 1)], "left_id long, right_id long, distance int")
    assert [r.percent for r in verified_pairs(pairs, None, 1).orderBy("right_id").collect()] == [100.0, 63 * 100.0 / 64]
