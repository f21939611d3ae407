"""Fingerprints, structural similarity and alignment against plain loops."""

import struct

import numpy as np
import pytest

from twinsieve.functions import temporal as t
from twinsieve.functions import vision as v
from twinsieve.functions.hashes import folded


def pattern(seed):
    y, x = np.mgrid[0:64, 0:64]
    return ((3 * x + 5 * y + 7 * seed) % 251).astype(np.uint8)


def bmp(image):
    h, w = image.shape
    stride = (w * 3 + 3) // 4 * 4
    rows = b"".join(np.repeat(r, 3).tobytes().ljust(stride, b"\0") for r in image[::-1])
    return b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows


def test_decoders_agree():
    image = pattern(3)[:40, :30]
    pgm = b"P5\n# note\n30 40\n255\n" + image.tobytes()
    assert (v.decode(pgm) == image).all() and (v.decode(bmp(image)) == image).all()
    assert v.decode(b"BM broken") is None and v.decode(b"") is None and v.decode(b"P5\n9 9\n255\nxx") is None


def test_hash_is_the_sign_against_the_upper_median():
    image = np.random.default_rng(1).integers(0, 256, (32, 32)).astype(np.uint8)
    d = np.zeros((8, 8))
    for a in range(8):
        for b in range(8):
            c = np.cos((2 * np.arange(32) + 1) * a * np.pi / 64)[None, :] * np.cos((2 * np.arange(32) + 1) * b * np.pi / 64)[:, None]
            d[a, b] = (image * c).sum() * (np.sqrt(1 / 32) if a == 0 else np.sqrt(2 / 32)) * (np.sqrt(1 / 32) if b == 0 else np.sqrt(2 / 32))
    values = d.ravel()[1:]
    want = sum(1 << i for i, x in enumerate(values) if x >= sorted(values)[31])
    straight, mirrored = v.perceptual_hashes(image[None])
    assert int(straight[0]) == want
    assert int(mirrored[0]) == int(v.perceptual_hashes(image[:, ::-1][None])[0][0])


def test_ssim_by_blocks():
    a, b = pattern(1), pattern(2)
    scores = []
    for y in range(0, 64, 8):
        for x in range(0, 64, 8):
            p, q = a[y : y + 8, x : x + 8].astype(float), b[y : y + 8, x : x + 8].astype(float)
            mp, mq = p.mean(), q.mean()
            scores.append((2 * mp * mq + v.C1) * (2 * ((p * q).mean() - mp * mq) + v.C2) / ((mp**2 + mq**2 + v.C1) * (p.var() + q.var() + v.C2)))
    assert abs(v.ssim(a, b) - min(1, max(0, np.mean(scores)))) < 1e-9
    assert v.ssim(a, a) > 0.999 and v.verified(a, a, 98.0) == 98.0 and v.verified(None, a, 90.0) == 90.0


def plain_alignment(sim, x, y, threshold, gap, tol):
    n, m = sim.shape
    s, best = np.zeros((n + 1, m + 1)), 0.0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            score = sim[i - 1, j - 1] if sim[i - 1, j - 1] >= threshold else sim[i - 1, j - 1] - 100
            if i > 1 and j > 1 and tol > 0:
                score -= min(20.0, 20 * abs((x.ts[i - 1] - x.ts[i - 2]) - (y.ts[j - 1] - y.ts[j - 2])) / tol)
            s[i, j] = max(0, s[i - 1, j - 1] + score, s[i - 1, j] - gap, s[i, j - 1] - gap)
            best = max(best, s[i, j])
    return min(100.0, best / n)


def test_alignment_against_plain_loops():
    rng = np.random.default_rng(4)
    for _ in range(20):
        n, m = rng.integers(1, 9, 2)
        x, y = (t.Frames(np.cumsum(rng.random(k) + 0.5), rng.integers(0, 1 << 62, k).astype(np.uint64), np.zeros(k, np.uint64)) for k in sorted((n, m)))
        y.h[: len(x.h) // 2] = x.h[: len(x.h) // 2]
        sim = t.frame_matrix(x, y)
        assert abs(t.local_alignment(sim, x, y, 60.0, 8.0, 2.0, 0.0) - plain_alignment(sim, x, y, 60.0, 8.0, 2.0)) < 1e-9


def test_partial_clip_and_empty():
    whole = t.Frames(np.arange(20.0), np.array([0x1000 + i for i in range(20)], np.uint64), np.zeros(20, np.uint64))
    clip = t.Frames(np.arange(8.0), whole.h[5:13], np.zeros(8, np.uint64))
    assert t.video_similarity(whole, clip, 50, 8) >= 99.9
    assert t.video_similarity(whole, t.Frames.of([]), 50, 8) == 0.0


def test_leading_offset_finds_the_opening():
    rng = np.random.default_rng(9)
    h = rng.integers(1, 1 << 62, 40).astype(np.uint64)
    ref = t.Anchors(np.arange(20.0), h[:20], ~h[:20], np.zeros(20, bool), 20.0)
    late = t.Anchors(np.arange(32.0), np.concatenate((h[28:], h[:20])), ~np.concatenate((h[28:], h[:20])), np.zeros(32, bool), 32.0)
    assert t.leading_offsets(ref, late)[0][0] == 12.0


def test_known_digests():
    assert v.fnv1a(b"", v.FNV_STANDARD) == v.FNV_STANDARD and v.fnv1a(b"a", v.FNV_STANDARD) == 0xAF63DC4C8601EC8C


def test_folded_hashes_depend_on_order(spark):
    rows = spark.createDataFrame([([1, 2],), ([2, 1],), ([],), (None,)], "h array<long>").select(folded("h")).collect()
    assert len({r[0] for r in rows}) == 4 and 0 not in {r[0] for r in rows[:3]} and rows[3][0] is None


def test_quick_hash_on_rows(spark):
    from twinsieve.session import ship

    ship(spark)
    rows = [(b"",), (b"abc",), (bytes(range(256)) * 3,), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "content binary").select(v.quick_hash("content")).collect()]
    assert got == [str(v.fnv1a(r[0])) if r[0] is not None else None for r in rows]


def test_alignment_blends_thumbs_where_both_sides_have_them():
    rng = np.random.default_rng(6)
    thumbs = rng.integers(1, 256, (4, 48, 48)).astype(np.uint8)
    rows = lambda z: [{"ts": float(k), "h": 4096 + 77 * k, "mh": 0, **({} if z is None else {"thumb": z[k].tobytes()})} for k in range(4)]
    score = lambda a, b: t.video_similarity(t.Frames.of(rows(a)), t.Frames.of(rows(b)))
    other = rng.integers(1, 256, (4, 48, 48)).astype(np.uint8)
    assert score(thumbs, thumbs) > 99.9 and score(thumbs, thumbs[:, :, ::-1]) > 99.9
    assert score(thumbs, other) < 50
    assert score(thumbs, None) == score(None, None) == score(thumbs, np.zeros_like(other)) == 100.0
    half = np.where(np.arange(4)[:, None, None] < 2, thumbs, 0).astype(np.uint8)
    assert score(half, other) == pytest.approx(50.0, abs=1e-6)
    frame = t.blended(np.array([[95.0]]), *(t.Frames.of(rows(z)[:1]) for z in (thumbs, other)), 90.0)
    assert frame[0, 0] == pytest.approx(0.4 * 95 + 60 * max(v.ssim(thumbs[0], other[0]), v.ssim(thumbs[0], other[0][:, ::-1])))


@pytest.mark.parametrize("block, files_a_task", [(2048, 4), (7, 4), (1, 1)])
def test_near_fingerprints_are_verified_on_pixels_within_the_candidate_range(spark, monkeypatch, block, files_a_task):
    from twinsieve import session
    from twinsieve.operators import verify

    monkeypatch.setattr(verify, "BLOCK", block)
    if files_a_task == 1:  # each task of a checkpoint then writes several partitions
        monkeypatch.setattr(session, "MANY", 0)
        monkeypatch.setattr(session, "FILES", 1)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 256, (40, 50)).astype(np.uint8)
    images = {i: np.where(rng.random(base.shape) < i / 60, rng.integers(0, 256, base.shape), base[:, ::-1] if i % 7 == 0 else base).astype(np.uint8)[: 40 - i % 3] for i in range(24)}
    files = [(i, b"P5 %d %d 255\n" % x.shape[::-1] + x.tobytes()) for i, x in images.items()] + [(30, b"damaged"), (31, None), (None, b"")]
    prints = {i: (1 << 63 | (1 << (i % 10)) - 1) for i in [*images, 30, 31]}
    df = spark.createDataFrame([(i, v.signed(h)) for i, h in prints.items()] + [(40, None)], "id long, h long")
    out = verify.verified_near(df, spark.createDataFrame(files, "doc_id long, content binary"), 8).collect()
    want = {}
    for a in prints:
        for b in prints:
            if a < b and (d := bin(prints[a] ^ prints[b]).count("1")) <= 8:
                want[a, b] = v.verified(images.get(a), images.get(b), (64 - d) * 100.0 / 64)
    assert len(out) == len(want) and {(r.left_id, r.right_id) for r in out} == set(want)
    assert all(abs(r.percent - want[r.left_id, r.right_id]) < 1e-9 for r in out)
    assert len({r.percent for r in out}) > 100


def test_the_query_of_verified_pairs_looks_at_pixels(spark, tmp_path):
    from __spark_entry__ import queries

    texts = ["alpha beta gamma delta " * 9 + "x%d " % k * k for k in range(6)] + [None, "..."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = queries()["sim04_verified_pairs"](spark, str(tmp_path))
    assert out.columns == ["left_id", "right_id", "percent"]
    percents = [r.percent for r in out.collect()]
    assert percents and any(p < v.SURE for p in percents)
