"""Temporal similarity of videos given as frame tables (SIM-06 to SIM-10, SIM-12, WIN-14, SRT-06).

The alignment is a dynamic programme over one pair of short sequences; it runs in Arrow batches of pairs, after the cheap
gates. A programme's row is a vector: the diagonal step is one numpy operation, and the run of gaps along the row is a
running maximum, so a pair costs one pass per frame of the shorter video.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashes import best_anchor, best_full
from .scalars import duration_gate
from .vision import ssim

THUMB = 48


@dataclass
class Frames:
    """A video's frames: times, fingerprints and mirrored ones as unsigned arrays, scene changes, and gray thumbs of 48 x 48 if
    there are any; one of zeros is unknown."""

    ts: np.ndarray
    h: np.ndarray
    mirror: np.ndarray
    scenes: np.ndarray = field(default_factory=lambda: np.zeros(0))
    thumbs: np.ndarray | None = None

    @staticmethod
    def of(rows, scenes=()) -> "Frames":
        rows = list(rows) if rows is not None else []
        get = lambda k: [r[k] for r in rows]
        thumbs = None
        if rows and "thumb" in rows[0]:
            thumbs = np.array([np.frombuffer(t or bytes(THUMB * THUMB), np.uint8) for t in get("thumb")]).reshape(-1, THUMB, THUMB)
        return Frames(np.array(get("ts"), float), np.array(get("h"), np.int64).view(np.uint64), np.array(get("mh"), np.int64).view(np.uint64), np.array(list(scenes), float), thumbs)

    def take(self, keep: np.ndarray) -> "Frames":
        return Frames(self.ts[keep], self.h[keep], self.mirror[keep], self.scenes, self.thumbs[keep] if self.thumbs is not None else None)


def percents(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """SIM-01 of all pairs."""
    return 100.0 * (64 - np.bitwise_count(a[:, None] ^ b[None])) / 64


def frame_matrix(x: Frames, y: Frames) -> np.ndarray:
    """The best of straight and mirrored fingerprints for each pair of frames; a mirrored one of 0 is unknown."""
    best = percents(x.h, y.h)
    for p, q, known in ((x.mirror, y.h, x.mirror[:, None] != 0), (x.h, y.mirror, y.mirror[None] != 0), (x.mirror, y.mirror, (x.mirror[:, None] != 0) & (y.mirror[None] != 0))):
        best = np.where(known, np.maximum(best, percents(p, q)), best)
    return best


def blended(sim: np.ndarray, x: Frames, y: Frames, threshold: float) -> np.ndarray:
    """Pairs at the threshold with thumbs on both sides: 0.4 of the fingerprints' percent and 0.6 of the better structural
    similarity of the thumbs, straight and mirrored."""
    if x.thumbs is None or y.thumbs is None:
        return sim
    out = sim.copy()
    for i, j in np.argwhere((sim >= threshold) & x.thumbs.any((1, 2))[:, None] & y.thumbs.any((1, 2))[None]):
        out[i, j] = 0.4 * sim[i, j] + 60.0 * max(ssim(x.thumbs[i], y.thumbs[j]), ssim(x.thumbs[i], y.thumbs[j][:, ::-1]))
    return out


def thinned(a: Frames, b: Frames) -> tuple[Frames, Frames]:
    """JN-18 on arrays: where one step is a whole multiple of the other, the finer video's frames at the coarser one's times."""
    if len(a.ts) < 2 or len(b.ts) < 2:
        return a, b
    steps = a.ts[1] - a.ts[0], b.ts[1] - b.ts[0]
    if min(steps) <= 0 or abs(steps[0] - steps[1]) <= 1e-9:
        return a, b
    fine, coarse = (a, b) if steps[0] < steps[1] else (b, a)
    k = max(steps) / min(steps)
    if k < 2 or abs(k - round(k)) > 0.01:
        return a, b
    near = np.abs(fine.ts[:, None] - coarse.ts[None]) < 1e-3
    keep, hit = near.any(1), near.any(0)[:-1]
    if keep.sum() < 3 or not len(hit) or 5 * hit.sum() < 4 * len(hit):
        return a, b
    fine = fine.take(keep)
    return (fine, coarse) if steps[0] < steps[1] else (coarse, fine)


def scene_flags(v: Frames) -> np.ndarray:
    """Which frames stand at a scene change, to the millisecond."""
    return (np.abs(v.ts[:, None] - v.scenes[None]) < 1e-3).any(1) if len(v.scenes) else np.zeros(len(v.ts), bool)


def local_alignment(sim: np.ndarray, x: Frames, y: Frames, threshold: float, gap: float, tolerance: float, bonus: float) -> float:
    """The best local alignment of frames, per cent of a full match of the shorter video: similar frames add their percent,
    others take off what they lack; steps that differ cost up to 20; a gap costs `gap`; scene changes on both sides add."""
    n, m = sim.shape
    match = np.where(sim >= threshold, sim, sim - 100.0)
    if tolerance > 0 and n > 1 and m > 1:
        match[1:, 1:] -= np.minimum(20.0, 20.0 * np.abs(np.diff(x.ts)[:, None] - np.diff(y.ts)[None]) / tolerance)
    if bonus > 0:
        match = match + bonus * (scene_flags(x)[:, None] & scene_flags(y)[None])
    before, best, ramp = np.zeros(m + 1), 0.0, gap * np.arange(m + 1)
    for i in range(n):
        row = np.maximum(0.0, before - gap)
        row[1:] = np.maximum(row[1:], before[:-1] + match[i])
        row[0] = 0.0
        row = np.maximum.accumulate(row + ramp) - ramp  # gaps along the row
        best, before = max(best, float(row.max())), row
    return min(100.0, best / n)


def coverage(sim: np.ndarray, gate: float) -> dict[str, float]:
    """SIM-10: shares of both videos' frames with a match, and stretches of the shorter one's, single gaps bridged."""
    hit = sim >= gate
    rows = hit.any(1)
    at = np.flatnonzero(rows)
    return {"short": float(rows.mean()), "long": float(hit.any(0).mean()), "segments": int((np.diff(at) > 2).sum() + 1) if len(at) else 0}


def video_similarity(a: Frames, b: Frames, threshold: float = 90.0, gap: float = 8.0, tolerance: float = 2.0, bonus: float = 0.0) -> float:
    """SIM-08: temporal alignment of two videos' frames, in percent, with their thumbs where both have them."""
    if not len(a.h) or not len(b.h):
        return 0.0
    a, b = thinned(a, b)
    x, y = (a, b) if len(a.h) <= len(b.h) else (b, a)
    return local_alignment(blended(frame_matrix(x, y), x, y, threshold), x, y, threshold, gap, tolerance, bonus)


def crop_similarity(a: Frames, b: Frames, crops_a: dict[str, np.ndarray], crops_b: dict[str, np.ndarray], threshold: float = 90.0, gap: float = 8.0, tolerance: float = 2.0) -> float:
    """SIM-09: the best alignment by crops: each aspect on its own, crops with the other's whole frames and with its crops of
    the same aspect; `crops` has fingerprints by aspect, and mirrored ones by mirror_<aspect>."""
    best = 0.0
    for r in ("4x3", "1x1", "9x16"):
        own, other = [c for c in (crops_a.get(r), crops_a.get(f"mirror_{r}")) if c is not None], [c for c in (crops_b.get(r), crops_b.get(f"mirror_{r}")) if c is not None]
        terms = [percents(p, q) for p in own for q in (*other, b.h, b.mirror)] + [percents(p, q) for p in (a.h, a.mirror) for q in other]
        if terms:
            best = max(best, local_alignment(np.maximum.reduce(terms), a, b, threshold, gap, tolerance, 0.0))
    return best


def _alignment_rows(threshold: float, gap: float, tolerance: float):
    @F.pandas_udf("double")
    def align(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([video_similarity(Frames.of(x), Frames.of(y), threshold, gap, tolerance) for x, y in zip(a, b)])

    return align


def video_matches(videos: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """SIM-07: of candidate pairs, those whose whole fingerprints reach the threshold match at once; those within twelve points
    of it, by fingerprints or anchors, and of fitting length or with an anchor, are aligned in time. `videos` has id,
    duration, h, mirror, anchors and frames array<struct<ts,h,mh[,thumb]>>, a thumb being 48 x 48 gray bytes or null; frames are joined to the gated pairs only."""
    small = videos.drop("frames")
    x, y = small.alias("x"), small.alias("y")
    rows = pairs.join(x, F.col("left_id") == F.col("x.id")).join(y, F.col("right_id") == F.col("y.id"))
    trigger = max(0.0, threshold - 12.0)
    rows = rows.select("left_id", "right_id", best_full("x", "y").alias("full"), best_anchor("x.anchors", "y.anchors").alias("anchor"), duration_gate("x.duration", "y.duration").alias("fits"))
    direct = rows.where(F.col("full") >= threshold).select("left_id", "right_id", F.col("full").alias("percent"), F.lit("direct").alias("stage"))
    gated = rows.where((F.col("full") < threshold) & (F.greatest("full", "anchor") >= trigger) & (F.col("fits") | (F.col("anchor") >= trigger)))
    f = videos.select("id", "frames")
    gated = gated.join(f.select(F.col("id").alias("left_id"), F.col("frames").alias("fa")), "left_id").join(f.select(F.col("id").alias("right_id"), F.col("frames").alias("fb")), "right_id")
    aligned = gated.select("left_id", "right_id", _alignment_rows(threshold, 8.0, 2.0)("fa", "fb").alias("percent"), F.lit("temporal").alias("stage")).where(F.col("percent") >= threshold)
    return direct.unionByName(aligned)


@dataclass
class Anchors:
    """An index of one frame a second: times, fingerprints, mirrored ones, and which are too flat."""

    ts: np.ndarray
    h: np.ndarray
    mirror: np.ndarray
    flat: np.ndarray
    duration: float


def ordered_run(scores: np.ndarray, ref: np.ndarray, ts: np.ndarray, start: int) -> tuple[list[tuple[int, int]], int]:
    """WIN-14: reference frames matched in order from a start on: each by the first later frame that passes 87.5, a quarter to
    two and a half seconds after the last match; after a miss one more reference frame may be passed over."""
    hits, at, last, steps, k = [], start, ts[start] - 1.0, 0, 0
    while k < len(ref) and at < len(ts):
        gaps = ts[at:] - last
        ok = (gaps <= 2.5) & ((gaps >= 0.25) | (np.arange(len(gaps)) == 0)) & (scores[ref[k], at:] >= 87.5)
        broken = np.flatnonzero(gaps > 2.5)
        found = np.flatnonzero(ok[: broken[0]] if len(broken) else ok)
        steps += 1
        if len(found):
            j = at + int(found[0])
            hits.append((int(ref[k]), j))
            at, last = j + 1, ts[j]
            k += 1
        elif k + 1 < len(ref):
            k += 2
            steps += 1
        else:
            break
    return hits, steps


def leading_offsets(ref: Anchors, cand: Anchors, probe: float = 5.0, window: float = 60.0) -> list[tuple[float, float]]:
    """SIM-12, SRT-06: where the reference's opening may begin in the other video: up to four (time, confidence), the surest
    first. The opening is `probe` seconds from the first frame with texture; three ordered matches are needed; confidence is
    their share times their mean score, less half for flat frames, 0.3 at least."""
    if not len(ref.ts) or not len(cand.ts):
        return []
    textured = np.flatnonzero(~ref.flat & (ref.ts <= 60.0))
    first = int(textured[0]) if len(textured) else 0
    opening = np.flatnonzero((np.arange(len(ref.ts)) >= first) & (ref.ts <= ref.ts[first] + probe + 1e-9))
    if len(opening) < 3:
        return []
    scores = np.maximum.reduce([percents(p, q) for p in (ref.h, ref.mirror) for q in (cand.h, cand.mirror)])
    out = []
    for s in np.flatnonzero(cand.ts <= window + 1e-9):
        hits, steps = ordered_run(scores, opening, cand.ts, int(s))
        if len(hits) < 3:
            continue
        flat = sum(bool(ref.flat[i] or cand.flat[j]) for i, j in hits) / (2 * len(hits))
        sure = min(1.0, max(0.0, len(hits) / steps * (sum(scores[i, j] for i, j in hits) / (100.0 * len(hits))) * (1 - 0.5 * flat)))
        if sure >= 0.3:
            out.append((float(cand.ts[hits[0][1]]), sure))
    return sorted(out, key=lambda x: (-x[1], x[0]))[:4]
