"""Near fingerprints verified on pixels, all images against all (SIM-04 on the candidates of JN-01)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vision import ASPECT_RATIOS, C1, C2, GRID, SURE, centre_crop, decode, resize
from ..session import checkpointed
from .hamming import BATCH, _once

#: Images of a block, which takes 40 KB an image where it is compared; partitions of blocks at most.
BLOCK, MOST = 2048, 256
#: Bytes of an image's windows: whole at 64 x 64, then whole and cropped at 32 x 32, each in its 8 x 8 blocks.
LARGE, SMALL = 64 * 64, GRID * GRID
#: The windows (of y, of x) that are compared at 32 x 32: equal crops, and each crop with the other's whole image.
_PAIRED = [w for k in range(1, len(ASPECT_RATIOS) + 1) for w in ((k, k), (k, 0), (0, k))]
_YS, _XS = (np.array([w[side] for w in _PAIRED] * 2) for side in (0, 1))
#: Behind the straight windows of x stand its mirrored ones.
_XS[len(_PAIRED) :] += 1 + len(ASPECT_RATIOS)


def _blocks(window: np.ndarray) -> np.ndarray:
    n = len(window) // 8
    return window.reshape(n, 8, n, 8).transpose(0, 2, 1, 3)


def windows(image: np.ndarray) -> bytes:
    """All that SIM-04 looks at in an image."""
    small = [resize(image, GRID, GRID), *(centre_crop(image, a) for a in ASPECT_RATIOS.values())]
    return b"".join(_blocks(w).tobytes() for w in (resize(image, 64, 64), *small))


def _sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and variances of blocks (..., 64)."""
    x = x.astype(np.float32)  # sums of squares of 64 bytes are whole numbers under 2^24
    mean = x.sum(-1).astype(np.float64) / 64
    return mean, np.einsum("...i,...i->...", x, x).astype(np.float64) / 64 - mean * mean


def _mirrored(x: np.ndarray) -> np.ndarray:
    """Windows (..., rows, columns, 8, 8) from right to left."""
    return x[..., ::-1, :, ::-1]


class _Side:
    """Images of a block: large (64, n, 64) and small (16, n, windows, 64) windows by their 8 x 8 blocks."""

    def __init__(self, raw: bytes, many: int) -> None:
        data = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(many, -1)
        self.large = data[:, :LARGE].reshape(many, 8, 8, 8, 8)
        self.small = data[:, LARGE:].reshape(many, -1, GRID // 8, GRID // 8, 8, 8)

    def by_block(self) -> None:
        many = len(self.large)
        self.l = np.ascontiguousarray(self.large.reshape(many, 64, 64).transpose(1, 0, 2), np.float32)
        self.s = np.ascontiguousarray(self.small.reshape(many, -1, 16, 64).transpose(2, 0, 1, 3), np.float32)
        (self.lm, self.lv), (self.sm, self.sv) = _sums(self.l), _sums(self.s)


def _score(mx, vx, my, vy, products) -> np.ndarray:
    """SSIM (images, window pairs) from the blocks' means, variances and sums of products, blocks first."""
    both = mx * my
    up = (2 * both + C1) * (2 * (products / np.float64(64) - both) + C2)
    return (up / ((mx * mx + my * my + C1) * (vx + vy + C2))).mean(0).clip(0, 1)


def best_scores(x: _Side, i: int, y: _Side, at: np.ndarray) -> np.ndarray:
    """The best structural similarity of image i of x with each of the images `at` of y."""
    large = np.stack([x.large[i], _mirrored(x.large[i])]).reshape(2, 64, 64).transpose(1, 2, 0)
    small = np.concatenate([x.small[i], _mirrored(x.small[i])]).reshape(-1, 16, 64).transpose(1, 2, 0)
    (lm, lv), (sm, sv) = _sums(large.transpose(0, 2, 1)), _sums(small.transpose(0, 2, 1))
    products = y.l[:, at] @ large.astype(np.float32)
    best = _score(lm[:, None], lv[:, None], y.lm[:, at, None], y.lv[:, at, None], products).max(1)
    products = (y.s[:, at].reshape(16, -1, 64) @ small.astype(np.float32)).reshape(16, len(at), y.s.shape[2], -1)[:, :, _YS, _XS]
    return np.maximum(best, _score(sm[:, None, _XS], sv[:, None, _XS], y.sm[:, at][:, :, _YS], y.sv[:, at][:, :, _YS], products).max(1))


def verified_near(prints: DataFrame, images: DataFrame, max_distance: int) -> DataFrame:
    """SIM-04: (left_id, right_id, percent) of all pairs of (id, h) within the distance, by the pixels of (doc_id, content)
    where the fingerprint's percent is below SURE. Ids are integers; of an id with several images the best percent counts.

    Each image is decoded once, to windows of fixed size. They travel once, to blocks that are written as one row each, and
    each two blocks meet in one task by a product that reads them from there: neither images nor pairs are exchanged."""
    once = _once(images.where("doc_id is not null"), "doc_id")
    prints = prints.where(F.col("h").isNotNull() & F.col("id").isNotNull()).select("id", F.col("h").cast("long").alias("h"))
    n, cores, kind = prints.count(), prints.sparkSession.sparkContext.defaultParallelism, prints.schema["id"].dataType.simpleString()
    parts = max(1, min(MOST, max(-(-n // BLOCK), min(isqrt(8 * cores), -(-n // 256)))))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for content in batch["content"]:
                image = decode(content.as_py()) if content.is_valid else None
                out.append(None if image is None or not image.size else zlib.compress(windows(image), 1))
            yield pa.record_batch([batch["id"], pa.array(out, pa.binary())], ["id", "w"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, empty = [], bytes(LARGE + SMALL * (1 + len(ASPECT_RATIOS)))

        def send(rows: list) -> pa.RecordBatch:
            ids, h, w, k = zip(*rows)
            raw = zlib.compress(b"".join(empty if x is None else zlib.decompress(x) for x in w), 1)
            packed = (np.array(ids, np.int64).tobytes(), np.array(h, np.int64).tobytes(), np.array([x is not None for x in w]).tobytes(), raw)
            return pa.record_batch([pa.array([k[0]]), *(pa.array([x], pa.binary()) for x in packed)], ["k", "ids", "h", "seen", "w"])

        for batch in batches:
            held += zip(*(batch[c].to_pylist() for c in ("id", "h", "w", "k")))
            while len(held) >= BLOCK:
                yield send(held[:BLOCK])
                held = held[BLOCK:]
        if held:
            yield send(held)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0

        def send() -> pa.RecordBatch:
            return pa.record_batch([np.concatenate(c) for c in zip(*held)], ["left_id", "right_id", "percent"])

        for batch in batches:
            for r in batch.to_pylist():
                (xs, ys), (hx, hy), (sx, sy) = ([np.frombuffer(r[f"{s}_{c}"], t) for s in "ab"] for c, t in (("ids", np.int64), ("h", np.uint64), ("seen", bool)))
                x = y = None
                for i in range(len(xs)):
                    d = np.bitwise_count(hx[i] ^ hy)
                    near = (d <= max_distance) & (ys != xs[i])
                    if r["a_k"] == r["b_k"]:
                        near[: i + 1] = False
                    at = np.flatnonzero(near)
                    if not len(at):
                        continue
                    percent = (64.0 - d[at]) * 100.0 / 64
                    ask = np.flatnonzero((percent < SURE) & sx[i] & sy[at])
                    if len(ask):
                        if x is None:
                            x, y = (_Side(r[f"{s}_w"], len(ids)) for s, ids in (("a", xs), ("b", ys)))
                            y.by_block()
                        percent[ask] = 0.5 * percent[ask] + 50.0 * best_scores(x, i, y, at[ask])
                    held.append((np.minimum(xs[i], ys[at]), np.maximum(xs[i], ys[at]), percent))
                    many += len(at)
                    if many >= BATCH:
                        yield send()
                        held, many = [], 0
        if many:
            yield send()

    looked = images.select(F.col("doc_id").alias("id"), "content").where("id is not null").mapInArrow(look, f"id {kind}, w binary")
    rows = prints.repartition(parts, "id").join(looked.repartition(parts, "id"), "id").select("id", "h", "w", F.monotonically_increasing_id().alias("k"))  # several partitions may be one task's to write
    blocks = checkpointed(rows.mapInArrow(pack, "k long, ids binary, h binary, seen binary, w binary"))
    a, b = (blocks.select(*[F.col(c).alias(f"{s}_{c}") for c in blocks.columns]) for s in "ab")
    found = a.hint("shuffle_replicate_nl").join(b, F.col("a_k") <= F.col("b_k")).mapInArrow(compare, "left_id long, right_id long, percent double")
    found = found.select(F.col("left_id").cast(kind).alias("left_id"), F.col("right_id").cast(kind).alias("right_id"), "percent")
    return found if once else found.groupBy("left_id", "right_id").agg(F.max("percent").alias("percent"))
