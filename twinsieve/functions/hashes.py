"""Scalar functions on 64-bit fingerprints, as column expressions (FN-01, FN-02, FLT-04..06, SIM-01..03, SIM-06, SIM-11, AGG-16, AGG-17)."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Aspect ratios whose centre crops have fingerprints of their own.
ASPECTS = ("4x3", "1x1", "9x16")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def distance(a: Column | str, b: Column | str) -> Column:
    """FN-01: bits in which two fingerprints differ."""
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def slice16(h: Column | str, part: int) -> Column:
    """FN-01: the part-th 16 bits."""
    return F.shiftrightunsigned(col(h), 16 * part).bitwiseAND(F.lit(65535)).cast("int")


def masks16(radius: int = 2) -> list[int]:
    """FN-02: all 16-bit masks of at most `radius` bits; 137 for two."""
    return sorted(sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(16), r))


def similarity(a: Column | str, b: Column | str) -> Column:
    """SIM-01: percent of equal bits."""
    return (64 - distance(a, b)) * 100.0 / 64


def usable(h: Column | str) -> Column:
    """FLT-04: analysed and not nearly empty."""
    return (col(h) != 0) & (F.bit_count(col(h)) >= 8)


def percent_of(max_distance: int) -> float:
    """FLT-05: the similarity that a distance stands for."""
    return 100.0 - 100.0 * min(64, max_distance) / 64


def percent_at(max_distance: Column | str) -> Column:
    """FLT-05 of a column."""
    return 100.0 - F.least(F.lit(64), col(max_distance)) * 100.0 / 64


def distance_at(percent: Column | str) -> Column:
    """FLT-05 of a column."""
    return F.floor((100.0 - col(percent)) * 64 / 100).cast("long")


def distance_of(percent: float) -> int:
    """FLT-05: the largest distance at which a similarity still holds."""
    return int(64 * (100.0 - percent) // 100)


def passed(score: Column | str, threshold: float) -> Column:
    """FLT-06: the score, or 0 under the threshold."""
    return F.when(col(score) >= threshold, col(score)).otherwise(0.0)


def best_of(terms: list[tuple[Column, Column]]) -> Column:
    """The highest similarity of the pairs in which both fingerprints are usable; 0 without one."""
    guarded = [F.when(usable(a) & usable(b), similarity(a, b)).otherwise(0.0) for a, b in terms]
    return F.greatest(*guarded) if len(guarded) > 1 else guarded[0]


def _of(prefix: str, name: str) -> Column:
    return F.col(f"{prefix}.{name}")


def best_full(x: str, y: str) -> Column:
    """SIM-02: straight and mirrored fingerprints, each with each."""
    names = ("h", "mirror")
    return best_of([(_of(x, a), _of(y, b)) for a in names for b in names])


def best_variant(x: str, y: str) -> Column:
    """SIM-03: as SIM-02, and each crop with the other's whole image and with its crop of the same aspect."""
    full = ("h", "mirror")
    terms = [(_of(x, a), _of(y, b)) for a in full for b in full]
    for r in ASPECTS:
        crop = (f"crop_{r}", f"mirror_crop_{r}")
        terms += [(_of(x, a), _of(y, b)) for a in crop for b in full] + [(_of(x, a), _of(y, b)) for a in full for b in crop] + [(_of(x, a), _of(y, b)) for a in crop for b in crop]
    return best_of(terms)


def best_anchor(a: Column | str, b: Column | str) -> Column:
    """SIM-06: the highest similarity between two arrays of fingerprints; 0 if one is empty."""
    a, b = col(a), col(b)
    pairwise = F.transform(a, lambda x: F.aggregate(b, F.lit(0.0), lambda best, y: F.greatest(best, F.when(usable(x) & usable(y), similarity(x, y)).otherwise(0.0))))
    return F.coalesce(F.array_max(pairwise), F.lit(0.0))


def frame_score(a: str, b: str) -> Column:
    """SIM-11: of two frames (structs with phash and mirror) the best of four; a frame passes at 87.5."""
    return F.greatest(*[similarity(F.col(f"{a}.{m}"), F.col(f"{b}.{n}")) for m in ("phash", "mirror") for n in ("phash", "mirror")])


def xor_fold(hashes: Column | str) -> Column:
    """AGG-17: all fingerprints of an array xor-ed."""
    return F.aggregate(col(hashes), F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))


def folded(hashes: Column | str) -> Column:
    """AGG-16: an identifier of a sequence of fingerprints that depends on their order: 60 bits of a SHA-256; never 0."""
    text = F.array_join(F.transform(col(hashes), hex16), "")
    h = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")
    return F.when(h == 0, F.lit(1).cast("long")).otherwise(h)


def hex16(h: Column | str) -> Column:
    """PRJ-07: sixteen lower-case hex digits."""
    return F.lpad(F.lower(F.hex(col(h))), 16, "0")


def simhash60(tokens: Column) -> list[Column]:
    """Thirty aggregates that count, over all tokens, the set bits of a 60-bit digest; see `fingerprint_of`.

    One sum counts two bits, i in its low half and i + 30 in its high half: a text of 2 GB has under 2^30 tokens, so neither
    half overflows. All sums of a text fold within its task."""
    digest = F.conv(F.substring(F.md5(tokens), 1, 15), 16, 10).cast("long")
    two = F.lit(1 | 1 << 30)
    return [F.sum(F.shiftrightunsigned(digest, i).bitwiseAND(two)).alias(f"v{i}") for i in range(30)]


def fingerprint_of(many: Column | str) -> Column:
    """A bit is set where more than half of the tokens have it set; `many` is their number."""
    half = F.lit((1 << 30) - 1)
    bits = [(i, F.col(f"v{i}").bitwiseAND(half)) for i in range(30)] + [(i + 30, F.shiftrightunsigned(f"v{i}", 30)) for i in range(30)]
    return reduce(lambda x, y: x.bitwiseOR(y), [F.when(ones * 2 > col(many), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, ones in bits])
