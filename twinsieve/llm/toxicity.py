"""Operator 7: toxicity of deobfuscated text.

A noisy channel turns letters into look-alike digits and signs, repeats them, and spaces them out. Every token that could
come from it (letters beside look-alikes, runs of three, single letters in a row or parted by signs; in a row with a
letter a look-alike or one letter repeated counts as a single letter) becomes a lattice
of its possible letters, and Viterbi decoding under a character trigram model finds the likeliest reading. The model is
counted over all texts. Read words join the text's own; features are words and their first four and five letters, as
hashes. The commonest ways of being toxic are learned from labelled rows: the FEATURES features with the highest
likelihood ratio, weighed by a logistic regression on at most about TRAIN_ROWS labelled
ids, a sample by hash of the id; of several texts with one id the one with the smallest hash is learned from.

What a text without evidence scores is a prior, not the labels' mix: where more than PRIOR of the labels are toxic, the
regression weighs both kinds as if PRIOR of them were, and the intercept never exceeds that share's. However skewed the
labels are, a text without any learned feature scores at most PRIOR and is kept by `clean`.

Null and empty texts have no features and get the score of the intercept. Rows and ids may repeat or be null; a null id
has no label. Very long texts are taken whole, in one slice each. Empty tables give empty results, and without labels of
both kinds every score is the share of toxic labels, PRIOR at most (1e-9 without any). Other columns stay; one with the
name of the score's column is replaced by it in `score` and stays as it is in `clean`.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _Powers, cut, flat, free_name, mix, slices
from .lm import fifth

TRAIN_ROWS, FEATURES, LEAST_ROWS, LEAST_RATIO = 20_000, 1024, 4, 15.0
#: The highest score of a text without evidence.
PRIOR = 0.2
#: Which letters a digit or sign may stand for.
LOOK_ALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c"}
CODES = 28
REPEATED = b"\0"
SCORE = "_ts_toxicity"

_AGAIN = re.compile(rb"(.)\1+", re.DOTALL)
_CODE = np.zeros(256, np.uint8)
_CODE[97:123] = np.arange(1, 27)
_CODE[65:91] = np.arange(1, 27)
_CODE[128:] = 27
_LETTER = _CODE > 0
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_ALIKE = np.zeros(256, bool)
_ALIKE[[ord(c) for c in LOOK_ALIKES]] = True


def _edges(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def count_trigrams(batches):
    """Codes of three neighbouring characters with their counts; a text begins and ends with two blanks."""
    total = np.zeros(CODES**3, np.int64)
    for batch in batches:
        data, offsets = flat(batch["text"])
        for lo, hi in slices(offsets):
            part = data[offsets[lo] : offsets[hi]]
            if len(part):
                c = np.concatenate((np.zeros(2, np.int64), _CODE[part], np.zeros(2, np.int64)))
                total += np.bincount(c[:-2] * CODES**2 + c[1:-1] * CODES + c[2:], minlength=CODES**3)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities of a code after two others, interpolated with shorter contexts; CODES cubed numbers."""
    counts = np.zeros(CODES**3)
    for gram, n in docs.select("text").mapInArrow(count_trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n")).collect():
        counts[gram] = n
    three = counts.reshape(CODES, CODES, CODES)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one.sum() + CODES)
    p2 = (two + 50 * p1) / (two.sum(1, keepdims=True) + 50)
    return np.log((three + 50 * p2[None]) / (three.sum(2, keepdims=True) + 50))


class Decoder:
    """Viterbi decoding of suspicious tokens; readings are kept for up to `keep` tokens."""

    def __init__(self, model: np.ndarray, keep: int = 200_000) -> None:
        self.model, self.keep, self.known = model.tolist(), keep, {}

    def options(self, token: bytes, spaced: bool) -> list[list[tuple[bytes, float]]]:
        """For each run of one character its readings and what they cost. In a spaced run a null byte after a character says
        that it was written more than once, for one letter or two."""
        out, at = [], 0
        while at < len(token):
            to = at + 1
            while to < len(token) and token[to] == token[at]:
                to += 1
            c, n = token[at : at + 1], to - at
            again = spaced and token[to : to + 1] == REPEATED
            if _CODE[c[0]] == 27:
                own = [(token[at:to], 0.0)]
            elif again and (c.isalpha() or c.decode("latin-1") in LOOK_ALIKES):
                own = [(x.encode() * k, y - 2.0 * (k - 1)) for x, y in ([(c.decode(), 0.0)] if c.isalpha() else [(x, -1.0) for x in LOOK_ALIKES[c.decode("latin-1")]]) for k in (1, 2)]
                own += [] if c.isalpha() else [(b"", -5.0 if c.isdigit() else -2.5)]
            elif c.isalpha():
                own = [(c * n, 0.0)] if n < 3 else []
                own += [(c, -2.0 if n == 2 else -0.5)] * (n > 1) + [(c * 2, -1.0)] * (n > 2)
            elif c.decode("latin-1") in LOOK_ALIKES:
                own = [(x.encode() * k, -1.0 - 0.5 * abs(k - min(n, 2))) for x in LOOK_ALIKES[c.decode("latin-1")] for k in ((1,) if n == 1 else (1, 2))]
                own.append((b"", -5.0 if c.isdigit() else -2.5))
            else:
                own = [(b"", 0.0)]
            if spaced and out:
                own = own + [(b" " + x, y) for x, y in own if x]
            out.append(own)
            at = to
        return out

    def read(self, token: bytes, spaced: bool = False) -> bytes:
        key = (token, spaced)
        if key in self.known:
            return self.known[key]
        model = self.model
        states = {(0, 0): (0.0, b"")}
        for own in self.options(token, spaced):
            after: dict = {}
            for (a, b), (p, text) in states.items():
                for letters, cost in own:
                    q, x, y = p + cost, a, b
                    for ch in letters:
                        z = 27 if ch > 127 else ch - 96 if ch != 32 else 0
                        q += model[x][y][z]
                        x, y = y, z
                    if (x, y) not in after or after[x, y][0] < q:
                        after[x, y] = (q, text + letters)
            states = after
        text = max((p + model[a][b][0], t) for (a, b), (p, t) in states.items())[1]
        if len(self.known) >= self.keep:
            self.known.clear()
        if len(token) <= 64:
            self.known[key] = text
        return text


def readings(data: np.ndarray, offsets: np.ndarray, decoder: Decoder) -> tuple[list[int], list[bytes]]:
    """Rows and what their suspicious tokens read as."""
    n = len(data)
    low, letter = _LOW[data], _LETTER[data]
    starts, ends = _edges(~_BLANK[data], offsets)
    if not len(starts):
        return [], []

    def within(mask: np.ndarray) -> np.ndarray:
        s = np.concatenate(([0], np.cumsum(mask)))
        return s[ends] - s[starts]

    same = np.zeros(n, bool)
    if n > 2:
        same[2:] = letter[2:] & (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & (data[2:] < 128)
    begun = letter.copy()
    begun[1:] &= ~letter[:-1]
    letters, alike = within(letter), within(_ALIKE[data])
    runs = within(begun)
    odd = (letters > 0) & ((alike > 0) | (within(same) > 0)) | (letters > 2) & (runs >= letters)
    signs = letter | _ALIKE[data]
    changed = signs.copy()
    changed[1:] &= ~signs[:-1] | (low[1:] != low[:-1])
    changed[starts] = signs[starts]
    lone = (within(changed) == 1) & (ends - starts - within(signs) <= 1)
    row = np.searchsorted(offsets, starts, "right") - 1
    rows, texts = [], []
    raw = low.tobytes()
    for k in np.flatnonzero(odd).tolist():
        rows.append(int(row[k]))
        texts.append(decoder.read(raw[starts[k] : ends[k]]))
    change = np.flatnonzero(np.diff(np.concatenate(([0], lone.view(np.int8), [0]))))
    for a, b in zip(change[::2].tolist(), change[1::2].tolist()):
        while b - a > 2:
            r = int(row[a])
            stop = a + int(np.searchsorted(row[a:b], r, "right"))
            if stop - a > 2 and letters[a:stop].any():
                rows.append(r)
                texts.append(decoder.read(b"".join(_AGAIN.sub(rb"\1" + REPEATED, raw[starts[k] : ends[k]]) for k in range(a, stop)), True))
            a = stop
    return rows, texts


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of words and of their first four and five bytes."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts, ends = _edges(_LETTER[data], offsets)
    up, down = _Powers.get(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOW[data].astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    row = np.searchsorted(offsets, starts, "right") - 1
    out_row, out = [row], [mix((sums[ends] - sums[starts]) * down[starts] + np.uint64(11))]
    for k in (4, 5):
        long = ends - starts > k
        s = starts[long]
        out_row.append(row[long])
        out.append(mix((sums[s + k] - sums[s]) * down[s] + np.uint64(k)))
    return np.concatenate(out_row), np.concatenate(out)


def extract(column: pa.Array, decoder: Decoder):
    """(first row, rows, hashes) of slices, readings included."""
    data, offsets = flat(column)
    for lo, hi in slices(offsets):
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        row, h = features(part, at)
        rows, texts = readings(part, at, decoder)
        if texts:
            lengths = np.array([len(t) for t in texts], np.int64)
            more, g = features(np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum(lengths))))
            row, h = np.concatenate((row, np.array(rows)[more])), np.concatenate((h, g))
        yield lo, hi, row, h


def fit(hits: list[tuple[int, list[int]]], width: int) -> np.ndarray:
    """Weights and, last, the intercept of a ridge logistic regression, by accelerated gradient descent. Rows weigh as if at
    most PRIOR of them were toxic."""
    y = np.array([h[0] for h in hits], float)
    w = np.zeros(width + 1)
    share = max(y.mean() if len(y) else 0.0, 1e-9)
    prior = min(share, PRIOR)
    most = math.log(prior / (1 - prior))
    w[-1] = most
    if not 0 < y.sum() < len(y):
        return w
    own = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    rows = np.repeat(np.arange(len(y)), [len(h[1]) for h in hits])
    cols = np.array([c for h in hits for c in h[1]], np.int64)
    per_row = np.bincount(rows, minlength=len(y)).max(initial=1)
    rate, v, old = 4.0 / (per_row + 1), w.copy(), w.copy()
    scale = np.maximum(np.append(np.bincount(cols, own[rows], width), own.sum()), 1)
    for t in range(1, 801):
        z = np.bincount(rows, v[cols], len(y)) + v[-1]
        g = own * (1 / (1 + np.exp(-z)) - y)
        grad = np.append(np.bincount(cols, g[rows], width) + 0.05 * v[:-1], g.sum())
        w = v - rate * grad / scale
        w[-1] = min(w[-1], most)
        v, old = w + (t - 1) / (t + 2) * (w - old), w
    return w


def score(docs: DataFrame, labels: DataFrame, name: str = SCORE) -> DataFrame:
    """`docs` (doc_id, text, ...) with the score as column `name`; other columns stay."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(character_model(docs))
    given = labels.where((fifth() != 0) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("_y"))
    n = given.count()
    share = min(1.0, TRAIN_ROWS / max(n, 1))
    place = F.xxhash64("_id").bitwiseAND(F.lit((1 << 30) - 1))
    sample = F.broadcast(given.where(place < int(share * (1 << 30))))  # about TRAIN_ROWS rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(sample, "_id")
    train = cut(texts.groupBy("_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("_y").alias("_y")).select("text", "_y"))

    def counted(batches):
        decoder = Decoder(model.value)
        for batch in batches:
            y = batch["_y"].to_numpy()
            for lo, _, row, h in extract(batch["text"], decoder):
                both = np.unique(np.stack((h, row.astype(np.uint64))), axis=1) if len(h) else np.zeros((2, 0), np.uint64)
                u, back = np.unique(both[0], return_inverse=True)
                toxic = np.bincount(back, y[lo + both[1].astype(np.int64)], len(u)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(toxic), pa.array(np.bincount(back, minlength=len(u)).astype(np.int64) - toxic)], names=["h", "a", "b"])

    sizes = train.groupBy("_y").count().collect()  # a few rows
    pos = sum(r[1] for r in sizes if r[0] == 1)
    neg = sum(r[1] for r in sizes if r[0] != 1)
    chosen: list[int] = []
    if pos and neg:
        a, b = F.col("a"), F.col("b")
        df = a + b

        def part(x, expected):
            return F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)

        rate = df / F.lit(float(pos + neg))
        ratio = 2 * (part(a, rate * pos) + part(b, rate * neg) + part(pos - a, (1 - rate) * pos) + part(neg - b, (1 - rate) * neg))
        table = train.mapInArrow(counted, "h long, a long, b long").groupBy("h").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(df >= LEAST_ROWS)
        chosen = [r[0] for r in table.select("h", ratio.alias("r")).where(F.col("r") >= LEAST_RATIO).orderBy(F.desc("r"), "h").limit(FEATURES).collect()]
    keys = np.sort(np.array(chosen, np.int64).view(np.uint64)) if chosen else np.zeros(0, np.uint64)
    keys_b = spark.sparkContext.broadcast(keys)

    def found(column: pa.Array, decoder: Decoder):
        """Distinct (row, feature) of a column."""
        keys = keys_b.value
        rows, cols = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, _, row, h in extract(column, decoder):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[at] == h
                both = np.unique((row[hit] + lo) * len(keys) + at[hit])
                rows.append(both // len(keys)), cols.append(both % len(keys))
        return np.concatenate(rows), np.concatenate(cols)

    def hits(batches):
        decoder = Decoder(model.value)
        for batch in batches:
            rows, cols = found(batch["text"], decoder)
            edges = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch["_y"], pa.array([cols[edges[k] : edges[k + 1]].tolist() for k in range(batch.num_rows)], pa.list_(pa.int32()))], names=["_y", "cols"])

    seen = [(r[0], r[1]) for r in train.mapInArrow(hits, "_y int, cols array<int>").collect()] if pos + neg else []  # the bounded sample's rows (one an id), a few numbers each
    weights = spark.sparkContext.broadcast(fit(seen, len(keys)))
    fields = [f for f in docs.schema.fields if f.name.lower() != name.lower()]
    kinds = [f.name for f in fields]

    def scored(batches):
        decoder, w = Decoder(model.value), weights.value
        for batch in batches:
            rows, cols = found(batch["text"], decoder)
            z = np.bincount(rows, w[cols], batch.num_rows) + w[-1] if len(rows) else np.full(batch.num_rows, w[-1])
            yield pa.RecordBatch.from_arrays([*[batch[k] for k in kinds], pa.array(1 / (1 + np.exp(-z)))], names=[*kinds, name])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.select(*[F.col(f"`{k}`") for k in kinds]).mapInArrow(scored, StructType([*fields, StructField(name, DoubleType())]))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows scored under the threshold, with their own columns."""
    name = free_name(docs, SCORE)
    return score(docs, labels, name).where(F.col(name) < threshold).drop(name)
