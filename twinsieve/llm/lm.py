"""Operator 2: language-model scoring with a log-frequency Bloom filter.

Counts of words and word pairs are gathered over the training rows, quantised to q = 1 + floor(log2 count), and each
n-gram is entered at levels 1 to q; its quantised count is read back by probing level after level until one fails. The
score interpolates by absolute discounting: P(w|h) = max(c(hw) - D, 0) / c(h) + lambda * P(w), with D from the counts of
counts, c the mean count of a level, and lambda the mass that D takes from contexts of the level of h, both measured.

Counting sends arrays, not rows: a task sorts its hashes and sends each bucket one packed row, and a bucket is merged by
one task at a time; there are as many as the table's size asks for (`buckets_of`). A filter is a segment to each bucket, with BITS bits an
entry at any size. While all segments have at most MAX_BROADCAST bytes they are broadcast; beyond that rows are scored in
chunks of text, which gives the same numbers: a chunk asks each bucket for its distinct words beyond the commonest, HEAD at
most, which are broadcast with their counts and levels, and for its distinct pairs, one packed row to a bucket, and the
answers come back in the order of the hashes, a byte to a pair. So nothing travels by token, and no sum by row and bucket.
The base score is exact: words beyond the commonest are looked up in the count table by bucket.

Words are told apart by 64-bit hashes. Null and blank texts have one token, the end. Null ids hash as the empty text (a
training row) and stay null. Repeated rows are rows; an empty table gives an empty result; other columns are ignored.
Without training rows every count is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, buckets_of, cut, flat, mix, slices, words

HEAD, LEVELS = 1 << 20, 48
BITS, PROBES = 12, 8
MAX_BROADCAST = 128 << 20
END = np.uint64(0x2545F4914F6CDD1D)
_G = np.uint64(0x9E3779B97F4A7C15)
#: Tokens (or hashes) that a task folds at a time: sorting takes some hundred bytes each.
_MERGE = 1 << 20
#: Bytes of text to a chunk, or one slice or row more.
CHUNK_BYTES = 6 << 20


def pieces(data: np.ndarray, offsets: np.ndarray):
    """(first row, tokens with an end after each row, where each row begins) of slices of texts end to end."""
    for lo, hi in slices(offsets):
        h, begins = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        yield lo, np.insert(h, begins[1:], END), begins + np.arange(len(begins))


def stream(column: pa.Array):
    """The pieces of a text column."""
    return pieces(*flat(column))


def pairs(tokens: np.ndarray) -> np.ndarray:
    """Hashes of each token with the one before it; a row's first follows an end."""
    return mix(np.concatenate(([END], tokens[:-1])) * np.uint64(0xD1342543DE82EF95) + tokens)


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1].clip(0, LEVELS).astype(np.uint8)


def _packed(n: int, h: np.ndarray, *more: np.ndarray):
    """Rows (bucket, hashes, ...) of sorted hashes."""
    edges = np.searchsorted(bucket_of(h, n), np.arange(n + 1).astype(np.uint64))
    full = np.flatnonzero(np.diff(edges))
    cuts = [(edges[b], edges[b + 1]) for b in full]
    return [pa.array(full.astype(np.int32))] + [pa.array([x[lo:hi].tobytes() for lo, hi in cuts], pa.binary()) for x in (h, *more)]


def _fold(h: np.ndarray, c: np.ndarray | None, extra: np.ndarray | None = None):
    """Sums of counts by hash, sorted; without counts each hash counts once."""
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(h))) if c is None else np.add.reduceat(c[order], first) if len(first) else c[:0]
    return h[first], counts, extra[order[first]] if extra is not None else None


class LogFrequencyFilter:
    """Segments of bits end to end; `of` reads quantised counts."""

    def __init__(self, n: int, segments: list[tuple[int, int, bytes]]) -> None:
        self.n, self.m, self.at, self.k = n, np.ones(n, np.uint64), np.zeros(n, np.uint64), PROBES
        bits, at = [np.zeros(8, np.uint8)], 64
        for bucket, k, raw in segments:
            self.m[bucket], self.at[bucket], self.k = 8 * len(raw), at, k
            bits.append(np.frombuffer(raw, np.uint8))
            at += 8 * len(raw)
        self.bits = np.concatenate(bits)

    @staticmethod
    def segment(h: np.ndarray, q: np.ndarray, bits: float) -> tuple[int, bytes]:
        k = max(1, min(PROBES, round(0.69 * bits)))  # PROBES at BITS
        m = np.uint64(max(64, int(q.sum() * bits / 8 + 8) * 8))
        out = np.zeros(int(m) // 8, np.uint8)
        for level in range(1, int(q.max(initial=0)) + 1):
            h, q = h[q >= level], q[q >= level]
            x = mix(h + np.uint64(level * int(_G) & (1 << 64) - 1))
            a, b = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32) | np.uint64(1)
            for i in range(k):
                p = (a + np.uint64(i) * b) % m
                np.bitwise_or.at(out, (p >> np.uint64(3)).astype(np.int64), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))
        return k, out.tobytes()

    def of(self, h: np.ndarray) -> np.ndarray:
        out, alive = np.zeros(len(h), np.uint8), np.arange(len(h))
        b = bucket_of(h, self.n).astype(np.int64)
        m, at = self.m[b], self.at[b]
        for level in range(1, LEVELS + 1):
            if not len(alive):
                break
            x = mix(h[alive] + np.uint64(level * int(_G) & (1 << 64) - 1))
            a, b = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32) | np.uint64(1)
            for i in range(self.k):
                p = at[alive] + (a + np.uint64(i) * b) % m[alive]
                hit = (self.bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
                alive, a, b = alive[hit], a[hit], b[hit]
            out[alive] = level
        return out

    def of_repeated(self, h: np.ndarray) -> np.ndarray:
        u, back = np.unique(h, return_inverse=True)
        return self.of(u)[back]


def _by_bucket(df: DataFrame) -> DataFrame:
    return df.repartition("bucket").sortWithinPartitions(*(c for c in ("bucket", "tag") if c in df.columns))


def _grouped(batches, names):
    """(bucket, list of rows) from rows in the order of buckets."""
    at, rows = None, []
    for batch in batches:
        columns = [batch[n] for n in names]
        for i, bucket in enumerate(batch["bucket"].to_pylist()):
            if bucket != at and rows:
                yield at, rows
                rows = []
            at = bucket
            rows.append([c[i].as_buffer() if c[i].is_valid and pa.types.is_binary(c.type) else c[i].as_py() for c in columns])
    if rows:
        yield at, rows


def _word_counts(train: DataFrame, n: int) -> DataFrame:
    def count(batches):
        held, size = [], 0

        def send():
            h = np.concatenate(held)
            return pa.RecordBatch.from_arrays(_packed(n, *_fold(h, None)[:2]), names=["bucket", "h", "c"])

        for batch in batches:
            for _, tokens, _ in stream(batch["text"]):
                held.append(tokens)
                size += len(tokens)
                if size >= _MERGE:
                    yield send()
                    held, size = [], 0
        if held:
            yield send()

    def merge(batches):
        for bucket, rows in _grouped(batches, ["h", "c"]):
            h, c, _ = _fold(np.concatenate([np.frombuffer(r[0], np.uint64) for r in rows]), np.concatenate([np.frombuffer(r[1], np.int64) for r in rows]))
            q = levels_of(c)
            stats = np.stack([np.bincount(q, minlength=LEVELS + 1), np.bincount(q, c, minlength=LEVELS + 1)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([h.tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary()), pa.array([stats.tolist()], pa.list_(pa.list_(pa.int64())))], names=["bucket", "h", "c", "stats"])

    return cut(_by_bucket(train.select("text").mapInArrow(count, "bucket int, h binary, c binary")).mapInArrow(merge, "bucket int, h binary, c binary, stats array<array<long>>"))


def _stats(df: DataFrame, rows: int) -> np.ndarray:
    """Sums of a small matrix over the buckets; its size does not depend on the data."""
    wide = LEVELS + 1
    got = df.agg(*[F.coalesce(F.sum(F.col("stats")[i][j]), F.lit(0)) for i in range(rows) for j in range(wide)]).first()
    return np.array(got, float).reshape(rows, wide)


def _segments(df: DataFrame) -> list[tuple[int, int, bytes]]:
    return [(r[0], r[1], bytes(r[2])) for r in df.select("bucket", "k", "bits").toLocalIterator()]


def _word_filter(counts: DataFrame, n: int, least: int) -> DataFrame:
    """Segments, and the hashes, counts and filter levels of the words of level `least` or more."""

    def build(batches):
        for batch in batches:
            for bucket, h, c in zip(batch["bucket"].to_pylist(), batch["h"], batch["c"]):
                h, c = np.frombuffer(h.as_buffer(), np.uint64), np.frombuffer(c.as_buffer(), np.int64)
                q = levels_of(c)
                k, raw = LogFrequencyFilter.segment(h, q, BITS)
                h, c = h[q >= least], c[q >= least]
                level = LogFrequencyFilter(n, [(bucket, k, raw)]).of(h)
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([k], pa.int32()), *[pa.array([x], pa.binary()) for x in (raw, h.tobytes(), c.tobytes(), level.tobytes())]], names=["bucket", "k", "bits", "h", "c", "q"])

    return cut(counts.select("bucket", "h", "c").mapInArrow(build, "bucket int, k int, bits binary, h binary, c binary, q binary"))


class Words:
    """Counts and levels of words, which are distinct and sorted: by the broadcast filter, else by the commonest words; what
    neither has is asked for."""

    def __init__(self, sieve, head, rest_of: bool) -> None:
        self.sieve, self.head, self.asks = sieve, head, rest_of or sieve is None

    def _place(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hh = self.head.value[0]
        at = np.minimum(np.searchsorted(hh, u), max(len(hh) - 1, 0))
        return at, hh[at] == u if len(hh) else np.zeros(len(u), bool)

    def asked(self, u: np.ndarray) -> np.ndarray:
        return u[~self._place(u)[1]]

    def of(self, u: np.ndarray, c: np.ndarray | None, q: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """With the answers to what was asked, if anything was."""
        at, own = self._place(u)
        counts, levels = np.zeros(len(u), np.int64), np.zeros(len(u), np.uint8)
        for out, column, told in ((counts, 1, c), (levels, 2, q if self.sieve is None else None)):
            out[own] = self.head.value[column][at[own]]
            if told is not None:
                out[~own] = told
        return counts, levels if self.sieve is None else self.sieve.value.of(u)


def _before(tokens: np.ndarray) -> np.ndarray:
    """The context of each token."""
    return np.concatenate(([END], tokens[:-1]))


def _batch(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=names)


_CHUNK = "chunk long, ids array<long>, held array<boolean>, sizes binary, raw long, text binary"


def _chunks(own: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, text) as chunks of texts end to end, compressed; a chunk is named by an id of its first row, for
    several partitions may be one task's to write."""

    def pack(batches):
        held, size = [], 0

        def send():
            chunk = held[0][4]
            ids, out, sizes, data, _ = zip(*held)
            data = b"".join(data)
            columns = [pa.array([chunk]), pa.array([sum(ids, [])], pa.list_(pa.int64())), pa.array([sum(out, [])], pa.list_(pa.bool_())), pa.array([np.concatenate(sizes).tobytes()], pa.binary()), pa.array([len(data)]), pa.array([pa.compress(data, "zstd", asbytes=True)], pa.binary())]
            return _batch(columns, ["chunk", "ids", "held", "sizes", "raw", "text"])

        for batch in batches:
            data, offsets = flat(batch["text"])
            for lo, hi in slices(offsets):
                held.append((batch["doc_id"].slice(lo, hi - lo).to_pylist(), batch["held_out"].slice(lo, hi - lo).to_pylist(), np.diff(offsets[lo : hi + 1]), data[offsets[lo] : offsets[hi]].tobytes(), batch["rid"][lo].as_py()))
                size += int(offsets[hi] - offsets[lo])
                if size >= CHUNK_BYTES or sum(len(x[0]) for x in held) >= _MERGE:
                    yield send()
                    held, size = [], 0
        if held:
            yield send()

    return cut(own.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "held_out", "text").mapInArrow(pack, _CHUNK))


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of a chunk, and where each row begins (one more at the end)."""
    offsets = np.concatenate(([0], np.cumsum(np.frombuffer(row["sizes"], np.int64))))
    data = np.frombuffer(pa.decompress(row["text"], row["raw"], "zstd", asbytes=True), np.uint8) if row["raw"] else np.zeros(0, np.uint8)
    tokens, begins, at = [], [], 0
    for _, h, b in pieces(data, offsets):
        tokens.append(h)
        begins.append(b[:-1] + at)
        at += len(h)
    return np.concatenate(tokens), np.append(np.concatenate(begins), at)


def _asked(chunks: DataFrame, n: int, which) -> DataFrame:
    """(bucket, chunk, a): a packed row to each bucket of the distinct sorted hashes that `which` chooses from a chunk's tokens."""

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                bucket, h = _packed(n, which(_opened(row)[0]))
                yield _batch([bucket, pa.array(np.full(len(bucket), row["chunk"])), h], ["bucket", "chunk", "a"])

    return chunks.mapInArrow(ask, "bucket int, chunk long, a binary")


def _narrow(c: np.ndarray) -> bytes:
    """Counts in as many bytes each as the largest needs, which the first byte tells; most have one."""
    wide = next(k for k in (1, 2, 4, 8) if c.max(initial=0) < 1 << 8 * k - (k == 8))
    return bytes([wide]) + c.astype(f"<u{wide}").tobytes()


def _widened(parts: list[bytes]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64) for x in parts if x)])


def _answers(asked: DataFrame, n: int, segments: DataFrame | None, counts: DataFrame | None) -> DataFrame:
    """(chunk, bucket, c, q): the counts and filter levels of asked hashes, in their order."""
    rows = asked.select("bucket", F.lit(2).alias("tag"), "chunk", "a", F.lit(None).cast("binary").alias("b"))
    for tag, table, a, b in ((0, segments, "bits", F.lit(None).cast("binary")), (1, counts, "h", F.col("c"))):
        if table is not None:
            rows = rows.unionByName(table.select("bucket", F.lit(tag).alias("tag"), F.lit(None).cast("long").alias("chunk"), F.col(a).alias("a"), b.alias("b")))
    with_levels, with_counts = segments is not None, counts is not None

    def tell(batches):
        at, own, counted, held, size = None, None, None, [], 0

        def send():
            u, back = np.unique(np.concatenate([h for _, h in held]), return_inverse=True)
            ends = np.cumsum([0] + [len(h) for _, h in held])
            q, c = np.zeros(len(u), np.uint8), np.zeros(len(u), np.int64)
            if own is not None:
                q = own.of(u)
            if counted is not None and len(counted[0]):
                k = np.minimum(np.searchsorted(counted[0], u), len(counted[0]) - 1)
                c = np.where(counted[0][k] == u, counted[1][k], 0)
            told = [pa.array([out(x[lo:hi]) for lo, hi in zip(ends, ends[1:])], pa.binary()) if wanted else pa.nulls(len(held), pa.binary()) for x, out, wanted in ((c[back], _narrow, with_counts), (q[back], np.ndarray.tobytes, with_levels))]
            return _batch([pa.array([chunk for chunk, _ in held], pa.int64()), pa.array(np.full(len(held), at, np.int32)), *told], ["chunk", "bucket", "c", "q"])

        for batch in batches:
            for bucket, tag, chunk, a, b in zip(*(batch[k].to_pylist() for k in ("bucket", "tag", "chunk", "a", "b"))):
                if bucket != at:
                    if held:
                        yield send()
                    at, own, counted, held, size = bucket, None, None, [], 0
                if tag == 0:
                    own = LogFrequencyFilter(n, [(bucket, PROBES, a)])
                elif tag == 1:
                    counted = np.frombuffer(a, np.uint64), np.frombuffer(b, np.int64)
                else:
                    held.append((chunk, np.frombuffer(a, np.uint64)))
                    size += len(held[-1][1])
                    if size >= _MERGE:
                        yield send()
                        held, size = [], 0
        if held:
            yield send()

    return _by_bucket(rows).mapInArrow(tell, "chunk long, bucket int, c binary, q binary")


def _met(chunks: DataFrame, answers: list[DataFrame | None], do, schema: str) -> DataFrame:
    """`do`(chunk, for each of the answers its counts and levels end to end) for each chunk, whose answers come to it."""
    many = len(answers)
    rows = chunks.select(F.lit(many).alias("tag"), F.lit(0).alias("bucket"), "*")
    for tag, told in enumerate(answers):
        if told is not None:
            rows = rows.unionByName(told.select(F.lit(tag).alias("tag"), "bucket", "chunk", "c", "q"), allowMissingColumns=True)
    rows = rows if "q" in rows.columns else rows.select("*", *[F.lit(None).cast("binary").alias(k) for k in "cq"])
    given = [told is not None for told in answers]

    def meet(batches):
        got = [([], []) for _ in range(many)]
        for batch in batches:
            for row in batch.to_pylist():
                if row["tag"] < many:
                    for held, k in zip(got[row["tag"]], "cq"):
                        held.append(row[k] or b"")
                    continue
                yield from do(row, [(_widened(c), np.frombuffer(b"".join(q), np.uint8)) if ok else (None, None) for ok, (c, q) in zip(given, got)])
                got = [([], []) for _ in range(many)]

    return rows.repartition("chunk").sortWithinPartitions("chunk", "tag", "bucket").mapInArrow(meet, schema)


def _pair_filter(train: DataFrame, n: int, known: Words, chunks: DataFrame | None, told: DataFrame | None) -> DataFrame:
    """Segments and, by the level of the context, types and tokens; by the level of the pair the same; counts of counts."""

    def packed(h, levels):
        h, c, q = _fold(h, None, levels)
        return _batch(_packed(n, h, c.astype(np.uint32), q), ["bucket", "h", "c", "q"])

    def count(batches):
        held, size = [], 0

        def send():
            h, c, x = _fold(np.concatenate([y[0] for y in held]), None, np.concatenate([y[1] for y in held]))
            return _batch(_packed(n, h, c.astype(np.uint32), known.sieve.value.of_repeated(x)), ["bucket", "h", "c", "q"])

        for batch in batches:
            for _, tokens, _ in stream(batch["text"]):
                held.append((pairs(tokens), _before(tokens)))
                size += len(tokens)
                if size >= _MERGE:
                    yield send()
                    held, size = [], 0
        if held:
            yield send()

    def count_chunk(row, answers):
        tokens, begins = _opened(row)
        u, back = np.unique(tokens, return_inverse=True)
        levels = known.of(u, *answers[0])[1][back]
        levels = np.concatenate((levels[-1:], levels[:-1]))  # a chunk's last token is an end
        learnt = np.repeat(np.array([x is False for x in row["held"]]), np.diff(begins))
        if learnt.any():
            yield packed(pairs(tokens)[learnt], levels[learnt])

    def merge(batches):
        for bucket, rows in _grouped(batches, ["h", "c", "q"]):
            h, c, ctx = _fold(np.concatenate([np.frombuffer(r[0], np.uint64) for r in rows]), np.concatenate([np.frombuffer(r[1], np.uint32) for r in rows]).astype(np.int64), np.concatenate([np.frombuffer(r[2], np.uint8) for r in rows]))
            q = levels_of(c)
            k, raw = LogFrequencyFilter.segment(h, q, BITS)
            ones = np.zeros(LEVELS + 1)
            ones[:2] = (c == 1).sum(), (c == 2).sum()
            wide = LEVELS + 1
            stats = [np.bincount(ctx, minlength=wide), np.bincount(ctx, c, minlength=wide), np.bincount(q, minlength=wide), np.bincount(q, c, minlength=wide), ones]
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([k], pa.int32()), pa.array([raw], pa.binary()), pa.array([np.array(stats).astype(np.int64).tolist()], pa.list_(pa.list_(pa.int64())))], names=["bucket", "k", "bits", "stats"])

    schema = "bucket int, h binary, c binary, q binary"
    counted = train.select("text").mapInArrow(count, schema) if chunks is None else _met(chunks, [told], count_chunk, schema)
    return cut(_by_bucket(counted).mapInArrow(merge, "bucket int, k int, bits binary, stats array<array<long>>"))


def _means(types: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    guess = np.concatenate(([0.0], 1.5 * 2.0 ** np.arange(len(types) - 1)))
    return np.where(types > 0, tokens / np.maximum(types, 1), guess)


def _log_p(m: dict, q: np.ndarray, ctx: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """log10 probabilities from the levels of token, context and pair."""
    p = (m["word"][q] + 0.5) / (m["total"] + 0.5 * (m["types"] + 1))
    seen = np.maximum(m["pair"][pair] - m["discount"], 0) * (pair > 0) / np.maximum(m["word"][ctx], 1)
    return np.log10(np.where(ctx > 0, np.minimum(seen, 1 - m["discount"] / np.maximum(m["word"][ctx], 1)) + m["back"][ctx] * p, p))


def score(docs: DataFrame, held_out: F.Column, max_broadcast: int = MAX_BROADCAST, head_size: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row; learns from rows not held out."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    n = buckets_of(docs)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    train = own.where(~F.col("held_out"))
    counts = _word_counts(train, n)
    w = _stats(counts, 2)
    types, total = int(w[0].sum()), int(w[1].sum())
    entries = float((w[0] * np.arange(w.shape[1])).sum())
    least = next(q for q in range(1, LEVELS + 2) if w[0][q:].sum() <= head_size)
    word_rows = _word_filter(counts, n, least)
    got = list(word_rows.select("h", "c", "q").toLocalIterator())  # `head_size` words at most
    hs, cs, qs = (np.frombuffer(b"".join(bytes(r[k]) for r in got), kind) for k, kind in enumerate((np.uint64, np.int64, np.uint8)))
    order = np.argsort(hs)
    head = sc.broadcast((hs[order], cs[order], qs[order]))
    words_filter = sc.broadcast(LogFrequencyFilter(n, _segments(word_rows))) if entries * BITS / 8 <= max_broadcast else None
    rest_of = types > len(hs)
    known_words = Words(words_filter, head, rest_of)

    def asked_words() -> DataFrame | None:
        return cut(_answers(_asked(chunks, n, lambda tokens: known_words.asked(np.unique(tokens))), n, word_rows if words_filter is None else None, counts)) if known_words.asks else None

    chunks = told = None
    if words_filter is None:
        chunks = _chunks(own)
        told = asked_words()
    pair_rows = _pair_filter(train, n, known_words, chunks, told)
    s = _stats(pair_rows, 5)
    n1, n2 = s[4, :2]
    discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.75
    model = {"word": _means(w[0], w[1]), "pair": _means(s[2], s[3]), "discount": discount, "back": np.where(s[1] > 0, discount * s[0] / np.maximum(s[1], 1), 1.0), "total": total, "types": types}
    size = pair_rows.agg(F.coalesce(F.sum(F.length("bits")), F.lit(0))).first()[0]
    pair_filter = sc.broadcast(LogFrequencyFilter(n, _segments(pair_rows))) if size <= max_broadcast and words_filter else None
    floor = total + 0.5 * (types + 1)
    if pair_filter is None:
        if chunks is None:
            chunks = _chunks(own)
            told = asked_words()

        def judge(row, answers):
            tokens, begins = _opened(row)
            many = len(begins) - 1
            of = np.repeat(np.arange(many), np.diff(begins))
            u, back = np.unique(tokens, return_inverse=True)
            c, q = known_words.of(u, *answers[0])
            base, known = np.bincount(of, np.log10((c + 0.5) / floor)[back], many), np.bincount(of, (c > 0)[back], many)
            q = q[back]
            ctx = np.concatenate((q[-1:], q[:-1]))  # a chunk's last token is an end
            _, back = np.unique(pairs(tokens), return_inverse=True)
            own_score = np.bincount(of, _log_p(model, q, ctx, answers[1][1][back]), many)
            yield _batch([pa.array(row["ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(np.diff(begins)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(own_score)], ["doc_id", "held_out", "n_tokens", "n_known", "base", "model"])

        of_pairs = _answers(_asked(chunks, n, lambda tokens: np.unique(pairs(tokens))), n, pair_rows, None)
        out = _met(chunks, [told, of_pairs], judge, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double")
        return _result(out, total)
    schema = "bucket int, tag int, rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, a binary, b binary"
    kinds = {"bucket": pa.int32(), "tag": pa.int32(), "rid": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "model": pa.float64(), "a": pa.binary(), "b": pa.binary()}

    def rows(**columns) -> pa.RecordBatch:
        many = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns[k].cast(t) if k in columns else pa.nulls(many, t) for k, t in kinds.items()], names=list(kinds))

    def read(batches):
        """A row for each document (tag 0), and packed questions to the count table (1)."""
        hh, hc, _ = head.value
        for batch in batches:
            for lo, tokens, begins in stream(batch["text"]):
                many = len(begins) - 1
                rid = batch["rid"].slice(lo, many).to_numpy()
                of = np.repeat(np.arange(many), np.diff(begins))
                u, back = np.unique(tokens, return_inverse=True)
                at = np.minimum(np.searchsorted(hh, u), max(len(hh) - 1, 0))
                c = np.where(hh[at] == u, hc[at], 0) if len(hh) else np.zeros(len(u), np.int64)
                asked = (c == 0) if rest_of else np.zeros(len(u), bool)
                base = np.bincount(of, np.where(asked, 0.0, np.log10((c + 0.5) / floor))[back], many)
                known = np.bincount(of, (c > 0)[back], many)
                q = words_filter.value.of(u)[back]
                ctx = np.concatenate((q[-1:], q[:-1]))  # a slice's last token is an end
                model_score = np.bincount(of, _log_p(model, q, ctx, pair_filter.value.of_repeated(pairs(tokens))), many)
                yield rows(tag=pa.array(np.zeros(many, np.int32)), rid=pa.array(rid), doc_id=batch["doc_id"].slice(lo, many), held_out=batch["held_out"].slice(lo, many), n_tokens=pa.array(np.diff(begins)), n_known=pa.array(known.astype(np.int64)), base=pa.array(base), model=pa.array(model_score))
                ask = np.flatnonzero(asked[back])
                if len(ask):
                    ask = ask[np.argsort(tokens[ask])]
                    b, h, r = _packed(n, tokens[ask], rid[of[ask]])
                    yield rows(bucket=b, tag=pa.array(np.ones(len(b), np.int32)), a=h, b=r)

    def sums(rid: np.ndarray, *values: np.ndarray) -> list[pa.Array]:
        u, back = np.unique(rid, return_inverse=True)
        return [pa.array(u)] + [pa.array(np.bincount(back, v, len(u))) for v in values]

    def look_up(batches):
        at, h, c = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for bucket, tag, a, b in zip(batch["bucket"].to_pylist(), batch["tag"].to_pylist(), batch["a"], batch["b"]):
                if tag == 0:
                    at, h, c = bucket, np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.int64)
                    continue
                ask, rid = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.int64)
                found = np.zeros(len(ask), np.int64)
                if at == bucket and len(h):
                    k = np.minimum(np.searchsorted(h, ask), len(h) - 1)
                    found = np.where(h[k] == ask, c[k], 0)
                yield pa.RecordBatch.from_arrays(sums(rid, np.log10((found + 0.5) / floor), found > 0), names=["rid", "base", "n_known"])

    asked = cut(own.select(F.monotonically_increasing_id().alias("rid"), "*").mapInArrow(read, schema))
    out = asked.where("tag = 0").select("rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "model")
    if rest_of:
        of_counts = asked.where("tag = 1").select("bucket", "tag", "a", "b")
        answers = _by_bucket(of_counts.unionByName(counts.select("bucket", F.lit(0).alias("tag"), F.col("h").alias("a"), F.col("c").alias("b")))).mapInArrow(look_up, "rid long, base double, n_known double")
        out = out.join(answers.groupBy("rid").agg(F.sum("base").alias("_b"), F.sum("n_known").alias("_k")), "rid", "left").withColumn("base", F.col("base") + F.coalesce("_b", F.lit(0.0))).withColumn("n_known", F.col("n_known") + F.coalesce("_k", F.lit(0.0)).cast("long")).drop("_b", "_k")
    return _result(out, total)


def _result(out: DataFrame, total: int) -> DataFrame:
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("model").alias("score"))


def fifth(doc_id: str = "doc_id") -> F.Column:
    """The remainder by 5 of the CRC-32 of an id as text; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5
