"""Operator 10: documents into training sequences by large-item matching.

Every document becomes its token ids and an end id; one longer than a sequence is cut into full pieces, the first piece
taking the rest. Pieces above one third of the capacity stand at most two to a sequence: from the longest down, each is
matched with the longest that still fits beside it, which pairs as many as can be paired. Smaller pieces then go, longest
first, into the tightest gap. All of it runs on the histogram of lengths, at most `capacity` numbers: runs of equal
lengths go into runs of sequences with equal gaps, so the driver holds a few thousand runs at any input size, and a
piece finds its sequence from its rank among the pieces of its length.

Ids are those of `tokenizers` called without special tokens added; a special token that stands in the text is one id.

Null text is empty: one piece, the end id. Ties and repeated rows: each row has its own pieces. Null ids are kept. An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, global_rank

END_ID = 2
#: Parts from this length on are not kept.
LONG = 100
#: White space before a space; the class has all that tokenizers count as white space.
_SPACE_AGAIN = re.compile(r"\s ")


class Encoder:
    """Ids of whole texts as the tokenizers library gives them, as little-endian bytes.

    A text is cut before each space that follows something other than white space. The tokenizer cuts there too: none of its
    patterns goes on from such a place into a space, none looks back, and a special token of the vocabulary holds no space.
    So the ids of a text are those of its parts, which are kept in two generations of at most `keep` parts. A text with
    white space before a space is encoded as a whole.

    A part of characters below U+0250 without a special token is merged by tiktoken, which takes half the time; there both
    libraries' patterns and merges agree (tests try every such character and every token). Others go to tokenizers."""

    def __init__(self, path: str, keep: int = 300_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task is one thread
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.odd = re.compile("|".join(["[^\\x00-\u024f]", *map(re.escape, sorted(special))]))
        self.parts = not any(" " in t for t in special)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in self.tokenizer.get_vocab(False).items()}
        self.bpe = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.keep, self.young, self.old, self.heads = keep, {}, {}, {}

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids if self.odd.search(text) else self.bpe.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not self.parts or _SPACE_AGAIN.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        try:
            ids = list(map(self.young.__getitem__, rest))
        except KeyError:
            ids = self._learn(rest)
        head = self.heads.get(first)
        if head is None:
            head = self.whole(first)
            if len(self.heads) < self.keep and len(first) < LONG:
                self.heads[first] = head
        return head + b"".join(ids)

    def _learn(self, rest: list[str]) -> list[bytes]:
        if len(self.young) > self.keep:
            self.old, self.young = self.young, {}
        here, own = self.young, {}
        for part in set(rest):
            if part not in here:
                (here if len(part) < LONG else own)[part] = self.old.get(part) or self.whole(" " + part)
        return [here[p] if p in here else own[p] for p in rest]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces_of(docs: DataFrame, capacity: int, tokenizer: str) -> DataFrame:
    """A row for each piece: _rid, doc_id, piece, start, length, ids_crc32."""
    schema = "_rid long, doc_id long, piece int, start long, length long, ids_crc32 long"
    end = np.array([END_ID], "<u4").tobytes()

    def cut_up(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            rows = []
            for rid, doc, text in zip(batch["_rid"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"]):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                at, k = 0, 0
                to = (n - 1) % capacity + 1
                while at < n:
                    rows.append((rid, doc, k, at, to - at, zlib.crc32(ids[4 * at : 4 * to])))
                    at, to, k = to, to + capacity, k + 1
                if len(rows) > 50_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    def _batch(rows):
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.monotonically_increasing_id().alias("_rid"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut_up, schema)


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, first rank, last rank + 1, first sequence, pieces per sequence, offset) and the number of sequences."""
    left, used, runs, bins, total = dict(counts), dict.fromkeys(counts, 0), [], [], 0

    def put(length: int, n: int, first: int, each: int, offset: int) -> None:
        runs.append((length, used[length], used[length] + n, first, each, offset))
        used[length] += n
        left[length] -= n

    large = sorted(x for x in counts if 3 * x > capacity)
    for a in reversed(large):
        while left[a]:
            k = bisect_left(large, min(a, capacity - a) + 1) - 1
            while k >= 0 and (not left[large[k]] or large[k] == a and left[a] < 2):
                k -= 1
            if k < 0:
                n = left[a]
                put(a, n, total, 1, 0)
                insort(bins, (capacity - a, total, n))
            else:
                b = large[k]
                n = left[a] // 2 if a == b else min(left[a], left[b])
                put(a, n, total, 1, 0)
                put(b, n, total, 1, a)
                insort(bins, (capacity - a - b, total, n))
            total += n
    for s in sorted((x for x in counts if 3 * x <= capacity), reverse=True):
        while left[s]:
            at = bisect_left(bins, (s, -1, -1))
            if at == len(bins):
                n = -(-left[s] // (capacity // s))
                bins.append((capacity, total, n))
                total += n
            gap, first, n = bins.pop(at)
            each = min(gap // s, left[s])
            full = min(n, left[s] // each)
            put(s, full * each, first, each, capacity - gap)
            insort(bins, (gap - each * s, first, full))
            if n > full:
                insort(bins, (gap, first + full, n - full))
    return runs, total


def pack(docs: DataFrame, capacity: int = 1024, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    pieces = cut(pieces_of(docs, capacity, tokenizer))
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # `capacity` rows at most
    runs, _ = plan(counts, capacity)
    first, at = {}, 0
    for length in sorted(counts):
        first[length], at = at, at + counts[length]
    rows = [(n, first[n] + lo, first[n] + hi, seq, each, offset) for n, lo, hi, seq, each, offset in runs if hi > lo]
    table = F.broadcast(docs.sparkSession.createDataFrame(rows, "length long, _lo long, _hi long, _seq long, _each long, _off long"))
    k = F.col("pos") - F.col("_lo")
    return (
        global_rank(pieces, ["length", "_rid", "piece"]).join(table, "length").where((F.col("pos") >= F.col("_lo")) & (F.col("pos") < F.col("_hi")))
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_seq") + F.floor(k / F.col("_each"))).cast("long").alias("sequence_id"), (F.col("_off") + k % F.col("_each") * F.col("length")).alias("offset"))
    )
