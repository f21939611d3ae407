"""Operator 8: exact duplicates by composable polynomial fingerprints.

White space runs count as one space. A text is hashed in chunks of 64 KiB, each a polynomial over its bytes modulo four
primes; the fingerprint of two parts in a row is that of the first times the base to the length of the second, plus that
of the second, so chunks may be hashed anywhere and joined in order. A text of LONG bytes or more is dealt over the
cluster chunk by chunk: a chunk knows the byte before it, so it drops what continues a run of white space, and the row's
fingerprint is put together from the chunks' values and lengths. Shorter texts are hashed where they are read.

Texts whose fingerprints and lengths agree are then compared chunk by chunk: an aggregation over (fingerprint, chunk
number, bytes) in which equal chunks fold before the exchange, so a group of any size never meets in one task, and no text
travels but one chunk of each kind a task. The texts to compare are found by a Bloom filter of the fingerprints that occur
twice; what it lets through besides has no partner. Chunks of long texts are cut anew at their places in the normalised
text. A fingerprint that covers different texts is split by SHA-256. Groups of many rows are joined by broadcast (a
thousand at most have a thousandth of all rows each), others by their key.

Null text is the empty text. Of repeated rows with the smallest id one stays. Null ids come last. Very long texts are
taken chunk by chunk; an empty table gives an empty result; other columns play no part and may have any name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import bloom
from .common import LAST_ID, by_group, cut, order_id, settled, with_row_ids, without_rows

CHUNK = 1 << 16
#: Bytes from which the chunks of a text are hashed by many tasks.
LONG = 8 << 20
PRIMES = np.array([2147483647, 2147483629, 2147483587, 2147483579], np.uint64)
BASES = np.array([1103515245, 1664525013, 1284865837, 1540483477], np.uint64)
_powers = np.ones((1, 4), np.uint64)
_SPACES = b" \t\n\x0b\x0c\r"


def normalised(text: bytes) -> bytes:
    """Each run of white space as one space."""
    parts = text.split()
    if not parts:
        return b" " if text else b""
    return (b" " if text[:1].isspace() else b"") + b" ".join(parts) + (b" " if text[-1:].isspace() else b"")


def continued(part: bytes, before: bytes) -> bytes:
    """The normalised form of a part that follows the byte `before` (empty at the beginning)."""
    return normalised(part.lstrip(_SPACES) if before.isspace() else part)


def chunk_fingerprint(chunk: bytes) -> np.ndarray:
    """Polynomial values of at most CHUNK bytes, modulo each prime."""
    global _powers
    if len(_powers) == 1:
        p = np.ones((CHUNK, 4), np.uint64)
        for k in range(CHUNK - 2, -1, -1):
            p[k] = p[k + 1] * BASES % PRIMES
        _powers = p
    b = np.frombuffer(chunk, np.uint8).astype(np.uint64) + np.uint64(1)
    return b @ _powers[CHUNK - len(b) :] % PRIMES


def combine(first: np.ndarray, second: np.ndarray, length: int) -> np.ndarray:
    """The fingerprint of two parts in a row; `length` is the second's."""
    shift = np.array([pow(int(b), length, int(p)) for b, p in zip(BASES, PRIMES)], np.uint64)
    return (first * shift + second) % PRIMES


def put_together(parts: list[tuple[np.ndarray, int]]) -> bytes:
    """The fingerprint of parts in a row, each with its values and its length."""
    value, size = np.zeros(4, np.uint64), 0
    for own, length in parts:
        value = combine(value, own, length) if size else own
        size += length
    return value.astype("<u4").tobytes() + size.to_bytes(8, "little")


def fingerprint(text: bytes) -> bytes:
    chunks = [text[at : at + CHUNK] for at in range(0, len(text), CHUNK)]
    return put_together([(chunk_fingerprint(c), len(c)) for c in chunks])


def _raw(column: pa.Array):
    for t in column.cast(pa.binary()):
        yield t.as_buffer().to_pybytes() if t.is_valid else b""


def _fingerprints(of, batches):
    for batch in batches:
        texts = list(map(normalised, _raw(batch["text"])))
        yield pa.RecordBatch.from_arrays([batch["_ts_rid"], batch["_oid"], pa.array(list(map(of, texts)), pa.binary()), pa.array([hashlib.sha256(t).hexdigest() for t in texts])], names=["_ts_rid", "_oid", "fp", "text_sha256"])


def _pieces(long: DataFrame) -> DataFrame:
    """(_ts_rid, _oid, k, before, part): the raw chunks of long texts, dealt over the cluster."""
    raw = long.select("_ts_rid", "_oid", F.col("text").cast("binary").alias("raw"))
    at = F.explode(F.sequence(F.lit(0), F.floor((F.length("raw") - 1) / CHUNK).cast("int")))
    cut_up = raw.select("_ts_rid", "_oid", at.alias("k"), "raw").select("_ts_rid", "_oid", "k", F.when(F.col("k") > 0, F.substring("raw", F.col("k") * CHUNK, F.lit(1))).otherwise(F.lit(b"")).alias("before"), F.substring("raw", F.col("k") * CHUNK + 1, F.lit(CHUNK)).alias("part"))
    return cut_up.repartition("_ts_rid", "k")


def _piece_values(batches):
    for batch in batches:
        parts = [continued(p, b) for p, b in zip(_raw(batch["part"]), _raw(batch["before"]))]
        values = [chunk_fingerprint(p).astype("<u4").tobytes() for p in parts]
        yield pa.RecordBatch.from_arrays([batch["_ts_rid"], batch["_oid"], batch["k"], pa.array(values, pa.binary()), pa.array([len(p) for p in parts], pa.int32())], names=["_ts_rid", "_oid", "k", "value", "size"])


def _join_pieces(batches):
    for batch in batches:
        prints = []
        for pieces in batch["pieces"].to_pylist():
            prints.append(put_together([(np.frombuffer(p["value"], "<u4").astype(np.uint64), p["size"]) for p in pieces]))
        yield pa.RecordBatch.from_arrays([batch["_ts_rid"], batch["_oid"], pa.array(prints, pa.binary())], names=["_ts_rid", "_oid", "fp"])


def _chunks(of, known, batches):
    """(fp, no, part) of the texts whose fingerprint may occur twice."""
    for batch in batches:
        fps, nos, parts, size = [], [], [], 0
        for text in map(normalised, _raw(batch["text"])):
            fp = of(text)
            if not bloom.probe(known.value, np.array([_short(fp)], np.int64))[0]:
                continue
            for no, at in enumerate(range(0, len(text), CHUNK)):
                fps.append(fp), nos.append(no), parts.append(text[at : at + CHUNK])
                size += len(parts[-1])
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(fps, pa.binary()), pa.array(nos, pa.int32()), pa.array(parts, pa.binary())], names=["fp", "no", "part"])
                    fps, nos, parts, size = [], [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(fps, pa.binary()), pa.array(nos, pa.int32()), pa.array(parts, pa.binary())], names=["fp", "no", "part"])


def _short(fp: bytes) -> int:
    """64 bits of a fingerprint."""
    return int.from_bytes(hashlib.blake2b(fp, digest_size=8).digest(), "little", signed=True)


@F.pandas_udf(LongType())
def _short_of(fp):
    return fp.map(_short)


def _cut_anew(batches):
    """Pieces of long texts as (fp, _ts_rid, no, at, bytes), cut at multiples of CHUNK of the normalised text."""
    for batch in batches:
        out = [[], [], [], [], []]
        for rid, fp, at, part, before in zip(batch["_ts_rid"].to_pylist(), batch["fp"].to_pylist(), batch["at"].to_pylist(), _raw(batch["part"]), _raw(batch["before"])):
            text, done = continued(part, before), 0
            while done < len(text):
                to = min(len(text), done + CHUNK - (at + done) % CHUNK)
                for column, x in zip(out, (fp, rid, (at + done) // CHUNK, (at + done) % CHUNK, text[done:to])):
                    column.append(x)
                done = to
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], names=["fp", "_ts_rid", "no", "at", "bytes"])


def _digests(batches):
    for batch in batches:
        digests = [hashlib.sha256(normalised(t)).hexdigest() for t in _raw(batch["text"])]
        yield pa.RecordBatch.from_arrays([batch["_ts_rid"], pa.array(digests)], names=["_ts_rid", "text_sha256"])


def _several(rows: DataFrame) -> DataFrame:
    return rows.groupBy("fp").agg(F.min(F.struct("_oid", "_ts_rid")).alias("_first"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")


def groups(docs: DataFrame, of=fingerprint) -> DataFrame:
    """_ts_rid, _oid, text_sha256, _keep (order id of the row that stays), group_size, kept for each row of `docs`, a scan or a
    checkpoint. `of` gives a short text's fingerprint."""
    spark = docs.sparkSession
    own = with_row_ids(docs).select("_ts_rid", order_id().alias("_oid"), "text")
    is_long = F.coalesce(F.octet_length("text") >= LONG, F.lit(False))
    short, long = own.where(~is_long), own.where(is_long)
    pieces = cut(_pieces(long).mapInArrow(_piece_values, "_ts_rid long, _oid long, k int, value binary, size int"))
    any_long = bool(pieces.limit(1).count())
    schema = "_ts_rid long, _oid long, fp binary, text_sha256 string"
    rows = short.mapInArrow(lambda batches: _fingerprints(of, batches), schema)
    if any_long:
        put = pieces.groupBy("_ts_rid", "_oid").agg(F.array_sort(F.collect_list(F.struct("k", "value", "size"))).alias("pieces"))
        digests = long.select("_ts_rid", "text").mapInArrow(_digests, "_ts_rid long, text_sha256 string")  # one pass over a whole text each
        rows = rows.unionByName(put.mapInArrow(_join_pieces, "_ts_rid long, _oid long, fp binary").join(digests, "_ts_rid").select("_ts_rid", "_oid", "fp", "text_sha256"))
    rows = cut(rows)
    several = cut(_several(rows))
    n = several.count()
    if not n:
        return rows.select("_ts_rid", "_oid", "text_sha256", F.col("_oid").alias("_keep"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    known = spark.sparkContext.broadcast(bloom.build(several.select(_short_of("fp").alias("h")), "h", n))
    parts = short.select("text").mapInArrow(lambda batches: _chunks(of, known, batches), "fp binary, no int, part binary")
    if any_long:
        sized = pieces.groupBy("_ts_rid").agg(F.array_sort(F.collect_list(F.struct("k", "size"))).alias("p"))
        places = sized.select("_ts_rid", F.posexplode("p").alias("i", "x"), "p").select("_ts_rid", F.col("x.k").alias("k"), F.aggregate(F.slice("p", F.lit(1), F.col("i")), F.lit(0).cast("long"), lambda a, x: a + x["size"]).alias("at"))
        again = _pieces(long).join(rows.join(several.select("fp"), "fp", "left_semi").select("_ts_rid", "fp"), "_ts_rid").join(places, ["_ts_rid", "k"])
        anew = again.select("_ts_rid", "fp", "at", "part", "before").mapInArrow(_cut_anew, "fp binary, _ts_rid long, no int, at int, bytes binary")
        whole = anew.groupBy("fp", "_ts_rid", "no").agg(F.array_sort(F.collect_list(F.struct("at", "bytes"))).alias("b"))
        parts = parts.unionByName(whole.select("fp", "no", F.aggregate("b", F.lit(b""), lambda a, x: F.concat(a, x["bytes"])).alias("part")))
    kinds = parts.groupBy("fp", "no", "part").count().groupBy("fp", "no").agg(F.count(F.lit(1)).alias("kinds"))
    clash = cut(kinds.where("kinds > 1").select("fp").distinct())
    if clash.limit(1).count():
        mixed = rows.join(clash, "fp", "left_semi").withColumn("fp", F.unhex("text_sha256"))
        rows = cut(rows.join(clash, "fp", "left_anti").unionByName(mixed))
        several = cut(_several(rows))
    placed = by_group(rows, several, "fp", "group_size")
    return placed.select("_ts_rid", "_oid", "text_sha256", F.coalesce("_first._oid", "_oid").alias("_keep"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.coalesce(F.col("_first._ts_rid") == F.col("_ts_rid"), F.lit(True)).alias("kept"))


def _id(column: str):
    return F.when(F.col(column) != LAST_ID, F.col(column))


def exact_groups(docs: DataFrame, of=fingerprint) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row."""
    return groups(settled(docs), of).select(_id("_oid").alias("doc_id"), _id("_keep").alias("keep_id"), "group_size", "kept", "text_sha256")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The rows that stay, with their own columns. Rows are told apart by their place, so `docs` that isn't a scan or a
    checkpoint is made one."""
    docs = settled(docs)
    return without_rows(docs, groups(docs).where("not kept").select("_ts_rid"))
