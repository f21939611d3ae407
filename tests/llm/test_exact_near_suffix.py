"""Operators 8, 3 and 4 against brute force on odd documents."""

import hashlib
import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import pyarrow as pa

from twinsieve.llm import exact, near, suffix
from twinsieve.llm.common import bucket_of, by_group, shingles, slices, words
from twinsieve.session import _checkpoint_file, release

BIG = (1 << 63) - 1


def test_normalised_and_composable_fingerprints():
    for t in (b"", b" ", b"a", b"  a \t\n b ", b"a\x0bb", b"\xc3\xa9  x"):
        assert exact.normalised(t) == re.sub(rb"[\x20\x09-\x0D]+", b" ", t)
    text = bytes(np.random.default_rng(3).integers(0, 256, 200_001).astype(np.uint8))
    for cut in (1, 65536, 70_000, 199_999):
        parts = text[:cut], text[cut:]
        value = [np.frombuffer(exact.fingerprint(p)[:16], "<u4").astype(np.uint64) for p in parts]
        assert exact.combine(*value, len(parts[1])).astype("<u4").tobytes() == exact.fingerprint(text)[:16]


def test_exact_groups(docs, rows, none):
    def norm(t):
        return re.sub(rb"[\x20\x09-\x0D]+", b" ", (t or "").encode())

    groups = defaultdict(list)
    for d, t in rows:
        groups[norm(t)].append(BIG if d is None else d)
    want = Counter((d, None if min(groups[norm(t)]) == BIG else min(groups[norm(t)]), len(groups[norm(t)]), hashlib.sha256(norm(t)).hexdigest()) for d, t in rows)
    out = exact.exact_groups(docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == want
    assert sum(r.kept for r in out) == len(groups)
    left = exact.exact_dedup(docs)
    assert left.columns == docs.columns and left.count() == len(groups)
    assert exact.exact_groups(none).count() == 0 and exact.exact_dedup(none).count() == 0


def test_a_fingerprint_of_two_texts_is_split(docs, rows):
    want = Counter(exact.normalised((t or "").encode()) for _, t in rows)
    out = exact.exact_groups(docs, of=lambda text: b"same").collect()  # every text has one fingerprint
    assert sum(r.kept for r in out) == len(want)
    assert sorted(r.group_size for r in out if r.kept) == sorted(want.values())


def test_long_texts_are_hashed_in_pieces(docs, rows, monkeypatch):
    plain = Counter(map(tuple, exact.exact_groups(docs).collect()))
    monkeypatch.setattr(exact, "LONG", 200)
    assert Counter(map(tuple, exact.exact_groups(docs).collect())) == plain


def sets_of(rows):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else []))
    return out


def test_words_and_shingles():
    texts = ["", "  A b\tC ", "x", None, "é É z", "a b c d e f a b c d e"]
    from twinsieve.llm.common import flat

    data, offsets = flat(pa.array(texts))
    h, begins = words(data, offsets)
    assert np.diff(begins).tolist() == [len((t or "").encode().split()) for t in texts]
    assert h[0] == words(*flat(pa.array(["a"])))[0][0]
    assert np.diff(shingles(h, begins)[1]).tolist() == [len(s) for s in sets_of([(0, t) for t in texts])]


def test_near_duplicates(docs, rows, none):
    sets = sets_of(rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(lambda: BIG)
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least[find(i)], BIG if d is None else d)
    want = Counter((d, len(sets[i]), None if least[find(i)] == BIG else least[find(i)]) for i, (d, _) in enumerate(rows))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in near.near_duplicates(docs).collect()) == want
    left = near.near_dedup(docs)
    assert left.columns == docs.columns and left.count() == len({find(i) for i in range(len(rows))})
    assert near.near_duplicates(none).count() == 0


def test_blocks_find_links_between_components_only():
    a, b, c = np.arange(100, dtype=np.uint64), np.arange(10, 110, dtype=np.uint64), np.arange(500, 600, dtype=np.uint64)
    table = pa.table({"node": [1, 2, 3, 4], "label": [1, 2, 3, 1], "shingles": pa.array([x.tobytes() for x in (a, b, c, a[:99])], pa.binary())})
    assert near.across(table).to_pydict() == {"a": [1], "b": [2]}


def test_suffix_array_and_repeated_windows():
    rng = np.random.default_rng(8)
    for _ in range(20):
        text = rng.integers(97, 99, rng.integers(30, 200)).astype(np.uint8)
        starts = np.arange(len(text) - 6)
        seen, want = set(), []
        for s in starts:
            w = text[s : s + 7].tobytes()
            want.append(w in seen)
            seen.add(w)
        assert suffix.repeated(text, starts, 7).tolist() == want


def removed(rows, least=100):
    seen, want = set(), []
    for d, t in sorted(enumerate(rows), key=lambda x: (BIG if x[1][0] is None else x[1][0], x[0])):
        b = (t[1] or "").encode()
        cover = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if b[i : i + least] in seen:
                cover[i : i + least] = b"\1" * least
            seen.add(b[i : i + least])
        left = bytes(x for x, c in zip(b, cover) if not c)
        want.append((t[0], len(b), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(left).hexdigest()))
    return want


def test_repeated_passages(docs, rows, none):
    out = suffix.remove_repeats(docs)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect())
    assert got == Counter(removed(rows))
    assert suffix.remove_repeats(none).count() == 0


def long_repeats():
    """Blocks with one beginning of 160 bytes and a few endings, in any order."""
    rng = np.random.default_rng(9)
    begin, *ends = (rng.integers(97, 123, n).astype(np.uint8).tobytes() for n in (160, *[60] * 4))
    return [begin + ends[k] for k in rng.integers(0, 4, 24)]


def test_windows_longer_than_128_bytes():
    text = np.frombuffer(b"".join(long_repeats()), np.uint8)
    for least in (129, 170, 300):
        starts, seen, want = np.arange(len(text) - least + 1), set(), []
        for s in starts:
            w = text[s : s + least].tobytes()
            want.append(w in seen)
            seen.add(w)
        assert suffix.repeated(text, starts, least).tolist() == want


@pytest.mark.parametrize("least", [21, 200])
def test_repeated_passages_of_other_lengths(spark, least):
    rng = np.random.default_rng(10)
    rows = [(k, (rng.integers(97, 123, 30).astype(np.uint8).tobytes() + b).decode()) for k, b in enumerate(long_repeats())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(docs, least).collect())
    assert got == Counter(removed(rows, least))


def test_least_must_be_longer_than_the_strings_looked_up(docs):
    with pytest.raises(ValueError):
        suffix.remove_repeats(docs, suffix.GRAM)


def test_segments_of_a_slice_take_bounded_memory():
    import tracemalloc

    text = np.random.default_rng(5).integers(97, 123, 4 << 20).astype(np.uint8)
    offsets = np.arange(0, len(text) + 1, 2048)
    suffix.segments(text[:4096], offsets[:3], 100)  # grows the table of powers
    tracemalloc.start()
    many = 0
    for lo, hi in slices(offsets, suffix.SLICE):
        many += int(suffix.segments(text[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], 100)[2].sum())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert many == (len(offsets) - 1) * (2048 - 99)  # every window is in one segment
    assert peak < 48 << 20


def test_keys_fill_buckets_evenly():
    text = np.random.default_rng(6).integers(97, 123, 1 << 18).astype(np.uint8)
    key, plain = (suffix.segments(text, np.array([0, len(text)]), 100)[k] for k in (3, 7))
    for keys in (key, plain):
        filled = np.bincount(bucket_of(keys, 64).astype(int), minlength=64)
        assert filled.max() < 2 * filled.mean() and filled.min() > 0


def test_hot_groups_meet_without_an_anti_join(spark):
    rows = spark.createDataFrame([(7, k) for k in range(300)] + [(k, k) for k in range(20, 60)] + [(None, k) for k in range(50)], "key long, x long").checkpoint()
    groups = spark.createDataFrame([(7, 300, "hot"), *((k, 1, "rare") for k in range(20, 40))], "key long, many long, name string").checkpoint()
    out = by_group(rows, groups, "key", "many")
    assert "LeftAnti" not in out._jdf.queryExecution().executedPlan().toString()
    want = Counter([(7, "hot")] * 300 + [(k, "rare" if k < 40 else None) for k in range(20, 60)] + [(None, None)] * 50)
    assert Counter((r.key, r.name) for r in out.collect()) == want


def test_small_checkpoints_are_read_by_few_tasks(spark):
    df = near.cut(spark.range(1000).repartition(90))
    assert df._jdf.queryExecution().toRdd().getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in df.collect()) == list(range(1000))
    path = _checkpoint_file(df)
    release(df)
    assert path and not os.path.exists(path.removeprefix("file:"))
