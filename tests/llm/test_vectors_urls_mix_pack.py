"""Operators 1, 5, 6, 9 and 10 and the pipeline."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from twinsieve.llm import bloom, embeddings, mixing, packing, sharding, urls
from twinsieve.llm.queries import URL_RULES
from twinsieve.session import ship


def test_bloom_has_no_false_negatives(spark):
    ids = spark.range(3000).selectExpr("xxhash64(id) h", "id")
    f = bloom.build(ids.where("id < 1500"), "h", 1500)
    h = np.array([r.h for r in ids.orderBy("id").collect()], np.int64)
    hit = bloom.probe(f, h)
    assert hit[:1500].all() and hit[1500:].mean() < 0.05


def judged(url, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        at = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:at]), rest[at:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fit = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        return host, path, max(fit)[1], max(fit)[2]
    return host, path, None, "block" if url in listed else "allow"


def test_url_rules(spark):
    ship(spark)
    made = [f"http{s}://{h}{p}{q}" for s, h, p, q in itertools.product(("", "s"), ("example.com", "WWW.Example.com", "a.b.net", "net", "xnet", "org", "m.bad.org"), ("", "/", "/en/", "/en", "/es/x", "/fr/"), ("", "?a=/en/", "#f"))]
    made += [None, "", "no scheme", "://", "http://", "http://com", "x://y://z.com/q", "http://bad.org/page.html"]
    listed = {"http://bad.org/page.html", "http://m.bad.org/page"}
    pages = spark.createDataFrame([(k if k % 9 else None, u, "h", "r") for k, u in enumerate(made)] + [(1, made[1], "h", "r")], "page_id long, url string, host string, rule string")
    block = urls.listed_table(spark.createDataFrame([("https://bad.org/page/",)], "url string"))
    want = Counter((k if k % 9 else None, *judged(u, listed)) for k, u in enumerate(made)) + Counter([(1, *judged(made[1], listed))])
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, URL_RULES, block).collect()) == want
    assert urls.judge(pages.where("page_id < 0"), URL_RULES, block).count() == 0


def test_every_page_of_a_listed_host_is_listed(spark, tmp_path, monkeypatch):
    from twinsieve.llm.queries import LISTED_NAMES, op1_url_filter

    ship(spark)
    hosts = [f"{pre}{name}.example.{top}{port}" for pre, top, port in itertools.product(("", "www.", "m.", "Blog."), ("com", "net", "org"), ("", ":8080")) for name in (*LISTED_NAMES, "fine", "not-spam-farm")]
    made = [f"http://{h}/{lang}/{k}{end}" for h, (lang, k, end) in itertools.product(hosts, (("en", 7, ""), ("de", 123_456, "?page=2"), ("es", 1000, ".html")))] + [None, "", "spam-farm.example.net"]
    spark.createDataFrame(list(enumerate(made)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    listed = {u for u in made if u and any(f"/{name}." in u or f".{name}." in u for name in LISTED_NAMES)}
    want = {k: (*judged(u, listed)[2:], u in listed) for k, u in enumerate(made)}
    got = op1_url_filter(spark, str(tmp_path)).collect()
    assert len(got) == len(made) and {r.page_id: (r.rule, r.verdict, r.listed) for r in got} == want
    monkeypatch.setattr(urls, "MAX_BROADCAST_ROWS", 0)
    assert {r.page_id: (r.rule, r.verdict, r.listed) for r in op1_url_filter(spark, str(tmp_path)).collect()} == want


def test_lattice_decoder_is_nearest():
    x = np.random.default_rng(1).normal(size=(50, 8)) * 2
    c, n = embeddings.decode(x), embeddings.neighbours()
    assert len(n) == 240 and np.allclose((n**2).sum(1), 2) and (np.round(2 * c) == 2 * c).all() and ((c.sum(1) % 2) == 0).all()
    own = ((x - c) ** 2).sum(1)
    assert all(own[i] <= ((x[i] - c[i] - n) ** 2).sum(1).min() + 1e-9 for i in range(50))


def test_near_vectors(spark):
    ship(spark)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 64))
    vectors = [(i, (centres[i % 30] + rng.normal(size=64) * rng.choice([0.02, 0.1, 0.14])).astype(np.float32).tolist(), i % 2) for i in range(240)]
    vectors += [(300 + i, vectors[0][1], 0) for i in range(5)] + [(310, vectors[0][1], None), (311, vectors[0][1], 1)]
    vectors += [(320, None, 0), (321, [0.0] * 64, 0), (322, [float("nan")] * 64, 0), (323, [], 0), (324, [1.0], 0), (None, vectors[3][1], 1), (5, vectors[5][1], 1)]
    df = spark.createDataFrame([(a, b, c, 9) for a, b, c in vectors], "vec_id long, embedding array<float>, label int, node long")
    good = [v for v in vectors if v[1] and v[2] is not None and np.isfinite(v[1]).all() and np.any(v[1])]
    links, total = defaultdict(int), 0
    for i, j in itertools.combinations(range(len(good)), 2):
        a, b = np.array(good[i][1]), np.array(good[j][1])
        if good[i][2] == good[j][2] and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
            links[i] += 1
            links[j] += 1
            total += 1
    out = embeddings.near_groups(df).collect()
    assert len(out) == len(vectors)
    assert sum(r.n_links for r in out) >= 0.99 * 2 * total and sum(r.n_links for r in out) <= 2 * total
    assert all(r.n_links == 0 and r.kept for r in out if r.vec_id in (310, 320, 321, 322, 323, 324))
    assert embeddings.near_groups(df.where("vec_id < 0")).count() == 0


def test_best_fit_decreasing_equals_one_by_one():
    rng = random.Random(3)
    for _ in range(30):
        items = [rng.randint(1, 40) for _ in range(rng.randint(0, 120))]
        runs, shards = sharding.best_fit_decreasing(list(Counter(items).items()), 50)
        rooms = []
        for s in sorted(items, reverse=True):
            fit = [k for k, r in enumerate(rooms) if r >= s]
            if fit:
                rooms[min(fit, key=lambda k: rooms[k])] -= s
            else:
                rooms.append(50 - s)
        assert shards == len(rooms) and sum(n for _, _, n in runs) == len(items)
        used = Counter()
        for s, k, n in runs:
            used[k] += s * n
        assert sorted(50 - u for u in used.values()) == sorted(rooms)


def test_shards_of_documents(docs, rows, none):
    out = sharding.shard_documents(docs, shards=4).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(4))
    home = defaultdict(set)
    for r in out:
        home[r.text_crc32, r.size].add(r.shard)
    assert all(len(h) == 1 for h in home.values())
    assert sharding.shard_documents(none).count() == 0
    packed = sharding.shard_documents(docs, capacity=400_000).collect()
    assert len(packed) == len(rows)


def test_packing_plan_is_whole_and_tight():
    rng = random.Random(6)
    for _ in range(40):
        lengths = [rng.randint(1, 100) for _ in range(rng.randint(0, 400))]
        runs, total = packing.plan(dict(Counter(lengths)), 100)
        place, seen = defaultdict(list), Counter()
        for n, lo, hi, seq, each, offset in runs:
            for rank in range(lo, hi):
                k = rank - lo
                place[seq + k // each].append((offset + k % each * n, n))
            seen[n] += hi - lo
        assert seen == Counter(lengths)
        for parts in place.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= 100
        assert len(place) == total <= (sum(lengths) / 100) * 1.25 + 12


def test_pieces_of_documents(docs, rows, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want = Counter()
    for d, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        at, to, k = 0, (len(ids) - 1) % 1024 + 1, 0
        while at < len(ids):
            want[d, k, at, to - at, zlib.crc32(np.array(ids[at:to], "<u4").tobytes())] += 1
            at, to, k = to, to + 1024, k + 1
    out = packing.pack(docs).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    assert packing.pack(none).count() == 0


def test_raking_meets_the_marginals(spark):
    rng = random.Random(2)
    cells = [(s, l, p, rng.randint(1, 500)) for s in "abc" for l in ("en", "de") for p in "xy"]
    df = spark.createDataFrame(cells, "_ts_source string, _ts_lang string, _ts_topic string, t long")
    out = mixing.rake(df, [{"a": 1, "b": 1, "c": 2}, {"en": 0.3, "de": 0.7}, {"x": 0.5, "y": 0.5}]).collect()
    for k, want in ((0, {"a": 0.25, "b": 0.25, "c": 0.5}), (1, {"en": 0.3, "de": 0.7}), (2, {"x": 0.5, "y": 0.5})):
        got = Counter()
        for r in out:
            got[r[k]] += r.w
        assert all(abs(got[c] - w) < 1e-4 for c, w in want.items())


def test_mixing_of_documents(docs, none):
    out = mixing.weighed(docs, keep=0.6).collect()
    tokens = sum(r._ts_tokens for r in out)
    assert len(out) == docs.count() and abs(sum(r._ts_tokens * r._ts_p for r in out) - 0.6 * tokens) < 0.02 * tokens
    kept = mixing.mix(docs, keep=0.6)
    assert kept.columns == docs.columns and kept.count() == sum(r._ts_in for r in out)
    assert mixing.mix(none).count() == 0


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline(spark, docs, empty, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    own = docs.where("doc_id is not null").select("doc_id", "text", "lang", "source", "n_chars")
    (own.where("doc_id < 0") if empty else own).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, k % 2) for k in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    out = corpus_pipeline.run(spark, folder).collect()
    assert bool(out) != empty
    by = defaultdict(int)
    for r in out:
        by[r.sequence_id] += r.length
    assert all(n <= 1024 for n in by.values())


def kept_by_brute_force(rows):
    """Of each component of texts with a Jaccard similarity of 0.75 or more over shingles of five words, the smallest id."""
    sets = []
    for r in rows:
        w = (r.text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else []))
    home = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if home[i] != home[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and sets[i] and sets[j]:
            a, b = home[i], home[j]
            home = [a if x == b else x for x in home]
    first = {}
    for k in sorted(range(len(rows)), key=lambda k: rows[k].doc_id):
        first.setdefault(home[k], k)
    return [rows[k] for k in first.values()]


def test_no_stage_of_the_pipeline_loses_rows(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline
    from twinsieve.llm import toxicity

    ship(spark)
    folder = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    given, got = [], []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        given.append((docs, docs.collect()))
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        got.append(docs.collect())
    assert all(len({r.doc_id for r in rows}) == len(rows) > 20 for _, rows in given)
    score = {r.doc_id: r._ts_toxicity for r in toxicity.score(given[0][0], labels).collect()}
    assert Counter(got[0]) == Counter(r for r in given[0][1] if score[r.doc_id] < 0.5)
    first = {}
    for r in sorted(given[1][1], key=lambda r: r.doc_id):
        first.setdefault(re.sub("[\t-\r ]+", " ", r.text or ""), r)
    assert Counter(got[1]) == Counter(first.values())
    assert Counter(got[2]) == Counter(kept_by_brute_force(given[2][1]))
    taken = {r.doc_id for r in mixing.weighed(given[3][0]).collect() if r._ts_in}
    assert Counter(got[3]) == Counter(r for r in given[3][1] if r.doc_id in taken)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want = Counter()
    for r in given[4][1]:
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [2]
        edges = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        want.update((r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(itertools.pairwise(edges)))
    pieces = lambda rows: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert pieces(got[4]) == want == pieces(corpus_pipeline.run(spark, folder).collect())


def test_sql_twins_on_odd_rows(spark, docs, tmp_path):
    import duckdb

    from twinsieve.llm import queries

    ship(spark)
    folder = str(tmp_path)
    odd = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(900 + k, t) for k, t in enumerate(["a\x0bb", "a \n b", "a\xa0b", " a b", "a b", "a\x1fb"])], "doc_id long, text string"))
    odd.write.parquet(f"{folder}/documents.parquet")
    made = [None, "", "x", "http://com", "HTTP://Free-Bets.example.net:443/en/1.html?x#y", "https://m.free-bets.example.net/en/1/", "http://a.b.adult-x.org:80/a\nb/", "http://net/es/", "http://www.example.com/en/", "http://www.example.com/en/"]
    spark.createDataFrame([(k if k % 3 else None, u) for k, u in enumerate(made)], "page_id long, url string").write.parquet(f"{folder}/pages.parquet")
    with duckdb.connect() as db:
        for name, of in (("op1_url_filter", "pages"), ("op8_polynomial_exact_dedup", "documents")):
            db.sql(f"CREATE VIEW {of} AS SELECT * FROM '{folder}/{of}.parquet/*.parquet'")
            out, twin = queries.queries()[name](spark, folder), db.sql(queries.oracle_sql()[name])
            assert out.columns == twin.columns and Counter(map(tuple, out.collect())) == Counter(twin.fetchall())


def test_cells_of_vectors_do_not_depend_on_the_size_of_the_input(spark, monkeypatch):
    ship(spark)
    used, cell_rows = [], embeddings.cell_rows
    monkeypatch.setattr(embeddings, "cell_rows", lambda *a: used.append(a) or cell_rows(*a))
    df = spark.createDataFrame([(i, [1.0, float(i)] * 4, 0) for i in range(4)], "vec_id long, embedding array<float>, label int")
    got = []
    for bound in (10**9, 0):
        monkeypatch.setattr(embeddings, "WIDE_FROM", bound, raising=False)
        got.append(sorted(tuple(r) for r in embeddings.near_groups(df).collect()))
    assert used[0] == used[1] and got[0] == got[1]
