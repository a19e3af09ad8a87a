"""Top-k search, mixing, WARC archives and the pipeline against brute force."""

import base64
import hashlib
from collections import defaultdict

import numpy as np
import pytest
from llm_brute import words
from pyspark.sql import functions as F

from equilens.llm import mixing, topk_search, warc
from equilens.llm.queries import QUERIES


# ---------------------------------------------------------------- top-k

def brute_topk(rows, is_query, k):
    dim = max(len(v) for v in rows.values())
    full = {i: np.array(list(v) + [0] * (dim - len(v)), dtype=object) for i, v in rows.items()}
    out = set()
    for q in filter(is_query, rows):
        best = sorted(((-int(full[q] @ full[c]), c) for c in rows if c != q))[:k]
        out |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(best)}
    return out


@pytest.mark.parametrize("case", ["clusters", "copies", "ragged", "tiny", "large"])
def test_topk(spark, case, monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(topk_search, "STRIP", 32)
    n = {"tiny": 3}.get(case, 600)
    v = rng.integers(-40, 40, (n, 8)) + rng.integers(-300, 300, (6, 8))[rng.integers(0, 6, n)]
    if case == "copies":
        v[: n // 2] = v[0]
    if case == "large":
        v = v * 2_000_000
    rows = {i: v[i].tolist()[: 8 - (i % 3 if case == "ragged" else 0)] for i in range(n)}
    monkeypatch.setattr(topk_search, "build_index", lambda x, f=topk_search.build_index: f(x, 200, 64))
    frame = spark.createDataFrame([*rows.items(), (None, [1] * 8), (n + 5, None), next(iter(rows.items()))], "id long, v array<long>")
    got = topk_search.search(frame, F.col("id") % 5 == 0, 7).collect()
    assert {tuple(r) for r in got} == brute_topk(rows, lambda i: i % 5 == 0, 7) and len(got) == len({tuple(r) for r in got})


def test_annuli_fill_blocks(spark):
    """Vectors of one length without clusters: nothing can be left out, so blocks must be full."""
    v = np.random.default_rng(4).normal(0, 8, (5000, 24)).round().astype(int)
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<long>")
    index, _, directory = topk_search.build_index(frame, block_rows=512)
    sizes = [r["count"] for r in index.groupBy("block").count().collect()]
    assert sum(sizes) == 5000 and len(sizes) <= 13 and len(directory) > 100          # 9.8 full blocks, 128 cells
    assert {d[3] for d in directory} == {r.block for r in index.select("block").distinct().collect()}


def test_bounds_leave_rows_of_other_clusters_unscored(monkeypatch):
    """On clustered vectors of one length a query scores its own cluster's part of the rows, with the right result."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (32, 32))
    centres *= 1000 / np.linalg.norm(centres, axis=1)[:, None]
    x = np.rint(centres[rng.integers(0, 32, 8000)] + rng.normal(0, 10, (8000, 32))).astype(np.int64)
    geo = topk_search.Geometry(x[:2000], float((x * x).sum(axis=1).max()), 32)
    cell, dist = geo.key(x)
    scored = []
    monkeypatch.setattr(topk_search, "STRIP", 64)
    monkeypatch.setattr(topk_search, "_products", lambda q, r, f=topk_search._products: (scored.append(len(q) * len(r)), f(q, r))[1])
    ids = np.arange(8000)
    for q in range(0, 8000, 100):
        s = x @ x[q]
        floor = np.sort(np.delete(s, q))[-20:-19]                                    # the final bound of this query
        _, who, top = topk_search._search_block(ids, x, dist, cell, geo, ids[q:q + 1], x[q:q + 1], floor, 20)
        assert list(zip(who, top)) == sorted(zip(np.delete(ids, q), np.delete(s, q)), key=lambda t: (-t[1], t[0]))[:20]
    assert sum(scored) < 0.1 * 80 * 8000


def test_topk_of_nothing(spark):
    frame = spark.createDataFrame([(1, None)], "id long, v array<long>")
    assert topk_search.search(frame, F.lit(True)).collect() == []


def test_quantize_leaves_out_bad_vectors(spark):
    rows = [(1, [0.5, -0.01]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, None), (5, [None, 1.0]), (6, [])]
    got = spark.createDataFrame(rows, "i int, e array<float>").select("i", topk_search.quantize(F.col("e")).alias("v")).collect()
    assert {r.i: r.v for r in got} == {1: [32, -1], 2: None, 3: None, 4: None, 5: None, 6: []}


# ---------------------------------------------------------------- mixing

def brute_targets(size):
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + ([None] if None in size else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(size.values()), {}
    while True:
        rest = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = {s: 3.0 * size[s] for s in rest if share[s] > 3 * size[s]}
        if not over:
            return {**capped, **share}
        capped |= over


def test_targets(spark):
    for sizes in [{"a": 10, "b": 1000, "c": 5, None: 50}, {"a": 7}, {"a": 0, "b": 4}, {"z": 1, "é": 100, "A": 1, "b": 1, "c": 900}]:
        frame = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r.source: r.target for r in mixing.targets(frame).collect()}
        for s, t in brute_targets(sizes).items():
            assert abs(got[s] - t) < 1e-6 * max(t, 1), (sizes, s)


def test_mix_takes_what_the_targets_ask(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE_ROWS", 7)
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    plan = mixing.assign(rows, keep=("doc_id", "source")).collect()
    again = mixing.assign(rows.repartition(5), keep=("doc_id", "source")).collect()
    assert sorted(map(str, plan)) == sorted(map(str, again)) and len(plan) == rows.count()
    size, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in plan:
        size[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size) and all(0 <= p <= 1 for p in r.positions)
    target = brute_targets(size)
    for r in plan:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 * r.target
    for s in size:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1


def test_position_inverts_the_schedule(spark):
    rows = [(y / 10, b) for y in range(11) for b in (-1.0, -0.4, 0.0, 0.7, 1.0)]
    frame = spark.createDataFrame(rows, "y double, b double").withColumn("t", mixing.position_at(F.col("y"), F.col("b")))
    for r in frame.collect():
        assert abs(r.t + r.b * (r.t * r.t - r.t) - r.y) < 1e-9


def test_mix_stream(spark, docs):
    stream = mixing.mix(docs)
    assert stream.columns == docs.columns
    ids = [r.doc_id for r in stream.collect()]
    plan = mixing.assign(docs).collect()
    want = sorted((str(r.doc_id) for r in plan for _ in r.positions))
    assert sorted(map(str, ids)) == want and all(r.taken == 0 for r in plan if not r.size)
    assert mixing.mix(docs.limit(0)).collect() == []


# ---------------------------------------------------------------- WARC

def brute_records(rows):
    best = {}
    for i, h in rows:
        if i is not None:
            best[h or ""] = max(best.get(h or "", i), i)
    out = []
    for i, h in rows:
        b = (h or "").encode()
        m = best.get(h or "")
        other = m is not None and m != i
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if other else "response", m if other else None))
    return sorted(map(str, out))


@pytest.fixture()
def pages(spark):
    rows = [(i, f"http://h{i % 7}.example.com:80{i % 2}/p?q={i % 11}", "<p>hot</p>" if i % 3 else f"<p>{i}\r\n\r\nWARC/1.1 é</p>") for i in range(200)]
    rows += [(300, None, None), (301, "", ""), (302, "not a url\n", "x" * 200_000), (None, "http://a.b/", "<p>hot</p>"),
             (303, "http://[bad", "y"), (304, "http://a.b:99999/", "z"), (305, "http://a.b/", "z"), (305, "http://a.b/", "z")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(1)).withColumn("payload", F.lit("?"))


def test_archives_round_trip(spark, pages, tmp_path):
    folder, directory = warc.build(pages, f"file://{tmp_path}/w", block=8, file_bytes=5000)
    got = warc.read_archives(directory, folder).collect()
    rows = [(r.page_id, r.html) for r in pages.collect()]
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == brute_records(rows)
    html = {i: h for i, h in rows}
    for r in got:
        if r.record_type == "response" and r.page_id is not None:
            assert bytes(r.payload).decode() == (html[r.page_id] or "")


def test_archives_are_gzip_members_in_key_order(spark, pages, tmp_path):
    import gzip
    folder, directory = warc.build(pages, f"file://{tmp_path}/w", block=8)
    n = 0
    for f in (tmp_path / "w").glob("*.warc.gz"):
        n += gzip.decompress(f.read_bytes()).count(b"WARC-Record-ID: <urn:equilens:page:")
    assert n == pages.count()
    rows = sorted(directory.collect(), key=lambda d: (d.first_key, d.last_key))
    assert all(a.last_key <= b.first_key for a, b in zip(rows, rows[1:])) and sum(d.captures for d in rows) == n


def test_lookup(spark, pages, tmp_path):
    folder, directory = warc.build(pages, f"file://{tmp_path}/w", block=4)
    for asked in (["http://h3.example.com:801/p?q=4", "https://nowhere/"], [None], ["http://a.b/", "http://a.b/"]):
        got = warc.lookup(directory, folder, spark.createDataFrame([(u,) for u in asked], "url string")).collect()
        keys = {warc.url_key(u) for u in asked}
        assert sorted(str(r.page_id) for r in got) == sorted(str(r.page_id) for r in pages.collect() if warc.url_key(r.url) in keys)


def test_query_looks_every_url_up(spark, pages, tmp_path, monkeypatch):
    """The registered query searches the index; it gives what a scan of the archives gives."""
    pages.select("page_id", "url", "html").write.parquet(f"{tmp_path}/pages.parquet")
    folder, directory = warc.build(pages, f"file://{tmp_path}/w", block=4, min_bytes=0)
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    want = sorted(map(str, warc.read_archives(directory, folder).select(*cols).collect()))
    monkeypatch.setattr(warc, "read_archives", None)
    got = sorted(map(str, QUERIES["op9_warc"](spark, str(tmp_path)).collect()))
    assert got == want and len(got) == pages.count()


def test_small_payloads_are_responses(spark, pages, tmp_path):
    folder, directory = warc.build(pages, f"file://{tmp_path}/w", min_bytes=50)
    assert warc.read_archives(directory, folder).where("record_type = 'revisit'").count() == 0


def test_no_pages(spark, pages, tmp_path):
    folder, directory = warc.build(pages.limit(0), f"file://{tmp_path}/w")
    assert warc.read_archives(directory, folder).collect() == []


def test_url_keys():
    assert warc.url_key("HTTP://Www.Example.com:8080/A/b?c#d") == "com,example,www:8080)/A/b?c"
    assert [warc.url_key(u) for u in (None, "", "http://[x", "a.b/c")] == ["", "", "http://[x", "b,a)/c"]


# ---------------------------------------------------------------- pipeline

def test_pipeline(spark):
    """Stages one by one: clean documents stay, each decision is the operator's own, tokens decode."""
    import corpus_pipeline as cp
    from test_dedup import brute_lines, classes, fingerprint
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    calm = cp.drop_toxic(spark, docs, sf)
    assert calm.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in calm.collect()]
    assert len(rows) > 0.7 * docs.count()
    lines = cp.drop_repeated_lines(spark, calm, sf)
    after = {r.doc_id: (r.text, r.n_chars) for r in lines.collect()}
    want = brute_lines(rows, spans=(1, 2, 3))
    assert after == {i: (t, len(t)) for (i, _), t in want.items()}
    once = cp.drop_near_copies(spark, lines, sf)
    low = classes([(i, fingerprint(t)) for i, (t, _) in after.items()])
    assert sorted(r.doc_id for r in once.collect()) == sorted(low.values())
    mixed = cp.mix_sources(spark, once, sf)
    assert mixed.columns == docs.columns
    taken, size = defaultdict(int), defaultdict(int)
    for r in once.collect():
        size[r.source] += len(words(r.text))
    for r in mixed.collect():
        taken[r.source] += len(words(r.text))
    for s, t in brute_targets(size).items():
        assert abs(taken[s] - t) <= max(len(words(r.text)) for r in once.collect() if r.source == s) / 2 + 1
    last = cp.encode(spark, mixed, sf)
    got = last.collect()
    assert len(got) == mixed.count() and all(r.round_trip for r in got)
    ran = cp.run(spark, sf)
    assert sorted((r.doc_id, r.n_tokens) for r in ran.collect()) == sorted((r.doc_id, r.n_tokens) for r in got)


def test_pipeline_stages_take_odd_rows(spark, docs):
    import corpus_pipeline as cp
    sf = "/root/testdata/sf0.001"
    odd = docs.select("doc_id", "text", "lang", "source", F.col("size").alias("n_chars"))
    for frame in (odd, odd.limit(0)):
        for _, stage in cp.STAGES:
            frame = stage(spark, frame, sf)
        assert frame.count() >= 0


def test_registered_queries():
    assert {k.split("_")[0] for k in QUERIES} == {f"op{n}" for n in range(1, 14)}
