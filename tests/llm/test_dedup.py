"""Line dedup and SimHash near-duplicates against brute force."""

import numpy as np
import xxhash
from llm_brute import lower, words
from pyspark.sql import functions as F

from equilens.llm import line_dedup, simhash


def brute_lines(rows, spans=(3,)):
    """Kept lines of (id, text) rows: windows of every span in the order of id and position; windows
    of three lines hold a word, shorter ones over 50."""
    gone = {}
    for n in spans:
        seen = set()
        for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
            lines = (t or "").split("\n")
            for p in range(len(lines) - n + 1 if t is not None else 0):
                w = tuple(lines[p:p + n])
                if len(words("\n".join(w))) > (0 if n == 3 else 50):
                    if w in seen:
                        gone.setdefault((i, t), set()).update(range(p, p + n))
                    seen.add(w)
    return {(i, t): None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone.get((i, t), ()))
            for i, t in rows}


def test_lines_match_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = line_dedup.dedup_lines(docs.withColumn("was", F.col("text")), removed_lines="cut")
    assert out.columns == [*docs.columns, "was", "cut"]
    got = out.collect()
    assert len(got) == len(rows)
    want = brute_lines(rows)
    for r in got:
        assert r.text == want[(r.doc_id, r.was)]
    two = [r for r in got if r.doc_id == 2]
    assert [r.text for r in two] == ["other end"] * 2 and two[0].cut == [0, 1, 2]


def test_lines_overlap_and_self_repeat(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "z\na\nb\nc\nd\ny"), (3, "x\nx\nx\nx\nx\nx"), (4, "b\nc\nd\nb\nc\nd")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: t for (i, _), t in brute_lines(rows).items()}
    assert got[2] == "z\ny" and got[1] == "a\nb\nc\nd"


def test_lines_of_an_empty_table(spark, docs):
    assert line_dedup.dedup_lines(docs.limit(0)).collect() == []


def test_long_passages_of_one_and_two_lines(spark):
    long, a, b = " ".join(f"w{i}" for i in range(51)), " ".join(["a"] * 26), " ".join(["b"] * 25)
    fifty = " ".join(["c"] * 50)
    rows = [(1, f"{long}\none"), (2, long), (3, f"x\n{long}\ny\nz"), (4, f"{a}\n{b}"), (5, f"p\n{a}\n{b}\nq"), (6, a),
            (7, fifty), (8, fifty), (9, None), (10, ""), (11, f"{long}\n{long}"), (12, "k\nl\nm"), (13, "k\nl\nm\nn")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.cut) for r in line_dedup.dedup_lines(frame, removed_lines="cut", long_words=50).collect()}
    want = dict(rows) | {2: "", 3: "x\ny\nz", 5: "p\nq", 8: fifty, 11: "", 13: "n"}
    assert {i: t for i, (t, _) in got.items()} == want
    assert got[3][1] == [1] and got[5][1] == [1, 2] and got[11][1] == [0, 1] and got[8][1] == []
    # the pipeline's stage takes them out as well
    import corpus_pipeline
    assert {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, frame, "").collect()} == want
    # without the option the three-line rule stands alone
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(frame).collect()} == {i: t for (i, _), t in brute_lines(rows).items()}


def fingerprint(text):
    w = words(lower(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, radius=2):
    """Smallest id reachable, by all pairs; ``fps``: (id, fingerprint)."""
    u = sorted({f for _, f in fps})
    up = list(range(len(u)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(u)):
        for j in range(i):
            if (u[i] ^ u[j]).bit_count() <= radius:
                up[find(i)] = find(j)
    low = {}
    for i, f in fps:
        r = find(u.index(f))
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return {f: low.get(find(k)) for k, f in enumerate(u)}


def test_fingerprints_and_components(spark, docs):
    rows = docs.collect()
    near = simhash.near_duplicates(docs).select("doc_id", simhash.hex16(F.col("fp")).alias("h"), "component_id").collect()
    fps = [(r.doc_id, fingerprint(r.text)) for r in rows]
    low = classes(fps)
    assert sorted(map(str, [(i, f"{f:016x}", low[f]) for i, f in fps])) == sorted(str(tuple(r)) for r in near)


def test_links_match_all_pairs_with_hot_cells(spark):
    """Chains of near fingerprints, crowded cells and small chunks."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 12)
    fps = set(base.tolist()) | set(rng.integers(0, 1 << 62, 400).tolist())
    for b in base.tolist():
        x = b
        for _ in range(30):                      # a chain: each link within two bits, the ends far apart
            x ^= (1 << int(rng.integers(0, 62))) | (1 << int(rng.integers(0, 62)))
            fps.add(x)
        for _ in range(60):                      # a crowd
            fps.add(b ^ (1 << int(rng.integers(0, 62))))
    fps = sorted(fps)
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = classes([(f, f) for f in fps])
    for chunk in (16, 4096):
        roots = {r.node: r.root for r in simhash.components(simhash.link_edges(frame, chunk=chunk)).collect()}
        assert {f: roots.get(f, f) for f in fps} == want


def test_keep_one(spark, docs):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    fps = [(r.doc_id, fingerprint(r.text)) for r in docs.collect()]
    low = classes(fps)
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(low.values()) | {None} if None in low.values() else set(low.values()))
    assert sorted(i for i in ids if i is not None) == sorted({v for v in low.values() if v is not None})
    assert simhash.keep_one(docs.limit(0)).collect() == []
