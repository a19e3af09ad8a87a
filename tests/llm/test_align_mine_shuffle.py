"""Hard negatives, token alignment and the distinct-word codec against brute force and the public libraries."""

import hashlib
import re
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from equilens.llm import hard_negatives, token_align, word_shuffle
from equilens.llm.queries import QUERIES
from equilens.llm.token_counts import byte_symbols

SF = "/root/testdata/sf0.001"
ODD = ["", None, " ", "   a", "a ", "a  ", "a\n b", "a\n  b", "a \n  b \n", " \n ", "x\u2581y", "<s> </s> <unk> <|endoftext|>", "<0x41>",
       "日本語テキスト" * 200, "a" * 2000, "ab" * 900 + " " + "cd" * 10, "\t\tx  y\u00a0 z", "\u0085 a\x1cb \x00c", "word " * 900,
       "😀😀 a😀b", "http://a.b/c?d=e&f " * 90, "it's we'll I'VE 1234 5６７", "\U000323b0a \u088fb", "\r\n" * 50]


# ---------------------------------------------------------------- hard negatives

def brute_negatives(rows, anchor):
    """The definition, row by row."""
    rows = [(u, *r) for u, r in enumerate(rows) if None not in r]
    width = max((len(r[3]) for r in rows), default=0)
    m = np.array([list(r[3]) + [0] * (width - len(r[3])) for r in rows], np.int64).reshape(len(rows), width)
    out = []
    for n, (u, i, label, _) in enumerate(rows):
        if not anchor(i):
            continue
        ranked = sorted((-int(s), r[1], r[0], r[2]) for s, r in zip(m @ m[n], rows))
        others = [x for x in ranked if x[3] != label]
        for p, pid, _, _ in [x for x in ranked if x[3] == label and x[2] != u][:5]:
            fit = [(y, -s) for s, y, _, _ in others if -30 * p <= -100 * s <= -90 * p][:10]
            out += [(i, pid, k, y, -p, s) for k, (y, s) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, every, **kw):
    frame = spark.createDataFrame(rows, "id long, label int, v array<long>").selectExpr("*", "id AS uid", "label AS block", "id AS floor")
    return sorted(tuple(r) for r in hard_negatives.mine(frame, F.col("id") % every == 0, **kw).collect())


def test_negatives_match_brute_force(spark):
    """Ties, hot equal vectors, repeated ids, nulls, short vectors, few rows of a label, negative scores."""
    r = np.random.default_rng(1)
    rows = [(int(i), int(r.integers(0, 3)), [int(x) for x in r.integers(-9, 10, 5)]) for i in r.integers(0, 300, 400)]
    rows += [(None, 1, [1, 2]), (5, None, [1]), (6, 1, None), (1, 1, []), (2, 2, [3]), (40, 9, [-1] * 5), (30, 8, [5] * 5), (31, 8, [-5] * 5)]
    rows += [(10, 1, [9] * 5)] * 60 + [(20, 2, [9, 9, 9, 9, 8])] * 50
    want = brute_negatives(rows, lambda i: i % 10 == 0)
    assert len(want) > 5000
    assert mined(spark, rows, 10, n_codes=4, block_rows=64) == want


def test_negatives_of_few_rows(spark):
    assert mined(spark, [], 10) == [] and mined(spark, [(0, 1, [1, 2])], 10) == []


def test_heap_visits_all_cells_by_falling_bound():
    r = np.random.default_rng(2)
    for _ in range(100):
        a, b = (r.integers(0, 5, r.integers(1, 7)).astype(float) for _ in range(2))
        got = list(hard_negatives.cells_by_bound(a, b))
        assert sorted(x[:2] for x in got) == [(i, j) for i in range(len(a)) for j in range(len(b))]
        assert [x[2] for x in got] == sorted((x[2] for x in got), reverse=True)
        assert all(a[i] + b[j] == s for i, j, s in got)


def test_certified_windows_leave_cells_unscored():
    """On clustered vectors a search ends after a part of the cells, with the right result."""
    r = np.random.default_rng(3)
    centres = r.normal(0, 1000, (16, 16))
    x = np.rint(centres[r.integers(0, 16, 4000)] + r.normal(0, 20, (4000, 16))).astype(np.int64)
    label, ids = r.integers(0, 4, 4000), np.arange(4000)
    index = hard_negatives.MultiIndex(x[:1000], 16, 16)
    (i, ri), (j, rj) = index.key(x)
    for side, (code, d) in enumerate(((i, ri), (j, rj))):
        np.maximum.at(index.radii[side], code, d)
    block = hard_negatives.Block(index, 16, ids, ids, label, i * 16 + j, x)
    scored = []
    visit = block.visit
    block.visit = lambda q, high, low, wanted, take: visit(q, high, low, wanted, lambda rows, s: (scored.append(len(rows)), take(rows, s)))
    for q in range(0, 4000, 100):
        high, low = index.bounds(x[q:q + 1])
        who, top = hard_negatives._positives(block, q, label[q], x[q], [h[0] for h in high], [h[0] for h in low], hard_negatives.NONE, 5)
        s = x @ x[q]
        ok = (label == label[q]) & (ids != q)
        assert list(zip(who, top)) == sorted(zip(ids[ok], s[ok]), key=lambda t: (-t[1], t[0]))[:5]
    assert sum(scored) < 0.5 * 40 * 4000


# ---------------------------------------------------------------- alignment

@pytest.fixture(scope="module")
def paths():
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def aligner(paths):
    """Groups of a text by the libraries, token by token."""
    a, b = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    a.encode_special_tokens = True
    byte_of, entry = {c: i for i, c in enumerate(byte_symbols())}, {i: s for s, i in a.get_vocab().items()}

    def bytes_b(i):
        piece = b.id_to_piece(i)
        hit = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        return bytes([int(hit[1], 16)]) if hit else piece.replace("\u2581", " ").encode()

    def groups(text):
        if not text:
            return []
        sides = [(i, bytes(byte_of[c] for c in entry[i])) for i in a.encode(" " + text, add_special_tokens=False).ids], \
            [(i, bytes_b(i)) for i in b.encode(text)]
        if any(b"".join(x for _, x in s) != (" " + text).encode() for s in sides):
            return []
        at, spans = 0, []
        ends = []
        for s in sides:
            at, e = 0, []
            for _, x in s:
                at += len(x)
                e.append(at)
            ends.append(e)
        low = 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            spans.append([[i for i, _ in s[bisect_right(es, low):bisect_right(es, end)]] for s, es in zip(sides, ends)])
            low = end
        return spans

    return groups


def brute_links(groups):
    pairs = lambda g: [(i, j) for a, b in g for i in a for j in b]
    count = Counter(p for g in groups.values() for p in set(pairs(g)))
    best = defaultdict(int)
    for (i, _), c in count.items():
        best[i] = max(best[i], c)
    out = {}
    for k, g in groups.items():
        links = pairs(g)
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out[k] = (sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(count[p] == best[p[0]] for p in links),
                  sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if g else "")
    return out


@pytest.mark.parametrize("range_bytes", [7, 64, 1 << 16])
def test_alignment_matches_brute_force(spark, paths, range_bytes):
    """Whatever the ranges: documents whole, cut into a few, and into hundreds that are composed in rounds."""
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "doc_id int, text string").selectExpr("*", "text AS a", "doc_id AS _row")
    of = aligner(paths)
    want = brute_links({i: of(t) for i, t in enumerate(ODD)})
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    got = token_align.align_links(frame, *paths, derived={"h": digest}, range_bytes=range_bytes, block_bytes=4096)
    assert {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.h) for r in got.collect()} == want
    for r in token_align.align(frame, *paths, range_bytes=range_bytes).collect():
        g = of(ODD[r.doc_id])
        assert (list(r.a), list(r.b)) == ([i for a, _ in g for i in a], [i for _, b in g for i in b])
        assert (list(r.na), list(r.nb)) == ([len(a) for a, _ in g], [len(b) for _, b in g])
        assert r.groups == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)


def test_alignment_of_odd_rows(spark, docs, paths):
    """Repeated rows and null ids are rows of their own, each counted; an empty table stays empty."""
    rows = docs.collect()
    of = aligner(paths)
    want = Counter((r.doc_id, *w[:6]) for r, w in zip(rows, brute_links({n: of(r.text) for n, r in enumerate(rows)}).values()))
    got = token_align.align_links(docs, *paths, range_bytes=1000).collect()
    assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) for r in got) == want
    assert token_align.align_links(docs.limit(0), *paths).collect() == []


def test_fragments_are_a_monoid():
    r = np.random.default_rng(4)
    parts = [r.integers(0, 4, r.integers(1, 5)) for _ in range(12)]
    whole = token_align.join_sizes(parts)
    for cut in range(1, 12):
        split = token_align.join_sizes([token_align.join_sizes(parts[:cut]), token_align.join_sizes(parts[cut:])])
        assert split.tolist() == whole.tolist()
    assert token_align.join_sizes([np.zeros(1, np.int64), whole, np.zeros(1, np.int64)]).tolist() == whole.tolist()


def test_links_of_large_groups():
    """A group of many equal tokens is counted by its distinct ids, with the same result."""
    r = np.random.default_rng(5)
    a, b = r.integers(0, 5, 90), r.integers(0, 3, 80)
    for na, nb in (([90], [80]), ([40, 50], [1, 79]), ([1] * 90, [1] * 79 + [1] + [0] * 10)):
        pairs, times, n, links = token_align.document_links((a, np.array(na), None), (b, np.array(nb), None), np.array([len(na)]))
        want, i, j = Counter(), 0, 0
        for x, y in zip(na, nb):
            want.update((int(p) << 21) | int(q) for p in a[i:i + x] for q in b[j:j + y])
            i, j = i + x, j + y
        assert dict(zip(pairs.tolist(), times.tolist())) == dict(want) and links[0] == sum(want.values()) and n[0] == len(want)


# ---------------------------------------------------------------- distinct-word codec

@pytest.fixture(scope="module")
def ranks():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    table = word_shuffle.load_ranks(path)
    return path, table, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def test_codec_matches_the_library(spark, docs, ranks):
    path, _, lib = ranks
    texts = [r.text for r in docs.collect()] + ODD
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").selectExpr("*", "text AS ids", "doc_id AS _block")
    for block in (1000, word_shuffle.BLOCK_BYTES):
        coded = word_shuffle.encode(frame, path, packed=True, block_bytes=block)
        got = {r.doc_id: r for r in coded.collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            assert list(got[i].ids) == lib.encode_ordinary(t or "")
            assert np.frombuffer(got[i].ids_u32, "<u4").tolist() == list(got[i].ids)
    back = {r.doc_id: bytes(r.decoded) for r in word_shuffle.decode(coded, path).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(texts)}


def test_codec_of_odd_rows(spark, docs, ranks):
    path, _, lib = ranks
    coded = word_shuffle.encode(docs, path, keep=("doc_id", "score"))
    want = Counter((r.doc_id, r.score, tuple(lib.encode_ordinary(r.text or ""))) for r in docs.collect())
    assert Counter((r.doc_id, r.score, tuple(r.ids)) for r in coded.collect()) == want
    assert word_shuffle.decode(word_shuffle.encode(docs.limit(0), path), path).collect() == []
    some = spark.createDataFrame([(1, [32, 50_300, None]), (1, None), (None, [])], "doc_id int, ids array<int>")
    assert Counter((r.doc_id, bytes(r.decoded)) for r in word_shuffle.decode(some, path).collect()) == Counter(
        [(1, lib.decode_single_token_bytes(32)), (1, b""), (None, b"")])


def test_rows_in_another_order_are_refused(spark, ranks):
    def shuffled(batches):
        for b in batches:
            yield b.take(np.random.default_rng().permutation(b.num_rows))

    frame = spark.createDataFrame([(i, f"word{i} other{i * 7}") for i in range(200)], "doc_id int, text string")
    with pytest.raises(Exception, match="another order"):
        word_shuffle.encode(frame.coalesce(1).mapInArrow(shuffled, frame.schema), ranks[0]).collect()


def test_long_words_merge_alike(ranks):
    r = np.random.default_rng(6)
    for n in (3, 20, 48, 49, 200):
        for letters in ("ab", "aehnrst", "a"):
            word = "".join(r.choice(list(letters), n)).encode()
            assert word_shuffle._merge_short(word, ranks[1]) == word_shuffle._merge_long(word, ranks[1])


# ---------------------------------------------------------------- queries

def test_queries_have_whole_tables(spark, paths, ranks):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    lib, of = ranks[2], aligner(paths)
    coded = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op13_word_shuffle"](spark, SF).collect()}
    want = {}
    for r in rows:
        ids = lib.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert coded == want
    linked = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)
              for r in QUERIES["op12_token_align"](spark, SF).collect()}
    some = {r.doc_id: of(r.text) for r in rows if len(r.text or "") < 2000}
    full = {i: (linked[i][0], linked[i][1], linked[i][2], linked[i][3], linked[i][6]) for i in some}
    assert full == {i: (w[0], w[1], w[2], w[3], w[6]) for i, w in brute_links(some).items()}
    assert len(linked) == len(rows)
