"""Token counts and the BPE automaton against the tokenizers library."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from equilens.llm import bpe_automaton, token_counts

ODD = ["", "a" * 500, "ΑΣ ΣΑΣ İI", "x\x1cy z\x1f", "<|endoftext|>a <|ENDOFTEXT|> b<|startoftext|><|endoftext|>", "é é",
       "日本語テキスト" * 40, "  \n\n a  b \t  c　　d ", "it's we'll I'VE 'S '' \"", "1234 5６７", "😀😀 a😀b",
       "aaaa aaaaa " + "a" * 25, " <|endoftext|> \n", "a\r\nb", "\u0085x", "-" * 120, "hello" * 200, "thethethe " * 50]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_merges_come_after_their_parts(name):
    """Both methods need a vocabulary in which a part is made before it is used."""
    import json
    born = {}
    for i, m in enumerate(json.load(open(public_tokenizers.path(name)))["model"]["merges"]):
        a, b = m.split(" ") if isinstance(m, str) else m
        assert born.get(a, -1) < i and born.get(b, -1) < i
        born.setdefault(a + b, i)


def test_counts_match_the_library(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    texts = [r.text for r in docs.collect()] + ODD
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.n for r in frame.select("i", token_counts.token_count(F.col("text"), path).alias("n")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == len(lib.encode(t or "", add_special_tokens=False).ids), t


def test_small_memory_changes_nothing():
    table = token_counts.rank_table(public_tokenizers.path("word_bpe_49k.json"))
    tight, wide = token_counts.ChunkCounter(table, 2), token_counts.ChunkCounter(table, 10_000)
    for _ in range(2):
        assert [tight.count([t])[0] for t in ODD] == wide.count(ODD)


def test_codec_matches_the_library(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    texts = [r.text for r in docs.collect()] + ODD
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    coded = bpe_automaton.encode(frame, path, decoded=True)
    again = {r.doc_id: r.decoded for r in bpe_automaton.decode(coded, path).collect()}
    for r in coded.collect():
        t = texts[r.doc_id] or ""
        ids = lib.encode(t, add_special_tokens=False).ids
        assert list(r.ids) == ids
        assert r.decoded == lib.decode(ids, skip_special_tokens=False) == again[r.doc_id] == t


def test_decode_of_broken_bytes_and_null(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    ids = [lib.encode("日", add_special_tokens=False).ids[0], 50256, 32]
    frame = spark.createDataFrame([(1, ids), (2, None), (3, [])], "doc_id int, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe_automaton.decode(frame, path).collect()}
    assert got == {1: lib.decode(ids, skip_special_tokens=False), 2: "", 3: ""}


def test_automaton_accepts_only_its_own_encodings():
    auto = bpe_automaton.automaton(public_tokenizers.path("byte_bpe_50k.json"))
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for a, b in [(b"t", b"he"), (b"th", b"e"), (b"a", b"aa"), (b"aa", b"a"), (b"q", b"z")]:
        ia, ib = (auto.labels.index(x) for x in (a, b))
        assert auto._arc_one(ia, ib) == (lib.encode((a + b).decode(), add_special_tokens=False).ids == [ia, ib])


def test_queries_have_whole_tables(spark):
    from equilens.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for r in rows:
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                          hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op4_bpe_codec"](spark, sf).collect()}
    assert got == want
    word = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in QUERIES["op3_token_counts"](spark, sf).collect():
        text = next(x.text for x in rows if x.doc_id == r.doc_id) or ""
        n = len(word.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 2048)
