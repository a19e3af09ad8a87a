"""Language-model scores by a weighted backoff automaton over trigrams.

Words and one end mark are the labels.  States are the root, every word seen in training, and
every pair of neighbouring words seen at least ``MIN_PAIR`` times.  The root has an arc for every
word with its discounted unigram probability (absolute discounting, the freed mass goes to the
unknown word).  A word's or pair's state has arcs for the words that followed it, smoothed towards
the state it falls back to (Dirichlet weights ``MU``, ``MU_PAIR``), and a failure arc to that state
(pair, its second word, root) with the rest of its mass.  One left-to-right traversal of a text
carries the state, takes failure arcs until a state has the next word, and adds up their weights.

No task holds the whole automaton.  Texts are packed into blocks; a block asks for the
corpus counts of its own distinct words, bigrams and trigrams, and builds the slice of the
automaton that its texts can reach.  Questions and answers travel as packed arrays, one for each
block and hash range, so a frequent word is one entry for each block, not one row for each
occurrence.  An answer says too whether other blocks asked: where a trigram's first or second bigram
stands in no other block, nor does the trigram, and the block's own count is the corpus count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from equilens.llm.common import materialize, text_slices

MU = 300.0                   # weight of the root against a word state's own counts
MU_PAIR = 30.0               # weight of the word state against a pair state's own counts
MIN_PAIR = 2                 # sightings in training that make a pair of words a state
BUCKET_ENTRIES = 2_000_000   # entries that one bucket task holds, about
PART_TOKENS = 4_000_000      # tokens of the blocks that one task scores one after the other, about
END = b""                    # the end mark; words are never empty


# ---------------------------------------------------------------- blocks

def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def _unpack(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)


def _pack_planes(values: np.ndarray) -> bytes:
    """Bytes of one weight together: the leading ones are mostly zero."""
    return _pack(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T)


def _unpack_planes(data: bytes, dtype) -> np.ndarray:
    planes = _unpack(data, np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype)[:, 0]


def encode_blocks(docs: DataFrame, text: str, doc_id: str, train: Column, block_bytes: int = 7 << 20) -> DataFrame:
    """Texts as blocks of token numbers: one row for about ``block_bytes`` of text (a text is never cut)."""
    id_type = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(id_type)),
                           T.StructField("train", T.BinaryType()), T.StructField("sizes", T.BinaryType()),
                           T.StructField("types", T.BinaryType()), T.StructField("tokens", T.BinaryType()),
                           T.StructField("n_types", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for part in text_slices(batches, "text", block_bytes):
            known: dict[bytes, int] = {}
            flat, sizes = [], []
            for t in part.column("text").to_pylist():
                words = (t or "").encode("utf-8").lower().split()
                words.append(END)
                sizes.append(len(words))
                for w in set(words).difference(known):
                    known[w] = len(known)
                flat.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
            tokens = np.concatenate(flat)
            # frequent types first: small numbers; types of one frequency by hash: small steps
            order = np.lexsort((hashes, -np.bincount(tokens, minlength=len(known))))
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            tokens = place[tokens]
            small = np.uint16 if len(order) <= 1 << 16 else np.uint32
            yield pa.RecordBatch.from_arrays([
                pa.array([block], pa.int64()), pa.array([part.column("id").to_pylist()], _id_list(part)),
                pa.array([part.column("train").to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()], pa.binary()),
                pa.array([np.array(sizes, np.int64).tobytes()], pa.binary()),
                pa.array([_pack_keys(hashes[order])], pa.binary()), pa.array([_pack_planes(tokens.astype(small))], pa.binary()),
                pa.array([len(order)], pa.int64()), pa.array([len(tokens)], pa.int64())], names=schema.names)
            block += 1

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), train.alias("train"))
    return rows.mapInArrow(run, schema)


def _id_list(part: pa.RecordBatch) -> pa.DataType:
    return pa.list_(part.schema.field("id").type)


class Block:
    """One block with its training counts and distinct bigrams."""

    def __init__(self, row: dict):
        self.block, self.ids = row["block"], row["ids"]
        self.types = _unpack_keys(row["types"])
        small = np.uint16 if len(self.types) <= 1 << 16 else np.uint32
        self.tokens = _unpack_planes(row["tokens"], small).astype(np.int64)
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        train = np.frombuffer(row["train"], np.uint8).astype(bool)
        self.learns = np.repeat(train, self.sizes)             # token positions that train
        self.first = np.cumsum(self.sizes) - self.sizes
        self.own = np.bincount(self.tokens[self.learns], minlength=len(self.types))

    def bigrams(self) -> None:
        """Distinct (state, label) pairs, the pair that ends at each position, and their training counts."""
        inner = np.ones(len(self.tokens), bool)
        inner[self.first] = False                              # a text begins at the root
        self.inner = np.flatnonzero(inner)
        key = (self.tokens[self.inner - 1] << 32) | self.tokens[self.inner]
        pairs, at = np.unique(key, return_inverse=True)
        self.state, self.label = pairs >> 32, pairs & 0xFFFFFFFF
        self.own_pairs = np.bincount(at[self.learns[self.inner]], minlength=len(pairs))
        self.pair = np.full(len(self.tokens), -1)
        self.pair[self.inner] = at

    def trigrams(self) -> None:
        """Distinct (pair, label) trigrams: their pair, the pair of their last two words, where each stands, training counts."""
        deep = self.inner[self.pair[self.inner - 1] >= 0]
        key = (self.pair[deep - 1] << 32) | self.tokens[deep]
        triples, first, at = np.unique(key, return_index=True, return_inverse=True)
        self.context, self.last = triples >> 32, triples & 0xFFFFFFFF
        self.tail = self.pair[deep[first]]
        self.own_triples = np.bincount(at[self.learns[deep]], minlength=len(triples))
        self.triple = np.full(len(self.tokens), -1)
        self.triple[deep] = at

    def pair_hash(self) -> np.ndarray:
        return _mix(self.types[self.state], self.types[self.label])

    def asked(self, pair_counts: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """Trigrams whose corpus count the block must ask for, from the answers about its bigrams.

        Two blocks that hold a trigram hold its two bigrams, so they agree on asking.
        """
        return np.flatnonzero(shared[self.context] & shared[self.tail] & (pair_counts[self.context] >= MIN_PAIR))

    def triple_hash(self, at: np.ndarray) -> np.ndarray:
        return _mix(self.pair_hash()[self.context[at]], self.types[self.last[at]])


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of two hashes, order counting."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + b
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


# ---------------------------------------------------------------- questions and answers

_ASK = "bucket int, block long, keys binary, counts binary"
_ANSWER = "block long, bucket int, counts binary, n long, n1 long, n2 long, total long"


def _bucket(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """Hash range of each key; ranges follow the keys' order."""
    return ((keys >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Keys in ascending runs as steps (modulo 2^64)."""
    return _pack_planes(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack_planes(data, np.uint64), dtype=np.uint64)


def _questions(block: int, keys: np.ndarray, counts: np.ndarray, n_buckets: int) -> pa.RecordBatch:
    """One packed row for each bucket the keys fall into."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.uint32)
    cut = np.searchsorted(_bucket(keys, n_buckets), np.arange(n_buckets + 1, dtype=np.uint64))
    used = np.flatnonzero(np.diff(cut))
    return pa.RecordBatch.from_arrays([
        pa.array(used, pa.int32()), pa.array([block] * len(used), pa.int64()),
        pa.array([_pack_keys(keys[cut[b]:cut[b + 1]]) for b in used], pa.binary()),
        pa.array([_pack_planes(counts[cut[b]:cut[b + 1]]) for b in used], pa.binary())],
        names=["bucket", "block", "keys", "counts"])


def _put_answers(keys: np.ndarray, own: np.ndarray, answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The inverse: corpus counts in the order of ``keys``, and whether other blocks asked too."""
    reply = np.zeros(len(keys), np.int64)
    if len(keys):
        reply[np.argsort(keys, kind="stable")] = np.concatenate([_unpack_planes(answers[b], np.int64) for b in sorted(answers)])
    return own + (reply >> 1), (reply & 1).astype(bool)


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Rows of sorted batches, key by key."""
    held: list[dict] = []
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            if held and row[key] != held[0][key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _answer(questions: DataFrame, n_buckets: int) -> DataFrame:
    """For every question twice the counts of other blocks, plus 1 where any of them asked; each bucket's totals (block null)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, "bucket"):
            keys = [_unpack_keys(r["keys"]) for r in rows]
            own = np.concatenate([_unpack_planes(r["counts"], np.uint32) for r in rows]).astype(np.int64)
            distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(at, own, len(distinct)).astype(np.int64)
            reply = (total[at] - own) * 2 + (np.bincount(at, minlength=len(distinct)) > 1)[at]
            start = 0
            for r, k in zip(rows, keys):
                yield _answer_row(r["block"], r["bucket"], _pack_planes(reply[start:start + len(k)]), 0, 0, 0, 0)
                start += len(k)
            yield _answer_row(None, rows[0]["bucket"], b"", int((total > 0).sum()), int((total == 1).sum()),
                              int((total == 2).sum()), int(total.sum()))

    n = max(n_buckets, _partitions(questions))
    return questions.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, _ANSWER)


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _answer_row(block, bucket, counts, n, n1, n2, total) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((block, bucket, counts, n, n1, n2, total), kinds)],
                                      names=["block", "bucket", "counts", "n", "n1", "n2", "total"])


def _with_answers(blocks: DataFrame, n_parts: int, **answers: DataFrame) -> DataFrame:
    """Blocks and the answers to them, brought together by block."""
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in blocks.schema if f.name != "block"]
    out = blocks.select("*", F.lit("").alias("kind"), F.lit(None).cast("int").alias("bucket"),
                        F.lit(None).cast("binary").alias("counts"))
    for kind, rows in answers.items():
        out = out.unionByName(rows.where("block IS NOT NULL").select("block", *empty, F.lit(kind).alias("kind"), "bucket", "counts"))
    return out.repartition(max(n_parts, _partitions(blocks)), "block")


def _read(rows: list[dict]) -> tuple[Block, dict[str, dict[int, bytes]]]:
    got: dict[str, dict[int, bytes]] = {"words": {}, "pairs": {}}
    for r in rows[1:]:
        got[r["kind"]][r["bucket"]] = r["counts"]
    return Block(rows[0]), got


# ---------------------------------------------------------------- the automaton

@dataclass(frozen=True)
class Totals:
    """Training tokens, distinct ones, and how many were seen once and twice."""

    tokens: int
    types: int
    once: int
    twice: int

    @property
    def discount(self) -> float:
        return self.once / (self.once + 2 * self.twice) if self.once and self.twice else 0.5

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1.0) / (self.tokens + self.types + 1))

    def root(self, counts: np.ndarray) -> np.ndarray:
        """log10 weights of the root's arcs; words not seen share the unknown word's arc."""
        if not self.tokens:
            return np.zeros(len(counts))
        known = np.maximum(counts - self.discount, 1e-300) / self.tokens
        return np.log10(np.where(counts > 0, known, self.discount * self.types / self.tokens))


class BackoffAutomaton:
    """A slice of the automaton: the states and arcs that a block's texts can reach.

    State 0 is the root, ``1 + w`` word ``w``, ``1 + words + p`` pair ``p`` of the block.
    """

    def __init__(self, block: Block, counts: np.ndarray, pair_counts: np.ndarray, triple_counts: np.ndarray,
                 totals: Totals, mu: float, mu_pair: float):
        self.block, n = block, len(counts)
        root = totals.root(counts)
        second = (pair_counts + mu * 10 ** root[block.label]) / (counts[block.state] + mu)
        third = (triple_counts + mu_pair * second[block.tail]) / (pair_counts[block.context] + mu_pair)
        # weights of the arcs of the root, the words and the pairs; not a number: no such arc
        self.arcs = (root, np.where(pair_counts > 0, np.log10(second), np.nan), np.where(triple_counts > 0, np.log10(third), np.nan))
        self.failure = np.concatenate([[0.0], np.log10(mu / (counts + mu)), np.log10(mu_pair / (pair_counts + mu_pair))])
        self.back = np.concatenate([np.zeros(n + 1, np.int64), 1 + block.label])
        # where the arcs lead: the longest state that ends there
        self.word_goes = np.where(counts > 0, np.arange(n) + 1, 0)
        self.pair_goes = np.where(pair_counts >= MIN_PAIR, np.arange(len(pair_counts)) + n + 1, self.word_goes[block.label])

    def traverse(self) -> np.ndarray:
        """Accumulated log10 probability of each text; the state is carried from word to word."""
        b, n = self.block, len(self.arcs[0])
        root, second, third = self.arcs
        second, third, pair_goes = np.append(second, np.nan), np.append(third, np.nan), np.append(self.pair_goes, 0)    # -1: no pair or triple
        failure, back = self.failure.data, self.back.data
        out = np.empty(len(b.sizes))
        for i, (a, z) in enumerate(zip(b.first.tolist(), (b.first + b.sizes).tolist())):
            state, total = 0, 0.0
            # what each position can take from the root, a word, a pair, and where it then stands
            w, p, t = b.tokens[a:z], b.pair[a:z], b.triple[a:z]
            goes = np.where(p >= 0, pair_goes[p], self.word_goes[w])
            for r, s, t, go in zip(root[w].tolist(), second[p].tolist(), third[t].tolist(), goes.tolist()):
                while state:
                    arc = t if state > n else s
                    if arc == arc:
                        break
                    total += failure[state]
                    state = back[state]
                total += arc if state else r
                state = go
            out[i] = total
        return out


def score(docs: DataFrame, train: Column, text: str = "text", doc_id: str = "doc_id", mu: float = MU,
          mu_pair: float = MU_PAIR) -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` of every row.

    ``train`` marks the rows the model learns from (null counts as not).  A-Z are
    lower-cased; null, empty and blank texts are one end mark; repeated rows count each
    time.  Without training rows every probability is 1.  The counts of words, bigrams and
    trigrams are exact over all training rows.
    """
    id_type = docs.schema[doc_id].dataType
    id_arrow = to_arrow_type(id_type)
    blocks = materialize(encode_blocks(docs, text, doc_id, F.coalesce(train, F.lit(False))), "blocks")
    size = blocks.agg(F.sum("n_types").alias("types"), F.sum("n_tokens").alias("tokens")).first()
    n_words = max(1, math.ceil((size["types"] or 0) / BUCKET_ENTRIES))
    n_pairs = max(1, math.ceil((size["tokens"] or 0) / BUCKET_ENTRIES))

    def ask(what: str, n_buckets: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in _grouped(batches, "block"):
                b = Block(rows[0])
                if what == "words":
                    yield _questions(b.block, b.types, b.own, n_buckets)
                else:
                    b.bigrams()
                    yield _questions(b.block, b.pair_hash(), b.own_pairs, n_buckets)

        return _answer(blocks.mapInArrow(run, _ASK), n_buckets)

    words = materialize(ask("words", n_words), "word-counts")
    t = words.where("block IS NULL").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "n1", "n2", "total")]).first()
    totals = Totals(t["total"], t["n"], t["n1"], t["n2"])
    # blocks with their answers are exchanged once and read twice
    n_parts = math.ceil((size["tokens"] or 0) / PART_TOKENS)
    held = _with_answers(blocks, n_parts, words=words, pairs=ask("pairs", n_pairs))

    def ask_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, "block"):
            b, got = _read(rows)
            b.bigrams()
            b.trigrams()
            at = b.asked(*_put_answers(b.pair_hash(), b.own_pairs, got["pairs"]))
            yield _questions(b.block, b.triple_hash(at), b.own_triples[at], n_pairs)

    triples = _answer(held.sortWithinPartitions("block", "kind").mapInArrow(ask_triples, _ASK), n_pairs) \
        .where("block IS NOT NULL").select("block", "bucket", "counts")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        b, got = _read(sorted(left.to_pylist(), key=lambda r: r["kind"]))
        counts, _ = _put_answers(b.types, b.own, got["words"])
        b.bigrams()
        b.trigrams()
        pair_counts, shared = _put_answers(b.pair_hash(), b.own_pairs, got["pairs"])
        at, triple_counts = b.asked(pair_counts, shared), b.own_triples.copy()
        triple_counts[at], _ = _put_answers(b.triple_hash(at), b.own_triples[at], {r["bucket"]: r["counts"] for r in right.to_pylist()})
        triple_counts[pair_counts[b.context] < MIN_PAIR] = 0        # no such state
        automaton = BackoffAutomaton(b, counts, pair_counts, triple_counts, totals, mu, mu_pair)
        known = np.add.reduceat((counts > 0)[b.tokens].astype(np.int64), b.first)
        base = np.add.reduceat(totals.base(counts)[b.tokens], b.first)
        return pa.table([pa.array(b.ids, id_arrow), pa.array(b.sizes, pa.int64()), pa.array(known, pa.int64()),
                         pa.array(base, pa.float64()), pa.array(automaton.traverse(), pa.float64())], names=schema.names)

    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("n_tokens", T.LongType()),
                           T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()),
                           T.StructField("score", T.DoubleType())])
    out = held.groupBy("block").cogroup(triples.groupBy("block")).applyInArrow(finish, schema)
    return out.withColumn("train_tokens", F.lit(totals.tokens).cast("long"))
