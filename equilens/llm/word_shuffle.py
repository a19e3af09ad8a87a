"""Byte-level BPE encoding by a shuffle of distinct words, and decoding by a join with the token bytes.

Pre-tokens are exploded with their positions: a task cuts its documents into blocks of some
megabytes of text; a block lists its distinct pre-tokens (``block, code, word``), and each
document keeps its pre-tokens by position as codes of its block.  The words of all blocks are
shuffled, every distinct word of the corpus is encoded once, its ids go back to the blocks that
use it, and each block reassembles its documents by position.

A word that every document repeats is one row for each block, so no hot word crowds a task,
and what travels by word is the blocks' vocabularies, not their texts.  Words and codes come
from two passes over the documents, which is cheaper than a written copy of both; a block's
vocabulary has a digest, so input whose rows change order between the passes is refused.

Decoding joins ids with the table of token bytes, which the vocabulary bounds, so every task
joins its own rows' ids by position, a gather from the table, and puts the bytes together.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from equilens.llm.bpe_automaton import CHUNK
from equilens.llm.common import text_slices
from equilens.llm.token_counts import WHITE

BLOCK_BYTES = 8 << 20
SCAN_BYTES = 1 << 20
BUCKETS = 4                                           # hash buckets of words for each shuffle partition
SHORT_WORD = 48

# fixed values: letters and numbers that Unicode has got since version 16, which the vocabulary's library doesn't know
LATER = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 "
    "10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 "
    "16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 "
    "1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 "
    "1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F")


def split_pattern(pattern: str) -> regex.Pattern:
    """A split pattern with the library's meaning: white space, letters and numbers of its Unicode version."""
    later = "".join("-".join(f"\\U{int(c, 16):08X}" for c in part.split("-")) for part in LATER.split())
    inside = pattern.replace(r"[^\s\p{L}\p{N}]", f"[[^{WHITE}\\p{{L}}\\p{{N}}]||[{later}]]")
    inside = inside.replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")
    for kind in (r"\p{L}", r"\p{N}"):
        inside = regex.sub(rf"(?<![\w\]}}]){regex.escape(kind)}(?=\+)", lambda m: f"[{kind}--[{later}]]", inside)
    return regex.compile(f"(?V1){inside}")


# ---------------------------------------------------------------- merges

@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their rank (also their id) from a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    parts = [word[i:i + 1] for i in range(len(word))]
    none = len(ranks)
    pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while pairs and (best := min(pairs)) < none:
        at = pairs.index(best)
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
        del pairs[at]
        if at:
            pairs[at - 1] = ranks.get(parts[at - 1] + parts[at], none)
        if at < len(pairs):
            pairs[at] = ranks.get(parts[at] + parts[at + 1], none)
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges, lowest rank first and leftmost among equals, from a heap: n log n steps."""
    n = len(word)
    end = list(range(1, n + 1))                       # end of the part that starts at i; 0: merged away
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != stop:   # one of the two parts has changed since
            continue
        end[i], end[mid] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i:end[stop]])) is not None:
                heappush(heap, (r, i, end[stop]))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
            heappush(heap, (r, p, stop))
    return [ranks[word[i:end[i]]] for i in range(n) if end[i]]


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the token that it is, or what merging pairs by rank leaves."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    return _merge_short(word, ranks) if len(word) <= SHORT_WORD else _merge_long(word, ranks)


# ---------------------------------------------------------------- ragged arrays

def ragged(rows: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Items of ``rows`` (indexes of ragged rows) one after another, and the number of each."""
    begin = np.cumsum(sizes) - sizes
    lens = sizes[rows]
    ends = np.cumsum(lens)
    at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lens, lens) + np.repeat(begin[rows], lens)
    return flat[at], lens


def width_of(n_codes: int) -> int:
    """Bytes that hold any of ``n_codes`` codes."""
    return max((max(n_codes - 1, 0).bit_length() + 7) // 8, 1)


def pack(codes: np.ndarray, width: int) -> bytes:
    """Codes as byte planes, the low bytes first: small codes leave the high planes nearly empty."""
    return codes.astype("<u4").view(np.uint8).reshape(-1, 4).T[:width].tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros(planes.shape[1], np.int64)
    for i in range(width):
        out |= planes[i].astype(np.int64) << (8 * i)
    return out


# ---------------------------------------------------------------- pre-tokens of a block

class Vocabulary:
    """Distinct chunks (runs without white space) and pre-tokens of a block, numbered as they first come."""

    def __init__(self, split: regex.Pattern):
        self.split = split
        self.chunks: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.flat: list[int] = []                     # words of the chunks, one after another
        self.sizes: list[int] = []

    def add(self, texts: list[str | None]) -> list[list[str]]:
        """The chunks of each text, after their words are numbered."""
        found = [CHUNK.findall(t) if t else [] for t in texts]
        for chunk in dict.fromkeys(chain.from_iterable(found)):
            if chunk not in self.chunks:
                plain = chunk.isalpha() or chunk[0] == " " and chunk[1:].isalpha()
                words = [chunk] if plain else self.split.findall(chunk)
                self.chunks[chunk] = len(self.chunks)
                self.flat += [self.words.setdefault(w, len(self.words)) for w in words]
                self.sizes.append(len(words))
        return found

    def rows(self, found: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Chunk numbers of the texts one after another, and how many each text has."""
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(map(self.chunks.__getitem__, chain.from_iterable(found)), np.int32, int(counts.sum())), counts

    def codes(self, rows: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        """Word numbers of each text by position."""
        codes, lens = ragged(rows, np.array(self.flat, np.int32), np.array(self.sizes, np.int64))
        upto = np.concatenate([[0], np.cumsum(lens)])
        cut = upto[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [codes[a:b] for a, b in zip(cut, cut[1:])]

    def digest(self) -> int:
        """Tells the vocabulary of one pass from that of another."""
        return xxhash.xxh3_64_intdigest("\0".join(self.words)) >> 1


def _blocks(batches: Iterator[pa.RecordBatch], split: regex.Pattern, block_bytes: int, with_rows: bool):
    """``(block number, vocabulary, parts)``; parts have the columns beside the text, and the chunk numbers of the texts."""
    number, words, parts, held = TaskContext.get().partitionId() << 32, Vocabulary(split), [], 0
    for part in text_slices(batches, "_text", SCAN_BYTES):
        found = words.add(part.column("_text").to_pylist())
        if with_rows:
            parts.append((part.columns[:-1], *words.rows(found)))
        held += (pc.sum(pc.binary_length(part.column("_text"))).as_py() or 0) + len(part)
        if held >= block_bytes:
            yield number, words, parts
            number, words, parts, held = number + 1, Vocabulary(split), [], 0
    if held:
        yield number, words, parts


_ASK = "_bucket int, _of long, _digest long, _n int, _codes binary, _lens binary, _words binary"
_ANSWER = "_of long, _digest long, _n int, _codes binary, _sizes binary, _ids binary"


def _names(ddl: str) -> list[str]:
    return [f.split()[0] for f in ddl.split(", ")]


def block_words(texts: DataFrame, pattern: str, block_bytes: int, buckets: int) -> DataFrame:
    """The distinct pre-tokens of each block of ``_text`` rows, packed by hash bucket: ``_n`` words one behind
    another, their lengths, and the steps from code to code."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, words, _ in _blocks(batches, split_pattern(pattern), block_bytes, False):
            digest, raw = words.digest(), [w.encode("utf-8") for w in words.words]
            bucket = np.fromiter(map(xxhash.xxh32_intdigest, raw), np.int64, len(raw)) % buckets
            lens, order = np.fromiter(map(len, raw), np.int64, len(raw)), np.argsort(bucket, kind="stable")
            cut = [0, *(np.flatnonzero(np.diff(bucket[order])) + 1).tolist(), len(order)]
            out = []
            for a, b in zip(cut, cut[1:]):
                if a < b:
                    some = order[a:b]
                    step, size = np.diff(some, prepend=0), lens[some]
                    out.append((int(bucket[some[0]]), number, digest, b - a, pack(step, width_of(int(step.max()) + 1)),
                                pack(size, width_of(int(size.max()) + 1)), b"".join([raw[i] for i in some.tolist()])))
            if out:
                types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=_names(_ASK))

    return texts.select("_text").mapInArrow(run, _ASK)


def block_codes(texts: DataFrame, pattern: str, block_bytes: int, keep: list[str]) -> DataFrame:
    """``keep``, ``_block``, ``_digest`` and ``_codes`` (pre-tokens by position) of each row."""
    new = [T.StructField("_block", T.LongType()), T.StructField("_digest", T.LongType()), T.StructField("_codes", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, words, parts in _blocks(batches, split_pattern(pattern), block_bytes, True):
            digest, width = words.digest(), width_of(len(words.words))
            for cols, rows, counts in parts:
                n = len(counts)
                packed = [pack(c, width) for c in words.codes(rows, counts)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([number] * n, pa.int64()), pa.array([digest] * n, pa.int64()),
                                                  pa.array(packed, pa.binary())], names=[*keep, *[f.name for f in new]])

    return texts.mapInArrow(run, T.StructType([T.StructField(c, texts.schema[c].dataType) for c in keep] + new))


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """For each pack of words the sizes and ids of their tokens; each distinct word is encoded once.

    Equal words meet in one bucket, and a task holds the ids of one bucket's words at a time.
    """
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, at, known = load_ranks(path), None, {}
        for batch in batches:
            sizes, ids = [], []
            cols = [batch.column(c).to_pylist() for c in ("_bucket", "_n", "_lens", "_words")]
            for bucket, count, lens, raw in zip(*cols):
                if bucket != at:
                    at, known = bucket, {}
                ends = np.cumsum(unpack(lens, len(lens) // count)).tolist()
                found = []
                for a, b in zip([0, *ends], ends):
                    word = raw[a:b]
                    got = known.get(word)
                    if got is None:
                        got = known[word] = encode_word(word, ranks)
                    found.append(got)
                size = np.fromiter(map(len, found), np.int64, count)
                flat = np.fromiter(chain.from_iterable(found), np.int64, int(size.sum()))
                sizes.append(pack(size, width_of(int(size.max()) + 1)))
                ids.append(pack(flat, width_of(int(flat.max()) + 1)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("_of", "_digest", "_n", "_codes")],
                                              pa.array(sizes, pa.binary()), pa.array(ids, pa.binary())], names=_names(_ANSWER))

    # merging is work by the word, not by the byte: the number of tasks doesn't follow the table's size
    return words.repartition(n, "_bucket").sortWithinPartitions("_bucket").mapInArrow(run, _ANSWER)


def _unpacked(known: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and sizes of a block's words in the order of their codes."""
    codes, sizes, flat = [], [], []
    for n, *packed in zip(*[known.column(c).to_pylist() for c in ("_n", "_codes", "_sizes", "_ids")]):
        step, s = (unpack(x, len(x) // n) for x in packed[:2])
        total = int(s.sum())
        codes.append(np.cumsum(step))
        sizes.append(s)
        flat.append(unpack(packed[2], len(packed[2]) // total))
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return ragged(np.argsort(np.concatenate(codes)), np.concatenate(flat), np.concatenate(sizes))


def encode(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), packed: bool = False,
           pattern: str = public_tokenizers.PATTERN, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` columns, ``ids`` (array of token ids) and, if asked for, ``ids_u32`` (the same ids as
    little-endian unsigned 32-bit integers).

    ``path`` is a rank file, ``pattern`` the split pattern (none of its matches may go on behind a
    run without white space).  Each match is encoded by itself; special strings are plain text.
    Null and empty texts have no ids.  Every row gives one row, whatever its other columns hold,
    repeated or not.  ``df`` must return its rows in one order whenever it is read, as files do;
    otherwise the job fails.  ``block_bytes`` bounds a task's memory, not what is encoded.
    """
    keep = list(keep)
    texts = df.select(*keep, df[text].alias("_text"))
    buckets = BUCKETS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = encode_words(block_words(texts, pattern, block_bytes, buckets), path)
    docs = block_codes(texts, pattern, block_bytes, keep)
    new = [T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("ids_u32", T.BinaryType())] * packed

    def assemble(docs: pa.Table, known: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        flat, sizes = _unpacked(known)
        first = pc.unique(known.column("_digest")).to_pylist() or [Vocabulary(None).digest()]
        if pc.unique(docs.column("_digest")).to_pylist() != first:
            raise RuntimeError("the rows to encode came in another order the second time; write them first")
        width = width_of(len(sizes))
        codes = [unpack(c, width) for c in docs.column("_codes").to_pylist()]
        ids, lens = ragged(np.concatenate(codes) if codes else np.zeros(0, np.int64), flat, sizes)
        upto = np.concatenate([[0], np.cumsum(lens)])
        cut = upto[np.concatenate([[0], np.cumsum([len(c) for c in codes], dtype=np.int64)]).astype(np.int64)]
        cols = [docs.column(c) for c in keep]
        cols.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids.astype(np.int32), pa.int32()),
                                             type=pa.list_(pa.field("element", pa.int32()))))
        if packed:
            data = ids.astype("<u4").tobytes()
            cols.append(pa.array([data[4 * a:4 * b] for a, b in zip(cut.tolist(), cut[1:].tolist())], pa.binary()))
        return pa.Table.from_arrays(cols, names=[*keep, *[f.name for f in new]])

    schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in keep] + new)
    return docs.groupBy("_block").cogroup(known.groupBy("_of")).applyInArrow(assemble, schema)


# ---------------------------------------------------------------- decoding

@lru_cache(maxsize=2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table by id: all bytes, and the begin and length of each id's; one row more, empty, at its end."""
    ranks = load_ranks(path)
    table = [b""] * (max(ranks.values(), default=-1) + 2)
    for token, rank in ranks.items():
        table[rank] = token
    sizes = np.fromiter(map(len, table), np.int64, len(table))
    return np.frombuffer(b"".join(table), np.uint8), np.cumsum(sizes) - sizes, sizes


def decode(df: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``decoded``, the bytes (binary, UTF-8 or not) that the ids stand for.

    Null and empty ids decode to no bytes; so does an id that the vocabulary lacks, or null.
    """
    keep = list(keep)
    schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in keep] + [T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, begin, sizes = token_bytes(path)
        none = len(sizes) - 1
        for batch in batches:
            counts = pc.list_value_length(batch.column("_ids")).fill_null(0).to_numpy()
            bounds = np.searchsorted(np.cumsum(counts), np.arange(0, counts.sum(), SCAN_BYTES), "left")
            bounds = np.unique([0, *bounds.tolist(), batch.num_rows]).tolist()
            for i, j in zip(bounds, bounds[1:]):
                part = batch.slice(i, j - i)
                at = pc.fill_null(part.column("_ids").flatten(), none).to_numpy(zero_copy_only=False).astype(np.int64)
                at[(at < 0) | (at > none)] = none
                lens = sizes[at]
                ends = np.concatenate([[0], np.cumsum(lens)])
                text = data[np.arange(ends[-1]) - np.repeat(ends[:-1] - begin[at], lens)].tobytes()
                cut = ends[np.concatenate([[0], np.cumsum(counts[i:j])]).astype(np.int64)].tolist()
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in range(len(keep))],
                                                  pa.array([text[a:b] for a, b in zip(cut, cut[1:])], pa.binary())], names=[*keep, "decoded"])

    return df.select(*keep, df[ids].alias("_ids")).mapInArrow(run, schema)
