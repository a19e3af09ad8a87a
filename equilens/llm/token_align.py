"""Cross-tokenizer alignment by an associative monoid of byte-range fragments.

A document's text, with a space in front, is spelled by the tokens of two tokenizers, A and B.
Where tokens of both end at the same byte, a group is closed.  The tokens of a byte range form a
*fragment*: the segments between those common ends.  Its first segment is the open prefix (the
group may have begun in an earlier range), its last one the open suffix, all between are closed
groups; a range without a common end is one open segment.  Joining two fragments merges the
left one's suffix with the right one's prefix.  That is associative, and the fragment of no
tokens is its identity, so fragments may be joined in any tree.

Short documents are one range.  Longer ones are cut into byte ranges that Spark spreads over its
tasks; a range is tokenized with the whole words it touches, so its tokens are those of the whole
text, and keeps the tokens that end inside it.  Rounds of grouped joins then compose the ranges.

Both tokenizers treat the text between two safe cuts (a space behind a character that isn't white
space) on its own, so tokens are remembered by such a piece.  Link counts travel as blocks: the
documents of a block name their pairs by codes of the block's own dictionary, and only the
dictionaries are shuffled by pair.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equilens.llm.common import materialize, text_slices
from equilens.llm.token_counts import WHITE, byte_symbols
from equilens.llm.word_shuffle import pack, ragged, unpack, width_of

RANGE_BYTES = 64 << 10
FAN = 16
MAX_PIECES = 250_000
BLOCK_BYTES = 8 << 20
SCAN_BYTES = 1 << 20
ID_BITS = 21                                          # a pair of ids and a document's place fit in 64 bits

# a space and all up to the next safe cut; a space that ends the text belongs to the piece before
PIECE = re.compile(rf" (?: \Z|[^ ]|(?<=[{WHITE}]) )*")
_WHITE_END = re.compile(rf"[{WHITE}]\Z")
JOINED = 512                                          # new pieces tokenized at once


# ---------------------------------------------------------------- tokens

class Tokenizers:
    """Both tokenizers, and the bytes that each of their ids spells."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        to_byte = {c: b for b, c in enumerate(byte_symbols())}
        self.bytes_a = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for entry, i in self.a.get_vocab(with_added_tokens=True).items():
            self.bytes_a[i] = bytes(to_byte[c] for c in entry) if all(c in to_byte for c in entry) else entry.encode("utf-8")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode("utf-8")
                        for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]
        if max(len(self.bytes_a), len(self.bytes_b)) >= 1 << ID_BITS:
            raise ValueError(f"vocabularies of {1 << ID_BITS} ids or more don't fit")


@lru_cache(maxsize=2)
def tokenizers_of(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


class Tokens:
    """Ids and byte lengths of pieces under both tokenizers, remembered up to ``max_pieces`` pieces."""

    def __init__(self, both: Tokenizers, max_pieces: int):
        self.both, self.max_pieces = both, max_pieces
        tables = (both.bytes_a, both.bytes_b)
        self.len_of = [np.fromiter(map(len, x), np.int64, len(x)) for x in tables]
        self.spelling = [np.frombuffer(b"".join(x), np.uint8) for x in tables]
        self.known: dict[str, int] = {}
        self.flat = [np.zeros(0, np.int32)] * 2
        self.sizes = [np.zeros(0, np.int64)] * 2
        self.fine, self.n_bytes = np.zeros(0, bool), np.zeros(0, np.int64)

    def _forget(self, used: dict) -> None:
        """Keep the pieces in use now, the frequent ones among them."""
        names = [p for p in self.known if p in used]
        rows = np.array([self.known[p] for p in names], np.int64)
        for side in (0, 1):
            self.flat[side], self.sizes[side] = ragged(rows, self.flat[side], self.sizes[side])
        self.fine, self.n_bytes = self.fine[rows], self.n_bytes[rows]
        self.known = dict(zip(names, range(len(names))))

    def _encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [e.ids for e in self.both.a.encode_batch_fast(texts, add_special_tokens=False)]
        return a, self.both.b.encode([t[1:] for t in texts], num_threads=1)

    def learn(self, pieces: list[str]) -> None:
        """Tokenize new pieces: many at a time where they may stand behind each other, else one by one."""
        raw = [p.encode("utf-8") for p in pieces]
        rows: list[int] = []                          # pieces in the order in which their tokens are added
        found = [[], []], [[], []]                    # ids and sizes of either side
        alone = [i for i, p in enumerate(pieces) if _WHITE_END.search(p)]
        taken = set(alone)
        free = [i for i in range(len(pieces)) if i not in taken]
        runs = [free[i:i + JOINED] for i in range(0, len(free), JOINED)]
        for run, *ids in zip(runs, *self._encode(["".join([pieces[i] for i in run]) for run in runs])):
            ends = np.cumsum([len(raw[i]) for i in run])
            text = np.frombuffer(b"".join([raw[i] for i in run]), np.uint8)
            ids = [np.array(x, np.int64) for x in ids]
            spelled = [ragged(x, flat, lens)[0] for x, flat, lens in zip(ids, self.spelling, self.len_of)]
            if not all(np.array_equal(x, text) for x in spelled):
                alone += run                          # a tokenizer changes some piece: find out which
                continue
            rows += run
            for side in (0, 1):
                upto = np.searchsorted(np.cumsum(self.len_of[side][ids[side]]), ends, "right")
                found[side][0].append(ids[side])
                found[side][1].append(np.diff(upto, prepend=0))
        fine = np.ones(len(rows) + len(alone), bool)
        if alone:
            both = self._encode([pieces[i] for i in alone])
            for k, (i, *ids) in enumerate(zip(alone, *both), len(rows)):
                fine[k] = all(b"".join([table[x] for x in y]) == raw[i] for table, y in zip((self.both.bytes_a, self.both.bytes_b), ids))
            for side in (0, 1):
                found[side][0].append(np.fromiter(chain.from_iterable(both[side]), np.int64))
                found[side][1].append(np.fromiter(map(len, both[side]), np.int64))
            rows += alone
        self.known.update(zip([pieces[i] for i in rows], range(len(self.known), len(self.known) + len(rows))))
        for side in (0, 1):
            self.flat[side] = np.concatenate([self.flat[side], *found[side][0]]).astype(np.int32)
            self.sizes[side] = np.concatenate([self.sizes[side], *found[side][1]])
        self.fine = np.concatenate([self.fine, fine])
        self.n_bytes = np.concatenate([self.n_bytes, np.array([len(raw[i]) for i in rows], np.int64)])

    def of(self, texts: list[list[str]]) -> tuple:
        """For texts given as pieces: whether each spells right, its bytes, and for either side the flat
        ids, their lengths in bytes and how many each text has."""
        used = dict.fromkeys(chain.from_iterable(texts))
        if len(self.known) > self.max_pieces:
            self._forget(used)
        if new := [p for p in used if p not in self.known]:
            self.learn(new)
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        rows = np.fromiter(map(self.known.__getitem__, chain.from_iterable(texts)), np.int64, int(counts.sum()))
        owner = np.repeat(np.arange(len(texts)), counts)
        fine = np.bincount(owner, ~self.fine[rows], len(texts)) == 0
        n_bytes = np.bincount(owner, self.n_bytes[rows], len(texts)).astype(np.int64)
        sides = []
        for side in (0, 1):
            ids, lens = ragged(rows, self.flat[side], self.sizes[side])
            sides.append((ids, self.len_of[side][ids], np.bincount(owner, lens, len(texts)).astype(np.int64)))
        return fine, n_bytes, *sides


# ---------------------------------------------------------------- fragments

def fragments(sides, start: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple:
    """Fragments of several ranges at once: ``(ids, tokens per segment)`` of A and B, segments per range.

    ``start`` is the byte at which a range's text begins; tokens that end in ``low < byte <= high`` count.
    """
    n = len(start)
    ids, key, owner = [], [], []
    for flat, lens, counts in sides:
        who = np.repeat(np.arange(n), counts)
        upto = np.cumsum(lens)
        before = np.concatenate([[0], upto])[np.cumsum(counts) - counts]
        end = upto - before[who] + start[who]
        inside = (end > low[who]) & (end <= high[who])
        ids.append(flat[inside])
        owner.append(who[inside])
        key.append((who[inside] << 42) | end[inside])
    at = np.minimum(np.searchsorted(key[1], key[0]), max(len(key[1]) - 1, 0))
    common = key[1][at] == key[0] if len(key[1]) else np.zeros(len(key[0]), bool)
    closes = key[0][common]
    per_range = np.bincount(owner[0][common], minlength=n)
    segments = per_range + 1
    first = np.cumsum(segments) - segments
    closed_before = np.cumsum(per_range) - per_range
    sizes = []
    for k, who in zip(key, owner):
        segment = np.searchsorted(closes, k, "left") - closed_before[who] + first[who]
        sizes.append(np.bincount(segment, minlength=int(segments.sum())).astype(np.int64))
    n_tokens = [np.bincount(who, minlength=n) for who in owner]
    return (ids[0], sizes[0], n_tokens[0]), (ids[1], sizes[1], n_tokens[1]), segments


def join_sizes(parts: list[np.ndarray]) -> np.ndarray:
    """Segment sizes of joined fragments: each suffix merges with the prefix behind it."""
    flat, lens = np.concatenate(parts), np.array([len(p) for p in parts])
    ends = np.cumsum(lens)[:-1]                       # the prefixes that go into the segment before
    segment = np.arange(len(flat)) - np.searchsorted(ends, np.arange(len(flat)), "right")
    return np.bincount(segment, flat).astype(np.int64)


def _lists(flat: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat.astype(np.int32), pa.int32()),
                                    type=pa.list_(pa.field("element", pa.int32())))


_SIDES = "a array<int>, b array<int>, na array<int>, nb array<int>"


def _parts(fine: np.ndarray, a: tuple, b: tuple, segments: np.ndarray) -> list[pa.Array]:
    return [pa.array(fine), _lists(a[0], a[2]), _lists(b[0], b[2]), _lists(a[1], segments), _lists(b[1], segments)]


# ---------------------------------------------------------------- alignment

def _flat(col: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64), pc.list_value_length(col).to_numpy().astype(np.int64)


def _groups(fine: np.ndarray, a: tuple, b: tuple, segments: np.ndarray) -> tuple:
    """Whole documents: the last segment is empty and goes; misspelled documents have no tokens."""
    last = np.cumsum(segments) - 1
    keep_doc, keep_segment = fine, np.repeat(fine, segments)
    keep_segment[last] = False
    out = []
    for flat, sizes, counts in (a, b):
        out.append((flat[np.repeat(keep_doc, counts)], sizes[keep_segment], np.where(keep_doc, counts, 0)))
    return *out, np.where(fine, segments - 1, 0)


@lru_cache(maxsize=1)
def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Every id below ``n`` in decimals, with a comma behind."""
    text = [f"{i}," for i in range(n)]
    return np.frombuffer("".join(text).encode(), np.uint8), np.fromiter(map(len, text), np.int64, n)


def groups_text(a: tuple, b: tuple, groups: np.ndarray) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` for each document: the ids of A and B group by group."""
    n_tokens = a[2] + b[2]
    place_a = np.arange(len(a[0])) + np.repeat(np.cumsum(b[1]) - b[1], a[1])
    place_b = np.arange(len(b[0])) + np.repeat(np.cumsum(a[1]), b[1])
    ids = np.empty(len(a[0]) + len(b[0]), np.int64)
    ids[place_a], ids[place_b] = a[0], b[0]
    data, lens = ragged(ids, *_decimals(1 << int(max(ids.max(initial=1), 1)).bit_length()))
    data, ends = data.copy(), np.cumsum(lens)
    if len(ids):
        data[ends[np.cumsum(a[1] + b[1]) - b[1] - 1] - 1] = ord("|")
        data[ends[np.cumsum(a[1] + b[1]) - 1] - 1] = ord(";")
    cut = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_tokens)])].tolist()
    text = data.tobytes().decode("ascii")
    return [text[i:max(j - 1, i)] for i, j in zip(cut, cut[1:])]


def _cut_ranges(text: str, size: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The pieces of a text, the byte at which each begins, and the byte ranges' bounds; a bound inside
    a piece longer than a range is left out, since only a whole piece can be tokenized."""
    pieces = PIECE.findall(" " + text)
    starts = np.concatenate([[0], np.cumsum([len(p.encode("utf-8")) for p in pieces])])
    bounds = np.arange(size, starts[-1], size)
    at = np.searchsorted(starts, bounds, "right") - 1
    bounds = bounds[(starts[np.minimum(at + 1, len(pieces))] - starts[at] <= size) | (starts[at] == bounds)]
    return pieces, starts, np.concatenate([[0], bounds, starts[-1:]])


def _fields(df: DataFrame, keep: list[str]) -> list[T.StructField]:
    return [T.StructField(c, df.schema[c].dataType) for c in keep]


def _aligned(df: DataFrame, path_a: str, path_b: str, text: str, keep: list[str], range_bytes: int, max_pieces: int, emit, schema) -> DataFrame:
    """Align every row; ``emit`` turns an iterator of ``(keep columns, A, B, groups per row)`` into batches of ``schema``."""
    docs = df.select(*keep, df[text].alias("_text"))
    size = F.coalesce(F.octet_length("_text"), F.lit(0))
    fields, sides = _fields(df, keep), T.StructType.fromDDL(_SIDES).fields

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        tokens = Tokens(tokenizers_of(path_a, path_b), max_pieces)
        for part in text_slices(batches, "_text", SCAN_BYTES):
            texts = [PIECE.findall(" " + t) if t else [] for t in part.column("_text").to_pylist()]
            fine, n_bytes, *both = tokens.of(texts)
            zero = np.zeros(len(texts), np.int64)
            yield part.columns[:-1], *_groups(fine, *fragments(both, zero, zero, n_bytes))

    range_schema = T.StructType([T.StructField(c, T.LongType()) for c in ("_row", "_at", "_ranges", "_start", "_low", "_high")]
                                + [T.StructField("_text", T.StringType())] + fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for i in range(batch.num_rows):
                pieces, starts, bounds = _cut_ranges(batch.column("_text")[i].as_py(), range_bytes)
                held = []
                for k, (low, high) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
                    p, q = int(np.searchsorted(starts, low, "right")) - 1, int(np.searchsorted(starts, high, "left"))
                    held.append((row, k, len(bounds) - 1, int(starts[p]), low, high, "".join(pieces[p:q])))
                n = len(held)
                own = [pa.concat_arrays([batch.column(c).slice(i, 1), pa.nulls(n - 1, batch.column(c).type)]) for c in range(len(keep))]
                cols = [pa.array(x, pa.string() if j == 6 else pa.int64()) for j, x in enumerate(zip(*held))]
                yield pa.RecordBatch.from_arrays([*cols, *own], names=range_schema.names)
                row += 1

    fragment_schema = T.StructType([T.StructField("_row", T.LongType()), T.StructField("_at", T.LongType()), T.StructField("_fine", T.BooleanType())]
                                   + sides + fields)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(tokenizers_of(path_a, path_b), max_pieces)
        for part in text_slices(batches, "_text", SCAN_BYTES):
            fine, _, *both = tokens.of([PIECE.findall(t) for t in part.column("_text").to_pylist()])
            bounds = [part.column(c).to_numpy() for c in ("_start", "_low", "_high")]
            yield pa.RecordBatch.from_arrays([part.column("_row"), part.column("_at"), *_parts(fine, *fragments(both, *bounds)),
                                              *[part.column(c) for c in keep]], names=fragment_schema.names)

    def compose(part: pa.Table) -> pa.Table:
        part = part.sort_by("_at").combine_chunks()
        joined = [pa.array([join_sizes(part.column(c).to_pylist())], pa.list_(pa.field("element", pa.int32()))) for c in ("na", "nb")]
        ids = [_lists(x, np.array([len(x)])) for x in (_flat(pa.chunked_array(part.column(c)).combine_chunks())[0] for c in ("a", "b"))]
        cols = [part.column("_row").slice(0, 1), pa.array([part.column("_at")[0].as_py() // FAN]),
                pa.array([pc.all(part.column("_fine")).as_py()]), *ids, *joined, *[part.column(c).slice(0, 1) for c in keep]]
        return pa.Table.from_arrays([pa.chunked_array([c]) if isinstance(c, pa.Array) else c for c in cols], names=fragment_schema.names)

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i in range(batch.num_rows):           # one long document at a time
                one = batch.slice(i, 1)
                (ia, ca), (ib, cb), (na, segments), (nb, _) = (_flat(one.column(c)) for c in ("a", "b", "na", "nb"))
                yield [one.column(c) for c in keep], *_groups(one.column("_fine").to_numpy(zero_copy_only=False), (ia, na, ca), (ib, nb, cb), segments)

    short = docs.where(size <= range_bytes).mapInArrow(lambda batches: emit(whole(batches)), schema)
    ranges = materialize(docs.where(size > range_bytes).mapInArrow(cut, range_schema), "ranges")
    most = ranges.agg(F.max("_ranges")).first()[0] or 0
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tree = ranges.repartition(n, "_row", "_at").mapInArrow(spell, fragment_schema)
    while most > 1:                                   # a round joins FAN neighbours
        tree = tree.groupBy("_row", F.floor(F.col("_at") / FAN).alias("_to")).applyInArrow(compose, fragment_schema)
        most = -(-most // FAN)
    return short.unionByName(tree.mapInArrow(lambda batches: emit(close(batches)), schema))


def align(df: DataFrame, path_a: str, path_b: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
          range_bytes: int = RANGE_BYTES, max_pieces: int = MAX_PIECES) -> DataFrame:
    """``keep``, ``a``, ``b`` (token ids), ``na``, ``nb`` (tokens of A and B in each group) and ``groups``
    (the same as text: ``a1,a2|b1;a3|b2,b3``) of each row.

    A encodes a space and the text, B the text (it adds the space itself); strings of special tokens
    are plain text.  Null and empty texts, and texts that a tokenizer doesn't spell byte for byte (a
    literal U+2581, for one), have no tokens, no groups and an empty ``groups``.  Texts over
    ``range_bytes`` are cut into ranges of that size; the results don't depend on it.  Every row gives
    one row, repeated or not.
    """
    keep = list(keep)
    schema = T.StructType(_fields(df, keep) + T.StructType.fromDDL(_SIDES).fields + [T.StructField("groups", T.StringType())])

    def emit(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for cols, a, b, groups in rows:
            yield pa.RecordBatch.from_arrays([*cols, *_parts(groups > 0, a, b, groups)[1:], pa.array(groups_text(a, b, groups), pa.string())],
                                             names=schema.names)

    return _aligned(df, path_a, path_b, text, keep, range_bytes, max_pieces, emit, schema)


# ---------------------------------------------------------------- links

def document_links(a: tuple, b: tuple, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct linked pairs of each document (A's id, then B's id), how often each is linked, pairs and
    links per document.

    Every occurrence of A in a group is linked with every one of B; a group of many tokens is
    first reduced to its distinct ids, so equal pairs are never spelled out one by one there.
    """
    n_docs, n_groups = len(groups), len(a[1])
    doc = np.repeat(np.arange(n_docs), groups)
    links = np.bincount(doc, a[1] * b[1], n_docs).astype(np.int64)
    ga, gb = np.repeat(np.arange(n_groups), a[1]), np.repeat(np.arange(n_groups), b[1])
    ids, times, sizes = [a[0].astype(np.int64), b[0].astype(np.int64)], [None, None], [a[1], b[1]]
    large = a[1] * b[1] > 256
    if large.any():
        for side, (g, flat) in enumerate(zip((ga, gb), list(ids))):
            some = large[g]
            key, count = np.unique((g[some] << ID_BITS) | flat[some], return_counts=True)
            g = np.concatenate([g[~some], key >> ID_BITS])
            order = np.argsort(g, kind="stable")
            ids[side] = np.concatenate([flat[~some], key & ((1 << ID_BITS) - 1)])[order]
            times[side] = np.concatenate([np.ones(int((~some).sum()), np.int64), count])[order]
            sizes[side] = np.bincount(g, minlength=n_groups)
        ga = np.repeat(np.arange(n_groups), sizes[0])
    per_a = sizes[1][ga]
    left = np.repeat(np.arange(len(ids[0])), per_a)
    begin = np.cumsum(sizes[1]) - sizes[1]
    right = np.arange(len(left)) - np.repeat(np.cumsum(per_a) - per_a, per_a) + begin[ga][left]
    key = (doc[ga][left] << (2 * ID_BITS)) | (ids[0][left] << ID_BITS) | ids[1][right]
    if times[0] is None:
        key, count = np.unique(key, return_counts=True)
    else:
        key, back = np.unique(key, return_inverse=True)
        count = np.bincount(back, times[0][left] * times[1][right], len(key)).astype(np.int64)
    return key & ((1 << 2 * ID_BITS) - 1), count, np.bincount(key >> (2 * ID_BITS), minlength=n_docs), links


def align_links(df: DataFrame, path_a: str, path_b: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                derived: dict[str, Column] | None = None, range_bytes: int = RANGE_BYTES, max_pieces: int = MAX_PIECES,
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` of each row, ``n_a, n_b, n_groups, n_links, n_best, count_sum`` (long) of its alignment, and the
    ``derived`` columns, expressions over ``keep`` and ``groups`` (as ``align`` gives them).

    A pair's count is the number of rows in which its ids are linked, that is, stand in one group.
    ``n_best`` are the links whose count is the highest of their A id (ties included), ``count_sum``
    sums the counts of all links.  Rows without tokens have zeros.
    """
    keep, derived = list(keep), derived or {}
    own = ["n_a", "n_b", "n_groups", "n_links"]
    schema = T.StructType(_fields(df, keep) + [T.StructField("groups", T.StringType())] + [T.StructField(c, T.LongType()) for c in own] + [
        T.StructField("_block", T.LongType()), T.StructField("_codes", T.BinaryType()), T.StructField("_times", T.BinaryType()),
        T.StructField("_code", T.IntegerType()), T.StructField("_a", T.IntegerType()), T.StructField("_b", T.IntegerType()),
        T.StructField("_docs", T.LongType())])
    names = schema.names

    def send(number: int, docs: list) -> Iterator[pa.RecordBatch]:
        pairs, back, seen = np.unique(np.concatenate([d[2] for d in docs]), return_inverse=True, return_counts=True)
        order = np.argsort(-seen, kind="stable")      # frequent pairs get small codes
        code_of = np.empty(len(order), np.int64)
        code_of[order] = np.arange(len(order))
        codes, width, at = code_of[back], width_of(len(pairs)), 0
        for cols, texts, flat, times, counts, numbers in docs:
            n = len(counts)
            cut = np.concatenate([[0], np.cumsum(counts)]).tolist()
            packed = [pack(codes[at + i:at + j], width) for i, j in zip(cut, cut[1:])]
            often = [pack(t, width_of(int(t.max(initial=0)) + 1)) for t in (times[i:j] for i, j in zip(cut, cut[1:]))]
            at += len(flat)
            yield pa.RecordBatch.from_arrays([*cols, texts, *[pa.array(x, pa.int64()) for x in numbers], pa.array([number] * n, pa.int64()),
                                              pa.array(packed, pa.binary()), pa.array(often, pa.binary()),
                                              *[pa.nulls(n, pa.int32())] * 3, pa.nulls(n, pa.int64())], names=names)
        types = [c.type for c in docs[0][0]]
        for i in range(0, len(order), 50_000):
            some = order[i:i + 50_000]
            n = len(some)
            yield pa.RecordBatch.from_arrays([*[pa.nulls(n, t) for t in types], pa.nulls(n, pa.string()), *[pa.nulls(n, pa.int64())] * 4,
                                              pa.array([number] * n, pa.int64()), *[pa.nulls(n, pa.binary())] * 2,
                                              pa.array(np.arange(i, i + n), pa.int32()), pa.array(pairs[some] >> ID_BITS, pa.int32()),
                                              pa.array(pairs[some] & ((1 << ID_BITS) - 1), pa.int32()), pa.array(seen[some], pa.int64())], names=names)

    def emit(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        number, held, docs = TaskContext.get().partitionId() << 32, 0, []
        for cols, a, b, groups in rows:
            pairs, times, per_doc, links = document_links(a, b, groups)
            docs.append((cols, pa.array(groups_text(a, b, groups), pa.string()), pairs, times.astype(np.uint32), per_doc, (a[2], b[2], groups, links)))
            held += 4 * len(a[0]) + len(groups)       # about the bytes of their text
            if held >= block_bytes:
                yield from send(number, docs)
                number, held, docs = number + 1, 0, []
        if docs:
            yield from send(number, docs)

    marks = _aligned(df, path_a, path_b, text, keep, range_bytes, max_pieces, emit, schema)
    marks = materialize(marks.select(*names, *[e.alias(c) for c, e in derived.items()]).drop("groups"), "links")
    keep += derived
    pairs = marks.where("_code IS NOT NULL").select(F.col("_block").alias("_of"), "_code", "_a", "_b", "_docs")
    counts = pairs.groupBy("_a", "_b").agg(F.sum("_docs").alias("_count"))
    # one row for each id of A: the vocabulary bounds it
    best = counts.groupBy("_a").agg(F.max("_count").alias("_top"))
    counts = counts.join(F.broadcast(best), "_a").select("_a", "_b", "_count", (F.col("_count") == F.col("_top")).alias("_best"))
    known = pairs.join(counts, ["_a", "_b"]).select("_of", "_code", "_count", "_best")
    docs = marks.where("_codes IS NOT NULL").select("_block", *keep, *own, "_codes", "_times")

    def score(docs: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by("_code")
        count, best = known.column("_count").to_numpy(), known.column("_best").to_numpy().astype(np.int64)
        width = width_of(len(count))
        n_best, total = [], []
        for codes, times in zip(docs.column("_codes").to_pylist(), docs.column("_times").to_pylist()):
            codes = unpack(codes, width)
            times = unpack(times, max(len(times) // max(len(codes), 1), 1))
            n_best.append(int(times @ best[codes]))
            total.append(int(times @ count[codes]))
        return pa.Table.from_arrays([*[docs.column(c) for c in [*keep, *own]], pa.chunked_array([pa.array(n_best, pa.int64())]),
                                     pa.chunked_array([pa.array(total, pa.int64())])], names=[*keep, *own, "n_best", "count_sum"])

    result = T.StructType(_fields(marks, keep) + [T.StructField(c, T.LongType()) for c in [*own, "n_best", "count_sum"]])
    return docs.groupBy("_block").cogroup(known.groupBy("_of")).applyInArrow(score, result)
