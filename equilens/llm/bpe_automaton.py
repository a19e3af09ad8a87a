"""BPE encoding and decoding through a tokenization automaton.

The automaton reads token sequences and accepts exactly those that byte-pair encoding
produces.  It starts as one state with an arc per byte.  Each merge ``(a, b) -> ab``, in
rank order, applies one merge gadget: the state behind ``a`` loses its arc ``b``, and every
state with an arc ``a`` gains an arc ``ab`` to where ``b`` led.  All arcs of one label lead
to one state, so a state is named by the last token.  The gadgets are kept as versions:

* ``removed[(a, b)]``: when the state behind ``a`` lost arc ``b``;
* the state behind ``ab`` was, at its birth, the state behind ``b``;
* an arc ``ab`` exists where arc ``a`` existed at the birth of ``ab``.

Whether arc ``y`` leaves state ``x`` follows from these versions and is remembered in a
transition table that fills as arcs are used.  A word is encoded from left to right: every
prefix has one accepted tokenization, so the state at each byte is fixed, and vocabulary
arcs that spell the next bytes (a dense byte table) are followed where the automaton has
them.  Decoding emits the arcs' labels.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from equilens.llm.common import text_slices
from equilens.llm.token_counts import WHITE, byte_symbols

# the split pattern of byte-level BPE: fixed by the public vocabulary
SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+"
                      rf"|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
# pre-tokens never cross the end of a run without white space: coarse chunks may be cut first
CHUNK = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
NEVER = np.iinfo(np.int32).max
LONG_WORD = 64


class Automaton:
    """Versioned transition structure compiled from a byte-level tokenizer file."""

    def __init__(self, path: str, table_bits: int = 20):
        spec = json.load(open(path, encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        to_byte = {c: b for b, c in enumerate(byte_symbols())}
        self.labels: list[bytes] = [b""] * size
        self.birth = np.zeros(size, np.int32)
        self.left = np.zeros(size, np.int32)
        self.right = np.zeros(size, np.int32)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        live = {}
        for char, b in to_byte.items():
            live[vocab[char]] = bytes([b])
        keys, times = [], []
        self._pairs: dict[int, int] = {}
        for time, merge in enumerate(spec["model"]["merges"], 1):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            ia, ib, new = vocab[a], vocab[b], vocab[a + b]
            # the gadget applies only where the path a, b exists and ab is new
            if ia not in live or ib not in live or new in live or not self._arc_one(ia, ib):
                continue
            live[new] = live[ia] + live[ib]
            self.birth[new], self.left[new], self.right[new] = time, ia, ib
            self._pairs[(ia << 16) | ib] = time
            keys.append((ia << 16) | ib)
            times.append(time)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[order]
        self.times = np.array(times, np.int32)[order]
        for i, label in live.items():
            self.labels[i] = label
        for content, i in self.special.items():
            self.labels[i] = content.encode("utf-8")
        self._compile_spelling(live)
        self.memo_key = np.full(1 << table_bits, -1, np.int64)
        self.memo = np.zeros(1 << table_bits, bool)
        self.mask = (1 << table_bits) - 1
        self.label_flat = np.frombuffer(b"".join(self.labels), np.uint8)
        self.label_len = np.array([len(x) for x in self.labels], np.int64)
        self.label_at = np.cumsum(self.label_len) - self.label_len

    def _compile_spelling(self, live: dict[int, bytes]) -> None:
        """Byte table: node x byte -> node, and the token whose label ends at a node."""
        children: list[dict[int, int]] = [{}]
        token = [-1]
        for i, label in live.items():
            node = 0
            for byte in label:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    token.append(-1)
                node = children[node][byte]
            token[node] = i
        # nodes with children come first, so the table has no rows for the many ends
        inner = [n for n, kids in enumerate(children) if kids]
        number = {n: i for i, n in enumerate(inner)}
        for n, kids in enumerate(children):
            if not kids:
                number[n] = len(number)
        self.n_inner = len(inner)
        self.step = np.zeros((self.n_inner, 256), np.int32)        # 0: no such spelling
        for n in inner:
            for byte, child in children[n].items():
                self.step[number[n], byte] = number[child]
        self.token = np.empty(len(token), np.int32)
        self.token[[number[n] for n in range(len(token))]] = token

    def _arc_one(self, x: int, y: int) -> bool:
        """Has the state behind token ``x`` an arc ``y`` after the gadgets applied so far?"""
        limit = NEVER
        while True:
            if self._pairs.get((x << 16) | y, NEVER) < limit:
                return False
            bx, by = int(self.birth[x]), int(self.birth[y])
            if bx == by == 0:
                return True
            if by >= bx:
                y, limit = int(self.left[y]), by + 1
            else:
                x, limit = int(self.right[x]), bx

    def _arcs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """``_arc_one`` for arrays, from the versions."""
        out = np.ones(len(x), bool)
        at, limit = np.arange(len(x)), np.full(len(x), NEVER, np.int32)
        while len(at):
            key = (x.astype(np.int64) << 16) | y
            pos = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            gone = (self.keys[pos] == key) & (self.times[pos] < limit)
            out[at[gone]] = False
            bx, by = self.birth[x], self.birth[y]
            go = ~gone & ((bx > 0) | (by > 0))
            by_y = by >= bx
            limit = np.where(by_y, by + 1, bx)[go]
            x, y = np.where(by_y, x, self.right[x])[go], np.where(by_y, self.left[y], y)[go]
            at = at[go]
        return out

    def arcs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Transitions by table; entries not there yet are derived and stored."""
        key = (x.astype(np.int64) << 16) | y
        slot = ((key * 0x9E3779B1) >> 12) & self.mask
        out = self.memo[slot]
        miss = np.flatnonzero(self.memo_key[slot] != key)
        if len(miss):
            got = self._arcs(x[miss], y[miss])
            out[miss] = got
            self.memo_key[slot[miss]] = key[miss]
            # slots hit twice keep the last key written; write the value that belongs to it
            mine = self.memo_key[slot[miss]] == key[miss]
            self.memo[slot[miss][mine]] = got[mine]
        return out

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each pre-token (none is empty)."""
        out: list = [None] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for low, high in ((0, 6), (6, 10), (10, 16), (16, 32), (32, LONG_WORD)):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            for i in range(0, len(rows), 20_000):
                part = rows[i:i + 20_000]
                for r, ids in zip(part.tolist(), self._encode_block([words[r] for r in part], sizes[part])):
                    out[r] = ids
        for r in np.flatnonzero(sizes > LONG_WORD).tolist():
            out[r] = self._encode_long(words[r])
        return out

    def _encode_block(self, words: list[bytes], sizes: np.ndarray) -> list[list[int]]:
        width = int(sizes.max())
        grid = np.zeros((len(words), width), np.uint8)
        grid[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        last = np.full((len(words), width + 1), -1, np.int32)      # token that ends at each byte
        for j in range(width):
            rows = np.flatnonzero(sizes > j)
            node = np.zeros(len(rows), np.int32)
            for k in range(j, width):
                node = self.step[node, grid[rows, k]]
                on = (node > 0) & (sizes[rows] > k)
                rows, node = rows[on], node[on]
                if not len(rows):
                    break
                tok = self.token[node]
                have = tok >= 0
                r, t = rows[have], tok[have]
                if j:
                    ok = self.arcs(last[r, j], t)
                    r, t = r[ok], t[ok]
                last[r, k + 1] = t
                on = node < self.n_inner
                rows, node = rows[on], node[on]
        # walk back along the arcs, all words at once
        at, rows = sizes.copy(), np.arange(len(words))
        found: list[list[int]] = [[] for _ in words]
        while len(rows):
            t = last[rows, at[rows]]
            for r, x in zip(rows.tolist(), t.tolist()):
                found[r].append(x)
            at[rows] -= self.label_len[t]
            rows = rows[at[rows] > 0]
        for ids in found:
            ids.reverse()
        return found

    def _encode_long(self, word: bytes) -> list[int]:
        """The same walk for one long pre-token (bounded steps for each byte)."""
        last = [-1] * (len(word) + 1)
        step, token = self.step, self.token
        for j in range(len(word)):
            node, state = 0, last[j]
            for k in range(j, len(word)):
                node = step[node, word[k]]
                if not node:
                    break
                t = int(token[node])
                if t >= 0 and (j == 0 or self._arc_one(state, t)):
                    last[k + 1] = t
                if node >= self.n_inner:
                    break
        ids, at = [], len(word)
        while at:
            ids.append(last[at])
            at -= len(self.labels[last[at]])
        return ids[::-1]

    def emit(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Decode: the labels of the arcs, as text; bytes that are no UTF-8 become U+FFFD."""
        lens = self.label_len[ids]
        ends = np.concatenate([[0], np.cumsum(lens)])
        pos = np.arange(ends[-1]) - np.repeat(ends[:-1], lens) + np.repeat(self.label_at[ids], lens)
        flat = self.label_flat[pos].tobytes()
        cut = ends[offsets].tolist()
        return [flat[a:b].decode("utf-8", errors="replace") for a, b in zip(cut, cut[1:])]


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    return Automaton(path)


class Encoder:
    """Encodes texts; remembers the ids of up to ``max_chunks`` chunks in flat arrays."""

    def __init__(self, auto: Automaton, max_chunks: int):
        self.auto, self.max_chunks = auto, max_chunks
        self.split_special = re.compile("(" + "|".join(map(re.escape, auto.special)) + ")") if auto.special else None
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64)
        for content, i in self.auto.special.items():
            self.add([content], [[i]])

    def keep(self, used: set[str]) -> None:
        """Forget all chunks but those in use now, the frequent ones among them."""
        kept = [c for c in self.known if c in used and c not in self.auto.special]
        rows = np.array([self.known[c] for c in kept], np.int64)
        begin, sizes, flat = np.cumsum(self.sizes) - self.sizes, self.sizes[rows], self.flat
        at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begin[rows], sizes)
        self.clear()
        self.known.update(zip(kept, range(len(self.known), len(self.known) + len(kept))))
        self.flat, self.sizes = np.concatenate([self.flat, flat[at]]), np.concatenate([self.sizes, sizes])

    def add(self, chunks: list[str], ids: list[list[int]]) -> None:
        self.known.update(zip(chunks, range(len(self.known), len(self.known) + len(chunks))))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))
        self.flat, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])

    def chunks(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self.split_special is not None and "<|" in text:
            parts = self.split_special.split(text)
            return [c for p in parts for c in ([p] if p in self.auto.special else CHUNK.findall(p))]
        return CHUNK.findall(text)

    def learn(self, chunks: list[str]) -> None:
        # letters alone, with or without the space before, are one pre-token
        plain = [c for c in chunks if c.isalpha() or c[0] == " " and c[1:].isalpha()]
        rest = list(set(chunks).difference(plain))
        seen = dict(zip(plain, range(len(plain))))
        parts = [[seen.setdefault(w, len(seen)) for w in SPLIT.findall(c)] for c in rest]
        ids = self.auto.encode_words([w.encode("utf-8") for w in seen])
        self.add(plain + rest, ids[:len(plain)] + [[i for w in p for i in ids[w]] for p in parts])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the offsets of each text (empty for null and empty texts)."""
        split = [self.chunks(t) for t in texts]
        used = set().union(*split)
        if len(self.known) > self.max_chunks:
            self.keep(used)
        new = used - self.known.keys()
        if new:
            self.learn(list(new))
        counts = np.fromiter(map(len, split), np.int64, len(split))
        rows = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        begin = np.cumsum(self.sizes) - self.sizes
        lens = self.sizes[rows]
        ends = np.concatenate([[0], np.cumsum(lens)])
        ids = self.flat[np.arange(ends[-1]) - np.repeat(ends[:-1], lens) + np.repeat(begin[rows], lens)]
        return ids, ends[np.concatenate([[0], np.cumsum(counts)])]


def _schema(df: DataFrame, keep: list[str], **new: T.DataType) -> T.StructType:
    return T.StructType([df.schema[c] for c in keep] + [T.StructField(k, t) for k, t in new.items()])


def encode(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
           decoded: bool = False, max_chunks: int = 150_000) -> DataFrame:
    """``keep`` columns, ``ids`` (array of token ids) and, if asked for, ``decoded``.

    Null and empty texts give no ids and decode to the empty text.  ``decoded`` is emitted
    from the ids in the same pass; ``decode`` does that for stored ids.  Special strings
    inside a text become their special token.  Every row gives one row, repeated or not.
    """
    keep = list(keep)
    new = {"ids": T.ArrayType(T.IntegerType(), False)} | ({"decoded": T.StringType()} if decoded else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(automaton(path), max_chunks)
        for part in text_slices(batches, "_text", 2 << 20):
            ids, offsets = enc.encode(part.column("_text").to_pylist())
            cols = [part.column(i) for i in range(len(keep))]
            cols.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())))
            if decoded:
                cols.append(pa.array(enc.auto.emit(ids, offsets), pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *new])

    return df.select(*keep, df[text].alias("_text")).mapInArrow(run, _schema(df, keep, **new))


def decode(df: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``decoded``, the text that the ids' arcs spell (null ids: empty text)."""
    keep = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(path)
        for batch in batches:
            rows = batch.column("_ids").to_pylist()
            flat = np.fromiter(chain.from_iterable(r or () for r in rows), np.int64)
            sizes = [len(r or ()) for r in rows]
            texts = auto.emit(flat, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]))
            cols = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string())], names=[*keep, "decoded"])

    return df.select(*keep, df[ids].alias("_ids")).mapInArrow(run, _schema(df, keep, decoded=T.StringType()))
