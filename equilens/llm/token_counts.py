"""Token counts by rank-synchronous merging of ragged numpy arrays.

All distinct pre-tokens of a batch are held in one flat symbol array with sequence
offsets.  A round looks up the rank of every adjacent pair, takes each sequence's lowest
rank, merges all occurrences of that pair in every sequence at once, and drops sequences
that have no mergeable pair left.  What survives is the token count.

Spark splits the documents over tasks; a task keeps a bounded table of the chunks (runs
without white space) it has counted, so repeated words cost one dictionary access.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode White_Space, which both tokenizer files mean by \s
WHITE = "\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WHITE_RUN = re.compile(f"[{WHITE}]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")
NO_RANK = np.iinfo(np.int32).max


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    chars = {b: chr(b) for b in plain}
    return [chars.get(b) or chr(next(spare)) for b in range(256)]


class RankTable:
    """Merge ranks of a tokenizer file in arrays: sorted pair keys, ranks and merged symbols."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, vocab = spec["model"], spec["model"]["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        # the right part's name carries the word-end suffix, the merged name keeps it
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.first = np.array([vocab[c] for c in byte_symbols()], np.int32)
        self.last = np.array([vocab[c + suffix] for c in byte_symbols()], np.int32)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split_special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(split.replace(r"\s", WHITE))

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Symbols that survive in each of ``words`` (none is empty)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.first[raw]
        ends = np.cumsum(sizes)
        sym[ends - 1] = self.last[raw[ends - 1]]
        out, ids = sizes.copy(), np.arange(len(words))
        while len(ids):
            starts = np.cumsum(sizes) - sizes
            tail = starts + sizes - 1
            rank = np.full(len(sym), NO_RANK, np.int32)
            if len(sym) > 1:
                rank[:-1] = self.rank_of(sym[:-1], sym[1:])
            rank[tail] = NO_RANK                      # a pair never spans two sequences
            lowest = np.minimum.reduceat(rank, starts)
            live = lowest != NO_RANK
            out[ids] = sizes
            if not live.any():
                break
            keep = np.repeat(live, sizes)
            sym, rank = sym[keep], rank[keep]
            sizes, ids, lowest = sizes[live], ids[live], lowest[live]
            hit = rank == np.repeat(lowest, sizes)
            # in a run of overlapping hits (equal symbols) every other one merges, from the left
            at = np.arange(len(hit))
            begin = hit.copy()
            begin[1:] &= ~hit[:-1]
            hit &= (at - np.maximum.accumulate(np.where(begin, at, 0))) % 2 == 0
            sym[hit] = self.merged[rank[hit]]
            gone = np.zeros(len(hit), bool)
            gone[1:] = hit[:-1]
            first = np.cumsum(sizes) - sizes
            sizes = sizes - np.add.reduceat(gone, first, dtype=np.int64)
            sym = sym[~gone]
        return out


@lru_cache(maxsize=2)
def rank_table(path: str) -> RankTable:
    return RankTable(path)


def white_chunks(text: str) -> list[str]:
    """Runs without Unicode white space (``str.split`` also cuts at \\x1c-\\x1f, so those texts go by pattern)."""
    if _SEPARATORS.search(text):
        return [c for c in _WHITE_RUN.split(text) if c]
    return text.split()


def lower_each(text: str) -> str:
    """Lower-case character by character (a capital sigma never takes its final form)."""
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


class ChunkCounter:
    """Counts per chunk, remembered up to ``max_chunks`` distinct chunks."""

    def __init__(self, table: RankTable, max_chunks: int):
        self.table, self.max_chunks, self.known = table, max_chunks, {}

    def learn(self, chunks: list[str]) -> None:
        extra = np.zeros(len(chunks), np.int64)
        owner, words, seen = [], [], {}
        for i, chunk in enumerate(chunks):
            parts = [chunk]
            if self.table.split_special is not None and "<|" in chunk:
                extra[i] = len(self.table.split_special.findall(chunk))
                parts = self.table.split_special.split(chunk)
            for part in parts:
                part = lower_each(part if part.isascii() else unicodedata.normalize("NFC", part))
                for word in (part,) if part.isalpha() else self.table.pattern.findall(part):
                    words.append(seen.setdefault(word, len(seen)))
                    owner.append(i)
        if words:
            counts = self.table.counts([w.encode("utf-8") for w in seen])
            extra += np.bincount(owner, counts[words], len(chunks)).astype(np.int64)
        self.known.update(zip(chunks, extra.tolist()))

    def count(self, texts: list[str | None]) -> list[int]:
        split = [white_chunks(t) if t else [] for t in texts]
        used = set().union(*split)
        if len(self.known) > self.max_chunks:       # keep what is in use now, the frequent chunks among it
            self.known = {c: n for c, n in self.known.items() if c in used}
        new = used - self.known.keys()
        if new:
            self.learn(list(new))
        get = self.known.__getitem__
        return [sum(map(get, chunks)) for chunks in split]


def token_count(text: Column, path: str, max_chunks: int = 300_000) -> Column:
    """Tokens of each whole text under the tokenizer file at ``path``.

    Null and empty texts have 0 tokens.  Special strings inside a text count one token
    each, as the library does by default; no begin, end or added tokens, no truncation.
    ``max_chunks`` bounds the memory of a task, not what is counted.
    """

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = ChunkCounter(rank_table(path), max_chunks)
        for batch in batches:
            out, step = [], 512
            for i in range(0, len(batch), step):
                out += counter.count(batch.slice(i, step).to_pylist())
            yield pa.array(out, pa.int64())

    return count(text)
