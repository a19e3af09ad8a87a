"""SimHash near-duplicates with bit-sliced comparison.

* A fingerprint bit is set where more than half of the text's shingle hashes set it.
* Two fingerprints within ``radius`` bits agree on two of ``radius + 2`` segments, so each
  distinct fingerprint goes to one cell for each pair of segments (key: their bits).  A key
  with many members is split into chunks and its cells are chunk pairs: no task holds an
  unbounded group and no pair is left out.
* In a cell, members stand 64 to a machine word, one word for each bit plane.  A query XORs
  the planes with its own bits and adds them into saturating bit-sliced counters by
  carry-save; words whose lanes all exceed the radius are abandoned on the way.
* A cell reports each member's smallest linked member (at most one edge for each member),
  and the components are then joined up by Spark over all cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equilens.llm.common import fresh, materialize

LANES = 64


def _fingerprint(text: str | None, n: int) -> int:
    words = (text or "").encode("utf-8").lower().split()       # bytes: ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    begin = end - size
    k = min(n, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(begin[:len(words) - k + 1].tolist(),
                                                                 end[k - 1:].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """64-bit SimHash (as a signed long) of the whole text's ``shingle``-word sequences.

    A-Z are lower-cased; repeated shingles count each time; a text with fewer words is one
    shingle; null, empty and blank texts have fingerprint zero.
    """
    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([_fingerprint(t.as_py(), shingle) for t in batch], pa.int64())

    return run(text)


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ---------------------------------------------------------------- cells

def _planes(words: np.ndarray) -> np.ndarray:
    """``words x 64`` fingerprints to ``words x 64`` bit planes (bit l of plane b: bit b of lane l)."""
    bits = np.unpackbits(words.view(np.uint8).reshape(len(words), LANES, 8), axis=2, bitorder="little")
    packed = np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64)[:, :, 0]


def _within(planes: np.ndarray, word: np.ndarray, query: np.ndarray, lanes: np.ndarray, radius: int) -> np.ndarray:
    """For each (word, query): the lanes of ``lanes`` at ``radius`` or fewer differing bits."""
    depth = (radius + 1).bit_length()
    out = np.zeros(len(word), np.uint64)
    live = np.arange(len(word))
    count = [np.zeros(len(word), np.uint64) for _ in range(depth)]
    over = ~lanes
    limit = radius + 1
    for plane in range(64):
        bit = (query[live] >> np.uint64(plane)) & np.uint64(1)
        carry = planes[word[live], plane] ^ (np.uint64(0) - bit)
        for c in range(depth):                      # carry-save: one full column of counters at a time
            count[c], carry = count[c] ^ carry, count[c] & carry
        over |= carry
        at_limit = ~over
        for c in range(depth):
            at_limit &= count[c] if (limit >> c) & 1 else ~count[c]
        over |= at_limit
        if plane % 8 == 7:                          # abandon words in which every lane exceeds the radius
            stay = over != ~np.uint64(0)
            if not stay.all():
                live, over, count = live[stay], over[stay], [x[stay] for x in count]
            if not len(live):
                return out
    out[live] = ~over
    return out


def _join_up(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes of each pair (a, b) in ``label`` (a class is named by its smallest member)."""
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _cell_edges(cell: np.ndarray, fp: np.ndarray, side: np.ndarray, radius: int,
                items: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, smallest linked member) of sorted cells.

    ``side`` is 0 or 1 for cells of two chunks (queries: side 0, lanes: side 1), 2 for cells of one chunk.
    """
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(cell)]]))
    keep = np.repeat(sizes > 1, sizes)
    cell, fp, side = cell[keep], fp[keep], side[keep]
    if not len(cell):
        return fp, fp
    label = np.arange(len(cell))
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(cell)]]))
    n_words = (sizes + LANES - 1) // LANES
    group = 0
    while group < len(starts):
        # as many whole cells as fit the plane table
        stop = max(group + 1, int(np.searchsorted(np.cumsum(n_words[group:]), 2048, "right")) + group)
        s, m, w = starts[group:stop], sizes[group:stop], n_words[group:stop]
        first_word = np.cumsum(w) - w
        base, total = int(s[0]), int(m.sum())
        mine = np.repeat(np.arange(len(s)), m)                     # cell of each member
        pos = np.arange(total) - np.repeat(s - base, m)
        slot = first_word[mine] + pos // LANES
        grid = np.zeros((int(w.sum()), LANES), np.uint64)
        grid[slot, pos % LANES] = fp[base:base + total].view(np.uint64)
        planes = _planes(grid)
        target = np.zeros(len(grid), np.uint64)                   # lanes that may be compared with
        sd = side[base:base + total]
        can = sd >= 1
        np.bitwise_or.at(target, slot[can], np.uint64(1) << (pos[can] % LANES).astype(np.uint64))
        queries = np.flatnonzero((sd == 0) | (sd == 2))
        per = w[mine[queries]]
        done = 0
        bounds = np.cumsum(per)
        while done < len(queries):
            upto = max(done + 1, int(np.searchsorted(bounds, (bounds[done - 1] if done else 0) + items, "right")))
            q = queries[done:upto]
            reps = per[done:upto]
            qi = np.repeat(q, reps)
            word = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps) + first_word[mine[qi]]
            hits = _within(planes, word, fp[base + qi].view(np.uint64), target[word], radius)
            on = np.flatnonzero(hits)
            if len(on):
                lanes = np.unpackbits(hits[on].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                r, lane = np.nonzero(lanes)
                other = (word[on[r]] - first_word[mine[qi[on[r]]]]) * LANES + lane + s[mine[qi[on[r]]]]
                _join_up(label, base + qi[on[r]], other)
            done = upto
        group = stop
    linked = label != np.arange(len(label))
    return fp[linked], fp[label[linked]]


def link_edges(fps: DataFrame, radius: int = 2, chunk: int = 4096) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints ``fp`` at ``radius`` or fewer bits.

    Edges span the same components as all linked pairs but are at most one for each member of a cell.
    """
    n_seg = radius + 2
    cuts = [64 * i // n_seg for i in range(n_seg + 1)]

    def segment(i: int) -> Column:
        return F.shiftrightunsigned("fp", cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1))

    keys = [F.xxhash64(F.lit(t), segment(i), segment(j)) for t, (i, j) in enumerate(combinations(range(n_seg), 2))]
    members = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    members = members.join(sizes, "key")
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("chunks")).cast("int")
    cells = members.withColumn("chunks", chunks).withColumn("own", own) \
        .select("fp", "key", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")) \
        .select("fp", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"),
                F.when(F.col("own") < F.col("other"), 0).when(F.col("own") > F.col("other"), 1).otherwise(2)
                .cast("int").alias("side"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush(parts, last):
            cell, fp, side = (np.concatenate(x) for x in zip(*parts))
            cut = len(cell) if last else int(np.searchsorted(cell, cell[-1], "left"))
            a, b = _cell_edges(cell[:cut], fp[:cut], side[:cut], radius) if cut else (fp[:0], fp[:0])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"]), \
                [(cell[cut:], fp[cut:], side[cut:])]

        for batch in batches:
            if batch.num_rows:
                held.append(tuple(batch.column(c).to_numpy() for c in ("cell", "fp", "side")))
                size += batch.num_rows
            if size > 200_000:
                out, held = flush(held, False)
                size = len(held[0][0])
                yield out
        if size:
            yield flush(held, True)[0]

    # rows of one cell meet in one task, sorted so that a task streams over its cells
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node on an edge; the root is the component's smallest node.

    Rounds of hook-to-smallest-neighbour, pointer jumping and contraction; every round's
    tables are written to the shared folder, so the lineage stays short.
    """
    edges = materialize(edges.where("a <> b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("b"))
        for step in range(2):
            up = materialize(up, "hooks")
            nxt = up.select(F.col("a").alias("b"), F.col("b").alias("c"))
            up = up.join(nxt, "b").select("a", F.col("c").alias("b"))
        up = materialize(up, "hooks")
        ua, ub = up.select("a", F.col("b").alias("ra")), up.select(F.col("a").alias("b"), F.col("b").alias("rb"))
        edges = materialize(edges.join(ua, "a").join(ub, "b").where("ra <> rb")
                            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        if labels is None:
            labels = up.select(F.col("a").alias("node"), F.col("b").alias("root"))
        else:
            moved = up.select(F.col("a").alias("root"), F.col("b").alias("to"))
            labels = labels.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            labels = materialize(labels, "labels")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels


def near_duplicates(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                    shingle: int = 3, radius: int = 2) -> DataFrame:
    """``keep`` columns of every row, ``fp`` and ``component`` (its smallest fingerprint, by value).

    ``keep[0]`` is the id: ``component_id`` is the smallest id in the component (null ids
    count only where a component has no other).  Rows with equal text, repeated rows among
    them, share a fingerprint; null, empty and blank texts share fingerprint zero.
    """
    keyed = materialize(docs.select(*keep, fingerprint(docs[text], shingle).alias("fp")), "fingerprints")
    by_fp = keyed.groupBy("fp").agg(F.min(keep[0]).alias("low"))
    by_fp = materialize(by_fp, "distinct")
    roots = components(link_edges(by_fp.select("fp"), radius)).withColumnRenamed("node", "fp")
    placed = by_fp.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("component"))
    lows = placed.groupBy("component").agg(F.min("low").alias("component_id"))
    return keyed.join(placed.select("fp", "component").join(lows, "component"), "fp")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3, radius: int = 2) -> DataFrame:
    """``docs`` without near-duplicates: of every component the row with the smallest id stays.

    Among rows of that id the smallest text hash decides; of fully repeated rows one stays.
    """
    key, n = fresh(docs, "text_key", "copy_no")
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(docs[text], F.lit(""))))
    near = near_duplicates(keyed, text, (doc_id, key), shingle, radius)
    # null ids lose against others, as in component_id
    order = F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"), F.col(key).alias("key"))
    best = near.groupBy("component").agg(F.min(order).alias("best")).select(
        F.col("best.id").alias("id"), F.col("best.key").alias("key"))
    kept = keyed.join(best, keyed[doc_id].eqNullSafe(best["id"]) & (keyed[key] == best["key"]), "left_semi")
    w = Window.partitionBy(doc_id, key).orderBy(F.xxhash64(*docs.columns))
    return kept.withColumn(n, F.row_number().over(w)).where(F.col(n) == 1).select(*docs.columns)
