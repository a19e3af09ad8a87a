"""Toxicity: a support vector machine over a gap-weighted subsequence string kernel.

The kernel of two strings sums over common subsequences of three letters, each weighted by
``LAMBDA`` to the power of the spans it takes in both; normalised and cubed, "idiot",
"i-d-i-o-t" and "idxiot" stay close.  A sentence is represented by the largest kernel value that any of its
units (a word, or a run of single letters drawn together) has with each of ``m`` landmark
words, mapped by the Nyström transform of the landmarks' kernel matrix; a linear support
vector machine gives its margin, and a text's margin is that of its most toxic sentence.

Labels belong to texts, so sentences are labelled in rounds: every sentence of a clean text
is clean; of a toxic text the sentence with the highest margin and those above zero are toxic.  Landmarks are
the words whose presence the labels depend on most, counted by Spark over the fitting rows.

Every letter of every script is a symbol of its own.  Words are what stands between spaces: in
scripts written without spaces only whole runs and their first letters can become landmarks, and
so can no word of under three letters.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, combinations, islice, takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equilens.llm.common import materialize, text_slices

LAMBDA = 0.7             # weight of one position of span
DEGREE = 3               # power of the normalised kernel: many weak likenesses do not add up to a strong one
STEMS = (3, 4, 5)        # lengths of the stems that may be landmarks
MAX_LOOKUP = 1 << 22     # triples of symbols in a table; of larger alphabets they are searched for
WINDOW = 24              # longer units are compared in windows of this many characters, half overlapping
# a symbol is the code point of a letter or of a mark that belongs to one, or the start mark;
# digits read as the letters they resemble; anything else is 0, which holds a place but matches nothing
START = "^"
_TOP = 0x32400           # no letters beyond


def _is_letter(c: str) -> bool:
    return unicodedata.category(c)[0] in "LM"


@lru_cache(maxsize=2)
def _symbols(n: int) -> np.ndarray:
    """Symbol of each of the first ``n`` code points; the last is none."""
    out = np.fromiter((i if _is_letter(chr(i)) or chr(i) == START else 0 for i in range(n)), np.uint32, n)
    out[list(b"013457")] = list(b"oieast")
    return out.astype(np.uint8) if n <= 256 else out


_EDGE = re.compile(r"^\W+|\W+$")


def _core(unit: str) -> str:
    """The unit without what is neither letter, mark nor digit at its ends."""
    if unit.isascii():
        return _EDGE.sub("", unit)
    a, b = 0, len(unit)
    while a < b and not (unit[a].isalnum() or unit[a] == "_"):
        a += 1
    while a < b and not (unit[b - 1].isalnum() or unit[b - 1] == "_" or _is_letter(unit[b - 1])):
        b -= 1
    return unit[a:b]


def _spelt(word: str) -> bool:
    """Letters only, with the marks that belong to them."""
    return word.isalpha() or not word.isascii() and all(map(_is_letter, word))


# ---------------------------------------------------------------- kernel

@lru_cache(maxsize=64)
def _triples(n: int) -> tuple[np.ndarray, ...]:
    at = np.array(list(combinations(range(n), 3)), np.int64).reshape(-1, 3)
    return at[:, 0], at[:, 1], at[:, 2], LAMBDA ** (at[:, 2] - at[:, 0] + 1.0)


def _codes(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Flat symbol codes of all units, each after a start mark, and their sizes.  Units hold no line breaks."""
    text = f"\n{START}".join(units)
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    text = f"{START}{text}\n"
    try:
        raw = np.frombuffer(text.encode("latin-1"), np.uint8)
        symbols = _symbols(256)
    except UnicodeEncodeError:
        raw = np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), _TOP - 1)
        symbols = _symbols(_TOP)
    ends = np.flatnonzero(raw == 10)
    size = np.diff(np.concatenate([[-1], ends])) - 1
    return symbols[raw[raw != 10]], size


def _code(word: str) -> np.ndarray:
    return _codes([word])[0]


def _self_kernel(codes: np.ndarray) -> np.ndarray:
    """Unnormalised kernel of each row with itself."""
    rows, n = codes.shape
    decay = np.tril(LAMBDA ** np.subtract.outer(np.arange(n), np.arange(n)).clip(0).astype(np.float32), -1).T
    same = ((codes[:, :, None] == codes[:, None, :]) & (codes[:, :, None] > 0)).astype(np.float32)
    e = same * np.float32(LAMBDA ** 2)
    for _ in range(2):
        # symmetric, so both sides of the double decay are one product and a transpose each
        e = (e.reshape(-1, n) @ decay).reshape(rows, n, n).transpose(0, 2, 1).reshape(-1, n) @ decay
        e = e.reshape(rows, n, n) * same
    return e.sum(axis=(1, 2))


class Kernel:
    """Normalised kernel values of many strings with the landmark words."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        codes = [_code(word) for word in landmarks]
        # the alphabet: the landmarks' letters from 1 on; 0 is any other, which no landmark has
        letters = np.unique(np.concatenate([np.zeros(1, np.int64), *codes])).astype(np.int64)
        letters = letters[letters > 0]
        self.base = len(letters) + 1
        self.symbol = np.zeros(max(int(letters.max(initial=0)) + 2, 256), np.int64)
        self.symbol[letters] = np.arange(1, self.base)
        parts = []
        for code in codes:
            i, j, k, w = _triples(len(code))
            ok = (code[i] > 0) & (code[j] > 0) & (code[k] > 0)
            parts.append((self._triple(code[None], i, j, k)[0, ok], w[ok]))
        self.keys = np.unique(np.concatenate([np.zeros(0, np.int64), *(t for t, _ in parts)]))
        self.lookup = None
        if self.base ** 3 <= MAX_LOOKUP:
            self.lookup = np.full(self.base ** 3, -1, np.int16 if len(self.keys) < 1 << 15 else np.int32)
            self.lookup[self.keys] = np.arange(len(self.keys))
        self.basis = np.zeros((max(len(self.keys), 1), len(landmarks)), np.float32)
        for col, (triple, w) in enumerate(parts):
            np.add.at(self.basis[:, col], np.searchsorted(self.keys, triple), w)
        self.basis /= np.maximum(np.sqrt((self.basis ** 2).sum(axis=0)), 1e-12)

    def _triple(self, codes: np.ndarray, i: np.ndarray, j: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Three places of each row as one number in base ``base``; one with another letter is no landmark's."""
        if codes.dtype != np.uint8:
            codes = np.minimum(codes, len(self.symbol) - 1)
        c = self.symbol[codes]
        if self.base ** 3 <= MAX_LOOKUP:
            c = c.astype(np.int32)
        return c[:, i] * (self.base * self.base) + c[:, j] * self.base + c[:, k]

    def _feature(self, triple: np.ndarray) -> np.ndarray:
        """Row of ``basis`` for each triple, -1 where no landmark has it."""
        if self.lookup is not None:
            return self.lookup[triple]
        at = np.minimum(np.searchsorted(self.keys, triple), len(self.keys) - 1)
        return np.where(self.keys[at] == triple, at, -1)

    def of_units(self, units: list[str]) -> np.ndarray:
        """``len(units) x m``: the largest value over the windows of each unit."""
        out = np.zeros((len(units), len(self.landmarks)), np.float32)
        flat, size = _codes(units)
        begin = np.cumsum(size) - size
        owner = np.arange(len(units))
        long = np.flatnonzero(size > WINDOW)
        if len(long):                       # half-overlapping windows of the long ones
            cut = [(o, begin[o] + i, min(WINDOW, size[o] - i)) for o in long.tolist()
                   for i in range(0, int(size[o]) - WINDOW // 2, WINDOW // 2)]
            short = size <= WINDOW
            more = np.array(cut, np.int64)
            owner, begin, size = (np.concatenate([x[short], more[:, c]]) for c, x in enumerate((owner, begin, size)))
        for n in np.unique(size[size >= 3]).tolist():
            rows = np.flatnonzero(size == n)
            step = max(1, 3_200_000 // max(32, len(self.landmarks)) // len(_triples(n)[0]))
            for i in range(0, len(rows), step):
                part = rows[i:i + step]
                got = self._block(flat[begin[part][:, None] + np.arange(n)])
                own = owner[part]
                if len(long):
                    np.maximum.at(out, own, got)
                else:
                    out[own] = got
        return out

    def _block(self, codes: np.ndarray) -> np.ndarray:
        i, j, k, w = _triples(codes.shape[1])
        feat = self._feature(self._triple(codes, i, j, k))
        row, col = np.nonzero(feat >= 0)
        out = np.zeros((len(codes), len(self.landmarks)), np.float32)
        if len(row):
            values = self.basis[feat[row, col]] * w[col, None].astype(np.float32)
            starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            hit = row[starts]
            norm = np.sqrt(np.maximum(_self_kernel(codes[hit]), 1e-12))
            out[hit] = (np.add.reduceat(values, starts, axis=0) / norm[:, None]) ** DEGREE
        return out


# ---------------------------------------------------------------- sentences

def _units(text: str | None) -> tuple[list[str], list[int]]:
    """Units of a text and the position at which each sentence begins."""
    words = (text or "").lower().split()
    if not words:
        return [], []
    size = np.fromiter(map(len, words), np.int64, len(words))
    single = size == 1
    if single.any() and (single[2:] & single[1:-1] & single[:-2]).any():
        edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
        out, done = [], 0
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a >= 3:
                out += words[done:a] + ["".join(words[a:b])]
                done = b
        words = out + words[done:]
    ends = [i + 1 for i, w in enumerate(words[:-1]) if w[-1] in ".!?"]
    return words, [0, *ends]


class SentenceFeatures:
    """Largest kernel value per landmark for every sentence; keeps the units it has seen, boundedly."""

    def __init__(self, kernel: Kernel, max_units: int = 150_000):
        self.kernel, self.max_units = kernel, max_units * 32 // max(32, len(kernel.landmarks))
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1 << 12, len(self.kernel.landmarks)), np.float32)

    def of_texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Features of all sentences and the number of sentences of each text."""
        split = [_units(t) for t in texts]
        used = set().union(*(u for u, _ in split))
        if len(self.known) > self.max_units:        # keep what is in use now, the frequent units among it
            kept = [u for u in self.known if u in used]
            self.rows = self.rows[[self.known[u] for u in kept]]
            self.known = dict(zip(kept, range(len(kept))))
        new = list(used - self.known.keys())
        if new:
            first = len(self.known)
            need = first + len(new)
            if need > len(self.rows):
                grown = np.zeros((need + (1 << 15), self.rows.shape[1]), np.float32)
                grown[:first] = self.rows[:first]
                self.rows = grown
            self.rows[first:need] = self.kernel.of_units(new)
            self.known.update(zip(new, range(first, need)))
        total = sum(len(u) for u, _ in split)
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(u for u, _ in split)), np.int64, total)
        base, starts, counts = 0, [], []
        for units, begins in split:
            starts += [base + b for b in begins]
            counts.append(len(begins))
            base += len(units)
        if not starts:
            return np.zeros((0, self.rows.shape[1]), np.float32), np.array(counts, np.int64)
        return np.maximum.reduceat(self.rows[at], np.array(starts), axis=0), np.array(counts, np.int64)


# ---------------------------------------------------------------- model

@dataclass(frozen=True)
class Model:
    """Landmarks, a sentence margin's weights on kernel values (Nyström map folded in), and the text score's weights.

    The score is logistic in a text's highest margin and the share of its sentences above zero.
    """

    landmarks: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float
    logistic: tuple[float, float, float]

    def evidence(self, texts: list[str | None], features: SentenceFeatures) -> np.ndarray:
        rows, counts = features.of_texts(texts)
        return _evidence(rows @ np.array(self.weights) + self.bias, counts, self.bias)

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence @ np.array(self.logistic), -40, 40)))


def _evidence(margin: np.ndarray, counts: np.ndarray, bias: float) -> np.ndarray:
    """Highest margin (clipped), log share of sentences with a positive margin, and 1, for each text."""
    out = np.tile([bias, 0.0, 1.0], (len(counts), 1))
    have = counts > 0
    if have.any():
        starts = (np.cumsum(counts) - counts)[have]
        out[have, 0] = np.maximum.reduceat(margin, starts)
        out[have, 1] = np.add.reduceat((margin > 0).astype(float), starts) / counts[have]
    out[:, 0] = np.clip(out[:, 0], -2, 2)
    out[:, 1] = np.log(out[:, 1] + 1e-3) - math.log(1e-3)
    return out


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Squared-hinge linear support vector machine by Newton steps; the last weight is the bias."""
    x = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    last = None
    for _ in range(rounds):
        active = y * (x @ w) < 1
        if last is not None and (active == last).all():
            break
        last = active
        xa = x[active] * weight[active, None]
        w = np.linalg.solve(ridge + c * xa.T @ x[active], c * xa.T @ y[active])
    return w


def _balanced(y: np.ndarray) -> np.ndarray:
    pos = max(int((y > 0).sum()), 1)
    neg = max(len(y) - pos, 1)
    return np.where(y > 0, 0.5 / pos, 0.5 / neg) * 1000


def _variants(word: str) -> list[str]:
    """The word with separators between its letters, and with one letter put in at each inner place."""
    return ["-".join(word), " ".join(word).replace(" ", ".")] + \
        [word[:i] + "xqzv"[i % 4] + word[i:] for i in range(1, len(word))]


def _marks(labels: DataFrame, use: Column | None, doc_id: str, toxic: str) -> DataFrame:
    marks = labels.where(F.col(toxic).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(toxic).cast("int").alias("toxic"))
    return marks if use is None else marks.where(use)


def _sample(docs: DataFrame, marks: DataFrame, text: str, doc_id: str, per_class: int) -> DataFrame:
    """Texts of at most ``per_class`` ids of each label, those of the smallest id hashes; repeated texts count once.

    The ids are chosen before any text is read, so the broadcast holds 2 x ``per_class`` rows at most.
    """
    ids = [marks.where(F.col("toxic") == y).orderBy(F.xxhash64("id")).limit(per_class) for y in (0, 1)]
    ids = materialize(ids[0].unionByName(ids[1]), "toxic-ids")
    texts = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    texts = texts.join(F.broadcast(ids), "id")
    sample = texts.groupBy("text").agg(F.min("id").alias("id"), F.max("toxic").alias("toxic"))
    return materialize(sample.repartition(32, "text"), "toxic-sample")


def _landmarks(sample: DataFrame, n_clean: int) -> tuple[list[str], list[str]]:
    """Words by dependence of the label on their presence (a G statistic), and the most frequent others.

    Every word whose statistic is sure enough is a landmark or shares the letters of one from its
    start on; the sample bounds their number.
    """
    def sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", 1 << 20):
            out, t = [], []
            for text, y in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                units, begins = _units(text)
                for a, b in zip(begins, [*begins[1:], len(units)]):
                    found = {_core(u) for u in units[a:b]}
                    out.append(sorted(u for u in found if 3 <= len(u) <= WINDOW and _spelt(u)))
                    t.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string())), pa.array(t, pa.int32())],
                                             names=["words", "toxic"])

    # sentences that copies share count once, or the words of one copied text would look telling
    rows = sample.select("text", "toxic").mapInArrow(sentences, "words array<string>, toxic int") \
        .groupBy("words").agg(F.max("toxic").alias("toxic"))
    rows = materialize(rows, "sentences")
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = float(n.get(1, 0)), float(n.get(0, 0))
    if not n1 or not n0:
        return [], []
    # a word, and the stems (first letters) that inflected or compound forms share
    stems = F.flatten(F.transform("words", lambda w: F.concat(
        F.when(F.length(w) <= WINDOW // 2, F.array(w)).otherwise(F.array().cast("array<string>")),
        F.transform(F.filter(F.lit(list(STEMS)), lambda n: F.length(w) > n), lambda n: F.substring(w, F.lit(1), n)))))
    counts = rows.select(F.explode(F.array_distinct(stems)).alias("word"), "toxic").groupBy("word") \
        .agg(F.sum("toxic").alias("c1"), F.sum(1 - F.col("toxic")).alias("c0"))
    c1, c0 = F.col("c1"), F.col("c0")

    def term(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    share = (c1 + c0) / (n1 + n0)
    g = term(c1, share * n1) + term(c0, share * n0) + term(n1 - c1, (1 - share) * n1) + term(n0 - c0, (1 - share) * n0)
    counts = counts.where((c1 + c0 >= 3) & (c1 + c0 < n1 + n0)).withColumn("g", F.when(c1 / n1 > c0 / n0, g).otherwise(0.0))
    found = counts.where("g >= 16").orderBy(F.desc("g"), F.desc(F.length("word")), "word").collect()
    by_word = sorted((r["word"], i) for i, r in enumerate(found))
    toxic: list[str] = []
    for r in found:
        # the longest word that tells nearly as much as its stem stands for it
        same = takewhile(lambda x: x[0].startswith(r["word"]), islice(by_word, bisect_left(by_word, (r["word"], 0)), None))
        word = max((x for x in same if found[x[1]]["g"] >= 0.8 * r["g"]), key=lambda x: (len(x[0]), -x[1]))[0]
        if not any(word.startswith(t) or t.startswith(word) for t in toxic):
            toxic.append(word)
    clean = [r["word"] for r in counts.where("g = 0").orderBy(F.desc("c0"), "word").limit(n_clean).collect()]
    return toxic, clean


def fit(docs: DataFrame, labels: DataFrame, use: Column | None = None, text: str = "text", doc_id: str = "doc_id",
        toxic: str = "toxic", n_clean: int = 8, per_class: int = 6000, top: int = 5,
        rounds: int = 4) -> Model:
    """Fit on the labelled documents whose ``id`` meets the condition ``use``.

    The fit takes at most ``per_class`` texts of each label (the documented bound) and
    gathers ``top`` sentences of each on the driver, as kernel values, and two numbers a text.
    Every word of these with sure evidence is covered by a landmark, however many there are.
    A document labelled twice is toxic if any label says so; null labels and null texts are
    left out; repeated texts count once.  Without texts of both labels the model scores every
    text by the label share.
    """
    marks = materialize(_marks(labels, use, doc_id, toxic), "marks")
    sample = _sample(docs, marks, text, doc_id, per_class)
    telling, clean = _landmarks(sample, n_clean)
    landmarks, n_toxic = telling + clean, len(telling)
    if not telling:
        rate = sample.agg(F.avg("toxic")).first()[0] or 0.0
        rate = min(max(rate, 1e-6), 1 - 1e-6)
        return Model((), (), 0.0, (0.0, 0.0, math.log(rate / (1 - rate))))
    kernel = Kernel(landmarks)
    m = len(landmarks)

    def top_sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feats = SentenceFeatures(Kernel(landmarks))
        for part in text_slices(batches, "text", 1 << 20):
            rows, counts = feats.of_texts(part.column("text").to_pylist())
            first = rows[:, :n_toxic].max(axis=1) if len(rows) else np.zeros(0)
            ids, ys, ks, base = [], [], [], 0
            for i, (row_id, y, c) in enumerate(zip(part.column("row").to_pylist(), part.column("toxic").to_pylist(), counts.tolist())):
                best = base + np.argsort(-first[base:base + c], kind="stable")[:top]
                ids += [row_id] * len(best)
                ys += [y] * len(best)
                ks += [k.tolist() for k in rows[best]]
                base += c
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ys, pa.int32()),
                                              pa.array(ks, pa.list_(pa.float32()))], names=["row", "toxic", "k"])

    picked = sample.select(F.xxhash64("id", "text").alias("row"), "text", "toxic") \
        .mapInArrow(top_sentences, "row long, toxic int, k array<float>").collect()
    picked.sort(key=lambda r: (r["row"], r["toxic"], [-x for x in r["k"]]))
    k = np.array([r["k"] for r in picked], np.float64).reshape(-1, m)
    y = np.array([1.0 if r["toxic"] else -1.0 for r in picked])
    row = np.array([r["row"] for r in picked])
    vals, vecs = np.linalg.eigh(kernel.of_units(landmarks).astype(np.float64) + 1e-6 * np.eye(m))
    nystrom = vecs @ np.diag(1 / np.sqrt(np.maximum(vals, 1e-3))) @ vecs.T
    score = k[:, :n_toxic].max(axis=1)
    extra = np.zeros((0, m))
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    sure = score >= 0.95                    # at first: a sentence with a landmark itself
    odd = np.zeros(len(row), bool)          # far on the wrong side: a label that the text doesn't bear out
    for _ in range(rounds):
        best = np.zeros(len(row), bool)
        for a, b in zip(starts, [*starts[1:], len(row)]):
            best[a + int(np.argmax(score[a:b]))] = True
        use = ((y < 0) | best | sure) & ~odd
        x, t = np.vstack([k[use], extra]) @ nystrom, np.concatenate([y[use], np.ones(len(extra))])
        w = _svm(x, t, _balanced(t))
        folded, bias = nystrom @ w[:-1], w[-1]
        score = k @ folded + bias
        odd, sure = np.where(y > 0, score < 0, score > 1), score > 0
        # gapped spellings of landmarks that the machine finds toxic by themselves
        toxic = [word for word, s in zip(landmarks, kernel.of_units(landmarks) @ folded + bias) if s >= 0]
        extra = kernel.of_units([v for word in toxic for v in _variants(word)]).astype(np.float64).reshape(-1, m)
    sentence = Model(tuple(landmarks), tuple(folded.tolist()), float(bias), (1.0, 0.0, 0.0))

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feats = SentenceFeatures(Kernel(landmarks))
        for part in text_slices(batches, "text", 1 << 20):
            e = sentence.evidence(part.column("text").to_pylist(), feats)
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(e[:, 0]), pa.array(e[:, 1])], names=["toxic", "a", "b"])

    texts = sample.select("text", "toxic").mapInArrow(evidence, "toxic int, a double, b double").collect()
    texts.sort()
    told = np.array([float(r["toxic"]) for r in texts])
    total = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = np.where(told > 0, total[1] / max(told.sum(), 1), total[0] / max((1 - told).sum(), 1))
    logistic = _logistic(np.array([[r["a"], r["b"], 1.0] for r in texts]), told, share)
    return Model(tuple(landmarks), tuple(folded.tolist()), float(bias), logistic)


def _logistic(x: np.ndarray, label: np.ndarray, weight: np.ndarray, rounds: int = 60) -> tuple[float, ...]:
    """Logistic fit by damped Newton steps; ``weight`` gives the sample the classes' true shares."""
    weight = weight / weight.sum()
    w = np.zeros(x.shape[1])
    ridge = 1e-5 * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - label)) + ridge @ w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        move = np.linalg.solve(hess, grad)
        w = w - move * min(1.0, 4 / max(np.abs(move).max(), 1e-9))
    return tuple(float(v) for v in w)


def score(text: Column, model: Model) -> Column:
    """Score (0 to 1) of each whole text; null and empty texts have the score of no toxic sentence."""
    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        feats = SentenceFeatures(Kernel(list(model.landmarks))) if model.landmarks else None
        for batch in batches:
            out = []
            for i in range(0, len(batch), 256):
                texts = batch.slice(i, 256).to_pylist()
                found = model.evidence(texts, feats) if feats else np.tile([0.0, 0.0, 1.0], (len(texts), 1))
                out.append(model.scores(found))
            yield pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return run(text)
