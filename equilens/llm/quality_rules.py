"""Quality rules: base statistics of a text and a decision list learned from labels.

All in DataFrame and SQL functions.  Sequential covering learns rules that find bad
documents: a rule is a conjunction of thresholds, grown condition by condition (the gain
counts come from one aggregate over threshold bins), pruned on rows set aside, and kept while
it is precise; rows it covers go, and the next rule is grown.  The result is an ordered list
of Spark conditions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equilens.llm.common import NOT_WORD_GAP, WORD_GAP, bucket_of, materialize, words_of

SYMBOLS = r"[^#*$%&|<>]+"           # all but the symbols that count

# derived measures that rules may test, from the columns of ``statistics``
MEASURES: dict[str, str] = {
    "n_words": "CAST(n_words AS DOUBLE)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def _left_after(text: Column, pattern: str) -> Column:
    """Code points that remain when ``pattern`` is taken out."""
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the counts of every whole text (null: no words, no lines).

    ``n_repeat_words`` counts words in windows of three words found twice or more in the
    text: the windows' hashes are sorted with their positions, equal neighbours repeat.
    """
    cols = list(keep)
    base = docs.select(*[F.col(c) for c in cols], F.coalesce(F.col(text), F.lit("")).alias("_t"))
    base = base.withColumn("_h", F.transform(words_of(F.col("_t")), lambda w: F.xxhash64(w)))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(NOT_WORD_GAP))
    windows = F.when(F.size("_h") >= 3, F.transform(
        F.sequence(F.lit(0), F.size("_h") - 3),
        lambda i: F.struct(F.xxhash64(F.get("_h", i), F.get("_h", i + 1), F.get("_h", i + 2)).alias("g"), i.alias("p"))))
    base = base.select(*cols, F.size("_h").cast("long").alias("n_words"), _left_after(F.col("_t"), WORD_GAP).alias("word_chars"),
                       _left_after(F.col("_t"), SYMBOLS).alias("n_symbols"), lines.alias("_l"), F.sort_array(windows).alias("_w"),
                       _left_after(F.col("_t"), r"[^\p{Lu}]+").alias("n_upper"),
                       _left_after(F.col("_t"), r"[^!?]+").alias("n_marks"),
                       _left_after(F.col("_t"), r"[^0-9]+").alias("n_digits"))
    again = F.filter("_w", lambda x, i: (x["g"] == F.get("_w", i - 1)["g"]) | (x["g"] == F.get("_w", i + 1)["g"]))
    covered = F.flatten(F.transform(again, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))
    return base.select(*cols, "n_words", "word_chars", "n_symbols",
                       (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
                       F.coalesce(F.size(F.array_distinct(F.when(F.col("_w").isNotNull(), covered))), F.lit(0))
                       .cast("long").alias("n_repeat_words_raw"), "n_upper", "n_marks", "n_digits",
                       F.size("_l").cast("long").alias("n_lines")) \
        .withColumn("n_repeat_words", F.greatest("n_repeat_words_raw", F.lit(0))).drop("n_repeat_words_raw")


def base_failed(n_words: str = "n_words", n_repeat: str = "n_repeat_words") -> Column:
    return (F.col(n_words) < 50) | (100 * F.col(n_repeat) > 50 * F.col(n_words))


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    cut: float

    def expr(self) -> Column:
        value = F.expr(MEASURES[self.measure])
        return value > self.cut if self.above else value <= self.cut

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.cut:.6g}"


@dataclass
class DecisionList:
    """Rules in order; a document that none covers is kept."""

    rules: list[list[Condition]] = field(default_factory=list)

    def kept(self) -> Column:
        out = None
        for rule in self.rules:
            cond = _all(rule)
            out = F.when(cond, False) if out is None else out.when(cond, False)
        return F.lit(True) if out is None else out.otherwise(True)

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(map(str, r)) for r in self.rules) + "\nelse keep"


def _all(conds: list[Condition]) -> Column:
    out = F.lit(True)
    for c in conds:
        out = out & c.expr()
    return out


def _cuts(rows: DataFrame, n_cuts: int) -> dict[str, list[float]]:
    """Candidate thresholds: each class's quantiles (2 x n_cuts numbers a measure)."""
    at = [i / (n_cuts + 1) for i in range(1, n_cuts + 1)]
    got = rows.groupBy("bad").agg(*[F.percentile_approx(F.expr(e), at, 2000).alias(m) for m, e in MEASURES.items()]).collect()
    return {m: sorted({float(v) for r in got for v in r[m] or ()}) for m in MEASURES}


def _bin(value: Column, cuts: list[float]) -> Column:
    """Number of cuts below the value."""
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < value))


def learn(rows: DataFrame, max_rules: int = 8, max_conditions: int = 3, n_cuts: int = 19, min_cover: int = 5,
          min_precision: float = 0.8) -> DecisionList:
    """Decision list from ``rows``: the columns of ``statistics``, ``bad`` (0/1) and ``part`` (0..2).

    Parts 0 and 1 grow rules, part 2 prunes and judges them.  Counts cover all rows; what
    reaches the driver is one row for each measure and bin.  Without rows of both classes
    the list is empty and keeps everything.
    """
    rows = materialize(rows, "labelled")
    cuts = _cuts(rows, n_cuts)
    if not any(cuts.values()):
        return DecisionList()
    bins = [F.struct(F.lit(m).alias("m"), _bin(F.expr(MEASURES[m]), cs).alias("b")) for m, cs in cuts.items() if cs]
    binned = materialize(rows.withColumn("bins", F.array(*bins)), "bins")
    out, open_rows = DecisionList(), F.lit(True)
    grow, prune = F.col("part") < 2, F.col("part") == 2
    for _ in range(max_rules):
        rule: list[Condition] = []
        while len(rule) < max_conditions:
            cells = binned.where(open_rows & grow & _all(rule)).select("bad", F.explode("bins").alias("x")) \
                .groupBy("x.m", "x.b").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
            best = _best_condition(cells, cuts, min_cover)
            if best is None:
                break
            rule.append(best[0])
            if best[1] == 0:                # covers no good row any more
                break
        if not rule:
            break
        heads = [_all(rule[:k]) for k in range(1, len(rule) + 1)]
        got = binned.where(open_rows & prune).agg(
            *[F.sum(F.when(h, F.col("bad"))).alias(f"p{k}") for k, h in enumerate(heads)],
            *[F.sum(F.when(h, 1 - F.col("bad"))).alias(f"n{k}") for k, h in enumerate(heads)]).first()
        score = [((got[f"p{k}"] or 0), (got[f"n{k}"] or 0)) for k in range(len(rule))]
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in score]
        k = max(range(len(rule)), key=lambda i: (worth[i], -i))
        p, n = score[k]
        if p < max(1, min_cover // 2) or p / (p + n) < min_precision:
            break
        out.rules.append(rule[:k + 1])
        open_rows = open_rows & ~_all(rule[:k + 1])
    return out


def _best_condition(cells, cuts: dict[str, list[float]], min_cover: int) -> tuple[Condition, int] | None:
    """The threshold of most information gain over the bin counts, and the good rows it covers."""
    per: dict[str, dict[int, tuple[int, int]]] = {}
    for r in cells:
        per.setdefault(r["m"], {})[r["b"]] = (r["p"], r["n"])
    best, top = None, 1e-9
    for m in sorted(per):
        bins = per[m]
        p0, n0 = sum(p for p, _ in bins.values()), sum(n for _, n in bins.values())
        if not p0 or not n0:
            continue
        before = math.log2(p0 / (p0 + n0))
        p = n = 0
        for i, cut in enumerate(cuts[m]):
            # bins 0..i hold values <= cut
            p, n = p + bins.get(i, (0, 0))[0], n + bins.get(i, (0, 0))[1]
            for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
                if pp >= min_cover:
                    gain = pp * (math.log2(pp / (pp + nn)) - before)
                    if gain > top:
                        best, top = (Condition(m, above, cut), nn), gain
    return best


def label_rows(stats: DataFrame, labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality") -> DataFrame:
    """Statistics of labelled documents that pass the base rules, with ``bad`` and ``part``."""
    marks = labels.where(F.col(quality).isNotNull()).groupBy(F.col(doc_id).alias("label_id")) \
        .agg((F.max(quality) == 0).cast("int").alias("bad"))
    return stats.where(~base_failed()).join(marks, stats[doc_id] == marks["label_id"]).drop("label_id") \
        .withColumn("part", bucket_of(F.col(doc_id), 3))


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DecisionList]:
    """``(doc_id, statistics..., base_failed, kept)`` of every row, and the learned list."""
    stats = materialize(statistics(docs, text, (doc_id,)), "statistics")
    rules = learn(label_rows(stats, labels, doc_id))
    return stats.withColumn("base_failed", base_failed()) \
        .withColumn("kept", ~F.col("base_failed") & rules.kept()), rules
