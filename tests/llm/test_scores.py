"""Quality rules, language-model scores and toxicity against brute force and held-out labels."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_brute import lower, words
from pyspark.sql import functions as F

from equilens.llm import lm_score, quality_rules, toxicity
from equilens.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute_statistics(text):
    w = words(text)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    count = Counter(grams)
    covered = {p for i, g in enumerate(grams) if count[g] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_statistics(spark, docs):
    got = quality_rules.statistics(docs.withColumn("t", F.col("text")), keep=("doc_id", "t")).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_statistics(r.t), r.doc_id
    assert quality_rules.statistics(docs.limit(0)).collect() == []


def test_statistics_cover_whole_tables(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op5_quality_rules"](spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        b = brute_statistics(rows[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        assert r.base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0]) and not (r.base_failed and r.kept)


def test_rules_tell_junk_from_clean_text(spark):
    got = QUERIES["op5_quality_rules"](spark, SF)
    t = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("NOT base_failed").groupBy("quality", "kept").count()
    n = {(r.quality, r.kept): r["count"] for r in t.collect()}
    assert n.get((1, True), 0) >= 0.98 * (n.get((1, True), 0) + n.get((1, False), 0))
    assert n.get((0, False), 0) >= 0.8 * (n.get((0, True), 0) + n.get((0, False), 0))


def test_rules_without_labels_keep_what_the_base_keeps(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    judged, rules = quality_rules.judge(docs, labels)
    assert rules.rules == [] and judged.where("kept = base_failed").count() == 0


def test_rule_learner_finds_a_conjunction(spark):
    """Bad rows: many symbols and few upper-case letters."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(3000):
        s, u = int(rng.integers(0, 100)), int(rng.integers(0, 100))
        rows.append((i, 100, 500, s, 0, 0, u, 0, 0, 10, int(s > 60 and u < 30), i % 3))
    frame = spark.createDataFrame(rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                                        "n_repeat_words long, n_upper long, n_marks long, n_digits long, n_lines long, bad int, part int")
    rules = quality_rules.learn(frame)
    assert {c.measure for c in rules.rules[0]} == {"symbols_per_word", "upper_share"}
    wrong = frame.withColumn("kept", rules.kept()).where("CAST(kept AS INT) = bad").count()
    assert wrong < 90
    assert "reject if" in str(rules)


def brute_lm(rows, mu, mu_pair):
    """Scores of (id, text, train) rows by the model's formulas, each word's whole history at hand."""
    toks = [[w for w in words(lower(t))] + [""] for _, t, _ in rows]
    uni, big, tri = Counter(), Counter(), Counter()
    for t, (_, _, train) in zip(toks, rows):
        if train:
            uni.update(t)
            big.update(zip(t, t[1:]))
            tri.update(zip(t, t[1:], t[2:]))
    n, v = sum(uni.values()), len(uni)
    once, twice = (sum(c == k for c in uni.values()) for k in (1, 2))
    d = once / (once + 2 * twice) if once and twice else 0.5

    def probability(history, w):
        if len(history) == 2:
            lower_order = probability(history[1:], w)
            return (tri[(*history, w)] + mu_pair * lower_order) / (big[history] + mu_pair) if big[history] >= lm_score.MIN_PAIR else lower_order
        p = 1.0 if not n else (uni[w] - d) / n if uni[w] else d * v / n
        return (big[(*history, w)] + mu * p) / (uni[history[0]] + mu) if history and uni[history[0]] else p

    out = []
    for t in toks:
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t)
        total = sum(math.log10(probability(tuple(t[max(i - 2, 0):i]), w)) for i, w in enumerate(t))
        out.append((len(t), sum(uni[w] > 0 for w in t), n, round(base, 6), round(total, 6)))
    return out


@pytest.mark.parametrize("none", [False, True])
def test_lm_matches_brute_force(spark, docs, none, monkeypatch):
    monkeypatch.setattr(lm_score, "BUCKET_ENTRIES", 40)
    train = F.lit(False) if none else F.col("lang") == "en"
    rows = [(r.doc_id, r.text, (not none) and r.lang == "en") for r in docs.collect()]
    got = lm_score.score(docs, train, mu=10.0, mu_pair=3.0).collect()
    want = brute_lm(rows, 10.0, 3.0)
    key = lambda x: str(x)
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got), key=key) \
        == sorted([(i, *w) for (i, _, _), w in zip(rows, want)], key=key)


def test_lm_probabilities_sum_to_one():
    """Over the vocabulary and the unknown word, from the root, from a word's state and from a pair's."""
    counts = np.array([5, 3, 2, 1, 1, 0])
    totals = lm_score.Totals(12, 5, 2, 1)
    texts = [[w] for w in range(6)] + [[0, w] for w in range(6)] + [[1, 0, w] for w in range(6)] + [[1, 0]]
    b = object.__new__(lm_score.Block)
    b.types, b.tokens = np.arange(1, 7, dtype=np.uint64), np.array(sum(texts, []))
    b.sizes = np.array([len(t) for t in texts])
    b.first, b.learns = np.cumsum(b.sizes) - b.sizes, np.zeros(len(b.tokens), bool)
    b.bigrams()
    b.trigrams()
    pairs = np.array([{(0, 0): 2, (0, 2): 2, (0, 3): 1, (1, 0): 3}.get(p, 0) for p in zip(b.state, b.label)])
    triples = np.array([{0: 1, 2: 2}.get(w, 0) for w in b.last])
    p = 10 ** lm_score.BackoffAutomaton(b, counts, pairs, triples, totals, 7.0, 2.0).traverse()
    assert abs(p[:6].sum() - 1) < 1e-12 and abs(p[6:12].sum() - p[0]) < 1e-12 and abs(p[12:18].sum() - p[18]) < 1e-12
    assert p[14] / p[18] > 2 / 5 and p[18] < p[1]


def test_lm_query_on_whole_table(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BUCKET_ENTRIES", 50_000)
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 7 != 2) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {i: w for (i, _, _), w in zip(rows, brute_lm(rows, lm_score.MU, lm_score.MU_PAIR))}
    got = QUERIES["op6_lm_score"](spark, sf).collect()
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert abs(r.base_score - want[r.doc_id][3]) < 1e-5 and abs(r.score - want[r.doc_id][4]) < 1e-5
    held = [r for r in got if r.held_out]
    assert len(got) == len(rows) and sum(r.score for r in held) > sum(r.base_score for r in held)


def brute_kernel(a, b):
    """Gap-weighted three-letter subsequence kernel by enumeration."""
    from itertools import combinations

    def phi(s):
        out = Counter()
        code = toxicity._code(s).tolist()
        for i in combinations(range(len(code)), 3):
            t = tuple(code[x] for x in i)
            if all(t):
                out[t] += toxicity.LAMBDA ** (i[2] - i[0] + 1)
        return out

    x, y = phi(a), phi(b)
    dot = lambda p, q: sum(v * q[k] for k, v in p.items())
    return (dot(x, y) / math.sqrt(dot(x, x) * dot(y, y))) ** toxicity.DEGREE if dot(x, x) and dot(y, y) else 0.0


def test_kernel_matches_enumeration():
    marks = ["idiot", "banana", "réeux"]
    units = ["idiot", "i-d-i-o-t", "idxiot", "bananas", "an", "", "réeuxment", "zzz", "x1d10t", "日本語", "aaaaaaa"]
    got = toxicity.Kernel(marks).of_units(units)
    for i, u in enumerate(units):
        for j, m in enumerate(marks):
            assert abs(got[i, j] - brute_kernel(u, m)) < 1e-4, (u, m)


def test_kernel_of_every_script():
    marks = ["дурак", "βλάκας", "أحمق", "笨蛋东西", "मूर्ख", "hlupák", "žebrák"]
    units = [*marks, "д-у-р-а-к", "дуxрак", "дура", "idiot", "hlupak", "東京都民", "\U000323AF\U0010FFFF"]
    for k in (toxicity.Kernel(marks), toxicity.Kernel([*marks, "".join(map(chr, range(0x4E00, 0x4E00 + 200)))])):
        got = k.of_units(units)
        assert (k.lookup is None) == (len(k.landmarks) > len(marks))
        for i, u in enumerate(units):
            for j, m in enumerate(marks):
                assert abs(got[i, j] - brute_kernel(u, m)) < 1e-4, (u, m)
            assert i >= len(marks) or got[i, i] > 0.999


def test_toxicity_learns_other_scripts(spark):
    rng = np.random.default_rng(6)
    plain = ["тихий", "день", "город", "письмо", "окно", "сестра", "бумага", "сад", "дом", "река", "поле", "शहर", "नदी", "खिड़की"]
    line = lambda: " ".join(rng.choice(plain, 8))
    rows = [(i, f"{line()}. {line()}.", 0) for i in range(120)] + \
        [(200 + i, f"{line()}. {line()} {('дурак', 'मूर्ख')[i % 2]}! {line()}.", 1) for i in range(120)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"),
                         spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert {"дурак", "मूर्ख"} <= set(model.landmarks)
    texts = ["ты дурак", "ты д-у-р-а-к", "तुम मूर्ख हो", "тихий день", "नदी शहर"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [r.s for r in frame.select("i", toxicity.score(F.col("text"), model).alias("s")).orderBy("i").collect()]
    assert min(got[:3]) >= 0.5 > max(got[3:]), got


def test_landmarks_cover_rare_and_many_families(spark):
    """One dominant insult and forty rare ones: each has sure evidence and becomes a landmark."""
    names = [a + b + "rx" for a in ("bak", "dom", "fel", "gor", "hiv", "jun", "kel", "lom") for b in ("a", "e", "i", "o", "u")]
    rows = [(f"word{i % 7} thing{i % 11} n{i}", 0) for i in range(3000)] + [(f"thing{i % 11} idiot n{i}", 1) for i in range(3000)] + \
        [(f"word{i % 7} {w} m{i}", 1) for w in names for i in range(40)]
    rows = [(re.sub(r"\d+", lambda m: "".join(chr(97 + int(d)) for d in m[0]), t), y) for t, y in rows]
    toxic, clean = toxicity._landmarks(spark.createDataFrame(rows, "text string, toxic int"), 8)
    assert toxic[0] == "idiot" and len(clean) == 8
    for w in names:
        assert any(w.startswith(t) or t.startswith(w) for t in toxic), w


def test_long_units_keep_their_insult():
    k = toxicity.Kernel(["idiot"])
    assert k.of_units(["-" * 200 + "idiot" + "-" * 200])[0, 0] > 0.3


def test_single_letters_are_drawn_together():
    assert toxicity._units("you i d i o t now. And a b no.") == (["you", "idiot", "now.", "and", "a", "b", "no."], [0, 3])


def test_toxicity_held_out_and_gapped(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op10_toxicity"](spark, sf)
    t = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").groupBy("toxic", "predicted").count()
    n = {(r.toxic, r.predicted): r["count"] for r in t.collect()}
    assert n[1, 1] >= 0.8 * (n[1, 1] + n.get((1, 0), 0)) and n[0, 0] >= 0.96 * (n[0, 0] + n.get((0, 1), 0))
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_toxicity_tolerates_gaps_and_odd_rows(spark, docs):
    rng = np.random.default_rng(5)
    plain = ["the", "day", "was", "fine", "went", "home", "seven", "garden", "quiet", "letter", "moved", "window", "sister", "paper"]
    line = lambda: " ".join(rng.choice(plain, 8))
    rows = [(i, f"{line()}. {line()}.", 0) for i in range(120)] + \
        [(200 + i, f"{line()}. {line()} idiot {line()}.", 1) for i in range(60)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"),
                         spark.createDataFrame([(i, y) for i, _, y in rows] * 2 + [(7, None)], "doc_id long, toxic int"))
    texts = ["you idiot", "you i-d-i-o-t", "you i d i o t", "you idxiot", "a fine day", "", None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = [r.s for r in frame.select("i", toxicity.score(F.col("text"), model).alias("s")).orderBy("i").collect()]
    assert min(got[:4]) >= 0.5 > max(got[4:]) and got[5] == got[6]
    many = docs.select(toxicity.score(F.col("text"), model).alias("s")).collect()
    assert len(many) == docs.count() and all(0 <= r.s <= 1 for r in many)


def test_toxicity_without_labels(spark, docs):
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r.s < 0.5 for r in docs.select(toxicity.score(F.col("text"), model).alias("s")).collect())
