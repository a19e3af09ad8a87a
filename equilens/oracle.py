"""DuckDB oracle SQL for the registered queries (independent formulations).

The fixture views are spelled out as CTEs over the raw tables; pairwise
metrics are computed by explicit group-pair self-joins here, unlike the
Spark side, which uses closed forms, so the two check each other.
"""

from __future__ import annotations

SCORED = """
scored AS (
  SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber,
         CAST(l.l_quantity > 25 AS INTEGER) AS label_Y,
         CAST(((l.l_partkey*7 + l.l_suppkey*13 + l.l_linenumber*29) % 101) >= 50 AS INTEGER) AS pred_Y,
         CAST((l.l_partkey*7 + l.l_suppkey*13 + l.l_linenumber*29) % 101 AS BIGINT) AS score_pct,
         CAST((l.l_partkey*7 + l.l_suppkey*13 + l.l_linenumber*29) % 101 AS DOUBLE) / 100.0 AS score_S,
         l.l_linestatus, o.o_orderpriority, c.c_mktsegment
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
                  JOIN customer c ON o.o_custkey = c.c_custkey)"""


def _sd(a, b):
    return f"CASE WHEN ({b}) > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0.0 END"


def _counts(grp_expr, prot_name):
    return f"""
  SELECT '{prot_name}' AS protected, {grp_expr} AS group_value, COUNT(*) AS n,
    SUM(CASE WHEN pred_Y<>0 AND label_Y<>0 THEN 1 ELSE 0 END) AS tp,
    SUM(CASE WHEN pred_Y<>0 AND label_Y=0 THEN 1 ELSE 0 END) AS fp,
    SUM(CASE WHEN pred_Y=0 AND label_Y<>0 THEN 1 ELSE 0 END) AS fn,
    SUM(CASE WHEN pred_Y=0 AND label_Y=0 THEN 1 ELSE 0 END) AS tn,
    SUM(CASE WHEN label_Y=1 THEN 1 ELSE 0 END) AS n_pos,
    SUM(CASE WHEN label_Y=0 THEN 1 ELSE 0 END) AS n_neg,
    SUM(CASE WHEN label_Y=1 THEN score_S END) AS sum_score_pos,
    SUM(CASE WHEN label_Y=0 THEN score_S END) AS sum_score_neg
  FROM scored"""


def conf_cte(protected=("l_linestatus", "o_orderpriority", "c_mktsegment")):
    parts = [_counts(f"COALESCE(CAST({p} AS VARCHAR), 'NaN')", p) + f" GROUP BY {p}" for p in protected]
    parts.append(_counts("CAST(NULL AS VARCHAR)", "__overall__"))
    raw = " UNION ALL ".join(parts)
    return f"""
counts AS ({raw}),
conf AS (
  SELECT protected, group_value, CAST(n AS BIGINT) n, CAST(tp AS BIGINT) tp, CAST(fp AS BIGINT) fp,
         CAST(fn AS BIGINT) fn, CAST(tn AS BIGINT) tn, CAST(n_pos AS BIGINT) n_pos,
         CAST(n_neg AS BIGINT) n_neg, sum_score_pos, sum_score_neg,
         {_sd('tp', 'tp+fn')} TPR, {_sd('fp', 'fp+tn')} FPR, {_sd('fn', 'tp+fn')} FNR,
         {_sd('tn', 'tn+fp')} TNR, {_sd('tp', 'tp+fp')} PPV, {_sd('tn', 'tn+fn')} NPV,
         {_sd('fp', 'tp+fp')} FDR, {_sd('fn', 'fn+tn')} "FOR", {_sd('tp+tn', 'n')} ACC,
         {_sd('tp+fp', 'n')} PPOS,
         {_sd('COALESCE(sum_score_pos,0.0)', 'n_pos')} mean_score_pos,
         {_sd('COALESCE(sum_score_neg,0.0)', 'n_neg')} mean_score_neg
  FROM counts)"""


_PAIR_EXPR = {
    "BNC": "abs(a.mean_score_neg - b.mean_score_neg)",
    "BPC": "abs(a.mean_score_pos - b.mean_score_pos)",
    "CUAE": "greatest(abs(a.PPV - b.PPV), abs(a.NPV - b.NPV))",
    "EOpp": "abs(a.TPR - b.TPR)",
    "EO": "greatest(abs(a.TPR - b.TPR), abs(a.FPR - b.FPR))",
    "FDRP": "abs(a.FDR - b.FDR)",
    "FORP": 'abs(a."FOR" - b."FOR")',
    "FNRB": "abs(a.FNR - b.FNR)",
    "FPRB": "abs(a.FPR - b.FPR)",
    "NPVP": "abs(a.NPV - b.NPV)",
    "OAE": "abs(a.ACC - b.ACC)",
    "PPVP": "abs(a.PPV - b.PPV)",
    "SP": "abs(a.PPOS - b.PPOS)",
}


def fairness_cte(metrics=None):
    metrics = metrics or list(_PAIR_EXPR)
    sel = " UNION ALL ".join(
        f"SELECT '{m}' AS metric, a.protected, avg({_PAIR_EXPR[m]}) AS value FROM conf a JOIN conf b "
        f"ON a.protected = b.protected AND a.group_value < b.group_value "
        f"WHERE a.protected <> '__overall__' GROUP BY a.protected" for m in metrics)
    return f"fair AS ({sel})"


def _with(*ctes):
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes)


ORACLE: dict[str, str] = {}

ORACLE["confusion_by_group"] = _with(SCORED, conf_cte()) + """
SELECT protected, group_value, n, tp, fp, fn, tn, n_pos, n_neg,
  round(sum_score_pos, 6) sum_score_pos, round(sum_score_neg, 6) sum_score_neg,
  round(TPR,6) TPR, round(FPR,6) FPR, round(FNR,6) FNR, round(TNR,6) TNR, round(PPV,6) PPV,
  round(NPV,6) NPV, round(FDR,6) FDR, round("FOR",6) "FOR", round(ACC,6) ACC, round(PPOS,6) PPOS,
  round(mean_score_pos,6) mean_score_pos, round(mean_score_neg,6) mean_score_neg FROM conf"""

ORACLE["accuracy_metrics"] = _with(SCORED, conf_cte()) + """
SELECT metric, round(value, 6) AS value FROM (
  SELECT 'ACC' metric, ACC value FROM conf WHERE protected='__overall__' UNION ALL
  SELECT 'F1', CASE WHEN PPV+TPR > 0 THEN 2*PPV*TPR/(PPV+TPR) ELSE 0.0 END FROM conf WHERE protected='__overall__' UNION ALL
  SELECT 'Recall', TPR FROM conf WHERE protected='__overall__' UNION ALL
  SELECT 'Precision', PPV FROM conf WHERE protected='__overall__')"""

for _m in _PAIR_EXPR:
    ORACLE[f"fairness_{_m.lower()}"] = _with(SCORED, conf_cte(), fairness_cte([_m])) + \
        "\nSELECT metric, protected, round(value, 6) AS value FROM fair"

ORACLE["fairness_all"] = _with(SCORED, conf_cte(), fairness_cte()) + \
    "\nSELECT metric, protected, round(value, 6) AS value FROM fair"

ORACLE["overall_fairness"] = _with(SCORED, conf_cte(), fairness_cte()) + \
    "\nSELECT round(greatest(0.0, 1.0 - coalesce(avg(value), 0.0)), 6) AS overall_fairness FROM fair"

ORACLE["performance_matrix"] = _with(SCORED, conf_cte()) + """
SELECT protected, group_value, round(ACC,6) accuracy, round(PPV,6) "precision", round(TPR,6) recall,
  round(CASE WHEN PPV+TPR>0 THEN 2*PPV*TPR/(PPV+TPR) ELSE 0.0 END, 6) f1, n AS support
FROM conf WHERE protected <> '__overall__'"""

ORACLE["ratio_mode"] = _with(SCORED, conf_cte()) + "\n" + " UNION ALL ".join(
    f"""SELECT protected, '{r}' AS rate, '{m}' AS mode, round({expr}, 6) AS value
  FROM conf WHERE protected <> '__overall__' GROUP BY protected"""
    for r in ("TPR", "FPR", "PPV", "ACC")
    for m, expr in (("difference", f"max({r}) - min({r})"),
                    ("ratio", f"CASE WHEN max({r}) > 0 THEN min({r}) / max({r}) ELSE 0.0 END")))


# ---- step 2 -----------------------------------------------------------------
AUDIT = """
audit AS MATERIALIZED (
  SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice, l.l_discount, l.l_tax,
         p.p_retailprice, l.l_returnflag, l.l_linenumber, p.p_type, p.p_brand,
         o.o_orderpriority, c.c_mktsegment, o.o_totalprice
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
                  JOIN customer c ON o.o_custkey = c.c_custkey
                  JOIN part p ON l.l_partkey = p.p_partkey)"""
NULLS = """
nulls AS (
  SELECT * REPLACE (nullif(l_returnflag, 'N') AS l_returnflag, nullif(l_discount, 0.05) AS l_discount),
         CAST(NULL AS DOUBLE) AS all_null
  FROM audit)"""
DOCS = """
docs AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
         FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

AUDIT_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "p_retailprice"]
AUDIT_CAT = ["l_returnflag", "l_linenumber", "p_type", "p_brand"]
AUDIT_PROT = ["o_orderpriority", "c_mktsegment"]
_PROFILE_NUMERIC = AUDIT_NUM + ["l_linenumber", "o_totalprice", "all_null"]
_PROFILE_COLS = AUDIT_NUM + AUDIT_CAT + AUDIT_PROT + ["o_totalprice", "all_null"]


def _profile_sql():
    parts = []
    for c in _PROFILE_COLS:
        num = c in _PROFILE_NUMERIC
        cont = f"(count(DISTINCT {c}) > 10)" if num else "false"
        stat = (lambda f: f"round(CASE WHEN {cont} THEN {f}(CAST({c} AS DOUBLE)) END, 4)") if num else \
            (lambda f: "CAST(NULL AS DOUBLE)")
        parts.append(f"""SELECT '{c}' AS attr,
  CASE WHEN {cont} THEN 'continuous' ELSE 'categorical' END AS kind,
  CAST(count(DISTINCT {c}) AS BIGINT) AS unique_values,
  CAST(count(*) - count({c}) AS BIGINT) AS missing_count,
  round((count(*) - count({c})) * 100.0 / count(*), 6) AS missing_percentage,
  {stat('min')} AS min, {stat('max')} AS max, {stat('avg')} AS mean, {stat('stddev_samp')} AS std
FROM nulls""")
    return _with(AUDIT, NULLS) + "\n" + "\nUNION ALL\n".join(parts)


ORACLE["column_profile"] = _profile_sql()

ORACLE["value_counts_top10"] = _with(AUDIT, """
vc AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS attr, CAST({c} AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS cnt FROM audit "
    f"WHERE {c} IS NOT NULL GROUP BY {c}" for c in AUDIT_CAT + AUDIT_PROT) + ")") + """
SELECT * FROM (SELECT attr, value, cnt,
  CAST(row_number() OVER (PARTITION BY attr ORDER BY cnt DESC, value ASC) AS INTEGER) AS rank FROM vc)
WHERE rank <= 10"""

ORACLE["target_distribution"] = _with(DOCS) + """
SELECT CAST(toxic AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS cnt FROM docs GROUP BY toxic"""


def _hist_sql(k=10):
    parts = []
    for c in AUDIT_NUM:
        parts.append(f"""
SELECT '{c}' AS attr, CAST(b.bin AS INTEGER) AS bin, round(b.lo, 4) lo, round(b.hi, 4) hi,
       CAST(count(x.v) AS BIGINT) AS cnt
FROM (SELECT i AS bin,
             CASE WHEN i = 0 THEN mn ELSE mn + i * ((mx - mn) / {k}) END AS lo,
             CASE WHEN i = {k} - 1 THEN mx ELSE mn + (i + 1) * ((mx - mn) / {k}) END AS hi
      FROM (SELECT min({c}) mn, max({c}) mx FROM audit), range({k}) t(i)) b
LEFT JOIN (SELECT CAST({c} AS DOUBLE) v, min({c}) OVER () mn, max({c}) OVER () mx FROM audit) x
  ON b.bin = CAST(least(greatest(
        (SELECT count(*) FROM range(1, {k}) e(j) WHERE x.mn + e.j * ((x.mx - x.mn) / {k}) < x.v), 0), {k} - 1) AS INTEGER)
GROUP BY b.bin, b.lo, b.hi""")
    return _with(AUDIT) + "\nUNION ALL\n".join(parts)


ORACLE["histogram"] = _hist_sql()

_RATES = """
rates AS (""" + " UNION ALL ".join(
    f"""SELECT '{p}' AS protected, CAST({p} AS VARCHAR) AS group_value, CAST(count(*) AS BIGINT) n,
       CAST(sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) n_pos,
       sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) * 1.0 / count(*) AS positive_rate
  FROM docs WHERE {p} IS NOT NULL GROUP BY {p}""" for p in ("lang", "source")) + ")"
_BIAS = """
bias AS (SELECT protected, CAST(count(*) AS BIGINT) n_groups, max(positive_rate) - min(positive_rate) statistical_parity,
   CASE WHEN max(positive_rate) > 0 THEN min(positive_rate) / max(positive_rate) ELSE 1.0 END disparate_impact,
   (max(positive_rate) - min(positive_rate)) * 0.8 equal_opportunity_proxy,
   (max(positive_rate) - min(positive_rate)) * 0.9 equalized_odds_proxy
 FROM rates GROUP BY protected HAVING count(*) >= 2)"""

ORACLE["group_positive_rates"] = _with(DOCS, _RATES) + """
SELECT protected, group_value, n, n_pos, round(positive_rate, 6) positive_rate FROM rates"""
ORACLE["data_bias"] = _with(DOCS, _RATES, _BIAS) + """
SELECT protected, n_groups, round(statistical_parity, 6) statistical_parity, round(disparate_impact, 6) disparate_impact,
  round(equal_opportunity_proxy, 6) equal_opportunity_proxy, round(equalized_odds_proxy, 6) equalized_odds_proxy FROM bias"""
ORACLE["data_bias_combined"] = _with(DOCS, _RATES, _BIAS) + """
SELECT round(max(statistical_parity), 6) statistical_parity, round(max(equal_opportunity_proxy), 6) equal_opportunity_proxy,
  round(max(equalized_odds_proxy), 6) equalized_odds_proxy, round(min(disparate_impact), 6) disparate_impact,
  CAST(count(*) AS BIGINT) n_protected FROM bias"""
ORACLE["dataset_summary"] = _with(DOCS) + """
SELECT CAST(count(*) AS BIGINT) n_samples, CAST(2 AS BIGINT) n_features,
  round(avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END), 6) positive_rate FROM docs"""


# ---- step 3 -----------------------------------------------------------------
_NULLS_ALL = ["l_orderkey", "l_partkey", "l_suppkey"] + _PROFILE_COLS
_STRINGS = {"l_returnflag", "p_type", "p_brand", "o_orderpriority", "c_mktsegment"}
_KEYS = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


def _kinds_sql(rule):
    parts = []
    for c in _NULLS_ALL:
        d = f"count(DISTINCT {c})"
        if rule == "profile":
            kind = (f"CASE WHEN {d} > 10 THEN 'numerical' ELSE 'categorical' END"
                    if c not in _STRINGS else "'categorical'")
        elif c in _STRINGS:
            kind = (f"CASE WHEN count({c}) = 0 THEN 'none' WHEN count(TRY_CAST({c} AS DOUBLE)) = count({c}) "
                    f"THEN (CASE WHEN {d} / count(*) < 0.1 THEN 'categorical' ELSE 'numerical' END) "
                    f"ELSE 'categorical' END")
        else:
            kind = (f"CASE WHEN count({c}) = 0 THEN 'none' WHEN {d} < 20 THEN 'categorical' "
                    f"ELSE 'numerical' END")
        parts.append(f"SELECT '{c}' AS attr, {kind} AS kind, CAST({d} AS BIGINT) AS unique_values FROM nulls")
    return _with(AUDIT, NULLS) + "\n" + "\nUNION ALL\n".join(parts)


ORACLE["infer_kinds_loader"] = _kinds_sql("loader")
ORACLE["infer_kinds_profile"] = _kinds_sql("profile")

ORACLE["bin_median"] = _with(AUDIT) + f"""
SELECT {_KEYS}, o_totalprice,
  CASE WHEN o_totalprice > (SELECT quantile_cont(o_totalprice, 0.5) FROM audit) THEN 'True' ELSE 'False' END AS bin
FROM audit"""


def _qbin(c):
    return (f"CAST((SELECT count(*) FROM (SELECT unnest(quantile_cont({c}, [0.25, 0.5, 0.75])) AS e FROM audit) q "
            f"WHERE q.e < a.{c}) AS VARCHAR)")


ORACLE["bin_quartile"] = _with(AUDIT) + f"""
SELECT {_KEYS}, l_quantity, p_retailprice, {_qbin('l_quantity')} AS bin_qty, {_qbin('p_retailprice')} AS bin_price
FROM audit a"""

ORACLE["bin_equal_width"] = _with(AUDIT, NULLS) + f"""
SELECT {_KEYS}, l_discount,
  CASE WHEN l_discount IS NULL THEN 'nan' ELSE CAST(
    (SELECT count(*) FROM range(1, 4) e(j), (SELECT min(l_discount) mn, max(l_discount) mx FROM nulls) s
     WHERE s.mn + e.j * ((s.mx - s.mn) / 4) < n.l_discount) AS VARCHAR) END AS bin
FROM nulls n"""

_DICT_PARTS = []
for _c in AUDIT_CAT:
    _num = _c == "l_linenumber"
    _order = f"{_c} IS NULL, {_c}" if _num else f"COALESCE({_c}, 'NaN')"
    _DICT_PARTS.append(
        f"SELECT '{_c}' AS attr, CAST(row_number() OVER (ORDER BY {_order}) - 1 AS INTEGER) AS code, "
        f"COALESCE(CAST({_c} AS VARCHAR), 'NaN') AS label, CAST({_c} AS VARCHAR) AS raw "
        f"FROM (SELECT DISTINCT {_c} FROM nulls)")
_DICT = "dict AS (" + " UNION ALL ".join(_DICT_PARTS) + ")"

ORACLE["encoding_dictionary"] = _with(AUDIT, NULLS, _DICT) + "\nSELECT attr, code, label FROM dict"


def _code(c, alias=None):
    return (f"(SELECT d.code FROM dict d WHERE d.attr = '{c}' AND d.raw IS NOT DISTINCT FROM CAST(n.{c} AS VARCHAR))"
            f" AS {alias or c}")


ORACLE["label_encode"] = _with(AUDIT, NULLS, _DICT) + f"""
SELECT n.l_orderkey, n.l_partkey, n.l_suppkey, n.l_linenumber, {_code('l_returnflag')}, {_code('p_type')},
  {_code('p_brand')}, {_code('l_linenumber', 'linenumber_code')}
FROM nulls n"""

ORACLE["inverse_encode"] = _with(AUDIT, NULLS) + f"""
SELECT {_KEYS}, COALESCE(l_returnflag, 'NaN') AS l_returnflag, COALESCE(p_type, 'NaN') AS p_type FROM nulls"""

ORACLE["binarize_target"] = _with(AUDIT) + f"""
SELECT {_KEYS}, o_totalprice,
  CAST(o_totalprice > (SELECT quantile_cont(o_totalprice, 0.5) FROM audit) AS INTEGER) AS label_Y
FROM audit"""

ORACLE["binarize_target_binary"] = _with(DOCS) + "\nSELECT doc_id, toxic, CAST(toxic AS INTEGER) AS label_Y FROM docs"


ORACLE["binarize_target_nulls"] = _with(AUDIT, NULLS) + f"""
, m AS (SELECT quantile_cont(l_discount, 0.5) AS med FROM nulls)
SELECT {_KEYS}, l_discount, CAST(coalesce(l_discount, med) > med AS INTEGER) AS label_Y FROM nulls, m"""

ORACLE["binarize_target_null_class"] = f"""
WITH t AS (SELECT {_KEYS}, nullif(l_linestatus, 'F') AS l_linestatus FROM lineitem),
y AS (SELECT *, coalesce(l_linestatus, 'NaN') AS c FROM t),
b AS (SELECT min(c) AS lo, max(c) AS hi FROM y)
SELECT {_KEYS}, l_linestatus, CAST(c = hi AND lo <> hi AS INTEGER) AS label_Y FROM y, b"""


# ---- step 4 -----------------------------------------------------------------
def _hb(seed, salt=""):
    key = "concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber)"
    return f"(CAST('0x' || substr(md5({key} || '{salt}:{seed}'), 1, 8) AS BIGINT) % 1000)"


ORACLE["hash_split"] = _with(SCORED) + f"\nSELECT {_KEYS}, {_hb(1)} < 700 AS is_train FROM scored"
ORACLE["hash_sample"] = _with(SCORED) + f"\nSELECT {_KEYS}, label_Y FROM scored WHERE {_hb(0, 'sample')} < 500"
ORACLE["stratified_split"] = _with(SCORED) + f"""
, h AS (SELECT {_KEYS}, label_Y,
          md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber) || 'strat:42') AS hh FROM scored),
d AS (SELECT label_Y, hh, count(*) c FROM h GROUP BY label_Y, hh),
r AS (SELECT label_Y, hh, sum(c) OVER (PARTITION BY label_Y ORDER BY hh) AS cum,
             sum(c) OVER (PARTITION BY label_Y) AS n FROM d)
SELECT h.l_orderkey, h.l_partkey, h.l_suppkey, h.l_linenumber, h.label_Y, r.cum > round(r.n * 0.3) AS is_train
FROM h JOIN r ON h.label_Y = r.label_Y AND h.hh = r.hh"""
ORACLE["subgroup_filter"] = _with(AUDIT) + f"""
SELECT {_KEYS}, c_mktsegment, l_returnflag, l_quantity FROM audit
WHERE c_mktsegment = 'BUILDING' AND l_returnflag = 'R'"""


# ---- step 5: epsilon ----------------------------------------------------------
_PG = "pg AS (" + " UNION ALL ".join(
    f"SELECT '{p}' AS protected, COALESCE(CAST({p} AS VARCHAR), 'NaN') AS g, * FROM audit" for p in AUDIT_PROT) + ")"
_PAIRS = """pairs AS (SELECT a.protected, a.g AS g1, b.g AS g2
  FROM (SELECT DISTINCT protected, g FROM pg) a JOIN (SELECT DISTINCT protected, g FROM pg) b
    ON a.protected = b.protected AND a.g < b.g)"""
_NST = "nst AS (" + " UNION ALL ".join(
    f"SELECT protected, g, '{c}' AS attr, count({c}) AS cnt, avg(CAST({c} AS DOUBLE)) AS m, "
    f"min(CAST({c} AS DOUBLE)) AS mn, max(CAST({c} AS DOUBLE)) AS mx FROM pg GROUP BY protected, g"
    for c in AUDIT_NUM) + ")"
_S_NUMA = """s_numa AS (SELECT a.protected, a.g AS g1, b.g AS g2, a.attr,
  CASE WHEN greatest(a.mx, b.mx) <> least(a.mn, b.mn) THEN abs(a.m - b.m) / (greatest(a.mx, b.mx) - least(a.mn, b.mn))
       ELSE abs(a.m - b.m) END AS s
  FROM nst a JOIN nst b ON a.protected = b.protected AND a.attr = b.attr AND a.g < b.g)"""
_VCN = "vcn AS (" + " UNION ALL ".join(
    f"SELECT protected, g, '{c}' AS attr, CAST({c} AS DOUBLE) AS v, count(*) AS cnt FROM pg "
    f"WHERE {c} IS NOT NULL GROUP BY protected, g, {c}" for c in AUDIT_NUM) + ")"
_MERGED = """merged AS (
  SELECT p.protected, p.g1, p.g2, x.attr, x.v,
         sum(CASE WHEN x.g = p.g1 THEN x.cnt ELSE 0 END) AS a, sum(CASE WHEN x.g = p.g2 THEN x.cnt ELSE 0 END) AS b
  FROM pairs p JOIN vcn x ON x.protected = p.protected AND (x.g = p.g1 OR x.g = p.g2)
  GROUP BY p.protected, p.g1, p.g2, x.attr, x.v),
cum AS (
  SELECT *, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER wp AS na, sum(b) OVER wp AS nb,
         lead(v) OVER w AS nv, min(v) OVER wp AS lo, max(v) OVER wp AS hi
  FROM merged WINDOW w AS (PARTITION BY protected, g1, g2, attr ORDER BY v),
                     wp AS (PARTITION BY protected, g1, g2, attr))"""
_S_NUMB = """s_numb AS (SELECT protected, g1, g2, attr, max(abs(ca / na - cb / nb)) AS s FROM cum
  GROUP BY protected, g1, g2, attr)"""
_S_NUMC = """s_numc AS (SELECT protected, g1, g2, attr,
  0.5 * CASE WHEN max(hi) <> max(lo)
             THEN sum(coalesce(nv - v, 0) * (ca * (nb - cb) + cb * (na - ca))) / (max(hi) - max(lo))
             ELSE sum(coalesce(nv - v, 0) * (ca * (nb - cb) + cb * (na - ca))) END AS s
  FROM cum GROUP BY protected, g1, g2, attr)"""
_CC = "cc AS (" + " UNION ALL ".join(
    f"SELECT protected, g, '{c}' AS attr, CAST({c} AS VARCHAR) AS v, count(*) AS cnt FROM pg "
    f"WHERE {c} IS NOT NULL GROUP BY protected, g, {c}" for c in AUDIT_CAT) + ")"
_CGRID = """tot AS (SELECT protected, g, attr, sum(cnt) AS t FROM cc GROUP BY protected, g, attr),
cgrid AS (
  SELECT p.protected, p.g1, p.g2, vv.attr, vv.v, coalesce(c1.cnt, 0) AS n1, coalesce(c2.cnt, 0) AS n2,
         t1.t AS t1, t2.t AS t2
  FROM pairs p JOIN (SELECT DISTINCT protected, attr, v FROM cc) vv ON vv.protected = p.protected
  LEFT JOIN cc c1 ON c1.protected = p.protected AND c1.g = p.g1 AND c1.attr = vv.attr AND c1.v = vv.v
  LEFT JOIN cc c2 ON c2.protected = p.protected AND c2.g = p.g2 AND c2.attr = vv.attr AND c2.v = vv.v
  LEFT JOIN tot t1 ON t1.protected = p.protected AND t1.g = p.g1 AND t1.attr = vv.attr
  LEFT JOIN tot t2 ON t2.protected = p.protected AND t2.g = p.g2 AND t2.attr = vv.attr
  WHERE coalesce(c1.cnt, 0) + coalesce(c2.cnt, 0) > 0)"""
_S_CATA = """s_cata AS (SELECT protected, g1, g2, attr, sum(abs(n1 / t1 - n2 / t2)) / count(*) AS s FROM cgrid
  GROUP BY protected, g1, g2, attr)"""
_S_CATB = """s_catb AS (SELECT protected, g1, g2, attr, 0.5 * sum((n1 - n2) ^ 2 / (n1 + n2)) AS s FROM cgrid
  GROUP BY protected, g1, g2, attr)"""


def _eps_ctes(num="a", cat="a"):
    ctes = [AUDIT, _PG, _PAIRS]
    if num == "a":
        ctes += [_NST, _S_NUMA]
    else:
        ctes += [_VCN, _MERGED, _S_NUMB if num == "b" else _S_NUMC]
    ctes += [_CC, _CGRID, _S_CATA if cat == "a" else _S_CATB]
    ctes.append(f"""s_all AS (SELECT protected, g1, g2, attr, 'numerical' AS kind, s FROM s_num{num}
  UNION ALL SELECT protected, g1, g2, attr, 'categorical' AS kind, s FROM s_cat{cat})""")
    return ctes


def _scaled_sql(how):
    w = "PARTITION BY protected, g1, g2, kind"
    if how == "min":
        e = f"s / min(s) OVER ({w})"
    elif how == "mean":
        e = f"s / avg(s) OVER ({w})"
    else:
        return f"""s_z AS (SELECT protected, g1, g2, attr, kind, (s - avg(s) OVER ({w})) / stddev_samp(s) OVER ({w}) AS z
  FROM s_all), s_sc AS (SELECT protected, g1, g2, attr, kind, z - min(z) OVER ({w}) AS s FROM s_z)"""
    return f"s_sc AS (SELECT protected, g1, g2, attr, kind, {e} AS s FROM s_all)"


_OUT_S = "\nSELECT protected, g1, g2, attr, kind, round(s, {r}) AS s FROM {t}"
ORACLE["diff_num_a"] = _with(*_eps_ctes("a", "a")) + _OUT_S.format(r=6, t="s_all WHERE kind = 'numerical'")
ORACLE["diff_num_b"] = _with(*_eps_ctes("b", "a")) + _OUT_S.format(r=6, t="s_all WHERE kind = 'numerical'")
ORACLE["diff_num_c"] = _with(*_eps_ctes("c", "a")) + _OUT_S.format(r=4, t="s_all WHERE kind = 'numerical'")
ORACLE["diff_cat_a"] = _with(*_eps_ctes("a", "a")) + _OUT_S.format(r=6, t="s_all WHERE kind = 'categorical'")
ORACLE["diff_cat_b"] = _with(*_eps_ctes("a", "b")) + _OUT_S.format(r=6, t="s_all WHERE kind = 'categorical'")
for _sc in ("min", "mean", "sigma"):
    ORACLE[f"diff_scaled_{_sc}"] = _with(*_eps_ctes("a", "a"), _scaled_sql(_sc)) + _OUT_S.format(r=4, t="s_sc")

_LOO = {
    "d1A": "sqrt(avg(o.s * o.s))",
    "d1B": "sqrt(sum(o.s * o.s))",
}


def _loo_cte(how):
    return f"""loo AS (SELECT a.protected, a.g1, a.g2, a.attr, {_LOO[how]} AS r
  FROM s_all a JOIN s_all o ON a.protected = o.protected AND a.g1 = o.g1 AND a.g2 = o.g2 AND a.attr <> o.attr
  GROUP BY a.protected, a.g1, a.g2, a.attr)"""


ORACLE["subset_loo_d1a"] = _with(*_eps_ctes(), _loo_cte("d1A")) + \
    "\nSELECT protected, g1, g2, attr, round(r, 6) AS r FROM loo"
ORACLE["subset_loo_d1b"] = _with(*_eps_ctes(), _loo_cte("d1B")) + \
    "\nSELECT protected, g1, g2, attr, round(r, 6) AS r FROM loo"

_U = """u AS (SELECT protected, attr, avg(r) AS u, count(*) OVER (PARTITION BY protected) AS p
  FROM loo GROUP BY protected, attr),
eps AS (SELECT protected, attr, abs(u - avg(u) OVER (PARTITION BY protected)) / p AS epsilon FROM u)"""

ORACLE["attr_distance"] = _with(*_eps_ctes(), _loo_cte("d1A"), _U) + """
SELECT a.protected, a.attr AS a1, b.attr AS a2, round(abs(a.u - b.u) / a.p, 6) AS dist
FROM u a JOIN u b ON a.protected = b.protected AND a.attr < b.attr"""
ORACLE["epsilon"] = _with(*_eps_ctes(), _loo_cte("d1A"), _U) + \
    "\nSELECT protected, attr, round(epsilon, 6) AS epsilon FROM eps"
ORACLE["epsilon_num_b_cat_b"] = _with(*_eps_ctes("b", "b"), _loo_cte("d1A"), _U) + \
    "\nSELECT protected, attr, round(epsilon, 6) AS epsilon FROM eps"
ORACLE["max_epsilon"] = _with(*_eps_ctes(), _loo_cte("d1A"), _U) + """
SELECT protected, attr, round(epsilon, 6) AS epsilon FROM eps ORDER BY epsilon DESC, protected, attr LIMIT 1"""
ORACLE["mean_epsilon"] = _with(*_eps_ctes(), _loo_cte("d1A"), _U) + """
SELECT round(sum(epsilon) / (count(*) + count(DISTINCT protected)), 6) AS mean_epsilon FROM eps"""


# ---- step 6: transforms ----------------------------------------------------------
def _poly(x, b):
    return f"sign({x}) * pow(abs({x}), {b!r})"


ORACLE["transform_poly"] = _with(AUDIT) + f"""
SELECT {_KEYS}, round({_poly('l_quantity', 1/3)}, 6) AS l_quantity, round({_poly('l_discount', 1/5)}, 6) AS l_discount
FROM audit"""
ORACLE["transform_log"] = _with(AUDIT) + f"""
SELECT {_KEYS}, round(abs(ln(abs(l_quantity) + 1e-5) / ln(3.0)) * sign(l_quantity), 6) AS l_quantity,
  round(abs(ln(abs(l_discount) + 1e-5) / ln(7.0)) * sign(l_discount), 6) AS l_discount
FROM audit"""
ORACLE["transform_arcsin"] = _with(AUDIT) + f"""
, mm AS (SELECT max(abs(l_quantity)) AS amax, min(abs(l_quantity)) AS amin FROM audit),
xs AS (SELECT a.*, 2.0 * (l_quantity - amin) / (amax - amin) - 1.0 AS xs, amax FROM audit a, mm)
SELECT {_KEYS}, round(pow(asin(abs(xs) / amax), 3.0) * sign(xs), 6) + 0.0 AS l_quantity FROM xs"""
# (+ 0.0 turns a rounded -0.0 into 0.0, as Spark's decimal rounding does)
ORACLE["transform_t2"] = _with(AUDIT) + f"""
SELECT {_KEYS}, round({_poly('l_quantity', (1/3) * (1/5) * (1/7))}, 6) AS l_quantity FROM audit"""
ORACLE["transform_t3"] = _with(AUDIT) + f"""
SELECT {_KEYS}, round({_poly('l_quantity', 1/3)} + {_poly('l_quantity', 1/5)} + {_poly('l_quantity', 1/7)}, 6)
  AS l_quantity FROM audit"""
ORACLE["transform_blend"] = _with(AUDIT) + f"""
SELECT {_KEYS}, round(0.8 * {_poly('l_quantity', 1/3)} + 0.2 * {_poly('l_quantity', 1/5)}, 6) AS l_quantity,
  round(0.8 * 1.0 + 0.2 * {_poly('l_discount', 1/3)}, 6) AS l_discount, 1 AS l_tax
FROM audit"""
ORACLE["rebin_chain"] = _with(AUDIT) + f"""
SELECT {_KEYS}, CASE l_returnflag WHEN 'R' THEN 'F' WHEN 'A' THEN 'F' ELSE l_returnflag END AS l_returnflag,
  CASE l_linenumber WHEN 3 THEN 0 WHEN 1 THEN 0 ELSE l_linenumber END AS linenumber
FROM audit"""
ORACLE["transform_validity"] = _with(AUDIT) + f"""
SELECT CAST(candidate AS INTEGER) AS candidate, attr, valid FROM (
  SELECT 0 AS candidate, 'l_quantity' AS attr,
         max(CASE WHEN isinf({_poly('l_quantity', 3.0)}) OR isnan({_poly('l_quantity', 3.0)}) THEN 1 ELSE 0 END) = 0 AS valid FROM audit
  UNION ALL SELECT 1, 'l_extendedprice',
         max(CASE WHEN isinf({_poly('l_extendedprice', 945.0)}) THEN 1 ELSE 0 END) = 0 FROM audit
  UNION ALL SELECT 2, 'l_quantity', false
  UNION ALL SELECT 3, 'l_discount',
         max(CASE WHEN isinf(0.8 * {_poly('l_discount', 15.0)} + 0.2 * {_poly('l_discount', 105.0)}) THEN 1 ELSE 0 END) = 0 FROM audit
  UNION ALL SELECT 4, 'l_returnflag',
         count(DISTINCT CASE l_returnflag WHEN 'R' THEN 'N' WHEN 'A' THEN 'N' ELSE l_returnflag END) <> 1 FROM audit
  UNION ALL SELECT 5, 'l_returnflag',
         count(DISTINCT CASE l_returnflag WHEN 'R' THEN 'A' ELSE l_returnflag END) <> 1 FROM audit
  UNION ALL SELECT 6, 'p_type',
         count(DISTINCT CASE p_type WHEN 'PROMO' THEN 'SMALL' ELSE p_type END) <> 1 FROM audit)"""

_E_EXPR = {
    "E2": ("a / b", "b IS NOT NULL"), "E3": ("a / (a + b)", "b IS NOT NULL"),
    "E4": ("CAST(abs(a - b) AS DOUBLE)", "b IS NOT NULL"), "E5": ("abs((a - b) / (a + b))", "b IS NOT NULL"),
    "E7": ("1.0 / a + 1.0 / b", "b IS NOT NULL"), "E8": ("a * b / (a + b)", "b IS NOT NULL"),
}


def _stream_sql(mode, order=0):
    by = {0: "k", 1: "v, k", -1: "v DESC, k"}[order]
    if mode in ("d4A", "d4B"):
        vals = [float(x) for x in range(3, 23, 2)]
        if mode == "d4B":
            vals = [1.0 / v for v in vals]
        first, last, n = repr(vals[0]), repr(vals[-1]), len(vals)
        head = _with(AUDIT)
        f = (lambda b: f"abs(ln(abs(l_quantity) + 1e-5) / ln({b})) * sign(l_quantity)") if mode == "d4A" \
            else (lambda b: _poly('l_quantity', b))
        return head + f"""
SELECT {_KEYS}, l_quantity, round({f(first)}, 6) AS t_first,
  round({f(last)}, 6) AS t_last, CAST({n} AS BIGINT) AS stream_len FROM audit"""
    expr, cond = _E_EXPR[mode]
    return "WITH RECURSIVE " + AUDIT.strip() + f""",
pw(k, r) AS (SELECT 1, CAST(102 % 173 AS BIGINT) UNION ALL SELECT k + 1, (r * 102) % 173 FROM pw WHERE k < 173),
res AS (SELECT k, r FROM pw WHERE k >= 2 AND r NOT IN (1, 172)),
nx AS (SELECT k, r AS a, lead(r) OVER (ORDER BY k) AS b FROM res),
st AS (SELECT row_number() OVER (ORDER BY {by}) AS j, v FROM (SELECT k, {expr} AS v FROM nx WHERE {cond})
       WHERE v > 0.5 AND v < 2.0),
ends AS (SELECT (SELECT v FROM st WHERE j = 1) AS first, (SELECT v FROM st ORDER BY j DESC LIMIT 1) AS last,
         (SELECT count(*) FROM st) AS n)
SELECT {_KEYS}, l_quantity, round(sign(l_quantity) * pow(abs(l_quantity), first), 6) AS t_first,
  round(sign(l_quantity) * pow(abs(l_quantity), last), 6) AS t_last, CAST(n AS BIGINT) AS stream_len
FROM audit, ends"""


for _mode in ("d4A", "d4B", "E2", "E3", "E4", "E5", "E7", "E8"):
    ORACLE[f"beta_stream_{_mode.lower()}"] = _stream_sql(_mode)
ORACLE["beta_stream_e2_rising"] = _stream_sql("E2", 1)
ORACLE["beta_stream_e5_falling"] = _stream_sql("E5", -1)


# ---- step 7: re-bin choices and importance ------------------------------------------
_BM = _with(AUDIT, _PG, _PAIRS, _CC, _CGRID) + """
, d AS (SELECT protected, attr, g1, g2, v,
          CASE WHEN n1 > 0 AND n2 > 0 THEN n2 / t2 - n1 / t1 ELSE 0.0 END AS d FROM cgrid),
cands AS (SELECT protected, attr, g1, g2, arg_max(v, (d, v)) AS hv, max(d) AS hd,
                 arg_min(v, (d, v)) AS lv, min(d) AS ld FROM d GROUP BY protected, attr, g1, g2)"""
ORACLE["bm_rebin_candidates"] = _BM + """
SELECT protected, attr, g1, g2, hv AS from_value, lv AS to_value, round(hd + ld, 6) AS diff FROM cands"""
ORACLE["bm_rebin_choice"] = _BM + """
SELECT protected, attr, g1, g2, from_value, to_value, diff FROM (
  SELECT protected, attr, g1, g2, hv AS from_value, lv AS to_value, round(hd + ld, 6) AS diff,
         row_number() OVER (PARTITION BY protected, attr ORDER BY abs(hd + ld) DESC, g1, g2) AS rk FROM cands)
WHERE rk = 1"""

_LABELED = """
labeled AS (SELECT *, CAST(o_totalprice > (SELECT quantile_cont(o_totalprice, 0.5) FROM audit) AS INTEGER) AS label_Y
            FROM audit)"""
_CLS = "cls AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS attr, CAST({c} AS VARCHAR) AS v, "
    f"sum(CASE WHEN label_Y = 0 THEN 1 END) AS c0, sum(CASE WHEN label_Y = 1 THEN 1 END) AS c1 "
    f"FROM labeled WHERE {c} IS NOT NULL GROUP BY {c}" for c in AUDIT_CAT) + ")"
ORACLE["ae_rebin_r1"] = _with(AUDIT, _LABELED, _CLS) + """
, d AS (SELECT attr, v, CAST(CASE WHEN c0 IS NOT NULL AND c1 IS NOT NULL THEN abs(c1 - c0) ELSE 0 END AS BIGINT) AS d FROM cls)
SELECT attr, arg_max(v, (d, v)) AS from_value, arg_min(v, (d, v)) AS to_value, max(d) + min(d) AS diff
FROM d GROUP BY attr"""
ORACLE["ae_rebin_r2"] = _with(AUDIT, "vc AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS attr, CAST({c} AS VARCHAR) AS v, count(*) AS cnt FROM audit WHERE {c} IS NOT NULL GROUP BY {c}"
    for c in AUDIT_CAT) + ")") + """
SELECT attr, max(CASE WHEN rk = 2 THEN v END) AS from_value, max(CASE WHEN rk = 1 THEN v END) AS to_value FROM (
  SELECT attr, v, row_number() OVER (PARTITION BY attr ORDER BY cnt, v) AS rk FROM vc)
GROUP BY attr HAVING count(*) >= 2"""


def _mi_sql():
    items = []
    for c in AUDIT_NUM:
        items.append(f"""SELECT '{c}' AS attr, CAST((SELECT count(*) FROM (
            SELECT DISTINCT unnest(quantile_cont({c}, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,0.0,1.0])) AS e FROM labeled) q
          WHERE q.e < l.{c} AND q.e > (SELECT min({c}) FROM labeled) AND q.e < (SELECT max({c}) FROM labeled))
          AS VARCHAR) AS x, label_Y AS y FROM labeled l""")
    for c in AUDIT_CAT:
        items.append(f"SELECT '{c}' AS attr, CAST({c} AS VARCHAR) AS x, label_Y AS y FROM labeled WHERE {c} IS NOT NULL")
    return _with(AUDIT, _LABELED, "xy AS (" + " UNION ALL ".join(items) + ")") + """
, j AS (SELECT attr, x, y, count(*) AS nxy FROM xy GROUP BY attr, x, y),
t AS (SELECT attr, nxy, sum(nxy) OVER (PARTITION BY attr) AS n, sum(nxy) OVER (PARTITION BY attr, x) AS nx,
             sum(nxy) OVER (PARTITION BY attr, y) AS ny FROM j),
mi AS (SELECT attr, sum((nxy / n) * ln(nxy * n / (nx * ny))) AS importance FROM t GROUP BY attr)"""


ORACLE["mi_importance"] = _mi_sql() + "\nSELECT attr, round(importance, 6) AS importance FROM mi"
ORACLE["pick_lowest_importance"] = _mi_sql() + """
SELECT attr, round(importance, 6) AS importance FROM mi WHERE attr <> 'l_returnflag' ORDER BY importance, attr LIMIT 1"""

ORACLE["rows_changed"] = _with(AUDIT) + """
SELECT attr, CAST(rows_changed AS BIGINT) AS rows_changed FROM (
  SELECT 'l_quantity' AS attr, sum(CASE WHEN pow(l_quantity, 1.0 / 3) = l_quantity THEN 0 ELSE 1 END) AS rows_changed FROM audit
  UNION ALL SELECT 'l_returnflag', sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) FROM audit
  UNION ALL SELECT 'l_tax', sum(CASE WHEN CAST(l_tax AS VARCHAR) = '1' THEN 0 ELSE 1 END) FROM audit)"""


# ---- step 11: streaming monitor (batch equivalent over closed windows) ------------------
_EV = """
ev AS (SELECT date_trunc('day', ts) AS ws, date_trunc('day', ts) + INTERVAL 1 DAY AS we, event_type,
              CAST(value > 5 AS INTEGER) AS label_Y, CAST(user_id % 2 AS INTEGER) AS pred_Y FROM events),
closed AS (SELECT * FROM ev WHERE we <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR),
wc AS (SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(we, '%Y-%m-%d %H:%M:%S') AS window_end,
              'event_type' AS protected, event_type AS group_value, CAST(count(*) AS BIGINT) AS n,
              CAST(sum(CASE WHEN pred_Y<>0 AND label_Y<>0 THEN 1 ELSE 0 END) AS BIGINT) tp,
              CAST(sum(CASE WHEN pred_Y<>0 AND label_Y=0 THEN 1 ELSE 0 END) AS BIGINT) fp,
              CAST(sum(CASE WHEN pred_Y=0 AND label_Y<>0 THEN 1 ELSE 0 END) AS BIGINT) fn,
              CAST(sum(CASE WHEN pred_Y=0 AND label_Y=0 THEN 1 ELSE 0 END) AS BIGINT) tn,
              CAST(sum(CASE WHEN label_Y=1 THEN 1 ELSE 0 END) AS BIGINT) n_pos,
              CAST(sum(CASE WHEN label_Y=0 THEN 1 ELSE 0 END) AS BIGINT) n_neg,
              sum(CASE WHEN label_Y=1 THEN CAST(pred_Y AS DOUBLE) END) AS sum_score_pos,
              sum(CASE WHEN label_Y=0 THEN CAST(pred_Y AS DOUBLE) END) AS sum_score_neg
       FROM closed GROUP BY ws, we, event_type)"""
ORACLE["stream_counters"] = _with(_EV) + """
SELECT window_start, window_end, protected, group_value, n, tp, fp, fn, tn, n_pos, n_neg,
       round(sum_score_pos, 6) sum_score_pos, round(sum_score_neg, 6) sum_score_neg FROM wc"""
_WCONF = f"""
conf AS (SELECT window_start, window_end, protected, group_value,
  {_sd('tp', 'tp+fn')} TPR, {_sd('fp', 'fp+tn')} FPR, {_sd('fn', 'tp+fn')} FNR, {_sd('tp', 'tp+fp')} PPV,
  {_sd('tn', 'tn+fn')} NPV, {_sd('fp', 'tp+fp')} FDR, {_sd('fn', 'fn+tn')} "FOR", {_sd('tp+tn', 'n')} ACC,
  {_sd('tp+fp', 'n')} PPOS, {_sd('COALESCE(sum_score_pos,0.0)', 'n_pos')} mean_score_pos,
  {_sd('COALESCE(sum_score_neg,0.0)', 'n_neg')} mean_score_neg FROM wc)"""
ORACLE["stream_monitor"] = _with(_EV, _WCONF) + "\n" + " UNION ALL ".join(
    f"""SELECT a.window_start, a.window_end, '{m}' AS metric, a.protected, round(avg({e}), 6) AS value
  FROM conf a JOIN conf b ON a.window_start = b.window_start AND a.protected = b.protected
   AND a.group_value < b.group_value GROUP BY a.window_start, a.window_end, a.protected"""
    for m, e in _PAIR_EXPR.items())


# ---- sources and sinks ------------------------------------------------------------
_LI_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
            "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
ORACLE["load_preview"] = f"SELECT * FROM lineitem ORDER BY {', '.join(_LI_COLS)} LIMIT 10"
ORACLE["load_by_name"] = """SELECT CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total,
  CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers FROM orders"""
for _fmt in ("csv", "json", "parquet"):
    ORACLE[f"roundtrip_{_fmt}"] = _with(DOCS) + """
SELECT CAST(doc_id AS BIGINT) doc_id, lang, source, CAST(n_chars AS BIGINT) n_chars, CAST(quality AS INTEGER) quality,
       CAST(toxic AS INTEGER) toxic FROM docs"""


# ---- intersectional groups, subgroups, calibration ------------------------------------------
_SP = ["l_linestatus", "o_orderpriority", "c_mktsegment"]
_ISETS = [s for k in (2, 3) for s in __import__("itertools").combinations(_SP, k)]


def _iconf():
    base = conf_cte()
    raw = " UNION ALL ".join(
        _counts(" || '|' || ".join(f"COALESCE(CAST({c} AS VARCHAR), 'NaN')" for c in s), "&".join(s))
        + f" GROUP BY {', '.join(s)}" for s in _ISETS)
    start = base.index("counts AS (") + len("counts AS (")
    end = base.index("),\nconf AS (")
    return base[:start] + raw + base[end:]


ORACLE["intersectional_confusion"] = _with(SCORED, _iconf()) + """
SELECT protected, group_value, n, tp, fp, fn, tn, n_pos, n_neg,
  round(sum_score_pos, 6) sum_score_pos, round(sum_score_neg, 6) sum_score_neg,
  round(TPR,6) TPR, round(FPR,6) FPR, round(FNR,6) FNR, round(TNR,6) TNR, round(PPV,6) PPV,
  round(NPV,6) NPV, round(FDR,6) FDR, round("FOR",6) "FOR", round(ACC,6) ACC, round(PPOS,6) PPOS,
  round(mean_score_pos,6) mean_score_pos, round(mean_score_neg,6) mean_score_neg FROM conf"""
ORACLE["intersectional"] = _with(SCORED, _iconf(), fairness_cte()) + \
    "\nSELECT metric, protected, round(value, 6) AS value FROM fair"


def _subgroups_sql():
    from itertools import combinations
    parts = []
    for k in range(1, len(_SP) + 1):
        for s in combinations(_SP, k):
            desc = " || ' & ' || ".join(f"'{c}=' || CAST({c} AS VARCHAR)" for c in _SP if c in s)
            parts.append(f"SELECT {desc} AS subgroup, count(*) AS support, sum(CAST(label_Y = pred_Y AS INTEGER)) "
                         f"AS correct FROM scored GROUP BY {', '.join(s)}")
    return _with(SCORED, "cube AS (" + " UNION ALL ".join(parts) + ")") + """
, overall AS (SELECT count(*) AS n_all, sum(CAST(label_Y = pred_Y AS INTEGER)) AS c_all FROM scored),
s AS (SELECT subgroup, CAST(support AS BIGINT) AS support, correct / support AS accuracy,
             c_all / n_all AS overall_accuracy, abs(correct / support - c_all / n_all) AS gap
      FROM cube, overall WHERE support >= 100)
SELECT subgroup, support, round(accuracy, 6) accuracy, round(overall_accuracy, 6) overall_accuracy,
       round(gap, 6) gap, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (ORDER BY gap DESC, subgroup) AS rank FROM s) WHERE rank <= 10"""


ORACLE["subgroups_top10"] = _subgroups_sql()
ORACLE["calibration"] = _with(SCORED, "cb AS (" + " UNION ALL ".join(
    f"SELECT '{p}' AS protected, COALESCE(CAST({p} AS VARCHAR), 'NaN') AS group_value, "
    f"least(floor(score_S * 10), 9) AS bin, count(*) AS n, avg(score_S) AS ms, avg(label_Y) AS my "
    f"FROM scored GROUP BY {p}, least(floor(score_S * 10), 9)" for p in _SP) + ")") + """
SELECT protected, group_value, round(sqrt(sum(n * (ms - my) ^ 2) / sum(n)), 6) AS calibration_rmse,
       CAST(sum(n) AS BIGINT) AS n FROM cb GROUP BY protected, group_value"""


# ---- vector distances ------------------------------------------------------------------
_VEC = """
e AS (SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos
      FROM embeddings),
c AS (SELECT label, pos, avg(x) AS m FROM e GROUP BY label, pos),
gv AS (SELECT pos, var_samp(x) AS v FROM e GROUP BY pos),
j AS (SELECT e.vec_id, e.label, e.pos, e.x, c.m, gv.v,
             e.x - avg(e.x) OVER (PARTITION BY e.vec_id) AS xc, c.m - avg(c.m) OVER (PARTITION BY e.vec_id) AS mc,
             abs(e.x) / sum(abs(e.x)) OVER (PARTITION BY e.vec_id) AS px,
             abs(c.m) / sum(abs(c.m)) OVER (PARTITION BY e.vec_id) AS pm
      FROM e JOIN c ON e.label = c.label AND e.pos = c.pos JOIN gv ON e.pos = gv.pos),
b AS (SELECT vec_id, label, CAST(sum(CASE WHEN x > 0 AND m > 0 THEN 1 ELSE 0 END) AS DOUBLE) tt,
             CAST(sum(CASE WHEN x > 0 AND NOT m > 0 THEN 1 ELSE 0 END) AS DOUBLE) tf,
             CAST(sum(CASE WHEN NOT x > 0 AND m > 0 THEN 1 ELSE 0 END) AS DOUBLE) ft,
             CAST(sum(CASE WHEN NOT x > 0 AND NOT m > 0 THEN 1 ELSE 0 END) AS DOUBLE) ff,
             CAST(count(*) AS DOUBLE) n FROM j GROUP BY vec_id, label)"""
_DIST_SQL = {
    "sqeuclidean": ("j", "sum((x - m) * (x - m))"),
    "euclidean": ("j", "sqrt(sum((x - m) * (x - m)))"),
    "cityblock": ("j", "sum(abs(x - m))"),
    "chebyshev": ("j", "max(abs(x - m))"),
    "minkowski": ("j", "sqrt(sum(abs(x - m) * abs(x - m)))"),
    "cosine": ("j", "1 - sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m)))"),
    "correlation": ("j", "1 - sum(xc * mc) / (sqrt(sum(xc * xc)) * sqrt(sum(mc * mc)))"),
    "canberra": ("j", "sum(CASE WHEN abs(x) + abs(m) > 0 THEN abs(x - m) / (abs(x) + abs(m)) ELSE 0.0 END)"),
    "braycurtis": ("j", "sum(abs(x - m)) / sum(abs(x + m))"),
    "hamming": ("j", "avg(CASE WHEN x <> m THEN 1.0 ELSE 0.0 END)"),
    "seuclidean": ("j", "sqrt(sum((x - m) * (x - m) / v))"),
    "jensenshannon": ("j", "sqrt((sum(CASE WHEN px > 0 THEN px * ln(px / ((px + pm) / 2)) ELSE 0.0 END) + "
                           "sum(CASE WHEN pm > 0 THEN pm * ln(pm / ((px + pm) / 2)) ELSE 0.0 END)) / 2)"),
    "jaccard": ("b", "sum(CASE WHEN tt + tf + ft > 0 THEN (tf + ft) / (tt + tf + ft) ELSE 0.0 END)"),
    "dice": ("b", "sum((tf + ft) / (2 * tt + tf + ft))"),
    "yule": ("b", "sum(CASE WHEN tf * ft > 0 THEN 2 * tf * ft / (tt * ff + tf * ft) ELSE 0.0 END)"),
    "matching": ("b", "sum((tf + ft) / n)"),
    "kulczynski1": ("b", "sum(tt / (tf + ft))"),
    "rogerstanimoto": ("b", "sum(2 * (tf + ft) / (tt + ff + 2 * (tf + ft)))"),
    "russellrao": ("b", "sum((n - tt) / n)"),
    "sokalmichener": ("b", "sum(2 * (tf + ft) / (tt + ff + 2 * (tf + ft)))"),
    "sokalsneath": ("b", "sum(2 * (tf + ft) / (tt + 2 * (tf + ft)))"),
}
for _dm, (_src, _expr) in _DIST_SQL.items():
    ORACLE[f"distance_{_dm}"] = _with(_VEC) + f"""
SELECT vec_id, label, '{_dm}' AS metric, round({_expr}, 6) AS dist FROM {_src} GROUP BY vec_id, label"""


# ---- Gaussian naive Bayes from aggregates --------------------------------------------
def _nb_sql():
    feats = AUDIT_NUM
    split = (f"{_hb(1)} < 700")
    mom = ", ".join(f"avg({f}) AS m_{f}, var_pop({f}) AS v_{f}" for f in feats)
    jll = lambda y: " + ".join(
        [f"ln(c{y}.prior)"] + [f"(-0.5 * ln(2 * pi() * (c{y}.v_{f} + e.eps)) - (t.{f} - c{y}.m_{f}) ^ 2 / (2 * (c{y}.v_{f} + e.eps)))"
                               for f in feats])
    return _with(AUDIT, _LABELED) + f"""
, sp AS (SELECT *, {split} AS is_train FROM labeled),
tr AS (SELECT * FROM sp WHERE is_train), t AS (SELECT * FROM sp WHERE NOT is_train),
cls AS (SELECT label_Y AS y, count(*) * 1.0 / (SELECT count(*) FROM tr) AS prior, {mom} FROM tr GROUP BY label_Y),
e AS (SELECT 1e-9 * greatest({', '.join(f'var_pop({f})' for f in feats)}) AS eps FROM tr),
j AS (SELECT t.l_orderkey, t.l_partkey, t.l_suppkey, t.l_linenumber, t.label_Y, t.o_orderpriority, t.c_mktsegment,
             {jll(0)} AS d0, {jll(1)} AS d1
      FROM t, e, (SELECT * FROM cls WHERE y = 0) c0, (SELECT * FROM cls WHERE y = 1) c1)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(label_Y AS INTEGER) AS label_Y,
       CAST(CASE WHEN d1 > d0 THEN 1 ELSE 0 END AS INTEGER) AS pred_Y, round(1.0 / (1.0 + exp(d0 - d1)), 4) AS score_S,
       o_orderpriority, c_mktsegment FROM j"""


ORACLE["score_nb_closed"] = _nb_sql()


# ---- linear and quadratic discriminants over two features: the 2 x 2 inverse by hand --------
def _disc_pair_sql(kind):
    one = lambda y: {
        "LDA": f"""(i.a * c{y}.m1 + i.b * c{y}.m2) * t.f1 + (i.b * c{y}.m1 + i.d * c{y}.m2) * t.f2
             - 0.5 * (i.a * c{y}.m1 ^ 2 + 2 * i.b * c{y}.m1 * c{y}.m2 + i.d * c{y}.m2 ^ 2) + ln(c{y}.n / nn.n)""",
        "QDA": f"""ln(c{y}.n / nn.n) - 0.5 * ln(c{y}.det) - 0.5 * (c{y}.d * (t.f1 - c{y}.m1) ^ 2
             - 2 * c{y}.b * (t.f1 - c{y}.m1) * (t.f2 - c{y}.m2) + c{y}.a * (t.f2 - c{y}.m2) ^ 2) / c{y}.det"""}[kind]
    return _with(AUDIT, _LABELED) + f"""
, sp AS (SELECT *, l_quantity AS f1, l_discount AS f2, {_hb(1)} < 700 AS is_train FROM labeled),
tr AS (SELECT * FROM sp WHERE is_train), t AS (SELECT * FROM sp WHERE NOT is_train),
nn AS (SELECT count(*) * 1.0 AS n FROM tr),
raw AS (SELECT label_Y AS y, count(*) AS n, avg(f1) AS m1, avg(f2) AS m2, var_samp(f1) AS va, covar_samp(f1, f2) AS vb,
               var_samp(f2) AS vd FROM tr GROUP BY label_Y),
cls AS (SELECT y, n, m1, m2, 0.99 * va + 0.01 AS a, 0.99 * vb AS b, 0.99 * vd + 0.01 AS d,
               (0.99 * va + 0.01) * (0.99 * vd + 0.01) - (0.99 * vb) ^ 2 AS det FROM raw),
po AS (SELECT sum((n - 1) * va) / (sum(n) - 2) AS a, sum((n - 1) * vb) / (sum(n) - 2) AS b, sum((n - 1) * vd) / (sum(n) - 2) AS d FROM raw),
i AS (SELECT d / (a * d - b * b) AS a, -b / (a * d - b * b) AS b, a / (a * d - b * b) AS d FROM po),
j AS (SELECT t.*, {one(0)} AS d0, {one(1)} AS d1
      FROM t, nn, i, (SELECT * FROM cls WHERE y = 0) c0, (SELECT * FROM cls WHERE y = 1) c1)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(label_Y AS INTEGER) AS label_Y,
       CAST(CASE WHEN d1 > d0 THEN 1 ELSE 0 END AS INTEGER) AS pred_Y, round(1.0 / (1.0 + exp(d0 - d1)), 4) AS score_S,
       o_orderpriority, c_mktsegment FROM j"""


ORACLE["score_lda_two_features"] = _disc_pair_sql("LDA")
ORACLE["score_qda_two_features"] = _disc_pair_sql("QDA")


# ---- metrics of the closed-form model, protected bins, one-hot slots -------------------------
def _nb_scored(table):
    """``scored`` for the metric CTEs: the closed-form model over the rows of ``table``."""
    head, _, _ = _nb_sql().rpartition("SELECT l_orderkey")
    head = head.replace("t AS (SELECT * FROM sp WHERE NOT is_train)", f"t AS (SELECT * FROM {table})") \
        .replace("t.label_Y, t.o_orderpriority", "t.label_Y, t.is_train, t.l_returnflag, t.o_orderpriority")
    return head.rstrip() + """
, scored AS (SELECT *, CASE WHEN d1 > d0 THEN 1 ELSE 0 END AS pred_Y, 1.0 / (1.0 + exp(d0 - d1)) AS score_S FROM j)"""


_TWO = ("o_orderpriority", "c_mktsegment")
ORACLE["evaluate_nb"] = _nb_scored("(SELECT * FROM sp WHERE NOT is_train)").replace(
    "FROM (SELECT * FROM sp WHERE NOT is_train))", "FROM sp WHERE NOT is_train)") + "," + conf_cte(_TWO) + "," + fairness_cte() + """
SELECT metric, CAST(NULL AS VARCHAR) AS protected, round(value, 6) AS value FROM (
  SELECT 'ACC' metric, ACC value FROM conf WHERE protected='__overall__' UNION ALL
  SELECT 'F1', CASE WHEN PPV+TPR > 0 THEN 2*PPV*TPR/(PPV+TPR) ELSE 0.0 END FROM conf WHERE protected='__overall__' UNION ALL
  SELECT 'Recall', TPR FROM conf WHERE protected='__overall__' UNION ALL
  SELECT 'Precision', PPV FROM conf WHERE protected='__overall__')
UNION ALL SELECT metric, protected, round(value, 6) AS value FROM fair"""

_SUB = "c_mktsegment = 'BUILDING' AND l_returnflag = 'R'"
ORACLE["subgroup_report_nb"] = _nb_scored("sp") + f""",
g AS (SELECT 'subgroup_all' AS scope, * FROM scored WHERE {_SUB} UNION ALL
      SELECT 'subgroup_test', * FROM scored WHERE {_SUB} AND NOT is_train UNION ALL
      SELECT 'overall_test', * FROM scored WHERE NOT is_train),
n AS (SELECT scope, count(*) AS size, sum((pred_Y = 1 AND label_Y = 1)::INT) tp, sum((pred_Y = 1 AND label_Y <> 1)::INT) fp,
             sum((pred_Y <> 1 AND label_Y = 1)::INT) fn, sum((pred_Y <> 1 AND label_Y <> 1)::INT) tn FROM g GROUP BY scope),
r AS (SELECT *, {_sd('tp', 'tp+fp')} AS pr, {_sd('tp', 'tp+fn')} AS re FROM n)
SELECT scope, CAST(size AS BIGINT) AS size, round({_sd('tp+tn', 'tp+fp+fn+tn')}, 6) AS accuracy, round(pr, 6) AS "precision",
       round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0 END, 6) AS f1,
       round({_sd('fp', 'fp+tn')}, 6) AS fpr, (SELECT count(*) FROM scored) AS overall_size,
       round(size * 100.0 / (SELECT count(*) FROM scored), 6) AS percentage FROM r"""

ORACLE["bin_protected"] = _with(AUDIT) + f"""
SELECT {_KEYS}, {_qbin('l_quantity')} AS l_quantity, {_qbin('p_retailprice')} AS p_retailprice, o_orderpriority FROM audit a"""

ORACLE["one_hot"] = _with(AUDIT, "lv AS (" + " UNION ALL ".join(
    f"SELECT DISTINCT {i} AS a, CAST({c} AS VARCHAR) AS v FROM audit" for i, c in enumerate(AUDIT_CAT)) + ")",
    "sz AS (SELECT a, count(*) AS k FROM lv GROUP BY a)",
    """sl AS (SELECT lv.a, lv.v, k, row_number() OVER (PARTITION BY lv.a ORDER BY lv.v DESC) - 1 AS r,
         coalesce((SELECT sum(o.k - 1) FROM sz o WHERE o.a < lv.a), 0) AS off FROM lv JOIN sz USING (a))""",
    "hot AS (SELECT a, v, CASE WHEN r < k - 1 THEN CAST(off + r AS INTEGER) END AS slot FROM sl)") + f"""
SELECT {_KEYS}, list_filter([{', '.join(f's{i}.slot' for i in range(len(AUDIT_CAT)))}], lambda x: x IS NOT NULL) AS slots,
       CAST((SELECT sum(k - 1) FROM sz) AS BIGINT) AS width
FROM audit """ + " ".join(f"JOIN hot s{i} ON s{i}.a = {i} AND s{i}.v = CAST(audit.{c} AS VARCHAR)" for i, c in enumerate(AUDIT_CAT))


# ---- history views over a history derived from the scored rows ----------------------------
_HIST = """
ra AS (SELECT l_linenumber AS iteration, c_mktsegment, avg(pred_Y) AS value FROM scored GROUP BY l_linenumber, c_mktsegment),
mh AS (SELECT l_linenumber AS iteration, 'ACC' AS metric, CAST(NULL AS VARCHAR) AS protected,
              avg((label_Y = pred_Y)::INT) AS value FROM scored GROUP BY l_linenumber
       UNION ALL SELECT iteration, 'PPOS', c_mktsegment, value FROM ra
       UNION ALL SELECT iteration, 'max_epsilon', NULL, max(value) FROM ra GROUP BY iteration)"""
ORACLE["metric_series"] = _with(SCORED, _HIST) + """
SELECT iteration, metric, round(avg(value), 6) AS value FROM mh GROUP BY iteration, metric"""
ORACLE["before_after"] = _with(SCORED, _HIST) + """
SELECT metric, protected, iteration, round(value, 6) AS value,
       round(first_value(value) OVER w, 6) AS initial, round(value - lag(value) OVER w, 6) AS delta_previous,
       round(value - first_value(value) OVER w, 6) AS delta_initial
FROM mh WINDOW w AS (PARTITION BY metric, protected ORDER BY iteration)"""
ORACLE["run_status"] = _with(SCORED, _HIST) + """
SELECT max(iteration) AS total_iterations, 'epsilon_threshold' AS termination_reason,
       round(least(100.0, max(iteration) * 100.0 / 10), 6) AS progress_percent,
       list(round(value, 6) ORDER BY iteration) FILTER (metric = 'max_epsilon') AS max_epsilon_series,
       list(round(value, 6) ORDER BY iteration) FILTER (metric = 'ACC') AS accuracy_series FROM mh"""


# ---- epsilon of general order h (h = p - 2 on the audit features) ------------------------
def _order_h_sql(h=7):
    from math import comb
    attrs = AUDIT_NUM + AUDIT_CAT
    p = len(attrs)
    n_sub = sum(comb(p - 1, k) for k in range(max(h - 1, 0), p))
    vals = ", ".join(f"('{a}', {i})" for i, a in enumerate(attrs))
    return _with(*_eps_ctes(), f"idx AS (SELECT * FROM (VALUES {vals}) t(attr, bit))",
                 f"masks AS (SELECT range AS mask FROM range({1 << p}) WHERE bit_count(range) >= {h})",
                 """rr AS (SELECT s.protected, s.g1, s.g2, m.mask, sqrt(avg(s.s * s.s)) AS r
          FROM s_all s JOIN idx USING (attr) JOIN masks m ON (m.mask >> idx.bit) & 1 = 1
          GROUP BY s.protected, s.g1, s.g2, m.mask)""",
                 "u AS (SELECT protected, mask, avg(r) AS U FROM rr GROUP BY protected, mask)",
                 "ab AS (SELECT i1.attr AS a, i1.bit AS ia, i2.attr AS b, i2.bit AS ib FROM idx i1 JOIN idx i2 ON i1.bit < i2.bit)",
                 f"""d AS (SELECT u1.protected, ab.a, ab.b, sum(abs(u1.U - u2.U)) / {n_sub} AS dist
          FROM u u1 JOIN ab ON (u1.mask >> ab.ia) & 1 = 1 AND (u1.mask >> ab.ib) & 1 = 0
          JOIN u u2 ON u2.protected = u1.protected AND u2.mask = u1.mask - (1 << ab.ia) + (1 << ab.ib)
          GROUP BY u1.protected, ab.a, ab.b)""",
                 "dd AS (SELECT protected, a, dist FROM d UNION ALL SELECT protected, b AS a, dist FROM d)",
                 f"""g AS (SELECT protected, a, sum(dist * dist) AS ra,
                 sum(sum(dist * dist)) OVER (PARTITION BY protected) AS t FROM dd GROUP BY protected, a)""") + f"""
SELECT protected, a AS attr, round(sqrt(greatest(ra / {p} - t / (2 * {p} * {p}), 0.0)), 6) AS epsilon FROM g"""


ORACLE["epsilon_order_h"] = _order_h_sql()



# ---- epsilon on other fixtures: docs (20 groups, p = 2) and nulls -----------------------------
def _eps_sql_for(table_cte, table, num, cat, prot, num_kind="a", cat_kind="a"):
    pg = "pg AS (" + " UNION ALL ".join(
        f"SELECT '{p}' AS protected, COALESCE(CAST({p} AS VARCHAR), 'NaN') AS g, * FROM {table}" for p in prot) + ")"
    nst = "nst AS (" + " UNION ALL ".join(
        f"SELECT protected, g, '{c}' AS attr, count({c}) AS cnt, avg(CAST({c} AS DOUBLE)) AS m, "
        f"min(CAST({c} AS DOUBLE)) AS mn, max(CAST({c} AS DOUBLE)) AS mx FROM pg GROUP BY protected, g" for c in num) + ")"
    cc = "cc AS (" + " UNION ALL ".join(
        f"SELECT protected, g, '{c}' AS attr, CAST({c} AS VARCHAR) AS v, count(*) AS cnt FROM pg "
        f"WHERE {c} IS NOT NULL GROUP BY protected, g, {c}" for c in cat) + ")"
    if num_kind == "a":
        numeric = [nst, _S_NUMA]
    else:
        vcn = "vcn AS (" + " UNION ALL ".join(
            f"SELECT protected, g, '{c}' AS attr, CAST({c} AS DOUBLE) AS v, count(*) AS cnt FROM pg "
            f"WHERE {c} IS NOT NULL GROUP BY protected, g, {c}" for c in num) + ")"
        numeric = [vcn, _MERGED, _S_NUMB]
    ctes = [table_cte, pg, _PAIRS, *numeric, cc, _CGRID, _S_CATA,
            f"""s_all AS (SELECT protected, g1, g2, attr, 'numerical' AS kind, s FROM s_num{num_kind}
  UNION ALL SELECT protected, g1, g2, attr, 'categorical' AS kind, s FROM s_cata)"""]
    loo = """loo AS (SELECT a.protected, a.g1, a.g2, a.attr, sqrt(avg(o.s * o.s)) AS r
  FROM s_all a JOIN s_all o ON a.protected = o.protected AND a.g1 = o.g1 AND a.g2 = o.g2 AND a.attr <> o.attr
  GROUP BY a.protected, a.g1, a.g2, a.attr)"""
    return _with(*ctes, loo, _U) + "\nSELECT protected, attr, round(epsilon, 6) AS epsilon FROM eps"


ORACLE["epsilon_docs"] = _eps_sql_for(DOCS, "docs", ["n_chars"], ["quality"], ["lang", "source"])
ORACLE["epsilon_nulls"] = _eps_sql_for(AUDIT + "," + NULLS, "nulls", AUDIT_NUM, AUDIT_CAT, AUDIT_PROT)

ORACLE["epsilon_docs_ks"] = _eps_sql_for(DOCS, "docs", ["n_chars"], ["quality"], ["lang", "source"], num_kind="b")


_EV_SLIDE = """
ev AS (SELECT date_trunc('day', ts) - INTERVAL (o) DAY AS ws, event_type,
              CAST(value > 5 AS INTEGER) AS label_Y, CAST(user_id % 2 AS INTEGER) AS pred_Y
       FROM events, (VALUES (0), (1)) t(o)),
closed AS (SELECT * FROM ev WHERE ws + INTERVAL 2 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR)"""
ORACLE["stream_counters_sliding"] = _with(_EV_SLIDE, """
wc AS (SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start,
              strftime(ws + INTERVAL 2 DAY, '%Y-%m-%d %H:%M:%S') AS window_end,
              'event_type' AS protected, event_type AS group_value, CAST(count(*) AS BIGINT) AS n,
              CAST(sum(CASE WHEN pred_Y<>0 AND label_Y<>0 THEN 1 ELSE 0 END) AS BIGINT) tp,
              CAST(sum(CASE WHEN pred_Y<>0 AND label_Y=0 THEN 1 ELSE 0 END) AS BIGINT) fp,
              CAST(sum(CASE WHEN pred_Y=0 AND label_Y<>0 THEN 1 ELSE 0 END) AS BIGINT) fn,
              CAST(sum(CASE WHEN pred_Y=0 AND label_Y=0 THEN 1 ELSE 0 END) AS BIGINT) tn,
              CAST(sum(CASE WHEN label_Y=1 THEN 1 ELSE 0 END) AS BIGINT) n_pos,
              CAST(sum(CASE WHEN label_Y=0 THEN 1 ELSE 0 END) AS BIGINT) n_neg,
              sum(CASE WHEN label_Y=1 THEN CAST(pred_Y AS DOUBLE) END) AS sum_score_pos,
              sum(CASE WHEN label_Y=0 THEN CAST(pred_Y AS DOUBLE) END) AS sum_score_neg
       FROM closed GROUP BY ws, event_type)""") + """
SELECT window_start, window_end, protected, group_value, n, tp, fp, fn, tn, n_pos, n_neg,
       round(sum_score_pos, 6) sum_score_pos, round(sum_score_neg, 6) sum_score_neg FROM wc"""


# ---- five nearest neighbours: every test row against every train row ------------------------
ORACLE["score_knn"] = f"""
WITH {DOCS},
s AS (SELECT *, CAST('0x' || substr(md5(doc_id || ':1'), 1, 8) AS BIGINT) % 1000 < 700 AS tr FROM docs),
d AS (SELECT a.doc_id, b.toxic, row_number() OVER (PARTITION BY a.doc_id ORDER BY
             (a.n_chars - b.n_chars) * (a.n_chars - b.n_chars) + (a.quality - b.quality) * (a.quality - b.quality), b.doc_id) AS k
      FROM s a JOIN s b ON NOT a.tr AND b.tr)
SELECT doc_id, CAST(avg(toxic) > 0.5 AS INTEGER) AS pred_Y, round(avg(toxic), 6) AS score_S FROM d WHERE k <= 5 GROUP BY doc_id
"""

# ---- num-d on the labelled documents: dense matrix of all row pairs -------------------------
def _num_d_docs_sql(dist, scaled):
    prot, cat = ("lang", "source"), ("quality", "toxic")
    pg = "pg AS (" + " UNION ALL ".join(f"SELECT '{p}' AS protected, {p} AS g, n_chars, quality, toxic FROM docs" for p in prot) + ")"
    cc = "cc AS (" + " UNION ALL ".join(f"SELECT protected, g, '{c}' AS attr, {c} AS v, count(*) AS n FROM pg GROUP BY protected, g, {c}"
                                        for c in cat) + ")"
    return _with(
        DOCS, pg, cc,
        "tot AS (SELECT protected, g, attr, sum(n) AS t FROM cc GROUP BY ALL)",
        """pv AS (SELECT a.protected, a.g AS g1, b.g AS g2, a.attr, v.v,
             coalesce((SELECT n FROM cc WHERE (protected, g, attr, v) = (a.protected, a.g, a.attr, v.v)), 0) AS n1,
             coalesce((SELECT n FROM cc WHERE (protected, g, attr, v) = (b.protected, b.g, a.attr, v.v)), 0) AS n2, a.t AS t1, b.t AS t2
           FROM tot a JOIN tot b ON a.protected = b.protected AND a.attr = b.attr AND a.g < b.g
           JOIN (SELECT DISTINCT attr, v FROM cc) v ON v.attr = a.attr)""",
        """s AS (SELECT protected, g1, g2, attr, avg(abs(n1 / t1 - n2 / t2)) AS s FROM pv WHERE n1 > 0 OR n2 > 0 GROUP BY ALL)""",
        f"""dm AS (SELECT a.doc_id AS i, b.doc_id AS j, a.lang = b.lang AS same_lang, a.source = b.source AS same_source,
             {dist} AS d FROM docs a CROSS JOIN docs b)""",
        "st AS (SELECT avg(d) AS mu, stddev_pop(d) AS sd, count(*) AS nn FROM dm)",
        "term AS (" + " UNION ALL ".join(
            f"SELECT '{p}' AS protected, sum(({scaled}) * (CASE WHEN same_{p} THEN 1 ELSE -1 END)) / any_value(nn) AS x FROM dm, st WHERE i < j"
            for p in prot) + ")",
        """r AS (SELECT protected, g1, g2, 'n_chars' AS attr, sqrt(avg(s * s)) AS r FROM s GROUP BY ALL
           UNION ALL SELECT s.protected, g1, g2, CASE attr WHEN 'quality' THEN 'toxic' ELSE 'quality' END, abs(s) + x
                     FROM s JOIN term USING (protected))""",
        "u AS (SELECT protected, attr, avg(r) AS u FROM r GROUP BY ALL)") + """
SELECT protected, attr, round(abs(u - avg(u) OVER (PARTITION BY protected)) / 3, 6) AS epsilon FROM u"""


ORACLE["epsilon_num_d_docs"] = _num_d_docs_sql("(a.n_chars - b.n_chars) ^ 2", "(d - mu) / sd")
ORACLE["epsilon_num_d_cityblock"] = _num_d_docs_sql("abs(a.n_chars - b.n_chars)", "d / mu")


# ---- logistic regression: Newton steps written out, levels eliminated by their own diagonal --
def _newton_sql(start, step, steps=9):
    ctes = [f"s0 AS MATERIALIZED ({start})"]
    for k in range(steps):
        ctes += [f"{name}{k if name != 's' else k + 1} AS MATERIALIZED ({sql.format(k=k)})" for name, sql in step]
    return ",\n".join(ctes), f"s{steps}"


def _lr_coefficients_sql():
    newton, last = _newton_sql(
        "SELECT f, f > min(f) OVER () AS free, 0.0::DOUBLE AS w, 0.0::DOUBLE AS b, 0.0::DOUBLE AS m FROM (SELECT DISTINCT f FROM tr)",
        [("g", """SELECT f, free, w, b, m, sum(p - y) + w AS g, sum((p - y) * x) AS gx, sum(p * (1 - p)) AS c,
                  sum(p * (1 - p) * x) AS cx, sum(p * (1 - p) * x * x) AS cxx
                  FROM (SELECT tr.*, s{k}.* EXCLUDE (f), 1 / (1 + exp(-(b + w + m * x))) AS p FROM tr JOIN s{k} USING (f))
                  GROUP BY f, free, w, b, m"""),
         ("t", """SELECT sum(c) - sum(c * c / (c + 1)) FILTER (free) AS a, sum(cx) - sum(c * cx / (c + 1)) FILTER (free) AS h,
                  sum(cxx) + 1 - sum(cx * cx / (c + 1)) FILTER (free) AS d, sum(g - w) - sum(c * g / (c + 1)) FILTER (free) AS rb,
                  sum(gx) + any_value(m) - sum(cx * g / (c + 1)) FILTER (free) AS rm FROM g{k}"""),
         ("s", """SELECT f, free, CASE WHEN free THEN w - (g + c * db + cx * dm) / (c + 1) ELSE 0 END AS w, b + db AS b, m + dm AS m
                  FROM g{k}, (SELECT -(d * rb - h * rm) / (a * d - h * h) AS db, -(a * rm - h * rb) / (a * d - h * h) AS dm FROM t{k})""")])
    return _with(AUDIT, _LABELED) + f"""
, tr AS MATERIALIZED (SELECT l_returnflag AS f, l_extendedprice / 1000 AS x, label_Y AS y FROM labeled WHERE {_hb(1)} < 700),
{newton}
SELECT 'l_returnflag' AS term, f AS level, round(w, 6) AS coefficient FROM {last} WHERE free
UNION ALL SELECT 'price', NULL, round(any_value(m), 6) FROM {last} UNION ALL SELECT '', NULL, round(any_value(b), 6) FROM {last}"""


ORACLE["lr_coefficients"] = _lr_coefficients_sql()


def _ae_rebin_r3_sql():
    newton, last = _newton_sql(
        """SELECT i, j, f, n, pos, f > min(f) OVER (PARTITION BY i, j) AS free, 0.0::DOUBLE AS w, 0.0::DOUBLE AS b FROM (
             SELECT i, j, CASE WHEN v = i THEN j ELSE v END AS f, sum(n) AS n, sum(pos) AS pos FROM pairs, cnt WHERE tr GROUP BY ALL)""",
        [("g", """SELECT *, n / (1 + exp(-(b + w))) - pos + w AS g, n / (1 + exp(-(b + w))) * (1 - 1 / (1 + exp(-(b + w)))) AS c FROM s{k}"""),
         ("s", """SELECT i, j, f, n, pos, free, CASE WHEN free THEN w - (g + c * db) / (c + 1) ELSE 0 END AS w, b + db AS b
                  FROM g{k} JOIN (SELECT i, j, -(sum(g - w) - sum(c * g / (c + 1)) FILTER (free))
                                         / (sum(c) - sum(c * c / (c + 1)) FILTER (free)) AS db FROM g{k} GROUP BY i, j) USING (i, j)""")])
    return _with(AUDIT, _LABELED) + f"""
, cnt AS MATERIALIZED (SELECT CAST(l_linenumber AS VARCHAR) AS v, {_hb(1)} < 700 AS tr, count(*) AS n, sum(label_Y) AS pos
                       FROM labeled GROUP BY ALL),
vals AS (SELECT DISTINCT v FROM cnt),
pairs AS MATERIALIZED (SELECT a.v AS i, b.v AS j FROM vals a JOIN vals b ON a.v < b.v),
{newton}
SELECT i AS from_value, j AS to_value,
       round(sum(CASE WHEN s.b + s.w > 0 THEN cnt.pos ELSE cnt.n - cnt.pos END) / sum(cnt.n), 6) AS accuracy
FROM {last} s JOIN cnt ON NOT cnt.tr AND s.f = CASE WHEN cnt.v = i THEN j ELSE cnt.v END GROUP BY i, j"""


ORACLE["ae_rebin_r3"] = _ae_rebin_r3_sql()
