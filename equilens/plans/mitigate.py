"""One bias-mitigation step: pick the feature with the largest epsilon and rewrite it.

The driver holds only the change set (a small dict) and a few scalars.
Every attempt is evaluated by Spark:

* numeric attribute: all remaining beta indexes are materialised as
  pseudo-columns ``attr#k`` of the base table, so their difference rows S
  and their validity come from one aggregate pass each;
* categorical attribute: the attribute's contingency table
  (protected group x value) is aggregated once and cached; every re-bin
  attempt regroups that small table, with no pass over the data;
* epsilon of a candidate reuses the cached S rows of all other attributes,
  only the changed attribute's rows are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equilens.functions.transforms import numeric_change, rebin
from equilens.operators import epsilon as E
from equilens.operators.rebin import bm_candidates_from_counts, bm_rebin_choice
from equilens.operators.transform import apply_changes, arcsin_stats, validity
from equilens.spec import AuditSpec, EpsilonConfig


@dataclass
class StepResult:
    changes: dict
    protected: str | None
    attr: str | None
    attempts: int = 0
    success: bool = False
    epsilon_before: float | None = None
    epsilon_after: float | None = None
    log: list = field(default_factory=list)


def _dropped(changes):
    return [a for a, c in changes.items() if c == "dropped"]


def _cat_s_from_counts(wide: DataFrame, slots: dict, cfg: EpsilonConfig) -> DataFrame:
    d = E.diff_cat(wide, slots)
    return d.select(*E.PAIR, "attr", F.col("s_a" if cfg.cat == "cat-a" else "s_b").alias("s"),
                    F.lit("categorical").alias("kind"))


def _epsilon_with(s_base: DataFrame, protected: str, attr: str, s_attr: DataFrame, cfg: EpsilonConfig,
                  cands=None) -> DataFrame:
    """Epsilon of ``attr`` after replacing its S rows (for one protected attribute).
    ``cands``: candidate ids (driver list, at most the stream length) evaluated together."""
    by = ["cand"] if cands is not None else []
    rest = s_base.where((F.col("protected") == protected) & (F.col("attr") != attr))
    if cands is not None:
        # one copy of the other attributes' S rows per candidate
        rest = rest.withColumn("cand", F.explode(F.array(*[F.lit(int(c)) for c in cands])))
    s = E.scale_s(rest.unionByName(s_attr.select(*rest.columns)), cfg.scale) if cfg.scale in ("min", "mean", "sigma") \
        else rest.unionByName(s_attr.select(*rest.columns))
    eps = E.epsilon_from_s(s, cfg.sum, by)
    return eps.where(F.col("attr") == attr)


def mitigation_step(base: DataFrame, spec: AuditSpec, changes: dict, stream: list,
                    cfg: EpsilonConfig = EpsilonConfig(), method: str = "poly", multi: str = "t1",
                    s_base: DataFrame | None = None) -> StepResult:
    """Run one mitigation step against the *base* table with the current change set."""
    cur = apply_changes(base, spec, changes, stream, method, multi)
    own = s_base is None
    if own:
        s_base = raw_differences(cur, spec, cfg)
    eps = E.epsilon_from_s(E.scale_s(s_base, cfg.scale), cfg.sum)
    pick = E.max_epsilon(eps, exclude=_dropped(changes)).first()
    res = StepResult(dict(changes), None, None)
    if pick is not None and pick["epsilon"] and pick["epsilon"] > 0:
        prot, attr, e0 = pick["protected"], pick["attr"], float(pick["epsilon"])
        res = StepResult(dict(changes), prot, attr, epsilon_before=e0)
        if attr in spec.categorical:
            _categorical_attempts(base, cur, spec, changes, stream, cfg, s_base, prot, attr, e0, res)
        else:
            _numeric_attempts(base, spec, changes, stream, cfg, s_base, prot, attr, e0, res, method, multi)
    if own:
        s_base.unpersist()
    return res


def raw_differences(df: DataFrame, spec: AuditSpec, cfg: EpsilonConfig) -> DataFrame:
    """The unscaled difference table, persisted (one row for each pair and feature); the caller frees it."""
    return E.difference_table(df, spec, EpsilonConfig(cfg.num, cfg.cat, "none", cfg.sum)).persist()


def _categorical_attempts(base, cur, spec, changes, stream, cfg, s_base, prot, attr, e0, res):
    """Merge values until epsilon falls.  The counters of the base values are taken once; every
    attempt applies the whole map to them, as ``apply_changes`` does to the rows."""
    slots = {prot: E.group_slots(E.groups(cur, [prot]))[prot]}
    wide0 = E.wide_counts(base.select(prot, attr), slots, [attr], False).persist()
    mapping = {str(k): str(v) for k, v in changes[attr].items()} if isinstance(changes.get(attr), dict) else {}
    for k in range(len(stream)):
        now = E.merge_values(wide0, slots, rebin(F.col("v"), mapping))
        choice = bm_rebin_choice(bm_candidates_from_counts(now, slots)).first()
        res.attempts = k + 1
        if choice is None or choice["from_value"] == choice["to_value"]:
            break
        mapping = {**mapping, choice["from_value"]: choice["to_value"]}
        after = E.merge_values(wide0, slots, rebin(F.col("v"), mapping))
        e1 = _epsilon_with(s_base, prot, attr, _cat_s_from_counts(after, slots, cfg), cfg).first()
        e1 = float(e1["epsilon"]) if e1 and e1["epsilon"] is not None else None
        res.log.append({"attempt": k + 1, "change": dict(mapping), "epsilon": e1})
        if e1 is not None and e1 < e0:
            res.changes[attr] = mapping
            res.success, res.epsilon_after = True, e1
            break
    if not res.success:
        res.changes[attr] = "dropped"
    wide0.unpersist()


def next_index(prev, side: str) -> int:
    """Next stream index of one side: after the side's last one; 1 where only the other side was changed; else 0."""
    if not isinstance(prev, dict):
        return 0
    return prev.get(side, 0) + 1


def _numeric_attempts(base, spec, changes, stream, cfg, s_base, prot, attr, e0, res, method, multi):
    prev = changes.get(attr)
    # an attribute first changed on the other side counts as having used the first index here
    start = next_index(prev, "beta_O")
    tries = []
    for k in range(len(stream)):
        ch = dict(prev) if isinstance(prev, dict) else {}
        ch["beta_O"] = start + k
        tries.append(ch)
    valid_idx = [i for i, ch in enumerate(tries) if ch["beta_O"] < len(stream)]
    ok = {r["candidate"]: r["valid"] for r in
          validity(base, spec, [(attr, tries[i]) for i in valid_idx], stream, method, multi).collect()}
    stats = arcsin_stats(base, [attr])[attr] if method == "arcsin" else None
    cand_cols = {i: numeric_change(F.col(attr).cast("double"), tries[i], stream, method, multi, stats=stats)
                 for n, i in enumerate(valid_idx) if ok.get(n)}
    eps_by = {}
    if cand_cols:
        wide = base.select(prot, *[c.alias(f"{attr}#{i}") for i, c in cand_cols.items()])
        cspec = AuditSpec(spec.target, (prot,), tuple(f"{attr}#{i}" for i in cand_cols), ())
        s_c = E.difference_table(wide, cspec, EpsilonConfig(cfg.num, cfg.cat, "none", cfg.sum))
        s_c = s_c.select(F.split(F.col("attr"), "#")[1].cast("int").alias("cand"), *E.PAIR,
                         F.lit(attr).alias("attr"), "kind", "s")
        for r in _epsilon_with(s_base, prot, attr, s_c, cfg, cands=list(cand_cols)).collect():
            eps_by[r["cand"]] = r["epsilon"]
    for n, i in enumerate(valid_idx + [i for i in range(len(tries)) if i not in valid_idx]):
        res.attempts += 1
        if not ok.get(valid_idx.index(i)) if i in valid_idx else True:
            res.log.append({"attempt": res.attempts, "change": tries[i], "valid": False})
            break
        e1 = eps_by.get(i)
        res.log.append({"attempt": res.attempts, "change": tries[i], "epsilon": e1})
        if e1 is not None and e1 < e0:
            res.changes[attr] = tries[i]
            res.success, res.epsilon_after = True, float(e1)
            break
    if not res.success:
        res.changes[attr] = "dropped"
