"""Audit specification and the fixed parameter values of the method."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values that must equal the original method for identical results.
# Metric names and their order, accuracy metric names, default parameters.
# ---------------------------------------------------------------------------
FAIRNESS_METRICS = ["BNC", "BPC", "CUAE", "EOpp", "EO", "FDRP", "FORP", "FNRB",
                    "FPRB", "NPVP", "OAE", "PPVP", "SP"]
ACCURACY_METRICS = ["ACC", "F1", "Recall", "Precision"]
RATE_NAMES = ["TPR", "FPR", "FNR", "TNR", "PPV", "NPV", "FDR", "FOR", "ACC", "PPOS"]
LOADER_CATEGORICAL_MAX_DISTINCT = 20      # numeric with fewer distinct -> categorical
LOADER_OBJECT_DISTINCT_RATIO = 0.1        # numeric-like strings below ratio -> categorical
PROFILE_CATEGORICAL_MAX_DISTINCT = 10     # profile rule: numeric with <= distinct
ALPHA_O = 0.8                             # weight of the protected-side transform
EPSILON_THRESHOLD_FACTOR = 0.9
ACCURACY_THRESHOLD_GAIN = 0.01
DEFAULT_MAX_ITERATIONS = 2
TOP_VALUE_COUNTS = 10


@dataclass(frozen=True)
class AuditSpec:
    """Roles of the columns of one DataFrame.

    Features are never split off into separate frames: every operator
    receives the whole DataFrame plus this spec and selects what it needs.
    """

    target: str
    protected: tuple[str, ...]
    numerical: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    key: tuple[str, ...] = ()
    extra: dict = field(default_factory=dict, hash=False, compare=False)

    @property
    def features(self) -> tuple[str, ...]:
        return tuple(self.numerical) + tuple(self.categorical)

    def with_kinds(self, numerical, categorical) -> "AuditSpec":
        return AuditSpec(self.target, self.protected, tuple(numerical), tuple(categorical),
                         self.key, self.extra)


@dataclass(frozen=True)
class EpsilonConfig:
    """Options of the bias-concentration measure (defaults of the method)."""

    num: str = "num-a"        # num-a | num-b | num-c
    cat: str = "cat-a"        # cat-a | cat-b
    scale: str = "zscore"     # min | mean | sigma | anything else: none
    sum: str = "d1A"          # d1A (root mean square) | d1B (root sum of squares)
