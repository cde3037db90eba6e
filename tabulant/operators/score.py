"""Row scoring: ratios, threshold flags, tier labels, screening filters, what-if scenarios."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import to_number
from ..functions.numeric import safe_divide
from ..functions.predicates import contains_text, known, matches, ordinal_position
from .agg import share_of_total

# The labels the source questions use for flags and scenarios.
HIGH_RISK = "High Risk"
MODERATE = "Moderate"
SCENARIO_LABELS = ("baseline", "mitigated")


def safe_ratio(df: DataFrame, num: str, den: str, keep: list[str], name: str = "ratio",
               scale: int | None = 4) -> DataFrame:
    """``num / den`` per row; NULL where the denominator is 0 or NULL."""
    r = safe_divide(F.col(num).cast("double"), F.col(den).cast("double"))
    r = F.round(r, scale) if scale is not None else r
    return df.select(*keep, r.alias(name))


def flag_any(df: DataFrame, conditions: list[Column], keep: list[str], name: str = "health_flag",
             hit: str = HIGH_RISK, miss: str = MODERATE) -> DataFrame:
    """Label a row ``hit`` when any condition holds; unknown (NULL) tests count as false."""
    any_hit = None
    for c in conditions:
        any_hit = known(c) if any_hit is None else any_hit | known(c)
    return df.select(*keep, F.when(any_hit, F.lit(hit)).otherwise(F.lit(miss)).alias(name))


def classify(rules: list[tuple[Column, str]], default: str) -> Column:
    """First matching rule's label (searched CASE); unknown tests do not match."""
    expr = None
    for cond, label in rules:
        expr = F.when(known(cond), F.lit(label)) if expr is None else expr.when(known(cond), F.lit(label))
    return expr.otherwise(F.lit(default))


def priority_class(df: DataFrame, rules: list[tuple[Column, str]], default: str,
                   name: str = "priority") -> DataFrame:
    """Add a class label from ordered rules over (possibly aggregated) columns."""
    return df.withColumn(name, classify(rules, default))


def multi_threshold_filter(df: DataFrame, conditions: list[Column], text_col: str,
                           excluded: list[str] | None = None, case_sensitive: bool = False,
                           exclude_regex: str | None = None) -> DataFrame:
    """Rows meeting every threshold whose text contains none of the excluded words.

    ``excluded`` is the ``NOT LIKE '%w%'`` list; ``exclude_regex`` is the
    ``$not: {$regex}`` form (one alternation, ``case_sensitive`` applies).
    A row whose text is unknown is not excluded by either.
    """
    keep = None
    for c in conditions:
        keep = known(c) if keep is None else keep & known(c)
    for word in excluded or []:
        term = ~known(contains_text(text_col, word, case_sensitive))
        keep = term if keep is None else keep & term
    if exclude_regex:
        term = ~known(matches(text_col, exclude_regex, case_sensitive))
        keep = term if keep is None else keep & term
    return df.filter(keep)


def clean_zero_filter(df: DataFrame, category: str, categories: list[str], value: str) -> DataFrame:
    """Rows in the listed categories whose cleaned value equals exactly 0 (junk is not 0)."""
    return df.filter(F.col(category).isin(*categories) & known(to_number(value) == F.lit(0.0)))


@dataclass(frozen=True)
class ScenarioSpec:
    """How a what-if scenario scores rows.

    ``measures`` maps a measure column to its threshold; each measure is
    first normalised per ``per`` units of ``base``.  A row scores one point
    per measure over its threshold (``>=`` when ``inclusive``, else ``>``).
    The mitigated scenario multiplies each normalised measure by its factor
    -- only for rows over the threshold when ``reduce_only_flagged`` -- and
    re-scores with the same thresholds.
    """
    measures: dict[str, float]
    factors: dict[str, float]
    base: str
    per: float = 100.0
    inclusive: bool = True
    reduce_only_flagged: bool = True
    positive_base_only: bool = False
    ratio_first: bool = False
    labels: tuple[str, str] = SCENARIO_LABELS


def _normalised(m: str, spec: ScenarioSpec) -> Column:
    base = F.col(spec.base).cast("double")
    val = F.col(m).cast("double")
    if spec.ratio_first:
        out = safe_divide(val, base) * F.lit(spec.per)
    else:
        out = safe_divide(val * F.lit(spec.per), base)
    if spec.positive_base_only:
        out = F.when(base > 0, out)
    return out


def _over(v: Column, thr: float, inclusive: bool) -> Column:
    return known(v >= F.lit(thr) if inclusive else v > F.lit(thr))


def scenario_risk(df: DataFrame, spec: ScenarioSpec, scenario_name: str = "scenario",
                  score_name: str = "risk_score") -> DataFrame:
    """Risk-score distribution for a baseline and a mitigated scenario, with shares.

    One scan: both scores are computed per row and the two scenarios are
    stacked with ``explode(array(struct, struct))`` (no second read of the
    input), then counted per (scenario, score) with a partial/final
    aggregate; each count's percentage of its scenario comes from a window
    over that few-row result.  Output is ordered by the scenario list, then
    score descending.
    """
    flags_base, flags_new = [], []
    for m, thr in spec.measures.items():
        v = _normalised(m, spec)
        over = _over(v, thr, spec.inclusive)
        factor = F.lit(spec.factors.get(m, 1.0))
        v_new = F.when(over, v * factor).otherwise(v) if spec.reduce_only_flagged else v * factor
        flags_base.append(over.cast("int"))
        flags_new.append(_over(v_new, thr, spec.inclusive).cast("int"))

    def total(cols):
        out = cols[0]
        for c in cols[1:]:
            out = out + c
        return out

    stacked = df.select(F.explode(F.array(
        F.struct(F.lit(spec.labels[0]).alias("s"), total(flags_base).alias("r")),
        F.struct(F.lit(spec.labels[1]).alias("s"), total(flags_new).alias("r")),
    )).alias("__x")).select(F.col("__x.s").alias(scenario_name), F.col("__x.r").cast("bigint").alias(score_name))
    shares = share_of_total(stacked, [scenario_name], [score_name])
    return shares.orderBy(ordinal_position(scenario_name, list(spec.labels)), F.col(score_name).desc())
