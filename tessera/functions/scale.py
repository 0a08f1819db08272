"""Column functions of the lift scale: labels, multipliers, clamps, verdicts and safe numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.plans import settings as S


#: White space as Unicode has it; the JVM's own class is ASCII.
SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def change_label(raw: Column | str) -> Column:
    """The label without white space around it and in lower case; anything off the scale, and null, is ``unchanged``."""
    label = F.lower(F.regexp_replace(col_of(raw), rf"^{SPACE}+|{SPACE}+$", ""))
    return F.when(label.isin(*S.LIFT_OF, S.GUARANTEED), label).otherwise("unchanged")


def clamp(value: Column, bounds: tuple[float, float]) -> Column:
    return F.least(F.greatest(value, F.lit(bounds[0])), F.lit(bounds[1]))


def lift_of_change(change: Column | str, prior: Column | str) -> Column:
    """The multiplier of a label; ``guaranteed`` lifts the prior to near certainty."""
    c = col_of(change)
    scale = F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in S.LIFT_OF.items()], F.lit(1.0))
    sure = F.lit(S.GUARANTEED_POSTERIOR) / F.greatest(col_of(prior), F.lit(S.PRIOR_RANGE[0]))
    return clamp(F.when(c == S.GUARANTEED, sure).otherwise(scale), S.LIFT_RANGE)


def verdict(log_lift: Column | str) -> Column:
    """The half-open band of a log lift. NaN and infinity are in none, so they are neutral (Spark sorts NaN last)."""
    x = col_of(log_lift)
    out = F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), "neutral")
    for name, low in reversed(S.VERDICTS[1:]):
        out = out.when(x >= low, name)
    return out.otherwise(S.VERDICTS[0][0])


def safe_double(value: Column | str, default: float) -> Column:
    """A finite number, or the default for null, text that is no number, NaN and infinity."""
    raw = col_of(value).cast("string")
    x = F.when(raw.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), F.expr(f"try_cast({_name(value)} as double)") if isinstance(value, str) else raw.cast("double"))
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(default)).otherwise(x)


def _name(c: str) -> str:
    return f"`{c}`"


def credibility(meta: Column | str) -> Column:
    """The weight of a record in its JSON ``meta``, 1 where it is absent or no number."""
    return safe_double(F.get_json_object(col_of(meta), "$.credibility"), 1.0)


def supports(v: Column | str) -> Column:
    return col_of(v).isin("supports", "strongly_supports")


def contradicts(v: Column | str) -> Column:
    return col_of(v).isin("contradicts", "strongly_contradicts")
