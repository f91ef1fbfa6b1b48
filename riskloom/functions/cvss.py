"""CVSS 3.1 base scores from 0 to 100, as Column arithmetic in the standard's order of operations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the standard.
WEIGHTS = {
    "C": ({"H": 0.56, "L": 0.22}, 0.0),
    "I": ({"H": 0.56, "L": 0.22}, 0.0),
    "A": ({"H": 0.56, "L": 0.22}, 0.0),
    "AV": ({"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}, 0.85),
    "AC": ({"L": 0.77, "H": 0.44}, 0.77),
    "UI": ({"N": 0.85, "R": 0.62}, 0.85),
}
PRIVILEGES = ({"N": 0.85, "L": 0.62, "H": 0.27}, 0.85)
PRIVILEGES_CHANGED = ({"N": 0.85, "L": 0.68, "H": 0.50}, 0.85)


def base_score(vector: Column) -> Column:
    """ceil(10 x base score) of a vector; missing vectors and vectors without impact score 0, missing metrics count as most severe."""
    metrics = F.str_to_map(F.regexp_replace(vector, "^[^/]*/?", ""), F.lit("/"), F.lit(":"))
    # Inside a lambda the map is a variable: taken apart once a vector, not once a metric and value.
    return F.coalesce(F.get(F.transform(F.array(metrics), _score), F.lit(0)), F.lit(0)).cast("int")


def _score(metrics: Column) -> Column:
    def weight(name: str, table=None) -> Column:
        values, rest = table or WEIGHTS[name]
        out = F.lit(rest)
        for key, value in values.items():
            out = F.when(F.try_element_at(metrics, F.lit(name)) == key, value).otherwise(out)
        return out

    changed = F.coalesce(F.try_element_at(metrics, F.lit("S")) == "C", F.lit(False))
    lost = 1.0 - ((1.0 - weight("C")) * (1.0 - weight("I")) * (1.0 - weight("A")))
    impact = F.when(changed, 7.52 * (lost - 0.029) - 3.25 * F.pow(lost - 0.02, F.lit(15.0))).otherwise(6.42 * lost)
    needed = F.when(changed, weight("PR", PRIVILEGES_CHANGED)).otherwise(weight("PR", PRIVILEGES))
    ease = 8.22 * weight("AV") * weight("AC") * needed * weight("UI")
    score = F.least(F.when(changed, 1.08 * (impact + ease)).otherwise(impact + ease), F.lit(10.0))
    return F.when(impact <= 0, 0).otherwise(F.ceil(score * 10))
