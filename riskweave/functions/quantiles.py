"""Exact quantiles (linear interpolation) by rank selection, without sorting a group in one task.

``percentile`` keeps a value->count map per group and merges it in one
task, which is unbounded when one group holds a large share of the rows.
Here the same bounded steps serve every group, large or small, and any
number of groups; nothing is collected:

1. one aggregate per group: its size and ``percentile_approx`` (a mergeable
   sketch of bounded size) at p -/+ a margin around every requested p.
2. a bracket per (group, p): the sketch values around p; the whole range of
   a group with no more than `accuracy` values.
3. one pass over the data joined with the brackets (groups x probs rows; the
   optimizer broadcasts them if they are small): values below the bracket
   collapse into one counted bucket map-side, values inside are kept as
   distinct (value, weight) pairs, values above are dropped. Per (group, p)
   this leaves roughly ``6 * n / accuracy`` distinct values, spread over all
   tasks by their hash.
4. the bracket is cut into RANGES value ranges whose weights are counted
   (map-side combined) and give each range its offset; only the ranges
   that hold the ranks floor(place) and the next one are sorted, as one short
   list per (group, p). The result interpolates linearly, as ``percentile``
   and DuckDB's ``quantile_cont`` do.

If a bracket ever misses its ranks (the sketch guarantee failed), the
result raises instead of returning a wrong number; a larger ``margin``
widens the brackets.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_ACCURACY = 100_000
# Half-width of a bracket in units of 1 / accuracy: the sketch is off by one at most.
DEFAULT_MARGIN = 3.0
# Value ranges of a bracket.
RANGES = 4096

_V, _I, _B, _W = "__q_v", "__q_i", "__b_i", "__q_w"


def _bracket_probs(probs: Sequence[float], margin: float) -> list[float]:
    out = []
    for p in probs:
        out.append(max(0.0, p - margin))
        out.append(min(1.0, p + margin))
    return out


def _find(items: str, start: str, value: str) -> Column:
    """Walk ``items`` (value, weight), sorted, from the rank ``start``: the
    values that hold the ranks k0 and k1, and the rank before the first."""
    none = F.lit(None).cast("bigint" if value == "range" else "double")
    begin = F.struct(F.col(start).alias("upto"), none.alias("first"), none.alias("second"), F.lit(None).cast("bigint").alias("before"))

    def step(a: Column, x: Column) -> Column:
        end = a["upto"] + x["weight"]
        holds = (F.col("k0") >= a["upto"]) & (F.col("k0") < end)
        return F.struct(end.alias("upto"), F.when(holds, x[value]).otherwise(a["first"]).alias("first"),
                        F.when((F.col("k1") >= a["upto"]) & (F.col("k1") < end), x[value]).otherwise(a["second"]).alias("second"),
                        F.when(holds, a["upto"]).otherwise(a["before"]).alias("before"))

    return F.aggregate(items, begin, step)


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), accuracy: int = DEFAULT_ACCURACY,
                    margin: float = DEFAULT_MARGIN, place: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Columns ``*by, n, q0..q{P-1}``: exact quantiles of non-null ``value``;
    groups without any non-null value are absent. Lazy. ``place`` gives the
    0-based rank of p among n values, p * (n - 1) if not given; it must lie
    within a few ranks of that."""
    by, probs = list(by), list(probs)
    if not by:  # a constant key keeps every join an equi-join
        return exact_quantiles(df.withColumn("__q_g", F.lit(0)), value, probs, ["__q_g"], accuracy, margin, place).drop("__q_g")
    base = df.select(*by, F.col(value).cast("double").alias(_V)).where(F.col(_V).isNotNull())

    sketch = F.percentile_approx(_V, F.array(*[F.lit(p) for p in _bracket_probs(probs, margin / accuracy)]), F.lit(accuracy))
    stats = base.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), sketch.alias("__q_a"), F.min(_V).alias("__q_min"), F.max(_V).alias("__q_max"))
    one = F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias(_I, "__q_p")
    brackets = stats.select(*by, "n", "__q_a", "__q_min", "__q_max", one)
    # The margin must span some ranks: up to `accuracy` values the bracket is the whole range.
    few = F.col("n") <= accuracy
    at = (place or (lambda p, n: p * (n - 1)))(F.col("__q_p"), F.col("n"))
    keys = [f"__b_{c}" for c in by]
    brackets = brackets.select(
        *by, _I, "n", F.floor(at).cast("bigint").alias("k0"), F.least(F.floor(at).cast("bigint") + 1, F.col("n") - 1).alias("k1"),
        (at - F.floor(at)).cast("double").alias("frac"), F.when(few, F.col("__q_min")).otherwise(F.element_at("__q_a", F.col(_I) * 2 + 1)).alias("lo"),
        F.when(few, F.col("__q_max")).otherwise(F.element_at("__q_a", F.col(_I) * 2 + 2)).alias("hi")).toDF(*keys, _B, "n", "k0", "k1", "frac", "lo", "hi")
    group = F.lit(True)
    for c, k in zip(by, keys):
        group = group & F.col(c).eqNullSafe(F.col(k))
    same = (F.col(_I) == F.col(_B)) & group

    # A row per group and probability: sent to the rows. Dealt by group, all rows of one would meet in one task.
    joined = base.join(F.broadcast(brackets), group).where(F.col(_V) <= F.col("hi")).withColumn(_I, F.col(_B))
    # Below the bracket: range -1 (one counted row per task after the map-side combine).
    inside, wide = F.col(_V) >= F.col("lo"), F.col("hi") - F.col("lo")
    part = F.least(F.lit(RANGES - 1), F.floor((F.col(_V) - F.col("lo")) / wide * RANGES))
    part = F.when(~inside, -1).when((wide > 0) & (wide < float("inf")), part).otherwise(0).cast("bigint")
    cands = joined.select(*by, _I, part.alias("range"), F.when(inside, F.col(_V)).alias(_V)).groupBy(*by, _I, "range", _V).agg(F.count(F.lit(1)).alias(_W))

    counted = cands.groupBy(*by, _I, "range").agg(F.sum(_W).alias("weight")).groupBy(*by, _I).agg(
        F.array_sort(F.collect_list(F.struct("range", "weight"))).alias("ranges")).withColumn("zero", F.lit(0).cast("bigint"))
    chosen = counted.join(brackets.drop("lo", "hi"), same).select(
        *keys, _B, "n", "k0", "k1", "frac", _find("ranges", "zero", "range").alias("r")).select("*", "r.*").drop("r", "upto")
    # Ranges between the two that hold the ranks are empty.
    held = cands.join(chosen, same).where((F.col("range") >= 0) & ((F.col("range") == F.col("first")) | (F.col("range") == F.col("second"))))
    lists = held.groupBy(*by, _I).agg(F.array_sort(F.collect_list(F.struct(F.col(_V).alias("value"), F.col(_W).alias("weight")))).alias("values"),
                                             *[F.max(c).alias(c) for c in ("n", "k0", "k1", "frac", "before")])
    per = lists.withColumn("v", _find("values", "before", "value")).select(*by, _I, "n", "frac", F.col("v.first").alias("v0"), F.col("v.second").alias("v1"))
    q = F.when(F.col("v0").isNull() | F.col("v1").isNull(),
               F.raise_error(F.lit("exact_quantiles: bracket missed its rank; repeat with a larger margin")).cast("double")) \
        .otherwise(F.when(F.col("frac") == 0, F.col("v0"))
                   .otherwise(F.col("v0") + F.col("frac") * (F.col("v1") - F.col("v0"))))
    per = per.withColumn("q", q)
    found = per.groupBy(*by).agg(F.max("n").alias("n"), *[F.max(F.when(F.col(_I) == i, F.col("q"))).alias(f"q{i}") for i in range(len(probs))],
                                 F.count(F.lit(1)).alias("__q_found"))
    # A rank below its bracket leaves no value at all: that too must not pass in silence.
    whole = F.when(F.col("__q_found") == len(probs), F.col("n")).otherwise(
        F.raise_error(F.lit("exact_quantiles: bracket missed its rank; repeat with a larger margin")).cast("bigint"))
    return found.withColumn("n", whole).drop("__q_found")
