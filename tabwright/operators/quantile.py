"""Exact quantiles of groups of any size.

Small groups, whose rows are counted first, are the matter of one aggregate. Larger ones are bracketed: a KLL sketch per
group, merged from partial ones, tells two values between which a quantile's ranks lie but for a small chance; one more
pass counts what lies below and inside each bracket, which proves it, and sketches the inside, so that a bracket that
still holds too many rows is narrowed by the same steps. At last only the distinct values inside the brackets are
shuffled and ranked. No task or aggregate ever holds a group's values, and values are never sorted as a whole.

Where a bracket fails (a sketch was off, or values are not numbers), values shrink to one row for each distinct one with
its count, are dealt by range of (group, value), and a quantile's neighbours are found by their ranks. All ways give the
same results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.operators.order import PART, PLACE, ordered_parts, persisted

#: Values of a group that an aggregate may hold, and that one bracket may.
MOST_VALUES = 500_000
#: Size of a sketch, and how far to both sides of a rank its brackets reach (about three times its error of 0.1 %).
SKETCH, REACH = 3_200, 0.003
#: Steps of the ranks that a sketch is asked for.
GRID = 200
#: Times that brackets are narrowed: each one leaves about a fiftieth of the rows.
NARROWED = 6


def group_quantiles(df: DataFrame, groups: dict[str, Column], value: Column, shares: list[float], most_values: int = MOST_VALUES) -> DataFrame:
    """One row per group that has values: the groups' columns, then q0, q1...: the values at the shares (0..1) of each group, linear between ranks. Null groups are groups; null values don't count."""
    # groups go by names of our own inside, so that none of theirs meets a column made here
    names = [f"_g{i}" for i in range(len(groups))]
    cells = df.select(*[c.alias(n) for n, c in zip(names, groups.values())], value.cast("double").alias("_x")).filter("_x IS NOT NULL")
    given = [F.col(n).alias(g) for n, g in zip(names, groups)]
    largest = cells.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= most_values:
        found = cells.groupBy(*names).agg(F.percentile("_x", F.array(*[F.lit(float(s)) for s in shares])).alias("_q"))
        return found.select(*given, *[F.get("_q", F.lit(i)).alias(f"q{i}") for i in range(len(shares))])
    cells = persisted(cells)
    found = _by_brackets(cells, names, shares, most_values)
    if found is None:
        found = _by_ranks(cells, names, shares)
    return found.select(*given, *[f"q{i}" for i in range(len(shares))])


def _beside(cells: DataFrame, table: DataFrame, names: list[str]) -> DataFrame:
    """``cells`` with the row of their group in ``table``; null groups meet. Spark broadcasts the table if it is small and else splits large groups."""
    own = table.select(*[F.col(n).alias(f"{n}_of") for n in names], *[c for c in table.columns if c not in names])
    if not names:
        return cells.crossJoin(F.broadcast(own))
    return cells.join(own, reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"{n}_of")) for n in names])).drop(*[f"{n}_of" for n in names])


def _by_brackets(cells: DataFrame, names: list[str], shares: list[float], most_values: int) -> DataFrame | None:
    """The quantiles by sketches and counts; None if a bracket doesn't hold its ranks or stays too wide."""
    each = range(len(shares))
    x = F.col("_x")

    low = [F.floor((F.col("_n") - 1) * F.lit(float(s))) for s in shares]
    high = [F.least(r + 1, F.col("_n") - 1) for r in low]

    ranks = F.array(*[F.lit(k / GRID) for k in range(GRID + 1)])

    def bracket(i: int, grid: str, before: Column, among: Column) -> list[Column]:
        """Around both ranks of a quantile, of which the sketch lacks those before and has so many."""
        place = lambda r, more: ((r - before + 0.5) / among + more) * GRID
        at = lambda k: F.get(grid, F.greatest(F.least(k, F.lit(GRID)), F.lit(0)).cast("int"))
        return [at(F.floor(place(low[i], -REACH))).alias(f"_lo{i}"), at(F.ceil(place(high[i], REACH))).alias(f"_hi{i}")]

    whole = cells.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"), F.kll_sketch_agg_double("_x", F.lit(SKETCH)).alias("_s"))
    whole = persisted(whole.filter("_s IS NOT NULL").select(*names, "_n", F.kll_sketch_get_quantile_double("_s", ranks).alias("_s")))
    bounds = whole.select(*names, "_n", *[c for i in each for c in bracket(i, "_s", F.lit(0), F.col("_n"))])
    for _ in range(NARROWED):
        bounds = persisted(bounds)
        inside = lambda i: (x >= F.col(f"_lo{i}")) & (x <= F.col(f"_hi{i}"))
        made = [F.first("_n").alias("_n")]
        for i in each:
            made += [
                F.first(f"_lo{i}").alias(f"_lo{i}"), F.first(f"_hi{i}").alias(f"_hi{i}"),
                F.count(F.when(x < F.col(f"_lo{i}"), 1)).alias(f"_below{i}"), F.count(F.when(inside(i), 1)).alias(f"_in{i}"),
                F.kll_sketch_agg_double(F.when(inside(i), x), F.lit(SKETCH)).alias(f"_s{i}"),
            ]
        seen = _beside(cells, bounds, names).groupBy(*names).agg(*made)
        seen = persisted(seen.withColumns({f"_s{i}": F.when(F.col(f"_in{i}") > 0, F.kll_sketch_get_quantile_double(f"_s{i}", ranks)) for i in each}))
        holds = [(F.col(f"_below{i}") <= low[i]) & (high[i] < F.col(f"_below{i}") + F.col(f"_in{i}")) for i in each]
        wide = [(F.col(f"_in{i}") > most_values) & (F.col(f"_lo{i}") < F.col(f"_hi{i}")) for i in each]
        told = seen.agg(F.min(reduce(lambda a, b: a & b, holds)).alias("held"), F.max(reduce(lambda a, b: a | b, wide)).alias("wide"), F.sum("_n").alias("n")).first()
        if not told["held"] or told["n"] != cells.count():
            return None
        if not told["wide"]:
            return _inside_brackets(cells, seen, names, low, high, shares)
        bounds = seen.select(*names, "_n", *[F.when(wide[i], new).otherwise(F.col(old)).alias(old) for i in each for new, old in zip(bracket(i, f"_s{i}", F.col(f"_below{i}"), F.col(f"_in{i}")), (f"_lo{i}", f"_hi{i}"))])
    return None


def _inside_brackets(cells: DataFrame, seen: DataFrame, names: list[str], low: list[Column], high: list[Column], shares: list[float]) -> DataFrame:
    """The quantiles from the values inside brackets that hold them."""
    each = range(len(shares))
    of = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"_lo{i}").alias("lo"), F.col(f"_hi{i}").alias("hi"), F.col(f"_below{i}").alias("below"), low[i].alias("low"), high[i].alias("high"), ((F.col("_n") - 1) * F.lit(float(shares[i])) - low[i]).alias("weight")) for i in each]))
    table = persisted(seen.select(*names, of.alias("_b")).select(*names, "_b.*"))
    ranges = table.groupBy(*names).agg(F.collect_list(F.struct("i", "lo", "hi")).alias("_all"))
    within = F.filter("_all", lambda b: (F.col("_x") >= b["lo"]) & (F.col("_x") <= b["hi"]))
    counts = _beside(cells, ranges, names).select(*names, "_x", F.explode(within).alias("_b")).groupBy(*names, F.col("_b.i").alias("i"), "_x").agg(F.count(F.lit(1)).alias("_c"))
    order = Window.partitionBy(*names, "i").orderBy("_x")
    ranked = counts.withColumn("_to", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    both = _beside(ranked, table.withColumnRenamed("i", "_i"), names).filter("i = _i")
    start, end = F.col("below") + F.col("_to") - F.col("_c"), F.col("below") + F.col("_to")
    at = lambda rank: F.max(F.when((start <= F.col(rank)) & (F.col(rank) < end), F.col("_x")))
    value = at("low") + F.when(F.first("weight") > 0, (at("high") - at("low")) * F.first("weight")).otherwise(0.0)
    found = both.groupBy(*names, "i").agg(value.alias("q"))
    return found.groupBy(*names).agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(f"q{i}") for i in each])


def _by_ranks(cells: DataFrame, names: list[str], shares: list[float]) -> DataFrame:
    counts = cells.groupBy(*names, "_x").agg(F.count(F.lit(1)).alias("_c"))
    parts = ordered_parts(counts, [*names, "_x"])
    within = parts.withColumn("_to", F.sum("_c").over(Window.partitionBy(PART, *names).orderBy(PLACE)))
    ends = parts.groupBy(F.col(PART).alias("_p"), *[F.col(n).alias(f"{n}_of") for n in names]).agg(F.sum("_c").alias("_s"))
    line, whole = Window.partitionBy(*[f"{n}_of" for n in names]).orderBy("_p"), Window.partitionBy(*[f"{n}_of" for n in names])
    ends = ends.select("*", F.coalesce(F.sum("_s").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_s").over(whole).alias("_n"))
    on = F.col(PART) == F.col("_p")
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"{n}_of"))
    ranked = within.join(ends, on).select(*names, "_x", "_n", (F.col("_before") + F.col("_to") - F.col("_c")).alias("_from"), (F.col("_before") + F.col("_to")).alias("_to"))

    def at(rank: Column) -> Column:
        """The value whose ranks (from 0) include one."""
        return F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_to")), F.col("_x")))

    made = []
    for i, share in enumerate(shares):
        place = (F.col("_n") - 1) * F.lit(float(share))
        low = F.floor(place)
        made += [at(low).alias(f"_l{i}"), at(F.least(low + 1, F.col("_n") - 1)).alias(f"_h{i}"), F.max(place - low).alias(f"_w{i}")]
    found = ranked.groupBy(*names).agg(*made)
    return found.select(*names, *[(F.col(f"_l{i}") + F.when(F.col(f"_w{i}") > 0, (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.col(f"_w{i}")).otherwise(0.0)).alias(f"q{i}") for i in range(len(shares))])
