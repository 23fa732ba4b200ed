"""Exact quantiles whose memory does not grow with the data.

Whole columns take one path whatever their size.  One aggregate counts the values of all columns and sketches them (KLL,
combined map-side); the sketch gives bounds around each wanted order statistic.  A second aggregate counts the values
below, at and between the bounds and keeps those between, which are few, so the counts say which of them is wanted.
A bracket that would still hold more values than a task should keep is sketched and counted again.  The result is the
linearly interpolated quantile.

Groups finish in one grouped ``percentile``, which keeps the distinct values of a group in one task; groups too large
for that are narrowed together in the same manner.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablescout.session import durable

#: Values of one bracket that a task may hold.
HELD_VALUES = 50_000
EXACT_GROUP_ROWS = 2_000_000
_ACCURACY = 10_000
#: Size of a sketch, and the share of values that its bounds stand away from a wanted one; three times its usual error.
_SKETCH, _MARGIN = 2048, 0.005


@dataclass
class _Bracket:
    """Wanted ranks (from 0) whose values lie strictly between ``low`` and ``high``.

    ``below`` values are at or under ``low``; ``inside`` lie between the bounds.
    """

    column: str
    ranks: tuple[int, ...]
    inside: int
    below: int = 0
    low: float | None = None
    high: float | None = None

    def masked(self) -> Column:
        x = F.col(self.column)
        keep = x.isNotNull()
        if self.low is not None:
            keep = keep & (x > F.lit(self.low))
        if self.high is not None:
            keep = keep & (x < F.lit(self.high))
        return F.when(keep, x)

    def fractions(self) -> list[float]:
        """Where a sketch of the values inside should show each wanted rank, with a margin on both sides."""
        centres = [(r - self.below + 0.5) / self.inside for r in self.ranks]
        return sorted({min(1.0, max(0.0, c + side * _MARGIN)) for c in centres for side in (-1, 1)})

    def zones(self, bounds: Sequence[float], held: int) -> list[tuple[Column, Column | None]]:
        """Count of values per zone, and its sorted values if they are few; odd zones are the bounds themselves."""
        x, out = self.masked(), []
        keep = not bounds or 2.5 * _MARGIN * self.inside <= held
        for z in range(2 * len(bounds) + 1):
            if z % 2:
                out.append((F.count_if(x == F.lit(bounds[z // 2])), None))
                continue
            here = F.lit(True)
            if z:
                here = here & (x > F.lit(bounds[z // 2 - 1]))
            if z < 2 * len(bounds):
                here = here & (x < F.lit(bounds[z // 2]))
            inner = not bounds or 0 < z < 2 * len(bounds)
            out.append((F.count(F.when(here, x)), F.sort_array(F.collect_list(F.when(here, x))) if keep and inner else None))
        return out

    def split(self, bounds: Sequence[float], counts: Sequence[int]) -> tuple[dict[int, float], list["_Bracket"]]:
        """Ranks that fall on a bound, and brackets between bounds for the others."""
        known, rest, start = {}, [], self.below
        for z, n in enumerate(counts):
            ranks = tuple(r for r in self.ranks if start <= r < start + n)
            if ranks and z % 2:
                known.update({r: bounds[z // 2] for r in ranks})
            elif ranks:
                low = bounds[z // 2 - 1] if z else self.low
                high = bounds[z // 2] if z < 2 * len(bounds) else self.high
                rest.append(_Bracket(self.column, ranks, n, start, low, high))
            start += n
        return known, rest


def _interpolate(n: int, probs: Sequence[float], values: dict[int, float]) -> list[float]:
    out = []
    for p in probs:
        h = p * (n - 1)
        low, high = values[math.floor(h)], values[math.ceil(h)]
        out.append(low if low == high else low + (h - math.floor(h)) * (high - low))
    return out


def _sketched(x: Column, fractions: Sequence[float]) -> Column:
    """Values near some fractions of the order of ``x``."""
    sketch = F.call_function("kll_sketch_agg_double", x, F.lit(_SKETCH))
    return F.when(F.count(x) > 0, F.call_function("kll_sketch_get_quantile_double", sketch, F.array(*map(F.lit, fractions))))


def _counted(x: DataFrame, brackets: Sequence[_Bracket], bounds: Sequence[Sequence[float]], held: int) -> list[tuple[dict[int, float], list[int]]]:
    """Per bracket the ranks found among kept values, and the counts of its zones."""
    aggs, wanted = [], []
    for i, (b, edges) in enumerate(zip(brackets, bounds)):
        start = F.lit(b.below)
        found = {r: F.lit(None).cast("double") for r in b.ranks}
        for z, (count, values) in enumerate(b.zones(edges, held)):
            aggs += [count.alias(f"n{i}_{z}")] + ([values.alias(f"v{i}_{z}")] if values is not None else [])
            if values is not None:
                for r in b.ranks:
                    found[r] = F.coalesce(found[r], F.when(F.lit(r) >= start, F.try_element_at(F.col(f"v{i}_{z}"), (F.lit(r) - start + 1).cast("int"))))
            start = start + F.col(f"n{i}_{z}")
        wanted += [F.col(f"n{i}_{z}") for z in range(2 * len(edges) + 1)] + [value.alias(f"r{i}_{r}") for r, value in found.items()]
    row = x.agg(*aggs).select(*wanted).first()
    out = []
    for i, (b, edges) in enumerate(zip(brackets, bounds)):
        known = {r: row[f"r{i}_{r}"] for r in b.ranks if row[f"r{i}_{r}"] is not None}
        out.append((known, [row[f"n{i}_{z}"] for z in range(2 * len(edges) + 1)]))
    return out


def _value(column: str) -> Column:
    """The column as a double, NaN as missing."""
    return F.nullif(F.col("`" + column.replace("`", "``") + "`").cast("double"), F.lit(float("nan")))


def quantile_start(columns: Sequence[str], probs: Sequence[float]) -> list[Column]:
    """Aggregates that ``column_quantiles`` begins with, for a caller that reads the columns anyway."""
    fractions = sorted({min(1.0, max(0.0, p + side * _MARGIN)) for p in probs for side in (-1, 1)})
    return [f for c in columns for f in (F.count(_value(c)).alias(f"n_{c}"), _sketched(_value(c), fractions).alias(f"q_{c}"))]


def column_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], exact_rows: int = HELD_VALUES,
    counts: dict[str, int] | None = None, start: Mapping | None = None,
) -> dict[str, list[float] | None]:
    """Quantiles of whole columns, returned as a few numbers per column; NaN counts as missing.

    ``exact_rows`` is the number of values of a bracket that a task may hold.  ``counts`` (non-null values per column) is
    taken on trust for columns that have none.  ``start`` holds what ``quantile_start`` gave for the same rows.
    """
    columns = [c for c in columns if counts is None or counts[c] > 0]
    out: dict[str, list[float] | None] = {c: None for c in (counts or columns)}
    if not columns:
        return out
    names = {f"x{i}": c for i, c in enumerate(columns)}
    x = df.select(*[_value(c).alias(n) for n, c in names.items()])
    if start is None:
        first = x.agg(*quantile_start(list(names), probs)).first()
    else:
        first = {f"{kind}_{n}": start[f"{kind}_{c}"] for n, c in names.items() for kind in ("n", "q")}
    totals = {n: first[f"n_{n}"] for n in names if first[f"n_{n}"]}
    ranks = {n: tuple(sorted({r for p in probs for r in (math.floor(p * (t - 1)), math.ceil(p * (t - 1)))})) for n, t in totals.items()}
    brackets = [_Bracket(n, ranks[n], t) for n, t in totals.items()]
    bounds = [[] if b.inside <= exact_rows else sorted(set(first[f"q_{b.column}"])) for b in brackets]
    values: dict[str, dict[int, float]] = {n: {} for n in totals}
    while brackets:
        rest = []
        for b, edges, (known, counted) in zip(brackets, bounds, _counted(x, brackets, bounds, exact_rows)):
            values[b.column].update(known)
            on_bounds, open_ = b.split(edges, counted)
            values[b.column].update(on_bounds)
            for c in open_:
                c.ranks = tuple(r for r in c.ranks if r not in known)
                rest += [c] if c.ranks else []
        brackets, bounds = rest, [[] for _ in rest]
        if large := [i for i, b in enumerate(rest) if b.inside > exact_rows]:
            row = x.agg(*[_sketched(rest[i].masked(), rest[i].fractions()).alias(f"q{i}") for i in large]).first()
            for i in large:
                bounds[i] = sorted(set(row[f"q{i}"]))
    out.update({names[n]: _interpolate(t, probs, values[n]) for n, t in totals.items()})
    return out


def _open_bracket(x: Column, i: int) -> Column:
    low, high = F.col(f"low{i}"), F.col(f"high{i}")
    inside = (low.isNull() | (x > low)) & (high.isNull() | (x < high))
    return F.when(F.col(f"value{i}").isNull() & inside, x)


def _narrowed(i: int) -> dict[str, Column]:
    """The next state of target ``i`` from the counts around its sketched bounds."""
    k, inside = F.col(f"k{i}"), F.col(f"inside{i}")
    lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
    low, high, value = F.col(f"low{i}"), F.col(f"high{i}"), F.col(f"value{i}")
    under, at_low, mid = F.col(f"under{i}"), F.col(f"atlow{i}"), F.col(f"mid{i}")
    at_high = F.when(lo == hi, F.lit(0)).otherwise(F.col(f"athigh{i}"))
    first, second = under + at_low, under + at_low + mid
    third = second + at_high
    done = value.isNotNull()
    return {
        f"k{i}": F.when(done | (k < first), k).when(k < second, k - first)
                  .when(k < third, k).otherwise(k - third),
        f"inside{i}": F.when(done, inside).when(k < under, under).when(k < first, inside)
                       .when(k < second, mid).when(k < third, inside).otherwise(inside - third),
        f"low{i}": F.when(done | (k < first), low).when(k < second, lo).when(k < third, low).otherwise(hi),
        f"high{i}": F.when(done, high).when(k < under, lo).when(k < first, high)
                     .when(k < second, hi).otherwise(high),
        f"value{i}": F.when(done, value).when(k < under, F.lit(None)).when(k < first, lo)
                      .when(k < second, F.lit(None)).when(k < third, hi),
    }


def _hot_group_values(x: DataFrame, by: list[str], state: DataFrame, targets: int, exact_rows: int) -> DataFrame:
    """Order statistics of the large groups, all narrowed together; ``state`` has one row per group."""
    grid = [g / 1000 for g in range(1001)]
    kept = [f"{c}{i}" for i in range(targets) for c in ("k", "inside", "low", "high", "value")]

    def joined(frame: DataFrame) -> DataFrame:
        same = [F.col(f"r.{b}").eqNullSafe(F.col(f"s.{b}")) for b in by]
        condition = same[0]
        for part in same[1:]:
            condition = condition & part
        rest = [c for c in frame.columns if c not in by]
        return x.alias("r").join(frame.alias("s"), condition).select(
            *[F.col(f"s.{b}").alias(b) for b in by], F.col("r._x").alias("_x"), *[F.col(f"s.{c}") for c in rest])

    while True:
        open_targets = [F.col(f"value{i}").isNull() & (F.col(f"inside{i}") > exact_rows) for i in range(targets)]
        active = open_targets[0]
        for part in open_targets[1:]:
            active = active | part
        if state.where(active).isEmpty():
            break
        sketch = joined(state).groupBy(*by, "_n", *kept).agg(*[
            F.percentile_approx(_open_bracket(F.col("_x"), i), F.array(*map(F.lit, grid)), _ACCURACY).alias(f"s{i}")
            for i in range(targets)])
        place = [F.floor((F.col(f"k{i}") + 0.5) / F.col(f"inside{i}") * 1000) for i in range(targets)]
        bounds = sketch.select(*by, "_n", *kept, *[
            F.element_at(f"s{i}", F.greatest(F.lit(1), place[i]).cast("int")).alias(f"lo{i}") for i in range(targets)
        ], *[
            F.element_at(f"s{i}", F.least(F.lit(1001), place[i] + 3).cast("int")).alias(f"hi{i}") for i in range(targets)
        ])
        bounds = durable(bounds)
        aggs = []
        for i in range(targets):
            v = _open_bracket(F.col("_x"), i)
            lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
            aggs += [F.count_if(v < lo).alias(f"under{i}"), F.count_if(v == lo).alias(f"atlow{i}"),
                     F.count_if((v > lo) & (v < hi)).alias(f"mid{i}"), F.count_if(v == hi).alias(f"athigh{i}")]
        edges = [f"{c}{i}" for i in range(targets) for c in ("lo", "hi")]
        counted = joined(bounds).groupBy(*by, "_n", *kept, *edges).agg(*aggs)
        columns = {name: c for i in range(targets) for name, c in _narrowed(i).items()}
        state = durable(counted.select(*by, "_n", *[columns[c].alias(c) for c in kept]))
    return joined(state).groupBy(*by, "_n", *kept).agg(*[
        F.sort_array(F.collect_list(_open_bracket(F.col("_x"), i))).alias(f"v{i}") for i in range(targets)
    ]).select(*by, "_n", *[
        F.coalesce(F.col(f"value{i}"), F.try_element_at(F.col(f"v{i}"), (F.col(f"k{i}") + 1).cast("int"))).alias(f"y{i}")
        for i in range(targets)])


def group_quantiles(
    df: DataFrame, by: Sequence[str], column: str, probs: Sequence[float], names: Sequence[str],
    exact_rows: int = EXACT_GROUP_ROWS,
) -> DataFrame:
    """Quantiles of one column per group: one row per group, one column per name.

    Groups up to ``exact_rows`` rows finish in one grouped ``percentile``.  The larger ones (at
    most rows / ``exact_rows`` of them) are narrowed together, each round joining a row of bracket
    bounds per group to the data.
    """
    by = list(by)
    x = df.select(*by, F.col(column).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    sizes = x.groupBy(*by).agg(F.count("_x").alias("_n"))
    hot = sizes.where(F.col("_n") > exact_rows)

    def small(frame: DataFrame) -> DataFrame:
        quantiles = F.percentile(F.col("_x"), F.array(*map(F.lit, probs)))
        return frame.groupBy(*by).agg(quantiles.alias("_q")).select(
            *by, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])

    if hot.isEmpty():
        return small(x)
    hot = durable(hot)
    same = [F.col(f"r.{b}").eqNullSafe(F.col(f"k.{b}")) for b in by]
    condition = same[0]
    for part in same[1:]:
        condition = condition & part
    rest = small(x.alias("r").join(hot.alias("k"), condition, "left_anti"))
    place = [F.lit(float(p)) * (F.col("_n") - 1) for p in probs]
    state = hot.select(*by, "_n", *[
        c for j, h in enumerate(place) for i, rank in ((2 * j, F.floor(h)), (2 * j + 1, F.ceil(h))) for c in (
            rank.cast("long").alias(f"k{i}"), F.col("_n").alias(f"inside{i}"),
            F.lit(None).cast("double").alias(f"low{i}"), F.lit(None).cast("double").alias(f"high{i}"),
            F.lit(None).cast("double").alias(f"value{i}"))])
    values = _hot_group_values(x, by, durable(state), 2 * len(probs), exact_rows)
    return rest.unionByName(values.select(*by, *[
        (F.col(f"y{2 * j}") + (h - F.floor(h)) * (F.col(f"y{2 * j + 1}") - F.col(f"y{2 * j}"))).alias(name)
        for j, (h, name) in enumerate(zip(place, names))]))
