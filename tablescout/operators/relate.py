"""Discovery of foreign keys between tables by value containment.

All candidate columns are compared in one shuffle.  Each column owns one bit; grouping the values
of all columns by value and OR-ing the bits tells which columns share that value.  Counting equal
bit patterns then gives every intersection size, so pairs are formed over a few patterns instead of
over the values.  The grouping combines map-side: a value that fills a third of a column still
reaches the shuffle once per task.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablescout.functions import name_similarity
from tablescout.session import durable

NAME_GATE = 0.6
CONFIDENCE = 0.8
# Weights of the signals, and the bonus for one-to-many edges.
NAME_WEIGHT, OVERLAP_WEIGHT, CARDINALITY_BONUS = 0.2, 0.4, 0.05
EMBEDDING_GATE = 0.85
_BITS = 62
#: Blocks of columns in which all others are compared with them.
_BLOCKS = 32

PAIR = ("from_dataset", "from_column", "to_dataset", "to_column")
#: Takes column pairs, gives the distinct values of both sides and in common.
Counter = Callable[[Sequence[tuple[str, str, str, str]]], DataFrame]


def _sides(catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    kept = ["dataset", "column", "semantic_type", "null_pct", "rows", "nulls", "distinct"]
    numeric = (F.col("kind") == "numeric").alias("is_numeric")
    base = catalog.select(*kept, numeric)
    return tuple(base.select(*[F.col(c).alias(f"{side}_{c}") for c in base.columns]) for side in ("from", "to"))


def _squeezed(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[_-]", "")


def _stem(name: Column) -> Column:
    return F.regexp_replace(_squeezed(name), "id", "")


def candidate_pairs(catalog: DataFrame, new: Sequence[str] | None = None) -> DataFrame:
    """Column pairs of different tables worth comparing, with their name similarity.

    Kept are pairs of similar names and pairs of keys, unless a column is more than 90 % empty, the
    kinds of values differ, or a measure is involved with a key or another measure.  With ``new``
    only pairs that touch one of those tables remain, and since stored tables hold keys as text, a key of
    theirs may also meet a number.  This runs over catalog rows, never data; the catalog is materialised so that profiling
    happens once.  All keys are compared with all keys, so columns are dealt into blocks, each of which
    meets the catalog in a task of its own.
    """
    left, right = _sides(durable(catalog))
    left = left.withColumn("_block", F.pmod(F.xxhash64("from_dataset", "from_column"), F.lit(_BLOCKS)))
    right = right.withColumn("_block", F.explode(F.array(*[F.lit(b).cast("long") for b in range(_BLOCKS)])))
    both = F.col("from_is_numeric") == F.col("to_is_numeric")
    if new is not None:
        stored = ~F.col("from_dataset").isin(*new) | ~F.col("to_dataset").isin(*new)
        both = both | stored & (F.col("from_semantic_type") == "key") & (F.col("to_semantic_type") == "key")
    touched = F.lit(True) if new is None else F.col("from_dataset").isin(*new) | F.col("to_dataset").isin(*new)
    same_block = left["_block"] == right["_block"]
    pairs = left.join(right, same_block & both & touched & (F.col("from_dataset") < F.col("to_dataset"))).drop("_block")
    pairs = pairs.where((F.col("from_null_pct") <= 90) & (F.col("to_null_pct") <= 90))
    a, b = F.col("from_semantic_type"), F.col("to_semantic_type")
    measures = (a == "measure") & b.isin("measure", "key") | (a == "key") & (b == "measure")
    pairs = pairs.where(~measures)
    keys = (a == "key") & (b == "key")
    # Names of very different length cannot be similar; the others are scored once per pair of names.
    likely = keys
    for form in (_squeezed, _stem):
        x, y = (F.length(form(F.col(f"{s}_column"))) for s in ("from", "to"))
        likely = likely | (2.0 * F.least(x, y) >= NAME_GATE * (x + y))
    pairs = pairs.where(likely)
    names = pairs.select("from_column", "to_column").distinct().withColumn("name_similarity", name_similarity("from_column", "to_column"))
    scored = pairs.join(names, ["from_column", "to_column"])
    return scored.where((F.col("name_similarity") >= NAME_GATE) | keys).select(
        *PAIR, "name_similarity", keys.alias("both_keys"),
        *[f"{s}_{c}" for s in ("from", "to") for c in ("rows", "nulls", "distinct")])


def canonical_text(column: Column, kind: T.DataType) -> Column:
    """One text per value whatever the type of its column: a whole decimal or double reads as the integer."""
    text = column.cast("string")
    if isinstance(kind, T.DecimalType) and kind.scale > 0:
        return F.regexp_replace(text, r"\.?0+$", "")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (column == F.floor(column)) & (F.abs(column) < 1e15)
        return F.when(whole, column.cast("double").cast("decimal(20,0)").cast("string")).otherwise(text)
    return text


def value_patterns(tables: Mapping[str, DataFrame], columns: Sequence[tuple[str, str]],
                   pairs: Sequence[tuple[str, str, str, str]] = ()) -> DataFrame:
    """Distinct values counted by the set of columns they occur in (``bits0``.., ``n_values``).

    Columns of whole numbers that are only compared with each other are grouped as numbers, which is much
    cheaper; all others meet as canonical text.
    """
    words = (len(columns) + _BITS - 1) // _BITS

    def masks(index: int) -> list[Column]:
        return [F.lit(1 << (index % _BITS) if w == index // _BITS else 0).cast("long").alias(f"bits{w}") for w in range(words)]

    names = [f"bits{w}" for w in range(words)]
    kinds = {(d, c): tables[d].schema[c].dataType for d, c in columns}

    def grouped(chosen: Sequence[int], as_text: bool) -> DataFrame:
        frames = []
        for dataset in dict.fromkeys(columns[i][0] for i in chosen):
            cells = []
            for i in (i for i in chosen if columns[i][0] == dataset):
                cell = F.col(f"`{columns[i][1]}`")
                value = canonical_text(cell, kinds[columns[i]]) if as_text else cell.cast("long")
                cells.append(F.struct(value.alias("value"), *masks(i)))
            frames.append(tables[dataset].select(F.inline(F.array(*cells))).where("value is not null"))
        return reduce(DataFrame.unionAll, frames).groupBy("value").agg(*[F.bit_or(n).alias(n) for n in names]).select(*names)

    # Text spreads along the pairs: whatever meets a column that is read as text is read as text too.
    text = {c for c in columns if not isinstance(kinds[c], T.IntegralType)}
    while more := {x for p in pairs for a, b in [((p[0], p[1]), (p[2], p[3]))] for x, y in ((a, b), (b, a)) if y in text and x not in text}:
        text |= more
    whole = [i for i, c in enumerate(columns) if c not in text]
    rest = [i for i, c in enumerate(columns) if c in text]
    parts = [grouped(chosen, as_text) for chosen, as_text in ((whole, False), (rest, True)) if chosen]
    return reduce(DataFrame.unionAll, parts).groupBy(*names).agg(F.count(F.lit(1)).alias("n_values"))


def overlap_counts(tables: Mapping[str, DataFrame], pairs: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """Distinct values per side and in common, for many column pairs in one pass over the tables.

    The patterns are few; each adds its values to the wanted pairs that it holds, and to no others.
    """
    columns = list(dict.fromkeys(c for p in pairs for c in ((p[0], p[1]), (p[2], p[3]))))
    place = {c: i for i, c in enumerate(columns)}
    patterns = value_patterns(tables, columns, pairs)
    spark = patterns.sparkSession

    def has(i: Column) -> Column:
        words = F.array(*[F.col(c) for c in patterns.columns if c.startswith("bits")])
        return F.getbit(F.element_at(words, (F.floor(i / _BITS) + 1).cast("int")), i % _BITS) == 1

    wanted = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip((*PAIR, "a", "b"), (*p, place[p[0], p[1]], place[p[2], p[3]]))]) for p in pairs])
    in_a, in_b = has(F.col("w.a")), has(F.col("w.b"))
    cells = (patterns.withColumn("w", F.explode(F.filter(wanted, lambda w: has(w["a"]) | has(w["b"]))))
             .groupBy(*[F.col(f"w.{n}").alias(n) for n in PAIR])
             .agg(F.sum(F.when(in_a, F.col("n_values")).otherwise(0)).alias("from_values"),
                  F.sum(F.when(in_b, F.col("n_values")).otherwise(0)).alias("to_values"),
                  F.sum(F.when(in_a & in_b, F.col("n_values")).otherwise(0)).alias("common_values")))
    every = spark.createDataFrame([tuple(p) for p in pairs], ", ".join(f"{n} string" for n in PAIR))
    counts = ("from_values", "to_values", "common_values")
    return every.join(cells, list(PAIR), "left").select(*PAIR, *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def relationship_type(from_unique: Column, to_unique: Column) -> Column:
    return (F.when(from_unique & to_unique, "one-to-one").when(to_unique, "many-to-one")
            .when(from_unique, "one-to-many").otherwise("many-to-many"))


def join_strategy(match_pct: Column) -> Column:
    return F.when(match_pct >= 95, "inner").otherwise("left")


def confidence(name: Column, overlap: Column, kind: Column) -> Column:
    """Weighted mean of the signals at hand, plus the bonus for one-to-many edges, at most 1.

    A pair whose names differ is judged by overlap alone.
    """
    by_name = name >= NAME_GATE
    total = F.when(by_name, NAME_WEIGHT * name + OVERLAP_WEIGHT * overlap).otherwise(OVERLAP_WEIGHT * overlap)
    weight = F.when(by_name, NAME_WEIGHT + OVERLAP_WEIGHT).otherwise(OVERLAP_WEIGHT)
    bonus = F.when(kind.isin("one-to-many", "many-to-one"), CARDINALITY_BONUS).otherwise(0.0)
    return F.least(F.lit(1.0), total / weight + bonus)


def measured_pairs(tables: Mapping[str, DataFrame], pairs: DataFrame, counted_by: Counter | None = None) -> DataFrame:
    """Containment in both directions, uniqueness of both sides, cardinality and join strategy.

    ``counted_by`` counts the values of column pairs in place of reading ``tables``, such as a stored index does.
    """
    pairs = durable(pairs)
    keys = [tuple(r) for r in pairs.select(*PAIR).collect()]
    if not keys:
        empty = T.StructType([T.StructField(n, T.LongType()) for n in ("from_values", "to_values", "common_values")])
        counted = pairs.select(*PAIR).join(
            pairs.sparkSession.createDataFrame([], empty), F.lit(False), "left")
    else:
        counted = counted_by(keys) if counted_by is not None else overlap_counts(tables, keys)
    out = pairs.join(counted, list(PAIR), "left").fillna(0, ["from_values", "to_values", "common_values"])
    pct = {s: F.coalesce(F.try_divide(F.col("common_values") * 100.0, F.col(f"{s}_values")), F.lit(0.0)) for s in ("from", "to")}
    unique = {s: (F.col(f"{s}_values") == F.col(f"{s}_rows")) & (F.col(f"{s}_rows") > 0) for s in ("from", "to")}
    return (out.withColumns({"match_pct": pct["from"], "reverse_pct": pct["to"],
                             "from_unique": unique["from"], "to_unique": unique["to"]})
            .withColumn("relationship_type", relationship_type(F.col("from_unique"), F.col("to_unique")))
            .withColumn("join_strategy", join_strategy(F.col("match_pct"))))


def oriented(measured: DataFrame) -> DataFrame:
    """Turn every pair so that it points from the child to its unique parent."""
    turn = F.when(F.col("to_unique") & ~F.col("from_unique"), F.lit(False)) \
            .when(F.col("from_unique") & ~F.col("to_unique"), F.lit(True)) \
            .otherwise(F.col("reverse_pct") > F.col("match_pct"))

    def side(column: str) -> Column:
        here, there = (f"from_{column}", f"to_{column}")
        return F.when(turn, F.col(there)).otherwise(F.col(here)).alias(here)

    def other(column: str) -> Column:
        here, there = (f"to_{column}", f"from_{column}")
        return F.when(turn, F.col(there)).otherwise(F.col(here)).alias(here)

    fields = ("dataset", "column", "values", "rows", "unique")
    out = measured.select(
        *[side(c) for c in fields], *[other(c) for c in fields], "name_similarity", "both_keys", "common_values",
        F.when(turn, F.col("reverse_pct")).otherwise(F.col("match_pct")).alias("match_pct"),
        F.when(turn, F.col("match_pct")).otherwise(F.col("reverse_pct")).alias("parent_coverage_pct"))
    return (out.withColumn("relationship_type", relationship_type(F.col("from_unique"), F.col("to_unique")))
            .withColumn("join_strategy", join_strategy(F.col("match_pct"))))


def judged(edges: DataFrame, threshold: float = CONFIDENCE, min_coverage: float = 90.0) -> DataFrame:
    """Confidence and verdict of oriented edges, with the reason for each rejection.

    Small dense integer keys are contained in each other by accident, so overlap alone is not
    enough: the parent must be unique, a parent with an unrelated name must be covered almost
    completely, two primary keys need equal names or a parent covered by half, and each child keeps
    only its best parent (name similarity, then coverage).
    """
    scored = edges.withColumn("confidence", confidence(
        F.col("name_similarity"), F.col("match_pct") / 100, F.col("relationship_type")))
    named = F.col("name_similarity") >= NAME_GATE
    coverage = F.col("parent_coverage_pct")
    reason = (F.when(~F.col("to_unique"), "parent not unique")
              .when(F.col("confidence") < threshold, "low confidence")
              .when(~named & (coverage < min_coverage), "unrelated name, parent barely covered")
              .when(F.col("from_unique") & (F.col("name_similarity") < 0.9) & (coverage < 50), "two keys of different things"))
    scored = scored.withColumn("reason", reason)
    w = Window.partitionBy("from_dataset", "from_column").orderBy(
        F.col("reason").isNotNull().cast("int"), F.desc("name_similarity"), F.desc("parent_coverage_pct"), "to_dataset", "to_column")
    ranked = scored.withColumn("_rank", F.row_number().over(w))
    reason = F.coalesce("reason", F.when(F.col("_rank") > 1, "better parent found"))
    return ranked.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull()).drop("_rank")


def detect_relationships(
    tables: Mapping[str, DataFrame], catalog: DataFrame, existing: Mapping[str, DataFrame] | None = None,
    threshold: float = CONFIDENCE, all_pairs: bool = False, counted_by: Counter | None = None,
) -> DataFrame:
    """Foreign-key edges over ``tables``; with ``existing`` only edges that touch a new table.

    ``catalog`` holds the column rows of all tables.  ``all_pairs`` also returns what was rejected.  With ``counted_by``, the
    counts of a value index, no table is read, and only edges that touch one of ``tables`` are looked for.
    """
    everything = {**(existing or {}), **tables}
    pairs = candidate_pairs(catalog, new=list(tables) if existing or counted_by is not None else None)
    edges = judged(oriented(measured_pairs(everything, pairs, counted_by)), threshold)
    return edges if all_pairs else edges.where("accepted")


def merge_candidates(by_name: DataFrame, by_other: DataFrame, other_score: str) -> DataFrame:
    """Candidates of two methods by their column pair, each keeping the scores it has."""
    return by_name.select(*PAIR, "name_similarity").join(
        by_other.select(*PAIR, other_score), list(PAIR), "full_outer")


def embedding_candidates(columns: DataFrame, threshold: float = EMBEDDING_GATE) -> DataFrame:
    """Columns of different tables with similar vectors; a key on either side adds 0.05.

    ``columns``: ``dataset``, ``column``, ``semantic_type``, ``embedding``.
    """
    from tablescout.operators.similarity import similar_pairs

    keyed = columns.withColumn("_id", F.concat_ws(".", "dataset", "column"))
    # The columns meet what is known of them before they are paired: there are far fewer of them than of pairs.
    about = keyed.select("_id", "dataset", "column", "semantic_type")
    known = keyed.select("_id", "embedding").where("embedding is not null").join(about, "_id")
    out = similar_pairs(known, "_id", "embedding", threshold, carry=("dataset", "column", "semantic_type"))
    out = out.where("left_dataset <> right_dataset")
    key = (F.col("left_semantic_type") == "key") | (F.col("right_semantic_type") == "key")
    score = F.least(F.lit(1.0), F.col("similarity") + F.when(key, 0.05).otherwise(0.0))
    first = F.col("left_dataset") < F.col("right_dataset")

    def pick(name: str, yes: str, no: str) -> Column:
        return F.when(first, F.col(yes)).otherwise(F.col(no)).alias(name)

    return out.select(
        pick("from_dataset", "left_dataset", "right_dataset"), pick("from_column", "left_column", "right_column"),
        pick("to_dataset", "right_dataset", "left_dataset"), pick("to_column", "right_column", "left_column"),
        score.alias("embedding_similarity"))


def lookup_edges(edges: DataFrame, datasets: Sequence[str], min_confidence: float = CONFIDENCE) -> DataFrame:
    return edges.where(F.col("from_dataset").isin(*datasets) & F.col("to_dataset").isin(*datasets)
                       & (F.col("confidence") >= min_confidence))
