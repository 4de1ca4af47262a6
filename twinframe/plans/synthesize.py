"""Synthetic tables by smoothed bootstrap with neighbour voting."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinframe.functions.cells import decimal_places, is_numeric_type, round_half_up, round_to_places, valid_number
from twinframe.functions.rng import standard_normal, uniform, vote_choice
from twinframe.operators.moments import NumberStats, stat_fields, steady_stats
from twinframe.operators.neighbours import classes_of, feature_arrays, nearest_neighbours
from twinframe.operators.profile import distinct_sketch, surely_many
from twinframe.operators.ranges import with_row_index
from twinframe.sources.csv import ROW_INDEX

# Fixed value: noise in units of a column's deviation.
NOISE_FACTOR = 0.05

# The source's columns carry this prefix while other columns (index, features, neighbours) stand beside them.
OWN = "of_"


@dataclass(frozen=True)
class Facts:
    """What the driver knows about the original table: one entry per column and the row count."""

    columns: list[str]
    numeric: list[str]
    categorical: list[str]
    stats: dict[str, NumberStats]
    precision: dict[str, int]
    rows: int


def table_facts(df: DataFrame, columns: list[str], numeric: list[str] | None = None) -> Facts:
    """Column kinds, statistics, decimal places and row count, from one scan as a rule.

    ``numeric`` names the numerical columns when a profile has settled them already.
    """
    fields = [df.schema[c] for c in columns if is_numeric_type(df.schema[c].dataType)]
    facts = [
        F.struct(
            *stat_fields(df, f.name),
            distinct_sketch(f).alias("distinct"),
            F.max(decimal_places(valid_number(f.name, f.dataType))).alias("places"),
        ).alias(f"c{at}")
        for at, f in enumerate(fields)
    ]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *facts).first()
    found = {f.name: row[f"c{at}"] for at, f in enumerate(fields)}
    many = numeric
    if many is None:
        many = surely_many(df, {name: fact["distinct"] for name, fact in found.items()})
    numeric = [c for c in columns if c in many]
    return Facts(
        columns,
        numeric,
        [c for c in columns if c not in many],
        {c: steady_stats(found[c]) for c in numeric},
        {c: found[c]["places"] or 0 for c in numeric},
        row["rows"],
    )


def bootstrap_rows(indexed: DataFrame, rows: int, target_size: int, seed: int) -> DataFrame:
    """Draw rows with replacement: row ``i`` copies the original at floor(u * rows)."""
    draws = indexed.sparkSession.range(target_size).select(
        F.col("id").alias("i"), F.floor(uniform(seed, F.col("id"), "base") * rows).alias(ROW_INDEX)
    )
    return draws.join(indexed, ROW_INDEX)


def jittered(base: Column, name: str, stats: NumberStats, places: int, seed: int) -> Column:
    """One synthetic number: imputed, moved by 5% noise, kept in range, rounded as the source."""
    base = F.coalesce(base, F.lit(stats.mean))
    if not stats.std > 0:
        return base
    moved = base + F.lit(stats.std * NOISE_FACTOR) * standard_normal(seed, F.col("i"), name)
    kept = F.greatest(F.lit(float(stats.min)), F.least(F.lit(float(stats.max)), moved))
    rounded = round_half_up(kept) if stats.is_integer else round_to_places(kept, places)
    return F.when(F.isnan(moved), base).otherwise(rounded)


def synthetic_numbers(bases: DataFrame, facts: Facts, seed: int) -> DataFrame:
    """Replace every numeric column of bootstrapped rows by its jittered value."""
    made = {
        c: jittered(
            valid_number(c, bases.schema[c].dataType), c.removeprefix(OWN), facts.stats[c], facts.precision[c], seed
        )
        for c in facts.numeric
    }
    return bases.select(*[made[c].alias(c) if c in made else F.col(f"`{c}`") for c in bases.columns])


def indexed_features(df: DataFrame, facts: Facts, order_by: list[str]) -> DataFrame:
    """The original rows with their index, z-scores and category texts."""
    indexed = df if ROW_INDEX in df.columns else with_row_index(df.select(*dict.fromkeys([*order_by, *facts.columns])), order_by)
    z, cats = feature_arrays(indexed, facts.numeric, facts.categorical, facts.stats)
    return indexed.select(ROW_INDEX, *[F.col(f"`{c}`") for c in facts.columns], z.alias("z"), cats.alias("cats"))


def synthetic_seeds(features: DataFrame, facts: Facts, target_size: int, seed: int) -> DataFrame:
    """Synthetic numbers, their z-scores, and the seed row's categories."""
    numbers = synthetic_numbers(bootstrap_rows(features, facts.rows, target_size, seed), facts, seed)
    z, _ = feature_arrays(numbers, facts.numeric, [], facts.stats)
    return numbers.withColumn("z", z)


def with_neighbours(
    df: DataFrame, facts: Facts, target_size: int, seed: int, order_by: list[str], **search: object
) -> DataFrame:
    features = indexed_features(df, facts, order_by)
    seeds = synthetic_seeds(features, facts, target_size, seed)
    return nearest_neighbours(
        seeds, target_size, features.select(ROW_INDEX, "z", "cats"), len(facts.numeric), len(facts.categorical), **search
    )


def synthesize(
    df: DataFrame,
    target_size: int,
    seed: int,
    order_by: list[str],
    columns: list[str] | None = None,
    keep_row: bool = False,
    numeric: list[str] | None = None,
    **search: object,
) -> DataFrame:
    """A synthetic table of exactly ``target_size`` rows with the source's columns and order.

    ``order_by`` is a unique key giving the original row order (ignored when the table already
    carries ``row_idx``, as CSV imports do; a ``row_idx`` named in ``columns`` is data like any other). ``numeric`` fixes which columns are numerical; by
    default that is settled by type and distinct count. The same seed gives the same rows under any
    partitioning. ``keep_row`` also returns the row number ``i``. Further arguments go to
    ``nearest_neighbours``.
    """
    indexed = ROW_INDEX in df.columns and ROW_INDEX not in (columns or [])
    columns = columns or [c for c in df.columns if c != ROW_INDEX]
    kinds = {f.name: f.dataType for f in df.schema}
    kept = dict.fromkeys([*columns, *([] if indexed else order_by)])
    # whatever the columns are called, they can't be taken for the library's own
    own = df.select(*([ROW_INDEX] if indexed else []), *[F.col(f"`{c}`").alias(OWN + c) for c in kept])
    names, order_by = [OWN + c for c in columns], [OWN + c for c in order_by]
    facts = table_facts(own, names, None if numeric is None else [OWN + c for c in numeric])
    if facts.rows == 0:
        empty = df.select(F.lit(0).cast("bigint").alias("i"), *[F.col(f"`{c}`") for c in columns])
        return empty if keep_row else empty.drop("i")
    if not facts.categorical:
        found = synthetic_seeds(indexed_features(own, facts, order_by), facts, target_size, seed)
        made = {}
    elif not facts.numeric and len(facts.categorical) == 1:
        # a lone categorical column has nothing to measure distance by: copy the seed row
        found = bootstrap_rows(indexed_features(own, facts, order_by), facts.rows, target_size, seed)
        made = {}
    else:
        found = with_neighbours(own, facts, target_size, seed, order_by, **search)
        made = {
            c: vote_choice(classes_of(t), uniform(seed, F.col("i"), f"{c.removeprefix(OWN)}:pick"))
            for t, c in enumerate(facts.categorical)
        }
    # the original is numbered and noised as double; integer columns return to their own type
    picked = [made.get(OWN + c, F.col(f"`{OWN + c}`")).cast(kinds[c]).alias(c) for c in columns]
    return found.select(*(["i"] if keep_row else []), *picked)
