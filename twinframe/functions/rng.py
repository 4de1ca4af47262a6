"""Seeded draws as plain column expressions.

Every draw is a hash of (seed, row number, tag), so a row gets the same value whatever the
partitioning, and a recomputed task after an executor loss repeats it exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, row: Column, tag: str) -> Column:
    """A uniform double strictly between 0 and 1 from 52 bits of an MD5 digest."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), row.cast("string"), F.lit(tag)))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(2.0**52)


def standard_normal(seed: int, row: Column, tag: str) -> Column:
    """A standard normal double by the Box-Muller transform of two uniforms."""
    radius = F.sqrt(F.lit(-2.0) * F.log(uniform(seed, row, f"{tag}:a")))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(seed, row, f"{tag}:b"))


def vote_choice(classes: Column, draw: Column) -> Column:
    """Pick a class with probability votes / total from an array of votes.

    Classes are walked in first-seen order; NULL is a class like any other. Grouping equal
    votes together turns the walk over running weights into one array lookup.
    """
    grouped = F.flatten(
        F.transform(F.array_distinct(classes), lambda c: F.filter(classes, lambda v: v.eqNullSafe(c)))
    )
    place = F.ceil(draw * F.size(classes)).cast("int")
    return F.when(F.size(classes) > 0, F.get(grouped, F.greatest(place, F.lit(1)) - 1))


def weighted_choice(options: Column, draw: Column) -> Column:
    """Pick a value from an array of (value, weight) structs with probability weight / total.

    An empty array gives NULL, a zero total the first value.
    """
    weights = F.transform(options, lambda o: o["weight"].cast("double"))
    total = F.aggregate(weights, F.lit(0.0), lambda acc, w: acc + w)
    running = F.transform(
        options,
        lambda o, at: F.struct(
            o["value"].alias("value"),
            F.aggregate(F.slice(weights, 1, at + 1), F.lit(0.0), lambda acc, w: acc + w).alias("reach"),
        ),
    )
    hit = F.filter(running, lambda r: r["reach"] >= draw * total)
    return F.when(total == 0, F.get(options, F.lit(0))["value"]).otherwise(
        F.coalesce(F.get(hit, F.lit(0)), F.get(running, F.lit(0)))["value"]
    )
