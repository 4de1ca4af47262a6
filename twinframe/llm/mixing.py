"""Mixing sources to target weights by iterative proportional fitting, with built-in functions only.

Tokens are summed into cells of source, language and topic. Each marginal's target shares are first
lowered to what the budget can take of each name, and the rest is raised in proportion. A cell carries its
three targets, so a round of raking is three window sums over the cells and nothing else; a cell's weight
ends each round no higher than the share at which its documents would be needed more than once. Rounds go
on until no weight moves. A document's probability is that of its cell, and a hash of its id decides, so a
rerun keeps the same documents.

The tables here carry no topic, so ``topic_of`` takes a coarse one from the form of a text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinframe.llm.common import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
# fixed values: what a text contains, by topic, the first that fits counts
TOPICS = {"legal": ("license", "copyright"), "contact": ("@",), "table": (" | ",)}
DIMENSIONS = ("source", "lang", "topic")
STEP, STEPS = 4, 16  # rounds between two looks at the weights, and looks at most
STILL = 1e-6  # a share of all tokens; weights that move less in a round have settled
ONE_TASK = 100_000  # so many cells are raked without a shuffle


def topic_of(text: Column) -> Column:
    found = F.lit("prose")
    for name, marks in reversed(TOPICS.items()):
        found = F.when(reduce(Column.__or__, [F.contains(F.lower(text), F.lit(m)) for m in marks]), name).otherwise(found)
    return F.coalesce(found, F.lit("prose"))


def _measured(df: DataFrame) -> DataFrame:
    """The table with its columns as ``of_0``, ``of_1``…, with ``tokens`` and the three dimensions; NULL counts as the empty name."""
    held = df.toDF(*[f"of_{at}" for at in range(len(df.columns))])
    given = lambda c: F.col(f"of_{df.columns.index(c)}")
    text = F.coalesce(given("text"), F.lit(""))
    name = lambda c: F.coalesce(given(c).cast("string"), F.lit(""))
    return held.withColumns({"tokens": F.regexp_count(text, F.lit(WORD)).cast("double"), "source": name("source"), "lang": name("lang"), "topic": topic_of(text)})


def _targets(cells: DataFrame, column: str, wanted: dict[str, float] | float, total: float, budget: float) -> DataFrame:
    """(column, t_column): shares that sum to 1 and that the budget can take.

    A number is the power of the present shares; a dict gives shares by name, and names it lacks
    divide what it leaves in proportion to their tokens. If it leaves nothing, they keep their present
    shares, and the dict divides the rest: no name is dropped. A name with too few tokens gets them all,
    and the others divide what it can't take. One row a name, so one task orders them.
    """
    everything = Window.partitionBy(F.lit(0))
    over = lambda value: F.coalesce(F.sum(value).over(everything), F.lit(0.0))
    share = lambda value, whole: F.when(whole > 0, value / whole).otherwise(0.0)
    now = cells.groupBy(column).agg((F.sum("tokens") / total).alias("now"))
    if isinstance(wanted, dict):
        given = F.lit(None).cast("double")
        for key, part in wanted.items():
            given = F.when(F.col(column) == key, part).otherwise(given)
        now = now.withColumn("given", given)
        unlisted = F.col("given").isNull()
        now = now.withColumns({"free": over(F.when(unlisted, F.col("now"))), "listed": over(F.when(~unlisted, F.col("now"))), "whole": over("given")})
        left = 1 - sum(wanted.values())
        divided = F.coalesce("given", share(F.col("now"), F.col("free")) * left)
        kept = F.coalesce(share(F.col("given"), F.col("whole")) * F.col("listed"), "now")
        raw = F.when(F.lit(left > 1e-9) | (F.col("free") == 0), divided).otherwise(kept)
    else:
        raw = F.pow("now", wanted)
    asked = now.withColumn("raw", raw).withColumn("asked", share(F.col("raw"), over("raw"))).withColumn("most", F.col("now") / budget)
    earlier = Window.partitionBy(F.lit(0)).orderBy("ratio", column).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda value: F.coalesce(F.sum(value).over(earlier), F.lit(0.0))
    level = lambda held, part: F.when(1 - part > 1e-12, (1 - held) / (1 - part)).otherwise(0.0)
    ranked = asked.withColumn("ratio", F.when(F.col("asked") > 0, F.col("most") / F.col("asked")).otherwise(float("inf")))
    ranked = ranked.withColumn("short", F.col("ratio") < level(before("most"), before("asked")))
    raised = level(over(F.when(F.col("short"), F.col("most"))), over(F.when(F.col("short"), F.col("asked"))))
    return ranked.withColumn("raised", raised).select(column, F.when(F.col("short"), F.col("most")).otherwise(F.col("asked") * F.col("raised")).alias(f"t_{column}"))


def raked(cells: DataFrame, targets: dict[str, dict[str, float] | float], budget: float) -> DataFrame:
    """Cells (source, lang, topic, tokens) with their targets ``t_…``, ``probability``, and ``w``, their share of what is drawn.

    ``budget`` is the wanted share of all tokens. Cells without tokens keep the probability 1. Targets that hold
    for each marginal alone may still contradict each other or the cells; ``reached_shares`` tells what is left.
    """
    total, size = cells.agg(F.sum("tokens"), F.count("*")).first()
    total, used = total or 1.0, [d for d in DIMENSIONS if d in targets]
    now = cells.withColumn("w", F.col("tokens") / total).withColumn("moved", F.lit(0.0))
    for d in used:
        now = now.join(_targets(cells, d, targets[d], total, budget), d)
    now, kept = cut_lineage(now), ", ".join([*DIMENSIONS, "tokens", *[f"t_{d}" for d in used]])
    spark, full = cells.sparkSession, float(total * budget)
    for _ in range(STEPS):
        if size <= ONE_TASK:
            now = now.coalesce(1)
        # one text for a step: a plan built column by column costs the driver more than the work
        rows = "(SELECT *, w AS last FROM {now})"
        for at in range(STEP):
            for d in used:
                held = f"sum(w) OVER (PARTITION BY {d})"
                rows = f"(SELECT {kept}, last, CASE WHEN {held} > 0 THEN w * t_{d} / {held} ELSE w END AS w FROM {rows})"
            last = "last" if at == STEP - 1 else f"least(w, tokens / {full!r}D) AS last"
            rows = f"(SELECT {kept}, {last}, least(w, tokens / {full!r}D) AS w FROM {rows})"
        now = spark.sql(f"SELECT {kept}, w, abs(w - last) AS moved FROM {rows}", now=now)
        now = cut_lineage(now)
        if (now.agg(F.max("moved")).first()[0] or 0.0) <= STILL:
            break
    chance = F.when(F.col("tokens") > 0, F.least(F.col("w") * total * budget / F.col("tokens"), F.lit(1.0))).otherwise(1.0)
    return now.withColumn("probability", chance).drop("moved")


def reached_shares(df: DataFrame, targets: dict[str, dict[str, float] | float], budget: float) -> DataFrame:
    """dimension, name, present, target, reached: token shares before, as aimed at after lowering, and as drawn."""
    cells = cut_lineage(raked(_cells(_measured(df.select("text", "source", "lang"))), targets, budget))
    parts = []
    for d in DIMENSIONS:
        if d in targets:
            expected = F.col("tokens") * F.col("probability")
            shares = cells.groupBy(F.lit(d).alias("dimension"), F.col(d).alias("name")).agg(F.sum("tokens").alias("present"), F.first(f"t_{d}").alias("target"), F.sum(expected).alias("reached"))
            whole = Window.partitionBy("dimension")
            part = lambda c: F.coalesce(F.try_divide(F.col(c), F.sum(c).over(whole)), F.lit(0.0)).alias(c)
            parts.append(shares.select("dimension", "name", part("present"), "target", part("reached")))
    return reduce(DataFrame.unionAll, parts)


def draw(column: str, seed: int) -> Column:
    """A number in 0..1 from the md5 of seed and id; the same for the same id."""
    text = F.md5(F.concat_ws("-", F.lit(str(seed)), F.coalesce(F.col(column).cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(text, 1, 8), 16, 10).cast("double") / 2**32


def _cells(measured: DataFrame) -> DataFrame:
    return cut_lineage(measured.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")))


def mixed_sample(df: DataFrame, targets: dict[str, dict[str, float] | float], budget: float, seed: int = 1) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability, sampled of every document.

    NULL source or language is a category of its own; a NULL or empty text has no tokens, the topic
    "prose" and its cell's probability (1 where the whole cell is empty). Repeated rows draw alike. A NULL id draws as
    one id. Other columns are ignored.
    """
    measured = cut_lineage(_measured(df.select("text", "doc_id", "source", "lang")).drop("of_0"))
    chances = cut_lineage(raked(_cells(measured), targets, budget).select(*DIMENSIONS, "probability"))
    return measured.join(chances, list(DIMENSIONS)).select(
        F.col("of_1").alias("doc_id"),
        F.col("of_2").alias("source"),
        F.col("of_3").alias("lang"),
        "topic",
        F.col("tokens").cast("long").alias("n_tokens"),
        F.round("probability", 8).alias("probability"),
        (draw("of_1", seed) < F.col("probability")).alias("sampled"),
    )


def mixed_documents(df: DataFrame, targets: dict[str, dict[str, float] | float], budget: float, seed: int = 1) -> DataFrame:
    """The sampled rows with all their columns, whatever their names. Texts are read twice and don't move unless the cells outgrow a broadcast."""
    measured = _measured(df)
    chances = cut_lineage(raked(_cells(_measured(df.select("text", "source", "lang"))), targets, budget).select(*DIMENSIONS, "probability"))
    drawn = measured.join(chances, list(DIMENSIONS)).where(draw(f"of_{df.columns.index('doc_id')}", seed) < F.col("probability"))
    return drawn.select(*[f"of_{at}" for at in range(len(df.columns))]).toDF(*df.columns)


def mixing_sql(targets: dict[str, dict[str, float] | float], budget: float, seed: int = 1) -> str:
    """The same over the view ``documents``; a recursive step is ``STEP`` rounds."""
    topic = "'prose'"
    for name, marks in reversed(TOPICS.items()):
        topic = f"CASE WHEN {' OR '.join(f'contains(lower(text), {m!r})' for m in marks)} THEN '{name}' ELSE {topic} END"
    steps = [
        f"""measured AS MATERIALIZED (SELECT doc_id, source, lang, coalesce(source, '') AS c_source, coalesce(lang, '') AS c_lang,
            coalesce({topic}, 'prose') AS c_topic, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::DOUBLE AS n FROM documents)""",
        "whole AS MATERIALIZED (SELECT CASE WHEN sum(n) > 0 THEN sum(n) ELSE 1 END AS total FROM measured)",
        "cells AS MATERIALIZED (SELECT c_source, c_lang, c_topic, sum(n) AS tokens, any_value(total) AS total FROM measured, whole GROUP BY ALL)",
    ]
    for d in DIMENSIONS:
        wanted = targets[d]
        if isinstance(wanted, dict):
            left = 1 - sum(wanted.values())
            given = "CASE " + " ".join(f"WHEN c_{d} = '{k}' THEN {v}" for k, v in wanted.items()) + " END"
            free, listed = "sum(CASE WHEN given IS NULL THEN now ELSE 0 END) OVER ()", "sum(CASE WHEN given IS NULL THEN 0 ELSE now END) OVER ()"
            divided, kept = f"coalesce(given, coalesce(now / nullif({free}, 0), 0) * {left!r})", f"coalesce(given / nullif(sum(given) OVER (), 0) * {listed}, now)"
            raw = divided if left > 1e-9 else f"CASE WHEN {free} = 0 THEN {divided} ELSE {kept} END"
        else:
            given, raw = "NULL", f"pow(now, {wanted})"
        level = "CASE WHEN 1 - {part} > 1e-12 THEN (1 - {held}) / (1 - {part}) ELSE 0 END"
        before = lambda c: f"coalesce(sum({c}) OVER (ORDER BY ratio, c_{d} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
        short = lambda c: f"coalesce(sum(CASE WHEN short THEN {c} END) OVER (), 0)"
        steps.append(
            f"""t_{d} AS MATERIALIZED (SELECT c_{d}, CASE WHEN short THEN most ELSE asked * {level.format(held=short("most"), part=short("asked"))} END AS t_{d} FROM
            (SELECT *, ratio < {level.format(held=before("most"), part=before("asked"))} AS short FROM
            (SELECT *, CASE WHEN asked > 0 THEN most / asked ELSE 'infinity'::DOUBLE END AS ratio FROM
            (SELECT c_{d}, now / {budget} AS most, coalesce(raw / nullif(sum(raw) OVER (), 0), 0) AS asked FROM (SELECT *, {raw} AS raw FROM
            (SELECT c_{d}, sum(tokens / total) AS now, {given} AS given FROM cells GROUP BY c_{d}))))))"""
        )
    rounds = "r"
    names = "step, c_source, c_lang, c_topic, tokens, total, " + ", ".join(f"t_{d}" for d in DIMENSIONS)
    for _ in range(STEP):
        rounds = f"(SELECT *, w AS last FROM {rounds})" if rounds == "r" else f"(SELECT * REPLACE (w AS last) FROM {rounds})"
        for d in DIMENSIONS:
            held = f"sum(w) OVER (PARTITION BY c_{d})"
            rounds = f"(SELECT {names}, last, CASE WHEN {held} > 0 THEN w * t_{d} / {held} ELSE w END AS w FROM {rounds})"
        rounds = f"(SELECT {names}, last, least(w, tokens / (total * {budget})) AS w FROM {rounds})"
    start = "SELECT 0 AS step, c_source, c_lang, c_topic, tokens, total, t_source, t_lang, t_topic, tokens / total AS w, 1e0 AS moved FROM cells"
    steps.append(
        f"""r AS ({start} JOIN t_source USING (c_source) JOIN t_lang USING (c_lang) JOIN t_topic USING (c_topic)
            UNION ALL SELECT {names.replace("step", "step + 1", 1)}, w, max(abs(w - last)) OVER () AS moved FROM {rounds.replace("FROM r)", f"FROM r WHERE step < {STEPS} AND moved > {STILL})")})"""
    )
    chance = f"CASE WHEN tokens > 0 THEN least(w * total * {budget} / tokens, 1) ELSE 1 END"
    drawn = f"('0x' || substr(md5('{seed}-' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296"
    return f"""WITH RECURSIVE {", ".join(steps)}, chances AS (SELECT c_source, c_lang, c_topic, {chance} AS p FROM r WHERE step = (SELECT max(step) FROM r))
        SELECT doc_id, source, lang, c_topic AS topic, n::BIGINT AS n_tokens, round(p, 8) AS probability, {drawn} < p AS sampled
        FROM measured JOIN chances USING (c_source, c_lang, c_topic)"""
