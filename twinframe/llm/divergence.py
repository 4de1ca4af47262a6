"""How sources of one language differ in their words, from products of one-hot level matrices.

Every document's terms are counted by language and source. A kept term's count in a source is its
level there, and a level has a price. For two sources all that matters is how many terms have level a
in one and level b in the other: their joint table. Take the matrix with a row for each term and a column
for each (source, level) that occurs; a row has a one for its level in each source. This matrix, transposed,
times itself holds the joint tables of all pairs of sources.

The product is taken in blocks of terms and of sources, in whole numbers, without the columns of level 0,
which follow from the others: the product's diagonal says how many terms have a level at all. Blocks of a
pair of sources are priced on their own and added up. So no task holds more than ``TERMS`` terms of
twice ``SOURCES`` sources, whatever term, source or language is common.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinframe.llm.common import Batches, cut_lineage, slices, strings

LEAST_DOCUMENTS = 10
UNIT = 10**9  # the price of all occurrences together
TOP = 10
TERMS, SOURCES = 4096, 64  # in a block
ROWS_AT_ONCE = 256  # terms whose pairs of columns are listed together
HELD = 300_000  # counts kept in a task before they are handed over

# A-Z become small; what can't be in a term becomes a space
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _counted(batches: Batches) -> Batches:
    """Occurrences and documents by language, source and term, as far as the task has come when its table is full."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def flush() -> Batches:
        for (lang, source), (times, documents) in held.items():
            columns = [[lang] * len(times), [source] * len(times), [t.decode() for t in times], list(times.values()), [documents[t] for t in times]]
            kinds = [pa.string()] * 3 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "source", "term", "n", "documents"])
        held.clear()

    for batch in slices(batches):
        for lang, source, text in zip(strings(batch, "lang"), strings(batch, "source"), strings(batch, "text")):
            terms = text.encode().translate(_TERM_BYTES).split()
            times, documents = held[lang, source]
            times.update(terms)
            documents.update(set(terms))
        if sum(len(times) for times, _ in held.values()) > HELD:
            yield from flush()
    yield from flush()


def term_counts(documents: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, id, n, sources): terms of at least ``least`` documents of a language, their occurrences in all and by source.

    Written once; ``id`` numbers the rows.
    """
    found = documents.mapInArrow(_counted, "lang string, source string, term string, n long, documents long")
    # tasks hand over sums already; one shuffle by term serves both steps
    by_source = found.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    terms = by_source.groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("sources"))
    return cut_lineage(terms.where(F.col("documents") >= least).select("lang", "term", F.monotonically_increasing_id().alias("id"), "n", "sources"))


def _groups(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, place, total, kept, lang_total, sources): every group, its place in its language and what prices need."""
    in_source = terms.select("lang", F.explode("sources").alias("s")).groupBy("lang", F.col("s.source").alias("source")).agg(F.sum("s.n").alias("total"))
    in_lang = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
    every = documents.select("lang", "source").distinct()
    every = every.join(in_source, ["lang", "source"], "left").join(in_lang, "lang", "left").na.fill(0, ["total", "kept", "lang_total"])
    every = every.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    return cut_lineage(every.join(every.groupBy("lang").agg(F.count("*").alias("sources")), "lang"))


def prices(counts: list[int], totals: list[int], kept: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 2) / (total + 2 * kept)), in whole numbers of any size."""
    return np.array([1 + UNIT * (c + 2) // (t + 2 * kept) for c, t in zip(counts, totals)], dtype=np.int64)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def one_hot_product(left: np.ndarray, right: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The product of two one-hot matrices, the first transposed, as (left column, right column, count).

    A row gives for each source the column that holds its one, or -1. Rows are taken a few at a time, and
    their products are added up.
    """
    code, count = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for start in range(0, len(left), ROWS_AT_ONCE):
        a, b = left[start : start + ROWS_AT_ONCE, :, None], right[start : start + ROWS_AT_ONCE, None, :]
        new, times = np.unique((a * columns + b)[(a >= 0) & (b >= 0)], return_counts=True)
        code, where = np.unique(np.concatenate([code, new]), return_inverse=True)
        count = np.bincount(where, weights=np.concatenate([count, times]), minlength=len(code)).astype(np.int64)
    return code // columns, code % columns, count


def _block(key: tuple, rows: pa.Table) -> pa.Table:
    """What one block of terms adds to the value of each pair of sources, the first in block ``lo``, the second in ``hi``.

    Rows without an id introduce the sources of both blocks.
    """
    lang, lo, hi, part = (k.as_py() for k in key)
    source_of = {}
    for row in rows.filter(pa.compute.is_null(rows["id"])).to_pylist():
        source_of[row["place"]] = row
    places = sorted(source_of)
    kept = source_of[places[0]]["kept"]
    names = {"lang": [], "a": [], "b": [], "value": []}
    first = [p for p in places if p // SOURCES == lo]
    second = [p for p in places if p // SOURCES == hi]
    value = np.zeros((len(first), len(second)), dtype=np.int64)
    if kept:
        used = rows.filter(pa.compute.is_valid(rows["id"]))
        ids, place, n = (used[c].to_numpy() for c in ("id", "place", "n"))
        # columns: the levels that occur, by source
        levels, column = np.unique(np.stack([place, n], axis=1).reshape(-1, 2), axis=0, return_inverse=True)
        price = prices(levels[:, 1].tolist(), [source_of[p]["total"] for p in levels[:, 0].tolist()], kept)
        zero = {p: x for p, x in zip(places, prices([0] * len(places), [source_of[p]["total"] for p in places], kept).tolist())}
        of_first, of_second = np.array([zero[p] for p in first]), np.array([zero[p] for p in second])
        none = distance(of_first[:, None], of_second[None, :])
        if part == 0:
            value += kept * none
        _, term = np.unique(ids, return_inverse=True)
        sides = []
        for wanted in (first, second):
            at = np.searchsorted(wanted, place) % max(1, len(wanted))
            mine = np.array(wanted)[at] == place
            ones = np.full((int(term.max(initial=-1)) + 1, len(wanted)), -1, dtype=np.int64)
            ones[term[mine], at[mine]] = column.ravel()[mine]
            sides.append(ones)
        # terms that one source has and the other may lack: the diagonal of the product
        times = np.bincount(column.ravel(), minlength=len(levels))
        for x, (p, m) in enumerate(zip(price.tolist(), times.tolist())):
            own = int(levels[x, 0])
            if own // SOURCES == lo:
                i = first.index(own)
                value[i] += m * (distance(np.int64(p), of_second) - none[i])
            if own // SOURCES == hi:
                j = second.index(own)
                value[:, j] += m * (distance(of_first, np.int64(p)) - none[:, j])
        # terms that both have
        a, b, m = one_hot_product(*sides, max(1, len(levels)))
        i, j = np.searchsorted(first, levels[a, 0]), np.searchsorted(second, levels[b, 0])
        p, q, p0, q0 = price[a], price[b], of_first[i], of_second[j]
        np.add.at(value, (i, j), m * (distance(p, q) - distance(p, q0) - distance(p0, q) + distance(p0, q0)))
    for i, j in np.argwhere(np.array(first)[:, None] < np.array(second)[None, :]).tolist():
        names["lang"].append(lang)
        names["a"].append(source_of[first[i]]["source"])
        names["b"].append(source_of[second[j]]["source"])
        names["value"].append(int(value[i, j]))
    return pa.table([pa.array(names[c], t) for c, t in zip(names, (pa.string(), pa.string(), pa.string(), pa.int64()))], names=list(names))


def _pairs(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language."""
    blocks = F.ceil(F.col("sources") / SOURCES)
    parts = F.greatest(F.lit(1), F.ceil(F.col("kept") / TERMS))

    def paired(rows: DataFrame) -> DataFrame:
        """Each row for every pair of blocks that its source's block is in."""
        own = F.floor(F.col("place") / SOURCES)
        return rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
            "lang", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "part", "id", "place", "n", "total", "kept", "source"
        )

    sized = groups.withColumn("blocks", blocks).withColumn("parts", parts)
    # a column that names its source is enough for a term; figures come with the rows that introduce a source
    entries = terms.select("lang", "id", F.explode("sources").alias("s")).select("lang", "id", F.col("s.source").alias("source"), F.col("s.n").alias("n"))
    entries = entries.join(sized.select("lang", "source", "place", "blocks", "parts"), ["lang", "source"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    null = lambda kind: F.lit(None).cast(kind)
    entries = entries.withColumn("total", null("long")).withColumn("kept", null("long")).withColumn("source", null("string"))
    heads = sized.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("id", null("long")).withColumn("n", null("long"))
    rows = paired(heads).unionByName(paired(entries))
    priced = rows.groupBy("lang", "lo", "hi", "part").applyInArrow(_block, "lang string, a string, b string, value long")
    values = cut_lineage(priced.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    one = values.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")
    return one.unionAll(values.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))


def _terms_of(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of the terms that a group has more of than its language."""
    rows = terms.select("lang", "term", F.col("n").alias("lang_n"), F.explode("sources").alias("s"))
    rows = rows.select("lang", "term", "lang_n", F.col("s.source").alias("source"), F.col("s.n").alias("n")).join(groups, ["lang", "source"])
    price = lambda n, total: F.expr(f"1 + cast({n} + 2 as decimal(20, 0)) * {UNIT} div ({total} + 2 * kept)")
    priced = rows.withColumn("p", price("n", "total")).withColumn("q", price("lang_n", "lang_total")).where("p > q")
    return priced.select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))


def source_divergence(df: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: the distance of each source to every other of its language
    (part ``pair``), and the ``top`` terms that set it off from its language (part ``term``).

    Terms are runs of letters, A-Z made small; a language keeps those of at least ``least`` of its documents.
    A count c of N kept occurrences has the price 1 + floor(10^9 (c + 2) / (N + 2 V)), V kept terms; the distance
    of two prices is floor((p - q)^2 / (p + q)), and that of two sources its sum over all kept terms, 0 if there are
    none. Ranks go by value, the largest first, then by the item's bytes. NULL text, language or source counts as
    empty. Repeated rows are documents of their own; a source without terms is compared too; an empty table gives
    no rows. Other columns are ignored. Every pair of a language's sources is a row of the result, as asked.
    """
    documents = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    terms = term_counts(documents, least)
    groups = _groups(documents, terms)
    ranked = []
    for part, rows, most in (("pair", _pairs(terms, groups), None), ("term", _terms_of(terms, groups), top)):
        by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
        found = rows.withColumn("rank", F.row_number().over(by))
        found = found if most is None else found.where(F.col("rank") <= most)
        ranked.append(found.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank"))
    return ranked[0].unionAll(ranked[1])


def divergence_sql(least: int = LEAST_DOCUMENTS, top: int = TOP) -> str:
    """The same over the view ``documents``, term by term."""
    big, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    price = lambda n, total: f"1 + {UNIT}::HUGEINT * ({n} + 2) // ({total} + 2 * v)"
    return f"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            translate(coalesce(text, ''), '{big}', '{small}') AS text FROM documents),
        words AS MATERIALIZED (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
        kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT r) >= {least}),
        vocabulary AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY ALL),
        groups AS (SELECT DISTINCT lang, source FROM docs),
        own AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        every AS (SELECT lang, source, term, coalesce(own.n, 0) AS n, kept.n AS lang_n, v, total AS lang_total
            FROM groups JOIN kept USING (lang) JOIN vocabulary USING (lang) LEFT JOIN own USING (lang, source, term)),
        priced AS MATERIALIZED (SELECT lang, source, term, n, {price("n", "sum(n) OVER (PARTITION BY lang, source)")} AS p, {price("lang_n", "lang_total")} AS q FROM every),
        pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
            FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
            UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM priced WHERE n > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {top}"""
