"""Near-duplicate documents: an inverted join over signature coordinates, confirmed on full sets.

A document's set of word shingles gives a signature of minima, one per hash function. Equal
sets are one class from the start. Every class posts itself under its (coordinate, value)
pairs. Two sets with the wanted similarity agree in at least ``matches`` coordinates (with a
chance of about 1e-8 to fail at the limit itself), so with the pairs ordered from rare to common
they share one of the first ``coordinates - matches + 1``; values that only one class has take
places in that prefix and need no posting. Lists with the same members are looked at once.

Links are found in two steps. First every class is compared with the one list leader it agrees
with most; leaders are the members that share most coordinates with others, such as the original
of many edited copies. Then only lists that still hold several components are merged in blocks,
counting agreeing coordinates and skipping pairs of one component, of too different size, or
with too many shingles that no other candidate has; what is left must also agree in a longer
signature, and is put out by the first list that both members share. Every candidate is
confirmed on the full sets. No list is capped, and no list is gathered whole: blocks have a fixed size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.llm.common import cut_lineage, per_batch, strings
from twinframe.llm.components import components
from twinframe.llm.shingles import Words, intersection, set_digest, shingle_set, word_numbers

COORDINATES = 64
MATCHES = 30  # a binomial(64, 0.8) count falls below it with a chance under 1e-8
WIDE = 512  # coordinates of the longer signature that members of open lists get, a byte each
WIDE_SLACK = 6.0  # standard deviations that its count may fall short of the wanted similarity
BLOCK = 1024  # members of a list compared in one task


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    odd = rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, rng.integers(0, 2**63, n, dtype=np.uint64)


def signature(shingles: np.ndarray, odd: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """The minimum of every hash function over a set, as 32-bit numbers."""
    least = np.full(len(odd), 2**64 - 1, dtype=np.uint64)
    for start in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[start : start + 2048, None] * odd + shift).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signatures(df: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, n_shingles, digest of the set, signature (empty for an empty set)."""
    schema = T.StructType(
        [df.schema["doc_id"], T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("signature", T.ArrayType(T.IntegerType()))]
    )

    def make():
        words, (odd, shift) = Words(), _coefficients(COORDINATES)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, digests, made = [], [], []
            for text in strings(batch, "text"):
                found = shingle_set(word_numbers(text, words), shingle)
                n.append(len(found))
                digests.append(set_digest(found))
                made.append(signature(found, odd, shift) if len(found) else [])
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(made, pa.list_(pa.int32()))],
                names=["doc_id", "n_shingles", "digest", "signature"],
            )

        return step

    return per_batch(df.select("doc_id", "text"), schema, make)


def prefix_postings(classes: DataFrame, matches: int) -> DataFrame:
    """(list, node, shared, size): the prefix of every class in rare-first order, one list per set of members.

    ``shared`` is the number of coordinates that the class has in common with any other, ``size`` that of members.
    """
    posted = classes.select(
        F.col("rep").alias("node"),
        F.explode(F.transform("signature", lambda v, i: i.cast("long") * F.lit(2**32) + v.cast("long") + F.lit(2**31))).alias("key"),
    )
    shared = cut_lineage(posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    held = posted.join(shared, "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("keys"))
    prefix = cut_lineage(
        held.where(F.size("keys") >= matches)
        .select("node", F.size("keys").alias("shared"), F.explode(F.slice("keys", F.lit(1), F.size("keys") - matches + 1)).alias("k"))
        .select(F.col("k.key").alias("list"), "node", "shared")
    )
    # equal member sets: the same size and the same two sums of hashes
    member = F.xxhash64("node").cast("decimal(38,0)")
    other = F.xxhash64(F.lit(7), "node").cast("decimal(38,0)")
    lists = prefix.groupBy("list").agg(F.count("*").alias("n"), F.sum(member).alias("a"), F.sum(other).alias("b")).where("n > 1")
    lists = cut_lineage(lists.groupBy("n", "a", "b").agg(F.min("list").alias("list")).select("list", F.col("n").alias("size")))
    return cut_lineage(prefix.join(lists, "list"))


def _texts(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the classes in some list; the only time that texts are moved."""
    wanted = nodes.select(F.col("node").alias("doc_id")).distinct()
    # the same join at every size: few classes now don't mean few later
    return cut_lineage(documents.join(wanted.hint("merge"), "doc_id").select(F.col("doc_id").alias("node"), "text"))


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (u, v) of classes whose full sets have ``100 * common >= percent * union``."""
    pairs = pairs.select("u", "v")
    left = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("text_u")), "u")
    both = left.join(texts.select(F.col("node").alias("v"), F.col("text").alias("text_v")), "v").select("u", "v", "text_u", "text_v")

    def run(batches):
        words = Words()
        for batch in batches:
            ends = []
            for name in ("text_u", "text_v"):
                ends.append([shingle_set(word_numbers(t, words), shingle) for t in strings(batch, name)])
            keep = []
            for a, b in zip(*ends):
                common = intersection(a, b)
                keep.append(common > 0 and 100 * common >= percent * (len(a) + len(b) - common))
            if any(keep):
                yield batch.select(["u", "v"]).filter(pa.array(keep))

    return both.mapInArrow(run, pairs.schema)


def _leader_pairs(postings: DataFrame, classes: DataFrame, matches: int) -> DataFrame:
    """Every class with the list leader it agrees with in most coordinates, at least ``matches``.

    A list's leader shares most coordinates with others, the smallest of equals, so links to leaders form no circle.
    """
    rank = F.struct("shared", (-F.col("node")).alias("node"))
    leaders = cut_lineage(postings.groupBy("list").agg(F.max(rank).alias("r")).select("list", (-F.col("r.node")).alias("leader")))
    pairs = cut_lineage(postings.join(leaders, "list").where("node <> leader").select("node", "leader").distinct())
    mine = classes.select(F.col("rep").alias("node"), F.col("signature").alias("s"))
    theirs = classes.select(F.col("rep").alias("leader"), F.col("signature").alias("t"))
    agree = F.aggregate(F.zip_with("s", "t", lambda a, b: (a == b).cast("int")), F.lit(0), lambda x, y: x + y)
    counted = pairs.join(mine, "node").join(theirs, "leader").select("node", "leader", agree.alias("n")).where(F.col("n") >= matches)
    best = counted.groupBy("node").agg(F.max(F.struct("n", (-F.col("leader")).alias("leader"))).alias("best"))
    return best.select(F.col("node").alias("u"), (-F.col("best.leader")).alias("v"))


def _tops(parents: DataFrame) -> DataFrame:
    """(node, root) of a forest (u, v), by doubling the length of the known paths."""
    now = parents.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        above = now.select(F.col("node").alias("root"), F.col("root").alias("above"))
        now = cut_lineage(now.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        moved = now.where("moved").limit(1).count()
        now = now.drop("moved")
        if not moved:
            return now


def _alone(texts: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, alone): how many shingles of a class no other class among ``nodes`` has; none are left out."""

    def run(batches):
        words = Words()
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                sets = [shingle_set(word_numbers(t, words), shingle) for t in strings(part, "text")]
                owner = np.repeat(part.column("node").to_numpy(), [len(x) for x in sets])
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.concatenate(sets).view(np.int64))], names=["node", "shingle"])

    node = texts.schema["node"].dataType.simpleString()
    held = texts.join(nodes.distinct(), "node").mapInArrow(run, f"node {node}, shingle long")
    single = held.groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1")
    return cut_lineage(single.groupBy("node").agg(F.count("*").alias("alone")))


def _wide_signatures(texts: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, wide): the longer signature as bytes."""

    def make():
        words, (odd, shift) = Words(), _coefficients(WIDE)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = (shingle_set(word_numbers(t, words), shingle) for t in strings(batch, "text"))
            made = [signature(x, odd, shift).astype(np.uint8).tobytes() for x in sets]
            return pa.RecordBatch.from_arrays([batch.column("node"), pa.array(made, pa.binary())], names=["node", "wide"])

        return step

    return per_batch(texts.join(nodes.distinct(), "node"), f"node {texts.schema['node'].dataType.simpleString()}, wide binary", make)


def _open_pairs(postings: DataFrame, classes: DataFrame, linked: DataFrame, texts: DataFrame, shingle: int, matches: int, percent: int) -> DataFrame:
    """Pairs of different components within lists that agree in at least ``matches`` coordinates."""
    root = F.coalesce("root", "node").alias("root")
    held = cut_lineage(postings.join(linked, "node", "left").select("list", "size", "node", root))
    still = cut_lineage(held.groupBy("list").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("list"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    at = F.pmod(F.xxhash64("node", F.lit(3)), blocks).cast("int")
    # a member goes to the pairs of blocks that hold its own
    rows = cut_lineage(held.join(still, "list"))
    bounds = classes.select(F.col("rep").alias("node"), "n_shingles", "signature").join(_alone(texts, rows.select("node"), shingle), "node", "left")
    # with so many shingles of its own a class can't reach the wanted share with any other
    bounds = bounds.select("node", "n_shingles", "signature", (F.col("n_shingles") - F.coalesce("alone", F.lit(0))).alias("common"))
    bounds = cut_lineage(bounds.where(F.col("common") * 100 >= F.col("n_shingles") * percent))
    lists = postings.groupBy("node").agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftright(list, 32) as int))")).alias("lists"))
    bounds = cut_lineage(bounds.join(_wide_signatures(texts, bounds.select("node"), shingle), "node").join(lists, "node"))
    share = percent / 100
    wide_matches = WIDE * share - WIDE_SLACK * (WIDE * share * (1 - share)) ** 0.5
    rows = rows.withColumn("blocks", blocks).withColumn("at", at)
    rows = rows.select("list", "node", "root", "at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("list", "node", "root", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "at")
    rows = rows.join(bounds, "node")
    ordered = rows.repartition("list", "i", "j").sortWithinPartitions("list", "i", "j")
    node = classes.schema["rep"].dataType

    def pairs_of(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        marks = np.array([r["signature"] for r in rows], dtype=np.int32)
        n = np.array([r["n_shingles"] for r in rows])
        common = np.array([r["common"] for r in rows])
        root = np.array([r["root"] for r in rows])
        side = np.array([r["at"] for r in rows])
        wide = np.frombuffer(b"".join(r["wide"] for r in rows), dtype=np.uint8).reshape(len(rows), WIDE)
        held = np.array([r["lists"] for r in rows], dtype=np.int64).view(np.uint64)
        posted = (held[:, None] >> np.arange(COORDINATES, dtype=np.uint64)) & np.uint64(1) > 0
        coordinate = rows[0]["list"] >> 32
        same_block = rows[0]["i"] == rows[0]["j"]
        u, v = [], []
        for at in range(len(rows) - 1):
            others = np.arange(at + 1, len(rows))
            fits = root[others] != root[at]
            if not same_block:
                fits &= side[others] != side[at]
            most = np.minimum(common[others], common[at])
            fits &= 100 * most >= percent * (n[others] + n[at] - most)
            others = others[fits]
            if len(others):
                equal = marks[others] == marks[at]
                # of all lists that both are in, the first one puts the pair out
                first = (equal & posted[others] & posted[at]).argmax(axis=1) == coordinate
                others = others[(equal.sum(axis=1) >= matches) & first]
                others = others[(wide[others] == wide[at]).sum(axis=1) >= wide_matches]
                u += [at] * len(others)
                v += others.tolist()
        return u, v

    def run(batches):
        kept: list[dict] = []

        def flush():
            u, v = pairs_of(kept)
            if u:
                yield pa.RecordBatch.from_pydict({"u": [kept[x]["node"] for x in u], "v": [kept[x]["node"] for x in v]})

        for batch in batches:
            for row in batch.to_pylist():
                if kept and (row["list"], row["i"], row["j"]) != (kept[0]["list"], kept[0]["i"], kept[0]["j"]):
                    yield from flush()
                    kept = []
                kept.append(row)
        if kept:
            yield from flush()

    schema = T.StructType([T.StructField("u", node), T.StructField("v", node)])
    found = ordered.mapInArrow(run, schema)
    return found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _linked(documents: DataFrame, signed: DataFrame, shingle: int, percent: int, matches: int) -> DataFrame:
    """The result for documents whose ids stand for one set each."""
    usable = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    copies = cut_lineage(usable.groupBy("digest").agg(F.min("doc_id").alias("rep")))
    classes = cut_lineage(usable.join(copies.select(F.col("rep").alias("doc_id"), F.col("digest").alias("same")), "doc_id").where("digest = same").select(F.col("doc_id").alias("rep"), "n_shingles", "signature").dropDuplicates(["rep"]))
    postings = prefix_postings(classes, matches)
    texts = _texts(documents, postings)
    linked = _tops(cut_lineage(confirmed(_leader_pairs(postings, classes, matches), texts, shingle, percent)))
    more = cut_lineage(_open_pairs(postings, classes, linked, texts, shingle, matches, percent))
    # links between components are few; only their components are looked for
    top = linked.select(F.col("node"), F.col("root"))
    between = confirmed(more, texts, shingle, percent)
    between = between.join(top.toDF("u", "ru"), "u", "left").join(top.toDF("v", "rv"), "v", "left").select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))
    between = cut_lineage(between.where("u <> v").distinct())
    wider = cut_lineage(components(between)) if between.limit(1).count() else None
    if wider is not None:
        known = linked.join(wider.toDF("root", "wider"), "root", "left").select("node", F.coalesce("wider", "root").alias("root"))
        linked = known.union(wider.join(linked.select("node"), "node", "left_anti").select("node", "root"))
    # a component is named by its smallest member; the root itself is one
    member = linked.union(linked.select(F.col("root").alias("node"), "root")).distinct()
    least = cut_lineage(member.groupBy("root").agg(F.min("node").alias("least")))
    roots = cut_lineage(member.join(least, "root").select("node", F.col("least").alias("root")))
    classed = signed.join(copies, "digest", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("rep")).alias("node"))
    out = classed.join(roots, "node", "left").select("doc_id", "n_shingles", F.coalesce("root", "node", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _clashing_ids(signed: DataFrame) -> DataFrame:
    """The ids (doc_id) that several sets share; an empty set doesn't count."""
    marks = [F.xxhash64(F.lit(x), "digest") for x in (1, 2)]  # numbers, so that equal ids collapse before the shuffle
    spread = [x(mark).alias(f"{x.__name__}{at}") for at, mark in enumerate(marks) for x in (F.min, F.max)]
    sets = signed.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id").agg(*spread)
    return sets.where("min0 <> max0 OR min1 <> max1").select("doc_id")


def _named_anew(documents: DataFrame, clashing: DataFrame) -> DataFrame:
    """(inner, doc_id, text): the rows whose id is ``clashing``, each with an id of its own that no document has."""
    low, high = documents.agg(F.min("doc_id"), F.max("doc_id")).first()
    if high < 2**62:
        inner = F.lit(high + 1).cast("long") + F.monotonically_increasing_id()
    elif low > -(2**62):
        inner = F.lit(low - 1).cast("long") - F.monotonically_increasing_id()
    else:
        raise ValueError("ids that several texts share need 2^62 free numbers above or below all ids")
    return cut_lineage(documents.join(clashing, "doc_id", "left_semi").select(inner.alias("inner"), "doc_id", "text"))


def near_duplicates(df: DataFrame, shingle: int = 4, percent: int = 80, matches: int = MATCHES) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links), kept.

    Documents are linked when ``100 * intersection >= percent * union`` of their shingle sets.
    A NULL or text without words has no shingles and no links, so its component is its id; a NULL
    id has no links, no component, and isn't kept. Rows that share an id are one document: each
    text has its own links, and the components of an id's texts are one. Each row gets a row.
    Other columns are ignored; an empty table gives none.
    """
    documents = df.select("doc_id", "text")
    signed = cut_lineage(signatures(documents, shingle))
    clashing = cut_lineage(_clashing_ids(signed))
    if not clashing.limit(1).count():
        return _linked(documents, signed, shingle, percent, matches)
    own = _named_anew(documents, clashing)
    renamed = own.select(F.col("inner").alias("doc_id"), "text")
    long_id = F.col("doc_id").cast("long").alias("doc_id")
    documents = documents.join(clashing, "doc_id", "left_anti").select(long_id, "text").unionByName(renamed)
    signed = signed.join(clashing, "doc_id", "left_anti").withColumn("doc_id", F.col("doc_id").cast("long"))
    signed = cut_lineage(signed.unionByName(signatures(renamed, shingle)))
    found = _linked(documents, signed, shingle, percent, matches).select(F.col("doc_id").alias("inner"), "n_shingles", F.col("component_id").alias("part"))
    ids = own.select("inner", F.col("doc_id").cast("long").alias("shared"))
    found = cut_lineage(found.join(ids, "inner", "left").withColumn("doc_id", F.coalesce("shared", "inner")))
    # the parts that hold texts of one id are one component
    texts = found.where("shared IS NOT NULL AND n_shingles > 0").select("shared", "part").distinct()
    least = cut_lineage(texts.groupBy("shared").agg(F.min("part").alias("v")))
    edges = cut_lineage(texts.join(least, "shared").select(F.col("part").alias("u"), "v").distinct())
    whole = components(edges).select(F.col("node").alias("part"), F.col("root").alias("whole"))
    parts = cut_lineage(edges.select(F.col("u").alias("part")).distinct().join(whole, "part", "left").withColumn("whole", F.coalesce("whole", "part")))
    found = found.join(parts, "part", "left")
    names = cut_lineage(found.where("whole IS NOT NULL").groupBy("whole").agg(F.min("doc_id").alias("name")))
    found = found.join(names, "whole", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("name", "part"))
    kind = df.schema["doc_id"].dataType
    out = found.select(F.col("doc_id").cast(kind).alias("doc_id"), "n_shingles", component.cast(kind).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
