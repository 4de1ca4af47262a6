"""Fingerprints from spots: a common word and the chain of content words that follows it.

Every occurrence of a common word (an anchor) gives one signature, the anchor with the next
``CHAIN`` words that are not common. The set of signatures, as sorted 32-bit numbers in hex, is
the fingerprint; two are compared by the Jaccard coefficient. A text without any spot has one
signature, its whole word sequence (its characters, if it has no words), so equal texts always
have equal fingerprints.

Sets are partitioned by length so that only neighbouring partitions can hold similar pairs, and a
comparison stops as soon as the remaining members can't reach the wanted likeness.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.llm.common import cut_lineage, per_batch, slices, strings
from twinframe.llm.components import components
from twinframe.llm.shingles import _ODD, REMEMBERED, mixed

# fixed values: common words of four languages
ANCHORS = (
    "the of and to a in is it you that he was for on are with as i his they be at one have this from or had by but not what all were we when "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son ou aux "
    "el y los del las por con no su para al lo como más o pero sus este ya entre cuando muy sin sobre"
).split()
CHAIN = 2
BLOCK = 512  # members of a list that are compared in one task
_WORD = re.compile(r"[^\W_]+")


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = made = xxhash.xxh3_64_intdigest(word)
        return made


_ANCHOR_NUMBERS = np.sort(np.array([xxhash.xxh3_64_intdigest(a) for a in set(ANCHORS)], dtype=np.uint64))


def spot_set(text: str, numbers: _Numbers) -> np.ndarray:
    """The sorted distinct signatures of a text, as 32-bit numbers; never empty."""
    found = _WORD.findall(text.lower())
    words = np.fromiter(map(numbers.__getitem__, found), dtype=np.uint64, count=len(found))
    at = np.searchsorted(_ANCHOR_NUMBERS, words)
    common = _ANCHOR_NUMBERS[np.minimum(at, len(_ANCHOR_NUMBERS) - 1)] == words
    content = np.flatnonzero(~common)
    anchors = np.flatnonzero(common)
    first = np.searchsorted(content, anchors)
    whole = first + CHAIN <= len(content)
    anchors, first = anchors[whole], first[whole]
    if not len(anchors):
        return np.array([xxhash.xxh3_64_intdigest(" ".join(found) or text) >> 32], dtype=np.uint32)
    made = mixed(words[anchors])
    for step in range(CHAIN):
        made = mixed(made + words[content[first + step]] * _ODD[step])
    return np.unique((made >> np.uint64(32)).astype(np.uint32))


def fingerprint(signatures: np.ndarray) -> bytes:
    """The sorted signatures as big-endian bytes; in results they appear as hex."""
    return signatures.astype(">u4").tobytes()


def length_partition(size: int, likeness: float) -> int:
    """Sets at least ``likeness`` alike lie in the same or in neighbouring partitions."""
    return int(math.floor(math.log(size) / -math.log(likeness))) if size and 0 < likeness < 1 else 0


def jaccard(a: np.ndarray, b: np.ndarray, at_least: float = 0.0) -> float:
    """The Jaccard coefficient of two sorted sets; 0 as soon as it can't reach ``at_least``."""
    if min(len(a), len(b)) < at_least * max(len(a), len(b)):
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    common, total = 0, len(a) + len(b)
    for start in range(0, len(a), 1024):
        part = a[start : start + 1024]
        at = np.searchsorted(b, part)
        common += int((b[np.minimum(at, len(b) - 1)] == part).sum())
        most = common + len(a) - start - len(part)
        if most < at_least * (total - most):
            return 0.0
    return common / (total - common)


_RESULT = "n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


class _Compared:
    """Results of documents with their successors, gathered into one batch."""

    def __init__(self) -> None:
        self.numbers = _Numbers()
        self.rows: list[tuple] = []

    def spots(self, text: str) -> np.ndarray:
        return spot_set(text, self.numbers)

    def add(self, doc_id, text: str, own: np.ndarray, following: str, next_own: np.ndarray) -> None:
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        changed = self.spots(edited)
        sha = hashlib.sha256(edited.encode()).hexdigest()
        self.rows.append((doc_id, len(text), sha, fingerprint(own), fingerprint(changed), jaccard(own, changed), jaccard(own, next_own)))


def fingerprints(df: DataFrame) -> DataFrame:
    """Fingerprint every text and its edited text.

    The edited text has the last floor(n / 2) of the n characters replaced by the first as many (or
    all) of the next document in ascending doc_id; after the last comes the first. Rows of equal
    id follow each other, a NULL id comes first, and a NULL text counts as empty; a lone
    row is its own successor. (Of rows with equal id and different texts, a fixed order of their
    packed bytes decides.) Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    Rows are dealt out in ranges of ids, so a successor is the next row of the same task; only the
    first and last row of each range meet again across ranges.
    """
    kind = df.schema["doc_id"].dataType
    fields = T._parse_datatype_string(_RESULT).fields
    schema = T.StructType([T.StructField("doc_id", kind), *fields, T.StructField("part", T.IntegerType()), T.StructField("edge", T.StringType()), T.StructField("text", T.StringType())])
    results = ["doc_id", *(f.name for f in fields)]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_type

        columns = [pa.array([r[i] for r in rows], to_arrow_type(f.dataType)) for i, f in enumerate(schema.fields)]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        unpack = zstandard.ZstdDecompressor()
        made, last = _Compared(), None
        for batch in slices(batches):
            edges = []
            for doc_id, packed in zip(batch.column("doc_id").to_pylist(), batch.column("packed").to_pylist()):
                text = unpack.decompress(packed).decode()
                own = made.spots(text)
                if last is None:
                    edges.append((doc_id, *[None] * len(fields), part, "first", text))
                else:
                    made.add(*last, text, own)
                last = (doc_id, text, own)
            rows = [(*r, part, None, None) for r in made.rows]
            made.rows = []
            if rows or edges:
                yield batch_of(edges + rows)
        if last is not None:
            yield batch_of([(last[0], *[None] * len(fields), part, "last", last[1])])

    def packer():
        pack = zstandard.ZstdCompressor(level=1)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = pa.array([pack.compress(t.encode()) for t in strings(batch, "text")], pa.binary())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), made], names=["doc_id", "packed"])

        return step

    # whole texts move once; packed they are a third smaller than the shuffle's own compression makes them
    packed = per_batch(df.select("doc_id", "text"), T.StructType([T.StructField("doc_id", kind), T.StructField("packed", T.BinaryType())]), packer)
    ordered = packed.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "packed")
    table = cut_lineage(ordered.mapInArrow(run, schema))
    parts = sorted(r["part"] for r in table.where("edge = 'first'").select("part").collect())  # one number per range
    after = table.sparkSession.createDataFrame([(a, b) for a, b in zip(parts, parts[1:] + parts[:1])], "part int, next int")
    lasts = table.where("edge = 'last'").select("doc_id", "text", "part")
    firsts = table.where("edge = 'first'").select(F.col("part").alias("next"), F.col("text").alias("following"))

    def finish(batches):
        made = _Compared()
        for batch in batches:
            for doc_id, text, following in zip(batch.column("doc_id").to_pylist(), strings(batch, "text"), strings(batch, "following")):
                made.add(doc_id, text, made.spots(text), following, made.spots(following))
            if made.rows:
                yield batch_of([(*r, None, None, None) for r in made.rows]).select(results)
            made.rows = []

    edges = lasts.join(after, "part").join(firsts, "next").select("doc_id", "text", "following").mapInArrow(finish, T.StructType(schema.fields[: len(results)]))
    whole = table.where("edge IS NULL").select(*results).unionByName(edges)
    return whole.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


def spot_sets(df: DataFrame) -> DataFrame:
    """doc_id and spots: the sorted distinct signatures of every text, never empty."""
    schema = T.StructType([df.schema["doc_id"], T.StructField("spots", T.ArrayType(T.LongType()))])

    def make():
        numbers = _Numbers()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [spot_set(t, numbers).astype(np.int64) for t in strings(batch, "text")]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.list_(pa.int64()))], names=["doc_id", "spots"])

        return step

    return per_batch(df.select("doc_id", "text"), schema, make)


def _meetings(classes: DataFrame, likeness: float) -> DataFrame:
    """(partition, spot, node, own): where classes meet. Each posts its rarest spots, as many as a similar
    set must share one of, in its own length partition and, as a guest, in that of longer sets."""
    single = classes.select("node", F.explode("spots").alias("spot"))
    often = cut_lineage(single.groupBy("spot").agg(F.count("*").alias("n")).where("n > 1"))
    shared = single.join(often, "spot").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "spot"))).alias("held"))
    size, shares = F.size("spots"), F.size("held")
    # spots that no other class has come first and meet nobody
    take = shares - F.ceil(size * likeness - 1e-9).cast("int") + 1
    posted = classes.join(shared, "node").where(take > 0)
    partition = F.floor(F.log(size.cast("double")) / -math.log(likeness) + 1e-9).cast("int")
    rows = posted.select("node", partition.alias("home"), F.explode(F.slice("held", F.lit(1), take)).alias("h"))
    rows = rows.select("node", "home", F.col("h.spot").alias("spot"), F.explode(F.array("home", F.col("home") + 1)).alias("partition"))
    return cut_lineage(rows.select("partition", "spot", "node", (F.col("home") == F.col("partition")).alias("own")))


def similar_documents(df: DataFrame, likeness: float = 0.8) -> DataFrame:
    """doc_id and class_id of every row: the smallest doc_id reachable over pairs of spot sets at least ``likeness`` alike.

    Equal sets are one class from the start. Others meet in lists of a length partition and a spot;
    lists are compared in blocks, with pruned Jaccard, and give only the links that join what wasn't
    joined yet, so no group is expanded into its pairs. A NULL id has no class; a NULL text counts as
    empty, and empty texts are alike. ``likeness`` lies between 0 and 1, both excluded.
    """
    signed = cut_lineage(spot_sets(df))
    copies = cut_lineage(signed.where("doc_id IS NOT NULL").groupBy("spots").agg(F.min("doc_id").alias("node")))
    meetings = _meetings(copies, likeness)
    lists = meetings.groupBy("partition", "spot").agg(F.count("*").alias("size"), F.max("own").alias("some")).where("size > 1 AND some")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = meetings.join(cut_lineage(lists), ["partition", "spot"]).withColumn("at", F.pmod(F.xxhash64("node", F.lit(3)), blocks).cast("int"))
    rows = rows.select("partition", "spot", "node", "own", "at", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    keys = ["partition", "spot", "i", "j"]
    rows = rows.select("partition", "spot", "node", "own", "at", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"))
    # two classes share one list as a rule, and a copy of an id in two classes is one node
    ordered = rows.join(copies, "node").repartition(*keys).sortWithinPartitions(*keys, "node")

    def links(rows: list[dict]) -> list[tuple]:
        root = list(range(len(rows)))

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        sets, out = [np.array(r["spots"]) for r in rows], []
        for b in range(1, len(rows)):
            for a in range(b):
                if rows[a]["own"] or rows[b]["own"]:
                    x, y = top(a), top(b)
                    if x != y and jaccard(sets[a], sets[b], likeness) >= likeness:
                        root[y] = x
                        out.append((rows[b]["node"], rows[a]["node"]))
        return out

    def run(batches):
        kept: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if kept and any(row[k] != kept[0][k] for k in keys):
                    yield from flush(kept)
                    kept = []
                kept.append(row)
        if kept:
            yield from flush(kept)

    def flush(kept: list[dict]):
        found = links(kept)
        if found:
            yield pa.RecordBatch.from_pydict({"u": [u for u, _ in found], "v": [v for _, v in found]})

    kind = df.schema["doc_id"].dataType
    edges = cut_lineage(ordered.mapInArrow(run, T.StructType([T.StructField("u", kind), T.StructField("v", kind)])))
    roots = cut_lineage(components(edges))
    return signed.join(copies, "spots", "left").join(roots, "node", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "node")).alias("class_id"))
