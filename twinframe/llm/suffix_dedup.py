"""Removal of long byte strings that repeat anywhere in a corpus, by suffix sorting.

A string of ``length`` bytes is found through its anchor: the gram of ``GRAM`` bytes with the
smallest hash inside it, the leftmost of equals. Equal strings have equal anchors at equal
places, so each string is looked for among the stretches around occurrences of its anchor only.
All anchors of all texts are counted; those that occur once are done with.

Stretches of one anchor with equal bytes are one piece with a weight. Text of a short period has
an anchor in every period; the equal pieces that follow each other there are one row with their
number, so such a text makes no more rows than others. Where an anchor has
different pieces, these are cut into parts whose strings share a core, and parts are gathered by
core. Parts that few others share a core with are suffix-sorted in blocks by the two-stage
method, and neighbours with a common prefix of ``length`` bytes are the repeats. Where many
different parts share a core (the edges of a very common passage), they are cut finer, down to
single strings, which need no comparison beyond equality. So no group is gathered whole and
nothing is capped.

Texts are known by their md5 digest, so copies of a text share their spans.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.llm.common import cut_lineage, per_batch, slices, strings
from twinframe.llm.shingles import mixed
from twinframe.llm.suffix_sort import repeated

GRAM = 128
STRETCH = 1 << 20  # string starts hashed together; longer texts are walked in stretches
CUTS = (64, 8, 1)  # string starts per part, from coarse to single strings
FEW = 256  # parts of one core that are suffix-sorted together
BLOCK_BYTES = 1 << 18

_PIECE = "digest binary, lo long, hi long, anchor long, key long, piece long"


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every gram of ``size`` bytes (a power of two), by doubling."""
    made = mixed(data.astype(np.uint64) + np.uint64(1))
    base, width = 0x9E3779B97F4A7C15 | 1, 1
    while width < size:
        made = made[:-width] * np.uint64(pow(base, width, 1 << 64)) + made[width:]
        width *= 2
    return mixed(made)


def sliding_minima(values: np.ndarray, window: int) -> np.ndarray:
    """The minimum of every window, from running minima in blocks."""
    n = len(values)
    blocks = -(-n // window)
    padded = np.full(blocks * window, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[:n] = values
    grid = padded.reshape(blocks, window)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - window + 1
    return np.minimum(behind[:count], ahead[window - 1 : window - 1 + count])


def anchors(texts: list[bytes], length: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per text with a string of ``length`` bytes: its number, first and last string start of each anchor, the anchor's place and hash."""
    gram, out = min(GRAM, 1 << (max(1, length // 2).bit_length() - 1)), []
    window = length - gram + 1
    # texts are joined up to the stretch size; a longer text comes in overlapping stretches
    waiting: list[tuple[int, int, bytes]] = []
    held = 0

    def flush() -> None:
        nonlocal waiting, held
        if not waiting:
            return
        sizes = np.array([len(p) for _, _, p in waiting])
        data = np.frombuffer(b"".join(p for _, _, p in waiting), dtype=np.uint8)
        ends = np.cumsum(sizes)
        hashes = gram_hashes(data, gram)
        place = np.arange(len(hashes), dtype=np.uint64)
        least = sliding_minima((hashes >> np.uint64(25) << np.uint64(25)) | place, window)
        at = (least & np.uint64((1 << 25) - 1)).astype(np.int64)
        for (number, offset, _), end, size in zip(waiting, ends.tolist(), sizes.tolist()):
            start = end - size
            own = at[start : end - length + 1]
            cuts = np.flatnonzero(np.diff(own)) + 1
            lo = np.concatenate([[0], cuts])
            hi = np.concatenate([cuts - 1, [len(own) - 1]])
            out.append((number, lo + offset, hi + offset, own[lo] - start + offset, hashes[own[lo]].view(np.int64)))
        waiting, held = [], 0

    for number, raw in enumerate(texts):
        for start in range(0, max(0, len(raw) - length + 1), STRETCH):
            piece = raw[start : start + STRETCH + length - 1]
            if held + len(piece) > 2 * STRETCH:
                flush()
            waiting.append((number, start, piece))
            held += len(piece)
    flush()
    return out


def _digest(raw: bytes, shift: int) -> int:
    """A signed 64-bit hash of bytes and their place relative to the anchor."""
    made = xxhash.xxh3_64_intdigest(raw, seed=shift)
    return made - (1 << 64) if made >= 1 << 63 else made


def anchor_pieces(texts: DataFrame, length: int) -> DataFrame:
    """One row per anchor of every text (digest, text).

    Anchors that follow each other with the same piece, as in text of a short period, are one row:
    the first one's, with ``weight`` their number and ``last`` the last string start of them all.
    """

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            raws = [t.encode() for t in strings(batch, "text")]
            digests = batch.column("digest").to_pylist()
            owner, columns = [], [[] for _ in range(7)]
            for number, first, last, at, hashes in anchors(raws, length):
                raw = raws[number]
                pieces = np.array([_digest(raw[a : b + length], p - a) for a, b, p in zip(first.tolist(), last.tolist(), at.tolist())], dtype=np.int64)
                edge = (hashes[1:] != hashes[:-1]) | (pieces[1:] != pieces[:-1])
                head = np.concatenate([[0], np.flatnonzero(edge) + 1])
                after = np.append(head[1:], len(first))
                owner += [digests[number]] * len(head)
                for column, part in zip(columns, (first[head], last[head], at[head], hashes[head], pieces[head], last[after - 1], after - head)):
                    column.append(part)
            arrays = [pa.array(np.concatenate(parts) if parts else [], pa.int64()) for parts in columns]
            return pa.RecordBatch.from_arrays([pa.array(owner, pa.binary()), *arrays], names=["digest", "lo", "hi", "anchor", "key", "piece", "last", "weight"])

        return step

    return per_batch(texts, f"{_PIECE}, last long, weight long", make)


def _weighed(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key occurs with more weight than 1, and per key its number of different pieces.

    Both are written. The first gets ``times``, the weight of all equal pieces under the key.
    """
    keys = cut_lineage(
        pieces.groupBy("key").agg(F.sum("weight").alias("total"), F.min("piece").alias("low"), F.max("piece").alias("high")).where("total > 1").select("key", (F.col("low") == F.col("high")).alias("alone"), "total")
    )
    held = cut_lineage(pieces.join(keys, "key"))
    mixed_ = held.where("NOT alone")
    times = mixed_.groupBy("key", "piece").agg(F.sum("weight").alias("times"), F.min(F.struct("digest", "lo")).alias("first"))
    return held, cut_lineage(times)


def _cut_finer(units: DataFrame, width: int, length: int) -> DataFrame:
    """Cut units (with bytes from ``lo`` on) into parts of ``width`` string starts, keyed by the core that all strings of a part hold."""
    schema = T.StructType([*T._parse_datatype_string(_PIECE).fields, T.StructField("weight", T.LongType()), T.StructField("bytes", T.BinaryType())])

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for r in batch.to_pylist():
                raw, lo, hi, p = r["bytes"], r["lo"], r["hi"], r["anchor"]
                # a start at distance d before the anchor belongs to part d // width
                for part in range((p - hi) // width, (p - lo) // width + 1):
                    a, b = max(lo, p - (part + 1) * width + 1), min(hi, p - part * width)
                    core_end = p - (part + 1) * width + 1 + length
                    core = raw[p - part * width - lo : core_end - lo] if width > 1 else raw[a - lo : a - lo + length]
                    own = raw[a - lo : b - lo + length]
                    rows.append((r["digest"], a, b, p, _digest(core, part), _digest(own, p - a), r["weight"], own))
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(arrow)], names=schema.names)

        arrow = [pa.binary()] + [pa.int64()] * 6 + [pa.binary()]
        return step

    return per_batch(units.select("digest", "lo", "hi", "anchor", "weight", "bytes"), schema, make)


def _sorted_repeats(parts: DataFrame, length: int) -> DataFrame:
    """Spans (digest, start, end) of repeated strings among parts of the same key, by suffix sorting blocks of whole keys."""
    ordered = parts.select("key", "digest", "lo", "weight", "bytes").repartition("key").sortWithinPartitions("key")

    def run(batches):
        kept: list[dict] = []
        size = 0

        def flush():
            marks = repeated([r["bytes"] for r in kept], [r["weight"] for r in kept], length)
            digest, start, end = [], [], []
            for r, found in zip(kept, marks):
                if r["weight"] > 1:
                    continue  # its own copies have marked it already
                edge = np.diff(np.concatenate([[0], found.astype(np.int8), [0]]))
                first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                digest += [r["digest"]] * len(first)
                start += (first + r["lo"]).tolist()
                end += (last - 1 + r["lo"] + length).tolist()
            if digest:
                yield pa.RecordBatch.from_pydict({"digest": pa.array(digest, pa.binary()), "start": start, "end": end})

        for batch in batches:
            for row in batch.to_pylist():
                if size > BLOCK_BYTES and row["key"] != kept[-1]["key"]:
                    yield from flush()
                    kept, size = [], 0
                kept.append(row)
                size += len(row["bytes"])
        if kept:
            yield from flush()

    return ordered.mapInArrow(run, "digest binary, start long, end long")


def repeated_spans(df: DataFrame, length: int = 400, text: str = "text") -> DataFrame:
    """(digest, start, end) of stretches whose every byte lies in a repeated string; digest is the text's md5. Spans may overlap."""
    texts = df.select(F.unhex(F.md5(F.col(text).cast("binary"))).alias("digest"), F.col(text).alias("text")).where(F.octet_length("text") >= length)
    spans = []

    def whole(rows: DataFrame, last: str = "hi") -> DataFrame:
        return rows.select("digest", F.col("lo").alias("start"), (F.col(last) + length).alias("end"))

    held, times = _weighed(cut_lineage(anchor_pieces(texts, length)))
    spans.append(whole(held.where("alone"), "last"))
    spans.append(whole(held.join(times.where("times > 1").select("key", "piece"), ["key", "piece"]), "last"))
    # one unit per different piece; only these fetch their bytes
    units = times.select("key", "piece", F.col("first.digest").alias("digest"), F.col("first.lo").alias("lo"), F.col("times").alias("weight"))
    units = units.join(held.select("digest", "lo", "hi", "anchor").distinct(), ["digest", "lo"])
    wanted = cut_lineage(units.groupBy("digest").agg(F.collect_list(F.struct("lo", "hi", "anchor", "weight")).alias("units")))
    units = _fetched(texts, wanted, length)
    for width in CUTS:
        parts = cut_lineage(_cut_finer(units, width, length))
        held, times = _weighed(parts)
        own = held.where("weight = 1")
        spans.append(whole(own.where("alone")))
        spans.append(whole(own.join(times.where("times > 1").select("key", "piece"), ["key", "piece"])))
        if width == 1:
            break  # equal strings are equal pieces
        kinds = cut_lineage(times.groupBy("key").agg(F.count("*").alias("kinds")))
        one = times.select("key", F.col("first.digest").alias("digest"), F.col("first.lo").alias("lo"), F.col("times").alias("weight"))
        one = one.join(kinds, "key").join(held.select("key", "digest", "lo", "hi", "anchor", "bytes").dropDuplicates(["key", "digest", "lo"]), ["key", "digest", "lo"])
        one = cut_lineage(one)
        spans.append(cut_lineage(_sorted_repeats(one.where(F.col("kinds") <= FEW), length)))
        units = one.where(F.col("kinds") > FEW)
    found = spans[0]
    for more in spans[1:]:
        found = found.unionByName(more)
    return found.distinct()


def _fetched(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Units with their bytes; a text with several copies is read from each but used once."""
    schema = "digest binary, lo long, hi long, anchor long, weight long, bytes binary"

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for digest, text, units in zip(batch.column("digest").to_pylist(), strings(batch, "text"), batch.column("units").to_pylist()):
                raw = text.encode()
                rows += [(digest, u["lo"], u["hi"], u["anchor"], u["weight"], raw[u["lo"] : u["hi"] + length]) for u in units]
            arrow = [pa.binary()] + [pa.int64()] * 4 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(arrow)], names=["digest", "lo", "hi", "anchor", "weight", "bytes"])

        return step

    cut = per_batch(texts.join(wanted, "digest"), schema, make)
    return cut.dropDuplicates(["digest", "lo"])


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in sorted((x["start"], x["end"]) for x in spans or []):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [(a, b) for a, b in out]


def _with_spans(df: DataFrame, length: int, text: str) -> DataFrame:
    """The table with the column ``_spans`` added; no other column may be called so, or ``_digest``."""
    spans = repeated_spans(df, length, text).groupBy("digest").agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    spans = cut_lineage(spans.withColumnRenamed("digest", "_digest"))
    return df.withColumn("_digest", F.unhex(F.md5(F.col(text).cast("binary")))).join(spans, "_digest", "left").drop("_digest")


def removed_repeats(df: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every text without its repeated strings.

    A NULL text counts as empty: nothing to remove. Copies of a text repeat each other, so texts of
    ``length`` bytes or more with a copy lose all. A NULL id is kept; other columns are ignored.
    """
    schema = T.StructType(
        [df.schema["doc_id"]] + [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())]
    )

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            size, removed, count, sha = [], [], [], []
            for text, spans in zip(strings(batch, "text"), batch.column("_spans").to_pylist()):
                raw, gone = text.encode(), _merged(spans)
                size.append(len(raw))
                removed.append(sum(b - a for a, b in gone))
                count.append(len(gone))
                sha.append(hashlib.sha256(_without(raw, gone)).hexdigest())
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (size, removed, count)), pa.array(sha, pa.string())], names=schema.names
            )

        return step

    return per_batch(_with_spans(df.select("doc_id", "text"), length, "text"), schema, make)


def _without(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in gone:
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]])


def without_repeats(df: DataFrame, length: int = 400, n_chars: str | None = "n_chars") -> DataFrame:
    """The table with its repeated strings cut out of ``text`` and ``n_chars`` counted anew.

    A character that a cut goes through is dropped. Texts without repeats, NULL ones included, and
    all other columns stay as they are, whatever their names.
    """
    held = df.toDF(*[f"of_{at}" for at in range(len(df.columns))])
    names = held.columns
    text = names[df.columns.index("text")]
    n_chars = names[df.columns.index(n_chars)] if n_chars in df.columns else None
    marked = _with_spans(held, length, text)

    def run(batches):
        for batch in slices(batches):
            spans = batch.column("_spans").to_pylist()
            texts = batch.column(text).to_pylist()
            made = [_without(t.encode(), _merged(s)).decode("utf-8", "ignore") if s else t for t, s in zip(texts, spans)]
            columns = {n: batch.column(n) for n in names}
            columns[text] = pa.array(made, pa.string())
            if n_chars in columns:
                counts = [len(m) if s else n for m, s, n in zip(made, spans, columns[n_chars].to_pylist())]
                columns[n_chars] = pa.array(counts, columns[n_chars].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return marked.select(*names, "_spans").mapInArrow(run, held.schema).toDF(*df.columns)
