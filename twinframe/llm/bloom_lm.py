"""A language model in a log-frequency Bloom filter.

Counts of words and word pairs are quantised to the logarithm: an n-gram with level q is put into
the filter as (n-gram, 1) .. (n-gram, q). Its level is found by probing 1, 2, .. until the first
miss, so a false answer can only raise a count, with a chance that falls with every level.

Texts are packed once into chunks of word numbers. A chunk's distinct n-grams go, with their counts
over the training texts, as packed arrays to shards by hash. One task merges a shard: it yields the
exact word counts, builds the shard's filter with ``BITS`` per entry whatever the number of n-grams,
probes it for all n-grams that came, and sends the levels back to the chunks, where texts are scored.
No filter leaves its task, so none has to fit a broadcast. The exact base model needs true word
counts: those of the most frequent words, at most ``HEAD`` of them, are broadcast, the others are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.llm.common import cut_lineage, id_fold, slices, strings
from twinframe.llm.shingles import mixed

END_WORD = xxhash.xxh3_64_intdigest(b" end ")  # no word holds a space; it also stands before a text's first word
PAIR = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xC2B2AE3D27D4EB4F)
BITS, PROBES = 10, 4
GROWTH = 1.6  # a level is a factor of this in the count
LEVELS = 64
HEAD = 500_000
SHARDS = 256
FLUSH = 2_000_000  # tokens of a chunk, besides its last text
STRENGTH = 1500.0  # tokens of word-only evidence mixed into every context


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum(1 + np.floor(np.log(counts) / np.log(GROWTH) + 1e-9).astype(np.int64), LEVELS)


def count_of_level() -> np.ndarray:
    """The count a level stands for: the geometric middle of its integers; 0 for level 0."""
    first = np.ceil(GROWTH ** np.arange(LEVELS + 1) - 1e-6)
    middle = np.sqrt(first[:-1] * np.maximum(first[1:] - 1, first[:-1]))
    return np.concatenate([[0.0], middle])


def _summed(h: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    h = h[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, dtype=np.int64)
    ones = np.ones(len(h), dtype=np.int64) if n is None else n[order]
    return h[starts], np.add.reduceat(ones, starts) if len(h) else ones


def _places(items: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers from which all bits of (item, level) follow."""
    y = mixed(items ^ np.uint64(level * int(STEP) % 2**64))
    return y >> np.uint64(32), (y & np.uint64(0xFFFFFFFF)) | np.uint64(1)


def filter_of(items: np.ndarray, levels: np.ndarray, n_bits: int) -> np.ndarray:
    """The bytes of a filter that holds (item, 1..level) for every item."""
    bits = np.zeros(-(-n_bits // 8) * 8, dtype=bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        a, b = _places(items[levels >= level], level)
        for probe in range(PROBES):
            bits[(a + np.uint64(probe) * b) % np.uint64(n_bits)] = True
    return np.packbits(bits, bitorder="little")


class Filter:
    """The shards of a filter side by side."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, n_bits: np.ndarray) -> None:
        self.data, self.offsets, self.n_bits = data, offsets, n_bits

    def levels(self, items: np.ndarray) -> np.ndarray:
        found = np.zeros(len(items), dtype=np.int64)
        shard = (items % np.uint64(len(self.offsets))).astype(np.int64)
        offset, size = self.offsets[shard], self.n_bits[shard]
        alive = np.flatnonzero(size > 0)
        for level in range(1, LEVELS + 1):
            a, b = _places(items[alive], level)
            for probe in range(PROBES):
                at = offset[alive] + (a + np.uint64(probe) * b) % size[alive]
                hit = (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
                alive, a, b = alive[hit], a[hit], b[hit]
            if not len(alive):
                break
            found[alive] = level
        return found


class _Numbered(dict):
    """Words to consecutive numbers; 0 is the end of a text."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes = [END_WORD]

    def __missing__(self, word: bytes) -> int:
        self[word] = made = len(self.hashes)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return made


def _pack(values: np.ndarray) -> bytes:
    """An array's size and its bytes by significance, compressed."""
    return len(values).to_bytes(8, "little") + pa.compress(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    raw = pa.decompress(data[8:], decompressed_size=n * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(width, n).T).view(kind).ravel()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts by the chunk: ids, folds, sizes in tokens, word numbers with an end after each text, and the words' hashes."""
    from pyspark import TaskContext

    chunk = TaskContext.get().partitionId() << 16
    words, rows, sizes, parts, held = _Numbered(), [], [], [], 0

    def flush() -> pa.RecordBatch:
        whole = pa.array([0, len(sizes)], pa.int32())
        packed = (_pack(np.array(sizes, dtype=np.uint32)), _pack(np.concatenate(parts)), _pack(np.array(words.hashes, dtype=np.uint64)))
        columns = [pa.ListArray.from_arrays(whole, pa.concat_arrays([r.column(c) for r in rows])) for c in ("doc_id", "held_out")]
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), *columns, *[pa.array([x], pa.binary()) for x in packed]], names=["chunk", "doc_id", "held_out", "sizes", "tokens", "words"])

    for batch in slices(batches, 500):
        start = 0
        for at, text in enumerate(strings(batch, "text")):
            split = text.encode().lower().split()
            parts.append(np.fromiter(map(words.__getitem__, split), dtype=np.uint32, count=len(split)))
            parts.append(np.zeros(1, dtype=np.uint32))
            sizes.append(len(split) + 1)
            held += len(split) + 1
            if held >= FLUSH:
                rows.append(batch.select(["doc_id", "held_out"]).slice(start, at + 1 - start))
                yield flush()
                words, rows, sizes, parts, held = _Numbered(), [], [], [], 0
                start, chunk = at + 1, chunk + 1
        if start < batch.num_rows:
            rows.append(batch.select(["doc_id", "held_out"]).slice(start))
    if held:
        yield flush()


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(mixed(first * PAIR) + second)


def _distinct(h: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes by shard and value, and the place of each given one among them."""
    found, at = np.unique(h, return_inverse=True)
    order = np.argsort(found % np.uint64(shards), kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return found[order], rank[at]


def _ngrams(words: np.ndarray, tokens: np.ndarray, shards: int) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """A chunk's distinct words and pairs, with the places of each word number and each token's pair."""
    hashes = words[tokens]
    before = np.concatenate([np.array([END_WORD], dtype=np.uint64), hashes[:-1]])
    return _distinct(words, shards), _distinct(pair_hashes(before, hashes), shards)


def _asked(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """The distinct n-grams of every chunk, kind 0 words and 1 pairs, by shard, with their counts over the texts that teach."""
    for batch in batches:
        for row in batch.to_pylist():
            tokens = _unpack(row["tokens"], np.uint32)
            teaches = np.repeat(~np.array(row["held_out"], dtype=bool), _unpack(row["sizes"], np.uint32))
            made = []
            for kind, (h, at) in enumerate(_ngrams(_unpack(row["words"], np.uint64), tokens, shards)):
                n = np.bincount((at if kind else at[tokens])[teaches], minlength=len(h)).astype(np.uint32)
                cuts = np.searchsorted(h % np.uint64(shards), np.arange(shards + 1, dtype=np.uint64))
                made += [(row["chunk"], s, kind, _pack(np.diff(h[a:b], prepend=np.uint64(0))), _pack(n[a:b])) for s, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            types = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names=["chunk", "shard", "kind", "h", "n"])


def _answered(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Exact counts of the words that teach (kind 2: h, n), and the levels that a shard's filter gives to
    each chunk's words and pairs (kinds 0 and 1: chunk, shard, data); rows come ordered by shard."""
    now, kept = None, [[], []]
    names, types = ["kind", "chunk", "shard", "h", "n", "data"], (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())

    def flush() -> Iterator[pa.RecordBatch]:
        made = []
        for parts in kept:
            h = np.concatenate([np.cumsum(_unpack(a, np.uint64)) for _, a, _ in parts]) if parts else np.zeros(0, dtype=np.uint64)
            n = np.concatenate([_unpack(b, np.uint32) for _, _, b in parts]).astype(np.int64) if parts else np.zeros(0, dtype=np.int64)
            made.append(_summed(h, n))
        items, counts = (np.concatenate(x) for x in zip(*made))
        levels = levels_of(counts[counts > 0])
        n_bits = max(8, int(levels.sum()) * BITS)
        held = Filter(filter_of(items[counts > 0], levels, n_bits), np.zeros(1, dtype=np.uint64), np.array([n_bits], dtype=np.uint64))
        h, n = (x[made[0][1] > 0] for x in made[0])
        for start in range(0, len(h), 50_000):
            part = h[start : start + 50_000].view(np.int64)
            none = [pa.nulls(len(part), t) for t in types]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), 2, dtype=np.int32)), none[1], none[2], pa.array(part), pa.array(n[start : start + 50_000]), none[5]], names=names)
        for kind, parts in enumerate(kept):
            found = held.levels(made[kind][0]).astype(np.uint8)
            for start in range(0, len(parts), 200):
                rows = [(kind, c, now, None, None, _pack(found[np.searchsorted(made[kind][0], np.cumsum(_unpack(a, np.uint64)))])) for c, a, _ in parts[start : start + 200]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    for batch in batches:
        for chunk, shard, kind, h, n in zip(*(batch.column(c).to_pylist() for c in ("chunk", "shard", "kind", "h", "n"))):
            if shard != now:
                if now is not None:
                    yield from flush()
                now, kept = shard, [[], []]
            kept[kind].append((chunk, h, n))
    if now is not None:
        yield from flush()


def _scored(row: dict, answers: list[list[bytes]], shards: int, head: tuple[np.ndarray, np.ndarray], n_train: int, n_words: int, strength: float) -> tuple:
    """Per text of a chunk: tokens, known tokens of the head, their part of the base score, model score; the other words' hashes and where each text's end."""
    words, tokens, sizes = _unpack(row["words"], np.uint64), _unpack(row["tokens"], np.uint32), _unpack(row["sizes"], np.uint32).astype(np.int64)
    (_, word_at), (_, pair_at) = _ngrams(words, tokens, shards)
    of_level = count_of_level()
    count, pairs = (of_level[np.concatenate([_unpack(x, np.uint8) for x in part])[at]] for part, at in zip(answers, (word_at, pair_at)))
    del pair_at
    keys, counts = head
    at = np.minimum(np.searchsorted(keys, words), max(0, len(keys) - 1))
    exact = np.where(keys[at] == words, counts[at], -1) if len(keys) else np.full(len(words), -1)
    starts = np.cumsum(sizes) - sizes
    before, own = count[np.concatenate([[0], tokens[:-1]])], count[tokens]  # a text's first word follows an end
    pairs = np.minimum(pairs, np.minimum(before, own))  # a pair is no more frequent than its words
    chance = (pairs + strength * ((own + 1) / (n_train + n_words + 1))) / (before + strength)
    score = np.add.reduceat(np.log10(chance), starts)
    base = np.add.reduceat(np.where(exact > 0, np.log10(np.maximum(exact, 0) + 1), 0.0)[tokens], starts) - sizes * np.log10(n_train + n_words + 1)
    other = exact[tokens] < 0
    known = np.add.reduceat((exact > 0)[tokens].astype(np.int64), starts)
    ends = np.concatenate([[0], np.cumsum(np.add.reduceat(other.astype(np.int64), starts))])
    return sizes, known, base, score, words[tokens[other]].view(np.int64), ends


def score_texts(df: DataFrame, folds: int = 7, held_fold: int = 2, strength: float = STRENGTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    Rows whose id's crc32 modulo ``folds`` is ``held_fold`` are held out, all others teach (a NULL id
    isn't held out). A NULL or empty text is one end token. Repeated rows teach and are scored
    each; other columns are ignored. With nothing to learn from, all tokens are unknown.
    """
    spark = df.sparkSession
    held_out = F.coalesce(id_fold("doc_id", folds) == held_fold, F.lit(False))
    rows = df.select("doc_id", "text", held_out.alias("held_out"))
    shards = max(SHARDS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = df.schema["doc_id"].dataType.simpleString()
    packed = cut_lineage(rows.mapInArrow(_chunks, f"chunk long, doc_id array<{kind}>, held_out array<boolean>, sizes binary, tokens binary, words binary"))
    asked = packed.select("chunk", "held_out", "sizes", "tokens", "words").mapInArrow(lambda batches: _asked(batches, shards), "chunk long, shard int, kind int, h binary, n binary")
    ordered = asked.repartition("shard").sortWithinPartitions("shard")
    learned = cut_lineage(ordered.mapInArrow(lambda batches: _answered(batches, shards), "kind int, chunk long, shard int, h long, n long, data binary"))
    words = learned.where("kind = 2").select("h", "n")
    n_train, n_words = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # the most frequent words, whole steps of the count, at most HEAD of them
    step = F.floor(F.log2("n") * 8).cast("int")
    least, total = 1 << 30, 0
    for r in sorted(words.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        total += r["count"]
        if total > HEAD:
            break
        least = r["step"]
    top = words.where(step >= least).toPandas().sort_values("h", key=lambda s: s.astype("uint64"))
    head = (top["h"].to_numpy(dtype=np.int64).view(np.uint64), top["n"].to_numpy(dtype=np.int64))
    sent = spark.sparkContext.broadcast(head)
    schema = T._parse_datatype_string(f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, rest array<long>")

    def run(batches):
        row, answers = None, [[], []]

        def scored() -> pa.RecordBatch:
            *columns, rest, ends = _scored(row, answers, shards, sent.value, n_train, n_words, strength)
            first = row["chunk"] << 24
            columns = [np.arange(first, first + len(columns[0])), *row["docs"], *columns]
            return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rest))], names=schema.names)

        for batch in batches:
            chunks, kinds, data = (batch.column(c).to_pylist() for c in ("chunk", "kind", "data"))
            for at, (chunk, kind) in enumerate(zip(chunks, kinds)):
                if kind >= 0:
                    answers[kind].append(data[at])
                    continue
                if row:
                    yield scored()
                row, answers = {c: batch.column(c)[at].as_py() for c in ("sizes", "tokens", "words")}, [[], []]
                row |= {"chunk": chunk, "docs": [batch.column(c)[at].values for c in ("doc_id", "held_out")]}
        if row:
            yield scored()

    texts = packed.withColumns({"kind": F.lit(-1), "shard": F.lit(-1)})
    levels = learned.where("kind < 2").select("chunk", "kind", "shard", "data")
    met = texts.unionByName(levels, allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk", "kind", "shard")
    scored = cut_lineage(met.mapInArrow(run, schema))
    tail = cut_lineage(words.where(step < least))
    rest = scored.select("row", F.explode("rest").alias("h")).join(tail, "h").groupBy("row").agg(F.sum(F.log10(F.col("n") + 1)).alias("more_base"), F.count("*").alias("more_known"))
    nothing = F.lit(0)
    return scored.join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", nothing)).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        "score",
    )
