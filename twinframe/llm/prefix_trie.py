"""The trie of conversation prefixes, from sorted conversations and range minima over their common prefixes.

A conversation is the string of its turns' digests, so that conversations with a common beginning
are neighbours once sorted. All conversations are sorted by range partitioning on (digests, id):
copies of one conversation, however many, spread over ranges too. Within a range, equal ones are one
row, and a sparse table over the common prefixes of neighbours (``lcp``) answers range minima. Every
candidate prefix, a row and a depth, finds the left and right end of its interval by binary search in
that table, on its own; interval sums and a second sparse table (of ids) give its figures.

Prefixes of a range's first and last row may go on in the next range: these are open. Each range
hands over its two rows with what it knows of their prefixes, two rows a range, and one task merges
these by the same search. Everything else is final within its range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.llm.common import cut_lineage, shuffle_partitions

WORD = r"[^\x20\x09-\x0D]+"
GROUP = 20  # ids that share the beginning of their first one
MOST_SHARED = 3  # turns
TURN = 20  # bytes a turn: 16 of a digest, 4 of a word count
ROWS_PER_RANGE = 100_000
BYTES_PER_RANGE = 16 << 20
IDS_PER_CHUNK = 8_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

_NODE = "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_FOUND = f"kind string, side int, place int, open_depth int, turns binary, part long, ids string, sums array<array<long>>, ends array<string>, {_NODE}"
_OPEN = f"kind string, side int, place int, open_depth int, turns binary, {_NODE}"
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<array<long>>": pa.list_(pa.list_(pa.int64())), "array<string>": pa.list_(pa.string())}


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def _batch(schema: str, rows: int, **columns) -> pa.RecordBatch:
    """A batch with the given columns; others are NULL, and a text stands for a whole column of it."""
    of = lambda name: [columns.get(name)] * rows if isinstance(columns.get(name), str | int | None) else columns[name]
    kinds = [_ARROW[field.split()[1]] for field in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(of(n), t) for n, t in zip(_names(schema), kinds)], names=_names(schema))


def shared_turns(conv_id: str) -> Column:
    """How many turns a conversation takes from the first one of its group."""
    return F.crc32(F.col(conv_id).cast("string").cast("binary")) % (MOST_SHARED + 1)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): every conversation's turns, its first ones replaced by those of its group's first.

    ``turns`` is a binary string with ``TURN`` bytes a turn. NULL role or text counts as empty; turns come
    by number, NULL first, equal numbers by digest. Rows without a conversation id form none.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32)
    words = F.lpad(F.lower(F.hex(F.regexp_count(text, F.lit(WORD)))), 8, "0")
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.concat(digest, words).alias("key"))
    # a NULL number sorts first among structs too
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("turn", "key"))), lambda x: x["key"])
    own = cut_lineage(turns.groupBy("conv_id").agg(ordered.alias("keys")))
    heads = own.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("first"), F.slice("keys", 1, MOST_SHARED).alias("head"))
    joined = own.withColumn("first", F.col("conv_id") - F.col("conv_id") % GROUP).withColumn("h", shared_turns("conv_id").cast("int")).join(heads, "first", "left")
    taken = F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), F.col("h"))
    rest = F.slice("keys", F.col("h") + 1, F.size("keys"))
    return joined.select("conv_id", F.unhex(F.array_join(F.concat(taken, rest), "")).alias("turns"))


def sparse_minima(values: np.ndarray) -> list[np.ndarray]:
    """Level k holds the minimum of every 2^k values from each place on."""
    levels, width = [values], 1
    while 2 * width <= len(values):
        levels.append(np.minimum(levels[-1][:-width], levels[-1][width:]))
        width *= 2
    return levels


def range_minimum(levels: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The minimum of values left..right (both included) by two overlapping powers of two."""
    level = np.log2(right - left + 1).astype(np.int64)
    out = np.empty(len(left), dtype=levels[0].dtype)
    for k in np.unique(level).tolist():
        at = level == k
        out[at] = np.minimum(levels[k][left[at]], levels[k][right[at] - (1 << k) + 1])
    return out


def extents(levels: list[np.ndarray], row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row that share ``depth`` turns with ``row``; ``levels`` of lcp, whose value i is between rows i - 1 and i."""
    n = len(levels[0])
    left, right = row.copy(), row.copy()
    for k in range(len(levels) - 1, -1, -1):
        width = 1 << k
        start = left - width + 1
        fits = start >= 1
        fits[fits] = levels[k][start[fits]] >= depth[fits]
        left[fits] -= width
        fits = right + width < n
        fits[fits] = levels[k][right[fits] + 1] >= depth[fits]
        right[fits] += width
    return left, right


class Sorted:
    """Different conversations in order, with sums that give any interval's figures."""

    def __init__(self, rows: list[bytes]) -> None:
        self.rows = rows
        self.length = np.fromiter((len(r) // TURN for r in rows), dtype=np.int64, count=len(rows))
        self.first = np.cumsum(self.length) - self.length
        whole = np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(-1, TURN)
        self.digest = np.ascontiguousarray(whole[:, :16]).view(np.uint64).reshape(-1, 2)
        self.words = np.ascontiguousarray(whole[:, 16:]).view(">u4").astype(np.int64).ravel()
        self.lcp = np.zeros(len(rows), dtype=np.int64)
        live = np.arange(1, len(rows))
        depth = 0
        while len(live):
            live = live[(self.length[live] > depth) & (self.length[live - 1] > depth)]
            a, b = self.digest[self.first[live] + depth], self.digest[self.first[live - 1] + depth]
            live = live[(a == b).all(axis=1)]
            depth += 1
            self.lcp[live] = depth
        self.levels = sparse_minima(self.lcp)

    def last_words(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Words of the last turn of prefixes; none of the empty one."""
        words = np.append(self.words, 0)
        return words[np.where(depth > 0, self.first[row] + depth - 1, len(self.words))]

    def prefixes(self, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, depth) of each row's prefixes deeper than ``least``."""
        count = np.maximum(self.length - least, 0)
        row = np.repeat(np.arange(len(self.rows)), count)
        depth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + 1 + least[row]
        return row, depth


def _running(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values)])


def _of_range(place: int, rows: list[bytes], copies: list[int], least_id: list[int], sha: list[str | None]) -> Iterator[pa.RecordBatch]:
    """Final nodes of one range and its two open rows.

    Per different conversation: its copies, their smallest id, and the digest of their ids (None for
    the first and last row, whose copies may go on elsewhere).
    """
    s, n = Sorted(rows), len(rows)
    ids, till = sparse_minima(np.array(least_id, dtype=np.int64)), _running(np.array(copies, dtype=np.int64))
    # a node is named by its first row; the root (depth 0) is a prefix of the range's first row
    known = np.where(np.arange(n) == 0, -1, s.lcp)
    row, depth = s.prefixes(known)
    base = np.searchsorted(row, np.arange(n))
    left, right = extents(s.levels, row, depth)
    above, _ = extents(s.levels, row, np.maximum(depth - 1, 0))
    parent = np.where(depth > 0, base[above] + depth - 2 - known[above], -1)
    final = (left > 0) & (right < n - 1)
    size, conv = till[right + 1] - till[left], range_minimum(ids, left, right)
    # nodes are in order of (row, depth), so a subtree is a stretch of them
    after, at = np.searchsorted(row, right, side="right"), np.arange(len(row))
    below = depth > 0
    children = np.bincount(parent[below], minlength=len(row))
    final_children = np.bincount(parent[below & final], minlength=len(row))
    saved = _running(np.where(final, (size - 1) * s.last_words(row, depth), 0))
    saved = saved[after] - saved[at]
    leaves = _running(final & (children == 0))
    leaves = leaves[after] - leaves[at]
    ends = [sha[r] if whole else EMPTY_SHA for r, whole in zip(left.tolist(), (depth == s.length[left]).tolist())]

    done = np.flatnonzero(final)
    # an open parent is a prefix of the first row, or else of the last one
    opened = ~final[parent[done]]
    when = lambda chosen, values: [x if c else None for c, x in zip(chosen.tolist(), values.tolist())]
    yield _batch(
        _FOUND,
        len(done),
        kind="node",
        place=place,
        side=when(opened, (left[parent[done]] > 0).astype(int)),
        open_depth=when(opened, depth[done] - 1),
        depth=depth[done],
        conv_id=conv[done],
        parent_conv_id=when(~opened, conv[parent[done]]),
        n_convs=size[done],
        n_children=children[done],
        n_leaves=leaves[done],
        saved_tokens=saved[done],
        ends_sha256=[ends[x] for x in done.tolist()],
    )
    # figures of each open prefix; one that first and last row share is told of the first only
    common = int(range_minimum(s.levels, np.array([1]), np.array([n - 1]))[0]) if n > 1 else 0
    for side, r in ((0, 0), (1, n - 1))[: 1 + (n > 1)]:
        deep = np.arange(s.length[r] + 1)
        start, _ = extents(s.levels, np.full(len(deep), r), deep)
        node = base[start] + deep - 1 - known[start]
        told = (deep > common) | (side == 0)
        sums = np.stack([size[node], conv[node], final_children[node], leaves[node], saved[node]], axis=1)
        sums[~told] = [0, np.iinfo(np.int64).max, 0, 0, 0]
        inside = told & (deep == s.length[start]) & (start > 0) & (start < n - 1)
        own = [ends[x] if i else None for i, x in zip(inside.tolist(), node.tolist())]
        yield _batch(_FOUND, 1, kind="row", place=place, side=side, turns=[rows[r]], sums=[sums.tolist()], ends=[own])


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted range of (turns, conv_id): its final nodes, its open rows and the ids of their copies."""
    place = TaskContext.get().partitionId()
    rows, copies, least, sha = [], [], [], []
    waiting: list[str] = []  # ids of the row at hand that are in no chunk yet
    chunks: list[str] = []  # its chunks that are not handed over; any row but the first may turn out to be the last
    part = 0

    def pack() -> None:
        if waiting:
            chunks.append(",".join(waiting))
            waiting.clear()

    def handed_over() -> Iterator[pa.RecordBatch]:
        nonlocal part
        for text in chunks:
            yield _batch(_FOUND, 1, kind="ids", place=place, turns=[rows[-1]], part=part, ids=text)
            part += 1
        chunks.clear()

    for batch in batches:
        for turns, conv_id in zip(batch.column("turns").to_pylist(), batch.column("conv_id").to_pylist()):
            if rows and turns == rows[-1]:
                copies[-1] += 1
            else:
                pack()
                if len(rows) == 1:
                    yield from handed_over()
                elif rows:
                    sha[-1] = hashlib.sha256(",".join(chunks).encode()).hexdigest()
                    chunks.clear()
                part = 0
                rows.append(turns)
                copies.append(1)
                least.append(conv_id)
                sha.append(None)
            waiting.append(str(conv_id))
            if len(waiting) >= IDS_PER_CHUNK:
                pack()
                if len(rows) == 1:
                    yield from handed_over()
    if rows:
        pack()
        yield from handed_over()
        yield from _of_range(place, rows, copies, least, sha)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All open rows, two a range, in one task: the open nodes, and which of them each range's open prefixes are."""
    given = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["place"], r["side"]))
    if not given:
        return
    s, n = Sorted([r["turns"] for r in given]), len(given)
    row, depth = s.prefixes(np.full(n, -1))
    left, _ = extents(s.levels, row, depth)
    _, head, node = np.unique(left * (int(s.length.max()) + 1) + depth, return_index=True, return_inverse=True)
    sums = np.array([f for r in given for f in r["sums"]], dtype=np.int64).reshape(-1, 5)
    totals = np.zeros((len(head), 5), dtype=np.int64)
    np.add.at(totals, node, sums)
    size, _, children, leaves, saved = totals.T.copy()
    conv = np.full(len(head), np.iinfo(np.int64).max)
    np.minimum.at(conv, node, sums[:, 1])
    ends: list[str | None] = [None] * len(head)
    for at, known in zip(node.tolist(), (e for r in given for e in r["ends"])):
        ends[at] = ends[at] or known
    # a row's prefixes are listed from the root on, so a node's parent comes right before it
    deep = depth[head]
    parent = np.where(deep > 0, node[np.maximum(head - 1, 0)], -1)
    np.add.at(children, parent[deep > 0], 1)
    # what open nodes themselves add to those above them
    more_saved, more_leaves = (size - 1) * s.last_words(row[head], deep), (children == 0).astype(np.int64)
    for d in range(int(deep.max()), 0, -1):
        at = deep == d
        np.add.at(more_saved, parent[at], more_saved[at])
        np.add.at(more_leaves, parent[at], more_leaves[at])
    own: list[bytes | None] = [None] * len(head)
    for at in np.flatnonzero(depth == s.length[row]).tolist():
        own[node[at]] = given[row[at]]["turns"]
    yield _batch(
        _OPEN,
        len(head),
        kind="open",
        turns=own,
        depth=deep,
        conv_id=conv,
        parent_conv_id=[int(conv[p]) if p >= 0 else None for p in parent.tolist()],
        n_convs=size,
        n_children=children,
        n_leaves=leaves + more_leaves,
        saved_tokens=saved + more_saved,
        ends_sha256=ends,
    )
    named = [(given[r]["side"], given[r]["place"]) for r in row.tolist()]
    yield _batch(_OPEN, len(row), kind="place", side=[x for x, _ in named], place=[x for _, x in named], open_depth=depth, conv_id=conv[node])


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each key's chunks of ids, which come in order."""
    key, running = None, hashlib.sha256()
    done: list[tuple[bytes, str]] = []
    for batch in batches:
        for turns, ids in zip(batch.column("turns").to_pylist(), batch.column("ids").to_pylist()):
            if turns != key:
                if key is not None:
                    done.append((key, running.hexdigest()))
                key, running = turns, hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
    if key is not None:
        done.append((key, running.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.binary(), pa.string()))], names=["turns", "sha"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for every different beginning of the rebuilt conversations, the empty one included.

    conv_id (the smallest of its conversations), depth, parent_conv_id (NULL for the root), n_convs,
    n_children, n_leaves (nodes without children in the subtree), saved_tokens (words of last turns
    that a cache of the subtree's prefixes need not read again), ends_sha256 (of the ids of
    conversations that are this beginning and no more).

    NULL role or text counts as empty, a NULL turn number comes first, equal numbers are ordered by
    content, repeated rows are turns of their own. Rows with a NULL conv_id belong to no conversation.
    Other columns are ignored; an empty table has no node. A task holds a range's different
    conversations at 20 bytes a turn; one conversation's turns are gathered in a row.
    """
    every = cut_lineage(rebuilt(conversations.select("conv_id", "turn", "role", "text")))
    n, size = every.agg(F.count("*"), F.sum(F.octet_length("turns"))).first()
    ranges = max(1, -(-n // ROWS_PER_RANGE), -(-(size or 0) // BYTES_PER_RANGE), min(shuffle_partitions(every.sparkSession), n // 1000))
    placed = every.repartitionByRange(ranges, "turns", "conv_id").sortWithinPartitions("turns", "conv_id")
    found = cut_lineage(placed.mapInArrow(_ranges, _FOUND))
    # two rows a range
    merged = cut_lineage(found.where("kind = 'row'").select("place", "side", "turns", "sums", "ends").repartition(1).mapInArrow(_merged, _OPEN))
    chunks = found.where("kind = 'ids'").select("turns", "place", "part", "ids").repartition("turns").sortWithinPartitions("turns", "place", "part")
    sha = cut_lineage(chunks.mapInArrow(_chained, "turns binary, sha string"))
    names, nodes = _names(_NODE), found.where("kind = 'node'")
    above = merged.where("kind = 'place'").select("place", "side", "open_depth", F.col("conv_id").alias("above"))
    below = nodes.where("side IS NOT NULL").join(above, ["place", "side", "open_depth"]).withColumn("parent_conv_id", F.col("above"))
    opened = merged.where("kind = 'open'").join(sha, "turns", "left").withColumn("ends_sha256", F.coalesce("sha", "ends_sha256", F.lit(EMPTY_SHA)))
    parts = [nodes.where("side IS NULL"), below, opened]
    return parts[0].select(*names).unionAll(parts[1].select(*names)).unionAll(parts[2].select(*names))


def prefix_trie_sql() -> str:
    """The same over the view ``conversations``: beginnings as lists, grouped."""
    shifted = "list_reduce(list_prepend(i, repeat([0], 8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda r, b: xor(r >> 8, tab[((xor(r, b) & 255) + 1)::INTEGER])), 4294967295)"
    return f"""WITH crc AS (SELECT list({shifted} ORDER BY i) AS tab FROM (SELECT unnest(range(256))::BIGINT AS i)),
        turns AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS n,
            {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t FROM conversations WHERE conv_id IS NOT NULL),
        own AS MATERIALIZED (SELECT c, list(t ORDER BY n) AS l FROM turns GROUP BY c),
        shared AS (SELECT c, l, c - c % {GROUP} AS f, {crc} % {MOST_SHARED + 1} AS h FROM own, crc),
        whole AS MATERIALIZED (SELECT s.c, list_concat(coalesce(b.l[1:h], []), s.l[h + 1:]) AS l FROM shared s LEFT JOIN own b ON b.c = s.f),
        starts AS (SELECT c, len(l) AS size, unnest(range(len(l) + 1)) AS d, l FROM whole),
        nodes AS MATERIALIZED (SELECT l[1:d] AS p, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs,
            coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE size = d), '') AS ends FROM starts GROUP BY l[1:d]),
        kids AS (SELECT p[1:depth - 1] AS q, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
        one AS MATERIALIZED (SELECT nodes.*, coalesce(kids.n, 0) AS n_children,
            CASE WHEN depth > 0 THEN (n_convs - 1) * len(regexp_extract_all(p[depth].text, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS own
            FROM nodes LEFT JOIN kids ON p = q),
        up AS (SELECT p[1:k] AS p, sum(own)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
            FROM (SELECT p, own, n_children, unnest(range(depth + 1)) AS k FROM one) GROUP BY ALL)
        SELECT a.depth::BIGINT AS depth, a.conv_id, b.conv_id AS parent_conv_id, a.n_convs, a.n_children, n_leaves, saved_tokens, sha256(a.ends) AS ends_sha256
        FROM one a JOIN up ON a.p = up.p LEFT JOIN nodes b ON a.depth > 0 AND b.p = a.p[1:a.depth - 1]"""
