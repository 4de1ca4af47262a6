"""Encoding and decoding with a merge-type SentencePiece vocabulary.

The merge agenda is our own: all adjacent symbol pairs that form a piece wait, best score
first, leftmost first among equals; a merge takes the pairs it makes stale off the agenda and
adds the two new ones. Short chunks advance together, one row of a matrix each, one merge a
round; a long chunk keeps its agenda in a heap. Symbols that are no piece fall back to bytes.

If no piece holds a space mark after another character, no merge can cross the start of a run
of marks, so a text falls apart into chunks (marks and the word after them) that are encoded on
their own and remembered. Every newly met chunk of an Arrow batch is compared with the
``sentencepiece`` library in one call; a difference raises. Decoding is the library's.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import sys
import types
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from twinframe.llm.common import slices, strings

MARK = "▁"
REMEMBERED = 300_000  # chunks kept in a task; a fuller memory is emptied
LONG_CHUNK = 64  # longer chunks are not kept
WIDTHS = (8, 16, 32)  # chunks up to these lengths share an agenda matrix
NEVER = np.inf  # the cost of a pair that is no piece


class Pieces:
    """A vocabulary with its merge agenda and the library's processor."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        plain = [i for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_byte(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.ids = {lib.id_to_piece(i): i for i in plain}
        self.cost = {p: -lib.get_score(i) for p, i in self.ids.items()}
        self.unknown = lib.unk_id()
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.has_bytes = all(lib.is_byte(i) for i in self.bytes)
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.chunks = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+") if self.splits else re.compile(r"(?s).+")
        self.known: dict[str, list[int]] = {}
        self.decimal = [str(i) for i in range(lib.get_piece_size())]
        self._tables()

    def _tables(self) -> None:
        """Symbol numbers (a piece's id, or a number past all ids for another character) and the mergeable pairs."""
        self.first_other = self.library.get_piece_size()
        self.base = self.first_other + 0x110000
        self.number = np.arange(0x110000, dtype=np.int64) + self.first_other
        for piece, at in self.ids.items():
            if len(piece) == 1:
                self.number[ord(piece)] = at
        symbol = lambda s: self.ids.get(s, self.first_other + ord(s) if len(s) == 1 else None)
        pairs = {}
        for piece, at in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = symbol(piece[:cut]), symbol(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * self.base + right] = (self.cost[piece], at)
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_cost = np.array([pairs[k][0] for k in self.pair_keys.tolist()] + [NEVER])
        self.pair_made = np.array([pairs[k][1] for k in self.pair_keys.tolist()] + [0], dtype=np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cost and merged symbol of pairs; an absent symbol is negative and never merges."""
        key = np.where((left < 0) | (right < 0), -1, left * self.base + right)
        at = np.searchsorted(self.pair_keys, key)
        at = np.where((at < len(self.pair_keys)) & (self.pair_keys[np.minimum(at, len(self.pair_keys) - 1)] == key), at, len(self.pair_keys))
        return self.pair_cost[at], self.pair_made[at]

    def merge_together(self, chunks: list[str], width: int) -> list[list[int]]:
        """The ids of chunks of at most ``width`` characters; every round merges each chunk's best pair."""
        n = len(chunks)
        sizes = np.fromiter(map(len, chunks), dtype=np.int64, count=n)
        inside = np.arange(width) < sizes[:, None]
        symbols = np.full((n, width), -1, dtype=np.int64)
        symbols[inside] = self.number[np.frombuffer("".join(chunks).encode("utf-32-le"), dtype=np.uint32)]
        cost, made = self._pairs(symbols[:, :-1], symbols[:, 1:])
        done, rows, place = symbols.copy(), np.arange(n), np.arange(width)
        while len(rows):
            best = cost.argmin(axis=1)
            line = np.arange(len(rows))
            merges = cost[line, best] < NEVER
            if not merges.all():
                done[rows[~merges]] = symbols[~merges]
                rows, symbols, cost, made, best = rows[merges], symbols[merges], cost[merges], made[merges], best[merges]
                line = line[: len(rows)]
            if not len(rows):
                break
            merged = made[line, best]
            shift = lambda m, fill: np.concatenate([m[:, 1:], np.full((len(m), 1), fill, m.dtype)], axis=1)
            symbols = np.where(place <= best[:, None], symbols, shift(symbols, -1))
            symbols[line, best] = merged
            keep = place[:-1] < best[:, None]
            cost, made = np.where(keep, cost, shift(cost, NEVER)), np.where(keep, made, shift(made, 0))
            inner = best < width - 1
            cost[line[inner], best[inner]], made[line[inner], best[inner]] = self._pairs(merged[inner], symbols[line[inner], best[inner] + 1])
            later = best > 0
            cost[line[later], best[later] - 1], made[line[later], best[later] - 1] = self._pairs(symbols[line[later], best[later] - 1], merged[later])
        left = (done >= 0).sum(axis=1).tolist()
        odd = (done >= self.first_other).any(axis=1).tolist()
        return [self._fall_back(row[:k]) if other else row[:k] for row, k, other in zip(done.tolist(), left, odd)]

    def _fall_back(self, numbers: list[int]) -> list[int]:
        out: list[int] = []
        for x in numbers:
            if x < self.first_other:
                out.append(x)
            elif self.has_bytes:
                out.extend(self.bytes[b] for b in chr(x - self.first_other).encode())
            else:
                out.append(self.unknown)
        return out

    def merge(self, chunk: str) -> list[str]:
        """The chunk's symbols after all merges of the agenda."""
        cost, symbols, n = self.cost, list(chunk), len(chunk)
        agenda = []
        for at in range(n - 1):
            pair = symbols[at] + symbols[at + 1]
            if pair in cost:
                agenda.append((cost[pair], at, pair))
        if not agenda:
            return symbols
        heapq.heapify(agenda)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while agenda:
            _, at, pair = heapq.heappop(agenda)
            right = after[at]
            if not symbols[at] or right >= n or len(symbols[at]) + len(symbols[right]) != len(pair):
                continue  # one of the two was merged since
            symbols[at], symbols[right] = pair, ""
            after[at] = beyond = after[right]
            if beyond < n:
                before[beyond] = at
                wider = pair + symbols[beyond]
                if wider in cost:
                    heapq.heappush(agenda, (cost[wider], at, wider))
            left = before[at]
            if left >= 0:
                wider = symbols[left] + pair
                if wider in cost:
                    heapq.heappush(agenda, (cost[wider], left, wider))
        return [s for s in symbols if s]

    def chunk_ids(self, chunk: str) -> list[int]:
        out: list[int] = []
        for symbol in self.merge(chunk):
            if symbol in self.ids:
                out.append(self.ids[symbol])
            elif self.has_bytes:
                out.extend(self.bytes[b] for b in symbol.encode())
            else:
                out.append(self.unknown)
        return out

    def _learn(self, fresh: list[str]) -> None:
        """Encode new chunks and hold them against the library."""
        shorter = 0
        for width in (*WIDTHS, None):
            some = [c for c in fresh if shorter < len(c) and (width is None or len(c) <= width)]
            ours = self.merge_together(some, width) if width else [self.chunk_ids(c) for c in some]
            # the library puts the first mark there itself; it gives nothing for an empty text, so a lone mark can't be asked for
            theirs = self.library.encode([c[1:].replace(MARK, " ") for c in some], num_threads=1)
            if ours != theirs:
                for chunk, mine, other in zip(some, ours, theirs, strict=True):
                    if mine != other and chunk != MARK:
                        raise ValueError(f"the agenda and the library disagree on {chunk[:80]!r}: {mine[:20]} and {other[:20]}")
            self.known.update(zip(some, ours))
            shorter = width

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """The ids of every text."""
        split = [self.chunks.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        fresh = set().union(*split).difference(self.known)
        self._learn(list(fresh))
        of = self.known.__getitem__
        out = [list(chain.from_iterable(map(of, chunks))) for chunks in split]
        for chunk in fresh:
            if len(chunk) > LONG_CHUNK:
                del self.known[chunk]
        return out


def pieces_of_worker(model_file: str) -> Pieces:
    """One vocabulary per Python worker and file, kept between tasks."""
    kept = sys.modules.setdefault("_twinframe_kept", types.ModuleType("_twinframe_kept")).__dict__
    if ("pieces", model_file) not in kept:
        kept["pieces", model_file] = Pieces(model_file)
    return kept["pieces", model_file]


def with_pieces(df: DataFrame, model_file: str, text: str = "text", keep_ids: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Encode and decode every whole text.

    Returns the columns ``keep`` (default: all) and ``n_tokens``, ``ids_sha256`` (of the decimal
    ids joined by commas), ``decoded_sha256`` (of the decoded text in UTF-8), with ``keep_ids``
    also ``ids``. A kept column with one of these names is replaced. A NULL text counts as empty:
    no ids, and the digests of nothing. Repeated rows are encoded each; an empty table gives none.
    ``model_file`` must exist on every executor.
    """
    made = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    made += [("ids", T.ArrayType(T.IntegerType()))] if keep_ids else []
    kept = [n for n in (df.columns if keep is None else keep) if n not in dict(made)]
    at = len(kept)
    schema = T.StructType([T.StructField(f"of_{i}", df.schema[n].dataType) for i, n in enumerate(kept)] + [T.StructField(n, t) for n, t in made])
    types_ = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]

    def run(batches):
        pieces = pieces_of_worker(model_file)
        for batch in slices(batches):
            yield step(pieces, batch)
        pieces.known.clear()  # the worker goes on to other tasks

    def step(pieces: Pieces, batch: pa.RecordBatch) -> pa.RecordBatch:
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        n, ids_sha, decoded, all_ids = [], [], [], []
        texts = strings(batch, "text")
        for start in range(0, len(texts), 256):
            for ids in pieces.encode_batch(texts[start : start + 256]):
                n.append(len(ids))
                ids_sha.append(sha(",".join(map(pieces.decimal.__getitem__, ids))))
                decoded.append(sha(pieces.library.decode(ids) if ids else ""))
                if keep_ids:
                    all_ids.append(ids)
        columns = [pa.array(x, t) for x, t in zip([n, ids_sha, decoded, all_ids][: len(made)], types_)]
        return pa.RecordBatch.from_arrays(batch.columns[:at] + columns, names=schema.names)

    quoted = lambda n: df["`" + n.replace("`", "``") + "`"]
    read = df.select(*[quoted(n).alias(f"of_{i}") for i, n in enumerate(kept)], quoted(text).alias("text"))
    return read.mapInArrow(run, schema).toDF(*kept, *dict(made))
