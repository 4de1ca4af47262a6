"""Token counts by a transducer compiled from a merge vocabulary, run over chunks of texts side by side.

Merging by score has two properties that make it finite-state. Leaving out the last tokens of an
encoding leaves the encoding of the shorter text, and neighbours stay apart in a whole text exactly
if they stay apart on their own. So the last token of a prefix follows from the last tokens of the
shorter prefixes at which a piece could still have started. Such a list is a state; a transition
reads one character and is annotated with the number of tokens that the prefix gains (or loses, if
it merges some). Transitions are compiled when first met.

A text is cut into chunks, and all chunks of an Arrow slice advance together, one character a step.
Each chunk has a state map: exit state and token count by entry state, tabulated for a guess first
and then for every state in which the chunk before it can end; a run stops as soon as it meets the
guess's run, which is after a few characters as a rule. The maps of a text's chunks are then composed
by a parallel prefix scan (pointer doubling), so no text is walked from end to end.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from twinframe.llm.common import kept_in_worker, slices, strings

MARK = "▁"
CHUNK = 256  # characters a chunk
TOGETHER = 1 << 20  # characters whose chunks advance together; a longer text comes in several turns
STATES = 150_000  # a fuller transducer is compiled anew
REMEMBERED = 400_000  # answers about pairs of tokens
FEW = 12  # tokens with a common beginning that are tried one by one
WALL = 0  # stands for a last token that can't merge with what follows
ROOT = 0  # of the tree of prefixes of pieces
START = 0  # the state before any character
NEVER = float("inf")  # the cost of a pair that is no piece
_EMIT_BITS, _EMIT_ZERO = 16, 1 << 15


class Transitions:
    """An open-addressed table from (state, class) to (state, tokens gained), read and written by whole arrays."""

    def __init__(self) -> None:
        self.size = 0
        self._make(1 << 16)

    def _make(self, slots: int) -> None:
        self.shift = np.uint64(64 - (slots.bit_length() - 1))
        self.keys = np.full(slots, -1, dtype=np.int64)
        self.values = np.zeros(slots, dtype=np.int64)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and the places of keys that are absent."""
        slot = self._home(keys)
        values, missing = self.values[slot], []
        at = np.flatnonzero(self.keys[slot] != keys)
        slot = slot[at]
        while len(at):
            empty = self.keys[slot] == -1
            missing.append(at[empty])
            at, slot = at[~empty], (slot[~empty] + 1) & (len(self.keys) - 1)
            hit = self.keys[slot] == keys[at]
            values[at[hit]] = self.values[slot[hit]]
            at, slot = at[~hit], slot[~hit]
        return values, np.concatenate(missing) if missing else at

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Put absent, distinct keys in."""
        self.size += len(keys)
        if 3 * self.size > len(self.keys):
            held = self.keys >= 0
            keys, values = np.concatenate([self.keys[held], keys]), np.concatenate([self.values[held], values])
            self._make(1 << (4 * self.size).bit_length())
        slot = self._home(keys)
        while len(keys):
            _, first = np.unique(slot, return_index=True)
            first = first[self.keys[slot[first]] == -1]
            self.keys[slot[first]], self.values[slot[first]] = keys[first], values[first]
            left = np.ones(len(keys), dtype=bool)
            left[first] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & (len(self.keys) - 1)


class Transducer:
    """The compiled automaton of one vocabulary."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        plain = [i for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_byte(i) or lib.is_unknown(i) or lib.is_unused(i))]
        if not all(lib.is_byte(lib.piece_to_id(f"<0x{b:02X}>")) for b in range(256)):
            raise ValueError("the vocabulary has no byte pieces")
        self.cost = {lib.id_to_piece(i): -lib.get_score(i) for i in plain}
        letters = sorted({c for piece in self.cost for c in piece} | {MARK})
        # classes of characters: one for each that occurs in a piece, and one for each UTF-8 length of others
        self.letters: list[str | None] = [None] * 4 + letters
        self.class_of = np.zeros(0x110000, dtype=np.int16)
        for size, least in enumerate((0, 0x80, 0x800, 0x10000)):
            self.class_of[least:] = size
        for at, letter in enumerate(letters, 4):
            self.class_of[ord(letter)] = at
        self.class_of[ord(" ")] = self.class_of[ord(MARK)]
        # the tree of prefixes; every letter is a node below the root
        self.texts, self.below = [""], {}
        for word in [*letters, *self.cost]:
            node = ROOT
            for letter in word:
                nxt = self.below.get((node, letter))
                if nxt is None:
                    nxt = self.below[node, letter] = len(self.texts)
                    self.texts.append(self.texts[node] + letter)
                node = nxt
        self.node_of = node_of = {text: node for node, text in enumerate(self.texts)}
        # the tokens that begin with a node's text, where they are few
        self.longer: list[list[int]] = [[] for _ in self.texts]
        for node, text in enumerate(self.texts):
            if node and (len(text) == 1 or text in self.cost):
                for end in range(len(text), 0, -1):
                    above = self.longer[node_of[text[:end]]]
                    if len(above) <= FEW:
                        above.append(node)
        self.whole: dict[int, bool] = {}
        self.edges: dict[tuple[int, bool], list[str]] = {}
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple[tuple[int, int, int], ...]] = [((ROOT, WALL, 0),)]
        self.number = {self.states[0]: START}
        self.apart: dict[int, bool] = {}
        self.alike: dict[int, int | None] = {}
        self.first_like: dict[tuple[int, tuple[int, ...]], int] = {}
        self.table = Transitions()

    # compilation

    def merges(self, text: str) -> Iterator[list[str]]:
        """The symbols of a short text before and after each merge, best score first, leftmost among equals."""
        cost, parts = self.cost, list(text)
        costs = [cost.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        yield parts
        while costs and (best := min(costs)) < NEVER:
            at = costs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del costs[at]
            if at:
                costs[at - 1] = cost.get(parts[at - 1] + parts[at], NEVER)
            if at < len(costs):
                costs[at] = cost.get(parts[at] + parts[at + 1], NEVER)
            yield parts

    def is_token(self, node: int) -> bool:
        """Does the node's text stay one symbol?"""
        if node not in self.whole:
            *_, last = self.merges(self.texts[node])
            self.whole[node] = len(last) == 1
        return self.whole[node]

    def edge(self, node: int, right: bool) -> list[str]:
        """All symbols that stand at the left or right end of a token while it is merged."""
        if (node, right) not in self.edges:
            self.edges[node, right] = list(dict.fromkeys(parts[-1 if right else 0] for parts in self.merges(self.texts[node])))
        return self.edges[node, right]

    def stand_in(self, before: int, node: int) -> int | None:
        """The token that stands for all those that do as well before the tokens that begin with the node's text.

        None if nothing can follow. Where few tokens begin so, those that stay apart decide; else the
        wall stands for tokens whose right end can't merge.
        """
        key = before * len(self.texts) + node
        if key not in self.alike:
            if len(self.longer[node]) <= FEW:
                fits = tuple(t for t in self.longer[node] if self.is_token(t) and self.stay_apart(before, t))
                found = self.first_like.setdefault((node, fits), before) if fits else None
            else:
                text = self.texts[node]
                meets = before != WALL and any(
                    self.node_of.get(r + text, ROOT) != ROOT or any(r + text[:i] in self.cost for i in range(1, len(text))) for r in self.edge(before, True)
                )
                found = before if meets else WALL
            self.alike[key] = found
        return self.alike[key]

    def stay_apart(self, left: int, right: int) -> bool:
        """Do two tokens next to each other stay as they are?"""
        if left == WALL:
            return True
        key = left * len(self.texts) + right
        if key not in self.apart:
            if len(self.apart) > REMEMBERED:
                self.apart.clear()
            a, b = self.texts[left], self.texts[right]
            apart = True
            if any(r + x in self.cost for r in self.edge(left, True) for x in self.edge(right, False)):
                *_, last = self.merges(a + b)
                apart = last == [a, b]
            self.apart[key] = apart
        return self.apart[key]

    def compile(self, state: int, kind: int) -> int:
        """The packed transition of a state for a class of characters.

        A state lists, for each start that a piece may still have, the node read since, the last
        token before it and the tokens before it less those of the whole prefix; the root comes last.
        """
        letter = self.letters[kind]
        if letter is None:
            return START << _EMIT_BITS | _EMIT_ZERO + kind + 1
        gained, last, grown = 0, WALL, []
        for node, before, offset in self.states[state]:
            child = self.below.get((node, letter))
            if child is None:
                continue
            if last == WALL and self.is_token(child) and self.stay_apart(before, child):
                text = self.texts[child]
                last, gained = child, offset + (1 if text in self.cost else len(text.encode()))
            before = self.stand_in(before, child)
            if before is not None:
                grown.append((child, before, offset))
        made = (*[(child, before, offset - gained) for child, before, offset in grown], (ROOT, last, 0))
        number = self.number.setdefault(made, len(self.states))
        if number == len(self.states):
            self.states.append(made)
        return number << _EMIT_BITS | _EMIT_ZERO + gained

    # execution

    def step(self, states: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and tokens gained of many chunks."""
        keys = states * len(self.letters) + kinds
        values, missing = self.table.find(keys)
        if len(missing):
            new, where = np.unique(keys[missing], return_inverse=True)
            made = np.array([self.compile(*divmod(k, len(self.letters))) for k in new.tolist()], dtype=np.int64)
            self.table.add(new, made)
            values[missing] = made[where]
        return values >> _EMIT_BITS, (values & ((1 << _EMIT_BITS) - 1)) - _EMIT_ZERO

    def run(self, texts: list[str], entries: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and exit state of each non-empty text, read from its entry state."""
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        kinds = self.class_of[np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)]
        parts = -(-sizes // CHUNK)
        first = np.cumsum(parts) - parts  # a text's first chunk
        owner = np.repeat(np.arange(len(texts)), parts)
        within = np.arange(len(owner)) - first[owner]
        start = (np.cumsum(sizes) - sizes)[owner] + within * CHUNK
        length = np.minimum(CHUNK, sizes[owner] - within * CHUNK)
        goes_on = within < parts[owner] - 1
        begins = np.zeros(len(owner), dtype=np.int64)
        begins[first] = entries

        # state maps for the first guess; longer chunks come first, so that those still running are a prefix
        order = np.argsort(-length, kind="stable")
        held = np.zeros((CHUNK, len(owner)), dtype=np.int32)
        total = np.zeros((CHUNK, len(owner)), dtype=np.int32)
        state, count = begins[order], np.zeros(len(owner), dtype=np.int64)
        for j in range(int(length.max())):
            on = int(np.searchsorted(-length[order], -j, side="left"))
            state[:on], gained = self.step(state[:on], kinds[start[order[:on]] + j])
            count[:on] += gained
            held[j], total[j] = state, count
        column = np.empty_like(order)
        column[order] = np.arange(len(order))
        ends, counts = state[column], count[column]

        # the maps for every other state in which the chunk before may end
        wide = 1 << 32
        maps = [(np.arange(len(owner)) * wide + begins, ends, counts)]
        known, at, entry = maps[0][0], np.flatnonzero(goes_on), ends[goes_on]
        while True:
            need = np.setdiff1d((at + 1) * wide + entry, known)
            if not len(need):
                break
            at = need // wide
            out, gain = self._meet(need % wide, kinds, start[at], length[at], held, total, column[at])
            maps.append((need, out, gain))
            known = np.union1d(known, need)
            more = goes_on[at]
            at, entry = at[more], out[more]

        # composition: each round doubles the number of chunks that a map spans
        keys, ends, counts = (np.concatenate(x) for x in zip(*maps))
        by = np.argsort(keys)
        keys, ends, counts = keys[by], np.append(ends[by], 0), np.append(counts[by], 0)
        last = len(keys)
        follow = np.where(goes_on[keys // wide], np.searchsorted(keys, (keys // wide + 1) * wide + ends[:-1]), last)
        follow = np.append(follow, last)
        while (follow != last).any():
            counts = counts + counts[follow]
            ends = np.where(follow == last, ends, ends[follow])
            follow = follow[follow]
        heads = np.searchsorted(keys, first * wide + np.array(entries, dtype=np.int64))
        return counts[heads], ends[heads]

    def _meet(self, state, kinds, start, length, held, total, column) -> tuple[np.ndarray, np.ndarray]:
        """Exit states and counts of chunks from other entry states, each run until it meets the first one."""
        out, gain = np.zeros(len(state), dtype=np.int64), np.zeros(len(state), dtype=np.int64)
        live, count, state, j = np.arange(len(state)), np.zeros(len(state), dtype=np.int64), state.copy(), 0
        while len(live):
            state, gained = self.step(state, kinds[start[live] + j])
            count += gained
            met = state == held[j, column[live]]
            over = met | (j + 1 >= length[live])
            done = live[over]
            final = length[done] - 1
            out[done] = np.where(met[over], held[final, column[done]], state[over])
            rest = total[final, column[done]] - total[j, column[done]]
            gain[done] = count[over] + np.where(met[over], rest, 0)
            live, state, count, j = live[~over], state[~over], count[~over], j + 1
        return out, gain

    def counts(self, texts: Iterable[str]) -> list[int]:
        """The number of tokens of every text."""
        out: list[int] = []
        waiting: list[tuple[int, str]] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if len(self.states) > STATES:
                self.reset()
            if waiting:
                found, _ = self.run([t for _, t in waiting], [START] * len(waiting))
                for (at, _), n in zip(waiting, found.tolist()):
                    out[at] = n
            waiting.clear()
            size = 0

        for text in texts:
            out.append(0)
            if len(text) >= TOGETHER:
                state = START
                for begin in range(-1, len(text), TOGETHER):
                    piece = MARK * (begin < 0) + text[max(0, begin) : begin + TOGETHER]
                    found, left = self.run([piece], [state])
                    out[-1], state = out[-1] + int(found[0]), int(left[0])
            elif text:
                if size + len(text) > TOGETHER:
                    flush()
                waiting.append((len(out) - 1, MARK + text))
                size += len(text) + 1
        flush()
        return out


def count_tokens(df: DataFrame, model_file: str, limit: int = 4096, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Count the tokens of every whole text.

    Returns the columns ``keep`` (default: all) with ``n_bytes`` (UTF-8), ``n_tokens`` and
    ``over_limit`` (more than ``limit`` tokens); kept columns with these names are replaced. A NULL
    text counts as empty: no bytes and no tokens. Repeated rows are counted each, an empty table
    gives none. ``model_file`` (a merge vocabulary with byte pieces, no normalisation) must exist on
    every executor.
    """
    made = [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())]
    kept = [n for n in (df.columns if keep is None else keep) if n not in dict(made)]
    at = len(kept)
    fields = [T.StructField(f"kept_{i}", df.schema[n].dataType) for i, n in enumerate(kept)]
    schema = T.StructType(fields + [T.StructField(n, t) for n, t in made])

    def run(batches):
        transducer = kept_in_worker(("transducer", model_file), lambda: Transducer(model_file))
        for batch in slices(batches):
            texts = strings(batch, "text")
            sizes = [len(t.encode()) for t in texts]
            counts = transducer.counts(texts)
            columns = [pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())]
            yield pa.RecordBatch.from_arrays(batch.columns[:at] + columns, names=schema.names)

    quoted = lambda n: df["`" + n.replace("`", "``") + "`"]
    read = df.select(*[quoted(n).alias(f"kept_{i}") for i, n in enumerate(kept)], quoted(text).alias("text"))
    return read.mapInArrow(run, schema).toDF(*kept, *dict(made))
