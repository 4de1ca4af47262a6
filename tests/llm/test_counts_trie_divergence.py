"""Token counts, the conversation trie and source divergence against plain counterparts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark import cloudpickle

import twinframe
from twinframe.llm import divergence, prefix_trie as trie, token_transducer
from twinframe.llm.divergence import one_hot_product, source_divergence
from twinframe.llm.prefix_trie import extents, range_minimum, sparse_minima
from twinframe.llm.token_transducer import Transducer, count_tokens

cloudpickle.register_pickle_by_value(twinframe)
MODEL = public_tokenizers.path("piece_bpe_32k.model")

# 12


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def odd_texts():
    draw = random.Random(5)
    made = ["", " ", "  a", "a ", "▁x▁▁", "\x00\x01", "é́ ﬁ①", "日本語🎉", "<s></s><unk><0x41>", "x" * 2000, " " * 300, "\n\n\tdef f():\n" * 40, "ab" * 5000, "=" * 3001]
    for letters, size in (("ab cé▁ 中\n<>‍🙂xyzthe", 60), ("abcdefghijklmnopqrstuvwxyz", 400), ("aeinrst ", 400)):
        made += ["".join(draw.choice(letters) for _ in range(draw.randint(0, size))) for _ in range(150)]
    return made


@pytest.mark.parametrize(("chunk", "together"), [(256, 1 << 20), (3, 1 << 20), (7, 40), (1, 90)])
def test_transducer_equals_the_library(library, monkeypatch, chunk, together):
    monkeypatch.setattr(token_transducer, "CHUNK", chunk)
    monkeypatch.setattr(token_transducer, "TOGETHER", together)
    texts = odd_texts()
    assert Transducer(MODEL).counts(texts) == [len(x) for x in library.encode(texts)]


def test_transducer_compiles_anew_when_full(library, monkeypatch):
    monkeypatch.setattr(token_transducer, "STATES", 50)
    monkeypatch.setattr(token_transducer, "REMEMBERED", 20)
    monkeypatch.setattr(token_transducer, "TOGETHER", 500)
    texts = odd_texts()
    assert Transducer(MODEL).counts(texts) == [len(x) for x in library.encode(texts)]


def test_token_counts_of_rows(spark, library):
    texts = [None, *odd_texts(), "one", "one"]
    rows = [(None if at == 3 else at, t, "x", 7, 1) for at, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, n_tokens int, `we``ird` int").repartition(3)
    expected = Counter((r[0], len((r[1] or "").encode()), n, n > 50) for r, n in zip(rows, (len(x) for x in library.encode([t or "" for t in texts]))))
    found = count_tokens(df, MODEL, limit=50, keep=["doc_id"])
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert Counter(map(tuple, found.collect())) == expected
    whole = count_tokens(df, MODEL)
    assert whole.columns == ["doc_id", "text", "a.b", "we`ird", "n_bytes", "n_tokens", "over_limit"]
    assert whole.where("doc_id = 10").select("`a.b`").first()[0] == "x"
    assert count_tokens(df.limit(0), MODEL).count() == 0


# 13


def test_extents_are_the_widest():
    draw = random.Random(4)
    import numpy as np

    for _ in range(100):
        lcp = [0] + [draw.randint(0, 4) for _ in range(draw.randint(0, 20))]
        levels = sparse_minima(np.array(lcp))
        for row in range(len(lcp)):
            for depth in range(5):
                left, right = row, row
                while left > 0 and lcp[left] >= depth:
                    left -= 1
                while right + 1 < len(lcp) and lcp[right + 1] >= depth:
                    right += 1
                a, b = extents(levels, np.array([row]), np.array([depth]))
                assert (a[0], b[0]) == (left, right)
            for other in range(row, len(lcp)):
                assert range_minimum(levels, np.array([row]), np.array([other]))[0] == min(lcp[row : other + 1])


def plain_trie(rows):
    """Nodes by grouping all beginnings of all rebuilt conversations."""
    turns = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            turns[conv_id].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32], role, text))
    own = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in turns.items()}
    members = defaultdict(list)
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    out = []
    for node, inside in members.items():
        subtree = [p for p in members if p[: len(node)] == node]
        children = [p for p in subtree if len(p) == len(node) + 1]
        leaves = [p for p in subtree if not any(q[:-1] == p for q in members if q)]
        saved = sum((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in subtree if p)
        ends = ",".join(map(str, sorted(c for c in inside if built[c] == node)))
        parent = min(members[node[:-1]]) if node else None
        out.append((len(node), min(inside), parent, len(inside), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def talks(seed, n):
    draw = random.Random(seed)
    rows = []
    for c in range(n):
        if draw.random() < 0.05:
            continue  # a first of a group may be absent
        for turn in range(draw.choice([1, 1, 2, 3, 4, 6])):
            hot = c % 3 == 0
            rows.append((c, None if turn == 0 and c % 7 == 0 else turn, draw.choice(["user", None]) if not hot else "user", f"say {turn}" if hot else draw.choice(["a b c", "a", "", None, "d e"])))
    return rows


@pytest.mark.parametrize("rows_per_range", [3, 17, 100_000])
def test_trie_equals_grouped_beginnings(spark, monkeypatch, rows_per_range):
    monkeypatch.setattr(trie, "ROWS_PER_RANGE", rows_per_range)
    monkeypatch.setattr(trie, "IDS_PER_CHUNK", 2)
    rows = talks(rows_per_range, 110) + [(None, 0, "user", "none"), (5, 9, "user", "twice"), (5, 9, "user", "twice"), (-33, 0, "user", "below zero")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, `a.b` string").repartition(4)
    names = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    found = trie.prefix_trie(df).select(*names).collect()
    assert Counter(map(tuple, found)) == plain_trie(rows)


def test_trie_of_copies_of_nothing_and_of_long_talks(spark, monkeypatch):
    monkeypatch.setattr(trie, "ROWS_PER_RANGE", 4)
    schema = "conv_id long, turn long, role string, text string"
    assert trie.prefix_trie(spark.createDataFrame([], schema)).count() == 0
    for rows in ([(c, 0, "u", "same words") for c in range(0, 600, 20)], [(c, t, "u", f"t{t}") for c in (20, 40) for t in range(300)], [(3, 0, "u", "only")]):
        names = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        found = trie.prefix_trie(spark.createDataFrame(rows, schema)).select(*names).collect()
        assert Counter(map(tuple, found)) == plain_trie(rows)


# 11


def plain_divergence(rows, least, top):
    words = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    out = []
    for lang in {w[0] for w in words}:
        mine = [w for w in words if w[0] == lang]
        documents = Counter(t for _, _, ts in mine for t in set(ts))
        kept = sorted(t for t, n in documents.items() if n >= least)
        groups = {s: Counter(t for _, g, ts in mine if g == s for t in ts) for s in {w[1] for w in mine}}
        whole = Counter(t for _, _, ts in mine for t in ts)

        def price(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        priced, all_ = {s: price(c) for s, c in groups.items()}, price(whole)
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s, p in priced.items():
            pairs = [(o, sum(f(p[t], q[t]) for t in kept)) for o, q in priced.items() if o != s]
            terms = [(t, f(p[t], all_[t])) for t in kept if groups[s][t] and p[t] > all_[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return Counter(out)


@pytest.mark.parametrize(("sources", "terms", "held"), [(64, 4096, 300_000), (2, 5, 7)])
def test_divergence_equals_term_by_term(spark, monkeypatch, sources, terms, held):
    for name, value in (("SOURCES", sources), ("TERMS", terms), ("HELD", held), ("ROWS_AT_ONCE", 3)):
        monkeypatch.setattr(divergence, name, value)
    draw = random.Random(8)
    vocabulary = ["The", "the", "straße", "日本", "Ärger", "x1y", "no_way", "q"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [
        (" ".join(draw.choices(vocabulary, weights=range(len(vocabulary), 0, -1), k=draw.randint(0, 60))), draw.choice(["en", "de", None, "en"]), f"s{draw.randint(0, 6)}")
        for _ in range(150)
    ]
    rows += [(None, "en", "silent"), ("", "xx", "lone"), ("12 34", "yy", "a"), ("few words", "yy", None), ("hot " * 5000 + "\x00", "en", "s0")] + [("again", "de", "s1")] * 12
    df = spark.createDataFrame([(*r, n % 5, 1, "k") for n, r in enumerate(rows)], "text string, lang string, source string, doc_id int, place int, `a.b` string").repartition(4)
    found = source_divergence(df, least=10, top=4)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(map(tuple, found.collect())) == plain_divergence(rows, 10, 4)
    assert source_divergence(df.limit(0)).count() == 0


def test_one_hot_product_is_a_matrix_product(monkeypatch):
    import numpy as np

    monkeypatch.setattr(divergence, "ROWS_AT_ONCE", 4)
    rng = np.random.default_rng(2)
    left, right = rng.integers(-1, 6, (30, 3)), rng.integers(-1, 6, (30, 2))
    ones = lambda m: np.array([[sum(v == c for v in row) for c in range(6)] for row in m])
    a, b, m = one_hot_product(left, right, 6)
    whole = np.zeros((6, 6), dtype=int)
    whole[a, b] = m
    assert (whole == ones(left).T @ ones(right)).all()
