"""The corpus pipeline over small documents: every stage against a plain counterpart."""

import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece
from conftest import SMALL
from test_operators import brute_components

import __spark_entry__ as entry
import corpus_pipeline
from twinframe.llm.common import cut_lineage
from twinframe.llm.mixing import mixed_sample
from twinframe.llm.quality import score_quality
from twinframe.llm.queries import MIXTURE


def plain_cut(docs, length):
    count = Counter(t.encode()[i : i + length] for t in docs.values() for i in range(len(t.encode()) - length + 1))
    out = {}
    for doc_id, text in docs.items():
        raw = text.encode()
        gone = set()
        for i in range(len(raw) - length + 1):
            if count[raw[i : i + length]] > 1:
                gone.update(range(i, i + length))
        out[doc_id] = bytes(b for i, b in enumerate(raw) if i not in gone).decode("utf-8", "ignore")
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = docs.columns
    now = {r.doc_id: r.text or "" for r in docs.collect()}
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        made = cut_lineage(stage(spark, docs, SMALL))
        rows = {r.doc_id: r for r in made.collect()}
        assert len(rows) == made.count()
        if name == "quality":
            expected = {r.doc_id: now[r.doc_id] for r in score_quality(docs, labels).collect() if r.predicted}
        elif name == "near_dedup":
            expected = {d: now[d] for d, _, _, kept in brute_components(list(now.items()), 5, 80) if kept}
        elif name == "repeats":
            expected = plain_cut(now, 400)
        elif name == "mixture":
            sample = mixed_sample(docs, MIXTURE, corpus_pipeline.BUDGET).collect()
            expected = {r.doc_id: now[r.doc_id] for r in sample if r.sampled}
        else:
            lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            expected = now
            assert all(r.ids == lib.encode(r.text or "") and r.n_tokens == len(r.ids) for r in rows.values())
            assert all(r.decoded_sha256 == hashlib.sha256(lib.decode(r.ids).encode()).hexdigest() for r in rows.values())
        assert {d: r.text or "" for d, r in rows.items()} == expected, name
        assert name == "pieces" or made.columns == names
        now, docs = expected, made


def test_stages_take_gaps_and_empty_tables(spark):
    more = ["node", "digest", "probability", "_source", "tokens", "_spans", "_digest", "a.b", "n"]
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{c}` string" for c in more)
    words = " ".join(f"word{n} of the" for n in range(60))
    rows = [(1, words, "en", "a", 5)] * 2 + [(2, words, None, None, None), (3, None, "en", "a", 0), (None, "some text here", "de", "b", 14)]
    rows = [(*r, *[f"{c} of {r[0]}" for c in more]) for r in rows]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        empty = not docs.count()
        for _, stage in corpus_pipeline.STAGES[:2]:
            docs = cut_lineage(stage(spark, docs, SMALL))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *more]
        ids = [r.doc_id for r in docs.collect()]
        assert ids == [] if empty else ids.count(1) <= 1 and 2 not in ids
        for _, stage in corpus_pipeline.STAGES[2:]:
            docs = cut_lineage(stage(spark, docs, SMALL))
        assert docs.columns[: len(more) + 5] == ["doc_id", "text", "lang", "source", "n_chars", *more]
        assert docs.count() <= len(ids)
        assert all(r[c] == f"{c} of {r.doc_id}" for r in docs.collect() for c in more)


def test_a_repeated_id_keeps_its_other_text(spark):
    texts = [" ".join(f"{w}{n} of the" for n in range(60)) for w in ("word", "other")]
    rows = [(5, texts[0]), (5, texts[0]), (5, texts[1]), (7, texts[1]), (9, "a b c d e f")]
    docs = spark.createDataFrame([(*r, "en", "a", 5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, docs, SMALL).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(5, texts[0]), (5, texts[1]), (9, "a b c d e f")])


def test_all_are_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{at}_") for n in names) for at in range(1, 14))
