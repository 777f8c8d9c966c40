"""Stages of the pipeline on the smallest tables."""

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import simhash
from tessera.llm.common import written

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(written(stage(spark, tables[-1], DATA), "test"))
    start, rules, language, single, mix, coded = [t.collect() for t in tables]
    assert all(t.columns == docs.columns for t in tables[:-1])
    ids = [[r["doc_id"] for r in t] for t in (start, rules, language, single, mix)]
    assert all(set(b) <= set(a) for a, b in zip(ids, ids[1:])) and len(set(ids[3])) == len(ids[3])
    prints = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in language}
    left = [prints[i] for i in ids[3]]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() > 2 for k, a in enumerate(left) for b in left[:k])
    words, taken = sum(len(r["text"].split()) for r in single), sum(len(r["text"].split()) for r in mix)
    assert abs(taken - 1.5 * words) < 0.1 * words and max(ids[4].count(i) for i in set(ids[4])) <= 2
    library, text = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {r["doc_id"]: r["text"] for r in mix}
    assert len(coded) == len(mix) and all(list(r["ids"]) == library.encode(text[r["doc_id"]], add_special_tokens=False).ids for r in coded)


def test_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 0 and [f for f, _ in corpus_pipeline.STAGES][2].startswith("SimHash")
