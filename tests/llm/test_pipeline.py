from __future__ import annotations

import hashlib

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from millrace.llm.bpe_tree import load_ranks
from millrace.llm.common import Scratch


def test_stages(spark, odd, odd_rows, labels, tmp_path):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    scratch, seen = Scratch(spark, "test"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.keep(stage(spark, docs, str(tmp_path)), name)
        seen[name] = docs
        if name != "tokens":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {k: {r.doc_id for r in v.select("doc_id").collect()} for k, v in seen.items()}
    assert ids["lines"] <= ids["quality"] and ids["near"] <= ids["lines"] and ids["mix"] == ids["near"] == ids["tokens"]
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    texts = {}
    for r in seen["mix"].collect():
        texts.setdefault(r.doc_id, set()).add(hashlib.sha256(",".join(map(str, library.encode_ordinary(r.text or ""))).encode()).hexdigest())
    for r in seen["tokens"].collect():
        assert r.ids_sha256 in texts[r.doc_id] and len(r.ids) == r.n_tokens
    assert all(r.n_chars == len(r.text or "") for r in seen["lines"].collect())


def test_run_on_the_smallest_tables(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 50 and "ids" in got.columns
