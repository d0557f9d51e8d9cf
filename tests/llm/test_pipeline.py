"""The pipeline's stages against plain Python versions of their decisions."""

import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from folioflow.llm import line_dedup
from tests.llm.test_near_dedup import brute


def test_stages_one_after_another(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    held = {r.doc_id: r.text for r in docs.collect()}
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        before = held
        at = stage(spark, at, small)
        rows = at.collect()
        if name == "bpe_encoding":
            library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
            for r in rows:
                ids = library.encode(before[r.doc_id], add_special_tokens=False).ids
                assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert len(rows) == len(before)
            continue
        assert at.columns == columns
        held = {r.doc_id: r.text for r in rows}
        assert len(rows) == len(held) and set(held) <= set(before)
        if name == "language_id":
            assert set(held) == {d for d, t in before.items() if any(c.isalpha() for c in t or "")}
        if name == "line_dedup":
            first = {}
            for d in sorted(before):
                for n, _, _, body in line_dedup._multi(line_dedup._lines(before[d])):
                    first.setdefault(body, (d, n))
            want = {}
            for d, t in before.items():
                gone = [n for n, _, _, body in line_dedup._multi(line_dedup._lines(t)) if first[body] != (d, n)]
                want[d] = line_dedup.kept_lines(t, gone)[0].decode() if gone else t
                if gone and not want[d]:
                    del want[d]
            assert held == want
        if name == "near_dedup":
            # five words and a similarity of 0.8 are what the stage has to link; the 2-bit rule is the query's
            assert set(held) == brute(sorted(before.items()))
        at = spark.createDataFrame(rows, docs.schema)


def test_run_returns_the_last_stage(spark, small):
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} == set(corpus_pipeline.run(spark, small).columns)
