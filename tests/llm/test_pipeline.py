"""The pipeline against a brute-force version of its stages."""

import corpus_pipeline
import public_tokenizers

from colloquy.llm import pii, quality

from .conftest import FOLDER
from .test_documents import brute_components


def test_pipeline(spark, docs):
    from tokenizers import Tokenizer

    kept = {r.doc_id for r in quality.quality_verdicts(docs).where("kept").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept}
    _, component = brute_components(texts, 80)
    left = {k: t for k, t in texts.items() if component[k] == k}
    clean = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(list(left.items()), "doc_id long, text string")).collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {k: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for k, t in clean.items()}
    got = {}
    for r in corpus_pipeline.run(spark, FOLDER).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


def test_stages_keep_columns(spark, odd):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, FOLDER).columns == odd.columns, name
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, odd, FOLDER).count() >= odd.count() and last(spark, odd.limit(0), FOLDER).count() == 0
