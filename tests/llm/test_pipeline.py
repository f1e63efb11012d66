"""The pipeline's rows against brute force, stage by stage."""

import re

import corpus_pipeline
import sentencepiece
from pyspark.sql import functions as F

from tests.llm import tables as T
from tokenloom.llm import pieces, quality, secrets


def test_stages_return_the_columns_of_documents(spark):
    docs = T.awkward(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, T.SF)
        assert out.columns == docs.columns and out.count() <= docs.count()
        assert stage(spark, T.empty(spark), T.SF).count() == 0


def test_run(spark):
    docs = spark.read.parquet(f"{T.SF}/documents.parquet")
    judged = quality.judge(docs).filter(F.col(quality.PREFIX + "kept")).select("doc_id", "text").orderBy("doc_id")
    rows = T.rows_of(judged)
    roots = T.brute_components([T.brute_fingerprint(t) for _, t in rows])
    rows = [r for i, r in enumerate(rows) if roots[i] == i]
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    windows = {tuple(w[i : i + 10]) for (t,) in T.sample_rows("benchmark", "text") for w in [cut(t)] for i in range(max(1, len(w) - 9))}
    rows = [(k, t) for k, t in rows if not any(tuple(w[i : i + 10]) in windows for w in [cut(t)] for i in range(len(w)))]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    want = {k: len(library.encode(secrets.redact_text(t))) for k, t in rows}
    got = {r["doc_id"]: r["n_pieces"] for r in corpus_pipeline.run(spark, T.SF).collect()}
    assert got == want and len(want) > 50
