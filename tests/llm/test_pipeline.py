"""The pipeline on the smallest tables: stages keep the columns, decisions take effect."""

import corpus_pipeline
from engram.llm import minhash


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "minhash near-dedup", "mixing", "bpe"]
    out = corpus_pipeline.run(spark, sf)
    rows = out.collect()
    assert set(docs.columns) < set(out.columns) and 0 < len(rows) < n and len({r.doc_id for r in rows}) == len(rows)
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    kept = {r.doc_id for r in rows}
    assert len(kept & toxic) <= 0.1 * len(toxic) and all(len(r.token_ids) == r.n_tokens for r in rows)
    again = minhash.near_duplicates(out.select("doc_id", "text")).where("doc != component").count()
    assert again == 0
