"""The stages of the pipeline, each on what its predecessor kept, against plain readings of what each keeps."""

import corpus_pipeline
from test_decontamination import brute
from test_shingles import plain_groups

from rankloom.llm import language_id, mixing
from rankloom.llm.common import staged


def test_every_stage(spark, sf_dir, docs):
    at, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = at.collect()
        out = stage(spark, at, sf_dir)
        rows = out.collect()
        if name == "language_id":
            classify = language_id.Classifier(language_id.fit(at))
            assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in before if not classify(r["text"])[3])
        elif name == "simhash_near_duplicates":
            wanted, _ = plain_groups([(r["doc_id"], r["text"]) for r in before])
            assert sorted(r["doc_id"] for r in rows) == sorted(set(wanted))
        elif name == "benchmark_decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            gone = {d for d, _ in brute([(r["doc_id"], r["text"]) for r in before], items)}
            assert sorted(r["doc_id"] for r in rows) == sorted({r["doc_id"] for r in before} - gone)
        elif name == "source_mixing":
            taken = {r["doc_id"]: r["copies"] if r["size"] else 1 for r in mixing.mix(at).collect()}
            assert sorted(r["doc_id"] for r in rows) == sorted(i for i, n in taken.items() for _ in range(n))
        else:
            assert len(rows) == len(before) and sorted({(r["shard"], r["slot"]) for r in rows}) == sorted((r["shard"], r["slot"]) for r in rows)
            assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in before)
            break
        assert out.columns == columns and rows
        at = staged(out, f"test-{name}")


def test_edge_rows(spark, sf_dir, edge, empty):
    for docs in (edge, empty):
        at = docs
        for name, stage in corpus_pipeline.STAGES:
            out = staged(stage(spark, at, sf_dir), f"edge-{name}")
            assert name == "sharding" or out.columns == docs.columns
            at = out
