"""The corpus pipeline, stage by stage."""

import corpus_pipeline as P
from lakeloom.llm.common import written

from .test_near import brute_documents
from .test_tokens import check_packing


def test_stages_keep_their_columns_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes, before = docs.columns, [docs.count()], docs
    for k, (name, stage) in enumerate(P.STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), f"test{k}")
        assert docs.columns == columns
        sizes.append(docs.count())
        if name == "MinHash near-dedup":
            texts = {r["doc_id"]: r["text"] for r in before.collect()}
            expected = {i for i, (_, _, kept) in brute_documents(texts, 80).items() if kept}
            assert {r["doc_id"] for r in docs.collect()} == expected
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[1] and sizes[2] > sizes[3] == sizes[4] > 0
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    check_packing(P.STAGES[-1][1](spark, docs, sf_dir).collect(), texts)


def tables(spark, folder, docs, labels):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_odd_tables(spark, odd_docs, no_docs, tmp_path):
    """Null, empty, blank, very long and repeated texts, null ids, columns with names of the operators' own; labels that are null, repeated or unknown; and no rows at all."""
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, None), (3, 1, 0), (None, 1, 1), (4, None, 0), (5, 1, 0), (99, 1, 0)], "doc_id bigint, quality int, toxic int")
    for name, docs, known in (("odd", odd_docs, labels), ("none", no_docs, labels), ("unlabelled", odd_docs, labels.filter("false")), ("neither", no_docs, labels.filter("false"))):
        sf_dir = tables(spark, tmp_path / name, docs, known)
        docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
        for k, (stage, function) in enumerate(P.STAGES[:-1]):
            docs = written(function(spark, docs, sf_dir), f"odd{k}")
            assert docs.columns == before.columns and docs.count() <= before.count()
        rows = P.run(spark, sf_dir).collect()
        assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}
        # Each stage by itself, on all of the odd rows.
        for stage, function in P.STAGES:
            assert function(spark, before, sf_dir).count() >= 0


def test_names_and_number_of_stages():
    assert [n for n, _ in P.STAGES] == ["quality classifier", "quality rules", "MinHash near-dedup", "PII", "best-fit packing"]
    assert P.ORACLE_SQL is None
