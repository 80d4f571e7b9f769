import corpus_pipeline

from quadra.llm.queries import ORACLE_SQL, QUERIES


def test_ten_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "pii", "packing"]
    now = docs.where("doc_id < 150")
    before = now.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, data).persist()
        after = now.count()
        assert now.columns == docs.columns and 0 < after <= before
        assert name in ("toxicity", "near_dedup") or after == before
        before = after
    assert now.where("text rlike '[a-z]@mail[0-9]'").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, now, data)
    assert packed.select("doc_id").distinct().count() == before
