from spikeframe.llm import queries, stages
from spikeframe.llm.mixing import mix_sources


def test_every_document_of_a_hot_source_is_placed(spark, tmp_path):
    data = [(i, "hot" if i % 3 == 0 else f"s{i % 20}", "text") for i in range(3000)] + [(3000 + i, None, "text") for i in range(5)]
    docs = spark.createDataFrame(data, "doc_id long, source string, text string")
    got = mix_sources(docs, slots=100).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(3005))
    assert sorted(r["position"] for r in got) == list(range(3005))
    assert sorted(r["doc_id"] for r in stages.mix(spark, docs, "").collect()) == list(range(3005))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.op5_mixing(spark, str(tmp_path)).count() == 3005
