"""Importance resampling of a table in which every feature is rare."""


def test_rare_features_count(spark):
    from weftline.llm.resampling import resample_documents

    docs = [(i, f"good{i % 4} fine{i % 3}" if i < 12 else f"bad{i % 4} poor{i % 3}") for i in range(24)]
    labels = spark.createDataFrame([(i, int(i < 12), 0) for i in range(0, 24, 2)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r["log_weight"] for r in resample_documents(spark.createDataFrame(docs, "doc_id bigint, text string"), labels).collect()}
    assert min(got[i] for i in range(12)) > max(got[i] for i in range(12, 24))
