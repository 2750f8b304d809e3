"""What training sends does not grow with the number of partitions that a table is dealt over."""

from weftline.llm import language_model as LM


def test_small_partitions_train_together(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"one two three {i % 7} four") for i in range(300)], "doc_id long, text string").repartition(24)
    sent = []
    real = LM.keep
    monkeypatch.setattr(LM, "keep", lambda df, name, *a: (t := real(df, name, *a), sent.append(t) if name == "op6-weights" else None)[0])
    got = LM.score_documents(docs).collect()
    assert len(got) == 300 and all(r.n_tokens == 6 for r in got)
    assert sent and all(t.select("part").distinct().count() == 1 for t in sent)


def test_weights_sent_keep_to_the_texts_and_are_written_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"one two three {i % 7} four") for i in range(4000)], "doc_id long, text string").repartition(24)
    parts, written = [], []
    fit, keep = LM._fit_part, LM.keep
    monkeypatch.setattr(LM, "_fit_part", lambda part, *a: (parts.append(part.rdd.getNumPartitions()), fit(part, *a))[1])
    monkeypatch.setattr(LM, "keep", lambda df, name, *a: (written.append(name), keep(df, name, *a))[1])
    assert LM.score_documents(docs).count() == 4000
    row = LM.FAN * 2 + 4
    assert max(parts) * LM.KINDS * LM.LEAST_ROWS * row <= 1.5 * docs.agg({"text": "count"}).first()[0] * len("one two three 1 four")
    assert len(parts) == LM.ROUNDS and len(written) == 2 + LM.ROUNDS
