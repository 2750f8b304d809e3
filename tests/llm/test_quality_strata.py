"""The limit on rejected good documents holds for each of very many languages."""

import random


def test_every_language_has_its_own_cutoff(spark):
    from weftline.llm.quality import filter_documents, judge_documents

    rng, vocabulary = random.Random(2), [f"word{i}" for i in range(300)]
    say = lambda mark, n: " ".join(w + mark for w in rng.choices(vocabulary, k=n))
    docs, labels = [], []

    def add(lang, mark, good, n):
        for _ in range(n):
            docs.append((len(docs), say(mark, 40), lang))
            labels.append((len(docs) - 1, good))

    for i in range(66):  # pooled, the languages with clean good documents would outvote the last
        add(f"l{i:02}", "", 1, 500 if i < 64 else 495)
        add(f"l{i:02}", "##", 0, 60)
    add("last", "##", 1, 8)
    add(None, "", 1, 500)
    add(None, "##", 0, 60)
    table = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int")
    kept = {r["doc_id"] for r in judge_documents(table, marks).where("kept").collect()}
    good = dict(labels)
    for lang in {d[2] for d in docs}:
        mine = [d[0] for d in docs if d[2] == lang]
        assert all(i in kept for i in mine if good[i]), lang
        assert lang == "last" or not any(i in kept for i in mine if not good[i]), lang
    assert {r["doc_id"] for r in filter_documents(table, marks).collect()} == kept
