"""Importance resampling against its definition."""

import collections
import math
import random

import numpy as np
import pytest

from weftline.llm import resampling as R

SCHEMA = "doc_id bigint, text string, lang string"


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    say = lambda w, n: " ".join(rng.choices(w, k=n))
    good, bad = [f"g{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    docs = [(i, say(good, 40), "en") for i in range(300)] + [(1000 + i, say(bad, 40), "en") for i in range(100)]
    docs += [(5000, None, None), (5001, "", "en"), (5002, "g1 " * 3000, None), (7, docs[7][1], "en"), (None, say(good, 30), "en")]
    labels = [(i, 1, 0) for i in range(150)] + [(1000 + i, 0, 0) for i in range(50)] + [(3, 1, 0), (4, None, 0), (5, 0, 1)]
    return docs, spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), labels


def test_weights(spark, tables):
    from weftline.llm.shingles import Words

    rows, docs, labels, marks = tables
    got = R.resample_documents(docs, labels).collect()
    assert len(got) == len(rows)
    verdict = collections.defaultdict(list)
    for i, q, t in marks:
        if q is not None:
            verdict[i].append((q, t))
    good = {i for i, v in verdict.items() if min(q for q, _ in v) > 0 and max(t for _, t in v) == 0}
    raw, target = np.zeros(R.BUCKETS), np.zeros(R.BUCKETS)
    words = Words()
    feats = [R._features(words, t) for _, t, _ in rows]
    for (i, _, _), f in zip(rows, feats, strict=True):
        np.add.at(raw, f, 1)
        if i in good:
            np.add.at(target, f, 1)
    part = target.sum() / raw.sum()
    want = sorted((str(i), len(f), round(sum(math.log((target[b] + 1) / (raw[b] * part + 1)) for b in f if raw[b] >= R.LEAST), 6)) for (i, _, _), f in zip(rows, feats, strict=True))
    assert sorted((str(r["doc_id"]), r["n_features"], round(r["log_weight"], 6)) for r in got) == want
    k = round(len(rows) * len(good) / len(verdict))
    scores = sorted((r["score"] for r in got), reverse=True)
    assert all(r["kept"] == (r["score"] >= scores[k - 1]) for r in got)
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert sum(i in kept for i in range(300)) > 270
    assert sum(1000 + i in kept for i in range(100)) < 10
    assert sorted(map(str, got)) == sorted(map(str, R.resample_documents(docs.repartition(7), labels).collect()))


def test_edges(spark, tables):
    _, docs, labels, _ = tables
    assert R.resample_documents(docs.where("false"), labels).count() == 0
    assert R.resample_documents(docs, labels.where("false")).where("not kept").count() == 0


def test_kth_largest(spark, monkeypatch):
    monkeypatch.setattr(R, "EXACT", 5)
    monkeypatch.setattr(R, "STEPS", 7)
    v = [random.Random(1).gauss(0, 5) for _ in range(200)] + [1.5] * 20
    df = spark.createDataFrame([(x,) for x in v], "score double")
    for k in (1, 2, 60, 90, 219, 220):
        assert R.kth_largest(df, k) == sorted(v, reverse=True)[k - 1]


def slow_features(text):
    """Buckets of one- and two-word features, word by word with whole numbers."""
    import hashlib

    top = (1 << 64) - 1

    def mixed(x):
        x ^= x >> 31
        x = x * 0x9E3779B97F4A7C15 & top
        x ^= x >> 29
        x = x * 0xBF58476D1CE4E5B9 & top
        return x ^ (x >> 32)

    h = [int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in (text or "").encode().lower().split()]
    return [mixed(x) % R.BUCKETS for x in h] + [mixed((a * 0x9E3779B97F4A7C15 + b) & top) % R.BUCKETS for a, b in zip(h, h[1:], strict=False)]


def test_features():
    from weftline.llm.shingles import Words

    words = Words()
    for text in (None, "", " ", "one", "One one two", "é É x\ty\x0bz " * 40):
        assert R._features(words, text).tolist() == slow_features(text)
