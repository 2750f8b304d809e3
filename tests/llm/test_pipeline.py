"""The pipeline, stage by stage, against brute force over each stage's own input."""

import collections
import random

import numpy as np
import pytest
from test_operators import slow_groups, slow_passages, slow_stats

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghi", k=rng.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    docs = [(i, say(rng.randint(25, 150)), "en", f"s{i % 4}") for i in range(260)]
    docs += [(300 + i, " ".join(w + "###" for w in say(60).split()), "en", "s0") for i in range(40)]
    docs += [(400 + i, docs[i][1] + " more", "en", "s1") for i in range(30)]
    for k, passage in enumerate((say(110), say(51), say(60), say(80))):
        docs += [(500 + 10 * k + i, say(60 + 150 * (k > 0)) + " " + passage + " " + say(60 + 150 * (k > 0)), "en", None) for i in range(10)]
    docs += [(600, None, None, None), (601, "", "en", "s1"), (602, "too short", "en", "s1"), (5, docs[5][1], "en", "s1")]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1) for i in range(260)] + [(300 + i, 0) for i in range(40)]
    spark.createDataFrame([(*x, 0) for x in labels], "doc_id bigint, quality bigint, toxic bigint").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, sf_dir, tmp_path):
    import corpus_pipeline as P

    names = [n for n, _ in P.STAGES]
    assert names == ["quality_rules", "minhash_near_dedup", "suffix_array_dedup", "mix_sources", "bpe_tokens"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    inputs = []
    for name, stage in P.STAGES[:-1]:
        inputs.append([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in docs.collect()])
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    inputs.append([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in docs.collect()])
    raw, judged, unique, cut, mixed = inputs

    def passes(t):
        n, _, sym, _, rep = slow_stats(t)
        return n >= 20 and 100 * rep <= 30 * n and sym == 0

    assert sorted(judged) == sorted(r for r in raw if passes(r[1]))
    keepers = {r[0] for r in slow_groups(judged) if r[3]}
    assert sorted(r[0] for r in unique) == sorted(keepers)
    assert set(unique) <= set(judged)
    assert sorted(((r[0], r[1]) for r in cut), key=str) == slow_passages(unique, 51)
    assert all(r[4] == len(r[1]) for r in cut)
    before = {r[0]: r[1] for r in unique}
    assert {r[0] for r in cut if r[1] != before[r[0]]} >= {i for i in range(510, 540) if i in before}
    assert sum(i in before for i in range(510, 540)) > 20
    copies = collections.Counter(mixed)
    assert set(copies) <= set(cut)
    assert all(n <= 3 for n in copies.values())
    sizes = {s: sum(len(r[1].split()) for r in cut if r[3] == s) for s in {r[3] for r in cut}}
    from weftline.llm.mixing import targets

    for s, t in targets(sizes).items():
        assert abs(sum(len(r[1].split()) for r in mixed if r[3] == s) - t) <= 250
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = collections.Counter((r["doc_id"], tuple(r["ids"])) for r in P.STAGES[-1][1](spark, docs, sf_dir).collect())
    assert got == collections.Counter((r[0], tuple(lib.encode(r[1], add_special_tokens=False).ids)) for r in mixed)
    again = collections.Counter((r["doc_id"], tuple(np.array(r["ids"]))) for r in P.run(spark, sf_dir).collect())
    assert again == got


def test_empty(spark, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality bigint, toxic bigint").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
