"""The source divergence audit against sums over all terms, on made texts with rare terms, ties, nulls and empty groups."""

import random
import re
from collections import Counter, defaultdict

import pytest

from weftline.llm import divergence
from weftline.llm.divergence import audit_sources, audited, divergent_terms

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, term string, n int, rank int"


def slow(docs, min_docs=10, k=10):
    counts, seen = defaultdict(Counter), defaultdict(Counter)
    groups = {(r[2] or "", r[3] or "") for r in docs}
    for _, text, lang, source, *_ in docs:
        t = TERM.findall((text or "").translate(LOW))
        counts[lang or "", source or ""].update(t)
        seen[lang or ""].update(set(t))
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in seen[lang].items() if n >= min_docs]
        sources = sorted(s for g, s in groups if g == lang)
        total = Counter()
        for s in sources:
            total.update(counts[lang, s])
        p = {}
        for s, c in [*((s, counts[lang, s]) for s in sources), (None, total)]:
            n = sum(c[t] for t in kept)
            p[s] = {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}
        for s in sources:
            parts = {
                "pair": [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s],
                "term": [(f(p[s][t], p[None][t]), t) for t in kept if counts[lang, s][t] and p[s][t] > p[None][t]],
            }
            for part, found in parts.items():
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i) for i, (v, item) in enumerate(found[: None if part == "pair" else k], 1)]
    return out


def made(seed, n=400):
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in ["ka", "Lo", "état", "ñ", "zz", "\U0001f600"] for b in ["", "x", "yy", "é", "qu"]]
    docs = []
    for i in range(n):
        lang, source = rng.choice(["en", "de", "", None, "rare"] if i % 40 == 0 else ["en", "de"]), rng.choice(["a", "b", "Ä", "c", None, ""])
        bias = vocab[len(source or "") * 3 :]
        text = " ".join(rng.choice(bias if rng.random() < 0.5 else vocab) + rng.choice(["", "1", "_", "."]) for _ in range(rng.randrange(60)))
        docs.append((i, text, lang, source, "t", 1, 2))
    docs += [(1, docs[1][1], *docs[1][2:])] * 15  # a repeated row
    docs += [(9000, None, "en", "silent", None, None, None), (9001, "", "none", "x", None, None, None), (9002, "once", "none", "y", None, None, None), (None, "ka ka", "en", "a", None, None, None)]
    docs.append((9003, "ka Lox " * 40_000, "de", "b", None, None, None))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_sums_over_all_terms(spark, seed):
    docs = made(seed)
    got = audit_sources(spark.createDataFrame(docs, SCHEMA))
    assert sorted(map(tuple, got.collect())) == sorted(slow(docs))


def test_ties_are_ordered_by_bytes(spark):
    docs = [(i, "aa bb cc dd ee é \U0001f600 ff gg hh ii jj kk" if i < 15 else "zz", "en", "s" if i < 15 else "t", None, None, None) for i in range(30)]
    got = audit_sources(spark.createDataFrame(docs, SCHEMA))
    assert sorted(map(tuple, got.collect())) == sorted(slow(docs))


def test_search_stops_before_all_buckets(spark, monkeypatch):
    rng = random.Random(5)
    docs = [(i, " ".join(f"w{'abcdefghij'[t % 10]}{'abcdefghij'[t // 10 % 10]}{'abcdefghij'[t // 100]}" for t in (int(rng.paretovariate(0.4)) % 900 for _ in range(80))), "en", f"s{i % 3}", None, None, None) for i in range(600)]
    d = spark.createDataFrame(docs, SCHEMA)
    rows, _ = audited(d)
    opened = []
    real = divergence.keep

    def spy(df, name, *a):
        out = real(df, name, *a)
        if name == "op11-taken":
            opened.append(out.count())
        return out

    monkeypatch.setattr(divergence, "keep", spy)
    monkeypatch.setattr(divergence, "FIRST", 1)
    got = sorted((r.source, r["item"], r.value) for r in divergent_terms(rows).collect())
    assert got == sorted((s, item, v) for _, s, part, item, v, _ in slow(docs) if part == "term")
    buckets = rows.withColumn("b", divergence.F.floor(divergence.F.log2("n") * divergence.STEPS)).select("source", "b").distinct().count()
    assert len(opened) > 1 and 0 < sum(opened) < buckets


def test_empty(spark):
    assert audit_sources(spark.createDataFrame([], SCHEMA)).count() == 0


def test_counting_in_pieces(monkeypatch):
    """What a task counts does not depend on how many terms it holds and on where long texts are cut."""
    import pyarrow as pa

    docs = [((text or "") * 3, lang or "", source or "") for _, text, lang, source, *_ in made(7, 60)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*docs[i : i + 20], strict=True)], ["text", "lang", "source"]) for i in range(0, len(docs), 20)]

    def counted():
        n, docs = Counter(), Counter()
        for b in divergence._counted(iter(batches)):
            for r in b.to_pylist():
                n[r["lang"], r["source"], r["term"]] += r["n"]
                docs[r["lang"], r["source"], r["term"]] += r["docs"]
        return n, docs

    whole = counted()
    monkeypatch.setattr(divergence, "HELD", 7)
    monkeypatch.setattr(divergence, "PIECE", 5)
    assert counted() == whole
    assert sum(whole[0].values()) == sum(len(TERM.findall(t.translate(LOW))) for t, *_ in docs)
