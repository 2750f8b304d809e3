"""Benchmark decontamination against a plain scan, on made texts with short items, copies, nulls and overlaps."""

import hashlib
import random
import re

import pytest

from weftline.llm.decontamination import audit_documents, decontaminate

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA_D = "doc_id long, text string, len string, _h long, at int, digest string, spans string"
SCHEMA_B = "item_id long, text string, words string"


def words(text):
    return WORD.findall((text or "").translate(LOW))


def slow(docs, bench):
    windows = {}
    for item, text, *_ in bench:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    lens = sorted({len(k) for k in windows})
    out = []
    for doc, text, *_ in docs:
        w, hit, items = words(text), set(), set()
        for n in lens:
            for i in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    items |= found
        ids = ",".join(sorted(items))
        out.append((doc, len(w), len(hit), len(items), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out, lens


def made(seed):
    rng = random.Random(seed)
    vocab = ["the", "The", "Maß", "état", "x1", "42", "cat", "DOG", "\U0001f600", "Ünder"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "_", "--"]) for _ in range(n))
    bench = [(i, text(rng.choice([1, 3, 9, 10, 11, 25])), "w") for i in range(12)]
    bench += [(3, text(14), None), (77, bench[5][1], None), (None, text(12), None), (78, None, None), (79, " -- ", None)]
    docs = []
    for i in range(60):
        parts = [text(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            b = rng.choice(bench)[1] or ""
            w = re.split(r"(?<=[ \n])", b)
            k = rng.randrange(len(w))
            parts += ["".join(w[k:]), text(rng.randrange(5))]
        docs.append((i, rng.choice(["", "..", "\x00"]) + "".join(parts), "n", i, 1, "d", "s"))
    docs += [(None, docs[7][1], None, None, None, None, None), (5, docs[5][1], None, None, None, None, None), (900, None, None, None, None, None, None), (901, "", None, None, None, None, None), (902, "!?", None, None, None, None, None)]
    docs.append((903, text(30_000) + docs[9][1], None, None, None, None, None))
    return docs, bench


def key(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize("set_bytes", [64 << 20, 900])
def test_equals_a_plain_scan(spark, set_bytes):
    docs, bench = made(1)
    want, lens = slow(docs, bench)
    assert 1 in lens and 10 in lens and len(lens) > 2
    got = audit_documents(spark.createDataFrame(docs, SCHEMA_D), spark.createDataFrame(bench, SCHEMA_B), set_bytes=set_bytes)
    assert key(tuple(r) for r in got.collect()) == key(want)


def test_no_python_in_the_plan(spark):
    docs, bench = made(2)
    d, b = spark.createDataFrame(docs, SCHEMA_D), spark.createDataFrame(bench, SCHEMA_B)
    plan = audit_documents(d, b)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_tables(spark):
    docs, bench = made(3)
    d, b = spark.createDataFrame(docs, SCHEMA_D), spark.createDataFrame(bench, SCHEMA_B)
    assert audit_documents(d.limit(0), b).count() == 0
    none = audit_documents(d, b.limit(0)).collect()
    assert len(none) == len(docs) and not any(r.contaminated or r.n_hit or r.n_items for r in none)
    assert key(r.n_words for r in none) == key(len(words(t[1])) for t in docs)


@pytest.mark.parametrize("seed", [4, 5])
def test_removal(spark, seed):
    docs, bench = made(seed)
    bench = [b for b in bench if len(words(b[1])) >= 9]
    d, b = spark.createDataFrame(docs, SCHEMA_D), spark.createDataFrame(bench, SCHEMA_B)
    want, _ = slow(docs, bench)
    clean = {r[0] for r, w in zip(docs, want, strict=True) if not w[5]}
    whole = decontaminate(d, b, remove="documents")
    assert whole.columns == d.columns
    assert {r.doc_id for r in whole.collect()} == clean
    cut = {r.doc_id: r for r in decontaminate(d, b).where("doc_id is not null and doc_id <> 5").collect()}
    windows = {tuple(words(t)[i : i + 10]) for _, t, *_ in bench for i in range(max(1, len(words(t)) - 9))}
    lower = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    for r in docs:
        if r[0] in (None, 5):
            continue
        got, w = cut[r[0]], words(r[1])
        assert tuple(got)[2:] == r[2:]
        hit = {j for n in {len(x) for x in windows} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for j in range(i, i + n)}
        if not hit:
            assert got.text == r[1]
            continue
        at = [m.span() for m in lower.finditer(r[1])]
        runs = []
        for j in sorted(hit):
            if runs and runs[-1][1] == j - 1:
                runs[-1][1] = j
            else:
                runs.append([j, j])
        text, end = "", 0
        for a, z in runs:
            text, end = text + r[1][end : at[a][0]], at[z][1]
        assert got.text == text + r[1][end:]


def test_refuses_other_removals(spark):
    docs, bench = made(6)
    with pytest.raises(ValueError):
        decontaminate(spark.createDataFrame(docs, SCHEMA_D), spark.createDataFrame(bench, SCHEMA_B), remove="all")
