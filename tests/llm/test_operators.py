"""Text operators against brute force, on small tables with every awkward case."""

import collections
import hashlib
import math
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = "The quick brown fox jumps over the lazy dog while seven wizards boil juicy kelp near the old stone bridge at dawn. "


def awkward_rows():
    """(doc_id, text, lang, source): nulls, empty, very long, ties, repeated rows, near copies."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(300)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    body = say(120)
    rows = [(1, None, "en", "s1"), (2, "", "en", "s2"), (3, " \t\n ", None, None), (4, "one", "en", "s1"), (5, "one", "en", "s1"), (6, "ONE two", "de", "s2")]
    rows += [(10 + i, body, "en", "s1") for i in range(5)]
    rows += [(30 + i, " ".join(w if rng.random() > 0.02 else "zzz" for w in body.split(" ")), "en", "s1") for i in range(30)]
    rows += [(80 + i, say(rng.randint(3, 200)), "fr", rng.choice(["s1", "s2", "s3", None])) for i in range(60)]
    rows += [(150, say(20_000), "en", "s3"), (151, BASE * 30, "en", "s3"), (152, "x " * 500, "en", "s3"), (153, "É" * 700 + "\n" + "ß" * 700, None, "s3")]
    rows += [(200 + i, say(20) + " " + BASE * 5 + say(20), "en", "s2") for i in range(12)]
    return rows + [(200, rows[-12][1], "en", "s2"), (None, say(50), "en", "s1"), (None, None, None, None)]


SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="module")
def rows():
    return awkward_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    clash = "count bigint, n bigint, node string, sha string, key int, size int, copies int, token string, row int, part int, kept string"
    return spark.createDataFrame([(*r, *[None] * 11) for r in rows], f"{SCHEMA}, {clash}").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def words_of(t):
    return WORD.findall(t or "")


# ---- fingerprints ------------------------------------------------------------------------------------------------


def canonical(t):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t).lower()).strip(" ")


def test_fingerprints(spark, docs, rows, none):
    from weftline.llm.fingerprints import fingerprint_documents

    got = collections.Counter(tuple(r) for r in fingerprint_documents(docs).select("doc_id", "n_chars", "edited_sha256").collect())
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    want = collections.Counter()
    for r, after in zip(order, [*order[1:], order[0]], strict=True):
        t, u = r[1] or "", after[1] or ""
        k = len(t) // 4
        want[r[0], len(t), hashlib.sha256((t[: len(t) - k] + u[:k]).encode()).hexdigest()] += 1
    assert got == want
    forms = {}
    prints = fingerprint_documents(docs).select("doc_id", "fingerprint").join(docs.select("doc_id", "text"), "doc_id").collect()
    for r in prints:
        if r["doc_id"] != 200:
            forms.setdefault(canonical(r["text"] or ""), set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in forms.values())
    assert len({next(iter(v)) for v in forms.values()}) == len(forms)
    assert fingerprint_documents(none).count() == 0


def test_fingerprints_single_document_and_case(spark):
    from weftline.llm.fingerprints import fingerprint_documents

    one = fingerprint_documents(spark.createDataFrame([(7, "abcdefgh")], "doc_id bigint, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    assert one["near_next"] == 1.0
    two = fingerprint_documents(spark.createDataFrame([(1, "Ａ  b\n"), (2, "a b")], "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert two[0]["fingerprint"] == two[1]["fingerprint"]
    assert two[0]["near_next"] == 1.0


def test_fingerprints_mixed_bucket(spark):
    from weftline.llm.fingerprints import mixed_buckets

    e = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (2, 2, "c"), (2, 2, "c")], "h1 bigint, h2 bigint, form string")
    assert [tuple(r) for r in mixed_buckets(e, e.select("h1", "h2").distinct()).collect()] == [(1, 1)]


# ---- html --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<nav><a href=x>Home</a></nav><article><h1>T&amp;t</h1><p>a  b<br><p>c<b>d</b></article><footer>no</footer>", "T&t\na b\ncd"),
        ('<article><p>one<div class="ad">buy</div><p>two<form>f<input></form><section id="comments"><p>me too</section></article>', "one\ntwo"),
        ("<body><script>if (a<b) document.write('<p>x')</script><style>p{}</style><article>x<!-- <p>y --></article>", "x"),
        ("<article><header><h1>Head</h1>by me</header><p>body</article>", "Head\nbody"),
        ("<div class='menu'>" + "menu " * 40 + "</div><div><p>" + "story " * 40 + "</p><p>End.</p></div><div class='sidebar'>" + "side " * 40 + "</div>", " ".join(["story"] * 40) + "\nEnd."),
        ("<article>unclosed <b>bold <p>next", "unclosed bold\nnext"),
        ("plain < 3 text " * 10, " ".join(["plain < 3 text"] * 10)),
    ],
)
def test_html(page, text):
    from weftline.llm.html import main_text

    assert main_text(page) == text


def test_html_table(spark):
    from weftline.llm.html import extract_pages

    pages = spark.createDataFrame([(1, "u", None, 1), (1, "u", None, 1), (None, None, "<article>é</article>", 2)], "page_id bigint, url string, html string, text int")
    got = sorted((tuple(r) for r in extract_pages(pages).collect()), key=str)
    assert got == sorted([(1, "u", "", 0), (1, "u", "", 0), (None, None, "é", 1)], key=str)
    assert extract_pages(pages.where("false")).count() == 0


# ---- mixing ------------------------------------------------------------------------------------------------------


def test_targets():
    from weftline.llm.mixing import targets

    t = targets({"a": 100, "b": 100, "c": 100, None: 10})
    assert sum(t.values()) == pytest.approx(310)
    assert t[None] == pytest.approx(30)  # weight 5 again, but three times its size at most
    assert t["a"] / t["c"] == pytest.approx(5)
    assert targets({}) == {}
    assert targets({"a": 0}) == {"a": 0}


def test_mix(spark, docs, rows, none):
    from weftline.llm import mixing

    got = mixing.mix_documents(docs).collect()
    assert collections.Counter((r["doc_id"], r["size"]) for r in got) == collections.Counter((r[0], len(words_of(r[1]))) for r in rows)
    by = collections.defaultdict(int)
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        by[r["source"]] += r["taken"]
    target = {r["source"]: r["target"] for r in got}
    largest = collections.defaultdict(int)
    for r in got:
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s, t in target.items():
        assert abs(by[s] - t) <= largest[s]
    key = lambda x: sorted(map(str, x))
    assert key(got) == key(mixing.mix_documents(docs.repartition(5)).collect())
    assert mixing.mix_documents(none).count() == 0


def test_mix_levels(spark, monkeypatch):
    """A tree of several levels keeps word sums."""
    from weftline.llm import mixing

    monkeypatch.setattr(mixing, "CHUNK", 8)
    rng = random.Random(2)
    df = spark.createDataFrame([(i, "w " * rng.randint(1, 40), "ab"[i % 3 == 0]) for i in range(900)], "doc_id bigint, text string, source string")
    got = mixing.mix_documents(df).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w")).collect()
    assert all(abs(r["t"] - r["w"]) <= 40 for r in got)


def test_small_sources_meet_their_targets(spark):
    """Sources of a few dozen documents, some of them very long, are mixed to within a small document."""
    from weftline.llm import mixing

    rng = random.Random(7)
    rows = [(i, "w " * rng.choice([rng.randint(20, 600), rng.randint(20, 600), 5000]), f"s{i % 9}") for i in range(400)]
    got = mixing.mix_documents(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    for s in {r["source"] for r in got}:
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 0.01 * mine[0]["target"]
        wanted = mine[0]["target"] / mine[0]["source_size"]
        assert all(math.floor(wanted) <= r["copies"] <= math.ceil(wanted) for r in mine)


def test_repeated_documents(spark, docs, rows):
    from weftline.llm.mixing import mix_documents, repeat_documents

    clash = docs.withColumns({"_id": F.lit(1), "_n": F.lit(2), "_plan": F.lit(3), "_i": F.lit(4)})
    assert repeat_documents(clash).columns == clash.columns
    got = repeat_documents(docs)
    assert got.columns == docs.columns
    want = mix_documents(docs).agg(F.sum("copies")).first()[0]
    assert got.count() == want


# ---- quality -----------------------------------------------------------------------------------------------------


def slow_stats(t):
    w = words_of(t)
    n = len(w)
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    c = collections.Counter(tuple(w[i : i + 8]) for i in range(n - 7))
    mark = [0] * n
    for i in range(n - 7):
        if c[tuple(w[i : i + 8])] > 1:
            mark[i : i + 8] = [1] * 8
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, sum(mark)


def test_statistics(rows):
    from weftline.llm.quality import statistics

    rng = random.Random(3)
    for t in [r[1] for r in rows] + ["".join(rng.choices(["a ", "b ", "\n", "c", " ", "\x1c", "\xa0", " \t\n", "#|", "É ", "a b a b a b a b "], k=rng.randint(0, 60))) for _ in range(500)]:
        assert statistics(t)[:5] == slow_stats(t)


def test_binomial_and_cutoffs():
    from weftline.llm.quality import at_most, choose_cutoff

    exact = sum(math.comb(50, i) * 0.1**i * 0.9 ** (50 - i) for i in range(4))
    assert at_most(3, 50, 0.1) == pytest.approx(exact)
    good, bad = np.zeros(256, int), np.zeros(256, int)
    good[2], good[10], bad[60] = 990, 10, 100
    assert choose_cutoff(good, bad, 0.03, 0.01) in range(10, 60)
    assert choose_cutoff(good // 100, bad, 0.03, 0.01) is None
    # whatever is chosen, the bound holds
    rng = np.random.default_rng(0)
    for _ in range(50):
        g, b = rng.integers(0, 30, 256), rng.integers(0, 30, 256)
        c = choose_cutoff(g, b, 0.1, 0.05)
        assert c is None or at_most(int(g[c + 1 :].sum()), int(g.sum()), 0.1) <= 0.05


def test_repeated_rows_are_one_trial(spark):
    """Five copies of each labelled good document are no more evidence than one."""
    from weftline.llm.quality import fit_rules, with_statistics

    rng = random.Random(4)
    say = lambda mark: " ".join(w + mark for w in rng.choices([f"word{i}" for i in range(200)], k=40))
    good, bad = [(i, say(""), "en") for i in range(150)], [(1000 + i, say("#" * 400), "en") for i in range(40)]
    labels = spark.createDataFrame([(i, 1) for i, *_ in good] + [(i, 0) for i, *_ in bad], "doc_id bigint, quality int")
    fit = lambda rows: fit_rules(with_statistics(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")), labels).collect()
    assert fit(good + bad)
    assert fit(good[:100] + bad) == fit(good[:100] * 5 + bad) == []
    # Levels have no upper end: 400 marks a word are told from 300.
    milder = [(2000 + i, say("#" * 300), "en") for i in range(300)]
    labels = labels.unionByName(spark.createDataFrame([(i, 1) for i, *_ in milder], "doc_id bigint, quality int"))
    assert 30_000 <= fit(good + bad + milder)[0]["_cutoff"] < 40_000


def test_judged(spark, docs, rows, none):
    from weftline.llm.quality import filter_documents, judge_documents

    rng = random.Random(9)
    good = [(1000 + i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "eps", "zeta"], k=60)), "en", "s1") for i in range(400)]
    junk = [(2000 + i, " ".join(w + "###" for w in rng.choices(["alpha", "beta", "gamma", "delta"], k=60)), "en", "s1") for i in range(60)]
    more = spark.createDataFrame(good + junk, SCHEMA)
    labels = spark.createDataFrame([(r[0], 1) for r in good] + [(r[0], 0) for r in junk] + [(1000, None), (1001, 1)], "doc_id bigint, quality int")
    all_docs = docs.select("doc_id", "text", "lang", "source").unionByName(more)
    got = {r["doc_id"]: r for r in judge_documents(all_docs, labels).collect()}
    for i, t, _, _ in [r for r in rows if r[0]] + good + junk:
        n, chars, sym, dup, rep = slow_stats(t)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, sym, dup, rep)
        assert r["base_failed"] == (n < 20 or 100 * rep > 30 * n)
        assert not (r["base_failed"] and r["kept"])
    assert all(got[r[0]]["kept"] for r in good)
    assert not any(got[r[0]]["kept"] for r in junk)
    kept = filter_documents(all_docs, labels)
    assert kept.columns == all_docs.columns
    assert sorted(r[0] or 0 for r in kept.select("doc_id").collect()) == sorted(r[0] or 0 for r in judge_documents(all_docs, labels).where("kept").select("doc_id").collect())
    assert judge_documents(none, labels).count() == 0
    assert judge_documents(docs, labels.where("false")).where("kept and base_failed").count() == 0


# ---- suffix sorting and substrings --------------------------------------------------------------------------------


def slow_suffixes(text):
    order = sorted(range(len(text)), key=lambda i: text[i:], reverse=True)
    same = lambda a, b: next((k for k in range(len(text)) if text[a + k : a + k + 1] != text[b + k : b + k + 1] or not text[a + k : a + k + 1]), len(text))
    return order, [same(a, b) for a, b in zip([None, *order], order, strict=False) if a is not None]


@pytest.mark.parametrize("chunk", [5, 1 << 17])
def test_suffixes(monkeypatch, chunk):
    """Order and common prefixes, with queues that spill and with recursion on names."""
    from weftline.llm import induced

    monkeypatch.setattr(induced, "CHUNK", chunk)
    rng = random.Random(5)
    before = induced.spilled
    for trial in range(60):
        n = rng.randint(0, 160)
        text = bytes(rng.choices(b"abcdefghijklmnopqrstuvwxyz"[: rng.choice([1, 2, 3, 26])], k=n))
        if n and rng.random() < 0.4:
            text = (text[: rng.randint(1, 20)] * 60)[:n]
        got = list(induced.suffixes(np.frombuffer(text, np.uint8), 256, budget=64, doubled=[0, 9, 1 << 20][trial % 3]))
        order = [int(i) for at, _ in got for i in at]
        common = [int(i) for _, lcp in got for i in lcp][1:]
        assert (order, common) == slow_suffixes(text)
    assert induced.spilled > before


def test_shard_beyond_its_memory(monkeypatch):
    """A shard whose queues and text go to disk finds what brute force finds."""
    import pyarrow as pa

    from weftline.llm import induced, substring_dedup

    rng = random.Random(2)
    pieces = ["".join(rng.choices("abc ", k=600)).encode() + BASE.encode() * rng.randint(1, 6) for _ in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array([7] * 60), pa.array(range(60)), pa.array([len(p) - 399 for p in pieces], pa.int32()), pa.array(pieces, pa.binary())], names=["key", "piece", "wins", "bytes"])
    before = induced.spilled
    found = list(substring_dedup._sorted_shard(400, False, 4096)(iter([batch.slice(0, 20), batch.slice(20)])))[0].to_pylist()
    assert induced.spilled - before > 10 * sum(map(len, pieces))
    n = collections.Counter(p[k : k + 400] for p in pieces for k in range(len(p) - 399))
    want = {(i, k) for i, p in enumerate(pieces) for k in range(len(p) - 399) if n[p[k : k + 400]] > 1}
    assert {(r["piece"], k) for r in found for k in range(r["lo"], r["hi"] + 1)} == want


def slow_passages(rows, length):
    """Texts without the words that runs of length words cover which also start elsewhere, A-Z lower-cased."""
    n = collections.Counter()
    split = [[(m.start(), m.group().lower()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for _, t, *_ in rows]
    for w in split:
        n.update(tuple(x for _, x in w[k : k + length]) for k in range(len(w) - length + 1))
    whole = collections.Counter((t or "") for _, t, *_ in rows)
    out = []
    for (i, t, *_), w in zip(rows, split, strict=True):
        text, gone = (t or "").encode(), set()
        for k in range(len(w) - length + 1):
            if n[tuple(x for _, x in w[k : k + length])] > 1:
                gone |= set(range(k, k + length))
        ends = [*[a for a, _ in w[1:]], len(text)]
        keep = text[: w[0][0] if w else len(text)] + b"".join(text[a:e] for k, ((a, _), e) in enumerate(zip(w, ends, strict=False)) if k not in gone)
        out.append((i, "" if whole[t or ""] > 1 and len(w) >= length else keep.decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [512, 4])
def test_passages_by_words(spark, rows, monkeypatch, hot):
    """Passages of 51, 60 and 80 words go, whatever white space and case; those of 50 words stay."""
    from weftline.llm import substring_dedup

    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=rng.randint(1, 9)))
    more = []
    for size in (50, 51, 60, 80):
        passage = [word() for _ in range(size)]
        more += [(1000 * size + i, " ".join([word() for _ in range(rng.randint(0, 90))]) + "\n" + rng.choice([" ", "\n\t"]).join(passage if i % 2 else map(str.upper, passage)) + "  " + " ".join([word() for _ in range(rng.randint(0, 90))])) for i in range(9)]
    more = [(*r, None, None) for r in more]
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    every = [r for r in rows if r[0] is not None] + more
    got = sorted(((r["doc_id"], r["text"] or "") for r in substring_dedup.deduplicate(spark.createDataFrame(every, SCHEMA).repartition(3)).collect()), key=str)
    assert got == slow_passages(every, 51)
    left = dict(got)
    assert all((left[i] == (t or "")) == (i // 1000 == 50) for i, t, *_ in more)


def slow_removal(rows, length):
    n = collections.Counter()
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    for _, t in texts:
        for k in range(len(t) - length + 1):
            n[t[k : k + length]] += 1
    out = []
    for i, t in texts:
        edge = np.zeros(len(t) + 1, int)
        for k in range(len(t) - length + 1):
            if n[t[k : k + length]] > 1:
                edge[k] += 1
                edge[k + length] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        left = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((i, len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [512, 4])
def test_substrings(spark, docs, rows, hot):
    from weftline.llm.substring_dedup import repeated_substrings

    rng = random.Random(1)
    passage = BASE * 12
    more = [(10_000 + i, "".join(rng.choices("abcdef \n", k=rng.randint(5, 300))) + passage[:900] + "".join(rng.choices("uvwxyz \n", k=rng.randint(5, 300))), None, None) for i in range(40)]
    all_docs = docs.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(more, SCHEMA))
    got = sorted((tuple(r) for r in repeated_substrings(all_docs, hot=hot).collect()), key=str)
    assert got == slow_removal(rows + more, 400)


def test_planted_passages(spark):
    """Passages of over 50 words in two texts each: 399 bytes stay, 400 go; n_bytes is the input's length either way."""
    from weftline.llm.substring_dedup import repeated_substrings

    rng = random.Random(8)
    say = lambda n, letters: " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(n))
    rows = [(i, say(rng.randint(30, 200), "klmnopqrs"), None, None) for i in range(20)]
    for size in (285, 373, 399, 400, 401, 560):
        passage = say(120, "abcdefghij")[: size - 1].rstrip() + "z"
        passage += "z" * (size - len(passage))
        assert len(passage) == size and len(passage.split()) > 50
        rows += [(100 * size + i, f"{say(40, 'klmnopqrs')}{'<{'[i]}{passage}{'>}'[i]}{say(40, 'klmnopqrs')}", None, None) for i in range(2)]
    got = sorted((tuple(r) for r in repeated_substrings(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == slow_removal(rows, 400)
    assert {i: (n, gone) for i, n, gone, *_ in got} == {i: (len(t), i // 100 if i // 100 >= 400 else 0) for i, t, *_ in rows}


def test_substrings_tables(spark, docs, none):
    from weftline.llm.substring_dedup import deduplicate, repeated_substrings

    assert repeated_substrings(none).count() == 0
    clash = docs.withColumns({"_sha": F.lit(1), "_kept": F.lit(2), "tid": F.lit(3)})
    assert deduplicate(clash).columns == clash.columns
    assert deduplicate(clash).count() == docs.count()
    out = deduplicate(docs, length=400, words=False)
    assert out.columns == docs.columns
    assert out.count() == docs.count()
    again = {r["doc_id"]: r["n_removed"] for r in repeated_substrings(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in out.collect():
        if r["doc_id"] in again and r["doc_id"] is not None and again[r["doc_id"]] == 0:
            assert r["text"] == texts[r["doc_id"]]


# ---- language model ------------------------------------------------------------------------------------------------


def test_language_model(spark, docs, rows, none):
    from weftline.llm.language_model import score_documents

    got = score_documents(docs).collect()
    tok = lambda t: (t or "").encode().lower().split() + [b""]
    counts = collections.Counter()
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    for i, t, *_ in rows:
        if not out(i):
            counts.update(tok(t))
    total = sum(counts.values())
    less = math.log10(total + 0.1 * (len(counts) + 1))
    want = collections.Counter((i, out(i), len(tok(t)), sum(w in counts for w in tok(t)), total, round(sum(math.log10(counts.get(w, 0) + 0.1) - less for w in tok(t)), 5)) for i, t, *_ in rows)
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert score_documents(none).count() == 0


def test_language_model_learns(spark):
    """Held-out texts of two alternating languages score higher than under word frequencies alone."""
    from weftline.llm.language_model import score_documents

    rng = random.Random(8)
    langs = [[f"{p}{i}{p}" for i in range(200)] for p in ("ka", "lo")]
    df = spark.createDataFrame([(i, " ".join(rng.choices(langs[i % 2], k=200))) for i in range(400)], "doc_id bigint, text string")
    held = score_documents(df).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert held["s"] > held["b"]


def slow_scores(docs, train):
    """log10 probabilities of texts after one minibatch of gradient updates, token by token with dictionaries."""
    from weftline.llm import language_model as L

    def tokens(t):
        t = L.Tokens([t.encode()])
        return [(int(h), int(s)) for h, s in zip(t.h1, t.suffix_leaves(), strict=True)]

    def fold(x):
        x ^= x >> 15
        x = x * 0x2C1B3C6D & 0xFFFFFFFF
        return (x ^ x >> 13) % L.LEAST_ROWS

    c = collections.Counter(x for t in train for x in tokens(t))
    often = sorted(c.items(), key=lambda y: (-y[1], y[0][0] - (y[0][0] >> 63 << 64)))
    placed = L.Lexicon(np.array([x[0] for x, _ in often], np.uint64), np.array([k for _, k in often], float)).place >= 0
    assert placed.mean() > 0.9
    single = {x: i for i, x in enumerate([x for (x, _), p in zip(often, placed, strict=True) if p][: L.SINGLE])}
    leaf = lambda x: single.get(x, x[1])
    n, v = collections.Counter(), collections.Counter()
    for x, k in c.items():
        n[leaf(x)] += k
        v[leaf(x)] += 1
    mass = [n[i] + 0.1 * (v[i] + 1) for i in range(256)]
    top = [sum(mass[16 * i : 16 * i + 16]) for i in range(16)]
    bias = [np.log(np.array(top) / sum(top))] + [np.log(np.array(mass[16 * i : 16 * i + 16]) / top[i]) for i in range(16)]

    def steps(t):
        got = tokens(t)
        hashes = [0, 0] + [x[0] >> 32 | 1 for x in got]
        for i, x in enumerate(got):
            two, one = hashes[i], hashes[i + 1]
            for node, way in ((0, leaf(x) // 16), (1 + leaf(x) // 16, leaf(x) % 16)):
                add = node * 0x632BE5AB
                yield x, node, way, [(0, fold(one * 0x9E3779B1 + add & 0xFFFFFFFF)), (1, fold(two * 0x85EBCA6B + 1 + add & 0xFFFFFFFF)), (2, fold(one * 0xC2B2AE35 + two * 0x27D4EB2F + 2 + add & 0xFFFFFFFF))]

    w = collections.defaultdict(lambda: np.zeros(16))
    grad = collections.defaultdict(lambda: np.zeros(16))
    for t in train:
        for _, node, way, rows in steps(t):
            p = np.exp(bias[node])
            p[way] -= 1
            for r in rows:
                grad[r] = grad[r] + p
    for r, g in grad.items():
        w[r] = (-L.RATE * g / np.sqrt((g * g).sum() + 1)).astype(np.float16).astype(float)
    total, out = sum(c.values()), []
    for t in docs:
        score = 0.0
        for x, node, way, rows in steps(t):
            z = bias[node] + sum(w[r] for r in rows)
            score += (z[way] - np.log(np.exp(z).sum())) / np.log(10)
            if node:
                score += math.log10((c[x] + 0.1) / mass[leaf(x)])
        out.append(score)
    assert total
    return out


def test_language_model_slowly(spark):
    from weftline.llm.language_model import score_documents

    rng = random.Random(21)
    words = [f"{a}{b}" for a in ("ba", "long-word", "x", "é") for b in range(12)]
    texts = {i: " ".join(rng.choices(words, k=rng.randint(0, 60))) for i in range(1, 25)}
    out = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    got = {r["doc_id"]: r["score"] for r in score_documents(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").coalesce(1), rounds=1).collect()}
    want = slow_scores(texts.values(), [t for i, t in texts.items() if not out(i)])
    assert [got[i] for i in texts] == pytest.approx(want, rel=2e-3)
    assert any(map(out, texts))


def test_probabilities_sum_to_one():
    from weftline.llm import language_model as L

    rng = np.random.default_rng(0)
    w = rng.normal(size=(L.KINDS, L.LEAST_ROWS, L.FAN)).astype(np.float32)
    bias = L.biases(rng.integers(0, 50, L.LEAVES).astype(float), rng.integers(0, 5, L.LEAVES).astype(float))
    t = L.Tokens([b"one", b"one"])
    total = 0.0
    for leaf in range(L.LEAVES):
        node, way, row = L.decisions(t, np.full(4, leaf), L.LEAST_ROWS)
        total = total + np.exp(L.log_paths(w, bias, node, way, row).reshape(-1, L.DEPTH).sum(axis=1))
    assert total == pytest.approx(np.ones(4), abs=1e-4)
    assert (row.reshape(L.KINDS, 4, -1)[:, 0] == row.reshape(L.KINDS, 4, -1)[:, 2]).all()  # both texts start the same way


def test_token_hashes():
    from weftline.llm.tokens import END1, END2, TextWords

    rng = random.Random(3)
    texts = ["".join(rng.choices("ab \té\n\x0bZzÉ", k=rng.randint(0, 300))).encode() for _ in range(50)] + [b"", b" ", b"x" * 5000, b"X" * 5000]
    w = TextWords(texts)
    words = [x for t in texts for x in t.lower().split()]
    pairs = list(zip(w.h1.tolist(), w.second().tolist(), strict=True))
    assert len(set(zip(words, pairs, strict=True))) == len(set(words)) == len(set(pairs))
    assert (END1, END2) not in pairs
    assert np.diff(np.append(w.starts, len(words))).tolist() == [len(t.split()) for t in texts]
    for n, last in zip((2, 3), w.last(2, 3), strict=True):
        assert last.tolist() == [int.from_bytes(x[-n:].rjust(0), "little") for x in words]


# ---- near duplicates ------------------------------------------------------------------------------------------------


def slow_groups(rows):
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                top[max(root(i), root(j))] = min(root(i), root(j))
    groups = collections.defaultdict(list)
    for k in range(len(rows)):
        groups[root(k)].append(rows[k][0])
    out = []
    for k, r in enumerate(rows):
        ids = [i for i in groups[root(k)] if i is not None]
        comp = min(ids) if ids else None
        out.append((r[0], len(sets[k]), comp, r[0] == comp))
    return sorted(out, key=str)


def test_near_duplicates(spark, docs, rows, none):
    from weftline.llm.near_dedup import keep_one_of_each, near_duplicates

    got = sorted((tuple(r) for r in near_duplicates(docs).collect()), key=str)
    assert got == slow_groups(rows)
    clash = docs.withColumns({"_id": F.lit(1), "_n": F.lit(2), "m": F.create_map(F.lit("a"), F.lit(1))})
    assert keep_one_of_each(clash).columns == clash.columns
    left = keep_one_of_each(docs)
    assert left.columns == docs.columns
    assert keep_one_of_each(clash).count() == left.count()
    ids = [r[0] for r in left.where("doc_id = 200").select("doc_id").collect()]
    assert len(ids) <= 1
    assert near_duplicates(none).count() == 0


def test_pairs_at_the_threshold(spark):
    """Of 300 pairs at a likeness of exactly 0.75 all are linked, and none of 300 just below."""
    from weftline.llm.near_dedup import near_duplicates

    rng = random.Random(17)
    rows = []
    for i in range(600):
        body = [f"w{i}x{k}" for k in range(60)]
        cut = 8 if i < 300 else 9  # 48 of 64 shingles, or 47 of 65
        rows += [(2 * i, " ".join(body)), (2 * i + 1, " ".join(body[:-cut] + [f"v{rng.random()}" for _ in range(cut)]))]
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    assert all(got[2 * i + 1] == 2 * i for i in range(300))
    assert all(got[2 * i + 1] == 2 * i + 1 for i in range(300, 600))


def test_near_duplicates_in_small_blocks(spark, rows, monkeypatch):
    """Blocks much smaller than a bucket find the same groups."""
    from weftline.llm import near_dedup

    rng = random.Random(6)
    base = [f"w{i}" for i in range(80)]
    near = [(i, " ".join(w if rng.random() > 0.025 else f"x{rng.randint(0, 9)}" for w in base), None, None) for i in range(120)]
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    got = sorted((tuple(r) for r in near_dedup.near_duplicates(spark.createDataFrame(near, SCHEMA)).collect()), key=str)
    assert got == slow_groups(near)


def test_templates_are_split_by_rare_shingles(spark, monkeypatch):
    """A bucket of many texts of one template, most of them not linked, is split and still finds every link."""
    from weftline.llm import near_dedup

    rng = random.Random(16)
    frame = [f"t{i}" for i in range(70)]
    rows = []
    for i in range(90):
        own = [f"o{i}x{k}" for k in range(26)]
        rows.append((3 * i, " ".join(frame + own)))
        if i % 3 == 0:
            rows.append((3 * i + 1, " ".join(frame + own[:-3] + ["z", "zz", "zzz"])))
        if i % 5 == 0:
            rows.append((3 * i + 2, " ".join(["a", "b"] + frame + own + [f"q{rng.random()}"])))
    rows = [(*r, None, None) for r in rows]
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "BIG", 20)
    seen, parted = [], near_dedup._parted

    def watched(members, linker, big):
        out = parted(members, linker, big)
        seen.append((out.where("part <> 0").count(), out.groupBy("bucket", "part").count().where("part <> 0").agg(F.max("count")).first()[0] or 0))
        return out

    monkeypatch.setattr(near_dedup, "_parted", watched)
    got = sorted((tuple(r) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == slow_groups(rows)
    assert seen[0][0] > 0
    assert seen[0][1] <= 20


def test_estimate(spark):
    from weftline.llm import shingles as S
    from weftline.llm.near_dedup import estimate

    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    b = np.concatenate([a[:2400], rng.integers(0, 1 << 63, 600, dtype=np.uint64)])
    sig = [S.packed(S.minima(np.unique(x))).tolist() for x in (a, b)]
    got = spark.createDataFrame([tuple(sig)], "a array<bigint>, b array<bigint>").select(estimate(F.col("a"), F.col("b"))).first()[0]
    assert got == pytest.approx(2400 / 3600, abs=0.15)


def test_components(spark):
    from weftline.llm.graphs import components, merged

    rng = random.Random(0)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(5, 5)]
    top = {}

    def root(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            top[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    want = {k: root(k) for k in list(top)}
    assert {r["node"]: r["comp"] for r in components(df).collect()} == want
    half = components(df.where("a % 2 = 0"))
    assert {r["node"]: r["comp"] for r in merged(half, df.where("a % 2 = 1")).collect()} == want
    assert components(df.where("false")).count() == 0


# ---- archives --------------------------------------------------------------------------------------------------------


def test_archives(spark, tmp_path):
    from weftline.llm.warc import read_archives, round_trip

    long = "<p>" + "é漢x\r\n\r\nWARC/1.1\r\n" * 8000
    pages = [(1, "http://a/1", "<p>" + "same " * 40), (2, "http://a/2", "<p>" + "same " * 40), (3, "http://a/3\nX: y", "short"), (4, None, "short"), (5, "u", None), (6, "u", ""), (7, "http://long", long), (8, "http://long", long), (9, "http://alone", long + "z"), (None, "http://x", "nothing here")]
    df = spark.createDataFrame([(*p, 5) for p in pages], "page_id bigint, url string, html string, digest int").repartition(2)
    got = {r["page_id"]: r for r in round_trip(df).collect()}
    assert len(got) == len(pages)
    for i, url, html in pages:
        data = (html or "").encode()
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"], r["url"]) == (len(data), hashlib.sha256(data).hexdigest(), url)
    assert {i: r["refers_to"] for i, r in got.items() if r["record_type"] == "revisit"} == {2: 1, 8: 7}
    assert round_trip(df.where("false")).count() == 0
    assert round_trip(df.where("page_id = 7").union(df.where("page_id = 7"))).count() == 2
    assert read_archives  # the reader stands alone, too


def test_archives_with_names_as_ids(spark):
    from weftline.llm.warc import round_trip

    same = "<p>" + "same " * 40
    pages = [("b 1", same), ("a\nWARC-Type: x", same), ("é", "x"), ("", "y"), (" z", same + "!"), ("7", same)]
    got = {r["page_id"]: r for r in round_trip(spark.createDataFrame([(i, "u", h) for i, h in pages], "page_id string, url string, html string")).collect()}
    assert set(got) == {i for i, _ in pages}
    assert {i: r["refers_to"] for i, r in got.items() if r["record_type"] == "revisit"} == {"b 1": "7", "a\nWARC-Type: x": "7"}


def test_segments_are_checked():
    from weftline.llm import warc

    body = "é".encode() * 30_000
    digest = hashlib.sha256(body).hexdigest()
    made = list(warc.records(1, "u", body, digest, None, None, "m"))
    assert len(made) > 3
    found = list(warc.parsed(b"".join(made)))
    assert [f.get("warc-segment-number") for f, _ in found] == [str(i) for i in range(1, len(made) + 1)]
    assert warc.payload_of(b"".join(b for _, b in found)) == body
    assert all(b.decode() for _, b in found)
    with pytest.raises(ValueError, match="digest"):
        warc._checked(b"".join(b for _, b in found), "0")
    with pytest.raises(ValueError, match="broken|invalid|subsection"):
        warc.dechunked(b"5\r\nabc")


# ---- encoding --------------------------------------------------------------------------------------------------------


def test_encoding(spark, docs, rows, none):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from weftline.llm.bpe import encode_documents, encoder

    path = P.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        enc = encoder(f.read())
    rng = random.Random(1)
    pool = [*"aAbBzZéÉßΣσςİıǅ é'sS'T  \x1c\x1f\x85　 12٣½\n\t😀漢字한ᄀ̀", "<|endoftext|>", "<|startoftext|>", "'re", "'LL", " the ", "ing"]
    texts = [r[1] or "" for r in rows] + ["".join(rng.choices(pool, k=rng.randint(0, 60))) for _ in range(2000)] + ["a" * 500, "hahahahahaha" * 9]
    for t, (n, ids, text) in zip(texts, enc.encode(texts), strict=True):
        want = lib.encode(t, add_special_tokens=False).ids
        assert (n, np.frombuffer(ids, "<u4").tolist(), text) == (len(want), want, lib.decode(want, skip_special_tokens=False))
    got = collections.Counter((r["doc_id"], r["n_tokens"], tuple(r["ids"])) for r in encode_documents(docs, path).collect())
    assert got == collections.Counter((i, len(x), tuple(x)) for i, x in ((r[0], lib.encode(r[1] or "", add_special_tokens=False).ids) for r in rows))
    assert encode_documents(none, path, digests=True).count() == 0
