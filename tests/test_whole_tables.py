"""Queries over all complete iterations, against plain Python over the whole segment table."""

import collections
import hashlib
import os

import pytest

from weftline.operators import flux as X
from weftline.plans.catalogue import BASIS, N, QUERIES, TARGET
from weftline.sources import views as V

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def segments(spark):
    rows = [r.asDict() for r in X.with_states(V.segments(spark, SF), N, V.BASIS, V.TARGET).collect()]
    last = collections.defaultdict(int)
    for r in rows:
        last[r["file_idx"]] = max(last[r["file_idx"]], r["n_iter"])
    return [r for r in rows if r["n_iter"] < last[r["file_idx"]]]


def close(got, want):
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=2e-6) for k in want)


def test_start_weights(spark, segments):
    pi = {r["state"]: r["value"] for r in QUERIES["steady_state_power"](spark, SF).collect()}
    total = collections.Counter()
    for r in segments:
        total[r["to_state"]] += r["weight"]
    want = {(r["n_iter"], r["seg_id"]): r["weight"] * pi[r["to_state"]] / total[r["to_state"]] for r in segments if r["to_state"] not in (BASIS, TARGET) and pi[r["to_state"]] > 0}
    got = {(r["n_iter"], r["seg_id"]): r["start_weight"] for r in QUERIES["start_state_weights"](spark, SF).collect()}
    close(got, want)
    assert len({i for i, _ in got}) > 20


def test_pcoord_flux(spark, segments):
    place = lambda x: -1 if x < 0 else 10 if x >= 200 else int(x // 20)
    total, want = collections.Counter(), collections.Counter()
    for r in segments:
        total[r["n_iter"]] += r["weight"]
    for r in segments:
        want[place(r["p0"]), place(r["p1"])] += r["weight"] / total[r["n_iter"]] / len(total)
    close({(r["from_state"], r["to_state"]): r["w"] for r in QUERIES["flux_pcoord1d"](spark, SF).collect()}, dict(want))
    assert sum(want.values()) == pytest.approx(1)


def test_structures(spark, segments):
    refs = sorted(map(tuple, QUERIES["structure_references"](spark, SF).collect()))
    assert refs == sorted((r["seg_id"], f"hdf:f{r['file_idx']}:{r['n_iter']}:{r['seg_id']}") for r in segments)
    labels = sorted((r["n_iter"], r["label"], r["bin"], r["seg"]) for r in QUERIES["parsed_labels"](spark, SF).collect())
    assert labels == sorted((r["n_iter"], f"b{r['to_cluster']}_s{r['seg_id']}", r["to_cluster"], r["seg_id"]) for r in segments)
    name = lambda r: hashlib.md5(f"{r['p0']:.2f},{r['p1']:.2f}".encode()).hexdigest()
    known = {}
    for r in segments:
        known[name(r)] = min(known.get(name(r), 99), r["to_state"])
    got = sorted((r["n_iter"], r["seg_id"], r["hash"], r["state"]) for r in QUERIES["structure_hash_states"](spark, SF).collect())
    assert got == sorted((r["n_iter"], r["seg_id"], name(r), known[name(r)]) for r in segments)
