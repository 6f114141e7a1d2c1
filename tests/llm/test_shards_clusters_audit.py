"""Sharding, centroid clustering and the filter audit against plain re-computations."""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import zlib
from itertools import permutations
from pathlib import Path

import numpy as np
import pytest

from terrafold.llm import dual_tree, filter_audit, sharding

SF = Path("/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, shard string, slot long, key string"


def documents(spark, rows):
    """Rows of (doc_id, text, lang), with columns of names that operators use themselves."""
    return spark.createDataFrame([(i, t, lang, "s", "x", 7, "k") for i, t, lang in rows], DOCS)


# Sharding

def loads(rows, shards):
    out = [0] * shards
    for r in rows:
        out[r.shard] += r.size
    return out


def check_places(rows, shards):
    for k in range(shards):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))


def test_shards_are_those_of_the_textbook(spark):
    rng = np.random.default_rng(5)
    texts = ["é" * int(n) + f"#{k}" for k, n in enumerate(rng.integers(0, 900, 150))]
    rows = [(i, texts[int(k)], "en") for i, k in enumerate(rng.integers(0, 150, 400))]
    found = sharding.assign(documents(spark, rows), shards=5, parts=1 << 20).collect()
    text_of = dict((i, t) for i, t, _ in rows)
    groups = {}
    for i, t, _ in rows:
        groups[t] = groups.get(t, 0) + len(t.encode()) + 8
    heap, place = [(0, k) for k in range(5)], {}
    for t in sorted(groups, key=lambda t: (-groups[t], hashlib.md5(t.encode()).digest())):
        load, k = heap[0]
        heapq.heapreplace(heap, (load + groups[t], k))
        place[t] = k
    assert len(found) == len(rows) and all(r.shard == place[text_of[r.id]] for r in found)
    assert all(r.size == len(text_of[r.id].encode()) + 8 and r.crc == zlib.crc32(text_of[r.id].encode()) for r in found)
    check_places(found, 5)


def test_small_groups_go_in_pieces_and_loads_stay_near(spark):
    rows = [(i, f"text number {i} " * (1 + i % 7), "en") for i in range(3000)]
    found = sharding.assign(documents(spark, rows), shards=4, parts=16).collect()
    check_places(found, 4)
    of = loads(found, 4)
    assert len(found) == 3000 and max(of) - min(of) <= 2 * math.ceil(sum(of) / 64)


def test_a_hot_group_stays_together(spark):
    rows = [(i, "the same text for many" if i % 2 else f"own {i}", "en") for i in range(600)]
    found = sharding.assign(documents(spark, rows), shards=3, parts=8).collect()
    check_places(found, 3)
    assert len({r.shard for r in found if r.id % 2}) == 1 and len(found) == 600


def test_shards_of_odd_input(spark):
    rows = [(None, None, None), (1, "", "en"), (1, "", "en"), (None, None, None), (2, "a" * 300_000, "en"), (3, "x", None)]
    found = sharding.assign(documents(spark, rows), shards=24).collect()
    assert len(found) == 6 and len({r.shard for r in found if r.size == 8}) == 1  # null and empty texts are equal
    check_places(found, 24)
    assert sharding.assign(documents(spark, []), shards=24).count() == 0


def test_written_shards(spark, tmp_path):
    rows = [(i, f"text {i % 40}", "en") for i in range(200)]
    docs = documents(spark, rows)
    sharding.write_shards(docs, f"file://{tmp_path}/out", shards=4)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    placed = {r.id: r.shard for r in sharding.assign(docs, shards=4).collect()}
    assert {r.doc_id: r.shard for r in back.collect()} == placed and set(back.columns) == set(docs.columns)


# Clustering

def plain_lloyd(ids, q, k, rounds):
    first = sorted(range(len(q)), key=lambda i: (hashlib.sha256(f"1:{'' if ids[i] is None else ids[i]}".encode()).hexdigest(), q[i].tolist()))[:k]
    centroids = q[first].copy()
    for n in range(rounds + 1):
        d = ((q[:, None] - centroids[None]) ** 2).sum(2)
        a = d.argmin(1)
        if n < rounds:
            for c in range(len(centroids)):
                if (a == c).any():
                    centroids[c] = [int(x) // int((a == c).sum()) for x in q[a == c].sum(0)]
    return a, d[np.arange(len(q)), a], centroids


@pytest.mark.parametrize("spread", [1, 40, 100_000_000])
def test_dual_tree_is_lloyd(spark, spread):
    rng = np.random.default_rng(spread)
    centres = rng.integers(-spread, spread + 1, (7, 6))
    q = (centres[rng.integers(0, 7, 900)] + rng.integers(-3, 4, (900, 6))).clip(-dual_tree.LARGEST, dual_tree.LARGEST)
    ids = [int(i) if i % 50 else None for i in range(900)]
    kept = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, q)], "id long, q array<int>")
    found, centroids = dual_tree.lloyd(kept, k=9, rounds=3)
    a, d, want = plain_lloyd(ids, q.astype(np.int64), 9, 3)
    assert (centroids == want).all()
    key = lambda x: tuple(-1 if v is None else int(v) for v in x)
    assert sorted((key((r.id, r.cluster, r.distance)) for r in found.collect())) == sorted(map(key, zip(ids, a, d)))


def test_cover_tree_covers_and_prunes():
    rng = np.random.default_rng(1)
    centres = rng.integers(-2000, 2000, (5, 64))
    q = (centres[rng.integers(0, 5, 256)] + rng.integers(-40, 40, (256, 64))).astype(np.int32)
    order, nodes = dual_tree.cover_tree(q)
    x = q[order].astype(np.int64)
    for start, end, low, high, reach in nodes:
        assert ((x[start:end] - x[start]) ** 2).sum(1).max() == reach
        kids = nodes[low:high]
        if high:
            assert kids[0][0] == start and kids[-1][1] == end and all(a[1] == b[0] for a, b in zip(kids, kids[1:])) and all(4 * k[4] <= reach for k in kids)
            assert all(4 * ((x[a[0]] - x[b[0]]) ** 2).sum() > reach for i, a in enumerate(kids) for b in kids[:i])
    runs, compared = dual_tree.nearest(q[order], nodes, centres, dual_tree.cover_tree(centres))
    assert compared < 256 and sum(e - s for s, e, _ in runs) == 256


def test_vectors_of_odd_input(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.01]), (1, [0.5, -0.01]), (2, None), (3, [1.0]), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, [None, 0.0]), (None, [0.25, 0.0]), (7, [])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster string")
    kept = dual_tree.kept_vectors(table, dim=2)
    assert sorted((r.id or 0, r.q) for r in kept.collect()) == [(0, [16, 0]), (1, [32, -1]), (1, [32, -1])]
    found, centroids = dual_tree.lloyd(kept, k=16)
    assert len(centroids) == 3 and sorted(r.distance for r in found.collect()) == [0, 0, 0]
    assert dual_tree.lloyd(kept.limit(0))[0].count() == 0
    with pytest.raises(Exception, match="beyond"):
        dual_tree.kept_vectors(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>"), dim=1).collect()


# Filter audit

def plain_audit(rows, labels):
    smallest = {}
    for i, t, _ in rows:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, x in labels if x == 1} - {None}
    fails = []
    for i, t, lang in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": bool(set(t) & set("#$%&*|")), "E": i is not None and i > smallest[t]}
        fails.append((lang or "", {f for f in bad if bad[f]}, i in good, i in toxic))
    out = {}
    for part in {f[0] for f in fails}:
        own = [f for f in fails if f[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order):
                gone = lambda x: bool(x[1] & set(order[:step]))  # noqa: B023, E731
                here = [x for x in own if f in x[1] and not gone(x)]
                out[part, order, step + 1] = [sum(not (x[1] & set(order[: step + 1])) for x in own), len(here), sum(f in x[1] and gone(x) for x in own), sum(x[1] == {f} for x in own), sum(x[2] for x in here), sum(x[3] for x in here)]
    for key in list(out):
        f = key[1][key[2] - 1]
        out[key] = [*out[key][:6], sum(v[1] for k, v in out.items() if k[0] == key[0] and k[1][k[2] - 1] == f)]
    return out


def test_audit_is_that_of_every_order(spark):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(400)] + ["BIG", "a#b", "x|y"]
    pool = [None, "", "ONE TWO", "café " * 150] + [" ".join(rng.choice(words if k % 3 else words[:400], int(rng.integers(1, 400)), replace=bool(k % 2))) for k in range(40)]
    rows = [(int(i) if i % 31 else None, pool[int(rng.integers(0, len(pool)))], [None, "", "en", "de"][int(rng.integers(0, 4))]) for i in rng.permutation(300)]
    rows += rows[:20] + [(9999, "long " * 60_000 + "UP", "en")]
    labels = [(int(rng.integers(0, 330)), [None, 0, 1][int(rng.integers(0, 3))], [None, 0, 1][int(rng.integers(0, 3))]) for _ in range(250)] + [(None, 1, 1)]
    found = filter_audit.audit(filter_audit.histograms(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    want = plain_audit(rows, labels)
    assert {(r.part, r.filter_order, r.step): list(r)[3:] for r in found} == want and len(found) == len(want)


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.histograms(documents(spark, []), labels)).count() == 0
    assert filter_audit.audit(filter_audit.histograms(documents(spark, [(1, "a", None)]), labels)).count() == 600


@pytest.mark.skipif(not SF.exists(), reason="no tables")
@pytest.mark.parametrize("name", ["op11_sharding", "op12_dual_tree", "op13_filter_audit"])
def test_same_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from terrafold.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    ours, theirs = QUERIES[name](spark, str(SF)).toPandas(), con.sql(SQL[name]).df()
    told = lambda frame: sorted(map(str, frame[sorted(frame.columns)].astype(object).where(frame.notna(), None).itertuples(index=False, name=None)))
    assert sorted(ours.columns) == sorted(theirs.columns) and told(ours) == told(theirs)


# The working point of the toxicity curve

def test_the_working_point_is_the_best_cut():
    from terrafold.llm import toxicity

    y = np.array([0, 0, 0, 1, 1])
    assert toxicity.working_point(np.array([-3.0, -2.0, -1.0, 1.0, 2.0]), y) == 0.0  # 0 parts them already
    assert toxicity.working_point(np.array([-9.0, -8.0, -7.0, -5.0, -4.0]), y) == -6.0
    assert toxicity.working_point(np.array([3.0, 4.0, 5.0, 7.0, 9.0]), y) == 6.0
    # A toxic text among many ordinary ones is not worth their false alarms.
    m, y = np.r_[np.arange(-100.0, 0.0), [-50.5, 5.0, 6.0]], np.r_[np.zeros(100), [1, 1, 1]]
    assert toxicity.working_point(m, y) == 0.0
    assert -1 < toxicity.steady_point(m, y) <= 0.0
