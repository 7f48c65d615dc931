from __future__ import annotations

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np

from shoebox.llm import prefixtrie
from shoebox.llm.prefixtrie import NodeTable, prefix_trie, subtree_sums

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            tie = hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest()
            own[c].append(((t is not None, t or 0), tie, (r, x)))
    own = {c: [v[2] for v in sorted(vs)] for c, vs in own.items()}
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(list)
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        p = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:])
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
        ends[p].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out, leaves, saved = [], {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
        digest = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        up = min(members[p[:-1]]) if p else None
        out.append((min(members[p]), len(p), up, len(members[p]), len(kids[p]), leaves[p], saved[p], digest))
    return sorted(map(str, out))


def found(frame, **options):
    return sorted(str(tuple(r)) for r in prefix_trie(frame, **options).select(*COLUMNS).collect())


def test_equals_brute_force_with_nulls_ties_copies_and_clashing_names(spark):
    rows = [(0, t, "user", f"hello {t}") for t in range(7)]
    rows += [(c, t, "user", f"hello {t}") for c in (1, 2, 3, 105, 100) for t in range(6)]
    rows += [(4, None, None, None), (4, None, "user", "b"), (4, 2, "", "a"), (4, 2, "user", "a"), (4, 2, "user", "a")]
    rows += [(None, 1, "user", "lost"), (205, 1, "x", "no first"), (-7, 1, "a", "below zero"), (-7, 2, "a", "😀é")]
    rows += [(300, 0, "a", "one turn only"), *((300 + i, 0, "b", "mine") for i in range(1, 40))]
    rows += [(50, 1, "user", "long " * 50_000), (51, 1, "us", "er:" + "long " * 50_000)]
    frame = spark.createDataFrame([(*r, "x", 0, 5) for r in rows], SCHEMA + ", pid string, depth int, hi long")
    assert found(frame) == brute(rows)


def test_long_and_common_conversations_are_cut_between_tasks_and_runs(spark):
    rng = np.random.default_rng(1)
    rows = [(7, t, "u", f"t{t}") for t in range(400)] + [(8, t, "u", f"t{t}") for t in range(390)]
    rows += [(c, t, "u", f"t{t}") for c in range(20, 60) for t in range(int(rng.integers(1, 12)))]
    rows += [(c, t, "u", f"t{t}" if t < 6 else f"own {c} {t}") for c in range(60, 90) for t in range(9)]
    rows += [(c, t, "u", "same") for c in range(1000, 1200) for t in range(8)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        want = brute(rows)
        assert found(frame) == want
        assert found(frame, run_rows=5) == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_empty_table(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ends_are_hashed_piece_by_piece(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "CHUNK_IDS", 3)
    rows = [(c, t, "u", "same") for c in range(50) for t in range(7)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_node_table_is_minimal_perfect_and_knows_its_keys():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 62, (5000, 2)).astype(np.uint64), axis=0)
    keys[:3] = [[0, 0], [0, 1], [1, 0]]
    table = NodeTable(keys[:, 0], keys[:, 1])
    slots = table.slots(keys[:, 0], keys[:, 1])
    assert sorted(slots) == list(range(len(keys)))
    assert (table.slots(keys[:, 0], keys[:, 1] + np.uint64(7)) == -1).all()


def test_sums_run_up_the_parents():
    parent, depth = np.array([-1, 0, 0, 1, 3]), np.array([0, 1, 1, 2, 3])
    values = np.array([1, 10, 100, 1000, 10000])
    subtree_sums(parent, depth, values)
    assert values.tolist() == [11111, 11010, 100, 11000, 10000]
