"""Conversation trie against a plain one, its rollup at every component size, awkward rows."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from quiver.llm import prefix_trie as P
from tests.conftest import SF_SMALL

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Nodes as tuples, from rows without two turns of one number in a conversation."""
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:])
    nodes = {}
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            nodes.setdefault(whole[c][:d], []).append(c)
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    sums = {}
    for p in sorted(nodes, key=len, reverse=True):
        below = [sums[k] for k in children.get(p, [])]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        sums[p] = (sum(b[0] for b in below) or 1, (len(nodes[p]) - 1) * words + sum(b[1] for b in below))
    return sorted((m[0], len(p), nodes[p[:-1]][0] if p else None, len(m), len(children.get(p, [])), *sums[p],
                   hashlib.sha256(",".join(str(c) for c in m if len(whole[c]) == len(p)).encode()).hexdigest()) for p, m in nodes.items())


def found(spark, rows, local_nodes=P.LOCAL_NODES):
    got = P.trie(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS rep", "2 AS depth", "3 AS pos", "'x' AS key"), local_nodes).collect()
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[n] for n in names) for r in got), key=lambda t: (t[0], t[1]))


def drawn(seed, convs, alphabet, longest):
    """Conversations over few different turns, so that they share prefixes; ids with gaps, some bases absent."""
    draw = np.random.default_rng(seed)
    rows = []
    for c in draw.choice(convs * 3, convs, replace=False).tolist():
        for turn in range(int(draw.integers(1, longest))):
            k = int(draw.integers(0, alphabet))
            rows.append((c, turn if turn else None, "user" if k % 2 else None, " ".join("w" * k) if k else None))
    return rows


@pytest.mark.parametrize("local_nodes", [1, 5, P.LOCAL_NODES])
def test_trie_against_brute_force(spark, local_nodes):
    rows = drawn(1, 60, 2, 7)
    assert found(spark, rows, local_nodes) == brute(rows)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(spark, rows, 16) == brute(rows)


def test_long_conversation_and_one_common_text(spark, monkeypatch):
    """A path longer than a running sum's chunk, and two thirds of the conversations alike."""
    monkeypatch.setattr(P, "CHUNK_TURNS", 8)
    monkeypatch.setattr(P, "ENDS_TOGETHER", 3)
    rows = [(0, t, "u", f"turn {t % 3}") for t in range(60)] + [(1000, t, "u", f"turn {t % 3}") for t in range(50)]
    rows += [(c, t, "u", "the same words") for c in range(2000, 2080) for t in range(3)]
    assert found(spark, rows, 4) == brute(rows)


def test_awkward_rows(spark):
    rows = [(None, 0, "u", "no conversation"), (20, None, None, None), (20, 1, "", ""), (21, 5, "u", "x " * 50_000), (22, -3, "a:", "b"), (23, 0, "a", ":b"),
            (-5, 0, "u", "negative"), (-40, 0, "u", "negative base")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    twice = [(40, 0, "u", "a"), (40, 0, "u", "a"), (40, 0, "u", "b")]                 # one place three times
    got = found(spark, twice)
    assert [t[1] for t in got] == list(range(len(got))) and all(t[3] == 1 for t in got)


def test_rolled_up_on_drawn_trees():
    draw = np.random.default_rng(7)
    for shape in ("path", "star", "random", "deep"):
        n = 200
        parent = [-1] + [{"path": i - 1, "star": 0, "random": int(draw.integers(0, i)), "deep": int(draw.integers(max(0, i - 3), i))}[shape] for i in range(1, n)]
        values = [(int(draw.integers(0, 9)), 1) for _ in range(n)]
        want = [list(v) for v in values]
        for v in range(n - 1, 0, -1):
            want[parent[v]] = [a + b for a, b in zip(want[parent[v]], want[v])]
        assert P.rolled_up(parent, values) == want


def test_a_path_takes_as_many_rounds_as_halvings(spark, monkeypatch):
    rounds, kept = [], P.store
    monkeypatch.setattr(P, "store", lambda df, name: (rounds.append(name), kept(df, name))[1])
    rows = [(0, t, "u", str(t)) for t in range(40)]
    assert found(spark, rows, 2) == brute(rows)
    assert rounds.count("trie-sides") <= 5                                            # 41 nodes halved down to 2
