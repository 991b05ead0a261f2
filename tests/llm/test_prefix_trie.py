"""The conversation tree against a plain tree of tuples, and the double array by itself."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tandem.llm import prefix_trie
from tests.llm.conftest import SF
from tests.test_oracles import compare, connect

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plain_nodes(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])
        built[c] = tuple(base[:h] + turns[h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    kids = {p: 0 for p in members}
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(cs) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if built[c] == p))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows, extra=""):
    df = spark.createDataFrame(rows, SCHEMA)
    found = prefix_trie.nodes(df.selectExpr("*", *extra) if extra else df)
    return sorted((tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in found.collect()), key=repr)


AWKWARD = [
    (0, 1, "user", "a"), (0, None, "user", "first"), (0, 2, None, None), (0, 2, "user", "tie"), (0, 2, "user", "tie"), (0, 3, "", "é" * 50), (0, 9, "bot", "x" * 100_000),
    (1, 0, "user", "own"), (2, 0, "user", "own"), (2, 1, "bot", "b"), (3, 5, "user", "q"), (7, None, None, None), (7, None, "user", "z"), (99, 0, "u", "n"), (150, 0, "user", "no base"), (151, 0, "user", "no base"),
    (-5, 0, "user", "below"), (-5, 1, "user", "zero"), (-105, 0, "user", "below"), (None, 0, "user", "nobody"), (100, 0, "user", "first"), (100, 1, "user", "a"), (4, 0, "a", ""), (4, 1, "", "a"),
] + [(8, i, "user", f"t{i}") for i in range(40)] + [(9, i, "user", f"t{i}") for i in range(39)]


def many(count, seed):
    """Conversations over few different turns, so that prefixes are shared deep down."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-300, 1500), count):
        start = [("user", "hello"), ("bot", "hi")] if rng.random() < 0.5 else []
        turns = start + [(rng.choice(["user", "bot"]), rng.choice(["ok", "thanks", "go on", f"w{rng.randrange(30)}"])) for _ in range(rng.randrange(9))]
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    return rows


def test_awkward_rows(spark):
    assert got(spark, AWKWARD) == plain_nodes(AWKWARD)
    assert got(spark, AWKWARD, ["1 as block", "2 as conv", "3 as key", "4 as chars", "'e' as end", "true as shared"]) == plain_nodes(AWKWARD)
    assert got(spark, []) == []
    assert got(spark, [(None, 1, "user", "x")]) == []


@pytest.mark.parametrize("turns", [3, 40, 250_000])
def test_shards_share_nodes(spark, monkeypatch, turns):
    """With small shards prefixes are cut further down, and nodes above the cuts are merged."""
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", turns)
    rows = many(400, 7)
    assert got(spark, rows) == plain_nodes(rows)


def test_double_array():
    rng = np.random.Generator(np.random.PCG64(2))
    trie, level, held = prefix_trie.DoubleArray(), np.zeros(1, np.int64), {}
    for _ in range(6):
        pairs = np.unique(np.stack([rng.choice(level, 3000), rng.integers(0, 5000, 3000)], axis=1), axis=0)
        trie.add(pairs[:, 0], pairs[:, 1])
        level = trie.child(pairs[:, 0], pairs[:, 1])
        assert (level > 0).all() and len(np.unique(level)) == len(level)
        held |= {tuple(p): s for p, s in zip(pairs.tolist(), level.tolist(), strict=True)}
    for (node, code), slot in held.items():
        assert trie.child(np.array([node]), np.array([code]))[0] == slot
    nodes, codes = np.array([n for n, _ in held]), rng.integers(0, 5000, len(held))
    expected = [held.get(p, -1) for p in zip(nodes.tolist(), codes.tolist(), strict=True)]
    assert trie.child(nodes, codes).tolist() == expected
    assert trie.top < 20 * len(held)


def test_given_tables_against_sql(spark):
    assert compare(connect(SF), spark, "op12_prefix_trie") > 100
