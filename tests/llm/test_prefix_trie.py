import hashlib
import random
import zlib

import numpy as np
import pytest

from stockweave.llm import prefix_trie
from stockweave.llm.prefix_trie import NodeTable, PerfectHash

SCHEMA = "conv_id long, turn long, role string, text string, a string, depth string, n_turns string"


def make(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def plain(rows):
    def digest(r):
        role, text = r[2] or "", r[3] or ""
        return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()

    own = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", digest(r))):
        own.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = own.get(c - int(np.fmod(c, 100)), [])[:h] + own[c][h:]
    members = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    below = {}
    for node in members:
        if node:
            below.setdefault(node[:-1], []).append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        inner = below.get(node, [])
        leaves[node] = sum(leaves[x] for x in inner) if inner else 1
        saved[node] = sum(saved[x] for x in inner) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        ends = sorted(c for c in members[node] if len(made[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(members[node]), len(node), parent, len(members[node]), len(inner), leaves[node], saved[node], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, n, long=0):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * n), n) + [-7, -205]:
        turns = rng.randint(1, 8)
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "", None, "cé" * 40])) for t in range(turns)]
    return rows + [(5 * n, t, "user", f"t{t % 3}") for t in range(long)]


def odd():
    rows = [(None, 1, "user", "lost"), (1, None, "user", "first"), (1, 2, None, None), (1, 2, None, None), (1, 2, "user", "tie"), (1, 2, "user", "tied"), (200, 1, "user", "x" * 300_000), (201, 1, "user", "x" * 300_000)]
    return rows + [(c, 1, "user", "alone") for c in range(301, 320)]  # no base: all with h > 0 end without turns


@pytest.mark.parametrize("shard", [None, 3, 40])
def test_against_brute_force(spark, shard):
    for rows in (conversations(1, 300, 60), odd()):
        got = prefix_trie.prefix_trie(make(spark, rows), shard)
        assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_a_shared_first_turn_is_split_over_shards(spark):
    rows = [(c, t, "user", "hello" if t < 6 else f"{c}.{t}") for c in range(400) for t in range(9)]
    got = prefix_trie.prefix_trie(make(spark, rows), 30)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_members_of_many_chunks(spark, monkeypatch):
    rows = [(c, t, "user", "same") for c in range(700) for t in range(2)]
    want = plain(rows)
    assert sorted(map(tuple, prefix_trie.prefix_trie(make(spark, rows)).collect()), key=str) == want


def test_no_conversations(spark):
    assert prefix_trie.prefix_trie(make(spark, [(None, 1, "user", "x")])).count() == 0


def test_hash_is_minimal_and_perfect_and_tells_foreign_keys():
    rng = np.random.default_rng(2)
    a, b = rng.integers(-(2**63), 2**63 - 1, (2, 5000))
    a[1:50] = a[0]  # halves may agree
    at = PerfectHash(a, b).slots(a, b)
    assert sorted(at) == list(range(5000))
    t = NodeTable(a, b, np.r_[0, a[:-1]], np.r_[0, b[:-1]], np.arange(5000))
    assert (t.a[t.at] == a).all() and (t.parent[t.at[1:]] == t.at[:-1]).all() and t.parent[t.at[0]] == -1
    assert (t.find(b, a) == -1).all()
    ones = np.ones(5000, np.int64)
    t.add_up(ones)
    assert ones[t.at[0]] == 5000 and ones[t.at[-1]] == 1


def test_a_digest_given_twice_is_an_error():
    z = np.array([3, 3])
    with pytest.raises(ValueError):
        NodeTable(z, np.array([1, 1]), z, z, z)
