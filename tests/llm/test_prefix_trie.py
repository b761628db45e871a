import hashlib
import zlib

import numpy as np
import pytest

from specframe.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, left string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            r, t = role or "", text or ""
            fp = hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest()[:32]
            own.setdefault(c, []).append((turn is not None, turn or 0, fp, (r, t)))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - int(np.fmod(c, 5)), [])[:h] + turns[h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[x] for x in below) if below else 1
        saved[p] = sum(saved[x] for x in below) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows):
    got = prefix_trie.prefix_trie(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted([tuple(r) for r in got.collect()], key=repr)


def talks(seed, n, longest, words):
    """Conversations over few different turns, so that prefixes of every length are shared."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        fixed = rng.random() < 0.4
        for t in range(int(rng.integers(1, longest))):
            rows.append((c, t, "user" if t % 2 else "bot", "é" * (t % 3) + ("same" if fixed else f"w{rng.integers(0, words)}")))
    return rows


@pytest.mark.parametrize("segment, rows_a_block", [(32, 50_000), (3, 7)])
def test_equals_brute_force(spark, monkeypatch, segment, rows_a_block):
    monkeypatch.setattr(prefix_trie, "SEGMENT", segment)
    monkeypatch.setattr(prefix_trie, "BLOCK_ROWS", rows_a_block)
    rows = talks(3, 120, 14, 2) + [(500 + c, t, "u", "all alike") for c in range(60) for t in range(9)] + [(900, t, "u", f"long {t}") for t in range(70)]
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SEGMENT", 2)
    rows = [(None, 1, "u", "lost"), (0, None, None, None), (0, None, "", ""), (0, 3, "u", "ß"), (1, 1, "u", "a"), (1, 1, "u", "a"), (1, 1, "u", "b"), (-3, 2, "u", "x"), (-3, 1, "u", "y"), (-7, 1, "u", "x" * 100_000), (7, 1, "a", "bc"), (8, 1, "ab", "c")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == [] and found(spark, [(None, 1, "u", "t")]) == []
    turnless = [c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2][:3]
    rows = [(c, 1, "u", "own") for c in turnless]
    assert found(spark, rows) == brute(rows) and found(spark, rows)[0][3:6] == (3, 0, 1)


def test_searches_against_scans():
    rng = np.random.default_rng(0)
    values = rng.integers(-1, 6, 300)
    levels, at, depth = prefix_trie.sparse_table(values), rng.integers(0, 300, 200), rng.integers(0, 7, 200)
    right, left = prefix_trie.first_below(levels, at + 1, depth), prefix_trie.last_below(levels, at + 1, depth)
    for i, d, r, l in zip(at, depth, right, left):
        assert r == next((j for j in range(i + 1, 300) if values[j] < d), 300) and l == next((j for j in range(i, -1, -1) if values[j] < d), -1)
