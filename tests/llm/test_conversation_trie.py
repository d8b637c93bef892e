import hashlib
import random
import re
import zlib

import pytest

from tickwright.llm import conversation_trie as m

SCHEMA = "conv_id bigint, turn bigint, role string, text string, n_convs string"


def brute(rows):
    """All nodes from rows (conv_id, turn, role, text), one conversation and prefix at a time."""
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            key = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()[:32]
            own.setdefault(c, []).append((turn is not None, turn or 0, key, len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))))
    paths = {}
    for c, turns in own.items():
        turns.sort()
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        paths[c] = [t[2:] for t in own.get(first, [])[:h] + turns[h:]]
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(k for k, _ in path[:d]), []).append(c)
    words = {tuple(k for k, _ in path[:d]): path[d - 1][1] for path in paths.values() for d in range(1, len(path) + 1)}
    out = set()
    for node, ids in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below)]
        saved = sum((len(members[x]) - 1) * words.get(x, 0) for x in below)
        ends = ",".join(str(c) for c in sorted(ids) if len(paths[c]) == len(node))
        up = min(members[node[:-1]]) if node else None
        out.add((min(ids), len(node), up, len(ids), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def random_rows(seed, n=120):
    rng = random.Random(seed)
    said = ["", "a", "a b", "long\ttext here", None, "ß é\x0b漢"]
    rows = []
    for c in rng.sample(range(-60, 400), n):
        like = rng.random()
        if like < 0.35:  # a large group of copies, and one of copies that go on
            texts = ["same", "words", "in", "all", "of", "them"][: 6 if like < 0.25 else 5]
        else:
            texts = [rng.choice(said) for _ in range(rng.randint(1, 6))]
        for i, text in enumerate(texts):
            rows.append((c, rng.choice([i, i, i, None]) if like > 0.9 else i, rng.choice(["user", "bot", None]) if like > 0.8 else "user", text, "x"))
    rows += rows[:3] + [(None, 1, "user", "left out", None)]
    rng.shuffle(rows)
    return rows


def result(spark, rows, shards):
    return [tuple(r) for r in m.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3), shards).collect()]


@pytest.mark.parametrize("seed, shards, turns", [(1, 1, 1024), (2, 4, 1024), (3, 25, 1024), (4, 25, 2), (5, 60, 1024)])
def test_equals_brute_force(spark, monkeypatch, seed, shards, turns):
    monkeypatch.setattr(m, "SPLITTER_TURNS", turns)
    rows = random_rows(seed)
    got = result(spark, rows, shards)
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_pieces_of_one_list_of_ids(spark):
    walk = m.Walk(0, [(b"k" * 16, 99)])
    walk.add(1, b"k" * 16, [2])
    walk.send_ends(walk.stack[-1])
    walk.add(5, b"k" * 16, [2])
    walk.add(11, b"k" * 16, [2])
    walk.finish()
    names = [x.split()[0] for x in m.PARTS.split(", ")]
    rows = [dict(zip(names, r)) for r in walk.rows]
    pieces = [r["chunk"] for r in rows if r["kind"] == m.ENDS]
    assert pieces == [b"1", b"5,11"] and [r["n_convs"] for r in rows if r["kind"] == m.PARTIAL] == [3, 3]
    chunks = spark.createDataFrame([{k: r[k] for k in ("node", "shard", "seq", "chunk")} for r in rows if r["kind"] == m.ENDS], "node binary, shard int, seq bigint, chunk binary")
    assert [r["ends_sha256"] for r in m.hash_streams(chunks.repartition(2)).collect()] == [hashlib.sha256(b"1,5,11").hexdigest()]


def test_skeleton_has_a_bound(spark, monkeypatch):
    paths = spark.createDataFrame([(i, bytes([i % 7]) * 16 * 30, [1] * 30) for i in range(500)], "id bigint, path binary, words array<int>")
    cuts = m.choose_splitters(paths, 40)
    assert 30 <= len(cuts) <= 60 and cuts == sorted(cuts) and m.skeleton_size([p for p, _ in cuts]) <= 1 + 7 * 30
    monkeypatch.setattr(m, "SKELETON_NODES", 40)
    cut = m.choose_splitters(paths, 40)
    assert m.skeleton_size([p for p, _ in cut]) <= 40


def test_common_turns():
    a, b = b"a" * 16, b"b" * 16
    assert m.common(a * 9, a * 5 + b * 3) == 5 and m.common(b"", a) == 0 and m.common(a, a) == 1 and m.common(a * 3, a * 7) == 3


def test_long_and_empty(spark):
    rows = [(7, i, "user", f"turn {i % 50}", None) for i in range(3000)] + [(8, 0, None, None, None)]
    assert len(result(spark, rows, 4)) == len({(c, d) for c, d, *_ in result(spark, rows, 2)})
    got = result(spark, rows, 4)
    assert max(r[1] for r in got) >= 2990 and sum(r[1] == 0 for r in got) == 1
    assert result(spark, [], 3) == [] and result(spark, [(None, 1, "a", "b", "c")], 3) == []
