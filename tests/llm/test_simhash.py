from itertools import combinations

import numpy as np
import pytest
import xxhash

from tickwright.llm import simhash as m


def brute_print(text, width=4):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[k : k + width]) for k in range(max(1, len(w) - width + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = [p for _, p in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            parent[find(a)] = find(b)
    out = []
    for k, (i, p) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        out.append((i, f"{p:016x}", min(ids, default=None)))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["id"], r["fingerprint"], r["component_id"]) for r in df.collect()), key=repr)


def test_triples_cover_all_fours():
    assert len(m.TRIPLES) == 20
    assert all(any(set(t) <= set(q) for t in m.TRIPLES) for q in combinations(range(8), 4))


def test_odd_rows_match_brute_force(odd_docs, no_docs):
    want = brute_components([(r["doc_id"], brute_print(r["text"])) for r in odd_docs.collect()])
    assert got(m.near_duplicates(odd_docs)) == want
    assert m.near_duplicates(no_docs).count() == 0 and m.first_of_each_group(no_docs).count() == 0


def test_first_of_each_group(odd_docs):
    kept = m.first_of_each_group(odd_docs)
    groups = {c for _, _, c in got(m.near_duplicates(odd_docs))}
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(g for g in groups if g is not None)


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert got(m.near_duplicates(docs)) == brute_components([(r["doc_id"], brute_print(r["text"])) for r in docs.collect()])


@pytest.mark.parametrize("block", [8, 2048])
def test_chains_and_crowds(spark, monkeypatch, block):
    """A crowd of near fingerprints in blocks, a chain of four-bit steps, and far ones."""
    monkeypatch.setattr(m, "BLOCK", block)
    rng = np.random.default_rng(1)
    start = int(rng.integers(1 << 62))
    rows = [(100 + k, start ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64)))) for k in range(120)]
    chain = int(rng.integers(1 << 62))
    for k in range(12):
        chain ^= sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        rows.append((1000 + k, chain))
    rows += [(2000 + k, int(rng.integers(1 << 62))) for k in range(200)]
    want = brute_components(rows)
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in rows]
    table = spark.createDataFrame(signed, "id bigint, fp bigint")
    found = {r["fp"]: r["component_id"] for r in m.fingerprint_components(table).collect()}
    assert sorted([(i, f"{p:016x}", found[s]) for (i, p), (_, s) in zip(rows, signed)], key=repr) == want
