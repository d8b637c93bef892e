import random
import zlib

import numpy as np
import pytest

from tickwright.llm import packing
from tickwright.llm import tokens as m
from tickwright.llm.token_count import count_tokens


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(m.default_tokenizer())


def random_texts(n):
    rng = random.Random(3)
    bits = [" ", " ", "  ", "\n", "\t", " ", " ", "\x1c", "\x85", "a", "Be", "'s", "'", ".", "ß", "é", "12", "<|endoftext|>", "漢字", "🙂", "\r\n", "don't"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_pieces_give_the_ids_of_the_whole(plain):
    texts = random_texts(3000) + ["", " ", "   ", "a" * 5000, "x " * 5000]
    own = m.PieceEncoder(m.default_tokenizer())
    numbers, counts = own.batch(texts)
    ends = np.cumsum(counts)
    got = [own.ids_of(numbers[a:b]).tolist() for a, b in zip(ends - counts, ends)]
    assert own.counts_of(texts).tolist() == [len(x) for x in got]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_small_store_of_pieces(plain, monkeypatch):
    monkeypatch.setattr(m, "KEPT_PIECES", 5)
    monkeypatch.setattr(m, "CALL_PIECES", 2)
    own = m.PieceEncoder(m.default_tokenizer())
    for part in (["one two three", "four five six seven"], ["one nine", "eight"]):
        assert own.counts_of(part).tolist() == [len(plain.encode(t).ids) for t in part]


def test_slices_by_bytes():
    texts = ["a" * 10, None, "b" * 3, "", "c" * 100, "d"]
    parts = list(m.by_bytes(texts, 12))
    assert [t for p in parts for t in texts[p]] == texts and len(parts) == 3
    assert list(m.by_bytes([])) == []


def test_counts_of_tables(spark, small, odd_docs, no_docs, plain):
    for docs in (spark.read.parquet(f"{small}/documents.parquet"), odd_docs.withColumnRenamed("score", "n_tokens")):
        out = count_tokens(docs)
        want = sorted((len((r["text"] or "").encode()), len(plain.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect())
        assert sorted((r["n_bytes"], r["n_tokens"]) for r in out.collect()) == want
        assert out.where("over_limit <> (n_tokens > 512)").count() == 0
    assert count_tokens(no_docs).count() == 0


# ---- packing -----------------------------------------------------------------------------


def cost(cuts, fee):
    return sum(packing.padding(b - a) + packing.SEQUENCE_COST + fee[b] for a, b in zip(cuts, cuts[1:]))


@pytest.mark.parametrize("seed", range(25))
def test_cuts_are_the_cheapest(seed):
    rng = np.random.default_rng(seed)
    ends = np.cumsum(rng.integers(1, 900, rng.integers(1, 9)))
    sentences = np.unique(rng.integers(1, ends[-1] + 1, 12))
    positions, penalty = packing.cut_positions(ends, sentences, 1024)
    fee = dict(zip(positions.tolist(), penalty.tolist()))
    at = positions.tolist()
    best = {0: 0}
    for j in at[1:]:
        best[j] = min(best[i] + packing.padding(j - i) for i in at if 0 < j - i <= 1024) + fee[j] + packing.SEQUENCE_COST
    cuts = packing.best_cuts(positions, penalty)
    assert cuts[0] == 0 and cuts[-1] == ends[-1] and cost(cuts, fee) == best[at[-1]]


def check_pack(docs, out, plain):
    """Every id in one piece, sequences gapless and short, little padding."""
    ids = {}
    for r in docs.collect():
        raw = np.array(plain.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4").tobytes()
        ids.setdefault(r["doc_id"], []).append(raw)
    rows = out.collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for key, own in ids.items():
        assert sum(p[1] for p in pieces[key]) == sum(len(x) // 4 for x in own)
        for start, length, crc, total in pieces[key]:
            assert any(len(x) == 4 * total and zlib.crc32(x[4 * start : 4 * (start + length)]) == crc for x in own)
    padded = total = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
        padded += packing.padding(at)
        total += at
    return padded, total


def test_pack_tables(spark, small, odd_docs, no_docs, plain):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    padded, total = check_pack(docs, packing.pack(docs), plain)
    assert padded < 0.002 * total
    check_pack(odd_docs, packing.pack(odd_docs), plain)
    assert packing.pack(no_docs).count() == 0


def test_streams_end_inside_a_partition(spark, small, plain, monkeypatch):
    monkeypatch.setattr(packing, "STREAM_TOKENS", 3000)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    check_pack(docs, packing.pack(docs), plain)
