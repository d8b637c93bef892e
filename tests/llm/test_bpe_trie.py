import hashlib
import random

import pytest

from tickwright.llm import bpe_trie as m


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(m.default_tokenizer())


def random_texts(n, seed=3):
    rng = random.Random(seed)
    bits = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", " ", "a", "Be", "'s", "'", "'LL", ".", "ß", "é", "é", "̈", "̣", "12", "<|endoftext|>", "<|startoftext|>", "<|", "漢字", "🙂", "\r\n", "don't", "ing", "th", "Σ", "İ", "ⅷ", "٣", "_", "​", "\x00", "\x7f", "aaa", "!!!!", "한글", "각", "ǅ", "Å"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def want(plain, text):
    ids = plain.encode(text or "", add_special_tokens=False).ids
    decoded = plain.decode(ids, skip_special_tokens=False)
    return ids, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), decoded, hashlib.sha256(decoded.encode()).hexdigest()


def greedy(word, merges):
    """Merges one pair at a time, always the one of least rank, of equal ones the leftmost."""
    ids = [merges.vocabulary[x] for x in word[:-1]] + [merges.vocabulary[word[-1] + merges.end]]
    made = {pair: token for token, pair in merges.parts.items()}
    while True:
        found = min(((merges.rank[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in merges.rank), default=None)
        if found is None:
            return ids
        ids[found[1] : found[1] + 2] = [made[ids[found[1]], ids[found[1] + 1]]]


def test_ids_are_those_of_the_library(plain):
    own = m.WordCoder(m.default_tokenizer())
    texts = random_texts(5000) + ["a" * 5000, "x " * 5000, "漢" * 3000, "ab" * 999, None, "", " "]
    for text, ids, digests in zip(texts, own.ids(texts), own.digests(texts)):
        expected = want(plain, text)
        assert ids == expected[0] and digests == (expected[1], expected[2], expected[4])
        assert own.decode(ids) == expected[3]


def test_little_is_kept(plain, monkeypatch):
    for name, value in (("KEPT_RUNS", 3), ("KEPT_NODES", 4), ("KEPT_PAIRS", 2), ("TRIE_DEPTH", 3), ("SLICE", 7)):
        monkeypatch.setattr(m, name, value)
    own = m.WordCoder(m.default_tokenizer())
    texts = random_texts(300, 5) + ["one two three four five six", "Lengthy words everywhere"]
    assert [x for x in own.ids(texts)] == [want(plain, t)[0] for t in texts]


@pytest.mark.parametrize("seed", range(20))
def test_trie_equals_greedy_merges_of_a_small_vocabulary(seed):
    rng = random.Random(seed)
    letters = "abc"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    vocabulary = {x: i for i, x in enumerate([*letters, *[x + "#" for x in letters]])}
    split = [[*w[:-1], w[-1] + "#"] for w in words]
    merges = []
    for _ in range(25):  # the order in which a trainer would merge
        count = {}
        for s in split:
            for p in zip(s, s[1:]):
                count[p] = count.get(p, 0) + 1
        pair = max(count, key=lambda p: (count[p], p), default=None)
        if pair is None or "".join(pair) in vocabulary:
            break
        merges.append(list(pair))
        vocabulary["".join(pair)] = len(vocabulary)
        for s in split:
            i = 0
            while i + 1 < len(s):
                if (s[i], s[i + 1]) == pair:
                    s[i : i + 2] = ["".join(pair)]
                i += 1
    table = m.Merges(vocabulary, merges, "#")
    asked = sorted(set(words) | {"".join(rng.choice(letters) for _ in range(rng.randint(1, 15))) for _ in range(300)})
    trie = m.PrefixTrie(table)
    assert dict(trie.encode_sorted(asked)) == {w: greedy(w, table) for w in asked}
    prefixes = {w[:i] for w in asked for i in range(1, len(w))}
    assert len(trie.state) == len(prefixes) + 1  # each shared prefix once


def test_merges_out_of_order_are_refused():
    vocabulary = {"a": 0, "b": 1, "aba": 2, "ab": 3}
    with pytest.raises(ValueError):
        m.Merges(vocabulary, [["ab", "a"], ["a", "b"]], "#")


def test_tables(spark, small, odd_docs, no_docs, plain):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for table, odd in ((docs, False), (odd_docs.withColumnRenamed("score", "n_tokens").withColumnRenamed("source", "_coded"), True)):
        out = m.round_trip(table)
        assert out.columns == [*[c for c in table.columns if c != "n_tokens"], "n_tokens", "ids_sha256", "decoded_sha256"]
        rows = sorted((r["text"] or "", r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out.collect())
        texts = sorted((r["text"] or "" for r in table.collect()))
        assert rows == [(t, *want(plain, t)[1:3], want(plain, t)[4]) for t in texts]
        if odd:
            both = m.decode(m.encode(table)).collect()
            assert all(list(r["ids"]) == want(plain, r["text"])[0] and r["decoded"] == want(plain, r["text"])[3] for r in both)
    assert m.round_trip(no_docs).count() == 0 and m.decode(m.encode(no_docs)).count() == 0
    lists = spark.createDataFrame([(1, None), (2, []), (3, [320, 99999999])], "k int, ids array<int>")
    assert [r["decoded"] for r in m.decode(lists).orderBy("k").collect()] == ["", "", "a</w>"]


def test_query_equals_the_library(spark, small, plain):
    from tickwright.llm.queries import QUERIES

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    out = QUERIES["op13_bpe"](spark, small)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    rows = out.collect()
    assert len(rows) == len(docs)
    for r in rows:
        expected = want(plain, docs[r["doc_id"]])
        assert tuple(r)[1:] == (expected[1], expected[2], expected[4])
