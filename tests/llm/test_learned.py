import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickwright.llm import context_tree as ct
from tickwright.llm import language_id as li
from tickwright.llm import toxicity as tx


def fold(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


# ---- language ----------------------------------------------------------------------------


def test_grams_bind_letters_by_place():
    text = "Ab  c9-d"
    codes = li.grams(text)
    assert len(codes) == len(" ab c d ") - 2
    assert li.grams("123 ... ").size == 0 and li.grams(None).size == 0 and li.grams("").size == 0
    first = li.gram_vectors(codes[:1], 256)[0]
    space, a, b = (li.letter(ord(c), 256) for c in " ab")
    assert (first == np.roll(space, 2) * np.roll(a, 1) * b).all()


def test_profiles_against_plain_sums():
    rng = np.random.default_rng(0)
    prototypes = rng.normal(size=(3, 256))
    prototypes /= np.linalg.norm(prototypes, axis=1, keepdims=True)
    texts = ["hello world hello", None, "x", "ñandú über", "55"]
    best, score = li.predict(texts, prototypes)
    for t, b, s in zip(texts, best, score):
        profile = sum((li.gram_vectors(np.array([g]), 256)[0].astype(float) for g in li.grams(t)), np.zeros(256))
        if not profile.any():
            assert b == -1 and s == 0
            continue
        cosine = prototypes @ profile / np.linalg.norm(profile)
        assert b == cosine.argmax() and s == pytest.approx(max(0, cosine.max()), abs=1e-5)


def test_many_distinct_letters_take_slices(monkeypatch):
    rng = np.random.default_rng(1)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9000, n))) for n in (4000, 30)] + ["plain words", ""]
    prototypes = rng.normal(size=(3, 256))
    prototypes /= np.linalg.norm(prototypes, axis=1, keepdims=True)
    whole = li.predict(texts, prototypes)
    monkeypatch.setattr(li, "SLICE_GRAMS", 100)
    monkeypatch.setattr(li, "KEPT_LETTERS", 50)
    li._letters.clear()
    sliced = li.predict(texts, prototypes)
    assert (whole[0] == sliced[0]).all() and np.allclose(whole[1], sliced[1], atol=1e-5)


def test_memory_of_a_long_diverse_text():
    """400 000 mixed letters, measured in a process of its own."""
    import subprocess
    import sys

    code = """
import resource, numpy as np
from tickwright.llm import language_id as li
text = "".join(map(chr, np.random.default_rng(0).integers(0x4E00, 0x9FFF, 400_000)))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
li.predict([text], np.ones((4, li.DIM)))
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    import tickwright

    root = str(__import__("pathlib").Path(tickwright.__file__).parents[1])
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True, timeout=300)
    assert int(out.stdout) < 300_000  # KB; vectors of all grams at once would take 2 GB


def test_prototypes_are_the_sums_of_their_grams(spark):
    texts = [("de", "Straße und Weg"), ("de", "und so"), ("en", "the way and the road"), ("en", None)]
    langs, got = li.learn_prototypes(spark.createDataFrame(texts, "lang string, text string"), 128)
    assert langs == ["de", "en"]
    for lang, row in zip(langs, got):
        want = sum(li.gram_vectors(np.array([g]), 128)[0].astype(float) for own, t in texts if own == lang for g in li.grams(t))
        assert row == pytest.approx(want / np.linalg.norm(want))


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = li.identify(docs, li.learn(docs)).where(li.held_out(F.col("doc_id")))
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 150 and right > 0.98


def test_language_odd_rows(odd_docs, no_docs):
    out = li.identify(odd_docs, li.learn(odd_docs))
    assert out.count() == odd_docs.count() and [c for c in out.columns if c != "score"] == [c for c in odd_docs.columns if c != "score"] + ["lang_pred"]
    for r in out.collect():
        assert 0 <= r["score"] <= 1
        if not any(c.isalpha() for c in r["text"] or ""):
            assert r["lang_pred"] == "und" and r["score"] == 0
    assert {r["lang_pred"] for r in li.identify(odd_docs, li.learn(no_docs)).collect()} == {"und"}
    assert li.identify(no_docs, li.learn(odd_docs)).count() == 0


# ---- context tree ------------------------------------------------------------------------


def plain_tree(train, texts, depth):
    """Scores by recursion over explicit contexts, straight from the definition."""
    nodes: dict = {}
    longer: dict = {}
    end = bytes([255])

    def walk(body):
        data = end * depth + body + end
        for at in range(depth, len(data)):
            byte = data[at]
            for i in range(8):
                node, bit = (1 << i) | (byte >> (8 - i)), byte >> (7 - i) & 1
                yield [(data[at - d : at], node) for d in range(depth + 1)], bit

    for body in train:
        for path, bit in walk(body):
            for d, key in enumerate(path):
                nodes.setdefault(key, [0, 0])[bit] += 1
                if d:
                    longer.setdefault(path[d - 1], set()).add(key)
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    known: dict = {}

    def weighted(key):
        if key not in known:
            own = kt(*nodes[key])
            if len(key[0]) < depth:
                below = sum(weighted(k) for k in longer[key])
                known[key] = (own, below, max(own, below) + math.log1p(math.exp(-abs(own - below))) - math.log(2))
            else:
                known[key] = (own, None, own)
        return known[key][2]

    out = []
    for body in texts:
        total = 0.0
        for path, bit in walk(body):
            p, rest = 0.0, 1.0
            for key in path:
                if key not in nodes:
                    p += rest * 0.5
                    rest = 0
                    break
                weighted(key)
                own, below, _ = known[key]
                share = 1.0 if below is None else 1 / (1 + math.exp(min(700, below - own)))
                a, b = nodes[key]
                p += rest * share * (b + 0.5) / (a + b + 1)
                rest *= 1 - share
            total += math.log10(p if bit else 1 - p)
        out.append(total)
    return out


@pytest.mark.parametrize("limits", [(1 << 23, 1 << 18), (0, 0), (0, 3), (400, 8)])
def test_context_tree_against_recursion(odd_docs, spark, limits):
    extra = spark.createDataFrame([(20 + k, "to be or not to be " * (k % 4), "en", None, 0, "") for k in range(12)], odd_docs.schema)
    docs = odd_docs.where("doc_id <> 5 OR doc_id IS NULL").unionByName(extra)
    rows = [(r["doc_id"], (r["text"] or "").encode().lower().split()) for r in docs.collect()]
    train = [w for i, w in rows if fold(i, 5) != 1]
    counts = Counter(w for own in train for w in [*own, None])
    n, v = sum(counts.values()), len(counts)
    base = [sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*own, None]) for _, own in rows]
    known = [sum(counts[w] > 0 for w in [*own, None]) for _, own in rows]
    scores = plain_tree([b" ".join(w) for w in train], [b" ".join(w) for _, w in rows], ct.DEPTH)
    want = sorted(((i, fold(i, 5) == 1, len(w) + 1, k, n, b, s) for (i, w), k, b, s in zip(rows, known, base, scores)), key=repr)
    out = ct.score_documents(docs, local_grams=limits[0], local_words=limits[1])
    got = sorted(((r["id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in out.collect()), key=repr)
    for a, b in zip(sorted(got, key=lambda r: (repr(r[:5]), r[6])), sorted(want, key=lambda r: (repr(r[:5]), r[6]))):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-7) and a[6] == pytest.approx(b[6], abs=1e-6)
    assert len(got) == len(want)


def test_long_texts_are_counted_and_scored_by_pieces(monkeypatch):
    texts = ["Some  words and MORE words " * 9, None, "", "x", "one" * 40 + " two " * 30, "\tend here"]
    bodies = [ct.normal(t) for t in texts]

    def by_text():
        found, words = {}, {}
        for first, pieces in ct.slabs(texts):
            codes, sizes = ct.gram_codes(pieces)
            column, counts = ct.word_column(pieces)
            for k in range(len(pieces)):
                found.setdefault(first + k, []).extend(codes[sizes[:k].sum() :][: sizes[k]].tolist())
                words.setdefault(first + k, []).extend(column.to_pylist()[counts[:k].sum() :][: counts[k]])
        return found, words

    whole, words = by_text()
    assert {i: [w.decode()[:-1] for w in x] for i, x in words.items()} == {i: b.decode().split() for i, b in enumerate(bodies)}
    assert all(len(whole[i]) == len(b) + 1 for i, b in enumerate(bodies))
    assert [c >> 8 for c in whole[3]] == [0xFFFFFFFFFF, 0xFFFFFFFF00 + ord("x")]
    scores = {b"words ": -1.5, b"x ": -2.0}
    codes = np.unique(np.concatenate(list(whole.values())))
    table = ct.Lookup(codes[::2], -np.arange(len(codes[::2]), dtype=float))
    plain = [ct.score_slab([piece], 5, table, scores, {b"x "}) for _, pieces in ct.slabs(texts) for piece in pieces]
    monkeypatch.setattr(ct, "SLAB_BYTES", 20)
    assert by_text() == (whole, words)
    pieces = [ct.score_slab(own, 5, table, scores, {b"x "}) for first, own in ct.slabs(texts) if first == 0]
    assert len(pieces) > 3
    joined = ct.as_one(pieces)
    for k in ("score", "n_bytes", "words", "base", "known"):
        assert joined[k] == pytest.approx(plain[0][k])
    for k, key in (("rare", "word"), ("grams", "gram")):
        total = Counter()
        for x in joined[k].to_pylist()[0]:
            total[x[key]] += x["k"]
        assert total == {x[key]: x["k"] for x in plain[0][k].to_pylist()[0]}


def test_counts_add_up(monkeypatch):
    monkeypatch.setattr(ct, "FLUSH_GRAMS", 40)
    monkeypatch.setattr(ct, "FLUSH_WORDS", 8)
    rng = np.random.default_rng(1)
    grams, words = ct.GramCounts(), ct.WordCounts()
    want, want_words, got, got_words = Counter(), Counter(), Counter(), Counter()

    def take(total, rows):
        for key, n, m in rows:
            total[key, 1] += int(n)
            total[key, 0] += int(m) - int(n)

    for step in range(30):
        codes, train = rng.integers(0, 60, 30), rng.integers(0, 2, 30)
        want.update(zip(codes.tolist(), train.tolist()))
        grams.add(codes, train)
        own, flag = [f"w{rng.integers(0, 12)}" for _ in range(9)], int(rng.integers(0, 2))
        want_words.update((w.encode() + b" ", flag) for w in own)
        words.add([(b"", " ".join(own).encode() + b"\xff"), (b"", b"\xff")], bool(flag))
        if grams.full() or step == 29:
            take(got, zip(*grams.flush()))
        if words.full() or step == 29:
            take(got_words, [(r["word"], r["n"], r["m"]) for r in words.flush().to_pylist()])
    assert +got == want and +got_words == want_words


def test_context_tree_without_rows(no_docs):
    assert ct.score_documents(no_docs).count() == 0


def test_lookup():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 48, 5000))
    table = ct.Lookup(keys, keys * 0.5)
    asked = rng.choice(keys, 20_000)
    assert (table(asked) == asked * 0.5).all()
    mixed = np.concatenate([keys[:50], keys[:50] + 1, (np.array([-5]) & ((1 << 48) - 1))])
    there = np.isin(mixed, keys)
    assert (table(mixed)[there] == mixed[there] * 0.5).all() and np.isnan(table(mixed)[~there]).all()
    assert len(ct.Lookup(np.empty(0, np.int64), np.empty(0))(np.empty(0, np.int64))) == 0


def test_frequent_words_are_few(spark):
    words = spark.createDataFrame([(bytes([k]), k, k + 1) for k in range(100)], "word binary, n bigint, m bigint")
    for limit in (0, 1, 10, 1000):
        found = [r["n"] for r in ct.frequent(words, limit, "word", "n").collect()]
        assert len(found) <= limit and sorted(found) == list(range(100))[100 - len(found) :]


# ---- toxicity ----------------------------------------------------------------------------


def test_answers_equal_direct_convolution():
    rng = np.random.default_rng(0)
    texts = [tx.word_ids(t) for t in ("a b c d e", "", "one", "x y")]
    y = np.array([1, 0, 1, 0])
    model = tx.train_filters(texts, y)
    model.weight = rng.normal(size=len(model.weight))
    z, _ = model.logits(texts)
    for ids, got in zip(texts, z):
        x = model.vectors[ids]
        n = len(ids) - max(tx.WIDTHS) + 1
        pooled = np.concatenate([np.max([sum(x[t + j] @ f[j] for j in range(len(f))) for t in range(n)], axis=0) for f in model.filters])
        assert got == pytest.approx(np.maximum(pooled + model.shift, 0) @ model.weight + model.bias, abs=1e-4)


def test_toxicity_held_out_quality(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = tx.sample_and_fit(docs, labels)
    held = docs.where(li.held_out(F.col("doc_id"), 3, 1)).join(labels, "doc_id").where("toxic IS NOT NULL")
    rows = tx.score_texts(held, model).select("toxic", "score", "predicted").collect()
    y, s = np.array([r["toxic"] for r in rows]), np.array([r["score"] for r in rows])
    rank = np.argsort(np.argsort(s))
    auc = (rank[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum()
    p = np.array([r["predicted"] for r in rows])
    assert (p == (s >= 0.7)).all() and auc > 0.93 and p[y == 1].mean() > 0.7 and y[p == 1].mean() > 0.7


def test_threshold_becomes_the_cut():
    assert tx.calibrated(np.array([2.0]), np.array([2.0]), 3.0)[0] == pytest.approx(tx.CUT)
    assert tx.best_threshold(np.array([3.0, 2, 1, 0]), np.array([1, 1, 0, 0])) == 1.5
    assert tx.best_threshold(np.array([1.0, 2]), np.array([1, 1])) is None


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (None, 1), (4, 1), (5, 0), (7, 0), (8, 1)], "doc_id bigint, toxic int")
    for model in (tx.sample_and_fit(odd_docs, labels), tx.sample_and_fit(no_docs, labels), tx.sample_and_fit(odd_docs, labels.limit(0))):
        out = tx.score_texts(odd_docs, model).collect()
        assert len(out) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in out)
        assert len({r["score"] for r in out if r["doc_id"] == 2}) == 1
        assert tx.score_texts(no_docs, model).count() == 0


def test_thresholds_keep_the_class_share_beyond_the_limits(spark):
    """One row of 20 is toxic. Weak words stand in half of the toxic rows and a tenth of the clean
    ones, so flagging them costs F1 at that share, but not at the sample's one of three."""
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(6000):
        toxic = i % 20 == 0
        kind = "strong" if toxic and i % 40 == 0 else "weak" if toxic or rng.random() < 0.1 else "plain"
        words = [f"w{k}" for k in rng.integers(0, 50, 12)]
        rows.append((i, " ".join(words + [kind] * 3 * (kind != "plain")), "en"))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = tx.sample_and_fit(docs, marks, positives=60, negatives=120)
    out = tx.score_texts(docs, model)
    share = {k: out.where(F.col("text").contains(k)).agg(F.avg("predicted")).first()[0] for k in ("strong", "weak")}
    assert share["strong"] > 0.9 and share["weak"] < 0.1
    whole = tx.sample_and_fit(docs, marks)
    again = tx.score_texts(docs, whole)
    share = {k: again.where(F.col("text").contains(k)).agg(F.avg("predicted")).first()[0] for k in ("strong", "weak")}
    assert share["strong"] > 0.9 and share["weak"] < 0.1


def test_used_rows_count_for_the_shares_only():
    model = tx.Model(None, [], None, None, 0.0, ["en"], None, np.zeros(2), 1.0)
    # 10 clean rows at step 100 of which 9 were used, 4 toxic ones at 100 and 4 at 300
    guess, long = np.zeros(4, int), np.zeros(4, bool)
    tx.calibrate(model, guess, np.array([0, 0, 1, 1]), long, np.array([True, False, False, False]), np.array([-900, 100, 100, 300]), np.array([90, 10, 4, 4]))
    assert model.threshold == pytest.approx([2.0, 2.0])


def test_training_words_have_a_bound(spark, monkeypatch):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    seen = []
    fit = tx.fit
    monkeypatch.setattr(tx, "fit", lambda ids, y, langs: seen.append(sum(map(len, ids))) or fit(ids, y, langs))
    tx.sample_and_fit(docs, labels)
    tx.sample_and_fit(docs, labels, train_words=seen[0] // 3)
    assert 0 < seen[1] < 0.5 * seen[0]
