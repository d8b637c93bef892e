"""Language-model scores by context-tree weighting over bytes.

A text is its lower-cased words, one space between them and an end sign. Each byte is eight binary
choices; every choice, in every context of the last 0 to ``DEPTH`` bytes, is a node with two counts
and the Krichevsky-Trofimov probability of its training bits. Weighting runs from the leaves up,

    log P(node) = log(1/2 KT(node) + 1/2 product of P over the node's longer contexts),

and the conditional probability of a bit mixes the KT estimates of all depths with the weights
that this gives along its path, from the root down. A choice never seen in training has even odds
below the last context that was seen.

Everything learned comes from counts of (context, byte) and of words over all training rows: tasks
count their own texts, Spark adds up, each tree level is one aggregate of the level below and one
join with the level above. The trained model is a table of (context, byte) with its log
probability. Scoring looks bytes up in that table: the most frequent grams, at most
``LOCAL_GRAMS``, and the most frequent words, at most ``LOCAL_WORDS``, are broadcast; what a text
has beyond them is joined, so no key of that join is a frequent one. Long texts are cut at spaces
and counted and scored by pieces.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwright.llm.language_id import held_out
from tickwright.session import materialize

DEPTH = 5
END = 255
LOCAL_GRAMS = 1 << 23
LOCAL_WORDS = 1 << 18
SLAB_BYTES = 1 << 20
FLUSH_GRAMS = 1 << 20
FLUSH_WORDS = 1 << 18
SENT_ROWS = 1 << 16
# pieces of a slab are numbered in 16 bits beside the six bytes of a gram
SLAB_PIECES = 1 << 16


def normal(text: str | None) -> bytes:
    """Lower-cased words with one space between them."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def slabs(texts: list[str | None], depth: int = DEPTH):
    """(first text, pieces) with about ``SLAB_BYTES`` bytes; a piece is (bytes before, own bytes).

    A text ends with an end sign, and ``depth`` of them stand before it. A long text has slabs of
    its own with one piece each, cut behind spaces; all its pieces but the last lack the end sign.
    """
    end, filler = bytes([END]), bytes([END]) * depth
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        body = normal(text)
        if held and (size + len(body) > SLAB_BYTES or len(held) == SLAB_PIECES):
            yield first, held
            held, size = [], 0
        if len(body) <= SLAB_BYTES:
            if not held:
                first = i
            held.append((filler, body + end))
            size += len(body) + depth + 1
            continue
        at, before = 0, filler
        while at < len(body):
            stop = body.find(b" ", at + SLAB_BYTES) + 1 or len(body)
            yield i, [(before, body[at:stop] + (end if stop == len(body) else b""))]
            at, before = stop, body[max(0, stop - depth) : stop].rjust(depth, end)
    if held:
        yield first, held


def gram_codes(pieces: list[tuple[bytes, bytes]], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(code of each byte with the ``depth`` bytes before it, bytes of each piece), piece by piece."""
    stream = np.frombuffer(b"".join([x for piece in pieces for x in piece]), np.uint8).astype(np.int64)
    sizes = np.array([len(body) for _, body in pieces], np.int64)
    codes = np.zeros(len(stream) - depth, np.int64)
    for k in range(depth + 1):
        codes = (codes << 8) | stream[k : len(codes) + k]
    own = np.ones(len(codes), bool)
    behind = (np.cumsum(sizes + depth) - depth)[:-1]
    for k in range(depth):
        own[behind + k] = False
    return codes[own], sizes


def word_column(pieces: list[tuple[bytes, bytes]]):
    """(Arrow array of all words, each with one space behind it; words of each piece)."""
    import pyarrow as pa

    end = bytes([END])
    bodies = [body.removesuffix(end) for _, body in pieces]
    bodies = [body + b" " if body and not body.endswith(b" ") else body for body in bodies]
    data = b"".join(bodies)
    raw = np.frombuffer(data, np.uint8)
    ends = np.append(0, np.flatnonzero(raw == 32) + 1)
    words = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
    reach = np.cumsum([len(body) for body in bodies])
    return words, np.diff(np.searchsorted(ends, reach, "right") - 1, prepend=0)


def first_of(values: np.ndarray) -> np.ndarray:
    """Places where a sorted array begins a new value."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.empty(0, np.int64)


def merge(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(codes, n, m) with equal codes of the parts, each sorted, added up."""
    codes, n, m = (np.concatenate([p[k] for p in parts]) for k in range(3))
    order = np.argsort(codes, kind="stable")  # merges sorted runs
    codes = codes[order]
    start = first_of(codes)
    return codes[start], np.add.reduceat(n[order], start), np.add.reduceat(m[order], start)


class GramCounts:
    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, codes: np.ndarray, train: np.ndarray) -> None:
        keys = codes << 1 | train
        keys.sort()
        start = first_of(keys)
        m = np.diff(np.append(start, len(keys)))
        keys = keys[start]
        self.parts.append((keys >> 1, m * (keys & 1), m))
        if sum(len(p[0]) for p in self.parts[1:]) > max(FLUSH_GRAMS // 4, len(self.parts[0][0])):
            self.parts = [merge(self.parts)]

    def full(self) -> bool:
        return len(self.parts) == 1 and len(self.parts[0][0]) > FLUSH_GRAMS

    def flush(self) -> tuple[np.ndarray, ...]:
        out = merge(self.parts)
        self.parts = []
        return out


class WordCounts:
    def __init__(self):
        self.parts: list = []

    def add(self, pieces, train: bool) -> None:
        import pyarrow as pa

        found = word_column(pieces)[0].value_counts()
        m = found.field(1)
        n = m if train else pa.array(np.zeros(len(m), np.int64))
        self.parts.append(pa.table([found.field(0), n, m], ["word", "n", "m"]))
        if sum(len(p) for p in self.parts[1:]) > max(FLUSH_WORDS // 4, len(self.parts[0])):
            self.parts = [self.merged()]

    def merged(self):
        import pyarrow as pa

        found = pa.concat_tables(self.parts).group_by("word").aggregate([("n", "sum"), ("m", "sum")])
        return found.select(["word", "n_sum", "m_sum"]).rename_columns(["word", "n", "m"])

    def full(self) -> bool:
        return len(self.parts) == 1 and len(self.parts[0]) > FLUSH_WORDS

    def flush(self):
        out = self.merged()
        self.parts = []
        return out


def corpus_counts(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Partial counts (word, gram, n, m) of rows (text, train): n in training rows, m in all.

    A row has a word (with one space behind it), or a gram (context and byte), or neither; the last
    counts rows.
    """
    import pyarrow as pa

    if depth > 5:
        raise ValueError("a gram has six bytes at most")
    schema = pa.schema([("word", pa.binary()), ("gram", pa.int64()), ("n", pa.int64()), ("m", pa.int64())])

    def count(batches):
        _tables.clear()  # of an earlier model; the worker may have served it
        words, grams, docs = WordCounts(), GramCounts(), [0, 0]

        def sent(columns):
            yield from pa.table(columns, schema=schema).combine_chunks().to_batches(SENT_ROWS)

        def sent_words():
            found = words.flush()
            return sent([found.column("word"), pa.nulls(len(found), pa.int64()), found.column("n"), found.column("m")])

        def sent_grams():
            codes, n, m = grams.flush()
            return sent([pa.nulls(len(codes), pa.binary()), *map(pa.array, (codes, n, m))])

        for batch in batches:
            texts, train = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), np.int64)
            docs = [docs[0] + int(train.sum()), docs[1] + len(texts)]
            for first, pieces in slabs(texts, depth):
                codes, sizes = gram_codes(pieces, depth)
                flags = train[first : first + len(pieces)]
                grams.add(codes, np.repeat(flags, sizes))
                for flag in (0, 1):
                    words.add([p for p, f in zip(pieces, flags) if f == flag], bool(flag))
                if grams.full():
                    yield from sent_grams()
                if words.full():
                    yield from sent_words()
        if grams.parts:
            yield from sent_grams()
        if words.parts:
            yield from sent_words()
        if docs[1]:
            yield from sent([pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array(docs[:1]), pa.array(docs[1:])])

    return rows.select("text", F.col("train").cast("int").alias("train")).mapInArrow(count, "word binary, gram bigint, n bigint, m bigint")


# ---- the tree ----------------------------------------------------------------------------


def log_gamma(x: Column) -> Column:
    """Stirling's series eight steps up; exact to about 1e-11 for x of a half or more."""
    y = x + 8
    steps = x
    for k in range(1, 8):
        steps = steps * (x + k)
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return series - F.log(steps)


def log_kt(zeros: Column, ones: Column) -> Column:
    zeros, ones = zeros.cast("double"), ones.cast("double")
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - math.log(math.pi)


def choices(gram: Column) -> Column:
    """The eight (key, bit) of a gram; a key is the context and the byte's bits so far after a 1."""
    byte = gram.bitwiseAND(255)
    context = F.shiftleft(F.shiftright(gram, 8), 8)
    out = []
    for i in range(8):
        node = F.shiftright(byte, 8 - i).bitwiseOR(F.lit(1 << i))
        out.append(F.struct((context + node).alias("key"), F.shiftright(byte, 7 - i).bitwiseAND(1).alias("bit")))
    return F.explode(F.array(*out))


def shorter(key: Column, depth: int) -> Column:
    """The key with only the last ``depth`` bytes of its context."""
    return key.bitwiseAND(F.lit((1 << (8 * (depth + 1))) - 1).cast("bigint"))


def gram_scores(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(gram, lp): log10 of the probability of a gram's byte after its context, from (gram, n)."""
    bits = grams.select("gram", "n", choices(F.col("gram")).alias("c")).select("n", "c.key", "c.bit")
    level = bits.groupBy("key").agg(F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).alias("zeros"), F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).alias("ones"))
    own = log_kt(F.col("zeros"), F.col("ones"))
    levels = {depth: materialize(level.withColumn("kt", F.lit(1.0)).withColumn("lw", own), "tree-level")}
    for d in reversed(range(depth)):
        below = levels[d + 1].groupBy(shorter(F.col("key"), d).alias("key")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("lw").alias("longer"))
        below = below.withColumn("own", own).withColumn("gap", F.col("longer") - F.col("own"))
        # share of the node's own estimate, and log of the half-and-half mixture, without overflow
        share = 1 / (1 + F.exp(F.least(F.col("gap"), F.lit(700.0))))
        mixed = F.greatest("own", "longer") + F.log1p(F.exp(-F.abs("gap"))) - math.log(2)
        levels[d] = materialize(below.select("key", "zeros", "ones", share.alias("kt"), mixed.alias("lw")), "tree-level")
    estimate = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1)
    done = levels[0].select("key", (F.col("kt") * estimate).alias("p"), (1 - F.col("kt")).alias("rest"))
    for d in range(1, depth + 1):
        above = done.select(F.col("key").alias("up"), F.col("p").alias("p_up"), F.col("rest").alias("rest_up"))
        here = levels[d].withColumn("up", shorter(F.col("key"), d - 1)).join(above, "up")
        done = here.select("key", (F.col("p_up") + F.col("rest_up") * F.col("kt") * estimate).alias("p"), (F.col("rest_up") * (1 - F.col("kt"))).alias("rest"))
        done = materialize(done, "tree-paths")
    asked = grams.select("gram", choices(F.col("gram")).alias("c")).select("gram", "c.key", "c.bit")
    odds = F.when(F.col("bit") == 1, F.col("p")).otherwise(1 - F.col("p"))
    return asked.join(done.select("key", "p"), "key").groupBy("gram").agg(F.sum(F.log10(odds)).alias("lp"))


class Lookup:
    """Numbers by 64-bit key: open addressing with linear probing, all in numpy."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(len(keys) * 4 // 3).bit_length()))
        slot = self.slots(keys)
        order = np.argsort(slot, kind="stable")
        place = np.maximum.accumulate(slot[order] - np.arange(len(keys))) + np.arange(len(keys)) if len(keys) else slot
        size = max((1 << (64 - int(self.shift))), int(place[-1]) + 1 if len(keys) else 1) + 1
        self.keys = np.full(size, -1, np.int64)
        self.values = np.zeros(size, np.float64)
        self.keys[place], self.values[place] = keys[order], values[order]

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys, NaN where a key is absent."""
        at = self.slots(keys)
        wrong = np.flatnonzero(self.keys[at] != keys)
        absent = np.empty(0, np.int64)
        while len(wrong):
            found = self.keys[at[wrong]]
            absent = np.append(absent, wrong[found == -1])
            wrong = wrong[(found != -1) & (found != keys[wrong])]
            at[wrong] += 1
        out = self.values[at]
        out[absent] = np.nan
        return out


_tables: dict[str, tuple] = {}


def local_tables(name: str, grams, words, below: float) -> tuple[Lookup, dict[bytes, float], set[bytes]]:
    """The broadcast model in a worker: (lookup of grams, base score of each word, words that training lacks)."""
    if name not in _tables:
        _tables.clear()
        keys, n = words.value
        scores = dict(zip(keys, (np.log10(n + 0.5) - below).tolist()))
        _tables[name] = Lookup(*grams.value), scores, {w for w, k in zip(keys, n.tolist()) if not k}
    return _tables[name]


def lists(owner: np.ndarray, size: int, key, counts: np.ndarray, name: str):
    """A column of lists of (key, k), one list for each of ``size`` owners; ``owner`` is sorted."""
    import pyarrow as pa

    ends = np.append(0, np.cumsum(np.bincount(owner, minlength=size)))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([key, pa.array(counts, pa.int64())], [name, "k"]))


# ---- scores ------------------------------------------------------------------------------


def frequent(counts: DataFrame, limit: int, *columns: str) -> DataFrame:
    """The given columns of the rows with the largest m, at most ``limit`` of them, by a histogram of m."""
    step = F.floor(F.log2("m") * 8)
    histogram = sorted(((r["step"], r["k"]) for r in counts.where("m > 0").groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    total, least = 0, math.inf
    for s, k in histogram:
        total += k
        if total > limit:
            break
        least = s
    return counts.where(step >= F.lit(float(least))).select(*columns)


def score_slab(pieces, depth: int, table: Lookup, scores: dict[bytes, float], unknown: set[bytes]) -> dict:
    """Sums over each piece, and what the local tables lack."""
    import pyarrow as pa

    size = len(pieces)
    codes, bytes_of = gram_codes(pieces, depth)
    key = (codes.astype(np.uint64) << np.uint64(16)) | np.repeat(np.arange(size, dtype=np.uint64), bytes_of)
    key.sort()
    codes, piece = (key >> np.uint64(16)).astype(np.int64), (key & np.uint64(0xFFFF)).astype(np.int64)
    start = first_of(codes)
    value = np.repeat(table(codes[start]), np.diff(np.append(start, len(codes))))
    far = np.isnan(value)
    value[far] = 0
    out = {"score": np.bincount(piece, value, size), "n_bytes": bytes_of}
    lost = key[far]
    start = first_of(lost)
    times = np.diff(np.append(start, len(lost)))
    order = np.argsort(piece[far][start], kind="stable")
    out["grams"] = lists(piece[far][start][order], size, pa.array(codes[far][start][order]), times[order], "gram")

    words, counts = word_column(pieces)
    coded = words.dictionary_encode()
    own = coded.dictionary.to_pylist()
    by_word = np.array([scores.get(w, np.nan) for w in own], np.float64)
    is_known = np.array([w in scores and w not in unknown for w in own], np.float64)
    at = coded.indices.to_numpy(zero_copy_only=False)
    piece, value = np.repeat(np.arange(size), counts), by_word[at]
    rare = np.isnan(value)
    value[rare] = 0
    out |= {"words": counts, "base": np.bincount(piece, value, size), "known": np.bincount(piece, is_known[at], size).astype(np.int64)}
    pairs, times = np.unique(piece[rare] * max(len(own), 1) + at[rare], return_counts=True)
    out["rare"] = lists(pairs // max(len(own), 1), size, coded.dictionary.take(pa.array(pairs % max(len(own), 1))), times, "word")
    return out


def as_one(parts: list[dict]) -> dict:
    """The sums of the pieces of one text."""
    import pyarrow as pa

    out = {k: np.sum([p[k] for p in parts], axis=0) for k in ("score", "n_bytes", "words", "base", "known")}
    for k in ("grams", "rare"):
        values = pa.concat_arrays([p[k].values for p in parts])
        out[k] = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    return out


def score_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    depth: int = DEPTH,
    local_grams: int = LOCAL_GRAMS,
    local_words: int = LOCAL_WORDS,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, code_length) of each row.

    Trains on the rows whose id is not in fold 1 of 5 and scores all. Null and empty texts are one
    token, the end. ``code_length`` is in bits per byte of the scored form. Repeated rows are
    scored (and learned) each; other columns are not read; without training rows all bits are even.
    """
    import pyarrow as pa

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out(F.col(id_col), 5, 1).alias("held_out"))
    counts = materialize(corpus_counts(rows.select("text", (~F.col("held_out")).alias("train")), depth), "corpus-counts")
    added = [F.sum("n").alias("n"), F.sum("m").alias("m")]
    words = materialize(counts.where("word IS NOT NULL").groupBy("word").agg(*added), "word-counts")
    grams = materialize(counts.where("gram IS NOT NULL").groupBy("gram").agg(*added), "gram-counts")
    ends = counts.where("word IS NULL AND gram IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    seen = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    train_tokens, distinct = seen["n"] + ends, seen["v"] + (ends > 0)
    below = math.log10(train_tokens + 0.5 * (distinct + 1))
    scored = gram_scores(grams.select("gram", "n"), depth)
    model = materialize(scored.join(grams.select("gram", "m"), "gram"), "gram-scores")
    near = frequent(model, local_grams, "gram", "lp").toArrow()
    near_words = frequent(words, local_words, "word", "n").toArrow()
    context, name = rows.sparkSession.sparkContext, uuid.uuid4().hex
    sent_grams = context.broadcast((near.column("gram").to_numpy(), near.column("lp").to_numpy()))
    sent_words = context.broadcast((near_words.column("word").to_pylist(), near_words.column("n").to_numpy()))
    del near, near_words
    names = ["row", "id", "held_out", "n_tokens", "n_known", "base", "score", "n_bytes", "words", "grams"]
    end_score = math.log10(ends + 0.5) - below

    def score(batches):
        from pyspark import TaskContext

        local = local_tables(name, sent_grams, sent_words, below)
        number = TaskContext.get().partitionId() << 40

        def row_batch(batch, first, n, x):
            part = slice(first, first + n)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.arange(number + first, number + first + n)), batch.column(0)[part], batch.column(2)[part], pa.array(x["words"] + 1, pa.int64()), pa.array(x["known"] + int(ends > 0), pa.int64()), pa.array(x["base"] + end_score), pa.array(x["score"]), pa.array(x["n_bytes"], pa.int64()), x["rare"], x["grams"]],
                names,
            )

        for batch in batches:
            open_parts = []
            for first, pieces in slabs(batch.column(1).to_pylist(), depth):
                found = score_slab(pieces, depth, *local)
                if pieces[-1][1][-1:] != bytes([END]):
                    open_parts.append(found)
                    continue
                if open_parts:
                    found, open_parts = as_one([*open_parts, found]), []
                yield row_batch(batch, first, len(pieces), found)
            number += batch.num_rows

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"row bigint, id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, n_bytes bigint, words array<struct<word: binary, k: bigint>>, grams array<struct<gram: bigint, k: bigint>>"
    done = materialize(rows.select("id", "text", "held_out").mapInArrow(score, schema), "scored")

    rare = done.select("row", F.explode("words").alias("w")).select("row", "w.word", "w.k").join(words.select("word", "n"), "word", "left")
    rare = rare.select("row", "k", F.coalesce("n", F.lit(0)).alias("n"))
    more = rare.select("row", (F.col("k") * (F.log10(F.col("n") + 0.5) - below)).alias("base"), F.when(F.col("n") > 0, F.col("k")).otherwise(0).alias("known"), F.lit(0.0).alias("lp"))
    far = done.select("row", F.explode("grams").alias("g")).select("row", "g.gram", "g.k").join(model.select("gram", "lp"), "gram")
    more = more.unionByName(far.select("row", F.lit(0.0).alias("base"), F.lit(0).cast("bigint").alias("known"), (F.col("k") * F.col("lp")).alias("lp")))
    more = more.groupBy("row").agg(F.sum("base").alias("more_base"), F.sum("known").alias("more_known"), F.sum("lp").alias("more_lp"))
    out = done.drop("words", "grams").join(more, "row", "left")
    total = F.col("score") + F.coalesce("more_lp", F.lit(0.0))
    return out.select(
        "id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        total.alias("score"),
        (-total / math.log10(2) / F.col("n_bytes")).alias("code_length"),
    )
