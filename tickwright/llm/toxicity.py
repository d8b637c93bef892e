"""Toxicity: a convolutional text classifier with hashed words, trained in numpy.

Words are hashed into buckets with a small vector each; filters of width one, two and three slide
over a text, the largest answer of each filter is pooled, and a linear layer gives the logit.
Training starts from smoothed word odds in the first vector place and runs minibatch Adagrad. It
sees a bounded sample of labelled rows (``POSITIVES``, ``NEGATIVES``); all else covers all rows.

Thresholds are calibrated by language on all labelled rows that training does not see: a fifth of
the texts is never sampled, nor are long ones, and what the sample leaves over is used as well. One
Spark pass counts their logits in steps by guessed language and label, weighted to the class shares
of all labelled rows, so the limits of the sample do not move a threshold. The language is guessed
from the words alone by multinomial odds, so nothing but the text enters a score, and a text at its
language's threshold scores ``CUT`` exactly.

Scoring is one Arrow pass. The model has a fixed size and travels with the function; convolution
becomes sums of per-bucket answers that each worker tabulates once.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickwright.llm.language_id import held_out
from tickwright.session import materialize

BUCKETS = 1 << 18
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
POSITIVES = 4000
NEGATIVES = 8000
LONGEST = 20_000  # words of a training text; longer ones are not sampled
TRAIN_WORDS = 8_000_000  # of all training texts together, which the driver holds as 32-bit numbers
EPOCHS = 6
BATCH = 32
RATE = 0.05
CUT = 0.7
SPARED = 5  # one text of so many is kept from training
STEPS = 100  # of a logit in the model's scale, in which the classes' medians are 6 apart
FARTHEST = 64 * STEPS
SLAB_WORDS = 1 << 16
SEED = 11

# ASCII signs become spaces, letters, digits and all other bytes stay
SIGNS = bytes(b if b >= 128 or bytes([b]).isalnum() else 32 for b in range(256))


def word_ids(text: str | None) -> np.ndarray:
    """Bucket of every word, and padding so that each filter fits at each word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().translate(SIGNS).split()
    out = np.full(max(1, len(words)) + max(WIDTHS) - 1, BUCKETS, np.int32)
    out[: len(words)] = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) & (BUCKETS - 1)
    return out


@dataclass
class Model:
    vectors: np.ndarray  # bucket x DIM, the last row is padding
    filters: list[np.ndarray]  # for each width: place x DIM x FILTERS
    shift: np.ndarray
    weight: np.ndarray
    bias: float
    langs: list[str]
    word_odds: np.ndarray  # bucket x language
    threshold: np.ndarray  # one for each language, the last for texts of no known word
    scale: float
    constant: float | None = None  # the score of all texts if the sample has one class only
    _answers: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_answers": None}

    def answers(self) -> np.ndarray:
        """Answers of every filter place, and language odds, for every bucket."""
        if self._answers is None:
            self._answers = np.concatenate([self.vectors @ f[j] for f in self.filters for j in range(len(f))] + [self.word_odds], axis=1).astype(np.float32)
        return self._answers

    def logits(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(logit, guessed language) of texts given as buckets."""
        tail = max(WIDTHS) - 1
        sizes = np.array([len(t) for t in texts])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        ids = np.concatenate(texts + [np.full(tail, BUCKETS, np.int32)])
        rows = self.answers()[ids]
        n = len(ids) - tail
        # windows that begin in a text's padding must not count
        inner = np.ones(n, bool)
        for k in range(1, tail + 1):
            inner[ends - k] = False
        pooled, column = [], 0
        for width in WIDTHS:
            total = rows[:n, column : column + FILTERS].copy()
            for j in range(1, width):
                total += rows[j : n + j, column + j * FILTERS : column + (j + 1) * FILTERS]
            total[~inner] = -np.inf
            pooled.append(np.maximum.reduceat(total, starts, axis=0))
            column += width * FILTERS
        z = np.maximum(np.concatenate(pooled, axis=1) + self.shift, 0) @ self.weight + self.bias
        if not self.langs:
            return z, np.full(len(texts), -1)
        odds = np.add.reduceat(rows[:n, column:].astype(np.float64), starts, axis=0)
        return z, np.where((odds != 0).any(1), odds.argmax(1), -1)

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        z, lang = self.logits(texts)
        return calibrated(z, self.threshold[lang], self.scale)


def calibrated(z: np.ndarray, threshold: np.ndarray, scale: float) -> np.ndarray:
    """Monotone in z; the threshold itself becomes ``CUT``."""
    x = np.clip((z - threshold) * scale, -500, 500)
    return 1 / (1 + np.exp(-x) * (1 - CUT) / CUT)


def start_odds(texts: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log odds of each bucket between the classes by documents, drawn to zero for rare ones."""
    seen = np.zeros((2, BUCKETS + 1))
    for ids, label in zip(texts, y):
        seen[int(label), np.unique(ids)] += 1
    odds = np.log((seen[1] + 0.5) / (y.sum() + 1)) - np.log((seen[0] + 0.5) / (len(y) - y.sum() + 1))
    odds *= seen.sum(0) / (seen.sum(0) + 20)
    odds[BUCKETS] = 0
    return np.clip(odds, -2, 4)


def train_filters(texts: list[np.ndarray], y: np.ndarray) -> Model:
    rng = np.random.default_rng(SEED)
    vectors = rng.normal(0, 0.05, (BUCKETS + 1, DIM)).astype(np.float32)
    vectors[:, 0] = start_odds(texts, y)
    vectors[BUCKETS] = 0
    filters = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, : FILTERS // 2] = np.abs(f[:, 0, : FILTERS // 2]) + 0.5 / len(f)
    weight = rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32) + 0.1
    shift = np.zeros_like(weight)
    bias = np.array([-1.0], np.float32)
    memory = [np.full_like(a, 1e-2) for a in (vectors, *filters, shift, weight, bias)]
    balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    tail = max(WIDTHS) - 1

    def step(value, past, gradient):
        past += gradient**2
        value -= RATE * gradient / np.sqrt(past)

    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for begin in range(0, len(order), BATCH):
            chosen = order[begin : begin + BATCH]
            own = [texts[i] for i in chosen]
            ids = np.concatenate(own)
            sizes = np.array([len(t) for t in own])
            starts = np.cumsum(sizes) - sizes
            x = vectors[ids]
            pooled, places = [], []
            for f in filters:
                total = x @ f[0]
                for j in range(1, len(f)):
                    total[:-j] += x[j:] @ f[j]
                where = np.stack([total[a : a + n - tail].argmax(0) + a for a, n in zip(starts, sizes)])
                places.append(where)
                pooled.append(np.take_along_axis(total, where, 0))
            pooled = np.concatenate(pooled, axis=1)
            active = np.maximum(pooled + shift, 0)
            p = 1 / (1 + np.exp(-np.clip(active @ weight + bias, -30, 30)))
            g = ((p - y[chosen]) * balance[chosen] / len(chosen)).astype(np.float32)
            inner = g[:, None] * weight * (active > 0)
            step(weight, memory[-2], active.T @ g)
            step(bias, memory[-1], g.sum(keepdims=True))
            step(shift, memory[-3], inner.sum(0))
            rows, changes = [], []
            for k, f in enumerate(filters):
                part = inner[:, k * FILTERS : (k + 1) * FILTERS]
                gradient = np.empty_like(f)
                for j in range(len(f)):
                    at = places[k] + j
                    gradient[j] = np.einsum("bf,bfd->df", part, x[at])
                    rows.append(ids[at].ravel())
                    changes.append((part[:, :, None] * f[j].T[None]).reshape(-1, DIM))
                step(f, memory[1 + k], gradient)
            touched, place = np.unique(np.concatenate(rows), return_inverse=True)
            change = np.zeros((len(touched), DIM), np.float32)
            np.add.at(change, place, np.concatenate(changes))
            change[touched == BUCKETS] = 0
            memory[0][touched] += change**2
            vectors[touched] -= RATE * change / np.sqrt(memory[0][touched])
    return Model(vectors, filters, shift, weight, float(bias[0]), [], np.zeros((BUCKETS + 1, 0), np.float32), np.zeros(1), 1.0)


def best_threshold(z: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> float | None:
    """The middle of the best gap by F1, rows counting by weight; None if a class is missing."""
    if y.sum() == 0 or y.sum() == len(y):
        return None
    weight = np.ones(len(y)) if weight is None else weight
    values, place = np.unique(-z, return_inverse=True)
    hits = np.cumsum(np.bincount(place, weight * y))
    f1 = 2 * hits / (np.cumsum(np.bincount(place, weight)) + hits[-1])
    last = len(f1) - 1 - int(np.argmax(f1[::-1]))
    below = -values[last + 1] if last + 1 < len(values) else -values[last] - 2
    return float((-values[last] + below) / 2)


def fit(texts: list[np.ndarray], y: np.ndarray, langs: list[str | None]) -> Model:
    """Trains on the whole sample; its one threshold holds until ``calibrate`` sets them."""
    y = np.asarray(y, np.float64)
    if len(y) == 0 or y.sum() in (0, len(y)):
        blank = np.zeros((BUCKETS + 1, 0), np.float32)
        return Model(blank, [], np.zeros(0), np.zeros(0), 0.0, [], blank, np.zeros(1), 1.0, constant=float(len(y) > 0 and y[0]))
    model = train_filters(texts, y)
    names = sorted({x for x in langs if x is not None})
    counts = np.full((BUCKETS + 1, len(names)), 0.1)
    for ids, lang in zip(texts, langs):
        if lang is not None:
            np.add.at(counts[:, names.index(lang)], ids, 1)
    odds = np.log(counts / counts.sum(0)) if names else counts
    model.langs, model.word_odds = names, (odds - odds.mean(1, keepdims=True) if names else odds).astype(np.float32)
    model.word_odds[BUCKETS] = 0
    model._answers = None
    z = np.concatenate([model.logits([t])[0] for t in texts])
    model.threshold = np.full(len(names) + 1, best_threshold(z, y))
    spread = np.median(z[y == 1]) - np.median(z[y == 0])
    model.scale = float(6 / spread) if spread > 1e-6 else 1.0
    return model


def slabs(texts: list[str | None]):
    """Buckets of the texts, in lists of about ``SLAB_WORDS`` words."""
    held, size = [], 0
    for text in texts:
        held.append(word_ids(text))
        size += len(held[-1])
        if size >= SLAB_WORDS:
            yield held
            held, size = [], 0
    if held:
        yield held


def placed(rows: DataFrame, model: Model) -> DataFrame:
    """(id, mark, guess, step) of all rows (id, mark, text): guessed language and logit in steps."""
    import pyarrow as pa

    def place(batches):
        for batch in batches:
            found = [model.logits(held) for held in slabs(batch.column(2).to_pylist())]
            if found:
                z, guess = (np.concatenate(x) for x in zip(*found))
                step = np.clip(np.floor((z - model.threshold[-1]) * model.scale * STEPS + 0.5), -FARTHEST, FARTHEST)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(guess, pa.int32()), pa.array(step.astype(np.int32))], ["id", "mark", "guess", "step"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "mark", "text").mapInArrow(place, f"id {kind}, mark bigint, guess int, step int")


def calibrate(model: Model, guess: np.ndarray, y: np.ndarray, long: np.ndarray, used: np.ndarray, step: np.ndarray, n: np.ndarray) -> None:
    """Sets the thresholds from counts ``n``.

    Rows that training used only count for the shares of language, label and length; the others
    stand for them. A language without both classes gets the threshold of all.
    """
    weight = n.astype(np.float64)
    for key in set(zip(guess.tolist(), y.tolist(), long.tolist())):
        own = (guess == key[0]) & (y == key[1]) & (long == key[2])
        if (own & ~used).any():
            weight[own] *= n[own].sum() / n[own & ~used].sum()
    names = range(len(model.langs))
    found = [best_threshold(step[own], y[own], weight[own]) for own in [~used & (guess == k) for k in names] + [~used]]
    steps = np.array([found[-1] if t is None else t for t in found])
    model.threshold = model.threshold[-1] + steps / (STEPS * model.scale)


def sample_and_fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", positives: int = POSITIVES, negatives: int = NEGATIVES, train_words: int = TRAIN_WORDS) -> Model:
    """Fits on at most so many labelled rows of each class, and words together, that are not held out
    (fold 1 of 3) and sets the thresholds on all others outside that fold.

    Documents are taken by a hash of the id, and kept from training by one of the text. If a class
    is missing on either side, which happens in tiny tables only, one side has all rows. Rows
    without a label or an id do not count; a document with several labels is toxic if one says so.
    """
    import pyarrow as pa

    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col), 3, 1))
    marks = marks.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y")).where("y IN (0, 1)")
    texts = docs.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col), 3, 1))
    texts = texts.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).withColumn("mark", F.xxhash64("text"))
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\s+")) + 1
    long = F.col("words") > LONGEST
    spared = F.pmod(F.xxhash64("mark"), F.lit(SPARED)) == SPARED - 1
    known = texts.select("id", "mark", words.alias("words")).withColumn("long", long).join(marks, "id").distinct()
    known = materialize(known.withColumn("spared", spared), "labelled-rows")
    sides = {(r["y"], r["spared"] or r["long"]) for r in known.select("y", "long", "spared").distinct().collect()}
    apart = len(sides) == 4
    pool = known.where(~F.col("long") & ~F.col("spared")) if apart else known.where(~F.col("long"))
    take = [pool.where(F.col("y") == k).orderBy(F.xxhash64("id"), "id", "mark").limit(n) for k, n in ((1, positives), (0, negatives))]
    sofar = F.sum("words").over(Window.orderBy(F.xxhash64("id"), "id", "mark").rowsBetween(Window.unboundedPreceding, 0))
    take = take[0].unionByName(take[1]).withColumn("sofar", sofar).where(F.col("sofar") <= train_words)  # a window over both limits' rows at most
    take = F.broadcast(materialize(take.select("id", "mark", "y"), "sampled-rows"))
    rows = texts.join(take, ["id", "mark"]).select("id", "mark", "text", "y", "lang")

    def hashed(batches):
        for batch in batches:
            ids = [word_ids(t).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(ids, pa.binary()), *batch.columns[3:]], ["id", "mark", "ids", "y", "lang"])

    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(hashed, f"id {kind}, mark bigint, ids binary, y int, lang string").orderBy(F.xxhash64("id", "mark")).toArrow()
    ids = [np.frombuffer(x, np.int32) for x in found["ids"].to_pylist()]
    model = fit(ids, np.array(found["y"].to_pylist(), np.float64), found["lang"].to_pylist())
    if model.constant is not None:
        return model
    used = F.broadcast(take.select("mark").distinct().withColumn("used", F.lit(apart)))
    counted = placed(texts, model).join(known, ["id", "mark"]).dropDuplicates(["id", "mark"]).join(used, "mark", "left")
    counted = counted.groupBy("guess", "y", "long", F.coalesce("used", F.lit(False)).alias("used"), "step").agg(F.count(F.lit(1)).alias("n")).toArrow()
    calibrate(model, *[np.array(counted[c].to_pylist()) for c in ("guess", "y", "long", "used", "step", "n")])
    return model


def score_texts(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and (score, predicted). Null counts as the empty text; equal texts
    score equal. Input columns with one of the new names are replaced."""
    from collections.abc import Iterator

    import pandas as pd

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            out = [model.scores(held) for held in slabs(series.tolist())]
            yield pd.Series(np.concatenate(out) if out else [], dtype="float64")

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    out = docs.drop("score", "predicted").withColumn("score", F.pandas_udf(score, "double")(F.col(text_col)))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
