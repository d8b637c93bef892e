"""Language identification with hyperdimensional profiles.

Every letter has a random bipolar vector, drawn from its code point. An n-gram's vector binds its
letters: each is rolled by its place and all are multiplied. A text's vector bundles (adds) its
n-grams, a language's prototype bundles those of all its training texts, and a text gets the
language of the nearest prototype by cosine.

Bundling is linear, so prototypes come from n-gram counts by language: tasks count their own
texts, the counts are added by (language, n-gram), and each partition of that table sends one
vector per language. What reaches the driver are the prototypes, languages x ``DIM`` numbers.
"""

from __future__ import annotations

import functools
import sys

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 1024
N = 3
SEED = 7
UNKNOWN = "und"
FLUSH_GRAMS = 500_000
BATCH_CHARS = 1 << 20
# vectors held at once, whatever the number of distinct n-grams in a batch
SLICE_GRAMS = 8192
KEPT_LETTERS = 1 << 14
BITS = 21  # of a code point

_letters: dict[int, np.ndarray] = {}


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    """Whether crc32 of the id as text falls into the fold; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def letter(code: int, dim: int) -> np.ndarray:
    key = code * 65_536 + dim
    if key not in _letters:
        if len(_letters) >= KEPT_LETTERS:
            _letters.clear()
        _letters[key] = (np.random.default_rng([SEED, code]).integers(0, 2, dim, dtype=np.int8) * 2 - 1).astype(np.int8)
    return _letters[key]


@functools.cache
def letters_or_space() -> np.ndarray:
    """Each code point's own number if it is a letter, else a space's."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(sys.maxunicode + 1)], np.int64)


def grams(text: str | None) -> np.ndarray:
    """Codes of the n-grams of the lower-cased letters; runs of other signs are one space.

    Empty if the text has no letter.
    """
    if not text:
        return np.empty(0, np.int64)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = letters_or_space()[codes]
    if (codes == 32).all():
        return np.empty(0, np.int64)
    codes = np.concatenate(([32], codes, [32]))
    space = codes == 32
    codes = codes[~(space & np.append(False, space[:-1]))]
    out = codes[: len(codes) - N + 1].copy()
    for k in range(1, N):
        out = (out << BITS) | codes[k : len(codes) - N + 1 + k]
    return out


def gram_vectors(codes: np.ndarray, dim: int) -> np.ndarray:
    """Bound vectors of n-gram codes, one int8 row each."""
    out = np.ones((len(codes), dim), np.int8)
    for k in range(N):
        letters, place = np.unique((codes >> (BITS * (N - 1 - k))) & ((1 << BITS) - 1), return_inverse=True)
        table = np.stack([np.roll(letter(c, dim), N - 1 - k) for c in letters.tolist()])
        out *= table[place]
    return out


def count_grams(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) of training rows (lang, text)."""
    import pyarrow as pa

    def count(batches):
        held: dict[str, list] = {}

        def merged(lang):
            parts = held[lang]
            codes, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return codes, np.bincount(place, np.concatenate([p[1] for p in parts])).astype(np.int64)

        def flush():
            for lang in sorted(held):
                codes, n = merged(lang)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            texts: dict[str, list[np.ndarray]] = {}
            size = 0
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts.setdefault(lang, []).append(grams(text))
                size += len(text or "")
                if size >= BATCH_CHARS:
                    for key, parts in texts.items():
                        held.setdefault(key, []).append(np.unique(np.concatenate(parts), return_counts=True))
                    texts, size = {}, 0
            for key, parts in texts.items():
                held.setdefault(key, []).append(np.unique(np.concatenate(parts), return_counts=True))
            for key in held:
                held[key] = [merged(key)]
            if sum(len(p[0][0]) for p in held.values()) >= FLUSH_GRAMS:
                yield from flush()
        yield from flush()

    counted = rows.select("lang", "text").mapInArrow(count, "lang string, gram bigint, n bigint")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn_prototypes(rows: DataFrame, dim: int = DIM) -> tuple[list[str], np.ndarray]:
    """(languages, unit prototype of each) from all training rows (lang, text)."""
    import pyarrow as pa

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            codes, n = batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.float64)
            for begin in range(0, len(codes), 4096):
                part = slice(begin, begin + 4096)
                vectors = gram_vectors(codes[part], dim)
                for lang in set(langs[part]):
                    own = langs[part] == lang
                    sums[lang] = sums.get(lang, 0) + n[part][own] @ vectors[own]
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dim, pa.string()), pa.array(np.arange(dim), pa.int32()), pa.array(v)], ["lang", "k", "v"])

    sums = count_grams(rows).mapInArrow(bundle, "lang string, k int, v double").groupBy("lang", "k").agg(F.sum("v").alias("v")).collect()
    langs = sorted({r["lang"] for r in sums})
    out = np.zeros((len(langs), dim))
    place = {lang: i for i, lang in enumerate(langs)}
    for r in sums:
        out[place[r["lang"]], r["k"]] = r["v"]
    return langs, out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def predict(texts: list[str | None], prototypes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest prototype or -1, cosine) of each text."""
    best, score = np.full(len(texts), -1), np.zeros(len(texts))
    counted = [np.unique(grams(t), return_counts=True) for t in texts]
    rows = [i for i, (codes, _) in enumerate(counted) if len(codes)]
    if not rows or not len(prototypes):
        return best, score
    distinct, place = np.unique(np.concatenate([counted[i][0] for i in rows]), return_inverse=True)
    profiles = np.zeros((len(rows), prototypes.shape[1]), np.float32)
    counts = [counted[i][1].astype(np.float32) for i in rows]
    places = np.split(place, np.cumsum([len(n) for n in counts])[:-1])
    for begin in range(0, len(distinct), SLICE_GRAMS):
        vectors = gram_vectors(distinct[begin : begin + SLICE_GRAMS], prototypes.shape[1]).astype(np.float32)
        for k, (n, own) in enumerate(zip(counts, places)):
            a, b = np.searchsorted(own, [begin, begin + SLICE_GRAMS])
            if a < b:
                profiles[k] += n[a:b] @ vectors[own[a:b] - begin]
    length = np.maximum(np.linalg.norm(profiles, axis=1, keepdims=True), 1e-12)
    cosine = (profiles / length) @ prototypes.T.astype(np.float32)
    best[rows] = cosine.argmax(1)
    score[rows] = np.clip(cosine.max(1), 0, 1)
    return best, score


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and (lang_pred, score).

    Null, empty and letterless texts are ``und`` with score 0, as is every text if nothing was
    learned. Equal cosines take the first language by name. Input columns with one of the new
    names are replaced.
    """
    from collections.abc import Iterator

    import pandas as pd

    langs, prototypes = model

    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            texts = series.tolist()
            begin, size, parts = 0, 0, []
            for i, t in enumerate(texts):
                size += len(t or "")
                if size >= BATCH_CHARS or i + 1 == len(texts):
                    best, score = predict(texts[begin : i + 1], prototypes)
                    parts.append(pd.DataFrame({"lang_pred": [langs[b] if b >= 0 else UNKNOWN for b in best], "score": score}))
                    begin, size = i + 1, 0
            yield pd.concat(parts) if parts else pd.DataFrame({"lang_pred": pd.Series([], dtype=str), "score": pd.Series([], dtype=float)})

    nearest.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    udf = F.pandas_udf(nearest, "lang_pred string, score double")
    docs = docs.drop("lang_pred", "score")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    out = docs.select(own.alias("row"), F.col(text_col).alias("text")).withColumn("found", udf("text"))
    return out.select("row.*", "found.*")


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dim: int = DIM):
    """Prototypes from all rows with a language that are not held out."""
    rows = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return learn_prototypes(rows, dim)
