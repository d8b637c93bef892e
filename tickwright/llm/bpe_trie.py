"""Byte-pair encoding by a trie of distinct words, and decoding.

A greedy merge order has two properties that make a trie enough. Any run of neighbouring tokens in
an encoding is the encoding of its own letters, so the encoding of a prefix ends in exactly one
token, and what stands before that token is the encoding of a shorter prefix. And a row of tokens
is an encoding if each two neighbours are. A node of the trie (a prefix) therefore needs only its
last token: the one suffix of the prefix that is a token and may follow the last token of the node
where that suffix begins. Words go into the trie in sorted order, which visits it depth first;
prefixes that words share are computed once. The last letter of a word carries the word end and is
a step of its own behind its prefix node.

Whether a token may follow another is read off the merge ranks: the letters next to the border
belong to ever larger tokens, each from the rank of its merge until the rank of the next; if two
that touch at the border can merge while both last, the pair is no encoding.

Normalising and cutting into words is the tokenizer file's own (the library's components, applied
to the distinct runs between ASCII white space, which no rule of theirs looks across). Workers keep
a bounded number of runs and nodes; the result does not depend on what is kept.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwright.llm.tokens import by_bytes

KEPT_RUNS = 500_000
KEPT_NODES = 600_000
KEPT_PAIRS = 1_000_000
# longer words share no trie nodes, their states live as long as the word
TRIE_DEPTH = 64
SLICE = 1 << 21
GAP = re.compile(rb"[ \t\n\r\x0b\x0c]")
WHITE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
# fixed values: the vocabulary's word pattern, and the same for lower-case ASCII and Latin-1 letters
PLAIN_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
# byte-level vocabularies write bytes without a visible Latin-1 sign as the letters from 256 on, in order
HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
BYTE_LETTERS = {b: chr(256 + i) for i, b in enumerate(HIDDEN)}
NEVER = 1 << 60

_coders: dict[str, WordCoder] = {}


def default_tokenizer() -> str:
    """Path of the public 49k vocabulary of words with word ends."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Merges:
    """Ranks of a vocabulary's merges and which tokens may be neighbours."""

    def __init__(self, vocabulary: dict[str, int], merges: list, end: str):
        self.vocabulary, self.end = vocabulary, end
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        born = dict.fromkeys(vocabulary.values(), -1)
        for rank, pair in enumerate(merges):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            pair, made = (vocabulary[left], vocabulary[right]), vocabulary[left + right]
            if made in self.parts:
                raise ValueError("not a trained order of merges: two of them make one token")
            self.rank[pair], self.parts[made], born[made] = rank, pair, rank
        if any(max(born[a], born[b]) >= born[t] for t, (a, b) in self.parts.items()):
            raise ValueError("not a trained order of merges: a token is made before its parts")
        self.born = born
        self.longest = max(map(len, vocabulary), default=0)
        self.spines: tuple[dict, dict] = ({}, {})
        self.pairs: dict[tuple[int, int], bool] = {}
        # tokens that their own letters do not give are part of no encoding
        self.never = {t for t, (a, b) in self.parts.items() if not self.lasting(a, b, self.born[t])}

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """(token, rank of the merge that ends it) of all tokens at one border of a token."""
        found = self.spines[side].get(token)
        if found is None:
            found, here, until = [], token, NEVER
            while True:
                found.append((here, until))
                if here not in self.parts:
                    break
                until = self.born[here]
                here = self.parts[here][1 - side]
            self.spines[side][token] = found
        return found

    def lasting(self, left: int, right: int, limit: int = NEVER) -> bool:
        """No merge across the border before ``limit``; of equal merges the leftmost comes first."""
        for a, until_a in self.spine(left, 0):
            for b, until_b in self.spine(right, 1):
                rank = self.rank.get((a, b), NEVER)
                if rank < limit and rank < until_a and rank <= until_b:
                    return False
        return True

    def neighbours(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self.lasting(left, right)
        return known


class PrefixTrie:
    """Prefixes of words with the last token of each."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.forget()

    def forget(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        # of each node: its last token and that token's letters; the root has none
        self.state: list[tuple[int, int]] = [(-1, 0)]

    def last_token(self, word: str, upto: int, path: list[tuple[int, int]], end: str = "") -> tuple[int, int]:
        """(token, letters) that ends the encoding of the first ``upto`` letters."""
        m = self.merges
        tokens, pairs = m.vocabulary, m.pairs
        for start in range(upto - 1, max(0, upto - m.longest) - 1, -1):
            token = tokens.get(word[start:upto] + end)
            if token is None or token in m.never:
                continue
            if start:
                known = pairs.get((path[start][0], token))
                if known is False or known is None and not m.neighbours(path[start][0], token):
                    continue
            return token, upto - start
        raise ValueError(f"a letter without a token: {word[upto - 1]!r}")

    def encode_sorted(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """(word, ids) of sorted words: a depth-first walk that goes back to the common prefix."""
        child, states = self.child, self.state
        before, path, nodes = "", [(-1, 0)], [0]
        for word in words:
            inner = len(word) - 1
            shared, most = 0, min(len(before), inner)
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del path[shared + 1 :], nodes[shared + 1 :]
            for depth in range(shared + 1, inner + 1):
                node = child.get((nodes[-1], word[depth - 1])) if depth <= TRIE_DEPTH else None
                if node is None:
                    state = self.last_token(word, depth, path)
                    node = 0
                    if depth <= TRIE_DEPTH:
                        node = child[nodes[-1], word[depth - 1]] = len(states)
                        states.append(state)
                else:
                    state = states[node]
                path.append(state), nodes.append(node)
            before = word[:-1]
            token, length = self.last_token(word, inner + 1, path, self.merges.end)
            ids, at = [token], inner + 1 - length
            while at:
                token, length = path[at]
                ids.append(token)
                at -= length
            ids.reverse()
            yield word, ids
        if len(states) > KEPT_NODES:
            self.forget()


def runs_of(texts: list[bytes]) -> tuple[pa.StringArray, np.ndarray]:
    """(all runs between ASCII white space, runs of each text) of UTF-8 texts."""
    raw = np.frombuffer(b" ".join(texts), np.uint8)
    keep = ~WHITE[raw]
    starts = keep.copy()
    starts[1:] &= ~keep[:-1]
    data, ends = raw[keep], np.cumsum([len(t) + 1 for t in texts])
    offsets = np.append(np.flatnonzero(starts[keep]), len(data)).astype(np.int32)
    runs = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data))
    return runs, np.diff(np.searchsorted(np.flatnonzero(starts), ends), prepend=0)


def pieces_of(text: bytes) -> Iterator[bytes]:
    """A text cut at white space into pieces of ``SLICE`` bytes and the rest of a run."""
    at = 0
    while at < len(text):
        gap = GAP.search(text, min(at + SLICE, len(text)))
        stop = gap.start() if gap else len(text)
        yield text[at:stop]
        at = stop


class Coded:
    """Tokens of texts, and their ids and decoded strings as slices of one buffer each."""

    def __init__(self, tokens: np.ndarray, ids, decoded):
        self.tokens, self.ids, self.decoded = tokens, ids, decoded

    def of(self, i: int) -> tuple[int, memoryview, memoryview]:
        return int(self.tokens[i]), *[data[bounds[i] : bounds[i + 1]] for data, bounds in (self.ids, self.decoded)]


class WordCoder:
    """Ids and decoded strings of runs of text, each distinct run once while it is kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or file["decoder"] or file["post_processor"]:
            raise ValueError("the file is no vocabulary of words with word ends")
        cutters = file["pre_tokenizer"].get("pretokenizers", [])
        if [c.get("pattern") for c in cutters] != [{"Regex": WORD_PATTERN}, None]:
            raise ValueError("another word pattern")
        own = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = own.normalizer, own.pre_tokenizer
        self.trie = PrefixTrie(Merges(model["vocab"], model["merges"], model["end_of_word_suffix"]))
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        if any(GAP.search(t.encode()) for t in self.special) or any(t[k] for t in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens that depend on their surroundings")
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.names = {i: t for t, i in (model["vocab"] | self.special).items()}
        self.numbers = {i: str(i) for i in self.names}
        # (tokens, ids as text, decoded text) of words and of runs
        self.by_word: dict[str | int, tuple[int, str, str]] = {}
        self.known: dict[str, tuple[int, str, str]] = {}

    def words(self, run: str) -> list[str | int]:
        """The words of a run, and the ids of special strings in it.

        Runs of ASCII signs and Latin-1 letters are in normal form, and the file's word pattern
        needs no Unicode tables there; all others go through the library.
        """
        if run.isascii() and run.isalpha():
            return [run.lower()]
        if PLAIN.fullmatch(run) and "<" not in run:
            found = PLAIN_WORD.findall(run.lower())
            return found if run.isascii() else [w.encode().decode("latin-1").translate(BYTE_LETTERS) for w in found]
        parts = self.cut.split(run) if self.cut and "<" in run else [run]
        found: list[str | int] = []
        for i, part in enumerate(parts):
            if i % 2:
                found.append(self.special[part])
            elif part:
                found += [w for w, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(part))]
        return found

    def entry(self, ids: list[int]) -> tuple[int, str, str]:
        names, numbers = self.names, self.numbers
        return len(ids), " ".join([numbers[i] for i in ids]) + " ", " ".join([names[i] for i in ids]) + " "

    def learn(self, runs: set[str]) -> dict[str, tuple[int, str, str]]:
        """(tokens, ids as text, decoded text) of new runs; a space follows each token's."""
        coded = self.by_word
        collecting = gc.isenabled()
        gc.disable()  # many small objects, no cycles
        try:
            cut = [(run, self.words(run)) for run in runs]
            new = {w for _, own in cut for w in own}
            if len(coded) + len(new) > KEPT_RUNS:
                coded.clear()
            new.difference_update(coded)
            for w in [w for w in new if type(w) is int]:
                new.remove(w)
                coded[w] = self.entry([w])
            for w, ids in self.trie.encode_sorted(sorted(new)):
                coded[w] = self.entry(ids)
            out = {}
            for run, own in cut:
                if len(own) == 1:
                    out[run] = coded[own[0]]
                else:
                    parts = [coded[w] for w in own]
                    out[run] = sum([x[0] for x in parts]), "".join([x[1] for x in parts]), "".join([x[2] for x in parts])
            return out
        finally:
            if collecting:
                gc.enable()

    def decode(self, ids) -> str:
        """The tokens' strings, one space between them; unknown ids have none."""
        return " ".join([self.names[i] for i in ids if i in self.names])

    def meet(self, runs: list[str]) -> list[tuple[int, str, str]]:
        """Entries of distinct runs, learned where they are new."""
        missing = {run for run in runs if run not in self.known}
        if missing:
            if len(self.known) + len(missing) > KEPT_RUNS:
                self.known.clear()
                missing = set(runs)
            self.known |= self.learn(missing)
        return [self.known[run] for run in runs]

    def code(self, texts: list[bytes]) -> Coded:
        """All texts, their distinct runs once."""
        runs, counts = runs_of(texts)
        coded = runs.dictionary_encode()
        entries = self.meet(coded.dictionary.to_pylist())
        n = np.array([x[0] for x in entries], np.int64)[coded.indices.to_numpy()]
        reach = np.append(0, np.cumsum(counts))
        tokens = np.diff(np.append(0, np.cumsum(n))[reach])
        joined = [pa.array([x[k] for x in entries], pa.large_string()).take(coded.indices) for k in (1, 2)]
        return Coded(tokens, *[(memoryview(x.buffers()[2] or b""), np.frombuffer(x.buffers()[1], np.int64)[reach]) for x in joined])

    def parts(self, texts: list[str | None]) -> Iterator[Iterator[tuple[int, memoryview, memoryview]]]:
        """For each text (tokens, ids as text, decoded text), the texts with one space at their end;
        a long text gives several, cut at white space."""
        for part in by_bytes(texts, SLICE):
            # only the last text of a part can be a long one
            own = [(t or "").encode() for t in texts[part]]
            long = own.pop() if len(own[-1]) > SLICE else None
            found = self.code(own)
            for i in range(len(own)):
                yield iter([found.of(i)])
            if long is not None:
                yield (self.code([piece]).of(0) for piece in pieces_of(long))

    def ids(self, texts: list[str | None]) -> Iterator[list[int]]:
        for parts in self.parts(texts):
            yield [int(i) for _, numbers, _ in parts for i in bytes(numbers).split()]

    def digests(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """(tokens, SHA-256 of the ids as text, SHA-256 of the decoded text)."""
        for parts in self.parts(texts):
            n, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()
            for tokens, numbers, names in parts:
                if tokens:
                    if n:
                        ids.update(b" "), decoded.update(b" ")
                    n += tokens
                    ids.update(numbers[:-1]), decoded.update(names[:-1])
            yield n, ids.hexdigest(), decoded.hexdigest()


def coder(path: str) -> WordCoder:
    """One coder for each Python worker."""
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path]


def encode(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """All columns of ``docs`` and ``ids``, the token ids of each text.

    Null and empty texts have no ids. An input column of that name is replaced; other columns never
    reach Python. Special strings in a text are their special ids, as the library has it.
    """
    path = tokenizer or default_tokenizer()

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = coder(path)
        for texts in batches:
            yield pd.Series(list(own.ids(texts.tolist())), dtype=object)

    return docs.withColumn("ids", ids(text_col))


def decode(rows: DataFrame, ids_col: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """All columns and ``decoded``: the tokens' strings, one space between them, special ones too.

    Null and empty lists give the empty text, ids that the vocabulary lacks are passed over.
    """
    path = tokenizer or default_tokenizer()

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = coder(path)
        for lists in batches:
            yield pd.Series([own.decode([] if x is None else x) for x in lists.tolist()], dtype=object)

    return rows.withColumn("decoded", decoded(ids_col))


def round_trip(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """All columns of ``docs`` and (n_tokens, ids_sha256, decoded_sha256), without storing ids.

    The digests are those of what ``encode`` and ``decode`` give: of the decimal ids with one space
    between them and of the decoded text. Texts are read in slices of bounded size. Null counts as
    the empty text, rows that repeat are coded each; input columns of the new names are replaced.
    """
    path = tokenizer or default_tokenizer()
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]

    @F.pandas_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def digests(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(list(coder(path).digests(texts.tolist())), columns=names).astype({"n_tokens": "int64"})

    free = next(f"_coded{i or ''}" for i in range(len(docs.columns) + 1) if f"_coded{i or ''}" not in docs.columns)
    out = docs.drop(*names).withColumn(free, digests(text_col))
    return out.select(*[c for c in docs.columns if c not in names], *[F.col(free)[n].alias(n) for n in names])
