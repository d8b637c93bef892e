"""Token ids of whole texts from a tokenizer file, by batches of distinct pieces.

A byte-level vocabulary never joins what stands before a space to the word after it. A text may
therefore be cut in front of every space that has white space on at most one side, and the pieces
encoded alone give the ids of the whole. Each batch cuts its texts, encodes the pieces that the
task has not met yet in calls of a bounded number, and puts texts together from stored pieces. A text
of any length is thus never encoded in one call, unless it has no safe boundary at all.
"""

from __future__ import annotations

import os
import re
from itertools import repeat

import numpy as np

KEPT_PIECES = 1_000_000
CALL_PIECES = 256
SENTENCE_ENDS = (".", "!", "?", "\n")
ENDING_BYTES = [ord(x) for x in SENTENCE_ENDS]
# a space that has white space on both sides is no safe boundary
UNSAFE = re.compile(r"\s \s")
SAFE_SPACE = re.compile(r" (?=\S)")

_encoders: dict[str, PieceEncoder] = {}


def default_tokenizer() -> str:
    """Path of the public 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> PieceEncoder:
    """One encoder for each Python worker."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


class PieceEncoder:
    """Numbers every piece it meets; ids of all numbered pieces lie in one array."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        # a byte-level token has one sign for each byte
        self.token_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.token_bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str | tuple[str], int] = {}
        self.flat: list[np.ndarray] = []
        self.length: list[np.ndarray] = []
        self.closing: list[np.ndarray] = []
        self.tables = None

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def pieces(text: str) -> list[str]:
        """The text cut at safe boundaries; all but the first piece lack their leading space."""
        return text.split(" ") if not UNSAFE.search(text) else SAFE_SPACE.split(text)

    def learn(self, missing: set) -> None:
        """Numbers and encodes new pieces (with their leading space)."""
        alone, joined = [], []
        for piece in missing:
            # a tuple is a text's first piece; pieces that white space opens or ends stay apart
            (joined if type(piece) is str and piece and piece.strip() == piece else alone).append(piece)
        for begin in range(0, len(joined), CALL_PIECES):
            call = joined[begin : begin + CALL_PIECES]
            if not self._store_joined(call):
                alone += call
        for begin in range(0, len(alone), CALL_PIECES):
            call = [p[0] if type(p) is tuple else " " + p for p in alone[begin : begin + CALL_PIECES]]
            ids = self.encode(call)
            closing = np.array([p.endswith(SENTENCE_ENDS) for p in call], bool)
            self._number(alone[begin : begin + CALL_PIECES], np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids)), closing)
        self.tables = None

    def _store_joined(self, call: list[str]) -> bool:
        """Encodes pieces as one text and divides its ids by their bytes; False if they do not fit."""
        text = " " + " ".join(call)
        ids = self.encode([text])[0]
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        ends = np.append(np.flatnonzero(raw == 32)[1:], len(raw))
        reach = np.cumsum(self.token_bytes[ids])
        last = np.searchsorted(reach, ends)
        if len(ends) != len(call) or last[-1] != len(ids) - 1 or (reach[last] != ends).any():
            return False
        self._number(call, ids, np.diff(last, prepend=-1), np.isin(raw[ends - 1], ENDING_BYTES))
        return True

    def _number(self, call: list, ids: np.ndarray, length: np.ndarray, closing: np.ndarray) -> None:
        self.known.update(zip(call, range(len(self.known), len(self.known) + len(call))))
        self.flat.append(ids)
        self.length.append(length)
        self.closing.append(closing)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, length, closes a sentence) of the numbered pieces."""
        if self.tables is None:
            self.flat, self.length, self.closing = ([np.concatenate(x)] for x in (self.flat, self.length, self.closing))
            length = self.length[0]
            self.tables = self.flat[0], np.cumsum(length) - length, length, self.closing[0]
        return self.tables

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(number of each piece of all texts in order, pieces of each text); null counts as empty."""
        flat: list = []
        counts = np.empty(len(texts), np.int64)
        for i, text in enumerate(texts):
            pieces = self.pieces(text or "")
            pieces[0] = (pieces[0],)
            counts[i] = len(pieces)
            flat += pieces
        if len(self.known) > KEPT_PIECES:
            self.forget()
        numbers = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        new = np.flatnonzero(numbers < 0).tolist()
        if new:
            self.learn({flat[i] for i in new})
            numbers[new] = [self.known[flat[i]] for i in new]
        return numbers, counts

    def ids_of(self, numbers: np.ndarray) -> np.ndarray:
        """Ids of pieces in order."""
        flat, start, length, _ = self.arrays()
        own = length[numbers]
        ends = np.cumsum(own)
        return flat[np.repeat(start[numbers] - (ends - own), own) + np.arange(ends[-1] if len(ends) else 0)]

    def counts_of(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text."""
        numbers, counts = self.batch(texts)
        if not len(counts):
            return counts
        return np.add.reduceat(self.arrays()[2][numbers], np.cumsum(counts) - counts)


def by_bytes(texts: list[str | None], limit: int = 4 << 20):
    """Slices of a list whose texts have about ``limit`` characters together, one text at least."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= limit:
            yield slice(begin, i + 1)
            begin, size = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))
