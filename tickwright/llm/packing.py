"""Order-preserving packing of documents into token sequences.

Each partition's documents, in their order, form token streams of about ``STREAM_TOKENS``. A
stream may be cut at document ends, at sentence ends and, dearer, at multiples of the sequence
length. Dynamic programming over these positions minimises padding plus cut penalties:

    best(j) = penalty(j) + cost of a sequence + min over i in reach of best(i) + padding(i, j)

Padding is length - (j - i), so the minimum over i is that of best(i) + i over a sliding window,
which a monotone queue keeps; lengths that are powers of two need no padding and are looked up.
No shuffle; a task holds one stream and the tokens of one batch.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickwright.llm.tokens import by_bytes, default_tokenizer, encoder

LENGTH = 1024
STREAM_TOKENS = 1 << 20
CUT_DOCUMENT, CUT_SENTENCE, CUT_ANYWHERE = 0, 2, 8
SEQUENCE_COST = 2


def padding(n: int, length: int = LENGTH) -> int:
    """Unused places of a sequence with n tokens; powers of two are stored as they are."""
    return 0 if n & (n - 1) == 0 else length - n


def cut_positions(document_ends: np.ndarray, sentence_ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted positions from 0 to the end, penalty of each)."""
    total = int(document_ends[-1])
    free = np.arange(0, total + 1, length)
    tail, at = [], int(free[-1])
    for k in reversed(range(length.bit_length() - 1)):
        if (total - at) >> k:
            at += 1 << k
            tail.append(at)
    positions = np.concatenate((document_ends, sentence_ends, free, np.array(tail, np.int64), [0]))
    cost = np.repeat([CUT_DOCUMENT, CUT_SENTENCE, CUT_ANYWHERE, 0], [len(document_ends), len(sentence_ends), len(free) + len(tail), 1])
    order = np.lexsort((cost, positions))
    positions, cost = positions[order], cost[order]
    first = np.append(True, positions[1:] != positions[:-1])
    return positions[first], cost[first]


def best_cuts(positions: np.ndarray, penalty: np.ndarray, length: int = LENGTH) -> list[int]:
    """Positions of the cheapest cuts, both ends included. Earlier starts win ties."""
    n = len(positions)
    exact: dict[int, list[int]] = {}
    # place of every position, or none
    place = np.full(int(positions[-1]) + 1, -1)
    place[positions] = np.arange(n)
    for k in range(length.bit_length() - 1):
        first = int(np.searchsorted(positions, 1 << k))
        start = place[positions[first:] - (1 << k)]
        hit = np.flatnonzero(start >= 0)
        for j, i in zip((hit + first).tolist(), start[hit].tolist()):
            exact.setdefault(j, []).append(i)
    at, fee = positions.tolist(), (penalty + SEQUENCE_COST).tolist()
    key, back = [0] * n, [0] * n  # key(i) = best(i) + position of i
    queue, head = [0], 0  # places with rising keys
    matches = exact.get
    for j in range(1, n):
        here = at[j]
        while here - at[queue[head]] > length:
            head += 1
        come = queue[head]
        cost = key[come] + length - here
        for i in matches(j, ()):
            if key[i] - at[i] < cost:
                cost, come = key[i] - at[i], i
        back[j] = come
        key[j] = new = cost + fee[j] + here
        while len(queue) > head and key[queue[-1]] > new:
            queue.pop()
        queue.append(j)
    cuts = [n - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return [at[i] for i in reversed(cuts)]


def pack_stream(ids: bytes, document_ends: np.ndarray, sentence_ends: np.ndarray, length: int = LENGTH) -> dict[str, np.ndarray]:
    """Pieces of one stream: index of the document, start, length, checksum, sequence and offset."""
    cuts = np.array(best_cuts(*cut_positions(document_ends, sentence_ends, length), length))
    edges = np.union1d(cuts, np.append(0, document_ends))
    begin, end = edges[:-1], edges[1:]
    document = np.searchsorted(document_ends, begin, "right")
    sequence = np.searchsorted(cuts, begin, "right") - 1
    view = memoryview(ids)
    return {
        "document": document,
        "start": begin - np.append(0, document_ends)[document],
        "length": end - begin,
        "ids_crc32": np.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begin.tolist(), end.tolist())], np.int64),
        "sequence": sequence,
        "offset": begin - cuts[sequence],
    }


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece.

    A document is its ids and a closing id 0, so null and empty texts are one token. Repeated rows
    are packed each; other columns are not read. Sequence numbers are unique over all partitions.
    """
    import pyarrow as pa

    path = tokenizer or default_tokenizer()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        from pyspark import TaskContext

        own = encoder(path)
        number = TaskContext.get().partitionId() << 40
        names, sizes, parts, ends = [], [], [], []
        held = 0

        def flush():
            nonlocal number, held
            document_ends = np.cumsum(np.array(sizes, np.int64))
            found = pack_stream(np.concatenate(parts).astype("<u4").tobytes(), document_ends, np.concatenate(ends), length)
            document = found["document"]
            batch = pa.RecordBatch.from_arrays(
                [pa.concat_arrays(names).take(pa.array(document)), *(pa.array(found[c].astype(np.int64)) for c in ("start", "length", "ids_crc32")), pa.array(np.array(sizes, np.int64)[document]), pa.array(number + found["sequence"].astype(np.int64)), pa.array(found["offset"].astype(np.int64))],
                ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            number += int(found["sequence"][-1]) + 1
            names.clear(), sizes.clear(), parts.clear(), ends.clear()
            held = 0
            return batch

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in by_bytes(texts, 2 << 20):
                numbers, counts = own.batch(texts[part])
                _, _, size, closing = own.arrays()
                # every document's pieces and, after them, its closing id
                after = np.cumsum(counts)
                size, closing = np.insert(size[numbers], after, 1), np.insert(closing[numbers], after, False)
                tokens = np.cumsum(size)
                document_ends = tokens[after + np.arange(len(after))]
                ends.append(held + tokens[closing])
                parts.append(np.insert(own.ids_of(numbers), document_ends - np.arange(1, len(after) + 1), 0))
                sizes += np.diff(document_ends, prepend=0).tolist()
                names.append(batch.column(0)[part])
                held += int(tokens[-1])
                if held >= STREAM_TOKENS:
                    yield flush()
        if sizes:
            yield flush()

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
