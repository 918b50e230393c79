"""Cost-balanced packing of documents into training sequences.

A document's cost is linear in its tokens plus quadratic in each piece's length (attention within the piece). Its
whole sequences of `capacity` tokens are cut off first; these are full and have the greatest cost there is. What is
left goes to a pool. A pool opens as many sequences as its tokens fill and takes pieces in descending cost; each
goes to the sequence of the lowest cost so far that has room for it, and only where none has room is it cut. So a
pool's sequences are full except for the last; those of a task's end are shortened to powers of two, which need no
padding.

Pools are local to a task and hold at most `pool` remainders, so memory is bounded, nothing is shuffled and a task
that runs again packs alike. Ids of sequences hold the task's partition above and a counter below.

Token ids are those of the `tokenizers` library for the vocabulary file; they are made by a faster encoder of the
same vocabulary and pattern where a text has none of its special tokens (tests hold both against each other).

Defined cases: a null text is empty and has the end token alone; texts of any length are cut into pieces; repeated
rows are packed each; an empty table gives no sequences; extra columns are not read."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

CAPACITY = 1024
POOL = 4096
END_ID = 0
#: Cost of a token, and of a pair of tokens within a piece.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"
_NAMES = [part.strip().split()[0] for part in SCHEMA.split(",")]


@cache
def encoder(vocabulary: str):
    """text -> uint32 array. vocabulary: a tokenizers JSON file of byte-level BPE, by path or by name."""
    import json

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    slow = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = [t["content"] for t in spec.get("added_tokens", [])]
    letters = {c: b for b, c in _byte_letters().items()}
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding(name="bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return encode


def _byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(others)}


def piece_cost(length: int) -> float:
    return LINEAR * length + QUADRATIC * length * length


def pack_pool(lengths: list[int], capacity: int) -> tuple[list[list[tuple[int, int, int]]], list[int]]:
    """Sequences of (document index, start, length), each at most capacity long, and their lengths.

    Lengths are the documents' tokens. Sequences are opened for all tokens; the last has what doesn't fill one."""
    total = sum(lengths)
    n = -(-total // capacity)
    room = [capacity] * n
    if total % capacity:
        room[-1] = total % capacity
    size, none = 1 << capacity.bit_length(), (math.inf, -1)
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(size)]  # (cost, sequence) by room; full ones leave
    least = [none] * (2 * size)  # a tree over the rooms with the cheapest of each part

    def changed(r: int) -> None:
        i = r + size
        least[i] = heaps[r][0] if heaps[r] else none
        while i > 1:
            i >>= 1
            least[i] = min(least[2 * i], least[2 * i + 1])

    for s, r in enumerate(room):
        heaps[r].append((0.0, s))  # in order, so a heap
    for r in set(room):
        changed(r)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    for k in sorted(range(len(lengths)), key=lambda i: (-piece_cost(lengths[i]), i)):
        start, left = 0, lengths[k]
        while left:
            found, i = none, left + size
            if left <= capacity:  # the cheapest with room for all of it
                found = least[i]
                while i > 1:
                    if not i & 1:
                        found = min(found, least[i + 1])
                    i >>= 1
            if found is none:  # else the roomiest takes a part
                i = 1
                while i < size:
                    i = 2 * i + (least[2 * i + 1] is not none)
                found = least[i]
            cost, s = found
            heappop(heaps[room[s]])
            changed(room[s])
            part = min(left, room[s])
            out[s].append((k, start, part))
            room[s] -= part
            start, left = start + part, left - part
            if room[s]:
                heappush(heaps[room[s]], (cost + piece_cost(part), s))
                changed(room[s])
    return out, [sum(x[2] for x in s) for s in out]


def powers(length: int) -> list[int]:
    """The powers of two that a length is the sum of, large first."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


def _cut_short(pieces: list[tuple[int, int, int]], length: int) -> Iterator[list[tuple[int, int, int]]]:
    """One short sequence as sequences whose lengths are powers of two."""
    rest = list(pieces)
    for size in powers(length):
        part = []
        while size:
            k, start, n = rest.pop(0)
            take = min(n, size)
            part.append((k, start, take))
            size -= take
            if take < n:
                rest.insert(0, (k, start + take, n - take))
        yield part


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", capacity: int = CAPACITY, pool: int = POOL, with_ids: bool = False) -> DataFrame:
    """One row a piece. with_ids adds the token ids (array<int>), for writing sequences."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    crc = zlib.crc32

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        counter = TaskContext.get().partitionId() << 40
        held: list[tuple[int | None, int, int, np.ndarray]] = []  # id, start in the document, the document's tokens, ids
        out: dict[str, list] = {}

        def clear() -> None:
            out.update({name: [] for name in [*_NAMES, *["ids"] * with_ids]})

        def put(doc, start, ids, total, sequence, offset) -> None:
            row = (doc, start, len(ids), crc(ids.astype("<u4").tobytes()), total, sequence, offset, piece_cost(len(ids)))
            for name, value in zip(_NAMES, row, strict=True):
                out[name].append(value)
            if with_ids:
                out["ids"].append(ids.astype(np.int32))

        def flush(last: bool) -> None:
            nonlocal counter
            sequences, sizes = pack_pool([len(x[3]) for x in held], capacity)
            keep = []
            for pieces, size in zip(sequences, sizes, strict=True):
                if size < capacity and not last:  # goes on to the next pool
                    keep += [(held[k][0], held[k][1] + a, held[k][2], held[k][3][a : a + n]) for k, a, n in pieces]
                    continue
                for part in [pieces] if size == capacity else _cut_short(pieces, size):
                    offset = 0
                    for k, a, n in part:
                        doc, start, total, ids = held[k]
                        put(doc, start + a, ids[a : a + n], total, counter, offset)
                        offset += n
                    counter += 1
            held[:] = keep

        clear()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID))
                whole = len(ids) // capacity * capacity
                for a in range(0, whole, capacity):
                    put(doc, a, ids[a : a + capacity], len(ids), counter, 0)
                    counter += 1
                if whole < len(ids):
                    held.append((doc, whole, len(ids), ids[whole:]))
                if len(held) >= pool:
                    flush(False)
                if len(out["doc_id"]) >= 4096:
                    yield pa.RecordBatch.from_pydict(out, schema=schema)
                    clear()
        flush(True)
        if out["doc_id"]:
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema([(name, pa.float64() if name == "cost" else pa.int64()) for name in _NAMES] + [("ids", pa.list_(pa.int32()))] * with_ids)
    return rows.mapInArrow(task, SCHEMA + ", ids array<int>" * with_ids)
