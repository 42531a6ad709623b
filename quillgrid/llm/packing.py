"""Operator 1: packing token sequences by Karmarkar-Karp multiway differencing.

A document's ids (text ids, then an end id) are cut into full windows and a rest below the window
size. The rests of each task gather in pools of bounded size. In a pool, every `fine_every`-th rest
is halved repeatedly, so that small pieces are there to level with. Differencing into k windows
starts with one partial partition a piece; the two with the largest imbalance merge, largest sums
against smallest, until one is left. k starts at the total over the capacity and rises while any
window exceeds the capacity. No key is grouped and nothing shuffled, so no group can be hot.

Defined results: a null or empty text is the end id alone; a null doc_id is packed as any other;
repeated rows are packed each; an empty table gives no rows; extra columns are ignored; a text that spells an
added token of the vocabulary has that token's id there, as the tokenizers library gives it. Tasks that
run again give the same rows, as sequence ids come from the partition and a counter.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import loaded
from .common import bounded, spread

WINDOW = 2048
POOL_PIECES = 512
FINE_EVERY = 6
FINEST = 16

SCHEMA = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Deal the indices of sizes into k windows by multiway differencing; some may be empty."""
    # A partial partition: non-empty windows as (sum, tree), sums falling; windows not listed are empty.
    spread = lambda p: p[0][0] - (p[-1][0] if len(p) == k else 0)
    heap = [(-s, i, [(s, i)]) if k > 1 else (0, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        alone = k - len(b)  # the largest windows of a that meet empty windows of b
        if len(a) <= alone:
            joined = a + b
        else:
            joined = a[:alone]
            for (x, s), (y, t) in zip(a[alone:], b[::-1]):
                joined.append((x + y, (s, t)))
            joined += b[::-1][len(a) - alone :]
        joined.sort(key=lambda w: -w[0])
        heapq.heappush(heap, (-spread(joined), serial, joined))
        serial += 1
    out = []
    for _, tree in heap[0][2] if heap else []:
        todo, own = [tree], []
        while todo:
            t = todo.pop()
            if isinstance(t, tuple):
                todo.extend(t)
            else:
                own.append(t)
        out.append(sorted(own))
    return out


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most capacity; the number rises from the least possible."""
    if not sizes:
        return []
    k = -(-sum(sizes) // capacity)
    while True:
        dealt = difference(sizes, k)
        if max(sum(sizes[i] for i in w) for w in dealt) <= capacity:
            return dealt
        k += max(1, k // 200)


def cut(length: int, fine: bool, finest: int = FINEST) -> list[int]:
    """Lengths of the pieces of a rest: whole, or halved down to the finest."""
    out = []
    while fine and length >= 2 * finest:
        out.append(length // 2)
        length -= length // 2
    return [*out, length]


class Packer:
    """Packs documents one after another; each call may return finished rows."""

    def __init__(self, base: int, window: int = WINDOW, pool: int = POOL_PIECES):
        self.next, self.window, self.pool_size = base, window, pool
        self.pool: list[tuple] = []
        self.rests = 0

    def add(self, key, ids: np.ndarray) -> list[tuple]:
        ids = ids.astype("<u4")
        rows, n, w = [], len(ids), self.window
        full = n - n % w
        for start in range(0, full, w):
            rows.append((key, start, w, zlib.crc32(ids[start : start + w].tobytes()), n, self.next, 0))
            self.next += 1
        if full < n:
            at = full
            self.rests += 1
            for length in cut(n - full, self.rests % FINE_EVERY == 0):
                self.pool.append((key, at, length, zlib.crc32(ids[at : at + length].tobytes()), n))
                at += length
            if len(self.pool) >= self.pool_size:
                rows += self.flush()
        return rows

    def flush(self) -> list[tuple]:
        rows = []
        for window in windows([p[2] for p in self.pool], self.window):
            offset = 0
            for i in window:
                rows.append((*self.pool[i], self.next, offset))
                offset += self.pool[i][2]
            self.next += 1
        self.pool = []
        return rows


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, window: int = WINDOW, pool: int = POOL_PIECES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, *(f.split()[0] for f in SCHEMA.split(", "))]

    def run(batches):
        coder = loaded(vocabulary)
        packer = Packer(TaskContext.get().partitionId() << 33, window, pool)
        end = np.array([end_id], dtype="<u4")

        def told(rows, key_type):
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], key_type), *(pa.array(c, pa.int64()) for c in cols[1:])], names)

        key_type = None
        for part in bounded(batches, 1000, 4_000_000, text_col):
            key_type = part.schema.field(id_col).type
            rows = []
            for key, ids in zip(part.column(id_col).to_pylist(), coder.encode(part.column(text_col).to_pylist())):
                rows += packer.add(key, np.concatenate([ids, end]))
            if rows:
                yield told(rows, key_type)
        if packer.pool:
            yield told(packer.flush(), key_type)

    return spread(docs.select(id_col, text_col)).mapInArrow(run, f"{id_col} {kind}, {SCHEMA}")
