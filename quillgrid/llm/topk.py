"""Operator 7: exact top-k by inner product with norm-bucketed retrieval.

Vectors become whole numbers, floor(256 x). They are ordered by dimension and falling length and cut
into buckets of at most BUCKET vectors, queries into blocks of at most BLOCK. First every query meets the
longest bucket of its dimension, which gives it a score that k rows reach. Then a query and a bucket
have a local cosine threshold: that score over the product of the query's and the bucket's greatest
length. Above 1 the bucket is passed over; where the threshold leaves a narrow range in the query's
largest coordinate, only vectors in that range are verified (coordinate pruning), else those long
enough (length pruning). Verified products are exact, and each pair gives at most k rows, which are
ranked at the end. Buckets are numbered by falling length, so what a block meets is a range from the longest on; it
follows from one pass over the lengths of buckets and what blocks need, which are a few numbers each. A bucket is
met by the blocks of one shelf (SHELF blocks) in a task, and copied for each such task, so work is even whatever the
vectors hold; equal vectors spread over buckets like others.

Defined results: a vector that is null, empty or has a null or non-finite component takes no part, nor
does a row with a null vec_id; only vectors of one dimension meet; the query's own row is left out, but
other rows with its vec_id are not; a table without such rows gives none. Extra columns are ignored. Components may have
any size: products are exact whole numbers, in 64-bit arithmetic where it is exact and in Python's else, and ranks follow
them up to a size of 2**126. A score of 2**63 or more in size, which a long cannot hold, is told as the nearest long.
A double whose 256-fold overflows counts as non-finite.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

BUCKET = 4096
BLOCK = 256
SHELF = 64
K = 5
#: Coordinate pruning is used where its range holds less than this share of the vectors.
NARROW = 0.1
#: Above this product of lengths float64 sums of products may be inexact.
EXACT = 2.0**52


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(uid, vec_id, dim, norm, cells) of the rows that take part; cells holds whole doubles, which have any size exactly."""

    def run(batches):
        uid = TaskContext.get().partitionId() << 33
        for part in batches:
            out = []
            for key, v in zip(part.column(id_col).to_pylist(), part.column(vec_col)):
                v = v.values if v.is_valid else None
                if key is not None and v is not None and len(v) and not v.null_count:
                    with np.errstate(over="ignore", invalid="ignore"):
                        x = np.floor(256 * v.to_numpy().astype(np.float64))
                    if np.isfinite(x).all():
                        out.append((uid, key, len(x), length(x), x.tobytes()))
                uid += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["uid", "vec_id", "dim", "norm", "cells"])

    return vectors.select(F.col(id_col).cast("bigint").alias(id_col), vec_col).mapInArrow(run, "uid bigint, vec_id bigint, dim bigint, norm double, cells binary")


def length(x: np.ndarray) -> float:
    """The Euclidean length, also where the squares overflow; at most the greatest double."""
    most = float(np.abs(x).max())
    if most < 1e150:
        return float(np.sqrt(x @ x))
    return min(most * float(np.sqrt((x / most) @ (x / most))), np.finfo(np.float64).max)


_BLOCKS = "no bigint, dim bigint, longest double, uids binary, ids binary, norms binary, cells binary"


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows in range order as blocks of at most size vectors of one dimension."""

    def run(batches):
        no = TaskContext.get().partitionId() << 24
        held, dim = [], None

        def out():
            nonlocal no, held
            pack = lambda i, kind: np.array([r[i] for r in held], dtype=kind).tobytes()
            row = [[no], [dim], [max(r[2] for r in held)], [pack(0, np.int64)], [pack(1, np.int64)], [pack(2, np.float64)], [b"".join(r[3] for r in held)]]
            no, held = no + 1, []
            return pa.RecordBatch.from_arrays([pa.array(c) for c in row], [f.split()[0] for f in _BLOCKS.split(", ")])

        for part in batches:
            for uid, key, d, norm, cells in zip(*(part.column(c).to_pylist() for c in ("uid", "vec_id", "dim", "norm", "cells"))):
                if held and (d != dim or len(held) >= size):
                    yield out()
                dim = d
                held.append((uid, key, norm, cells))
        if held:
            yield out()

    return rows.mapInArrow(run, _BLOCKS)


class Side:
    """A block or bucket in memory, by falling length."""

    def __init__(self, row: dict):
        self.uids, self.ids, norms = (np.frombuffer(row[c], dtype=t) for c, t in (("uids", np.int64), ("ids", np.int64), ("norms", np.float64)))
        order = np.argsort(-norms, kind="stable")
        self.uids, self.ids, self.norms = self.uids[order], self.ids[order], norms[order]
        self.cells = np.frombuffer(row["cells"], dtype=np.float64).reshape(len(norms), -1)[order]
        self.sorted: dict[int, tuple] = {}

    def coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """The unit vectors' coordinate f in rising order, and whose it is."""
        if f not in self.sorted:
            x = self.cells[:, f] / np.maximum(self.norms, 1e-300)
            order = np.argsort(x)
            self.sorted[f] = x[order], order
        return self.sorted[f]


#: Below this product of lengths whole products fit 64 bits.
LONG = 2.0**62
_MASK = (1 << 63) - 1
_MOST = (1 << 126) - 1


def products(q: np.ndarray, p: np.ndarray, bound: float) -> np.ndarray:
    """Exact products of whole vectors: doubles, 64-bit numbers or Python's, by the greatest product of two lengths."""
    if bound < EXACT:
        return q @ p.T
    whole = lambda x: x.astype(np.int64) if np.abs(x).max(initial=0) < LONG else np.array([[int(v) for v in r] for r in x], dtype=object).reshape(x.shape)
    if bound < LONG and max(np.abs(q).max(initial=0), np.abs(p).max(initial=0)) < LONG:
        return whole(q) @ whole(p).T
    return whole(q).astype(object) @ whole(p).astype(object).T


def halves(score) -> tuple[int, int]:
    """The score as two numbers of 63 bits, the lower not negative; beyond 2**126 the greatest of them."""
    score = max(-_MOST, min(_MOST, int(score)))
    return score >> 63, score & _MASK


def search(queries: Side, bucket: Side, least: np.ndarray, k: int):
    """Yield (query, candidates, scores): at most k of the bucket's best for each query, none below least[query]."""
    longest = bucket.norms[0] if len(bucket.norms) else 0.0
    with np.errstate(over="ignore"):
        bound = queries.norms * longest
        most = float(queries.norms.max(initial=0) * longest)
    slack = 1e-6 * bound + 1e-6
    live = np.flatnonzero(~(bound < least - slack))
    plain = []
    chosen: dict[int, np.ndarray] = {}
    for i in live:
        t = (least[i] - slack[i]) / bound[i] if 0 < bound[i] < np.inf else -1.0
        if 0 < t <= 1:
            f = int(np.argmax(np.abs(queries.cells[i])))
            u = queries.cells[i, f] / queries.norms[i]
            width = np.sqrt(max(0.0, 1 - t * t)) * np.sqrt(max(0.0, 1 - u * u))
            x, order = bucket.coordinate(f)
            # a cosine of at least t keeps the angles to the axis within acos(t) of each other
            low = u * t - width if u > -t else -np.inf
            high = u * t + width if u < t else np.inf
            a, b = np.searchsorted(x, low - 1e-9), np.searchsorted(x, high + 1e-9, side="right")
            if b - a < NARROW * len(x):
                chosen[i] = order[a:b]
                continue
        plain.append(i)
    for i, some in chosen.items():
        if len(some):
            yield from _best(queries, i, bucket, some, products(queries.cells[i : i + 1], bucket.cells[some], most)[0], least[i], k)
    if plain:
        all_of = lambda i: not np.isfinite(least[i]) or least[i] <= 0 or not queries.norms[i] or not np.isfinite(slack[i])
        reach = [len(bucket.norms) if all_of(i) else int(np.searchsorted(-bucket.norms, -(least[i] - slack[i]) / queries.norms[i], side="right")) for i in plain]
        scores = products(queries.cells[plain], bucket.cells[: max(reach)], most)
        for j, i in enumerate(plain):
            if reach[j]:
                yield from _best(queries, i, bucket, np.arange(reach[j]), scores[j, : reach[j]], least[i], k)


def _best(queries: Side, i: int, bucket: Side, some: np.ndarray, scores: np.ndarray, least: float, k: int):
    other = bucket.uids[some] != queries.uids[i]
    some, scores = some[other], scores[other]
    if scores.dtype == object:  # sorted by Python's numbers; least is a double, so it is used with its rounding
        order = sorted(range(len(some)), key=lambda j: (-scores[j], bucket.ids[some[j]], bucket.uids[some[j]]))[:k]
        some, scores = some[order], scores[order]
    else:
        if len(scores) > k:
            least = max(least - abs(least) * 1e-15, np.partition(scores, len(scores) - k)[len(scores) - k])
        keep = scores >= least - abs(least) * 1e-15
        some, scores = some[keep], scores[keep]
        order = np.lexsort((bucket.uids[some], bucket.ids[some], -scores))[:k]
        some, scores = some[order], scores[order]
    if len(some):
        yield i, some, scores


#: A score is high * 2**63 + low.
_FOUND = "query_uid bigint, query_id bigint, uid bigint, vec_id bigint, high bigint, low bigint"


def meet(pairs: DataFrame, buckets: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The best of each bucket for the blocks of each (dim, bucket, shelf) in pairs; queries hold least scores."""
    right = pairs.join(buckets.withColumnRenamed("no", "bucket"), ["dim", "bucket"]).withColumn("kind", F.lit(0))
    left = pairs.join(queries.withColumn("shelf", _shelf("no")), ["dim", "shelf"]).withColumn("kind", F.lit(1))
    names = ["bucket", "shelf", "kind", "uids", "ids", "norms", "cells", "least"]
    rows = right.select(names).union(left.select(names))

    def run(batches):
        bucket = None
        for part in batches:
            for n in range(part.num_rows):
                row = part.slice(n, 1).to_pylist()[0]
                if row["kind"] == 0:
                    bucket = Side(row)
                    continue
                block = Side(row)
                norms = np.frombuffer(row["norms"], dtype=np.float64)
                least = np.full(len(norms), -np.inf) if row["least"] is None else np.frombuffer(row["least"], dtype=np.float64)[np.argsort(-norms, kind="stable")]
                out = [(int(block.uids[i]), int(block.ids[i]), int(bucket.uids[j]), int(bucket.ids[j]), *halves(s)) for i, some, scores in search(block, bucket, least, k) for j, s in zip(some, scores)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], [f.split()[0] for f in _FOUND.split(", ")])

    return rows.repartition("bucket", "shelf").sortWithinPartitions("bucket", "shelf", "kind").mapInArrow(run, _FOUND)


def _shelf(block: str):
    """SHELF blocks of neighbouring lengths; a shelf may hold more than one dimension."""
    return F.floor(F.col(block) / SHELF)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    over = Window.partitionBy("query_uid").orderBy(F.desc("high"), F.desc("low"), "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k)


def met_pairs(needs: DataFrame, buckets: DataFrame) -> DataFrame:
    """(dim, bucket, shelf): the buckets from the longest of the shelf's dimension down to the length that its blocks need.

    Needs (shelf, dim, need) and buckets are put in one order of length; the buckets before a shelf are counted there.
    """
    over = Window.partitionBy("dim").orderBy(F.desc("length"), "kind", "no")
    own = buckets.select("dim", F.col("longest").alias("length"), F.lit(0).alias("kind"), "no")
    ask = needs.select("dim", ((F.col("need") - 1e-6) / (1 + 1e-6)).alias("length"), F.lit(1).alias("kind"), F.col("shelf").alias("no"))
    run = own.union(ask).withColumn("n", F.count_if(F.col("kind") == 0).over(over))
    run = stage(run, "lengths")
    numbered = run.where("kind = 0").select("dim", F.col("n").alias("at"), F.col("no").alias("bucket"))
    met = run.where("kind = 1 and n > 0").select("dim", F.col("no").alias("shelf"), F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("at"))
    return met.join(numbered, ["dim", "at"]).select("dim", "bucket", "shelf")


def top_k(vectors: DataFrame, k: int = K, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows for each query row, whose id is divisible by `every`."""
    rows = stage(whole_vectors(vectors, id_col, vec_col), "vectors")
    n = rows.count()
    keys = ["dim", F.desc("norm"), "vec_id", "uid"]
    ordered = rows.repartitionByRange(max(1, -(-n // BUCKET)), *keys).sortWithinPartitions(*keys)
    buckets = stage(blocks(ordered, BUCKET), "buckets").withColumn("least", F.lit(None).cast("binary"))
    asked = rows.where(F.col("vec_id") % every == 0)
    parts = max(1, -(-asked.count() // (4 * BLOCK)))
    queries = stage(blocks(asked.repartitionByRange(parts, *keys).sortWithinPartitions(*keys), BLOCK), "queries")
    unknown = queries.withColumn("least", F.lit(None).cast("binary"))
    first = buckets.groupBy("dim").agg(F.max(F.struct("longest", (-F.col("no")).alias("no"))).alias("x")).select("dim", (-F.col("x.no")).alias("bucket"))
    shelves = queries.withColumn("shelf", _shelf("no")).select("dim", "shelf").distinct()
    seeds = _ranked(meet(shelves.join(first, "dim").select("dim", "bucket", "shelf"), buckets, unknown, k), k).where(F.col("rank") == k)
    seeds = seeds.select("query_uid", (F.col("high").cast("double") * 2.0**63 + F.col("low")).alias("least"))
    # the least score of each query, put beside its block in the block's order
    order = queries.select("no", "uids").mapInArrow(_uids, "no bigint, at bigint, query_uid bigint")
    least = order.join(seeds, "query_uid", "left").groupBy("no").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("least", F.lit(float("-inf"))).alias("least")))).alias("x"))
    known = stage(queries.join(least, "no").withColumn("least", F.col("x.least")).drop("x").mapInArrow(_packed, _BLOCKS + ", least binary, need double"), "queries")
    # a shelf and a bucket meet unless even the shelf's loosest query cannot reach its least score there
    needs = known.withColumn("shelf", _shelf("no")).groupBy("dim", "shelf").agg(F.min("need").alias("need"))
    found = meet(met_pairs(needs, buckets), buckets, known.drop("need"), k)
    told = F.when(F.col("high") == 0, F.col("low")).when(F.col("high") == -1, F.col("low") + F.lit(-(2**63)))
    told = told.otherwise(F.when(F.col("high") > 0, F.lit(2**63 - 1)).otherwise(F.lit(-(2**63))))
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", told.alias("score"))


def _uids(batches):
    for part in batches:
        for no, uids in zip(part.column("no").to_pylist(), part.column("uids").to_pylist()):
            uids = np.frombuffer(uids, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(uids), no)), pa.array(np.arange(len(uids))), pa.array(uids)], ["no", "at", "query_uid"])


def _packed(batches):
    """Least scores as bytes, and the least candidate length that any query of the block needs."""
    names = [f.split()[0] for f in _BLOCKS.split(", ")]
    for part in batches:
        least = [np.array(x, dtype=np.float64) for x in part.column("least").to_pylist()]
        norms = [np.frombuffer(x, dtype=np.float64) for x in part.column("norms").to_pylist()]
        need = [float(np.min(np.where((s > 0) & (n > 0) & np.isfinite(s), s / np.maximum(n, 1e-300), 0.0))) for s, n in zip(least, norms)]
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array([x.tobytes() for x in least], pa.binary()), pa.array(need)], [*names, "least", "need"])


ORACLE_SQL = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r AS qr, q.vec_id AS query_id, e.r, e.vec_id, list_dot_product(q.v, e.v)::BIGINT AS score FROM e AS q JOIN e ON q.vec_id % 50 = 0 AND q.r <> e.r AND len(q.v) = len(e.v)),
t AS (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id, r)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 5
"""
