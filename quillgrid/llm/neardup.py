"""Operator 10: near-duplicate classes by MinHash signatures and a multi-index Hamming join.

A document's set holds its distinct shingles of five words (A-Z lower-cased). Documents with equal sets
are one class and count once from there on. A class has a signature of SLOTS min-hashes of BITS bits; two
sets of similarity J agree in about J of the slots.

Index. The slots form CHUNKS chunks of CHUNK slots. If two signatures differ in fewer than 2 * CHUNKS
slots, some chunk differs in at most one (pigeonhole), so each class is entered under every chunk with
each one slot left out. So all pairs up to the signature-distance threshold REACH = 2 * CHUNKS - 1 = 39 meet under a key;
at J = 0.75 the distance is 25 in the mean with a deviation of 4.3, and 0.0007 of such pairs lie beyond. These are not
given up: what meets under a key up to a distance of FAR is held against the full sets, which decides. At J = 0.75 a
pair lies beyond FAR with a chance of 2e-8, and meets under no key at all with a chance of 2e-9.

Work on groups. Equal sets meet in one class, so exact copies cost nothing further. Within the classes
of a key, first only each one's pair with the key's least class is tried. The components of the links
found leave as open only pairs of different components. These are all tried, in tiles of bounded size:
first by signature, each pair under the first key it shares, then by full sets, which only the classes
that still have a candidate bring along; a tile is bounded in rows and in members of its sets. A tile gives back links, not pairs. A key may hold any number
of classes; none is dropped. What is read twice is written to the shared folder first.

Defined results: without words the set is empty and the row is linked with nothing (component_id is
its doc_id); with fewer than five words the whole sequence is the set's one member. A row with a null
doc_id takes no part: component_id null, kept true. Repeated rows are exact copies; rows that share a
doc_id but not a text each follow their own text. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import bounded, mix, own_names, spread, stage, unstage
from .components import components

SHINGLE = 5
SIMILARITY = 75  # of 100
CHUNKS, CHUNK = 20, 5
SLOTS = CHUNKS * CHUNK
#: Signatures that differ in so many slots meet for certain.
REACH = 2 * CHUNKS - 1
#: Pairs beyond this distance are not held against the full sets.
FAR = 50
BITS = 12
TILE = 1024
#: Members of the sets of one block of a tile.
MEMBERS = 2_000_000
#: Bits of the filter through which texts pass before their sets are taken, and nodes up to which it is used.
FILTER_BITS = 1 << 22
FILTER_NODES = FILTER_BITS // 4

_rng = np.random.default_rng(20_240)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TURN = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = _rng.integers(0, 2**31, SLOTS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _rng.integers(0, 2**32, SLOTS, dtype=np.uint32)
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


def shingle_sets(texts: list[str | None], k: int = SHINGLE) -> list[np.ndarray]:
    """Each text's set as sorted 64-bit hashes of its shingles of k words."""
    raw = b" ".join([b"", *((t or "").encode("utf-8", "surrogatepass").lower() for t in texts), b""])
    sizes = np.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], dtype=np.int64)
    begins = 1 + np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64) if texts else np.zeros(0, np.int64)
    if not texts:
        return []
    byte = np.frombuffer(raw, dtype=np.uint8)
    is_word = _IS_WORD[byte]
    edge = np.flatnonzero(is_word[1:] != is_word[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    power = np.full(len(byte), _STEP, dtype=np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    sums = np.cumsum(_BYTE[byte] * power, dtype=np.uint64)
    power = np.full(len(byte), _BACK, dtype=np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    word = mix((sums[ends - 1] - sums[starts - 1]) * power[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, begins)
    last = np.append(first[1:], len(starts))
    n = len(word)
    if n >= k:
        all_of = np.zeros(n - k + 1, dtype=np.uint64)
        for j in range(k):
            all_of += word[j : n - k + 1 + j] * _TURN[j % SHINGLE] * np.uint64(1 + 2 * (j // SHINGLE))
        all_of = mix(all_of)
    out = []
    for a, b in zip(first.tolist(), last.tolist()):
        if b - a >= k:
            out.append(np.unique(all_of[a : b - k + 1]))
        elif b > a:
            few = sum((int(w) * int(_TURN[j % SHINGLE]) for j, w in enumerate(word[a:b])), start=b - a)
            out.append(mix(np.array([few & (2**64 - 1)], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def signature(members: np.ndarray) -> bytes:
    """The min-hashes of a set that is not empty, two bytes each."""
    x = (members ^ (members >> np.uint64(32))).astype(np.uint32)
    least = np.full(SLOTS, 0xFFFFFFFF, dtype=np.uint32)
    for lo in range(0, len(x), 4096):
        np.minimum(least, (x[lo : lo + 4096, None] * _MULT + _PLUS).min(axis=0), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype("<u2").tobytes()


def digests(members: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a set, as signed numbers; 0 for the empty set."""
    salts = (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F))
    return tuple(int(mix(members ^ s).sum(dtype=np.uint64).astype(np.int64)) for s in salts)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, two 64-bit digests of the set, signature; null for an empty set) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for part in bounded(batches, 2000, 2_000_000, text_col):
            n, one, two, sig = [], [], [], []
            for s in shingle_sets(part.column(text_col).to_pylist()):
                n.append(len(s))
                for own, digest in zip((one, two), digests(s)):
                    own.append(digest)
                sig.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sig, pa.binary())], [id_col, "n_shingles", "h1", "h2", "sig"])

    return spread(docs.select(id_col, text_col)).mapInArrow(run, f"{id_col} {kind}, n_shingles bigint, h1 bigint, h2 bigint, sig binary")


def index_keys(reps: DataFrame) -> DataFrame:
    """(key, node): each chunk with each one slot left out; the key holds the other slots, its chunk and the slot."""

    def run(batches):
        keep = np.array([[j for j in range(CHUNK) if j != out] for out in range(CHUNK)])
        shift = (np.arange(CHUNK - 1, dtype=np.uint64) * np.uint64(BITS))
        which = (np.arange(SLOTS, dtype=np.uint64) << np.uint64(BITS * (CHUNK - 1))).reshape(CHUNKS, CHUNK)
        for part in batches:
            node = part.column("node").to_numpy()
            for lo in range(0, len(node), 500):
                own = part.column("sig").slice(lo, 500)
                sig = np.frombuffer(b"".join(own.to_pylist()), dtype="<u2").reshape(-1, CHUNKS, CHUNK).astype(np.uint64)
                keys = (sig[:, :, keep] << shift).sum(axis=3, dtype=np.uint64) + which
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().astype(np.int64)), pa.array(np.repeat(node[lo : lo + 500], SLOTS))], ["key", "node"])

    return reps.select("node", "sig").mapInArrow(run, "key bigint, node bigint")


def meetings(keys: DataFrame) -> DataFrame:
    """(key, node, head) of the keys that several nodes share; head is the key's least node."""

    def run(batches):
        held_key = held_node = None  # a row whose run may go on
        key_now = head_now = None  # the run that the last batch ended in, if rows of it are out already
        for part in batches:
            key, node = part.column("key").to_numpy(), part.column("node").to_numpy()
            if held_key is not None:
                key, node = np.append(held_key, key), np.append(held_node, node)
                held_key = None
            if not len(key):
                continue
            fresh = np.append(True, key[1:] != key[:-1])
            if key_now is not None and key[0] == key_now:
                fresh[0] = False
            at = np.flatnonzero(fresh)
            run_of = np.cumsum(fresh) - 1
            head = np.where(run_of >= 0, node[at][run_of] if len(at) else 0, head_now if head_now is not None else 0)
            follows = ~fresh
            several = follows | np.append(follows[1:], False)
            if fresh[-1]:
                held_key, held_node = key[-1:], node[-1:]
                key_now = head_now = None
            else:
                key_now, head_now = key[-1], head[-1]
            if several.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[several]), pa.array(node[several]), pa.array(head[several])], ["key", "node", "head"])

    return keys.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "key bigint, node bigint, head bigint")


def _near(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Which signatures are near enough to be held against the full sets."""
    x, y = (np.frombuffer(b"".join(c.to_pylist()), dtype="<u2").reshape(-1, SLOTS) for c in (a, b))
    return (x != y).sum(axis=1) <= FAR


def within_reach(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures are near enough."""
    sig = reps.select("node", "sig")
    full = pairs.join(sig.select(F.col("node").alias("b"), F.col("sig").alias("y")), "b").join(sig.select(F.col("node").alias("a"), F.col("sig").alias("x")), "a")

    def run(batches):
        for part in batches:
            if part.num_rows:
                near = pa.array(_near(part.column("x"), part.column("y")))
                yield part.select(["a", "b"]).filter(near)

    return full.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def open_rows(met: DataFrame, of_component: DataFrame, reps: DataFrame) -> DataFrame:
    """(key, one, two, block, node, component, sig): nodes by tile, of the keys where components meet.

    A key with many nodes is dealt into blocks of about TILE nodes, or MEMBERS members of their sets; a tile is a pair of blocks.
    """
    rows = met.select("key", "node").join(of_component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = stage(rows.join(reps.select("node", "n_shingles"), "node"), "met")
    sums = [F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"), F.sum("n_shingles").alias("members")]
    mixed = rows.groupBy("key").agg(*sums).where("lo != hi")
    blocks = F.ceil(F.greatest(F.col("n") / TILE, F.col("members") / MEMBERS)).cast("bigint")
    rows = rows.join(mixed.select("key", blocks.alias("blocks")), "key").join(reps.select("node", "sig"), "node")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "node", "component", "sig")


_TILE = ("key", "one", "two")
_ROW = "key bigint, one bigint, two bigint, block bigint, node bigint, component bigint"


def _tiles(batches, binary: tuple[str, ...]):
    """The rows of each tile, from batches sorted by tile: a dict of arrays, and of lists for binary columns."""
    numbers = ("key", "one", "two", "block", "node", "component")
    held = None
    for part in batches:
        cols = {c: part.column(c).to_numpy() for c in numbers} | {c: part.column(c).to_pylist() for c in binary}
        if held is not None:
            cols = {c: np.append(held[c], v) if c in numbers else held[c] + v for c, v in cols.items()}
        n = len(cols["key"])
        if not n:
            continue
        fresh = np.zeros(n, dtype=bool)
        for c in _TILE:
            fresh[1:] |= cols[c][1:] != cols[c][:-1]
        edges = [0, *np.flatnonzero(fresh).tolist()]
        for a, b in zip(edges, edges[1:]):
            yield {c: v[a:b] for c, v in cols.items()}
        held = {c: v[edges[-1] :] for c, v in cols.items()}
    if held is not None:
        yield held


def candidates(tile: dict, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of a tile: of different components, within reach, and with this key as the first that they share."""
    n, comp, node, block = len(sig), tile["component"], tile["node"], tile["block"]
    within = tile["one"][0] == tile["two"][0]
    own = int(tile["key"][0]) >> (BITS * (CHUNK - 1))
    left, right = [], []
    for lo in range(0, n, 256):
        rows = slice(lo, min(n, lo + 256))
        ask = (comp[rows, None] != comp[None, :]) & (node[rows, None] != node[None, :]) & (np.arange(rows.start, rows.stop)[:, None] < np.arange(n)[None, :])
        if not within:
            ask &= block[rows, None] != block[None, :]
        i, j = np.nonzero(ask)
        for at in range(0, len(i), 200_000):
            x, y = i[at : at + 200_000] + lo, j[at : at + 200_000]
            off = (sig[x] != sig[y]).reshape(-1, CHUNKS, CHUNK)
            count = off.sum(axis=2)
            near = count <= 1
            first = near.argmax(axis=1)
            slot = off[np.arange(len(x)), first].argmax(axis=1)  # the one slot that differs, or 0
            keep = near.any(axis=1) & (first * CHUNK + slot == own) & (count.sum(axis=1) <= FAR)
            left.append(x[keep])
            right.append(y[keep])
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _sigs(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype="<u2").reshape(-1, SLOTS)


def asked_rows(rows: DataFrame) -> DataFrame:
    """The rows of tiles whose node has a candidate there; a pair is a candidate in one tile only."""
    names = [f.split()[0] for f in _ROW.split(", ")]

    def run(batches):
        out, n = [], 0
        for tile in _tiles(batches, ("sig",)):
            if len(tile["node"]) > 1:
                i, j = candidates(tile, _sigs(tile["sig"]))
                if len(i):
                    some = np.unique(np.append(i, j))
                    out.append([tile[c][some] for c in names] + [[tile["sig"][k] for k in some]])
                    n += len(some)
            if n >= 5000:
                yield told(out)
                out, n = [], 0
        if out:
            yield told(out)

    def told(out):
        cols = [pa.array(np.concatenate([o[k] for o in out])) for k in range(len(names))]
        return pa.RecordBatch.from_arrays([*cols, pa.array([s for o in out for s in o[-1]], pa.binary())], [*names, "sig"])

    return rows.repartition(*_TILE).sortWithinPartitions(*_TILE).mapInArrow(run, f"{_ROW}, sig binary")


def common_counts(members: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets i and j; in large groups by bit maps over the members that several sets have."""
    if len(i) <= 16:
        return np.array([len(np.intersect1d(members[a], members[b], assume_unique=True)) for a, b in zip(i, j)], dtype=np.int64)
    values, df = np.unique(np.concatenate(members), return_counts=True)
    shared = values[df > 1]
    width = -(-len(shared) // 64) or 1
    maps = np.zeros((len(members), width * 8), dtype=np.uint8)
    for k, m in enumerate(members):
        at = np.searchsorted(shared, m)
        at = at[(at < len(shared)) & (shared[np.minimum(at, len(shared) - 1)] == m)] if len(shared) else at[:0]
        dense = np.zeros(width * 64, dtype=np.uint8)
        dense[at] = 1
        maps[k] = np.packbits(dense)
    maps = maps.view(np.uint64)
    out = np.zeros(len(i), dtype=np.int64)
    step = max(1, 4_000_000 // width)
    for lo in range(0, len(i), step):
        out[lo : lo + step] = np.bitwise_count(maps[i[lo : lo + step]] & maps[j[lo : lo + step]]).sum(axis=1, dtype=np.int64)
    return out


def open_links(asked: DataFrame, full: DataFrame, similarity: int) -> DataFrame:
    """Links (a, b) between components, from the full sets of each tile's candidates: enough of them to join what is linked."""
    rows = asked.join(full, "node").select(*(f.split()[0] for f in _ROW.split(", ")), "sig", "members")

    def run(batches):
        for tile in _tiles(batches, ("sig", "members")):
            if len(tile["node"]) < 2:
                continue
            i, j = candidates(tile, _sigs(tile["sig"]))
            members = [np.frombuffer(m, dtype=np.uint64) for m in tile["members"]]
            size = np.array([len(m) for m in members])
            fit = 100 * np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j])
            i, j = i[fit], j[fit]
            if not len(i):
                continue
            common = common_counts(members, i, j)
            linked = (common > 0) & (100 * common >= similarity * (size[i] + size[j] - common))
            parent: dict[int, int] = {}

            def root(c):
                while parent.setdefault(c, c) != c:  # noqa: B023
                    parent[c] = parent[parent[c]]  # noqa: B023
                    c = parent[c]  # noqa: B023
                return c

            a, b = [], []
            for x, y in zip(i[linked].tolist(), j[linked].tolist()):
                p, q = root(int(tile["component"][x])), root(int(tile["component"][y]))
                if p != q:
                    parent[p] = q
                    a.append(int(tile["node"][x]))
                    b.append(int(tile["node"][y]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.repartition(*_TILE).sortWithinPartitions(*_TILE).mapInArrow(run, "a bigint, b bigint")


def _filter_words(nodes: DataFrame) -> DataFrame:
    """(word, bits): a bit map of FILTER_BITS over hashes of the nodes, less words without a bit."""
    slots = nodes.select(F.pmod(F.xxhash64("node"), F.lit(FILTER_BITS)).alias("slot"))
    return slots.selectExpr("slot div 64 as word", "shiftleft(1L, cast(slot % 64 as int)) as bit").groupBy("word").agg(F.bit_or("bit").alias("bits"))


def node_filter(nodes: DataFrame) -> np.ndarray:
    """The bit map of the nodes, of fixed size; it may hold others, so a join must follow."""
    rows = _filter_words(nodes).toArrow()
    out = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def full_sets(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, members) of the rows of docs whose id is among nodes (and, by chance, of few others).

    Up to FILTER_NODES nodes a bit map of fixed size keeps the other texts from being shuffled; more nodes are joined with the texts.
    """
    nodes = nodes.distinct()
    some = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("node"), text_col)
    bits = None
    if nodes.count() <= FILTER_NODES:
        bits = docs.sparkSession.sparkContext.broadcast(node_filter(nodes))
        some = some.withColumn("slot", F.pmod(F.xxhash64("node"), F.lit(FILTER_BITS)))
    else:
        some = some.join(nodes, "node", "left_semi")

    def sets(batches):
        for asked in batches:
            if bits is not None:
                slot = asked.column("slot").to_numpy()
                asked = asked.filter(pa.array((bits.value[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1))
            for part in bounded([asked], 2000, 2_000_000, text_col) if asked.num_rows else ():
                own = [s.tobytes() for s in shingle_sets(part.column(text_col).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(own, pa.binary())], ["node", "members"])

    return stage(some.mapInArrow(sets, "node bigint, members binary"), "sets")


def verified(pairs: DataFrame, full: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= similarity * union."""
    both = pairs.join(full.select(F.col("node").alias("b"), F.col("members").alias("y")), "b").join(full.select(F.col("node").alias("a"), F.col("members").alias("x")), "a")

    def run(batches):
        for part in batches:
            keep = []
            for x, y in zip(part.column("x"), part.column("y")):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                small, large = min(len(x), len(y)), max(len(x), len(y))
                if not small or 100 * small < similarity * large:
                    keep.append(False)
                    continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= similarity * (len(x) + len(y) - common))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint").distinct()


def classified(docs: DataFrame, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, h1, h2, component_id, kept) of every row; ids must be integers."""
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must hold integers")
    kind = docs.schema[id_col].dataType.simpleString()
    sigs = stage(signatures(docs, id_col, text_col), "signatures")
    classes = sigs.where(f"n_shingles > 0 and {id_col} is not null").groupBy("h1", "h2", "n_shingles").agg(F.min(F.col(id_col).cast("bigint")).alias("node"), F.min("sig").alias("sig"))
    classes = stage(classes, "classes")
    reps = classes.select("node", "n_shingles", "sig")
    met = stage(meetings(index_keys(reps)), "meetings")
    stars = met.where("node != head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    first = within_reach(stars, reps).groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    first = stage(first, "pairs")
    full = full_sets(first.select(F.col("a").alias("node")).union(first.select("b")), docs, id_col, text_col)
    starry = stage(verified(first, full, similarity), "links")
    of_component = stage(components(starry.toDF("u", "v")), "components")
    asked = stage(asked_rows(open_rows(met, of_component, reps)), "asked")
    for done in (full, first, met):
        unstage(done)
    full = full_sets(asked.select("node"), docs, id_col, text_col)
    links = stage(starry.union(open_links(asked, full, similarity)), "links")
    for done in (full, asked, starry, of_component):
        unstage(done)
    of_component = components(links.toDF("u", "v"))
    of_class = classes.join(of_component, "node", "left").select("h1", "h2", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    out = sigs.join(of_class, ["h1", "h2", "n_shingles"], "left")
    least = F.when(F.col(id_col).isNotNull(), F.coalesce("component_id", id_col)).cast(kind)
    return out.select(id_col, "n_shingles", "h1", "h2", least.alias("component_id"), F.col(id_col).eqNullSafe(least).alias("kept"))


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; ids must be integers."""
    return classified(docs, similarity, id_col, text_col).drop("h1", "h2")


def _marked(ids: DataFrame, column: str):
    """A condition on `column` that holds for all of ids and, by chance, for few others; its size is fixed.

    The bit map is the value of a scalar subquery, so it is no part of the plan's text.
    """
    some = _filter_words(ids.toDF("node"))
    every = ids.sparkSession.range(FILTER_BITS // 64).withColumnRenamed("id", "word").join(some, "word", "left")
    whole = stage(every.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits")))), lambda x: x.bits).alias("map")), "filter")
    slot = f"pmod(xxhash64(cast(`{column}` as bigint)), {FILTER_BITS}L)"
    word = F.get(whole.scalar(), F.expr(f"cast({slot} div 64 as int)"))
    return F.col(column).isNotNull() & (F.call_function("shiftright", word, F.expr(f"cast({slot} % 64 as int)")).bitwiseAND(F.lit(1).cast("bigint")) == 1)


def deduplicated(docs: DataFrame, similarity: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, less all but one of each near-duplicate class.

    Of repeated rows with one id one stays. Only rows whose id may be removed, or is not unique, are
    shuffled with their text; a filter of fixed size lets the others pass. The columns may have any names.
    """
    columns = docs.columns
    docs, (id_col, text_col) = own_names(docs, id_col, text_col)
    told = stage(classified(docs, similarity, id_col, text_col), "classified")
    some = told.where(F.col(id_col).isNotNull())
    often = stage(some.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").select(F.col(id_col).cast("bigint").alias("_id")), "often")
    gone = some.where("not kept").select(F.col(id_col).cast("bigint").alias("_id"))
    asked = stage(gone.union(often).distinct(), "asked")
    mark = _marked(asked, id_col)
    maybe = docs.where(mark)
    same = F.col(id_col).cast("bigint") == F.col("_id")
    out = docs.where(~mark).union(maybe.join(asked, same, "left_anti"))
    if often.isEmpty():
        return out.toDF(*columns)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches):
        for part in bounded(batches, 2000, 2_000_000, text_col):
            sets = shingle_sets(part.column(text_col).to_pylist())
            one, two = zip(*map(digests, sets))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([len(s) for s in sets], pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64())], [*part.schema.names, "_n", "_h1", "_h2"])

    again = maybe.join(often, same, "left_semi").mapInArrow(run, f"{kind}, _n bigint, _h1 bigint, _h2 bigint").dropDuplicates([id_col, "_n", "_h1", "_h2"])
    stay = some.where("kept").select(F.col(id_col).cast("bigint").alias("_id"), F.col("n_shingles").alias("_n"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).distinct()
    both = again.alias("a").join(stay.alias("s"), same & (F.col("a._n") == F.col("s._n")) & (F.col("a._h1") == F.col("s._h1")) & (F.col("a._h2") == F.col("s._h2")), "left_semi")
    return out.union(both.select(*(f"a.`{c}`" for c in docs.columns))).toDF(*columns)


#: The same rows by DuckDB: all pairs of documents with a common shingle, and their closure.
ORACLE_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM d),
s AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS g FROM w WHERE len(ws) >= 5
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n AS p ON p.doc_id = x JOIN n AS q ON q.doc_id = y WHERE 100 * common >= 75 * (p.n + q.n - common)),
both_ways AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach(x, y) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.x, b.y FROM reach AS r JOIN both_ways AS b ON r.y = b.x),
least AS (SELECT x, min(y) AS m FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m, d.doc_id) AS component_id, coalesce(m, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON x = d.doc_id
"""
