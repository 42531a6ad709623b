"""Operator 2: scoring texts with a hidden Markov language model over the whole corpus.

Model. Every token belongs to one class: the end token, each of the `top_words` most frequent
training words, and the words of one hashed ending have a class of their own. Latent states move by
a transition matrix and emit a class; a word follows from its class with (c + 0.1) / (C + 0.1 (V + 1)),
where c is the word's training count and C, V the tokens and distinct words of its class (words with a
class of their own: 1). So the states have a bounded number of parameters, while the word counts
behind them hold every training word and grow with the corpus.

Work. (1) Count all training words. (2) Encode each block of documents once: class ids in order, and
for words outside the top their postings (word, positions of the documents in the block). (3)
Baum-Welch: every task runs scaled forward-backward recursions over its whole documents' class ids
and adds up expected counts; these are summed by class across tasks, at most classes x states numbers. A long document
is cut into windows whose states are carried exactly: each window's transfer matrix, from the states before it to those at
its end, gives the states at all its borders, and then all windows are run side by side.
(4) Scaled forward recursion over whole documents gives the exact likelihood of the class sequence;
postings joined with the counts add what the words of a document contribute. A block's words are joined
once, not once a document, and the frequent words never enter the join, so no key is hot.

Defined results: a null or empty text has the end token alone; words and texts may have any length;
of equally frequent words those that sort first have a class of their own; a null doc_id counts as training;
repeated rows count each; an empty table gives no rows; without training rows all counts are 0.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bounded, remainder, spread, stage, words

TOP_WORDS = 4096
ENDINGS = 4096
STATES = 6
ITERATIONS = 4
WINDOW = 512
#: Windows that are run side by side, and their tokens with the padding.
SIDE_BY_SIDE, CELLS = 4096, 1 << 19
ADD = 0.1
#: The end token; no word is empty.
END = b""
#: Longer words go by a digest of their own in the table of classes, which bounds what is sent to every task.
LONGEST = 64
#: Blocks of one task of the last steps.
BLOCKS_A_TASK = 3


@dataclass
class Model:
    """Everything that scoring needs besides the counts of the rarer words; its size is bounded."""

    classes: dict[bytes, int]  # of the end token and the top words, from 0
    own_counts: np.ndarray  # their counts
    tail_log: np.ndarray  # of each class of endings: log10(C + ADD * (V + 1))
    prior: np.ndarray  # class frequencies
    total: int
    distinct: int
    start: np.ndarray | None = None
    move: np.ndarray | None = None
    emit: np.ndarray | None = None  # class x state

    @property
    def own(self) -> int:
        return len(self.classes)

    def class_of(self, word: bytes) -> int:
        got = self.classes.get(class_key(word))
        return self.own + zlib.crc32(word[-3:]) % ENDINGS if got is None else got


def class_key(word: bytes) -> bytes:
    """The word, or a digest for a long one; no word holds the space that a digest starts with."""
    return word if len(word) <= LONGEST else b" " + hashlib.blake2b(word, digest_size=16).digest()


def numbered(texts) -> tuple[list[bytes], list[np.ndarray]]:
    """The distinct tokens of some texts, and each text as their numbers, with the end token."""
    number: defaultdict = defaultdict(count().__next__)
    find = number.__getitem__
    own = [np.fromiter(map(find, [*words(t), END]), dtype=np.int64) for t in texts]
    return list(number), own


def word_counts(docs: DataFrame, id_col: str, text_col: str, modulus: int, held: int) -> DataFrame:
    """(word binary, n) over the training rows."""

    def run(batches):
        for part in bounded(batches, 20_000, 12_000_000, text_col):
            texts = [t for k, t in zip(part.column(id_col).to_pylist(), part.column(text_col).to_pylist()) if remainder(k, modulus) != held]
            if texts:
                distinct, own = numbered(texts)
                yield pa.RecordBatch.from_arrays([pa.array(distinct, pa.binary()), pa.array(np.bincount(np.concatenate(own), minlength=len(distinct)))], ["word", "n"])

    return spread(docs.select(id_col, text_col)).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def untrained(counts: DataFrame, top_words: int) -> Model:
    """The classes and their totals; collects at most the top words and one row a class."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    most = counts.where(F.length("word") > 0).orderBy(F.desc("n"), "word").limit(top_words)

    def keys(batches):
        for part in batches:
            yield pa.RecordBatch.from_arrays([pa.array([class_key(w) for w in part.column("word").to_pylist()], pa.binary()), part.column("n")], ["word", "n"])

    top = sorted(((bytes(r.word), r.n) for r in most.mapInArrow(keys, "word binary, n bigint").collect()), key=lambda x: (-x[1], x[0]))
    end = counts.where(F.length("word") == 0).first()
    own = [(END, end.n if end else 0), *top]
    classes = {w: i for i, (w, _) in enumerate(own)}
    model = Model(classes, np.array([n for _, n in own], dtype=np.float64), np.zeros(0), np.zeros(0), total, distinct)

    def run(batches):
        size = model.own + ENDINGS
        tokens, kinds = np.zeros(size), np.zeros(size)
        for part in batches:
            at = np.fromiter((model.class_of(w) for w in part.column("word").to_pylist()), dtype=np.int64)
            tokens += np.bincount(at, weights=part.column("n").to_numpy(), minlength=size)
            kinds += np.bincount(at, minlength=size)
        some = np.flatnonzero(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(tokens[some]), pa.array(kinds[some])], ["class", "tokens", "kinds"])

    tokens, kinds = np.zeros(model.own + ENDINGS), np.zeros(model.own + ENDINGS)
    for r in counts.mapInArrow(run, "class bigint, tokens double, kinds double").groupBy("class").agg(F.sum("tokens"), F.sum("kinds")).collect():
        tokens[r[0]], kinds[r[0]] = r[1], r[2]
    model.tail_log = np.log10(tokens[model.own :] + ADD * (kinds[model.own :] + 1))
    model.prior = (tokens + 0.5) / (tokens + 0.5).sum()
    return model


def encoded_blocks(docs: DataFrame, model: Model, id_col: str, text_col: str, modulus: int, held: int) -> DataFrame:
    """One row a block with its documents (kind 0), and one for each of its words outside the top (kind 1)."""
    kind = docs.schema[id_col].dataType.simpleString()
    fields = f"kind int, block bigint, word binary, at binary, ids array<{kind}>, held array<boolean>, lengths array<int>, classes binary"
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for part in bounded(batches, 20_000, 12_000_000, text_col):
            keys = part.column(id_col)
            distinct, own = numbered(part.column(text_col).to_pylist())
            class_of = np.fromiter(map(model.class_of, distinct), dtype=np.uint16, count=len(distinct))
            flat, lengths = np.concatenate(own), np.array([len(o) for o in own], dtype=np.int32)
            flags = [[remainder(k, modulus) == held for k in keys.to_pylist()]]
            head = [pa.array([0], pa.int32()), pa.array([block]), pa.array([b" %d" % block], pa.binary()), pa.nulls(1, pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array(flags), pa.array([lengths]), pa.array([class_of[flat].tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(head, names)
            at = np.repeat(np.arange(len(own), dtype=np.uint16), lengths)
            rare = class_of[flat] >= model.own
            flat, at = flat[rare], at[rare]
            at = at[np.argsort(flat, kind="stable")]
            sizes = np.bincount(flat, minlength=len(distinct))
            told = np.flatnonzero(sizes)
            offsets = np.concatenate([[0], np.cumsum(sizes[told]) * 2]).astype(np.int32)
            spans = pa.Array.from_buffers(pa.binary(), len(told), [None, pa.py_buffer(offsets), pa.py_buffer(at)])
            kept = pa.array([distinct[i] for i in told], pa.binary())
            for lo in range(0, len(told), 50_000):
                n = min(50_000, len(told) - lo)
                none = [pa.nulls(n, t) for t in (keys.type, pa.bool_(), pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), pa.array(np.full(n, block)), kept.slice(lo, n), spans.slice(lo, n), *(pa.nulls(n, pa.list_(x.type)) for x in none), pa.nulls(n, pa.binary())], names)
            block += 1

    return spread(docs.select(id_col, text_col)).mapInArrow(run, fields)


def _batches(order: np.ndarray, lengths: np.ndarray):
    """Runs of windows in falling order of length that are worked on at once."""
    lo = 0
    while lo < len(order):
        n = max(1, min(SIDE_BY_SIDE, CELLS // int(lengths[order[lo]])))
        yield order[lo : lo + n]
        lo += n


def borders(parts: list[np.ndarray], starts: list[int], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Of each window the states before it (given all up to there) and what follows its end, up to scale.

    parts are the windows of some texts one text after the other; starts are the places of first windows. A row
    before a first window is model.start, and one after a last window is all ones.
    """
    states, n = len(model.start), len(parts)
    before, after = np.tile(model.start, (n, 1)), np.ones((n, states))
    first = np.zeros(n, dtype=bool)
    first[starts] = True
    several = np.flatnonzero(~first | ~np.append(first[1:], True))  # of texts with more than one window
    if not len(several):
        return before, after
    lengths = np.array([len(parts[i]) for i in several])
    order = np.argsort(-lengths, kind="stable")
    a = model.move.astype(np.float32)
    e = np.ascontiguousarray(model.emit * len(model.prior), dtype=np.float32)  # about 1 in the mean, so that some products stay in range
    moved = np.empty((n, states, states))  # transfer matrices
    for some in _batches(order, lengths):
        own, size = several[some], lengths[some]
        ids = np.zeros((int(size[0]), len(own)), dtype=np.int64)
        for k, i in enumerate(own):
            ids[: size[k], k] = parts[i]
        x = np.repeat(np.eye(states, dtype=np.float32)[:, None], len(own), axis=1)  # state before x window x state
        live = np.searchsorted(-size, -np.arange(len(ids)), side="left")
        for t in range(len(ids)):
            m = live[t]
            y = (x[:, :m].reshape(-1, states) @ a).reshape(states, m, states)
            if not t:  # a first window's states are those at its first token
                y[:, first[own[:m]]] = np.eye(states)[:, None]
            y *= e[ids[t, :m]]
            if t % 4 == 3:  # only the proportions count
                y /= y.sum(axis=(0, 2))[:, None]
            if m == x.shape[1]:
                x = y
            else:
                x[:, :m] = y
        x = x.transpose(1, 0, 2)
        moved[own] = x
    place = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))  # of a window in its text
    for k in range(1, int(place.max()) + 1):
        at = np.flatnonzero(place == k)
        x = np.einsum("ni,nij->nj", before[at - 1], moved[at - 1])
        before[at] = x / x.sum(axis=1, keepdims=True)
    for k in range(int(place.max()), 0, -1):
        at = np.flatnonzero(place == k)
        x = np.einsum("nij,nj->ni", moved[at], after[at])
        after[at - 1] = x / x.sum(axis=1, keepdims=True)
    return before, after


def expected_counts(seqs: list[np.ndarray], model: Model, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Scaled forward-backward over whole texts of class ids: expected (start, move, emit) and the log likelihood."""
    states, size = len(model.start), len(model.prior)
    start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((size, states))
    total = 0.0
    a, e = model.move.astype(np.float32), np.ascontiguousarray(model.emit, dtype=np.float32)
    parts = [s[i : i + window] for s in seqs for i in range(0, len(s), window)]
    counts = [-(-len(s) // window) for s in seqs]
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64) if seqs else np.zeros(0, np.int64)
    before, after = borders(parts, starts, model)
    is_first = np.zeros(len(parts), dtype=bool)
    is_first[starts] = True
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    for at in _batches(np.argsort(-sizes, kind="stable"), sizes):
        own = [parts[i] for i in at]
        lengths = np.array([len(p) for p in own])
        first, came = is_first[at], before[at].astype(np.float32)
        longest = int(lengths[0])
        ids = np.zeros((longest, len(own)), dtype=np.int64)
        for k, p in enumerate(own):
            ids[: len(p), k] = p
        live = np.searchsorted(-lengths, -np.arange(longest), side="left")  # windows longer than t
        out = e[ids]  # emission probabilities: time x window x state
        alpha, scale = np.zeros_like(out), np.ones((longest, len(own)), dtype=np.float32)
        for t in range(longest):
            n = live[t]
            x = (alpha[t - 1, :n] @ a if t else np.where(first[:, None], came, came @ a)) * out[t, :n]
            c = x.sum(axis=1)
            alpha[t, :n], scale[t, :n] = x / c[:, None], c
        total += float(np.log(scale, dtype=np.float64).sum())
        beta = after[at].astype(np.float32)
        beta /= (alpha[lengths - 1, np.arange(len(own))] * beta).sum(axis=1, keepdims=True)
        gamma = alpha
        gamma_last = alpha[lengths - 1, np.arange(len(own))] * beta
        for t in range(longest - 2, -1, -1):
            n = live[t + 1]
            ahead = out[t + 1, :n] * beta[:n] / scale[t + 1, :n, None]
            move += alpha[t, :n].T @ ahead
            beta[:n] = ahead @ a.T
            gamma[t, :n] = alpha[t, :n] * beta[:n]
        gamma[lengths - 1, np.arange(len(own))] = gamma_last
        move += came[~first].T @ (out[0] * beta / scale[0][:, None])[~first]
        start += gamma[0][first].sum(axis=0)
        within = np.arange(longest)[:, None] < lengths[None, :]
        flat = ids[within]
        for k in range(states):
            emit[:, k] += np.bincount(flat, weights=gamma[:, :, k][within], minlength=size)
    return start, move * model.move, emit, total


def initial(model: Model, states: int, seed: int = 7) -> None:
    """Sticky states whose emissions vary around the class frequencies."""
    rng = np.random.default_rng(seed)
    model.start = np.full(states, 1 / states)
    model.move = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - 0.1 / max(1, states - 1))
    model.move /= model.move.sum(axis=1, keepdims=True)
    emit = model.prior[:, None] * np.exp(rng.normal(0, 0.7, (len(model.prior), states)))
    model.emit = emit / emit.sum(axis=0)


def baum_welch(blocks: DataFrame, model: Model, states: int, iterations: int) -> list[float]:
    """Train model over all training documents of the blocks; returns the log likelihood before each step."""
    spark = blocks.sparkSession
    initial(model, states)
    told = []
    for _ in range(iterations):
        sent = spark.sparkContext.broadcast(model)

        def run(batches, sent=sent):
            m = sent.value
            sums = None
            for part in batches:
                for held, lengths, classes in zip(*(part.column(c).to_pylist() for c in ("held", "lengths", "classes"))):
                    ids = np.split(np.frombuffer(classes, dtype=np.uint16), np.cumsum(lengths)[:-1])
                    got = expected_counts([s for s, h in zip(ids, held) if not h], m)
                    sums = got if sums is None else tuple(x + y for x, y in zip(sums, got))
            if sums is not None:
                start, move, emit, total = sums
                rows = [*emit.tolist(), *move.tolist(), start.tolist(), [total, *[0.0] * (len(start) - 1)]]
                cols = np.array(rows).T
                yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), *(pa.array(c) for c in cols)], ["row", *(f"s{k}" for k in range(len(start)))])

        sums = blocks.where("kind = 0").select("held", "lengths", "classes").mapInArrow(run, ", ".join(["row int", *(f"s{k} double" for k in range(states))]))
        table = np.zeros((len(model.prior) + states + 2, states))
        for r in sums.groupBy("row").agg(*(F.sum(f"s{k}") for k in range(states))).collect():
            table[r[0]] = r[1:]
        size = len(model.prior)
        emit = table[:size] + 50.0 * model.prior[:, None]
        move = table[size : size + states] + 0.1
        start = table[size + states] + 0.1
        told.append(float(table[-1, 0]))
        model.emit, model.move = emit / emit.sum(axis=0), move / move.sum(axis=1, keepdims=True)
        model.start = start / start.sum()
        sent.unpersist()
    return told


def log_likelihoods(seqs: list[np.ndarray], model: Model) -> np.ndarray:
    """log10 probability of each whole class sequence by the scaled forward recursion."""
    order = np.argsort([-len(s) for s in seqs], kind="stable")
    lengths = np.array([len(seqs[i]) for i in order])
    flat = np.concatenate([seqs[i] for i in order]).astype(np.int64) if len(seqs) else np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(seqs) else np.zeros(0, np.int64)
    longest = int(lengths[0]) if len(seqs) else 0
    live = np.searchsorted(-lengths, -np.arange(longest), side="left")
    a, e = model.move, np.ascontiguousarray(model.emit)
    sums = np.zeros(len(seqs))
    x = np.tile(model.start, (len(seqs), 1))
    for t in range(longest):
        n = live[t]
        x = (x[:n] @ a if t else x[:n]) * e[flat[starts[:n] + t]]
        c = x.sum(axis=1)
        x /= c[:, None]
        sums[:n] += np.log10(c)
    out = np.zeros(len(seqs))
    out[order] = sums
    return out


def block_scores(blocks: DataFrame, model: Model) -> DataFrame:
    """Of each block: what the class sequence and the end and top words contribute to its documents' scores."""
    sent = blocks.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        own_log = np.log10(m.own_counts + ADD)
        per_token = np.log10(m.total + ADD * (m.distinct + 1))
        for part in batches:
            heads = []
            for keys, held, lengths, classes in zip(*(part.column(c).to_pylist() for c in ("ids", "held", "lengths", "classes"))):
                flat = np.frombuffer(classes, dtype=np.uint16).astype(np.int64)
                ends = np.cumsum(lengths)
                doc = np.repeat(np.arange(len(lengths)), lengths)
                top = flat < m.own
                total = lambda keep, x: np.bincount(doc[keep], weights=x, minlength=len(lengths))  # noqa: B023, E731
                base = total(top, own_log[flat[top]]) - np.array(lengths) * per_token
                known = total(top, m.own_counts[flat[top]] > 0)
                score = log_likelihoods(np.split(flat, ends[:-1]), m) - total(~top, m.tail_log[flat[~top] - m.own])
                heads.append(pickle.dumps((keys, held, lengths, base, known, score)))
            yield pa.RecordBatch.from_arrays([part.column("block"), pa.array(heads, pa.binary())], ["block", "head"])

    return blocks.where("kind = 0").select("block", "ids", "held", "lengths", "classes").mapInArrow(run, "block bigint, head binary")


def combined(parts: DataFrame, id_col: str, kind, total: int, tasks: int) -> DataFrame:
    """Add the words' contributions up by block and give a row for each document."""
    arrow = to_arrow_type(kind)

    def run(batches):
        logs, hits, heads = {}, {}, {}
        for part in batches:
            block, n = part.column("block").to_numpy(), part.column("n")
            spans = part.column("at")
            rows = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
            for i in np.flatnonzero(spans.is_null().to_numpy(zero_copy_only=False)):
                heads[int(block[i])] = pickle.loads(part.column("head")[int(i)].as_py())
            if not len(rows):
                continue
            spans, block = spans.take(pa.array(rows)), block[rows]
            n = n.take(pa.array(rows)).fill_null(0).to_numpy(zero_copy_only=False)
            offsets = np.frombuffer(spans.buffers()[1], dtype=np.int32)[spans.offset : spans.offset + len(spans) + 1]
            at = np.frombuffer(spans.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].view(np.uint16) if len(rows) else np.zeros(0, np.uint16)
            sizes = np.diff(offsets) // 2
            of_block, value, known = np.repeat(block, sizes), np.repeat(np.log10(n + ADD), sizes), np.repeat(n > 0, sizes)
            for b in np.unique(block):
                here = of_block == b
                for sums, weights in ((logs, value), (hits, known)):
                    new = np.bincount(at[here], weights=weights[here])
                    old = sums.get(int(b), np.zeros(0))
                    if len(old) < len(new):
                        old, new = new, old
                    old[: len(new)] += new
                    sums[int(b)] = old
        for b, (keys, held, lengths, base, known, score) in heads.items():
            fit = lambda x: np.pad(x, (0, len(lengths) - len(x)))  # noqa: B023, E731
            log, hit = fit(logs.get(b, np.zeros(0))), fit(hits.get(b, np.zeros(0)))
            cols = [pa.array(keys, arrow), pa.array(held), pa.array(lengths, pa.int64()), pa.array((known + hit).astype(np.int64)), pa.array(np.full(len(lengths), total, np.int64)), pa.array(base + log), pa.array(score + log)]
            yield pa.RecordBatch.from_arrays(cols, [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return parts.repartition(tasks, "block").mapInArrow(run, f"{id_col} {kind.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def score_documents(docs: DataFrame, modulus: int = 10, held: int = 0, top_words: int = TOP_WORDS, states: int = STATES, iterations: int = ITERATIONS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on the rows whose crc32(id) mod modulus is not `held`, and score every row."""
    kind = docs.schema[id_col].dataType
    counts = stage(word_counts(docs, id_col, text_col, modulus, held), "lm-counts")
    model = untrained(counts, top_words)
    blocks = stage(encoded_blocks(docs, model, id_col, text_col, modulus, held), "lm-blocks")
    baum_welch(blocks, model, states, iterations)
    tasks = max(1, -(-blocks.where("kind = 0").count() // BLOCKS_A_TASK))
    rare = blocks.where("kind = 1").select("block", "word", "at").repartition(tasks, "word").join(counts.repartition(tasks, "word"), "word", "left").select("block", "at", "n")
    parts = rare.unionByName(block_scores(blocks, model), allowMissingColumns=True)
    return combined(parts, id_col, kind, model.total, tasks)
