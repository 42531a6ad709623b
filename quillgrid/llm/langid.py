"""Operator 4: language identification with words first and character n-grams as a backoff.

Model. Known words carry their log frequency in each language. A word the model does not know is scored
from its characters: at each position the longest known n-gram (4 down to 1) that starts there gives
the score, so shorter ones are used only where the longer are unknown. The text's score for a language
is the sum over its words; `score` is the posterior of the best one.

The model is fitted on labelled rows of every language of the table: about TRAIN_ROWS of each, or all it
has, chosen by a hash of the id over all of the table. So hot sources or languages do not change its size,
and rare ones are learned from what they have. Each language brings its own most frequent words and n-grams:
WORDS and GRAMS divided by the number of languages, but LEAST of each at least. The tables hold only counts
that are not 0, so they grow in proportion to the number of languages; a word or n-gram seen once counts like any other,
and a word of more than LONGEST_WORD characters goes by a digest there. Every row of the table is predicted
from its whole text.

Defined results: `und` with score 0 if the text is null, empty or has no letter, or if there is no
labelled row to learn from; ties go to the language that sorts first. A null lang is not learned from;
a null doc_id is no training row; a very long text is scored whole; repeated rows count each; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, own_names, spread, stage

#: Of each language.
TRAIN_ROWS = 5_000
#: Known words and n-grams of all languages, and of each at least.
WORDS = 50_000
GRAMS = 30_000
LEAST = 2_000
#: Pieces that a language has equally often are taken in the order of so many hashes.
TIES = 64
LONGEST = 4
#: Characters of a word that the table of words holds itself.
LONGEST_WORD = 64
CACHE_WORDS = 300_000
#: Scores kept in the cache and bytes of text in a batch times languages; unseen words scored at once.
CACHE_CELLS = 4_000_000
BATCH_CELLS = 64_000_000
AT_ONCE = 20_000
UNKNOWN = "und"

_LETTERS = re.compile(r"[^\W\d_]+")


def letter_words(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def word_key(word: str) -> str:
    """The word, or a digest for a long one; no word holds the space that a digest starts with."""
    return word if len(word) <= LONGEST_WORD else " " + hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def grams(word: str, longest: int = LONGEST) -> list[str]:
    """All n-grams of the word with its borders."""
    w = f" {word} "
    return [w[i : i + n] for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


@dataclass
class LogTable:
    """Log frequencies by entry and language: a base for each kind of entry, and what languages that have it get beyond."""

    kinds: np.ndarray
    base: np.ndarray
    starts: np.ndarray
    languages: np.ndarray
    more: np.ndarray

    @staticmethod
    def of(kinds: np.ndarray, sizes: np.ndarray, languages: np.ndarray, counts: np.ndarray, n_languages: int) -> LogTable:
        """From the counts of each entry (as many as sizes says); add-half smoothing over the entries of its kind."""
        shape = (int(kinds.max(initial=0)) + 1, n_languages)
        totals = np.zeros(shape)
        np.add.at(totals, (np.repeat(kinds, sizes), languages), counts)
        totals += 0.5 * (np.bincount(kinds, minlength=shape[0])[:, None] + 1)
        return LogTable(kinds, np.log(0.5 / totals), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), languages, np.log((counts + 0.5) / 0.5))

    def sums(self, rows: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
        """The sum of the rows of each of n groups."""
        out = np.zeros((n, self.base.shape[1]))
        for kind, base in enumerate(self.base):
            out += np.bincount(groups[self.kinds[rows] == kind], minlength=n)[:, None] * base
        first, sizes = self.starts[rows], self.starts[rows + 1] - self.starts[rows]
        at = np.arange(sizes.sum()) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
        cells = np.repeat(groups, sizes) * out.shape[1] + self.languages[at]
        return out + np.bincount(cells, weights=self.more[at], minlength=out.size).reshape(out.shape)


@dataclass
class LanguageModel:
    """Log frequencies of known words and n-grams by language."""

    languages: list[str]
    words: dict[str, int]
    word_logs: LogTable
    grams: dict[str, int]
    gram_logs: LogTable
    longest: int = LONGEST
    cache: dict[str, int] = field(default_factory=dict)
    cached: np.ndarray | None = None

    @staticmethod
    def of(languages: list[str], words: dict[str, list[float]], grams: dict[str, list[float]]) -> LanguageModel:
        """From counts by language."""
        sparse = lambda x: (list(x), *(list(y) for y in zip(*(([k for k, c in enumerate(v) if c], [c for c in v if c]) for v in x.values())))) if x else ([], [], [])
        return LanguageModel.of_sparse(languages, sparse(words), sparse(grams))

    @staticmethod
    def of_sparse(languages: list[str], words: tuple[list, list, list], grams: tuple[list, list, list]) -> LanguageModel:
        """From entries, the numbers of the languages that have each, and their counts; n-grams are smoothed for each length."""

        def logs(kinds, entries):
            _, own, counts = entries
            sizes = np.array([len(x) for x in own], dtype=np.int64)
            flat = lambda x, kind: np.fromiter(chain.from_iterable(x), dtype=kind)
            return LogTable.of(np.array(kinds, dtype=np.int64), sizes, flat(own, np.int64), flat(counts, float), len(languages))

        number = lambda x: {k: i for i, k in enumerate(x)}
        return LanguageModel(languages, number(words[0]), logs([0] * len(words[0]), words), number(grams[0]), logs([len(g) - 1 for g in grams[0]], grams))

    def back_off(self, words: list[str]) -> np.ndarray:
        """Scores of unseen words: at each position the longest known n-gram that starts there."""
        rows, sizes = [], []
        get = self.grams.get
        for word in words:
            w = f" {word} "
            end, n = len(w), len(rows)
            for i in range(end - 1):
                for size in range(min(self.longest, end - i), 0, -1):
                    row = get(w[i : i + size])
                    if row is not None:
                        rows.append(row)
                        break
            sizes.append(len(rows) - n)
        sizes = np.array(sizes, dtype=np.int64)
        sums = self.gram_logs.sums(np.array(rows, dtype=np.int64), np.repeat(np.arange(len(words)), sizes), len(words))
        # the n-grams of a word overlap: their mean, doubled, counts them as about two independent ones
        return 2 * sums / np.maximum(sizes, 1)[:, None]

    def of_words(self, words: list[str]) -> np.ndarray:
        at = np.fromiter((self.words.get(word_key(w), -1) for w in words), dtype=np.int64, count=len(words))
        known, unseen = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        out = self.word_logs.sums(at[known], known, len(words))
        for k in range(0, len(unseen), AT_ONCE):
            out[unseen[k : k + AT_ONCE]] = self.back_off([words[i] for i in unseen[k : k + AT_ONCE]])
        return out

    def of_tokens(self, tokens: list[str]) -> np.ndarray:
        """Of each token (text without white space): the scores of its words, and whether it has a letter."""
        out = np.zeros((len(tokens), len(self.languages) + 1))
        if self.cached is None:
            self.cached = np.zeros((min(CACHE_WORDS, CACHE_CELLS // (len(self.languages) + 1)), len(self.languages) + 1))
        at = np.fromiter((self.cache.get(t, -1) for t in tokens), dtype=np.int64, count=len(tokens))
        out[at >= 0] = self.cached[at[at >= 0]]
        new = np.flatnonzero(at < 0)
        words, owner = [], []
        for i in new.tolist():
            for w in _LETTERS.findall(tokens[i]):
                words.append(w)
                owner.append(i)
        if words:
            np.add.at(out[:, :-1], np.array(owner), self.of_words(words))
            out[[i for i, w in zip(owner, words) if any(map(str.isalpha, w))], -1] = 1
        for i in new[: len(self.cached) - len(self.cache)].tolist():
            self.cached[len(self.cache)] = out[i]
            self.cache[tokens[i]] = len(self.cache)
        return out

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        number: defaultdict = defaultdict(count().__next__)
        find = number.__getitem__
        own = [np.fromiter(map(find, t.lower().split()), dtype=np.int64) if t and self.languages else np.zeros(0, np.int64) for t in texts]
        table = self.of_tokens(list(number))
        out = []
        for rows in own:
            total = table[rows].sum(axis=0)
            if not len(rows) or not total[-1]:
                out.append((UNKNOWN, 0.0))
                continue
            total = total[:-1]
            best = int(np.argmax(total))
            out.append((self.languages[best], float(1 / np.exp(total - total[best]).sum())))
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]


def fit(docs: DataFrame, modulus: int = 4, held: int = 2, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from about `rows` labelled rows of each language whose crc32(id) mod modulus is not `held`."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % modulus != held))
    totals = dict(labelled.groupBy(lang_col).count().collect())
    languages = sorted(totals)
    if not languages:
        return LanguageModel.of([], {}, {})
    numbers = {lang: k for k, lang in enumerate(languages)}
    some = spread(labelled.select(id_col, text_col, lang_col))
    if max(totals.values()) > rows:
        share = F.pmod(F.xxhash64(F.col(id_col), F.lit("langid")), F.lit(1 << 30))
        shares = docs.sparkSession.createDataFrame([(lang, int((1 << 30) * min(1.0, rows / n))) for lang, n in totals.items()], f"`{lang_col}` string, below_ bigint")
        some = some.join(F.broadcast(shares), lang_col).where(share < F.col("below_"))

    def run(batches):
        for part in bounded(batches, 5000, 8_000_000, text_col):
            by_word: dict[str, Counter] = {}
            for lang, text in zip(part.column(lang_col).to_pylist(), part.column(text_col).to_pylist()):
                by_word.setdefault(lang, Counter()).update(letter_words(text))
            rows: list[tuple] = []
            for name, counts in by_word.items():
                lang = numbers[name]
                pieces: Counter = Counter()
                for w, c in counts.items():
                    for g in grams(w):
                        pieces[g] += c
                rows += [(lang, True, word_key(w), c) for w, c in counts.items()]
                rows += [(lang, False, g, c) for g, c in pieces.items()]
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1]), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())], ["language", "whole", "piece", "n"])

    counts = some.select(text_col, lang_col).mapInArrow(run, "language int, whole boolean, piece string, n bigint")
    counts = counts.groupBy("whole", "piece", "language").agg(F.sum("n").alias("n"))
    own = counts.groupBy("whole", "piece").agg(F.collect_list(F.struct("language", "n")).alias("own"))
    own = stage(own.withColumn("tie", F.pmod(F.xxhash64("piece"), F.lit(TIES))), "language-pieces")
    ranks = own.select("whole", "tie", F.explode("own").alias("x")).groupBy("whole", "x.language", (F.col("x.n") * TIES + F.col("tie")).alias("rank")).agg(F.count("*").alias("n"))
    least = docs.sparkSession.createDataFrame([least_ranks(ranks.toArrow(), len(languages))], "of_words array<bigint>, of_grams array<bigint>")
    least_of = F.when(F.col("whole"), F.col("of_words")).otherwise(F.col("of_grams"))
    told = own.crossJoin(F.broadcast(least)).where(F.exists("own", lambda x: x["n"] * TIES + F.col("tie") >= F.get(least_of, x["language"])))
    told = told.select("whole", "piece", F.col("own.language").alias("languages"), F.col("own.n").alias("counts")).toArrow()

    def take(whole: bool) -> tuple[list, list, list]:
        got = told.filter(pc.equal(told.column("whole"), whole))
        return tuple(got.column(c).to_pylist() for c in ("piece", "languages", "counts"))

    return LanguageModel.of_sparse(languages, take(True), take(False))


def least_ranks(ranks: pa.Table, n_languages: int) -> tuple[list[int], list[int]]:
    """For words and n-grams: by language, the least rank so that no more pieces than it may bring have it or a higher one."""
    whole, language, rank, n = (ranks.column(c).to_numpy() for c in ("whole", "language", "rank", "n"))
    out = []
    for kind, most in ((True, WORDS), (False, GRAMS)):
        of_kind = np.flatnonzero(whole == kind)
        of_kind = of_kind[np.lexsort((-rank[of_kind], language[of_kind]))]
        ends = np.searchsorted(language[of_kind], np.arange(n_languages + 1))
        cuts = []
        for start, end in zip(ends[:-1], ends[1:]):
            own = of_kind[start:end]
            fit_in = int(np.searchsorted(np.cumsum(n[own]), max(LEAST, most // n_languages), side="right"))
            cuts.append(0 if fit_in == len(own) else int(rank[own[fit_in]]) + 1)
        out.append(cuts)
    return out[0], out[1]


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score), or with keep the rows of docs with both columns added.

    With keep, the two columns replace columns of the same names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own = [f for f in docs.schema.fields if f.name.lower() not in ("lang_pred", "score")] if keep else [docs.schema[id_col], docs.schema[text_col]]
    back = own if keep else own[:1]
    names = [f.name for f in back]
    chars = min(4_000_000, BATCH_CELLS // (len(model.languages) + 1))

    def run(batches):
        for part in bounded(batches, 2000, chars, text_col):
            got = sent.value.predict_all(part.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*names, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in back)
    return spread(docs.select(*(f"`{f.name}`" for f in own))).mapInArrow(run, f"{fields}, lang_pred string, score double")


def filtered(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs whose language is told with a score of at least `least`, with all their columns, which may have any names."""
    own, (id_col, text_col, lang_col) = own_names(docs, id_col, text_col, lang_col)
    out = identify(own, fit(own, id_col=id_col, text_col=text_col, lang_col=lang_col), id_col, text_col, keep=True)
    return out.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*own.columns).toDF(*docs.columns)


def predicted(docs: DataFrame, modulus: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, with a model that learned from the other folds."""
    out = identify(docs, fit(docs, modulus, held))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == held, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
