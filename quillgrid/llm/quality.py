"""Operator 9: quality rules with thresholds learned per language and source.

Four measures of a document, in thousandths: characters a word, symbols a word, repeated lines a line,
words in repeated three-word windows a word. Each is sketched per language and source as counts by
bucket: a measure below 512 is its own bucket, a larger one keeps its nine leading bits, so a quantile
is off by less than 1 in 256. Sketches merge by adding counts, per task first, then per group, then per language.

A fence is a quantile of the group moved outwards by a spread of the group. For word length and symbols it is the
upper quartile and three times the distance of the quartiles (word length: four times, and below the lower quartile too). Repeats are
0 in most documents, so there it is the 0.99 quantile, moved by its distance from the median. Nothing but
quantiles sets a fence: where a group has no spread, all that differs from it by more than a text's smallest
step (STEP: two symbols, one line, one repeated window) is outside. Each quantile is the mean of the group's and its
language's, weighted by the group's documents and PRIOR: a group of few documents leans on its language, without a
size at which the rule changes. A document is kept if it passes the base rules and no fence is passed.

A group has at most some thousand buckets a measure, so no task gets more than that for a hot source; the
thresholds are joined to the documents by Spark's choice of join, which broadcasts only below its size limit and splits
hot keys.

Defined results: a null or empty text has no words, so all counts are 0 and base_failed is true; a null
lang or source is a group of its own; a very long text is measured whole; equal values share a bucket, so ties fall on
the same side; repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, own_names, spread, stage, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED = 50  # of 100 words
#: Documents that the language's quantiles count as beside the group's own.
PRIOR = 30
#: Leading bits that a bucket keeps.
BITS = 9
#: Quantiles that are taken, in hundredths.
QUANTILES = (25, 50, 75, 99)
#: Measure, its count and what that is divided by; fence: quantile, spread as (times, from, to), and the same below.
MEASURES = (
    ("word_length", "word_chars", "n_words", (75, 4, 25, 75), (25, 4, 25, 75)),
    ("symbols", "n_symbols", "n_words", (75, 3, 25, 75), None),
    ("repeated_lines", "n_dup_lines", "n_lines", (99, 1, 50, 99), None),
    ("repeated_words", "n_repeat_words", "n_words", (99, 1, 50, 99), None),
)
#: The smallest steps of a text, which no fence of 0 can tell apart from chance.
STEP = {"symbols": 2, "repeated_lines": 1, "repeated_words": 6}

_SPACES = " \t\n\x0b\x0c\r"


def repeated_words(own: list[bytes]) -> int:
    """Words inside three-word windows that are found twice or more in the list."""
    grams = list(zip(own, own[1:], own[2:]))
    if len(set(grams)) == len(grams):
        return 0
    seen: set = set()
    twice = {g for g in grams if g in seen or seen.add(g)}
    total, covered = 0, 0  # covered: words up to here that are counted already
    for i, g in enumerate(grams):
        if g in twice:
            total += i + 3 - max(i, covered)
            covered = i + 3
    return total


def measured(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and lines with a word."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    own = words(text, lower=False)
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    chars = len(text) - sum(map(text.count, _SPACES))
    return len(own), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(own), len(lines)


def features(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of docs with the counts of each whole text."""
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

    def run(batches):
        for part in bounded(batches, 2000, 4_000_000, text_col):
            rows = [measured(t) for t in part.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(c, pa.int64()) for c in zip(*rows))], [*keep, *counts])

    asked = list(dict.fromkeys([*keep, text_col]))
    return spread(docs.select(*(f"`{c}`" for c in asked))).mapInArrow(run, ", ".join([fields, *(f"{c} bigint" for c in counts)]))


def with_measures(counts: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    ratios = {name: F.expr(f"1000 * {count} div greatest({of}, 1L)") for name, count, of, _, _ in MEASURES}
    return counts.withColumns({"base_failed": failed, **ratios})


def bucket(value: Column) -> Column:
    """The least value of its bucket: BITS leading bits are kept."""
    bits = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, bits), bits)


def sketches(measures: DataFrame, lang: str, source: str) -> DataFrame:
    """(lang, source, measure, bucket, n) over the documents that pass the base rules."""
    each = F.explode(F.array(*(F.struct(F.lit(m[0]).alias("measure"), bucket(F.col(m[0])).alias("bucket")) for m in MEASURES)))
    rows = measures.where("not base_failed").select(F.col(lang).alias("lang"), F.col(source).alias("source"), each.alias("x"))
    return rows.groupBy("lang", "source", "x.measure", "x.bucket").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """(keys, measure, docs, q<k>): the least buckets up to which k of 100 documents are."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    over = Window.partitionBy(*keys, "measure")
    run = merged.withColumns({"below": F.sum("n").over(over.orderBy("bucket")), "total": F.sum("n").over(over)})
    least = [F.min(F.when(100 * F.col("below") >= k * F.col("total"), F.col("bucket"))).alias(f"q{k}") for k in QUANTILES]
    return run.groupBy(*keys, "measure").agg(F.max("total").alias("docs"), *least)


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row a (lang, source): the fences high_<measure> and low_<measure>."""
    own, wide = quantiles(sketch, "lang", "source"), quantiles(sketch, "lang")
    wide = wide.select(F.col("lang").alias("lang2"), F.col("measure").alias("measure2"), *(F.col(f"q{k}").alias(f"w{k}") for k in QUANTILES))
    both = own.join(wide, F.col("lang").eqNullSafe(F.col("lang2")) & (F.col("measure") == F.col("measure2")))
    both = both.select("lang", "source", "measure", *(F.expr(f"(docs * q{k} + {PRIOR} * w{k}) div (docs + {PRIOR})").alias(f"q{k}") for k in QUANTILES))
    fences = []
    for name, _, _, up, down in MEASURES:
        here = F.col("measure") == name
        at, times, a, b = up
        fences.append(F.max(F.when(here, F.col(f"q{at}") + times * (F.col(f"q{b}") - F.col(f"q{a}")))).alias(f"high_{name}"))
        if down is not None:
            at, times, a, b = down
            fences.append(F.max(F.when(here, F.col(f"q{at}") - times * (F.col(f"q{b}") - F.col(f"q{a}")))).alias(f"low_{name}"))
    return both.groupBy("lang", "source").agg(*fences)


def passed(measures: DataFrame, fences: DataFrame, lang: str, source: str) -> DataFrame:
    """measures with `outside`, the measures beyond their group's fences, and `kept`: none is, and the base rules are passed."""
    told = fences.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    out = measures.join(told, F.col(f"`{lang}`").eqNullSafe(F.col("_lang")) & F.col(f"`{source}`").eqNullSafe(F.col("_source")), "left")
    beyond = []
    for name, count, of, _, down in MEASURES:
        if name in STEP:
            bad = 1000 * (F.col(count) - STEP[name]) > F.col(f"high_{name}") * F.greatest(F.col(of), F.lit(1))
        else:
            bad = bucket(F.col(name)) > F.col(f"high_{name}")
        if down is not None:
            bad |= bucket(F.col(name)) < F.col(f"low_{name}")
        beyond.append(F.when(bad, name))
    outside = F.when(F.col("base_failed"), "").otherwise(F.concat_ws(",", *beyond))
    return out.withColumn("outside", outside).withColumn("kept", ~F.col("base_failed") & (F.col("outside") == ""))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(doc_id, the counts, base_failed, kept, outside) of every row; outside names the measures beyond the group's fences."""
    measures = with_measures(stage(features(docs, [id_col, lang, source], text_col), "quality"))
    fences = stage(thresholds(sketches(measures, lang, source)), "fences")
    out = passed(measures, fences, lang, source)
    return out.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "outside")


def filtered(docs: DataFrame, text_col: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of docs that are kept, with all their columns, which may have any names.

    The measures are taken twice, once for the sketches and once beside the texts, so that no text is
    shuffled or written; the fences are written first, so their size is known when they are joined.
    """
    own, (text_col, lang, source) = own_names(docs, text_col, lang, source)
    fences = stage(thresholds(sketches(with_measures(features(own, [lang, source], text_col)), lang, source)), "fences")
    out = passed(with_measures(features(own, own.columns, text_col)), fences, lang, source)
    return out.where("kept").select(*own.columns).toDF(*docs.columns)


#: The same rows by DuckDB.
ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM d),
tok AS (SELECT r, unnest(ws) AS a, unnest(range(1, len(ws) + 1)) AS i FROM w),
tri AS (SELECT r, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM tok WINDOW o AS (PARTITION BY r ORDER BY i)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM tri WHERE c IS NOT NULL) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY r),
li AS (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d),
lc AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM li WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY r),
f AS (SELECT d.r, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines
  FROM d JOIN w USING (r) LEFT JOIN covered USING (r) LEFT JOIN lc USING (r)),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 1000 * word_chars // greatest(n_words, 1) AS v1,
  1000 * n_symbols // greatest(n_words, 1) AS v2, 1000 * n_dup_lines // greatest(n_lines, 1) AS v3, 1000 * n_repeat_words // greatest(n_words, 1) AS v4 FROM f),
l AS (SELECT lang, source, unnest([1, 2, 3, 4]) AS k, unnest([v1, v2, v3, v4]) AS v FROM m WHERE NOT base_failed),
s AS (SELECT lang, source, k, (v >> greatest(length(bin(v)) - 9, 0)) << greatest(length(bin(v)) - 9, 0) AS bucket, count(*) AS n FROM l GROUP BY ALL),
g AS (SELECT lang, source, k, bucket, sum(n) OVER (PARTITION BY lang, source, k ORDER BY bucket) AS below, sum(n) OVER (PARTITION BY lang, source, k) AS total FROM s),
own AS (SELECT lang, source, k, max(total) AS docs, min(bucket) FILTER (WHERE 100 * below >= 25 * total) AS q25, min(bucket) FILTER (WHERE 100 * below >= 50 * total) AS q50,
  min(bucket) FILTER (WHERE 100 * below >= 75 * total) AS q75, min(bucket) FILTER (WHERE 100 * below >= 99 * total) AS q99 FROM g GROUP BY ALL),
s2 AS (SELECT lang, k, bucket, sum(n) AS n FROM s GROUP BY ALL),
g2 AS (SELECT lang, k, bucket, sum(n) OVER (PARTITION BY lang, k ORDER BY bucket) AS below, sum(n) OVER (PARTITION BY lang, k) AS total FROM s2),
wide AS (SELECT lang, k, min(bucket) FILTER (WHERE 100 * below >= 25 * total) AS w25, min(bucket) FILTER (WHERE 100 * below >= 50 * total) AS w50,
  min(bucket) FILTER (WHERE 100 * below >= 75 * total) AS w75, min(bucket) FILTER (WHERE 100 * below >= 99 * total) AS w99 FROM g2 GROUP BY ALL),
q AS (SELECT own.lang, own.source, own.k, (docs * q25 + 30 * w25) // (docs + 30) AS q25, (docs * q50 + 30 * w50) // (docs + 30) AS q50,
  (docs * q75 + 30 * w75) // (docs + 30) AS q75, (docs * q99 + 30 * w99) // (docs + 30) AS q99
  FROM own JOIN wide ON own.lang IS NOT DISTINCT FROM wide.lang AND own.k = wide.k),
fence AS (SELECT lang, source, max(q75 + 4 * (q75 - q25)) FILTER (WHERE k = 1) AS h1, max(q25 - 4 * (q75 - q25)) FILTER (WHERE k = 1) AS l1,
  max(q75 + 3 * (q75 - q25)) FILTER (WHERE k = 2) AS h2, max(q99 + (q99 - q50)) FILTER (WHERE k = 3) AS h3, max(q99 + (q99 - q50)) FILTER (WHERE k = 4) AS h4 FROM q GROUP BY ALL),
b AS (SELECT m.*, h1, l1, h2, h3, h4, (v1 >> greatest(length(bin(v1)) - 9, 0)) << greatest(length(bin(v1)) - 9, 0) AS b1
  FROM m LEFT JOIN fence ON m.lang IS NOT DISTINCT FROM fence.lang AND m.source IS NOT DISTINCT FROM fence.source),
o AS (SELECT *, CASE WHEN base_failed THEN '' ELSE concat_ws(',', CASE WHEN b1 > h1 OR b1 < l1 THEN 'word_length' END,
  CASE WHEN 1000 * (n_symbols - 2) > h2 * greatest(n_words, 1) THEN 'symbols' END, CASE WHEN 1000 * (n_dup_lines - 1) > h3 * greatest(n_lines, 1) THEN 'repeated_lines' END,
  CASE WHEN 1000 * (n_repeat_words - 6) > h4 * greatest(n_words, 1) THEN 'repeated_words' END) END AS outside FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND outside = '' AS kept, outside FROM o
"""
