"""Label classification and ranked lexical search."""

from __future__ import annotations

import os
import re
import unicodedata
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER_ROWS = 20
LABEL_COLUMNS = 3
CLIP = 2048
#: The constants of the ranking function, and the least weight of a term.
K1, B, LEAST = 1.2, 0.75, 1e-6

_RUN = re.compile(r"[^\W_]+")


def labels(cells: DataFrame, clip: int = CLIP) -> DataFrame:
    """cells (row, col, value_text) with kind (header, label or body) and the clipped text."""
    kind = F.when(F.col("row") <= HEADER_ROWS, "header").when(F.col("col") <= LABEL_COLUMNS, "label").otherwise("body")
    return cells.withColumns({"kind": kind, "text": F.substring("value_text", 1, clip)})


def ascii_tokens(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, tokens): runs of ASCII letters and digits in lower case."""
    return docs.select(key, F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)).alias("tokens"))


def tokens(text: str | None) -> list[str]:
    """Runs of letters and digits without case and diacritics."""
    if not text:
        return []
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return _RUN.findall(bare.casefold())


def unicode_tokens(docs: DataFrame, key: list[str], text: str) -> DataFrame:
    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(tokens)

    return docs.select(*key, split(F.col(text)).alias("tokens"))


def _occurrences(phrase: list[str]) -> Column:
    """How often the tokens of a phrase follow one another."""
    if len(phrase) == 1:
        return F.size(F.filter("tokens", lambda t: t == phrase[0]))
    ends = F.sequence(F.lit(1), F.size("tokens") - len(phrase) + 1)
    whole = F.array(*map(F.lit, phrase))
    hits = F.size(F.filter(ends, lambda i: F.slice("tokens", i, len(phrase)) == whole))
    return F.when(F.size("tokens") >= len(phrase), hits).otherwise(0)


def bm25(docs: DataFrame, total: int | None, key: str | list[str], terms: list[str | list[str]], folder: str | None = None) -> DataFrame:
    """(key, score) of the documents that hold a term; the best score is the least.

    Frequencies are counted inside each document's row; only one row of totals is gathered, so the
    ranking needs no shuffle of documents or tokens. Totals are over all documents given. They are read twice;
    where their tokens are not at hand, the counts are written to a folder in between.
    """
    keys = [key] if isinstance(key, str) else key
    phrases = [[t] if isinstance(t, str) else t for t in terms]
    counted = docs.select(*keys, F.size("tokens").alias("len"), *(_occurrences(p).alias(f"f{i}") for i, p in enumerate(phrases)))
    if folder:
        path = os.path.join(folder, f"counts-{uuid.uuid4().hex}")
        counted.write.parquet(path)
        counted = docs.sparkSession.read.schema(counted.schema).parquet(path)
    sums = counted.agg(F.count("*"), F.sum("len"), *(F.count_if(F.col(f"f{i}") > 0) for i in range(len(phrases)))).first()
    n = sums[0] if total is None else total
    if not n or not phrases:
        return counted.where("false").select(*keys, F.lit(0.0).alias("score"))
    average = (sums[1] or 0) / n or 1.0
    score = F.lit(0.0)
    for i in range(len(phrases)):
        df = sums[2 + i]
        weight = F.greatest(F.ln(F.lit((n - df + 0.5) / (df + 0.5))), F.lit(LEAST))
        f = F.col(f"f{i}")
        score += weight * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / average))
    some = F.greatest(*(F.col(f"f{i}") for i in range(len(phrases))), F.lit(0)) > 0
    return counted.where(some).select(*keys, (-score).alias("score"))
