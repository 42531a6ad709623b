"""Operator 6: URL filtering by rules and by the likelihood ratio of two character models. DataFrame operations only.

Rules name a host and a path prefix; the longest that fits decides. Where none fits, the URL's
characters (host and path between a start and an end mark) are scored by two Markov models of variable
order, one of the URLs that rules allow and one of those that they block. A context of up to ORDER
characters counts; the estimate of each order is smoothed with that of the next shorter:
p(c | context) = (n(context c) + PULL p(c | shorter)) / (n(context) + PULL). The difference of the two
log likelihoods a character is held against a threshold that is calibrated on labelled URLs which
the models have not seen: the point where the normal curves of both classes lie equally far off.

Counts are exact, under the n-grams themselves, whatever their number. What a character adds to a URL's
ratio follows from its window alone, the character with up to ORDER before it. So the counts are looked up
once for each distinct window, and a URL's ratio is the sum over its windows: those among the most frequent
FREQUENT are sent to every task, the others are joined by key, of which each has at most one in FREQUENT
of all characters. N-grams of one or two characters are in many windows and are dealt out in SPREAD copies.
Sums are of whole multiples of 1 / UNIT, so their order does not matter.

Defined results: a null url or one without `://` has an empty host and path, fits no rule and is judged
by the models like any other; without labelled URLs the ratio is 0, the threshold 0 and the verdict
allow; repeated rows count each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

ALLOW, BLOCK = "allow", "block"
#: Host, path prefix, verdict.
RULES = (("org", "/", ALLOW), ("example.org", "/es/", BLOCK), ("example.org", "/en/1", BLOCK), ("com", "/fr/", ALLOW), ("com", "/de/", BLOCK))

ORDER = 4
PULL = 4.0
#: Characters that the shortest estimate spreads its half counts over.
ALPHABET = 128
#: One labelled URL in so many is kept from training, for calibration.
CALIBRATION = 5
#: Windows with more than one in so many of all characters are sent to every task; there are fewer than this.
FREQUENT = 10_000
#: Copies of the counts of n-grams of 1 and 2 characters in the join with the windows.
SPREAD = {1: 64, 2: 16}
#: The ratio of a character is rounded to whole multiples of 1 / UNIT.
UNIT = float(1 << 36)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def ruled(rows: DataFrame, rules=RULES) -> DataFrame:
    """rows with `rule` and `ruling` of the longest rule that fits host and path; null where none does."""
    rule = ruling = None
    for host, path, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        ruling = F.when(fits, verdict) if ruling is None else ruling.when(fits, verdict)
    none = F.lit(None).cast("string")
    return rows.withColumns({"rule": none if rule is None else rule, "ruling": none if ruling is None else ruling})


def marked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("marked", F.concat(F.lit("\x02"), "host", "path", F.lit("\x03")))


def windows(rows: DataFrame, *keep: str) -> DataFrame:
    """(*keep, at, window) of every character of `marked`: its place from 1, and it with up to ORDER before it."""
    ends = F.sequence(F.lit(1), F.length("marked"))
    each = F.transform(ends, lambda i: F.struct(i.alias("at"), F.substr("marked", F.greatest(i - ORDER, F.lit(1)), F.least(i, F.lit(ORDER + 1))).alias("window")))
    return rows.select(*keep, F.explode(each).alias("x")).select(*keep, "x.at", "x.window")


def models(labelled: DataFrame) -> DataFrame:
    """(piece, allow, block): exact counts of all n-grams of 1 to ORDER + 1 characters."""
    sums = [F.count_if(F.col("ruling") == v).alias(v) for v in (ALLOW, BLOCK)]
    by_window = windows(labelled, "ruling").groupBy("window").agg(*sums)
    pieces = F.transform(F.sequence(F.lit(1), F.length("window")), lambda n: F.substr("window", F.length("window") - n + 1, n))
    return by_window.select(F.explode(pieces).alias("piece"), ALLOW, BLOCK).groupBy("piece").agg(*(F.sum(v).alias(v) for v in (ALLOW, BLOCK)))


def _spread(n: Column) -> Column:
    """Copies of an n-gram of n characters."""
    out = F.lit(1)
    for k, copies in SPREAD.items():
        out = F.when(n == k, copies).otherwise(out)
    return out


def _window_ratios(found: DataFrame, counts: DataFrame) -> DataFrame:
    """(window, uses, units): found with log p(allowed) - log p(blocked) of the last character after the others, times UNIT."""
    size = F.length("window")
    # place k < ORDER + 1: the n-gram of k + 1 characters that ends here; then: the context of k - ORDER characters
    own = [F.when(size >= n, F.struct(F.lit(n - 1).alias("k"), F.substr("window", size - n + 1, F.lit(n)).alias("piece"))) for n in range(1, ORDER + 2)]
    before = [F.when(size > n, F.struct(F.lit(ORDER + n).alias("k"), F.substr("window", size - n, F.lit(n)).alias("piece"))) for n in range(1, ORDER + 1)]
    asked = found.select("window", "uses", F.explode(F.filter(F.array(*own, *before), lambda x: x.isNotNull())).alias("x")).select("window", "uses", "x.k", "x.piece")
    asked = asked.withColumn("copy", F.pmod(F.xxhash64("window"), _spread(F.length("piece"))).cast("int"))
    copies = counts.withColumn("copy", F.explode(F.sequence(F.lit(0), _spread(F.length("piece")) - 1)))
    told = asked.join(copies, ["piece", "copy"], "left").groupBy("window", "uses")
    places = range(2 * ORDER + 1)
    told = told.agg(*(F.coalesce(F.max(F.when(F.col("k") == k, F.col(v))), F.lit(0)).cast("double").alias(f"{v}{k}") for v in (ALLOW, BLOCK) for k in places))
    totals = counts.where(F.length("piece") == 1).agg(*(F.coalesce(F.sum(v), F.lit(0)).cast("double").alias(f"{v}_total") for v in (ALLOW, BLOCK)))
    told = told.crossJoin(F.broadcast(totals))

    def log_probability(v: str) -> Column:
        p = (F.col(f"{v}0") + 0.5) / (F.col(f"{v}_total") + 0.5 * ALPHABET)
        for n in range(1, ORDER + 1):
            p = (F.col(f"{v}{n}") + PULL * p) / (F.col(f"{v}{ORDER + n}") + PULL)
        return F.ln(p)

    some = (F.col(f"{ALLOW}_total") > 0) & (F.col(f"{BLOCK}_total") > 0)
    units = F.when(some, F.round((log_probability(ALLOW) - log_probability(BLOCK)) * UNIT)).otherwise(0.0)
    return told.select("window", "uses", units.cast("bigint").alias("units"))


def with_log_ratio(rows: DataFrame, fitted_models: DataFrame) -> DataFrame:
    """rows with log_ratio: log p(allowed) - log p(blocked) a character of `marked`; 0 if a model is empty."""
    rows = stage(rows.withColumn("_row", F.monotonically_increasing_id()), "url-rows")
    found = windows(rows).where("at > 1").groupBy("window").agg(F.count("*").alias("uses"))
    ratios = stage(_window_ratios(found, fitted_models), "url-windows")
    frequent = F.col("uses") * FREQUENT > ratios.agg(F.sum("uses")).scalar()
    each = windows(rows, "_row").where("at > 1").join(F.broadcast(ratios.where(frequent).select("window", "units")), "window", "left")
    known = each.where("units is not null").select("_row", "units")
    rare = each.where("units is null").select("_row", "window").join(ratios.where(~frequent).select("window", "units"), "window").select("_row", "units")
    sums = known.union(rare).groupBy("_row").agg(F.sum("units").alias("units"))
    return rows.join(sums, "_row").withColumn("log_ratio", F.col("units") / UNIT / (F.length("marked") - 1)).drop("_row", "units")


def fitted(rows: DataFrame) -> tuple[DataFrame, float]:
    """rows with log_ratio by the models learned from the rows that have a ruling, and the threshold for it."""
    held = F.pmod(F.xxhash64("marked", F.lit(1)), F.lit(CALIBRATION)) == 0
    labelled = F.col("ruling").isNotNull()
    told_models = stage(models(rows.where(labelled & ~held)), "url-models")
    scored = stage(with_log_ratio(rows, told_models), "url-ratios")
    told = {r[0]: r[1:] for r in scored.where(labelled & held).groupBy("ruling").agg(F.avg("log_ratio"), F.coalesce(F.stddev_pop("log_ratio"), F.lit(0.0))).collect()}
    if len(told) < 2:
        return scored, 0.0
    (good, good_dev), (bad, bad_dev) = told[ALLOW], told[BLOCK]
    spread = good_dev + bad_dev
    return scored, (good * bad_dev + bad * good_dev) / spread if spread > 0 else (good + bad) / 2


def judged(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, log_ratio) of every row."""
    host, path = host_and_path(F.coalesce(F.col(url_col), F.lit("")))
    rows = marked(ruled(pages.select(F.col(id_col), host.alias("host"), path.alias("path")), rules))
    out, threshold = fitted(rows)
    verdict = F.coalesce("ruling", F.when(F.col("log_ratio") >= threshold, ALLOW).otherwise(BLOCK))
    return out.select(id_col, "host", "path", "rule", verdict.alias("verdict"), "log_ratio")
