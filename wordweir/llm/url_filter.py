"""URL filters by the ratio of two character language models, in DataFrame functions only.

Rules decide first: the longest that fits host and path. The urls that rules decide are the labelled data of two models, of
accepted and of rejected urls: variable-order Markov models over all characters (A-Z lower-cased), with interpolated
Witten-Bell smoothing. A context is used if urls hold it at least ``EVIDENCE`` times; else the longest shorter one that they do, down to none,
and below that a uniform distribution over the characters met. Contexts have up to ``ORDER`` characters. A url's score is the mean, over
its characters, of the log of the models' ratio; the threshold is where acceptance of accepted and rejection of rejected urls
are best balanced on a fifth of the labelled urls (by hash) that the counts leave out.

All counts are distributed tables: a row for each string of ``ORDER`` + 1 characters that urls hold, with its numbers in both models. The
smoothed ratio of each comes by joins from the shortest contexts to the longest, and is joined back to the characters of the urls.
So what is gathered grows with the urls. Ratios are broadcast if they are few (``FEW`` rows of some 40 bytes); else only those
of hot strings are, and the others are joined by a shuffle. Only the calibration histogram (at most 2 * 4001 rows) comes to the driver.

Defined cases: a null url, or one without ://, has an empty host and path, and no rule fits; a url without
characters scores 0; without labelled urls of both kinds every score passes; repeated rows are judged, and counted, each. Row numbers
join scores to pages, so ``pages`` is a table, or has been cut.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import A_Z, a_z, cut, forget, hot_join, once

ORDER, EVIDENCE = 5, 4
#: What stands before a url, and the digits after the point of a log ratio.
PAD, DIGITS = "\x02", 4
FEW = 50_000
BIN, SPREAD = 100, 20
#: (host and path, verdict)
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
MAX_RULES = 1000


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, pattern, k), F.lit("")) for k in (1, 2))
    return F.translate(host, A_Z, a_z), path


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (of equally long ones the first in order) and its verdict; null if none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} go into one expression")
    rule = verdict = F.lit(None).cast("string")
    for text, word in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, word).otherwise(verdict)
    return rule, verdict


def strings(url: Column) -> Column:
    """Each character with the ORDER before it."""
    chars = F.filter(F.split(F.translate(url, A_Z, a_z), "", -1), lambda c: c != "")
    padded = F.concat(F.array(*[F.lit(PAD)] * ORDER), chars)

    def each(c: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(c) - 1 - ORDER), lambda i: F.concat(*(F.get(c, i + k) for k in range(ORDER + 1))))

    return F.when(url.isNotNull() & (F.length(url) > 0), once(padded, each)).otherwise(F.array().cast("array<string>"))


def counted(rows: DataFrame) -> DataFrame:
    """rows: (url, good: label of a row that counts, else null) -> (string, good, bad, size): occurrences in either model and in all urls."""
    found = rows.select(F.explode(strings(F.col("url"))).alias("string"), "good")
    one = lambda c: F.count(F.when(c, True))
    return found.groupBy("string").agg(one(F.col("good")).alias("good"), one(~F.col("good")).alias("bad"), F.count("*").alias("size"))


def smoothed(counts: DataFrame) -> DataFrame:
    """(string, size, ratio): log of the ratio of the models' probabilities of the last character after the others, times 10 ** DIGITS."""
    alphabet = max(1, counts.select(F.right("string", F.lit(1))).distinct().count())
    below = None
    for k in range(ORDER + 1):
        last = F.right("string", F.lit(k + 1))
        here = counts.groupBy(last.alias("w")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        here = here.withColumns({"h": F.left("w", F.length("w") - 1), "s": F.right("w", F.length("w") - 1)})
        kinds = [F.count(F.when(F.col(c) > 0, True)).alias(f"{c}_kinds") for c in ("good", "bad")]
        contexts = here.groupBy("h").agg(*(F.sum(c).alias(f"{c}_all") for c in ("good", "bad")), *kinds).where(F.col("good_all") + F.col("bad_all") >= EVIDENCE)
        here = here.join(contexts, "h", "left")
        if below is None:
            here = here.withColumns({f"{c}_below": F.lit(1.0 / alphabet) for c in ("good", "bad")})
        else:
            here = here.join(below.select(F.col("w").alias("s"), *(F.col(f"{c}_p").alias(f"{c}_below") for c in ("good", "bad"))), "s")

        def p(c: str) -> Column:
            mixed = (F.col(c) + F.col(f"{c}_kinds") * F.col(f"{c}_below")) / (F.col(f"{c}_all") + F.col(f"{c}_kinds"))
            return F.when(F.col(f"{c}_all") > 0, mixed).otherwise(F.col(f"{c}_below")).alias(f"{c}_p")

        below = here.select("w", p("good"), p("bad"))
    ratio = F.round((F.ln("good_p") - F.ln("bad_p")) * 10**DIGITS).cast("bigint")
    return counts.select("string", "size").join(below.select(F.col("w").alias("string"), ratio.alias("ratio")), "string")


def best_threshold(histogram: list[tuple[bool, int, int]]) -> float:
    """histogram: (accepted, bin, urls). Where acceptance and rejection rates add up to most; of equals, next to 0."""
    sums = {True: 0, False: 0}
    for good, _, n in histogram:
        sums[good] += n
    if not sums[True] or not sums[False]:
        return -math.inf
    cuts = {b for _, b, _ in histogram} | {b + 1 for _, b, _ in histogram}

    def gain(t: int) -> tuple[float, int]:
        return sum((n / sums[g]) * ((b >= t) == g) for g, b, n in histogram), -abs(t)

    return max(cuts, key=gain) / BIN


def scored(rows: DataFrame, ratios: DataFrame) -> DataFrame:
    """(row, score) of the rows (row, url) whose url has characters."""
    found = rows.select("row", F.explode(strings(F.col("url"))).alias("string"))
    sizes = ratios.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if sizes[0] <= FEW:
        found = found.join(F.broadcast(ratios.select("string", "ratio")), "string")
    else:
        found = hot_join(found, ratios, "string", sizes[1])
    # whole numbers are summed, so that no order of summation shows
    return found.groupBy("row").agg((F.sum("ratio") / F.count("*") / 10**DIGITS).alias("score"))


def judge(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, learn: Column | None = None,
) -> DataFrame:
    """Per page: id, host, path, rule, score, method (the models' verdict) and verdict (the rule's, else the models').

    Counts, scores and calibrates at once. ``learn``: of the labelled pages, those that may be learned from (default: all).
    """
    url = F.col(url_col)
    host, path = host_and_path(url)
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), url.alias("url"), host.alias("host"), path.alias("path"),
        (F.lit(True) if learn is None else learn).alias("learn"),
    )
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "said": said})
    label = F.when(F.col("learn"), F.col("said") == "allow")
    held = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    counts = cut(counted(rows.select("url", F.when(~held, label).alias("good"))))
    ratios = cut(smoothed(counts))
    forget(counts)
    scores = cut(scored(rows, ratios))
    forget(ratios)
    rows = rows.join(scores, "row", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    bins = F.floor(F.greatest(F.least("score", F.lit(SPREAD)), F.lit(-SPREAD)) * BIN).cast("int")
    histogram = rows.where(held & label.isNotNull()).groupBy(label.alias("good"), bins.alias("bin")).count().collect()
    least = best_threshold([(r["good"], r["bin"], r["count"]) for r in histogram])
    method = F.when(F.col("score") >= F.lit(least), "allow").otherwise("block")
    rows = rows.select(F.col("id").alias(id_col), "host", "path", "rule", "score", "said", method.alias("method"))
    return rows.select(id_col, "host", "path", "rule", "score", "method", F.coalesce("said", "method").alias("verdict"))
