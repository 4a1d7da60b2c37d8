"""Host-level quality rules, with DataFrame functions only.

Each document is checked by per-text rules; the failures are summed by host (``source``); host failure
rates are shrunk towards the mean of all hosts by a beta prior fitted to the hosts' own rates (method of
moments); a host whose shrunk rate is over ``max_rate`` is rejected as a whole, and that verdict is joined
back to its documents.

Scale: one scan of the texts gives a narrow table of counts (written once); hosts are one partial
aggregation; the join back is salted, so that a host with a third of all rows is dealt over ``salts`` tasks.
The host table is broadcast only by Spark's own check of its size.

Defined results: null text counts as an empty one (no words, base fails); documents without a host get no
host verdict; repeated rows are judged one by one; an empty table gives an empty result; hosts are compared
with each other only if there are two or more, a single host's rate is not shrunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, unused, words, written

SYMBOLS = "#*$%&|<>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for each row, also where lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(w: Column) -> Column:
    """Words covered by 3-word windows that the text holds twice or more."""
    n = F.size(w)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def marked(s: Column) -> Column:
        # equal windows stand next to each other after sorting by (hash, place)
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        hit = F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return F.size(F.array_distinct(F.flatten(F.transform(hit, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_let(ordered, marked))

    return F.when(n < 4, 0).otherwise(_let(windows, covered))


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t = F.coalesce(F.col(text), F.lit(""))
    w, lines = unused(docs, "_words", "_lines")
    out = docs.withColumns({w: words(F.col(text)), lines: F.filter(F.split(t, "\n", -1), lambda x: F.translate(x, SPACE, "") != "")})
    return out.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.translate(t, SPACE, "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": _repeat_words(F.col(w)).cast("long"),
        }
    ).drop(w, lines)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def host_rates(counted: DataFrame, failed: str = "base_failed", host: str = "source") -> DataFrame:
    """One row per host: docs, failures, and the rate shrunk by the empirical beta prior."""
    hosts = counted.where(F.col(host).isNotNull()).groupBy(host).agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col(failed).cast("long")).alias("host_failed"))
    rate = F.col("host_failed") / F.col("host_docs")
    # moments over hosts: a beta prior with mean m and strength s = m(1-m)/v - 1, v without the binomial noise
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_samp(rate).alias("v"), F.avg(1 / F.col("host_docs")).alias("inv"))
    m, v = F.col("m"), F.col("v")
    noise = m * (1 - m) * F.col("inv")
    strength = F.when(v > noise, F.greatest(m * (1 - m) / (v - noise) - 1, F.lit(0.0))).otherwise(F.when(v.isNull(), F.lit(0.0)).otherwise(F.lit(1e3)))
    prior = prior.select("m", strength.alias("s"))
    return hosts.join(F.broadcast(prior), F.lit(True)).select(host, "host_docs", "host_failed", ((F.col("host_failed") + m * F.col("s")) / (F.col("host_docs") + F.col("s"))).alias("host_rate"))


def judge(docs: DataFrame, max_rate: float = 0.5, host: str = "source", salts: int = 16) -> DataFrame:
    """``docs`` with the five counts, base_failed, host_docs, host_failed, host_rate and kept.

    Every column of ``docs`` passes through the written table, so select the few that are needed first.
    A column of ``docs`` named like one of the new ones is replaced.
    """
    counted = written(text_counts(docs).withColumn("base_failed", base_failed()).drop("host_docs", "host_failed", "host_rate", "kept"), "counts")
    return _join_hosts(counted, max_rate, host, salts)


def judge_narrow(docs: DataFrame, max_rate: float = 0.5, host: str = "source", salts: int = 16) -> DataFrame:
    """As ``judge``, for the digest only: the text is dropped before anything is written."""
    counted = text_counts(docs.select("doc_id", host, "text")).drop("text").withColumn("base_failed", base_failed())
    return _join_hosts(written(counted, "counts"), max_rate, host, salts)


def _join_hosts(counted: DataFrame, max_rate: float, host: str, salts: int) -> DataFrame:
    rates = written(host_rates(counted, "base_failed", host), "hosts")
    salt, = unused(counted, "_salt")
    spread = rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = counted.withColumn(salt, F.pmod(F.xxhash64(*[F.col(c) for c in ("doc_id", "n_words", "word_chars", "n_symbols")]), F.lit(salts)).cast("int"))
    joined = left.join(spread, [host, salt], "left").drop(salt)
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("host_rate") <= max_rate, F.lit(True)))
