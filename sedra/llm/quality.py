"""Quality rules with host verdicts, in DataFrame functions only.

Each document is measured by itself. Failures of the soft rules are then summed
by host, host rates are shrunk with an empirical beta prior, and a host whose
shrunk rate for a rule is above `host_limit` has that rule enforced: its
documents that break it are rejected. A document that breaks no rule is kept
whatever its host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BLANKS, packed, words_of, written

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _repeat_words(hashes: Column, ordered: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more; ordered: the sorted (hash, position) pairs."""
    same = lambda k, d: F.coalesce(F.get(ordered, k + d)["h"] == F.get(ordered, k)["h"], F.lit(False))
    twice = F.filter(ordered, lambda p, k: same(k, -1) | same(k, 1))
    return F.sort_array(F.transform(twice, lambda p: p["i"]))


def measured(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """Struct `row` with the input row, `host`, and MEASURES as longs.

    Null and empty texts measure zero everywhere. Windows are compared by their
    64-bit hash within one text.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    out = packed(docs, host=F.col(host), body=body, words=words_of(F.col(text)))
    lines = F.filter(F.split("body", "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    n = F.size("words")
    windows = F.when(n < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))
    )
    out = out.select(
        "row",
        "host",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        windows.alias("windows"),
    )
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    pairs = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    out = out.withColumns(
        {
            "n_lines": F.size("lines").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "ordered": F.when(twice, F.sort_array(pairs)),
        }
    )
    out = out.withColumn("starts", F.when(F.col("ordered").isNotNull(), _repeat_words(F.col("windows"), F.col("ordered"))))
    covered = F.transform("starts", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", k + 1) - p, F.lit(WINDOW))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return out.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).select("row", "host", *MEASURES)


def base_failed() -> Column:
    """The base rule: too short, or too many repeated words."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def soft_rules() -> dict[str, Column]:
    """Rules that alone are too weak to reject a document."""
    n = F.col("n_words")
    return {
        "symbols": 10 * F.col("n_symbols") > n,
        "lines": 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
        "length": (F.col("word_chars") > 12 * n) | (F.col("word_chars") < 2 * n),
    }


def host_verdicts(table: DataFrame, host_limit: float = 0.5) -> DataFrame:
    """Per host key: `enforced`, the names of the rules enforced there; hosts without any are left out.

    The prior of each rule is fitted by moments over all hosts: mean m is the
    overall failure rate, v the variance of host rates, and the prior weighs
    m(1-m)/v - 1 documents, from 1 to 10,000. Partial sums go before the shuffle,
    so a host with a third of all rows is one row per task.
    """
    rules = soft_rules()
    hosts = table.groupBy(host_key().alias("host_key")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c.cast("long")).alias(r) for r, c in rules.items()]
    )
    hosts = written(hosts, "hosts")
    fit = []
    for r in rules:
        m, v = F.sum(r) / F.sum("n"), F.var_pop(F.col(r) / F.col("n"))
        weight = F.greatest(F.lit(1.0), F.least(F.lit(1e4), F.when(v > 0, m * (1 - m) / v - 1).otherwise(F.lit(1e4))))
        fit += [m.alias(f"{r}_m"), weight.alias(f"{r}_w")]
    prior = hosts.agg(*fit).first()  # two numbers for each rule; null if there is no host
    value = lambda c: F.lit(prior[c]).cast("double")
    rate = {r: (F.col(r) + value(f"{r}_m") * value(f"{r}_w")) / (F.col("n") + value(f"{r}_w")) for r in rules}
    enforced = F.array_compact(F.array(*[F.when(rate[r] > host_limit, F.lit(r)) for r in rules]))
    return hosts.select("host_key", enforced.alias("enforced")).where(F.size("enforced") > 0)


def host_key() -> Column:
    """A key that is never null: null hosts are one host."""
    return F.when(F.col("host").isNull(), F.lit("n")).otherwise(F.concat(F.lit("h"), F.col("host").cast("string")))


def judged(table: DataFrame, host_limit: float = 0.5) -> DataFrame:
    """A written table of measured() with `base_failed`, `enforced` and `kept`.

    Only hosts with a verdict are joined; they are written first, so the planner
    knows their size. Beyond its broadcast limit the join shuffles, and a hot
    host is split by adaptive execution.
    """
    verdicts = written(host_verdicts(table, host_limit), "verdicts")
    out = table.withColumn("host_key", host_key()).join(verdicts, "host_key", "left")
    broken = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in soft_rules().items()]))
    hit = F.coalesce(F.arrays_overlap("enforced", broken), F.lit(False))
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~hit)


def quality_table(docs: DataFrame, text: str = "text", host: str = "source", host_limit: float = 0.5) -> DataFrame:
    """docs, measured and judged: struct `row` (the input row), MEASURES, base_failed, kept.

    Nulls: a null text has no words and fails the base rule; null hosts count as
    one host. Repeated rows are judged alike, one by one. An empty table gives an
    empty table. Input columns of any name stay inside `row`.
    """
    return judged(written(measured(docs, text, host), "quality"), host_limit)


def quality_filter(docs: DataFrame, text: str = "text", host: str = "source", host_limit: float = 0.5) -> DataFrame:
    """The rows of docs that are kept, unchanged."""
    return quality_table(docs, text, host, host_limit).where("kept").select("row.*")
