"""Quality rules by host.

Each document is measured and held against a few rules. Failures are then added up by host,
every host's failure rate of every rule is shrunk towards the corpus by a beta prior whose
parameters come from the spread of the rates over hosts (method of moments), and hosts whose shrunk
rate is too high for any rule are rejected. Their verdict is joined back to the documents: a
document stays if it passes the base rules and its host is not rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Rules besides the base rules count towards a host only.
RULES = ("few_words", "repeats", "symbols", "dup_lines")
MAX_HOST_RATE = 0.5
#: Beta prior where rates do not differ, or there is one host: so many documents of mean rate.
STRONG = 1000.0
WEAK = 1.0


def covered(starts: Column, width: int = 3) -> Column:
    """Positions covered by windows of ``width`` at the given, ascending, different starts."""
    total = F.aggregate(
        starts,
        F.struct(F.lit(-width).cast("bigint").alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda a, s: F.struct(
            s.cast("bigint").alias("last"),
            (a["n"] + F.least(F.lit(width), s - a["last"])).cast("bigint").alias("n"),
        ),
    )
    return total["n"]


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (all long).

    ``n_repeat_words`` counts the words that lie in a window of three words found twice or more
    in the text, first occurrence included, each word once. Windows are compared by 64-bit hash
    of their three words. A null text counts as empty; all of an empty text's measures are zero.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    # A window's hash and place are sorted together only where some hash occurs twice.
    rows = docs.withColumn("_words", words(text))
    rows = rows.withColumn("n_words", F.size("_words").cast("bigint"))
    rows = rows.withColumn(
        "_windows",
        F.when(
            F.col("n_words") >= 3,
            F.transform(
                F.arrays_zip(
                    F.slice("_words", F.lit(1), F.size("_words") - 2).alias("a"),
                    F.slice("_words", F.lit(2), F.size("_words") - 2).alias("b"),
                    F.slice("_words", F.lit(3), F.size("_words") - 2).alias("c"),
                ),
                lambda w: F.xxhash64(w["a"], w["b"], w["c"]),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    rows = rows.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(
                F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
            ),
        ),
    )

    def again(x: Column, i: Column) -> Column:
        before = F.get(F.col("_sorted"), i - 1)["h"]
        after = F.get(F.col("_sorted"), i + 1)["h"]
        return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

    starts = F.sort_array(F.transform(F.filter("_sorted", again), lambda x: x["i"]))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("_lines", lines)
    return rows.select(
        *docs.columns,
        "n_words",
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.col("_sorted").isNull(), F.lit(0).cast("bigint"))
        .otherwise(covered(starts))
        .alias("n_repeat_words"),
    )


def failures() -> dict[str, Column]:
    """Rules over the measures, true where a document fails."""
    n = F.col("n_words")
    return {
        "few_words": n < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > 50 * n,
        "symbols": 10 * F.col("n_symbols") > F.col("word_chars"),
        "dup_lines": 20 * F.col("n_dup_lines") > n,
    }


def host_rates(measured: DataFrame, host_col: str = "source") -> DataFrame:
    """``host, rule, n_docs, n_failed, rate``: a row for each host and rule, rate shrunk.

    With m the mean of the hosts' raw rates and v their variance beyond what m(1-m) and the
    hosts' sizes explain, the prior is Beta(m k, (1-m) k) with k = m(1-m)/v - 1, held between
    ``WEAK`` and ``STRONG``. Counting combines on the map side, so a host with a third of all rows
    is one row for each task. The statistics over hosts are one row a rule.
    """
    failed = failures()
    counts = measured.groupBy(F.col(host_col).alias("host")).agg(
        F.count(F.lit(1)).alias("n_docs"),
        *[F.sum(failed[r].cast("bigint")).alias(r) for r in RULES],
    )
    rows = counts.select(
        "host",
        "n_docs",
        F.explode(
            F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("n_failed")) for r in RULES])
        ).alias("r"),
    ).select("host", "n_docs", "r.rule", "r.n_failed")
    raw = F.col("n_failed") / F.col("n_docs")
    prior = rows.groupBy("rule").agg(
        F.avg(raw).alias("m"),
        F.coalesce(F.var_pop(raw), F.lit(0.0)).alias("v"),
        F.avg(1 / F.col("n_docs")).alias("inverse"),
    )
    spread = F.col("m") * (1 - F.col("m"))
    extra = F.col("v") - spread * F.col("inverse")
    strength = F.when(extra > 0, spread / F.nullif(extra, F.lit(0.0)) - 1).otherwise(F.lit(STRONG))
    prior = prior.select(
        F.col("rule"),
        "m",
        F.least(F.lit(STRONG), F.greatest(F.lit(WEAK), strength)).alias("k"),
    )
    rate = (F.col("n_failed") + F.col("m") * F.col("k")) / (F.col("n_docs") + F.col("k"))
    return rows.join(prior, "rule").select("host", "rule", "n_docs", "n_failed", rate.alias("rate"))


def rejected_hosts(rates: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``host, failed_rules`` of the hosts whose shrunk rate of some rule exceeds ``max_rate``."""
    bad = rates.filter(F.col("rate") > max_rate)
    return bad.groupBy("host").agg(F.array_sort(F.collect_set("rule")).alias("failed_rules"))


def judge(
    measured: DataFrame, host_col: str = "source", max_rate: float = MAX_HOST_RATE
) -> DataFrame:
    """Add ``base_failed`` and ``kept`` to measured documents (see ``measure``).

    A null host is a host like any other. Repeated rows count each time and stay repeated. An
    empty table gives an empty result. Only rejected hosts take part in the join back.
    """
    failed = failures()
    bad = rejected_hosts(host_rates(measured, host_col), max_rate).select(
        F.col("host").alias("_bad_host"), F.lit(True).alias("_bad")
    )
    rows = measured.withColumn("base_failed", failed["few_words"] | failed["repeats"])
    joined = rows.join(bad, F.col(host_col).eqNullSafe(F.col("_bad_host")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("_bad").isNull()).drop(
        "_bad_host", "_bad"
    )
