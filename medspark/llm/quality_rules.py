"""Host-level quality rules, in DataFrame functions only.

Every document is measured and held against the rules.  Failures are counted by
host; each rule's rate is shrunk towards all hosts by a beta prior whose two
parameters are estimated from the hosts themselves (moments of their rates), so
a host with few documents is not condemned by one of them.  A host whose shrunk
rate passes the limit for some rule fails, and with it its documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medspark.llm.storage import written
from medspark.llm.texts import fresh

SPACES = r"[\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
RULES = ("few_words", "repeats", "symbols", "dup_lines", "word_length")
HOST_LIMIT = 0.5  # of a rule's shrunk failure rate


def _bound(value: Column, make) -> Column:
    """``make(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), make), 1)


def _repeated(grams: Column) -> Column:
    """Words in the windows (hashes, by position) that occur twice or more."""
    def covered(at):
        steps = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda total, step: total + step)

    def twice(rows):
        def same(other, x):
            return F.coalesce(other["h"] == x["h"], F.lit(False))
        kept = F.filter(rows, lambda x, k: same(F.get(rows, k - 1), x) | same(F.get(rows, k + 1), x))
        return F.sort_array(F.transform(kept, lambda x: x["i"]))

    rows = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return (F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("bigint"))
            .otherwise(_bound(_bound(rows, twice), covered)))


def measures(text: Column) -> Column:
    """Struct of a text's measures; a NULL text measures as an empty one."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES + "+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")

    def of_words(w):
        n = F.size(w)
        grams = F.when(n >= WINDOW, F.transform(
            F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))),
            lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)]))).otherwise(
                F.array().cast("array<bigint>"))
        return F.struct(
            n.cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
            _bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            _bound(lines, F.size).cast("bigint").alias("n_lines"),
            _bound(grams, _repeated).alias("n_repeat_words"))

    return _bound(words, of_words)


def rules(m: Column) -> dict[str, Column]:
    """Failures by rule; the first two reject a document by themselves."""
    return {
        "few_words": m["n_words"] < MIN_WORDS,
        "repeats": 100 * m["n_repeat_words"] > MAX_REPEATED_PERCENT * m["n_words"],
        "symbols": 10 * m["n_symbols"] > m["n_words"],
        "dup_lines": 10 * m["n_dup_lines"] > 3 * m["n_lines"],
        "word_length": (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 12 * m["n_words"]),
    }


def _packed(failures: dict[str, Column]) -> Column:
    """A bit for each failure, in the order of ``RULES``."""
    return reduce(lambda a, b: a.bitwiseOR(b),
                  [F.when(failures[k], F.lit(1 << i)).otherwise(F.lit(0)) for i, k in enumerate(RULES)])


def base_failed(m: Column) -> Column:
    return rules(m)["few_words"] | rules(m)["repeats"]


def host_rates(measured: DataFrame, host: str, failures: dict[str, Column]) -> DataFrame:
    """One row per host that has a name: documents, and each rule's shrunk rate."""
    hosts = (measured.where(F.col(host).isNotNull()).groupBy(F.col(host).cast("string").alias("host"))
             .agg(F.count(F.lit(1)).alias("n"), *[F.sum(v.cast("int")).alias(f"k_{k}") for k, v in failures.items()]))

    def moments(k):
        rate = F.col(f"k_{k}") / F.col("n")
        mean = F.avg(rate)
        noise = mean * (1 - mean) * F.avg(1 / F.col("n"))  # of counting alone
        return F.struct(mean.alias("mean"), (F.var_pop(rate) - noise).alias("spread")).alias(f"p_{k}")

    prior = hosts.agg(*[moments(k) for k in failures])

    def shrunk(k):
        p = F.col(f"p_{k}")
        variance = p["mean"] * (1 - p["mean"])
        strength = F.when(p["spread"] * 1e6 > variance, F.greatest(variance / p["spread"] - 1, F.lit(1.0))
                          ).otherwise(F.lit(1e6))  # alpha + beta
        return ((F.col(f"k_{k}") + p["mean"] * strength) / (F.col("n") + strength)).alias(f"rate_{k}")

    # the prior is one row
    return hosts.crossJoin(F.broadcast(prior)).select("host", "n", *[shrunk(k) for k in failures])


def host_verdicts(rates: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """(host, host_failed): some rule's shrunk rate is above ``limit``."""
    failed = reduce(lambda a, b: a | b, [F.col(c) > limit for c in rates.columns if c.startswith("rate_")])
    return rates.select("host", failed.alias("host_failed"))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
          host_limit: float = HOST_LIMIT) -> DataFrame:
    """One row per input row: id, measures, base_failed, host_failed, kept.

    NULL and empty texts have no words and fail; documents without a host are
    judged alone; repeated rows and NULL ids each keep their row."""
    measured = written(df.select(F.col(id_col), F.col(host_col).cast("string").alias("_host"),
                                 measures(F.col(text_col)).alias("_m")), "measures")
    # written, so that its size decides how it is joined, and a hot host can be split
    m = F.col("_m")
    verdicts = written(host_verdicts(host_rates(measured, "_host", rules(m)), host_limit), "hosts")
    return (measured.join(verdicts, F.col("_host") == F.col("host"), "left")
            .select(id_col, *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines",
                                                      "n_repeat_words")],
                    base_failed(m).alias("base_failed"),
                    F.coalesce(F.col("host_failed"), F.lit(False)).alias("host_failed"))
            .withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed")))


def keep_good(df: DataFrame, text_col: str = "text", host_col: str = "source",
              host_limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of ``df`` that pass, all columns.  Texts are measured once: rows are
    written with their failures as bits, hosts are counted from these, and the table
    of failing hosts is written so that its size decides how it is joined."""
    bits, name = fresh(df, "failures"), fresh(df, "host")
    names = {k: F.col(bits).bitwiseAND(F.lit(1 << i)) != 0 for i, k in enumerate(RULES)}
    rows = written(df.withColumn(bits, _bound(measures(F.col(text_col)), lambda m: _packed(rules(m)))), "measured")
    bad = written(host_verdicts(host_rates(rows, host_col, names), host_limit).where("host_failed"), "hosts")
    good = rows.where(~names["few_words"] & ~names["repeats"])
    return good.join(bad.select(F.col("host").alias(name)), F.col(host_col).cast("string") == F.col(name),
                     "left_anti").drop(bits)
