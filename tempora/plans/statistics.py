"""Evaluation summaries and paired statistics over judged documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tempora.functions import stats
from tempora.sources.tables import JUDGED_SQL, judged, table


def _discordant(j: DataFrame, *group: str) -> DataFrame:
    return j.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("ref_ok").cast("long")).alias("ref_correct"),
        F.sum(F.col("cand_ok").cast("long")).alias("cand_correct"),
        F.sum((F.col("ref_ok") & ~F.col("cand_ok")).cast("long")).alias("b10"),
        F.sum((~F.col("ref_ok") & F.col("cand_ok")).cast("long")).alias("b01"),
    )


def wilson_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _discordant(judged(spark, sf_dir), "lang")
    low, high = stats.wilson(F.col("ref_correct"), F.col("n"))
    return d.select("lang", "n", "ref_correct", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def mcnemar_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _discordant(judged(spark, sf_dir), "source")
    p = stats.mcnemar(F.col("b01"), F.col("b10"))
    return d.select("source", "n", "b01", "b10", F.round((F.col("cand_correct") - F.col("ref_correct")) / F.col("n") * 100, 6).alias("delta"), F.round(p, 9).alias("p"))


def paired_mde(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _discordant(judged(spark, sf_dir), "lang")
    return d.select("lang", F.round(stats.paired_mde(F.col("b01") + F.col("b10"), F.col("n")), 6).alias("mde"), F.round(stats.paired_mde(F.col("b01") + F.col("b10"), F.col("n"), 0.9), 6).alias("mde_90"))


def holm_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _discordant(judged(spark, sf_dir), "source")
    p = d.withColumn("p", stats.mcnemar(F.col("b01"), F.col("b10"))).withColumn("all", F.lit(1))
    return stats.holm(p, "p", ["all"], "source").select("source", F.round("p", 9).alias("p"), F.round("p_holm", 9).alias("p_holm"), stats.stars(F.col("p_holm")).alias("stars"))


def system_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source as a system against the reference, adjusted over all, best first."""
    d = _discordant(judged(spark, sf_dir), "source").withColumn("p", stats.mcnemar(F.col("b01"), F.col("b10"))).withColumn("all", F.lit(1))
    h = stats.holm(d, "p", ["all"], "source").withColumn("delta", (F.col("cand_correct") - F.col("ref_correct")) / F.col("n") * 100)
    rank = F.row_number().over(Window.partitionBy("all").orderBy(F.desc(F.round("delta", 6)), "source"))
    return h.select("source", "n", F.round("delta", 6).alias("delta"), F.round("p_holm", 9).alias("p_holm"), rank.alias("rank"))


def verdict(p_holm: Column, delta: Column, n: Column) -> Column:
    """Significant and better; else inconclusive below the detectable difference; else worse or not significant."""
    return F.when((p_holm < 0.05) & (delta > 0), "SIGNIFICANT+").when(F.abs(delta) < stats.expected_mde(n), "inconclusive").when(delta < 0, "negative").otherwise("n.s.")


def budget_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages as budgets: paired test, adjusted, with a verdict."""
    d = _discordant(judged(spark, sf_dir), "lang").withColumn("p", stats.mcnemar(F.col("b01"), F.col("b10"))).withColumn("all", F.lit(1))
    h = stats.holm(d, "p", ["all"], "lang").withColumn("delta", (F.col("cand_correct") - F.col("ref_correct")) / F.col("n") * 100)
    oracle = judged(spark, sf_dir).groupBy("lang").agg(F.avg((F.col("ref_ok") | F.col("cand_ok")).cast("double")).alias("ceiling"))
    return h.join(oracle, "lang").select("lang", F.round("delta", 6).alias("delta"), F.round("p_holm", 9).alias("p_holm"), verdict(F.col("p_holm"), F.col("delta"), F.col("n")).alias("verdict"), F.round(F.col("ceiling") * 100, 6).alias("ceiling"))


def ordinals(rows: DataFrame, order: str, width: int = 4096) -> DataFrame:
    """Rows with their place ``at`` (from 0) in the order of a unique whole number.

    Places are counted within ranges of ``width``, and ranges before them by their sizes, so no task orders all rows.
    """
    r = rows.withColumn("_range", F.floor(F.col(order) / width).cast("long"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(F.lit(1)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = r.groupBy("_range").agg(F.count(F.lit(1)).alias("_size")).select("_range", before.alias("_first"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return r.withColumn("_w", within).join(firsts, "_range").withColumn("at", F.col("_first") + F.col("_w")).drop("_range", "_w", "_first")


def _sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged questions with the positional slice they fall into."""
    j = ordinals(judged(spark, sf_dir), "qidx")
    n = j.agg(F.count(F.lit(1)).alias("n"))
    r = F.col("at") / F.greatest(F.lit(1), F.col("n") - 1)
    return j.crossJoin(F.broadcast(n)).withColumn("slice", F.when(r < 0.3, "train").when(r < 0.6, "val").otherwise("test"))


def partition_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy on positional slices (first 30 %, next 30 %, rest) and on all."""
    s = _sliced(spark, sf_dir).withColumn("slice", F.explode(F.array("slice", F.lit("full"))))
    g = s.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ref_ok").cast("long")).alias("correct"))
    low, high = stats.wilson(F.col("correct"), F.col("n"))
    return g.select("slice", "n", "correct", F.round(F.col("correct") / F.col("n") * 100, 6).alias("accuracy"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def selection_band_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected best of 2, 5 and 20 equal systems on 200 questions, at each language's true share."""
    d = _discordant(judged(spark, sf_dir), "lang").withColumn("share", F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.col("ref_correct") / F.col("n"))))
    bands = [F.struct(F.lit(k).alias("k"), stats.selection_band(200, k, F.col("share")).alias("band")) for k in (2, 5, 20)]
    return d.withColumn("x", F.explode(F.array(*bands))).select("lang", F.col("x.k").alias("k"), F.round("x.band", 7).alias("band"))


def paired_bootstrap(spark: SparkSession, sf_dir: str, resamples: int = 2000, seed: int = 42) -> DataFrame:
    """Percentile interval of the paired difference.

    Only counts matter: a resample draws how many of n questions are won, lost
    and tied, from the multinomial law of the counts found. So its work does not grow with n.
    """
    d = _discordant(judged(spark, sf_dir), "lang").select("lang", "n", "b01", "b10")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, n, b01, b10 in batch.itertuples(index=False):
                rng = np.random.default_rng([seed, zlib.crc32(str(lang).encode())])
                drawn = rng.multinomial(n, [b01 / n, b10 / n, 1 - (b01 + b10) / n], size=resamples)
                yield pd.DataFrame({"lang": [lang] * resamples, "diff": (drawn[:, 0] - drawn[:, 1]) / n * 100})

    diff = d.mapInPandas(draw, "lang string, diff double")
    return diff.groupBy("lang").agg(F.count(F.lit(1)).alias("resamples"), F.percentile("diff", 0.025).alias("low"), F.percentile("diff", 0.975).alias("high"), F.avg("diff").alias("mean"))


def result_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, unparsed and valid answers of each source; a null language counts as unparsed."""
    j = judged(spark, sf_dir).withColumn("parse_fail", F.coalesce(F.col("lang") == "es", F.lit(True)))
    g = j.groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("ref_ok").cast("long")).alias("correct"), F.sum(F.col("parse_fail").cast("long")).alias("parse_fail"), F.sum((F.col("ref_ok") & ~F.col("parse_fail")).cast("long")).alias("valid_correct"))
    valid = F.col("total") - F.col("parse_fail")
    return g.select("source", "total", "correct", "parse_fail", valid.alias("valid"), F.round(F.col("correct") / F.col("total"), 6).alias("accuracy"), F.round(F.when(valid > 0, F.col("valid_correct") / valid).otherwise(0.0), 6).alias("valid_accuracy"))


def letter_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First letters of texts as predictions: trimmed, upper case, '?' where there is none."""
    letter = F.upper(F.substring(F.trim("text"), 1, 1))
    d = table(spark, sf_dir, "documents").select("source", F.when(letter.rlike("^[A-Z]$"), letter).otherwise("?").alias("letter"))
    return d.groupBy("source", "letter").agg(F.count(F.lit(1)).alias("n"))


def micro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled precision, recall and F1 of quality as a prediction of not being toxic."""
    j = judged(spark, sf_dir)
    g = j.groupBy("lang").agg(*[F.sum(c.cast("long")).alias(n) for n, c in (("tp", F.col("ref_ok") & F.col("cand_ok")), ("fp", F.col("ref_ok") & ~F.col("cand_ok")), ("fn", ~F.col("ref_ok") & F.col("cand_ok")))])
    p, r = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / (F.col("tp") + F.col("fn"))
    return g.select("lang", "tp", "fp", "fn", F.round(F.when(F.col("tp") > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))


def cost_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.floor(F.avg("n_chars")).cast("long").alias("context_chars"), F.bround(F.avg(F.col("n_chars") / 100), 2).alias("frames"))


def wrong_first_sample(spark: SparkSession, sf_dir: str, k: int = 24) -> DataFrame:
    """At most 24 judged questions of each source, wrong ones first."""
    order = Window.partitionBy("source").orderBy("ref_ok", "qidx")
    return judged(spark, sf_dir).withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select("source", "qidx", "ref_ok", "rank")


def count_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header counts against the vectors they summarise."""
    header = table(spark, sf_dir, "labels").groupBy(F.col("toxic").alias("system")).agg(F.count(F.lit(1)).alias("stated"))
    vector = judged(spark, sf_dir).groupBy((~F.col("cand_ok")).cast("int").alias("system")).agg(F.count(F.lit(1)).alias("counted"))
    return header.join(vector, "system", "left").select("system", "stated", F.coalesce("counted", F.lit(0)).alias("counted"), (F.col("stated") == F.coalesce("counted", F.lit(0))).alias("agrees"))


def selection_band_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of 2, 5 and 20 equal systems on 200 questions that chance exceeds once in twenty."""
    d = _discordant(judged(spark, sf_dir), "lang").withColumn("share", F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.col("ref_correct") / F.col("n"))))
    bands = [F.struct(F.lit(k).alias("k"), stats.selection_quantile(200, k, F.col("share")).alias("p95")) for k in (2, 5, 20)]
    return d.withColumn("x", F.explode(F.array(*bands))).select("lang", F.col("x.k").alias("k"), F.round("x.p95", 6).alias("p95"))


def compare_report(spark: SparkSession, sf_dir: str, candidates: int = 5) -> DataFrame:
    """Two systems on each source: shares, interval, exact test, detectable difference, and whether chance selection explains the gain."""
    d = _discordant(judged(spark, sf_dir), "source").withColumn("share", F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.col("ref_correct") / F.col("n"))))
    low, high = stats.wilson(F.col("cand_correct"), F.col("n"))
    delta = (F.col("cand_correct") - F.col("ref_correct")) / F.col("n") * 100
    gain = (stats.selection_band(200, candidates, F.col("share")) - F.col("share")) * 100
    return d.select(
        "source", "n", F.round(F.col("ref_correct") / F.col("n") * 100, 6).alias("acc_ref"), F.round(F.col("cand_correct") / F.col("n") * 100, 6).alias("acc_cand"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"),
        F.round(delta, 6).alias("delta"), (F.col("b01") + F.col("b10")).alias("discordant"), F.round(stats.mcnemar(F.col("b01"), F.col("b10")), 9).alias("p"),
        F.round(stats.expected_mde(F.col("n")), 6).alias("mde"), F.round(gain, 5).alias("band"), (F.round(delta, 5) <= F.round(gain, 5)).alias("inside_band"),
    )


def sweep_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source as a system; those that gain are told from selection noise (best of 20 at the pooled share)."""
    d = _discordant(judged(spark, sf_dir), "source")
    pooled = judged(spark, sf_dir).agg(F.avg(F.col("ref_ok").cast("double")).alias("share"))
    band = pooled.select(((stats.selection_band(200, 20, F.col("share")) - F.col("share")) * 100).alias("band"))
    s = d.crossJoin(F.broadcast(band)).withColumn("delta", (F.col("cand_correct") - F.col("ref_correct")) / F.col("n") * 100)
    flag = F.when(F.col("delta") <= 0, "").when(F.round("delta", 5) <= F.round("band", 5), "within selection noise").otherwise("exceeds selection band")
    return s.select("source", F.round("delta", 6).alias("delta"), F.round("band", 5).alias("band"), flag.alias("flag"))


def budget_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by number as budgets: verdicts, and whether the gain shrinks from the least budget to the largest."""
    j = judged(spark, sf_dir).withColumn("k", F.regexp_extract("source", r"(\d+)$", 1).cast("int")).where("k IS NOT NULL")
    d = _discordant(j, "k").withColumn("p", stats.mcnemar(F.col("b01"), F.col("b10"))).withColumn("all", F.lit(1))
    h = stats.holm(d, "p", ["all"], "k").withColumn("delta", F.round((F.col("cand_correct") - F.col("ref_correct")) / F.col("n") * 100, 6))
    ends = h.agg(F.min_by("delta", "k").alias("first"), F.max_by("delta", "k").alias("last"), F.min_by("p_holm", "k").alias("p_first"))
    ends = ends.select((F.col("last") < F.col("first")).alias("shrinks"), ((F.col("p_first") < 0.05) & (F.col("first") > 0) & (F.col("last") < F.col("first"))).alias("supported"))
    return h.crossJoin(F.broadcast(ends)).select("k", "n", "delta", F.round("p_holm", 9).alias("p_holm"), verdict(F.col("p_holm"), F.col("delta"), F.col("n")).alias("verdict"), "shrinks", "supported")


def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much better the whole scores than the slice that was never selected on."""
    ok = F.col("ref_ok").cast("double")
    g = _sliced(spark, sf_dir).agg(F.avg(ok).alias("full"), F.avg(F.when(F.col("slice") == "test", ok)).alias("held"))
    return g.select(F.round(F.col("full") * 100, 6).alias("full_acc"), F.round(F.col("held") * 100, 6).alias("held_out"), F.round((F.col("full") - F.col("held")) * 100, 6).alias("bias"))


def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions, and videos and texts once each, by language."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("questions"), F.countDistinct("source").alias("videos"), F.countDistinct("text").alias("texts"))


QUERIES = {f.__name__: f for f in (wilson_ci, mcnemar_exact, paired_mde, holm_adjust, system_sweep, budget_verdict, partition_slices, selection_band_exact, paired_bootstrap, result_summary, letter_histogram, micro_f1, cost_means, wrong_first_sample, count_verification, selection_band_p95, compare_report, sweep_bands, budget_report, contamination, distinct_counts)}

_D = "d AS (SELECT {g}, count(*) AS n, CAST(sum(CAST(ref_ok AS INT)) AS BIGINT) AS rc, CAST(sum(CAST(cand_ok AS INT)) AS BIGINT) AS cc, CAST(sum(CAST(ref_ok AND NOT cand_ok AS INT)) AS BIGINT) AS b10, CAST(sum(CAST(NOT ref_ok AND cand_ok AS INT)) AS BIGINT) AS b01 FROM judged GROUP BY 1)"
_P = "p AS (SELECT *, CASE WHEN b01 + b10 = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2 * (SELECT sum(exp(lgamma(b01 + b10 + 1.0) - lgamma(i + 1.0) - lgamma(b01 + b10 - i + 1.0) - (b01 + b10) * ln(2.0))) FROM range(100000) r(i) WHERE i <= least(b01, b10))) END AS p FROM d)"
_H = "h AS (SELECT *, max(s) OVER (ORDER BY p, {g} ROWS UNBOUNDED PRECEDING) AS p_holm FROM (SELECT *, least(1.0::DOUBLE, (count(*) OVER () - row_number() OVER (ORDER BY p, {g}) + 1) * p) AS s FROM p))"
_W = "round(greatest(0.0, ({c} / n::DOUBLE + 1.96*1.96/(2*n) - 1.96*sqrt(({c}/n::DOUBLE)*(1-{c}/n::DOUBLE)/n + 1.96*1.96/(4.0::DOUBLE*n*n))) * 100/(1+1.96*1.96/n)), 6) AS low, round(least(100.0, ({c} / n::DOUBLE + 1.96*1.96/(2*n) + 1.96*sqrt(({c}/n::DOUBLE)*(1-{c}/n::DOUBLE)/n + 1.96*1.96/(4.0::DOUBLE*n*n))) * 100/(1+1.96*1.96/n)), 6) AS high"
_DELTA = "(cc - rc) / n::DOUBLE * 100"
_VERDICT = "CASE WHEN p_holm < 0.05 AND cc > rc THEN 'SIGNIFICANT+' WHEN abs((cc - rc) / n::DOUBLE * 100) < 280.0::DOUBLE * sqrt(0.24::DOUBLE / n) THEN 'inconclusive' WHEN cc < rc THEN 'negative' ELSE 'n.s.' END"
_CDF = "pmf AS (SELECT {g}, x, exp(lgamma(201.0) - lgamma(x + 1.0) - lgamma(201.0 - x) + x * ln(share) + (200 - x) * ln(1 - share)) AS f FROM s, range(201) r(x)), cdf AS (SELECT {g}, x, least(1.0::DOUBLE, sum(f) OVER (PARTITION BY {g} ORDER BY x ROWS UNBOUNDED PRECEDING)) AS c FROM pmf)"
_SLICED = "r AS (SELECT *, percent_rank() OVER (ORDER BY qidx) AS r FROM judged)"

ORACLE = {
    "wilson_ci": f"WITH {JUDGED_SQL}, {_D.format(g='lang')} SELECT lang, n, rc AS ref_correct, {_W.format(c='rc')} FROM d",
    "mcnemar_exact": f"WITH {JUDGED_SQL}, {_D.format(g='source')}, {_P} SELECT source, n, b01, b10, round({_DELTA}, 6) AS delta, round(p, 9) AS p FROM p",
    "paired_mde": f"WITH {JUDGED_SQL}, {_D.format(g='lang')} SELECT lang, round((1.96 + 0.84)::DOUBLE * sqrt(b01 + b10) / n * 100, 6) AS mde, round((1.96 + 1.28)::DOUBLE * sqrt(b01 + b10) / n * 100, 6) AS mde_90 FROM d",
    "holm_adjust": f"WITH {JUDGED_SQL}, {_D.format(g='source')}, {_P}, {_H.format(g='source')} SELECT source, round(p, 9) AS p, round(p_holm, 9) AS p_holm, CASE WHEN p_holm < 0.01 THEN '***' WHEN p_holm < 0.05 THEN '**' WHEN p_holm < 0.10 THEN '*' ELSE '' END AS stars FROM h",
    "system_sweep": f"WITH {JUDGED_SQL}, {_D.format(g='source')}, {_P}, {_H.format(g='source')} SELECT source, n, round({_DELTA}, 6) AS delta, round(p_holm, 9) AS p_holm, CAST(row_number() OVER (ORDER BY round({_DELTA}, 6) DESC, source) AS INT) AS rank FROM h",
    "budget_verdict": f"""WITH {JUDGED_SQL}, {_D.format(g='lang')}, {_P}, {_H.format(g='lang')}, o AS (SELECT lang, avg(CAST(ref_ok OR cand_ok AS DOUBLE)) AS ceiling FROM judged GROUP BY 1)
SELECT h.lang, round({_DELTA}, 6) AS delta, round(p_holm, 9) AS p_holm, {_VERDICT} AS verdict, round(ceiling * 100, 6) AS ceiling FROM h JOIN o USING (lang)""",
    "partition_slices": f"""WITH {JUDGED_SQL}, r AS (SELECT *, percent_rank() OVER (ORDER BY qidx) AS r FROM judged), s AS (SELECT CASE WHEN r < 0.3 THEN 'train' WHEN r < 0.6 THEN 'val' ELSE 'test' END AS slice, ref_ok FROM r UNION ALL SELECT 'full', ref_ok FROM r),
g AS (SELECT slice, count(*) AS n, CAST(sum(CAST(ref_ok AS INT)) AS BIGINT) AS correct FROM s GROUP BY 1) SELECT slice, n, correct, round(correct / n::DOUBLE * 100, 6) AS accuracy, {_W.format(c='correct')} FROM g""",
    "selection_band_exact": f"""WITH {JUDGED_SQL}, {_D.format(g='lang')}, s AS (SELECT lang, least(0.99::DOUBLE, greatest(0.01::DOUBLE, rc / n::DOUBLE)) AS share FROM d),
pmf AS (SELECT lang, x, exp(lgamma(201.0) - lgamma(x + 1.0) - lgamma(201.0 - x) + x * ln(share) + (200 - x) * ln(1 - share)) AS f FROM s, range(201) r(x)),
cdf AS (SELECT lang, x, least(1.0::DOUBLE, sum(f) OVER (PARTITION BY lang ORDER BY x ROWS UNBOUNDED PRECEDING)) AS c FROM pmf)
SELECT lang, CAST(k AS INT) AS k, round((200 - sum(CASE WHEN x < 200 THEN pow(c, k) ELSE 0 END)) / 200, 7) AS band FROM cdf, (VALUES (2), (5), (20)) ks(k) GROUP BY 1, 2""",
    "result_summary": f"""WITH {JUDGED_SQL}, j AS (SELECT *, coalesce(lang = 'es', true) AS pf FROM judged), g AS (SELECT source, count(*) AS total, count(*) FILTER (WHERE ref_ok) AS correct, count(*) FILTER (WHERE pf) AS parse_fail, count(*) FILTER (WHERE ref_ok AND NOT pf) AS vc FROM j GROUP BY 1)
SELECT source, total, correct, parse_fail, total - parse_fail AS valid, round(correct / total::DOUBLE, 6) AS accuracy, round(CASE WHEN total > parse_fail THEN vc / (total - parse_fail)::DOUBLE ELSE 0.0 END, 6) AS valid_accuracy FROM g""",
    "letter_histogram": "SELECT source, CASE WHEN regexp_full_match(upper(substr(trim(text), 1, 1)), '[A-Z]') THEN upper(substr(trim(text), 1, 1)) ELSE '?' END AS letter, count(*) AS n FROM documents GROUP BY 1, 2",
    "micro_f1": f"WITH {JUDGED_SQL}, g AS (SELECT lang, count(*) FILTER (WHERE ref_ok AND cand_ok) AS tp, count(*) FILTER (WHERE ref_ok AND NOT cand_ok) AS fp, count(*) FILTER (WHERE NOT ref_ok AND cand_ok) AS fn FROM judged GROUP BY 1) SELECT lang, tp, fp, fn, round(CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM g",
    "cost_means": "SELECT lang, CAST(floor(avg(n_chars)) AS BIGINT) AS context_chars, round_even(avg(n_chars / 100.0::DOUBLE), 2) AS frames FROM documents GROUP BY 1",
    "wrong_first_sample": f"WITH {JUDGED_SQL} SELECT source, qidx, ref_ok, CAST(row_number() OVER (PARTITION BY source ORDER BY ref_ok, qidx) AS INT) AS rank FROM judged QUALIFY row_number() OVER (PARTITION BY source ORDER BY ref_ok, qidx) <= 24",
    "count_verification": f"WITH {JUDGED_SQL}, h AS (SELECT toxic AS system, count(*) AS stated FROM labels GROUP BY 1), v AS (SELECT CAST(NOT cand_ok AS INT) AS system, count(*) AS counted FROM judged GROUP BY 1) SELECT h.system, stated, coalesce(counted, 0) AS counted, stated = coalesce(counted, 0) AS agrees FROM h LEFT JOIN v USING (system)",
    "selection_band_p95": f"""WITH {JUDGED_SQL}, {_D.format(g='lang')}, s AS (SELECT lang, least(0.99::DOUBLE, greatest(0.01::DOUBLE, rc / n::DOUBLE)) AS share FROM d), {_CDF.format(g='lang')}
SELECT lang, CAST(k AS INT) AS k, round(count(*) FILTER (WHERE x < 200 AND round(pow(c, k), 9) < 0.95) / 200.0::DOUBLE, 6) AS p95 FROM cdf, (VALUES (2), (5), (20)) ks(k) GROUP BY 1, 2""",
    "compare_report": f"""WITH {JUDGED_SQL}, {_D.format(g='source')}, {_P}, s AS (SELECT source, least(0.99::DOUBLE, greatest(0.01::DOUBLE, rc / n::DOUBLE)) AS share FROM d), {_CDF.format(g='source')},
b AS (SELECT cdf.source, round(((200 - sum(CASE WHEN x < 200 THEN pow(c, 5) ELSE 0 END)) / 200 - any_value(share)) * 100, 5) AS band FROM cdf JOIN s USING (source) GROUP BY 1)
SELECT p.source, n, round(rc / n::DOUBLE * 100, 6) AS acc_ref, round(cc / n::DOUBLE * 100, 6) AS acc_cand, {_W.format(c='cc')}, round({_DELTA}, 6) AS delta, b01 + b10 AS discordant, round(p, 9) AS p, round(280.0::DOUBLE * sqrt(0.24::DOUBLE / n), 6) AS mde, band, round({_DELTA}, 5) <= band AS inside_band FROM p JOIN b USING (source)""",
    "sweep_bands": f"""WITH {JUDGED_SQL}, {_D.format(g='source')}, s AS (SELECT 1 AS one, avg(CAST(ref_ok AS DOUBLE)) AS share FROM judged), {_CDF.format(g='one')}, b AS (SELECT round(((200 - sum(CASE WHEN x < 200 THEN pow(c, 20) ELSE 0 END)) / 200 - (SELECT share FROM s)) * 100, 5) AS band FROM cdf)
SELECT source, round({_DELTA}, 6) AS delta, band, CASE WHEN cc <= rc THEN '' WHEN round({_DELTA}, 5) <= band THEN 'within selection noise' ELSE 'exceeds selection band' END AS flag FROM d, b""",
    "budget_report": f"""WITH j0 AS (SELECT 1), {JUDGED_SQL.replace('judged AS', 'jx AS')}, judged AS (SELECT *, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) AS k FROM jx WHERE regexp_matches(source, '[0-9]+$')), {_D.format(g='k')}, {_P}, {_H.format(g='k')},
e AS (SELECT arg_min(cc - rc, k) / arg_min(n, k)::DOUBLE AS lo, arg_max(cc - rc, k) / arg_max(n, k)::DOUBLE AS hi, arg_min(p_holm, k) AS pl FROM h)
SELECT k, n, round({_DELTA}, 6) AS delta, round(p_holm, 9) AS p_holm, {_VERDICT} AS verdict, round(hi * 100, 6) < round(lo * 100, 6) AS shrinks, pl < 0.05 AND lo > 0 AND hi < lo AS supported FROM h, e""",
    "contamination": f"WITH {JUDGED_SQL}, {_SLICED} SELECT round(avg(CAST(ref_ok AS DOUBLE)) * 100, 6) AS full_acc, round(avg(CAST(ref_ok AS DOUBLE)) FILTER (WHERE r >= 0.6) * 100, 6) AS held_out, round((avg(CAST(ref_ok AS DOUBLE)) - avg(CAST(ref_ok AS DOUBLE)) FILTER (WHERE r >= 0.6)) * 100, 6) AS bias FROM r",
    "distinct_counts": "SELECT lang, count(*) AS questions, count(DISTINCT source) AS videos, count(DISTINCT text) AS texts FROM documents GROUP BY 1",
}
