"""Leaderboards over a grid of runs: order lines as results of model, memory and seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tempora.sources.tables import table

SEEDS = ("A", "N", "R")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``model, memory, dataset, seed, correct, total, cost, frames`` of each run."""
    line = table(spark, sf_dir, "lineitem").select("l_linestatus", "l_suppkey", "l_returnflag", "l_discount", "l_extendedprice", "l_quantity", "l_linenumber")
    return line.groupBy(F.col("l_linestatus").alias("model"), (F.col("l_suppkey") % 20).alias("memory"), (F.col("l_linenumber") % 3).alias("dataset"), F.col("l_returnflag").alias("seed")).agg(
        F.sum((F.col("l_discount") >= 0.05).cast("long")).alias("correct"), F.count(F.lit(1)).alias("total"), F.sum(F.floor("l_extendedprice").cast("long")).alias("cost"), F.sum(F.floor("l_quantity").cast("long")).alias("frames")
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled cells of the grid that have every seed their model was run with."""
    r = runs(spark, sf_dir)
    needed = r.groupBy("model").agg(F.countDistinct("seed").alias("needed"))
    g = r.groupBy("model", "memory", "dataset").agg(F.countDistinct("seed").alias("seeds"), F.sum("correct").alias("correct"), F.sum("total").alias("total"), F.sum("cost").alias("cost"), F.sum("frames").alias("frames"))
    return g.join(needed, "model").where("seeds = needed").drop("needed")


def complete_seed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).withColumn("accuracy", F.round(F.col("correct") / F.col("total"), 6))


def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average over all three datasets (a missing one counts zero), mean cost where there is any."""
    c = cells(spark, sf_dir)
    g = c.groupBy("model", "memory").agg((F.sum(F.col("correct") / F.col("total")) / 3).alias("avg"), F.avg(F.nullif("cost", F.lit(0))).alias("cost"))
    order = Window.partitionBy("model").orderBy(F.desc(F.round("avg", 6)), "memory")
    return g.select("model", "memory", F.round("avg", 6).alias("avg"), F.floor("cost").cast("long").alias("cost"), F.row_number().over(order).alias("rank"))


def leaderboard_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir).withColumn("acc", F.round(F.col("correct") / F.col("total"), 4))
    p = c.groupBy("model", "memory").pivot("dataset", [0, 1, 2]).agg(F.max("acc"))
    return p.select("model", "memory", *[F.col(str(d)).alias(f"dataset_{d}") for d in (0, 1, 2)])


def frontier_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best cell of each dataset: accuracy, then lower cost, then name."""
    c = cells(spark, sf_dir).withColumn("accuracy", F.round(F.col("correct") / F.col("total"), 6))
    order = Window.partitionBy("dataset").orderBy(F.desc("accuracy"), "cost", "model", "memory")
    return c.withColumn("r", F.row_number().over(order)).where("r = 1").select("dataset", "model", "memory", "accuracy", "cost")


def pareto_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that none beats in accuracy at no more cost: a skyline by one sorted pass, equals kept."""
    c = cells(spark, sf_dir).withColumn("accuracy", F.round(F.col("correct") / F.col("total"), 6))
    cheaper = Window.partitionBy("dataset").orderBy("cost").rangeBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("dataset").orderBy("cost").rangeBetween(Window.unboundedPreceding, 0)
    kept = c.withColumn("before", F.max("accuracy").over(cheaper)).withColumn("now", F.max("accuracy").over(upto))
    return kept.where("accuracy = now AND (before IS NULL OR accuracy > before)").select("dataset", "model", "memory", "accuracy", "cost")


def missing_grid(spark: SparkSession, sf_dir: str, memories: int = 25) -> DataFrame:
    """Cells of the configured grid that have no complete result; the grid is bounded by its dimensions."""
    r = runs(spark, sf_dir)
    grid = r.select("model").distinct().crossJoin(F.broadcast(spark.range(memories).withColumnRenamed("id", "memory"))).crossJoin(F.broadcast(spark.range(3).select(F.col("id").cast("int").alias("dataset"))))
    return grid.join(cells(spark, sf_dir), ["model", "memory", "dataset"], "left_anti")


def harness_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each program: its accuracy on each dataset ("-" where missing), the average, tokens, and a mark on the frontier."""
    c = cells(spark, sf_dir).withColumn("acc", F.col("correct") / F.col("total"))
    p = c.groupBy("model", "memory").agg(
        *[F.coalesce(F.max(F.when(F.col("dataset") == d, F.format_string("%.1f", F.round(F.col("acc") * 100, 1)))), F.lit("-")).alias(f"dataset_{d}") for d in (0, 1, 2)],
        F.round(F.sum("acc") / 3, 6).alias("avg"),
        F.floor(F.avg(F.nullif("cost", F.lit(0)))).cast("long").alias("tokens"),
    )
    # On the frontier: none is better at no more tokens, none as good at fewer.
    cheaper = Window.partitionBy(F.lit(1)).orderBy("tokens").rangeBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(F.lit(1)).orderBy("tokens").rangeBetween(Window.unboundedPreceding, 0)
    return p.withColumn("_b", F.max("avg").over(cheaper)).withColumn("pareto", (F.col("avg") == F.max("avg").over(upto)) & (F.col("_b").isNull() | (F.col("avg") > F.col("_b")))).drop("_b")


def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir)
    return r.select("model", F.col("cost").alias("tokens")).unionByName(r.select("model", F.col("frames").alias("tokens"))).groupBy("model").agg(F.sum("tokens").alias("tokens"))


def summary_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested summary as JSON text; models in order, the last one wins."""
    c = cells(spark, sf_dir)
    last = c.groupBy("dataset", "memory").agg(F.max("model").alias("model"))
    one = c.join(last, ["dataset", "memory", "model"]).groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct("memory", "model", "correct"))).alias("entries"))
    return one.select("dataset", F.array_join(F.transform("entries", lambda x: F.concat_ws(":", x["memory"].cast("string"), x["model"], x["correct"].cast("string"))), ",").alias("summary"))


def summary_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary as one nested JSON document: dataset, memory, then accuracy, cost and model; the last model wins."""
    c = cells(spark, sf_dir)
    last = c.groupBy("dataset", "memory").agg(F.max(F.struct("model", F.round(F.col("correct") / F.col("total"), 4).alias("accuracy"), "cost")).alias("x"))
    entry = F.struct(F.col("memory").cast("string").alias("memory"), F.to_json(F.struct("x.accuracy", "x.cost", "x.model")).alias("body"))
    one = last.groupBy("dataset").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    inner = F.array_join(F.transform("entries", lambda e: F.concat(F.lit('"'), e["memory"], F.lit('":'), e["body"])), ",")
    return one.select("dataset", F.concat(F.lit("{"), inner, F.lit("}")).alias("document"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``iteration, system, axis, score, component`` of each order, a month being an iteration."""
    o = table(spark, sf_dir, "orders")
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long")
    return o.select(month.alias("iteration"), F.col("o_orderkey").alias("system"), F.when(F.col("o_orderstatus") == "O", "exploration").otherwise("exploitation").alias("axis"), F.col("o_totalprice").alias("score"), F.col("o_orderpriority").alias("component"))


def frontier_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Systems that beat all before them; iterations are cut to their best first, so little is ordered at once."""
    best = ledger(spark, sf_dir).groupBy("iteration").agg(F.max_by("system", F.struct("score", -F.col("system"))).alias("system"), F.max("score").alias("score"))
    before = Window.partitionBy(F.lit(1)).orderBy("iteration").rowsBetween(Window.unboundedPreceding, -1)
    return best.withColumn("champion", F.max("score").over(before)).where("champion IS NULL OR score > champion").select("iteration", "system", F.round("score", 2).alias("score"))


def axis_recent_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the three latest iterations."""
    l = ledger(spark, sf_dir)  # noqa: E741
    latest = l.select("iteration").distinct().orderBy(F.desc("iteration")).limit(3)
    return l.join(F.broadcast(latest), "iteration", "left_semi").select("component").distinct()


def recent_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axes of the three latest iterations: a row's components if it has any, else its axis unless that only names the phase."""
    l = ledger(spark, sf_dir)  # noqa: E741
    parts = F.when(F.col("system") % 3 == 0, F.split("component", "-")).otherwise(F.array().cast("array<string>"))
    axis = F.when(F.col("system") % 3 == 1, F.concat(F.lit("axis "), F.col("system") % 5)).otherwise(F.col("axis"))
    named = F.when(F.size(parts) > 0, parts).when(~axis.isin("exploitation", "exploration"), F.array(axis))
    latest = l.select("iteration").distinct().orderBy(F.desc("iteration")).limit(3)
    newest = latest.agg(F.max("iteration").alias("newest"))
    axes = l.join(F.broadcast(latest), "iteration", "left_semi").select(F.explode(named).alias("axis")).distinct()
    return axes.crossJoin(F.broadcast(newest))


def best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer the first of their best orders."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("customer")).agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("epoch"), F.max("o_totalprice").alias("score"))


def score_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score of each iteration, and its distance from the best iteration before."""
    m = ledger(spark, sf_dir).groupBy("iteration").agg(F.round(F.avg("score"), 4).alias("mean"))
    before = Window.partitionBy(F.lit(1)).orderBy("iteration").rowsBetween(Window.unboundedPreceding, -1)
    return m.select("iteration", "mean", F.round(F.col("mean") - F.max("mean").over(before), 4).alias("delta"))


def execution_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as programs, orders as their questions: a run failed with no result, any error, or four fifths unparsed."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("program"))
    g = o.groupBy(F.col("o_custkey").alias("program")).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("unparsed"), F.sum((F.col("o_totalprice") % 50 < 1).cast("long")).alias("errors")
    )
    failed = F.col("n").isNull() | (F.col("errors") > 0) | (F.col("unparsed") >= 0.8)
    return c.join(g, "program", "left").select("program", F.coalesce("n", F.lit(0)).alias("n"), failed.alias("failed"))


def progress_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Done so far and estimated rest of each day, from the days before it."""
    e = table(spark, sf_dir, "events").groupBy(F.dayofmonth("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.lit(1)).orderBy("day")
    done, total = F.sum("n").over(w), F.sum("n").over(Window.partitionBy(F.lit(1)))
    return e.select("day", done.alias("done"), F.round((total - done) * F.row_number().over(w) / done, 6).alias("days_left"))


QUERIES = {f.__name__: f for f in (complete_seed_groups, leaderboard, leaderboard_pivot, frontier_argmax, pareto_frontier, missing_grid, token_totals, summary_map, frontier_updates, axis_recent_union, recent_axes, best_epoch, score_delta, execution_errors, progress_rate, harness_pivot, summary_json)}

_RUNS = "runs AS (SELECT l_linestatus AS model, l_suppkey % 20 AS memory, l_linenumber % 3 AS dataset, l_returnflag AS seed, count(*) FILTER (WHERE l_discount >= 0.05) AS correct, count(*) AS total, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS cost, CAST(sum(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) AS frames FROM lineitem GROUP BY 1, 2, 3, 4)"
_CELLS = _RUNS + ", needed AS (SELECT model, count(DISTINCT seed) AS needed FROM runs GROUP BY 1), cells AS (SELECT model, memory, dataset, count(DISTINCT seed) AS seeds, CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(total) AS BIGINT) AS total, CAST(sum(cost) AS BIGINT) AS cost, CAST(sum(frames) AS BIGINT) AS frames FROM runs GROUP BY 1, 2, 3 HAVING count(DISTINCT seed) = (SELECT needed FROM needed x WHERE x.model = runs.model)), acc AS (SELECT *, round(correct / total::DOUBLE, 6) AS accuracy FROM cells)"
_LEDGER = "ledger AS (SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS iteration, o_orderkey AS system, o_totalprice AS score, o_orderpriority AS component FROM orders)"
ORACLE = {
    "complete_seed_groups": f"WITH {_CELLS} SELECT * FROM acc",
    "leaderboard": f"WITH {_CELLS}, g AS (SELECT model, memory, sum(correct / total::DOUBLE) / 3 AS a, avg(nullif(cost, 0)) AS c FROM cells GROUP BY 1, 2) SELECT model, memory, round(a, 6) AS avg, CAST(floor(c) AS BIGINT) AS cost, CAST(row_number() OVER (PARTITION BY model ORDER BY round(a, 6) DESC, memory) AS INT) AS rank FROM g",
    "leaderboard_pivot": f"WITH {_CELLS} SELECT model, memory, max(round(correct / total::DOUBLE, 4)) FILTER (WHERE dataset = 0) AS dataset_0, max(round(correct / total::DOUBLE, 4)) FILTER (WHERE dataset = 1) AS dataset_1, max(round(correct / total::DOUBLE, 4)) FILTER (WHERE dataset = 2) AS dataset_2 FROM cells GROUP BY 1, 2",
    "frontier_argmax": f"WITH {_CELLS} SELECT dataset, model, memory, accuracy, cost FROM acc QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY accuracy DESC, cost, model, memory) = 1",
    "pareto_frontier": f"WITH {_CELLS} SELECT dataset, model, memory, accuracy, cost FROM acc a WHERE NOT EXISTS (SELECT 1 FROM acc b WHERE b.dataset = a.dataset AND b.accuracy >= a.accuracy AND b.cost <= a.cost AND (b.accuracy > a.accuracy OR b.cost < a.cost))",
    "missing_grid": f"WITH {_CELLS} SELECT m.model, k.memory, CAST(d.dataset AS INT) AS dataset FROM (SELECT DISTINCT model FROM runs) m, range(25) k(memory), range(3) d(dataset) WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.model = m.model AND c.memory = k.memory AND c.dataset = d.dataset)",
    "token_totals": f"WITH {_RUNS} SELECT model, CAST(sum(cost + frames) AS BIGINT) AS tokens FROM runs GROUP BY 1",
    "summary_map": f"WITH {_CELLS}, l AS (SELECT * FROM cells QUALIFY row_number() OVER (PARTITION BY dataset, memory ORDER BY model DESC) = 1) SELECT dataset, string_agg(memory || ':' || model || ':' || correct, ',' ORDER BY memory) AS summary FROM l GROUP BY 1",
    "frontier_updates": f"WITH {_LEDGER}, b AS (SELECT * FROM ledger QUALIFY row_number() OVER (PARTITION BY iteration ORDER BY score DESC, system) = 1), c AS (SELECT *, max(score) OVER (ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS champion FROM b) SELECT iteration, system, round(score, 2) AS score FROM c WHERE champion IS NULL OR score > champion",
    "axis_recent_union": f"WITH {_LEDGER}, r AS (SELECT component, dense_rank() OVER (ORDER BY iteration DESC) AS k FROM ledger) SELECT DISTINCT component FROM r WHERE k <= 3",
    "best_epoch": "SELECT o_custkey AS customer, o_orderkey AS epoch, o_totalprice AS score FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1",
    "score_delta": f"WITH {_LEDGER}, m AS (SELECT iteration, round(avg(score), 4) AS mean FROM ledger GROUP BY 1) SELECT iteration, mean, round(mean - max(mean) OVER (ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 4) AS delta FROM m",
    "execution_errors": "WITH g AS (SELECT o_custkey AS program, count(*) AS n, avg(CAST(o_orderstatus = 'F' AS DOUBLE)) AS u, count(*) FILTER (WHERE o_totalprice % 50 < 1) AS e FROM orders GROUP BY 1) SELECT c_custkey AS program, coalesce(n, 0) AS n, n IS NULL OR e > 0 OR u >= 0.8 AS failed FROM customer LEFT JOIN g ON program = c_custkey",
    "recent_axes": f"""WITH {_LEDGER.replace('o_orderpriority AS component', "o_orderpriority AS component, o_orderstatus AS st")}, r AS (SELECT *, dense_rank() OVER (ORDER BY iteration DESC) AS k FROM ledger), x AS (SELECT * FROM r WHERE k <= 3)
SELECT DISTINCT axis, (SELECT max(iteration) FROM x) AS newest FROM (SELECT unnest(string_split(component, '-')) AS axis FROM x WHERE system % 3 = 0 UNION ALL SELECT 'axis ' || system % 5 FROM x WHERE system % 3 = 1)""",
    "harness_pivot": f"""WITH {_CELLS}, p AS (SELECT model, memory, coalesce(max(printf('%.1f', round(correct / total::DOUBLE * 100, 1))) FILTER (WHERE dataset = 0), '-') AS dataset_0, coalesce(max(printf('%.1f', round(correct / total::DOUBLE * 100, 1))) FILTER (WHERE dataset = 1), '-') AS dataset_1, coalesce(max(printf('%.1f', round(correct / total::DOUBLE * 100, 1))) FILTER (WHERE dataset = 2), '-') AS dataset_2, round(sum(correct / total::DOUBLE) / 3, 6) AS avg, CAST(floor(avg(nullif(cost, 0))) AS BIGINT) AS tokens FROM cells GROUP BY 1, 2)
SELECT *, NOT EXISTS (SELECT 1 FROM p b WHERE b.avg >= a.avg AND b.tokens <= a.tokens AND (b.avg > a.avg OR b.tokens < a.tokens)) AS pareto FROM p a""",
    "summary_json": f"""WITH {_CELLS}, l AS (SELECT * FROM cells QUALIFY row_number() OVER (PARTITION BY dataset, memory ORDER BY model DESC) = 1)
SELECT dataset, '{{' || string_agg('"' || memory || '":{{"accuracy":' || round(correct / total::DOUBLE, 4) || ',"cost":' || cost || ',"model":"' || model || '"}}', ',' ORDER BY memory::VARCHAR) || '}}' AS document FROM l GROUP BY 1""",
    "progress_rate": "WITH e AS (SELECT CAST(day(ts) AS INT) AS day, count(*) AS n FROM events GROUP BY 1), w AS (SELECT day, CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS done, sum(n) OVER () AS total, row_number() OVER (ORDER BY day) AS k FROM e) SELECT day, done, round((total - done) * k / done::DOUBLE, 6) AS days_left FROM w",
}
