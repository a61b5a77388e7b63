"""The portfolio simulator as one windowed query per set of folds, and its figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelflow.config import EngineConfig
from panelflow.operators.scan import running


def softmax(a: Column) -> Column:
    e = F.transform(a, F.exp)
    return F.transform(F.array(e), lambda x: F.transform(x, lambda v: v / F.aggregate(x, F.lit(0.0), lambda s, y: s + y)))[0]


def simulate(rows: DataFrame, cfg: EngineConfig, keys: tuple[str, ...] = ("fold",)) -> DataFrame:
    """The execution log of rows (keys, ts, rets, bench_ret, action): one row a step.

    rets holds a return a cluster, action a score a cluster and last cash's.
    Nothing an action sees depends on the portfolio, so the loop is a lag and a
    running product.  The first obs_window rows of a fold and its last are not
    traded; a fold of obs_window + 1 rows trades its only one; shorter folds
    have no step.  Actions are held to [0, 1].  Rows that bring weights of their
    own (a share a cluster, then cash) are traded by these.
    """
    by = Window.partitionBy(*keys).orderBy("ts")
    k = F.size("rets")
    rows = rows.withColumn("pos", F.row_number().over(by) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    rows = rows.where((F.col("pos") >= cfg.obs_window) & (F.col("pos") <= F.greatest(F.lit(cfg.obs_window), F.col("n") - 2)))
    if "weights" not in rows.columns:
        rows = rows.withColumn("weights", softmax(F.transform("action", lambda a: F.greatest(F.lit(0.0), F.least(F.lit(1.0), a)))))
    cash = F.concat(F.array_repeat(F.lit(0.0), k), F.array(F.lit(1.0)))
    rows = rows.withColumn("prev", F.coalesce(F.lag("weights").over(by), cash))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    rows = rows.withColumn("turnover", total(F.zip_with("weights", "prev", lambda a, b: F.abs(a - b) * cfg.leverage)))
    rows = rows.withColumn("cost", F.col("turnover") * cfg.cost_rate)
    gross = total(F.zip_with(F.slice("weights", F.lit(1), k), "rets", lambda w, r: w * r)) * cfg.leverage
    rows = rows.withColumn("ret", gross - F.col("cost"))
    reward = (F.col("ret") - F.col("bench_ret")) * 10 - F.when(F.col("ret") < -0.02, F.abs("ret") * 50).otherwise(0.0) - F.col("turnover") * cfg.turnover_penalty
    rows = rows.withColumn("reward", F.least(F.lit(10.0), F.greatest(F.lit(-10.0), reward)))
    equity = 100 * F.product(1 + F.col("ret")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(*keys, "ts", equity.alias("equity"), "ret", F.col("bench_ret").alias("benchmark_return"), F.lit(cfg.leverage).alias("leverage"), "turnover", "cost", "reward", "weights", F.element_at("weights", -1).alias("cash_weight"), "rets")


def drawdown(log: DataFrame, keys: tuple[str, ...] = ("fold",)) -> DataFrame:
    """log with rebased equity (100 at the first row) and drawdown from the running peak."""
    w = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("rebased", F.col("equity") / F.first("equity").over(w) * 100).withColumn("drawdown", F.col("equity") / F.max("equity").over(w) - 1)


def kpis(log: DataFrame, cfg: EngineConfig, keys: tuple[str, ...] = ("fold",)) -> DataFrame:
    """One row of figures a fold; ratios over a deviation that is not positive are 0."""
    neg = F.when(F.col("ret") < 0, F.col("ret"))
    x, y = F.col("benchmark_return"), F.col("ret")
    a = drawdown(log, keys).groupBy(*keys).agg(
        F.count("*").alias("periods"), (F.max_by("equity", "ts") / F.min_by("equity", "ts") - 1).alias("total_return"),
        (F.datediff(F.max("ts"), F.min("ts")) / 365.25).alias("years"), F.stddev_samp("ret").alias("sd"), F.stddev_samp(neg).alias("down"),
        F.min("drawdown").alias("max_drawdown"), F.stddev_samp(x).alias("bsd"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("icept"), (F.count_if(y > 0) / F.count("*")).alias("win_rate"),
    )
    a = a.withColumn("cagr", F.when(F.col("years") > 0, F.pow(1 + F.col("total_return"), 1 / F.nullif("years", F.lit(0.0))) - 1).otherwise(0.0))
    a = a.withColumn("vol", F.coalesce(F.col("sd") * F.sqrt(F.lit(float(cfg.periods))), F.lit(0.0))).withColumn("dvol", F.coalesce(F.col("down") * F.sqrt(F.lit(float(cfg.periods))), F.lit(0.0)))
    ratio = lambda n, d: F.when(F.col(d) > 0, n / F.nullif(d, F.lit(0.0))).otherwise(0.0)
    linear = (F.col("periods") > 1) & (F.coalesce("bsd", F.lit(0.0)) > 0)
    over = F.col("cagr") - cfg.risk_free
    return a.select(
        *keys, "periods", "total_return", "cagr", "vol", "max_drawdown", ratio(over, "vol").alias("sharpe"), ratio(over, "dvol").alias("sortino"),
        F.when(F.col("max_drawdown") < 0, F.col("cagr") / F.abs(F.nullif("max_drawdown", F.lit(0.0)))).otherwise(0.0).alias("calmar"),
        F.when(linear, F.col("icept") * cfg.periods).otherwise(0.0).alias("alpha"), F.when(linear, F.col("slope")).otherwise(0.0).alias("beta"), "win_rate",
    )


def allocation_rank(log: DataFrame) -> DataFrame:
    """(cluster, mean_weight), cash left out, the largest first."""
    long = log.select(F.posexplode("weights").alias("cluster", "w"), (F.size("weights") - 1).alias("cash"))
    return long.where("cluster < cash").groupBy("cluster").agg(F.avg("w").alias("mean_weight")).orderBy(F.desc("mean_weight"), "cluster")


def histogram(log: DataFrame, bins: int = 50) -> DataFrame:
    """(bin, n, density) of returns over equal bins from least to most, the most in the last bin."""
    e = log.agg(F.min("ret").alias("lo"), F.max("ret").alias("hi"), F.count("*").alias("total"))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col("ret") - F.col("lo"), width)))).cast("int")
    return log.crossJoin(F.broadcast(e)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.first(F.try_divide(F.lit(1.0), F.col("total") * width)).alias("per")).select("bin", "n", (F.col("n") * F.col("per")).alias("density"))


def stitched(log: DataFrame) -> DataFrame:
    """(ts, curve): all folds' returns in order of time, compounded from 100."""
    grown = running(log.select("ts", "ret"), "ts", ["ts"], grown=("product", 1 + F.col("ret")))
    return grown.select("ts", (100 * F.col("grown")).alias("curve"))


def global_curves(log: DataFrame, bench: DataFrame) -> DataFrame:
    """(date, strategy, bench) of the dates of bench from the log's first step to its last, both from 100.

    The benchmark runs on through dates that are not traded, on which strategy is null.
    """
    span = log.agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b"))
    days = bench.crossJoin(F.broadcast(span)).where(F.col("date").between(F.col("a"), F.col("b")))
    grown = running(days.select("date", "bench_ret"), "date", ["date"], grown=("product", 1 + F.col("bench_ret")))
    curve = stitched(log).select(F.to_date("ts").alias("date"), F.col("curve").alias("strategy"))
    return grown.join(curve, "date", "left").select("date", "strategy", (100 * F.col("grown")).alias("bench"))


def walk_forward(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """rows once for each (fold, split) whose dates hold them; folds (fold, tr_start, tr_end, te_start, te_end) is a handful of rows."""
    spans = folds.select("fold", F.explode(F.array(F.struct(F.lit("train").alias("split"), F.col("tr_start").alias("a"), F.col("tr_end").alias("b")), F.struct(F.lit("test").alias("split"), F.col("te_start").alias("a"), F.col("te_end").alias("b")))).alias("s")).select("fold", "s.*")
    return rows.join(F.broadcast(spans), F.to_date("ts").between(F.col("a"), F.col("b"))).drop("a", "b")


def _lines(figures: DataFrame, keys: tuple[str, ...], names, width: int) -> DataFrame:
    """(keys, n, line): a line a figure, its name padded to width; kinds are % for percent, # for a number, d for days."""
    shown = {"%": lambda c: F.format_string("%.2f%%", F.col(c) * 100), "#": lambda c: F.format_string("%.2f", F.col(c)), "d": lambda c: F.format_string("%d days", F.col(c))}
    lines = [F.struct(F.lit(n).alias("n"), F.format_string(f"%-{width}s | %10s", F.lit(name), shown[kind](c)).alias("line")) for n, (name, c, kind) in enumerate(names)]
    return figures.select(*keys, F.explode(F.array(*lines)).alias("l")).select(*keys, "l.*")


#: The summary's and the report's names, figures and kinds.
SUMMARY = (("Total Return", "total_return", "%"), ("CAGR", "cagr", "%"), ("Vol", "vol", "%"), ("Max DD", "max_drawdown", "%"), ("Sharpe", "sharpe", "#"), ("Sortino", "sortino", "#"), ("Alpha", "alpha", "%"), ("Beta", "beta", "#"), ("Win Rate", "win_rate", "%"))
REPORT = (
    ("Period", "periods", "d"), ("Total Return", "total_return", "%"), ("CAGR", "cagr", "%"), ("Volatility", "vol", "%"), ("Max Drawdown", "max_drawdown", "%"), ("Sharpe Ratio", "sharpe", "#"),
    ("Sortino Ratio", "sortino", "#"), ("Calmar Ratio", "calmar", "#"), ("Alpha (Ann.)", "alpha", "%"), ("Beta", "beta", "#"), ("Win Rate", "win_rate", "%"),
)


def report_lines(figures: DataFrame, keys: tuple[str, ...] = ("fold",)) -> DataFrame:
    """(keys, n, line): the executive summary's lines; ratios and beta as numbers, the rest in percent."""
    return _lines(figures, keys, SUMMARY, 15)


def executive_summary(figures: DataFrame, title: str) -> DataFrame:
    """(n, line) of a fold's summary: a header, then the lines."""
    head = figures.sparkSession.createDataFrame([(0, f"--- REPORT: {title} ---")], "n int, line string")
    return head.union(report_lines(figures, ()).select(F.col("n") + 1, "line"))


def executive_report(log: DataFrame, figures: DataFrame, prefix: str, title: str) -> DataFrame:
    """(n, line) of the long report: header, dates of the first and last step, and all figures between rules."""
    rule = "-" * 40
    dates = log.agg(F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("a"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("b"))
    head = [F.lit(f"--- {title}: EXECUTIVE REPORT ({prefix}) ---"), F.lit(""), F.format_string("Period: %s -> %s", "a", "b"), F.lit(rule)]
    top = dates.select(F.posexplode(F.array(*head)).alias("n", "line"))
    end = dates.select((F.lit(len(head) + len(REPORT))).alias("n"), F.lit(rule).alias("line"))
    return top.union(_lines(figures, (), REPORT, 25).select(F.col("n") + len(head), "line")).union(end)


def fold_summary(figures: DataFrame) -> DataFrame:
    """(Fold, Train_Ret, Test_Ret, Train_Sharpe, Test_Sharpe) of figures by fold and split."""
    p = figures.groupBy("fold").pivot("split", ["train", "test"]).agg(F.first("total_return").alias("ret"), F.first("sharpe").alias("sharpe"))
    return p.select(F.col("fold").alias("Fold"), F.col("train_ret").alias("Train_Ret"), F.col("test_ret").alias("Test_Ret"), F.col("train_sharpe").alias("Train_Sharpe"), F.col("test_sharpe").alias("Test_Sharpe"))


def weight_stack(log: DataFrame, keys: tuple[str, ...] = ("fold",)) -> DataFrame:
    """(keys, ts, cluster, weight, top): each step's weights stacked, the cluster of the largest mean weight below, cash on top: data of the allocation chart."""
    long = log.select(*keys, "ts", F.posexplode("weights").alias("cluster", "weight"), (F.size("weights") - 1).alias("cash"))
    mean = long.groupBy(*keys, "cluster").agg(F.when(F.col("cluster") < F.max("cash"), F.avg("weight")).otherwise(-1.0).alias("mean"))
    w = Window.partitionBy(*keys, "ts").orderBy(F.desc("mean"), "cluster").rowsBetween(Window.unboundedPreceding, 0)
    return long.join(mean, [*keys, "cluster"]).withColumn("top", F.sum("weight").over(w)).drop("mean", "cash")


def require_steps(rows: DataFrame, cfg: EngineConfig, keys: tuple[str, ...] = ("fold",)) -> DataFrame:
    """rows, unless a fold has no more rows than an observation takes, so that nothing could be traded: that is an error."""
    short = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") <= cfg.obs_window).orderBy(*keys).limit(5).collect()
    if short or rows.isEmpty():
        found = "; ".join(f"{', '.join(str(r[k]) for k in keys)} has {r['n']}" for r in short) or "there are none"
        raise ValueError(f"a backtest takes more than {cfg.obs_window} rows: {found}")
    return rows


#: Bins of a density: with them a range of 20 bandwidths is cut to 2e-5 of one.
BINS = 2**20


def density(log: DataFrame, points: int = 200, cut: float = 3.0) -> DataFrame:
    """(point, x, density): Gaussian kernel density of returns on a grid that reaches `cut` bandwidths past both ends.

    The bandwidth h is the sample deviation times n ** -0.2.  A return is shared
    between the two of BINS bins it lies between, in proportion, in one
    aggregate; kernels are then summed over bins, so a grid costs as much for a
    million returns as for a billion.  A bin's width d puts the density out by
    at most (d / h) ** 2 / 8 of 0.4 / h.  A log of fewer than two steps or of
    equal returns has no row.
    """
    e = log.agg(F.min("ret").alias("lo"), F.max("ret").alias("hi"), F.count("ret").alias("n"), F.stddev_samp("ret").alias("sd"))
    e = e.where("n > 1 and sd > 0").withColumn("h", F.col("sd") * F.pow(F.col("n"), F.lit(-0.2)))
    place = F.least((F.col("ret") - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(1.0)) * (BINS - 1)
    share = log.select("ret").where("ret is not null").crossJoin(F.broadcast(e)).select(place.alias("p"), F.floor(place).alias("b"))
    ends = F.array(F.struct(F.col("b").alias("b"), (1 - (F.col("p") - F.col("b"))).alias("w")), F.struct((F.col("b") + 1).alias("b"), (F.col("p") - F.col("b")).alias("w")))
    bins = share.select(F.explode(ends).alias("e")).select("e.*").where("w > 0").groupBy("b").agg(F.sum("w").alias("w"))
    step = (F.col("hi") - F.col("lo") + 2 * cut * F.col("h")) / (points - 1)
    at = F.col("lo") - cut * F.col("h") + F.col("point") * step
    grid = bins.crossJoin(F.broadcast(e)).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", at)
    ret = F.col("lo") + F.col("b") * (F.col("hi") - F.col("lo")) / (BINS - 1)
    kernel = F.col("w") * F.exp(-F.pow((F.col("x") - ret) / F.col("h"), F.lit(2.0)) / 2) / (F.col("n") * F.col("h") * 2.5066282746310002)
    return grid.groupBy("point").agg(F.first("x").alias("x"), F.sum(kernel).alias("density"))
