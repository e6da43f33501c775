"""Policy scoring as set-based jobs: candidates, choices, thresholds, impact of an event, exposure to congestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.functions.scalars import sum_once
from roadweave.operators.joins import in_parts, sent_if_few


def score_candidates(cells: DataFrame, load: DataFrame, weight: float, scale: float) -> DataFrame:
    """request, candidate, eta, delta, cost, best: travel time and the growth of squared load over scale that a car more brings to each road of
    the candidate; the cheapest is best, the smaller number among equals. cells: request, candidate, seg, eta (of the cell); load: seg, load. Sums
    are rounded once, so that the order in which cells arrive decides no tie."""
    grown = (2 * F.coalesce("load", F.lit(0)) + 1) / (scale * scale)
    total = sum_once("eta") if dict(cells.dtypes)["eta"] == "double" else F.sum("eta")
    met = cells.join(sent_if_few(load), "seg", "left").select("request", "candidate", "eta", grown.alias("grown"))
    c = in_parts(met, cells.count(), "request").groupBy("request", "candidate").agg(total.alias("eta"), sum_once("grown").alias("delta"))
    c = c.withColumn("cost", F.col("eta") + weight * F.col("delta"))
    return c.withColumn("best", F.row_number().over(Window.partitionBy("request").orderBy("cost", "candidate")) == 1)


def validate_choices(candidates: DataFrame, choices: DataFrame, most_s: float = 180.0, share: float = 0.15) -> DataFrame:
    """request, problem (null: valid): a request has one choice, of a known candidate, within the bound over its fastest. candidates: request,
    candidate, eta, of repeats the least; choices: request, candidate."""
    candidates = candidates.groupBy("request", "candidate").agg(F.min("eta").alias("eta"))
    fastest = candidates.groupBy("request").agg(F.min("eta").alias("fastest"))
    chosen = choices.groupBy("request").agg(F.count("*").alias("n"), F.min("candidate").alias("candidate"))
    c = fastest.join(chosen, "request", "left").join(candidates, ["request", "candidate"], "left")
    late = F.col("eta") - F.col("fastest") > F.least(F.lit(most_s), F.col("fastest") * share)
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "several").when(F.col("eta").isNull(), "unknown").when(late, "detour")
    return c.select("request", problem.alias("problem"))


def target_checks(pairs: DataFrame, reduction: float, guard: float) -> DataFrame:
    """policy and what holds of it: a mean reduction of at least that share, more blocks better than worse, none worse than the guard.
    pairs: policy, block, diff, base."""
    rel = F.try_divide(F.sum("diff"), F.sum("base"))
    better, worse = F.count_if(F.col("diff") < 0), F.count_if(F.col("diff") > 0)
    t = pairs.groupBy("policy").agg((rel <= -reduction).alias("reduced"), (better > worse).alias("consistent"), (F.max(F.try_divide("diff", "base")) <= guard).alias("guarded"))
    return t.withColumn("promote", F.col("reduced") & F.col("consistent") & F.col("guarded"))


def select_policy(runs: DataFrame, development: Column) -> DataFrame:
    """The best policy and its challenger by their mean over development blocks alone. runs: policy, block, metric."""
    means = runs.filter(development).groupBy("policy").agg(F.avg("metric").alias("mean"))
    top = means.orderBy("mean", "policy").limit(2)
    return top.withColumn("role", F.when(F.row_number().over(Window.orderBy("mean", "policy")) == 1, "best").otherwise("challenger"))


def group_outcomes(trips: DataFrame, *keys: str) -> DataFrame:
    """Participants against others by keys. trips: keys, participant, seconds (null: not arrived)."""
    side = lambda c, p: (F.count_if(c).alias(f"{p}_trips"), F.try_divide(F.count_if(c & F.col("seconds").isNotNull()), F.count_if(c)).alias(f"{p}_arrived"), F.avg(F.when(c, F.col("seconds"))).alias(f"{p}_mean_s"))
    p = F.coalesce("participant", F.lit(False))
    return trips.groupBy(*keys).agg(*side(p, "part"), *side(~p, "other"))


def congestion_exposure(readings: DataFrame, slow: float, stopped: float, window_s: int = 300) -> DataFrame:
    """Vehicle seconds seen, congested and stopped by window of each road. readings: seg, t, speed, seconds."""
    s = F.col("seconds")
    part = lambda c: F.coalesce(F.sum(F.when(c, s)), F.lit(0))
    return readings.groupBy("seg", (F.floor(F.col("t") / window_s) * window_s).alias("win")).agg(F.sum(s).alias("observed_s"), part(F.col("speed") < slow).alias("congested_s"), part(F.col("speed") < stopped).alias("stopped_s"))


def pair_impact(cells: DataFrame, share: float = 0.1) -> DataFrame:
    """seg, peak_bucket, peak, recovered: the largest difference of the event run's delay to the control's, the earliest among equals, and the
    first later bucket under that share of it (null: none). cells: seg, bucket, event, control; a null side takes no part."""
    d = cells.withColumn("diff", F.col("event") - F.col("control")).filter("diff is not null").select("seg", "bucket", "diff")
    top = d.groupBy("seg").agg(F.max(F.struct("diff", (-F.col("bucket")).alias("b"))).alias("top")).select("seg", (-F.col("top.b")).alias("peak_bucket"), F.col("top.diff").alias("peak"))
    after = (F.col("bucket") > F.col("peak_bucket")) & (F.col("diff") < share * F.col("peak"))
    return d.join(top, "seg").groupBy("seg", "peak_bucket", "peak").agg(F.min(F.when(after, F.col("bucket"))).alias("recovered"))


def run_impact(cells: DataFrame, ends: DataFrame, share: float = 0.1) -> DataFrame:
    """pair, peak_bucket, peak, recovered: of the delay of all roads together, the largest difference of the event run to its control (the earliest
    among equals), and the first bucket from it and from the event's end on under that share of it, 1 second at least (null: none).
    cells: pair, bucket, seg, event, control (a null adds nothing); ends: pair, end_bucket. One row a pair and bucket is what is compared."""
    d = cells.groupBy("pair", "bucket").agg(F.sum(F.coalesce("event", F.lit(0.0)) - F.coalesce("control", F.lit(0.0))).alias("diff"))
    top = d.groupBy("pair").agg(F.max(F.struct("diff", (-F.col("bucket")).alias("b"))).alias("top")).select("pair", (-F.col("top.b")).alias("peak_bucket"), F.col("top.diff").alias("peak"))
    late = (F.col("bucket") >= F.greatest("peak_bucket", F.coalesce("end_bucket", "peak_bucket"))) & (F.col("diff") < share * F.greatest("peak", F.lit(1.0)))
    return d.join(top, "pair").join(ends, "pair", "left").groupBy("pair", "peak_bucket", "peak").agg(F.min(F.when(late, F.col("bucket"))).alias("recovered"))


def detour_roads(volumes: DataFrame, hours: float, more: float = 30.0, times: float = 1.5) -> DataFrame:
    """pair, seg, event, control: open roads that carry `more` vehicles an hour more in the event run, and so many times as many as in the control,
    over the declared hours. volumes: pair, seg, bucket, event, control, closed (at any time: no detour)."""
    v = volumes.groupBy("pair", "seg").agg(F.sum(F.coalesce("event", F.lit(0))).alias("event"), F.sum(F.coalesce("control", F.lit(0))).alias("control"), F.bool_or(F.coalesce("closed", F.lit(False))).alias("shut"))
    return v.filter(~F.col("shut") & (F.col("event") - F.col("control") >= more * hours) & (F.col("event") >= times * F.greatest("control", F.lit(1)))).select("pair", "seg", "event", "control")


def validate_forecast(forecast: DataFrame) -> DataFrame:
    """problem, rows: what breaks the contract of a forecast. forecast: seg, valid_from, valid_to, speed, ratio."""
    after = F.lead("valid_from").over(Window.partitionBy("seg").orderBy("valid_from"))
    f = forecast.withColumn("after", after)
    rules = {"empty_interval": F.col("valid_to") <= F.col("valid_from"), "gap": F.col("after") > F.col("valid_to"), "overlap": F.col("after") < F.col("valid_to"), "no_speed": F.col("speed").isNull(), "ratio_range": ~F.col("ratio").between(0, 1)}
    found = F.filter(F.array(*(F.when(rule, name) for name, rule in rules.items())), lambda x: x.isNotNull())
    return f.select(F.explode(found).alias("problem")).groupBy("problem").agg(F.count("*").alias("rows"))


def warning_scores(scored: DataFrame, *keys: str, recall: float = 0.7) -> DataFrame:
    """How well a score warns, by keys: threshold of the best f1 (the higher score among equals), f1, recall_threshold (the highest score that
    finds that share of the positives), brier, average_precision, mean_score and rate. scored: keys, score, label; null scores take no part,
    a null label is none. Rows are counted by distinct score first, so windows see scores, not rows: round scores to a grid beforehand."""
    s = scored.filter("score is not null").groupBy(*keys, "score").agg(F.count("*").alias("n"), F.count_if(F.col("label")).alias("pos"))
    mine = Window.partitionBy(*keys)
    down = mine.orderBy(F.desc("score"))
    s = s.withColumn("seen", F.sum("n").over(down)).withColumn("hit", F.sum("pos").over(down)).withColumn("every", F.sum("pos").over(mine))
    n, pos, score, every = (F.col(c) for c in ("n", "pos", "score", "every"))
    s = s.withColumn("f1", 2 * F.col("hit") / (F.col("seen") + every))
    rows = F.sum("n")
    return s.groupBy(*keys).agg(
        F.max(F.struct("f1", "score")).getField("score").alias("threshold"), F.max("f1").alias("f1"), F.max(F.when(F.try_divide("hit", "every") >= recall, score)).alias("recall_threshold"),
        (F.sum(n * score * score - 2 * score * pos + pos) / rows).alias("brier"), F.sum(F.try_divide(F.col("hit") / F.col("seen") * pos, every)).alias("average_precision"), (F.sum(n * score) / rows).alias("mean_score"), (F.sum("pos") / rows).alias("rate"),
    )
