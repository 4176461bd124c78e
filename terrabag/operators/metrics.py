"""Ranking and classification metrics of scored bags (label 0 or 1, score). Scores are relative suitability, not probability."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import correlation, rank_average, running_sums

TINY = 1e-10


def confusion(scored: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """tp, tn, fp and fn of score >= threshold, for each threshold; the thresholds are few, so each row meets all of them."""
    t = scored.select("label", F.col("score"), F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold"))
    yes, pos = F.col("score") >= F.col("threshold"), F.col("label") == 1
    return t.groupBy("threshold").agg(F.count_if(yes & pos).alias("tp"), F.count_if(~yes & ~pos).alias("tn"), F.count_if(yes & ~pos).alias("fp"), F.count_if(~yes & pos).alias("fn"))


def _divide(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.when(F.abs(b) < TINY, F.lit(default)).otherwise(a / b)


def cohens_kappa(tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    n = (tp + tn + fp + fn).cast("double")
    po = (tp + tn) / n
    pe = ((tp + fp) / n) * ((tp + fn) / n) + ((tn + fn) / n) * ((tn + fp) / n)
    return F.when(n == 0, 0.0).when(pe == 1, F.when(po == 1, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe))


def metric_columns(tp: Column, tn: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """The closed-form metrics of a confusion table by name; what isn't finite counts as 0."""
    tp, tn, fp, fn = (c.cast("double") for c in (tp, tn, fp, fn))
    n = tp + tn + fp + fn
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    se, sp, pr, npv = ratio(tp, tp + fn), ratio(tn, fp + tn), ratio(tp, tp + fp), ratio(tn, tn + fn)
    prev, acc, err, other, pm, pm2 = (tp + fn) / n, (tp + tn) / n, (fp + fn) / n, (tn + fp) / n, (tp + fp) / n, (fn + tn) / n
    fom, fdr = ratio(fn, fn + tn), ratio(fp, tp + fp)
    lrp, lrn = _divide(se, 1 - sp), _divide(1 - se, sp)
    kg, kg2 = F.when(se == 0, 0.0).otherwise(1 - (1 - sp) / se), F.when(se == 0, 0.0).otherwise(1 - pm / se)
    dor = F.when((sp > 0) & (sp < 1), _divide(_divide(se, 1 - sp), _divide(1 - se, sp))).otherwise(0.0)
    log10 = lambda c: F.when(c > 0, F.log10(F.when(c > 0, c).otherwise(1.0))).otherwise(0.0)
    squash = lambda p: F.greatest(F.least(p, F.lit(1 - 1e-10)), F.lit(1e-10))
    logit = lambda p: F.log(squash(p) / (1 - squash(p)))
    mcc_den = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    indicative2 = _divide(se, pm)
    afk = se * _divide(se - (1 - sp), other)
    return {
        "sensitivity": se, "specificity": sp, "prevalence": prev, "accuracy": acc, "err_rate": err, "other": other, "pm": pm, "pm_prime": pm2,
        "precision": pr, "recall": se, "tpr": se, "tnr": sp, "power": se, "ppv": pr, "npv": npv, "fpr": 1 - sp, "fnr": 1 - se, "for_rate": fom, "fdr": fdr,
        "f_measure": ratio(2 * pr * se, pr + se), "geo_mean": F.when((tp > 0) & (tn > 0), F.sqrt(tp * tn)).otherwise(0.0),
        "mae": err, "brier": err, "rmse": F.sqrt(err), "lrp": lrp, "indicative": lrp, "log_lrp": log10(lrp), "lrn": lrn, "kg": kg, "kg2": kg2,
        "dor": dor, "log_dor": log10(dor), "d": logit(se) - logit(1 - sp), "s": logit(se) + logit(1 - sp), "kappa": cohens_kappa(tp, tn, fp, fn),
        "opp_precision": F.when(se + sp == 0, 0.0).otherwise(acc - F.abs(sp - se) / (sp + se)),
        "mcc": F.when(mcc_den == 0, 0.0).otherwise((tp * tn - fp * fn) / F.sqrt(mcc_den)), "informedness": se + sp - 1, "markedness": pr + npv - 1,
        "afk": F.when(afk < 0, 0.0).otherwise(F.sqrt(afk)), "indicative2": indicative2, "indicative_norm": _divide(lrp, other), "indicative_norm2": _divide(indicative2, other),
        "x1": _divide(pr, prev), "ppg": _divide(pr, prev), "x2": _divide(fom, prev), "npg": _divide(fom, prev), "x3": _divide(fdr, other), "x4": _divide(npv, other),
        "balance": (kg + F.when(sp > 0, 1 - (1 - se) / sp).otherwise(0.0)) / 2,
        "balance2": (F.when(se > 0, 1 - pm / se).otherwise(0.0) + F.when(pm2 > 0, 1 - (1 - se) / pm2).otherwise(0.0)) / 2,
    }


def metrics(quads: DataFrame) -> DataFrame:
    """quads (threshold, tp, tn, fp, fn) with every metric as a column."""
    cols = metric_columns(*[F.col(c) for c in ("tp", "tn", "fp", "fn")])
    clean = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")) | c.isNull(), 0.0).otherwise(c)
    return quads.select("threshold", *[clean(c).alias(k) for k, c in cols.items()])


def by_score(scored: DataFrame, partition: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives of each distinct score, with running sums from the largest score on."""
    g = scored.groupBy(*partition, "score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    if not partition:
        return running_sums(g, [F.desc("score")], ["pos", "neg"]).withColumnsRenamed({"run_pos": "tp", "run_neg": "fp"})
    w = Window.partitionBy(*partition).orderBy(F.desc("score"))
    return g.withColumn("tp", F.sum("pos").over(w)).withColumn("fp", F.sum("neg").over(w))


def roc_auc(scored: DataFrame, partition: Sequence[str] = ()) -> DataFrame:
    """auc: chance that a positive outranks a negative, ties half; null with one class. Works on distinct scores, so ties are cheap."""
    s = by_score(scored, partition)
    wins = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + F.col("pos") / 2.0))
    p, n = F.sum("pos"), F.sum("neg")
    out = s.groupBy(*partition).agg(wins.alias("wins"), p.alias("p"), n.alias("n"))
    return out.select(*partition, F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("wins") / (F.col("p") * F.col("n")).cast("double")).alias("auc"))


def average_precision(scored: DataFrame, partition: Sequence[str] = ()) -> DataFrame:
    """Sum of precision times gained recall over distinct scores; null without positives."""
    s = by_score(scored, partition)
    gain = F.sum(F.col("pos").cast("double") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return s.groupBy(*partition).agg((gain / F.nullif(F.sum("pos"), F.lit(0)).cast("double")).alias("average_precision"))


def roc_curve(scored: DataFrame) -> DataFrame:
    """threshold, fpr, tpr for each distinct score."""
    s = by_score(scored)
    total = scored.agg(F.count_if(F.col("label") == 1).cast("double").alias("p"), F.count_if(F.col("label") == 0).cast("double").alias("n"))
    return s.crossJoin(F.broadcast(total)).select(F.col("score").alias("threshold"), (F.col("fp") / F.col("n")).alias("fpr"), (F.col("tp") / F.col("p")).alias("tpr"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson correlation of average ranks."""
    t = df.select(F.col(a).alias("a"), F.col(b).alias("b"))
    for c in ("a", "b"):
        # Ranks come from distinct values and their counts, which are summed range by range.
        ranks = running_sums(t.groupBy(c).agg(F.count(F.lit(1)).alias("n")), [F.asc(c)], ["n"])
        t = t.join(ranks.select(c, (F.col("run_n") - (F.col("n") - 1) / 2.0).alias(f"r{c}")), c)
    return t.agg(correlation("ra", "rb").alias("spearman"))


def quantile_edges(scored: DataFrame, n_bins: int) -> DataFrame:
    """One row: the sorted distinct quantiles of the score at n_bins + 1 equal steps."""
    at = F.array(*[F.lit(i / n_bins) for i in range(n_bins + 1)])
    return scored.agg(F.array_sort(F.array_distinct(F.percentile("score", at))).alias("edges"))


def boyce_bins(scored: DataFrame, n_bins: int = 10) -> DataFrame:
    """bin, presences, backgrounds, mean score and the ratio of presence share to background share of each quantile bin."""
    edges = quantile_edges(scored, n_bins)
    inner = F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 2, F.lit(0)))
    t = scored.crossJoin(F.broadcast(edges)).filter(F.size("edges") >= 4).withColumn("bin", F.size(F.filter(inner, lambda e: e < F.col("score"))))
    b = t.groupBy("bin").agg(F.count_if(F.col("label") == 1).alias("presences"), F.count_if(F.col("label") == 0).alias("backgrounds"), F.avg("score").alias("centre"))
    total = scored.agg(F.count_if(F.col("label") == 1).cast("double").alias("p"), F.count_if(F.col("label") == 0).cast("double").alias("n"))
    ratio = F.when(F.col("backgrounds") > 0, (F.col("presences") / F.col("p")) / (F.col("backgrounds") / F.col("n")))
    return b.crossJoin(F.broadcast(total)).select("bin", "presences", "backgrounds", "centre", ratio.alias("ratio"))


def boyce_index(scored: DataFrame, n_bins: int = 10, guard_constant: bool = True) -> DataFrame:
    """Spearman correlation of bin centres and ratios; null with under three ratios or, if guarded, constant ones."""
    b = boyce_bins(scored, n_bins).filter("ratio is not null")
    r = b.select("ratio", rank_average("centre").alias("rc"), rank_average("ratio").alias("rr"))
    enough = F.count(F.lit(1)) >= 3
    if guard_constant:
        enough = enough & (F.max("ratio") > F.min("ratio"))
    return r.agg(F.when(enough, correlation("rc", "rr")).alias("boyce"))


def continuous_boyce(scored: DataFrame, n_windows: int = 20, width: float = 0.1) -> DataFrame:
    """Spearman correlation of window centres and presence-to-background ratios over overlapping half-open score windows."""
    span = scored.agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.count_if(F.col("label") == 1).cast("double").alias("p"), F.count_if(F.col("label") == 0).cast("double").alias("n"))
    step = (F.col("hi") - F.col("lo")) * F.lit(1 - width) / F.lit(float(n_windows - 1))
    size = (F.col("hi") - F.col("lo")) * F.lit(width)
    w = span.filter("hi > lo").select("p", "n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n_windows - 1)), lambda i: F.struct((F.col("lo") + i * step).alias("s"), (F.col("lo") + i * step + size).alias("e")))).alias("w"))
    w = w.select("p", "n", "w.s", "w.e")
    # The windows are few and fixed in number: each score meets those that hold it.
    counts = scored.join(F.broadcast(w), (F.col("score") >= F.col("s")) & (F.col("score") < F.col("e"))).groupBy("s", "e", "p", "n").agg(F.count_if(F.col("label") == 1).alias("a"), F.count_if(F.col("label") == 0).alias("b"))
    r = counts.filter("b > 0").select(((F.col("s") + F.col("e")) / 2).alias("centre"), ((F.col("a") / F.col("p")) / (F.col("b") / F.col("n"))).alias("ratio"))
    return r.select(rank_average("centre").alias("rc"), rank_average("ratio").alias("rr")).agg(F.when(F.count(F.lit(1)) >= 3, correlation("rc", "rr")).alias("cbi"))


def presence_background(scored: DataFrame, top: float = 0.05) -> DataFrame:
    """One row: auc, pr_auc, boyce, top_5_percent_lift and score_separation."""
    cut = scored.agg(F.percentile("score", F.lit(1 - top)).alias("cut"), F.avg("label").alias("prevalence"))
    lift = scored.crossJoin(F.broadcast(cut)).agg((F.avg(F.when(F.col("score") >= F.col("cut"), F.col("label"))) / F.first("prevalence")).alias("top_5_percent_lift"))
    sep = scored.agg((F.avg(F.when(F.col("label") == 1, F.col("score"))) - F.avg(F.when(F.col("label") == 0, F.col("score")))).alias("score_separation"))
    return roc_auc(scored).crossJoin(average_precision(scored).withColumnRenamed("average_precision", "pr_auc")).crossJoin(boyce_index(scored)).crossJoin(lift).crossJoin(sep)


def capture_curve(scored: DataFrame, item: str) -> DataFrame:
    """area and captured share of positives when rows are taken from the largest score on, ties by item."""
    total = scored.agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("label").cast("double").alias("p"))
    r = running_sums(scored.select(item, "score", "label", F.lit(1).alias("one")), [F.desc("score"), F.asc(item)], ["one", "label"])
    return r.crossJoin(F.broadcast(total)).select(item, (F.col("run_one") / F.col("n")).alias("area"), (F.col("run_label") / F.col("p")).alias("capture"))


def capture_gain(scored: DataFrame, areas: Sequence[float]) -> DataFrame:
    """threshold, capture, gain and lift of the top areas; null where nothing is captured."""
    levels = [min(1.0, max(1e-9, a)) for a in areas]
    cuts = scored.agg(F.percentile("score", F.array(*[F.lit(1 - a) for a in levels])).alias("cut"))
    rows = cuts.select(F.posexplode("cut").alias("k", "threshold")).withColumn("area", F.element_at(F.array(*[F.lit(float(a)) for a in areas]), F.col("k") + 1))
    hit = scored.crossJoin(F.broadcast(rows)).groupBy("area", "threshold").agg((F.sum(F.when(F.col("score") >= F.col("threshold"), F.col("label")).otherwise(0)).cast("double") / F.sum("label")).alias("capture"))
    some = F.col("capture") > 0
    return hit.select("area", "threshold", "capture", F.when(some, 1 - F.col("area") / F.col("capture")).alias("gain"), F.when(some, F.col("capture") / F.col("area")).alias("lift"))


def reliability(scored: DataFrame, n_bins: int = 10) -> DataFrame:
    """Count, mean score and share of positives of equally wide score bins on [0, 1]; a score of 1 falls in the last bin."""
    b = F.least(F.floor(F.col("score") * n_bins), F.lit(n_bins - 1)).cast("int")
    return scored.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.avg("label").alias("observed"))


def optimal_threshold(scored: DataFrame, criterion: str = "tss") -> DataFrame:
    """The threshold among 0, 1 and all scores that is best by tss or f1, the least of equal ones."""
    total = scored.agg(F.count_if(F.col("label") == 1).cast("double").alias("p"), F.count_if(F.col("label") == 0).cast("double").alias("n"))
    s = by_score(scored).select(F.col("score").alias("t"), "tp", "fp")
    ends = total.select(F.lit(0.0).alias("t"), F.col("p").cast("long").alias("tp"), F.col("n").cast("long").alias("fp"))
    above = scored.agg(F.count_if((F.col("score") >= 1) & (F.col("label") == 1)).alias("tp"), F.count_if((F.col("score") >= 1) & (F.col("label") == 0)).alias("fp")).select(F.lit(1.0).alias("t"), "tp", "fp")
    every = s.filter("t > 0 and t <> 1").unionByName(ends).unionByName(above).crossJoin(F.broadcast(total))
    if criterion == "tss":
        value = F.col("tp") / F.col("p") - F.col("fp") / F.col("n")
    elif criterion == "f1":
        value = 2.0 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("p"))
    else:
        raise ValueError("criterion must be 'tss' or 'f1'")
    return every.select(F.col("t").alias("threshold"), value.alias("value")).orderBy(F.desc("value"), "threshold").limit(1)


def cumulative_lift(scored: DataFrame, item: str, fractions: Sequence[float]) -> DataFrame:
    """Mean label of the top max(1, ceil(f n)) rows over the prevalence."""
    total = scored.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("prevalence"))
    r = running_sums(scored.select(item, "score", "label", F.lit(1).alias("one")), [F.desc("score"), F.asc(item)], ["one"])
    r = r.select("label", F.col("run_one").alias("i")).crossJoin(F.broadcast(total))
    r = r.withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    top = r.filter(F.col("i") <= F.greatest(F.lit(1), F.ceil(F.col("fraction") * F.col("n"))))
    return top.groupBy("fraction").agg((F.avg("label") / F.first("prevalence")).alias("lift"))


def score_agreement(df: DataFrame, item: str, a: str, b: str, top: float = 0.05) -> DataFrame:
    """One row: mean absolute difference, Pearson, Spearman and the overlap of the top max(1, ceil(top n)) rows."""
    n = df.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * top)).alias("k"))
    ranked = df.select(item, a, b, F.lit(1).alias("one"))
    for c, name in ((a, "ia"), (b, "ib")):
        ranked = running_sums(ranked, [F.desc(c), F.asc(item)], ["one"]).withColumnRenamed("run_one", name)
    both = ranked.crossJoin(F.broadcast(n)).agg((F.count_if((F.col("ia") <= F.col("k")) & (F.col("ib") <= F.col("k"))) / F.first("k")).alias("top_overlap"))
    return df.agg(F.avg(F.abs(F.col(a) - F.col(b))).alias("mae"), correlation(a, b).alias("pearson")).crossJoin(spearman(df, a, b)).crossJoin(both)


def paired_differences(rows: DataFrame, baseline: str, keys: Sequence[str], value: str) -> DataFrame:
    """By method: pairs with the baseline's row of equal keys, mean difference, its standard error and 95 % interval; null error for one pair."""
    base = rows.filter(F.col("method") == baseline).select(*keys, F.col(value).alias("__base"))
    d = rows.filter(F.col("method") != baseline).join(base, list(keys)).withColumn("__d", F.col(value) - F.col("__base"))
    g = d.groupBy("method").agg(F.count("__d").alias("pairs"), F.avg("__d").alias("mean_difference"), (F.stddev_samp("__d") / F.sqrt(F.count("__d").cast("double"))).alias("standard_error"))
    return g.withColumn("ci_low", F.col("mean_difference") - 1.96 * F.col("standard_error")).withColumn("ci_high", F.col("mean_difference") + 1.96 * F.col("standard_error"))


def student_t_quantile(p: float, df: int) -> float:
    """Quantile of Student's t distribution by bisection on the regularised incomplete beta function."""

    def beta_cf(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        h = d
        for m in range(1, 500):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1.0 + num * d
                d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
                c = 1.0 + num / c
                c = c if abs(c) > 1e-300 else 1e-300
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    def beta_inc(a: float, b: float, x: float) -> float:
        if x <= 0 or x >= 1:
            return 0.0 if x <= 0 else 1.0
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
        return front * beta_cf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * beta_cf(b, a, 1 - x) / b

    def cdf(t: float) -> float:
        tail = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
        return 1 - tail if t > 0 else tail

    low, high = -1e6, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return (low + high) / 2


def replicate_summary(rows: DataFrame, value: str, group: str, n: int, confidence: float = 0.95) -> DataFrame:
    """By group of n replicates: count, mean and t interval; nulls with fewer than two. The quantile is a number from the driver."""
    t = student_t_quantile(0.5 + confidence / 2, n - 1) if n > 1 else float("nan")
    g = rows.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value).cast("double"))).alias("se"))
    return g.select(group, "n", "mean", (F.col("mean") - t * F.col("se")).alias("ci_low"), (F.col("mean") + t * F.col("se")).alias("ci_high"))


def kernel_diagnostics(pairs: DataFrame) -> DataFrame:
    """pairs (bag_i, bag_j, exact, approx) of a whole matrix: relative Frobenius error, largest error, correlation above the diagonal."""
    d = F.col("exact") - F.col("approx")
    up = F.col("bag_i") < F.col("bag_j")
    return pairs.agg((F.sqrt(F.sum(d * d)) / F.sqrt(F.sum(F.col("exact") * F.col("exact")))).alias("relative_error"), F.max(F.abs(d)).alias("max_error"), correlation(F.when(up, F.col("exact")), F.when(up, F.col("approx"))).alias("triangle_correlation"))
