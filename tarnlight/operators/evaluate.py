"""Agreement, metrics, calibration and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlight.functions import rules as R
from tarnlight.operators.prefix import sums_before


def join_truth(predictions: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Predictions without a label are left out."""
    return predictions.join(truth, key)


def with_meta(df: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """Columns of ``meta``, '' where there is no row or value."""
    names = [c for c in meta.columns if c != key]
    return df.join(meta, key, "left").withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in names})


def with_coverage(df: DataFrame, prediction: str = "prediction") -> tuple[DataFrame, DataFrame]:
    """Rows with a prediction, and one row with the share of all that these are."""
    return df.where(F.col(prediction).isNotNull()), df.agg(F.avg(F.col(prediction).isNotNull().cast("double")).alias("coverage"))


def _rate(a: Column, b: Column) -> Column:
    return a / F.greatest(F.lit(1), b)


def binary_metrics(df: DataFrame, *by: str, y: str = "y", pred: str = "pred") -> DataFrame:
    """Counts, accuracy, precision, sensitivity, specificity, F1, in one pass. Empty denominators give 0."""
    of = lambda a, b: F.count_if((F.col(y) == a) & (F.col(pred) == b))
    out = df.groupBy(*by).agg(of(1, 1).alias("tp"), of(0, 1).alias("fp"), of(0, 0).alias("tn"), of(1, 0).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    p, r = _rate(tp, tp + fp), _rate(tp, tp + fn)
    return out.select(
        *by, "tp", "fp", "tn", "fn", F.round(_rate(tp + tn, tp + fp + tn + fn), 6).alias("accuracy"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("sensitivity"),
        F.round(_rate(tn, tn + fp), 6).alias("specificity"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"),
    )


def confusion(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Counts of each pair of truth and prediction."""
    return df.groupBy(y, pred).agg(F.count("*").alias("n"))


def per_class_metrics(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Precision, recall, F1 and support of each class of truth or prediction."""
    n = confusion(df, y, pred)
    long = n.select(F.explode(F.array(
        F.struct(F.col(y).alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("said"), F.when(F.col(y) == F.col(pred), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col(pred).alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("said"), F.lit(0).cast("bigint").alias("hit")),
    )).alias("x")).select("x.*")
    sums = long.groupBy("class").agg(F.sum("support").alias("support"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    p, r = _rate(F.col("hit"), F.col("said")), _rate(F.col("hit"), F.col("support"))
    return sums.select("class", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"), "support", "hit")


def multiclass_metrics(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Accuracy and the macro averages."""
    return per_class_metrics(df, y, pred).agg(
        F.round(F.sum("hit") / F.greatest(F.lit(1), F.sum("support")), 6).alias("accuracy"), F.round(F.avg("precision"), 6).alias("macro_precision"),
        F.round(F.avg("recall"), 6).alias("macro_recall"), F.round(F.avg("f1"), 6).alias("macro_f1"),
    )


def _by_score(df: DataFrame, by: tuple[str, ...], y: str, p: str) -> DataFrame:
    """Positives and negatives of each distinct score, counted or added up. What follows needs an order only over distinct scores."""
    if {"pos", "neg"} <= set(df.columns):
        return df.groupBy(*by, p).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return df.groupBy(*by, p).agg(F.sum(F.col(y)).cast("double").alias("pos"), F.sum(1 - F.col(y)).cast("double").alias("neg"))


def roc_auc(df: DataFrame, *by: str, y: str = "y", p: str = "p") -> DataFrame:
    """The Mann-Whitney form; tied scores count half. One class only: null."""
    s = sums_before(_by_score(df, by, y, p), by, F.col(p), ("neg",))
    return s.groupBy(*by).agg(F.round(F.try_divide(F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")), 6).alias("auc"))


def roc_curve(df: DataFrame, *by: str, y: str = "y", p: str = "p") -> DataFrame:
    """(threshold, fpr, tpr) with thresholds falling, after a first point (0, 0) at infinity."""
    s = sums_before(_by_score(df, by, y, p), by, F.desc(p), ("pos", "neg"))
    whole = s.groupBy(*by).agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    s = s.join(whole, list(by)) if by else s.crossJoin(F.broadcast(whole))  # one row
    share = lambda c: (F.col(f"before_{c}") + F.col(c)) / F.greatest(F.lit(1.0), F.col(f"_{c}"))
    points = s.select(*by, F.col(p).cast("double").alias("threshold"), share("neg").alias("fpr"), share("pos").alias("tpr"))
    start = s.select(*by, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")).distinct()
    return start.unionByName(points)


def youden(df: DataFrame, *by: str, y: str = "y", p: str = "p") -> DataFrame:
    """The threshold that maximises TPR - FPR, of equals the highest; infinity becomes 1."""
    # rounded, so that gains that differ only in the order of additions are equal
    best = F.max(F.struct(F.round(F.col("tpr") - F.col("fpr"), 9).alias("j"), F.col("threshold"))).alias("m")
    curve = roc_curve(df, *by, y=y, p=p)
    return curve.groupBy(*by).agg(best).select(*by, F.when(F.col("m.threshold") > 1, 1.0).otherwise(F.col("m.threshold")).alias("tau"), F.round("m.j", 6).alias("j"))


def _draw(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def stratified_folds(df: DataFrame, key: str, y: str = "y", k: int = 5, seed: int = 42) -> DataFrame:
    """A fold from 0 to k-1 for each row; each label is dealt evenly in a seeded order.

    Rows are counted by label and the first byte of their draw, then ordered within a byte, so that no window holds a label.
    """
    drawn = df.withColumn("_d", _draw(seed, F.col(key))).withColumn("_b", F.substring("_d", 1, 3))
    sizes = drawn.groupBy(y, "_b").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(y).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(y, "_b", before.alias("_o"))
    place = F.row_number().over(Window.partitionBy(y, "_b").orderBy("_d", key)) - 1
    return drawn.withColumn("_r", place).join(offsets, [y, "_b"]).withColumn("fold", F.pmod(F.col("_r") + F.col("_o"), F.lit(k)).cast("int")).drop("_d", "_b", "_r", "_o")


def cv_calibrate(folded: DataFrame, y: str = "y", p: str = "p", k: int = 5) -> DataFrame:
    """For each fold tau from the others' rows, and the fold's metrics at it. Rows are counted by fold and score first."""
    train = _by_score(folded, ("fold",), y, p).withColumn("test_fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where(F.col("fold") != F.col("test_fold"))
    taus = youden(train, "test_fold", y=y, p=p).select(F.col("test_fold").alias("fold"), "tau")
    tested = folded.join(F.broadcast(taus), "fold").withColumn("pred", (F.col(p) >= F.col("tau")).cast("int"))
    return binary_metrics(tested, "fold", "tau", y=y)


def cv_summary(folds: DataFrame) -> DataFrame:
    """Mean and population deviation over folds, and pooled accuracy."""
    names = ("accuracy", "sensitivity", "specificity", "f1")
    stats = [f(c).alias(f"{n}_{c}") for c in names for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    pooled = F.sum(F.col("tp") + F.col("tn")) / F.sum(F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))
    out = folds.agg(*stats, pooled.alias("pooled_accuracy"))
    return out.select(*[F.round(c, 5).alias(c) for c in out.columns])


def ood_gap(pooled: DataFrame, internal: float) -> DataFrame:
    """internal minus out-of-distribution accuracy in points, with its verdict."""
    gap = (F.lit(internal) - F.col("pooled_accuracy")) * 100
    return pooled.select(F.round(gap, 3).alias("gap_pp"), R.ood_verdict(gap).alias("verdict"))


def fleiss_kappa(votes: DataFrame, columns: list[str], categories: list[int], binary: bool = False) -> DataFrame:
    """Kappa over rows without blank votes; binary: votes above 1 are 1."""
    full = votes.dropna(subset=columns)
    cast = [(F.least(F.lit(1), F.col(c)) if binary else F.col(c)) for c in columns]
    cats = [c for c in categories if not binary or c <= 1]
    n = len(columns)
    count = lambda c: sum(F.when(x == c, 1).otherwise(0) for x in cast)
    rows = full.select(*[count(c).alias(f"c{i}") for i, c in enumerate(cats)])
    agree = (sum(F.pow(F.col(f"c{i}"), 2) for i in range(len(cats))) - n) / (n * (n - 1))
    sums = rows.agg(F.count("*").alias("items"), F.avg(agree).alias("p"), *[(F.avg(f"c{i}") / n).alias(f"s{i}") for i in range(len(cats))])
    chance = sum(F.pow(F.col(f"s{i}"), 2) for i in range(len(cats)))
    return sums.select("items", F.round(F.try_divide(F.col("p") - chance, 1 - chance), 6).alias("kappa"))


def pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    """A24"""
    return df.agg(F.round(F.corr(F.col(a).cast("double"), F.col(b).cast("double")), 6).alias("pearson"))


def average_rank(df: DataFrame, c: str, out: str) -> DataFrame:
    """Ranks of column c with ties averaged, from counts of distinct values."""
    n = sums_before(df.groupBy(c).agg(F.count("*").alias("_n")), (), F.col(c), ("_n",))
    ranks = n.select(c, (F.col("before__n") + (F.col("_n") + 1) / 2).alias(out))
    return df.join(ranks, c)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """A25"""
    return average_rank(average_rank(df, a, "_ra"), b, "_rb").agg(F.round(F.corr("_ra", "_rb"), 6).alias("spearman"))


def class_weights(df: DataFrame, label: str, *by: str) -> DataFrame:
    """N / (classes * n of the class), and each class's share."""
    n = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*by)
    return n.withColumn("weight", F.round(F.sum("n").over(whole) / (F.lit(2) * F.col("n")), 6)).withColumn("share", F.round(F.col("n") / F.sum("n").over(whole), 6))


def dq_report(votes: DataFrame, key: str, columns: list[str], consensus: Column, least: int = 200, most: int = 300) -> DataFrame:
    """Rows, distinct items, empty cells, agreement of consensus and mode, names by pattern; PASS or FAIL."""
    mode = R.mode_first(*[F.col(c) for c in columns])
    out = votes.agg(
        F.count("*").alias("rows"), F.count_distinct(key).alias("items"), F.sum(sum(F.col(c).isNull().cast("int") for c in columns)).alias("empty_cells"),
        F.count_if(consensus == mode).alias("consensus_is_mode"), F.count_if(F.col(key).cast("string").rlike("^[0-9]+$")).alias("well_named"),
    )
    good = F.col("rows").between(least, most) & (F.col("empty_cells") == 0) & (F.col("consensus_is_mode") == F.col("rows"))
    return out.withColumn("verdict", F.when(good, "PASS").otherwise("FAIL"))


def check_claims(got: DataFrame, claims: DataFrame) -> DataFrame:
    """Got (name, value) against claims (name, expected, tolerance); without a value the claim fails."""
    ok = F.coalesce(F.abs(F.col("value") - F.col("expected")) <= F.col("tolerance"), F.lit(False))
    return claims.join(got, "name", "left").select("name", "value", "expected", F.when(ok, "PASS").otherwise("FAIL").alias("verdict"))


def extremes(df: DataFrame, score: str, key: str, k: int = 10) -> DataFrame:
    """The k lowest and the k highest by score."""
    low = df.orderBy(score, key).limit(k).withColumn("end", F.lit("low"))
    return low.unionByName(df.orderBy(F.desc(score), key).limit(k).withColumn("end", F.lit("high")))


def ensemble_report(metrics: DataFrame, ensemble: str) -> DataFrame:
    """metrics (model, f1): the best single model, the ensemble's gain in points, and the verdict."""
    best = metrics.agg(
        F.max(F.when(F.col("model") != ensemble, F.struct("f1", "model"))).alias("best"), F.max(F.when(F.col("model") == ensemble, F.col("f1"))).alias("f1"),
    )
    delta = (F.col("f1") - F.col("best.f1")) * 100
    return best.select(F.col("best.model").alias("best_single"), F.round(delta, 4).alias("delta_pp"), R.ensemble_verdict(delta).alias("verdict"))


def audit_summary(leak: DataFrame, bench: DataFrame, before: float) -> DataFrame:
    """One-row leakage and benchmark reports side by side. leak: level; bench: accuracy. An empty one: not run."""
    one = leak.agg(F.max("level").alias("level")).crossJoin(bench.agg(F.max("accuracy").alias("accuracy")))  # one row each
    return one.select(
        F.coalesce("level", F.lit("NOT RUN")).alias("leakage"), "accuracy", F.round((F.lit(before) - F.col("accuracy")) * 100, 4).alias("drop_pp"),
        R.audit_conclusion(F.col("level"), F.lit(before), F.col("accuracy")).alias("conclusion"),
    )


def evidence_counts(df: DataFrame, *columns: str) -> DataFrame:
    """A32"""
    return df.groupBy(R.evidence_status(*[F.col(c) for c in columns]).alias("evidence_status")).agg(F.count("*").alias("n"))
