"""Experiment drivers: a grid over parameters, one experiment on a dataset, a batch over files, one run with all its reports."""

from __future__ import annotations

import logging
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import accessors, cluster, epsjoin, evaluate, projection, sampling, scaling
from ..sources import arff
from ..storage import keep

log = logging.getLogger("bagloom")
EPS, MIN_PTS = (0.5, 1.0, 1.5, 2.0, 3.0, 5.0), (2, 3, 4)
RESULT = "dataset string, status string, seconds double, train_bags long, test_bags long, clusters long, noise_pct double, precision double, recall double, f1 double, specificity double, error string"
SCALERS = {"minmax": scaling.MinMax, "zscore": scaling.ZScore}
#: Columns of published result files, their names, and how they call a choice of parameters.
GRID_COLUMNS = ("Eps", "MinPts", "Clusters", "Ruido_Pct", "Precision", "Recall", "Specificity", "F1_Score", "Interpretacion")
EXPERIMENT_COLUMNS = ("Dataset", "Status", "Execution_Time", "Train_Bags", "Test_Bags", "Clusters", "Noise_Pct", "Precision", "Recall", "F1", "Specificity", "Error_Msg")
EXPERIMENT_FILE = "results_summary_scaled_%s.csv"
SCALER_NAMES = {"minmax": "MinMax", "zscore": "Standard", None: "None"}
WORDS = {"excellent": "EXCELENTE", "over-segmented": "Sobre segmentado.", "under-segmented": "Sub segmentado.", "all noise": "Todo Ruido", "poor": "Malo"}


def _scores(found: DataFrame, names: tuple[str, ...]) -> tuple[float, ...]:
    q = evaluate.metrics(keep(found, "judged")).first()  # read for the class map and for the counts
    return tuple(round(q[c], 4) for c in names)


def grid(bags: DataFrame, eps: tuple = EPS, min_pts: tuple = MIN_PTS, mode: str = "compat") -> DataFrame:
    """Fit, predict and evaluate on the same bags for every choice; distances are computed once, at the largest eps."""
    dims = epsjoin.dimensions(bags)
    links = keep(epsjoin.links(bags, max(eps), dims), "grid-links")
    rows = []
    for m in min_pts:
        for e in eps:
            model = cluster.fit(bags, e, m, mode, dims=dims, links=links)
            s = model.statistics().first()
            rows.append((float(e), m, s.clusters, round(s.noise_pct, 2), *_scores(evaluate.labelled(model.predict_fitted(bags, links), bags), ("precision", "recall", "specificity", "f1"))))
    found = bags.sparkSession.createDataFrame(rows, "eps double, min_pts int, clusters long, noise_pct double, precision double, recall double, specificity double, f1 double")
    return found.withColumn("interpretation", evaluate.interpretation(F.col("clusters"), F.col("f1")))


def single(data: arff.Dataset, eps: float = 0.5, min_pts: int = 2, percent: float = 70, seed: int = 42, scaler: str | None = None, mode: str = "compat") -> tuple:
    """One row of RESULT; a failure is a row too."""
    began = time.perf_counter()
    try:
        if scaler is not None and scaler not in SCALERS:
            raise TypeError(f"no scaler {scaler!r}; known: {', '.join(SCALERS)}")
        data = data.numeric()
        train, test = (arff.Dataset(data.name, part, data.attributes) for part in sampling.exact_split(data.bags, percent, seed))
        if scaler is not None:
            fitted = SCALERS[scaler]().fit(train)
            train, test = fitted.transform(train), fitted.transform(test)
        train, test = keep(train.bags, "train"), keep(test.bags, "test")
        model = cluster.fit(train, eps, min_pts, mode, dims=len(data.attributes))
        s = model.statistics().first()
        scores = _scores(evaluate.labelled(model.predict(test), test), ("precision", "recall", "f1", "specificity"))
        return (data.name, "ok", round(time.perf_counter() - began, 2), s.total, test.count(), s.clusters, round(s.noise_pct, 2), *scores, "")
    except Exception as e:  # a batch goes on with its other datasets
        log.exception("experiment on %s failed", data.name)
        return _failed(data.name, e, time.perf_counter() - began)


def _failed(name: str, error: Exception, seconds: float = 0.0) -> tuple:
    return (name, "failed", round(seconds, 2), 0, 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, str(error)[:500])


def batch(spark: SparkSession, folder: str, out: str | None = None, **options) -> DataFrame:
    """A row for each ARFF file of a folder. out: a folder for the report as CSV, named after the scaler."""
    rows = []
    for path in arff.files_of(spark, folder):
        log.info("experiment on %s", path)
        try:
            rows.append(single(arff.read_arff(spark, path), **options))
        except ValueError as e:
            rows.append(_failed(path.rpartition("/")[2], e))
    if not rows:
        log.warning("no ARFF files in %s", folder)
    found = spark.createDataFrame(rows, RESULT)
    if out is not None:
        write_csv(experiment_report(found), f"{out}/{EXPERIMENT_FILE % SCALER_NAMES[options.get('scaler')]}")
    return found


def grid_report(found: DataFrame) -> DataFrame:
    """A grid in the columns and words of published files."""
    words = F.create_map(*[F.lit(x) for pair in WORDS.items() for x in pair])
    return found.select("eps", "min_pts", "clusters", "noise_pct", "precision", "recall", "specificity", "f1", words[F.col("interpretation")]).toDF(*GRID_COLUMNS)


def experiment_report(found: DataFrame) -> DataFrame:
    """Experiments in the columns and words of published files."""
    status = F.when(F.col("status") == "ok", "Success").otherwise("Failed")
    return found.withColumn("status", status).toDF(*EXPERIMENT_COLUMNS)


def write_csv(df: DataFrame, path: str) -> None:
    """A report of few rows as one CSV file with a header, in a folder of that name; an earlier one is replaced."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def as_table(df: DataFrame) -> str:
    """A report of few rows as a Markdown table."""
    rows = [df.columns, *[["" if v is None else str(v) for v in r] for r in df.collect()]]
    widths = [max(len(r[k]) for r in rows) for k in range(len(df.columns))]
    lines = ["| " + " | ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)) + " |" for r in rows]
    return "\n".join([lines[0], "|" + "|".join("-" * (w + 2) for w in widths) + "|", *lines[1:]])


def log_to(path: str) -> None:
    """Sends the package's log to a file and to the console, from level INFO."""
    log.setLevel(logging.INFO)
    for handler in (logging.FileHandler(path, encoding="utf-8"), logging.StreamHandler(sys.stdout)):
        handler.setFormatter(logging.Formatter("%(asctime)s - %(name)s - %(levelname)s - %(message)s"))
        log.addHandler(handler)


def run(spark: SparkSession, path: str, eps: float = 900.0, min_pts: int = 2, percent: float = 70, seed: int = 42, mode: str = "compat", method: str = "pca") -> dict | None:
    """One file from reading to evaluation: split, fit, evaluation of the training bags, coordinates to plot, prediction and evaluation of
    the test bags. Gives model, train, test (metrics as rows) and plot; None if the file can't be read. Each step is logged; if there is
    nothing to plot, the run goes on."""
    try:
        data = arff.read_arff(spark, path).numeric()
        totals = accessors.totals(data.bags).first()
    except Exception as e:
        log.critical("%s cannot be read: %s", path, e)
        return None
    log.info("%r: %d bags, %d instances, %d positive, %d negative", data, totals.bags, totals.instances, totals.positive, totals.negative)
    train, test = (keep(part, name) for part, name in zip(sampling.exact_split(data.bags, percent, seed), ("train", "test"), strict=True))
    model = cluster.fit(train, eps, min_pts, mode, dims=len(data.attributes))
    s = model.statistics().first()
    log.info("%r: %d training bags, %d cores, %d noise", model, s.total, s.cores, s.noise)
    out = {"model": model, "train": keep(evaluate.labelled(model.assignments, train), "judged"), "test": None, "plot": None}
    log.info("training bags\n%s", evaluate.report(out["train"]))
    try:
        out["plot"] = keep(projection.plot_table(train, model.assignments, method), "plot")
    except Exception as e:
        log.error("nothing to plot: %s", e)
    if test.isEmpty():
        log.warning("no test bags")
        return out
    out["test"] = keep(evaluate.labelled(model.predict(test), test), "judged")
    log.info("test bags\n%s", evaluate.report(out["test"]))
    return out


if __name__ == "__main__":
    log_to("bagloom.log")
    run(SparkSession.builder.getOrCreate(), *sys.argv[1:2])
