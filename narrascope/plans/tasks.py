"""The catalogue of evaluation tasks: names, kinds and the metric plan of each kind."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrascope.operators import retrieval, stats

#: Task names and their kinds; for the yearly tasks, their datasets.
STS_YEARS = {
    "STS12": ("MSRpar", "MSRvid", "SMTeuroparl", "surprise.OnWN", "surprise.SMTnews"),
    "STS13": ("FNWN", "headlines", "OnWN"),
    "STS14": ("deft-forum", "deft-news", "headlines", "images", "OnWN", "tweet-news"),
    "STS15": ("answers-forums", "answers-students", "belief", "headlines", "images"),
    "STS16": ("answer-answer", "headlines", "plagiarism", "postediting", "question-question"),
}
KINDS = {
    **dict.fromkeys(STS_YEARS, "suite"), "STSBenchmark": "correlation", "SICKRelatedness": "correlation", "SICKEntailment": "classes", "SNLI": "classes",
    **dict.fromkeys(("CR", "MR", "MPQA", "SUBJ", "SST2", "SST5", "TREC"), "classes"), "MRPC": "binary", "ImageCaptionRetrieval": "ranks",
    **dict.fromkeys(("Length", "WordContent", "Depth", "TopConstituents", "BigramShift", "Tense", "SubjNumber", "ObjNumber", "OddManOut", "CoordinationInversion"), "classes"),
}
PRESETS = {"sts": (*STS_YEARS, "STSBenchmark", "SICKRelatedness"), "transfer": ("MR", "CR", "MPQA", "SUBJ", "SST2", "TREC", "MRPC")}
DEFAULTS = {"seed": 1111, "batch": 128, "folds": 5}


def _classes(df: DataFrame) -> DataFrame:
    return df.agg(F.round(100 * F.avg((F.col("gold") == F.col("predicted")).cast("double")), 2).alias("acc"), F.count("*").alias("n"))


def _binary(df: DataFrame) -> DataFrame:
    return df.agg(F.round(100 * F.avg((F.col("gold") == F.col("predicted")).cast("double")), 2).alias("acc"), F.round(stats.binary_f1(F.col("gold"), F.col("predicted")), 2).alias("f1"), F.count("*").alias("n"))


METRICS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "suite": lambda df: stats.correlation_suite(df, "dataset", "predicted", "gold"),
    "correlation": lambda df: stats.correlations(df, [], "predicted", "gold"),
    "classes": _classes,
    "binary": _binary,
    "ranks": lambda df: retrieval.recall_of_first(df) if "first" in df.columns else retrieval.recall_and_median_rank(retrieval.ranked(df)),
}


def evaluate(task: str, scored: DataFrame) -> DataFrame:
    """The metrics of a task over its scored rows: (gold, predicted[, dataset]), or for ranks (q, c, sim, rel), or (q, first) with the rank of the
    first relevant candidate."""
    if task not in KINDS:
        raise ValueError(f"no task {task}")
    return METRICS[KINDS[task]](scored)


def evaluate_all(scored: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {task: evaluate(task, df) for task, df in scored.items()}
