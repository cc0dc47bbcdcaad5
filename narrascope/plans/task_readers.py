"""Reading the evaluation tasks from their published folders; ``tasks`` has their metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrascope.plans.tasks import KINDS, STS_YEARS
from narrascope.sources import readers

#: The files of each task.
OPINIONS = {"MR": ("rt-polarity.pos", "rt-polarity.neg"), "CR": ("custrev.pos", "custrev.neg"), "SUBJ": ("subj.objective", "subj.subjective"), "MPQA": ("mpqa.pos", "mpqa.neg")}
SENTIMENT = {"train": "sentiment-train", "dev": "sentiment-dev", "test": "sentiment-test"}
BENCHMARK = {"train": "sts-train.csv", "dev": "sts-dev.csv", "test": "sts-test.csv"}
SICK = {"train": "SICK_train.txt", "dev": "SICK_trial.txt", "test": "SICK_test_annotated.txt"}
MRPC = {"train": "msr_paraphrase_train.txt", "test": "msr_paraphrase_test.txt"}
TREC = {"train": "train_5500.label", "test": "TREC_10.label"}
CAPTIONS = {"train": "train.parquet", "dev": "valid.parquet", "test": "test.parquet"}
PROBING = {
    "Length": "sentence_length.txt", "WordContent": "word_content.txt", "Depth": "tree_depth.txt", "TopConstituents": "top_constituents.txt", "BigramShift": "bigram_shift.txt",
    "Tense": "past_present.txt", "SubjNumber": "subj_number.txt", "ObjNumber": "obj_number.txt", "OddManOut": "odd_man_out.txt", "CoordinationInversion": "coordination_inversion.txt",
}


def _splits(files: dict[str, str], read) -> DataFrame:
    return reduce(DataFrame.unionByName, [read(name).select(F.lit(split).alias("split"), "*") for split, name in files.items()])


def load(spark: SparkSession, task: str, folder: str) -> DataFrame:
    """The rows of a task: ``split`` and (sent1, sent2, gold), (text, label) or, of captions, the columns of their tables.

    The yearly similarity tasks have a ``dataset`` each and one split, the opinion tasks one split; captions are Parquet
    tables in place of the published pickles.  Labels of classes are whole numbers from 0; a class that no row of a
    split of the sentiment tasks reaches is an error.
    """
    if task not in KINDS:
        raise ValueError(f"no task {task}")
    at = lambda name: f"{folder.rstrip('/')}/{name}"
    if task in STS_YEARS:
        years = [
            readers.sts_pairs(spark, at(f"STS.input.{name}.txt"), at(f"STS.gs.{name}.txt")).select(F.lit("test").alias("split"), F.lit(name).alias("dataset"), "sent1", "sent2", "gold")
            for name in STS_YEARS[task]
        ]
        return reduce(DataFrame.unionByName, years)
    if task in OPINIONS:
        return readers.two_classes(spark, *map(at, OPINIONS[task])).select(F.lit("all").alias("split"), "text", "label")
    if task in ("SST2", "SST5"):
        read = readers.labelled_last if task == "SST2" else readers.labelled_first
        return _splits(SENTIMENT, lambda name: readers.checked_labels(read(spark, at(name)), int(task[-1])))
    if task == "STSBenchmark":
        return _splits(BENCHMARK, lambda name: _pairs(readers.tab_columns(spark, at(name), {"sent1": 5, "sent2": 6, "gold": 4}), "double"))
    if task == "SICKRelatedness":
        return _splits(SICK, lambda name: _pairs(readers.tab_columns(spark, at(name), {"sent1": 1, "sent2": 2, "gold": 3}, header=True), "double"))
    if task == "SICKEntailment":
        names = F.create_map(*[F.lit(x) for kv in readers.ENTAILMENT.items() for x in kv])
        rows = lambda name: readers.tab_columns(spark, at(name), {"sent1": 1, "sent2": 2, "gold": 4}, header=True).withColumn("gold", names[F.col("gold")])
        return _splits(SICK, lambda name: _pairs(rows(name), "int"))
    if task == "MRPC":
        return _splits(MRPC, lambda name: _pairs(readers.tab_columns(spark, at(name), {"sent1": 3, "sent2": 4, "gold": 0}, header=True), "int"))
    if task == "SNLI":
        parts = {split: split for split in ("train", "dev", "test")}
        return _splits(parts, lambda split: readers.aligned(spark, at(f"s1.{split}"), at(f"s2.{split}"), at(f"labels.{split}")).select("sent1", "sent2", F.col("label").alias("gold")))
    if task == "TREC":
        return _splits(TREC, lambda name: readers.questions(spark, at(name)))
    if task == "ImageCaptionRetrieval":
        return _splits(CAPTIONS, lambda name: spark.read.parquet(at(name)))
    return readers.probing(spark, at(PROBING[task])).select("split", "text", F.col("label_id").alias("label"))


def _pairs(rows: DataFrame, kind: str) -> DataFrame:
    return rows.select("sent1", "sent2", F.col("gold").cast(kind).alias("gold"))
