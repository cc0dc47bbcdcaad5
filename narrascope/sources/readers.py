"""Readers with explicit schemas for the file formats of the domain.

All go through Spark's readers, so paths may be in any store that Spark reads.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrascope.functions.text import strip

TRIPLET = "anchor_text string, text_a string, text_b string, text_a_is_closer boolean"
TEXT = "text string"
TRAINING = "sent0 string, sent1 string, hard_neg string"
AUGMENTED = "model_name string, anchor_prototype string, text_a_prototype string, text_b_prototype string, anchor_text string, text_a string, text_b string"
CHOICES = "source string, choices array<string>, answer int, types array<string>"
CLOZE = "InputStoryid string, InputSentence1 string, InputSentence2 string, InputSentence3 string, InputSentence4 string, RandomFifthSentenceQuiz1 string, RandomFifthSentenceQuiz2 string, AnswerRightEnding int"
NAMES = "name string, sex string, percent double"
#: The six coarse question classes.
TREC_CLASSES = {"ABBR": 0, "DESC": 1, "ENTY": 2, "HUM": 3, "LOC": 4, "NUM": 5}
ENTAILMENT = {"NEUTRAL": 1, "ENTAILMENT": 2, "CONTRADICTION": 0}


def jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines; blank lines are skipped, a malformed one is an error (strict) or dropped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def bad_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The malformed lines of a file."""
    wide = T.StructType.fromDDL(schema).add("_corrupt_record", "string")
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select("value", F.from_json("value", wide, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).where("r._corrupt_record is not null").select("value")


def jsonl_values(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object in text for each line; a line that isn't an object is wrapped as ``{"_value": ...}``."""
    line = strip(F.col("value"))
    rows = spark.read.text(path).select(line.alias("value")).where("value <> ''")
    return rows.select(F.when(F.col("value").startswith("{"), F.col("value")).otherwise(F.concat(F.lit('{"_value": '), F.col("value"), F.lit("}"))).alias("value"))


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document that holds an array of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def csv(spark: SparkSession, path: str, schema: str | None = None, tab: bool = False, encoding: str = "UTF-8", quoted_empty: bool = False) -> DataFrame:
    """CSV with a header; quotes are doubled inside quoted cells, which may span lines.

    Empty cells are null; with ``quoted_empty`` only those without quotes are, as ``sinks.csv`` writes them.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding).option("sep", "\t" if tab else ",")
    # without this U+0000 is the escape of doubled quotes, and cells lose it
    reader = reader.option("charToEscapeQuoteEscaping", '"')
    if quoted_empty:
        # Spark takes any cell that equals the null value for null, so it is a text that no cell holds
        reader = reader.option("nullValue", uuid.uuid4().hex)
    return (reader.schema(schema) if schema else reader).csv(path)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """CSV with every cell stripped and rows without any text left out; an empty file is an error."""
    rows = csv(spark, path)
    if not rows.columns:
        raise ValueError("the file has no header")
    cells = [strip(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c) for c in rows.columns]
    return rows.select(*cells).where(F.exists(F.array(*[F.col(f"`{c}`") for c in rows.columns]), lambda x: x != ""))


def by_extension(spark: SparkSession, path: str) -> DataFrame:
    """Training rows from a CSV, or from a tab-separated file if the name says so; other kinds are an error."""
    if not path.lower().rstrip("/").endswith((".csv", ".tsv")):
        raise ValueError(f"no reader for {path}")
    return csv(spark, path, tab="tsv" in path.lower())


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``(path, number, value)``: the lines of each file, right-stripped, numbered from 0 in the file's order.

    A file's number of lines isn't bounded, so lines are numbered by their position in the scan: the places within a
    part of the file, plus all lines of its earlier parts.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", r"\s+$", "").alias("value"))
    part = F.shiftright("at", 33)
    sizes = rows.groupBy("path", part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("low"))
    before = sizes.alias("x").join(sizes.alias("y"), (F.col("x.path") == F.col("y.path")) & (F.col("y.part") < F.col("x.part")), "left")
    before = before.groupBy(F.col("x.path").alias("path"), F.col("x.part").alias("part"), F.col("x.low").alias("low")).agg(F.coalesce(F.sum("y.n"), F.lit(0)).alias("before"))
    numbered = rows.withColumn("part", part).join(before, ["path", "part"])
    return numbered.select("path", (F.col("at") - F.col("low") + F.col("before")).alias("number"), "value")


def zipped(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(number, a, b)``: the lines of two files side by side."""
    return left.select("number", F.col("value").alias("a")).join(right.select("number", F.col("value").alias("b")), "number")


def sts_pairs(spark: SparkSession, inputs: str, gold: str) -> DataFrame:
    """``(sent1, sent2, gold)`` of a tab-separated file and its scores, without pairs that have none."""
    rows = zipped(lines(spark, inputs), lines(spark, gold)).where(F.trim("b") != "")
    cells = F.split("a", "\t")
    return rows.select("number", F.get(cells, F.lit(0)).alias("sent1"), F.get(cells, F.lit(1)).alias("sent2"), F.col("b").cast("double").alias("gold"))


def tab_columns(spark: SparkSession, path: str, picks: dict[str, int], header: bool = False) -> DataFrame:
    """Named columns of a tab-separated file without quoting, by their places."""
    rows = lines(spark, path)
    cells = F.split("value", "\t")
    return (rows.where("number > 0") if header else rows).select("number", *[F.get(cells, F.lit(k)).alias(n) for n, k in picks.items()])


def latin_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value``: the lines of a file in Latin-1."""
    # Spark's text reader knows UTF-8 only; a separator that no line holds makes the CSV reader one for lines
    return spark.read.schema("value string").option("sep", "\u0001").option("quote", "").option("encoding", "ISO-8859-1").csv(path)


def two_classes(spark: SparkSession, positive: str, negative: str) -> DataFrame:
    """``(text, label)`` of one file of positive and one of negative lines."""
    a, b = (latin_lines(spark, p) for p in (positive, negative))
    return a.select(F.col("value").alias("text"), F.lit(1).alias("label")).unionByName(b.select(F.col("value").alias("text"), F.lit(0).alias("label")))


def labelled_last(spark: SparkSession, path: str) -> DataFrame:
    """``(text, label)`` of lines that end in a tab and a number."""
    cell = F.split("value", "\t")
    return lines(spark, path).where("value <> ''").select(F.get(cell, F.lit(0)).alias("text"), F.element_at(cell, -1).cast("int").alias("label"))


def checked_labels(rows: DataFrame, classes: int, label: str = "label") -> DataFrame:
    """The rows, if the largest label is that of the last class; else an error."""
    top = rows.agg(F.max(label)).first()[0]
    if top != classes - 1:
        raise ValueError(f"labels reach {top}, not {classes - 1}")
    return rows


def labelled_first(spark: SparkSession, path: str) -> DataFrame:
    """``(text, label)`` of lines that begin with a number."""
    return lines(spark, path).where("value <> ''").select(F.regexp_extract("value", r"^\d+\s+(.*)$", 1).alias("text"), F.regexp_extract("value", r"^(\d+)", 1).cast("int").alias("label"))


def questions(spark: SparkSession, path: str) -> DataFrame:
    """``(text, label)`` of ``CLASS:sub question`` lines."""
    classes = F.create_map(*[F.lit(x) for kv in TREC_CLASSES.items() for x in kv])
    rows = latin_lines(spark, path).where("value <> ''")
    return rows.select(F.regexp_extract("value", r"^\S+\s+(.*)$", 1).alias("text"), F.element_at(classes, F.regexp_extract("value", r"^([A-Z]+):", 1)).alias("label"))


def aligned(spark: SparkSession, first: str, second: str, labels: str) -> DataFrame:
    """``(number, sent1, sent2, label)`` of three parallel files."""
    rows = zipped(lines(spark, first), lines(spark, second)).join(lines(spark, labels).select("number", F.col("value").alias("label")), "number")
    return rows.select("number", F.col("a").alias("sent1"), F.col("b").alias("sent2"), "label")


def probing(spark: SparkSession, path: str) -> DataFrame:
    """``(split, label, text, label_id)``: ids by the sorted labels of the training rows."""
    cells = F.split("value", "\t")
    split = F.element_at(F.create_map(F.lit("tr"), F.lit("train"), F.lit("va"), F.lit("dev"), F.lit("te"), F.lit("test")), F.get(cells, F.lit(0)))
    rows = lines(spark, path).where("value <> ''").select(split.alias("split"), F.get(cells, F.lit(1)).alias("label"), F.element_at(cells, -1).alias("text"))
    names = rows.where("split = 'train'").agg(F.array_sort(F.collect_set("label")).alias("labels"))  # a label set is small by nature
    ids = names.select(F.posexplode("labels").alias("label_id", "label"))
    return rows.join(F.broadcast(ids), "label", "left")


def clusters_tsv(spark: SparkSession, path: str) -> DataFrame:
    """``(cluster_id, movie_id, title, text)`` of ragged lines: an id and groups of three; the last line of an id counts."""
    rows = lines(spark, path).where("value <> ''").withColumn("cells", F.split("value", "\t"))
    last = rows.groupBy(F.get("cells", F.lit(0)).cast("int").alias("cluster_id")).agg(F.max_by("cells", "number").alias("cells"))
    at = F.sequence(F.lit(1), F.size("cells") - 3, F.lit(3))
    members = F.when(F.size("cells") >= 4, F.transform(at, lambda i: F.struct(F.get("cells", i).alias("movie_id"), F.get("cells", i + 1).alias("title"), F.get("cells", i + 2).alias("text"))))
    return last.select("cluster_id", F.inline(members))


def entities(spark: SparkSession, pattern: str, schema: str, only: DataFrame | None = None) -> DataFrame:
    """One JSON document for each file of a glob with ``id``, the file's stem; ``only`` (id) restricts them."""
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)\.[^./]*$", 1)
    rows = spark.read.schema(schema).option("multiLine", True).option("ignoreMissingFiles", True).json(pattern).select("*", stem.alias("id"))
    return rows if only is None else rows.join(only.select("id"), "id", "left_semi")


def word_vectors(spark: SparkSession, path: str, vocabulary: DataFrame | None = None, first: int | None = None, specials: tuple[str, ...] = ()) -> DataFrame:
    """``(word, vec)`` of lines of a word and its numbers.

    ``vocabulary`` (word) restricts them, and ``first`` to the file's first lines and the ``specials`` wherever they stand.
    """
    cells = F.split("value", " ")
    rows = spark.read.text(path) if first is None else lines(spark, path).where((F.col("number") < first) | F.get(cells, F.lit(0)).isin(*specials))
    rows = rows.select(F.get(cells, F.lit(0)).alias("word"), F.slice(cells, F.lit(2), F.size(cells)).cast("array<double>").alias("vec"))
    return rows if vocabulary is None else rows.join(vocabulary.select("word"), "word", "left_semi")


def first_captions(rows: DataFrame, n: int = 5) -> DataFrame:
    """``(image_id, caption_no, caption)``: the first n captions of images that have as many."""
    return rows.where(F.size("captions") >= n).select("image_id", F.posexplode(F.slice("captions", 1, n)).alias("caption_no", "caption"))


def named_ids(spark: SparkSession, path: str) -> DataFrame:
    """``(id, name)`` of a JSON object that names ids, in one or more files of one line or many."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "name"))


def split_files(spark: SparkSession, files: dict[str, str], schema: str) -> DataFrame:
    """The rows of CSV files with a header and declared columns, and the ``split`` of each file."""
    parts = [csv(spark, path, schema).select("*", F.lit(split).alias("split")) for split, path in files.items()]
    return reduce(DataFrame.unionByName, parts)


#: Names of splits in downloaded dataset folders, and what they are called here.
HUB_SPLITS = {"train": "train", "validation": "dev", "valid": "dev", "dev": "dev", "test": "test"}


def hub_folder(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The rows of a downloaded dataset folder and their ``split``: Parquet or CSV files named by their split (``train-00000-of-00002.parquet``,
    ``test.csv``) or in folders that are.  Files of other names have a null split."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    kinds = {r[0] for r in files.select(F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))).distinct().collect()}  # kinds of files
    if not kinds & {"parquet", "csv"}:
        raise ValueError(f"no Parquet or CSV files in {path}")
    reader = spark.read.option("recursiveFileLookup", True)
    reader = reader.schema(schema) if schema else reader
    if "parquet" in kinds:
        rows = reader.option("pathGlobFilter", "*.parquet").parquet(path)
    else:
        rows = reader.option("pathGlobFilter", "*.csv").option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    inside = F.substring(F.col("_metadata.file_path"), F.lit(1) + F.instr(F.col("_metadata.file_path"), path.rstrip("/").split("/")[-1] + "/"), F.lit(1 << 20))
    found = F.regexp_extract(inside, r"/(" + "|".join(HUB_SPLITS) + r")(?:[-_.][^/]*)?(?:/[^/]*)*$", 1)
    return rows.select("*", F.create_map(*[F.lit(x) for kv in HUB_SPLITS.items() for x in kv])[found].alias("split"))
