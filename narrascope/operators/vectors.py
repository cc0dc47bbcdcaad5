"""Similarity joins over vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrascope.functions.similarity import cosine
from narrascope.operators.blocks import BLOCK, Above, Best, BestOfLabel, BestPairs, LabelSums, Measure, RankMetrics, Relevant, grid
from narrascope.session import Scratch


def lookup_embeddings(rows: DataFrame, table: DataFrame, keys: dict[str, str], key: str = "text", vector: str = "embedding", order: str | None = None) -> DataFrame:
    """``rows`` with a vector for each key column: ``keys`` maps a key column to the name of its vector.

    Left joins on a lookup that has one vector for each key: of a key that repeats the last by the column ``order``, or without one the
    largest.  The lookup may be of any size; Spark broadcasts it only if it is small.
    """
    last = F.max(vector) if order is None else F.max_by(vector, F.struct(F.col(order), F.col(vector)))
    one = table.groupBy(F.col(key).alias("__key")).agg(last.alias("__vector"))
    for name, out in keys.items():
        rows = rows.join(one, F.col(name) == F.col("__key"), "left").withColumnRenamed("__vector", out).drop("__key")
    return rows


def pair_scores(queries: DataFrame, candidates: DataFrame, id_col: str = "vec_id", vector: str = "embedding", top: int | None = None, least: float | None = None, exclude_self: bool = True, measure: Measure = "cosine", block: int = BLOCK, label: str | None = None) -> DataFrame:
    """``(q, c, sim)`` of queries against candidates by block products, with the labels ``ql`` and ``cl`` if ``label`` names whole numbers.

    A cell of the grid hands on what is at least ``least``, and of that the ``top`` best for each query, so what leaves it is
    bounded by the result and not by all pairs.  Zero vectors have no cosine and are in no pair.  ``measure`` is ``cosine``,
    ``inner`` or a function of two arrays of vectors.
    """
    out = grid(queries, candidates, lambda: Best(top, least, measure, exclude_self), id_col, vector, label, block)
    out = out if label is not None else out.select("q", "c", "sim")
    if top is None:
        return out
    best = Window.partitionBy("q").orderBy(F.desc("sim"), "c")
    return out.withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= top).drop("__r")


def label_distances(rows: DataFrame, label: str, id_col: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """``(q, ql, cl, total, n)``: the sum of cosine distances of each vector to the others of each label, and their number.

    Cells hand on one row for each vector and label, never the pairs.
    """
    parts = grid(rows, rows, LabelSums, id_col, vector, label, block)
    return parts.groupBy("q", "ql", "cl").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def relevant_ranks(queries: DataFrame, candidates: DataFrame, label: str | Column = "label", first: bool = False, exclude_self: bool = True, id_col: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """``(q, ranks)``: the ascending ranks, among all candidates by cosine, of those with the query's label; with ``first``
    of the best of them only.  Queries without such a candidate have no ranks (null).

    Similarities of relevant candidates go to the blocks as thresholds, and a cell counts how many others are above each, so
    what leaves it are relevant pairs.  Ties go to the smaller id.  Of many relevant candidates, where only measures of the ranks are
    wanted, ``rank_metrics`` hands on these.
    """
    spark = queries.sparkSession
    work = Scratch(spark, "ranks")
    if first:
        best = best_of_label(queries, candidates, label, exclude_self, False, id_col, vector, block)
        found = work.save(best.select("q", F.array("c").alias("cs"), F.array("sim").alias("sims")), "relevant")
    else:
        known = grid(queries, candidates, lambda: Relevant(exclude_self), id_col, vector, label, block)
        # of one query's relevant candidates only
        z = known.groupBy("q").agg(F.flatten(F.collect_list(F.arrays_zip("cs", "sims"))).alias("z"))
        found = work.save(z.select("q", F.col("z.cs").alias("cs"), F.col("z.sims").alias("sims")), "relevant")
    asked = queries.select(F.col(id_col).cast("long").alias("__id"), F.col(vector).alias("__v")).join(found, F.col("__id") == F.col("q"))
    ask = asked.select(F.col("__id").alias(id_col), F.col("__v").alias(vector), F.lit(0).alias("__label"), "cs", "sims")
    above = grid(ask, candidates.select(F.col(id_col), F.col(vector), F.lit(0).alias("__label")), lambda: Above(exclude_self), id_col, vector, "__label", block, ["cs", "sims"], found.count())
    # as many arrays as there are groups of candidate blocks, each of the query's relevant candidates
    total = above.groupBy("q").agg(F.collect_list("above").alias("a"))
    zero = F.transform(F.get("a", F.lit(0)), lambda _: F.lit(0).cast("long"))
    summed = F.aggregate("a", zero, lambda s, x: F.zip_with(s, x, lambda u, v: u + v))
    ranks = total.select("q", F.array_sort(F.transform(summed, lambda x: x + 1)).alias("ranks"))
    return queries.select(F.col(id_col).cast("long").alias("q")).join(ranks, "q", "left")


def best_of_label(queries: DataFrame, candidates: DataFrame, label: str | Column = "label", exclude_self: bool = True, earlier: bool = False, id_col: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """``(q, c, sim)``: each query's best candidate of its own label, with ``earlier`` of those with a smaller id; ties to the smaller id.

    Rows of a label share blocks, and blocks without a label in common are not multiplied.
    """
    parts = grid(queries, candidates, lambda: BestOfLabel(exclude_self, earlier), id_col, vector, label, block, by_label=True)
    best = parts.groupBy("q").agg(F.min(F.struct((-F.col("sim")).alias("s"), "c", "sim")).alias("b"))
    return best.select("q", "b.c", "b.sim")


def rank_metrics(queries: DataFrame, candidates: DataFrame, ks: tuple[int, ...] = (1, 5, 10), label: str | Column = "label", exclude_self: bool = True, id_col: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """The metrics of ``retrieval.per_query_ranks`` for each query with a candidate of its label, by cosine, ties to the smaller id.

    A cell sees all candidates of its queries and hands on one row for each of them, never the pairs or their ranks.
    """
    rows = grid(queries, candidates, lambda: RankMetrics(ks, exclude_self), id_col, vector, label, block, whole=True)
    return rows.select(
        "q", "ap", "ndcg", (F.col("within") / F.col("r")).alias("r_precision"), F.col("first_hit").cast("int").alias("first_hit"), "r",
        *[(F.get("hits", F.lit(n)) / F.lit(float(k))).alias(f"p_at_{k}") for n, k in enumerate(ks)],
    )


def best_pairs(rows: DataFrame, top: int, id_col: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """``(q, c, sim)``: the ``top`` pairs q < c of the largest cosine, ties to the smaller ids; a cell hands on as many at most."""
    parts = grid(rows, rows, lambda: BestPairs(top), id_col, vector, None, block)
    return parts.orderBy(F.desc("sim"), "q", "c").limit(top)


def search(queries: DataFrame, index: DataFrame, top: int = 5, threshold: float = 0.6, **names) -> DataFrame:
    """``(q, c, sim, rank)``: the best ``top`` index entries of at least the threshold for each query."""
    found = pair_scores(queries, index, top=top, least=threshold, **names)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "c")))


def add_to_index(index: DataFrame, more: DataFrame) -> DataFrame:
    """Both, without entries of the second whose id the first has."""
    return index.unionByName(more.join(index.select("vec_id"), "vec_id", "left_anti"))


def triplet_similarities(rows: DataFrame, anchor: Column, a: Column, b: Column) -> DataFrame:
    """With ``sim_a``, ``sim_b`` and ``predicted``: A only if it is strictly nearer; a similarity that isn't defined speaks for B."""
    out = rows.withColumns({"sim_a": cosine(anchor, a), "sim_b": cosine(anchor, b)})
    return out.withColumn("predicted", F.coalesce(F.col("sim_a") > F.col("sim_b"), F.lit(False)))


def triplet_accuracy(rows: DataFrame, gold: str = "gold") -> DataFrame:
    """Accuracy, mean margin of the right over the wrong text, both mean similarities, and the number of labelled rows."""
    right = F.when(F.col(gold), F.col("sim_a")).otherwise(F.col("sim_b"))
    wrong = F.when(F.col(gold), F.col("sim_b")).otherwise(F.col("sim_a"))
    return rows.where(F.col(gold).isNotNull()).agg(
        F.avg((F.col("predicted") == F.col(gold)).cast("double")).alias("accuracy"), F.avg(right - wrong).alias("margin"),
        F.avg(right).alias("pos_sim"), F.avg(wrong).alias("neg_sim"), F.count("*").alias("n"),
    )
