"""Stories: nested records with maps by language, their filters, pairs, names and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrascope.operators.corpus import bucket
from narrascope.operators.ordering import numbered, running_sum

#: Languages from the best to the poorest translation.
LANGUAGE_ORDER = ("en", "fr", "de", "it", "es")
STORY = (
    "wikidata_id string, title string, titles map<string,string>, summaries_original map<string,string>, summaries_translated map<string,string>, "
    "sentences map<string,array<string>>, num_sentences map<string,int>, genres array<string>, years array<int>"
)


def constructed(rows: DataFrame) -> DataFrame:
    """Story records: null maps are empty ones, sentence counts come from the sentences."""
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    counts = F.transform_values(F.coalesce("sentences", F.from_json(F.lit("{}"), "map<string,array<string>>")), lambda _, s: F.size(s))
    maps = {c: F.coalesce(F.col(c), empty) for c in ("titles", "summaries_original", "summaries_translated") if c in rows.columns}
    return rows.withColumns(maps | ({"num_sentences": counts} if "sentences" in rows.columns else {}))


def long_summaries(summaries: Column, counts: Column, least: int) -> Column:
    """Entries of the map with at least so many sentences."""
    return F.map_filter(summaries, lambda k, _: F.coalesce(F.element_at(counts, k), F.lit(0)) >= least)


def from_year(years: Column, year: int, exclude: bool = False) -> Column:
    """Whether the first year is (or is not) a year; a story without years is in neither."""
    first = F.array_min(years)
    return F.coalesce(first != year if exclude else first == year, F.lit(False))


def one_shared_genre(a: Column, b: Column, banned: tuple[str, ...] = ()) -> Column:
    """Exactly one genre in common, and none of the banned ones."""
    shared = F.array_intersect(a, b)
    return (F.size(shared) == 1) & ~F.arrays_overlap(shared, F.array(*[F.lit(g) for g in banned]).cast("array<string>"))


def has_links(sitelinks: Column, *wanted: str) -> Column:
    return F.size(F.array_intersect(sitelinks, F.array(*[F.lit(w) for w in wanted]))) == len(wanted)


def summary_rows(stories: DataFrame, summaries: str = "summaries_translated", key: str = "wikidata_id", least: int = 2) -> DataFrame:
    """``(label, key, lang, summary)`` of stories with at least so many summaries; labels number the stories by key."""
    kept = stories.where(F.size(summaries) >= least).select(key, summaries)
    labels = numbered(kept.select(key).distinct(), [key], "place").select(key, (F.col("place") - 1).alias("label"))
    return kept.join(labels, key).select("label", key, F.explode(summaries).alias("lang", "summary"))


def sentence_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(tag, sentence)`` of every sentence, tagged by the id and its paragraph."""
    paragraphs = df.select(key, F.posexplode(F.split(text, "\n")).alias("p", "paragraph"))
    parts = paragraphs.select(key, "p", F.posexplode(F.filter(F.split("paragraph", r"(?<=[.!?])\s+"), lambda x: x != "")).alias("s", "sentence"))
    return parts.select(F.concat(F.col(key).cast("string"), F.lit("_"), F.col("p").cast("string")).alias("tag"), "s", "sentence")


def rebuilt_text(lines: DataFrame, out: str = "text") -> DataFrame:
    """Texts from tagged sentences: sentences of a paragraph by a space, paragraphs by a line break."""
    key, p = F.substring_index("tag", "_", 1).alias("key"), F.substring_index("tag", "_", -1).cast("int").alias("p")
    joined = lambda by, order, value, sep: (F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), sep))
    paragraphs = lines.select(key, p, "s", "sentence").groupBy("key", "p").agg(joined(None, "s", "sentence", " ").alias("paragraph"))
    return paragraphs.groupBy("key").agg(joined(None, "p", "paragraph", "\n").alias(out))


def translation_order(lang: Column) -> Column:
    """Place of a language by quality; unknown ones come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in LANGUAGE_ORDER]), lang), F.lit(0).cast("long")), F.lit(len(LANGUAGE_ORDER) + 1).cast("long"))


def metadata_counts(df: DataFrame, book: Column, movie: Column, **flags: Column) -> DataFrame:
    """Books, movies, both and neither; titles that are both count in each.  Further flags are counted under their names."""
    more = [F.count_if(c).alias(name) for name, c in flags.items()]
    return df.agg(F.count_if(book).alias("books"), F.count_if(movie).alias("movies"), F.count_if(book & movie).alias("both"), F.count_if(~book & ~movie).alias("neither"), F.count("*").alias("n"), *more)


def genre_counts(df: DataFrame, genres: str) -> DataFrame:
    """How often each genre stands; stories without one are counted under null."""
    return df.select(F.explode_outer(genres).alias("genre")).groupBy("genre").agg(F.count("*").alias("n"))


def gender_of_span(tokens: DataFrame, names: DataFrame, by: list[str], token: str, pos: str) -> DataFrame:
    """The most frequent sex of a span's known names, the first of equals; names match without regard to case."""
    known = names.select(F.lower(F.trim("name")).alias("__name"), "sex")
    hits = tokens.join(known, F.lower(F.trim(F.col(token))) == F.col("__name"))
    counts = hits.groupBy(*by, "sex").agg(F.count("*").alias("c"), F.min(pos).alias("first"))
    return counts.groupBy(*by).agg(F.max_by("sex", F.struct("c", -F.col("first"))).alias("sex"))


def name_table(rows: DataFrame, order: str) -> DataFrame:
    """``(name, sex, percent)`` of stretches of equal names: the modal sex, the first of equals, and the summed share.

    A row is compared with the one before it by a join on its place, and stretches are numbered by a running sum, so no
    task sees all rows.
    """
    placed = numbered(rows.select(order, "name", "sex", "percent"), [order], "__n")
    before = placed.select((F.col("__n") + 1).alias("__n"), F.col("name").alias("__previous"), F.lit(True).alias("__has"))
    new = F.when(F.col("__has") & F.col("name").eqNullSafe(F.col("__previous")), 0).otherwise(1)
    r = running_sum(placed.join(before, "__n", "left"), ["__n"], new, "run")
    totals = r.groupBy("run").agg(F.first("name").alias("name"), F.sum("percent").alias("percent"))
    sexes = r.groupBy("run", "sex").agg(F.count("*").alias("c"), F.min(order).alias("first")).groupBy("run").agg(F.max_by("sex", F.struct("c", -F.col("first"))).alias("sex"))
    return totals.join(sexes, "run").select("name", "sex", "percent")


#: English possessives, and the pronouns that a recent mention keeps.
POSSESSIVES = ("my", "our", "your", "his", "her", "its", "their", "whose")
PRONOUNS = ("I", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them", *POSSESSIVES)


def mention_replacements(mentions: DataFrame, by: list[str], token: str = "token", text: str = "text", name: str = "name", near: int = 8) -> DataFrame:
    """``replacement`` of every mention of a coreference cluster (``by``) by the cluster's name.

    A pronoun that begins at most ``near`` tokens after the mention before it stays as it is; a possessive, or a text
    that ends in 's, becomes the name's possessive; all others become the name, which may be null.
    """
    order = Window.partitionBy(*by).orderBy(token)
    plain, low = F.col(text), F.lower(F.col(text))
    recent = F.coalesce(F.lag(token).over(order) + near >= F.col(token), F.lit(False)) & F.trim(low).isin(*PRONOUNS)
    owns = (plain.endswith("'s") | low.isin(*POSSESSIVES)) & F.col(name).isNotNull()
    return mentions.withColumn("replacement", F.when(recent, plain).when(owns, F.concat(F.col(name), F.lit("'s"))).otherwise(F.col(name)))


def recent_mentions(mentions: DataFrame, by: list[str], token: str, near: int = 8) -> DataFrame:
    """``recent``: whether the mention begins at most ``near`` tokens after the one before it in its cluster."""
    order = Window.partitionBy(*by).orderBy(token)
    return mentions.withColumn("recent", F.coalesce(F.lag(token).over(order) + near >= F.col(token), F.lit(False)))


def longest_mention(mentions: DataFrame, by: list[str], text: str) -> DataFrame:
    """The longest text of each group, the smallest of equals."""
    return mentions.groupBy(*by).agg(F.min_by(F.col(text), F.struct(-F.length(text), F.col(text))).alias(text))


def labelled_pairs(positives: DataFrame, negatives: DataFrame, scale: float, seed: int = 42) -> DataFrame:
    """``(a_id, b_id, label)``: all positive pairs, and of the negatives about ``scale`` times as many, by their hash."""
    n = negatives.agg(F.count("*").alias("neg")).crossJoin(positives.agg(F.count("*").alias("pos")))
    draw = bucket(F.concat_ws("|", F.col("a_id").cast("string"), F.col("b_id").cast("string")), 1_000_000, seed) / 1e6
    kept = negatives.crossJoin(F.broadcast(n)).where(draw < scale * F.col("pos") / F.greatest("neg", F.lit(1)))
    return positives.select("a_id", "b_id", F.lit(1).alias("label")).unionByName(kept.select("a_id", "b_id", F.lit(-1).alias("label")))


def quota_sample(clusters: DataFrame, sizes: dict[int, int], in_test: float = 0.8, seed: int = 42) -> DataFrame:
    """Clusters ``(cluster, size, in_test)`` drawn by hash: for each size a number of clusters, a share of them from the test part."""
    want = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])
    rows = clusters.withColumn("__want", F.element_at(want, F.col("size").cast("int"))).where("__want is not null")
    quota = F.when(F.col("in_test"), F.round(F.col("__want") * in_test)).otherwise(F.col("__want") - F.round(F.col("__want") * in_test))
    order = Window.partitionBy("size", "in_test").orderBy(bucket(F.col("cluster"), 1 << 30, seed), "cluster")
    return rows.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= quota).select("cluster", "size", "in_test")


def with_replacement(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows drawn with replacement: draw k takes the row at the k-th hashed place in the order of the key's hash."""
    total = df.count()
    if not total:
        return df.limit(0).withColumn("draw", F.lit(0).cast("long"))
    placed = numbered(df.withColumn("__hash", bucket(F.col(key), 1 << 30, seed)), ["__hash", key], "__r")
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), (bucket(F.col("id"), total, seed + 1) + 1).alias("__r"))
    return placed.join(draws, "__r").drop("__r", "__hash")


def contrastive_candidates(rows: DataFrame, key: str, batch: int, n: int = 30, seed: int = 42) -> DataFrame:
    """``(key, other)``: n rows from other batches for each row, at hashed distances in the order of keys 0..N-1."""
    total = F.lit(rows.count())
    b = F.floor(F.col(key) / batch)
    steps = rows.select(F.col(key), b.alias("__b"), F.explode(F.sequence(F.lit(1), F.lit(2 * n))).alias("k"))
    other = (F.col(key) + F.lit(batch) + bucket(F.concat_ws("|", F.col(key).cast("string"), F.col("k").cast("string")), 1 << 30, seed)) % total
    drawn = steps.withColumn("other", other).where(F.floor(F.col("other") / batch) != F.col("__b")).groupBy(key, "other").agg(F.min("k").alias("k"))
    first = Window.partitionBy(key).orderBy("k")
    return drawn.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= n).select(key, "other")


def masked_tokens(tokens: Column, key: Column, share: int = 15, vocabulary: int = 30000, seed: int = 42) -> Column:
    """Tokens with ``share`` percent of them masked by hash: of those 80 % the mask, 10 % another token, 10 % as they are; the labels hold the masked ones."""
    spot = lambda i, k: bucket(F.concat_ws("|", key.cast("string"), i.cast("string"), F.lit(k)), 100, seed)
    other = lambda i: F.concat(F.lit("tok"), bucket(F.concat_ws("|", key.cast("string"), i.cast("string")), vocabulary, seed).cast("string"))
    return F.transform(
        tokens,
        lambda t, i: F.struct(
            F.when(spot(i, "a") >= share, t).when(spot(i, "b") < 80, "<mask>").when(spot(i, "b") < 90, other(i)).otherwise(t).alias("token"),
            F.when(spot(i, "a") < share, t).alias("label"),
        ),
    )


def random_baseline(key: Column, seed: int = 42) -> Column:
    """A truth value by the hash of a key."""
    return bucket(key, 2, seed) == 1


def random_vector(key: Column, dim: int, seed: int = 42) -> Column:
    """Hashed numbers in 0..1."""
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: bucket(F.concat_ws("|", key.cast("string"), i.cast("string")), 1 << 30, seed) / float(1 << 30))
