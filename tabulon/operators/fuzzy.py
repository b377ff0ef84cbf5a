"""Fuzzy merging of string columns, blocked by n-grams.

Only distinct strings that share an n-gram are compared, by an equi-join on the
n-gram.  By TF-IDF others have similarity 0; of each string's n-grams, the rarest
first, only those are joined without which the rest cannot reach the threshold (a
prefix filter on the norm of the rest), so common n-grams pair no strings.  By edit
distance the length of the
n-gram follows from the threshold: at most d edits leave one of d + 1 pieces of
the longer string whole, so every pair at or over the threshold shares an n-gram
of the least length of such a piece.  Strings made of one common pattern share
their n-grams with all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ngrams(s: Column, n: int = 3) -> Column:
    """Distinct character n-grams of the lower-cased string."""
    t = F.lower(s)
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(t) - (n - 1), F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(t, i, F.lit(n))))


def _grams(df: DataFrame, col: str, n: int) -> DataFrame:
    own = df.select(F.col(col).alias("s")).dropna().distinct()
    return own.select("s", F.explode(ngrams(F.col("s"), n)).alias("g"))


def _vectors(left: DataFrame, right: DataFrame, col: str, n: int) -> DataFrame:
    """(s, g, u, before, in_a, in_b): unit TF-IDF vectors of the strings of both sides,
    idf = ln((1 + N) / (1 + df)) + 1, and the squared weights of a string's rarer
    n-grams."""
    a, b = (_grams(df, col, n).withColumn(side, F.lit(True)) for df, side in ((left, "in_a"), (right, "in_b")))
    both = a.unionByName(b, allowMissingColumns=True).groupBy("s", "g").agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    size = both.agg(F.count_distinct("s").alias("N"))
    idf = both.groupBy("g").agg(F.count("*").alias("df")).join(F.broadcast(size)).select("g", "df", (F.ln((1 + F.col("N")) / (1 + F.col("df"))) + 1).alias("w"))
    own = Window.partitionBy("s")  # the n-grams of a string
    unit = F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(own))
    weighted = both.join(idf, "g").withColumn("u", unit)
    rarer = own.orderBy("df", "g").rowsBetween(Window.unboundedPreceding, -1)
    return weighted.withColumn("before", F.coalesce(F.sum(F.col("u") * F.col("u")).over(rarer), F.lit(0.0)))


def _candidates(vectors: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs whose similarity may reach the threshold.

    Let g be the rarest n-gram that two strings share.  Their similarity is at most
    the norm of what follows g in either string, g counted; so g lies in both
    prefixes, which end where that norm falls below the threshold.
    """
    prefix = vectors.filter((1 - F.col("before")) >= max(threshold - 1e-8, 0.0) ** 2 - 1e-12)
    a, b = (prefix.filter(side).select(F.col("s").alias(side[-1]), "g") for side in ("in_a", "in_b"))
    return a.join(b, "g").select("a", "b").distinct()


def tfidf_pairs(left: DataFrame, right: DataFrame, col: str, n: int = 3, threshold: float = 0.0) -> DataFrame:
    """(a, b, similarity) of all pairs that share an n-gram and whose cosine of TF-IDF
    weights is at or over the threshold (to 8 places), and of some below."""
    vectors = _vectors(left, right, col, n)
    whole = vectors.groupBy("s").agg(F.map_from_entries(F.collect_list(F.struct("g", "u"))).alias("v"))  # of one string
    pairs = _candidates(vectors, threshold)
    near = pairs.join(whole.select(F.col("s").alias("a"), F.col("v").alias("va")), "a").join(whole.select(F.col("s").alias("b"), F.col("v").alias("vb")), "b")
    shared = F.array_intersect(F.map_keys("va"), F.map_keys("vb"))
    dot = F.aggregate(shared, F.lit(0.0), lambda t, g: t + F.element_at("va", g) * F.element_at("vb", g))
    return near.select("a", "b", dot.alias("similarity"))


def _pieces(s: Column, threshold: float) -> Column:
    """Distinct substrings of ``s``, of each length that the longer string of a
    pair at or over a threshold of more than 0 may ask for."""
    n = F.char_length(s)

    def piece(longer: Column) -> Column:
        edits = F.floor(longer * (1 - threshold + 1e-9))
        return F.floor(longer / (edits + 1)).cast("int")

    if threshold > 0.5:
        sizes = F.array_distinct(F.transform(F.sequence(n, F.floor(n / threshold + 1e-6).cast("int")), piece))
    else:
        sizes = F.array(F.least(n, F.lit(1)))

    def cut(size: Column) -> Column:
        starts = F.when(size <= n, F.sequence(F.lit(1), n - size + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substr(s, i, size))

    return F.array_distinct(F.flatten(F.transform(sizes, cut)))


def edit_pairs(left: DataFrame, right: DataFrame, col: str, threshold: float = 0.8) -> DataFrame:
    """(a, b, similarity): 1 - edit distance / the longer length, of every pair at
    or over the threshold (to 9 places) and of some others."""
    a, b = (df.select(F.col(col).alias(name)).dropna().distinct() for df, name in ((left, "a"), (right, "b")))
    shorter, longer = (f(F.char_length("a"), F.char_length("b")) for f in (F.least, F.greatest))
    if threshold > 0:
        cut = lambda df, name: df.select(name, F.explode(_pieces(F.col(name), threshold)).alias("g"))
        near = cut(a, "a").join(cut(b, "b"), "g").filter(longer - shorter <= longer * (1 - threshold + 1e-9))
        pairs = near.select("a", "b").distinct()
    else:
        pairs = a.crossJoin(b)
    alike = F.when(F.col("a") == F.col("b"), 1.0).otherwise(1 - F.levenshtein("a", "b") / longer)
    return pairs.withColumn("similarity", alike)


def fuzzy_match(left: DataFrame, right: DataFrame, col: str, threshold: float = 0.8, method: str = "tfidf") -> DataFrame:
    """(a, matched, similarity): the best partner of each left string at or over
    the threshold; ties go to the lesser string."""
    pairs = tfidf_pairs(left, right, col, threshold=threshold) if method == "tfidf" else edit_pairs(left, right, col, threshold)
    best = pairs.withColumn("similarity", F.round("similarity", 9)).filter(F.col("similarity") >= threshold)
    found = best.groupBy("a").agg(F.min(F.struct((-F.col("similarity")).alias("k"), F.col("b"))).alias("m"))
    return found.select("a", F.col("m.b").alias("matched"), (-F.col("m.k")).alias("similarity"))


def fuzzy_merge(left: DataFrame, right: DataFrame, col: str, threshold: float = 0.8, method: str = "tfidf") -> DataFrame:
    """``left`` with ``<col>_matched``, ``<col>_similarity`` and the columns of
    the matching right rows."""
    m = fuzzy_match(left, right, col, threshold, method).toDF("_a", f"{col}_matched", f"{col}_similarity")
    names = [F.col(c).alias(f"{c}_using" if c in left.columns else c) for c in right.columns]
    using = right.select(*names)
    key = f"{col}_using"
    out = left.join(m, left[col] == m["_a"], "left").drop("_a")
    return out.join(using, F.col(f"{col}_matched") == F.col(key), "left")


def fuzzy_score(left: DataFrame, right: DataFrame, col: str, threshold: float = 80, raw: bool = False) -> DataFrame:
    """``left`` with ``<col>_match``, ``<col>_score`` (0-10 with 5 places, or raw
    0-100) and ``_merge`` (3 matched, 1 not); the threshold is 0-100."""
    m = fuzzy_match(left, right, col, threshold / 100, "editdistance")
    score = F.col("similarity") * 100 if raw else F.round(F.col("similarity") * 10, 5)
    m = m.select(F.col("a").alias("_a"), F.col("matched").alias(f"{col}_match"), score.alias(f"{col}_score"))
    out = left.join(m, left[col] == m["_a"], "left").drop("_a")
    return out.withColumn("_merge", F.when(F.col(f"{col}_match").isNotNull(), 3).otherwise(1))
