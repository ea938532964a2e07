"""Ranking chunks for queries: BM25, vector distance, and their fusion. All queries of a run share one plan."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import fixed
from quillstone.functions import text as T
from quillstone.operators import nearest

#: Query tables up to this many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Different words that a search names in the scan's filter.
NAMED_TERMS = 1_000
#: Documents of the rarest words that set a search's bar, for each of its k; documents that may prove a scale's start.
PROBED, SHORTEST = 50, 32


def weight(name: str) -> float:
    """A score weight from the environment, by its name or its legacy name; 1.0 by default."""
    return float(os.environ.get(f"{name}_SCORE_WEIGHT", os.environ.get(f"{name}_RRF_WEIGHT", "1.0")))


def fits(df: DataFrame) -> bool:
    """Whether a table, and whatever has at most a row for each of its rows, may be broadcast."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its row count is within the bound."""
    return F.broadcast(df) if fits(df) else df


def in_scope(chunks: DataFrame, year: Column, year_col: str = "year") -> DataFrame:
    return chunks.where(F.col(year_col) == year)


@dataclass
class Bm25Index:
    """postings (scope, id, dl, term, tf), documents (scope, id, dl), terms (scope, term, df, max_tf, min_dl, idf), scopes (scope, n, avgdl).

    Frames are lazy; ``persist`` keeps the postings for many queries. Postings of a stored index also have ``bucket``, one of ``buckets``.
    """

    postings: DataFrame
    documents: DataFrame
    terms: DataFrame
    scopes: DataFrame
    buckets: int | None = None

    def persist(self) -> Bm25Index:
        for df in (self.postings, self.documents, self.terms, self.scopes):
            df.persist()
        return self


def idf_terms(counts: DataFrame, scopes: DataFrame) -> DataFrame:
    """Adds idf to (scope, term, df, ...); a negative one becomes a quarter of the mean idf of the scope's vocabulary."""
    raw = counts.join(small(scopes.select("scope", "n")), "scope").withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy("scope").agg(F.avg("raw").alias("mean_idf"))
    idf = F.when(F.col("raw") < 0, fixed.BM25_EPSILON * F.col("mean_idf")).otherwise(F.col("raw"))
    return raw.join(mean, "scope").withColumn("idf", idf).drop("raw", "n", "mean_idf")


def bm25_index(docs: DataFrame, id_col: str, text_col: str, scope_col: str) -> Bm25Index:
    """Okapi BM25 statistics per scope."""
    words = docs.select(F.col(scope_col).alias("scope"), F.col(id_col).alias("id"), T.tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("words")).withColumn("dl", F.size("words"))
    documents = words.select("scope", "id", "dl")
    scopes = documents.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    postings = words.select("scope", "id", "dl", F.explode("words").alias("term")).groupBy("scope", "id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    # Counting over tf keeps both uses of the postings equal, so that their exchange is made once and reused.
    df = postings.groupBy("scope", "term").agg(F.count_if(F.col("tf") > 0).alias("df"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))
    return Bm25Index(postings, documents, idf_terms(df, scopes), scopes)


def asked_terms(queries: DataFrame) -> DataFrame:
    """(query_id, scope, term, times): case-sensitive words between white space; a word that a query repeats counts as often."""
    words = queries.select("query_id", "scope", F.explode(T.tokens(F.coalesce("query", F.lit("")))).alias("term"))
    return words.groupBy("query_id", "scope", "term").agg(F.count(F.lit(1)).alias("times"))


def gain(tf: Column | str, dl: Column | str) -> Column:
    """What a word adds to a document's score."""
    norm = fixed.BM25_K1 * (1 - fixed.BM25_B + fixed.BM25_B * F.col(dl) / F.col("avgdl"))
    return F.col("times") * F.col("idf") * F.col(tf) * (fixed.BM25_K1 + 1) / (F.col(tf) + norm)


def bm25_scores(index: Bm25Index, queries: DataFrame) -> DataFrame:
    """(query_id, scope, id, score) of documents that hold a query word; ``queries`` has query_id, scope, query."""
    asked = asked_terms(queries)
    few = fits(asked)
    weighed = index.terms.join(F.broadcast(asked) if few else asked, ["scope", "term"])  # at most a row for each asked word
    found = index.postings.join(F.broadcast(weighed) if few else weighed, ["scope", "term"]).join(small(index.scopes), "scope")
    return found.groupBy("query_id", "scope", "id").agg(F.sum(gain("tf", "dl")).alias("score"))


@dataclass
class Asked:
    """What a search asks: its words with weights and bounds (a row for each), and the postings of these words."""

    words: DataFrame
    postings: DataFrame
    few: bool

    def near(self, df: DataFrame) -> DataFrame:
        """Marked for broadcast if the asked words are within the bound; ``df`` has at most a row for each."""
        return F.broadcast(df) if self.few else df


def ask(index: Bm25Index, queries: DataFrame) -> Asked:
    """Words of ``queries`` that the index knows, with ``most`` and ``least``, bounds of what each can add to a score.

    Up to ``NAMED_TERMS`` different words go into the scan of the postings as a filter, which prunes the folders of a
    stored index and its row groups; more are joined.
    """
    asked = asked_terms(queries)
    few = fits(asked)
    known = index.terms.join(F.broadcast(asked) if few else asked, ["scope", "term"]).join(small(index.scopes.drop("n")), "scope")
    extreme = gain("max_tf", "min_dl")  # grows with tf and falls with dl
    words = known.select("query_id", "scope", "term", "times", "idf", "df", "avgdl", F.greatest(extreme, F.lit(0.0)).alias("most"), F.least(extreme, F.lit(0.0)).alias("least")).persist()
    postings = index.postings
    named = [r.term for r in words.select("term").distinct().limit(NAMED_TERMS + 1).collect()]
    if len(named) <= NAMED_TERMS:
        postings = postings.where(F.col("term").isin(named))
        if index.buckets:
            spots = words.select(F.pmod(F.xxhash64("term"), F.lit(index.buckets)).alias("bucket")).distinct().collect()
            postings = postings.where(F.col("bucket").isin([r.bucket for r in spots]))
    return Asked(words, postings, few)


def _kth(scores: DataFrame, k: int, *pool: str) -> DataFrame:
    """The k-th largest score of each pool that has so many; only k rows a task and pool are dealt out."""
    nth = F.row_number().over(Window.partitionBy(*pool).orderBy(F.desc("score")))
    return scores.withColumn("nth", nth).where(F.col("nth") <= k).where(F.col("nth") == k).select(*pool, F.col("score").alias("kth"))


def bm25_candidates(asked: Asked, k: int) -> DataFrame:
    """(query_id, scope, id, score) that hold the k best documents of every query and scope, with exact scores.

    1. The rarest words give partial scores; the k-th largest is a bar that the k-th best score reaches.
    2. Words whose bounds together stay below the bar cannot lift a document over it by themselves: only documents with
       another word are scored, by those words, which gives a higher bar.
    3. Documents that can still reach it get what the remaining words add. They are broadcast if they are few.

    A bar is lowered by 2e-6 of the largest possible score, so that ties at six places of a scaled score stay in.
    """
    pool, words = ["query_id", "scope"], asked.words
    rarer = Window.partitionBy(*pool).orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    probes = words.withColumn("before", F.coalesce(F.sum("df").over(rarer), F.lit(0))).where(F.col("before") < PROBED * k)
    partial = asked.postings.join(asked.near(probes), ["scope", "term"]).groupBy(*pool, "id").agg(F.sum(gain("tf", "dl")).alias("score"))
    smaller = Window.partitionBy(*pool).orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*pool)
    slack = F.sum("least").over(whole) - 2e-6 * F.sum("most").over(whole) - 1e-9
    marked = words.join(asked.near(_kth(partial, k, *pool)), pool, "left").withColumns({"slack": slack, "upto": F.sum("most").over(smaller)})
    marked = marked.withColumn("rest", F.coalesce(F.col("upto") < F.col("kth") + F.col("slack"), F.lit(False))).persist()
    found = asked.postings.join(asked.near(marked.where(~F.col("rest"))), ["scope", "term"])
    first = found.groupBy(*pool, "id").agg(F.sum(gain("tf", "dl")).alias("score"))
    could_add = F.coalesce(F.max(F.when(F.col("rest"), F.col("upto"))), F.lit(0.0)).alias("could_add")
    left = marked.groupBy(*pool).agg(F.first("slack").alias("slack"), could_add).join(asked.near(_kth(first, k, *pool)), pool, "left")
    able = first.join(asked.near(left), pool).where(F.col("kth").isNull() | (F.col("score") + F.col("could_add") >= F.col("kth") + F.col("slack"))).select(*pool, "id", "score").persist()
    rest = marked.where("rest").select(*pool, "term", "times", "idf", "avgdl")
    also = asked.postings.join(asked.near(rest.select("scope", "term").distinct()), ["scope", "term"], "left_semi").select("scope", "id", "term", "tf", "dl")
    more = also.join(small(able.drop("score")), ["scope", "id"]).join(asked.near(rest), [*pool, "term"]).select(*pool, "id", gain("tf", "dl").alias("score"))
    return able.unionByName(more).groupBy(*pool, "id").agg(F.sum("score").alias("score"))


def bm25_search(index: Bm25Index, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, scope, id, score, rank): the k best of the documents that hold a query word, by score at six places, then id."""
    return best(bm25_candidates(ask(index, queries), k), "score", k, "query_id", "scope")


def minmax(rows: DataFrame, column: str, *by: str, out: str = "norm") -> DataFrame:
    """Adds ``column`` scaled to 0..1 within ``by``; if all are equal, 1 for positive values and 0 else."""
    w = Window.partitionBy(*by)
    low, high = F.min(column).over(w), F.max(column).over(w)
    flat = F.when(F.col(column) > 0, 1.0).otherwise(0.0)
    return rows.withColumn(out, F.when(high - low <= 1e-12, flat).otherwise((F.col(column) - low) / (high - low)))


def bm25_normalized(index: Bm25Index, queries: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, scope, id, score, norm) over a query's whole pool.

    With ``k``, documents without a query word are listed only as far as they can be among the best k: the first k
    of the pool. They are still part of the scale.
    """
    scores = bm25_scores(index, queries)
    pool = index.documents.select("scope", "id")
    if k is not None:
        first = Window.partitionBy("scope").orderBy("id")
        pool = pool.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= k).drop("rn")
    asked = queries.select("query_id", "scope").distinct()
    rest = pool.join(asked, "scope").select("query_id", "scope", "id", F.lit(0.0).alias("score"))
    # A document of the pool that also scores keeps its score: the sum with 0.
    every = scores.unionByName(rest).groupBy("query_id", "scope", "id").agg(F.sum("score").alias("score"))
    bounds = scores.groupBy("query_id", "scope").agg(F.count(F.lit(1)).alias("matched"), F.min("score").alias("low"), F.max("score").alias("high"))
    bounds = asked.join(small(index.scopes), "scope").join(bounds, ["query_id", "scope"], "left")
    zero = F.coalesce("matched", F.lit(0)) < F.col("n")
    low = F.when(zero, F.least(F.coalesce("low", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("low"))
    high = F.when(zero, F.greatest(F.coalesce("high", F.lit(0.0)), F.lit(0.0))).otherwise(F.col("high"))
    bounds = bounds.select("query_id", "scope", low.alias("low"), high.alias("high"))
    span = F.col("high") - F.col("low")
    flat = F.when(F.col("score") > 0, 1.0).otherwise(0.0)
    bounds = F.broadcast(bounds) if fits(asked) else bounds
    return every.join(bounds, ["query_id", "scope"]).select("query_id", "scope", "id", "score", F.when(span <= 1e-12, flat).otherwise((F.col("score") - F.col("low")) / span).alias("norm"))


def best(rows: DataFrame, column: str, k: int, *by: str, descending: bool = True, tie: str = "id", out: str = "rank") -> DataFrame:
    """The k best rows of each group by ``column`` rounded to six places, ties to the smaller ``tie``."""
    score = F.col(column).desc() if descending else F.col(column).asc()
    rows = rows.withColumn(column, F.round(column, 6))
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(score, tie))).where(F.col(out) <= k)


def _lowest_is_zero(index: Bm25Index, asked: Asked) -> DataFrame:
    """(query_id, scope) that have a document without any of their words, and no word that lowers a score: their scale starts at 0.

    Found among the shortest documents of each scope; a pair that is not found may still have one.
    """
    short = Window.partitionBy("scope").orderBy("dl", "id")
    docs = index.documents.select("scope", "dl", "id").withColumn("nth", F.row_number().over(short)).where(F.col("nth") <= SHORTEST)
    probes = docs.groupBy("scope").agg(F.count(F.lit(1)).alias("probed"))
    met = asked.postings.select("scope", "id", "term").join(small(docs.select("scope", "id")), ["scope", "id"]).join(asked.near(asked.words.select("query_id", "scope", "term")), ["scope", "term"])
    held = met.groupBy("query_id", "scope").agg(F.countDistinct("id").alias("held"))
    pairs = asked.words.groupBy("query_id", "scope").agg(F.min("least").alias("least")).join(probes, "scope").join(held, ["query_id", "scope"], "left")
    return pairs.where((F.col("least") >= 0) & (F.coalesce("held", F.lit(0)) < F.col("probed"))).select("query_id", "scope")


def bm25_topk(index: Bm25Index, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, scope, id, bm25_score, rank): the k best of each pool, on the scale of the whole pool.

    The largest score is that of the best candidate and the smallest is 0 where a document has no query word, which a
    few documents prove; only queries without that proof are scored over their whole pool.
    """
    pool, asked = ["query_id", "scope"], ask(index, queries)
    known = _lowest_is_zero(index, asked).persist()
    scores = bm25_candidates(asked, k)
    open_ = queries.join(known, pool, "left_anti")
    every = queries.select(*pool).distinct()
    bounds = scores.join(known, pool, "left_semi").groupBy(*pool).agg(F.lit(0.0).alias("low"), F.max("score").alias("high"))
    if not open_.isEmpty():
        full = bm25_scores(index, open_).groupBy(*pool).agg(F.count(F.lit(1)).alias("matched"), F.min("score").alias("low"), F.max("score").alias("high"))
        sized = open_.select(*pool).distinct().join(small(index.scopes.select("scope", "n")), "scope").join(full, pool, "left")
        zero = F.coalesce("matched", F.lit(0)) < F.col("n")
        end = lambda f, c: F.when(zero, f(F.coalesce(c, F.lit(0.0)), F.lit(0.0))).otherwise(F.col(c)).alias(c)
        bounds = bounds.unionByName(sized.select(*pool, end(F.least, "low"), end(F.greatest, "high")))
    first = index.documents.select("scope", "id").withColumn("nth", F.row_number().over(Window.partitionBy("scope").orderBy("id"))).where(F.col("nth") <= k)
    rest = first.join(every, "scope").select(*pool, "id", F.lit(0.0).alias("score"))
    # Of the first documents of a pool those that score keep their score: the sum with 0.
    listed = scores.unionByName(rest).groupBy(*pool, "id").agg(F.sum("score").alias("score"))
    span = F.col("high") - F.col("low")
    flat = F.when(F.col("score") > 0, 1.0).otherwise(0.0)
    norm = F.when(span <= 1e-12, flat).otherwise((F.col("score") - F.col("low")) / span)
    return best(listed.join(asked.near(bounds), pool).select(*pool, "id", norm.alias("bm25_score")), "bm25_score", k, *pool)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def vector_distances(vectors: DataFrame, queries: DataFrame, *, prefilter: str | None = None) -> DataFrame:
    """(query_id, id, distance), squared L2, of vectors (id, embedding) and queries (query_id, embedding).

    The stated query set goes against all rows: a broadcast loop while it is within the bound. ``prefilter`` names a
    column both sides share (the year), which makes it a hash join within that scope.
    """
    asked = queries.select("query_id", F.col("embedding").alias("asked"), *([prefilter] if prefilter else []))
    joined = vectors.join(small(asked), prefilter) if prefilter else vectors.join(small(asked), F.lit(True))
    return joined.select("query_id", "id", squared_distance(F.col("embedding"), F.col("asked")).alias("distance"))


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, *, prefilter: str | None = None) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest of vectors (id, embedding) for queries (query_id, embedding), by blocks."""
    by = [prefilter] if prefilter else []
    asked = queries.select("query_id", F.col("embedding").alias("asked"), *by)
    return best(nearest.candidates(vectors, asked, k, *by), "distance", k, "query_id", descending=False)


def fuse(bm25: DataFrame, embedding: DataFrame, chunks: DataFrame, *, table_bonus: bool = True, polarity: str = "similarity", bm25_weight: float | None = None, embedding_weight: float | None = None, scope: str | None = None) -> DataFrame:
    """Weighted sum of both normalised scores on (query_id, id), missing sides as 0; chunks are (id, chunk_nature).

    ``scope`` names a column of both sides: each query then has its own scale and result in each scope.

    ``bm25`` has norm. ``embedding`` has distance: as similarity its scale is turned round, so that near is high; as
    distance it is not. With the bonus, the BM25 part of chunks that are mainly tables counts twice. Without
    embedding rows the result is the BM25 part.
    """
    wb = weight("BM25") if bm25_weight is None else bm25_weight
    we = weight("EMBEDDING") if embedding_weight is None else embedding_weight
    if polarity not in ("similarity", "distance"):
        raise ValueError(f"Unknown polarity: {polarity}")
    pool = ["query_id", scope] if scope else ["query_id"]
    scaled = minmax(embedding.withColumn("value", -F.col("distance") if polarity == "similarity" else F.col("distance")), "value", *pool, out="embedding_score")
    both = bm25.select(*pool, "id", F.col("norm").alias("bm25_score")).join(scaled.select(*pool, "id", "embedding_score"), [*pool, "id"], "full")
    both = both.join(chunks.select("id", "chunk_nature"), "id", "left").fillna(0.0, ["bm25_score", "embedding_score"])
    factor = F.when(F.col("chunk_nature") == "table_main", 2.0).otherwise(1.0) if table_bonus else F.lit(1.0)
    return both.select(*pool, "id", "bm25_score", "embedding_score", (wb * factor * F.col("bm25_score") + we * F.col("embedding_score")).alias("hybrid_score"))


def hybrid_topk(fused: DataFrame, k: int = 5, scope: str | None = None) -> DataFrame:
    rounded = fused.withColumns({c: F.round(c, 6) for c in ("bm25_score", "embedding_score")})
    return best(rounded, "hybrid_score", k, "query_id", *([scope] if scope else []))


def retriever(kind: str):
    """The ranking function of that name: bm25, embedding or hybrid."""
    try:
        return {"bm25": bm25_topk, "embedding": vector_topk, "hybrid": hybrid_topk}[kind]
    except KeyError:
        raise ValueError(f"Unknown retriever type: {kind}") from None
