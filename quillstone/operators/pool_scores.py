"""Scores of whole pools, document by document: a row has its scores for all queries as an array, so no pair is shuffled.

Tasks score blocks of documents against the asked words and vectors, which are sent to them: at most ``BROADCAST_ROWS`` rows, or an error.
Document frequencies are pre-aggregated by task, so the vocabulary is shuffled and not the postings.

Every query is asked in every scope. Ids are unique; null texts have no words; vectors that are null, hold null or have another length
than a query's have no distance to it. An array's places are those of ``names``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import fixed
from quillstone.operators.ranking import BROADCAST_ROWS, asked_terms, best, fits, idf_terms

#: Scores of a block of documents at most, rows that are held before the best are kept, and parts of scores that are added at once.
BLOCK, HELD, ADDED = 2**20, 2**20, 2**22
COUNTED = pa.schema([("key", pa.string()), ("term", pa.string()), ("df", pa.int64()), ("words", pa.int64())])
BEST = pa.schema([("key", pa.string()), ("place", pa.int32()), ("id", pa.int64()), ("score", pa.float64()), ("listed", pa.bool_())])
SCORED = pa.schema([("key", pa.string()), ("id", pa.int64()), ("score", pa.list_(pa.float64())), ("distance", pa.list_(pa.float64()))])


def _key(scope: Column) -> Column:
    """A scope, which may be a struct or null, as text."""
    return F.to_json(F.struct(scope.alias("scope")))


def _lists(values: np.ndarray) -> pa.Array:
    """A matrix as lists; NaN of the second kind are nulls (see ``_distances``)."""
    n, width = values.shape
    flat = values.ravel() if isinstance(values, np.ma.MaskedArray) else np.ma.masked_array(values.ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(flat.data, pa.float64(), mask=np.broadcast_to(np.ma.getmaskarray(flat), flat.shape)))


def _distances(vectors: pa.Array, asked: list) -> np.ma.MaskedArray:
    """Squared distance of each vector to each asked one; masked where there is none."""
    out = np.ma.masked_all((len(vectors), len(asked)))
    sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    for width in {len(q) for q in asked if q is not None}:
        rows = np.flatnonzero(sizes == width)
        if not len(rows):
            continue
        flat = vectors.take(pa.array(rows)).flatten().cast(pa.float64())
        held = flat.is_valid().to_numpy(zero_copy_only=False).reshape(len(rows), width).all(1)
        own = flat.fill_null(0).to_numpy(zero_copy_only=False).reshape(len(rows), width)[held]
        for place, q in enumerate(asked):
            if q is not None and len(q) == width and None not in q:
                out[rows[held], place] = np.square(own - np.asarray(q, np.float64)).sum(1)
    return out


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number of words of each text, and all words: those of ``T.tokens``, between ASCII white space."""
    split = pc.ascii_split_whitespace(texts)
    flat = split.flatten()
    held = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    before = np.r_[0, np.cumsum(held)]
    offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
    return np.diff(before[offsets]), flat.filter(pa.array(held))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, text) to (key, term, df, words) of a batch; the row without a term has a scope's documents and words."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, (dl, flat) = batch.column(0).dictionary_encode(), words_of(batch.column(1))
        key, terms = keys.indices.to_numpy(), flat.dictionary_encode()
        width = max(len(terms.dictionary), 1)
        doc, term = np.divmod(np.unique(np.repeat(np.arange(len(dl)), dl) * width + terms.indices.to_numpy()), width)
        pair, df = np.unique(key[doc] * width + term, return_counts=True)
        n = len(keys.dictionary)
        of = pa.array(np.r_[pair // width, np.arange(n)])
        named = terms.dictionary.take(pa.array(np.r_[pair % width, np.zeros(n, int)], mask=np.r_[np.zeros(len(pair), bool), np.ones(n, bool)]))
        sums = np.r_[np.zeros(len(pair), int), np.bincount(key, dl, n).astype(int)]
        yield pa.record_batch([keys.dictionary.take(of), named, pa.array(np.r_[df, np.bincount(key, minlength=n)]), pa.array(sums)], schema=COUNTED)


def _bm25(weights: dict, terms: pa.Array, average: dict, n_queries: int):
    """Sums of a block, documents by queries, and with ``count`` whether a document has a word of the query.

    ``weights``: for each scope the start of each term's entries, their queries and what a word of full weight adds.
    """
    def bm25(keys: list, texts: pa.Array, count: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        n = len(keys)
        dl, flat = words_of(texts)
        doc = np.repeat(np.arange(n), dl)
        at = pc.index_in(flat, value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False)
        known = at >= 0
        pair, tf = np.unique(doc[known] * max(len(terms), 1) + at[known], return_counts=True)
        doc, term = np.divmod(pair, max(len(terms), 1))
        sums, met, signed = np.zeros(n * n_queries), np.zeros(n * n_queries, bool) if count else None, False
        for key in set(keys):
            if key not in weights:
                continue
            starts, places, adds = weights[key]
            own = np.fromiter((k == key for k in keys), bool, n)[doc]
            d, t, f = doc[own], term[own], tf[own]
            part = f * (fixed.BM25_K1 + 1) / (f + fixed.BM25_K1 * (1 - fixed.BM25_B + fixed.BM25_B * dl[d] / average[key]))
            times = starts[t + 1] - starts[t]
            ends = np.cumsum(times)
            cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(ADDED, ends[-1] if len(ends) else 0, ADDED)), len(ends)])
            for a, b in zip(cuts, cuts[1:]):
                of = times[a:b]
                entry = np.repeat(starts[t[a:b]] - (np.cumsum(of) - of), of) + np.arange(of.sum())
                where = np.repeat(d[a:b], of) * n_queries + places[entry]
                sums += np.bincount(where, adds[entry] * np.repeat(part[a:b], of), n * n_queries)
                if count and len(adds) and adds.min() <= 0:
                    met[where], signed = True, True
        if count:
            met = met | (sums > 0) if signed else sums > 0
        return sums.reshape(n, n_queries), met.reshape(n, n_queries) if count else None

    return bm25


def _score(bm25, asked: list, n_queries: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK // max(n_queries, 1))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                yield pa.record_batch([part.column(0), part.column(1), _lists(bm25(part.column(0).to_pylist(), part.column(2))[0]), _lists(_distances(part.column(3), asked))], schema=SCORED)

    return score


def _best(bm25, slack: dict, k: int, n_queries: int, matched: bool):
    """Of each block the documents that can be among the k best of a scope and query, and one of the lowest score (not ``listed``).

    A bar is lowered by ``slack``, so ties at six places of a scaled score stay in; of equal scores the k smallest ids do.
    """
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK // max(n_queries, 1))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                keys, order = part.column(0).to_pylist(), part.column(1).fill_null(-(2**63)).to_numpy(zero_copy_only=False)
                every, met = bm25(keys, part.column(2), True)
                for key in set(keys):
                    rows = np.flatnonzero(np.fromiter((x == key for x in keys), bool, len(keys)))
                    own = every[rows]
                    open_ = np.where(met[rows], own, -np.inf) if matched else own
                    kth = np.partition(open_, -k, axis=0)[-k] if len(rows) > k else np.full(n_queries, -np.inf)
                    row, place = np.nonzero((open_ >= kth - slack.get(key, 0.0)) & (open_ > -np.inf))
                    score = own[row, place]
                    sort = np.lexsort((order[rows[row]], -score, place))
                    row, place, score = row[sort], place[sort], score[sort]
                    at = np.arange(len(row))
                    new = np.r_[True, (place[1:] != place[:-1]) | (score[1:] != score[:-1])][: len(row)]
                    few = at - np.maximum.accumulate(np.where(new, at, 0)) < k
                    row, place, score = row[few], place[few], score[few]
                    low = own.argmin(0)
                    at = pa.array(np.r_[rows[row], rows[low]])
                    n, listed = len(at), np.r_[np.ones(len(row), bool), np.zeros(n_queries, bool)]
                    yield pa.record_batch([pa.array([key] * n, pa.string()), pa.array(np.r_[place, np.arange(n_queries)], pa.int32()), part.column(1).take(at), pa.array(np.r_[score, own[low, np.arange(n_queries)]]), pa.array(listed)], schema=BEST)

    return best


class Pools:
    """What tasks need to score ``docs`` (id, text, scope) for ``queries`` (query_id, query, and more)."""

    def __init__(self, docs: DataFrame, queries: DataFrame):
        spark = docs.sparkSession
        self.texts = docs.select(F.col("id").cast("long").alias("id"), _key(F.col("scope")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
        keyed = docs.select("scope").distinct().select(_key(F.col("scope")).alias("key"), "scope")
        self.scopes = spark.createDataFrame(keyed.collect(), keyed.schema)
        everywhere = asked_terms(queries.select("query_id", "query").crossJoin(F.broadcast(self.scopes.select(F.col("key").alias("scope"))))).persist()
        if not (fits(everywhere) and fits(queries)):
            raise ValueError(f"more than {BROADCAST_ROWS} asked words")
        self.query_ids = [r.query_id for r in queries.select("query_id").distinct().orderBy("query_id").collect()]
        place = {q: k for k, q in enumerate(self.query_ids)}
        # Batches are counted as they are, so about a row for each word of a batch is shuffled.
        counted = self.texts.select("key", "text").mapInArrow(_frequencies, "key string, term string, df long, words long")
        counted = counted.groupBy(F.col("key").alias("scope"), "term").agg(F.sum("df").alias("df"), F.sum("words").alias("words")).persist()
        scopes = counted.where("term IS NULL").select("scope", F.col("df").alias("n"), "words")
        weighed = idf_terms(counted.where("term IS NOT NULL").select("scope", "term", "df"), scopes).join(F.broadcast(everywhere), ["scope", "term"])
        weighed = weighed.select(F.col("scope").alias("key"), "term", "query_id", (F.col("times") * F.col("idf")).alias("adds")).toArrow()
        average = {r["scope"]: r.words / r.n for r in scopes.collect()}
        counted.unpersist()
        everywhere.unpersist()
        known = sorted(set(weighed.column("term").to_pylist()))
        number, weights = {t: k for k, t in enumerate(known)}, {}
        self.bounds = {}
        for key in set(weighed.column("key").to_pylist()):
            own = weighed.filter(pc.equal(weighed.column("key"), key))
            term = np.array([number[t] for t in own.column("term").to_pylist()])
            order = np.argsort(term, kind="stable")
            starts = np.searchsorted(term[order], np.arange(len(known) + 1))
            weights[key] = (starts, np.array([place[q] for q in own.column("query_id").to_pylist()])[order], own.column("adds").to_numpy()[order])
            # A word adds less than k1 + 1 times its weight.
            self.bounds[key] = (fixed.BM25_K1 + 1) * np.bincount(weights[key][1], np.abs(weights[key][2]), len(place))
        self.bm25 = _bm25(weights, pa.array(known, pa.string()), average, len(place))
        self.names = spark.createDataFrame([(k, q) for q, k in place.items()], queries.select(F.lit(0).alias("place"), "query_id").schema)


def pool_scores(docs: DataFrame, queries: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, scope, id, score, distance) of ``docs`` (id, text, scope), and names (place, query_id).

    ``queries`` has query_id, query and embedding, null where there is none; ``vectors`` has id and embedding.
    """
    pools = Pools(docs, queries)
    rows = queries.groupBy("query_id").agg(F.first("embedding", ignorenulls=True).alias("embedding")).orderBy("query_id").collect()
    run = _score(pools.bm25, [r.embedding for r in rows], len(rows))
    held = pools.texts.join(vectors.select(F.col("id").cast("long").alias("id"), "embedding"), "id", "left")
    scored = held.select("key", "id", "text", "embedding").mapInArrow(run, "key string, id long, score array<double>, distance array<double>")
    return scored.join(F.broadcast(pools.scopes), "key"), pools.names


def _ends(docs: DataFrame, queries: DataFrame, k: int, matched: bool) -> DataFrame:
    """(query_id, scope, id, score, low, high): candidates for the k best of each pool, and the ends of the pool's scale."""
    pools = Pools(docs, queries)
    run = _best(pools.bm25, {key: 2e-6 * np.maximum(b, 1.0) + 1e-9 for key, b in pools.bounds.items()}, k, len(pools.query_ids), matched)
    found = pools.texts.select("key", "id", "text").mapInArrow(run, "key string, place int, id long, score double, listed boolean")
    pool = Window.partitionBy("key", "place")
    found = found.withColumns({"low": F.min("score").over(pool), "high": F.max("score").over(pool)}).where("listed")
    return found.join(F.broadcast(pools.scopes), "key").join(F.broadcast(pools.names), "place").select("query_id", "scope", "id", "score", "low", "high")


def pool_search(docs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """As ``ranking.bm25_search``, with every query asked in every scope; no posting is shuffled."""
    return best(_ends(docs, queries, k, True).select("query_id", "scope", "id", "score"), "score", k, "query_id", "scope")


def pool_topk(docs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """As ``ranking.bm25_topk``, with every query asked in every scope; no posting is shuffled."""
    span = F.col("high") - F.col("low")
    flat = F.when(F.col("score") > 0, 1.0).otherwise(0.0)
    norm = F.when(span <= 1e-12, flat).otherwise((F.col("score") - F.col("low")) / span)
    return best(_ends(docs, queries, k, False).select("query_id", "scope", "id", norm.alias("bm25_score")), "bm25_score", k, "query_id", "scope")


def fused_pools(scored: DataFrame, names: DataFrame, chunks: DataFrame, *, bm25_weight: float = 1.0, embedding_weight: float = 1.0, polarity: str = "similarity") -> DataFrame:
    """(pool, query_id, scope, id, bm25_score, embedding_score, hybrid_score) as ``ranking.fuse`` with scopes, and the bonus of tables.

    ``scored`` is read twice and should be a stored table; ``chunks`` are (id, chunk_nature).
    """
    if polarity not in ("similarity", "distance"):
        raise ValueError(f"Unknown polarity: {polarity}")
    value = lambda c: -F.col(c) if polarity == "similarity" else F.col(c)
    each = scored.select("key", F.posexplode(F.arrays_zip("score", "distance")).alias("place", "s")).select("key", "place", "s.score", value("s.distance").alias("value"))
    ends = each.groupBy("key", "place").agg(*[f(c).alias(f"{n}_{c}") for c in ("score", "value") for n, f in (("low", F.min), ("high", F.max))])
    ends = ends.join(F.broadcast(names), "place").withColumn("pool", F.row_number().over(Window.orderBy("key", "place")))
    by_key = ends.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "pool", "query_id", "low_score", "high_score", "low_value", "high_value"))).alias("ends"))
    # A row for each scope.
    rows = scored.join(F.broadcast(by_key), "key").join(chunks.select(F.col("id").cast("long").alias("id"), "chunk_nature"), "id", "left")
    pairs = rows.select("scope", "id", "chunk_nature", F.explode(F.arrays_zip("score", "distance", "ends")).alias("s")).select("scope", "id", "chunk_nature", "s.score", value("s.distance").alias("value"), "s.ends.*")

    def norm(c: str) -> Column:
        span = F.col(f"high_{c}") - F.col(f"low_{c}")
        return F.when(span <= 1e-12, F.when(F.col(c) > 0, 1.0).otherwise(0.0)).otherwise((F.col(c) - F.col(f"low_{c}")) / span)

    pairs = pairs.select("pool", "query_id", "scope", "id", "chunk_nature", norm("score").alias("bm25_score"), F.coalesce(norm("value"), F.lit(0.0)).alias("embedding_score"))
    factor = F.when(F.col("chunk_nature") == "table_main", 2.0).otherwise(1.0)
    return pairs.select("pool", "query_id", "scope", "id", "bm25_score", "embedding_score", (bm25_weight * factor * F.col("bm25_score") + embedding_weight * F.col("embedding_score")).alias("hybrid_score"))


def near_best(rows: DataFrame, column: str, k: int) -> DataFrame:
    """Of rows (pool, id, ``column``) those a task cannot rule out of the k best of their pool at six places, ties to the smaller id."""
    def prune(held: list[pa.RecordBatch]) -> pa.Table:
        table = pa.Table.from_batches(held)
        pool, ids = table.column("pool").to_numpy(), table.column("id").fill_null(-(2**63)).to_numpy()
        score = table.column(column).to_numpy()
        score = np.where(np.isnan(score), np.inf, score)
        order = np.lexsort((ids, -score, pool))
        pool, score = pool[order], score[order]
        place = np.arange(len(order))
        new = np.r_[True, pool[1:] != pool[:-1]] if len(order) else np.zeros(0, bool)
        start = np.maximum.accumulate(np.where(new, place, 0))
        other = new | np.r_[True, score[1:] != score[:-1]] if len(order) else new
        run = place - np.maximum.accumulate(np.where(other, place, 0))
        kth = np.minimum(start + k - 1, max(len(order) - 1, 0))
        bar = np.where(pool[kth] == pool, score[kth], -np.inf) - 2e-6
        return table.take(pa.array(np.sort(order[(score >= bar) & (run < k)])))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= HELD:
                held = prune(held).combine_chunks().to_batches()
                n = sum(b.num_rows for b in held)
                if n >= HELD // 2:  # many pools: what is left goes on as it is
                    yield from held
                    held, n = [], 0
        if held:
            yield from prune(held).to_batches()

    return rows.mapInArrow(best, rows.schema)
