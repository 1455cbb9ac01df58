"""Ranking operators. Each takes and gives a batch: one row per (query_id, rank) with chunk_id, source_path and score.

Scores are rounded to six digits before they are ranked, so that the order does not depend on the order of summation;
ties go to the lesser chunk id. Rank is explicit everywhere.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from folioforge.functions.text import terms
from folioforge.functions.vectors import cosine, overlap_score
from folioforge.operators.answers import ordered_text
from folioforge.operators.groups import small_or_plain
from folioforge.session import cut

K1, B, RRF_K, CANDIDATES, TOP = 1.5, 0.75, 60, 20, 5
#: Rows and queries of one block of a search, at most in expectation.
VECTOR_BLOCK, QUERY_BLOCK = 8192, 8192
BM25_CHUNKS, BM25_QUERIES = 32768, 131072
#: Terms up to this number, with their frequencies, are broadcast when an index is made; a row is a word and a number.
FREQUENCY_ROWS = 1_000_000
#: Blocks up to this number are tasks of their own.
MOST_TASKS = 20_000
#: Queries and cells of one matrix inside a task.
BATCH_QUERIES, BATCH_CELLS = 256, 8_000_000
#: Pairs of a question and a chunk with one of its rare terms, at one time inside a task.
BATCH_PAIRS = 2_000_000
#: Terms in more than a share of the chunks are common. Of these shares that one is taken at which a search costs least.
COMMON_SHARES = (0.05, 0.02, 0.01, 0.005, 0.002, 0.001, 0.0005, 0.0001)
#: What a cell of common terms and a pair of rare ones cost, in nanoseconds as measured on one core.
CELL_COST, PAIR_COST = 40, 400


def top_k(scored: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """The k best rows per query with their rank. Spark keeps only k per query and task before it shuffles."""
    if k < 1:
        raise ValueError("top_k must be at least 1")
    w = Window.partitionBy(by).orderBy(F.col("score").desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# BM25 --------------------------------------------------------------------------------------------------------------
def chunk_terms(chunks: DataFrame) -> DataFrame:
    """chunk_id, source_path and the chunk's terms; every chunk, also those without terms."""
    return chunks.select("chunk_id", "source_path", terms(F.col("text")).alias("terms"))


def postings(termed: DataFrame) -> DataFrame:
    """chunk_id, source_path, token, tf and the chunk's length in terms; a chunk without terms has none."""
    t = termed.select("chunk_id", "source_path", F.size("terms").alias("dl"), F.explode("terms").alias("token"))
    return t.groupBy("chunk_id", "source_path", "dl", "token").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(termed: DataFrame) -> DataFrame:
    """One row: the number of chunks, those without terms included, and their mean length."""
    n = F.count(F.lit(1))
    return termed.agg(n.alias("n_chunks"), (F.coalesce(F.sum(F.size("terms")), F.lit(0)) / n).alias("avg_len"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, token: each query's distinct terms."""
    return queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("token"))


def weighted_postings(chunks: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """chunk_id, source_path, token, weight: each posting's part of the score, with statistics over all chunks; a chunk's side by side.

    The weights depend on the corpus only; a table of them answers any number of queries by one join.
    """
    if k1 <= 0 or not 0 <= b <= 1:
        raise ValueError("k1 must be positive and b within 0 and 1")
    termed = cut(chunks.select("chunk_id", "source_path", terms(F.col("text")).alias("t")).select("chunk_id", "source_path", F.size("t").alias("dl"), F.array_join("t", " ").alias("words")))  # terms have no spaces
    n, n_ids, total = termed.agg(F.count(F.lit(1)), F.count_distinct("chunk_id"), F.coalesce(F.sum("dl"), F.lit(0))).head()
    if n != n_ids:  # rows of the same chunk count as one text
        termed = termed.groupBy("chunk_id", "source_path", "dl").agg(F.array_join(F.collect_list("words"), " ").alias("words"))
    termed = termed.filter("dl > 0")
    found = termed.select("words").mapInArrow(_frequencies, "token string, df long")
    df = cut(found.groupBy("token").agg(F.sum("df").alias("df")))
    posted = termed.mapInArrow(_counted, "chunk_id string, source_path string, dl int, posted array<struct<token:string,tf:int>>").select("chunk_id", "source_path", "dl", F.inline("posted"))
    if df.count() <= FREQUENCY_ROWS:
        scored = posted.join(F.broadcast(df), "token")
    else:
        scored = posted.join(df, "token").repartition("chunk_id").sortWithinPartitions("chunk_id")
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(total / max(n, 1))))
    return scored.select("chunk_id", "source_path", "token", (idf * tf).alias("weight"))


def _distinct(words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The terms of a batch of texts; then text, term and number of occurrences of each text's distinct terms, in the order of texts."""
    lists = pc.split_pattern(words, " ")
    flat = lists.flatten().dictionary_encode()
    pairs, tf = np.unique(pc.list_parent_indices(lists).to_numpy().astype(np.int64) * len(flat.dictionary) + flat.indices.to_numpy(), return_counts=True)
    return flat.dictionary, *np.divmod(pairs, len(flat.dictionary)), tf


def _frequencies(batches):
    """token, df: in how many texts of a batch a term is."""
    for batch in batches:
        if batch.num_rows:
            token, _, term, _ = _distinct(batch["words"])
            yield pa.RecordBatch.from_arrays([token, pa.array(np.bincount(term, minlength=len(token)).astype(np.int64))], ["token", "df"])


def _counted(batches):
    """Each text's distinct terms with their numbers, without a shuffle."""
    for batch in batches:
        if batch.num_rows:
            token, text, term, tf = _distinct(batch["words"])
            ends = pa.array(np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32))
            posted = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([token.take(pa.array(term)), pa.array(tf.astype(np.int32))], ["token", "tf"]))
            yield pa.RecordBatch.from_arrays([batch["chunk_id"], batch["source_path"], batch["dl"], posted], ["chunk_id", "source_path", "dl", "posted"])


def best_cells(scores: np.ndarray, k: int, positive: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score to six digits) of the k best cells of every row; ties go to the lesser column."""
    n = scores.shape[1]
    wide = max(k, 64)  # of so many groups of columns the k-th best maximum is a score that k cells reach
    if n >= 4 * wide:
        m = n // wide * wide
        reached = np.partition(scores[:, :m].reshape(len(scores), m // wide, wide).max(axis=1), wide - k, axis=1)[:, wide - k] - 1e-6  # less by what rounding may add
        cells = np.flatnonzero(scores >= (np.maximum(reached, 4e-7) if positive else reached)[:, None])
    else:
        cells = np.arange(scores.size)
    rows, columns = np.divmod(cells, max(n, 1))
    found = np.rint(scores[rows, columns] * 1e6).astype(np.int64)
    if positive:
        rows, columns, found = rows[found > 0], columns[found > 0], found[found > 0]
    kept = leading(rows, columns, found, k)
    return rows[kept], columns[kept], found[kept] / 1e6


def leading(rows: np.ndarray, columns: np.ndarray, found: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best entries of every row; ties go to the lesser column."""
    order = np.lexsort((columns, -found, rows))
    r = rows[order]
    return order[np.arange(len(r)) - np.searchsorted(r, r) < k]


def in_blocks(queries: DataFrame, rows: DataFrame, n_queries: int, n_rows: int, search: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """search(rows, queries) for every block of queries with every block of rows, brought together by an equi-join of block numbers.

    Rows are shipped once per block of queries and queries once per block of rows. Each block is a group of its own, of
    bounded size, whatever the keys are.
    """
    block = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("_q", block("query_id", n_queries)).withColumn("_c", every(n_rows))
    c = rows.withColumn("_c", block("chunk_id", n_rows)).withColumn("_q", every(n_queries))
    q, c = (df.withColumn("_block", F.col("_q") * n_rows + F.col("_c")).drop("_q", "_c") for df in (q, c))
    if n_queries * n_rows <= MOST_TASKS:  # a task for every block, instead of as the hash of its number falls
        q, c = (df.repartitionById(n_queries * n_rows, F.col("_block")) for df in (q, c))
    return c.groupBy("_block").cogroup(q.groupBy("_block")).applyInArrow(search, schema)


def block_counts(df: DataFrame, n_queries: int, n_rows: int, most_queries: int, most_rows: int) -> tuple[int, int]:
    """Numbers of blocks of queries and of rows: none larger than wanted, and enough of them for all cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    a = max(1, math.ceil(n_queries / most_queries))
    return a, max(1, math.ceil(n_rows / most_rows), min(math.ceil(cores / a), math.ceil(16 * n_rows / most_rows)))


def _product(rows: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """For a block: the k best chunks of each set of common terms, and of each whole set those with a rare term of it.

    The scores by common terms alone are a product of matrices, a row for each set of common terms; rare terms are added where
    they occur. A chunk without a rare term of the set has the score of the common ones, so that both together hold the k best.
    """
    rows = rows.sort_by("chunk_id")  # columns in the order of ids, so that ties go to the lesser
    queries = queries.sort_by("query_id")
    ids, paths = (pa.concat_arrays(rows[x].chunks) if rows.num_rows else pa.array([], pa.string()) for x in ("chunk_id", "source_path"))
    names, key, chunk, scores = [], [], [], []
    if rows.num_rows and queries.num_rows:
        posted = rows["posted"].combine_chunks()
        token, weight, p_c = posted.flatten().field("token"), posted.flatten().field("weight").to_numpy(), pc.list_parent_indices(posted).to_numpy()

        def of(lists: pa.Array) -> tuple[np.ndarray, ...]:
            """Owner and term of every entry of the lists, then term, chunk and weight of the postings of these terms."""
            flat = lists.flatten().dictionary_encode()
            t = pc.fill_null(pc.index_in(token, flat.dictionary), -1).to_numpy()
            known = t >= 0
            return pc.list_parent_indices(lists).to_numpy(), flat.indices.to_numpy(), t[known], p_c[known], weight[known]

        group = queries["query_id"].combine_chunks().dictionary_encode()
        g = group.indices.to_numpy()  # ascending, as the rows are sorted
        a_g, a_t, c_t, c_c, c_w = of(queries["common"].combine_chunks().take(pa.array(np.unique(g, return_index=True)[1])))
        a_s, s_t, r_t, r_c, r_w = of(queries["rare"].combine_chunks())
        by_term = np.argsort(r_t, kind="stable")
        r_t, r_c, r_w = r_t[by_term], r_c[by_term], r_w[by_term]
        first = np.searchsorted(r_t, s_t)
        held = np.searchsorted(r_t, s_t, "right") - first
        n_g, n_c = len(group.dictionary), len(ids)
        for lo in range(0, n_g, BATCH_QUERIES):
            n = min(BATCH_QUERIES, n_g - lo)
            base = _common_scores(a_g - lo, a_t, c_t, c_c, c_w, n, n_c)
            r, c, score = best_cells(base, k, positive=True)
            names.append(group.dictionary.take(pa.array(r + lo)))
            chunk.append(c)
            scores.append(score)
            last = np.full(n, np.inf)  # what the k-th best chunk by common terms has, if there are as many
            np.minimum.at(last, r, score)
            last[np.bincount(r, minlength=n) < k] = 0.0
            lists = slice(*np.searchsorted(a_s, np.searchsorted(g, [lo, lo + n])))
            for s, c, score in _rare_scores(a_s[lists], first[lists], held[lists], r_c, r_w, base, g - lo, last, k):
                names.append(queries["_set"].combine_chunks().take(pa.array(s)))
                chunk.append(c)
                scores.append(score)
    chunk, scores = (np.concatenate(x) if x else np.array([], t) for x, t in ((chunk, np.int64), (scores, np.float64)))
    return pa.table({"key": pa.concat_arrays(names) if names else pa.array([], pa.string()), "chunk_id": ids.take(pa.array(chunk)), "source_path": paths.take(pa.array(chunk)), "score": pa.array(scores, pa.float64())})


def _common_scores(owner: np.ndarray, asked: np.ndarray, p_t: np.ndarray, p_c: np.ndarray, weight: np.ndarray, n: int, n_c: int) -> np.ndarray:
    """Scores of n sets of common terms, given as (owner, term), with all chunks; the postings are in the order of chunks."""
    mine = (owner >= 0) & (owner < n)
    wanted, at = np.unique(asked[mine], return_inverse=True)
    scores = np.zeros((n, n_c))
    if not len(wanted):
        return scores
    ask = np.zeros((n, len(wanted)))
    ask[owner[mine], at] = 1.0
    place = np.full(max(wanted.max(), p_t.max(initial=0)) + 1, -1)
    place[wanted] = np.arange(len(wanted))
    step = max(1, BATCH_CELLS // max(len(wanted), n))
    for left in range(0, n_c, step):
        a, b = np.searchsorted(p_c, [left, left + step])
        t = place[p_t[a:b]]
        has = t >= 0
        matrix = np.zeros((len(wanted), min(step, n_c - left)))
        matrix[t[has], p_c[a:b][has] - left] = weight[a:b][has]
        np.matmul(ask, matrix, out=scores[:, left : left + step])
    return scores


def _rare_scores(owner: np.ndarray, first: np.ndarray, held: np.ndarray, p_c: np.ndarray, weight: np.ndarray, base: np.ndarray, group: np.ndarray, last: np.ndarray, k: int):
    """(set, chunk, score) of the chunks with a rare term of the set, at most k per set, in portions; base has the scores by common terms."""
    n_c, before = base.shape[1], np.cumsum(held) - held
    starts = np.flatnonzero(np.diff(owner, prepend=-1))  # portions end between two sets
    ends = np.append(starts[np.diff(before[starts] // BATCH_PAIRS, prepend=-1) > 0], len(owner))
    for a, b in zip(ends[:-1], ends[1:]):
        n = held[a:b]
        at = np.repeat(first[a:b] - np.cumsum(n) + n, n) + np.arange(n.sum())
        if not len(at):
            continue
        pair = np.repeat(owner[a:b].astype(np.int64), n) * n_c + p_c[at]
        order = np.argsort(pair, kind="stable")
        start = np.flatnonzero(np.diff(pair[order], prepend=-1))
        s, c = np.divmod(pair[order][start], n_c)
        score = np.rint((base[group[s], c] + np.add.reduceat(weight[at][order], start)) * 1e6).astype(np.int64)
        good = (score > 0) & (score >= np.rint(last[group[s]] * 1e6))  # the others have k chunks before them
        s, c, score = s[good], c[good], score[good]
        kept = leading(s, c, score, k)
        yield s[kept], c[kept], score[kept] / 1e6


def bm25_sets(queries: DataFrame, weighted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, _asked), and (_asked, known: the terms in the index with the number of chunks that hold them) once for all queries of the same terms."""
    digest = F.md5(F.array_join("tokens", " "))  # terms have no spaces
    words = queries.filter("query_id is not null").select(F.col("query_id").cast("string").alias("query_id"), F.array_distinct(terms(F.col("text"))).alias("tokens")).filter(F.size("tokens") > 0)
    words = words.groupBy("query_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tokens")))).alias("tokens")).select("query_id", "tokens", digest.alias("_asked"))
    words = cut(words)  # read for the sets and for their askers
    asked = words.dropDuplicates(["_asked"]).select("_asked", F.explode("tokens").alias("token"))
    known = asked.join(document_frequency(weighted), "token").groupBy("_asked").agg(F.array_sort(F.collect_list(F.struct("token", "df"))).alias("known"))  # a query's own terms
    return words.select("query_id", "_asked"), cut(known)


def common_limit(sets: DataFrame, n_chunks: int) -> float:
    """The number of chunks beyond which a term is common: that of COMMON_SHARES at which the search costs least."""
    limits = [s * n_chunks for s in COMMON_SHARES]

    def pairs(m: float) -> Column:
        return F.coalesce(F.sum(F.aggregate("known", F.lit(0).cast("long"), lambda a, x: a + F.when(x["df"] <= m, x["df"]).otherwise(0))), F.lit(0))

    def groups(m: float) -> Column:
        return F.approx_count_distinct(F.array_join(F.transform(F.filter("known", lambda x: x["df"] > m), lambda x: x["token"]), " "))

    got = sets.agg(*[(PAIR_COST * pairs(m) + CELL_COST * n_chunks * groups(m)).alias(str(i)) for i, m in enumerate(limits)]).head()
    return limits[int(np.argmin(got))]


def bm25_indexed(queries: DataFrame, weighted: DataFrame, k: int = TOP) -> DataFrame:
    """As bm25, over an index built before. Each set of terms is searched once, however many queries ask for it.

    Postings are matched with the asked terms by an equi-join, so that the others go nowhere, and packed per chunk; blocks of
    chunks meet blocks of sets. A join of the terms themselves would yield a row for every query and chunk with a common term,
    most of them from frequent terms: those are searched once for all sets that have the same of them, see _product.
    """
    if k < 1:
        raise ValueError("top_k must be at least 1")
    words, known = bm25_sets(queries, weighted)
    size = weighted.agg(F.approx_count_distinct("chunk_id")).head()[0]
    limit = common_limit(known, size)
    part = lambda keep: F.transform(F.filter("known", keep), lambda x: x["token"])
    key = lambda mark, c: F.concat(F.lit(mark), F.md5(F.array_join(c, " ")))
    sets = known.select("_asked", key("s", part(lambda x: x["df"] > 0)).alias("_set"), part(lambda x: x["df"] > limit).alias("common"), part(lambda x: x["df"] <= limit).alias("rare"))
    once = sets.withColumn("query_id", key("c", F.col("common"))).dropDuplicates(["_set"])
    wanted = small_or_plain(known.select(F.explode("known.token").alias("token")).distinct())
    packed = weighted.join(wanted, "token", "left_semi").groupBy("chunk_id", "source_path").agg(F.collect_list(F.struct("token", "weight")).alias("posted"))  # a chunk's own terms
    n_q, n_c = block_counts(weighted, once.count(), size, BM25_QUERIES, BM25_CHUNKS)
    blocks = in_blocks(once.select("query_id", "_set", "common", "rare"), packed, n_q, n_c, lambda rows, qs: _product(rows, qs, k), "key string, chunk_id string, source_path string, score double")
    keys = once.select("_set", F.explode(F.array("_set", "query_id")).alias("key"))
    found = top_k(blocks, k, "key").join(keys, "key").groupBy("_set", "chunk_id").agg(F.max("score").alias("score"), F.min("source_path").alias("source_path"))
    asking = words.join(sets.select("_asked", "_set"), "_asked").select("query_id", "_set")
    return top_k(found, k, "_set").join(asking, "_set").select("query_id", "chunk_id", "source_path", "score", "rank")


def bm25_scores_within(queries: DataFrame, weighted: DataFrame, scope: DataFrame) -> DataFrame:
    """Scores of the chunks of each query's own few documents, scope(query_id, source_path): one equi-join."""
    asked = query_terms(queries).join(scope, "query_id")
    return asked.join(weighted, ["source_path", "token"]).groupBy("query_id", "chunk_id", "source_path").agg(F.round(F.sum("weight"), 6).alias("score"))


def bm25(queries: DataFrame, chunks: DataFrame, k: int = TOP, k1: float = K1, b: float = B, keep: Column | None = None) -> DataFrame:
    """The k best chunks per query. ``keep`` (a condition on the chunk table) restricts results, never the statistics."""
    if k < 1:
        raise ValueError("top_k must be at least 1")
    weighted = build_index(chunks, k1, b)
    if keep is not None:
        weighted = weighted.join(chunks.filter(keep).select("chunk_id"), "chunk_id", "left_semi")
    return bm25_indexed(queries, weighted, k)


def build_index(chunks: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """The weighted postings as a table in the shared folder: made once, read by every search."""
    return cut(weighted_postings(chunks, k1, b))


# vectors -----------------------------------------------------------------------------------------------------------
def _similar(rows: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The k nearest rows of a block per query."""

    def unit(t: pa.Table) -> np.ndarray:
        v = t["embedding"].combine_chunks()
        m = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    rows = rows.sort_by("chunk_id")
    found = []
    if rows.num_rows and queries.num_rows:
        c, q = unit(rows), unit(queries)
        step = max(1, BATCH_CELLS // 8 // len(c))
        for lo in range(0, len(q), step):
            r, at, score = best_cells(q[lo : lo + step] @ c.T, k)
            found.append((r + lo, at, score))
    r, at, score = (np.concatenate([x[i] for x in found]) if found else np.array([], t) for i, t in enumerate((np.int64, np.int64, np.float64)))
    kept = rows.select(["chunk_id"] + [x for x in ("source_path",) if x in rows.column_names]).take(pa.array(at))
    return pa.table({"query_id": queries["query_id"].take(pa.array(r)), **{x: kept[x] for x in kept.column_names}, "score": pa.array(score + 0.0)})


def nearest(queries: DataFrame, vectors: DataFrame, k: int = TOP, keep: Column | None = None) -> DataFrame:
    """Exhaustive cosine search, exact, in blocks: every block of queries meets every block of vectors once.

    queries(query_id, embedding), vectors(chunk_id, embedding and, if it shall be carried along, source_path). A pair of blocks
    is one matrix product, of which the k best per query leave the task; these are merged per query. A vector that several queries
    have is searched once. Rows without a vector take no part; a vector of length 0 has similarity 0.
    """
    if k < 1:
        raise ValueError("top_k must be at least 1")
    v = vectors.filter(keep) if keep is not None else vectors
    carried = [c for c in ("source_path",) if c in v.columns]
    v = v.filter("chunk_id is not null and embedding is not null").select(F.col("chunk_id").cast("string").alias("chunk_id"), *carried, F.col("embedding").cast("array<float>").alias("embedding"))
    q = queries.filter("query_id is not null and embedding is not null").select(F.col("query_id").cast("string").alias("query_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    q = cut(q.withColumn("_same", F.md5(F.col("embedding").cast("string"))))  # embedded once for the search and for its askers
    once = q.dropDuplicates(["_same"]).select(F.col("_same").alias("query_id"), "embedding")
    n_q, n_c = block_counts(v, once.count(), v.count(), QUERY_BLOCK, VECTOR_BLOCK)
    schema = "query_id string, chunk_id string" + "".join(f", {c} string" for c in carried) + ", score double"
    found = top_k(in_blocks(once, v, n_q, n_c, lambda rows, qs: _similar(rows, qs, k), schema), k).withColumnRenamed("query_id", "_same")
    found = found.join(q.select("query_id", "_same"), "_same").select("query_id", "chunk_id", *carried, "score", "rank")
    rows, queries_asked = q.agg(F.count("query_id"), F.count_distinct("query_id")).head()
    return found if rows == queries_asked else top_k(found.drop("rank"), k)  # several vectors of one query


# combinations --------------------------------------------------------------------------------------------------------
def rrf(lists: list[DataFrame], k: int = TOP, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists; the payload is that of the first list that holds the chunk."""
    if rrf_k < 0:
        raise ValueError("rrf_k must be at least 0")
    tagged = [x.select("query_id", "chunk_id", "source_path", "rank", F.lit(i).alias("list_no")) for i, x in enumerate(lists)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    return rrf_tagged(every, k, rrf_k)


def rrf_tagged(every: DataFrame, k: int = TOP, rrf_k: int = RRF_K) -> DataFrame:
    """As rrf, for lists that are one table with list_no."""
    fused = every.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(1 / (rrf_k + F.col("rank"))), 6).alias("score"), F.min_by("source_path", "list_no").alias("source_path")
    )
    return top_k(fused, k)


def hybrid(queries: DataFrame, chunks: DataFrame, embed, k: int = TOP, candidate_k: int = CANDIDATES) -> DataFrame:
    """The semantic and the BM25 list of every query, fused."""
    if k > candidate_k:
        raise ValueError("top_k cannot exceed candidate_k")
    chunks = cut(chunks.select("chunk_id", "source_path", "text"))  # read by both retrievers
    return hybrid_indexed(queries, chunks.select("chunk_id", "source_path", embed(F.col("text")).alias("embedding")), build_index(chunks), embed, k, candidate_k)


def hybrid_indexed(queries: DataFrame, vectors: DataFrame, weighted: DataFrame, embed, k: int = TOP, candidate_k: int = CANDIDATES) -> DataFrame:
    """As hybrid, over vectors(chunk_id, source_path, embedding) and an index made before."""
    if k > candidate_k:
        raise ValueError("top_k cannot exceed candidate_k")
    found = nearest(queries.select("query_id", embed(F.col("text")).alias("embedding")), vectors, candidate_k)
    return rrf([found, bm25_indexed(queries, weighted, candidate_k)], k).select("query_id", "rank", "chunk_id", "source_path", "score")


def rerank(candidates: DataFrame, queries: DataFrame, chunks: DataFrame, k: int = TOP, score=overlap_score) -> DataFrame:
    """Candidates scored again by a model that sees question and text, best k."""
    pairs = candidates.select("query_id", "chunk_id", "source_path").join(queries.select("query_id", F.col("text").alias("_q")), "query_id")
    pairs = pairs.join(chunks.select("chunk_id", F.col("text").alias("_c")), "chunk_id")
    return top_k(pairs.select("query_id", "chunk_id", "source_path", F.round(score(F.col("_q"), F.col("_c")), 6).alias("score")), k)


def leading_sources(ranked: DataFrame, n: int) -> DataFrame:
    """query_id, source_path of the n documents behind the best chunks, in rank order."""
    if n < 1:
        raise ValueError("document_k must be at least 1")
    first = ranked.filter("source_path is not null").groupBy("query_id", "source_path").agg(F.min("rank").alias("first"))
    w = Window.partitionBy("query_id").orderBy("first")
    return first.withColumn("source_rank", F.row_number().over(w)).filter(F.col("source_rank") <= n)


def scoped(first: DataFrame, queries: DataFrame, weighted: DataFrame, document_k: int = 3, k: int = TOP) -> DataFrame:
    """A second pass inside the leading documents of the first (a list of candidates); queries whose second pass is empty keep the first."""
    first = cut(first.select("query_id", "chunk_id", "source_path", "score", "rank"))  # names the documents, and is kept where they give nothing
    second = top_k(bm25_scores_within(queries, weighted, leading_sources(first, document_k).select("query_id", "source_path")), k)
    second = second.select("query_id", "chunk_id", "source_path", "score", "rank")
    kept = first.filter(F.col("rank") <= k).join(second.select("query_id").distinct(), "query_id", "left_anti")
    return second.unionByName(kept.select(*second.columns))


def scoped_hybrid(first: DataFrame, queries: DataFrame, chunks: DataFrame, embed, k: int = TOP, candidate_k: int = CANDIDATES, document_k: int = 3) -> DataFrame:
    """The same with both retrievers in the second pass. A query meets only the chunks of its few documents."""
    scope = leading_sources(first, document_k).select("query_id", "source_path")
    inside = scope.join(chunks.select("source_path", "chunk_id", embed(F.col("text")).alias("_c")), "source_path")
    inside = inside.join(queries.select("query_id", embed(F.col("text")).alias("_q")), "query_id")
    semantic = top_k(inside.select("query_id", "chunk_id", "source_path", F.round(cosine(F.col("_q"), F.col("_c")), 6).alias("score")), candidate_k)
    scores = bm25_scores_within(queries, build_index(chunks), scope)
    second = rrf([semantic, top_k(scores, candidate_k)], k).select("query_id", "chunk_id", "source_path", "score", "rank")
    kept = first.filter(F.col("rank") <= k).join(second.select("query_id").distinct(), "query_id", "left_anti")
    return second.unionByName(kept.select(*second.columns))


def neighbours(ranked: DataFrame, chunks: DataFrame, window: int = 1, source_k: int | None = None) -> DataFrame:
    """The ranked chunks followed by their unranked neighbours in the document, by rank of origin, then offset."""
    if window < 1:
        raise ValueError("neighbor_window must be at least 1")
    place = chunks.select("chunk_id", "source_path", "chunk_index")
    was = F.col("expanded_from") if "expanded_from" in ranked.columns else F.lit(None).cast("string")
    r = ranked.select("query_id", "rank", "chunk_id", "score", F.col("source_path").alias("_path"), was.alias("_from")).join(place, "chunk_id", "left")
    r = r.withColumn("source_path", F.coalesce("source_path", "_path"))  # whole documents have no place and no neighbours
    origin = r if source_k is None else r.filter(F.col("rank") <= source_k)
    steps = F.explode(F.array(*[F.lit(i) for i in range(-window, window + 1) if i]))
    wanted = origin.select("query_id", F.col("rank").alias("from_rank"), F.col("chunk_id").alias("expanded_from"), "score", "source_path", "chunk_index", steps.alias("offset"))
    wanted = wanted.withColumn("chunk_index", F.col("chunk_index") + F.col("offset")).join(place, ["source_path", "chunk_index"])
    fresh = wanted.join(ranked.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    once = fresh.withColumn("_k", F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("from_rank", "offset"))).filter("_k = 1")
    base = r.select("query_id", "chunk_id", "source_path", "score", F.lit(0).alias("part"), F.col("rank").alias("a"), F.lit(0).alias("b"), F.col("_from").alias("expanded_from"))
    more = once.select("query_id", "chunk_id", "source_path", "score", F.lit(1).alias("part"), F.col("from_rank").alias("a"), F.col("offset").alias("b"), "expanded_from")
    w = Window.partitionBy("query_id").orderBy("part", "a", "b")
    return base.unionByName(more).withColumn("rank", F.row_number().over(w)).drop("part", "a", "b")


def parents(ranked: DataFrame, documents: DataFrame, max_characters: int | None = None) -> DataFrame:
    """Chunks replaced by their whole document, once each; those of oversized or unknown documents stay as they are."""
    d = documents.select("source_path", F.length("content").alias("_n"))
    r = ranked.select("query_id", "rank", "chunk_id", "source_path", "score").join(d, "source_path", "left")
    fits = F.col("_n").isNotNull() if max_characters is None else F.coalesce(F.col("_n") <= max_characters, F.lit(False))
    r = r.withColumn("whole", fits)
    w = Window.partitionBy("query_id", "source_path", "whole").orderBy("rank")
    kept = r.withColumn("_k", F.row_number().over(w)).filter(~F.col("whole") | (F.col("_k") == 1))
    again = Window.partitionBy("query_id").orderBy("rank")
    return kept.select(
        "query_id", F.row_number().over(again).alias("rank"), F.when(F.col("whole"), F.col("source_path")).otherwise(F.col("chunk_id")).alias("chunk_id"),
        "source_path", "score", F.when(F.col("whole"), F.col("chunk_id")).alias("expanded_from"),
    )


def with_parent_text(ranked: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """The result of ``parents`` with the text of each row: the document's where it stands for the whole document, else the chunk's."""
    d = documents.select("source_path", F.col("content").alias("_d"))
    c = chunks.select("chunk_id", F.col("text").alias("_c"))
    whole = F.col("expanded_from").isNotNull() & (F.col("chunk_id") == F.col("source_path"))
    return ranked.join(d, "source_path", "left").join(c, "chunk_id", "left").withColumn("text", F.when(whole, F.col("_d")).otherwise(F.col("_c"))).drop("_d", "_c")


def parse_subqueries(responses: DataFrame, limit: int = 3) -> DataFrame:
    """query_id, sub_no, text: the usable lines of a model's response(query_id, question, response).

    List marks and quotes are taken off; the question itself, repetitions in any letter case and code fences are left out.
    """
    if limit < 1:
        raise ValueError("max_subqueries must be at least 1")
    white = r"(?U)^\s+|\s+$"
    lines = F.split("response", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]", -1)
    line = F.regexp_replace(F.regexp_replace(F.col("line"), white, ""), r"(?U)^(?:[-*]|\d+[.)])\s*", "")
    t = responses.select("query_id", "question", F.posexplode(lines).alias("pos", "line"))
    t = t.select("query_id", "pos", F.lower(F.regexp_replace(F.coalesce("question", F.lit("")), white, "")).alias("q"), F.regexp_replace(line, "^[` \\t\"']+|[` \\t\"']+$", "").alias("text"))
    t = t.filter((F.col("text") != "") & (F.lower("text") != F.col("q"))).withColumn("low", F.lower("text"))
    first = t.withColumn("_k", F.row_number().over(Window.partitionBy("query_id", "low").orderBy("pos"))).filter("_k = 1")
    w = Window.partitionBy("query_id").orderBy("pos")
    return first.withColumn("sub_no", F.row_number().over(w)).filter(F.col("sub_no") <= limit).select("query_id", "sub_no", "text")


def with_subqueries(questions: DataFrame, subqueries: DataFrame) -> DataFrame:
    """(question_id, list_no, text, query_id): the question as list 0 and its distinct sub-queries; query_id is unique."""
    every = questions.select(F.col("query_id").alias("question_id"), F.lit(0).alias("list_no"), "text").unionByName(
        subqueries.select(F.col("query_id").alias("question_id"), F.col("sub_no").alias("list_no"), "text")
    )
    first = Window.partitionBy("question_id", "text").orderBy("list_no")
    every = every.withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k")
    return every.withColumn("query_id", F.concat_ws("#", "question_id", F.col("list_no").cast("string")))


def lists_of(every: DataFrame, ranked: DataFrame) -> DataFrame:
    """Ranked lists of all queries, tagged with the question and the number of the list."""
    tags = every.select("query_id", "question_id", "list_no")
    return ranked.join(tags, "query_id").select(F.col("question_id").alias("query_id"), "list_no", "chunk_id", "source_path", "rank", "score")


def lists_of_texts(every: DataFrame, rank: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """As lists_of, of every text's list, which is made once: questions share most of their sub-queries."""
    every = cut(every)  # read for the texts, by both retrievers, and for their lists
    first = every.groupBy("text").agg(F.min("query_id").alias("first"))
    ranked = rank(first.select(F.col("first").alias("query_id"), "text"))
    return lists_of(every.join(first, "text").select(F.col("first").alias("query_id"), "question_id", "list_no"), ranked)


def with_coverage(tagged: DataFrame, fused: DataFrame, per_query: int, k: int = TOP) -> DataFrame:
    """Evidence reserved for each sub-query, then filled up from the fused list.

    Each choice depends on those before it, so a question's candidates (at most lists times candidate_k) are folded in
    order. Reserved rows keep their retriever's score, filled ones that of the fusion.
    """
    if per_query < 0:
        raise ValueError("coverage_per_query must be at least 0")
    if per_query == 0:
        return fused
    subs = tagged.filter("list_no > 0").select("query_id", F.col("list_no").alias("l"), F.col("rank").alias("r"), "chunk_id", "source_path", "score")
    fill = fused.select("query_id", F.lit(1_000_000).alias("l"), F.col("rank").alias("r"), "chunk_id", "source_path", "score")
    rows = subs.unionByName(fill).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("l", "r", "chunk_id", "source_path", "score"))).alias("rows"))
    pick = "array<struct<chunk_id:string,source_path:string,score:double>>"
    start = F.struct(F.array().cast(pick).alias("got"), F.lit(-1).alias("l"), F.lit(0).alias("n"))

    def add(acc: Column, x: Column) -> Column:
        n = F.when(acc["l"] == x["l"], acc["n"]).otherwise(0)
        room = (F.size(acc["got"]) < k) & ((x["l"] == 1_000_000) | (n < per_query))
        take = room & ~F.exists(acc["got"], lambda g: g["chunk_id"] == x["chunk_id"])
        more = F.concat(acc["got"], F.array(F.struct(x["chunk_id"].alias("chunk_id"), x["source_path"].alias("source_path"), x["score"].alias("score"))))
        return F.struct(F.when(take, more).otherwise(acc["got"]).alias("got"), x["l"].alias("l"), (n + take.cast("int")).alias("n"))

    folded = rows.select("query_id", F.aggregate("rows", start, add, lambda a: a["got"]).alias("got"))
    return folded.select("query_id", F.posexplode("got").alias("pos", "g")).select("query_id", (F.col("pos") + 1).alias("rank"), "g.chunk_id", "g.source_path", "g.score")


def multi_hop(questions: DataFrame, followups: DataFrame, rank, k: int = TOP, candidate_k: int = CANDIDATES) -> DataFrame:
    """Fusion of the question's list and its follow-up's; a question without a usable follow-up keeps its first list.

    followups(query_id, text); ``rank`` maps queries(query_id, text) and k to a ranked list. A follow-up equal to the question in
    any letter case is none.
    """
    f = followups.alias("f").join(questions.alias("q"), "query_id").filter("f.text is not null and lower(trim(f.text)) <> lower(trim(q.text)) and trim(f.text) <> ''")
    f = f.select("query_id", F.col("f.text").alias("text"))
    every = with_subqueries(questions, f.withColumn("sub_no", F.lit(1)))
    tagged = cut(lists_of(every, rank(every.select("query_id", "text"), candidate_k)))  # read for the fused and for the single lists
    fused = rrf_tagged(tagged, k)
    alone = tagged.join(f.select("query_id"), "query_id", "left_anti").filter(F.col("rank") <= k)
    both = fused.join(f.select("query_id"), "query_id", "left_semi")
    return both.select("query_id", "rank", "chunk_id", "source_path", "score").unionByName(alone.select("query_id", "rank", "chunk_id", "source_path", "score"))


def followups_from(first: DataFrame, questions: DataFrame, chunks: DataFrame, generate: Callable[[Column, Column], Column], evidence_k: int = 5) -> DataFrame:
    """query_id, text: what a model would ask next, from each question's best evidence_k passages of the first pass.

    ``generate`` maps question and evidence to a response, of which the first usable line is taken; questions without one, or
    for which it is the question itself, have no row.
    """
    if evidence_k < 1:
        raise ValueError("evidence_k must be at least 1")
    best = first.filter(F.col("rank") <= evidence_k).select("query_id", "rank", "chunk_id").join(chunks.select("chunk_id", "text"), "chunk_id")
    # fixed value: how a passage is labelled as evidence
    part = F.concat(F.lit("[Evidence "), F.col("rank").cast("string"), F.lit("]\n"), F.coalesce("text", F.lit("")))
    evidence = best.groupBy("query_id").agg(ordered_text(F.col("rank"), part).alias("evidence"))  # evidence_k passages
    asked = evidence.join(questions.select("query_id", F.col("text").alias("question")), "query_id")
    said = asked.select("query_id", "question", generate(F.col("question"), F.col("evidence")).alias("response")).filter("response is not null")
    return parse_subqueries(said, 1).select("query_id", "text")


def multi_hop_from_evidence(questions: DataFrame, chunks: DataFrame, rank, generate: Callable[[Column, Column], Column], k: int = TOP, candidate_k: int = CANDIDATES, evidence_k: int = 5) -> DataFrame:
    """multi_hop whose follow-ups are made from the first pass; that pass is run once."""
    if k > candidate_k:
        raise ValueError("top_k cannot exceed candidate_k")
    columns = ("query_id", "rank", "chunk_id", "source_path", "score")
    first = cut(rank(questions, candidate_k).select(*columns))  # evidence, first list of the fusion, and kept where nothing follows
    f = cut(followups_from(first, questions, chunks, generate, evidence_k))
    second = rank(f, candidate_k).select(*columns)
    fused = rrf([first.join(f.select("query_id"), "query_id", "left_semi"), second], k).select(*columns)
    return fused.unionByName(first.filter(F.col("rank") <= k).join(f.select("query_id"), "query_id", "left_anti"))


#: The retrieval strategies by name: which stages run, in this order.
STRATEGIES = {
    "keyword": ("keyword",),
    "semantic": ("semantic",),
    "hybrid": ("hybrid",),
    "hybrid-reranked": ("hybrid", "rerank"),
    "scoped": ("hybrid", "scoped"),
    "reranked": ("hybrid", "rerank"),
    "parent": ("hybrid", "parent"),
    "neighbor": ("hybrid", "neighbor"),
}
#: Those that need a table of sub-queries or follow-ups.
TABLE_STRATEGIES = {
    "hybrid-decomposed": ("hybrid", "decompose"),
    "hybrid-decomposed-multihop": ("hybrid", "decompose", "multihop"),
    "hybrid-decomposed-reranked": ("hybrid", "decompose", "rerank"),
}
FIRST, STAGES = ("keyword", "semantic", "hybrid"), ("decompose", "multihop", "scoped", "rerank", "parent", "neighbor")
#: What a question's follow-up has behind the question's id; its own sub-queries stand under that id.
FOLLOWUP = "#followup"
BATCH = ("query_id", "rank", "chunk_id", "source_path", "score")


def stages_of(strategy: str | tuple[str, ...]) -> tuple[str, ...]:
    """The stages of a name, or those given: one of FIRST, then any of STAGES in their order."""
    if isinstance(strategy, str):
        named = STRATEGIES | TABLE_STRATEGIES
        if strategy not in named:
            raise ValueError(f"unknown strategy {strategy}; one of {', '.join(named)}")
        return named[strategy]
    stages = tuple(strategy)
    if not stages or stages[0] not in FIRST or list(stages[1:]) != [s for s in STAGES if s in stages[1:]]:
        raise ValueError(f"stages {stages}: one of {', '.join(FIRST)}, then any of {', '.join(STAGES)} in this order")
    return stages


def retrieve(
    strategy: str | tuple[str, ...], queries: DataFrame, chunks: DataFrame, documents: DataFrame, embed, k: int = TOP, candidate_k: int = CANDIDATES, *,
    subqueries: DataFrame | None = None, followups: DataFrame | None = None, coverage_per_query: int = 0, document_k: int = 3, score=overlap_score,
    max_characters: int | None = None, window: int = 1, source_k: int | None = None, keep: Column | None = None,
) -> DataFrame:
    """A strategy, by name or as its stages, over questions(query_id, text) and one chunk table. ``embed`` maps a text column to vectors.

    subqueries(query_id, sub_no, text) and followups(query_id, text) are what models made of the questions. Every stage wraps
    the ones before it: a second pass, be it of a follow-up or inside the leading documents, runs through all of them again.
    ``keep`` (a condition on the chunk table) restricts the results of every retriever in every pass, never the statistics.
    """
    stages = stages_of(strategy)
    if k > candidate_k:
        raise ValueError("top_k cannot exceed candidate_k")
    for stage, given in (("decompose", subqueries), ("multihop", followups)):
        if stage in stages and given is None:
            raise ValueError(f"{stage} needs its table of {'subqueries' if stage == 'decompose' else 'followups'}")
    chunks = cut(chunks)  # read by every stage
    searched = chunks if keep is None else chunks.filter(keep)
    made: list[DataFrame] = []

    def index() -> DataFrame:
        if not made:
            whole = build_index(chunks)
            made.append(whole if keep is None else whole.join(searched.select("chunk_id"), "chunk_id", "left_semi"))
        return made[0]

    def keyword(q: DataFrame, n: int, scope: DataFrame | None) -> DataFrame:
        return bm25_indexed(q, index(), n) if scope is None else top_k(bm25_scores_within(q, index(), scope), n)

    def semantic(q: DataFrame, n: int, scope: DataFrame | None) -> DataFrame:
        vectors = searched.select("chunk_id", "source_path", embed(F.col("text")).alias("embedding"))
        asked = q.select("query_id", embed(F.col("text")).alias("embedding"))
        if scope is None:
            return nearest(asked, vectors, n)
        inside = scope.join(vectors.withColumnRenamed("embedding", "_c"), "source_path").join(asked.withColumnRenamed("embedding", "_q"), "query_id")
        return top_k(inside.select("query_id", "chunk_id", "source_path", F.round(cosine(F.col("_q"), F.col("_c")), 6).alias("score")), n)

    def both(q: DataFrame, n: int, scope: DataFrame | None) -> DataFrame:
        return rrf([semantic(q, candidate_k, scope), keyword(q, candidate_k, scope)], n)

    def decomposed(before):
        def run(q: DataFrame, n: int, scope: DataFrame | None) -> DataFrame:
            every = with_subqueries(q, subqueries.join(q.select("query_id"), "query_id", "left_semi"))
            ids = every.select(F.col("question_id"), F.col("query_id").alias("_id"))
            inner = scope if scope is None else scope.join(ids, F.col("query_id") == F.col("question_id")).select(F.col("_id").alias("query_id"), "source_path")
            tagged = cut(lists_of(every, before(every.select("query_id", "text"), candidate_k, inner)))  # read by the fusion and the coverage
            fused = rrf_tagged(tagged, n)
            if coverage_per_query == 0:
                return fused
            none = fused.join(tagged.filter("list_no > 0").select("query_id"), "query_id", "left_anti").select(*BATCH)
            return with_coverage(tagged.join(none.select("query_id"), "query_id", "left_anti"), fused.join(none.select("query_id"), "query_id", "left_anti"), coverage_per_query, n).select(*BATCH).unionByName(none)

        return run

    def hopped(before):
        def run(q: DataFrame, n: int, scope: DataFrame | None) -> DataFrame:
            low = lambda c: F.lower(F.trim(c))
            asked = q.select("query_id", low(F.col("text")).alias("low"))
            if "decompose" in stages:
                asked = asked.unionByName(subqueries.select("query_id", low(F.col("text")).alias("low")))
            f = followups.filter("text is not null and trim(text) <> ''").join(q.select("query_id"), "query_id", "left_semi").select("query_id", "text", low(F.col("text")).alias("low"))
            f = f.join(asked, ["query_id", "low"], "left_anti").select("query_id", "text")
            hop = lambda df: df.withColumn("query_id", F.concat("query_id", F.lit(FOLLOWUP)))
            first = cut(before(q, candidate_k, scope).select(*BATCH))  # fused, and kept where there is no follow-up
            second = before(hop(f), candidate_k, scope if scope is None else hop(scope)).select(*BATCH)
            second = second.withColumn("query_id", F.expr(f"left(query_id, length(query_id) - {len(FOLLOWUP)})"))
            fused = rrf([first.join(f.select("query_id"), "query_id", "left_semi"), second], n).select(*BATCH)
            return fused.unionByName(first.filter(F.col("rank") <= n).join(f.select("query_id"), "query_id", "left_anti").select(*BATCH))

        return run

    def narrowed(before):
        def run(q: DataFrame, n: int, scope: DataFrame | None) -> DataFrame:
            first = cut(before(q, candidate_k, scope).select(*BATCH))  # names the documents, and is kept where they give nothing
            second = cut(before(q, n, leading_sources(first, document_k).select("query_id", "source_path")).select(*BATCH))
            kept = first.filter(F.col("rank") <= n).join(second.select("query_id").distinct(), "query_id", "left_anti")
            return second.unionByName(kept.select(*BATCH))

        return run

    wraps = {
        "decompose": decomposed, "multihop": hopped, "scoped": narrowed,
        "rerank": lambda before: lambda q, n, scope: rerank(before(q, candidate_k, scope), q, chunks, n, score),
        "parent": lambda before: lambda q, n, scope: parents(before(q, n, scope), documents, max_characters),
        "neighbor": lambda before: lambda q, n, scope: neighbours(before(q, n, scope), chunks, window, source_k),
    }
    run = {"keyword": keyword, "semantic": semantic, "hybrid": both}[stages[0]]
    for stage in stages[1:]:
        run = wraps[stage](run)
    return run(queries, k, None)
