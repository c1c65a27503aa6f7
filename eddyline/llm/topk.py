"""Exact top-k inner products by a three-phase uniform threshold.

Vectors are split by dimensions over ``NODES`` nodes; a node knows only its
part of each score.  For every query:

1. each node gives its local top list; the totals of the listed vectors yield
   tau, a score that k vectors are known to reach;
2. the safe cutoff tau / NODES goes to every node with the query, and each
   node sends all its entries at or above it.  A vector that no node sends
   stays below tau in total;
3. sent entries are summed; vectors whose upper bound (cutoff less one for
   each node that did not send them) misses tau are dropped, and the scores
   still incomplete are resolved from the vectors themselves.

Equal vectors are searched once, as a class that keeps its k + 1 smallest ids
(one may be the query's own), so groups of copies add no entries.  Queries go
against vectors in blocks: a block of queries meets a chunk of vectors in one
task, as a matrix product whose numbers are exact integers.  Cutoffs travel
inside the query blocks, not as one driver-side table.

Defined cases: vectors that are null, or hold null or non-finite components,
take no part; missing trailing dimensions count as 0; null ids are never
queries and come last among ties; rows that repeat an id are rows of their
own; fewer candidates than k give fewer rows; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from eddyline.llm.common import load_table, prepare, stored

NODES = 2
CHUNK = 4096         # vectors in a chunk
BLOCK = 512          # queries in a block
TOGETHER = 16        # blocks that meet a chunk in one task


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """``(id, v array<bigint>)`` of the rows that take part."""
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ints = F.transform(vec_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return df.filter(F.col(vec_col).isNotNull() & ~bad).select(F.col(id_col).alias("id"), ints.alias("v"))


def _classes(vectors: DataFrame, k: int) -> DataFrame:
    """``(cid, v, ids)``: distinct vectors with their k + 1 smallest ids."""
    rank = F.row_number().over(W.partitionBy("v").orderBy(F.col("id").asc_nulls_last()))
    few = vectors.withColumn("r", rank).filter(F.col("r") <= k + 1)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"])
    return few.groupBy("v").agg(ids.alias("ids")).withColumn("cid", F.monotonically_increasing_id())


def _packed(rows: DataFrame, size: int, count: int, dims: int, nodes: int) -> DataFrame:
    """Rows ``(cid, v[, cut])`` as matrices: ``(part, node, cids, mat, cuts)``,
    about ``size`` rows in a part."""
    width = -(-dims // nodes) if dims else 1
    parts = max(1, -(-count // size))
    has_cut = "cut" in rows.columns

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        mat = np.zeros((len(pdf), width * nodes))
        for i, v in enumerate(pdf["v"]):
            mat[i, :len(v)] = v
        cuts = pdf["cut"].to_numpy(np.int64) if has_cut else np.zeros(len(pdf), np.int64)
        return pd.DataFrame([{"part": int(pdf["part"].iloc[0]), "node": n,
                              "cids": pdf["cid"].to_numpy(np.int64).tobytes(),
                              "mat": np.ascontiguousarray(mat[:, n * width:(n + 1) * width]).tobytes(),
                              "cuts": cuts.tobytes()} for n in range(nodes)])

    return (rows.withColumn("part", F.pmod(F.xxhash64("cid"), F.lit(parts)).cast("int"))
            .groupBy("part").applyInPandas(pack, "part int, node int, cids binary, mat binary, cuts binary"))


def _local(row, chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of queries and vectors, and the node's exact scores."""
    cids, qids = np.frombuffer(chunk.cids, np.int64), np.frombuffer(row.qids, np.int64)
    a = np.frombuffer(row.qmat).reshape(len(qids), -1)
    b = np.frombuffer(chunk.mat).reshape(len(cids), -1)
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 2 ** 53:
        return qids, cids, (a @ b.T).astype(np.int64)
    return qids, cids, a.astype(np.int64) @ b.T.astype(np.int64)


ENTRY = "qid long, cid long, node int, part_score long"


def _entries(chunks: DataFrame, n_chunks: int, blocks: DataFrame, n_blocks: int, pick) -> DataFrame:
    """Every block of queries beside every chunk, node by node: one task holds
    a chunk and up to ``TOGETHER`` blocks, cogrouped, so matrices cross the
    network once and are never joined row by row."""
    groups = -(-n_blocks // TOGETHER)
    asked = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))).alias("chunk"), "node",
                          F.floor(F.col("part") / F.lit(TOGETHER)).cast("int").alias("several"),
                          F.col("cids").alias("qids"), F.col("mat").alias("qmat"), "cuts")
    held = chunks.select(F.col("part").alias("chunk"), "node",
                         F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("several"), "cids", "mat")
    key = ["chunk", "node", "several"]

    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"qid": [], "cid": [], "node": [], "part_score": []}).astype("int64")]
        for chunk in c.itertuples():
            for row in q.itertuples():
                qids, cids, s = _local(row, chunk)
                i, j = pick(row, s)
                out.append(pd.DataFrame({"qid": qids[i], "cid": cids[j], "node": row.node, "part_score": s[i, j]}))
        return pd.concat(out)

    return asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(run, ENTRY)


def _dot(a: str, b: str) -> Column:
    both = F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0).cast("long")))
    return F.aggregate(both, F.lit(0).cast("long"), lambda s, x: s + x)


def _top(rows: DataFrame, key: str, score: str, tie: str, k: int) -> DataFrame:
    order = W.partitionBy(key).orderBy(F.col(score).desc(), F.col(tie))
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def exact_topk(df: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding",
               k: int = 5, scale: int = 256, nodes: int = NODES) -> DataFrame:
    """``(query_id, rank, id, score)``: for each query row the k other rows
    with the highest inner product, ties to the smaller id."""
    vectors = whole_vectors(df, id_col, vec_col, scale)
    classes = stored(_classes(vectors, k), "topk-classes")
    queries = stored(whole_vectors(df.filter(is_query & F.col(id_col).isNotNull()), id_col, vec_col, scale)
                     .join(classes.select("v", "cid"), "v").select("id", "cid"), "topk-queries")
    q_classes = queries.select("cid").distinct().join(classes, "cid")
    n, dims = classes.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    n_q = q_classes.count()
    chunks = stored(_packed(classes.select("cid", "v"), CHUNK, n, dims, nodes), "topk-chunks")
    n_chunks = max(1, -(-n // CHUNK))
    want = k + 1                                       # a query's own row may be among them

    # phase 1: local top lists; tau is the want-th best total among the listed
    def best(row, s):
        m = min(want, s.shape[1])
        j = np.argpartition(-s, m - 1, axis=1)[:, :m]
        return np.repeat(np.arange(len(s)), m), j.ravel()

    n_blocks = max(1, -(-n_q // BLOCK))
    lists = _entries(chunks, n_chunks, _packed(q_classes.select("cid", "v"), BLOCK, n_q, dims, nodes), n_blocks, best)
    local = (lists.withColumn("p", F.row_number().over(
        W.partitionBy("qid", "node").orderBy(F.col("part_score").desc(), "cid"))).filter(F.col("p") <= want))
    qv = classes.select(F.col("cid").alias("qid"), F.col("v").alias("qv"))
    cv = classes.select("cid", F.col("v").alias("cv"))
    total = (local.select("qid", "cid").distinct().join(cv, "cid").join(qv, "qid")
             .select("qid", "cid", _dot("qv", "cv").alias("score")))
    tau = _top(total, "qid", "score", "cid", want).groupBy("qid").agg(
        F.when(F.count(F.lit(1)) == want, F.min("score")).alias("tau"))
    m = F.lit(nodes).cast("long")
    cut = F.when(F.col("tau").isNull(), F.lit(-2 ** 62)).when(
        F.col("tau") > 0, F.expr(f"(tau + {nodes - 1}L) div {nodes}L")).otherwise(F.expr(f"tau div {nodes}L"))
    cuts = stored(tau.select("qid", "tau", cut.cast("long").alias("cut")), "topk-cutoffs")

    # phase 2: every entry at or above the cutoff
    def enough(row, s):
        return np.nonzero(s >= np.frombuffer(row.cuts, np.int64)[:, None])

    with_cut = q_classes.select("cid", "v").join(cuts.select(F.col("qid").alias("cid"), "cut"), "cid")
    sent = _entries(chunks, n_chunks, _packed(with_cut, BLOCK, n_q, dims, nodes), n_blocks, enough)
    sums = sent.groupBy("qid", "cid").agg(F.sum("part_score").alias("got"), F.count(F.lit(1)).alias("from"))
    bound = F.col("got") + (m - F.col("from")) * (F.col("cut") - 1)
    alive = stored(sums.join(cuts, "qid").filter((F.col("from") == m) | F.col("tau").isNull()
                                                 | (bound >= F.col("tau"))), "topk-alive")

    # phase 3: resolve what is incomplete
    known = alive.filter(F.col("from") == m).select("qid", "cid", F.col("got").alias("score"))
    open_ = (alive.filter(F.col("from") < m).select("qid", "cid").join(cv, "cid").join(qv, "qid")
             .select("qid", "cid", _dot("qv", "cv").alias("score")))
    # classes with a tie at the edge are ordered by their smallest id
    scored = known.union(open_).join(classes.select("cid", "ids"), "cid").withColumn("first", F.col("ids")[0])
    order = W.partitionBy("qid").orderBy(F.col("score").desc(), F.col("first").asc_nulls_last())
    per_class = scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= want)

    own = F.array_position("ids", F.col("query_id"))
    others = F.when(own > 0, F.filter("ids", lambda x, i: i != (own - 1).cast("int"))).otherwise(F.col("ids"))
    rows = (queries.select(F.col("id").alias("query_id"), F.col("cid").alias("qid"),
                           F.monotonically_increasing_id().alias("row")).join(per_class, "qid")
            .withColumn("ids", F.when(F.col("cid") == F.col("qid"), others).otherwise(F.col("ids")))
            .select("row", "query_id", "score", F.explode("ids").alias("id")))
    place = F.row_number().over(W.partitionBy("row").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last()))
    return (rows.withColumn("rank", place).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    e = load_table(spark, sf_dir, "embeddings")
    return exact_topk(e, F.col("vec_id") % 50 == 0).withColumnRenamed("id", "vec_id").select(
        "query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e,
                  row_number() OVER () AS rid
           FROM embeddings
           WHERE embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id,
             CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
