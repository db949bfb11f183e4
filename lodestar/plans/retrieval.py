"""Registered queries on retrieval and fusion, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions.text import half_up, tokens
from lodestar.operators import retrieval as R
from lodestar.operators.cells import Cells, cell_search, upsert_cells, vector_index
from lodestar.operators.tables import shared_folder
from lodestar.operators.textindex import text_index
from lodestar.plans import views as V

WORDS_SQL = "list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g'), ' '), lambda w: w <> '')"
BM25_SQL = f"""
tok as (select doc_id, {WORDS_SQL} as ws from documents),
dl as (select doc_id, len(ws) as dl from tok),
tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest(ws) as term from tok) group by 1, 2),
n as (select (select count(*) from documents) as n, (select avg(dl) from dl) as avgdl),
dfs as (select term, count(*) as df from tf group by 1),
raw as (select term, df, ln(n.n - df + 0.5e0) - ln(df + 0.5e0) as raw from dfs, n),
idf as (select term, df, case when raw < 0 then 0.25e0 * (select avg(raw) from raw) else raw end as idf from raw),
q as (select query_id, term, count(*) as qtf from (select item_id as query_id, unnest({WORDS_SQL}) as term from benchmark) group by 1, 2),
bm as (select query_id, doc_id, floor(sum(qtf * (idf * (tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))))) * 1e6 + 0.5e0) / 1e6 as score
       from q join tf using (term) join idf using (term) join dl using (doc_id), n group by 1, 2),
plain as (select query_id, doc_id, floor(sum(qtf * tf) / any_value(dl)::double * 1e6 + 0.5e0) / 1e6 as score from q join tf using (term) join dl using (doc_id) group by 1, 2)"""


def _top(name: str, k: int) -> str:
    return f"(select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from {name} qualify rank <= {k})"


def r01_tokenise_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tokens(F.col("text"))
    return V.corpus(spark, sf_dir).select("doc_id", F.size(words).cast("long").alias("n_words"), F.size(F.array_distinct(words)).cast("long").alias("n_distinct"))


def a01_idf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.idf_table(V.corpus(spark, sf_dir)).select("term", "df", half_up(F.col("idf"), 6).alias("idf"))


def r03_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bm25_search(V.benchmark_queries(spark, sf_dir), V.corpus(spark, sf_dir), 10)


def r03_bm25_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, corpus = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("text")).groupBy("text").agg(F.min("query_id").alias("query_id")), V.corpus(spark, sf_dir)
    return R.pad_with_zeros(R.bm25_search(queries, corpus, 20), queries, corpus, 20)


def _vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.vectors(spark, sf_dir).where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "v")


def r05_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50 against all vectors."""
    return R.cosine_search(_vector_queries(spark, sf_dir), V.vectors(spark, sf_dir), 10)


def r05_cells_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from an index of cells, which leaves out what is too far away."""
    return cell_search(_vector_queries(spark, sf_dir), vector_index(V.vectors(spark, sf_dir)), 10)[0]


def f10_topk_with_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = V.table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return R.without_deleted(R.cosine_search(_vector_queries(spark, sf_dir), V.vectors(spark, sf_dir), 10), gone)


def r09_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, corpus = V.benchmark_queries(spark, sf_dir), V.corpus(spark, sf_dir)
    index = text_index(corpus)
    return R.rrf([R.search_index(queries, index, 100, by) for by in ("bm25", "tf")], [1.0, 0.8])


def r06_vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of label 0 come again with reversed components; deleted ids among them are live again."""
    all_, gone = V.vectors(spark, sf_dir), V.table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    now, deleted = R.upsert_vectors(all_.select("doc_id", "v"), all_.where("label = 0").select("doc_id", F.reverse("v").alias("v")), gone)
    return now.join(deleted.withColumn("deleted", F.lit(True)), "doc_id", "left").select("doc_id", half_up(F.col("v")[0].cast("double"), 6).alias("first"), F.coalesce("deleted", F.lit(False)).alias("deleted"))


def r06_cells_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of label 0 come again with reversed components into a saved index of cells; then it is asked."""
    all_ = V.vectors(spark, sf_dir)
    path = f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}"
    vector_index(all_.select("doc_id", "v"), 8).save(path)
    upsert_cells(spark, path, all_.where("label = 0").select("doc_id", F.reverse("v").alias("v")))
    return cell_search(_vector_queries(spark, sf_dir), Cells.load(spark, path), 10)[0]


def w03_rank_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = R.bm25_search(V.benchmark_queries(spark, sf_dir), V.corpus(spark, sf_dir), 10)
    return top.select("query_id", "doc_id", (F.row_number().over(Window.partitionBy("query_id").orderBy("rank")) - 1).cast("long").alias("rank0"))


COSINE_SQL = """
e as (select vec_id, label, embedding::double[] as v, sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) as n from embeddings),
cos as (select a.vec_id as query_id, b.vec_id as doc_id, floor(list_dot_product(a.v, b.v) / (a.n * b.n) * 1e6 + 0.5e0) / 1e6 as score from e a, e b where a.vec_id % 50 = 0)"""

QUERIES = [r01_tokenise_counts, a01_idf_table, r03_bm25_topk, r03_bm25_padded, r05_cosine_topk, r05_cells_topk, f10_topk_with_tombstones, r09_rrf, r06_vector_upsert, r06_cells_upsert, w03_rank_in_list]
SQL = {
    "r01_tokenise_counts": f"select doc_id, len(ws)::bigint as n_words, len(list_distinct(ws))::bigint as n_distinct from (select doc_id, {WORDS_SQL} as ws from documents)",
    "a01_idf_table": f"with {BM25_SQL} select term, df, floor(idf * 1e6 + 0.5e0) / 1e6 as idf from idf",
    "r03_bm25_topk": f"with {BM25_SQL} select * from {_top('bm', 10)}",
    "r03_bm25_padded": f"""with {BM25_SQL.replace("select item_id as query_id, unnest(" + WORDS_SQL + ") as term from benchmark", "select query_id, unnest(" + WORDS_SQL + ") as term from (select min(p_partkey) as query_id, p_name as text from part group by p_name)")},
pq as (select min(p_partkey) as query_id from part group by p_name),
padded as (select query_id, doc_id, coalesce(score, 0) as score from pq cross join (select doc_id from documents) left join bm using (query_id, doc_id))
select * from {_top('padded', 20)}""",
    "r05_cosine_topk": f"with {COSINE_SQL} select * from {_top('cos', 10)}",
    "r05_cells_topk": f"with {COSINE_SQL} select * from {_top('cos', 10)}",
    "f10_topk_with_tombstones": f"""with {COSINE_SQL} select query_id, doc_id, score, row_number() over (partition by query_id order by rank) as rank from {_top('cos', 10)}
where doc_id not in (select doc_id from labels where toxic = 1)""",
    "r09_rrf": f"""with {BM25_SQL}, a as {_top('bm', 100)}, b as {_top('plain', 100)},
f as (select query_id, doc_id, floor((coalesce(1e0 / (60 + a.rank), 0) + coalesce(0.8e0 / (60 + b.rank), 0)) * 1e9 + 0.5e0) / 1e9 as score from a full join b using (query_id, doc_id))
select * from {_top('f', 100)}""",
    "r06_vector_upsert": """select vec_id as doc_id, floor((case when label = 0 then embedding[len(embedding)] else embedding[1] end)::double * 1e6 + 0.5e0) / 1e6 as first,
coalesce(label, -1) <> 0 and vec_id in (select doc_id from labels where toxic = 1) as deleted from embeddings""",
    "r06_cells_upsert": """with e as (select vec_id, case when label = 0 then list_reverse(embedding::double[]) else embedding::double[] end as v, sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) as n from embeddings),
cos as (select q.vec_id as query_id, e.vec_id as doc_id, floor(list_dot_product(q.embedding::double[], e.v) / (sqrt(list_sum(list_transform(q.embedding::double[], lambda x: x * x))) * e.n) * 1e6 + 0.5e0) / 1e6 as score from embeddings q, e where q.vec_id % 50 = 0)
select * from """ + _top("cos", 10),
    "w03_rank_in_list": f"with {BM25_SQL} select query_id, doc_id, rank - 1 as rank0 from {_top('bm', 10)}",
}
