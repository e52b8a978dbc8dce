"""Queries of dense kernels on the embeddings, span schedules and pooling. Weights are made from whole numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanframe.functions import kernels as K
from spanframe.operators import tokens as T
from spanframe.plans.catalog_lexical import TOKENS, documents

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


N = 64
W = [[((3 * o + 5 * i) % 11 - 5) / 8 for i in range(N)] for o in range(6)]
B = [o / 4 for o in range(6)]
X = "(SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)"
Y = f"(SELECT vec_id, label, x, list_transform(range(6), lambda o: list_dot_product(x, list_transform(range({N}), lambda i: ((3 * o + 5 * i) % 11 - 5) / 8.0::DOUBLE)::DOUBLE[]) + o / 4.0) AS y FROM {X})"
ROUND = lambda c: f"list_transform({c}, lambda v: round(v, 4) + 0)"


def _x(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def rounded(c):
    return F.transform(c, lambda v: F.round(v, 4) + F.lit(0.0))


@query(f"SELECT vec_id, {ROUND('y')} AS y FROM {Y}")
def vec_linear(spark, sf_dir):
    return _x(spark, sf_dir).select("vec_id", rounded(K.linear(F.col("x"), W, B)).alias("y"))


@query(f"SELECT vec_id, {ROUND('list_transform(z, lambda v: v / list_sum(z))')} AS p FROM (SELECT vec_id, list_transform(y, lambda v: exp((v - list_max(y)) / 2)) AS z FROM {Y})")
def vec_softmax(spark, sf_dir):
    y = _x(spark, sf_dir).withColumn("y", K.linear(F.col("x"), W, B))
    return y.select("vec_id", rounded(K.softmax(F.col("y"), 2.0)).alias("p"))


@query(f"SELECT vec_id, (list_position(y, list_max(y)) - 1)::BIGINT AS best FROM {Y}")
def vec_argmax(spark, sf_dir):
    y = _x(spark, sf_dir).withColumn("y", K.linear(F.col("x"), W, B))
    return y.select("vec_id", K.argmax(F.col("y")).cast("bigint").alias("best"))


@query(f"SELECT vec_id, {ROUND('[greatest(y[1], y[2]), greatest(y[3], y[4]), greatest(y[5], y[6])]')} AS y FROM {Y}")
def vec_maxout(spark, sf_dir):
    w, b = [[W[2 * o], W[2 * o + 1]] for o in range(3)], [[B[2 * o], B[2 * o + 1]] for o in range(3)]
    return _x(spark, sf_dir).select("vec_id", rounded(K.maxout(F.col("x"), w, b)).alias("y"))


NORM_SQL = f"(SELECT vec_id, label, x, list_transform(range(1, {N + 1}), lambda i: (x[i] - list_avg(x)) / sqrt(list_var_pop(x) + 1e-8) * (1 + (i - 1) % 3) + ((i - 1) % 5) / 4.0) AS z FROM {X})"


@query(f"SELECT vec_id, {ROUND('z')} AS z FROM {NORM_SQL}")
def vec_layer_norm(spark, sf_dir):
    z = K.layer_norm(F.col("x"), [1 + i % 3 for i in range(N)], [i % 5 / 4 for i in range(N)])
    return _x(spark, sf_dir).select("vec_id", rounded(z).alias("z"))


@query(f"""SELECT vec_id, round(list_sum(list_transform(range(1, {3 * N + 1}), lambda i: w[i] * (i % 7))), 4) + 0 AS s FROM (SELECT vec_id,
 list_concat(list_concat(coalesce(lag(x) OVER o, z), x), coalesce(lead(x) OVER o, z)) AS w FROM (SELECT *, list_transform(range({N}), lambda i: 0::DOUBLE) AS z FROM {X}) WINDOW o AS (PARTITION BY label ORDER BY vec_id))""")
def vec_expand_window(spark, sf_dir):
    x = K.expand_window(_x(spark, sf_dir), "x", N, 1, "label", "vec_id", "w")
    return x.select("vec_id", (F.round(K.dot(F.col("w"), [i % 7 for i in range(1, 3 * N + 1)]), 4) + F.lit(0.0)).alias("s"))


@query(f"SELECT vec_id, {ROUND(f'list_transform(range(1, {N + 1}), lambda i: x[i] + z[i])')} AS r, len(list_concat(x, z))::INT AS width FROM {NORM_SQL}")
def vec_residual_concat(spark, sf_dir):
    z = K.layer_norm(F.col("x"), [1 + i % 3 for i in range(N)], [i % 5 / 4 for i in range(N)])
    x = _x(spark, sf_dir).withColumn("z", z)
    return x.select("vec_id", rounded(K.residual(F.col("x"), F.col("z"))).alias("r"), F.size(K.concatenate(F.col("x"), F.col("z"))).alias("width"))


@query(f"SELECT l_orderkey, l_linenumber, round(coalesce(list_sum(x), 0), 4) + 0 AS s FROM lineitem LEFT JOIN {X} ON vec_id = l_partkey")
def static_vector_lookup(spark, sf_dir):
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey")
    v = _x(spark, sf_dir).select(F.col("vec_id").alias("key"), F.col("x").alias("vector"))
    x = K.lookup(l, "l_partkey", v, N, "v")
    return x.select("l_orderkey", "l_linenumber", (F.round(F.aggregate("v", F.lit(0.0), lambda s, a: s + a), 4) + F.lit(0.0)).alias("s"))


SCHEDULE_SQL = f"""WITH {TOKENS}, n AS (SELECT doc_id, count(*)::INT AS n FROM tok GROUP BY doc_id), s AS (SELECT doc_id, n, unnest(range(0, n, 96))::INT AS start FROM n),
spans AS (SELECT doc_id, start, least(start + 128, n)::INT AS "end" FROM s WHERE start = 0 OR start + 32 < n)"""


def _spans(spark, sf_dir):
    n = T.flat(documents(spark, sf_dir), offsets=False).groupBy("doc_id").agg(F.count("*").cast("int").alias("n"))
    return K.span_schedule(n, 128, 96).select("doc_id", "start", "end")


@query(f'{SCHEDULE_SQL} SELECT doc_id, start, "end" FROM spans')
def span_schedule(spark, sf_dir):
    return _spans(spark, sf_dir)


@query(f"""{SCHEDULE_SQL}, p AS (SELECT doc_id, unnest(range(start, "end"))::INT AS i, start FROM spans) SELECT doc_id, i, round(avg(start % 17), 4) AS a, round(avg(i - start), 4) AS b FROM p GROUP BY doc_id, i""")
def overlap_mean_pool(spark, sf_dir):
    """Each span gives a token it covers a vector; what a token gets is their mean."""
    p = _spans(spark, sf_dir).select("doc_id", "start", F.explode(F.sequence("start", F.col("end") - 1)).alias("i"))
    p = p.withColumn("v", F.array((F.col("start") % 17).cast("double"), (F.col("i") - F.col("start")).cast("double")))
    m = K.mean_pool(p, ["doc_id", "i"], "v", 2, "m")
    return m.select("doc_id", "i", F.round(F.col("m")[0], 4).alias("a"), F.round(F.col("m")[1], 4).alias("b"))
