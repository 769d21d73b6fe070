"""Queries over terms, vectors, pairs, graphs and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormglass.functions import text as X
from stormglass.operators import evaluate, graph, paths
from stormglass.operators import steps as S
from stormglass.operators import vectors as V
from stormglass.runtime import table
from stormglass.sources import posts as P

from .registry import EDGES, POSTS, SNAPSHOTS, WORDS, query


@query(f"WITH {WORDS} SELECT term, count(*) AS n FROM (SELECT unnest(terms) AS term FROM w) GROUP BY term")
def agg1_term_count(spark: SparkSession, sf: str) -> DataFrame:
    return V.term_count(P.words(spark, sf))


@query(f"WITH {SNAPSHOTS} SELECT snapshot, term, count(*) AS n FROM (SELECT snapshot, unnest(terms) AS term FROM snap) GROUP BY ALL")
def agg2_term_count_windowed(spark: SparkSession, sf: str) -> DataFrame:
    return V.windowed_term_count(P.words(spark, sf))


@query(f"""WITH {SNAPSHOTS}, c AS (SELECT snapshot, term, count(*) AS n FROM (SELECT snapshot, unnest(terms) AS term FROM snap) GROUP BY ALL)
SELECT snapshot, term, n, CAST(rn AS INT) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY snapshot ORDER BY n DESC, term) AS rn FROM c) WHERE rn <= 20""")
def top_terms_per_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("snapshot").orderBy(F.desc("n"), "term")
    return V.windowed_term_count(P.words(spark, sf)).withColumn("rn", F.row_number().over(order)).where("rn <= 20")


DF = f"{WORDS}, d AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT tweet_id, unnest(terms) AS term FROM w) GROUP BY term)"


@query(f"WITH {DF} SELECT term, df, round(ln((SELECT count(*) FROM w) / df), 6) AS idf FROM d")
def agg3_doc_freq_idf(spark: SparkSession, sf: str) -> DataFrame:
    return V.doc_freq(P.words(spark, sf)).withColumn("idf", F.round("idf", 6))


@query(f"WITH {WORDS}, {EDGES} SELECT least(u, v) AS a, greatest(u, v) AS b, count(*) AS weight FROM co GROUP BY ALL")
def agg4_edge_weight(spark: SparkSession, sf: str) -> DataFrame:
    return graph.edges(P.words(spark, sf))


@query(f"WITH {WORDS}, {EDGES} SELECT tweet_id, u, v, count(*) AS n FROM co GROUP BY ALL")
def jn3_cooccur_self_join(spark: SparkSession, sf: str) -> DataFrame:
    return graph.pairs(P.words(spark, sf), "tweet_id").groupBy("tweet_id", "u", "v").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {WORDS} SELECT DISTINCT term, tweet_id FROM (SELECT tweet_id, unnest(terms) AS term FROM w)")
def agg5_posts_per_node(spark: SparkSession, sf: str) -> DataFrame:
    return P.words(spark, sf).select(F.explode(F.array_distinct("terms")).alias("term"), "tweet_id")


@query(f"WITH {WORDS} SELECT term, round(avg(i), 6) AS avg_position, count(*) AS n FROM (SELECT unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS i FROM w) GROUP BY term")
def agg6_avg_position(spark: SparkSession, sf: str) -> DataFrame:
    o = P.words(spark, sf).select(F.posexplode("terms").alias("i", "term"))
    return o.groupBy("term").agg(F.round(F.avg("i"), 6).alias("avg_position"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {WORDS} SELECT term, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM (SELECT unnest(terms) AS term FROM w) GROUP BY term")
def agg7_visit_share(spark: SparkSession, sf: str) -> DataFrame:
    c = V.term_count(P.words(spark, sf))
    whole = c.agg(F.sum("n")).first()[0] or 1
    return c.select("term", F.round(F.col("n") / F.lit(whole), 9).alias("share"))


@query("""SELECT label, CAST(i AS INT) AS i, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY label, i""")
def agg9_centroid(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return e.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))


#: v: weights over all posts; users stand in for clusters.
WEIGHTS = f"""{WORDS}, tf AS (SELECT tweet_id, step, coalesce(user_id, '-') AS cluster, term, count(*) AS tf FROM (SELECT tweet_id, step, user_id, unnest(terms) AS term FROM w) GROUP BY ALL),
c AS (SELECT term, sum(tf) AS c FROM tf GROUP BY term), v AS (SELECT tweet_id, step, cluster, term, tf * ln(1 + (SELECT count(*) FROM w) / c) AS weight FROM tf JOIN c USING (term))"""


@query(f"WITH {WEIGHTS} SELECT tweet_id, term, round(weight, 6) AS weight FROM v")
def mth1_tf_weight(spark: SparkSession, sf: str) -> DataFrame:
    return V.weights(P.words(spark, sf), "tweet_id").withColumn("weight", F.round("weight", 6))


@query(f"WITH {WEIGHTS} SELECT tweet_id, round(sqrt(sum(weight * weight)), 6) AS norm FROM v GROUP BY tweet_id")
def mth2_norm(spark: SparkSession, sf: str) -> DataFrame:
    return V.norms(V.weights(P.words(spark, sf), "tweet_id"), "tweet_id").withColumn("norm", F.round("norm", 6))


#: sv: weights within each step; sim: cosines of the posts of a step.
STEP_SIM = f"""{WORDS}, tf AS (SELECT step, tweet_id, term, count(*) AS tf FROM (SELECT step, tweet_id, unnest(terms) AS term FROM w) GROUP BY ALL),
c AS (SELECT step, term, sum(tf) AS c FROM tf GROUP BY ALL), n AS (SELECT step, count(*) AS n FROM w GROUP BY step),
sv AS (SELECT step, tweet_id, term, tf * ln(1 + n / c) AS weight FROM tf JOIN c USING (step, term) JOIN n USING (step)),
nm AS (SELECT step, tweet_id, sqrt(sum(weight * weight)) AS norm FROM sv GROUP BY ALL),
dot AS (SELECT a.step, a.tweet_id AS a, b.tweet_id AS b, sum(a.weight * b.weight) AS d FROM sv a JOIN sv b ON a.step = b.step AND a.term = b.term AND a.tweet_id < b.tweet_id GROUP BY ALL),
sim AS (SELECT dot.step, a, b, d / (x.norm * y.norm) AS similarity FROM dot JOIN nm x ON x.step = dot.step AND x.tweet_id = a JOIN nm y ON y.step = dot.step AND y.tweet_id = b)"""


def step_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return V.weights(P.words(spark, sf), "tweet_id", "step")


@query(f"WITH {STEP_SIM} SELECT step, a, b, round(similarity, 6) AS similarity FROM sim WHERE round(similarity, 9) >= 0.2")
def jn4_all_pairs_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return V.similar_pairs(step_vectors(spark, sf), "tweet_id", 0.2, "step").withColumn("similarity", F.round("similarity", 6))


#: sim as above, of the posts each window sees, under the window's snapshot as step.
WINDOW_SIM = SNAPSHOTS + ", sw AS MATERIALIZED (SELECT snapshot AS step, tweet_id, terms FROM snap)" + STEP_SIM[len(WORDS) :].replace("FROM w)", "FROM sw)").replace("FROM w ", "FROM sw ")


@query(f"WITH {WINDOW_SIM} SELECT step AS snapshot, a, b, round(similarity, 6) AS similarity FROM sim WHERE round(similarity, 9) >= 0.2")
def jn4_window_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of posts of a window of twelve steps; weights are those of the window."""
    words = P.words(spark, sf)
    plain, names, _ = S.numbered(words)
    seen = S.snapshots(words.select("tweet_id", "step", "created_at_ms")).join(plain, "tweet_id").select("snapshot", "post", "terms")
    pairs = V.blocked_pairs(V.weights(seen, "post", "snapshot"), "post", 0.2, "snapshot")
    named = pairs.join(names.select(F.col("post").alias("a"), F.col("tweet_id").alias("_a")), "a").join(names.select(F.col("post").alias("b"), F.col("tweet_id").alias("_b")), "b")
    return named.select("snapshot", F.col("_a").alias("a"), F.col("_b").alias("b"), F.round("similarity", 6).alias("similarity"))


#: every pair of a step by brute force; a pair without a common term has similarity 0.
@query(f"WITH {STEP_SIM}, t AS (SELECT step, sum(similarity) AS s FROM sim GROUP BY step), k AS (SELECT step, count(*) AS n FROM nm WHERE norm > 0 GROUP BY step) SELECT k.step, n, round(CASE WHEN n > 1 THEN coalesce(s, 0) / (n * (n - 1) / 2) END, 6) AS mean FROM k LEFT JOIN t USING (step)")
def mth3_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return V.mean_similarity(step_vectors(spark, sf), "tweet_id", "step").withColumn("mean", F.round("mean", 6))


JACCARD = f"""{WORDS}, d AS (SELECT DISTINCT step, tweet_id, unnest(terms) AS term FROM w), n AS (SELECT tweet_id, count(*) AS n FROM d GROUP BY tweet_id),
i AS (SELECT a.step, a.tweet_id AS a, b.tweet_id AS b, count(*) AS i FROM d a JOIN d b ON a.step = b.step AND a.term = b.term AND a.tweet_id < b.tweet_id GROUP BY ALL)"""


@query(f"WITH {JACCARD} SELECT step, a, b, round(i / (x.n + y.n - i), 6) AS similarity FROM i JOIN n x ON x.tweet_id = a JOIN n y ON y.tweet_id = b WHERE round(i / (x.n + y.n - i), 9) >= 0.2")
def jn5_all_pairs_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return V.jaccard_pairs(P.words(spark, sf), "tweet_id", 0.2, "step").withColumn("similarity", F.round("similarity", 6))


NEXT = "nx AS (SELECT *, lead(terms) OVER (PARTITION BY step ORDER BY created_at_ms, tweet_id) AS b FROM w)"


def neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Each post with the terms of the next post of its step."""
    from pyspark.sql import Window

    order = Window.partitionBy("step").orderBy("created_at_ms", "tweet_id")
    return P.words(spark, sf).withColumn("b", F.lead("terms").over(order)).where("b IS NOT NULL")


@query(f"WITH {WORDS}, {NEXT} SELECT tweet_id, round((len(terms) + len(b) - len(list_distinct(terms || b))) / len(list_distinct(terms || b)), 6) AS jaccard FROM nx WHERE b IS NOT NULL")
def mth5_list_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours(spark, sf).select("tweet_id", F.round(X.list_jaccard(F.col("terms"), F.col("b")), 6).alias("jaccard"))


@query(f"WITH {WORDS}, {NEXT} SELECT tweet_id, round(len(list_intersect(terms, b)) / len(list_distinct(terms || b)), 6) AS jaccard FROM nx WHERE b IS NOT NULL")
def mth6_set_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours(spark, sf).select("tweet_id", F.round(X.set_jaccard(F.col("terms"), F.col("b")), 6).alias("jaccard"))


@query(f"WITH {WORDS}, o AS (SELECT DISTINCT tweet_id, unnest(terms) AS term FROM w) SELECT term, tweet_id, user_id, created_at_ms FROM o JOIN p USING (tweet_id) WHERE term IN ('bayou', 'levee')")
def jn7_posting_lookup(spark: SparkSession, sf: str) -> DataFrame:
    postings = P.words(spark, sf).select("tweet_id", F.explode(F.array_distinct("terms")).alias("term")).where("term IN ('bayou', 'levee')")
    return postings.join(P.posts(spark, sf), "tweet_id").select("term", "tweet_id", "user_id", "created_at_ms")


CENTERS = """e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
k AS (SELECT label AS cluster, i, avg(x) AS y FROM e GROUP BY ALL)"""


@query(f"""WITH {CENTERS}, s AS (SELECT vec_id, cluster, round(sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))), 9) AS s FROM e JOIN k USING (i) GROUP BY ALL)
SELECT vec_id, cluster FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cluster) AS rn FROM s) WHERE rn = 1""")
def jn8_nearest_cluster(spark: SparkSession, sf: str) -> DataFrame:
    from stormglass.operators import cluster

    e = table(spark, sf, "embeddings")
    return cluster.nearest(e, "vec_id", "embedding", cluster.centroids(e, "label", "embedding"))


@query(f"""WITH {CENTERS} SELECT a.cluster AS a, b.cluster AS b, round(sum(a.y * b.y) / (sqrt(sum(a.y * a.y)) * sqrt(sum(b.y * b.y))), 6) AS similarity
FROM k a JOIN k b ON a.i = b.i AND a.cluster < b.cluster GROUP BY ALL""")
def jn9_cluster_pairs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("term", "x"))
    c = e.groupBy("label", "term").agg(F.avg(F.col("x").cast("double")).alias("weight"))
    return V.similar_pairs(c, "label", -2.0).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {CENTERS} SELECT vec_id, round(sum((x - y) * (x - y)), 5) AS distance FROM e JOIN k ON e.label = k.cluster AND e.i = k.i GROUP BY vec_id""")
def mth4_sq_euclid(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    c = e.groupBy("label", "i").agg(F.avg("x").alias("y"))
    return e.join(c, ["label", "i"]).groupBy("vec_id").agg(F.round(F.sum((F.col("x") - F.col("y")) ** 2), 5).alias("distance"))


@query(f"""WITH {WORDS}, o AS (SELECT tweet_id, unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS i FROM w)
SELECT l.term AS u, r.term AS v, count(DISTINCT (l.tweet_id, r.i)) AS n_places, count(DISTINCT l.tweet_id) AS n_posts FROM o l JOIN o r ON l.tweet_id = r.tweet_id AND r.i > l.i AND r.i - l.i <= 3 AND l.term <> r.term GROUP BY ALL""")
def jn10_position_gap_join(spark: SparkSession, sf: str) -> DataFrame:
    return graph.places(P.words(spark, sf)).groupBy("u", "v").agg(F.count(F.lit(1)).alias("n_places"), F.countDistinct("tweet_id").alias("n_posts"))


@query(f"""WITH {WEIGHTS}, nm AS (SELECT tweet_id, sqrt(sum(weight * weight)) AS norm FROM v GROUP BY tweet_id),
k AS (SELECT cluster, term, sum(weight / norm) AS a, sum(weight) AS b FROM v JOIN nm USING (tweet_id) WHERE norm > 0 GROUP BY ALL),
q AS (SELECT cluster, sum(a * b) AS dot, sqrt(sum(b * b)) AS length FROM k GROUP BY cluster),
t AS (SELECT coalesce(user_id, '-') AS cluster, count(*) AS n, sum(step) AS sum_t, sum(step * step) AS sum_t2 FROM w GROUP BY 1)
SELECT cluster, n, CAST(sum_t AS BIGINT) AS sum_t, CAST(sum_t2 AS BIGINT) AS sum_t2, round(dot / (n * length), 6) AS avg_similarity FROM t JOIN q USING (cluster)""")
def agg10_tcv_stats(spark: SparkSession, sf: str) -> DataFrame:
    return user_clusters(spark, sf).withColumn("avg_similarity", F.round("avg_similarity", 6))


def user_clusters(spark: SparkSession, sf: str) -> DataFrame:
    words = P.words(spark, sf).withColumn("cluster", F.coalesce("user_id", F.lit("-")))
    vectors = V.weights(words, "tweet_id").join(words.select("tweet_id", "cluster"), "tweet_id")
    return V.cluster_stats(V.cluster_vectors(vectors, "tweet_id", "cluster"), words, "cluster")


@query(f"""WITH {WORDS}, t AS (SELECT coalesce(user_id, '-') AS cluster, count(*) AS n, sum(step) / count(*) AS m, sum(step * step) / count(*) AS m2 FROM w GROUP BY 1)
SELECT cluster, round(CASE WHEN n < 50 THEN m ELSE m + sqrt(greatest(m2 - m * m, 0)) * {V.normal_quantile(0.95)!r} END, 5) AS freshness FROM t""")
def mth8_freshness(spark: SparkSession, sf: str) -> DataFrame:
    words = P.words(spark, sf).withColumn("cluster", F.coalesce("user_id", F.lit("-")))
    t = words.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("step").alias("sum_t"), F.sum(F.col("step") * F.col("step")).alias("sum_t2"))
    return V.freshness(t).select("cluster", F.round("freshness", 5).alias("freshness"))


@query(f"""WITH {WORDS}, t AS (SELECT coalesce(user_id, '-') AS cluster, count(*) AS n, sum(step) / count(*) AS m, sum(step * step) / count(*) AS m2 FROM w GROUP BY 1)
SELECT cluster FROM t WHERE round(CASE WHEN n < 50 THEN m ELSE m + sqrt(greatest(m2 - m * m, 0)) * {V.normal_quantile(0.95)!r} END, 5) < 200 - 12""")
def gr17_delete_outdated(spark: SparkSession, sf: str) -> DataFrame:
    return mth8_freshness(spark, sf).where("freshness < 200 - 12").select("cluster")


@query("""SELECT round(sqrt(2) * list_sum(list_transform(list_zip([1.0, 1.0, 7/6, 127/90, 4369/2520, 34807/16200, 20036983/7484400], range(0, 7)),
lambda c: c[1] / (2 * c[2] + 1) * pow(sqrt(pi()) / 2 * 0.9, 2 * c[2] + 1))), 9) AS quantile""")
def mth7_normal_quantile(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(1).select(F.round(F.lit(V.normal_quantile(0.95)), 9).alias("quantile"))


@query(f"""WITH {WORDS}, o AS (SELECT DISTINCT step, tweet_id, created_at_ms, unnest(terms) AS term FROM w),
f AS (SELECT step, term, min((created_at_ms, tweet_id)) AS first FROM o GROUP BY ALL),
n AS (SELECT w.step, w.tweet_id, w.created_at_ms, len(list_distinct(terms)) AS size, count(f.term) AS new_terms FROM w LEFT JOIN f ON f.step = w.step AND f.first = (w.created_at_ms, w.tweet_id) GROUP BY ALL)
SELECT step, tweet_id, new_terms, CAST(sum(new_terms) OVER (PARTITION BY step ORDER BY created_at_ms, tweet_id) AS BIGINT) AS n_union, size - new_terms AS n_both FROM n""")
def agg13_set_overlap_stats(spark: SparkSession, sf: str) -> DataFrame:
    return S.running_sets(P.words(spark, sf), "step", "tweet_id", "created_at_ms", "terms")


COOCCUR = """o AS (SELECT source, doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS term FROM documents WHERE source IS NOT NULL),
c AS (SELECT source, term, count(*) AS n FROM o GROUP BY ALL),
top AS (SELECT source, term, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, term) AS rn FROM c) WHERE rn <= 10),
h AS (SELECT o.source, doc_id, o.term FROM o JOIN top ON top.source = o.source AND top.term = o.term)"""


@query(f"WITH {COOCCUR} SELECT x.source, x.term AS u, y.term AS v, count(*) AS n FROM h x JOIN h y ON y.source = x.source AND y.doc_id = x.doc_id WHERE x.term < y.term GROUP BY ALL")
def agg12_topic_tweet_cooccur(spark: SparkSession, sf: str) -> DataFrame:
    return cooccur(spark, sf)[1]


def cooccur(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Top ten terms of each source with their documents, and the documents two of them share."""
    from pyspark.sql import Window

    o = table(spark, sf, "documents").where("source IS NOT NULL").select("source", "doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("term"))
    order = Window.partitionBy("source").orderBy(F.desc("n"), "term")
    top = o.groupBy("source", "term").agg(F.count(F.lit(1)).alias("n")).withColumn("rn", F.row_number().over(order)).where("rn <= 10").select("source", "term", "n")
    own = o.join(F.broadcast(top.select("source", "term")), ["source", "term"]).groupBy("source", "doc_id").agg(F.array_sort(F.collect_set("term")).alias("t"))
    pair = F.flatten(F.transform("t", lambda a: F.transform(F.filter("t", lambda b: b > a), lambda b: F.struct(a.alias("u"), b.alias("v")))))
    return top, own.select("source", F.inline(pair)).groupBy("source", "u", "v").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {COOCCUR}, co AS (SELECT x.source, x.term AS u, y.term AS v, count(*) AS n FROM h x JOIN h y ON y.source = x.source AND y.doc_id = x.doc_id GROUP BY ALL)
SELECT a.source, round(sum(ln((coalesce(co.n, 0) + 1) / a.n)) / 45, 6) AS coherence FROM top a JOIN top b ON a.source = b.source AND a.term <> b.term LEFT JOIN co ON co.source = a.source AND co.u = a.term AND co.v = b.term GROUP BY a.source""")
def mth14_coherence(spark: SparkSession, sf: str) -> DataFrame:
    top, pairs = cooccur(spark, sf)
    both = pairs.unionAll(pairs.select("source", F.col("v").alias("u"), F.col("u").alias("v"), "n"))
    each = top.withColumnsRenamed({"term": "u", "n": "c"}).join(top.select("source", F.col("term").alias("v")), "source").where("u <> v")
    full = each.join(both, ["source", "u", "v"], "left")
    return full.groupBy("source").agg(F.round(F.sum(F.log((F.coalesce("n", F.lit(0)) + 1) / F.col("c"))) / 45, 6).alias("coherence"))


#: dir: directed edges over all posts; tot: with the total of both directions; pr: transitions.
DIRECTED = f"""{WORDS}, {EDGES}, dir AS (SELECT u, v, count(*) AS n FROM co GROUP BY ALL),
tot AS (SELECT d.u, d.v, d.n + coalesce(b.n, 0) AS total FROM dir d LEFT JOIN dir b ON b.u = d.v AND b.v = d.u),
pr AS (SELECT u, v, total / sum(total) OVER (PARTITION BY u) AS p FROM tot), nodes AS (SELECT DISTINCT unnest(terms) AS node FROM w)"""


@query(f"WITH {DIRECTED} SELECT u, v, total FROM tot")
def gr1_build_word_graph(spark: SparkSession, sf: str) -> DataFrame:
    return graph.directed(P.words(spark, sf))


@query(f"WITH {DIRECTED} SELECT u, v, round(p, 9) AS p FROM pr")
def mth12_normalize_weights(spark: SparkSession, sf: str) -> DataFrame:
    return graph.transitions(graph.directed(P.words(spark, sf))).withColumn("p", F.round("p", 9))


@query(f"""WITH {SNAPSHOTS}, pos AS (SELECT snapshot, tweet_id, unnest(terms) AS term, generate_subscripts(terms, 1) AS i FROM snap)
SELECT a.snapshot, least(a.term, b.term) AS a, greatest(a.term, b.term) AS b, count(*) AS weight FROM pos a JOIN pos b ON a.snapshot = b.snapshot AND a.tweet_id = b.tweet_id AND b.i - a.i BETWEEN 1 AND 3 AND a.term <> b.term GROUP BY ALL""")
def gr2_window_graph(spark: SparkSession, sf: str) -> DataFrame:
    e = graph.window_edges(P.words(spark, sf))
    return e.groupBy("snapshot", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.max("total").alias("weight"))


WALK4 = f"""{DIRECTED}, r0 AS (SELECT node, 1.0::DOUBLE AS r FROM nodes), r1 AS (SELECT v AS node, sum(r * p * 0.85) AS r FROM r0 JOIN pr ON u = node GROUP BY v),
r2 AS (SELECT v AS node, sum(r * p * 0.85) AS r FROM r1 JOIN pr ON u = node GROUP BY v), r3 AS (SELECT v AS node, sum(r * p * 0.85) AS r FROM r2 JOIN pr ON u = node GROUP BY v),
rk AS (SELECT node, sum(r) / sum(sum(r)) OVER () AS rank FROM (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3) GROUP BY node)"""


def ranked(spark: SparkSession, sf: str, length: int) -> tuple[DataFrame, DataFrame]:
    words = P.words(spark, sf)
    nodes = words.select(F.explode("terms").alias("node")).distinct()
    return words, graph.walk_rank(nodes, graph.transitions(graph.directed(words)), length=length)


@query(f"WITH {WALK4} SELECT node, round(rank, 9) AS rank FROM rk")
def gr5_walk_pagerank_4(spark: SparkSession, sf: str) -> DataFrame:
    return ranked(spark, sf, 4)[1].withColumn("rank", F.round("rank", 9))


WALK20 = f"{DIRECTED}, r0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE AS r FROM nodes), " + ", ".join(f"r{k} AS MATERIALIZED (SELECT v AS node, sum(r * p * 0.85) AS r FROM r{k - 1} JOIN pr ON u = node GROUP BY v)" for k in range(1, 20)) + ", rk AS (SELECT node, sum(r) / sum(sum(r)) OVER () AS rank FROM (" + " UNION ALL ".join(f"SELECT * FROM r{k}" for k in range(20)) + ") GROUP BY node)"


@query(f"WITH {WALK20} SELECT node, round(rank, 9) AS rank FROM rk")
def gr5_walk_pagerank(spark: SparkSession, sf: str) -> DataFrame:
    return ranked(spark, sf, 20)[1].withColumn("rank", F.round("rank", 9))


@query(f"WITH {WALK4}, t AS (SELECT node, rank FROM rk ORDER BY round(rank, 9) DESC, node LIMIT 20) SELECT printf('PageRank: %f, %s', rank, node) AS line FROM t UNION ALL SELECT printf('%s --> %s: %.1f', u, v, total::DOUBLE) FROM tot")
def snk7_console_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of a run's log: the top nodes by rank and the edges of the graph."""
    from stormglass.sources import sinks

    words, ranks = ranked(spark, sf, 4)
    return sinks.rank_lines(ranks.select("node", F.round("rank", 9).alias("rank")), 20).unionAll(sinks.edge_lines(graph.directed(words)))


@query(f"WITH {WALK4} SELECT node, round(rank, 9) AS rank FROM rk ORDER BY round(rank, 9) DESC, node LIMIT 10")
def top3_topk_pagerank(spark: SparkSession, sf: str) -> DataFrame:
    return ranked(spark, sf, 4)[1].withColumn("rank", F.round("rank", 9)).orderBy(F.desc("rank"), "node").limit(10)


@query(f"""WITH {WALK4}, un AS (SELECT DISTINCT u AS node, v AS other FROM co UNION SELECT DISTINCT v, u FROM co)
SELECT node, round(rk.rank + coalesce(s.near, 0), 8) AS utility FROM rk LEFT JOIN (SELECT un.node, sum(rk.rank) AS near FROM un JOIN rk ON rk.node = un.other GROUP BY un.node) s USING (node)""")
def gr6_neighborhood_utility(spark: SparkSession, sf: str) -> DataFrame:
    words, ranks = ranked(spark, sf, 4)
    return graph.neighborhood_utility(ranks, graph.edges(words)).withColumn("utility", F.round("utility", 8))


@query(f"WITH {WALK4}, o AS (SELECT DISTINCT tweet_id, unnest(terms) AS node FROM w) SELECT tweet_id, round(sum(rank), 8) AS score FROM o JOIN rk USING (node) GROUP BY tweet_id")
def mth10_post_score(spark: SparkSession, sf: str) -> DataFrame:
    words, ranks = ranked(spark, sf, 4)
    o = words.select("tweet_id", F.explode(F.array_distinct("terms")).alias("node"))
    return o.join(ranks, "node").groupBy("tweet_id").agg(F.round(F.sum("rank"), 8).alias("score"))


#: ev: unigram scores of each model against the model inc, over the first k lines of a step.
EVAL = f"""{X.STOP_SQL}, l AS (SELECT step, model, rank_no, {X.extract_terms_sql('text')} AS terms FROM summaries, stop),
ks AS (SELECT unnest([3, 5]) AS k), o AS (SELECT DISTINCT k, step, model, unnest(terms) AS term FROM l, ks WHERE rank_no <= k),
g AS (SELECT m.k, m.step, m.model, count(*) AS n_generated, count(r.term) AS n_both FROM o m LEFT JOIN o r ON r.k = m.k AND r.step = m.step AND r.term = m.term AND r.model = 'inc' WHERE m.model <> 'inc' GROUP BY ALL),
ref AS (SELECT k, step, count(*) AS n_reference FROM o WHERE model = 'inc' GROUP BY ALL),
ev AS (SELECT model, k, step, n_generated, n_reference, n_both, round(n_both / n_generated, 6) AS p, round(n_both / n_reference, 6) AS r,
  round(CASE WHEN n_both > 0 THEN 2 * (n_both / n_generated) * (n_both / n_reference) / (n_both / n_generated + n_both / n_reference) END, 6) AS f1 FROM g JOIN ref USING (k, step))"""


def scores(spark: SparkSession, sf: str) -> DataFrame:
    lines = P.words_of(spark, sf, table(spark, sf, "summaries"), "text").withColumn("k", F.explode(F.array(F.lit(3), F.lit(5)))).where("rank_no <= k")
    return evaluate.rouge(lines.where("model <> 'inc'"), lines.where("model = 'inc'"), "k", "step")


@query(f"WITH {EVAL} SELECT * FROM ev")
def gr28_rouge_eval(spark: SparkSession, sf: str) -> DataFrame:
    return scores(spark, sf)


@query(f"WITH {EVAL} SELECT model, k, step, p, r, f1 FROM ev")
def mth11_prf(spark: SparkSession, sf: str) -> DataFrame:
    return scores(spark, sf).select("model", "k", "step", "p", "r", "f1")


@query(f"WITH {EVAL} SELECT model, k, step, n_generated, n_reference, n_both FROM ev")
def agg14_rouge_sets(spark: SparkSession, sf: str) -> DataFrame:
    return scores(spark, sf).select("model", "k", "step", "n_generated", "n_reference", "n_both")


@query("SELECT m.step, m.model, count(*) AS n FROM summaries m JOIN summaries r ON r.step = m.step AND r.rank_no = m.rank_no AND r.model = 'inc' WHERE m.model <> 'inc' GROUP BY ALL")
def jn11_eval_join(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "summaries")
    ref = s.where("model = 'inc'").select("step", "rank_no")
    return s.where("model <> 'inc'").join(ref, ["step", "rank_no"]).groupBy("step", "model").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {EVAL} SELECT model, step, max(p) FILTER (k = 3) AS p_3, max(r) FILTER (k = 3) AS r_3, max(f1) FILTER (k = 3) AS f1_3,
max(p) FILTER (k = 5) AS p_5, max(r) FILTER (k = 5) AS r_5, max(f1) FILTER (k = 5) AS f1_5 FROM ev GROUP BY model, step""")
def snk4_write_eval_csv(spark: SparkSession, sf: str) -> DataFrame:
    from stormglass.runtime import scratch_dir
    from stormglass.sources import sinks

    path = scratch_dir(spark)
    wide = sinks.eval_table(scores(spark, sf), [3, 5])
    sinks.write_csv(wide, path)
    return spark.read.schema(wide.schema).csv(path)


TAGGED = f"{POSTS}, g AS (SELECT tweet_id, created_at_ms, {paths.tag_text_sql('text')} AS nodes FROM p)"
NEXT_NODES = f"{TAGGED}, e AS (SELECT tweet_id, created_at_ms, unnest(nodes[:-2]) AS a, unnest(nodes[2:]) AS b, unnest(range(2, len(nodes) + 1)) AS i FROM g), nx AS (SELECT * FROM e WHERE a <> b AND NOT regexp_full_match(a, '{paths.STOP_ADDING}'))"


def tagged_posts(spark: SparkSession, sf: str) -> DataFrame:
    return paths.tagged(P.posts(spark, sf), "tweet_id", "text").join(P.posts(spark, sf).select("tweet_id", "created_at_ms"), "tweet_id")


@query(f"WITH {NEXT_NODES} SELECT a, b, count(*) AS weight FROM nx GROUP BY ALL")
def gr19_word_path_graph(spark: SparkSession, sf: str) -> DataFrame:
    return paths.adjacent(paths.tagged(P.posts(spark, sf), "tweet_id", "text"), "nodes")


def two_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of two nodes that follow each other: where they are met, and their gain."""
    g = P.posts(spark, sf).select(F.struct("created_at_ms", "tweet_id").alias("post"), paths.tag_text(F.col("text")).alias("nodes"))
    pair = F.transform(F.sequence(F.lit(0), F.size("nodes") - 2), lambda i: F.struct(F.get("nodes", i).alias("a"), F.get("nodes", i + 1).alias("b")))
    each = g.where(F.size("nodes") > 1).select("post", F.inline(pair)).where(F.col("a") != F.col("b")).where(~F.col("a").rlike(f"^{paths.STOP_ADDING}$"))
    return each.groupBy("a", "b").agg(F.min("post").alias("first"), F.count(F.lit(1)).alias("n_places")).withColumn("gain", paths.path_score(F.col("n_places"), F.lit(2)) / 2)


@query(f"WITH {NEXT_NODES} SELECT a, b, round(count(*) * log2(2) / 2, 6) AS gain FROM nx GROUP BY ALL ORDER BY gain DESC, a, b LIMIT 20")
def top7_gain_sort_limit(spark: SparkSession, sf: str) -> DataFrame:
    return two_nodes(spark, sf).withColumn("gain", F.round("gain", 6)).orderBy(F.desc("gain"), "a", "b").limit(20).select("a", "b", "gain")


#: the order of candidates: the latest first post first, of one first post the fewest places.
@query(f"WITH {NEXT_NODES}, c AS (SELECT a, b, min((created_at_ms, tweet_id)) AS first, count(*) AS n_places FROM nx GROUP BY ALL) SELECT a, b, n_places, row_number() OVER (ORDER BY first DESC, n_places, a, b) - 1 AS place FROM c")
def top10_candidate_order(spark: SparkSession, sf: str) -> DataFrame:
    c = two_nodes(spark, sf).select("a", "b", "n_places", (-F.col("first.created_at_ms")).alias("ms"), "first")
    last = c.select("first").distinct()
    # Strings cannot be negated: equal times are ordered by their place among the first posts.
    at = S.with_index(last, "first", name="i")
    return S.with_index(c.join(at, "first").select("a", "b", "n_places", (-F.col("i")).alias("i")), "i", "n_places", "a", "b", name="place").select("a", "b", "n_places", "place")


#: cp, ck: what is left of terms and posts after so many rounds of the filter; more than it takes to settle.
CORE = f"""{WORDS}, k0 AS MATERIALIZED (SELECT tweet_id, unnest(terms) AS term FROM w), """ + ", ".join(
    f"c{i} AS MATERIALIZED (SELECT tweet_id, term FROM k{i - 1} WHERE term IN (SELECT term FROM k{i - 1} GROUP BY term HAVING count(*) >= 5)), k{i} AS MATERIALIZED (SELECT tweet_id, term FROM c{i} WHERE tweet_id IN (SELECT tweet_id FROM c{i} GROUP BY tweet_id HAVING count(*) >= 3))" for i in range(1, 16)
)


@query(f"WITH {CORE} SELECT tweet_id, count(*) AS n FROM k15 GROUP BY tweet_id")
def gr23_kcore_filter(spark: SparkSession, sf: str) -> DataFrame:
    from stormglass.operators import topics

    return topics.core_terms(P.words(spark, sf).select("tweet_id", F.explode("terms").alias("term"))).groupBy("tweet_id").agg(F.count(F.lit(1)).alias("n"))


#: the sum of a post's similarities to the others of its step, by sets of terms.
@query(f"WITH {JACCARD}, jc AS (SELECT a, b, i / (x.n + y.n - i) AS s FROM i JOIN n x ON x.tweet_id = a JOIN n y ON y.tweet_id = b) SELECT w.step, w.tweet_id AS a, round(coalesce(sum(t.s), 0), 6) AS centrality FROM w LEFT JOIN (SELECT a, s FROM jc UNION ALL SELECT b, s FROM jc) t ON t.a = w.tweet_id GROUP BY ALL")
def gr9_centrality(spark: SparkSession, sf: str) -> DataFrame:
    w = P.words(spark, sf)
    s = V.jaccard_pairs(w, "tweet_id", 0.0, "step")
    both = s.select("a", "similarity").unionAll(s.select(F.col("b").alias("a"), "similarity")).groupBy("a").agg(F.sum("similarity").alias("c"))
    return w.select("step", F.col("tweet_id").alias("a")).join(both, "a", "left").select("step", "a", F.round(F.coalesce("c", F.lit(0.0)), 6).alias("centrality"))


#: one round of the ranking of posts of a step over similarities of at least 0.2.
@query(f"""WITH {STEP_SIM}, g AS (SELECT step, a, b, similarity AS s FROM sim WHERE round(similarity, 9) >= 0.2 UNION ALL SELECT step, b, a, similarity FROM sim WHERE round(similarity, 9) >= 0.2),
o AS (SELECT step, a, sum(s) AS whole FROM g GROUP BY ALL), m AS (SELECT w.step, tweet_id, n FROM w JOIN n USING (step)),
x AS (SELECT m.step, m.tweet_id, 0.15 / m.n + 0.85 * coalesce(sum(g.s / o.whole / m.n), 0) AS score FROM m LEFT JOIN g ON g.step = m.step AND g.b = m.tweet_id LEFT JOIN o ON o.step = g.step AND o.a = g.a GROUP BY m.step, m.tweet_id, m.n)
SELECT step, tweet_id, round(score / sum(score) OVER (PARTITION BY step), 6) AS score FROM x""")
def gr12_lexrank_scores_1(spark: SparkSession, sf: str) -> DataFrame:
    from stormglass.operators import lexrank

    return lexrank.step_scores(P.words(spark, sf), iterations=1).select("step", "tweet_id", F.round("score", 6).alias("score"))


#: x0 ... x50: the scores after each round; each is divided by its sum.
LEXRANK = f"""{STEP_SIM}, g AS (SELECT step, a, b, similarity AS s FROM sim WHERE round(similarity, 9) >= 0.2 UNION ALL SELECT step, b, a, similarity FROM sim WHERE round(similarity, 9) >= 0.2),
q AS MATERIALIZED (SELECT step, a, b, s / sum(s) OVER (PARTITION BY step, a) AS p FROM g), m AS MATERIALIZED (SELECT w.step, tweet_id, n FROM w JOIN n USING (step)),
x0 AS MATERIALIZED (SELECT step, tweet_id, 1.0 / n AS score FROM m)""" + "".join(
    f""", y{k} AS (SELECT q.step, q.b AS tweet_id, sum(score * p) AS s FROM x{k - 1} x JOIN q ON q.step = x.step AND q.a = x.tweet_id GROUP BY ALL),
x{k} AS MATERIALIZED (SELECT m.step, m.tweet_id, (0.15 / n + 0.85 * coalesce(s, 0)) / sum(0.15 / n + 0.85 * coalesce(s, 0)) OVER (PARTITION BY m.step) AS score FROM m LEFT JOIN y{k} USING (step, tweet_id))""" for k in range(1, 51)
)


@query(f"WITH {LEXRANK} SELECT step, tweet_id, round(score, 6) AS score FROM x50")
def gr12_lexrank_scores(spark: SparkSession, sf: str) -> DataFrame:
    from stormglass.operators import lexrank

    return lexrank.step_scores(P.words(spark, sf)).withColumn("score", F.round("score", 6))


@query(f"WITH {WINDOW_SIM} SELECT step AS snapshot, a, b, round(similarity, 6) AS similarity FROM sim WHERE round(similarity, 9) >= 0.2 ORDER BY similarity, a, b")
def top4_sort_scores(spark: SparkSession, sf: str) -> DataFrame:
    return jn4_window_pairs(spark, sf).orderBy("similarity", "a", "b")
