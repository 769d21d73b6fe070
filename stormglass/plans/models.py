"""Queries of the summary models and of the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stormglass.functions import text as X
from stormglass.functions.times import created
from stormglass.operators import cluster, evaluate, lexrank, paths, select, topics
from stormglass.operators import steps as S
from stormglass.operators import vectors as V
from stormglass.runtime import materialize, scratch_dir, stream_table, table
from stormglass.sources import posts as P
from stormglass.streaming import clusters, windows

from .registry import SNAPSHOTS, WORDS, query
from .vectors import CORE, LEXRANK, TAGGED


def windows_of(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    words = P.words(spark, sf)
    return words, S.snapshots(words.select("tweet_id", "step", "created_at_ms", "terms"))


def with_text(spark: SparkSession, sf: str, chosen: DataFrame) -> DataFrame:
    return chosen.join(P.posts(spark, sf).select("tweet_id", "text"), "tweet_id")


@query()
def inc_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: subtopics of the word graph, posts that cover them, none redundant."""
    words, snaps = windows_of(spark, sf)
    return with_text(spark, sf, select.inc_summary(words, snaps)).select(F.col("snapshot").alias("step"), "rank_no", "tweet_id", "text", F.round("score", 6).alias("score"))


@query()
def gr10_diversify_cover(spark: SparkSession, sf: str) -> DataFrame:
    words, snaps = windows_of(spark, sf)
    return select.inc_summary(words, snaps, cover=0.5)


@query()
def gr11_alt_selectors(spark: SparkSession, sf: str) -> DataFrame:
    """What each way to choose posts for the subtopics gives, and the first with representative posts only."""
    words, snaps = windows_of(spark, sf)
    ways = {s: {"score": s} for s in select.SELECTORS} | {"representative": {"representative": True}}
    return select.inc_summary(words, snaps, stage="posts", ways=ways)


#: sw: the posts of each window under its snapshot as step; the rest as for the posts of a step.
WINDOW_RANK = f"""{SNAPSHOTS}, sw AS MATERIALIZED (SELECT snapshot AS step, tweet_id, terms FROM snap){LEXRANK[len(WORDS) :].replace("FROM w ", "FROM sw ").replace("FROM w)", "FROM sw)").replace("SELECT w.step", "SELECT sw.step").replace("FROM sw JOIN n", "FROM sw JOIN n")},
near AS (SELECT step, a AS tweet_id, list(b) AS near FROM g WHERE round(s, 9) >= 0.5 GROUP BY ALL),
ordered AS (SELECT step, list({{'id': tweet_id, 'score': score, 'near': coalesce(near, [])}} ORDER BY round(score, 12) DESC, tweet_id) AS xs FROM x50 LEFT JOIN near USING (step, tweet_id) GROUP BY step),
chosen AS (SELECT step, list_reduce(list_transform(xs, lambda x: [x]), lambda acc, x: CASE WHEN len(acc) < 20 AND len(list_intersect(list_transform(acc, lambda k: k.id), x[1].near)) = 0 THEN acc || x ELSE acc END) AS xs FROM ordered)"""


@query(f"WITH {WINDOW_RANK}, u AS (SELECT step, unnest(xs) AS x, unnest(range(1, len(xs) + 1)) AS rank_no FROM chosen) SELECT u.step, CAST(rank_no AS INT) AS rank_no, x.id AS tweet_id, p.text, round(x.score, 6) AS score FROM u JOIN p ON p.tweet_id = x.id")
def gr13_lexrank_summary(spark: SparkSession, sf: str) -> DataFrame:
    _, snaps = windows_of(spark, sf)
    return with_text(spark, sf, lexrank.summary(snaps)).select(F.col("snapshot").alias("step"), "rank_no", "tweet_id", "text", F.round("score", 6).alias("score"))


@query()
def gr18_mmr_summary(spark: SparkSession, sf: str) -> DataFrame:
    words, _ = windows_of(spark, sf)
    return with_text(spark, sf, cluster.micro_cluster_summary(words)).select("step", "rank_no", "tweet_id", "text", F.round("score", 6).alias("score"))


def tagged_windows(spark: SparkSession, sf: str) -> DataFrame:
    _, snaps = windows_of(spark, sf)
    tagged = materialize(paths.tagged(P.posts(spark, sf), "tweet_id", "text"))
    return snaps.select("snapshot", "tweet_id", "created_at_ms").join(tagged, "tweet_id")


@query()
def gr20_path_search(spark: SparkSession, sf: str) -> DataFrame:
    """The sentences of each window: those left of similar ones, the 20 of the most gain."""
    order = Window.partitionBy("snapshot").orderBy(F.desc("gain"), "nodes")
    found = paths.candidates(tagged_windows(spark, sf), keep="different")
    return found.withColumn("rank_no", F.row_number().over(order)).where(F.col("rank_no") <= paths.MOST)


KMEANS = """e AS MATERIALIZED (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), en AS MATERIALIZED (SELECT vec_id, sqrt(sum(x * x)) AS n FROM e GROUP BY vec_id),
st AS (SELECT vec_id, row_number() OVER (ORDER BY md5(vec_id::VARCHAR)) - 1 AS c FROM embeddings QUALIFY c < 10), k0 AS MATERIALIZED (SELECT c, i, x FROM e JOIN st USING (vec_id))""" + "".join(
    f""", a{k} AS MATERIALIZED (SELECT vec_id, c FROM (SELECT e.vec_id, k.c, row_number() OVER (PARTITION BY e.vec_id ORDER BY round(sum(e.x * k.x) / (any_value(en.n) * any_value(kn.n)), 9) DESC, k.c) AS rn
FROM e JOIN k{k - 1} k USING (i) JOIN en ON en.vec_id = e.vec_id JOIN (SELECT c, sqrt(sum(x * x)) AS n FROM k{k - 1} GROUP BY c) kn ON kn.c = k.c GROUP BY e.vec_id, k.c) WHERE rn = 1), k{k} AS MATERIALIZED (SELECT c, i, avg(x) AS x FROM e JOIN a{k} USING (vec_id) GROUP BY c, i)""" for k in range(1, 12)
)


@query(f"WITH {KMEANS} SELECT vec_id, CAST(c AS INT) AS cluster FROM a11")
def gr14_kmeans(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.kmeans(table(spark, sf, "embeddings"), "vec_id", "embedding")


_FITTED: dict[tuple[str, str], tuple] = {}


def topic_model(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The posts with their terms, the core of these, and the model fitted on all of it, once for an application and input."""
    name = (spark.sparkContext.applicationId, sf)
    if name not in _FITTED:
        words = P.words(spark, sf)
        core = topics.core_terms(words.select("tweet_id", F.explode("terms").alias("term")))
        _FITTED[name] = (words, core, *topics.fit(core))
    return _FITTED[name]


@query()
def gr24_gibbs_topics(spark: SparkSession, sf: str) -> DataFrame:
    return topic_model(spark, sf)[2]


@query()
def ground_truth(spark: SparkSession, sf: str) -> DataFrame:
    """The reference summaries: posts that represent the fitted topics of each window."""
    words, core, phi, theta = topic_model(spark, sf)
    return topics.representatives(topics.in_windows(topics.infer(core, phi, theta), words.select("tweet_id", "step", "terms")))


#: phi, theta: the topics are the days; inf: each core post's most probable one.
GIVEN = f"""{CORE}, d AS MATERIALIZED (SELECT k15.tweet_id, term, CAST(step // 24 AS INT) AS topic FROM k15 JOIN s USING (tweet_id)), tt AS (SELECT topic, count(*) AS l, count(DISTINCT tweet_id) AS p FROM d GROUP BY topic),
vv AS (SELECT count(DISTINCT term) AS v, count(DISTINCT tweet_id) AS p FROM d), tw AS (SELECT topic, term, count(*) AS n FROM d GROUP BY ALL), cells AS (SELECT topic, l, term FROM tt, (SELECT DISTINCT term FROM d)),
phi AS MATERIALIZED (SELECT c.topic, c.term, (coalesce(n, 0) + 0.01) / (l + v * 0.01) AS phi FROM cells c CROSS JOIN vv LEFT JOIN tw ON tw.topic = c.topic AND tw.term = c.term), theta AS (SELECT topic, tt.p / vv.p AS theta FROM tt, vv),
lk AS (SELECT tweet_id, topic, sum(n * ln(phi)) + ln(any_value(theta)) AS l, avg(phi) AS mean, count(*) AS n_unique FROM (SELECT tweet_id, term, count(*) AS n FROM k15 GROUP BY ALL) JOIN phi USING (term) JOIN theta USING (topic) GROUP BY tweet_id, topic),
pb AS (SELECT *, exp(l - max(l) OVER (PARTITION BY tweet_id)) AS e FROM lk),
inf AS MATERIALIZED (SELECT tweet_id, topic, e / whole AS posterior, n_unique, CASE WHEN n_unique >= 7 THEN mean ELSE 0 END AS score FROM (SELECT *, sum(e) OVER (PARTITION BY tweet_id) AS whole, row_number() OVER (PARTITION BY tweet_id ORDER BY l DESC, topic) AS rn FROM pb) WHERE rn = 1),
win AS (SELECT q.step AS snapshot, w.tweet_id, w.terms, i.topic, i.score FROM (SELECT DISTINCT step FROM w) q JOIN w ON w.step > q.step - 12 AND w.step <= q.step JOIN inf i ON i.tweet_id = w.tweet_id WHERE n_unique >= 5 AND posterior >= 0.8),
sh AS (SELECT snapshot, topic, count(*) / sum(count(*)) OVER (PARTITION BY snapshot) AS share FROM win GROUP BY snapshot, topic)"""


def given_model(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """As :func:`topic_model` with the days as topics, and the posts inferred from it."""
    words = P.words(spark, sf)
    core = topics.core_terms(words.select("tweet_id", F.explode("terms").alias("term")))
    phi, theta = topics.given(core, words.select("tweet_id", F.floor(F.col("step") / 24).cast("int").alias("topic")))
    phi = materialize(phi)
    return words, core, phi, theta, topics.infer(core, phi, theta)


@query(f"WITH {GIVEN} SELECT tweet_id, topic, round(posterior, 6) AS posterior, n_unique FROM inf")
def gr25_infer_topic(spark: SparkSession, sf: str) -> DataFrame:
    return given_model(spark, sf)[4].select("tweet_id", "topic", F.round("posterior", 6).alias("posterior"), "n_unique")


@query(f"WITH {GIVEN} SELECT tweet_id, topic, round(score, 9) AS score FROM inf")
def gr26_topic_post_score(spark: SparkSession, sf: str) -> DataFrame:
    return given_model(spark, sf)[4].select("tweet_id", "topic", F.round("score", 9).alias("score"))


@query(f"WITH {GIVEN} SELECT tweet_id, topic FROM inf WHERE n_unique >= 5 AND posterior >= 0.8")
def flt5_confident_post(spark: SparkSession, sf: str) -> DataFrame:
    return topics.confident(given_model(spark, sf)[4]).select("tweet_id", "topic")


@query(f"WITH {GIVEN} SELECT snapshot, topic, round(share, 9) AS share FROM sh")
def agg11_topic_share(spark: SparkSession, sf: str) -> DataFrame:
    words, _, _, _, inferred = given_model(spark, sf)
    return topics.topic_share(topics.in_windows(inferred, words.select("tweet_id", "step"))).withColumn("share", F.round("share", 9))


@query(f"""WITH {GIVEN}, tp AS (SELECT snapshot, topic, share FROM (SELECT *, coalesce(sum(share) OVER (PARTITION BY snapshot ORDER BY share DESC, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sh) WHERE round(before, 9) < 0.9),
b AS (SELECT snapshot, topic, tweet_id, list_distinct(terms) AS terms FROM win QUALIFY row_number() OVER (PARTITION BY snapshot, topic ORDER BY round(score, 12) DESC, tweet_id) = 1),
o AS (SELECT snapshot, list({{'id': tweet_id, 'topic': topic, 'terms': terms}} ORDER BY share DESC, topic) AS xs FROM b JOIN tp USING (snapshot, topic) GROUP BY snapshot),
r AS (SELECT snapshot, list_reduce(list_transform(xs, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: len(list_intersect(k.terms, x[1].terms)) / len(list_distinct(k.terms || x[1].terms)) >= 0.5)) = 0 THEN acc || x ELSE acc END) AS xs FROM o),
u AS (SELECT snapshot, unnest(xs) AS x, unnest(range(1, len(xs) + 1)) AS rank_no FROM r) SELECT snapshot, CAST(rank_no AS INT) AS rank_no, x.id AS tweet_id, x.topic AS topic FROM u""")
def gr27_representatives(spark: SparkSession, sf: str) -> DataFrame:
    words, _, _, _, inferred = given_model(spark, sf)
    return topics.representatives(topics.in_windows(inferred, words.select("tweet_id", "step", "terms")))


MODEL_FILES = f"""{GIVEN}, tops AS (SELECT topic, term, phi FROM phi QUALIFY row_number() OVER (PARTITION BY topic ORDER BY phi DESC, term) <= 10),
best AS (SELECT topic, score FROM inf QUALIFY row_number() OVER (PARTITION BY topic ORDER BY score DESC, tweet_id) <= 5), st AS (SELECT step, topic, count(*) AS n FROM inf JOIN s USING (tweet_id) GROUP BY ALL),
h AS (SELECT topic, tweet_id, term FROM (SELECT DISTINCT tweet_id, term FROM k15) JOIN tops USING (term)), c AS (SELECT topic, term, count(*) AS n FROM h GROUP BY ALL),
co AS (SELECT x.topic, x.term AS u, y.term AS v, count(*) AS m FROM h x JOIN h y ON x.topic = y.topic AND x.tweet_id = y.tweet_id AND x.term <> y.term GROUP BY ALL),
ch AS (SELECT a.topic, sum(ln((coalesce(m, 0) + 1) / a.n)) / 45 AS coherence FROM c a JOIN c b ON a.topic = b.topic AND a.term <> b.term LEFT JOIN co ON co.topic = a.topic AND u = a.term AND v = b.term GROUP BY a.topic)"""


@query(f"""WITH {MODEL_FILES} SELECT 'words' AS file, count(DISTINCT term) AS n, 0.0 AS total FROM phi UNION ALL SELECT 'topicWordDistributions', count(*), round(sum(phi), 4) FROM phi UNION ALL SELECT 'topWords', count(*), round(sum(phi), 4) FROM tops
UNION ALL SELECT 'topPosts', count(*), round(sum(score), 4) FROM best UNION ALL SELECT 'stepTopics', count(*), CAST(count(DISTINCT step) AS DOUBLE) FROM st UNION ALL SELECT 'coherence', count(*), round(sum(coherence), 4) FROM ch UNION ALL SELECT 'topics', count(*), round(sum(theta), 4) FROM theta""")
def snk3_write_topic_model(spark: SparkSession, sf: str) -> DataFrame:
    """The files of a model as read back: their lines and the sum of their values."""
    words, core, phi, theta, inferred = given_model(spark, sf)
    path = scratch_dir(spark)
    topics.write_model(path, core, phi, theta, materialize(inferred), words.select("tweet_id", "step", "text"))
    kinds = {"words": "term string", "topicWordDistributions": "topic int, term string, value double", "topWords": "topic int, term string, value double", "topPosts": "topic int, tweet_id string, value double, text string", "stepTopics": "step int, topic int, value double", "coherence": "topic int, value double", "topics": "topic int, value double"}
    out = None
    for name, kind in kinds.items():
        rows = spark.read.schema(kind).option("escape", '"').csv(f"{path}/{name}")
        total = F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 4) if "value" in kind else F.lit(0.0)
        one = rows.agg(F.count(F.lit(1)).alias("n"), total.alias("total")).select(F.lit(name).alias("file"), "n", "total")
        out = one if out is None else out.unionAll(one)
    return out


@query()
def eval_models(spark: SparkSession, sf: str) -> DataFrame:
    """Our own models against each other: the ranking of posts against the flagship."""
    own, ref = gr13_lexrank_summary(spark, sf).where("rank_no <= 10"), inc_summary(spark, sf).where("rank_no <= 10")
    lines = P.words_of(spark, sf, own.withColumn("model", F.lit("lexrank")), "text")
    return evaluate.rouge(lines, P.words_of(spark, sf, ref, "text"), "step")


@query(f"WITH {TAGGED} SELECT tweet_id, array_to_string(nodes, ' ') AS tagged FROM g")
def txt9_pos_tag(spark: SparkSession, sf: str) -> DataFrame:
    return paths.tagged(P.posts(spark, sf), "tweet_id", "text").select("tweet_id", F.array_join("nodes", " ").alias("tagged"))


@query(f"WITH {TAGGED} SELECT tweet_id, len(nodes) AS n, len(list_filter(nodes, lambda n: ends_with(n, '/nn'))) + len(list_filter(nodes, lambda n: NOT ends_with(n, '/nn') AND NOT ends_with(n, '/.'))) AS n_words FROM g")
def txt9_tagger_hook(spark: SparkSession, sf: str) -> DataFrame:
    """The tagger is a parameter: here one that knows only ends and words."""
    own = paths.tagged(P.posts(spark, sf), "tweet_id", "text", lambda w: F.when(w.rlike("^[.!?;]+$"), ".").otherwise("nn"))
    return own.select("tweet_id", F.size("nodes").cast("bigint").alias("n"), F.size(F.filter("nodes", lambda n: n.endswith("/nn"))).cast("bigint").alias("n_words"))


@query(r"SELECT tweet_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '/[a-z]+', '', 'g'), '\bxx\b', '', 'g'), ' +', ' ', 'g')) || ' .' AS sentence FROM posts")
def txt10_strip_tags(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "posts").select("tweet_id", X.strip_tags(F.col("text")).alias("sentence"))


@query(f"WITH g AS (SELECT summary_id, {paths.tag_text_sql('text')} AS nodes FROM summaries), j AS (SELECT summary_id, array_to_string(nodes[:-2], ' ') AS sentence FROM g) SELECT summary_id, {paths.valid_sql('sentence')} AS valid FROM j")
def txt11_valid_candidate(spark: SparkSession, sf: str) -> DataFrame:
    """Summary posts as candidates, without the stop they end with."""
    body = F.array_join(F.slice("nodes", 1, F.size("nodes") - 1), " ")
    return paths.tagged(table(spark, sf, "summaries"), "summary_id", "text").select("summary_id", paths.valid(body).alias("valid"))


def _is(pattern: str) -> str:
    return f"regexp_full_match(node, '{pattern}')"


@query(f"""WITH {TAGGED}, o AS (SELECT unnest(nodes) AS node, unnest(range(0, len(nodes))) AS i FROM g), n AS (SELECT node, count(*) AS n, avg(i) AS pos FROM o GROUP BY node)
SELECT node, n, round(pos, 6) AS avg_position, pos <= {paths.START_BEFORE} AND ({_is(paths.START_TAGS)} OR {_is(paths.START_NAMES)}) AS starts, {_is(paths.END_TOKENS)} AS ends, {_is(paths.COLLAPSIBLE)} AS collapsible, {_is(paths.STOP_ADDING)} AS stops FROM n""")
def txt12_node_class(spark: SparkSession, sf: str) -> DataFrame:
    return paths.node_classes(paths.tagged(P.posts(spark, sf), "tweet_id", "text"), "nodes").withColumn("avg_position", F.round("avg_position", 6))


@query("SELECT n_length, overlap, CAST(overlap AS DOUBLE) AS plain, CAST(overlap * n_length AS DOUBLE) AS by_length, round(overlap * log2(n_length), 6) AS by_log FROM (SELECT unnest(range(1, 19)) AS n_length), (SELECT unnest(range(1, 6)) AS overlap)")
def mth9_path_score(spark: SparkSession, sf: str) -> DataFrame:
    n = spark.range(1, 19).select(F.col("id").alias("n_length"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(5).cast("bigint"))).alias("overlap"))
    score = lambda kind: paths.path_score(F.col("overlap"), F.col("n_length"), kind)
    return n.select("n_length", "overlap", score("plain").alias("plain"), score("length").cast("double").alias("by_length"), F.round(score("log"), 6).alias("by_log"))


def stream_words(spark: SparkSession, sf: str) -> DataFrame:
    p = stream_table(spark, sf, "posts")
    return P.words_of(spark, sf, p, "text").withColumn("at", F.timestamp_millis("created_at_ms"))


CLOSED = f"""{X.STOP_SQL}, x AS (SELECT make_timestamp(created_at_ms * 1000) AS ts, unnest({X.extract_terms_sql('text')}) AS term FROM posts, stop), mx AS (SELECT max(make_timestamp(created_at_ms // 1 * 1000)) AS m FROM posts)"""


@query(f"WITH {CLOSED} SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, term, count(*) AS n FROM x, mx WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= m - INTERVAL 1 HOUR GROUP BY ALL")
def st1_tumbling_trigger(spark: SparkSession, sf: str) -> DataFrame:
    terms = stream_words(spark, sf).select("at", F.explode("terms").alias("term"))
    out = windows.run_to_table(windows.tumbling_terms(terms, "at"), scratch_dir(spark))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "term", "n")


@query(f"""WITH {CLOSED}, s AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(unnest(range(0, 12))::INT) AS start, term FROM x)
SELECT start, term, count(*) AS n FROM s, mx WHERE start + INTERVAL 12 HOUR <= m - INTERVAL 1 HOUR GROUP BY ALL""")
def st3_sliding_window(spark: SparkSession, sf: str) -> DataFrame:
    terms = stream_words(spark, sf).select("at", F.explode("terms").alias("term"))
    out = windows.run_to_table(windows.sliding_terms(terms, "at"), scratch_dir(spark))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "term", "n")


@query("""WITH o AS (SELECT coalesce(user_id, '-') AS key, created_at_ms AS ms, row_number() OVER (PARTITION BY coalesce(user_id, '-') ORDER BY created_at_ms) - 1 AS i FROM posts)
SELECT key, CAST(i // 6 AS INT) AS bucket, CAST(6 AS INT) AS n, min(ms) AS first_ms, max(ms) AS last_ms FROM o GROUP BY key, i // 6 HAVING count(*) = 6""")
def st2_st4_count_trigger(spark: SparkSession, sf: str) -> DataFrame:
    p = stream_table(spark, sf, "posts").select(F.coalesce("user_id", F.lit("-")).alias("key"), "created_at_ms")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return windows.run_to_table(windows.count_trigger(p, "key", 6), scratch_dir(spark))
    finally:
        spark.conf.set(name, before)


@query(f"""WITH {WORDS}, c AS (SELECT step, term, count(*) AS n FROM (SELECT p.tweet_id, s.step, unnest(w.terms) AS term FROM p JOIN s USING (tweet_id) JOIN w USING (tweet_id)) GROUP BY ALL)
SELECT step, term, n FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY n DESC, term) AS rn FROM c) WHERE rn <= 5""")
def st7_output_per_step(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    ref = P.posts(spark, sf).agg(F.min("created_at_ms")).first()[0]
    p = stream_table(spark, sf, "posts").withColumn("step", S.time_step(F.col("created_at_ms"), ref))
    stream = P.words_of(spark, sf, p, "text").select("tweet_id", "step", "terms")

    def top(rows: DataFrame) -> DataFrame:
        counts = V.term_count(rows.dropDuplicates(["tweet_id"]), "step")
        return counts.withColumn("rn", F.row_number().over(Window.partitionBy("step").orderBy(F.desc("n"), "term"))).where("rn <= 5").drop("rn")

    return windows.per_batch(stream, scratch_dir(spark), top).select("step", "term", "n")


@query()
def st5_st6_online_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Micro-clusters per language stream of the raw posts, tracked live: the first deliveries come
    in batches of days, and what is known of a stream is state between them."""
    h = table(spark, sf, "hurricane_harvey").where("id IS NOT NULL AND text IS NOT NULL")
    first = h.groupBy("id").agg(F.min(F.struct("delivery_id", "lang", "created_at", "text")).alias("m")).select(F.col("id").cast("string").alias("tweet_id"), F.coalesce(F.lower("m.lang"), F.lit("-")).alias("lang"), F.unix_millis(created(F.col("m.created_at"))).alias("created_at_ms"), F.col("m.text").alias("text"))
    words = P.words_of(spark, sf, S.with_step(first.where("created_at_ms IS NOT NULL")), "text").where(F.size("terms") >= 1)
    rows = materialize(words.select("tweet_id", "step", "created_at_ms", "terms", "lang"))
    path = scratch_dir(spark)
    return windows.replay(rows, "step", 4, lambda stream: windows.run_to_table(clusters.cluster_stream(stream, "lang"), path))
