"""Queries over sources, rows, texts, sets and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stormglass.functions import text as X
from stormglass.functions.times import created
from stormglass.operators import steps as S
from stormglass.runtime import materialize, scratch_dir, table
from stormglass.sources import posts as P
from stormglass.sources import sinks

from .registry import POSTS, SNAPSHOTS, STEPPED, WORDS, query

LINE = "regexp_replace(coalesce(text, ''), '[\\r\\n\\t]', ' ', 'g')"
CREATED = "coalesce(CAST(try_strptime(created_at, '%a %b %d %H:%M:%S %z %Y') AS TIMESTAMPTZ) AT TIME ZONE 'UTC', try_cast(created_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC')"
MS = f"epoch_us({CREATED}) // 1000"


@query(f"SELECT tweet_id, created_at_ms, user_id, {LINE} AS text FROM posts")
def src1_scan_tsv_dir(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark)
    sinks.write_tsv(table(spark, sf, "posts"), path)
    return P.read_tsv(spark, path).select("tweet_id", "created_at_ms", "user_id", "text")


@query(f"WITH {POSTS} SELECT tweet_id, created_at_ms FROM (SELECT *, row_number() OVER (ORDER BY created_at_ms, tweet_id) AS i FROM p) WHERE i > 200")
def src2_skip_first_n(spark: SparkSession, sf: str) -> DataFrame:
    return S.skip_first(P.posts(spark, sf), 200, "created_at_ms", "tweet_id", key="tweet_id").select("tweet_id", "created_at_ms")


@query("SELECT delivery_id FROM hurricane_harvey WHERE NOT starts_with(text, 'I liked a @YouTube video')")
def src3_valid_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "hurricane_harvey").where(X.is_valid(F.col("text"))).select("delivery_id")


@query("SELECT id, lang, user_obj.id AS user_id, created_at, text FROM hurricane_harvey WHERE id IS NOT NULL")
def src4_scan_json_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark)
    sinks.write_json(table(spark, sf, "hurricane_harvey").select("id", "lang", F.col("user_obj").alias("user"), "created_at", "text"), path)
    return P.read_json(spark, path).select("id", "lang", F.col("user.id").alias("user_id"), "created_at", "text")


@query("SELECT delivery_id, batch_file FROM (SELECT *, row_number() OVER (ORDER BY delivery_id) - 1 AS i FROM hurricane_harvey) WHERE i >= 1000 AND i < 2000")
def src5_slice_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = S.with_index(table(spark, sf, "hurricane_harvey").select("delivery_id", "batch_file"), "delivery_id")
    return lines.where("index >= 1000 AND index < 2000").select("delivery_id", "batch_file")


@query("SELECT DISTINCT trim(tweet_id) AS tweet_id FROM id_list WHERE trim(tweet_id) <> ''")
def src6_scan_id_list(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark)
    table(spark, sf, "id_list").select(F.coalesce("tweet_id", F.lit("")).alias("value")).write.text(path)
    return P.read_ids(spark, path)


@query("SELECT DISTINCT lower(word) AS word FROM stop_words WHERE word <> '' UNION SELECT unnest(['//t', 'http', 'https'])")
def src7_scan_stopwords(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark)
    words = table(spark, sf, "stop_words").where("word IS NOT NULL")
    words.groupBy("list_no").agg(F.array_join(F.collect_list("word"), ",").alias("value")).write.partitionBy("list_no").text(path)
    return P.read_stop_words(spark, path).select("word")


@query("SELECT step, model, CAST(i AS INT) AS rank_no, text FROM (SELECT step, model, regexp_replace(text, '[\\r\\n]', ' ', 'g') AS text, row_number() OVER (PARTITION BY step, model ORDER BY rank_no, text) AS i FROM summaries) WHERE i <= 3")
def src8_scan_summary_file(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark)
    sinks.write_summary_files(table(spark, sf, "summaries"), path, "step", "model")
    lines = P.read_summaries(spark, path, 3)
    return lines.select(F.regexp_extract("path", r"step=(\d+)", 1).cast("int").alias("step"), F.regexp_extract("path", r"model=([^/]+)", 1).alias("model"), "rank_no", "text")


RAW_LINE = "tweet_id || ' ' || coalesce(user_id, '-') || ' ' || created_at_ms || ' en ' || trim(regexp_replace(text, '[\\s\\x0B\\x{85}\\x{2028}\\x{2029}]+', ' ', 'g'))"


@query(f"""WITH l AS (SELECT {RAW_LINE} AS line FROM posts WHERE tweet_id IS NOT NULL AND text IS NOT NULL)
SELECT regexp_extract(line, '^[^ ]+') AS id, nullif(regexp_extract(line, '^(?:[^ ]+ +){{7}}(.+)$', 1), '') AS text, len(regexp_extract_all(regexp_extract(line, '^(?:[^ ]+ +){{4}}(.+)$', 1), '[^ ]+')) AS n_tokens FROM l""")
def src9_scan_raw_tokens(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark)
    text = F.trim(F.regexp_replace("text", r"[\s\x0B\x{85}\x{2028}\x{2029}]+", " "))
    p = table(spark, sf, "posts").where("tweet_id IS NOT NULL AND text IS NOT NULL")
    p.select(F.concat_ws(" ", "tweet_id", F.coalesce("user_id", F.lit("-")), F.col("created_at_ms").cast("string"), F.lit("en"), text).alias("value")).write.text(path)
    both = P.read_raw(spark, path, 8).select("id", F.nullif("rest", F.lit("")).alias("text")), P.read_raw(spark, path, 5).select("id", "tokens", "rest")
    numbered = [b.withColumn("line", F.monotonically_increasing_id()) for b in both]
    n = F.when(F.coalesce("rest", F.lit("")) == "", 0).otherwise(F.size("tokens")).cast("bigint")
    return numbered[0].join(numbered[1].select("line", n.alias("n_tokens")), "line").select("id", "text", "n_tokens")


@query("SELECT step, model, rank_no, regexp_replace(text, '[\\r\\n]', ' ', 'g') AS text FROM summaries")
def snk1_write_step_summary(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark)
    rows = table(spark, sf, "summaries").select("step", "model", "rank_no", "text")
    sinks.write_step_summary(rows, path)
    sinks.write_step_summary(rows.where("step = 1"), path)
    return spark.read.parquet(path).select("step", "model", "rank_no", "text")


@query("SELECT line, count(*) AS n FROM (SELECT regexp_replace(text, '[\\r\\n]', ' ', 'g') AS line FROM summaries UNION ALL SELECT DISTINCT '********** step = ' || step || ' ************ ' FROM summaries) GROUP BY line")
def snk2_append_log(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark)
    rows = table(spark, sf, "summaries")
    sinks.append_log(rows.where("step <= 25"), path)
    sinks.append_log(rows.where("step > 25"), path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT tweet_id || chr(9) || 'null' || chr(9) || created_at_ms || chr(9) || coalesce(user_id, '') || chr(9) || {LINE} AS line FROM posts")
def snk5_write_tsv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark)
    sinks.write_tsv(table(spark, sf, "posts"), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(r"""WITH b AS (SELECT DISTINCT model AS baseline FROM summaries WHERE model <> 'inc'), t AS (SELECT DISTINCT step FROM summaries), ks AS (SELECT unnest([3, 5]) AS top_k),
p AS (SELECT baseline, step, top_k FROM b, t, ks)
SELECT baseline, p.step, top_k, count(DISTINCT rank_no) AS n_rows, count(*) AS n_cells FROM p JOIN summaries s ON s.step = p.step AND s.model IN ('inc', baseline) AND rank_no <= top_k GROUP BY ALL""")
def snk6_write_ab_html(spark: SparkSession, sf: str) -> DataFrame:
    """The pages as read back: each has a row per rank and both posts where there are both."""
    path, s = scratch_dir(spark), table(spark, sf, "summaries")
    rows = s.select("model", "step").distinct().collect()
    plan = materialize(sinks.ab_plan(spark, sorted({r["model"] for r in rows} - {"inc"}), sorted({r["step"] for r in rows}), [3, 5]))
    sinks.ab_pages(s, plan, path)
    pages = spark.read.text(f"{path}/pages", wholetext=True)
    cells = F.regexp_extract_all("value", F.lit("<td>([^<]*)</td><td>([^<]*)</td><td>"), F.lit(1))
    found = pages.select(F.col("index").cast("int").alias("index"), F.size(cells).cast("bigint").alias("n_rows"), F.size(F.regexp_extract_all("value", F.lit("<td>([^<]+)</td>"), F.lit(1))).cast("bigint").alias("n_all"))
    key = spark.read.option("header", True).schema("index int, baseline string, step int, inc_set int, top_k int").csv(f"{path}/key")
    return key.join(found, "index").select("baseline", "step", "top_k", "n_rows", (F.col("n_all") - F.col("n_rows")).alias("n_cells"))


@query(f"WITH {STEPPED} SELECT tweet_id, step FROM s")
def prj1_time_step(spark: SparkSession, sf: str) -> DataFrame:
    return S.with_step(P.posts(spark, sf)).select("tweet_id", "step")


@query(f"SELECT CAST(id AS VARCHAR) AS tweet_id, 'null' AS unused, {MS} AS created_at_ms, CAST(user_obj.id AS VARCHAR) AS user_id, regexp_replace(text, '[\\r\\n]', ' ', 'g') AS text FROM hurricane_harvey WHERE id IS NOT NULL")
def prj2_json_to_tsv(spark: SparkSession, sf: str) -> DataFrame:
    return P.as_tsv_rows(table(spark, sf, "hurricane_harvey").where("id IS NOT NULL"))


@query("SELECT doc_id FROM documents WHERE lang = 'en'")
def flt1_lang_en(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("lang = 'en'").select("doc_id")


@query(f"SELECT delivery_id FROM hurricane_harvey WHERE CAST({CREATED} AS DATE) IN (DATE '2019-08-25', DATE '2019-08-27')")
def flt2_date_in(spark: SparkSession, sf: str) -> DataFrame:
    day = F.to_date(created(F.col("created_at")))
    return table(spark, sf, "hurricane_harvey").where(day.isin("2019-08-25", "2019-08-27")).select("delivery_id")


@query(f"WITH {WORDS} SELECT tweet_id, len(terms) AS n_terms FROM w")
def flt3_has_terms(spark: SparkSession, sf: str) -> DataFrame:
    return P.words(spark, sf).select("tweet_id", F.size("terms").cast("bigint").alias("n_terms"))


@query("SELECT delivery_id FROM hurricane_harvey WHERE starts_with(trim(text), 'RT @')")
def flt4_is_retweet(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "hurricane_harvey").where(X.is_retweet(F.col("text"))).select("delivery_id")


@query("SELECT count(*) AS n FROM (SELECT id, max(id) OVER (ORDER BY delivery_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM hurricane_harvey WHERE id IS NOT NULL) WHERE id <= before")
def flt6_order_violations(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.running_max(table(spark, sf, "hurricane_harvey").where("id IS NOT NULL").select("delivery_id", "id"), "delivery_id", "id")
    return rows.where("id <= before").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT delivery_id, max(id) OVER (ORDER BY delivery_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM hurricane_harvey WHERE id IS NOT NULL")
def win4_running_max(spark: SparkSession, sf: str) -> DataFrame:
    return S.running_max(table(spark, sf, "hurricane_harvey").where("id IS NOT NULL").select("delivery_id", "id"), "delivery_id", "id").select("delivery_id", "before")


@query(f"WITH {WORDS} SELECT tweet_id FROM w WHERE list_contains(terms, 'bayou')")
def flt7_node_contains(spark: SparkSession, sf: str) -> DataFrame:
    return P.words(spark, sf).where(F.array_contains("terms", "bayou")).select("tweet_id")


@query(f"WITH {STEPPED} SELECT tweet_id, step FROM s WHERE step >= 24 AND step < 48")
def flt8_step_range(spark: SparkSession, sf: str) -> DataFrame:
    return S.with_step(P.posts(spark, sf)).where("step >= 24 AND step < 48").select("tweet_id", "step")


@query("SELECT tweet_id, created_at_ms FROM posts WHERE tweet_id IN (SELECT trim(tweet_id) FROM id_list)")
def jn1_semi_join_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "posts").join(P.id_list(spark, sf), "tweet_id", "left_semi").select("tweet_id", "created_at_ms")


@query("""SELECT id, prio FROM (SELECT id, prio, row_number() OVER (PARTITION BY id ORDER BY prio) AS rn FROM (
  SELECT id, 0 AS prio FROM hurricane_harvey WHERE source = 'web_client' UNION ALL SELECT id, 1 FROM hurricane_harvey WHERE source = 'droid_app' UNION ALL SELECT try_cast(tweet_id AS BIGINT), 2 FROM posts)
  WHERE id IN (SELECT try_cast(trim(tweet_id) AS BIGINT) FROM id_list)) WHERE rn = 1""")
def jn2_semi_join_first_source(spark: SparkSession, sf: str) -> DataFrame:
    h = table(spark, sf, "hurricane_harvey")
    a, b = (h.where(F.col("source") == s).select("id", F.lit(i).alias("prio")) for i, s in enumerate(("web_client", "droid_app")))
    c = table(spark, sf, "posts").select(F.expr("try_cast(tweet_id AS bigint)").alias("id"), F.lit(2).alias("prio"))
    ids = P.id_list(spark, sf).select(F.expr("try_cast(tweet_id AS bigint)").alias("id"))
    return a.unionAll(b).unionAll(c).join(ids, "id", "left_semi").groupBy("id").agg(F.min("prio").alias("prio")).orderBy("id")


@query(f"SELECT CAST({CREATED} AS DATE) AS day, count(*) AS n FROM hurricane_harvey GROUP BY 1")
def agg8_count_by_date(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "hurricane_harvey").groupBy(F.to_date(created(F.col("created_at"))).alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT batch_file, min(delivery_id) AS first_delivery, arg_min(id, delivery_id) AS first_id, arg_max(id, delivery_id) AS last_id, count(*) AS n FROM hurricane_harvey WHERE id IS NOT NULL GROUP BY batch_file")
def agg15_first_last_count(spark: SparkSession, sf: str) -> DataFrame:
    h = table(spark, sf, "hurricane_harvey").where("id IS NOT NULL")
    return h.groupBy("batch_file").agg(F.min("delivery_id").alias("first_delivery"), F.min_by("id", "delivery_id").alias("first_id"), F.max_by("id", "delivery_id").alias("last_id"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {SNAPSHOTS} SELECT snapshot, tweet_id, step FROM snap")
def win1_sliding_window_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return S.snapshots(P.words(spark, sf).select("tweet_id", "step", "created_at_ms")).select("snapshot", "tweet_id", "step")


@query(f"WITH {WORDS} SELECT q.step AS snapshot, w.tweet_id FROM (SELECT DISTINCT step FROM w) q JOIN w ON w.step BETWEEN q.step - 2 AND q.step - 1")
def win2_window_short(spark: SparkSession, sf: str) -> DataFrame:
    return S.snapshots(P.words(spark, sf).select("tweet_id", "step", "created_at_ms"), 2).select("snapshot", "tweet_id")


@query(f"WITH {WORDS} SELECT q.step AS snapshot, count(*) AS n FROM (SELECT DISTINCT step FROM w) q JOIN w ON w.step > q.step - 12 AND w.step <= q.step GROUP BY 1")
def win3_window_eval(spark: SparkSession, sf: str) -> DataFrame:
    per = P.words(spark, sf).groupBy("step").agg(F.count(F.lit(1)).alias("n"))
    seen = per.select(F.explode(F.sequence(F.col("step"), F.col("step") + 11)).alias("snapshot"), "n")
    return seen.join(per.select(F.col("step").alias("snapshot")), "snapshot", "left_semi").groupBy("snapshot").agg(F.sum("n").alias("n"))


@query("SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents WHERE source IS NOT NULL) WHERE rn = 1")
def win5_top_per_group(spark: SparkSession, sf: str) -> DataFrame:
    best = F.min(F.struct((-F.col("n_chars")).alias("n"), "doc_id")).alias("m")
    return table(spark, sf, "documents").where("source IS NOT NULL").groupBy("source").agg(best).select("source", "m.doc_id", (-F.col("m.n")).alias("n_chars"))


@query(f"""WITH {WORDS}, o AS (SELECT tweet_id, unnest(terms) AS term FROM w), r AS (SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) AS topic FROM o GROUP BY term ORDER BY topic LIMIT 20)
SELECT tweet_id, min(topic) AS topic FROM o JOIN r USING (term) GROUP BY tweet_id""")
def win6_first_topic_wins(spark: SparkSession, sf: str) -> DataFrame:
    o = P.words(spark, sf).select("tweet_id", F.explode("terms").alias("term"))
    top = o.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(20)
    ranked = top.withColumn("topic", F.row_number().over(Window.orderBy(F.desc("n"), "term")).cast("bigint"))
    return o.join(F.broadcast(ranked), "term").groupBy("tweet_id").agg(F.min("topic").alias("topic"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top1_topk_heap(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("SELECT source, n FROM (SELECT source, n, coalesce(sum(n) OVER (ORDER BY n DESC, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS whole FROM (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source)) WHERE before < 0.85 * whole")
def top2_top_mass(spark: SparkSession, sf: str) -> DataFrame:
    per = table(spark, sf, "documents").where("source IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return S.top_mass(per, "n", "source", 0.85)


@query("SELECT id, min(delivery_id) AS delivery_id FROM hurricane_harvey WHERE id IS NOT NULL GROUP BY id ORDER BY id")
def top5_external_merge_sort(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "hurricane_harvey").where("id IS NOT NULL").groupBy("id").agg(F.min("delivery_id").alias("delivery_id")).orderBy("id")


@query(r"SELECT DISTINCT batch_file, CAST(regexp_extract(batch_file, '_(\d+)_', 1) AS INT) AS day, CAST(regexp_extract(batch_file, '_(\d+)\.json$', 1) AS INT) AS hour FROM hurricane_harvey WHERE batch_file IS NOT NULL")
def top8_filename_numeric_sort(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "hurricane_harvey").where("batch_file IS NOT NULL").select("batch_file").distinct()
    return files.select("batch_file", F.regexp_extract("batch_file", r"_(\d+)_", 1).cast("int").alias("day"), F.regexp_extract("batch_file", r"_(\d+)\.json$", 1).cast("int").alias("hour")).orderBy("day", "hour")


@query("SELECT summary_id FROM summaries WHERE rank_no <= 2")
def top9_head_k_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "summaries").where("rank_no <= 2").select("summary_id")


def _sides(spark: SparkSession, sf: str) -> DataFrame:
    """Term sets of every model at each step, beside those of the model they are held against."""
    s = P.words_of(spark, sf, table(spark, sf, "summaries"), "text").select("step", "model", F.explode("terms").alias("term")).groupBy("step", "model").agg(F.collect_set("term").alias("terms"))
    own, ref = s.where("model <> 'inc'").withColumnRenamed("terms", "b"), s.where("model = 'inc'").select("step", F.col("terms").alias("a"))
    return own.join(ref, "step").select("step", "model", "a", "b")


SIDES = f"""{X.STOP_SQL}, t AS (SELECT step, model, list(DISTINCT term) AS terms FROM (SELECT step, model, unnest({X.extract_terms_sql('text')}) AS term FROM summaries, stop) GROUP BY ALL),
sides AS (SELECT o.step, o.model, r.terms AS a, o.terms AS b FROM t o JOIN t r ON r.step = o.step AND r.model = 'inc' AND o.model <> 'inc')"""


@query(f"WITH {SIDES} SELECT step, model, len(list_distinct(a || b)) AS n_union, len(list_intersect(a, b)) AS n_both FROM sides")
def set1_set2_union_intersect(spark: SparkSession, sf: str) -> DataFrame:
    return _sides(spark, sf).select("step", "model", F.size(F.array_union("a", "b")).cast("bigint").alias("n_union"), F.size(F.array_intersect("a", "b")).cast("bigint").alias("n_both"))


@query(f"WITH {SIDES} SELECT step, model, len(a) - len(list_intersect(a, b)) AS n_failed, len(b) - len(list_intersect(a, b)) AS n_missed FROM sides")
def set3_except(spark: SparkSession, sf: str) -> DataFrame:
    return _sides(spark, sf).select("step", "model", F.size(F.array_except("a", "b")).cast("bigint").alias("n_failed"), F.size(F.array_except("b", "a")).cast("bigint").alias("n_missed"))


@query(f"WITH {SIDES} SELECT step, model, round((len(a) - len(list_intersect(a, b))) / len(list_distinct(a || b)), 6) AS novelty FROM sides")
def set4_novelty(spark: SparkSession, sf: str) -> DataFrame:
    return _sides(spark, sf).select("step", "model", F.round(X.novelty(F.col("a"), F.col("b")), 6).alias("novelty"))


@query(f"WITH {SIDES} SELECT step, model, round(len(list_intersect(a, b)) / len(list_distinct(a || b)), 6) AS jaccard FROM sides")
def set5_set6_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return _sides(spark, sf).select("step", "model", F.round(X.set_jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


#: the counts of each source's languages less those of each other source, where that leaves any.
@query("""WITH c AS (SELECT source, lang, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY ALL), s AS (SELECT DISTINCT source FROM c)
SELECT a.source, s.source AS other, a.lang, a.n - coalesce(b.n, 0) AS n FROM c a JOIN s ON s.source <> a.source LEFT JOIN c b ON b.source = s.source AND b.lang = a.lang WHERE a.n > coalesce(b.n, 0)""")
def set7_map_subtract(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "documents").where("source IS NOT NULL AND lang IS NOT NULL").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    maps = c.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("m"))
    both = maps.join(maps.select(F.col("source").alias("other"), F.col("m").alias("o")), F.col("source") != F.col("other"))
    left = F.map_filter(F.map_zip_with("m", "o", lambda k, a, b: a - F.coalesce(b, F.lit(0))), lambda k, v: v > 0)
    return both.select("source", "other", F.explode(left).alias("lang", "n"))


@query("SELECT text, min(summary_id) AS summary_id FROM summaries GROUP BY text")
def set8_distinct_by_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "summaries").groupBy("text").agg(F.min("summary_id").alias("summary_id"))


@query(f"WITH {WORDS} SELECT tweet_id, array_to_string(terms, ' ') AS terms FROM w")
def txt1_txt7_term_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return P.words(spark, sf).select("tweet_id", F.array_join("terms", " ").alias("terms"))


@query(f"SELECT tweet_id, {X.clean_sql('text')} AS clean FROM posts")
def txt1_txt5_clean(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "posts").select("tweet_id", X.clean(F.col("text")).alias("clean"))


@query(f"SELECT tweet_id, {X.normalize_sql('text')} AS normal FROM posts")
def txt8_normalize_string(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "posts").select("tweet_id", X.normalize(F.col("text")).alias("normal"))


@query(f"SELECT tweet_id, {X.reformat_sql('text')} AS line FROM posts")
def txt13_reformat_tweet(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "posts").select("tweet_id", X.reformat(F.col("text")).alias("line"))


@query(f"""WITH {WORDS}, c AS (SELECT tweet_id, term, count(*) AS n FROM (SELECT tweet_id, unnest(terms) AS term FROM w) GROUP BY ALL)
SELECT tweet_id, string_agg(term || ' ' || n, ' ' ORDER BY term) AS vector FROM c GROUP BY tweet_id""")
def txt14_vector_codec(spark: SparkSession, sf: str) -> DataFrame:
    counts = P.words(spark, sf).select("tweet_id", F.explode("terms").alias("term")).groupBy("tweet_id", "term").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("term", "n"))), lambda p: F.concat_ws(" ", p["term"], p["n"].cast("string")))
    return counts.groupBy("tweet_id").agg(F.array_join(pairs, " ").alias("vector"))


@query(f"WITH {WORDS} SELECT tweet_id, term, count(*) AS n FROM (SELECT tweet_id, unnest(terms) AS term FROM w) GROUP BY ALL")
def txt14_vector_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors written as text and read back."""
    return X.decode_vector(txt14_vector_codec(spark, sf), "vector", "tweet_id").select("tweet_id", "term", F.col("value").cast("bigint").alias("n"))


#: a cluster's sums as one line: its number of posts, its times, and the terms of both sums, which here are counts.
@query(f"""WITH {WORDS}, m AS (SELECT coalesce(user_id, '-') AS cluster, step, tweet_id, terms FROM w), t AS (SELECT cluster, count(*) AS n, sum(step) AS t1, sum(step * step) AS t2 FROM m GROUP BY cluster),
c AS (SELECT cluster, term, count(*) AS a, count(DISTINCT tweet_id) AS b FROM (SELECT cluster, tweet_id, unnest(terms) AS term FROM m) GROUP BY ALL),
l AS (SELECT cluster, string_agg('2:' || term || ':' || printf('%.12f', a * 1000.0), chr(9) ORDER BY term) || chr(9) || string_agg('1:' || term || ':' || printf('%.12f', b * 1000.0), chr(9) ORDER BY term) AS x FROM c WHERE NOT contains(term, ':') GROUP BY cluster)
SELECT cluster, '0:' || cluster || chr(9) || '5:' || n || chr(9) || '3:' || t1 || chr(9) || '4:' || t2 || chr(9) || x AS line FROM t JOIN l USING (cluster)""")
def txt14_cluster_codec(spark: SparkSession, sf: str) -> DataFrame:
    return X.encode_clusters(*_cluster_sums(spark, sf))


@query(f"""WITH {WORDS} SELECT coalesce(user_id, '-') AS cluster, term, count(*) AS weight_sum, count(DISTINCT tweet_id) AS norm_sum FROM (SELECT user_id, tweet_id, unnest(terms) AS term FROM w) WHERE NOT contains(term, ':') GROUP BY ALL""")
def txt14_cluster_decode(spark: SparkSession, sf: str) -> DataFrame:
    out = X.decode_clusters(X.encode_clusters(*_cluster_sums(spark, sf)), "line")
    return out.select("cluster", "term", F.col("weight_sum").cast("bigint").alias("weight_sum"), F.col("norm_sum").cast("bigint").alias("norm_sum"))


def _cluster_sums(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    m = P.words(spark, sf).withColumn("cluster", F.coalesce("user_id", F.lit("-")))
    times = m.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("step").alias("sum_t"), F.sum(F.col("step") * F.col("step")).alias("sum_t2"))
    each = m.select("cluster", "tweet_id", F.explode("terms").alias("term")).where(~F.contains("term", F.lit(":")))
    return each.groupBy("cluster", "term").agg(F.count(F.lit(1)).alias("weight_sum"), F.countDistinct("tweet_id").alias("norm_sum")), times


@query(f"""WITH {WORDS}, o AS (SELECT created_at_ms, tweet_id, unnest(terms) AS term, generate_subscripts(terms, 1) AS i FROM w),
f AS (SELECT term, min((created_at_ms, tweet_id, i)) AS spot FROM o GROUP BY term)
SELECT term, row_number() OVER (ORDER BY spot) - 1 AS token_id FROM f""")
def txt15_token_ids(spark: SparkSession, sf: str) -> DataFrame:
    o = P.words(spark, sf).select("created_at_ms", "tweet_id", F.posexplode("terms").alias("i", "term"))
    first = o.groupBy("term").agg(F.min(F.struct("created_at_ms", "tweet_id", "i")).alias("at"))
    return S.with_index(first, "at", name="token_id").select("term", "token_id")


@query(f"SELECT delivery_id, {MS} AS ms FROM hurricane_harvey")
def dt1_parse_created_at(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "hurricane_harvey").select("delivery_id", F.unix_millis(created(F.col("created_at"))).alias("ms"))


@query("SELECT tweet_id, created_at_ms, strftime(make_timestamp(created_at_ms * 1000), '%d/%m/%Y') AS day FROM posts")
def dt2_day_of_ms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "posts").select("tweet_id", "created_at_ms", F.date_format(F.timestamp_millis("created_at_ms"), "dd/MM/yyyy").alias("day"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, json_exists(props, '$.id') AS has_id FROM events")
def jsn1_parse_object(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.get_json_object("props", "$.id").isNotNull().alias("has_id"))
