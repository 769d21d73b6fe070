"""Where the queries register: name -> callable, and name -> SQL, with the common table expressions."""

from __future__ import annotations

from stormglass.functions.text import STOP_SQL, extract_terms_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


HOUR_MS = 3_600_000
#: One row per post id: the earliest of repeated lines.
POSTS = """p AS (SELECT tweet_id, user_id, created_at_ms, text FROM (
  SELECT *, row_number() OVER (PARTITION BY tweet_id ORDER BY created_at_ms NULLS FIRST, text NULLS FIRST, user_id NULLS FIRST) AS rn FROM posts WHERE tweet_id IS NOT NULL) WHERE rn = 1)"""
STEPPED = f"{POSTS}, ref AS (SELECT min(created_at_ms) AS r FROM p), s AS (SELECT p.*, CAST(greatest(0, (created_at_ms - r) // {HOUR_MS}) AS INT) AS step FROM p, ref)"
#: w: posts with step and terms, only those with a term.
WORDS = f"{STEPPED}, {STOP_SQL}, w AS (SELECT * FROM (SELECT s.*, {extract_terms_sql('text')} AS terms FROM s, stop) WHERE len(terms) >= 1)"
#: snap: each post once per snapshot that sees it, the twelve steps before; only snapshots at steps with posts.
SNAPSHOTS = f"{WORDS}, snap AS (SELECT q.step AS snapshot, w.* FROM (SELECT DISTINCT step FROM w) q JOIN w ON w.step BETWEEN q.step - 12 AND q.step - 1)"
EDGES = """pos AS (SELECT tweet_id, step, unnest(terms) AS term, generate_subscripts(terms, 1) AS i FROM w),
co AS (SELECT a.tweet_id, a.step, a.term AS u, b.term AS v FROM pos a JOIN pos b ON a.tweet_id = b.tweet_id AND b.i - a.i BETWEEN 1 AND 3 AND a.term <> b.term)"""
