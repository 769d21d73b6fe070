"""Term extraction from posts, as one list of rules rendered for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that count as quotes.
QUOTES = "\"'`—»‘’‚‛“”„‟‹›「」『』〝〞〟﹁﹂﹃﹄＂＇｢｣"
#: Characters that count as punctuation.
PUNCTUATION = "~^(){}[]<>:;,.?!"
#: What is always a stop word.
EXTRA_STOP_WORDS = ("//t", "http", "https")

Q = "[" + QUOTES + "]"
P = r"[~^(){}\[\]<>:;,.?!]"
INNER = r"[~^(){}\[\]<>;,?!]"  #: stays only between two digits

BLANKS = [(r"[\n\r\t]", " ")]
RETWEET = [(r"(?i)(^| )rt @[^ ]*", "$1")]
ENTITY = [(r"&[^ ~^(){}\[\]<>:;,.?!@#%$]*", " ")]
QUOTE = [
    (rf"s{Q} ", "   "),  # the plural owner's
    (rf"{Q}( |$)", " $1"),
    (rf"(^| ){Q}+", "$1 "),
    (rf"{Q}s", "  "),  # the owner's
    (rf"{Q}([^mdt])$", " $1"),
]
PUNCT = [
    (rf"{P}( |$)", " $1"),
    (rf"(^| ){P}+", "$1 "),
    (rf"{P}http", " http"),
    (rf"{INNER}{INNER}+", " "),
    (rf"([^0-9]){INNER}", "$1 "),
    (rf"{INNER}([^0-9])", " $1"),
]
CLEAN = [*BLANKS, *RETWEET, *ENTITY, *QUOTE, *PUNCT]

NUMBER, HOUR, URL, FOREIGN = r"^[0-9.,]+$", r"^[0-9:]+$", r"^(https?|ftp)://[!-~]+$", "[^\x00-\u0080]"
WORD = [(P, " "), (r"[^A-Za-z0-9%$]+$", ""), (r"^[^A-Za-z0-9@#%$]+", "")]


def _spark(c: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, to in rules:
        c = F.regexp_replace(c, pattern, to)
    return c


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql(c: str, rules: list[tuple[str, str]]) -> str:
    for pattern, to in rules:
        c = f"regexp_replace({c}, {_quoted(pattern)}, {_quoted(to.replace('$1', chr(92) + '1'))}, 'g')"
    return c


def clean(text: Column) -> Column:
    return _spark(F.trim(text), CLEAN)


def clean_sql(text: str) -> str:
    return _sql(f"trim({text})", CLEAN)


def extract_terms(text: Column, stop_words: list[str]) -> Column:
    """Terms of a post in order, duplicates kept: numbers, hours and links as they
    are, other ASCII words in lower case without outer signs but for a leading
    @ # % $ and a trailing % $; no stop words. Null and empty texts give an empty array."""
    words = F.split(clean(text), " +")
    kept = lambda w: w.rlike(NUMBER) | w.rlike(HOUR) | w.rlike(URL)
    one = lambda w: F.when(kept(w), F.array(w)).when(w.rlike(FOREIGN), F.array().cast("array<string>")).otherwise(F.split(_spark(F.lower(w), WORD), " +"))
    flat = F.flatten(F.transform(words, one))
    stop = F.array(*[F.lit(w) for w in sorted({*stop_words, *EXTRA_STOP_WORDS})])
    return F.coalesce(F.filter(flat, lambda t: t.rlike(r"[\p{L}\p{N}]") & ~F.array_contains(stop, t)), F.array().cast("array<string>"))


STOP_SQL = f"stop AS (SELECT list(DISTINCT lower(word)) || [{', '.join(map(_quoted, EXTRA_STOP_WORDS))}] AS words FROM stop_words)"


def extract_terms_sql(text: str) -> str:
    """Needs the table ``stop`` of STOP_SQL among the query's tables."""
    words = f"regexp_split_to_array({clean_sql(text)}, ' +')"
    kept = " OR ".join(f"regexp_matches(w, {_quoted(p)})" for p in (NUMBER, HOUR, URL))
    split = f"regexp_split_to_array({_sql('lower(w)', WORD)}, ' +')"
    flat = f"flatten(list_transform({words}, lambda w: CASE WHEN {kept} THEN [w] WHEN regexp_matches(w, {_quoted(FOREIGN)}) THEN []::VARCHAR[] ELSE {split} END))"
    return rf"coalesce(list_filter({flat}, lambda t: regexp_matches(t, '[\p{{L}}\p{{N}}]') AND NOT list_contains(stop.words, t)), []::VARCHAR[])"


def normalize(text: Column) -> Column:
    """The post on one line, cleaned and in lower case, ended by a full stop."""
    t = F.trim(text)
    ended = F.when(t.rlike(r"[.!?,;]$"), t).otherwise(F.concat(t, F.lit(".")))
    return F.trim(F.regexp_replace(F.lower(_spark(ended, [*BLANKS, *RETWEET, *ENTITY, *QUOTE])), " +", " "))


def normalize_sql(text: str) -> str:
    t = f"trim({text})"
    ended = f"CASE WHEN regexp_matches({t}, '[.!?,;]$') THEN {t} ELSE {t} || '.' END"
    return f"trim(regexp_replace(lower({_sql(ended, [*BLANKS, *RETWEET, *ENTITY, *QUOTE])}), ' +', ' ', 'g'))"


def is_retweet(text: Column) -> Column:
    return F.trim(text).startswith("RT @")


def is_valid(text: Column) -> Column:
    return ~text.startswith("I liked a @YouTube video")


TAGS = [(r"/[a-z]+", ""), (r"\bxx\b", ""), (r" +", " ")]


def strip_tags(sentence: Column) -> Column:
    """A tagged path as a sentence: tags and joints removed, ended by a stop."""
    return F.concat(F.trim(_spark(sentence, TAGS)), F.lit(" ."))


#: The fields of a cluster's line, their separators, and the factor of its weights.
CLUSTER_ID, NORM_SUM, WEIGHT_SUM, SUM_TIME, SUM_SQUARED_TIME, N_POSTS = 0, 1, 2, 3, 4, 5
FIELD, VALUE, AMPLIFIED = "\t", ":", 1000


def decode_vector(df: DataFrame, vector: str, *keep: str) -> DataFrame:
    """``*keep, term, value`` of vectors written as term and value in turn, with blanks between. Null and empty give no rows."""
    parts = F.split(vector, " ")
    at = F.sequence(F.lit(0), F.floor(F.size(parts) / 2).cast("int") - 1)
    pairs = F.transform(at, lambda i: F.struct(F.get(parts, 2 * i).alias("term"), F.get(parts, 2 * i + 1).cast("double").alias("value")))
    return df.where(F.size(parts) > 1).select(*keep, F.inline(pairs))


def encode_clusters(sums: DataFrame, times: DataFrame) -> DataFrame:
    """``cluster, line``: clusters' sums (``cluster, term, weight_sum, norm_sum``) and times (``cluster, n, sum_t, sum_t2``) as
    lines of marked fields, weights amplified with twelve decimals. A term with the separator in it is not allowed."""

    def fields(mark: int, column: str):
        rows = F.array_sort(F.collect_list(F.struct("term", F.col(column).cast("double").alias("x"))))
        return F.array_join(F.transform(rows, lambda r: F.concat(F.lit(f"{mark}{VALUE}"), r["term"], F.lit(VALUE), F.format_string("%.12f", r["x"] * AMPLIFIED))), FIELD)

    both = sums.groupBy("cluster").agg(fields(WEIGHT_SUM, "weight_sum").alias("a"), fields(NORM_SUM, "norm_sum").alias("b")).join(times, "cluster")
    head = [F.concat(F.lit(f"{mark}{VALUE}"), F.col(c).cast("string")) for mark, c in ((CLUSTER_ID, "cluster"), (N_POSTS, "n"), (SUM_TIME, "sum_t"), (SUM_SQUARED_TIME, "sum_t2"))]
    return both.select("cluster", F.concat_ws(FIELD, *head, "a", "b").alias("line"))


def decode_clusters(df: DataFrame, line: str) -> DataFrame:
    """``cluster, n, sum_t, sum_t2, term, weight_sum, norm_sum`` of lines by :func:`encode_clusters`."""
    parts = F.transform(F.split(line, FIELD), lambda f: F.split(f, VALUE))
    of = lambda mark: F.filter(parts, lambda p: p[0] == str(mark))
    one = lambda mark: F.get(F.get(of(mark), F.lit(0)), F.lit(1))
    head = df.select(one(CLUSTER_ID).alias("cluster"), one(N_POSTS).cast("bigint").alias("n"), one(SUM_TIME).cast("bigint").alias("sum_t"), one(SUM_SQUARED_TIME).cast("bigint").alias("sum_t2"), F.filter(parts, lambda p: p[0].isin(str(NORM_SUM), str(WEIGHT_SUM))).alias("p"))
    each = head.select("cluster", "n", "sum_t", "sum_t2", F.explode("p").alias("p")).select("cluster", "n", "sum_t", "sum_t2", F.col("p")[0].alias("mark"), F.col("p")[1].alias("term"), (F.col("p")[2].cast("double") / AMPLIFIED).alias("x"))
    value = lambda mark: F.max(F.when(F.col("mark") == str(mark), F.col("x")))
    return each.groupBy("cluster", "n", "sum_t", "sum_t2", "term").agg(value(WEIGHT_SUM).alias("weight_sum"), value(NORM_SUM).alias("norm_sum"))


REFORMAT = [(r"\s+", " "), (r"^RT @[^ ]* ?", "")]


def reformat(text: Column) -> Column:
    """A post for reading: single blanks, without one leading retweet mark."""
    return _spark(F.trim(text), REFORMAT)


def reformat_sql(text: str) -> str:
    return f"regexp_replace(regexp_replace(trim({text}), '\\s+', ' ', 'g'), '^RT @[^ ]* ?', '')"


def list_jaccard(a: Column, b: Column) -> Column:
    """Overlap by the lengths of the lists: repeated values count as shared, so it can exceed 1."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, (F.size(a) + F.size(b) - union) / union)


def set_jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union)


def novelty(new: Column, old: Column) -> Column:
    """Share of the union of both that only the new one has."""
    union = F.size(F.array_union(new, old))
    return F.when(union > 0, F.size(F.array_except(new, old)) / union)
