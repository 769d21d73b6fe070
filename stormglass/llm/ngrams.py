"""Frequency of every distinct term or n-gram, by sorted suffixes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLUSH = 300_000
ALL = ""  #: stands for the record itself; its df is the number of records with a term


def _suffixes(words: list[str], n: int, out: Counter) -> None:
    """Adds the truncated suffixes of one record.

    A suffix carries how many of its leading prefixes stood earlier in the same
    record: those are occurrences, but no new record. If a prefix stood earlier
    so did all shorter ones, so one number holds the whole record set.
    """
    if n == 1:
        for w, k in Counter(words).items():
            out[w, 0] += 1
            if k > 1:
                out[w, 1] += k - 1
        return
    seen: set[str] = set()
    for i in range(len(words)):
        part, known = words[i : i + n], 0
        for k in range(1, len(part) + 1):
            gram = " ".join(part[:k])
            if gram in seen:
                known = k
            else:
                seen.add(gram)
        out[" ".join(part), known] += 1


def _map(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found: Counter) -> pa.RecordBatch:
            grams, known = zip(*found)
            first = [g.split(" ", 2) for g in grams]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([f[0] for f in first], pa.string()),
                    pa.array([f[1] if len(f) > 1 else "" for f in first], pa.string()),
                    pa.array(grams, pa.string()),
                    pa.array(known, pa.int32()),
                    pa.array(list(found.values()), pa.int64()),
                ],
                names=["head", "next", "suffix", "known", "n"],
            )

        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = text.split(" ") if text else []
                if words:
                    found[ALL, 0] += 1
                    _suffixes(words, n, found)
                if len(found) > FLUSH:
                    yield rows(found)
                    found = Counter()
        if found:
            yield rows(found)

    return run


def _stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes in reverse lexicographic order in, one row per n-gram out.

    The stack holds the words of the current suffix with their counts so far;
    what the next suffix does not share is complete, and its occurrences are
    handed to the word below when popped.
    """
    words: list[str] = []
    total: list[int] = []
    fresh: list[int] = []
    grams: list[str] = []
    cf: list[int] = []
    df: list[int] = []

    def pop(depth: int) -> None:
        while len(words) > depth:
            grams.append(" ".join(words))
            words.pop()
            t = total.pop()
            cf.append(t)
            df.append(fresh.pop())
            if total:
                total[-1] += t

    def take() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(cf, pa.int64()), pa.array(df, pa.int64())], names=["ngram", "cf", "df"])
        for x in (grams, cf, df):
            x.clear()
        return out

    for batch in batches:
        for suffix, known, n in zip(*(batch.column(c).to_pylist() for c in ("suffix", "known", "n"))):
            part = suffix.split(" ")
            same = 0
            while same < len(words) and same < len(part) and words[same] == part[same]:
                same += 1
            pop(same)
            for w in part[same:]:
                words.append(w)
                total.append(0)
                fresh.append(0)
            total[-1] += n
            for k in range(known, len(part)):
                fresh[k] += n
        if len(grams) > 20_000:
            yield take()
    pop(0)
    if grams:
        yield take()


def ngram_counts(df: DataFrame, terms: str, max_n: int = 1, split: int = 8) -> DataFrame:
    """``ngram, cf, df`` of every n-gram of up to ``max_n`` terms.

    ``terms`` names an array column, one record per row. Each record sends its
    suffixes, cut to ``max_n`` terms and combined before the shuffle, to the
    partition of their first term; there they are sorted in reverse order and
    one pass with a stack yields occurrences (cf) and records (df) of all
    prefixes. With ``max_n`` above 1 a first term's suffixes are also divided
    by their second term over ``split`` partitions, so that no common term
    becomes one task; the single terms are then summed once more.

    The row with the empty n-gram holds the number of records with a term (df).
    Null or empty arrays, like an empty table, add nothing; null elements and
    blanks within an element are not allowed (they are what separates terms);
    other columns are ignored.
    """
    if max_n < 1:
        raise ValueError("max_n must be at least 1")
    part = "head string, next string, suffix string, known int, n bigint"
    sent = df.select(F.array_join(F.col(terms), " ").alias("text")).mapInArrow(_map(max_n), part)
    n = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    keys = [F.col("head")] if max_n == 1 else [F.col("head"), F.pmod(F.xxhash64("next"), F.lit(split))]
    routed = sent.repartition(int(n), *keys).select("suffix", "known", "n")
    out = routed.sortWithinPartitions(F.col("suffix").desc()).mapInArrow(_stack, "ngram string, cf bigint, df bigint")
    if max_n > 1:
        out = out.groupBy("ngram").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))
    return out


def mark_extremes(counts: DataFrame, min_df: int = 3, max_share: float = 0.05) -> DataFrame:
    """``ngram, cf, df, mark``: rare below ``min_df`` records, common above
    ``max_share`` of all records; null otherwise.

    Takes the result of :func:`ngram_counts`, materialized: the number of records
    is read from it. Rare wins where both would hold.
    """
    whole = counts.where(F.col("ngram") == ALL).agg(F.sum("df")).first()[0] or 0
    mark = F.when(F.col("df") < min_df, "rare").when(F.col("df") > whole * max_share, "common")
    return counts.where(F.col("ngram") != ALL).withColumn("mark", mark)
