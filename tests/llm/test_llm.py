import itertools
import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormglass.llm import classes, diverse, mixing, neardup, ngrams, packing, relevance, setjoin, splitting, tokens, truncation
from stormglass.llm import queries as Q
from stormglass.llm.common import first_deliveries, terms
from stormglass.runtime import materialize
from tests.test_core import SF, check

LONG = "storm surge " * 20_000
needs_tokenizer = pytest.mark.skipif(not os.path.exists(tokens.TOKENIZER), reason="no tokenizer")


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# --- common


def test_terms(spark):
    rows = [("A b, see https://x.y/z?q now", ["a", "b", "see", "now"]), (None, []), ("", []), ("...", []), ("día 避難 x2", ["día", "避難", "x2"]), ("x HTTPS://A.b", ["x", "https", "a", "b"])]
    df = frame(spark, rows, "t string, want array<string>").withColumn("got", terms(F.col("t")))
    assert all(r["got"] == r["want"] for r in df.collect())


def test_first_deliveries(spark):
    rows = [(1, 5, "b"), (1, 3, "a"), (2, None, "x"), (2, 9, None), (None, 1, "n"), (3, None, None), (3, None, "z")]
    got = {r["id"]: r["text"] for r in first_deliveries(frame(spark, rows, "id bigint, delivery_id bigint, text string"), ["text"]).collect()}
    assert got == {1: "a", 2: None, 3: None}


# --- problem 5


def brute_ngrams(records, n):
    cf, df = Counter(), Counter()
    for r in records:
        grams = [" ".join(r[i : i + k]) for i in range(len(r)) for k in range(1, n + 1) if i + k <= len(r)]
        cf.update(grams)
        df.update(set(grams))
    return {g: (cf[g], df[g]) for g in cf}


@pytest.mark.parametrize("n", [1, 3])
def test_ngram_counts(spark, n):
    r = random.Random(1)
    records = [[r.choice("a b c dd the the".split()) for _ in range(r.randint(0, 12))] for _ in range(60)] + [["the"] * 50]
    rows = [(x, "clash", 1) for x in records] + [(None, "clash", 1)]
    counts = materialize(ngrams.ngram_counts(frame(spark, rows, "terms array<string>, ngram string, df int"), "terms", n, split=2))
    got = {x["ngram"]: (x["cf"], x["df"]) for x in counts.collect()}
    assert got.pop(ngrams.ALL)[1] == sum(bool(x) for x in records)
    assert got == brute_ngrams(records, n)


def test_ngram_marks_and_empty(spark):
    empty = materialize(ngrams.ngram_counts(frame(spark, [], "terms array<string>"), "terms", 2))
    assert empty.count() == 0 and ngrams.mark_extremes(empty).count() == 0
    counts = materialize(ngrams.ngram_counts(frame(spark, [(["a", "b"],)] * 3 + [(["a"],)] * 37, "terms array<string>"), "terms"))
    assert {r["ngram"]: r["mark"] for r in ngrams.mark_extremes(counts, 4, 0.5).collect()} == {"a": "common", "b": "rare"}


# --- problem 4


def test_relevance_against_formula(spark):
    records = {1: ["a", "b", "a"], 2: ["b", "c"], 3: ["b"], 4: [], 5: None}
    df = frame(spark, [(k, v, 0.0) for k, v in records.items()], "id bigint, terms array<string>, score double")
    counts = materialize(ngrams.ngram_counts(df, "terms"))
    got = {(r["id"], r["term"]): r["score"] for r in relevance.score_terms(df, counts, "id", "terms").collect()}
    docs = [v for v in records.values() if v]
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    for k, v in records.items():
        for t in set(v or []):
            d, tf = sum(t in x for x in docs), v.count(t)
            want = math.log(1 + (n - d + 0.5) / (d + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(v) / mean))
            assert got.pop((k, t)) == pytest.approx(want, abs=1e-6)
    assert not got
    plain = relevance.score_terms(df, counts, "id", "terms", k1=math.inf, b=0, idf="plain")
    best = {r["id"]: r["term"] for r in relevance.top_terms(plain, "id").collect()}
    assert best == {1: "a", 2: "c", 3: "b"}
    assert relevance.score_terms(df.limit(0), counts, "id", "terms").count() == 0


def test_top_terms_tie_is_first_by_code_point(spark):
    scores = frame(spark, [(1, "b", 2.0), (1, "a", 2.0), (1, "Z", 2.0), (2, "x", 0.0)], "id bigint, term string, score double")
    assert {r["id"]: r["term"] for r in relevance.top_terms(scores, "id").collect()} == {1: "Z", 2: "x"}
    assert relevance.top_terms(scores, "id", 2).count() == 1


# --- problem 2


def near_copies(n, seed=0):
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = [f"w{r.randrange(4000)}" for _ in range(30)]
        out.append(words)
        for _ in range(i % 3):
            copy = list(words)
            for _ in range(r.randint(1, 5)):
                copy[r.randrange(30)] = f"w{r.randrange(4000)}"
            out.append(copy)
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def pairs_of(texts, width, threshold):
    sets = [{tuple(t[i : i + width]) for i in range(len(t) - width + 1)} for t in texts]
    return {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] and jaccard(sets[i], sets[j]) >= threshold}


def test_near_duplicates_against_brute_force(spark):
    texts = near_copies(60) + [["x"]] * 2 + [[]] + [["q", "r", "s", "t", "u"] * 6] * 3
    df = frame(spark, [(i, t, "c") for i, t in enumerate(texts)], "id bigint, terms array<string>, cls string")
    sets = df.select("id", classes.shingle_set(F.col("terms"), 2).alias("tokens")).where(F.size("tokens") > 0)
    links, whole, members = neardup.near_duplicates(sets, "id", "tokens", threshold=0.5, bands=120, rows=4, bucket_rows=40)
    got = {(r["a"], r["b"]) for r in neardup.all_pairs(links, whole, members).collect()}
    want = pairs_of(texts, 2, 0.5)
    assert got == want
    root = list(range(len(texts)))
    for i, j in want:
        a, b = root[i], root[j]
        root = [a if x == b else x for x in root]
    group = {r["key"]: r["group"] for r in neardup.components(links, members).collect()}
    assert all((group[i] == group[j]) == (root[i] == root[j]) for i in group for j in group)


def test_pairs_of_a_large_class_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "MEMBERS", 16)
    texts = [[*"abcdefghij"]] * 70 + [[*"abcdefghik"]] * 40 + [[*"qrst"]]
    df = frame(spark, list(enumerate(texts)), "id bigint, terms array<string>").select("id", classes.shingle_set(F.col("terms"), 1).alias("tokens"))
    got = [(r["a"], r["b"]) for r in neardup.all_pairs(*neardup.near_duplicates(df, "id", "tokens", threshold=0.8, bands=40, rows=2)).collect()]
    assert len(got) == math.comb(110, 2) and set(got) == {(i, j) for i, j in itertools.combinations(range(110), 2)}


def test_what_shortened_hashes_confuse_is_looked_at_again(spark):
    """Two elements share their last 31 bits: the short sets are equal, the whole ones are below the threshold."""
    one, two = [*range(1, 9), 9 + 2**40, 10 + 2**41], [*range(1, 9), 9 + 2**42, 10 + 2**43]
    df = frame(spark, [(1, one), (2, two), (3, [*range(1, 9), 9 + 2**40])], "id bigint, tokens array<bigint>")
    links, whole, members = neardup.near_duplicates(df, "id", "tokens", threshold=0.8, bands=40, rows=2)
    got = {(r["a"], r["b"]) for r in neardup.all_pairs(links, whole, members).collect()}
    assert got == {(1, 3)}


def test_near_duplicates_of_one_hot_group(spark):
    """More sets under one band key than a block holds: every pair is still met."""
    base = [f"w{i}" for i in range(200)]
    texts = [[*base, f"own{i}"] for i in range(neardup.BLOCK + 60)]
    df = frame(spark, list(enumerate(texts)), "id bigint, terms array<string>").select("id", classes.shingle_set(F.col("terms"), 1).alias("tokens"))
    links, whole, members = neardup.near_duplicates(df, "id", "tokens", threshold=0.8, bands=20, rows=5)
    assert links.count() == math.comb(len(texts), 2)


def test_near_duplicates_of_nothing_and_nulls(spark):
    df = frame(spark, [], "id bigint, tokens array<bigint>")
    links, whole, members = neardup.near_duplicates(df, "id", "tokens")
    assert links.count() == whole.count() == members.count() == 0
    df = frame(spark, [(1, None), (2, []), (3, [5]), (4, [5])], "id bigint, tokens array<bigint>")
    links, whole, members = neardup.near_duplicates(df, "id", "tokens")
    assert links.count() == 0 and members.count() == 4 and whole.where("n > 1").count() == 2


def test_posterior_bound():
    for n in (32, 64, 128):
        m = neardup.least_matches(n, 0.5, 1e-4)
        tail = sum(math.comb(n + 1, k) for k in range(m)) / 2 ** (n + 1)
        assert 0 < m < n / 2 and tail < 1e-4


# --- problem 6


@pytest.mark.parametrize("threshold", [0.4, 0.6, 0.9])
def test_set_join_against_brute_force(spark, threshold):
    r = random.Random(2)
    base = [[f"t{r.randrange(60)}" for _ in range(r.randint(1, 14))] for _ in range(40)]
    left = base + [[], None, ["solo"]]
    right = [list({*b, f"t{r.randrange(60)}"} - {f"t{r.randrange(60)}"}) for b in base] + base[:5] + base[:5] + [[], None]
    make = lambda x, k: frame(spark, [(i, t, "clash") for i, t in enumerate(x)], f"{k} bigint, terms array<string>, sig string").select(k, "sig", classes.token_set(F.coalesce("terms", F.array().cast("array<string>"))).alias("tokens"))
    got = {(x["l"], x["r"]): x["similarity"] for x in setjoin.join_similar(make(left, "l"), make(right, "r"), "l", "r", "tokens", threshold).collect()}
    want = {(i, j): jaccard(set(a), set(b)) for i, a in enumerate(left) for j, b in enumerate(right) if a and b and jaccard(set(a), set(b)) >= threshold}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_set_self_join(spark):
    r = random.Random(4)
    texts = [[f"t{r.randrange(25)}" for _ in range(r.randint(2, 9))] for _ in range(50)]
    df = frame(spark, list(enumerate(texts)), "k bigint, terms array<string>").select("k", classes.token_set(F.col("terms")).alias("tokens"))
    whole, members = classes.classes(df, "k", "tokens")
    m = {x["cls"]: x["rep"] for x in whole.collect()}
    got = {tuple(sorted((m[x["cls_a"]], m[x["cls_b"]]))) for x in setjoin.similar_sets(whole, whole, 0.5).collect()}
    reps = sorted(m.values())
    want = {(i, j) for i, j in itertools.combinations(reps, 2) if jaccard(set(texts[i]), set(texts[j])) >= 0.5}
    assert got == want


def test_set_join_of_long_sets(spark):
    """Sets of thousands of tokens send no more combinations than tokens."""
    r = random.Random(3)
    base = [r.sample(range(40_000), n) for n in (5000, 5000, 1200, 300, 40, 12)]
    left = [sorted(b) for b in base]
    right = [sorted({*b[: int(len(b) * 0.9)], *(50_000 + i for i in range(len(b) // 10))}) for b in base]
    make = lambda x, k: frame(spark, [(i, t) for i, t in enumerate(x)], f"{k} bigint, tokens array<bigint>").select(k, classes.token_set(F.col("tokens")).alias("tokens"))
    got = {(x["l"], x["r"]) for x in setjoin.join_similar(make(left, "l"), make(right, "r"), "l", "r", "tokens", 0.6).collect()}
    assert got == {(i, j) for i, a in enumerate(left) for j, b in enumerate(right) if jaccard(set(a), set(b)) >= 0.6}
    bound = setjoin._level_bounds(0.6, setjoin.LEVELS)
    levels = bound(np.arange(1, 6000))
    assert levels.min() == 1 and levels.max() == 3 and (np.diff(levels) <= 0).all()


def test_set_join_with_nothing(spark):
    df = frame(spark, [], "k bigint, tokens array<bigint>")
    assert setjoin.join_similar(df.withColumnRenamed("k", "l"), df, "l", "k", "tokens", 0.5).count() == 0


# --- problem 1


POSTS = "d bigint, id bigint, source string, text string, copy string"


def cut_posts():
    """A source with a field of 60 characters, one that marks its cuts, and one without limits that loses ends."""
    r = random.Random(9)
    nouns, verbs, places = ["bridge", "levee", "harbor", "station", "school"], ["flooded", "closed", "reopened", "burned"], ["Northfield", "Lakewood", "Brookside", "Riverton"]
    line = lambda: f"the {r.choice(nouns)} near {r.choice(places)} {r.choice(verbs)} at {r.randint(1, 12)} pm"
    rows, cut = [], set()
    for i in range(3000):
        whole = ". ".join(line() for _ in range(r.randint(1, 3))) + r.choice([".", "!", ""])
        source = ["field", "marks", "open"][i % 3]
        text = whole
        if source == "field" and len(whole) > 60:
            text = whole[:60]
        elif source == "marks" and len(whole) > 60:
            text = whole[:55].rsplit(" ", 1)[0] + " [...]"
        elif source == "open" and r.random() < 0.2:
            text = whole[: r.randint(20, len(whole) - 1)]
        rows.append((i, i, source, text, "x"))
        if text != whole:
            cut.add(i)
    return rows, cut


def test_cut_texts(spark):
    rows, cut = cut_posts()
    n = len(rows)
    extra = [(n, 1_000_001, "other", "water rises in the old town", "x"), (n + 1, 1_000_001, "other", "water rises in", "x"), (n + 2, None, None, None, None), (n + 3, 5, None, "", ""), (n + 4, 7, "open", LONG, "x"), (n + 5, 1_000_001, "other", "water rises in the old town ", "x")]
    found = {r["d"]: r for r in truncation.evidence(frame(spark, rows + extra, POSTS), "d", "id", "source", "text").collect()}
    assert len(found) == n + len(extra)
    assert found[n + 1]["reason"] == "copy"
    assert not any(found[n + k]["cut"] for k in (0, 2, 3, 5))
    got = {d for d, r in found.items() if r["cut"] and d < n}
    for source, least in ((0, 0.97), (1, 0.99), (2, 0.7)):
        own = {d for d in range(n) if d % 3 == source}
        assert len(got & cut & own) >= least * len(cut & own), source
        assert len((got & own) - cut) <= 0.03 * len(got & own), source


def test_cuts_are_judged_alike_in_more_rows(spark):
    for m in (1, 10):
        texts = ["people close the gate now."] * 1500 * m + ["th gate near here now."] * m + ["stay near the gate now."] * 100 * m
        rows = [(i, i, "a", t, "x") for i, t in enumerate(texts)]
        n = len(rows)
        rows += [(n, n, "a", "people close th", "x"), (n + 1, n + 1, "b", "stay at the gate near", "x")]
        found = {r["d"]: r["reason"] for r in truncation.evidence(frame(spark, rows, POSTS), "d", "id", "source", "text").collect()}
        assert found[n] == "torn" and found[n + 1] is None, m


def test_any_copy_that_goes_on_shows_a_cut(spark):
    texts = ["water rises in", "water rises in the old town", "Water rises in the old town, they say", "water rises", " water"]
    rows = [(i, 1, "a", t, "x") for i, t in enumerate(texts)] + [(9, None, "a", "water rises in", "x"), (10, None, "a", "water rises in town", "x")]
    found = {r["d"]: r["reason"] for r in truncation.evidence(frame(spark, rows, POSTS), "d", "id", "source", "text").collect()}
    assert {d for d, x in found.items() if x == "copy"} == {0, 3} and len(found) == len(rows)


def test_cut_texts_of_nothing(spark):
    df = truncation.evidence(frame(spark, [], POSTS), "d", "id", "source", "text")
    assert df.count() == 0 and truncation.truncation_report(df).count() == 0


def test_stack_automaton():
    for text, want in {"“a (b) c”": False, "“a (b c”": True, "a) b": False, ":) ok": False, "“«x»": True, "「水": True, "": False}.items():
        assert bool(truncation.unclosed(text)) is want, text


# --- problem 10


@needs_tokenizer
@pytest.mark.parametrize("limit,overlap", [(60, 10), (200, 0), (64, 50)])
def test_pieces_round_trip(limit, overlap):
    r = random.Random(3)
    words = "storm Überflut 避難所は暗い。 data-dump 12,345 🌊 (see) “quoted”".split()
    texts = ["\n\n".join("\r\n".join(" ".join(r.choice(words) for _ in range(r.randint(1, 40))) + r.choice([". ", "! ", "", "…"]) for _ in range(r.randint(1, 6))) for _ in range(8)) for _ in range(10)]
    texts += ["a" * 5000, "避" * 900, "🌊" * 700, " " * 3000, "\n" * 900, "x\x85y z " * 300, LONG]
    encoding, _ = tokens.load(tokens.TOKENIZER)
    for text in texts:
        found = splitting.pieces(text, limit, overlap)
        ids = encoding.encode_ordinary(text)
        if len(ids) <= limit:
            assert found == []
            continue
        assert found[0][:2] == (0, 0) and found[-1][2] == len(ids)
        assert all(a[2] == b[1] for a, b in zip(found, found[1:]))
        assert "".join(encoding.decode(ids[own:end]) for _, own, end, _ in found) == text
        for first, own, end, part in found:
            assert end - first <= limit and len(encoding.encode_ordinary(part)) <= limit
            assert encoding.decode(ids[first:end]) == part


@needs_tokenizer
def test_pieces_prefer_natural_boundaries():
    text = "\n\n".join("One sentence here. Another sentence there." for _ in range(30))
    found = splitting.pieces(text, 60, 0)
    assert all(part.endswith("\n\n") for *_, part in found[:-1])


def test_merging_takes_the_weakest_boundary():
    assert splitting.merge([0, 4, 8, 12], [4, 1], 8) == [0, 4, 12]
    assert splitting.merge([0, 4, 8, 12], [1, 4], 8) == [0, 8, 12]
    assert splitting.merge([0, 5], [], 3) == [0, 5]


@needs_tokenizer
def test_split_table(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "short", "x"), (4, LONG, "x"), (4, LONG, "x")]
    got = splitting.split_oversized(frame(spark, rows, "doc_id bigint, text string, piece_no string"), "doc_id", "text", 1000, 50).collect()
    assert {r["doc_id"] for r in got} == {4} and len(got) == 2 * got[0]["n_pieces"]
    assert splitting.split_oversized(frame(spark, [], "doc_id bigint, text string"), "doc_id", "text", 1000, 50).count() == 0
    with pytest.raises(ValueError):
        splitting.split_oversized(frame(spark, [], "doc_id bigint, text string"), "doc_id", "text", 50, 50)


# --- problem 8


@pytest.mark.parametrize("seed", range(4))
def test_containers(spark, seed):
    r = random.Random(seed)
    sizes = [r.choice([0, 1, 7, 30, 34, 50, 67, 99, 100, 101, 250, 300, None]) if r.random() < 0.5 else r.randint(0, 140) for _ in range(400)] + [40] * 200
    df = frame(spark, [(i, s, "c") for i, s in enumerate(sizes)], "k bigint, n bigint, container_id string")
    got = packing.containers(df, "k", "n", 100).collect()
    parts, boxes = {}, Counter()
    for x in got:
        parts.setdefault(x["k"], []).append((x["part_no"], x["size_from"], x["n"]))
        boxes[x["container_id"]] += x["n"]
    assert set(parts) == set(range(len(sizes))) and max(boxes.values()) <= 100
    for k, s in enumerate(sizes):
        own = sorted(parts[k])
        assert sum(p[2] for p in own) == (s or 0)
        assert len(own) == max(1, math.ceil((s or 0) / 100)) and [p[1] for p in own] == [100 * i for i in range(len(own))]
    least = math.ceil(sum(s or 0 for s in sizes) / 100)
    assert set(boxes) == set(range(len(boxes))) and len(boxes) <= 1.25 * least


def test_containers_of_nothing_and_of_empty_items(spark):
    assert packing.containers(frame(spark, [], "k bigint, n bigint"), "k", "n", 10).count() == 0
    got = packing.containers(frame(spark, [(1, 0), (2, None)], "k bigint, n bigint"), "k", "n", 10).collect()
    assert [(r["container_id"], r["n"]) for r in got] == [(0, 0), (0, 0)]
    got = packing.containers(frame(spark, [(1, 30), (2, 10)], "k bigint, n bigint"), "k", "n", 10).collect()
    assert sorted(r["container_id"] for r in got) == [0, 1, 2, 3]


def test_large_items_pair_at_most_twice():
    plan = packing.Plan({60: 3, 40: 2, 35: 4, 20: 3}, 100)
    boxes: dict[int, list[int]] = {}
    counts = {60: 3, 40: 2, 35: 4, 20: 3}
    places = sorted(plan.places)
    for i, (size, rank, box, each) in enumerate(places):
        last = next((p[1] for p in places[i + 1 :] if p[0] == size), counts[size])
        for k in range(last - rank):
            boxes.setdefault(box + k // each, []).append(size)
    assert all(sum(b) <= 100 and sum(3 * s > 100 for s in b) <= 2 for b in boxes.values())
    assert sum(map(len, boxes.values())) == sum(counts.values())


# --- problem 9


def test_raking_reaches_sources_and_caps():
    cells = [("a", "en", 0, 1000), ("a", "fr", 1, 500), ("b", "en", 0, 200), ("b", "fr", 0, 100), ("c", "en", 1, 50)]
    weight, total = mixing.rake(cells, {"a": (0.5, 1), "b": (0.4, 4), "c": (0.1, 4)})
    per = Counter()
    for c, w in zip(cells, weight):
        per[c[0]] += c[3] * w
    assert total == pytest.approx(2000)
    assert per["a"] == pytest.approx(1000) and per["b"] == pytest.approx(800) and per["c"] == pytest.approx(200)
    assert all(w <= {"a": 1, "b": 4, "c": 4}[c[0]] + 1e-9 for c, w in zip(cells, weight))
    assert mixing.rake([], {"a": (1.0, 1)})[1] == 0.0


def test_mix(spark):
    r = random.Random(5)
    rows = [(i, r.choice(["a"] * 6 + ["b", "c", "z", None]), r.choice(["en", "EN", "fr", None]), r.randint(0, 60), i % 3, "x") for i in range(4000)]
    df = frame(spark, rows, "k bigint, source string, lang string, n_tokens bigint, topic int, repeats string")
    targets = frame(spark, [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("gone", 0.0, 1)], "source string, target_share double, max_repeats int")
    mixed = materialize(mixing.mix(df, targets, "k", "source", "lang"))
    most = {"a": 1, "b": 2, "c": 3}
    got = mixed.collect()
    assert len({x["k"] for x in got}) == len(got) and all(1 <= x["repeats"] <= most[x["source"]] for x in got)
    report = {x["source"]: x for x in mixing.shares(mixed, targets, "source").collect()}
    assert report["gone"]["actual_share"] == 0 and all(abs(report[s]["actual_share"] - t) < 0.003 for s, t in (("a", 0.5), ("b", 0.3), ("c", 0.2)))
    rows = mixing.marginals(mixed, df, targets, "source", "lang").collect()
    assert all(abs(x["target_share"] - x["actual_share"]) < 0.01 for x in rows), rows
    assert {x["dimension"] for x in rows} == {"source", "lang", "topic"}
    assert mixing.mix(df.limit(0), targets, "k", "source", "lang").count() == 0


@pytest.mark.parametrize("text, state", [("a (b", "quote"), ("he said \"wait", "quote"), ('a 6" pipe', ""), ("<b>bold", "markup"), ("<b>bold</b> x", ""), ("line<br>next", ""), ("see <a href='x", "markup"), ("**note", "markup"), ("**note**", ""), ("`code", "markup"), ("```\nx = [1\n```", ""), ("a :)", ""), ("“x” (y)", ""), ("<!-- x", "markup"), ("3 < 4", ""), ("", "")])
def test_automaton(text, state):
    assert truncation.unclosed(text) == state


@pytest.mark.parametrize("text, torn", [("x%E2%80", True), ("x%E2%80%99", False), ("x%20%", True), ("100%", False), ("a%20b", False)])
def test_torn_escapes(text, torn):
    assert truncation.torn_escape(text) == torn


def test_broken_tails():
    for text in ("smile \\ud83d", "fish &amp", "x &#128", "tail \\u26", "\ufffd"):
        assert truncation.BROKEN.search(text), text
    for text in ("AT&T", "fish &amp; chips", "C:\\temp files", "q\\ud83d\\ude00"):
        assert not truncation.BROKEN.search(text), text


@needs_tokenizer
def test_sizes_and_topics(spark):
    docs = [(1, "the storm broke the levee again", "a"), (2, "le vent recouvre la rue", "a"), (3, None, "b"), (4, "", None), (5, LONG, "b")]
    df = frame(spark, docs, "k bigint, text string, source string")
    sizes = materialize(mixing.sized(df, "k", "text", ["source"]))
    centers = mixing.fit_topics(sizes, "k", topics=2)
    got = {r["k"]: r for r in mixing.assigned(sizes, centers).collect()}
    assert got[3]["n_tokens"] == got[4]["n_tokens"] == 0 and got[5]["n_tokens"] > 10_000
    assert got[1]["topic"] != got[2]["topic"] and got[3]["topic"] == 0
    assert {r["k"]: r["n_tokens"] for r in tokens.token_counts(df, "k", "text").collect()} == {k: r["n_tokens"] for k, r in got.items()}
    assert mixing.fit_topics(sizes.limit(0), "k").shape == (1, mixing.DIMS)


# --- problem 7


def test_varied_subset(spark):
    """Ten subjects, one with nine tenths of the rows as near copies: all are covered."""
    r = random.Random(6)
    rows = []
    for i in range(600):
        s = 0 if i % 10 else (i // 10) % 10
        rows.append((i, [*(f"s{s}w{j}" for j in range(8)), f"own{r.randrange(30)}"], "x"))
    df = frame(spark, rows, "id bigint, terms array<string>, rank string").select("id", "rank", classes.token_set(F.col("terms")).alias("tokens"))
    got = [x["id"] for x in sorted(diverse.varied_subset(df, "id", "tokens", 10, per_round=4).collect(), key=lambda x: x["rank"])]
    assert len(set(got)) == 10
    assert len({0 if i % 10 else (i // 10) % 10 for i in got}) == 10
    held = diverse.coverage(df.withColumn("s", F.when(F.col("id") % 10 != 0, 0).otherwise((F.col("id") / 10).cast("int") % 10)), diverse.varied_subset(df, "id", "tokens", 10, per_round=4), "id", "s").first()
    assert (held["n_groups"], held["n_covered"], held["share_largest"]) == (10, 10, 0.1) and held["share_largest_all"] > 0.9
    again = diverse.varied_subset(df, "id", "tokens", 10, per_round=4).collect()
    assert {x["id"] for x in again} == set(got)


def test_varied_subset_at_the_edges(spark):
    df = frame(spark, [(1, [5, 6]), (2, None), (3, []), (4, [5, 6])], "id bigint, tokens array<bigint>")
    got = sorted((r["rank"], r["id"]) for r in diverse.varied_subset(df, "id", "tokens", 9, dims=16).collect())
    assert [i for _, i in got][0] == 1 and {i for _, i in got} == {1, 2, 3, 4}
    assert diverse.varied_subset(df.limit(0), "id", "tokens", 3).count() == 0


def test_more_records_than_dimensions(spark):
    df = frame(spark, [(i, [i % 30 + 1, i % 29 + 1000]) for i in range(60)], "id bigint, tokens array<bigint>")
    got = diverse.varied_subset(df, "id", "tokens", 40, per_round=8, dims=16).collect()
    assert len({r["id"] for r in got}) == 40


def test_pivots_reveal_rank():
    x = np.array([[3.0, 0, 0], [3, 0, 0], [0, 2, 0], [1, 1, 0]])
    assert diverse.pivots(x, 4) == [0, 2]


# --- queries


@needs_tokenizer
@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, name):
    check(spark, Q.QUERIES[name], Q.SQL[name])


@needs_tokenizer
@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["p1_report", "p2_groups", "p7_varied", "p8_containers", "p9_mix", "p9_marginals", "p10_pieces"])
def test_query_runs(spark, name):
    df = Q.QUERIES[name](spark, SF)
    assert df.count() > 0
