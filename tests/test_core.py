import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stormglass.functions import text as X
from stormglass.plans import queries as CORE
from stormglass.operators import cluster, evaluate, graph, lexrank, paths, select, topics
from stormglass.operators import steps as S
from stormglass.operators import vectors as V
from stormglass.runtime import scratch_dir, stream_table
from stormglass.sources import posts as P
from stormglass.sources import sinks
from stormglass.streaming import clusters, dedup, windows

STOP = "the of and in to a is for on by via".split()
TERMS = {
    "RT @bob: Storm hits the coast": ["storm", "hits", "coast"],
    "The mother's dog and the mothers' cats": ["mother", "dog", "mother", "cats"],
    "don't stop": ["don't", "stop"],
    "they’re late now": ["late", "now"],
    "Fish &amp; chips, 50% off!": ["fish", "chips", "50%", "off"],
    "meet at 10:30 on 1,234.5 km": ["meet", "at", "10:30", "1,234.5", "km"],
    "a.b c,d e;f": ["b", "c", "d", "e", "f"],
    "#Harvey update (via @abc)": ["#harvey", "update", "@abc"],
    "café storm": ["storm"],
    "see https://t.co/BVrO15VF7k now": ["see", "https://t.co/BVrO15VF7k", "now"],
    "storm storm surge": ["storm", "storm", "surge"],
    "cut https://t.co/ML…": ["cut"],
    "$5 cost 5$": ["$5", "cost", "5$"],
    "!!! ???": [],
    "": [],
    "what,, 1,,2 now!!": ["what", "1", "2", "now"],
}


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_terms_in_spark_and_sql(spark):
    rows = [*TERMS.items(), (None, [])]
    df = frame(spark, rows, "t string, want array<string>").withColumn("got", X.extract_terms(F.col("t"), STOP))
    for r in df.collect():
        assert r["got"] == r["want"], r["t"]
    c = duckdb.connect()
    c.execute("create table stop_words(word varchar)")
    c.executemany("insert into stop_words values (?)", [(w,) for w in STOP])
    c.execute("create table x(t varchar)")
    c.executemany("insert into x values (?)", [(t,) for t, _ in rows])
    got = c.execute(f"with {X.STOP_SQL} select t, {X.extract_terms_sql('t')} from x, stop").fetchall()
    assert {t: v for t, v in got} == dict(rows)


def words(spark, rows):
    return frame(spark, rows, "tweet_id string, created_at_ms bigint, step int, terms array<string>")


def test_time_step(spark):
    df = frame(spark, [(-5,), (0,), (3599999,), (3600000,)], "t bigint")
    assert [r[0] for r in df.select(S.time_step(F.col("t"), 0)).collect()] == [0, 0, 0, 1]


def test_edges_and_self_pairs(spark):
    w = words(spark, [("1", 0, 0, list("abcde"))])
    assert {(r["a"] + r["b"], r["weight"]) for r in graph.edges(w).collect()} == {(p, 1) for p in "ab ac ad bc bd be cd ce de".split()}
    assert [tuple(r) for r in graph.edges(words(spark, [("1", 0, 0, ["x", "x", "y"])])).collect()] == [("x", "y", 2)]
    assert graph.edges(words(spark, [("1", 0, 0, ["x"]), ("2", 0, 0, [])])).count() == 0


def test_walk_rank_of_one_edge(spark):
    nodes, steps = frame(spark, [("a",), ("b",)], "node string"), frame(spark, [("a", "b", 1.0)], "u string, v string, p double")
    got = {r["node"]: r["rank"] for r in graph.walk_rank(nodes, steps).collect()}
    assert got["a"] == pytest.approx(1 / 2.85) and got["b"] == pytest.approx(1.85 / 2.85)
    assert graph.series_rank(np.array([0]), np.array([1]), np.array([3.0]), 2) == pytest.approx([1 / 2.85, 1.85 / 2.85])


def test_walk_rank_agrees_with_sampled_walks():
    rng = np.random.default_rng(3)
    u, v = np.array([0, 0, 1, 2, 3, 4, 4]), np.array([1, 2, 2, 3, 0, 0, 3])
    w = np.array([1.0, 2, 1, 3, 1, 2, 1])
    out = {i: (v[u == i], w[u == i] / w[u == i].sum()) for i in range(5)}
    visits = np.zeros(5)
    for start in range(5):
        for _ in range(4000):
            at = start
            for _ in range(20):
                visits[at] += 1
                if rng.random() < 0.15 or not len(out[at][0]):
                    break
                at = rng.choice(out[at][0], p=out[at][1])
    assert graph.series_rank(u, v, w, 5) == pytest.approx(visits / visits.sum(), abs=0.01)


def test_weights_and_jaccards(spark):
    w = words(spark, [("1", 0, 0, ["x", "x"]), ("2", 0, 0, ["y"]), ("3", 0, 0, ["z"]), ("4", 0, 0, ["u"])])
    assert {r["term"]: round(r["weight"], 6) for r in V.weights(w, "tweet_id").collect()}["x"] == pytest.approx(2 * math.log(3), abs=1e-6)
    a, b = F.array(F.lit("storm"), F.lit("storm"), F.lit("surge")), F.array(F.lit("storm"))
    n = [F.array(*[F.lit(i) for i in x]) for x in ([1, 2, 3], [3, 4])]
    r = spark.range(1).select(X.list_jaccard(a, b).alias("l"), X.set_jaccard(a, b).alias("s"), X.novelty(n[1], n[0]).alias("n")).first()
    assert (r["l"], r["s"], r["n"]) == (1.0, 0.5, 0.25)


def test_similar_pairs_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(str(i), i, i % 2, [f"t{x}" for x in rng.integers(0, 12, 6)]) for i in range(30)]
    v = V.weights(words(spark, rows), "tweet_id", "step")
    got = {(r["a"], r["b"]): r["similarity"] for r in V.similar_pairs(v, "tweet_id", 0.2, "step").collect()}
    vec = {}
    for r in v.collect():
        vec.setdefault((r["step"], r["tweet_id"]), {})[r["term"]] = r["weight"]
    want = {}
    for (s, a), x in vec.items():
        for (t, b), y in vec.items():
            if s == t and a < b:
                cos = sum(x[k] * y.get(k, 0) for k in x) / math.sqrt(sum(q * q for q in x.values()) * sum(q * q for q in y.values()))
                if round(cos, 9) >= 0.2:
                    want[a, b] = cos
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("block", [7, 1000])
def test_pairs_of_blocks(spark, block):
    rng = np.random.default_rng(1)
    rows = [(g, int(k), int(t), float(w)) for g in range(2) for k in range(40) for t, w in zip(rng.choice(15, 5, replace=False), rng.random(5))]
    v = frame(spark, rows, "g int, k bigint, term bigint, weight double")
    one = {(r["g"], r["a"], r["b"]): r["similarity"] for r in V.similar_pairs(v, "k", 0.3, "g").collect()}
    got = V.blocked_pairs(v, "k", 0.3, "g", block).collect()
    two = {(r["g"], r["a"], r["b"]): r["similarity"] for r in got}
    assert one and len(got) == len(two) and one.keys() == two.keys() and all(one[k] == pytest.approx(two[k]) for k in one)
    assert V.blocked_pairs(v.limit(0), "k", 0.3, "g").count() == 0


def test_top_mass_and_top_k(spark):
    df = frame(spark, list(enumerate([0.1, 0.3, 0.3, 0.2, 0.05, 0.05])), "k int, v double")
    assert sorted(r["v"] for r in S.top_mass(df, "v", "k", 0.85).collect()) == [0.1, 0.2, 0.3, 0.3]
    assert [r["k"] for r in df.orderBy(F.desc("v"), "k").limit(2).collect()] == [1, 2]


def test_order_operators(spark):
    df = frame(spark, list(enumerate([1, 3, 2, 4, 4])), "o int, id bigint")
    assert S.running_max(df, "o", "id").where("id <= before").count() == 2
    assert [r["index"] for r in S.with_index(df, "o").orderBy("o").collect()] == [0, 1, 2, 3, 4]
    assert [r["o"] for r in S.skip_first(df, 2, "o", key="o").orderBy("o").collect()] == [2, 3, 4]


def test_snapshots_see_twelve_steps(spark):
    w = words(spark, [(str(s), s, s, ["x"]) for s in range(20)])
    seen = {r["step"] for r in S.snapshots(w).where("snapshot = 15").collect()}
    assert seen == set(range(3, 15))
    assert {r["step"] for r in S.snapshots(w, trigger_post=True).where("snapshot = 15").collect()} == set(range(3, 16))


def test_quantile_and_rouge(spark):
    assert V.normal_quantile(0.95) == pytest.approx(1.606192, abs=1e-6)
    own = frame(spark, [("m", 1, list("abc")), ("m", 2, ["q"])], "model string, step int, terms array<string>")
    ref = frame(spark, [(1, list("bcde")), (2, ["r"])], "step int, terms array<string>")
    r = {x["step"]: x for x in evaluate.rouge(own, ref, "step").collect()}
    assert (r[1]["p"], r[1]["r"], r[1]["f1"]) == (0.666667, 0.5, 0.571429)
    assert r[2]["f1"] is None


def test_lexrank_one_iteration():
    s = np.zeros((3, 3))
    s[0, 1] = s[1, 0] = 0.7
    assert lexrank.scores_of(s, 1) == pytest.approx([20 / 43, 20 / 43, 3 / 43])
    assert lexrank._power(["a", "b", "c"], np.array([0]), np.array([1]), np.array([0.7]), 1, True) == pytest.approx([20 / 43, 20 / 43, 3 / 43])


def test_summaries_stay_in_their_window_and_do_not_repeat(spark):
    rng = np.random.default_rng(5)
    rows = [(f"p{i:03}", i, i // 10, [f"t{x}" for x in rng.integers(0, 25, 5)]) for i in range(60)]
    w = words(spark, rows)
    snaps = S.snapshots(w)
    seen = {(r["snapshot"], r["tweet_id"]) for r in snaps.collect()}
    terms = {r[0]: frozenset(r[3]) for r in rows}
    for chosen in (select.inc_summary(w, snaps), lexrank.summary(snaps, 5)):
        got = chosen.collect()
        assert got and all((r["snapshot"], r["tweet_id"]) in seen for r in got)
        assert len({(r["snapshot"], r["rank_no"]) for r in got}) == len(got)
    by = {}
    for r in select.inc_summary(w, snaps).collect():
        by.setdefault(r["snapshot"], []).append(r["tweet_id"])
    assert all(select.jaccard(terms[a], terms[b]) <= 0.2 for ps in by.values() for a in ps for b in ps if a < b)


def test_subtopics_against_a_plain_version():
    """The same choice with sets and dictionaries, one neighbour after the other."""
    rng = np.random.default_rng(12)
    for _ in range(20):
        n, m = 14, 9
        posts = [sorted({int(x) for x in rng.integers(0, n, 4)}) for _ in range(m)]
        near = {i: {j for p in posts if i in p for j in p if j != i} for i in range(n)}
        held = {i: {k for k, p in enumerate(posts) if i in p} for i in range(n)}
        rank = {i: float(x) for i, x in enumerate(rng.random(n) / n)}
        utility = {t: r + sum(rank[o] for o in near[t]) for t, r in rank.items()}
        left, seen, done, covered, accepted, general = set(rank), 0.0, set(), set(), [], []
        while left:
            b = min(left, key=lambda t: (-round(utility[t], 12), t))
            left.discard(b)
            if len(held[b] - covered) / max(1, len(held[b] | covered)) > select.NOVELTY:
                general.append(b)
                covered |= held[b]
                continue
            seen += utility[b]
            if utility[b] <= 0 or utility[b] / seen < select.TOPICS_STOP:
                break
            accepted.append(b)
            for c in near[b]:
                if b not in done:
                    utility[c] -= rank[b] + rank[c]
                if c not in done:
                    for o in near[c]:
                        utility[o] -= rank[c]
                    done.add(c)
            done.add(b)
        flat = lambda d: (np.r_[0, np.cumsum([len(d[i]) for i in range(n)])].astype(np.int64), np.array([x for i in range(n) for x in sorted(d[i])], np.int64))
        assert select.subtopics(np.array([rank[i] for i in range(n)]), flat(near), flat(held), m) == accepted + general


def test_selectors_on_nothing():
    none = np.zeros(0, np.int64)
    assert select.subtopics(np.zeros(0), (np.zeros(1, np.int64), none), (np.zeros(1, np.int64), none), 0) == []
    assert select.choose_posts([], {}, {}) == []
    assert select.diversify([], {}) == []


def test_micro_clusters_and_kmeans(spark):
    rows = [(f"p{i:03}", i, i // 8, ["storm", "surge", f"t{i % 3}"]) for i in range(40)]
    got = cluster.micro_cluster_summary(words(spark, rows), k=4).collect()
    assert {r["step"] for r in got} == {1, 2, 3, 4} and max(r["rank_no"] for r in got) <= 4
    m = cluster.Micro()
    m.add("a", {"x": 1.0}, 1)
    assert m.average() == pytest.approx(1.0) and m.fresh() == 1.0
    e = frame(spark, [(i, [float(i // 5 * 10), 1.0 + i % 5 / 10]) for i in range(10)], "k bigint, v array<double>")
    labels = {r["k"]: r["cluster"] for r in cluster.kmeans(e, "k", "v", k=2).collect()}
    assert len(labels) == 10


def test_merge_of_many_clusters():
    o = cluster.Online()
    for i in range(160):
        c = cluster.Micro()
        c.add(str(i), {f"w{i // 2}": 1.0}, 0)
        o.clusters.append(c)
    o.merge()
    # As many are gone as three tenths of those left.
    assert len(o.clusters) == 123 and sum(c.n for c in o.clusters) == 160
    o = cluster.Online()
    for i in range(150):
        c = cluster.Micro()
        c.add(str(i), {f"w{i // 2}": 1.0, "all": 0.1}, 0)
        o.clusters.append(c)
    o.merge()
    assert len(o.clusters) == 115


def test_live_clusters_equal_those_of_one_batch(spark):
    rng = np.random.default_rng(4)
    rows = [(f"p{i:03}", i // 12, i * 1000, [f"t{x}" for x in rng.integers(0, 20, 5)], "ab"[i % 2]) for i in range(120)]
    df = frame(spark, rows, "tweet_id string, step int, created_at_ms bigint, terms array<string>, lang string")
    whole = {tuple(r) for r in cluster.micro_cluster_summary(df, "lang").select("stream", "step", "rank_no", "tweet_id").collect()}
    path = scratch_dir(spark)
    live = windows.replay(df, "step", 3, lambda stream: windows.run_to_table(clusters.cluster_stream(stream, "lang"), path))
    assert whole and {tuple(r) for r in live.select("stream", "step", "rank_no", "tweet_id").collect()} == whole


def test_selectors():
    terms = {p: frozenset(t) for p, t in {"1": "abc", "2": "abd", "3": "axy", "4": "bpq"}.items()}
    rank = {t: 0.1 for t in "abcdxypq"} | {"a": 0.3, "c": 0.2}
    chosen = {s: [p for p, _ in select.choose_posts(["a", "b"], rank, terms, score=s)] for s in select.SELECTORS}
    assert chosen["new"] == ["1", "3", "4"] and chosen["score_only"] == ["1", "3", "2", "4"]
    assert set(chosen["per_topic"]) == set(chosen["without_redundancy"]) == {"1", "3", "4"} and set(chosen["most_alike"]) == {"1", "2", "3", "4"}
    assert [p for p, _ in select.choose_posts(["b"], rank, terms, representative=True)] == ["4"]


def test_walks_are_taken_over():
    from stormglass.functions import sampling

    one = {("a", "b"): 1.0, ("a", "c"): 3.0, ("b", "c"): 1.0, ("c", "a"): 1.0}
    two = {**one, ("c", "d"): 1.0}
    store = sampling.WalkStore(walks=8000, from_there=True)
    store.update(["a", "b", "c"], one)
    store.update(["a", "b", "c", "d", "z"], two)
    assert 0 < store.rewalked < len(store.store) - store.new and store.new == 16_000
    e = sorted(two)
    at = {t: i for i, t in enumerate(store.names)}
    want = graph.series_rank(np.array([at[a] for a, _ in e]), np.array([at[b] for _, b in e]), np.array([two[x] for x in e]), 5)
    assert store.shares() == pytest.approx(want, abs=0.01)
    other = sampling.WalkStore(walks=8000)
    other.update(["a", "b", "c"], one)
    other.update(["a", "b", "c", "d", "z"], two)
    assert other.new == 16_000 and other.shares() == pytest.approx(want, abs=0.03)
    store.update(["b"], {})
    assert store.names == ["b"] and store.shares().tolist() == [1.0]


def test_state_ends_without_rows(spark):
    """A bucket whose identifiers are old goes with the watermark, though no row comes for it."""
    early = [(d, d, 0, 0, "a") for d in range(1, 9)]
    stream = as_stream(spark, [deliveries(spark, early), deliveries(spark, [(100, 1000, 900, 900, "b")]), deliveries(spark, [(101, 1000, 1000, 1000, "b")]), deliveries(spark, [(102, 3, 1100, 0, "a")])])
    out = dedup.first_copies(stream, "id", "delivery_id", "received_at", F.col("created_at"), "1 hour", 4)
    base = scratch_dir(spark)
    run = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out")
    run.awaitTermination()
    rows = [p.stateOperators[0].numRowsTotal for p in run.recentProgress if p.stateOperators]
    assert rows[0] == 4 and rows[-1] < 4
    assert {(r["key"], r["ord"]) for r in dedup.settle(spark.read.schema(dedup.OUT).parquet(f"{base}/out")).collect()} == {(1000, 101), (3, 102)}


def tagged(spark, texts):
    rows = frame(spark, list(enumerate(texts)), "i int, t string").select("i", paths.tag_text(F.col("t")).alias("n")).orderBy("i").collect()
    return [list(r["n"]) for r in rows]


def test_paths(spark):
    assert paths.join_positions([(1, 2), (2, 0)], [(1, 4), (1, 7), (2, 3), (3, 1)]) == [(1, 4), (2, 3)]
    assert paths.join_positions([(1, 1), (1, 2)], [(1, 3), (1, 4)]) == [(1, 3), (1, 4)] and paths.join_positions([(1, 1)], [(1, 2), (1, 3)]) == [(1, 2)]
    assert paths.path_score(3, 8) == 9.0 and paths.path_score(3, 8, "plain") == 3.0 and paths.path_score(3, 8, "length") == 24.0
    assert tagged(spark, ["The river flooded.", None, ""]) == [["the/dt", "river/nn", "flooded/vbd", "./."], ["./."], ["./."]]
    found = paths.Window(tagged(spark, ["The river wanted a muddied useful town.", "the river wanted our muddied useful town.", "the river wanted a muddied useful town today."])).sentences()
    assert any(paths.strip(c.nodes).startswith("the river wanted") for c in found)
    assert paths.strip(["storm/nn", "hits/vbd"]) == "storm hits ." and paths.strip(["a/nn", "xx", "our/prp$", "b/nn"]) == "a our b ."
    assert paths.Window([]).sentences() == []


def test_steps_of_a_window_are_joined_positions():
    rng = np.random.default_rng(8)
    posts = [[f"{'abcd'[x]}/nn" for x in rng.integers(0, 4, 9)] for _ in range(6)]
    w = paths.Window(posts)
    at = [(p, i) for p, nodes in enumerate(posts) for i in range(len(nodes))]
    for n in range(len(w.names)):
        places = w.where[n]
        for m, met in w.follow(places):
            assert [at[x] for x in met] == paths.join_positions([at[x] for x in places], [at[x] for x in w.where[m]])


VALID = [("river/nn looks/vbz useful/jj", True), ("useful/jj river/nn", True), ("the/dt useful/jj river/nn", False), ("it/prp looks/vbz useful/jj town/nn", True), ("river/nn looks/vbz", False), ("useful/jj to/to run/vb", True), ("quickly/rb in/in town/nn", True), ("useful/jj river/nn in/in", False), ("town/nn", False)]


def test_valid_sentences(spark):
    for r in frame(spark, VALID, "s string, want boolean").select("*", paths.valid(F.col("s")).alias("got")).collect():
        assert r["got"] == r["want"] == paths.is_valid(r["s"].split(" ")), r["s"]
    c = duckdb.connect()
    for s, want in VALID:
        assert c.execute(f"select {paths.valid_sql('s')} from (select ? as s)", [s]).fetchone()[0] == want


def test_valid_sentences_by_lists_and_patterns(spark):
    rng = np.random.default_rng(1)
    tags = ["nn", "nns", "vbd", "vbz", "vb", "jj", "rb", "dt", "prp", "prp$", "to", "in", "cc", "cd"]
    rows = [(" ".join(f"w{i}/{tags[x]}" for i, x in enumerate(rng.integers(0, len(tags), rng.integers(1, 7)))),) for _ in range(600)]
    got = frame(spark, rows, "s string").select("s", paths.valid(F.col("s")).alias("v")).collect()
    assert all(r["v"] == paths.is_valid(r["s"].split(" ")) for r in got) and 10 < sum(r["v"] for r in got) < 590


def test_node_classes(spark):
    df = frame(spark, [(["the/dt", "river/nn", "runs/nns", ",/,", "in/in", "./."],), (["the/dt", *["x/cd"] * 20, "late/nn"],)], "nodes array<string>")
    got = {r["node"]: r for r in paths.node_classes(df, "nodes").collect()}
    assert got["the/dt"]["starts"] and got["river/nn"]["starts"] and not got["late/nn"]["starts"] and not got["x/cd"]["starts"]
    assert got[",/,"]["ends"] and got["./."]["ends"] and got["./."]["stops"] and not got[",/,"]["stops"]
    assert got["in/in"]["collapsible"] and not got["river/nn"]["collapsible"]
    assert {(r["a"], r["b"]) for r in paths.adjacent(frame(spark, [(["a/nn", "a/nn", "./.", "b/nn"],)], "nodes array<string>"), "nodes").collect()} == {("a/nn", "./.")}


def test_similar_sentences_stand_for_each_other():
    c = lambda words, gain, level: paths.Candidate(tuple(f"{w}/nn" for w in words), gain, level, [])
    kept = paths.deduplicate([c("abc", 1.0, 3), c("abd", 2.0, 3), c("xyz", 0.5, 3)])
    assert {k.nodes[2] for k in kept} == {"d/nn", "z/nn"}
    # More gain in fewer nodes does not take the place of a longer one.
    kept = paths.deduplicate([c("abc", 1.0, 3), c("abd", 2.0, 2)])
    assert [k.nodes[2] for k in kept] == ["c/nn"]


def test_topics(spark):
    rng = np.random.default_rng(2)
    rows = [(f"p{i}", t) for i in range(40) for t in rng.permutation([f"{'ab'[i % 2]}{j}" for j in range(8)])[:7]]
    core = topics.core_terms(frame(spark, rows, "tweet_id string, term string"))
    phi, theta = topics.fit(core, topics=2, sweeps=60, burn=20, every=10)
    got = {r["tweet_id"]: r for r in topics.infer(core, phi, theta).collect()}
    a, b = ({got[f"p{i}"]["topic"] for i in range(k, 40, 2)} for k in (0, 1))
    assert len(a) == len(b) == 1 and a != b
    assert all(r["posterior"] > 0.8 for r in got.values())
    assert phi.groupBy("topic").agg(F.sum("phi").alias("s")).where("abs(s - 1) > 1e-9").count() == 0
    assert theta.agg(F.sum("theta")).first()[0] == pytest.approx(1)
    none = frame(spark, [], "tweet_id string, term string")
    assert topics.core_terms(none).count() == 0 and topics.fit(none)[0].count() == 0


def test_every_post_and_term_takes_part(spark, monkeypatch):
    """Posts in several parts: all are counted, and posts with terms the model lacks get a topic too."""
    monkeypatch.setattr(topics, "POSTS_PER_PART", 30)
    rows = [(f"p{i}", f"{'ab'[i % 2]}{(i // 2 + j) % 9}") for i in range(120) for j in range(5)]
    core = frame(spark, rows, "tweet_id string, term string")
    phi, theta = topics.fit(core, topics=2, sweeps=60, burn=20, every=10)
    assert phi.select("term").distinct().count() == 18
    late = frame(spark, [*rows, ("new", "unseen"), ("mixed", "a1"), ("mixed", "unseen")], "tweet_id string, term string")
    got = {r["tweet_id"]: r for r in topics.infer(late, phi, theta).collect()}
    assert len(got) == 122 and got["mixed"]["topic"] == got["p0"]["topic"] and got["mixed"]["n_unique"] == 2
    assert got["p0"]["topic"] != got["p1"]["topic"] and got["new"]["n_unique"] == 1


def test_sampler_agrees_with_a_plain_one():
    """The odds of a single post against counts, with a repeated term."""
    terms, total, per = np.array([[5.0, 1, 0], [0, 2, 6]]), np.array([6.0, 8]), np.array([3.0, 4])
    n = np.zeros(2)
    for seed in range(4000):
        t, tt, p = terms.copy(), total.copy(), per.copy()
        s = topics.Sampler([[0, 0, 1]], np.array([0]), 3, 2, 0.5)
        t[0] += [2, 1, 0]
        tt[0] += 3
        p[0] += 1
        s.sweep(t, tt, p, 1.0, np.random.default_rng(seed))
        n[s.z[0]] += 1
        assert t.sum() == terms.sum() + 3 and tt.sum() == total.sum() + 3 and p.sum() == per.sum() + 1
    odds = [(p + 1) * (a + 0.5) * (a + 1.5) * (b + 0.5) / ((l + 1.5) * (l + 2.5) * (l + 3.5)) for p, a, b, l in ((3, 5, 1, 6), (4, 0, 2, 8))]
    assert n[0] / 4000 == pytest.approx(odds[0] / sum(odds), abs=0.02)


def test_counts_are_collected_once_per_exchange(spark, monkeypatch):
    core = frame(spark, [(f"p{i}", f"{'ab'[i % 2]}{j}") for i in range(20) for j in range(5)], "tweet_id string, term string")
    calls, plain = [], type(core).collect
    monkeypatch.setattr(type(core), "collect", lambda self: calls.append(1) or plain(self))
    phi, _ = topics.fit(core, topics=2, sweeps=60, burn=20, every=10)
    assert len(calls) <= 7
    monkeypatch.undo()
    assert phi.groupBy("topic").agg(F.sum("phi").alias("s")).where("abs(s - 1) < 1e-9").count() == 2


def test_sweep_takes_few_logs(monkeypatch):
    """A draw changes few counts: a sweep takes no log for every token and topic."""
    taken = []

    class Counting:
        def __getattr__(self, name):
            return (lambda x, **how: taken.append(np.size(x)) or np.log(x, **how)) if name == "log" else getattr(np, name)

    posts = [[(i + 2 * j) % 50 for j in range(20)] for i in range(500)]
    s = topics.Sampler([sorted(p) for p in posts], np.arange(500) % 30, 50, 30, 0.01)
    terms = np.zeros((30, 50))
    np.add.at(terms, (s.z[s.post], s.term), 1)
    total, per = np.bincount(s.z, s.size, 30).astype(float), np.bincount(s.z, minlength=30).astype(float)
    monkeypatch.setattr(topics, "np", Counting())
    s.sweep(terms, total, per, 1.0, np.random.default_rng(1))
    want = np.zeros((30, 50))
    np.add.at(want, (s.z[s.post], s.term), 1)
    assert sum(taken) < 10_000 * 30 / 2 and (terms == want).all()


def test_filter_of_core_terms_runs_to_its_end(spark):
    """A chain in which each round takes away what kept the next in."""
    rows = []
    for i in range(9):
        # Post i holds terms i, i+1, i+2; only dropping from one end starts the chain.
        rows += [(f"p{i}", f"t{i + j}") for j in range(3)]
    rows += [(f"q{k}", f"s{j}") for k in range(5) for j in range(3)]
    got = topics.core_terms(frame(spark, rows, "tweet_id string, term string"), least_count=2, least_terms=3)
    assert {r[0] for r in got.select("tweet_id").distinct().collect()} == {f"q{k}" for k in range(5)}


def test_tsv_json_round_trip(spark):
    rows = [("1", "null", 5, None, "a\tb\nc"), ("2", "null", 6, "u", "x y")]
    df = frame(spark, rows, P.TSV)
    path = scratch_dir(spark)
    sinks.write_tsv(df, path)
    assert {tuple(r) for r in P.read_tsv(spark, path).select("tweet_id", "created_at_ms", "user_id", "text").collect()} == {("1", 5, None, "a b c"), ("2", 6, "u", "x y")}
    path = scratch_dir(spark)
    frame(spark, [('{"id": 1, "text": "a", "user": {"id": 7}}',), ('{"text": "b"}',)], "v string").write.text(path)
    assert [(r["id"], r["user"]["id"], r["text"]) for r in P.read_json(spark, path).collect()] == [(1, 7, "a")]
    s = frame(spark, [("inc", 1, 1, "<a> & b"), ("inc", 1, 2, "RT @x: second"), ("m", 1, 1, "left")], "model string, step int, rank_no int, text string")
    path = scratch_dir(spark)
    sinks.ab_pages(s, sinks.ab_plan(spark, ["m"], [1], [1, 2]), path)
    pages = sorted(r["value"] for r in spark.read.text(f"{path}/pages", wholetext=True).collect())
    assert len(pages) == 2 and all("&lt;a&gt; &amp; b" in p and "left" in p for p in pages) and sum("second" in p for p in pages) == 1
    assert spark.read.option("header", True).csv(f"{path}/key").count() == 2


def test_all_selectors_share_one_graph(spark, monkeypatch):
    calls = []
    edges = select.graph.window_edges
    monkeypatch.setattr(select.graph, "window_edges", lambda *a: calls.append(1) or edges(*a))
    got = CORE.QUERIES["gr11_alt_selectors"](spark, "/root/testdata/sf0.001").select("selector").distinct().collect()
    assert len(calls) == 1 and {r["selector"] for r in got} == {*select.SELECTORS, "representative"}


def test_alike_in_blocks(monkeypatch):
    terms = {f"p{i}": frozenset(("t", f"a{i % 3}", f"b{i % 5}", *(["c"] if i % 2 else []))) for i in range(40)}
    monkeypatch.setattr(select, "ALIKE_BLOCK", 100, raising=False)
    want = {p: sum(select.jaccard(terms[p], terms[q]) for q in terms if q != p) for p in terms}
    assert select.alike(list(terms), terms) == pytest.approx(want)


DELIVERIES = "delivery_id bigint, id bigint, received_at timestamp, created_at timestamp, text string, key string"


def deliveries(spark, rows):
    from datetime import datetime, timedelta

    base = datetime(2019, 8, 19)
    at = lambda h: None if h is None else base + timedelta(hours=h)
    return frame(spark, [(d, i, at(r), at(c), t, "x") for d, i, r, c, t in rows], DELIVERIES)


def as_stream(spark, batches):
    path = scratch_dir(spark)
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(DELIVERIES).option("maxFilesPerTrigger", 1).parquet(path)


def brute(rows):
    first = {}
    for d, i, *_ in rows:
        if i is not None:
            first[i] = min(d, first.get(i, d))
    return {(i, d) for d, i, *_ in rows if i is not None and d != first[i]}


@pytest.mark.parametrize("horizon", ["1 hour", "10 days"])
def test_copies_over_batches(spark, horizon):
    """Copies in one batch, later batches, out of order, after the horizon, with null and late times."""
    one = [(1, 10, 0, 0, "a"), (2, 10, 0, 0, "a"), (3, 20, 0, None, None), (4, None, 0, 0, ""), (9, 40, 1, 1, "z")]
    two = [(5, 10, 30, 0, "b"), (6, 20, 30, None, "x" * 100_000), (8, 30, 31, 31, "c"), (7, 30, 31, 31, "c")]
    three = [(10, 30, 90, 31, "c"), (11, 10, 90, None, "a"), (12, 50, 90, 90, "n"), (0, 40, 91, 1, "early")]
    rows = one + two + three
    stream = as_stream(spark, [deliveries(spark, r) for r in (one, two, three)])
    got = dedup.copies(stream, "id", "delivery_id", "received_at", F.col("created_at"), horizon, buckets=4).collect()
    assert {(r["key"], r["ord"]) for r in got} == brute(rows) and len(got) == len(brute(rows))


def test_copies_delivered_behind_the_watermark(spark):
    """Files that do not come in order of delivery: rows whose delivery is older than the watermark count like the others."""
    one = [(1, 10, 0, 0, "a"), (2, 20, 500, 500, "b"), (3, 60, None, 510, "n"), (4, 70, 400, 520, "ahead")]
    two = [(5, 10, 1, 0, "a"), (6, 30, 2, 1, "c"), (7, 30, 3, 1, "c"), (8, 40, 4, 4, "d"), (13, 90, 505, 505, "m")]
    three = [(9, 40, 5, 4, "d"), (10, 20, 6, 500, "b"), (0, 30, 7, 1, "c"), (11, 60, 501, 510, "n"), (12, 70, 501, 520, "ahead")]
    rows = one + two + three
    stream = as_stream(spark, [deliveries(spark, r) for r in (one, two, three)])
    got = dedup.copies(stream, "id", "delivery_id", "received_at", F.col("created_at"), "1 hour", buckets=4).collect()
    assert {(r["key"], r["ord"]) for r in got} == brute(rows) and len(got) == len(brute(rows))


def test_copies_of_one_hot_message_and_of_nothing(spark):
    rows = [(i, 7 if i % 3 else i, i // 100, i // 100, "t") for i in range(600)]
    stream = as_stream(spark, [deliveries(spark, rows[:300]), deliveries(spark, rows[300:])])
    got = dedup.copies(stream, "id", "delivery_id", "received_at", F.col("created_at"))
    assert {(r["key"], r["ord"]) for r in got.collect()} == brute(rows)
    empty = as_stream(spark, [deliveries(spark, [])])
    assert dedup.copies(empty, "id", "delivery_id", "received_at", F.col("created_at")).count() == 0


def test_copies_go_on_from_their_checkpoint(spark):
    path, base = scratch_dir(spark), scratch_dir(spark)
    one, two = [(1, 10, 0, 0, "a"), (2, 20, 0, 0, "a")], [(3, 10, 1, 0, "a"), (4, 30, 1, 1, "a")]
    run = lambda: dedup.copies(spark.readStream.schema(DELIVERIES).parquet(path), "id", "delivery_id", "received_at", F.col("created_at"), checkpoint=base)
    deliveries(spark, one).write.mode("append").parquet(path)
    assert run().count() == 0
    deliveries(spark, two).write.mode("append").parquet(path)
    assert [(r["key"], r["ord"]) for r in run().collect()] == [(10, 3)]


def test_many_files_make_a_bounded_number_of_batches(spark, monkeypatch):
    sf, base = (scratch_dir(spark).removeprefix("file:") for _ in range(2))
    ids = [i if i % 3 else i // 6 for i in range(144)]
    rows = [(i, x, i // 3, x // 3, "t") for i, x in enumerate(ids)]
    for i in range(36):
        df = deliveries(spark, rows[4 * i : 4 * i + 4]).withColumn("created_at", F.date_format("created_at", "EEE MMM dd HH:mm:ss Z yyyy"))
        df.coalesce(1).write.mode("append").parquet(f"{sf}/hurricane_harvey.parquet")
    monkeypatch.setattr(dedup, "scratch_dir", lambda spark: base)
    got = {(r["id"], r["delivery_id"]) for r in CORE.QUERIES["p3_found"](spark, sf).collect()}
    batches = [x for x in os.listdir(f"{base}/state/sources/0") if not x.startswith(".")]
    assert got == brute(rows) and 9 <= len(batches) <= 16


def test_late_rows_over_batches(spark):
    rows = [(1, 100), (2, 50), (3, None), (4, 200), (5, 120), (6, 195), (7, 189), (8, 300), (9, 289)]
    df, path = frame(spark, rows, "d bigint, ms bigint"), scratch_dir(spark)
    got = windows.replay(df, "d", 3, lambda stream: windows.late_rows(stream, path, "d", "ms", 10)).collect()
    assert {(r["d"], r["late_ms"]) for r in got} == {(2, 50), (5, 80), (7, 11), (9, 11)}
    none = windows.replay(df.limit(0), "d", 2, lambda stream: windows.late_rows(stream, scratch_dir(spark), "d", "ms", 10))
    assert none.count() == 0


def test_output_per_step_is_replaced(spark):
    path = scratch_dir(spark)
    rows = [[("a", 0), ("b", 1)], [("c", 1), ("d", 2)]]
    for r in rows:
        frame(spark, r, "tweet_id string, step int").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("tweet_id string, step int").option("maxFilesPerTrigger", 1).parquet(path)
    out = windows.per_batch(stream, scratch_dir(spark), lambda df: df.groupBy("step").agg(F.count(F.lit(1)).alias("n")))
    assert {(r["step"], r["n"]) for r in out.collect()} == {(0, 1), (1, 2), (2, 1)}


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stream_of_a_single_file(spark):
    assert stream_table(spark, SF, "posts").isStreaming


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(CORE.SQL))
def test_query_equals_sql(spark, name):
    check(spark, CORE.QUERIES[name], CORE.SQL[name])


#: What a result without SQL must hold, whatever the data.
@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(CORE.QUERIES.keys() - CORE.SQL.keys()))
def test_query_without_sql(spark, name):
    got = [r.asDict() for r in CORE.QUERIES[name](spark, SF).collect()]
    assert got or name in ("gr20_path_search", "gr21_collapse")
    at = next((k for k in ("snapshot", "step") if got and k in got[0]), None)
    if got and "rank_no" in got[0]:
        by = {}
        for r in got:
            by.setdefault((r.get("stream"), r.get("selector"), r.get("model"), r[at]), []).append(r["rank_no"])
        assert all(sorted(v) == list(range(1, len(v) + 1)) for v in by.values()), "ranks run from 1 without a gap"
    if got and "tweet_id" in got[0] and name not in ("st5_st6_online_clusters",):
        known = {r["tweet_id"]: r["step"] for r in P.words(spark, SF).select("tweet_id", "step").collect()}
        assert all(known[r["tweet_id"]] <= r[at] for r in got), "only posts the window sees"


def check(spark, query, sql):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f[:-8]} as select * from read_parquet('{SF}/{f}')")
    df = query(spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[k] for k in cols)) for r in df.collect())
    want = sorted(repr(r) for r in c.execute(f"select {', '.join(cols)} from ({sql})").fetchall())
    assert got == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["step", "rank_no", "tweet_id", "text", "score"] and rows.count() > 0


def test_alias_table_and_walks():
    from stormglass.functions import sampling

    keep, alias = sampling.alias_table([0.4, 0.15, 0.1, 0.35])
    assert keep == pytest.approx([0.25, 0.15, 0.1, 0.2]) and alias == [0, 0, 3, 0]
    drawn = np.bincount(sampling.draw(keep, alias, np.random.default_rng(0), 100_000), minlength=4) / 100_000
    assert drawn == pytest.approx([0.4, 0.15, 0.1, 0.35], abs=0.01)
    u, v, w = np.array([0, 0, 1, 2]), np.array([1, 2, 2, 0]), np.array([1.0, 3, 1, 1])
    visits = sampling.sample_walks(u, v, w, 3, walks=20_000)
    assert visits / visits.sum() == pytest.approx(graph.series_rank(u, v, w, 3), abs=0.01)


def test_joined_sentences(spark):
    texts = ["muddied river flooded in useful Northfield market.", "muddied river flooded in bountiful Lakewood harbor."] * 2
    found = paths.Window(tagged(spark, texts)).sentences()
    joined = [paths.strip(c.nodes) for c in found if c.joined]
    assert any("northfield" in s and "lakewood" in s and " and " in s for s in joined), [paths.strip(c.nodes) for c in found]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_every_language_is_clustered(spark):
    h = spark.read.parquet(f"{SF}/hurricane_harvey.parquet")
    got = {r["stream"] for r in CORE.QUERIES["st5_st6_online_clusters"](spark, SF).select("stream").distinct().collect()}
    assert h.where("lower(lang) = 'en'").count() and "en" in got


def test_paths_reach_an_end_of_one_post(spark):
    """Only one of the two posts ends after the words they share."""
    found = paths.Window(tagged(spark, ["useful river.", "useful river in towns we know"])).sentences()
    assert [c.nodes for c in found] == [("useful/jj", "river/nn")] and len(found[0].places) == 1


def test_every_path_is_tried(spark):
    # More than 20,000 paths from the first word; the one along all words comes last.
    names = ["useful", *[c * 2 for c in "zyxwvutsrqponml"]]
    texts = [" ".join(names)] * 2 + [f"{a} {b}" for i, a in enumerate(names) for b in names[i + 2 : i + 4]]
    found = {paths.strip(c.nodes) for c in paths.Window(tagged(spark, texts)).sentences()}
    assert " ".join([*names, "."]) in found


def test_first_step_is_clustered_by_kmeans(monkeypatch):
    import pandas as pd

    starts, forget = [], cluster.Online.forget
    monkeypatch.setattr(cluster.Online, "forget", lambda o, before: (starts.append([c.n for c in o.clusters]), forget(o, before)))
    # Posts without a common word would each start a cluster.
    rows = [(f"p{i:02}", i // 30, i, [f"w{i}"]) for i in range(31)]
    cluster.online_clusters(pd.DataFrame(rows, columns=["tweet_id", "step", "created_at_ms", "terms"]))
    assert len(starts[0]) <= 10 and sum(starts[0]) == 30
