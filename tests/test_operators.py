import datetime as dt
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.operators import conversations, corpus, relational, retrieval, scoring, sessions

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_asof_takes_the_latest_within_the_tolerance(spark):
    left = spark.createDataFrame([(1, "a", at(10)), (2, "a", at(100)), (3, "b", at(10)), (4, None, at(10))], "k int, u string, ts timestamp")
    right = spark.createDataFrame([(1, "a", at(5), 1.0), (2, "a", at(8), 2.0), (3, "a", at(8), 3.0), (4, "a", at(11), 4.0)], "e int, u string, ts timestamp, v double")
    got = {r["k"]: r["v_asof"] for r in relational.asof_join(left, right, ["u"], "ts", "v", 600, "e").collect()}
    assert got == {1: 3.0, 2: None, 3: None, 4: None}


def test_drop_excess_keeps_the_first_of_hot_keys_only(spark):
    rows = spark.createDataFrame([("hot", k) for k in range(500)] + [("few", k) for k in range(5)], "g string, k int")
    got = relational.drop_excess(rows, ["g"], ["k"]).collect()
    assert sorted(r["k"] for r in got if r["g"] == "hot") == [0, 1] and sum(r["g"] == "few" for r in got) == 5
    assert relational.drop_excess(rows.limit(0), ["g"], ["k"]).count() == 0


def test_batches_number_without_gaps(spark):
    rows = spark.range(0, 5000, 7).withColumnRenamed("id", "k")
    got = [r["batch_no"] for r in relational.batches(rows, "k", 100, 9).orderBy("k").collect()]
    assert got == [k // 100 for k in range(len(got))]
    assert relational.batches(rows.limit(0), "k", 100).count() == 0


def test_upsert_and_changes(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, s string, n int")
    new = spark.createDataFrame([(2, None, 5), (3, "c", 3)], "k int, s string, n int")
    assert sorted(map(tuple, relational.upsert(old, new, ["k"]).collect())) == [(1, "a", 1), (2, "b", 5), (3, "c", 3)]
    assert sorted(map(tuple, relational.changes(old, new, "k", ["s", "n"]).collect())) == [(1, "removed"), (2, "changed"), (3, "added")]


def test_two_hops_keep_nodes_without_neighbours(spark):
    nodes = spark.createDataFrame([("x",), ("y",)], "a string")
    first = spark.createDataFrame([("x", "m"), ("x", "n")], "a string, b string")
    second = spark.createDataFrame([("m", 2), ("m", 1)], "b string, c int")
    got = {r["a"]: r["neighbours"] for r in relational.two_hops(nodes, first, second, "a", "b", "c").collect()}
    assert got["y"] is None and [(n["b"], n["leaves"]) for n in got["x"]] == [("m", [1, 2]), ("n", [])]


def test_retained_keeps_rows_without_a_time(spark):
    rows = spark.createDataFrame([(1, T0), (2, None), (3, at(60 * 24 * 9))], "k int, ts timestamp")
    assert sorted(r["k"] for r in relational.retained(rows, "ts", F.lit(str(at(60 * 24 * 10))).cast("timestamp"), 7).collect()) == [2, 3]


def test_top_k_leaves_out_zero_and_null_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 0.0]), (5, [0.0, 1.0])], "vec_id int, embedding array<double>")
    assert [r["vec_id"] for r in retrieval.top_k(rows, [1.0, 0.0], 2).collect()] == [1, 4]
    plan = retrieval.top_k(rows, [1.0, 0.0], 2)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-5, 5), st.integers(-5, 5)), min_size=1, max_size=25))
def test_top_k_each_equals_brute_force(spark, items):
    rows = spark.createDataFrame([(k, [float(a), float(b) + 0.5]) for k, (_, a, b) in enumerate(items)], "k int, embedding array<double>")
    queries = rows.where("k % 4 = 0").select(F.col("k").alias("q"), F.col("embedding").alias("query_vector"))
    got = retrieval.top_k_each(queries, rows, 3, "q", "k").collect()

    def cos(x, y):
        return sum(a * b for a, b in zip(x, y)) / (sum(a * a for a in x) ** 0.5 * sum(b * b for b in y) ** 0.5)

    vectors = {k: [float(a), float(b) + 0.5] for k, (_, a, b) in enumerate(items)}
    for q in (k for k in vectors if k % 4 == 0):
        want = sorted((-cos(vectors[q], v) for v in vectors.values()))[:3]
        have = sorted(-r["sim"] for r in got if r["q"] == q)
        assert len(have) == len(want) and all(abs(a - b) < 1e-9 for a, b in zip(want, have))


def test_candidates_and_diversity(spark):
    a = spark.createDataFrame([(1, "same text here", 1), (2, "other words", 2)], "k int, t string, rank int")
    b = spark.createDataFrame([(3, "same text here", 1), (4, "third thing", 2)], "k int, t string, rank int")
    assert [r["k"] for r in retrieval.union_candidates([a, b], "k", "t").collect()] == [1, 2, 4]
    rows = spark.createDataFrame([("q", 1, "a b c d", 0.9), ("q", 2, "a b c d", 0.8), ("q", 3, "x y z", 0.7)], "g string, k int, t string, s double")
    assert [r["k"] for r in retrieval.pick_diverse(rows, "g", "k", "t", "s").orderBy("rank").collect()] == [1, 3]


def test_diverse_choice_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary, domain, query = [f"w{k}" for k in range(30)], ["w1", "w2", "w3"], "w4 W5 w1"
    docs = []
    for k in range(120):
        opening = " ".join(["same"] * 60 + [f"o{j}" for j in range(60)]) if k % 3 == 0 else ""
        docs.append((k, "ab"[k % 2], f"{opening} {' '.join(rng.sample(vocabulary, 24 if k % 5 else 12))} t{k % 7}\n", rng.randrange(8) / 8))
    docs += [(200, "a", docs[0][2] + " tail " * 3, 1.0), (201, "a", "x " + docs[1][2], 1.0), (202, "a", " ", 1.0)]

    def overlap(a, b):
        if not a or not b:
            return 0.0
        weight = sum(2.0 if w in domain else 1.5 if w in query.lower().split() else 1.0 for w in a & b)
        return weight / max(len(a | b) + 0.5 * sum(w in domain for w in (a | b) - (a & b)), 1.0)

    want = {}
    for group in "ab":
        chosen = []
        for k, _, text, _ in sorted((d for d in docs if d[1] == group), key=lambda d: (-d[3], d[0]))[:15]:
            words = set(text.lower().split())
            if len(chosen) < 5 and all(overlap(words, w) <= 0.75 for _, w in chosen):
                chosen.append((k, words))
        want[group] = [k for k, _ in chosen]
    top = retrieval.best_each(spark.createDataFrame(docs, "k int, g string, t string, s double"), "g", "k", "s")
    got = retrieval.pick_diverse(top, "g", "k", "t", "s", domain=spark.createDataFrame([(w,) for w in domain], "term string"), query=query).orderBy("g", "rank").collect()
    assert {g: [r["k"] for r in got if r["g"] == g] for g in "ab"} == want


def test_best_sources(spark):
    rows = spark.createDataFrame([(1, "s", "backup plan", 7), (2, "s", None, 1), (3, None, "nothing", 7)], "doc_id int, source string, text string, member_id int")
    got = retrieval.best_sources(rows, "backup plan").collect()
    assert [(r["source"], r["score"], r["best_key"]) for r in got] == [("s", 1.0, 1), ("unknown", 0.0, 3)]


def test_corpus_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id int, text string")
    assert corpus.document_frequency(none).count() == 0 and corpus.tfidf_terms(none).count() == 0 and corpus.structure_stats(none).first()["documents"] == 0


def test_conversations(spark):
    rows = spark.createDataFrame(
        [(1, 1, 0, 9, "HumanMessage", "what is a backup?"), (2, 1, 1, 9, "AI", "a copy"), (3, 1, 1, 9, "AI", "a copy"), (4, 1, 2, 9, "user", "more"), (5, 2, 0, 9, "odd", "x"), (6, 2, 1, 9, None, None)],
        "message_id int, conv_id int, turn int, member_id int, type string, content string",
    )
    assert [tuple(r) for r in conversations.turn_pairs(rows).collect()] == [(1, 0, "what is a backup?", "a copy")]
    assert [tuple(r) for r in conversations.titles(rows).collect()] == [(1, "A backup?")]
    assert conversations.history(rows).first()["history"] == "User: what is a backup?\n\nAssistant: a copy\n\nUser: more"
    assert [tuple(r) for r in conversations.user_analytics(rows).collect()] == [(9, 2, 6)]


def test_spread_only_small_inputs_of_few_files(spark, tmp_path, monkeypatch):
    from skein.operators import spread

    path = str(tmp_path / "a b")
    spark.range(100).coalesce(1).write.parquet(path)
    rows = spark.read.parquet(path)
    assert spread.spread(rows).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread.spread(rows).count() == 100
    monkeypatch.setattr(spread, "SMALL_BYTES", 1)
    assert spread.spread(rows).rdd.getNumPartitions() == 1
    assert spread.spread(spark.range(3)).count() == 3


def test_asof_keeps_equal_left_rows_and_matches_nothing_on_nulls(spark):
    left = spark.createDataFrame([(1, "a", at(10)), (1, "a", at(10)), (2, None, at(10)), (3, "a", None)], "k int, u string, ts timestamp")
    right = spark.createDataFrame([(1, "a", at(5), 1.0), (2, None, at(5), 9.0), (3, "a", None, 8.0), (4, "a", at(-3), 0.0)], "e int, u string, ts timestamp, v double")
    got = sorted((r["k"], r["v_asof"], r["age_seconds"]) for r in relational.asof_join(left, right, ["u"], "ts", "v", 600, "e").collect())
    assert got == [(1, 1.0, 300.0), (1, 1.0, 300.0), (2, None, None), (3, None, None)]
    assert relational.asof_join(left, right.limit(0), ["u"], "ts", "v", 600, "e").count() == 4 and relational.asof_join(left.limit(0), right, ["u"], "ts", "v", 600, "e").count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 60)), max_size=15), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 60)), max_size=15))
def test_asof_equals_brute_force(spark, asked, known):
    left = spark.createDataFrame([(k, u, at(m)) for k, (u, m) in enumerate(asked)], "k int, u int, ts timestamp")
    right = spark.createDataFrame([(k, u, at(m), float(k)) for k, (u, m) in enumerate(known)], "e int, u int, ts timestamp, v double")
    got = {r["k"]: r["v_asof"] for r in relational.asof_join(left, right, ["u"], "ts", "v", 7 * 60, "e").collect()}
    want = {k: max(((m2, e) for e, (u2, m2) in enumerate(known) if u2 == u and m - 7 <= m2 <= m), default=(0, None))[1] for k, (u, m) in enumerate(asked)}
    assert got == {k: None if e is None else float(e) for k, e in want.items()}


def test_prefixes_may_be_empty_or_null(spark):
    rows = spark.createDataFrame([(1, "alpha"), (2, "alps"), (3, "beta"), (4, None)], "k int, c string")
    names = spark.createDataFrame([("alpha", "x"), ("al?", "alp"), ("any", ""), ("none", None), ("long", "alphabetic")], "name string, prefix string")
    got = {(r["name"], r["k"], r["match"]) for r in relational.exact_or_prefix(rows, names, "c").collect()}
    assert got == {("alpha", 1, "exact"), ("al?", 1, "prefix"), ("al?", 2, "prefix"), *(("any", k, "prefix") for k in (1, 2, 3))}


def test_batches_with_an_outlier(spark):
    rows = spark.createDataFrame([(k,) for k in [*range(500), 10**15]], "k long")
    got = [r["batch_no"] for r in relational.batches(rows, "k", 100, 8).orderBy("k").collect()]
    assert got == [k // 100 for k in range(501)]


def test_running_over_cells_equals_one_window(spark):
    rows = spark.createDataFrame([(k, k % 2, at(k * 500), float(k) if k % 3 else None) for k in range(40)], "k int, u int, ts timestamp, v double")
    got = {r["k"]: (r["running_sum"], r["running_count"]) for r in relational.running(rows, ["u"], "ts", "k", "v").collect()}
    for k in range(40):
        seen = [float(j) for j in range(k + 1) if j % 2 == k % 2 and j % 3]
        assert got[k] == (sum(seen), len(seen))


def test_top_k_each_in_blocks_of_queries(spark, monkeypatch):
    rng = random.Random(3)
    rows = spark.createDataFrame([(k, [rng.random(), rng.random(), None if k == 5 else 0.5]) for k in range(60)] + [(90, None), (91, [0.0, 0.0, 0.0])], "k int, embedding array<double>")
    queries = rows.where("k < 7 or k > 80").select(F.col("k").alias("q"), F.col("embedding").alias("query_vector"))
    whole = sorted(map(tuple, retrieval.top_k_each(queries, rows, 4, "q", "k").collect()))
    assert len(whole) == 28 and all(r[0] == r[1] for r in whole if r[3] == 1)
    monkeypatch.setattr(retrieval, "QUERY_ROWS", 2)
    assert sorted(map(tuple, retrieval.top_k_each(queries, rows.repartition(7), 4, "q", "k").collect())) == whole
    assert retrieval.top_k_each(queries.limit(0), rows, 4, "q", "k").count() == 0 == retrieval.top_k_each(queries, rows.limit(0), 4, "q", "k").count()


def test_frequency_bounds():
    assert corpus.frequency_bounds(3) == (1, 0.9) and corpus.frequency_bounds(1000) == (3, 0.9) and corpus.frequency_bounds(40) == (2, 0.875) and corpus.frequency_bounds(8) == (1, 0.6) and corpus.frequency_bounds(90, 2) == (2, 0.8)


def test_scores_of_lists(spark):
    terms = scoring.term_arrays(*[spark.createDataFrame([(x,) for x in words], "term string") for words in (["disk", "tape"], ["-l"], ["full disk"])])
    rows = spark.createDataFrame([("g", 1, "The full disk: x"), ("g", 2, None), ("g", 3, "tape -l disk"), ("h", 4, "one")], "g string, k int, t string")
    got = {r["g"]: r for r in scoring.list_features(rows, "g", "t", terms).collect()}
    assert len(got["g"]["features"]) == scoring.STATE and got["g"]["domain_max"] == 0.2 and got["g"]["technical"] == 0.1 and got["g"]["phrases"] == 0.2 and got["h"]["domain_avg"] == 0
    ranked = {r["k"]: (r["final_score"], r["place"]) for r in scoring.final_ranking(rows, "g", "k", "t", "full tape", F.array().cast("array<string>"), terms).collect()}
    assert ranked[4] == (1.0, 1) and ranked[2][1] == 3 and ranked[1][0] > 0.6
    chances = spark.range(1).select(scoring.best_places(scoring.boosted(F.array(F.lit(0.5), F.lit(0.45), F.lit(0.5)), F.array(F.lit(1))), 2).alias("p"))
    assert chances.first()["p"] == [1, 0]
    assert scoring.relevant_chunks(rows, "full disk tape", "k", "t", "g", terms, spark.createDataFrame([("disk",)], "term string"), F.array().cast("array<string>")).count() == 3


def test_sessions_and_translation(spark):
    rows = spark.createDataFrame([(1, "u", at(0)), (2, "u", at(5)), (3, "v", at(1))], "k int, u string, ts timestamp")
    opened = {r["k"]: r["is_active"] for r in sessions.open_sessions(rows, "u", "ts", "k").collect()}
    assert opened == {1: False, 2: True, 3: True}

    def model(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return [x[::-1] for x in texts]

    texts = spark.createDataFrame([("ab",), (None,), ("",), ("bad",), ("cd",)], "t string").coalesce(1)
    assert [r["t"] for r in sessions.translated(texts, ["t"], model, 2).collect()] == ["ba", None, "", "bad", "dc"]
    stored = spark.createDataFrame([(1, 2)], "conv_id int, turns int")
    assert sessions.delete_chats(stored, stored).count() == 0 and sessions.save_chats(stored, stored, F.current_timestamp()).count() == 1
