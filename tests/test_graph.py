import numpy as np
from pyspark.sql import functions as F

from tessella.operators import graph as G
from tessella.operators import metrics as M
from tessella.operators import resolve as R
from tessella.operators import routing as Q
from tessella.operators import telemetry as T
from tessella.operators import vector_search as S

#: A small graph: relation, ends, confidence and cosine, so that scores are 0.9, 0.6, 0.45, 1, 1.
TOY = [("r1", "a", "c", 0.9), ("r2", "c", "b", 0.6), ("r3", "a", "d", 0.45), ("r4", "d", "e", 1.0), ("r5", "e", "f", 1.0)]


def _edges(spark, rows):
    both = [(s, o, r, "k" + r, x) for r, s, o, x in rows] + [(o, s, r, "k" + r, x) for r, s, o, x in rows]
    return spark.createDataFrame(both, "node string, other string, rel_id string, chunk_id string, score double")


def test_two_seeds_joined_by_a_path(spark):
    seeds = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "qid long, node string")
    found = G.paths(seeds, _edges(spark, TOY), 2, 25, 8)
    rows = {q: sorted((r for r in found.collect() if r.qid == q), key=lambda r: r.place) for q in (1, 2)}
    first = rows[1][0]
    assert set(first.rels) == {"r1", "r2"} and first.joined and abs(first.score - 0.54) < 1e-9
    assert sum(set(r.rels) == {"r1", "r2"} for r in rows[1]) == 1
    assert all("r5" not in r.rels for r in rows[1] + rows[2])
    assert any(r.rels == ["r3", "r4"] and abs(r.score - 0.45) < 1e-9 for r in rows[2]) and not any(r.joined for r in rows[2])
    chunks = [r.chunk_id for r in G.provenance(found, 3).filter("qid = 1").orderBy("rank").collect()]
    assert set(chunks[:2]) == {"kr1", "kr2"} and len(set(chunks)) == 3


def test_fanout_and_loops(spark):
    star = [(f"s{i:02}", "hub", f"n{i:02}", 1 - i / 100) for i in range(30)]
    kept = G.paths(spark.createDataFrame([(1, "hub")], "qid long, node string"), _edges(spark, star), 1, 25, 100)
    assert sorted(r.rels[0] for r in kept.collect()) == [f"s{i:02}" for i in range(25)]
    loop = [("x", "a", "b", 0.5), ("y", "a", "b", 0.4)]
    found = G.paths(spark.createDataFrame([(1, "a")], "qid long, node string"), _edges(spark, loop), 2, 25, 8)
    assert sorted(r.rels for r in found.collect()) == [["x"], ["y"]]


def test_best_overlap_takes_the_earlier_of_equals(spark):
    spans = spark.createDataFrame([("d", 0, 0, 30), ("d", 1, 31, 80)], "doc string, ord int, start_offset int, end_offset int")
    rows = [(1, "d", 10, 40), (2, "d", 25, 70), (3, "d", 20, 41), (4, "d", 90, 95)]
    got = G.best_overlap(spark.createDataFrame(rows, "id int, doc string, evidence_start int, evidence_end int"), spans, "doc")
    assert {r.id: r.ord for r in got.collect()} == {1: 0, 2: 1, 3: 0}


def test_components(spark):
    pairs = [(f"n{i:02}", f"n{i + 1:02}") for i in range(20)] + [("z1", "z2"), ("z2", "z1")]
    got = {r.node: r.root for r in G.components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert set(got.values()) == {"n00", "z1"} and len(got) == 23


def test_alike_pairs_are_those_of_brute_force(spark):
    names = ["drustol railway", "drustol railways", "drustol foundry", "velm press", "velm presse", "velm", "drustol railway co"]
    df = spark.createDataFrame([("ORG", n) for n in names], "kind string, norm string")
    got = {(r.a, r.b) for r in R.alike_pairs(df, 0.7).collect()}

    def grams(s):
        return {f"  {w} "[i : i + 3] for w in s.split() for i in range(len(w) + 1)}

    want = {(a, b) for a in names for b in names if a < b and a.split()[0] == b.split()[0] and len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= 0.7}
    assert got == want


def test_answer_metrics(spark):
    cases = [
        ("globex", "globex", 1, 1), ("globex inc", "globex corporation", 0, 0.5), ("yes", "no", 0, 0), ("no it was not", "no", 0, 0), ("alpha town", "alpha town ohio", 0, 0.8),
        ("", "delta", 0, 0), ("new york new york", "new york", 0, 2 / 3), ("american rock band", "american", 0, 0.5),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "p string, g string")
    got = df.select(M.exact_match(F.col("p"), F.col("g")).alias("em"), M.token_f1(F.col("p"), F.col("g")).alias("f1")).collect()
    assert [(r.em, round(r.f1, 6)) for r in got] == [(em, round(f1, 6)) for _, _, em, f1 in cases]


def test_retrieval_metrics_and_spans(spark):
    row = spark.createDataFrame([(["Distractor", "Jane Roe", "Other", "Acme"], ["Acme", "Jane Roe"])], "t array<string>, g array<string>")
    r = row.select(*(M.recall_at_k(F.col("t"), F.col("g"), k).alias(f"k{k}") for k in (1, 2, 4)), M.reciprocal_rank(F.col("t"), F.col("g")).alias("m")).first()
    assert (r.k1, r.k2, r.k4, r.m) == (0.0, 0.5, 1.0, 0.5)
    spans = [("a", 0, 6), ("a", 4, 8), ("b", 2, 6), ("b", 0, 20), ("c", 5, 5)]
    got = M.covered(spark.createDataFrame(spans, "k string, start_offset int, end_offset int"), "k").collect()
    assert {r.k: r.covered for r in got} == {"a": 8, "b": 20}


def test_fusion_keeps_the_first_seen_among_equals(spark):
    lists = spark.createDataFrame([(1, 0, 10, 1), (1, 0, 20, 2), (1, 1, 20, 1), (1, 1, 30, 2), (1, 1, 20, 9)], "query_id long, list int, id long, rank int")
    got = Q.fused(lists).orderBy("rank").collect()
    assert [(r.id, r.source) for r in got] == [(20, "hybrid"), (10, "vector"), (30, "graph")]


def test_diversity(spark):
    vectors = {"a": [0.82, 0.572, 0.0], "c": [0.81, 0.585, 0.03], "b": [0.78, -0.3, 0.55]}
    hits = [(1, i, i, [1.0, 0.0, 0.0], v) for i, v in enumerate(vectors.values(), 1)] + [(1, 9, 4, [1.0, 0.0, 0.0], None)]
    df = spark.createDataFrame(hits, "query_id long, id long, rank int, q array<double>, v array<double>")
    assert [r.id for r in Q.diversified(df, 0.7, 4).orderBy("rank").collect()] == [1, 3, 2, 9]
    assert [r.id for r in Q.diversified(df, 1.0, 2).orderBy("rank").collect()] == [1, 2]


def test_routes_and_models(spark):
    df = spark.createDataFrame([("single_hop", 0.4), ("single_hop", 0.9), ("multi_hop", 0.9)], "l string, c double")
    got = [r.r for r in df.select(Q.initial_route(F.col("l"), F.col("c"), F.lit(False), 0.6, "graph").alias("r")).collect()]
    assert got == ["hybrid", "vector", "vector"]
    sizes = df.select(Q.model_size(F.lit("vector"), F.col("l"), F.lit(2501)).alias("m")).collect()
    assert [r.m.size for r in sizes] == ["large"] * 3 and sizes[2].m.reason == "large:label multi_hop"
    value = spark.range(1).select(Q.answer_confidence(F.lit(1.0), F.lit(0.55), F.lit(False), F.lit("hybrid")).alias("x")).first().x
    assert value == 0.825


def test_group_stats_and_percentiles(spark):
    rows = [("r1", 0.0010, 100, 1.0, 0.9), ("r1", 0.0020, 300, 0.5, None), ("r1", 0.0050, 900, 0.0, 0.4), ("r1", None, None, 0.2, None)]
    df = spark.createDataFrame(rows, "run_id string, cost_usd double, latency_ms int, f1 double, faithfulness double")
    r = df.groupBy("run_id").agg(*T.group_stats()).first()
    assert (r.n, r.n_without_trace, r.p50_ms, r.p95_ms, r.faithfulness) == (4, 1, 300.0, 840.0, 0.65)
    ranks = spark.range(1, 101).select(T.nearest_rank("id", 0.95).alias("p")).first().p
    assert ranks == 95


def test_blocks_give_the_neighbours_of_brute_force(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(S, "DATA_BLOCK", 40)
    monkeypatch.setattr(S, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(0)
    m = rng.normal(size=(150, 8))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(999, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = S.exact_topk(df, df.filter("vec_id % 10 = 0"), 5).collect()
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(0, 150, 10):
        scores = unit @ unit[q]
        scores[q] = -9
        assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == np.argsort(-scores, kind="stable")[:5].tolist()


def test_alias_matches_are_those_of_brute_force(spark):
    from tessella.functions.text import word_similarity_of

    names = [("Robert Warrren", 0.9), ("Warren", 0.5), ("velm press", 1.0), ("Velm", 0.6), ("Press of Velm Ltd", 0.95), ("R", 1.0), ("Robert", None), ("born", 0.3), ("--", 1.0)]
    questions = ["Where was Robert Warren born?", "Who owns Velm Press?", "R?", "", "Was the velmm presse sold?"]
    asked = spark.createDataFrame([(q,) for q in questions], "question string")
    got = {(r.question, r.alias) for r in R.alias_matches(spark.createDataFrame(names, "alias string, confidence double"), asked, 0.45).collect()}
    want = {(q, a) for q in questions for a, c in names if (c or 0) * word_similarity_of(a.lower(), q.lower()) >= 0.45}
    assert got == want and ("Where was Robert Warren born?", "Robert Warrren") in got


def test_alias_seeds_in_blocks_are_those_of_brute_force(spark, monkeypatch):
    import random

    from tessella.functions.text import word_similarity_of

    monkeypatch.setattr(R, "ALIAS_BLOCK", 20, raising=False)
    monkeypatch.setattr(R, "QUESTION_BLOCK", 20, raising=False)
    draw = random.Random(3)
    words = "The the of ab ananas banana warren warrren robert velm press presse İstanbul x".split()
    pick = lambda n: " ".join(draw.choices(words, k=n))
    names = {pick(draw.randint(1, 4)): draw.choice([0.3, 0.45, 0.7, 1.0, None]) for _ in range(40)} | {"": 1.0, "a\nb": 1.0}
    asked = [(i, pick(draw.randint(0, 12))) for i in range(35)] + [(90, None), (91, "the " * 300 + "velm press")]
    asked += [(i, asked[0][1]) for i in (92, 93)]
    found = R.alias_seeds(spark.createDataFrame(list(names.items()), "alias string, confidence double"), spark.createDataFrame(asked, "id long, question string"), 0.45)
    want = set()
    for i, q in asked:
        got = {a: c * word_similarity_of(a.lower(), q.lower()) for a, c in names.items() if c and q}
        got = {a: s for a, s in got.items() if s >= 0.45}
        want |= {(i, a, s) for a, s in got.items() if not any(len(b) > len(a) and a.lower() in b.lower() and got[b] >= s for b in got)}
    rows = [tuple(r) for r in found.collect()]
    assert set(rows) == want and len(rows) == len(want) and {i for i, _, _ in want} >= {91, 92, 93}
    assert "gram" not in found._jdf.queryExecution().executedPlan().toString()  # no row for each trigram or pair


def test_alias_seeds_shuffle_no_match_and_split_a_hot_question(spark, monkeypatch):
    monkeypatch.setattr(R, "IDS", 3, raising=False)
    names = spark.createDataFrame([("Robert Warren", 1.0), ("Warren", 0.9), ("Velm", 0.8)], "alias string, confidence double")
    asked = [(i, "Did Robert Warren stay?") for i in range(8)] + [(8, "Did Velm?"), (0, "Did Velm?")]
    found = R.alias_seeds(names, spark.createDataFrame(asked, "id long, question string"), 0.45)
    want = {(i, "Robert Warren", 1.0) for i in range(8)} | {(8, "Velm", 0.8), (0, "Velm", 0.8)}
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(want) and {(i, a, round(x, 6)) for i, a, x in rows} == want
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "Join" not in plan and "Exchange" not in plan.split("InArrow")[0]  # matches leave their task for the result only
    meeting = plan.split("InArrow")[1].split("Union")[0]
    assert meeting.count("Exchange") == 1 and "REPARTITION_BY_NUM" in meeting  # a task for each meeting, none put together


def test_names_inside_longer_ones_by_index_and_by_search():
    from tessella.functions.runs import Inside, outermost

    names = ["a", "ana", "banana", "ananas", "an", "banana", "x", "", "na b"]
    sizes, scores = [len(x) for x in names], [0.5, 0.9, 0.6, 0.7, 0.4, 0.8, 1.0, 1.0, 0.3]
    for some in ([0, 1, 2, 3, 4, 5, 6, 8], [1, 2, 3], [0, 4, 6]):
        kept = Inside(names, sizes).outermost(np.zeros(len(some), dtype=np.int64), np.array(some), np.array([scores[i] for i in some]))
        want = outermost(*([x[i] for i in some] for x in (names, sizes, scores)))
        assert np.flatnonzero(kept).tolist() == sorted(want)


def test_merge_rule_against_all_pairs(spark):
    long = "Bartholomew Featherstonehaugh"
    rows = [
        (long, "PERSON", "Acme", "ORG", "d1:s:0"), (long, "PERSON", "Acme Inc", "ORG", "d2:s:0"), (long, "PERSON", "Velm", "ORG", "d3:s:0"),
        (long + "h", "PERSON", "Velm", "ORG", "d4:s:0"), (long + "h", "PERSON", "Rome", "PLACE", "d1:s:1"), (long + "h", "PERSON", "Oslo", "PLACE", "d5:s:0"),
        (long, "ORG", "Oslo", "PLACE", "d6:s:0"), (long + "h", "ORG", "Rome", "PLACE", "d7:s:0"), ("", "PERSON", "Rome", "PLACE", "d8:s:0"),
    ]
    df = spark.createDataFrame(rows, "subject string, subject_type string, object string, object_type string, chunk_id string")
    got = {r.node: r.root for r in G.components(R.merge_edges(df)).filter("node like 'n|%'").collect()}
    near: dict = {}
    for s, st, o, ot, chunk in rows:
        a, b = (st, s.lower()), (ot, o.lower().removesuffix(" inc"))
        if a[1] and b[1]:
            near.setdefault((*a, chunk[:2]), set()).add(b)
            near.setdefault((*b, chunk[:2]), set()).add(a)

    def grams(s):
        return {f"  {w} "[i : i + 3] for w in s.split() for i in range(len(w) + 1)}

    def merged(a, b):
        sim = len(grams(a[1]) & grams(b[1])) / len(grams(a[1]) | grams(b[1]))
        return a[0] == b[0] and sim >= 0.92 and (a[0] != "PERSON" or a[2] == b[2] or bool(near[a] & near[b]))

    root = {n: n for n in near}
    for _ in near:
        for a in near:
            for b in near:
                if merged(a, b):
                    root[a] = root[b] = min(root[a], root[b])
    assert got == {"n|" + "|".join(n): "n|" + "|".join(r) for n, r in root.items()}


def test_few_queries_go_to_the_data(spark):
    import numpy as np

    m = np.random.default_rng(1).normal(size=(120, 6))
    rows = [(i, [float(x) for x in v], "ab"[i % 2]) for i, v in enumerate(m)] + [(900 + i, [float(x) for x in m[4]], None) for i in range(3)] + [(999, None, "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, part string").repartition(5)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    got = S.exact_topk(df, df.filter("vec_id % 30 = 0 or vec_id > 900"), 4, by="part").collect()
    for q in range(0, 120, 30):
        scores = np.where(np.arange(120) % 2 == q % 2, unit @ unit[q], -9)
        scores[q] = -9
        assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == np.argsort(-scores, kind="stable")[:4].tolist()
    assert [r.id for r in sorted((r for r in got if r.query_id == 902), key=lambda r: r.rank)] == [900, 901]
    assert S.exact_topk(df.filter("false"), df, 3).count() == 0


def test_spellings_of_one_form_are_one_node(spark):
    rows = [(1, "Q. X. Marl", "The Quillmar Co."), (2, "QX MARL", "quillmar"), (3, "--", "quillmar"), (4, None, "quillmar"), (5, "Quillmar Inc", "QUILLMAR")]
    df = spark.createDataFrame(rows, "triple_id long, subject string, object string").selectExpr(
        "*", "'PERSON' as subject_type", "if(triple_id = 5, 'PERSON', 'ORG') as object_type", "'_Works for_' as predicate", "'d:s:0' as chunk_id", "0 as evidence_start", "1 as evidence_end", "0.5 as confidence"
    )
    got = G.relations(df).collect()
    assert [(r.triple_id, r.predicate) for r in got] == [(1, "works_for")]
