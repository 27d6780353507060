"""Small cases of what the second round found wrong or too large."""

import random
import re

from pyspark.sql import functions as F

import oracle
from rankloom.operators import entity, lexical
from rankloom.plans import matching as matching_plans, registered


def test_coverage_rounds_exact_halves_up_in_any_order(spark, monkeypatch):
    # credits and importances whose exact quotients are 0.696875, 0.296875 and 0.321875, in orders that fall short of it in doubles
    cases = [
        ([0.55, 1.0, 1.0, 0.35, 1.0, 0.0, 1.0, 0.55], [0.9, 0.8, 1.0, 0.9, 0.8, 0.5, 0.5, 1.0], 0.69688),
        ([0.0, 0.0, 0.35, 0.55, 0.55, 0.0, 1.0, 0.0], [0.9, 0.9, 0.5, 1.0, 0.5, 0.8, 0.9, 0.9], 0.29688),
        ([0.35, 0.55, 0.0, 0.0, 0.55, 0.55], [0.8, 0.9, 0.9, 0.8, 0.5, 0.9], 0.32188),
    ]
    rows = [("j", i, f"s{n}", kind, "exact", c, w) for i, (cs, ws, _) in enumerate(cases) for kind in ("required", "preferred") for n, (c, w) in enumerate(zip(cs, ws))]
    tiers = spark.createDataFrame(rows, "job_id string, resume_id long, skill_key string, kind string, status string, credit double, importance double").coalesce(1)
    monkeypatch.setattr(matching_plans, "_tiers", lambda spark, d: tiers)
    got = {r["resume_id"]: (r["required"], r["preferred"]) for r in matching_plans.coverage(spark, "").collect()}
    assert got == {i: (x, x) for i, (_, _, x) in enumerate(cases)}


def test_listed_pairs_are_scored_against_the_best_of_the_whole_pool(spark, monkeypatch):
    rng = random.Random(7)
    words = ["python", "spark", "react", "sql", "kafka", "docker", "java", "rust"]
    texts = {i: " ".join(rng.choices(words, [9, 7, 5, 3, 2, 2, 1, 1], k=rng.randrange(0, 30))) for i in range(40)}
    bag = [(q, t, rng.choice([1.0, 2.0, 3.0])) for q in "abc" for t in rng.sample(words, 4)]
    docs, queries = spark.createDataFrame(list(texts.items()), "k long, t string"), spark.createDataFrame([("a",), ("b",), ("c",), ("none",)], "q string")
    more = spark.createDataFrame(bag + [("a", "rust", 9.0), ("b", "java", 9.0)], "q string, term string, weight double").groupBy("q", "term").agg(F.max("weight").alias("weight"))
    bag = spark.createDataFrame(bag, "q string, term string, weight double")
    pairs = spark.createDataFrame([(q, k) for q in ("a", "b", "none", "gone") for k in range(0, 40, 3)], "q string, k long")
    found = {}
    for share, rows in ((0.0, 2_000_000), (2.0, 2)):  # all terms dense; none, in blocks of few queries
        monkeypatch.setattr(lexical, "DENSE_SHARE", share)
        monkeypatch.setattr(lexical, "BLOCK_ROWS", rows)
        full = [{(r["q"], r["k"]): r for r in lexical.bm25(docs, b, "k", "t", "q", queries).collect()} for b in (bag, more)]
        got = lexical.bm25_listed(docs, bag, pairs, "k", "t", "q", queries, more).collect()
        assert {(r["q"], r["k"]) for r in got} == {(q, k) for q in ("a", "b", "none") for k in range(0, 40, 3)} and len(got) == 42
        assert all(abs(r[c] - f[r["q"], r["k"]]["normalised"]) < 2e-4 for r in got for c, f in zip(("normalised", "more"), full))
        found[share] = {k: (round(r["score"], 9), r["rank"]) for k, r in full[0].items()}
        for q in "abc":
            order = sorted(range(40), key=lambda k: (-round(full[0][q, k]["score"], 6), k))
            assert [full[0][q, k]["rank"] for k in order] == list(range(1, 41))
    assert found[0.0] == found[2.0]


def test_ranking_pairs_makes_no_row_for_all_others(spark, monkeypatch):
    def all_pairs(*args, **kwargs):
        raise AssertionError("every text was given out for every job")

    monkeypatch.setattr(lexical, "bm25", all_pairs)
    for name in ("pipeline_rank", "extra_requirement_rerank"):
        assert registered()[0][name](spark, oracle.SMALL).columns[:2] == ["job_id", "resume_id"]


def test_contained_heads_against_brute_force(spark):
    rng = random.Random(3)
    phrases = ["".join(rng.choices("abcdefgh", k=30)) for _ in range(6)]
    texts = ["".join(rng.choices(phrases, k=rng.randrange(2, 5))) for _ in range(60)]
    texts += [texts[0], texts[0], "zz" + texts[1] + "q", texts[2].upper() + "-!", None, "", "short"]
    head = "".join(rng.choices("abcdefgh", k=60))
    texts += [head, "vwxyz" + head[:40] + "v" * 15]  # of one length: the first asks for the second alone
    fps = {i: re.sub("[^a-z0-9]+", "", (t or "").lower())[:100] for i, t in enumerate(texts)}
    live = {i: f for i, f in fps.items() if len(f) > 20}
    want = {}
    for i, a in live.items():
        near = [j for j, b in live.items() if j != i and (a[:40] in b if len(a) <= len(b) else b[:40] in a)]
        if near:
            want[i] = min(near)
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    for window in (1, 200):
        got = entity.contained(rows, "k", "t", head=40, whole=100, least=20, gram=8, window=window).collect()
        assert len(got) == len(want) and {r["k"]: r["other"] for r in got} == want
