"""Whole jobs on fixtures, against brute force: what a cut would leave out is there."""

import math
from collections import Counter

import numpy as np

import oracle
from rankloom.operators import entity, semantic
from rankloom.plans import registered
from rankloom.session import table


def test_lsa_is_the_svd_over_the_whole_vocabulary(spark):
    # 7 and 8 share only a rare pair of terms; every other term of 9 is its own
    texts = ["react node mongodb", "react node express", "python spark hadoop", "python spark kafka", "python pandas numpy", "react redux css", "node express mongodb",
             "zyxq wvut alpha", "zyxq wvut beta", "gamma delta react", "python kafka redux", ""]
    rows = list(enumerate(texts))
    got = {r["k"]: np.array(r["vector"]) for r in semantic.lsa(spark.createDataFrame(rows, "k long, t string"), "k", "t").collect()}
    counts = [Counter(t.split() + [" ".join(p) for p in zip(t.split(), t.split()[1:])]) for t in texts]
    vocabulary = sorted(set().union(*counts))
    n = sum(map(bool, counts))
    df = {w: sum(w in c for c in counts) for w in vocabulary}
    a = np.array([[(1 + math.log(c[w])) * (math.log((1 + n) / (1 + df[w])) + 1) if c[w] else 0.0 for w in vocabulary] for c in counts])
    a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)
    k = min(160, len(vocabulary) - 1, n - 1)
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    want = u[:, :k] * s[:k]
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-12)
    mine = np.vstack([got[i] for i, _ in rows])
    assert mine.shape == (len(texts), k)
    live = np.linalg.norm(a, axis=1) > 0
    assert np.allclose((mine @ mine.T)[np.ix_(live, live)], (want @ want.T)[np.ix_(live, live)], atol=1e-3)
    assert not mine[~live].any()


def test_every_job_ranks_the_whole_pool(spark):
    jobs, pool = table(spark, oracle.SMALL, "jobs").count(), table(spark, oracle.SMALL, "resumes").count()
    rows = registered()[0]["bm25_rank"](spark, oracle.SMALL).select("job_id", "resume_id", "score", "rank").collect()
    assert len(rows) == jobs * pool and {r["rank"] for r in rows} == set(range(1, pool + 1))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_fuzzy_join_has_aliases_and_all_scripts(spark):
    ontology = [("azure", "Microsoft Azure", ["azure cloud"]), ("gha", "GitHub Actions", ["gh actions", None]), ("nest", "NestJS", None), ("redux", "Redux", ["redux toolkit"]), ("cafe", "Café Framework", []), ("go", "Go", ["golang"])]
    typed = ["Microsoft \u0410zure", "n\ufeffestjs", "gh actons", "redux toolikit", "cafe framework", "Golang", "go", "unrelated thing", None, " github  actions"]
    names = {(n.strip().lower(), k) for k, c, al in ontology for n in [c, *(al or [])] if n and len(n.strip()) >= 6}
    want = {}
    for v in {v.strip().lower() for v in typed if v}:
        near = sorted((edits(v, n), n, k) for n, k in names if edits(v, n) <= 2)
        if len(v) >= 6 and near:
            want[v] = near[0]
    rows = spark.createDataFrame([(v,) for v in typed], "s string")
    got = entity.nearest_surface(rows, "s", spark.createDataFrame(ontology, "skill_key string, canonical string, aliases array<string>"))
    assert {r["typed"]: (r["edits"], r["name"], r["skill_key"]) for r in got.collect()} == want
    assert len(want) == 7


def test_vector_queries_take_a_twentieth_against_all(spark):
    e = table(spark, oracle.SMALL, "embeddings").select("vec_id").toPandas()["vec_id"]
    rows = registered()[0]["sim_cross"](spark, oracle.SMALL).select("chunk", "req_no").collect()
    assert {(r["chunk"], r["req_no"]) for r in rows} == {(c, q) for c in e for q in e if q % 20 == 0} and len(rows) == len(e) * sum(e % 20 == 0)


def test_blocks_of_requirements_are_joined(spark):
    rng = np.random.default_rng(5)
    c, r = rng.standard_normal((7, 4)), rng.standard_normal((23, 4))
    chunks = spark.createDataFrame([(i % 3, i, 1.0, v.tolist()) for i, v in enumerate(c)], "doc int, chunk int, weight double, vector array<double>")
    reqs = spark.createDataFrame([(i, "required", v.tolist()) for i, v in enumerate(r)], "req_no int, kind string, vector array<double>")
    got = {(x["chunk"], x["req_no"]): x["sim"] for x in semantic.similarities(chunks, reqs, 5).collect()}
    assert len(got) == 7 * 23 and all(abs(s - c[i] @ r[j]) < 1e-9 for (i, j), s in got.items())


def test_whole_documents_are_compared_by_one_vector_each(spark):
    # document 1 has one chunk equal to the query and one against it; 2 lies against it
    rows = [(1, [1.0, 0.0, 0.0]), (1, [-1.0, 0.0, 2.0]), (2, [-1.0, 0.0, 0.0]), (3, [2.0, 2.0, 0.0]), (4, [1.0, 0.0, 0.0]), (4, [-1.0, 0.0, 0.0])]
    docs = semantic.document_vectors(spark.createDataFrame(rows, "doc int, v array<double>"), "doc", "v")
    query = semantic.document_vectors(spark.createDataFrame([(0, [3.0, 0.0, 0.0]), (0, [1.0, 0.0, 0.0])], "q int, v array<double>"), "q", "v")
    got = {r["doc"]: round(r["similarity"], 6) for r in semantic.document_similarity(docs, query, "doc").collect()}
    assert got == {1: 0.0, 2: 0.0, 3: round(0.5**0.5, 6), 4: 0.0}
