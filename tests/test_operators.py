import math
import sqlite3
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.functions import scoring as S
from folioscan.functions.text import QUERY_EXPANSIONS
from folioscan.operators import graph as G
from folioscan.operators import lexical as X
from folioscan.operators import vector as E
from folioscan.operators.corpus import longest_prefix, merge_corpus
from folioscan.operators.merging import merge_by_key, ranked_items, score_records, source_diagnostics
from folioscan.operators.ranking import keep_last
from folioscan.operators.skew import hot_keys, lookup_join, running_sum
from folioscan.plans.hybrid import HybridParameters, SearchIndex, hybrid_search
from tests.conftest import rows

TEXTS = [("a", "Flat maps", "flat flat map foo_bar étale"), ("b", "", "foo bar and map of maps"), ("c", None, "bar foo étale etale scheme"), ("d", "Scheme", "flat scheme scheme"), ("e", "x", ""), ("f", "y", None)]
ASKED = ["flat", "foo_bar", "etale", "map", "scheme flat", "flat flat", "_", "", "nothing", "and", "bar", "flat _"]


def corpus(spark):
    return spark.createDataFrame(TEXTS, "id string, title string, content string")


def test_bm25_equals_sqlite(spark):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(id UNINDEXED, title, content, tokenize='unicode61 remove_diacritics 2')")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i, t or "", c or "") for i, t, c in TEXTS])
    want = set()
    for n, q in enumerate(ASKED):
        tokens = " ".join(__import__("re").findall("[A-Za-z0-9_]+", q.lower()))
        if tokens:
            quoted = " ".join(f'"{t}"' for t in tokens.split())
            want |= {(n, i, round(-s, 9)) for i, s in con.execute("SELECT id, bm25(t) FROM t WHERE t MATCH ?", (quoted,))}
    queries = spark.createDataFrame(list(enumerate(ASKED)), "qid int, query string")
    got = {(r.qid, r.id, r.score) for r in X.bm25(X.build_index(corpus(spark)), queries, 10).collect()}
    assert {(q, i) for q, i, _ in got} == {(q, i) for q, i, _ in want}
    assert all(abs(s - next(t for p, j, t in want if (p, j) == (q, i))) < 1e-6 for q, i, s in got)


def test_index_updates_equal_rebuild(spark):
    old = X.build_index(corpus(spark).filter("id IN ('a', 'b', 'c')"))
    new = corpus(spark).filter("id <> 'b'").withColumn("content", F.when(F.col("id") == "a", "new text").otherwise(F.col("content")))
    changed = spark.createDataFrame([("a",), ("b",), ("d",), ("e",), ("f",)], "id string")
    got, want = X.apply_changes(old, new, changed), X.build_index(new)
    assert rows(got.postings) == rows(want.postings)
    assert rows(got.docs) == rows(want.docs)
    pruned = X.apply_changes(old, new, changed.limit(0), prune=True)
    assert {r.id for r in pruned.docs.collect()} == {"a", "c"}


def test_hash_vectors(spark):
    encode = E.EMBEDDERS["hash"](dim=1536)
    docs = spark.createDataFrame([("a", "flat flat Étale"), ("b", ""), ("c", None), ("d", "概")], "id string, t string")
    sparse = E.hash_vectors(docs, "id", F.col("t"))
    got = {r.id: np.array(r.v) for r in sparse.select("id", E.densify(F.col("indices"), F.col("values"), 1536).alias("v")).collect()}
    assert E._hashed("flat") == 13618400000479592292 and E._hashed("flat") % 1536 == 1380
    for i, t in (("a", "flat flat Étale"), ("b", ""), ("c", ""), ("d", "概")):
        assert np.allclose(got[i], encode([t])[0], atol=1e-6)
    direct = {r.id: r.embedding for r in E.embed(docs, "id", F.col("t"), "hash", dim=1536).collect()}
    assert np.allclose(direct["a"], got["a"], atol=1e-6)
    with pytest.raises(ValueError):
        E.embed(docs, "id", F.col("t"), "none")
    with pytest.raises(ValueError):
        E.embed(docs, "id", F.col("t"), "hash", dim=0)


def test_vector_search(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 8)).round(3)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(99, None), (61, m[7].tolist())], "id int, embedding array<double>")
    queries = spark.createDataFrame([(i, m[i].tolist()) for i in (0, 7)], "qid int, embedding array<double>")
    got = [(r.qid, r.id, r["rank"]) for r in E.vector_top_k(vectors, queries, 3).orderBy("qid", "rank").collect()]
    full = np.vstack([m, m[7]])
    want = []
    for q in (0, 7):
        s = (full @ m[q]).round(9)
        order = sorted(range(61), key=lambda i: (-s[i], i))[:3]
        want += [(q, 61 if i == 60 else i, n) for n, i in enumerate(order, 1)]
    assert got == want
    assert E.vector_top_k(vectors, queries.limit(0), 3).count() == 0
    with pytest.raises(Exception):
        E.vector_top_k(vectors, spark.createDataFrame([(1, [1.0])], "qid int, embedding array<double>"), 3).collect()


@pytest.mark.parametrize("k, tied", [(3, 0), (3, 300), (70, 300)])
def test_a_task_sends_on_only_its_best(spark, monkeypatch, k, tied):
    """Over many slices the result is exact, with ties by id; each task passes on its ``k`` best of a query, not those of every slice."""
    monkeypatch.setattr(E, "SLICE", 64)
    sent, rank = [], E.top_k
    monkeypatch.setattr(E, "top_k", lambda df, *a: sent.append(df.count()) or rank(df, *a))
    rng = np.random.default_rng(2)
    m = np.concatenate([rng.normal(size=(1200, 4)), np.zeros((tied, 4)), np.ones((tied, 4))])[rng.permutation(1200 + 2 * tied)]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id int, embedding array<double>").coalesce(1)
    asked = [*rng.normal(size=(7, 4)).tolist(), [1.0] * 4, [-1.0] * 4, *[[0.0] * 4] * bool(tied)]
    queries = spark.createDataFrame(list(enumerate(asked)), "qid int, embedding array<double>")
    got = sorted((r.qid, r["rank"], r.id) for r in E.vector_top_k(vectors, queries, k).collect())
    scores = [np.round(m @ np.array(q), 9) for q in asked]
    assert got == [(q, n, i) for q, s in enumerate(scores) for n, i in enumerate(sorted(range(len(m)), key=lambda i: (-s[i], i))[:k], 1)]
    if not tied:
        assert k * len(asked) <= sent[0] <= 4 * k * len(asked)  # of 19 slices


def test_reuse(spark):
    docs = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "id string, doc_hash string")
    old = spark.createDataFrame([("a", "1", [1.0]), ("b", "x", [2.0]), ("c", "3", [3.0]), ("z", "9", [9.0])], "id string, doc_hash string, embedding array<double>")
    kept, todo = E.reuse_vectors(docs, old, spark.createDataFrame([("c",)], "id string"))
    assert rows(kept.select("id")) == [("a",)]
    assert rows(todo.select("id")) == [("b",), ("c",), ("d",)]
    assert E.compatible({"provider": "local", "dim": 3}, {"provider": "local", "dim": 5})
    assert not E.compatible({"provider": "hash", "dim": 3}, {"provider": "hash", "dim": 5})
    assert E.query_parameters({"dim": 7}, {"provider": "x"}, dim=0)["dim"] == 7


def test_longest_prefix(spark):
    labels = spark.createDataFrame([("spaces-limits-lemma-x",), ("spaces-a",), ("other-a",), ("plain",), (None,)], "full_label string")
    keys = spark.createDataFrame([("spaces",), ("spaces-limits",), ("plain",)], "chapter_key string")
    got = {r.full_label: r.chapter_key for r in longest_prefix(labels, keys).collect()}
    assert got["spaces-limits-lemma-x"] == "spaces-limits" and got["spaces-a"] == "spaces"
    assert got["other-a"] == "other" and got["plain"] == "unknown"


def test_merge_corpus(spark):
    mk = lambda *r: spark.createDataFrame(list(r), "tag string, v int")
    got = merge_corpus(mk(("a", 1), ("b", 1), ("c", 1)), spark.createDataFrame([("b",), ("c",)], "tag string"), mk(("b", 2)))
    assert rows(got) == [("a", 1), ("b", 2)]


def test_keep_last(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("", 3, "z"), (None, 4, "w")], "k string, n int, v string")
    assert rows(keep_last(df, "k", F.col("n"))) == [("a", 2, "y")]


def test_skew_helpers(spark):
    left = spark.createDataFrame([("h", i) for i in range(500)] + [(f"k{i}", i) for i in range(20)] + [(None, 0)], "k string, n int")
    right = spark.createDataFrame([("h", "H")] + [(f"k{i}", str(i)) for i in range(0, 20, 2)], "k string, v string")
    counts = left.groupBy("k").agg(F.count(F.lit(1)).alias("c"))
    hot = hot_keys(counts, "k", "c", 521, 0.1)
    assert rows(hot) == [("h",)]
    assert rows(lookup_join(left, right, "k", hot)) == rows(left.join(right, "k"))
    assert rows(lookup_join(left, right, "k", hot, "left")) == rows(left.join(right, "k", "left"))
    df = spark.createDataFrame([("g", i, i // 7, float(i)) for i in range(50)], "g string, n int, b int, v double")
    got = running_sum(df, ["g"], "b", ["n"], "v", "s").orderBy("n").collect()
    assert [r.s for r in got] == [sum(range(i + 1)) for i in range(50)]


def test_literature_merge(spark):
    items = [
        ("crossref", 1, "Title one", "", "2020", "short", "", "10.1234/a", ""),
        ("arxiv", 2, "Title One", "A", "", "longer text", "", "10.1234/A", ""),
        ("wikipedia", 1, "", "", "", "", "u", "", ""),
        ("openalex", 1, "Other", "B", "2024", "flat", "", "", ""),
    ]
    df = spark.createDataFrame(items, "source_key string, rank int, title string, authors string, year string, summary string, url string, doi string, arxiv_id string")
    merged = {r.key: r for r in merge_by_key(ranked_items(df)).collect()}
    m = merged["doi:10.1234/a"]
    assert (m.title, m.authors, m.year, m.summary, m.provenance) == ("Title One", "A", "2020", "longer text", ["arXiv", "Crossref"])
    assert m.rank_signal == pytest.approx(1 / 1.12)
    best = score_records(merge_by_key(ranked_items(df.withColumn("qid", F.lit(1))), ("qid", "key")), spark.createDataFrame([(1, "latest flat")], "qid int, query string"), 2025).collect()
    assert {r.citation_id for r in best} == {"P1", "P2"}
    top = next(r for r in best if r.title == "Other")
    assert top.score == pytest.approx(0.92 + 0.45 * 0.5 + 0.4 * 1.0 + 0.08, abs=1e-6)
    status = {r.source_key: (r.status, r["count"], r.degrade_reason) for r in source_diagnostics(df, spark.createDataFrame([("mathse", "HTTP_503", "x")], "source_key string, code string, message string")).collect()}
    assert status["arxiv"] == ("ok", 1, None) and status["mathse"] == ("error", 0, "timeout") and status["mathoverflow"] == ("ok", 0, "no_matches")


# --- hybrid search against a plain reading of its definition


def brute(query, docs, bm, vec, edges, p):
    low = query.lower()
    hint = query.strip().upper()
    hint = hint if len(hint) == 4 and hint.isalnum() and hint.isascii() else ""
    env = next((e for e, t in S.ENV_HINTS if any(x in low for x in t)), "")
    proof = any(x in low for x in S.PROOF_HINTS)
    expanded = " ".join([query] + [v for k, v in QUERY_EXPANSIONS if k in query])
    tokens = set(__import__("re").findall("[A-Za-z0-9_]+", expanded.lower()))

    def norm(s):
        if not s:
            return {}
        lo, hi = min(s.values()), max(s.values())
        return {k: 1.0 if hi - lo <= 1e-12 else (v - lo) / (hi - lo) for k, v in s.items()}

    best = lambda s, k: dict(sorted(s.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k])
    v, b = norm(best(vec, p.vector_k)), norm(best(bm, p.bm25_k))
    cand = set(v) | set(b) | ({hint} if hint in docs else set())

    def base(i):
        d, s = docs[i], p.vector_weight * v.get(i, 0) + p.bm25_weight * b.get(i, 0)
        s += 10 * (bool(hint) and i == hint) + 0.75 * (bool(env) and d["env_type"] == env)
        if proof:
            s += 0.45 if d["proof_text"] else 0.10 if d["env_type"] in ("theorem", "lemma", "proposition") else 0
            s += 0.05 * bool(d["statement_text"])
        else:
            s += 0.12 * bool(d["statement_text"]) - 0.08 * bool(d["proof_text"])
        s += 0.35 * (d["chapter_key"].lower() in low or d["chapter_key"].replace("-", " ") in low.replace("-", " ").replace("_", " "))
        words = f"{d['title']} {d['full_label']}".lower().replace("-", " ")
        return s + min(0.35, 0.05 * sum(len(t) >= 3 and t in words for t in tokens))

    bases = {i: base(i) for i in cand}
    out, into = defaultdict(list), defaultdict(list)
    for s, t in edges:
        out[s].append(t)
        into[t].append(s)
    seeds = list(best(bases, max(1, p.seed_k))) + ([hint] if hint in docs else [])
    front = {}
    for n, i in enumerate(seeds):
        front.setdefault(i, max(bases.get(i, 0), 0.05) / (1 + 0.2 * n))
    g = defaultdict(float)
    for hop in range(p.hops):
        nxt = defaultdict(float)
        for i, sig in front.items():
            for near, w in ((out[i], p.out_weight), (into[i], p.in_weight)):
                for j in near:
                    nxt[j] += sig * w * p.hop_decay**hop / math.sqrt(len(near))
        for j, s in nxt.items():
            g[j] += s
        front = dict(sorted(nxt.items(), key=lambda x: (-round(x[1], 12), x[0]))[: max(2 * p.expand_k, 32)])
    everyone = cand | set(dict(sorted(g.items(), key=lambda x: (-round(x[1], 12), x[0]))[: p.expand_k]))
    gn = norm(dict(g))
    cn = norm({i: math.log1p(len(into[i])) + 0.35 * math.log1p(len(out[i])) for i in everyone})
    return {i: base(i) + p.graph_weight * gn.get(i, 0) + p.centrality_weight * cn.get(i, 0) for i in everyone}


def test_hybrid_against_brute_force(spark):
    rng = np.random.default_rng(5)
    envs, words = ["lemma", "theorem", "definition", "remark"], ["flat", "scheme", "sheaf", "proper", "map", "stack", "proof"]
    docs = {}
    for n in range(40):
        i = f"T{n:03d}"
        docs[i] = {"id": i, "tag": i, "env_type": envs[n % 4], "reference": f"{n}.1", "chapter_key": ["flat-maps", "stacks"][n % 2], "statement_text": " ".join(rng.choice(words, 6)) if n % 5 else "", "proof_text": " ".join(rng.choice(words, 4)) if n % 3 else "", "title": str(rng.choice(words)), "full_label": f"label-{n}"}
    edges = {(f"T{a:03d}", f"T{b:03d}") for a, b in rng.integers(0, 40, (90, 2)) if a != b}
    queries = ["flat scheme", "prove the theorem on sheaf", "T007", "概形 flat maps definition", "zzz"]
    schema = ", ".join(f"{c} string" for c in docs["T000"])
    frame = spark.createDataFrame([tuple(d.values()) for d in docs.values()], schema)
    p = HybridParameters(vector_k=12, bm25_k=10, seed_k=4, expand_k=6, lexical_mode="or")
    index = X.build_index(frame.withColumn("content", F.concat_ws(" ", "statement_text", "proof_text")))
    vectors = E.embed(frame, "id", F.col("statement_text"), "hash", dim=64)
    from folioscan.plans.tuning import with_embeddings

    asked = spark.createDataFrame(list(enumerate(queries)), "qid int, query string")
    ready = with_embeddings(asked, dim=64)
    e = spark.createDataFrame(sorted(edges), "src string, dst string")
    whole = SearchIndex(frame, index, vectors, G.GraphIndex.build(frame, e))
    got = defaultdict(dict)
    for r in hybrid_search(ready, whole, p).collect():
        got[r.qid][r.id] = r.score
    lexical = defaultdict(dict)
    from folioscan.functions.text import expand_query

    for r in X.bm25(index, asked.select("qid", expand_query(F.col("query")).alias("query")), 10, mode="or").collect():
        lexical[r.qid][r.id] = r.score
    m = {r.id: np.array(r.embedding, dtype=float) for r in vectors.collect()}
    q = {r.qid: np.array(r.embedding, dtype=float) for r in ready.collect()}
    for n, text in enumerate(queries):
        want = brute(text, docs, lexical[n], {i: float(np.round(m[i] @ q[n], 9)) for i in m}, edges, p)
        assert set(got[n]) == set(want)
        assert all(abs(got[n][i] - want[i]) < 1e-6 for i in want), text
    plain = hybrid_search(ready, whole, HybridParameters(vector_k=5, bm25_k=5, graph_weight=0.0, env="lemma", lexical_mode="or"))
    assert {docs[r.id]["env_type"] for r in plain.collect()} == {"lemma"}


def test_graph(spark):
    nodes = spark.createDataFrame([("A",), ("B",), ("C",)], "id string")
    raw = spark.createDataFrame([("A", " b "), ("A", "B"), ("A", "A"), ("B", "C"), ("C", "Z"), ("A", None), ("A", "")], "source_tag string, target_tag string")
    edges = G.clean_edges(nodes, raw)
    assert rows(edges) == [("A", "B"), ("B", "C")]
    d = {r.id: (r.n_in, r.n_out) for r in G.degrees(nodes, edges).collect()}
    assert d == {"A": (0, 1), "B": (1, 1), "C": (1, 0)}
    seeds = spark.createDataFrame([(1, "A", 1.0)], "qid int, id string, signal double")
    graph = G.GraphIndex.build(nodes, edges)
    assert G.expand(seeds, graph, hops=0).count() == 0
    got = {r.id: r.graph_score for r in G.expand(seeds, graph, hops=2).collect()}
    assert got == pytest.approx({"B": 1.0, "C": 0.55, "A": 0.55 * 0.65})
