"""Operators against brute force on small fixtures."""

import math
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import vector as V
from tessera.operators import assign, facts, graph
from tessera.operators import fuzzy as X
from tessera.operators import retrieve as R
from tessera.operators import terms as T
from tessera.plans import induce
from tessera.sources import files

CHUNKS = [
    ("c1", "a.pdf", 1, 1, "Customer due diligence is due. KYC applies.", None), ("c2", "a.pdf", 1, 2, "客戶盡職審查須進行。客戶盡職審查。", "第一章 > 審查\n客戶盡職審查須進行。客戶盡職審查。"), ("c3", "a.pdf", 2, 1, "  ", "  "), ("c4", "a.pdf", 3, 1, None, None),
    ("c5", "b.pdf", 1, 1, "Ｃustomer due　diligence", "Customer Due Diligence\nＣustomer due　diligence"),
]
TERMS = [("t1", "k1", "customer due diligence", "phrase", 0.9), ("t2", "k1", "due", "word", 0.3), ("t3", "k2", "客戶盡職審查", "phrase", 0.8), ("t4", "k2", "KYC", "word", None), ("t5", "k3", "absent", "word", 0.5), ("t6", "k3", "x", "phrase", 0.1), ("t7", "k3", None, "word", 0.1)]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id string, source_file string, page int, chunk_index int, text string, retrieval_text string")


@pytest.fixture(scope="module")
def terms(spark):
    return spark.createDataFrame(TERMS, "term_id string, concept_id string, text string, match_type string, evidence_weight double")


def test_mentions(chunks, terms):
    got = {(r.chunk_id, r.term_id): (r["count"], r.source_count, r.match_scope) for r in T.mentions(chunks, terms.select("term_id", "text", "match_type")).collect()}
    assert got == {("c1", "t1"): (1, 1, "source_text"), ("c1", "t2"): (2, 2, "source_text"), ("c1", "t4"): (1, 1, "source_text"), ("c2", "t3"): (2, 2, "source_text"), ("c5", "t1"): (2, 1, "source_text"), ("c5", "t2"): (2, 1, "source_text")}
    concepts = {(r.chunk_id, r.concept_id): (r["count"], round(r.confidence, 4), r.matched_terms) for r in T.concept_mentions(T.mentions(chunks, terms.select("term_id", "text", "match_type")), terms).collect()}
    assert concepts == {("c1", "k1"): (3, 1.0, ["customer due diligence", "due"]), ("c2", "k2"): (2, 1.0, ["客戶盡職審查"]), ("c5", "k1"): (4, 1.0, ["customer due diligence", "due"])}
    assert T.mentions(chunks.limit(0), terms.select("term_id", "text", "match_type")).count() == 0


def test_candidates_and_scores(spark):
    rows = spark.createDataFrame([("g1", "c1", "Risk limits and the risk limits; LCR ratio"), ("g1", "c2", "risk limits"), ("g2", "c3", "資本充足比率 以及 流動"), ("g2", "c4", None), ("g2", "c5", "")], "g string, chunk_id string, text string")
    counts = T.candidates(rows, ["g", "chunk_id"], "text")
    got = {}
    for r in counts.collect():  # a row per spelling
        got[r.chunk_id, r.term] = (got.get((r.chunk_id, r.term), (0, ""))[0] + r.n, r.display)
    assert got["c1", "risk limits"][0] == 2 and got["c1", "lcr"] == (1, "LCR") and ("c1", "limits risk") not in got and ("c1", "the") not in got
    assert got["c3", "資本充足"][0] == 1 and got["c3", "充足比率"][0] == 1
    scored = {r.term: r for r in T.cluster_terms(counts, "g", "chunk_id").collect()}
    assert set(scored) == {"risk", "limits", "risk limits"} and scored["risk limits"].frequency == 3 and scored["risk limits"].chunk_frequency == 2
    total = {g: sum(n for (c, _), (n, _) in got.items() if (c in ("c1", "c2")) == (g == "g1")) for g in ("g1", "g2")}
    want = 3 / total["g1"] * math.log1p(sum(total.values()) / 2 / 3) * (1 + 0.12 * math.log1p(2))
    assert scored["risk limits"].score == pytest.approx(want, abs=1e-8)
    full = T.with_fallback(T.diverse_terms(T.cluster_terms(counts, "g", "chunk_id"), "g"), counts, "g").collect()
    assert {r.g for r in full} == {"g1", "g2"} and next(r for r in full if r.g == "g2").score == 0


def test_group_table_equals_candidates_of_chunks(spark, monkeypatch):
    """Counts summed by group, whatever a task holds, give the terms that the candidates of all chunks give; no row of a single chunk is kept."""
    texts = ["Risk limits and the risk limits; LCR ratio", "lcr LCR Lcr well-known risk's limits", "流動資金比率 以及資本充足", "", None, "the LCR"]
    paths = [("1.2 LCR", "Chapter 1 Risk Limits > 1.2 LCR"), (None, None), ("第四章 流動資金", "(LCR) > İstanbul risk > 第四章 流動資金")]
    rows = [(["a", "b", "c", None][i % 4], f"c{i}", texts[i % 6], *paths[i % 3]) for i in range(30)] + [("lone", "c99", "single mention", None, None)]
    df = spark.createDataFrame(rows, "g string, chunk_id string, text string, section_title string, section_path string").repartition(3)
    heads = T.heading_candidates(df, ["g", "chunk_id"])
    counts = T.candidates(df, ["g", "chunk_id"], "text").unionByName(heads)
    want = T.with_fallback(T.diverse_terms(T.cluster_terms(counts, "g", "chunk_id", heads), "g"), counts, "g").collect()
    for held in (2, 300_000):
        monkeypatch.setattr(T, "HELD_TERMS", held)
        table = T.group_table(df, "g", "text")
        got = T.with_fallback(T.diverse_terms(T.table_terms(table, "g"), "g"), table, "g").collect()
        assert sorted(map(repr, got)) == sorted(map(repr, want)) and any(r.text == "LCR" for r in got) and any(r.g == "lone" for r in got)
    assert table.count() == table.select("g", "term").distinct().count()


def test_diverse_terms_go_on_beyond_a_block(spark):
    rows = [("g", f"a b c d e f g h {i % 2}" if i < 40 else f"term{i} x{i}", i + 1) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, term string, rank int")
    got = [r.term for r in T.diverse_terms(df, "g", limit=5, reach=8).orderBy("rank").collect()]
    assert got == [rows[i][1] for i in T.pick_diverse([t for _, t, _ in rows], 5)]


def test_headings(spark):
    rows = spark.createDataFrame([("c1", "2.1 Capital Planning", "Chapter 2 Risk > 2.1 Capital Planning"), ("c2", None, None)], "chunk_id string, section_title string, section_path string")
    got = {}
    for r in T.heading_candidates(rows, ["chunk_id"]).collect():
        got[r.term] = got.get(r.term, 0) + r.n
    assert got == {"capital planning": 12, "capital": 4, "planning": 4, "risk": 12}


def test_next_edges(spark):
    rng = random.Random(1)
    rows = [(f"{d}{p}{i}", d, p, i) for d in "ab" for p in range(1, 6) for i in range(1, 4) if rng.random() < 0.7]
    got = sorted(map(tuple, graph.next_edges(spark.createDataFrame(rows, "chunk_id string, source_file string, page int, chunk_index int")).collect()))
    assert got == sorted((a[0], b[0]) for a, b in zip(rows, rows[1:]) if a[1] == b[1])


def test_upsert_and_guards(spark):
    old = spark.createDataFrame([("a", "pending", 1), ("b", "approved", 2)], "k string, status string, n int")
    new = spark.createDataFrame([("b", "pending", 9), ("c", "pending", None)], "k string, status string, n int")
    assert sorted(map(tuple, graph.upsert(old, new, ["k"], once=("status",)).collect())) == [("a", "pending", 1), ("b", "approved", 9), ("c", "pending", None)]
    with pytest.raises(ValueError):
        graph.require_unique(old.union(old), "k")
    with pytest.raises(FileExistsError):
        graph.refuse_existing(graph.label_counts(Concept=old), allowed=False)
    graph.refuse_existing(graph.label_counts(Concept=old), allowed=True)
    edges = spark.createDataFrame([("a", "x"), ("z", "x"), ("a", "q")], "k string, t string")
    assert [tuple(r) for r in graph.bound_edges(edges, old, "k", spark.createDataFrame([("x",)], "t string"), "t").collect()] == [("a", "x")]
    hops = graph.two_hops(spark.createDataFrame([("r", "p"), ("p", "l"), ("l", "m"), ("r", "l")], "parent_concept_id string, child_concept_id string"), spark.createDataFrame([("r",)], "c string"))
    assert {tuple(r) for r in hops.collect()} == {("r", "r", 0), ("r", "p", 1), ("r", "l", 1), ("r", "m", 2)}


def test_fuzzy_equals_all_pairs(spark):
    rng = random.Random(2)
    words = ["customer", "due", "diligence", "capital", "ratio", "risk", "limit", "資本充足比率", "盡職審查", "a", "kyc"]
    terms = [(f"t{i}", "k", " ".join(rng.sample(words, rng.randrange(1, 4))), "phrase") for i in range(60)]

    def spoil(s):
        i = rng.randrange(len(s))
        return s[:i] + rng.choice(["", s[i] * 2, "x"]) + s[i + 1 :]

    asked = [(f"q{i}", "What is " + spoil(rng.choice(terms)[2]) + "?") for i in range(60)]
    norm = lambda s: " ".join("".join(c if c.isalnum() or c == " " else " " for c in s.casefold()).split())
    want = {(q, t[0]) for q, text in asked for t in terms if len(t[2].replace(" ", "")) >= 4 and R.fuzzy_similarity(norm(text), norm(t[2])) >= 0.88}
    got = R.fuzzy_matches(spark.createDataFrame(asked, "question_id string, question string"), spark.createDataFrame(terms, "term_id string, concept_id string, text string, match_type string"))
    assert {(r.question_id, r.term_id) for r in got.collect()} == want and want
    assert round(R.fuzzy_similarity("customer due dilligence", "customer due diligence"), 4) == 0.9778
    assert SequenceMatcher(None, "tide", "diet").ratio() == 0.25 == R.fuzzy_similarity("tide", "diet")


def test_fuzzy_search_equals_all_pairs_without_comparing_them(monkeypatch):
    """Many long terms of few words: the same pairs as a comparison of all, of which few reach the matcher."""
    rng = random.Random(5)
    latin, signs = ["linear", "tiered", "audit", "tenor", "cover", "capital", "kyc", "ledger", "frame"], "估值審批攤銷撥備流動資金比率監管"
    terms = sorted({" ".join(rng.sample(latin, 4)) for _ in range(60)} | {"".join(rng.choices(signs, k=rng.randrange(4, 20))) for _ in range(60)} | {"kyc" + "".join(rng.choices(signs, k=4)) for _ in range(5)})

    def spoil(s):
        i = rng.randrange(len(s))
        return s[:i] + rng.choice(["", s[i] * 2, "x", signs[0]]) + s[i + 1 :]

    asked = sorted({rng.choice(["where is ", "", "問"]) + spoil(t) for t in terms} | {t[1:] for t in terms} | {t[:-1] for t in terms})
    form = lambda q, t: "l" + X.latin_form(t) if X.latin_form(q) and X.latin_form(t) else "s" + X.sign_form(t)
    want = {(i, form(q, t), R.fuzzy_similarity(q, t, 0.88)) for i, q in enumerate(asked) for t in terms}
    calls = []
    monkeypatch.setattr(X, "SequenceMatcher", type("Counted", (SequenceMatcher,), {"ratio": lambda self: (calls.append(1), SequenceMatcher.ratio(self))[1]}))
    assert set(X.Goals(terms, 0.88).search(asked)) == {w for w in want if w[2]}
    assert len(calls) < len(asked) * len(terms) / 20


def test_exact_and_decisions(spark, terms):
    asked = spark.createDataFrame([("q1", "Is customer due-diligence overdue?"), ("q2", "進行客戶盡職審查的程序？"), ("q3", "nothing"), ("q4", None)], "question_id string, question string")
    got = {(r.question_id, r.term_id) for r in R.exact_matches(asked, terms.where("text <> 'x'")).collect()}
    assert got == {("q1", "t1"), ("q1", "t2"), ("q2", "t3")}
    one = {(r.question_id, r.concept_id): (r.confidence, r.matched_terms) for r in R.grouped(R.exact_matches(asked, terms)).collect()}
    assert one["q1", "k1"] == (1.0, ["customer due diligence", "due"])
    rows = spark.createDataFrame([("a", "k1", 0.95), ("a", "k2", 0.89), ("b", "k1", 0.95), ("b", "k2", 0.91), ("c", "k1", 0.9)], "question_id string, concept_id string, confidence double")
    assert sorted((r.question_id, r.concept_id, r.status) for r in R.fuzzy_decision(rows).collect()) == [("a", "k1", "resolved"), ("b", "k1", "ambiguous"), ("b", "k2", "ambiguous"), ("c", "k1", "resolved")]
    ranked = spark.createDataFrame([("a", "k1", 0.8, 1), ("a", "k2", 0.77, 2), ("a", "k3", 0.5, 3), ("b", "k1", 0.4, 1), ("c", "k1", 0.6, 1)], "question_id string, concept_id string, confidence double, rank int")
    single = {(r.question_id, r.concept_id): (r.status, r.taken) for r in R.semantic_decision(ranked).collect()}
    assert single["a", "k1"] == ("ambiguous", False) and single["b", "k1"] == ("unresolved", False) and single["c", "k1"] == ("resolved", True)
    both = {(r.question_id, r.concept_id): r.taken for r in R.semantic_decision(ranked, single=False).collect()}
    assert both["a", "k1"] and both["a", "k2"] and not both["a", "k3"]


def test_questions(spark):
    rows = spark.createDataFrame([(1, "What is the definition of capital?"), (2, "資本的要求有哪些"), (3, "Compare A vs B"), (4, "how to file"), (5, "tell me")], "i int, q string")
    assert [r.r for r in rows.select(R.intent(F.col("q")).alias("r")).collect()] == ["definition", "control_requirements", "comparison", "procedure", "general_information"]
    rows = spark.createDataFrame([("The risk and 客戶盡職審查的要求",), ("a is",), (None,)], "q string")
    assert [r.r for r in rows.select(R.keywords(F.col("q")).alias("r")).collect()] == [["risk", "客戶盡職審查的", "客戶", "戶盡", "盡職", "職審", "審查", "查的"], [], []]


def test_ranking(spark, chunks):
    found = R.lexical_chunks(chunks.withColumn("is_table_of_contents", F.lit(None).cast("boolean")), ["due", "kyc"], 10)
    best = R.ranked(found, ["due", "kyc"], "general_information", 5).collect()
    assert [(r.chunk_id, r.lexical_score, r.relevance, r.citation) for r in best] == [("c1", 2, 320, "[a.pdf p.1]"), ("c5", 1, 160, "[b.pdf p.1]")]


def test_facts(spark, chunks):
    edges = spark.createDataFrame([("c1", "k2"), ("c1", "k1"), ("c1", "k3"), ("c2", "k1"), ("c3", "k1"), ("c3", "k2")], "chunk_id string, concept_id string")
    none = spark.createDataFrame([], "chunk_id string")
    todo = facts.unsupported_chunks(chunks, edges, none)
    found = facts.cooccurrences(todo)
    assert sorted((r.chunk_id, r.subject_concept_id, r.object_concept_id) for r in found.collect()) == [("c1", "k1", "k2"), ("c1", "k1", "k3"), ("c1", "k2", "k3")]
    bad = found.limit(1).withColumn("evidence_quote", F.lit("not there")).unionByName(found.limit(1).withColumn("predicate", F.lit("LOVES"))).unionByName(found.limit(1).withColumn("confidence", F.lit(2.0))).unionByName(found.limit(1).withColumn("subject_concept_id", F.lit("k9")))
    assert facts.valid(bad, chunks, edges).count() == 0 and facts.valid(found, chunks, edges).count() == 3
    nodes = facts.fact_nodes(found)
    first = nodes.orderBy("fact_id").first().fact_id
    nodes = facts.set_status(nodes, spark.createDataFrame([(first, "approved")], "fact_id string, new_status string"))
    assert {r.fact_id: r.status for r in facts.write_facts(nodes, found).collect()}[first] == "approved"
    assert facts.pending(nodes, facts.supports(found), chunks, 9).count() == 2
    assert [r.fact_id for r in facts.approved(nodes, facts.supports(found), chunks, ["k1", "k2", "k3"], 5).collect()] == [first]
    with pytest.raises(ValueError):
        facts.set_status(nodes, spark.createDataFrame([("fact_no", "approved")], "fact_id string, new_status string"))


def test_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((40, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r], int(i % 3)) for i, r in enumerate(x)] + [(98, None, 0), (99, [0.0] * 8, 1), (97, [None] * 8, 1)], "k int, v array<double>, g int")
    c = {r.g: np.array(r.centroid) for r in V.centroids(df.where(V.usable(F.col("v"))), "g", "v").collect()}
    for g in range(3):
        m = x[np.arange(40) % 3 == g].mean(axis=0)
        assert np.allclose(c[g], m / np.linalg.norm(m))
    m = spark.createDataFrame([(f"n{g}", [float(v) for v in c[g]]) for g in c], "n string, c array<double>")
    held = V.similarities(df, "k", "v", m, "n", "c")
    got = {(r.k, r.n): r.similarity for r in held.collect()}
    assert len(got) == 120 and got[5, "n1"] == pytest.approx(float(x[5] @ c[1] / np.linalg.norm(x[5])))
    own = {r.k: r for r in assign.primary(df, "k", "v", m, "n", "c").collect()}
    assert own[7].n == max((got[7, n], n) for n in ("n0", "n1", "n2"))[1]
    two = V.similarities(df, "k", "v", m, "n", "c", top=2).collect()
    assert {(r.k, r.n) for r in two} == {(k, n) for k in range(40) for n in sorted(("n0", "n1", "n2"), key=lambda n: (-round(got[k, n], 6), n))[:2]}
    angles = {"n0": 0.0, "n1": 0.3, "n2": 0.45, "n3": 2.0}
    m = spark.createDataFrame([(n, [math.cos(a), math.sin(a)]) for n, a in angles.items()], "n string, c array<double>")
    df = spark.createDataFrame([(k, [2 * math.cos(a), 2 * math.sin(a)]) for k, a in (("a", 0.1), ("b", 0.36), ("c", 1.2))], "k string, v array<double>")
    chosen = spark.createDataFrame([("a", "n0"), ("b", "n3"), ("c", "n2")], "k string, n string")
    assert sorted((r.k, r.n) for r in assign.secondary(df, "k", "v", m, "n", "c", chosen).collect()) == [("a", "n1"), ("b", "n1")]


def test_clusterings():
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((3, 6)) * 4
    x = np.vstack([c + 0.3 * rng.standard_normal((40, 6)) for c in centre] + [rng.uniform(-12, 12, (12, 6))])
    label, strength = assign.density_clusters(x, 8, 3)
    groups = [set(label[i * 40 : (i + 1) * 40]) - {-1} for i in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3 and (label[120:] == -1).sum() >= 9
    assert ((strength >= 0) & (strength <= 1)).all() and strength[label == -1].max(initial=0) == 0
    assert [assign.automatic_settings(n) for n in (10, 500, 1161, 2000)] == [(8, 2), (8, 2), (10, 3), (10, 3)]
    two = assign.average_linkage(x[:80], 2)
    assert len(set(two[:40])) == 1 and len(set(two[40:])) == 1 and two[0] != two[79]
    assert assign.silhouette(x[:80], two) > 0.5 and assign.silhouette(x[:80], np.zeros(80, int)) == 0
    y = assign.reduce_dimensions(rng.standard_normal((200, 64)))
    assert y.shape == (200, 50) and np.allclose(np.linalg.norm(y, axis=1), 1)
    assert assign.cluster_points(rng.standard_normal((9, 4)))[2] in ("hdbscan", "agglomerative_fallback")
    base = np.eye(3)
    leaves = [(f"l{i}", list(base[i // 3] + 0.05 * rng.standard_normal(3))) for i in range(9)]
    assert sorted(m for m, _ in assign.taxonomy_groups(leaves)) == [["l0", "l1", "l2"], ["l3", "l4", "l5"], ["l6", "l7", "l8"]]
    assert assign.taxonomy_groups(leaves[:3]) == [] == assign.taxonomy_groups([])


def test_ontology(spark):
    rng = np.random.default_rng(6)
    subjects = ["capital ratio", "client money", "stress testing", "wire transfers", "record keeping"]
    rows = []
    for i in range(150):
        s = i % 5
        v = np.eye(8)[s] + 0.1 * rng.standard_normal(8)
        rows.append((f"c{i:03d}", f"The board reviews the {subjects[s]} each year and {subjects[s]} limits.", None, f"d{i % 4}.pdf", i // 4, 1, None, f"1.1 {subjects[s]}", [float(z) for z in v]))
    df = spark.createDataFrame(rows, "chunk_id string, text string, retrieval_text string, source_file string, page int, chunk_index int, section_title string, section_path string, embedding array<double>")
    o = induce.induce(df)
    leaves = [r for r in o.concepts.collect() if r.level == 2]
    assert len(leaves) == 5 and sum(r.chunk_count for r in leaves) == 150 and len({r.name for r in leaves}) == 5
    assert o.assignments.where("primary").count() == 150
    text = {r[0]: r[1] for r in rows}
    by_leaf = {}
    for r in o.assignments.where("primary").collect():
        by_leaf.setdefault(r.concept_id, set()).add(subjects[int(r.chunk_id[1:]) % 5])
    assert all(len(s) == 1 for s in by_leaf.values()) and len(set().union(*by_leaf.values())) == 5  # each leaf is one subject
    assert all(next(iter(by_leaf[r.concept_id])) in r.name for r in leaves) and len(text) == 150
    for r in o.terms.collect():
        assert any(r.normalized_text in t.lower() for t in text.values())
    own = {r.concept_id: [x.embedding for x in leaves if x.concept_id == r.concept_id][0] for r in leaves}
    for r in o.representatives.collect():
        assert int(np.argmax(own[r.concept_id])) == int(r.chunk_id[1:]) % 5
    edges = {(r.parent_concept_id, r.child_concept_id) for r in o.taxonomy.collect()}
    assert {c for _, c in edges} >= {r.concept_id for r in leaves}
    assert o.terms.groupBy("concept_id").count().agg(F.max("count")).first()[0] <= 12
    assert induce.preview(o).count() == 1
    assert induce.run_id("h", {"b": 1, "a": 2}) == induce.run_id("h", {"a": 2, "b": 1})
    with pytest.raises(ValueError):
        induce.induce(df.limit(3))
    with pytest.raises(ValueError):
        induce.induce(df, terms_per_concept=0)


def test_files(spark, tmp_path):
    import hashlib

    for name, data in (("B.PDF", b"two"), ("a.pdf", b"one"), ("c.txt", b"no")):
        (tmp_path / name).write_bytes(data)
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "d.pdf").write_bytes(b"deep")
    got = files.source_files(spark, str(tmp_path)).collect()
    assert {(r.file_name, r.sha256) for r in got} == {("B.PDF", hashlib.sha256(b"two").hexdigest()), ("a.pdf", hashlib.sha256(b"one").hexdigest())}
    row = [("r_p1_c1", "r one.pdf", 'h"x', 1, 1, "2.1", "T", "P > T", False, 5, 1, 2, 2, "m", "ctx", "body")]
    df = spark.createDataFrame(row, "chunk_id string, source_file string, document_sha256 string, page int, chunk_index int, section_id string, section_title string, section_path string, is_table_of_contents boolean, estimated_tokens int, start_line int, end_line int, split_part int, chunking_method string, retrieval_text string, text string")
    files.export_markdown(df, str(tmp_path / "out"))
    text = (tmp_path / "out" / "r one" / "p0001_c001_2.1_part-02.md").read_text()
    assert text.startswith('---\nchunk_id: "r_p1_c1"\n') and 'document_sha256: "h\\"x"' in text and "(../../r%20one.pdf#page=1)" in text and text.endswith("## Source Text\n\nbody\n")
    with pytest.raises(FileExistsError):
        files.export_markdown(df, str(tmp_path / "out"))
    calls = []

    def encode(chunks):
        calls.append(1)
        return chunks.select("chunk_id", F.array(F.lit(1.0)).alias("embedding"))

    ids = spark.createDataFrame([("a",), ("b",)], "chunk_id string")
    hits = [files.cached_vectors(spark, str(tmp_path / "cache"), "m/x", "h" * 64, d, encode)[1] for d in (ids, ids, ids.limit(1))]
    assert hits == [False, True, False] and len(calls) == 2
