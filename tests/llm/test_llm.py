"""The training-data operators: brute force, held-out accuracy, and the edge cases of their docstrings."""

import datetime as dt
import glob
import os
import pickle
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from folioscan.llm import contamination, language, matching, mixing, papers, queries, survivor
from folioscan.llm.distinctive import term_relevance
from folioscan.session import shared_dir
from tests.conftest import rows
from verify import canonical

EMPTY_PAPERS = "item_id bigint, title string, authors string, year string, summary string, url string, source string, doi string, arxiv_id string, retrieved_at timestamp_ntz"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, tiny, name):
    con = duckdb.connect()
    for path in glob.glob(f"{tiny}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    assert canonical(queries.QUERIES[name](spark, tiny).toPandas()) == canonical(con.execute(queries.SQL[name]).df())


# --- 1


DOCS = "id string, title string, content string, indexed_at timestamp_ntz, term string, tf int, df int"


def test_terms_edge_cases(spark):
    t = dt.datetime
    data = [
        ("A", "Étale", "etale Étale word", t(2024, 1, 2), "x", 1, 1),
        ("A", "old", "gone gone", t(2024, 1, 1), None, None, None),
        ("A", "Étale", "etale Étale word", t(2024, 1, 2), "x", 1, 1),  # repeated
        ("B", None, None, t(2024, 1, 1), None, None, None),
        ("C", "", "word", None, None, None, None),
        ("C", "", "word2words " * 20000, t(2024, 1, 1), None, None, None),
        (None, "lost", "lost", t(2024, 1, 1), None, None, None),
    ]
    got = {(r.id, r.term): r for r in term_relevance(spark.createDataFrame(data, DOCS)).collect()}
    assert set(got) == {("A", "etale"), ("A", "word"), ("C", "word"), ("C", "words")}
    assert (got["A", "etale"].tf, got["A", "etale"].df, got["A", "word"].df) == (3, 1, 2)
    assert got["C", "words"].tf == 20000
    assert got["A", "etale"].score > got["A", "word"].score
    assert term_relevance(spark.createDataFrame([], DOCS)).count() == 0


# --- 2


def plain_survivors(groups, rows_, trust):
    """The stated order, read literally, one group at a time."""
    rank = {(f, re.sub(r"\s", "", s).lower()): n for f, s, n in trust}
    by = {}
    for r in rows_:
        by.setdefault(r["item_id"], []).append(r)
    out = set()
    for g in {g for g, _ in groups}:
        members = [r for i in {i for h, i in groups if h == g} for r in by.get(i, [])]
        longest = max((r["title"] or "" for r in members), key=lambda x: (len(x), x), default="")
        for field in survivor.FIELDS:
            best = []
            for r in members:
                if field == "summary":
                    words = papers.abstract(r["summary"], [papers.letters(r["title"]), papers.letters(longest)])
                    ok, n = bool(words), len(words)
                else:
                    ok, n = (papers.valid_doi if field == "doi" else papers.valid_arxiv)(r[field]) is not None, 0
                if ok:
                    s = re.sub(r"\s", "", r["source"] or "").lower()
                    at = r["retrieved_at"]
                    best.append((n, rank.get((field, s), -2 if not s else -1), at is not None, at or dt.datetime.min, -r["item_id"]))
            if best:
                out.add((g, field, -max(best)[-1]))
    return out


def test_survivors_against_brute_force(spark, small):
    read = lambda n: [r.asDict() for r in spark.read.parquet(f"{small}/{n}.parquet").collect()]
    want = plain_survivors([(r["group_id"], r["item_id"]) for r in read("dup_groups")], read("retrieve_papers"), [(r["field_name"], r["source"], r["trust"]) for r in read("source_trust")])
    got = {tuple(r) for r in queries.p2_found(spark, small).collect()}
    assert got == want and len(got) > 100


def test_votes_differ_from_the_stated_order(spark, small):
    """With a flat prior the votes decide; they name other rows than the order does for some identifiers."""
    votes = {(r.group_id, r.field_name) for r in queries.p2_votes(spark, small).collect()}
    assert votes == {(r.group_id, r.field_name) for r in queries.p2_found(spark, small).collect()}


def test_survivor_fusion(spark):
    copied = survivor.log_copied(20, 15, 0, 0.6, 0.6)
    assert survivor.dependence(copied) > 0.95
    assert survivor.dependence(survivor.log_copied(20, 0, 20, 0.8, 0.8)) < 0.2
    one = survivor.vote(["a", "b"], {"a": 0.8, "b": 0.8}, {("a", "b"): 1.0})
    two = survivor.vote(["a", "b"], {"a": 0.8, "b": 0.8}, {})
    assert one < two
    # Two sources, neither in the table of trust nor pooled, against a trusted one.
    data = [
        (1, "T", None, None, None, None, "X", "10.1000/a", None, None),
        (2, "T", None, None, None, None, "Y", "10.1000/b", "2101.00001v2", None),
        (3, "T", None, None, None, None, "Z", "10.1000/b", "arXiv: 2101.00001", None),
    ]
    p = spark.createDataFrame(data, EMPTY_PAPERS)
    g = spark.createDataFrame([(1, i, "extra") for i in (1, 2, 3, 3)], "group_id bigint, item_id bigint, title string")
    t = spark.createDataFrame([("doi", "x ", 9), ("doi", "W", 2)], "field_name string, source string, trust int")
    pick = lambda **k: {r.field_name: r for r in survivor.survivors(g, p, t, **k).collect()}
    default, flat = pick(), pick(trust_weight=0.0, words_weight=0.0)
    assert {f: r.item_id for f, r in default.items()} == {"doi": 1, "arxiv_id": 2}
    assert flat["doi"].item_id == 2 and flat["doi"].posterior > 0.9
    assert survivor.survivors(g.limit(0), p, t).count() == 0
    assert survivor.survivors(g, p.limit(0), t).count() == 0
    assert survivor.survivor_records(survivor.survivors(g, p, t)).first().doi == "10.1000/a"


def test_enough_votes_outweigh_trust(spark):
    """The prior is finite: the posterior, not the order, decides."""
    data = [(i, "T", None, None, None, None, f"s{i}", "10.1000/b" if i else "10.1000/a", None, None) for i in range(9)]
    p = spark.createDataFrame(data, EMPTY_PAPERS)
    g = spark.createDataFrame([(1, i) for i in range(9)], "group_id bigint, item_id bigint")
    t = spark.createDataFrame([("doi", "s0", 9)], "field_name string, source string, trust int")
    assert survivor.survivors(g, p, t).first().item_id == 1
    assert survivor.survivors(g, p, t, trust_weight=100.0).first().item_id == 0


def test_copies_count_less(spark):
    """Two sources that share their false values elsewhere lose to one alone with a like accuracy."""
    fusion = survivor.Fusion()
    fusion.accuracy = {"doi": {"a": 0.6, "b": 0.6, "c": 0.9}}
    kinds = [{"sources": ["a", "b"], "prior": 0.0, "n": 1}, {"sources": ["c"], "prior": 0.0, "n": 1}]
    free = fusion.posteriors("doi", kinds)
    fusion.copying, fusion._cache = {("a", "b"): 1.0}, {}
    bound = fusion.posteriors("doi", kinds)
    assert free[0] > free[1] and bound[0] < bound[1] and sum(bound) < 1


def test_abstracts_are_one_value_by_their_whole_beginning(spark):
    """A cut belongs to the text that goes on from it; texts that part after six words are two values."""
    open_ = "we show that every flat cover of the ring"
    texts = [open_, open_ + " splits", open_ + " splits twice in", open_ + " is affine", "we show", "we find that", "other", open_ + "s"]
    got = {r.plain: r.key for r in survivor.value_keys(spark.createDataFrame([("s", t) for t in texts] + [("z", "we show")], "slot string, plain string").filter("slot = 's'")).collect()}
    assert set(got) == set(texts)
    assert got[open_ + " splits"] == got[open_ + " splits twice in"] != got[open_ + " is affine"]
    assert got["we show"] == got[open_ + " splits twice in"]  # of several, the longest
    assert len({got[t] for t in ("we find that", "other", open_ + "s", open_ + " is affine")}) == 4


@pytest.mark.parametrize(
    ("value", "want"),
    [("https://doi.example/10.99999/Ab.1", "10.99999/ab.1"), ("DOI: 10.9999/x", "10.9999/x"), (" 10.9999/ x ", "10.9999/x"), ("10.99/x", None), ("10.9999/", None), ("11.9999/x", None), ("", None), (None, None), ("doi", None)],
)
def test_doi(value, want):
    assert papers.valid_doi(value) == want


@pytest.mark.parametrize(
    ("value", "want"),
    [("1304.54124v3", "1304.54124v3"), ("arXiv:1304.5412V3", "1304.5412v3"), ("https://preprints.example/abs/1304.54124 ", "1304.54124"), ("1313.54124", None), ("1300.54124", None), ("1304.541", None), ("arXiv", None), (None, None)],
)
def test_arxiv(value, want):
    assert papers.valid_arxiv(value) == want


def test_abstracts():
    title = [papers.letters("A note on flat maps: the Zubu cover revisited")]
    for bad in (None, "", "-", "N/A", "TBA", "[abstract missing]", "No abstract available.", "tags: a, b; score: 3; answers: 1; accepted/answered: True", "A NOTE ON FLAT MAPS: THE ZUBU COVER REVISITED", "This content is available to subscribers only. Please sign in."):
        assert papers.abstract(bad, title) == [], bad
    assert len(papers.abstract("<jats:p>We show that $X$ is flat ...</jats:p>", title)) == 6
    assert len(papers.abstract("  We  show  it.\n", title)) == 3


# --- 5


def test_matching_finds_known_groups(spark, small):
    """Pairs of the given groups, kept in the result, fitted without them: half of the groups label, the rest is held out."""
    p, g = spark.read.parquet(f"{small}/retrieve_papers.parquet"), spark.read.parquet(f"{small}/dup_groups.parquet").distinct()
    found = matching.match_entities(p, g.filter("group_id % 2 = 0"), exclude_groups=False)
    got = {(r.item_id_a, r.item_id_b) for r in found.collect()}
    src = {r.item_id: re.sub(r"\s", "", r.source or "").lower() for r in p.collect()}
    held = [(r.group_id, r.item_id) for r in g.filter("group_id % 2 = 1").collect()]
    true = {(a, b) for h, a in held for k, b in held if h == k and a < b and src[a] != src[b]}
    known = {i: h for h, i in held}
    wrong = [(a, b) for a, b in got if a in known and b in known and known[a] != known[b]]
    assert len(true & got) >= 0.95 * len(true) and len(true) > 20
    assert len(wrong) <= 0.05 * len(true)


@pytest.fixture(scope="module")
def matcher(spark, small):
    """A classifier fitted on the given groups and weak labels of the small tables."""
    p, g = spark.read.parquet(f"{small}/retrieve_papers.parquet"), spark.read.parquet(f"{small}/dup_groups.parquet")
    items = matching.prepare(p)
    common = matching.common_stems(items)
    return matching.fit(items, matching.candidate_pairs(items, common), g, common)


def test_matching_edge_cases(spark, matcher):
    z = (None,) * 10
    base = ("On the flat cover of Zubulant rings", "Ada Lovelast, Ben Cantork", "2020", None, None)
    data = [
        (1, *base, "A", None, None, None),
        (1, *base, "A", None, None, None),  # repeated
        (2, "on the flat cover of zubulant rings.", "LOVELAST Ada and CANTORK Ben", "2020", "", None, " b ", "", "", None),
        (3, "On the flat cover of Zubulant rings II", "A. Lovelast, B. Cantork", "2021", None, None, "B", None, None, None),
        (4, "Erratum: On the flat cover of Zubulant rings", "A. Lovelast, B. Cantork", "2021", None, None, "C", None, None, None),
        (5, *base, "a", None, None, None),  # the same source as 1
        (6, None, None, None, None, None, None, None, None, None),
        (7, "", "", "", "word " * 20000, None, "", "", "", None),
        z,
    ]
    df = spark.createDataFrame(data, EMPTY_PAPERS).withColumn("confidence", F.lit(1))
    got = {(r.item_id_a, r.item_id_b) for r in matching.match_entities(df, model=matcher).collect()}
    assert got == {(1, 2), (2, 5)}
    listed = spark.createDataFrame([(9, 2)], "group_id bigint, item_id bigint")
    assert matching.match_entities(df, listed, model=matcher).count() == 0
    assert matching.match_entities(df.limit(0)).count() == 0
    links, members = matching.match_classes(df, model=matcher)
    sized = {r.item_id: (r.class_id, r.n_links) for r in matching.match_members(links, members).collect()}
    assert sized == {1: (1, 1), 2: (2, 1), 3: (3, 0), 4: (4, 0), 5: (1, 1), 6: (6, 0), 7: (7, 0)}
    with pytest.raises(ValueError, match="labels"):  # nothing stands in for a classifier
        matching.match_entities(df.filter("item_id IN (1, 2)"))


@pytest.mark.parametrize("n", [20, 50, 51, 500])
def test_a_pair_is_found_in_a_block_of_any_size(spark, n):
    """Two renditions of one work among ``n`` items of one surname and one common stem."""
    data = [(i, f"Topology {'' if i < 2 else chr(97 + i % 26) * 4 + chr(97 + i // 26) * 4}", "A. Wang", None, None, None, f"s{i}", None, None, None) for i in range(n)]
    items = matching.prepare(spark.createDataFrame(data, EMPTY_PAPERS))
    assert matching.candidate_pairs(items, []).filter("item_id_a = 0 AND item_id_b = 1").count() == 1


@pytest.mark.parametrize("part", [7, 500])
def test_large_blocks_are_whole(spark, monkeypatch, part):
    """All pairs of a block of over 50 items meet, with or without a further stem or a title, in one part or more."""
    monkeypatch.setattr(matching, "PART", part)
    n, all_pairs = 60, lambda ids: {(a, b) for a in ids for b in ids if a < b}
    row = lambda i, title, authors, doi=None, summary=None: (i, title, authors, str(1950 + i % 70), summary, None, f"s{i}", doi, None, None)
    said = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    blocks = [
        [row(i, "Topology", "A. Wang") for i in range(n)],
        [row(100 + i, "", None, "10.1234/shared.1") for i in range(n)],
        [row(200 + i, None, None, None, said) for i in range(n)],
        [row(300 + i, f"Sheaves {chr(97 + i % 26) * 4}{chr(97 + i // 26) * 4}", "B. Quillen") for i in range(n)],  # no further stem in common
        [row(400 + i, "Motives", None if i < 10 else "C. Noether") for i in range(n)],
    ]
    items = matching.prepare(spark.createDataFrame([r for b in blocks for r in b], EMPTY_PAPERS))
    got = [tuple(r) for r in matching.candidate_pairs(items, []).collect()]
    assert len(got) == len(set(got))
    assert set(got) == set().union(*(all_pairs([r[0] for r in b]) for b in blocks))


@pytest.fixture
def crowd(spark):
    """Items with one surname or none, some of which share identifiers, so that pairs meet in blocks of several kinds."""
    row = lambda i: (i, f"Topology of motives {chr(97 + i % 26) * 4}", "A. Wang" if i % 3 else None, str(1950 + i % 70), None, None, f"s{i}", f"10.1234/{i // 4}.1", None, None)
    return spark.createDataFrame([row(i) for i in range(120)], EMPTY_PAPERS)


def test_tiles_are_all_pairs(crowd):
    """Each pair is in exactly one tile, whatever blocks it meets in."""
    items = matching.prepare(crowd)
    whole = [tuple(r) for r in matching.candidate_pairs(items, []).collect()]
    assert len(whole) > 3000
    blocks, meetings = matching.candidate_blocks(items, [])
    assert meetings >= len(whole)
    tiles = [[tuple(r) for r in matching.pairs_of(blocks, i, j, 4).collect()] for i in range(4) for j in range(i, 4)]
    assert sorted(p for t in tiles for p in t) == sorted(whole)
    assert max(map(len, tiles)) < len(whole) / 4
    drawn = {tuple(r) for r in matching._drawn(blocks, meetings, 50).collect()}
    order = [tuple(r) for r in matching.candidate_pairs(items, []).orderBy(F.xxhash64("item_id_a", "item_id_b")).limit(50).collect()]
    assert set(order) <= drawn and len(drawn) < len(whole)


def test_python_reads_only_pairs_that_may_match(spark, crowd, matcher, tiny):
    """The bound of a pair is never below its logit; only pairs that may reach the threshold are read, and all that reach it are."""
    import numpy as np
    import pyarrow as pa

    noisy = queries.table(spark, tiny, "retrieve_papers").select(F.col("item_id") + 1000, *crowd.columns[1:]).toDF(*crowd.columns)
    items = matching.prepare(crowd.unionByName(noisy)).localCheckpoint()
    common = matching.common_stems(items)
    pairs = items.select(F.col("item_id").alias("item_id_a")).join(items.select(F.col("item_id").alias("item_id_b")), F.col("item_id_a") < F.col("item_id_b"))
    x = {(r.item_id_a, r.item_id_b): r.x for r in matching.compared(pairs, items, common).collect()}
    outlined = pairs
    for s in "ab":
        outlined = outlined.join(items.select(*[F.col(c).alias(f"{c}_{s}") for c in items.columns], *[c.alias(f"{n}_{s}") for n, c in matching._outline(common).items()]), f"item_id_{s}")
    some = np.random.default_rng(1)
    every = [matcher.weights, *some.normal(size=(5, len(matching.FEATURES)))]

    def bounds(batches):
        for b in batches:
            found = [matching.greatest_logit(b, w) for w in every]
            yield pa.record_batch([b["item_id_a"], b["item_id_b"], pa.array(np.transpose(found).tolist(), pa.list_(pa.float64()))], ["a", "b", "z"])

    bound = {(r.a, r.b): r.z for r in outlined.mapInArrow(bounds, "a bigint, b bigint, z array<double>").collect()}
    assert len(x) > 3000
    assert all(z >= np.dot(x[p], w) - 1e-9 for p in x for z, w in zip(bound[p], every))
    read = {(r.item_id_a, r.item_id_b): r.x for r in matching.compared(pairs, items, common, matcher, 0.5).collect()}
    reach = {p for p, v in x.items() if matcher.probability(np.array([v]))[0] >= 0.5}
    assert reach and reach <= set(read) and all(read[p] == x[p] for p in read)
    assert len(read) < len(x) / 2


def test_comparing_takes_bounded_disk(spark, crowd, matcher, monkeypatch):
    """Pairs are compared a few at a time, with the same result; what nothing reads any more is deleted."""
    monkeypatch.setattr(matching, "LEAST_TILE", 10**9)
    found = lambda **k: {(r.item_id_a, r.item_id_b, round(r.confidence, 9)) for r in matching.match_entities(crowd, model=matcher, **k).collect()}
    whole = found()
    monkeypatch.setattr(matching, "LEAST_TILE", 1000)
    sizes, compared = [], matching.compared
    monkeypatch.setattr(matching, "compared", lambda pairs, *a: sizes.append(pairs.count()) or compared(pairs, *a))
    folder = f"{shared_dir(spark)}/folioscan".removeprefix("file://")
    before = set(os.listdir(folder))
    assert whole and found(closing=False) <= whole
    assert len(sizes) > 5 and max(sizes) < 1000
    left = {name.split("-")[0] for name in set(os.listdir(folder)) - before}
    assert left == {"links", "members"}
    assert found() == whole
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_closing_goes_on_to_the_end(spark, monkeypatch):
    """A work under two titles, two items each: its ends are three links apart."""
    model = matching.Classifier()
    model.weights[[matching.FEATURES.index(f) for f in ("intercept", "title_least", "doi_same")]] = -6, 12, 12
    monkeypatch.setattr(matching, "fit", lambda *_: model)
    a, b, doi = "Flat covers and rings", "Descent along torsors", "10.1234/one.1"
    data = [(1, a, None), (2, a, doi), (3, b, doi), (4, b, None)]
    df = spark.createDataFrame([(i, t, "A. Wang", "2020", None, None, f"s{i}", d, None, None) for i, t, d in data], EMPTY_PAPERS)
    got = {(r.item_id_a, r.item_id_b): r.confidence for r in matching.match_entities(df).collect()}
    assert set(got) == {(x, y) for x in range(1, 5) for y in range(x + 1, 5)}
    assert got[1, 4] < got[1, 3] < got[1, 2]


def test_titles_and_names():
    read = papers.read_title
    assert read("X of Y and Z: Part Two")["part"] == 2 and read("sections and part coverings  two")["part"] == 2
    assert read("Addendurn: Remarks on X")["note"] and not read("Remarks on X")["note"]
    assert read("Is there a reference for flat maps?")["question"] and not read("How flat maps bound covers")["question"]
    assert read("Article: [v2] Flat <i>maps</i> (preprint)")["tokens"] == ["flat", "maps"]
    assert papers.surnames("Senbuhara, L.; Varbarahara, T.") == (["senbuhara", "varbarahara"], False)
    assert papers.surnames("T. Quozé et al.") == (["quoze"], True)
    assert papers.near("flat", "falt", 1) and not papers.near("flat", "form", 1)


# --- 6


def plain_leaks(text, items):
    doc, out = contamination.words(text), set()
    for k, t in items:
        w = contamination.words(t)
        runs = {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
        if any(tuple(doc[i : i + 12]) in runs for i in range(len(doc) - 11)):
            out.add(k)
            continue
        need, most = -(-8 * len(w) // 10), int(1.25 * len(w) + 1e-9)
        for s in range(len(doc)):
            part = doc[s : s + most]
            if sum(x in set(w) for x in part) < need:
                continue
            row = [0] * (len(w) + 1)
            for x in part:
                new = [0]
                for j, y in enumerate(w, 1):
                    new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
                row = new
            if row[-1] >= need:
                out.add(k)
                break
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(40)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.randint(8, 40)))) for k in range(12)]
    docs = []
    for d in range(60):
        body = rng.choices(vocab + [f"z{i}" for i in range(200)], k=rng.randint(0, 150))
        w = rng.choice(items)[1].split()
        cut = w[rng.randint(0, 5) :][: rng.randint(5, 40)]
        cut = [x for x in cut if rng.random() > rng.choice([0, 0.1, 0.25])]
        at = rng.randint(0, len(body))
        docs.append((d, " ".join(body[:at] + cut + body[at:])))
    got = contamination.leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), max_items=5)
    want = {(d, k) for d, t in docs for k in plain_leaks(t, items)}
    assert {tuple(r) for r in got.collect()} == want and want


def test_leaks_of_items_of_any_length(spark):
    """Items of 1 to 60 words, documents with parts of them, some with words lost or put in."""
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(120)]
    items = [(k, " ".join(rng.choices(vocab, k=k + 1))) for k in range(60)]
    docs = []
    for d in range(150):
        body = rng.choices([f"z{i}" for i in range(50)] + vocab[:20], k=rng.randint(0, 60))
        for k in rng.sample(range(60), 2):
            w = items[k][1].split()
            lost = rng.choice([0.0, 0.1, 0.2, 0.25])
            kept = [x for x in w if rng.random() >= lost]
            for _ in range(rng.choice([0, 0, len(w) // 8, len(w) // 4])):
                kept.insert(rng.randint(0, len(kept)), "zz")
            body += kept + ["zy"] * rng.randint(0, 3)
        docs.append((d, " ".join(body)))
    want = {(d, k) for d, t in docs for k in plain_leaks(t, items)}
    frames = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert {tuple(r) for r in contamination.leaked_items(*frames).collect()} == want and len(want) > 100
    parts = contamination.leaked_items(*frames, max_words=200, measure=True).collect()
    assert {(r.doc_id, r.item_id) for r in parts} == want
    assert all(r.longest_run >= 12 or r.in_order >= 0.8 * r.n_words for r in parts)


def test_leak_index_is_sparse():
    """20,000 items over 150,000 words make an index that can be sent to executors."""
    rng = random.Random(2)
    items = [(k, [f"w{rng.randrange(150_000)}" for _ in range(50)]) for k in range(20_000)]
    index = contamination.ItemIndex(items)
    assert len(pickle.dumps(index)) < 200 << 20
    text = " ".join(["z"] * 50 + items[777][1] + ["z"] * 50 + items[5][1][:14] + ["z"] * 9)
    assert index.found(text) == [5, 777]


def test_leaks_of_just_the_share(spark):
    """Documents that hold exactly the share of a short passage and none of its other words."""
    docs = [(1, "w1 w2 w4 w5"), (2, "w1 w2 w5"), (3, "v0 v1 v3 v4 v5 v6 v8 v9"), (4, "v0 v1 v3 v4 v5 v6 v8")]
    items = [(5, "w1 w2 w3 w4 w5"), (10, " ".join(f"v{i}" for i in range(10)))]
    for listed in (items, items[1:]):
        got = contamination.leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(listed, "item_id bigint, text string"))
        assert {tuple(r) for r in got.collect()} == {(d, k) for d, t in docs for k in plain_leaks(t, listed)} == {(1, 5), (3, 10)} & {(d, k) for d in (1, 3) for k, _ in listed}


def test_leak_spellings(spark):
    passage = "find all unramified residues whose module universally refines both the separated relation and a rigidified domain"
    forms = [
        passage.upper(),
        "find all unramiﬁed residues whose module uni-\n  versally reﬁnes both the separated relation and a rigidiﬁed domain",
        "<p>Find  <b>all</b> unramified residues, whose mod­ule universally refines &quot;both&quot; the séparated relation and a rigidified domain.</p>",
        "find all unramified residues whose module universally refines",
        None,
        "",
        passage + " " + "x " * 50000,
    ]
    docs = spark.createDataFrame([(i, t, "e") for i, t in enumerate(forms)] + [(0, forms[0], "e"), (None, passage, "e")], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(1, passage), (1, passage), (2, None), (3, "")], "item_id bigint, text string")
    assert rows(contamination.leaked_items(docs, items)) == [(0, 1), (1, 1), (2, 1), (6, 1)]
    assert contamination.leaked_items(docs.limit(0), items).count() == 0
    assert contamination.leaked_items(docs, items.limit(0)).count() == 0


# --- 7


def test_mix_keeps_its_promises(spark, small):
    chosen, shares = mixing.mix_sources(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/mix_targets.parquet"), rows_per_bucket=30)
    sized = {r.doc_id: r for r in mixing.count_tokens(spark.read.parquet(f"{small}/documents.parquet")).collect()}
    whole = sum(r.n_tokens for r in sized.values())
    targets = [r.asDict() for r in spark.read.parquet(f"{small}/mix_targets.parquet").collect()]
    picked = chosen.collect()
    for mix in {t["mix_name"] for t in targets}:
        goal = {re.sub(r"\s", "", t["source"]).lower(): t for t in targets if t["mix_name"] == mix}
        mine = sorted((r for r in picked if r.mix_name == mix), key=lambda r: r.end_token)
        budget = next(iter(goal.values()))["budget_factor"] * whole
        supply = {s: sum(r.n_tokens for r in sized.values() if r.source == s) for s in goal}
        total = sum(r.n_tokens for r in mine)
        most = sum(supply[s] * goal[s]["max_repeats"] for s in goal)
        assert total <= budget and total >= min(budget, most) - 3 * max(r.n_tokens for r in sized.values())
        assert [r.finish_time for r in mine] == sorted(r.finish_time for r in mine)
        run = 0
        for r in mine:
            run += r.n_tokens
            assert r.end_token == run
        assert len({(r.doc_id, r.repeat_no) for r in mine}) == len(mine)
        for r in mine:
            assert r.source in goal and 1 <= r.repeat_no <= goal[r.source]["max_repeats"] and r.n_tokens == sized[r.doc_id].n_tokens
        # sources that did not run out stand at their relative weights
        got = {s: sum(r.n_tokens for r in mine if r.source == s) for s in goal}
        free = [s for s in goal if got[s] < supply[s] * goal[s]["max_repeats"]]
        rates = [got[s] / goal[s]["target_weight"] for s in free]
        biggest = max(r.n_tokens for r in sized.values())
        assert all(abs(a - b) <= biggest * (1 / goal[s]["target_weight"] + 1 / goal[t]["target_weight"]) for a, s in zip(rates, free) for b, t in zip(rates, free))
        report = {r.source: r for r in shares.collect() if r.mix_name == mix}
        assert all(report[s].n_tokens == got[s] for s in goal)


def test_mix_buckets_hold_equal_rows(spark, monkeypatch):
    """A small source of great weight finishes early, in few moments; its copies are spread all the same."""
    sizes = []
    whole = mixing.running_sum

    def watched(df, group, bucket, *more):
        sizes.append([r["count"] for r in df.groupBy(*group, bucket).count().collect()])
        return whole(df, group, bucket, *more)

    monkeypatch.setattr(mixing, "running_sum", watched)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("some words to count").alias("text"), F.when(F.col("id") < 300, "a").otherwise("b").alias("source"))
    t = "mix_name string, budget_factor double, source string, target_weight double, max_repeats int"
    chosen, _ = mixing.mix_sources(docs, spark.createDataFrame([("m", 1.2, "a", 90.0, 6), ("m", 1.2, "b", 1.0, 2)], t), rows_per_bucket=200)
    assert chosen.count() == 3600
    assert all(max(s) < 2 * 200 and len(s) > 5 for s in sizes)


def test_mix_edge_cases(spark):
    docs = spark.createDataFrame([(1, "a b c", " ArXiv"), (2, None, "arxiv"), (3, "", None), (4, "d", None), (4, "d", None)], "doc_id bigint, text string, source string").withColumn("n_tokens", F.lit(1))
    t = "mix_name string, budget_factor double, source string, target_weight double, max_repeats int"
    chosen, shares = mixing.mix_sources(docs, spark.createDataFrame([("m", 10.0, "arxiv", 1.0, 3), ("m", 10.0, "none", 1.0, 3), ("m", 10.0, "arxiv", 1.0, 3), ("z", 1.0, "arxiv", 0.0, 3)], t))
    assert sorted((r.doc_id, r.repeat_no) for r in chosen.collect()) == [(1, 1), (1, 2), (1, 3)]
    assert {(r.mix_name, r.source): r.n_tokens for r in shares.collect()} == {("m", "arxiv"): 9, ("m", "none"): 0, ("z", "arxiv"): 0}
    for d, q in ((docs.limit(0), [("m", 1.0, "arxiv", 1.0, 1)]), (docs, [])):
        assert mixing.mix_sources(d, spark.createDataFrame(q, t))[0].count() == 0


# --- 8


@pytest.mark.parametrize(
    ("label", "want"),
    [("en-US", "en"), ("German", "de"), ("français", "fr"), ("中文", "zh"), (" ES ", "es"), ("es-419", "es"), ("de_AT", "de"), ("mul", None), ("??", None), ("", None), (None, None), ("it", None)],
)
def test_labels(label, want):
    assert language.label_code(label) == want


@pytest.fixture(scope="module")
def model(spark, small):
    return language.train(spark.read.parquet(f"{small}/documents.parquet"))


def test_language_accuracy_held_out(spark, small):
    """Fitted on a half of the documents by hash; in the other half nearly all labels that name one language agree."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))
    # Copies of a text must not stand on both sides.
    texts = docs.filter(half == 0).select("text").distinct()
    held = docs.filter(half == 1).join(texts, "text", "left_anti")
    got = language.detect_languages(held, language.train(docs.filter(half == 0)))
    got = got.filter("size(languages) = 1 AND label_code IS NOT NULL").select("label_code", F.col("languages")[0]["lang"].alias("lang")).collect()
    assert sum(r.label_code == r.lang for r in got) >= 0.93 * len(got) and len(got) > 200


def test_unknown_languages(spark, model):
    """A language that no machine was fitted for is not forced into one; places count in the text as given."""
    en = "We first treat the case where the category is normal and then the general case of every scheme. "
    pl = "W tej pracy dowodzimy \u017ce ka\u017cdy w\u0142a\u015bciwy morfizm schemat\u00f3w zachowuje sp\u00f3jno\u015b\u0107 snop\u00f3w oraz badamy niekt\u00f3re konsekwencje tego twierdzenia. "
    ru = "\u0412 \u044d\u0442\u043e\u0439 \u0440\u0430\u0431\u043e\u0442\u0435 \u043c\u044b \u0434\u043e\u043a\u0430\u0437\u044b\u0432\u0430\u0435\u043c \u0447\u0442\u043e \u043c\u043e\u0440\u0444\u0438\u0437\u043c \u0441\u043e\u0445\u0440\u0430\u043d\u044f\u0435\u0442 \u043f\u0443\u0447\u043a\u0438. "
    data = [(1, pl * 2, None), (2, ru * 4, "en"), (3, "a &amp;&lt; b &eacute;t&eacute;. " + en * 2, None)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in language.detect_languages(df, model).collect()}
    assert [x.lang for x in got[1].languages] == [x.lang for x in got[2].languages] == ["und"]
    last = got[3].stretches[-1]
    assert last.lang == "en" and data[2][1][last.start : last.end].rstrip().endswith("scheme.")


def test_places():
    places = language.Places()
    text = "a &amp; b caf\u00c3\u00a9 c"
    clean = places.mend(places.mend(text, language._ENTITY, language._entity), language._MOJIBAKE, language._unbroken)
    assert clean == "a & b caf\u00e9 c"
    assert [text[places.original(i)] for i in (0, 4, 6, 11)] == ["a", "b", "c", "c"]
    assert places.original(len(clean)) == len(text)


def test_languages_are_a_parameter(spark, small):
    """Fitted for two languages only, Chinese is of no language."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    two = language.train(docs, families={"germanic": ["de", "en"]})
    assert two.languages == ["de", "en"]
    got = language.detect_languages(docs, two).selectExpr("explode(languages) AS l").select("l.lang").distinct().collect()
    assert {r.lang for r in got} >= {"de", "en", "und"}


def test_fit_uses_the_whole_sampled_text(spark, monkeypatch):
    """Not only the openings of documents and of their sentences."""
    seen = []
    monkeypatch.setattr(language.Model, "fit", lambda self, samples, vectors: seen.append(samples))
    text = " ".join(f"This is the sentence of number {chr(97 + i) * 5} in a row of them." for i in range(12)) + " And " + "so on and " * 40 + "finally."
    language.train(spark.createDataFrame([(1, text, "en")], "doc_id bigint, text string, lang string"), rounds=1)
    words = [w for t, _ in seen[0] for w in t]
    assert all(any(chr(97 + i) * 5 in w for w in words) for i in range(12)) and any("finally" in w for w in words)
    assert max(len(t) for t, _ in seen[0]) > 60


def test_languages_edge_cases(spark, model):
    en = "We first treat the case where the category is normal and then the general case of every scheme. "
    fr = "Il suffit de montrer que le module est projectif au voisinage de chaque point. "
    de = "Daraus folgt, dass der Halm durch das Ideal bis auf Isomorphie bestimmt wird. "
    zh = "由此推出,存在唯一的层使得概形成为凝聚的对象。证明的方法与平坦情形相同,只是用域代替层。但是如果概形不是有界的,这个结论一般并不成立。"
    cases = {
        1: (en * 3, "en", []),
        2: (en * 3, None, ["en"]),
        3: (en * 3 + fr * 3, "en", ["en", "fr"]),
        4: (en * 3 + fr, "en", []),
        5: (de.upper() * 3, "fr", ["de"]),
        6: (zh, "zh", []),
        7: (zh + " (c) 2024", "und", ["zh"]),
        8: (zh + en * 3, "zh", ["en", "zh"]),
        9: ("Cette propriété est vérifiée près de chaque point fermé du schéma considéré. ".encode().decode("latin-1") * 3, "de", ["fr"]),
        10: ("<p>" + de + "</p>", "en", ["de"]),  # few words, but the only language
        11: (en * 3 + "[3] Sur les faisceaux plats et leurs torseurs, 2003. " * 4, "en", []),
        12: (None, None, []),
        13: ("", "", []),
        14: ("$x^2 = 1$ 42 ----", None, []),
        15: (en * 3000, "xx", ["en"]),
    }
    data = [(k, t, c) for k, (t, c, _) in cases.items()]
    df = spark.createDataFrame([*data, data[1], (None, en, None)], "doc_id bigint, text string, lang string").withColumn("languages", F.lit(0))
    got = {}
    for r in language.mislabelled(language.detect_languages(df, model)).collect():
        got.setdefault(r.doc_id, []).append(r.lang_code)
        assert 0 < r.confidence <= 1
    for k, (_, _, want) in cases.items():
        assert sorted(got.get(k, [])) == want, k
    assert language.mislabelled(language.detect_languages(df.limit(0), model)).count() == 0
    spans = language.detect_languages(df.filter("doc_id = 3"), model).first().stretches
    assert [(s.lang, cases[3][0][s.start : s.start + 2]) for s in spans] == [("en", "We"), ("fr", "Il")]
