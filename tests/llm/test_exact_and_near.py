"""Exact and near duplicates against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from odd_rows import no_docs, odd_docs  # noqa: F401
from flowsieve.llm import components, minhash_tensor as M
from flowsieve.llm.components import connected_components
from flowsieve.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from flowsieve.llm.minhash_tensor import NearDupConfig, drop_near_duplicates, near_duplicates


def brute_near(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        sets[i] = s
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(i for i in sets if i is not None and sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets if i is not None}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect() if r.doc_id is not None}


def mutated(rng, base, n):
    words = base.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"m{rng.randrange(10 ** 6)}"
    return " ".join(words)


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_of_the_small_table(spark, k):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(near_duplicates(docs, NearDupConfig(shingle=k))) == brute_near(rows, k)


def test_large_buckets_lose_no_link(spark):
    """Families whose members are close to some and not to others, all in the
    same buckets, compared in blocks far smaller than a bucket."""
    rng = random.Random(3)
    rows = []
    for family in range(3):
        base = " ".join(f"f{family}w{rng.randrange(5000)}" for _ in range(120))
        rows += [mutated(rng, base, rng.choice([1, 2, 3, 4, 5, 6])) for _ in range(60)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cfg = NearDupConfig(shingle=4, block=16)
    want = brute_near(rows, 4)
    assert len({c for _, c in want.values()}) > 3
    assert result(near_duplicates(docs, cfg)) == want


def test_near_duplicates_of_odd_rows(spark, odd_docs, no_docs):
    got = near_duplicates(odd_docs, NearDupConfig(shingle=4))
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert result(got) == brute_near([r for r in rows if r[0] is not None], 4)
    assert got.count() == len(rows)
    null = got.where("doc_id is null").first()
    assert null.component_id is None and null.kept
    assert near_duplicates(no_docs).count() == 0
    kept = drop_near_duplicates(odd_docs, NearDupConfig(shingle=4))
    assert kept.columns == odd_docs.columns
    assert {0, 1, 2, 3, 4} <= {r.doc_id for r in kept.collect()} and 5 not in {r.doc_id for r in kept.collect()}


def test_tensored_banding_needs_few_minhashes():
    cfg = NearDupConfig()
    tables = cfg.bands * (cfg.bands - 1) // 2
    assert (cfg.hashes, tables * 2 * cfg.rows) == (60, 1140)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (None, 3)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r.node: r.root for r in got} == {i: 0 for i in range(1, 41)} | {x: 100 for x in range(101, 160)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_components_of_random_graphs_hubs_and_repeated_edges(spark):
    rng = random.Random(11)
    edges = [(rng.randrange(900), rng.randrange(900)) for _ in range(700)]
    # hubs that are the least, the largest and a middle node of their component, and a path through all of them
    edges += [(1000, x) for x in range(1001, 1600)] + [(9000, x) for x in range(2000, 2600)] + [(3300, x) for x in range(3000, 3600)]
    edges += [(1500, 9000), (2500, 3300), (3599, 4000)] + [(x, x + 1) for x in range(4000, 4050)]
    edges += edges[:50] + [(y, x) for x, y in edges[50:90]]
    assert len(edges) * 2 < 1000 * components.HUB and 599 > components.HUB
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for x, y in edges:
        x, y = sorted((find(x), find(y)))
        parent[y] = x
    got = connected_components(spark.createDataFrame(edges, "a long, b long").repartition(3), "a", "b").collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.root for r in got} == {x: find(x) for x in parent if find(x) != x}


def jobs_of(spark, name, action):
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    try:
        out = action()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
    return out, len(sc.statusTracker().getJobIdsForGroup(name))


def test_settled_components_take_no_round(spark):
    """The driver's memory follows the jobs, each with as many tasks as the session shuffles into."""
    stars = spark.createDataFrame([(i % 7, i) for i in range(7, 300)], "a long, b long")
    got, jobs = jobs_of(spark, "settled", lambda: {r.node: r.root for r in connected_components(stars, "a", "b").collect()})
    assert got == {i: i % 7 for i in range(7, 300)} and 0 < jobs <= 8
    joined = stars.unionByName(spark.createDataFrame([(10, 11), (298, 13)], "a long, b long"))
    got, jobs = jobs_of(spark, "joined", lambda: {r.node: r.root for r in connected_components(joined, "a", "b").collect()})
    low = {i: 3 if i in (3, 4, 6) else i for i in range(7)}
    assert got == {i: low[i % 7] for i in range(7, 300)} | {4: 3, 6: 3} and jobs <= 50


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for ids in groups.values():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        first = True
        for i in sorted(ids, key=lambda x: (x is None, x)):
            out.append((i, keep, len(ids), i == keep and first))
            first = first and i != keep
    return sorted(out, key=str)


def exact(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect()), key=str)


def test_exact_duplicates_of_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert exact(exact_duplicates(odd_docs)) == brute_exact(rows)
    assert exact_duplicates(no_docs).count() == 0
    kept = drop_exact_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in brute_exact(rows) if r[3])
    names = ["__sha", "__id", "sha", "row", "digest", "text_sha256", "body", "salt", "keep_id"]
    clash = drop_exact_duplicates(odd_docs.select("doc_id", "text", *[F.lit(c).alias(c) for c in names]))
    assert clash.columns == ["doc_id", "text", *names] and clash.count() == kept.count()
    assert all([r[c] for c in names] == names for r in clash.collect())


@pytest.mark.parametrize("salts", [1, 16])
def test_a_weak_digest_changes_nothing(spark, odd_docs, salts):
    """Full content is compared wherever digests agree."""
    weak = exact_duplicates(odd_docs, salts, digest=lambda body: (F.length(body) % 2).cast("string"))
    assert exact(weak) == exact(exact_duplicates(odd_docs))


def test_a_hot_text_is_spread_over_salts(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot  text").otherwise(
        F.concat(F.lit("t"), F.col("id"))).alias("text"))
    got = exact_duplicates(docs)
    assert got.where("kept").count() == 2001 and got.where("group_size = 1000 and keep_id = 0").count() == 1000


def test_rerun_agrees(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert exact(exact_duplicates(docs)) == exact(exact_duplicates(docs.repartition(7)))
    assert result(near_duplicates(docs)) == result(M.near_duplicates(docs.repartition(7)))


def test_near_duplicates_of_every_text_of_an_id(spark):
    def prose(tag, changed=None):
        words = [f"{tag}{j}" for j in range(120)]
        if changed is not None:
            words[changed] = "other"
        return " ".join(words)

    rows = [(2, prose("b")), (1, prose("c")), (9, prose("d"))]
    for i in range(6):  # ids with two texts, each a near copy of another id's; and with no text
        rows += [(100 + i, prose(f"x{i}")), (100 + i, prose(f"y{i}")), (100 + i, None),
                 (200 + i, prose(f"x{i}", 3)), (300 + i, prose(f"y{i}", 119)), (400 + i, None)]
    rows += [(7, prose("b")), (7, prose("e")), (8, prose("e"))]  # 8 reaches 2 by way of 7
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, NearDupConfig()).collect()}
    want = {1: 1, 2: 2, 9: 9, 7: 2, 8: 2}
    for i in range(6):
        want |= {100 + i: 100 + i, 200 + i: 100 + i, 300 + i: 100 + i, 400 + i: 400 + i}
    assert got == want


def family(rng, n, words, edits, tag):
    """Copies of one text, each with its own words in random places."""
    base = [f"{tag}{j}" for j in range(words)]
    out = []
    for i in range(n):
        text = list(base)
        for at in rng.sample(range(words), rng.choice(edits)):
            text[at] = f"{tag}x{rng.randrange(40)}" if rng.random() < 0.3 else f"{tag}y{i}z{at}"
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("percent", [70, 80, 90])
def test_families_beyond_a_block(spark, percent):
    """Members near and far from the centre of their family, whose links
    run through few of the pairs."""
    rng = random.Random(percent)
    texts = family(rng, 90, 60, [1, 2, 3], "a") + family(rng, 90, 60, [2, 3, 4], "b") + family(rng, 60, 40, [1, 2], "c")
    texts += [t + " " + " ".join(f"own{i}t{j}" for j in range(14)) for i, t in enumerate(family(rng, 60, 60, [0], "d"))]
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(5, texts[7]), (11, texts[100] + " more")]  # ids with two texts
    docs = spark.createDataFrame([r for r in rows[:len(texts)]], "doc_id long, text string")
    cfg = NearDupConfig(shingle=4, percent=percent, block=8)
    assert result(near_duplicates(docs, cfg)) == brute_near(rows[:len(texts)], 4, percent)


def test_a_large_group_below_the_threshold_is_not_compared_in_pairs(spark, monkeypatch):
    """Texts that share 87 % of their words with all others, so that each pair's
    similarity is 0.76: every pair meets in tables, none is a link."""
    n = 20_000
    template = " ".join(f"t{j}" for j in range(104))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit(template + " "), F.array_join(F.transform(
        F.sequence(F.lit(0), F.lit(15)), lambda j: F.concat(F.lit("o"), F.col("id"), F.lit("q"), j)), " ")).alias("text"))
    seen = []
    plain = M._deviating

    def counted(placed, cfg):
        cells, links = plain(placed, cfg)
        seen.append((placed.count(), cells.count(), links.count()))
        return cells, links
    monkeypatch.setattr(M, "_deviating", counted)
    got = near_duplicates(docs, NearDupConfig())
    assert got.where("component_id = doc_id and kept").count() == n
    assert not seen or seen[0][1:] == (0, 0)


def test_rows_without_an_id_are_compared_when_dropped(spark):
    text = " ".join(f"w{j}" for j in range(100))
    rows = [(None, text + " a"), (None, text), (3, text + " b"), (None, None), (None, "other words"), (4, None)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, at long")
    assert sorted(r["at"] for r in drop_near_duplicates(docs).collect()) == [2, 3, 4, 5]
