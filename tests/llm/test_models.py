"""Quality network, line rules, language mixtures: brute force and held-out rows."""

import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from odd_rows import no_docs, odd_docs  # noqa: F401
from flowsieve.llm import lang_mixture as L
from flowsieve.llm import quality_conv as Q
from flowsieve.llm.line_rules import LineConfig, line_quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def network(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, Q.fit_quality(docs, labels)


def brute_score(text: bytes, m: Q.ConvModel, cfg: Q.ConvConfig) -> float:
    n = max(1, -(-len(text) // cfg.hop)) * cfg.hop
    x = text + bytes(n + cfg.width - len(text))
    at = {p: sum(m.table[k, x[p + k]] for k in range(cfg.width)) for p in range(0, n - cfg.width + 1, cfg.stride)}
    begins = range(0, max(n - cfg.hop, 1), cfg.hop)
    chunks = [np.maximum(np.max([v for p, v in at.items() if b <= p < b + 2 * cfg.hop], axis=0) + m.bias, 0) for b in begins]
    z = np.concatenate((np.mean(chunks, axis=0), np.max(chunks, axis=0))) @ m.out + m.out_bias[0]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def test_scores_match_a_plain_network(network):
    docs, _, model = network
    cfg = Q.ConvConfig()
    texts = [(r.text or "").encode() for r in docs.orderBy("doc_id").limit(30).collect()] + [b"", b"x", b"y" * 128, b"z" * 129]
    offs = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    got = Q.score_bytes(np.frombuffer(b"".join(texts), dtype=np.uint8), offs, model, cfg)
    assert np.allclose(got, [brute_score(t, model, cfg) for t in texts], atol=1e-4)


def test_gradients_match_differences():
    cfg = Q.ConvConfig(filters=3, width=3, hop=8)
    rng = np.random.default_rng(1)
    texts = [b"hello world, this is it", b"ab", b"!!$$ !!$$ %%", b"q" * 40]
    label = np.array([1.0, 0.0, 0.0, 1.0])
    model = Q.train([b"a", b"b"], np.array([0.0, 1.0]), Q.ConvConfig(filters=3, width=3, hop=8, epochs=0))
    for w in model.weights():
        w += rng.normal(0, 0.3, w.shape).astype(np.float32)
    model.table[:, 0] = 0
    offs = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    x, first = Q._padded(data, offs, cfg)

    def loss():
        p = Q.score_bytes(data, offs, model, cfg)
        return -np.mean(label * np.log(p) + (1 - label) * np.log(1 - p))
    grads = Q._gradients(x, first, label, model, cfg)
    for w, g in zip(model.weights(), grads):
        flat, want = w.reshape(-1), np.asarray(g).reshape(-1)
        for i in sorted(range(len(flat)), key=lambda i: -abs(want[i]))[:8]:
            old = flat[i]
            flat[i] = old + 1e-3
            up = loss()
            flat[i] = old - 1e-3
            down = loss()
            flat[i] = old
            assert (up - down) / 2e-3 == pytest.approx(want[i], abs=2e-3)


def test_held_out_quality(network):
    docs, labels, model = network
    got = Q.score_quality(docs, model).join(labels, "doc_id").where("held_out").select("predicted", "quality").collect()
    assert len(got) > 50
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95
    assert np.mean([r.predicted for r in got if r.quality == 1]) > 0.98


def test_training_reads_no_held_out_label(spark, network):
    docs, labels, model = network
    turned = labels.withColumn("quality", Q.F.when(Q.held_out(), 1 - Q.F.col("quality")).otherwise(Q.F.col("quality")))
    again = Q.fit_quality(docs, turned)
    assert all(np.array_equal(a, b) for a, b in zip(model.weights(), again.weights()))


def test_quality_of_odd_rows(spark, network, odd_docs, no_docs):
    model = network[2]
    got = Q.score_quality(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert Q.score_quality(no_docs, model).count() == 0
    kept = Q.keep_quality(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r.predicted for r in got)
    none = Q.fit_quality(no_docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in Q.score_quality(odd_docs, none).collect()} == {0.5}


def brute_lines(rows, cfg):
    """rows: (key, host, text) -> the counts and verdict of each."""
    ws = r"[\x20\x09-\x0D]+"
    out, docs_of, host_docs, lines_of = {}, defaultdict(set), defaultdict(set), {}
    for key, host, text in rows:
        t = text or ""
        words = [w for w in re.split(ws, t) if w]
        grams = Counter(zip(words, words[1:], words[2:]))
        cover = {i + j for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.sub(ws, "", x)]
        norm = Counter()
        for x in lines:
            w = [y for y in re.split(ws, x) if y]
            norm[b" ".join(y.encode().lower() for y in w)] += len(w)
        out[key] = [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)]
        lines_of[key] = norm
        host_docs[host].add(t)
        for x in norm:
            docs_of[host, x].add(t)
    for key, host, _ in rows:
        n, *_, rep = out[key]
        gone = sum(c for x, c in lines_of[key].items() if len(docs_of[host, x]) > cfg.most_docs
                   or len(docs_of[host, x]) >= cfg.min_docs and len(docs_of[host, x]) * 100 > len(host_docs[host]) * cfg.host_percent)
        bad = n < cfg.min_words or 100 * rep > cfg.repeat_percent * n
        out[key] += [bad, not bad and 100 * (n - gone) >= cfg.left_percent * n, gone]
    return out


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


@pytest.mark.parametrize("cfg", [LineConfig(), LineConfig(min_words=5, min_docs=2, host_percent=1, left_percent=60),
                                 LineConfig(most_docs=1, left_percent=90)])
def test_line_rules(spark, cfg):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = brute_lines([(r.doc_id, r.source, r.text) for r in docs.collect()], cfg)
    got = {r.doc_id: [r[f] for f in FIELDS] for r in line_quality(docs, cfg).collect()}
    assert got == want
    assert len({w[6] for w in want.values()}) == 2


def test_depleted_documents_are_rejected(spark):
    common = "this very same line stands in all of the documents of the host " * 6
    rows = [(i, f"{common}\n" + " ".join(f"own{i}x{j}" for j in range(20 if i < 12 else 90))) for i in range(24)]
    docs = spark.createDataFrame([(i, t, "h") for i, t in rows], "doc_id long, text string, source string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in line_quality(docs, LineConfig(repeat_percent=100)).collect()}
    assert got == {i: (False, i >= 12) for i in range(24)}


@pytest.mark.parametrize("n", [300, 3000])
def test_a_passage_is_boilerplate_on_a_host_of_any_size(spark, n):
    """101 documents of a host share a passage, at 34 % and at 3 % of the host;
    exact copies of a text are one document."""
    passage = " ".join(f"p{j}" for j in range(70))
    own = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(59)), lambda j: F.concat(F.lit("w"), F.col("id"), F.lit("x"), j)), " ")
    few = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda j: F.concat(F.lit("v"), F.col("id"), F.lit("x"), j)), " ")
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("h").alias("source"), F.when(
        F.col("id") < 101, F.concat(F.lit(passage + "\n"), few)).when(F.col("id") < 250, F.lit(" ".join(f"c{j}" for j in range(60)))).otherwise(own).alias("text"))
    got = {r.doc_id: (r.kept, r.removed_words) for r in line_quality(docs).collect()}
    assert got == {i: (False, 70) if i < 101 else (True, 0) for i in range(n)}


def test_line_rules_of_odd_rows(spark, odd_docs, no_docs):
    got = line_quality(odd_docs).collect()
    want = brute_lines([(i, r.source, r.text) for i, r in enumerate(odd_docs.collect())], LineConfig())
    assert sorted([r.doc_id is None, r.doc_id or 0, *[r[f] for f in FIELDS]] for r in got) == sorted(
        [r.doc_id is None, r.doc_id or 0, *want[i]] for i, r in enumerate(odd_docs.collect()))
    assert line_quality(no_docs).count() == 0


@pytest.fixture(scope="module")
def languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, L.fit_languages(docs)


def test_trigram_model_counts_all_training_rows(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    cfg = L.LangConfig(bits=15)
    counts = defaultdict(Counter)
    for r in docs.collect():
        if zlib.crc32(str(r.doc_id).encode()) % 5 and r.lang is not None:
            for w in re.findall(rb"[A-Za-z\x80-\xff]+", r.text.encode()):
                w = b"\0" + w.lower() + b"\0"
                for a, b, c in zip(w, w[1:], w[2:]):
                    counts[r.lang][((a << 16 | b << 8 | c) * 0x9E3779B1 % 2 ** 32) >> 17] += 1
    model = L.fit_languages(docs, cfg)
    assert model.languages == sorted(counts)
    for i, lang in enumerate(model.languages):
        n = np.full(1 << 15, cfg.smoothing)
        for b, c in counts[lang].items():
            n[b] += c
        assert np.allclose(model.log_p[:, i], np.log(n / n.sum()), atol=1e-5)


def test_held_out_languages(languages):
    docs, model = languages
    got = L.predict_languages(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100 and np.mean([r.lang_pred == r.lang for r in got]) > 0.99


def test_mixed_documents_get_both_languages(spark, languages):
    docs, model = languages
    long = {r.lang: r.text for r in docs.where("n_chars between 2500 and 3500").collect()}
    rows = [(0, long["en"] + "\n" + long["de"][:1200]), (1, long["fr"][:1000] + " " + long["es"]), (2, long["de"])]
    got = {r.doc_id: r for r in L.predict_languages(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[0].languages == ["en", "de"] and got[1].languages == ["es", "fr"] and got[2].languages == ["de"]
    assert [got[i].lang_pred for i in range(3)] == ["en", "es", "de"]


def test_em_reaches_the_likeliest_proportions():
    rng = np.random.default_rng(2)
    ll = np.log(rng.dirichlet([1, 1], 400)).astype(np.float32)
    pi, value, gain = L.fit_proportions(np.exp(ll).astype(float), np.array([0]), np.full((1, 2), 0.5), 1e-6)
    assert 0 <= gain[0] <= 1e-6
    grid = [(np.log(np.exp(ll) @ [p, 1 - p]).sum(), p) for p in np.linspace(0.001, 0.999, 999)]
    assert pi[0, 0] == pytest.approx(max(grid)[1], abs=0.01) and value[0] == pytest.approx(max(grid)[0], abs=0.05)


def best_set(ll, cfg):
    """All sets, each fitted to the end."""
    p, cost, out = np.exp(ll), cfg.penalty * np.log(max(len(ll), 2)), []
    for size in range(1, ll.shape[1] + 1):
        for s in itertools.combinations(range(ll.shape[1]), size):
            pi = np.full(size, 1 / size)
            for _ in range(3000):
                pi = (p[:, s] * pi / (p[:, s] @ pi)[:, None]).mean(axis=0)
            out.append((np.log(p[:, s] @ pi).sum() - (size - 1) * cost, s))
    return max(out)


@pytest.mark.parametrize("k", [2, 4, 6])
def test_language_sets_equal_a_search_of_all_sets(k):
    """Words of languages that overlap, in shares from none to all."""
    rng = np.random.default_rng(k)
    cfg, rows = L.LangConfig(), []
    for trial in range(14):
        models = rng.dirichlet(np.full(30, [0.2, 1.0][trial % 2]), k)
        true = rng.permutation(k)[:1 + trial % k]
        share = rng.dirichlet(np.full(len(true), 3.0))
        words = rng.choice(30, size=int(rng.choice([3, 40, 400])), p=share @ models[true])
        rows.append(np.log(models[:, words].T + 1e-9))
    begin = np.concatenate(([0], np.cumsum([len(r) for r in rows])[:-1]))
    pi, score = L.mixtures(np.concatenate(rows), begin, cfg)
    sizes = set()
    for r, found in zip(rows, pi):
        value, s = best_set(r, cfg)
        mine = np.log(np.exp(r) @ found).sum() - ((found > 0).sum() - 1) * cfg.penalty * np.log(max(len(r), 2))
        assert mine >= value - cfg.tolerance and (found > 0).sum() == len(s)
        sizes.add(len(s))
    assert len(sizes) >= min(k, 3) and (score > 0).all() and (score <= 1 + 1e-9).all()


def test_two_true_languages_among_many_similar_ones():
    rng = np.random.default_rng(4)
    shared = rng.dirichlet(np.full(60, 1.0))
    models = 0.7 * shared + 0.3 * rng.dirichlet(np.full(60, 0.3), 40)
    words = np.concatenate([rng.choice(60, 400, p=models[3]), rng.choice(60, 400, p=models[17])])
    pi, _ = L.mixtures(np.log(models[:, words].T), np.array([0]), L.LangConfig())
    assert list(np.flatnonzero(pi[0])) == [3, 17]


def test_a_text_in_every_learned_language(spark, languages):
    docs, model = languages
    long = {r.lang: r.text for r in docs.where("n_chars between 2500 and 3500").collect()}
    everything = "\n".join(long[x] for x in model.languages)
    got = L.predict_languages(spark.createDataFrame([(1, everything)], "doc_id long, text string"), model).first()
    assert sorted(got.languages) == model.languages


def test_languages_of_odd_rows(spark, languages, odd_docs, no_docs):
    model = languages[1]
    got = L.predict_languages(odd_docs, model).collect()
    assert len(got) == odd_docs.count()
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (0, 1, 2, 10))
    assert by_id[4].lang_pred in model.languages and by_id[9].lang_pred in model.languages
    assert all(0 <= r.score <= 1 for r in got)
    assert L.predict_languages(no_docs, model).count() == 0
    empty = L.fit_languages(no_docs)
    assert {r.lang_pred for r in L.predict_languages(odd_docs, empty).collect()} == {"und"}
    dashes = spark.createDataFrame([(1, "— … “”"), (2, "日本")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in L.predict_languages(dashes, model).orderBy("doc_id").collect()] == [True, False]
