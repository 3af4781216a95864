"""WARC round trips, the Merkle manifest and whitening against plain versions."""

import glob
import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from odd_rows import no_docs, odd_docs  # noqa: F401
from flowsieve.llm import merkle_midstate as MM, warc_members as WM, whitening as WH
from flowsieve.llm.hot_keys import look_up


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_text(rows):
    return sorted(rows, key=lambda r: tuple(str(v) for v in r))


# --- joins of hot keys ------------------------------------------------------

def test_look_up_of_hot_cold_null_and_unknown_keys(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id")).alias("k"))
    table = spark.range(2500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = look_up(rows, table, "k", share=10)
    assert by_text(got.collect()) == by_text(rows.join(table, "k", "left").collect())


# --- WARC -------------------------------------------------------------------

ODD_HTML = [None, "", "a\r\n\r\nb", "\r\n\r\r\n\r\n", "q" * 120 + "\r\n", "\r\r\n\r\n\r", "WARC/1.1\r\n\r\n" * 20, "x" * 99,
            "x" * 99, "x" * 100, "x" * 100, "\x00\x1f ü😀" * 30, "é" * 50, "é" * 50, "long " * 200_000, "\n" * 150, "\r" * 150, "\r\n" * 100]


def odd_pages(spark):
    rows = [(100 + i, "http://a/ b", h) for i, h in enumerate(ODD_HTML)]
    rows += [(None, "u\r\nInjected: y", "x" * 100), (None, None, "z" * 100), (None, None, "z" * 100), (7, None, "y" * 100),
             (7, None, "y" * 100), (8, None, "y" * 100), (7, None, "w" * 100)]
    rows += [(1000 + i, "hot", "h" * 200) for i in range(200)]
    rows = [(*r, "clash", i) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, record string, digest int").repartition(5)


def plain_warc(rows):
    first = {}
    for r in rows:
        if r.page_id is not None:
            first[r.html or ""] = min(first.get(r.html or "", r.page_id), r.page_id)
    out = []
    for r in rows:
        body = (r.html or "").encode()
        m = first.get(r.html or "")
        again = len(body) >= 100 and m is not None and r.page_id != m
        out.append((r.page_id, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", m if again else None))
    return by_text(out)


@pytest.mark.parametrize("per_file", [3, 2000])
def test_warc_of_odd_pages(spark, per_file, tmp_path):
    pages = odd_pages(spark)
    got = WM.archive_report(pages, WM.WarcConfig(records_per_file=per_file, batch_bytes=500), str(tmp_path), keep_raw=True)
    assert by_text(map(tuple, got.collect())) == plain_warc(pages.collect())
    # the archives are what any gzip reader inflates, a member a record
    total = 0
    for path in glob.glob(f"{tmp_path}/normalised/kind=archives/*/part-*"):
        data, records = open(path, "rb").read(), 0
        whole, rest = b"", data
        while rest:
            d = zlib.decompressobj(31)
            one = d.decompress(rest)
            records += bool(one)
            assert not one or (one.startswith(b"WARC/1.1\r\n") and one.endswith(b"\r\n\r\n"))
            whole, rest = whole + one, d.unused_data
        assert gzip.decompress(data) == whole and records <= per_file
        index, = glob.glob(path.rsplit("/", 1)[0].replace("kind=archives", "kind=index") + "/part-*")
        entries = WM.index_entries(open(index, "rb").read())
        assert len(entries) == records
        assert b"".join(WM.inflate_member(data, e["position"], e["length"]) for e in entries) == whole
        total += records
    assert total == pages.count()
    raw = b"".join(gzip.open(p).read() for p in glob.glob(f"{tmp_path}/raw/*.gz"))
    assert b"\r\nInjected" not in raw


def test_payloads_come_back_whole(spark, tmp_path):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    WM.write_archives(pages, f"{tmp_path}/raw")
    WM.normalise(spark, f"{tmp_path}/raw", f"{tmp_path}/out")
    got = {r.page_id: (r.target_uri, bytes(r.payload)) for r in WM.read_archives(spark, f"{tmp_path}/out").collect()}
    assert got == {r.page_id: (r.url, r.html.encode()) for r in pages.collect()}


def test_no_pages(spark, tmp_path):
    assert WM.archive_report(odd_pages(spark).limit(0), folder=str(tmp_path)).count() == 0


def test_a_parser_fed_in_any_pieces():
    rng = random.Random(5)
    blocks = [bytes(rng.choice(b"\r\nab") for _ in range(rng.randrange(60))) for _ in range(80)]
    stream = b"".join(b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in blocks)
    for size in (1, 3, 7, 50, 10 ** 6):
        parser, got = WM.RecordParser(), []
        for i in range(0, len(stream), size):
            got += [rec for _, rec in parser.feed(stream[i:i + size])]
        parser.close()
        assert [r[r.index(b"\r\n\r\n") + 4:-4] for r in got] == blocks and b"".join(got) == stream


@pytest.mark.parametrize("broken", [b"HTTP/1.1 200 OK\r\n\r\n", b"WARC/1.1\r\nX: y\r\n\r\n", b"WARC/1.1\r\nContent-Length: 1\r\n\r\nabcdefgh"])
def test_broken_streams_are_told(broken):
    with pytest.raises(ValueError):
        list(WM.RecordParser().feed(broken))
    parser = WM.RecordParser()
    list(parser.feed(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"))
    with pytest.raises(ValueError):
        parser.close()


# --- Merkle -----------------------------------------------------------------

def plain_manifest(rows, arity=8):
    """Trees rebuilt from scratch for every row."""
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, low=False):
        text = r.text.translate(str.maketrans(MM.UPPER, MM.LOWER)) if low and r.text is not None else r.text
        return sha("".join(field(v) for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i:i + arity])) for i in range(0, len(out[-1]), arity)])
        return out
    trees = {}
    for r in rows:
        trees.setdefault(r.lang, []).append(r)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for k in names:
        trees[k].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
    own = {k: levels([leaf(r) for r in trees[k]]) for k in names}
    top = levels([own[k][-1][0] for k in names])
    out = []
    for t, k in enumerate(names):
        for i, r in enumerate(trees[k]):
            changed = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
            now, proof = leaf(r, changed), []
            for tree, at in ((own[k], i), (top, t)):
                for level in tree[:-1]:
                    a = at // arity * arity
                    run = level[a:a + arity]
                    proof += run[:at - a] + run[at - a + 1:]
                    now = sha("".join(run[:at - a] + [now] + run[at - a + 1:]))
                    at //= arity
            root = top[-1][0]
            out.append((r.doc_id, leaf(r), own[k][-1][0], root, sha("".join(proof)), now, now == root))
    return by_text(out)


@pytest.mark.parametrize("arity,depth", [(8, 4), (8, 1), (2, 2), (3, 1)])
def test_manifest_of_the_small_table(spark, arity, depth):
    """Chunks of 4 and 3 nodes need several storeys."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = MM.manifest(docs, MM.tampered_leaf(), MM.MerkleConfig(arity=arity, depth=depth))
    assert by_text(map(tuple, got.collect())) == plain_manifest(docs.collect(), arity)


def test_manifest_of_odd_rows_and_many_groups(spark, odd_docs, no_docs):
    got = MM.manifest(odd_docs, MM.tampered_leaf())
    rows = got.collect()
    assert by_text(map(tuple, rows)) == plain_manifest(odd_docs.collect())
    assert MM.manifest(no_docs, MM.tampered_leaf()).count() == 0
    one = odd_docs.where("doc_id = 4")
    assert by_text(map(tuple, MM.manifest(one, MM.tampered_leaf()).collect())) == plain_manifest(one.collect())
    groups = spark.range(70).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.concat(F.lit("é"), F.col("id") % 41)
                                    .alias("lang"), F.lit(1).cast("long").alias("n_chars"), F.lit("A b").alias("text"))
    cfg = MM.MerkleConfig(arity=8, depth=1)
    rows = MM.manifest(groups, MM.tampered_leaf(cfg), cfg).collect()
    assert by_text(map(tuple, rows)) == plain_manifest(groups.collect()) and {r.verified for r in rows} == {True, False}


def test_a_fold_resumes_behind_the_left_siblings():
    nodes = [sha(str(i)) for i in range(11)]
    parents = MM.Parents(nodes, 8)
    for i in range(11):
        run = nodes[i // 8 * 8:i // 8 * 8 + 8]
        changed = [sha("new") if x == nodes[i] else x for x in run]
        assert parents.fold(i, sha("new")) == sha("".join(changed))
        assert parents.fold(i, nodes[i]) == parents.digests[i // 8]  # the retained state is not used up


# --- whitening --------------------------------------------------------------

def random_symmetric(rng, values):
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    return (q * values) @ q.T


SPECTRA = [np.linspace(1, 50, 40), np.array([5.0] * 6 + [1.0] * 6), np.array([1e9, 1e3, 1.0, 1e-3, 0, 0]), np.ones(9),
           np.concatenate((np.full(5, 3.0) + np.arange(5) * 1e-9, np.linspace(0, 1, 30))), np.array([2.0]), np.array([4.0, 4.0]),
           np.zeros(5)]


@pytest.mark.parametrize("values", SPECTRA, ids=range(len(SPECTRA)))
def test_leading_eigen_of_known_spectra(values):
    a = random_symmetric(np.random.default_rng(1), values)
    k = min(32, len(values))
    got, vectors = WH.leading_eigen(a, k)
    size = max(values.max(), 1e-300)
    assert np.abs(got - np.sort(values)[::-1][:k]).max() <= 1e-13 * size * len(values)
    assert np.abs(vectors @ vectors.T - np.eye(k)).max() < 1e-12
    assert np.abs(vectors @ a - got[:, None] * vectors).max() <= 1e-12 * size * len(values)


def test_leading_eigen_of_diagonal_and_block_matrices():
    for a in (np.diag([3.0, 1.0, 2.0]), np.kron(np.eye(4), np.array([[2.0, 1.0], [1.0, 2.0]])), np.eye(6)):
        got, vectors = WH.leading_eigen(a, len(a))
        assert np.allclose(got, np.sort(np.linalg.eigvalsh(a))[::-1], atol=1e-14)
        assert np.allclose(vectors @ a, got[:, None] * vectors, atol=1e-13) and np.allclose(vectors @ vectors.T, np.eye(len(a)), atol=1e-13)


def test_sturm_counts():
    rng = np.random.default_rng(2)
    d, e = rng.standard_normal(20), rng.standard_normal(19)
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    shifts = np.linspace(-4, 4, 50)
    assert list(WH.sturm_count(d, e * e, shifts, 1e-300)) == [int((values < s).sum()) for s in shifts]


def check_whitening(frame, vectors, scale=64, shift=1_000_000, k=32):
    """vectors: {id: list} of the usable rows."""
    x = np.array([[int(np.floor(scale * c)) + shift for c in v] for v in vectors.values()], dtype=object)
    n, s = len(x), x.sum(axis=0)
    exact = n * x - s
    y = (exact / n).astype(float)
    cov = y.T @ y / n
    values, comps = np.linalg.eigh(cov)
    values, comps = values[::-1][:k], comps[:, ::-1][:, :k]
    far = {i: int(v) for i, v in zip(vectors, (exact * exact).sum(axis=1))}
    rows = frame.collect()
    kept = max(r.component for r in rows)
    assert kept == int((values > 1e-12 * np.trace(cov)).sum()) and len(rows) == n * kept
    want = dict(zip(vectors, y @ comps / np.sqrt(np.maximum(values, 1e-300))))
    got = {}
    for r in rows:
        assert r.n == n and int(r.deviation) == far[r.vec_id] and r.identity_error < 1e-6
        assert abs(r.explained - values[r.component - 1] / np.trace(cov)) < 1e-9
        got.setdefault(r.vec_id, {})[r.component] = r.whitened
    for c in range(1, kept + 1):
        a, b = np.array([got[i][c] for i in vectors]), np.array([want[i][c - 1] for i in vectors])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6


def test_whitening_of_the_small_table(spark):
    table = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    check_whitening(WH.whiten(table), {r.vec_id: r.embedding for r in table.collect()})


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = {i: [float(np.float32(v)) for v in rng.standard_normal(4) * [9, 4, 2, 1]] for i in range(50)}
    bad = [None, [], [1.0, None, 2.0, 3.0], [float("nan")] * 4, [1.0, float("inf"), 0.0, 0.0], [1.0, 2.0]]
    rows = [(i, v, 1, "c") for i, v in good.items()] + [(900 + i, v, 2, None) for i, v in enumerate(bad)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int, component string").repartition(4)
    check_whitening(WH.whiten(table), good)
    assert WH.whiten(table.limit(0)).count() == 0
    assert WH.whiten(table.where("vec_id >= 900 and vec_id < 905")).count() == 0
    assert WH.whiten(table.where("vec_id < 1")).count() == 0  # one vector varies in nothing
    twice = WH.whiten(table.unionByName(table.where("vec_id < 3"))).where("vec_id < 3").collect()
    assert len(twice) == 2 * 3 * 4 and {r.n for r in twice} == {53}


def test_huge_entries_stay_exact(spark):
    good = {0: [1e30, 2.0, 1.0], 1: [-3e17, 5.0, 2.0], 2: [2e30, 2.0, 7.0], 3: [1.5e30, 9.0, 1.0]}
    table = spark.createDataFrame(list(good.items()), "vec_id long, embedding array<double>")
    cfg = WH.WhiteningConfig(scale=1, shift=0)
    rows = [[int(v) for v in x] for x in good.values()]
    x = np.array(rows, dtype=object)
    assert WH._squares(WH._n_times_less(x, 4, list(x.sum(axis=0)))) == [int(v) for v in ((4 * x - x.sum(axis=0)) ** 2).sum(axis=1)]
    small = np.array([[2 ** 40, 3], [2 ** 41, 5]])
    assert WH._squares(WH._n_times_less(small, 2, [2 ** 40 + 2 ** 41, 8])) == [2 ** 80 + 4, 2 ** 80 + 4]
    assert WH.valid_vectors(table, "vec_id", "embedding").count() == 4 and cfg.scale == 1


def test_whitening_is_the_same_in_other_partitions(spark):
    table = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    a, b = (WH.whiten(table.repartition(p)).toPandas().set_index(["vec_id", "component"]).sort_index() for p in (1, 7))
    assert (a.deviation == b.deviation).all() and np.allclose(a.whitened.abs(), b.whitened.abs(), atol=1e-8)
