"""Mixing totals and packing round trips."""

import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SF_SMALL
from odd_rows import no_docs, odd_docs  # noqa: F401
from flowsieve.llm.mixing import MixConfig, mix_report, mixed_documents, permuted, plan_mix
from flowsieve.llm.packing_dp import PackConfig, best_cuts, cut_points, load_encoder, pack_documents
from flowsieve.llm.sql_text import word_count

VOCABULARY = str(public_tokenizers.path("byte_bpe_50k.json"))


def brute_targets(sizes, weights=(3, 1, 2), total=1.5, cap=2.0):
    """Share by weight, cut at the cap, share the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_ = {s: 0.0 for s in names}, set(names)
    left = total * sum(sizes.values())
    while left > 1e-9 and open_:
        share = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in sorted(open_, key=str):
            target[s] += share * weight[s]
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                open_.discard(s)
    return target


def check_mix(docs, report, tolerance):
    rows = docs.select("source", word_count(F.col("text")).alias("n")).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len((r.n and [0] * r.n) or [])
    want = sorted(brute_targets(sizes).values())
    got = report.collect()
    assert len(got) == len(rows)
    assert sum(r["size"] for r in got) == sum(sizes.values())
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert np.allclose(sorted({(r.source_size, r.target) for r in got}, key=lambda x: x[1])[-1][1], want[-1])
    assert set(np.round([r.target for r in got], 3)) <= set(np.round(want, 3))
    taken = defaultdict(int)
    for r in got:
        taken[(r.source_size, r.target)] += r.taken
    for (size, target), n in taken.items():
        assert abs(n - target) <= tolerance


def test_sources_take_their_targets(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    check_mix(docs, mix_report(docs, MixConfig(shard=64)), tolerance=2 * 64)
    again = {(r.doc_id, r.taken) for r in mix_report(docs).collect()}
    assert again == {(r.doc_id, r.taken) for r in mix_report(docs.repartition(5)).collect()}


def test_sizes_are_words(spark, odd_docs):
    for r in odd_docs.select("text", word_count(F.col("text")).alias("n")).collect():
        assert r.n == len((r.text or "").encode().split())


def test_mix_of_odd_rows(spark, odd_docs, no_docs):
    got = mix_report(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert all(r.taken <= 2 * r["size"] for r in got) and any(r.taken for r in got)
    assert mix_report(no_docs).count() == 0 and mixed_documents(no_docs).count() == 0
    mixed = mixed_documents(odd_docs)
    assert mixed.columns == odd_docs.columns
    assert not {0, 1, 2} & {r.doc_id for r in mixed.collect()} and {None, 7} <= {r.doc_id for r in mixed.collect()}
    clash = odd_docs.select("doc_id", "text", "source", *[F.lit(1).alias(c) for c in (
        "row", "doc", "__row", "__parts", "parts", "pass", "size", "sid", "block", "digest", "taken", "words", "low")])
    out = mixed_documents(clash)
    assert out.columns == clash.columns and out.where("row = 1 and __parts = 1 and pass = 1 and words = 1").count() == out.count() > 0


def spark_hash(*values):
    """xxhash64 of ints, longs (as (value,)) and strings, null skipped."""
    h = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else struct.pack("<q", v[0]) if isinstance(v, tuple) else struct.pack("<i", v)
            h = xxhash.xxh64_intdigest(raw, h)
    return h - (1 << 64) if h >> 63 else h


def replayed(rows, cfg):
    """{doc_id: words taken}: the draw slot by slot and the permutations index by
    index, over documents laid end to end word by word."""
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len((r.text or "").split())
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    target = brute_targets(sizes, cfg.weights, cfg.total, cfg.cap)
    blocks = [-(-sizes[s] // cfg.block) for s in names]
    quota = [min(int(target[s] * b / sizes[s] + 0.5), int(cfg.cap * b)) for s, b in zip(names, blocks)]
    slots, owner = sum(quota), [i for i, q in enumerate(quota) for _ in range(q)]
    drawn = defaultdict(int)
    for slot in range(slots):
        drawn[slot // cfg.shard, owner[spark_hash(cfg.seed, (slot,)) % slots]] += 1
    got, freed = [0] * len(names), 0
    for (_, sid), n in sorted(drawn.items()):
        own = min(n, quota[sid] - got[sid])
        got[sid], freed = got[sid] + own, freed + n - own
    assert freed == sum(q - g for q, g in zip(quota, got))  # what is over goes to those that lack
    chunks = max(1, -(-len(rows) // cfg.chunk_rows))
    words = {i: [] for i in range(len(names))}
    for i, s in enumerate(names):
        mine = [(spark_hash((r.doc_id,), (spark_hash(s, r.text),)) % chunks, r.doc_id, len(r.text.split())) for r in rows if r.source == s]
        for _, doc, n in sorted(mine):
            words[i] += [doc] * n
    taken = defaultdict(int)
    for sid, q in enumerate(quota):
        n = blocks[sid]
        for slot in range(q):
            turn, i = slot // n, slot % n
            for r in range(cfg.rounds):
                k = spark_hash(cfg.seed, r, sid, (turn,)) % n
                j = (k - i) % n
                i = j if spark_hash(cfg.seed + 1, r, (max(i, j),), sid, (turn,)) & 1 else i
            for doc in words[sid][i * cfg.block:(i + 1) * cfg.block]:
                taken[doc] += 1
    return taken


def test_taken_words_equal_a_replay_of_the_draw(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    cfg = MixConfig(shard=64, chunk_rows=50)
    want = replayed(docs.collect(), cfg)
    assert {r.doc_id: r.taken for r in mix_report(docs, cfg).collect() if r.taken} == dict(want)


def test_mixed_documents_hold_the_words_of_the_report(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    texts = {r.doc_id: r.text.split() for r in docs.collect()}
    words = defaultdict(int)
    for r in mixed_documents(docs).collect():
        mine = r.text.split()
        words[r.doc_id] += len(mine)
        it = iter(texts[r.doc_id])
        assert all(w in it for w in mine)  # in order
        assert r.n_chars == len(r.text)
    assert dict(words) == {r.doc_id: r.taken for r in mix_report(docs).collect() if r.taken}


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_permutations_are_permutations(spark, n):
    got = spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), [F.lit(3)], MixConfig()).alias("p")).collect()
    assert sorted(r.p for r in got) == list(range(n))
    assert n < 64 or [r.p for r in got] != list(range(n))


def test_each_block_at_most_once_a_pass(spark):
    mix = plan_mix(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), MixConfig(shard=100))
    assert mix.taken.groupBy("sid", "block", "pass").count().where("count > 1").count() == 0
    slots = mix.taken.groupBy("shard").count().collect()
    assert all(r["count"] == 100 for r in slots if r.shard < max(s.shard for s in slots))


def brute_cut_cost(pos, penalty, length):
    def padding(n):
        return 0 if n & (n - 1) == 0 else length - n
    best = [0.0] + [float("inf")] * (len(pos) - 1)
    for j in range(1, len(pos)):
        for i in range(j):
            if pos[j] - pos[i] <= length:
                best[j] = min(best[j], best[i] + padding(pos[j] - pos[i]) + penalty[j])
    return best[-1]


def test_cuts_cost_least():
    rng = np.random.default_rng(5)
    for _ in range(60):
        pos = np.concatenate(([0], np.cumsum(rng.integers(1, 30, rng.integers(2, 60)))))
        penalty = rng.choice([0.0, 1.0, 8.0], len(pos))
        cuts = best_cuts(pos, penalty, 64)
        assert cuts[0] == 0 and cuts[-1] == pos[-1] and max(np.diff(cuts)) <= 64
        cost = dict(zip(pos.tolist(), penalty.tolist()))
        mine = sum((0 if n & (n - 1) == 0 else 64 - n) for n in np.diff(cuts)) + sum(cost[c] for c in cuts[1:])
        assert mine == pytest.approx(brute_cut_cost(pos.tolist(), penalty.tolist(), 64))


def test_cuts_lie_at_documents_and_sentences():
    _, ends, opens = load_encoder(VOCABULARY)
    ids = np.array(Tokenizer.from_file(VOCABULARY).encode("One two. Three four! Five", add_special_tokens=False).ids + [0])
    cfg = PackConfig(VOCABULARY)
    pos, penalty = cut_points(ids, np.array([len(ids)]), ends, opens, cfg)
    assert len(pos) == 4 and penalty.tolist()[1:] == [1.0, 1.0, 0.0]


def check_pieces(docs, pieces, length=1024):
    tok = Tokenizer.from_file(VOCABULARY)
    want = defaultdict(list)
    for r in docs.collect():
        ids = np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        want[r.doc_id].append(ids)
    rows = pieces.collect()
    left = defaultdict(list)
    for r in rows:
        left[r.doc_id].append(r)
    for doc, texts in want.items():
        assert sum(len(t) for t in texts) == sum(r.length for r in left[doc])
        for r in left[doc]:
            assert any(r.doc_tokens == len(t) and zlib.crc32(t[r.start:r.start + r.length].tobytes()) == r.ids_crc32
                       for t in texts)
        if len(texts) == 1:
            at = 0
            for r in sorted(left[doc], key=lambda r: r.start):
                assert r.start == at
                at += r.length
    seq = defaultdict(list)
    for r in rows:
        seq[r.sequence_id].append(r)
    padding = tokens = 0
    for pieces_ in seq.values():
        at = 0
        for r in sorted(pieces_, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
        tokens += at
    return padding / (padding + tokens)


def test_packing_round_trip(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert check_pieces(docs, pack_documents(docs, PackConfig(VOCABULARY))) < 0.02
    small = PackConfig(VOCABULARY, horizon=4096)
    assert check_pieces(docs, pack_documents(docs, small)) < 0.02


def test_packing_keeps_order(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").coalesce(1)
    rows = pack_documents(docs, PackConfig(VOCABULARY)).collect()
    assert [(r.doc_id, r.start) for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset))] == sorted(
        (r.doc_id, r.start) for r in rows)


def test_packing_of_odd_rows(spark, odd_docs, no_docs):
    check_pieces(odd_docs, pack_documents(odd_docs, PackConfig(VOCABULARY)))
    assert pack_documents(no_docs, PackConfig(VOCABULARY)).count() == 0


def test_special_token_text_is_ordinary(spark):
    docs = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string")
    check_pieces(docs, pack_documents(docs, PackConfig(VOCABULARY)))


def test_packing_of_long_white_space(spark):
    texts = [" " * 2_000_000, "a" + "\n" * 1_100_000, " \n" * 600_000 + "b", "a. " + "　\t" * 600_000 + " c  d" + " " * 70_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    check_pieces(docs, pack_documents(docs, PackConfig(VOCABULARY)))


def test_white_space_runs_are_cut_exactly(monkeypatch):
    from flowsieve.llm import packing_dp

    monkeypatch.setattr(packing_dp, "_RUN", 4)
    encoder, tok = load_encoder(VOCABULARY)[0], Tokenizer.from_file(VOCABULARY)
    rng = np.random.default_rng(3)
    parts = [" ", " ", "\n", "\t", "\r\n", "　", "\xa0", "\x85", "\x1c", "a", "Word", "9", "!", "'s", "é", "日"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) * int(rng.integers(1, 12)) for _ in range(int(rng.integers(1, 8))))
        assert packing_dp.text_ids(encoder, text) == tok.encode(text, add_special_tokens=False).ids


def test_queries_find_added_tokens(spark, tmp_path):
    import corpus_pipeline
    from flowsieve.llm.queries import op7_packing

    mark = "<|endoftext|>"
    texts = ["a <|endoftext|> b", mark, mark * 3, f"x{mark}", f"{mark}  y", f"<|endoftext{mark}|>", "a  " + mark + "\n\n'" + mark + "s",
             "plain words <|end|>", None, "", "a " + " " * 200_000 + mark + " " * 200_000 + "b", "w. " * 5000 + mark + " V"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    tok = Tokenizer.from_file(VOCABULARY)
    want = {i: np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4") for i, t in enumerate(texts)}
    assert want[0].tolist() == [64, 220, 50256, 275, 0]
    for rows in (op7_packing(spark, str(tmp_path)).collect(), corpus_pipeline.packing(spark, docs, "").collect()):
        assert {r.doc_id for r in rows} == set(want)
        for doc, ids in want.items():
            at = 0
            for r in sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(ids)
                assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
                at += r.length
            assert at == len(ids)


def test_no_row_is_dropped_for_its_id(spark):
    import corpus_pipeline

    rng = np.random.default_rng(11)
    ids = [None, None, None, 4, 4, 4, 4, 5, 5, 6]
    texts = [" ".join(f"r{i}w{j}" for j in range(int(rng.integers(200, 900)))) for i in range(len(ids))]
    texts[9] = texts[0]  # a text of its own id, and of none
    texts[6] = texts[5]  # a copy: same id, source, text
    sources = ["a", "b", "a", "a", "b", "a", "a", "b", "b", "a"]
    docs = spark.createDataFrame(list(zip(ids, texts, sources)), "doc_id long, text string, source string").repartition(4)
    key = {(d, t, s) for d, t, s in zip(ids, texts, sources)}
    report = defaultdict(int)
    for r in mix_report(docs).collect():
        report[(r.doc_id, r["size"])] += r.taken
    mixed = corpus_pipeline.mixing(spark, docs, "").collect()
    words = defaultdict(int)
    for r in mixed:
        mine = r.text.split()
        whole = [t for d, t, s in key if (d, s) == (r.doc_id, r.source) and set(mine) <= set(t.split())]
        assert len(whole) == 1  # no words of another row of that id
        words[(r.doc_id, len(whole[0].split()))] += len(mine)
    assert dict(words) == {k: n for k, n in report.items() if n}
    assert sum(words.values()) == pytest.approx(1.5 * sum(len(t.split()) for t in texts), abs=3 * 64)
    again = corpus_pipeline.mixing(spark, docs.repartition(3), "").collect()
    assert sorted(map(str, again)) == sorted(map(str, mixed))
