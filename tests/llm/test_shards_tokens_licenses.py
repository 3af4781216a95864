"""Shard table, token counts, licence scan, pipeline, registration."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

import __spark_entry__ as E
import corpus_pipeline
from conftest import SF_SMALL
from odd_rows import no_docs, odd_docs  # noqa: F401
from flowsieve.llm.licenses import LICENCES, NOTICES, scan_licenses
from flowsieve.llm.shard_table import ShardConfig, _number, assign_shards, fill_table
from flowsieve.llm.sql_text import word_count
from flowsieve.llm.viterbi_count import SPACE, UnigramVocabulary, WordCounter, count_tokens, load_vocabulary, token_counts


def plain_fill(cfg):
    orders = []
    for s in cfg.shards:
        a, d = _number(s, "start") % cfg.slots, _number(s, "step") % (cfg.slots - 1) + 1
        orders.append(iter([(a + j * d) % cfg.slots for j in range(cfg.slots)]))
    table = {}
    while len(table) < cfg.slots:
        for i, order in enumerate(orders):
            if len(table) < cfg.slots:
                table[next(x for x in order if x not in table)] = i
    return [table[i] for i in range(cfg.slots)]


def test_fill_is_by_turns():
    cfg = ShardConfig(tuple("abcdefg"), 211)
    assert fill_table(cfg).tolist() == plain_fill(cfg)
    n = np.bincount(fill_table(ShardConfig()))
    assert len(n) == 256 and n.max() - n.min() <= 1
    heavy = np.bincount(fill_table(ShardConfig(tuple("abc"), 997, weights={"b": 2})))
    assert heavy[1] == pytest.approx(997 / 2, abs=2)


def test_few_slots_move_when_a_shard_leaves():
    names = tuple(f"s{i}" for i in range(20))
    before, after = fill_table(ShardConfig(names, 10007)), fill_table(ShardConfig(names[:7] + names[8:], 10007))
    old, new = np.array(names)[before], np.array(names[:7] + names[8:])[after]
    assert np.mean((old != new) & (old != "s7")) < 0.1


def test_bad_tables_are_refused():
    for bad in (ShardConfig((), 7), ShardConfig(("a", "a"), 7), ShardConfig(("a",), 8), ShardConfig(tuple("abcdefgh"), 7)):
        with pytest.raises(ValueError):
            fill_table(bad)


def test_placement(spark, odd_docs, no_docs):
    table = fill_table(ShardConfig())
    got = assign_shards(odd_docs, F.col("doc_id")).withColumn("h", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(65537)))
    rows = got.collect()
    assert len(rows) == odd_docs.count() and set(odd_docs.columns) < set(got.columns)
    assert all(r.slot == r.h and r.shard == f"shard-{table[r.h]:04d}" for r in rows)
    assert assign_shards(no_docs, F.col("doc_id")).count() == 0
    clash = odd_docs.withColumnRenamed("lang", "shard").withColumnRenamed("key", "slot")
    assert assign_shards(clash, F.col("doc_id")).columns == clash.columns
    names = ["__slot", "__shard", "at", "name", "row"]
    got = assign_shards(odd_docs.select("doc_id", *[F.lit(c).alias(c) for c in names]), F.col("doc_id"))
    assert got.columns == ["doc_id", *names, "slot", "shard"] and all([r[c] for c in names] == names for r in got.collect())


def reference(vocabulary):
    t = Tokenizer(models.Unigram(list(vocabulary.pieces), vocabulary.unknown, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=SPACE, prepend_scheme="always", split=False)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


ODD = ["", " ", "  a", "a  b", "\n\n", "\n a\nb ", "日本語 テスト", "<unk> x <unk><unk>", "a<0x0A>b </s>", "é́ ▁a", "😀😀 x😀",
       "\t\ta\tb", "a" * 300, "▁", " ▁ ", "a\n▁\n", "xyz😀q\n😀", "a    b", "        return x", "def f():\n        return  x\n\n    y", " " * 40, "a" + " " * 33, "\n    \n  "]


def test_counts_match_the_tokenizer(spark, odd_docs, no_docs):
    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    vocabulary = load_vocabulary(path)
    count, counter = reference(vocabulary), WordCounter(vocabulary, most=1000)
    assert [count_tokens(t, counter) for t in ODD] == [count(t) for t in ODD]
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").unionByName(
        odd_docs.select("doc_id", "text"))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in token_counts(docs, path).collect())
    assert got == sorted((r.doc_id is None, r.doc_id or 0, count(r.text or "")) for r in docs.collect())
    assert token_counts(no_docs, path).count() == 0


@pytest.mark.parametrize("with_bytes", [True, False])
def test_ties_and_unknowns(with_bytes):
    """A small vocabulary full of equal paths, on all short texts."""
    import itertools

    pieces = [("<unk>", 0.0), ("a", -1.0), ("aa", -2.0), ("b", -1.0), ("ab", -2.0), ("aab", -3.0), ("xx", -2.5), (SPACE, -1.0),
              (SPACE + "a", -2.0), ("ba", -1.5),
              (SPACE * 2, -1.5), (SPACE * 3 + "a", -3.5)]
    if with_bytes:
        pieces += [(f"<0x{b:02X}>", -5.0) for b in range(256)]
    vocabulary = UnigramVocabulary(tuple(pieces), 0)
    t = Tokenizer(models.Unigram(pieces, 0, byte_fallback=with_bytes))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=SPACE, prepend_scheme="always", split=False)
    counter = WordCounter(vocabulary)
    for n in range(1, 7):
        for chars in itertools.product("abx ", repeat=n):
            text = "".join(chars)
            assert count_tokens(text, counter) == len(t.encode(text, add_special_tokens=False).ids), text


def test_inheritance_from_the_nearest_directory(spark):
    rows = [
        (1, "r/LICENSE", "Released under the MIT License."),
        (2, "r/a/b/code.c", "int main() { return 0; }"),
        (3, "r/a/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (4, "r/x/own.c", "Licensed under CC BY-NC 4.0.\n" + "some code here " * 30),
        (5, "r/x/y/other.c", None), (6, "elsewhere/f.c", "plain"), (7, None, "Copyright nobody in particular, all wrongs reserved " * 3),
        (8, "r/ab/code.c", "no licence of its own: a/ is no ancestor of ab/"),
        (5, "r/x/y/other.c", None),
    ]
    got = scan_licenses(spark.createDataFrame(rows, "id long, path string, text string")).collect()
    assert len(got) == len(rows)
    by = {r.id: (r.license, r.origin, r.license_dir) for r in got}
    assert by == {1: ("MIT", "file", "r"), 2: ("GPL-3.0", "inherited", "r/a"), 3: ("GPL-3.0", "file", "r/a"),
                  4: ("CC-BY-NC-4.0", "header", None), 5: ("MIT", "inherited", "r"), 6: (None, "none", None),
                  7: (None, "none", None), 8: ("MIT", "inherited", "r")}


def wrapped(text, width=70, mark=""):
    import textwrap

    return "\n".join(mark + line for line in textwrap.wrap(text, width))


MIT_FILE = ("The MIT License (MIT)\n\nCopyright (c) 2019 Somebody Else\n\n" + "\n\n".join(
    wrapped(part) for part in dict(LICENCES)["MIT"].replace(": The above", ":|The above").replace(". THE SOFTWARE", ".|THE SOFTWARE").split("|")))
PROSE = "the river ran on and the quiet town slept under a wide dark sky while nobody watched "
LICENSE_CASES = {
    "mit file": (MIT_FILE, ("MIT", "file")),
    "bsd-2 file": ("Copyright (c) 2001, A. Author\nAll rights reserved.\n\n" + wrapped(dict(LICENCES)["BSD-2-Clause"]), ("BSD-2-Clause", "file")),
    "bsd-3 file": ("Copyright (c) 2001, A. Author\n\n" + wrapped(dict(LICENCES)["BSD-3-Clause"]), ("BSD-3-Clause", "file")),
    "isc file": ("ISC License\n\nCopyright (c) 2004\n\n" + wrapped(dict(LICENCES)["ISC"]), ("ISC", "file")),
    "gpl-2 header": (wrapped([t for n, t in NOTICES if n == "GPL-2.0"][1], 60, " * ") + "\n\nint main() {}\n" + PROSE * 9, ("GPL-2.0", "header")),
    "gpl-3 header": (wrapped([t for n, t in NOTICES if n == "GPL-3.0"][1], 50, "# ") + "\n\nimport os\n" + PROSE * 9, ("GPL-3.0", "header")),
    "agpl": ("This work is licensed under the GNU Affero General Public License, version 3. " + PROSE * 5, ("AGPL-3.0", "header")),
    "lgpl-2.1": (PROSE + ". This work is licensed under the GNU Lesser General Public License, version 2.1. " + PROSE * 5, ("LGPL-2.1", "header")),
    "gpl-2 one line": (PROSE + ". This work is licensed under the GNU General Public License, version 2. " + PROSE * 5, ("GPL-2.0", "header")),
    "cc by": (PROSE * 3 + "\nLicensed under CC BY 4.0.\n" + PROSE, ("CC-BY-4.0", "header")),
    "cc by-sa": (PROSE * 3 + "\nThis work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.\n" + PROSE, ("CC-BY-SA-4.0", "header")),
    "cc by-nc": (PROSE * 3 + ". Licensed under CC BY-NC 4.0. " + PROSE, ("CC-BY-NC-4.0", "header")),
    "apache header": ("/*\n" + wrapped([t for n, t in NOTICES if n == "Apache-2.0"][1], 60, " * ") + "\n */\ncode code\n" + PROSE * 8, ("Apache-2.0", "header")),
    "spdx": ("// SPDX-License-Identifier: MPL-2.0\n" + PROSE * 4, ("MPL-2.0", "header")),
    "embedded": (PROSE * 2 + ". Released under the MIT License. " + PROSE * 2, ("MIT", "header")),
    "no licence": ("Copyright law is a subject that many people discuss at length in the evening. " + PROSE * 3, (None, "none")),
    "drives": ("She lost her driving license on the way home, and a copyright notice fell from the book. " + PROSE, (None, "none")),
}


def test_licences_and_their_near_misses(spark):
    rows = [(i, f"p{i}/x", text) for i, (text, _) in enumerate(LICENSE_CASES.values())]
    got = {r.id: (r.license, r.origin) for r in scan_licenses(spark.createDataFrame(rows, "id long, path string, text string")).collect()}
    assert {name: got[i] for i, name in enumerate(LICENSE_CASES)} == {name: want for name, (_, want) in LICENSE_CASES.items()}


def test_scores_do_not_depend_on_the_corpus(spark):
    rows = [(i, f"p{i}/x", text) for i, (text, _) in enumerate(LICENSE_CASES.values())]
    df = spark.createDataFrame(rows, "id long, path string, text string")
    alone = {r.id: r.score for r in scan_licenses(df.where("id = 4")).collect()}
    assert alone[4] == {r.id: r.score for r in scan_licenses(df).collect()}[4]


def test_licenses_of_odd_rows(spark, odd_docs, no_docs):
    def files(d):
        return d.select(F.col("doc_id").alias("id"), F.col("source").alias("path"), "text", "score")
    assert scan_licenses(files(odd_docs)).count() == odd_docs.count()
    assert scan_licenses(files(no_docs)).count() == 0


def test_registered_queries():
    ops = [k for k in E.queries() if k.startswith("op") and k[2].isdigit()]
    assert sorted(int(k[2:].split("_")[0]) for k in ops) == list(range(1, 14)) and "pipeline" in E.queries()


def test_pipeline_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "near dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(corpus_pipeline.stored(stage(spark, seen[-1], SF_SMALL), "test-stage"))
    assert all(d.columns == docs.columns for d in seen[:-1])
    n = [d.count() for d in seen]
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert n[0] > n[1] > n[2] >= n[3] and ids[4] <= ids[3] <= ids[2] <= ids[1]
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in ids[1] for i in good) >= 0.98 * len(good)
    norm = [" ".join(r.text.split()) for r in seen[2].collect()]
    assert len(set(norm)) == len(norm)
    words = [d.agg(F.sum(word_count(F.col("text")))).first()[0] for d in seen[3:5]]
    assert words[1] == pytest.approx(1.5 * words[0], rel=0.02)
    per_doc = seen[5].groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).where("n % doc_tokens != 0")
    assert per_doc.count() == 0


def test_pipeline_of_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stored(stage(spark, docs, SF_SMALL), "test-odd")
            docs.count()
