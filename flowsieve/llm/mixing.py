"""Mixing sources to target weights.

The words of each source's documents, laid end to end, are cut into blocks of
``block`` words. The output is a row of slots, ``shard`` to an output shard; a
slot is one block. Every shard draws how many of its slots each source gets
from a multinomial with the target shares. The slots of a source, numbered
over all shards, are mapped to its blocks by a pseudorandom permutation of the
block indices (a new one for each pass over the source), and the join on
(source, block) gives the words taken.

Independent draws miss a source's total by about the square root of its slots,
so the draws beyond a source's quota are handed to the sources that fell short;
every source then takes its target to within a block, and none passes over its
words more than ``cap`` times.

All of it is DataFrame operations. Texts are read once for their sizes; after
that only (document, size) and block rows move. Positions inside a source come
from windows over (source, chunk), where a chunk is a hash slice of bounded
size, so a source with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from flowsieve.llm.sql_text import small, word_count
from flowsieve.operators.ordering import running_totals
from flowsieve.session import written as stored


@dataclass(frozen=True)
class MixConfig:
    """``weights`` repeat over the sources in code point order (null last);
    ``total`` and ``cap`` are multiples of all sizes and of a source's size."""

    weights: tuple[int, ...] = (3, 1, 2)
    total: float = 1.5
    cap: float = 2.0
    block: int = 64
    shard: int = 16384
    rounds: int = 10
    seed: int = 7
    chunk_rows: int = 20_000


def source_targets(facts: DataFrame, cfg: MixConfig) -> DataFrame:
    """(source, sid, source_size, target, n_blocks, quota), one row a source.

    Targets share ``total`` times all words by weight; what exceeds ``cap``
    times a source's words is shared again by weight until none is above. In
    order of cap / weight this is one water level: the largest of the levels
    at which all sources before a row are full and the others are not.
    """
    t = facts.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "sid")
    everything = Window.partitionBy()
    weights = F.array(*[F.lit(w) for w in cfg.weights])
    t = (t.withColumn("sid", F.row_number().over(by_name) - 1)
         .withColumn("weight", F.element_at(weights, (F.col("sid") % len(cfg.weights) + 1).cast("int")))
         .withColumn("most", F.col("source_size") * F.lit(cfg.cap))
         .withColumn("ratio", F.col("most") / F.col("weight"))
         .withColumn("all_words", F.sum("source_size").over(everything) * F.lit(cfg.total))
         .withColumn("full", F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("most"))
         .withColumn("rest", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
         .withColumn("level", F.max((F.col("all_words") - F.col("full")) / F.col("rest")).over(everything))
         .withColumn("target", F.least(F.col("most"), F.col("level") * F.col("weight")).cast("double")))
    return t.select(
        "source", "sid", "source_size", "target",
        F.ceil(F.col("source_size") / cfg.block).cast("long").alias("n_blocks"),
        # slots at the source's mean words a block, its last block being shorter
        F.coalesce(F.least(F.round(F.try_divide(F.col("target") * F.ceil(F.col("source_size") / cfg.block), F.col("source_size"))),
                           F.floor(F.lit(cfg.cap) * F.ceil(F.col("source_size") / cfg.block))),
                   F.lit(0)).cast("long").alias("quota"))


def _positions(facts: DataFrame, sources: DataFrame, n_rows: int, cfg: MixConfig) -> DataFrame:
    """(row, doc_id, sid, size, start): the document's first word in its source."""
    chunks = max(1, -(-n_rows // cfg.chunk_rows))
    keyed = (facts.join(sources.select(F.col("source").alias("name"), "sid"), F.col("source").eqNullSafe(F.col("name")))
             .select("row", "doc_id", "digest", "sid", "size", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(chunks)).alias("chunk")))
    inside = Window.partitionBy("sid", "chunk").orderBy("doc_id", "digest", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunk_start = (keyed.groupBy("sid", "chunk").agg(F.sum("size").alias("words"))
                   .select("sid", "chunk", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("chunk_start")))
    return (keyed.withColumn("upto", F.sum("size").over(inside)).join(chunk_start, ["sid", "chunk"])
            .select("row", "doc_id", "sid", "size", (F.col("chunk_start") + F.col("upto") - F.col("size")).alias("start")))


def _draws(spark, sources: DataFrame, n_sources: int, slots: int, cfg: MixConfig) -> DataFrame:
    """(shard, sid, n): multinomial counts of each output shard. A slot draws
    a number below the slot total and belongs to the source whose interval
    holds it; the interval is found by an equality join on a coarse cell."""
    width = max(1, -(-slots // max(n_sources, 1)))
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    shares = (sources.where("quota > 0").select("sid", "quota", F.sum("quota").over(upto).alias("hi"))
              .withColumn("lo", F.col("hi") - F.col("quota"))
              .withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width)))))
    drawn = (spark.range(slots).select(
        F.floor(F.col("id") / cfg.shard).alias("shard"),
        F.pmod(F.xxhash64(F.lit(cfg.seed), F.col("id")), F.lit(slots)).alias("r"))
        .withColumn("cell", F.floor(F.col("r") / width)))
    return (drawn.join(small(shares, 2 * n_sources), "cell").where("lo <= r and r < hi")
            .groupBy("shard", "sid").agg(F.count("*").alias("n")))


def _settled(draws: DataFrame, sources: DataFrame) -> DataFrame:
    """(sid, shard, first, n): runs of slot numbers of each source, 0 to its
    quota without a gap. Draws beyond the quota, the last ones in shard order,
    go one by one to the sources that drew too few."""
    before = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    runs = (draws.join(sources.select("sid", "quota"), "sid")
            .withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
            .withColumn("own", F.greatest(F.lit(0), F.least("n", F.col("quota") - F.col("first")))))
    own = runs.where("own > 0").select("sid", "shard", "first", F.col("own").alias("n"))
    over = runs.where("n > own").select("shard", "sid", (F.col("n") - F.col("own")).alias("extra"))
    freed = (running_totals(over, ["shard", "sid"], {"upto": F.col("extra")})
             .withColumn("at", F.col("upto") - F.col("extra"))
             .select("shard", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("extra") - 1)).alias("e")))
    drawn = draws.groupBy("sid").agg(F.sum("n").alias("drawn"))
    lacking = (sources.select("sid", "quota").join(drawn, "sid", "left")
               .withColumn("drawn", F.coalesce("drawn", F.lit(0))).where("quota > drawn"))
    in_order = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    wanted = (lacking.withColumn("lack", F.col("quota") - F.col("drawn"))
              .withColumn("at", F.coalesce(F.sum("lack").over(in_order), F.lit(0)))
              .select("sid", "drawn", "at", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("lack") - 1)).alias("e")))
    given = (freed.join(wanted, "e")
             .select("sid", "shard", (F.col("drawn") + F.col("e") - F.col("at")).alias("first"), F.lit(1).cast("long").alias("n")))
    return own.unionByName(given)


def permuted(index: Column, n: Column, keys: list[Column], cfg: MixConfig) -> Column:
    """A keyed pseudorandom permutation of 0 to n - 1. Each round pairs i with
    (k - i) mod n and swaps the two, or not, by a bit hashed from the larger:
    every round is a permutation, for any n."""
    def one_round(i: Column, r: Column) -> Column:
        k = F.pmod(F.xxhash64(F.lit(cfg.seed), r, *keys), n)
        j = F.pmod(k - i, n)
        bit = F.xxhash64(F.lit(cfg.seed + 1), r, F.greatest(i, j), *keys).bitwiseAND(F.lit(1))
        return F.when(bit == 1, j).otherwise(i)
    return F.aggregate(F.array(*[F.lit(r) for r in range(cfg.rounds)]), index, one_round)


@dataclass
class Mix:
    """``sources``: the source table; ``docs``: (row, doc_id, sid, size, start);
    ``taken``: (sid, block, shard, pass), a row for each slot."""

    sources: DataFrame
    n_sources: int
    docs: DataFrame
    taken: DataFrame


def plan_mix(docs: DataFrame, cfg: MixConfig = MixConfig(), row: Column | None = None) -> Mix:
    """Draw the mix. Needs doc_id, source and text; null text has no words and
    a null source is a source of its own, last in order. Rows that repeat a
    doc_id, or have none, are documents of their own, in the order of a digest
    of source and text; only rows equal in all three can change places between
    runs. ``row`` names the input rows (numbered here where it is not given)."""
    spark = docs.sparkSession
    row = F.monotonically_increasing_id() if row is None else row
    facts = stored(docs.select(row.alias("row"), F.xxhash64(F.col("source").cast("string"), F.col("text").cast("string")).alias("digest"),
                               F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                               word_count(F.col("text")).alias("size")), "mix-sizes")
    n_rows = facts.count()
    sources = stored(source_targets(facts, cfg), "mix-sources")
    n_sources, slots = sources.agg(F.count("*"), F.coalesce(F.sum("quota"), F.lit(0))).first()
    placed = stored(_positions(facts, small(sources, n_sources), n_rows, cfg), "mix-positions")
    draws = stored(_draws(spark, sources, n_sources, slots, cfg), "mix-draws")
    runs = stored(_settled(draws, sources), "mix-runs")
    # a run has up to a shard's slots: few rows, which are spread before they become slots
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = (runs.repartition(tasks, "sid", "first").withColumn("q", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)))
            .join(small(sources.select("sid", "n_blocks"), n_sources), "sid")
            .withColumn("pass", F.floor(F.col("q") / F.col("n_blocks")).cast("long"))
            .withColumn("i", F.pmod("q", "n_blocks")))
    taken = each.select("sid", "shard", "pass", permuted(
        F.col("i"), F.col("n_blocks"), [F.col("sid"), F.col("pass")], cfg).alias("block"))
    return Mix(sources, n_sources, placed, taken)


def _pieces(mix: Mix, cfg: MixConfig) -> DataFrame:
    """(…, block, low, high): the words of each document in each block; block
    is null for a document without words."""
    last = F.floor((F.col("start") + F.col("size") - 1) / cfg.block)
    blocks = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / cfg.block), last))
    cut = mix.docs.withColumn("block", F.explode_outer(blocks))
    low = F.greatest(F.col("start"), F.col("block") * cfg.block) - F.col("start")
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * cfg.block) - F.col("start")
    return cut.withColumn("low", low).withColumn("high", high)


def mix_report(docs: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken (words
    the mix takes of it, repeats counted). An empty table gives an empty one."""
    mix = plan_mix(docs, cfg)
    times = mix.taken.groupBy("sid", "block").agg(F.count("*").alias("times"))
    per_doc = (_pieces(mix, cfg).join(times, ["sid", "block"], "left")
               .groupBy("row", "doc_id", "sid", "size")
               .agg(F.sum(F.coalesce(F.col("times") * (F.col("high") - F.col("low")), F.lit(0))).alias("taken")))
    return (per_doc.join(small(mix.sources.select("sid", "source_size", "target"), mix.n_sources), "sid")
            .select("doc_id", "size", "source_size", "target", "taken"))


def mixed_documents(docs: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """The mix as documents: a row per input row and pass with the words that
    pass takes of it, in their order; all columns of the input, with text (and
    n_chars where there is one) those of the row. A document whose words are
    all taken keeps its exact text; documents of which nothing is taken, or
    that have no words (null and empty texts), have no row. Rows that repeat a
    doc_id, or have none, are documents of their own, as in ``mix_report``.
    Columns besides doc_id, source and text may have any name. An empty table
    gives an empty table.
    """
    # rows are numbered once, so that spans go back to the text they were computed for
    rows = stored(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                              F.monotonically_increasing_id().alias("row")), "mix-rows")
    mix = plan_mix(rows.select("row", *[F.col(f"doc.{c}").alias(c) for c in ("doc_id", "source", "text")]), cfg, F.col("row"))
    parts = (_pieces(mix, cfg).join(mix.taken, ["sid", "block"])
             .groupBy("row", "size", "pass")
             .agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("parts"),
                  F.sum(F.col("high") - F.col("low")).alias("words")))
    words = F.array(F.regexp_extract_all(F.col("doc.text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)))
    cut = F.transform(words, lambda w: F.array_join(F.flatten(F.transform(
        "parts", lambda p: F.slice(w, (p["low"] + 1).cast("int"), (p["high"] - p["low"]).cast("int")))), ""))
    text = F.when(F.col("words") == F.col("size"), F.col("doc.text")).otherwise(
        F.regexp_replace(F.get(cut, 0), r"^[\x20\x09-\x0D]+", ""))
    out = rows.join(parts, "row").select("doc", text.alias("taken"))
    new = {"text": F.col("taken"), "n_chars": F.length("taken")}
    return out.select(*[(new[c].cast(docs.schema[c].dataType) if c in new else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
