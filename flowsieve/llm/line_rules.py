"""Quality rules from line frequencies across documents.

One pass over the texts gives each document its counts and its distinct lines,
as 64-bit hashes of the normalised line (words, A-Z folded, one space apart).
For every (host, line) the distinct documents are counted, exact copies of a
text as one. A line is boilerplate of its host if more than ``most_docs`` of
them hold it, whatever the host's size, or at least ``min_docs`` and more than
``host_percent`` of the host's. Those lines are removed; a document that keeps
less than ``left_percent`` of its words is depleted and rejected, as is one that
fails the base rules.

Copies of a text are not counted apart: a page that is copied a thousand times
would else lose all its lines, and the one copy that deduplication keeps would
go with the others.

Distinct documents are counted in two steps, by (host, line, text) and then by
(host, line) with map-side sums, so a line that a third of all rows share is
never gathered in one task; the lines look their verdict up in the same way,
those of very frequent lines from a broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from flowsieve.llm.arrow_text import blocks, hash_words, mix64, row_runs, small_batches, word_spans
from flowsieve.llm.hot_keys import hot_of, look_up
from flowsieve.session import written as stored

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_FACTS = ("row long, doc_id long, host string, digest long, n_words long, word_chars long, n_symbols long, "
          "n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<long>")


@dataclass(frozen=True)
class LineConfig:
    min_words: int = 50
    repeat_percent: int = 50
    min_docs: int = 10
    host_percent: int = 10
    most_docs: int = 100
    left_percent: int = 30


def _per_row(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(mask)))[offs])


def _repeated_words(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Words inside a 3-word window that the row holds twice or more."""
    if len(h) < 3:
        return np.zeros(n, dtype=np.int64)
    window = mix64(h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(0x9E3779B97F4A7C15) + h[2:] * np.uint64(0xC2B2AE3D27D4EB4F))
    at = np.flatnonzero(row[:-2] == row[2:])
    key = mix64(window[at] + mix64(row[at].astype(np.uint64)))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(at), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    hit = at[again]
    covered = np.zeros(len(h), dtype=bool)
    for j in range(3):
        covered[hit + j] = True
    return np.bincount(row[covered], minlength=n)


def text_facts(data: np.ndarray, offs: np.ndarray) -> tuple[dict[str, np.ndarray], list[np.ndarray]]:
    """Counts per text, and [row, hash, words] of its distinct lines with a word."""
    n = len(offs) - 1
    starts, ends, row = word_spans(data, offs)
    lead = (data & 0xC0) != 0x80
    solid = np.zeros(len(data) + 1, dtype=np.int8)
    np.add.at(solid, starts, 1)
    np.add.at(solid, ends, -1)
    solid = np.cumsum(solid[:-1], dtype=np.int8).astype(bool)
    counts = {
        "digest": np.zeros(n, dtype=np.uint64),
        "n_words": np.bincount(row, minlength=n),
        "word_chars": _per_row(solid & lead, offs),
        "n_symbols": _per_row(_SYMBOL[data], offs),
        "n_dup_lines": np.zeros(n, dtype=np.int64),
        "n_repeat_words": _repeated_words(hash_words(data, starts, ends, lower=False), row, n),
    }
    full = np.flatnonzero(np.diff(offs) > 0)
    counts["digest"][full] = hash_words(data, offs[full], offs[full + 1], lower=False)
    # a line is known by the number of line ends (newlines, text ends) before it
    breaks = np.concatenate((np.flatnonzero(data == 10) + 1, offs[1:-1]))
    breaks.sort(kind="stable")
    line = np.searchsorted(breaks, starts, side="right")
    own, first = row_runs(line)
    if not len(own):
        return counts, [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)]
    begin = np.where(own > 0, breaks[np.maximum(own - 1, 0)] if len(breaks) else 0, 0)
    end = np.append(breaks, len(data))[own]
    end = end - (data[end - 1] == 10)
    line_row, words = row[first], np.diff(np.append(first, len(line)))
    raw = mix64(hash_words(data, begin, end, lower=False) + mix64(line_row.astype(np.uint64)))
    _, kept = np.unique(raw, return_index=True)
    counts["n_dup_lines"] = np.bincount(line_row, minlength=n) - np.bincount(line_row[kept], minlength=n)
    place = np.arange(len(line)) - np.repeat(first, words)
    power = np.cumprod(np.full(int(words.max()), 0x9E3779B97F4A7C15, dtype=np.uint64), dtype=np.uint64)
    hashes = mix64(np.add.reduceat(hash_words(data, starts, ends, lower=True) * power[place], first))
    key = mix64(hashes + mix64(line_row.astype(np.uint64)))
    _, one, group = np.unique(key, return_index=True, return_inverse=True)
    total = np.bincount(group, weights=words).astype(np.int64)
    order = np.argsort(line_row[one], kind="stable")
    return counts, [line_row[one][order], hashes[one][order], total[order]]


def _facts(batches):
    row_id = TaskContext.get().partitionId() << 40
    for rows, data, offs in blocks(batches, "text"):
        n = rows.num_rows
        counts, (line_row, hashes, words) = text_facts(data, offs)
        cut = pa.array(np.searchsorted(line_row, np.arange(n + 1)).astype(np.int32))
        columns = [pa.array(row_id + np.arange(n)), rows.column("doc_id"), rows.column("host"),
                   pa.array(counts.pop("digest").view(np.int64)), *[pa.array(c.astype(np.int64)) for c in counts.values()],
                   pa.ListArray.from_arrays(cut, pa.array(hashes.view(np.int64))),
                   pa.ListArray.from_arrays(cut, pa.array(words))]
        row_id += n
        yield pa.RecordBatch.from_arrays(columns, names=[c.strip().split()[0] for c in _FACTS.split(",")])


def line_quality(docs: DataFrame, cfg: LineConfig = LineConfig(), host: str = "source") -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, removed_words.

    Needs doc_id, text and the host column; others are not read. A null text
    has no words (and so fails); rows without a host share one; repeated rows
    are counted as one document and each get a result; an empty table gives an
    empty one.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col(host).cast("string"), F.lit("\0")).alias("host"),
                       F.col("text").cast("string").alias("text"))
    facts = stored(rows.mapInArrow(_facts, _FACTS), "line-facts")
    lines = facts.select("row", "host", "digest", F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select(
        "row", "host", "digest", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"))
    per_line = lines.groupBy("host", "line").agg(F.count_distinct("digest").alias("n_docs"))
    per_host = facts.groupBy("host").agg(F.count_distinct("digest").alias("host_docs"))
    often = look_up(stored(per_line.where(F.col("n_docs") >= min(cfg.min_docs, cfg.most_docs + 1)), "line-often"), per_host, "host")
    key = F.struct("host", "line").alias("key")
    boilerplate = stored(often.where((F.col("n_docs") > cfg.most_docs) | (F.col("n_docs") >= cfg.min_docs) & (
        F.col("n_docs") * 100 > F.col("host_docs") * cfg.host_percent)).select(key, "n_docs"), "line-boilerplate")
    total = facts.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0]
    removed = (look_up(lines.select("row", key, "words"), boilerplate, "key",
                       hot=hot_of(boilerplate, "key", "n_docs", total))
               .where("n_docs is not null").groupBy("row").agg(F.sum("words").alias("removed_words")))
    failed = (F.col("n_words") < cfg.min_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * cfg.repeat_percent)
    left = (F.col("n_words") - F.col("removed_words")) * 100 >= F.col("n_words") * cfg.left_percent
    return (facts.drop("lines", "line_words").join(removed, "row", "left")
            .withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    failed.alias("base_failed"), (~failed & left).alias("kept"), "removed_words"))
