"""Language of whole texts by multilingual mixture inference.

Each language is a distribution over letter trigrams (bytes, A-Z folded, with
word ends), hashed to ``buckets``. A document is a mixture of languages: each
of its words comes from one of them, with the likelihood of its trigrams.
Expectation-maximisation over the words estimates the proportions within a set
of languages; the set is the one of largest penalised likelihood, where each
further language must gain ``penalty`` times the logarithm of the number of
words. The prediction is the largest language of the set.

The likelihood is concave in the proportions, so the gradient bounds how much
any proportions could still gain: expectation-maximisation runs until that
bound is below ``tolerance``. The same bound closes the search exactly: no set
is likelier than all languages together, so sets stop growing when even that
value, less the cost of their size, is below the best set found. Of each size
all sets are tried if they are at most ``exhaustive`` (any of up to eight
languages), else those that differ by one language from the best sets so far.

Trigram counts are taken over all labelled training rows, summed per task and
then per (language, bucket); the model's size is languages times buckets.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowsieve.llm.arrow_text import blocks, row_runs, small_batches
from flowsieve.llm.sql_text import held_out

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True


@dataclass(frozen=True)
class LangConfig:
    bits: int = 15
    smoothing: float = 0.5
    penalty: float = 4.0
    tolerance: float = 0.05
    exhaustive: int = 70


@dataclass
class LangModel:
    """``log_p``: (buckets, languages)."""

    languages: list[str]
    log_p: np.ndarray


def letter_trigrams(data: np.ndarray, offs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each letter's trigram, first letter of each word, its row).
    Words are runs of letters here; bytes of 128 and above count as letters."""
    letter = _LETTER[data]
    n = len(data)
    before, after = np.zeros(n, dtype=np.uint32), np.zeros(n, dtype=np.uint32)
    folded = np.where(letter, _FOLD[data], np.uint32(0))
    if n > 1:
        before[1:], after[:-1] = folded[:-1], folded[1:]
        cuts = offs[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        before[cuts] = 0
        after[cuts - 1] = 0
    code = ((before << np.uint32(16)) | (folded << np.uint32(8)) | after)[letter]
    bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    first = np.flatnonzero(before[letter] == 0)
    at = np.flatnonzero(letter)[first]
    return bucket, first, np.searchsorted(offs, at, side="right") - 1


def fit_languages(docs: DataFrame, cfg: LangConfig = LangConfig()) -> LangModel:
    """Trigram model of each non-null lang, from rows that are not held out."""
    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for rows, data, offs in blocks(batches, "text"):
            bucket, first, row = letter_trigrams(data, offs, cfg.bits)
            letters_row = np.repeat(row, np.diff(np.append(first, len(bucket))))
            codes = rows.column("lang").dictionary_encode()
            for i, name in enumerate(codes.dictionary.to_pylist()):
                mine = codes.indices.to_numpy()[letters_row] == i
                got = np.bincount(bucket[mine], minlength=1 << cfg.bits)
                totals[name] = totals[name] + got if name in totals else got
        for name, got in totals.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(got[at].astype(np.int64))],
                                             names=["lang", "bucket", "n"])

    small_batches(docs.sparkSession)
    rows = docs.where(~held_out() & F.col("lang").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    table = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(
        F.sum("n").alias("n")).toArrow()
    names = table.column("lang").to_pylist()
    languages = sorted(set(names))
    n = np.full((1 << cfg.bits, len(languages)), cfg.smoothing)
    place = {name: i for i, name in enumerate(languages)}
    n[table.column("bucket").to_numpy(), [place[x] for x in names]] += table.column("n").to_numpy()
    return LangModel(languages, np.log(n / n.sum(axis=0)).astype(np.float32) if languages else n.astype(np.float32))


def fit_proportions(p: np.ndarray, begin: np.ndarray, pi: np.ndarray, tolerance: float,
                    enough: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(proportions, log likelihood, most it could still gain) of each row, by
    expectation-maximisation from ``pi``; a proportion of zero stays zero.

    p: likelihood of each word in each language, relative to its largest; begin:
    first word of each row. A row is done when the possible gain is at most the
    tolerance, or when its likelihood with that gain stays below ``enough``.
    """
    words = np.diff(np.append(begin, len(p)))
    pi, value, gain = pi.copy(), np.full(len(begin), -np.inf), np.full(len(begin), np.inf)
    live, q, at, n = np.arange(len(begin)), p, begin, words.astype(np.float64)
    step = 0
    while len(live):
        now = pi[live]
        mix = np.einsum("wk,wk->w", q, np.repeat(now, n.astype(np.int64), axis=0))
        slope = np.add.reduceat(q / mix[:, None], at, axis=0)
        # languages outside the set (proportion zero) cannot gain
        gain[live] = np.where(now > 0, slope, 0.0).max(axis=1) - n
        if step % 4 == 0 or step > 200:
            value[live] = np.add.reduceat(np.log(mix), at)
            done = gain[live] <= tolerance
            if enough is not None:
                done |= value[live] + gain[live] < enough[live]
            if done.any():
                keep = ~done
                some = np.repeat(keep, n.astype(np.int64))
                q, live, n, now, slope = q[some], live[keep], n[keep], now[keep], slope[keep]
                at = np.concatenate(([0], np.cumsum(n.astype(np.int64))[:-1])) if len(n) else at[:0]
        pi[live] = now * slope / n[:, None]
        step += 1
    return pi, value, gain


def _next_sets(size: int, k: int, best: set[tuple[int, ...]], cfg: LangConfig) -> list[tuple[int, ...]]:
    if comb(k, size) <= cfg.exhaustive:
        return list(combinations(range(k), size))
    grown = {tuple(sorted((*s, j))) for s in best for j in range(k) if j not in s}
    swapped = {tuple(sorted(set(s) - {i} | {j})) for s in grown for i in s for j in range(k) if j not in s} if size < 4 else set()
    return sorted(grown | swapped)


def mixtures(ll: np.ndarray, begin: np.ndarray, cfg: LangConfig) -> tuple[np.ndarray, np.ndarray]:
    """(proportions over the chosen set, score) of each row. ll: log likelihood
    of each word in each language; begin: first word of each row."""
    n, k = len(begin), ll.shape[1]
    ll = ll.astype(np.float64)
    words = np.diff(np.append(begin, len(ll)))
    top = ll.max(axis=1, keepdims=True)
    base = np.add.reduceat(top[:, 0], begin)
    alone = np.add.reduceat(ll, begin, axis=0) - base[:, None]
    best = alone.argmax(axis=1)
    pi = np.zeros((n, k))
    pi[np.arange(n), best] = 1.0
    score = 1 / np.exp(alone - alone.max(axis=1, keepdims=True)).sum(axis=1)
    if k == 1:
        return pi, score
    p = np.maximum(np.exp(ll - top), 1e-300)
    cost = cfg.penalty * np.log(np.maximum(words, 2))
    chosen = alone.max(axis=1)
    # all languages at once: what no set can exceed; most rows end here
    start = 0.9 * pi + 0.1 / k
    _, value, gain = fit_proportions(p, begin, start, cfg.tolerance, enough=chosen + cost)
    ceiling = value + gain
    for i in np.flatnonzero(ceiling - cost >= chosen):
        mine = p[begin[i]:begin[i] + words[i]]
        sets, size = {(int(best[i]),)}, 2
        while size <= k and ceiling[i] - (size - 1) * cost[i] > chosen[i]:
            tried = {}
            for s in _next_sets(size, k, sets, cfg):
                first = np.full((1, size), 1 / size)
                found, got, _ = fit_proportions(mine[:, s], np.zeros(1, dtype=np.int64), first, cfg.tolerance)
                tried[s] = got[0]
                if got[0] - (size - 1) * cost[i] > chosen[i]:
                    chosen[i] = got[0] - (size - 1) * cost[i]
                    pi[i] = 0.0
                    pi[i, s] = found[0]
                    score[i] = found[0].max()
            sets, size = set(sorted(tried, key=lambda s: -tried[s])[:4]), size + 1
    return pi, score


def predict_languages(docs: DataFrame, model: LangModel, cfg: LangConfig = LangConfig()) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, languages
    (the chosen set, largest proportion first).

    Reads doc_id and text only. A text that is null or has no letter, or any
    text where no language was learned, is ``und`` with score 0 and no
    languages. Ties go to the first language by name. An empty table gives an
    empty one.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.log_p))

    def run(batches):
        languages, log_p = shared.value
        for rows, data, offs in blocks(batches, "text"):
            n = rows.num_rows
            pred, score, chosen = ["und"] * n, np.zeros(n), [[] for _ in range(n)]
            bucket, first, row = letter_trigrams(data, offs, cfg.bits)
            if languages and len(first):
                own, begin = row_runs(row)
                ll = np.add.reduceat(log_p[bucket], first, axis=0)
                pi, sure = mixtures(ll, begin, cfg)
                ascii_letter = np.diff(np.concatenate(([0], np.cumsum(_LETTER[data] & (data < 128))))[offs])[own] > 0
                for i, doc in enumerate(own.tolist()):
                    if not ascii_letter[i] and not any(c.isalpha() for c in data[offs[doc]:offs[doc + 1]].tobytes().decode("utf-8", "replace")):
                        continue
                    order = np.argsort(-pi[i], kind="stable")
                    pred[doc], score[doc] = languages[order[0]], min(1.0, sure[i])
                    chosen[doc] = [languages[j] for j in order if pi[i, j] > 0]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("held_out"), pa.array(pred), pa.array(score),
                 pa.array(chosen, pa.list_(pa.string()))],
                names=["doc_id", "held_out", "lang_pred", "score", "languages"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, languages array<string>")
