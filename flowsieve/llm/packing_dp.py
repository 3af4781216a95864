"""Order-preserving packing of documents into training sequences.

The token ids of the documents (each closed by an end id) form one stream per
input partition, in doc_id order. Dynamic programming cuts the stream into
windows of at most ``length`` tokens so that padding plus truncation penalties
are least:

    best[j] = penalty[j] + min over cuts i of best[i] + padding(pos[j] - pos[i])

A cut may lie at a document's end (free), at a sentence's end (``sentence``
tokens of penalty), or, where a sentence is longer than ``stride`` tokens,
every ``stride`` tokens inside it (``inside``). Padding of a window that is
not a power of two is length - (pos[j] - pos[i]), so the candidates compare by
best[i] + pos[i] and a monotone queue gives the least of the last ``length``
tokens in constant time; a window whose length is a power of two needs no
padding and is looked up directly at each power.

The stream is solved a ``horizon`` of tokens at a time: windows of the best
path are final except its last few, which the next horizon solves again. So a
task holds a bounded number of tokens besides its longest document, and the
only padding a partition adds is that of its last window.

Token ids are computed with the byte-level vocabulary of a tokenizers file
(merge ranks are its ids), in one encoder per task. A text that holds
the string of one of the file's added tokens has that token's id there, as in
``tokenizers``. The encoder's pattern gives up on a run of about a million white-space characters, so long
runs are cut out before it (see ``text_ids``).
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from flowsieve.llm.arrow_text import blocks, small_batches

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")

#: White space of the pattern's \s (Python's own also has \x1c to \x1f), and the
#: length of a run from which it is cut out of its text.
_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_RUN = 1 << 16


@dataclass(frozen=True)
class PackConfig:
    """Tokens a sequence, the closing id, penalties (in tokens of padding) of a
    cut at a sentence and inside one, the longest uncut run, and the tokens
    solved at a time."""

    tokenizer: str
    length: int = 1024
    end_id: int = 0
    sentence: float = 1.0
    inside: float = 8.0
    stride: int = 64
    horizon: int = 1 << 18


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable
    Latin-1 stands for itself, the other bytes in order for 256 onwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        chars[chr(256 + n)] = b
    return chars


def added_tokens(path: str) -> dict[str, int]:
    """Ids of the file's added tokens by the string they stand for."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    for t in spec["added_tokens"]:
        if t["single_word"] or t["lstrip"] or t["rstrip"] or (t["normalized"] and spec["normalizer"]):
            raise ValueError(f"added token {t['content']!r} of {path} is not matched as it is written")
    return {t["content"]: t["id"] for t in spec["added_tokens"] if t["content"]}


def load_encoder(path: str):
    """(encoder, ends, opens): a text encoder and, by id, whether a sentence can
    end after the token and begin with it."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    chars = _byte_chars()
    special = {t["content"] for t in spec["added_tokens"]}
    raw = {bytes(chars[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    encoder = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=raw, special_tokens={})
    n = max([*raw.values(), *(t["id"] for t in spec["added_tokens"])]) + 2
    ends, opens = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    for token, i in raw.items():
        ends[i] = token.rstrip(b"\"')]").endswith((b".", b"!", b"?")) or b"\n" in token
        opens[i] = token[:1] in (b" ", b"\n")
    return encoder, ends, opens


def text_ids(encoder, text: str) -> list[int]:
    """Ids of a text of any content.

    The pattern takes a run of white space before other text without its last
    character (``\\s+(?!\\S)``), at the end of the text whole, as one piece. No
    other piece reaches into the run or looks past it, and nothing looks back,
    so a long run's piece is encoded by itself and the pattern sees the rest. A
    run of 2 * _RUN - 1 or more holds an aligned stretch of _RUN.
    """
    if not any(text[i:i + _RUN].isspace() for i in range(0, len(text) - _RUN + 1, _RUN)):
        return encoder.encode_ordinary(text)
    ids, at = [], 0
    for run in _WHITE.finditer(text):
        if run.end() - run.start() >= _RUN:
            stop = run.end() if run.end() == len(text) else run.end() - 1
            ids += encoder.encode_ordinary(text[at:run.start()])
            ids += encoder._encode_single_piece(text[run.start():stop])
            at = stop
    return ids + encoder.encode_ordinary(text[at:])


def added_pattern(added: dict[str, int]) -> re.Pattern | None:
    """Finds the strings of added tokens, at one place the longest."""
    return re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None


def ids_with_added(encoder, text: str, added: dict[str, int], find: re.Pattern | None) -> list[int]:
    """Ids of a text, with those of added tokens where their strings stand; the
    parts between are encoded each by itself."""
    ids, at = [], 0
    for m in find.finditer(text) if find else ():
        ids += text_ids(encoder, text[at:m.start()])
        ids.append(added[m.group()])
        at = m.end()
    return ids + text_ids(encoder, text[at:]) if at else text_ids(encoder, text)


def cut_points(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, opens: np.ndarray,
               cfg: PackConfig) -> tuple[np.ndarray, np.ndarray]:
    """Ascending positions where the stream may be cut, with their penalties."""
    n = len(ids)
    sentence = np.flatnonzero(ends[ids[:-1]] & opens[ids[1:]]) + 1
    pos = np.union1d(np.union1d(sentence, doc_ends), [0, n])
    gaps = np.diff(pos)
    extra = [np.arange(pos[i] + cfg.stride, pos[i + 1], cfg.stride) for i in np.flatnonzero(gaps > cfg.stride)]
    penalty = np.full(len(pos), cfg.sentence)
    penalty[np.isin(pos, doc_ends)] = 0.0
    if extra:
        more = np.concatenate(extra)
        pos, penalty = np.concatenate((pos, more)), np.concatenate((penalty, np.full(len(more), cfg.inside)))
        order = np.argsort(pos, kind="stable")
        pos, penalty = pos[order], penalty[order]
    return pos, penalty


def best_cuts(pos: np.ndarray, penalty: np.ndarray, length: int) -> list[int]:
    """Positions of the least-cost cuts, from pos[0] to pos[-1]. Gaps between
    neighbouring positions must not exceed ``length``."""
    n = len(pos)
    exact: dict[int, list[int]] = {}
    for k in range(length.bit_length()):
        if (1 << k) <= length:
            i = np.searchsorted(pos, pos - (1 << k))
            for j in np.flatnonzero((pos[np.minimum(i, n - 1)] == pos - (1 << k))):
                exact.setdefault(int(j), []).append(int(i[j]))
    at, cost = pos.tolist(), penalty.tolist()
    best, back = [0.0] * n, [0] * n
    value = [0.0] * n  # best[i] + pos[i], what candidates compare by
    value[0] = float(at[0])
    queue = deque([0])
    for j in range(1, n):
        here = at[j]
        while at[queue[0]] < here - length:
            queue.popleft()
        i = queue[0]
        low = value[i] - here + length
        for e in exact.get(j, ()):
            if best[e] < low:
                low, i = best[e], e
        low += cost[j]
        best[j], back[j] = low, i
        v = low + here
        value[j] = v
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    cuts, j = [at[n - 1]], n - 1
    while j:
        j = back[j]
        cuts.append(at[j])
    return cuts[::-1]


class _Stream:
    """Tokens of a partition that no final window holds yet."""

    def __init__(self, cfg: PackConfig, ends: np.ndarray, opens: np.ndarray, first_id: int):
        self.cfg, self.ends, self.opens, self.next_id = cfg, ends, opens, first_id
        self.parts: list[np.ndarray] = []
        self.docs: list[tuple] = []  # (doc_id, tokens of the document, its tokens already emitted, tokens here)
        self.size = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.docs.append((doc_id, len(ids), 0, len(ids)))
        self.size += len(ids)

    def solve(self, last: bool) -> list[tuple]:
        """Rows of the windows that are final."""
        ids = np.concatenate(self.parts) if self.parts else np.zeros(0, dtype=np.uint32)
        if not len(ids):
            return []
        doc_ends = np.cumsum([d[3] for d in self.docs])
        cuts = best_cuts(*cut_points(ids, doc_ends, self.ends, self.opens, self.cfg), self.cfg.length)
        if not last:
            cuts = cuts[:max(2, len(cuts) - 16)]
        rows, d, done = [], 0, 0  # done: where document d begins
        for low, high in zip(cuts, cuts[1:]):
            at = low
            while at < high:
                doc_id, total, before, here = self.docs[d]
                stop = min(high, done + here)
                rows.append((doc_id, before + at - done, stop - at, zlib.crc32(ids[at:stop].astype("<u4").tobytes()),
                             total, self.next_id, at - low))
                at = stop
                if at == done + here:
                    d, done = d + 1, done + here
            self.next_id += 1
        kept = cuts[-1]
        rest = self.docs[d:]
        if rest and kept > done:
            doc_id, total, before, here = rest[0]
            rest[0] = (doc_id, total, before + kept - done, here - (kept - done))
        self.parts, self.docs, self.size = [ids[kept:]], rest, len(ids) - kept
        return rows


def _table(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=names)


def _pack(cfg: PackConfig):
    def run(batches):
        encoder, ends, opens = load_encoder(cfg.tokenizer)
        added = added_tokens(cfg.tokenizer)
        find = added_pattern(added)
        stream = _Stream(cfg, ends, opens, TaskContext.get().partitionId() << 40)
        for rows, data, offs in blocks(batches, "text"):
            raw, out = data.tobytes(), []
            for i, doc_id in enumerate(rows.column("doc_id").to_pylist()):
                text = raw[offs[i]:offs[i + 1]].decode("utf-8", "replace")
                stream.add(doc_id, np.array([*ids_with_added(encoder, text, added, find), cfg.end_id], dtype=np.uint32))
                if stream.size >= cfg.horizon:
                    out += stream.solve(last=False)
            yield _table(out)
        yield _table(stream.solve(last=True))
    return run


def pack_documents(docs: DataFrame, cfg: PackConfig) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.

    Needs doc_id and text; other columns are not read. A null or empty text is
    its closing id alone; repeated rows are documents of their own; null
    doc_ids are packed first. sequence_id is unique over the table; an empty
    table gives an empty one.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.sortWithinPartitions("doc_id", "text").mapInArrow(_pack(cfg), SCHEMA)
