"""Token counts of a unigram tokenizer without making the tokens.

An Aho-Corasick automaton over the vocabulary enumerates, at each position of a
word, the pieces that end there, longest first. Dynamic programming carries the
best score and the piece count; no path is kept. The rules are those of the
``tokenizers`` unigram model:

* a piece replaces the best path to its end only if its score is strictly
  larger, so of equal paths the one whose last piece is longer stays;
* where no piece is the single next character, that character can be an
  unknown, at 10 below the least score of the vocabulary;
* neighbouring unknowns fuse; a fused run that is itself a piece is one token,
  otherwise it counts its bytes if the vocabulary has all byte pieces, else one.

Spaces are written as the marker U+2581, and one is put before the text. The
text is cut before each marker that follows another character: no piece spans
such a place (a vocabulary that has one is not cut). Runs of markers stay whole,
as there are pieces of several. Counts of the parts are remembered within a
task, in a bounded table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowsieve.llm.arrow_text import blocks, small_batches

SPACE = "▁"
_PART = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


@dataclass(frozen=True)
class UnigramVocabulary:
    """Pieces with their scores, by id, and the id of the unknown piece."""

    pieces: tuple[tuple[str, float], ...]
    unknown: int = 0


def load_vocabulary(path: str) -> UnigramVocabulary:
    """Pieces and scores of a sentencepiece model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return UnigramVocabulary(tuple((sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())), sp.unk_id())


class WordCounter(dict):
    """Token count of a word, computed when first asked for."""

    def __init__(self, vocabulary: UnigramVocabulary, most: int = 1 << 19):
        import ahocorasick

        super().__init__()
        self.most = most
        self.known = {p for p, _ in vocabulary.pieces}
        self.bytes = all(f"<0x{b:02X}>" in self.known for b in range(256))
        # a newline is then always one unknown of one byte, and nothing spans it
        self.lines = self.bytes and all("\n" not in p and s == int(s) for p, s in vocabulary.pieces)
        # parts end before a marker behind another character
        self.parts = SPACE in self.known and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.known)
        self.unknown_score = min((s for _, s in vocabulary.pieces), default=0.0) - 10.0
        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(vocabulary.pieces):
            if piece:
                self.automaton.add_word(piece, (len(piece), score, i == vocabulary.unknown))
        if len(self.automaton):
            self.automaton.make_automaton()

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        n = self[word] = self.count(word)
        return n

    def _run(self, word: str, start: int, end: int) -> int:
        run = word[start:end]
        return 1 if run in self.known or not self.bytes else len(run.encode("utf-8", "surrogatepass"))

    def count(self, word: str) -> int:
        n = len(word)
        score, pieces, run = [0.0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        seen = [False] * (n + 1)  # a best path is known
        seen[0] = True
        matches = self.automaton.iter(word) if len(self.automaton) else iter(())
        nxt = next(matches, None)
        for end in range(1, n + 1):
            single = False
            while nxt is not None and nxt[0] == end - 1:
                length, s, unknown = nxt[1]
                nxt = next(matches, None)
                start = end - length
                single = single or length == 1
                got = s + score[start]
                if not seen[end] or got > score[end]:
                    self._extend(word, start, end, got, unknown, seen, score, pieces, run)
            if not single:
                got = self.unknown_score + score[end - 1]
                if not seen[end] or got > score[end]:
                    self._extend(word, end - 1, end, got, True, seen, score, pieces, run)
        return pieces[n] + (self._run(word, run[n], n) if run[n] >= 0 else 0)

    def _extend(self, word, start, end, got, unknown, seen, score, pieces, run) -> None:
        seen[end], score[end] = True, got
        if unknown:
            run[end] = run[start] if run[start] >= 0 else start
            pieces[end] = pieces[start]
        else:
            run[end] = -1
            pieces[end] = pieces[start] + 1 + (self._run(word, run[start], start) if run[start] >= 0 else 0)


def count_tokens(text: str, counter: WordCounter) -> int:
    """Tokens of a text; an empty text has none."""
    if not text:
        return 0
    text = text.replace(" ", SPACE)
    if not text.startswith(SPACE):
        text = SPACE + text
    lines = text.split("\n") if counter.lines else [text]
    total = len(lines) - 1
    for line in lines:
        total += sum(map(counter.__getitem__, _PART.findall(line) if counter.parts else [line] if line else []))
    return total


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """One row per input row: doc_id, n_tokens.

    Reads doc_id and text only; a null text has no tokens; repeated rows each
    get their count; an empty table gives an empty one. ``vocabulary_path``
    must be readable on the executors.
    """
    def run(batches):
        counter = WordCounter(load_vocabulary(vocabulary_path))
        for rows, data, offs in blocks(batches, "text"):
            raw = data.tobytes()
            n = np.array([count_tokens(raw[a:b].decode("utf-8", "replace"), counter) for a, b in zip(offs, offs[1:])],
                         dtype=np.int64)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n)], names=["doc_id", "n_tokens"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long")
