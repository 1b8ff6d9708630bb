"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the model's pieces reads a text once.  At each
position it reports, by its output links, every piece that ends there, longest
first; each relaxes the best score of that position (Viterbi).  A character
that is no piece costs the lowest score less ten and is written as its bytes.

Scores are summed in double precision; among equal sums the longer last piece
wins.  The encoding is the best-scoring segmentation of the model's pieces, for
models of either kind.  Text is escaped as the model says (spaces as U+2581,
one put in front), nothing else is normalised, so decoding gives the text back.

In a vocabulary where U+2581 only begins pieces, no piece spans the end of a
word: words are then encoded apart and remembered within a task.

Edge cases: a null text counts as empty and has no ids.  Null ids and repeated
rows stay.  U+2581 in a text decodes as a space, as the format has it.  Extra
columns are neither read nor returned.  Empty table: empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Remembered words per task, and the longest that is remembered.
REMEMBERED, LONGEST = 300_000, 64
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_NO = float("-inf")


class Codec:
    """Pieces with scores; ``bytes_at`` is the id of the piece for byte 0, or None without byte pieces."""

    def __init__(self, pieces: list[tuple[str, float, int]], bytes_at: int | None, unknown_id: int, size: int):
        self.auto = ahocorasick.Automaton()
        for text, score, i in pieces:
            self.auto.add_word(text, (len(text), score, i))
        if pieces:
            self.auto.make_automaton()
        self.empty = not pieces
        self.single = {text for text, _, _ in pieces if len(text) == 1}
        self.unknown_score = min((s for _, s, _ in pieces), default=0.0) - UNKNOWN_PENALTY
        self.bytes_at, self.unknown_id = bytes_at, unknown_id
        self.by_word = all(SPACE not in text.lstrip(SPACE) for text, _, _ in pieces)
        self.memory: dict[str, bytes] = {}
        self.out = [b""] * size
        for text, _, i in pieces:
            self.out[i] = text.replace(SPACE, " ").encode()
        self.out[unknown_id] = " ⁇ ".encode()
        if bytes_at is not None:
            for b in range(256):
                self.out[bytes_at + b] = bytes([b])

    @classmethod
    def load(cls, path: str) -> Codec:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        byte = next((i for i in range(n) if m.is_byte(i)), None)
        pieces = [(m.id_to_piece(i), m.get_score(i), i) for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        return cls(pieces, byte, m.unk_id(), n)

    def best(self, s: str) -> list[int]:
        """Ids of the best segmentation of ``s``."""
        n = len(s)
        score, came, piece = [0.0] + [_NO] * n, [0] * (n + 1), [-1] * (n + 1)
        single, unknown, done = self.single, self.unknown_score, 0  # best scores up to ``done`` are final
        for end, (length, value, i) in () if self.empty else self.auto.iter(s):
            while done < end:
                done += 1
                if s[done - 1] not in single and score[done - 1] + unknown > score[done]:
                    score[done], came[done], piece[done] = score[done - 1] + unknown, done - 1, -1
            begin = end + 1 - length
            if (x := score[begin] + value) > score[end + 1]:
                score[end + 1], came[end + 1], piece[end + 1] = x, begin, i
        while done < n:
            done += 1
            if s[done - 1] not in single and score[done - 1] + unknown > score[done]:
                score[done], came[done], piece[done] = score[done - 1] + unknown, done - 1, -1
        ids: list[int] = []
        at = n
        while at > 0:
            if piece[at] >= 0:
                ids.append(piece[at])
            elif self.bytes_at is None:
                ids.append(self.unknown_id)
            else:
                ids += [self.bytes_at + b for b in reversed(s[came[at] : at].encode())]
            at = came[at]
        ids.reverse()
        return ids

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        s = SPACE + text.replace(" ", SPACE)
        if not self.by_word:
            return np.array(self.best(s), np.int32)
        memory, found = self.memory, []
        for w in _WORDS.findall(s):
            ids = memory.get(w)
            if ids is None:
                ids = np.array(self.best(w), np.int32).tobytes()
                if len(w) <= LONGEST:
                    if len(memory) >= REMEMBERED:
                        memory.clear()
                    memory[w] = ids
            found.append(ids)
        return np.frombuffer(b"".join(found), np.int32)

    def decode(self, ids: np.ndarray | list[int]) -> str:
        ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
        return b"".join(map(self.out.__getitem__, ids)).decode(errors="replace")[1:]


def _ids_array(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *parts])))


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", verify: bool = False) -> DataFrame:
    """Per row: id, ``ids`` (array of int), ``n_pieces``; with ``verify`` also ``round_trip``: decoding gives the text."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_pieces int, ids array<int>" + ", round_trip boolean" * verify

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(model_path)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                b = batch.slice(a, 256)
                texts = [t or "" for t in b.column(1).to_pylist()]
                parts = [codec.encode(t) for t in texts]
                columns = [b.column(0), pa.array([len(p) for p in parts], pa.int32()), _ids_array(parts)]
                if verify:
                    columns.append(pa.array([codec.decode(p) == t.replace(SPACE, " ") for p, t in zip(parts, texts)]))
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_pieces", "ids", "round_trip"][: len(columns)])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and ``text``. Null ids decode as the empty text."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(model_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([codec.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")
