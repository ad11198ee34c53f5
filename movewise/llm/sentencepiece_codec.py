"""SentencePiece encoding and decoding (operator 7): an Aho-Corasick automaton drives Viterbi.

The automaton holds the model's pieces. One pass over a text visits its states; at each position the
output links give every piece that ends there, longest first, and each relaxes the best score. A
character that no piece covers costs the lowest score less 10 and becomes its bytes. The result is
the segmentation with the highest sum of piece scores (the first found, longest last piece, on ties).

Since no piece continues from a letter to a blank mark, blanks separate independent problems; a
bounded memo per worker keeps the ids of words. (A model with such pieces is encoded text by text.)

Scale: one pass without a shuffle; a worker holds the automaton, two generations of MEMO_WORDS words and MEMO_PARTS parts.

The model's own normaliser is not applied (texts are encoded as they are, which decoding needs), and its
user-defined pieces compete by their scores like others.

Cases: null and empty texts have no ids. A literal blank mark becomes bytes, so decoding returns every
text exactly. Very long words are solved in one pass, too, and not remembered. Repeated rows give equal
rows, ties of doc_id do not matter, an empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import identified, kept, map_arrow, real_id

MARK = "▁"
#: Stands for a literal mark in the text; it cannot occur in valid UTF-8.
LITERAL = "\udc81"
UNKNOWN_PENALTY = 10.0
#: Words and parts of words that a worker remembers, 0.2 kB each; of words two generations.
MEMO_WORDS, MEMO_PARTS = 60_000, 30_000


class Codec:
    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes_of: list[bytes] = [b""] * self.size
        self.byte_id = [0] * 256
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value], self.bytes_of[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.pieces[piece] = (i, model.get_score(i))
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
        self.unknown = min(s for _, s in self.pieces.values()) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, (i, score) in self.pieces.items():
            self.automaton.add_word(piece, (len(piece), i, score))
        self.automaton.make_automaton()
        self.kind, self.code = ("<u2", "H") if self.size <= 65536 else ("<u4", "I")
        letters = {c for p in self.pieces for c in p}
        loose = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in letters)
        self.cut = re.compile(f"[{loose}]|[^{loose}]+" if loose else ".+", re.S)
        self.separable = not any(a != MARK and b == MARK for p in self.pieces for a, b in zip(p, p[1:], strict=False))
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best segmentation of a text whose blanks are marks already."""
        n = len(text)
        best, link = [0.0] * (n + 1), [None] * (n + 1)  # score up to each position, and the piece that ends there (None: a character as bytes)
        done, unknown = 0, self.unknown
        for last, piece in self.automaton.iter(text):
            at = last + 1
            while done < at:
                best[done + 1] = best[done] + unknown
                done += 1
            total = best[at - piece[0]] + piece[2]
            if total > best[at]:
                best[at] = total
                link[at] = piece
        out: list[int] = []
        at = n
        while at:
            piece = link[at]
            if piece is not None:
                out.append(piece[1])
                at -= piece[0]
            else:
                c = text[at - 1]
                out.extend(self.byte_id[b] for b in reversed((MARK if c == LITERAL else c).encode()))
                at -= 1
        out.reverse()
        return out

    def _solved(self, part: str) -> bytes:
        return array(self.code, self.viterbi(part)).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a blank and a word, remembered. Characters that no piece has cut it further; such parts are remembered, too."""
        if (out := self.older.get(word)) is None:
            parts = self.cut.findall(MARK + word)
            out = self._solved(parts[0]) if len(parts) == 1 else b"".join(map(self._part, parts))
        if len(self.words) > MEMO_WORDS:
            self.older, self.words = self.words, {}
        if len(word) <= 64:
            self.words[word] = out
        return out

    def _part(self, part: str) -> bytes:
        if (out := self.parts.get(part)) is None:
            out = self._solved(part)
            if len(self.parts) > MEMO_PARTS:
                self.parts.clear()
            if len(part) <= 64:
                self.parts[part] = out
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, after the blank that the format puts in front."""
        if not text:
            return np.zeros(0, self.kind)
        if MARK in text:
            text = text.replace(MARK, LITERAL)
        if not self.separable:
            return np.array(self.viterbi(MARK + text.replace(" ", MARK)), self.kind)
        if text[0] == " " or "  " in text:  # a run of marks goes with the word after it
            parts = (y for x in re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", MARK + text.replace(" ", MARK)) for y in self.cut.findall(x))
            return np.frombuffer(b"".join(map(self._part, parts)), self.kind)
        get, miss = self.words.get, self._word
        return np.frombuffer(b"".join([get(w) or miss(w) for w in text.split(" ")]), self.kind)

    def decode(self, ids: np.ndarray) -> bytes:
        out = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        return out[1:] if out[:1] == b" " else out


def encode_report(docs: DataFrame, model: str) -> DataFrame:
    """One row per document: doc_id, n_ids, ids, ids_crc32 (of little-endian 32-bit ids), decoded_sha256, round_trip."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = kept(f"sentencepiece {model}", lambda: Codec(model))
        for batch in batches:
            ids = [c.encode(t) for t in batch["text"].to_pylist()]
            back = [c.decode(x) for x in ids]
            size = np.array([len(x) for x in ids], np.int64)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(flat))
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
            same = [a == b for a, b in zip(back, batch["text"].cast(pa.binary()).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["_id"], pa.array(size), lists, pa.array(crc, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()), pa.array(same, pa.bool_())], ["_id", "n_ids", "ids", "ids_crc32", "decoded_sha256", "round_trip"])

    rows = identified(docs).select("_id", "text")
    return map_arrow(rows, f"sentencepiece {model}", run, "_id long, n_ids long, ids array<int>, ids_crc32 long, decoded_sha256 string, round_trip boolean").select(real_id(), "n_ids", "ids", "ids_crc32", "decoded_sha256", "round_trip")
