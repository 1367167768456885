"""Piece encoding and decoding: an Aho-Corasick automaton drives a single-pass Viterbi.

A piece set (text, score) comes from a tokenizer file. Encoding maps every space to the mark
``\\u2581``, puts one mark in front and finds the piece sequence with the highest score sum. The
automaton reports, for each position, every piece that ends there by following its output links;
each report relaxes the best score at that position. A character that is no piece costs the lowest
score minus 10 and becomes its UTF-8 byte pieces. Sums are exact; on equal sums the longer last
piece wins. No piece has a mark after another character, so an optimal sequence never crosses the
start of a run of marks: text is cut there, and runs that were solved before are looked up (a
bounded memory per worker that changes no result).

Defined cases: null text has null ids and null decoded text; empty text has none; ids are decoded
to the text with marks as spaces, so a literal ``\\u2581`` comes back as a space (``exact`` is false).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loopweave.llm.common import slices

MARK = "▁"
UNKNOWN_PENALTY = 10.0
LOWEST = float("-inf")
MEMORY_WORDS = 150_000
MEMORY_CHARS = 64


class PieceCodec:
    """Encoder and decoder over pieces ``[(text, score)]`` and 256 byte ids."""

    def __init__(self, pieces: list[tuple[int, str, float]], byte_ids: list[int], unknown: int):
        self.text = {i: t for i, t, _ in pieces}
        self.size_of = {i: len(t) for i, t, _ in pieces}
        self.byte_ids = byte_ids
        self.byte_of = {i: b for b, i in enumerate(byte_ids)}
        self.unknown = unknown
        self.single = {t for _, t, _ in pieces if len(t) == 1}
        self.unknown_score = min((s for _, _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for i, t, s in pieces:
            self.automaton.add_word(t, (len(t), s, i))
        self.automaton.make_automaton()
        crossing = any(re.search(f"[^{MARK}]{MARK}", t) for _, t, _ in pieces)
        self.runs = re.compile(".+" if crossing else f"{MARK}+[^{MARK}]*|[^{MARK}]+", re.S)
        self.memory: dict[str, tuple[int, ...]] = {}

    def solve(self, run: str) -> tuple[int, ...]:
        """Ids of the best sequence for one run of characters."""
        if not self.single.issuperset(run):
            return self._solve_with_unknown(run)
        best = [0.0] + [LOWEST] * len(run)
        back = [0] * len(best)
        for last, (size, score, piece) in self.automaton.iter(run):
            end = last + 1
            score += best[end - size]
            if score > best[end]:
                best[end] = score
                back[end] = piece
        ids, end, size_of = [], len(run), self.size_of
        while end:
            ids.append(back[end])
            end -= size_of[back[end]]
        return tuple(reversed(ids))

    def _solve_with_unknown(self, run: str) -> tuple[int, ...]:
        """The same relaxation, where characters that are no piece may stand alone.

        An unknown character is the shortest way to its end, so it is tried after the reports there.
        """
        n = len(run)
        reports: list[list[tuple[int, float, int]]] = [[] for _ in range(n + 1)]
        for last, found in self.automaton.iter(run):
            reports[last + 1].append(found)
        best = [0.0] + [LOWEST] * n
        back = [-1] * (n + 1)
        for end in range(1, n + 1):
            for size, score, piece in reports[end]:
                if best[end - size] + score > best[end]:
                    best[end] = best[end - size] + score
                    back[end] = piece
            if run[end - 1] not in self.single and best[end - 1] + self.unknown_score > best[end]:
                best[end] = best[end - 1] + self.unknown_score
                back[end] = -1
        ids: list[int] = []
        end = n
        while end:
            if back[end] >= 0:
                ids.append(back[end])
                end -= self.size_of[back[end]]
                continue
            if self.byte_ids:
                ids.extend(self.byte_ids[b] for b in reversed(run[end - 1].encode("utf-8", "surrogatepass")))
            else:
                ids.append(self.unknown)
            end -= 1
        return tuple(reversed(ids))

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        memory, out = self.memory, []
        for run in self.runs.findall(MARK + text.replace(" ", MARK)):
            ids = memory.get(run)
            if ids is None:
                ids = self.solve(run)
                if len(run) <= MEMORY_CHARS:
                    if len(memory) >= MEMORY_WORDS:
                        memory.clear()
                    memory[run] = ids
            out.extend(ids)
        return out

    @lru_cache(maxsize=None)  # noqa: B019 - one entry per piece
    def _bytes(self, piece: int) -> bytes:
        if piece in self.byte_of:
            return bytes([self.byte_of[piece]])
        return self.text.get(piece, " ⁇ ").replace(MARK, " ").encode("utf-8", "surrogatepass")

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self._bytes, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    """The codec of a tokenizer file, built once per worker."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids = [], []
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            byte_ids.append(i)
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces.append((i, model.id_to_piece(i), float(model.get_score(i))))
    return PieceCodec(pieces, byte_ids, model.unk_id())


def default_path() -> str:
    """The place of the public 32k piece file on this machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


OUTPUT = "doc_id long, ids array<int>, n_ids long, decoded string, exact boolean"


def encode_documents(docs: DataFrame, path: str | None = None, with_text: bool = True) -> DataFrame:
    """doc_id, ids, n_ids, decoded, exact (decoded equals text) of every row of ``docs(doc_id, text)``.

    Other columns are ignored. ``path``: tokenizer file, the same on every machine.
    ``with_text=False`` leaves ``decoded`` null and still decodes to set ``exact``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path or default_path())
        for part in slices(batches, "text"):
            ids, sizes, decoded, exact = [], [], [], []
            for text in part.column(1).to_pylist():
                if text is None:
                    for out in (ids, sizes, decoded, exact):
                        out.append(None)
                    continue
                got = own.encode(text)
                back = own.decode(got)
                ids.append(np.array(got, dtype=np.int32))
                sizes.append(len(got))
                decoded.append(back if with_text else None)
                exact.append(back == text)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(ids, pa.list_(pa.int32())),
                    pa.array(sizes, pa.int64()),
                    pa.array(decoded, pa.string()),
                    pa.array(exact, pa.bool_()),
                ],
                names=["doc_id", "ids", "n_ids", "decoded", "exact"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, OUTPUT)
