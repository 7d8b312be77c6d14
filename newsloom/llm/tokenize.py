"""Encoding of a corpus by a byte-level BPE vocabulary through a tokenization automaton.

The merges are compiled, one gadget per merge and in rank order, into a deterministic automaton
whose arcs are labelled with tokens and whose accepted paths are exactly the tokenizations that
BPE produces.  A gadget for the merge ``u v -> uv`` takes the state that all ``u`` arcs lead to,
makes a copy of it without the ``v`` arc, redirects the ``u`` arcs to the copy, and gives every
state with a ``u`` arc a ``uv`` arc to the state that ``v`` led to.  A copy differs from its
original by one arc only, so a state is stored as its parent plus the arc that it lacks.

Texts are pre-split into words; a word is cut further at byte pairs that stand next to each other
in no token of the vocabulary (no merge can cross them), and each distinct piece is run through
the automaton once per process.  Arc labels on the accepted path are the ids.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

#: The pre-split pattern published with the vocabulary.
PRESPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct words kept per Python process; the cache only saves work and is emptied beyond it.
CACHE_WORDS = 400_000
#: Answers about arcs kept per process, likewise.
CACHE_ARCS = 500_000


def default_vocabulary() -> str:
    """Path of the public vocabulary file; override with NEWSLOOM_BPE or the ``vocabulary`` argument."""
    if path := os.environ.get("NEWSLOOM_BPE"):
        return path
    return "/opt/tokenizers/byte_bpe_50k.json"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins for bytes in byte-level vocabularies: printable Latin-1 stands for
    itself, the other 68 bytes follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenAutomaton:
    """Deterministic automaton over tokens, compiled from a merge list.

    ``tokens``: bytes of every id; ``merges``: id pairs in rank order with the id they make.
    """

    def __init__(self, tokens: list[bytes], merges: list[tuple[int, int, int]]):
        self.id_of = {t: i for i, t in enumerate(tokens)}
        self.tokens = tokens
        # lengths of the tokens by their last two bytes, the longest first; one byte is always a token
        by_end: dict[bytes, set[int]] = {}
        for t in tokens:
            if len(t) > 1:
                by_end.setdefault(t[-2:], {1}).add(len(t))
        self.lengths = {k: tuple(sorted(v, reverse=True)) for k, v in by_end.items()}
        n = len(tokens)
        self.left = [-1] * n  # first half of the merge that made the token
        self.born = [-1] * n  # time of that merge
        # States: 0 is the start state, in which every byte has an arc.
        self.parent: list[int] = [-1]
        self.since: list[int] = [-1]
        self.leads_to = [0] * n  # state that all arcs with this label lead to
        self.lacks: dict[tuple[int, int], int] = {}  # (state, label) -> time of the loss
        for time, (u, v, uv) in enumerate(merges):
            self._gadget(time, u, v, uv)
        self._arc_memo: dict[tuple[int, int], bool] = {}
        adjacent = np.zeros((256, 256), bool)
        for t in tokens:
            b = np.frombuffer(t, np.uint8)
            adjacent[b[:-1], b[1:]] = True
        self.adjacent = adjacent

    def _gadget(self, time: int, u: int, v: int, uv: int) -> None:
        before = self.leads_to[u]
        target = self.leads_to[v]
        self.left[uv], self.born[uv] = u, time
        self.leads_to[uv] = target  # arc uv leads where v led when the gadget was made
        copy = len(self.parent)
        self.parent.append(before)
        self.since.append(time)
        self.lacks[copy, v] = time
        self.leads_to[u] = copy

    def has_arc(self, state: int, label: int) -> bool:
        """Does ``state`` have an arc with this label?  A label that was merged had its arc only if
        its first half had one when it was made, so the check climbs the left halves; a state lacks
        what it or an ancestor lost before the copy was taken."""
        key = (state, label)
        known = self._arc_memo.get(key)
        if known is None:
            known, part, limit = True, label, 1 << 60
            while known and part >= 0:
                s = state
                while s > 0:
                    lost = self.lacks.get((s, part))
                    if lost is not None:
                        if lost <= limit:  # equal: a token merged with itself, and the copy has neither arc
                            known = False
                        break
                    s = self.parent[s]
                limit, part = self.born[part], self.left[part]
            if len(self._arc_memo) > CACHE_ARCS:
                self._arc_memo.clear()
            self._arc_memo[key] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids on the only path of the automaton that spells ``piece``."""
        whole = self.id_of.get(piece)
        n = len(piece)
        if n == 1:
            return [whole]
        last, size = [-1] * (n + 1), [0] * (n + 1)
        state = [-1] * (n + 1)
        state[0] = 0
        get, lengths = self.id_of.get, self.lengths.get
        for end in range(1, n + 1):
            for length in lengths(piece[max(0, end - 2) : end], (1,)):
                begin = end - length
                if begin < 0:
                    continue
                s = state[begin]
                label = get(piece[begin:end]) if s >= 0 else None
                if label is not None and self.has_arc(s, label):
                    last[end], size[end], state[end] = label, end - begin, self.leads_to[label]
                    break
        out, at = [], n
        while at > 0:
            out.append(last[at])
            at -= size[at]
        return out[::-1]


@functools.cache
def load(vocabulary: str) -> "Encoder":
    return Encoder(vocabulary)


class Encoder:
    """A vocabulary file with its automaton, its pre-splitter and the ids of words seen so far."""

    def __init__(self, vocabulary: str):
        model = json.load(open(vocabulary, encoding="utf-8"))["model"]
        alphabet = byte_alphabet()
        spell = lambda s: bytes(map(alphabet.__getitem__, s))
        vocab = model["vocab"]
        tokens: list[bytes] = [b""] * len(vocab)
        for text, i in vocab.items():
            # Strings of special tokens are plain text here; they are no merges, so they get no arc.
            tokens[i] = spell(text) if all(c in alphabet for c in text) else b""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        made = {m[2] for m in merges}
        for i, t in enumerate(tokens):
            if len(t) > 1 and i not in made:
                tokens[i] = b""
        self.automaton = TokenAutomaton(tokens, merges)
        self.split = regex.compile(PRESPLIT).findall
        self.words: dict[str, bytes] = {}
        self.pieces: dict[bytes, bytes] = {}

    def _word(self, word: str) -> bytes:
        raw = word.encode("utf-8", "surrogatepass")
        known = self.pieces.get(raw)
        if known is not None:
            return known
        b = np.frombuffer(raw, np.uint8)
        cuts = (np.flatnonzero(~self.automaton.adjacent[b[:-1], b[1:]]) + 1).tolist()
        out, begin, pieces = [], 0, self.pieces
        for end in (*cuts, len(raw)):
            piece = raw[begin:end]
            ids = pieces.get(piece)
            if ids is None:
                if len(pieces) > CACHE_WORDS:
                    pieces.clear()
                ids = pieces[piece] = np.array(self.automaton.encode_piece(piece), np.int32).tobytes()
            out.append(ids)
            begin = end
        return b"".join(out)

    def encode_bytes(self, text: str) -> bytes:
        """Ids of ``text`` as little-endian 32-bit integers."""
        words = self.words
        out = []
        for word in self.split(text):
            ids = words.get(word)
            if ids is None:
                ids = self._word(word)
                if len(word) < 24:
                    if len(words) > CACHE_WORDS:
                        words.clear()
                    words[word] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text or ""), np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.automaton.tokens.__getitem__, ids)).decode("utf-8", "replace")


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``(id_col, ids array<int>)`` of every row.  One narrow pass, no shuffle.

    Null and empty texts give an empty list; blank texts are encoded like any other; repeated rows
    give repeated rows; strings that look like special tokens are plain text; an empty table gives
    an empty table.  Texts of any length are encoded whole.  Other columns are not read.  The vocabulary
    file is read where the driver runs and shipped to the executors.
    """
    vocabulary = vocabulary or default_vocabulary()
    docs.sparkSession.sparkContext.addFile(vocabulary)
    shipped = os.path.basename(vocabulary)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(SparkFiles.get(shipped))
        for batch in batches:
            for begin in range(0, max(batch.num_rows, 1), 1000):
                part = batch.slice(begin, 1000)
                coded = [encoder.encode_bytes(t) if t else b"" for t in part.column(1).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype(np.int32)
                values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(coded))])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([part.column(0), lists], [id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
