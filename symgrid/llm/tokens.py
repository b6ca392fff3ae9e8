"""Problem 8: token ids of whole texts by a public byte-level BPE vocabulary.

Texts are cut into words by the vocabulary's pattern. The merges of a word are found on a contiguous array of ranks:
part boundaries with the rank of the pair that begins at each; the least rank is looked for again and again, its
boundary deleted and the neighbouring ranks refreshed. That is quadratic in the word, so words above ``SHORT`` bytes
(rulers of dashes, encoded blobs) use a heap with the same order of merges. The vocabulary file is read once, on
the driver. Each Python worker remembers the words it has met, so by Zipf's law few words are merged at all.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Where the vocabulary files lie; a parameter everywhere.
FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: Fixed value: the public pattern of words for this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHORT = 96
#: Words that a worker remembers at most; then it starts anew. A bound on memory, not on the words treated.
REMEMBERED = 400_000


def read_vocabulary(folder: str = FOLDER, vocabulary: str = VOCABULARY) -> bytes:
    """The vocabulary file, read where the driver runs; tasks get its bytes (1 MB or so) as a broadcast."""
    with open(f"{folder}/{vocabulary}.tiktoken", "rb") as f:
        return f.read()


class Encoder:
    """Ids of texts without special tokens."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.words = regex.compile(PATTERN).findall
        self.known = _Known(self)
        self.seen: dict[str, list[int]] = {}

    @staticmethod
    @functools.lru_cache(4)
    def of(vocabulary: bytes) -> Encoder:
        """The encoder of a vocabulary file's bytes; a worker makes it once."""
        return Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a})

    @staticmethod
    def load(folder: str = FOLDER, vocabulary: str = VOCABULARY) -> Encoder:
        return Encoder.of(read_vocabulary(folder, vocabulary))

    def merge_short(self, word: bytes) -> list[int]:
        """Ids of a word by the contiguous rank array."""
        ranks, none = self.ranks, 1 << 60
        if (whole := ranks.get(word)) is not None:
            return [whole]
        bounds = list(range(len(word) + 1))
        adjacent = [ranks.get(word[i : i + 2], none) for i in range(len(word) - 1)]
        while adjacent and (least := min(adjacent)) < none:
            i = adjacent.index(least)
            del bounds[i + 1], adjacent[i]
            if i < len(adjacent):
                adjacent[i] = ranks.get(word[bounds[i] : bounds[i + 2]], none)
            if i:
                adjacent[i - 1] = ranks.get(word[bounds[i - 1] : bounds[i + 1]], none)
        return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]

    def merge_long(self, word: bytes) -> list[int]:
        """The same for any length in n log n: pairs wait in a heap by rank and place, stale ones are skipped."""
        ranks, n = self.ranks, len(word)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= n or after[j] != end:
                continue
            alive[j], after[i] = False, end
            if end < n:
                before[end] = i
                if (r := ranks.get(word[i : after[end]])) is not None:
                    heapq.heappush(heap, (r, i, after[end]))
            if (h := before[i]) >= 0 and (r := ranks.get(word[h:end])) is not None:
                heapq.heappush(heap, (r, h, end))
        return [ranks[word[i : after[i]]] for i in range(n) if alive[i]]

    def word(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        return self.merge_short(raw) if len(raw) <= SHORT else self.merge_long(raw)

    def chunk(self, text: str) -> bytes:
        """Ids, as int32 bytes, of a stretch that no word crosses."""
        seen, ids = self.seen, []
        for w in self.words(text):
            if (known := seen.get(w)) is None:
                known = self.word(w)
                if len(w) <= SHORT:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[w] = known
            ids += known
        return np.array(ids, dtype=np.int32).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as int32 bytes.

        No word of the pattern has white space after another character, so white space begins a new stretch. Runs of
        several white characters are cut out with what is visible after them; the rest is cut at blanks, and equal
        pieces have equal ids.
        """
        known, out = self.known, []
        for i, part in enumerate(_RUNS(text)):
            if i % 2:
                out.append(known.block(part))
            elif part:
                head, *pieces = part.split(" ")
                if head:
                    out.append(known.of_head(head))
                out += map(known.__getitem__, pieces)
        return b"".join(out)

    def count(self, text: str) -> int:
        return len(self.encode(text)) // 4


_RUNS = regex.compile(r"(\s{2,}\S*)").split
_BLOCKS = regex.compile(r"\s*\S+|\s+").findall


class _Known(dict):
    """Ids of the pieces after a blank, by the piece without it; ``blocks``: of white space with the visible characters after it."""

    def __init__(self, encoder: Encoder) -> None:
        super().__init__()
        self.encoder, self.blocks = encoder, {}

    def block(self, block: str) -> bytes:
        if (ids := self.blocks.get(block)) is None:
            ids = self.encoder.chunk(block)
            if len(block) <= SHORT:
                if len(self.blocks) >= REMEMBERED:
                    self.blocks.clear()
                self.blocks[block] = ids
        return ids

    def of_head(self, text: str) -> bytes:
        return b"".join(map(self.block, _BLOCKS(text)))

    def __missing__(self, piece: str) -> bytes:
        ids = self.of_head(" " + piece)
        if len(piece) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids) of each row: the token ids of the whole text without special tokens.

    A null text and an empty one have no tokens: an empty list of ids, never null. Strings of special tokens in a text
    are ordinary text. Repeated rows give repeated results, extra columns are dropped. No shuffle.
    """
    kind = documents.schema[key].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(read_vocabulary(folder, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 1000):  # bounds the ids held at once
                piece = b.slice(at, 1000)
                ids = [encoder.encode(t) if t else b"" for t in piece.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)]) // 4
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([piece.column(0), lists], names=["k", "ids"])

    return documents.select(key, text).mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def count(documents: DataFrame, keep: list[str], text: str = "text", folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and n_tokens (0 for null and empty texts) of each row. No shuffle."""
    fields = ", ".join(f"c{i} {documents.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    shared = documents.sparkSession.sparkContext.broadcast(read_vocabulary(folder, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(shared.value)
        for b in batches:
            n = [encoder.count(t) if t else 0 for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(n, pa.int64())], names=[*[f"c{i}" for i in range(len(keep))], "n_tokens"])

    return documents.select(*keep, text).mapInArrow(run, f"{fields}, n_tokens long").toDF(*keep, "n_tokens")
