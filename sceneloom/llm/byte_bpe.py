"""Byte-level BPE by corpus-level merge replay.

Texts are split by the tokenizer's pattern. The pieces that a task hasn't met yet form its word table: one flat array
of token ids with links to the left and right neighbour. An inverted index maps the rank of every mergeable pair to
the positions where that pair stands; ranks are taken from a heap, lowest first, and a merge is applied at all its
positions at once, after which only the pairs that touch the merged tokens are looked up again. Within a word this is
the order of the usual encoder: lowest rank first, leftmost first where a pair overlaps itself.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, put, text_or_empty, tidy

#: Pieces that a worker remembers; beyond it the memory starts anew. It changes speed only.
REMEMBERED = 400_000
#: Bytes of text whose new pieces are replayed together.
BUFFER = 1 << 23


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class MergeReplay:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.decimal = [str(i) for i in range(len(self.tokens))]
        self._forget()

    def _forget(self) -> None:
        """Pieces met so far have numbers; their ids lie behind each other in one array."""
        self.known: dict[str, int] = {}
        self.ids, self.first, self.count, self.filled = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or -1."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], -1)

    def replay(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each word. All merges of all words in one run over the ranks."""
        if not words:
            return []
        flat = np.frombuffer(b"".join(words), np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        n = len(flat)
        if not n:
            return [()] * len(words)
        token = self.bytes[flat]
        follows = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        ends = np.cumsum(lengths)
        filled = lengths > 0
        follows[ends[filled] - 1] = n
        before[(ends - lengths)[filled]] = -1
        alive = np.ones(n, bool)
        pair = np.full(n + 1, -1, np.int64)
        inner = np.flatnonzero(follows < n)
        pair[inner] = self._rank(token[inner], token[inner + 1])
        index: dict[int, list[int]] = {}
        heap: list[int] = []

        def enter(positions: np.ndarray) -> None:
            found = pair[positions]
            some = found >= 0
            for rank, position in zip(found[some].tolist(), positions[some].tolist(), strict=True):
                if rank in index:
                    index[rank].append(position)
                else:
                    index[rank] = [position]
                    heapq.heappush(heap, rank)

        enter(inner)
        while heap:
            rank = heapq.heappop(heap)
            at = np.array(index.pop(rank), np.int64)
            at = at[pair[at] == rank]
            if len(at) > 1:
                at.sort()
                at = at[np.r_[True, at[1:] != at[:-1]]]
                # Of overlapping places (a right half that is itself a left half) every second one merges, from the left.
                linked = follows[at[:-1]] == at[1:]
                if linked.any():
                    place = np.arange(len(at))
                    run = place - np.maximum.accumulate(np.where(np.r_[False, linked], 0, place))
                    at = at[run % 2 == 0]
            elif not len(at):
                continue
            gone = follows[at]
            after = follows[gone]
            token[at] = rank
            alive[gone] = False
            pair[gone] = -1
            pair[at] = -1
            follows[at] = after
            inside = after < n
            right = at[inside]
            before[after[inside]] = right
            left = before[at]
            touched = np.concatenate([right, left[left >= 0]])
            pair[touched] = self._rank(token[touched], token[follows[touched]])
            enter(touched)
        kept = token[alive]
        counts = np.add.reduceat(np.r_[alive, False].astype(np.int64), np.minimum(ends - lengths, n)) if len(words) else []
        counts = np.where(filled, counts, 0)
        ids, out, start = kept.tolist(), [], 0
        for count in counts.tolist():
            out.append(tuple(ids[start : start + count]))
            start += count
        return out

    def _learn(self, start: int) -> None:
        """Ids of the pieces numbered from start."""
        words = self.replay([p.encode() for p in islice(self.known, start, None)])
        counts = np.fromiter(map(len, words), np.int64, len(words))
        self.first = put(self.first, start, self.filled + np.cumsum(counts) - counts)
        self.count = put(self.count, start, counts)
        self.ids = put(self.ids, self.filled, np.fromiter(chain.from_iterable(words), np.int32, int(counts.sum())))
        self.filled += int(counts.sum())

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text."""
        at = 0
        while at < len(texts):
            end, held = at, 0
            while end < len(texts) and (end == at or held + len(texts[end]) <= BUFFER):
                held += len(texts[end])
                end += 1
            if len(self.known) > REMEMBERED:
                self._forget()
            known, start = self.known, len(self.known)
            number = known.setdefault
            codes = [np.array([number(p, len(known)) for p in self.pattern.findall(t)], np.int32) for t in texts[at:end]]
            if len(known) > start:
                self._learn(start)
            for code in codes:
                count = self.count[code]
                upto = np.cumsum(count)
                yield self.ids[np.arange(int(count.sum())) + np.repeat(self.first[code] - upto + count, count)].tolist()
            at = end

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def codec(path: str, pattern: str) -> MergeReplay:
    """The vocabulary, read once per worker, or again when other operators had it meanwhile."""
    codecs = kept(__name__)
    if (path, pattern) not in codecs:
        codecs[path, pattern] = MergeReplay(read_ranks(path), pattern)
    return codecs[path, pattern]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (an array) and decoded_sha256 for every row; null texts count as empty and have no ids.

    Repeated rows are encoded each; an empty table gives an empty result; other columns are ignored. Every executor
    must have the vocabulary file at that path.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, pattern)
        for batch in _slices(batches):
            n, values, out_sha = [], [], []
            for ids in c.encode_all(batch.column("text").to_pylist()):
                n.append(len(ids))
                values.append(np.array(ids, np.int32))
                out_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
            offsets = pa.array(np.r_[0, np.cumsum(n)], pa.int32())
            arrays = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(values)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), arrays, pa.array(out_sha, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded_sha256"])

    return _texts(docs, id_col, text_col).mapInArrow(tidy(run, __name__), "doc_id bigint, n_tokens bigint, ids array<int>, decoded_sha256 string")


def encode_digests(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 for every row, as encode_documents, without handing the ids on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, pattern)
        for batch in _slices(batches):
            n, ids_sha, out_sha = [], [], []
            for ids in c.encode_all(batch.column("text").to_pylist()):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest())
                out_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs, id_col, text_col).mapInArrow(tidy(run, __name__), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs, text_col).alias("text"))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
