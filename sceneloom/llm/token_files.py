"""Token ids in compressed files: one wavelet matrix per shard.

A shard holds the ids of consecutive documents. Its file keeps the ids as a wavelet matrix: for each bit, highest
first, a bit-plane of the sequence as it stands after stable partitions by the bits above. Ranks over the planes give
access to any token, counts of an id in any range and the places of its occurrences without unpacking the rest: the
rank of every block stands in the file, and a plane is unpacked when a question first comes to it.
Files are blobs of a Parquet table in the shared folder, so any store that Spark can write will do.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import put, ranges_for, staged, text_or_empty
from .shingles import word_spans

MAGIC = b"WVM2"
SHARD_TOKENS = 1 << 19
END_ID = 1
#: Runs that a worker remembers; beyond it the memory starts anew. It changes speed only.
_WORDS_REMEMBERED = 800_000
_PIECES_REMEMBERED = 300_000
_BLOCK = 512
#: Bytes of text that are encoded at once; a longer text goes in parts that end at white space.
_SLICE_BYTES = 1 << 20


class WaveletMatrix:
    """Ids below 2**bits with access, rank and select.

    planes: packed bits of each plane, or its compressed frame; blocks: ones before every block of _BLOCK bits; zeros: zero bits of each plane.
    """

    def __init__(self, n: int, bits: int, planes: list[np.ndarray | bytes], blocks: list[np.ndarray], zeros: list[int]):
        self.n, self.bits, self._planes, self.blocks, self.zeros = n, bits, planes, blocks, zeros

    def plane(self, p: int) -> np.ndarray:
        found = self._planes[p]
        if isinstance(found, bytes):
            raw = zstandard.ZstdDecompressor().decompress(found, max_output_size=max(1, -(-self.n // 8)))
            found = self._planes[p] = np.frombuffer(raw, np.uint8)
        return found

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        kind = np.uint16 if bits <= 16 else np.uint32
        now, planes, blocks, zeros = ids.astype(kind), [], [], []
        for b in range(bits - 1, -1, -1):
            ones = (now >> kind(b) & kind(1)).astype(bool)
            planes.append(np.packbits(ones, bitorder="little"))
            counts = np.bitwise_count(planes[-1]).astype(np.int64)
            sums = np.r_[counts, np.zeros(-len(counts) % (_BLOCK // 8), np.int64)].reshape(-1, _BLOCK // 8).sum(1)
            blocks.append(np.r_[0, np.cumsum(sums)])
            zeros.append(len(ids) - int(counts.sum()))
            now = np.concatenate([now[np.flatnonzero(~ones)], now[np.flatnonzero(ones)]])
        return cls(len(ids), bits, planes, blocks, zeros)

    def _rank1(self, plane: int, i: int) -> int:
        """Ones before i."""
        block, data = i // _BLOCK, self.plane(plane)
        start = block * (_BLOCK // 8)
        whole = i // 8
        ones = int(self.blocks[plane][block]) + int(np.bitwise_count(data[start:whole]).sum())
        return ones + ((int(data[whole]) & ((1 << (i % 8)) - 1)).bit_count() if i % 8 else 0)

    def access(self, i: int) -> int:
        value = 0
        for p in range(self.bits):
            bit = int(self.plane(p)[i // 8]) >> (i % 8) & 1
            value = value << 1 | bit
            i = self.zeros[p] + self._rank1(p, i) if bit else i - self._rank1(p, i)
        return value

    def rank(self, token: int, i: int) -> int:
        """Occurrences of token before i."""
        start, end = self._range(token, i)
        return end - start

    def _range(self, token: int, i: int) -> tuple[int, int]:
        start, end = 0, i
        for p in range(self.bits):
            a, b = self._rank1(p, start), self._rank1(p, end)
            start, end = (self.zeros[p] + a, self.zeros[p] + b) if token >> (self.bits - 1 - p) & 1 else (start - a, end - b)
        return start, end

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence (from 0), or -1."""
        start, end = self._range(token, self.n)
        if not 0 <= k < end - start:
            return -1
        at = start + k
        for p in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - p) & 1
            at = self._select_bit(p, bit, at - self.zeros[p] if bit else at)
        return at

    def _select_bit(self, plane: int, bit: int, k: int) -> int:
        blocks = self.blocks[plane] if bit else np.arange(len(self.blocks[plane])) * _BLOCK - self.blocks[plane]
        block = int(np.searchsorted(blocks, k, side="right")) - 1
        part = np.unpackbits(self.plane(plane)[block * (_BLOCK // 8) : (block + 1) * (_BLOCK // 8)], bitorder="little")
        return block * _BLOCK + int(np.flatnonzero(part == bit)[k - int(blocks[block])])

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.rank(token, self.n))]

    def all(self) -> np.ndarray:
        """The whole sequence: the partitions undone from the lowest plane up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for p in range(self.bits - 1, -1, -1):
            ones = np.unpackbits(self.plane(p), count=self.n, bitorder="little").astype(bool)
            up = np.empty(self.n, kind)
            # Places are much quicker than masks for bits without order.
            up[np.flatnonzero(~ones)] = now[: self.zeros[p]]
            up[np.flatnonzero(ones)] = now[self.zeros[p] :] | kind(1 << (self.bits - 1 - p))
            now = up
        return now

    def to_bytes(self) -> bytes:
        """Magic, n, bits, CRC; then for each plane its zeros and the length of its frame; the ranks of the blocks; the frames."""
        pack = zstandard.ZstdCompressor(level=1).compress
        frames = [pack(self.plane(p).tobytes()) for p in range(self.bits)]
        ranks = pack(np.concatenate([np.diff(b).astype("<u2") for b in self.blocks]).tobytes())
        body = struct.pack("<I", len(ranks)) + b"".join(struct.pack("<qI", z, len(f)) for z, f in zip(self.zeros, frames, strict=True)) + ranks + b"".join(frames)
        return MAGIC + struct.pack("<qiI", self.n, self.bits, zlib.crc32(body)) + body

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        if data[:4] != MAGIC or len(data) < 24:
            raise ValueError("not a token file")
        n, bits, crc = struct.unpack_from("<qiI", data, 4)
        if zlib.crc32(memoryview(data)[20:]) != crc:
            raise ValueError("a damaged token file")
        (length,), at = struct.unpack_from("<I", data, 20), 24
        heads = [struct.unpack_from("<qI", data, at + 12 * p) for p in range(bits)]
        at += 12 * bits
        ranks = zstandard.ZstdDecompressor().decompress(data[at : at + length], max_output_size=max(1, bits * (2 * (-(-n // _BLOCK)))))
        ones = np.frombuffer(ranks, "<u2").astype(np.int64).reshape(bits, -1)
        at, frames = at + length, []
        for _, size in heads:
            frames.append(data[at : at + size])
            at += size
        return cls(n, bits, frames, [np.r_[0, np.cumsum(row)] for row in ones], [z for z, _ in heads])


#: What the quick way below stands for: this normaliser and this splitting, on words of these characters.
_QUICK_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_QUICK_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_QUICK_WORD = re.compile("[!-~\u00a1-\u00ac\u00ae-\u017e]*")
#: Letters whose small form is one letter, with punctuation behind them that holds no apostrophe: the splitting makes a piece of each part.
_LETTERS_AND_TAIL = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e]+)([!-&(-/:-@[-`{-~]*)")


def byte_symbols() -> list[str]:
    """The visible character that byte-level vocabularies write for each byte: printable Latin-1 stands for itself, the others follow from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space and works within the runs between it, so that each run needs encoding once.

    Runs are told apart by their bytes, and those met before are remembered. A run of Latin characters is normalised
    and split here where the tokenizer's settings are known, and its pieces go to the library's BPE model; any other run,
    and any that holds the string of a special token, goes through the whole library. As in the library's own setting, such a string
    becomes the special id, unless special_as_text.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        # One thread: Spark runs a task per core already, and threads would each keep memory of their own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.size = self.tokenizer.get_vocab_size()
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        split = (settings.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        wanted = [{"type": "Split", "pattern": {"Regex": _QUICK_PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
        self.quick = settings.get("normalizer") == _QUICK_NORMALIZER and split == wanted
        added = [t["content"] for t in settings.get("added_tokens") or []]
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE) if added else None
        self.pattern = regex.compile(_QUICK_PATTERN)
        self.symbols = dict(enumerate(byte_symbols()))
        self.tokenize = self.tokenizer.model.tokenize
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        # Ids as the bytes of 32-bit numbers: small, and the garbage collector need not visit them.
        self.pieces: dict[str, bytes] = {}
        # Entry 0 is the end of a document. The arrays grow by doubling.
        self.entries = self.filled = 1
        self.ids, self.first, self.count = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.ones(1 << 14, np.int64)

    def word(self, text: str) -> bytes:
        """Ids of one run without white space, as the bytes of 32-bit numbers."""
        if self.quick and (parts := _LETTERS_AND_TAIL.fullmatch(text)):
            letters, tail = parts.groups()
            letters = letters.lower()
            ids = self.pieces.get(letters) or self._piece(letters)
            return ids + (self.pieces.get(tail) or self._piece(tail)) if tail else ids
        if not (self.quick and _QUICK_WORD.fullmatch(text)) or (self.added and self.added.search(text)):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join([self.pieces.get(piece) or self._piece(piece) for piece in self.pattern.findall(text.lower())])

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.symbols)
        ids = self.pieces[piece] = array("I", [t.id for t in self.tokenize(shown)]).tobytes()
        return ids

    def _learn(self, words: list[bytes]) -> None:
        found = [self.word(word.decode()) for word in words]
        counts = np.fromiter(map(len, found), np.int64, len(found)) // 4
        self.known.update(zip(words, range(self.entries, self.entries + len(words)), strict=True))
        self.first = put(self.first, self.entries, self.filled + np.cumsum(counts) - counts)
        self.count = put(self.count, self.entries, counts)
        ids = np.frombuffer(b"".join(found), np.uint32)
        self.ids = put(self.ids, self.filled, ids)
        self.entries += len(words)
        self.filled += len(ids)

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with end_id behind; number of ids of each text). Texts are taken together up to _SLICE_BYTES."""
        ids, sizes, group, held = [np.zeros(0, np.uint32)], [], [], 0
        for text in texts:
            if group and held + len(text) > _SLICE_BYTES:
                self._take(group, end_id, ids, sizes)
                group, held = [], 0
            group.append(text)
            held += len(text)
        if group:
            self._take(group, end_id, ids, sizes)
        return np.concatenate(ids), np.array(sizes, np.int64)

    def _take(self, texts: list[bytes], end_id: int, ids: list[np.ndarray], sizes: list[int]) -> None:
        if len(texts) > 1 or len(texts[0]) <= _SLICE_BYTES:
            got, counts = self._encode(texts, end_id)
            ids.append(got)
            sizes += counts.tolist()
            return
        text, at, total = texts[0], 0, 1
        while at < len(text):
            found = _SPACE.search(text, at + _SLICE_BYTES)
            end = found.start() if found else len(text)
            got, counts = self._encode([text[at:end]], end_id)
            ids.append(got[:-1])
            total += int(counts[0]) - 1
            at = end
        ids.append(np.array([end_id], np.uint32))
        sizes.append(total)

    def _encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > _WORDS_REMEMBERED:
            self._forget()
        if len(self.pieces) > _PIECES_REMEMBERED:
            self.pieces.clear()
        self.ids[0] = end_id
        data = b"\n".join(texts)
        starts, ends, hashes = word_spans(data)
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        words = [data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        if not _same_bytes(data, starts, ends, first[which]):
            # Two runs have one hash: here all are told apart by their bytes alone.
            words, which = np.unique(np.array([data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], object), return_inverse=True)
            words = words.tolist()
        place = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = np.arange(self.entries, self.entries + len(new))
            self._learn([words[i] for i in new.tolist()])
        entry = place[which]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        words_before = np.searchsorted(starts, np.cumsum(lengths + 1) - 1)
        entry = np.insert(entry, words_before, 0)
        count = self.count[entry]
        upto = np.cumsum(count)
        place = np.arange(int(upto[-1])) - np.repeat(upto - count - self.first[entry], count)
        ends_at = upto[words_before + np.arange(len(texts))]
        return self.ids[place], np.diff(np.r_[0, ends_at])


def _same_bytes(data: bytes, starts: np.ndarray, ends: np.ndarray, model: np.ndarray) -> bool:
    """Whether every run equals, byte by byte, the run that model names for it."""
    lengths = ends - starts
    if not np.array_equal(lengths, lengths[model]):
        return False
    flat = np.frombuffer(data, np.uint8)
    others = np.flatnonzero(starts != starts[model])
    starts, moved, lengths = starts[others], (starts[model] - starts)[others], lengths[others]
    begins = np.cumsum(lengths) - lengths
    kind = np.int32 if len(data) < 1 << 31 else np.int64
    own = np.arange(int(lengths.sum()), dtype=kind) + np.repeat((starts - begins).astype(kind), lengths)
    return np.array_equal(flat[own], flat[own + np.repeat(moved.astype(kind), lengths)])


_encoders: dict[tuple[str, bool], WordEncoder] = {}


def _encoder(path: str, special_as_text: bool) -> WordEncoder:
    key = (path, special_as_text)
    if key not in _encoders:
        _encoders[key] = WordEncoder(*key)
    return _encoders[key]


_SHARD_SCHEMA = "part int, seq int, n_tokens long, doc_ids binary, nulls binary, sizes binary, blob binary"


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> DataFrame:
    """Encodes the texts in ascending order of id (null ids first) and writes the shard files; returns the table of files.

    A shard ends after the document that fills it. A null text counts as empty and has the end id alone. Rows repeated
    under one id follow each other. The string of a special token becomes its id, as by the library's default, unless special_as_text. Every executor must have the vocabulary file at that path.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs, text_col).alias("text"))
    ordered = rows.repartitionByRange(ranges_for(docs), "doc_id").sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, special_as_text)
        bits = max(1, (max(encoder.size, end_id + 1) - 1).bit_length())
        ids, sizes, names, held, seq, part = [], [], [], 0, 0, 0
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]

        def shard() -> pa.RecordBatch:
            tokens, keys = np.concatenate(ids), pa.concat_arrays(names)
            blank = np.asarray(keys.is_null().to_numpy(zero_copy_only=False), np.uint8)
            row = [part, seq, len(tokens), keys.fill_null(0).to_numpy().astype("<i8").tobytes(), np.packbits(blank).tobytes(), np.concatenate(sizes).astype("<i8").tobytes(), WaveletMatrix.build(tokens, bits).to_bytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["part", "seq", "n_tokens", "doc_ids", "nulls", "sizes", "blob"])

        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                part = batch.column("part")[0].as_py()
                got, lengths = encoder.encode([t.as_buffer().to_pybytes() for t in batch.column("text")], end_id)
                upto, row, keys = np.cumsum(lengths), 0, batch.column("doc_id")
                while row < len(lengths):
                    start = int(upto[row - 1]) if row else 0
                    # Documents up to the one that fills the shard, or all that are left.
                    full = int(np.searchsorted(upto, start + shard_tokens - held))
                    end = min(full + 1, len(lengths))
                    ids.append(got[start : int(upto[end - 1])])
                    sizes.append(lengths[row:end])
                    names.append(keys.slice(row, end - row))
                    held += int(upto[end - 1]) - start
                    row = end
                    if full < len(lengths):
                        yield shard()
                        ids, sizes, names, held, seq = [], [], [], 0, seq + 1
        if ids:
            yield shard()

    return staged(ordered.mapInArrow(run, _SHARD_SCHEMA), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("t"))
    # A row per task that wrote files; files of a task are summed apart.
    before = parts.select("part", F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("seq_start")).join(before, "part")
    starts = starts.select("part", "seq", (F.col("part_start") + F.col("seq_start")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                tokens = WaveletMatrix.from_bytes(row["blob"]).all().astype("<u4")
                sizes = np.frombuffer(row["sizes"], "<i8")
                ends = np.cumsum(sizes)
                blank = np.unpackbits(np.frombuffer(row["nulls"], np.uint8), count=len(sizes)).astype(bool)
                view = memoryview(tokens.tobytes())
                crc = [zlib.crc32(view[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(row["doc_ids"], "<i8"), pa.int64(), mask=blank), pa.array(row["start"] + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    joined = files.select("part", "seq", "doc_ids", "nulls", "sizes", "blob").join(starts, ["part", "seq"])
    return joined.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_occurrences(files: DataFrame, token: int) -> DataFrame:
    """part, seq, place of every occurrence of an id, by select on the files; place counts ids within the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, blob in zip(batch.column("part").to_pylist(), batch.column("seq").to_pylist(), batch.column("blob"), strict=True):
                places = WaveletMatrix.from_bytes(blob.as_buffer().to_pybytes()).occurrences(token)
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(places), pa.int32()), pa.array([seq] * len(places), pa.int32()), pa.array(places, pa.int64())], names=["part", "seq", "place"])

    return files.select("part", "seq", "blob").mapInArrow(run, "part int, seq int, place bigint")
