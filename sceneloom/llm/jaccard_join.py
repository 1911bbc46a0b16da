"""N-gram Jaccard join: documents whose word shingle sets overlap by a given share, and their components.

Equal sets are one class from the start. The tokens of a set are put in one order for all sets, rare first; rarity
is that of hash cells counted over the whole corpus, so that the order needs a table of fixed size. Two sets that
are similar enough share a token among their first n - ceil(t * n) + 1, so only these prefixes are joined. A bucket is the
sets that share a prefix token. Pairs of small buckets pass the length, positional and suffix filters and are
verified once, on the whole sets. Prefix tokens that only one set has, which are most, are found before and aren't shuffled.

The sets of a large bucket aren't paired with each other. They are held against the bucket's hub, its most
connected set, and of each only the difference D from the hub is kept. With c = (1 - t) / (1 + t), two sets x, y link where
|D_x| + |D_y| - 2 |D_x & D_y| <= c (|x| + |y|). So with f(x) = |D_x| - c |x|, those with f(x) + f(y) <= 0 link whatever
their differences are, and then both link with the set of the smallest f, which makes a star of them; all others must
share (f(x) + f(y)) / 2 tokens of their differences. They are found by a prefix join of the differences, whose condition
also holds a bitmap filter: the bits in which hashed sets differ are no more than the tokens in which they do, so
that nearly all pairs that leave the join do link. These are verified on the differences. Whole sets have such bitmaps too, and
texts are fetched only for pairs that pass all filters. Sets far from the hub go on
to further turns with other hubs, twice as many in each, until no bucket has rows: by the triangle inequality they can't
link with those close to a hub. No link between components is lost; within a star only links with its centre are named.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, ranges_for, staged, text_or_empty, tidy
from .components import connected_components
from .shingles import shingle_set
from .substring_dedup import COUNT_BITS, elsewhere, pack_sorted, range_cuts

CELL_BITS = 20
BLOCK_BITS = 14
#: Hash ranges over which the suffix filter bounds the overlap.
RANGES = 32
#: Bits of a whole set's bitmap.
SET_BITS = 1024
#: Sets of a bucket up to which all its pairs are candidates.
SMALL = 8
#: The same once hubs have taken out the families of a bucket: what is left is so mixed that nearly all its pairs fall to the filters.
SMALL_LATER = 32
#: Turns with one hub for each large bucket; in every later turn there are twice as many.
TURNS = 2
#: Bits of the bitmap filter, in words of 64.
MASK_WORDS = 8
#: Distance from a hub (1 - Jaccard), in percent, up to which a set has met all its partners around it: the differences of sets are kept up to this and the distance at which two link.
INNER = 35
#: Prefix tokens in a block.
BLOCK_TOKENS = 1 << 19
_FAN_IN = 256


def needed(nx: Column, ny: Column, percent: int) -> Column:
    """Smallest overlap of sets of these sizes with 100 * overlap >= percent * union."""
    return F.ceil(F.lit(percent) * (nx + ny) / F.lit(100 + percent))


def _profiles(k: int):
    """Rows (doc_id, hash, n, sid, ranges, bits) of the documents, and at a task's end its counts of hash cells in blocks."""
    names = ["doc_id", "hash", "n", "sid", "ranges", "bits", "block", "task", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.binary()]

    def rows(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, task = np.zeros(1 << CELL_BITS, np.int64), 0
        for batch in batches:
            task = batch.column("task")[0].as_py()
            n, sid, ranges, bits = [], [], [], []
            for value in batch.column("text"):
                tokens = shingle_set(value.as_buffer().to_pybytes(), k)
                n.append(len(tokens))
                sid.append(set_id(tokens))
                ranges.append(range_counts(tokens))
                bits.append(bitmap(tokens, SET_BITS))
                np.add.at(cells, (tokens & np.uint64((1 << CELL_BITS) - 1)).astype(np.int64), 1)
            none = [None] * len(n)
            yield rows([batch.column("doc_id").to_pylist(), batch.column("hash").to_pylist(), n, sid, ranges, bits, none, none, none])
        pack = zstandard.ZstdCompressor(level=1).compress
        blocks = cells.reshape(-1, 1 << BLOCK_BITS)
        used = [i for i in range(len(blocks)) if blocks[i].any()]
        if used:
            none = [None] * len(used)
            yield rows([none, none, none, none, none, none, used, [task] * len(used), [pack(blocks[i].tobytes()) for i in used]])

    return run, "doc_id bigint, hash bigint, n bigint, sid bigint, ranges binary, bits binary, block int, task bigint, counts binary"


def set_id(tokens: np.ndarray) -> int | None:
    """64 bits of a digest of the sorted set; equal sets have equal ids."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True) if len(tokens) else None


def range_counts(tokens: np.ndarray) -> bytes:
    return np.bincount((tokens >> np.uint64(59)).astype(np.int64), minlength=RANGES).astype("<u4").tobytes()


def bitmap(tokens: np.ndarray, size: int) -> bytes:
    """A bit for each token, by its hash."""
    bits = np.zeros(size, np.uint8)
    bits[(tokens >> np.uint64(40)).astype(np.int64) % size] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def rarity(blocks: DataFrame) -> np.ndarray:
    """Rank of every hash cell, coarse and rare first: a byte per cell, whatever the size of the corpus."""

    def add(frame):
        unpack = zstandard.ZstdDecompressor().decompress
        total = np.zeros(1 << BLOCK_BITS, np.int64)
        for data in frame["counts"]:
            total += np.frombuffer(unpack(data), np.int64)
        frame = frame.iloc[:1].copy()
        frame["counts"] = [zstandard.ZstdCompressor(level=1).compress(total.tobytes())]
        return frame[["block", "task", "counts"]]

    schema = "block int, task bigint, counts binary"
    last = blocks.agg(F.max("task")).first()[0] or 0
    while True:
        # A group holds _FAN_IN blocks at most, however many tasks there were.
        blocks = blocks.withColumn("task", F.floor(F.col("task") / _FAN_IN).cast("long")).groupBy("block", "task").applyInPandas(add, schema)
        if last < _FAN_IN:
            break
        last //= _FAN_IN
    out = np.zeros(1 << CELL_BITS, np.int64)
    for row in blocks.collect():
        out[row["block"] << BLOCK_BITS : row["block"] + 1 << BLOCK_BITS] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(row["counts"])), np.int64)
    return np.minimum(255, np.log2(out + 1) * 8).astype(np.uint8)


def ordered_prefix(tokens: np.ndarray, ranks: np.ndarray, percent: int) -> np.ndarray:
    """The tokens of a set's prefix, rare first."""
    n = len(tokens)
    length = n - -(-percent * n // 100) + 1
    rank = ranks[(tokens & np.uint64((1 << CELL_BITS) - 1)).astype(np.int64)]
    return tokens[np.lexsort((tokens, rank))[:length]]


def _prefixes(k: int, percent: int, shared):
    """The prefixes of about BLOCK_TOKENS tokens in one compressed row."""
    names = ["block", "n", "tokens", "sets"]
    kinds = [pa.string(), pa.int32(), pa.binary(), pa.binary()]

    def block(prefixes: list[np.ndarray], sets: list[tuple[int, int, int]]) -> pa.RecordBatch:
        tokens = np.concatenate(prefixes)
        row = [uuid.uuid4().hex, len(tokens), tokens.tobytes(), zstandard.ZstdCompressor(level=1).compress(np.array(sets, "<i8").tobytes())]
        return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, seen = shared.value, set()
        prefixes, sets, held = [], [], 0
        for batch in batches:
            for value in batch.column("text"):
                tokens = shingle_set(value.as_buffer().to_pybytes(), k)
                name = set_id(tokens)
                # A set that this task has had already gives no rows again; forgetting some only repeats rows.
                if name is None or name in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(name)
                prefix = ordered_prefix(tokens, ranks, percent)
                prefixes.append(prefix)
                sets.append((name, len(tokens), len(prefix)))
                held += len(prefix)
                if held >= BLOCK_TOKENS:
                    yield block(prefixes, sets)
                    prefixes, sets, held = [], [], 0
        if sets:
            yield block(prefixes, sets)

    return run, "block string, n int, tokens binary, sets binary"


def _sent(ranges: int):
    """The distinct tokens of each block, by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch.column("block").to_pylist(), batch.column("tokens"), strict=True):
                kinds = np.unique(np.frombuffer(body.as_buffer(), "<u8") >> np.uint64(64 - COUNT_BITS))
                cuts = range_cuts(kinds, ranges)
                used = np.flatnonzero(np.diff(cuts)).tolist()
                parts = [kinds[cuts[i] : cuts[i + 1]] for i in used]
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([name] * len(used)), pa.array(list(map(len, parts)), pa.int32()), pa.array(list(map(pack_sorted, parts)), pa.binary())], names=["range", "block", "n", "tokens"])

    return run, "range int, block string, n int, tokens binary"


def _met(ranges: int):
    """token, sid, n, pos of the blocks' tokens that another block, or another set of the same one, may have too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for body, packed, replies in zip(batch.column("tokens"), batch.column("sets"), batch.column("replies"), strict=True):
                tokens = np.frombuffer(body.as_buffer(), "<u8")
                sid, size, length = np.frombuffer(unpack(packed.as_buffer()), "<i8").reshape(-1, 3).T
                values, which, counts = np.unique(tokens >> np.uint64(64 - COUNT_BITS), return_inverse=True, return_counts=True)
                flags, cuts = counts > 1, range_cuts(values, ranges)
                for reply in replies.as_py() or []:
                    a, b = int(cuts[reply["range"]]), int(cuts[reply["range"] + 1])
                    flags[a:b] |= np.unpackbits(np.frombuffer(reply["bits"], np.uint8), count=b - a).astype(bool)
                at = np.flatnonzero(flags[which])
                owner = np.repeat(np.arange(len(sid)), length)[at]
                place = at - (np.cumsum(length) - length)[owner]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (tokens[at].view(np.int64), sid[owner], size[owner].astype(np.int32), place.astype(np.int32))], names=["token", "sid", "n", "pos"])

    return run, "token bigint, sid bigint, n int, pos int"


def _live(texts: DataFrame, k: int, percent: int, shared) -> DataFrame:
    """token, sid, n, pos: the staged prefix tokens that two sets or more have, once for each set.

    Most tokens of prefixes stand in one set only. They go no farther than to a hash range, in sorted and packed numbers, from which a bit for each comes back.
    """
    run, schema = _prefixes(k, percent, shared)
    blocks = staged(texts.select("text").mapInArrow(tidy(run), schema), "jaccard-prefixes")
    ranges = ranges_for(texts, 8)
    run, schema = _sent(ranges)
    # Tokens are hashes and each block has them once, so that ranges are even whatever the texts repeat.
    replies = staged(blocks.mapInArrow(tidy(run), schema).groupBy("range").applyInArrow(elsewhere, "block string, range int, bits binary"), "jaccard-replies")
    answered = blocks.join(replies.groupBy("block").agg(F.collect_list(F.struct("range", "bits")).alias("replies")), "block", "left").select("tokens", "sets", "replies")
    run, schema = _met(ranges)
    met = staged(answered.mapInArrow(tidy(run), schema), "jaccard-met", 8)
    drop_staged(blocks, replies)
    buckets = met.groupBy("token").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).where("low < high").select("token")
    live = staged(met.join(buckets, "token").distinct(), "jaccard-live")
    drop_staged(met)
    return live


def _own_text(k: int):
    """Keeps the rows whose text has the set that sid names; where an id is repeated or null there are others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [set_id(shingle_set(text.as_buffer().to_pybytes(), k)) == sid for sid, text in zip(batch.column("sid").to_pylist(), batch.column("text"), strict=True)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return run


def _filtered(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """x, y of pairs (x, y; a row per shared token) that pass the filters, once each."""
    return _bounded(pairs.select("x", "y").distinct(), sets, percent)


def _bounded(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """x, y of the pairs whose counts by range and whose bitmaps leave room for the similarity."""
    left = sets.select(F.col("sid").alias("x"), F.col("ranges").alias("rx"), F.col("bits").alias("bx"))
    right = sets.select(F.col("sid").alias("y"), F.col("ranges").alias("ry"), F.col("bits").alias("by"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, RANGES).astype(np.int64) for c in ("rx", "ry"))
                u, v = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u8").reshape(len(a), -1) for c in ("bx", "by"))
                total = (a + b).sum(1)
                common = np.minimum(np.minimum(a, b).sum(1), (total - np.bitwise_count(u ^ v).sum(1, dtype=np.int64)) // 2)
                good = pa.array((100 + percent) * common >= percent * total)
                yield pa.RecordBatch.from_arrays([batch.column("x").filter(good), batch.column("y").filter(good)], names=["x", "y"])

    return pairs.select("x", "y").join(left, "x").join(right, "y").select("x", "y", "rx", "ry", "bx", "by").mapInArrow(tidy(bound), "x bigint, y bigint")


def similar_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", turns: int = TURNS) -> DataFrame:
    """doc_id, n_shingles, component_id for every row.

    Words are runs without white space, A-Z as a-z. Two documents link when 100 * intersection >= percent * union of their
    sets of k-word shingles; a document with fewer words has its whole sequence as its one shingle, and one without
    words (or with a null text) has an empty set and links with nothing. component_id is the smallest id reachable by links.
    Rows repeated under one id are nodes of their own with that id; null ids take part but never name a component.
    """
    spark = docs.sparkSession
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs, text_col).alias("text")).withColumn("hash", F.xxhash64("text"))
    run, schema = _profiles(k)
    profiles = staged(texts.withColumn("task", F.spark_partition_id().cast("long")).mapInArrow(tidy(run), schema), "jaccard-profiles")
    base = profiles.where("block IS NULL").select("doc_id", "n", "sid")
    shared = spark.sparkContext.broadcast(rarity(profiles.where("block IS NOT NULL").select("block", "task", "counts")))
    live = _live(texts, k, percent, shared)
    chosen = staged(_chosen(profiles, live), "jaccard-sets")
    bodies, links, state = None, [], live
    for turn in count():
        sizes = state.groupBy("token").agg(F.count(F.lit(1)).alias("m"))
        sized = state.join(sizes.where("m > 1"), "token")
        most = SMALL_LATER if turn else SMALL
        pairs = _filtered(_bucket_pairs(sized.where(F.col("m") <= most), percent), chosen, percent).withColumn("star", F.lit(False))
        many = staged(sized.where(F.col("m") > most), "jaccard-many")
        more = bool(many.take(1))
        if more:
            dealt = staged(_dealt(many, 2 ** max(0, turn - turns + 1)), "jaccard-dealt")
            stars = _bounded(dealt.select(F.col("sid").alias("x"), F.col("hub").alias("y")).distinct(), chosen, percent - INNER)
            pairs = pairs.unionByName(stars.withColumn("star", F.lit(True)))
        pairs = staged(pairs, "jaccard-pairs")
        if bodies is None:
            # Later turns are about sets that now are in large buckets.
            wanted = pairs.select(F.col("x").alias("sid")).union(pairs.select("y")).union(many.select("sid")).distinct()
            bodies = _bodies(texts, chosen.join(wanted, "sid", "left_semi"), k)
            read = bodies
        else:
            named = pairs.select(F.col("x").alias("sid")).union(pairs.select("y")).distinct()
            read = staged(bodies.join(named, "sid", "left_semi"), "jaccard-bodies")
        run, schema = _compare(k, percent, shared)
        compared = staged(_with_texts(pairs, read).mapInArrow(tidy(run), schema), "jaccard-compared", 256)
        if turn:
            drop_staged(read)
        links.append(compared.where("NOT star").select(F.col("x").alias("a"), F.col("hub").alias("b")))
        drop_staged(many, pairs)
        if not more:
            break
        found = _around_hubs(compared.where("star"), percent)
        links += found
        # Sets close to a hub have met all their partners; hubs have met their whole buckets.
        close = compared.where("star AND inner").select("hub", F.col("x").alias("sid"))
        gone = dealt.join(close, ["hub", "sid"]).select("token", "sid").union(dealt.select("token", F.col("hub").alias("sid"))).distinct()
        state = staged(dealt.select("token", "sid", "n", "pos").distinct().join(gone, ["token", "sid"], "left_anti"), "jaccard-far")
        drop_staged(dealt)
        if not state.take(1):
            break
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    labels = connected_components(every)
    drop_staged(live, chosen, bodies)
    placed = base.join(labels, base["sid"] == labels["node"], "left").select("doc_id", "n", F.coalesce("root", "sid").alias("root"))
    first = placed.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return placed.join(first, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _chosen(profiles: DataFrame, live: DataFrame) -> DataFrame:
    """sid, doc_id, hash, ranges, bits: for every set in a bucket the row whose text stands for it."""
    active = live.select("sid").distinct()
    rows = profiles.where("block IS NULL").join(active, "sid", "left_semi")
    return rows.groupBy("sid").agg(F.min(F.struct("doc_id", "hash")).alias("row"), F.min("ranges").alias("ranges"), F.min("bits").alias("bits")).select("sid", "row.doc_id", "row.hash", "ranges", "bits")


def _bodies(texts: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """sid, text: one row for each chosen set."""
    row = chosen.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), "sid")
    named = texts.join(row, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))).select("sid", "text")
    bodies = staged(named.mapInArrow(tidy(_own_text(k)), "sid bigint, text string"), "jaccard-bodies")
    if bodies.groupBy("sid").count().where("count > 1").take(1):
        # Rows that are repeated with their id, or without one, bring their text several times.
        once = staged(bodies.dropDuplicates(["sid"]), "jaccard-bodies")
        drop_staged(bodies)
        return once
    return bodies


def _bucket_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of the sets of each bucket whose sizes and places leave room for enough overlap.

    The first token that two sets share stands at the smallest place in both, so a pair that links passes at that one.
    """
    a = rows.select("token", F.col("sid").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("px"))
    b = rows.select("token", F.col("sid").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("py"))
    fit = F.lit(100) * F.least("nx", "ny") >= F.lit(percent) * F.greatest("nx", "ny")
    room = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) >= needed(F.col("nx"), F.col("ny"), percent)
    return a.join(b, "token").where((F.col("x") < F.col("y")) & fit & room)


def _with_texts(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    left = bodies.select(F.col("sid").alias("x"), F.col("text").alias("text_x"))
    right = bodies.select(F.col("sid").alias("y"), F.col("text").alias("text_y"))
    return pairs.join(left, "x").join(right, "y").select("x", "y", "star", "text_x", "text_y")


def _masks() -> list[str]:
    return [f"m{i}" for i in range(MASK_WORDS)]


def _compare(k: int, percent: int, shared):
    """Plain pairs that link, as rows (x, hub); of stars how far x is from its hub, and the tokens that only one of them has, rare first, with their bitmap."""
    names = ["x", "hub", "star", "nx", "nh", "nd", "kin", "inner", "tokens", *_masks()]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.int64()), *[pa.int64()] * MASK_WORDS]
    most = INNER + 100 - percent

    def row(x: int, y: int, star: bool, own: np.ndarray, kept: np.ndarray, ranks: np.ndarray) -> tuple | None:
        if not star:
            common = len(np.intersect1d(own, kept, assume_unique=True))
            return (x, y, star, *[None] * (len(names) - 3)) if 100 * common >= percent * (len(own) + len(kept) - common) else None
        apart = np.setxor1d(own, kept, assume_unique=True)
        union = (len(own) + len(kept) + len(apart)) // 2
        kin = 100 * len(apart) <= most * union
        if not kin:
            return (x, y, star, len(own), len(kept), len(apart), False, False, None, *[None] * MASK_WORDS)
        rank = ranks[(apart & np.uint64((1 << CELL_BITS) - 1)).astype(np.int64)]
        tokens = apart[np.lexsort((apart, rank))].view(np.int64)
        return (x, y, star, len(own), len(kept), len(apart), True, 100 * len(apart) <= INNER * union, tokens, *np.frombuffer(bitmap(apart, 64 * MASK_WORDS), "<i8").tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, last, kept = shared.value, None, None
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = []
                for x, y, star, left, right in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "star")), batch.column("text_x"), batch.column("text_y"), strict=True):
                    if y != last:
                        last, kept = y, shingle_set(right.as_buffer().to_pybytes(), k)
                    found = row(x, y, star, shingle_set(left.as_buffer().to_pybytes(), k), kept, ranks)
                    if found:
                        rows.append(found)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    sql = "x bigint, hub bigint, star boolean, nx bigint, nh bigint, nd bigint, kin boolean, inner boolean, tokens array<bigint>, "
    return run, sql + ", ".join(f"{m} bigint" for m in _masks())


def _dealt(many: DataFrame, lanes: int) -> DataFrame:
    """token, sid, n, pos, hub: each set of a bucket with each of the bucket's hubs, which are the most connected sets of so many lanes."""
    fame = many.groupBy("sid").agg(F.sum("m").alias("fame"))
    lane = F.pmod(F.xxhash64("sid"), F.lit(lanes))
    hubs = many.join(fame, "sid").groupBy("token", lane.alias("lane")).agg(F.max(F.struct("fame", "sid")).alias("top")).select("token", F.col("top.sid").alias("hub"))
    return many.select("token", "sid", "n", "pos").join(hubs, "token").where("sid <> hub")


def _around_hubs(around: DataFrame, percent: int) -> list[DataFrame]:
    """Links (a, b) among the sets around each hub."""
    # f in whole numbers: (100 + percent) * |D| - (100 - percent) * |x|; the hub itself has no difference.
    f = F.lit(100 + percent) * F.col("nd") - F.lit(100 - percent) * F.col("nx")
    own = around.select("hub", F.col("hub").alias("x"), F.col("nh").alias("nx"), F.lit(0).cast("long").alias("nd")).distinct()
    kin = around.where("kin").select("hub", "x", "nx", "nd", "tokens", *_masks()).unionByName(own, allowMissingColumns=True).withColumn("f", f)
    best = kin.groupBy("hub").agg(F.min(F.struct("f", "x")).alias("best")).select("hub", F.col("best.f").alias("f0"), F.col("best.x").alias("x0"))
    judged = kin.join(best, "hub").withColumn("rest", F.col("f") + F.col("f0") > 0)
    free = staged(judged.where("NOT rest AND x <> x0").select(F.col("x").alias("a"), F.col("x0").alias("b")), "jaccard-links")
    # Pairs within the star are in one component; every other pair has a set outside it.
    least = judged.where("rest").groupBy("hub").agg(F.min("f").alias("f1"))
    least_shared = F.greatest(F.lit(1), F.ceil((F.col("f") + F.when(F.col("rest"), F.col("f0")).otherwise(F.col("f1"))) / F.lit(2 * (100 + percent)))).cast("int")
    length = (F.col("nd") - least_shared + 1).cast("int")
    rows = judged.join(least, "hub").withColumn("len", length).where("len > 0 AND tokens IS NOT NULL")
    rows = rows.select("hub", "x", "nx", "f", "nd", "rest", *_masks(), F.posexplode(F.slice("tokens", F.lit(1), F.col("len"))).alias("pos", "token"))
    a = rows.where("rest").select("hub", "token", "x", "nx", F.col("f").alias("fx"), (F.col("nd") - F.col("pos")).alias("room_x"), *(F.col(m).alias(f"x_{m}") for m in _masks()))
    b = rows.select("hub", "token", F.col("x").alias("y"), F.col("nx").alias("ny"), F.col("f").alias("fy"), (F.col("nd") - F.col("pos")).alias("room_y"), F.col("rest").alias("rest_y"), *(F.col(m).alias(f"y_{m}") for m in _masks()))
    enough = F.least("room_x", "room_y") * F.lit(2 * (100 + percent)) >= F.col("fx") + F.col("fy")
    apart = sum((F.bit_count(F.col(f"x_{m}").bitwiseXOR(F.col(f"y_{m}"))) for m in _masks()), F.lit(0))
    near = apart * F.lit(100 + percent) <= F.lit(100 - percent) * (F.col("nx") + F.col("ny"))
    pairs = a.join(b, ["hub", "token"]).where((F.col("x") != F.col("y")) & (~F.col("rest_y") | (F.col("x") < F.col("y"))) & enough & near)
    pairs = pairs.select("hub", "x", "y", (F.col("fx") + F.col("fy")).alias("f2")).distinct()
    # Whole differences say exactly whether the whole sets link.
    left = kin.select("hub", "x", F.col("tokens").alias("dx"))
    right = kin.select("hub", F.col("x").alias("y"), F.col("tokens").alias("dy"))
    shared_tokens = F.size(F.array_intersect("dx", "dy"))
    linked = pairs.join(left, ["hub", "x"]).join(right, ["hub", "y"]).where(shared_tokens * F.lit(2 * (100 + percent)) >= F.col("f2"))
    linked = staged(linked.select(F.col("x").alias("a"), F.col("y").alias("b")), "jaccard-links")
    return [free, linked]
