"""Language ID, token files, mixing, sharding, fingerprints, byte BPE and the pipeline."""

import hashlib
import random
import unicodedata
import zlib
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sceneloom.llm.byte_bpe import MergeReplay, encode_digests, encode_documents, read_ranks
from sceneloom.llm.common import documents, kept, shared_dir, staged, tidy
from sceneloom.llm.fingerprints import compare_with_edits, with_fingerprints
from sceneloom.llm.language_id import keep_identified, predict_languages, train
from sceneloom.llm.mixing import fit_counts, knapsack, plan_mix, water_fill
from sceneloom.llm.sharding import minimax_cuts, shard_by_bytes
from sceneloom.llm.token_files import WaveletMatrix, WordEncoder, read_token_files, write_token_files

SF = "/root/testdata/sf0.001"
HARD = [None, "", " \n\t ", "aaaaaaaaaaaaa" * 40, "日本語 🙂🙂", "It's WE'LL don't", " " * 500, "\x00\x01é", "<|endoftext|>", "x" * 30_000, "the same", "the same"]
RANKS, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")


def table(spark, texts, ids=None):
    rows = [(i, t, f"s{n % 3}" if n % 7 else None, "en", "x") for n, (i, t) in enumerate(zip(ids or range(len(texts)), texts, strict=True))]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, size string")


def test_replay_equals_tiktoken(spark):
    import tiktoken

    ranks = read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    texts = [t or "" for t in HARD] + ["".join(rng.choices("ab \n'sé1-=_", k=rng.randrange(60))) for _ in range(300)]
    codec = MergeReplay(ranks, public_tokenizers.PATTERN)
    got = list(codec.encode_all(texts))
    assert got == [library.encode_ordinary(t) for t in texts]
    assert [codec.decode(i).decode() for i in got] == texts
    rows = {r["doc_id"]: r for r in encode_digests(table(spark, HARD), RANKS, public_tokenizers.PATTERN).collect()}
    full = {r["doc_id"]: r for r in encode_documents(table(spark, HARD), RANKS, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(HARD):
        ids = library.encode_ordinary(t or "")
        sha = hashlib.sha256((t or "").encode()).hexdigest()
        assert (rows[i]["n_tokens"], rows[i]["ids_sha256"], rows[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha)
        assert (full[i]["ids"], full[i]["decoded_sha256"]) == (ids, sha)
    assert encode_digests(table(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_workers_keep_little_between_tasks():
    """What a task frees goes back to the system, and the pieces of byte BPE go when another operator's task comes."""
    import re
    from pathlib import Path

    import pyarrow as pa

    from sceneloom.llm.byte_bpe import codec

    def held():
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

    def run(batches):
        for batch in batches:
            # Small blocks of the C library's heap with a late one behind them, as long tasks leave them.
            blocks = [np.ones(1 << 13) for _ in range(3000)]
            last.append(np.ones(1 << 13))
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(b) for b in blocks)])], names=["n"])

    last = []
    batch = pa.RecordBatch.from_arrays([pa.array([1])], names=["n"])
    before = held()
    got = [b.column("n")[0].as_py() for b in tidy(run)(iter([batch]))]
    assert got == [3000 << 13] and held() < before + 60
    own = codec(RANKS, public_tokenizers.PATTERN)
    assert list(tidy(lambda batches: batches, "sceneloom.llm.byte_bpe")(iter([batch]))) == [batch]
    assert codec(RANKS, public_tokenizers.PATTERN) is own
    assert list(tidy(lambda batches: batches)(iter([batch]))) == [batch]
    assert not kept("sceneloom.llm.byte_bpe")
    assert codec(RANKS, public_tokenizers.PATTERN) is not own


def test_wavelet_matrix():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 700, 5000)
    m = WaveletMatrix.from_bytes(WaveletMatrix.build(ids, 10).to_bytes())
    assert (m.all() == ids).all()
    for i in range(0, 5000, 251):
        assert m.access(i) == ids[i] and m.rank(int(ids[i]), i) == (ids[:i] == ids[i]).sum()
    assert m.occurrences(int(ids[9])) == np.flatnonzero(ids == ids[9]).tolist() and m.select(699, 10**6) == -1
    with pytest.raises(ValueError):
        WaveletMatrix.from_bytes(b"WVM2" + bytes(19) + b"\x01")
    with pytest.raises(ValueError):
        WaveletMatrix.from_bytes(b"WVM1" + bytes(40))
    # Rank, select and access read the ranks in the file; a plane is unpacked only when it is needed.
    again = WaveletMatrix.from_bytes(WaveletMatrix.build(ids, 10).to_bytes())
    assert all(isinstance(p, bytes) for p in again._planes)
    assert again.rank(5, 5000) == (ids == 5).sum() and again.select(5, 0) == np.flatnonzero(ids == 5)[0]
    empty = WaveletMatrix.from_bytes(WaveletMatrix.build(np.zeros(0, np.int64), 10).to_bytes())
    assert len(empty.all()) == 0 and empty.rank(5, 0) == 0


def test_token_files(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    rng = random.Random(4)
    letters = [chr(c) for c in range(33, 0x180)] + list(" \t\xa0　ΣŸ")
    texts = HARD + ["".join(rng.choices(letters, k=rng.randrange(40))) for _ in range(200)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    got = {r["doc_id"]: r for r in read_token_files(write_token_files(table(spark, texts, ids), WORDS, shard_tokens=700)).collect()}
    start = 0
    for i, t in sorted(zip(ids, texts, strict=True)):
        tokens = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(tokens), zlib.crc32(tokens.tobytes())), t
        start += len(tokens)
    assert read_token_files(write_token_files(table(spark, []), WORDS)).count() == 0
    assert WordEncoder(WORDS).quick


def test_runs_with_equal_hashes_and_special_tokens(monkeypatch):
    from tokenizers import Tokenizer

    from sceneloom.llm import token_files

    library = Tokenizer.from_file(WORDS)
    one = b"a"
    for _ in range(10):
        one += bytes(ord("a") + ord("b") - c for c in one)
    two = bytes(ord("a") + ord("b") - c for c in one)
    texts = [one, two, b"x<|endoftext|>y <|startoftext|> <|ENDOFTEXT|>", b"", b"plain words"]
    expected = [[*library.encode(t.decode(), add_special_tokens=False).ids, 1] for t in texts]
    assert any(49407 in ids for ids in expected)

    def split(got):
        ids, sizes = got
        return [part.tolist() for part in np.split(ids, np.cumsum(sizes)[:-1])]

    assert split(WordEncoder(WORDS).encode(texts, 1)) == expected
    library.encode_special_tokens = True
    assert split(WordEncoder(WORDS, special_as_text=True).encode(texts, 1)) == [[*library.encode(t.decode(), add_special_tokens=False).ids, 1] for t in texts]
    # Whatever the hashes are, runs are told apart by their bytes; long texts go in parts.
    spans = token_files.word_spans
    monkeypatch.setattr(token_files, "word_spans", lambda data: (*spans(data)[:2], spans(data)[2] & np.uint64(1)))
    assert split(WordEncoder(WORDS).encode(texts, 1)) == expected
    monkeypatch.setattr(token_files, "_SLICE_BYTES", 7)
    assert split(WordEncoder(WORDS).encode(texts, 1)) == expected


def test_letters_with_punctuation_are_split_without_a_pattern():
    from tokenizers import Tokenizer

    library, encoder = Tokenizer.from_file(WORDS), WordEncoder(WORDS)
    letters = [chr(c) for c in range(0x21, 0x180) if chr(c).isalpha()]
    marks = [chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()]
    odd = ["don't,", "it's", "a1.", "x_y", "\u0130stanbul!", "e\u0301t\u00e9.", "\u212a.", "n\u00aa.", "a\u00d7b", "<|endoftext|>", "end<|endoftext|>", "..."]
    texts = [*letters, *(f"Wort{c}{m}" for c in letters for m in marks), *(f"Ende{m}{m}.{m}" for m in marks), *odd]
    ids, sizes = encoder.encode([t.encode() for t in texts], 1)
    for text, got in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
        assert got.tolist() == [*library.encode(text, add_special_tokens=False).ids, 1], text
    # Most words of any corpus; the pattern takes longer than all the rest of such a word.
    encoder.pattern = None
    encoder._forget()
    assert encoder.encode(["Größe,".encode(), "Éclair...".encode()], 1)[1].tolist() == [len(library.encode(t, add_special_tokens=False).ids) + 1 for t in ("Größe,", "Éclair...")]


def test_shards_end_by_document(spark):
    from sceneloom.llm.token_files import token_occurrences

    texts = ["one two three four"] * 10 + ["word " * 50] + ["five"] * 3
    files = write_token_files(table(spark, texts).coalesce(1), WORDS, shard_tokens=12)
    rows = sorted(read_token_files(files).collect())
    assert [r["start"] for r in rows] == [0, *np.cumsum([r["n_tokens"] for r in rows])[:-1].tolist()]
    sizes = [np.frombuffer(bytes(r["sizes"]), "<i8").tolist() for r in files.collect()]
    assert all(sum(s[:-1]) < 12 for s in sizes) and any(len(s) > 1 for s in sizes)
    ends = token_occurrences(files, 1)
    assert ends.count() == len(texts) and ends.where("place < 0").count() == 0


def test_budget_fit():
    assert water_fill([10, 10, 0], [5.0, 2.0, 1.0], 30.0) == [20.0, 10.0, 0.0]
    assert sum(water_fill([100, 50, 10], [5, 2, 1], 240)) == pytest.approx(240)
    rng = random.Random(6)
    for _ in range(60):
        lengths = sorted(rng.sample(range(1, 40), 5))
        counts = [rng.randrange(4) for _ in lengths]
        budget = rng.randrange(1, 120)
        sums = {0}
        for n, c in zip(lengths, counts, strict=True):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        total = sum(a * b for a, b in zip(lengths, knapsack(lengths, counts, budget), strict=True))
        low = max(s for s in sums if s <= budget)
        assert abs(total - budget) <= budget - low and total in sums
    lengths, counts = list(range(1, 400)), [500] * 399
    taken = fit_counts(lengths, counts, 10**7)
    assert sum(n * t for n, t in zip(lengths, taken, strict=True)) == 10**7 and all(t <= c for t, c in zip(taken, counts, strict=True))


def test_mixing(spark):
    rng = random.Random(8)
    texts = [None, "", *(" ".join(["w"] * rng.randrange(1, 60)) for _ in range(300)), *["same text here"] * 200]
    docs = table(spark, texts)
    rows = plan_mix(docs).collect()
    assert sorted(rows) == sorted(plan_mix(docs.repartition(3)).collect()) and len(rows) == len(texts)
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in rows)
    by = {}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    for r in rows:
        s = by.setdefault(source[r["doc_id"]], [0, 0, r["target"], r["source_size"]])
        s[0] += r["size"]
        s[1] += r["taken"]
    assert all(s[0] == s[3] and abs(s[1] - s[2]) <= 3 and s[2] <= 2 * s[0] for s in by.values())
    assert sum(s[2] for s in by.values()) == pytest.approx(1.5 * sum(s[0] for s in by.values()))
    assert plan_mix(table(spark, [])).count() == 0


def test_sharding(spark):
    rng = random.Random(3)
    for _ in range(50):
        sizes = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 14))]
        shards = rng.randrange(1, 6)
        capacity, ends = minimax_cuts(sizes, shards)
        assert ends[-1] == len(sizes) and len(ends) <= shards and ends == sorted(set(ends))
        prefix = [0, *accumulate(sizes)]
        assert max(prefix[b] - prefix[a] for a, b in zip([0, *ends], ends, strict=False)) <= capacity

        def needs(c, sizes=sizes, prefix=prefix):
            at = n = 0
            while at < len(sizes):
                nxt = bisect_right(prefix, prefix[at] + c) - 1
                if nxt == at:
                    return 10**9
                at, n = nxt, n + 1
            return n

        assert needs(capacity) <= shards and (capacity == 1 or needs(capacity - 1) > shards)
    texts = [*HARD, *["copy"] * 40, *(f"text {i} " * rng.randrange(1, 30) for i in range(400))]
    rows = shard_by_bytes(table(spark, texts)).collect()
    by_text, slots, bytes_ = {}, {}, [0] * 8
    for r in rows:
        t = texts[r["doc_id"]] or ""
        assert r["size"] == len(t.encode()) + 1 and r["text_crc32"] == zlib.crc32(t.encode()) and r["grown_shard"] is None
        assert by_text.setdefault(t, r["shard"]) == r["shard"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        bytes_[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(rows) == len(texts)
    assert shard_by_bytes(table(spark, [])).count() == 0 and shard_by_bytes(table(spark, ["a"])).count() == 1


def canonical(text):
    import re

    return re.sub(r"[\s\x85\xa0  -     　]+", " ", unicodedata.normalize("NFKC", text).lower()).strip(" ")


def test_fingerprints(spark):
    texts = [*HARD, "Café  au lait", "CAFÉ AU\nLAIT", "ﬁne", "fine", "abcdefgh" * 3, "abcdefgh" * 3]
    rng = random.Random(2)
    ids = rng.sample(range(1000), len(texts))
    got = {r["doc_id"]: r for r in compare_with_edits(table(spark, texts, ids)).collect()}
    order = sorted(zip(ids, [t or "" for t in texts], strict=True))
    same = {}
    for n, (i, t) in enumerate(order):
        nxt = order[(n + 1) % len(order)][1]
        k = len(t) // 4
        edited = t[: len(t) - k] + nxt[:k]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == float(canonical(t) == canonical(edited)) and r["near_next"] == float(canonical(t) == canonical(nxt))
        assert same.setdefault(canonical(t), r["fingerprint"]) == r["fingerprint"]
    assert len(set(same.values())) == len(same)
    assert compare_with_edits(table(spark, [])).count() == 0
    assert compare_with_edits(table(spark, ["abcd"])).first()["n_chars"] == 4
    named = with_fingerprints(table(spark, ["A b", "a  B"]), out="size").select("size").distinct()
    assert named.count() == 1


def test_language_id(spark):
    docs = documents(spark, SF)
    rows = {r["doc_id"]: r for r in predict_languages(docs).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [i for i, r in rows.items() if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    assert sum(rows[i]["lang_pred"] == truth[i] for i in held) >= 0.95 * len(held) and all(0 <= r["score"] <= 1 for r in rows.values())
    edge = table(spark, [None, "", "123 ...", "der die das und ist ein haus " * 4000])
    model = train(docs)
    out = [(r["lang_pred"], r["score"]) for r in predict_languages(edge).collect()]
    assert out[:3] == [("und", 0.0)] * 3
    assert [r["doc_id"] for r in keep_identified(edge, model).collect()] == [3]
    assert predict_languages(table(spark, [])).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = documents(spark, SF)
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "n-gram Jaccard join", "mixing sources", "byte-level BPE"]
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, SF), "test")
        assert docs.columns == columns
        kept.append({r[0] for r in docs.select("doc_id").collect()})
    assert kept[0] >= ids - {0} or len(kept[0]) >= 0.97 * len(ids)
    assert kept[1] == kept[0] and len(kept[2]) < len(kept[1])
    assert docs.count() > docs.select("doc_id").distinct().count()
    final = corpus_pipeline.STAGES[-1][1](spark, docs, SF).withColumn("n", F.size("ids"))
    assert final.count() == docs.count() and final.where("n <> n_tokens").count() == 0


def test_shared_folder_is_the_configured_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
