"""Line, exact, n-gram and substring dedup against brute force."""

import hashlib
import itertools
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from sceneloom.llm import jaccard_join
from sceneloom.llm.components import connected_components
from sceneloom.llm.exact_dedup import CHUNK, chunk_hash, combine, dedup_exact, fingerprint
from sceneloom.llm.line_dedup import dedup_lines
from sceneloom.llm.substring_dedup import MIN_WORDS, compact_windows, repeated_passages, sliding_minima

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("_removed", T.StringType()), T.StructField("key", T.StringType())])


def table(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "x", None) for i, t in zip(ids or range(len(texts)), texts, strict=True)], SCHEMA)


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


EDGE = [None, "", " \n\t ", "one", "a b c", "x" * 70_000, "word " * 30_000]


def test_lines_keep_first_of_repeated_passages(spark):
    block = "\n".join(f"shared line {i}" for i in range(12))
    texts = [f"alpha\n{block}\nomega", f"beta\nmore\n{block}\nend", "single\nlines", "single\nother", *EDGE]
    rows = {r["doc_id"]: r for r in dedup_lines(table(spark, texts)).collect()}
    assert rows[0]["text"] == texts[0] and rows[0]["_removed"] == 0
    assert rows[1]["_removed"] > 0 and "beta" in rows[1]["text"] and len(rows[1]["text"]) < len(texts[1])
    assert rows[2]["text"] == texts[2] and rows[3]["text"] == texts[3]
    for i, t in enumerate(EDGE):
        assert rows[4 + i]["text"] == t
    assert set(rows[0].asDict()) >= {"doc_id", "text", "key", "_chunks", "_removed", "_removed_lines"}


def test_lines_repeated_rows_and_empty_table(spark):
    text = "\n".join(f"l{i}" for i in range(20))
    got = dedup_lines(table(spark, [text, text], [7, 7])).collect()
    assert [r["text"] for r in got] == [text, text]
    assert dedup_lines(table(spark, [])).count() == 0


def test_fingerprints_compose():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(3 * CHUNK + 17))
    whole = fingerprint(data)
    for cut in (1, 100, CHUNK):
        left, right = data[:cut], data[cut:]
        assert combine((fingerprint(left), len(left)), (fingerprint(right), len(right)))[0] == whole
    assert chunk_hash(b"\x00") != chunk_hash(b"\x00\x00")


def naive_exact(texts, ids):
    groups = defaultdict(list)
    for i, t in zip(ids, texts, strict=True):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    return {i: (min(g)[1], len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g}


def test_exact_dedup(spark):
    texts = ["a b", "ab", "a  b ", "A b", "é x", "éx", *EDGE, "word " * 30_000 + " ", "ab"]
    got = {r["doc_id"]: r for r in dedup_exact(table(spark, texts)).collect()}
    for i, (keep, size, sha) in naive_exact(texts, range(len(texts))).items():
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["text_sha256"], got[i]["kept"]) == (keep, size, sha, keep == i)
    assert dedup_exact(table(spark, [])).count() == 0
    twice = dedup_exact(table(spark, ["a b", "a b", "ab", "z"], [4, 4, None, None])).collect()
    assert sorted((r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"], r["kept"]) for r in twice) == [(-1, -1, 1, True), (-1, 4, 3, False), (4, 4, 3, True), (4, 4, 3, True)]


def test_exact_dedup_splits_equal_fingerprints(spark, monkeypatch):
    import sceneloom.llm.exact_dedup as module

    rows = [("aaaa", 1), ("bbbb", 2), ("aaaa", 3)]
    run = module._fingerprints

    def same(batches):
        import pyarrow as pa

        for b in run(batches):
            zero = pa.array([0] * b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(3)], zero, zero, b.column(5)], names=b.schema.names)

    monkeypatch.setattr(module, "_fingerprints", same)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in dedup_exact(table(spark, [t for t, _ in rows], [i for _, i in rows])).collect()}
    assert got == {1: (1, 2), 2: (2, 1), 3: (1, 2)}


def naive_components(texts, ids, k, percent):
    sets = {}
    for i, t in zip(ids, texts, strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(rng, base, n, most):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(most)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("small", [1, 8])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    if small == 1:
        monkeypatch.setattr(jaccard_join, "SMALL_LATER", 1)
    rng = random.Random(5)
    texts = [*EDGE, *near_copies(rng, words(rng, 150), 40, 9), *near_copies(rng, words(rng, 40), 20, 4), *(" ".join(words(rng, 60)) for _ in range(20)), "A B C", "a b  c", "a b c d"]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_components(table(spark, texts), 4, 85).collect()}
    assert got == naive_components(texts, range(len(texts)), 4, 85)


def test_jaccard_join_large_families(spark):
    """Two families of which many copies link and many don't, a template that far copies share, and many small families."""
    rng = random.Random(15)
    template = words(rng, 60)
    far = [" ".join(template[:45] + words(rng, 25)) for _ in range(60)]
    texts = [t for n in (300, 250) for t in near_copies(rng, words(rng, 150), n, 14)] + far + [t for _ in range(40) for t in near_copies(rng, words(rng, 70), 6, 5)]
    for k, percent in ((4, 85), (5, 80)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_components(table(spark, texts), k, percent).collect()}
        assert got == naive_components(texts, range(len(texts)), k, percent)


def test_jaccard_join_many_rows_without_id(spark):
    texts = [t for i in range(40) for t in (f"a b c d e f {i % 20}", "same words in here for all")]
    got = jaccard_join.similar_components(table(spark, texts, [None] * 79 + [5]), 4, 60).collect()
    assert len(got) == 80 and {r["component_id"] for r in got} == {None, 5}


def test_jaccard_join_edges(spark):
    assert jaccard_join.similar_components(table(spark, []), 5, 80).count() == 0
    got = jaccard_join.similar_components(table(spark, ["a b c d e f", "a b c d e f", None], [3, 3, None]), 5, 80).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in got) == [(-1, None), (3, 3), (3, 3)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 103: 100}


def test_sliding_minima_and_windows():
    import numpy as np

    rng = random.Random(2)
    values = np.array([rng.randrange(50) for _ in range(333)], np.uint64)
    assert sliding_minima(values, 7).tolist() == [min(values[i : i + 7]) for i in range(327)]
    left, node, right = compact_windows(np.array([rng.randrange(1 << 60) for _ in range(200)], np.uint64), 20, 3)
    assert ((right - left + 1 >= 20) & (left <= node) & (node <= right)).all()


@pytest.mark.parametrize("turns", [0, 2])
def test_repeated_passages(spark, turns):
    rng = random.Random(9)
    passage, near = words(rng, MIN_WORDS + 5), words(rng, 200)
    fresh = lambda n: words(rng, n)
    edited = list(near)
    edited[70] = "changed"
    texts = [
        " ".join(fresh(80) + passage + fresh(30)),
        " ".join(fresh(10) + passage + fresh(120)),
        " ".join(w.upper() for w in passage),
        " ".join(fresh(150)),
        " ".join(fresh(30) + near),
        " ".join(edited + fresh(60)),
        " ".join(fresh(60) + passage[: MIN_WORDS - 10] + fresh(60)),
        *EDGE,
    ]
    rows = repeated_passages(table(spark, texts), turns=turns).collect()
    linked = {frozenset((r["doc_id"], r["other_id"])) for r in rows}
    assert set().union(*linked) == {0, 1, 2, 4, 5}
    one = next(r for r in rows if {r["doc_id"], r["other_id"]} == {0, 1})
    spans = {one["doc_id"]: (one["start_word"], one["end_word"]), one["other_id"]: (one["other_start"], one["other_end"])}
    assert spans == {0: (80, 135), 1: (10, 65)}
    assert repeated_passages(table(spark, [])).count() == 0


@pytest.mark.parametrize("turns", [0, 2])
def test_near_passages_in_buckets_of_many_families(spark, turns):
    """Eight families share 45 words; the two texts of a family are near (Jaccard 0.84), without a common run of 50 words."""
    rng = random.Random(11)
    hot, families = words(rng, 45), []
    for _ in range(8):
        text = words(rng, 36) + hot + words(rng, 36)
        edited = list(text)
        edited[33], edited[83] = "here", "there"
        families.append((" ".join(text), " ".join(edited)))
    rows = repeated_passages(table(spark, [x for x, _ in families] + [y for _, y in families]), turns=turns).collect()
    linked = {frozenset((r["doc_id"], r["other_id"])) for r in rows}
    assert linked == {frozenset((i, i + 8)) for i in range(8)}


def test_short_near_passages_are_found(spark):
    """Passages of 50 to 60 words with one edit in the middle (Jaccard 0.80 to 0.84) share no long run of words; at least nine of ten are found."""
    rng = random.Random(12)
    left, right = [], []
    for i in range(60):
        passage = words(rng, 50 + 5 * (i % 3))
        edited = list(passage)
        edited[len(passage) // 2] = "edited"
        left.append(" ".join(words(rng, 60) + passage + words(rng, 40)))
        right.append(" ".join(words(rng, 40) + edited + words(rng, 60)))
    rows = repeated_passages(table(spark, left + right)).collect()
    linked = {frozenset((r["doc_id"], r["other_id"])) for r in rows}
    assert linked <= {frozenset((i, i + 60)) for i in range(60)} and len(linked) >= 54


@pytest.mark.parametrize("fresh_edits", [True, False])
def test_recall_of_near_passages(spark, fresh_edits):
    """Passages of 50 to 200 words with one to four edits and Jaccard 0.8 or more between other words: at least nine of ten pairs, and nothing else, are found.

    Edits are words that stand nowhere else, or such that two other documents have in the same place, so that their tokens count as shared.
    """
    rng = random.Random(14)
    sizes = [(50, 1), (55, 1), (60, 1), (75, 1), (100, 2), (150, 3), (200, 4)]
    texts, expected = [], set()
    for i in range(70):
        length, edits = sizes[i % len(sizes)]
        passage = words(rng, length)
        edited = list(passage)
        for e in range(edits):
            edited[(e + 1) * length // (edits + 1)] = f"e{rng.randrange(10**9)}"
        grams = [{tuple(w[j : j + 5]) for j in range(length - 4)} for w in (passage, edited)]
        assert len(grams[0] & grams[1]) >= 0.8 * len(grams[0] | grams[1])
        expected.add(frozenset((len(texts), len(texts) + 1)))
        texts += [" ".join(words(rng, 60) + passage + words(rng, 40)), " ".join(words(rng, 40) + edited + words(rng, 60))]
        if not fresh_edits:
            middle = length // 2
            texts += [" ".join(words(rng, 30) + w[middle - 15 : middle + 15] + words(rng, 30)) for w in (passage, edited)]
    rows = repeated_passages(table(spark, texts)).collect()
    linked = {frozenset((r["doc_id"], r["other_id"])) for r in rows}
    assert linked <= expected and len(linked) >= 0.9 * len(expected)


def test_dense_regions_are_unions_of_dense_ranges():
    import numpy as np

    from sceneloom.llm.substring_dedup import dense_regions

    rng = np.random.default_rng(5)
    for _ in range(200):
        shared = rng.random(rng.integers(0, 60)) < rng.choice([0.5, 0.75, 0.9])
        inside = np.zeros(len(shared), bool)
        for a in range(len(shared)):
            for b in range(a + 8, len(shared) + 1):
                if 10 * shared[a:b].sum() >= 8 * (b - a):
                    inside[a:b] = True
        # Each run of the union is cut to its first and last shared token, and falls if it is too short then.
        edges = np.flatnonzero(np.diff(np.r_[False, inside, False]))
        expected = []
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            hits = np.flatnonzero(shared[a:b]) + a
            if hits[-1] + 1 - hits[0] >= 8:
                expected.append((int(hits[0]), int(hits[-1]) + 1))
        assert dense_regions(shared, 8, 0.8) == expected


def test_every_place_of_a_passage_is_found(spark):
    rng = random.Random(13)
    passage, inner = words(rng, 60), words(rng, 70)
    texts = [
        words(rng, 40) + passage + words(rng, 20),
        words(rng, 30) + passage + words(rng, 10) + passage + words(rng, 55) + passage,
        words(rng, 15) + inner + inner + words(rng, 80) + inner,
        words(rng, 100),
        words(rng, 3) * 200,
    ]
    rows = repeated_passages(table(spark, [" ".join(x) for x in texts])).collect()
    covered = {i: set() for i in range(5)}
    for r in rows:
        assert r["doc_id"] != r["other_id"] or r["other_end"] <= r["start_word"]
        covered[r["doc_id"]] |= set(range(r["start_word"], r["end_word"]))
        covered[r["other_id"]] |= set(range(r["other_start"], r["other_end"]))
    assert covered[0] == {*range(40, 100)}
    assert covered[1] == {*range(30, 90), *range(100, 160), *range(215, 275)}
    assert covered[2] == {*range(15, 155), *range(235, 305)}
    assert not covered[3] and not covered[4]


def linked_after(base, *runs):
    """base with each run of words (first, n) replaced."""
    out = list(base)
    for first, n in runs:
        out[first : first + n] = [f"r{first}_{i}" for i in range(n)]
    return out


def test_promising_lets_edits_stand_together(spark):
    """Of 91 words the middle four, or of 85 three, are others (Jaccard 0.83): no 46 tokens around them share nine tenths."""
    rng = random.Random(21)
    texts, expected = [], set()
    for n, edit in [(91, 4), (85, 3), (90, 3)] * 4:
        passage = words(rng, n)
        expected.add(frozenset((len(texts), len(texts) + 1)))
        texts += [" ".join(words(rng, 30) + w + words(rng, 30)) for w in (passage, linked_after(passage, (n // 2 - edit // 2, edit)))]
    rows = repeated_passages(table(spark, texts)).collect()
    assert {frozenset((r["doc_id"], r["other_id"])) for r in rows} == expected


@pytest.mark.parametrize("small", [1, 64])
def test_passages_with_partners_are_compared_too(spark, monkeypatch, small):
    """Eight edited copies of one passage in a line: those up to two steps apart are near, the others aren't; no link that joins them is left out."""
    from sceneloom.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "SMALL", small)
    rng = random.Random(22)
    base = words(rng, 150)
    chain = [linked_after(base, *((8 + 15 * j, 4) for j in range(i))) for i in range(9)]
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in chain]
    near = {(i, j) for i, j in itertools.combinations(range(9), 2) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])}
    rows = repeated_passages(table(spark, [" ".join(w) for w in chain])).collect()
    linked = {tuple(sorted((r["doc_id"], r["other_id"]))) for r in rows}
    assert near <= {(a, b) for a, b in linked} if small > 1 else {a for pair in linked for a in pair} == set(range(9))
    up = list(range(9))
    for a, b in sorted(linked):
        up = [up[a] if u == up[b] else u for u in up]
    assert len(set(up)) == 1


def test_jaccard_join_moves_only_tokens_that_two_sets_have(spark, monkeypatch):
    rng = random.Random(23)
    texts = [" ".join(words(rng, 100)) for _ in range(60)] + near_copies(rng, words(rng, 100), 3, 3)
    rows, keep = {}, jaccard_join.staged

    def spy(df, name, *more):
        out = keep(df, name, *more)
        rows.setdefault(name, out.count())
        return out

    monkeypatch.setattr(jaccard_join, "staged", spy)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_components(table(spark, texts), 5, 80).collect()}
    assert got == naive_components(texts, range(len(texts)), 5, 80)
    # Prefixes have 20 tokens or so.
    assert max(rows[n] for n in rows if n in ("jaccard-prefixes", "jaccard-met", "jaccard-live")) <= 3 * 25


def test_jaccard_join_nearly_linked_sets_need_one_hub(spark, monkeypatch):
    """Copies of a template with edits of their own that are a third apart from each other meet around the first hub, not around hubs that double."""
    rng = random.Random(24)
    template = words(rng, 400)
    texts = [" ".join(w if j % 100 >= 2 or j // 100 != i % 4 else f"x{i}_{j}" for j, w in enumerate(linked_after(template, *((25 + 50 * j + i % 7, 5) for j in range(7))))) for i in range(28)]
    texts = [" ".join(f"e{i}_{j}" if j % 26 == i % 3 and j else w for j, w in enumerate(template)) for i in range(60)] + texts
    turns, keep = [], jaccard_join._around_hubs
    monkeypatch.setattr(jaccard_join, "_around_hubs", lambda around, percent: turns.append(around.count()) or keep(around, percent))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similar_components(table(spark, texts), 5, 80).collect()}
    assert got == naive_components(texts, range(len(texts)), 5, 80)
    assert len(turns) <= 2 and sum(turns) <= 4 * len(texts), turns


def test_verification_of_a_pair_uses_no_general_set_operation(monkeypatch):
    import numpy as np

    from sceneloom.llm.substring_dedup import distinct, match, within

    rng = np.random.default_rng(3)
    for n, m in ((0, 5), (5, 0), (40, 40), (300, 20)):
        a, b = (rng.integers(0, 50, size).astype(np.uint64) for size in (n, m))
        assert distinct(a).tolist() == np.unique(a).tolist()
        assert within(a, np.sort(b)).tolist() == np.isin(a, b).tolist()
    x = rng.integers(1, 1 << 62, 120).astype(np.uint64)
    y = np.r_[rng.integers(1, 1 << 62, 30).astype(np.uint64), x[10:110]]
    y[75:80] = 0
    # Hundreds of thousands of pairs are verified one by one, and these take longer than all the rest.
    for name in ("isin", "unique", "intersect1d"):
        monkeypatch.setattr(np, name, None)
    assert match(x, y, [(30, 10, 109, 50, 30, 129)], 46, 0.8) == [(10, 109, 30, 129, 95 / 101)]


def test_filter_of_pairs_keeps_every_passage_and_asks_both_texts():
    import numpy as np

    from sceneloom.llm.substring_dedup import match, promising

    rng = np.random.default_rng(4)
    x, y, nodes, others, found = [], [], [], [], []
    for i in range(300):
        text = rng.integers(0, 1 << 62, 150).astype(np.uint64)
        other = np.r_[rng.integers(0, 1 << 62, i % 60).astype(np.uint64), text]
        for at in rng.integers(0, 150, i % 7):
            other[i % 60 + at : i % 60 + at + 5] = rng.integers(0, 1 << 62, 5)[: max(0, 150 - at)]
        same = np.flatnonzero(text == other[i % 60 :])
        node = int(same[len(same) // 2])
        found.append(bool(match(text, other, [(node, max(0, node - 45), min(149, node + 45), node + i % 60, max(0, node + i % 60 - 45), min(len(other) - 1, node + i % 60 + 45))], 46, 0.8)))
        x.append((text & np.uint64(0xFFFF)).astype("<u2"))
        y.append((other & np.uint64(0xFFFF)).astype("<u2"))
        nodes.append(node)
        others.append(node + i % 60)
    kept = promising(x, y, np.arange(300), np.array(nodes), np.array(others), 46, 0.8)
    assert 100 < sum(found) < 300 and kept[np.array(found)].all()
    # Pieces of 24 tokens that stand together in one text only, and 30 tokens between others.
    piece = np.arange(1, 49, dtype="<u2")
    apart = np.r_[piece[:24], np.arange(1000, 1100, dtype="<u2"), piece[24:]].astype("<u2")
    few = np.r_[np.arange(2000, 2100), piece[:30], np.arange(2100, 2200)].astype("<u2")
    lone = np.r_[np.arange(3000, 3100), piece[:30], np.arange(3100, 3200)].astype("<u2")
    assert promising([piece, few], [apart, lone], np.array([0, 1]), np.array([10, 110]), np.array([10, 110]), 46, 0.8).tolist() == [False, False]


def test_large_buckets_take_few_turns(spark, monkeypatch):
    """Sixteen families of two share 45 words, so every bucket of these is large; all families are found within four turns of pivots."""
    from sceneloom.llm import substring_dedup

    rng, keep, turns = random.Random(25), substring_dedup.staged, []
    hot, families = words(rng, 45), []
    for _ in range(16):
        text = words(rng, 36) + hot + words(rng, 36)
        edited = list(text)
        edited[33], edited[83] = "here", "there"
        families.append((" ".join(text), " ".join(edited)))
    monkeypatch.setattr(substring_dedup, "SMALL", 1)
    monkeypatch.setattr(substring_dedup, "staged", lambda df, name, *more: turns.append(name) or keep(df, name, *more))
    rows = repeated_passages(table(spark, [x for x, _ in families] + [y for _, y in families])).collect()
    assert {frozenset((r["doc_id"], r["other_id"])) for r in rows} == {frozenset((i, i + 16)) for i in range(16)}
    assert turns.count("passages-pivots") <= 4
