"""Hashing, exact deduplication, the Jaccard join and decontamination against plain versions."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumicell.llm import common, decontaminate, exact_dedup, jaccard_join, tokens
from tests.llm.util import EDGES, LOWER, brute_components, documents, words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbB \t\né中.,", max_size=40)), max_size=8))
def test_words_and_shingles_match_python(texts):
    data, off = tokens.utf8(pa.array(texts, pa.string()))
    h, o = tokens.word_hashes(data, off)
    plain = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) for t in texts]
    assert np.diff(o).tolist() == [len(p) for p in plain]
    flat = [w for p in plain for w in p]
    assert len(set(zip(flat, h.tolist()))) == len(set(flat)) == len(set(h.tolist()))
    g, go = tokens.ngram_hashes(h, o, 3)
    grams = [[tuple(p[k : k + 3]) for k in range(max(1, len(p) - 2))] if p else [] for p in plain]
    assert np.diff(go).tolist() == [len(x) for x in grams]
    flat = [x for p in grams for x in p]
    assert len(set(zip(flat, g.tolist()))) == len(set(flat)) == len(set(g.tolist()))


def test_words_longer_than_a_segment():
    text = ["a" * (tokens.SEGMENT * 2 + 5) + " b", "c", " " * tokens.SEGMENT + "d e"]
    h, o = tokens.word_hashes(*tokens.utf8(pa.array(text)))
    assert np.diff(o).tolist() == [2, 1, 2]


@pytest.mark.parametrize("filter_words", [0, 1000])
def test_exact_dedup_matches_python(spark, filter_words):
    rows = EDGES + [(100 + k, "Copy TEXT", "en") for k in range(600)] + [(1000 + k, f"own {k % 90}", "en") for k in range(120)]
    out = exact_dedup.exact_dedup(documents(spark, rows), filter_words=filter_words).toPandas()
    digest = lambda t: hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(digest(t), []).append(i)
    assert len(out) == len(rows)
    for x in out.itertuples():
        group = groups[x.text_sha256]
        known = [i for i in group if i is not None]
        assert x.group_size == len(group)
        if known:
            assert x.keep_id == max(known) and x.kept == (x.doc_id == max(known))
    assert exact_dedup.exact_dedup(documents(spark, [])).count() == 0


def test_drop_copies_keeps_one_row_of_each(spark):
    out = exact_dedup.drop_copies(documents(spark, EDGES + EDGES))
    assert out.columns == documents(spark, []).columns
    assert sorted(r.text.lower() if r.text else "" for r in out.collect()) == sorted({(t or "").lower() for _, t, _ in EDGES})


def test_jaccard_components_match_brute_force(spark):
    rng = random.Random(3)
    rows, at = [(1, None, None), (2, "", None), (3, "a b", None), (4, "A  b", None), (6, "a b c d e", None)], 10
    for g in range(12):  # drifting copies: chains whose ends don't link
        w = words(rng.choice([12, 60, 200]), g)
        for _ in range(8):
            rows.append((at, " ".join(w), None))
            at += 1
            w = list(w)
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = f"x{at}"
    shared = " ".join(words(60, 99))
    rows += [(at + k, shared + " " + " ".join(words(18, 1000 + k)), None) for k in range(30)]
    rows += [(at + 100 + k, rows[10][1], None) for k in range(20)]
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(documents(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_jaccard_components_edges(spark):
    got = jaccard_join.jaccard_components(documents(spark, EDGES)).collect()
    assert len(got) == len(EDGES)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id} == {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (7, 1, 7)}
    assert jaccard_join.jaccard_components(documents(spark, [])).count() == 0


def test_tree_search_loses_no_pair():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, 120, dtype=np.uint64)) for _ in range(40)]
    sets += [np.unique(np.concatenate([s[: len(s) - k % 20], rng.integers(0, 2**63, k % 20, dtype=np.uint64)])) for k, s in enumerate(sets)]
    v = np.array([jaccard_join.fold(jaccard_join.count_vector(s), 16) for s in sets])
    n = np.array([len(s) for s in sets])
    tree = jaccard_join.CountRTree(v, n, 75, 100)
    for i, s in enumerate(sets):
        found = set(tree.search(v[i], int(n[i]))[0].tolist())
        exact = {j for j, t in enumerate(sets) if 100 * len(np.intersect1d(s, t)) >= 75 * len(np.union1d(s, t))}
        assert exact <= found


@pytest.mark.parametrize("top", [3, 255, 256, 70000])
def test_points_and_keys_round_trip(top):
    v = np.array([0, 1, top, 2] * 8, "<u4")
    assert (jaccard_join.from_cell(jaccard_join.to_cell(v)) == v).all()
    h = np.array([0, 1, 2**64 - 1, 0x0123456789ABCDEF], np.uint64)
    assert jaccard_join.from_keys(jaccard_join.to_keys(h)).tolist() == [0, 0, 2**48 - 1, 0x0123456789AB]
    assert jaccard_join.from_keys(b"").tolist() == []


def test_large_buckets_in_bands_lose_no_link(spark, monkeypatch):
    """Slices of three rows, one bucket of many sizes whose members link in pairs or not at all."""
    monkeypatch.setattr(jaccard_join, "TREE_ROWS", 3)
    shared, rows = words(12, 9), []
    for k in range(24):
        own = words(6 + 3 * (k // 2), 500 + k // 2)
        rows.append((k, " ".join([*shared, *own, *(["tail%d" % k] if k % 3 else words(4, 900 + k))]), None))
    rows += [(100 + k, rows[k][1] + " end", None) for k in range(0, 24, 5)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(documents(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_components_of_a_path_and_a_star(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(300, 300)]
    got = {r.node: r.root for r in jaccard_join.components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, 7: 7, **{k: 7 for k in range(200, 260)}}

def test_tree_slices_reach_every_link_across_components():
    """Rows of several sizes in two slices of points and two of queries: links of all others across components are found once."""
    rng = np.random.default_rng(3)
    fresh = lambda k: rng.integers(0, 2**63, k, dtype=np.uint64)
    base = {k: np.unique(fresh(m)) for k, m in enumerate((20, 120, 130, 500))}
    sets = [np.unique(np.concatenate([b[: len(b) - k], fresh(k)])) for b in base.values() for k in (0, 1, 2, 3, len(b) // 5)]
    comp = [0 if k % 5 < 3 and k < 10 else k for k in range(len(sets))]
    cell = [jaccard_join.to_cell(jaccard_join.count_vector(s)) for s in sets]
    rows = [(k, comp[k], len(s), cell[k], comp[k] != 0) for k, s in enumerate(sets)]
    found = []
    for part in (0, 1):
        for asks in (0, 1):
            points = [(*r, jaccard_join.BOTH if r[4] and r[0] % 3 % 2 == asks else jaccard_join.POINT) for r in rows if r[0] % 2 == part]
            others = [(*r, jaccard_join.SEARCH) for r in rows if r[4] and r[0] % 2 != part and r[0] % 3 % 2 == asks]
            u, v, _ = jaccard_join._slice_pairs(points + others, 75, 100, False)
            found += [(min(p), max(p)) for p in zip(u, v)]
    exact = {(i, j) for j, t in enumerate(sets) for i, s in enumerate(sets[:j]) if comp[i] != comp[j] and 100 * len(np.intersect1d(s, t)) >= 75 * len(np.union1d(s, t))}
    assert exact and exact <= set(found) and len(found) == len(set(found))


def row_components(rows):
    """(doc_id, n, component) of each row by brute force, rows being texts of their own."""
    got = brute_components([(k, t, l) for k, (_, t, l) in enumerate(rows)])
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if got[k][0]:
            least.setdefault(got[k][1], []).append(i)
    least = {c: min((i for i in v if i is not None), default=None) for c, v in least.items()}
    return sorted(((i, got[k][0], least[got[k][1]] if got[k][0] else i) for k, (i, _, _) in enumerate(rows)), key=repr)


def test_repeated_and_missing_ids_are_rows_of_their_own(spark):
    a, b, c = words(40, 1), words(40, 2), words(40, 3)
    near = lambda w, k: " ".join([*w[:-1], f"end{k}"])
    rows = [(5, near(a, 0), None), (5, near(b, 0), None), (5, near(b, 0), None), (9, near(b, 1), None), (None, near(a, 1), None), (None, near(c, 0), None)]
    rows += [(None, near(c, 1), None), (3, near(a, 2), None), (None, None, None), (8, "", None), *EDGES]
    rows += [(40, "very long " * 100_000 + "end", None), (41, "very long " * 100_000 + "END", None)]
    got = jaccard_join.jaccard_components(documents(spark, rows))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=repr) == row_components(rows)
    kept = jaccard_join.one_of_each(documents(spark, rows).withColumnRenamed("n", "_text_hash"))
    assert kept.columns == documents(spark, []).withColumnRenamed("n", "_text_hash").columns
    texts = [(r.doc_id, r.text) for r in kept.collect()]
    front = lambda w: [i for i, t in texts if t and t.startswith(" ".join(w[:20]))]
    assert front(a) == [3] and front(b) == [5] and front(c) == [None] and front(["very", "long"] * 20) == [40]
    assert len([t for _, t in texts if not (t or "").strip()]) == 5
    assert jaccard_join.one_of_each(documents(spark, [])).count() == 0


def test_hot_keys_are_counted_apart(spark, monkeypatch):
    for name, value in (("HOT_LEAST", 8), ("HOT_SHARE", 5), ("HOT_SEEN", 8)):
        monkeypatch.setattr(jaccard_join, name, value)
    shared = words(40, 77)
    rows = [(k, " ".join([*shared, f"tail{k}"]), None) for k in range(60)] + [(100 + k, " ".join(words(40, 200 + k)), None) for k in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(documents(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_sets_of_nodes_too_large_to_broadcast(spark, monkeypatch):
    for name in ("BROADCAST_NODES", "BROADCAST_KEYS"):
        monkeypatch.setattr(jaccard_join, name, 0)
    rows = [(k // 2, " ".join([*words(30, k // 6), f"t{k % 3}"]), None) for k in range(36)] + [(90, "x y z a b", None)] * 3 + [(None, "x y z a b", None)] * 2
    got = jaccard_join.jaccard_components(documents(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == row_components(rows)
    assert jaccard_join.one_of_each(documents(spark, rows)).count() == 7


def test_samples_are_never_empty_and_bounded(spark):
    for n in (10**9, 10**11, 10**15):
        assert common.sample_threshold(8000, n) / 2**63 * n == pytest.approx(8000, rel=0.01)
    rows = spark.range(5000).withColumnRenamed("id", "doc_id")
    assert 350 < common.bounded_sample(rows, 500, "doc_id").count() < 650
    assert common.bounded_sample(rows, 6000, "doc_id").count() == 5000
    with pytest.raises(RuntimeError):  # a non-empty frame with an empty sample
        common.bounded_sample(rows.limit(3), 1, "doc_id", known=10**15)
    same = spark.range(4000).select(F.lit(7).alias("doc_id"))
    assert common.bounded_sample(rows.select("doc_id").unionByName(same.select(F.col("doc_id").cast("bigint"))), 100, "doc_id").count() <= 200


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())


def test_without_takes_nulls_as_equal_and_keeps_clean_rows(spark):
    docs = documents(spark, [(1, "a", None), (None, "b", None), (None, "c", None), (2, "b", None), (2, "d", None)]).withColumnRenamed("n", "_drop_text")
    gone = spark.createDataFrame([(None, "b"), (2, "d")], "doc_id bigint, text string")
    assert sorted(r.text for r in common.without(docs, gone).collect()) == ["a", "b", "c"]


@pytest.mark.parametrize("filter_words", [0, 1000])
def test_null_ids_and_repeated_rows_lose_their_copies(spark, monkeypatch, filter_words):
    monkeypatch.setattr(exact_dedup, "FILTER_WORDS", filter_words)
    rows = [(None, "Same text", None), (1, "same text", None), (None, "alone", None), (None, "alone", None), (3, "x", None), (3, "X", None), (3, "y", None), (7, "long " * 200_000, None), (6, "LONG " * 200_000, None)]
    docs = documents(spark, rows).withColumnRenamed("n", "_text_sha256")
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text[:9].lower()) for r in out.collect()), key=repr) == sorted([(1, "same text"), (None, "alone"), (3, "x"), (3, "y"), (7, "long long")], key=repr)
    assert exact_dedup.drop_copies(documents(spark, [])).count() == 0


def plain_alignment(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return h.max()


def test_alignment_matches_plain_version():
    rng = np.random.default_rng(4)
    a = [rng.integers(0, 5, n).astype(np.uint64) + np.uint64(9) for n in (1, 7, 20, 33)]
    b = [rng.integers(0, 5, n).astype(np.uint64) + np.uint64(9) for n in (4, 1, 50, 40)]
    assert decontaminate.smith_waterman(a, b).tolist() == [plain_alignment(x, y) for x, y in zip(a, b)]


def test_decontamination_finds_edited_copies_only(spark):
    items = [(k, " ".join(words(30, 500 + k, 3000))) for k in range(6)]
    rows = [(k, " ".join(words(300, k, 3000)), "en") for k in range(40)]
    for k in range(6):
        w = items[k][1].upper().split()
        w[7] = w[19] = "edited"
        rows.append((100 + k, rows[k][1] + " " + ", ".join(w) + " " + rows[k + 6][1], "en"))
    rows += [(200 + k, items[0][1] + f" tail {k}", "en") for k in range(60)]  # a leak into most documents
    rows += [(300, " ".join(words(100_000, 7, 3000)) + " " + items[1][1], "en")]
    want = {(100 + k, k) for k in range(6)} | {(200 + k, 0) for k in range(60)} | {(300, 1)}
    schema = "item_id bigint, text string"
    for block in (16 << 20, 300):
        some = spark.createDataFrame([*items, (90, None), (91, "")], schema)
        got = decontaminate.contaminated(documents(spark, rows + EDGES), some, item_bytes=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want
        clean = decontaminate.decontaminate(documents(spark, rows + EDGES), some, item_bytes=block)
        assert clean.count() == 40 + len(EDGES) and clean.columns == documents(spark, []).columns
    none = spark.createDataFrame([], schema)
    assert decontaminate.contaminated(documents(spark, rows), none).count() == 0
    assert decontaminate.decontaminate(documents(spark, rows), none).count() == len(rows)
    assert decontaminate.decontaminate(documents(spark, []), spark.createDataFrame(items, schema)).count() == 0


def test_decontamination_matches_brute_force(spark):
    """Every document against every item over the whole text, with items of one and two words and equal ones."""
    rng = random.Random(12)
    items = [(k, " ".join(words(rng.choice([4, 9, 25]), 700 + k, 5000))) for k in range(8)] + [(20, "alpha beta"), (21, "gamma"), (22, "alpha beta"), (23, "w1 w2 w3")]
    rows = []
    for k in range(40):
        w = words(rng.choice([3, 40, 120]), 60 + k, 5000)
        if k % 3 == 0:
            own = items[k % 8][1].split()
            if len(own) > 20:
                own[7] = "changed"
            at = rng.randrange(len(w))
            w[at:at] = own
        rows.append((k, " ".join(w), None))
    rows += [(50, "Alpha, BETA and more words", None), (51, "beta then alpha", None), (52, "x gamma", None), (53, "gamma", None), (None, "alpha beta", None), (53, "nothing", None), (54, "", None)]
    plain = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    want, dirty = [], set()
    for n, (i, t, _) in enumerate(rows):
        for k, item in items:
            a, b = plain(item), plain(t)
            score = plain_alignment(a, b) / (2 * len(a)) if b else 0
            # by the method a match has a run of three of the item's words, or the item whole if it is shorter
            runs = {tuple(b[j : j + min(3, len(a))]) for j in range(len(b))}
            if score >= 0.5 and any(tuple(a[j : j + min(3, len(a))]) in runs for j in range(len(a) - min(3, len(a)) + 1)):
                want.append((i, k, round(float(score), 9)))
                dirty.add(n)
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.contaminated(documents(spark, rows), frame).collect()
    assert len(want) > 14 and sorted(((r.doc_id, r.item_id, round(r.score, 9)) for r in got), key=repr) == sorted(want, key=repr)
    clean = decontaminate.decontaminate(documents(spark, rows), frame).collect()
    assert sorted(r.text for r in clean) == sorted(t for n, (_, t, _) in enumerate(rows) if n not in dirty)
