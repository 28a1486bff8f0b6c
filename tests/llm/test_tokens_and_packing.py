"""Tokenizing, packing and token files against the tokenizers library itself."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumicell.llm import packing, token_store
from lumicell.llm.encode import PieceEncoder
from tests.llm.util import EDGES, documents, library_ids, public_tokenizers, words

TOKENIZERS = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]
ODD = ["", " ", "a  b", "\n\n a\tb ", "it's d'accord", "<|endoftext|> x", "İ ΑΣ Σ", "é ́x", "a   b", "x​z", "\x0b\x1cq", "中文 テスト 1234.5", "a" * 300 + " b", None]
ODD += ["don't.'s x.'s '.a <a|b> a|b.c \"it's\" (x)'s", "\r\n\r\n x \r\n", "a, b;c-d_e/f 12.5% 1,000.00 $5 a1b2 1a.2b", "é.é .́ á,b", "...a!!! b???c ''' \"\"", "'s 't 're x's\n's"]
ODD += ["   ", "\n", "  x", "x  ", "\x00a \x01.b", "<|startoftext|>a.<|endoftext|>", "İ.İ ǅ,ǆ ﬁ.ﬁ", "😀.a😀 a😀,b", "a‍b.c"]


@pytest.mark.parametrize("name,keep_space", TOKENIZERS)
def test_pieces_give_the_librarys_ids(name, keep_space):
    enc, rng = PieceEncoder(public_tokenizers.path(name), keep_space), random.Random(1)
    letters = list("ab'S. ,\n\té1中İ|<>-́_~`^s t")
    fuzz = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(2000)]
    for texts in (ODD, ODD, [*fuzz, *(" ".join(words(50, k)) for k in range(5))]):
        ids, off = enc.encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == library_ids(name, texts)
    assert [len(x) for x in enc.encode(pa.array([], pa.string()))] == [0, 1]


def test_a_full_table_of_pieces_is_emptied(monkeypatch):
    monkeypatch.setattr("lumicell.llm.encode.SLOT_BITS", 6)
    monkeypatch.setattr("lumicell.llm.encode.POOL_IDS", 50)
    enc = PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), True)
    for k in range(6):
        texts = [" ".join(words(60, 10 * k + j)) for j in range(4)]
        ids, off = enc.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == library_ids("byte_bpe_50k.json", texts)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_id_code_round_trip(values):
    v = np.array(values, np.uint32)
    assert token_store.unpack_ids(token_store.pack_ids(v), len(v)).tolist() == values


def test_token_files_round_trip(spark, tmp_path, monkeypatch):
    """What a reader that knows the folder alone gives; files and blocks are in order of doc_id."""
    monkeypatch.setattr(token_store, "FILE_ROWS", 8)
    path, store = public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "store")
    rows = EDGES + [(50 - k, " ".join(words(30, k)), None) for k in range(30)] + [(99, "long " * 70_000, None)] + [(4, " ".join(words(k, k)), None) for k in range(20)]
    token_store.write_token_files(documents(spark, rows).repartition(3), store, path, False, 2)
    out = token_store.read_token_files(spark.newSession(), store, with_ids=True).collect()
    want = {}
    for (i, _, _), ids in zip(rows, library_ids("word_bpe_49k.json", [t for _, t, _ in rows])):
        want.setdefault(i, []).append([*ids, 2])
    got = {}
    for r in out:
        assert r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        got.setdefault(r.doc_id, []).append(r.ids)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(out, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i))
    blocks = spark.read.parquet(f"{store}/blocks").orderBy("file", "block").collect()
    assert len({b.file for b in blocks}) > 3 and order == [i for b in blocks for i in token_store.read_block(b.data)[0]]
    empty = str(tmp_path / "empty")
    token_store.write_token_files(documents(spark, []), empty, path, False, 2)
    assert token_store.read_token_files(spark, empty).count() == 0


def test_a_split_of_blocks_is_not_one_batch(spark, tmp_path):
    """Python gets a bounded number of bytes of blocks at once, and what is written comes in small row groups."""
    session, store, bound = spark.newSession(), str(tmp_path / "store"), 1 << 20
    bytes_key, vectors_key = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
    before = [session.conf.get(k, None) for k in (bytes_key, vectors_key)]
    text = " ".join(words(50_000, 3))
    docs = documents(session, [(k, text, None) for k in range(40)])
    token_store.write_token_files(docs, store, public_tokenizers.path("word_bpe_49k.json"), False, 2)
    assert [session.conf.get(k, None) for k in (bytes_key, vectors_key)] == before  # writing leaves the session as it was
    assert token_store.read_token_files(session, store).count() == 40

    def sizes(batches):
        for b in batches:
            cells = [len(x.as_py()) for x in b.column("data")]
            yield pa.RecordBatch.from_arrays([pa.array([sum(cells)]), pa.array([max(cells)])], ["n", "most"])

    blocks = session.read.parquet(f"{store}/blocks").coalesce(1).select("data")
    batches = blocks.mapInArrow(sizes, "n bigint, most bigint").collect()
    assert sum(b.n for b in batches) > 3 * bound
    assert all(b.n <= bound + b.most for b in batches)
    groups = [m.row_group(g).total_byte_size for f in (tmp_path / "store/blocks").glob("*.parquet") for m in [pq.ParquetFile(f).metadata] for g in range(m.num_row_groups)]
    assert max(groups) < 8 << 20


def test_impossible_limits_are_refused(spark):
    for limits in ((10, 10, 0), (0, 1, 1), (10, 0, 10)):
        with pytest.raises(ValueError):
            packing.VectorPacker(limits, lambda k, s, n: n)
    with pytest.raises(ValueError):
        packing.pack_documents(documents(spark, EDGES), public_tokenizers.path("byte_bpe_50k.json"), max_tokens=-1)


def test_packing_returns_every_id_once(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = EDGES + [(20 + k, " ".join(words(10 + 37 * k, k)), None) for k in range(30)] + [(60, "long " * 70_000, None)]
    out = packing.pack_documents(documents(spark, rows).repartition(2), path).collect()
    every = library_ids("byte_bpe_50k.json", [t for _, t, _ in rows])
    for (i, _, _), ids in list(zip(rows, every))[8:]:
        ids, at = np.array([*ids, 0], "<u4"), 0
        for r in sorted((r for r in out if r.doc_id == i), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert sum(r.length for r in out) == sum(len(ids) + 1 for ids in every)
    assert {(r.doc_id, r.length) for r in out if r.doc_id in (1, 2)} == {(1, 1), (2, 1)}
    totals = {}
    for r in out:
        totals[r.sequence_id] = totals.get(r.sequence_id, 0) + r.length
    assert all(n & (n - 1) == 0 and n <= 1024 for n in totals.values())
    assert packing.pack_documents(documents(spark, []), path).count() == 0


def test_short_documents_fill_sequences(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = packing.pack_documents(documents(spark, [(k, "a b", None) for k in range(2000)]).coalesce(1), path).groupBy("sequence_id").sum("length").collect()
    padded = sum(1024 if r[1] & (r[1] - 1) else r[1] for r in out)
    assert sum(r[1] for r in out) == 6000 and padded < 1.02 * 6000


def test_instructions_keep_all_three_limits(spark):
    """Prompts and responses of conversations; with each limit left out the result differs, so each binds."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    replies = turns.where("role = 'assistant'").selectExpr("conv_id * 1000 + turn as example_id", "conv_id as c", "turn as t", "text as response")
    asked = turns.selectExpr("conv_id as c", "turn + 1 as t", "text as prompt")
    examples = replies.join(asked, ["c", "t"], "left").select("example_id", "prompt", "response", F.lit("x").alias("loss_tokens"))
    examples = examples.unionByName(spark.createDataFrame([(None, None, None, "x"), (7, "p", None, "x"), (7, "p", None, "x"), (8, "w " * 5000, "r " * 3000, "x"), *[(500 + k, "short", "one", "x") for k in range(40)]], examples.schema))
    # short examples meet the limit on segments, replies that on loss, long prompts that on tokens; in one order, whatever the join gives
    examples = spark.createDataFrame(sorted(examples.collect(), key=repr), examples.schema).coalesce(1)
    limits = {"max_tokens": 1024, "max_segments": 4, "max_loss": 256}
    out = packing.pack_instructions(examples, path, **limits).collect()
    sequences, pieces = {}, {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, r.loss_tokens))
        pieces.setdefault(r.example_id, []).append((r.start, r.length, r.example_tokens))
    for v in sequences.values():
        v.sort()
        assert sum(n for _, n, _ in v) <= 1024 and len(v) <= 4 and sum(x for *_, x in v) <= 256
        assert all(a + n == b for (a, n, _), (b, _, _) in zip(v, v[1:])) and v[0][0] == 0
    rows = examples.collect()
    first, second = (library_ids("byte_bpe_50k.json", [r[c] for r in rows]) for c in ("prompt", "response"))
    want = {}
    for r, p, q in zip(rows, first, second):
        want[r.example_id] = want.get(r.example_id, 0) + len(p) + len(q) + 1
    assert {k: sum(n for _, n, _ in v) for k, v in pieces.items()} == want
    assert sum(r.loss_tokens for r in out) == sum(len(q) + 1 for q in second)
    assert len(pieces[7]) == 2 and len(pieces[8]) > 8
    placed = lambda rows: sorted((r.example_id or 0, r.start, r.sequence_id, r.offset) for r in rows)
    for name in limits:
        assert placed(packing.pack_instructions(examples, path, **(limits | {name: 1 << 16})).collect()) != placed(out)


def test_packer_keeps_every_limit():
    rng = random.Random(8)
    masked = {k: rng.random() < 0.4 for k in range(900)}  # instructions bear no loss

    def loss(key, start, length):
        return 0 if masked[key] else length

    for cut in (True, False):
        packer = packing.VectorPacker((128, 5, 100), loss, cut=cut, window=64)
        sizes = {k: rng.randrange(1, 100 if not cut else 400) for k in range(900)}
        pieces = [p for k, n in sizes.items() for p in packer.add(k, n)] + list(packer.flush())
        by_key, by_sequence = {}, {}
        for key, start, length, sequence, offset in pieces:
            by_key.setdefault(key, []).append((start, length))
            by_sequence.setdefault(sequence, []).append((offset, length, loss(key, start, length)))
        assert {k: sum(n for _, n in v) for k, v in by_key.items()} == sizes
        for v in by_key.values():
            v.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(v, v[1:])) and v[0][0] == 0
        for v in by_sequence.values():
            v.sort()
            assert sum(n for _, n, _ in v) <= 128 and len(v) <= 5 and sum(x for *_, x in v) <= 100
            assert all(a + n == b for (a, n, _), (b, _, _) in zip(v, v[1:])) and v[0][0] == 0
    with pytest.raises(ValueError):
        list(packing.VectorPacker((10, 1, 10), lambda k, s, n: n, cut=False).add("x", 11))
