"""Molecules of a cell in the order of their digests."""

import hashlib
import random

import pyarrow as pa
import pytest

from lumicell.functions.digests import Prefixes
from lumicell.model import CellData
from lumicell.operators import cells


def test_digests_of_any_length():
    rng = random.Random(0)
    texts = ["", "é:"] + ["x" * n for n in (53, 54, 55, 56, 63, 64, 118, 119, 120)] + ["".join(rng.choices("ab:é", k=rng.randrange(150))) for _ in range(50)]
    numbers = [1, 9, 10, 99, 100, 12345, 2**31 - 1]
    rows, m = zip(*[(r, n) for r in range(len(texts)) for n in numbers])
    high, low = Prefixes(pa.array(texts)).md5(*(pa.array(x).to_numpy() for x in (rows, m)))
    for r, n, h, k in zip(rows, m, high.tolist(), low.tolist()):
        assert f"{h:016x}{k:016x}" == hashlib.md5(f"{texts[r]}{n}".encode()).hexdigest()


def plain(triples, per_cell, seed):
    got = {}
    for cell in {c for c, _, _ in triples}:
        molecules = sorted((hashlib.md5(f"{seed}:{cell}:{g}:{m}".encode()).hexdigest(), g) for c, g, v in triples if c == cell for m in range(1, int(v) + 1))
        for _, g in molecules[:per_cell]:
            got[cell, g] = got.get((cell, g), 0) + 1
    return got


@pytest.mark.parametrize("rows, molecules", [(10_000, 1 << 14), (3, 50)])
def test_cells_of_any_size(spark, monkeypatch, rows, molecules):
    """Cells over many batches and single values over many blocks too; keys are texts."""
    rng = random.Random(1)
    triples = [(f"c{c}", f"gene-{g}", float(rng.choice((0, 1, 2, 9, 150)))) for c in range(12) for g in range(1 + 9 * (c % 4))] + [("one", "g", 1000.0), ("none", "g", 0.0)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    monkeypatch.setattr(cells, "MOLECULES", molecules)
    d = CellData(spark.createDataFrame(triples, "cell string, gene string, value double"), None, None)
    for per_cell, seed in ((20, 0), (300, 7)):
        got = {(r.cell, r.gene): r.value for r in cells.downsample(d, per_cell, seed).counts.collect()}
        assert got == plain(triples, per_cell, seed)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_what_is_dealt_by_cell_are_stored_rows(spark):
    """A cell of 50,000,000 counts: as rows of molecules it would be some gigabytes of shuffle."""
    d = CellData(spark.createDataFrame([(1, 1, 5e7), (2, 3, 4.0)], "cell bigint, gene bigint, value double"), None, None)
    plan = cells.downsample(d, 20).counts._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "RepartitionByExpression" in plan


def test_fractions_below_one_are_no_molecules(spark):
    d = CellData(spark.createDataFrame([(1, 1, 0.5), (1, 2, 2.0)], "cell bigint, gene bigint, value double"), None, None)
    assert [(r.gene, r.value) for r in cells.downsample(d, 20).counts.collect()] == [(2, 2.0)]
