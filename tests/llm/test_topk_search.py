"""Exact search: many blocks and groups against brute force, and the shared folder."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowsense.llm import common, topk_search


def test_grid_of_blocks_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "SIDE", 2)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(700, 6)) * rng.choice([1, 1, 5], size=(700, 1))
    v[100:160] = v[7]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("group", F.lit(1))
    got = sorted(map(tuple, topk_search.topk(df, F.col("vec_id") % 5 == 0, block=20, groups=6, first=2).collect()))
    whole = np.floor(256 * v).astype(np.int64)
    expected = []
    for q in range(0, 700, 5):
        scores = whole @ whole[q]
        best = sorted((-int(s), i) for i, s in enumerate(scores) if i != q)[:5]
        expected += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert got == sorted(expected)


def test_shared_folder_has_a_scheme(spark):
    assert common.shared_dir(spark).startswith("file:///")
    before = spark.conf.get("spark.checkpoint.dir")
    held, asked = type(spark.conf).get, "spark.checkpoint.dir"

    def unset(self, key, *default):
        return default[0] if key == asked else held(self, key, *default)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(spark.conf), "get", unset)
        assert common.shared_dir(spark).startswith("file:///")
        m.setattr(spark.sparkContext, "master", "spark://host:7077")
        with pytest.raises(ValueError, match="checkpoint"):
            common.shared_dir(spark)
    assert spark.conf.get("spark.checkpoint.dir") == before


def test_a_worker_holds_one_stage_at_a_time():
    one = common.hold("one", list)
    assert common.hold("one", list) is one
    common.hold("other")
    assert common.hold("one", list) is not one


@pytest.mark.parametrize("scale", [1, 3000, 1 << 19, 1 << 22])
def test_cell_equals_brute_force_at_every_width(scale):
    """One product of matrices a pair of blocks; small numbers travel in two bytes; ties, copies and shared ids as in a plain sort."""
    rng = np.random.default_rng(4)
    v = rng.integers(-200, 200, (400, 8)) * scale
    v[50:250] = v[7]
    ids = np.arange(400)
    ids[:2] = 5
    wide = 2 if scale == 1 else 4

    def block(rows):
        rows = rows[np.argsort(ids[rows], kind="stable")]
        assert np.abs(v).max() < 1 << (8 * wide - 1)
        return {"ids": ids[rows].tobytes(), "v": v[rows].astype(f"<i{wide}").tobytes(), "wide": wide, "r": b"", "top": float(np.linalg.norm(v[rows].astype(float), axis=1).max()), "kths": None}

    asked, here = [block(np.arange(0, 400, 3))], [block(np.arange(0, 150)), block(np.arange(150, 400))]
    got = [tuple(r.values()) for b in topk_search.meet_cell(asked, here, 8, 5) for r in b.to_pylist()]
    expected = []
    for q in range(0, 400, 3):
        best = sorted((-int(s), int(i)) for i, s in zip(ids, v.astype(object) @ v[q].astype(object)) if i != ids[q])[:5]
        expected += [(int(ids[q]), i, -s) for s, i in best]
    assert sorted(got) == sorted(expected)


def test_blocks_travel_in_two_bytes_a_component(spark):
    rows = topk_search.whole_vectors(spark.createDataFrame([(i, [0.5, -1.0, 0.25]) for i in range(40)], "vec_id long, embedding array<float>"), "vec_id", "embedding", 256)
    packed = topk_search.block_bytes(rows.withColumn("group", F.lit(0).cast("long")), 3, None, 2, 64).collect()
    assert sum(len(r["v"]) for r in packed) == 40 * 3 * 2
