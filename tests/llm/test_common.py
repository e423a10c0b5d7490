"""What operators share: the folder, broadcasts by size, repeated rows apart."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from hypnoflow.llm import common


def test_folder_off_one_machine_must_be_named():
    none = SimpleNamespace(isDefined=lambda: False)
    sc = SimpleNamespace(master="spark://elsewhere:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    spark = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda key, default: default))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(spark)


def test_broadcast_only_what_is_small(spark):
    hint = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    small, large = spark.range(10), spark.range(common.BROADCAST_BYTES // 100)
    assert hint(common.broadcastable(small, 8)) and hint(common.broadcastable(small.limit(0), 8))
    assert not hint(common.broadcastable(large, 101)) and not hint(common.broadcastable(small, F.lit(common.BROADCAST_BYTES)))


def test_repeats_apart(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, "d"), (3, "d"), (3, "e")], "k bigint, v string").repartition(3)
    seen, once, again = common.repeats_apart(df, "k", "row", F.length("v"))
    assert {tuple(r) for r in seen.collect()} == {(1, 1, 1), (2, 2, 2), (3, 3, 3)}
    assert [tuple(r) for r in once.collect()] == [(1, "a")]
    rows = again.collect()
    assert sorted((r.k, r.v) for r in rows) == [(2, "b"), (2, "c"), (3, "d"), (3, "d"), (3, "e")] and len({r.row for r in rows}) == 5
    assert again.collect() == rows
    assert common.repeats_apart(df.limit(0), "k", "row")[2] is None
