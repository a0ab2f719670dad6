import random

import numpy as np
from pyspark.sql import functions as F

from capturelake.operators import scale as S


def numbers(spark, n=400, seed=1):
    rnd = random.Random(seed)
    rows = [(0 if rnd.random() < 0.6 else rnd.randrange(1, 5), i, float(rnd.randrange(40))) for i in range(n)]
    return spark.createDataFrame(rows, "k long, i long, v double")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_positions_do_not_depend_on_the_hot_path(spark):
    df = numbers(spark)
    order = [F.col("v"), F.col("i")]
    plain = S.running_total(df, ["k"], order)
    spread = S.running_total(df, ["k"], order, hot_rows=20)
    assert rows(plain.select("k", "i", "idx")) == rows(spread.select("k", "i", "idx"))


def test_weighted_totals(spark):
    df = numbers(spark)
    order = [F.col("i")]
    w = F.col("v").cast("bigint")
    plain = S.running_total(df, ["k"], order, "t", w)
    spread = S.running_total(df, ["k"], order, "t", w, hot_rows=20)
    assert rows(plain.select("k", "i", "t")) == rows(spread.select("k", "i", "t"))


def test_neighbours_across_chunks(spark):
    df = numbers(spark)
    outputs = {"before": (F.col("i"), -1), "after": (F.col("i"), 1)}
    order = [F.col("v"), F.col("i")]
    plain = S.neighbours(df, ["k"], order, outputs)
    for hot in (2, 7, 50):
        spread = S.neighbours(df, ["k"], order, outputs, hot_rows=hot)
        assert rows(plain.select("i", "before", "after").na.fill(-1)) == rows(
            spread.select("i", "before", "after").na.fill(-1))


def test_percentiles_match_numpy(spark):
    df = numbers(spark)
    want = {"p25": (F.col("v"), 0.25), "p50": (F.col("v"), 0.5), "p95": (F.col("v"), 0.95)}
    frame = df.toPandas()
    for hot in (S.HOT_ROWS, 10):
        for r in S.exact_percentiles(df, ["k"], want, hot_rows=hot).collect():
            values = frame[frame.k == r.k].v
            assert np.allclose([r.p25, r.p50, r.p95], np.percentile(values, [25, 50, 95]))


def test_attach_keeps_every_row(spark):
    df = numbers(spark)
    stats = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))
    plain = rows(df.join(stats, "k").select("k", "i", "n", "top"))
    salted = S.attach(df, stats, ["k"], F.col("n"), hot_rows=30)
    assert rows(salted.select("k", "i", "n", "top")) == plain
    shape = S.measure(df, ["k"])
    assert rows(S.attach(df, stats, ["k"], F.col("n"), shape=shape).select("k", "i", "n", "top")) == plain


def test_first_rows(spark):
    df = numbers(spark)
    got = rows(S.first_rows(df, ["k"], [F.col("v"), F.col("i")], 5, rank="r").select("k", "r", "i"))
    frame = df.toPandas().sort_values(["k", "v", "i"])
    frame["r"] = frame.groupby("k").cumcount() + 1
    want = sorted(tuple(int(x) for x in r) for r in frame[frame.r <= 5][["k", "r", "i"]].to_numpy())
    assert got == want


def test_released_checkpoints_leave_no_files(spark):
    from pathlib import Path

    from capturelake.session import durable, release, shared_dir

    def files():
        return sum(1 for _ in Path(shared_dir(spark)).glob("*/rdd-*/part-*"))

    before = files()
    held = durable(spark.range(100).repartition(4))
    assert held.count() == 100 and files() > before
    release(held, spark.range(3))
    assert files() == before
