"""Views, vector expressions, run-log meters (edge rows and the skew-split paths)."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from quiver.functions import text as T
from quiver.functions import vectors as V
from quiver.operators import runlog, views


def test_first_and_sampled_question(spark):
    df = spark.createDataFrame([(1, ["  ", None, " a ", "b"]), (2, []), (3, None), (4, ["\tx\n"])],
                               "id long, questions array<string>")
    got = {r.id: r.q for r in df.select("id", T.first_question("questions").alias("q")).collect()}
    assert got == {1: "a", 2: "", 3: "", 4: "x"}
    s = {r.id: r.q for r in df.select("id", T.sampled_question("questions", "id", F.lit(7)).alias("q")).collect()}
    assert s[1] in ("a", "b") and s[2] == "" and s[3] == "" and s[4] == "x"


def test_masks(spark):
    df = spark.createDataFrame([(1, " ", b"x"), (2, "", None), (3, None, b"")], "id long, txt string, img binary")
    got = {r.id: (r.txt, r.txt_mask, r.img_mask) for r in views.with_masks(df).collect()}
    assert got == {1: (" ", 1, 1), 2: ("", 0, 0), 3: ("", 0, 1)}
    ok, rejected = views.valid_queries(views.with_masks(df))
    assert sorted(r.id for r in ok.collect()) == [1, 3] and [r.id for r in rejected.collect()] == [2]


def test_candidate_and_query_views(spark):
    corpus = spark.createDataFrame([(1, b"i", "cap", [" q "])],
                                   "id long, image binary, caption string, questions array<string>")
    c = {r.modality: (r.txt, r.img) for m in ["it", "i", "t", "zz"] for r in views.candidate_view(corpus, m).collect()}
    assert c == {"it": ("cap", bytearray(b"i")), "i": ("", bytearray(b"i")), "t": ("cap", None), "zz": ("", None)}
    q = {r.modality: r.txt for m in ["it", "i", "t"] for r in views.query_view(corpus, m).collect()}
    assert q == {"it": "q", "i": "", "t": "q"}
    try:
        views.query_view(corpus, "zz")
        raise AssertionError("unknown query mode must raise")
    except ValueError:
        pass


def test_weight_clamped_and_on_text(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0])], "img array<double>, txt array<double>")
    for w, want in [(1.7, [0.0, 1.0]), (-0.2, [1.0, 0.0]), (0.25, [0.75, 0.25])]:
        assert df.select(V.fuse_weighted("img", "txt", w).alias("v")).collect()[0].v == want


def test_normalisation_zero_and_eps(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([1e-8, 0.0],)], "v array<double>")
    a = [r.v for r in V.with_l2_normalized(df, "v").collect()]
    b = [r.v for r in V.with_l2_normalized_eps(df, "v").collect()]
    assert a[0] == [0.6, 0.8] and a[1] == [0.0, 0.0] and a[2] == [1.0, 0.0]
    assert b[1] == [0.0, 0.0] and abs(b[2][0] - 0.01) < 1e-12


def test_modality_algebra(spark):
    """Under sum fusion the unit 'i' view is the unit image vector; with text weight 1 it is zero."""
    base = spark.createDataFrame([(1, [3.0, 4.0], [1.0, 0.0], 1, 1)],
                                 "id long, img_vec array<double>, txt_vec array<double>, img_mask int, txt_mask int")
    u = {r.modality: r.vec for r in views.unit_modality_vectors(base).collect()}
    assert u["i"] == [0.6, 0.8] and u["t"] == [1.0, 0.0]
    w1 = {r.modality: r.vec for r in views.modality_vectors(base, "weight", 1.0).collect()}
    assert w1["i"] == [0.0, 0.0]


def test_rolling_median_lower_middle(spark):
    log = spark.createDataFrame([("m", i, float(v), 1) for i, v in enumerate([1, 2, 3, 4])],
                                "metric string, step long, value double, n long")
    r = runlog.rolling_meter(log, ["metric"]).orderBy("step").collect()
    assert [x.median for x in r] == [1.0, 1.0, 2.0, 2.0]
    assert r[-1].avg == 2.5 and r[-1].max == 4.0 and r[-1].window_n == 4


def test_tied_best_epoch_goes_later(spark):
    s = spark.createDataFrame([(1, 0, 3.0), (1, 1, 2.0), (1, 2, 2.0), (2, 0, None), (2, 1, 5.0)],
                              "run_id long, epoch int, loss double")
    got = {r.run_id: r.best_epoch for r in runlog.best_epoch(s).collect()}
    assert got == {1: 2, 2: 1}
    assert {r.run_id: r.best_epoch for r in runlog.best_epoch(s, eval_freq=2).collect()} == {1: 2, 2: 0}


def test_skew_split_paths_equal_plain_windows(spark):
    """One hot series (most rows) split into chunks and halo blocks gives the plain window result."""
    rng = np.random.default_rng(0)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.integers(3)}", int(step), float(np.round(rng.normal(), 2)), 1)
            for step in rng.permutation(3000)]
    log = spark.createDataFrame(rows, "metric string, step long, value double, n long")
    got = runlog.rolling_meter(log, ["metric"], block_rows=37, chunk_steps=101)
    w = Window.partitionBy("metric").orderBy("step").rowsBetween(-19, 0)
    n = F.count(F.lit(1)).over(w)
    want = log.select("metric", "step", n.alias("window_n"),
                      F.element_at(F.array_sort(F.collect_list("value").over(w)), F.ceil(n / 2).cast("int")).alias("median"),
                      (F.sum(F.col("value").cast("decimal(38,12)")).over(w).cast("double") / n).alias("avg"),
                      F.max("value").over(w).alias("max"))
    cols = ["metric", "step", "window_n", "median", "avg", "max"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
    cum = runlog.cumulative_avg(log, ["metric"], chunk_steps=53)
    wc = Window.partitionBy("metric").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    want_c = log.select("metric", "step", F.count(F.lit(1)).over(wc).alias("count"),
                        (F.sum(F.col("value").cast("decimal(38,12)")).over(wc).cast("double")
                         / F.count(F.lit(1)).over(wc)).alias("cum_avg"))
    c = ["metric", "step", "count", "cum_avg"]
    assert sorted(map(tuple, cum.select(*c).collect())) == sorted(map(tuple, want_c.select(*c).collect()))
    best = runlog.running_best(log.withColumnRenamed("step", "epoch"), ["metric"], loss="value", chunk_steps=64)
    want_b = log.select("metric", F.col("step").alias("epoch"),
                        (F.col("value") <= F.min("value").over(wc)).alias("is_best"))
    assert sorted(map(tuple, best.select("metric", "epoch", "is_best").collect())) == \
        sorted(map(tuple, want_b.collect()))


def test_stats_wide_absent_phase(spark):
    s = spark.createDataFrame([(1, 0, "train", "loss", 1.5), (1, 0, "val", "loss", 2.5), (1, 1, "train", "loss", 1.0)],
                              "run_id long, epoch int, phase string, metric string, value double")
    w = {(r.run_id, r.epoch): (r.train_loss, r.val_loss)
         for r in runlog.stats_wide(s, ["run_id", "epoch"], "phase", "metric", "value",
                                    ["train_loss", "val_loss"]).collect()}
    assert w == {(1, 0): (1.5, 2.5), (1, 1): (1.0, None)}


def test_plain_string_questions(spark):
    """A plain-string question list: the sampled draw accepts it, the first-question rule does not."""
    from quiver.operators import pairs
    corpus = spark.createDataFrame([(1, b"i", "cap", "  why?  "), (2, b"j", "cap2", "   ")],
                                   "id long, image binary, caption string, questions string")
    q = {r.id: r.txt for r in views.query_view(corpus, "t").collect()}
    assert q == {1: "", 2: ""}
    p = pairs.train_pairs(corpus, seed=1, modes=["txt_only"])
    got = {r.id: r.query.txt for r in p.collect()}
    assert got == {1: "why?", 2: ""}
