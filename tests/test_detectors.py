import numpy as np
from pyspark.sql import functions as F

from trustfold.operators import detectors as D


def _long(spark, values, chunk=0, column="x"):
    return spark.createDataFrame([(chunk, i, column, float(v)) for i, v in enumerate(values)],
                                 "chunk_id int, row_id long, column string, value double")


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    vals = np.round(rng.normal(size=60) * 3, 1)
    got = {r["row_id"]: r["score"] for r in D.knn_scores(_long(spark, vals), k=5).collect()}
    for i, v in enumerate(vals):
        d = np.sort(np.abs(np.delete(vals, i) - v))
        assert abs(got[i] - d[4]) < 1e-9


def test_zscore_iqr_mad_flag_the_far_point(spark):
    # with n points a population z-score is at most (n-1)/sqrt(n): use 31 points
    vals = [1, 2, 2, 3, 3, 3, 4, 4, 5, 6] * 3 + [100]
    long = _long(spark, vals)
    p = D.DetectorParams(contamination=0.1, threshold=3.0)
    for name in ("Z-Score", "IQR", "MAD"):
        flagged = {r["row_id"] for r in D.detect(long, p, name).where("is_outlier").collect()}
        assert 30 in flagged, name


def test_contamination_share_bounded(spark):
    rng = np.random.default_rng(5)
    long = _long(spark, rng.normal(size=400))
    p = D.DetectorParams(contamination=0.05, threshold=3.0)
    for name in ("HBOS", "kNN", "LODA"):
        share = D.detect(long, p, name).agg(F.avg(F.col("is_outlier").cast("double"))).first()[0]
        assert share <= 0.05 + 1.0 / 400 + 1e-9, name


def test_learned_detectors_flag_at_most_contamination(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(size=300), [25.0, -30.0]])
    long = _long(spark, vals)
    p = D.DetectorParams(contamination=0.02, threshold=3.0)
    for name in ("IForest", "OC-SVM"):
        out = D.detect(long, p, name)
        assert out.count() == len(vals)
        share = out.agg(F.avg(F.col("is_outlier").cast("double"))).first()[0]
        # strictly above a linearly interpolated percentile: at most c*n plus one row
        assert share <= 0.02 + 1.0 / len(vals) + 1e-9, name
    flagged = {r["row_id"] for r in D.detect(long, p, "IForest").where("is_outlier").collect()}
    assert {300, 301} <= flagged


def test_one_pass_equals_single_methods(spark):
    rng = np.random.default_rng(11)
    long = _long(spark, np.round(rng.normal(size=250), 1)).unionByName(_long(spark, rng.exponential(size=180), chunk=1))
    p = D.DetectorParams(contamination=0.05, threshold=2.0)
    both, names = D.masks(long, p)
    assert names == list(D.METHODS)
    got = {(r["chunk_id"], r["row_id"]): r["mask"] for r in both.collect()}
    assert len(got) == 430
    for name in names:
        single = {(r["chunk_id"], r["row_id"]) for r in D.detect(long, p, name).where("is_outlier").collect()}
        assert single == {k for k, m in got.items() if m & D.bit(name)}, name


def test_knn_over_partition_edges(spark):
    """One group over many range partitions, some with fewer rows than k."""
    vals = np.round(np.random.default_rng(13).normal(size=700) * 2, 2)
    long = _long(spark, vals)
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        got = {r["row_id"]: r["score"] for r in D.knn_scores(long, k=20).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    for i, v in enumerate(vals):
        assert abs(got[i] - np.sort(np.abs(np.delete(vals, i) - v))[19]) < 1e-9


def test_tree_samples_use_the_whole_group(spark):
    from trustfold.operators import learned

    for n in (100, 3000, 60000):
        long = _long(spark, range(n))
        got = learned.tree_samples(long, D.moments(long)).groupBy("tree").agg(F.count("*").alias("n"), F.max("value").alias("m")).collect()
        assert len(got) == 100
        assert all(r["n"] < 400 for r in got) and max(r["m"] for r in got) > 0.98 * n


def test_knn_jobs_do_not_depend_on_partitions(spark):
    """Runs of fewer rows than k in a partition, several groups in one, and the same number of jobs at any number of them."""
    rng = np.random.default_rng(17)
    long = _long(spark, np.round(rng.normal(size=90), 1)).unionByName(_long(spark, rng.random(7), chunk=1)).unionByName(_long(spark, np.zeros(60), chunk=2))
    jobs, scores = [], []
    sc = spark.sparkContext
    for n in (2, 40, 120):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        sc.setJobGroup(f"knn{n}", "")
        scores.append(sorted((r["chunk_id"], r["row_id"], -1 if r["score"] is None else round(r["score"], 9)) for r in D.knn_scores(long, k=20).collect()))
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"knn{n}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert scores[0] == scores[1] == scores[2] and len(scores[0]) == 157
    assert [s for c, _, s in scores[0] if c == 1] == [-1] * 7 and {s for c, _, s in scores[0] if c == 2} == {0}
    assert jobs[0] == jobs[1] == jobs[2] <= 5


def test_value_scores_are_the_rows_scores(spark):
    """Values that come once, a few and many times, in several groups and over many range partitions."""
    rng = np.random.default_rng(19)
    long = _long(spark, np.round(rng.normal(size=300), 1)).unionByName(_long(spark, np.repeat([0.0, 1.0, 5.0], [200, 20, 1]), chunk=1)).unionByName(
        _long(spark, rng.random(9), chunk=2))
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    try:
        rows = {(r["chunk_id"], r["value"]): r["score"] for r in D.knn_scores(long).collect()}
        values = {(r["chunk_id"], r["value"]): (r[D.TIMES], r["score"]) for r in D.value_scores(D.counted_values(long)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert {k: s for k, (_, s) in values.items()} == rows and sum(n for n, _ in values.values()) == 530


def test_masks_sort_values_and_not_rows(spark, monkeypatch):
    """What is sorted does not grow with the rows of a 0/1 column, and flags are the same by either kind of lookup and percentile."""
    from trustfold.plans import percentiles as P

    rng = np.random.default_rng(23)
    values = np.concatenate([np.round(rng.normal(size=200), 1), [40.0]])
    long = _long(spark, values).unionByName(_long(spark, np.arange(900) % 300 == 7, column="f"))
    sizes, sort = [], D.range_sorted

    def counted(df, *args, **kw):
        sizes.append(df.where("column = 'f'" if "column" in df.columns else "false").count())
        return sort(df, *args, **kw)

    monkeypatch.setattr(D, "range_sorted", counted)
    p = D.DetectorParams(contamination=0.05, threshold=2.0)
    get = lambda: {(r["column"], r["row_id"]): r["mask"] for r in D.masks(long, p, list(D.SQL_CHECKABLE))[0].collect()}
    first = get()
    assert sizes == [2] and len(first) == 1101 and first["x", 200] & D.bit("kNN")
    score = {i: np.sort(np.abs(np.delete(values, i) - v))[19] for i, v in enumerate(values)}
    cut = np.percentile(list(score.values()), 95)
    assert {i for i in score if first["x", i] & D.bit("kNN")} == {i for i, s in score.items() if s > cut}
    monkeypatch.setattr(D, "HITS", 0)
    monkeypatch.setattr(P, "SMALL", 5)
    assert get() == first
