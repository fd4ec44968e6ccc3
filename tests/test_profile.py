import numpy as np
from conftest import rows

from dataweft.operators import profile


def table(spark):
    return spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 4.0), (None, None), ("c", 4.0)], "c string, v double")


def test_counts_and_shares(spark):
    df = table(spark)
    assert rows(profile.shape(df)) == [(5, 2)]
    assert rows(profile.null_counts(df)) == [("c", 1), ("v", 1)]
    assert rows(profile.missing_pct(df)) == [("c", 20.0), ("v", 20.0)]
    assert rows(profile.nunique(df)) == [("c", 3), ("v", 3)]
    assert rows(profile.value_share(df, "c"), "c", "share") == [("a", 50.0), ("b", 25.0), ("c", 25.0)]
    assert rows(profile.value_counts(df, "c")) == [(None, 1), ("a", 2), ("b", 1), ("c", 1)]
    assert rows(profile.schema_table(df), "column_name", "type", "non_null") == [("c", "string", 4), ("v", "double", 4)]
    assert rows(profile.group_sizes(df, ["c", "v"])) == [("a", 1.0, 1), ("a", 2.0, 1), ("b", 4.0, 1), ("c", 4.0, 1)]


def test_describe(spark):
    df = table(spark)
    r = profile.describe_num(df, ["v"]).first()
    assert (r.n, r["min"], r.q25, r.q50, r.q75, r["max"]) == (4, 1.0, 1.75, 3.0, 4.0, 4.0)
    assert np.isclose(r["std"], np.std([1, 2, 4, 4], ddof=1)) and np.isclose(r["mean"], 2.75)
    assert rows(profile.describe_cat(df, ["c", "v"]), "column_name", "n", "n_distinct", "top", "freq") == [
        ("c", 4, 3, "a", 2), ("v", 4, 3, "4.0", 2)]


def test_summaries(spark):
    df = table(spark)
    assert rows(profile.numeric_summary(df, "v"), "n", "min", "max", "avg", "median") == [(4, 1.0, 4.0, 2.75, 3.0)]
    got = rows(profile.grouped_summary(df, ["c"], "v"), "c", "n", "median")
    assert got == [(None, 0, None), ("a", 2, 1.5), ("b", 1, 4.0), ("c", 1, 4.0)]


def test_correlation(spark):
    df = spark.createDataFrame([(1, 2, 3), (2, 4, 1), (3, 6, 2)], "a int, b int, c int")
    got = {r.column_name: r["corr"] for r in profile.correlations(df, [("a", "b"), ("a", "c")]).collect()}
    assert np.isclose(got["a~b"], 1.0) and np.isclose(got["a~c"], -0.5)


def test_sketches_merge_and_keep_their_error(spark):
    rng = np.random.default_rng(4)
    data = [(g, int(d), float(v)) for g in "ab" for d, v in zip(rng.integers(0, 5, 400), rng.lognormal(3, 2, 400) * rng.choice([-1, 1, 1], 400), strict=True)]
    data += [("z", 0, 0.0), ("z", 1, 7.0), ("z", 2, None), ("n", 0, float("nan"))]
    df = spark.createDataFrame(data, "g string, d int, v double")
    probs = {"low": 0.05, "mid": 0.5, "high": 0.99}
    daily = profile.sketch(df, ["g", "d"], "v", 0.02)
    got = {r.g: r for r in profile.sketch_quantiles(daily, ["g"], probs, 0.02).collect()}
    assert set(got) == {"a", "b", "z"}
    for g, r in got.items():
        values = sorted(v for x, _, v in data if x == g and v is not None)
        assert r.n == len(values)
        for name, p in probs.items():
            exact = values[int(np.floor(p * (len(values) - 1)))]
            assert abs(r[name] - exact) <= 0.02 * abs(exact) + 1e-12
    whole = profile.sketch(df, ["g"], "v", 0.02)
    assert rows(profile.merge_sketches(daily, ["g"])) == rows(whole)
