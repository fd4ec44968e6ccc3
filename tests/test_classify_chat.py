import numpy as np
import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from dataweft.operators import chat, classify, experiments
from dataweft.operators.classify import Line

POINTS = [(2.0, 1.0, 1), (1.0, 2.0, -1), (1.0, 3.0, 1), (0.0, 0.5, -1)]
DIAGONAL = Line(1, -1, 0)


def points(spark):
    return spark.createDataFrame(POINTS, "x double, y double, label int")


def test_losses_by_hand(spark):
    p = points(spark)
    assert sorted(r.margin for r in classify.margins(p, DIAGONAL).collect()) == [-2.0, 0.5, 1.0, 1.0]
    got = [classify.mean_loss(p, DIAGONAL, k).first()[0] for k in classify.LOSSES]
    assert got == [0.875, 0.625, 0.5]
    assert classify.objective(p, DIAGONAL, 10, "hinge").first()[0] == 35.0
    assert classify.objective(p, DIAGONAL, 10, "hard", "squared").first()[0] == 1 + 20 * 2


def test_correct_count_rules(spark):
    p = points(spark)
    assert classify.correct_count(p, DIAGONAL).first()[0] == 1
    assert classify.correct_count(p, DIAGONAL, "margin").first()[0] == 3
    assert classify.correct_count(p, Line(1, 0, 0)).first()[0] == 2  # vertical: height 0


def test_grid_takes_the_first_best(spark):
    lines = [("hinge", 1.0, Line(0, 1, -1.5)), ("hinge", 10.0, Line(0, 1, -1.5)), ("ramp", 1.0, DIAGONAL)]
    got = classify.choose(classify.grid(points(spark), lines))
    assert rows(got, "loss", "c", "correct") == [("hinge", 1.0, 2), ("ramp", 1.0, 1)]


def separable(spark, n):
    rng = np.random.default_rng(0)
    data = []
    for _ in range(n):
        label = int(rng.choice([-1, 1]))
        data.append((float(rng.uniform(0, 2)), float(rng.uniform(0, 2) + 3 * label), label))
    return spark.createDataFrame(data, "x double, y double, label int")


def test_fit_separates_and_refits_on_more_points(spark):
    few, many = separable(spark, 20), separable(spark, 400)
    assert classify.correct_count(few, classify.fit_linear_svc(few, 10.0), "margin").first()[0] == 20
    assert classify.correct_count(many, classify.fit_linear_svc(many, 10.0), "margin").first()[0] == 400


def test_all_settings_are_fitted_in_one_pass(spark):
    """Few jobs; no line near has a lower objective, nor has the fit of one setting alone."""
    far = spark.createDataFrame([(1.0, 12.0, -1)] * 3, "x double, y double, label int")
    p = separable(spark, 60).unionByName(far).withColumn("x", F.col("x") / 3).cache()
    spark.sparkContext.setJobGroup("grid", "grid")
    lines = classify.fit_grid(p, (0.1, 10.0))
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("grid")) < 60
    spark.sparkContext.setJobGroup("rest", "rest")
    data = np.array([(r.x, r.y, r.label) for r in p.collect()])

    def value(line, c, cap):
        gap = np.maximum(0, 1 - data[:, 2] * (line.w0 * data[:, 0] + line.w1 * data[:, 1] + line.b))
        return (line.w0 ** 2 + line.w1 ** 2) / 2 + c * np.minimum(cap, gap).sum()

    assert [(kind, c) for kind, c, _ in lines] == [(kind, c) for kind in classify.LOSSES for c in (0.1, 10.0)]
    rng = np.random.default_rng(1)
    for kind, c, line in lines:
        cap = 1 - classify.CUT_OFF.get(kind, -np.inf)
        best = value(line, c, cap)
        assert best <= value(Line(0.0, 0.0, 0.0), c, cap)
        for size in (1e-3, 1e-2, 0.1):  # nothing near is better
            assert all(best <= value(Line(*(np.array(line) + rng.normal(0, size, 3))), c, cap) * 1.0001 + 1e-4 for _ in range(200))
    alone = classify.refit(p, "hinge", 10.0)
    assert value(lines[1][2], 10.0, np.inf) <= 1.0001 * value(alone, 10.0, np.inf)
    with pytest.raises(ValueError, match="no points"):
        classify.fit_grid(p.limit(0), (1.0,))
    with pytest.raises(ArithmeticError):
        classify.fit_grid(p.unionByName(spark.createDataFrame([(float("nan"), 1.0, 1)], "x double, y double, label int")), (1.0,))


def test_robust_fit_ignores_far_outliers(spark):
    far = spark.createDataFrame([(1.0, 12.0, -1)] * 3, "x double, y double, label int")
    p = separable(spark, 60)
    mixed = p.unionByName(far)
    robust = classify.fit_robust_svc(mixed, 10.0)
    right = classify.correct_count(p, robust, "margin").first()[0]
    plain = classify.correct_count(p, classify.fit_linear_svc(mixed, 10.0), "margin").first()[0]
    assert right >= plain and right >= 58


CHAT = [(1, 0, "user", "Hi there"), (1, 1, "assistant", "Hello, hello!"), (1, 2, "user", "ok"), (2, 0, "user", "Only one"),
        (3, 4, "user", "late"), (3, 9, "assistant", "Été hello")]


def messages(spark):
    return spark.createDataFrame(CHAT, "conv_id int, turn int, role string, content string").repartition(3)


@pytest.mark.parametrize("most", [100, 2])
def test_nesting_and_reply(spark, most):
    nested = chat.nest_messages(messages(spark), most)
    assert nested.agg(F.sum(F.size("messages"))).first()[0] == len(CHAT)
    want = [(1, "Hello, hello!"), (2, None), (3, "Été hello")]
    assert rows(chat.reply_text(messages(spark))) == want
    assert rows(chat.reply_of_nested(nested)) == want


def test_vocab_encoding_and_labels(spark):
    replies = chat.reply_text(messages(spark))
    vocab = chat.build_vocab(replies, "reply", 3)
    assert rows(vocab, "id", "token", "n") == [(2, "hello", 3), (3, "!", 1), (4, ",", 1)]
    for _ in range(1):
        out = chat.lm_labels(chat.encode(replies, "conv_id", "reply", vocab, 5))
        got = {r.conv_id: r for r in out.collect()}
        assert (got[1].input_ids, got[1].attention_mask, got[1].labels) == ([2, 4, 2, 3, 0], [1, 1, 1, 1, 0], [2, 4, 2, 3, -100])
        assert (got[2].input_ids, got[2].labels, got[2].n_tokens) == ([0] * 5, [-100] * 5, 0)
        assert got[3].input_ids == [1, 2, 0, 0, 0]
    short = chat.encode(replies, "conv_id", "reply", vocab, 3).where("conv_id = 1").first()
    assert short.input_ids == [2, 4, 2] and short.n_tokens == 4


def test_encoding_adds_no_shuffle_for_the_arrays(spark):
    replies = chat.reply_text(messages(spark))
    vocab = chat.build_vocab(replies, "reply", 3)
    text = plan(chat.encode(replies, "conv_id", "reply", vocab, 5))
    assert text.count("Exchange hashpartitioning(conv_id") == 1


def test_prompts_and_batches(spark):
    df = spark.range(40).withColumn("t", F.lit("say"))
    assert chat.to_prompt(df, "t").first().prompt == "### Instruction:\nsay\n\n### Response:\n"
    out = chat.batch_ids(df, ["id"], 16)
    assert rows(out.groupBy("batch_id").count()) == [(0, 16), (1, 16), (2, 8)]
    assert chat.batch_ids(df, ["id"], 16, steps=2).count() == 32


def test_experiments(spark):
    df = spark.createDataFrame([([0.5, -1.0], 1), ([0.2, 2.0], -1)], "v array<double>, y int")
    res = experiments.results_frame(df, "v", "y")
    assert rows(res, "params", "accuracy", "mse") == [(1, 0.5, (0.25 + 1.44) / 2), (2, 0.0, (4.0 + 9.0) / 2)]
    assert experiments.best_config(res, 100).first().params == 1
    assert [r.params for r in experiments.sweep(res, "params").collect()] == [1, 2]
    assert experiments.mse(df, F.col("y") + 2.0, "y").first()[0] == 4.0
    lab = spark.createDataFrame([([0.1, 0.9], 1), ([0.8, 0.8], 1)], "s array<double>, l int")
    assert experiments.categorical_accuracy(lab, "s", "l").first()[0] == 0.5
    known = spark.createDataFrame([("a", 0.3992, 131943, .1202), ("b", 0.363, 99000, .1173), ("c", 0.363, 90000, .118)],
                                  "name string, accuracy double, params int, mse double")
    assert experiments.best_config(known).first().name == "b"


@pytest.mark.parametrize("kind", ["hinge", "ramp"])
def test_refit_takes_the_rounds_of_the_grid(spark, monkeypatch, kind):
    monkeypatch.setattr(classify, "_svc", None)
    p = separable(spark, 60)
    assert classify.correct_count(p, classify.refit(p, kind, 10.0), "margin").first()[0] >= 58
