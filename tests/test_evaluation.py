"""Scores of answers from a judge's verdicts, in one plan."""

import math

import pytest
from pyspark.sql import functions as F

from vektorloom.operators import scoring
from vektorloom.plans import evaluation
from vektorloom.plans.evaluation import METRICS, evaluate_answers, evaluate_one, evaluate_rows

SCHEMA = "q_id string, user_input string, response string, retrieved_contexts array<string>, reference string"


def rows_of(spark):
    return spark.createDataFrame(
        [
            ("a", "where is it", "It is here. Far away!", ["it is here", "nothing", "near it"], "It is here. It is near."),
            ("b", "why", "because", [], "no"),
            ("c", None, None, None, None),
            ("bad", "x", "boom", ["x"], "x"),
        ],
        SCHEMA,
    )


def picky():
    """Fails on a whole batch that holds a bad row, and has no word on empty questions."""

    def assess(rows):
        if any(r["response"] == "boom" for r in rows):
            raise RuntimeError("cannot read this")
        inner = evaluation.overlap_judge()()
        return [v if r["user_input"] else None for r, v in zip(rows, inner(rows))]

    return assess


def test_scores_by_hand(spark):
    got = {r.q_id: r for r in evaluate_rows(rows_of(spark).coalesce(1), lambda: picky()).collect()}
    a = got["a"]
    assert (a.context_recall, a.faithfulness, a.factual_f1, a.answer_accuracy) == (1.0, 0.5, 2 / (2 + 1 + 1), 0.5)
    assert a.context_precision == pytest.approx((1 / 1 + 2 / 3) / 2) and a.error is None
    # where/is/it and it/is/here/far/away share two words
    assert a.answer_relevancy == pytest.approx(2 / math.sqrt(3 * 5)) and a.bleu > 0
    b = got["b"]
    assert (b.context_recall, b.context_precision, b.faithfulness, b.answer_accuracy, b.factual_f1) == (0.0, None, 0.0, 0.0, 0.0)
    assert got["c"].error == "no verdict" and all(got["c"][m] is None for m in METRICS[:-1])
    assert got["bad"].error == "RuntimeError: cannot read this" and got["bad"].faithfulness is None


def test_scores_agree_with_verdict_rows(spark):
    """The expressions over lists and the operators over verdict rows are two ways to the same scores."""
    judged = evaluation.judged(rows_of(spark).where("q_id IN ('a', 'b')"))
    lists = {r.q_id: r for r in evaluation.scores(judged).collect()}
    each = lambda name, value: judged.select("q_id", F.posexplode(f"verdicts.{name}").alias("rank", value))
    for table, name in [
        (scoring.context_recall(each("supported", "supported")), "context_recall"),
        (scoring.faithfulness(each("faithful", "supported")), "faithfulness"),
        (scoring.context_precision(each("relevant", "relevant")), "context_precision"),
        (scoring.factual_f1(each("outcomes", "outcome")), "factual_f1"),
        (scoring.answer_accuracy(each("ratings", "rating")), "answer_accuracy"),
        (scoring.bleu(rows_of(spark)), "bleu"),
    ]:
        for key, value in table.collect():
            if key in lists:
                assert value == pytest.approx(lists[key][name]), name


def test_judge_is_called_once_per_row(spark, tmp_path):
    count = spark.sparkContext.accumulator(0)

    def judge():
        def assess(rows):
            count.add(len(rows))
            return evaluation.overlap_judge()()(rows)

        return assess

    found = evaluate_rows(rows_of(spark), judge, csv=str(tmp_path / "scores"))
    assert count.value == 4 and found.count() == 4 and found.where("error IS NULL").count() == 4 and count.value == 4
    back = {r.q_id: r for r in found.collect()}
    assert back["a"].retrieved_contexts == ["it is here", "nothing", "near it"] and back["a"].response == "It is here. Far away!"
    assert back["a"].faithfulness == 0.5 and back["b"].context_precision is None
    means = evaluate_answers(rows_of(spark), metrics=("faithfulness", "bleu"))[1].first()
    assert set(means.asDict()) == {"faithfulness", "bleu"}
    with pytest.raises(ValueError):
        evaluate_rows(rows_of(spark), metrics=("charm",))


def test_one_answer(spark):
    got = evaluate_one(spark, "what swims", "fish swim", ["fish swim in water"], "fish swim", metrics=("context_recall", "factual_f1"))
    assert got == {"context_recall": 1.0, "factual_f1": 1.0}


def test_no_shuffle_after_the_judge(spark):
    plan = evaluate_rows(rows_of(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "RoundRobin" in plan
