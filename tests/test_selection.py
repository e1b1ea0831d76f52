"""Votes and best of n."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from goldsieve.operators.selection import best_of_n
from goldsieve.operators.voting import vote_phrased, vote_tagged
from goldsieve.plans.curation import curate, judge, kept_records
from goldsieve.plans.evaluation import evaluate

SAMPLES = "problem_id long, sample_no int, text string"


def _samples(spark, texts_by_problem):
    rows = [
        (problem, n, text)
        for problem, texts in texts_by_problem.items()
        for n, text in enumerate(texts, 1)
    ]
    return spark.createDataFrame(rows, SAMPLES)


def test_ties_go_to_the_answer_seen_first(spark):
    df = _samples(spark, {1: ["answer: 2", "answer: 1", "answer: 2", "answer: 1"]})
    assert vote_phrased(df).collect()[0].answer == "2"
    assert vote_phrased(df.orderBy(F.desc("sample_no"))).collect()[0].answer == "2"


def test_votes_are_strings_and_text_is_the_first_whole_one(spark):
    df = _samples(
        spark, {1: ["<answer>18.0</answer>", "a <answer>18</answer> b", "<answer>18</answer>"]}
    )
    assert [tuple(r) for r in vote_tagged(df).collect()] == [
        (1, "18", "a <answer>18</answer> b")
    ]


def test_invalid_votes_do_not_count(spark):
    df = _samples(spark, {1: ["none", "none", "7"], 2: ["none"], 3: ["<answer></answer>", "x"]})
    rows = {r.problem_id: r.answer for r in vote_tagged(df).collect()}
    assert rows == {1: "7", 3: ""}


def test_vote_against_brute_force(spark):
    pick = random.Random(8)
    problems = {
        p: [f"answer {pick.randint(1, 3)}" for _ in range(pick.randint(1, 9))] for p in range(200)
    }

    def winner(texts):
        counts, first = defaultdict(int), {}
        for n, text in enumerate(texts):
            counts[text] += 1
            first.setdefault(text, n)
        return min(counts, key=lambda text: (-counts[text], first[text])).split()[1]

    found = {r.problem_id: r.answer for r in vote_phrased(_samples(spark, problems)).collect()}
    assert found == {p: winner(texts) for p, texts in problems.items()}


def _completion(reason, answer, closing):
    return (
        f"<trip_before>{'r' * reason}</trip_before><answer>{answer}</answer>"
        f"<end>{'e' * closing}</end>"
    )


def test_best_of_n(spark):
    texts = {
        1: [
            _completion(40, 5, 40),
            _completion(50, "5.0", 40),
            _completion(40, 5, 60),
            _completion(900, 6, 900),
            _completion(901, 5, 30),
            _completion(50, 5, 29),
            None,
        ],
        2: [_completion(40, 6, 40)],
        3: [_completion(40, 5, 40)],
    }
    gold = spark.createDataFrame([(1, "5"), (2, "5"), (3, "")], "problem_id long, gold string")
    [best] = best_of_n(_samples(spark, texts), gold).collect()
    # The second and third samples both score 70; the earlier one wins.
    assert (best.problem_id, best.answer, best.text) == (1, "5.0", texts[1][1])


def test_evaluation_counts_problems_without_answers(spark):
    problems = spark.createDataFrame(
        [(n, n, f"q{n}", "$1,000" if n == 4 else "7") for n in range(1, 6)],
        "problem_id long, id long, question string, gold string",
    )
    samples = _samples(
        spark, {1: [" 7 "], 2: ["8"], 3: ["<answer></answer>"], 4: ["<answer>$1,000</answer>"]}
    )
    results, accuracy = evaluate(problems, samples)
    rows = {r.id: (r.assistant_answer, r.answer, r.exact_match) for r in results.collect()}
    assert rows == {
        1: ("7", "7", True),
        2: ("8", "8", False),
        3: ("<answer></answer>", "", False),
        4: ("<answer>$1,000</answer>", "1000", False),
        5: (None, None, False),
    }
    assert tuple(accuracy.collect()[0]) == (1, 5, 20.0, 0.2)


@pytest.mark.parametrize("seed", range(3))
def test_evaluation_ignores_row_order(spark, folder, seed):
    from goldsieve.sources.derived import derived_completions, derived_problems

    problems = derived_problems(spark, folder).withColumn("id", F.col("problem_id"))
    samples = derived_completions(spark, folder)
    shuffled = samples.orderBy(F.xxhash64("problem_id", "sample_no", F.lit(seed)))
    plain, mixed = (evaluate(problems, s).results.collect() for s in (samples, shuffled))
    assert sorted(plain) == sorted(mixed)


def test_repeated_sample_keys_give_one_row(spark):
    rows = [(1, 1, "<answer>5</answer> b"), (1, 1, "<answer>5</answer> a"), (2, 1, "none")]
    df = spark.createDataFrame(rows, SAMPLES)
    assert [tuple(r) for r in vote_tagged(df).collect()] == [(1, "5", "<answer>5</answer> a")]
    problems = spark.createDataFrame(
        [(n, n, "q", "5") for n in (1, 2, 3)], "problem_id long, id long, question string, gold string"
    )
    assert tuple(evaluate(problems, df).accuracy.first())[:2] == (1, 3)
    twice = [(1, 1, _completion(40, 5, 40)), (1, 1, _completion(40, 6, 90)), (1, 2, _completion(40, 5, 50))]
    best = best_of_n(spark.createDataFrame(twice, SAMPLES), problems.select("problem_id", "gold"))
    assert [r.text for r in best.collect()] == [twice[2][2]]
    with pytest.raises(ValueError, match="must be unique"):
        evaluate(problems.union(problems), df)


def test_every_reject_has_a_reason(spark):
    prompts = spark.createDataFrame(
        [(1, 1, "q", "5"), (2, 2, "q", None), (3, 3, "q", "5")],
        "problem_id long, id long, question string, gold string",
    )
    good = _completion(3, 5, 3)
    rows = [
        (1, 1, good), (1, 2, _completion(3, 6, 3)), (1, 3, "x"), (1, 4, _completion(3, " ", 3)),
        (2, 1, good), (9, 1, good), (None, 1, good), (1, 5, good.split("eee")[0] + "  \n"), (1, 6, None),
    ]
    curated = curate(prompts, spark.createDataFrame(rows, SAMPLES))
    assert [r.assistant_answer for r in curated.kept.collect()] == [good]
    found = {(r.problem_id, r.sample_no): r.reject_reason for r in curated.rejects.collect()}
    assert found == {
        (1, 2): "wrong_answer", (1, 3): "unparsed", (1, 4): "empty_answer", (2, 1): "no_gold",
        (9, 1): "no_problem", (None, 1): "no_problem", (1, 5): "unparsed", (1, 6): "unparsed",
    }
    assert [r.problem_id for r in curated.outstanding.collect()] == [3]
    with pytest.raises(ValueError, match="must be unique"):
        curate(prompts.union(prompts), curated.graded)


def test_judge_takes_any_column_names(spark):
    prompts = spark.createDataFrame(
        [(1, 11, "q", "5", "theirs", "x")],
        "problem_id long, id long, question string, gold string, text string, _known string",
    )
    rows = [(1, 1, _completion(3, 5, 3), "a", "b", 7), (2, 1, "x", "c", "d", 8)]
    samples = spark.createDataFrame(rows, f"{SAMPLES}, _flaw string, _got string, id long")
    graded = judge(samples, prompts)
    assert len(graded.columns) == len(set(graded.columns))
    found = {r.problem_id: (r.kept, r.text, r._flaw, r._got, r.id, r._known) for r in graded.collect()}
    assert found == {1: (True, rows[0][2], "a", "b", 11, "x"), 2: (False, "x", "c", "d", None, None)}
    assert [r.assistant_answer for r in kept_records(graded, "train").collect()] == [rows[0][2]]
