"""Gold and predicted answers, and grading: edge cases with known results."""

import math
import random

import pytest
from pyspark.sql import functions as F

from goldsieve.functions import answers
from goldsieve.functions.numbers import is_correct, to_double
from goldsieve.operators.grading import has_length
from goldsieve.operators.problems import ingest_problems, template_problems


def test_final_answer(texts):
    cases = {
        "x\n#### 1,234": "1234",
        "a #### 5\nb #### 7": "5",
        "x #### 3/4": "3",
        "x #### red": "red",
        "x ####": "",
        "x #####": "#",
        "#### -2.50 units": "-2.50",
        "no marker": None,
    }
    assert texts(cases, answers.final_answer) == list(cases.values())


def test_after_last_marker(texts):
    cases = {"a #### 5\nb #### 1,007 ": "1,007", " plain ": "plain", "a####": "", "a#####b": "#b"}
    assert texts(cases, answers.after_last_marker) == list(cases.values())


@pytest.mark.parametrize(
    "solution, target",
    [
        ("6-2=4\n#### 4", "6-2=4\n<answer>4</answer>"),
        ("so #### 1,000", "so #### 1,000\n<answer>1000</answer>"),
        ("so #### 12", "so\n<answer>12</answer>"),
        ("so ####\n 12", "so\n<answer>12</answer>"),
        ("a #### red\nblue", "a\n<answer>red\nblue</answer>"),
        ("a #### 5 apples", "a #### 5 apples\n<answer>5</answer>"),
        ("a\n  #### 5 apples", "a\n<answer>5</answer>"),
        ("#### 7", "\n<answer>7</answer>"),
        ("x ####", "x\n<answer></answer>"),
        ("x ######## 5", "x ####\n<answer>5</answer>"),
    ],
)
def test_template_target(spark, solution, target):
    raw = spark.createDataFrame([("q", solution)], "question string, answer string")
    [row] = template_problems(raw).rows.collect()
    assert row.assistant_target == target


def test_template_splits_rows_and_rejects(spark):
    raw = spark.createDataFrame(
        [(" q1\r\n", "a #### 1"), ("q2", "none"), ("q3", None)],
        "question string, answer string",
    )
    rows, rejects = template_problems(raw)
    assert [tuple(r) for r in rows.collect()] == [("q1", "a\n<answer>1</answer>", "1")]
    assert [r.reject_reason for r in rejects.collect()] == ["no_marker", "no_marker"]


def test_adapter_rows(spark):
    raw = spark.createDataFrame(
        [(2, "b", "x #### 1,5"), (1, "a", "y")], "k int, question string, answer string"
    )
    rows = ingest_problems(raw, "sums", "test", ["k"]).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [
        ("sums/test/0", "math", "a", "y"),
        ("sums/test/1", "math", "b", "1,5"),
    ]


def test_tagged_answer(texts):
    cases = {
        "<answer></answer> 5": "",
        "3 then 4": "4",
        "<answer>1</answer> <answer>2</answer>": "1",
        "<answer> $1,2 34.. </answer>": "1234",
        "<answer>a<answer>b</answer>": "a<answer>b",
        "7 </answer> <answer>9</answer>": "7",
        "<answer>5": "5",
        "<ANSWER>5 or 6</ANSWER>": "6",
        "none": None,
    }
    assert texts(cases, answers.tagged_answer) == list(cases.values())


def test_cut_at_answer(texts):
    cases = {"a</answer>b</answer>": "a</answer>", "no tag": "no tag", "": ""}
    assert texts(cases, answers.cut_at_answer) == list(cases.values())


def test_phrased_answer(texts):
    cases = {
        "The answer is 5. The answer is 1,006. 9": "1006",
        "Answer: 7 then 9": "7",
        "the answer is: 3, answer 4": "3",
        "total 12 .": "12",
        "total 12 .\n": "12",
        "total 12. \n": None,
        "5-3": "-3",
        "12,3456": "3456",
        "1,234\n": "1234",
        "12 apples": None,
    }
    assert texts(cases, answers.phrased_answer) == list(cases.values())


def test_long_digit_runs_stay_fast(texts):
    assert texts(["9" * 200_000 + " x", "x " * 5], answers.phrased_answer) == [None, None]


def test_to_double_reads_what_python_reads(texts):
    pick = random.Random(5)
    pieces = [*"0123+-._eE, ", "inf", "nan", "Infinity", "d", "f", "0x1p3", "１", "٣"]
    values = ["".join(pick.choices(pieces, k=pick.randint(1, 6))) for _ in range(4000)]

    def python(value):
        try:
            return repr(float(value))
        except ValueError:
            return "None"

    assert [repr(x) for x in texts(values, to_double)] == [python(v) for v in values]


PAIRS = [
    ("18", "18.0", True),
    ("1,000", "1000", True),
    ("1e3", "1000", True),
    ("1_000", "1000", True),
    ("inf", "inf", True),
    ("inf", "-inf", False),
    ("inf", "5", False),
    ("$18", "18", False),
    ("$18", "$18", True),
    ("nan", "1", False),
    ("nan", "nan", False),
    ("-nan", "-nan", False),
    ("18", "18 apples", False),
    ("1d", "1", False),
    ("1d", "1D", True),
    ("Red", "red ", True),
    ("0", "0.0000005", True),
    ("1e308", "-1e308", False),
    ("", "", True),
]


def test_is_correct_and_its_symmetry(spark):
    df = spark.createDataFrame(PAIRS, "gold string, predicted string, wanted boolean")
    both = df.select(
        "*",
        is_correct(F.col("gold"), F.col("predicted")).alias("there"),
        is_correct(F.col("predicted"), F.col("gold")).alias("back"),
    )
    for row in both.collect():
        assert row.there == row.back == row.wanted, row


def test_tolerance_is_that_of_isclose(spark):
    pick = random.Random(6)
    pairs = []
    for _ in range(3000):
        left = pick.choice([1, -1]) * 10 ** pick.uniform(-9, 9)
        pairs.append((repr(left), repr(left * (1 + pick.choice([1e-6, 9.99e-7, 1.01e-6, 0])))))
    df = spark.createDataFrame(pairs, "g string, p string")
    for row in df.select("*", is_correct(F.col("g"), F.col("p")).alias("ok")).collect():
        assert row.ok == math.isclose(float(row.g), float(row.p), rel_tol=1e-6, abs_tol=1e-6)


def test_length_bounds(texts):
    values = ["x" * 29, "x" * 30, "x" * 900, "x" * 901, None, "\N{GRINNING FACE}" * 30]
    assert texts(values, has_length) == [False, True, True, False, False, True]
