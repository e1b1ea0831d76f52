"""Message rendering, fan-out and attaching completions."""

import pytest
from pyspark.sql import functions as F

from goldsieve.operators.completions import attach_completions, fan_out
from goldsieve.operators.prompts import RoleMarkers, render_messages, rows_without_pack
from goldsieve.sources.packs import DEFAULT_PACKS, Pack, packs_table

PLAIN = RoleMarkers(before="[{role}]", after="\n")
PACKS = (
    Pack("generate", "a", "sys {question}", "Q={question} A={answer} {{x}}"),
    Pack("generate", "b", "other", "{answer}{question}"),
    Pack("solve", "a", "solver", "{question}?"),
)


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(
        [(1, "one {answer}", "11", "t1", "a"), (2, "two", "22", "t2", "b")],
        "id int, question string, golden_answer string, assistant_target string, style string",
    )


def test_inserted_text_is_not_expanded(spark, rows):
    out = render_messages(rows, packs_table(spark, PACKS), "generate", mode="a", markers=PLAIN)
    first = out.orderBy("id").first()
    assert [tuple(m) for m in first.messages] == [
        ("system", "sys {question}"),
        ("user", "Q=one {answer} A=11 {x}"),
    ]
    assert first.prompt == "[system]sys {question}\n[user]Q=one {answer} A=11 {x}\n[assistant]"


def test_mode_column_chooses_the_pack(spark, rows):
    table = packs_table(spark, PACKS)
    out = render_messages(rows, table, "generate", mode_column="style").orderBy("id").collect()
    assert out[0].messages[1].content == "Q=one {answer} A=11 {x}"
    assert out[1].messages[1].content == "22two"
    assert out[1].messages[0].content == "other"


def test_training_has_the_target_and_no_invitation(spark, rows):
    out = render_messages(rows, packs_table(spark, PACKS), "train", mode="a", markers=PLAIN)
    wanted = "[system]solver\n[user]one {answer}?\n[assistant]t1\n"
    assert out.orderBy("id").first().prompt == wanted


def test_unknown_modes_are_errors(spark, rows):
    table = packs_table(spark)
    with pytest.raises(ValueError, match="boring"):
        render_messages(rows, table, "eval", mode="boring")
    with pytest.raises(ValueError, match="default"):
        render_messages(rows, table, "generate", mode="default")
    assert render_messages(rows, table, "generate", mode_column="style").count() == 0
    left = rows_without_pack(rows, packs_table(spark, PACKS[:1]), "generate", "style").collect()
    assert [(row.id, row.reject_reason) for row in left] == [(2, "no_pack")]


def test_bad_packs_are_errors(spark, rows):
    twice = packs_table(spark, (*PACKS, PACKS[0]))
    with pytest.raises(ValueError, match="one row per stage and mode"):
        render_messages(rows, twice, "generate", mode="a")
    odd = packs_table(spark, (Pack("solve", "a", "s", "{answer}"),))
    with pytest.raises(ValueError, match="placeholder"):
        render_messages(rows, odd, "eval", mode="a")
    with pytest.raises(ValueError, match="placeholder"):
        render_messages(rows, odd, "eval", mode_column="style")
    with pytest.raises(ValueError, match="must be unique"):
        render_messages(rows, twice, "generate", mode_column="style")


def test_any_number_of_packs(spark, rows):
    many = packs_table(spark, tuple(Pack("generate", f"m{n}", "s", "{answer}{{{question}") for n in range(2000)))
    out = render_messages(rows.withColumn("style", F.lit("m1999")), many, "generate", mode_column="style")
    assert [r.messages[1].content for r in out.orderBy("id").collect()] == ["11{one {answer}", "22{two"]


def test_default_packs(spark, rows):
    assert {(p.stage, p.mode) for p in DEFAULT_PACKS} == {
        ("generate", "boring"),
        ("generate", "surreal"),
        ("solve", "default"),
        ("solve", "surreal"),
    }
    for pack in DEFAULT_PACKS:
        purpose = "generate" if pack.stage == "generate" else "eval"
        out = render_messages(rows, packs_table(spark), purpose, mode=pack.mode)
        assert "one {answer}" in out.orderBy("id").first().prompt


def test_fan_out(spark, rows):
    out = fan_out(rows.select("id"), 3).orderBy("id", "sample_no").collect()
    assert [tuple(r) for r in out] == [(i, n) for i in (1, 2) for n in (1, 2, 3)]
    with pytest.raises(ValueError):
        fan_out(rows, 0)


def test_attach(spark):
    prompts = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "problem_id long, q string")
    completions = spark.createDataFrame(
        [(1, "x"), (1, "y"), (9, "z")], "problem_id long, text string"
    )
    inner = attach_completions(prompts, completions)
    left = attach_completions(prompts, completions, how="left")
    assert sorted((r.problem_id, r.q, r.text) for r in inner.rows.collect()) == [
        (1, "a", "x"),
        (1, "a", "y"),
    ]
    assert left.rows.count() == 4 and left.rows.where("text is null").count() == 2
    assert sorted(r.q for r in inner.outstanding.collect()) == ["b", "c"]
    assert [r.text for r in inner.orphans.collect()] == ["z"]
    assert [tuple(r) for r in inner.repeated.collect()] == [(2, 2)]


def test_rows_of_a_mode_stay_where_they_are(spark):
    """A small pack table goes to the rows; a join by mode would gather them in few tasks."""
    rows = spark.range(100).selectExpr("'q' AS question", "'1' AS golden_answer", "'boring' AS style")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = render_messages(rows, packs_table(spark), "generate", mode_column="style")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        assert found.count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
