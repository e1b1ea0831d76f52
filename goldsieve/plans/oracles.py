"""The registered queries again, in SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from goldsieve.plans.catalog import BATCH, SAMPLES
from goldsieve.sources.packs import DEFAULT_PACKS

# DuckDB's RE2 spells these its own way, so no pattern is shared with Spark.
_NUMBER = r"[-+]?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?"
_FLOAT = r"[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?"
_STRICT = (
    r"(?s)\A\s*<trip_before>\s*(.+?)\s*</trip_before>"
    r"\s*<answer>\s*(.+?)\s*</answer>\s*<end>\s*(.+?)\s*</end>"
)
_BLANKS = r"E' \t\n\r\f\x0b'"


def _text(value: str) -> str:
    """A Python string as an SQL literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return f"E'{escaped}'"


def _trim(value: str) -> str:
    return f"trim({value}, {_BLANKS})"


def _number(value: str) -> str:
    return f"CASE WHEN regexp_full_match({value}, '{_FLOAT}') THEN try_cast({value} AS DOUBLE) END"


def _correct(gold: str, predicted: str) -> str:
    g, p = (f"replace({_trim(v)}, ',', '')" for v in (gold, predicted))
    x, y = _number(g), _number(p)
    return (
        f"coalesce(abs(({x}) - ({y})) <= greatest(1e-6 * greatest(abs({x}), abs({y})), 1e-6), "
        f"lower({g}) = lower({p}))"
    )


def _tagged(text: str) -> str:
    cut = (
        f"CASE WHEN contains({text}, '</answer>') "
        f"THEN substr({text}, 1, strpos({text}, '</answer>') + 8) ELSE {text} END"
    )
    body = f"regexp_extract_all({cut}, '(?s)<answer>(.*?)</answer>', 1)[-1]"
    number = f"regexp_extract_all({cut}, '{_NUMBER}')[-1]"
    return (
        f"rtrim(regexp_replace(coalesce({body}, {number}), '[,$[:space:]]', '', 'g'), '.')"
    )


def _phrased(text: str) -> str:
    def last(pattern: str) -> str:
        return f"regexp_extract_all({text}, '{pattern}', 1)[-1]"

    return (
        "replace(coalesce("
        + ", ".join(
            (
                last(rf"[Tt]he answer is[:\s]*({_NUMBER})"),
                last(rf"[Aa]nswer[:\s]*({_NUMBER})"),
                last(rf"({_NUMBER})(?:\s*\n?\z|\s*\.\n?\z)"),
            )
        )
        + "), ',', '')"
    )


def _percent(kept: str, total: str) -> str:
    return f"printf('%.1f', 100.0::DOUBLE * {kept} / {total})::DOUBLE"


_PROBLEMS = """
problems AS (
  SELECT o_orderkey AS problem_id,
         'Order ' || o_orderkey || ': what is the total?' AS question,
         CASE WHEN o_orderkey % 50 = 7 THEN 'Add the lines.'
              WHEN o_orderkey % 3 = 0
                THEN E'Add the lines.\\n#### ' || format('{:,}', floor(o_totalprice)::BIGINT)
              WHEN o_orderkey % 3 = 1
                THEN E'Add the lines.\\r\\n#### ' || floor(o_totalprice)::BIGINT
              ELSE E'Add the lines.\\n#### ' || floor(o_totalprice)::BIGINT END AS answer,
         CASE WHEN o_orderkey % 101 <> 7 THEN floor(o_totalprice)::BIGINT::VARCHAR END AS gold,
         o_orderpriority AS teacher, o_orderstatus AS mode,
         row_number() OVER (ORDER BY o_orderkey) AS id
  FROM orders)"""

_SAMPLES = (
    _PROBLEMS
    + """,
lined AS (
  SELECT l_orderkey AS problem_id,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey,
           l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,
           l_linestatus, l_shipdate)::INTEGER AS sample_no
  FROM lineitem),
numbered AS (
  SELECT * FROM lined
  UNION ALL SELECT -problem_id, sample_no FROM lined WHERE problem_id % 89 = 3),
varied AS (
  SELECT n.problem_id, n.sample_no, floor(o.o_totalprice)::BIGINT::VARCHAR AS amount,
         p.gold, ((abs(n.problem_id) + n.sample_no) % 15)::INTEGER AS variant
  FROM numbered n JOIN orders o ON o.o_orderkey = abs(n.problem_id)
  LEFT JOIN problems p USING (problem_id)),
parts AS (
  SELECT *,
    CASE variant WHEN 11 THEN 'hm'
      ELSE rtrim(repeat('drift ', 6 + sample_no)) END AS r,
    CASE variant WHEN 5 THEN format('{:,}', amount::BIGINT) WHEN 6 THEN amount || '.0'
      WHEN 7 THEN '$' || amount WHEN 8 THEN (amount::BIGINT + 1)::VARCHAR WHEN 14 THEN ' '
      ELSE amount END AS a,
    CASE variant WHEN 13 THEN E' \\n ' ELSE rtrim(repeat('hum ', 10)) END AS e
  FROM varied),
whole AS (
  SELECT *,
    CASE WHEN variant = 4 THEN
      '<TRIP_BEFORE>' || r || E'</TRIP_BEFORE>\\n<ANSWER>' || a
      || E'</ANSWER>\\n<END>' || e || '</END>'
    ELSE
      '<trip_before>' || r || E'</trip_before>\\n'
      || CASE variant WHEN 10 THEN 'The answer is ' || amount || '.'
           ELSE '<answer>' || a || '</answer>' END
      || E'\\n<end>' || e || CASE WHEN variant IN (1, 13) THEN '' ELSE '</end>' END
    END AS w
  FROM parts),
samples AS (
  SELECT problem_id, sample_no, variant, amount, gold,
    CASE variant WHEN 2 THEN E'```xml\\n' || w || E'\\n```'
      WHEN 3 THEN replace(replace(w, '<', '&lt;'), '>', '&gt;')
      WHEN 9 THEN E'Sure:\\n' || w WHEN 12 THEN w || E'\\nbye' ELSE w END AS text
  FROM whole)"""
)

_JUDGED = (
    _SAMPLES
    + f""",
closed AS (
  SELECT s.*, p.id, p.question, p.teacher, p.mode,
    {_trim("text")} AS bare,
    CASE WHEN contains(bare, '</end>') OR NOT contains(bare, '<end>') THEN bare
         ELSE bare || '</end>' END AS closed
  FROM samples s LEFT JOIN problems p USING (problem_id)),
strict AS (
  SELECT *, regexp_matches(closed, '{_STRICT}') AS ok,
    CASE WHEN ok THEN {_trim(f"regexp_extract(closed, '{_STRICT}', 1)")} END AS reason,
    CASE WHEN ok THEN {_trim(f"regexp_extract(closed, '{_STRICT}', 2)")} END AS answer,
    CASE WHEN ok THEN {_trim(f"regexp_extract(closed, '{_STRICT}', 3)")} END AS closing
  FROM closed),
judged AS (
  SELECT *, CASE WHEN id IS NULL THEN 'no_problem'
                 WHEN NOT ok THEN 'unparsed' WHEN answer = '' THEN 'empty_answer'
                 WHEN gold IS NULL THEN 'no_gold'
                 WHEN NOT {_correct("gold", "answer")} THEN 'wrong_answer' END AS reject_reason,
         reject_reason IS NULL AS kept
  FROM strict),
kept AS (
  SELECT id, 'train' AS split, question, gold AS gold_answer, reason AS trip_before,
         answer, closing AS "end", text AS assistant_answer
  FROM judged WHERE kept)"""
)

# Only fences, &lt; and &gt; occur in the derived completions.
_CLEANED = (
    _SAMPLES
    + f""",
cleaned AS (
  SELECT *, {_trim(
        "regexp_replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'),"
        " '(?m)^\\s*```.*$', '', 'g')"
    )} AS cleaned FROM samples),
lenient AS (
  SELECT *,
    regexp_matches(cleaned, '(?si)<trip_before>.*</trip_before>')
      AND regexp_matches(cleaned, '(?si)<answer>.*</answer>')
      AND regexp_matches(cleaned, '(?si)<end>') AS ok,
    CASE WHEN ok THEN {_trim("regexp_extract(cleaned, '(?si)<trip_before>(.*?)</trip_before>', 1)")}
      END AS reason,
    CASE WHEN ok THEN {_trim("regexp_extract(cleaned, '(?si)<answer>(.*?)</answer>', 1)")}
      END AS answer,
    CASE WHEN ok THEN
      {_trim("regexp_extract(cleaned, '(?si)<end>(.*?)(?:</end>)?\\s*\\z', 1)")} END AS closing
  FROM cleaned)"""
)

_ANSWERS = (
    _SAMPLES
    + f""",
answers AS (
  SELECT *, {_tagged("text")} AS tagged, {_phrased("text")} AS phrased FROM samples)"""
)


def _votes(answer: str) -> str:
    return f""",
tally AS (
  SELECT problem_id, {answer} AS answer, count(*) AS n, min(sample_no) AS first
  FROM answers WHERE {answer} IS NOT NULL GROUP BY ALL),
winners AS (
  SELECT problem_id, answer, first AS sample_no FROM tally
  QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY n DESC, first) = 1),
votes AS (
  SELECT w.problem_id, w.answer, s.text
  FROM winners w JOIN samples s USING (problem_id, sample_no))"""


_RESULTS = (
    _ANSWERS
    + _votes("tagged")
    + f""",
results AS (
  SELECT p.id, 'test' AS split, p.question, p.gold AS golden_answer,
         {_trim("v.text")} AS assistant_answer, v.answer,
         coalesce(v.answer <> '' AND {_correct("p.gold", "v.answer")}, false) AS exact_match
  FROM problems p LEFT JOIN votes v USING (problem_id))"""
)

_GOLD = f"""coalesce(
    nullif(replace(regexp_extract(tail, '{_NUMBER}'), ',', ''), ''), tail)"""

_TEMPLATES = (
    _PROBLEMS
    + f""",
solutions AS (
  SELECT *, {_trim("replace(answer, E'\\r\\n', E'\\n')")} AS solution,
         {_trim("substr(solution, strpos(solution, '####') + 4)")} AS tail
  FROM problems),
templates AS (
  SELECT problem_id, mode, teacher, question, {_GOLD} AS golden_answer,
         'Add the lines.' || E'\\n<answer>' || golden_answer || '</answer>' AS assistant_target
  FROM solutions WHERE contains(solution, '####'))"""
)


def _batches(rows: str, flag: str) -> str:
    """``rows`` is a relation with ``row_no`` and a boolean ``flag``."""
    return f""",
batches AS (
  SELECT row_no // {BATCH} + 1 AS batch_no, count_if({flag})::BIGINT AS kept,
         count(*) AS total
  FROM {rows} GROUP BY 1)
SELECT batch_no, kept, total, {_percent("kept", "total")} AS success_pct,
       (sum(kept) OVER (ORDER BY batch_no))::BIGINT AS running_kept,
       (sum(total) OVER (ORDER BY batch_no))::BIGINT AS running_total
FROM batches"""


def _holdout(rows: str, key: str) -> str:
    return f""",
hashed AS (SELECT *, md5({key} || ':42') AS h FROM {rows}),
cut AS (
  SELECT min(h) AS h FROM (
    SELECT h, count(*) OVER (ORDER BY h) AS upto, count(*) OVER () AS n FROM hashed)
  WHERE upto >= ceil(0.1::DOUBLE * n))"""


def _pack(stage: str, mode: str) -> tuple[str, str]:
    found = next(p for p in DEFAULT_PACKS if (p.stage, p.mode) == (stage, mode))
    return found.system, found.user_template


def _user(stage: str, mode: str, **slots: str) -> str:
    """A filled user template as an SQL expression; each slot occurs once."""
    _, rest = _pack(stage, mode)
    parts = []
    for name, expression in slots.items():
        before, rest = rest.split("{" + name + "}")
        parts += [_text(before), expression]
    return " || ".join([*parts, _text(rest)])


def _turn(role: str, content: str) -> str:
    return f"'<|im_start|>{role}' || chr(10) || {content} || '<|im_end|>' || chr(10)"


def _prompt(stage: str, mode: str, user: str, last: str) -> str:
    system = _turn("system", _text(_pack(stage, mode)[0]))
    return f"{system} || {_turn('user', user)} || {last}"


_INVITE = "'<|im_start|>assistant' || chr(10)"

_STYLES = {
    style: _prompt(
        "generate",
        style,
        _user("generate", style, question="question", answer="golden_answer"),
        _INVITE,
    )
    for style in ("boring", "surreal")
}

# Exactly the tenth of the kept rows, rounded up, with the smallest hashes.
_HELD = """rows_ AS (
  SELECT *, row_number() OVER (ORDER BY id, assistant_answer) - 1 AS row_no FROM kept),
held AS (
  SELECT *, row_number() OVER (ORDER BY md5(row_no || ':42'))
            <= ceil(0.1::DOUBLE * count(*) OVER ()) AS is_validation
  FROM rows_)"""

_FANNED = f"""fanned AS (
  SELECT o_orderkey AS problem_id, unnest(range(1, {SAMPLES + 1}))::INTEGER AS sample_no
  FROM orders)"""

ORACLES: dict[str, str] = {
    "curate_kept_rate": f"""WITH {_JUDGED}
SELECT variant, count(*) AS samples, count_if(ok)::BIGINT AS parsed,
       count_if(kept)::BIGINT AS kept,
       {_percent("count_if(kept)", "count(*)")} AS kept_pct
FROM judged GROUP BY variant""",
    "curate_verdicts": f"""WITH {_JUDGED}
SELECT coalesce(reject_reason, 'kept') AS verdict, count(*) AS n FROM judged GROUP BY 1""",
    "curate_kept_records": f"WITH {_JUDGED} SELECT * FROM kept",
    "curate_rejects": f"""WITH {_JUDGED}
SELECT problem_id, sample_no, reject_reason, text FROM judged WHERE NOT kept""",
    # Templates read gold from the solution, which always has it.
    "curate_from_raw": f"""WITH {_JUDGED}
SELECT teacher, mode, count(*) AS total,
       count_if(ok AND answer <> '' AND {_correct("amount", "answer")})::BIGINT AS kept
FROM judged WHERE id IS NOT NULL AND problem_id % 50 <> 7 GROUP BY ALL""",
    "adapter_rows": f"""WITH {_PROBLEMS}
SELECT 'orders/train/' || (id - 1) AS id, 'math' AS task_type, question,
       {_trim("string_split(answer, '####')[-1]")} AS gold_answer FROM problems""",
    "template_rows": f"""WITH {_TEMPLATES}
SELECT problem_id, question, assistant_target, golden_answer FROM templates""",
    "template_rejects": f"""WITH {_TEMPLATES}
SELECT problem_id, question, solution AS answer, 'no_marker' AS reject_reason
FROM solutions WHERE NOT contains(solution, '####')""",
    "template_kept_rows": f"""WITH {_JUDGED}
SELECT id, question, assistant_answer AS assistant_target, gold_answer AS golden_answer
FROM kept""",
    "strict_parse": f"""WITH {_JUDGED}
SELECT problem_id, sample_no, reason, answer, closing FROM strict""",
    "lenient_parse": f"""WITH {_CLEANED}
SELECT problem_id, sample_no, reason, answer, closing FROM lenient""",
    "cleaned_completions": f"""WITH {_CLEANED}
SELECT problem_id, sample_no, cleaned FROM cleaned""",
    "tagged_answers": f"""WITH {_ANSWERS}
SELECT problem_id, sample_no, tagged AS answer FROM answers""",
    "phrased_answers": f"""WITH {_ANSWERS}
SELECT problem_id, sample_no, phrased AS answer FROM answers""",
    "graded_answers": f"""WITH {_ANSWERS}
SELECT variant, count(*) AS n, count_if({_correct("gold", "tagged")})::BIGINT AS correct
FROM answers SEMI JOIN problems USING (problem_id) GROUP BY variant""",
    "tagged_vote": f"""WITH {_ANSWERS}{_votes("tagged")}
SELECT problem_id, answer, text FROM votes""",
    "phrased_vote": f"""WITH {_ANSWERS}{_votes("phrased")}
SELECT problem_id, answer FROM winners""",
    "best_samples": f"""WITH {_CLEANED}
SELECT problem_id, reason, answer, closing, text FROM lenient
WHERE ok AND answer <> '' AND length(reason) BETWEEN 30 AND 900
  AND length(closing) BETWEEN 30 AND 900 AND {_correct("gold", "answer")}
QUALIFY row_number() OVER (PARTITION BY problem_id
  ORDER BY length(reason) + 0.5 * length(closing) DESC, sample_no) = 1""",
    "evaluation_results": f"WITH {_RESULTS} SELECT * FROM results",
    "evaluation_accuracy": f"""WITH {_RESULTS}
SELECT count_if(exact_match)::BIGINT AS kept, count(*) AS total,
       {_percent("count_if(exact_match)", "count(*)")} AS success_pct,
       printf('%.3f', count_if(exact_match)::DOUBLE / count(*))::DOUBLE AS rate FROM results""",
    "evaluation_batches": f"""WITH {_RESULTS},
placed AS (SELECT id - 1 AS row_no, exact_match FROM results){_batches("placed", "exact_match")}""",
    "curation_batches": f"""WITH {_JUDGED},
placed AS (
  SELECT row_number() OVER (ORDER BY problem_id, sample_no) - 1 AS row_no, kept
  FROM judged){_batches("placed", "kept")}""",
    "curation_report": f"""WITH {_JUDGED},
runs AS (
  SELECT p.teacher, p.mode, (grouping(p.teacher) + grouping(p.mode))::INTEGER AS level,
         count(*) AS problems,
         count_if(NOT EXISTS (SELECT 1 FROM judged j WHERE j.problem_id = p.problem_id))::BIGINT
           AS without_completion
  FROM problems p GROUP BY ROLLUP (p.teacher, p.mode)),
graded AS (
  SELECT teacher, mode, (grouping(teacher) + grouping(mode))::INTEGER AS level,
         count_if(kept)::BIGINT AS kept, count(*) AS total
  FROM judged WHERE id IS NOT NULL GROUP BY ROLLUP (teacher, mode))
SELECT r.teacher, r.mode, r.level, problems, without_completion, coalesce(kept, 0) AS kept,
       coalesce(total, 0) AS total, {_percent("kept", "total")} AS success_pct,
       printf('%.3f', kept::DOUBLE / total)::DOUBLE AS rate,
       {_percent("coalesce(kept, 0)", "problems")} AS kept_per_problem_pct
FROM runs r LEFT JOIN graded g ON r.level = g.level
  AND r.teacher IS NOT DISTINCT FROM g.teacher AND r.mode IS NOT DISTINCT FROM g.mode""",
    "numbered_orders": """
SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS row_no
FROM orders""",
    "holdout_members": f"""WITH {_PROBLEMS}{_holdout("problems", "problem_id")}
SELECT problem_id, h <= (SELECT h FROM cut) AS is_validation FROM hashed""",
    "generation_prompts": f"""WITH {_TEMPLATES}
SELECT problem_id, CASE mode WHEN 'F' THEN 'surreal' ELSE 'boring' END AS style,
       CASE mode WHEN 'F' THEN {_STYLES["surreal"]} ELSE {_STYLES["boring"]} END AS prompt
FROM templates""",
    "evaluation_prompts": f"""WITH {_PROBLEMS}, {_FANNED}
SELECT problem_id, sample_no,
       {_prompt("solve", "default", _user("solve", "default", question="question"), _INVITE)}
         AS prompt
FROM fanned JOIN problems USING (problem_id)""",
    "conversation_messages": f"""WITH pairs AS (
  SELECT a.conv_id, a.turn, a.text AS question, b.text AS target
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
  WHERE a.role = 'user' AND b.role = 'assistant')
SELECT conv_id, turn, 0 AS position, 'system' AS role,
       {_text(_pack("solve", "default")[0])} AS content FROM pairs
UNION ALL SELECT conv_id, turn, 1, 'user',
       {_user("solve", "default", question="question")} FROM pairs
UNION ALL SELECT conv_id, turn, 2, 'assistant', target FROM pairs""",
    "fanned_out": f"WITH {_FANNED} SELECT * FROM fanned",
    "attached_completions": f"""WITH {_SAMPLES}, {_FANNED}
SELECT problem_id, sample_no, text FROM fanned LEFT JOIN samples USING (problem_id, sample_no)""",
    "outstanding_prompts": f"""WITH {_SAMPLES}, {_FANNED}
SELECT * FROM fanned ANTI JOIN samples USING (problem_id, sample_no)""",
    "orphan_completions": f"""WITH {_SAMPLES}, {_FANNED}
SELECT problem_id, sample_no, text FROM samples ANTI JOIN fanned USING (problem_id, sample_no)""",
    "repeated_keys": """
SELECT l_orderkey AS problem_id, l_linenumber AS sample_no, count(*) AS n
FROM lineitem GROUP BY ALL HAVING count(*) > 1""",
    "training_messages": f"""WITH {_JUDGED}, {_HELD}
SELECT id, row_no, is_validation,
       {_prompt("solve", "surreal", _user("solve", "surreal", question="question"),
                _turn("assistant", "assistant_answer"))} AS prompt
FROM held""",
    "training_set_round_trip": f"""WITH {_JUDGED}, {_HELD}
SELECT id, row_no, CASE WHEN is_validation THEN 'validation' ELSE 'train' END AS subset,
       assistant_answer AS assistant_target
FROM held""",
    "problems_by_split": f"""WITH {_TEMPLATES}
SELECT mode AS split, question, golden_answer, assistant_target FROM templates""",
    "plain_training_messages": f"""WITH {_TEMPLATES}{_holdout("templates", "problem_id")}
SELECT problem_id, h <= (SELECT h FROM cut) AS is_validation,
       {_prompt("solve", "default", _user("solve", "default", question="question"),
                _turn("assistant", "assistant_target"))} AS prompt
FROM hashed""",
    "document_numbers": f"""
SELECT doc_id, {_tagged("text")} AS tagged, {_phrased("text")} AS phrased FROM documents""",
    "document_lengths": """
SELECT doc_id, length(text)::INTEGER AS characters FROM documents
WHERE length(text) BETWEEN 30 AND 900""",
    "normalized_documents": f"""
SELECT doc_id, {_trim(
        "replace(replace(replace(replace(text, E'\\r\\n', E'\\n'), E'\\r', E'\\n'),"
        " chr(160), ' '), chr(8201), ' ')"
    )} AS text FROM documents""",
    # The entities that occur in the pages, the ampersand last.
    "cleaned_pages": f"""
SELECT page_id, {_trim(
        "replace(replace(replace(replace(html, '&copy;', chr(169)), '&middot;', chr(183)),"
        " '&quot;', '\"'), '&amp;', '&')"
    )} AS cleaned FROM pages""",
    "kept_round_trip": f"""WITH {_JUDGED}
SELECT *, 'teacher-7b' AS teacher, 'orders' AS dataset FROM kept""",
    "published_versions": f"""WITH {_JUDGED}
SELECT 'old' AS read, * REPLACE ('draft' AS split) FROM kept
UNION ALL SELECT 'newest' AS read, * FROM kept""",
    "appended_numbers": """
SELECT o_orderkey, late::BIGINT AS append_id,
       row_number() OVER (ORDER BY late, o_orderkey) - 1 AS row_no
FROM (SELECT o_orderkey, min((o_orderstatus IS DISTINCT FROM 'F')::INT) AS late
      FROM orders GROUP BY ALL)""",
    "results_round_trip": f"""WITH {_RESULTS}
SELECT *, 'orders' AS dataset, 'none' AS note FROM results""",
    "streamed_kept_records": f"WITH {_JUDGED} SELECT * FROM kept",
    "streamed_totals": f"""WITH {_JUDGED}
SELECT count_if(kept)::BIGINT AS kept, count(*) AS total,
       {_percent("count_if(kept)", "count(*)")} AS success_pct FROM judged""",
    "streamed_running_success": f"""WITH {_JUDGED}
SELECT teacher, mode, count_if(kept)::BIGINT AS kept, count(*) AS total,
       100.0::DOUBLE * count_if(kept) / count(*) AS success_pct
FROM judged GROUP BY ALL""",
    "late_problem_verdicts": f"""WITH {_JUDGED}
SELECT problem_id, sample_no, coalesce(reject_reason, 'kept') AS verdict FROM judged""",
}
# Batch and stream come to the same.
ORACLES["streamed_tagged_vote"] = ORACLES["tagged_vote"]
ORACLES["streamed_best_samples"] = ORACLES["best_samples"]
