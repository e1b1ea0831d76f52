"""Record layouts shared by readers, operators and writers."""

from pyspark.sql import types as T


def _record(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_TEXT = T.StringType()

# Field names and order of the exchanged records.
PROBLEM = _record(("question", _TEXT), ("answer", _TEXT))
KEPT = _record(
    ("id", T.LongType()),
    ("split", _TEXT),
    ("question", _TEXT),
    ("gold_answer", _TEXT),
    ("trip_before", _TEXT),
    ("answer", _TEXT),
    ("end", _TEXT),
    ("assistant_answer", _TEXT),
)
RESULT = _record(
    ("id", T.LongType()),
    ("split", _TEXT),
    ("question", _TEXT),
    ("golden_answer", _TEXT),
    ("assistant_answer", _TEXT),
    ("answer", _TEXT),
    ("exact_match", T.BooleanType()),
)

# Folder levels of the kept and result tables.
KEPT_RUN = _record(
    ("teacher", _TEXT), ("dataset", _TEXT), ("mode", _TEXT), ("subset", _TEXT)
)
RESULT_RUN = _record(
    ("model", _TEXT),
    ("teacher", _TEXT),
    ("dataset", _TEXT),
    ("mode", _TEXT),
    ("note", _TEXT),
    ("with_adapter", _TEXT),
)

# The boundary with the model: one row per sampled completion, unique by
# problem_id and sample_no.
COMPLETION = _record(
    ("problem_id", T.LongType()), ("sample_no", T.IntegerType()), ("text", _TEXT)
)
