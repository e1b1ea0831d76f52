"""Template rows to chat messages for training, with a hold-out."""

from __future__ import annotations

from pyspark.sql import DataFrame

from goldsieve.operators.holdout import split_holdout
from goldsieve.operators.prompts import render_messages


def training_set(
    templates: DataFrame,
    packs: DataFrame,
    mode: str,
    key: str = "id",
    fraction: float = 0.1,
    seed: int = 42,
) -> DataFrame:
    """Template rows with ``is_validation``, ``messages`` and ``prompt``.

    ``templates`` come from :func:`template_kept` or, for plain reasoning, from
    :func:`template_problems`, and carry the unique ``key``.
    """
    flagged = split_holdout(templates, key, fraction, seed)
    return render_messages(flagged, packs, "train", mode=mode)
