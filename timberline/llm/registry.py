"""What `__spark_entry__` takes from this subpackage."""

from __future__ import annotations

import corpus_pipeline

from timberline.llm import queries as q


def queries() -> dict:
    return {**q.QUERIES, "pipeline": corpus_pipeline.run}


def oracles() -> dict[str, str]:
    return dict(q.ORACLES)
