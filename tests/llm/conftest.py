from __future__ import annotations

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; an input may have them too.
CLASH = ["raw", "mark", "rank", "key", "fp", "anchor", "seg", "h", "id", "start", "n", "w", "blob", "spans", "rest", "region", "host", "component_id", "root"]


@pytest.fixture
def docs(spark):
    """Documents from texts (ids from 0, or pairs of id and text), with clashing further columns."""

    def make(rows, lang="en"):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        full = [(i, t, lang, "s", len(t) if t is not None else None, *["x"] * len(CLASH)) for i, t in rows]
        return spark.createDataFrame(full, DOC + "".join(f", {c} string" for c in CLASH))

    return make
