"""Where the folder is there, its queries are registered: an import that fails inside it would otherwise pass for its absence."""

from __future__ import annotations

import __spark_entry__


def test_all_queries_of_the_subpackage_are_registered():
    names = __spark_entry__.queries()
    assert __spark_entry__.llm is not None
    assert [n for n in names if n.startswith("op") and n[2].isdigit()] == [n for k in range(1, 14) for n in names if n.startswith(f"op{k}_")]
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)
