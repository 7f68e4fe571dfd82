"""What the plans of the native operators, and of scans, must look like."""

import re

import pytest

from quillbook.llm import line_dedup, quality_rules, scratch, secret_scan


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def unwritten(monkeypatch):
    """Intermediate tables stay part of the plan, so that it shows all of them."""
    seen = []

    def kept(df, label):
        seen.append(df)
        out = df.sparkSession.createDataFrame([], df.schema) if label in ("statistics", "scatter", "medians", "least", "estimate") else df
        out._scratch_path = ""
        return out

    monkeypatch.setattr(scratch, "table", kept)
    return seen


@pytest.mark.parametrize("operator", [secret_scan.secret_report, line_dedup.line_report, quality_rules.judge])
def test_native(documents, unwritten, operator):
    whole = [plan(operator(documents)), *map(plan, unwritten)]
    for text in whole:
        assert not re.search("Python|Pandas|Arrow(?!ColumnarToRow)|CartesianProduct|BroadcastNestedLoop", text), text[:2000]


def test_only_wanted_columns_are_read(documents):
    text = plan(secret_scan.scan_secrets(documents).select("doc_id", "secrets"))
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", text)


@pytest.mark.parametrize("operator", [secret_scan.secret_report, line_dedup.line_report])
def test_texts_are_not_shuffled(documents, unwritten, monkeypatch, operator):
    """However many candidates there are, no whole text lies under an exchange."""
    from quillbook.plans import scratch as shared

    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
    final = operator(documents)
    for df in [final, *unwritten]:
        tree = df._jdf.queryExecution().sparkPlan()
        ensured = df._jdf.queryExecution().executedPlan().toString()
        assert tree is not None
        for exchange in re.findall(r"Exchange hashpartitioning[^\n]*\n([^\n]*)", ensured):
            assert not re.search(r"\btext#", exchange), exchange
