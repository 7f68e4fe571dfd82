from quillbook.llm import quality_rules, scratch


def test_steps_let_go_of_what_the_driver_holds(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word " * 3 + " ".join(f"w{i * j}" for j in range(60 + i))) for i in range(40)], "doc_id long, text string")
    steps, asked = [], []
    table = scratch.table
    monkeypatch.setattr(scratch, "table", lambda df, label: steps.append(label) or table(df, label))
    monkeypatch.setattr(scratch, "let_go", lambda session: asked.append(session))
    assert quality_rules.judge(docs).count() == 40
    assert len(asked) == steps.count("scatter") - 3 > 0  # three levels, each with a table of starts
