"""Candidates that are not asked for are no work in Python."""

from tessera.operators.judgments import shadow_run


def test_texts_of_refused_candidates_stay_where_they_are(spark):
    rows = [(1, u, u, f"p{u}", f"path{u}", "t", True, u != 2, 0.5, True, None, False) for u in range(1, 5)]
    judged = spark.createDataFrame(rows, "task_id long, unit_id long, rank int, prompt string, path string, title string, rights boolean, trusted boolean, relevance double, implementation boolean, edit_target boolean, root_cause boolean").repartition(1)
    df = shadow_run(judged, lambda row: {"relevance": len(row["path"]), "implementation": 0, "edit_target": 1, "root_cause": row["title"] == "t"}, calls=3)
    before = df._jdf.queryExecution().analyzed().toString().split("MapInPandas", 1)[1]
    assert "CASE WHEN isnull(refused" in before
    got = {r.unit_id: tuple(r)[2:] for r in df.collect()}
    assert got[1] == ("OK", "NONE", 1, 5.0, False, True, True) and got[3] == got[1]
    assert got[2] == ("FALLBACK", "TRUST_DENIED", 0, 0.5, True, None, False) and got[4] == ("FALLBACK", "BUDGET_EXHAUSTED", 0, 0.5, True, None, False)
