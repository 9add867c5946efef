"""What cider stores: slim counts, and only frequencies that change a weight."""

from quillspark.operators import metrics


def test_only_shared_frequencies_are_stored(spark, monkeypatch):
    staged = []
    monkeypatch.setattr(metrics, "stage", lambda df, to=metrics.stage: staged.append(to(df)) or staged[-1])
    rows = [(i, f"one w{i} v{i}", f"one w{i} u{i}" if i % 2 else "") for i in range(6)]
    got = {r["pair_id"]: r["score"] for r in metrics.cider(spark.createDataFrame(rows, "pair_id long, ref string, hyp string")).collect()}
    tf, df = staged
    assert "sizes" not in tf.columns and [r["df"] for r in df.collect()] == [6]
    assert got[0] == 0 and 10 / 4 * (1 / 2 + 1 / 2) - 1e-9 < got[1] < 10
