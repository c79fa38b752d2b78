"""Labels beyond the bound of the byte network."""

from thermoscope.llm import lang_cnn


def test_rare_labels_are_not_learned(spark, monkeypatch):
    monkeypatch.setattr(lang_cnn, "MAX_LANGUAGES", 2)
    rows = [(k, "the thing and the other", "en") for k in range(4)] + [(10 + k, "der und die das", "de") for k in range(3)] \
        + [(20 + k, f"noise number {k}", f"x{k}") for k in range(9)] + [(0, "noise of the same id", "x1")] \
        + [(40 + k, "12 34", "digits") for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = lang_cnn.train(df)
    assert net.labels == ["de", "en"]
    assert {r["lang_pred"] for r in lang_cnn.predict(df, net).collect()} <= {"de", "en", "und"}


def test_documents_stay_without_labels(spark):
    df = spark.createDataFrame([(1, "a clean text", None), (2, "12 34", None), (3, None, None), (4, "中文", None)],
                               "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in lang_cnn.keep_determined(df, lang_cnn.train(df)).collect()) == [1, 4]
