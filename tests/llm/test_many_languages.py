"""No labelled language is left unlearned."""

from kinfold.llm import language_id


def test_rare_languages_are_learned(spark):
    rows = [(300 * k + i, f"{chr(0x4E00 + 9 * k) * 3} {chr(0x4E01 + 9 * k) * 3}", f"l{k:03}") for k in range(230) for i in range(16)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(model.languages) == {r[2] for r in rows}
