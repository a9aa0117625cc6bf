"""Language identification: held-out accuracy, rejection, and odd rows."""

import zlib

from pyspark.sql import functions as F

from cuesheet.llm import langid
from cuesheet.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = QUERIES["op6_language"](spark, sf)
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").collect()
    assert len(rows) == truth.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["lang"] is not None]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert sum(r["rejected"] for r in rows) <= 0.002 * len(rows)


def model_of(spark):
    english = ["the cat and the dog went to the house of the man", "this is the way that we were there with them"]
    german = ["der hund und die katze gingen in das haus des mannes", "das ist der weg auf dem wir mit ihnen waren"]
    rows = [(k, english[k % 2] + f" number{k}" * (k % 3), "en") for k in range(20)]
    rows += [(100 + k, german[k % 2] + f" zahl{k}" * (k % 3), "de") for k in range(20)]
    rows += [(300, None, "en"), (301, "no language", None), (302, "", "de")]
    return langid.fit(spark.createDataFrame(rows, "key long, text string, lang string"))


def test_odd_rows(spark):
    model = model_of(spark)
    assert sorted(set(model.languages)) == ["de", "en"]
    rows = [
        (1, "the dog and the house", "x"), (2, "der hund und das haus", "x"), (3, None, "x"), (4, "", "x"),
        (5, "123 !? \n", "x"), (6, "это совсем другой язык и другие буквы, которых нет в обучении " * 3, "x"),
        (None, "the man", None), (7, "the cat " * 40_000, "x"), (1, "the dog and the house", "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = langid.identify(df, model).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["lang_pred"] == "en" and by[2]["lang_pred"] == "de" and by[7]["lang_pred"] == "en"
    assert not by[1]["rejected"] and not by[2]["rejected"]
    for k in (3, 4, 5):
        assert (by[k]["lang_pred"], by[k]["score"], by[k]["rejected"]) == ("und", 0.0, True)
    assert by[6]["rejected"] and by[6]["lang_pred"] in ("en", "de")
    kept = langid.accepted(df, model)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {1, 2, None, 7}
    assert langid.identify(df.limit(0), model).count() == 0


def test_inputs_of_a_prediction(spark):
    """Only the text counts: ids and other columns can change."""
    model = model_of(spark)
    df = spark.createDataFrame([(1, "the way of the dog", "de")], "doc_id long, text string, lang string")
    changed = df.select((F.col("doc_id") + 99).alias("doc_id"), "text", F.lit(None).alias("lang"))
    assert langid.identify(df, model).first()["score"] == langid.identify(changed, model).first()["score"]


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "key long, text string, lang string")
    model = langid.fit(empty)
    df = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert langid.identify(df, model).first()["lang_pred"] == "und"


def test_several_centroids(spark):
    model = model_of(spark)
    assert len(model.languages) > 2  # more than one centroid per language
    norms = (model.centroids**2).sum(axis=0)
    assert abs(norms - 1).max() < 1e-3
