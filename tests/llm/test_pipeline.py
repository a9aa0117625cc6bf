"""The pipeline: stages one by one, their decisions by hand, and odd rows through all of it."""

import random

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from cuesheet.llm import decontaminate, minhash, pieces, pii

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int, window string"


def documents(spark):
    rng = random.Random(5)
    languages = {
        "en": "the of and to in is that for it with as was on are this by be at from or".split(),
        "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch".split(),
    }
    rows = []

    def text(lang):
        return " ".join(rng.choice(languages[lang]) + rng.choice(["", "", "", str(rng.randrange(900))]) for _ in range(80))

    for k in range(120):
        rows.append((k, text(("en", "de")[k % 2]), ("en", "de")[k % 2]))
    item = "one benchmark passage with more than ten words in it so that it can be found"
    rows += [
        (200, rows[3][1], "de"), (201, rows[3][1] + " end", "de"), (202, rows[5][1].upper(), "de"),
        (203, text("de") + " " + item, "de"), (204, text("de") + " write to x@y.com or +1 (017) 555-7713", "de"),
        (205, None, "en"), (206, "", "en"), (207, "12345 !!", "en"), (None, rows[11][1] + " no id", "de"),
        (208, rows[2][1] * 60, "en"), (209, "это совсем другой язык, которого здесь нет " * 5, None), (0, rows[0][1], "en"),
    ]
    table = [(i, t, lang, "s", len(t) if t is not None else None, 1, "w") for i, t, lang in rows]
    return spark.createDataFrame(table, SCHEMA), spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    docs, items = documents(spark)
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    items.write.parquet(f"{path}/benchmark.parquet")
    return path


def rows_of(df, columns):
    return sorted((tuple(r) for r in df.select(columns).collect()), key=str)


def test_stages_by_hand(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in P.STAGES] == [
        "language ID", "MinHash near-dedup", "benchmark decontamination", "PII", "SentencePiece encoding and decoding",
    ]
    spoken = P.language(spark, docs, folder)
    assert spoken.columns == columns
    before = rows_of(docs, columns)
    gone = {205, 206, 207, 209}
    spoken_rows = rows_of(spoken, columns)
    assert spoken_rows == [r for r in before if r[0] not in gone]

    unique = P.near_duplicates(spark, spoken, folder)
    assert unique.columns == columns
    unique_rows = rows_of(unique, columns)
    sets = {}
    for r in spoken_rows:
        sets.setdefault(r[0], set()).update(minhash.shingle_set(r[1]).tolist())
    ids = sorted(i for i in sets if i is not None)
    low = {i: i for i in ids}

    def root(i):
        return i if low[i] == i else root(low[i])

    for a in ids:
        for b in ids:
            if a < b and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]):
                one, other = sorted((root(a), root(b)))
                low[other] = one
    kept = {i for i in ids if root(i) == i} | {None}
    assert {r[0] for r in unique_rows} == kept and len(unique_rows) == len(kept)
    assert not {200, 201, 202} & kept

    clean = P.decontamination(spark, unique, folder)
    clean_rows = rows_of(clean, columns)
    assert clean.columns == columns and clean_rows == [r for r in unique_rows if r[0] != 203]

    masked = P.personal_data(spark, clean, folder)
    assert masked.columns == columns
    expected = [(r[0], pii.masked(r[1]), r[2], r[3], len(pii.masked(r[1])), *r[5:]) for r in clean_rows]
    assert rows_of(masked, columns) == sorted(expected, key=str)
    assert any("<EMAIL>" in r[1] and "<PHONE>" in r[1] for r in expected)

    encoded = P.encoding(spark, masked, folder)
    back = rows_of(pieces.decode(encoded), ["doc_id", "text"])
    assert back == sorted(((r[0], r[1]) for r in expected), key=str)
    assert encoded.where("NOT lossless").count() == 0

    whole = rows_of(P.run(spark, folder), ["doc_id", "n_pieces"])
    assert whole == rows_of(encoded, ["doc_id", "n_pieces"])


def test_near_duplicates_decide_rows(spark, folder):
    """Texts that share an id are documents of their own; rows that repeat both are one."""
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    rows = [
        (1, text(1)), (1, text(2)), (2, text(1) + " end"), (3, text(2) + " end"), (4, text(4)), (4, text(4)), (4, None), (4, None),
        (None, text(1)), (5, text(5)), (6, ""), (6, ""), (-7, text(5)),
    ]
    table = [(i, t, "en", "s", n, 1, "w") for n, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(table, SCHEMA)
    left = P.near_duplicates(spark, docs, folder)
    assert left.columns == docs.columns
    want = [table[k] for k in (0, 1, 4, 6, 7, 8, 10, 12)]
    assert rows_of(left, docs.columns) == sorted(want, key=str)


def test_decontamination_decides_rows(spark, folder):
    """Rows without an id and rows that share one go or stay by their own text."""
    item = spark.read.parquet(f"{folder}/benchmark.parquet").where("text IS NOT NULL").first()["text"]
    rows = [
        (None, f"before {item} after"), (None, "clean, no id"), (None, None), (None, ""), (1, "clean, id used twice"),
        (1, item), (2, item.upper()), (3, "clean"), (3, "clean"), (None, f"before {item} after"),
    ]
    table = [(i, t, "en", "s", 0, 1, "w") for i, t in rows]
    docs = spark.createDataFrame(table, SCHEMA)
    left = P.decontamination(spark, docs, folder)
    assert left.columns == docs.columns
    clean = [r for r in table if r[1] is None or item not in r[1].lower()]
    assert rows_of(left, docs.columns) == sorted(clean, key=str) and len(clean) == 6


def test_contaminated_row_without_id_through_all_stages(spark, tmp_path):
    docs, items = documents(spark)
    planted = docs.where("doc_id = 203").withColumn("doc_id", F.lit(None).cast("long"))
    docs.unionByName(planted).write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    out = P.run(spark, str(tmp_path))
    item = items.first()["text"]
    texts = [r["text"] for r in pieces.decode(out).collect()]
    assert len(texts) > 100 and not any(item in t for t in texts)
    assert out.where("doc_id IS NULL").count() == 1


def test_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0


def test_clean_documents_stay(spark, sf_dir):
    """On the given tables: what goes has a reason."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spoken = P.language(spark, docs, sf_dir)
    assert spoken.count() >= 0.99 * docs.where(F.col("text").rlike(r"\p{L}")).count()
    leaked = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated")
    assert P.decontamination(spark, docs, sf_dir).count() == docs.count() - leaked.count()


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert names["pipeline"] is P.run
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
