"""Co-training: what it learns on the tables, the pieces by hand, and odd rows."""

import random

import numpy as np

from cuesheet.llm import cotrain


def test_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    # Labels of a fourth of the rows are kept from the fit.
    known = labels.where("crc32(cast(doc_id AS string)) % 4 <> 0")
    got = cotrain.score(docs, cotrain.fit(docs, known))
    assert got.count() == docs.count()
    rows = got.join(labels.where("crc32(cast(doc_id AS string)) % 4 = 0"), "doc_id").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([g >= cotrain.KEEP for g in good]) > 0.97


def planted(n=1200):
    """Content tells most of it, metadata tells some; the labelled rows are few."""
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(n):
        good = rng.random() < 0.6
        words = ["fine", "clear", "useful"] if good else ["zzqq", "xxkk", "qqxx"]
        text = " ".join(rng.choice(words + ["common", "other"]) + str(rng.randrange(50)) for _ in range(rng.randrange(3, 30)))
        source = "a" if (good if rng.random() < 0.85 else not good) else "b"
        rows.append((k, text, "en", source, len(text)))
        if k % 6 == 0:
            labels.append((k, int(good), 0))
    return rows, labels, {r[0]: "fine" in r[1] or "clear" in r[1] or "useful" in r[1] for r in rows}


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def test_planted(spark):
    rows, labels, truth = planted()
    docs = spark.createDataFrame(rows, DOCS)
    model = cotrain.fit(docs, spark.createDataFrame(labels, LABELS))
    got = cotrain.score(docs, model).collect()
    right = np.mean([(r["score"] >= 0.5) == truth[r["doc_id"]] for r in got])
    by_meta = np.mean([(r["p_metadata"] >= 0.5) == truth[r["doc_id"]] for r in got])
    assert right > 0.95 and 0.75 < by_meta < 0.95
    # Calibrated: among rows with a chance near p, about the share p is good.
    for low, high in ((0.0, 0.2), (0.8, 1.01)):
        some = [truth[r["doc_id"]] for r in got if low <= r["score"] < high]
        assert low - 0.1 <= np.mean(some) <= high + 0.1


def test_views_teach_each_other(spark, monkeypatch):
    """Rows labelled by one view reach the other view's fit, not its own, in every round and from the whole table."""
    seen = []
    original = cotrain.pseudo_sums
    monkeypatch.setattr(cotrain, "pseudo_sums", lambda pool, model: (seen.append((pool, model)), original(pool, model))[1])
    rows, labels, _ = planted(600)
    cotrain.fit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS))
    assert len(seen) == cotrain.ROUNDS
    pool, model = seen[-1]
    assert {r["doc_id"] for r in pool.collect()} == {r[0] for r in rows} - {r[0] for r in labels}
    by_row = cotrain.score(spark.createDataFrame([r for r in rows if r[0] % 6], DOCS), model).collect()
    sums, counts = original(pool, model)
    for view, name in ((0, "p_metadata"), (1, "p_content")):
        assert counts[view, 1] == sum(model.sure(r[name]) == 1 for r in by_row)
        assert counts[view, 0] == sum(model.sure(r[name]) == 0 for r in by_row)
    assert counts.sum() > 0 and (counts[0] != counts[1]).any()
    # Rows with an empty list of places have no share to give; all others give one.
    assert abs(sums[2].sum() - counts[1].sum()) < 1e-2


def brute_fit(rows, marks, held):
    """The model by loops over rows on the driver: (good, bad) sums, the other view's sure rows, calibration."""
    rounds, sizes, views = cotrain.ROUNDS, cotrain._TABLES, cotrain._VIEW
    places = {key: (cotrain.trigrams(text), cotrain.shape(text), np.array(meta)) for key, text, meta in rows}

    def add(total, key, label, table, weight=1.0):
        for place in places[key][table]:
            total[label][place] += weight / len(places[key][table])

    picked = None
    for turn in range(rounds + 1):
        tables = []
        for table, size in enumerate(sizes):
            total = {0: np.zeros(size), 1: np.zeros(size)}
            taught = [k for k in marks if k not in held]
            for key in taught:
                add(total, key, marks[key], table)
            for label in (0, 1):
                some = [k for k, x in (picked or {0: {}, 1: {}})[views[table]].items() if x == label]
                for key in some:
                    add(total, key, label, table, min(1, sum(marks[k] == label for k in taught) * turn / rounds / len(some)))
            tables.append(cotrain.Bayes.fit(total[1], total[0]))
        scored = {k: np.array([t.score(p) for t, p in zip(tables, places[k])]) for k in places}
        truth, on_held = np.array([marks[k] for k in sorted(held)]), np.array([scored[k] for k in sorted(held)])
        model = cotrain.Model(tables, cotrain.logistic(on_held[:, [0, 1]], truth), cotrain.logistic(on_held[:, [2]], truth), np.zeros(3))
        prior = np.mean([marks[k] for k in taught])
        picked = {0: {}, 1: {}}
        for key in places:
            if key not in marks:
                content, meta, _ = (x[0] for x in model.chances(scored[key][None]))
                for view, chance in ((0, meta), (1, content)):
                    if 1 - chance <= (1 - cotrain.SURE) * (1 - prior):
                        picked[view][key] = 1
                    elif chance <= (1 - cotrain.SURE) * prior:
                        picked[view][key] = 0
    model.combined = cotrain.logistic(model.logits(on_held), truth)
    return {k: [x[0] for x in model.chances(s[None])] for k, s in scored.items()}


def test_against_brute_force(spark):
    rows, labels, _ = planted(420)
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    sample = cotrain.labelled_sample(docs, marks).collect()
    assert {r["key"]: r["label"] for r in sample} == {r[0]: r[1] for r in labels}
    by_hand = docs.select("doc_id", "text", cotrain.metadata(docs.columns).alias("meta")).collect()
    want = brute_fit(by_hand, {r[0]: r[1] for r in labels}, {r["key"] for r in sample if r["held"]})
    got = cotrain.score(docs, cotrain.fit(docs, marks)).collect()
    assert len(got) == len(want) == 420
    for r in got:
        assert np.allclose([r["p_content"], r["p_metadata"], r["score"]], want[r["doc_id"]], atol=1e-4)


def test_the_sample_of_labels_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(cotrain, "LABELLED", 30)
    rows, labels, _ = planted(300)
    docs = spark.createDataFrame(rows + [(6, f"copy {k}", "en", "a", 6) for k in range(200)], DOCS)
    sample = cotrain.labelled_sample(docs, spark.createDataFrame(labels * 3, LABELS)).collect()
    assert len(sample) == len({r["key"] for r in sample}) == 30


def test_odd_rows(spark):
    rows, labels, _ = planted(300)
    model = cotrain.fit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels + [(None, 1, 0), (99_999, 0, 0), (1, None, None)], LABELS))
    odd = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "fine", "en", "a", 4), (3, "clear " * 100_000, "en", "a", 1), (3, "clear " * 100_000, "en", "a", 1)]
    docs = spark.createDataFrame([(*r, 0.5, "m") for r in odd], DOCS + ", score double, meta string")
    got = cotrain.score(docs, model).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 and r["kept"] is not None for r in got)
    assert cotrain.score(docs.limit(0), model).count() == 0
    assert cotrain.score(docs.select("doc_id", "text"), model).count() == 5


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a text", "en", "a", 6)], DOCS)
    for labels in ([], [(1, 1, 0)]):
        got = cotrain.score(docs, cotrain.fit(docs, spark.createDataFrame(labels, LABELS))).first()
        assert (got["score"], got["kept"]) == (0.5, True)


def test_logistic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x[:, 0] + 0.5)))).astype(float)
    beta = cotrain.logistic(x, y)
    assert abs(beta[0] - 2) < 0.2 and abs(beta[1]) < 0.15 and abs(beta[2] - 0.5) < 0.15
    assert (cotrain.logistic(-x[:, :1], y)[:-1] >= 0).all()


def test_bayes_by_hand():
    good, bad = np.array([3.0, 1.0, 0.0]), np.array([0.0, 1.0, 1.0])
    model = cotrain.Bayes.fit(good, bad)
    smooth = 0.001
    expected = np.log((good + smooth) / (4 + 3 * smooth)) - np.log((bad + smooth) / (2 + 3 * smooth))
    assert np.allclose(model.weights, expected, atol=1e-5)
    assert abs(model.score(np.array([0, 2])) - expected[[0, 2]].mean()) < 1e-5 and model.score(np.array([], int)) == 0
