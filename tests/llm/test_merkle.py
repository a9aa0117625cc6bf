"""The manifest against a tree built in one piece."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from cuesheet.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    values = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return digest("".join(values))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        own = levels[-1]
        levels.append([digest("".join(own[k : k + 16])) for k in range(0, len(own), 16)])
    return levels


def way(levels, k):
    out = []
    for level in levels[:-1]:
        run = level[k - k % 16 : k - k % 16 + 16]
        out.append((run, k % 16))
        k //= 16
    return out


def brute(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, own = [], []
    for s in sources:
        mine = sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        own.append(mine)
        trees.append(tree([leaf(*r) for r in mine]))
    top = tree([t[-1][0] for t in trees])
    out = []
    for place, (mine, t) in enumerate(zip(own, trees)):
        for k, r in enumerate(mine):
            steps = way(t, k) + way(top, place)
            proof = digest("".join(h for run, at in steps for n, h in enumerate(run) if n != at))
            seen = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                seen = (r[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]), *r[2:])
            now = leaf(*seen)
            for run, at in steps:
                now = digest("".join([*run[:at], now, *run[at + 1 :]]))
            out.append((r[0], leaf(*r), t[-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return sorted(out, key=str)


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r) for r in merkle.manifest(df, merkle.tampered_text()).collect()), key=str)


def test_sources_of_many_sizes(spark):
    """Full and ragged trees on every level; more sources than one run holds."""
    rows, sizes = [], [1, 2, 15, 16, 17, 255, 256, 257, 300, 4096, 4097, 5000] + [1] * 20
    for s, size in enumerate(sizes):
        for _ in range(size):
            n = len(rows)
            rows.append((n * 7 - 100, f"Text {n % 13} Ä", "de" if n % 3 else None, f"s{s:02d}" if s else None, n))
    rows = rows[::2] + rows[1::2]
    got = found(spark, rows)
    assert got == brute(rows)
    assert 0 < sum(not r[-1] for r in got) < len(rows)


def test_odd_rows(spark):
    rows = [
        (None, None, None, None, None), (None, None, None, None, None), (1, "", "", "", 0), (1, "", "", "", 0), (1, None, "", "", 0),
        (2, "A" * 300_000, "en", "a", -5), (3, "- 3:abc", "-", "-", None), (4, "É", "fr", "ä", 1), (5, "x", "en", "=a", 1),
        (5, "y", "en", "=a", 1),
    ]
    assert found(spark, rows) == brute(rows)


def test_one_source_and_one_row(spark):
    rows = [(7, "One", "en", "a", 3)]
    got = found(spark, rows)
    assert got == brute(rows) and got[0][1] == got[0][2] == got[0][3]


def test_empty_table_and_clashing_columns(spark):
    assert found(spark, []) == []
    names = SCHEMA + ", leaf string, key string, pos long, total long, block long, root string, now string, _row long"
    rows = [(k, "T", "en", "s", 1, "a", "b", 1, 2, 3, "c", "d", 9) for k in range(20)]
    got = merkle.manifest(spark.createDataFrame(rows, names), merkle.tampered_text()).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute([r[:5] for r in rows])


@pytest.mark.parametrize("places", [1, 2, 16, 17, 33, 256, 257, 273, 700])
def test_butterfly(spark, places):
    """Each node gets the siblings on its whole way, also where groups are ragged; stand-ins do not come out."""
    nodes = [digest(str(k)) for k in range(places)]
    df = spark.createDataFrame([("k", k, places, h) for k, h in enumerate(nodes)], "key string, place long, places long, digest string")
    got = merkle.butterfly(df, "key").collect()
    levels = tree(nodes)
    assert sorted(r["place"] for r in got) == list(range(places))
    for r in got:
        steps = [("".join(run[:at]), "".join(run[at + 1 :])) for run, at in way(levels, r["place"])]
        assert r["root"] == levels[-1][0] and [(s["left"], s["right"]) for s in r["steps"]] == steps


def test_any_change_is_seen(spark):
    rows = [(k, f"text {k}", "en", f"s{k % 3}", 1) for k in range(60)]
    changed = F.when(F.col("doc_id") == 17, F.lit("text 17 ")).otherwise(F.col("text"))
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA), changed).collect()
    assert [r["doc_id"] for r in got if not r["verified"]] == [17]
