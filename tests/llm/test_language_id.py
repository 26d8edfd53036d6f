"""Language profiles: held-out accuracy, a plain version of the arithmetic, and odd rows."""

import zlib

import numpy as np

from panelark.llm import language_id as lid

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    have = lid.query(spark, FOLDER).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(have) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in have)
    held = [r for r in have if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def plain_vector(text):
    letters = lid.letter_vectors().astype(int)
    symbols = [lid.BREAK]
    for c in text + "\n":
        s = int(lid.classes()[ord(c)])
        if s != lid.BREAK or symbols[-1] != lid.BREAK:
            symbols.append(s)
    total = np.zeros(lid.SIZE)
    for a, b, c in zip(symbols, symbols[1:], symbols[2:]):
        total += np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c]
    return total


def test_against_plain_arithmetic(spark):
    rows = [(1, "The cat. 12 sat!", "en"), (2, "Der Hund über", "de"), (3, "the hat", "en"), (4, "Ärger 日本", "de")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = lid.fit(docs)
    assert profiles.languages == ["de", "en"]
    want = {lang: sum(plain_vector(t) for _, t, x in rows if x == lang) for lang in ("de", "en")}
    unit = np.array([v / np.linalg.norm(v) for v in want.values()])
    assert np.allclose(profiles.vectors, unit, atol=1e-5)
    for r in lid.predict(docs, profiles).collect():
        v = plain_vector(rows[r.doc_id - 1][1])
        cosine = unit @ v / np.linalg.norm(v)
        assert r.lang_pred == profiles.languages[int(cosine.argmax())] and abs(r.score - cosine.max()) < 1e-4


def test_odd_rows(spark):
    rows = [
        (1, "the cat and the hat", "en"), (2, None, "en"), (3, "", "en"), (4, " 12 .. \n", "de"), (5, "der hund und die", "de"),
        (None, "the cat", None), (6, "the dog " * 40000, None), (6, "the dog", None),
    ]
    docs = spark.createDataFrame([(*r, "x", 0.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, _score double")
    have = [(r.doc_id, r.lang_pred) for r in lid.predict(docs, lid.fit(docs)).collect()]
    want = [(1, "en"), (2, "und"), (3, "und"), (4, "und"), (5, "de"), (None, "en"), (6, "en"), (6, "en")]
    assert sorted(have, key=str) == sorted(want, key=str)
    nothing = lid.fit(docs.limit(0))
    assert {(r.lang_pred, r.score) for r in lid.predict(docs, nothing).collect()} == {("und", 0.0)}
    assert lid.predict(docs.limit(0), nothing).collect() == []
    kept = lid.stage(spark, docs.drop("_score"), "")
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "5", "6", "6", "None"] and kept.columns == docs.drop("_score").columns
