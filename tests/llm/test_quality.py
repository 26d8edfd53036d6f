"""Counts against plain Python, Kneser-Ney against its definition, bands and odd rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from panelark.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    None, "", " \n\t", "one", "a b c a b c", "a a a a", "x\nx\n\nx \nx", "é # * % é\x0bé", "a b c d a b c", "\x1c a\x85b\xa0c", "b c d " * 3000,
    "line one\r\nline one\r\n", "日本 語 日本 語 日本 語", "<|> & $",
]


def plain(text):
    text = text or ""
    found = WORD.findall(text)
    windows = Counter(zip(found, found[1:], found[2:]))
    covered = set()
    for i in range(len(found) - 2):
        if windows[tuple(found[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return [len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), repeated, len(covered)]


def test_counts():
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab é\n#\t ") for _ in range(rng.randint(0, 60))) for _ in range(800)]
    have = quality.text_counts(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert [int(have[c][i]) for c in quality.COUNTS] == plain(text), repr(text)


def test_kneser_ney_by_definition():
    rng = random.Random(2)
    raw = Counter(tuple(rng.choice([0, 1, 1, 2, 3, 7]) for _ in range(4)) for _ in range(900))
    code = np.array([int(np.polyval(g, quality.SYMBOLS)) for g in raw])
    model = quality.kneser_ney(code, np.array(list(raw.values())))
    assert (np.diff(model.keys.astype(object)) > 0).all()
    tables = [dict(raw)]
    for _ in range(3):
        lower = defaultdict(set)
        for g in tables[-1]:
            lower[g[1:]].add(g[0])
        tables.append({g: len(s) for g, s in lower.items()})

    def p(gram):
        if not gram:
            return 1 / quality.SYMBOLS
        table = tables[4 - len(gram)]
        cells = np.zeros(max(len(table), 1), int)
        cells[: len(table)] = list(table.values())
        discount = quality._discounts(cells)
        after = [c for g, c in table.items() if g[:-1] == gram[:-1]]
        if not after:
            return p(gram[1:])
        mass = sum(discount[min(c, 3)] for c in after) / sum(after)
        c = table.get(gram, 0)
        return max(c - discount[min(c, 3)], 0) / sum(after) + mass * p(gram[1:])

    for gram in [(0, 1, 1, 2), (7, 7, 7, 7), (3, 0, 1, 9), (9, 9, 9, 9), (9, 1, 2, 3), *list(raw)[:40]]:
        have = model.log_probability(np.array([int(np.polyval(gram, quality.SYMBOLS))]))[0]
        assert have == pytest.approx(np.log10(p(gram)), abs=1e-4), gram
    context = int(np.polyval((1, 2, 1), quality.SYMBOLS)) * quality.SYMBOLS
    assert (10 ** model.log_probability(context + np.arange(quality.SYMBOLS))).sum() == pytest.approx(1, abs=1e-4)


def test_spark_counts(spark):
    docs = spark.createDataFrame([("ab ab", "en"), ("ab ab", "en"), ("xy", None), (None, "en")], "text string, lang string")
    models = quality.fit(docs.repartition(3))
    assert set(models) == {"en", quality.POOLED}
    code, _ = quality.codes(["ab ab", "ab ab"])
    want = quality.kneser_ney(*np.unique(code, return_counts=True))
    assert all(np.array_equal(a.astype(float), b.astype(float), equal_nan=True) for a, b in zip(models["en"], want, strict=True))


def test_rules(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["the", "an", "er", "on", "is"]) for _ in range(rng.randint(1, 3)))
    rows = [(i, " ".join(word() for _ in range(120)), "en") for i in range(60)]
    rows += [(100, " ".join("qzx" + rng.choice("jkwvy") * 3 + str(rng.random()) for _ in range(80)), "en")]
    rows += [(200 + i, t, "en") for i, t in enumerate(ODD)] + [(None, rows[0][1], None), (0, rows[0][1], "en")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, perplexity double")
    have = quality.rules(docs).collect()
    assert len(have) == len(rows)
    kept = {r.doc_id: r.kept for r in have}
    assert all(kept[i] for i in range(60)) and not kept[100] and not any(kept[200 + i] for i in range(len(ODD)))
    for r in have:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert quality.rules(docs.limit(0)).collect() == []


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    have = quality.query(spark, folder).collect()
    assert len(have) == len(texts)
    for r in have:
        assert [r[c] for c in quality.COUNTS] == plain(texts[r.doc_id])


def test_characters_stay_apart():
    """Letters, cases, digits and marks are symbols of their own, also beyond 16 bits."""
    texts = ["ab12", "AB12", "ab34", "жщ", "語本", "\U0001f600", "\U0001f601", "ab;?", "ab!?", "a\tb"]
    assert len({tuple(quality.codes([t])[0].tolist()) for t in texts}) == len(texts)


def test_rare_grams_are_joined(spark):
    """Perplexities are the same whether all entries, some or none are sent to the tasks."""
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("abcdé語AB1 ") for _ in range(rng.randint(0, 80))), rng.choice(["en", "de", None])) for i in range(60)]
    rows += [(61, "new 字 text", "de")]
    docs = spark.createDataFrame([*rows, (60, None, "en")], "doc_id long, text string, lang string").repartition(3)
    names, entries = quality.train(docs.where("doc_id <> 61"))
    have = [{r.doc_id: r.log_perplexity for r in quality.measure(docs, names, entries, held=held).collect()} for held in (quality.HELD, 150, 0)]
    models = quality.fit(docs.where("doc_id <> 61"))
    for i, text, lang in rows:
        want = -models[lang or quality.POOLED].log_probability(quality.codes([text])[0]).mean()
        assert [h[i] for h in have] == pytest.approx([want] * 3, abs=1e-6)
    assert [h[60] for h in have] == [None] * 3
