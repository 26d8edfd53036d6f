import math
import random
import re
import time

import pytest

from panelark.llm import licenses as lic

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(text):
    return TOKEN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(texts, templates=lic.TEMPLATES):
    """Every beginning of every template tried in every text."""
    docs = [tokens(t) for t in texts]
    cut = [(t.label, tokens(t.text), [tokens(p) for p in t.phrases]) for t in templates]
    idf = {w: round(math.log((len(docs) + 1) / (sum(w in set(d) for d in docs) + 1)), 6) for _, ws, _ in cut for w in ws}
    out = []
    for words in docs:
        at = {}
        for phrase, label in {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}.items():
            p = phrase.split()
            at[label] = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places = sorted(i for found in at.values() for i in found)
        base = {label for label, found in at.items() if found}
        scores, own = [0.0], set()
        for label, ws, phrases in cut:
            shared = sorted(set(ws) & set(words), key=lambda w: (-idf[w], w))[: lic.LOOKUPS]
            least = max(2, math.ceil(lic.MIN_VOTES * len(shared)))
            for start in range(-len(ws), len(words)):
                there = [(q, w) for q, w in enumerate(ws) if 0 <= start + q < len(words) and words[start + q] == w]
                if sum(w in shared for _, w in there) < least:
                    continue
                near = words[max(start - lic.SLACK, 0) :][: len(ws) + 2 * lic.SLACK]
                ok = all(any(near[i : i + len(p)] == p for i in range(len(near))) for p in phrases)
                share = sum(idf[w] for _, w in there) / max(sum(idf[w] for w in ws), 1e-9)
                if ok and round(share, 6) >= lic.MIN_SCORE:
                    scores.append(round(share, 6))
                    own.add(label)
        first, last = (places[0], places[-1]) if places else (None, None)
        out.append((len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(base | own)), pytest.approx(max(scores), abs=2e-6)))
    return out


def scanned(spark, texts, templates=lic.TEMPLATES):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [tuple(r)[1:] for r in lic.report(docs, lic.rarity(docs, templates), templates).orderBy("doc_id").collect()]


def some_texts(seed, n=60):
    rng = random.Random(seed)
    filler = "the of this work program software is under to license version and été 2 3 by under, Thé ßx permission".split()
    out = []
    for _ in range(n):
        words = [rng.choice(filler) for _ in range(rng.randint(0, 60))]
        for t in rng.sample(lic.TEMPLATES, rng.choice([0, 0, 1, 2])):
            notice = t.text.split()
            for _ in range(rng.choice([0, 0, 1, 4])):  # replaced, lost and added words
                k = rng.randrange(max(len(notice), 1))
                notice[k : k + 1] = rng.choice([["x"], [], ["by", "y"]])
            k = rng.randint(0, len(words))
            words[k:k] = notice
        out.append(rng.choice([" ", "\n# ", "-"]).join(words))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_version(spark, seed):
    texts = some_texts(seed) + [None, "", "under the mit license", "UNDER THE MIT LICENSE under the mit\nlicense", "mit license", "cc-by_nc CC/BY.NC"]
    assert scanned(spark, texts) == plain(texts)


def test_given_documents(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    assert [r[0] for r in scanned(spark, texts)] == [len(tokens(t)) for t in texts]
    assert scanned(spark, texts) == plain(texts)


def test_every_template_is_found_and_its_lookalikes_are_not(spark):
    texts = [f"/* {t.text} */\nint main" for t in lic.TEMPLATES] + ["some other text"] * 200
    for t, row in zip(lic.TEMPLATES, scanned(spark, texts)):
        assert t.label in row[5].split(",") and row[6] > 0.9, t
    other = ["a licensed public house, version 3", "free of charge", "the GNU project", "This program is free software", "creative commons"]
    assert all(r[5] == "" and r[6] == 0 for r in scanned(spark, other + texts)[:5])


def test_version_decides_between_licences(spark):
    notice = lic.GNU.format("Panel", "", "either version {}")
    texts = [notice.format(2), notice.format(3), notice.replace("GNU ", "GNU Lesser").format(3)] + ["text of something else"] * 50
    assert [r[5] for r in scanned(spark, texts)[:3]] == ["gpl-2", "gpl-3", "lgpl-3"]


def test_many_places_in_one_text(spark):
    one = "Released under the MIT License. This work is licensed under the GNU General Public License, version 3.\n"
    texts = [one * 20_000, "nothing here"]
    start = time.time()
    got = scanned(spark, texts)[0]
    assert got[:6] == (340_000, 20_000, 1, 1 + 17 * 19_999, "mit", "gpl-3,mit")
    assert time.time() - start < 60


def test_empty_table_repeated_rows_other_columns_and_no_templates(spark):
    assert scanned(spark, []) == []
    docs = spark.createDataFrame([(None, "under the MIT license", "x", 1)] * 2, "doc_id long, text string, label string, _w int")
    rows = lic.report(docs, lic.rarity(docs)).collect()
    assert [(r.doc_id, r.base_labels, r.n_base) for r in rows] == [(None, "mit", 1)] * 2
    assert scanned(spark, ["under the MIT license"], []) == [(4, 1, 0, 0, "mit", "mit", 0.0)]


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = lic.report(docs, lic.rarity(docs))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
