"""The signal log's tree against a plain recursive one."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from panelark.operators import live


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def root(leaves):
    """The published definition: split at the largest power of two below the size."""
    if len(leaves) == 1:
        return leaves[0]
    k = 1 << ((len(leaves) - 1).bit_length() - 1)
    return sha(f"1|{root(leaves[:k])}|{root(leaves[k:])}")


def day(i):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=6 * i)


def digests(spark, sizes):
    rows = [(p, day(i), sha(f"{p}{i}")) for p, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "portfolio string, signal_date timestamp_ntz, digest string")


def leaf(p, i):
    return sha(f"0|{day(i):%Y-%m-%d %H:%M:%S}|{sha(f'{p}{i}')}")


SIZES = {"one": 1, "two": 2, "seven": 7, "eight": 8, "many": 100}


def test_roots_after_every_date(spark):
    log = {(r.portfolio, r.signal_date): r for r in live.chain_log(digests(spark, SIZES)).collect()}
    for p, n in SIZES.items():
        leaves, before = [leaf(p, i) for i in range(n)], live.GENESIS
        for i in range(n):
            row = log[p, day(i)]
            assert (row.previous_hash, row.sha256) == (before, root(leaves[: i + 1]))
            before = row.sha256


def test_every_proof_holds_and_no_other_does(spark):
    proofs = live.inclusion_proofs(digests(spark, SIZES)).cache()
    assert proofs.where(~live.proof_holds()).count() == 0
    for p, n in SIZES.items():
        rows = proofs.where(F.col("portfolio") == p).collect()
        assert {r.root for r in rows} == {root([leaf(p, i) for i in range(n)])}
        assert max(len(r.proof) for r in rows) == (n - 1).bit_length()
    wrong = proofs.withColumn("digest", F.lit(sha("other")))
    assert wrong.where(live.proof_holds()).count() == 0


def test_appending_changes_no_earlier_date(spark):
    first = live.chain_log(digests(spark, {"p": 5, "q": 3})).cache()
    again = digests(spark, {"p": 9, "q": 3, "new": 1}).withColumn("digest", F.when(F.col("signal_date") <= F.lit(day(2)), F.lit("changed")).otherwise(F.col("digest")))
    log = live.append_log(first, again).cache()
    assert log.count() == 9 + 3 + 1
    kept = log.join(first, first.columns, "left_semi")
    assert kept.count() == first.count()
    assert log.where("digest = 'changed' AND portfolio <> 'new'").count() == 0
    assert live.verify_chain(log).where(~F.col("valid")).count() == 0


@pytest.mark.parametrize(("column", "bad"), [("digest", [2]), ("leaf", [2, 3, 4]), ("sha256", [2]), ("previous_hash", [2])])
def test_what_tampering_marks(spark, column, bad):
    log = live.chain_log(digests(spark, {"p": 5}))
    changed = log.withColumn(column, F.when(F.col("signal_date") == F.lit(day(2)), F.lit("0" * 64)).otherwise(F.col(column)))
    marks = [r.valid for r in live.verify_chain(changed).orderBy("signal_date").collect()]
    assert [i for i, good in enumerate(marks) if not good] == bad


def test_empty_log(spark):
    none = digests(spark, {"p": 1}).limit(0)
    assert live.chain_log(none).count() == 0 and live.inclusion_proofs(none).count() == 0
