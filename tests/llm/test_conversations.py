import hashlib
import itertools
import random
import re
import zlib

import pytest

from panelark.llm import conversations as cv

RIGHT = re.compile(r"(s?(ua)+)?")
SPACE = re.compile(r"[\x20\x09-\x0D]*")


def fault_of(row, earlier):
    kept = row[1].rstrip(" \t\n\x0b\x0c\r")
    if not kept:
        return "blank"
    if row in earlier:
        return "duplicate"
    return "" if kept[-1] in ".!?" else "truncated"


def plain(rows):
    """Counts, cost, edits and repaired rows of one conversation, by carrying every best list of edits as a string."""
    faults = [fault_of(r, rows[:i]) for i, r in enumerate(rows)]
    initials = [r[0][:1] for r in rows]
    best = {"": (0, "", ())}  # by the initials written so far, shortened to what matters

    def short(text):
        return text if text in ("", "s") else text[-1]

    def better(table, key, value):
        if key not in table or value[:2] < table[key][:2]:
            table[key] = value

    def with_inserts(table):
        out = {}
        todo = [(k, v) for k, v in table.items()]
        for _ in range(4):
            for k, v in todo:
                better(out, (k, v[1]), v)
            todo = [
                (short(k + x), (v[0] + 3, v[1] + "I", (*v[2], ({"u": "user", "a": "assistant"}[x], ""))))
                for k, v in todo for x in "ua" if valid(k, x)
            ]
        return [(k[0], v) for k, v in out.items()]

    def valid(key, letter):
        return (key, letter) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}

    for row, fault, initial in zip(rows, faults, initials):
        new = {}
        for k, (cost, edits, out) in with_inserts(best):
            better(new, k, (cost + 4, edits + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 * (fault == "truncated")
            if valid(k, initial):
                better(new, short(k + initial), (cost + more, edits + "K", (*out, row)))
            for x, role in (("u", "user"), ("a", "assistant")):
                if valid(k, x):
                    better(new, short(k + x), (cost + 3 + more, edits + "R", (*out, (role, row[1]))))
        best = new
    cost, edits, out = min(v for k, v in with_inserts(best) if k in ("", "a"))
    assert RIGHT.fullmatch("".join(r[0][:1] for r in out))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (*counts, illegal, cost, edits, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()), out


def searched(rows, spill=1 << 20):
    path, seen = cv.Path(spill), []
    for i, row in enumerate(rows):
        path.row(*row, {"": cv.FINE, "blank": cv.BLANK, "duplicate": cv.DUPLICATE, "truncated": cv.TRUNCATED}[fault_of(row, seen)], i)
        seen.append(row)
    r = path.result()
    return tuple(r[k] for k in ("blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))


ROWS = [("user", "a."), ("user", "b"), ("assistant", "c!"), ("assistant", "d"), ("system", "e?"), ("system", "f"), ("tool", "g."), ("", "h."), ("user", " \n"), ("user", "a.")]


def test_all_short_conversations():
    for n in range(4):
        for rows in itertools.product(ROWS, repeat=n):
            assert searched(list(rows)) == plain(list(rows))[0], rows


def test_by_trying_every_list_of_edits():
    rng = random.Random(3)
    for _ in range(40):
        rows = [rng.choice(ROWS) for _ in range(rng.randint(1, 3))]
        found = []
        for edits in itertools.product("KRD", repeat=len(rows)):
            for inserts in itertools.product(range(3), repeat=len(rows) + 1):
                text = "".join("I" * n + e for n, e in zip(inserts, edits)) + "I" * inserts[-1]
                found += every(rows, text)
        assert min(found) == searched(rows)[4:6]


def every(rows, edits):
    """Cost and edits if some choice of roles makes the list valid."""
    faults = [fault_of(r, rows[:i]) for i, r in enumerate(rows)]
    cost, options, i = 0, [""], 0
    for e in edits:
        if e == "I":
            cost, options = cost + 3, [o + x for o in options for x in "ua"]
            continue
        fault, initial, i = faults[i], rows[i][0][:1], i + 1
        if e == "D":
            cost += 4
            continue
        if fault in ("blank", "duplicate") or (e == "K" and not initial):
            return []
        cost += 3 * (fault == "truncated") + 3 * (e == "R")
        options = [o + x for o in options for x in (initial if e == "K" else "ua")]
    return [(cost, edits)] if any(RIGHT.fullmatch(o) for o in options) else []


@pytest.mark.parametrize("spill", [4, 20, 1 << 20])
def test_long_conversations_with_spilled_trails(spill):
    rng = random.Random(spill)
    rows = [rng.choice(ROWS[:8]) if rng.random() < 0.2 else (("user", "assistant")[i % 2], f"{i}.") for i in range(400)]
    assert searched(rows, spill) == plain(rows)[0]


def test_trail_comes_back_in_order():
    path = cv.Path(8)
    for i in range(50_001):
        path.row(("user", "assistant")[i % 2], f"{i}.", cv.FINE, i)
    assert path.trail.file is not None
    assert path.result()["audit"] == "K" * 50_001 + "I"


def frame(spark, rows, more=""):
    return spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string{more}")


def plain_query(rows):
    """The whole query: damage by checksum, then the plain repair of each conversation."""
    convs = {}
    for conv, turn, role, text in rows:
        here = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        here += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv, here in convs.items():
        here.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, _, _ in here if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *plain([r[1:] for r in here])[0])
    return out


def in_rows(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def test_query_on_given_conversations(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert in_rows(cv.query(spark, folder)) == plain_query(rows)


def test_nulls_ties_repeated_rows_and_spaces(spark):
    rng = random.Random(9)
    rows = [
        (rng.choice([None, 1, 2, 3, 4, 5]), rng.choice([None, 0, 1, 2, 3, 7, 2**60, -4]), rng.choice(["user", "assistant", "system", None, "", "ü", "User"]),
         rng.choice([None, "", "Yes.", "Yes.\x0b\t ", "no", "no ", "é!", "off", "x0B", "it is f", "?", "a\nb", "\x0c\x0b"]))
        for _ in range(400)
    ]
    df = frame(spark, [(*r, 0) for r in rows], ", kind int")
    assert in_rows(cv.repair(cv.damaged(df), there=cv.F.col("there"))) == plain_query(rows)


def test_conversation_whose_rows_all_go(spark):
    conv = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    out = in_rows(cv.repair(cv.damaged(frame(spark, [(conv, 0, "user", "Hi.")])), there=cv.F.col("there")))
    assert out == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert cv.repair(frame(spark, [])).count() == 0


def test_one_conversation_over_many_batches(spark):
    rows = [(1, i, ("user", "assistant")[i % 2] if i % 97 else "user", f"text {i}." if i % 53 else "cut") for i in range(6000)]
    rows.append((2, 0, "user", "long " * 400_000 + "."))
    got = in_rows(cv.repair(frame(spark, rows), spill_bytes=1024))
    assert got[1][1:] == plain([r[2:] for r in rows[:-1]])[0]
    assert got[2][5:7] == (3, "KI")


def test_repaired_rows_match_their_digest(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(None, 0, "assistant", "Hello."), (None, None, "system", "Rules.")]
    df = cv.damaged(frame(spark, rows))
    out = {}
    for r in cv.repaired(df, there=cv.F.col("there")).orderBy("conv_id", "place").collect():
        out.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        assert len(out[r.conv_id]) == r.place + 1
    for conv, report in in_rows(cv.repair(df, there=cv.F.col("there"))).items():
        assert hashlib.sha256("\n".join(out.get(conv, [])).encode()).hexdigest() == report[-1]
