from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import pytest
from conftest import SMALL, same_rows

from pingworks.llm import convrepair as C

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def test_equals_its_sql(spark, duck):
    same_rows(C.query(spark, SMALL), duck, C.ORACLE_SQL)


def _faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        solid = text.rstrip(BLANK)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def _legal(initials: str) -> bool:
    rest = initials[1:] if initials[:1] == "s" else initials
    return initials == "" or (rest != "" and len(rest) % 2 == 0 and rest == "ua" * (len(rest) // 2))


def _cheapest(rows, most: int):
    """Every edit sequence with up to ``most`` insertions, tried one by one."""
    faults, best = _faults(rows), None

    def walk(i, inserts, cost, audit, made):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows) and _legal("".join(r[:1] or "-" for r, _ in made)):
            best = min(best or (cost, audit, made), (cost, audit, made), key=lambda x: x[:2])
        if inserts < most:
            for role in ("user", "assistant"):
                walk(i, inserts + 1, cost + 3, audit + "I", [*made, (role, "")])
        if i == len(rows):
            return
        _, role, text = rows[i]
        walk(i + 1, inserts, cost + 4, audit + "D", made)
        if faults[i] in ("", "truncated"):
            more = 3 if faults[i] else 0
            walk(i + 1, inserts, cost + more, audit + "K", [*made, (role, text)])
            for new in ("user", "assistant"):
                walk(i + 1, inserts, cost + more + 3, audit + "R", [*made, (new, text)])

    walk(0, 0, 0, "", [])
    return best


def _brute(rows, most=3):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    cost, audit, made = _cheapest(rows, most)
    turns = [t for t, _, _ in rows if t is not None]
    faults = _faults(rows)
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha), made


FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _conversations(seed, n):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "why", " \n", "", "So? ", "x.\t", "é"]
    roles = ["user", "assistant", "system", "tool", "user", "assistant", ""]
    return {k: [(rng.choice([None, *range(7)]), rng.choice(roles), rng.choice(texts)) for _ in range(rng.randrange(1, 6))] for k in range(n)}


@pytest.mark.parametrize("longest", [1, 2, 4096])
def test_against_every_edit_sequence(spark, longest):
    """Also with conversations cut into fragments of one and two rows."""
    convs = _conversations(3, 60)
    rows = spark.createDataFrame([(k, *r) for k, v in convs.items() for r in v], SCHEMA)
    got = {r.conv_id: tuple(r[c] for c in FIELDS) for r in C.digests(rows, C.audits(rows, longest=longest)).collect()}
    for k, v in convs.items():
        assert got[k] == _brute(v)[0], (k, v)


def test_repaired_turns(spark):
    convs = _conversations(8, 25)
    rows = spark.createDataFrame([(k, *r, "x", 1.5) for k, v in convs.items() for r in v], SCHEMA + ", audit string, cost double")  # clashing names
    got = {}
    for r in C.repair(rows).orderBy("conv_id", "position").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
        assert len(got[r.conv_id]) == r.position + 1
    assert got == {k: m for k, v in convs.items() if (m := _brute(v)[1])}


def test_one_conversation_over_many_tasks(spark):
    """A conversation of most rows, with copies, lies in several tasks and fragments."""
    rng = random.Random(1)
    long = [(t, rng.choice(["user", "assistant"]), rng.choice(["Same.", f"Turn {t}.", f"cut {t}", ""])) for t in range(3000)]
    long += [(5, "user", "Again.")] * 500
    rows = spark.createDataFrame([(7, *r) for r in long] + [(k, 0, "user", "Hm.") for k in range(100, 400)], SCHEMA)
    whole = C.audits(rows).filter("conv_id = 7").first()
    parts = {(r.part, r.seq) for r in C.fragments(C.facts(rows), 100).filter("conv_id = 7").select("part", "seq").collect()}
    split = C.audits(rows, longest=100).filter("conv_id = 7").first()
    assert len(parts) > 20 and len({p for p, _ in parts}) > 1 and whole == split
    assert len(split.audit.replace("I", "")) == 3500 and split.audit.count("D") >= 500 and split.duplicate >= 499


def test_edges(spark):
    big = "word " * 200_000 + "end."
    rows = [
        (None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (1, None, None, None), (1, None, None, None), (2, 1, "user", big), (2, 2, "assistant", "Yes."),
        (3, 9, "user", "a."), (3, 9, "assistant", "b."), (3, 9, "assistant", "b."), (4, -5, "assistant", "Only."), (4, 5, "system", "Rules."),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    ids = spark.createDataFrame([(9,), (2,), (9,)], "conv_id long")
    got = {r.conv_id: r for r in C.digests(df, C.audits(df, ids)).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert set(got) == {None, 1, 2, 3, 4, 9}
    assert tuple(got[9])[1:] == (0, 0, 0, 0, 0, 0, "", empty)
    assert (got[None].cost, got[None].audit) == (0, "KK") and got[None].repaired_sha256 == hashlib.sha256(b"user:Hi.\nassistant:Ho.").hexdigest()
    assert (got[1].gaps, got[1].blank, got[1].audit, got[1].repaired_sha256) == (0, 2, "DD", empty)
    assert got[2].repaired_sha256 == hashlib.sha256(f"user:{big}\nassistant:Yes.".encode()).hexdigest()
    assert (got[3].duplicate, got[3].audit) == _pick(_brute([(9, "user", "a."), (9, "assistant", "b."), (9, "assistant", "b.")])[0])
    assert got[4].gaps == 9 and got[4].audit == _brute([(-5, "assistant", "Only."), (5, "system", "Rules.")])[0][6]
    assert C.digests(df.limit(0), C.audits(df.limit(0))).count() == 0 and C.repair(df.limit(0)).count() == 0


def _pick(x):
    return x[2], x[6]


def test_damage(spark):
    rows = [(c, t, r, x) for c in (None, 3, 4) for t in (None, *range(12)) for r, x in [("assistant", "One. Two? Three!")]] + [(5, 1, None, None)]
    got = sorted(map(tuple, C.damage(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    want = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        text = "" if kind == 1 else x.translate({46: None, 33: None, 63: None}) if kind == 2 else x
        want += [(c, t, "user" if kind == 4 else r, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert got == sorted(want, key=str)
