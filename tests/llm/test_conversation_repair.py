"""Conversation repair against all edit sequences of short conversations, and against SQL."""

import itertools
import random
import re

import duckdb
import pytest

import segspark.llm.conversation_repair as cr

SPACES = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, cost int, audit string, seq int"


def brute(turns):
    """(cost, audit, repaired turns) of the least of all edit sequences."""
    seen, options = set(), []
    inserts = [w for n in range(3) for w in itertools.product("ua", repeat=n)]
    for role, text in turns:
        bare = text.strip(SPACES)
        must = not bare or (role, text) in seen
        seen.add((role, text))
        late = int(not must and bare[-1] not in ".!?")
        edits = [(3, "D", None)]
        if not must:
            edits += [(late, "K", (role, text)), (2 + late, "R", ("user", text)), (2 + late, "R", ("assistant", text))]
        options.append([(2 * len(w) + c, "I" * len(w) + e, [({"u": "user", "a": "assistant"}[x], "") for x in w] + [t] * (t is not None)) for w in inserts for c, e, t in edits])
    options.append([(2 * len(w), "I" * len(w), [({"u": "user", "a": "assistant"}[x], "") for x in w]) for w in inserts])
    best = None
    for way in itertools.product(*options):
        made = [t for x in way for t in x[2]]
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in made)):
            found = (sum(x[0] for x in way), "".join(x[1] for x in way))
            if best is None or found < best[:2]:
                best = (*found, made)
    return best


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", 3) for r in rows], SCHEMA)


def test_all_edit_sequences(spark):
    dice = random.Random(5)
    said = ["Hi.", "Well", "", " ", "Go!", "no end  "]
    rows, convs = [], {}
    for c in range(70):
        turns = [(dice.choice(["system", "user", "assistant", "tool", "User", ""]), dice.choice(said)) for _ in range(dice.randint(1, 3))]
        convs[c] = turns
        rows += [(c, t, *x) for t, x in enumerate(turns)]
    repair = cr.Repair(frame(spark, rows))
    found = {r["conv_id"]: r for r in repair.summary().collect()}
    made = {}
    for r in repair.turns().orderBy("conv_id", "turn").collect():
        made.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert sorted(found) == sorted(convs)
    for c, turns in convs.items():
        cost, audit, left = brute(turns)
        assert (found[c]["cost"], found[c]["audit"], made.get(c, [])) == (cost, audit, left), turns


def odd_rows():
    dice = random.Random(11)
    words = ["One.", "two", "", None, "\t\n", "Three!", "vier?", "Ende \x0b", "É.", "same.", "same."]
    roles = ["system", "user", "user", "assistant", "assistant", None, "", "tool"]
    rows = [(c, t, dice.choice(roles), dice.choice(words) if dice.random() < 0.6 else f"text {c} {t}.") for c in range(40) for t in range(dice.randint(1, 9))]
    rows += [(100, t, ["user", "assistant"][t % 2], f"turn {t}" + "." * (t % 7 > 0)) for t in range(150)]  # cut over many blocks
    rows += [(101, t, "user", "again and again") for t in range(60)]
    rows += [(None, t, "user", "no name.") for t in (None, None, 3, 3, 9)] + [(102, None, "assistant", "x" * 200_000), (103, 5, None, None), (103, 5, "user", "tie."), (103, 5, "assistant", "tie.")]
    return rows + rows[:7]


@pytest.mark.parametrize("block, merged", [(1024, 8), (4, 2), (7, 3)])
def test_same_rows_as_sql(spark, tmp_path, monkeypatch, block, merged):
    monkeypatch.setattr(cr, "BLOCK", block)
    monkeypatch.setattr(cr, "MERGED", merged)
    frame(spark, odd_rows()).write.parquet(f"{tmp_path}/conversations.parquet")
    df = cr.op11_conversation_repair(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    found = con.execute(cr.OP11_SQL)
    assert [c[0] for c in found.description] == df.columns
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(found.fetchall(), key=repr)


def test_nothing_and_no_turns(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cr.Repair(none).summary().count() == 0
    assert cr.Repair(none).turns().count() == 0
    named = spark.createDataFrame([(4,), (4,), (None,)], "conv_id long")
    rows = cr.Repair(none, named=named).summary().collect()
    assert sorted((r["conv_id"] or 0, r["cost"], r["audit"], r["repaired_sha256"][:6]) for r in rows) == [(0, 0, "", "e3b0c4"), (4, 0, "", "e3b0c4")]


def test_ids_of_another_type(spark):
    df = spark.createDataFrame([("a", 1, "user", "Hi."), ("a", 2, "assistant", "Oh."), (None, 1, "user", "Hi.")], "conv_id string, turn int, role string, text string")
    assert {r["conv_id"]: r["audit"] for r in cr.Repair(df).summary().collect()} == {"a": "KK", None: "KI"}


def test_damage(spark):
    rows = {(r["turn"], r["role"], r["text"]) for r in cr.damage(frame(spark, [(1, t, "assistant", "A. b? c!") for t in range(40)])).collect()}
    assert {x[2] for x in rows} == {"A. b? c!", "A b c", ""}
    assert {x[1] for x in rows} == {"assistant", "user"}
