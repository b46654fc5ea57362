"""Commands applied in batch against commands applied one after the other."""

from __future__ import annotations

import random

from conftest import rows

from quarrylight.operators import commands

ROWS, LOG = "id int, name string, state string, search_runs int, retry_at string", "seq int, id int, op string, fields map<string,string>"


def test_batch_is_the_sequence(spark):
    draw = random.Random(1)
    held = {i: [f"n{i}", "OLD", 3, "later"] for i in range(12)}
    log = []
    for seq in range(300):
        op = draw.choice(["EDIT"] * 12 + ["SEARCH_NOW", "RETRY", "DELETE", "UNKNOWN"])
        fields = {c: draw.choice(["x", "y", None]) for c in draw.sample(["name", "state", "nowhere", "id"], draw.randrange(0, 3))}
        # half of the log is about one row
        log.append((seq, draw.choice([0] * 10 + list(range(1, 16))) if op != "DELETE" else draw.randrange(1, 16), op, fields if op == "EDIT" else None))
    df, told = spark.createDataFrame([(i, *v) for i, v in held.items()], ROWS), spark.createDataFrame(log, LOG).repartition(4)
    names, state, outcome = ["name", "state", "search_runs", "retry_at"], {i: dict(zip(("name", "state", "search_runs", "retry_at"), v, strict=True)) for i, v in held.items()}, {}
    for seq, i, op, fields in log:
        outcome[seq] = "APPLIED" if i in state else "MISSING"
        if i not in state:
            continue
        if op == "EDIT":
            state[i].update({c: v for c, v in fields.items() if c in names})
        elif op == "SEARCH_NOW":
            state[i].update(search_runs=0, state="NEW")
        elif op == "RETRY":
            state[i]["retry_at"] = None
        elif op == "DELETE":
            del state[i]
    got = {r.id: r.asDict() for r in commands.apply_commands(df, told, "id").collect()}
    assert got == {i: {"id": i} | v for i, v in state.items()} and len(got) < 12
    assert dict(rows(commands.outcomes(df, told, "id"), "seq", "outcome")) == outcome
    children = spark.createDataFrame([(1, i) for i in range(12)], "x int, parent int")
    assert {r.parent for r in commands.cascade(children, told, "parent").collect()} == set(state)
    assert rows(commands.apply_commands(df, told.limit(0), "id")) == rows(df)
