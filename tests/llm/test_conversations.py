"""Conversation repair against plain versions."""

import random
import time
from collections import Counter

import brute
from pyspark.sql import functions as F

from brightrow.llm import conversations

TURNS = "conv_id long, turn long, role string, text string"
EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def decoded(rows, found):
    decoder = conversations.Decoder()
    for (_, role, text), fault in zip(rows, found):
        if fault in ("blank", "duplicate"):
            decoder.delete()
        else:
            decoder.feed(role, text, fault == "truncated")
    return decoder.finish()


def plain(rows, repair):
    _, _, _, _, _, cost, audit, digest = brute.conversation(rows, repair)
    return cost, audit, digest


def random_rows(rng, size):
    roles = ["user", "assistant", "system", "user", "assistant", "s", "tool", "", " "]
    texts = ["One.", "Two?", "open end", "", " \n", "Three!  ", "more\n", "again."]
    return [(i, rng.choice(roles), rng.choice(texts)) for i in range(size)]


def test_all_ways_to_edit():
    rng = random.Random(3)
    for _ in range(120):
        rows = random_rows(rng, rng.randint(0, 3))
        found = brute.faults(rows)
        want = plain(rows, brute.repair_all_ways)
        assert decoded(rows, found) == want, rows
        assert plain(rows, brute.repair_by_whole_strings) == want, rows


def test_long_conversations_equal_whole_strings():
    rng = random.Random(4)
    cases = [random_rows(rng, rng.randint(4, 60)) for _ in range(400)]
    cases += [[(i, role, f"{i}.") for i in range(n)] for role in ("user", "assistant", "system", "x") for n in (1, 2, 7, 40)]
    cases += [[(i, rng.choice(("user", "assistant")), f"{i}" + rng.choice((".", ""))) for i in range(80)] for _ in range(100)]
    for rows in cases:
        assert decoded(rows, brute.faults(rows)) == plain(rows, brute.repair_by_whole_strings), rows


def test_open_edits_stay_few_and_time_linear():
    """Two chains of edits that never meet hold letters only; deletions add no branches."""
    seconds = []
    for size in (20_000, 200_000):
        decoder, begin = conversations.Decoder(), time.perf_counter()
        for i in range(size):
            if i % 3:
                decoder.feed("user", f"{i}.", False)
            else:
                decoder.delete()
        runs = {id(s.run) for s in decoder.survivors.values()}
        depth = max(_depth(s.run) for s in decoder.survivors.values())
        assert len(runs) <= 4 and depth <= 5
        cost, audit, _ = decoder.finish()
        assert len(audit.replace("I", "")) == size
        seconds.append(time.perf_counter() - begin)
    assert seconds[1] < 30 * seconds[0]
    usual = conversations.Decoder()
    for i in range(1_000):
        usual.feed("user" if i % 2 == 0 else "assistant", f"{i}.", False)
    assert len(usual.final) > 900


def _depth(run):
    n = 0
    while run is not None:
        run, n = run.parent, n + 1
    return n


def test_damage_and_report(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [
        (9001, None, "user", "No turn."),
        (9001, None, "assistant", None),
        (9001, None, None, "No role."),
        (9001, 3, "user", "x" * 200_000),
        (9002, None, None, None),
        (None, None, "user", "Nothing known."),
        (None, 1, "assistant", "Nothing known."),
        *[(9003, t, "user", "The same.") for t in range(40)],
        *[(9004, 5, "user", "One turn.")] * 3,
        (9004, 5, "assistant", "One turn."),
        *[(9005 + i, t, "system", "Sys.\n") for i in range(40) for t in range(i % 3 + 1)],
    ]
    df = spark.createDataFrame(rows, TURNS).repartition(4)
    for clash in ("TEXT", "_fault", "dropped", "gaps", "cost"):
        df = df.withColumn(clash, F.lit(1)) if clash != "TEXT" else df.select("*", F.lit(1).alias("TEXT"))
    want = [
        (name, *brute.conversation(mine, brute.repair_by_whole_strings)) for name, mine in brute.damaged(rows).items()
    ]
    got = [tuple(r) for r in conversations.repair_report(conversations.damage(df)).collect()]
    assert Counter(map(str, got)) == Counter(map(str, want))
    gone = [r for r in got if r[1:] == (0, 0, 0, 0, 0, 0, "", EMPTY)]
    assert gone and all(not brute.damaged(rows)[r[0]] for r in gone)


def test_report_without_damage(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 0, "user", "Alone?"), (2, 4, None, None)]
    got = {r["conv_id"]: r for r in conversations.repair_report(spark.createDataFrame(rows, TURNS)).collect()}
    assert (got[1]["audit"], got[1]["cost"]) == ("KK", 0)
    assert (got[2]["audit"], got[2]["cost"], got[2]["gaps"], got[2]["blank"]) == ("KDI", 5, 3, 1)
    empty = spark.createDataFrame([], TURNS)
    assert conversations.repair_report(conversations.damage(empty)).collect() == []


def test_one_shuffle(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi.")], TURNS)
    plan = conversations.repair_report(conversations.damage(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, plan
