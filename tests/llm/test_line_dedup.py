import hashlib
import re

from conftest_llm import ODD, prose
from pyspark.sql import functions as F

from fluxgate.llm.common import Scratch
from fluxgate.llm.line_dedup import LevelledRuns, dedup_lines


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def brute(rows):
    holders = {}
    for d, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(-1 if d is None else d)
    out = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        own = -1 if d is None else d
        stay = [x for x in lines if len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == own]
        out.append((d, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=str)


def results(docs):
    return sorted((tuple(r) for r in dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256)).collect()), key=str)


def test_equals_brute_force(documents):
    shared = [prose(i, 8) for i in range(30)]
    rows = []
    for d in range(120):
        lines = [prose(1000 + d * 7 + i, 6) for i in range(d % 5)] + [shared[(d * 13 + i) % 30] for i in range(d % 4)] * (1 + d % 2)
        if d % 6 == 0:
            lines += ["\t " + shared[d % 30].upper() + " \r", "", "short"]
        rows.append((d, "\n".join(lines)))
    assert results(documents(rows + ODD + [(900, "\n\n"), (901, "É" * 20), (902, "é" * 20), (903, "É" * 20), (904, "É" * 20)], line="c", lost="d", k="e")) == brute(rows + ODD + [(900, "\n\n"), (901, "É" * 20), (902, "é" * 20), (903, "É" * 20), (904, "É" * 20)])


def test_empty(documents):
    assert results(documents([])) == []


def test_runs_compact_and_answer(spark):
    runs = LevelledRuns(Scratch(spark, "t"), fanout=2)
    for b in range(5):
        runs.add(spark.range(b * 10, b * 10 + 15).select(F.col("id").alias("h1"), F.xxhash64("id").alias("h2"), F.lit(b).cast("bigint").alias("doc_id")))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert runs.merged().count() == 55
    assert runs.merged().where("n_docs = 2").count() == 20
    # runs hold each hash once; what came again is in the updates
    held = [r.h1 for run in runs.runs() for r in runs.table(run).collect()]
    assert sorted(held) == list(range(55))
    assert sum(runs.table(u).count() for u in runs.updates) == 20
    new = spark.range(50, 60).select(F.col("id").alias("h1"), F.xxhash64("id").alias("h2"))
    assert sorted(r.h1 for r in runs.unseen(new).collect()) == [55, 56, 57, 58, 59]


def test_merge_anti_join_leaves_the_runs_in_place(spark):
    runs = LevelledRuns(Scratch(spark, "t"), fanout=4)
    for b in range(3):
        runs.add(spark.createDataFrame([(i, i * 7919, b + i % 2) for i in range(b * 10, b * 10 + 15)], "h1 long, h2 long, doc_id long"))
    with runs._planned():
        plan = runs.unseen(runs.table(runs.runs()[0]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and "Exchange" not in plan and "Sort [" not in plan
    runs.clear()


def test_long_document_of_common_lines(documents):
    lines = [f"common line number {i} of many" for i in range(20_000)]
    rows = [(d, "\n".join(lines)) for d in range(3)] + [(9, "\n".join(f"own line number {i} of many" for i in range(20_000))), (None, lines[0]), (None, "x" * 1_000_000), (10, "\n" * 200_000)]
    assert results(documents(rows)) == brute(rows)


def test_columns_that_clash(documents):
    rows = [(d, "a line that is common to all\nown " + str(d)) for d in range(3)]
    names = ("lost", "all_lines", "kept_lines", "line", "pos", "th", "k", "h1", "_lost", "_d", "batch")
    got = dedup_lines(documents(rows, **{n: n.upper() for n in names}, n_lines="old"))
    assert all(r[n] == n.upper() for r in got.collect() for n in names) and {r.n_lines for r in got.collect()} == {2}
