import duckdb

from tests.llm import samples
from veriflate.llm import mixing as M


def oracle(pairs_df):
    con = duckdb.connect()
    con.register("documents", pairs_df)
    return con.execute(M.OP10_SQL).fetchall()


def check(spark, pairs):
    df = samples.frame(spark, pairs)
    out = M.taken(df).collect()
    want = oracle(df.toArrow())
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted((tuple(r) for r in out), key=key)
    want = sorted(want, key=key)
    assert [(*r[:3], *r[4:]) for r in got] == [(*r[:3], *r[4:]) for r in want]
    assert all(abs(a[3] - b[3]) < 1e-6 for a, b in zip(got, want, strict=True))
    assert all(r.taken <= 2 * r.size for r in out)
    return df, out


def test_targets_are_met(spark):
    pairs = samples.odd() + [(None, "x y z"), (None, "x y z")] * 20 + samples.texts(6, 400)
    df, out = check(spark, pairs)
    per = {}
    for r in out:
        size, target, got = per.get(r.source_size, (r.source_size, r.target, 0))
        per[r.source_size] = (size, target, got + r.taken)
    assert all(t - 1 < got <= t for _, t, got in per.values())
    assert sorted(map(tuple, M.taken(df).collect()), key=str) == sorted(map(tuple, out), key=str)


def test_schedule_spreads_sources(spark):
    pairs = [(i, " ".join(["w"] * 900)) for i in range(12, 200)]
    _, pieces = M.schedule(samples.frame(spark, pairs))
    rows = pieces.select("slot", "sid", "start", "from", "to").collect()
    assert len({r.slot for r in rows}) > 100
    first = [r.sid for r in sorted(rows, key=lambda r: r.slot)][:20]
    assert len(set(first)) > 1
    # The points of a source are spread: no source waits for long between its slots.
    for sid, share in ((0, 0.6), (1, 0.3)):
        own = sorted({r.slot for r in rows if r.sid == sid})
        gaps = [b - a for a, b in zip(own, own[1:], strict=False)]
        assert max(gaps) <= 6 / share * max(1, max(r.slot for r in rows) / len({r.slot for r in rows}))


def test_long_schedules_are_made_in_steps(spark):
    # 2^30 blocks of two sources: only the plan's rows before the last step are made.
    sources = spark.createDataFrame([(0, 1 << 29, 0), (1, 1 << 29, 1 << 29)], "sid int, quota long, first long")
    slots = M._slots(sources, 1024, 1 << 30)
    plan = slots._jdf.queryExecution().optimizedPlan().toString()
    # Twice over: the running sums read the slots twice.
    assert plan.count("explode(sequence") == 4
    few = M._slots(spark.createDataFrame([(0, 9_000, 0), (1, 5_000, 9_000)], "sid int, quota long, first long"), 1024, 14_000)
    assert {(r.sid, r.n) for r in few.groupBy("sid").agg(M.F.countDistinct("rank").alias("n")).collect()} == {(0, 9_000), (1, 5_000)}


def test_nothing_to_mix(spark):
    assert M.taken(samples.frame(spark, [])).count() == 0
    out = M.taken(samples.frame(spark, [(1, None), (2, " ")])).collect()
    assert [(r.size, r.target, r.taken) for r in out] == [(0, 0.0, 0)] * 2


def test_mixed_rows(spark):
    pairs = [(None, "no id")] + samples.texts(6, 200)
    df = samples.frame(spark, pairs)
    out = M.mixed(df)
    assert out.columns == df.columns
    counts = {}
    for r in out.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert set(counts.values()) <= {1, 2}
    taken = {r.doc_id: r for r in M.taken(df).collect()}
    assert all(taken[i].taken > 0 for i in counts)
    words = sum(taken[i].size * n for i, n in counts.items())
    assert abs(words / sum(t.taken for t in taken.values()) - 1) < 0.1
    order = [r.doc_id for r in M.mixed(df).collect()]
    firsts = {}
    for at, i in enumerate(order):
        firsts.setdefault(i, at)
    # Blocks hold many of these short documents, and a document can come for its second round first.
    slots = [taken[i].first_slot for i in sorted(firsts, key=firsts.get)]
    assert sum(a <= b for a, b in zip(slots, slots[1:], strict=False)) > 0.7 * len(slots)


def test_mixed_keeps_columns_with_like_names(spark):
    df = samples.frame(spark, samples.texts(6, 30)).withColumn("_id", M.F.lit(7)).withColumn("_copy", M.F.lit("c")).withColumn("_slot", M.F.lit(1.5))
    out = M.mixed(df).collect()
    assert out and {(r._id, r._copy, r._slot) for r in out} == {(7, "c", 1.5)}


def test_plan_has_no_python(spark):
    plan = M.taken(samples.frame(spark, [(1, "x y")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
