"""State carried over batches: any split of the input, with repeats after a crash, gives the result of one batch."""

import numpy as np
import pytest

from quarry.streaming import state as S

SCHEMA = "k string, at int, x int, note string"


def made(seed, n=120):
    draw = np.random.default_rng(seed)
    keys = [None, "a", "b", "c", "d"]
    return [(keys[draw.integers(0, 5)], int(draw.integers(0, 9)), None if draw.random() < 0.2 else int(draw.integers(-50, 50)), f"n{draw.integers(0, 30)}") for _ in range(n)]


def rows(df):
    return sorted((tuple(f"{v:.9g}" if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


STATES = {"figures": S.figures(["k"], ["x", "at"]), "last_wins": S.last_wins(["k"], "at")}


@pytest.mark.parametrize("name", STATES)
def test_any_split_gives_the_same(spark, tmp_path, name):
    state, every = STATES[name], made(1)
    frame = lambda part: spark.createDataFrame(part, SCHEMA)
    expected = rows(state.finish(state.partial(frame(every))))
    for trial, cuts in enumerate(([0, 120], [0, 3, 3, 50, 51, 90, 120])):
        target = str(tmp_path / f"state{trial}")
        assert S.results(spark, target, state) is None
        for number, (a, b) in enumerate(zip(cuts, cuts[1:])):
            S.take(frame(every[a:b]), number, target, state, every=3)
            if number % 2:
                S.take(frame(every[a:b]), number, target, state, every=3)  # again, as after a crash
        assert rows(S.results(spark, target, state)) == expected


def test_figures_by_hand(spark):
    state = S.figures(["k"], ["x"])
    df = spark.createDataFrame([("a", 1, 2, ""), ("a", 1, 4, ""), ("a", 1, None, ""), ("b", 1, None, ""), ("c", 1, 5, "")], SCHEMA)
    got = {r.k: r for r in state.finish(state.partial(df)).collect()}
    assert (got["a"].n, got["a"].x_n, got["a"].x_sum, got["a"].x_min, got["a"].x_max, got["a"].x_mean) == (3, 2, 6, 2, 4, 3)
    assert got["a"].x_std == pytest.approx(2**0.5) and got["b"].x_mean is None and got["c"].x_std is None
    assert state.finish(state.partial(df.limit(0))).count() == 0


def test_last_row_by_hand(spark):
    df = spark.createDataFrame([("a", 1, 9, "old"), ("a", 2, 1, "new"), ("a", 2, 3, "new"), ("b", None, 1, "x"), (None, 1, 1, "y")], SCHEMA)
    got = {r.k: tuple(r) for r in S.last_wins(["k"], "at").partial(df).collect()}
    assert got == {"a": ("a", 2, 3, "new"), "b": ("b", None, 1, "x"), None: (None, 1, 1, "y")}


def test_a_broken_stream_goes_on(spark, tmp_path, monkeypatch):
    state, every = STATES["last_wins"], made(2, 60)
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for i in range(4):
        spark.createDataFrame(every[15 * i : 15 * i + 15], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    calls, take = [], S.take

    def breaking(df, number, *rest):
        take(df, number, *rest)
        calls.append(number)
        if len(calls) == 2:
            raise RuntimeError("the machine is gone")

    monkeypatch.setattr(S, "take", breaking)
    with pytest.raises(Exception):
        S.carried(stream(), target, checkpoint, state, every=2)
    S.carried(stream(), target, checkpoint, state, every=2)
    assert calls.count(1) == 2 and max(calls) == 3  # the batch that broke off came again
    expected = rows(state.partial(spark.createDataFrame(every, SCHEMA)))
    assert rows(S.results(spark, target, state)) == expected
    spark.createDataFrame([("a", 99, 0, "last")], SCHEMA).write.mode("append").parquet(source)
    S.carried(stream(), target, checkpoint, state, every=2)
    assert {r.k: r.note for r in S.results(spark, target, state).collect()}["a"] == "last"
