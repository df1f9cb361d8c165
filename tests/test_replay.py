"""Replay of rejected records: bounded passes, each over what still fails."""

from pyspark.sql import functions as F

from slipway.operators.accounting import replay


def rejects(spark, rows):
    return spark.createDataFrame(rows, "id BIGINT, attempts BIGINT, need BIGINT")


def passes_from_need(seen):
    def transform(again):
        seen.append(sorted((r.id, r.attempts) for r in again.collect()))
        return again.withColumn("error_kind", F.when(F.col("attempts") < F.col("need"), "invalid"))

    return transform


def ids(df):
    return sorted((r.id, r.attempts) for r in df.collect())


def test_replay_recovers_or_gives_up(spark):
    seen = []
    ok, given_up = replay(rejects(spark, [(1, 0, 1), (2, 0, 3), (3, 0, 9), (4, 2, 3), (5, 2, 9), (6, 3, 0), (7, 5, 0)]),
                          passes_from_need(seen))
    assert ids(ok) == [(1, 1), (2, 3), (4, 3)]
    assert ids(given_up) == [(3, 3), (5, 3), (6, 3), (7, 5)]  # used up before: never run
    assert seen == [[(1, 1), (2, 1), (3, 1), (4, 3), (5, 3)], [(2, 2), (3, 2)], [(2, 3), (3, 3)]]


def test_replay_stops_when_nothing_fails(spark):
    seen = []
    ok, given_up = replay(rejects(spark, [(1, 0, 0), (2, 1, 0)]), passes_from_need(seen))
    assert len(seen) == 1 and ids(ok) == [(1, 1), (2, 2)] and ids(given_up) == []


def test_replay_of_nothing(spark):
    ok, given_up = replay(rejects(spark, []), passes_from_need([]))
    assert ok.count() == given_up.count() == 0
