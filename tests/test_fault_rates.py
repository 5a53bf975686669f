"""Every injected audio fault is caught on the given tables, and no control is empty."""

from pyspark.sql import functions as F

from plumbline.operators import checks as ck
from plumbline.plans import registry


def test_audio_faults(spark):
    rows = registry.queries()["a17_detection_rate"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 6 and all(r["rate"] == 1.0 and r["clean_controls"] > 0 for r in rows), rows


def test_no_table_of_episodes_is_sent_whole_to_the_driver(spark, sf):
    found = registry.queries()["c14_detection_rate"](spark, sf)
    assert {r.check_id for r in found.collect()} == {check for _, check in ck.MUTATIONS}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_check_runs_on_its_own_corruption_only(spark, monkeypatch):
    asked = {}

    def check(name):
        def run(turns, episodes, papers):
            asked[name] = {r.episode_id for r in episodes.collect()}, {r.episode_id for r in turns.select("episode_id").collect()}
            return ck.result(episodes, turns.select("episode_id", F.col("turn_idx").alias("at"), F.col("text").alias("what")).limit(0), name, "error")
        return run

    monkeypatch.setattr(ck, "CHECK_OF", {name: check(name) for _, name in ck.MUTATIONS}, raising=False)
    turns = spark.createDataFrame([(1, i, "host", "Said so.") for i in range(4)], "episode_id long, turn_idx int, speaker string, text string")
    episodes = spark.createDataFrame([(1, 1, 2)], "episode_id long, paper_id long, minutes int")
    papers = spark.createDataFrame([(1, "Said so.")], "paper_id long, text string")
    assert ck.detection(turns, episodes, papers).filter("clean AND NOT detected").count() == len(ck.MUTATIONS)
    assert asked == {name: ({f"1|{k}", "1|control"},) * 2 for k, name in ck.MUTATIONS}


def test_result_counts_offences_of_the_episodes_asked_for(spark):
    episodes = spark.createDataFrame([(1,), (2,)], "episode_id long")
    offences = spark.createDataFrame([(1, 5, "b"), (1, 2, "a"), (3, 1, "c"), (None, 1, "d")], "episode_id long, at int, what string")
    assert sorted(map(tuple, ck.result(episodes, offences, "x", "error").collect())) == [(1, "x", False, "error", 2, "a"), (2, "x", True, "error", 0, None)]
