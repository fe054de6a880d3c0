"""Timelines around an answer, and facts by words, on small tables."""

import datetime

from corvidex.operators import facts, fts, sessions

ROWS = [(1, 10, "a", "red apple"), (2, 20, "a", "green pear red"), (3, 20, "b", "red pear apple tree"), (4, 30, "a", None), (5, 5, "b", "apple apple apple"), (6, 40, "b", "plum"), (7, 50, None, "fig"), (8, 60, None, "date")]


def line(spark, query, group=None, before=1, after=2):
    rows = spark.createDataFrame(ROWS, "id int, ts int, g string, body string").repartition(3)
    return sorted((r["pos"], r["id"]) for r in sessions.timeline(rows, "id", "ts", "body", query, before, after, group).collect())


def test_all_words_come_before_any(spark):
    assert line(spark, "apple pear") == [(-1, 2), (0, 3), (1, 4), (2, 6)]  # 5 scores more for apple, 3 has both
    assert line(spark, "apple pear", "g") == [(-1, 5), (0, 3), (1, 6)]
    assert line(spark, "apple fig")[1] in ((0, 5), (0, 7))


def test_groups_that_are_null_and_questions_that_find_nothing(spark):
    assert line(spark, "fig", "g") == [(0, 7), (1, 8)]
    assert line(spark, "nothing", "g") == line(spark, "") == line(spark, "?!") == []
    empty = spark.createDataFrame([], "id int, ts int, g string, body string")
    assert sessions.timeline(empty, "id", "ts", "body", "apple").count() == 0


def test_facts_by_words(spark):
    day = datetime.date(2024, 1, 1)
    rows = spark.createDataFrame([(1, "parsers failing on tabs", day, None), (2, "failed parser", day, day), (3, "deploys", None, None)], "id int, text string, valid_at date, invalid_at date")
    index = fts.build(rows, "id", {"text": 1.0}, stemmed=True)
    got = facts.by_words(rows, index, ["fail", "parsing"], 5).collect()
    assert {(r["id"], r["valid_at"], r["invalid_at"]) for r in got} == {(1, day, None), (2, day, day)}
    assert [r["id"] for r in facts.by_words(rows.where("id <> 2"), index, ["fail"], 1).collect()] == [1]
    assert facts.by_words(rows, index, [], 5).count() == 0
