import json

import pytest
from pyspark.sql import functions as F

from retinue.functions.logs import log_fields
from retinue.functions.strings import file_name, split_tokens
from retinue.operators import counts as C

LINE = '1.2.3.4 - - [10/Oct/2000:13:55:36 -0700] "GET /a HTTP/1.0" 200 2326 "http://ref/" "Mozilla/5.0 (X11) Gecko"'


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


@pytest.mark.parametrize(
    "text, tokens",
    [("a b", ["a", "b"]), ("", [""]), ("  ", []), (" a  b  ", ["", "a", "", "b"]), ("a", ["a"]), (" a", ["", "a"])],
)
def test_split_on_spaces(spark, text, tokens):
    assert texts(spark, text).select(split_tokens(F.col("value"))).first()[0] == tokens


def test_split_on_another_separator(spark):
    got = [r[0] for r in texts(spark, "a#b##", "##", "#a").select(split_tokens(F.col("value"), "#")).collect()]
    assert got == [["a", "b"], [], ["", "a"]]


def test_file_name(spark):
    rows = texts(spark, "hdfs://h/a/b.JPEG", "b.png").select(file_name(F.col("value"))).collect()
    assert [r[0] for r in rows] == ["b.JPEG", "b.png"]


def test_word_count_is_sorted(spark):
    got = [tuple(r) for r in C.word_count(texts(spark, "b a b", "a c")).collect()]
    assert got == [("a", 2), ("b", 2), ("c", 1)]


def test_log_fields(spark):
    row = texts(spark, LINE).select(log_fields(F.col("value")).alias("f")).select("f.*").first()
    assert tuple(row) == ("1.2.3.4", '"http://ref/"', 'Gecko"')


def test_short_lines_are_counted_not_fatal(spark):
    lines = texts(spark, LINE, LINE, "too short", "")
    got = {(r.dimension, r.key): r.cnt for r in C.log_counts(lines).collect()}
    assert got == {
        ("ip", "1.2.3.4"): 2, ("page", '"http://ref/"'): 2, ("agent", 'Gecko"'): 2, ("rejected", None): 2,
    }
    assert C.ip_counts(lines).collect()[0].asDict() == {"cnt": 2, "key": "1.2.3.4"}


def test_keys_with_equal_counts_both_stay(spark):
    rows = texts(spark, "x", "y", "y", "z")
    assert [tuple(r) for r in C.counts_by_count(rows, "value").collect()] == [(1, "x"), (1, "z"), (2, "y")]


def test_clicks_are_summed_per_user(spark):
    def event(uid, n):
        return json.dumps({"uid": uid, "event_time": "1", "os_type": "Android", "click_count": n})

    clicks = C.click_counts(C.parse_clicks(texts(spark, event("u", 3), event("v", 0), event("u", 4), "no json")))
    assert {r.uid: r.clicks for r in clicks.collect()} == {"u": 7, "v": 0}


def behaviour(spark, *items):
    rows = [(i, f"x {C.USER_TAG}{user},{C.ACTIVITY_TAGS[kind]}{item}") for i, (user, kind, item) in enumerate(items)]
    return spark.createDataFrame(rows + [(99, "no tag at all")], "pos long, value string")


def test_user_activity(spark):
    lines = behaviour(
        spark, ("ann", "view", "12"), ("ann", "view", "1"), ("ann", "view", "12"), ("bob", "apply", "7"),
        ("ann", "search", "%20caf%C3%A9+au+lait+"), ("ann", "search", "caf%C3%A9+au+lait"),
    )
    got = {(r.user, r.part): json.loads(r.activity) for r in C.user_activity(lines).collect()}
    assert got == {("ann", 0): {"view": "12,1", "search": "café au lait"}, ("bob", 0): {"apply": "7"}}


def test_users_are_split_into_stretches_of_positions(spark):
    items = [("hot", "view", str(i % 20)) for i in range(40)] + [("cold", "view", "1"), ("cold", "view", "2")]
    got = {}
    for row in C.user_activity(behaviour(spark, *items), part_rows=8).collect():
        got.setdefault(row.user, []).append((row.part, json.loads(row.activity)["view"]))
    assert got["cold"] == [(5, "1,2")]
    assert len(got["hot"]) == 3
    assert ",".join(v for _, v in sorted(got["hot"])) == ",".join(map(str, range(20)))
    assert all(len(v.split(",")) <= 8 for _, v in got["hot"])
