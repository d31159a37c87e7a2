"""Word, log, click and activity queries."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from retinue.operators import counts
from retinue.plans.registry import query, table
from retinue.session import materialise, spread

WORDS_SQL = """
words AS (
  SELECT unnest(CASE WHEN length(line) > 0 AND rtrim(line, ' ') = '' THEN []
                     ELSE string_split(rtrim(line, ' '), ' ') END) AS word
  FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents))"""


def text_lines(documents):
    """``<value>``: one row per line of every text."""
    return documents.select(F.explode(F.split("text", "\n")).alias("value"))


@query("word_count", f"WITH {WORDS_SQL} SELECT word, count(*) AS cnt FROM words GROUP BY word")
def word_count(spark, sf_dir):
    return counts.word_count(text_lines(spread(table(spark, sf_dir, "documents").select("text"))))


@query("sort_by_key", "SELECT user_id, event_id, event_type FROM events ORDER BY user_id, event_id")
def sort_by_key(spark, sf_dir):
    return counts.sort_by_key(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


def log_line():
    """Access-log line of an event; an error leaves a line too short to have every field."""
    c = F.col
    whole = F.concat(
        F.lit("10.0.0."), c("user_id").cast("string"), F.lit(' - - [01/Jan/2024:00:00:00 +0000] "GET /item/'),
        c("event_id").cast("string"), F.lit(' HTTP/1.1" 200 512 "http://shop.example/'), c("event_type"),
        F.lit('" "Agent Browser/'), F.length("props").cast("string"), F.lit('"'),
    )
    short = F.concat(F.lit("10.0.0."), c("user_id").cast("string"), F.lit(" - - broken"))
    return F.when(c("event_type") == "error", short).otherwise(whole)


LOG_SQL = """
lines AS (
  SELECT CASE WHEN event_type = 'error' THEN '10.0.0.' || user_id || ' - - broken'
              ELSE '10.0.0.' || user_id || ' - - [01/Jan/2024:00:00:00 +0000] "GET /item/' || event_id
                   || ' HTTP/1.1" 200 512 "http://shop.example/' || event_type || '" "Agent Browser/'
                   || length(props) || '"' END AS line
  FROM events),
tokens AS (SELECT string_split(rtrim(line, ' '), ' ') AS t FROM lines),
fields AS (SELECT t[1] AS ip, t[11] AS page, t[-1] AS agent FROM tokens WHERE len(t) > 10)"""


def log_lines(spark, sf_dir):
    return table(spark, sf_dir, "events").select(log_line().alias("value"))


@query("log_ip_counts", f"WITH {LOG_SQL} SELECT count(*) AS cnt, ip AS key FROM fields GROUP BY ip")
def log_ip_counts(spark, sf_dir):
    return counts.ip_counts(log_lines(spark, sf_dir))


@query("log_page_counts", f"WITH {LOG_SQL} SELECT count(*) AS cnt, page AS key FROM fields GROUP BY page")
def log_page_counts(spark, sf_dir):
    return counts.page_counts(log_lines(spark, sf_dir))


@query("log_agent_counts", f"WITH {LOG_SQL} SELECT agent AS key, count(*) AS cnt FROM fields GROUP BY agent")
def log_agent_counts(spark, sf_dir):
    return counts.agent_counts(log_lines(spark, sf_dir))


LOG_COUNTS_SQL = f"""WITH {LOG_SQL}
SELECT 'ip' AS dimension, ip AS key, count(*) AS cnt FROM fields GROUP BY ip
UNION ALL SELECT 'page', page, count(*) FROM fields GROUP BY page
UNION ALL SELECT 'agent', agent, count(*) FROM fields GROUP BY agent
UNION ALL SELECT 'rejected', NULL, count(*) FROM tokens WHERE len(t) <= 10 HAVING count(*) > 0"""


@query("log_counts", LOG_COUNTS_SQL)
def log_counts(spark, sf_dir):
    return counts.log_counts(log_lines(spark, sf_dir))


def click_message():
    """JSON click message of an event; its count is the number in ``props``."""
    k = F.get_json_object("props", "$.k").cast("long")
    return F.to_json(
        F.struct(
            F.col("user_id").cast("string").alias("uid"),
            F.unix_millis(F.col("ts").cast("timestamp")).cast("string").alias("event_time"),
            F.lit("Android").alias("os_type"),
            k.alias("click_count"),
        )
    )


CLICKS_SQL = """SELECT CAST(user_id AS VARCHAR) AS uid, CAST(sum(CAST(props ->> '$.k' AS BIGINT)) AS BIGINT) AS clicks
FROM events GROUP BY user_id"""


@query("click_counts", CLICKS_SQL)
def click_counts(spark, sf_dir):
    messages = table(spark, sf_dir, "events").select(click_message().alias("value"))
    return counts.click_counts(counts.parse_clicks(messages))


def behaviour_line():
    """Tagged line of an event: views, applications and URL-encoded searches; others carry no tag."""
    user = F.concat(F.lit(f"t {counts.USER_TAG}u"), F.col("user_id").cast("string"), F.lit(","))
    item = F.length("props").cast("string")
    k = F.get_json_object("props", "$.k")
    tags = counts.ACTIVITY_TAGS
    return (
        F.when(F.col("event_type") == "view", F.concat(user, F.lit(tags["view"]), k))
        .when(F.col("event_type") == "purchase", F.concat(user, F.lit(tags["apply"]), k))
        .when(F.col("event_type") == "click", F.concat(user, F.lit(tags["search"]), F.lit("+term%20"), item, k, F.lit("+")))
        .otherwise(F.concat(user, F.lit("idle")))
    )


ACTIVITY_SQL = """
WITH seen AS (
  SELECT 'u' || user_id AS user, CASE event_type WHEN 'view' THEN 'view' WHEN 'purchase' THEN 'apply' ELSE 'search' END AS kind,
         CASE WHEN event_type = 'click' THEN 'term ' || length(props) || (props ->> '$.k') ELSE props ->> '$.k' END AS item,
         event_id AS pos
  FROM events WHERE event_type IN ('view', 'purchase', 'click')),
firsts AS (SELECT user, kind, item, min(pos) AS pos FROM seen GROUP BY ALL)"""

JSON_SQL = """
lists AS (
  SELECT user, string_agg(item, ',' ORDER BY pos) FILTER (WHERE kind = 'view') AS v,
         string_agg(item, ',' ORDER BY pos) FILTER (WHERE kind = 'apply') AS a,
         string_agg(item, ',' ORDER BY pos) FILTER (WHERE kind = 'search') AS s
  FROM firsts GROUP BY user)
SELECT user, CAST(0 AS BIGINT) AS part,
       '{' || concat_ws(',', '"view":"' || v || '"', '"apply":"' || a || '"', '"search":"' || s || '"') || '}' AS activity
FROM lists"""


def behaviour_lines(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), behaviour_line().alias("value"))


@query("user_activity", f"{ACTIVITY_SQL}, {JSON_SQL}")
def user_activity(spark, sf_dir):
    return counts.user_activity(behaviour_lines(spark, sf_dir))


@query("activity_first_seen", f'{ACTIVITY_SQL} SELECT "user", kind, item, pos FROM firsts')
def activity_first_seen(spark, sf_dir):
    return counts.first_seen(counts.activity_events(behaviour_lines(spark, sf_dir)))


def broken_click_message():
    """The message of :func:`click_message`; an error cuts it in half, and a signup carries no user."""
    whole = click_message()
    cut = F.substring(whole, F.lit(1), F.floor(F.length(whole) / 2).cast("int"))
    nobody = F.regexp_replace(whole, '"uid":"[0-9]*",', "")
    return F.when(F.col("event_type") == "error", cut).when(F.col("event_type") == "signup", nobody).otherwise(whole)


BROKEN_CLICKS_SQL = """
SELECT uid, clicks FROM (
  SELECT CAST(user_id AS VARCHAR) AS uid, CAST(sum(CAST(props ->> '$.k' AS BIGINT)) AS BIGINT) AS clicks
  FROM events WHERE event_type NOT IN ('error', 'signup') GROUP BY user_id
  UNION ALL SELECT 'received', count(*) FROM events
  UNION ALL SELECT 'rejected', count(*) FROM events WHERE event_type IN ('error', 'signup'))"""


@query("click_counts_with_rejects", BROKEN_CLICKS_SQL)
def click_counts_with_rejects(spark, sf_dir):
    """Clicks per user, and what was received and rejected, from one pass over the messages."""
    messages = table(spark, sf_dir, "events").select(broken_click_message().alias("value"))
    seen = Observation()
    clicks = materialise(counts.click_counts(counts.parse_clicks(messages), rejects=seen), "clicks")
    return clicks.union(counts.reject_row(spark, seen).select(F.explode(F.create_map(F.lit("received"), "received", F.lit("rejected"), "rejected"))))


BROKEN_ACTIVITY_SQL = """
SELECT "user", kind, item, CAST(min(event_id) AS BIGINT) AS pos FROM (
  SELECT CASE WHEN event_id % 10 = 3 THEN '' ELSE 'u' || user_id END AS "user", 'search' AS kind,
         CASE WHEN event_id % 7 = 2 THEN NULL ELSE 'a b' || event_type END AS item, event_id
  FROM events)
WHERE "user" <> '' AND item IS NOT NULL GROUP BY ALL
UNION ALL SELECT NULL, 'received', NULL, count(*) FROM events
UNION ALL SELECT NULL, 'rejected', NULL, count(*) FROM events WHERE event_id % 10 = 3 OR event_id % 7 = 2"""


@query("activity_with_rejects", BROKEN_ACTIVITY_SQL)
def activity_with_rejects(spark, sf_dir):
    """First searches of every user; lines without a user and terms that cannot be decoded are counted beside them."""
    user = F.when(F.col("event_id") % 10 == 3, F.lit("")).otherwise(F.concat(F.lit(f"{counts.USER_TAG}u"), F.col("user_id").cast("string"), F.lit(",")))
    term = F.when(F.col("event_id") % 7 == 2, F.lit("%zz")).otherwise(F.concat(F.lit("a%20b"), "event_type"))
    line = F.concat(user, F.lit(counts.ACTIVITY_TAGS["search"]), term)
    lines = table(spark, sf_dir, "events").select(line.alias("value"), F.col("event_id").alias("pos"))
    seen = Observation()
    events = counts.activity_events(lines, rejects=seen)
    found = materialise(counts.first_seen(events).select("user", "kind", "item", "pos"), "activity")
    entries = F.explode(F.create_map(F.lit("received"), "received", F.lit("rejected"), "rejected")).alias("kind", "pos")
    totals = counts.reject_row(spark, seen).select(entries)
    none = F.lit(None).cast("string")
    return found.union(totals.select(none.alias("user"), "kind", none.alias("item"), "pos"))
