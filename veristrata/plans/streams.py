"""Queries: batch forms of the transcript and event operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from veristrata.operators import transcripts as X
from veristrata.operators.metrics import r6
from veristrata.sources.tables import read


def _turns(spark, d):
    return read(spark, d, "conversations")


def _timed(spark, d):
    return X.replay_times(_turns(spark, d), "conv_id", "turn", "text")


def replay_times(spark, d):
    return _timed(spark, d).select("conv_id", "turn", r6("start").alias("start"), r6("end").alias("end"))


def speaker_context(spark, d):
    rows = _timed(spark, d).select(F.col("conv_id").alias("session"), F.col("turn").alias("id"), F.col("role").alias("speaker"), r6("start").alias("start"), r6("end").alias("end"), F.lit(True).alias("final"))
    return X.speaker_context(rows).select("session", "id", F.array_join(F.transform("preceding", lambda x: x.cast("string")), ",").alias("preceding"))


def word_budget(spark, d):
    return X.word_budget(_turns(spark, d), "conv_id", "turn", "text").select("conv_id", "turn", "context")


def latest_revisions(spark, d):
    events = read(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return X.latest_revisions(events, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


def _events(spark, d):
    return read(spark, d, "events").withColumn("seconds", F.unix_timestamp(F.col("ts").cast("timestamp")))


def click_window(spark, d):
    e = _events(spark, d)
    clicks = e.where("event_type = 'purchase'").select(F.col("user_id").alias("key"), F.col("event_id").alias("click_id"), F.col("seconds").alias("at"))
    cues = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("cue_id"), F.col("seconds").alias("end"))
    return X.click_window(clicks, cues, 1800).groupBy("key", "click_id").agg(F.count("*").alias("n_cues"))


def stale_clicks(spark, d):
    e = _events(spark, d)
    clicks = e.where("event_type = 'purchase'").select(F.col("user_id").alias("key"), F.col("event_id").alias("click_id"), F.col("seconds").alias("at"))
    cues = e.where("event_type <> 'purchase'").select(F.col("user_id").alias("key"), F.col("seconds").alias("end"))
    return X.stale_clicks(clicks, cues, 3600)


def recent_worthy(spark, d):
    return X.most_recent_worthy(_turns(spark, d), "conv_id", "turn", F.length("text") % 2 == 0).select("conv_id", "turn", "worthy")


QUERIES = {
    "n08_replay_times": replay_times,
    "n05_speaker_context": speaker_context,
    "e20_word_budget": word_budget,
    "n01_latest_revisions": latest_revisions,
    "n07_click_window": click_window,
    "n07_stale_clicks": stale_clicks,
    "e12_recent_worthy": recent_worthy,
}

_T = """t AS (SELECT conv_id, turn, role, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n FROM conversations),
m AS (SELECT conv_id, turn, role, round(sum(n) OVER w * 60 / 150, 6) AS end_, round(sum(n) OVER w * 60 / 150 - n * 60 / 150, 6) AS start_ FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""

ORACLES = {
    "n08_replay_times": f'WITH {_T} SELECT conv_id, turn, start_ AS "start", end_ AS "end" FROM m',
    "n05_speaker_context": f"""WITH {_T}, p AS (SELECT a.conv_id, a.turn, b.turn AS prev, row_number() OVER (PARTITION BY a.conv_id, a.turn ORDER BY b.end_ DESC, b.start_ DESC, b.turn DESC) AS k
 FROM m a JOIN m b ON a.conv_id = b.conv_id AND a.role = b.role AND b.end_ <= a.start_ AND b.start_ < a.start_),
g AS (SELECT conv_id, turn, string_agg(CAST(prev AS VARCHAR), ',' ORDER BY k DESC) AS s FROM p WHERE k <= 2 GROUP BY 1, 2)
SELECT m.conv_id AS session, m.turn AS id, coalesce(s, '') AS preceding FROM m LEFT JOIN g USING (conv_id, turn)""",
    "e20_word_budget": """WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w FROM conversations),
h AS (SELECT conv_id, turn, flatten(list(w) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS h FROM t)
SELECT conv_id, turn, coalesce(array_to_string(list_slice(h, greatest(len(h) - 47, 1), len(h)), ' '), '') AS context FROM h""",
    "n01_latest_revisions": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
    "n07_click_window": """WITH e AS (SELECT user_id, event_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)
SELECT c.user_id AS key, c.event_id AS click_id, count(*) AS n_cues FROM e c JOIN e q ON c.user_id = q.user_id AND q.s <= c.s AND q.s > c.s - 1800 WHERE c.event_type = 'purchase' GROUP BY 1, 2""",
    "n07_stale_clicks": """WITH e AS (SELECT user_id, event_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events),
l AS (SELECT c.user_id AS key, c.event_id AS click_id, c.s, max(q.s) AS last FROM e c LEFT JOIN e q ON c.user_id = q.user_id AND q.s <= c.s AND q.event_type <> 'purchase' WHERE c.event_type = 'purchase' GROUP BY ALL)
SELECT key, click_id FROM l WHERE last IS NULL OR last < s - 3600""",
    "e12_recent_worthy": """WITH t AS (SELECT conv_id, turn, length(text) % 2 = 0 AS worthy FROM conversations),
m AS (SELECT *, coalesce(sum(CAST(worthy AS INT)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS met FROM t) SELECT conv_id, turn, worthy FROM m WHERE met < 3""",
}
