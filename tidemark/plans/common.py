"""What the query modules share: plain types for results, and the derivation of the logs as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint and decimals as double, so that another engine's types are the same."""
    out = []
    for f in df.schema:
        if isinstance(f.dataType, T.ByteType | T.ShortType | T.IntegerType):
            out.append(F.col(f.name).cast("bigint").alias(f.name))
        elif isinstance(f.dataType, T.DecimalType | T.FloatType):
            out.append(F.col(f.name).cast("double").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


#: The record log of sources.derived.
LOG = """
log AS (
  SELECT *, row_number() OVER (PARTITION BY topic_id, part ORDER BY event_id) - 1 AS off
  FROM (
    SELECT event_id, user_id, event_type, value, CASE WHEN user_id % 37 = 5 THEN 9 ELSE user_id % 3 + 1 END AS topic_id, user_id % 4 AS part,
           CAST(user_id AS VARCHAR) AS message_key, epoch_us(ts) // 1000 AS sent, CAST(floor(value * 20) AS BIGINT) AS delay
    FROM events
  )
)"""

#: Its audit records, in order of arrival `a`.
AUDIT = (
    LOG
    + """,
kinds AS (
  SELECT *, CASE WHEN event_type IN ('purchase', 'view') THEN 'C' WHEN event_type = 'click' THEN 'D' WHEN event_type = 'error' THEN 'F' END AS kind,
         CASE event_id % 4 WHEN 0 THEN 'stale_age' WHEN 1 THEN 'queue_overflow' WHEN 2 THEN 'replaced_by_newer_key_record' END AS why
  FROM log
),
rows_of AS (
  SELECT 'P' AS t, topic_id, part, off, sent AS kafka, sent + CASE WHEN event_id % 40 = 0 THEN 100000 ELSE 0 END AS seen, message_key, NULL AS why, event_id, 0 AS place FROM kinds WHERE event_id % 90 <> 0
  UNION ALL SELECT 'R', topic_id, part, off, NULL, sent + 1, message_key, NULL, event_id, 1 FROM kinds WHERE event_id % 30 = 0
  UNION ALL SELECT kind, topic_id, part, off, NULL, sent + delay, message_key, CASE WHEN kind = 'D' THEN why END, event_id, 2 FROM kinds WHERE kind IS NOT NULL
  UNION ALL SELECT 'C', topic_id, part, off, NULL, sent + delay + 5, message_key, NULL, event_id, 3 FROM kinds WHERE event_id % 50 = 0
  UNION ALL SELECT 'F', topic_id, part, off, NULL, sent + delay + 9, message_key, NULL, event_id, 4 FROM kinds WHERE event_id % 70 = 0
  UNION ALL SELECT 'P', topic_id, -1, -1, sent, sent, message_key, NULL, event_id, 5 FROM kinds WHERE event_id % 45 = 7
),
aud AS (SELECT *, row_number() OVER (ORDER BY seen, event_id, place) AS a FROM rows_of)"""
)

#: One row a key: first arrivals and which outcomes were open when it closed.
LIFE = (
    AUDIT
    + """,
firsts AS (
  SELECT topic_id, part, off,
         count(*) FILTER (t = 'P') AS n_p, count(*) FILTER (t = 'C') AS n_c, count(*) FILTER (t = 'F') AS n_f, count(*) FILTER (t = 'D') AS n_d,
         min(a) FILTER (t = 'P') AS a_p, min(a) FILTER (t = 'C') AS a_c, min(a) FILTER (t = 'F') AS a_f, min(a) FILTER (t = 'D') AS a_d
  FROM aud WHERE part >= 0 AND off >= 0 GROUP BY ALL
),
outcomes AS (
  SELECT topic_id, part, off, a_p, t, a, row_number() OVER (PARTITION BY topic_id, part, off ORDER BY a) AS place,
         count(*) OVER (PARTITION BY topic_id, part, off) AS n,
         count(*) FILTER (a < a_p) OVER (PARTITION BY topic_id, part, off) AS early
  FROM (
    SELECT topic_id, part, off, a_p, 'C' AS t, a_c AS a FROM firsts WHERE a_c IS NOT NULL
    UNION ALL SELECT topic_id, part, off, a_p, 'F', a_f FROM firsts WHERE a_f IS NOT NULL
    UNION ALL SELECT topic_id, part, off, a_p, 'D', a_d FROM firsts WHERE a_d IS NOT NULL
  )
),
opened AS (
  SELECT o.*, CASE WHEN a_p IS NULL THEN n ELSE greatest(1, early) END AS k,
         o.place <= CASE WHEN a_p IS NULL THEN n ELSE greatest(1, early) END AS is_open,
         r.seen, r.message_key, r.why, p.kafka
  FROM outcomes o JOIN aud r ON r.a = o.a LEFT JOIN aud p ON p.a = o.a_p
)"""
)

#: The records of sources.derived.records().
RECORDS = (
    LOG
    + """,
rec AS (
  SELECT 'topic-' || topic_id AS topic, part AS "partition", off AS "offset", CASE WHEN user_id % 50 <> 0 THEN message_key END AS key,
         CASE WHEN event_id % 25 <> 0 THEN event_type END AS val, sent AS timestamp_ms, event_id AS arrival, event_id // 500 AS win,
         max(sent) OVER (PARTITION BY event_id // 500) AS now_ms, delay,
         CASE WHEN user_id % 50 <> 0 THEN 'k:' || message_key ELSE 'null' END AS lane
  FROM log
)"""
)

