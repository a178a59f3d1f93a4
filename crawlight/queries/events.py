"""Batch twins of the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlight.queries.registry import Area
from crawlight.sources.tables import table
from crawlight.streaming import events as E

area = Area()
q = area.query


def events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(df):
    return df.withColumn("start", F.date_format(F.col("start").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@q("s01_error_rate", "select strftime(date_trunc('hour', ts)::timestamp, '%Y-%m-%d %H:%M:%S.%f') as start, count(*) as events, count(*) filter (event_type = 'error') as errors from events group by 1")
def s01(spark, d):
    return _plain(E.error_rate(events(spark, d)))


@q("s02_sliding_availability", "with k as (select date_trunc('hour', ts) - to_hours(i::int) as start, event_type from events, range(6) t(i)) select strftime(start::timestamp, '%Y-%m-%d %H:%M:%S.%f') as start, count(*) as events, count(*) filter (event_type = 'error') as errors from k group by 1")
def s02(spark, d):
    return _plain(E.error_rate(events(spark, d), "6 hours", "1 hour"))


@q("s03_sessions", "with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as session from g) select user_id, strftime(min(ts)::timestamp, '%Y-%m-%d %H:%M:%S.%f') as start, count(*) as events from s group by user_id, session")
def s03(spark, d):
    return _plain(E.sessions(events(spark, d)))


@q("s04_first_seen", f"select user_id, event_type, event_id from events qualify coalesce(event_id - lag(event_id) over (partition by user_id, event_type order by event_id) > {E.FORGOTTEN}, true)")
def s04(spark, d):
    """First sights from a stream run to its end; a user and type not seen for a while are new again."""
    return E.to_the_end(spark, E.first_sights(E.stream(spark, E.arrivals(spark, table(spark, d, "events")))))


@q("s05_price_alerts", f"""with p as (select user_id % 20 as key, floor(value)::bigint as price, event_id from events where event_type = 'purchase' and value is not null),
b as (select *, sum(new) over (partition by key order by event_id) as life from (select *, case when event_id - lag(event_id) over (partition by key order by event_id) <= {E.FORGOTTEN} then 0 else 1 end as new from p)),
r as (select key, event_id, price, min(price) over w as low, max(price) over w as high from b window w as (partition by key, life order by event_id rows between unbounded preceding and 1 preceding))
select key, event_id, least(low, price) as low, greatest(high, price) as high from r where low is not null and not price between low and high""")
def s05_alerts(spark, d):
    """Alerts from a stream run to its end, with state by key that timers drop."""
    return E.to_the_end(spark, E.widening_prices(E.stream(spark, E.arrivals(spark, table(spark, d, "events")))))


@q("s05_price_range", "select user_id % 20 as key, floor(min(value))::bigint as low, floor(max(value))::bigint as high from events where event_type = 'purchase' group by 1")
def s05(spark, d):
    """What the alerts of a whole stream end in."""
    p = table(spark, d, "events").where("event_type = 'purchase'")
    return p.groupBy(F.pmod("user_id", F.lit(20)).alias("key")).agg(F.floor(F.min("value")).alias("low"), F.floor(F.max("value")).alias("high"))


#: Parts that the events arrive in, by number; how far a row may be behind the latest one of the parts before.
PARTS, DELAY = 64, "1 day"


@q("s06_late_events", f"with n as (select max(event_id) + 1 as n from events), p as (select *, event_id * {PARTS} // n as part from events, n), m as (select part, max(ts) as latest from p group by part), w as (select part, max(latest) over (order by part rows between unbounded preceding and 1 preceding) - interval {DELAY} as mark from m) select event_type, count(*) as events, count(*) filter (ts < mark) as late from p join w using (part) group by event_type")
def s06(spark, d):
    """Rows that come behind the watermark: the latest time of the parts before their own, less the delay."""
    return E.late_events(events(spark, d), PARTS, DELAY).groupBy("event_type").agg(F.count("*").alias("events"), F.count_if(F.col("late")).alias("late"))


QUERIES, SQL = area.queries, area.sql
