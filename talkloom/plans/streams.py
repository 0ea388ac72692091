"""What the streams of talkloom.streaming give, over whole tables: job feeds, partial updates, turns and stretches of speech."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.operators import changelog
from talkloom.plans import views as V
from talkloom.plans.catalog import query
from talkloom.streaming import ordered

#: A job is silent for six hours before it counts as gone; pieces of a turn are at most an hour apart.
SILENCE_MS, GAP_MS = 6 * 3_600_000, 3_600_000
_STATUS = "case event_type when 'purchase' then 'done' when 'error' then 'error' when 'signup' then 'queued' else 'running' end"


def job_events(spark, d) -> DataFrame:
    """Events as reports of jobs: (job, seq, at, status, stage, progress), a job for each user."""
    return V.table(spark, d, "events").selectExpr("user_id as job", "event_id as seq", "ts as at", f"{_STATUS} as status", "case when value < 150 then 'asr' else 'llm' end as stage", "cast(floor(value / 100) / 10 as double) as progress")


def speech_pieces(spark, d) -> DataFrame:
    """Events as pieces of speech: (media_id, seq, at, end_at, speaker, text); a piece lasts up to five hours."""
    e = V.table(spark, d, "events").selectExpr("user_id as media_id", "event_id as seq", "cast(ts as timestamp) as at", "value", "case when event_type in ('view', 'click', 'signup') then 'A' else 'B' end as speaker", "event_type as text")
    return e.withColumn("end_at", F.timestamp_micros(F.unix_micros("at") + F.floor(F.col("value") * 36_000).cast("long") * 1000)).drop("value")


_FEED = f"""with e as (select user_id as job, epoch_us(ts)::bigint as at_us, event_id as seq, {_STATUS} as status, case when value < 150 then 'asr' else 'llm' end as stage, round(floor(value / 100)::double / 10, 3) as progress from events),
 n as (select *, coalesce(at_us // 1000 - lag(at_us // 1000) over w > {SILENCE_MS}, true) as fresh from e window w as (partition by job order by at_us, seq)),
 l as (select *, sum(fresh::int) over (partition by job order by at_us, seq) as life from n),
 o as (select *, coalesce(bool_or(status in ('done', 'error')) over w, false) as ended, lag(status) over v as s0, lag(stage) over v as t0, lag(progress) over v as p0 from l
   window v as (partition by job, life order by at_us, seq), w as (partition by job, life order by at_us, seq rows between unbounded preceding and 1 preceding))"""


@query(_FEED + f""" select job, at_us, seq, status, stage, progress from o where not ended and (fresh or status <> s0 or stage <> t0 or progress <> p0)
 union all select job, (max(at_us // 1000) + {SILENCE_MS}) * 1000, null, 'gone', null, null from l group by job, life having not bool_or(status in ('done', 'error'))""")
def job_change_feed(spark, d):
    """What a follower of each job is told: changes of status, stage or progress up to its end, and that it is gone."""
    return ordered.job_feed_batch(job_events(spark, d), SILENCE_MS)


def updates(spark, d) -> DataFrame:
    """Events as partial updates of a user's record: each sets one or two of three fields."""
    return V.table(spark, d, "events").selectExpr("user_id as id", "event_id as seq", "case when event_id % 3 = 0 then event_type end as status", "case when event_id % 3 = 1 then props end as props", "case when event_id % 5 < 3 then value end as score")


_FIELDS = ["status", "props", "score"]
_UPDATES = "u as (select user_id as id, event_id as seq, case when event_id % 3 = 0 then event_type end as status, case when event_id % 3 = 1 then props end as props, case when event_id % 5 < 3 then value end as score from events)"


def _state_sql(upto: str) -> str:
    pick = ", ".join(f"arg_max({f}, seq) filter ({f} is not null) as {f}" for f in _FIELDS)
    return f"with {_UPDATES} select id, {pick} from u where seq <= {upto} group by id having count(status) + count(props) + count(score) > 0"


@query(_state_sql("(select max(event_id) from events)"))
def record_state(spark, d):
    """Each record after all partial updates."""
    return changelog.state_at(updates(spark, d), "id", "seq", _FIELDS)


@query(_state_sql("(select max(event_id) // 3 from events)"))
def record_state_at(spark, d):
    """Each record as it was after a third of the updates, from a snapshot of a sixth and the deltas since."""
    u = updates(spark, d)
    upto = (u.agg(F.max("seq")).first()[0] or 0) // 3
    changes = changelog.deltas(u, "id", "seq", _FIELDS)
    snapshot = changelog.compacted(changes, "id", _FIELDS, upto // 2)
    later = changelog.deltas(u.where(F.col("seq") > upto // 2), "id", "seq", _FIELDS)
    return changelog.state(changelog.compacted(snapshot.unionByName(later), "id", _FIELDS, upto), "id", _FIELDS)


_PIECES = "p as (select user_id as media_id, event_id as seq, case when event_type in ('view', 'click', 'signup') then 'A' else 'B' end as speaker, event_type as text, epoch_us(ts)::bigint as at_us, epoch_us(ts)::bigint + floor(value * 36000)::bigint * 1000 as end_us from events)"


@query(f"""with {_PIECES}, s as (select *, sum(case when speaker = q then 0 else 1 end) over (partition by media_id order by at_us, seq) as run from (select *, lag(speaker) over (partition by media_id order by at_us, seq) as q from p)),
 r as (select *, max(end_us) over (partition by media_id, run order by at_us, seq rows between unbounded preceding and 1 preceding) as reach from s),
 t as (select *, sum(case when reach is null or at_us - reach > {GAP_MS * 1000} then 1 else 0 end) over (partition by media_id order by at_us, seq) as turn from r)
 select media_id, min_by(seq, at_us) as seq, min(speaker) as speaker, min(at_us) as start_us, max(end_us) as end_us, string_agg(text, ' ' order by at_us, seq) as text from t group by media_id, turn""")
def assembled_turns(spark, d):
    """Turns of pieces in order: of one speaker, at most GAP_MS after the turn's end."""
    return ordered.assemble_turns_batch(speech_pieces(spark, d), GAP_MS)


@query(f"""with {_PIECES}, g as (select *, at_us + ((end_us - at_us) // 1000 + {GAP_MS}) * 1000 as till from p),
 n as (select *, case when at_us <= max(till) over (partition by media_id, speaker order by at_us, seq rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from g),
 i as (select *, sum(new) over (partition by media_id, speaker order by at_us, seq) as run from n)
 select media_id, speaker, min(at_us) as start_us, max(end_us) as end_us, count(*) as pieces from i group by media_id, speaker, run""")
def speech_stretches(spark, d):
    """Each speaker's stretches, by session windows with a gap of each piece's own."""
    return ordered.spoken_sessions(speech_pieces(spark, d), GAP_MS)
