"""Streams over the event and conversation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import fixed_values as V
from ..functions import predicates as P
from ..functions.hashing import frac, pick, pick_from
from ..streaming import rooms as R
from .dialect import injected, injected_sql, strip_sql, u32_sql
from .on_aggregates import SESSION_SQL
from .on_extract import _mention_sql
from .on_filters import trigger_sql
from .on_joins import ASOF_SQL
from .on_synth import arr
from .registry import query


def events(t):
    return R.table_stream(t.spark, t.folder, "events")


def replayed(t):
    return R.Replay(t.spark, t.folder, "events", "ts", "user_id")


def k_of(props="props"):
    return F.get_json_object(props, "$.k").cast("bigint")


@query("stream_message_gate", """
    SELECT event_id, user_id FROM events WHERE event_type <> 'error'
        AND (user_id % 3 = 0 OR json_extract_string(props, '$.k')::BIGINT % 5 = 0)""")
def _(t):
    rows = events(t).select("event_id", "user_id", (F.col("event_type") == "error").alias("is_bot"),
                            (F.col("user_id") % 3 == 0).alias("is_dm"), (k_of() % 5 == 0).alias("mentioned"))
    return R.drain(R.message_gate(rows).select("event_id", "user_id"), "gate")


@query("stream_event_dispatch", """
    SELECT event_id, CASE event_type WHEN 'signup' THEN 'greet' WHEN 'error' THEN 'ignore' ELSE 'reply' END AS action,
        CASE WHEN event_type NOT IN ('signup', 'error') THEN CASE WHEN event_id % 2 = 0 THEN props WHEN event_id % 3 = 0 THEN '' ELSE event_type END END AS said,
        CASE WHEN event_type NOT IN ('signup', 'error') THEN CASE WHEN user_id % 4 = 0 THEN 'dm' ELSE 'room' || user_id END END AS room
    FROM events""")
def _(t):
    kind = (F.when(F.col("event_type") == "signup", "ADDED_TO_SPACE").when(F.col("event_type") == "error", "OTHER")
            .otherwise("MESSAGE"))
    argument = F.when(F.col("event_id") % 2 == 0, F.col("props"))
    text = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type"))
    room = F.when(F.col("user_id") % 4 != 0, F.concat(F.lit("room"), F.col("user_id").cast("string")))
    columns = R.event_dispatch(kind, argument, text, room)
    return R.drain(events(t).select("event_id", *[c.alias(n) for n, c in columns.items()]), "dispatch")


@query("stream_room_history", """
    WITH h AS (SELECT event_id, user_id, list(event_type || ' ' || props) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS l FROM events)
    SELECT event_id, user_id, coalesce(array_to_string(l, chr(10)), '') AS history FROM h""")
def _(t):
    replay = replayed(t)
    rows = replay.stream.select("event_id", "user_id", "ts", F.concat_ws(" ", "event_type", "props").alias("line"))
    out = R.keyed(rows, "user_id", R.RoomHistory("user_id", ["ts", "event_id"], slice_ms=replay.slice_ms),
                  "event_id bigint, user_id bigint, history string", replay.buckets)
    return R.on_time(R.drain(out, "history", replay))


@query("stream_last_seen", ASOF_SQL)
def _(t):
    replay = replayed(t)
    rows = replay.stream.select("event_id", "user_id", "ts", "event_type", "value")
    out = R.keyed(rows, "user_id", R.LastSeen("user_id", ["ts", "event_id"], slice_ms=replay.slice_ms),
                  "event_id bigint, user_id bigint, seen_image bigint, seen_value double", replay.buckets)
    return R.on_time(R.drain(out, "seen", replay))


def suppression_input(rows):
    """Three scored candidates per event, out of a few texts so that they recur."""
    key = F.col("event_id")
    texts = F.array(*[F.concat(F.lit("Reply "), pick(f"text{i}", key, 9).cast("string")) for i in range(3)])
    scores = F.array(*[frac(f"score{i}", key) for i in range(3)])
    return rows.select("event_id", "user_id", "ts", texts.alias("texts"), scores.alias("scores"))


@query("stream_recent_suppression")
def _(t):
    replay = replayed(t)
    out = R.keyed(suppression_input(replay.stream), "user_id", R.RecentSuppression("user_id", ["ts", "event_id"], slice_ms=replay.slice_ms),
                  "event_id bigint, user_id bigint, reply string, score double", replay.buckets)
    return R.on_time(R.drain(out, "suppressed", replay))


@query("stream_session_stats", SESSION_SQL)
def _(t):
    rows = events(t).select("user_id", "value", k_of().alias("k"))
    # Sums are kept in the state; figures are made of the last sums.
    sums = rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("replies"), F.sum(F.greatest(F.lit(1), "k")).alias("tokens"),
        F.sum("value").alias("raw_seconds"))
    last = R.drain_updates(sums, "user_id", "sessions")
    seconds = F.greatest("raw_seconds", F.lit(1e-9))
    return last.select(
        "user_id", "replies", "tokens", F.round("raw_seconds", 4).alias("seconds"),
        F.round(F.col("tokens") / seconds, 4).alias("tok_s"),
        F.round(F.col("raw_seconds") / F.col("replies") * 1000, 3).alias("ms_per_reply"),
        F.round(F.col("replies") / seconds, 6).alias("replies_s"))


TYPED = [("/see pic ", ""), ("look at 'my pic.PNG' ", ""), ("", " main.py"), ("what is in this picture ", ""),
         ("write a python function ", ""), ("please solve it ", "")]
_KEY = "conv_id || '-' || turn"
_X = trigger_sql("x")


@query("stream_route", f"""
    WITH s AS (SELECT conv_id, turn, {_KEY} AS k, CASE WHEN turn = 2 AND conv_id % 3 = 0 THEN (conv_id % 9)::VARCHAR ELSE
        {strip_sql(injected_sql('typed', _KEY, 'text', TYPED))} END AS x FROM conversations),
    p AS (SELECT *, ({arr(V.ROUTES)})[{u32_sql('label', 'k')} % 6 + 1] AS label, {u32_sql('sure', 'k')} / 4294967296.0 AS conf FROM s)
    SELECT conv_id, turn, CASE WHEN starts_with(x, '/') THEN 'command' WHEN {_mention_sql('x', V.IMAGE_EXTS)} IS NOT NULL THEN 'look'
        WHEN {_mention_sql('x', V.CODE_EXTS)} IS NOT NULL THEN 'read' WHEN regexp_matches(x, '^[0-8]$') THEN 'move'
        WHEN conf >= 0.9 AND label <> 'chat' THEN label WHEN {_X['image']} THEN 'vision' WHEN {_X['codegen']} THEN 'codegen'
        WHEN {_X['reason']} THEN 'reason' WHEN {_X['code']} THEN 'code' ELSE 'chat' END AS route FROM p""")
def _(t):
    from ..functions.text import strip
    key = F.concat_ws("-", "conv_id", "turn")
    typed = strip(injected("typed", key, F.col("text"), TYPED))
    x = F.when((F.col("turn") == 2) & (F.col("conv_id") % 3 == 0), (F.col("conv_id") % 9).cast("string")).otherwise(typed)
    rows = R.table_stream(t.spark, t.folder, "conversations").select(
        "conv_id", "turn", x.alias("x"), pick_from("label", key, V.ROUTES).alias("label"), frac("sure", key).alias("conf"))
    said = F.col("x")
    route = R.route_column(X.command_name(said), X.file_mention(said, V.IMAGE_EXTS), X.file_mention(said, V.CODE_EXTS),
                           said.rlike("^[0-8]$"), F.col("label"), F.col("conf"), P.first_trigger(said), threshold=0.9)
    return R.drain(rows.select("conv_id", "turn", route.alias("route")), "route")
