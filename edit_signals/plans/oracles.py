"""DuckDB oracle SQL for every driver query in :mod:`.queries`.

Each statement recomputes the same result from the raw tables by brute force
(plain GROUP BY, running window functions over the whole table) and mirrors the
adapter rules of ``sources/events_table.py``.
"""

from __future__ import annotations

# Adapter: events -> edits (same rules as sources/events_table.py).
_EDITS = """
src AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
),
edits AS (
  SELECT
    CASE WHEN k = 7 THEN NULL ELSE 'user_' || CAST(user_id AS VARCHAR) END AS title,
    CASE WHEN k % 2 = 0 THEN 'enwiki' ELSE 'dewiki' END AS wiki,
    'editor_' || CAST(user_id AS VARCHAR) AS "user",
    CASE WHEN k = 3 THEN false ELSE event_type <> 'click' END AS bot,
    CAST(epoch_us(ts) // 1000000 AS BIGINT) AS "timestamp",
    event_type AS "type",
    props AS "comment",
    CASE WHEN k BETWEEN 80 AND 89 THEN 1 ELSE 0 END AS namespace,
    event_id AS revision_old,
    event_id + 1 AS revision_new,
    CAST(k * 10 AS INTEGER) AS length_old,
    CAST(k * 10 + user_id % 50 AS INTEGER) AS length_new,
    event_id, k,
    ts AS event_time,
    CASE WHEN k >= 90 THEN ts + INTERVAL 6 HOUR ELSE ts END AS arrival_ts
  FROM src
),
main AS (SELECT * FROM edits WHERE namespace = 0)
"""

_EVENT_COLS = ('title, wiki, "user", bot, "timestamp", "type", "comment", namespace, '
               'revision_old, revision_new, length_old, length_new')


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join([_EDITS.strip()] + [c.strip() for c in ctes]) + "\n"


def _bucket(width: str, col: str = "event_time") -> str:
    return f"time_bucket(INTERVAL '{width}', {col}, TIMESTAMP '1970-01-01')"


def _windowed(name: str, width: str, source: str = "main") -> str:
    return (f"{name} AS (SELECT *, {_bucket(width)} AS window_start, "
            f"{_bucket(width)} + INTERVAL '{width}' AS window_end FROM {source})")


def _batched(order: str) -> str:
    """Main rows with the micro-batch of their range: four equal integer ranges of ``order``."""
    return f"""batched AS (
  SELECT *, (({order} - lo) * 4) // (hi - lo + 1) AS batch
  FROM main, (SELECT min({order}) AS lo, max({order}) AS hi FROM main))"""


def _kept(name: str, width: str, order: str = "arrival_ts, event_id", source: str = "main") -> str:
    """Rows a zero-grace window of ``width`` accepts: window end > running max event time."""
    return f"""{name} AS (
  SELECT * FROM (
    SELECT *, {_bucket(width)} + INTERVAL '{width}' AS _we,
           max(event_time) OVER (ORDER BY {order}
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _hw
    FROM {source}) WHERE _we > _hw)"""


# one ordered log of the records: the offset follows the arrival, the record time is the event time
_LOG = """log AS (SELECT *, (epoch_us(arrival_ts) // 1000000) * 1000000000 + event_id AS off FROM main)"""


def _trending(name: str, width: str, threshold: int, source: str) -> str:
    return f"""{name} AS (
  SELECT 'TRENDING' AS signal_type, title, CAST(count(*) AS BIGINT) AS edit_count,
         CAST(NULL AS BIGINT) AS bot_edit_count, CAST(NULL AS BIGINT) AS total_edit_count,
         CAST(NULL AS DOUBLE) AS ratio,
         {_bucket(width)} AS window_start, {_bucket(width)} + INTERVAL '{width}' AS window_end,
         max({{'arrival_ts': arrival_ts, 'arrival_id': event_id}}) AS emitted
  FROM {source} WHERE title IS NOT NULL
  GROUP BY title, {_bucket(width)}
  HAVING count(*) >= {threshold})"""


def _bot(name: str, width: str, ratio: float, volume: int, source: str) -> str:
    return f"""{name} AS (
  SELECT 'BOT_ANOMALY' AS signal_type, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS BIGINT) AS edit_count,
         CAST(count(*) FILTER (WHERE bot) AS BIGINT) AS bot_edit_count,
         CAST(count(*) AS BIGINT) AS total_edit_count,
         CAST(count(*) FILTER (WHERE bot) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS ratio,
         {_bucket(width)} AS window_start, {_bucket(width)} + INTERVAL '{width}' AS window_end,
         max({{'arrival_ts': arrival_ts, 'arrival_id': event_id}}) AS emitted
  FROM {source}
  GROUP BY {_bucket(width)}
  HAVING count(*) >= {volume}
     AND CAST(count(*) FILTER (WHERE bot) AS DOUBLE) / CAST(count(*) AS DOUBLE) > {ratio})"""


_SIGNAL_COLS = "signal_type, title, edit_count, bot_edit_count, total_edit_count, ratio, window_start, window_end"

# Driver parameters: trending 1 day / 5 edits; bot 1 hour (and 1 day) / ratio 0.8 / volume 10.
T_W, T_N = "1 day", 5
B_W, B_W_DAY, B_R, B_V = "1 hour", "1 day", 0.8, 10

_DETECTED = [_trending("tr", T_W, T_N, "main"), _bot("bo", B_W, B_R, B_V, "main"),
             f"det AS (SELECT {_SIGNAL_COLS}, emitted FROM tr UNION ALL SELECT {_SIGNAL_COLS}, emitted FROM bo)"]


def _revisions(order: str = "arrival_ts, event_id", ts: str = "arrival_ts", id: str = "event_id", source: str = "main") -> list[str]:
    return [
        _kept("kt", T_W, order, source), _kept("kb", B_W, order, source),
        f"""trc AS (
  SELECT title, {_bucket(T_W)} AS window_start, {_bucket(T_W)} + INTERVAL '{T_W}' AS window_end,
         CAST(count(*) OVER (PARTITION BY title, {_bucket(T_W)} ORDER BY {order}
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS edit_count,
         {ts} AS emitted_ts, {id} AS emitted_id
  FROM kt WHERE title IS NOT NULL)""",
        f"""trev AS (
  SELECT 'TRENDING' AS signal_type, title, edit_count, CAST(NULL AS BIGINT) AS bot_edit_count,
         CAST(NULL AS BIGINT) AS total_edit_count, CAST(NULL AS DOUBLE) AS ratio,
         window_start, window_end, emitted_ts, emitted_id
  FROM trc WHERE edit_count >= {T_N})""",
        f"""brc AS (
  SELECT {_bucket(B_W)} AS window_start, {_bucket(B_W)} + INTERVAL '{B_W}' AS window_end,
         CAST(count(*) OVER w AS BIGINT) AS total_edit_count,
         CAST(count(*) FILTER (WHERE bot) OVER w AS BIGINT) AS bot_edit_count,
         {ts} AS emitted_ts, {id} AS emitted_id
  FROM kb
  WINDOW w AS (PARTITION BY {_bucket(B_W)} ORDER BY {order}
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
        f"""brev AS (
  SELECT 'BOT_ANOMALY' AS signal_type, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS BIGINT) AS edit_count,
         bot_edit_count, total_edit_count,
         CAST(bot_edit_count AS DOUBLE) / CAST(total_edit_count AS DOUBLE) AS ratio,
         window_start, window_end, emitted_ts, emitted_id
  FROM brc
  WHERE total_edit_count >= {B_V} AND CAST(bot_edit_count AS DOUBLE) / CAST(total_edit_count AS DOUBLE) > {B_R})""",
    ]


def _items(source: str, extra: str = "") -> str:
    return f"""SELECT {extra}signal_type AS pk, CAST(epoch_ms(window_end) AS VARCHAR) AS sk, signal_type AS "signalType",
       epoch_ms(window_start) AS "windowStart", epoch_ms(window_end) AS "windowEnd", title,
       edit_count AS "editCount", bot_edit_count AS "botEditCount", total_edit_count AS "totalEditCount", ratio
FROM {source}"""


def _display(source: str) -> str:
    win = ("strftime(window_start, '%Y-%m-%d %H:%M:%S') || ' - ' || strftime(window_end, '%Y-%m-%d %H:%M:%S')")
    metrics = ("CASE WHEN signal_type = 'TRENDING' THEN CAST(edit_count AS VARCHAR) || ' edits' "
               "ELSE CAST(bot_edit_count AS VARCHAR) || '/' || CAST(total_edit_count AS VARCHAR) || ' (' "
               "|| CAST(CAST(floor(ratio * 100 + 0.5) AS INTEGER) AS VARCHAR) || '%)' END")
    title = "CASE WHEN signal_type = 'TRENDING' THEN coalesce(title, 'null') ELSE '-' END"
    return f"""disp AS (
  SELECT *, signal_type AS display_type, {title} AS display_title, {metrics} AS display_metrics,
         {win} AS display_window FROM {source})"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["sse_decode"] = _with() + f"SELECT event_id, {_EVENT_COLS} FROM edits WHERE k NOT BETWEEN 95 AND 99"
    q["sse_quarantine"] = _with() + (
        "SELECT event_id, '{\"id\":' || CAST(event_id AS VARCHAR) || ',\"title\":' AS payload "
        "FROM edits WHERE k BETWEEN 95 AND 99")
    q["main_namespace"] = _with() + f"SELECT event_id, {_EVENT_COLS} FROM main"
    q["keyed_edits"] = _with() + "SELECT title AS key, event_id, wiki, title FROM main"
    q["event_round_trip"] = _with() + f"SELECT event_id, {_EVENT_COLS} FROM edits"
    q["ingest_counts"] = _with() + (
        "SELECT count(*) FILTER (WHERE k NOT BETWEEN 95 AND 99 AND namespace = 0) AS published, "
        "count(*) FILTER (WHERE k NOT BETWEEN 95 AND 99 AND namespace <> 0) AS filtered, "
        "count(*) FILTER (WHERE k BETWEEN 95 AND 99) AS failed FROM edits")
    q["tumbling_edit_counts"] = _with(_windowed("w", T_W)) + (
        "SELECT title, window_start, window_end, CAST(count(*) AS BIGINT) AS edit_count "
        "FROM w WHERE title IS NOT NULL GROUP BY title, window_start, window_end")
    q["tumbling_edit_counts_by_wiki"] = _with(_windowed("w", T_W)) + (
        "SELECT wiki, title, window_start, window_end, CAST(count(*) AS BIGINT) AS edit_count "
        "FROM w WHERE title IS NOT NULL AND wiki IS NOT NULL GROUP BY wiki, title, window_start, window_end")
    q["tumbling_bot_counts"] = _with(_windowed("w", B_W)) + (
        "SELECT window_start, window_end, CAST(count(*) AS BIGINT) AS total_edit_count, "
        "CAST(count(*) FILTER (WHERE bot) AS BIGINT) AS bot_edit_count, "
        "CAST(count(*) FILTER (WHERE bot) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS ratio "
        "FROM w GROUP BY window_start, window_end")
    q["trending_signals"] = _with(_trending("tr", T_W, T_N, "main")) + f"SELECT {_SIGNAL_COLS} FROM tr"
    q["bot_anomaly_signals"] = _with(_bot("bo", B_W, B_R, B_V, "main")) + f"SELECT {_SIGNAL_COLS} FROM bo"
    q["bot_anomaly_signals_daily"] = _with(_bot("bo", B_W_DAY, B_R, B_V, "main")) + f"SELECT {_SIGNAL_COLS} FROM bo"
    q["detect_signals"] = _with(*_DETECTED) + f"SELECT {_SIGNAL_COLS} FROM det"
    q["late_rows"] = _with(_kept("kb", B_W)) + (
        f"SELECT m.event_id, m.title, m.event_time, m.arrival_ts, {_bucket(B_W, 'm.event_time')} AS window_start "
        "FROM main m ANTI JOIN kb USING (event_id)")
    q["trending_no_grace"] = _with(_kept("kt", T_W), _trending("tr", T_W, T_N, "kt")) + f"SELECT {_SIGNAL_COLS} FROM tr"
    q["bot_no_grace"] = _with(_kept("kb", B_W), _bot("bo", B_W, B_R, B_V, "kb")) + f"SELECT {_SIGNAL_COLS} FROM bo"
    q["trending_revisions"] = _with(*_revisions()) + f"SELECT {_SIGNAL_COLS}, emitted_ts, emitted_id FROM trev"
    q["bot_revisions"] = _with(*_revisions()) + f"SELECT {_SIGNAL_COLS}, emitted_ts, emitted_id FROM brev"
    q["first_crossing"] = _with(*_revisions(), f"""rev AS (
  SELECT {_SIGNAL_COLS}, emitted_ts, emitted_id FROM trev
  UNION ALL SELECT {_SIGNAL_COLS}, emitted_ts, emitted_id FROM brev)""") + (
        "SELECT signal_type, title, "
        "arg_min(edit_count, (emitted_ts, emitted_id)) AS edit_count, "
        "arg_min(bot_edit_count, (emitted_ts, emitted_id)) AS bot_edit_count, "
        "arg_min(total_edit_count, (emitted_ts, emitted_id)) AS total_edit_count, "
        "arg_min(ratio, (emitted_ts, emitted_id)) AS ratio, window_start, window_end, "
        "min(emitted_ts) AS emitted_ts, arg_min(emitted_id, (emitted_ts, emitted_id)) AS emitted_id "
        "FROM rev GROUP BY signal_type, title, window_start, window_end")
    q["signal_round_trip"] = q["detect_signals"]
    store = f"""items AS ({_items('det', 'emitted, ')})"""
    q["signal_store"] = _with(*_DETECTED, store) + (
        'SELECT pk, sk, "signalType", "windowStart", "windowEnd", title, "editCount", "botEditCount", '
        '"totalEditCount", ratio FROM (SELECT *, row_number() OVER (PARTITION BY pk, sk '
        "ORDER BY emitted DESC, title DESC NULLS LAST) AS rn FROM items) WHERE rn = 1")
    q["signal_store_by_title"] = _with(*_DETECTED, store) + (
        'SELECT pk, sk, "signalType", "windowStart", "windowEnd", title, "editCount", "botEditCount", '
        '"totalEditCount", ratio FROM (SELECT *, row_number() OVER (PARTITION BY pk, sk, title '
        "ORDER BY emitted DESC) AS rn FROM items) WHERE rn = 1")
    q["recent_signals"] = _with(*_DETECTED) + (
        f"SELECT {_SIGNAL_COLS}, emitted.arrival_ts AS emitted_ts, emitted.arrival_id AS emitted_id FROM det "
        "ORDER BY emitted DESC, window_end DESC, signal_type ASC, title ASC NULLS FIRST LIMIT 50")
    q["signal_display"] = _with(*_DETECTED, _display("det")) + (
        "SELECT signal_type, title, window_start, display_type, display_title, display_metrics, display_window "
        "FROM disp")
    q["signal_html"] = _with(*_DETECTED, _display("det")) + (
        "SELECT signal_type, title, window_start, '<tr><td>' || signal_type || '</td><td>' || "
        "replace(replace(replace(display_title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</td><td>' || "
        "display_metrics || '</td><td>' || display_window || '</td></tr>' AS html_row FROM disp")
    wire = ("""CASE WHEN signal_type = 'TRENDING' THEN '{"signalType":"TRENDING","title":"' || title || """
            """'","editCount":' || CAST(edit_count AS VARCHAR) ELSE '{"signalType":"BOT_ANOMALY","botEditCount":' """
            """|| CAST(bot_edit_count AS VARCHAR) || ',"totalEditCount":' || CAST(total_edit_count AS VARCHAR) """
            """|| ',"ratio":' || CAST(ratio AS VARCHAR) END || ',"windowStart":' """
            """|| CAST(epoch_ms(window_start) AS VARCHAR) || ',"windowEnd":' || CAST(epoch_ms(window_end) AS VARCHAR) """
            """|| '}'""")
    q["signals_json"] = _with(*_DETECTED) + (
        "SELECT '[' || coalesce(string_agg(js, ',' ORDER BY rn), '') || ']' AS signals_json FROM ("
        "SELECT row_number() OVER (ORDER BY emitted DESC, window_end DESC, signal_type ASC, title ASC NULLS FIRST) "
        f"AS rn, {wire} AS js FROM det "
        "ORDER BY emitted DESC, window_end DESC, signal_type ASC, title ASC NULLS FIRST LIMIT 50)")
    closed = "window_end <= (SELECT max(event_time) FROM main)"
    q["stream_trending"] = _with(_trending("tr", T_W, T_N, "main")) + f"SELECT {_SIGNAL_COLS} FROM tr WHERE {closed}"
    q["stream_bot"] = _with(_bot("bo", B_W, B_R, B_V, "main")) + f"SELECT {_SIGNAL_COLS} FROM bo WHERE {closed}"
    q["stream_detect"] = _with(*_DETECTED) + f"SELECT {_SIGNAL_COLS} FROM det WHERE {closed}"
    q["stream_resume"] = q["stream_detect"]
    # the replay lands four ranges of the ordering column, one micro-batch each (plans/replay.py)
    batched = _batched("event_id")
    states = f"""states AS (
  SELECT title, window_start, batch, sum(n) OVER w AS total, max(ts) OVER w AS emitted_ts, max(id) OVER w AS emitted_id
  FROM (SELECT title, {_bucket(T_W)} AS window_start, batch, count(*) AS n, max(event_time) AS ts, max(event_id) AS id
        FROM batched WHERE title IS NOT NULL GROUP BY title, {_bucket(T_W)}, batch)
  WINDOW w AS (PARTITION BY title, window_start ORDER BY batch))"""
    updates = f"""upd AS (
  SELECT 'TRENDING' AS signal_type, title, CAST(total AS BIGINT) AS edit_count, CAST(NULL AS BIGINT) AS bot_edit_count,
         CAST(NULL AS BIGINT) AS total_edit_count, CAST(NULL AS DOUBLE) AS ratio, window_start,
         window_start + INTERVAL '{T_W}' AS window_end, emitted_ts, emitted_id
  FROM states WHERE total >= {T_N})"""
    q["stream_trending_updates"] = _with(batched, states, updates) + f"SELECT {_SIGNAL_COLS} FROM upd"
    bot_states = f"""bstates AS (
  SELECT window_start, batch, sum(n) OVER w AS total, sum(nb) OVER w AS bots, max(ts) OVER w AS emitted_ts, max(id) OVER w AS emitted_id
  FROM (SELECT {_bucket(B_W)} AS window_start, batch, count(*) AS n, count(*) FILTER (WHERE bot) AS nb,
               max(event_time) AS ts, max(event_id) AS id
        FROM batched GROUP BY {_bucket(B_W)}, batch)
  WINDOW w AS (PARTITION BY window_start ORDER BY batch))"""
    both = f"""allupd AS (
  SELECT * FROM upd UNION ALL
  SELECT 'BOT_ANOMALY' AS signal_type, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS BIGINT) AS edit_count,
         CAST(bots AS BIGINT) AS bot_edit_count, CAST(total AS BIGINT) AS total_edit_count,
         CAST(bots AS DOUBLE) / CAST(total AS DOUBLE) AS ratio, window_start, window_start + INTERVAL '{B_W}' AS window_end,
         emitted_ts, emitted_id
  FROM bstates WHERE total >= {B_V} AND CAST(bots AS DOUBLE) / CAST(total AS DOUBLE) > {B_R})"""
    all_updates = [batched, states, updates, bot_states, both]
    # one edit may be the last of a title's window and of a bot window: then the record's text decides
    q["stream_recent"] = _with(*all_updates) + (
        f"SELECT {_SIGNAL_COLS}, emitted_ts, emitted_id FROM allupd "
        "ORDER BY emitted_ts DESC, emitted_id DESC, signal_type DESC LIMIT 50")
    q["stream_landed_topic"] = _with() + (
        f'SELECT title AS key, {_EVENT_COLS}, "timestamp" AS record_seconds FROM main WHERE k NOT BETWEEN 95 AND 99')
    all_items = f"items AS ({_items('allupd', 'emitted_ts, emitted_id, ')})"
    q["stream_store"] = _with(*all_updates, all_items) + (
        'SELECT pk, sk, "signalType", "windowStart", "windowEnd", title, "editCount", "botEditCount", '
        '"totalEditCount", ratio FROM (SELECT *, row_number() OVER (PARTITION BY pk, sk, title '
        "ORDER BY emitted_ts DESC, emitted_id DESC) AS rn FROM items) WHERE rn = 1")
    q["stream_open_windows"] = _with(*_DETECTED) + f"SELECT {_SIGNAL_COLS} FROM det WHERE NOT ({closed})"
    q["stream_store_window"] = _with(*all_updates, all_items) + (
        'SELECT pk, sk, "signalType", "windowStart", "windowEnd", title, "editCount", "botEditCount", '
        '"totalEditCount", ratio FROM (SELECT *, row_number() OVER (PARTITION BY pk, sk '
        "ORDER BY emitted_ts DESC, emitted_id DESC) AS rn FROM items) WHERE rn = 1")
    # in arrival order: a row is dropped if its window ended by the latest event time of earlier batches
    q["stream_late"] = _with(
        _batched("epoch_us(arrival_ts)"),
        """marks AS (SELECT batch, max(top) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark
  FROM (SELECT batch, max(event_time) AS top FROM batched GROUP BY batch))""",
        *[f"""{n} AS (SELECT b.* FROM batched b JOIN marks m USING (batch)
  WHERE m.mark IS NULL OR {_bucket(w)} + INTERVAL '{w}' > m.mark)""" for n, w in (("kt", T_W), ("kb", B_W))],
        _trending("tr", T_W, T_N, "kt"), _bot("bo", B_W, B_R, B_V, "kb")) + (
        f"SELECT {_SIGNAL_COLS} FROM tr WHERE {closed} UNION ALL SELECT {_SIGNAL_COLS} FROM bo WHERE {closed}")
    # a clock per partition for trending; for bots the partitions merged by (clock, partition, offset)
    q["partitioned_no_grace"] = _with(
        """topic AS (SELECT *, CAST(substr(title, 6) AS BIGINT) % 7 AS part,
         (epoch_us(arrival_ts) // 1000000) * 1000000000 + event_id AS off FROM main WHERE title IS NOT NULL AND event_id % 13 <> 0)""",
        """clocked AS (SELECT *, max(event_time) OVER (PARTITION BY part ORDER BY off
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS clock FROM topic)""",
        """merged AS (SELECT *, max(event_time) OVER (ORDER BY clock, part, off
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hw FROM clocked)""",
        f"kt AS (SELECT * FROM clocked WHERE {_bucket(T_W)} + INTERVAL '{T_W}' > clock)",
        f"kb AS (SELECT * FROM merged WHERE {_bucket(B_W)} + INTERVAL '{B_W}' > hw)",
        _trending("tr", T_W, T_N, "kt"), _bot("bo", B_W, B_R, B_V, "kb"),
        f"""et AS (SELECT title, {_bucket(T_W)} AS window_start, arg_max(event_time, off) AS emitted_ts
  FROM kt GROUP BY title, {_bucket(T_W)})""",
        f"""eb AS (SELECT {_bucket(B_W)} AS window_start, arg_max(event_time, (clock, part, off)) AS emitted_ts
  FROM kb GROUP BY {_bucket(B_W)})""") + (
        f"SELECT tr.* EXCLUDE (emitted), et.emitted_ts FROM tr JOIN et USING (title, window_start) "
        f"UNION ALL BY NAME SELECT bo.* EXCLUDE (emitted), eb.emitted_ts FROM bo JOIN eb USING (window_start)")
    # exact in a stream: the rows of the batch operators, windows still open included, wherever the input is cut
    q["stream_exact_revisions"] = _with(_LOG, *_revisions("off", "event_time", "off", "log")) + (
        f"SELECT {_SIGNAL_COLS}, emitted_ts, emitted_id FROM trev UNION ALL SELECT {_SIGNAL_COLS}, emitted_ts, emitted_id FROM brev")
    q["stream_exact_signals"] = _with(_LOG, _kept("kt", T_W, "off", "log"), _kept("kb", B_W, "off", "log"),
                                      _trending("tr", T_W, T_N, "kt"), _bot("bo", B_W, B_R, B_V, "kb")) + (
        f"SELECT {_SIGNAL_COLS} FROM tr UNION ALL SELECT {_SIGNAL_COLS} FROM bo")
    q["stream_ingest_counts"] = q["ingest_counts"]
    # Through the feed: broken lines (k 95..99) never reach detection; record time = payload
    # time (whole seconds).
    fed = ("fed AS (SELECT * REPLACE (date_trunc('second', event_time) AS event_time) FROM main "
           "WHERE k NOT BETWEEN 95 AND 99)")
    q["stream_feed_to_signals"] = _with(fed, _trending("tr", T_W, T_N, "fed"), _bot("bo", B_W, B_R, B_V, "fed")) + (
        f"SELECT {_SIGNAL_COLS} FROM tr WHERE window_end <= (SELECT max(event_time) FROM fed) "
        f"UNION ALL SELECT {_SIGNAL_COLS} FROM bo WHERE window_end <= (SELECT max(event_time) FROM fed)")
    q["stream_ingest"] = _with() + (
        f'SELECT title AS key, {_EVENT_COLS}, "timestamp" AS record_seconds FROM main WHERE k NOT BETWEEN 95 AND 99')
    return q
