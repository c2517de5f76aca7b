"""

All queries read the whole ``events`` table, which is mapped to topic records
first (see ``tickloom/sources/events.py``); ``TICKS`` is the same mapping in SQL.
Times leave as zoneless timestamps. Prices are quoted in 64ths and sizes are
whole, so that sums are exact and results can be compared without rounding.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.functions import (
    instant,
    local_time,
    parse_messages,
    parse_ticks,
    rejected_records,
    to_messages,
)
from tickloom.operators import (
    per_second,
    price_change,
    recent_volume,
    rolling_metrics,
    tick_metrics,
    unique_ticks,
)
from tickloom.params import JobParams, state_width
from tickloom.plans import (
    batch_layer,
    build_batch_layer,
    land_batch,
    lookback,
    narrow_rows,
    read_batch_layer,
    refresh_batch_layer,
    serving_view,
    to_relational_rows,
    to_table_rows,
    violations,
    write_rows,
)
from tickloom.plans.layers import DATE, read_rows
from tickloom.schemas import METRIC_FIELDS, MEASURE_COLUMNS
from tickloom.sources import unwrap_envelope
from tickloom.sources.events import LAG, event_records, read_events, write_waves
from tickloom.streaming import (
    compact_table,
    fold_table,
    land_ticks,
    read_landed_ticks,
    read_recent_volume,
    read_revisions,
    read_table,
    run_to_end,
    start_message_echo,
    start_recent_volume,
    start_speed_layer,
)
from tickloom.workspace import new_folder

try:
    from corpus_pipeline import ORACLE_SQL as PIPELINE_SQL, run as run_pipeline
    from tickloom.llm.registry import ORACLES as CORPUS_SQL, QUERIES as CORPUS_QUERIES
except ModuleNotFoundError as missing:
    name = missing.name or ""
    if name not in ("corpus_pipeline", "tickloom.llm", "tickloom.llm.registry"):
        if name.startswith("tickloom"):
            raise
        warnings.warn(f"no text queries: they need {name}, see requirements.txt")
    PIPELINE_SQL, CORPUS_SQL, CORPUS_QUERIES = None, {}, {}
else:
    CORPUS_QUERIES = {**CORPUS_QUERIES, "pipeline": run_pipeline}

ZONE = "America/New_York"
SPAN = "1 hour"
STREAM_SPAN = "5 hours"
SHORT_DELAY = "3 days 7 minutes"
SPLIT = datetime(2024, 1, 16)
REFRESH = (datetime(2024, 1, 8), datetime(2024, 1, 12))
STRAY = datetime(2031, 1, 1)
WINDOW = (datetime(2024, 1, 5, 6), datetime(2024, 1, 20, 18))


def _zoneless(df: DataFrame) -> DataFrame:
    times = [f.name for f in df.schema if f.dataType.typeName() == "timestamp"]
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times})


def _records(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return event_records(read_events(spark, sf_dir), **options).drop("wave")


def _ticks(spark: SparkSession, sf_dir: str, fields=METRIC_FIELDS, **options) -> DataFrame:
    return parse_ticks(_records(spark, sf_dir, **options), fields)


def _metrics(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return tick_metrics(unique_ticks(_ticks(spark, sf_dir, **options)))


# --- batch chain -----------------------------------------------------------


def explode_ticks(spark, sf_dir):
    return _zoneless(parse_ticks(_records(spark, sf_dir)))


def dedup_first_poll(spark, sf_dir):
    return _zoneless(unique_ticks(parse_ticks(_records(spark, sf_dir))))


def dedup_by_product(spark, sf_dir):
    ticks = _ticks(spark, sf_dir)
    return _zoneless(unique_ticks(ticks, keys=("product_id", "trade_id")))


def metrics_batch(spark, sf_dir):
    return _zoneless(_metrics(spark, sf_dir))


def metrics_with_repeats(spark, sf_dir):
    return _zoneless(tick_metrics(_ticks(spark, sf_dir)))


def metrics_decimal(spark, sf_dir):
    unique = unique_ticks(_ticks(spark, sf_dir, raw_numbers=True))
    exact = tick_metrics(unique, numbers="decimal")
    return _zoneless(
        exact.withColumn("avg_share_price", F.round("avg_share_price", 2)).withColumns(
            {c: F.col(c).cast("double") for c in MEASURE_COLUMNS}
        )
    )


def table_rows(spark, sf_dir):
    return _zoneless(to_table_rows(_metrics(spark, sf_dir)))


def table_rows_narrow(spark, sf_dir):
    return _zoneless(narrow_rows(to_table_rows(_metrics(spark, sf_dir))))


def relational_rows(spark, sf_dir):
    return _zoneless(to_relational_rows(_metrics(spark, sf_dir), ZONE))


def table_violations(spark, sf_dir):
    return violations(to_relational_rows(_metrics(spark, sf_dir, blank_sizes=True)))


def envelope_unwrap(spark, sf_dir):
    responses = _records(spark, sf_dir, enveloped=True)
    return _zoneless(parse_ticks(unwrap_envelope(responses)))


def envelope_direct(spark, sf_dir):
    responses = _records(spark, sf_dir, enveloped=True)
    return _zoneless(parse_ticks(responses, enveloped=True))


def product_selection(spark, sf_dir):
    return _zoneless(parse_ticks(_records(spark, sf_dir), products=("P1", "P3")))


def rejected(spark, sf_dir):
    broken = rejected_records(_records(spark, sf_dir, broken_errors=True))
    return _zoneless(broken.select("offset", "timestamp", F.col("value").cast("string").alias("value")))


def messages(spark, sf_dir):
    """Every message text is read back, so the comparison covers each field."""
    return _zoneless(parse_messages(to_messages(_metrics(spark, sf_dir, poll_seconds=None))))


def messages_lossless(spark, sf_dir):
    metrics = _metrics(spark, sf_dir, poll_seconds=None)
    return _zoneless(parse_messages(to_messages(metrics, lossless=True)))


# --- look-back, layers, rolling --------------------------------------------


def per_second_metrics(spark, sf_dir):
    return _zoneless(per_second(unique_ticks(_ticks(spark, sf_dir, poll_seconds=None))))


def recent_volume_1h(spark, sf_dir):
    return _zoneless(recent_volume(_metrics(spark, sf_dir), SPAN))


def price_change_by_product(spark, sf_dir):
    return _zoneless(price_change(_metrics(spark, sf_dir)))


def rolling(spark, sf_dir):
    return _zoneless(rolling_metrics(_metrics(spark, sf_dir), "6 hours"))


def local_times(spark, sf_dir):
    ticks = unique_ticks(_ticks(spark, sf_dir, poll_seconds=None))
    return _zoneless(
        ticks.select(
            "trade_id",
            "api_call_timestamp",
            local_time("api_call_timestamp", ZONE).alias("api_call_timestamp_local"),
        )
    )


def _landed(spark, sf_dir, path) -> DataFrame:
    """The ticks as the batch layer finds them: parsed once, landed by date."""
    return land_batch(_ticks(spark, sf_dir), path)


def batch_layer_table(spark, sf_dir):
    """All dates, written and then partly recomputed from the landed ticks."""
    path = new_folder(spark, "batch")
    ticks = _landed(spark, sf_dir, f"{path}/ticks")
    build_batch_layer(ticks, path)
    refresh_batch_layer(ticks, path, SPLIT, datetime(2024, 1, 20))
    return _zoneless(read_batch_layer(spark, path))


def batch_refresh(spark, sf_dir):
    """A table of other ticks, refreshed until it is that of all ticks.

    At first every third trade polled on the refreshed dates is missing, so that
    copies polled later are counted, and a date beyond the data has rows that
    are withdrawn.
    """
    path = new_folder(spark, "batch")
    landed = _landed(spark, sf_dir, f"{path}/ticks")
    ticks = landed.drop(DATE)  # rows whose poll is moved would keep their old date
    polled, (start, end) = F.col("api_call_timestamp"), map(instant, REFRESH)
    missing = (polled >= start) & (polled < end) & (F.col("trade_id") % 3 == 0)
    strays = ticks.where(F.col("trade_id") % 5 == 1).withColumn("api_call_timestamp", instant(STRAY))
    build_batch_layer(ticks.where(~missing).unionByName(strays), path)
    refresh_batch_layer(landed, path, *REFRESH)
    refresh_batch_layer(landed, path, STRAY, STRAY + timedelta(days=1))
    return _zoneless(read_batch_layer(spark, path))


def batch_refresh_lost_ids(spark, sf_dir):
    """Trades that lose their first poll and are counted on later dates again.

    At first copies of trades that are polled later stand on the refreshed
    dates; the refresh finds them withdrawn.
    """
    path = new_folder(spark, "batch")
    landed = _landed(spark, sf_dir, f"{path}/ticks")
    ticks = landed.drop(DATE)  # rows whose poll is moved would keep their old date
    later = ticks.where((F.col("api_call_timestamp") >= instant(REFRESH[1])) & (F.col("trade_id") % 7 == 3))
    early = later.withColumn("api_call_timestamp", instant(REFRESH[0]) + F.expr("INTERVAL 1 HOUR"))
    build_batch_layer(ticks.unionByName(early), path)
    refresh_batch_layer(landed, path, *REFRESH)
    return _zoneless(read_batch_layer(spark, path))


def lookback_window(spark, sf_dir):
    path = new_folder(spark, "batch")
    write_rows(batch_layer(_ticks(spark, sf_dir)), path)
    found = lookback(read_rows(spark, path), *WINDOW, products=("P0", "P2"))
    return _zoneless(found.drop(DATE))


def serving(spark, sf_dir):
    """Accurate rows up to a date; beyond it rows that still count repeats."""
    path = new_folder(spark, "serving")
    ticks = _ticks(spark, sf_dir)
    write_rows(batch_layer(ticks), f"{path}/batch")
    write_rows(to_table_rows(tick_metrics(ticks)), f"{path}/speed")
    tables = (read_rows(spark, f"{path}/{name}") for name in ("batch", "speed"))
    return _zoneless(serving_view(*tables, SPLIT).drop(DATE))


# --- streams ---------------------------------------------------------------


def _replay(spark, sf_dir, start, **changes) -> str:
    """Run a job over the waves, stopping and resuming it after each one."""
    root = new_folder(spark, "replay")
    width = state_width(spark, read_events(spark, sf_dir).count())
    settings = {"available_now": True, "delay": LAG, "message_topic": "metrics", "state_partitions": width}
    params = JobParams(**{**settings, "count_state": False, **changes})
    for _ in write_waves(spark, sf_dir, f"{root}/raw"):
        run_to_end(start(spark, params, f"{root}/checkpoint", root))
    return root


def _to_table(spark, params, checkpoint, root):
    return start_speed_layer(spark, params, checkpoint, f"{root}/table", f"{root}/raw")


def speed_layer_append(spark, sf_dir):
    root = _replay(spark, sf_dir, _to_table)
    return _zoneless(read_table(spark, f"{root}/table").drop(DATE))


def speed_layer_one_lane(spark, sf_dir):
    """The same with state in memory, and without trades that have no id."""
    root = _replay(spark, sf_dir, _to_table, rocksdb=False, null_ids="drop")
    return _zoneless(read_table(spark, f"{root}/table").drop(DATE))


def speed_layer_forever(spark, sf_dir):
    root = _replay(spark, sf_dir, _to_table, dedup="forever")
    return _zoneless(read_table(spark, f"{root}/table").drop(DATE))


def speed_layer_upsert(spark, sf_dir):
    root = _replay(spark, sf_dir, _to_table, output_mode="update")
    return _zoneless(read_table(spark, f"{root}/table").drop(DATE))


def speed_layer_revisions(spark, sf_dir):
    """How often a key was published: once, or again after a straggler."""
    root = _replay(spark, sf_dir, _to_table, output_mode="update")
    revisions = read_revisions(spark, f"{root}/table")
    return _zoneless(
        revisions.groupBy("api_call_timestamp_utc", "product_id").agg(
            F.count(F.lit(1)).alias("revisions")
        )
    )


# With a delay below the lag of repeats, stragglers are dropped as late, ids come
# back after they were forgotten, and a tail is not published yet.


def speed_layer_late_append(spark, sf_dir):
    root = _replay(spark, sf_dir, _to_table, delay=SHORT_DELAY)
    return _zoneless(read_table(spark, f"{root}/table").drop(DATE))


def per_second_stream(spark, sf_dir):
    """Whole seconds in append mode: one is out when the watermark has passed its end."""

    def start(spark, params, checkpoint, root):
        return start_speed_layer(spark, params, checkpoint, f"{root}/table", f"{root}/raw", grain="second")

    root = _replay(spark, sf_dir, start, delay=SHORT_DELAY)
    return _zoneless(read_table(spark, f"{root}/table").drop(DATE))


def recent_volume_stream(spark, sf_dir):
    """Three stateful steps in append mode: a row is out with its sum once it is final."""

    def start(spark, params, checkpoint, root):
        return start_recent_volume(spark, params, checkpoint, f"{root}/volume", STREAM_SPAN, f"{root}/raw")

    root = _replay(spark, sf_dir, start, delay=SHORT_DELAY)
    return _zoneless(read_recent_volume(spark, f"{root}/volume").drop(DATE))


def speed_layer_readmission(spark, sf_dir):
    root = _replay(spark, sf_dir, _to_table, delay=SHORT_DELAY, output_mode="update")
    return _zoneless(read_table(spark, f"{root}/table").drop(DATE))


def speed_layer_late_forever(spark, sf_dir):
    root = _replay(spark, sf_dir, _to_table, delay=SHORT_DELAY, output_mode="update", dedup="forever")
    return _zoneless(read_table(spark, f"{root}/table").drop(DATE))


def speed_layer_compacted(spark, sf_dir):
    root = _replay(spark, sf_dir, _to_table, output_mode="update")
    compact_table(spark, f"{root}/table", f"{root}/compacted", upto=3)
    current = read_table(spark, f"{root}/table", f"{root}/compacted", upto=3)
    return _zoneless(current.drop(DATE))


def speed_layer_folded(spark, sf_dir):
    """Folded twice, the second time by the dates of the newer batches only."""
    root = _replay(spark, sf_dir, _to_table, output_mode="update")
    fold_table(spark, f"{root}/table", 3)
    fold_table(spark, f"{root}/table", 5, drop=True)
    return _zoneless(read_table(spark, f"{root}/table").drop(DATE))


def messages_roundtrip(spark, sf_dir):
    """Table and messages from one query, the messages read by a second one."""

    def start(spark, params, checkpoint, root):
        return start_speed_layer(
            spark, params, checkpoint, f"{root}/table", f"{root}/raw", f"{root}/messages"
        )

    root = _replay(spark, sf_dir, start)
    params = JobParams(available_now=True, message_topic="metrics")
    run_to_end(
        start_message_echo(spark, params, f"{root}/echo-checkpoint", f"{root}/messages", f"{root}/echo")
    )
    echoed = spark.read.schema("timestamp timestamp, value string").parquet(f"{root}/echo")
    return _zoneless(parse_messages(echoed))


def landed_ticks(spark, sf_dir):
    def start(spark, params, checkpoint, root):
        return land_ticks(spark, params, checkpoint, f"{root}/ticks", f"{root}/raw")

    root = _replay(spark, sf_dir, start)
    return _zoneless(read_landed_ticks(spark, f"{root}/ticks").drop(DATE))


def lambda_chain(spark, sf_dir):
    """Stream to landed ticks to batch table, stream to speed table, one view."""

    def start(spark, params, checkpoint, root):
        run_to_end(land_ticks(spark, params.but(dedup="forever"), f"{root}/landing", f"{root}/ticks", f"{root}/raw"))
        return _to_table(spark, params, checkpoint, root)

    root = _replay(spark, sf_dir, start, output_mode="update")
    build_batch_layer(read_landed_ticks(spark, f"{root}/ticks"), f"{root}/batch")
    batch = read_batch_layer(spark, f"{root}/batch")
    return _zoneless(serving_view(batch, read_table(spark, f"{root}/table"), SPLIT).drop(DATE))


def entry(spark: SparkSession) -> DataFrame:
    """Records to table rows, the whole chain in batch."""
    return table_rows(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "explode_ticks": explode_ticks,
        "dedup_first_poll": dedup_first_poll,
        "dedup_by_product": dedup_by_product,
        "metrics_batch": metrics_batch,
        "metrics_with_repeats": metrics_with_repeats,
        "metrics_decimal": metrics_decimal,
        "table_rows": table_rows,
        "table_rows_narrow": table_rows_narrow,
        "relational_rows": relational_rows,
        "table_violations": table_violations,
        "envelope_unwrap": envelope_unwrap,
        "envelope_direct": envelope_direct,
        "product_selection": product_selection,
        "rejected_records": rejected,
        "messages": messages,
        "messages_lossless": messages_lossless,
        "per_second": per_second_metrics,
        "recent_volume": recent_volume_1h,
        "price_change": price_change_by_product,
        "rolling_metrics": rolling,
        "local_time": local_times,
        "batch_layer": batch_layer_table,
        "lookback": lookback_window,
        "batch_refresh": batch_refresh,
        "batch_refresh_lost_ids": batch_refresh_lost_ids,
        "serving_view": serving,
        "lambda_chain": lambda_chain,
        "speed_layer_append": speed_layer_append,
        "speed_layer_one_lane": speed_layer_one_lane,
        "speed_layer_forever": speed_layer_forever,
        "speed_layer_upsert": speed_layer_upsert,
        "speed_layer_revisions": speed_layer_revisions,
        "speed_layer_late_append": speed_layer_late_append,
        "per_second_stream": per_second_stream,
        "recent_volume_stream": recent_volume_stream,
        "speed_layer_readmission": speed_layer_readmission,
        "speed_layer_late_forever": speed_layer_late_forever,
        "speed_layer_compacted": speed_layer_compacted,
        "speed_layer_folded": speed_layer_folded,
        "messages_roundtrip": messages_roundtrip,
        "landed_ticks": landed_ticks,
        **CORPUS_QUERIES,
    }


# --- the same in SQL -------------------------------------------------------

# Polls, and the trade fields each of them delivers.
_TRADES = """
trades AS (
  SELECT event_id, event_type,
         CAST(event_id AS VARCHAR) AS trade_id,
         'P' || CAST(user_id % 5 AS VARCHAR) AS product_id,
         {price} AS price,
         {size} AS size,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS time,
         CASE event_type WHEN 'purchase' THEN 'BUY' WHEN 'click' THEN 'SELL'
                         ELSE event_type END AS side,
         '' AS bid, '' AS ask,
         {poll} AS poll
  FROM events)"""

_DELIVERED = """
ticks AS (
  SELECT * FROM trades
  UNION ALL
  SELECT * FROM trades WHERE event_id % 7 = 0
  UNION ALL
  SELECT * REPLACE (poll + INTERVAL 10 DAY AS poll) FROM trades WHERE event_id % 3 = 0),
uniq AS (
  SELECT * FROM ticks
  QUALIFY row_number() OVER (PARTITION BY trade_id ORDER BY poll) = 1)"""

_MEASURES = """
       count(trade_id) AS num_trades,
       count(*) FILTER (WHERE side = 'SELL') AS num_sell_trades,
       count(*) FILTER (WHERE side = 'BUY') AS num_buy_trades,
       sum(TRY_CAST(size AS DOUBLE)) AS share_volume,
       avg(TRY_CAST(price AS DOUBLE)) AS avg_share_price"""

_COLUMNS = "num_trades, num_sell_trades, num_buy_trades, share_volume, avg_share_price"
_FIELDS = "trade_id, product_id, price, size, time, side, bid, ask"
_POLL = "time_bucket(INTERVAL 30 MINUTE, ts)"
_PRICE = "CAST(floor(value * 64) / 64 AS VARCHAR)"
_SIZE = "json_extract_string(props, '$.k')"


def _with(poll=_POLL, price=_PRICE, size=_SIZE, source="uniq", more="") -> str:
    trades = _TRADES.format(poll=poll, price=price, size=size)
    metrics = f"""
metrics AS (
  SELECT poll AS api_call_timestamp, product_id, {_MEASURES}
  FROM {source} GROUP BY ALL)"""
    return f"WITH {trades},{_DELIVERED},{metrics}{more}\n"


# Each wave is one batch, followed by one without data. A row is late if it is
# no newer than the mark after the wave before; an id is forgotten once that mark
# has passed its first poll by the delay.
_SHORT = "INTERVAL 3 DAY + INTERVAL 7 MINUTE"
_LATE = f""",
deliveries AS (
  SELECT *, CAST(poll AS DATE) - DATE '1970-01-01' AS day FROM ticks),
waves AS (
  SELECT *, day // 10 + CASE WHEN event_id % 6 = 1 THEN 1 ELSE 0 END AS wave FROM deliveries),
marks AS (
  SELECT wave, max(max(poll)) OVER (ORDER BY wave) - ({_SHORT}) AS mark FROM waves GROUP BY wave),
timely AS (
  SELECT * FROM (
    SELECT w.*, (SELECT max(mark) FROM marks m WHERE m.wave < w.wave) AS before_it FROM waves w)
  WHERE before_it IS NULL OR poll > before_it),
placed AS (
  SELECT *, first_value(poll) OVER (PARTITION BY trade_id ORDER BY wave, poll) AS first_poll,
         row_number() OVER (PARTITION BY trade_id, poll) AS copy
  FROM timely),
admitted AS (SELECT * FROM placed WHERE copy = 1 AND (poll = first_poll OR {{again}})),
streamed AS (
  SELECT poll AS api_call_timestamp, product_id, {_MEASURES} FROM admitted GROUP BY ALL)"""


def _rows() -> str:
    return f"""api_call_timestamp AS api_call_timestamp_utc,
       date_trunc('hour', api_call_timestamp) AS api_call_timestamp_hour,
       product_id, {_COLUMNS}"""


def oracle_sql() -> dict[str, str]:
    base = _with()
    exact = _with(poll="ts")
    late = _with(more=_LATE.format(again=f"first_poll + {_SHORT} <= before_it"))
    ticks = f"SELECT poll AS api_call_timestamp, {_FIELDS} FROM"
    published = "api_call_timestamp <= (SELECT max(poll) FROM ticks) - INTERVAL 10 DAY"
    rules = ["api_call_timestamp_utc", "product_id", *_COLUMNS.split(", ")]
    window = "api_call_timestamp >= '2024-01-05 06:00:00' AND api_call_timestamp < '2024-01-20 18:00:00'"
    volume = """sum(share_volume) OVER (PARTITION BY product_id ORDER BY api_call_timestamp
                RANGE BETWEEN INTERVAL {span} HOUR PRECEDING AND CURRENT ROW) AS recent_volume"""
    change = """avg_share_price / nullif(lag(avg_share_price) OVER
                (PARTITION BY product_id ORDER BY api_call_timestamp), 0) - 1.0 AS price_change"""
    cents = "sum(CAST(round(TRY_CAST(price AS DOUBLE) * 100) AS BIGINT))"
    return {
        "explode_ticks": f"{base} {ticks} ticks",
        "dedup_first_poll": f"{base} {ticks} uniq",
        "dedup_by_product": f"""{base}
            SELECT poll AS api_call_timestamp, trade_id, product_id, price, size, side FROM ticks
            QUALIFY row_number() OVER (PARTITION BY product_id, trade_id ORDER BY poll) = 1""",
        "metrics_batch": f"{base} SELECT * FROM metrics",
        "metrics_with_repeats": f"{_with(source='ticks')} SELECT * FROM metrics",
        "metrics_decimal": f"""{_with(price="CAST(value AS VARCHAR)", size="CAST(value AS VARCHAR)")}
            SELECT poll AS api_call_timestamp, product_id, count(trade_id) AS num_trades,
                   count(*) FILTER (WHERE side = 'SELL') AS num_sell_trades,
                   count(*) FILTER (WHERE side = 'BUY') AS num_buy_trades,
                   CAST(sum(TRY_CAST(size AS DECIMAL(38,18))) AS DOUBLE) AS share_volume,
                   CAST((2 * {cents} + count(*)) // (2 * count(*)) AS DOUBLE) / 100 AS avg_share_price
            FROM uniq GROUP BY 1, 2""",
        "table_rows": f"{base} SELECT {_rows()} FROM metrics",
        "table_rows_narrow": f"""{base}
            SELECT api_call_timestamp AS api_call_timestamp_utc,
                   date_trunc('hour', api_call_timestamp) AS api_call_timestamp_hour, product_id,
                   CAST(num_trades AS INTEGER) AS num_trades,
                   CAST(num_sell_trades AS INTEGER) AS num_sell_trades,
                   CAST(num_buy_trades AS INTEGER) AS num_buy_trades,
                   CAST(share_volume AS FLOAT) AS share_volume,
                   CAST(avg_share_price AS FLOAT) AS avg_share_price
            FROM metrics""",
        "relational_rows": f"""{base}
            SELECT api_call_timestamp AS api_call_timestamp_utc,
                   api_call_timestamp AT TIME ZONE 'UTC' AT TIME ZONE '{ZONE}'
                     AS api_call_timestamp_local,
                   product_id, {_COLUMNS}
            FROM metrics""",
        "table_violations": _with(size=f"CASE event_type WHEN 'error' THEN '' ELSE {_SIZE} END")
        + "SELECT 'key not unique' AS rule, count(*) - count(DISTINCT (api_call_timestamp, product_id))"
        + " AS rows FROM metrics"
        + "".join(
            f" UNION ALL SELECT '{c} is null', count(*) FILTER (WHERE "
            f"{c.replace('timestamp_utc', 'timestamp')} IS NULL) FROM metrics"
            for c in rules
        )
        + " UNION ALL SELECT 'product_id too long',"
        + " count(*) FILTER (WHERE length(product_id) > 15) FROM metrics",
        "envelope_unwrap": f"{base} {ticks} ticks",
        "envelope_direct": f"{base} {ticks} ticks",
        "product_selection": f"{base} {ticks} ticks WHERE product_id IN ('P1', 'P3')",
        "rejected_records": f"""{base}
            SELECT event_id * 2 AS "offset", poll AS timestamp, 'not json' AS value
            FROM trades WHERE event_type = 'error'
            UNION ALL
            SELECT event_id * 2 + 1, poll + INTERVAL 10 DAY, 'not json'
            FROM trades WHERE event_type = 'error' AND event_id % 3 = 0""",
        "messages": f"""{exact}
            SELECT date_trunc('millisecond', api_call_timestamp) AS api_call_timestamp,
                   product_id, {_COLUMNS} FROM metrics""",
        "messages_lossless": f"{exact} SELECT * FROM metrics",
        "per_second": f"""{exact}
            SELECT date_trunc('second', poll) AS second, product_id, {_MEASURES}
            FROM uniq GROUP BY 1, 2""",
        "recent_volume": f"{base} SELECT *, {volume.format(span=1)} FROM metrics",
        "price_change": f"{base} SELECT *, {change} FROM metrics",
        "rolling_metrics": f"{base} SELECT *, {volume.format(span=6)}, {change} FROM metrics",
        "local_time": f"""{exact}
            SELECT trade_id, poll AS api_call_timestamp,
                   poll AT TIME ZONE 'UTC' AT TIME ZONE '{ZONE}' AS api_call_timestamp_local
            FROM uniq""",
        "batch_layer": f"""{base}
            SELECT {_rows()}, CAST(api_call_timestamp AS DATE) AS api_call_date FROM metrics""",
        "batch_refresh": f"""{base}
            SELECT {_rows()}, CAST(api_call_timestamp AS DATE) AS api_call_date FROM metrics""",
        "batch_refresh_lost_ids": f"""{base}
            SELECT {_rows()}, CAST(api_call_timestamp AS DATE) AS api_call_date FROM metrics""",
        "lookback": f"""{base}
            SELECT {_rows()} FROM metrics WHERE {window} AND product_id IN ('P0', 'P2')""",
        "serving_view": _with(
            more=f""",
accurate AS (SELECT * FROM metrics WHERE api_call_timestamp < '2024-01-16'),
rough AS (SELECT poll AS api_call_timestamp, product_id, {_MEASURES} FROM ticks GROUP BY ALL)"""
        )
        + f"""SELECT {_rows()}, 'batch' AS layer FROM accurate
            UNION ALL
            SELECT {_rows()}, 'speed' FROM rough WHERE api_call_timestamp >= '2024-01-16'""",
        "lambda_chain": f"""{base}
            SELECT {_rows()}, CASE WHEN api_call_timestamp < '2024-01-16' THEN 'batch' ELSE 'speed' END AS layer
            FROM metrics""",
        "speed_layer_append": f"{base} SELECT {_rows()} FROM metrics WHERE {published}",
        "speed_layer_one_lane": f"{base} SELECT {_rows()} FROM metrics WHERE {published}",
        "speed_layer_forever": f"{base} SELECT {_rows()} FROM metrics WHERE {published}",
        "speed_layer_upsert": f"{base} SELECT {_rows()} FROM metrics",
        "speed_layer_revisions": f"""{base}
            SELECT poll AS api_call_timestamp_utc, product_id,
                   count(DISTINCT event_id % 6 = 1) AS revisions
            FROM uniq GROUP BY 1, 2""",
        "speed_layer_late_append": f"{late} SELECT {_rows()} FROM streamed WHERE api_call_timestamp <= (SELECT max(mark) FROM marks)",
        "per_second_stream": f"""{late} SELECT {_rows()} FROM streamed
            WHERE api_call_timestamp + INTERVAL 1 SECOND <= (SELECT max(mark) FROM marks)""",
        "recent_volume_stream": f"""{late} SELECT *, {volume.format(span=5)} FROM streamed
            WHERE api_call_timestamp <= (SELECT max(mark) FROM marks)""",
        "speed_layer_readmission": f"{late} SELECT {_rows()} FROM streamed",
        "speed_layer_late_forever": f"{_with(more=_LATE.format(again='false'))} SELECT {_rows()} FROM streamed",
        "speed_layer_compacted": f"{base} SELECT {_rows()} FROM metrics",
        "speed_layer_folded": f"{base} SELECT {_rows()} FROM metrics",
        "messages_roundtrip": f"{base} SELECT * FROM metrics WHERE {published}",
        "landed_ticks": f"{base} {ticks} uniq",
        **CORPUS_SQL,
        **({"pipeline": PIPELINE_SQL} if PIPELINE_SQL else {}),
    }
