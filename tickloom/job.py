"""The whole job: speed layer, landed ticks, message echo and upkeep, until one ends.

    python -m tickloom.job --folder /shared/trades [--raw FOLDER] [--available-now] [--upkeep MINUTES]

Names of topics, broker and store come from the environment. With a broker the
raw topic is read from it; otherwise from files of the same shape under ``--raw``.
Every ``--upkeep`` minutes the keyed table is folded and the batch layer corrected.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from tickloom.params import JobParams, build_session
from tickloom.streaming.jobs import await_any, land_ticks, run_to_end, start_message_echo, start_speed_layer
from tickloom.upkeep import upkeep
from tickloom.workspace import make_folder


def _messages(spark: SparkSession, params: JobParams, folder: str) -> str | None:
    return None if params.source == "kafka" else make_folder(spark, f"{folder}/messages")


def start_writers(spark: SparkSession, params: JobParams, folder: str, raw: str | None = None) -> list[StreamingQuery]:
    """Start the queries that read the raw topic: speed layer and landed ticks."""
    params.require_names()
    messages, marks = _messages(spark, params, folder), f"{folder}/checkpoints"
    return [
        start_speed_layer(
            spark, params, f"{marks}/speed", f"{folder}/table", raw, messages, "speed", accounts=f"{folder}/accounts"
        ),
        land_ticks(spark, params, f"{marks}/landed", f"{folder}/ticks", raw, "landed"),
    ]


def start_echo(spark: SparkSession, params: JobParams, folder: str, echo: str | None = None) -> StreamingQuery:
    """Start the query that reads the messages; to the console, or to files under ``echo``."""
    messages = _messages(spark, params, folder)
    return start_message_echo(spark, params, f"{folder}/checkpoints/echo", messages, echo, "echo")


def start(
    spark: SparkSession, params: JobParams, folder: str, raw: str | None = None, echo: str | None = None
) -> list[StreamingQuery]:
    """Start all three queries; tables and checkpoints go below ``folder``."""
    return [*start_writers(spark, params, folder, raw), start_echo(spark, params, folder, echo)]


def run_through(
    spark: SparkSession, params: JobParams, folder: str, raw: str | None = None, echo: str | None = None
) -> None:
    """Process what is there, in order: the echo starts when the messages are all written."""
    for query in start_writers(spark, params, folder, raw):
        run_to_end(query)
    run_to_end(start_echo(spark, params, folder, echo))
    upkeep(spark, params, folder)


def run(params: JobParams, folder: str, raw: str | None = None, minutes: float = 30) -> None:
    """Build the session, start the queries and wait; upkeep every so many minutes."""
    params.require_names()
    spark = build_session(params)
    if params.available_now:
        run_through(spark, params, folder, raw)
    else:
        await_any(start(spark, params, folder, raw), 60 * minutes, lambda: upkeep(spark, params, folder))


def main(arguments=None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--folder", required=True, help="shared folder of tables and checkpoints")
    parser.add_argument("--raw", help="folder of raw records, without a broker")
    parser.add_argument("--trigger", help="interval between batches, such as '5 seconds'")
    parser.add_argument("--available-now", action="store_true", help="process what is there and end")
    parser.add_argument("--upkeep", type=float, default=30, help="minutes between two passes of upkeep")
    parser.add_argument("--starting-offsets", default="latest", help="where a first start begins")
    parser.add_argument("--output-mode", default="append", choices=("append", "update"))
    options = parser.parse_args(arguments)
    params = JobParams.from_env(
        source="files" if options.raw else "kafka",
        trigger_interval=options.trigger,
        available_now=options.available_now,
        starting_offsets=options.starting_offsets,
        output_mode=options.output_mode,
    )
    run(params, options.folder, options.raw, options.upkeep)


if __name__ == "__main__":
    main()
