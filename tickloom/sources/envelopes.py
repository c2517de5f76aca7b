"""Poll responses to topic records."""

from pyspark.sql import DataFrame, functions as F

from tickloom.functions.parsing import trades_of


def unwrap_envelope(responses: DataFrame) -> DataFrame:
    """Replace each response body by the text of its ``trades`` array.

    Everything else in the response is dropped. The text is JSON, so a null
    field stays a null field. A body without trades gets a null value. To parse
    in one pass use ``parse_ticks(responses, enveloped=True)``.
    """
    trades = trades_of(F.col("value"), enveloped=True)
    return responses.withColumn("value", F.to_json(trades).cast("binary"))
