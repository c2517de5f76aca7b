"""Text to number, once and explicitly."""

from pyspark.sql import Column, functions as F

# The two number types a caller can choose.
NUMBER_TYPES = {"double": "double", "decimal": "decimal(38,18)"}


def to_number(column: str | Column, numbers: str = "double") -> Column:
    """Cast text to a number; text that is not a number becomes null.

    A plain cast fails the job under ANSI mode on the first empty string.
    ``decimal`` keeps sums exact and independent of the order of rows.
    """
    column = F.col(column) if isinstance(column, str) else column
    return column.try_cast(NUMBER_TYPES[numbers])
