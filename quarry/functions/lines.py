"""Lines and overlapping line windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The breaks that end a line.
BREAK = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C\\x1D\\x1E\\x85\\u2028\\u2029]"


def decoded(content: Column) -> Column:
    """Bytes as UTF-8, with what is invalid replaced."""
    return F.make_valid_utf8(content.cast("string"))


def lines(text: Column) -> Column:
    """The lines of a text; a break at its end begins no further line, and an empty text has none."""
    whole = F.split(F.regexp_replace(text, f"(?:{BREAK})\\z", ""), BREAK, -1)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(whole)


def check_window(window: int, overlap: int) -> None:
    if window <= 0:
        raise ValueError("the window must have at least one line")
    if not 0 <= overlap < window:
        raise ValueError("the overlap must be at least 0 and less than the window")


def window_count(n: Column, window: int, overlap: int) -> Column:
    """How many windows n lines make: the one that reaches the end is the last."""
    step = window - overlap
    return F.when(n <= 0, 0).when(n <= window, 1).otherwise(F.ceil((n - window) / step) + 1).cast("int")


def windows(all_lines: Column, window: int, overlap: int) -> Column:
    """Array of (chunk_index, start_line, end_line, content) of an array column of lines."""
    check_window(window, overlap)
    n, step = F.size(all_lines), window - overlap
    count = window_count(n, window, overlap)

    def one(i: Column) -> Column:
        return F.struct(
            i.alias("chunk_index"),
            (i * step + 1).alias("start_line"),
            F.least(i * step + window, n).alias("end_line"),
            F.array_join(F.slice(all_lines, i * step + 1, F.lit(window)), "\n").alias("content"),
        )

    return F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")), one)


def chunk_checksum(path: Column, start: Column, end: Column, content: Column) -> Column:
    return F.sha2(F.concat_ws("\n", path, start.cast("string"), end.cast("string"), content), 256)
