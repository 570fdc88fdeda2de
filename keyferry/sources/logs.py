"""Log files of the form ``[time] [LEVEL] [req:..] [task:..] [source] message {json}``."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the line format.
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSS"
LINE_PATTERN = (
    r"(?s)^\[([^\]]*)\] \[([A-Z]+)\](?: \[req:([^\]]*)\])?(?: \[task:([^\]]*)\])?(?: \[([^\]]*)\])?"
    r" (.*?)(?: (\{\".*\}))?\z"
)
EXPORT_TITLE = "=== Log Export ==="
STACK_TITLE = "Stack Trace:"
RULE = "=" * 50


def scan_log_text(lines: DataFrame) -> DataFrame:
    """Parse a column ``value`` with one log line per row. Other lines (titles, stacks) are left out.

    One match per line: its groups are written one under the other, which no line can contain, and split.
    """
    names = ["timestamp", "level", "request_id", "task_id", "source", "message", "fields"]
    groups = "\n".join(f"${i + 1}" for i in range(len(names)))
    parts = lines.select(F.split(F.regexp_replace("value", LINE_PATTERN, groups), "\n").alias("part"))
    required = ("timestamp", "level", "message")

    def field(index: int, name: str) -> Column:
        text = F.col("part")[index]
        return (text if name in required else F.nullif(text, F.lit(""))).alias(name)

    return parts.filter(F.size("part") == len(names)).select(*[field(i, name) for i, name in enumerate(names)])


def read_log_text(spark: SparkSession, path: str) -> DataFrame:
    return scan_log_text(spark.read.text(path))


def log_line(stacks: bool = False, id_length: int | None = None) -> Column:
    """The text line of a log row, followed by its stack when ``stacks`` is set.

    Request and task ids are written whole, or cut to ``id_length`` characters. A null message is an empty one.
    """

    def shown(name: str) -> Column:
        return F.substring(name, 1, id_length) if id_length else F.col(name)

    def tagged(text: Column, prefix: str = "") -> Column:
        return F.when(F.length(text) > 0, F.concat(F.lit(f" [{prefix}"), text, F.lit("]")))

    line = F.concat(
        F.format_string("[%s] [%s]", "timestamp", "level"),
        F.coalesce(tagged(shown("request_id"), "req:"), F.lit("")),
        F.coalesce(tagged(shown("task_id"), "task:"), F.lit("")),
        F.coalesce(tagged(F.col("source")), F.lit("")),
        F.lit(" "),
        F.coalesce("message", F.lit("")),
        F.coalesce(F.when(F.length("fields") > 0, F.concat(F.lit(" "), F.col("fields"))), F.lit("")),
    )
    if not stacks:
        return line
    return F.when(F.length("stack") > 0, F.concat_ws("\n", line, F.lit(STACK_TITLE), F.col("stack"))).otherwise(line)
