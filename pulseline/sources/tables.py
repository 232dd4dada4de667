"""The activity table in Parquet, verdict reports and alert documents."""

import csv
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulseline.schema import ACTIVITY_SCHEMA, ALERT_SCHEMA, VERDICT_COLUMNS

# Marks of template rows that carry no real address or threat.
PLACEHOLDER_IP = r"<IP>|&lt;IP&gt;|\[IP\]"
PLACEHOLDER_THREAT = r"<threat_type>|&lt;threat_type&gt;"
FENCE = r"```(csv)?"


def write_activity(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append activity rows, one folder per day, clustered by host and time.

    The range split is on (day, host, time), so a busy host is spread over several
    files by time and every file covers a narrow range that scans can skip.
    """
    keys = ["date_num", "hostname", "timestamp"]
    (
        df.select(*ACTIVITY_SCHEMA.fieldNames())
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date_num")
        .parquet(path)
    )


def read_activity(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.schema(ACTIVITY_SCHEMA).parquet(path).select(*ACTIVITY_SCHEMA.fieldNames())
    )


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"))


def report_rows(text: str) -> list[dict[str, str | None]]:
    """The rows of one report by column name; its first row names the columns."""
    body = re.sub(FENCE, "", text)
    lines = [row for row in csv.reader(io.StringIO(body.strip())) if any(c.strip() for c in row)]
    if not lines:
        return []
    names = [c.strip() for c in lines[0]]
    place = {name: names.index(name) for name in VERDICT_COLUMNS if name in names}
    return [
        {name: (row[i] or None) if i < len(row) else None for name, i in place.items()}
        for row in lines[1:]
    ]


def load_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """Verdict reports: CSV text, possibly fenced, with the header in any column order.

    A report is parsed whole, so quoted cells may hold line breaks and it may have any number of columns;
    reports are documents of a reader's size, many of which are read at a time. ``line_no`` orders the rows of
    a report; reports are ordered by ``report``, their file path. Template rows are dropped.
    """
    reports = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("report"), "value"
    )
    names = ["report", "line_no", *VERDICT_COLUMNS]
    types = [pa.string(), pa.int64(), *[pa.string()] * len(VERDICT_COLUMNS)]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for report, text in zip(*(batch.column(c).to_pylist() for c in ("report", "value"))):
                rows = report_rows(text)
                cells = [[row.get(c) for row in rows] for c in VERDICT_COLUMNS]
                columns = [[report] * len(rows), list(range(1, len(rows) + 1)), *cells]
                arrays = [pa.array(c, t) for c, t in zip(columns, types)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "report string, line_no bigint, " + ", ".join(f"{c} string" for c in VERDICT_COLUMNS)
    ip = F.coalesce(F.col("ip"), F.lit(""))
    threat = F.coalesce(F.col("threat_type"), F.lit(""))
    return reports.mapInArrow(parse, schema).filter(
        ~ip.rlike(PLACEHOLDER_IP) & ~threat.rlike(PLACEHOLDER_THREAT)
    )


def load_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Alert documents, one JSON object per line.

    Every line that is a JSON object counts, whichever columns are read; a field of another type than
    expected is null. Other lines are skipped.
    """
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in ALERT_SCHEMA])
    lines = spark.read.text(path)
    # In brackets, so that text behind the object makes the line malformed.
    parsed = lines.select(
        F.from_json(F.concat(F.lit("["), "value", F.lit("]")), T.ArrayType(texts)).alias("a")
    ).filter("size(a) = 1 AND a[0] IS NOT NULL")
    return parsed.select(
        *[F.col("a")[0][f.name].try_cast(f.dataType).alias(f.name) for f in ALERT_SCHEMA]
    )
