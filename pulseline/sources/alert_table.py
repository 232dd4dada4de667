"""The alert table: alerts are added and addresses dismissed for good.

Every change is written to a folder of its own first and then named by one row of the change list. The row is one
file that appears at once, so readers see a change whole or not at all, and a writer that fails before it leaves nothing but a folder
that no one reads. A dismissal hides the alerts of its addresses that were added before it; later ones
show again. ``compact`` folds all changes into one, without what is hidden. One writer at a time is assumed; readers need no lock.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from pulseline.schema import ALERT_SCHEMA
from pulseline.session import work_dir

CHANGE_LIST = "seq bigint, kind string, folder string"
ADDED, DISMISSED, FOLDED = "added", "dismissed", "folded"


def _changes(spark: SparkSession, path: str) -> list:
    """The changes in order: one short row each since the table was last folded, and the folds."""
    try:
        rows = spark.read.schema(CHANGE_LIST).parquet(f"{path}/changes").collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = []
    rows = sorted(rows)
    last = max((i for i, r in enumerate(rows) if r.kind == FOLDED), default=0)
    return rows[last:]


def _commit(spark: SparkSession, path: str, kind: str, rows: DataFrame) -> None:
    seq = max((r.seq for r in _changes(spark, path)), default=0) + 1
    folder = f"{path}/data/{seq:08d}-{work_dir(spark, kind).rsplit('/', 1)[1]}"
    rows.write.parquet(folder)
    row = spark.createDataFrame([(seq, kind, folder)], CHANGE_LIST)
    row.coalesce(1).write.mode("append").parquet(f"{path}/changes")


def add_alerts(alerts: DataFrame, path: str) -> None:
    """Add alert documents."""
    rows = alerts.select(*[F.col(f.name).cast(f.dataType) for f in ALERT_SCHEMA])
    _commit(alerts.sparkSession, path, ADDED, rows)


def dismiss(ips: DataFrame, path: str) -> None:
    """Hide all alerts of the addresses (column ``ip``) that the table has now."""
    rows = ips.select(F.col("ip").cast("string")).filter("ip IS NOT NULL").distinct()
    _commit(ips.sparkSession, path, DISMISSED, rows)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """The alerts that are not dismissed; alerts without an address cannot be."""
    changes = _changes(spark, path)

    def rows(kinds: tuple[str, ...], schema) -> DataFrame:
        out = spark.createDataFrame([], schema).withColumn("seq", F.lit(0).cast("bigint"))
        for r in changes:
            if r.kind in kinds:
                one = spark.read.schema(schema).parquet(r.folder)
                out = out.unionByName(one.withColumn("seq", F.lit(r.seq).cast("bigint")))
        return out

    alerts = rows((ADDED, FOLDED), ALERT_SCHEMA)
    if not any(r.kind == DISMISSED for r in changes):
        return alerts.drop("seq")
    gone = rows((DISMISSED,), "ip string").groupBy(F.col("ip").alias("_ip")).agg(F.max("seq").alias("_until"))
    hidden = (F.col("ip") == F.col("_ip")) & (F.col("seq") < F.col("_until"))
    return alerts.join(gone, hidden, "left_anti").drop("seq")


def compact(spark: SparkSession, path: str) -> None:
    """Fold all changes into one folder; readers go on with the old ones until it is committed."""
    _commit(spark, path, FOLDED, read_alerts(spark, path))
