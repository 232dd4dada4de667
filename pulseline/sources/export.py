"""Exports of profiles and reports."""

from pyspark.sql import DataFrame

from pulseline.functions.text import clip

# Clip lengths and marks of the exported text columns.
SHORT_TEXT = (50, "..")
PATH_TEXT = (500, "...")


def clip_columns(df: DataFrame, short=(), paths=()) -> DataFrame:
    """Shorten the named text columns for export."""
    cut = {c: clip(c, *SHORT_TEXT) for c in short} | {c: clip(c, *PATH_TEXT) for c in paths}
    return df.withColumns(cut) if cut else df


def export_csv(df: DataFrame, path: str, short=(), paths=(), mode: str = "error") -> None:
    """CSV with a header in every part file, quotes doubled."""
    (
        clip_columns(df, short, paths)
        .write.mode(mode)
        .option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .csv(path)
    )


def export_json(df: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON object per line, null fields kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
