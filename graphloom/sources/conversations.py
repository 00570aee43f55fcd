"""Transcript files and documents as tables."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, transcript


def project_key(path: str) -> str:
    """Folder name of a project's transcripts."""
    return path.rstrip("/").replace("/", "-")


def find_project(root: str, path: str) -> str | None:
    """The folder of a project: its key, else the first whose name holds the project's base name. A listing on the driver."""
    top = Path(root)
    if (top / project_key(path)).is_dir():
        return str(top / project_key(path))
    base = path.rstrip("/").rsplit("/", 1)[-1]
    return next((str(d) for d in sorted(top.iterdir()) if d.is_dir() and base in d.name), None) if top.is_dir() else None


def list_projects(root: str) -> list[str]:
    return sorted(d.name.replace("-", "/") for d in Path(root).iterdir() if d.is_dir())


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages of all transcript files of a folder, streaming repeats merged."""
    lines = spark.read.text(path, wholetext=True, pathGlobFilter="*.jsonl").select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
    return transcript.dedup_turns(transcript.parse_lines(lines.withColumn("line_no", F.col("line_no").cast("long"))))


def conversations(messages: DataFrame, most: int = 50_000) -> DataFrame:
    """(session_id, text) of sessions worth reading: three messages or more, not automated, with some substantive text."""
    counts = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    real = counts.join(transcript.automated(messages).where("not automated"), "session_id").select("session_id")
    return transcript.substantive_text(messages.join(real, "session_id", "left_semi"), most).where("text <> ''")


def summaries(messages: DataFrame, preview: int = 200) -> DataFrame:
    """(session_id, messages, preview) of each session."""
    head = transcript.flow_text(messages, preview).withColumnRenamed("text", "preview")
    return messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("messages")).join(head, "session_id")


def session_text(messages: DataFrame, mode: str = "substantive", most: int = 50_000) -> DataFrame:
    """(session_id, text) by mode: user, all or substantive."""
    make = {"user": transcript.user_text, "all": transcript.flow_text, "substantive": transcript.substantive_text}[mode]
    return make(messages, most)


def _there(spark: SparkSession, path: str) -> bool:
    """Whether a path of any of Hadoop's file systems is there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return len(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target) or []) > 0


def documents(spark: SparkSession, paths: list[str], target: int = 4000, overlap: int = 500) -> DataFrame:
    """Chunks (path, text, index, start_offset, end_offset) of whole text files, of local paths or any URI that Hadoop reads; missing paths are left out."""
    there = [p for p in paths if _there(spark, p)]
    if not there:
        return spark.createDataFrame([], "path string, text string, index long, start_offset long, end_offset long")
    raw = spark.read.text(there, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    keyed = raw.withColumn("doc_id", F.xxhash64("path"))
    return text.chunk_table(keyed).join(keyed.select(F.col("doc_id").alias("id"), "path"), "id").drop("id")
