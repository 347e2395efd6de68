"""Text sinks of the analyses: unquoted comma-separated lines without a header."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Output name that stands for the standard output.
STDOUT = "-"


def lines(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(F.concat_ws(",", *[F.col(c).cast("string") for c in columns or df.columns]).alias("value"))


def write_lines(df: DataFrame, path: str, *columns: str, order: list[str] | None = None, one_file: bool = False) -> None:
    """Overwrite ``path``, or print to the standard output if it is ``-``.

    With ``order`` the lines are globally sorted. They are written by many tasks
    into a folder of part files; ``one_file`` joins these, in order, to one file."""
    ready = lines(df.orderBy(*order) if order else df, *columns)
    if path == STDOUT:
        for r in ready.toLocalIterator():  # one partition at a time
            sys.stdout.write(r["value"] + "\n")
        return
    if not one_file:
        ready.write.mode("overwrite").text(path)
        return
    parts = path.rstrip("/") + ".parts"
    ready.write.mode("overwrite").text(parts)
    _joined(df, parts, path)


def _joined(df: DataFrame, parts: str, path: str) -> None:
    """One file of the part files' bytes, streamed by the driver; the parts are removed."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    folder, target = jvm.org.apache.hadoop.fs.Path(parts), jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    fs.delete(target, True)
    out = fs.create(target, True)
    for name in sorted(s.getPath().toString() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")):
        part = fs.open(jvm.org.apache.hadoop.fs.Path(name))
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
        part.close()
    out.close()
    fs.delete(folder, True)
