"""Session settings the toolkit relies on, and lineage cuts that survive lost executors."""

from __future__ import annotations

import codecs
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Times are UTC instants; names that differ by case alone are different columns.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.caseSensitive": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}


def session(name: str = "loomframe", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir.  Only a session on one machine may do without one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="loomframe-")
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and go on from the files."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, modification time in ms) of the files that `path` (file, folder or pattern) names, by name."""
    fs, where = _fs(spark, path)
    found = [s for s in (fs.globStatus(where) or [])]
    out = []
    for status in found:
        inner = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        out += [(str(s.getPath()), s.getLen(), s.getModificationTime()) for s in inner if s.isFile() and not str(s.getPath().getName()).startswith(("_", "."))]
    if not out:
        raise FileNotFoundError(path)
    return sorted(out)


def head_bytes(spark: SparkSession, path: str, most: int) -> bytes:
    """The first `most` bytes of a file that Spark can reach."""
    fs, where = _fs(spark, path)
    stream = fs.open(where)
    try:
        return bytes(stream.readNBytes(most))
    finally:
        stream.close()


def fresh(spark: SparkSession, name: str) -> str:
    """A path for new files in the shared folder; what is there goes when the driver ends."""
    folder = f"{shared_folder(spark)}/loomframe-{uuid.uuid4().hex}"
    fs, where = _fs(spark, folder)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return f"{folder}/{name}"


def spool(spark: SparkSession, data: bytes, name: str = "spooled.csv") -> str:
    """Put bytes into the shared folder, where all executors can read them."""
    target = fresh(spark, name)
    fs, where = _fs(spark, target)
    stream = fs.create(where, True)
    try:
        for at in range(0, len(data), 1 << 20):
            stream.write(bytearray(data[at : at + (1 << 20)]))
    finally:
        stream.close()
    return target


def _lines_end(stream, newline: bytes, lines: int, block: int = 1 << 16) -> tuple[int, int]:
    """(bytes of the first `lines` lines of a stream, lines that it had too few)."""
    width = len(newline)
    done = 0
    while lines:
        data = bytes(stream.readNBytes(block))
        at = 0
        while lines and (found := data.find(newline, at)) >= 0:
            if found % width:  # across two characters
                at = found + 1
                continue
            at, lines = found + width, lines - 1
        if not lines:
            return done + at, 0
        done += len(data)
        if len(data) < block:
            break
    return done, lines


def spool_body(spark: SparkSession, paths: list[str], mark: int, lines: int, encoding: str, name: str = "spooled.csv", target: str | None = None) -> str:
    """Copy files, one after the other, to the shared folder as UTF-8 without a mark of `mark` bytes and the first `lines` lines.

    The JVM streams the text, so inputs of any size take constant memory.
    """
    known = codecs.lookup(encoding).name
    if known in ("utf-16", "utf-32"):
        encoding = known = f"{known}-le"
    newline = "\n".encode(known)
    jvm = spark.sparkContext._jvm
    target = target or fresh(spark, name)
    fs, where = _fs(spark, target)
    writer = jvm.java.io.OutputStreamWriter(fs.create(where, True), "UTF-8")
    try:
        for path in paths:
            source, at = _fs(spark, path)
            stream = source.open(at)
            try:
                stream.seek(mark)
                skipped, lines = _lines_end(stream, newline, lines)
                stream.seek(mark + skipped)
                jvm.java.io.InputStreamReader(stream, encoding).transferTo(writer)
            finally:
                stream.close()
            mark = 0
    finally:
        writer.close()
    return target


def recoded(spark: SparkSession, paths: list[str], encoding: str) -> str:
    """A folder with UTF-8 copies of files, in their order."""
    folder = fresh(spark, "recoded")
    for k, path in enumerate(paths):
        spool_body(spark, [path], 0, 0, encoding, target=f"{folder}/{k:06d}.csv")
    return folder
