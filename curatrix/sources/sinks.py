"""Sinks: deterministic JSON lines, fingerprints of what was written, checkpoints."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the folder of spark.checkpoint.dir and read again, which cuts the lineage.

    Where that is unset, a local session gets a temporary folder for it; on a cluster, where
    executors share no local folder, it is an error.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        root = tempfile.mkdtemp(prefix="curatrix-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/curatrix-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forgotten(df: DataFrame) -> None:
    """Delete a checkpointed table that nothing reads any more."""
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def json_line(df: DataFrame) -> Column:
    """A row as JSON with sorted keys, at all levels, and no blanks; nulls are left out."""
    return F.to_json(F.parse_json(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]))))


def write_json_lines(df: DataFrame, path: str, *order: str, mode: str = "errorifexists") -> None:
    """Lines in a given order over range-partitioned files; refuses to overwrite by default."""
    line = json_line(df).alias("value")
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    ordered.select(line).write.mode(mode).text(path)


def write_splits(df: DataFrame, path: str, split: str, splits: tuple[str, ...], mode: str = "errorifexists") -> None:
    """A folder for each split, also for splits without rows."""
    for s in splits:
        write_json_lines(df.where(F.col(split) == s).drop(split), f"{path}/{split}={s}", mode=mode)


def content_set_hash(df: DataFrame, hash_col: Column) -> DataFrame:
    """sha256 of all row hashes with how often each occurs, folded over a tree of their prefixes.

    Equal hashes are counted first, so a content that many rows have is one entry. The sorted (hash, count) of each
    six-digit prefix are hashed, then the sorted (prefix, digest) of each four-digit one, each two-digit one and all; so a
    row holds a 16-millionth of the table's different hashes, or 256 digests. Note that the value differs from a single pass over all
    hashes; see ``content_set_hash_plain``. A null hash counts as row, but has no entry.
    """
    joined = lambda c: F.sha2(F.array_join(c, ""), 256).alias("d")
    counted = df.groupBy(hash_col.alias("h")).agg(F.count("*").alias("m"))
    entry = F.when(F.col("h").isNotNull(), F.concat("h", F.lit(":"), F.col("m").cast("string"), F.lit(";")))
    parts = counted.groupBy(F.substring("h", 1, 6).alias("p")).agg(joined(F.array_sort(F.collect_list(entry))), F.sum("m").alias("n"))
    digests = F.transform(F.array_sort(F.collect_list(F.struct("p", "d"))), lambda x: F.concat(x["p"], x["d"]))
    for size in (4, 2):
        parts = parts.groupBy(F.substring("p", 1, size).alias("q")).agg(joined(digests), F.sum("n").alias("n")).select(F.col("q").alias("p"), "d", "n")
    return parts.agg(joined(digests).alias("content_set_sha256"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))


def content_set_hash_plain(df: DataFrame, hash_col: Column) -> dict:
    """{count, sha256} of all row hashes in sorted order, streamed over sorted partitions to the driver.

    One digest over all rows in order can't be made in parts: a driver that reads 64 bytes a row is
    the price of that value. ``content_set_hash`` is the form for large tables.
    """
    digest, n = hashlib.sha256(), 0
    for row in df.select(hash_col.alias("h")).orderBy("h").toLocalIterator():
        digest.update(row.h.encode())
        n += 1
    return {"count": n, "sha256": digest.hexdigest()}


def file_fingerprints(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, bytes, sha256 of every file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def directory_fingerprint(spark: SparkSession, path: str) -> str:
    """One hash over the files' relative paths and hashes in path order (a row for each file)."""
    files = file_fingerprints(spark, path).orderBy("path").toLocalIterator()
    digest = hashlib.sha256()
    for f in files:
        digest.update(f"{f.path.rsplit(path.rstrip('/') + '/', 1)[-1]}\0{f.sha256}\0".encode())
    return digest.hexdigest()


def write_report(spark: SparkSession, report: dict, path: str, overwrite: bool = False) -> None:
    """A JSON object through Hadoop's file system; refuses to overwrite by default."""
    text = json.dumps(report, ensure_ascii=False, sort_keys=True, indent=2) + "\n"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(target, overwrite)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def open_sealed(spark: SparkSession, manifest: str, expected_sha256: str, marker: str) -> DataFrame:
    """The sealed manifest's text, once: a second opening and a changed manifest raise ValueError."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(marker)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p):
        raise ValueError("the seal has been opened before")
    found = file_fingerprints(spark, manifest).first()
    if found is None or found.sha256 != expected_sha256:
        raise ValueError("the manifest isn't the sealed one")
    write_report(spark, {"manifest_sha256": expected_sha256}, marker)
    return spark.read.text(manifest, wholetext=True)


def run_manifest(spark: SparkSession, inputs: dict[str, str], parameters: dict, repository: str | None = None, run_id: str = "", command: str = "") -> dict:
    """What a run was made from: versions, packages, session settings, a fingerprint of each input folder, and the
    commit and state of a git repository if one is named and can be read."""
    import importlib.metadata
    import platform

    settings = {r.key: r.value for r in spark.sql("SET").collect() if r.key.startswith("spark.sql.")}
    return {
        "run_id": run_id,
        "command": command,
        "versions": {"python": platform.python_version(), "spark": spark.version},
        "runtime": {"hostname": platform.node(), "platform": platform.platform()},
        "packages": sorted(f"{d.metadata['Name']}=={d.version}" for d in importlib.metadata.distributions()),
        "git": git_state(repository) if repository else None,
        "settings": settings,
        "parameters": parameters,
        "inputs": {name: directory_fingerprint(spark, path) for name, path in inputs.items()},
    }


def git_state(repository: str) -> dict | None:
    """commit, dirty and status of a repository; null where git can't tell."""
    import subprocess

    said = []
    for command in (("rev-parse", "HEAD"), ("status", "--short")):
        try:
            done = subprocess.run(["git", "-c", f"safe.directory={repository}", "-C", repository, *command], capture_output=True, text=True, timeout=60, check=True)
        except (OSError, subprocess.SubprocessError):
            return None
        said.append(done.stdout.strip())
    return {"commit": said[0], "dirty": bool(said[1]), "status": said[1]}
