"""Tables in versions: a numbered manifest names the folder that holds the present one.

A version is written to a folder of its own and then published by a manifest ``_version-<number>.json``, which is
put in place by one rename that fails if the number is taken. So a reader sees the old version or the new one, never a
part; a rename of data is not needed, which object stores would copy; and of two writers one is told. The version
before the present one stays for readers that have begun; older ones go.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession

from newslab.sources.paths import located

_NAME = re.compile(r"_version-(\d{12})\.json")


@dataclass(frozen=True)
class Version:
    number: int
    folder: str  # within the table's path
    facts: dict  # what a reader must know of the layout


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = located(spark, path)
    if not fs.exists(at):
        return []
    return [f.getPath().getName() for f in fs.listStatus(at)]


def versions(spark: SparkSession, path: str) -> list[Version]:
    """All published versions that are still there, the present one last."""
    found = []
    for number in sorted(int(m[1]) for m in map(_NAME.fullmatch, _names(spark, path)) if m):
        fs, at = located(spark, f"{path}/_version-{number:012d}.json")
        stream = fs.open(at)
        try:
            said = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        found.append(Version(number, said["folder"], said["facts"]))
    return found


def current(spark: SparkSession, path: str) -> Version | None:
    found = versions(spark, path)
    return found[-1] if found else None


def new_folder() -> str:
    return f"data-{uuid.uuid4().hex}"


def publish(spark: SparkSession, path: str, folder: str, after: Version | None, facts: dict | None = None) -> Version:
    """Make ``folder`` the present version, if ``after`` (None: no version) still is. Otherwise somebody else published
    in between, and this is an error."""
    version = Version(after.number + 1 if after else 0, folder, facts or {})
    target = f"{path}/_version-{version.number:012d}.json"
    fs, draft = located(spark, f"{path}/_draft-{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    try:
        stream.write(bytearray(json.dumps({"folder": folder, "facts": version.facts}).encode()))
    finally:
        stream.close()
    jvm = spark._jvm
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    _, place = located(spark, target)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(place).toUri(), spark._jsc.hadoopConfiguration())
    try:
        files.rename(fs.makeQualified(draft), fs.makeQualified(place), none)
    except Exception as error:
        fs.delete(draft, False)
        if fs.exists(place):
            raise FileExistsError(f"another version of {path} was published meanwhile") from error
        raise
    return version


def forget_old(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete all but the newest ``keep`` versions, manifest first, and folders that no manifest names are left alone: they
    may be a version that is being written."""
    for old in versions(spark, path)[:-keep]:
        fs, at = located(spark, f"{path}/_version-{old.number:012d}.json")
        fs.delete(at, False)
        fs.delete(located(spark, f"{path}/{old.folder}")[1], True)
