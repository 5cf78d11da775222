"""Numbered versions of a table folder, with an optimistic commit.

A version is one small JSON file ``_versions/<number>.json``.  Files are only ever added,
and a number can be taken once: the content is written under a name of its own first and
then given the number's name, which fails if that exists (an atomic rename without
overwriting in a Hadoop file system, a hard link in a local one).  A writer that worked
from version n commits n + 1; if another was faster it gets ``LostRace`` and must look at
the newer version.  Readers only ever see complete versions.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

FOLDER = "_versions"


class LostRace(RuntimeError):
    """Another writer has committed the version first."""


def _system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _name(number: int) -> str:
    return f"{number:012d}.json"


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """All committed versions, ascending."""
    fs, where = _system(spark, os.path.join(folder, FOLDER))
    if not fs.exists(where):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(where)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json"))


def read(spark: SparkSession, folder: str, number: int) -> dict:
    fs, where = _system(spark, os.path.join(folder, FOLDER, _name(number)))
    stream = fs.open(where)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def live(spark: SparkSession, folder: str) -> dict | None:
    """The newest version with its ``number``, or None."""
    found = numbers(spark, folder)
    return read(spark, folder, found[-1]) | {"number": found[-1]} if found else None


def commit(spark: SparkSession, folder: str, number: int, content: dict) -> dict:
    """Make ``content`` version ``number``, or raise ``LostRace`` if there is one already."""
    jvm = spark._jvm
    fs, to = _system(spark, os.path.join(folder, FOLDER, _name(number)))
    fs.mkdirs(to.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(to.getParent(), f".draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(json.dumps({k: v for k, v in content.items() if k != "number"}).encode())
    out.close()
    try:
        if fs.getScheme() == "file":
            os.link(draft.toUri().getPath(), to.toUri().getPath())
        else:
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, to, none)
    except Exception as e:
        if isinstance(e, FileExistsError) or fs.exists(to):
            raise LostRace(f"version {number} of {folder} is taken") from e
        raise
    finally:
        fs.delete(draft, False)  # gone after a rename, spare after a link or a lost race
    return content | {"number": number}


def update(spark: SparkSession, folder: str, change: Callable[[dict | None], dict], attempts: int = 20) -> dict:
    """Commit ``change(newest version)``; after a lost race, of the version that won."""
    for _ in range(attempts):
        now = live(spark, folder)
        content = change(now)
        try:
            return commit(spark, folder, now["number"] + 1 if now else 1, content)
        except LostRace:
            continue
    raise LostRace(f"{attempts} attempts to commit to {folder} were all overtaken")
