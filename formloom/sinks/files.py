"""Rows to whole files: one group of rows becomes one file's bytes."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formloom.session import small_batches
from formloom.sinks.subtitle import by_file


def build(rows: DataFrame, keys: list[str], order: str, make: Callable[[pd.DataFrame], bytes]) -> DataFrame:
    """keys and content: make gets a file's rows in order. A file is built in one task, as its bytes are one value."""
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("content", T.BinaryType())])

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, make(f.sort_values(order, kind="stable"))]], columns=schema.names)

    return by_file(rows, keys).groupBy(*keys).applyInPandas(run, schema)


def build_each(rows: DataFrame, keys: list[str], column: str, make: Callable[[str], bytes]) -> DataFrame:
    """keys and content: a file of each row's value, without an exchange; rows with the same keys are files of their own."""
    small_batches(rows.sparkSession)

    @F.pandas_udf("binary")
    def made(s: pd.Series) -> pd.Series:
        return s.map(make, na_action="ignore")

    return rows.select(*keys, made(column).alias("content"))


def save(files: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """Write each file into folder (any URI that pyarrow knows) and return name and bytes written.

    A file appears under its name only when it is whole: it is written aside and then moved, so a
    task that is lost or repeated leaves no part of one.
    """

    def run(frames):
        from pyarrow import fs
        from pyspark import TaskContext

        files_, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        files_.create_dir(root, recursive=True)
        mark = TaskContext.get().taskAttemptId()
        for f in frames:
            out = []
            for n, c in zip(f["n"], f["c"], strict=True):
                with files_.open_output_stream(f"{root}/.{mark}-{len(out)}.part") as s:
                    s.write(bytes(c))
                files_.move(f"{root}/.{mark}-{len(out)}.part", f"{root}/{n}")
                out.append((n, len(c)))
            yield pd.DataFrame(out, columns=["name", "written"])

    return files.select(F.col(name).alias("n"), F.col(content).alias("c")).mapInPandas(run, "name string, written long")
