"""Commit protocol for a folder that several tables of one run go to.

    out/<table>/attempt=<attempt>/   what a run wrote
    out/log/<attempt>.json           the entry that commits it: its tables, renamed into place as one small file

Files of an attempt without an entry do not count: readers go through `folders`, and the next run removes them first. A run
may die anywhere; before its entry nothing of it is seen, after it everything is. One run at a time writes to a folder.
"""

from __future__ import annotations

import json

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from ..sources.recordings import filesystem

#: Tables of which only the last committed attempt counts.
LATEST = ("failures",)


def _children(path: str) -> list[str]:
    fs, p = filesystem(path)
    return sorted(i.base_name for i in fs.get_file_info(pafs.FileSelector(p, allow_not_found=True)))


def entries(out_dir: str) -> dict[str, list[str]]:
    """Committed attempts, oldest first, with the tables each of them holds."""
    fs, p = filesystem(f"{out_dir}/log")
    out = {}
    for name in _children(f"{out_dir}/log"):
        if name.endswith(".json") and not name.startswith("."):
            with fs.open_input_stream(f"{p}/{name}") as f:
                out[name.removesuffix(".json")] = json.loads(f.read())["tables"]
    return out


def _counts(table: str, attempt: str, log: dict[str, list[str]]) -> bool:
    holders = [a for a, tables in log.items() if table in tables]
    return attempt in holders and (table not in LATEST or attempt == holders[-1])


def folders(out_dir: str, table: str) -> list[str]:
    """Folders of a table that count, oldest first."""
    log = entries(out_dir)
    return [f"{out_dir}/{table}/attempt={a}" for a in log if _counts(table, a, log)]


def read(spark: SparkSession, out_dir: str, table: str, schema=None) -> DataFrame | None:
    """Committed rows of a table, or None if no attempt holds it."""
    found = folders(out_dir, table)
    reader = spark.read.option("basePath", f"{out_dir}/{table}")
    return (reader.schema(schema) if schema else reader).parquet(*found).drop("attempt") if found else None


def recover(out_dir: str, tables: tuple[str, ...]) -> None:
    """Remove what no entry names."""
    log = entries(out_dir)
    for table in tables:
        fs, p = filesystem(f"{out_dir}/{table}")
        for name in _children(f"{out_dir}/{table}"):
            if name.startswith("attempt=") and not _counts(table, name.removeprefix("attempt="), log):
                fs.delete_dir(f"{p}/{name}")


def begin(out_dir: str, tables: tuple[str, ...]) -> str:
    """Name of a new attempt; leftovers of broken ones are gone afterwards."""
    recover(out_dir, tables)
    last = max((int(a[1:]) for a in entries(out_dir)), default=0)
    return f"a{last + 1:06d}"


def commit(out_dir: str, attempt: str, tables: list[str]) -> None:
    """Write the entry under another name, then rename it: it is there whole or not at all."""
    fs, p = filesystem(f"{out_dir}/log")
    fs.create_dir(p, recursive=True)
    with fs.open_output_stream(f"{p}/.{attempt}") as f:
        f.write(json.dumps({"tables": tables}).encode())
    fs.move(f"{p}/.{attempt}", f"{p}/{attempt}.json")
