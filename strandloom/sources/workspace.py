"""The workspace: a catalogue of named tables with a journal."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
KINDS = ("nodes", "links", "reads", "kmer_counts", "read_paths", "threads", "mappings", "table")


@dataclass
class Operation:
    """One journal entry."""

    name: str
    tool: str
    detail: str
    ts: float = field(default_factory=time.time)
    entries: list[str] = field(default_factory=list)


class Workspace:
    """Named tables by kind; names are unique within a kind. Tables are immutable: replacing one gives a new version."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.tables: dict[str, dict[str, DataFrame]] = {k: {} for k in KINDS}
        self.journal: list[Operation] = []

    def add(self, kind: str, name: str, df: DataFrame, replace: bool = False) -> DataFrame:
        if kind not in self.tables:
            raise KeyError(f"unknown kind: {kind}")
        if name in self.tables[kind] and not replace:
            raise ValueError(f"{kind} already has a table named {name}")
        self.tables[kind][name] = df
        return df

    def get(self, kind: str, name: str) -> DataFrame:
        if name not in self.tables[kind]:
            raise KeyError(f"no {kind} named {name}; there are: {', '.join(self.names(kind))}")
        return self.tables[kind][name]

    def names(self, kind: str) -> list[str]:
        return sorted(self.tables[kind])

    def add_operation(self, name: str, tool: str, detail: str) -> Operation:
        self.journal.append(Operation(name, tool, detail))
        return self.journal[-1]

    def journal_table(self) -> DataFrame:
        rows = [(i, o.name, o.ts, o.tool, o.detail, o.entries) for i, o in enumerate(self.journal)]
        t = self.spark.createDataFrame(rows, "op_id int, name string, ts double, tool string, detail string, entries array<string>")
        return t.withColumn("ts", F.timestamp_seconds("ts"))

    def dump(self, path: str, graph_only: bool = False) -> None:
        """K3: tables as Parquet below a fresh version folder, then the manifest, which makes the version visible at once."""
        version = uuid.uuid4().hex
        manifest = {"format": VERSION, "version": version, "tables": [], "journal": [o.__dict__ for o in self.journal]}
        for kind, named in self.tables.items():
            if graph_only and kind not in ("nodes", "links"):
                continue
            for name, df in named.items():
                where = f"{version}/{kind}/{len(manifest['tables'])}"
                df.write.parquet(f"{path}/{where}")
                manifest["tables"].append({"kind": kind, "name": name, "path": where})
        fs, base = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        with fs.open_output_stream(f"{base}/_manifest-{version}") as f:
            f.write(json.dumps(manifest).encode())
        fs.move(f"{base}/_manifest-{version}", f"{base}/manifest.json")

    @classmethod
    def load(cls, spark: SparkSession, path: str, journal_only: bool = False) -> Workspace:
        """A dumped workspace; another format raises."""
        fs, base = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        with fs.open_input_stream(f"{base}/manifest.json") as f:
            manifest = json.loads(f.read())
        if manifest.get("format") != VERSION:
            raise ValueError(f"not a workspace of format {VERSION}: {path}")
        ws = cls(spark)
        ws.journal = [Operation(**o) for o in manifest["journal"]]
        for t in [] if journal_only else manifest["tables"]:
            ws.add(t["kind"], t["name"], spark.read.parquet(f"{path}/{t['path']}"))
        return ws

    def ls(self, level: int = 0, recursive: bool = True) -> str:
        """K6: an indented summary; counts rows only where ``recursive``."""
        pad = "  " * level
        out = [f"{pad}Workspace"]
        for kind, named in self.tables.items():
            if named:
                out.append(f"{pad}  {kind}: {len(named)}")
                out += [f"{pad}    {n}: {df.count()} rows" for n, df in sorted(named.items())] if recursive else []
        return "\n".join(out)
