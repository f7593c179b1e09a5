"""Project catalogue: folder names, order, recent list; records are JSON files in one folder."""

from __future__ import annotations

import json
import os
import re
import shutil
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.codec import slug

RECENT = 10


def unique_slugs(names: DataFrame) -> DataFrame:
    """names (key, name) with a folder for each: repeats get -2, -3 and so on in the order of key."""
    rows = names.withColumn("slug", slug(F.col("name")))
    k = F.row_number().over(W.partitionBy("slug").orderBy("key"))
    return rows.withColumn("k", k).select("key", "name", F.concat("slug", F.when(F.col("k") > 1, F.concat(F.lit("-"), F.col("k").cast("string"))).otherwise("")).alias("folder"))


def newest_first(projects: DataFrame) -> DataFrame:
    """projects (key, created_at string) with their place, newest first, ties by key."""
    return projects.withColumn("place", F.row_number().over(W.orderBy(F.desc("created_at"), "key")))


def recent(touches: DataFrame, most: int = RECENT) -> DataFrame:
    """touches (path, at): the paths touched last, each once, newest first."""
    last = touches.groupBy("path").agg(F.max("at").alias("at"))
    return last.orderBy(F.desc("at"), "path").limit(most)


def data_folder() -> Path:
    """Where projects are kept: POINTLOOM_HOME, or a folder in the user's home; the working folder without one."""
    if own := os.environ.get("POINTLOOM_HOME"):
        return Path(own)
    home = os.environ.get("HOME")
    return (Path(home) if home else Path.cwd()) / ".pointloom"


class ProjectFolder:
    """A folder of projects; a project is a folder with project.json. Entries whose folder is gone drop out of the list."""

    def __init__(self, root: str | None = None):
        self.root = Path(root) if root else data_folder()

    @staticmethod
    def _slug(name: str) -> str:
        return (re.sub(r"[^A-Za-z0-9_ -]", "", name).replace(" ", "_") or "project")[:64]

    @staticmethod
    def read(path: str) -> dict | None:
        try:
            found = json.loads((Path(path) / "project.json").read_text())
        except (OSError, ValueError):
            return None
        return {"name": found.get("name", ""), "path": str(path), "sourceFile": found.get("sourceFile", ""), "createdAt": found.get("createdAt", "")}

    def create(self, name: str, source: str = "") -> dict:
        base = self._slug(name)
        folder, k = base, 1
        while (self.root / "projects" / folder).exists():
            k += 1
            folder = f"{base}-{k}"
        path = self.root / "projects" / folder
        path.mkdir(parents=True)
        record = {"version": 1, "name": name, "path": str(path), "sourceFile": source, "createdAt": datetime.now().strftime("%Y-%m-%d %H:%M")}
        (path / "project.json").write_text(json.dumps(record, indent=2))
        return record

    def list(self) -> list[dict]:
        found = [p for d in sorted((self.root / "projects").glob("*/")) if (p := self.read(str(d)))]
        return sorted(found, key=lambda p: p["createdAt"], reverse=True)

    def _recent_paths(self) -> list[str]:
        try:
            return [str(p) for p in json.loads((self.root / "recent.json").read_text())]
        except (OSError, ValueError):
            return []

    def _write_recent(self, paths: list[str]) -> None:
        self.root.mkdir(parents=True, exist_ok=True)
        (self.root / "recent.json").write_text(json.dumps(paths))

    def touch(self, path: str) -> None:
        self._write_recent([path, *(p for p in self._recent_paths() if p != path)][:RECENT])

    def recent(self) -> list[dict]:
        paths = self._recent_paths()
        known = [p for p in paths if self.read(p)]
        if known != paths:
            self._write_recent(known)
        return [self.read(p) for p in known]

    def delete(self, path: str) -> bool:
        if os.path.commonpath((self.root.resolve(), Path(path).resolve())) != str(self.root.resolve()):
            return False
        shutil.rmtree(path, ignore_errors=True)
        self._write_recent([p for p in self._recent_paths() if p != path])
        return True

    def imported(self, name: str, source: str, build) -> dict:
        """create, build(path), touch; a failed build leaves no project behind."""
        record = self.create(name, source)
        try:
            build(record["path"])
        except Exception:
            self.delete(record["path"])
            raise
        self.touch(record["path"])
        return record
