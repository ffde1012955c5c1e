"""A content-addressed store of recommendation sets.

An entry's name is the digest of all that its sets depend on: thresholds and analysis instant, the
selected sets, and the versions of the inputs. So an entry never changes, equal requests share it,
and a request whose inputs have changed gets an entry of its own. An entry is written aside and
moved into place when it is whole; of two writers of one entry the first one wins.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Collection, Mapping
from dataclasses import dataclass, fields
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from tellwise.config import Thresholds
from tellwise.plans.advisor import CHOICES, Recommendations, check_selection, recommend
from tellwise.sources.folders import Files, shared_folder
from tellwise.sources.telemetry import SOURCES, Telemetry

#: Raised when the rules change, so that older entries are not taken for theirs.
RULES = 1


@dataclass(frozen=True)
class Entry:
    """One stored result. ``created`` is a naive UTC instant."""

    key: str
    created: datetime
    as_of: datetime
    sets: tuple[str, ...]


def input_versions(data: Telemetry, given: Mapping[str, str] | None = None) -> dict[str, str]:
    """Source -> digest of its schema, its plan and the paths, lengths and times of its files.

    Files are looked up folder by folder, so no data is read. A source without files (rows made
    in the program), or one with too many folders to look up, needs a version in ``given``.
    """
    given, found = given or {}, {}
    for name in SOURCES:
        df = getattr(data, name)
        if df is None:
            continue
        if name in given:
            found[name] = f"given:{given[name]}"
            continue
        used = set(df.inputFiles())
        if not used:
            raise ValueError(f"source {name!r} has no files; give its version")
        files = Files(df.sparkSession)
        folders = sorted({path.rpartition("/")[0] for path in used})
        names = {path.rpartition("/")[2] for path in used}
        states = sorted(s for folder in folders for s in files.listed(folder) if s[0].rpartition("/")[2] in names)
        plan = df._jdf.queryExecution().analyzed().canonicalized().toString()
        text = json.dumps([df.schema.json(), plan, states])
        found[name] = hashlib.sha256(text.encode()).hexdigest()
    return found


def entry_key(cfg: Thresholds, selected: Collection[str], versions: Mapping[str, str], with_prompts: bool = False) -> str:
    """The digest that names an entry."""
    def plain(value: object) -> object:
        return dict(sorted(value.items())) if isinstance(value, Mapping) else str(value) if isinstance(value, datetime) else value

    thresholds = {f.name: plain(getattr(cfg, f.name)) for f in fields(cfg)}
    text = json.dumps([RULES, thresholds, list(selected), with_prompts, dict(versions)], sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()


class ResultStore:
    """Entries in ``folder/<key>``: a Parquet table for each set, and what the entry is."""

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark, self.files = spark, Files(spark)
        self.folder = (folder or f"{shared_folder(spark)}/recommendations").rstrip("/")

    def get(self, data: Telemetry, *, cfg: Thresholds, selected: Collection[str] = CHOICES, with_prompts: bool = False,
            versions: Mapping[str, str] | None = None) -> Recommendations:
        """The sets, read from their entry; computed and written first if there is none."""
        chosen = check_selection(selected)
        key = entry_key(cfg, chosen, input_versions(data, versions), with_prompts)
        if not self.has(key):
            self._write(key, recommend(data, cfg=cfg, selected=chosen, with_prompts=with_prompts), cfg, chosen)
        return self.read(key, chosen)

    def has(self, key: str) -> bool:
        return self.files.exists(f"{self.folder}/{key}/entry/_SUCCESS")

    def read(self, key: str, selected: Collection[str]) -> Recommendations:
        return Recommendations(**{name: self.spark.read.parquet(f"{self.folder}/{key}/{name}") for name in selected})

    def _write(self, key: str, sets: Recommendations, cfg: Thresholds, chosen: Collection[str]) -> None:
        aside = f"{self.folder}/_attempts/{uuid.uuid4().hex}"
        sets.write_parquet(aside)
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        text = json.dumps({"key": key, "created": now.isoformat(), "as_of": cfg.as_of.isoformat(), "sets": list(chosen)})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{aside}/entry")
        if not self.files.move(aside, f"{self.folder}/{key}"):
            self.files.remove(aside)
            if not self.has(key):
                raise OSError(f"entry {key} can't be put into {self.folder}")

    def entries(self) -> list[Entry]:
        """All whole entries, oldest first."""
        if not self.files.exists(self.folder):
            return []
        keys = [path.rpartition("/")[2] for path, _, _ in self.files.listed(self.folder)]
        there = [f"{self.folder}/{key}/entry" for key in keys if self.has(key)]
        rows = [json.loads(r["value"]) for r in self.spark.read.text(there).collect()] if there else []
        found = [Entry(r["key"], datetime.fromisoformat(r["created"]), datetime.fromisoformat(r["as_of"]), tuple(r["sets"])) for r in rows]
        return sorted(found, key=lambda e: (e.created, e.key))

    def remove(self, key: str) -> None:
        """Delete an entry; what was read from it lazily can't be read any more."""
        self.files.remove(f"{self.folder}/{key}")

    def expire(self, before: datetime) -> list[str]:
        """Delete the entries created before a naive UTC instant; their keys."""
        old = [e.key for e in self.entries() if e.created < before]
        for key in old:
            self.remove(key)
        return old
