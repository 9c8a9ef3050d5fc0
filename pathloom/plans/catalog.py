"""A directory of immutable table versions behind a manifest that is swapped last."""

from __future__ import annotations

import asyncio
import contextlib
import fcntl
import hashlib
import http.client
import json
import os
import re
import shutil
import sys
import urllib.error
import urllib.request
from collections.abc import Awaitable, Callable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BadRemoteFilename, DownloadMismatch, FetchFailed, HttpStatus, HttpTransport, InvalidVersion, ManifestError, ManifestMissing, NoCacheDir, TableNotFound, UnsupportedSchema, VersionReused
from ..meta import TABLES
from ..operators.layered import LayeredTable
from ..operators.table import KeyedTable
from ..sources.tablefile import open_file, read_table_file

# Fixed values of the on-disk catalog.
MANIFEST, SCHEMA, EXTENSION, LOCK = "manifest.json", 1, "lhdb", ".update.lock"
ENV = "PATHLOOM_DIR"


def cache_dir() -> Path:
    """``PATHLOOM_DIR`` if it is set and not empty, else the platform's cache folder."""
    if named := os.environ.get(ENV):
        return Path(named)
    home = os.environ.get("XDG_CACHE_HOME") or (os.path.expanduser("~/Library/Caches") if sys.platform == "darwin" else os.environ.get("LOCALAPPDATA") or os.path.expanduser("~/.cache"))
    if home.startswith("~"):
        raise NoCacheDir("no home folder")
    return Path(home) / "pathloom"


def sha256_file(path: Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def write_durably(path: Path, data: bytes) -> None:
    staged = path.with_name(f"{path.name}.{os.getpid()}.tmp")
    with open(staged, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(staged, path)


def copy_durably(source: Path, path: Path) -> None:
    staged = path.with_name(f"{path.name}.{os.getpid()}.tmp")
    shutil.copyfile(source, staged)
    with open(staged, "rb+") as f:
        os.fsync(f.fileno())
    os.replace(staged, path)


def rfc3339(seconds: float) -> str:
    """UTC second, or nothing for a time that has no four-digit year."""
    try:
        return datetime.fromtimestamp(seconds, UTC).strftime("%Y-%m-%dT%H:%M:%SZ") if seconds >= 0 else ""
    except (OverflowError, ValueError, OSError):
        return ""


def is_version(label: str) -> bool:
    return bool(label) and "/" not in label and "\\" not in label


def version_of(table: str, file: str) -> str | None:
    """The version in a file name ``<table>-<version>.<extension>``; None if it is none."""
    m = re.fullmatch(rf"{re.escape(table)}-(.+)\.{EXTENSION}", file, re.DOTALL)
    return m[1] if m and is_version(m[1]) else None


@dataclass
class Manifest:
    generated_at: str = ""
    source: dict | None = None
    tables: dict[str, dict] = field(default_factory=dict)

    @classmethod
    def parse(cls, data: bytes) -> Manifest:
        try:
            m = json.loads(data)
            if m["schema"] != SCHEMA:
                raise UnsupportedSchema(m["schema"])
            return cls(m["generated_at"], m.get("source"), dict(m["tables"]))
        except (ValueError, KeyError, TypeError) as e:
            raise ManifestError(f"not a manifest: {e}") from e

    @classmethod
    def read(cls, path: Path) -> Manifest:
        try:
            return cls.parse(path.read_bytes())
        except FileNotFoundError as e:
            raise ManifestMissing(str(path)) from e

    def encode(self) -> bytes:
        body = {"schema": SCHEMA, "generated_at": self.generated_at, **({"source": self.source} if self.source is not None else {}), "tables": dict(sorted(self.tables.items()))}
        return (json.dumps(body, indent=2) + "\n").encode()

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, v["file"], v["sha256"], v["entries"], v["key_width"]) for k, v in sorted(self.tables.items())], "id string, file string, sha256 string, entries long, key_width int")


@dataclass
class GcReport:
    deleted: list[Path] = field(default_factory=list)
    retained: list[Path] = field(default_factory=list)


@dataclass
class UpdateReport:
    locked: bool = False
    installed: list[str] = field(default_factory=list)
    unknown_tables: list[str] = field(default_factory=list)
    gc: GcReport = field(default_factory=GcReport)


class Store:
    """Tables of a catalog directory. Readers never lock."""

    def __init__(self, directory: str | Path | None = None):
        self.dir = Path(directory) if directory is not None else cache_dir()

    @property
    def manifest_path(self) -> Path:
        return self.dir / MANIFEST

    def manifest(self) -> Manifest:
        return Manifest.read(self.manifest_path)

    def _manifest_or_empty(self) -> Manifest:
        try:
            return self.manifest()
        except ManifestMissing:
            return Manifest()

    def path_for(self, table: str) -> Path:
        entry = self.manifest().tables.get(table)
        if entry is None:
            raise TableNotFound(table)
        return self.dir / entry["file"]

    def open(self, spark: SparkSession, table: str) -> KeyedTable:
        path = str(self.path_for(table))
        return KeyedTable(read_table_file(spark, path), open_file(path).head.meta)

    def open_many(self, spark: SparkSession, tables: list[str]) -> list[tuple[str, KeyedTable | Exception]]:
        """Each table with what opening it gave; one that fails does not stop the others."""
        out = []
        for t in tables:
            try:
                out.append((t, self.open(spark, t)))
            except Exception as e:  # noqa: BLE001
                out.append((t, e))
        return out

    def open_layered(self, spark: SparkSession, tables: list[str]) -> tuple[LayeredTable, list[tuple[str, Exception]]]:
        opened = self.open_many(spark, tables)
        return LayeredTable(spark, [t for _, t in opened if isinstance(t, KeyedTable)]), [(n, e) for n, e in opened if isinstance(e, Exception)]

    def view(self, spark: SparkSession, table: str) -> None:
        self.open(spark, table).df.createOrReplaceTempView(table.replace("-", "_"))

    @contextlib.contextmanager
    def try_lock(self) -> Iterator[bool]:
        """True while this process is the only updater."""
        self.dir.mkdir(parents=True, exist_ok=True)
        with open(self.dir / LOCK, "a") as f:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError:
                yield False
            else:
                yield True

    def commit(self, items: list[tuple[str, str, str | Path]], source: dict | None = None) -> Manifest:
        """Publishes ``(table, version, built file)`` items, the manifest last.

        The same version with the same bytes is no change; with others it is an error.
        """
        self.dir.mkdir(parents=True, exist_ok=True)
        manifest = self._manifest_or_empty()
        manifest.generated_at, manifest.source = rfc3339(datetime.now(UTC).timestamp()), source
        for table, version, built in items:
            if not is_version(version):
                raise InvalidVersion(version)
            head = open_file(str(built)).head
            target, digest = self.dir / f"{table}-{version}.{EXTENSION}", sha256_file(Path(built))
            if not target.exists():
                copy_durably(Path(built), target)
            elif sha256_file(target) != digest:
                raise VersionReused(f"{table} {version}")
            manifest.tables[table] = {"file": target.name, "sha256": digest, "entries": head.entries, "key_width": int(head.meta.key_width)}
        write_durably(self.manifest_path, manifest.encode())
        return manifest

    def gc(self) -> GcReport:
        """Deletes tables that no manifest entry names, and leftovers; without a manifest nothing."""
        report = GcReport()
        try:
            named = {t["file"] for t in self.manifest().tables.values()}
        except ManifestMissing:
            return report
        for p in sorted(self.dir.iterdir()):
            if p.is_file() and (p.name.endswith(".tmp") or p.suffix == f".{EXTENSION}" and p.name not in named):
                try:
                    p.unlink()
                    report.deleted.append(p)
                except OSError:
                    report.retained.append(p)
        return report

    def plan(self, remote: Manifest, force: bool = False) -> tuple[list[tuple[str, str, dict]], list[str]]:
        """``(table, version, entry)`` to download, and the ids that are unknown here."""
        local, wanted, unknown = self._manifest_or_empty(), [], []
        for table, entry in sorted(remote.tables.items()):
            if table not in TABLES:
                unknown.append(table)
                continue
            version = version_of(table, entry["file"])
            if version is None:
                raise BadRemoteFilename(f"{table}: {entry['file']!r}")
            mine = local.tables.get(table)
            if force or not (mine and mine["sha256"] == entry["sha256"] and (self.dir / mine["file"]).is_file()):
                wanted.append((table, version, entry))
        return wanted, unknown

    def update(self, fetch: Callable[[str], bytes], force: bool = False) -> UpdateReport:
        """Brings the catalog up to a published release; a failure leaves it as it was."""
        steps = self._update(force)
        try:
            name = next(steps)
            while True:
                try:
                    data = fetch(name)
                except Exception as e:
                    raise FetchFailed(name, e) from e
                name = steps.send(data)
        except StopIteration as done:
            return done.value
        finally:
            steps.close()

    async def update_async(self, fetch, force: bool = False) -> UpdateReport:
        """As ``update`` with an awaitable fetch; a cancelled call cleans up after itself."""
        steps = self._update(force)
        try:
            name = next(steps)
            while True:
                try:
                    data = await fetch(name)
                except asyncio.CancelledError:
                    raise
                except Exception as e:
                    raise FetchFailed(name, e) from e
                name = steps.send(data)
        except StopIteration as done:
            return done.value
        finally:
            steps.close()

    def _update(self, force: bool):
        """Yields the names that it needs and is sent their bytes."""
        with self.try_lock() as mine:
            if not mine:
                return UpdateReport(locked=True)
            remote = Manifest.parse((yield MANIFEST))
            wanted, unknown = self.plan(remote, force)
            staged: list[Path] = []
            items = []
            try:
                for table, version, entry in wanted:
                    data = yield entry["file"]
                    actual = hashlib.sha256(data).hexdigest()
                    if actual != entry["sha256"]:
                        raise DownloadMismatch(entry["file"], entry["sha256"], actual)
                    staged.append(self.dir / f"{entry['file']}.download.tmp")
                    staged[-1].write_bytes(data)
                    items.append((table, version, staged[-1]))
                if items:
                    self.commit(items, remote.source)
            finally:
                for p in staged:
                    p.unlink(missing_ok=True)
            report = UpdateReport(installed=[t for t, _, _ in items], unknown_tables=unknown)
            with contextlib.suppress(Exception):
                report.gc = self.gc()
            return report


def http_fetch(base_url: str, timeout: float = 60) -> Callable[[str], bytes]:
    """Fetches ``base_url/name``; ``HttpStatus`` for a status other than 2xx, ``HttpTransport`` where no whole answer comes."""

    def fetch(name: str) -> bytes:
        url = f"{base_url.rstrip('/')}/{name}"
        try:
            with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
                return r.read()
        except urllib.error.HTTPError as e:
            raise HttpStatus(url, e.code) from e
        except (OSError, http.client.HTTPException) as e:
            raise HttpTransport(url, e) from e

    return fetch


def http_fetch_async(base_url: str, timeout: float = 60) -> Callable[[str], Awaitable[bytes]]:
    """The same for ``update_async``: the event loop is free while a thread waits for the answer."""
    fetch = http_fetch(base_url, timeout)
    return lambda name: asyncio.to_thread(fetch, name)


def release_url(repo: str) -> str:
    """Where the files of the latest release of a hosted ``owner/name`` repository are."""
    return f"https://github.com/{repo}/releases/latest/download"


def directory_fetch(directory: str | Path) -> Callable[[str], bytes]:
    return lambda name: (Path(directory) / name).read_bytes()


def plan_frame(remote: DataFrame, local: DataFrame, files: DataFrame, known: DataFrame, force: bool = False) -> DataFrame:
    """The update plan as a query: ``id, file, action`` (download, keep, unknown)."""
    here = local.join(files.select("file").distinct(), "file", "left_semi").select(F.col("id").alias("l_id"), F.col("sha256").alias("l_sha"))
    ids = known.select(F.col("id").alias("k_id")).distinct()
    r = remote.join(ids, remote["id"] == ids["k_id"], "left").join(here, remote["id"] == here["l_id"], "left")
    fresh = F.coalesce(F.col("l_sha") == F.col("sha256"), F.lit(False)) & F.lit(not force)
    return r.select("id", remote["file"], F.when(F.col("k_id").isNull(), "unknown").when(fresh, "keep").otherwise("download").alias("action"))


def gc_frame(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``file`` of the files that garbage collection deletes."""
    tables = files.filter(F.col("file").endswith(f".{EXTENSION}")).join(manifest, "file", "left_anti")
    return tables.select("file").union(files.filter(F.col("file").endswith(".tmp")).select("file"))
