"""Command line: ``python -m pathloom.cli <verb>``."""

from __future__ import annotations

import argparse
import contextlib
import hashlib
import shutil
import sys
from collections.abc import Iterator
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import BuildError, OpenError, VerifyError
from .meta import TABLES, LogicalTable
from .operators.table import KeyedTable, merge_lists, merge_report
from .plans.catalog import Store, directory_fetch, http_fetch, release_url
from .plans.hunt import Hunt, resolved_lines, targets
from .session import local_session, ship
from .sources.tablefile import open_file, write_table_file
from .sources.mining import mine_archives, mine_report
from .sources.textio import hash_lines, locate, read_hash_list, read_seeds, read_unknown


class Refused(Exception):
    """A request that cannot be met, told without a trace."""


def parse_key(text: str) -> int:
    digits = text
    while digits.startswith("0x"):
        digits = digits[2:]
    try:
        if not 1 <= len(digits) <= 16 or not digits.isalnum():
            raise ValueError
        return int(digits, 16)
    except ValueError as e:
        raise Refused(f"not a hash: {text}") from e


def _listed(spark: SparkSession, files: list[str]) -> DataFrame:
    place = locate(spark, files)
    if place:
        raise Refused(f"{place}: no <hash> <path>")
    return read_hash_list(spark, files)


def build(spark: SparkSession, files: list[str], table: LogicalTable, out: str, frame_size: int | None, level: int) -> int:
    pairs = _listed(spark, files).select("key", "path")
    checked = KeyedTable.build(pairs, table.meta)
    write_table_file(checked.df, out, table.meta, frame_size, level)
    checked.release()
    return open_file(out).head.entries


def get(spark: SparkSession, text: str, file: str | None, table: str | None, store: Store) -> str:
    key = parse_key(text)
    path = file or str(store.path_for(table))
    opened = open_file(path)
    at = opened.find(key)
    row = next(opened.rows(at, at + 1), None) if at is not None else None
    if row is None:
        raise Refused(f"{text} is not in {path}")
    return row[1]


def gen(spark: SparkSession, known: list[str], unknown: list[str], archives: list[str], table: LogicalTable, seeds: list[str], words: bool, most_number: int, most_skin: int):
    """The hunt's report; keys of archive chunks are hunted for in the game table only."""
    if not unknown and not archives:
        raise Refused("either --unknown or --wad is needed")
    pairs = _listed(spark, known) if known else spark.createDataFrame([], "key long, path string")
    keys = read_unknown(spark, unknown) if unknown else spark.createDataFrame([], "key long")
    extra = read_seeds(spark, seeds) if seeds else None
    if archives:
        strings, chunks, _ = mine_report(mine_archives(spark, archives))
        mined = strings.select(F.col("token").alias("path"))
        extra = mined if extra is None else extra.union(mined)
        if table.id == "game":
            keys = keys.union(chunks)
    hunt = Hunt.for_table(table.id, table.meta, most_number=most_number, most_skin=most_skin, seeds=extra, words=words)
    return hunt.run(pairs.select("path"), targets(keys, pairs))


def merge(spark: SparkSession, files: list[str]) -> tuple[Iterator[str], dict]:
    """The merged list's lines, which come a partition at a time, and the report."""
    lists = [_listed(spark, [f]) for f in files]
    merged = merge_lists(lists)
    report = merge_report(merged, lists).first().asDict()
    return (r["value"] for r in hash_lines(merged, report["digits"]).toLocalIterator()), report


def inputs_of(directory: Path, table: LogicalTable) -> list[Path]:
    """The table's list, and for a table that may be split its parts .0, .1 and so on without a gap."""
    found = [p for p in [directory / table.input] if p.is_file()]
    if table.split:
        n = 0
        while (p := directory / f"{table.input}.{n}").is_file():
            found.append(p)
            n += 1
    return found


def fingerprint(files: list[Path]) -> str:
    digest = hashlib.sha256()
    for p in sorted(files, key=lambda p: p.name):
        with open(p, "rb") as f:
            while part := f.read(1 << 20):
                digest.update(part)
    return digest.hexdigest()


def bundle(spark: SparkSession, inputs: Path, out: Path, version: str | None, repo: str | None, commit: str | None, allow_missing: bool, frame_size: int | None, level: int):
    found = {t.id: inputs_of(inputs, t) for t in TABLES.values()}
    missing = [TABLES[i].input for i, files in found.items() if not files]
    if len(missing) == len(TABLES):
        raise Refused(f"no lists in {inputs}")
    if missing and not allow_missing:
        raise Refused(f"missing in {inputs}: {', '.join(missing)}")
    store = Store(out)
    if store.manifest_path.exists():
        raise Refused(f"{store.manifest_path} is there already")
    out.mkdir(parents=True, exist_ok=True)
    scratch, items = out / ".scratch", []
    scratch.mkdir(exist_ok=True)
    try:
        for name, files in found.items():
            if files:
                target = scratch / name
                build(spark, [str(p) for p in files], TABLES[name], str(target), frame_size, level)
                items.append((name, version or datetime.now(UTC).strftime("%Y-%m-%d"), target))
        source = {"repo": repo, "commit": commit, "inputs_sha256": fingerprint([p for files in found.values() for p in files])}
        return store.commit(items, {k: v for k, v in source.items() if v is not None})
    finally:
        shutil.rmtree(scratch, ignore_errors=True)


def stats(file: str) -> dict:
    t = open_file(file)
    h = t.head
    return {"entries": h.entries, "key_width": int(h.meta.key_width), "hash_kind": h.meta.algorithm.name, "casing": h.meta.casing.name, "arena_bytes": h.arena_bytes, "stored_bytes": h.stored_bytes, "ratio": round(h.stored_bytes / h.arena_bytes, 4) if h.arena_bytes else 1.0, "file_bytes": t.size}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pathloom")
    verbs = p.add_subparsers(dest="verb", required=True)
    table = {"choices": list(TABLES), "default": "game"}

    def packing(v):
        v.add_argument("--raw", action="store_true")
        v.add_argument("--frame-size", type=int, default=16384)
        v.add_argument("--level", type=int, default=19)

    v = verbs.add_parser("build")
    v.add_argument("--input", nargs="+", required=True)
    v.add_argument("--table", **table)
    v.add_argument("--out", required=True)
    packing(v)
    v = verbs.add_parser("get")
    v.add_argument("hash")
    v.add_argument("--file")
    v.add_argument("--table", choices=list(TABLES))
    v.add_argument("--dir")
    v = verbs.add_parser("update")
    v.add_argument("--repo")
    v.add_argument("--url")
    v.add_argument("--from-dir")
    v.add_argument("--dir")
    v.add_argument("--force", action="store_true")
    v = verbs.add_parser("gen")
    for name in ("--known", "--unknown", "--wad", "--seeds"):
        v.add_argument(name, nargs="*", default=[])
    v.add_argument("--table", **table)
    v.add_argument("--words", action="store_true")
    v.add_argument("--max-number", type=int, default=200)
    v.add_argument("--max-skin", type=int, default=100)
    v.add_argument("--out")
    v = verbs.add_parser("merge")
    v.add_argument("inputs", nargs="+")
    v.add_argument("--out")
    v = verbs.add_parser("bundle")
    v.add_argument("--inputs", type=Path, required=True)
    v.add_argument("--out", type=Path, required=True)
    v.add_argument("--version")
    v.add_argument("--source-repo")
    v.add_argument("--source-commit")
    v.add_argument("--allow-missing", action="store_true")
    packing(v)
    for name in ("verify", "stats"):
        verbs.add_parser(name).add_argument("file")
    return p


def _write(lines, out: str | None) -> None:
    with open(out, "w", encoding="utf-8", newline="\n") if out else contextlib.nullcontext(sys.stdout) as f:
        f.writelines(f"{x}\n" for x in lines)


def run(args: argparse.Namespace, spark: SparkSession | None = None) -> None:
    if args.verb in ("build", "gen", "merge", "bundle"):
        spark = spark or local_session()
        ship(spark)
    if args.verb == "build":
        n = build(spark, args.input, TABLES[args.table], args.out, None if args.raw else args.frame_size, args.level)
        print(f"{n} entries in {args.out}", file=sys.stderr)
    elif args.verb == "get":
        if not args.file and not args.table:
            raise Refused("either --file or --table is needed")
        print(get(spark, args.hash, args.file, args.table, Store(args.dir)))
    elif args.verb == "update":
        if not (args.repo or args.url or args.from_dir):
            raise Refused("one of --repo, --url and --from-dir is needed")
        report = Store(args.dir).update(directory_fetch(args.from_dir) if args.from_dir else http_fetch(args.url or release_url(args.repo)), args.force)
        print("another update runs" if report.locked else f"installed: {', '.join(report.installed) or 'nothing'}", file=sys.stderr)
    elif args.verb == "gen":
        t = TABLES[args.table]
        report = gen(spark, args.known, args.unknown, args.wad, t, args.seeds, args.words, args.max_number, args.max_skin)
        for s in report.stats:
            print(s, file=sys.stderr)
        _write((r["value"] for r in resolved_lines(report, t.meta.key_width.hex_digits, t.lowercase_output).toLocalIterator()), args.out)
    elif args.verb == "merge":
        lines, report = merge(spark, args.inputs)
        print(report, file=sys.stderr)
        _write(lines, args.out)
    elif args.verb == "bundle":
        m = bundle(spark, args.inputs, args.out, args.version, args.source_repo, args.source_commit, args.allow_missing, None if args.raw else args.frame_size, args.level)
        print(f"{len(m.tables)} tables in {args.out}", file=sys.stderr)
    elif args.verb == "verify":
        open_file(args.file).verify()
        print("ok", file=sys.stderr)
    else:
        for k, v in stats(args.file).items():
            print(f"{k}: {v}")


def main(argv: list[str] | None = None) -> int:
    try:
        run(parser().parse_args(argv))
    except (Refused, BuildError, OpenError, VerifyError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
