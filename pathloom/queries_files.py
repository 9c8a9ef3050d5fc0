"""Registered queries of what reads and writes files, answers single keys, or works on a catalog, and their SQL."""

from __future__ import annotations

import asyncio
import contextlib
import http.server
import os
import threading
import uuid
import zipfile
from functools import partial
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cli
from .errors import MergeConfig
from .functions.hashing import xxh3, xxh64
from .functions.keys import unsigned
from .meta import TABLES, KeyWidth, TableMeta
from .operators import guessers as G
from .operators.layered import ExtendedTable, LayeredTable
from .operators.table import KeyedTable, check, descents, placed_in_order
from .plans.catalog import ENV, Store, cache_dir, copy_durably, directory_fetch, http_fetch, http_fetch_async, rfc3339, sha256_file, version_of, write_durably
from .plans.hunt import Hunt, HuntState, resolved_lines, stats_frame, targets
from .queries import _CORPUS_SQL, _KEYS_SQL, _MERGED_SQL, _PARTS_SQL, _SWAP_SQL, U32, _fnv_sql, _hex_sql, _keys, _lists, _parts, _probes, corpus
from .registry import query
from .registry import table as _t
from .session import shared_dir
from .sources.tablefile import Header, open_bytes, open_file, write_table_file
from .sources.mining import mine_archives, mine_report
from .sources.textio import hash_lines, locate, read_hash_list, read_seeds, read_unknown, write_hash_list


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/queries/{name}-{uuid.uuid4().hex}"


def _folder(spark: SparkSession, name: str) -> Path:
    """A new folder for what the command line and the catalog do on the driver's side of a shared file system."""
    path = _fresh(spark, name)
    if "://" in path and not path.startswith("file://"):
        raise RuntimeError("the catalog needs a folder that is mounted as a file system")
    out = Path(path.removeprefix("file://"))
    out.mkdir(parents=True)
    return out


def _named(spark, sf_dir, table: str, key: str, path: str) -> DataFrame:
    return _t(spark, sf_dir, table).select(F.col(key).cast("long").alias("key"), F.col(path).alias("path"))


def _customers(spark, sf_dir) -> DataFrame:
    return _named(spark, sf_dir, "customer", "c_custkey", "c_name")


def _nations(spark, sf_dir) -> DataFrame:
    return _named(spark, sf_dir, "nation", "n_nationkey", "n_name")


# ---- lists ---------------------------------------------------------------------------------------------------------------


@query("select c_custkey::BIGINT as key, c_name || '  ' as path from customer")
def read_list_file(spark, sf_dir):
    """A list written as text and read again; paths end in spaces."""
    path = _fresh(spark, "list")
    write_hash_list(_customers(spark, sf_dir).withColumn("path", F.concat("path", F.lit("  "))), path)
    return read_hash_list(spark, path).select("key", "path")


@query("select c_custkey::BIGINT * 7919 as key from customer")
def read_unknown_file(spark, sf_dir):
    """One hash a line, with and without prefix, among spaces and blank lines."""
    path, key = _fresh(spark, "unknown"), F.hex(F.col("c_custkey") * 7919)
    lines = _t(spark, sf_dir, "customer").select(F.explode(F.array(F.concat(F.lit(" "), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("0x"), key)).otherwise(F.lower(key)), F.lit(" \t")), F.lit("   "))).alias("value"))
    lines.write.text(path)
    return read_unknown(spark, path)


@query("select n_name || ' ' as path from nation")
def read_seed_file(spark, sf_dir):
    path = _fresh(spark, "seeds")
    _nations(spark, sf_dir).select(F.explode(F.array(F.concat("path", F.lit(" ")), F.lit(""))).alias("value")).write.text(path)
    return read_seeds(spark, path)


@query("select 3::BIGINT as line, 'no hash' as kind union all select null, 'sound'")
def malformed_line(spark, sf_dir):
    """Where a list is broken is told by file and line."""
    folder = _folder(spark, "broken")
    (folder / "bad.txt").write_text("1 a\r\n\n0x2 b\n3 c\n")
    (folder / "good.txt").write_text("1 a b c \n\n2 \n")
    bad, good = locate(spark, str(folder / "bad.txt")), locate(spark, str(folder / "good.txt"))
    return spark.createDataFrame([(int(bad.rpartition(":")[2]), "no hash"), (good, "sound")], "line long, kind string")


@query(f"select {_hex_sql('key')} || ' ' || lower(path) as value from (select c_custkey::BIGINT as key, c_name as path from customer) t")
def written_list(spark, sf_dir):
    path = _fresh(spark, "written")
    write_hash_list(_customers(spark, sf_dir), path, lowercase=True)
    return spark.read.text(path)


@query("select row_number() over (order by c_custkey) - 1 as place, lpad(lower(to_hex(c_custkey)), 8, '0') || ' ' || c_name as value from customer")
def list_order(spark, sf_dir):
    """The lines of a list stand in order of key: their places among the lines as they come."""
    lines = hash_lines(_customers(spark, sf_dir), 8).toLocalIterator()
    return spark.createDataFrame(((n, r["value"]) for n, r in enumerate(lines)), "place long, value string")


@query(f"select lpad(lower(to_hex(key)), (select max(length(to_hex(c_custkey))) from customer)::INT, '0') || ' ' || path as value from {_MERGED_SQL} t")
def cli_merge(spark, sf_dir):
    """The command line's merge of three lists, written as one file."""
    folder, files = _folder(spark, "merge"), []
    for n, rows in enumerate(_lists(spark, sf_dir)):
        files.append(f"{folder}/{n}")
        rows.select(F.concat("hex", F.lit(" "), "path")).write.text(files[-1])
    if cli.main(["merge", *files, "--out", f"{folder}/merged.txt"]):
        raise RuntimeError("merge failed")
    return spark.read.text(f"file://{folder}/merged.txt")


@query("select sha256((select string_agg(n_name, ';' order by n_nationkey) from nation where n_regionkey < 2) || (select string_agg(n_name, ';' order by n_nationkey) from nation where n_regionkey >= 2)) as digest")
def list_fingerprint(spark, sf_dir):
    """One digest of several lists, in order of their names."""
    folder = _folder(spark, "inputs")
    rows = _t(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # a fixed table of 25 rows
    for name, of in (("b.txt", lambda r: r >= 2), ("a.txt", lambda r: r < 2)):
        (folder / name).write_text(";".join(r["n_name"] for r in rows if of(r["n_regionkey"])))
    return spark.createDataFrame([(cli.fingerprint([folder / "b.txt", folder / "a.txt"]),)], "digest string")


# ---- hashes of known texts -----------------------------------------------------------------------------------------------

# Hashes of so many letters a, by the published algorithms.
XXH64 = {
    0: -1205034819632174695, 1: -3292477735350538661, 3: -5908176911397144741, 4: 4802821936147382066, 8: -3078722373627055885, 9: 3236322743703965433, 16: -2939319268822343319, 17: -861267587532096248, 31: -124123331417855722,
    32: -8831976466377237801, 33: 1798061103824220747, 63: 7699020314904116425, 100: 3985758137895276467, 128: 7300379565935374962, 129: -6470615816593113080, 200: -7769112285488944194, 240: 7255903791201427105, 241: 3245699850734585388, 1000: 6261194739255231011, 5000: -5569130556962095914,
}
XXH3 = {
    0: 3244421341483603138, 1: -1817709641818812897, 3: -1965203137977529873, 4: 5409754171546613543, 8: -3901313178938810982, 9: -2156241091266948412, 16: 1421536839330484490, 17: 4112485096731572522, 31: 1515450229463695958,
    32: -2614845232007375326, 33: 3167689057942052365, 63: -8360645179744306050, 100: 4692068465866116615, 128: 8800631852072424300, 129: 1551182126899767131, 200: -6040501358373189227, 240: -7404965787703593530, 241: -662047440260949712, 1000: -5483221183958099076, 5000: -8738471274325936663,
}


def _vectors_sql(vectors: dict[int, int]) -> str:
    return f"select n::BIGINT as n, key::BIGINT as key from (values {', '.join(f'({n}, {k})' for n, k in vectors.items())}) v(n, key)"


@query(_vectors_sql(XXH64))
def xxh64_vectors(spark, sf_dir):
    return spark.createDataFrame([(n,) for n in XXH64], "n long").select("n", xxh64(F.repeat(F.lit("a"), F.col("n").cast("int"))).alias("key"))


@query(_vectors_sql(XXH3))
def xxh3_vectors(spark, sf_dir):
    return spark.createDataFrame([(n,) for n in XXH3], "n long").select("n", xxh3(F.repeat(F.lit("a"), F.col("n").cast("int"))).alias("key"))


@query("select * from (values ('game', 8, 1, 1, 'hashes.game.txt', true, true), ('lcu', 8, 1, 1, 'hashes.lcu.txt', false, true), ('binentries', 4, 2, 1, 'hashes.binentries.txt', false, false), ('bintypes', 4, 2, 1, 'hashes.bintypes.txt', false, false), "
       "('binfields', 4, 2, 1, 'hashes.binfields.txt', false, false), ('binhashes', 4, 2, 1, 'hashes.binhashes.txt', false, false), ('rst', 8, 1, 1, 'hashes.rst.xxh64.txt', false, true), ('rst-xxh3', 8, 3, 1, 'hashes.rst.xxh3.txt', false, true)) t(id, key_width, hash_kind, casing, input, split, lowercase)")  # fmt: skip
def table_registry(spark, sf_dir):
    return spark.createDataFrame([(t.id, int(t.meta.key_width), int(t.meta.hash_kind), int(t.meta.casing), t.input, t.split, t.lowercase_output) for t in TABLES.values()], "id string, key_width int, hash_kind int, casing int, input string, split boolean, lowercase boolean")


# ---- one table -----------------------------------------------------------------------------------------------------------


@query(f"select path, row_number() over (order by path) - 1 as place from {_CORPUS_SQL}")
def path_order(spark, sf_dir):
    """Every path's place in bytewise order, by ranges."""
    return placed_in_order(corpus(spark, sf_dir), F.col("path"))


_SIGNED_SQL = "(select case when o_orderkey % 2 = 0 then -o_orderkey * 1000003 - 1 else o_orderkey * 7919 end::BIGINT as key from orders)"


@query(f"select key, row_number() over (order by case when key < 0 then key::HUGEINT + 18446744073709551616 else key end) - 1 as place from {_SIGNED_SQL} t")
def key_order(spark, sf_dir):
    """Every key's place in unsigned order, by ranges."""
    key = F.when(F.col("o_orderkey") % 2 == 0, -F.col("o_orderkey") * 1000003 - 1).otherwise(F.col("o_orderkey") * 7919)
    return placed_in_order(_t(spark, sf_dir, "orders").select(key.cast("long").alias("key")), unsigned(F.col("key")))


@query("select row_number() over (order by n_name) - 1 as place, n_nationkey::BIGINT as key, n_name as path from nation")
def scan_in_path_order(spark, sf_dir):
    rows = KeyedTable(_nations(spark, sf_dir), TableMeta()).in_path_order().toLocalIterator()
    return spark.createDataFrame(((n, r["key"], r["path"]) for n, r in enumerate(rows)), "place long, key long, path string")


@query("select * from (select o_orderkey as at, (o_orderkey * 7919) % 1000 as key, lag((o_orderkey * 7919) % 1000) over (order by o_orderkey) as before from orders) t where key <= before")
def key_descents(spark, sf_dir):
    """Stored keys that do not ascend, found over ranges."""
    return descents(_t(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("at"), (F.col("o_orderkey") * 7919 % 1000).cast("long").alias("key")))


@query("select n_nationkey::BIGINT as key, n_name as path from nation")
def resident_rows(spark, sf_dir):
    """A small table as a dictionary on the driver."""
    held = KeyedTable(_nations(spark, sf_dir), TableMeta()).resident()
    return spark.createDataFrame(list(held.items()), "key long, path string")


@query("select n_nationkey::BIGINT as key, n_name as path from nation")
def table_bytes_scan(spark, sf_dir):
    """A table file held as bytes."""
    path = f"{_fresh(spark, 'bytes')}.lhdb"
    write_table_file(_nations(spark, sf_dir), path, TableMeta())
    data = bytes(spark.read.format("binaryFile").load(path).first()["content"])
    opened = open_bytes(data)
    return spark.createDataFrame(list(opened.rows(0, opened.head.entries)), "key long, path string")


@query(f"select count(*) as entries, 4::BIGINT as key_width, sum(strlen(path))::BIGINT as arena_bytes, 2::BIGINT as hash_kind, true as again from {_CORPUS_SQL}")
def header_fields(spark, sf_dir):
    """A written file's header, decoded, encoded and decoded again."""
    path = f"{_fresh(spark, 'header')}.lhdb"
    table = KeyedTable.of_paths(corpus(spark, sf_dir), U32)
    write_table_file(table.df, path, U32)
    table.release()
    head = open_file(path).head
    return spark.createDataFrame([(head.entries, int(head.meta.key_width), head.arena_bytes, int(head.meta.hash_kind), Header.decode(head.encode()) == head)], "entries long, key_width long, arena_bytes long, hash_kind long, again boolean")


@query(f"select row_number() over (order by path) - 1 as place, path from {_CORPUS_SQL}")
def arena_order(spark, sf_dir):
    """A file's rows come in the order of their place in the arena."""
    path = f"{_fresh(spark, 'order')}.lhdb"
    write_table_file(corpus(spark, sf_dir).select(F.xxhash64("path").alias("key"), "path"), path, TableMeta())
    opened = open_file(path)
    return spark.createDataFrame([(n, p) for n, (_, p) in enumerate(opened.rows(0, opened.head.entries))], "place long, path string")


@query("select count(*) as entries, sum(strlen(c_name))::BIGINT as arena_bytes, true as smaller from customer")
def stored_stats(spark, sf_dir):
    """Size of a table and of what is stored of it."""
    path = _fresh(spark, "stored")
    KeyedTable(_customers(spark, sf_dir), TableMeta()).write(path)
    table = KeyedTable.open(spark, path)
    stored = KeyedTable.stored_bytes(spark, f"{path}/path")
    return table.stats().select("entries", "arena_bytes", (F.lit(stored) < F.col("arena_bytes") + 16 * F.col("entries")).alias("smaller"))


@query("select s_suppkey::BIGINT as ord, row_number() over (order by s_suppkey) - 1 as place, (s_suppkey * 37) % 150 as key, p.p_name as path from supplier left join part p on p.p_partkey = (s_suppkey * 37) % 150 and p.p_partkey % 3 <> 0")
def lookup_in_order(spark, sf_dir):
    """Answers come back in the order of the probes."""
    probes = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("ord"), (F.col("s_suppkey") * 37 % 150).cast("long").alias("key")).repartition(7, "key")
    rows = _parts(spark, sf_dir).get_batch(probes, order="ord").toLocalIterator()
    return spark.createDataFrame(((n, r["ord"], r["key"], r["path"]) for n, r in enumerate(rows)), "place long, ord long, key long, path string")


@query("select (select min(s_nationkey) from (select s_nationkey from supplier group by 1 having count(*) > 1)) as duplicate, (select min(c_custkey) from customer) + 4294967296 as wide, 2::BIGINT as long")
def first_offenders(spark, sf_dir):
    """Which row a build is refused for: the smallest key twice, the smallest wide key, the first long path in path order."""
    found = []
    wide = _customers(spark, sf_dir).withColumn("key", F.col("key") + (1 << 32))
    long = spark.createDataFrame([(1, "b" * 65536), (2, "a" * 65537), (3, "c")], "key long, path string")
    for rows in (_named(spark, sf_dir, "supplier", "s_nationkey", "s_name"), wide, long):
        try:
            check(rows.distinct(), U32)
            found.append(None)
        except Exception as e:  # noqa: BLE001
            found.append(getattr(e, "key", -1))
    return spark.createDataFrame([tuple(found)], "duplicate long, wide long, long long")


@query("select true as same, false as other")
def table_checksum(spark, sf_dir):
    """The checksum does not depend on the layout, and changes with a row."""
    rows = _customers(spark, sf_dir)
    of = lambda df: KeyedTable(df, TableMeta()).checksum()
    whole = of(rows)
    return spark.createDataFrame([(whole == of(rows.orderBy("path").repartition(5)), whole == of(rows.filter("key <> 7")))], "same boolean, other boolean")


@query(f"select path, key + 1 as key from {_KEYS_SQL} t where key % 5 = 0")
def hash_mismatches(spark, sf_dir):
    """Rows whose key is not the hash of their path."""
    keys = _keys(spark, sf_dir)
    return KeyedTable(keys.select(F.when(F.col("key") % 5 == 0, F.col("key") + 1).otherwise(F.col("key")).alias("key"), "path"), U32).mismatches()


# ---- overlays and layers -------------------------------------------------------------------------------------------------

_OVERLAY = {2: "", 3: "put over a miss", 4: "put over a hit", 10**7: "above all"}
_OVERLAY_SQL = f"(values {', '.join(f'({k}, {p!r})' for k, p in _OVERLAY.items())}) o(key, path)"


@query(f"select l_orderkey, l_linenumber, l_partkey as key, coalesce(o.path, t.path) as path, case when o.key is not null then 0 when t.key is not null then 1 end as layer from lineitem left join {_OVERLAY_SQL} on l_partkey = o.key left join {_PARTS_SQL} t on l_partkey = t.key")
def overlay_lookup(spark, sf_dir):
    table = ExtendedTable(_parts(spark, sf_dir))
    table.extend(_OVERLAY.items())
    return table.get_batch(_probes(spark, sf_dir))


@query(f"select k.key::BIGINT as key, coalesce(o.path, t.path, c.c_name) as path from (select unnest([1, 2, 3, 4, 6, 9, 10000000, 77777777]) as key) k left join {_OVERLAY_SQL} on o.key = k.key left join {_PARTS_SQL} t on t.key = k.key left join customer c on c_custkey = k.key")
def layered_point(spark, sf_dir):
    """Single keys through an overlay above two tables."""
    table = LayeredTable(spark, [_parts(spark, sf_dir), KeyedTable(_customers(spark, sf_dir), TableMeta())])
    table.extend(_OVERLAY.items())
    return spark.createDataFrame([(k, table.get(k)) for k in (1, 2, 3, 4, 6, 9, 10**7, 77777777)], "key long, path string")


@query(f"select * from (values ('MergeConfig', 1, 2)) t(refused, layers, overlay) where (select {_fnv_sql(chr(39) + 'a/b.dds' + chr(39))}) > 0")
def layer_construction(spark, sf_dir):
    """Tables of unlike keys cannot be layered; paths put in get the first table's hash."""
    table = LayeredTable(spark)
    missing = table.insert_path("a/b.dds")
    table.push_base(KeyedTable(_nations(spark, sf_dir), U32))
    refused = None
    try:
        table.push_base(KeyedTable(_nations(spark, sf_dir), TableMeta(KeyWidth.U64)))
    except MergeConfig:
        refused = "MergeConfig"
    table.insert(1, "one")
    key = table.insert_path("A/b.dds")
    right = missing is None and table.get(key) == "A/b.dds" and table.contains(1)
    return spark.createDataFrame([(refused, len(table.bases) if right else -1, table.overlay_len)], "refused string, layers int, overlay int")


# ---- generators and the hunt ---------------------------------------------------------------------------------------------


@query("select 'seed/' || p_name as path from part")
def guess_seed_strings(spark, sf_dir):
    """Candidates from any frame with a path."""
    return G.SeedStrings(_t(spark, sf_dir, "part").select(F.concat(F.lit("seed/"), "p_name").alias("path"))).guess(corpus(spark, sf_dir))


@query(f"select c_custkey::BIGINT as key from customer where c_custkey % 2 = 0 and c_custkey not in (select p_partkey from {_PARTS_SQL.replace('as key', 'as p_partkey')} t)")
def hunt_targets(spark, sf_dir):
    """Unknown keys of two sources, copies and known ones left out."""
    keys = _customers(spark, sf_dir).filter("key % 2 = 0").select("key")
    return targets(keys.union(keys.filter("key % 3 = 0")), _parts(spark, sf_dir).df)


_KNOWN_SQL = f"(select path from {_KEYS_SQL} k where key % 3 <> 0)"
_SWAP_KNOWN_SQL = _SWAP_SQL.replace(_CORPUS_SQL, _KNOWN_SQL)


@query(f"select 1 as round, 'extension-swap' as guesser, (select count(*) from ({_SWAP_KNOWN_SQL}) s) as candidates, (select count(distinct k.key) from ({_SWAP_KNOWN_SQL}) s join {_KEYS_SQL} k on k.path = s.path and k.key % 3 = 0) as found")
def hunt_counters(spark, sf_dir):
    """Candidates and finds of a round, counted in one pass."""
    keys = _keys(spark, sf_dir)
    report = Hunt(U32, [G.ExtensionSwap()]).run(keys.filter("key % 3 <> 0").select("path"), keys.filter("key % 3 = 0").select("key"))
    return stats_frame(spark, report).filter("round = 1").select("round", "guesser", "candidates", "found")


@query(f"select count(*) as known, (select count(distinct key) from {_KEYS_SQL} k where key % 3 = 0 and key % 5 <> 0) as unknown, 1::BIGINT as finds from (select path from {_KEYS_SQL} k where key % 3 <> 0 union all select n_name from nation union all select path from {_KEYS_SQL} k where key % 3 = 0 and key % 5 = 0) t")
def hunt_state(spark, sf_dir):
    """Known paths and unknown keys are added, some keys are found: what is known then, and what is left."""
    keys = _keys(spark, sf_dir)
    left = keys.filter("key % 3 = 0")
    state = HuntState(keys.filter("key % 3 <> 0").select("path"), left.filter("key % 2 = 0").select("key")).add_known(_nations(spark, sf_dir)).add_unknown(left.select("key")).promote(left.filter("key % 5 = 0"))
    return spark.createDataFrame([(state.corpus().count(), state.unknown.count(), len(state.finds))], "known long, unknown long, finds long")


class _Upper:
    """A generator of one's own needs a name and ``guess``."""

    name = "upper"

    def guess(self, corpus: DataFrame) -> DataFrame:
        return corpus.select(F.upper("path").alias("path"))


@query(f"select min(upper(path)) as path, {_fnv_sql('lower(path)')} as key, 'upper' as guesser from {_CORPUS_SQL} group by 2")
def hunt_own_guesser(spark, sf_dir):
    """Every key of the corpus is hunted for with a generator that is not the library's."""
    keys = _keys(spark, sf_dir)
    return Hunt(U32, [_Upper()]).run(keys.select("path"), keys.select("key"), count=False).resolved.select("path", "key", "guesser")


@query(f"select lpad(lower(to_hex(key)), 8, '0') || ' ' || lower(min(path)) as value from (select k.key, k.path from ({_SWAP_KNOWN_SQL}) s join {_KEYS_SQL} k on k.path = s.path and k.key % 3 = 0) t group by key")
def hunt_lines(spark, sf_dir):
    """A hunt's finds as the lines of a list."""
    keys = _keys(spark, sf_dir)
    report = Hunt(U32).with_(G.ExtensionSwap()).run(keys.filter("key % 3 <> 0").select("path"), keys.filter("key % 3 = 0").select("key"), count=False)
    return resolved_lines(report, 8, True)


@query("select 'assets/' || lower(n_name) || '.dds' as token, 0 as skipped from nation")
def mine_archive(spark, sf_dir):
    """Strings of an archive's chunks; each chunk here is the name of one nation."""
    folder = _folder(spark, "archives")
    for k, rows in enumerate((lambda n: n < 9, lambda n: n >= 9)):
        with zipfile.ZipFile(folder / f"{k}.zip", "w") as z:
            for r in _nations(spark, sf_dir).collect():  # a fixed table of 25 rows
                if rows(r["key"]):
                    z.writestr(r["path"], f"\0\1 assets/{r['path'].lower()}.dds \2".encode())
    strings, chunks, skipped = mine_report(mine_archives(spark, f"file://{folder}/*.zip"))
    n = skipped.first()["chunks_skipped"] + 25 - chunks.count()
    return strings.withColumn("skipped", F.lit(n).cast("int"))


# ---- the catalog ---------------------------------------------------------------------------------------------------------


def _catalog(spark, sf_dir, name: str = "catalog", version: str = "1", rows: int = 10**9) -> Store:
    """A catalog with customers as the game table and parts as another."""
    folder = _folder(spark, name)
    items = []
    for table, df in (("game", _customers(spark, sf_dir)), ("binfields", _parts(spark, sf_dir).df)):
        write_table_file(df.filter(F.col("key") < rows), str(folder / f"{table}.built"), TABLES[table].meta)
        items.append((table, version, folder / f"{table}.built"))
    store = Store(folder / "store")
    store.commit(items, {"repo": "none"})
    return store


@query(f"select 'game' as id, 'game-1.lhdb' as file, count(*) as entries, 8 as key_width from customer union all select 'binfields', 'binfields-1.lhdb', count(*), 4 from {_PARTS_SQL} t")
def catalog_manifest(spark, sf_dir):
    """What a commit writes into the manifest."""
    return _catalog(spark, sf_dir).manifest().frame(spark).drop("sha256")


@query("select c_custkey::BIGINT as key, c_name as path from customer")
def catalog_open(spark, sf_dir):
    return _catalog(spark, sf_dir).open(spark, "game").df


@query("select * from (values ('binfields', 'opened'), ('lcu', 'TableNotFound'), ('game', 'opened')) t(id, outcome)")
def catalog_open_many(spark, sf_dir):
    """A table that cannot be opened does not stop the others."""
    found = _catalog(spark, sf_dir).open_many(spark, ["binfields", "lcu", "game"])
    return spark.createDataFrame([(n, "opened" if isinstance(t, KeyedTable) else type(t).__name__) for n, t in found], "id string, outcome string")


@query("select l_orderkey, l_linenumber, l_partkey as key, c_name as path, case when c_custkey is not null then 1 end as layer from lineitem left join customer on c_custkey = l_partkey")
def catalog_layered(spark, sf_dir):
    """Lookups through what of a catalog could be opened."""
    stack, failed = _catalog(spark, sf_dir).open_layered(spark, ["rst", "game"])
    if [n for n, _ in failed] != ["rst"]:
        raise RuntimeError(f"{failed}")
    return stack.get_batch(_probes(spark, sf_dir))


@contextlib.contextmanager
def _served(folder: Path):
    class Quiet(http.server.SimpleHTTPRequestHandler):
        def log_message(self, *args):
            pass

    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), partial(Quiet, directory=str(folder))) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        try:
            yield f"http://127.0.0.1:{server.server_address[1]}"
        finally:
            server.shutdown()


_UPDATES = "('directory', 'first', 'binfields,game'), ('directory', 'again', ''), ('http', 'first', 'binfields,game'), ('async', 'first', 'binfields,game'), ('async', 'forced', 'binfields,game'), ('http', 'missing', 'HttpStatus 404'), ('http', 'silent', 'HttpTransport')"


@query(f"select * from (values {_UPDATES}) t(fetcher, run, outcome)")
def catalog_update(spark, sf_dir):
    """Updates from a folder and a server, waiting or not; what the servers do wrong is told apart."""
    source, out = _catalog(spark, sf_dir), []
    names = lambda report: ",".join(sorted(report.installed))

    def failure(base: str) -> str:
        try:
            Store(_folder(spark, "update")).update(http_fetch(base, 5))
        except Exception as e:  # noqa: BLE001
            cause = e.__cause__
            return f"{type(cause).__name__} {cause.status}" if hasattr(cause, "status") else type(cause).__name__
        return "none"

    mine = Store(_folder(spark, "update"))
    out += [("directory", run, names(mine.update(directory_fetch(source.dir)))) for run in ("first", "again")]
    with _served(source.dir) as base:
        out.append(("http", "first", names(Store(_folder(spark, "update")).update(http_fetch(base)))))
        late = Store(_folder(spark, "update"))
        out += [("async", run, names(asyncio.run(late.update_async(http_fetch_async(base), force)))) for run, force in (("first", False), ("forced", True))]
        out.append(("http", "missing", failure(f"{base}/elsewhere")))
    out.append(("http", "silent", failure(base)))
    return spark.createDataFrame(out, "fetcher string, run string, outcome string")


@query("select * from (values ('binfields-1.lhdb'), ('game-1.lhdb'), ('left.tmp')) t(file)")
def catalog_gc(spark, sf_dir):
    """What is deleted once a newer version is published."""
    store, newer = _catalog(spark, sf_dir), _catalog(spark, sf_dir, version="2", rows=50)
    (store.dir / "left.tmp").write_bytes(b"")
    (store.dir / "note.txt").write_bytes(b"")
    store.commit([(t, "2", newer.path_for(t)) for t in ("game", "binfields")])
    return spark.createDataFrame([(p.name,) for p in store.gc().deleted], "file string")


@query("select '/named/folder' as folder, sha256('content') as digest, 0::BIGINT as left_over, 'content' as copied")
def catalog_files(spark, sf_dir):
    """The folder that the environment names; files are put in place as a whole."""
    folder, before = _folder(spark, "files"), os.environ.get(ENV)
    os.environ[ENV] = "/named/folder"
    try:
        named = str(cache_dir())
    finally:
        os.environ.pop(ENV)
        os.environ.update({ENV: before} if before is not None else {})
    write_durably(folder / "a", b"content")
    copy_durably(folder / "a", folder / "b")
    return spark.createDataFrame([(named, sha256_file(folder / "b"), len(list(folder.glob("*.tmp"))), (folder / "b").read_text())], "folder string, digest string, left_over long, copied string")


@query("select true as first, false as second, true as after")
def catalog_lock(spark, sf_dir):
    """One updater at a time."""
    store = Store(_folder(spark, "lock"))
    with store.try_lock() as first, store.try_lock() as second:
        pass
    with store.try_lock() as after:
        return spark.createDataFrame([(first, second, after)], "first boolean, second boolean, after boolean")


_FILES_SQL = "(select case n_regionkey when 0 then 'game-' || n_name || '.lhdb' when 1 then 'game-.lhdb' when 2 then 'game-a/' || n_name || '.lhdb' when 3 then 'lcu-' || n_name || '.lhdb' else 'game-' || n_name || '.json' end as file from nation)"


@query(f"select distinct file, nullif(regexp_extract(file, '^game-([^/]+)\\.lhdb$', 1), '') as version from {_FILES_SQL} t")
def version_names(spark, sf_dir):
    """The version in a file's name, if the name is one."""
    rows = _t(spark, sf_dir, "nation").select("n_regionkey", "n_name").collect()  # a fixed table of 25 rows
    name = lambda r, n: [f"game-{n}.lhdb", "game-.lhdb", f"game-a/{n}.lhdb", f"lcu-{n}.lhdb", f"game-{n}.json"][r]
    files = {name(r["n_regionkey"], r["n_name"]) for r in rows}
    return spark.createDataFrame([(f, version_of("game", f)) for f in sorted(files)], "file string, version string")


@query("select n_nationkey::BIGINT as n, strftime(make_timestamp((n_nationkey::BIGINT * 86399 * 365) * 1000000), '%Y-%m-%dT%H:%M:%SZ') as at from nation")
def release_times(spark, sf_dir):
    rows = _t(spark, sf_dir, "nation").select("n_nationkey").collect()  # a fixed table of 25 rows
    return spark.createDataFrame([(r[0], rfc3339(r[0] * 86399 * 365)) for r in rows], "n long, at string")


_ERRORS = ["BadMagic", "ChecksumMismatch", "DuplicateKey", "InvalidVersion", "KeyOutOfRange", "Malformed", "MalformedHeader", "ManifestError", "ManifestMissing", "PathTooLong", "TableNotFound", "UnsupportedSchema", "UnsupportedVersion", "VersionReused", "ZeroFrameSize"]


@query(f"select unnest({_ERRORS}) as error")
def error_kinds(spark, sf_dir):
    """Every way to fail has an error of its own."""
    from .plans.catalog import Manifest
    from .sources.tablefile import encode_table

    store, newer = _catalog(spark, sf_dir), _catalog(spark, sf_dir, rows=50)
    good = encode_table([(1, "a"), (2, "b")], TableMeta(), None)
    spoiled = good[:-1] + bytes([good[-1] ^ 1])
    attempts = [
        lambda: open_bytes(b"X" + good[1:]), lambda: open_bytes(spoiled).verify(), lambda: encode_table([(1, "a"), (1, "b")], TableMeta()), lambda: store.commit([("game", "a/b", newer.path_for("game"))]), lambda: encode_table([(1 << 32, "a")], U32),
        lambda: open_bytes(good[:-1]), lambda: open_bytes(good[:20]), lambda: Manifest.parse(b"{"), lambda: Store(_folder(spark, "none")).manifest(), lambda: encode_table([(1, "a" * 65536)], TableMeta()), lambda: store.path_for("rst"),
        lambda: Manifest.parse(b'{"schema": 99, "generated_at": "", "tables": {}}'), lambda: open_bytes(good[:8] + b"\x09" + good[9:]), lambda: store.commit([("game", "1", newer.path_for("game"))]), lambda: encode_table([(1, "a")], TableMeta(), 0),
    ]

    def outcome(f) -> str:
        try:
            f()
        except Exception as e:  # noqa: BLE001
            return type(e).__name__
        return "none"

    return spark.createDataFrame([(outcome(f),) for f in attempts], "error string")


# ---- the command line ----------------------------------------------------------------------------------------------------


def _built(spark, sf_dir) -> Path:
    """A table file made by the command line from the customers' list."""
    folder = _folder(spark, "cli")
    hash_lines(_customers(spark, sf_dir), 16).write.text(f"file://{folder}/list")
    if cli.main(["build", "--input", f"file://{folder}/list", "--table", "lcu", "--out", f"{folder}/lcu.lhdb", "--level", "3"]):
        raise RuntimeError("build failed")
    return folder


def _printed(*args: str) -> tuple[int, str]:
    """Exit code and output of the command line."""
    import io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        code = cli.main(list(args))
    return code, out.getvalue().strip()


@query("select c_custkey::BIGINT as key, 0 as code, c_name as printed from customer where c_custkey < 20 union all select 99999999, 1, ''")
def cli_get(spark, sf_dir):
    """Keys asked of a built file by the command line."""
    file = str(_built(spark, sf_dir) / "lcu.lhdb")
    return spark.createDataFrame([(k, *_printed("get", f"0x{k:x}", "--file", file)) for k in (*range(20), 99999999)], "key long, code int, printed string")


@query("select count(*) as entries, 8::BIGINT as key_width, 'XXH64' as hash_kind, sum(strlen(c_name))::BIGINT as arena_bytes, 0 as verified from customer")
def cli_stats(spark, sf_dir):
    """What the command line says of a file, and whether it verifies."""
    file = str(_built(spark, sf_dir) / "lcu.lhdb")
    said = dict(line.split(": ") for line in _printed("stats", file)[1].split("\n"))
    return spark.createDataFrame([(int(said["entries"]), int(said["key_width"]), said["hash_kind"], int(said["arena_bytes"]), _printed("verify", file)[0])], "entries long, key_width long, hash_kind string, arena_bytes long, verified int")


@query("select c_custkey::BIGINT as key, c_name as path, 1 as without from customer")
def cli_bundle_update(spark, sf_dir):
    """A release made of one list, installed elsewhere; without leave to miss lists it is refused."""
    folder = _folder(spark, "release")
    (folder / "lists").mkdir()
    lines = hash_lines(_customers(spark, sf_dir), 16).toLocalIterator()
    with open(folder / "lists" / "hashes.lcu.txt", "w", encoding="utf-8") as f:
        f.writelines(r["value"] + "\n" for r in lines)
    args = ["bundle", "--inputs", f"{folder}/lists", "--out", f"{folder}/out", "--version", "7", "--level", "3"]
    refused = cli.main(args)
    if cli.main([*args, "--allow-missing"]) or cli.main(["update", "--from-dir", f"{folder}/out", "--dir", f"{folder}/store"]):
        raise RuntimeError("bundle or update failed")
    return Store(folder / "store").open(spark, "lcu").df.withColumn("without", F.lit(refused))


@query(f"select lpad(lower(to_hex(key)), 8, '0') || ' ' || path as value from (select distinct k.key, k.path from ({_SWAP_KNOWN_SQL}) s join {_KEYS_SQL} k on k.path = s.path and k.key % 3 = 0) t")
def cli_gen(spark, sf_dir):
    """A hunt by the command line: known list and unknown keys in, found lines out (numbers are not swept, as no number is unknown)."""
    folder, keys = _folder(spark, "gen"), _keys(spark, sf_dir)
    hash_lines(keys.filter("key % 3 <> 0"), 8).write.text(f"file://{folder}/known")
    swaps = G.ExtensionSwap().guess(keys.filter("key % 3 <> 0").select("path"))
    keys.filter("key % 3 = 0").join(swaps.distinct(), "path", "left_semi").select(F.lower(F.hex("key"))).write.text(f"file://{folder}/unknown")
    if cli.main(["gen", "--known", f"file://{folder}/known", "--unknown", f"file://{folder}/unknown", "--table", "binentries", "--out", f"{folder}/found.txt"]):
        raise RuntimeError("gen failed")
    return spark.read.text(f"file://{folder}/found.txt")
