"""Registered queries of the library's own operators, each with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import strings as S
from .functions.hashing import fnv1a32, hash_path, xxh3, xxh64
from .functions.human import duration, grouped, mebibytes
from .functions.keys import format_hex, parse_hex
from .meta import TABLES, Casing, HashKind, KeyWidth, TableMeta
from .operators import guessers as G
from .operators.layered import resolve
from .operators.table import KeyedTable, adjacent_conflicts, arena_offsets, conflicts, frame_ids, merge_lists, merge_report
from .plans.catalog import gc_frame, plan_frame
from .plans.hunt import Hunt, hits
from .registry import QUERIES, SQL, query
from .registry import table as _t
from .session import checkpointed, shared_dir
from .sources.tablefile import read_table_file, write_table_file
from .sources.mining import scan_tokens, tree_strings
from .sources.textio import parse_hash_lines

U32 = TableMeta(KeyWidth.U32, HashKind.FNV1A32, Casing.INSENSITIVE)

# ---- the corpus: asset paths made of the parts -------------------------------------------------------------------------

_CORPUS_SQL = """(select distinct 'assets/characters/' || w1 || '/skins/skin' || sz || '/' || w1 || '_' || w2 || '_skin' || sz || '.' || ext as path
  from (select split_part(p_name, ' ', 1) as w1, split_part(p_name, ' ', 2) as w2, lpad(cast(p_size as varchar), 2, '0') as sz, lower(substr(p_type, 1, 3)) as ext from part) p0)"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct asset paths; some hundred to a few thousand at any scale, spread out before they are exploded."""
    word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    size = F.lpad(F.col("p_size").cast("string"), 2, F.lit("0"))
    path = F.concat(F.lit("assets/characters/"), word(1), F.lit("/skins/skin"), size, F.lit("/"), word(1), F.lit("_"), word(2), F.lit("_skin"), size, F.lit("."), F.lower(F.substring("p_type", 1, 3)))
    return _t(spark, sf_dir, "part").select(path.alias("path")).distinct()


def lcu_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same below a plugin's region and locale, chosen by the part's number."""
    both = _t(spark, sf_dir, "part").select("p_partkey").withColumn("r", F.get(F.array(*map(F.lit, G.REGIONS)), (F.col("p_partkey") % 26).cast("int"))).withColumn("l", F.get(F.array(*map(F.lit, G.LOCALES)), (F.col("p_partkey") % 30).cast("int")))
    return both.select(F.concat(F.lit(S.MOUNT), "r", F.lit("/"), "l", F.lit("/data/item"), F.col("p_partkey").cast("string"), F.lit(".json")).alias("path"))


def _list_sql(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_LCU_SQL = f"""(select '{S.MOUNT}' || ({_list_sql(G.REGIONS)})[p_partkey % 26 + 1] || '/' || ({_list_sql(G.LOCALES)})[p_partkey % 30 + 1] || '/data/item' || p_partkey || '.json' as path from part)"""


def _fnv_sql(text: str) -> str:
    data = f"hex(encode({text}))"
    return f"list_reduce(list_prepend(2166136261::UBIGINT, list_transform(range(0, length({data}) // 2), lambda i: ('0x' || substr({data}, 2 * i + 1, 2))::UBIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295::UBIGINT)::BIGINT"


def _hex_sql(key: str) -> str:
    return f"lower(lpad(to_hex(case when {key} < 0 then ({key}::HUGEINT + 18446744073709551616)::UBIGINT else {key}::UBIGINT end), 16, '0'))"


# ---- hashes and keys -----------------------------------------------------------------------------------------------------


@query(f"select path, {_fnv_sql('lower(path)')} as key from {_CORPUS_SQL}")
def hash_fnv1a32(spark, sf_dir):
    return corpus(spark, sf_dir).select("path", hash_path(F.col("path"), U32).alias("key"))


@query(f"select item_id, {_fnv_sql('text')} as key from benchmark")
def hash_fnv1a32_text(spark, sf_dir):
    """Whole texts, accents and all."""
    return _t(spark, sf_dir, "benchmark").select("item_id", fnv1a32(F.col("text")).alias("key"))


@query()
def hash_xxh64(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", xxh64(F.col("text")).alias("key"))


@query()
def hash_xxh3(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", xxh3(F.col("text")).alias("key"))


@query(f"select o_orderkey, {_hex_sql('k')} as hex from (select o_orderkey, case when o_orderkey % 2 = 0 then -o_orderkey * 1000003 else o_orderkey * 7919 end as k from orders) t")
def hex_format(spark, sf_dir):
    k = F.when(F.col("o_orderkey") % 2 == 0, -F.col("o_orderkey") * 1000003).otherwise(F.col("o_orderkey") * 7919)
    return _t(spark, sf_dir, "orders").select("o_orderkey", format_hex(k).alias("hex"))


@query("select o_orderkey, case when o_orderkey % 5 = 0 then null else o_orderkey * 7919 end as key from orders")
def hex_parse(spark, sf_dir):
    """Hex with and without prefix; what is no hex is null."""
    text = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("zz"), F.col("o_orderkey").cast("string"))).when(F.col("o_orderkey") % 5 == 1, F.concat(F.lit("0x"), F.hex(F.col("o_orderkey") * 7919))).otherwise(F.lower(F.hex(F.col("o_orderkey") * 7919)))
    return _t(spark, sf_dir, "orders").select("o_orderkey", parse_hex(text).alias("key"))


@query("select doc_id, sha256(text) as digest from documents")
def sha256_docs(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("select key, row_number() over (order by case when key < 0 then key::HUGEINT + 18446744073709551616 else key end) as place from (select distinct case when n_nationkey % 2 = 0 then -n_nationkey - 1 else n_nationkey end::BIGINT as key from nation) t")
def unsigned_order(spark, sf_dir):
    from pyspark.sql import Window

    from .functions.keys import unsigned

    keys = _t(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, -F.col("n_nationkey") - 1).otherwise(F.col("n_nationkey")).cast("long").alias("key")).distinct()
    return keys.select("key", F.row_number().over(Window.orderBy(unsigned(F.col("key")))).cast("long").alias("place"))  # a fixed table of 25 rows


# ---- lookups -------------------------------------------------------------------------------------------------------------

_PARTS_SQL = "(select p_partkey as key, p_name as path from part where p_partkey % 3 <> 0)"


def _parts(spark, sf_dir) -> KeyedTable:
    return KeyedTable(_t(spark, sf_dir, "part").filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("path")), TableMeta())


def _probes(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("key"))


@query(f"select l_orderkey, l_linenumber, l_partkey as key, t.path as path, t.key is not null as hit from lineitem left join {_PARTS_SQL} t on l_partkey = t.key")
def lookup_batch(spark, sf_dir):
    return _parts(spark, sf_dir).get_batch(_probes(spark, sf_dir))


@query(f"select l_orderkey, l_linenumber, l_partkey as key, t.key is not null as known from lineitem left join {_PARTS_SQL} t on l_partkey = t.key")
def lookup_contains(spark, sf_dir):
    return _parts(spark, sf_dir).contains(_probes(spark, sf_dir))


@query(f"select l_orderkey, l_linenumber, l_partkey as key from lineitem where l_partkey in (select key from {_PARTS_SQL} t)")
def lookup_semi(spark, sf_dir):
    return _parts(spark, sf_dir).known(_probes(spark, sf_dir))


@query(f"select l_orderkey, l_linenumber, l_partkey as key from lineitem where l_partkey not in (select key from {_PARTS_SQL} t)")
def lookup_anti(spark, sf_dir):
    return _parts(spark, sf_dir).unknown(_probes(spark, sf_dir))


_POINTS = [0, 1, 3, 7, 8, 1999, 10**6]


@query(f"select k.key::BIGINT as key, t.path as path from (select unnest({_POINTS}) as key) k left join {_PARTS_SQL} t on t.key = k.key")
def lookup_point(spark, sf_dir):
    """Single keys, hits and misses, each by a filter that reaches the scan."""
    parts = _parts(spark, sf_dir)
    return spark.createDataFrame([(k, parts.get(k)) for k in _POINTS], "key long, path string")


_LAYERS_SQL = """select event_id, user_id as key,
  case when o.key is not null then o.path when a.key is not null then a.path else b.path end as path,
  case when o.key is not null then 0 when a.key is not null then 1 when b.key is not null then 2 end as layer
from events left join (select s_suppkey as key, case when s_suppkey % 2 = 0 then '' else s_name end as path from supplier where s_suppkey % 4 < 2) o on user_id = o.key
left join (select s_suppkey as key, s_name as path from supplier) a on user_id = a.key
left join (select c_custkey as key, c_name as path from customer) b on user_id = b.key"""


@query(_LAYERS_SQL)
def lookup_layered(spark, sf_dir):
    """An overlay that also holds empty paths, above two tables."""
    s, c = _t(spark, sf_dir, "supplier"), _t(spark, sf_dir, "customer")
    over = s.filter("s_suppkey % 4 < 2").select(F.col("s_suppkey").alias("key"), F.when(F.col("s_suppkey") % 2 == 0, F.lit("")).otherwise(F.col("s_name")).alias("path"))
    layers = [over, s.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("path")), c.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("path"))]
    return resolve(_t(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key")), layers)


# ---- build, merge, verify ------------------------------------------------------------------------------------------------


@query("select distinct p_size::BIGINT as key, p_brand as path from part")
def build_dedup(spark, sf_dir):
    return _t(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("key"), F.col("p_brand").alias("path")).dropDuplicates(["key", "path"])


@query("select s_nationkey as key, count(distinct s_name) as n_paths from supplier group by 1 having count(distinct s_name) > 1")
def build_conflicts(spark, sf_dir):
    return conflicts(_t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"), F.col("s_name").alias("path")))


@query("select * from (select s_nationkey as key, s_name as path, lead(s_name) over (partition by s_nationkey order by s_name) as next_path from supplier) t where next_path is not null")
def adjacent_paths(spark, sf_dir):
    return adjacent_conflicts(_t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"), F.col("s_name").alias("path")).distinct())


def _lists(spark, sf_dir) -> list[DataFrame]:
    c, s = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "supplier")
    one = c.select(F.lower(F.hex("c_custkey")).alias("hex"), F.col("c_custkey").alias("key"), F.col("c_name").alias("path"))
    return [one, s.select(F.lower(F.hex("s_suppkey")).alias("hex"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("path")), one.filter("key % 2 = 0")]


_MERGED_SQL = "(select c_custkey as key, c_name as path from customer union select s_suppkey, s_name from supplier)"


@query(f"select * from {_MERGED_SQL} t")
def merge_union(spark, sf_dir):
    return merge_lists(_lists(spark, sf_dir))


@query(f"select sum(n)::BIGINT as entries, sum(n - 1)::BIGINT as conflicts, (select max(length(to_hex(c_custkey))) from customer) as digits from (select key, count(*) as n from {_MERGED_SQL} m group by key) t")
def merge_summary(spark, sf_dir):
    lists = _lists(spark, sf_dir)
    return merge_report(merge_lists(lists), lists).select("entries", "conflicts", F.col("digits").cast("long").alias("digits"))


@query(f"select count(*) as entries, count(distinct path) as paths, sum(strlen(path))::BIGINT as arena_bytes, max(strlen(path)) as longest from {_CORPUS_SQL}")
def table_stats(spark, sf_dir):
    return KeyedTable(corpus(spark, sf_dir).select(F.xxhash64("path").alias("key"), "path"), TableMeta()).stats()


@query("""select (select count(*) from (select s_nationkey from supplier group by 1 having count(*) > 1)) as repeated_keys, (select count(distinct n_nationkey) from nation where n_nationkey % 5 = 0) as wide_keys,
  (select count(distinct s_nationkey) from supplier where s_suppkey % 7 = 0) as long_paths, (select count(*) from region) as broken_paths""")
def verify_table(spark, sf_dir):
    """A 32-bit table with every kind of violation in it."""
    s, n, r = _t(spark, sf_dir, "supplier"), _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    rows = s.select(F.col("s_nationkey").cast("long").alias("key"), F.when(F.col("s_suppkey") % 7 == 0, F.rpad("s_name", 65536, "x")).otherwise(F.col("s_name")).alias("path"))
    wide = n.filter("n_nationkey % 5 = 0").select((F.col("n_nationkey") + (1 << 32)).cast("long").alias("key"), F.col("n_name").alias("path"))
    broken = r.select((F.col("r_regionkey") + 1000).cast("long").alias("key"), F.unhex(F.lit("61FF62")).cast("string").alias("path"))
    return KeyedTable(rows.union(wide).union(broken), U32).violations()


@query(f"select path, strlen(path) as length, coalesce(sum(strlen(path)) over (order by path rows between unbounded preceding and 1 preceding), 0)::BIGINT as \"offset\" from {_CORPUS_SQL}")
def arena_layout(spark, sf_dir):
    return arena_offsets(corpus(spark, sf_dir))


@query(f"""select path, "offset" // 4096 as first_frame, ("offset" + length - 1) // 4096 as last_frame from (
select path, strlen(path) as length, coalesce(sum(strlen(path)) over (order by path rows between unbounded preceding and 1 preceding), 0)::BIGINT as "offset" from {_CORPUS_SQL}) t""")
def arena_frames(spark, sf_dir):
    return frame_ids(arena_offsets(corpus(spark, sf_dir)), 4096).select("path", "first_frame", "last_frame")


@query("select c_custkey as key, c_name || ' ' as path from customer")
def list_lines(spark, sf_dir):
    """Lines of a list, parsed: the path keeps its spaces."""
    lines = _t(spark, sf_dir, "customer").select(F.lit("list").alias("file"), F.concat(F.hex("c_custkey"), F.lit(" "), "c_name", F.lit(" ")).alias("value"))
    return parse_hash_lines(lines).select("key", "path")


@query(f"select path, {_fnv_sql('lower(path)')} as key from {_CORPUS_SQL}")
def table_file_scan(spark, sf_dir):
    """The corpus as a binary table file, written and read again."""
    table = KeyedTable.of_paths(corpus(spark, sf_dir), U32)
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}.lhdb"
    write_table_file(table.df, path, U32)
    table.release()
    return read_table_file(spark, path).select("path", "key")


@query("select p_partkey as key, p_name as path from part order by md5('3:' || p_partkey), p_partkey limit 100")
def sample_rows(spark, sf_dir):
    return KeyedTable(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("path")), TableMeta()).sample(100, seed=3)


@query("""select p_partkey, format('{:,}', p_partkey * 1234) as grouped, format('{:,.1f}', p_partkey * 123457 / 1048576.0) || ' MiB' as mebibytes,
  case when p_partkey % 4 = 0 then format('{:,}', p_partkey % 1000) || ' ns' when p_partkey % 4 = 1 then format('{:,.1f}', (1000 + p_partkey % 900 * 1001) / 1000.0) || ' µs'
  when p_partkey % 4 = 2 then format('{:,.1f}', (1000000 + p_partkey % 900 * 1000001) / 1000000.0) || ' ms' else format('{:,.1f}', (1000000000 + p_partkey * 1000000001) / 1000000000.0) || ' s' end as duration from part""")
def human_numbers(spark, sf_dir):
    k = F.col("p_partkey")
    ns = F.when(k % 4 == 0, k % 1000).when(k % 4 == 1, 1000 + k % 900 * 1001).when(k % 4 == 2, 1000000 + k % 900 * 1000001).otherwise(1000000000 + k * 1000000001)
    return _t(spark, sf_dir, "part").select(k, grouped(k * 1234).alias("grouped"), mebibytes(k * 123457).alias("mebibytes"), duration(ns).alias("duration"))


# ---- vocabularies and generators -----------------------------------------------------------------------------------------


@query(rf"select distinct w as word from (select unnest(regexp_split_to_array(path, '[/_\-. ]')) as w from {_CORPUS_SQL}) t where strlen(w) >= 2 and not regexp_full_match(w, '[0-9]+')")
def wordlist(spark, sf_dir):
    return G.wordlist(corpus(spark, sf_dir))


@query(f"select distinct regexp_extract(path, '(?:^|/)characters/([0-9A-Za-z]+)(?:/|$)', 1) as champion from {_CORPUS_SQL}")
def champions(spark, sf_dir):
    return G.champions(corpus(spark, sf_dir))


@query(rf"select regexp_extract(path, '\.([0-9A-Za-z]+)$', 1) as ext from {_CORPUS_SQL} union select unnest({_list_sql(G.EXTENSIONS)})")
def extensions(spark, sf_dir):
    return G.extensions(corpus(spark, sf_dir))


_EXT_SQL = rf"(select regexp_extract(path, '\.([0-9A-Za-z]+)$', 1) as ext from {_CORPUS_SQL} union select unnest({_list_sql(G.EXTENSIONS)}) as ext)"
_SWAP_SQL = rf"select regexp_replace(path, '\.[^./]*$', '') || '.' || ext as path from {_CORPUS_SQL} c, {_EXT_SQL} e where ext <> regexp_extract(path, '\.([0-9A-Za-z]+)$', 1)"


@query(_SWAP_SQL)
def guess_extension_swap(spark, sf_dir):
    return G.ExtensionSwap().guess(corpus(spark, sf_dir))


@query(f"select regexp_replace(path, '([^/]*)$', p || '\\1') as path from {_CORPUS_SQL} c, (select unnest({_list_sql(G.PREFIXES)}) as p) x")
def guess_prefix_variants(spark, sf_dir):
    return G.PrefixVariants().guess(corpus(spark, sf_dir))


@query(f"select '{S.MOUNT}global/default/' || path as path from {_CORPUS_SQL} c union all select regexp_extract(path, '^{S.MOUNT}[^/]*/[^/]*/(.*)$', 1) from {_LCU_SQL} x")
def guess_cross_reference(spark, sf_dir):
    return G.CrossReference().guess(corpus(spark, sf_dir).unionByName(lcu_corpus(spark, sf_dir)))


_NUMBER_SQL = f"""with c as (select path, regexp_extract(path, '^(.*skins/skin)([0-9]+)(.*)$', 1) as a, regexp_extract(path, 'skins/skin([0-9]+)', 1) as r, regexp_extract(path, 'skins/skin[0-9]+(.*)$', 1) as z,
  regexp_extract(path, '^(.*_skin)[0-9]+[.]', 1) as a2, regexp_extract(path, '_skin[0-9]+([.].*)$', 1) as z2 from {_CORPUS_SQL}),
runs as (select a, r, z from c union all select a2, r, z2 from c), n as (select unnest(range(0, 201)) as n)
select a || n || z as path from runs, n union all select a || '0' || n || z from runs, n where n < 10"""


@query(_NUMBER_SQL)
def guess_numeric_range(spark, sf_dir):
    return G.NumericRange().guess(corpus(spark, sf_dir))


_SKIN_SQL = f"""with c as (select path, regexp_extract(path, 'skins/skin([0-9]+)', 1) as r from {_CORPUS_SQL}), n as (select unnest(range(0, 101)) as n)
select regexp_replace(path, 'skin[0-9]+', 'skin' || lpad(n::VARCHAR, greatest(2, length(n::VARCHAR))::INT, '0'), 'g') as path from c, n where n <> r::INT
union all select regexp_replace(path, 'skin[0-9]+', 'skin' || n, 'g') from c, n where n <> r::INT and r like '0%'"""


@query(_SKIN_SQL)
def guess_skin_sweep(spark, sf_dir):
    return G.CharacterSkin().sweep(corpus(spark, sf_dir))


_CHAMP_SQL = f"""with c as (select path, regexp_extract(path, 'characters/([0-9A-Za-z]+)/', 1) as own from {_CORPUS_SQL}), o as (select distinct own as other from c),
marked as (select own, regexp_replace(path, '([/_.-])', chr(1) || '\\1' || chr(1), 'g') as m from c)
select replace(replace(chr(1) || m || chr(1), chr(1) || own || chr(1), chr(1) || other || chr(1)), chr(1), '') as path from marked, o where own <> other"""


@query(_CHAMP_SQL)
def guess_champion_transfer(spark, sf_dir):
    return G.CharacterSkin(0).transfer(corpus(spark, sf_dir))


@query(
    f"with c as (select string_split(path, '/') as s from {_LCU_SQL} x), r as (select unnest({_list_sql(G.REGIONS)}) as r), l as (select unnest({_list_sql(G.LOCALES)}) as l) "
    f"select s[1] || '/' || s[2] || '/' || r || '/' || l || '/' || array_to_string(s[5:], '/') as path from c, r, l where list_contains({_list_sql(G.REGIONS)}, s[3]) and (s[3] <> r or s[4] <> l)"
)
def guess_region_locale(spark, sf_dir):
    return G.RegionLocale().guess(lcu_corpus(spark, sf_dir))


_WORDS_SQL = rf"(select distinct w as word from (select unnest(regexp_split_to_array(path, '[/_\-. ]')) as w from {_CORPUS_SQL}) t where strlen(w) >= 2 and not regexp_full_match(w, '[0-9]+'))"
_STEM_SQL = rf"(select regexp_extract(path, '^(.*/)', 1) as dir, regexp_extract(path, '([^/]*)\.[^./]*$', 1) as stem, regexp_extract(path, '(\.[^./]*)$', 1) as ext from {_CORPUS_SQL})"
_SUBST_SQL = f"""with c as (select dir, string_split(stem, '_') as t, ext from {_STEM_SQL} x), i as (select unnest([1, 2, 3]) as i)
select dir || array_to_string(list_transform(range(1, 4), lambda k: case when k = i then word else t[k] end), '_') || ext as path from c, i, {_WORDS_SQL} w where t[i] <> word"""


@query(_SUBST_SQL)
def guess_word_substitution(spark, sf_dir):
    return G.WordSubstitution().guess(corpus(spark, sf_dir))


@query(f"select dir || case f when 0 then stem || '_' || word when 1 then word || '_' || stem when 2 then stem || '-' || word else word || '-' || stem end || ext as path from {_STEM_SQL} c, {_WORDS_SQL} w, (select unnest([0, 1, 2, 3]) as f) x")
def guess_word_add(spark, sf_dir):
    return G.WordAdd().guess(corpus(spark, sf_dir))


# ---- the hunt ------------------------------------------------------------------------------------------------------------


def _keys(spark, sf_dir) -> DataFrame:
    return checkpointed(corpus(spark, sf_dir).select("path", hash_path(F.col("path"), U32).alias("key")))


_KEYS_SQL = f"(select path, {_fnv_sql('lower(path)')} as key from {_CORPUS_SQL})"


@query(
    rf"with k as (select * from {_KEYS_SQL} x), known as (select path from k where key % 3 <> 0), e as (select regexp_extract(path, '\.([0-9A-Za-z]+)$', 1) as ext from known union select unnest({_list_sql(G.EXTENSIONS)})), "
    rf"c as (select regexp_replace(path, '\.[^./]*$', '') || '.' || ext as path from known, e where ext <> regexp_extract(path, '\.([0-9A-Za-z]+)$', 1)), h as (select distinct path from c) "
    rf"select k.key, min(h.path) as path from h join k on k.path = h.path and k.key % 3 = 0 group by k.key"
)
def hunt_round(spark, sf_dir):
    """One generator against the keys of a third of the corpus (here the oracle matches by path)."""
    keys = _keys(spark, sf_dir)
    known, unknown = keys.filter("key % 3 <> 0").select("path"), keys.filter("key % 3 = 0").select("key")
    return hits(G.ExtensionSwap().guess(known), unknown, U32)


@query(
    f"""with recursive n as (select key, path, split_part(path, '/', 3) as champ, split_part(path, '/', 5) as skin, split_part(split_part(path, '/', 6), '_', 2) as noun, split_part(path, '.', 2) as ext from {_KEYS_SQL} k),
reached(path) as (select path from n where key % 3 <> 0 union select b.path from reached r join n a on a.path = r.path join n b on b.noun = a.noun and (a.champ <> b.champ)::INT + (a.skin <> b.skin)::INT + (a.ext <> b.ext)::INT = 1)
select key, path from n where key % 3 = 0 and path in (select path from reached)"""
)
def hunt_fixpoint(spark, sf_dir):
    """Rounds of the game table's generators until nothing more is found; a step that leads to a path of the corpus changes its champion, its skin or its extension."""
    keys = _keys(spark, sf_dir)
    known, unknown = keys.filter("key % 3 <> 0").select("path"), keys.filter("key % 3 = 0").select("key")
    report = Hunt.for_table("game", U32, faithful=False).run(known, unknown, count=False)
    return report.resolved.select("key", "path")


# ---- mining --------------------------------------------------------------------------------------------------------------

_TRIM = "trim(t, '.-')"


def _tokens_sql(table: str, column: str) -> str:
    return rf"select distinct {_TRIM} as token from (select unnest(regexp_extract_all({column}, '[A-Za-z0-9_./-]+')) as t from {table}) x where length({_TRIM}) between 4 and 300 and ({_TRIM} like '%/%' or {_TRIM} like '%.%')"


@query(_tokens_sql("pages", "html"))
def mine_tokens(spark, sf_dir):
    return scan_tokens(_t(spark, sf_dir, "pages"), "html").distinct()


@query(_tokens_sql("documents", "text"))
def mine_documents(spark, sf_dir):
    return scan_tokens(_t(spark, sf_dir, "documents"), "text").distinct()


@query("select distinct json_keys(props)[1] as token from events")
def mine_trees(spark, sf_dir):
    return tree_strings(_t(spark, sf_dir, "events"), "props").distinct()


# ---- catalog -------------------------------------------------------------------------------------------------------------


@query(f"""with remote as (select case when n_nationkey < 8 then ({_list_sql(list(TABLES))})[n_nationkey + 1] else 'other' || n_nationkey end as id, n_name as file, sha256(n_name) as sha from nation)
select id, file, case when id like 'other%' then 'unknown' when ascii(substr(file, 1, 1)) % 2 = 0 then 'keep' else 'download' end as action from remote""")
def manifest_plan(spark, sf_dir):
    n = _t(spark, sf_dir, "nation")
    name = F.get(F.array(*map(F.lit, TABLES)), F.col("n_nationkey").cast("int"))
    remote = n.select(F.when(F.col("n_nationkey") < 8, name).otherwise(F.concat(F.lit("other"), F.col("n_nationkey").cast("string"))).alias("id"), F.col("n_name").alias("file"), F.sha2("n_name", 256).alias("sha256"))
    local = remote.withColumn("sha256", F.when(F.ascii("file") % 2 == 0, F.col("sha256")).otherwise(F.lit("old")))
    known = spark.createDataFrame([(t,) for t in TABLES], "id string")
    return plan_frame(remote, local, local.select("file"), known)


@query("select n_name || '.lhdb' as file from nation where n_regionkey <> 1 union all select n_name || '.tmp' from nation where n_regionkey = 2")
def gc_candidates(spark, sf_dir):
    n = _t(spark, sf_dir, "nation")
    of = lambda end: F.concat("n_name", F.lit(end)).alias("file")
    files = n.select(of(".lhdb")).union(n.filter("n_regionkey = 2").select(of(".tmp"))).union(n.select(of(".json")))
    return gc_frame(files, n.filter("n_regionkey = 1").select(of(".lhdb")))


def _registered() -> None:
    import_module("pathloom.queries_files")  # builds on this module


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _registered()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _registered()
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of the corpus, looked up in the table built from two thirds of it."""
    keys = corpus(spark, sf_dir).select("path", hash_path(F.col("path"), U32).alias("key"))
    table = KeyedTable(keys.filter("key % 3 <> 0").select("key", "path"), U32)
    return table.get_batch(keys.select("key"))

