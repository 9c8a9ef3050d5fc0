"""Document fingerprints by spot signatures, in DataFrame functions only.

A signature is an anchor (a common word) and the chain of the ``CHAIN`` content
words that follow it; content words are those that are no anchors.  A text's
fingerprint is its sorted set of distinct signatures, and two are compared by
the Jaccard of the sets, told apart by 64-bit hashes.  Sets are put into
partitions by length; where a caller asks for pairs of at least some likeness
only, those whose partitions or lengths lie too far apart for it are pruned
before any signature is looked at.

A text with no anchor before two content words falls back to the set of its
word pairs, then of its words, then to the hash of the text, so unlike short
texts have unlike fingerprints and equal texts always equal ones.

Neighbours come together in one shuffle of the texts: ranges of ids, cut by a
sample of them, are buckets, and each bucket also gets the first document of the
next one.  So every text's signatures are found once, and once more those of its
edited text.

Defined cases: a null text is empty; documents of the same id follow each other
in order of a hash of their text, equal rows count as one document in that
order (and are each returned); a null id comes first; the only document is its
own next one; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table, text_of

# Anchors, the most common words of the languages at hand.
ANCHORS = {
    "en": "the of and to in is that it for was on as with his be at by this had not are but from or have an they which one you were all her she there would their we him been has when who will no more if out so said what up its about into than them can only other".split(),
    "fr": "le la les de des du un une et est en que qui dans pour par sur pas ne se ce il elle au aux avec son sa ses ou mais plus".split(),
    "de": "der die das und ist ein eine zu den von mit im nicht sich auf dem des als auch es an er sie aus bei nach wie".split(),
    "es": "el los las del una por con su para al lo como o este".split(),
}
CHAIN = 2
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def anchors() -> list[str]:
    return sorted({w for ws in ANCHORS.values() for w in ws})


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), SEPARATORS), "")


def _marked(text: Column) -> Column:
    """Words joined by spaces, each content word after a mark."""
    return F.array_join(F.transform(words_of(text), lambda w: F.when(w.isin(anchors()), w).otherwise(F.concat(F.lit("\x01"), w))), " ")


def with_signatures(rows: DataFrame, text: str, to: str) -> DataFrame:
    """``rows`` with the array ``to``: the distinct signatures of column ``text``, each its words joined by spaces."""
    # a piece is one content word and the anchors up to the next one
    cut = rows.withColumn("_pieces", F.split(_marked(F.col(text)), "\x01"))
    heads = cut.withColumn("_heads", F.transform("_pieces", lambda p: F.substring_index(p, " ", 1)))
    n = F.size("_pieces")

    def of_piece(p: Column, i: Column) -> Column:
        after = F.filter(F.slice(F.split(p, " "), F.when(i == 0, 1).otherwise(2), F.length(p) + 1), lambda a: a != "")
        return F.when(i < n - CHAIN, F.transform(after, lambda a: F.concat_ws(" ", a, F.get("_heads", i + 1), F.get("_heads", i + 2)))).otherwise(F.array().cast("array<string>"))

    spots = heads.withColumn("_spots", F.flatten(F.transform("_pieces", of_piece)))
    words = words_of(F.col(text))
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
    backup = F.when(F.size(words) > 1, F.array_compact(pairs)).when(F.size(words) == 1, words).otherwise(F.array(F.sha2(F.col(text), 256)))
    found = F.when(F.size("_spots") > 0, F.col("_spots")).otherwise(backup)
    return spots.withColumn(to, F.array_distinct(found)).drop("_pieces", "_heads", "_spots")


def fingerprint(signatures: Column) -> Column:
    """A digest of the sorted set of signatures."""
    return F.sha2(F.array_join(F.array_sort(signatures), "\n"), 256)


def hashes(signatures: Column) -> Column:
    return F.transform(signatures, lambda s: F.xxhash64(s))


def length_partition(signatures: Column) -> Column:
    """Partition of a set by its length: the powers of two up to it."""
    return F.length(F.bin(F.size(signatures))) - 1


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard of two sets of signatures (or of their hashes); 0 where their partitions or lengths alone keep it below ``least``."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    exact = both / (F.size(a) + F.size(b) - both)
    if least <= 0:
        return exact
    apart = F.abs(length_partition(a) - length_partition(b)) > math.ceil(math.log2(1 / least))
    bound = F.least(F.size(a), F.size(b)) / F.greatest(F.size(a), F.size(b))
    return F.when(apart | (bound < least), F.lit(0.0)).otherwise(exact)


#: Buckets for each split of the input, and ids that are sampled for each bucket's bounds.
BUCKETS, SAMPLED = 8, 20
_AT = "struct<known: boolean, id: bigint, row: bigint>"


def bucket_of(at: Column, bounds: list[tuple[bool, int, int]]) -> Column:
    """How many of the sorted ``bounds`` are not over ``at``, looked for among groups of them and then in one."""
    width = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    told = lambda b: {"known": b[0], "id": b[1], "row": b[2]}
    heads = F.from_json(F.lit(json.dumps([told(g[0]) for g in groups])), f"array<{_AT}>")
    whole = F.from_json(F.lit(json.dumps([[told(b) for b in g] for g in groups])), f"array<array<{_AT}>>")
    group = F.size(F.filter(heads, lambda b: b <= at))
    return F.when(group == 0, F.lit(0)).otherwise((group - 1) * width + F.size(F.filter(F.get(whole, group - 1), lambda b: b <= at)))


def _bounds(ids: DataFrame, most: int) -> list[tuple[bool, int, int]]:
    """At most ``most`` bounds that cut ``ids`` (``at``) into parts of similar size, from a sample of a bounded number of them."""
    share = min(1.0, SAMPLED * most / max(ids.count(), 1))
    sample = sorted((r["at"]["known"], r["at"]["id"], r["at"]["row"]) for r in ids.sample(share, seed=7).collect())
    step = max(1, len(sample) // most)
    return sample[step::step]


def beside_next(docs: DataFrame) -> DataFrame:
    """``bucket, ghost, at, text, copies``: the distinct documents by buckets of consecutive ones; a ghost is the next bucket's first (the very first, after the last)."""
    text = text_of(docs)
    doc_id = docs["doc_id"].cast("long")
    rows = docs.select(F.struct(doc_id.isNotNull().alias("known"), F.coalesce(doc_id, F.lit(0)).alias("id"), F.xxhash64(text).alias("row")).alias("at"), text.alias("text"))
    ids = checkpointed(rows.select("at").distinct())
    cut = _bounds(ids, BUCKETS * max(1, rows.rdd.getNumPartitions()))
    firsts = sorted((r["bucket"], r["first"]) for r in ids.groupBy(bucket_of(F.col("at"), cut).alias("bucket")).agg(F.min("at").alias("first")).collect())
    ghosts = [(first, firsts[n - 1][0]) for n, (_, first) in enumerate(firsts)]
    sent_to = docs.sparkSession.createDataFrame(ghosts, f"first {_AT}, before int")
    dealt = rows.withColumn("bucket", bucket_of(F.col("at"), cut)).join(F.broadcast(sent_to), F.col("at") == F.col("first"), "left")
    own = F.struct(F.col("bucket"), F.lit(False).alias("ghost"))
    to = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("before").alias("bucket"), F.lit(True).alias("ghost"))))
    sent = dealt.select(F.explode(to).alias("to"), "at", "text").select("to.bucket", "to.ghost", "at.known", "at.id", "at.row", "text").repartition("bucket")
    return sent.groupBy("bucket", "ghost", "known", "id", "row").agg(F.first("text").alias("text"), F.count("*").alias("copies"))


def compare_with_next(docs: DataFrame, share: int = 4) -> DataFrame:
    """Every document beside its next one: text, edited text, the fingerprints of both, and the signatures' hashes of these and of the next one.

    The text with its last ``1/share`` replaced by as much of the next
    document's beginning is the edited text.
    """
    signed = with_signatures(beside_next(docs), "text", "signatures").select("bucket", "ghost", "known", "id", "row", "copies", "text", fingerprint(F.col("signatures")).alias("fingerprint"), hashes(F.col("signatures")).alias("hashes"))
    along = Window.partitionBy("bucket").orderBy("ghost", "known", "id", "row")
    led = signed.withColumn("next_text", F.lead("text").over(along)).withColumn("next_hashes", F.lead("hashes").over(along)).filter("not ghost")
    keep = F.expr(f"cast(length(text) div {share} as int)")
    edited = led.withColumn("edited", F.concat(F.expr(f"left(text, length(text) - cast(length(text) div {share} as int))"), F.left("next_text", keep))).drop("next_text")
    both = with_signatures(edited, "edited", "edited_signatures")
    out = both.select(
        "copies", F.when(F.col("known"), F.col("id")).alias("doc_id"), F.length("text").cast("long").alias("n_chars"), "text", "edited", "fingerprint", "hashes", "next_hashes",
        fingerprint(F.col("edited_signatures")).alias("edited_fingerprint"), hashes(F.col("edited_signatures")).alias("edited_hashes"),
    )
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copy", "copies")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = compare_with_next(table(spark, sf_dir, "documents"))
    own = F.col("hashes")
    return c.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", likeness(own, F.col("edited_hashes")).alias("near_edited"), likeness(own, F.col("next_hashes")).alias("near_next"),
        F.size(own).cast("long").alias("n_signatures"), length_partition(own).cast("long").alias("length_partition"),
    )


_ANCHORS = ", ".join(f"'{a}'" for a in anchors())
OP5_SQL = f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
n as (select *, coalesce(lead(text) over (order by doc_id), first_value(text) over (order by doc_id)) as after from d),
e as (select *, left(text, length(text) - length(text) // 4) || left(after, length(text) // 4) as edited from n),
t as (select doc_id, 0 as kind, text from e union all select doc_id, 1, edited from e),
w as (select doc_id, kind, text, list_filter(string_split_regex(lower(text), '{SEPARATORS}'), lambda x: x <> '') as ws from t),
p as (select doc_id, kind, unnest(ws) as word, generate_subscripts(ws, 1) as pos from w),
c as (select *, word in ({_ANCHORS}) as anchor, sum((word not in ({_ANCHORS}))::int) over (partition by doc_id, kind order by pos) as rank from p),
spots as (
  select a.doc_id, a.kind, a.word || ' ' || x.word || ' ' || y.word as s from c a
  join c x on x.doc_id = a.doc_id and x.kind = a.kind and x.rank = a.rank + 1 and not x.anchor
  join c y on y.doc_id = a.doc_id and y.kind = a.kind and y.rank = a.rank + 2 and not y.anchor where a.anchor),
chains as (select doc_id, kind, list(distinct s) as s from spots group by all),
sets as (
  select w.doc_id, w.kind, list_sort(list_distinct(coalesce(chains.s, case when len(ws) > 1 then list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) when len(ws) = 1 then ws else [sha256(text)] end))) as s
  from w left join chains on chains.doc_id = w.doc_id and chains.kind = w.kind),
own as (select e.doc_id, text, edited, s.s as s, coalesce(lead(s.s) over (order by e.doc_id), first_value(s.s) over (order by e.doc_id)) as s_after, x.s as s_edited
  from e join sets s on s.doc_id = e.doc_id and s.kind = 0 join sets x on x.doc_id = e.doc_id and x.kind = 1)
select doc_id, cast(length(text) as bigint) as n_chars, sha256(edited) as edited_sha256, sha256(array_to_string(s, chr(10))) as fingerprint, sha256(array_to_string(s_edited, chr(10))) as edited_fingerprint,
  len(list_intersect(s, s_edited)) / cast(len(list_distinct(list_concat(s, s_edited))) as double) as near_edited,
  len(list_intersect(s, s_after)) / cast(len(list_distinct(list_concat(s, s_after))) as double) as near_next,
  cast(len(s) as bigint) as n_signatures, cast(length(bin(len(s))) - 1 as bigint) as length_partition
from own
"""
