"""N-gram Jaccard self-join of documents by chosen paths.

A text is the set of its five-word shingles (hashed); two texts are linked if
the Jaccard similarity of their sets is at least ``THRESHOLD``.

Chosen paths: a set x follows a token j if a random hash of j is below
``1 / (THRESHOLD * |x|)``, so it takes 1.25 paths on average, and two similar
sets share one with a fixed chance.  Runs with fresh hashes are repeated until
the chance that no path is shared, or that the sketches below rule the pair
out, is below ``1 - RECALL``; a path that several runs choose is walked once.
All sets of a path are a bucket, and all pairs of a bucket of up to ``BRUTE``
sets are compared.

A larger bucket, as of a passage that many texts share, is split: its sets go
down paths of up to ``DEPTH`` tokens, each drawn from the whole set by a hash
that depends on the path so far, until a bucket is small.  Similar sets stay
together through all levels with a chance that falls with the depth, so the
runs are as many more as the target recall asks for.  Buckets whose sets are
alike for the most part (by the sketches of some of them), which no token can
tell apart, and those that are large even after ``DEPTH`` tokens, are compared
block by block: blocks are of one class of sizes, and only blocks of the same or
of neighbouring classes meet, as no other sizes can be as similar as the
threshold.  So no pair that shares a path goes uncompared; the work in such a
bucket grows with the square of its sets of similar size.

A pair is looked at in one bucket only, that of the least path it shares.  A
sketch of 64 coordinates sorts out pairs that are far off; all others are
verified there on the whole sets.  Pairs are not written: a block gives each
set's number of links, and as many links as hold its sets together.

Equal sets are one node, so copies, however many, cost one row each.

Result: one row per document with its class (the smallest id of its connected
component), the number of verified links of its text to other texts, and the
number of documents with an equal set.

Defined cases: a text of one to four words is one shingle of all its words;
null, empty and wordless texts have no shingles and are each a class of their
own; rows of the same id and text are one document and get equal rows; a null
id never names a class that has another id.
"""

from __future__ import annotations

import math
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, emit, pieces, stored, table, texts, thrown_away
from .words import WORD_BATCH, Words

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.999
#: Sets of a bucket that are compared at once; sets of a block, and tokens of a bucket or block that are held at once.
BRUTE, BLOCK, TOKENS = 512, 1024, 1 << 22
#: Minhash coordinates of a sketch, one byte each, and how many must agree for a pair to be verified.
COORDS, AGREE = 64, 38
#: Tokens of a path at most; share of coordinates in which the sets of a bucket that is not split any more agree on average, and how many of them are looked at for that.
DEPTH, ALIKE, LOOKED_AT = 5, 0.5, 32

_NODES = pa.schema([("doc_id", pa.int64()), ("row_hash", pa.int64()), ("node", pa.binary()), ("size", pa.int32()), ("sketch", pa.binary()), ("paths", pa.list_(pa.int64()))])
#: A set's number of links in a block (``b`` is null), or a link.
_LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("n", pa.int64())])
_LINKS_DDL = "a binary, b binary, n long"


def sketch_miss(threshold: float = THRESHOLD) -> float:
    """The chance that the sketches of two sets at the threshold agree in fewer than ``AGREE`` coordinates."""
    return sum(math.comb(COORDS, k) * threshold**k * (1 - threshold) ** (COORDS - k) for k in range(AGREE))


def survival(depth: int) -> float:
    """The chance that two sets at the threshold share a path of ``depth`` tokens in one run, at worst.

    At worst one set holds the other, and one token is expected to be shared at
    the end of each shared path.
    """
    s = 1.0
    for _ in range(depth):
        s = 1 - math.exp(-s)
    return s


def runs_for(recall: float = RECALL, threshold: float = THRESHOLD, depth: int = 1) -> int:
    """Runs after which two sets at the threshold share no path of ``depth`` tokens with a chance of at most half of what ``1 - recall`` and the sketches leave.

    The other half is for the other of the two steps, single tokens and deeper paths.
    """
    left = 1 - recall - sketch_miss(threshold)
    if left <= 0:
        raise ValueError(f"sketches of {COORDS} coordinates allow no recall of {recall} at {threshold}")
    return math.ceil(math.log(left / 2) / math.log(1 - survival(depth)))


def _constants(seed: int, n: int):
    import numpy as np

    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, dtype=np.uint64)


def shingle_hashes(hashes):
    """Hash of every ``SHINGLE`` words in a row; fewer words make one."""
    import numpy as np

    width = min(SHINGLE, len(hashes))
    if not width:
        return hashes
    s = np.full(len(hashes) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        s = (s ^ hashes[k : len(hashes) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        s ^= s >> np.uint64(32)
    return s


def shingle_sets(words: Words, part: pa.RecordBatch):
    """The sorted distinct shingle hashes of each text of a batch."""
    import numpy as np

    hashes, offsets = words.of(part["text"])
    for i in range(part.num_rows):
        yield np.unique(shingle_hashes(hashes[offsets[i] : offsets[i + 1]]))


def digest(tokens) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(tokens.tobytes())


def sketch_of(tokens, odd, low) -> bytes:
    """One byte of the minhash of every coordinate."""
    import numpy as np

    least = np.full(len(odd), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(tokens), 4096):
        least = np.minimum(least, ((tokens[i : i + 4096, None] ^ low) * odd).min(axis=0))
    return ((least * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(56)).astype(np.uint8).tobytes()


def nodes_of(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``doc_id, row_hash, node, size, sketch, paths``; ``node`` is a 128-bit digest of the shingle set."""
    runs = runs_for(recall, threshold)

    def run(batches):
        import numpy as np

        words, (odd, low), (run_odd, run_low) = Words(), _constants(11, COORDS), _constants(13, runs)

        def rows():
            for batch in batches:
                for part in pieces(batch, most=WORD_BATCH):
                    for doc_id, row_hash, tokens in zip(part["doc_id"].to_pylist(), part["row_hash"].to_pylist(), shingle_sets(words, part), strict=True):
                        if not len(tokens):
                            yield doc_id, row_hash, None, 0, None, None
                            continue
                        below = np.uint64(min(2**64 - 1, int(2**64 / (threshold * len(tokens)))))
                        mixed = tokens ^ (tokens >> np.uint64(31))
                        chosen = np.zeros(len(tokens), dtype=bool)
                        for o, b in zip(run_odd, run_low, strict=True):
                            chosen |= (mixed ^ b) * o < below
                        yield doc_id, row_hash, digest(tokens), len(tokens), sketch_of(tokens, odd, low), tokens[chosen].view(np.int64).tolist()

        yield from emit(_NODES, rows(), lambda r: 200)

    return texts(docs).withColumn("row_hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, row_hash long, node binary, size int, sketch binary, paths array<long>")


def _near(sizes, sketches, other_sizes, other_sketches, threshold):
    """Agreeing coordinates of all pairs, 0 where the sizes alone keep a pair below the threshold."""
    import numpy as np

    agree = (sketches[:, None, :] == other_sketches[None, :, :]).sum(axis=2)
    low, high = np.minimum(sizes[:, None], other_sizes[None, :]), np.maximum(sizes[:, None], other_sizes[None, :])
    return np.where(low >= threshold * high, agree, 0)


def _matrix(values: list[bytes]):
    import numpy as np

    return np.frombuffer(b"".join(values), dtype=np.uint8).reshape(len(values), COORDS)


_MEMBER = pa.schema([("path", pa.int64()), ("task", pa.string()), ("side", pa.int32()), ("node", pa.binary()), ("size", pa.int32()), ("sketch", pa.binary()), ("paths", pa.list_(pa.int64()))])
_MEMBER_DDL = "path long, task string, side int, node binary, size int, sketch binary, paths array<long>"
_WHOLE = 2


_TREE = pa.schema([("node", pa.binary()), ("size", pa.int32()), ("level", pa.int32()), ("parent", pa.list_(pa.int64())), ("path", pa.list_(pa.int64()))])


def chosen_paths(tokens, roots, threshold: float, depth: int = DEPTH):
    """``parents, paths`` of each level: the paths that a set takes from the ``roots``, one for each run; every step is drawn from all its tokens."""
    import numpy as np

    below = np.uint64(min(2**64 - 1, int(2**64 / (threshold * len(tokens)))))
    mixed, at = tokens ^ (tokens >> np.uint64(31)), roots
    width = max(1, (1 << 20) // len(tokens))
    for _ in range(depth):
        parents, found = [at[:0]], [at[:0]]
        for start in range(0, len(at), width):
            some = at[start : start + width]
            odd, low = some * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1), some * np.uint64(0xC2B2AE3D27D4EB4F)
            i, t = np.nonzero((mixed ^ low[:, None]) * odd[:, None] < below)
            step = (some[i] ^ (mixed[t] * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xA0761D6478BD642F)
            parents.append(some[i])
            found.append(step ^ (step >> np.uint64(29)))
        at = np.concatenate(found)
        yield np.concatenate(parents), at


def trees_of(docs: DataFrame, reps: DataFrame, nodes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """Rows of ``_TREE``: for each of ``nodes`` and each level, its paths and the paths that they go on from."""
    runs = runs_for(recall, threshold, DEPTH)

    def run(batches):
        words, roots = Words(), _constants(17, runs)[0]

        def rows():
            for node, tokens in _sets_of(batches, words):
                for level, (parents, paths) in enumerate(chosen_paths(tokens, roots, threshold), 1):
                    yield node, len(tokens), level, parents.view("i8").tolist(), paths.view("i8").tolist()

        yield from emit(_TREE, rows(), lambda r: 16 * len(r[3]))

    return _texts_of(docs, reps, nodes).mapInArrow(run, "node binary, size int, level int, parent array<long>, path array<long>")


def _few(n: str = "n", tokens: str = "tokens"):
    return (F.col(n) <= BRUTE) & (F.col(tokens) <= TOKENS)


def _counted(rows: DataFrame) -> DataFrame:
    """``path, n, tokens`` of the paths that several sets take."""
    return rows.groupBy("path").agg(F.count("*").alias("n"), F.sum("size").alias("tokens")).filter("n > 1")


def alike(large: DataFrame, sketches: DataFrame) -> DataFrame:
    """``path, stays`` of the buckets ``large`` (``path, n, node``): whether their sets are alike for the most part, by the sketches of about ``LOOKED_AT`` of each."""

    def run(batches):
        import numpy as np

        for batch in batches:
            found = []
            for some in batch["some"].to_pylist():
                m = _matrix(some)
                agree = (m[:, None, :] == m[None, :, :]).mean(axis=2)
                found.append(len(m) < 2 or bool((agree.sum() - len(m)) / (len(m) * (len(m) - 1)) >= ALIKE))
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array(found, type=pa.bool_())], names=["path", "stays"])

    looked = large.filter(F.pmod(F.xxhash64("node", "path"), F.greatest(F.floor(F.col("n") / LOOKED_AT), F.lit(1))) == 0)
    return looked.select("path", "node").join(sketches, "node").groupBy("path").agg(F.collect_list("sketch").alias("some")).mapInArrow(run, "path long, stays boolean")


def told_apart(members: DataFrame, sketches: DataFrame, last: bool) -> tuple[DataFrame, DataFrame]:
    """Of large buckets' ``members``, those of buckets that stay as they are and those of buckets that are split; of the ``last`` level all stay."""
    if last:
        return members, members.limit(0)
    told = checkpointed(members.join(alike(members, sketches), "path", "left").withColumn("stays", F.coalesce("stays", F.lit(False))))
    return told.filter("stays").drop("stays"), told.filter("not stays").drop("stays")


def split_buckets(docs: DataFrame, reps: DataFrame, nodes: DataFrame, threshold: float, recall: float) -> DataFrame:
    """``node, path, size, n, tokens``: the buckets that ``nodes`` end in, each small, of sets that are alike, or of ``DEPTH`` tokens."""
    trees, kept = stored(trees_of(docs, reps, nodes, threshold, recall), "trees")
    sketches = reps.select("node", "sketch")
    step = F.arrays_zip("parent", "path")
    ends, going = [], None
    for level in range(1, DEPTH + 1):
        here = trees.filter(F.col("level") == level)
        # of the steps of this level only those that go on from a bucket that is split
        steps = here.withColumn("step", F.explode(step)) if going is None else here.join(going, "node").withColumn("step", F.explode(F.filter(step, lambda s: F.array_contains("from", s["parent"]))))
        rows = checkpointed(steps.select("node", "size", "step.path"))
        members = checkpointed(rows.join(_counted(rows), "path"))
        ends.append(members.filter(_few()))
        large = members.filter(~_few())
        if large.isEmpty():
            break
        stay, split = told_apart(large, sketches, level == DEPTH)
        ends.append(stay)
        going = split.groupBy("node").agg(F.collect_set("path").alias("from"))
    found = checkpointed(reduce(DataFrame.unionByName, (e.select("node", "path", "size", "n", "tokens") for e in ends)).dropDuplicates(["node", "path"]))
    thrown_away(docs.sparkSession, kept)
    return found


def tasks_of(docs: DataFrame, reps: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Rows of ``_MEMBER``: which sets are compared with which.

    Sets of the same ``path`` and ``task`` are: all with all where ``side`` is
    ``_WHOLE``, those of side 0 with those of side 1 elsewhere.
    """
    rows = reps.select(F.explode("paths").alias("path"), "node", "size")
    known = checkpointed(rows.join(_counted(rows), "path"))
    members, info = known, reps.select("node", "sketch", "paths")
    large = known.filter(~_few())
    if not large.isEmpty():
        stay, split = told_apart(large, info.select("node", "sketch"), False)
        deep = split.select("node").distinct()
        ends = split_buckets(docs, reps, deep, threshold, recall)
        # the buckets that a split set is in are those that it ends in, and those of single tokens that are not split
        whole = known.filter(_few()).unionByName(stay)
        lists = ends.select("node", "path").unionByName(whole.join(deep, "node", "left_semi").select("node", "path")).groupBy("node").agg(F.collect_list("path").alias("own"))
        info = info.join(lists, "node", "left").select("node", "sketch", F.coalesce("own", "paths").alias("paths"))
        members = whole.unionByName(ends.select(whole.columns))
        large = members.filter(~_few())
    small = members.filter(_few()).select("path", F.lit("").alias("task"), F.lit(_WHOLE).alias("side"), "node", "size")
    # A little wider than the threshold, so that rounding puts no pair two classes apart.
    kind = F.floor(F.log("size") / (1.0001 * math.log(1 / threshold))).cast("int")
    large = large.select("path", "node", "size", kind.alias("kind"))
    blocks = F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("size") / F.lit(TOKENS))).cast("int")
    per_kind = large.groupBy("path", "kind").agg(blocks.alias("blocks"))
    per_path = per_kind.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("kind", "blocks"))).alias("blocks"))
    placed = large.join(per_path, "path").withColumn("mine", F.struct("kind", F.pmod(F.xxhash64("node"), F.col("blocks")[F.col("kind")]).cast("int").alias("block")))
    met = F.expr("""flatten(transform(array(kind - 1, kind, kind + 1), k -> if(map_contains_key(blocks, k),
        transform(sequence(0, blocks[k] - 1), i -> named_struct('kind', k, 'block', i)), array())))""")
    met = placed.withColumn("other", F.explode(met)).withColumn("low", F.least("mine", "other")).withColumn("high", F.greatest("mine", "other"))
    side = F.when(F.col("low") == F.col("high"), _WHOLE).when(F.col("mine") == F.col("low"), 0).otherwise(1)
    task = F.concat_ws("/", "low.kind", "low.block", "high.kind", "high.block")
    tasks = small.unionByName(met.withColumn("side", side).withColumn("task", task).select(small.columns))
    return tasks.join(info, "node").select([f.name for f in _MEMBER])


def _candidates(path: int, members: list[dict], threshold: float):
    """``i, others``: the pairs of ``members`` whose least shared path is ``path`` and that their sizes and sketches do not rule out."""
    import numpy as np

    sides = np.array([m["side"] for m in members])
    whole = sides[0] == _WHOLE
    left, right = (np.arange(len(members)),) * 2 if whole else (np.flatnonzero(sides == 0), np.flatnonzero(sides == 1))
    if not len(left) or not len(right):
        return
    sizes, sketches = np.array([m["size"] for m in members]), _matrix([m["sketch"] for m in members])
    before = [frozenset(p for p in m["paths"] if p < path) for m in members]
    for start in range(0, len(left), 64):
        some = left[start : start + 64]
        for i, agree in zip(some, _near(sizes[some], sketches[some], sizes[right], sketches[right], threshold), strict=True):
            others = [k for k in right[agree >= AGREE] if (k > i or not whole) and before[i].isdisjoint(before[k])]
            if others:
                yield i, others


def _buckets(rows: DataFrame, *more: str) -> DataFrame:
    return rows.groupBy("path", "task").agg(F.collect_list(F.struct("side", "node", "size", "sketch", "paths", *more)).alias("members"))


def with_candidates(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``tasks_of`` that have a set to be verified against."""

    def run(batches):
        def rows():
            for batch in batches:
                for path, task, members in zip(*(batch[n].to_pylist() for n in ("path", "task", "members")), strict=True):
                    kept = set()
                    for i, others in _candidates(path, members, threshold):
                        kept.update((i, *others))
                    for m in (members[i] for i in sorted(kept)):
                        yield path, task, m["side"], m["node"], m["size"], m["sketch"], m["paths"]

        yield from emit(_MEMBER, rows(), lambda r: 200)

    return _buckets(rows).mapInArrow(run, _MEMBER_DDL)


def _texts_of(docs: DataFrame, reps: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, text``: for each of ``nodes`` texts of its smallest id, among them one of its set."""
    named = reps.select("node", F.col("doc_id").alias("rep_id")).join(nodes, "node", "left_semi")
    return texts(docs).join(named, F.col("doc_id").eqNullSafe(F.col("rep_id"))).select("node", "text")


def _sets_of(batches, words: Words):
    """``node, tokens`` of the rows of ``_texts_of`` whose text has the node's set."""
    for batch in batches:
        for part in pieces(batch, most=WORD_BATCH):
            for node, tokens in zip(part["node"].to_pylist(), shingle_sets(words, part), strict=True):
                if digest(tokens) == node:
                    yield node, tokens


def shared_tokens(tokens, others: list):
    """How many of the sorted ``tokens`` each of the other sets holds."""
    import numpy as np

    all_others = np.concatenate(others)
    at = np.searchsorted(tokens, all_others)
    at[at == len(tokens)] = 0
    return np.add.reduceat((tokens[at] == all_others).astype(np.int64), np.cumsum([0, *map(len, others[:-1])]))


def verified_links(docs: DataFrame, reps: DataFrame, wanted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``_LINKS``: how many pairs of each set are as similar as ``threshold`` on the whole sets, and links enough to join all that are linked."""
    schema = pa.schema([("node", pa.binary()), ("tokens", pa.binary())])

    def load(batches):
        yield from emit(schema, ((node, tokens.tobytes()) for node, tokens in _sets_of(batches, Words())), lambda r: len(r[1]))

    def verify(batches):
        import numpy as np

        def rows():
            for batch in batches:
                for path, members in zip(batch["path"].to_pylist(), batch["members"].to_pylist(), strict=True):
                    yield from bucket(path, members)

        def bucket(path, members):
            sets = [np.frombuffer(m["tokens"], dtype=np.uint64) for m in members]
            lengths = np.array([len(s) for s in sets])
            links, parent = np.zeros(len(members), dtype=np.int64), list(range(len(members)))

            def root(i):
                while parent[i] != i:
                    parent[i] = i = parent[parent[i]]
                return i

            for i, others in _candidates(path, members, threshold):
                others = np.array(others)
                both = shared_tokens(sets[i], [sets[k] for k in others])
                linked = others[both >= threshold * (lengths[i] + lengths[others] - both)]
                links[i] += len(linked)
                links[linked] += 1
                for k in linked:
                    x, y = root(int(i)), root(int(k))
                    if x != y:
                        parent[y] = x
                        yield members[i]["node"], members[k]["node"], 0
            for i in np.flatnonzero(links):
                yield members[i]["node"], None, int(links[i])

        yield from emit(_LINKS, rows(), lambda r: 64)

    sets = _texts_of(docs, reps, wanted.select("node").distinct()).mapInArrow(load, "node binary, tokens binary").dropDuplicates(["node"])
    return _buckets(wanted.join(sets, "node"), "tokens").mapInArrow(verify, _LINKS_DDL)


def components(links: DataFrame) -> DataFrame:
    """``name, label``: the smallest name of each linked name's component.

    Every name takes the least label among its neighbours, then its label's own
    label, until nothing changes; only labels and links move.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = checkpointed(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("name"), F.least("a", "b").alias("label")))
    while True:
        heard = both.join(labels, both["b"] == labels["name"]).groupBy("a").agg(F.min("label").alias("heard"))
        nearer = labels.join(heard, labels["name"] == heard["a"]).select("name", F.col("label").alias("was"), F.least("label", "heard").alias("label"))
        parents = nearer.select(F.col("name").alias("parent"), F.col("label").alias("root"))
        now = checkpointed(nearer.join(parents, nearer["label"] == parents["parent"]).select("name", "was", F.least("label", "root").alias("label")))
        labels = now.select("name", "label")
        if now.filter("was <> label").isEmpty():
            return labels


def class_of_nodes(links: DataFrame, reps: DataFrame) -> DataFrame:
    """``node, class_id`` of the linked nodes.

    Nodes go by names that begin with their smallest document, so that a
    component's smallest name holds its class, and no node needs to ask for it.
    """
    named = reps.select(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "node").alias("name"))
    of = lambda end: named.select(F.col("name").alias(end), F.col("name.node").alias(f"{end}_node"))
    pairs = links.select(F.col("a").alias("a_node"), F.col("b").alias("b_node")).join(of("a"), "a_node").join(of("b"), "b_node").select("a", "b")
    return components(checkpointed(pairs)).select(F.col("name.node").alias("node"), F.col("label.doc_id").alias("class_id"))


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``doc_id, row_hash, class_id, n_links, n_copies`` for every row of ``docs``; ``row_hash`` is xxhash64 of the text."""
    nodes = checkpointed(nodes_of(docs, threshold, recall))
    reps = checkpointed(nodes.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("paths").alias("paths")))
    wanted = checkpointed(with_candidates(tasks_of(docs, reps, threshold, recall), threshold))
    links = checkpointed(verified_links(docs, reps, wanted, threshold))
    found = class_of_nodes(links.filter("b is not null"), reps)
    degree = links.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    classes = reps.select("node", "doc_id", "n_copies").join(found, "node", "left").join(degree, "node", "left").select("node", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    return nodes.select("doc_id", "row_hash", "node").join(classes, "node", "left").select("doc_id", "row_hash", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).drop("row_hash")


OP4_SQL = f"""
with recursive w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') as ws from documents),
s as (select doc_id, case when len(ws) < {SHINGLE} then [array_to_string(ws, ' ')] else list_sort(list_distinct(list_transform(range(1, len(ws) - {SHINGLE - 2}), lambda i: array_to_string(ws[i : i + {SHINGLE - 1}], ' ')))) end as s from w where len(ws) > 0),
k as (select doc_id, s, sha256(array_to_string(s, chr(10))) as node from s),
nodes as (select node, min(doc_id) as least, count(*) as n_copies, any_value(s) as s from k group by node),
tokens as (select node, len(s) as n, unnest(s) as token from nodes),
links as (select a.node as a, b.node as b from tokens a join tokens b on a.token = b.token and a.node <> b.node
  group by a.node, b.node, a.n, b.n having count(*) >= {THRESHOLD} * (a.n + b.n - count(*))),
reached(a, b) as (select node, node from nodes union select reached.a, links.b from reached join links on links.a = reached.b),
classes as (select reached.a as node, min(nodes.least) as class_id from reached join nodes on nodes.node = reached.b group by reached.a),
degrees as (select a as node, count(*) as n_links from links group by a)
select d.doc_id, coalesce(c.class_id, d.doc_id) as class_id, cast(coalesce(g.n_links, 0) as bigint) as n_links, cast(coalesce(n.n_copies, 1) as bigint) as n_copies
from documents d left join k on k.doc_id = d.doc_id left join nodes n on n.node = k.node left join classes c on c.node = k.node left join degrees g on g.node = k.node
"""
