"""Toxicity by class-conditional Kneser-Ney models.

Two models of order two, of toxic and of ordinary documents, share their lowest
order.  For class c, word w after h:

    P_c(w|h) = (n_c(hw) - d) / n_c(h) + back_c(h) * P_c(w)
    P_c(w)   = (k_c(w) - d) / K_c + back_c * P(w)

``n_c`` counts documents of the class, ``k_c(w)`` the distinct words that w
follows in the class, and ``P(w)`` is the share of w in the distinct pairs of
the whole corpus, labelled or not: the backoff that both classes share.  The
discount d of a count is what the other class lets expect of it, ``1 + RHO``
times over, and ``Z`` standard deviations more, at most the count itself; back
is the mass that the discounts set free, so every P sums to 1.  An expression
that a class does not clearly prefer, as every rare one, is thus left to the
shared counts and weighs the same in both models.

A text is compared by the difference of its two log-likelihoods over its number
of words, under the models and under their lower order; a logistic curve, fitted
on labelled documents that the models have not seen, makes a score of the two.

What is gathered: the pair counts of the labelled sample (at most
``MAX_LABELLED`` rows, those of the smallest hashes of their ids), and over all
documents the distinct pairs of words.  Only words that a class has in more
than ``Z * sqrt(LEAST)`` pairs or documents can have a surplus in it; these are
the vocabulary, so its tables, which are broadcast, are bounded by the sample.
All other words are one.  A word's predecessors are told apart by 40 bits.

Defined cases: a null or empty text has no words and gets the score of equal
likelihoods; without labels of both classes every score is the share of toxic
labels; a document labelled twice counts as toxic if one label says so; a null
id is treated as the empty text's checksum, and never as labelled; repeated rows
get the same score, and count as often as they stand there.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import emit, pieces, stored, table, texts, thrown_away
from .words import WORD_BATCH, Words

#: Labelled rows that the models and the curve are fitted on, at most; one of FOLDS parts of them is for the curve.
MAX_LABELLED, FOLDS = 32768, 5
THRESHOLD = 0.3
#: A count is discounted by (1 + RHO) times what is expected, and by Z deviations of an expectation of LEAST at least.
RHO, Z, LEAST = 1.0, 3.0, 1.0
#: Counts that the lower order stands for where the other class's share of a pair is estimated.
PRIOR = 10.0
#: Discounts of counts of 1, of 2, and of more, where a class is what the other is held against.
D = (0.75, 1.1, 1.4)
_BEGIN = 0x9E3779B97F4A7C15

_PAIRS = pa.schema([("before", pa.int64()), ("word", pa.int64()), ("n0", pa.int64()), ("n1", pa.int64())])
#: Distinct pairs of some texts whose words are of one part: the words, how many pairs each has, and 40 bits of each pair.
_SEEN = pa.schema([("part", pa.int32()), ("words", pa.binary()), ("counts", pa.binary()), ("high", pa.binary()), ("low", pa.binary())])
_FOLLOWED = pa.schema([("word", pa.int32()), ("n", pa.int64())])
HELD_WORDS, HOT, SPLIT_BITS = 1 << 20, 1000, 6


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def labelled_sample(labels: DataFrame, most: int = MAX_LABELLED) -> dict[int, int]:
    """``doc_id -> toxic`` of at most ``most`` labelled documents that are not held out."""
    rows = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).dropna()
    rows = rows.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return {r["doc_id"]: int(r["toxic"] > 0) for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()}


def of_sample(docs: DataFrame, sample: dict[int, int]) -> DataFrame:
    """``doc_id, text, toxic`` of the sampled documents."""
    chosen = docs.sparkSession.createDataFrame(sorted(sample.items()), "doc_id long, toxic int")
    return texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")


def pair_hash(before, hashes):
    import numpy as np

    mixed = (before ^ (before >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    pair = (mixed ^ hashes) * np.uint64(0x94D049BB133111EB)
    return pair ^ (pair >> np.uint64(31))


def _pairs_of(hashes, offsets):
    """Hash of each word's pair with the word before it (or the text's beginning), and of that word."""
    import numpy as np

    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[offsets[:-1][offsets[:-1] < offsets[1:]]] = np.uint64(_BEGIN)
    return pair_hash(before, hashes), before


def pair_counts(sampled: DataFrame) -> DataFrame:
    """``before, word, n0, n1``: in how many ordinary and toxic documents of the sample a pair stands, so one that repeats itself weighs as others do."""

    def run(batches):
        import numpy as np

        words = Words()
        for batch in batches:
            for part in pieces(batch, most=WORD_BATCH):
                hashes, offsets = words.of(part["text"])
                pair, before = _pairs_of(hashes, offsets)
                doc = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                once = np.unique(pair + doc.astype(np.uint64) * np.uint64(_BEGIN), return_index=True)[1]
                _, first, back = np.unique(pair[once], return_index=True, return_inverse=True)
                toxic = part["toxic"].to_numpy()[doc[once]] > 0
                n = [np.bincount(back, weights=w, minlength=len(first)).astype(np.int64) for w in (~toxic, toxic)]
                first = once[first]
                yield pa.RecordBatch.from_arrays([pa.array(before[first].view(np.int64)), pa.array(hashes[first].view(np.int64)), *map(pa.array, n)], schema=_PAIRS)

    counted = sampled.select("text", "toxic").mapInArrow(run, "before long, word long, n0 long, n1 long")
    return counted.groupBy("before", "word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def index_of(known, hashes):
    """Where each hash stands in the sorted ``known``; ``len(known)`` where it does not."""
    import numpy as np

    if not len(known):
        return np.zeros(len(hashes), dtype=np.int64)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at, len(known))


def followed(docs: DataFrame, known, hot):
    """Over all documents, how many distinct words (or beginnings) stand before each word of the sorted hashes ``known``, and at the end before any other word.

    Pairs go by their word to the parts that count them, those of the words
    marked in ``hot`` (one more than ``known``) by the pair, too.
    """
    import numpy as np

    given = docs.sparkSession.sparkContext.broadcast((known, hot))
    rows = texts(docs)
    parts = min(1 << 17, max(1 << 8, 1 << (4 * rows.rdd.getNumPartitions()).bit_length()))

    def run(batches):
        words, held, n = Words(), [], 0
        for batch in batches:
            for part in pieces(batch, most=WORD_BATCH):
                few, at, offsets = words.coded(part["text"])
                held.append((index_of(given.value[0], few).astype(np.uint32)[at], _pairs_of(few[at], offsets)[0]))
                n += len(at)
                if n >= HELD_WORDS:
                    yield from packed(held)
                    n = 0
        if n:
            yield from packed(held)

    def packed(held):
        word, pair = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.argsort(pair)
        pair = pair[order]
        new = np.append(True, pair[1:] != pair[:-1])
        word, pair = word[order[new]], pair[new]
        is_hot = given.value[1]
        split = np.where(is_hot[word], pair >> np.uint64(64 - SPLIT_BITS), np.uint64(0))
        mixed = (word.astype(np.uint64) << np.uint64(SPLIT_BITS) | split) * np.uint64(_BEGIN)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        part = (mixed >> np.uint64(32)) % np.uint64(parts)
        order = np.argsort(part << np.uint64(32) | word)
        part, word, low = part[order].astype(np.int32), word[order], pair[order] & np.uint64((1 << 40) - 1)
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        high, low = (low >> np.uint64(8)).astype(np.uint32), low.astype(np.uint8)

        def rows():
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                found, counts = np.unique(word[start:end], return_counts=True)
                yield int(part[start]), found.tobytes(), counts.astype(np.uint32).tobytes(), high[start:end].tobytes(), low[start:end].tobytes()

        yield from emit(_SEEN, rows(), lambda r: sum(map(len, r[1:])))
        pa.default_memory_pool().release_unused()

    def count(batches):
        part, held = None, []

        def counted():
            word = np.concatenate([w for w, _ in held])
            pair = np.concatenate([p for _, p in held])
            held.clear()
            order = np.lexsort((pair, word))
            word, pair = word[order], pair[order]
            new = np.ones(len(word), dtype=bool)
            new[1:] = (word[1:] != word[:-1]) | (pair[1:] != pair[:-1])
            found, n = np.unique(word[new], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(n.astype(np.int64))], schema=_FOLLOWED)

        for batch in batches:
            for now, words, counts, high, low in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and now != part:
                    yield counted()
                part = now
                pair = np.frombuffer(high, dtype=np.uint32).astype(np.uint64) << np.uint64(8) | np.frombuffer(low, dtype=np.uint8)
                held.append((np.repeat(np.frombuffer(words, dtype=np.uint32), np.frombuffer(counts, dtype=np.uint32)), pair))
        if held:
            yield counted()

    seen = rows.mapInArrow(run, "part int, words binary, counts binary, high binary, low binary")
    found = seen.repartition("part").sortWithinPartitions("part").mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(known) + 1)
    out[found["word"].to_numpy()] = found["n"].to_numpy()
    return out


def _discount(n):
    import numpy as np

    return np.where(n > 2, D[2], np.where(n > 1, D[1], np.where(n > 0, D[0], 0)))


def surplus(n, expected, ratio):
    """What is left of counts ``n`` after their discount; ``ratio`` is the class's size over the other's."""
    import numpy as np

    return np.maximum(n - (1 + RHO) * expected - Z * np.sqrt((expected + LEAST) * (1 + ratio)), 0)


def lower_order(k, totals, discounts, shared):
    """``P_c(w)`` of both classes for words of continuation counts ``k[c]``, ``back_c``, and what each class alone would let expect."""
    import numpy as np

    size = np.maximum(totals, 1)
    alone = [(k[c] - _discount(k[c])) / size[c] + (discounts[c] / size[c] if totals[c] else 1.0) * shared for c in (0, 1)]
    left = [surplus(k[c], size[c] * alone[1 - c], size[c] / size[1 - c]) for c in (0, 1)]
    back = [1 - left[c].sum() / size[c] for c in (0, 1)]
    return [left[c] / size[c] + back[c] * shared for c in (0, 1)], back, alone


def upper_order(n, of_before, word, lower):
    """The direct share of pairs in both classes; ``n[c]`` counts the pairs, ``of_before[c]`` those of their first word, ``word`` indexes ``lower``."""
    import numpy as np

    out = []
    for c in (0, 1):
        mine, other = np.maximum(of_before[c], 1), of_before[1 - c]
        share = (n[1 - c] + PRIOR * np.maximum(lower[0], lower[1])[word]) / (other + PRIOR)
        out.append(surplus(n[c], of_before[c] * share, of_before[c] / np.maximum(other, 1)) / mine)
    return out


def fit_models(docs: DataFrame, sample: dict[int, int]) -> dict:
    """The tables that a score needs, from the pairs of ``sample`` and the followed words of all ``docs``."""
    import numpy as np

    counts, kept = stored(pair_counts(of_sample(docs, sample)), "pairs")
    many = math.floor(Z * math.sqrt(LEAST)) + 1
    k = [F.sum((F.col(f"n{c}") > 0).cast("long")).alias(f"k{c}") for c in (0, 1)]
    by_word = counts.groupBy("word").agg(*k, F.max(F.greatest("n0", "n1")).alias("most"))
    cost = [F.sum(F.when(F.col(f"k{c}") > 2, D[2]).when(F.col(f"k{c}") > 1, D[1]).when(F.col(f"k{c}") > 0, D[0]).otherwise(0.0)).alias(f"d{c}") for c in (0, 1)]
    totals = by_word.agg(*cost, F.sum("k0").alias("k0"), F.sum("k1").alias("k1")).first()
    words = by_word.filter(F.greatest("k0", "k1", "most") >= many).toArrow()
    often = counts.filter(F.greatest("n0", "n1") >= many)
    by_before = counts.join(often.select("before").distinct(), "before", "left_semi").groupBy("before").agg(F.sum("n0").alias("b0"), F.sum("n1").alias("b1"))
    pairs = often.join(by_before, "before").toArrow()
    thrown_away(docs.sparkSession, kept)

    known = words["word"].to_numpy().view(np.uint64)
    order = np.argsort(known)
    known, k = known[order], [words[f"k{c}"].to_numpy()[order].astype(float) for c in (0, 1)]
    n = followed(docs, known, np.append(k[0] + k[1] >= HOT, True))
    shared = n / max(n.sum(), 1)
    lower, back, _ = lower_order(k, [totals["k0"] or 0, totals["k1"] or 0], [totals["d0"] or 0, totals["d1"] or 0], shared[:-1])
    # the word that stands for all others: no class has a surplus of it, so any share does
    lower = [np.append(lower[c], back[c] * max(shared[-1], 1e-12)) for c in (0, 1)]

    before, word = (pairs[x].to_numpy().view(np.uint64) for x in ("before", "word"))
    direct = upper_order(*([pairs[f"{x}{c}"].to_numpy().astype(float) for c in (0, 1)] for x in ("n", "b")), index_of(known, word), lower)
    used = (direct[0] > 0) | (direct[1] > 0)
    pair, order = np.unique(pair_hash(before, word)[used], return_index=True)
    contexts, at = np.unique(before[used], return_inverse=True)
    return {
        "known": known, "lower": np.array(lower), "pair": pair, "direct": np.array([np.append(d[used][order], 0) for d in direct]),
        "contexts": contexts, "back": np.array([np.append(1 - np.bincount(at, weights=d[used], minlength=len(contexts)), 1) for d in direct]),
    }


def ratios(model: dict, few, at, offsets):
    """Log-likelihood ratio (toxic to ordinary) of every word of ``few[at]``, under the models and under their lower order."""
    import numpy as np

    alone = model["lower"][:, index_of(model["known"], few)]
    lower = (np.log(alone[1]) - np.log(alone[0]))[at]
    # after a word that no surplus pair begins with, both models are their lower order
    context = np.empty(len(at), dtype=np.int64)
    context[1:] = index_of(model["contexts"], few)[at[:-1]]
    context[offsets[:-1][offsets[:-1] < offsets[1:]]] = index_of(model["contexts"], np.array([_BEGIN], dtype=np.uint64))[0]
    where = np.flatnonzero(context < len(model["contexts"]))
    context, word = context[where], at[where]
    pair = index_of(model["pair"], pair_hash(model["contexts"][context], few[word]))
    after = model["direct"][:, pair] + model["back"][:, context] * alone[:, word]
    upper = lower.copy()
    upper[where] = np.log(after[1]) - np.log(after[0])
    return upper, lower


def likelihoods(docs: DataFrame, model) -> DataFrame:
    """``doc_id, after, alone``: each text's difference of log-likelihoods a word, under the models and under their lower order."""

    def run(batches):
        import numpy as np

        words, tables = Words(), model.value
        for batch in batches:
            for part in pieces(batch, most=WORD_BATCH):
                few, at, offsets = words.coded(part["text"])
                n = np.maximum(np.diff(offsets), 1)
                after, alone = (np.diff(np.concatenate(([0.0], np.cumsum(x)))[offsets]) / n for x in ratios(tables, few, at, offsets))
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(after), pa.array(alone)], names=["doc_id", "after", "alone"])

    return texts(docs).mapInArrow(run, "doc_id long, after double, alone double")


def fit_curve(x, y, rounds: int = 30, ridge: float = 1e-3):
    """Weights of a logistic regression on scaled columns: ``centre, scale, weights``.

    A likelihood ratio never speaks against its own class: a column that would
    get a weight below 0 gets 0, and the rest is fitted again.
    """
    import numpy as np

    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    used = np.ones(x.shape[1], dtype=bool)
    while True:
        a = np.column_stack([np.ones(len(x)), ((x - centre) / scale)[:, used]])
        w = np.zeros(a.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge * len(x) * np.eye(len(w)), a.T @ (p - y) + ridge * len(x) * w)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        whole = np.zeros(x.shape[1] + 1)
        whole[np.append(True, used)] = w
        if (whole[1:] >= 0).all():
            return centre, scale, whole
        used &= whole[1:] >= 0


def score_toxicity(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    import numpy as np

    sample = labelled_sample(labels, most)
    kinds = set(sample.values())
    ids = texts(docs)
    if len(kinds) < 2:
        share = float(sum(sample.values()) / max(len(sample), 1))
        return ids.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.lit(share).alias("score"), F.lit(int(share >= THRESHOLD)).alias("predicted"))
    fold = lambda d: (d * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 40
    unseen = {d: x for d, x in sample.items() if fold(d) % FOLDS == 0}
    unseen = unseen if len(set(unseen.values())) == 2 else sample
    seen = {d: x for d, x in sample.items() if d not in unseen} if unseen is not sample else sample
    seen = seen if len(set(seen.values())) == 2 else sample
    model = docs.sparkSession.sparkContext.broadcast(fit_models(docs, seen))
    rows = likelihoods(of_sample(docs, unseen), model).toArrow()
    if rows.num_rows:
        x = np.column_stack([rows["after"].to_numpy(), rows["alone"].to_numpy()])
        centre, scale, w = fit_curve(x, np.array([unseen[d] for d in rows["doc_id"].to_pylist()], dtype=float))
    else:
        centre, scale, w = np.zeros(2), np.ones(2), np.array([0.0, 1.0, 1.0])
    line = F.lit(float(w[0]))
    for name, m, s, b in zip(("after", "alone"), centre, scale, w[1:], strict=True):
        line = line + (F.col(name) - float(m)) / float(s) * float(b)
    score = 1 / (1 + F.exp(-line))
    return likelihoods(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
