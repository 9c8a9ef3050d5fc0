"""Line dedup, packing, BPE, chat, media, licenses against brute force on small tables with odd rows."""

import hashlib
import re
import statistics
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pathloom.llm import bpe, chat, fingerprints, licenses, line_dedup, media, packing

LONG = "a line that is long enough to be looked at by dedup, number "
SCHEMA = "doc_id long, text string, source string, row_hash string, whole string, keep_bitmap int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty texts, ties, repeated rows, a very long text, and columns whose names the operators use inside."""
    rows = [(i, f"{LONG}{i % 3}\nshort\n  {LONG.upper()}x \t\n" + f"own line of document {i} that nobody else has at all\n" * 2) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "MIT License and the Apache license, GENERAL Public license; mit license"), (103, "MIT License and the Apache license, GENERAL Public license; mit license"), (None, LONG + "0"), (None, None)]
    rows += [(200, "word " * 60_000 + "\n" + LONG + "1"), (201, "ünïcode ß 漢字 🙂 KK"), (202, f"{LONG}1\n{LONG}1\nx")]
    return spark.createDataFrame([(i, t, None if (i or 0) % 7 == 0 else f"s{(i or 0) % 3}", "clash", "clash", 1) for i, t in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def rows_of(odd):
    return [(r["doc_id"], r["text"] or "") for r in odd.collect()]


def test_line_dedup(odd, none):
    given_ = rows_of(odd)
    key = lambda line: re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in given_:
        for line in t.split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(i)
    top = {k: max(x for x in v if x is not None) for k, v in holders.items() if len(v) >= 5}
    want = sorted((str(i), t.count("\n") + 1, len([x for x in t.split("\n") if key(x) in top and top[key(x)] != i]), "\n".join(x for x in t.split("\n") if not (key(x) in top and top[key(x)] != i))) for i, t in given_)
    rows = line_dedup.keyed(odd)
    bitmaps = line_dedup.keep_bitmaps(rows)
    got = line_dedup.apply_bitmaps(rows, bitmaps)
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept"]) for r in got.collect()) == want
    whole = line_dedup.keep_lines(odd, bitmaps)
    assert whole.columns == odd.columns and sorted((str(r["doc_id"]), r["text"]) for r in whole.collect()) == sorted((a, d) for a, _, _, d in want)
    assert line_dedup.apply_bitmaps(line_dedup.keyed(none), line_dedup.keep_bitmaps(line_dedup.keyed(none))).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 9)), max_size=60), st.integers(1, 7), st.integers(1, 9))
def test_line_stream_over_any_cut(pairs, batch, part):
    """The streaming pass decides the same wherever partitions and batches are cut."""
    import pyarrow as pa

    rows = sorted({(h, -d) for h, d in pairs})
    rows = [(h, -d) for h, d in rows]
    dropped, left, reports = set(), [], []
    for start in range(0, len(rows), part):
        mine = rows[start : start + part]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in b], pa.int64()), pa.array([0] * len(b), pa.int64()), pa.array([r[1] for r in b], pa.int64()), pa.array([0] * len(b), pa.int64()), pa.array([0] * len(b), pa.int32())], schema=line_dedup._LINES) for i in range(0, len(mine), batch) if (b := mine[i : i + batch])]
        for out in line_dedup._stream(5)(iter(batches)):
            for r in out.to_pylist():
                if r["kind"] == line_dedup.DROPPED:
                    dropped.add((r["h1"], r["doc_id"]))
                elif r["kind"] == line_dedup.OPEN:
                    left.append((r["h1"], r["doc_id"]))
                else:
                    reports.append((r["h1"], r["n_docs"], r["doc_id"]))
    for h, d in left:
        mine = [x for x in reports if x[0] == h]
        if sum(x[1] for x in mine) >= 5 and d != max(x[2] for x in mine):
            dropped.add((h, d))
    docs = defaultdict(list)
    for h, d in rows:
        docs[h].append(d)
    assert dropped == {(h, d) for h, ds in docs.items() if len(ds) >= 5 for d in ds if d != max(ds)}


def slow_fit(items, capacity):
    bins, out = [], []
    for size, source, cluster in items:
        fit = [(b["left"], i) for i, b in enumerate(bins) if b["left"] >= size and (source is None or source not in b["s"]) and (cluster is None or cluster not in b["c"])]
        i = min(fit)[1] if fit else len(bins)
        if not fit:
            bins.append({"left": capacity, "s": set(), "c": set(), "n": 0})
        b = bins[i]
        b["left"] -= size
        b["s"].add(source)
        b["c"].add(cluster)
        out.append((i, b["n"]))
        b["n"] += 1
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.one_of(st.none(), st.integers(0, 3)), st.one_of(st.none(), st.integers(0, 4))), max_size=60))
def test_best_fit(items):
    assert packing.best_fit(items, 20) == slow_fit(items, 20)


def test_packing(odd, none):
    got = packing.pack_documents(odd, capacity=1000, shard_rows=20).collect()
    bins = defaultdict(list)
    for r in got:
        bins[r["bin_id"]].append(r)
    source = {r["doc_id"]: r["source"] for r in odd.collect()}
    for rows in bins.values():
        assert sum(r["length"] for r in rows) <= 1000 and sorted(r["slot"] for r in rows) == list(range(len(rows)))
        named = [source[r["doc_id"]] for r in rows if source[r["doc_id"]] is not None]
        assert len(named) == len(set(named))
    covered = defaultdict(list)
    for r in got:
        covered[r["doc_id"]].append((r["start"], r["length"]))
    for i, t in rows_of(odd):
        if i in (None, 103):
            continue
        parts = sorted(covered[i])
        assert sum(n for _, n in parts) == len(t) and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False))
    assert len(covered[103]) == 2 and len(covered[None]) == 2
    assert packing.pack_documents(none).count() == 0


def test_packing_keeps_large_ids_beside_null(spark):
    """Ids and clusters over 2**53 stay exact where others are null; near duplicates, given as clusters, never share a bin."""
    big = 2**53
    rows = [(None, "x" * 30, "a", None), (None, "", None, big + 1), *((big + k, "y" * (10 + k), f"s{k}", big + 1 + k // 2 * 2) for k in range(1, 40, 2)), (2**63 - 1, None, None, None), (-(2**63), "z", "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, cluster long").repartition(3)
    for cluster in (None, df["cluster"]):
        got = packing.pack_documents(df, capacity=100, cluster=cluster).collect()
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows)
        assert {r["doc_id"]: r["length"] for r in got if r["doc_id"] is not None} == {i: len(t or "") for i, t, *_ in rows if i is not None}
    pairs = [(k, "w" * 10, None, k // 2) for k in range(20)]
    twins = spark.createDataFrame(pairs, "doc_id long, text string, source string, cluster long")
    bins = defaultdict(list)
    for r in packing.pack_documents(twins, capacity=100, cluster=twins["cluster"]).collect():
        bins[r["bin_id"]].append(r["doc_id"] // 2)
    assert len(bins) == 2 and all(len(set(b)) == len(b) == 10 for b in bins.values())


def test_bpe(odd, none):
    codec = bpe._codec(*bpe._defaults(None, None))
    got = bpe.decode_tokens(bpe.encode_documents(odd)).collect()
    want = sorted((str(i), [x for x in codec.encode_ordinary(t)], t.encode()) for i, t in rows_of(odd))
    assert sorted((str(r["doc_id"]), [int.from_bytes(r["token_bytes"][k : k + 4], "little") for k in range(0, len(r["token_bytes"]), 4)], bytes(r["decoded"])) for r in got) == want
    assert bpe.decode_tokens(bpe.encode_documents(none)).count() == 0


def test_bpe_known_ids(spark):
    """Ids that the ranks are known to give, through encoding in a table and back."""
    known = {
        "": [], "Hello world": [15496, 995], "the  cat's 12345 \n\n tabs\t.": [1169, 220, 3797, 338, 17031, 2231, 220, 628, 22524, 197, 13], "naïve café – 漢字 🙂": [2616, 38776, 40304, 784, 10545, 120, 95, 27764, 245, 32485],
        "\x00\xa0\u2028end  ": [188, 1849, 447, 101, 437, 220, 220], " <|endoftext|> ": [1279, 91, 437, 1659, 5239, 91, 29, 220],
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(known)], "doc_id long, text string")
    for r in bpe.decode_tokens(bpe.encode_documents(df)).collect():
        text = list(known)[r["doc_id"]]
        assert bytes(r["token_bytes"]) == b"".join(x.to_bytes(4, "little") for x in known[text]) and r["n_tokens"] == len(known[text]) and bytes(r["decoded"]) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab'sé1 .\n\t\x1c\xa0漢🙂 ", max_size=60), st.integers(1, 6))
def test_safe_boundaries(text, size):
    codec = bpe._codec(*bpe._defaults(None, None))
    assert "".join(bpe.segments(text, size)) == text
    assert bpe.encode_text(codec, text, size) == codec.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="a\\n\n<|s>[/INST]", max_size=8), st.one_of(st.text(max_size=20), st.sampled_from(chat.CONTROL), st.text(alphabet="<|/s>[]INST\\ im_endstar", max_size=30))), max_size=6))
def test_chat_round_trip(turns):
    whole = chat.chatml(turns)
    spans = list(chat.rendered(chat.CHATML, iter(turns), lambda t: True))
    assert [s.added for s in spans] == [chat.chatml([t]) for t in turns] and "".join(s.added for s in spans) == whole
    assert [s.kept for s in spans] == [len(chat.chatml(turns[:k])) for k in range(len(turns))] and not any(s.rewritten for s in spans)
    assert [chat.parse_chatml(s.added) for s in spans] == turns
    assert [chat.unescape(s.added[s.start : s.end]) for s in spans] == [t for _, t in turns]
    for c in chat.CONTROL[2:]:
        assert c not in whole
    assert whole.count(chat.OPEN) == whole.count(chat.CLOSE) == len(turns)


def test_chat_long_conversations_stream(monkeypatch):
    turns = [("assistant" if i % 3 else "user", f"<s>turn {i}\\" * (i % 4)) for i in range(60)]
    whole = list(chat.rendered(chat.CHATML, iter(turns), chat.is_assistant))
    monkeypatch.setattr(chat, "FULL", 20)
    assert list(chat.rendered(chat.CHATML, iter(turns), chat.is_assistant)) == whole


def rebuilt(spans):
    out = ""
    for s in spans:
        out = out[: s.kept] + s.added
    return out


def test_chat_rewriting_templates_are_told():
    turns = [("user", "aaa"), ("assistant", "bb"), ("user", "aaa"), ("assistant", "d"), ("user", "e"), ("assistant", "f"), ("user", "g"), ("assistant", "bb")]
    moving = lambda turns: "".join(f"[{r}]{t}" for r, t in turns[:-1]) + (f"[last {turns[-1][0]}]{turns[-1][1]}" if turns else "")
    # older than five turns: the text is left out
    short = lambda turns: "".join(f"[{r}]{t if i >= len(turns) - 5 else ''}" for i, (r, t) in enumerate(turns))
    numbered = lambda turns: "".join(f"{i}:{r}>{t};" for i, (r, t) in enumerate(turns))
    for render, told in ((moving, [1, 2, 3, 4, 5, 6, 7]), (short, [5, 6, 7]), (numbered, [])):
        spans = list(chat.rendered(chat.Template(render), iter(turns), chat.is_assistant))
        assert [i for i, s in enumerate(spans) if s.rewritten] == told and rebuilt(spans) == render(turns)
        for s, (role, text) in zip(spans, turns, strict=True):
            assert s.start is None if role == "user" or s.rewritten else s.added[s.start : s.end] == text
    with pytest.raises(ValueError):
        list(chat.rendered(chat.Template(short, independent=True), iter(turns)))
    for render in (lambda turns: "".join(f"<{r}>" for r, _ in turns), lambda turns: "".join(f"<{r}>{t}{t}" for r, t in turns)):
        assert [s.start for s in chat.rendered(chat.Template(render), iter(turns[:2]), chat.is_assistant)] == [None, None]


def test_chat_any_template_in_a_table(spark):
    rows = [(c, i, "assistant" if i % 2 else "user", f"t{i}") for c in (1, 2) for i in range(7 if c == 1 else 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    short = chat.Template(lambda turns: "".join(f"[{r}]{t if i >= len(turns) - 5 else ''}" for i, (r, t) in enumerate(turns)))
    got = chat.format_turns(df, short).collect()
    assert {(r["conv_id"], r["turn_no"]) for r in got if r["rewritten"]} == {(1, 5), (1, 6)}
    assert {(r["conv_id"], r["turn_no"]) for r in got if r["in_loss"]} == {(1, 1), (1, 3), (2, 1)}


def test_chat_table(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>\\ yo"), (2, 5, "assistant", None), (2, 5, "assistant", None), (None, 0, None, "x"), *((3, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(300))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted((t, r or "", x or "") for k, t, r, x in rows if k == c)
        said = "".join(x for _, r, x in mine if r == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in mine).encode()).hexdigest() and got[c]["n_turns"] == len(mine)
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert got[c]["formatted_chars"] == len(chat.chatml([(r, x) for _, r, x in mine]))
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=1500))
def test_pgm_round_trip(data):
    p = media.pad(data)
    assert len(p) % 576 == 0 and len(p) >= 576 and p.startswith(data) and media.from_pgm(media.to_pgm(p)) == p
    for broken in (media.to_pgm(p)[:-1], b"P6" + media.to_pgm(p)[2:], b"", data):
        with pytest.raises(ValueError):
            media.from_pgm(broken)


def plain_features(p):
    blocks = [p[k * len(p) // 64 : (k + 1) * len(p) // 64] for k in range(64)]
    means = [sum(b) * 64 // len(p) for b in blocks]
    mean = statistics.fmean(p)
    return int(1000 * mean), statistics.pvariance(p), "".join("1" if m > statistics.median(means) else "0" for m in means)


def test_media(spark, odd, none, tmp_path):
    path = f"file://{tmp_path}/archives"
    media.write_archives(media.to_members(odd), path)
    got = media.measure(media.read_archives(spark, path, split_bytes=700)).collect()
    want = []
    for i, t in rows_of(odd):
        data = t.encode()
        p = data + b"\xff" * (576 - len(data) % 576 if len(data) % 576 or not data else 0)
        image = f"P5\n576 {len(p) // 576}\n255\n".encode() + p
        want.append((str(i), len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(image), hashlib.sha256(image).hexdigest(), plain_features(p)))
    told = []
    for r in got:
        mean, variance, bits = r["feature"].split(":")
        told.append((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"], (int(mean), int(variance), bits)))
    for x, y in zip(sorted(told), sorted(want), strict=True):
        assert x[:7] == y[:7] and x[7][2] == y[7][2] and abs(x[7][0] - y[7][0]) <= 1 and abs(x[7][1] - 1000 * y[7][1]) <= 1.01
    media.write_archives(media.to_members(none), f"{path}-none")
    assert media.read_archives(spark, f"{path}-none").count() == 0


def test_media_retries_a_member(tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("m", b"payload")
    calls = []

    class Flaky(zipfile.ZipFile):
        def read(self, name, pwd=None):
            calls.append(name)
            if len(calls) < 3:
                raise OSError("lost")
            return super().read(name, pwd)

    reopen = lambda: Flaky(tmp_path / "a.zip")
    first = reopen()
    assert media.read_member(first, first.infolist()[0], reopen, 3, 0) == b"payload" and len(calls) == 3
    calls.clear()
    with pytest.raises(OSError):
        media.read_member(first, first.infolist()[0], reopen, 2, 0)


def test_licenses(odd, none):
    got = licenses.scan_licenses(odd).collect()
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = []
    for i, t in rows_of(odd):
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        found = sorted((label, k) for label, phrase in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split())
        want.append((str(i), len(w), found))
    assert sorted((str(r["doc_id"]), r["n_words"], sorted((s["label"], s["start"]) for s in r["spans"] if s["exact"] and s["verified"])) for r in got) == sorted(want)
    assert licenses.scan_licenses(none).count() == 0


def test_notices_with_changes(spark):
    text = "Permission is hereby granted, free of any charge, to any one person obtaining a copy of this software and its associated documentation files."
    r = licenses.scan_licenses(spark.createDataFrame([(1, "x y z " + text), (2, "permission slips and free software")], "doc_id long, text string")).collect()
    labels = {x["doc_id"]: {s["label"] for s in x["spans"] if s["verified"]} for x in r}
    assert labels == {1: {"mit-grant"}, 2: set()}


def test_notice_positions_count_once(spark):
    texts = ["cc by cc by cc by nc 4", "licensed under cc by nc 4.0", "cc by " * 50 + "licensed under cc by nc 4 0 " + "cc by " * 50, "licensed under cc, by nc 4.0", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1, texts[1]), (None, texts[1])], "doc_id long, text string").repartition(3)
    got = sorted(((-1 if r["doc_id"] is None else r["doc_id"]), sorted((s["label"], s["start"], s["end"]) for s in r["spans"] if s["verified"])) for r in licenses.scan_licenses(df).collect())
    nc = "cc-by-nc-4.0"
    assert got == [(-1, [(nc, 0, 7)]), (0, []), (1, [(nc, 0, 7)]), (1, [(nc, 0, 7)]), (2, [(nc, 100, 107)]), (3, [(nc, 0, 7)]), (4, [])]


def spot_signatures(text):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text.lower()) if w]
    stop = set(fingerprints.anchors())
    chains = set()
    for i, w in enumerate(words):
        after = [x for x in words[i + 1 :] if x not in stop][:2] if w in stop else []
        if len(after) == 2:
            chains.add(" ".join([w, *after]))
    return chains or {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)} or set(words) or {hashlib.sha256(text.encode()).hexdigest()}


def digest_of(signatures):
    return hashlib.sha256("\n".join(sorted(signatures, key=str.encode)).encode()).hexdigest()


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_signatures(spark):
    texts = ["the cat sat on the mat and the dog barked at a tree.", "der Hund und die Katze laufen nach Hause", "no anchor words", "", "...", "one", "the", "the cat sat on the mat", "the " * 5000 + "cow stood"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {r["k"]: r["s"] for r in fingerprints.with_signatures(df, "text", "s").collect()}
    assert all(len(got[k]) == len(set(got[k])) and set(got[k]) == spot_signatures(t) for k, t in enumerate(texts))
    assert len({tuple(sorted(v)) for v in got.values()}) == len(texts)


def test_likeness_and_pruning(spark):
    rows = [([1, 2, 3, 4], [3, 4, 5]), ([1], list(range(30))), (list(range(10)), list(range(100))), ([7], [7]), ([1], [2]), ([0, 1], list(range(30)))]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>")
    assert [r[0] for r in df.select(fingerprints.likeness(df["a"], df["b"])).collect()] == [jaccard(set(a), set(b)) for a, b in rows]
    for least in (0.05, 0.1, 0.4, 0.8):
        got = [r[0] for r in df.select(fingerprints.likeness(df["a"], df["b"], least)).collect()]
        assert all(x == jaccard(set(a), set(b)) if jaccard(set(a), set(b)) >= least else x in (0.0, jaccard(set(a), set(b))) for x, (a, b) in zip(got, rows, strict=True))


def test_fingerprints_equal_brute_force(odd, none, spark, tmp_path):
    """Every column of the query, on odd rows: null and repeated ids, equal rows, empty and very long texts."""
    import xxhash

    order = sorted(set(rows_of(odd)), key=lambda x: (x[0] is not None, x[0] or 0, (xxhash.xxh64_intdigest(x[1].encode(), 42) + 2**63) % 2**64))
    after = {x: order[(k + 1) % len(order)][1] for k, x in enumerate(order)}
    want = []
    for i, t in rows_of(odd):
        u, k = after[i, t], len(t) // 4
        edited = t[: len(t) - k] + u[:k]
        own, new = spot_signatures(t), spot_signatures(edited)
        want.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), digest_of(own), digest_of(new), jaccard(own, new), jaccard(own, spot_signatures(u)), len(own), len(own).bit_length() - 1))
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    got = fingerprints.op5_fingerprints(spark, str(tmp_path)).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)
    assert fingerprints.compare_with_next(none).count() == 0
    r = fingerprints.compare_with_next(odd.filter("doc_id = 201")).first()
    assert r["edited"] == r["text"][: len(r["text"]) - len(r["text"]) // 4] + r["text"][: len(r["text"]) // 4] and sorted(r["next_hashes"]) == sorted(r["hashes"])


def test_fingerprint_buckets(spark, monkeypatch):
    """Wherever buckets are cut, each document meets the next one: with large ids, many of one id, and copies."""
    import xxhash

    rows = [(2**53 + 1 + 3 * i, f"the cat{i} sat{i} on the mat{i} ran") for i in range(60)] + [(5, f"a dog{i} ran off") for i in range(40)] + [(7, "the same old text") for _ in range(30)] + [(None, "x y"), (-(2**63), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    order = sorted({(i, t or "") for i, t in rows}, key=lambda x: (x[0] is not None, x[0] or 0, (xxhash.xxh64_intdigest(x[1].encode(), 42) + 2**63) % 2**64))
    want = {x: order[(k + 1) % len(order)][1] for k, x in enumerate(order)}
    for buckets in (1, 8, 40):
        monkeypatch.setattr(fingerprints, "BUCKETS", buckets)
        got = fingerprints.compare_with_next(df).collect()
        assert len(got) == len(rows)
        for r in got:
            u, k = want[r["doc_id"], r["text"]], len(r["text"]) // 4
            assert r["edited"] == r["text"][: len(r["text"]) - k] + u[:k] and len(r["next_hashes"]) == len(spot_signatures(u))
