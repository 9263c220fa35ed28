"""Exact, near and substring dedup, and embeddings, against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixeloom.llm import embedding_dedup, exact_dedup, near_dedup, substring_dedup

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def table(spark, rows, schema="doc_id long, text string, id string, digest int, n int, component double"):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", 1, 2, 3.0) for i, t in rows], schema)


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def documents(seed, n=120):
    rng = random.Random(seed)
    base = [[rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(rng.randrange(1, 120))] for _ in range(n // 4)]
    out = [None, "", " \t\n", "one", "One", "one two", "ONE  TWO", "één één", "é"]
    for _ in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        out.append(rng.choice([" ", " ", "\n", "  "]).join(words))
    return list(enumerate(out))


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.length(c).cast("string")])
def test_exact_dedup(spark, digest):
    rows = documents(1) + [(5, "One"), (700, "a b"), (701, "a  b"), (702, "ab")]
    got = exact_dedup.exact_dedup(table(spark, rows), digest=digest).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i))
    want = sorted((i, min(g)[1], len(g)) for g in groups.values() for _, i in g)
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups) and all(r.keep_id == r.doc_id for r in got if r.kept)
    if digest is exact_dedup.sha256:
        assert {r.digest for r in got} == {hashlib.sha256(k.encode()).hexdigest() for k in groups}


def test_state_outlives_a_call(spark, tmp_path):
    """Three tables arrive; the second and third meet what came before, in files and outside of them."""
    first = [(1, "a b"), (2, "x"), (3, "ab"), (4, None)]
    second = [(5, "a  b "), (6, "y"), (7, "x"), (7, "x"), (8, "zz")]
    third = [(0, "z z"), (9, "new"), (10, " ")]
    base, seen = str(tmp_path / "state"), []
    for k, rows in enumerate((first, second, third)):
        frame = table(spark, rows)
        if k != 1:
            frame.write.parquet(str(tmp_path / f"t{k}"))
            frame = spark.read.parquet(str(tmp_path / f"t{k}"))
        got = exact_dedup.exact_dedup(frame, state=base).collect()
        seen += rows
        groups = {}
        for i, t in seen:
            groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i))
        want = sorted((i, min(g)[1], len(g)) for i, t in rows for g in [groups[re.sub("[\x20\x09-\x0d]", "", t or "")]])
        assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == want
    # digests that stand for several texts, over two calls
    weak, base = (lambda c: F.length(c).cast("string")), str(tmp_path / "weak")
    exact_dedup.exact_dedup(table(spark, [(1, "ab"), (2, "cd")]), digest=weak, state=base).collect()
    got = exact_dedup.exact_dedup(table(spark, [(3, "cd"), (4, "e"), (5, "a  b")]), digest=weak, state=base).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [(3, 2, 2, False), (4, 4, 1, True), (5, 5, 2, True)]


def test_rows_of_files_are_told_apart(spark, tmp_path):
    """Equal rows in several files, and columns with the names that the operator uses."""
    rows = [(1, "one two"), (1, "one two"), (2, "onetwo"), (3, "three")] * 5
    frame = table(spark, rows, "doc_id long, text string, file string, _metadata int, row int, xd__at double")
    frame.repartition(3).write.parquet(str(tmp_path / "docs"))
    left = exact_dedup.distinct_rows(spark.read.parquet(str(tmp_path / "docs"))).collect()
    assert sorted((r.doc_id, r.text) for r in left) == [(1, "one two"), (3, "three")]


def test_empty_tables(spark):
    empty = table(spark, [(1, "x")]).limit(0)
    assert exact_dedup.exact_dedup(empty).isEmpty()
    assert near_dedup.near_dedup(empty).isEmpty()
    assert substring_dedup.substring_dedup(empty).isEmpty()
    assert embedding_dedup.embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).isEmpty()


def shingles(text, width):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(low))
    return frozenset([tuple(words)] if 0 < len(words) < width else (tuple(words[i : i + width]) for i in range(len(words) - width + 1)))


@pytest.mark.parametrize(("width", "percent", "seed"), [(3, 85, 1), (5, 80, 2)])
def test_near_dedup(spark, width, percent, seed):
    rows = documents(seed, 200) + [(900, "one"), (900, "one")]
    sets = {i: shingles(t, width) for i, t in rows}
    parent = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(parent, i), find(parent, j)
                parent[max(a, b)] = min(a, b)
    got = near_dedup.near_dedup(table(spark, rows), near_dedup.Similarity(width, percent)).collect()
    assert len(got) == len(rows)
    assert all((r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), find(parent, r.doc_id), find(parent, r.doc_id) == r.doc_id) for r in got)


def test_links_are_confirmed_whatever_the_signatures(monkeypatch):
    monkeypatch.setattr(near_dedup.Similarity, "radius", property(lambda self: 0))
    shingles = np.concatenate([np.arange(200), np.arange(10, 200), np.arange(5000, 5190)])
    src, dst = near_dedup.compare_sets(np.array([4, 5, 6]), shingles, np.array([0, 200, 390, 580]), near_dedup.Similarity(5, 95))
    assert (src.tolist(), dst.tolist()) == ([4], [5])


def test_oversized_keys_and_clusters_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    monkeypatch.setattr(near_dedup, "BLOCK_WORDS", 500)
    monkeypatch.setattr(near_dedup, "MOST_WORDS", 700)
    test_near_dedup(spark, 3, 85, 3)


@pytest.mark.parametrize("radius", [3, 21, 22, 37])
def test_every_pair_within_the_radius_shares_an_index_key(radius):
    rng = np.random.default_rng(radius)
    a = rng.integers(0, 1 << 16, (400, near_dedup.SYMBOLS), np.uint16)
    b = a.copy()
    for i in range(len(a)):
        at = rng.choice(near_dedup.SYMBOLS, radius, replace=False)
        b[i, at] += np.uint16(1)
    assert (near_dedup.index_keys(a, radius) == near_dedup.index_keys(b, radius)).any(1).all()


def brute_substrings(rows, window):
    seen, out = {}, {}
    for i, t in sorted(rows):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - window + 1):
            if seen.setdefault(data[k : k + window], i) < i:
                gone[k : k + window] = b"\1" * window
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def substring_rows(seed):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdeé \n") for _ in range(rng.randrange(20, 160))) for _ in range(12)]
    rows = [(0, None), (1, ""), (2, "a" * 49), (3, "a" * 300), (4, "a" * 200), (5, "ab" * 100), (6, "ba" * 100)]
    for i in range(7, 80):
        rows.append((i * 3, "".join(rng.choice(passages)[rng.randrange(30) :] + "".join(rng.choice("xyz ") for _ in range(rng.randrange(40))) for _ in range(rng.randrange(1, 6)))))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("window", "most", "bucket_bytes"), [(50, 20_000, 1 << 22), (50, 20_000, 9000), (50, 2, 1 << 22), (24, 20_000, 500)])
def test_substring_dedup(spark, tmp_path, window, most, bucket_bytes):
    """One bucket, a few (from a file), many; and anchors so hot that parts of their runs are dealt out."""
    rows = substring_rows(window)
    frame = table(spark, rows)
    frame.write.parquet(str(tmp_path / "docs"))
    small = most == 2

    def few(found):
        found["kind"][found["kind"] == substring_dedup.RUNS] = substring_dedup.PARTS
        return found

    docs = spark.read.parquet(str(tmp_path / "docs"))
    if small:  # the verdicts that a limit of two runs would give, for the workers don't see a changed limit
        src = docs.selectExpr("coalesce(doc_id, -1) as id", "text", "0L as row")
        judged = substring_dedup.second_pass(substring_dedup.first_pass(src, window, 2), 2)
        turn = F.udf(lambda blob: substring_dedup.pack(few(substring_dedup.unpack([bytes(blob)], substring_dedup.VERDICT))), "binary")
        judged = judged.withColumn("rows", turn("rows"))
        texts = substring_dedup.texts_by_bucket(src, 2)
        masks = substring_dedup.last_pass(substring_dedup.third_pass(texts, judged, window, 2), window, 2)
        got = substring_dedup.remove(texts, judged, masks, window).withColumnRenamed("id", "doc_id").collect()
    else:
        got = substring_dedup.substring_dedup(docs, window, bucket_bytes=bucket_bytes).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_substrings(rows, window)


def test_no_byte_is_removed_on_a_hash(monkeypatch):
    """All anchors alike and all keys alike: still only equal bytes fold and only equal windows are repeated."""
    monkeypatch.setattr(substring_dedup, "mix", lambda x: x & np.uint64(1))
    texts = [t.encode() for _, t in substring_rows(50) if t and len(t) > 60]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    text, start, size, place, anchor = substring_dedup.runs(data, at, 50)
    records = np.zeros(len(text), substring_dedup.RECORD)
    records["anchor"], records["doc"], records["at"], records["size"], records["rel"] = anchor, text, start - at[text], size, place - start
    whole = substring_dedup.fold(records, start, data, 50)
    raw = data.tobytes()
    run = lambda i: raw[start[i] : start[i] + int(size[i]) + 49]
    assert all(any(run(i) == run(j) and text[j] < text[i] for j in range(len(text))) for i in np.flatnonzero(whole))
    strings = np.zeros(len(text), substring_dedup.STRING)
    for name in ("doc", "at", "size", "rel"):
        strings[name] = records[name]
    strings["digit"] = 3  # one anchor for all
    strings["size"], strings["rel"], whole_strings = 1, 0, [raw[s : s + 50] for s in start]
    blob = np.frombuffer(b"".join(whole_strings), np.uint8)
    bits = substring_dedup.compared(strings, blob, 50)
    assert [bool(b) for b in bits] == [any(w == v and text[j] < text[i] for j, v in enumerate(whole_strings)) for i, w in enumerate(whole_strings)]


def test_a_settled_anchor():
    records = np.zeros(5, substring_dedup.RECORD)
    records["anchor"], records["doc"] = [9, 9, 4, 4, 7], [1, 2, 3, 3, 5]
    records["before"], records["after"] = [6, 6, 1, 1, 1], [0, 8, 2, 2, 0]
    assert sorted(substring_dedup.settle(records)["doc"].tolist()) == [1, 2]
    records["before"][0] = 7
    assert not len(substring_dedup.settle(records))
    records["after"][0] = 8
    assert len(substring_dedup.settle(records)) == 2


def test_a_text_longer_than_a_slice(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh ") for _ in range(3 * substring_dedup.SLICE_BYTES // 2))
    middle = substring_dedup.SLICE_BYTES
    rows = [(1, long[middle - 300 : middle + 300]), (2, long), (3, "x" + long[-200:])]
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in substring_dedup.substring_dedup(table(spark, rows)).collect()}
    assert got == {1: (600, 0), 2: (len(long), 600), 3: (201, 200)}


@pytest.mark.parametrize(("block", "sub", "most"), [(4096, 1024, 512), (40, 16, 512), (40, 16, 3)])
def test_embedding_dedup(spark, monkeypatch, block, sub, most):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(25, 32))
    x = [(centers[rng.integers(25)] + rng.normal(size=32) * rng.choice([0.05, 0.3, 0.5])).astype(np.float32).tolist() for _ in range(300)]
    x += [x[0], x[0], x[5], [v * 2 for v in x[7]]]
    rows = [(int(i), v, 1, 2) for i, v in zip(rng.permutation(len(x)), x, strict=True)]
    rows += [(1000, None, 0, 0), (1001, [0.0] * 32, 0, 0), (1002, [float("nan")] * 32, 0, 0), (1003, [1.0, None] * 16, 0, 0), (1004, [], 0, 0), (1005, [float("inf")] * 32, 0, 0), (1006, [1.0, 2.0], 0, 0), (1007, [1.0, 2.0], 0, 0)]
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "SUB", sub)
    monkeypatch.setattr(embedding_dedup, "MOST_BLOCKS", most)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, key int, rep int")).collect()}
    good = [(i, np.array(v, np.float64)) for i, v, *_ in rows if i < 1000 or i > 1005]
    parent, links = {i: i for i, *_ in rows}, {i: 0 for i, *_ in rows}
    for a, (i, v) in enumerate(good):
        for j, w in good[:a]:
            if len(v) == len(w) and v @ w / (np.sqrt(v @ v) * np.sqrt(w @ w)) >= 0.9:
                links[i] += 1
                links[j] += 1
                p, q = find(parent, i), find(parent, j)
                parent[max(p, q)] = min(p, q)
    assert got == {i: (links[i], find(parent, i), find(parent, i) == i) for i in parent}


def test_vectors_whose_squares_over_and_underflow(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e200, 1.1e200]), (3, [1e-200, 1e-200]), (4, [2e-200, 2.1e-200]), (5, [1e308, -1e308]), (6, [5e-324, 0.0]), (7, [1.0, 0.001]), (8, [float("inf"), 1.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5), 6: (1, 6), 7: (1, 6), 8: (0, 8)}


def test_rows_that_share_an_id_are_cut_by_their_own_text(spark):
    rng = random.Random(4)
    a, b, c, d = ("".join(rng.choice("abcdefgh ") for _ in range(150)) for _ in range(4))
    # a repeated id and null ids with texts of different lengths, the longer sharing parts with documents before and behind
    rows = [(None, d + a[:80]), (None, ""), (None, "short"), (None, c + d), (1, a), (5, b[:90] + a + b[90:]), (5, "tiny"), (5, c[:60]), (5, c[20:140] + b), (9, b + "x" + c), (9, b)]
    want = []
    for i, t in rows:
        less = {u[k : k + 50] for j, u in rows if (j is not None, j or 0) < (i is not None, i or 0) for k in range(len(u) - 49)}
        gone = bytearray(len(t))
        for k in range(len(t) - 49):
            if t[k : k + 50] in less:
                gone[k : k + 50] = b"\1" * 50
        kept = "".join(x for x, g in zip(t, gone, strict=True) if not g)
        want.append((i, len(t), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(table(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_null_ids_are_no_trouble(spark):
    rows = [(None, "a b c d e f g " * 9), (None, None), (3, "a b c d e f g " * 9)]
    frame = table(spark, rows)
    assert exact_dedup.exact_dedup(frame).count() == 3
    assert near_dedup.near_dedup(frame).count() == 3
    got = {(r.doc_id, r.n_removed) for r in substring_dedup.substring_dedup(frame).collect()}
    assert got == {(None, 0), (3, 126)}
    vectors = spark.createDataFrame([(None, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None)], "vec_id long, embedding array<double>")
    assert embedding_dedup.embedding_dedup(vectors).count() == 3
