"""Packing, token counts, chat windows, language ID, URL rules, mixing and the pipeline, against plain versions."""

import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixeloom.llm import chat, language, mixing, packing, queries, token_count, url_filter

ODD = [None, "", " ", "\n", "  a  b\n\n c", "é É É ﬁ İ", "don't  stop...now, <s> </s> <|endoftext|> x", "日本 語▁x", "$$$ 123 a1b2", "\x85\x1c\xa0|　 a"]


def file(name):
    pytest.importorskip("public_tokenizers")
    return queries.tokenizer_file(name)


def texts(seed, n):
    rng = random.Random(seed)
    parts = [" ", " ", "  ", "\n", "\t", "the", "ing", "é", "ß", "X", ".", ",", "'s", "23", "日", "—", "...", "<s>", "▁", "don't"]
    return [*ODD, *("".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(n))]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(rows)], "doc_id long, text string, length string, rank int")


def test_token_counts(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = file("piece_bpe_32k.model")
    rows = texts(1, 300)
    want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode([t or "" for t in rows])]
    got = token_count.count_tokens(docs(spark, rows), path, limit=20).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_tokens, r.over_limit) for r in got] == [(len((t or "").encode()), n, n > 20) for t, n in zip(rows, want, strict=True)]
    assert token_count.count_tokens(docs(spark, rows).limit(0), path).isEmpty()


@pytest.mark.parametrize("chunk", [1, 2, 7, 64])
def test_chunk_maps_compose_in_any_order(monkeypatch, chunk):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = file("piece_bpe_32k.model")
    library, machine = sentencepiece.SentencePieceProcessor(model_file=path), token_count.transducer(path)
    monkeypatch.setattr(token_count, "CHUNK", chunk)
    some = [(t or "").replace("▁", " ") for t in texts(chunk, 200)] + ["日本語" * 300, "執" * 90, " " * 77, "ab" * 400]
    raw = [t.encode() for t in some]
    data, bounds = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    assert machine.counts(data, bounds).tolist() == [len(x) for x in library.encode(some)]
    # one text's maps composed in another order
    text = np.frombuffer((" " + some[-4] + some[12] + some[30]).encode(), np.uint8)
    begin = np.arange(0, len(text), chunk)
    maps = machine.chunk_maps(text, begin, np.minimum(begin + chunk, len(text)))
    done = [machine.scan(text, maps, np.zeros(len(maps)))[-1:]]
    while len(maps) > 1:
        k = len(maps) // 2 - 1
        maps = np.concatenate([maps[:k], machine.compose(text, maps[k : k + 1], maps[k + 1 : k + 2]), maps[k + 2 :]]) if k >= 0 else machine.compose(text, maps[:1], maps[1:])
    for m in (*done, maps):
        begin, end, head, count, tail, _ = m[0]
        assert count + sum(machine.units(text, np.array([begin, tail]), np.array([head, end]))) == len(library.encode(text.tobytes().decode()[1:]))


def thue_morse(a, b, n):
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_words_that_polynomial_hashes_confuse(spark):
    """Thue-Morse words and their complements are told apart by tokenizers' tables and by near-duplicates."""
    from pixeloom.llm import near_dedup

    tokenizers, sentencepiece = pytest.importorskip("tokenizers"), pytest.importorskip("sentencepiece")
    rows = [w for x, y in ("ab", "cd", "xz") for n in (10, 11) for w in thue_morse(x, y, n)]
    frame = docs(spark, rows)
    path = file("piece_bpe_32k.model")
    want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(rows)]
    assert [r.n_tokens for r in token_count.count_tokens(frame, path).orderBy("doc_id").collect()] == want
    path = file("word_bpe_49k.json")
    plain = tokenizers.Tokenizer.from_file(path)
    want = [zlib.crc32(np.array([*plain.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for t in rows]
    assert [r.ids_crc32 for r in packing.pack(frame, path).orderBy("doc_id").collect()] == want
    assert all(r.kept and r.component_id == r.doc_id for r in near_dedup.near_dedup(frame).collect())


@pytest.mark.parametrize("table_bytes", [packing.TABLE_BYTES, 2000])
def test_word_table_equals_the_library(monkeypatch, table_bytes):
    """Words of letters alone, which go to the model directly, and all others; also when the table is dropped between slices."""
    tokenizers = pytest.importorskip("tokenizers")
    path = file("word_bpe_49k.json")
    monkeypatch.setattr(packing, "TABLE_BYTES", table_bytes)
    rng = random.Random(7)
    parts = ["a", "e", "th", "S", "ing", "QU", "zq", "\u0301", "é", "ſ", "K", "7", "'", "'s", "-", "!", "日", "\u00ad"]
    rows = [t or "" for t in texts(9, 100)] + [" ".join("".join(rng.choices(parts, weights=[6] * 7 + [1] * 11, k=rng.randrange(1, 12))) for _ in range(40)) for _ in range(100)]
    plain, table, got = tokenizers.Tokenizer.from_file(path), packing.WordTokens(path), []
    for k in range(0, len(rows), 7):
        raw = [t.encode() for t in rows[k : k + 7]]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        got += [ids.tolist() for ids in table.batch(np.frombuffer(b"".join(raw), np.uint8), bounds)]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in rows]


def test_packing(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = file("word_bpe_49k.json")
    rows = texts(2, 250) + ["long text " * 300]
    plain = tokenizers.Tokenizer.from_file(path)
    want = []
    for i, t in enumerate(rows):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k // 64, k, len(ids[k : k + 64]), zlib.crc32(ids[k : k + 64].tobytes())) for k in range(0, len(ids), 64)]
    got = packing.pack(docs(spark, rows), path, capacity=64).toPandas()
    assert sorted(map(tuple, got[["doc_id", "piece", "start", "length", "ids_crc32"]].to_numpy().tolist())) == want
    placed = got.sort_values(["sequence_id", "offset"])
    assert (placed.groupby("sequence_id").length.cumsum() - placed.length == placed.offset).all()
    assert placed.groupby("sequence_id").length.sum().max() <= 64
    assert placed.sequence_id.nunique() <= 1.03 * math.ceil(got.length.sum() / 64) + 1
    assert packing.pack(docs(spark, rows).limit(0), path).isEmpty()


@pytest.mark.parametrize("lengths", [[10] * 5, [1] * 9, [6, 4, 6, 4, 3, 3, 4], [10, 9, 9, 1]])
def test_plan_places_every_rank_once(lengths):
    have = {n: lengths.count(n) for n in set(lengths)}
    rows, sequences = packing.plan(have, 10)
    used = {}
    for n, table in rows.items():
        ranks = []
        for a, b, base, repeat, offset in table:
            for rank in range(a + 1, b + 1):
                ranks.append(rank)
                t = rank - a - 1
                used.setdefault(base + t % repeat, []).append((offset + t // repeat * n, n))
        assert sorted(ranks) == list(range(1, have[n] + 1))
    assert len(used) == sequences == math.ceil(sum(lengths) / 10)
    assert all(sum(n for _, n in v) <= 10 for v in used.values())


def brute_windows(turns, room, history):
    """(window text parts) of one conversation of (role, text) in order."""
    esc = lambda t: re.sub(r"(<s>|\[INST\]|\[/INST\]|</s>)", lambda m: m[0][0] + "\\" + m[0][1:], t.replace("\\", "\\\\"))
    outs = [f"<s>[INST] {esc(r)} [/INST]{esc(t)}</s>" for r, t in turns]
    sizes = [math.ceil(len(o) / 4) for o in outs]
    starts = [sum(sizes[:i]) for i in range(len(sizes))]
    span = [2 * (s // room) + ((s + n - 1) // room > s // room) for s, n in zip(starts, sizes, strict=True)]
    made = []
    for w in sorted(set(span)):
        own = [i for i, s in enumerate(span) if s == w]
        before = [i for i in range(own[0]) if starts[own[0]] - starts[i] <= history and not (i == 0 and turns[0][0] == "system")]
        lead = [0] if turns[0][0] == "system" and own[0] > 0 else []
        made.append("".join(outs[i] for i in lead + before + own))
    return made


def test_chat_windows_and_reading_back(spark):
    rng = random.Random(4)
    bits = ["hello ", "</s>", "[INST]", "\\", "<\\s>", "[/INST] ", "<s>", "wörld ", "\n", " [/INST]"]
    conversations = {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")], 3: [("system", ""), ("assistant", "")]}
    for c in range(20):
        roles = (["system"] if c % 3 == 0 else []) + [rng.choice(["user", "assistant", "tool [INST]"]) for _ in range(rng.randrange(1, 14))]
        conversations[100 + c] = [(r, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 60)))) for r in roles]
    rows = [(c, k, r, None if (c, k) == (3, 0) else t, "w") for c, turns in conversations.items() for k, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string")
    made = chat.windows(frame, budget=100, history=25, system=15)
    by = {}
    for r in made.orderBy("conv_id", "window").collect():
        by.setdefault(r.conv_id, []).append(r.text)
        assert all(r.text[s:][:n] is not None for s, n in r.losses)
    assert by == {c: brute_windows(t, 60, 25) for c, t in conversations.items()}
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    for c, turns in conversations.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        want = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(map(len, by[c])))
        assert tuple(got[c])[1:] == want
    assert chat.read_back(chat.windows(frame.limit(0))).isEmpty()


LANGUAGES = {"en": "the of and that with this from ing tion", "fr": "le la été où français être que très", "de": "der die straße über schön und nicht ä", "es": "el niño años también qué señor los"}


def language_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        name = rng.choice(sorted(LANGUAGES))
        rows.append((i, " ".join(rng.choice(LANGUAGES[name].split()) for _ in range(rng.randrange(4, 60))), name))
    return rows


def test_language_on_held_out_rows(spark):
    rows = [(i, t, name if i % 3 else None, name, f"host-{name}" if i % 5 else None, "s") for i, t, name in language_rows(5, 600)]
    rows += [(1000, None, "en", "-", None, "s"), (1001, "", None, "-", "new", "s"), (1002, "12 34", "fr", "-", None, "s"), (1003, "été très " * 5000, None, "fr", None, "s")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string, source string, _x string")
    got = language.identify(frame, ["doc_id", "truth", "_x"]).collect()
    assert len(got) == len(rows)
    held_out = [r for r in got if r.doc_id < 1000 and r.doc_id % 3 == 0]
    assert sum(r._language.language == r.truth for r in held_out) >= 0.98 * len(held_out)
    odd = {r.doc_id: r._language for r in got if r.doc_id >= 1000}
    assert all(odd[i].language is None and not odd[i].kept for i in (1000, 1001, 1002)) and odd[1003].language == "fr" and odd[1003].kept
    assert language.identify(frame.limit(0), ["doc_id"]).isEmpty()
    assert not language.identify(frame.withColumn("lang", F.lit(None).cast("string")), ["doc_id"]).where("_language.kept").count()


def test_a_rare_language_is_known(spark):
    rows = [(i, t, name) for i, t, name in language_rows(13, 1500)]
    rows += [(5000 + i, f"hyvää päivää kiitos {i}", "fi") for i in range(language.LEAST_ROWS)] + [(6000 + i, "tak", "da") for i in range(language.LEAST_ROWS - 1)]
    frame = spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, lang string, source string")
    # the sample of the whole table would hold 0.07 of its rows
    names, _ = language.fit_text_model(frame.selectExpr("doc_id as id", "text", "lang as declared"), 20)
    assert names == sorted([*LANGUAGES, "fi"])
    got = {r.doc_id: r._language for r in language.identify(frame, ["doc_id"], sample_rows=20).where("doc_id >= 5000 and doc_id < 6000").collect()}
    assert len(got) == language.LEAST_ROWS and all(v.language == "fi" and v.kept for v in got.values())


def test_a_host_decides_where_the_text_does_not(spark):
    rows = [(i, t, name, "h-" + name, "p") for i, t, name in language_rows(6, 400)]
    rows += [(900 + k, "a", None, "h-" + name, "p") for k, name in enumerate(sorted(LANGUAGES))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, parent string")
    got = language.identify(frame, ["doc_id"], parent_col="parent").where("doc_id >= 900").orderBy("doc_id").collect()
    assert [r._language.language for r in got] == sorted(LANGUAGES)


def test_page_evidence(spark):
    pages = spark.createDataFrame([("https://blog.x.example.fr/a", "<html lang='fr'><script>no()</script><p>été</p></html>"), (None, None), ("nothing", "<p>x")], "url string, html string")
    got = [r.evidence for r in language.page_evidence(pages).collect()]
    assert (got[0].host, got[0].parent, got[0].suffix, got[0].declared, got[0].text.strip()) == ("blog.x.example.fr", "example.fr", "fr", "fr", "été")
    assert got[1].host is None and got[2].host is None and got[2].declared is None


def brute_language(spark, rows):
    """(language, confidence) of (id, text, declared, host, parent, suffix) rows: text likelihoods from the model, the rest counted."""
    frame = spark.createDataFrame([r[:3] for r in rows], "id long, text string, declared string")
    names, model = language.fit_text_model(frame)
    named = [r for r in rows if r[2] in names]
    world = [(sum(r[2] == x for r in named) + 1) / (len(named) + len(names)) for x in names]
    out = {}
    for i, text, declared, host, parent, suffix in rows:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        codes, _ = language.trigrams(raw, np.array([0, len(raw)]))
        score = []
        for k, x in enumerate(names):
            logs = model[k][codes].astype(float).sum() * min(len(codes), language.FULL_WEIGHT) / max(1, len(codes))
            prior = world[k]
            here, up = [r for r in named if r[3] == host], [r for r in named if r[4] == parent]
            if host is not None and here:
                prior = (sum(r[2] == x for r in up) + 20 * prior) / (len(up) + 20)
                prior = (sum(r[2] == x for r in here) + 20 * prior) / (len(here) + 20)
            at = [r for r in named if suffix is not None and r[5] == suffix]
            address = (sum(r[2] == x for r in at) + world[k]) / (sum(r[2] == x for r in named) + 1) if at else 1
            said = 1 if declared not in names else 0.9 if declared == x else 0.1 / (len(names) - 1)
            score.append(logs + math.log(prior) + math.log(address) + math.log(said))
        best = max(score)
        out[i] = (names[score.index(best)], 1 / sum(math.exp(s - best) for s in score)) if len(codes) else (None, 0.0)
    return out


def test_op8_uses_the_evidence_of_pages(spark, tmp_path):
    ends = {"en": "com", "fr": "fr", "de": "de", "es": "es"}
    pages = [(i, f"https://h{i % 3}.{name}{i % 2}.{'com' if i % 6 == 0 else ends[name]}/{i}", f"<html{'' if i % 5 == 0 else f' lang={name!r}'}><p>{t}</p></html>") for i, t, name in language_rows(8, 200)]
    probes = {900 + k: name for k, name in enumerate(sorted(LANGUAGES))}
    pages += [(i, f"http://new-{name}.{ends[name]}/", "<p>z</p>") for i, name in probes.items()] + [(910, None, "<p>été</p>"), (911, "http://x.fr/", None), (912, "http://x.unseen/", "<p>der die</p>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    documents = spark.createDataFrame([(i, t, name, "s") for i, t, name in language_rows(9, 100)], "doc_id long, text string, lang string, source string")
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op8_language_id(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got if r.page_id is None) == list(range(100))
    alone = {r.doc_id: tuple(r._language) for r in language.identify(documents, ["doc_id"]).collect()}
    assert all((r.language, r.confidence, r.kept) == alone[r.doc_id] for r in got if r.page_id is None)
    seen = {r.page_id: r for r in got if r.doc_id is None}
    evidence = language.page_evidence(spark.createDataFrame(pages, "page_id long, url string, html string")).select("page_id", "evidence.*").collect()
    want = brute_language(spark, [(r.page_id, r.text, r.declared, r.host, r.parent, r.suffix) for r in evidence])
    assert sorted(seen) == sorted(want) and all(seen[r.page_id].declared == r.declared for r in evidence)
    for i, (name, share) in want.items():
        assert (seen[i].language, seen[i].kept) == (name, share >= 0.5) and math.isclose(seen[i].confidence, share, rel_tol=1e-4), i
    # nothing but the suffix tells these apart
    assert {i: seen[i].language for i in probes} == probes


def brute_url(url):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = re.search("[/?#]", rest)
        host, rest = (rest, "") if cut is None else (rest[: cut.start()], rest[cut.start() :])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = re.split("[?#]", rest)[0]
    fits = [(-len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        _, rule, verdict = min(fits)
        return host, path, rule, None, verdict
    labels, parts = host.split("."), path.split("/")
    general = None
    if any(p == "login" or p.startswith("login.") for p in parts[1:]):
        general = "login pages"
    if any(p == "cart" or p.startswith("cart.") for p in parts[1:]):
        general = "shopping carts"
    if "ads" in labels[:-1]:
        general = "advertising hosts"
    if re.search(r"[.](zip|gz|exe|mp4|jpg|png)\Z", host + path):
        general = "archives and media"
    return host, path, None, general, "block" if general else "allow"


def test_url_rules(spark, tmp_path):
    urls = [None, "", "x", "http://", "http://example.org", "HTTP://A.Example.ORG/es/1?x", "http://example.org/es", "http://example.org/en/12", "http://example.org/en/2#1", "http://badexample.org/es/", "https://a.com/fr/x", "https://a.com/de/", "https://com/de/x", "https://b.net/login", "https://b.net/login.html?x", "https://b.net/x/login/y", "https://b.net/nologin", "https://b.net/login\n", "https://shop.net/cart/x", "https://shop.net/a\nb/cart", "https://ads.b.net/", "https://myads.b.net/", "https://b.net/a.zip", "https://b.net/a.zip\n", "https://b.net/a.zip?x", "https://org/a.zip", "https://x.com/fr/cart", "http://x.org?y=://z.com/de/", "http://a.com:80/fr/", "http://é.org/É/a\nb"]
    rng = random.Random(8)
    urls += ["http://" + rng.choice(["a.", "", "b.a."]) + rng.choice(["example.org", "org", "com", "x.com", "net"]) + rng.choice(["", "/", "/es/", "/en/1", "/fr/", "/de/", "/fr", "/en/"]) + rng.choice(["", "x", "1/2", "?q=/de/"]) for _ in range(200)]
    frame = spark.createDataFrame([(i, u, "h", "t") for i, u in enumerate(urls)], "page_id long, url string, host string, tokens string")
    got = url_filter.judge(frame).orderBy("page_id").collect()
    assert [tuple(r)[1:] for r in got] == [brute_url(u) for u in urls]
    assert {r.rule for r in got} == {None, "org/", "example.org/es/", "example.org/en/1", "com/fr/", "com/de/"}
    assert {r.method_rule for r in got} == {None, "login pages", "shopping carts", "advertising hosts", "archives and media"}
    # the registered SQL over the same URLs
    duckdb = pytest.importorskip("duckdb")
    frame.select("page_id", "url").write.parquet(str(tmp_path / "pages"))
    sql = queries.ORACLES["op6_url_filter"].replace("FROM pages", f"FROM '{tmp_path}/pages/*.parquet'")
    names = ["page_id", "host", "path", "rule", "method_rule", "verdict"]
    assert [r[1:] for r in sorted(duckdb.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall())] == [brute_url(u) for u in urls]
    assert url_filter.judge(frame.limit(0)).isEmpty()
    assert {r.verdict for r in url_filter.judge(frame, []).collect()} == {"allow"}


def brute_targets(sizes):
    """The rule as told: share by weight, cap, reshare."""
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target, full, left = {}, set(), float(sum(sizes.values()))
    while True:
        open_ = [s for s in names if s not in full]
        share = left / max(1, sum(weight[s] for s in open_))
        over = [s for s in open_ if share * weight[s] > 3 * sizes[s]]
        if not over:
            return target | {s: share * weight[s] for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            full.add(s)


def test_mixing(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([None, "", " "]) if rng.random() < 0.05 else "w " * rng.randrange(1, 60), rng.choice(["a", "a", "a", "b", "c", "Z", None]) if i > 6 else "tiny", 1, 2) for i in range(1500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, copies int")
    got = mixing.mix(frame).collect()
    words = {i: len(re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t, *_ in rows}
    sizes = {}
    for i, _, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + words[i]
    want = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.size == words[r.doc_id] and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 60 for s in sizes)
    again = {r.doc_id: r.taken for r in mixing.mix(frame.repartition(3)).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    assert mixing.mix(frame.limit(0)).isEmpty()


def test_word_count(spark):
    rows = [*ODD, "\x0b\x0c a\rb ", "a"]
    got = docs(spark, rows).select("doc_id", mixing.word_count(F.col("text")).alias("n")).orderBy("doc_id").collect()
    assert [r.n for r in got] == [len(re.findall("[^\x20\x09-\x0d]+", t or "")) for t in rows]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as pipeline

    file("word_bpe_49k.json")
    rng = random.Random(11)
    rows = []
    for i, t, name in language_rows(12, 150):
        rows.append((i, t + " " + " ".join(rng.choice(LANGUAGES[name].split()) for _ in range(80)), name, f"s{i % 4}", 0, "n", "k"))
    rows += [(500, rows[0][1], "en", "s1", 0, "n", "k"), (501, "  " + rows[1][1], "en", None, 0, "n", "k"), (502, rows[2][1] + " extra", rows[2][2], "s1", 0, "n", "k"), (503, None, None, None, None, None, None), (7, rows[7][1], rows[7][2], "s3", 0, "n", "k")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, _id string")
    frame = frame.withColumnRenamed("_id", "_text")
    where = str(tmp_path / "documents.parquet")
    frame.write.parquet(where)
    kept = {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        frame = stage(spark, frame, str(tmp_path))
        frame.write.parquet(str(tmp_path / f"stage-{k}"))
        frame = spark.read.parquet(str(tmp_path / f"stage-{k}"))
        kept[name] = sorted(r.doc_id for r in frame.collect())
        if k < len(pipeline.STAGES) - 1:
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "_text"]
    first, exact, near, mixed, _ = kept.values()
    assert 503 not in first and len(first) == len(rows) - 1
    assert exact.count(7) == 1 and 0 in exact and 500 not in exact and 501 in exact and 1 not in exact and 502 in exact
    assert 502 not in near and 2 in near and set(near) <= set(exact) and len(near) == len(exact) - 1
    assert set(mixed) <= set(near)
    total = frame.agg(F.sum("length")).first()[0]
    assert frame.select("sequence_id").distinct().count() <= total / 4096 * 1.1 + 1
    assert len(json.dumps(kept)) > 0 and pipeline.run(spark, str(tmp_path)).count() == frame.count()
