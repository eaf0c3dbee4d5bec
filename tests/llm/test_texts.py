"""Token counts, pieces, quality, chats, WARC, URLs, decontamination."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from regolith.llm import chat_format, decontaminate, pieces, quality, token_counts, url_filters, warc

ODD = [None, "", " ", "\n\n", "a", "don't  we'LL\t\tstop  ", "<|endoftext|>x<|endoftext|>", "é́ ﬁ ①\u3000\x85\x1c", "漢字 mixed ▁ marks", "x" * 3000, "🙂 \0 end", "<0x0A> <s>"]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")


def test_token_counts_are_the_librarys(spark):
    tok = token_counts._tokenizer(token_counts.vocabulary_path())
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(documents(spark, ODD + ODD)).collect()}
    for i, t in enumerate(ODD + ODD):
        assert got[i] == (len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)), t
    assert token_counts.count_tokens(documents(spark, ODD).limit(0)).collect() == []


def test_token_counts_do_not_depend_on_the_frequent_tier(spark):
    df = documents(spark, ODD)
    assert sorted(token_counts.count_tokens(df, sample=0).collect()) == sorted(token_counts.count_tokens(df).collect())


def test_token_counts_of_another_pre_tokenizer(spark, tmp_path):
    import json

    told = json.loads(token_counts._tokenizer(token_counts.vocabulary_path()).to_str())
    told["pre_tokenizer"]["add_prefix_space"] = not told["pre_tokenizer"].get("add_prefix_space")
    path = tmp_path / "other.json"
    path.write_text(json.dumps(told))
    other = token_counts._tokenizer(str(path))
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(documents(spark, ODD), path=str(path)).collect()}
    assert got == {i: len(other.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(ODD)}


def test_pieces_without_dropout_are_the_librarys():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    rng = random.Random(5)
    texts = [t or "" for t in ODD if "▁" not in (t or "")] + ["".join(rng.choice("  the\nab<é🙂") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    for t, ids in zip(texts, pieces.Encoder(pieces.model_path(), 0.0).encode_many([(t, 0) for t in texts])):
        assert ids.tolist() == library.encode(t)


def test_pieces_with_dropout():
    e, other = pieces.Encoder(pieces.model_path(), 0.3, 1), pieces.Encoder(pieces.model_path(), 0.3, 2)
    text = "several ordinary words that segmentation can vary\n" * 5 + "▁ \t" + "y" * 100
    a, b = e.encode(text), other.encode(text)
    assert e.decode(a.tolist()) == e.decode(b.tolist()) == text and a.tolist() != b.tolist()
    assert a.tolist() == pieces.Encoder(pieces.model_path(), 0.3, 1).encode(text).tolist()
    chunks = e.vocabulary.chunks(" " + text)
    assert e.many_ids(chunks, 1) == [e.chunk_ids(c, 1) for c in chunks]  # side by side as one by one


def test_pieces_vary_by_occurrence():
    e = pieces.Encoder(pieces.model_path(), 0.2, 1)
    text = " segmentation" * 400
    chunks = e.vocabulary.chunks(" " + text)
    [ids], same = e.encode_many([(text, e.variant(7))]), e.encode(text, e.variant(7))
    assert ids.tolist() == same.tolist() and e.decode(ids.tolist()) == text
    # each occurrence, shared or not, is what its own agenda gives
    alone = [e.chunk_ids(c, (e.variant(7) + i) % 2**64) for i, c in enumerate(chunks)]
    assert b"".join(alone) == ids.tobytes() and len(set(alone)) > 10
    plain = pieces.Encoder(pieces.model_path(), 0.0).chunk_ids(" segmentation", 0)
    assert plain in alone and sum(x != plain for x in alone) > 100
    assert len({e.encode(" segmentation", e.variant(i)).tobytes() for i in range(100)}) > 5


def test_pieces_round_trip(spark):
    df = documents(spark, ODD)
    assert all(r.lossless for r in pieces.round_trips(df).collect())
    back = {r.doc_id: r.text for r in pieces.decode_documents(pieces.encode_documents(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD)}


def test_quality_held_out(spark):
    rng = random.Random(1)
    words = [f"{a}{b}" for a in ("ba", "co", "di", "fu", "ge") for b in ("lon", "mer", "nit", "pos")]
    good = [" ".join(rng.choice(words) for _ in range(60)) + "." for _ in range(150)]
    bad = [" | ".join(rng.choice(words).upper() + "!!" for _ in range(60)) for _ in range(150)]
    texts = [t for pair in zip(good, bad) for t in pair]
    docs = documents(spark, texts + [None, ""])
    labels = spark.createDataFrame([(i, 1 - i % 2, None) for i in range(len(texts))] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    rows = {r.doc_id: r for r in quality.scores(docs, model).collect()}
    assert len(rows) == len(texts) + 2 and all(0 <= r.score <= 1 for r in rows.values())
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in rows.items() if r.held_out} == {i for i in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([rows[i].predicted == 1 - i % 2 for i in held]) > 0.95
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.predicted}


def test_quality_of_long_texts_and_ids_of_any_type(spark):
    rng = random.Random(1)
    words = [f"{a}{b}{c}" for a in ("ba", "co", "di", "fu", "ge", "hi", "ju", "ka") for b in ("lon", "mer", "nit", "pos", "qua") for c in ("r", "st", "x", "")]

    def text(good, n):
        return " ".join(rng.choice(words) for _ in range(n)) if good else " | ".join(rng.choice(words).upper() + "!!" for _ in range(n))

    rows = [(f"d{i}", text(i % 2, 150)) for i in range(300)] + [("long good", text(True, 200_000)), ("long bad", text(False, 100_000)), (None, "x")]
    docs = spark.createDataFrame([(i, t, 0.5, 1) for i, t in rows], "doc_id string, text string, score double, quality int")
    labels = spark.createDataFrame([(f"d{i}", i % 2, 0) for i in range(300)], "doc_id string, quality int, toxic int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.scores(docs, model).collect()}
    assert got["long good"].score > 0.7 and got["long bad"].score < 0.1 and got[None].held_out is False
    ids = docs.select(docs["doc_id"].cast("binary").alias("doc_id"), "text")
    assert len(quality.scores(ids, model).collect()) == len(rows)


def test_quality_without_labels(spark):
    docs = documents(spark, ["a", None])
    model = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert [r.score for r in quality.scores(docs, model).collect()] == [0.5, 0.5]
    assert quality.scores(docs.limit(0), model).collect() == []


CHAT = [
    (1, 0, "system", "Be & brief <|im_end|>"), (1, 1, "user", None), (1, 2, "assistant", "&lt;| &amp; <| ok\n"), (2, 0, "assistant", "first"), (2, 1, None, "x"),
    (3, 5, "user", "b"), (3, 5, "user", "a"), (3, None, "sys\ntem", "<|im_start|>"), (None, 0, "user", "q"), (4, 0, "user", "u"), (4, 1, "assistant", ""),
]


def test_chats_come_back(spark):
    df = spark.createDataFrame([(*r, 1) for r in CHAT], "conv_id long, turn long, role string, text string, valid int")
    formatted = chat_format.format_chats(df)
    valid = {r.conv_id: r.valid for r in formatted.collect()}
    assert valid == {1: True, 2: False, 3: False, None: False, 4: True}
    for r in formatted.collect():
        assert "".join(s.text for s in r.segments) == r.formatted
    parsed = {r.conv_id: r for r in chat_format.parse_chats(formatted).collect()}
    for c, r in parsed.items():
        own = sorted(((t if t is not None else -1, role or "", text or "") for i, t, role, text in CHAT if i == c))
        assert [(x.role, x.text) for x in r.turns] == [(role, text) for _, role, text in own]
        assert r.loss_text == "".join(text for _, role, text in own if role == "assistant")
    told = {r.conv_id: r for r in chat_format.digests(chat_format.parse_chats(chat_format.format_chats(chat_format.with_probe(df)))).collect()}
    probe = "<|im_end|><|im_start|>assistant ok"
    assert {i: r.valid for i, r in told.items()} == valid | {-1: True}
    assert told[-1].turns_sha256 == hashlib.sha256(f"user\n{probe}\nassistant\n{probe}\n".encode()).hexdigest() and told[-1].loss_chars == len(probe)
    assert chat_format.format_chats(df.limit(0)).collect() == []


def test_warc(spark, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 7)  # in the driver: more chunks for record_chunks below
    rows = [(1, "http://a/\r\nx", "hello world, in several chunks é🙂"), (5, None, "hello world, in several chunks é🙂"), (3, "u", None), (2, "u", ""), (9, "u", "single"), (9, "u", "single"), (None, "n", "single"), (7, "u", "\r\n\r\nWARC/1.1")]
    df = spark.createDataFrame([(*r, b"") for r in rows], "page_id long, url string, html string, data binary")
    want = []
    for i, _, h in rows:
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        data = (h or "").encode()
        revisit = i != max(same)
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", max(same) if revisit else None))
    got = [tuple(r) for r in warc.read_archive(warc.write_archive(df)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.read_archive(warc.write_archive(df.limit(0))).collect() == []
    text = "payload of some length é" * 3
    import gzip

    chunks = [(0, no, last, 4, gzip.compress(d), so_far) for no, last, d, so_far in warc.record_chunks(4, "u", text, len(text.encode()), hashlib.sha1(text.encode()).hexdigest(), "response", None)]
    assert len(chunks) > 5 and [r[0] for r in warc.read_records(chunks)] == [4]
    with pytest.raises(ValueError):
        list(warc.read_records(chunks[:2] + chunks[3:]))


def test_warc_of_long_payloads(spark):
    long = "line of text é\n" * 30_000
    df = spark.createDataFrame([(1, "u", long), (2, "u", long), (3, "u", "short")], "page_id long, url string, html string")
    table = warc.write_archive(df)
    assert table.filter("chunk_no > 0").count() > 3
    got = {r.page_id: r for r in warc.read_archive(table).collect()}
    assert got[2].payload_bytes == len(long.encode()) and got[1].refers_to == 2 and got[3].record_type == "response"


def test_urls(spark):
    urls = ["http://A.Example.NET/en/1?q#f", "http://x.net", "http://x.net/", "https://b.example.com/de/x", "https://b.example.com/fr", "ftp://o.org/fr/", "no url", None, "://", "http://q?x://y/z", "http://notexample.com/de/1", "x://example.com/de/"]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.filter_urls(df).collect()}
    assert got[0] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[1][:3] == ("x.net", "", None) and got[2] == ("x.net", "/", "net/", "block")
    assert got[3] == ("b.example.com", "/de/x", "example.com/de/", "block") and got[4][:3] == ("b.example.com", "/fr", None)
    assert got[5] == ("o.org", "/fr/", "org/fr/", "allow")
    assert got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow") and got[8][:2] == ("", "")
    assert got[9][:2] == ("q", "") and got[10][2] is None and got[11] == ("example.com", "/de/", "example.com/de/", "block")


def test_links_carry_trust_and_distrust(spark):
    pages = [(1, "http://bad.net/", ""), (2, "http://farm.com/a", '<a href="http://bad.net/x">x</a> <a class=q href=//bad.net/y>'), (3, "http://good.org/fr/", '<a href="https://friend.com/">'), (4, "http://friend.com/", '<a href="/local">'), (5, "http://mixed.com/", '<A HREF=\'http://bad.net/\'><a href="http://friend.com/">')]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    own = url_filters.judged(df)
    edges = {(r.src, r.dst): r.links for r in url_filters.host_edges(df).collect()}
    assert edges == {("farm.com", "bad.net"): 2, ("good.org", "friend.com"): 1, ("mixed.com", "bad.net"): 1, ("mixed.com", "friend.com"): 1}
    seed = {h: (float(h == "good.org"), float(h == "bad.net")) for h in ("bad.net", "farm.com", "good.org", "friend.com", "mixed.com")}
    got = {r.host: (r.trust, r.distrust, r.verdict) for r in url_filters.host_verdicts(own, url_filters.host_edges(df)).collect()}
    want = plain_verdicts(seed, edges)
    assert got.keys() == want.keys() and all(got[h] == pytest.approx(want[h]) for h in want)
    assert got["farm.com"][2] == "block" and got["friend.com"][2] == "allow"


def plain_verdicts(seed, links):
    """host: (trust, distrust, verdict) by rounds of PageRank over all hosts, in plain loops."""
    hosts = {h for pair in links for h in pair} | set(seed)

    def received(start, out):
        got = dict.fromkeys(hosts, 0.0)
        for _ in range(url_filters.ROUNDS):
            after = dict.fromkeys(hosts, 0.0)
            for a, to in out.items():
                for b, n in to.items():
                    after[b] += url_filters.DAMPING * ((1 - url_filters.DAMPING) * start[a] + got[a]) * n / sum(to.values())
            got = after
        return got

    forth, back, found = {}, {}, {}
    for (a, b), n in links.items():
        forth.setdefault(a, {})[b] = n
        back.setdefault(b, {})[a] = n
    one = dict.fromkeys(hosts, 1.0)
    for k, out in ((0, forth), (1, back)):
        start = {h: seed.get(h, (0.0, 0.0))[k] for h in hosts}
        own, all_of = received(start, out), received(one, out)
        found[k] = {h: start[h] + (1 - start[h]) * (own[h] / all_of[h] if all_of[h] else 0.0) for h in hosts}
    return {h: (found[0][h], found[1][h], "block" if found[1][h] >= url_filters.BLOCK_AT - 1e-9 and found[1][h] > found[0][h] + 1e-9 else "allow") for h in hosts}


def test_link_farms_are_blocked_whatever_their_size(spark):
    def verdicts(n):
        to_bad = '<a href="http://bad.net/x">'
        rows = [("http://bad.net/", '<a href="http://big.com/">')] + [(f"http://farm{i}.com/", to_bad) for i in range(n)]
        rows += [("http://behind.com/", '<a href="http://farm0.com/">'), ("http://linked.com/", ""), ("http://apart.com/", '<a href="http://big.com/">')]
        rows += [("http://good.org/fr/", '<a href="http://vouched.com/">'), ("http://vouched.com/", to_bad), ("http://worse.net", ""), ("http://worse.net/", "")]
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
        return {r.host + r.path: r.verdict for r in url_filters.filter_urls(df).collect()}

    for n in (1, 10, 60):
        got = verdicts(n)
        assert [got[f"farm{i}.com/"] for i in range(n)] == ["block"] * n  # n hosts that link to one blocked host only
        assert got["worse.net/"] == "block"
        assert got["apart.com/"] == got["linked.com/"] == got["vouched.com/"] == got["good.org/fr/"] == "allow"


@pytest.mark.parametrize("seed_of", [12, 13])
def test_verdicts_of_a_random_graph(spark, seed_of):
    """Pages with absolute links: hubs, cycles, dead ends, rules; hosts and pages as by plain loops."""
    rng = random.Random(seed_of)
    hosts = [f"h{i}.com" for i in range(40)] + [f"b{i}.net" for i in range(24)] + [f"g{i}.org" for i in range(6)]
    pages, links, judged = [], Counter(), {}
    for h in hosts:
        for _ in range(rng.randint(1, 3)):
            to = [] if rng.random() < 0.2 else [rng.choice(hosts) if rng.random() < 0.7 else "h0.com" for _ in range(rng.randint(0, 6))]
            path = "/fr/" if rng.random() < 0.5 else "/"
            pages.append((len(pages), f"http://{h}{path}", "".join(f'<a href="https://{x}/y">' for x in to), "clashing"))
            links.update((h, x) for x in to if x != h)
            judged.setdefault(h, []).append("block" if h.endswith(".net") else "allow" if h.endswith(".org") and path == "/fr/" else None)
    df = spark.createDataFrame(pages, "page_id long, url string, html string, host string")
    seed = {h: (v.count("allow") / len(v), v.count("block") / len(v)) for h, v in judged.items()}
    want = plain_verdicts(seed, links)
    got = {r.host: (r.trust, r.distrust, r.verdict) for r in url_filters.host_verdicts(url_filters.judged(df), url_filters.host_edges(df)).collect()}
    assert got.keys() == want.keys()
    for h in want:
        assert got[h] == pytest.approx(want[h])
    verdicts = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.filter_urls(df).collect()}
    for i, url, _, _ in pages:
        h, path = url[7:].split("/", 1)
        rule = "net/" if h.endswith(".net") else "org/fr/" if h.endswith(".org") and path == "fr/" else None
        assert verdicts[i] == (h, "/" + path, rule, {"net/": "block", "org/fr/": "allow", None: want[h][2]}[rule])
    assert {v[3] for v in verdicts.values() if v[2] is None} == {"allow", "block"}


def test_urls_of_an_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filters.filter_urls(df).collect() == []


def brute_hits(docs, bench):
    import re

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    out = []
    for _, t in docs:
        w, hit, items = words(t), set(), set()
        for i, b in set(bench):
            v = words(b)
            n = min(13, len(v))
            windows = {tuple(v[s : s + n]) for s in range(len(v) - n + 1)} if n else set()
            for s in range(len(w) - n + 1):
                if n and tuple(w[s : s + n]) in windows and i is not None:
                    hit.update(range(s, s + n))
                    items.add(str(i))
        out.append((len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_decontamination(spark):
    rng = random.Random(4)
    common, rare = ["the", "of", "a"], [f"r{i}" for i in range(60)]
    bench = [(i, " ".join(rng.choice(common if rng.random() < 0.7 else rare) for _ in range(rng.choice([3, 13, 14, 40])))) for i in range(12)] + [(12, "the"), (13, None), (14, "  "), (None, "a of a"), (3, "zz yy"), (15, "Répété, répété; RÉpété")]
    docs = []
    for i in range(60):
        text = [rng.choice(common + rare) for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            b = (bench[rng.randrange(12)][1]).split()
            text[5:5] = b[rng.randint(0, 3) :]
        docs.append((i, ", ".join(text).upper() if i % 2 else " ".join(text)))
    docs += [(60, None), (61, ""), (5, docs[0][1]), (0, docs[0][1]), (None, docs[3][1])]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, n_hit int")
    bf = spark.createDataFrame([(*b, 1) for b in bench], "item_id long, text string, pos int")
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.judge(df, bf).collect())
    want = Counter((d[0], *b) for d, b in zip(docs, brute_hits(docs, bench)))
    assert got == want
    kept = decontaminate.keep_clean(df, bf)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(d[0] for d, b in zip(docs, brute_hits(docs, bench)) if not b[-1])
    assert decontaminate.judge(df.limit(0), bf).collect() == []
    assert all(r.n_hit == 0 for r in decontaminate.judge(df, bf.limit(0)).collect())


def test_proximity(spark):
    rng = random.Random(8)
    bench = [(i, " ".join(rng.choice("a b c d e f g h i j".split()) for _ in range(rng.choice([1, 2, 4])))) for i in range(12)] + [(12, "zz a"), (13, None), (14, "b b")]
    docs = [(i, " ".join(rng.choice("a b c d e f g h i j k l m n o p q r s t u".split()) for _ in range(rng.randint(0, 40)))) for i in range(40)] + [(40, None), (0, "a"), (41, "a " + "x " * 12 + "b"), (42, "a " + "x " * 13 + "b")]
    count = Counter(w for _, t in docs for w in (t or "").split())

    def near(text, most):
        w, n = (text or "").split(), 0
        for _, b in bench:
            pair = sorted({x for x in (b or "").split() if x in count}, key=lambda x: (count[x], x))[:2]
            places = [[p for p, x in enumerate(w) if x == y] for y in pair]
            n += len(pair) == 2 and any(abs(p - q) <= most for p in places[0] for q in places[1])
        return n

    df, bf = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    for most in (1, 13):
        got = Counter((r.doc_id, r.n_words, r.n_near) for r in decontaminate.judge(df, bf, near=most).collect())
        assert got == Counter((i, len((t or "").split()), near(t, most)) for i, t in docs)


@pytest.mark.parametrize("window", [1, 2, 5, 12, 20])
def test_decontamination_with_any_window(spark, window):
    rng = random.Random(window)
    bench = [(i, " ".join(rng.choice("a b c d e f".split()) for _ in range(rng.choice([2, 7, 20])))) for i in range(5)]
    docs = [(i, " ".join(rng.choice("a b c d e f x y".split()) for _ in range(rng.randint(0, 25)))) for i in range(25)] + [(25, bench[4][1])]

    def brute(text):
        w, hit = text.split(), set()
        for _, b in bench:
            v = b.split()
            n = min(window, len(v))
            windows = {tuple(v[s : s + n]) for s in range(len(v) - n + 1)}
            hit.update(p for s in range(len(w) - n + 1) if tuple(w[s : s + n]) in windows for p in range(s, s + n))
        return len(hit)

    got = decontaminate.judge(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), window=window)
    assert {r.doc_id: r.n_hit for r in got.collect()} == {i: brute(t) for i, t in docs}


def test_decontamination_with_a_smaller_window(spark):
    rng = random.Random(6)
    bench = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(20))) for i in range(8)]
    docs = []
    for i in range(40):
        words, at = bench[i % 8][1].split(), rng.randrange(13)
        # a passage of 8 words, or of 7; what follows in the item occurs in no document
        docs.append((i, " ".join(["x", *words[at : at + 8 - i % 2], "y"])))
    bench += [(8, "a b c d e f g h never1 never2 never3 never4 never5")]
    docs += [(40, "x a b c d e f g h y"), (41, "a b c d e f g"), (42, None)]

    def brute(text):
        w, hit = (text or "").split(), set()
        for _, b in bench:
            v = b.split()
            windows = {tuple(v[s : s + 8]) for s in range(len(v) - 7)}
            hit.update(p for s in range(len(w) - 7) if tuple(w[s : s + 8]) in windows for p in range(s, s + 8))
        return len(hit)

    df = spark.createDataFrame(docs, "doc_id long, text string")
    bf = spark.createDataFrame(bench, "item_id long, text string")
    got = {r.doc_id: r.n_hit for r in decontaminate.judge(df, bf, window=8).collect()}
    assert got == {i: brute(t) for i, t in docs} and got[40] == 8 and got[41] == 0
    assert {r.doc_id for r in decontaminate.keep_clean(df, bf, window=8).collect()} == {i for i, n in got.items() if not n}




def test_url_verdicts_are_those_of_sql(spark, tmp_path):
    """The SQL of the registered query over pages with absolute links."""
    import duckdb

    from regolith.llm import queries

    rng = random.Random(8)
    hosts = [f"h{i}.com" for i in range(30)] + [f"b{i}.net" for i in range(20)] + [f"g{i}.org" for i in range(6)] + ["example.com", "www.example.net"]
    pages = [(i, f"https://{rng.choice(hosts)}/{rng.choice(['fr/', 'de/', 'en/', ''])}?q", "".join(f"<a id=1 HREF='//{rng.choice(hosts)}/x'>\n" for _ in range(rng.randint(0, 4)))) for i in range(150)]
    pages += [(150, None, None), (151, "no host", '<a href="http://h0.com">')]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({queries.ORACLES['op9_url_filters']})").fetchall()
    got = [tuple(r) for r in queries.op9_url_filters(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    assert {v for _, h, _, r, v in want if not r and h} == {"allow", "block"}
