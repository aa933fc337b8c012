"""The operators for training text against brute force on small tables: nulls, empty and long texts, ties, repeated rows, clashing names."""

import base64
import gzip
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandloom.llm import ann, common, components, decontaminate, line_dedup, minhash, packing, quality, token_counts, token_store, url_filter, warc
from strandloom.llm.wordcache import WordCache

LONG = "wort " * 30_000
TEXTS = [None, "", "one", "Hello there, it's a test.", "Hello there, it's a test.", "été naïve\n\n  x12½ don't", "漢字 кириллица \x85 mixed", "a<|endoftext|>b <|startoftext|>", LONG, "x" * 70_000, "!!! ??\t\t\n"]


@pytest.fixture(scope="module")
def docs(spark):
    """Rows with clashing extra columns, a repeated id and a null one."""
    rows = [(k, t, "n", 1, True) for k, t in enumerate(TEXTS)] + [(3, TEXTS[3], "n", 1, True), (None, "no id here", "n", 1, True)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, start int, contaminated boolean").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def library(name):
    words = WordCache(name)
    return lambda t: words.library.encode(t or "", add_special_tokens=False).ids


# token counts, packing, token store


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_word_cache_is_the_library(name):
    words = WordCache(name)
    rng = random.Random(1)
    alphabet = "aAbBzZ éÉßñ 019'!?.,-|  \n\t½²ª" + "'s't're"
    texts = [t or "" for t in TEXTS] + ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(400)]
    for got, e in zip(words.encode(texts), words.library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got == np.array(e.ids, dtype="<u4").tobytes()


def test_word_cache_forgets(monkeypatch):
    words = WordCache("word_bpe_49k.json")
    for k in range(300):
        words.ids[f"q{k}"]
    import strandloom.llm.wordcache as module

    monkeypatch.setattr(module, "CACHE_WORDS", 10)
    assert words.encode(["alpha beta q1 q2 alpha " + " ".join(f"w{k}" for k in range(50))]) == [np.array(words.library.encode("alpha beta q1 q2 alpha " + " ".join(f"w{k}" for k in range(50)), add_special_tokens=False).ids, dtype="<u4").tobytes()]


def test_spliced_chunks():
    counter = token_counts.Counter("word_bpe_49k.json", 200, 16)
    rng = random.Random(2)
    for text in (" ".join(rng.choices(["Wort", "naïve", "it's", "12", "!!", "x" * 90, "\n\n"], k=400)), "x" * 900, "ab " * 300 + "y" * 700 + " z", " " * 500):
        assert token_counts.spliced_ids(text, counter.encoded, 200, 16).tolist() == library("word_bpe_49k.json")(text)


def test_counts(docs, none):
    want = library("word_bpe_49k.json")
    rows = token_counts.count_tokens(docs, limit=5).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = "no id here" if r.doc_id is None else TEXTS[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), len(want(text)), len(want(text)) > 5)
    assert token_counts.count_tokens(none).collect() == []
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, "piece_bpe_32k.model").collect()}[3] == len(model.encode(TEXTS[3]))


@pytest.mark.parametrize("limits", [{"max_tokens": 64, "max_segments": 3, "max_loss": 40}, {"max_tokens": 50}, {"max_tokens": 2048}])
def test_packing(docs, none, limits):
    want = library("word_bpe_49k.json")
    rows = packing.pack(docs.withColumn("prompt", F.lit(4)), prompt_col="prompt", with_ids=True, **limits).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for key, pieces in by_doc.items():
        text = "no id here" if key is None else TEXTS[key] or ""
        copies = 2 if key == 3 else 1
        ids = np.array([*want(text), 1], dtype="<u4").tobytes()
        assert sum(p.length for p in pieces) == copies * len(ids) // 4
        for p in pieces:
            assert bytes(p.ids) == ids[4 * p.start : 4 * (p.start + p.length)] and p.ids_crc32 == zlib.crc32(bytes(p.ids)) and p.doc_tokens == len(ids) // 4
            assert p.loss_tokens == max(0, p.start + p.length - max(p.start, 4))
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= limits["max_tokens"] and len(pieces) <= limits.get("max_segments", 256) and sum(p.loss_tokens for p in pieces) <= limits.get("max_loss", limits["max_tokens"])
        padding += 0 if at & (at - 1) == 0 else limits["max_tokens"] - at
    if "max_loss" not in limits:
        assert padding <= limits["max_tokens"]
    assert packing.pack(none).collect() == []


def test_token_store(docs, none, tmp_path):
    spark = docs.sparkSession
    token_store.write_tokens(docs, f"{tmp_path}/a", segment_ids=40_000)
    want, at = library("byte_bpe_50k.json"), 0
    rows = sorted(token_store.read_tokens(spark, f"{tmp_path}/a").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 0, 1, 2, 3, 3, *range(4, len(TEXTS))]
    for r in rows:
        ids = np.array([*want("no id here" if r.doc_id is None else TEXTS[r.doc_id]), 2], dtype="<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    token_store.write_tokens(none, f"{tmp_path}/b")
    assert token_store.read_tokens(spark, f"{tmp_path}/b").collect() == []


def test_segment_access():
    rng = np.random.default_rng(3)
    ids = np.concatenate([rng.integers(0, 300, 700), rng.integers(0, 2**31, 900)]).astype("<u4")
    s = token_store.Segment(token_store.segment(0, 0, [1, None], [700, 1600], ids))
    assert s.doc_ids == [1, None] and all(s[k] == ids[k] for k in range(0, 1600, 7))
    assert (s.ids(0, 1600) == ids).all() and (s.ids(513, 1499) == ids[513:1499]).all()
    raw = bytearray(token_store.segment(0, 0, [1], [3], ids[:3]))
    raw[60] ^= 1
    with pytest.raises(ValueError):
        token_store.Segment(bytes(raw))


# decontamination


def brute_hits(text, items, window):
    words = decontaminate.words_of(text)
    hit, found = set(), set()
    for i, t in items:
        w = decontaminate.words_of(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if n else ():
            for p in range(len(words) - n + 1):
                if words[p : p + n] == w[k : k + n]:
                    hit |= set(range(p, p + n))
                    found |= {str(i)} if i is not None else set()
    return len(words), len(hit), sorted(found)


def test_decontamination(spark, docs, none):
    rng = random.Random(4)
    vocabulary = ["alpha", "Beta", "gamma", "délta", "x1"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 5, 8])))) for k in range(12)] + [(None, "alpha alpha x1"), (99, None), (3, "Beta; beta")]
    texts = [" ".join(rng.choices(vocabulary + ["zz", "--", "q"], k=rng.randrange(40))) for _ in range(60)] + [None, ""]
    df = spark.createDataFrame([(k, t, "old") for k, t in enumerate(texts)], "doc_id long, text string, n_hit string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for shard in (1 << 20, 30):
        rows = decontaminate.find_benchmark(df, bench, window=4, one_in=3, shard_bytes=shard).collect()
        assert len(rows) == len(texts)
        for r in rows:
            n, hit, found = brute_hits(r.text, [x for x in items if x[1] is not None], 4)
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest())
            assert r.contaminated == (hit > 0 and 3 * hit >= n)
            assert sum(len(decontaminate.words_of(r.text[s.start : s.end])) for s in r.spans) == hit
    assert decontaminate.find_benchmark(df, bench.limit(0)).where("n_hit > 0 or contaminated").count() == 0
    assert decontaminate.clean_of_benchmark(docs, bench.limit(0)).columns == docs.columns
    assert decontaminate.find_benchmark(none, bench).collect() == []


def test_lines_as_numbers():
    rng = random.Random(4)
    alphabet = "aAbz 0 9\n\n-é漢İ\t\x7f\x85"
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(1, 90))) for _ in range(300)] + ["x" * 17 + " " + "y" * 300, "\n", " ", " ".join("q" * k for k in range(1, 40)), "a a b a\nb b"]
    got = line_dedup.normal_lines(texts)
    want = [(line_dedup.line_words(x), i, k) for i, t in enumerate(texts) for k, x in enumerate(t.split("\n")) if line_dedup.line_words(x)]
    assert got[0] == [b" ".join(w) for w, _, _ in want]
    assert list(zip(got[1].tolist(), got[2].tolist(), got[3].tolist(), strict=True)) == [(i, k, len(w)) for w, i, k in want]
    sizes, flat = got[4]
    assert sizes.tolist() == [len(set(w)) for w, _, _ in want]
    assert flat.tolist() == [h for w, _, _ in want for h in sorted(xxhash.xxh3_64_intdigest(x) for x in set(w))]
    assert len(line_dedup.normal_lines([" \n"])[0]) == 0 and line_dedup.normal_lines([])[0] == []
    for a, b in (("", ""), ("abc", "abd"), ("xbc", "abc"), ("aab", "aaab")):
        assert line_dedup.most_equal(min(len(a), len(b)), lambda i, j: a[i:j] == b[i:j]) == max(k for k in range(min(len(a), len(b)) + 1) if a[:k] == b[:k])


# quality


def test_quality(spark, docs, none):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 8)))
    good = [" ".join(word() for _ in range(60)) + "." for _ in range(150)]
    bad = [" ".join(word().upper() + "!!" for _ in range(60)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 150)) for k in range(210)] + [(0, None), (None, 1)], "doc_id long, quality int")
    model = quality.learn(df, labels)
    rows = quality.score(df, model).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {k for k in range(210) if zlib.crc32(str(k).encode()) % 5 == 0}
    assert np.mean([r.predicted == (r.doc_id < 150) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    again = quality.learn(df.repartition(3), labels)
    assert np.allclose(again.weights, model.weights)
    assert quality.score(docs, model).count() == docs.count() and quality.score(none, model).collect() == []
    assert {r.score for r in quality.score(docs, quality.learn(df, labels.where("quality = 1"))).collect()} == {0.5}
    assert quality.keep_good(docs, model).columns == docs.columns


def test_quality_learns_from_all(spark, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK", 50)
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 8)))
    # 7,500 plain better ones and 60 worse ones: a fit on the 6,000 of least hash missed some
    df = spark.createDataFrame([(k, " ".join(word().upper() + "!" if rng.random() < (0.5 if k % 126 == 0 else 0.2) else word() for _ in range(12))) for k in range(7560)], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, int(k % 126 != 0)) for k in range(7560)], "doc_id long, quality int")
    made = []
    monkeypatch.setattr(quality, "stored", lambda d, name, **how: made.append((name, common.stored(d, name, **how))) or made[-1][1])
    monkeypatch.setattr(quality, "discard", lambda d: None)
    model = quality.learn(df, labels)
    held = [k for k in range(7560) if zlib.crc32(str(k).encode()) % 5 == 0]
    table = dict(made)["learning"]
    assert table.where("not pair and good").count() == sum(k % 126 != 0 for k in range(7560)) - sum(k % 126 != 0 for k in held)
    assert table.where("pair").count() >= quality.PAIRS
    raw = np.array([r.raw for r in dict(made)["raw"].collect()])
    worse = sum(k % 126 == 0 for k in range(7560) if k not in set(held))
    assert model.threshold == pytest.approx(np.quantile(raw, worse / len(raw)))
    assert np.allclose(quality.learn(df.repartition(2), labels).weights, model.weights)
    d = quality.paired(np.arange(7.0)[:, None], 100 * np.arange(1, 4.0)[:, None], 2, [1, 2])
    assert len(d) == 14 and {round(float(x)) % 100 for x in d[:, 0]} == set(range(7)) and {-(round(float(x)) // 100) for x in d[:, 0]} == {1, 2, 3}


def test_quality_of_a_capped_sample(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 8)))
    loud = lambda p: " ".join(w.upper() + "!" if rng.random() < p else w for w in (word() for _ in range(60)))
    df = spark.createDataFrame([(k, loud(rng.uniform(0.1, 0.6) if k % 8 == 0 else rng.uniform(0, 0.5))) for k in range(800)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 8 != 0)) for k in range(1000)], "doc_id long, quality int")
    for most in (800, 80):
        model = quality.learn(df, labels, most_labels=most)
        rejected = np.mean([r.predicted == 0 for r in quality.score(df, model).collect() if not r.held_out])
        assert abs(rejected - 1 / 8) < 0.08  # the share of worse ones, whatever the sample
    values = np.array([3.0, 1.0, 2.0, 5.0])
    assert quality.weighted_quantile(values, np.ones(4), 0.4) == pytest.approx(np.quantile(values, 0.4))


# WARC


def test_warc_round_trip(spark, tmp_path):
    rows = [(4, "http://a/ b", "<p>é</p>"), (2, None, "<p>é</p>"), (7, "http://c", None), (1, "x", "solo"), (9, "y", ""), (None, "z", "solo"), (5, "w", "big" * 50_000), (1, "x", "solo")]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, payload_bytes string")
    warc.write_archives(pages, f"{tmp_path}/a", chunk_bytes=100)
    got = warc.read_archives(spark, f"{tmp_path}/a").collect()
    assert all(r.gap_reason is None for r in got)
    first = {"<p>é</p>": 2, "": 7, "solo": 1, "big" * 50_000: 5}
    seen = Counter()
    for r in got:
        text = next(t or "" for i, _, t in rows if i == r.id)
        assert r.payload_bytes == len(text.encode()) and r.payload_digest == base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()
        if r.record_type == "response":
            assert r.id == first[text] and r.refers_to is None and bytes(r.payload) == text.encode()
            seen[text] += 1
        else:
            assert r.refers_to == first[text] and r.payload is None
    assert len(got) == len(rows) and seen == Counter(dict.fromkeys(first, 1))
    warc.write_archives(pages, f"{tmp_path}/b", least=1)
    assert [r.id for r in warc.read_archives(spark, f"{tmp_path}/b").where("payload_bytes = 0 and record_type = 'response'").orderBy("id").collect()] == [7, 9]
    for part in (tmp_path / "a").glob("part-*"):
        gzip.decompress(part.read_bytes())
    shuffled = pages.select("page_id", "url", "html").repartition(3)
    assert common.settled(pages, "t") is pages and "Exchange" not in common.settled(shuffled, "t")._jdf.queryExecution().executedPlan().toString()
    warc.write_archives(shuffled.union(shuffled), f"{tmp_path}/d")
    kinds = Counter(r.payload_digest for r in warc.read_archives(spark, f"{tmp_path}/d").where("record_type = 'response'").collect())
    assert len(kinds) == len(first) and set(kinds.values()) == {1}
    warc.write_archives(pages.limit(0), f"{tmp_path}/c")
    assert warc.read_archives(spark, f"{tmp_path}/c").count() == 0


def test_salvage():
    records = [warc.record("response", f"{k}:0", "u", f"text {k} WARC/1.1 inside".encode() * 20, None) for k in range(6)]
    members = [gzip.compress(r, mtime=0) for r in records]
    ids = lambda data: [(f["headers"]["warc-record-id"], None) if f else (None, g) for f, g in warc.salvage(data)]
    urn = lambda k: (f"<urn:row:{k}:0>", None)
    assert ids(b"".join(members)) == [urn(k) for k in range(6)] == ids(b"".join(records))
    broken = bytearray(b"".join(members))
    at = len(members[0]) + len(members[1]) // 2
    broken[at] ^= 255
    got = ids(bytes(broken))
    assert [x for x in got if x[0]] == [urn(k) for k in (0, 2, 3, 4, 5)]
    gaps = [g for _, g in got if g]
    assert gaps[0][0] == len(members[0]) and gaps[-1][1] == len(members[0]) + len(members[1])
    plain = bytearray(b"".join(records))
    plain[len(records[0]) + 300] ^= 255
    got = ids(bytes(plain))
    assert [x for x in got if x[0]] == [urn(k) for k in (0, 2, 3, 4, 5)]
    got = ids(b"junk" * 50 + members[0] + members[1][:40] + b"".join(members[2:]))
    assert [x for x in got if x[0]] == [urn(k) for k in (0, 2, 3, 4, 5)] and got[0][1][:2] == (0, 200)
    assert [x for x in ids(b"".join(members)[:-9]) if x[0]] == [urn(k) for k in range(5)]
    assert ids(b"") == []


# URLs


def test_urls(spark):
    rng = random.Random(6)
    rules = [("block", "a.com", "/x/"), ("allow", "com", "/"), ("block", "b.a.com", "/x/y/"), ("allow", "net", "/p"), ("block", "q.net", "/")]
    hosts = ["a.com", "B.a.com", "ca.com", "net", "q.net", "z.q.net", "com", ""]
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice(hosts)}{rng.choice(['', '/', '/x/', '/x', '/x/y/z', '/p', '/X/', '?a=/x/', '#f', '/x/y/?q://no'])}" for _ in range(200)] + [None, "", "no scheme", "a://b://c/"]
    df = spark.createDataFrame([(k, u, "c") for k, u in enumerate(urls)], "page_id long, url string, verdict string")
    for r in url_filter.filter_urls(df, rules, "unknown").collect():
        u = urls[r.page_id]
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:end].lower(), rest[end:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        fits = [(len(h) + len(p), len(h), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "unknown"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best[2], best[3])
    assert {r.verdict for r in url_filter.filter_urls(df, [], "allow").collect()} == {"allow"}
    assert url_filter.filter_urls(df.limit(0), rules).collect() == []
    twice = url_filter.filter_urls(df.union(df), [*rules, *rules], "unknown")
    assert twice.count() == 2 * len(urls) and twice.distinct().count() == len(urls)


def test_urls_with_thousands_of_rules(spark):
    rng = random.Random(16)
    word = lambda: "".join(rng.choice("abcé\"\\.*") for _ in range(3))
    rules = [(rng.choice(["allow", "block"]), f"h{k % 700}.{rng.choice(['com', 'net'])}", f"/{word()}/") for k in range(30_000)]
    rules = list({(h, p): (a, h, p) for a, h, p in rules}.values())
    some = rng.sample(rules, 300)
    urls = [f"http://{rng.choice(['', 'www.', 'x'])}{h}{p}{rng.choice(['', 'q'])}" for _, h, p in some]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in url_filter.filter_urls(df, rules, "unknown").collect():
        fits = [(len(h) + len(p), len(h), h + p, a) for a, h, p in rules if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        best = max(fits, default=(0, 0, None, "unknown"))
        assert (r.rule, r.verdict) == (best[2], best[3])


# nearest neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(700, 8)).astype("f4")
    x[100:300] = x[100]  # copies
    rows = [(k, [float(v) for v in x[k]], "c") for k in range(700)]
    rows += [(900, None, "c"), (920, [0.0] * 8, "c"), (940, [float("nan")] + [1.0] * 7, "c"), (960, [1.0], "c"), (980, [None] + [1.0] * 7, "c"), (None, [1.0] * 8, "c"), (20, [9.0] * 8, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    least = lambda k: min([rows[k][1]] + ([[9.0] * 8] if k == 20 else []))
    full = np.array([least(k) for k in range(700)])
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 20, list_rows=64).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 700, 20))
    right = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21)) and q not in [v for _, v, _ in found]
        s = full @ full[q]
        assert np.allclose([b for _, _, b in found], s[[v for _, v, _ in found]])
        assert [(-b, v) for _, v, b in found] == sorted((-b, v) for _, v, b in found)
        s[q] = -np.inf
        right += len({v for _, v, _ in found} & set(np.lexsort([np.arange(700), -np.round(s, 9)])[:20].tolist()))
    assert right / (20 * len(got)) >= 0.9
    few = ann.nearest(df.where("vec_id < 5"), F.col("vec_id") % 20 == 0, 20).collect()
    assert len(few) == 4
    assert ann.nearest(df.limit(0), F.lit(True)).collect() == []


# near-duplicates and lines


def roots(pairs, n):
    of = list(range(n))

    def root(k):
        while of[k] != k:
            k = of[k]
        return k

    for a, b in pairs:
        a, b = root(a), root(b)
        of[max(a, b)] = min(a, b)
    return [root(k) for k in range(n)]


def test_components(spark):
    rng = random.Random(8)
    edges = [(k, k + 1) for k in range(60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(1000, k) for k in range(400, 460)] + [(7, 7)]
    want = roots(edges, 1001)
    for small in (0, 10**6):
        got = {r["id"]: r["class"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), small).collect()}
        assert got == {k: want[k] for k in {x for e in edges for x in e if e[0] != e[1]}}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_signatures_estimate():
    rng = random.Random(9)
    a = [f"w{rng.randrange(60)}".encode() for _ in range(400)]
    b = list(a)
    for _ in range(12):
        b[rng.randrange(400)] = b"other"
    doc, shingle, weight = minhash.weighted_shingles([a, b])
    sig = minhash.signatures(2, doc, shingle, weight, 4096)
    cut = np.searchsorted(doc, [0, 1, 2])
    one = lambda k: (shingle[cut[k] : cut[k + 1]], weight[cut[k] : cut[k + 1]])
    wanted, plain = minhash.similarities(one(0), one(1))
    assert abs((sig[0] == sig[1]).mean() - wanted) < 0.04
    x, y = (Counter(tuple(w[k : k + 5]) for k in range(396)) for w in (a, b))
    exact = sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in x | y) for d in x & y)
    assert wanted == pytest.approx(exact) and plain == pytest.approx(len(x & y) / len(x | y))


def near_copies(seed, count, size=90, spread=(0, 1, 2, 3, 5, 9)):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(200)}" for _ in range(size)]
    out = []
    for k in range(count):
        w = list(base)
        for _ in range(rng.choice(spread)):
            w[rng.randrange(size)] = f"y{rng.randrange(10**6)}"
        out.append(" ".join(w + (w[:15] * 3 if k % 5 == 0 else [])))
    return out


def test_document_classes(spark, none):
    rng = random.Random(10)
    texts = near_copies(1, 120) + near_copies(2, 40) + [" ".join(f"u{rng.randrange(5000)}" for _ in range(50)) for _ in range(40)] + ["one two", "ONE, two!", "", None, "...", "three four five"] * 2
    rows = [(k, t, "c") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows + [(None, texts[0], "c"), (5, texts[5], "c")], "doc_id long, text string, class_id string").repartition(3)
    words = [minhash.words_of(t) for t in texts]
    doc, shingle, weight = minhash.weighted_shingles(words)
    cut = np.searchsorted(doc, np.arange(len(words) + 1))
    one = lambda k: (shingle[cut[k] : cut[k + 1]], weight[cut[k] : cut[k + 1]])
    links = [(i, j) for i in range(len(texts)) for j in range(i) if words[i] and max(minhash.similarities(one(i), one(j))) >= 0.8]
    want = roots(links, len(texts))
    got = minhash.document_classes(df).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        assert r.class_id == (None if r.doc_id is None else want[r.doc_id])
    kept = minhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(set(want))
    assert minhash.document_classes(none).collect() == []


def test_edit_similarity():
    rng = random.Random(11)

    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return 1 - row[-1] / max(len(a), len(b), 1)

    for _ in range(300):
        a, b = ("".join(rng.choices("abcé", k=rng.randrange(14))) for _ in "xy")
        assert line_dedup.edit_similarity(a.encode(), b.encode()) == pytest.approx(slow(a, b) if a or b else 1.0)


def test_simhash():
    lines = [f"a b c d word{k} {k % 7} z".encode().split() for k in range(50)] + [b"w ".split() * 1, [b"x%d" % (k % 300) for k in range(700)]]
    got = line_dedup.simhashes(lines).tolist()
    for w, g in zip(lines, got, strict=True):
        hashes = [xxhash.xxh3_64_intdigest(x) for x in w]
        want = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))
        assert g % 2**64 == want


def test_pigeonhole():
    rng = random.Random(12)
    values = [rng.getrandbits(64) for _ in range(30)]
    for n in (10, 10**6, 10**9):
        b = line_dedup.MOST_BITS + 1
        while b < 12 and n > 4 * 2 ** (64 * (b - line_dedup.MOST_BITS) / b):
            b += 1
        edges = [64 * k // b for k in range(b + 1)]
        for v in values:
            w = v
            for k in rng.sample(range(64), line_dedup.MOST_BITS):
                w ^= 1 << k
            same = sum(v >> edges[k] & (1 << edges[k + 1] - edges[k]) - 1 == w >> edges[k] & (1 << edges[k + 1] - edges[k]) - 1 for k in range(b))
            assert same >= b - line_dedup.MOST_BITS


def test_lines_by_words(spark):
    rng = random.Random(31)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 9)))
    texts = []
    for n in [5, 7, 9, 10, 14, 19, 20, 30, 45, 90] * 3:
        w = [word() for _ in range(n)]
        texts.append(" ".join(w))
        w[rng.randrange(n)] = word()
        texts.append(" ".join(w))
    nodes = [line_dedup.normal_line(t) for t in texts]
    bits = [b % 2**64 for b in line_dedup.simhashes([set(n.split()) for n in nodes]).tolist()]
    links = [(i, j) for i in range(len(nodes)) for j in range(i) if line_dedup.edit_similarity(nodes[i], nodes[j]) >= 0.8]
    assert sum((bits[i] ^ bits[j]).bit_count() > line_dedup.MOST_BITS for i, j in links) > 10
    of = roots(links, len(nodes))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df, reach=line_dedup.REACH).collect()}
    stays = {min(k for k in range(len(nodes)) if of[k] == c) for c in set(of)}
    assert {k for k, t in got.items() if t} == stays


def test_word_blocks():
    rng = random.Random(32)
    for n in (5, 9, 12, 21, 60, 120):
        a = [b"w%d" % rng.randrange(10**6) for _ in range(n)]
        x, y, z = line_dedup.word_blocks([set(a), set([b"other", *a[1:]]), ()]).to_pylist()
        assert set(x) & set(y) and not len(z)


def test_lines(spark, none):
    rng = random.Random(13)
    base = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(3, 60))) for _ in range(60)]
    texts = []
    for _ in range(80):
        lines = []
        for _ in range(rng.randrange(6)):
            w = rng.choice(base).split()
            if rng.random() < 0.4:
                w[rng.randrange(len(w))] = f"q{rng.randrange(100)}"
            lines.append(rng.choice([" ".join(w), " ".join(w).upper() + "!", "", "***"]))
        texts.append("\n".join(lines))
    texts += [None, "", "\n\n", LONG]
    rows = [(k, t, "c") for k, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, (None, texts[0], "c")], "doc_id long, text string, n_fuzzy string").repartition(3)
    places = {}
    for k, t in enumerate(texts):
        for j, line in enumerate((t or "").split("\n")):
            if n := line_dedup.normal_line(line):
                places.setdefault(n, []).append((k, j))
    nodes = list(places)
    split = [list(dict.fromkeys(n.split())) for n in nodes]
    bits = [b % 2**64 for b in line_dedup.simhashes(split).tolist()]
    links = [(i, j) for i in range(len(nodes)) for j in range(i) if min(len(nodes[i].split()), len(nodes[j].split())) >= 5 and (bits[i] ^ bits[j]).bit_count() <= 3 and line_dedup.edit_similarity(nodes[i], nodes[j]) >= 0.8]
    assert links
    stays = {}
    of = roots(links, len(nodes))
    for k, n in enumerate(nodes):
        stays.setdefault(of[k], []).extend(places[n])
    stays = {min(v) for v in stays.values()}
    got = line_dedup.dedup_lines(df).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        if r.doc_id is None or not texts[r.doc_id]:
            assert r.text == texts[r.doc_id or 0]
            continue
        lines = texts[r.doc_id].split("\n")
        left = [x for j, x in enumerate(lines) if not line_dedup.normal_line(x) or (r.doc_id, j) in stays]
        assert r.text == "\n".join(left) and r.n_lines == len(lines) and r.n_exact + r.n_fuzzy == len(lines) - len(left)
    assert line_dedup.dedup_lines(none).collect() == []


# queries and the pipeline

FOLDER = "/root/testdata/sf0.001"


def test_oracles(spark):
    import os

    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables")
    from strandloom.llm.queries import ORACLE_SQL, QUERIES

    db = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        db.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        got = QUERIES[name](spark, FOLDER)
        found = db.execute(sql)
        columns = [d[0] for d in found.description]
        assert sorted(str([r[c] for c in columns]) for r in got.collect()) == sorted(str(list(r)) for r in found.fetchall())


def test_pipeline(spark):
    import os

    import corpus_pipeline

    if not os.path.isdir(FOLDER):
        pytest.skip("no tables")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == columns and out.schema == docs.schema
        ids, before = {r.doc_id for r in out.select("doc_id").collect()}, {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= before and len(ids) > len(before) // 2
        docs = spark.createDataFrame(out.collect(), docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert {r.doc_id for r in last.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_alike():
    rng = random.Random(41)
    for _ in range(400):
        a = [rng.choice(["alpha", "be", "cé", "delta漢", "x"]) for _ in range(rng.randrange(1, 14))]
        b = [rng.choice(["alphi", "q"]) if rng.random() < 0.2 else w for w in a][: rng.choice([99, 99, 8])]
        x, y = " ".join(a).encode(), " ".join(b).encode()
        for least in (0.6, 0.8, 0.95):
            assert line_dedup.alike(x, y, least) == (line_dedup.edit_similarity(x, y) >= least - 1e-9)


def test_buckets_in_any_batches():
    import pyarrow as pa

    rng = random.Random(42)
    rows = sorted((rng.randrange(25), k, rng.getrandbits(4)) for k in range(160))
    want = []
    for key in range(25):
        own = [r for r in rows if r[0] == key]
        want += [(key, i, own[0][1], (s ^ own[0][2]).bit_count() <= 1) for _, i, s in own[1:] if len(own) > 2 or (s ^ own[0][2]).bit_count() <= 1]
    for size in (1, 2, 3, 7, 160):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[k : k + size], strict=True)], ["key", "id", "simhash"]) for k in range(0, len(rows), size)]
        got = [tuple(r.values())[:4] for b in line_dedup.gathered(iter(batches), 1) for r in b.to_pylist()]
        assert sorted(got) == sorted(want)


def test_partners_of_large_groups():
    import pyarrow as pa

    rng = random.Random(43)
    for n in (5, 60, 300):
        rows = [(7, 0, k, rng.choice([1, 1, 1, 2, 3]), rng.getrandbits(9)) for k in range(n)]
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["key", "part", "id", "class", "simhash"])
        want = {a[2] for a in rows for b in rows if a[3] != b[3] and (a[4] ^ b[4]).bit_count() <= 1}
        assert {i for b in line_dedup.with_partners(iter([batch]), 1) for i in b.column(2).to_pylist()} == want


def test_lines_keep_the_columns_of_documents(spark):
    rows = [(1, "one line of five words\nanother line with some words", 7, "x"), (2, "one line of five words", 8, "y"), (3, None, 9, None), (4, "", 1, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, n_exact string")
    kept = line_dedup.drop_lines(df, reach=line_dedup.REACH)
    assert kept.schema == df.schema and sorted(tuple(r) for r in kept.collect()) == sorted(r for r in rows if r[0] != 2)
    found = line_dedup.dedup_lines(df)
    assert {r.doc_id: (r.n_lines, r.n_exact) for r in found.collect()} == {1: (2, 0), 2: (1, 1), 3: (0, 0), 4: (0, 0)}


def test_neighbours_read_a_minority_of_lists(spark):
    """Recall of 0.9 where each query reads less than a third of the lists, and fewer rows than there are."""
    rng = np.random.default_rng(19)
    x = (rng.normal(size=(60, 24))[rng.integers(0, 60, 6000)] + 0.45 * rng.normal(size=(6000, 24))).astype(np.float32)
    lifted = ann.lifted(x.astype(np.float64), float((x.astype(np.float64) ** 2).sum(1).max())).astype(np.float32)
    c = ann.centroids(lifted, 375)
    graph, q = ann.Graph(c), x[::20]
    size = np.bincount(ann.lists_of(lifted, c, 8, 1.15)[1], minlength=len(c))
    assert size.max() < 40 * size.mean() and (size > 0).mean() > 0.95
    read = [ann.probes(graph, np.append(v, 0).astype(np.float32), size, 192, 1.07, 8, 168) for v in q]
    assert np.mean([len(r) for r in read]) < len(c) / 3 and np.mean([size[r].sum() for r in read]) < len(x)
    found = [set(graph.search(np.append(v, 0).astype(np.float32), 32)[0].tolist()) for v in q]
    exact = [set(np.argsort(((c - np.append(v, 0)) ** 2).sum(1))[:32].tolist()) for v in q]
    assert np.mean([len(a & b) / 32 for a, b in zip(found, exact, strict=True)]) > 0.95
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    s = q.astype(np.float64) @ x.astype(np.float64).T
    s[np.arange(len(q)), 20 * np.arange(len(q))] = -np.inf
    best = np.argsort(-s, axis=1)[:, :20]
    assert np.mean([len(got[20 * k] & set(best[k].tolist())) / 20 for k in range(len(q))]) >= 0.9


def test_repeated_passages_are_candidates(spark):
    """Pairs that are alike by plain Jaccard alone: a page, and the page with a phrase repeated."""
    rng = random.Random(51)
    texts = []
    for _ in range(60):
        w = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        texts += [" ".join(w), " ".join([*w, *(w[:15] * 30)])]
    words = [minhash.words_of(t) for t in texts]
    doc, shingle, weight = minhash.weighted_shingles(words)
    cut = np.searchsorted(doc, np.arange(len(words) + 1))
    one = lambda k: (shingle[cut[k] : cut[k + 1]], weight[cut[k] : cut[k + 1]])
    both = [minhash.similarities(one(k), one(k + 1)) for k in range(0, len(texts), 2)]
    assert all(p < 0.5 and j > 0.8 for p, j in both)
    got = minhash.document_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {k: k - k % 2 for k in range(len(texts))}


def test_text_without_turns_is_encoded_once_more_at_most():
    counter = token_counts.Counter("word_bpe_49k.json", 2000, 64)
    rng = random.Random(52)
    han = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(12_000))
    code = "".join(rng.choices("abcdefXYZ0123456789+/", k=30_000))
    for text in (han, f"some words {han[:7000]} and more words " * 2, code, "word " * 900 + han[:3000] + " word" * 2000):
        encoded = []
        ids = token_counts.spliced_ids(text, lambda t: encoded.append(len(t)) or counter.encoded(t), 2000, 64)
        assert ids.tolist() == library("word_bpe_49k.json")(text)
        assert sum(encoded) < 3 * len(text) + 2000


def test_short_documents_are_packed_without_padding(spark):
    df = spark.createDataFrame([(k, "one two") for k in range(3000)], "doc_id long, text string").coalesce(1)
    rows = packing.pack(df).collect()
    size = Counter()
    for r in rows:
        size[r.sequence_id] += r.length
    assert sum(2048 - n for n in size.values() if n & (n - 1)) == 0


def test_clean_of_benchmark_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "one two three", 77, "x"), (2, "four five", 8, None), (3, None, 9, "z")], "doc_id long, text string, n_words int, spans string")
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    kept = decontaminate.clean_of_benchmark(df, bench)
    assert kept.schema == df.schema and sorted(tuple(r) for r in kept.collect()) == [(2, "four five", 8, None), (3, None, 9, "z")]


def test_groups_of_lines_in_any_batches():
    import pyarrow as pa

    rng = random.Random(61)
    base = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "rho", "tau"], k=12)).encode() for _ in range(8)]
    rows = []
    for k in range(120):
        w = rng.choice(base).split()
        w[rng.randrange(12)] = b"q%d" % rng.randrange(5)
        rows.append((rng.randrange(6), rng.randrange(2), k, k // 2, 0, b" ".join(w)))
    rows.sort()
    links = [(a[2], b[2]) for a in rows for b in rows if a[:2] == b[:2] and a[2] < b[2] and a[3] != b[3] and line_dedup.edit_similarity(a[5], b[5]) >= 0.8]
    same = [(2 * k, 2 * k + 1) for k in range(60)]
    kinds = [pa.int64()] * 5 + [pa.binary()]
    for size in (1, 5, 33, 120):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + size], strict=True), kinds, strict=True)], ["key", "part", "id", "class", "simhash", "line"]) for k in range(0, 120, size)]
        got = [tuple(r.values()) for b in line_dedup.connected(iter(batches), 0.8, 16) for r in b.to_pylist()]
        assert set(got) <= set(links) and roots(got + same, 120) == roots(links + same, 120)


def test_benchmark_is_found_by_one_worker_a_task(spark):
    df = spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "one two three"), (2, "four five")], "item_id long, text string")
    for shard in (1 << 20, 10):
        found = decontaminate.find_benchmark(df, bench, window=2, shard_bytes=shard)
        assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
        assert [(r.doc_id, r.n_hit) for r in found.orderBy("doc_id").collect()] == [(1, 3), (2, 0)]


def test_workers_drop_what_other_operators_left():
    def run(batches):
        yield len(common.process_cache("tables"))
        common.process_cache("tables")["x"] = 1

    assert list(common.tidy(run, "tables")([])) == [0] and list(common.tidy(run, "tables")([])) == [1]
    assert list(common.tidy(iter)([2])) == [2] and common.process_cache("tables") == {}


def test_stages_end_by_giving_memory_back(spark, docs, monkeypatch):
    used = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, run, schema, *a, f=type(docs).mapInArrow, **b: used.append(run.__qualname__) or f(df, run, schema, *a, **b))
    minhash.document_classes(docs)
    packing.pack(docs)
    decontaminate.find_benchmark(docs, spark.createDataFrame([(1, "one")], "item_id long, text string"))
    assert used and set(used) == {"tidy.<locals>.whole"}


def test_workers_get_batches_of_bounded_size(spark):
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["size"])

    df = spark.range(40).select("id", F.repeat(F.lit("x"), 1 << 20).alias("text")).coalesce(1)
    packing.pack(df, id_col="id")
    assert max(r.size for r in df.mapInArrow(sizes, "size long").collect()) < 2 * common.BATCH_BYTES
