"""Operators against brute force on small, awkward tables."""

import array
import collections
import hashlib
import math
import random
import re
import zlib
from itertools import combinations

import pytest

from tapestride.llm import decontaminate, exact_dedup, html_main, licences, lm_score, near_join, packing, repeats, toxicity, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DDL = "doc_id long, text string, n long, id string, digest string, class string, prefix string, shift int"


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, 1, "x", "y", None, "z", 3) for i, t in rows], DDL).repartition(3)


def words(n, seed, letters="abcdefgh"):
    r = random.Random(seed)
    return [r.choice(letters) + str(r.randrange(900)) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    base = words(120, 1)
    near = base[:60] + ["changed"] + base[61:]
    passage = words(50, 2)
    out = [(1, " ".join(base)), (2, "\n".join(base)), (3, " ".join(near)), (4, None), (5, ""), (6, "  \t\n"), (7, "one"), (8, "one two three")]
    out += [(10 + k, " ".join(words(40, 10 + k) + passage + words(30, 50 + k))) for k in range(6)]
    out += [(20, " ".join(words(30, 99) * 4)), (21, " ".join(words(5000, 77))), (22, " ".join(base)), (22, " ".join(base)), (None, " ".join(base)), (None, "null id")]
    return out


def brute_repeats(rows):
    every = [WORD.findall(t or "") for _, t in rows]
    count = collections.Counter(tuple(w[i : i + 35]) for w in every for i in range(len(w) - 34))
    out = []
    for (key, _), w in zip(rows, every):
        gone = {j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((key, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("hot", "batch"), [(512, 6_000_000), (1, 2000)])
def test_repeats(spark, rows, monkeypatch, hot, batch):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "BATCH_BYTES", batch)
    got = repeats.remove_repeats(frame(spark, rows))
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()), key=repr) == brute_repeats(rows)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got.collect())


def test_empty_tables(spark):
    empty = frame(spark, [(1, "x")]).where("false")
    assert repeats.remove_repeats(empty).count() == 0
    assert decontaminate.overlaps(empty, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
    assert packing.pack(empty, vocabulary()).count() == 0
    assert exact_dedup.exact_dedup(empty, empty).count() == 0
    assert lm_score.lm_score(empty).count() == 0
    assert licences.scan_licences(empty).count() == 0
    assert near_join.near_join(empty).count() == 0
    assert html_main.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    with pytest.raises(ValueError, match="no labelled rows"):
        toxicity.fitted(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int"))


def test_mask_is_lossless():
    for bad in combinations(range(decontaminate.WINDOW), decontaminate.SPARE):
        assert any(not {o + s for o in m} & set(bad) for m in decontaminate.MASKS for s in range(decontaminate.WINDOW - m[-1]))


def test_decontaminate(spark):
    item = words(30, 5)
    short = ["only", "four", "words", "here"]
    two_off = [w if k % 10 != 3 else "other" for k, w in enumerate(item)]
    half_off = [w if k % 3 else "other" for k, w in enumerate(item)]
    docs = [(1, " ".join(words(50, 1) + item + words(20, 2))), (2, " ".join(two_off)), (3, " ".join(half_off)), (4, " ".join(item[:10])), (5, " ".join(item[:13])), (6, "x only FOUR words, here!"), (7, "only four words there"), (8, None), (9, ""), (None, " ".join(item)), (1, "again")]
    items = spark.createDataFrame([(100, " ".join(item), 7), (101, " ".join(short), 7), (102, None, 7), (103, "", 7), (100, " ".join(item), 7)], "item_id long, text string, seed int")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(frame(spark, docs), items).collect()}
    assert got == {(1, 100), (2, 100), (5, 100), (6, 101), (None, 100)}
    assert {r.doc_id for r in decontaminate.clean(frame(spark, docs), items).collect()} == {3, 4, 7, 8, 9}


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_decontaminate_both_joins(spark, monkeypatch, broadcast):
    """Null and repeated ids, a very long text, a phrase that a text repeats, and no items; by broadcast and by shuffle."""
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", broadcast)
    item = words(30, 5)
    long = words(40_000, 3)
    docs = [(1, " ".join(long[:20_000] + item + long[20_000:])), (2, " ".join(item * 200)), (None, " ".join(item[:14])), (None, "clean text"), (3, "again"), (3, " ".join(item)), (4, None), (1, " ".join(long))]
    items = spark.createDataFrame([(100, " ".join(item)), (101, None)], "item_id long, text string")
    got = decontaminate.overlaps(frame(spark, docs), items).collect()
    assert sorted(((r.doc_id, r.item_id, r.words_equal, r.first_word) for r in got), key=repr) == sorted([(1, 100, 30, 20_000), (2, 100, 30, 0), (3, 100, 30, 0), (None, 100, 14, 0)], key=repr)
    assert decontaminate.overlaps(frame(spark, docs), items.where("false")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t &amp; t</title><script>var a="</p><article>";</script><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site</h1><nav><ul><li><a href=x>Home</a></li></ul></nav></header><div class="cookie-notice"><p>We use cookies. Long sentences of a notice are no content.</p></div>
<main><article><h1>The   title &amp; more</h1><p><b>First &quot;block&quot;<br>goes on.<br><p>Second block, with <a href=y>a link</a> in it.<div class=ad><p>Buy this now, please, it is good.</p></div>
<ul><li>One point made.<li>Another point made.</ul><!-- <p>hidden</p> --><form><p>Your name please.</p></form><section id="comments"><p>I, a reader, think that this is a long comment.</p></section></article></main>
<aside><p>Related: a long teaser of another article, with a full stop.</p></aside><footer>&copy; us</footer></body></html>"""


def test_html(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<div><p>A page without an article, only a long paragraph of text.</p></div>"), (5, "u", "<nav>menu</nav>"), (6, "u", "<article><p>cut &am"), (7, "u", "<article><p>a <b")]
    got = {r.page_id: r for r in html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars", "2 AS id")).collect()}
    assert got[1].text.split("\n\n") == ["The title & more", 'First "block" goes on.', "Second block, with a link in it.", "One point made.", "Another point made."]
    assert got[1].n_chars == len(got[1].text)
    assert [got[k].text for k in (2, 3, 5)] == ["", "", ""]
    assert got[4].text == "A page without an article, only a long paragraph of text."
    assert got[6].text == "cut &am"
    assert got[7].text.startswith("a")


def test_min_cut_is_least():
    r = random.Random(4)
    for _ in range(60):
        n = r.randrange(1, 8)
        source, sink = [r.random() * 3 for _ in range(n)], [r.random() * 3 for _ in range(n)]
        edges = [(a, b, r.random()) for a, b in combinations(range(n), 2) if r.random() < 0.5]
        cost = lambda side: sum(sink[k] if side[k] else source[k] for k in range(n)) + sum(x for a, b, x in edges if side[a] != side[b])  # noqa: E731, B023
        best = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert cost(html_main.min_cut(source, sink, edges)) == pytest.approx(best)


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("group", [4_000_000, 700])
def test_packing_round_trip(spark, rows, monkeypatch, group):
    """Null and repeated ids are documents of their own: pieces of one document share doc_tokens and follow on."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "GROUP_TOKENS", group)
    tokenizer = Tokenizer.from_file(vocabulary())
    docs = [*rows, (30, "don't İSTANBUL Σίσυφος naïve café 😀 x1y22 \x1c a\u00a0b\u2003c <|endoftext|> e\u0301"), (31, "…,,!!"), (32, None), (33, "it's 'quoted' 5's x.'s y'\u017fa")]
    pieces = packing.pack(frame(spark, docs), vocabulary(), with_ids=True).collect()
    want = collections.defaultdict(list)
    for k, t in docs:
        want[k].append((*tokenizer.encode(t or "", add_special_tokens=False).ids, 2))
    by = collections.defaultdict(list)
    for p in pieces:
        assert zlib.crc32(array.array("I", p.ids).tobytes()) == p.ids_crc32
        assert len(p.ids) == p.length
        by[p.doc_id].append(p)
    assert set(by) == set(want) and None in by
    for k, texts in want.items():
        assert sum(p.length for p in by[k]) == sum(map(len, texts))
        left = collections.Counter((p.start, tuple(p.ids), p.doc_tokens) for p in by[k])
        for ids in texts:  # each text is some chain of pieces
            at = 0
            while at < len(ids):
                piece = next(p for p in left if left[p] and p[0] == at and p[2] == len(ids) and ids[at : at + len(p[1])] == p[1])
                left[piece] -= 1
                at += len(piece[1])
        assert not +left
    sequences = collections.defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
    for s in sequences.values():
        s.sort(key=lambda p: p.offset)
        total = sum(p.length for p in s)
        assert [p.offset for p in s] == [sum(q.length for q in s[:j]) for j in range(len(s))]
        assert total <= 4096 and total & (total - 1) == 0


def test_ids_are_the_tokenizers():
    import pyarrow as pa
    from tokenizers import Tokenizer

    r, tokenizer, bpe = random.Random(6), Tokenizer.from_file(vocabulary()), packing.WordBpe(vocabulary())
    letters = " \t\n\x0b\x0c\r\x1c\x85\u00a0\u2003aAbBdSst1'\u017fé\u0301İΣ😀<|>,.!’—€"
    texts = ["".join(r.choices(letters, k=r.randrange(40))) for _ in range(4000)] + ["word " * 50_000, ""]
    for _ in range(2):  # the second time from the caches
        for text, ids in zip(texts, bpe.ids(pa.array(texts))):
            assert array.array("I", ids).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_packing_groups():
    r = random.Random(1)
    lengths = [r.choice([1, 3, 500, 600, 1500, 3000, 4096, 9000]) for _ in range(300)]
    seqs, left = packing.pack_group(lengths[:200], last=False)
    assert sum(p[2] for p in left) < 4096
    stay = sorted({d for d, _, _ in left})
    more, none = packing.pack_group([lengths[d] for d in stay] + lengths[200:], carried=[(stay.index(d), a, n) for d, a, n in left])
    of = [*stay, *range(200, 300)]
    seqs += [[(of[d], a, n) for d, a, n in s] for s in more]
    assert none == []
    parts = collections.defaultdict(list)
    for s in seqs:
        assert sum(p[2] for p in s) & (sum(p[2] for p in s) - 1) == 0
        for d, a, n in s:
            parts[d].append((a, n))
    for d, n in enumerate(lengths):
        assert sum(x for _, x in parts[d]) == n
        at = 0
        for a, x in sorted(parts[d]):
            assert a == at
            at += x
    assert len(packing.steps(seqs)) == len(seqs)


def test_toxicity_learns(spark):
    r = random.Random(3)
    plain = [f"w{r.randrange(3000)}x" for _ in range(3000)]
    docs, labels = [], []
    for k in range(1200):
        bad = k % 5 == 0
        text = r.choices(plain, k=60) + ([r.choice(["idiot", "scum", "lowei" + r.choice("abcdefgh")]) for _ in range(3)] if bad else [])
        r.shuffle(text)
        docs.append((k, " ".join(text).replace("x", "q").translate(str.maketrans("0123456789", "abcdefghij"))))
        if k < 800:
            labels.append((k, 1, int(bad)))
    docs += [(5000, None), (5001, "")]
    chain = toxicity.fitted(frame(spark, docs), spark.createDataFrame([*labels, (3, None, None), (9999, 1, 1)], "doc_id long, quality int, toxic int"))
    out = {x.doc_id: x for x in toxicity.toxicity(frame(spark, docs), chain).collect()}
    assert sum(out[k].is_toxic == (k % 5 == 0) for k in range(800, 1200)) >= 396
    kept = {x.doc_id for x in toxicity.drop_flagged(frame(spark, docs), chain).collect()}
    assert kept == {k for k, x in out.items() if not x.is_toxic}
    assert {5000, 5001} <= kept
    assert chain.names == ["low_quality", "toxic"]


def test_toxicity_of_odd_rows(spark):
    """Null and repeated ids, null labels and empty texts: every row is scored by its own text, as the model's sums say."""
    r = random.Random(9)
    docs, labels = [], []
    for k in range(200):
        bad = k % 4 == 0
        docs.append((k, " ".join([f"word{'abcdefghij'[r.randrange(10)]}{'klmnop'[r.randrange(6)]}" for _ in range(30)] + ["scum"] * bad)))
        labels.append((k, 1, int(bad)))
    docs += [(None, "you scum"), (None, "kind words"), (0, "kind words"), (8, "a scum text"), (900, None), (901, "")] + [(4, "zz repeated " * 3)] * 50
    labels += [(None, 1, 1), (6, None, None), (4, 0, 0)]
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = toxicity.fitted(frame(spark, docs), y)
    scorer = toxicity.Scorer(chain)
    got = toxicity.toxicity(frame(spark, docs), chain).collect()
    assert len(got) == len(docs)

    def brute(text):  # each model's sum over the text's distinct features, earlier log-odds fed forward
        present = {f for w in toxicity.LETTERS.findall((text or "").lower()) for f in toxicity.features(w)}
        odds = []
        for m in chain.models:
            z = m.bias + sum(w for f, w in m.weights.items() if f in present) + sum(c * o for c, o in zip(m.chain, odds))
            odds.append(max(-15.0, min(15.0, z)))
        return [1 / (1 + math.exp(-z)) for z in odds]

    want = sorted(((k, *brute(t)) for k, t in docs), key=repr)
    assert [x[0] for x in sorted(((x.doc_id, x.low_quality, x.toxic) for x in got), key=repr)] == [w[0] for w in want]
    by = collections.defaultdict(list)
    for x in got:
        by[x.doc_id].append((x.low_quality, x.toxic, x.is_toxic))
    for k, own in by.items():
        assert sorted(x[:2] for x in own) == [pytest.approx(w) for w in sorted(tuple(brute(t)) for i, t in docs if i == k)]
        assert all(f == (p > chain.thresholds[1]) for _, p, f in own)
    assert scorer.score("you scum") == pytest.approx(brute("you scum"))
    assert {x.doc_id for x in got if x.is_toxic} >= {None, 8, 12}
    again = toxicity.labelled(frame(spark, docs), y, toxicity.CATEGORIES, "doc_id", "text", 60)
    assert len(again.models) == 2  # a bounded sample, whatever an id's number of documents


def test_binary_fuse():
    import numpy as np

    r = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 100, 20_000):
        keys = r.integers(-(2**63), 2**63 - 1, n)
        f = exact_dedup.BinaryFuse.build(np.concatenate([keys, keys]))
        assert f.may_contain(keys).all()
        assert f.may_contain(r.integers(-(2**63), 2**63 - 1, 20_000)).mean() < 0.012
        if n > 1000:
            assert len(f.prints) < 1.3 * n


def brute_dedup(rows):
    """(id, keep_id, group_size, kept, digest) of each row; of rows equal in all any one is kept."""
    bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = collections.defaultdict(list)
    for k, t in rows:
        groups[bare(t)].append((-len(t or ""), k is None, k))
    out = []
    for text, own in groups.items():
        own.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(k, own[0][2], len(own), at == 0, hashlib.sha256(text.encode()).hexdigest()) for at, (_, _, k) in enumerate(own)]
    return sorted(out, key=repr)


def dedup_rows(rows):
    a, b, c = rows[0][1], "other text", "third text"
    return [*rows, (1, b), (1, b), (2, b + " "), (None, c), (None, c), (None, c + "\n"), (7, "one"), (9, a), (9, a), (None, None), (3, a)]


def test_exact_dedup(spark, rows):
    rows = dedup_rows(rows)
    got = exact_dedup.exact_dedup(*exact_dedup.halves(frame(spark, rows))).collect()
    assert sorted(((x.doc_id, x.keep_id, x.group_size, x.kept, x.text_sha256) for x in got), key=repr) == brute_dedup(rows)
    kept = [(x.doc_id, re.sub(r"\s", "", x.text or "")) for x in exact_dedup.drop_copies(frame(spark, rows)).collect()]
    assert sorted((k, hashlib.sha256(t.encode()).hexdigest()) for k, t in kept if k is not None) == sorted((w[0], w[4]) for w in brute_dedup(rows) if w[3] and w[0] is not None)
    assert len({t for _, t in kept}) == len(kept) == sum(w[3] for w in brute_dedup(rows))


def test_snapshot_index_serves_batches(spark, rows, tmp_path):
    """A stored index; a batch far larger than the snapshot, and one far smaller; sides chosen by position, not by id."""
    rows = dedup_rows(rows)
    old, new = rows[:12], rows[12:] + [(5000 + k, f"text {k}") for k in range(50)]
    exact_dedup.index_snapshot(frame(spark, old)).save(str(tmp_path))
    index = exact_dedup.Index.load(frame(spark, old), str(tmp_path))
    for batch in (new, new[:1], []):
        df = frame(spark, batch) if batch else frame(spark, new).where("false")
        got = exact_dedup.exact_dedup(df, index).collect()
        assert sorted(((x.doc_id, x.keep_id, x.group_size, x.kept, x.text_sha256) for x in got), key=repr) == brute_dedup(old + batch)
        assert sum(x.in_snapshot for x in got) == len(old)


def test_screen_lets_all_true_ones_through(spark):
    digest = lambda a, b: spark.range(a, b).selectExpr("unhex(sha2(cast(id as string), 256)) AS digest")
    filters = exact_dedup.build_filters(digest(0, 300), 2)
    for parts in (1, 4):
        through = {bytes(r[0]) for r in exact_dedup.screen(digest(200, 3000), filters, 2, parts).collect()}
        true = {hashlib.sha256(str(k).encode()).digest() for k in range(200, 300)}
        assert true <= through and len(through) < 200


def test_byte_check_keeps_sides_apart(spark, monkeypatch):
    """With a digest that all texts share, sides whose texts differ aren't merged."""
    monkeypatch.setattr(exact_dedup, "digest_of", lambda text: exact_dedup.F.unhex(exact_dedup.F.sha2(exact_dedup.F.lit("same"), 256)))
    got = exact_dedup.exact_dedup(frame(spark, [(1, "a")]), frame(spark, [(2, "b")])).collect()
    assert all(x.kept and x.group_size == 1 for x in got)


def test_urls(spark):
    urls = ["https://a.example.org/es/x?q#f", "http://example.org/en/12", "http://example.org/en/2", "HTTP://A.COM/fr/", "x://b.com/de/z", "http://org", "http://example.org.net/es/", "http://notexample.org/es/", "no scheme", "", None, "http://com/de/", "http://u@h.COM:80/de/", "a://b://c.org/"]
    got = [x[1:] for x in sorted(url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect())]

    def judge(url):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.split(r"[/?#]", rest)[0]
            path = re.split(r"[?#]", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")

    assert [tuple(g) for g in got] == [judge(u) for u in urls]


def test_urls_in_parts_and_odd_rows(spark, monkeypatch):
    """Several arrays judge like one; repeated rows, null ids and columns with the output's names."""
    r = random.Random(3)
    rules = [(r.choice(["allow", "block"]), ".".join(r.choices("abc", k=r.randrange(1, 4))), "/" + "/".join(r.choices("xy", k=r.randrange(3)))) for _ in range(60)] + [("block", "a.B", "/")]
    urls = [(r.choice([None, k // 2]), f"http://{'.'.join(r.choices('abc', k=r.randrange(1, 5)))}/{'/'.join(r.choices('xyz', k=r.randrange(4)))}", "h", "v") for k in range(200)]
    pages = spark.createDataFrame(urls, "page_id long, url string, host string, verdict string")
    want = sorted(map(tuple, url_filter.filter_urls(pages, rules).collect()), key=repr)
    assert len(want) == 200 and len({w[3] for w in want}) > 10
    monkeypatch.setattr(url_filter, "MAX_RULES", 7)
    assert sorted(map(tuple, url_filter.filter_urls(pages, rules).collect()), key=repr) == want


def test_url_collisions(tmp_path, monkeypatch):
    import xxhash

    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda s: 7)
    (tmp_path / "f").write_bytes(url_filter.build([("block", "a.org", "/x"), ("allow", "b.org", "/")]))
    index = url_filter.DigestArray(str(tmp_path / "f"))
    assert index.judge(["a.org", "z.b.org", "c.org"], ["/x1", "/", "/x"]) == (["a.org/x", "b.org/", None], ["block", "allow", "allow"])
    (tmp_path / "g").write_bytes(url_filter.build([]))
    assert url_filter.DigestArray(str(tmp_path / "g")).judge(["a"], ["/"]) == ([None], ["allow"])


def test_lm_score(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BATCH_TOKENS", 300)
    r = random.Random(8)
    rows = [(k, " ".join(f"{a}{r.randrange(9)}" for a in r.choices("TheQuick", k=r.randrange(60)))) for k in range(120)] + [(500, None), (501, ""), (502, "zzz new"), (None, "T1")]
    got = lm_score.lm_score(frame(spark, rows)).collect()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {k: [*WORD.findall((t or "").translate(low)), None] for k, t in rows}
    held = {k: zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2 for k, _ in rows}
    c, pair = collections.Counter(), collections.Counter()
    for k, x in tokens.items():
        if not held[k]:
            c.update(x)
            pair.update(zip([None, *x], x))
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows)
    for x in got:
        t = tokens[x.doc_id]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held[x.doc_id], len(t), sum(c[w] > 0 for w in t), n)
        assert x.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
    # the whole model again, token by token: held-out EM, then every score
    import numpy as np

    held_tokens = [(p, w) for k, x in tokens.items() if not held[k] for p, w in zip([None, *x], x)]
    before = np.array([c[p] - 1 for p, _ in held_tokens])
    of = np.array([0 if x <= 0 else 1 + math.ceil(math.log2(x)) for x in before])
    p = np.array([[(pair[e] - 1) / x if x > 0 else 0.0, (c[e[1]] - 1) / (n - 1), 1 / (v + 1)] for e, x in zip(held_tokens, before)])
    mix = {b: np.array([0.0, 0.5, 0.5] if b == 0 else [1 / 3] * 3) for b in range(lm_score.BUCKETS)}
    for b in set(of.tolist()):
        for _ in range(lm_score.EM_ROUNDS):
            share = mix[b] * p[of == b]
            mix[b] = (share / share.sum(axis=1, keepdims=True)).mean(axis=0)
    worst = 0.0
    for x in got:
        t, want = tokens[x.doc_id], 0.0
        for prev, w in zip([None, *t], t):
            m = mix[int(lm_score.bucket(np.array([c[prev]]))[0])]
            want += math.log10(m[0] * pair[prev, w] / max(c[prev], 1) + m[1] * c[w] / n + m[2] / (v + 1))
        worst = max(worst, abs(x.score / want - 1))
    assert worst < 0.005, worst


def test_probabilities_sum_to_one():
    """Over all words of the vocabulary and the unknown one, for a seen context and weights of any bucket."""
    import numpy as np

    counts, after = np.array([5, 3, 2]), np.array([2, 1, 1])  # three words; what followed a context seen 4 times
    n, v = int(counts.sum()), len(counts)
    weights = lm_score.learned([(((3 * 2) * 512 + 4 + 256) * 512 - 6 + 256, 10), (((3 * 2) * 512 - 3 + 256) * 512 - 2 + 256, 7)])
    assert (weights[3] > 0).all()
    p = lm_score.probability(np.append(counts, 0), np.full(4, 4), np.append(after, 0), n, v, weights)
    assert p.sum() == pytest.approx(1.0)


def test_em_prefers_what_predicts():
    # bigram estimates 4 times the unigram's in bucket 3, 16 times worse in bucket 4
    up, down = 2 * lm_score.STEP, -4 * lm_score.STEP
    code = lambda b, q2: ((b * 2) * 512 + q2 + 256) * 512 - 30 + 256
    w = lm_score.learned([(code(3, up), 100), (code(4, down), 100)])
    assert w[3][0] > 0.9 and w[4][0] < 0.1
    assert w.sum(axis=1) == pytest.approx([1.0] * len(w))


def test_licences(spark):
    mit = "Copyright (c) 2020 X. All rights reserved.\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software\nwithout restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    rows = [(1, "Some text here\nReleased under the MIT License.\nmore"), (2, "x. Licensed under the Apache License, Version 2.0. y"), (3, mit), (4, None), (5, ""), (6, "We discuss the MIT License."), (7, "All rights reserved. " * 2), (8, "licensed under\nCC BY-NC 4.0")]
    got = sorted((x.doc_id, x.license, len(x.sentence_ids)) for x in licences.scan_licences(frame(spark, rows)).collect())
    reserved = "LicenseRef-AllRightsReserved"
    assert got == [(1, "MIT", 1), (2, "Apache-2.0", 1), (3, reserved, 1), (3, "MIT", 2), (7, reserved, 1), (7, reserved, 1), (8, "CC-BY-NC-4.0", 1)]
    one = next(x for x in licences.scan_licences(frame(spark, rows)).collect() if x.doc_id == 1)
    assert rows[0][1][one.first_char : one.end_char] == "Released under the MIT License"


def test_licence_notices(spark):
    """Common phrasings, SPDX lines, whole texts; and sentences that only speak of licences."""
    bsd = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
           "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n3. Neither the name of The Example Project nor the names of its contributors may be used to endorse or promote products\nderived from this software without specific prior written permission.")  # fmt: skip
    texts = {
        "// SPDX-License-Identifier: MIT": ["MIT"], "# SPDX-License-Identifier: (GPL-2.0+ OR Apache-2.0)\ncode": ["GPL-2.0-or-later", "Apache-2.0"], "SPDX-License-Identifier: Unknown-1.0": [],
        "This project is licensed under the MIT License - see the LICENSE file.": ["MIT"], "This project is licensed under the MIT License - see the [LICENSE.md](LICENSE.md) file for details": ["MIT"],
        "The MIT License (MIT)\n\nCopyright (c) 2020 Someone": ["MIT"], "Licensed under the BSD 3-Clause License.": ["BSD-3-Clause"], "Licensed under CC BY 4.0 International.": ["CC-BY-4.0"],
        "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.": ["CC-BY-SA-3.0"], "The code is distributed under the terms of the GNU LGPL v2.1 or later.": ["LGPL-2.1-or-later"], "Released under the GNU AGPLv3.": ["AGPL-3.0-only"], "Data is made available under CC0 1.0 Universal": ["CC0-1.0"],
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.": ["LGPL-2.1-or-later"],
        bsd: ["BSD-3-Clause"], "To the extent possible under law, Jane Q. Doe has waived all copyright and related or neighboring rights to this work.": ["CC0-1.0"],
        "Everyone talks under the MIT License umbrella.": [], "It is not licensed under any terms.": [], "The licence was discussed under the GPL heading.": [], "mit": [],
    }
    rows = list(enumerate(texts)) + [(None, "Licensed under the MIT License."), (500, "x " * 300_000 + ". Licensed under the ISC license.")]
    got = collections.defaultdict(list)
    for x in licences.scan_licences(frame(spark, rows)).orderBy("first_char").collect():
        got[x.doc_id].append(x.license)
        text = next(t for k, t in rows if k == x.doc_id)
        assert 0 <= x.first_char < x.end_char <= len(text)
    assert {k: sorted(got[k]) for k, _ in enumerate(texts)} == {k: sorted(w) for k, w in enumerate(texts.values())}
    assert got[None] == ["MIT"] and got[500] == ["ISC"]


def test_licences_against_brute_force():
    """Random texts of known and unknown sentences: every run of fragments is compared with every sentence, every rule tried at every place."""
    r, scanner = random.Random(12), licences.Scanner()
    norm = lambda t: tuple(re.findall("[a-z0-9]+", t.lower()))
    fixed = {tuple(s.split()): n for n, s in licences.SENTENCES.items() if "*" not in s}
    pieces = [" ".join(w) for w in fixed]
    rules = sorted(licences.RULES, key=lambda x: -len(x[1]))
    for _ in range(150):
        parts = []
        if r.random() < 0.7:
            licence_rule = r.choice(licences.RULES)[1]
            for name in licence_rule:
                parts += [licences.SENTENCES[name].replace("*", "Some Holder")] + ["noise number %d here" % r.randrange(9)] * r.randrange(4)
        parts += [r.choice([r.choice(pieces), "plain talk of %d things" % r.randrange(99)]) for _ in range(r.randrange(5))]
        text = "".join(p.capitalize() + r.choice([". ", ".\n", "\n", "; "]) for p in parts)
        fragments = [norm(text[m.start() : m.end()]) for m in licences.FRAGMENT.finditer(text)]
        ids, k = [], 0
        while k < len(fragments):
            ends = [j for j in range(k, len(fragments)) if tuple(w for f in fragments[k : j + 1] for w in f) in fixed]
            varied = [(j, n) for j in range(k, min(k + 16, len(fragments))) for n, s in licences.SENTENCES.items() if "*" in s and re.fullmatch(s.replace("*", r"\w+(?: \w+){0,7}"), " ".join(w for f in fragments[k : j + 1] for w in f))]
            if ends:
                ids.append(fixed[tuple(w for f in fragments[k : ends[-1] + 1] for w in f)])
                k = ends[-1] + 1
            elif varied:
                ids.append(varied[-1][1])
                k = varied[-1][0] + 1
            else:
                ids.append(None)
                k += 1
        want, known, at = [], [(p, i) for p, i in enumerate(ids) if i], 0
        while at < len(known):
            hit = next((rule for rule in rules if tuple(i for _, i in known[at : at + len(rule[1])]) == rule[1] and all(b[0] - a[0] <= 3 for a, b in zip(known[at:], known[at + 1 : at + len(rule[1])]))), None)
            want += [(hit[0], list(hit[1]))] if hit else []
            at += len(hit[1]) if hit else 1
        assert [(x[0], x[1]) for x in scanner.scan(text)] == want, text


@pytest.mark.parametrize("block", [512, 7])
def test_near_join(spark, monkeypatch, block):
    monkeypatch.setattr(near_join, "BLOCK", block)
    r = random.Random(5)
    rows, base = [], words(150, 3)
    for k in range(60):  # chains of edits: links between neighbours, one group
        rows.append((k, " ".join(base)))
        for _ in range(r.randrange(3)):
            base[r.randrange(len(base))] = f"n{r.randrange(10**6)}"
    rows += [(100 + k, " ".join(words(80, 1000 + k))) for k in range(20)] + [(200, rows[0][1]), (201, None), (202, ""), (203, "a b"), (204, "a b"), (205, "a b c d e f")]
    got = {x.doc_id: x for x in near_join.near_join(frame(spark, rows)).collect()}

    def grams(t):
        w = WORD.findall(t or "")
        k = min(5, len(w))
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()

    sets = {k: grams(t) for k, t in rows}
    links, parent = collections.Counter(), {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        if sets[a] == sets[b] or (sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
            links[a] += 1
            links[b] += 1
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert {k: got[k].n_links for k in sets} == {k: links[k] for k in sets}
    assert {k: got[k].group_id for k in sets} == {k: root(k) for k in sets}
    assert {x.doc_id for x in near_join.one_of_each_group(frame(spark, rows)).collect()} == {root(k) for k in sets}


def test_depth_follows_the_recall():
    floor = near_join.shortest_prefix()
    assert near_join.found(0.8, floor) >= near_join.RECALL > near_join.found(0.8, floor + 1)
    with pytest.raises(ValueError, match="more trees"):
        near_join.shortest_prefix(trees=1)
    equal = lambda s: round((s * 0.75 + 0.25) * near_join.PERMUTATIONS)
    assert near_join.next_depth({}, 8) == floor  # nothing found says nothing
    assert near_join.next_depth({equal(0.5): 100}, 8) == floor  # nothing near the threshold either
    assert near_join.next_depth({equal(1.0): 100}, 8) == 8  # all found at full depth
    assert near_join.next_depth({equal(0.8): 100}, 8) == floor
    depths = [near_join.next_depth({equal(s): 100}, 8) for s in (0.8, 0.85, 0.9, 0.95, 1.0)]
    assert depths == sorted(depths) and len(set(depths)) > 2
    mixed = {equal(0.9): 100_000, equal(0.8): 1}
    assert near_join.next_depth(mixed, 8) == near_join.next_depth({equal(0.9): 100}, 8)


def test_trie_keys_sort_by_prefix():
    import numpy as np

    a = np.arange(near_join.PERMUTATIONS, dtype=np.uint32) * 77_777
    b = a.copy()
    places = near_join.layout()
    b[places[3, 5]] += 1  # differs from level 6 on in the fourth tree
    (a1, a2), (b1, b2) = near_join.trie_keys(a, places), near_join.trie_keys(b, places)
    assert a1[3] == b1[3] and a2[3] != b2[3]
    assert a2[3] >> np.uint64(14 * 3) == b2[3] >> np.uint64(14 * 3) and a2[3] >> np.uint64(14 * 2) != b2[3] >> np.uint64(14 * 2)
    assert (a1 >> np.uint64(56) == np.arange(near_join.TREES)).all()


def brute_links(rows):
    def grams(t):
        w = WORD.findall(t or "")
        k = min(5, len(w))
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()

    sets = [grams(t) for _, t in rows]
    links = [0] * len(rows)
    for a, b in combinations(range(len(rows)), 2):
        if sets[a] == sets[b] or (sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
            links[a] += 1
            links[b] += 1
    return links


def test_near_join_odd_rows(spark):
    """Null and repeated ids, a very long text beside its near copy."""
    long = words(30_000, 8)
    near = [*long[:500], "other", *long[501:]]
    a, b = words(100, 1), words(100, 2)
    rows = [(None, " ".join(a)), (None, " ".join([*a[:-1], "x"])), (5, " ".join(b)), (5, " ".join([*b, "y"])), (5, " ".join(b)), (7, " ".join(long)), (8, " ".join(near)), (None, None), (9, "a\tb\nc d  e")]
    got = near_join.near_join(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = collections.Counter((k, n) for (k, _), n in zip(rows, brute_links(rows)))
    assert collections.Counter((x.doc_id, x.n_links) for x in got) == want


@pytest.mark.parametrize("node", [1024, 40])
def test_one_large_node(spark, monkeypatch, node):
    """A group of near copies larger than a node that is compared in place, and classes that share nothing with it."""
    monkeypatch.setattr(near_join, "NODE", node)
    r, base, rows = random.Random(7), words(200, 4), []
    for k in range(150):
        own = list(base)
        own[r.randrange(200)] = f"x{k}"
        rows.append((k, " ".join(own)))
    rows += [(1000 + k, " ".join(words(60, 5000 + k))) for k in range(100)]
    got = {x.doc_id: x.n_links for x in near_join.near_join(frame(spark, rows)).collect()}
    assert [got[k] for k, _ in rows] == brute_links(rows)


def test_components(spark, monkeypatch):
    from tapestride.llm import components

    monkeypatch.setattr(components, "LEAST", 5)
    r = random.Random(3)
    edges = [(0, k) for k in range(1, 60)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(70)] + [(300 + k, 301 + k) for k in range(40)] + [(7, 7), (150, 150)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {x.node: x.label for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: root(k) for k in list(parent)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
