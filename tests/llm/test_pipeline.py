"""The pipeline against brute force, stage by stage, on planted documents."""

import random
import re
from itertools import combinations

import corpus_pipeline
from tapestride.llm import toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def grams(text):
    w = WORD.findall(text or "")
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def corpus():
    r = random.Random(11)
    vocabulary = ["".join(r.choices("abcdefghij", k=6)) for _ in range(900)]
    say = lambda n: r.choices(vocabulary, k=n)
    items = [say(24) for _ in range(4)]
    docs, labels = [], []
    for k in range(500):
        words = say(80)
        if k % 7 == 0:
            for _ in range(3):
                words[r.randrange(80)] = r.choice(["idiot", "moron", "scum"])
        labels.append((k, 1, int(k % 7 == 0)))
        docs.append((k, " ".join(words)))
    clean = [d for d in docs if d[0] % 7]
    for k, (_, text) in enumerate(r.sample(clean, 40)):
        words = text.split()
        if k % 2:
            words[k] = "changed"
        docs.append((1000 + k, ("\n" if k % 4 == 0 else " ").join(words) + " " * (k % 3)))
    for k in range(20):
        passage = [w if k % 2 or j % 9 else "other" for j, w in enumerate(items[k % 4])]
        docs.append((2000 + k, " ".join(say(30) + passage + say(30))))
    docs += [(3000, None), (3001, ""), (3002, "   "), (3003, "short one")]
    return docs, labels, items


def test_pipeline(spark, tmp_path):
    docs, labels, items = corpus()
    sf = f"{tmp_path}/sf"
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    text, left = dict(docs), spark.read.parquet(f"{sf}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, left, sf)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == COLUMNS
        out.write.parquet(f"{tmp_path}/{k}")
        left = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r.doc_id for r in left.select("doc_id").collect()})
    chain = toxicity.fitted(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    scorer = toxicity.Scorer(chain)
    assert kept[0] == {k for k, t in docs if scorer.score(t or "")[1] <= chain.thresholds[1]}
    assert kept[0] >= {k for k, _ in docs if k >= 1000 or k % 7} and len(kept[0] & {k for k in range(0, 500, 7)}) <= 2

    bare = lambda k: re.sub(r"[\x20\x09-\x0D]", "", text[k] or "")
    best = {}
    for k in kept[0]:
        best[bare(k)] = min(best.get(bare(k), (0, 10**9)), (-len(text[k] or ""), k))
    assert kept[1] == {k for _, k in best.values()}

    sets, parent = {k: grams(text[k]) for k in kept[1]}, {k: k for k in kept[1]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(kept[1]), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert kept[2] == {root(k) for k in kept[1]}

    def leaks(k):
        w = re.findall(r"[^\W_]+", (text[k] or "").lower())
        for item in items:
            for shift in range(-len(item) + 1, len(w)):
                same = [0 <= j + shift < len(w) and w[j + shift] == x for j, x in enumerate(item)]
                if sum(same) >= 11 and any(sum(same[s : s + 13]) >= 11 for s in range(len(item) - 12)):
                    return True
        return False

    assert kept[3] == {k for k in kept[2] if not leaks(k)}
    assert not kept[3] & set(range(2000, 2020))
    assert kept[4] == kept[3]


def test_run_on_odd_rows(spark, tmp_path):
    """Null and repeated ids through the whole pipeline: no clean text is lost, every text is packed once."""
    docs, labels, items = corpus()
    r = random.Random(5)
    fresh = lambda: " ".join("".join(r.choices("klmnopqr", k=7)) for _ in range(60))
    alone, two, leak = fresh(), fresh(), " ".join(items[0])
    odd = [(None, alone), (None, leak), (1, two), (1, two), (1, leak), (None, docs[2][1]), (None, None)]
    rows = docs[:500] + odd
    sf = f"{tmp_path}/sf"
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    got = corpus_pipeline.run(spark, sf).collect()
    starts = [(p.doc_id, p.doc_tokens) for p in got if p.start == 0]
    from tokenizers import Tokenizer

    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1
    assert (None, tokens(alone)) in starts and starts.count((1, tokens(two))) == 1 and (None, 1) in starts
    assert (1, tokens(docs[1][1])) in starts  # the other text of an id whose second text leaks
    assert sum(k is None for k, _ in starts) == 2  # the leak and the copy without an id are gone
