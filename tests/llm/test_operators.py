"""Each operator on a small fixture with null ids and texts, empty and long texts, repeated rows,
empty tables and clashing column names; results against brute force."""

import hashlib
import json
import math
import time
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parcelgraph.llm import bpe, chat, collisions, decontamination, extraction, neardup, packing, quality, sharding, shingles, suffix_tree, token_counts

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, n int, id string, size string, key int, x double, score string, shard string, slot string"


def rows(texts):
    return [(i, t, 1, "clash", "s", 2, 3.0, "?", "h", "l") for i, t in texts]


@pytest.fixture(scope="module")
def words():
    rng = np.random.default_rng(3)
    pool = [f"w{k}" for k in range(400)]
    return lambda n: " ".join(rng.choice(pool, n))


@pytest.fixture(scope="module")
def texts(words):
    base = words(120)
    some = [(1, base), (2, base), (3, base + " tail end"), (4, ""), (5, None), (6, "  \n\t "), (7, "One TWO"), (8, "one  two"), (9, words(4000)), (10, "x" * 3000), (None, base), (11, "é ß <|endoftext|> ΑΣ b\x1c c"), (12, base), (12, base)]
    return some + [(100 + k, words(60)) for k in range(40)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(rows(texts), DOCS).repartition(3)


def test_token_counts(spark, docs, texts):
    library = Tokenizer.from_file(BYTE)
    found = Counter(tuple(r) for r in token_counts.count_tokens(docs, BYTE, limit=100).collect())
    want = Counter()
    for i, t in texts:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[(i, len((t or "").encode()), n, n > 100)] += 1
    assert found == want
    assert token_counts.count_tokens(docs.where("false"), BYTE).count() == 0


def test_whole_tokens_are_proved():
    library = Tokenizer.from_file(BYTE)
    whole = bpe.whole_tokens(open(BYTE, encoding="utf-8").read())
    assert len(whole) > 49_000
    sample = [w for w in whole[::97] if "<|endoftext|>" not in w]
    assert all(len(library.model.tokenize("".join(bpe.byte_alphabet()[b] for b in w.encode()))) == 1 for w in sample)


def test_packing(spark, docs, texts):
    library = Tokenizer.from_file(WORD)
    out = packing.pack(docs, WORD, capacity=64, end_id=1, group_rows=16).collect()
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    for i, t in texts:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        copies = sum(1 for j, _ in texts if j == i)
        mine = [r for r in pieces[i] if r.doc_tokens == len(ids)]
        assert sum(r.length for r in mine) == copies * len(ids)
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert packing.pack(docs.where("false"), WORD).count() == 0


def test_first_fit_decreasing():
    lengths = np.random.default_rng(1).integers(1, 100, 300)
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    free, want = [], {}
    for k in np.argsort(-lengths, kind="stable"):
        b = next((i for i, f in enumerate(free) if f >= lengths[k]), len(free))
        if b == len(free):
            free.append(100)
        want[k] = (b, 100 - free[b])
        free[b] -= lengths[k]
    assert {k: (int(bins[k]), int(offsets[k])) for k in want} == {k: (int(a), int(b)) for k, (a, b) in want.items()}


def test_sharding(spark, docs, texts):
    out = sharding.shard_by_bytes(docs, shards=4, tolerance=0.01, slot_rows=5)
    assert set(docs.columns) | {"size", "shard", "slot"} == set(out.columns)
    got = out.select("doc_id", "size", "shard", "slot").collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, 16 + len((t or "").encode())) for i, t in texts)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert set(by) <= set(range(4))
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    assert all(abs(sum(r.size for r in part) - total / 4) <= largest + 0.02 * total / 4 for part in by.values())
    assert sharding.shard_by_bytes(docs.where("false"), shards=4).count() == 0


def test_sharding_splits_a_group_of_copies(spark):
    same = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("copy of one text").alias("text"))
    sizes = [r["count"] for r in sharding.shard_by_bytes(same, shards=8).groupBy("shard").count().collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 2


def test_sharding_splits_equal_rows_under_any_names(spark):
    """Repeated rows, null ids and columns named like the operator's own."""
    table = [(7, "copy of one text", k, 0, 0) for k in range(2000)] + [(None, f"text {k}", k, 0, 0) for k in range(400)]
    docs = spark.createDataFrame(table, "doc_id long, text string, k0 int, part int, _part int")
    out = sharding.shard_by_bytes(docs, shards=8, slot_rows=50).collect()
    assert Counter((r.doc_id, r.text, r.k0) for r in out) == Counter((i, t, k) for i, t, k, _, _ in table)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r)
    sizes = [sum(r.size for r in part) for part in by.values()]
    assert len(by) == 8 and max(sizes) < 1.25 * min(sizes)
    assert all(sorted(r.slot for r in part) == list(range(len(part))) for part in by.values())


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "\\l \\\\ \\b<", "<|turn|>user\nhi<|end|>", "", None, "a\n<<SYS>>[", "[[I<<s>"]
    table = [(1, k, "user" if k % 2 == 0 else "assistant", t, 0) for k, t in enumerate(odd)] + [(2, 0, "assistant", "x", 0), (2, 0, "assistant", "x", 0), (None, None, None, None, 0)]
    turns = spark.createDataFrame(table, "conv_id long, turn long, role string, text string, conv int")
    out = {r.conv_id: r for r in chat.format_conversations(turns).select("*", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [(t.role, t.text) for t in out[1].turns] == [("user" if k % 2 == 0 else "assistant", t or "") for k, t in enumerate(odd)]
    assert out[1].loss == "".join(t or "" for k, t in enumerate(odd) if k % 2)
    assert out[1].formatted.count("<|turn|>") == len(odd) and "[INST]" not in out[1].formatted and out[1].formatted.count("</s>") == 1
    assert out[2].n_turns == 2 and out[2].loss == "xx"
    assert [(t.role, t.text) for t in out[None].turns] == [("", "")]
    assert chat.format_conversations(turns.where("false")).count() == 0


def test_chat_parts(spark):
    part = lambda kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None: (kind, text, ref, width, height, seconds, pages)
    rows = [(1, 0, "user", [part("text", "see <"), part("text", "s>"), part("image", ref="a.png", width=28, height=29)]), (1, 1, "user", [part("document", ref="d", pages=3), part("audio", ref="b", seconds=2.0), part(None, "t")]), (1, 2, "assistant", None)]
    turns = spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts array<{chat.PART}>")
    r = chat.format_conversations(turns, parts_col="parts").select("*", chat.read_back(F.col("formatted")).alias("t")).first()
    assert [(a.n, a.turn, a.type, a.ref, a.tokens) for a in r.attachments] == [(1, 0, "image", "a.png", 6), (2, 1, "document", "d", 768), (3, 1, "audio", "b", 50)]
    assert [t.text for t in r.t] == ["see <s><|image:1|>", "<|document:2|><|audio:3|>t", ""]
    assert r.formatted.count("<s>") == 1


def test_words_with_unassigned_characters(spark):
    library = __import__("tokenizers").Tokenizer.from_file(WORD)
    encode = bpe.WordEncoder(open(WORD).read())
    rng = np.random.default_rng(3)
    odd = [chr(int(c)) for c in rng.integers(0x300, 0x1FFFF, 4000) if not 0xD800 <= c < 0xE000]
    texts = ["a\u0558b \u0558", "x" * 5000 + " y", *(f"one{c} {c}two {c}" for c in odd if unicodedata.category(c) == "Cn")]
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, ascii(t)


def test_extraction_is_linear_and_keeps_named_text(spark):
    began = time.process_time()
    for page in ('<a "' * 60000, "<div>" * 60000 + "x", "<b>" * 30000 + "<div>a</div>" * 30000, '<a ">" ' * 50000 + '"', "<i><div>" + "<b>" * 30000 + "</i>" * 30000, "<!--" * 50000, "<script>" * 50000):
        extraction.main_text(page)
    assert time.process_time() - began < 20
    long = "<p>" + "This is a sentence of the article, and it is long enough. " * 4 + "</p>"
    page = f"""<body><nav><a>Home</a></nav><article><h1>Title</h1>{long}<h2 id="related-work">Related work</h2>{long}
      <section id="side-effects"><p>Side effects are rare, and mild, in most people.</p></section><p class="text-legal">The law, as it stands, says so.</p>
      <div class="share">Share this, now.</div></article><footer>Imprint</footer></body>"""
    found = extraction.main_text(page).split("\n\n")
    assert {"Title", "Related work", "Side effects are rare, and mild, in most people.", "The law, as it stands, says so."} <= set(found)
    assert not {"Home", "Imprint", "Share this, now."} & set(found)


def test_quality(spark, docs, texts, words):
    junk = [(1000 + k, "BUY!! NOW!! " * (5 + k)) for k in range(30)]
    clean = [(2000 + k, words(30 + 3 * k).capitalize() + ".") for k in range(30)]
    every = spark.createDataFrame(rows(texts + junk + clean), DOCS)
    labels = spark.createDataFrame([(i, 0) for i, _ in junk[:20]] + [(i, 1) for i, _ in clean[:20]] + [(5, None), (None, 1)], "doc_id long, quality int")
    out = quality.score_quality(every, labels, F.col("doc_id").isNotNull()).collect()
    assert len(out) == len(texts + junk + clean) and all(0 <= r.score <= 1 for r in out)
    score = {r.doc_id: r.score for r in out}
    assert all(score[i] < 0.5 for i, _ in junk[20:]) and all(score[i] >= 0.5 for i, _ in clean[20:])
    assert {r.score for r in quality.score_quality(docs, labels.where("false"), F.lit(True)).collect()} == {0.5}
    assert quality.score_quality(docs.where("false"), labels, F.lit(True)).count() == 0


def test_discriminant_is_the_density_difference():
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(500, 3)), rng.normal(size=(400, 3)) @ np.diag([1, 2, 0.5]) + 1
    stack = lambda f: np.array([f(a), f(b)])
    m = quality.Discriminant.fit(np.array([500.0, 400.0]), stack(lambda x: x.sum(0)), stack(lambda x: x.T @ x), 1e-9)
    x = rng.normal(size=(20, 3))
    log = []
    for y in (a, b):
        cov, d = np.cov(y.T, bias=True), x - y.mean(0)
        log.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1] + math.log(len(y)))
    assert np.allclose(m.score(x), 1 / (1 + np.exp(log[0] - log[1])), atol=1e-6)


def test_collisions(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 16))
    near = base[:10] + 0.05 * rng.normal(size=(10, 16))
    v = [(k, [float(x) for x in y], k % 3) for k, y in enumerate([*base, *base[:5]])] + [(100 + k, [float(x) for x in y], k % 3) for k, y in enumerate(near)]
    v += [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] * 16, 0), (203, [1.0] * 16, None), (204, [1.0, None] * 8, 1), (205, [], 1), (206, [1.0, 2.0], 1), (207, [2.0, 4.0], 1), (None, [1.0] * 16, 0)]
    table = spark.createDataFrame([(*r, 0) for r in v], "vec_id long, embedding array<double>, label int, id int")
    out = {r.vec_id: r for r in collisions.link_vectors(table, block_rows=4).collect()}
    ok = [(i, np.array(x), g) for i, x, g in v if i is not None and g is not None and x and None not in x and np.isfinite(x).all() and any(x)]
    links = defaultdict(set)
    for i, x, g in ok:
        for j, y, h in ok:
            if i != j and g == h and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links[i].add(j)
    assert {i: r.n_links for i, r in out.items()} == {i: len(links[i]) for i, _, _ in v}

    def reach(i):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        return min(seen)

    assert all(r.component_id == reach(i) and r.kept == (reach(i) == i) for i, r in out.items() if i is not None)
    assert out[None].component_id is None and not out[None].kept
    assert collisions.link_vectors(table.where("false")).count() == 0


def test_collision_calibration():
    least = collisions.collision_threshold(32, 0.4, 0.2, 0.9999)
    hits = (np.abs(0.2 * np.random.default_rng(0).normal(size=(200_000, 32))) <= 0.4).sum(1)
    assert (hits >= least).mean() >= 0.9997
    a, b = np.random.default_rng(1).normal(size=(2, 20, 5))
    assert (collisions.count_collisions(a, b, 0.7) == (np.abs(a[:, None] - b[None]) <= 0.7).sum(2)).all()


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>if (a<b) "</p>"</script></head><body class="page">
<header><a href="/">Home</a> Daily</header><nav><ul><li><a href=x>one</a><li><a href=y>two</a></ul></nav>
<div class="cookie-notice">We use cookies, accept them.</div>
<main><article><h1>The title of it</h1><p>First para&shy;graph &amp; more,<br>with a <b>bold</b> word; and it goes on, long enough.<p>Second one: a sentence.
<div class="ad">Buy this, now.</div><p>Third &lt;tag&gt; paragraph of the story, which ends here.</p></article></main>
<aside>Other news, of the day.</aside><section id="comments"><p>I liked this, really, thank you for it.</p></section>
<form><p>Your name</p><textarea>x</textarea></form><footer>Copyright, all rights.</footer><!-- <p>no</p> -->"""


def test_extraction(spark):
    want = "The title of it\n\nFirst para­graph & more, with a bold word; and it goes on, long enough.\n\nSecond one: a sentence.\n\nThird <tag> paragraph of the story, which ends here."
    assert extraction.main_text(PAGE) == want
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, "u", "<p>", "x"), (4, "u", "<" * 2000 + '<a "' * 500, "x"), (1, "u", PAGE, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = extraction.extract(pages).collect()
    assert len(out) == 6 and [r.text for r in out if r.page_id == 1] == [want, want] and [r.text for r in out if r.page_id in (2, 3)] == ["", ""]
    assert extraction.extract(pages.where("false")).count() == 0


def test_minimum_cut_is_minimal():
    rng = np.random.default_rng(5)
    for _ in range(30):
        n = int(rng.integers(2, 8))
        scores = [round(float(x), 2) for x in rng.normal(size=n)]
        ties = [(a, b, round(float(rng.random()), 2)) for a in range(n) for b in range(a) if rng.random() < 0.5]
        cost = lambda s, scores=scores, ties=ties: sum(x for x, y in zip(scores, s) if x > 0 and not y) - sum(x for x, y in zip(scores, s) if x < 0 and y) + sum(w for a, b, w in ties if s[a] != s[b])
        best = min(cost([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))
        assert abs(cost(extraction.minimum_cut(scores, ties)) - best) < 1e-6


def reference_sets(texts):
    out = []
    for i, t in texts:
        w = (t or "").encode().lower().split()
        out.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    return out


def test_shingles(texts):
    for (_, t), (_, s) in zip(texts, reference_sets(texts), strict=True):
        assert len(shingles.shingle_set(t or "")) == len(s)
    assert (shingles.word_hashes("A b\n c") == shingles.word_hashes(" a B  c")).all()
    long = "ab " * 500_000
    assert len(set(shingles.word_hashes(long).tolist())) == 1 and len(shingles.word_hashes(long)) == 500_000


def test_near_duplicates(spark, texts, words):
    rng = np.random.default_rng(6)
    family = words(200).split()
    more = []
    for k in range(60):
        w = list(family)
        for at in rng.choice(200, int(rng.integers(1, 9)), replace=False):
            w[at] = f"new{k}{at}"
        more.append((500 + k, " ".join(w)))
    texts = [*texts, *more]
    docs = spark.createDataFrame(rows(texts), DOCS)
    out = neardup.near_duplicates(docs, leaf_rows=8, block_rows=16, depth=3).collect()
    sets = [(i, s) for i, s in reference_sets(texts) if i is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out if r.doc_id is not None) == Counter((i, len(s), find(i), find(i) == i) for i, s in sets)
    assert [r.component_id for r in out if r.doc_id is None] == [None]
    assert neardup.near_duplicates(docs.where("false")).count() == 0


def test_near_duplicates_at_the_threshold(spark):
    """Pairs of similarity 0.75 exactly whose signatures agree in fewer than 80 of 128 places, or 15 of
    the first 32, are links as well; that together with the trees few enough are missed."""
    draws, texts = shingles.multipliers(neardup.PLACES, 5), []
    for k in range(6000):
        a = [f"a{k}x{i}" for i in range(74)]
        b = a[:64] + [f"b{k}x{i}" for i in range(10)]
        x, y = (shingles.shingle_set(" ".join(w)) for w in (a, b))
        same = shingles.minhash(x, draws) == shingles.minhash(y, draws)
        if same.sum() < 80 or same[:32].sum() < 15:
            assert (shingles.overlap(x, y), len(x), len(y)) == (60, 70, 70)
            texts += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    assert len(texts) >= 4
    out = neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert all(r.component_id == r.doc_id // 2 * 2 for r in out)
    trees, places, quarter = neardup.calibrate(0.75, 0.9999, 4)
    rng = np.random.default_rng(0)
    lost = lambda n, least: (rng.binomial(n, 0.75, 4_000_000) < least).mean()
    share = rng.binomial(128, 0.75, 400_000) / 128
    by_trees = np.mean([(1 - neardup.survival(0.75, 4, f)) ** trees * c for f, c in zip(*np.unique(share, return_counts=True), strict=True)]) * len(np.unique(share)) / len(share)
    assert lost(128, places) + lost(32, quarter) + by_trees < 1e-4


def test_pipeline_keeps_different_texts_of_an_id(spark, words):
    import corpus_pipeline

    one, other, third = words(60), words(60), words(60)
    rows = [(1, one), (1, one), (1, other), (2, one), (3, third), (3, None), (None, one), (None, one)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    out = corpus_pipeline.near_duplicate_filter(spark, docs, "").collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter([(1, one), (1, other), (3, third), (3, None), (None, one), (None, one)])


def test_decontamination(spark, docs, texts, words):
    item = words(30)
    held = [(700, words(2000) + " " + item.upper() + " " + words(500)), (701, words(300) + " " + " ".join(item.split()[:24])), (702, words(50) + " " + " ".join(item.split()[:22]))]
    every = [*texts, *held]
    items = [(1, item), (2, texts[0][1]), (3, "one two"), (4, None), (5, " "), (6, words(14)), (1, item)]
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, value int")
    out = decontamination.contaminated(spark.createDataFrame(rows(every), DOCS), benchmark).collect()
    sets, wanted = reference_sets(every), reference_sets(items)
    want = {(i, j, len(t), len(s & t)) for i, s in sets for j, t in wanted if t and 100 * len(s & t) >= 75 * len(t)}
    assert Counter(tuple(r) for r in out) == Counter(want)
    assert decontamination.contaminated(docs.where("false"), benchmark).count() == 0
    assert decontamination.contaminated(docs, benchmark.where("false")).count() == 0


def test_suffix_tree(spark, texts):
    docs = spark.createDataFrame(rows(texts), DOCS)
    train = ~F.coalesce(F.col("doc_id") % 7 == 2, F.lit(False))
    tokens = [(i, [*(t or "").encode().lower().split(), b""]) for i, t in texts]
    count = Counter(w for i, ws in tokens if i is None or i % 7 != 2 for w in ws)
    n, v = sum(count.values()), len(count)
    want = Counter((i, len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tokens)
    out = suffix_tree.score_texts(docs, train, least_count=2).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    learnt = [ws for i, ws in tokens if i is None or i % 7 != 2]
    scores = defaultdict(list)
    for r in out:
        scores[r.doc_id].append(r.score)
    expected = defaultdict(list)
    p = tree_by_hand(learnt, 2, 2, 1.0, 0.75)
    for i, ws in tokens:
        expected[i].append(sum(math.log10(p(ws[:k], w)) for k, w in enumerate(ws)))
    for i, known in expected.items():
        assert np.allclose(sorted(scores[i]), sorted(known), rtol=1e-6)
    none = suffix_tree.score_texts(docs, F.lit(False)).collect()
    assert len(none) == len(texts) and all(abs(r.score - r.base_score) < 1e-9 for r in none)
    assert suffix_tree.score_texts(docs.where("false"), train).count() == 0


def test_suffix_tree_reads_words_as_bytes_split():
    held = ["A b  c", " ", None, "", "x" * 100 + " " + "Y" * 9 + "\n", "é ß a " + "x" * 100, "\x0b\x0ck\x1c\x08 \x0e", "Q" * 8 + " " + "Q" * 16 + " " + "q" * 64 + "\t" + "Q" * 65]
    symbols, place, lengths = suffix_tree._read(pa.array(held))
    split = [[*(t or "").encode().lower().split(), None] for t in held]
    assert lengths.tolist() == [len(ws) for ws in split]
    assert place.tolist() == [k for ws in split for k in range(len(ws))]
    named = defaultdict(set)
    for w, h in zip((w for ws in split for w in ws), symbols.tolist(), strict=True):
        named[w].add(h)
    assert all(len(hs) == 1 for hs in named.values()) and len({min(hs) for hs in named.values()}) == len(named)


def tree_by_hand(texts, depth, least_count, divergence, discount):
    """The tree's next-symbol probability as a function of the past and a symbol."""
    count = Counter(w for ws in texts for w in ws)
    total = sum(count.values()) + len(count) + 1
    after = defaultdict(Counter)
    for ws in texts:
        for k, w in enumerate(ws):
            for n in range(1, min(depth, k) + 1):
                after[tuple(ws[k - n : k])][w] += 1
    states = {}

    def probability(past, w):
        for n in range(min(depth, len(past)), 0, -1):
            if (state := tuple(past[-n:])) in states:
                seen, rest = states[state]
                return seen.get(w, 0.0) + rest * probability(state[1:], w)
        return (count[w] + 1) / total

    for n in range(1, depth + 1):
        for context, seen in after.items():
            many = sum(seen.values())
            if len(context) != n or (n > 1 and many < least_count):
                continue
            rest = discount * len(seen) / many
            share = {w: (c - discount) / many for w, c in seen.items()}
            q = {w: probability(context[1:], w) for w in seen}
            p = {w: share[w] + rest * q[w] for w in seen}
            inside, outside = 1 - sum(p.values()), 1 - sum(q.values())
            gain = sum(p[w] * math.log(p[w] / q[w]) for w in seen)
            if inside > 1e-12 and outside > 1e-12:
                gain += inside * math.log(inside / outside)
            if gain * many >= divergence:
                states[context] = share, rest
    return probability


def test_suffix_tree_learns_and_sums_to_one(spark):
    rng = np.random.default_rng(8)
    text = lambda: " ".join(x for _ in range(20) for x in rng.choice(["a b c d", "b a d c", "c c a b"], 1))
    made = [(k, text()) for k in range(200)]
    out = suffix_tree.score_texts(spark.createDataFrame(made, "doc_id long, text string"), F.col("doc_id") % 5 > 0, depth=3, least_count=2).collect()
    held = [r for r in out if r.doc_id % 5 == 0]
    assert sum(r.score for r in held) > 0.6 * sum(r.base_score for r in held)
    texts = [[*t.split(), ""] for k, t in made if k % 5]
    p = tree_by_hand(texts, 3, 2, 1.0, 0.75)
    for r in held:
        ws = [*made[r.doc_id][1].split(), ""]
        assert math.isclose(r.score, sum(math.log10(p(ws[:k], w)) for k, w in enumerate(ws)), rel_tol=1e-6)
    # what is left for words never seen is one more count
    total = sum(map(len, texts)) + 5 + 1
    for past in (["a"], ["b", "c"], ["d", "b", "a"], ["c", "c", "c"], ["new", "a"]):
        assert math.isclose(sum(p(past, w) for w in ["a", "b", "c", "d", "", "new"]), 1, rel_tol=1e-9) and p([], "new") == 1 / total


def test_suffix_tree_grows_with_the_input(spark):
    """Whatever else is in the corpus, what two texts share is learnt."""
    rng = np.random.default_rng(12)
    pool = [f"w{k}" for k in range(3000)]
    filler = [(100 + k, " ".join(rng.choice(pool[: 30 + 20 * (k % 140)], 500))) for k in range(300)]
    twice = " ".join(f"rare{k}" for k in rng.permutation(60))
    docs = spark.createDataFrame([(1, twice), (2, twice), *filler], "doc_id long, text string")
    out = {r.doc_id: r for r in suffix_tree.score_texts(docs, F.lit(True)).collect()}
    assert out[1].score == out[2].score and out[1].score > 0.4 * out[1].base_score


def test_queries_have_their_columns(spark):
    from parcelgraph.llm import queries

    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))
    out = queries.QUERIES["op2_chat_format"](spark, "/root/testdata/sf0.001").where("conv_id = -1").first()
    said = "</s>[INST] ok [/INST]"
    assert out.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest() and out.loss_chars == len(said)
    assert json.dumps(out.loss_sha256) == json.dumps(hashlib.sha256(said.encode()).hexdigest())


def test_suffix_tree_sends_a_row_a_task_to_the_driver(spark):
    """a table of n parts has n * n packed rows; few of their runs are frequent."""
    parts, rare = 60, 3
    kinds = [suffix_tree.SEEN, suffix_tree.WORD]
    rows = []
    for k in range(parts * parts):
        g, c = np.array([2 * k, 2 * k + 1], np.uint64), np.array([rare, 100 if k % 75 == 0 else rare], np.uint64)
        rows.append((k % parts, kinds[k % 2], suffix_tree.pack(g, np.full(2, 0.5, np.float32), np.zeros(2, np.float32), c)))
    table = spark.createDataFrame(rows, suffix_tree._PACKED).repartition(5)
    assert suffix_tree.frequent_rows(table, 50).count() <= 5
    g, v, c = suffix_tree.frequent(table, 50)
    # words have counts, other runs none
    assert dict(zip(g.tolist(), c.tolist(), strict=True)) == {2 * k + 1: 100 * (k % 2) for k in range(0, parts * parts, 75)} and set(v.tolist()) == {0.5}
    assert [len(x) for x in suffix_tree.frequent(table, 1000)] == [0, 0, 0]


def test_suffix_tree_reads_texts_eight_times(spark):
    """Each reading hashes all words again, which took most of the CPU seconds when there were ten."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame([(k, "one two three " * k) for k in range(40)], "doc_id long, text string").mapInArrow(counted, "doc_id long, text string")
    assert suffix_tree.score_texts(docs, F.lit(True)).count() == 40
    assert 0 < read.value <= 8 * 40


def test_suffix_tree_sorts_and_finds_hashes():
    rng = np.random.default_rng(5)
    far = rng.integers(0, 1 << 64, 6000, np.uint64)
    two = np.array([1 << 63, (1 << 63) + 1, 0, (1 << 64) - 1], np.uint64)  # neighbours that lead alike, over the whole range
    for x in (far, np.r_[far, far + np.uint64(1), far], np.repeat(two[:1], 5000), two[rng.integers(0, 4, 9000)], far[:5], far[:0]):
        order, out = suffix_tree._sorted(x)
        assert np.array_equal(out, np.sort(x)) and np.array_equal(x[order], out) and np.array_equal(np.sort(order), np.arange(len(x)))
        known, wanted = np.unique(x), np.r_[x, far + np.uint64(2), two]
        for at, hit in (suffix_tree._found_by_range(suffix_tree._ranged(known), wanted), suffix_tree._found(known, wanted)):
            assert np.array_equal(hit, np.isin(wanted, known)) and np.array_equal(known[at[hit]], wanted[hit])
    for row in (np.array([5, 5, 0, 9], np.uint32), np.array([1 << 30, 3], np.uint32), np.zeros(0, np.uint32)):
        for x, y in zip(suffix_tree._numbered(row), np.unique(row, return_inverse=True), strict=True):
            assert np.array_equal(x, y)


def test_suffix_tree_slices_hold_each_part_once():
    h = np.r_[np.random.default_rng(6).integers(0, 1 << 64, 5000, np.uint64), np.array([0, (1 << 64) - 1], np.uint64)]
    for parts, slices in ((8, 3), (37, 2), (1000, 3), (9, 1)):
        part = suffix_tree.part_of(h, parts)
        assert np.array_equal(part, np.searchsorted(suffix_tree.starts(parts), h, "right") - 1)
        for k in range(slices):
            first, after = suffix_tree.part_slice(k, slices, parts)
            assert np.array_equal(suffix_tree._within(h, first, after, parts), (part >= first) & (part < after)) and suffix_tree.part_slice(k + 1, slices, parts)[0] == after
        assert suffix_tree.part_slice(0, slices, parts)[0] == 0 and after == parts
