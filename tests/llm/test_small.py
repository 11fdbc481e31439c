"""The ten operators against brute force on small tables with awkward rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from twinfold.llm import op1_bpe, op2_substrings, op3_decontaminate, op4_pii, op5_toxicity, op6_quality, op7_language, op8_shards, op9_html, op10_jaccard
from twinfold.llm.graph import components
from twinfold.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PASSAGE = " ".join(f"shared{i}" for i in range(40))
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
TEXTS = [
    None, "", " \t\n", "one", "one", "ONE two three", "a b c d e", "A b C d e", "a b c d f", PASSAGE, PASSAGE + " tail", "head " + PASSAGE, " ".join(["again"] * 60), LONG, LONG,
    LONG.replace("w5x5 ", "other "), "Zoë été naïve ß 漢字 😀 x", "1 2 3 ### $$$", "line one\nline one\nline two\n\nline one", "x" * 5000, "mail a.b@c.de or 10.0.0.1 now",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "de", None)[i % 3], ("s", None)[i % 2], len(t or ""), 0) for i, t in enumerate(TEXTS)]
    rows += [rows[3], (None, "a b c d e", "en", "s", 9, 1), (None, None, None, None, None, None)]
    # A column that operators use inside has a clashing name here.
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def same(got, want):
    key = lambda x: str(x)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_bpe(docs, empty):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = op1_bpe.read_ranks(open(path, "rb").read())
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in rows_of(docs):
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    same(map(tuple, op1_bpe.digests(docs, path, public_tokenizers.PATTERN).collect()), want)
    assert op1_bpe.digests(empty, path, public_tokenizers.PATTERN).count() == 0
    whole = op1_bpe.encode(docs, path, public_tokenizers.PATTERN).collect()
    same([(r.doc_id, r.ids, bytes(r.decoded).decode()) for r in whole], [(i, enc.encode_ordinary(t or ""), t or "") for i, t in rows_of(docs)])


def test_bpe_pieces():
    import public_tokenizers

    ranks = op1_bpe.read_ranks(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    b = op1_bpe.Bpe(ranks, public_tokenizers.PATTERN)
    rng = np.random.default_rng(1)
    pieces = [bytes(rng.integers(97, 101, rng.integers(1, 40), dtype=np.uint8)) for _ in range(300)]
    order, lens, flat = b.merge_matrix(pieces, 64)
    for n, ids in zip(order, np.split(flat, np.cumsum(lens)[:-1])):
        assert ids.tolist() == b.merge_heap(pieces[n]).tolist()


def windows_removed(texts, size):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[k : k + size]) for w in words for k in range(len(w) - size + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if seen[tuple(w[k : k + size])] > 1:
                gone[k : k + size] = [True] * size
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("size", [35, 3])
def test_substrings(docs, empty, size):
    rows = rows_of(docs)
    want = [(i, n, m, k) for (i, _), (n, m, k) in zip(rows, windows_removed([t for _, t in rows], size))]
    same([(r.doc_id, r.n_words, r.n_removed, bytes(r.kept).decode()) for r in op2_substrings.remove_repeats(docs, size).collect()], want)
    assert op2_substrings.remove_repeats(empty, size).count() == 0
    # A sketch that is much too small, and many small shipments, change nothing.
    same([(r.doc_id, r.n_words, r.n_removed, bytes(r.kept).decode()) for r in op2_substrings.remove_repeats(docs, size, most_bits=5, gathered=50).collect()], want)


def test_decontaminate(spark, docs, empty):
    item = "We know that Mary had 5 apples and gave Tom 1 apples before walking 9 km to the old market with Mary"
    texts = [
        (1, "Yesterday he said that Anna had 12 apples and gave Peter 3 apples before walking 40 km to the old market with Anna"),
        (2, "they say that Bob had 7 apples and gave Carl 2 apples before walking 55 miles to the old market with Dora"),  # the same slot, two names
        (3, "x. " + item + " x"), (3, "x. " + item + " x"), (4, None), (5, ""), (6, "that Mary had nothing"), (7, "read A B C D E F"),
    ]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame([(9, item), (10, None), (11, ""), (12, "too short"), (13, "a B c D e F")], "item_id long, text string")
    hits = op3_decontaminate.matches(d, items)
    keyed = d.select("doc_id", *op3_decontaminate._text_keys())
    same([tuple(r) for r in keyed.join(hits, ["t1", "t2"]).select("doc_id", "item_id").collect()], [(1, 9), (3, 9), (3, 9)])
    assert sorted(r.doc_id for r in op3_decontaminate.clean(d, items).collect()) == [2, 4, 5, 6, 7]
    assert op3_decontaminate.clean(docs, items).count() == docs.count() and op3_decontaminate.matches(empty, items).count() == 0
    assert op3_decontaminate.matches(d, items.where("false")).count() == 0


def test_decontaminate_names_and_sums(spark):
    items = [
        (1, "Mary has 5 apples and gives Tom 2 now"), (2, "12 + 7 = 19 and 19 - 4 = 15 so 15 + 6 = 21 and 21 - 2 = 19"), (3, "short exact item here"), (4, "only three words"),
        (5, "Tom has 3 apples. Mary gives him 5 more. How many apples does Tom have?"),
    ]
    texts = [
        (1, "Anna has 7 apples and gives Bob 3 now"), (2, "he wrote 12 + 7 = 19 and 19 - 4 = 15 so 15 + 6 = 21 and 21 - 2 = 19 down"), (3, "a short exact item here"), (4, "only three words"),
        (5, "Tom has 3 apples. Susan gives him 5 more. How many apples does Tom have?"), (6, "12 + 7 = 20 and 20 - 4 = 16 so 16 + 6 = 22 and 22 - 2 = 20"), (7, "Anna has 7 apples and takes Bob 3 now"),
    ]
    d = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("doc_id", "text", "doc_id _t1", "doc_id t2")
    hits = op3_decontaminate.matches(d, spark.createDataFrame(items, "item_id long, text string"))
    same([tuple(r) for r in d.select("doc_id", *[c.alias(n) for c, n in zip(op3_decontaminate._text_keys(), ("t1", "t2"))]).join(hits, ["t1", "t2"]).select("doc_id", "item_id").collect()], [(1, 1), (2, 2), (3, 3), (5, 5)])
    kept = op3_decontaminate.clean(d, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [4, 6, 7]


def brute_spans(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and op4_pii.luhn(digits(m[0]))]
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]


def test_pii_base(docs, empty):
    rng = np.random.default_rng(2)
    for _ in range(20_000):
        t = "".join(rng.choice(list("a.@+1 4-(0b9\n%"), rng.integers(1, 40)))
        assert op4_pii.base(t) == brute_spans(t), t
    got = op4_pii.detected(docs).collect()
    same([(r.doc_id, r.base_sha256) for r in got], [(i, hashlib.sha256(op4_pii.written(brute_spans(t or "")).encode()).hexdigest()) for i, t in rows_of(docs)])
    assert op4_pii.detected(empty).count() == 0


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail john (at) example (dot) com now", "email", "john (at) example (dot) com"), ("john.doe at example dot com", "email", "john.doe at example dot com"), ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("call plus one three one nine five five five five one three two ok", "phone", "plus one three one nine five five five five one three two"), ("ip ７４.42.69.78", "ip", "７４.42.69.78"),
        ("74 dot 42 dot 69 dot 78", "ip", "74 dot 42 dot 69 dot 78"), ("4387 5130​3523 7269", "card", "4387 5130​3523 7269"), ("we met at noon. Dot com is a word", None, None), ("hold at one. dot", None, None),
    ],
)
def test_pii_disguised(text, kind, found):
    own, every = op4_pii.spans(text)
    assert not own and [(op4_pii.KINDS[k], text[a:z]) for k, a, z in every] == ([(kind, found)] if kind else [])
    assert op4_pii.masked(text, every) == (text.replace(found, f"<{kind.upper()}>") if kind else text)


def test_pii_mask(docs):
    got = {r.doc_id: r for r in op4_pii.mask(docs).collect()}
    assert got[20].text == "mail <EMAIL> or <IP> now" and got[20].n_chars == len(got[20].text) and got[0].text is None and got[13].text == LONG


def test_toxicity(spark, sf, docs, empty):
    table = [(i, ("calm and kind words here " * 5 + ("you awful grobnik" if i % 3 == 0 else "friend")) + f" n{i}", "en") for i in range(400)]
    d = spark.createDataFrame(table, "doc_id long, text string, lang string")
    labels = d.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    net = op5_toxicity.fit(d, labels)
    wrong = [r for r in op5_toxicity.scored(d, net).collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.predicted != (r.doc_id % 3 == 0)]
    assert not wrong
    odd = op5_toxicity.scored(docs, net).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in odd)
    assert op5_toxicity.scored(empty, net).count() == 0
    none = op5_toxicity.fit(d, labels.where("false"))
    assert {round(r.score, 6) for r in op5_toxicity.scored(docs, none).collect()} == {0.15}


def quality(t):
    t = t or ""
    w = WORD.findall(t)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality(spark, docs, empty):
    got = op6_quality.judged(docs).collect()
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got], [(i, *quality(t)) for i, t in rows_of(docs)])
    assert all(not (r.kept and r.base_failed) for r in got) and op6_quality.judged(empty).count() == 0
    prose = [(i, " ".join(f"word{(i * 7 + j * j) % 991}" for j in range(80)) if i % 20 else " ".join(f"wo{i}{j}###$$$" for j in range(80)), "en", "s") for i in range(300)]
    d = spark.createDataFrame(prose, "doc_id long, text string, lang string, source string")
    assert {r.doc_id for r in op6_quality.judged(d).where("not kept").collect()} == {i for i in range(0, 300, 20)}
    assert op6_quality.filtered(d).columns == d.columns


def test_language(spark, docs, empty):
    words = {"en": "the and of that with from this have", "de": "der und nicht mit sich auch eine schon", "fr": "le et les dans une pour avec être"}
    rng = np.random.default_rng(3)
    table = [(i, " ".join(rng.choice(w.split(), 30)), lang) for i, (lang, w) in enumerate(list(words.items()) * 80)]
    d = spark.createDataFrame(table, "doc_id long, text string, lang string")
    net = op7_language.fit(d)
    held = [(r.lang, r.lang_pred) for r in op7_language.predicted(d, net).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(a == b for a, b in held) >= 0.95 * len(held) > 0
    odd = {r.doc_id: r for r in op7_language.predicted(docs.select("doc_id", "text"), net).collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (0, 1, 2, 17)) and odd[13].lang_pred in words
    assert op7_language.predicted(empty, net).count() == 0 and {r.lang_pred for r in op7_language.predicted(docs, None).collect()} == {"und"}
    signs = spark.createDataFrame([(1, "² ½ ① Ⅷ 12"), (2, "ａ")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in op7_language.predicted(signs, net).orderBy("doc_id").collect()] == [True, False]
    kept = op7_language.identified(docs)
    sure = {r.doc_id: r.lang_pred for r in op7_language.predicted(docs, op7_language.fit(docs)).where(F.col("score") >= op7_language.LEAST).collect()}
    assert kept.columns == docs.columns and kept.where("lang is null").count() == 0
    same([r.doc_id for r in kept.collect()], [i for i, t in rows_of(docs) if t is not None and any(c.isalpha() for c in t) and i in sure])


def test_language_gradient():
    net = op7_language.Network(["a", "b", "c"])
    for g in (net.ahead, net.behind):
        g.x, g.u = g.x.astype(np.float64), g.u.astype(np.float64)
    x, y = np.random.default_rng(0).integers(97, 110, (4, 7)), np.array([0, 1, 2, 0])

    def loss():
        h, ahead, behind = np.zeros((4, op7_language.STATES)), [], [None] * 7
        for i in range(7):
            h, _ = net.ahead.step(x[:, i], h)
            ahead.append(h)
        h = np.zeros((4, op7_language.STATES))
        for i in range(6, -1, -1):
            h, _ = net.behind.step(x[:, i], h)
            behind[i] = h
        return -np.mean([np.log(op7_language.softmax(np.concatenate([ahead[i], behind[i]], 1) @ net.v + net.c)[np.arange(4), y]).mean() for i in range(7)])

    for k, (p, g) in enumerate(zip([net.ahead.x, net.ahead.u, net.behind.x, net.behind.u, net.v], net.gradients(x, y))):
        at = (x[0, 0], 3) if k in (0, 2) else (2, 1)
        old = p[at]
        p[at] = old + 1e-3
        up = loss()
        p[at] = old - 1e-3
        down = loss()
        p[at] = old
        assert abs((up - down) / 2e-3 - g[at]) < 1e-5


def test_shards(spark, docs, empty):
    d = spark.createDataFrame([(i, "hot" if i % 3 else f"s{i % 5}") for i in range(1000)], "doc_id long, source string")
    got = op8_shards.stratified(d, shards=16).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    sizes = [len(x) for x in by.values()]
    assert len(got) == 1000 and len(by) == 16 and max(sizes) - min(sizes) <= 1
    share = Counter(r.source for r in got)
    for x in by.values():
        assert sorted(r.slot for r in x) == list(range(len(x)))
        assert all(abs(n - share[s] * len(x) / 1000) <= 2.5 for s, n in (Counter(r.source for r in x)).items())
    same([r.doc_id for r in op8_shards.stratified(docs.select("doc_id", "source")).collect()], [i for i, _ in rows_of(docs)])
    assert op8_shards.stratified(empty.select("doc_id", "source")).count() == 0
    again = {(r.doc_id, r.shard, r.slot) for r in op8_shards.stratified(d.repartition(7), shards=16).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in got}


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("<html><head><title>t</title></head><body></body></html>", ""), ("a &lt; b", "a < b"), ("<div>" * 3000 + "deep text", "deep text"),
        ("<nav><ul><li><a href=x>menu</a></ul></nav><div class='ad box'>buy</div><article><h1>T</h1><p><b>One,\n two.<br><p>Three &amp; four.</article><footer>f</footer>", "T\n\nOne, two.\n\nThree & four."),
        ("<body><header><h1>Site</h1></header><div id=c class=post><h2>T</h2><p>One, two, three four five six seven eight nine.<p>Next&nbsp;para <a href=x>link</a><script>if(a<b){}</script></div><div class=comments><p>nice, nice, nice</p></div><aside>x</aside>", "T\n\nOne, two, three four five six seven eight nine.\n\nNext para link"),
        ("<main><header><h1>Ti</h1><div>by me</div></header><section><p>A b c.</p></section><section><p>D<br>e.</p><ul><li>x<li>y</ul></section><form>q</form></main>", "Ti\n\nA b c.\n\nD e.\n\nx\n\ny"),
    ],
)
def test_html(page, text):
    assert op9_html.extract(page) == text


@pytest.mark.parametrize(
    "box", ['<div class="content has-sidebar">', '<div class="page no-sidebar">', '<div class="post share-enabled">', '<div class="commentary">', '<div id="share-story">', '<section class="main widget">', "<fieldset>", '<div class="post-comments-open with-sidebar">']
)
def test_html_names(box):
    body = "<h1>Title here</h1><p>One, two, three four five six seven eight nine ten.</p><p>Second paragraph, longer than the first one, in plain words.</p>"
    page = f'<nav><a href="/">menu</a></nav>{box}{body}</{box[1:].split(" ")[0].strip("<>")}><div class="sidebar"><p>Other things, all of them elsewhere.</p></div><div class="comments"><p>{"nice words, " * 90}</p></div>'
    assert op9_html.extract(page) == "Title here\n\nOne, two, three four five six seven eight nine ten.\n\nSecond paragraph, longer than the first one, in plain words."


def test_html_lede():
    page = '<article><header><h1>Head</h1><p class="lede">A lede of some length that tells what comes next.</p><p>By me</p></header><p>Text of it, more of it.</p></article>'
    assert op9_html.extract(page) == "Head\n\nA lede of some length that tells what comes next.\n\nText of it, more of it."


def test_html_pages(spark):
    d = spark.createDataFrame([(1, "u", "<article><p>é 漢</p></article>", 1), (1, "u", "<article><p>é 漢</p></article>", 1), (None, None, None, None)], "page_id long, url string, html string, text int")
    same([tuple(r) for r in op9_html.extracted(d).collect()], [(1, "u", "é 漢", 3), (1, "u", "é 漢", 3), (None, None, "", 0)])


def shingle_sets(texts):
    low = [WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)})) for t in texts]
    return [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for w in low]


def brute_components(rows):
    sets = shingle_sets([t for _, t in rows])
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(s), least.get(root(i), d) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("block", [1500, 3])
def test_jaccard(spark, docs, empty, block):
    rng = np.random.default_rng(4)
    rows = rows_of(docs)
    for i in range(40):
        base = [f"b{i % 6}w{j}" for j in range(20 + 15 * (i % 6))]
        for _ in range(rng.integers(0, 6)):
            base[rng.integers(0, len(base))] = f"edit{rng.integers(0, 1000)}"
        rows.append((1000 + i, " ".join(base)))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    same(map(tuple, op10_jaccard.jaccard_components(d, block=block).collect()), brute_components(rows))


def test_jaccard_edges(docs, empty):
    assert op10_jaccard.jaccard_components(empty).count() == 0
    kept = op10_jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    rows = rows_of(docs)
    want = {d for d, _, c in brute_components(rows) if d == c and d is not None}
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(want)


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(30)]
    up = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(up[a], up[b])
            changed |= up[a] != m or up[b] != m
            up[a] = up[b] = m
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: r for n, r in up.items() if n in got} and {n for e in edges if e[0] != e[1] for n in e} == set(got)


def test_pipeline(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "decontaminate", "personal_data", "tokenize"]
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "ids", "decoded"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    texts = {d: t for d, t in texts.items() if t is not None and any(map(str.isalpha, t))}
    told = {r.doc_id for r in QUERIES["op7_language"](spark, sf).where(F.col("score") >= op7_language.LEAST).collect()}
    assert told >= set(texts)
    keep = {d for d, n, c in brute_components(list(texts.items())) if d == c}
    leaks = {r.doc_id for r in QUERIES["op3_decontaminate"](spark, sf).collect()}
    want = [(d, op4_pii.masked(texts[d], op4_pii.spans(texts[d])[1])) for d in keep - leaks]
    same([(r.doc_id, bytes(r.decoded).decode()) for r in out.collect()], want)


def test_merge_skip():
    rng = np.random.default_rng(6)
    for _ in range(300):
        lists = [sorted(set(rng.integers(0, 30, rng.integers(0, 12)).tolist())) for _ in range(rng.integers(1, 9))]
        t = int(rng.integers(1, 6))
        count = Counter(x for own in lists for x in own)
        assert op10_jaccard.merge_skip(lists, t) == sorted((x, c) for x, c in count.items() if c >= t)


def test_links():
    rng = np.random.default_rng(7)
    for _ in range(40):
        bases = [rng.integers(0, 2**63, rng.integers(3, 60), dtype=np.uint64) for _ in range(4)]
        sets = []
        for _ in range(30):
            s = bases[rng.integers(0, 4)].copy()
            for _ in range(rng.integers(0, 1 + len(s) // 5)):
                s[rng.integers(0, len(s))] = rng.integers(0, 2**63)
            sets.append(np.unique(s))
        groups = rng.integers(0, 2, len(sets))
        near = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
        want, got = op10_jaccard.Forest(len(sets)), op10_jaccard.Forest(len(sets))
        for i in range(len(sets)):
            for j in range(i):
                if groups[i] == groups[j] and near(sets[i], sets[j]):
                    want.join(i, j)
        for a, b in op10_jaccard.links(sets, groups):
            assert near(sets[a], sets[b])
            got.join(a, b)
        # Sets of both groups may share an index; links across them are no fault.
        assert all(got.root(i) == got.root(j) for i in range(len(sets)) for j in [want.root(i)])


def test_jaccard_links_of_rare_keys(spark):
    """Pairs just above the bound, among texts that make some of their shingles frequent."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(40):
        base = [f"p{i}w{j}" for j in range(84 + int(rng.integers(0, 12)))]
        other = base[: int(len(base) * 0.9) - 1] + [f"q{i}w{j}" for j in range(rng.integers(0, 8))]
        rows += [(4 * i, " ".join(base)), (4 * i + 1, " ".join(other))]
        rows += [(1000 + 40 * i + k, " ".join([*base[: rng.integers(10, 60)], *(f"r{i}k{k}w{j}" for j in range(30))])) for k in range(3)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    same(map(tuple, op10_jaccard.jaccard_components(d).collect()), brute_components(rows))


@pytest.mark.parametrize("name", ["op2_substrings", "op10_jaccard"])
def test_sql(spark, sf, name):
    import duckdb

    from twinfold.llm.queries import ORACLE_SQL

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    df = QUERIES[name](spark, sf)
    assert sorted(columns) == sorted(df.columns)
    same([tuple(r) for r in df.select(*columns).collect()], want.fetchall())
