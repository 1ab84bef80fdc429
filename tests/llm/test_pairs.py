"""Operators across documents: near duplicates, substrings, decontamination, pages, and the pipeline."""

import hashlib
import random
import re
from collections import Counter, defaultdict

from cohortarium.llm import decontaminate, jaccard, membership, pages, queries, substrings
from cohortarium.llm.components import components

from .conftest import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def linked(texts, width, percent):
    """(shingles, component) by document, from all pairs."""
    sets = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(set)
    for i, s in sets.items():
        for g in s:
            by[g].add(i)
    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in by[g] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_near_duplicates(spark, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op7_ngram_jaccard(spark, DATA).collect()}
    assert got == linked(texts, 3, 90)


def test_near_duplicate_chains(spark, monkeypatch):
    """Families whose members drift away from the first: links that no leader sees must still be found."""
    random.seed(2)
    texts, n = {}, 0
    for family in range(6):
        words = [f"f{family}w{k}" for k in range(40 + 15 * family)]
        for _ in range(40):
            texts[n] = " ".join(words)
            n += 1
            for _ in range(random.choice((0, 0, 1, 2))):
                words[random.randrange(len(words))] = f"x{random.randrange(10**6)}"
    order = list(texts)
    random.shuffle(order)
    texts = {i: texts[j] for i, j in enumerate(order)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for width, percent, small in ((3, 90, 64), (5, 80, 3), (1, 70, 64)):
        monkeypatch.setattr(jaccard, "SMALL", small)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, width, percent).collect()}
        assert got == linked(texts, width, percent)


def test_bitmaps_never_rule_out_a_link():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 700)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.95], rng.integers(0, 2**63, rng.integers(0, 20)).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        x, y = jaccard.bitmap(a), jaccard.bitmap(b)
        if len(b) and 100 * both >= 90 * (len(a) + len(b) - both):
            assert jaccard.may_link(len(a), int.from_bytes(x, "little"), 8 * len(x), len(b), int.from_bytes(y, "little"), 8 * len(y), 90)


def test_near_duplicates_odd_rows(spark, odd_documents, no_documents):
    rows = jaccard.near_duplicates(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    got = {r.doc_id: r for r in rows}
    assert got[8].component_id == got[1].component_id == 1 and got[2].n_shingles == got[3].n_shingles == got[4].n_shingles == 0 and got[2].component_id == 2
    kept = jaccard.one_of_each(odd_documents)
    assert kept.columns == odd_documents.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 5, 6, 7] and ids.count(None) == 2
    assert jaccard.near_duplicates(no_documents).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 90), (90, 95), (7, 7), (200, 201), (201, 200)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 90: 90, 95: 90, 100: 90, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_membership(spark, odd_documents):
    ids = spark.createDataFrame([(1,), (5,)], "doc_id long")
    assert sorted(r.doc_id for r in membership.only_ids(odd_documents, ids).collect()) == [1, 5, 5]
    assert membership.without_ids(odd_documents, ids).count() == odd_documents.count() - 3
    assert membership.one_row_an_id(odd_documents).count() == odd_documents.count() - 2


def deduplicated(rows, width=13):
    """(doc_id, n_words, n_removed, digest) of every row, by looking at every window."""
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - width + 1) if i is not None else ():
            g = tuple(w[k : k + width])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, w in words:
        gone = {k + j for k in range(len(w) - width + 1) if i is not None and first[tuple(w[k : k + width])] < i for j in range(width)}
        out.append((str(i), len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out)


def shape(df):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_substring_dedup(spark, documents, odd_documents, no_documents):
    assert shape(queries.op5_substring_dedup(spark, DATA)) == deduplicated([(r.doc_id, r.text) for r in documents.collect()])
    assert shape(substrings.deduplicated(odd_documents)) == deduplicated([(r.doc_id, r.text) for r in odd_documents.collect()])
    assert substrings.deduplicated(no_documents).count() == 0


def test_substring_dedup_of_overlapping_passages(spark):
    """Passages that begin and end anywhere, repeat inside a document and consist of few words."""
    random.seed(6)
    source = [random.choice("abc") + str(random.randrange(6)) for _ in range(400)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(random.randrange(1, 5)):
            a = random.randrange(380)
            w += source[a : a + random.randrange(5, 60)] + [f"own{random.randrange(40)}"] * random.randrange(3)
        rows.append((i * 3 % 61, " ".join(w)))
    rows.append((99, "und " * 300))
    rows.append((98, "und " * 40))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert shape(substrings.deduplicated(df)) == deduplicated(rows)
    texts = {r.doc_id: r.text for r in substrings.deduplicated(df, keep_text=True).collect()}
    assert texts[99] == ""


def test_lcs():
    random.seed(1)
    for _ in range(300):
        a, b = ([random.randrange(-1, 5) for _ in range(random.randrange(0, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y and x >= 0 else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.lcs(a, b) == t[-1][-1]


def test_decontamination_recall(spark):
    """Of the items that a search over all windows settles, the latent candidates hold nine in ten and more."""
    folder = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    random.seed(5)
    base = [r.text.split() for r in docs.limit(300).collect() if len(r.text.split()) > 60]
    planted = []
    for i, t in items.items():
        w = [x if random.random() > 0.1 else random.choice(random.choice(base)) for x in t.split()]
        c = random.choice(base)
        at = random.randrange(len(c))
        planted.append((100_000 + i, " ".join(c[:at] + w + c[at:])))
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(both, bench).collect()}
    every = {(r.doc_id, r.item_id) for r in decontaminate.leaks(both, bench, cosine=-9.0).collect()}
    assert found <= every and len(found) >= 0.95 * len(every)
    plain = lambda t: [decontaminate.plain(x) for x in (t or "").encode().split()]
    said = {i: b" " + b" ".join(plain(t)) + b" " for i, t in items.items()}
    verbatim = {(r.doc_id, i) for r in docs.collect() for x in [b" " + b" ".join(plain(r.text)) + b" "] for i, s in said.items() if s in x}
    assert verbatim <= found
    assert len({d for d, _ in found if d < 100_000} - {d for d, _ in verbatim}) <= 3
    kept = {r.doc_id for r in decontaminate.without_leaks(both, bench).collect()}
    assert kept == {r.doc_id for r in both.collect()} - {d for d, _ in found}


def test_decontamination_odd_rows(spark, odd_documents, no_documents):
    bench = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "the quick brown fox jumps over the lazy dog near the river bank today", "x"), (None, "word1x1", "x")], "item_id long, text string, lcs string")
    got = sorted((r.doc_id, r.item_id or 0, r.lcs, r.n_item_words, r.verbatim) for r in decontaminate.leaks(odd_documents, bench).collect())
    assert got == [(1, 3, 14, 14, True), (5, 0, 1, 1, True), (5, 0, 1, 1, True), (8, 3, 14, 14, True)]
    kept = decontaminate.without_leaks(odd_documents, bench)
    assert kept.columns == odd_documents.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 2, 3, 4, 6, 6, 7]
    assert decontaminate.leaks(odd_documents, bench.filter("1 = 0")).count() == 0
    assert decontaminate.leaks(no_documents, bench).count() == 0
    assert decontaminate.without_leaks(odd_documents, bench.filter("1 = 0")).count() == odd_documents.count()


def test_decontamination_recall_beyond_the_sample(spark):
    """On more documents than the space is fitted on and more passages than its rank, against what was planted."""
    folder = "/root/testdata/sf0.1"
    docs, bench = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{folder}/benchmark.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    items = {r.item_id: r.text for r in bench.collect()}
    assert len(texts) > decontaminate.FIT_DOCUMENTS and len(items) > decontaminate.RANK
    random.seed(5)
    base = [t.split() for _, t in sorted(texts.items())[:3000] if len((t or "").split()) > 60]
    planted = []
    for i, t in items.items():
        w = [x if random.random() > 0.1 else random.choice(random.choice(base)) for x in t.split()]
        c = random.choice(base)
        at = random.randrange(len(c))
        planted.append((1_000_000 + i, " ".join(c[:at] + w + c[at:])))
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs.unionByName(spark.createDataFrame(planted, "doc_id long, text string")), bench).collect()}
    plain = lambda t: b" " + b" ".join(decontaminate.plain(x) for x in (t or "").encode().split()) + b" "
    said = {i: plain(t) for i, t in items.items()}
    verbatim = {(d, i) for d, t in texts.items() for x in [plain(t)] for i, s in said.items() if s in x}
    held = sum((1_000_000 + i, i) in found for i in items)
    print("planted found", held, len(items), "verbatim found", len(verbatim & found), len(verbatim))
    assert verbatim <= found and held >= 0.95 * len(items)


def test_space_of_all_documents(spark, monkeypatch):
    """Words and decomposition are those of every document: against counts and passages held in one place."""
    import numpy as np

    monkeypatch.setattr(decontaminate, "COUNTED", 50)
    random.seed(9)
    texts = [" ".join(f"W{random.randrange(40 + k // 4)}," for _ in range(random.randrange(5, 120))) for k in range(2400)]
    items = [[f"w{random.randrange(700)}".encode() for _ in range(40)] for _ in range(6)]
    space = decontaminate.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), items)
    words = [[decontaminate.plain(x) for x in t.encode().split()] for t in texts]
    often = Counter(w for said in words for w in set(said))
    own = {w for x in items for w in x}
    assert set(space.words) == own | {w for w, n in often.items() if n > 1}
    idf = [0.0 if often[w] > decontaminate.COMMON * 2400 else np.log(2401 / (1 + often[w])) for w in space.words]
    assert np.allclose(space.idf, idf)
    vocabulary, q = decontaminate.Vocabulary(space.words), np.random.default_rng(1).standard_normal((len(idf), 5)).astype(np.float32)
    want = np.zeros(q.shape)
    for said in words[:300]:
        for ids in decontaminate.passages(vocabulary.ids(said)):
            a = np.zeros(len(idf))
            np.add.at(a, ids[ids >= 0], np.array(idf)[ids[ids >= 0]])
            square = (np.array(idf)[ids[ids >= 0]] ** 2).sum()
            want += np.outer(a, a @ q) / square if square else 0.0
    got = decontaminate.spread(decontaminate.Space(space.words, space.idf, q, 0.0), (vocabulary.ids(x) for x in words[:300]), 1.0)
    assert np.allclose(got, want, rtol=1e-3, atol=1e-3)


def test_decontamination_sums_counts_and_bounds(monkeypatch):
    """Sums, counts and word numbers against plain ones; no subsequence is measured where a count of words rules it out."""
    import numpy as np

    random.seed(4)
    rng = np.random.default_rng(4)
    rows, at = rng.standard_normal((50, 3)).astype(np.float32), rng.integers(0, 50, 3000)
    for first in ([0], [0, 1, 2, 40, 41, 700, 2999], list(range(0, 3000, 7))):
        got = decontaminate.summed(rows, at, np.array(first))
        assert np.allclose(got, np.add.reduceat(rows[at], first), atol=1e-3) and len(got) == len(first)
    assert decontaminate.summed(rows, at[:0], at[:0]).shape == (0, 3)
    some = [b"Ab", b"ab,", b"ab", b"...", b",", b"(x)", b"X", b"\xc3\x89t.", b"\xc3\xa9t"] + [f"w{k}{'.' * (k % 3)}".encode() for k in range(3000)]
    texts = [random.choices(some, k=random.randrange(60)) for _ in range(400)]
    tally = decontaminate.Tally()
    for t in texts:
        tally.add([w.lower() for w in t])
    want = Counter(w for t in texts for w in {decontaminate.plain(x) for x in t})
    assert dict(zip(*(x.to_pylist() for x in tally.batch().columns), strict=True)) == want
    words = sorted(want)[::2]
    vocabulary, numbers = decontaminate.Vocabulary(words), {w: i for i, w in enumerate(words)}
    assert all(vocabulary.ids(t).tolist() == [numbers.get(decontaminate.plain(x), -1) for x in t] for t in texts)
    item = decontaminate.Item(1, [b"%d" % k for k in range(20)], np.arange(20), np.ones(20))
    measured = []
    monkeypatch.setattr(decontaminate, "lcs", lambda a, b, lcs=decontaminate.lcs: measured.append(b) or lcs(a, b))
    assert item.settle([*range(11), *range(30, 90), *range(11)]) is None and not measured
    assert item.settle([5, *range(16), -1]) == (16, True) and item.settle([*range(8, 20), 52]) is None and len(measured) == 3


def test_decontamination_of_common_words(spark):
    """Items whose words are common: in a group of copies with more than 12 % of the rows, and in a table of few rows."""
    random.seed(8)
    some = lambda n: [f"w{random.randrange(5000)}" for _ in range(n)]
    item, body = some(30), some(200)
    swapped = [w if k % 6 else "otherwise" for k, w in enumerate(item)]
    rows = [(i, " ".join(body[:100] + item + body[100:])) for i in range(60)] + [(60 + i, " ".join(some(150))) for i in range(120)]
    rows += [(1000, " ".join(some(70) + item + some(70))), (1001, " ".join(some(70) + swapped + some(70))), (1002, " ".join(item[:15] + some(300) + item[15:]))]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(some(30)))], "item_id long, text string")
    got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id, r.verbatim) for r in got} == {(i, 1, True) for i in (*range(60), 1000, 1001)} and len(got) == 62
    few = spark.createDataFrame([rows[0], rows[70], rows[71]], "doc_id long, text string")
    assert [(r.doc_id, r.item_id, r.lcs) for r in decontaminate.leaks(few, bench).collect()] == [(0, 1, 30)]
    assert [r.doc_id for r in decontaminate.without_leaks(few, bench).orderBy("doc_id").collect()] == [70, 71]


def article(html):
    import html as h

    m = re.search(r"<article>(.*?)</article>", html or "", re.S)
    parts = re.split(r"</?(?:p|h1)>", m[1]) if m else []
    lines = [" ".join(h.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in parts]
    return "\n".join(x for x in lines if x)


def test_pages(spark, some):
    want = {r.page_id: (r.url, article(r.html)) for r in some("pages").collect()}
    got = queries.op3_html_extraction(spark, DATA).collect()
    assert {r.page_id: (r.url, r.text) for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_page_differencing(spark):
    """Pages without articles: what neighbours on one host share goes, what is the page's own stays."""
    frame = "<html><body><div>Site name</div><p>Buy now</p>{}<p>All about us</p></body></html>"
    rows = [(i, f"https://h.example/a/{i:03d}.html?x={i}", frame.format(f"<p>own   text {i} &amp;lt;</p><div>more {i}</div>")) for i in range(200)]
    rows += [(500, "http://other.example/", frame.format("<p>alone</p>")), (501, None, None), (502, "x", ""), (503, "http://h2.example/1", "<article><p>same</p></article>"), (504, "http://h2.example/2", "<nav>n</nav><article><p>same</p></article><aside>s</aside>")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: r.text for r in pages.extract(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == f"own text {i} &lt;\nmore {i}" for i in range(200))
    assert got[500] == "Site name\nBuy now\nalone\nAll about us" and got[501] == got[502] == "" and got[503] == got[504] == "same"
    assert pages.extract(df.filter("1 = 0")).count() == 0


def test_page_copies(spark):
    """Copies without an article, repeated rows among them, keep their text and lose what a page that differs shares."""
    page = "<html><body><div>Site name</div><p>Buy now</p>{}<p>All about us</p></body></html>"
    body = "a long text that stands on several pages of the host, word for word, and is longer than the site's own lines are together, " * 4
    rows = [(0, "http://h.example/a", page.format("<p>first</p>"))] + [(i, f"http://h.example/b/{i}", page.format(f"<p>{body}</p>")) for i in (1, 2, 2, 3)]
    rows += [(4, "http://h.example/b/4", page.format(f"<p>Mirror</p><p>{body}</p>")), (5, "http://h.example/c", page.format("<p>last</p>"))]
    rows += [(i, "http://copied.example/", page.format(f"<p>{body}</p>")) for i in (6, 6)]
    got = sorted((r.page_id, r.text) for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    alone = f"Site name\nBuy now\n{body.strip()}\nAll about us"
    assert got == [(0, "first"), *((i, body.strip()) for i in (1, 2, 2, 3)), (4, f"Mirror\n{body.strip()}"), (5, "last"), (6, alone), (6, alone)]


def test_pages_with_an_article_beside_the_text(spark):
    """A teaser or a comment in an article element doesn't take the place of text in divs."""
    page = '<div>Site name</div><div><p>body {0}</p></div><article><p>teaser {0}</p></article><article class="post comment"><p>remark {0}</p></article><article class="no-comments"><p>more {0}</p></article><p>All about us</p>'
    df = spark.createDataFrame([(i, f"http://h.example/{i}", page.format(i)) for i in range(6)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in pages.extract(df).collect()} == {i: f"body {i}\nteaser {i}\nmore {i}" for i in range(6)}


def test_page_lines():
    kept = lambda h: [x[0] for x in pages.lines(h) if not x[2]]
    assert kept('<script>var t="</p><p>no";</script><p>a<b>b</b><br>c<p>d<!-- <p>no --><ul><li>e<li>f</ul>') == ["ab c", "d", "e", "f"]
    assert kept('<div class="sidebar"><p>no</div><div id="user-comments">no</div><header>no</header><form>no</form><div role=navigation>no</div><div hidden>no</div><p title=">">yes') == ["yes"]
    assert kept("<style>p{}</style><textarea><p>no</textarea><p>x &lt;p&gt; &#233;") == ["x <p> é"]


def test_shared_lines():
    random.seed(3)
    for _ in range(200):
        a, b = ([random.choice("abcd") for _ in range(random.randrange(9))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        shared = pages.shared_lines(a, b)
        assert len(shared) == t[-1][-1]
        it = iter(b)
        assert all(a[i] in it for i in sorted(shared))


def test_pipeline(spark):
    """The stages by name, against plain versions of what they decide."""
    import corpus_pipeline
    from cohortarium.llm.packing import token_pieces
    from cohortarium.llm.quality import fit, judge
    from cohortarium.llm.secrets import redacted

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    good = {r.doc_id for r in judge(docs, fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))).filter("kept").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    first = {i for i, (_, c) in linked(texts, 5, 80).items() if i == c}
    left = docs.filter(docs.doc_id.isin(list(first)))
    leaked = {r.doc_id for r in decontaminate.leaks(left, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    final = spark.createDataFrame([(i, redacted(texts[i])) for i in sorted(first - leaked)], "doc_id long, text string")
    want = sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in token_pieces(final).collect())
    got = corpus_pipeline.run(spark, DATA)
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in got.collect()) == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "packing"]


def test_pipeline_odd_rows(spark, odd_documents, no_documents, tmp_path):
    import corpus_pipeline

    for k, df in enumerate((odd_documents, no_documents)):
        folder = str(tmp_path / str(k))
        df.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, "nothing like this is anywhere")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        corpus_pipeline.run(spark, folder).collect()


def test_names_of_regions():
    for name in ("sidebar", "user-comments", "siteHeader", "ad-slot", "related-posts", "share_buttons", "cookie-bar", "nav", "menu top"):
        assert pages.boiler_attributes(f' class="{name}"'), name
    for name in ("post-header", "related-work", "ad-free-note", "noticed", "header-image-of-article", "shared-memory", "adsorption"):
        assert not pages.boiler_attributes(f' class="{name}"'), name


def test_long_pages_take_linear_time_and_little_memory():
    import time

    for page in ("<b>" * 20_000 + "</i>" * 20_000, "<b>" * 20_000 + "<div></div>" * 20_000, "<p><b>" * 20_000, "<div>" * 20_000 + "</span>" * 20_000, "<td>" * 20_000 + "x"):
        began = time.process_time()
        pages.lines(page)
        assert time.process_time() - began < 6, page[:10]
    a, b = [f"x{i % 7000}" for i in range(12_000)], [f"x{i * 7 % 7000}" for i in range(12_000)]
    began = time.process_time()
    found = pages.common_subsequence(a, b)
    assert time.process_time() - began < 30 and all(a[i] == b[j] for i, j in found) and all(x > y and v > w for (x, v), (y, w) in zip(found, found[1:]))
