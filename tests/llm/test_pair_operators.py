"""Operators 5, 7, 9 and 10 and the pipeline against brute force, with odd inputs."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from compare import SF, same

import corpus_pipeline
from framewright.llm import common, decontaminate, embeddings, html, simhash
from framewright.llm.queries import QUERIES, SQL


def groups(n, linked):
    """Least member that links lead to, for 0..n-1."""
    label = list(range(n))
    for a, b in linked:
        x, y = label[a], label[b]
        if x != y:
            label = [min(x, y) if v in (x, y) else v for v in label]
    return label


@pytest.mark.parametrize("last", [0, 20, common.LAST])
def test_components(spark, last):
    r = random.Random(1)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)] + [(7, 7), (None, 3)]
    got = {x["node"]: x["root"] for x in common.components(spark.createDataFrame(edges, "a long, b long"), last=last).collect()}
    sound = [(a, b) for a, b in edges if a is not None and a != b]
    want = groups(161, sound)
    nodes = {x for e in sound for x in e}
    assert set(got) == nodes and all((got[x] == got[y]) == (want[x] == want[y]) for x in nodes for y in nodes)
    assert common.components(spark.createDataFrame([], "a long, b long"), last=last).count() == 0


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_simhash(rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    linked = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    label = groups(len(rows), linked)
    least = {}
    for (d, _), g in zip(rows, label, strict=True):
        if d is not None:
            least[g] = min(least.get(g, d), d)
    return sorted(((d, f"{p:016x}", least.get(g)) for (d, _), p, g in zip(rows, prints, label, strict=True)), key=repr)


def test_simhash(docs):
    r = random.Random(2)
    base = [" ".join(r.choice(["alpha", "Beta", "gamma", "d", "ÉTÉ"]) for _ in range(80)) for _ in range(6)]
    texts = base + [t.replace("alpha", "delta", 1) for t in base] + [t + " end" for t in base] + [base[0], None, "", " \t", "one", "one two", "ONE two three", "w " * 30_000]
    rows = list(enumerate(texts)) + [(2, texts[2]), (None, texts[1]), (None, "alone in here now")]
    got = sorted((tuple(x) for x in simhash.near_duplicates(docs(rows)).collect()), key=repr)
    assert got == brute_simhash(rows)
    assert simhash.near_duplicates(docs([])).count() == 0


def near_prints(seed, n=400):
    r = np.random.default_rng(seed)
    base = r.integers(0, 1 << 63, 12, dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, (3, n), dtype=np.uint64))
    return np.unique(np.r_[base[r.integers(0, 12, n)] ^ flips, base, np.uint64(0)])


@pytest.mark.parametrize("bucket", [8, 64, 1 << 13])
def test_gray_index_is_exact(spark, bucket):
    prints = near_prints(bucket)
    want = groups(len(prints), [(a, b) for a in range(len(prints)) for b in range(a) if int(prints[a] ^ prints[b]).bit_count() <= 3])
    found = simhash.links(spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long"), most=bucket)
    root = {x["node"]: x["root"] for x in common.components(found).collect()}
    mine = [root.get(int(x), int(x)) for x in prints.view(np.int64)]
    assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))


def test_gray_order_and_pruning():
    codes = np.arange(16, dtype=np.uint64)
    inverse = codes ^ (codes >> np.uint64(1))
    assert (simhash.gray_rank(inverse) == codes).all()


def test_simhash_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((tuple(x) for x in QUERIES["op10_simhash_near_dedup"](spark, SF).collect()), key=repr) == brute_simhash(rows)


def shingles(words):
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_leaks(rows, items):
    out = {}
    for d, t in rows:
        w = (t or "").lower().split()
        for i, text in items:
            iw = (text or "").lower().split()
            if not iw or not w:
                continue
            c = shingles(iw)
            for s in range(max(1, len(w) - len(iw) + 1)):
                v = shingles(w[s : s + len(iw)])
                if len(iw) > 4 > len(w[s : s + len(iw)]) - 1 and len(w) < 5:
                    continue
                both = sum((v & c).values())
                score = both / (sum(v.values()) + sum(c.values()) - both)
                if score >= 0.8:
                    out[d, i] = max(out.get((d, i), 0), score)
    return out


@pytest.mark.parametrize("large", [False, True])
def test_leaks(spark, docs, monkeypatch, large):
    if large:
        monkeypatch.setattr(decontaminate, "BROADCAST", 0)
    r = random.Random(3)
    word = lambda: r.choice("abcdefghijklmnopqrstuvwxyz") + r.choice("0123456789")
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([5, 12, 30, 45, 60, 3, 1])] + [(90, None), (91, ""), (92, " ".join(["again"] * 20))]
    fill = lambda n: " ".join(word() for _ in range(n))
    texts = [f"{fill(40)} {t}\n{fill(9)}" for _, t in items if t] + [" ".join(w if k != 2 else "CHANGED" for k, w in enumerate(t.split())) for _, t in items if t] + [items[3][1].upper(), " ".join(items[4][1].split()[3:]), None, "", "x", fill(5000) + " " + items[2][1], fill(300)]
    rows = list(enumerate(texts)) + [(0, texts[0])]
    got = {(x["doc_id"], x["item_id"]): x["similarity"] for x in decontaminate.leaks(docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_leaks(rows, items)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in got)


@pytest.mark.parametrize("large", [False, True])
def test_leaks_of_reordered_items(spark, docs, monkeypatch, large):
    if large:
        monkeypatch.setattr(decontaminate, "BROADCAST", 0)
    r = random.Random(8)
    some = lambda n: [f"v{r.randrange(5000)}" for _ in range(n)]
    items = [(i, some(n)) for i, n in enumerate([50, 60, 90])]
    texts = [some(70) + t[cut:] + t[:cut] + some(40) for _, t in items for cut in (len(t) // 2, 10, len(t) - 12)] + [t[25:] + t[:25] for _, t in items] + [some(300)]
    rows = [(d, " ".join(t)) for d, t in enumerate(texts)]
    named = [(i, " ".join(t)) for i, t in items]
    got = {(x["doc_id"], x["item_id"]): x["similarity"] for x in decontaminate.leaks(docs(rows), spark.createDataFrame(named, "item_id long, text string")).collect()}
    want = brute_leaks(rows, named)
    assert len(want) == 12 and set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_leaks_empty(spark, docs):
    nothing = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert decontaminate.leaks(docs(["a b c d e f g"]), nothing).count() == 0 and decontaminate.leaks(docs([]), some).count() == 0
    rows = [(0, "a b c d e f g"), (1, "clean"), (2, None), (None, "also clean")]
    kept = decontaminate.clean(docs(rows), some)
    assert kept.columns == docs([]).columns and {x["doc_id"] for x in kept.collect()} == {1, 2, None}
    assert {x["doc_id"] for x in decontaminate.clean(docs([(None, "a b c d e f g"), (3, "x")]), some).collect()} == {3}


def test_clean_keeps_other_rows_of_an_id(spark, docs):
    some = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    rows = [(None, "a b c d e f g"), (None, "clean"), (None, None), (4, "x a b c d e f g"), (4, "of other words"), (4, "of other words")]
    kept = [(x["doc_id"], x["text"]) for x in decontaminate.clean(docs(rows), some).collect()]
    assert sorted(kept, key=repr) == sorted([rows[1], rows[2], rows[4], rows[5]], key=repr)


def test_leaks_stay_native(spark):
    found = QUERIES["op5_decontamination"](spark, SF)
    assert not re.search("Python|Pandas|Arrow", found._jdf.queryExecution().executedPlan().toString())
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    known = {s for _, t in items for s in shingles(t.lower().split())}
    rows = [r for r in rows if known & set(shingles((r[1] or "").lower().split()))]
    assert {(x["doc_id"], x["item_id"]): x["similarity"] for x in found.collect()} == brute_leaks(rows, items)


def brute_vectors(rows):
    clean = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            clean[i, tuple(v)] = np.array(v, float) / np.linalg.norm(v)
    keys = list(clean)
    linked = [(a, b) for a in range(len(keys)) for b in range(a) if len(keys[a][1]) == len(keys[b][1]) and clean[keys[a]] @ clean[keys[b]] >= 0.95]
    label = groups(len(keys), linked)
    n = Counter(x for e in linked for x in e)
    out = []
    for i, v in rows:
        k = keys.index((i, tuple(v))) if v and (i, tuple(v)) in clean else None
        root = min(keys[j][0] for j in range(len(keys)) if label[j] == label[k]) if k is not None else i
        out.append((i, n[k] if k is not None else 0, root, i is None or i == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1024, 4])
def test_vectors(spark, block):
    r = np.random.default_rng(4)
    centres = r.normal(size=(8, 16))
    rows = [(int(i), (centres[i % 8] + r.normal(scale=[0.05, 0.2, 0.24][i % 3], size=16)).astype(np.float32).tolist()) for i in range(120)]
    rows += [(200 + i, rows[5][1]) for i in range(7)] + [(300, [2 * x for x in rows[5][1]]), (301, None), (302, [0.0] * 16), (303, [None, 1.0]), (304, [float("nan")] * 16), (305, [float("inf")] * 16), (306, []), (307, [1.0, 0.0]), (308, [2.0, 0.0]), (None, rows[5][1]), (200, rows[5][1])]
    df = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, label int, key string, n_links string")
    got = sorted((tuple(x) for x in embeddings.near_duplicates(df, block=block).collect()), key=repr)
    assert got == brute_vectors(rows)
    assert embeddings.near_duplicates(df.where("false")).count() == 0


def test_vectors_query_is_sql(spark):
    same(QUERIES["op7_embedding_near_dedup"](spark, SF), SQL["op7_embedding_near_dedup"], SF)


def page(body, head="<title>t</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


CASES = [
    (None, ""),
    ("", ""),
    ("no markup at all", ""),
    (page("<nav><a href=/>menu</a></nav><article><h1>T &amp; U</h1><p>a\n  <b>b</b>&nbsp;c<br>d<p>e<script>x('<p>')</script></article><footer>f</footer>"), "T & U\na b c d\ne"),
    (page("<main><header><h1>T</h1></header><div class='share'>s</div><ul><li>one<li>two</ul><form>q</form><table><tr><td>x<td>y</table></main><aside>n</aside>"), "T\none\ntwo\nx\ny"),
    (page("<article><p>kept</p><section class=comments><p>lost</p></section><!-- <p>no</p> --><p>a < b &lt; c</p><style>p{}</style></article>"), "kept\na < b < c"),
    (page("<nav>open<article><p>unclosed menu</p>"), "unclosed menu"),
    (page("<article><p title='a > b'>quoted</p><noscript>n</noscript></article>"), "quoted"),
    (page("<article>" + "<p>word</p>" * 3000 + "</article>"), "\n".join(["word"] * 3000)),
]


def test_pages(spark):
    rows = [(i, f"http://h{i % 3}.org/{i}" if i % 4 else None, h, "x", "y") for i, (h, _) in enumerate(CASES)]
    df = spark.createDataFrame([*rows, rows[3]], "page_id long, url string, html string, region string, host string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.extract(df).collect()}
    assert got == {i: (t, len(t)) for i, (_, t) in enumerate(CASES)} and html.extract(df).count() == len(rows) + 1
    assert html.extract(df.where("false")).count() == 0


def test_wrapper_of_a_host_without_article(spark):
    body = "<div id=top><a href=/>home</a> <a href=/b>about</a></div><div id=body><h2>Title {0}</h2><p>Text number {0} of some length.</p>{1}</div><div id=foot>same on all</div>"
    pages = [page(body.format(i, "<p>More, at times.</p>" * (i % 3))) for i in range(5)]
    root = html.wrapper(pages)
    assert "(<p>(#SLOT)+</p>" in root.expression() or "<p>(#SLOT)+</p>" in root.expression()
    assert html.region(root) == ["html", "body", "div.body"]
    df = spark.createDataFrame([(i, "http://w.org/x", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    assert {r["text"] for r in html.extract(df).where("page_id = 1").collect()} == {"Title 1\nText number 1 of some length.\nMore, at times."}


def test_optional_and_repeated_groups():
    got = html.wrapper([page("<article><h1>a</h1><p>x</p></article>"), page("<article><p>x</p><p>y</p></article>")]).expression()
    assert "(<h1>a</h1>)?" in got and "<p>(#SLOT)+</p>" in got


def test_pages_of_several_templates(spark):
    main = "<article><p>Text {0} of an article.</p></article>"
    plain = "<div class=body><h2>Title {0}</h2><p>Text {0} of some length.</p></div><div class=sidebar><p>lost</p></div>"
    other = "<table><tr><td><p>Other {0} in a table cell.</p><p>More {0} of it.</p></td></tr></table>"
    kinds = {"a": [main, plain], "b": [plain, other], "": [main, plain, other]}
    rows = [(h, i, p.format(i)) for h, ps in kinds.items() for k, p in enumerate(ps) for i in range(k * 100, k * 100 + (40 if k == 0 else 3))]
    df = spark.createDataFrame([(n, f"http://{h}.org/{i}" if h else None if i % 2 else f"/x/{i}", page(b)) for n, (h, i, b) in enumerate(rows)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    for n, (_, i, b) in enumerate(rows):
        want = f"Text {i} of an article." if "article" in b else f"Title {i}\nText {i} of some length." if "Title" in b else f"Other {i} in a table cell.\nMore {i} of it."
        assert got[n] == want, rows[n]


def test_slots_decide_the_region():
    body = "<div class=terms><p>{1}</p><p>And more of it.</p></div><div class=body><p>Text {0}.</p></div>"
    pages = [page(body.format(i, "The same words of law on all pages. " * 9)) for i in range(5)]
    assert html.region(html.wrapper(pages)) == ["html", "body", "div.body"]
    assert html.main_text(pages[0], html.regions(pages)) == "Text 0." and html.main_text("<div>" * 3000 + "deep", None) == "deep"


def test_all_words_of_a_class_count():
    many = " ".join(f"a{k}" for k in range(12))
    got = html.main_text(page(f"<article><p>kept</p><div class='{many} sidebar'><p>lost</p></div><h2 id=social-impact>Impact</h2><section id=market-share><p>Shares</p></section><div id=share-bar>lost</div></article>"), None)
    assert got == "kept\nImpact\nShares"


def test_pages_query(spark):
    import html as entities

    for r, p in zip(QUERIES["op9_html_extraction"](spark, SF).orderBy("page_id").collect(), spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").collect(), strict=True):
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", p["html"], re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(b for b in blocks if b)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = common.written(stage(spark, docs, SF))
        if name != "bpe_encoding":
            assert out.columns == list(corpus_pipeline.COLUMNS) and dict(out.dtypes) == dict(docs.dtypes)
        seen.append((name, docs, out))
        docs = out
    stage = {name: (a, b) for name, a, b in seen}
    a, b = stage["near_dedup"]
    rows = [(r["doc_id"], r["text"]) for r in a.collect()]
    assert {r["doc_id"] for r in b.collect()} == {c for _, _, c in brute_simhash(rows)}
    a, b = stage["decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    known = {s for _, t in items for s in shingles(t.lower().split())}
    rows = [(r["doc_id"], r["text"]) for r in a.collect()]
    dirty = {d for d, _ in brute_leaks([r for r in rows if known & set(shingles((r[1] or "").lower().split()))], items)}
    assert {r["doc_id"] for r in b.collect()} == {d for d, _ in rows} - dirty
    a, b = stage["line_dedup"]
    assert a.count() == b.count()
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r["doc_id"] for r in docs.collect())


def test_near_dedup_takes_near_copies(spark, docs):
    r = random.Random(11)
    base = [[f"w{r.randrange(900)}" for _ in range(150)] for _ in range(8)]
    texts = [" ".join(b) for b in base]
    for k, b in enumerate(base):
        for changes in (1, 2, 3, 4, 6, 9):
            at = {r.randrange(150) for _ in range(changes)}
            texts.append(" ".join(f"new{k}x{changes}" if i in at else w for i, w in enumerate(b)))
    texts += [texts[0].upper(), "a b", "a  B", "a c", "", None]
    rows = [(d + 5, t) for d, t in enumerate(texts)]
    sets = [set(shingles((t or "").lower().split())) if (t or "").split() else set() for t in texts]
    prints = [brute_fingerprint(t) for t in texts]
    linked = [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0 or (prints[a] ^ prints[b]).bit_count() <= 3]
    want = {x + 5 for x in groups(len(rows), linked)}
    got = {x["doc_id"] for x in corpus_pipeline.near_dedup(spark, docs(rows).select(*corpus_pipeline.COLUMNS), SF).collect()}
    assert got == want and len(want) < len({x["component_id"] for x in simhash.near_duplicates(docs(rows)).collect()})


def test_pipeline_stages_take_odd_rows(spark, docs):
    rows = docs([(0, "the words of the text and the rest of it"), (1, None), (2, ""), (3, "the words of the text and the rest of it"), (None, "the words of the text and more")])
    for name, stage in corpus_pipeline.STAGES[1:]:
        got = stage(spark, rows.select(*corpus_pipeline.COLUMNS), SF)
        assert got.count() == (4 if name == "near_dedup" else 5) - (name == "near_dedup"), name
        assert stage(spark, rows.select(*corpus_pipeline.COLUMNS).where("false"), SF).count() == 0
    assert corpus_pipeline.STAGES[0][1](spark, rows, SF).count() <= 3
    assert corpus_pipeline.STAGES[0][1](spark, rows.where("false"), SF).count() == 0
