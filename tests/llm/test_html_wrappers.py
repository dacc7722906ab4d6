"""Operator 9 on pages without article elements, on hosts of several templates, and on odd shapes."""

import random
from functools import lru_cache

import pytest

from framewright.llm import html


def page(body):
    return f"<!DOCTYPE html><html><head><title>t</title></head><body>{body}</body></html>"


def words(r, n):
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(r.randrange(99)) for _ in range(n))


#: Templates without article elements: what stands around the blocks of the article, which are put in at {}.
TEMPLATES = [
    "<div id=top><a href=/>home</a> <a href=/b>about</a></div><div class='post-{n} entry utility'>{}</div><div class=sidebar><p>{other}</p></div><div id=foot>same on all</div>",
    "<table><tr><td><a href=/x>x</a><td class=text>{}</table><p class=legal>The same words of law on every page of this host, which are many.</p>",
    "<div class=page><div class=nav-bar><ul><li>{other}</ul></div><section class=story>{}<div class='ad-slot box'>{other}</div></section></div><footer><p>{other}</p></footer>",
]


def article(r):
    out = [("h2", words(r, 4))]
    for _ in range(r.randint(3, 8)):
        out.append(("p", words(r, r.randint(12, 40))))
    at = r.randint(2, len(out))
    return [*out[:at], ("ul", [words(r, 3) for _ in range(r.randint(1, 4))]), *out[at:]]


def marked(parts):
    return "".join(f"<ul>{''.join(f'<li>{x}' for x in said)}</ul>" if tag == "ul" else f"<{tag}>{said}</{tag}>" for tag, said in parts)


def lines(parts):
    return "\n".join(x for tag, said in parts for x in (said if tag == "ul" else [said]))


def test_articles_of_unmarked_templates(spark):
    r = random.Random(1)
    rows, want = [], {}
    for n in range(90):
        parts = article(r)
        body = TEMPLATES[n % 3].replace("{n}", str(n)).replace("{other}", words(r, 9)).replace("{}", marked(parts))
        rows.append((n, f"http://h{n % 2}.org/{n}", page(body)))
        want[n] = lines(parts)
    got = {x["page_id"]: x["text"] for x in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_one_article_page_takes_nothing_from_others(spark):
    r = random.Random(2)
    parts = [article(r) for _ in range(12)]
    rows = [(n, "http://mixed.org/x", page(f"<article>{marked(p)}</article>" if n == 5 else f"<div class=body>{marked(p)}</div>")) for n, p in enumerate(parts)]
    got = {x["page_id"]: x["text"] for x in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {n: lines(p) for n, p in enumerate(parts)}


def test_deep_and_wide_pages(spark):
    deep = "<div>" * 1500 + "<p>deep one</p>" + "</div>" * 1500
    open_ = page("".join(f"<div><p>w{k}</p>" for k in range(3000)))
    wide = page("<div>" + "<p>a</p><ul><li>b</ul>" * 4000 + "</div>")
    rows = [(0, "http://d.org/a", deep), (1, "http://d.org/b", deep.replace("one", "two")), (2, "http://d.org/c", wide), (3, "http://d.org/d", wide), (None, None, open_)]
    got = sorted((x["page_id"] is None, x["page_id"] or 0, x["n_chars"]) for x in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert [g[2] for g in got[:4]] == [8, 8, 15_999, 15_999] and got[4][2] > 0


def test_names_count_as_a_whole():
    kept = "<div class=related-work><p>r</p></div><section class='market-share'><p>m</p></section><div class='social-history text'><p>s</p></div>"
    lost = "<div class='a b c d e f g h sidebar'><p>1</p></div><section class=notice><p>2</p></section><div class=share-bar>3</div><div class='post-comments'><p>4</p></div>"
    assert html.main_text(page(f"<article><p>first</p>{kept}{lost}</article>"), None) == "first\nr\nm\ns"


@pytest.mark.parametrize("seed", range(4))
def test_alignment_is_exact(seed):
    r = random.Random(seed)
    for _ in range(100):
        a, b = ([r.randrange(3 + seed) for _ in range(r.randrange(40))] for _ in range(2))

        @lru_cache(None)
        def best(i, j):
            return 0 if i == len(a) or j == len(b) else best(i + 1, j + 1) + 1 if a[i] == b[j] else max(best(i + 1, j), best(i, j + 1))  # noqa: B023

        found = html.common(a, b)
        assert len(found) == best(0, 0) and all(a[i] == b[j] for i, j in found)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:], strict=False))


def test_wrapper_has_optional_and_repeated_groups_at_any_depth():
    pages = [page("<div>" * 300 + body) for body in ("<h1>a</h1><p>x</p>", "<p>x</p><ul><li>1<li>2</ul>", "<p>y</p>")]
    said = html.wrapper(pages).expression()
    assert "(<h1>a</h1>)?" in said and "(<ul><li>(#SLOT)+</li></ul>)?" in said and "<p>#SLOT</p>" in said


TERMS = "The same words of law on all pages of the kind, which are many more than those of a short text. " * 4


def test_wrappers_come_from_all_pages_of_a_host(spark):
    """Three pages of a kind among 300: by itself each would give its terms, together they show that these are the same."""
    kinds = ["<div class=body><p>Plain text {0} of some length.</p></div>", f"<div class=terms><p>{TERMS}</p><p>And more.</p></div><div class=short><p>Text {{0}}.</p></div>"]
    rows = [(n, "http://big.org/x", page(kinds[n % 100 == 50].format(n))) for n in range(300)]
    got = {x["page_id"]: x["text"] for x in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert got == {n: f"Text {n}." if n % 100 == 50 else f"Plain text {n} of some length." for n in range(300)}


def test_a_text_of_half_the_pages_is_no_constant(spark):
    """Half the pages have the same long text, so it is an article's; with a page more it is the host's own. Copies of a page count once."""
    body = "<div class=terms><p>{0}</p><p>And more.</p></div><div class=short><p>Text {1}.</p></div>"
    for more in (0, 1):
        pages = [page(body.format(TERMS if n < 20 + more else f"Law {n}.", n)) for n in range(40)]
        pages += [pages[0], pages[39]] * 60
        rows = [(n, "http://half.org/x", p) for n, p in enumerate(pages)]
        known = html.regions(pages)
        got = {x["page_id"]: x["text"] for x in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)).collect()}
        assert got == {n: html.main_text(p, known) for n, p in enumerate(pages)}
        assert got[3] == ("Text 3." if more else f"{TERMS.strip()}\nAnd more.")


def mixed_hosts(seed, n=240):
    """Pages of hosts of several kinds, with texts that few, half or most pages share, unlike class names, and copies."""
    r = random.Random(seed)
    shared = [words(r, k) for k in (3, 12, 40, 80)]
    out = []
    for _ in range(n):
        h, kind = r.choice([0, 0, 0, 1, 2]), r.randrange(3)
        parts = "".join(f"<div class='{c}{r.choice(['', '', ' x' + words(r, 1)])}'><p>{r.choice([shared[(kind + k + h) % 4]] * (k + 1) + [words(r, r.randint(2, 20))])}</p>{r.choice(['', '<ul><li>one<li>two</ul>', '<h2>h</h2>'])}<p>{words(r, 2)}</p></div>" for k, c in enumerate("abc"[: kind + 1]))
        out.append((f"http://h{h}.org/", page(f"<div class=k{'abc'[kind]}>{parts}</div>")))
        out += [out[-1]] * (r.random() < 0.1) * 9
    return out


@pytest.mark.parametrize("most", [html.BROADCAST, -1])
def test_parts_of_a_host_give_what_all_its_pages_give(spark, monkeypatch, most):
    monkeypatch.setattr(html, "BROADCAST", most)
    monkeypatch.setattr(html, "TEMPLATES", most)
    rows = mixed_hosts(3)
    by = {}
    for url, p in rows:
        by.setdefault(url, []).append(p)
    known = {url: html.regions(pages) for url, pages in by.items()}
    alone = [html.main_text(p, None) for _, p in rows]
    want = [html.main_text(p, known[url]) for url, p in rows]
    assert sum(a != b for a, b in zip(alone, want, strict=True)) > 20
    df = spark.createDataFrame([(n, u, p) for n, (u, p) in enumerate(rows)], "page_id long, url string, html string").repartition(6)
    assert {x["page_id"]: x["text"] for x in html.extract(df).collect()} == dict(enumerate(want))


@pytest.mark.parametrize("most", [1, 40, 2000])
def test_full_wrappers_add_up(monkeypatch, most):
    monkeypatch.setattr(html, "GROUPS", most)
    roots = []
    for _, p in mixed_hosts(4, 60):
        paths = html.Paths()
        events = list(html.texts(p, paths))
        roots.append(html.stream(events, paths))
        one = html.unpacked(html.packed(roots[-1]))
        assert [(g.name, g.free, g.off, g.repeated, g.optional, len(g.parts)) for g in one.below()] == [(g.name, g.free, g.off, g.repeated, g.optional, len(g.parts)) for g in roots[-1].below()]
        assert html.own_region(events, paths) == html.region(roots[-1])
    want = html.Masses()
    for root in roots:
        want.add(root)
    got = html.Masses()
    several = list(html.gathered(roots))
    for root in several:
        got.add(root)
    by_path = lambda m: {tuple(m.path(at)): (m.slots[at], m.free[at]) for at in range(len(m.up))}
    assert by_path(got) == by_path(want) and (len(several) > 1) == (most < 2000)
