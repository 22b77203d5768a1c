import pytest

from ledgerline.llm import wrappers as W

from .helpers import with_clashing_columns

HEAD = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>'


def page(body: str) -> str:
    return f"{HEAD}{body}</body></html>"


MENU = "<nav><ul><li><a href='/a'>A</a></li><li>B</li></ul></nav>"
CASES = {
    "article": (f"{MENU}<article><h1>Head &amp; line</h1><p>One  two\n three</p><p>Four</p></article><footer>F</footer>",
                "Head & line\nOne two three\nFour"),
    "unclosed": ("<article><h1>H</h1><p><b>One.<br><p>Two</p></article>", "H\nOne.\nTwo"),
    "inline": ("<article><p>a<b>b</b> <i>c</i>&nbsp;d<br>e</p></article>", "ab c d e"),
    "sidebar": ("<header><h1>Site</h1></header><main><p>Text</p></main><aside>Side</aside><div class='cookie-notice'>Ok?</div>", "Text"),
    "forms": ("<article><p>Text</p><form><p>Name</p><input value='x'><button>Go</button></form></article>", "Text"),
    "comments": ("<article><p>Text</p><section id='comments'><p>First!</p></section><div class=\"reader-comments\">no</div></article>", "Text"),
    "adverts": ("<div class='ad banner'>Buy</div><article><p>Text</p><div class='advert'>Buy</div><p>More</p></article>", "Text\nMore"),
    "hidden": ("<article><p style='display: none'>no</p><p hidden>no</p><p>Text</p></article>", "Text"),
    "header inside": ("<article><header><h1>Head</h1></header><p>Text</p></article>", "Head\nText"),
    "markup comment": ("<article><!-- <p>no</p> --><p>Text<!-- x --> on</p></article>", "Text on"),
    "no article": (f"{MENU}<div id='content'><p>One long paragraph</p><p>Two</p></div><div class='footer'>F</div>", "One long paragraph\nTwo"),
    "entities": ("<article><p>&lt;b&gt; &#233; &eacute; &amp;amp; &nope; &am</p></article>", "<b> é é &amp; &nope; &am"),
    "lists": ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\nb\nc\nd"),
    "raw": ("<article><p>a</p><script>if (a < b) { '</div>' }</script><noscript>no</noscript><p>b</p></article>", "a\nb"),
    "quotes": ("<article><p title='a > b'>Text</p></article>", "Text"),
    "own names": ("<article><h2 id='social-history'>Social</h2><section id='search-algorithms'><p>Search</p></section>"
                  "<p class='legal'>Legal</p><p id='comments'>Remark</p></article>", "Social\nSearch\nLegal\nRemark"),
    "inline controls": ("<article><p>Press <button>Go</button> or <label>Name</label> it</p></article>", "Press Go or Name it"),
    "names with others": ("<article><div class='ad-slot top'>Buy</div><p>Text</p><ul class='share_buttons'><li>x</ul></article>", "Text"),
    "empty": ("<article></article>", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_main_text(name):
    body, text = CASES[name]
    assert W.text_of(page(body), "/html/body/article!article" if "<article" in body else "") == text


@pytest.mark.parametrize("cut", [5, 60, 200])
def test_cut_off_pages_do_not_fail(cut):
    body = CASES["article"][0]
    whole = page(body)
    W.text_of(whole[: len(whole) - cut], "")


def test_repeats_fold_and_differences_become_optional():
    a = W.fold(tuple("ul li # /li li # /li li # /li /ul".split()))
    assert a == ("ul", ("+", ("li", "#", "/li")), "/ul")
    b = W.fold(tuple("ul li # /li /ul p # /p".split()))
    both = W.align(a, b)
    assert W.as_expression(both) == "ul ( li # /li )+ /ul ( p # /p )?"
    assert W.align(both, a) == both == W.align(both, b)
    assert W.from_json(W.as_json(both)) == both


def test_wrappers_of_hosts(many_chunks):
    n = 60
    rows = []
    for i in range(n):  # one host has structures of all kinds, more than are aligned at once
        extra = "".join(f"<h{1 + (i >> b & 1)}>x{b}</h{1 + (i >> b & 1)}>" for b in range(6))
        rows.append((i, "http://big.net/x", page(f"{MENU}<article>{extra}{'<p>word word</p>' * (i % 4)}</article>")))
    rows += [(100, "http://small.net/a", page(CASES["no article"][0])), (101, "http://small.net/b", None), (102, None, page(CASES["article"][0]))]
    rows += [(100, "http://small.net/a", page(CASES["no article"][0]))]
    pages = with_clashing_columns(many_chunks.createDataFrame(rows, "page_id long, url string, html string"))
    found = W.infer(pages)
    hosts = {r.host: r for r in found.collect()}
    assert set(hosts) == {"big.net", "small.net", ""}
    assert hosts["big.net"].n_pages == n and hosts["big.net"].container.endswith("article!article")
    assert "( p # /p )+" in W.as_expression(W.from_json(hosts["big.net"].wrapper))
    got = W.extract(pages, found).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert by[100] == CASES["no article"][1] and by[101] == "" and by[102] == CASES["article"][1]
    assert by[3] == "\n".join([f"x{b}" for b in range(6)] + ["word word"] * 3)
    assert W.extract(pages.filter("false"), W.infer(pages.filter("false"))).collect() == []


def test_the_container_is_a_node_of_the_wrapper(many_chunks):
    """Neighbours of one name are told apart by their places, and text that never varies is no article."""
    rows, want = [], {}
    for i in range(12):
        extra = "<ul><li>x</li></ul>" if i % 2 else ""
        body = f"{extra}<div><p>{'the same on all pages ' * 20}</p></div><div><p>Article {i}</p><p>more {i * i}</p></div><div><p>end</p></div>"
        rows.append((i, "http://plain.net/x", page(body)))
        want[i] = f"Article {i}\nmore {i * i}"
    pages = many_chunks.createDataFrame(rows, "page_id long, url string, html string")
    found = W.infer(pages)
    assert {r.page_id: r.text for r in W.extract(pages, found).collect()} == want
    models = W.json.loads(found.first().models)
    for i, (_, _, source) in enumerate(rows):
        assert [W.plain(s) for s in W.Page(source).slots(models)] == [path for path, _, _ in W.Page(source).blocks], i


def test_an_expression_describes_all_it_was_made_of():
    import itertools
    import random

    rnd = random.Random(3)
    for _ in range(300):
        streams = [tuple(rnd.choice("abc#") for _ in range(rnd.randint(0, 9))) for _ in range(6)]
        found = W.merged([W._stream(s) for s in streams])
        symbols, follow, first, last = W._automaton(found)
        for s in filter(None, streams):
            at = W.places(found, s)
            assert at[0] in first and at[-1] in last
            assert tuple(symbols[x] for x in at) == s and all(b in follow[a] for a, b in itertools.pairwise(at))


def test_wrappers_grow_with_the_template_not_with_the_pages(many_chunks):
    def word(i):
        return "".join(chr(97 + int(d)) for d in str(i))

    def source(i):
        parts = "".join(f"<h2 id='on-{word(i)}{k}q'>h{k}</h2>" * (i >> k & 1) + "<p>t</p><ul><li>x</li></ul>" * (i * k % 3) for k in range(7))
        return page(f"{MENU}<div class='post'><div id='{word(i)}z'>{parts}<p>Text {i}</p></div></div><div class='footer'>f</div>")

    sizes = []
    for n in (100, 400):
        rows = [(i, "http://hot.net/x", source(i)) for i in range(n)]
        pages = many_chunks.createDataFrame(rows, "page_id long, url string, html string")
        found = W.infer(pages)
        row = found.first()
        assert "div.post" in row.wrapper and "on-" not in row.wrapper
        sizes.append(len(row.wrapper))
        got = {r.page_id: r.text for r in W.extract(pages, found).collect()}
        assert len(got) == n and all(got[i].endswith(f"Text {i}") and "f" not in got[i].split("\n") for i in got)
        assert got[1].split("\n")[0] == "h0"
    assert sizes[1] <= 1.1 * sizes[0]


def articles(n):
    """Pages of one template: within the article a constant line and, among neighbours alike, the text."""
    rows, want = [], {}
    for i in range(n):
        extra = "<ul><li>x</li></ul>" if i % 2 else ""
        body = f"{MENU}<article>{extra}<div>Read this on paper, too</div><div>Text {i} and more of it, as it should be</div></article>"
        rows.append((i, "http://marked.net/x", page(body)))
        want[i] = f"Text {i} and more of it, as it should be"
    return rows, want


def test_constant_slots_of_marked_articles_are_found_by_alignment(many_chunks, monkeypatch):
    rows, want = articles(12)
    pages = many_chunks.createDataFrame(rows, "page_id long, url string, html string")
    texts = lambda: {r.page_id: r.text for r in W.extract(pages, W.infer(pages)).collect()}
    # the list is constant where it stands, but stands on half of the pages only
    assert texts() == {i: ("x\n" if i % 2 else "") + x for i, x in want.items()}
    monkeypatch.setattr(W, "merged", lambda found: "[]")
    assert all("Read this on paper, too" in x for x in texts().values())


def test_copies_lose_nothing(many_chunks):
    """Where most pages are copies, or few there are, equal text is no sign of a template."""
    rows = [(i, "http://copies.net/x", articles(1)[0][0][2]) for i in range(20)] + [(100 + i, "http://few.net/x", articles(1)[0][0][2]) for i in range(3)]
    pages = many_chunks.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in W.extract(pages, W.infer(pages)).collect()}
    assert got == {i: "Read this on paper, too\nText 0 and more of it, as it should be" for i, *_ in rows}


def test_large_templates_keep_their_places():
    names = [f"div.{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    one = [x for i, x in enumerate(names) if i % 7]
    many = tuple(x for y in names for x in (y, *["p", "ul"] * 5))
    found = W.merged([W._stream(tuple(x)) for x in (names, one, many, names[3:])])
    symbols = W._automaton(found)[0]
    assert [x for x in symbols if x in names] == names
    for x in (names, one, many):
        assert [symbols[at] for at in W.places(found, tuple(x))] == list(x)
    plain = ("div",) * 40
    assert len(set(W.places(W.merged([W._stream(plain), W._stream((*plain, "p"))]), plain))) == 40


def test_deep_and_long_pages_are_read_whole_and_fast():
    import time

    start = time.time()
    deep = W.text_of(page("<article>" + "<div>" * 20000 + "deep" + "</div>" * 20000 + "<p>end</p></article>"), "/html/body/article!article")
    long = W.text_of(page("<article>" + "<p>a</p><ul><li>b</ul>" * 10000 + "</article>"), "/html/body/article!article")
    assert deep == "deep\nend" and long == "\n".join(["a", "b"] * 10000)
    assert time.time() - start < 10
