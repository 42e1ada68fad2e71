"""Main text where only path ratios, or the place of the text, tell content from the rest."""


import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gatehouse.llm import html_text

PROSE = ["The harbour was closed, and the boats stayed in; nobody, it was said, had seen such a storm. " * 4 + f"Part {k}." for k in range(5)]
BODY = "".join(f"<p>{x}</p>" for x in PROSE)
LINKS = "<ul>" + "".join(f"<li><a href=x>Story number {k}</a></li>" for k in range(8)) + "</ul>"


def test_lists_of_links_in_the_article_go():
    page = f"<body><article><h1>Storm</h1><div class='toc'>{LINKS}</div>{BODY}<h2>After</h2><p>So it was.</p><ul><li>One boat</li><li>Two <a href=x>nets</a> of cod</li></ul><div class='trending'>{LINKS}</div><div class='most-popular'>Hot now</div></article></body>"
    assert html_text.main_text(page).split("\n") == ["Storm", *PROSE, "After", "So it was.", "One boat", "Two nets of cod"]


def test_paths_of_any_depth_stay_apart():
    page = html_text._Nodes()
    page.feed("<div>" * 80 + "<p>a</p><ul><li><a>b</a></li></ul>")
    a, b = (page.paths[e] for text, e, _, _ in page.nodes if text.strip())
    assert a != b and len(set(page.paths)) == 85


@pytest.mark.parametrize("inside", ["<article>{}</article>", "<main>{}</main>", "<div>{}</div>", "<article><div class='post-header-2'>{}</div></article>"])
@pytest.mark.parametrize("wrapper", ["<div class='layout has-sidebar'>{}</div>", "<div id='search-results'>{}</div>", "<form action=x>{}</form>", "<form><div class='widget'><div role='search'>{}</div></div></form>", "<main><div class='ad-free'>{}</div></main>"])
def test_named_wrappers_do_not_lose_the_article(wrapper, inside):
    menu = "<div class='menu'><a>One</a><a>Two</a></div><div class='cookie-notice'>We use cookies, of course.</div>"
    page = f"<body>{wrapper.format(menu + inside.format(BODY))}<footer>Foot</footer></body>"
    assert html_text.main_text(page).split("\n") == PROSE


def test_named_parts_beside_the_article_still_go():
    talk = "<article class='comment-body'><p>" + PROSE[0] * 9 + "</p></article>"
    page = f"<body><main><article><h1>Storm</h1>{BODY}</article><div class='comments'>{talk}</div><div class='related'><article><p>{PROSE[1]}</p></article></div><form>Name</form></main></body>"
    assert html_text.main_text(page).split("\n") == ["Storm", *PROSE]


ARTICLE = "<body><nav><a>Menu</a></nav><article><h1>Storm</h1>" + BODY + "{}</article><footer>Foot</footer></body>"


@pytest.mark.parametrize("part,kept", [
    ("<div class='share-price'><p>" + PROSE[0] + "</p></div>", [PROSE[0]]),
    ("<div class='social-history'>" + PROSE[1] + "</div>", [PROSE[1]]),
    ("<ol><li><a>Smith, J. (2010). The Sea. Oxford.</a></li><li><a>Weiss, K. (2011). Wind; a history. Bern.</a></li></ol>", ["Smith, J. (2010). The Sea. Oxford.", "Weiss, K. (2011). Wind; a history. Bern."]),
    ("<section><p><a>Read the report</a></p></section>", ["Read the report"]),
    ("<span>tail</span>", ["tail"]),
    ("tail", ["tail"]),
    ("<div class='ad'><p>" + PROSE[2] + "</p></div>", []),
    ("<div class='ad-slot'>" + PROSE[2] + "</div>", []),
    ("<div class='comment-list'><p>" + PROSE[2] + "</p></div>", []),
    ("<div id='siteFooter'><p>" + PROSE[2] + "</p></div>", []),
    ("<aside><p>" + PROSE[2] + "</p></aside>", []),
])
def test_names_do_not_decide_over_running_text(part, kept):
    assert html_text.main_text(ARTICLE.format(part)).split("\n") == ["Storm", *PROSE, *kept]


@pytest.mark.parametrize("head", ["<header><h1>Storm</h1></header>", "<div class='header'><h1>Storm</h1></div>", "<header class='page-header'><div><h1>Storm</h1></div></header>"])
def test_headline_in_the_header_of_the_article(head):
    page = f"<body><header><h1>Daily</h1></header><article>{head}{BODY}</article></body>"
    assert html_text.main_text(page).split("\n") == ["Storm", *PROSE]


HOSTILE = {
    "end tags": lambda n: "<b>" * n + "text" + "</i>" * n, "rules": lambda n: "<p><td>" + "<b>" * n + "<hr>" * n + "x", "paragraph ends": lambda n: "<b>" * n + "</p>" * n + "x",
    "items": lambda n: "<b>" * n + "<li>" * n + "x", "comments": lambda n: "x<!--" * n, "tags": lambda n: "x<a " * n, "values": lambda n: '<a b="' * n, "instructions": lambda n: "x<?" * n,
    "ends": lambda n: "</a b" * n, "declarations": lambda n: "<!x" * n, "closed values": lambda n: '<a b="' * n + ">", "depth": lambda n: "<div>" * n + "x" + "</div>" * n,
}


@pytest.mark.parametrize("kind", HOSTILE)
def test_time_is_linear(kind):
    import time

    start = time.process_time()
    html_text.main_text(HOSTILE[kind](1 << 15))
    assert time.process_time() - start < 5


class Searching(html_text._Nodes):
    """The same rules by searching the whole stack."""

    def handle_starttag(self, tag, attrs):
        for ends, stop in ((({"p"} if tag in html_text.ENDS_P else set()), html_text.BLOCK), (html_text.SIBLINGS.get(tag, set()), html_text.SCOPE)):
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag in ends:
                    self._close(k)
                    break
                if not ends or self.stack[k].tag in stop:
                    break
        calls = html_text.ENDS_P, html_text.SIBLINGS
        html_text.ENDS_P, html_text.SIBLINGS = set(), {}
        try:
            super().handle_starttag(tag, attrs)
        finally:
            html_text.ENDS_P, html_text.SIBLINGS = calls

    def handle_endtag(self, tag):
        if tag == "p" and not any(x.tag == "p" for x in self.stack):
            self.block += 1
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                self._close(k)
                return
            if tag not in html_text.BLOCK and self.stack[k].tag in html_text.BLOCK and self.stack[k].tag != "p":
                return


_TAGS = ["p", "div", "b", "li", "ul", "td", "tr", "table", "dt", "dd", "a", "br", "option", "article", "h1", "span"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(_TAGS), st.booleans()), max_size=40))
def test_stack_equals_searching(tags):
    page = "".join(f"<{'/' if end else ''}{tag}>{k}" for k, (tag, end) in enumerate(tags))
    made = []
    for kind in (html_text._Nodes, Searching):
        nodes = kind()
        nodes.feed(page)
        nodes.close()
        made.append((nodes.nodes, nodes.parent, nodes.tags))
    assert made[0] == made[1]
