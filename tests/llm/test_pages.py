"""Main text of planted pages."""

import pytest

from tessera.llm import html_text

ONE, TWO, THREE = (" ".join([f"{n} paragraph of the article that goes on for a while."] * 5) for n in ("first", "second", "third"))
BODY = f"<p>{ONE}</p><p>{TWO}</p><p>{THREE}</p>"
TEXT = f"{ONE}\n{TWO}\n{THREE}"
LINKS = "<ul>" + "<li><a href='/x'>Some other page of this site</a>" * 8 + "</ul>"

PAGES = {
    "byline, lead and ending beside a long run": (f"<div><p>By Ann Lee</p></div><div><p>Short lead.</p></div><div>{BODY}</div><div><p>The end.</p></div>", f"By Ann Lee\nShort lead.\n{TEXT}\nThe end."),
    "bare text beside a long run": (f"<div>Welcome</div><div>{BODY}</div><div>(c) 2024</div>", TEXT),
    "paragraphs beyond links aren't next to the run of links": (f"<div>{LINKS}</div><div><p>Lead.</p></div><div>{BODY}</div>", f"Lead.\n{TEXT}"),
    "a widget of text in an article": (f"<article><h1>T</h1>{BODY}<div class='widget-content'><p>{ONE}</p></div></article>", f"T\n{TEXT}\n{ONE}"),
    "a widget of links in an article": (f"<article><h1>T</h1>{BODY}<div class='widget-content'>{LINKS}</div></article>", f"T\n{TEXT}"),
    "a popup around the article": (f"<div class='popup'><article><h1>T</h1>{BODY}</article></div>", f"T\n{TEXT}"),
    "a sidebar class around everything": (f"<div class='sidebar-wrapper'><main>{BODY}</main></div>", TEXT),
    "related articles beside the article": (f"<article>{BODY}</article><div class='related'><article><p>{ONE}</p></article></div>", TEXT),
    "comments of users": (f"<article>{BODY}<div class='user-comments'><p>{ONE}</p></div></article>", TEXT),
    "comments in short": (f"<article>{BODY}<div class='cmt'><p>{ONE}</p></div></article>", TEXT),
    "comments by id": (f"<article>{BODY}<section id='reader-comments'><p>{ONE}</p><p>{TWO}</p></section></article>", TEXT),
    "long text beside a short article": (f"<article><h1>T</h1><p>A short article of its own.</p></article><div class='xx'>{BODY}</div>", "T\nA short article of its own."),
    "an article of the headline alone": (f"<article><h1>T</h1></article><div>{BODY}</div>", f"T\n{TEXT}"),
    "an article in sections": ("<article>" + "".join(f"<section><p>{x}</p></section>" for x in (ONE, TWO, THREE)) + "</article>", TEXT),
    "lists and tables of an article": (f"<article><p>{ONE}</p><ul><li>a<li>b</ul><table><tr><td>1<td>2</table><p>{TWO}</p></article>", f"{ONE}\na\nb\n1\n2\n{TWO}"),
    "references and white space": ("<main><p>a &lt;b&gt; &amp;amp;\n\t c&nbsp;d &#233;</p></main>", "a <b> &amp; c d é"),
    "scripts, styles and markup in comments": (f"<body><script>if (a < b) '</p>'</script><!-- <p>no</p> --><style>p{{}}</style><article>{BODY}</article></body>", TEXT),
    "forms, buttons and hidden parts": (f"<article>{BODY}<form><p>mail</p></form><button>go</button><p hidden>no</p><div style='display:none'>no</div></article>", TEXT),
    "notices, adverts, menus": (f"<div class='cookie-notice'>{ONE}</div><nav>{LINKS}</nav><div class='ad-slot'>{TWO}</div><article>{BODY}</article><footer><p>{ONE}</p></footer>", TEXT),
    "a page of one paragraph": (f"<p>{ONE}", ONE),
    "a page of links alone": ("<ul><li><a href='/'>x</a></ul>", "x"),
    "no page": ("", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_planted_page(name):
    page, want = PAGES[name]
    assert html_text.main_text(page) == want
