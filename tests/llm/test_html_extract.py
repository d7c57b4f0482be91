import random
import time

import pytest
from pyspark.sql import functions as F

from markscale.llm.html_extract import extract_main_text, main_text

LONG = "A long paragraph, with commas, and enough words to score well in the tree, again and again."

CASES = {
    "nothing": (None, ""),
    "empty": ("", ""),
    "text only": ("plain <b>te</b>xt", "plain text"),
    "references": (f"<article><p>a&amp;b &lt;&#233;&nbsp;&#x4e2d; \n\t c</p><p>{LONG}</p></article>", f"a&b <é 中 c {LONG}"),
    "furniture": (
        f"<html><head><title>t</title><style>p{{}}</style></head><body><header>h</header><nav><a href=/>n</a></nav>"
        f"<div class='cookie-notice'>c</div><div id='sidebar'><p>{LONG}</p></div><div role=search>s</div>"
        f"<main><h1>Title</h1><p>{LONG}</p><div class='ad'>buy</div><form><p>f</p></form><script>var x='</p>'</script>"
        f"<section id=comments><p>{LONG} reader</p></section></main><footer>f</footer></body></html>",
        f"Title {LONG}",
    ),
    "open tags": (f"<article><h1>T</h1><p><b>one.<br><p>two<p>{LONG}</article><footer>f", f"T one. two {LONG}"),
    "no article": (f"<body><div class=menu><p>{LONG}</p></div><div><p>{LONG}</p><p>short</p></div><div><a href=1>{LONG}</a></div>", f"{LONG} short"),
    "siblings": (f"<body><div><p>{LONG}</p><p>{LONG}</p></div><div><p>{LONG}</p></div><div><p><a href=x>{LONG}</a></p></div>", " ".join([LONG] * 3)),
    "own header": (f"<article><header><h1>T</h1></header><p>{LONG}</p></article>", f"T {LONG}"),
    "references of an article": (f"<article><p>{LONG}</p><ul><li><a href=1>x</a><li><a href=2>y</a></ul></article>", f"{LONG} x y"),
    "link list": (f"<body><div><p>{LONG}</p><ul><li><a href=1>x</a><li><a href=2>y</a></ul></div>", LONG),
    "linked paragraphs": (f"<body><div><p>{LONG}</p><p>{LONG}</p><div><p><a href=1>one</a> two</p></div></div>", f"{LONG} {LONG} one two"),
    "sections": (
        f"<article><section id=discussion><h2>Discussion</h2><p>{LONG}</p></section><section id='related-work'><p>r</p></section>"
        "<p class='notice-board-story'>n</p><div class='search'>s, found</div></article>",
        f"Discussion {LONG} r n s, found",
    ),
    "named furniture of an article": (
        f"<article><p>{LONG}</p><div class='ad'>a</div><div class='ad-slot-1'>b</div><div id=commentList>c</div><p class=notice>d</p>"
        "<div class='related-work'><a href=1>e</a></div><section class=comments><p>f</p></section><div class='share-buttons'>g</div></article>",
        LONG,
    ),
    "headings before": (f"<body><h1><a href=/>Site</a></h1><p>x</p><h1>Title</h1> <h2>Sub</h2><hr><div><p>{LONG}</p></div><h3>After</h3>", f"x Title Sub {LONG}"),
    "hidden": (f"<article><p>{LONG}</p><p hidden>x</p><p style='display: none'>y</p></article>", LONG),
    "layout class": (f"<body><div class='has-sidebar'><p>{LONG}</p></div></body>", LONG),
    "cut comment": (f"<article><p>{LONG}</p><!-- never closed", LONG),
}


@pytest.mark.parametrize("name", CASES)
def test_main_text(name):
    page, want = CASES[name]
    assert main_text(page) == want


def test_deep_and_long_pages():
    assert main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    body = "word, " * 200_000
    assert len(main_text(f"<article><p>{body}</p></article>")) == len(body) - 1


def test_pages_keep_their_rows(spark):
    rows = [(1, CASES["open tags"][0]), (1, CASES["open tags"][0]), (2, None), (None, "")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit(5))
    got = extract_main_text(df).collect()
    assert sorted(r.text for r in got) == ["", "", *[CASES["open tags"][1]] * 2]
    assert extract_main_text(df.limit(0)).count() == 0


def test_deep_nesting_takes_linear_time():
    def seconds(depth):
        began = time.perf_counter()
        page = f"<article>{'<b>' * depth}<p>deep<header>x</header>{'</b>' * depth}</article>"
        assert "deep" in main_text(page)
        return time.perf_counter() - began

    seconds(1000)
    assert min(seconds(32_000) for _ in range(3)) < 12 * min(seconds(8_000) for _ in range(3))


FURNISHED = (
    "<nav>{}</nav>", "<aside>{}</aside>", "<form>{}</form>", "<script>{}</script>", "<div class='ad'>{}</div>", "<div id='share-bar'>{}</div>",
    "<p class='cookie-notice'>{}</p>", "<section id=comments><p>{}</p></section>", "<ul role=navigation><li>{}</ul>", "<div hidden>{}</div>",
)
WRAPPED = (
    "<p>{}</p>", "<section id=discussion>{}</section>", "<div class='story-body'>{}</div>", "<ul><li>{}</ul>", "<blockquote>{}</blockquote>",
    "<p>{}", "<header>{}</header>", "<table><tr><td>{}<td></table>", "<h2>{}</h2>", "<section class='related-work'>{}</section>",
)


@pytest.mark.parametrize("seed", range(40))
def test_every_text_of_an_article_is_kept_and_no_furniture(seed):
    """Random articles, against the list of the texts that were put outside of furniture."""
    draw, kept, count = random.Random(seed), [], iter(range(10_000))

    def piece(depth):
        if draw.random() < 0.25:
            return draw.choice(FURNISHED).format(f"furniture{next(count)}")
        if depth and draw.random() < 0.4:
            inner = "".join(piece(depth - 1) for _ in range(draw.randint(1, 4)))
            return draw.choice(("<section id=search>{}</section>", "<div class='alert-system'>{}</div>", "<div>{}</div>")).format(f"<p>{inner}")
        kept.append(f"kept{next(count)}")
        # A named section that is mostly links would be furniture, so linked texts stand outside of those.
        return (draw.choice(WRAPPED) if depth < 4 else "<ul><li><a href=x>{}</a></ul>").format(kept[-1])

    body = "".join(piece(4) for _ in range(12))
    page = f"<body><nav><a href=1>menu</a></nav><article><p>{LONG}</p>{body}</article><footer>foot</footer>"
    assert main_text(page).split() == [*LONG.split(), *kept]
