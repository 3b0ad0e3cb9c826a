"""Pages whose markup looks like layout, and densities against plain recursion over small trees."""

import math
import random

import pytest

from formweave.llm import htmltext

PARTS = [f"This is paragraph {i} of the article, with many words in it and a stop." for i in range(4)]
ARTICLE = "".join(f"<p>{p}</p>" for p in PARTS)
TEXT = "\n".join(PARTS)


@pytest.mark.parametrize(
    "page",
    [
        f"<body><div><svg-icon></svg-icon>{ARTICLE}</div></body>",
        f"<body><div><math-field></math-field>{ARTICLE}</div></body>",
        f"<body><div><title-bar></title-bar><object-view></object-view><style-x></style-x>{ARTICLE}</div></body>",
        f"<body><form id='aspnetForm'><div>{ARTICLE}</div></form></body>",
        f"<body><form><div>{ARTICLE}</div><div class='search'><button>Go</button></div></form></body>",
        "<body>" + "".join(f"<div class='elementor-widget-text-editor'><p>{p}</p></div>" for p in PARTS) + "</body>",
        "<body><article>" + "".join(f"<div class='notice-text'><p>{p}</p></div>" for p in PARTS) + "</article></body>",
        "<body><article>" + "".join(f"<div class='social-history'><p>{p}</p></div>" for p in PARTS) + "</article></body>",
        f"<body><article><p class='social'>{PARTS[0]}</p>" + "".join(f"<p>{p}</p>" for p in PARTS[1:]) + "</article></body>",
        f"<body><form class='login'>Name, password</form><div>{ARTICLE}</div><div class='widget'><p>Other</p></div></body>",
        f"<body><article>{ARTICLE}</article><div id='comments'>" + "".join(f"<div class='comment'><p>Reader {i} says a lot about it all, at some length.</p></div>" for i in range(12)) + "</div></body>",
    ],
)
def test_articles_that_look_like_layout(page):
    assert htmltext.main_text(page) == TEXT


def test_no_page_is_emptied_by_words():
    assert htmltext.main_text("<body>" + "".join(f"<div class='comment-body'><p>{p}</p></div>" for p in PARTS) + "</body>") == TEXT


def build(rng, depth=0):
    """A random tree as (tag, children), children being trees or texts."""
    tag = rng.choice(["div", "p", "section", "a", "b", "ul"] if depth else ["body"])
    return tag, [build(rng, depth + 1) if depth < 4 and rng.random() < 0.5 else "w" * rng.randint(1, 30) for _ in range(rng.randint(0, 4))]


def test_densities_of_small_trees():
    rng = random.Random(5)

    def measure(t):
        """Characters, tags, characters and tags of links, of what is within."""
        c = g = lc = lg = 0
        for x in t[1]:
            if isinstance(x, str):
                c += len(x)
                continue
            xc, xg, xlc, xlg = measure(x)
            if x[0] == "a":
                xlc, xlg = xc, xg + 1
            c, g, lc, lg = c + xc, g + xg + 1, lc + xlc, lg + xlg
        return (c, g, c, g + 1) if t[0] == "a" else (c, g, lc, lg)

    def walk(t, out, share):
        c, g, lc, lg = measure(t)
        base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
        out.append(c / (g or 1) * math.log(max(c / (lc or 1) * (g or 1) / (lg or 1), 1.0)) / max(base, 1.0) if c else 0.0)
        for x in t[1]:
            if not isinstance(x, str):
                walk(x, out, share)
        return out

    def markup(t):
        return f"<{t[0]}>" + "".join(x if isinstance(x, str) else markup(x) for x in t[1]) + f"</{t[0]}>"

    def is_plain(t, inside=()):
        """Whether no element ends another by being opened (a block in p)."""
        return all(isinstance(x, str) or (not ("p" in (*inside, t[0]) and x[0] in htmltext.BLOCK) and is_plain(x, (*inside, t[0]))) for x in t[1])

    trees = [t for t in (build(rng) for _ in range(400)) if is_plain(t) and measure(t)[0]]
    assert len(trees) > 50
    for t in trees:
        page = htmltext.Page(markup(t))
        body, dense, _, _ = htmltext.densities(page, page.pieces)
        assert page.tag[body] == "body" and dense[1:] == pytest.approx(walk(t, [], measure(t)[2] / measure(t)[0]))
