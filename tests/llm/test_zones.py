"""Zones of page blocks: wrappers, marks and what an article may hold; and what differencing decides."""

import numpy as np
import pytest

from lodestral.llm import pagediff


def text(html, neighbour=None):
    return pagediff.main_text(pagediff.lines(html), pagediff.lines(neighbour) if neighbour else None)


ARTICLE = "<article><h1>Head</h1><p>Body</p></article>"


@pytest.mark.parametrize(
    "page,expected",
    [
        (f"<form>{ARTICLE}</form>", "Head\n\nBody"),
        (f"<form><label>Name</label></form>{ARTICLE}", "Head\n\nBody"),
        (f"<div class='layout has-sidebar'>{ARTICLE}<div class='sidebar'>s</div></div>", "Head\n\nBody"),
        (f"<div id='page-with-banner'>{ARTICLE}</div>", "Head\n\nBody"),
        (f"<div class='widget'>{ARTICLE}</div>", "Head\n\nBody"),
        (f"<nav>{ARTICLE}</nav><main><p>x</p></main>", "x"),
        ("<article><section id='related-work'><h2 id='side-effects'>Effects</h2><p class='notice'>Note</p></section></article>", "Effects\n\nNote"),
        ("<article><p>a</p><div class='ad'>buy</div><p class='ad'>buy</p><ul class='share'><li>x</li></ul><aside>s</aside><form><p>f</p></form><p>b</p></article>", "a\n\nb"),
        (f"{ARTICLE}<section id='comments'><article class='comment'><p>first!</p></article></section>", "Head\n\nBody"),
        (f"{ARTICLE}<div class='comment-list'><article><p>me too</p></article></div>", "Head\n\nBody"),
        ("<div role='main'><header><h1>T</h1></header><p>a<br>b &amp; c</p></div><footer>f</footer>", "T\n\na b & c"),
        ("<p>plain</p><div class='cookie-notice'>c</div><div hidden>h</div><div role='navigation'>n</div>", "plain"),
    ],
)
def test_zones(page, expected):
    assert text(page) == expected


def test_differencing():
    """Without an article shared lines go; article lines come back, furniture goes though no neighbour has it."""
    assert text("<p>same</p><p>own</p><p>tail</p>", "<p>same</p><p>other</p><p>tail</p>") == "own"
    page, near = pagediff.lines("<p>menu</p><article><p>same</p><p>own</p></article><div class='ad'>x</div>"), pagediff.lines("<p>menu</p><article><p>same</p></article>")
    keep, counts = pagediff._kept(page, near)
    assert [x for (_, x), k in zip(page, keep) if k] == ["same", "own"] and counts == {"lines": 4, "deleted": 2, "rescued": 1, "removed": 1}


def test_report(spark):
    pages = spark.createDataFrame([(k, f"https://a.test/{k}", f"<p>menu</p><article><p>same</p><p>own {k}</p></article><div class='ad'>{k}</div>") for k in range(6)], "page_id long, url string, html string")
    assert tuple(pagediff.report(pages).first()) == (24, 12, 6, 6)
    assert tuple(pagediff.report(pages.limit(0)).first()) == (0, 0, 0, 0)


@pytest.mark.parametrize("room", [1 << 26, 4])
def test_alignment(monkeypatch, room):
    """A longest common subsequence, whole or by halves."""
    monkeypatch.setattr(pagediff, "ROOM", room)
    rng = np.random.default_rng(6)
    for _ in range(300):
        a, b = (["".join(x) for x in rng.choice(list("abc"), (int(rng.integers(0, 14)), 1))] for _ in range(2))
        found = sorted(pagediff.shared_lines(a, b))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        at = iter(b)
        assert len(found) == table[-1, -1] and all(a[i] in at for i in found)
