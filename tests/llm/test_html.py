"""Operator 8: hand-labelled pages, and a plain second version of the two passes."""

import html as entities
import re

import pytest

from rivulet.llm import html, queries

P = "The house on the hill is as old as the town and was built by the people who had come from the coast."
Q = "There is no road to it from the south, but the path by the river can be used in all but the worst of weather."


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<head><title>x</title><body><p>{P}", P),
        (f"<html><head><meta charset=x>{P}", P),
        (f'<div class="has-sidebar"><p>{P}</p><div class="sidebar"><p>{Q}</p></div></div>', P),
        (f'<article class="post comments-open"><p>{P}</p></article>', P),
        (f"<p>{P} <math><mi>x</mi></math></p>", P + " x"),
        (f"<div><p>{P}</p><p>{Q}</p></div><article><a href=x>Read this</a></article>", f"{P} {Q}"),
        ("<p>" + "我们在城里看到了很多的人。" * 8 + "</p>", "我们在城里看到了很多的人。" * 8),
        ("<p>Short one.</p>", "Short one."),
        (f"<p>{P}</p><!-- x <p>gone", P),
        (f"<script><!-- x </script><p>{P}</p>", P),
        (f"<form><p>{P}</p></form>", P),
        (f"<p>{P}</p><form><p>{Q}</p></form>", P),
        (f"<p>{P}</p><form>Mail<input><p>Send</p>", P),
        ("<ul><li>One<li>Two<li>Three</ul>", "One Two Three"),
        (f"<p>{P}</p><div class=comments><p>{Q}</p></div>", P),
        (f"<p>{P}</p><div class='comment-list'><p>{Q}</p></div><p>Short.</p>", f"{P} Short."),
        (f"<header><p>{Q}</p></header><main><header><h1>Title</h1></header><p>{P}</p></main>", f"Title {P}"),
        (f"<p>{P}</p><p>© 2020 by the people of the town, who have all rights to it and to the rest</p>", P),
        (f"<aside><p>{Q}</p></aside><p>{P}</p>", P),
        (f"<p>{P}<p>" + "zzz yyy " * 20 + f"<p>{Q}", f"{P} {('zzz yyy ' * 20).strip()} {Q}"),
        ("<div>" * 3000 + P + "</b>" * 3000, P),
        (None, ""),
        ("", ""),
        ("<nav>x</nav>", ""),
        ("<article><p>cut &am", "cut &am"),
    ],
)
def test_pages_by_hand(page, want):
    assert html.main_text(page) == want


def plain(page: str) -> str:
    """The same rules on pages whose blocks are paragraphs, headings, list items and divs, by regular expressions."""
    page = re.sub(r"(?s)<!--.*?-->|<(script|style|title)\b.*?</\1>", "", page)
    blocks, place, link, linked, text = [], [], False, 0, ""
    for part in [*re.findall(r"<[^>]*>|[^<]+", page), "<p>"]:
        tag = re.match(r"</?(\w+)", part)
        if part.startswith("<!"):
            continue
        if tag is None:
            data = entities.unescape(part)
            text, linked = text + data, linked + len(data) * link
        elif tag[1] == "a":
            link = part[1] != "/"
        elif tag[1] == "br":
            text += " "
        elif tag[1] not in ("b", "meta"):
            if text.split():
                blocks.append((" ".join(text.split()), linked, tuple(place)))
            text, linked = "", 0
            name = "side" if tag[1] in ("nav", "footer") or 'class="ad"' in part else tag[1]
            if part[1] != "/" and tag[1] in ("nav", "footer", "div", "article"):
                place.append(name)
            elif part[1] == "/" and tag[1] in ("nav", "footer", "div", "article"):
                place.pop()
    shares = []
    for t, n, _ in blocks:
        words = [w.strip(".,;:!?#*%$&|()[]\"'") for w in t.lower().split()]
        shares.append(sum(w in html.STOP_WORDS for w in words) / len(words) if len(t) >= 70 and n * 2 <= len(t) else None)
    scores = []
    for (t, n, where), share in zip(blocks, shares, strict=True):
        if n * 2 > len(t) or ("©" in t and len(t) < 210):
            s = -2
        elif share is None:
            s = -1 if n else 0
        elif n * 5 > len(t):
            s = 0
        elif share >= 0.2 or not any(x is not None and x >= 0.1 for x in shares):
            s = 2
        else:
            s = 1 if share >= 0.1 else -1
        scores.append(s - 5 * ("side" in where) + ("article" in where))
    kept = []
    for i, (t, _, where) in enumerate(blocks):
        label = (scores[i] >= 2) - (scores[i] <= -2)
        if label == 0:
            voters = [j for j, b in enumerate(blocks) if abs(scores[j]) >= 2 and "side" not in b[2]]
            own = [j for j in voters if ("article" in blocks[j][2]) == ("article" in where)] if "article" in where else []
            near = sorted((abs(i - j), -scores[j]) for j in own or voters)
            label = 1 if not near or near[0][1] < 0 else -1
        if label > 0:
            kept.append(t)
    return " ".join(kept)


def test_a_plain_version_agrees(spark):
    pages = queries.table(spark, "/root/testdata/sf0.01", "pages").collect()
    bare = lambda p: re.sub(r"</?article>", "", re.sub(r"<(/?)(nav|footer)>", r"<\1div>", p.replace(' class="ad"', "")))
    # with their marks, without the article's, and without any
    for change in (lambda p: p, lambda p: re.sub(r"</?article>", "", p), bare):
        assert all(html.main_text(change(r["html"])) == plain(change(r["html"])) for r in pages)


def test_the_rules_decide(spark, monkeypatch):
    pages = [r["html"] for r in queries.table(spark, "/root/testdata/sf0.01", "pages").collect()]
    bare = [re.sub(r"</?article>", "", re.sub(r"<(/?)(nav|footer)>", r"<\1div>", p.replace(' class="ad"', ""))) for p in pages]
    marked, unmarked = list(map(html.main_text, pages)), list(map(html.main_text, bare))
    assert sum(a == b for a, b in zip(marked, unmarked, strict=True)) > 0.5 * len(pages)
    monkeypatch.setattr(html, "content_scores", lambda blocks: [0] * len(blocks))
    assert all(a != html.main_text(b) for a, b in zip(marked, bare, strict=True))


def test_columns(spark):
    df = spark.createDataFrame([(1, "<p>a</p>", "old", 7)], "page_id long, html string, text string, n int")
    assert html.extract(df).collect() == [(1, 7, "a")]
