"""Content regions are chosen by ratios, smoothing and clusters, on pages whose article is known."""

import itertools
import random
import time

import numpy as np
import pytest

from veilframe.llm import html


def plain_ratios(lines, counts, sigma):
    raw = [k * max(0, len(t) - linked) / max(1, tags) for (t, linked, tags, _, _), k in zip(lines, counts)]
    reach = max(1, int(3 * sigma))
    out = []
    for i in range(len(raw)):
        w = {j: np.exp(-0.5 * ((i - j) / sigma) ** 2) for j in range(max(0, i - reach), min(len(raw), i + reach + 1))}
        out.append(sum(raw[j] * x for j, x in w.items()) / sum(w.values()))
    return out


def test_smoothing_and_threshold_against_plain_ones():
    r = random.Random(1)
    for n in (1, 2, 3, 8, 40):
        lines = [["x" * r.randint(1, 300), r.randint(0, 40), r.randint(0, 9), 0, False] for _ in range(n)]
        counts = [r.choice([1.0, 4.0]) for _ in lines]
        assert np.allclose(html.ratios(lines, counts, 1.0), plain_ratios(lines, counts, 1.0))
    for _ in range(50):
        values = np.array([r.uniform(1, 5) for _ in range(r.randint(2, 12))] + [r.uniform(50, 90) for _ in range(r.randint(1, 12))])
        cut = html.threshold(values)
        best = min((sum(((p - p.mean()) ** 2).sum() for p in (np.sort(values)[:k], np.sort(values)[k:])), k) for k in range(1, len(values)))[1]
        assert ((values > cut).sum(), (values <= cut).sum()) == (len(values) - best, best)
    assert html.threshold(np.array([3.0, 3.0, 4.0])) == -1


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def page(r, semantic):
    """(html, its article): paragraphs, headings and short lines, among all that isn't article."""
    say = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    links = lambda n: "".join(f'<li><a href="/{k}">{say(2)}</a></li>' for k in range(n))
    title, blocks, body = say(5), [], []
    blocks.append(title)
    body.append(f"<h1>{title}</h1>")
    for _ in range(r.randint(3, 9)):
        text = say(r.choice([4, 40, 80, 120]))
        blocks.append(text)
        kind = r.choice(["<p>{}</p>", "<p>{}", "<div><p>{}</p></div>", "<section><p><b>{}</b></p></section>"])
        body.append(kind.format(text))
        if r.random() < 0.3:
            body.append(f'<div class="ad">{say(60)}</div>')
        if r.random() < 0.2:
            body.append(f"<script>var x = '{say(30)}';</script>")
    inner = "".join(body)
    inner = f"<article>{inner}</article>" if semantic else f'<div id="text">{inner}</div>'
    before, behind = f"<nav><ul>{links(6)}</ul></nav>", f'<div class="comments"><p>{say(70)}</p></div><footer>{say(12)}</footer>'
    lists = f"<ul>{links(5)}</ul>" if not semantic else f"<div><ul>{links(5)}</ul></div><article><ul>{links(8)}</ul></article>"
    return f"<!DOCTYPE html><html><head><title>{title}</title></head><body>{before}{inner}{lists}{behind}</body></html>", "\n".join(blocks)


@pytest.mark.parametrize("semantic", [True, False])
def test_articles_come_whole(semantic):
    r = random.Random(2)
    for _ in range(200):
        text, article = page(r, semantic)
        assert html.main_text(text) == article


def test_without_the_method_results_change(monkeypatch):
    """Lines chosen without ratios, without smoothing or without a threshold give other articles on the same pages."""
    r = random.Random(3)
    pages = [page(r, semantic)[0] for semantic in (True, False) for _ in range(60)]
    want = [html.main_text(p) for p in pages]
    flat = lambda values: -1.0
    with monkeypatch.context() as m:
        m.setattr(html, "threshold", flat)
        assert sum(a != b for a, b in zip(want, map(html.main_text, pages))) > 40
    with monkeypatch.context() as m:
        m.setattr(html, "ratios", lambda lines, counts: np.arange(len(lines), dtype=float))
        assert sum(a != b for a, b in zip(want, map(html.main_text, pages))) > 40
    smooth = html.ratios
    few = "<div><p>" + "a " * 80 + "</p><p>one</p><p>" + "b " * 80 + "</p></div><div><p>two</p></div>"
    lines = [["a " * 80, 0, 1, 0, False], ["one", 0, 1, 0, False], ["b " * 80, 0, 1, 0, False], ["two", 0, 1, 0, False]]
    assert smooth(lines, [1.0] * 4)[1] > 3 * smooth(lines, [1.0] * 4, 0.01)[1] and html.main_text(few).startswith("a a")


def test_doubtful_parts_of_an_article_go_by_their_lines():
    long = " ".join(WORDS * 6)
    part = '<article><p>{0}</p><p>{0}</p><div class="related-work">{1}</div><p>{0}</p></article>'
    assert html.main_text(part.format(long, f"<p>{long} more</p>")).split("\n") == [long, long, f"{long} more", long]
    assert html.main_text(part.format(long, "".join(f'<p><a href="{k}">{k} link</a></p>' for k in range(8)))).split("\n") == [long, long, long]


@pytest.mark.parametrize("unit", ["<div>", "<p><b>x<br>", "<article>", "<div><td>", "<nav><div></p></span>", "</div>", "<li>x", "<a>"])
def test_time_grows_with_length_only(unit):
    def seconds(n):
        began = time.perf_counter()
        html.main_text(unit * n + "text")
        return time.perf_counter() - began

    seconds(100)
    assert min(seconds(12_000) for _ in range(2)) < 12 * max(min(seconds(3_000) for _ in range(3)), 0.01)


def test_all_orders_of_ends_and_starts():
    """No order of tags loses the parser's place or fails."""
    tags = ["<div>", "</div>", "<nav>", "</nav>", "<p>", "</p>", "<li>", "<a>", "</a>", "t"]
    for combo in itertools.product(tags, repeat=4):
        html.main_text("".join(combo) + "end")
