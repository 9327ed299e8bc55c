"""Extraction: stray bodies, deep nesting, and the recurrent labeller against a version step by step and against differences."""

import math

import numpy as np
import pytest

from labelwright.llm import extract


def test_a_second_body_closes_nothing():
    page = "<html><body><article><p>One.</p><body class='x'><p>Two.</p></article><footer><body><p>End.</p></footer></body></html>"
    found = extract.blocks(page)
    assert [(t, "article" in p, "footer" in p) for p, t, _ in found] == [("One.", True, False), ("Two.", True, False), ("End.", False, True)]
    assert [t for _, t, _ in extract.blocks("<p>a<body><p>b")] == ["a", "b"]


@pytest.mark.parametrize("depth", [10, 63, 64, 65, 200, 5000])
def test_article_and_boilerplate_are_known_however_deep(depth):
    page = f"<article>{'<div>' * depth}<p>in</p>{'</div>' * depth}</article><div class='comments'>{'<div>' * depth}<p>out</p>{'</div>' * depth}</div><p>after</p>"
    (a, ta, _), (b, tb, _), (c, tc, _) = extract.blocks(page)
    assert (ta, tb, tc) == ("in", "out", "after")
    assert "article" in a and "article" not in b and "comments" in b and "comments" not in a and not {"article", "comments"} & set(c)


def plain_scores(model, x):
    """One page, one step and one number at a time."""
    h_size = extract.HIDDEN

    def run(rows, side):
        wx, wh, bias = (model.w[k + side].astype(float) for k in "xhc")
        h, c, out = [0.0] * h_size, [0.0] * h_size, []
        for row in rows:
            g = [sum(row[k] * wx[k, j] for k in range(len(row)) if row[k]) + sum(h[k] * wh[k, j] for k in range(h_size)) + bias[j] for j in range(4 * h_size)]
            s = lambda v: 1 / (1 + math.exp(-v))
            c = [s(g[h_size + j]) * c[j] + s(g[j]) * math.tanh(g[3 * h_size + j]) for j in range(h_size)]
            h = [s(g[2 * h_size + j]) * math.tanh(c[j]) for j in range(h_size)]
            out.append(h)
        return out

    f, b = run(x, "f"), run(x[::-1], "b")[::-1]
    w, p = model.w["o"][:, 0], model.w["p"][0]
    return [1 / (1 + math.exp(-(sum(a * v for a, v in zip(f[t] + b[t], w)) + p))) for t in range(len(x))]


def test_scores_equal_a_plain_version():
    r, model = np.random.default_rng(1), extract.Labeller()
    width = model.w["xf"].shape[0]
    pages = [(r.random((n, width)) * (r.random((n, width)) < 0.05)).astype(np.float32) for n in (1, 4, 2, 7)]
    for got, x in zip(model.scores(pages), pages):
        assert np.allclose(got, plain_scores(model, x), atol=1e-4)


def test_gradient_equals_differences():
    """The derivative of the sum of one direction's states, weighted at random, by back-propagation and by differences."""
    r, model = np.random.default_rng(2), extract.Labeller()
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x = r.normal(0, 0.3, (4, 3, model.w["xf"].shape[0]))
    weight = r.normal(size=(4, 3, extract.HIDDEN))
    loss = lambda: float((np.asarray(model._run(x, "f", False)[0], np.float64) * weight).sum())
    grads = {}
    model._back(x, "f", model._run(x, "f", True)[1], weight, grads)
    for name in ("xf", "hf", "cf"):
        flat = model.w[name].reshape(-1)
        for k in r.integers(0, len(flat), 6):
            old = flat[k]
            flat[k] = old + 1e-2
            up = loss()
            flat[k] = old - 1e-2
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-2 - grads[name].reshape(-1)[k]) < 2e-2 * max(1, abs(grads[name].reshape(-1)[k])), name
