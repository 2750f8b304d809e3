"""Density decides what is text, but what a page sets apart is none while anything else weighs."""

import random

import pytest

LONG = ["The quick brown fox jumps over the lazy dog near the old stone bridge at dawn. " * k for k in (2, 1, 3, 1)]
PARAGRAPHS = "".join(f"<p>{x}</p>" for x in LONG)
TEXT = "\n".join(x.strip() for x in LONG)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<html><body><h1>Short news</h1><p>Only a line.</p></body></html>", "Short news\nOnly a line."),
        (f"<div class='side-effects'>{PARAGRAPHS}</div>", TEXT),
        (f"<article>{PARAGRAPHS}<section class='related-work'><p>Others did this before.</p></section></article>", TEXT + "\nOthers did this before."),
        (f"<article>{PARAGRAPHS}<p class='alert'>Mind the gap.</p></article>", TEXT + "\nMind the gap."),
        (f"<main><p>new</p><p>story</p></main><div><p>{'word ' * 196}</p></div>", "new\nstory\n" + " ".join(["word"] * 196)),
        # What the page sets apart stays out, however it is named.
        (f"<article>{PARAGRAPHS}</article><div class='comment-list'>{PARAGRAPHS * 3}</div>", TEXT),
        (f"<article>{PARAGRAPHS}<div class='ad-slot'><p>Buy this now!</p></div><p>The end.</p></article><div id='site-footer'>{LONG[0]}</div>", TEXT + "\nThe end."),
        (f"<nav>{LONG[0]}</nav>{PARAGRAPHS}<aside>{LONG[1]}</aside>", TEXT),
        (f"<div class='sidebar'>{'<p>' + 'word ' * 900 + '</p>'}</div>", " ".join(["word"] * 900)),
    ],
)
def test_density(page, text):
    from weftline.llm.html import main_text

    assert main_text(page) == text


def slow_text(lines, marked):
    """lines: (text, linked, kind), kind one of own, weak, apart, beside; windows are summed place by place."""
    weigh = {"own": 1, "weak": 0.5, "apart": 0.02, "beside": 0.1}
    scale = lambda kind: 0.1 * weigh[kind] if marked and kind == "apart" else weigh[kind]
    groups = [[k for k, x in enumerate(lines) if (x[2] in ("own", "weak")) == mine] for mine in (True, False)]
    weights = [max(1 if marked and x[2] in ("own", "weak") else 0, len(x[0]) if not x[1] else 0) * scale(x[2]) for x in lines]
    sums = [{k: sum(weights[j] for j in g[p : p + 3]) for p, k in enumerate(g)} for g in groups]
    most = max(sums[0].values(), default=0)
    need = 0 if marked or most < 60 else 60
    if any(w and x[2] != "apart" for w, x in zip(weights, lines, strict=True)):
        groups[1] = [k for k in groups[1] if lines[k][2] != "apart"]
        sums[1] = {k: sum(weights[j] for j in groups[1][p : p + 3]) for p, k in enumerate(groups[1])}
    kept = set()
    for p, k in enumerate(groups[0]):
        if weights[k] and any(sums[0][groups[0][q]] >= need and weights[groups[0][q]] and all(sums[0][j] > 0 for j in groups[0][q : p + 1]) for q in range(p + 1)):
            kept.add(k)
    dense = max(60, 0.2 * max([most, *sums[1].values()]))
    for p, k in enumerate(groups[1]):
        if weights[k] * 3 >= dense and any(sums[1][groups[1][q]] >= dense for q in range(max(0, p - 2), p + 1)):
            kept.add(k)
    return "\n".join(lines[k][0] for k in sorted(kept))


STORY = "A short story about a bridge that was built twice, and about the river that did not mind at all. " * 2


@pytest.mark.parametrize(
    "apart",
    [
        "<div class='comments'>{0}</div>",
        "<footer>{0}</footer>",
        "<div class='cookie-banner'>{0}</div>",
        "<aside>{0}</aside>",
        "<form action='x'>{0}</form>",
    ],
)
@pytest.mark.parametrize("page", ["<body><p>{story}</p>{apart}</body>", "<body><article><p>{story}</p>{apart}</article></body>", "<body><article><p>{story}</p></article>{apart}</body>"])
def test_mass_does_not_let_in_what_is_set_apart(page, apart):
    from weftline.llm.html import main_text

    long = apart.format("".join(f"<p>{LONG[0]}</p>" for _ in range(25)))
    assert main_text(page.format(story=STORY, apart=long)) == STORY.strip()


@pytest.mark.parametrize("marked", [False, True])
def test_against_line_blocks(marked):
    from weftline.llm.html import main_text

    rng = random.Random(3)
    for _ in range(300):
        lines, page = [], ""
        for _ in range(rng.randint(0, 12)):
            text = " ".join("w" * rng.randint(1, 9) for _ in range(rng.choice([1, 2, 5, 30, 400])))
            linked = rng.random() < 0.2
            kind = rng.choice(["own", "own", "own", "weak", "apart", "beside"] if marked else ["own", "own", "own", "weak", "apart"])
            lines.append((text, linked, kind))
            inner = f"<a href='x'>{text}</a>" if linked else text
            block = {"own": f"<p>{inner}</p>", "weak": f"<div class='widget'>{inner}</div>", "apart": f"<div class='footer'>{inner}</div>", "beside": f"<p>{inner}</p>"}[kind]
            page += f"<article>{block}</article>" if marked and kind in ("own", "weak") else block
        has_part = any(k in ("own", "weak") for *_, k in lines)
        if not has_part:  # then nothing is marked
            lines = [(t, a, "own" if k == "beside" else k) for t, a, k in lines]
        assert main_text(f"<body>{page}</body>") == slow_text(lines, marked and has_part)
