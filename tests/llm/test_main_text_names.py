"""Names of subjects, and the numbers behind the ratios."""

import numpy as np
import pytest

from vellum.llm import main_text

LONG = "This part of the article says at length what was found, how it was measured and what it may mean for others. " * 2


@pytest.mark.parametrize("part", ['section id="related-work"', 'section id="discussion"', 'div id="share-price"', 'div class="menu-planning"', 'section class="post search-theory"'])
@pytest.mark.parametrize("around", ["article", 'div id="content"'])
def test_names_of_subjects_drop_no_content(part, around):
    tag = part.split()[0]
    html = f"<body><nav><a href=/>Home</a></nav><{around}><h1>Title</h1><p>{LONG}</p><{part}><h2>Heading</h2><p>{LONG}</p><p>{LONG}</p></{tag}><p>{LONG}</p></{around.split()[0]}><footer>End</footer></body>"
    want = "\n".join(["Title", LONG.strip(), "Heading", LONG.strip(), LONG.strip(), LONG.strip()])
    assert main_text.main_text(html) == want


@pytest.mark.parametrize(
    "part",
    [
        'div class="related-posts"><a href=/a>' + "A related post with a long title. " * 4 + "</a>",
        'div id="share-links"><a href=/a>Share</a><a href=/b>Post</a>',
        'section id="discussion"><div class="comment"><p>' + LONG + '</p></div><div class="comment"><p>' + LONG + "</p></div>",
        'div class="comments"><p>' + LONG + "</p>",
        'div class="ad"><p>' + LONG + "</p>",
        'div class="related-offers"><a href=/a>' + "Buy this thing that is on offer today only. " * 3 + "</a>",
        'div class="share-tools"><b>x</b><i>y</i><b>z</b>',
    ],
)
def test_what_the_ratio_doesnt_call_content_stays_out(part):
    tag = part.split()[0]
    html = f"<body><article><h1>Title</h1><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><{part}</{tag}></article></body>"
    assert main_text.main_text(html) == "\n".join(["Title", *[LONG.strip()] * 3])


def test_ratios_smoothing_and_clusters_by_brute_force():
    """The same numbers as loops over blocks give them."""
    import math
    import random

    r = random.Random(4)
    for _ in range(60):
        ratios = np.array([r.choice([0.0, r.uniform(1, 20), r.uniform(60, 300)]) for _ in range(r.randrange(1, 40))])
        weight = lambda d: math.exp(-((d / main_text.SIGMA) ** 2) / 2) if abs(d) <= int(3 * main_text.SIGMA) + 1 else 0
        want = [sum(x * weight(k - j) for j, x in enumerate(ratios)) / sum(weight(k - j) for j in range(len(ratios))) for k in range(len(ratios))]
        got = main_text.smoothed(ratios)
        assert np.allclose(got, want)
        low, high = min(want), max(want)
        for _ in range(50):
            near = [[v for v in want if (v >= (low + high) / 2) == side] for side in (False, True)]
            if not near[0] or not near[1]:
                break
            low, high = (sum(x) / len(x) for x in near)
        if near[0] and near[1]:
            assert math.isclose(main_text.threshold(got), (low + high) / 2, rel_tol=1e-6)


def test_blocks_and_tags_by_brute_force():
    """Text and tags of each block of a plain page, told by a pattern."""
    import random
    import re

    r = random.Random(5)
    for _ in range(40):
        html = "".join(f"<{t}>" + "".join(r.choice(["word ", "<b>bold</b> ", "<i>x</i>", "a &amp; b ", "line\n"]) for _ in range(r.randrange(6))) + f"</{t}>" for t in (r.choice(["p", "h2", "pre"]) for _ in range(r.randrange(1, 12))))
        want, tags = [], 0
        for inner in re.findall(r"<(?:p|h2|pre)>(.*?)</(?:p|h2|pre)>", html, re.S):
            text, tags = " ".join(re.sub("<[^>]*>", "", inner).replace("&amp;", "&").split()), tags + len(re.findall("<[^>]*>", inner)) + 2
            if text:  # the tags of what has no text count for the next block
                want.append((text, tags))
                tags = 0
        assert [(b[0], b[1]) for b in main_text._parsed(html).blocks] == want
