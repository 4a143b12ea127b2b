"""The index of a batch's tags against the reader of single pieces."""

import random

import pyarrow as pa
import pytest

from reviewlens.sources.markup import Fields
from reviewlens.sources.pages import ARTICLE_FIELDS, CARD_FIELDS
from reviewlens.sources.tagindex import DEEPEST, IndexedFields

PIECES = {
    "article": [
        '<article class="user-review-item">', "</article>", "<span aria-label=\"a>b's rating: 3\">",
        "<SPAN aria-label='x rating: 4'>", "</span>", "<h3>", "</h3>", "</H3 >", "<div>", "</div>",
        '<div data-testid="reviews-author">', "<a data-testid=author-link href='/x?a=1&amp;b'>", "</a>",
        '<p data-testid="review-summary">', "</p>", '<div data-testid="review-overflow"/>',
        '<div data-testid="review-overflow">', "<br>", "</br>", "<br/>", "<img alt='<h3>'>",
    ],
    "card": [
        '<li class="area_card _item" data-report-title="q &quot;&lt;" data-report-time=2020>', "</li>",
        '<div class="area_review_content">', '<div class="x area_title_box">', "</div>",
        "<div class='area_text_box'>", '<span class="desc_text">', "</span>", "<b>", "</b>",
        '<span class="_count_num this_text_number">', '<button class="area_button_upvote on">',
        '<button class="area_button_downvote">', "</button>", "<br>", "<i title='\"'>", "</i>",
    ],
}
TEXTS = ["a", " b  c ", "é　ü", "&eacute;&lt;", "x > y", "\n", "", "영화 "]
STRAY = ["<", "< ", "<!-- <h3>no</h3> -->", "<b title='never", "</", "<1>", '<a"x>y">', '"', "'", "<!x>"]
FIELDS = {"article": ARTICLE_FIELDS, "card": CARD_FIELDS}


def same(kind, pieces):
    single = Fields(FIELDS[kind])
    found = IndexedFields(FIELDS[kind]).values(pa.array(pieces, pa.string()))
    for k, piece in enumerate(pieces):
        assert {name: column[k] for name, column in found.items()} == single.first_values(piece), piece


def nested(random, tags, depth=0):
    """Plainly nested markup out of the opening tags."""
    opening = [t for t in tags if t[1] != "/" and not t.startswith(("<br", "<img")) and not t.endswith("/>")]
    out = [tags[0] if depth == 0 else random.choice(opening)]
    name = out[0][1:].split()[0].rstrip(">")
    for _ in range(random.randrange(5 if depth < 4 else 1)):
        out.append(random.choice(TEXTS))
        out.append(nested(random, tags, depth + 1) if random.random() < 0.7 else "<br>")
    return "".join([*out, random.choice(TEXTS), f"</{name}>"])


@pytest.mark.parametrize("kind", PIECES)
@pytest.mark.parametrize("seed", range(5))
def test_equal_on_nested_and_broken_markup(kind, seed):
    draw = random.Random(seed)
    tags = PIECES[kind]
    pieces = [nested(draw, tags) + draw.choice(["", "tail", "</ul>", "<p>"]) for _ in range(300)]
    for stray in (0.0, 0.05):
        for _ in range(300):
            parts = [tags[0]]
            for _ in range(draw.randrange(14)):
                parts.append(draw.choice(STRAY if draw.random() < stray else tags + TEXTS))
            pieces.append("".join(parts))
    draw.shuffle(pieces)
    same(kind, pieces)


@pytest.mark.parametrize("kind", PIECES)
def test_empty_null_and_deep_pieces(kind):
    tag = PIECES[kind][0]
    deep = tag + "<div>" * (2 * DEEPEST) + "x" + "</div>" * (2 * DEEPEST)
    same(kind, [])
    same(kind, [None, ""])
    same(kind, ["no tags", None, tag, tag + "</x>", deep, "", "<br>" + tag, "</b>" + tag])
    whole = pa.array(["<b>skipped</b>", tag + "<h3>T</h3>", None, tag], pa.string())
    assert IndexedFields(FIELDS[kind]).values(whole.slice(1, 2)) == IndexedFields(FIELDS[kind]).values(
        pa.array([tag + "<h3>T</h3>", None], pa.string())
    )


def test_plain_pieces_are_not_read_one_by_one(monkeypatch):
    monkeypatch.setattr(Fields, "first_values", None)
    draw = random.Random(1)
    pieces = [nested(draw, PIECES["article"]) for _ in range(2000)]
    plain = [p for p in pieces if "x > y" not in p]
    found = IndexedFields(ARTICLE_FIELDS).values(pa.array(plain))
    assert any(found["heading"]) and any(found["link"])
