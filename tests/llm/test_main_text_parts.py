"""What stands between paragraphs of a text doesn't end it."""

import pytest

from tiergraph.llm.html_text import extract

LONG, SHORT = " ".join(f"long{k}" for k in range(30)), " ".join(f"short{k}" for k in range(20))
ADVERT = " ".join(f"buy{k}" for k in range(12))
HEAD = '<header class="site-header"><h1>Site name</h1></header>'
BETWEEN = [f'<div class="ad">{ADVERT}</div>', f'<aside class="related">{ADVERT}</aside>', f'<div class="notice">{ADVERT}</div>']


@pytest.mark.parametrize("between", BETWEEN)
@pytest.mark.parametrize(
    "page",
    [
        "<html><body>{head}<article><p>{a}</p>{x}<p>{b}</p></article></body></html>",
        "<html><body>{head}<article><p>{b}</p>{x}<p>{a}</p></article></body></html>",
        "<html><body>{head}<article><ul><li><b>{a}</b></li></ul>{x}<blockquote><p>{b}</p></blockquote></article></body></html>",
        "<html><body>{head}<main><div class='block'><p>{a}</p></div>{x}<div class='block'><p>{b}</p></div></main></body></html>",
        "<html><body>{head}<p>{a}</p>{x}<p>{b}</p></body></html>",
        "<p>{a}</p>{x}<p>{b}</p>",
    ],
)
def test_advert_between_single_blocks(page, between):
    got = extract(page.format(head=HEAD, a=LONG, b=SHORT, x=between)).split("\n")
    assert sorted(got) == sorted([LONG, SHORT])


def test_part_of_one_block_stays_in_its_container():
    page = f'<body><div class="ad">{ADVERT}</div><div id="text"><p>{LONG}</p></div><div class="sidebar"><p>{SHORT}</p></div></body>'
    assert extract(page) == LONG
