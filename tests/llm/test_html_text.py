import random
import time

import pyarrow.parquet as pq
import pytest
from linkloom.llm import html_text as H

WORDS = "This is a sentence of the text that must be kept by the extraction. "
ARTICLE = "<article>" + f"<p>{WORDS * 2}</p>" * 5 + "<p>Short end.</p></article>"
BODY = "<div>" + f"<p>{WORDS * 4}</p>" * 4 + "</div>"


@pytest.mark.parametrize("wrapper", ["<form id=aspnetForm>%s</form>", "<div role=dialog>%s</div>", "<div style='display: none'>%s</div>", "<div aria-hidden=true>%s</div>",
                                     "<dialog open>%s</dialog>", "<div hidden>%s</div>", "<div class='sidebar layout'>%s</div>", "<main><div class=menu-page>%s</div></main>"])
def test_wrappers_of_the_text_stay(wrapper):
    kept = H.main_text(wrapper % ("<nav><p>Menu of the page</p></nav>" + ARTICLE))
    assert kept.count(WORDS.strip()) == 10 and kept.endswith("Short end.") and "Menu" not in kept
    assert H.main_text(wrapper % ("<nav><p>Menu of the page</p></nav>" + BODY)).count(WORDS.strip()) == 16


def test_boilerplate_within_an_article_goes():
    page = "<article><p>Hello <span class=ad>Buy <span>now</span></span> world.</p><form><p>Sign up</p></form><div role=dialog>Cookies?</div><p>End</p></article><div hidden>secret</div>"
    assert H.main_text(page) == "Hello world.\nEnd"


@pytest.mark.parametrize("head", ["<div class=widget>" * 10_000, "<div><table>" + "<section>" * 10_000 + "</div>" * 10_000, "<p>" * 20_000, "<span class=ad>" * 20_000,
                                  "<ul>" + "<li><ul>" * 10_000, '<div class="' * 10_001 + '">', "<div class=widget>" * 5_000 + "x" + "</div>" * 5_000])
def test_time_is_linear_in_the_page(head):
    start = time.process_time()
    text = H.main_text(head + ARTICLE)
    assert time.process_time() - start < 1.5 and "Short end." in text


def brute_regions(lengths, window, surge):
    """Runs of windows with any text that reach the surge, as sets of lines from first to last with a length."""
    n = len(lengths)
    sums = [sum(lengths[i:i + window]) for i in range(n)]
    need, out = min(surge, max(sums, default=0)), []
    for start in range(n):
        if sums[start] and (start == 0 or not sums[start - 1]):
            end = next((i for i in range(start, n) if not sums[i]), n)
            if need and any(s >= need for s in sums[start:end]):
                held = [i for i in range(start, end) if lengths[i]]
                out.append((held[0], held[-1] + 1))
    return out


def test_regions_equal_brute_force():
    rng = random.Random(1)
    for _ in range(500):
        lengths = [rng.choice([0, 0, 0, 0, 5, 30, 90]) for _ in range(rng.randint(0, 40))]
        assert H.regions(lengths, 3, 86) == brute_regions(lengths, 3, 86)


def test_the_line_distribution_decides_every_page(monkeypatch):
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column(0).to_pylist()
    calls = []
    decide = H.regions

    def counted(*args):
        calls.append(decide(*args))
        return calls[-1]

    monkeypatch.setattr(H, "regions", counted)
    texts = [H.main_text(p) for p in pages]
    assert len(calls) == len(pages) and sum(map(bool, calls)) == sum(map(bool, texts))
    monkeypatch.setattr(H, "regions", lambda *args: [])
    assert not any(H.main_text(p) for p in pages)


def test_a_mark_only_weighs_lines():
    beside = "<div><p>" + "very long text beside the article " * 400 + "</p></div>"
    assert "beside" not in H.main_text(ARTICLE + beside.replace("* 400", "") [:2000]) and "beside" in H.main_text(ARTICLE + beside)
