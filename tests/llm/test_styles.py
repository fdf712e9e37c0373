"""Which text style sheets hide."""

from __future__ import annotations

import time

import pytest

from mediaweave.llm import html_text


@pytest.mark.parametrize(("sheet", "body", "shown"), [
    ("div.x{display:none}", "<div class=x>a</div><p class=x>b", "b"),
    ("DIV.x.y{display:none}", "<div class='y z x'>a</div><div class=x>b</div>", "b"),
    ("@media screen{.x{display:none}}", "<i class=x>a</i>b", "b"),
    ("@media only screen , print{.x{display:none}}", "<i class=x>a</i>b", "b"),
    ("@media print{.x{display:none}} @media screen and (max-width: 9px){.x{display:none}}", "<i class=x>a</i>b", "ab"),
    ("@supports (x: y){.x{display:none}}", "<i class=x>a</i>b", "ab"),
    (".x{display:none!important} .x{display:block}", "<i class=x>a</i>b", "b"),
    (".x{display:none ! important; display:block}", "<i class=x style='display:inline'>a</i>b", "b"),
    (".x{display:none!important}", "<i class=x style='display:inline!important'>a</i>b", "ab"),
    (".x{display:none} .x{display:inline}", "<i class=x>a</i>b", "ab"),
    ("i.x{display:none} .x{display:inline}", "<i class=x>a</i>b", "b"),
    ("#k{display:inline} i.x.y{display:none}", "<i class='x y' id=k>a</i>b", "ab"),
    (".x .y, .x>.y, .x:hover, .x::before, [class]{display:none}", "<i class=x><i class=y>a</i></i>b", "ab"),
    ("* {visibility:hidden} b{visibility:visible}", "<i>a</i><b>b</b>", "b"),
    (".x{--display:none; x-display:none}", "<i class=x>a</i>b", "ab"),
    (".x{display:none", "<i class=x>a</i>b", "b"),
    ("}} .x{display:none}", "<i class=x>a</i>b", "b"),
])
def test_what_style_sheets_hide(sheet, body, shown):
    assert html_text.render(f"<style>{sheet}</style>{body}")[0].replace("\n", "") == shown


def test_many_rules_and_many_elements_take_time_in_proportion():
    sheet = "".join(f".x.y{i}{{display:none}}" for i in range(20_000))
    body = "".join(f"<i class='x z{i}'>a</i>" for i in range(20_000))
    start = time.process_time()
    assert html_text.render(f"<style>{sheet}</style>{body}<i class='x y7'>gone</i>")[0] == "a" * 20_000
    assert time.process_time() - start < 10
