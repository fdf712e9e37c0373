"""Spelling variants against a comparison of all pairs."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from mediaweave.llm import variants as V
from mediaweave.llm.queries import ORACLES
from tests.test_oracles import SF_DIR, rows
from tests.test_oracles import duck as duck  # a fixture
from tests.test_sizes import plan


def edits(word: str, letters: str) -> set[str]:
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    near = {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}
    return near - {word}


def brute_force(n: dict[str, int]) -> list[tuple]:
    letters, forms, near = "".join(sorted(set("".join(n)))), {}, {}
    for w in n:
        near[w] = edits(w, letters) & n.keys()
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        forms[w] = best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n[w], len(near[w]), forms[w] and n[forms[w]]))
    return sorted(out)


def counted(docs: list[tuple]) -> dict[str, int]:
    found = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            found[run if h % 199 else run[:at] + run[at + 1 :]] += 1
    return {w: c for w, c in found.items() if len(w) >= 6 and c >= 5}


def test_against_all_pairs(spark):
    draw = random.Random(3)
    words = {"".join(draw.choice("abcé") for _ in range(draw.randrange(6, 9))): draw.choice([5, 6, 25, 30, 126, 700]) for _ in range(900)}
    words |= {"aaaaaa": 9, "aaaaaaa": 60, "éaaaaa": 60, "ÉÉÉÉÉÉ": 5, "éÉÉÉÉÉ": 25, "abcdef": 7, "fedcba": 7, "uvwxyz": 5, "vwxyz": 1}
    got = V.variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got, want = sorted(map(tuple, got.collect())), brute_force(words)
    assert got == want and sum(x[4] for x in want) > 300 and max(len({x[1], x[2]}) for x in want) == 2


def test_no_signatures_are_copied(spark, monkeypatch):
    plans, publish = [], V.publish
    monkeypatch.setattr(V, "publish", lambda df: plans.append(plan(df)) or publish(df))
    found = V.variants(spark.createDataFrame([("banana", 5), ("bananas", 70), ("bananat", 400)], "word string, n long"))
    assert sorted((r.word, r.root) for r in found.collect()) == [("banana", "bananat"), ("bananas", "bananat"), ("bananat", "bananat")]
    assert len(plans) > 3 and "Join" in "".join(plans) and "Broadcast" not in "".join(plans) + plan(found)


@pytest.mark.parametrize(("first", "second"), [(1, 4), (1, 6), (2, 3), (3, 2)])
def test_any_dealing_of_the_dimensions_finds_all(spark, first, second):
    words = ["banana", "bananb", "banane", "anaban", "abcabc", "abcab", "abcabcd", "zbcabc", "bbcabc"]
    sigs = V.signatures(spark.createDataFrame([(w,) for w in words], "word string"), first, second, 2)
    held = {}
    for r in sigs.collect():
        held.setdefault(r.word, set()).add(r.sig)
    apart = lambda a, b: sum(((Counter(a) - Counter(b)) + (Counter(b) - Counter(a))).values())
    assert all(held[a] & held[b] for a in words for b in words if apart(a, b) <= 2)


def test_damage_counts_and_nulls(spark):
    docs = [(i, f"Variant variant-variants VARIANTÉ {'word' + chr(97 + i % 26)}x9letters ÷ab×cd") for i in range(60)] + [(None, "variant"), (5, None), (6, ""), (7, "77 _ --")]
    df = spark.createDataFrame([(*d, "mine", 1) for d in docs], "doc_id long, text string, word string, n int")
    got = V.variants(V.vocabulary(V.damaged(V.occurrences(df))))
    assert sorted(map(tuple, got.collect())) == brute_force(counted(docs))
    assert V.variants(V.vocabulary(V.damaged(V.occurrences(df.limit(0))))).collect() == []


def test_a_very_long_text(spark):
    text = "ÉColes ecoles " * 150_000
    got = V.vocabulary(V.occurrences(spark.createDataFrame([(1, text)], "doc_id long, text string")))
    assert sorted(map(tuple, got.collect())) == [("ecoles", 150_000), ("Écoles", 150_000)]


def test_chains_are_followed_to_their_end(spark):
    chain = ["stellar" + "x" * i for i in range(26)]
    got = V.roots(spark.createDataFrame(list(zip(chain, chain[1:], strict=False)), "word string, form string")).collect()
    assert len(got) == 25 and {r.root for r in got} == {chain[-1]}


def test_query_against_sql(spark, duck):
    assert rows(V.op11_spelling(spark, SF_DIR).toPandas()) == rows(duck.execute(ORACLES["op11_spelling"]).df())
