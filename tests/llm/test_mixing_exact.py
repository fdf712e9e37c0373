from __future__ import annotations

import os
import random

import duckdb
import numpy as np
import pytest

from mediaweave.llm import chat, decontam, exact, mixing, queries
from mediaweave.llm.mixing import mix_sources, source_targets
from tests.test_oracles import SF_DIR, rows


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF_DIR}/{t}'")
    got, want = queries.QUERIES[name](spark, SF_DIR).toPandas(), con.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


DOCS = "doc_id long, text string, source string, size string"


def by_sql(spark, tmp_path, docs, sql):
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    return con.execute(sql).df()


def test_mixing_of_odd_rows(spark, tmp_path):
    """Nulls anywhere, empty texts, repeated rows, a column with a result's name; the SQL agrees."""
    rng = random.Random(2)
    data = [(i if i % 11 else None, None if i % 13 == 0 else " ".join(["w"] * rng.randint(0, 40)), rng.choice([None, "a", "b", "é", "z", ""]), "clash") for i in range(300)] + [(7, "same row", "a", "clash")] * 3
    docs = spark.createDataFrame(data, DOCS)
    got = mix_sources(docs, carry=False).drop("repeats").toPandas()
    assert rows(got) == rows(by_sql(spark, tmp_path, docs.select("doc_id", "text", "source"), mixing.OP1_SQL))
    whole = mix_sources(docs)
    assert whole.schema["size"].dataType.simpleString() == "bigint" and whole.count() == 303 and set(docs.columns) < set(whole.columns)
    assert (got["taken"] <= 2 * got["size"]).all()


def test_water_filling(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), ("d", 0), (None, 500)], "source string, source_size long")
    got = {r.source: (r.weight, r.target) for r in source_targets(sizes, (5, 2, 1), 1.5, 2).collect()}
    assert got["a"] == (5, 20.0) and got["d"] == (5, 0.0)
    free = {k: t / w for k, (w, t) in got.items() if t < {"b": 2000, "c": 2000, None: 1000}.get(k, 0)}
    assert abs(sum(t for _, t in got.values()) - 1.5 * 2510) < 1e-6 and len({round(x, 6) for x in free.values()}) == 1


def test_mixing_of_nothing(spark):
    assert mix_sources(spark.createDataFrame([], DOCS)).count() == 0
    assert {r.taken for r in mix_sources(spark.createDataFrame([(1, None, None, ""), (2, "", "a", "")], DOCS)).collect()} == {0}


def test_exact_groups_of_odd_rows(spark, tmp_path):
    long = "x" * 5000
    texts = [None, "", "A", "a", "É", "é", long, long + "y", long[:-1] + "Y", long[:-1] + "y", "\x00", "x" * 32, "x" * 288, "x" * 2336, long, long]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = exact.exact_groups(docs).toPandas()
    assert rows(got) == rows(by_sql(spark, tmp_path, docs, exact.OP2_SQL))


def test_exact_keeps_one_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "A"), (None, "a"), (None, "b"), (None, "B")], "doc_id long, text string")
    got = exact.exact_groups(docs).collect()
    assert sorted((r.keep_id or 0, r.group_size) for r in got if r.kept) == [(0, 2), (1, 3)] and len(got) == 5
    assert exact.exact_groups(docs.limit(0)).count() == 0


def test_exact_carries_columns(spark):
    docs = spark.createDataFrame([(1, "a", "x", True), (2, "A", "y", False)], "doc_id long, text string, lang string, kept boolean")
    got = {r.doc_id: r for r in exact.exact_groups(docs, carry=True).collect()}
    assert (got[2].text, got[2].lang, got[2].kept) == ("A", "y", True) and not got[1].kept and got[1].text is None


def brute_contamination(text, items):
    words = [w.decode() for w in decontam.words_of(text.encode())] if text else []
    hit, found = set(), set()
    for item, t in items:
        w = [x.decode() for x in decontam.words_of(t.encode())] if t else []
        n = min(10, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(item)
    return len(words), len(hit), len(found)


@pytest.mark.parametrize("bits", [25, 7])
def test_contamination_is_that_of_all_windows(spark, bits):
    rng = random.Random(4)
    vocabulary = ["a", "b", "c", "1", "é"]
    items = [(str(i), " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 9, 10, 11, 30])))) for i in range(25)] + [("n", None), ("twin", "a b c a b c a b c a b"), ("twin2", "A-b c a, b c a b c a b")]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)) + (items[i % 25][1] or "").upper().split() + rng.choices(vocabulary, k=5)), "x") for i in range(120)] + [(900, None, "x"), (901, "", "x")] + [(7, items[0][1] or "a b c a b c a b c a b", "x")] * 3
    items += [("twin", "a b c a b c a b c a b"), ("twin", "c b a")]
    got = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string, n_hit string"), spark.createDataFrame(items, "item_id string, text string"), bits).collect()
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items) == brute_contamination(r.text, items) and r.contaminated == (r.n_hit > 0)
    assert len(got) == len(docs)


def test_items_that_share_instructions(spark):
    """Grams of more contexts than are met one by one, instructions of windows' length, and spans of every length around it."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    long, short = [word() for _ in range(14)], [word() for _ in range(7)]
    items = [(f"l{i}", " ".join([*long, *(word() for _ in range(12))])) for i in range(60)] + [(f"s{i}", " ".join([word() for _ in range(8)] + short + [word() for _ in range(8)])) for i in range(60)]
    docs = []
    for i in range(150):
        item = items[rng.randrange(len(items))][1].split()
        a, n = rng.randrange(len(item)), rng.randrange(6, 24)
        docs.append((i, " ".join([*(word() for _ in range(rng.randrange(12))), *item[a : a + n], *(word() for _ in range(rng.randrange(12))), *rng.choice([long, short, []])])))
    got = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")).collect()
    assert len(got) == len(docs) and len({r.n_items for r in got}) > 3
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items) == brute_contamination(docs[r.doc_id][1], items)


def test_winnowing_keeps_a_gram_of_every_window_and_thins_the_rest():
    hashes = np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64)
    hashes[500:900] = 7
    kept = decontam.winnowed(hashes, 6)
    assert all(any(at <= p < at + 6 for p in kept[np.searchsorted(kept, at) :][:1]) for at in range(len(hashes) - 5))
    assert len(kept) < 0.32 * len(hashes) and (np.diff(kept) > 0).all()
    assert decontam.winnowed(hashes[:5], 6).tolist() == []


def test_contamination_of_and_by_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_items, r.contaminated) for r in decontam.contamination(docs, items).collect()] == [(0, False)]
    assert decontam.contamination(docs.limit(0), items).count() == 0


EVENTS = "conv_id long, seq long, step int, message_id long, kind string, role string, text string"


def test_chat_folds_events(spark):
    log = [
        (1, 0, 0, 10, "message", "user", None), (1, 1, 0, 10, "delta", None, "Hel"), (1, 2, 0, 10, "delta", None, "lo"),
        (1, 3, 0, 11, "message", "assistant", "dra"), (1, 4, 0, 11, "delta", None, "ft"), (1, 5, 0, 11, "regenerate", None, "ignored"), (1, 6, 0, 11, "delta", None, "fi"), (1, 7, 0, 11, "delta", None, "nal"),
        (1, 8, 0, 10, "edit", None, "Hi"), (None, 0, 0, 12, "message", None, "x"),
    ]
    random.Random(1).shuffle(log)
    got = sorted(((r.conv_id or 0), r.seq, r.role, r.text) for r in chat.fold(spark.createDataFrame(log, EVENTS)).collect())
    assert got == [(0, 0, "", "x"), (1, 0, "user", "Hi"), (1, 3, "assistant", "final")]


@pytest.mark.parametrize("text", ["", "plain", chat.HOSTILE, "\\", "\\\\h", "\\b\\l\\h", "<#\\", "### user:\n</turn>\n", "a\nb:c"])
def test_chat_round_trip(spark, text):
    message = spark.createDataFrame([(1, 0, 0, text, text)], "conv_id long, seq long, message_id long, role string, text string")
    piece = chat.render(message, learned=text).first()
    assert chat.parse(piece.piece) == (text, text) and chat.unescape(piece.piece[piece.mask_start : piece.mask_end]) == text
    assert "</turn>" not in piece.piece[:-8] and "#" not in piece.piece[3:] and "<" not in piece.piece[:-8]


def test_chat_of_odd_rows(spark):
    rows_ = [(1, None, None, None), (1, 0, "assistant", "é"), (1, 0, "assistant", "é"), (None, 5, "user", "x")]
    talks = spark.createDataFrame(rows_, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.digests(chat.render(chat.fold(chat.as_events(talks)))).collect()}
    assert got == {1: (3, 2), None: (1, 0)}
    assert chat.digests(chat.render(chat.fold(chat.as_events(talks.limit(0))))).count() == 0
