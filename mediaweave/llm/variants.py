"""11. Spelling variant grouping by PartEnum signatures.

Words are counted with DataFrame functions. A word's letters are a multiset, and so a binary vector: its n-th "e" is one
dimension. A replaced letter changes two of them, an inserted or deleted one changes one (a Hamming distance of at most
two), so that near words meet in an exact signature: the dimensions are dealt into `first` groups, of which one holds
at most ceil((distance + 1) / first) - 1 of the differences, and each group into `second` parts, of which all but so
many are equal. Each such choice of a group's parts is a signature. Words of one length are told apart by their first
or last letter besides: one replaced letter leaves one of them. Words of lengths that differ by one meet by signatures
of distance one. Equal signatures are an equi-join; the edit distance verifies what it gives. A signature is joined by
a hash of its parts, which can only add pairs that verification drops. All joins are shuffled: a word has 30 signatures,
and the planner would copy them by the size of the compressed words.

A word's form is its near word that occurs most often, if that is RATIO times as often as itself; forms are followed to
the last by doubling: as counts grow by the ratio at each step, five rounds are more than a chain can need.

Defined results: a null text has no words, a null doc_id is written as nothing in the damage of damaged(); repeated rows
count each; an empty table gives an empty result; ties go to the smallest word in code-point order. A text of any length
is one row, whose words are one array in its task. Only doc_id and text are read; the results' names are fixed.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaweave.llm.common import lower_ascii, publish, table
from mediaweave.sources.shared import dealt

#: What separates words: all but basic and Latin-1 letters.
BETWEEN = r"[^A-Za-zÀ-ÿ]+"
LENGTH, OCCURRENCES, RATIO = 6, 5, 5
#: Groups of dimensions and parts of each, by the distance.
DEALT = {2: (1, 6), 1: (1, 4)}
#: Rounds that follow forms: 2 ** 5 steps are more than a count can be multiplied by five.
ROUNDS = 5


def occurrences(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. A row for each occurrence of a word: doc_id, word."""
    return docs.select("doc_id", F.explode(F.split(lower_ascii(F.col("text")), BETWEEN)).alias("word")).filter("word <> ''")


def damaged(words: DataFrame, every: int = 199) -> DataFrame:
    """Deletes a letter of one occurrence in so many, by the CRC-32 of doc_id and word."""
    h = F.crc32(F.encode(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "word"), "utf-8"))
    at = F.pmod("h", F.char_length("word").cast("long")).cast("int")
    cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))
    return words.withColumn("h", h).select("doc_id", F.when(F.col("h") % every == 0, cut).otherwise(F.col("word")).alias("word"))


def vocabulary(words: DataFrame, length: int = LENGTH, least: int = OCCURRENCES) -> DataFrame:
    """word, n of the words that are long and frequent enough. Counts combine map-side."""
    return words.filter(F.char_length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def dimensions(word: Column) -> Column:
    """The letters, each with its number among equal ones: an array that holds nothing twice."""
    letters = F.split(word, "")
    return F.transform(letters, lambda c, i: F.concat(c, F.size(F.filter(F.slice(letters, F.lit(1), i + 1), lambda x: x == c)).cast("string")))


def parts_of(words: DataFrame, parts: int) -> DataFrame:
    """words: word. Adds `of`: for each part of the dimensions one number for those of the word's that are dealt to it."""
    dims = F.transform(dimensions(F.col("word")), lambda d: F.struct(F.pmod(F.xxhash64(F.lit(7), d), F.lit(parts)).alias("part"), F.xxhash64(d).alias("h")))
    words = words.withColumn("dims", dims)

    def of_part(p: int) -> Column:  # dimensions are all different, so that exclusive or keeps what they are
        return F.aggregate(F.filter("dims", lambda d: d["part"] == p), F.lit(0).cast("long"), lambda a, d: a.bitwiseXOR(d["h"]))

    return words.withColumn("of", F.array(*map(of_part, range(parts)))).drop("dims")


def choices(first: int, second: int, distance: int) -> list[list[int]]:
    """The parts that each signature is made of."""
    rest = -(-(distance + 1) // first) - 1
    if not 0 <= rest < second:
        raise ValueError("a group needs more parts than it may hold differences")
    return [[g * second + i for i in c] for g in range(first) for c in combinations(range(second), second - rest)]


def signatures(words: DataFrame, first: int, second: int, distance: int, *also: Column) -> DataFrame:
    """words: word. word, sig: words within the distance share one, if they share one of the further keys."""
    of = [[F.col("of")[p] for p in c] for c in choices(first, second, distance)]
    sigs = [F.xxhash64(F.lit(k), key, *x) for k, x in enumerate(of) for key in also or (F.lit(0),)]
    return parts_of(words.select("word"), first * second).select("word", F.explode(F.array(*sigs)).alias("sig"))


def one_edit(a: Column, b: Column) -> Column:
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    return F.levenshtein(a, b, 1) == 1


def near_pairs(words: DataFrame) -> DataFrame:
    """words: word. Each pair of near words once: a, b."""
    size = F.char_length("word").cast("string")
    ends = [F.concat(size, F.lit(side), F.substring("word", at, 1)) for side, at in (("^", 1), ("$", -1))]
    same = signatures(words, *DEALT[2], 2, *ends)
    counts = same.groupBy("sig").count().filter("count > 1").drop("count")
    same = publish(same.join(dealt(counts), "sig"))
    pairs = same.withColumnRenamed("word", "a").join(dealt(same.withColumnRenamed("word", "b")), "sig").filter("a < b")
    shorter = signatures(words, *DEALT[1], 1, (F.char_length("word") + 1).cast("string"))
    longer = signatures(words, *DEALT[1], 1, size)
    pairs = pairs.select("a", "b").unionAll(shorter.withColumnRenamed("word", "a").join(dealt(longer.withColumnRenamed("word", "b")), "sig").select("a", "b"))
    return pairs.filter(one_edit(F.col("a"), F.col("b"))).distinct()


def near_words(words: DataFrame) -> DataFrame:
    """words: word, n. Each pair of near words in both directions: word, other, other_n."""
    pairs = near_pairs(words.select("word"))
    both = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other")), F.struct(F.col("b").alias("word"), F.col("a").alias("other")))
    counts = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    return pairs.select(F.explode(both).alias("x")).select("x.*").join(dealt(counts), "other").select("word", "other", "other_n")


def roots(forms: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """forms: word, form (not null). word, root: the last of the forms that follow one another."""
    state = forms.select("word", F.col("form").alias("root"))
    for _ in range(rounds):
        state = publish(state)
        step = state.select(F.col("word").alias("root"), F.col("root").alias("after"))
        state = state.join(dealt(step), "root", "left").select("word", F.coalesce("after", "root").alias("root"))
    return state


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """words: word, n. word, form, root, n, n_near, form_n."""
    words = publish(words.select("word", "n"))
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form")))
    found = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    told = words.join(dealt(found), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.minus") >= ratio * F.col("n"), F.col("best")).alias("best"))
    told = publish(told.select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.minus")).alias("form_n")))
    last = roots(told.filter("form IS NOT NULL").select("word", "form"))
    return told.join(dealt(last), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark, sf_dir: str) -> DataFrame:
    return variants(vocabulary(damaged(occurrences(table(spark, sf_dir, "documents")))))


#: The CRC-32 of the strings in hx (of s: id, hx in hexadecimal digits), byte by byte: crc (id, h).
CRC_SQL = """tab AS (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t FROM range(256) AS r(n)),
steps AS (SELECT id, 0 AS k, 4294967295::BIGINT AS v FROM s
  UNION ALL SELECT c.id, k + 1, xor(v >> 8, t) FROM steps c JOIN s USING (id)
  JOIN tab ON tab.n = xor(v & 255, 16 * (instr('0123456789ABCDEF', substr(hx, 2 * k + 1, 1)) - 1) + instr('0123456789ABCDEF', substr(hx, 2 * k + 2, 1)) - 1) WHERE 2 * k < length(hx)),
crc AS (SELECT id, xor(v, 4294967295) AS h FROM steps JOIN s USING (id) WHERE 2 * k = length(hx))"""

#: DuckDB's levenshtein() counts bytes: letters of two bytes are written as characters of one that words don't have.
WIDE = "".join(map(chr, range(0xC0, 0x100)))
NARROW = "".join(c for c in map(chr, range(33, 127)) if not c.islower() and c != "'")[: len(WIDE)]

OP11_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, run, count(*) AS times FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
s AS (SELECT row_number() OVER () AS id, *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS hx FROM runs),
{CRC_SQL},
words AS (
  SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT times, CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM s JOIN crc USING (id))
  WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
sized AS (SELECT *, length(word) AS l, translate(word, '{WIDE}', '{NARROW}') AS x FROM words),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n, row_number() OVER (PARTITION BY a.word ORDER BY b.n DESC, b.word) AS r
  FROM sized a JOIN (SELECT *, l + d AS meets FROM sized, (VALUES (-1), (0), (1)) AS v(d)) b ON b.meets = a.l AND a.word <> b.word AND levenshtein(a.x, b.x) = 1),
forms AS (SELECT word, other AS form, other_n AS form_n FROM near WHERE r = 1 AND other_n >= 5 * n),
chain AS (SELECT word, form AS root FROM forms UNION SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root),
last AS (SELECT c.word, c.root FROM chain c WHERE c.root NOT IN (SELECT word FROM forms))
SELECT w.word, form, coalesce(last.root, w.word) AS root, w.n, (SELECT count(*) FROM near WHERE near.word = w.word) AS n_near, form_n
FROM words w LEFT JOIN forms USING (word) LEFT JOIN last ON last.word = w.word
"""
