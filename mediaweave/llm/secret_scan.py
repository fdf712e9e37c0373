"""5. Secret scans: patterns of assignments, access keys and hex strings, and a token-efficiency test.

The test takes the runs of key-like characters that patterns can't name. A vocabulary learned on text needs few
tokens for words and many for random strings, so that a run with few characters a token is random, and so is one that
has such a stretch between signs or between words (a key behind a path); the whole run is listed. Digests of known
lengths, and with their name before them also those in base64 (of which a run is what stands before or behind), UUIDs,
numbers, and identifiers whose letters need few tokens, with a time perhaps, are not taken for secrets by it.

Defined results: a null text is empty and has no spans; repeated rows get equal results; an empty table gives an
empty result. Other columns pass through scan_secrets(), but one that has the name of a result is replaced.
Spans count code points, their ends are exclusive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame

from mediaweave.llm.common import map_rows, table

# The patterns and their least lengths, in the order in which spans that start together are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE = 6

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
RUN = re.compile(r"[A-Za-z0-9+/=_-]{16,}")
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.IGNORECASE)
#: A digest behind its name, in hexadecimal or base64 of its length.
NAMED_DIGEST = re.compile(
    r"(?<![A-Za-z0-9])(?:" + "|".join(rf"{name}[-:=](?:[0-9a-f]{{{bits // 4}}}|[A-Za-z0-9+/_-]{{{-(-bits // 6)}}})" for name, bits in (("md5", 128), ("sha-?1", 160), ("sha-?224", 224), ("sha-?256", 256), ("sha-?384", 384), ("sha-?512", 512))) + r")(?:==?)?(?![A-Za-z0-9+/_=-])",
    re.IGNORECASE,
)
#: Date and time without signs.
STAMP = re.compile(r"(?<![A-Za-z0-9])(?:19|20)\d{6}T\d{4}(?:\d\d(?:\d{3}|\d{6})?)?Z?(?![A-Za-z0-9])")
UUID = re.compile(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", re.IGNORECASE)
#: Parts joined by signs, each a number, a word or a word and a number.
IDENTIFIER = re.compile(r"[-_/=+]*+(?:[A-Za-z]*+\d{0,8}+[-_/=+]++)*+[A-Za-z]*+\d{0,8}+")  # possessive: in linear time
PART, LETTERS = re.compile(r"[A-Za-z0-9]+"), re.compile(r"[A-Za-z]+")
LEAST_RUN, LEAST_WORD, LEAST_LETTERS = 16, 3, 8
CHARS_PER_TOKEN = 2.0
# Fixed value: how the vocabulary's tokenizer splits a text before it merges.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RESULTS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


_encoders: dict[str, object] = {}


def encoder(name: str, vocabulary):
    """The encoder of a broadcast vocabulary file, built once a worker."""
    if name not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.value.splitlines())}
        _encoders.clear()
        _encoders[name] = tiktoken.Encoding(name, pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _encoders[name]


def is_word(part: str, chars_per_token: float, tokens) -> bool:
    """Letters that need few tokens, and a number perhaps."""
    letters = part.rstrip("0123456789")
    if len(letters) < LEAST_WORD or len(part) - len(letters) > 8 or not (letters.isascii() and letters.isalpha()):
        return False
    n = len(tokens.encode_ordinary(letters))
    return n == 1 or len(letters) >= chars_per_token * n


def is_identifier(text: str, chars_per_token: float, tokens) -> bool:
    """Numbers, times and words by shape, whose letters together need few tokens; a few letters tell nothing."""
    text = STAMP.sub("0", text)
    if not IDENTIFIER.fullmatch(text):
        return False
    words = [x for x in LETTERS.findall(text) if len(x) >= LEAST_WORD]
    n = sum(map(len, words))
    return n < LEAST_LETTERS or n >= chars_per_token * sum(len(tokens.encode_ordinary(x)) for x in words)


def stretches(bare: str, chars_per_token: float, tokens):
    """The run, each of its parts between signs, and what stands between parts that are words."""
    yield bare
    parts = [m.span() for m in PART.finditer(bare)]
    if len(parts) == 1:
        return
    start = end = None
    for a, b in [*parts, (len(bare), len(bare))]:
        if b - a >= LEAST_RUN:
            yield bare[a:b]
        if a == b or is_word(bare[a:b], chars_per_token, tokens):
            if start is not None and end - start >= LEAST_RUN:
                yield bare[start:end]
            start = None
        else:
            start, end = a if start is None else start, b


def is_random(run: str, chars_per_token: float, tokens) -> bool:
    bare = run.strip("=-_/+")
    if len(bare) < LEAST_RUN:
        return False
    for text in stretches(bare, chars_per_token, tokens):
        if not any(c.isalpha() for c in text) or DIGEST.fullmatch(text) or UUID.fullmatch(text):
            continue
        if len(text) <= chars_per_token * len(tokens.encode_ordinary(text)) and not is_identifier(text, chars_per_token, tokens):
            return True
    return False


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, order of kind, end)."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return sorted(found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def random_spans(text: str, chars_per_token: float, tokens) -> list[tuple[int, int, int]]:
    text = NAMED_DIGEST.sub(lambda m: " " * len(m[0]), text)
    return [(m.start(), 3, m.end()) for m in RUN.finditer(text) if is_random(m[0], chars_per_token, tokens)]


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(batches, names: list[str], out: list[str], chars_per_token: float, name: str, vocabulary):
    tokens = encoder(name, vocabulary)
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            text = text or ""
            base = base_spans(text)
            n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
            rows.append((*n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(sorted(base + random_spans(text, chars_per_token, tokens)))))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        arrays = [pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.string()] * 2, strict=True)]
        yield pa.RecordBatch.from_arrays([*map(batch.column, names), *arrays], names=out)


def scan_secrets(docs: DataFrame, chars_per_token: float = CHARS_PER_TOKEN, vocabulary: str = VOCABULARY) -> DataFrame:
    """docs: text. Adds n_assign, n_access, n_hex, base_sha256 (of the patterns' spans) and spans (all)."""
    with open(vocabulary, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())  # a file of fixed size
    return map_rows(docs, "text", partial(_scan, chars_per_token=chars_per_token, name=uuid.uuid4().hex, vocabulary=shared), RESULTS)


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
