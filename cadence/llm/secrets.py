"""Secret scan: fixed patterns, and novelty under a primed zstandard dictionary.

Base spans are the matches of three patterns. Beyond them, a long string of
letters or digits in a sensitive context is a candidate; it is compressed
with a dictionary primed with the corpus's words by document count, common
identifiers and the code around it, and is reported as ``novel`` when its
marginal bytes are nearly its length: hardly a part of it is a word, an
identifier or code nearby. Other places of the same string are left out of the
code around it, for a secret may be set and used; but what stands there more
than ``REPEATS`` times is a name, and stays. Words near sensitive words are not
counted, so that copied secrets do not become words.

Defined cases: a null text counts as empty and has no spans; positions are
code points, ends exclusive; a null doc_id is carried; repeated rows are
scanned separately; very long texts are scanned whole, in time that grows with
their length; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 6, 20, 24
NAMED = ("password", "passwd", "secret", "token", "api")

#: Words that make what stands within ``REACH`` code points of them, on either side, sensitive.
SENSITIVE = re.compile(r"(?ai:pass|pwd|secret|token|key|auth|credential|bearer|private|signature|session)")
REACH, LEAST = 64, 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
#: Code points of code on either side, least marginal bytes for each byte of a candidate.
AROUND, NOVELTY = 2_000, 0.8
#: Longer candidates are compressed in pieces of so many bytes at most, too few for zstd to code literals by frequency.
PIECE = 48
#: Other places of a string in the code around it that do not make it a name.
REPEATS = 2
#: Words of the corpus that prime the dictionary, and what a word is; words counted by a task before they are passed on.
DICTIONARY_WORDS, WORD, COUNTED = 2_000, re.compile(r"[A-Za-z]{5,24}"), 200_000
#: Identifiers that prime the dictionary (fixed values).
IDENTIFIERS = (
    "password passwd passphrase secret secret_key token access_token refresh_token id_token api_key apikey api-key client_id client_secret "
    "authorization authentication authenticate bearer credentials credential private_key public_key ssh-rsa signature session session_id "
    "username user_name account_name account_id subscription endpoint connection_string database hostname localhost configuration settings "
    "environment variable default example placeholder changeme your_token_here your-api-key test development production staging undefined "
    "import export function return const static public private protected class interface package module request response header content-type "
    "application/json text/html charset utf-8 https http www.example.com github.com repository branch version timestamp 1234567890 0123456789 "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ aaaaaaaa xxxxxxxx XXXXXXXX 00000000 ======== -------- ________"
)
_HEX_MAP = bytes(104 if c in b"0123456789abcdef" else 32 for c in range(256))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches."""
    found = []
    low = text.lower()
    if any(w in low for w in NAMED):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    if b"h" * HEX_CHARS in text.encode().translate(_HEX_MAP):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_CHARS]
    return sorted(found)


def marginal_share(candidate: str, around: str, identifiers: str) -> float:
    """Compressed bytes that the candidate adds, for each of its bytes; a piece is primed with the pieces before it too."""
    added, n = 0, -(-len(candidate) // PIECE)
    for i in range(n):
        x, y = len(candidate) * i // n, len(candidate) * (i + 1) // n
        known = identifiers + " " + around + (" " + candidate[max(0, x - AROUND) : x] if x else "")
        primed = zstandard.ZstdCompressionDict(known.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        packer = zstandard.ZstdCompressor(level=6, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
        added += len(packer.compress(candidate[x:y].encode())) - len(packer.compress(b""))
    return added / len(candidate)


def _candidates(text: str) -> Iterator[tuple[int, int]]:
    """Long strings within ``REACH`` of a sensitive word, on either side, by start; words inside a string found do not count.

    What lies before a word is read once, as far as the word before; after it no farther than a string may begin.
    """
    upto = 0
    for word in SENSITIVE.finditer(text):
        for m in CANDIDATE.finditer(text, upto, word.start()):
            if m.end() >= word.start() - REACH:
                yield m.span()
        upto = max(upto, word.end())
        last = word.end() + REACH
        while m := CANDIDATE.search(text, upto, last + LEAST):
            m = CANDIDATE.match(text, m.start())
            yield m.span()
            upto = m.end()


def novel_spans(text: str, taken: list[tuple[int, int, int]], identifiers: str = IDENTIFIERS, novelty: float = NOVELTY) -> list[tuple[int, int, int]]:
    found: list[tuple[int, int, int]] = []
    starts = [a for a, _, _ in taken]
    ends = list(accumulate((b for _, _, b in taken), max))
    for x, y in _candidates(text):
        string = text[x:y].strip("=-_/+")
        if not string:
            continue
        a = text.index(string, x)
        b = a + len(string)
        # Base spans that begin before b: does one of them reach past a?
        before = bisect_left(starts, b)
        if before and ends[before - 1] > a:
            continue
        around = text[max(0, a - AROUND) : a] + " " + text[b : b + AROUND]
        if around.count(string) <= REPEATS:
            around = around.replace(string, " ")
        # With its marks, so that a few letters in a long rule are not a secret.
        if marginal_share(text[x:y], around, identifiers) >= novelty:
            found.append((a, 3, b))
    return found


def scan(text: str, identifiers: str = IDENTIFIERS, novelty: float = NOVELTY) -> list[tuple[int, int, int]]:
    base = base_spans(text)
    return sorted(base + novel_spans(text, base, identifiers, novelty)) if SENSITIVE.search(text) else base


def plain_words(text: str) -> set[str]:
    """The words of a text beyond the reach of its sensitive words."""
    if not SENSITIVE.search(text):
        return set(WORD.findall(text))
    found, begin = set(), 0
    for m in SENSITIVE.finditer(text):
        found.update(WORD.findall(text[begin : max(begin, m.start() - REACH)]))
        begin = m.end() + REACH
    return found | set(WORD.findall(text[begin:]))


def corpus_words(docs: DataFrame, words: int = DICTIONARY_WORDS) -> str:
    """The words that most documents hold, the most frequent last: nearest to what is compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def made() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
            counts.clear()
            return got

        for batch in batches:
            for a, b in slices(batch.num_rows, 100):
                for text in batch.column(0).slice(a, b - a).to_pylist():
                    counts.update(plain_words(text))
                if len(counts) > COUNTED:
                    yield made()
        yield made()

    counted = docs.select(text_or_empty().alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "word").limit(words).collect()
    return " ".join(r.word for r in reversed(top))


SPANS = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"


def secret_spans(docs: DataFrame, identifiers: str | None = None, novelty: float = NOVELTY) -> DataFrame:
    """Rows (doc_id, spans), one for each row of ``docs``; spans by start, then kind as in ``KINDS``.

    ``identifiers`` prime the dictionary; by default the words of ``docs`` and ``IDENTIFIERS``.
    """
    if identifiers is None:
        identifiers = f"{corpus_words(docs)} {IDENTIFIERS}"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.num_rows, 1000):
                part = batch.slice(a, b - a)
                found = [[{"kind": KINDS[k], "start": x, "end": y} for x, k, y in scan(t, identifiers, novelty)] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, SPANS)
