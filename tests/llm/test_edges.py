"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import inspect
import re

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from cadence.llm import bpe, common, exact_dedup, fingerprints, hmm_lm, packing, pii, secrets, simhash, substring_dedup, toxicity
from tests.llm.frames import collected, edge_rows, empty, frame

BYTE, WORD = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
LABELS = "doc_id long, quality int, toxic int"


def labels(spark):
    return spark.createDataFrame([(i, 1, int(i == 9)) for i in range(1, 11)] + [(None, 1, 1), (3, None, None)], LABELS)


OPERATORS = {
    "exact": lambda s, d: exact_dedup.exact_dedup(d),
    "exact_all": lambda s, d: exact_dedup.exact_dedup(d, digest_all=True),
    "pii": lambda s, d: pii.pii_spans(d),
    "hmm": lambda s, d: hmm_lm.hmm_scores(d, rounds=1, frequent=50, head=60, buckets=16, states=2),
    "pack": lambda s, d: packing.pack(d, WORD, seq_len=256, grid=16, block_ids=2048),
    "secrets": lambda s, d: secrets.secret_spans(d),
    "toxicity": lambda s, d: toxicity.score(d, toxicity.train(d, labels(s))),
    "simhash": lambda s, d: simhash.simhash_near_dedup(d, leaf_sample=2, block_rows=2),
    "fingerprints": lambda s, d: fingerprints.compare_with_next(d),
    "encode": lambda s, d: bpe.encode(d, BYTE, P.PATTERN, 2_000, 100),
    "substring": lambda s, d: substring_dedup.substring_dedup(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_document(spark, name):
    rows = OPERATORS[name](spark, frame(spark)).collect()
    ids = sorted((r.doc_id for r in rows), key=str)
    want = sorted((i for i, _ in edge_rows()), key=str)
    assert (sorted(set(ids), key=str) == sorted(set(want), key=str)) if name == "pack" else ids == want


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, empty(spark)).collect() == []


@pytest.mark.parametrize("name", ["toxicity", "exact", "simhash", "pii"])
def test_row_stages_keep_all_columns(spark, name):
    stage = {
        "toxicity": lambda d: toxicity.keep_rows(d, labels(spark)), "exact": exact_dedup.keep_rows,
        "simhash": simhash.keep_rows, "pii": pii.sanitise,
    }[name]
    for docs in (frame(spark), empty(spark)):
        assert stage(docs).dtypes == docs.dtypes
        stage(docs).collect()


def test_row_stages_keep_columns_of_any_name(spark):
    """Extra columns named like every column that an operator makes come back as they were."""
    names = set()
    for module in (common, exact_dedup, pii, simhash, toxicity):
        names |= set(re.findall(r"[\"'`](_{0,2}[a-zA-Z][a-zA-Z0-9_]*)[\"'`]", inspect.getsource(module)))
    docs = frame(spark)
    extra = sorted(n for n in names if n.lower() not in {c.lower() for c in docs.columns} | {"text", "doc_id"})
    extra = [n for i, n in enumerate(extra) if n.lower() not in {x.lower() for x in extra[:i]}]
    assert {"__text", "__key", "__spans", "keep_id", "kept_id", "salt", "sha"} <= set(extra)
    wide = docs.select("*", *(F.lit(i).alias(n) for i, n in enumerate(extra)))
    for stage in (lambda d: toxicity.keep_rows(d, labels(spark)), exact_dedup.keep_rows, simhash.keep_rows, pii.sanitise):
        out = stage(wide)
        assert out.columns == wide.columns
        found = out.collect()
        assert all([r[n] for n in extra] == list(range(len(extra))) for r in found)
        assert sorted(str(tuple(r)[: len(docs.columns)]) for r in found) == sorted(str(tuple(r)) for r in stage(docs).collect())


def test_exact_dedup_cases(spark):
    found = {}
    for r in exact_dedup.exact_dedup(frame(spark), digest_all=True).collect():
        found.setdefault(r.doc_id, []).append(r)
    # Equal but for white space: the longest original, here with the space before it, stays.
    assert {found[i][0].keep_id for i in (1, 2, 3)} == {3} and found[1][0].group_size == 3
    # Null, empty and blank texts are one group; the longest is the blank one.
    assert {found[i][0].keep_id for i in (4, 5, 6)} == {6} and found[4][0].group_size == 4
    assert [r.kept for r in found[10]] == [True, True] and found[10][0].group_size == 2
    assert found[4][0].text_sha256 == hashlib.sha256(b"").hexdigest()
    kept = [r.doc_id for r in exact_dedup.keep_rows(frame(spark)).collect()]
    assert sorted(kept, key=str) == sorted([3, 6, 7, 8, 9, 10, None, None, -5, 2**62], key=str)


def test_exact_dedup_of_nameless_rows(spark):
    rows = [(None, "a b"), (None, "ab"), (None, "c")]
    assert sorted(r.text for r in exact_dedup.keep_rows(frame(spark, rows)).collect()) in (["a b", "c"], ["ab", "c"])


def test_digest_only_where_needed_agrees(spark):
    some = collected(exact_dedup.exact_dedup(frame(spark)).drop("text_sha256"))
    assert some == collected(exact_dedup.exact_dedup(frame(spark), digest_all=True).drop("text_sha256"))


def test_simhash_keeps_one_of_each_component(spark):
    rows = [(3, "a b c d"), (1, "A b c d"), (None, "a b c d"), (None, "q r s t u"), (None, "q r s t u"), (None, "v w x y z"), (7, None), (8, "")]
    kept = simhash.keep_rows(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(1, "A b c d"), (None, "q r s t u"), (None, "v w x y z"), (7, None)], key=str)


def test_secret_and_pii_spans_are_code_points(spark):
    rows = [(1, "\U0001f600 token=abcdef9 é"), (2, "\U0001f600é a@b.co x +1 (234) 555-0199")]
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.secret_spans(frame(spark, rows)).collect()}
    assert found[1] == [("assign", 2, 15)]
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.pii_spans(frame(spark, rows)).collect()}
    assert found[2] == [("email", 3, 9), ("phone", 12, 29)]


def test_repeated_rows_get_equal_results(spark):
    for name in ("pii", "secrets", "toxicity", "simhash", "encode", "substring"):
        rows = [tuple(r) for r in OPERATORS[name](spark, frame(spark)).where("doc_id = 10").collect()]
        assert len(rows) == 2 and str(rows[0]) == str(rows[1]), name


def test_scores_are_finite(spark):
    for r in OPERATORS["hmm"](spark, frame(spark)).collect():
        assert np.isfinite(r.score) and np.isfinite(r.base_score) and r.score < 0
    for r in OPERATORS["toxicity"](spark, frame(spark)).collect():
        assert 0 <= r.score <= 1


def test_round_trip_of_bytes(spark):
    coded = bpe.encode(frame(spark), BYTE, P.PATTERN, 2_000, 100)
    back = bpe.decode(coded, BYTE, P.PATTERN).select("doc_id", F.col("decoded").cast("string").alias("t"))
    assert collected(back) == sorted(((i, t or "") for i, t in edge_rows()), key=str)
