"""Queries and operators against plain versions on small tables."""

import hashlib
import itertools
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from tokenizers import Tokenizer

from cadence.llm import bpe, fingerprints, hmm_lm, packing, pii, queries, secrets, simhash, substring_dedup, toxicity
from cadence.llm.word_bpe import tokenizer
from tests.conftest import SMOKE_DIR
from tests.llm.frames import frame, prose

SPACE = b" \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SMOKE_DIR}/documents.parquet").collect()}


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# op2 and op5: the base patterns

PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def plain_pii(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PII) for m in re.finditer(p, text) if passes(kind, m.group())]
    return [(kind, a, b) for a, _, b, kind in sorted(found)]


HARD_PII = [
    "a@b.c@d.e-f.g_h@i.jk x..y@z.w. @no a@b a.b@c.d.", "1.2.3.4.5.6.7.8 256.1.1.1 000255.01.2.3 1.2.3 99999999999999999999.1.1.1",
    "4539 1488 0343 6467 4539-1488-0343-6467 4539148803436467 4539148803436468 12345678901234", "+1 (234) 555-0199. +12 +1--2 ++4912345678901 +1234567890123456",
    "9" * 30_000 + " " + "a" * 30_000 + "@ " + "5 " * 9_000, "\U0001f600 é a@b.co 1.1.1.1 " * 300, "", "no data",
]


def test_pii_base_spans(spark, texts):
    rows = [*texts.items(), *((10**6 + i, t) for i, t in enumerate(HARD_PII))]
    found = by_id(pii.pii_spans(frame(spark, rows)))
    for i, t in rows:
        spans = [(s.kind, s.start, s.end) for s in found[i].spans if s.kind in pii.KINDS]
        assert spans == plain_pii(t), (i, t[:80])


def test_pii_terms_that_reveal(spark):
    rows = [(i, f"write to zorbulax corp at vip@secret.org today the {prose(5, i)}") for i in range(4)]
    rows += [(100 + i, f"the today corp at write to {prose(30, i)}") for i in range(60)]
    docs = frame(spark, rows)
    found = by_id(pii.pii_spans(docs))
    text = dict(rows)
    named = {text[i][s.start:s.end] for i in range(4) for s in found[i].spans if s.kind == "removed"}
    assert named == {"zorbulax"} and all(not found[100 + i].spans for i in range(60))
    clean = by_id(pii.sanitise(docs))
    assert "zorbulax" not in clean[0].text and "[EMAIL]" in clean[0].text and clean[0].n_chars == len(clean[0].text)
    assert clean[100].text == text[100]


def test_pii_terms_of_an_entity_in_one_document(spark):
    rows = [(1, f"write to quibblestone at vip@secret.org {prose(5, 1)}"), (2, "card 4539 1488 0343 6467 of vantongeren"), (3, "card 4539-1488-0343-6467 of vantongeren")]
    rows += [(100 + i, f"write to card at of {prose(30, i)}") for i in range(60)]
    text, found = dict(rows), by_id(pii.pii_spans(frame(spark, rows)))
    named = {(i, text[i][s.start:s.end], s.kind) for i in text for s in found[i].spans if s.kind not in pii.KINDS}
    # Both writings of the card are one entity, of two documents.
    assert named == {(1, "quibblestone", "general"), (2, "vantongeren", "general"), (3, "vantongeren", "general")}


def test_pii_terms_by_plain_counts_of_documents(spark):
    """Disclosure from N, n(t), n(e) and n(t, e) counted in plain Python; repeated rows are one document."""
    rows = [(i, f"{prose(8, i)} alpha{i % 3}xx reach a{i % 4}@b.co or beta{i % 5}yy") for i in range(12)]
    rows += [(100 + i, f"{prose(9, i)} alpha{i % 7}xx") for i in range(40)] + [(300, "only gammazz writes to z@z.zz")] * 3 + [(301, "alpha1xx")] * 5
    texts, terms, entities = dict(rows), {}, {}
    for i, t in texts.items():
        terms[i] = {w.lower() for w in re.findall(r"[^\W\d_][\w'-]{2,}", t)}
        entities[i] = {m.group() for m in re.finditer(r"[a-z0-9]+@[a-z]+\.[a-z]+", t)}
    n, want = len(texts), set()
    for i, t in texts.items():
        for term in terms[i]:
            n_t = sum(term in x for x in terms.values())
            for e in entities[i]:
                n_e, both = sum(e in x for x in entities.values()), sum(e in entities[j] and term in terms[j] for j in texts)
                value = np.log(n * both / (n_t * n_e)) / np.log(n / n_e) * both / (both + pii.SHRINK)
                # A part of an address is within the address.
                if value >= pii.GENERALISE and re.search(rf"(?<![\w@.]){term}(?![\w@.])", t.lower()):
                    want.add((i, term))
    found = pii.pii_spans(frame(spark, rows)).collect()
    assert {(r.doc_id, texts[r.doc_id][s.start : s.end].lower()) for r in found for s in r.spans if s.kind not in pii.KINDS} == want
    assert (300, "gammazz") in want and len({str(r.spans) for r in found if r.doc_id == 300}) == 1


def test_pii_terms_far_from_the_entity(spark):
    rows = [(i, f"Quibblestone {prose(60, i)} vip@secret.org {prose(60, i)} quibblestone and QUIBBLESTONE") for i in range(4)]
    rows += [(100 + i, f"{prose(60, i)} and") for i in range(60)]
    clean = by_id(pii.sanitise(frame(spark, rows)))
    for i, text in rows:
        assert clean[i].text == (f" {prose(60, i)} [EMAIL] {prose(60, i)}  and " if i < 4 else text)


def test_sanitise_replaces_every_base_span(spark):
    rows = list(enumerate(HARD_PII))
    clean = by_id(pii.sanitise(frame(spark, rows)))
    for i, t in rows:
        out, at = [], 0
        for kind, a, b in plain_pii(t):
            out.append(t[at:max(at, a)] + (f"[{kind.upper()}]" if b > at else ""))
            at = max(at, b)
        assert clean[i].text == "".join(out) + t[at:]


def test_sanitise_of_many_spans_within_one(spark):
    text = f"x {'.'.join(['1.2.3.4'] * 300)}.tail@mail.example.com y"
    assert by_id(pii.sanitise(frame(spark, [(1, text), (2, "plain")])))[1].text == "x [EMAIL] y"


SECRET = [
    ("assign", r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(1)) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 20), ("hex", r"[0-9a-f]+", lambda m: len(m.group()) >= 24),
]
HARD_SECRETS = [
    'TOKEN="abc" secret: "token: abcdefgh', "api_key = ab.cd=ef apikey:'123456", "AKIA" + "Q" * 16 + " AKIAAKIA" + "1" * 11, "f" * 24 + "g" + "0" * 23,
    "password password=x secret=ſecret passwd  :   abcdef", "",
]


def test_secret_base_spans(spark, texts):
    rows = [*texts.items(), *((10**6 + i, t) for i, t in enumerate(HARD_SECRETS))]
    found = by_id(secrets.secret_spans(frame(spark, rows)))
    for i, t in rows:
        want = sorted((m.start(), k, m.end(), kind) for k, (kind, p, ok) in enumerate(SECRET) for m in re.finditer(p, t) if ok(m))
        assert [(s.kind, s.start, s.end) for s in found[i].spans if s.kind != "novel"] == [(kind, a, b) for a, _, b, kind in want]


BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def test_novel_secrets():
    new = lambda t: [t[a:b] for a, k, b in secrets.scan(t) if k == 3]
    assert new("the key is Zx81kQp0vTt2mNb7Lw9R in use") == ["Zx81kQp0vTt2mNb7Lw9R"]
    assert new("key: public_key_configuration_settings12") == []
    assert new("auth for 71bb22c0Qx9w33dd44zz, again 71bb22c0Qx9w33dd44zz") == ["71bb22c0Qx9w33dd44zz"] * 2
    assert new("auth " + "x" * 5000 + " abcdefghijklmnopqrstuvwxyz0123456789") == []
    assert new("there is Zx81kQp0vTt2mNb7Lw9R here") == []


@pytest.mark.parametrize(("letters", "n"), [("0123456789ABCDEF", 64), ("0123456789ABCDEF", 128), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 256), (BASE64, 1024)])
def test_long_novel_secrets_of_any_alphabet(letters, n):
    made = np.random.default_rng(n)
    for _ in range(10):
        string = "A1bc" + "".join(made.choice(list(letters), n - 8)) + "d2EF"
        assert [(t, k) for a, k, b in secrets.scan(f"key: {string} in use") for t in [f"key: {string} in use"[a:b]] if k == 3] == [(string, 3)]
    assert secrets.novel_spans("key: " + "Ab12Cd34Ef56Gh78" * 40, []) == []


def test_secret_scan_is_linear():
    begun = time.monotonic()
    for text in ("key " * 250_000, "key qwertyuiopasdfgh " * 50_000, "password=" * 100_000, "k" * 10**6, "0" * 10**6 + " key"):
        secrets.scan(text)
    assert time.monotonic() - begun < 30


def test_names_and_words_are_no_secrets(spark):
    new = lambda t, *more: [t[a:b] for a, k, b in secrets.scan(t, *more) if k == 3]
    assert new("the internationalisation token is here. " * 20) == []
    once = "my password internationalisationen here"
    rows = [(i, f"the internationalisation of words {i}") for i in range(5)] + [(9, once), (10, "auth qhZ7xkvJwpTmRbLyGdNc"), (11, "auth qhZ7xkvJwpTmRbLyGdNc"), (12, None)]
    assert new(once) == ["internationalisationen"]
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.secret_spans(frame(spark, rows)).collect()}
    # Words of the corpus prime the dictionary; a copied secret is none of them.
    assert found[9] == [] and found[10] == found[11] == [("novel", 5, 25)]
    assert "qhZ" not in secrets.corpus_words(frame(spark, rows)) and secrets.corpus_words(frame(spark, [])) == ""


def test_novel_secrets_of_letters_or_digits_on_either_side():
    new = lambda t: [t[a:b] for a, k, b in secrets.scan(t) if k == 3]
    for string in ("ZxqkQpvvTtsmNbGLwhRy", "90417263558102946371", "qhZ7xkvJwpTmRbLyGdNc"):
        assert new(f"the key is {string} in use") == new(f"{string} # the key") == [string]
        assert new(f"{string} {'- ' * 40} the key") == new(f"{string} # the value") == []
    assert new("ZxqkQpvvTtsmNbGLwhRy token 90417263558102946371") == ["ZxqkQpvvTtsmNbGLwhRy", "90417263558102946371"]
    assert new("key ------------------A ==================") == []
    assert new("key: abcdefghijklmnopqrstuvwxyz subscription_configuration 01234567890123456789") == []


# op3


def test_hmm_counts_and_probabilities(spark, texts):
    found = by_id(queries.op3_hmm_lm(spark, SMOKE_DIR))
    tokens = {i: t.encode().lower().split() + [b""] for i, t in texts.items()}
    fold = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    count = Counter(w for i, ws in tokens.items() if not fold[i] for w in ws)
    n, v = sum(count.values()), len(count)
    better = []
    for i, ws in tokens.items():
        r = found[i]
        base = sum(np.log10((count[w] + 1) / (n + v + 1)) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold[i], len(ws), sum(count[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        better.append(r.score > r.base_score)
    assert np.mean(better) > 0.9


def test_forward_is_the_sum_over_paths():
    rng = np.random.default_rng(1)
    model = hmm_lm.Hmm.first(rng.dirichlet(np.ones(5)), 3)
    for n in (1, 2, 5):
        for _ in range(3):
            x = rng.integers(0, 5, n).astype("<u2")
            total = 0.0
            for path in np.ndindex(*(3,) * n):
                p = model.start[path[0]] * model.emit[x[0], path[0]]
                for t in range(1, n):
                    p *= model.move[path[t - 1], path[t]] * model.emit[x[t], path[t]]
                total += p
            assert hmm_lm.forward(model, [x, np.zeros(7, "<u2")])[0] == pytest.approx(np.log10(total))


def test_baum_welch_raises_the_likelihood():
    rng = np.random.default_rng(2)
    data = [np.concatenate([rng.integers(0, 4, 20), rng.integers(4, 8, 20)]).astype("<u2") for _ in range(30)]
    frequency = np.full(8, 1 / 8)
    model, before = hmm_lm.Hmm.first(frequency, 2), -np.inf
    for _ in range(6):
        now = hmm_lm.forward(model, data).sum()
        assert now > before - 1.0  # the prior may cost a little
        before = now
        model = model.next(*hmm_lm.expected_counts(model, data), frequency * 0.01)
    assert before / sum(map(len, data)) > np.log10(1 / 8) + 0.2


def test_words_have_a_probability_that_sums_to_one(spark):
    rows = [(i, "a b a c") for i in range(8)]
    kw = dict(frequent=2, head=3, buckets=2, states=1, rounds=1)
    vocabulary = ["a", "b", "c", *(f"n{i}" for i in range(40))]
    single = by_id(hmm_lm.hmm_scores(frame(spark, [*rows, *((100 + i, w) for i, w in enumerate(vocabulary))]), learn=hmm_lm.F.col("doc_id") < 100, **kw))
    empty = by_id(hmm_lm.hmm_scores(frame(spark, [*rows, (100, "")]), learn=hmm_lm.F.col("doc_id") < 100, **kw))[100].score
    first = {w: 10 ** (single[100 + i].score - empty) for i, w in enumerate(vocabulary)}  # one state: the end has the same chance each time
    unknown = {hmm_lm.bucket(w.encode(), 2): p for w, p in first.items() if w.startswith("n")}
    assert sum(first[w] for w in "abc") + sum(unknown.values()) + 10**empty == pytest.approx(1.0, abs=1e-6)


# op4


def test_tokenizer_agrees_with_the_library(texts):
    coder = tokenizer(P.path("word_bpe_49k.json"))
    hard = ["", "  ", "Don't we'll. A.,b x.. É.É, ΣΑΣ. İstanbul, é, a b\u0085c\x1cd <|endoftext|> 12,5. a'S, 'tis", "́a ́ ẞ. ſ, K. ﬁ, ªº 1́ ≮",
            "日本語 中文。 한국어. ǅ ǆ 12a3", "x" * 100 + " " + "é" * 30, "a\x0bb c\x0cd «É» ... --é ÀÉ", "é.é é ٣٤ ²", "naïve—test “q” 5€"]
    hard += ["end <|endoftext|> a", "<|startoftext|>A<|endoftext|><|endoftext|>", "<|endoftext|", "a<|ENDOFTEXT|>b", "x <|startoftext|>", "word " * 9000 + "<|endoftext|> word"]
    plain = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert plain.encode("end <|endoftext|> a", add_special_tokens=False).ids == [806, 49407, 320]
    rows = [*hard, *texts.values()]
    for text, ids in zip(rows, coder(rows)):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, text[:60]


def test_packing_covers_every_id_once(spark, texts):
    pieces = packing.pack(frame(spark, list(texts.items())), P.path("word_bpe_49k.json"), seq_len=512, grid=8, block_ids=32_768).collect()
    coder = tokenizer(P.path("word_bpe_49k.json"))
    want = {i: [*ids.tolist(), 2] for i, ids in zip(texts, coder(list(texts.values())))}
    own, sequences = {}, {}
    for p in pieces:
        own.setdefault(p.doc_id, []).append(p)
        sequences.setdefault(p.sequence_id, []).append(p)
        assert p.doc_tokens == len(want[p.doc_id]) and p.length * 4 == len(p.ids) > 0
    for i, ids in want.items():
        parts = sorted(own[i], key=lambda p: p.start)
        assert [p.start for p in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))]
        assert np.frombuffer(b"".join(bytes(p.ids) for p in parts), "<u4").tolist() == ids
    padding = total = 0
    for parts in sequences.values():
        parts.sort(key=lambda p: p.offset)
        n = sum(p.length for p in parts)
        assert n <= 512 and [p.offset for p in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))]
        padding, total = padding + (0 if n & (n - 1) == 0 else 512 - n), total + n
    assert padding < 0.03 * total


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(3)
    for _ in range(40):
        n, limit = 40, 8
        at = sorted({*rng.choice(np.arange(1, n), 18, replace=False).tolist(), *range(4, n, 4), n})
        cost = [int(c) for c in rng.integers(0, 9, len(at))]
        best = {0: 0}
        for j, (here, c) in enumerate(zip(at, cost)):
            best[here] = min(best[p] + (0 if (here - p) & (here - p - 1) == 0 else limit - here + p) for p in best if here - p <= limit) + c + packing.SEQUENCE
        found = packing.best_cuts(at, cost, n, limit, True)
        total = sum((0 if (b - a) & (b - a - 1) == 0 else limit - b + a) + packing.SEQUENCE for a, b in zip([0, *found], found)) + sum(cost[at.index(x)] for x in found)
        assert found[-1] == n and total == best[n]


# op6


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    scored = by_id(queries.op6_toxicity(spark, sf))
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in scored.items())
    rows = [(scored[r.doc_id].predicted, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if scored[r.doc_id].held_out]
    assert sum(p and y for p, y in rows) >= 0.8 * sum(y for _, y in rows)
    assert sum(p and not y for p, y in rows) <= 0.02 * sum(not y for _, y in rows)


def test_toxicity_tolerates_inserted_characters():
    insults = ["worthless", "disgusting", "pathetic"]
    clean = [prose(40, i) for i in range(120)]
    toxic = [prose(20, i) + " " + insults[i % 3] + " " + insults[(i + 1) % 3] + " " + prose(20, i + 1) for i in range(60)]
    model = toxicity.fit(clean + toxic, [0] * len(clean) + [1] * len(toxic))
    scorer = toxicity.Scorer(model)
    p = lambda t: model.probability(scorer.worst([t])[0])
    changed = ["wor-thless disgusxting", "w.orthless patheetic", "d i s g u s t i n g you", "pathetic."]
    assert all(p(f"{prose(10, 3)} {c} {prose(10, 4)}") > 0.5 for c in changed)
    assert all(p(prose(50, i)) < 0.5 for i in range(300, 320)) and p("") < 0.5


def test_toxicity_reads_marked_joined_and_spoiled_insults():
    insults = ["worthless", "idiot", "scumbag", "笨蛋"]
    clean = [prose(40, i) + " 今天天气很好我们去公园" for i in range(120)]
    toxic = [prose(20, i) + " " + insults[i % 4] + " " + insults[(i + 1) % 4] + " " + prose(20, i + 1) for i in range(80)]
    model = toxicity.fit(clean + toxic, [0] * len(clean) + [1] * len(toxic))
    scorer = toxicity.Scorer(model)
    p = lambda t: model.probability(scorer.worst([t])[0])
    changed = ["i.d.i.o.t", "ixdxixoxt", "s-c-u-m-b-a-g", "what-a-scumbag-you-are", "stop-being-an-idiot-now", "whatanidiotyouare", "youareworthless", "idxiot", "wo_rth_less", "SCUMBAG!!!", "今天你这笨蛋去公园"]
    assert {c: p(f"{prose(10, 3)} {c} {prose(10, 4)}") > 0.5 for c in changed} == dict.fromkeys(changed, True)
    held = [f"{prose(50, i)} so-called well-known {prose(5, i)}" for i in range(300, 400)]
    assert sum(p(t) > 0.5 for t in held) <= 2


def test_kernel_counts_shared_gapped_triples():
    names = ["idiot", "moron", "abcabc"]
    kernel = toxicity.Kernel(names)

    def triples(w):
        w, out = "\x02" + w + "\x03", Counter()
        for i in range(len(w)):
            for a, b in toxicity.PATTERNS:
                if i + b < len(w):
                    out[w[i] + w[i + a] + w[i + b]] += toxicity.DECAY ** (b + 1)
        return out

    words = ["idiot", "idiots", "id-iot", "morons", "abcabcab", "zzz"]
    found = kernel.matches(words)
    for i, w in enumerate(words):
        x = triples(w)
        for j, l in enumerate(names):
            y = triples(l)
            k = sum(v * y[t] for t, v in x.items()) / np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
            assert (found[i][j] if i in found else 0) == pytest.approx(k**toxicity.POWER if k >= toxicity.FLOOR else 0, abs=1e-4)


# op7


def test_simhash_components(spark, texts):
    rows = [*texts.items(), (10**6, ""), (10**6 + 1, None), (10**6 + 2, "one two")]
    found = by_id(simhash.simhash_near_dedup(frame(spark, rows), leaf_sample=8, block_rows=16))

    def plain(t):
        words = (t or "").encode().lower().split()
        parts = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if parts else 0

    fps = {i: plain(t) for i, t in rows}
    assert all(found[i].fp & (2**64 - 1) == f for i, f in fps.items())
    assert {i: r.component_id for i, r in found.items()} == components(fps)


def components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: top(i) for i in ids}


def test_vantage_tree_loses_no_link(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    near = [int(x) ^ (1 << int(a)) ^ (1 << int(b)) for x in base for a, b in rng.integers(0, 64, (4, 2))]
    fps = sorted({int(x) for x in base} | set(near))
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3)
    found = {r.node: r.root for r in simhash.link_fingerprints(df, 2, leaf_sample=8, block_rows=16).collect()}
    want = components(dict(zip(signed, fps)))
    got = {x: found.get(x, x) for x in signed}
    assert len(set(want.values())) == len(set(got.values())) and all(got[x] == got[want[x]] for x in signed)
    # Trees of leaves, and slices of visitors, lose none either.
    deep = {r.node: r.root for r in simhash.link_fingerprints(df, 2, sample=64, leaf_sample=8, block_rows=16, slice_rows=32).collect()}
    assert deep == found


def test_vantage_tree_grows_with_the_fingerprints(spark):
    rng = np.random.default_rng(6)
    bounds = dict(sample=512, leaf_sample=32, block_rows=256)
    leaves = {}
    for n in (2_000, 20_000):
        df = spark.createDataFrame([(int(x),) for x in rng.integers(-(1 << 63), 1 << 63, n)], "fp long").repartition(4)
        fitting = simhash.fitting_places(df, 2, **bounds)
        residents = sum(places.where("resident").count() for places, _ in fitting)
        assert residents == n and all(s.where(f"n > {bounds['block_rows']}").isEmpty() for _, s in fitting)
        leaves[n] = sum(s.where("n > 0").count() for _, s in fitting)
        groups = [simhash.dealt(p, s, 256, 1_024).groupBy("path", "block", "slice").count().agg({"count": "max"}).first()[0] for p, s in fitting]
        assert max(g or 0 for g in groups) <= 256 + 1.25 * 1_024
    assert leaves[20_000] >= 5 * leaves[2_000]


def test_leaf_that_no_tree_divides_goes_to_blocks(spark):
    # One bit each: every two are two bits apart, so no vantage point divides them.
    df = spark.createDataFrame([(1 << i,) for i in range(60)], "fp long")
    found = simhash.link_fingerprints(df, 2, sample=16, leaf_sample=4, block_rows=8, slice_rows=16).collect()
    assert len(found) == 60 and {r.root for r in found} == {1}


# op8


def test_fingerprints_and_next_documents(spark, texts):
    found = by_id(fingerprints.compare_with_next(frame(spark, list(texts.items()))))
    ids = sorted(texts)
    for i, j in zip(ids, ids[1:] + ids[:1]):
        half = len(texts[i]) // 2
        edited = texts[i][: len(texts[i]) - half] + texts[j][:half]
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(texts[i]), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if texts[i] == texts[j]:
            assert r.near_next == 1 and r.fingerprint == found[j].fingerprint
    near = np.array([(found[i].near_edited, found[i].near_next) for i in ids])
    assert (near[:, 0] > near[:, 1]).mean() > 0.9 and 0.3 < np.median(near[:, 0]) < 0.7


def test_groups_follow_the_bytes(spark, texts):
    rows = [*texts.items(), (None, "no id"), *[(10**6, prose(40, k)) for k in range(12)]]
    docs = frame(spark, rows)
    few, many = fingerprints.compare_with_next(docs).collect(), fingerprints.compare_with_next(docs, task_bytes=2_000).collect()
    assert len(few) == len(rows) and sorted(map(repr, few)) == sorted(map(repr, many))


def test_rarity_counts_all_pairs(spark):
    rows = [(1, "abracadabra"), (2, None), (3, ""), (4, "z"), (5, "\u00e9t\u00e9 abra"), (6, "abracadabra")]
    want = Counter(p for _, t in rows for p in zip((t or "").encode(), (t or "").encode()[1:]))
    counts = fingerprints.pair_counts(frame(spark, rows))
    assert {(i // 256, i % 256): n for i, n in enumerate(counts.tolist()) if n} == want
    total = sum(want.values()) + 65_536
    bits = fingerprints.rarity(counts)
    assert bits[97 * 256 + 98] == pytest.approx(math.log2(total / (want[97, 98] + 1)), abs=1e-5)
    assert bits[0] == pytest.approx(math.log2(total), abs=1e-5)


def plain_features(data, bits):
    """The selected windows of the text, window by window."""
    width, mask = fingerprints.WINDOW, 2**64 - 1
    if len(data) <= width:
        return [xxhash.xxh3_64_intdigest(data)] if data else []
    keys = []
    for i in range(len(data) - width + 1):
        w = data[i : i + width]
        info = round(16 * sum(float(bits[a * 256 + b]) for a, b in zip(w, w[1:])))
        rolled = sum((b + 1) * pow(0x5851F42D4C957F2D, k, 1 << 64) for k, b in enumerate(w)) & mask
        keys.append(info << 48 | ((rolled ^ rolled >> 29) * int(fingerprints.FACTOR) & mask) >> 16)
    short = len(data) < fingerprints.SHORT
    run, least = (fingerprints.SHORT_RUN, fingerprints.SHORT_VOTES) if short else (fingerprints.RUN, fingerprints.VOTES)
    run = min(run, len(keys))
    best = [max(keys[i : i + run]) for i in range(len(keys) - run + 1)]
    stretches = [(k, len(list(g))) for k, g in itertools.groupby(best)]
    enough = min(least, max(n for _, n in stretches))
    return list(dict.fromkeys(k for k, n in stretches if n >= enough))


def plain_filters(numbers):
    """Bloom filters as sets of bit numbers."""
    out = []
    for at, x in enumerate(numbers):
        if at % fingerprints.FULL == 0:
            out.append(set())
        mixed = (x ^ x >> 31) * int(fingerprints.FACTOR) & (2**64 - 1)
        mixed ^= mixed >> 27
        out[-1] |= {(mixed >> 11 * k) % fingerprints.BITS for k in range(fingerprints.HASHES)}
    return out


def plain_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    if a == b:
        return 1.0
    a, b = (b, a) if len(a) > len(b) else (a, b)
    total = 0
    for x in a:
        best = 0
        for y in b:
            chance = len(x) * len(y) / fingerprints.BITS
            best = max(best, (len(x & y) - chance) / max(min(len(x), len(y)) - chance, 1e-9))
        total += min(1, best) * len(x)
    return total / sum(map(len, a))


def test_features_filters_and_likeness():
    rng = np.random.default_rng(11)
    # In 64ths of a bit, so that sums are exact in any order.
    bits = (rng.integers(200, 900, 1 << 16) / 64).astype(np.float32)
    base, noise = prose(1_500, 3), "".join(map(chr, rng.integers(97, 123, 15_000)))
    cases = ["", "a", "twelve bytes", "thirteen byte", "ab" * 30, "x" * 500, prose(20, 4), prose(90, 5), base, base[:3_000] + prose(300, 6), "\u00e9\u4e2d" * 300, noise, noise[:9_000] + base]
    chains = []
    for text in cases:
        data = text.encode()
        want = plain_features(data, bits)
        assert fingerprints.features(data, bits).tolist() == want, text[:20]
        packed = fingerprints.filters(np.array(want, dtype=np.uint64))
        assert [set(np.flatnonzero(np.unpackbits(row)).tolist()) for row in packed] == plain_filters(want)
        chains.append((packed, plain_filters(want)))
    assert max(len(sets) for _, sets in chains) > 1
    for (a, x), (b, y) in itertools.product(chains, chains):
        assert fingerprints.likeness(a, b) == pytest.approx(plain_likeness(x, y), abs=1e-9)


def test_a_lone_document_follows_itself(spark):
    (r,) = fingerprints.compare_with_next(frame(spark, [(5, prose(50, 2))])).collect()
    assert r.near_next == 1


# op9


def test_encoding_agrees_with_the_library(spark, texts):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = bpe.encoding(path, P.PATTERN)
    rows = [*texts.items(), (10**6, "a" * 3000 + " " * 500 + "b  \n\n c 12's"), (10**6 + 1, "\U0001f600é" * 900)]
    for chunk, overlap in ((10**6, 1000), (300, 60), (64, 9)):
        for i, r in by_id(bpe.encode(frame(spark, rows), path, P.PATTERN, chunk, overlap)).items():
            assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(dict(rows)[i]), (i, chunk)


# op10


def plain_substring(texts, window):
    first, words = {}, {i: (t or "").encode().split() for i, t in texts.items()}
    for i in sorted(words):
        for j in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][j:j + window]), i)
    out = {}
    for i, ws in words.items():
        gone = [False] * len(ws)
        for j in range(len(ws) - window + 1):
            if first[tuple(ws[j:j + window])] < i:
                gone[j:j + window] = [True] * window
        out[i] = (len(ws), sum(gone), b" ".join(w for w, g in zip(ws, gone) if not g).decode())
    return out


@pytest.mark.parametrize("window", [7, 13, 20])
def test_substring_dedup(spark, texts, window):
    rows = dict(texts)
    passage = prose(40, 9)
    for k in range(30):
        rows[10**6 + k] = f"{prose(k, k + 11)} {passage[k:]} {prose(20, k + 50)}"
    rows[10**7] = None
    found = by_id(substring_dedup.substring_dedup(frame(spark, list(rows.items())), window))
    assert {i: (r.n_words, r.n_removed, r.kept_text) for i, r in found.items()} == plain_substring(rows, window)
    # More tasks, blocks and buckets for the same bytes give the same rows.
    assert by_id(substring_dedup.substring_dedup(frame(spark, list(rows.items())), window, task_bytes=20_000)) == found


def test_difference_cover_meets_every_distance():
    met = {(a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER}
    assert met == set(range(substring_dedup.PERIOD))
