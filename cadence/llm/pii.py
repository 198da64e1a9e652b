"""PII removal by patterns and information-theoretic sanitisation, in DataFrame functions only.

Base spans are matches of four patterns with a check each. Their values are
the protected entities. A term of a document reveals an entity of it by

    disclosure = PMI(term, entity) / IC(entity)
               = log(N n(t,e) / (n(t) n(e))) / log(N / n(e)),

with document counts over the whole corpus: 1 says that the term occurs with
the entity only. A pair seen in n(t,e) documents keeps n(t,e) / (n(t,e) +
``SHRINK``) of it, so few documents weigh less and none are left out. Terms
over a threshold are generalised, those over a higher one removed, wherever
they stand in a document that holds the entity. Entities are equal whatever
their punctuation; those of the same documents are counted as one class.

Positions are code points, ends exclusive. Matches are located by the lengths
of the matches and of what the same pattern splits off, so no Python runs.

Defined cases: a null text counts as empty; a null doc_id is carried; rows
that repeat a doc_id and its text get equal spans and count as one document;
very long texts are read whole; an empty table gives an empty result;
``sanitise`` carries other columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import held, materialise, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Possessive, and starting where a run starts or a match ended, so that long runs are read once.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Texts without these characters are not searched.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
TERM = r"\p{L}[\p{L}\p{N}'-]{2,}+"
#: Documents by which the disclosure of a pair is shrunk; disclosure from which a term is generalised, and removed.
SHRINK, GENERALISE, REMOVE = 0.15, 0.8, 0.95
BLOCK = 128
SPAN = "struct<start:long,k:int,end:long,kind:string,value:string>"


def _matches(text: str, pattern: str, need: str | None = None) -> Column:
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    empty = F.lit([]).cast("array<string>")
    return F.when(F.col(text).contains(need), found).otherwise(empty) if need else found


def _located(df: DataFrame, text: str, pattern: str, out: str, need: str | None = None) -> DataFrame:
    """Adds ``out``: array of (start, end, value) of the matches in the column ``text``.

    Start of match i: lengths of the first i matches and of the i + 1 gaps up
    to it, summed by blocks so that very many matches stay cheap.
    """
    m, g, u, b = (f"__{out}_{x}" for x in "mgub")
    df = df.withColumn(m, _matches(text, pattern, need))
    df = df.withColumn(g, F.when(F.size(m) > 0, F.transform(F.split(F.col(text), pattern, -1), lambda x: F.length(x).cast("long"))))
    df = df.withColumn(u, F.expr(f"transform({m}, (x, i) -> length(x) + {g}[i])"))
    df = df.withColumn(b, F.expr(f"transform(sequence(0, size({m}) div {BLOCK}), k -> aggregate(slice({u}, k * {BLOCK} + 1, {BLOCK}), 0L, (s, x) -> s + x))"))
    start = (
        f"aggregate(slice({b}, 1, i div {BLOCK}), 0L, (s, y) -> s + y)"
        f" + aggregate(slice({u}, i div {BLOCK} * {BLOCK} + 1, i % {BLOCK}), 0L, (s, y) -> s + y) + {g}[i]"
    )
    df = df.withColumn(out, F.expr(f"transform({m}, (x, i) -> named_struct('start', {start}, 'value', x))"))
    df = df.withColumn(out, F.expr(f"transform({out}, x -> named_struct('start', x.start, 'end', x.start + length(x.value), 'value', x.value))"))
    return df.drop(m, g, u, b)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass, every second one from the right doubled."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda x: F.regexp_replace(x, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda x: (F.length(part(x)) <= 3) & (F.coalesce(part(x).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        digits = F.regexp_replace(value, r"[\x20-]", "")
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def base_spans(df: DataFrame, text: str = "__text", out: str = "__base") -> DataFrame:
    """Adds ``out``: the base spans of the column ``text``, by start, then kind as in ``KINDS``."""
    for kind in KINDS:
        df = _located(df, text, PATTERNS[kind], f"__{kind}", NEEDS[kind])
    parts = [F.transform(_kept(kind), _spanned(k, kind)) for k, kind in enumerate(KINDS)]
    return df.withColumn(out, F.array_sort(F.concat(*parts))).drop(*(f"__{kind}" for kind in KINDS))


def _kept(kind: str) -> Column:
    def check(x: Column) -> Column:
        return _valid(kind, x["value"])

    return F.filter(F.col(f"__{kind}"), check)


def _spanned(k: int, kind: str):
    def made(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), F.lit(k).alias("k"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))

    return made


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds the text, and a key of the document that repeated rows share."""
    df = docs.withColumn("__text", text_or_empty())
    return df.withColumn("__key", F.xxhash64("doc_id", "__text")).withColumn("__id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))


def _entity(s: Column) -> Column:
    """Name of the entity of a base span: digits alone of cards and phones, numbers of an address without leading zeros."""
    kind, value = s["kind"], s["value"]
    plain = F.when(kind.isin("card", "phone"), _digits(value)).when(kind == "ip", F.regexp_replace(value, r"(?<![0-9])0+(?=[0-9])", "")).otherwise(F.lower(value))
    return F.concat_ws(":", kind, plain)


def _terms(text: str) -> Column:
    """The distinct terms of the column ``text``."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.col(text), F.lit(TERM), F.lit(0)), lambda x: F.lower(x)))


def _found(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, __key, __id, __base, __text), one for each row of ``docs``; only texts with base spans are kept."""
    df = base_spans(_keyed(docs.select("doc_id", "text")))
    return df.select("doc_id", "__key", "__id", "__base", F.when(F.size("__base") > 0, F.col("__text")).alias("__text"))


def _classes(holding: DataFrame) -> DataFrame:
    """Rows (__key, __id, a, b, n_entity): the classes of entities of a document.

    Entities of the same documents have the same counts with every term, so a
    class, named by hashes of its documents, stands for all of them.
    """
    held = holding.select("__key", "__id", F.explode(F.array_distinct(F.transform("__base", _entity))).alias("entity"))
    named = held.groupBy("entity").agg(
        F.count("*").alias("n_entity"), F.bit_xor(F.xxhash64("__key", "__id")).alias("a"), F.bit_xor(F.xxhash64("__id", "__key")).alias("b")
    )
    return held.join(named, "entity").select("__key", "__id", "a", "b", "n_entity").distinct()


def _term_counts(docs: DataFrame, repeats: DataFrame) -> DataFrame:
    """Rows (term, n_term): in how many documents a term stands; rows that repeat one (``repeats``: how often) count once."""
    spoken = docs.select(F.explode(_terms("text")).alias("term"), F.lit(1).alias("n"))
    if not repeats.isEmpty():
        again = _keyed(docs.select("doc_id", "text")).join(repeats, ["__key", "__id"]).dropDuplicates(["__key", "__id"])
        spoken = spoken.unionByName(again.select(F.explode(_terms("__text")).alias("term"), (1 - F.col("m")).alias("n")))
    return spoken.groupBy("term").agg(F.sum("n").alias("n_term"))


def _disclosing(docs: DataFrame, found: DataFrame, holding: DataFrame, shrink: float, generalise: float) -> DataFrame:
    """Rows (__key, __id, term, disclosure): terms of a document that reveal an entity of it, over the threshold."""
    times = materialise(found.groupBy("__key", "__id").agg(F.count("*").alias("m")), "pii-documents")
    rows, repeats = times.count(), times.where("m > 1")
    n = F.lit(float(rows))

    def disclosure(both: str) -> Column:
        both, e, t = (F.col(c).cast("double") for c in (both, "n_entity", "n_term"))
        share = F.when(e < n, F.log(n * both / (F.greatest(t, both) * e)) / F.log(n / e)).otherwise(0.0)
        return share * both / (both + shrink)

    classes = materialise(_classes(holding), "pii-classes")
    most = max(1, min(classes.agg(F.max("n_entity")).first()[0] or 0, rows - 1))
    terms = _term_counts(docs, repeats)
    # The disclosure of a pair that stands together wherever it can bounds that of the pair, and grows with n_entity.
    # So words that reveal not even the largest entity are dropped before the join, and others by class after it; no pair is lost.
    terms = terms.withColumn("n_entity", F.lit(most)).withColumn("n_most", F.least("n_term", "n_entity"))
    terms = terms.where(disclosure("n_most") >= generalise).select("term", "n_term")
    spoken = holding.select("__key", "__id", F.explode(_terms("__text")).alias("term"))
    pairs = spoken.join(terms, "term").join(classes, ["__key", "__id"]).withColumn("n_most", F.least("n_term", "n_entity"))
    pairs = materialise(pairs.where(disclosure("n_most") >= generalise).drop("n_most"), "pii-pairs")
    of = ["a", "b", "n_entity", "term"]
    counted = pairs.groupBy(*of, "n_term").agg(F.count("*").alias("n_both")).select(*of, disclosure("n_both").alias("disclosure"))
    revealing = counted.where(F.col("disclosure") >= generalise)
    return pairs.join(revealing, of).groupBy("__key", "__id", "term").agg(F.max("disclosure").alias("disclosure"))


def _standing(holding: DataFrame) -> DataFrame:
    """Rows (__key, __id, term, start, end) of all terms of the texts; sums run over rows, for texts have many terms."""
    gaps = F.transform(F.split(F.col("__text"), TERM, -1), lambda x: F.length(x).cast("long"))
    words = F.arrays_zip(F.regexp_extract_all(F.col("__text"), F.lit(TERM), F.lit(0)).alias("value"), gaps.alias("gap"))
    rows = holding.select("__key", "__id", F.posexplode(words).alias("at", "w")).select("__key", "__id", "at", F.col("w")["value"].alias("value"), F.col("w")["gap"].alias("gap"))
    rows = rows.where(F.col("value").isNotNull()).withColumn("n", F.length("value").cast("long"))
    end = F.sum(F.col("gap") + F.col("n")).over(Window.partitionBy("__key", "__id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("end", end).select("__key", "__id", F.lower("value").alias("term"), (F.col("end") - F.col("n")).alias("start"), "end")


def _term_spans(docs: DataFrame, found: DataFrame, shrink: float, generalise: float, remove: float) -> DataFrame:
    """Rows (__key, __id, __terms): spans of the revealing terms of a document, wherever they stand in it."""
    holding = found.where(F.size("__base") > 0).dropDuplicates(["__key", "__id"])
    revealing = _disclosing(docs, found, holding, shrink, generalise)
    span = _standing(holding).join(revealing, ["__key", "__id", "term"])
    kind = F.when(F.col("disclosure") >= remove, F.lit("removed")).otherwise(F.lit("general"))
    made = F.struct(F.col("start"), F.lit(len(KINDS)).alias("k"), F.col("end"), kind.alias("kind"), F.col("term").alias("value"))
    return span.groupBy("__key", "__id").agg(F.collect_list(made).alias("__terms"))


def _all_spans(base: Column, terms: Column) -> Column:
    """Base spans and the term spans that touch none of them, in order."""
    plain = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    apart = F.filter(F.coalesce(terms, F.lit([]).cast(f"array<{SPAN}>")), lambda t: ~F.exists(plain, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    return F.array_sort(F.concat(plain, apart))


def pii_spans(docs: DataFrame, shrink: float = SHRINK, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """Rows (doc_id, spans), one for each row of ``docs``: (start, k, end, kind, value), kinds ``KINDS``, ``removed`` and ``general``."""
    found = materialise(_found(docs), "pii-base")
    terms = _term_spans(docs, found, shrink, generalise, remove)
    return found.join(terms, ["__key", "__id"], "left").select("doc_id", _all_spans(F.col("__base"), F.col("__terms")).alias("spans"))


def sanitise(docs: DataFrame, shrink: float = SHRINK, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """``docs`` with the spans of ``text`` replaced: entities and general terms by a label, revealing ones by nothing."""
    found = materialise(_found(docs), "pii-base")
    terms = _term_spans(docs, found, shrink, generalise, remove)
    spans = found.where(F.size("__base") > 0).join(terms, ["__key", "__id"], "left").dropDuplicates(["__key", "__id"])
    spans = spans.select("__key", "__id", _all_spans(F.col("__base"), F.col("__terms")).alias("__spans"))
    df = _keyed(held(docs)).join(spans, ["__key", "__id"], "left")
    # Where the text before a span begins: after the farthest end so far, by blocks as in ``_located``.
    df = df.withColumn("__far", F.expr(f"transform(sequence(0, size(__spans) div {BLOCK}), k -> array_max(transform(slice(__spans, k * {BLOCK} + 1, {BLOCK}), x -> x.end)))"))
    far = f"array_max(slice(__far, 1, i div {BLOCK})), array_max(transform(slice(__spans, i div {BLOCK} * {BLOCK} + 1, i % {BLOCK}), x -> x.end))"
    df = df.withColumn("__ends", F.expr(f"transform(__spans, (s, i) -> if(i = 0, 0L, greatest({far})))"))
    label = "case s.kind when 'removed' then '' when 'general' then '[TERM]' else concat('[', upper(s.kind), ']') end"
    pieces = (
        f"transform(__spans, (s, i) -> concat(substring(__text, cast(__ends[i] + 1 as int), cast(greatest(0L, s.start - __ends[i]) as int)), if(s.end > __ends[i], {label}, '')))"
    )
    tail = "substring(__text, cast(array_max(transform(__spans, s -> s.end)) + 1 as int))"
    df = df.withColumn("__clean", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(F.concat(F.array_join(F.expr(pieces), ""), F.expr(tail))))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("__clean").alias(c))
        elif c == "n_chars":
            columns.append(F.when(F.col("__spans").isNull(), F.col("row").getField(c)).otherwise(F.length("__clean")).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col("row").getField(c).alias(c))
    return df.select(*columns)
