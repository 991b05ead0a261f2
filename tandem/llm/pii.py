"""Personal data by pattern, and the terms beside it that the corpus shows to give it away. Columns and SQL functions only."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.session import stored

# Each pattern finds the leftmost greedy matches of its plain form that can be valid. The possessive quantifiers and the looks at the
# character before only keep the search linear: a match can start within a run of its first class only where the match
# before has ended.
KINDS = ("email", "ip", "card", "phone")
TERM = "term"
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# a text without this cannot hold a match, and is not searched
HINTS = {"email": "@", "phone": "+"}
SIGNS = {"ip": r"[0-9]\.[0-9]", "card": "[0-9](?:[ -]?[0-9]){11}"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_WORD = r"\p{L}++"

MIN_TERM_CHARS = 4
# Matches whose places are summed up together, and code points of a text that are cut together.
STRETCH = 512
# Texts without the entity that every term is taken to have been seen in besides its own.
SMOOTHING = 1.0
DISCLOSURE = 0.8


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and wherever the body names it."""
    return F.transform(F.array(value), body)[0]


def _located(text: Column, pattern: str) -> Column:
    """The matches of a pattern with their places in code points: lengths between and of matches, summed up.

    Sums run within stretches of ``STRETCH`` matches and over the stretches, so the cost grows with the length of a text.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<value:string,start:int,end:int>>")

    def length(m: Column) -> Column:
        return F.length(m["before"]) + F.length(m["value"])

    def step(acc: Column, m: Column) -> Column:
        start, end = (acc["at"] + F.length(m["before"])).cast("int"), (acc["at"] + length(m)).cast("int")
        span = F.struct(m["value"].alias("value"), start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    def begin_next(acc: Column, size: Column) -> Column:
        return F.struct((acc["at"] + size).cast("int").alias("at"), F.concat(acc["begins"], F.array(acc["at"])).alias("begins"))

    def stretches(pieces: Column) -> Column:
        last = F.greatest(F.lit(0), F.floor((F.size(pieces) - 1) / STRETCH).cast("int"))
        return F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(pieces, c * STRETCH + 1, STRETCH))

    def places(parts: Column) -> Column:
        sizes = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda acc, m: (acc + length(m)).cast("int")))
        begins = F.aggregate(sizes, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("begins")), begin_next)["begins"]
        each = F.zip_with(parts, begins, lambda part, at: F.aggregate(part, F.struct(at.alias("at"), empty.alias("spans")), step)["spans"])
        return F.flatten(each)

    zipped = _bound(found, lambda f: F.arrays_zip(f.alias("value"), F.slice(between, 1, F.size(f)).alias("before")))
    return _bound(_bound(zipped, stretches), places)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The check sum of card numbers: from the right, every second digit counts twice, less nine if above nine."""
    places = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(places, F.lit(0), lambda acc, d: acc + F.coalesce(d, F.lit(0))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        digits = _digits(value)
        return F.length(digits).between(12, 19) & F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _is_valid(kind: str, match: Column) -> Column:
    return _valid(kind, match["value"])


def _as_span(rank: int, kind: str, match: Column) -> Column:
    return F.struct(
        match["start"].alias("start"), F.lit(rank).alias("rank"), match["end"].alias("end"), F.lit(kind).alias("kind"), match["value"].alias("value")
    )


def _possible(kind: str, text: Column) -> Column:
    """A cheap condition that every text with a match meets."""
    return text.contains(HINTS[kind]) if kind in HINTS else text.rlike(SIGNS[kind])


def base_spans(text: Column) -> Column:
    """All valid matches of a text as ``array<struct<start, rank, end, kind, value>>``, by start and then kind."""
    parts = []
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>")
    for rank, kind in enumerate(KINDS):
        found = F.filter(_located(text, PATTERNS[kind]), partial(_is_valid, kind))
        parts.append(F.when(_possible(kind, text), F.transform(found, partial(_as_span, rank, kind))).otherwise(none))
    return F.array_sort(F.concat(*parts))


def _entities(spans: Column) -> Column:
    """What the values of base spans name, as hashes: the value itself (digits only, where that is all that tells cards and
    phones apart), and for an e-mail its user and its domain too, which further texts may share."""
    value = lambda s: F.when(s["kind"].isin("card", "phone"), _digits(s["value"])).otherwise(F.lower(s["value"]))
    part = lambda s, n: F.when(s["kind"] == "email", F.xxhash64(F.lit(f"part {n}"), F.split(F.lower(s["value"]), "@")[n]))
    names = F.transform(spans, lambda s: F.array(F.xxhash64(s["kind"], value(s)), part(s, 0), part(s, 1)))
    return F.array_distinct(F.array_compact(F.flatten(names)))


def _blanked(text: Column, spans: Column) -> Column:
    """The text with every character of a span replaced by one that is no letter, so that places stay as they are."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.concat(
                acc["parts"],
                F.array(
                    F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))),
                    F.repeat(F.lit("\uffff"), F.greatest(s["end"] - F.greatest(s["start"], acc["at"]), F.lit(0))),
                ),
            ).alias("parts"),
        ),
        lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text))),
    )


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)))


def _term_counts(rows: DataFrame) -> DataFrame:
    """``(term, n_t)``: how many different texts hold each term. Copies go first, so that terms are counted before they move."""
    terms = F.array_distinct(F.transform(_words(F.col("text")), lambda w: F.lower(w)))
    words = rows.dropDuplicates(["key"]).select(F.explode(terms).alias("term"))
    return words.filter(F.length("term") >= MIN_TERM_CHARS).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))


def revealing_terms(rows: DataFrame, held: DataFrame, disclosure: float) -> DataFrame:
    """``(key, forms)``: for each text of ``held`` the words, as written there, that give away an entity it holds.

    A term is flagged for an entity if its pointwise mutual information with it is at least ``disclosure`` of the
    entity's information. With n texts, n_e of them holding the entity, n_t the term and n_te both, the disclosed share
    is log(n p / n_e) / log(n / n_e), where p = (n_te + s n_e / n) / (n_t + s) estimates how often a text with the
    term holds the entity and s is ``SMOOTHING``. No pair is left out for being rare or far apart. Counts are of different
    texts over the whole corpus, so that copies of one text are one observation.
    """
    n = float(max(1, rows.agg(F.count_distinct("key").alias("n")).first()["n"]))  # one number

    def reaches(n_te: Column) -> Column:
        inform = F.log(F.lit(n) / F.col("n_e"))
        likely = (n_te + SMOOTHING * F.col("n_e") / n) / (F.col("n_t") + SMOOTHING)
        return (inform > 0) & (F.log(F.lit(n) * likely / F.col("n_e")) >= disclosure * inform)

    each = held.select("key", F.explode(_entities(F.col("spans"))).alias("entity"))
    counted = each.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    # most entities are in one text only
    entities = each.join(counted.filter("n_e > 1"), "entity", "left").select("key", "entity", F.coalesce("n_e", F.lit(1)).alias("n_e"))
    forms = held.select("key", F.explode(_words(F.col("text"))).alias("form")).select("key", F.lower("form").alias("term"), "form")
    forms = forms.filter(F.length("term") >= MIN_TERM_CHARS).groupBy("key", "term").agg(F.collect_list("form").alias("forms"))
    terms = forms.join(_term_counts(rows), "term")
    # a pair that would not be flagged even if all texts with the one held the other need not be counted
    pairs = terms.join(entities, "key").filter(reaches(F.least("n_t", "n_e")))
    pairs = stored(pairs.select("key", "entity", "term", "forms", "n_t", "n_e"), "pairs")
    flagged = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_te"), F.first("n_t").alias("n_t"), F.first("n_e").alias("n_e"))
    flagged = flagged.filter(reaches(F.col("n_te"))).select("entity", "term")
    found = pairs.join(flagged, ["entity", "term"]).groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("forms"))).alias("forms"))
    return found.withColumn("forms", F.array_sort("forms"))


def find(docs: DataFrame, id_col: str, text_col: str, disclosure: float = DISCLOSURE) -> DataFrame:
    """Per row of ``docs`` ``(doc, key, spans)``: all spans, the base ones and those of revealing terms."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("text", F.length("text")))
    # the digest of the text tells rows of one id apart
    found = rows.withColumn("spans", base_spans(F.col("text"))).withColumn("text", F.when(F.size("spans") > 0, F.col("text")).otherwise(""))
    found = stored(found, "base-spans")
    holding = found.filter(F.size("spans") > 0)
    held = holding.dropDuplicates(["key"]).select("key", "text", "spans")
    named = revealing_terms(rows, held, disclosure).join(held, "key")
    # every place of the flagged words in the text that does not overlap a base span: all words are located once, and
    # those that are flagged for their text are found by a join, however many there are
    words = named.select("key", F.explode(_located(_blanked(F.col("text"), F.col("spans")), _WORD)).alias("m")).select("key", F.col("m.value").alias("form"), "m")
    flagged = named.select("key", F.explode("forms").alias("form"))
    m = F.col("m")
    term = F.struct(m["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), m["end"].alias("end"), F.lit(TERM).alias("kind"), F.lower(m["value"]).alias("value"))
    more = words.join(flagged, ["key", "form"]).groupBy("key").agg(F.collect_list(term).alias("extra"))
    out = found.drop("text").join(more, "key", "left")
    spans = F.array_sort(F.concat(F.col("spans"), F.coalesce("extra", F.array().cast(found.schema["spans"].dataType))))
    return out.select("doc", "key", F.col("spans").alias("base"), spans.alias("spans"))


def _of_kind(kind: str, span: Column) -> Column:
    return span["kind"] == kind


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE) -> DataFrame:
    """One row per row of ``docs``: the counts of each kind, the digest of the base spans, and all spans as text.

    Columns ``doc_id``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_sha256``, ``spans``. A null text is
    empty and has no spans; a row without an id is reported under a null id; equal rows are reported alike; an empty
    table gives no rows; other columns are ignored.
    """
    found = find(docs, id_col, text_col, disclosure)
    counts = [F.size(F.filter("base", partial(_of_kind, kind))).cast("bigint").alias(f"n_{kind}") for kind in KINDS]
    return found.select(F.col("doc").alias("doc_id"), *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def _merged(spans: Column) -> Column:
    """Base spans with those that overlap an earlier one taken into it, under the name of the first."""
    empty = F.array().cast("array<struct<start:int,end:int,kind:string>>")

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        apart = F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))
        return F.when((F.size(acc) > 0) & (s["start"] < F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0))), joined).otherwise(apart)

    return F.aggregate(spans, empty, lambda acc, s: F.when(F.size(acc) == 0, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))).otherwise(step(acc, s)))


def _redacted(text: Column, spans: Column) -> Column:
    """The text with each span generalised to the name of its kind, overlapping spans as one, and terms removed.

    Terms overlap nothing, so what is kept lies between neighbouring spans. It is cut from stretches of the text rather
    than from its beginning.
    """
    base = _merged(F.filter(spans, lambda s: s["kind"] != TERM))
    terms = F.transform(F.filter(spans, lambda s: s["kind"] == TERM), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    label = lambda s: F.when(s["kind"] == TERM, F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))

    def cut(chunks: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / STRETCH).cast("int")
        held = F.array_join(F.slice(chunks, first + 1, F.floor(end / STRETCH).cast("int") - first + 1), "")
        return F.substring(held, start - first * STRETCH + 1, F.greatest(end - start, F.lit(0)))

    def pieces(chunks: Column, every: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.transform(every, lambda s: s["end"]))
        kept = F.zip_with(every, F.slice(before, 1, F.size(every)), lambda s, at: F.concat(cut(chunks, at, s["start"]), label(s)))
        return F.concat(F.array_join(kept, ""), cut(chunks, F.element_at(before, -1), F.length(text)))

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))
    walked = _bound(chunks, lambda c: _bound(F.array_sort(F.concat(base, terms)), lambda every: pieces(c, every)))
    return F.when(F.size(spans) > 0, walked).otherwise(text)


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE) -> DataFrame:
    """``docs`` with personal data generalised to its kind, as in ``[EMAIL]``, and revealing terms removed.

    A null text stays null; rows and other columns are kept as they are.
    """
    found = find(docs, id_col, text_col, disclosure).filter(F.size("spans") > 0)
    found = found.select(F.col("doc").alias("__doc"), F.col("key").alias("__key"), F.col("spans").alias("__spans")).dropDuplicates(["__doc", "__key"])
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    same = docs[id_col].cast("bigint").eqNullSafe(F.col("__doc")) & (F.xxhash64(text, F.length(text)) == F.col("__key"))
    wide = docs.join(found, same, "left")
    columns = [F.when(F.col("__spans").isNull(), docs[c]).otherwise(_redacted(docs[c], F.col("__spans"))).alias(c) if c == text_col else docs[c] for c in docs.columns]
    return wide.select(*columns)
