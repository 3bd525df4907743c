"""Personal data: patterns, and information-theoretic sanitisation of what points to it.

Everything here is DataFrame expressions: no Python runs on the executors.

Base spans (email, ip, card, phone) are regular expression matches, leftmost and without
overlap within a kind, that pass a check (parts of an address, Luhn sum, number of
digits). Patterns are written so that a failed start is not tried again inside the same
run of characters, and repeat without recursion, so whole long texts cost linear time.

Sanitisation: each base match is a protected entity e, whatever its spelling. Over the whole corpus it is
counted how often a term t stands within ``REACH`` characters of e, n(t, e), how often t
and e occur at all, n(t) and n(e), and the number of words N. The information that t gives
about e is their pointwise mutual information, and relative to what there is to know
about e it is

    disclosure(t, e) = log2(n(t, e) N / (n(t) n(e))) / log2(N / n(e))

which is 1 if t never occurs without e. Pairs need ``MIN_CONTEXTS`` different
surroundings, so that copies of one text prove nothing. Numbers are terms like any other
unless they belong to a base span beside e. Terms above ``REMOVE`` are removed
and those above ``GENERALISE`` are replaced by the class of their characters, wherever
they occur.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone", "generalise", "remove")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "phone": "+"}         # a character without which there is no match
IP_PART = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
WORD = r"[\p{L}\p{M}\p{N}]"
REACH = 80                      # characters on each side of an entity that are its surroundings
MIN_CONTEXTS = 3
GENERALISE, REMOVE = 0.90, 0.95
SPANS = "array<struct<s:int,k:int,e:int,v:string>>"
BLOCK = 256


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), use)[0]


def _matches(text: Column, pattern: Column, kind: int) -> Column:
    """Array of (s, k, e, v): places and text of all matches in code points. What stands
    between matches comes from split(), so places are running sums of lengths; these are
    taken in blocks, so that thousands of matches in one text stay cheap."""
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)),
                        lambda gap, v: F.struct(F.length(gap).alias("gap"), F.length(v).alias("n"), v.alias("v")))
    pieces = F.filter(pieces, lambda x: x["n"].isNotNull())

    def one(at, x):
        return F.struct((at + x["gap"]).alias("s"), F.lit(kind).alias("k"), (at + x["gap"] + x["n"]).alias("e"), x["v"].alias("v"))

    def block(part: Column) -> Column:      # places counted from the block's begin
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("found"))
        return F.aggregate(part, zero, lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["n"]).alias("at"), F.concat(acc["found"], F.array(one(acc["at"], x))).alias("found")))

    def shifted(acc: Column, b: Column) -> Column:
        moved = F.transform(b["found"], lambda x: F.struct((x["s"] + acc["at"]).alias("s"), x["k"].alias("k"),
                                                           (x["e"] + acc["at"]).alias("e"), x["v"].alias("v")))
        return F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["all"], F.array(moved)).alias("all"))

    def place(p: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(p) / BLOCK).cast("int") - 1),
                             lambda b: block(F.slice(p, b * BLOCK + 1, BLOCK)))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("all"))
        return F.when(F.size(p) > 0, F.flatten(F.aggregate(blocks, zero, shifted)["all"])).otherwise(F.array().cast(SPANS))

    return _let(pieces, place)


def _luhn(digits: Column) -> Column:
    def add(total, i):
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return v.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$")
    digits = F.regexp_replace(v, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _check(kind: str) -> Callable[[Column], Column]:
    return lambda x: _valid(kind, x["v"])


def base_spans(text: Column) -> Column:
    """Array of (s, k, e, v) by start, then kind; null text: empty."""
    found = []
    for k, kind in enumerate(("email", "ip", "card", "phone")):
        spans = F.filter(_matches(text, F.lit(PATTERNS[kind]), k), _check(kind))
        needs = F.instr(text, NEEDS[kind]) > 0 if kind in NEEDS else text.isNotNull()
        found.append(F.when(needs, spans).otherwise(F.array().cast(SPANS)))
    return F.array_sort(F.concat(*found))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"{WORD}+"), F.lit(0))


def _entity(k: Column, v: Column) -> Column:
    """Whom a base span names, however it is written: kind, and address in small letters,
    ip without leading zeros, digits of card or phone."""
    plain = F.when(k == KINDS.index("email"), F.lower(v)) \
             .when(k == KINDS.index("ip"), F.regexp_replace(v, "(?<![0-9])0+(?=[0-9])", "")) \
             .otherwise(F.regexp_replace(v, "[^0-9]", ""))
    return F.concat_ws(":", k.cast("string"), plain)


def _blanked(text: Column, spans: Column) -> Column:
    """The text with spaces for its base spans, kind by kind (those of one kind never overlap)."""
    def kind(k: int) -> Callable[[Column], Column]:
        def blank(t: Column) -> Column:
            def parts(own: Column) -> Column:
                begin = F.concat(F.array(F.lit(0)), F.transform(own, lambda x: x["e"]))
                pieces = F.zip_with(begin, own, lambda b, x: F.when(x.isNull(), F.substring(t, b + 1, F.length(t)))
                                    .otherwise(F.concat(F.substring(t, b + 1, x["s"] - b), F.repeat(F.lit(" "), x["e"] - x["s"]))))
                return F.when(F.size(own) > 0, F.array_join(pieces, "")).otherwise(t)
            return _let(F.filter(spans, lambda x: x["k"] == k), parts)
        return blank

    for k in range(4):
        text = _let(text, kind(k))
    return text


def disclosing_terms(docs: DataFrame, min_contexts: int = MIN_CONTEXTS, generalise: float = GENERALISE,
                     remove: float = REMOVE) -> DataFrame:
    """(doc_id, term, k) of every document with a term that discloses an entity; k is the
    place in KINDS of what to do. Counts are over all rows; a row with a null doc_id
    counts but is not named. Tables that may be small are stored, so that Spark broadcasts
    them only if they are."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))

    def before(of: str) -> Column:
        return F.substring(F.col(of), F.greatest(F.col("x.s") - REACH, F.lit(0)) + 1, F.least(F.col("x.s"), F.lit(REACH)))

    def after(of: str) -> Column:
        return F.substring(F.col(of), F.col("x.e") + 1, F.lit(REACH))

    def around(left: str, right: str) -> Column:        # words cut by the edge of the surroundings are dropped
        return F.concat_ws(" ", F.when(F.length(left) == REACH, F.regexp_replace(left, f"^{WORD}*", "")).otherwise(F.col(left)),
                           F.when(F.length(right) == REACH, F.regexp_replace(right, f"{WORD}*$", "")).otherwise(F.col(right)))

    spans = rows.select("text", base_spans(F.col("text")).alias("base")).where(F.size("base") > 0) \
                .select("text", _blanked(F.col("text"), F.col("base")).alias("blanked"), F.explode("base").alias("x")) \
                .select(_entity(F.col("x.k"), F.col("x.v")).alias("entity"), before("text").alias("left"), after("text").alias("right"),
                        before("blanked").alias("bare_left"), after("blanked").alias("bare_right"))
    # a number inside a base span is a part of that span, and no term
    numbers = F.regexp_extract_all(around("bare_left", "bare_right"), F.lit(f"(?<!{WORD})[0-9]+(?!{WORD})"), F.lit(0))
    near = F.array_distinct(F.concat(F.filter(_words(around("left", "right")), lambda w: w.rlike("[^0-9]")), numbers))
    spans = spans.select("entity", F.xxhash64("left", "right").alias("context"), near.alias("terms"))
    pairs = spans.select("entity", "context", F.explode("terms").alias("term")) \
                 .groupBy("entity", "term", "context").agg(F.count(F.lit(1)).alias("n")) \
                 .groupBy("entity", "term").agg(F.sum("n").alias("n_pair"), F.count(F.lit(1)).alias("contexts")) \
                 .where(F.col("contexts") >= min_contexts)
    pairs = common.store(pairs.join(spans.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")), "entity"))
    # how often the candidates occur; then, for the few that disclose something, where
    terms = common.store(pairs.select("term").distinct())
    words = rows.select("doc_id", F.explode(_words(F.col("text"))).alias("term"))
    # counted before they are joined: a frequent word is a row a partition then, and no hot key
    counts = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_term")).join(terms, "term")
    total = rows.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(f"{WORD}+"))), F.lit(0)).alias("n")).first()["n"]
    n = F.lit(float(max(total, 1)))
    told = F.log2(F.col("n_pair") * n / (F.col("n_term") * F.col("n_entity"))) / F.log2(n / F.col("n_entity"))
    acts = pairs.join(counts, "term").select("term", told.alias("told")).groupBy("term").agg(F.max("told").alias("told")) \
                .where(F.col("told") >= generalise) \
                .select("term", F.when(F.col("told") >= remove, KINDS.index("remove")).otherwise(KINDS.index("generalise")).alias("k"))
    return words.where("doc_id IS NOT NULL").join(common.store(acts), "term").select("doc_id", "term", "k").distinct()


def with_spans(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with ``__pii_base`` and ``__pii_spans``: base spans, and all spans of a row."""
    found = common.store(disclosing_terms(docs, **options).groupBy(F.col("doc_id").alias("__pii_doc"))
                               .agg(F.sort_array(F.collect_list(F.struct("term", "k"))).alias("__pii_terms")))
    text = F.coalesce(F.col("text"), F.lit(""))

    def occurrences(x: Column) -> Column:
        whole = F.concat(F.lit(f"(?iu)(?<!{WORD})"), x["term"], F.lit(f"(?!{WORD})"))
        return F.transform(_matches(text, whole, 0), lambda m: F.struct(m["s"].alias("s"), x["k"].alias("k"), m["e"].alias("e"), m["v"].alias("v")))

    rows = docs.join(found, docs["doc_id"] == found["__pii_doc"], "left")
    rows = rows.withColumn("__pii_base", base_spans(text))
    terms = F.when(F.col("__pii_terms").isNotNull(), F.flatten(F.transform("__pii_terms", occurrences))).otherwise(F.array().cast(SPANS))
    return rows.withColumn("__pii_spans", F.array_sort(F.concat("__pii_base", terms))).drop("__pii_doc", "__pii_terms")


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms) of every row.
    Null text: empty. Repeated rows are found alike; rows with a null doc_id have their base
    spans only. Other columns are not read."""
    rows = with_spans(docs.select("doc_id", "text"), **options).select("doc_id", "__pii_base", "__pii_spans")
    count = lambda k: F.size(F.filter("__pii_base", lambda x: x["k"] == k)).cast("long")
    return rows.select("doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)],
                       F.sha2(_joined(F.col("__pii_base")), 256).alias("base_sha256"), _joined(F.col("__pii_spans")).alias("spans"),
                       (F.size("__pii_spans") - F.size("__pii_base")).cast("long").alias("n_terms"))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with personal data replaced by the name of its kind, disclosing terms
    generalised ([WORD] or [NUMBER]) or removed. Overlapping spans are replaced together,
    by what stands for the first. All columns are kept; null texts stay null."""
    stands_for = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS[:4]])

    def merge(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        covered = F.struct(last["s"].alias("s"), last["k"].alias("k"), F.greatest(last["e"], x["e"]).alias("e"), last["v"].alias("v"))
        return F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["e"] > x["s"]),
                      F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(covered))).otherwise(F.concat(acc, F.array(x)))

    def replacement(x: Column) -> Column:
        return F.when(x["k"] < 4, F.get(stands_for, x["k"])) \
                .when(x["k"] == KINDS.index("remove"), F.lit("")) \
                .when(x["v"].rlike("^[0-9]+$"), F.lit("[NUMBER]")).otherwise(F.lit("[WORD]"))

    def rewritten(merged: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.transform(merged, lambda x: x["e"]))
        parts = F.zip_with(before, merged, lambda b, x: F.when(x.isNull(), F.substring(text, b + 1, F.length(text)))
                           .otherwise(F.concat(F.substring(text, b + 1, x["s"] - b), replacement(x))))
        return F.array_join(parts, "")

    text = F.col("text")
    rows = with_spans(docs, **options)
    merged = F.aggregate("__pii_spans", F.array().cast(SPANS), merge)
    new = F.when(F.size("__pii_spans") > 0, _let(merged, rewritten)).otherwise(text)
    return rows.withColumn("__pii_new", new).select(*[F.col("__pii_new").alias(c) if c == "text" else F.col(c) for c in docs.columns])
