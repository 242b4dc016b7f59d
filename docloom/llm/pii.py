"""Personal data in texts (DataFrame functions only).

Patterns propose spans; checks confirm them (Luhn for cards, the remainder by
97 for IBANs, ranges for addresses and phones); words of the context before a
span adjust its score.  Positions come from cutting the text at the matches
and adding up the lengths of the parts, in code points.  A text's matches are
handled in chunks, so that a text of very many takes time in proportion to them.

Patterns are written so that none backtracks over a long run: a proposal
starts at a run's start or where the last match ended, and repeated groups are
possessive, which changes no match as nothing follows them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<s:int,k:int,e:int,kind:string,m:string,score:double>>"
#: Code points before a span in which context words count.
CONTEXT = 48
#: Spans of added kinds count from this score on; base kinds always do.
ENOUGH = 0.6
#: Matches of a text that are handled together.
CHUNK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def chunk(values: Column, k: Column) -> Column:
    return F.slice(values, k * CHUNK + 1, F.lit(CHUNK))


def chunks(values: Column) -> Column:
    """Numbers of the chunks of a list that isn't empty."""
    return F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int"))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """12 to 19 digits of which the last is the right check digit."""
    d = digits(m)
    n = F.length(d)

    def value(i: Column) -> Column:
        v = F.substring(d, n - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, v).when(v > 4, 2 * v - 9).otherwise(2 * v)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + value(i))
    return F.when(n.between(12, 19), total % 10 == 0).otherwise(False)


def mod97(m: Column) -> Column:
    """An IBAN: its country and check digits moved to the end, letters as numbers from 10, leaves 1."""
    s = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4))

    def step(a: Column, i: Column) -> Column:
        v = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.substring(turned, i, F.lit(1))) - 1
        return F.when(v > 9, a * 100 + v).otherwise(a * 10 + v) % 97

    n = F.length(s)
    return F.when(n.between(15, 34), F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) == 1).otherwise(False)


def octets(m: Column) -> Column:
    one = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return m.rlike(rf"^{one}\.{one}\.{one}\.{one}$")


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A literal that every match contains; texts without it are not searched.
    hint: str
    check: Callable[[Column], Column] | None
    score: float
    #: Words that raise the score by ``bonus``.
    words: str
    bonus: float = 0.3
    base: bool = True


#: In the order in which spans that start at one place are listed.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++", "@", None, 0.9, "mail|contact|write"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", ".", octets, 0.6, "ip|address|host|server|login"),
    # Base card matches of fewer than 12 digits fail their check, so they are not proposed.
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){11,}+", "", luhn, 0.8, "card|visa|master|credit|pay"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", lambda m: F.length(digits(m)).between(9, 15), 0.7, "call|phone|tel|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])", "", mod97, 0.9, "iban|account|bank|transfer", base=False),
    # A base match swallows digits that follow after one separator, and fails with them: numbers written in their usual groups are proposed by themselves.
    Kind("card", r"(?<![0-9])(?:[0-9]{4}[\x20-]?){3}[0-9]{4}(?![0-9])", "", luhn, 0.8, "card|visa|master|credit|pay", base=False),
    Kind("phone", r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])", "+", lambda m: F.length(digits(m)).between(9, 15), 0.7, "call|phone|tel|mobile|fax", base=False),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "-", None, 0.4, "ssn|social|security|insured", base=False),
)
BASE = tuple(k.name for k in KINDS if k.base)


def spans_of(text: Column, order: int, kind: Kind) -> Column:
    """Confirmed spans of one kind, in order, each with its score."""
    # The part after the last match has no match beside it.
    pairs = F.zip_with(F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    length = lambda x: F.char_length(x["p"]) + F.coalesce(F.char_length(x["m"]), F.lit(0))

    def step(a: Column, x: Column) -> Column:
        s, before = a["at"] + F.char_length(x["p"]), F.concat(a["tail"], x["p"])
        span = F.struct(s.alias("s"), x["m"].alias("m"), F.substring(before, -CONTEXT, CONTEXT).alias("before"))
        return F.struct((a["at"] + length(x)).alias("at"), F.substring(F.concat(before, F.coalesce(x["m"], F.lit(""))), -CONTEXT, CONTEXT).alias("tail"), F.concat(a["out"], F.array(span)).alias("out"))

    def in_chunk(v: Column, at: Column, k: Column) -> Column:
        tail = F.substring(text, F.greatest(at - CONTEXT + 1, F.lit(1)), F.least(at, F.lit(CONTEXT)))
        none = F.array().cast("array<struct<s:int,m:string,before:string>>")
        return F.aggregate(chunk(v, k), F.struct(at.alias("at"), tail.alias("tail"), none.alias("out")), step, lambda a: a["out"])

    def in_order(v: Column) -> Column:
        totals = F.transform(chunks(v), lambda k: F.aggregate(chunk(v, k), F.lit(0), lambda n, x: n + length(x)))
        begun = F.aggregate(totals, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        return F.flatten(F.transform(begun, lambda at, k: in_chunk(v, at, k)))

    placed = F.filter(let(pairs, in_order), lambda x: x["m"].isNotNull())
    if kind.check is not None:
        placed = F.filter(placed, lambda x: kind.check(x["m"]))

    def scored(x: Column) -> Column:
        bonus = F.when(F.lower(x["before"]).rlike(rf"\b(?:{kind.words})"), kind.bonus).otherwise(0.0)
        return F.struct(x["s"], F.lit(order), x["s"] + F.char_length(x["m"]), F.lit(kind.name), x["m"], F.least(F.lit(1.0), F.lit(kind.score) + bonus))

    out = F.transform(placed, scored).cast(SPAN)
    if not kind.base:
        out = F.filter(out, lambda x: x["score"] >= ENOUGH)
    return F.when(F.contains(text, F.lit(kind.hint)), out).otherwise(F.array().cast(SPAN)) if kind.hint else out


def apart(x: Column, spans: Column) -> Column:
    """Whether ``x`` overlaps none of ``spans``, which are in order and don't overlap: by bisection."""

    def halved(a: Column, _: Column) -> Column:
        middle = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        open_, ended = a["lo"] < a["hi"], F.get(spans, middle)["e"] <= x["s"]
        return F.struct(F.when(open_ & ended, middle + 1).otherwise(a["lo"]).alias("lo"), F.when(open_ & ~ended, middle).otherwise(a["hi"]).alias("hi"))

    steps = F.sequence(F.lit(0), F.length(F.bin(F.size(spans))))
    first = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi")), halved, lambda a: a["lo"])
    return F.coalesce(F.get(spans, first)["s"] >= x["e"], F.lit(True))


def without(own: Column, spans: Column) -> Column:
    """Those of ``own`` that overlap none of ``spans``."""
    left = let(spans, lambda v: F.filter(own, lambda x: apart(x, v)))
    return F.when((F.size(own) > 0) & (F.size(spans) > 0), left).otherwise(own)


def with_spans(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """``docs`` with column ``into``: all spans, by start and then by kind.

    Added spans that overlap a base span of their kind, or a card an IBAN, are
    the same thing seen twice and are left out.

    A span has s and e (code points, end exclusive), k and kind, m (its text)
    and score.  Spans of different kinds may overlap.  Null and empty texts
    have none; rows stay as they are otherwise, a column called ``into`` is
    replaced.
    """
    source = F.coalesce(F.col(text).cast("string"), F.lit(""))
    each = docs.select(*(c for c in docs.columns if c != into), F.struct(*(spans_of(source, i, k).alias(f"k{i}") for i, k in enumerate(KINDS))).alias("__found"))
    found = [F.col("__found")[f"k{i}"] for i in range(len(KINDS))]

    def alone(own: Column, others: list[Column]) -> Column:
        for other in others:
            own = without(own, other)
        return own

    added = []
    for i, kind in enumerate(KINDS):
        if not kind.base:
            same = [found[j] for j, other in enumerate(KINDS) if other.base and other.name == kind.name or kind.name == "card" and other.name == "iban"]
            added.append(alone(found[i], same))
    return each.withColumn(into, F.array_sort(F.concat(*found[: len(BASE)], *added))).drop("__found")


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in angle brackets; of overlapping spans the first gives the name."""
    text = F.coalesce(text, F.lit(""))

    def in_chunk(own: Column, at: Column) -> Column:
        def named(part: Column) -> Column:
            def step(a: Column, x: Column) -> Column:
                kept = F.concat(a["out"], F.substring(part, a["at"] - at + 1, x["s"] - a["at"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))
                return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.when(x["s"] >= a["at"], kept).otherwise(a["out"]).alias("out"))

            return F.aggregate(own, F.struct(at.alias("at"), F.lit("").alias("out")), step, lambda a: a["out"])

        # Behind the last chunk, the rest of the text.
        rest = F.substring(text, at + 1, F.char_length(text))
        return F.when(F.size(own) > 0, let(F.substring(text, at + 1, F.element_at(own, -1)["s"] - at), named)).otherwise(rest)

    def in_order(v: Column) -> Column:
        ends = F.transform(chunks(v), lambda k: F.array_max(F.transform(chunk(v, k), lambda x: x["e"])))
        begun = F.aggregate(ends, F.array(F.lit(0)), lambda a, e: F.concat(a, F.array(F.greatest(F.element_at(a, -1), e))))
        return F.array_join(F.transform(begun, lambda at, k: let(chunk(v, k), lambda own: in_chunk(own, at))), "")

    return F.when(F.size(spans) > 0, let(spans, in_order)).otherwise(text)


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of personal data masked in ``text``; null texts stay null."""
    rows = with_spans(docs, text, "__pii")
    return rows.withColumn(text, F.when(F.col(text).isNotNull(), masked(F.col(text), F.col("__pii")))).select(*docs.columns)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def span_digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_<kind> of base spans, base_sha256, spans, scores) of every document.

    Null texts count as empty and have no spans; a text of any length is
    searched whole, in time about in proportion to its length.  Spans that
    start at one place are listed in the order of their kinds.  Repeated rows
    and rows without an id stay, each with its spans; an empty table gives no
    rows; other columns are not read.
    """
    rows = with_spans(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "pii").drop("text")
    base = F.filter("pii", lambda x: x["k"] < len(BASE))
    of_kind = lambda k: F.size(F.filter("pii", lambda x: x["k"] == BASE.index(k)))
    counts = [of_kind(k).cast("long").alias(f"n_{k}") for k in BASE]
    scores = F.array_join(F.transform("pii", lambda x: F.format_number(x["score"], 2)), ",")
    return rows.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"), scores.alias("scores"))
