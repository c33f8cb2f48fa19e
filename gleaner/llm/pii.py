"""Personal data: patterns propose spans, checksums confirm them, context scores them.

Everything is a column expression over one row, so nothing is shuffled and a
text of any length stays in its task. Offsets are code points, end exclusive.

Kinds: ``email``, ``ip``, ``card`` and ``phone`` as the contract has them, kept
whatever their score; ``iban`` (mod 97) and ``ssn``, kept from ``MIN_SCORE``,
which a form without a checksum only reaches near a word such as "social".

Null and empty texts have no spans; a null text stays null when redacted. Rows
are handled one by one, so repeated rows give repeated results, an empty table
gives an empty one, and all other columns pass unchanged (also one that is
called like the result, unless it has exactly the name given for it).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import let
from gleaner.llm.common import before_blocks, in_blocks, own_column

SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
MIN_SCORE = 0.6
NEAR_BEFORE, NEAR_AFTER = 48, 24
CONTEXT_BONUS = 0.3
PART = 4096

DIGITS = "[0-9]"
LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
WORD = "[0-9A-Za-z_]"
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def total(text: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            digit = F.substring(text, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
            return acc + F.when(digit > 9, digit - 9).otherwise(digit)

        return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), add)

    return let(F.reverse(digits), lambda text: F.when(F.length(text) > 0, total(text) % 10 == 0).otherwise(False))


def mod97(account: Column) -> Column:
    """Whether an account number in capitals and digits passes ISO 7064 mod 97."""
    symbols = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def rest(text: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            value = F.call_function("locate", F.substring(text, i, F.lit(1)), F.lit(symbols)) - 1
            return (acc * F.when(value > 9, 100).otherwise(10) + value) % 97

        return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), add)

    return let(turned, lambda text: F.when(F.length(text) > 4, rest(text) == 1).otherwise(False))


def _card(match: Column) -> Column:
    return let(_digits(match), lambda d: F.length(d).between(13, 19) & luhn(d))


def _phone(match: Column) -> Column:
    return F.length(_digits(match)).between(9, 15)


def _ip(match: Column) -> Column:
    return match.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")


def _iban(match: Column) -> Column:
    return let(F.replace(match, F.lit(" "), F.lit("")), lambda a: F.length(a).between(15, 34) & mod97(a))


@dataclass(frozen=True)
class Rule:
    kind: str
    needs: str  # a text without a match of this has no span of the kind
    pattern: str
    valid: Callable[[Column], Column]
    score: float
    context: str
    base: bool


# Possessive repeats match what the plain ones of the contract match, as what
# follows them can't start with what they repeat; the look-behinds only skip
# starts within a run that has failed from its beginning. So long runs of
# digits or letters cost neither stack nor quadratic time.
RULES = (
    Rule("email", "@", rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++", lambda m: F.lit(True), 0.7,
         "mail|contact|write|address", True),
    Rule("ip", r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _ip, 0.5,
         r"\bip\b|host|server|address|login", True),
    Rule("card", "[0-9][ -]?[0-9]", "[0-9](?:[ -]?[0-9])++", _card, 0.7, "card|visa|credit|pay", True),
    Rule("phone", r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", _phone, 0.6, "phone|tel|call|mobile|fax", True),
    Rule("iban", "[A-Z]{2}[0-9]{2}",
         rf"(?<!{WORD})[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?(?!{WORD})", _iban, 0.7,
         "iban|account|bank|konto|transfer", False),
    Rule("ssn", "[0-9]-[0-9]{2}-[0-9]", rf"(?<!{WORD})[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?!{WORD})",
         lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), 0.4, r"\bssn\b|social|security", False),
)
KINDS = [r.kind for r in RULES]
BASE = [r.kind for r in RULES if r.base]


def _spans(text: Column, rule: Rule) -> Column:
    """The confirmed spans of one kind, in order."""
    pieces = F.split(text, rule.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))

    def fold(between: Column) -> Column:
        after = F.slice(between, F.lit(2), F.size(between))
        rows = F.arrays_zip(between.alias("before"), found.alias("match"), after.alias("after"))

        def width(at: Column, row: Column) -> Column:
            return at + F.length(row["before"]) + F.coalesce(F.length(row["match"]), F.lit(0))

        def step(acc: Column, row: Column) -> Column:
            start = acc["at"] + F.length(row["before"])
            end = start + F.length(row["match"])
            near = F.lower(F.concat(F.right(row["before"], F.lit(NEAR_BEFORE)), F.lit(" "),
                                    F.left(row["after"], F.lit(NEAR_AFTER))))
            bonus = F.when(near.rlike(rule.context), CONTEXT_BONUS).otherwise(0.0)
            score = F.round(F.lit(rule.score) + bonus, 3)
            span = F.struct(F.lit(rule.kind).alias("kind"), start.alias("start"), end.alias("end"), score.alias("score"))
            keep = rule.valid(row["match"])
            if not rule.base:
                keep = keep & (score >= MIN_SCORE)
            spans = F.when(keep, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
            moved = F.struct(end.alias("at"), spans.alias("spans"))
            return F.when(row["match"].isNull(), acc).otherwise(moved)

        def scan(blocks: Column) -> Column:
            def of_block(starts: Column) -> Column:
                def run(block: Column, i: Column) -> Column:
                    empty = F.struct(F.get(starts, i).alias("at"), F.array().cast(SPANS).alias("spans"))
                    return F.aggregate(block, empty, step, lambda acc: acc["spans"])

                return F.flatten(F.transform(blocks, run))

            return let(before_blocks(blocks, F.lit(0), width), of_block)

        return in_blocks(rows, scan)

    return F.when(text.rlike(rule.needs), let(pieces, fold)).otherwise(F.array().cast(SPANS))


def find(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """``docs`` and a column of all spans, by kind and then by start."""
    return docs.withColumn(into, F.concat(*[_spans(F.coalesce(F.col(text), F.lit("")), r) for r in RULES]))


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; spans that
    overlap an earlier one extend it."""
    ordered = F.array_sort(spans, lambda a, b: F.coalesce(
        F.nullif(F.signum(a["start"] - b["start"]).cast("int"), F.lit(0)), F.signum(b["end"] - a["end"]).cast("int")
    ))

    def marked(parts: Column) -> Column:
        def step(acc: Column, span: Column) -> Column:
            gap = _between(parts, acc["at"], span["start"])
            mark = F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]"))
            new = F.struct(span["end"].alias("at"), F.concat(acc["parts"], F.array(gap, mark)).alias("parts"))
            longer = F.struct(F.greatest(acc["at"], span["end"]).alias("at"), acc["parts"].alias("parts"))
            return F.when(span["start"] >= acc["at"], new).otherwise(longer)

        def scan(blocks: Column) -> Column:
            def of_block(ends: Column) -> Column:
                def run(block: Column, i: Column) -> Column:
                    empty = F.struct(F.get(ends, i).alias("at"), F.array().cast("array<string>").alias("parts"))
                    return F.array_join(F.aggregate(block, empty, step, lambda acc: acc["parts"]), "")

                rest = _between(parts, F.element_at(ends, -1), F.length(text))
                return F.array_join(F.concat(F.transform(blocks, run), F.array(rest)), "")

            return let(before_blocks(blocks, F.lit(0), lambda at, span: F.greatest(at, span["end"])), of_block)

        return in_blocks(ordered, scan)

    return F.when(F.size(spans) > 0, let(_parts(text), marked)).otherwise(text)


def _parts(text: Column) -> Column:
    """``text`` in parts of ``PART`` characters. A substring is searched from the start of
    its text, so the many of a long text are taken from these."""
    last = F.floor(F.length(text) / PART).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * PART + 1, F.lit(PART)))


def _between(parts: Column, start: Column, end: Column) -> Column:
    """The characters from ``start`` up to ``end`` of the text cut into ``parts``."""
    first, last = F.floor(start / PART).cast("int"), F.floor(end / PART).cast("int")
    within = F.substring(F.get(parts, first), start % PART + 1, end - start)
    over = F.concat(
        F.substring(F.get(parts, first), start % PART + 1, F.lit(PART)),
        F.array_join(F.slice(parts, first + 2, last - first - 1), ""),
        F.substring(F.get(parts, last), F.lit(1), end % PART),
    )
    return F.when(start >= end, F.lit("")).when(first == last, within).otherwise(over)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the personal data of ``text`` replaced; columns as before."""
    into = own_column(docs, "pii")
    found = find(docs, text, into)
    return found.withColumn(text, redacted(F.col(text), F.col(into))).select(*docs.columns)


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, the hash of the base spans and all spans as text, per row."""
    found = find(docs.select(key, text), text, "pii")

    def of(*kinds: str) -> Column:
        return F.filter("pii", lambda s: s["kind"].isin(*kinds))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        key,
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(of(*BASE)), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
    )
