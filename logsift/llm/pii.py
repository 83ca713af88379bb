"""Personal data in texts: regular expressions propose, checksums confirm, context words adjust. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"


@dataclass(frozen=True)
class Kind:
    """A kind of personal data. Its pattern proposes spans from left to right without overlap; ``near`` are words that
    raise the score when they stand within WINDOW characters before the span. Spans under ``least`` are dropped.

    The patterns use possessive repeats and start only where a run starts (or where the last match ended), which finds
    the same spans as the plain pattern in time linear in the text.
    """

    name: str
    pattern: str
    has: str
    score: float
    least: float
    near: str


#: Characters before a span in which context words count, and what they add to the score.
WINDOW, RAISE = 40, 0.4

#: Fixed order of the kinds in results; the first four are kept whenever their check holds.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, 0.0, "mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", 0.6, 0.0, "ip|host|server|address"),
    Kind("card", r"(?<![0-9])[0-9](?:[ -]?[0-9])++", "[0-9]", 0.7, 0.0, "card|visa|credit|pay"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", 0.6, 0.0, "phone|call|tel|fax|mobile"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", 0.8, 0.5, "iban|bank|account|konto|compte|cuenta"),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "[0-9]-[0-9]", 0.3, 0.5, "ssn|social|security|insurance"),
)
BASE = ("email", "ip", "card", "phone")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _mod97(m: Column) -> Column:
    """Remainder of an IBAN modulo 97: the first four characters go last, A to Z count as 10 to 35."""
    flat = F.regexp_replace(m, " ", "")
    chars = F.split(F.concat(F.substring(flat, 5, 40), F.substring(flat, 1, 4)), "")
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda acc, c: F.when(c == "", acc).when(c.rlike("[0-9]"), (acc * 10 + value(c)) % 97).otherwise((acc * 100 + value(c)) % 97)
    return F.aggregate(chars, F.lit(0), step)


def _confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.length(_digits(m)).between(16, 19) & F.call_function("luhn_check", _digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(m, " ", "")).between(15, 34) & (_mod97(m) == 1)
    return F.lit(True)


#: Numbers added up in a row: a text's matches are counted on in pieces of so many, since each step copies its piece.
PIECE = 256


def _bound(x: Column, of: Callable[[Column], Column]) -> Column:
    """of(x), with x computed once for a row however often of() names it."""
    return F.transform(F.array(x), of)[0]


def _running(numbers: Column, of: Callable[[Column], Column]) -> Column:
    """of(the sums of each number and all before it)."""
    none = F.array().cast("array<int>")
    fold = lambda a: F.aggregate(a, none, lambda acc, v: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + v)))
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(numbers), F.lit(1)), F.lit(PIECE)), lambda at: fold(F.slice(numbers, at, F.lit(PIECE))))

    def joined(parts: Column) -> Column:
        totals = fold(F.transform(parts, lambda p: F.coalesce(F.try_element_at(p, F.lit(-1)), F.lit(0))))
        moved = lambda totals: F.transform(parts, lambda p, i: F.transform(p, lambda v: v + F.when(i > 0, totals[i - 1]).otherwise(0)))
        return _bound(F.flatten(_bound(totals, moved)), of)

    return _bound(parts, joined)


def _spans(text: Column, k: Kind) -> Column:
    """Array of (kind, start, end, score): a match's place is the length of all gaps and matches before it."""
    found = F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))
    gaps = F.split(text, k.pattern, -1)
    both = _bound(found, lambda m: F.arrays_zip(m.alias("m"), F.slice(gaps, 1, F.size(m)).alias("g")))

    def placed(both: Column, ends: Column) -> Column:
        def span(x: Column, i: Column) -> Column:
            m, g = x["m"], x["g"]
            score = F.lit(k.score) + F.when(F.lower(F.right(g, F.lit(WINDOW))).rlike(rf"\b(?:{k.near})"), RAISE).otherwise(0.0)
            whole = F.struct(F.lit(k.name).alias("kind"), (ends[i] - F.length(m)).alias("start"), ends[i].alias("end"), F.least(score, F.lit(1.0)).alias("score"))
            return F.struct(whole.alias("span"), (_confirmed(k.name, m) & (score >= k.least)).alias("good"))

        return F.transform(F.filter(F.transform(both, span), lambda s: s["good"]), lambda s: s["span"])

    lengths = lambda both: F.transform(both, lambda x: F.length(x["g"]) + F.length(x["m"]))
    spans = _bound(both, lambda both: _bound(lengths(both), lambda n: _running(n, lambda ends: placed(both, ends))))
    return F.when(text.rlike(k.has), spans).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>"))


def personal_data(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """docs with ``pii_<kind>``, one array of (kind, start, end, score) for each kind: code points, end exclusive.

    A null or empty text has none. Kinds are independent and may overlap. Each text is handled alone, without a
    shuffle; all columns and rows of docs stay, a column of the same name is replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({f"pii_{k.name}": _spans(text, k) for k in kinds})


def span_list(*arrays: Column) -> Column:
    """kind:start:end of all spans, in the order of the arrays, joined by commas."""
    return F.array_join(F.transform(F.concat(*arrays), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
