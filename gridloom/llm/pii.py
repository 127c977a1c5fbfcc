r"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Kinds: email, ip, card (Luhn), phone, and, added by the method, iban (mod 97) and ssn. Matches are leftmost and
non-overlapping per kind; a match that its validator rejects is dropped without another try. An IBAN may be followed by
words of capitals or digits: each place where one can begin proposes the words from there on, and the longest start of
these that passes mod 97 is the span.

Each kind takes one pass: `regexp_replace` sets U+FFFF around the matches, `split` deals the pieces, and a fold over
them adds up code points, so that the position of every match is known. Runs are matched possessively and only from
their first character, which keeps very long runs linear and off the regex engine's stack. A cheap test decides
per row and kind whether the pass is needed at all.

Scores: a base per kind, more where a context word stands within 40 characters before the span. No span that passes
its validator is dropped by its score; the score is a column of its own.

Edge cases: null texts are empty and have no spans; U+FFFF in a text counts as one code point; ties (two kinds over the
same characters) are all kept; repeated rows are independent; extra columns are kept by `redact`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, sha_hex, text_of

MARK = "￿"
LOCAL = "A-Za-z0-9._%+-"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    d = F.filter(F.split(F.reverse(digits), ""), lambda x: x != "")
    total = F.aggregate(
        d,
        F.struct(F.lit(0).alias("i"), F.lit(0).alias("t")),
        lambda a, x: F.struct((a["i"] + 1).alias("i"), (a["t"] + F.when(a["i"] % 2 == 0, x.cast("int")).when(x.cast("int") > 4, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2)).alias("t")),
    )
    return total["t"] % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without blanks passes the mod 97 test."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, F.lit(1), F.lit(4)))
    value = lambda x: F.when(x.between("0", "9"), F.ascii(x) - 48).otherwise(F.ascii(x) - 55)
    chars = F.filter(F.split(moved, ""), lambda x: x != "")
    return F.aggregate(chars, F.lit(0), lambda a, x: ((a * F.when(value(x) > 9, F.lit(100)).otherwise(F.lit(10)) + value(x)) % 97).cast("int")) == 1


def _ip(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))


def _card(m: Column) -> Column:
    return F.length(_digits(m)).between(12, 19) & luhn(_digits(m))


def _iban_length(m: Column) -> Column:
    """The length of the longest start of whole words that passes mod 97 with 15 to 34 characters, or null."""
    words = F.split(m, " ")
    starts = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.slice(words, F.lit(1), n))
    plain = lambda w: F.array_join(w, "")
    fits = F.filter(starts, lambda w: F.length(plain(w)).between(15, 34))
    return F.array_max(F.transform(F.filter(fits, lambda w: mod97(plain(w))), lambda w: F.length(F.array_join(w, " "))))


def _ssn(m: Column) -> Column:
    return ~(m.startswith("000") | m.startswith("666") | m.startswith("9") | F.substring(m, 5, 2).eqNullSafe("00") | m.endswith("0000"))


#: kind: (cheap test of the text, pattern, validator, base score, context words); the first four are the base kinds.
KINDS: dict[str, tuple[Callable[[Column], Column], str, Callable[[Column], Column], float, str]] = {
    "email": (lambda t: t.contains("@"), rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), 0.8, "e-?mail|contact|write|mailto"),
    "ip": (lambda t: t.rlike(r"[0-9]\.[0-9]"), r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _ip, 0.6, "ip|host|server|address"),
    "card": (lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){11}"), r"[0-9](?:[ -]?[0-9])++", _card, 0.7, "card|visa|credit|master|payment"),
    "phone": (lambda t: t.contains("+"), r"\+[0-9][ ().0-9-]+[0-9]", lambda m: F.length(_digits(m)).between(9, 15), 0.6, "phone|tel|call|mobile|fax|whatsapp"),
    "iban": (lambda t: t.rlike("[A-Z]{2}[0-9]{2} ?[A-Z0-9]"), r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}[A-Z0-9]{0,30}+(?![A-Za-z0-9])(?: [A-Z0-9]{1,30}+(?![A-Za-z0-9])){0,30}+))", _iban_length, 0.8, "iban|account|bank|konto"),
    "ssn": (lambda t: t.rlike("[0-9]-[0-9]{2}-[0-9]"), r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _ssn, 0.4, "ssn|social|security"),
}
BASE = ("email", "ip", "card", "phone")
SPANS = "array<struct<start:bigint,kind:int,end:bigint,score:double>>"
NEAR = 40


def spans_of(text: Column, kind: str) -> Column:
    """array<struct<start,kind,end,score>> of one kind, in order; code points, end exclusive."""
    test, pattern, valid, base, words = KINDS[kind]
    number = list(KINDS).index(kind)
    ahead = kind == "iban"  # its matches are copies of what lies ahead, so they take no place
    safe = F.when(text.contains(MARK), F.translate(text, MARK, "￾")).otherwise(text)
    pieces = F.split(F.regexp_replace(safe, pattern if ahead else f"({pattern})", f"{MARK}$1{MARK}"), MARK, -1)
    none = F.expr(f"cast(array() as {SPANS})")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(False).alias("is_match"), F.lit("").alias("gap"), none.alias("out"))

    def step(a: Column, s: Column) -> Column:
        end = a["at"] + F.length(s)
        score = F.when(F.lower(F.right(a["gap"], F.lit(NEAR))).rlike(words), F.lit(min(1.0, base + 0.2))).otherwise(F.lit(base))
        span = F.struct(a["at"].alias("start"), F.lit(number).alias("kind"), end.alias("end"), score.alias("score"))
        out = F.when(a["is_match"], F.when(valid(s), F.concat(a["out"], F.array(span))).otherwise(a["out"])).otherwise(a["out"])
        return F.struct(end.alias("at"), (~a["is_match"]).alias("is_match"), s.alias("gap"), out.alias("out"))

    def step_ahead(a: Column, s: Column) -> Column:
        last = F.coalesce(F.get(a["out"], F.size(a["out"]) - 1)["end"], F.lit(0))
        score = F.when(F.lower(a["gap"]).rlike(words), F.lit(min(1.0, base + 0.2))).otherwise(F.lit(base))
        span = F.struct(a["at"].alias("start"), F.lit(number).alias("kind"), (a["at"] + valid(s)).alias("end"), score.alias("score"))
        out = F.when(a["is_match"] & (a["at"] >= last), F.when(valid(s).isNotNull(), F.concat(a["out"], F.array(span))).otherwise(a["out"])).otherwise(a["out"])
        at, gap = F.when(a["is_match"], a["at"]).otherwise(a["at"] + F.length(s)), F.when(a["is_match"], a["gap"]).otherwise(F.right(F.concat(a["gap"], s), F.lit(NEAR)))
        return F.struct(at.alias("at"), (~a["is_match"]).alias("is_match"), gap.alias("gap"), out.alias("out"))

    return F.when(test(text), F.aggregate(pieces, start, step_ahead if ahead else step)["out"]).otherwise(none)


def find(docs: DataFrame, kinds: tuple[str, ...] = tuple(KINDS), text: str = "text", spans: str = "pii_spans") -> DataFrame:
    """`docs` plus the column `spans`, sorted by start, then kind. A column of this name is replaced in the result: name another to
    keep it, as `redact` does."""
    t = text_of(text)
    return docs.withColumn(spans, F.array_sort(F.concat(*[spans_of(t, k) for k in kinds])))


def labelled(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, doc: str = "doc_id") -> DataFrame:
    count = lambda k: F.size(F.filter("pii_spans", lambda s: s["kind"] == list(KINDS).index(k))).cast("long")
    base = F.filter("pii_spans", lambda s: s["kind"] < len(BASE))
    lowest = F.array_min(F.transform("pii_spans", lambda s: s["score"]))
    return found.select(doc, *[count(k).alias(f"n_{k}") for k in BASE], sha_hex(labelled(base)).alias("base_sha256"), labelled(F.col("pii_spans")).alias("spans"), lowest.alias("min_score"))


def redact(docs: DataFrame, kinds: tuple[str, ...] = tuple(KINDS), text: str = "text") -> DataFrame:
    """`docs` with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    whole, spans = fresh(docs, "whole_text"), fresh(docs, "pii_spans")
    found = find(docs.withColumn(whole, text_of(text)), kinds, whole, spans)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(a: Column, s: Column) -> Column:
        gap = F.substring(F.col(whole), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
        out = F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.array(gap, F.get(names, s["kind"]))))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate(spans, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col(whole), (a["at"] + 1).cast("int"), F.length(whole))))
    return found.withColumn(text, F.when(F.size(spans) > 0, done).otherwise(F.col(text))).select(*docs.columns)
