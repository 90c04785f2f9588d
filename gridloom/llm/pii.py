"""Personal data by patterns, checksums and context, in DataFrame operations only.

Each kind has a pattern that proposes spans, a validator that confirms them (Luhn for
card numbers, mod 97 for account numbers, ranges or character classes for the rest) and a score that words
nearby raise or lower. Spans of the base kinds that pass their validator stay
whatever their score; spans of the added kinds need THRESHOLD and must not overlap a
base span.

Positions come from splitting the text at the pattern: the lengths of the parts and
of the matches, summed up. The patterns are possessive and start only where a run
starts, so the time is linear in the text, also where nothing matches; each pattern
is run only on texts with a character that it needs.

Defined cases: a null text is empty and has no spans; positions count code points;
kinds are searched apart, so spans of two base kinds may overlap; null and repeated
ids are rows like others; texts are searched whole, in time linear in their length; an
empty table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.6
_BLOCK = 64


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: str
    valid: Callable[[Column], Column]
    score: float
    words: str
    base: bool = True


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _codes(s: Column) -> Column:
    """Code points of an ASCII string."""
    return F.transform(F.split(s, ""), F.ascii)


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(d)
    twice = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    total = F.aggregate(_codes_with_place(d, n), F.lit(0), lambda a, x: a + F.when(x["p"] % 2 == 1, twice(x["v"])).otherwise(x["v"]))
    return total % 10 == 0


def _codes_with_place(d: Column, n: Column) -> Column:
    return F.transform(_codes(d), lambda c, i: F.struct((c - 48).alias("v"), (n - 1 - i).alias("p")))


def mod97(m: Column) -> Column:
    """Whether an account number (country, check digits, number) leaves 1 when divided by 97."""
    s = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4)))
    return F.aggregate(_codes(turned), F.lit(0), lambda a, c: F.when(c >= 65, (a * 100 + c - 55) % 97).otherwise((a * 10 + c - 48) % 97)) == 1


def _within(x: Column, lo: int, hi: int) -> Column:
    return (F.length(x) >= lo) & (F.length(x) <= hi)


def _is_card(m: Column) -> Column:
    return F.when(_within(digits(m), 14, 19), luhn(digits(m))).otherwise(False)


def _is_secret(m: Column) -> Column:
    """Letters and digits mixed, as in keys made at random; words and numbers alone are none."""
    return (F.length(digits(m)) >= 4) & (F.length(F.regexp_replace(m, "[^A-Za-z]", "")) >= 4)


def _is_ip(m: Column) -> Column:
    short = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(short, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False))


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda m: F.lit(True), 0.8, "mail|contact|address|write to|adresse|correo"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", _is_ip, 0.6, r"\bip\b|address|server|host|adresse"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9]", _is_card, 0.7, "card|visa|credit|payment|carte|karte|tarjeta"),
    Kind("phone", r"\+[0-9](?:[\x20().-]*+[0-9])++", "+", lambda m: _within(digits(m), 10, 15), 0.7, "phone|call|mobile|tel|fax"),
    Kind("iban", r"(?:\G|(?<![A-Za-z0-9]))[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", mod97, 0.7, "iban|account|bank|konto|compte|cuenta", base=False),
    Kind("local_phone", r"(?:\G|(?<![0-9+]))(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])", "[0-9]", lambda m: F.lit(True), 0.4, "phone|call|mobile|tel|fax", base=False),
    Kind("secret", r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+", "(?i)token|secret|passw|key|credential|bearer|auth", _is_secret, 0.4, "token|secret|passw|key|credential|bearer|auth", base=False),
)
#: Words that speak against a find where they stand just before it.
AGAINST = "version|example|sample|order no|invoice"


def running_sums(lengths: Column) -> Column:
    """Sum of the entries before each one. By blocks, so that the time stays near linear in the number of matches."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")), lambda b: F.slice(lengths, b * _BLOCK + 1, _BLOCK))
    inner = F.transform(blocks, lambda s: F.transform(s, lambda x, i: total(F.slice(s, F.lit(1), i))))
    sums = F.transform(blocks, total)
    outer = F.transform(sums, lambda x, i: total(F.slice(sums, F.lit(1), i)))
    return F.flatten(F.zip_with(inner, outer, lambda s, o: F.transform(s, lambda x: x + o)))


_SPAN = "array<struct<start:bigint,end:bigint,kind:string,rank:int,base:boolean,score:double>>"


def _span_maker(kind: Kind, rank: int) -> Callable[[Column, Column], Column]:
    def span(m: Column, i: Column) -> Column:
        start = F.get("b", i) + F.length(F.get("p", i))
        ahead = F.lower(F.right(F.get("p", i), F.lit(40)))
        near = F.concat(ahead, F.lit(" | "), F.lower(F.left(F.get("p", i + 1), F.lit(20))))
        score = kind.score + F.when(near.rlike(kind.words), 0.25).otherwise(0.0) - F.when(ahead.rlike(AGAINST), 0.25).otherwise(0.0)
        return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), F.lit(kind.name).alias("kind"), F.lit(rank).alias("rank"), F.lit(kind.base).alias("base"), F.when(kind.valid(m), score).otherwise(-1.0).alias("score"))

    return span


def _passes(least: float) -> Callable[[Column], Column]:
    return lambda s: s["score"] >= least


def _is_kind(name: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == name


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its spans (start, end, kind, rank of the kind, base, score), by start and kind. No shuffle."""
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    none = F.array().cast(_SPAN)
    for rank, kind in enumerate(KINDS):
        there = F.contains("text", F.lit(kind.needs)) if len(kind.needs) == 1 else F.col("text").rlike(kind.needs)
        pattern = F.lit(kind.pattern)
        out = out.withColumn("m", F.when(there, F.regexp_extract_all("text", pattern, F.lit(0))))
        out = out.withColumn("p", F.when(F.size("m") > 0, F.split("text", kind.pattern, -1)))
        out = out.withColumn("b", F.when(F.size("m") > 0, running_sums(F.zip_with(F.slice("p", F.lit(1), F.size("m")), "m", lambda p, m: (F.length(p) + F.length(m)).cast("long")))))

        made = F.transform("m", _span_maker(kind, rank))
        passed = F.filter(made, _passes(0.0 if kind.base else THRESHOLD))
        out = out.withColumn(kind.name, F.when(F.size("m") > 0, passed.cast(_SPAN)).otherwise(none))
    base, more = (F.concat(*[F.col(k.name) for k in KINDS if k.base is b]) for b in (True, False))
    out = out.select("doc_id", base.alias("base"), more.alias("more"))
    apart = F.filter("more", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    order = lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(a["rank"] - b["rank"])
    return out.select("doc_id", F.array_sort(F.concat("base", apart), order).alias("spans"))


def listing(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def summary(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their listing, the listing of all spans and their number."""
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter("spans", _is_kind(k.name))).cast("long").alias(f"n_{k.name}") for k in KINDS if k.base]
    return found.select("doc_id", *counts, F.sha2(listing(base), 256).alias("base_sha256"), listing(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
