"""Personal data in texts: patterns propose, checksums confirm, context words adjust the score.

Positions come from one split per kind: the gaps and the matches alternate, so running sums of
their lengths (in code points) give every start. Patterns are written so that no text makes
them slow: a match can begin only at the start of a run or where the last match ended, and
possessive repeats never back off; both leave the leftmost non-overlapping matches of the base
patterns unchanged. Kinds whose cheap precondition fails cost one scan.

All kinds are confirmed: e-mail by its form, IP addresses by their parts, cards by the Luhn sum
of 16 to 19 digits, phones by 8 to 15 digits, IBANs by mod 97, social security numbers
by a context word. A failing match is dropped, its text is not tried again. IBANs are the
exception: every place where one can begin is tried, first with the length of its country, so that
neither following words (a BIC, an amount) nor a failing match before it hide one; then, as for
countries without a known length, as far as upper-case letters and digits go on.

Built-in column functions only; nothing is shuffled. Defined cases: a null or empty text has no
spans (and stays null in :func:`redact`); rows are handled one by one, so repeated rows, null
ids and further columns are kept as they are; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.columns import col, fresh

#: Base kinds in their order, and those that the method adds after them.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")

#: Length of an IBAN without blanks -> its countries.
IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
OWN_LENGTH = "|".join(
    f"(?:{names.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{length - 4}}}" for length, names in IBAN_COUNTRIES.items()
)

#: kind -> (cheap precondition, pattern). That of IBANs has no width; its groups are the longest
#: candidate that begins there and the one with the length of its country (may be empty).
PATTERNS = {
    "email": ("@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": (r"[0-9](?:[ -]?[0-9]){15}", r"(?<![0-9])[0-9](?:[ -]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
    "iban": (
        r"[A-Z]{2}[0-9]{2}",
        rf"\b(?=([A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}}\b))(?=(?:({OWN_LENGTH})\b)?)",
    ),
    "ssn": (r"[0-9]{3}-[0-9]{2}-", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"),
}
IP_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
IP = rf"^{IP_PART}(?:\.{IP_PART}){{3}}$"

#: kind -> (score of a confirmed match, words nearby that raise it).
SCORES = {
    "email": (0.9, "mail|contact|write"),
    "ip": (0.6, r"\bip\b|address|host|server"),
    "card": (0.9, "card|visa|credit|payment"),
    "phone": (0.7, "phone|call|tel|fax|mobile"),
    "iban": (0.95, "iban|account|bank"),
    "ssn": (0.4, "ssn|social security"),
}
RAISE, LOWER = 0.2, 0.2
DOUBTFUL = r"\b(?:example|test|dummy|version|sample)\b"
#: Characters before and after a span in which context words count.
BEFORE, AFTER = 40, 20
#: Spans of the method's own kinds need this score; base spans always stay.
LEAST_SCORE = 0.5

SPANS = "array<struct<kind:string,start:int,end:int,text:string,score:double>>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    turned = F.reverse(digits)

    def add(total, i):
        d = F.substring(turned, i, 1).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without blanks passes the ISO 7064 mod 97-10 check."""
    moved = F.concat(F.substring(iban, 5, 34), F.substring(iban, 1, 4))

    def add(rest, i):
        code = F.ascii(F.substring(moved, i, 1))
        return F.when(code >= 65, rest * 100 + code - 55).otherwise(rest * 10 + code - 48) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add) == 1


def confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(IP)
    if kind == "card":
        digits = F.regexp_replace(match, "[ -]", "")
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(8, 15)
    if kind == "iban":
        plain = F.replace(match, F.lit(" "), F.lit(""))
        return F.when(F.length(plain).between(15, 34), mod97(plain)).otherwise(F.lit(False))
    return F.lit(True)


def score(kind: str, text: Column, start: Column, end: Column) -> Column:
    base, words = SCORES[kind]
    first = F.greatest(start - BEFORE, F.lit(0))
    near = F.lower(
        F.concat(text.substr(first + 1, start - first), F.lit(" "), text.substr(end + 1, F.lit(AFTER)))
    )
    raised = F.when(near.rlike(words), RAISE).otherwise(0.0)
    lowered = F.when(near.rlike(DOUBTFUL), LOWER).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(base) + raised - lowered))


PLACES = "array<struct<start:int,end:int,text:string>>"


def placed_ibans(text: Column) -> Column:
    """Confirmed IBANs by start; of overlapping ones the first stays."""
    pattern = PATTERNS["iban"][1]
    longest, own = (F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) for group in (1, 2))
    gaps = F.split(text, pattern, -1)
    # A split drops the empty gap before a match without width at the very start.
    steps = F.arrays_zip(
        F.when(F.size(gaps) == F.size(longest), F.concat(F.array(F.lit("")), gaps)).otherwise(gaps).alias("gap"),
        longest.alias("longest"), own.alias("own"),
    )

    def place(acc, step):
        start = acc["at"] + F.length(step["gap"])
        match = F.when(confirmed("iban", step["own"]), step["own"]).when(
            confirmed("iban", step["longest"]), step["longest"]
        )
        end = start + F.length(match)
        good = match.isNotNull() & (start >= acc["done"])
        span = F.struct(start.alias("start"), end.alias("end"), match.alias("text"))
        return F.struct(
            start.alias("at"),
            F.when(good, end).otherwise(acc["done"]).alias("done"),
            F.when(good, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"),
        )

    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("done"), F.array().cast(PLACES).alias("out"))
    return F.aggregate(steps, begin, place, lambda acc: acc["out"])


def placed_spans(kind: str, text: Column) -> Column:
    """Confirmed matches of a kind by start; a failing match is not tried again."""
    pattern = PATTERNS[kind][1]
    # One array of (gap, match after it), so that neither is computed again per match.
    steps = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match")
    )

    def place(acc, step):
        start = acc["at"] + F.length(step["gap"])
        end = start + F.coalesce(F.length(step["match"]), F.lit(0))
        span = F.struct(start.alias("start"), end.alias("end"), step["match"].alias("text"))
        good = step["match"].isNotNull() & confirmed(kind, step["match"])
        return F.struct(
            end.alias("at"), F.when(good, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out")
        )

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(PLACES).alias("out"))
    return F.aggregate(steps, begin, place, lambda acc: acc["out"])


def spans_of_kind(kind: str, text: Column) -> Column:
    """Confirmed spans of one kind, by start."""
    hint = PATTERNS[kind][0]
    placed = placed_ibans(text) if kind == "iban" else placed_spans(kind, text)
    scored = F.transform(
        placed,
        lambda s: F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"),
            score(kind, text, s["start"], s["end"]).alias("score"),
        ),
    )
    if kind not in BASE_KINDS:
        scored = F.filter(scored, lambda s: s["score"] >= LEAST_SCORE)
    return F.when(text.rlike(hint), scored.cast(SPANS)).otherwise(F.array().cast(SPANS))


def find(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with the spans of each text, by kind, then start; returns the column's name too."""
    name = fresh(docs, "spans")
    text = F.coalesce(col(text_col), F.lit(""))
    return docs.withColumn(name, F.concat(*[spans_of_kind(kind, text) for kind in KINDS])), name


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, such as ``[EMAIL]``.

    Of overlapping spans the first gives its name; all they cover is removed.
    """
    found, name = find(docs, text_col)
    text = col(text_col)
    in_order = F.sort_array(
        F.transform(col(name), lambda s: F.struct(s["start"], (-s["end"]).alias("minus_end"), s["kind"]))
    )

    def cut(acc, s):
        end = -s["minus_end"]
        fresh_span = s["start"] >= acc["at"]
        piece = F.concat(
            acc["out"], text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")
        )
        return F.struct(
            F.greatest(acc["at"], end).alias("at"), F.when(fresh_span, piece).otherwise(acc["out"]).alias("out")
        )

    clean = F.aggregate(
        in_order,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        cut,
        lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))),
    )
    return found.withColumn(text_col, F.when(F.size(col(name)) > 0, clean).otherwise(text)).drop(name)
