"""Personal data by patterns, checksums and context, in built-in functions only.

Patterns propose spans from left to right without overlap within a kind; validators
confirm them (Luhn for cards, mod 97 for IBANs, ranges for addresses, digit counts for
phones); words of context close before or after raise a span's score.  The base kinds
``email ip card phone`` are reported whenever they validate; the added kinds ``iban``
and ``ssn`` when their score reaches ``THRESHOLD``.  A match that fails is dropped and
not tried again shorter.

``find(docs)`` adds ``spans_found``: array of (start, kind_no, end, kind, score), sorted
by start, then kind.  Offsets are code points, the end exclusive.  A null or empty text
has none.  ``redact`` puts ``<KIND>`` for each span.  Repeated rows stay repeated; other
columns are untouched, except that a column ``spans_found`` is replaced.

Spans come from splitting the text at the matches, so each text is scanned twice a kind
at most, and only texts that hold the kind's characters at all are scanned.  The
patterns are written so that no text makes them run in squared time: repeats that
cannot give way do not backtrack, and a run of letters is tried from its start only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

THRESHOLD = 0.5
BEFORE, AFTER = 40, 20

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]

# The length of an IBAN by country.
IBAN_LENGTHS = {
    15: ("NO",), 16: ("BE",), 18: ("DK", "FI", "FK", "FO", "GL", "NL"), 19: ("MK", "SI"), 20: ("AT", "BA", "EE", "KZ", "LT", "LU", "MN", "XK"),
    21: ("CH", "HR", "LI", "LV"), 22: ("BG", "BH", "CR", "DE", "GB", "GE", "IE", "ME", "RS", "VA"), 23: ("AE", "GI", "IL", "IQ", "OM", "SO", "TL"),
    24: ("AD", "CZ", "ES", "MD", "PK", "RO", "SA", "SE", "SK", "TN", "VG"), 25: ("LY", "PT", "ST"), 26: ("IS", "TR"),
    27: ("BI", "DJ", "FR", "GR", "IT", "MC", "MR", "SM"), 28: ("AL", "AZ", "BY", "CY", "DO", "GT", "HU", "LB", "NI", "PL", "SV"),
    29: ("BR", "EG", "PS", "QA", "UA"), 30: ("JO", "KW", "MU", "YE"), 31: ("MT", "SC"), 32: ("LC",), 33: ("RU",),
}
_IBAN = "|".join(f"(?:{'|'.join(codes)})[0-9]{{2}}(?: ?[A-Z0-9]){{{size - 4}}}" for size, codes in IBAN_LENGTHS.items())

# What each kind looks like, which character it cannot do without, words that speak for it, and its score without them.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?:{_IBAN})(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
CONTEXT = {
    "email": "e-?mail|mail|contact|courriel|correo",
    "ip": r"\bip\b|address|host|server|adresse|servidor",
    "card": "card|visa|mastercard|amex|carte|karte|tarjeta|credit|debit|payment",
    "phone": "phone|tel|call|mobile|fax|cell|handy|m[oó]vil",
    "iban": "iban|account|konto|compte|cuenta|bank|transfer",
    "ssn": "ssn|social|security",
}
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _mod97(hit: Column) -> Column:
    plain = F.replace(hit, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 34), F.substring(plain, 1, 4))
    step = lambda left, c: F.when(c.between("0", "9"), (left * 10 + F.ascii(c) - 48) % 97).otherwise((left * 100 + F.ascii(c) - 55) % 97)
    return F.length(plain).between(15, 34) & (F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1)


VALID = {
    "email": lambda hit: F.lit(True),
    "ip": lambda hit: hit.rlike(rf"^{PART}(?:\.{PART}){{3}}$"),
    "card": lambda hit: F.length(_digits(hit)).between(14, 19) & F.call_function("luhn_check", _digits(hit)),
    "phone": lambda hit: F.length(_digits(hit)).between(10, 15),
    "iban": _mod97,
    "ssn": lambda hit: ~hit.rlike("^(?:000|666|9)|-00-|-0000$"),
}


def _spans(kind: str, text: Column, hits: Column) -> Column:
    """Validated spans of one kind with their scores, from the matches and what lies between them."""
    number, gaps = KINDS.index(kind), F.split(text, PATTERNS[kind], -1)
    empty = F.array().cast("array<struct<start:int,kind_no:int,end:int,kind:string,score:double>>")

    def place(done: Column, one: Column) -> Column:
        hit = one["hit"]
        start = done["at"] + F.length(one["before"])
        end = start + F.length(hit)
        near = F.lower(F.concat_ws(" ", F.right(one["before"], F.lit(BEFORE)), F.left(one["after"], F.lit(AFTER)))).rlike(CONTEXT[kind])
        score = F.round(F.least(F.lit(1.0), F.lit(SCORES[kind]) + F.when(near, 0.3).otherwise(0.0)), 2)
        span = F.struct(start.alias("start"), F.lit(number).alias("kind_no"), end.alias("end"), F.lit(kind).alias("kind"), score.alias("score"))
        good = VALID[kind](hit) if kind in BASE else VALID[kind](hit) & (score >= THRESHOLD)
        return F.struct(end.alias("at"), F.when(good, F.array_append(done["spans"], span)).otherwise(done["spans"]).alias("spans"))

    # Each match with the text on either side, as the array walked over, so that it is made once and not per match.
    matches = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("before"), hits.alias("hit"), F.slice(gaps, 2, F.size(hits)).alias("after"))
    walked = F.aggregate(matches, F.struct(F.lit(0).alias("at"), empty.alias("spans")), place, lambda done: done["spans"])
    return F.when(F.size(hits) > 0, walked).otherwise(empty)


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    digit = body.rlike("[0-9]")
    holds = {"email": F.contains(body, F.lit("@")), "ip": digit, "card": digit, "phone": F.contains(body, F.lit("+")), "iban": digit, "ssn": digit}
    none = F.array().cast("array<string>")
    fresh = "_hits"
    while fresh in {c.lower() for c in docs.columns}:
        fresh += "_"
    hits = docs.withColumn(fresh, F.struct(*[F.when(holds[k], F.regexp_extract_all(body, F.lit(PATTERNS[k]), F.lit(0))).otherwise(none).alias(k) for k in KINDS]))
    found = F.array_sort(F.concat(*[_spans(k, body, F.col(fresh)[k]) for k in KINDS]))
    return hits.withColumn("spans_found", found).drop(fresh)


def written(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``find`` and the text with ``<KIND>`` in place of each span; of overlapping spans the first stays."""
    found = find(docs, text)
    size = F.length(text)

    def step(done: Column, s: Column) -> Column:
        piece = F.concat(done["out"], F.substring(F.col(text), done["at"] + 1, s["start"] - done["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        free = s["start"] >= done["at"]
        return F.struct(F.when(free, s["end"]).otherwise(done["at"]).alias("at"), F.when(free, piece).otherwise(done["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("spans_found", start, step, lambda d: F.concat(d["out"], F.substring(F.col(text), d["at"] + 1, size)))
    return found.withColumn(text, F.when(F.size("spans_found") > 0, clean).otherwise(F.col(text)))
