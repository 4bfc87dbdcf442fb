"""Personal data by regular expressions, checksum validators and context words, in DataFrame functions only.

Each kind's pattern proposes leftmost, non-overlapping spans; a validator (parts of at most 255, Luhn over 16 to 19
digits, 8 to 15 digits) confirms them. The base kinds email, ip, card and phone need no more. Two further kinds are
scored: `iban` (0.3, plus 0.6 as its remainder modulo 97 is 1; the longest of all possible ends for which it is) and `secret` (0.4 for a hexadecimal run of 32 or more);
a word of the kind's list within CONTEXT characters before the span adds 0.3, and spans of 0.7 or more count.

Patterns are written with possessive runs, and start only where a run starts or the last match ended, so a very long
run costs time in proportion to its length and no recursion. Positions are code points; they are the running sums of
the lengths of the parts between matches and of the matches.

Edge cases: null text counts as empty (no spans); ids may repeat or be null; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read, whole

CONTEXT, THRESHOLD, CHUNK = 40, 0.7, 64
_EMAIL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_EMAIL})){_EMAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})",  # the head; accounts() finds the end
    "secret": r"(?<![A-Za-z0-9])[0-9a-f]{32,}+(?![A-Za-z0-9])",
}
BASE = ("email", "ip", "card", "phone")
WORDS = {"iban": r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b", "secret": r"(?i)\b(?:token|key|secret|password|passwd|api)\b"}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_ACCOUNT = r"^[A-Z]{2}[0-9]{2}[A-Z0-9]*+(?:\x20[A-Z0-9]{2,}+)*(?:\x20[A-Z0-9]{1,4})?$"
SPAN = "array<struct<start:int,end:int,value:string>>"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether the digits of x pass Luhn; every second digit from the right counts double, less nine if over nine."""
    back = F.reverse(digits(x))
    n = F.length(back)

    def weight(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    total = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda a, i: a + weight(i))
    return F.coalesce((n > 0) & (total % 10 == 0), F.lit(False))


def mod97(x: Column) -> Column:
    """Whether an account number's check digits hold: letters as numbers, first four characters last, remainder 1."""
    flat = F.regexp_replace(x, " ", "")
    moved = F.concat(F.substring(flat, 5, 64), F.substring(flat, 1, 4))

    def step(a: Column, c: Column) -> Column:
        v = F.ascii(c)
        return F.when(v >= 65, (a * 100 + v - 55) % 97).otherwise((a * 10 + v - 48) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c))) == 1


def accounts(text: Column, heads: Column) -> Column:
    """Spans of account numbers from the spans of their first four characters: of all ends that leave 15 to 34 letters
    and digits, in groups of two or more and a last one of one to four, the farthest with valid check digits. What starts
    inside an account is left out."""

    def seen(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), F.substring(text, s["start"] + 1, F.lit(64)).alias("window"))

    def longest(s: Column) -> Column:
        window = s["window"]

        def ends(n: Column) -> Column:
            v = F.substring(window, F.lit(1), n)
            free = (n <= F.length(window)) & ~F.substring(window, n + 1, F.lit(1)).rlike("[A-Za-z0-9]")
            return free & v.rlike(_ACCOUNT) & F.length(F.regexp_replace(v, " ", "")).between(15, 34) & mod97(v)

        end = F.get(F.filter(F.sequence(F.lit(63), F.lit(15), F.lit(-1)), ends), F.lit(0))
        return F.struct(s["start"].alias("start"), window.alias("window"), end.alias("end"))

    def span(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), (s["start"] + s["end"]).alias("end"), F.substring(s["window"], F.lit(1), s["end"]).alias("value"))

    def step(a: Column, s: Column) -> Column:
        return F.when(s["start"] >= F.coalesce(F.try_element_at(a, F.lit(-1))["end"], F.lit(0)), F.concat(a, F.array(s))).otherwise(a)

    found = F.filter(F.transform(F.transform(heads, seen), longest), lambda s: s["end"].isNotNull())
    found = F.transform(found, span).cast(SPAN)
    return F.aggregate(found, F.array().cast(SPAN), step)


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
    "card": lambda v: F.length(digits(v)).between(16, 19) & luhn(v),
    "phone": lambda v: F.length(digits(v)).between(8, 15),
}


def score(kind: str, text: Column, span: Column) -> Column:
    """Base score of a further kind, with what its checksum and the words before it add."""
    before = F.substring(text, F.greatest(span["start"] + 1 - CONTEXT, F.lit(1)), F.least(span["start"], F.lit(CONTEXT)))
    near = F.when(before.rlike(WORDS[kind]), 0.3).otherwise(0.0)
    own = F.lit(0.3) + F.when(mod97(span["value"]), 0.6).otherwise(0.0) if kind == "iban" else F.lit(0.4)
    return own + near


def matches(pairs: Column) -> Column:
    """Spans from pairs of the part before a match and the match. Places run on within CHUNK pairs and then over the
    chunks, so a text of very many matches is not copied once a match."""
    none = F.array().cast(SPAN)

    def step(a: Column, p: Column) -> Column:
        begin = a["at"] + F.length(p["gap"])
        end = begin + F.length(p["match"])
        span = F.struct(begin.alias("start"), end.alias("end"), p["match"].alias("value"))
        return F.struct(end.alias("at"), F.concat(a["spans"], F.array(span)).alias("spans"))

    def chunk(c: Column) -> Column:
        return F.aggregate(F.slice(pairs, c * CHUNK + 1, F.lit(CHUNK)), F.struct(F.lit(0).alias("at"), none.alias("spans")), step)

    def joined(a: Column, c: Column) -> Column:
        moved = F.transform(c["spans"], lambda s: F.struct((s["start"] + a["at"]).alias("start"), (s["end"] + a["at"]).alias("end"), s["value"].alias("value")))
        return F.struct((a["at"] + c["at"]).alias("at"), F.concat(a["done"], F.array(moved)).alias("done"))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / CHUNK).cast("int")), chunk)
    return F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("done")), joined, lambda a: F.flatten(a["done"]))


def confirmed(kind: str):
    """A predicate on spans of a kind."""
    if kind in BASE:
        return lambda s: VALID[kind](s["value"])
    return lambda s: score(kind, F.col("text"), s) >= THRESHOLD


def label(kind: str):
    return lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))


def tagged(kind: str):
    return lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.lit(kind).alias("kind"))


def find(docs: DataFrame) -> DataFrame:
    """docs with a column of spans (start, end, value) for each kind of PATTERNS, of the whole text."""
    kinds = list(PATTERNS)
    out = docs.withColumn("text", whole("text"))
    out = out.withColumns({f"gaps_{k}": F.split("text", p, -1) for k, p in PATTERNS.items()})
    paired = lambda k, p: F.arrays_zip(F.slice(f"gaps_{k}", F.lit(1), F.size(f"gaps_{k}") - 1).alias("gap"), F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias("match"))
    out = out.withColumns({f"pairs_{k}": F.when(F.size(f"gaps_{k}") > 1, paired(k, p)) for k, p in PATTERNS.items()})
    spans = {}
    for k in kinds:
        found = F.when(F.size(f"gaps_{k}") > 1, matches(F.col(f"pairs_{k}"))).otherwise(F.array().cast(SPAN))
        spans[k] = F.filter(accounts(F.col("text"), found) if k == "iban" else found, confirmed(k))
    return out.withColumns(spans).drop(*[f"{x}_{k}" for k in kinds for x in ("gaps", "pairs")])


def named(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans, comma-joined, kinds as listed and by start in each."""
    return F.array_join(F.concat(*[F.transform(k, label(k)) for k in kinds]), ",")


def report(docs: DataFrame) -> DataFrame:
    found = find(docs.select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(named(BASE).cast("binary"), 256).alias("base_sha256"),
        named(tuple(PATTERNS)).alias("spans"),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS if k not in BASE],
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span's text replaced by its kind in brackets and n_chars counted anew; null texts stay null."""
    kept = docs.withColumns({"__null": F.col("text").isNull(), "__row": F.struct(*docs.columns)}).select("__null", "__row", "text")
    found = find(kept)
    spans = F.array_sort(F.concat(*[F.transform(k, tagged(k)) for k in PATTERNS]))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(a: Column, s: Column) -> Column:
        part = F.array(F.substring("text", a["at"] + 1, s["start"] - a["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        taken = F.struct((-s["back"]).alias("at"), F.concat(a["parts"], part).alias("parts"))
        return F.when(s["start"] >= a["at"], taken).otherwise(a)

    def chunk(a: Column, c: Column) -> Column:
        # a string for each chunk, so that many spans are not copied once a span
        done = F.aggregate(F.slice("__spans", c * CHUNK + 1, F.lit(CHUNK)), F.struct(a["at"].alias("at"), F.array().cast("array<string>").alias("parts")), step)
        return F.struct(done["at"].alias("at"), F.concat(a["parts"], F.array(F.array_join(done["parts"], ""))).alias("parts"))

    chunks = F.sequence(F.lit(0), F.floor((F.size("__spans") - 1) / CHUNK).cast("int"))
    text = F.aggregate(chunks, first, chunk, lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    out = found.withColumn("__spans", spans).withColumn("__text", F.when(~F.col("__null"), F.when(F.size("__spans") > 0, text).otherwise(F.col("text"))))
    new = {"text": F.col("__text"), "n_chars": F.length("__text").cast("long")}
    return out.select(*[new.get(c, F.col("__row")[c]).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return report(read(spark, sf_dir, "documents"))
