"""Text functions as Column expressions; every one stays in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split sees it: Java's own class lacks the separators 1c-1f.
_SPACE = r"(?U)[\s\x1c-\x1f]+"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def squeeze(x: Column | str) -> Column:
    """Runs of any white space as one space, none at the ends; null as empty (STR-1)."""
    return F.btrim(F.regexp_replace(F.coalesce(col(x), F.lit("")), _SPACE, " "))


def paragraphs(x: Column | str) -> Column:
    """White space squeezed within lines, three or more line ends as two (STR-2)."""
    y = F.regexp_replace(F.coalesce(col(x), F.lit("")), "\r\n?", "\n")
    y = F.regexp_replace(y, "[ \t ]+", " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(y, " ?\n ?", "\n"), "\n{3,}", "\n\n"))


def grounding_form(x: Column | str) -> Column:
    """What grounding compares: squeezed and lower-cased (STR-3)."""
    return F.lower(squeeze(x))


def sha(x: Column | str, length: int = 64) -> Column:
    """Leading hex digits of SHA-256 (STR-4)."""
    return F.substring(F.sha2(F.coalesce(col(x), F.lit("")).cast("binary"), 256), 1, length)


def stable_id(prefix: str, *parts: Column | str, length: int = 18) -> Column:
    """prefix_ and leading hex digits of SHA-256 of the parts joined by the unit separator (DED-1); nulls as `None`."""
    joined = F.concat_ws("\x1f", *[F.coalesce(col(p).cast("string"), F.lit("None")) for p in parts])
    return F.concat(F.lit(prefix + "_"), sha(joined, length))


def normal_hash(x: Column | str) -> Column:
    """Hash of a text's words alone: anything but letters and digits counts as a space (DED-10)."""
    return sha(F.btrim(F.regexp_replace(F.lower(F.coalesce(col(x), F.lit(""))), r"(?U)[\W_]+", " ")))


def hits(x: Column | str, pattern: str, most: int = 12) -> Column:
    """Distinct matches in order of first appearance, at most `most` (STR-14)."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.coalesce(col(x), F.lit("")), F.lit(pattern), F.lit(0))), 1, most)


def tokens(x: Column | str, pattern: str = r"[가-힣]+|[A-Za-z]+|[0-9]+(?:[.,][0-9]+)*|§") -> Column:
    """Mixed-script tokens (STR-6)."""
    return F.regexp_extract_all(F.coalesce(col(x), F.lit("")), F.lit(pattern), F.lit(0))


def sentences(x: Column | str, least: int = 15) -> Column:
    """Sentences of at least `least` characters, squeezed (STR-7)."""
    parts = F.split(F.coalesce(col(x), F.lit("")), r"(?<=[.!?。])\s+|\n+|(?<=다\.)\s*")
    return F.filter(F.transform(parts, squeeze), lambda s: F.length(s) >= least)


def excerpt(x: Column | str, most: int) -> Column:
    """Whole sentences while they fit, else the first `most` characters (STR-9)."""
    y = squeeze(x)
    head = F.substring(y, 1, most)
    whole = F.regexp_extract(head, r"^(.*[.!?])(?:\s|$)", 1)
    return F.when(F.length(y) <= most, y).when(whole != "", whole).otherwise(head)


def section(x: Column | str, heading: str) -> Column:
    """Text from a heading's end to the next heading of the same level, squeezed (STR-10)."""
    return squeeze(F.regexp_extract(F.coalesce(col(x), F.lit("")), rf"(?ms)^{heading}\s*$(.*?)(?=^## |\z)", 1))


def replaced(x: Column | str, pairs: Sequence[tuple[str, str]]) -> Column:
    """Patterns replaced one after another, in their order (STR-11, STR-12, STR-13, STR-24)."""
    y = F.coalesce(col(x), F.lit(""))
    for pattern, by in pairs:
        y = F.regexp_replace(y, pattern, by)
    return y


def context(x: Column | str, pattern: str, radius: int) -> Column:
    """Characters around the first match, null without one (STR-15)."""
    at = F.regexp_instr(col(x), F.lit(pattern))
    width = F.length(F.regexp_extract(col(x), f"({pattern})", 1))
    begin = F.greatest(at - radius, F.lit(1))
    return F.when(at > 0, F.substring(col(x), begin, at - begin + width + radius))


def term_count(x: Column | str, terms: Sequence[str]) -> Column:
    """Occurrences of any of the terms, each counted by itself (STR-16)."""
    y = F.coalesce(col(x), F.lit(""))
    counts = [((F.length(y) - F.length(F.replace(y, F.lit(t), F.lit("")))) / len(t)).cast("long") for t in terms]
    return sum(counts[1:], counts[0])


def shingles(words: Column, n: int) -> Column:
    """Hashes of all runs of n words (STR-17). The runs are n shifted arrays side by side, so the words are hashed n
    times in all and not once a run."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    count = F.greatest(F.size(words) - (n - 1), F.lit(0))
    side = F.arrays_zip(*[F.slice(hashes, k + 1, count).alias(f"w{k}") for k in range(n)])
    return F.transform(side, lambda r: F.xxhash64(*[r[f"w{k}"] for k in range(n)]))


def script_ratio(x: Column | str) -> Column:
    """Share of Hangul among Hangul and Latin letters, null without letters (STR-19)."""
    hangul, latin = F.regexp_count(col(x), F.lit("[가-힣]")), F.regexp_count(col(x), F.lit("[A-Za-z]"))
    return F.when(hangul + latin > 0, hangul / (hangul + latin))


def slug(x: Column | str) -> Column:
    """Lower case, other runs as one hyphen (STR-21)."""
    return F.btrim(F.regexp_replace(F.lower(col(x)), "[^a-z0-9가-힣]+", "-"), F.lit("-"))


def alpha_suffix(n: Column | str) -> Column:
    """A..Z, AA.. for 1, 2, ..: letters as digits without a zero, last one first (STR-22)."""
    start = F.struct(F.coalesce(col(n).cast("long"), F.lit(0).cast("long")).alias("left"), F.lit("").alias("mark"))

    def step(a: Column, _: Column) -> Column:
        letter = F.when(a["left"] > 0, F.char((a["left"] - 1) % 26 + 65)).otherwise("")
        return F.struct(F.greatest(F.floor((a["left"] - 1) / 26), F.lit(0)).cast("long").alias("left"), F.concat(letter, a["mark"]).alias("mark"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(13)), start, step, lambda a: a["mark"])


def replace_exact(x: Column | str, old: str, new: str, times: int) -> Column:
    """x with old replaced, an error unless it occurs `times` times (PRJ-13)."""
    found = ((F.length(col(x)) - F.length(F.replace(col(x), F.lit(old), F.lit("")))) / len(old)).cast("int")
    return F.when(found == times, F.replace(col(x), F.lit(old), F.lit(new))).otherwise(F.raise_error(F.concat(F.lit(f"wanted {times} of the text, found "), found.cast("string"))))


def incident_fingerprint(x: Column | str, date: Column | str, kind: Column | str) -> Column:
    """Hash of the words around an incident's date with the date and kind; null without the date or with too little
    around it (DED-8). The date is looked for as yyyy-mm-dd, then `yyyy. mm. dd.`, then `yyyy.mm.dd`."""
    t, d = F.coalesce(col(x), F.lit("")), col(date)
    forms = [d, F.concat(F.replace(d, F.lit("-"), F.lit(". ")), F.lit(".")), F.replace(d, F.lit("-"), F.lit("."))]
    places = [F.call_function("instr", t, f) for f in forms]
    at = F.coalesce(*[F.when(p > 0, p) for p in places])
    begin = F.greatest(at - 100, F.lit(1))
    near = squeeze(F.substring(t, begin, at + 320 - begin))
    return F.when(F.length(near) >= 100, sha(F.concat_ws("|", d, F.coalesce(col(kind), F.lit("")), near), 20))
