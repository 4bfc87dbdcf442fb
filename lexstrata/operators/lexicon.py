"""Lexicon matching over documents: hits, collisions, longest non-overlapping spans and summaries (LEX-1..4).

All patterns are compiled once per task and run in one Arrow pass over each text, so no document x pattern join is
made; the lexicon is a driver-side list by nature (hundreds of forms). What follows is plain DataFrame work.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HIT = "doc_id long, surface_id string, concept_id string, category string, family string, scope string, start int, end int, text string"


def pattern(form: str, kind: str, language: str) -> str:
    """Regular expression of a surface form: literals escaped, spaces as any white space, whole tokens in Latin script."""
    body = form if kind == "regex" else r"\s+".join(map(re.escape, form.split()))
    return rf"(?<![A-Za-z0-9])(?:{body})(?![A-Za-z0-9])" if language == "en" else f"(?:{body})"


def hits(docs: DataFrame, forms: Sequence[dict]) -> DataFrame:
    """A row for each match of each form; forms: surface_id, concept_id, category, family, scope, form, kind, language."""
    fields = ("surface_id", "concept_id", "category", "family", "scope")
    wanted = [([f[k] for k in fields], pattern(f["form"], f.get("kind", "literal"), f.get("language", "en"))) for f in forms]

    def run(batches):
        compiled = [(v, re.compile(p, re.I)) for v, p in wanted]
        for b in batches:
            rows = [(d, *v, m.start(), m.end(), m.group(0)) for d, t in zip(b["doc_id"], b["text"], strict=True) for v, p in compiled for m in p.finditer(t or "")]
            yield pd.DataFrame(rows, columns=["doc_id", *fields, "start", "end", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, HIT)


def resolved(found: DataFrame) -> DataFrame:
    """One row per exact span and category: concepts of one family are shared, of several families or scopes in conflict (LEX-2)."""
    key = ["doc_id", "start", "end", "category"]
    g = found.groupBy(*key, F.lower("text").alias("text")).agg(F.array_sort(F.collect_set("concept_id")).alias("concepts"), F.count_distinct("family").alias("families"), F.count_distinct("scope").alias("scopes"))
    name = F.array_join("concepts", "|")
    many = F.size("concepts") > 1
    label = F.when(~many, name).when((F.col("families") == 1) & (F.col("scopes") == 1), F.concat(F.lit("SHARED::"), name)).otherwise(F.concat(F.lit("CONFLICT::"), name))
    return g.select(*key, "text", label.alias("concept"))


def longest(spans: DataFrame, blocks: dict[str, str] | None = None) -> DataFrame:
    """Per document and category the longest spans that don't overlap, earlier first among equals; spans of a category in
    `blocks` also bar those of the category it names (LEX-3). One document's spans are one group, bounded by its text."""
    barred = blocks or {}
    order = sorted(set(barred), key=str)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keep, taken = [], {}  # of each category the starts and ends of what is taken, in order and without overlap
        pdf = pdf.assign(size=pdf["end"] - pdf["start"], late=~pdf["category"].isin(order)).sort_values(["late", "size", "start", "concept"], ascending=[True, False, True, True])
        for i, r in zip(pdf.index, pdf.itertuples(), strict=True):
            starts, ends = taken.setdefault(r.category, ([], []))
            at = bisect_left(starts, r.start)
            if (at == 0 or ends[at - 1] <= r.start) and (at == len(starts) or r.end <= starts[at]):
                keep.append(i)
                for c in (r.category, barred.get(r.category)):
                    starts, ends = taken.setdefault(c, ([], []))
                    at = bisect_left(starts, r.start)
                    starts.insert(at, r.start)
                    ends.insert(at, r.end)
        return pdf.loc[keep, ["doc_id", "start", "end", "category", "text", "concept"]]

    return spans.groupBy("doc_id").applyInPandas(run, "doc_id long, start int, end int, category string, text string, concept string")


def summary(spans: DataFrame) -> DataFrame:
    """Per category: spans, distinct concepts, documents (LEX-4)."""
    return spans.groupBy("category").agg(F.count(F.lit(1)).alias("n_spans"), F.count_distinct("concept").alias("n_concepts"), F.count_distinct("doc_id").alias("n_docs"))


def simple_longest(found: DataFrame) -> DataFrame:
    """The older match (LEX-5): hits without token boundaries or collisions, of each category the longest that don't
    overlap, earlier and then lesser ids first; remedies bar doctrines. Hits of `hits` with forms of language `any`."""
    own = found.select("doc_id", "start", "end", "category", "text", F.col("surface_id").alias("concept"))
    return longest(own, {"remedy": "doctrine"})
