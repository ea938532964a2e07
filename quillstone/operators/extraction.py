"""From ranked chunks to a value: document selection, prompt blocks, and a pluggable completer."""

from __future__ import annotations

import json
import re
import urllib.request
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import fixed
from quillstone.functions import text as T

Completer = Callable[[str], str]


def collect_docs(ranked: DataFrame, max_docs: int = fixed.MAX_DOCS) -> DataFrame:
    """The first ``max_docs`` different documents of each case in rank order, from filings of the year or up to two later.

    ``ranked`` has case_id, rank, filing_year, target_year, section, text, aliases, table_row_count.
    """
    rows = ranked.where((F.col("filing_year") - F.col("target_year")).between(0, 2)).withColumn("excerpt", T.value_excerpt(F.col("text"), F.col("aliases")))
    same = Window.partitionBy("case_id", "filing_year", "section", "excerpt").orderBy("rank")
    rows = rows.withColumn("again", F.row_number().over(same)).where("again = 1").drop("again")
    rows = rows.withColumn("doc_rank", F.row_number().over(Window.partitionBy("case_id").orderBy("rank"))).where(F.col("doc_rank") <= max_docs)
    return rows.withColumn("year_index", F.col("filing_year") - F.col("target_year")).withColumn("table_row_count", F.coalesce("table_row_count", F.lit(1)))


def serialize_docs(docs: DataFrame) -> DataFrame:
    """Rank and fields of each document for output; the full text falls back to the excerpt."""
    full = F.coalesce(F.nullif("text", F.lit("")), "excerpt", F.lit(""))
    return docs.select("case_id", F.col("doc_rank").alias("rank"), "filing_year", "section", "table_row_count", "year_index", "excerpt", full.alias("full_text"))


def doc_blocks(docs: DataFrame) -> DataFrame:
    """The prompt's document part: a block for each document, in rank order."""
    line = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(F.col(c).cast("string"), F.lit("None")))
    block = F.concat_ws("\n", F.concat(F.lit("Document "), F.col("doc_rank").cast("string")), line("Filing year", "filing_year"), line("Section", "section"), line("Table row count", "table_row_count"), F.concat(F.lit("Full text:\n"), F.col("text")))
    blocks = docs.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("doc_rank", block.alias("block")))).alias("b"))
    return blocks.select("case_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n---\n\n").alias("documents"))


def extraction_prompt(documents: str, target: str, year: int, aliases: list[str]) -> str:
    """What a completer is asked; the fiscal year is the one before the filing's."""
    return (
        f"Report the value of '{target}' for {year - 1}, also named {', '.join(aliases[:8])}, from the documents below and nothing else. "
        'Answer with JSON alone: {"value": ..., "supporting_docs": [...]}, null and [] if it is not there. '
        "Amounts are in millions; parentheses mean negative; columns run from the latest year back; a full year goes before a quarter; "
        "where documents disagree the majority counts, else the first.\n\n" + documents
    )


def offline_completer(prompt: str) -> str:
    """A deterministic stand-in: the first number after an alias in each document; the majority, else the first."""
    head, _, documents = prompt.partition("\n\n")
    named = re.search(r"also named (.*?), from the documents", head, re.DOTALL)
    aliases, found = (named[1].split(", ") if named else []), []
    for n, doc in enumerate(documents.split("\n\n---\n\n"), 1):
        for line in doc.splitlines():
            at = next((line.lower().find(a.lower()) + len(a) for a in aliases if a and a.lower() in line.lower()), -1)
            number = re.search(r"-?\(?\$?\d[\d,]*\.?\d*\)?", line[at:]) if at >= 0 else None
            if number:
                found.append((number[0], n))
                break
    if not found:
        return '{"value": null, "supporting_docs": []}'
    value = Counter(v for v, _ in found).most_common(1)[0][0]
    return f'{{"value": "{value}", "supporting_docs": {[n for v, n in found if v == value]}}}'


def plan_prompt(display_name: str, query: str, year: int) -> str:
    """What a completer is asked for a retrieval plan."""
    return (
        f"Which words help to find '{display_name}' ({query}) in an annual report filed in {year}? Answer with JSON alone: "
        '{"locate_terms": [...], "table_terms": [...], "constraint_terms": [...]}: sections that hold it, names of its table rows, what narrows it down.'
    )


def no_plan(prompt: str) -> str:
    """The completer without a service: an empty plan."""
    return "{}"


def query_plans(cases: DataFrame, completer: Completer = no_plan) -> DataFrame:
    """(case_id, locate_terms, table_terms, constraint_terms) of cases (case_id, display_name, query, year).

    Terms are normalised and different, eight of a kind at most. An answer that is no JSON object gives an empty plan.
    """
    def complete(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"case_id": pdf["case_id"], "answer": [completer(plan_prompt(n, q, int(y))) for n, q, y in zip(pdf["display_name"], pdf["query"], pdf["year"])]})

    asked = cases.select("case_id", "display_name", "query", "year").mapInPandas(complete, "case_id string, answer string")
    kinds = ("locate_terms", "table_terms", "constraint_terms")
    parsed = asked.withColumn("p", F.from_json(T.unfence(F.col("answer")), ", ".join(f"{k} array<string>" for k in kinds)))
    clean = lambda k: F.filter(F.transform(F.coalesce(F.col(f"p.{k}"), F.array().cast("array<string>")), T.normalize_alias), lambda t: t != "")
    return parsed.select("case_id", *[F.slice(F.array_distinct(clean(k)), 1, fixed.PLAN_TERMS).alias(k) for k in kinds])


def http_completer(url: str, model: str, key: str, timeout: float = 60) -> Completer:
    """A completer over an HTTP service with the common chat-completion interface; nothing is sent unless it is used."""
    def complete(prompt: str) -> str:
        body = json.dumps({"model": model, "temperature": 0, "messages": [{"role": "user", "content": prompt}]}).encode()
        asked = urllib.request.Request(url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
        with urllib.request.urlopen(asked, timeout=timeout) as answer:
            return json.load(answer)["choices"][0]["message"]["content"]

    return complete


def extract_values(cases: DataFrame, completer: Completer = offline_completer) -> DataFrame:
    """Adds raw_response, value and supporting_docs to cases (case_id, documents, target, year, aliases).

    The completer runs once a case, in the executors; errors propagate.
    """
    schema = "case_id string, raw_response string"

    def complete(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            answers = [completer(extraction_prompt(d, t, int(y), list(a))) for d, t, y, a in zip(pdf["documents"], pdf["target"], pdf["year"], pdf["aliases"])]
            yield pd.DataFrame({"case_id": pdf["case_id"], "raw_response": answers})

    asked = cases.select("case_id", "documents", "target", "year", "aliases").mapInPandas(complete, schema)
    parsed = asked.withColumn("parsed", T.parse_json_answer(F.col("raw_response")))
    value = T.strip(F.coalesce("parsed.value", F.lit("")))
    none = F.coalesce(F.size("parsed.supporting_docs"), F.lit(0)) <= 0
    shown = F.when(F.col("parsed").isNull(), F.when(T.empty_answer(F.col("raw_response")), "N/A").otherwise(T.strip(F.col("raw_response"))))
    shown = shown.when((value == "") & none, "N/A").when(value == "", T.strip(F.col("raw_response"))).otherwise(value)
    return parsed.select("case_id", "raw_response", shown.alias("value"), F.coalesce("parsed.supporting_docs", F.array().cast("array<int>")).alias("supporting_docs"))
