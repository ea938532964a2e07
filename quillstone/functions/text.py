"""Scalar text functions as column expressions.

White space is ASCII white space unless said otherwise; ``strip`` removes it on both sides like Python's, other
than SQL's ``trim``, which only removes spaces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions import fixed

WHITE = " \t\n\x0b\f\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once; keeps expressions that use a long one often small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITE))


def blank(c: Column) -> Column:
    """Nothing but white space, or null."""
    return ~F.coalesce(c.rlike(r"\S"), F.lit(False))


def tokens(c: Column) -> Column:
    """Words between white space; no empty ones."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def no_break_to_space(c: Column) -> Column:
    return F.replace(c, F.lit(chr(0xA0)), F.lit(" "))


def preprocess_line(line: Column) -> Column:
    """Separates a closing from an opening parenthesis, and a letter from the number that follows it."""
    return F.regexp_replace(F.regexp_replace(line, fixed.CLOSE_OPEN, ") $1"), fixed.LETTER_NUMBER, "$1 $2")


def parse_num(s: Column) -> Column:
    """Number of a cell without ``$`` and commas; parentheses mean negative; null if it is none."""
    def number(bare: Column) -> Column:
        inner = strip(F.substring(bare, F.lit(2), F.length(bare) - 2))
        negative = F.when(inner.rlike(f"^{fixed.NEGATIVE_CELL}$"), -inner.try_cast("double"))
        return F.when(bare.rlike(r"(?s)^\(.*\)$"), negative).otherwise(bare.try_cast("double"))

    return let(strip(F.regexp_replace(s, r"[$,]", "")), number)


def normalize_value(s: Column) -> Column:
    """As ``parse_num``, but parentheses are stripped wherever they stand at the ends."""
    def number(bare: Column) -> Column:
        value = F.regexp_replace(bare, r"^[()]+|[()]+$", "").try_cast("double")
        return F.when(bare.rlike(r"(?s)^\(.*\)$"), -value).otherwise(value)

    return let(strip(F.regexp_replace(s, r"[$,]", "")), number)


def float_text(v: Column) -> Column:
    """A double as Python prints it, for values without fraction; null prints ``None``."""
    mantissa = F.regexp_replace(F.split_part(v.cast("string"), F.lit("E"), F.lit(1)), r"\.0$", "")
    large = F.concat(mantissa, F.lit("e+"), F.split_part(v.cast("string"), F.lit("E"), F.lit(2)))
    plain = F.concat(v.cast("decimal(38,0)").cast("string"), F.lit(".0"))
    text = F.when(F.abs(v) >= 1e16, large).when(v == F.floor(v), plain).otherwise(v.cast("string"))
    return F.coalesce(text, F.lit("None"))


def parse_financial_table(line: Column) -> Column:
    """``label | value | value[ | value]`` of a table line, else the preprocessed line."""
    def row(ready: Column) -> Column:
        part = lambda k: F.regexp_extract(ready, fixed.TABLE_LINE, k)
        cells = [F.when(part(k) != "", let(parse_num(part(k)), float_text)) for k in (2, 3, 4)]
        shown = F.concat(strip(part(1)), F.lit(" | "), F.concat_ws(" | ", *cells))
        return F.when(ready.rlike(fixed.TABLE_LINE), shown).otherwise(strip(ready))

    return let(preprocess_line(strip(line)), row)


def render_lines(lines: Column) -> Column:
    """Text of an array of (line, label): table rows reformatted, runs of blank lines made one, ends stripped."""
    shown = F.transform(lines, lambda x: rstrip(F.replace(F.when(x["label"] == "table_row", parse_financial_table(x["line"])).otherwise(x["line"]), F.lit("\t"), F.lit("    "))))
    return strip(F.regexp_replace(F.array_join(shown, "\n"), "\n{3,}", "\n\n"))


def context_compact(*parts: Column) -> Column:
    return F.concat_ws(" - ", *[F.nullif(p, F.lit("")) for p in parts])


def truncate_words(c: Column, most: int = 20) -> Column:
    return F.array_join(F.slice(tokens(F.coalesce(c, F.lit(""))), 1, most), " ")


def is_title(line: Column) -> Column:
    """All capitals or title case with at most 8 words, or a short capitalised line that ends with a colon."""
    s = strip(line)
    few = F.size(tokens(s)) <= 8
    capitals = (F.upper(s) == s) & (F.lower(s) != s)
    title = s.rlike(r"\p{Lu}") & ~s.rlike(r"(^|[^\p{L}])\p{Ll}") & ~s.rlike(r"\p{L}\p{Lu}")
    colon = s.rlike(r"^[A-Z][a-zA-Z\s]+:$") & (F.length(s) < 60)
    return (F.length(s) >= 4) & ((few & (capitals | title)) | colon)


def footer_meta(line: Column) -> Column:
    """page_number, form_label and the three section names of a footer line; null where it says nothing."""
    s = strip(line)
    page = F.regexp_extract(s, fixed.PAGE_NUMBER, 1).try_cast("int")
    section = lambda k: F.nullif(strip(F.regexp_extract(s, fixed.FOOTER_SECTION, k)), F.lit(""))
    sections = F.when(s.rlike(fixed.FOOTER_SECTION), F.struct(section(1).alias("section"), section(2).alias("subsection"), section(3).alias("subsubsection")))
    return F.struct(page.alias("page_number"), F.when(s.rlike(fixed.FORM_LABEL), s).alias("form_label"), sections.alias("sections"))


def header_str(page: Column, *parts: Column) -> Column:
    shown = F.when(page != 0, F.concat(F.lit("Page "), page.cast("string")))
    return F.concat_ws(" | ", shown, *[F.nullif(p, F.lit("")) for p in parts])


def table_row(line: Column) -> Column:
    """(is_row, label, values) by the simple row pattern: a label of 3 to 60 characters and two or three numbers."""
    s = strip(no_break_to_space(line))
    hit = s.rlike(fixed.TABLE_ROW)
    part = lambda k: F.regexp_extract(s, fixed.TABLE_ROW, k)
    values = F.filter(F.array(part(2), part(3), part(4)), lambda v: v != "")
    return F.struct(hit.alias("is_row"), F.when(hit, F.lower(strip(part(1)))).alias("label"), F.when(hit, values).alias("values"))


def numbers_of(s: Column) -> Column:
    """All numbers of a text; one without a digit is not searched."""
    return F.when(s.rlike("[0-9]"), F.regexp_extract_all(s, F.lit(f"({fixed.NUMBER})"), F.lit(1))).when(s.isNotNull(), F.array().cast("array<string>"))


def rule_type(line: Column) -> Column:
    """Type of a line by an ordered list of rules: table_row, single_value, narrative, header, year_header, other."""
    keyword = lambda s: let(F.lower(s), lambda low: F.exists(F.array(*map(F.lit, fixed.FINANCIAL_KEYWORDS)), lambda w: F.contains(low, w)))

    def odd(s: Column, numbers: Column) -> Column:
        """A label that no table row has, or a small percentage as first value."""
        def unlike(label: Column) -> Column:
            digits, letters = F.regexp_count(label, F.lit(r"\d")), F.regexp_count(label, F.lit(r"\p{L}"))
            return (label == "") | ~label.rlike(r"^\p{L}") | (letters == 0) | (digits > 0.3 * F.length(label))

        label = strip(F.regexp_replace(strip(F.regexp_extract(s, f"(?s)^(.*?){fixed.NUMBER}", 1)), r"[$:]+$", ""))
        small_percent = F.coalesce(F.abs(normalize_value(F.get(numbers, F.lit(0)))) < 1, F.lit(False)) & s.contains("%")
        return let(label, unlike) | small_percent

    def kind(s: Column, numbers: Column) -> Column:
        count, short = F.size(numbers), F.length(s) < 60
        years = F.size(F.regexp_extract_all(s, F.lit(fixed.YEAR), F.lit(1)))
        return (
            F.when(s == "", "other")
            .when(short & (count > 0) & (years >= 2) & ~s.rlike("[a-zA-Z]{4,}"), "year_header")
            .when(short & (count == 0) & s.rlike(fixed.HEADER_WORDS), "header")
            .when(count >= 2, F.when(odd(s, numbers), "narrative").otherwise("table_row"))
            .when(count == 1, F.when(s.rlike(fixed.NARRATIVE_WORDS), "narrative").otherwise("single_value"))
            .when(keyword(s), "narrative")
            .otherwise("other")
        )

    clean = strip(F.replace(no_break_to_space(line), F.lit("TABLE | "), F.lit("")))
    return let(clean, lambda s: let(numbers_of(s), lambda numbers: kind(s, numbers)))


def parse_any_line(line: Column) -> Column:
    """(type, label, values, years, mentions, original) of a line: what its type by the rules has, null else.

    Rows and single values have a label, what stands before the first number, and values; year headers have years;
    narrative lines have mentions.
    """
    def parsed(s: Column, kind: Column) -> Column:
        valued, numbers = kind.isin("table_row", "single_value"), F.regexp_extract_all(s, F.lit(f"({fixed.NUMBER})"), F.lit(1))
        label = strip(F.regexp_replace(strip(F.regexp_extract(s, f"(?s)^(.*?){fixed.NUMBER}", 1)), r"[$:]+$", ""))
        years = F.transform(F.regexp_extract_all(s, F.lit(fixed.YEAR), F.lit(1)), lambda y: y.cast("int"))
        return F.struct(
            kind.alias("type"),
            F.when(valued, label).alias("label"),
            F.when(valued, F.transform(numbers, normalize_value)).alias("values"),
            F.when(kind == "year_header", years).alias("years"),
            F.when(kind == "narrative", mentions(s)).alias("mentions"),
            s.alias("original"),
        )

    clean = strip(F.replace(no_break_to_space(line), F.lit("TABLE | "), F.lit("")))
    return let(F.struct(clean.alias("s"), rule_type(line).alias("kind")), lambda x: parsed(x["s"], x["kind"]))


def rule_label(kind: Column, page_number: Column) -> Column:
    """Label of a line from its rule type; ``page_number`` tells lines that are lone page numbers."""
    label = let(kind, lambda k: F.when(k == "table_row", "table_row").when(k.isin("header", "year_header"), "footer").otherwise("narrative"))
    return F.when(page_number, "footer").otherwise(label)


def mentions(line: Column) -> Column:
    """Array of (label, value, year, raw): amounts that prose names; billions count as thousands of millions.

    A mention is in billions if ``billion`` or a final ``B`` stands in it or in the ten characters after it, which are
    looked at from the mention's own place.
    """
    pattern = F.lit(f"({fixed.MENTION.replace('(?i)', '(?i:')}))(?=((?s:.{{0,10}})))")

    def one(m: Column, rest: Column) -> Column:
        label, amount, year = (F.regexp_extract(m, fixed.MENTION, k) for k in (1, 2, 3))
        after = F.concat(m, rest)
        value = normalize_value(amount)
        return F.struct(strip(F.lower(label)).alias("label"), F.when(after.rlike(r"(?i)billion|B\b") & (value != 0), value * 1000).otherwise(value).alias("value"), year.try_cast("int").alias("year"), m.alias("raw"))

    return F.zip_with(F.regexp_extract_all(line, pattern, F.lit(1)), F.regexp_extract_all(line, pattern, F.lit(5)), one)


def normalize_alias(alias: Column) -> Column:
    squeezed = F.regexp_replace(no_break_to_space(strip(F.coalesce(alias, F.lit("")))), r"\s+", " ")
    return F.btrim(squeezed, F.lit(" .,:;|\"'"))


def compact_terms(terms: Column, most: int) -> Column:
    """Normalised terms without years and long phrases, the first ``most`` different ones."""
    clean = F.transform(F.coalesce(terms, F.array().cast("array<string>")), normalize_alias)
    good = F.filter(clean, lambda t: (t != "") & ~t.rlike(r"\b(?:19|20)\d{2}\b") & (F.size(tokens(t)) <= 6))
    return F.slice(F.array_distinct(good), 1, most)


def build_queries(aliases: Column, base_query: Column, locate: Column, table: Column, constraint: Column) -> Column:
    """(bm25_query, embedding_query) of a variable from its aliases and plan terms."""
    own = compact_terms(aliases, 6)
    everything = F.array_distinct(F.concat(own, *[compact_terms(t, 3) for t in (locate, table, constraint)]))
    bm25 = F.when(F.size(own) > 0, F.array_join(own, " ")).otherwise(F.array_join(F.slice(tokens(base_query), 1, 6), " "))
    embedding = F.array_join(F.slice(everything, 1, 7), " ")
    return F.struct(bm25.alias("bm25_query"), F.when(embedding == "", fixed.FALLBACK_QUERY).otherwise(embedding).alias("embedding_query"))


def hybrid_text(text: Column, *parts: Column) -> Column:
    """Non-empty parts on lines of their own, else the text."""
    return F.coalesce(F.nullif(F.concat_ws("\n", *[F.nullif(strip(p), F.lit("")) for p in parts]), F.lit("")), text)


def normalize_answer(variable: Column, value: Column) -> Column:
    plain = F.replace(strip(F.coalesce(value, F.lit(""))), F.lit('"'), F.lit(""))
    return F.when(variable == "sp_rating", F.upper(plain)).otherwise(plain)


def parse_amount(value: Column) -> Column:
    """First number of a text; a comma before three digits separates thousands. Negative in parentheses or after ``-``."""
    def amount(s: Column) -> Column:
        number = F.replace(F.regexp_extract(s, r"(\d+(?:,\d{3})*(?:\.\d+)?)", 1), F.lit(","), F.lit("")).try_cast("double")
        return F.when((s.contains("(") & s.contains(")")) | s.startswith("-"), -F.abs(number)).otherwise(number)

    return let(strip(F.coalesce(value.cast("string"), F.lit(""))), amount)


def values_match(prediction: Column, truth: Column) -> Column:
    distance = F.abs(parse_amount(prediction) - parse_amount(truth))
    return F.coalesce(distance <= fixed.NUMERIC_TOLERANCE, prediction == truth)


def excerpt_around(lines: Column, at: Column, radius: int = fixed.EXCERPT_RADIUS, most: int = fixed.EXCERPT_CHARS) -> Column:
    """The lines of an array within ``radius`` of place ``at``, stripped, at most ``most`` characters."""
    start = F.greatest(at - radius, F.lit(0))
    return F.left(strip(F.array_join(F.slice(lines, start + 1, at + radius + 1 - start), "\n")), F.lit(most))


def excerpt_display(text: Column) -> Column:
    """A text as a list shows it: on one line, cut."""
    return F.left(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" ")), F.lit(fixed.SHOWN_CHARS))


def value_excerpt(text: Column, aliases: Column) -> Column:
    """Lines around the first that holds a table mark and an alias, else an alias, else a table mark; else the start."""
    split = F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0B\x0C\x85\u2028\u2029]")

    def kinds(x: Column, names: Column) -> Column:
        return let(F.lower(x), lambda low: F.struct(low.contains("table_row").alias("mark"), F.exists(names, lambda a: F.contains(low, a)).alias("alias")))

    def first(of: Column, test: Callable[[Column], Column]) -> Column:
        return F.nullif(F.array_position(F.transform(of, lambda k: F.coalesce(test(k), F.lit(False))), F.lit(True)), F.lit(0)).cast("int") - 1

    def place(of: Column) -> Column:
        return F.coalesce(first(of, lambda k: k["mark"] & k["alias"]), first(of, lambda k: k["alias"]), first(of, lambda k: k["mark"]))

    def excerpt(lines: Column) -> Column:
        at = let(let(aliases, lambda names: F.transform(lines, lambda x: kinds(x, names))), place)
        found = let(at, lambda i: F.when(i.isNotNull(), excerpt_around(lines, i)).otherwise(F.left(text, F.lit(fixed.EXCERPT_CHARS))))
        return F.when(F.size(lines) > 0, found).otherwise(F.lit(""))

    # Lines, aliases, kinds and place are evaluated once each: the whole is linear in the text.
    return let(F.filter(split, lambda x: x.rlike(r"\S")), excerpt)


def unfence(c: Column) -> Column:
    """Without a code fence."""
    s = strip(c)
    return F.when(s.startswith("```"), strip(F.regexp_replace(F.regexp_replace(s, "^`+|`+$", ""), "^json", ""))).otherwise(s)


def malformed_json(c: Column) -> Column:
    """(value, supporting_docs) of an almost-JSON answer, lower-cased; null if it names no value."""
    s = F.lower(strip(c))
    pattern = r"""[\{,]\s*"?value"?\s*:\s*(["']?)([^,\}]+?)\1\s*[,\}]"""
    value = F.regexp_replace(strip(F.regexp_extract(s, pattern, 2)), "^[\"']+|[\"']+$", "")
    listed = F.split(F.regexp_extract(s, r"""[\{,]\s*"?supporting_docs"?\s*:\s*\[([^\]]*)\]""", 1), ",")
    docs = F.transform(F.filter(listed, lambda d: strip(d).rlike(r"^\d+$")), lambda d: strip(d).cast("int"))
    return F.when(s.rlike(pattern), F.struct(F.when((value != "") & (value != "null"), value).alias("value"), docs.alias("supporting_docs")))


def parse_json_answer(c: Column) -> Column:
    """(value, supporting_docs) of an answer: JSON, fenced JSON or almost JSON."""
    clean = unfence(c)
    parsed = F.from_json(clean, "value string, supporting_docs array<int>")
    good = F.is_valid_json(clean) if hasattr(F, "is_valid_json") else F.try_parse_json(clean).isNotNull()
    return F.when(good & parsed.isNotNull(), parsed).otherwise(malformed_json(c))


def empty_answer(c: Column) -> Column:
    s = unfence(F.lower(c))
    return s.rlike(r'\bvalue\b\s*:\s*(?:,|$|\}|null|"")') & s.rlike(r"\bsupporting_docs\b\s*:\s*\[\s*\]")


def context_line(c: Column) -> Column:
    s = strip(F.coalesce(c, F.lit("")))
    return F.when(s == "", "<BLK>").when(F.length(s) > fixed.MAX_LINE_CHARS, "<LONG>").otherwise(s)
