"""The registered queries in DuckDB's SQL, over the same tables. Composed from small expressions of one argument."""

from __future__ import annotations

from quillstone.functions import fixed
from quillstone.plans import inputs
from quillstone.plans.queries import ANSWERS

SQL: dict[str, str] = {}


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def sub(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(by)}, 'g')"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def part(x: str, pattern: str, k: int) -> str:
    return f"regexp_extract({x}, {q(pattern)}, {k})"


def strip(x: str) -> str:
    return sub(x, r"^\s+|\s+$")


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


def plain(x: str) -> str:
    return f"replace({x}, chr(160), ' ')"


def num(x: str) -> str:
    return f"TRY_CAST({x} AS DOUBLE)"


def preprocess(x: str) -> str:
    return sub(sub(x, r"\)\s*(\$?\()", r") \1"), r"([a-zA-Z])\s*(\$?\(?\d)", r"\1 \2")


def parse_num(x: str) -> str:
    bare = strip(sub(x, "[$,]"))
    inner = strip(f"substr({bare}, 2, len({bare}) - 2)")
    return f"CASE WHEN {has(bare, r'(?s)^\(.*\)$')} THEN CASE WHEN {has(inner, r'^-?[\d.]+$')} THEN -{num(inner)} END ELSE {num(bare)} END"


def normalize_value(x: str) -> str:
    bare = strip(sub(x, "[$,]"))
    value = num(sub(bare, r"^[()]+|[()]+$"))
    return f"CASE WHEN {has(bare, r'(?s)^\(.*\)$')} THEN -({value}) ELSE {value} END"


def float_text(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'None' ELSE concat(CAST(CAST({x} AS DECIMAL(38,0)) AS VARCHAR), '.0') END"


def table_text(x: str) -> str:
    ready = preprocess(strip(x))
    cell = lambda k: f"CASE WHEN {part(ready, fixed.TABLE_LINE, k)} <> '' THEN {float_text('(' + parse_num(part(ready, fixed.TABLE_LINE, k)) + ')')} END"
    row = f"concat({strip(part(ready, fixed.TABLE_LINE, 1))}, ' | ', concat_ws(' | ', {cell(2)}, {cell(3)}, {cell(4)}))"
    return f"CASE WHEN {has(ready, fixed.TABLE_LINE)} THEN {row} ELSE {strip(ready)} END"


def is_title(x: str) -> str:
    s = strip(x)
    few = f"len({tokens(s)}) <= 8"
    capitals = f"(upper({s}) = {s} AND lower({s}) <> {s})"
    title = f"({has(s, r'\p{Lu}')} AND NOT {has(s, r'(^|[^\p{L}])\p{Ll}')} AND NOT {has(s, r'\p{L}\p{Lu}')})"
    colon = f"({has(s, r'^[A-Z][a-zA-Z\s]+:$')} AND len({s}) < 60)"
    return f"(len({s}) >= 4 AND (({few} AND ({capitals} OR {title})) OR {colon}))"


def rule_type(x: str) -> str:
    s = strip(f"replace({plain(x)}, 'TABLE | ', '')")
    numbers = f"regexp_extract_all({s}, {q(fixed.NUMBER)})"
    label = strip(sub(strip(part(s, f"(?s)^(.*?){fixed.NUMBER}", 1)), r"[$:]+$"))
    first = normalize_value(f"{numbers}[1]")
    count = lambda pattern: f"len(regexp_extract_all({label}, {q(pattern)}))"
    letter = r"\p{L}"
    odd = f"({label} = '' OR NOT {has(label, '^' + letter)} OR {count(letter)} = 0 OR {count(r'\d')} > 0.3::DOUBLE * len({label}) OR coalesce(abs({first}) < 1 AND contains({s}, '%'), false))"
    words = " OR ".join(f"contains(lower({s}), {q(w)})" for w in fixed.FINANCIAL_KEYWORDS)
    return f"""CASE WHEN {s} = '' THEN 'other'
      WHEN len(regexp_extract_all({s}, {q(fixed.YEAR)})) >= 2 AND len({s}) < 60 AND NOT {has(s, '[a-zA-Z]{4,}')} THEN 'year_header'
      WHEN len({s}) < 60 AND len({numbers}) = 0 AND {has(s, fixed.HEADER_WORDS)} THEN 'header'
      WHEN len({numbers}) >= 2 THEN CASE WHEN {odd} THEN 'narrative' ELSE 'table_row' END
      WHEN len({numbers}) = 1 THEN CASE WHEN {has(s, fixed.NARRATIVE_WORDS)} THEN 'narrative' ELSE 'single_value' END
      WHEN {words} THEN 'narrative' ELSE 'other' END"""


def alias(x: str) -> str:
    return f"trim({sub(plain(strip('coalesce(' + x + ', ' + q('') + ')')), r'\s+', ' ')}, ' .,:;|\"''')"


def amount(x: str) -> str:
    s = strip(f"coalesce({x}, '')")
    number = num(f"replace({part(s, r'(\d+(?:,\d{3})*(?:\.\d+)?)', 1)}, ',', '')")
    return f"CASE WHEN (contains({s}, '(') AND contains({s}, ')')) OR starts_with({s}, '-') THEN -abs({number}) ELSE {number} END"


def truncate(x: str, n: int) -> str:
    return f"array_to_string(({tokens('coalesce(' + x + ', ' + q('') + ')')})[1:{n}], ' ')"


def context_line(x: str) -> str:
    s = strip(f"coalesce({x}, '')")
    return f"CASE WHEN {s} = '' THEN '<BLK>' WHEN len({s}) > {fixed.MAX_LINE_CHARS} THEN '<LONG>' ELSE {s} END"


def of_lines(name: str, expression: str) -> None:
    SQL[name] = f"SELECT id, {expression} AS result FROM ({inputs.LINES})"


of_lines("preprocess_line", preprocess("line"))
of_lines("parse_financial_table", table_text("line"))
of_lines("is_title", is_title("line"))
of_lines("truncate_words", truncate("line", 3))
of_lines("classify_rule_based", rule_type("line"))
of_lines("normalize_alias", alias("line"))
of_lines("eval_parse_numeric", f"round({amount('line')}, 6)")
of_lines("context_line", context_line("line"))

SQL["parse_num"] = f"SELECT id, {parse_num('cell')} AS result FROM (SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN concat('$', {inputs.A}) WHEN 1 THEN concat('(', {inputs.B}, ')') WHEN 2 THEN '$' WHEN 3 THEN '(1 2)' WHEN 4 THEN concat('-', {inputs.A}, '.5') WHEN 5 THEN NULL ELSE o_orderpriority END AS cell FROM orders)"
SQL["normalize_value"] = f"SELECT id, {normalize_value('cell')} AS result FROM (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN concat('$(', {inputs.A}, ')') WHEN 1 THEN concat('(', {inputs.B}) WHEN 2 THEN '' WHEN 3 THEN concat('$-', {inputs.C}) WHEN 4 THEN concat({inputs.A}, 'B') ELSE concat('(', {inputs.A}, '.25)') END AS cell FROM orders)"


def footer(x: str) -> dict[str, str]:
    s = strip(x)
    section = lambda k: f"nullif({strip(part(s, fixed.FOOTER_SECTION, k))}, '')"
    return {"page_number": f"TRY_CAST({part(s, fixed.PAGE_NUMBER, 1)} AS INTEGER)", "form_label": f"CASE WHEN {has(s, fixed.FORM_LABEL)} THEN {s} END", "section": section(1), "subsection": section(2), "subsubsection": section(3)}


SQL["footer_meta"] = "SELECT id, " + ", ".join(f"{e} AS {n}" for n, e in footer("line").items()) + f" FROM ({inputs.LINES})"

ROW = strip(plain("line"))
SQL["is_table_row"] = f"""SELECT id, {has(ROW, fixed.TABLE_ROW)} AS is_row, CASE WHEN {has(ROW, fixed.TABLE_ROW)} THEN lower({strip(part(ROW, fixed.TABLE_ROW, 1))}) END AS label,
  CASE WHEN {has(ROW, fixed.TABLE_ROW)} THEN array_to_string(list_filter([{part(ROW, fixed.TABLE_ROW, 2)}, {part(ROW, fixed.TABLE_ROW, 3)}, {part(ROW, fixed.TABLE_ROW, 4)}], lambda v: v <> ''), ';') END AS values FROM ({inputs.LINES})"""

MENTION = fixed.MENTION
SQL["inline_mentions"] = f"""WITH m AS (SELECT id, line, unnest(regexp_extract_all(line, {q(MENTION)})) AS m FROM ({inputs.LINES})),
v AS (SELECT *, {normalize_value(part('m', MENTION, 2))} AS v, substr(line, instr(line, m), len(m) + 10) AS near FROM m)
SELECT id, {strip('lower(' + part('m', MENTION, 1) + ')')} AS label, CASE WHEN {has('near', r'(?i)billion|B\b')} AND v <> 0 THEN v * 1000 ELSE v END AS value,
  TRY_CAST({part('m', MENTION, 3)} AS INTEGER) AS year FROM v"""

CLEAN_LINE = strip(f"replace({plain('line')}, 'TABLE | ', '')")
LABEL = strip(sub(strip(part("s", f"(?s)^(.*?){fixed.NUMBER}", 1)), r"[$:]+$"))
SQL["parse_any_line"] = f"""WITH t AS (SELECT id, {CLEAN_LINE} AS s, {rule_type('line')} AS type FROM ({inputs.LINES}))
SELECT id, type, CASE WHEN type IN ('table_row', 'single_value') THEN {LABEL} END AS label,
  CASE WHEN type IN ('table_row', 'single_value') THEN array_to_string(list_transform(regexp_extract_all(s, {q(fixed.NUMBER)}), lambda v: coalesce(printf('%.2f', {normalize_value('v')}), 'None')), ';') END AS values,
  CASE WHEN type = 'year_header' THEN array_to_string(regexp_extract_all(s, {q(fixed.YEAR)}), ';') END AS years,
  CASE WHEN type = 'narrative' THEN CAST(len(regexp_extract_all(s, {q(fixed.MENTION)})) AS INTEGER) END AS n_mentions, s AS original FROM t"""

CHUNKS = f"""SELECT doc_id, text, {inputs.YEAR} AS year, source AS section, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 7 AS INTEGER) END AS table_row_count,
  CASE WHEN doc_id % 4 = 0 THEN 'table_main' WHEN doc_id % 4 = 1 THEN 'narrative_main' END AS chunk_nature,
  CASE WHEN doc_id % 5 = 0 THEN concat(' summary ', source, ' ') END AS summary, CASE WHEN doc_id % 2 = 0 THEN lang END AS page_context,
  CASE WHEN doc_id % 6 = 0 THEN '' ELSE source END AS page_section FROM documents"""
ID = "concat_ws('_', CAST(year AS VARCHAR), section, CAST(doc_id AS VARCHAR))"
HYBRID = f"coalesce(nullif(concat_ws(chr(10), nullif({strip('summary')}, ''), nullif({strip('page_context')}, ''), nullif({strip('page_section')}, '')), ''), text)"

SQL["scan_skip_latest"] = "SELECT o_orderkey, CAST(filing_date AS VARCHAR) AS filing_date, CAST(nth - 1 AS INTEGER) AS nth FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS filing_date, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey) AS nth FROM orders) WHERE nth BETWEEN 2 AND 26"
SQL["scan_sections"] = f"SELECT doc_id, lower(upper(source)) AS source, CAST(len({strip('text')}) AS INTEGER) AS chars FROM documents WHERE {strip('text')} <> ''"
SQL["scan_index"] = f"SELECT {ID} AS id, year, section, coalesce(table_row_count, 0) AS table_row_count, coalesce(chunk_nature, '') AS chunk_nature, coalesce(summary, '') AS summary, 0 AS page_number, coalesce(page_context, '') AS page_context, coalesce(page_section, '') AS page_section, md5({HYBRID}) AS hybrid_md5 FROM ({CHUNKS})"
SQL["index_upsert_skip"] = f"SELECT {ID} AS id, year FROM ({CHUNKS}) WHERE NOT (year = 2021 OR section = 'src3')"
SQL["read_ground_truth"] = f"SELECT CAST(o_orderkey AS VARCHAR) AS year, {inputs.A} AS total_revenues, concat('-', {inputs.B}) AS underwriting_income, o_orderstatus AS sp_rating FROM orders"
SQL["read_labeled"] = "SELECT CASE doc_id % 4 WHEN 0 THEN 'table_row' WHEN 1 THEN 'narrative' ELSE 'footer' END AS label, concat(source, ', \"', lang, '\"') AS line FROM documents WHERE doc_id % 4 <> 2"
SQL["context_compact"] = f"SELECT doc_id, concat_ws(' - ', nullif(page_context, ''), nullif(page_section, '')) AS result FROM ({CHUNKS})"
SQL["header_str"] = f"SELECT doc_id, concat_ws(' | ', CASE WHEN table_row_count <> 0 THEN concat('Page ', CAST(table_row_count AS VARCHAR)) END, nullif(page_context, ''), nullif(page_section, ''), nullif(summary, '')) AS result FROM ({CHUNKS})"
SQL["hybrid_text"] = f"SELECT doc_id, md5({HYBRID}) AS result FROM ({CHUNKS})"
SQL["doc_id"] = f"SELECT doc_id, concat_ws('_', CAST(year AS VARCHAR), section, CAST(row_number() OVER (PARTITION BY year, section ORDER BY doc_id) - 1 AS VARCHAR)) AS id FROM ({CHUNKS})"
SQL["available_years"] = f"SELECT CAST(unnest(range(lo - 2, hi + 1)) AS INTEGER) AS year FROM (SELECT max(year) AS hi, min(year) AS lo FROM ({CHUNKS}))"
SQL["scope_filter"] = f"SELECT doc_id, year FROM ({CHUNKS}) WHERE year = 2022"
SQL["year_window"] = f"SELECT doc_id, CAST(year - 2021 AS INTEGER) AS year_index FROM ({CHUNKS}) WHERE year - 2021 BETWEEN 0 AND 2"

VARIABLES = "(VALUES " + ", ".join(f"({k}, {q(n)}, [{', '.join(map(q, a))}], {q(t)})" for k, (n, _, a, t) in enumerate(fixed.VARIABLES)) + ") v(no, variable, aliases, template)"
SQL["variable_lookup"] = f"SELECT o_orderkey, variable, array_to_string(aliases, ';') AS aliases FROM orders JOIN {VARIABLES} ON no = o_orderkey % 4"


def compact(x: str, n: int) -> str:
    clean = f"list_transform({x}, lambda t: {alias('t')})"
    good = f"list_filter({clean}, lambda t: t <> '' AND NOT {has('t', r'\b(?:19|20)\d{2}\b')} AND len({tokens('t')}) <= 6)"
    return f"({distinct(good)})[1:{n}]"


def distinct(x: str) -> str:
    """Different elements in order of first occurrence."""
    return f"list_filter({x}, lambda t, i: list_position({x}, t) = i)"


W = tokens("text")
PHRASES = "regexp_split_to_array(coalesce(text, ''), '[.,;:\n]')"


def compacted(named: dict[str, tuple[str, int]], rows: str, keep: str) -> str:
    """CTEs that end in ``terms``: the columns of ``rows`` that are kept, and under each name the first so many compact terms of a list."""
    clean = ", ".join(f"list_transform(coalesce({x}, []), lambda t: {alias('t')}) AS {n}" for n, (x, _) in named.items())
    good = ", ".join(f"list_filter({n}, lambda t: t <> '' AND NOT {has('t', r'\b(?:19|20)\d{2}\b')} AND len({tokens('t')}) <= 6) AS {n}" for n in named)
    first = ", ".join(f"(list_filter(good.{n}, lambda v, i: list_position(good.{n}, v) = i))[1:{k}] AS {n}" for n, (_, k) in named.items())
    return f"clean AS (SELECT {keep}, {clean} FROM {rows}), good AS (SELECT {keep}, {good} FROM clean), terms AS (SELECT {keep}, {first} FROM good)"


SQL["compact_terms"] = f"WITH {compacted({'said': (PHRASES, 3)}, 'documents', 'doc_id')} SELECT doc_id, array_to_string(said, ';') AS result FROM terms"
SQL["build_queries"] = f"""WITH {compacted({'own': (f"CASE WHEN doc_id % 3 > 0 THEN {PHRASES} END", 6), 'a': ('[source, lang]', 3), 'b': (f"string_split(coalesce(text, ''), chr(10))", 3), 'c': ("['in ' || source, 'balance']", 3)}, 'documents', 'doc_id, text')},
e AS (SELECT doc_id, text, own, own || a || b || c AS every FROM terms),
u AS (SELECT *, array_to_string((list_filter(every, lambda v, i: list_position(every, v) = i))[1:7], ' ') AS said FROM e)
SELECT doc_id, CASE WHEN len(own) > 0 THEN array_to_string(own, ' ') ELSE array_to_string(({tokens("coalesce(text, '')")})[1:6], ' ') END AS bm25_query, md5(CASE WHEN said = '' THEN {q(fixed.FALLBACK_QUERY)} ELSE said END) AS embedding_md5 FROM u"""
SQL["query_plan_terms"] = f"WITH d AS (SELECT doc_id, list_filter(list_transform({W}, lambda t: {alias('t')}), lambda t: t <> '') AS c FROM documents) SELECT doc_id, array_to_string((list_filter(c, lambda t, i: list_position(c, t) = i))[1:8], ';') AS terms FROM d"

# Lines of sections.
SECTION_LINES = f"""sections AS ({inputs.SECTIONS_DUCKDB}),
raw AS (SELECT section_id, unnest(string_split({plain('text')}, chr(10))) AS line, generate_subscripts(string_split({plain('text')}, chr(10)), 1) - 1 AS line_no FROM sections),
near AS (SELECT *, lag(line) OVER w AS before, lead(line) OVER w AS after FROM raw WINDOW w AS (PARTITION BY section_id ORDER BY line_no)),
paged AS (SELECT section_id, line_no, line, {has(strip('line'), r'^\d{1,3}$')} AND {strip("coalesce(before, '')")} = '' AND {strip("coalesce(after, '')")} = '' AS lone FROM near),
typed AS (SELECT *, {rule_type('line')} AS kind FROM paged WHERE {strip('line')} <> ''),
labelled AS (SELECT section_id, line_no, line, CASE WHEN lone THEN 'footer' WHEN kind = 'table_row' THEN 'table_row' WHEN kind IN ('header', 'year_header') THEN 'footer' ELSE 'narrative' END AS label FROM typed)"""
SQL["page_number_lines"] = f"WITH {SECTION_LINES} SELECT section_id, CAST(line_no AS INTEGER) AS line_no, line FROM paged WHERE lone"
META = footer("line")
CONTEXT = f"""meta AS (SELECT *, {', '.join(f"CASE WHEN label = 'footer' THEN {e} END AS {n}" for n, e in META.items())}, CASE WHEN label = 'footer' AND {has(strip('line'), fixed.FOOTER_SECTION)} THEN line_no END AS said FROM labelled),
run AS (SELECT *, first_value(page_number IGNORE NULLS) OVER w AS p, first_value(form_label IGNORE NULLS) OVER w AS f, last_value(said IGNORE NULLS) OVER w AS s FROM meta WINDOW w AS (PARTITION BY section_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
context AS (SELECT r.section_id, CAST(r.line_no AS INTEGER) AS line_no, r.label, r.p AS page_number, r.f AS form_label, m.section AS page_section, m.subsection AS page_subsection, m.subsubsection AS page_subsubsection, {is_title('r.line')} AS is_title
FROM run r LEFT JOIN meta m ON m.section_id = r.section_id AND m.line_no = r.s)"""
SQL["page_context"] = f"WITH {SECTION_LINES}, {CONTEXT} SELECT * FROM context"
SQL["stream_page_context"] = SQL["page_context"]
PSEUDO = "pseudo AS (SELECT raw.section_id, raw.line_no, raw.line, CASE WHEN " + strip("raw.line") + " = '' THEN 'blank' ELSE coalesce(labelled.label, 'narrative') END AS label FROM raw LEFT JOIN labelled USING (section_id, line_no))"
SQL["pseudo_label"] = f"WITH {SECTION_LINES}, {PSEUDO} SELECT section_id, CAST(line_no AS INTEGER) AS line_no, label FROM pseudo"
SQL["label_counts"] = f"WITH {SECTION_LINES}, {PSEUDO} SELECT label, count(*) AS n FROM pseudo GROUP BY label"
SQL["context_windows"] = f"""WITH {SECTION_LINES}, {PSEUDO}, c AS (SELECT *, {context_line('line')} AS c FROM pseudo),
w AS (SELECT *, concat_ws(chr(10), lag(c, 2, '<BLK>') OVER w, lag(c, 1, '<BLK>') OVER w) AS prev_text, concat_ws(chr(10), lead(c, 1, '<BLK>') OVER w, lead(c, 2, '<BLK>') OVER w) AS next_text FROM c WINDOW w AS (PARTITION BY section_id ORDER BY line_no))
SELECT section_id, CAST(line_no AS INTEGER) AS line_no, prev_text, c AS current_line, next_text, label FROM w WHERE label <> 'blank'"""
SQL["chunk_islands"] = """WITH s AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT DISTINCT FROM role THEN 0 ELSE 1 END AS s FROM conversations),
i AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS island FROM s)
SELECT conv_id, CAST(island AS BIGINT) AS island, role, count(*) AS lines, min(turn) AS first_turn FROM i GROUP BY conv_id, island, role"""
ISLANDS = """kinds AS (SELECT *, CASE WHEN label = 'table_row' THEN 'table' ELSE 'narrative' END AS kind FROM labelled WHERE label <> 'footer'),
started AS (SELECT *, CASE WHEN lag(kind) OVER w IS NOT DISTINCT FROM kind THEN 0 ELSE 1 END AS s, lag(line) OVER w AS before, lag(kind) OVER w AS previous FROM kinds WINDOW w AS (PARTITION BY section_id ORDER BY line_no)),
island AS (SELECT *, CAST(sum(s) OVER (PARTITION BY section_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM started)"""
SHOWN = sub(f"replace(CASE WHEN label = 'table_row' THEN {table_text('line')} ELSE line END, chr(9), '    ')", r"\s+$")
JOINED = sub(f"string_agg({SHOWN}, chr(10) ORDER BY line_no)", "\n{3,}", "\n\n")
SQL["render_lines"] = f"WITH {SECTION_LINES}, {ISLANDS} SELECT section_id, island, {strip(JOINED)} AS text FROM island GROUP BY section_id, island"
SQL["chunk_nature"] = f"""WITH {SECTION_LINES}, {ISLANDS}, c AS (SELECT section_id, count(*) FILTER (WHERE label = 'table_row') AS t, count(*) FILTER (WHERE label = 'narrative') AS n FROM island GROUP BY section_id)
SELECT section_id, t AS table_rows, n AS narrative, CASE WHEN t >= 10 OR t > n THEN 'table' ELSE 'narrative' END AS chunk_type, CASE WHEN t > n THEN 'table_main' ELSE 'narrative_main' END AS chunk_nature FROM c"""
CHUNK_CHARS, OVERLAP_CHARS = 400, 80
RENDERED = lambda x: strip(sub(x, "\n{3,}", "\n\n"))
WITHIN = lambda a, limit: f"len(list_filter({a}, lambda v: v <= {limit}))"
BELOW = lambda a, limit: f"len(list_filter({a}, lambda v: v < {limit}))"
SHOWN_TAIL = sub(f"replace(CASE WHEN was_table THEN {table_text('tail')} ELSE tail END, chr(9), '    ')", r"\s+$")
ORDERED = lambda x: f"list({x} ORDER BY line_no)"
#: Splitting, merging and overlap: pieces by recursion over their starts, merged runs by a running sum, overlap by recursion over chunks.
SQL["chunk_overlap"] = f"""WITH RECURSIVE {SECTION_LINES}, {ISLANDS}, {CONTEXT},
l AS (SELECT i.section_id, i.island, i.line_no, i.line, i.label, {SHOWN.replace("line END", "i.line END")} AS shown, greatest(len({strip('i.line')}), 1) + 1 AS cost, c.is_title, c.page_number, c.page_section, c.page_subsection, c.page_subsubsection FROM island i JOIN (SELECT section_id, line_no, is_title, page_number, page_section, page_subsection, page_subsubsection FROM context) c USING (section_id, line_no)),
sums AS (SELECT *, CAST(sum(cost) OVER (PARTITION BY section_id, island ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM l),
isles AS (SELECT section_id, island, string_agg(shown, chr(10) ORDER BY line_no) AS raw, {ORDERED('shown')} AS shown, {ORDERED('label')} AS labels, {ORDERED('e')} AS es, {ORDERED('e - cost')} AS bs,
  coalesce({ORDERED('line')} FILTER (WHERE label = 'narrative'), []) AS said, ({ORDERED('line')} FILTER (WHERE is_title))[1] AS title, ({ORDERED('page_number')})[1] AS page_number, ({ORDERED('page_section')})[1] AS a, ({ORDERED('page_subsection')})[1] AS b, ({ORDERED('page_subsubsection')})[1] AS c FROM sums GROUP BY section_id, island),
whole AS (SELECT *, len({RENDERED('raw')}) > {CHUNK_CHARS} AS split, CASE WHEN labels[1] = 'table_row' THEN said[greatest(len(said) - 4, 1):] ELSE said[1:5] END AS told FROM isles WHERE {RENDERED('raw')} <> ''),
cores AS (SELECT section_id, island, 1 AS s, CASE WHEN split THEN greatest({WITHIN('es', f'bs[1] + {CHUNK_CHARS}')}, 1) ELSE len(es) END AS t FROM whole
  UNION ALL SELECT section_id, island, cores.t + 1, greatest({WITHIN('es', f'bs[cores.t + 1] + {CHUNK_CHARS}')}, cores.t + 1) FROM cores JOIN whole USING (section_id, island) WHERE cores.t < len(es)),
wide AS (SELECT whole.*, s, t, {BELOW('bs', f'bs[s] - {fixed.SPLIT_OVERLAP_CHARS}')} + 1 AS f0, {WITHIN('es', f'es[t] + {fixed.SPLIT_OVERLAP_CHARS}')} AS l0 FROM cores JOIN whole USING (section_id, island)),
back AS (SELECT *, least(l0, greatest(t, {WITHIN('es', f'bs[f0] + {CHUNK_CHARS}')})) AS l1 FROM wide),
front AS (SELECT *, least(s, greatest(f0, {BELOW('bs', f'es[l1] - {CHUNK_CHARS}')} + 1)) AS f1 FROM back),
cut AS (SELECT *, CASE WHEN split THEN f1 ELSE 1 END AS f, CASE WHEN split THEN greatest(f1, least(l1, {WITHIN('es', f'bs[f1] + {CHUNK_CHARS}')})) ELSE len(es) END AS z FROM front),
parts AS (SELECT section_id, island, s, split, title, told, page_number, a, b, c, array_to_string(shown[f:z], chr(10)) AS raw, len(list_filter(labels[f:z], lambda x: x = 'table_row')) AS rows, len(list_filter(labels[f:z], lambda x: x = 'narrative')) AS prose FROM cut),
joins AS (SELECT *, CASE WHEN len({RENDERED('raw')}) <= {fixed.SMALL_CHUNK_CHARS} AND NOT split AND NOT lag(split, 1, true) OVER (PARTITION BY section_id ORDER BY island, s) THEN 0 ELSE 1 END AS begins FROM parts),
runs AS (SELECT *, CAST(sum(begins) OVER (PARTITION BY section_id ORDER BY island, s ROWS UNBOUNDED PRECEDING) AS INTEGER) AS chunk FROM joins),
g AS (SELECT section_id, chunk, string_agg(raw, chr(10) ORDER BY island, s) AS raw, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(prose) AS BIGINT) AS prose, bool_or(split) AS split, (list(title ORDER BY island, s) FILTER (WHERE title IS NOT NULL))[1] AS title, flatten(list(told ORDER BY island, s)) AS told,
  (list(page_number ORDER BY island, s))[1] AS page_number, (list(a ORDER BY island, s))[1] AS a, (list(b ORDER BY island, s))[1] AS b, (list(c ORDER BY island, s))[1] AS c FROM runs GROUP BY section_id, chunk),
o AS (SELECT section_id, chunk, {RENDERED('raw')} AS text, rows, prose FROM g WHERE chunk = 1
  UNION ALL SELECT section_id, chunk, CASE WHEN widened THEN {RENDERED(f"concat({SHOWN_TAIL}, chr(10), raw)")} ELSE plain END, rows + CAST(widened AND was_table AS BIGINT), prose + CAST(widened AND NOT was_table AS BIGINT)
  FROM (SELECT *, tail <> '' AND NOT split AND NOT starts_with(plain, tail) AS widened FROM (SELECT g.section_id, g.chunk, g.raw, g.rows, g.prose, g.split, {RENDERED('g.raw')} AS plain, {strip(f'right(o.text, {OVERLAP_CHARS})')} AS tail, o.rows >= 10 OR o.rows > o.prose AS was_table FROM o JOIN g ON g.section_id = o.section_id AND g.chunk = o.chunk + 1))),
named AS (SELECT g.*, o.text, o.rows AS t, o.prose AS n, array_to_string(list_filter([a, b, c], lambda x: x <> ''), ' - ') AS page_context FROM o JOIN g USING (section_id, chunk))
SELECT section_id, CAST(2021 + section_id % 5 AS INTEGER) AS year, CAST(chunk - 1 AS INTEGER) AS chunk_no, text, {truncate("coalesce(nullif(page_context, ''), nullif(title, ''), nullif(told[greatest(len(told) - 4, 1)], ''), 'No summary')", 30)} AS summary,
  CASE WHEN t >= 10 OR t > n THEN 'table' ELSE 'narrative' END AS chunk_type, CASE WHEN t > n THEN 'table_main' ELSE 'narrative_main' END AS chunk_nature, CAST(t AS INTEGER) AS table_row_count, page_number, page_context FROM named"""
SQL["context_lines"] = f"WITH {SECTION_LINES}, {ISLANDS}, n AS (SELECT *, row_number() OVER (PARTITION BY section_id, island ORDER BY line_no) AS rn FROM island WHERE kind = 'narrative') SELECT section_id, island, string_agg(line, chr(10) ORDER BY line_no) AS context FROM n WHERE rn <= 5 GROUP BY section_id, island"
INTRO = sub(strip(part(strip("before"), fixed.TABLE_INTRO, 1)), r"^[.:]+|[.:]+$")
SQL["table_intro"] = f"WITH {SECTION_LINES}, {ISLANDS} SELECT section_id, CAST(line_no AS INTEGER) AS line_no, {INTRO} AS intro FROM island WHERE kind = 'table' AND previous = 'narrative' AND {INTRO} <> ''"
SQL["summary_fallback"] = f"SELECT doc_id, {truncate('s', 30)} AS summary FROM (SELECT doc_id, coalesce(nullif(page_context, ''), nullif(summary, ''), nullif(page_section, ''), 'No summary') AS s FROM ({CHUNKS}))"

# Chunks.
SQL["chunk_simple"] = """WITH p AS (SELECT doc_id, text, unnest(range(0, CAST(ceil(greatest(len(text) - 1000, 0) / 800.0) AS BIGINT) * 800 + 1, 800)) AS start FROM documents WHERE len(text) > 0)
SELECT doc_id AS section_id, CAST(start / 800 AS INTEGER) AS chunk_no, CAST(start AS INTEGER) AS start, md5(substr(text, start + 1, 1000)) AS text_md5 FROM p"""
SQL["chunk_split"] = f"""WITH RECURSIVE raw AS (SELECT doc_id, unnest(string_split({plain('text')}, chr(10))) AS line, generate_subscripts(string_split({plain('text')}, chr(10)), 1) AS p FROM documents),
l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS n, greatest(len({strip('line')}), 1) + 1 AS cost FROM raw WHERE {strip('line')} <> ''),
f AS (SELECT doc_id, n, cost, 0 AS piece, cost AS used FROM l WHERE n = 0
  UNION ALL SELECT l.doc_id, l.n, l.cost, CASE WHEN f.used + l.cost <= 2000 THEN f.piece ELSE f.piece + 1 END, CASE WHEN f.used + l.cost <= 2000 THEN f.used + l.cost ELSE l.cost END FROM f JOIN l ON l.doc_id = f.doc_id AND l.n = f.n + 1)
SELECT doc_id AS section_id, CAST(piece AS INTEGER) AS piece, CAST(min(n) AS INTEGER) AS first_line, CAST(max(n) + 1 AS INTEGER) AS end_line FROM f GROUP BY doc_id, piece"""
SQL["chunk_merge_small"] = """WITH s AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1 OR len(text) > 500 THEN 1 ELSE 0 END AS s FROM documents),
c AS (SELECT *, CAST(sum(s) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chunk FROM s)
SELECT source, chunk, count(*) AS merged, min(doc_id) AS first_doc, CAST(sum(len(text)) AS BIGINT) AS chars FROM c GROUP BY source, chunk"""
ENDS = sub("text", "\r\n|[\n\r\x0b\x0c" + chr(0x85) + chr(0x2028) + chr(0x2029) + "]", "\n")
SQL["chunk_sizes"] = f"SELECT doc_id, CAST(len(text) AS INTEGER) AS char_size, CAST(CASE WHEN {ENDS} = '' THEN 0 ELSE len(string_split({sub(ENDS, chr(10) + '$')}, chr(10))) END AS INTEGER) AS line_size FROM documents"
QUANTILES = ", ".join(f"round(quantile_cont(CAST(len(text) AS DOUBLE), {p}), 2) AS {n}" for n, p in (("median", 0.5), ("p10", 0.1), ("p25", 0.25), ("p75", 0.75), ("p90", 0.9)))
SQL["chunk_stats"] = f"SELECT lang, CAST(min(len(text)) AS INTEGER) AS min, CAST(max(len(text)) AS INTEGER) AS max, round(avg(len(text)), 2) AS mean, {QUANTILES}, round(stddev_pop(len(text)), 2) AS stdev FROM documents GROUP BY lang"
SQL["chunk_totals"] = f"SELECT count(*) AS total_chunks, count(*) FILTER (WHERE coalesce(table_row_count, 0) > 0) AS table_chunks, count(*) FILTER (WHERE coalesce(table_row_count, 0) <= 0) AS without_table_chunks FROM ({CHUNKS})"
SQL["chunk_histogram"] = """WITH b AS (SELECT count(*) AS n, CAST(min(len(text)) AS DOUBLE) AS lo, CAST(max(len(text)) AS DOUBLE) AS hi, quantile_cont(CAST(len(text) AS DOUBLE), 0.75) - quantile_cont(CAST(len(text) AS DOUBLE), 0.25) AS iqr FROM documents),
w AS (SELECT *, CASE WHEN iqr > 0 THEN least(greatest(2 * iqr / pow(n, 1 / 3::DOUBLE), (hi - lo) / (2 * sqrt(n))), (hi - lo) / (log2(n) + 1)) ELSE (hi - lo) / (log2(n) + 1) END AS width FROM b),
k AS (SELECT lo, hi, CAST(ceil((hi - lo) / greatest(width, 1.0)) AS INTEGER) AS bins FROM w),
p AS (SELECT CAST(least(floor((len(text) - lo) / (hi - lo) * bins), bins - 1) AS INTEGER) AS bin, count(*) AS c FROM documents, k GROUP BY 1),
e AS (SELECT CAST(unnest(range(bins)) AS INTEGER) AS bin, lo, hi, bins FROM k)
SELECT bin, concat(CAST(CAST(round_even(lo + bin * (hi - lo) / bins, 0) AS BIGINT) AS VARCHAR), '-', CAST(CAST(round_even(lo + (bin + 1) * (hi - lo) / bins, 0) AS BIGINT) AS VARCHAR)) AS label, coalesce(c, 0) AS count FROM e LEFT JOIN p USING (bin)"""
SQL["chunk_union"] = "SELECT doc_id, lang, 'documents' AS origin, NULL AS url FROM documents UNION ALL SELECT page_id, NULL, 'pages', url FROM pages"
SQL["chunk_review"] = f"SELECT year, CAST(row_number() OVER (PARTITION BY year ORDER BY doc_id) AS INTEGER) AS id, CAST(len(string_split(text, chr(10))) AS INTEGER) AS line_count, CAST(len(text) AS INTEGER) AS char_count, coalesce(table_row_count, 0) AS table_rows FROM ({CHUNKS})"

# Ranking.
INDEX = f"""words AS (SELECT lang AS scope, doc_id AS id, unnest({W}) AS term FROM documents),
dl AS (SELECT lang AS scope, doc_id AS id, len({W}) AS dl FROM documents),
scopes AS (SELECT scope, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY scope),
tf AS (SELECT scope, id, term, count(*) AS tf FROM words GROUP BY scope, id, term),
df AS (SELECT scope, term, count(*) AS df FROM tf GROUP BY scope, term),
raw_idf AS (SELECT df.*, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df JOIN scopes USING (scope)),
means AS (SELECT scope, avg(raw) AS mean FROM raw_idf GROUP BY scope),
terms AS (SELECT scope, term, df, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM raw_idf JOIN means USING (scope))"""
SCORES = f"""{INDEX},
asked AS (SELECT item_id AS query_id, unnest({W}) AS term FROM benchmark),
scored AS (SELECT query_id, scope, id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM asked JOIN terms USING (term) JOIN tf USING (scope, term) JOIN dl USING (scope, id) JOIN scopes USING (scope) GROUP BY query_id, scope, id)"""
SQL["bm25_idf"] = f"WITH {INDEX} SELECT scope, term, df, round(idf, 6) AS idf FROM terms"
SQL["bm25_topk"] = f"""WITH {SCORES},
every AS (SELECT b.item_id AS query_id, dl.scope, dl.id, coalesce(score, 0) AS score FROM benchmark b CROSS JOIN dl LEFT JOIN scored s ON s.query_id = b.item_id AND s.scope = dl.scope AND s.id = dl.id),
bounds AS (SELECT query_id, scope, min(score) AS low, max(score) AS high FROM every GROUP BY query_id, scope),
norm AS (SELECT query_id, scope, id, round(CASE WHEN high - low <= 1e-12 THEN CASE WHEN score > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE (score - low) / (high - low) END, 6) AS bm25_score FROM every JOIN bounds USING (query_id, scope)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, scope ORDER BY bm25_score DESC, id) AS INTEGER) AS rank FROM norm)
SELECT query_id, scope, id, bm25_score, rank FROM ranked WHERE rank <= 5"""

SQL["bm25_search"] = f"""WITH {SCORES},
ranked AS (SELECT query_id, scope, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id, scope ORDER BY round(score, 6) DESC, id) AS INTEGER) AS rank FROM scored)
SELECT * FROM ranked WHERE rank <= 5"""
SQL["bm25_terms_by_batches"] = f"""WITH {INDEX}, ends AS (SELECT scope, term, max(tf) AS max_tf, CAST(min(dl) AS BIGINT) AS min_dl FROM tf JOIN dl USING (scope, id) GROUP BY scope, term)
SELECT scope, term, df, max_tf, min_dl, round(idf, 6) AS idf FROM terms JOIN ends USING (scope, term)"""


def nearest(scope: str) -> str:
    return f"""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda x: (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) * (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)))), 6) AS distance FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 {scope}),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM s) SELECT query_id, id, distance, rank FROM r WHERE rank <= 5"""


SQL["vector_topk"] = SQL["vector_topk_indexed"] = nearest("")
SQL["vector_topk_scoped"] = nearest("AND q.label = v.label")
SQL["minmax_normalize"] = "WITH s AS (SELECT doc_id, CAST(len(text) AS DOUBLE) AS s, CAST(min(len(text)) OVER (PARTITION BY source) AS DOUBLE) AS lo, CAST(max(len(text)) OVER (PARTITION BY source) AS DOUBLE) AS hi FROM documents) SELECT doc_id, round(CASE WHEN hi - lo <= 1e-12 THEN CASE WHEN s > 0 THEN 1 ELSE 0 END ELSE (s - lo) / (hi - lo) END, 6) AS norm FROM s"


def scaled(x: str, pool: str) -> str:
    lo, hi = f"min({x}) OVER (PARTITION BY {pool})", f"max({x}) OVER (PARTITION BY {pool})"
    return f"CASE WHEN {hi} - {lo} <= 1e-12 THEN CASE WHEN {x} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE ({x} - {lo}) / ({hi} - {lo}) END"


def fused(sign: str) -> str:
    return f"""WITH {SCORES},
every AS (SELECT b.item_id AS query_id, dl.scope, dl.id, coalesce(score, 0) AS score FROM benchmark b CROSS JOIN dl LEFT JOIN scored s ON s.query_id = b.item_id AND s.scope = dl.scope AND s.id = dl.id),
b AS (SELECT query_id, scope, id, {scaled('score', 'query_id, scope')} AS bm25_score FROM every),
dist AS (SELECT q.vec_id AS query_id, lang AS scope, v.vec_id AS id, {sign}list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda x: (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) * (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)))) AS d FROM embeddings q JOIN benchmark ON item_id = q.vec_id CROSS JOIN embeddings v JOIN documents ON doc_id = v.vec_id),
e AS (SELECT query_id, scope, id, {scaled('d', 'query_id, scope')} AS embedding_score FROM dist),
j AS (SELECT query_id, scope, id, coalesce(bm25_score, 0) AS bm25_score, coalesce(embedding_score, 0) AS embedding_score FROM b FULL JOIN e USING (query_id, scope, id)),
f AS (SELECT j.*, CASE WHEN chunk_nature = 'table_main' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END * bm25_score + embedding_score AS hybrid_score FROM j LEFT JOIN ({CHUNKS}) c ON c.doc_id = j.id)"""


SQL["hybrid_fusion"] = fused("-") + " SELECT query_id, id, round(bm25_score, 6) AS bm25_score, round(embedding_score, 6) AS embedding_score, round(hybrid_score, 6) AS hybrid_score FROM f"
SQL["hybrid_topk"] = fused("") + ", r AS (SELECT query_id, scope, id, round(hybrid_score, 6) AS hybrid_score, CAST(row_number() OVER (PARTITION BY query_id, scope ORDER BY round(hybrid_score, 6) DESC, id) AS INTEGER) AS rank FROM f) SELECT * FROM r WHERE rank <= 5"
SQL["candidate_union"] = "SELECT doc_id AS id FROM documents UNION SELECT vec_id FROM embeddings"

# Extraction.
SPLIT = f"list_filter(string_split({ENDS}, chr(10)), lambda x: {strip('x')} <> '')"
EXCERPT = f"""ranked AS (SELECT section AS case_id, CAST(row_number() OVER (PARTITION BY section ORDER BY doc_id) AS INTEGER) AS rank, year AS filing_year, section, text, table_row_count, list_filter([lower(({W})[6]), 'qq'], lambda a: a IS NOT NULL) AS aliases, {SPLIT} AS ls FROM ({CHUNKS})),
found AS (SELECT *, list_transform(ls, lambda x: contains(lower(x), 'table_row')) AS t, list_transform(ls, lambda x: len(list_filter(aliases, lambda a: contains(lower(x), a))) > 0) AS a FROM ranked),
placed AS (SELECT *, coalesce(list_position(list_transform(list_zip(t, a), lambda z: z[1] AND z[2]), true), list_position(a, true), list_position(t, true)) AS spot FROM found),
excerpts AS (SELECT *, CASE WHEN len(ls) = 0 THEN '' WHEN spot IS NOT NULL THEN left({strip("array_to_string(ls[greatest(spot - 2, 1) : spot + 2], chr(10))")}, 500) ELSE left(text, 500) END AS excerpt FROM placed)"""
COLLECTED = EXCERPT + """,
fresh AS (SELECT *, row_number() OVER (PARTITION BY case_id, filing_year, section, excerpt ORDER BY rank) AS again FROM excerpts WHERE filing_year - 2021 BETWEEN 0 AND 2),
collected AS (SELECT *, CAST(row_number() OVER (PARTITION BY case_id ORDER BY rank) AS INTEGER) AS doc_rank FROM fresh WHERE again = 1)"""
SQL["value_excerpt"] = f"WITH {EXCERPT} SELECT case_id, rank, md5(excerpt) AS excerpt_md5 FROM excerpts"
SQL["excerpt"] = f"WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: {strip('x')} <> '') AS ls FROM documents) SELECT doc_id, md5(left({strip('array_to_string(ls[1:5], chr(10))')}, 500)) AS excerpt_md5 FROM l"
SQL["collect_docs"] = f"WITH {COLLECTED} SELECT case_id, doc_rank, rank, filing_year, CAST(filing_year - 2021 AS INTEGER) AS year_index, coalesce(table_row_count, 1) AS table_row_count FROM collected WHERE doc_rank <= 3"
SQL["serialize_docs"] = f"WITH {COLLECTED} SELECT case_id, doc_rank AS rank, filing_year, section, md5(coalesce(nullif(text, ''), excerpt, '')) AS full_text_md5 FROM collected WHERE doc_rank <= 3"
SQL["excerpt_display"] = f"WITH {COLLECTED} SELECT case_id, doc_rank, left(replace(text, chr(10), ' '), 120) AS shown FROM collected WHERE doc_rank <= 3"
SQL["doc_blocks"] = f"""WITH {COLLECTED} SELECT case_id, md5(string_agg(concat('Document ', doc_rank, chr(10), 'Filing year: ', filing_year, chr(10), 'Section: ', section, chr(10), 'Table row count: ', coalesce(table_row_count, 1), chr(10), 'Full text:', chr(10), text), concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY doc_rank)) AS documents_md5 FROM collected WHERE doc_rank <= 3 GROUP BY case_id"""

BLOCK = "concat('Document ', doc_rank, chr(10), 'Filing year: ', filing_year, chr(10), 'Section: ', section, chr(10), 'Table row count: ', coalesce(table_row_count, 1), chr(10), 'Full text:', chr(10), text)"
#: The offline completer: in each document the first number after an alias, of these the most frequent, else the first.
SQL["extract_value"] = f"""WITH {COLLECTED},
blocks AS (SELECT case_id, doc_rank, {BLOCK} AS block, aliases FROM collected WHERE doc_rank <= 3),
own AS (SELECT case_id, aliases AS asked FROM blocks WHERE doc_rank = 1),
said AS (SELECT case_id, doc_rank, asked, string_split({ENDS.replace('text', 'block')}, chr(10)) AS ls FROM blocks JOIN own USING (case_id)),
lines AS (SELECT case_id, doc_rank, asked, unnest(ls) AS line, generate_subscripts(ls, 1) AS place FROM said),
met AS (SELECT *, list_filter(asked, lambda a: contains(lower(line), lower(a)))[1] AS hit FROM lines),
numbers AS (SELECT case_id, doc_rank, place, regexp_extract(substr(line, strpos(lower(line), hit) + len(hit)), '-?\\(?\\$?\\d[\\d,]*\\.?\\d*\\)?') AS number FROM met WHERE hit IS NOT NULL),
firsts AS (SELECT case_id, doc_rank, arg_min(number, place) AS number FROM numbers WHERE number <> '' GROUP BY case_id, doc_rank),
votes AS (SELECT case_id, number, count(*) AS n, min(doc_rank) AS first FROM firsts GROUP BY case_id, number),
chosen AS (SELECT case_id, number, n FROM votes QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY n DESC, first) = 1)
SELECT case_id, coalesce(number, 'N/A') AS value, CAST(coalesce(n, 0) AS INTEGER) AS supporting FROM own LEFT JOIN chosen USING (case_id)"""


def unfence(x: str) -> str:
    s = strip(x)
    return f"CASE WHEN starts_with({s}, '```') THEN {strip(sub(sub(s, '^`+|`+$'), '^json'))} ELSE {s} END"


LOW = f"lower({strip('answer')})"
# The engine has no back-references: the three ways to quote are alternatives.
VALUE = r"""[\{,]\s*"?value"?\s*:\s*(?:"([^,\}]+?)"|'([^,\}]+?)'|([^,\}]+?))\s*[,\}]"""
FOUND = f"concat({part(LOW, VALUE, 1)}, {part(LOW, VALUE, 2)}, {part(LOW, VALUE, 3)})"
CLEAN = sub(strip(FOUND), "^[\"']+|[\"']+$")
DOCS = part(LOW, r"""[\{,]\s*"?supporting_docs"?\s*:\s*\[([^\]]*)\]""", 1)
LISTED = f"array_to_string(list_transform(list_filter(string_split({DOCS}, ','), lambda d: {has(strip('d'), r'^\d+$')}), lambda d: {strip('d')}), ',')"
BAD = f"bad AS (SELECT *, {has(LOW, VALUE)} AS ok, CASE WHEN {CLEAN} NOT IN ('', 'null') THEN {CLEAN} END AS bad_value, {LISTED} AS bad_docs FROM ({ANSWERS}))"
SQL["parse_malformed_json"] = f"WITH {BAD} SELECT id, CASE WHEN ok THEN bad_value END AS value, CASE WHEN ok THEN bad_docs END AS docs FROM bad"
SQL["parse_json"] = f"""WITH {BAD}, j AS (SELECT *, CASE WHEN json_valid({unfence('answer')}) THEN CAST({unfence('answer')} AS JSON) END AS j FROM bad)
SELECT id, CASE WHEN j IS NOT NULL THEN j ->> '$.value' WHEN ok THEN bad_value END AS value, CASE WHEN j IS NOT NULL THEN array_to_string(CAST(j -> '$.supporting_docs' AS INTEGER[]), ',') WHEN ok THEN bad_docs END AS docs FROM j"""
SQL["empty_value_response"] = f"SELECT id, {has(unfence('lower(answer)'), r'\bvalue\b\s*:\s*(?:,|$|\}|null|' + chr(34) * 2 + ')')} AND {has(unfence('lower(answer)'), r'\bsupporting_docs\b\s*:\s*\[\s*\]')} AS empty FROM ({ANSWERS})"

# Evaluation.
NORMAL = "replace(" + strip("coalesce(CASE variable WHEN 'total_revenues' THEN total_revenues WHEN 'underwriting_income' THEN underwriting_income WHEN 'sp_rating' THEN upper(sp_rating) END, '')") + ", chr(34), '')"
TRUTH = f"""truth AS (SELECT CAST(o_orderkey AS INTEGER) AS year, {inputs.A} AS total_revenues, concat('-', {inputs.B}) AS underwriting_income, concat('"', lower(o_orderstatus), '+" ') AS sp_rating FROM orders),
cases AS (SELECT year, variable, {NORMAL} AS ground_truth FROM truth CROSS JOIN {VARIABLES})"""
PREDICTED = f"""{TRUTH},
guess AS (SELECT *, CASE WHEN year % 3 = 0 THEN ground_truth WHEN ({amount('ground_truth')}) IS NOT NULL THEN CAST(CAST(({amount('ground_truth')}) + year % 250 AS BIGINT) AS VARCHAR) ELSE 'A' END AS prediction FROM cases),
judged AS (SELECT *, CASE WHEN ({amount('prediction')}) IS NOT NULL AND ({amount('ground_truth')}) IS NOT NULL THEN abs(({amount('prediction')}) - ({amount('ground_truth')})) <= 100 ELSE prediction = ground_truth END AS correct FROM guess)"""
FOUND_NUMBERS = f"list_transform(regexp_extract_all(text, {q(fixed.NUMBER_TOKEN)}), lambda t: {amount('t')})"
HIT = f"CASE WHEN ground_truth = '' THEN false WHEN ({amount('ground_truth')}) IS NOT NULL THEN len(list_filter({FOUND_NUMBERS}, lambda v: coalesce(abs(v - ({amount('ground_truth')})) <= 100, false))) > 0 ELSE contains(upper(text), upper({strip('ground_truth')})) END"
CASE_DOCS = f"""{PREDICTED},
texts AS (SELECT *, [concat('first text 1,2 and ', ground_truth), concat('about (', prediction, ') so'), lower(concat('rated ', ground_truth))] AS d, CAST(year % 2 + 1 AS INTEGER) AS supporting FROM judged),
shifted AS (SELECT *, CASE year % 4 WHEN 0 THEN list_reverse(d) WHEN 1 THEN d[2:3] WHEN 2 THEN ['nothing'] ELSE d END AS s FROM texts),
docs AS (SELECT year, variable, ground_truth, supporting, unnest(s) AS text, CAST(generate_subscripts(s, 1) AS INTEGER) AS doc_rank FROM shifted),
hits AS (SELECT *, {HIT} AS hit FROM docs),
ranks AS (SELECT year, variable, coalesce(min(doc_rank) FILTER (WHERE hit), -1) AS retrieval_rank, any_value(supporting) AS supporting FROM hits GROUP BY year, variable),
rank_rows AS (SELECT year, variable, retrieval_rank, retrieval_rank > 0 AS retrieval_hit, retrieval_rank = supporting AS retrieval_hit_in_supporting_docs FROM ranks)"""
SQL["eval_cases"] = f"WITH {TRUTH} SELECT year, variable, ground_truth FROM cases"
SQL["values_match"] = f"WITH {PREDICTED} SELECT year, variable, prediction, correct FROM judged"
SQL["ground_truth_lookup"] = f"WITH {TRUTH}, asked AS (SELECT variable, CAST(o_orderkey * 2 AS INTEGER) AS year FROM orders CROSS JOIN {VARIABLES}) SELECT year, variable, coalesce(ground_truth, 'N/A') AS ground_truth FROM asked LEFT JOIN cases USING (year, variable)"
SQL["rank_in_docs"] = f"WITH {CASE_DOCS} SELECT * FROM rank_rows"
SQL["rank_numeric"] = f"WITH {CASE_DOCS} SELECT year, doc_rank, hit FROM hits WHERE variable = 'total_revenues'"
SQL["rank_string"] = f"WITH {CASE_DOCS} SELECT year, doc_rank, hit FROM hits WHERE variable = 'sp_rating'"
SQL["eval_summary"] = f"WITH {CASE_DOCS} SELECT count(*) AS cases, count(*) FILTER (WHERE correct) AS correct, round(count(*) FILTER (WHERE correct) / count(*), 6) AS accuracy, count(*) FILTER (WHERE retrieval_hit) AS retrieval_hit, round(count(*) FILTER (WHERE retrieval_hit) / count(*), 6) AS retrieval_hit_rate, round(avg(CASE WHEN retrieval_rank > 0 THEN 1.0::DOUBLE / retrieval_rank ELSE 0 END), 6) AS mrr FROM judged JOIN rank_rows USING (year, variable)"
SQL["eval_mrr"] = f"WITH {CASE_DOCS} SELECT variable, round(avg(CASE WHEN retrieval_rank > 0 THEN 1.0::DOUBLE / retrieval_rank ELSE 0 END), 6) AS mrr FROM rank_rows GROUP BY variable"
SQL["eval_csv_projection"] = f"WITH {CASE_DOCS} SELECT year, variable, prediction, ground_truth, correct, retrieval_rank, retrieval_hit, retrieval_hit_in_supporting_docs FROM judged JOIN rank_rows USING (year, variable)"
SQL["eval_json"] = f"""WITH scored AS ({SQL['eval_csv_projection']}), s AS ({SQL['eval_summary']}),
b AS (SELECT year, variable, CAST(to_json({{'correct': correct, 'ground_truth': ground_truth, 'prediction': prediction, 'retrieval_hit': retrieval_hit, 'retrieval_hit_in_supporting_docs': retrieval_hit_in_supporting_docs, 'retrieval_rank': retrieval_rank, 'variable': variable, 'year': year}}) AS VARCHAR) AS body, row_number() OVER (ORDER BY year, variable) AS n FROM scored)
SELECT CAST(1 AS INTEGER) AS part, year, variable, CASE WHEN n = 1 THEN body ELSE ',' || body END AS json FROM b
UNION ALL SELECT 0, NULL, NULL, concat('{{"summary":', CAST(to_json({{'cases': cases, 'correct': correct, 'accuracy': accuracy, 'retrieval_hit': retrieval_hit, 'retrieval_hit_rate': retrieval_hit_rate, 'mrr': mrr}}) AS VARCHAR), ',"cases":[') FROM s
UNION ALL SELECT 2, NULL, NULL, ']}}'"""

# Learning.
SQL["line_ngrams"] = f"WITH n AS (SELECT line, unnest([2, 3, 4, 5]) AS n FROM ({inputs.LINES})), g AS (SELECT line, n, unnest(range(1, len(line) - n + 2)) AS i FROM n) SELECT substr(line, i, n) AS gram, count(*) AS n FROM g GROUP BY substr(line, i, n)"
SQL["stratified_split"] = "WITH r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rank, count(*) OVER (PARTITION BY quality) AS n FROM labels) SELECT doc_id, quality, rank <= floor(n * 0.8::DOUBLE) AS is_train FROM r"
SQL["classification_report"] = """WITH p AS (SELECT CAST(quality AS VARCHAR) AS label, CAST(CASE WHEN doc_id % 5 = 0 THEN toxic ELSE quality END AS VARCHAR) AS predicted FROM labels),
s AS (SELECT label, count(*) AS support, 0 AS given, count(*) FILTER (WHERE label = predicted) AS good FROM p GROUP BY label UNION ALL SELECT predicted, 0, count(*), 0 FROM p GROUP BY predicted),
t AS (SELECT label, sum(support) AS support, sum(given) AS given, sum(good) AS good FROM s GROUP BY label),
r AS (SELECT label, support, coalesce(good / nullif(given, 0), 0) AS p, coalesce(good / nullif(support, 0), 0) AS r FROM t)
SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, CAST(support AS BIGINT) AS support FROM r"""

# Streaming.
SQL["stream_index"] = f"WITH c AS (SELECT year, CAST(ceil(greatest(len(text) - 2000, 0) / 1600.0) AS BIGINT) + 1 AS n FROM ({CHUNKS}) WHERE len(text) > 0) SELECT year, CAST(sum(n) AS BIGINT) AS chunks, CAST(sum(n) AS BIGINT) AS ids FROM c GROUP BY year"

# Jobs.
DOCUMENT_LINES = SECTION_LINES.replace(inputs.SECTIONS_DUCKDB, "SELECT doc_id AS section_id, text FROM documents")
SQL["job1_chunk_table"] = f"""WITH {DOCUMENT_LINES}, {ISLANDS},
c AS (SELECT section_id, island, kind, count(*) AS n_lines, count(*) FILTER (WHERE label = 'table_row') AS t, count(*) FILTER (WHERE label = 'narrative') AS n, {strip(JOINED)} AS text FROM island GROUP BY section_id, island, kind)
SELECT d.doc_id, d.source, d.lang, island AS chunk_no, kind, n_lines, t AS table_rows, CASE WHEN t >= 10 OR t > n THEN 'table' ELSE 'narrative' END AS chunk_type, CASE WHEN t > n THEN 'table_main' ELSE 'narrative_main' END AS chunk_nature, CAST(len(c.text) AS INTEGER) AS n_chars, c.text
FROM c JOIN documents d ON d.doc_id = c.section_id"""
SQL["job2_grow_index"] = f"""WITH {INDEX}, held AS (SELECT scope, term, max(tf) AS max_tf, CAST(min(dl) AS BIGINT) AS min_dl, count(*) AS postings, CAST(sum(tf) AS BIGINT) AS occurrences, CAST(sum(id % 1000) AS BIGINT) AS id_sum FROM tf JOIN dl USING (scope, id) GROUP BY scope, term)
SELECT scope, term, df, max_tf, min_dl, round(idf, 6) AS idf, postings, occurrences, id_sum FROM terms JOIN held USING (scope, term)"""
