"""The same queries in DuckDB SQL, written independently of the Spark plans.

Plain windows, plain sorts and DuckDB's own JSON functions; where a response
format is stricter than those, the expected value follows from the fixture's
rule. Only the fixtures themselves are shared.
"""

from taskloom.functions import lexicon
from taskloom.plans.fixtures import duckdb_sql as fx
from taskloom.prompts import STAGES, TYPE_GUIDES


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_SPACE = "concat(" + ", ".join(
    f"chr({c})" for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)
) + ")"


def strip(x: str) -> str:
    return f"trim({x}, {_SPACE})"


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda q: q <> '')"


def ints(x: str) -> str:
    return f"array_to_string({x}, ',')"


def words_score(col: str, words) -> str:
    return " + ".join(f"(length({col}) - length(replace({col}, {text(w)}, ''))) // {len(w)}" for w in words)


# --- corpus ------------------------------------------------------------------

_FEATURES = f"""
raw AS (SELECT doc_id, seq, quality_domain_txt, {strip('text')} AS text FROM {fx('corpus_raw')}),
cut AS (SELECT *, lower(text) AS low, {tokens('lower(text)')} AS toks, string_split(text, chr(10)) AS lns FROM raw),
counted AS (
  SELECT doc_id, seq, quality_domain_txt, text, length(text) AS text_len, len(toks) AS token_count,
    len(list_filter(toks, lambda q: regexp_matches(q, '\\d'))) AS digit_tokens,
    len(list_filter(lns, lambda q: regexp_matches(q, '^\\s*(\\d+[.):]|[-*•])\\s+\\S'))) AS list_lines,
    len(lns) AS line_count,
    ({words_score('low', lexicon.TEMPORAL_WORDS)}) AS temporal_score,
    ({words_score('low', lexicon.SPATIAL_WORDS)}) AS spatial_score,
    regexp_matches(text, '\\|[^\\n]{{2,}}\\|') AS has_table
  FROM cut),
rated AS (
  SELECT *, digit_tokens / greatest(token_count, 1) AS numeric_ratio, list_lines / line_count AS list_density FROM counted),
features AS (
  SELECT *, text_len >= 400 AND NOT has_table AND list_density < 0.15 AND numeric_ratio < 0.25 AS is_prose FROM rated),
hinted AS (
  SELECT *, CASE WHEN text_len < 200 THEN [] ELSE list_filter([
      CASE WHEN spatial_score >= 4 THEN 1 END,
      CASE WHEN is_prose THEN 2 END,
      CASE WHEN numeric_ratio >= 0.07 OR quality_domain_txt IN ('technology','education','economics','medical','natural_science') THEN 3 END,
      CASE WHEN has_table OR list_density >= 0.20 THEN 4 END,
      CASE WHEN temporal_score >= 4 THEN 5 END], lambda q: q IS NOT NULL) END AS rule_hints
  FROM features)"""

_T1, _T2 = "1 + doc_id % 5", "1 + (doc_id // 9) % 5"
# Listed types, origin and nesting of each response, by the fixture's own rule.
_EXPECTED = f"""
expected AS (
  SELECT doc_id, raw,
    CASE doc_id % 9 WHEN 0 THEN [({_T1})::varchar, ({_T2})::varchar] WHEN 1 THEN ['1', '4', 'true', '2.0']
      WHEN 2 THEN [({_T1})::varchar, ({_T2})::varchar] WHEN 4 THEN ['0', '6', '3', '3']
      WHEN 7 THEN [({_T1})::varchar, ({_T2})::varchar] WHEN 8 THEN [({_T1})::varchar, ({_T2})::varchar] ELSE [] END AS listed,
    doc_id % 9 <> 5 AS ok,
    CASE WHEN doc_id % 9 IN (0, 1, 4, 6) THEN 'whole' WHEN doc_id % 9 = 5 THEN 'none' ELSE 'block' END AS origin,
    doc_id % 9 = 3 AS matched_inner,
    CASE WHEN doc_id % 9 = 0 THEN concat({_T1}, '=it fits') WHEN doc_id % 9 = 4 THEN '3=figures' ELSE '' END AS reasons
  FROM {fx('corpus_responses')}),
typed AS (
  SELECT *, list_sort(list_distinct(list_transform(
    list_filter(listed, lambda q: q IN ('1','2','3','4','5')), lambda q: q::int))) AS types FROM expected)"""

_CLASSIFIED = f"""{_FEATURES}, {_EXPECTED},
classified AS (
  SELECT h.doc_id, substr(h.text, 1, 2048) AS text, h.rule_hints, t.types, t.reasons, t.raw AS raw_output, t.ok AS parse_ok
  FROM hinted h JOIN typed t USING (doc_id) WHERE h.text <> '' AND len(h.rule_hints) > 0)"""

_BUCKETS = f"""{_FEATURES},
buckets AS (
  SELECT doc_id AS corpus_id, substr(text, 1, 4096) AS corpus_text, unnest(rule_hints)::bigint AS type_id,
    generate_subscripts(rule_hints, 1) - 1 AS slot
  FROM hinted WHERE text <> '')"""

_RESOLVED = """CASE WHEN try_cast(trim(type_level1) AS int) BETWEEN 1 AND 5 THEN try_cast(trim(type_level1) AS bigint) ELSE 3 END"""


def _pairs(k: int, empty: tuple[int, ...] = ()) -> str:
    drop = f"WHERE type_id NOT IN ({', '.join(map(str, empty))})" if empty else ""
    return f"""{_BUCKETS},
kept AS (SELECT * FROM buckets {drop}),
entries AS (SELECT *, type_id AS pool, md5(concat_ws('|', 42, type_id, corpus_id, slot)) AS h FROM kept
  UNION ALL SELECT *, 0 AS pool, md5(concat_ws('|', 42, type_id, corpus_id, slot)) AS h FROM kept),
ring AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY h, corpus_id, slot) - 1 AS pos,
  count(*) OVER (PARTITION BY pool) AS n FROM entries),
sized AS (SELECT pool, max(n) AS n FROM ring GROUP BY pool),
problems AS (SELECT id, {_RESOLVED} AS type_id FROM {fx('qa')}),
routed AS (SELECT p.*, CASE WHEN s.pool IS NULL THEN 0 ELSE p.type_id END AS pool,
  CASE WHEN s.pool IS NULL THEN 'fallback' ELSE 'typed' END AS route FROM problems p LEFT JOIN sized s ON s.pool = p.type_id),
draws AS (SELECT r.*, s.n, j AS sample_idx, j // s.n AS pass FROM routed r JOIN sized s USING (pool), range(0, {k}) g(j)),
placed AS (SELECT *, ((('0x' || substr(md5(concat_ws('|', 42, id, pass)), 1, 15))::bigint % n) + sample_idx % n) % n AS pos FROM draws),
pairs AS (SELECT p.id, p.type_id, p.route, p.sample_idx, r.corpus_id, r.corpus_text FROM placed p JOIN ring r ON r.pool = p.pool AND r.pos = p.pos)"""


# --- record shaping ----------------------------------------------------------

def _problem(with_note: bool) -> str:
    note = ", CASE WHEN note <> '' THEN concat(chr(10), 'Note:', chr(10), note) END" if with_note else ""
    example = (
        "concat('  Example ', i, ':', chr(10), '    Input:  ', " + strip("examples[i].input")
        + ", chr(10), '    Output: ', " + strip("examples[i].output") + ")"
    )
    return (
        "concat_ws(chr(10), CASE WHEN refined_question <> '' THEN refined_question ELSE question END"
        ", CASE WHEN input_format <> '' THEN concat(chr(10), 'Input format:', chr(10), input_format) END"
        ", CASE WHEN output_format <> '' THEN concat(chr(10), 'Output format:', chr(10), output_format) END"
        ", CASE WHEN len(examples) > 0 THEN concat(chr(10), 'Examples:', chr(10), array_to_string(list_transform("
        f"range(1, len(examples) + 1), lambda i: {example}), chr(10))) END{note})"
    )


_LANGS = {"GNU C++17": "cpp", "PyPy 3": "python", "Java 11": "java", "C#": "c", "Scala": "c", "Haskell": "cpp",
          "Rust 2021": "rust", "JavaScript (V8)": "c", " Python 3 ": "python", "": "cpp"}
_RUNNERS = {"GNU C++17": "cpp", "PyPy 3": "pypy 3", "Java 11": "java", "C#": "c#", "Scala": "scala", "Haskell": "haskell",
            "Rust 2021": "rust", "JavaScript (V8)": "java", " Python 3 ": "python3", "": ""}


def _case_of(col: str, table: dict[str, str]) -> str:
    return f"CASE {col} " + " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in table.items()) + " END"


def _solutions(limit: int, allowed: tuple[str, ...]) -> str:
    ok = f"AND language IN ({', '.join(map(text, allowed))})" if allowed else ""
    status = f"WHEN NOT (language IN ({', '.join(map(text, allowed))})) THEN 'language'" if allowed else ""
    return f"""
named AS (SELECT s.*, coalesce(nullif(s.source, ''), s.og_source) AS code, {_case_of('programmingLanguage', _LANGS)} AS language
  FROM {fx('solutions')} s WHERE s.id IN (SELECT id FROM {fx('qa')})),
judged AS (SELECT *, CASE WHEN {strip('code')} = '' THEN 'empty' {status} WHEN length(code) > {limit} THEN 'too_long' ELSE 'kept' END AS status FROM named),
kept AS (SELECT * FROM judged WHERE status = 'kept' {ok})"""


_FIRST_CODE = f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq, pos) AS r FROM {fx('solutions')} WHERE source <> ''),
codes AS (SELECT id, source AS code, "programmingLanguage" FROM ranked WHERE r = 1)"""


# --- prompts -----------------------------------------------------------------

def _filled(stage: str, values: dict[str, str]) -> str:
    out = text(STAGES[stage].template)
    for name, value in values.items():
        out = f"replace({out}, {text('{' + name + '}')}, {value})"
    return out


_GUIDE = "CASE type_id " + " ".join(f"WHEN {k} THEN {text(v)}" for k, v in TYPE_GUIDES["en"].items()) + f" ELSE {text(TYPE_GUIDES['en'][3])} END"
_PROMPTS = f"""
prompts AS (SELECT seq, {_filled('synthesize', {
    'type_id': 'type_id::varchar', 'type_instruction': _GUIDE,
    'text': "concat(corpus_text, ' {problem} {{x}}')", 'problem': "concat('Solve ', title)"})} AS prompt FROM {fx('stories')})"""

# --- responses ---------------------------------------------------------------


def _field(col: str, name: str) -> str:
    """Missing → '', explicit null → NULL, as text otherwise."""
    return f"CASE WHEN NOT json_exists({col}, '$.{name}') THEN '' ELSE json_extract_string({col}, '$.{name}') END"


def _parsed(col: str) -> str:
    return f"(CASE WHEN json_valid({col}) THEN json_type({col}) = 'OBJECT' ELSE false END)"


def _safe(col: str, name: str) -> str:
    return f"CASE WHEN {_parsed(col)} THEN {_field(col, name)} END"


_STORIES = f"""
parts AS (SELECT *, {_safe('refined_result', 'problem')} AS rp, {_safe('refined_result', 'input')} AS ri,
  {_safe('synthesis_result', 'problem')} AS sp, {_safe('synthesis_result', 'input')} AS si FROM {fx('stories')}),
told AS (SELECT *, CASE WHEN rp <> '' AND ri IS NOT NULL THEN 'refined' WHEN sp <> '' AND si IS NOT NULL THEN 'draft' END AS story_origin FROM parts),
stories AS (SELECT *, CASE story_origin WHEN 'refined' THEN rp WHEN 'draft' THEN sp END AS story_problem,
  CASE story_origin WHEN 'refined' THEN ri WHEN 'draft' THEN si END AS story_input FROM told)"""

_PROGRAMS = f"""
programs AS (SELECT *, {_safe('instrument_result', 'instrumented_code')} AS code, {_safe('instrument_result', 'analysis')} AS analysis
  FROM {fx('instrumented')}),
usable AS (SELECT * FROM programs WHERE code <> ''),
first_usable AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS r FROM usable) WHERE r = 1)"""

_COT = f"""
cot AS (SELECT eval_id, problem_id, type_id, rating, problem, {_parsed('cot_result')} AS parse_ok,
  coalesce({_safe('cot_result', 'verified')}, '') = 'true' AS verified,
  try_cast({_safe('cot_result', 'num_steps')} AS bigint) AS num_steps,
  coalesce({_safe('cot_result', 'reasoning')}, '') AS reasoning,
  coalesce({_safe('cot_result', 'mismatch_reason')}, '') AS mismatch_reason FROM {fx('cot')})"""

_CLASSES = f"""
classes AS (SELECT id, {_parsed('raw')} AS parse_ok, coalesce({_safe('raw', 'core_step')}, '') AS core_step,
  coalesce({_safe('raw', 'level1')}, '') AS type_level1, coalesce({_safe('raw', 'level2')}, '') AS type_level2,
  coalesce({_safe('raw', 'new')}, '') = 'true' AS is_new, coalesce({_safe('raw', 'reason')}, '') AS reason FROM {fx('classify_responses')})"""

# Suites by the fixture's rule: length, repeats and long inputs depend on (conv_id, turn).
_SUITES = f"""
listed AS (
  SELECT suite, j AS place, CASE WHEN suite // 1000 % 4 = 2 AND j = 12 THEN repeat('9', 1200)
    ELSE concat(suite // 1000, chr(10), CASE WHEN suite % 1000 % 3 = 1 AND j = 7 THEN 6 ELSE j END) END AS input,
    CASE WHEN j < 5 THEN 'A' WHEN j < 10 THEN 'B' ELSE 'C' END AS level
  FROM {fx('printed_tests')} p, range(0, 30) g(j)
  WHERE suite // 1000 % 11 <> 10 AND j < CASE WHEN suite // 1000 % 3 = 0 THEN 29 ELSE 30 END)"""

# --- runs and traces ---------------------------------------------------------

_SPLIT = f"""
outs AS (SELECT *, string_split(stdout, chr(10)) AS ls FROM {fx('runs')}),
split AS (SELECT * EXCLUDE (ls),
  list_transform(list_filter(ls, lambda q: starts_with({strip('q')}, '[TRACE]')), lambda q: {strip('q')}) AS traces,
  {strip("array_to_string(list_filter(ls, lambda q: NOT starts_with(" + strip('q') + ", '[TRACE]')), chr(10))")} AS actual_output FROM outs)"""

_MATCHED = f"""{_SPLIT},
matched AS (SELECT *, return_code = 0 AND stdout <> '' AS success, actual_output = {strip('expected_output')} AS output_matched FROM split)"""

# Lines by position; a bare marker has an empty label and no fields.
_EVENTS = f"""{_SPLIT},
numbered AS (SELECT problem_id, seq, unnest(traces) AS line, generate_subscripts(traces, 1) - 1 AS line_no FROM split),
bodies AS (SELECT *, string_split({strip('substr(line, 8)')}, ' | ') AS parts FROM numbered),
events_out AS (SELECT problem_id, seq, line_no, {strip('parts[1]')} AS label, parts[2:] AS parts FROM bodies),
pairs_all AS (SELECT problem_id, seq, line_no, label, unnest(parts) AS part, generate_subscripts(parts, 1) AS nth FROM events_out),
pairs_last AS (SELECT problem_id, seq, line_no, label, string_split(part, '=')[1] AS key, string_split(part, '=')[2] AS value
  FROM pairs_all QUALIFY row_number() OVER (PARTITION BY seq, line_no, string_split(part, '=')[1] ORDER BY nth DESC) = 1)"""

_INPUT_KEY = strip("replace({0}, chr(13), '')")
_TRACES = f"""{_PROGRAMS},
usable_traces AS (SELECT problem_id, source, {_INPUT_KEY.format('input')} AS k, seq, raw_stdout FROM {fx('trace_runs')} WHERE {strip('raw_stdout')} <> ''),
first_traces AS (SELECT * FROM usable_traces QUALIFY row_number() OVER (PARTITION BY problem_id, source, k ORDER BY seq) = 1),
cases AS (SELECT *, {_INPUT_KEY.format('new_input')} AS k, coalesce({_safe('fused_result', 'problem')}, '') AS problem FROM {fx('fused')}),
candidates AS (SELECT c.*, t.raw_stdout, p.code AS instrumented_code,
  CASE WHEN c.problem = '' THEN 'bad_story' WHEN t.raw_stdout IS NULL THEN 'no_trace' WHEN p.code IS NULL THEN 'no_code' ELSE 'matched' END AS trace_status
  FROM cases c LEFT JOIN first_traces t ON t.problem_id = c.problem_id AND t.source = c.source AND t.k = c.k
  LEFT JOIN first_usable p ON p.id = c.problem_id)"""


def _status_of(n: int, of: str = "eval_cases") -> str:
    return f"ords AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS ord, count(*) OVER () AS n FROM {fx(of)})"


_SHARD7 = "CASE WHEN ord < n % 7 * (n // 7 + 1) THEN ord // (n // 7 + 1) ELSE n % 7 + (ord - n % 7 * (n // 7 + 1)) // greatest(n // 7, 1) END"
_WELL_FORMED = "'^\\[TRACE\\] [^|=]*[^|=\\s](\\s\\|\\s[^|=]+=.*)*$'"


def _hit(col: str, term: str) -> str:
    return f"regexp_matches(lower({col}), {text('(^|[^\\p{L}\\p{N}_])' + term + '($|[^\\p{L}\\p{N}_])')})"


def _terms(source: str, key: str, col: str, words) -> str:
    return " UNION ALL ".join(f"SELECT {key}, {text(w)} AS term FROM {source} WHERE {_hit(col, w)}" for w in words)


ORACLE: dict[str, str] = {
    "read_jsonl": f"""WITH {_EXPECTED} SELECT origin <> 'whole' AS bad_line, CASE WHEN origin = 'whole' THEN {ints('listed')} END AS types,
        count(*) AS n FROM expected GROUP BY 1, 2""",
    "read_jsonl_ordered": f"""WITH {_EXPECTED}, o AS (SELECT *, row_number() OVER (ORDER BY doc_id % 2, doc_id) - 1 AS seq FROM expected)
        SELECT seq, coalesce({ints('listed')}, '') AS types FROM o WHERE origin = 'whole'""",
    "intake_two_sinks": f"""WITH {_FEATURES}, k AS (SELECT *, {_filled('classify_corpus', {
          'text': 'substr(text, 1, 2048)', 'rule_hints': "CASE WHEN len(rule_hints) > 0 THEN array_to_string(rule_hints, ', ') ELSE 'none' END"})} AS prompt
          FROM hinted WHERE text <> '' AND len(rule_hints) > 0)
        SELECT 'rule' AS sink, doc_id, {ints('rule_hints')} AS types FROM k UNION ALL SELECT 'model', doc_id, (1 + length(prompt) % 5)::varchar FROM k""",
    "read_shards": f"""WITH {_status_of(0)} SELECT eval_id, seq, (ord // ((n + 15) // 16))::bigint AS shard FROM ords
        WHERE ord // ((n + 15) // 16) BETWEEN 3 AND 9""",
    "union_inputs": f"""SELECT problem_id, source, input FROM {fx('eval_cases')}
        UNION ALL SELECT problem_id, NULL, input FROM {fx('trace_runs')}""",
    "write_shards": f"""WITH {_status_of(0)} SELECT ({_SHARD7})::bigint AS shard, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM ords GROUP BY 1""",
    "append_jsonl": "SELECT doc_id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark",
    "two_way_sink": f"""WITH {_FEATURES}, o AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS ord FROM hinted),
        k AS (SELECT ord % 4 AS shard FROM o WHERE text <> '' AND len(rule_hints) > 0)
        SELECT 'rule' AS sink, shard, count(*) AS n FROM k GROUP BY 2 UNION ALL SELECT 'model', shard, count(*) FROM k GROUP BY 2""",
    "problem_text_classify": f"""SELECT id, concat_ws(chr(10),
        CASE WHEN title <> '' THEN concat('### ', title) END,
        CASE WHEN description <> '' THEN concat(chr(10), description) END,
        CASE WHEN input_format <> '' THEN concat(chr(10), chr(10), 'Input format:', chr(10), input_format) END,
        CASE WHEN output_format <> '' THEN concat(chr(10), chr(10), 'Output format:', chr(10), output_format) END,
        CASE WHEN len(examples) > 0 THEN concat(chr(10), chr(10), 'Examples:', chr(10), 'Example 1:',
          CASE WHEN examples[1].input <> '' THEN concat(chr(10), 'Input: ', examples[1].input) END,
          CASE WHEN examples[1].output <> '' THEN concat(chr(10), 'Output: ', examples[1].output) END) END) AS question FROM {fx('qa')}""",
    "problem_text_full": f"SELECT id, {_problem(False)} AS problem FROM {fx('qa')}",
    "problem_text_note": f"SELECT id, {_problem(True)} AS problem FROM {fx('qa')}",
    "tags_editorial": f"""SELECT id, CASE WHEN len(tags) > 0 THEN array_to_string(tags, ', ') ELSE 'None' END AS tags,
        CASE WHEN len(accepted_solutions) > 0 THEN concat('Reference code (', coalesce(accepted_solutions[1]."programmingLanguage", 'Unknown'),
        '):', chr(10), coalesce(accepted_solutions[1].source, 'N/A')) ELSE 'None' END AS editorial FROM {fx('qa')}""",
    "solution_rows": f"""WITH q AS (SELECT id, unnest(CASE WHEN len(accepted_solutions) = 0 THEN [NULL] ELSE accepted_solutions END) AS s FROM {fx('qa')})
        SELECT id, CASE WHEN s IS NOT NULL THEN 0 ELSE -1 END::bigint AS pos, s.source AS source, s.og_source AS og_source,
        s."programmingLanguage" AS "programmingLanguage", s.submission_id AS submission_id FROM q""",
    "expand_solutions": f"""WITH {_solutions(8000, ())} SELECT id, pos, code, language, submission_id,
        row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS solution_idx FROM kept""",
    "expand_solutions_sampled": f"""WITH {_solutions(8000, ())},
        drawn AS (SELECT *, md5(concat_ws('|', 42, id, pos)) AS h, count(*) OVER (PARTITION BY id) AS n FROM kept),
        ordered AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN n <= 2 THEN pos END NULLS LAST, h) - 1 AS solution_idx FROM drawn)
        SELECT id, pos, language, solution_idx FROM ordered WHERE solution_idx < 2""",
    "expand_funnel": f"""WITH {_solutions(8000, ())}, all_rows AS (SELECT status FROM judged UNION ALL
        SELECT 'empty' FROM {fx('qa')} WHERE id NOT IN (SELECT id FROM {fx('solutions')})) SELECT status, count(*) AS n FROM all_rows GROUP BY 1""",
    "language_detect_names": f"""SELECT "programmingLanguage", {_case_of('"programmingLanguage"', _LANGS)} AS language, count(*) AS n FROM {fx('solutions')} GROUP BY 1, 2""",
    "language_runner_names": f"""SELECT "programmingLanguage", {_case_of('"programmingLanguage"', _RUNNERS)} AS runner, count(*) AS n FROM {fx('solutions')} GROUP BY 1, 2""",
    "first_code": f"WITH {_FIRST_CODE} SELECT * FROM codes",
    "rating_lookup": f"""WITH r AS (SELECT id, coalesce(rating, 0) AS rating, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS r FROM {fx('qa_twice')})
        SELECT s.seq, s.id, coalesce(r.rating, 0)::bigint AS rating FROM {fx('stories')} s LEFT JOIN r ON r.id = s.id AND r.r = 1""",
    "text_truncate": "SELECT doc_id, substr(text, 1, 2048) AS text FROM documents",
    "corpus_features": f"""WITH {_FEATURES} SELECT doc_id, text_len, token_count, digit_tokens, list_lines, line_count,
        temporal_score, spatial_score, has_table, numeric_ratio, list_density, is_prose FROM features""",
    "rule_hints": f"WITH {_FEATURES} SELECT doc_id, {ints('rule_hints')} AS hints FROM hinted",
    "rule_filter": f"""WITH {_FEATURES} SELECT CASE WHEN text = '' THEN 'empty' WHEN len(rule_hints) = 0 THEN 'no_hint' ELSE 'kept' END AS status,
        count(*) AS n FROM hinted GROUP BY 1""",
    "suitable_types": f"WITH {_EXPECTED} SELECT doc_id, {ints('types')} AS types FROM typed",
    "classified_corpus": f"""WITH {_CLASSIFIED} SELECT doc_id, text, {ints('rule_hints')} AS hints, {ints('types')} AS types,
        reasons, raw_output, parse_ok FROM classified""",
    "type_buckets": f"""WITH {_CLASSIFIED} SELECT doc_id AS corpus_id, unnest(types)::bigint AS type_id, substr({strip('text')}, 1, 4096) AS corpus_text FROM classified""",
    "bucket_counts": f"WITH {_BUCKETS} SELECT type_id, count(*) AS entries FROM buckets GROUP BY 1",
    "hint_vs_model": f"""WITH {_CLASSIFIED}, pairs AS (
        SELECT k AS type_id, list_contains(rule_hints, k) AS h, list_contains(types, k) AS m FROM classified, range(1, 6) g(k))
        SELECT type_id, CASE WHEN h AND m THEN 'agreed' WHEN h THEN 'dropped' ELSE 'added' END AS outcome, count(*) AS n
        FROM pairs WHERE h OR m GROUP BY 1, 2""",
    "resolve_type": f"SELECT id, {_RESOLVED} AS type_id FROM {fx('qa')}",
    "typed_pairs": f"WITH {_pairs(3)} SELECT * FROM pairs",
    "typed_pairs_cycled": f"WITH {_pairs(45)} SELECT * EXCLUDE (corpus_text) FROM pairs",
    "pair_fallback": f"WITH {_pairs(2, (1, 3))} SELECT * EXCLUDE (corpus_text) FROM pairs",
    "pair_stats": f"""WITH p AS (SELECT {_RESOLVED} AS type_id FROM {fx('qa')}), {_BUCKETS},
        present AS (SELECT DISTINCT type_id FROM buckets WHERE type_id NOT IN (1, 3)),
        r AS (SELECT p.type_id, e.type_id IS NOT NULL AS hit, strict FROM p LEFT JOIN present e USING (type_id), (VALUES (true), (false)) v(strict))
        SELECT CASE WHEN hit THEN type_id::varchar WHEN strict THEN 'skipped' ELSE 'fallback' END AS route, count(*) AS n, strict FROM r GROUP BY 1, 3""",
    "segment_sample": f"""WITH {_status_of(0)}, sized AS (SELECT *, n // 500 + 1 AS k FROM ords),
        placed AS (SELECT *, least(ord // greatest(n // k, 1), k - 1) AS segment, greatest(1, 500 // k) AS quota FROM sized)
        SELECT seq, eval_id, segment FROM placed
        QUALIFY row_number() OVER (PARTITION BY segment ORDER BY md5(concat_ws('|', 42, eval_id)), seq) <= quota""",
    "shard_contiguous": f"WITH {_status_of(0)} SELECT eval_id, ord, ({_SHARD7})::bigint AS shard FROM ords",
    "shard_ceil": f"WITH {_status_of(0)} SELECT eval_id, ord, (ord // ((n + 15) // 16))::bigint AS shard FROM ords",
    "shard_modulo": f"WITH {_status_of(0, 'corpus_raw')} SELECT doc_id, ord, ord % 5 AS shard FROM ords",
    "resume_antijoin": f"SELECT eval_id, seq FROM {fx('eval_cases')} WHERE eval_id NOT IN (SELECT eval_id FROM {fx('done_keys')})",
    "resume_history": f"SELECT eval_id, seq FROM {fx('eval_cases')} WHERE eval_id NOT IN (SELECT eval_id FROM {fx('done_keys')})",
    "resume_incremental": f"""WITH {_FEATURES} SELECT doc_id, substr(text, 1, 2048) AS text, {ints('rule_hints')} AS hints FROM hinted
        WHERE text <> '' AND len(rule_hints) > 0""",
    "request_batches": f"WITH {_status_of(0)} SELECT eval_id, ord // 64 AS batch FROM ords",
    "render_prompt": f"WITH {_PROMPTS} SELECT seq, prompt FROM prompts",
    "render_corpus_prompt": f"""WITH {_FEATURES} SELECT doc_id, {_filled('classify_corpus', {
        'text': 'substr(text, 1, 2048)',
        'rule_hints': "CASE WHEN len(rule_hints) > 0 THEN array_to_string(rule_hints, ', ') ELSE 'none' END"})} AS prompt FROM hinted""",
    "type_instruction": f"""WITH t AS (SELECT (type_id + CASE WHEN seq % 7 = 0 THEN 40 ELSE 0 END)::bigint AS type_id FROM {fx('eval_cases')})
        SELECT type_id, {_GUIDE} AS guide, count(*) AS n FROM t GROUP BY 1, 2""",
    "chat_messages": f"""WITH {_PROMPTS} SELECT seq, 0::bigint AS place, 'system' AS role, md5({text(STAGES['synthesize'].system)}) AS content_md5 FROM prompts
        UNION ALL SELECT seq, 1, 'user', md5(prompt) FROM prompts""",
    "gen_params": f"""WITH {_PROMPTS} SELECT sha256(concat_ws('|', 'synthesize', '2048,16384,0.7,0.8,20,1.05,42', seq, prompt)) AS request_id, 0.7::double AS temperature, 0.8::double AS top_p,
        1.05::double AS repetition_penalty, 32::bigint AS batch_size, 2048::bigint AS max_tokens, 16384::bigint AS max_model_len, 20::bigint AS top_k, 42::bigint AS seed FROM prompts""",
    "infer_batches": f"WITH {_PROMPTS} SELECT seq, concat('words: ', len({tokens('prompt')})) AS synthesis_result FROM prompts",
    "length_gate": f"""WITH {_PROMPTS}, c AS (SELECT seq, len({tokens('prompt')}) AS n FROM prompts)
        SELECT seq, n AS prompt_tokens, n <= 300 AS sendable, CASE WHEN n <= 300 THEN concat('words: ', n) ELSE '' END AS result FROM c""",
    "parse_json_last_block": f"WITH {_EXPECTED} SELECT doc_id, ok, origin, matched_inner, {ints('listed')} AS types FROM expected",
    "parse_json_balanced": f"""WITH {_EXPECTED} SELECT doc_id, ok, origin,
        CASE WHEN doc_id % 9 = 3 THEN concat({_T1}, ',', {_T2}) ELSE {ints('listed')} END AS types FROM expected""",
    "draft_and_input": f"""WITH {_STORIES} SELECT seq, CASE WHEN {_parsed('synthesis_result')} THEN coalesce(sp, '') ELSE synthesis_result END AS draft_problem,
        CASE WHEN {_parsed('synthesis_result')} THEN coalesce(si, '') ELSE '' END AS draft_input FROM stories""",
    "story_fields": f"WITH {_STORIES} SELECT seq, story_problem, story_input, story_origin FROM stories",
    "synth_records": f"""WITH {_STORIES} SELECT id, title, type_id::bigint AS type_id, sample_idx::bigint AS sample_idx, story_problem AS problem,
        story_input AS input, 0::bigint AS rating FROM stories WHERE {strip('story_input')} <> ''""",
    "instrumented_code": f"WITH {_PROGRAMS} SELECT id, language, code, analysis FROM first_usable",
    "classification_fields": f"WITH {_CLASSES} SELECT * FROM classes",
    "kernel_text": f"""SELECT id, CASE WHEN coalesce({_safe('raw', 'text')}, '') <> '' THEN {_safe('raw', 'text')} ELSE question END AS refined_question
        FROM {fx('kernel_responses')}""",
    "generated_inputs": f"WITH {_SUITES} SELECT suite, place, input, level FROM listed",
    "cot_fields": f"WITH {_COT} SELECT eval_id, parse_ok, verified, coalesce(num_steps, -1) AS num_steps, reasoning, mismatch_reason FROM cot",
    "round_robin_templates": f"""WITH {_STORIES},
        tpl AS (SELECT id, story_problem, story_input, row_number() OVER (PARTITION BY id ORDER BY seq) - 1 AS i,
          count(*) OVER (PARTITION BY id) AS m FROM stories WHERE story_origin IS NOT NULL),
        turns AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY seq) - 1 AS j FROM {fx('eval_cases')})
        SELECT c.eval_id, c.problem_id, t.i AS template_idx, t.story_problem, t.story_input AS original_input, c.input AS new_input, c.expected_output
        FROM turns c JOIN tpl t ON t.id = c.problem_id AND t.i = c.j % t.m""",
    "fuse_funnel": f"""WITH {_STORIES}, known AS (SELECT DISTINCT id FROM stories WHERE story_origin IS NOT NULL)
        SELECT CASE WHEN k.id IS NULL THEN 'no_template' ELSE 'fused' END AS fuse_status, count(*) AS n
        FROM {fx('eval_cases')} e LEFT JOIN known k ON k.id = e.problem_id GROUP BY 1""",
    "shard_read_report": f"""SELECT ord // CAST(ceil(n / 16.0) AS BIGINT) AS shard, true AS readable, count(*) AS n FROM (
        SELECT row_number() OVER (ORDER BY seq) - 1 AS ord, count(*) OVER () AS n FROM {fx('eval_cases')}) GROUP BY 1""",
    "exchange_repeated_rows": f"""SELECT e.seq, e.input, c.copy::bigint AS copy, len(e.input)::varchar AS answer FROM {fx('eval_cases')} e, (VALUES (0), (1)) c(copy) WHERE c.copy = 0 OR e.seq % 3 = 0""",
    "exchange_resumed": f"""SELECT CASE WHEN seq % 2 = 0 THEN 'first' ELSE 'second' END AS answered_by, count(*) AS n FROM {fx('eval_cases')} GROUP BY 1""",
    "resume_added_inputs": f"""SELECT problem_id, source, input, count(*) AS n FROM {fx('eval_cases')} WHERE seq % 4 = 0 GROUP BY ALL""",
    "template_stats": f"""WITH {_STORIES} SELECT count(*) AS templates, count(DISTINCT id) AS problems, count(*) / greatest(count(DISTINCT id), 1) AS avg_per_problem
        FROM stories WHERE story_origin IS NOT NULL""",
    "code_join": f"""WITH {_FIRST_CODE} SELECT e.eval_id, c.code, CASE WHEN c.code IS NULL THEN '' ELSE {_case_of('c."programmingLanguage"', _RUNNERS)} END AS runner,
        CASE WHEN c.code IS NULL THEN 'no_code' ELSE 'ready' END AS code_status FROM {fx('eval_cases')} e LEFT JOIN codes c ON c.id = e.problem_id""",
    "test_input_union": f"""WITH g AS (SELECT id, unnest(test_cases) AS c FROM {fx('executed_tests')}), o AS (SELECT id, unnest(official_tests) AS c FROM {fx('qa')})
        SELECT id AS problem_id, concat('level_', coalesce(c.level, 'C')) AS source, c.input AS input, c.output AS expected_output FROM g
          WHERE c.status = 'success' AND c.input <> '' AND c.output <> ''
        UNION ALL SELECT id, 'official', c.input, c.output FROM o WHERE c.input <> '' AND c.output <> ''
        UNION ALL SELECT problem_id, 'synthesized', input, {strip('stdout')} FROM {fx('runs')} WHERE return_code = 0 AND {strip('stdout')} <> ''""",
    "trace_join": f"""WITH {_TRACES} SELECT eval_id, problem_id, title, source, problem, expected_output AS answer, raw_stdout, instrumented_code
        FROM candidates WHERE trace_status = 'matched'""",
    "trace_join_funnel": f"WITH {_TRACES} SELECT trace_status, count(*) AS n FROM candidates GROUP BY 1",
    "eval_keys": f"""WITH {_status_of(0)} SELECT seq, concat_ws('::', problem_id, source, ord) AS trace_id, concat_ws('::', problem_id, 'synth', seq) AS synth_id FROM ords""",
    "run_batches": f"""SELECT eval_id AS request_id, seq % 50 <> 7 AS success, CASE WHEN seq % 50 = 7 THEN -1 ELSE 0 END::bigint AS return_code,
        CASE WHEN seq % 50 = 7 THEN '' ELSE concat('cpp:', input, chr(10)) END AS stdout,
        CASE WHEN seq % 50 = 7 THEN 'max retries exceeded' ELSE '' END AS stderr FROM {fx('eval_cases')}""",
    "golden_outputs": f"""SELECT problem_id, seq, 'synthesized' AS source, input, {strip('stdout')} AS expected_output FROM {fx('runs')}
        WHERE return_code = 0 AND {strip('stdout')} <> ''""",
    "split_trace": f"WITH {_SPLIT} SELECT seq, coalesce(array_to_string(traces, chr(10)), '') AS traces, actual_output FROM split",
    "output_match": f"WITH {_MATCHED} SELECT seq, success, output_matched FROM matched",
    "answer_match": """WITH p AS (SELECT l_linenumber, l_extendedprice::decimal(18,2) AS price FROM lineitem)
        SELECT l_linenumber::bigint AS l_linenumber, l_linenumber % 3 <> 0 OR price = 0 AS matched, count(*) AS n FROM p GROUP BY 1, 2
        UNION ALL SELECT l_linenumber::bigint + 100, l_linenumber % 2 = 0, count(*) FROM lineitem GROUP BY 1, 2""",
    "run_funnel": f"""WITH {_MATCHED}, {_FIRST_CODE} SELECT CASE WHEN m.eval_id IN (SELECT eval_id FROM {fx('done_keys')}) THEN 'done'
        WHEN c.code IS NULL THEN 'no_code' WHEN NOT success THEN 'fail' WHEN output_matched THEN 'success' ELSE 'mismatch' END AS run_status,
        count(*) AS n FROM matched m LEFT JOIN codes c ON c.id = m.problem_id GROUP BY 1""",
    "trace_events": f"""WITH {_EVENTS} SELECT e.seq, e.line_no, e.label, coalesce(string_agg(CASE WHEN p.key IS NOT NULL THEN concat(p.key, '=', p.value) END, ';' ORDER BY p.key), '') AS fields
        FROM events_out e LEFT JOIN pairs_last p USING (seq, line_no) GROUP BY 1, 2, 3""",
    "trace_key_stats": f"""WITH {_EVENTS} SELECT problem_id, label, key, count(*) AS n, arg_min(value, (seq, line_no)) AS first_value,
        arg_max(value, (seq, line_no)) AS last_value FROM pairs_last GROUP BY 1, 2, 3""",
    "trace_label_stats": f"""WITH {_EVENTS} SELECT e.problem_id, e.label, count(DISTINCT (e.seq, e.line_no)) AS events, count(DISTINCT p.key) AS distinct_keys
        FROM events_out e LEFT JOIN pairs_last p USING (seq, line_no) GROUP BY 1, 2""",
    "trace_budget": f"""WITH {_SPLIT} SELECT seq, len(traces) AS trace_lines, len(list_filter(traces, lambda q: NOT regexp_matches(q, {_WELL_FORMED}))) AS malformed_lines,
        len(traces) > 20 AS over_budget FROM split""",
    "taxonomy_valid": f"""WITH {_CLASSES} SELECT id, CASE WHEN is_new THEN 'new' WHEN type_level1 NOT IN ('1','2','3','4','5') THEN 'bad_level1'
        WHEN type_level2 NOT IN ({', '.join(map(text, lexicon.TAXONOMY))}) THEN 'bad_level2'
        WHEN string_split(type_level2, '.')[1] <> type_level1 THEN 'mismatch' ELSE 'valid' END AS taxonomy_status FROM classes""",
    "length_window": f"""WITH {_STORIES}, c AS (SELECT seq, story_origin, len({tokens('story_problem')}) AS words FROM stories WHERE story_origin IS NOT NULL)
        SELECT *, CASE WHEN story_origin = 'draft' THEN words >= 200 ELSE words BETWEEN 150 AND 400 END AS in_window FROM c""",
    "input_preserved": f"""WITH {_STORIES} SELECT seq, si IS NOT DISTINCT FROM ri AS preserved FROM stories
        WHERE {_parsed('synthesis_result')} AND {_parsed('refined_result')}""",
    "value_coverage": f"""WITH c AS (SELECT seq, list_distinct(string_split(new_input, ' ')) AS v, {_safe('fused_result', 'problem')} AS problem
          FROM {fx('fused')} WHERE {_parsed('fused_result')}),
        f AS (SELECT seq, len(v) AS value_count, len(list_filter(v, lambda q: regexp_matches(problem, concat('(^|\\W)', q, '(\\W|$)')))) AS values_found FROM c)
        SELECT *, values_found / greatest(value_count, 1) AS coverage FROM f""",
    "banned_terms": f"WITH {_COT} {_terms('cot', 'eval_id', 'reasoning', lexicon.REASONING_BANNED)}",
    "banned_question_terms": _terms(fx("questions"), "doc_id", "question", lexicon.QUESTION_BANNED),
    "step_check": f"""WITH {_COT}, s AS (SELECT *, list_transform(regexp_extract_all(reasoning, '(?m)^Step (\\d+):', 1), lambda q: q::bigint) AS steps FROM cot WHERE verified)
        SELECT eval_id, len(steps) AS steps_found, CASE WHEN len(steps) = 0 THEN 'no_steps' WHEN steps <> range(1, len(steps) + 1) THEN 'gap'
        WHEN num_steps IS DISTINCT FROM len(steps) THEN 'wrong_count' ELSE 'ok' END AS step_status FROM s""",
    "test_suite_mix": f"""WITH {_SUITES} SELECT suite, count(*) FILTER (level = 'A') AS level_a, count(*) FILTER (level = 'B') AS level_b,
        count(*) FILTER (level = 'C') AS level_c, count(*) - count(DISTINCT input) AS repeats, count(*) FILTER (length(input) > 1000) AS over_long,
        count(*) FILTER (level = 'A') = 5 AND count(*) FILTER (level = 'B') = 5 AND count(*) FILTER (level = 'C') = 20 AS mix_ok FROM listed GROUP BY 1""",
    "instrument_readonly": f"""WITH {_PROGRAMS},
        a AS (SELECT seq, {strip('unnest(string_split(original, chr(10)))')} AS line FROM usable), b AS (SELECT seq, {strip('unnest(string_split(code, chr(10)))')} AS line FROM usable),
        ca AS (SELECT seq, line, count(*) AS n FROM a WHERE line <> '' GROUP BY 1, 2), cb AS (SELECT seq, line, count(*) AS n FROM b WHERE line <> '' GROUP BY 1, 2),
        d AS (SELECT coalesce(ca.seq, cb.seq) AS seq, coalesce(ca.line, cb.line) AS line, coalesce(ca.n, 0) - coalesce(cb.n, 0) AS net
          FROM ca FULL JOIN cb ON ca.seq = cb.seq AND ca.line = cb.line),
        t AS (SELECT seq, sum(greatest(net, 0))::bigint AS lost_lines, sum(CASE WHEN contains(line, '[TRACE]') THEN 0 ELSE greatest(-net, 0) END)::bigint AS unmarked_lines FROM d GROUP BY 1)
        SELECT *, lost_lines = 0 AND unmarked_lines = 0 AS read_only FROM t""",
    "trace_plan_parity": f"""WITH {_PROGRAMS}, c AS (SELECT seq, json_array_length(instrument_result, '$.trace_plan')::bigint AS plan_entries,
        len(string_split(code, '[TRACE]')) - 1 AS trace_statements FROM usable) SELECT *, plan_entries = trace_statements AS plan_matches FROM c""",
    "sft_records": f"""WITH {_COT} SELECT eval_id, type_id::bigint AS type_id, rating::bigint AS rating, 'user' AS role_1, problem AS content_1,
        'assistant' AS role_2, reasoning AS content_2 FROM cot WHERE verified AND {strip('reasoning')} <> ''""",
    "stage_yield": f"""WITH {_pairs(3)}, {_TRACES}, {_COT}, k AS (SELECT unnest(range(1, 6)) AS type_id)
        SELECT type_id, (SELECT count(*) FROM problems p WHERE p.type_id = k.type_id) AS problems,
          (SELECT count(*) FROM pairs p WHERE p.type_id = k.type_id) AS pairs,
          (SELECT count(*) FROM {fx('fused')} f WHERE f.type_id = k.type_id) AS cases,
          (SELECT count(*) FROM candidates c WHERE c.type_id = k.type_id AND trace_status = 'matched') AS matched,
          (SELECT count(*) FROM cot c WHERE c.type_id = k.type_id AND verified) AS verified FROM k""",
    "synthesize_problems": f"""WITH {_pairs(2)}, texts AS (SELECT id, {_problem(False)} AS problem FROM {fx('qa')})
        SELECT p.id, p.type_id::bigint AS type_id, p.sample_idx::bigint AS sample_idx, t.problem AS original_problem, p.corpus_text, md5({_filled('synthesize', {
            'type_id': 'p.type_id::varchar', 'type_instruction': _GUIDE, 'text': 'p.corpus_text', 'problem': 't.problem'})}) AS synthesis_result
        FROM pairs p JOIN texts t USING (id)""",
    "refine_problems": f"""WITH {_STORIES}, d AS (SELECT *, CASE WHEN {_parsed('synthesis_result')} THEN coalesce(sp, '') ELSE synthesis_result END AS draft,
          CASE WHEN {_parsed('synthesis_result')} THEN coalesce(si, '') ELSE '' END AS draft_in FROM stories)
        SELECT id, sample_idx::bigint AS sample_idx, title, md5({_filled('refine', {'draft_problem': 'draft', 'input': 'draft_in', 'corpus': 'corpus_text'})}) AS refined_result FROM d""",
    "fuse_inputs": f"""WITH {_STORIES},
        tpl AS (SELECT id, story_problem, story_input, row_number() OVER (PARTITION BY id ORDER BY seq) - 1 AS i,
          count(*) OVER (PARTITION BY id) AS m FROM stories WHERE story_origin IS NOT NULL),
        turns AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY seq) - 1 AS j FROM {fx('eval_cases')})
        SELECT c.eval_id, t.i::bigint AS template_idx, t.story_input AS original_input, c.input AS new_input, md5({_filled('fuse_input', {
            'problem': 't.story_problem', 'original_input': 't.story_input', 'new_input': 'c.input'})}) AS fused_result
        FROM turns c JOIN tpl t ON t.id = c.problem_id AND t.i = c.j % t.m""",
    "execute_instrumented": f"""WITH {_PROGRAMS}, c AS (SELECT *, sha256(concat_ws('|', problem_id, source, sha256({_INPUT_KEY.format('input')}))) AS content,
          split_part(input, ' ', 1)::bigint AS n FROM {fx('eval_cases')}),
        k AS (SELECT *, substr(sha256(concat_ws('|', content, row_number() OVER (PARTITION BY content ORDER BY seq) - 1)), 1, 32) AS run_key FROM c),
        r AS (SELECT k.*, (n % 97 + CASE WHEN n % 11 = 3 THEN 1 ELSE 0 END)::varchar AS answer, p.analysis FROM k JOIN first_usable p ON p.id = k.problem_id
          WHERE n % 50 <> 7 AND n % 13 <> 4)
        SELECT concat_ws('::', problem_id, source, run_key) AS trace_id, seq, problem_id, source, input, expected_output, answer AS actual_output,
          answer = expected_output AS output_matched, concat('[TRACE] read | n=', n) AS traces, concat('[TRACE] read | n=', n, chr(10), answer, chr(10)) AS raw_stdout, analysis FROM r""",
    "synthesize_reasoning": f"""WITH {_TRACES} SELECT eval_id, problem_id, source, md5({_filled('reasoning', {
            'problem': 'problem', 'answer': 'expected_output', 'instrumented_code': 'instrumented_code', 'raw_stdout': 'raw_stdout'})}) AS cot_result
        FROM candidates WHERE trace_status = 'matched'""",
    "synthesis_requests": f"""WITH {_pairs(3)}, texts AS (SELECT id, {_problem(False)} AS problem FROM {fx('qa')}),
        filled AS (SELECT p.id, p.type_id, p.sample_idx, p.corpus_id, {_filled('synthesize', {
            'type_id': 'p.type_id::varchar', 'type_instruction': _GUIDE, 'text': 'p.corpus_text', 'problem': 't.problem'})} AS prompt
          FROM pairs p JOIN texts t USING (id))
        SELECT *, sha256(concat_ws('|', 'synthesize', '2048,16384,0.7,0.8,20,1.05,42', id, sample_idx, prompt)) AS request_id FROM filled""",
}
