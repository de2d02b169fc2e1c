"""Explicit schemas of every table that is read as JSON lines. Nothing is inferred."""

_PAIR = "array<struct<input:string,output:string>>"

PROBLEMS_RAW = (
    "id string, contest_id string, index string, title string, description string, "
    f"input_format string, output_format string, examples {_PAIR}, tags array<string>, "
    "accepted_solutions array<struct<programmingLanguage:string,source:string>>, rating int"
)
QA = (
    "id string, contest_id string, index string, title string, question string, "
    f"refined_question string, input_format string, output_format string, note string, examples {_PAIR}, "
    "type_level1 string, type_level2 string, rating int, accepted_solutions "
    "array<struct<source:string,og_source:string,programmingLanguage:string,submission_id:string>>, "
    f"official_tests {_PAIR}"
)
CORPUS_RAW = "text string, quality_domain_txt string"
CORPUS_RULE = "text string, rule_hints array<int>"
CORPUS_CLASSIFIED = (
    "text string, rule_hints array<int>, suitable_types array<string>, "
    "reasons map<string,string>, raw_output string"
)
EXECUTED_TESTS = "id string, test_cases array<struct<level:string,status:string,input:string,output:string>>"
EVAL_CASES = (
    "eval_id string, problem_id string, title string, source string, type_id int, problem string, "
    "input string, expected_output string, rating int"
)
TRACE_RUNS = (
    "trace_id string, problem_id string, source string, input string, expected_output string, "
    "actual_output string, output_matched boolean, traces array<string>, raw_stdout string, analysis string"
)
