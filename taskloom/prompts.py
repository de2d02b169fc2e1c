"""Stage settings and default prompt texts (own wording; pass your own to override).

Placeholders are filled by literal replacement in the listed order.
"""

from dataclasses import dataclass

DEFAULT_TYPE = 3


@dataclass(frozen=True)
class Stage:
    batch_size: int
    max_tokens: int
    max_model_len: int
    temperature: float
    top_p: float | None
    top_k: int | None
    repetition_penalty: float | None
    system: str | None
    placeholders: tuple[str, ...]
    template: str
    seed: int = 42


_JSON_ONLY = "Answer with one JSON object and nothing else."

# Batch sizes, token budgets and sampling settings per stage.
STAGES = {
    "classify_problem": Stage(
        128, 1024, 131072, 0.0, 0.8, 20, 1.05,
        "You judge which kind of thinking a task needs.",
        ("question", "tags", "editorial"),
        "Imagine solving this task with pencil and paper. Name the task code that fits best.\n"
        + _JSON_ONLY + " Keys: core_step, level1, level2, new, reason.\n\n"
        "Task:\n{question}\n\nTags: {tags}\n\nKnown solution:\n{editorial}\n",
    ),
    "extract_kernel": Stage(
        128, 1024, 131072, 0.0, 0.8, 20, 1.05,
        "You restate tasks without their story.",
        ("question",),
        "Say what is given and what is asked, keeping every limit and rule.\n"
        + _JSON_ONLY + " Key: text.\n\nTask:\n{question}\n",
    ),
    "classify_corpus": Stage(
        64, 512, 4096, 0.1, 0.9, None, None,
        None,
        ("text", "rule_hints"),
        "Which task types (1 layout, 2 characters, 3 numbers, 4 records, 5 process) can this passage carry?\n"
        "A quick scan suggests: {rule_hints}. Correct it where the passage says otherwise.\n"
        + _JSON_ONLY + " Keys: suitable_types, reasons.\n\nPassage:\n{text}\n",
    ),
    "synthesize": Stage(
        32, 2048, 16384, 0.7, 0.8, 20, 1.05,
        "You write exam questions set in the real world.",
        ("type_id", "type_instruction", "text", "problem"),
        "Retell the task as an exam question inside the world of the passage (type {type_id}).\n"
        "{type_instruction}\n" + _JSON_ONLY + " Keys: problem, input.\n\n"
        "Passage:\n{text}\n\nTask:\n{problem}\n",
    ),
    "refine": Stage(
        200, 2048, 16384, 0.7, 0.8, 20, 1.05,
        "You edit exam questions until they read as one story.",
        ("draft_problem", "input", "corpus"),
        "Make story and question one piece of 150 to 400 words. Keep the input as it is.\n"
        + _JSON_ONLY + " Keys: problem, input.\n\n"
        "Draft:\n{draft_problem}\n\nInput:\n{input}\n\nPassage:\n{corpus}\n",
    ),
    "generate_tests": Stage(
        100, 16384, 16384, 0.3, 0.8, 20, 1.05,
        "You design small test inputs that catch wrong reasoning.",
        ("problem", "code", "language"),
        "Write a Python program that prints one list of 30 inputs: 5 minimal, 5 traps, 20 guided random.\n\n"
        "Task:\n{problem}\n\nSolution ({language}):\n{code}\n",
    ),
    "fuse_input": Stage(
        200, 2048, 16384, 0.7, 0.8, 20, 1.05,
        "You update the figures of an exam question.",
        ("problem", "original_input", "new_input"),
        "Rewrite the question so that every new value stands in the text; change nothing else.\n"
        + _JSON_ONLY + " Key: problem.\n\n"
        "Question:\n{problem}\n\nOld values:\n{original_input}\n\nNew values:\n{new_input}\n",
    ),
    "instrument": Stage(
        100, 16384, 16384, 0.3, 0.8, 20, 1.05,
        "You add print statements to programs without changing them.",
        ("problem", "code", "language"),
        "Add at most 20 lines of output of the form: [TRACE] label | key=value | key=value\n"
        + _JSON_ONLY + " Keys: analysis, trace_plan, instrumented_code.\n\n"
        "Task:\n{problem}\n\nProgram ({language}):\n{code}\n",
    ),
    "reasoning": Stage(
        100, 4096, 32768, 0.7, 0.8, 20, 1.05,
        "You explain answers in the words of the story.",
        ("problem", "answer", "instrumented_code", "raw_stdout"),
        "Check the program's output against the answer. If they agree, explain in lines 'Step 1:', 'Step 2:', …\n"
        + _JSON_ONLY + " Keys: verified, num_steps, reasoning, or verified and mismatch_reason.\n\n"
        "Question:\n{problem}\n\nAnswer:\n{answer}\n\nProgram:\n{instrumented_code}\n\nOutput:\n{raw_stdout}\n",
    ),
}

_GUIDES = {
    1: "Layout: let places and objects of the passage form the grid or map.",
    2: "Characters: quote one to four sentences and ask about their letters.",
    3: "Numbers: take at least two figures from the passage and calculate with them.",
    4: "Records: turn the listed entries into a data set to filter, sort or total.",
    5: "Process: follow the passage's own rules step by step from a given start.",
}

# Both languages carry English guides; a caller may pass another table.
TYPE_GUIDES = {"en": _GUIDES, "zh": dict(_GUIDES)}
