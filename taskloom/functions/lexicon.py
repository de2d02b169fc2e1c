"""Fixed values. They must equal the published rules for results to agree."""

# Words that suggest a process or a sequence of states.
TEMPORAL_WORDS = (
    "first", "then", "next", "after", "step", "phase", "each round",
    "iteration", "finally", "subsequently", "cycle", "transition",
    "evolve", "simulate", "state", "repeat", "sequence", "procedure",
    "until", "while", "at each", "per step",
)

# Words that suggest a layout (" row" keeps its leading space).
SPATIAL_WORDS = (
    "north", "south", "east", "west", "left", "right", "grid", " row",
    "column", "adjacent", "diagonal", "coordinate", "positioned",
    "map", "layout", "horizontal", "vertical", "above", "below",
    "cell", "matrix", "floor plan", "corner",
)

# Domains whose texts may carry numbers.
NUMERIC_DOMAINS = ("technology", "education", "economics", "medical", "natural_science")

# Language names, in the order in which substrings are tried.
LANGUAGE_NAMES = (
    ("gnu c++", "cpp"), ("gnu c++11", "cpp"), ("gnu c++14", "cpp"),
    ("gnu c++17", "cpp"), ("gnu c++20", "cpp"), ("ms c++", "cpp"),
    ("c++", "cpp"), ("c", "c"),
    ("python 2", "python"), ("python 3", "python"), ("python", "python"),
    ("pypy 2", "python"), ("pypy 3", "python"), ("pypy", "python"),
    ("pypy 3-64", "python"),
    ("java", "java"), ("java 8", "java"), ("java 11", "java"),
    ("kotlin", "kotlin"),
    ("rust", "rust"), ("go", "go"),
    ("javascript", "javascript"), ("node.js", "javascript"),
    ("ruby", "ruby"), ("php", "php"),
)

# Two-level task codes.
TAXONOMY = (
    "1.1", "1.2", "1.3", "1.4",
    "2.1", "2.2", "2.3",
    "3.1", "3.2", "3.3",
    "4.1", "4.2", "4.3",
    "5.1", "5.2", "5.3",
)

# Programming traces that a question text must not show.
QUESTION_BANNED = (
    "input format", "output format", "algorithm", "time complexity",
    "given a positive integer", "print the answer", "n", "x", "i",
)

# Programming, code-reference and hedging terms banned in reasoning.
REASONING_BANNED = (
    "variable", "variables", "array", "arrays", "loop", "loops",
    "algorithm", "algorithms", "function", "functions", "index", "indices",
    "the code", "the trace", "codeforces", "competitive programming",
    "coding problem", "assuming", "it seems", "based on the given",
)
