"""Names that results depend on."""

FREE_SUFFIX = "-free"
SINGLE_BEST = "or-tools_cp-sat-free"
SIGNIFICANT_COVERAGE = 100
#: Statuses of a result row that carry an objective.
SOLVED = ("S", "SC")
FAILED = ("UNK", "ERR")
ALPHA, BETA = 0.25, 0.75
PROBLEMS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
TOP3_KEYS = ("top3", "top_3", "suggested")
TIME_KEYS = ("time_seconds", "time")
DEFAULT_CONTEXT, CONTEXT_RESERVE = 250_000, 256
#: What a search's order of variables is called in reports.
SEARCH_VARIABLE = {
    "input_order": "the input order",
    "first_fail": "a first-fail strategy",
    "anti_first_fail": "an anti first-fail strategy",
    "smallest": "a smallest-domain strategy",
    "largest": "a largest-domain strategy",
}
#: What its choice of values is called.
SEARCH_VALUE = {
    "indomain_min": "assigning the minimum value",
    "indomain_max": "assigning the maximum value",
    "indomain_split": "splitting the domain",
    "indomain_split_random": "splitting the domain randomly",
}
#: How far it goes.
SEARCH_EXTENT = {"complete": "exploring the entire search space", "incomplete": "using an incomplete exploration strategy"}
#: What types of constraints are said to do.
CONSTRAINT_TEXT = {
    "int_lin_eq": "Linear equality constraints enforce that weighted sums of integer variables equal a constant",
    "int_lin_le": "Linear inequality constraints restrict weighted sums of integer variables to be less than or equal to a constant",
    "int_lin_ge": "Linear inequality constraints restrict weighted sums of integer variables to be greater than or equal to a constant",
    "int_eq": "Equality constraints enforce that pairs of integer variables take the same value",
    "int_ne": "Disequality constraints enforce that pairs of integer variables take different values",
    "int_le": "Ordering constraints enforce that one integer variable is less than or equal to another",
    "bool_clause": "Boolean clause constraints represent disjunctions over Boolean literals",
    "bool_clause_reif": "Reified Boolean clauses link the satisfaction of a clause to a Boolean variable",
    "bool2int": "Boolean-to-integer channeling constraints map Boolean values to integer variables",
    "all_different": "All-different constraints enforce that all involved variables take pairwise distinct values",
    "element": "Element constraints link a variable to a value selected from an array using an index",
    "int_times": "Multiplicative constraints enforce that one integer variable equals the product of two others",
    "int_max": "Maximum constraints bind a variable to the maximum value among a set of variables",
}

#: The wording of the published prompts. A prompt's segments are mode, place, text before, part, text behind.
QUESTION = "The goal is to determine which constraint programming solver would be best suited for this problem, considering the following options:\n\n"
QUESTION_END = "\n\nAnswer only with the name of the 3 best solvers inside square brackets separated by comma and nothing else."
QUESTION_END_REASONED = "\n\nAnswer with the name of the 3 best solvers inside square brackets separated by comma, followed by a short explanation of the main factors behind your choice."
SOLVER_HEAD = "Solvers and descriptions:\n"
SCRIPT_NOTE = "% [Model script truncated to fit model context window]\n"
SUMMARY_MARKER = "\n[TRUNCATED: fzn summary shortened to fit model context]\n"
PROMPT_SEGMENTS = [
    ("model", 1, "Problem description:\n", "description", "\n\n"),
    ("model", 2, "\n\nMiniZinc model:\n", "script", "\n\n"),
    ("model", 3, "MiniZinc data:\n", "data", "\n\n"),
    ("model", 4, "", "solver_text", "\n"),
    ("model", 5, "", "note", ""),
    ("model", 6, "", "question", ""),
    ("summary", 1, "Problem description:\n", "description", "\n\n"),
    ("summary", 2, "Given this description of a MiniZinc problem:\n", "summary", "\n\n"),
    ("summary", 3, "", "solver_text", "\n"),
    ("summary", 4, "", "question", ""),
]
