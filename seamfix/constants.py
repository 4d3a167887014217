"""Fixed values that must equal the reference's for identical results.

Everything in this module is a plain constant; the logic that uses them
lives in ``seamfix.operators`` and ``seamfix.functions``.
"""

from __future__ import annotations

# --- fixed values (detection) -------------------------------------------
# Candidate delimiters tried by the whole-file vote.
CANDIDATE_DELIMITERS = [",", ";", "\t", "|", ":"]
# Tie-break order among candidates reaching the same share (stdlib sniffer
# preference order restricted to the candidates; pipe is not preferred).
DELIMITER_PREFERENCE = [",", "\t", ";", ":", "|"]
DEFAULT_DELIMITER = ","
# Characters never treated as a stray delimiter inside a value.
EXCLUDED_FROM_CANDIDACY = "-_.'\"@ "
MAX_PREAMBLE_LINES = 10
SNIFF_TAIL_LINES = 5
SAMPLE_LINES = 5

# Failure classes, in detection priority order.
FAILURE_PRIORITY = [
    "wrong_encoding",
    "wrong_delimiter",
    "header_detection",
    "no_header",
    "invisible_characters",
    "mixed_delimiter",
    "engine_selection",
    "single_column_malformation",
]

# --- fixed values (proposal / validation) --------------------------------
ENGINES = ["python", "c", "pyarrow"]
# Default prescription per class: (class, delimiter, encoding, header_row, engine)
DEFAULT_PRESCRIPTIONS = [
    ("wrong_delimiter", ";", "utf-8", 0, "python"),
    ("wrong_encoding", ",", "latin-1", 0, "python"),
    ("header_detection", ",", "utf-8", 1, "python"),
    ("engine_selection", ",", "utf-8", 0, "pyarrow"),
    ("single_column_malformation", ";", "utf-8", 0, "python"),
]

# --- fixed values (schema drift) ----------------------------------------
RENAME_HINT_FLOOR = 0.4
FUZZY_WEIGHT = 0.4
CONFIRMATION_WEIGHT = 0.6
CONFIDENCE_THRESHOLD = 0.7
# Execution rank of each operation kind.
OPERATION_RANK = {"assign_header": -1, "rename": 0, "cast": 1, "drop": 2, "add_default": 3}
# Default value per logical type for add_default.
TYPE_DEFAULTS = {"string": "UNKNOWN", "int64": "0", "float64": "0.0", "bool": "False", "datetime": None}
TYPE_ALIASES = {
    "string": "string", "str": "string", "object": "string", "text": "string",
    "int64": "int64", "int": "int64", "integer": "int64",
    "float64": "float64", "float": "float64", "double": "float64",
    "bool": "bool", "boolean": "bool",
    "datetime": "datetime",
}

# --- fixed values (error words) ----------------------------------------
ERR_SINGLE_COLUMN = "single_column_result"
ERR_OUTPUT_COLLIDES = "output_path_collides_with_source"
ERR_INVISIBLE_IN_OUTPUT = "invisible_characters_in_output_columns"
ERR_HEADER_OUT_OF_RANGE = "header_row_out_of_range"
ERR_NO_OUTPUT = "no_repaired_output_to_verify"

# --- fixed values (number grammar, Python float()/int() compatible) -------
FLOAT_RE = (
    r"(?i)^\s*[+-]?(?:(?:\d+(?:_\d+)*)(?:\.(?:\d+(?:_\d+)*)?)?(?:e[+-]?\d+(?:_\d+)*)?"
    r"|\.\d+(?:_\d+)*(?:e[+-]?\d+(?:_\d+)*)?|inf(?:inity)?|nan)\s*$"
)
INT_RE = r"^\s*[+-]?\d+(?:_\d+)*\s*$"

# --- fixed values (run tracking) ----------------------------------------
RUN_STATUS = {"succeeded": "FINISHED", "failed": "FAILED"}
RUN_STATUS_DEFAULT = "FINISHED"
OUTCOME_NODES = ["set_success", "set_failure", "set_rejected"]
