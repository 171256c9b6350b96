"""Fixed values that results depend on: what counts as missing, stop words, months, spellings."""

# Seven distinct sets of texts that count as missing, lower case, each for one context.
MISSING_NUMERIC = ("", "[]", "not provided", "not specified", "na", "n/a", "nan", "none")
MEANINGLESS_NUMERIC = ("999999", "-1", "na", "n/a", "nan", "none", "")
MISSING_TEXT = ("", "-", "--", "na", "n/a", "n.a.", "nan", "nat", "none", "null", "nil", "not provided", "not specified")
NO_EVIDENCE = ("nan", "na", "n/a", "none", "null", "")
MISSING_ANSWER = ("", "999999", "none", "nan", "null", "n/a", "na", "not provided", "not specified", "[]")
BLANK_RECORD = ("", "none", "nan", "null", "na", "n/a", "nat")
NO_REPORT_VALUE = (*BLANK_RECORD, "999999", "not provided", "not specified", "ilegal", "invalid_syntax", "[]")
MISSING_IN_ID = ("", "none", "nan", "nat", "null", "na", "n/a")

# Column names that hold a confidence, best first.
CONFIDENCE_NAMES = ("confidence_lv", "confidence", "conf", "score", "prob", "probability", "conf_level")

# Spellings that are one item.
SPELLINGS = {"flamming": "flaming", "smouldering": "smoldering"}

# Words left out of places and species.
STOPWORDS = tuple(
    "the a an of and in at on for to with by from near area region province city district county prefecture municipality "
    "town village river estuary wetland lake bay island islands sea ocean gulf coast valley plain plateau".split()
)

# Month names and their short forms.
MONTH_NAMES = "january february march april may june july august september october november december".split()
MONTHS = {name[:3]: k for k, name in enumerate(MONTH_NAMES, 1)} | {name: k for k, name in enumerate(MONTH_NAMES, 1)} | {"sept": 9}

# Answer items that are errors, as they are written.
BAD_ITEM = "ilegal"
BAD_ITEMS = ("", "ilegal", "invalid_syntax")

# Fields of a candidate's identity, and those in which MISSING_IN_ID is null.
ID_FIELDS = ("paper_index", "question_index", "round_index", "model", "item", "value", "unit", "evidence", "confidence_lv", "mce", "experimental", "request_fingerprint", "paper_fingerprint")
ID_TEXT_FIELDS = ("value", "unit", "evidence", "mce", "experimental")
