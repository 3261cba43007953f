"""Fixed values that must equal the original task definitions for results to
agree (field lists, tags, prompt texts, reward points, formats).

FIXED VALUES — keep text, order and spelling exactly as given.
"""

from __future__ import annotations

# ---------------------------------------------------------------- FIXED VALUES
# Extraction task: the fields a completion must produce (scored list, 14).
RELEVANT_FIELDS = [
    "publication_number",
    "application_number",
    "patent_number",
    "date_published",
    "filing_date",
    "patent_issue_date",
    "abandon_date",
    "decision",
    "main_cpc_label",
    "main_ipcr_label",
    "title",
    "abstract",
    "summary",
    "claims",
]
# Fields kept when a raw record is projected (the scored list minus summary, claims).
PROJECTED_FIELDS = RELEVANT_FIELDS[:12]
# Date fields: the order constraint uses (filing <= published <= issued);
# the format bonus checks these four for ISO dates.
ORDER_DATE_FIELDS = ("filing_date", "date_published", "patent_issue_date")
ISO_DATE_FIELDS = ("filing_date", "date_published", "patent_issue_date", "abandon_date")
# Reward weights: validity, field mean, constraints, format.
EXTRACTION_WEIGHTS = (0.5, 0.4, 0.1, 0.05)
FORMAT_BONUS = 0.1
NORM_MAX_LEN = 4000

EXTRACTION_PROMPT_HEAD = "Extract the following fields as JSON only (no extra text). "
EXTRACTION_PROMPT_FIELDS = "Fields: {{{fields}}}\n\n"
EXTRACTION_PROMPT_DOC = "DOCUMENT:\n"
EXTRACTION_PROMPT_TAIL = "\n\nReturn strictly a single JSON object with those keys."
SFT_ANSWER_OPEN = "\n\n<answer>\n"
SFT_ANSWER_CLOSE = "\n</answer>"

# Reasoning format tags and the system prompt built from them.
REASONING_START = "<start_working_out>"
REASONING_END = "<end_working_out>"
SOLUTION_START = "<SOLUTION>"
SOLUTION_END = "</SOLUTION>"
MATH_SYSTEM_PROMPT = (
    "You are given a problem.\n"
    "Think about the problem and provide your working out.\n"
    f"Place it between {REASONING_START} and {REASONING_END}.\n"
    f"Then, provide your solution between {SOLUTION_START}{SOLUTION_END}"
)
DEFAULT_EOS = "<|endoftext|>"
THINK_OPEN = "<think>"
THINK_CLOSE = "</think>"
HASH_MARK = "####"

# Answer patterns (regular expressions, dot and line modes on).
FORMAT_PATTERN = r"(?dms)<end_working_out>.*?<SOLUTION>(.+?)</SOLUTION>[\s]{0,}(?:<\|endoftext\|>)?[\s]{0,}$"
NUMBER_PATTERN = r"(?dms)<SOLUTION>.*?[\s]{0,}([-]?[\d\.\,]{1,})"
GUESS_PATTERN = r"<guess>\s*([a-zA-Z]+)\s*</guess>"

# Reward points of the math rewards.
EXACT_FORMAT_POINTS = 3.0
APPROX_TAG_ONCE = 0.5
APPROX_TAG_ELSE = -1.0
ANSWER_NONE = -2.0
ANSWER_EQUAL = 5.0
ANSWER_EQUAL_STRIPPED = 3.5
ANSWER_RATIO_CLOSE = 2.0      # ratio in [0.9, 1.1]
ANSWER_RATIO_NEAR = 1.5       # ratio in [0.8, 1.2]
ANSWER_WRONG = -2.5
ANSWER_NOT_NUMERIC = -4.5
NUMBER_NONE = -2.5
NUMBER_EQUAL = 3.5
NUMBER_DIFFERENT = -1.5
NUMBER_UNPARSEABLE = 0.0

# Guess game.
GUESS_SYSTEM_PROMPT = (
    "You are a competitive game player.\n"
    "In each turn, output your guess inside <guess>...</guess> tags."
)
GUESS_TASK = "Guess the hidden 5-letter lowercase English word."
GUESS_WORDS = [
    "about", "other", "which", "their", "there", "after", "first", "would", "these", "could",
    "right", "think", "great", "point", "small", "world", "place", "under", "light", "words",
]
GUESS_FORMAT_BONUS = 0.1

# Group-relative reward.
GROUP_STD_EPS = 1e-6

# Email corpus build limits and search limits.
MAX_BODY_CHARS = 5000
MAX_RECIPIENTS = 30
MAX_SEARCH_RESULTS = 10
SNIPPET_TOKENS = 15
RANKING_PREVIEW_CHARS = 50
SNIPPET_OPEN = "<b>"
SNIPPET_CLOSE = "</b>"
SNIPPET_ELLIPSIS = " ... "
EMAIL_DATE_FORMAT = "yyyy-MM-dd HH:mm:ss"
RECIPIENT_TYPES = ("to", "cc", "bcc")

# Agent rollouts.
MAX_TURNS = 6
FINAL_ANSWER_TOOL = "return_final_answer"
AGENT_SYSTEM_PROMPT = (
    "\nYou are an email search agent. You are given a user query and a list of tools "
    "you can use to search the user's email. Use the tools to search the user's emails "
    "and find the answer to the user's query. You may take up to {max_turns} turns to "
    "find the answer, so if your first search doesn't find the answer, you can try "
    "with different keywords.\n\n"
    "User's email address is {inbox}\n"
    "Today's date is {query_date}\n"
)
JUDGE_SYSTEM_PROMPT = ("You are given a question, the reference answer and an answer of an assistant. "
                       "Accept the assistant's answer if it holds the relevant information of the reference answer.")
JUDGE_USER_TEMPLATE = "Question: {question}\nReference answer: {reference}\nAI answer: {answer}"

# Positional split and seeds.
TRAIN_FRACTION = 0.85
DEFAULT_SEED = 42

# Document rendering (text form of the record).
NO_TITLE = "No Title Available"
NOT_AVAILABLE = "N/A"
NO_ABSTRACT = "No abstract available."
COVER_NOTE = ("This document contains information about the patent’s abstract, "
              "claims, and detailed description.")
# ------------------------------------------------------------ END FIXED VALUES
