"""Names, limits and lists that decide results.

They have to agree with the system whose results are matched, so they are kept
together here and nowhere else.
"""

from __future__ import annotations

# Labels and rule versions.
SIGNIFICANT = "significant"
INSIGNIFICANT_WHITESPACE = "insignificant_whitespace"
INSIGNIFICANT_COMMENT = "insignificant_comment"
INSIGNIFICANT_FORMAT = "insignificant_format"
RULE_FLOOR = "floor.v1"
RULE_LAYERED = "floor.v1+ast-js.v1"

# Extractor versions.
FEATURE_VERSION = "v1.floor"
FORMAT_VERSION = "v1.ast-js"
DEGRADED_SUFFIX = "+degraded"

# File statuses.
ADDED = "added"
DELETED = "deleted"
MODIFIED = "modified"
RENAMED = "renamed"
COPIED = "copied"
UNREADABLE = "unreadable"

# Chunk source types.
SOURCE_COMMIT = "commit_message"
SOURCE_PR_BODY = "pr_body"
SOURCE_PR_DISCUSSION = "pr_discussion"
SOURCE_DOC = "doc_file"

# Timeline roles, answer states and abstention reasons.
INTRODUCED = "introduced"
ROLE_MODIFIED = "modified"
ANSWERED = "answered"
ABSTAINED = "abstained"
LOW_CONFIDENCE = "low_confidence"
UNKNOWN_REPO = "unknown_repo"
SYMBOL_NOT_FOUND = "symbol_not_found"
NO_SIGNIFICANT_HISTORY = "no_significant_history"
SINGLE_UNCITED_COMMIT = "single_uncited_commit"
NO_HITS = "no_hits"
ALL_STALE = "all_stale"
INSUFFICIENT_PREFIX = "INSUFFICIENT_EVIDENCE"
EMPTY_GENERATION = "empty_generation: model returned no content"

# Comment markers and document extensions.
COMMENT_PREFIXES = ("//", "/*", "*", "#", "<!--", "%", ";", "--")
DOC_EXTENSIONS = (".md", ".markdown", ".mdx", ".rst", ".txt")
CODE_EXTENSIONS = (".js", ".jsx", ".ts", ".tsx")
PATCH_SKIP_PREFIXES = ("+++", "---", "@@", "diff ", "index ", "\\ No newline")

# Noise filter.
NOISE_PREFIXES = ("Merge ", "Revert ")
MIN_BODY_CHARS = 20

# Retrieval.
RRF_K = 60
STALE_BELOW = 0.34
K_DENSE = 50
K_SPARSE = 50
TOP_N = 20
MIN_FUSED = 50

# Chunk sizes.
HEADER_PATHS = 5
MAX_SUBCHUNK = 1_600
COMMENT_SEPARATOR = "\n---\n"
TITLE_CUT = 500
DOC_TITLE_CUT = 120

# Merge-request text limits.
MAX_PR_BODY = 60_000
MAX_DISCUSSION = 16_000
MAX_COMMENT = 2_000

# Evidence limits.
MAX_EVIDENCE_COMMITS = 14
MAX_EVIDENCE_BODY = 400
MAX_BUNDLE = 9_000
MAX_SNIPPETS = 3
SNIPPET_CHARS = 700
MAX_QUESTION_HITS = 10
MAX_HIT_BODY = 350
SHA_SHOWN = 9
TITLE_SHOWN = 120

# The host whose addresses name repositories.
REPO_HOST = "github.com"

# Guards.
MAX_HISTORY_COMMITS = 50_000

# Characters that count as white space, and the line breaks among them.
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_CLASS = (
    "\\t\\n\\x0b\\x0c\\r\\x1c-\\x1f \\x85\\u00a0\\u1680\\u2000-\\u200a"
    "\\u2028\\u2029\\u202f\\u205f\\u3000"
)
LINE_BREAK = "\\r\\n|[\\n\\x0b\\x0c\\r\\x1c-\\x1e\\x85\\u2028\\u2029]"

# English stop words of the Snowball list used by Postgres text search.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his "
    "himself she her hers herself it its itself they them their theirs themselves what "
    "which who whom this that these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of at by for "
    "with about against between into through during before after above below to from up "
    "down in out on off over under again further then once here there when where why how "
    "all any both each few more most other some such no nor not only own same so than too "
    "very s t can will just don should now"
).split()
