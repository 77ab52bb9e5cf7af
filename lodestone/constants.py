"""Every threshold and fixed value of the engine."""

# Thresholds of retrieval, ranking and corpus rules.
EMBEDDING_DIM = 384
MAX_MODEL_TOKENS = 256
VECTOR_TOP_K = 50
MEAN_TOP_K = 3
BM25_TOP_K = 50
OVERLAP_CAP = 100
RESULTS_RETURNED = 3
WEIGHT_VECTOR, WEIGHT_FILE, WEIGHT_BM25 = 0.5, 0.3, 0.2
#: The runs whose best are judged: each signal alone, and two weightings of all.
POOL_RUNS = ((1.0, 0.0, 0.0), (0.0, 0.0, 1.0), (0.0, 1.0, 0.0), (0.5, 0.3, 0.2), (0.3, 0.3, 0.4))
REASON_HIGH_VECTOR = 0.7
REASON_HIGH_BM25 = 0.7

#: Rows of a side that may be broadcast, where it is counted first.
SMALL_ROWS = 10_000

#: Rows of one key that are folded in one row; more are spread.
FOLD_ROWS = 1_000

# BM25.
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25

# The corpus.
DUPLICATE_WINDOW_DAYS = 7
PER_PAGE = 100
GHOST_AUTHOR, DEFAULT_AUTHOR_TYPE = "ghost", "User"
REASON_BOT, REASON_HOUSEKEEPING, REASON_DUPLICATE = "bot_author", "housekeeping", "duplicate_resubmission"
REASON_NO_SOURCE, REASON_NO_DIFF = "no_source_content", "diff_unavailable"

# Accounts that are bots though they are reported as users, and titles of housekeeping changes.
BOT_ACCOUNTS = ("p5js-bot", "github-actions", "github-actions[bot]", "allcontributors", "allcontributors[bot]", "dependabot", "dependabot[bot]")
HOUSEKEEPING_TITLES = (
    r"chore:\s*update contributors\.png",
    r"chore:\s*update README table from stewards\.yml",
    r"(update|Update) stewards\.yml",
)
# Files that hold no source.
EXCLUDED_EXTENSIONS = (".md", ".txt", ".rst", ".po", ".lock", ".svg", ".map", ".obj", ".mtl", ".stl")
EXCLUDED_BASENAMES = ("package-lock.json", ".all-contributorsrc")
EXCLUDED_PATHS = (r"^translations/[^/]+/translation\.json$", r"^test/unit/visual/screenshots/")
# Keys of a raw item that are not kept, and how labels of an area begin.
DROPPED_KEYS = ("base", "head", "links", "_links")
AREA_PREFIX = "area:"
# Fixed value: added to the reason of a change that was closed without a merge.
CLOSED_SUFFIX = " — closed without merging, worth checking why"
# The parts of an identifier.
SUBTOKEN = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
# The head of a hunk, the line with a file's new path, and lines of a diff that are no content.
HUNK_HEADER = r"(?dm)^@@ -[0-9]+(?:,[0-9]+)? \+[0-9]+(?:,[0-9]+)? @@"
NEW_PATH = r"(?dm)^\+\+\+ (?:b/)?(.+)$"
DIFF_STRUCTURE = r"^(\+\+\+|---|diff|index|@@|new file|deleted file|rename)"
# The phrases of reasons.
SAID_BOTH, SAID_BOTH_END = "Both modify ", " with a similar change pattern"
SAID_FILE, SAID_PATTERN, SAID_TERMS, SAID_RELATED = "Also changes ", "Similar change pattern in ", "Shares terminology: ", "Related change in "
