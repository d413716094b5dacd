"""Fixed values of the fund-flow model and tuning thresholds.

The first block holds values that must equal the traced pipeline's for the
results to agree (labels, role names, role texts, durations, grid size,
display formulas).  The second block holds engine thresholds of our own.
"""

# --- fixed values (must match the traced pipeline's output) -----------------
LABEL_MUTUAL = "mutual_transfer"
LABEL_EXIT = "thorchain_launder"

ROLE_ATTACKER = "attacker"
ROLE_VAULT = "thorchain"
ROLE_HOP = "pre-inter"
ROLE_DEFAULT = "inter"

# First match wins when a wallet carries several roles: lower number first.
ROLE_PRIORITY = {ROLE_ATTACKER: 1, ROLE_VAULT: 2, ROLE_HOP: 3}

# Wallet panel title per role; any other role shows its upper-cased name.
ROLE_TITLE = {
    "thorchain": "ATTACKER EXIT VIA THORCHAIN BRIDGE",
    "inter": "LAUNDERING ADDRESS",
    "pre-inter": "LAUNDERING ADDRESS",
}
# Legend text per role, shown upper-cased.
ROLE_LEGEND = {
    "attacker": "Attacker Entry",
    "pre-inter": "Hop Address",
    "inter": "Intermediate Node",
    "thorchain": "Bridge Exit",
}

MONTH_ABBR = ["Jan", "Feb", "Mar", "Apr", "May", "Jun",
              "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

SETTLE_MS = 36_000_000          # a transfer takes 10 h from start to arrival
FRAME_COUNT = 1000              # replay grid has FRAME_COUNT + 1 positions
SHORT_HEAD, SHORT_TAIL, SHORT_SEP = 6, 4, "....."
TAG_HEAD, TAG_SUFFIX = 8, "…"
WEIGHT_BASE, WEIGHT_DIVISOR, WEIGHT_CAP = 0.5, 400.0, 3.0
PAIR_CURVE_BASE, PAIR_CURVE_STEP, PAIR_CURVE_MOD = 30, 12, 180
GLOBAL_CURVE_BASE, GLOBAL_CURVE_STEP, GLOBAL_CURVE_MOD = 30, 17, 150
LABEL_MIN_AMOUNT = 0.01
ETH_DECIMALS, USD_DECIMALS = 4, 2
BLOCK_TIME_PATTERN = "yyyy-MM-dd HH:mm:ss.SSS z"

# --- engine thresholds (ours) ------------------------------------------------
# Canonical exact type for money; sums stay exact and are cast to DOUBLE last.
MONEY_TYPE = "decimal(38,18)"
# A membership list up to this many values becomes an IN-set literal; larger
# lists are joined (an IN-set of thousands of literals costs seconds of planning).
INLIST_MAX = 128
# A relation up to this many rows and bytes may be broadcast (both checked before use).
BROADCAST_MAX_ROWS = 1_000_000
BROADCAST_MAX_BYTES = 128 << 20
# An ordered window over at most this many rows runs as a plain window;
# larger ones use buckets + offsets.
LOCAL_WINDOW_MAX_ROWS = 1_000_000
# Target rows per bucket in the ranged strategy (a few hundred MB of event
# rows), so buckets fit in executor memory at any input size.
RANGED_ROWS_PER_PARTITION = 2_000_000
# Sampled rows per bucket that the splitters are taken from (they reach the driver).
SPLITTER_SAMPLES = 32
# Positions of the replay grid whose prefix sums run in one task.
GRID_BLOCK = 100_000
# Equal rows are written out again in pieces of at most this many.
REPEATS_PER_PIECE = 65_536
# A query that reads the action table more than once stores it when made from
# more order lines than this; from fewer, extracting it again is the cheaper.
REREAD_MAX_LINES = 1_000_000
