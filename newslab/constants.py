"""Values that the results depend on."""

# --- fixed values: must stay as they are for results to agree -----------------

STOP_WORDS = """
a an the and or but in on at to for
of with by from is are was were be been
being have has had do does did will would
could should may might shall can need must
it its this that these those i we you he
she they me him her us them my your his
our their what which who whom where when how
not no nor as if then than too very just
about above after again all also am any because
before between both each few more most other
over own same so some such up down out off
into through during here there only once s t
says said new vs per via
""".split()

LOOKBACK_DAYS = {"1w": 7, "1m": 30, "3m": 90, "6m": 180, "1y": 365}
LOOKBACK_MONTHS = {"all": None, "1y": 12, "6m": 6, "3m": 3, "1m": 1}

THRESHOLDS = [-0.2, -0.1, 0.0, 0.1, 0.2, 0.3, 0.4, 0.5]

HORIZONS = (1, 5, 10)             # trading days
TOP_N = 20
MIN_SHARED = 2                    # words
MIN_HEADLINE_CHARS = 5
MIN_SIMILARITY = 0.55
EMBED_BATCH = 64
HALF_LIFE_DAYS = 180
CLASS_CUT = 0.1                   # bullish above, bearish below the negative
SENTIMENT_SHARE = 0.4             # weight of sentiment in the composite score
PRICE_SHARE = 0.6
PRICE_SCALE = 20.0
FULL_SAMPLE = 20                  # matches at which confidence is undiscounted
MAX_CONFIDENCE = 95.0
LABEL_CUT = 10.0                  # composite score of a bullish verdict
CAPITAL = 1_000_000.0
TARGET_VOLATILITY = 0.40
MAX_WEIGHT = 1.0
COST = 0.0015                     # per unit of turnover
SIGNAL_THRESHOLD = 0.0
FILL_ROWS = 5
TRADING_DAYS = 252
LEAD_DAYS = 100                   # calendar days of prices before the first sentiment day
MIN_SENTIMENT_DAYS = 250
ROBUST_GAP = 0.10
EDGE_SHARPE = 0.10
DASHBOARD_FLOOR = "2000-01-01"
INDEX_ROW_GROUP = 100_000
INDEX_BUCKETS = 64  # folders of tickers in an index
UNSCORED = -1e9                   # stands in for a missing mean when picking the best
