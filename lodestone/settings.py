"""Constants of the data model; every operator takes them as defaults of its parameters."""

# Domain limits, split sizes, ranking cutoffs, hyper-parameter grids and sampling sizes.
RATING_MIN, RATING_MAX = 0.0, 10.0
DATE_MIN, DATE_MAX = "2010-01-01", "2024-12-31"
SEED = 42
N_ANNOTATORS, MAX_ANNOTATORS, MIN_RATERS = 3, 5, 2
MIN_INTERACTIONS, N_HOLDOUT = 4, 2
CUTOFFS, TOP_N, SCORE_SEEDS = (5, 10), 10, (0, 1, 2)
BPR = {"factors": 32, "lr": 0.05, "reg": 0.01, "epochs": 40}
ALPHA_MIN, ALPHA_N0, ALPHA_TAU = 0.9, 4.0, 2.0
ALPHA_GRID = {"alpha_min": (0.0, 0.7, 0.8, 0.85, 0.9), "n0": (4.0, 5.0, 6.0), "tau": (1.0, 1.5, 2.0)}
RANGE_EPSILON = 1e-8
RIDGE_GRID = (10.0, 50.0, 100.0, 200.0, 500.0, 1000.0, 2000.0)
N_BOOT, BOOT_ALPHA = 10_000, 0.05
VOCABULARY = 4000
STRATA_SIZES = {"top": 100, "hard": 150, "random": 150}
HARD_JACCARD, HARD_SEQ = 0.34, 0.72
SHORT_NAME, TOP_NAMES = 3, 15
