"""Workload constants.

Everything here is a parameter of some operator; the operators take these as
defaults, never as hard-wired literals.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values, defaults of the operators' parameters: window offsets in days,
# the week/month feature layout, the qualifying ledger codes, model settings,
# the nine sales cutoffs and the campaign projection.
# ---------------------------------------------------------------------------
MONTH_WINDOW_DAYS = 364          # month features: [end - 364, end]
LAG_WINDOW_DAYS = 50             # lag/week window: [end - 50, end]
ACTIVE_DAYS_EVALUATION = 90      # active window in evaluation: [end - 90, end]
CHURN_DAYS = 365                 # target window: [end + 1, end + 365]
N_WEEKS = 6                      # week buckets 1..6, 7 days each, counted back from end
N_MONTHS = 12                    # relative months 0..11
BACKTEST_PERIODS = 5             # backtest days 1..periods-1
BACKTEST_SHIFT_DAYS = 365        # backtest day i shifts every date by i + 365
PREDICTION_SHIFT_DAYS = 366      # scoring shifts the training dates by 366
EVALUATION_GAP_DAYS = 30         # evaluation training end: max date - 365 - 30
QUALIFYING_COMPANY = "10"
QUALIFYING_ORDER_TYPES = (61, 66)
SALES_CUTOFFS = (0, 1000, 5000, 10000, 15000, 20000, 50000, 150000, 500000)
EVALUATION_GBT = {"maxIter": 30, "maxDepth": 8, "seed": 42}
PRODUCTION_GBT = {"maxIter": 30, "maxDepth": 20, "seed": 42}
CATEGORICAL_INPUTS = ("CUSTCLASS", "REGION")
NUMERIC_INPUTS = (
    "Month_1", "Month_2", "Month_3", "Month_4", "Month_5", "Month_6",
    "Month_7", "Month_8", "Month_9", "Month_10", "Month_11",
    "Week_1", "Week_2", "Week_3", "Week_4", "Week_5", "Week_6",
    "feature_days_customer",
)
CAMPAIGN_COLUMNS = (
    "customer_level", "total_sales", "prediction", "NAME1", "COMMENT1", "TEL",
    "REGION", "DISTRICT", "CUSTCLASS", "CUSTCAT", "CREDATE", "SALESMAN",
    "COMPID", "EMAILLONG", "CITY", "SALESMAN_EMPLOYNAME", "SALESMAN_EMAIL",
    "CZSNI", "CZTURNOVER", "CZRATING",
)
# ---------------------------------------------------------------------------

MONTH_COLUMNS = tuple(f"Month_{k}" for k in range(N_MONTHS))
WEEK_COLUMNS = tuple(f"Week_{j}" for j in range(1, N_WEEKS + 1))

@dataclass(frozen=True)
class SegmentRule:
    """One campaign segment: churners above a sales level in one region.

    ``districts`` / ``categories`` empty means "any".
    """

    segment: str
    min_sales: float
    region: int
    districts: tuple[int, ...] = field(default_factory=tuple)
    categories: tuple[int, ...] = field(default_factory=tuple)


def fixture_segments() -> list[SegmentRule]:
    """Presets scaled to the test tables' prices and codes (regions 0-4,
    nations 0-24, categories 800-869)."""
    return [
        SegmentRule("a", 20000.0, 1, (1, 6), tuple(range(800, 840))),
        SegmentRule("b", 30000.0, 3, (3, 8, 13), tuple(range(810, 850))),
        SegmentRule("c", 50000.0, 4, (), tuple(range(830, 870))),
    ]
