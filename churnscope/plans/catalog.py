"""The named queries: one Spark plan and (where SQL can say it) one DuckDB
statement per key, both over the raw test tables of a scale-factor folder.

Standard dates on the test tables (data runs 1995-01-01 .. 2001-08-01):

* training as of 1999-06-30, backtest days 1-4 as of 2000-06-30 .. 2000-07-03
  (all 365-day labels mature);
* current prediction: train as of (newest posting - 365) with a 365-day
  active window, score one day after the newest posting.

Queries whose oracle needs a deterministic prediction use the rule score
(``operators.model.rule_score``); model-based keys have no SQL and are
checked on rows only.

Presentation (both engines): dates as ``yyyy-MM-dd`` text, money and nullable
counts as double, so value hashes do not depend on how each engine's client
represents dates, decimals or integer nulls.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnscope.config import (
    BACKTEST_PERIODS,
    CAMPAIGN_COLUMNS,
    CHURN_DAYS,
    EVALUATION_GBT,
    N_WEEKS,
    PRODUCTION_GBT,
    fixture_segments,
)
from churnscope.operators import asof as A
from churnscope.operators import campaign as C
from churnscope.operators import drift as D
from churnscope.operators import features as FE
from churnscope.operators import ledger_ops as L
from churnscope.operators import metrics as M
from churnscope.operators import model as MD
from churnscope.operators import trees as TR
from churnscope.plans import oracle as O
from churnscope.plans import pipelines as P
from churnscope.session import fresh_path, materialize, remove_path
from churnscope.sources import (
    normalise_register,
    qualify,
    read_bucketed,
    read_call_lists,
    read_ledger,
    read_register_snapshot,
    read_register_snapshots,
    write_bucketed,
    write_call_lists,
)
from churnscope.sources import fixtures as X

TRAIN_END = X.TRAINING_END
TRAIN_DAYS = [(0, TRAIN_END)]
BACKTEST_DAYS = [(i, TRAIN_END + dt.timedelta(days=i + 365)) for i in range(1, BACKTEST_PERIODS)]
LATEST_SQL = "(select max(POSTDATE) from ledger)"
PRED_TRAIN_DAYS = [(0, f"{LATEST_SQL} - {CHURN_DAYS}")]
PRED_SCORE_DAYS = [(0, f"{LATEST_SQL} - {CHURN_DAYS} + {CHURN_DAYS + 1}")]


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    dates: Sequence[str] = field(default_factory=tuple)
    doubles: Sequence[str] = field(default_factory=tuple)

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return present(self.build(spark, sf_dir), self.doubles)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        return present_sql(self.sql, self.dates, self.doubles)


def present(df: DataFrame, doubles: Sequence[str] = ()) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            cols.append(F.date_format(c, "yyyy-MM-dd").alias(f.name))
        elif isinstance(f.dataType, T.DecimalType) or f.name in doubles:
            cols.append(c.cast("double").alias(f.name))
        else:
            cols.append(c)
    return df.select(*cols)


def present_sql(sql: str, dates: Sequence[str], doubles: Sequence[str]) -> str:
    reps = [f"strftime({c}, '%Y-%m-%d') as {c}" for c in dates]
    reps += [f"cast({c} as double) as {c}" for c in doubles]
    if not reps:
        return sql
    return f"select * replace ({', '.join(reps)}) from (\n{sql}\n) q"


# ---------------------------------------------------------------------------
# Spark inputs
# ---------------------------------------------------------------------------

def _inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return X.ledger(spark, sf), X.register(spark, sf)


def _train(spark: SparkSession) -> A.AsOf:
    return A.training_day(spark, TRAIN_END)


def _frame(spark, sf, level="custno"):
    led, reg = _inputs(spark, sf)
    return FE.feature_frame(led, reg, _train(spark), level)


def _rule_backtest(spark, sf):
    led, reg = _inputs(spark, sf)
    days = A.backtest_days(spark, TRAIN_END)
    return P.backtest(None, led, reg, days), days


def _latest(spark, sf) -> dt.date:
    """The newest posting, from the newest extract alone."""
    return A.latest_posting_date(X.newest_extract(spark, sf))


def _rule_current(spark, sf, level="custno"):
    led, reg = _inputs(spark, sf)
    return P.predict_current(led, reg, level, use_model=False, checkpoint=False, latest=_latest(spark, sf)), reg


# ---------------------------------------------------------------------------
# SQL pieces
# ---------------------------------------------------------------------------

FRAME_DATES = ("CREDATE", "KILLDATE")
REG_DATES = ("CREDATE", "KILLDATE")


def frame_cte(name: str, days, level: str = "custno", with_label: bool = True,
              active_days: int = 90) -> str:
    return f"{name} as ({O.feature_frame_sql(days, level, with_label, active_days)})"


def rule_sql(frame: str, labelled: bool = True, keep: str = "") -> str:
    quiet = " and ".join(f"Week_{j} = 0" for j in range(1, N_WEEKS + 1))
    label = "cast(target_churn as double) as indexedLabel, " if labelled else ""
    return (f"select loop_day, customer_level, {keep}total_sales, {label}"
            f"case when {quiet} and UNIQUE_TRANSREFNO_ACTIVE <= 1 then cast(1 as double) "
            f"else cast(0 as double) end as prediction from {frame}")


BT_PREDS = (O.with_base(BACKTEST_DAYS) + ", " + frame_cte("ff", BACKTEST_DAYS)
            + f", preds as ({rule_sql('ff')})\n")
CUR = (O.with_base() + ", " + frame_cte("tf", PRED_TRAIN_DAYS, active_days=CHURN_DAYS) + ", "
       + frame_cte("sf", PRED_SCORE_DAYS, with_label=False, active_days=CHURN_DAYS)
       + f", preds as ({rule_sql('sf', labelled=False)})"
       + ", pe as (select p.*, r.* exclude (CUSTNO) from preds p left join register r"
         " on r.CUSTNO = p.customer_level)\n")


COMPANY = (O.with_base() + ", " + frame_cte("sf", PRED_SCORE_DAYS, "compid", with_label=False, active_days=CHURN_DAYS)
           + f", preds as ({rule_sql('sf', labelled=False, keep='CUSTNO, ')})"
           + ", pe as (select p.*, r.* exclude (CUSTNO) from preds p left join register r using (CUSTNO))\n")


YEAR = O.with_base(TRAIN_DAYS) + f", yr as ({O.year_rows()})\n"
LAG_ROWS = (O.with_base(TRAIN_DAYS)
            + ", lg as (select w.loop_day, l.CUSTNO as customer_level, l.TRANSREFNO, "
              "cast(date_diff('day', l.POSTDATE, w.e) as integer) as lag from ledger l "
              "join windows w on l.POSTDATE >= w.lag_start and l.POSTDATE < w.e)\n")
WEEK_ROWS = (O.with_base(TRAIN_DAYS)
             + ", wk as (select w.loop_day, l.CUSTNO as customer_level, l.TRANSREFNO, "
               "cast(floor(date_diff('day', l.POSTDATE, w.e) / 7) + 1 as integer) as Week_variable "
               "from ledger l join windows w on l.POSTDATE between w.lag_start and w.e "
               "where date_diff('day', l.POSTDATE, w.e) between 0 and 41)\n")
LIVE = (O.with_base(TRAIN_DAYS)
        + ", live as (select w.loop_day, r.CUSTNO as customer_level, r.*, "
          "case when r.KILLDATE < w.target_end then 1 else 0 end as killed, "
          "cast(date_diff('day', r.CREDATE, w.e) + 1 as integer) as feature_days_customer "
          "from register r cross join windows w "
          "where r.CREDATE <= w.e and (r.KILLDATE > w.e or r.KILLDATE is null))\n")


def _segments_sql(source: str) -> str:
    cols = ", ".join(f"cast(null as varchar) as {c}" if c in _MISSING else c for c in CAMPAIGN_COLUMNS)
    parts = []
    for r in fixture_segments():
        cond = [f"prediction = 1", f"total_sales > {r.min_sales}", f"REGION = {r.region}"]
        if r.districts:
            cond.append(f"DISTRICT in ({', '.join(map(str, r.districts))})")
        if r.categories:
            cond.append(f"CUSTCAT in ({', '.join(map(str, r.categories))})")
        parts.append(f"select '{r.segment}' as segment, {cols} from {source} where {' and '.join(cond)}")
    return "\nunion all\n".join(parts)


_MISSING = {"COMMENT1", "TEL", "SALESMAN", "EMAILLONG", "CITY", "SALESMAN_EMPLOYNAME", "SALESMAN_EMAIL",
            "CZSNI", "CZRATING"}


def _dynamics_sql() -> str:
    """Set differences written out directly (no closed form)."""
    return """
flag as (select distinct loop_day, customer_level from preds where prediction = 1),
days as (select loop_day from windows),
dyn as (
 select d.loop_day,
  (select count(*) from flag f where f.loop_day = d.loop_day) as predicted,
  (select count(*) from flag f where f.loop_day = d.loop_day and not exists
     (select 1 from flag g where g.customer_level = f.customer_level and g.loop_day < d.loop_day))
     as newly_classified,
  (select count(distinct g.customer_level) from flag g where g.loop_day < d.loop_day and not exists
     (select 1 from flag f where f.customer_level = g.customer_level and f.loop_day = d.loop_day))
     as fallen_out,
  (select count(distinct g.customer_level) from flag g where g.loop_day <= d.loop_day) as total_classified
 from days d)
"""


CONFUSION_WIDE = """
cm as (select loop_day,
  cast(sum(case when indexedLabel = 1 and prediction = 1 then 1 else 0 end) as bigint) as true_positives,
  cast(sum(case when indexedLabel = 0 and prediction = 1 then 1 else 0 end) as bigint) as false_positive,
  cast(sum(case when indexedLabel = 1 and prediction = 0 then 1 else 0 end) as bigint) as false_negative,
  cast(sum(case when indexedLabel = 0 and prediction = 0 then 1 else 0 end) as bigint) as true_negative
 from preds group by loop_day)
"""


def _div(a: str, b: str) -> str:
    return f"case when ({b}) = 0 then null else cast({a} as double) / cast({b} as double) end"


def _drift_sql(by: str) -> str:
    return f"""
c as (select {by}, cast(sum(case when ds = 'train' then 1 else 0 end) as bigint) as train_count,
        cast(sum(case when ds = 'pred' then 1 else 0 end) as bigint) as pred_count
      from (select {by}, 'train' as ds from tf union all select {by}, 'pred' as ds from sf) u group by {by})
select {by}, train_count, pred_count,
  {_div('train_count', '(select sum(train_count) from c)')} as train_share,
  {_div('pred_count', '(select sum(pred_count) from c)')} as pred_share
from c
"""


CLASS_LABELS = """
lab as (select CUSTCLASS, cast(dense_rank() over (order by CUSTCLASS desc) - 1 as double) as idx
        from (select distinct CUSTCLASS from tf where CUSTCLASS is not null) t),
nlab as (select cast(count(*) as double) as n from lab)
"""


# ---------------------------------------------------------------------------
# Spark builders that need more than one line
# ---------------------------------------------------------------------------

def _ledger_scan(spark, sf):
    return qualify(X.raw_ledger(spark, sf))


def _asof_windows(spark, sf):
    return L.asof_schedule(X.ledger(spark, sf))


def _live(spark, sf):
    _, reg = _inputs(spark, sf)
    return FE.live_customers(reg, _train(spark))


def _labels(spark, sf):
    led, reg = _inputs(spark, sf)
    return FE.churn_labels(led, reg, _train(spark))


def _class_index(spark, sf):
    return D.category_index(_frame(spark, sf))


def _confusion_long(spark, sf):
    return M.confusion_long(_rule_backtest(spark, sf)[0])


def _confusion_wide(spark, sf):
    return M.confusion_wide(_rule_backtest(spark, sf)[0])


def _metrics(spark, sf):
    preds, days = _rule_backtest(spark, sf)
    return M.backtest_metrics(preds, days.frame.select("loop_day"))


def _dynamics(spark, sf):
    preds, days = _rule_backtest(spark, sf)
    return M.set_dynamics(preds, days.frame.select("loop_day"))


def _cutoffs(spark, sf):
    return M.precision_by_cutoff(_rule_backtest(spark, sf)[0], loop_day=1)


def _churners(spark, sf):
    preds, _ = _rule_backtest(spark, sf)
    return C.churners_with_register(preds, X.register(spark, sf), loop_day=1)


def _class_balance(spark, sf):
    cur, _ = _rule_current(spark, sf)
    return D.class_balance(cur.predictions, cur.training)


def _enriched(spark, sf, level="custno"):
    cur, reg = _rule_current(spark, sf, level)
    return C.enrich_predictions(cur.predictions, reg, level)


def _top(spark, sf):
    return C.top_churners(_enriched(spark, sf))


def _audit(spark, sf, level="custno"):
    cur, _ = _rule_current(spark, sf, level)
    return C.prediction_audit(cur.scoring, cur.predictions)


def _segments(spark, sf, level="custno"):
    return C.campaign_segments(_enriched(spark, sf, level), fixture_segments())


def _segment_counts(spark, sf):
    return C.segment_counts(_segments(spark, sf), fixture_segments())


def _drilldown(spark, sf):
    pe = _enriched(spark, sf)
    return C.drilldown(pe, C.largest_churner(pe))


def _drilldown_several(spark, sf):
    pe = _enriched(spark, sf)
    return C.drilldown(pe, C.top_churners(pe, 3).select("customer_level"))


# Two as-of days whose windows follow no common rule.
FREE_WINDOWS = [
    {"loop_day": 0, "month_start": dt.date(1998, 12, 1), "lag_start": dt.date(1999, 5, 1), "feature_end": dt.date(1999, 6, 30),
     "active_start": dt.date(1998, 6, 1), "active_end": dt.date(1999, 5, 31),
     "target_start": dt.date(1999, 8, 1), "target_end": dt.date(1999, 12, 31)},
    {"loop_day": 7, "month_start": dt.date(1999, 7, 1), "lag_start": dt.date(1999, 11, 20), "feature_end": dt.date(2000, 3, 31),
     "active_start": dt.date(1999, 1, 1), "active_end": dt.date(2000, 3, 31),
     "target_start": dt.date(2000, 4, 1), "target_end": dt.date(2000, 6, 30)},
]


def _free_frame(spark, sf):
    led, reg = _inputs(spark, sf)
    return FE.feature_frame(led, reg, A.asof_rows(spark, FREE_WINDOWS))


def _frame_from_files(spark, sf):
    """The training frame through the real readers: raw extracts and a
    register snapshot of text columns, written to the shared folder and
    removed once the frame stands."""
    base = fresh_path(spark, "raw-inputs")
    paths = []
    for i, raw in enumerate(X.raw_extracts(spark, sf)):
        paths.append(f"{base}/tx{i}")
        raw.write.parquet(paths[-1])
    reg = X.register(spark, sf)
    texts = [c for c in ("CUSTNO", "COMPID", "CREDATE", "KILLDATE", "REGION", "DISTRICT", "CUSTCAT")]
    reg.withColumns({c: F.col(c).cast("string") for c in texts}).write.parquet(f"{base}/register/2022/24")
    register = normalise_register(read_register_snapshot(spark, f"{base}/register", "2022/24"))
    frame = materialize(FE.feature_frame(read_ledger(spark, paths, X.HANDOVER), register, _train(spark)))
    remove_path(spark, base)
    return frame


SNAPSHOT_DAYS = (dt.date(1999, 12, 31), dt.date(2000, 7, 2))


def _frame_dated_register(spark, sf):
    """The backtest frame with the register as each day knew it, through the
    reader of dated snapshots; the folders are removed once the frame stands."""
    base = fresh_path(spark, "register-snapshots")
    for moved, day in enumerate(SNAPSHOT_DAYS):
        X.register_taken(spark, sf, day, moved).write.parquet(f"{base}/{day}")
    reg = read_register_snapshots(spark, base, {str(day): day for day in SNAPSHOT_DAYS})
    frame = materialize(FE.feature_frame(X.ledger(spark, sf), reg, A.backtest_days(spark, TRAIN_END)))
    remove_path(spark, base)
    return frame


def _dated_register_sql() -> str:
    first, second = map(O.d, SNAPSHOT_DAYS)
    taken = " union all ".join(
        f"select * replace (case when KILLDATE <= {day} then KILLDATE end as KILLDATE, cast((REGION + {moved}) % 5 as integer) as REGION), "
        f"{day} as taken from register where CREDATE <= {day}" for moved, day in enumerate((first, second)))
    return O.feature_frame_sql(BACKTEST_DAYS, register=f"({taken})",
                               live=f"r.taken = case when w.e >= {second} then {second} else {first} end")


def _frame_from_buckets(spark, sf, days=None):
    """The frame through tables bucketed by customer, dropped once it stands."""
    base = fresh_path(spark, "bucketed")
    mark = base.rsplit("-", 1)[1]
    names = {part: f"churn_{part}_{mark}" for part in ("ledger", "register")}
    for (part, name), rows in zip(names.items(), _inputs(spark, sf), strict=True):
        write_bucketed(rows, name, 8, f"{base}/{part}")
    led, reg = (read_bucketed(spark, name) for name in names.values())
    frame = materialize(FE.feature_frame(led, reg, days or _train(spark)))
    for name in names.values():
        spark.sql(f"drop table {name}")
    remove_path(spark, base)
    return frame


def _by_nodes(spark, sf):
    """Evaluation predictions against the node table's: same class, and probabilities equal to 1e-9."""
    ev = _evaluate(spark, sf)
    led, reg = _inputs(spark, sf)
    rows = TR.compared(ev.model, FE.feature_frame(led, reg, ev.backtest), ev.predictions)
    agrees = F.col("prediction").eqNullSafe(F.col("prediction_by_nodes")) & (
        F.abs(F.col("probability_churn") - F.col("probability_by_nodes")) < 1e-9)
    return rows.select("loop_day", "customer_level", F.coalesce(agrees, F.lit(False)).alias("agrees"))


def _importance_by_nodes(spark, sf):
    """Every input's importance against the one summed from the node table."""
    ev = _evaluate(spark, sf)
    own = TR.node_importances(TR.node_table(spark, ev.model)).withColumnRenamed("importance", "own")
    told = MD.feature_importance(ev.model, ev.training)
    gap = F.abs(F.col("importance") - F.coalesce("own", F.lit(0.0)))
    return told.join(own, "slot", "left").select("slot", "feature", (gap < 1e-9).alias("agrees"))


def _drift_region(spark, sf):
    cur, _ = _rule_current(spark, sf)
    return D.population_shift(cur.training, cur.scoring, ["REGION"])


def _drift_class(spark, sf):
    cur, _ = _rule_current(spark, sf)
    return D.class_index_counts(cur.training, cur.scoring, "CUSTCLASS")


def _csv_roundtrip(spark, sf):
    seg = _segments(spark, sf)
    path = fresh_path(spark, "call-lists")
    write_call_lists(seg, path, partition_by="segment")
    schema = T.StructType([f for f in seg.schema.fields])
    back = materialize(read_call_lists(spark, path, schema).select(*seg.columns))
    remove_path(spark, path)
    return back


def _model_inputs(spark, sf):
    frame = MD.with_label(_frame(spark, sf))
    return MD.model_inputs(MD.encoder(), frame)


def _model_input_vectors(spark, sf):
    """The model frame with the assembled vector as text (every input is a whole number)."""
    digits = F.transform("features", lambda x: x.cast("long").cast("string"))
    return _model_inputs(spark, sf).withColumn("features", F.array_join(digits, ","))


def _vectors_sql() -> str:
    def block(of: str) -> str:
        return f"[case when k = {of}.i then '1' else '0' end for k in range((select count(*) from {of}))]"

    numeric = [f"Month_{k}" for k in range(1, 12)] + [f"Week_{j}" for j in range(1, 7)] + ["feature_days_customer"]
    return f"""
, cls as (select CUSTCLASS, dense_rank() over (order by CUSTCLASS desc) - 1 as i
          from (select distinct CUSTCLASS from tf where CUSTCLASS is not null) a),
reg as (select REGION, dense_rank() over (order by cast(REGION as varchar) desc) - 1 as i
        from (select distinct REGION from tf where REGION is not null) b)
select loop_day, customer_level, total_sales, cast(target_churn as double) as "indexedLabel",
       array_to_string(list_concat(list_concat({block('cls')}, {block('reg')}),
                       [{', '.join(f'cast({c} as varchar)' for c in numeric)}]), ',') as features
from tf left join cls on cls.CUSTCLASS = tf.CUSTCLASS left join reg on reg.REGION = tf.REGION"""


def _model_input_entries(spark, sf):
    return MD.model_input_entries(MD.encoder(), _frame(spark, sf))


def _entries_sql() -> str:
    numeric = [f"Month_{k}" for k in range(1, 12)] + [f"Week_{j}" for j in range(1, 7)] + ["feature_days_customer"]
    parts = [
        "select t.loop_day, t.customer_level, c.i as slot, cast(1 as double) as value "
        "from tf t join cls c on c.CUSTCLASS = t.CUSTCLASS",
        "select t.loop_day, t.customer_level, (select count(*) from cls) + r.i as slot, "
        "cast(1 as double) as value from tf t join reg r on r.REGION = t.REGION",
    ]
    for k, c in enumerate(numeric):
        parts.append(f"select loop_day, customer_level, (select count(*) from cls) + (select count(*) from reg) "
                     f"+ {k} as slot, cast({c} as double) as value from tf")
    body = "\nunion all\n".join(parts)
    return f"""
, cls as (select CUSTCLASS, dense_rank() over (order by CUSTCLASS desc) - 1 as i
          from (select distinct CUSTCLASS from tf where CUSTCLASS is not null) a),
reg as (select REGION, dense_rank() over (order by cast(REGION as varchar) desc) - 1 as i
        from (select distinct REGION from tf where REGION is not null) b)
select loop_day, customer_level, cast(slot as integer) as slot, value
from ({body}) u where value != 0"""


def _current(spark, sf, gbt_params=None):
    led, reg = _inputs(spark, sf)
    return P.predict_current(led, reg, gbt_params=gbt_params or PRODUCTION_GBT, latest=_latest(spark, sf))


def _evaluate(spark, sf, gbt_params=None):
    led, reg = _inputs(spark, sf)
    return P.evaluate(led, reg, TRAIN_END, gbt_params=gbt_params or EVALUATION_GBT)


# What of a fitted run does not depend on the trees is compared with SQL, on a quick fit.
QUICK_GBT = {"maxIter": 2, "maxDepth": 2, "seed": 42}


def _importance_slots(spark, sf):
    cur = _current(spark, sf, QUICK_GBT)
    return MD.feature_importance(cur.model, cur.training).select("slot", "feature")


def _slots_sql() -> str:
    numeric = [f"Month_{k}" for k in range(1, 12)] + [f"Week_{j}" for j in range(1, 7)] + ["feature_days_customer"]
    rest = ", ".join(f"({k}, '{c}')" for k, c in enumerate(numeric))
    return f""", cls as (select CUSTCLASS as v, dense_rank() over (order by CUSTCLASS desc) - 1 as i
       from (select distinct CUSTCLASS from tf where CUSTCLASS is not null) a),
reg as (select cast(REGION as varchar) as v, dense_rank() over (order by cast(REGION as varchar) desc) - 1 as i
        from (select distinct REGION from tf where REGION is not null) b)
select cast(i as integer) as slot, 'CUSTCLASS_vector_' || v as feature from cls
union all select cast((select count(*) from cls) + i as integer) as slot, 'REGION_vector_' || v as feature from reg
union all select cast((select count(*) from cls) + (select count(*) from reg) + k as integer) as slot, c as feature
from (values {rest}) t(k, c)"""


# ---------------------------------------------------------------------------
# The catalogue
# ---------------------------------------------------------------------------

def _months_sql() -> str:
    return ", ".join(f"count(distinct case when m = {k} then TRANSREFNO end) as Month_{k}" for k in range(12))


def _lags_sql(n: int = 50) -> str:
    return ", ".join(f"count(distinct case when lag = {k} then TRANSREFNO end) as lag_{k}"
                     for k in range(1, n + 1))


WINDOW_DATES = ("month_start", "lag_start", "feature_end", "active_start", "active_end", "target_start", "target_end")


def _asof_sql(churn: int = CHURN_DAYS) -> str:
    return O.with_base() + f"""
, latest as (select max(POSTDATE) as latest from ledger),
steps as (select cast(range as integer) as i from range(0, {BACKTEST_PERIODS + 2})),
ends as (select i, case when i = 0 then latest - {churn + 30} when i < {BACKTEST_PERIODS} then latest - {churn + 30} + i + {churn}
                        when i = {BACKTEST_PERIODS} then latest - {churn} else latest + 1 end as e
         from steps, latest)
select case when i = 0 then 'evaluation_train' when i < {BACKTEST_PERIODS} then 'backtest'
            when i = {BACKTEST_PERIODS} then 'prediction_train' else 'prediction_score' end as purpose,
       case when i < {BACKTEST_PERIODS} then i else 0 end as loop_day,
       e - 364 as month_start, e - 50 as lag_start, e as feature_end,
       e - case when i < {BACKTEST_PERIODS} then 90 else {churn} end as active_start, e as active_end,
       e + 1 as target_start, e + {churn} as target_end
from ends"""


def build_catalog() -> dict[str, Query]:
    q: list[Query] = [
        Query("ledger_scan", _ledger_scan,
              O.with_base() + "select * from raw_ledger where " + O._QUAL,
              ("POSTDATE",), ("SALES",)),
        Query("register_snapshot", lambda s, sf: X.register(s, sf),
              O.with_base() + "select * from register", REG_DATES),
        Query("ledger_union", lambda s, sf: X.ledger(s, sf),
              O.with_base() + "select * from ledger", ("POSTDATE",), ("SALES",)),
        Query("ledger_enriched", lambda s, sf: FE.enrich_ledger(*_inputs(s, sf)),
              O.with_base() + "select l.*, r.COMPID from ledger l left join register r on l.CUSTNO = r.CUSTNO",
              ("POSTDATE",), ("SALES",)),
        Query("monthly_transactions", lambda s, sf: L.monthly_transactions(X.ledger(s, sf)),
              O.with_base() + "select strftime(POSTDATE, '%Y-%m') as year_month, "
              "count(distinct TRANSREFNO) as UNIQUE_TRANSREFNO from ledger group by 1"),
        Query("ledger_date_range", lambda s, sf: L.date_range(X.ledger(s, sf)),
              O.with_base() + "select min(POSTDATE) as min_date, max(POSTDATE) as max_date from ledger",
              ("min_date", "max_date")),
        Query("asof_windows", _asof_windows, _asof_sql(), WINDOW_DATES),
        Query("asof_windows_churn_180", lambda s, sf: L.asof_schedule(X.ledger(s, sf), churn_days=180), _asof_sql(180), WINDOW_DATES),
        Query("features_month_long", lambda s, sf: FE.features_month_long(X.ledger(s, sf), _train(s)),
              YEAR + "select loop_day, customer_level, cast(m as integer) as Month_variable, "
              "count(distinct TRANSREFNO) as UNIQUE_TRANSREFNO from yr group by all"),
        Query("features_week_long", lambda s, sf: FE.features_week_long(X.ledger(s, sf), _train(s)),
              WEEK_ROWS + "select loop_day, customer_level, Week_variable, "
              "count(distinct TRANSREFNO) as UNIQUE_TRANSREFNO from wk group by all"),
        Query("features_month", lambda s, sf: FE.features_month(X.ledger(s, sf), _train(s)),
              YEAR + f"select loop_day, customer_level, {_months_sql()} from yr group by all"),
        Query("features_week", lambda s, sf: FE.features_week(X.ledger(s, sf), _train(s)),
              WEEK_ROWS + "select loop_day, customer_level, " + ", ".join(
                  f"count(distinct case when Week_variable = {j} then TRANSREFNO end) as Week_{j}"
                  for j in range(1, N_WEEKS + 1)) + " from wk group by all"),
        Query("features_week_12", lambda s, sf: FE.features_week(X.ledger(s, sf), _train(s), n_weeks=12),
              O.with_base(TRAIN_DAYS) + "select w.loop_day, l.CUSTNO as customer_level, " + ", ".join(
                  f"count(distinct case when date_diff('day', l.POSTDATE, w.e) between {7 * j - 7} and {7 * j - 1} then TRANSREFNO end) "
                  f"as Week_{j}" for j in range(1, 13))
              + " from ledger l join windows w on l.POSTDATE between w.e - 83 and w.e group by all"),
        Query("daily_lag_counts", lambda s, sf: FE.daily_lag_counts(X.ledger(s, sf), _train(s)),
              LAG_ROWS + "select loop_day, customer_level, lag, count(distinct TRANSREFNO) as UNIQUE_TRANSREFNO "
              "from lg group by all"),
        Query("daily_lag_wide", lambda s, sf: FE.daily_lag_wide(X.ledger(s, sf), _train(s)),
              LAG_ROWS + f"select loop_day, customer_level, {_lags_sql()} from lg group by all"),
        Query("total_sales", lambda s, sf: FE.total_sales(X.ledger(s, sf), _train(s)),
              YEAR + "select loop_day, customer_level, sum(SALES) as total_sales from yr group by all",
              (), ("total_sales",)),
        Query("active_customers", lambda s, sf: FE.active_customers(X.ledger(s, sf), _train(s)),
              YEAR + "select loop_day, customer_level, count(distinct TRANSREFNO) as UNIQUE_TRANSREFNO_ACTIVE "
              "from yr where POSTDATE >= active_start and TRANSREFNO is not null group by all"),
        Query("live_customers", _live, LIVE + "select * from live", REG_DATES),
        Query("churn_labels", _labels,
              LIVE + ", tgt as (select w.loop_day, l.CUSTNO as customer_level, "
              "count(distinct l.TRANSREFNO) as UNIQUE_TRANSREFNO_TARGET from ledger l join windows w "
              "on l.POSTDATE between w.target_start and w.target_end group by all)\n"
              "select v.loop_day, v.customer_level, t.UNIQUE_TRANSREFNO_TARGET, "
              "case when t.UNIQUE_TRANSREFNO_TARGET is null then 1 else 0 end as target_churn "
              "from live v left join tgt t on t.loop_day = v.loop_day and t.customer_level = v.customer_level",
              (), ("UNIQUE_TRANSREFNO_TARGET",)),
        Query("churn_feature_frame", lambda s, sf: _frame(s, sf),
              O.feature_frame_sql(TRAIN_DAYS), FRAME_DATES, ("UNIQUE_TRANSREFNO_TARGET",)),
        Query("features_company_level", lambda s, sf: _frame(s, sf, "compid"),
              O.feature_frame_sql(TRAIN_DAYS, level="compid"), FRAME_DATES, ("UNIQUE_TRANSREFNO_TARGET",)),
        Query("feature_frame_dated_register", _frame_dated_register, _dated_register_sql(), FRAME_DATES, ("UNIQUE_TRANSREFNO_TARGET",)),
        Query("feature_frame_custom_windows", _free_frame, O.free_frame_sql(FREE_WINDOWS), FRAME_DATES,
              ("UNIQUE_TRANSREFNO_TARGET",)),
        Query("feature_frame_from_files", _frame_from_files,
              O.feature_frame_sql(TRAIN_DAYS), FRAME_DATES, ("UNIQUE_TRANSREFNO_TARGET",)),
        Query("feature_frame_bucketed", _frame_from_buckets,
              O.feature_frame_sql(TRAIN_DAYS), FRAME_DATES, ("UNIQUE_TRANSREFNO_TARGET",)),
        Query("register_newest", lambda s, sf: L.register_newest(X.register(s, sf)),
              O.with_base() + "select * from register order by CREDATE desc, CUSTNO", REG_DATES),
        Query("class_index", _class_index,
              O.with_base() + ", " + frame_cte("tf", TRAIN_DAYS) + """
select 'CUSTCLASS' as input_column, CUSTCLASS as value,
       cast(dense_rank() over (order by CUSTCLASS desc) - 1 as double) as label_index
from (select distinct CUSTCLASS from tf where CUSTCLASS is not null) a
union all
select 'REGION' as input_column, cast(REGION as varchar) as value,
       cast(dense_rank() over (order by cast(REGION as varchar) desc) - 1 as double) as label_index
from (select distinct REGION from tf where REGION is not null) b"""),
        Query("confusion_long", _confusion_long,
              BT_PREDS + "select loop_day, indexedLabel, prediction, count(*) as count from preds group by all"),
        Query("confusion_wide", _confusion_wide, BT_PREDS + ", " + CONFUSION_WIDE + "select * from cm"),
        Query("backtest_metrics", _metrics,
              BT_PREDS + ", " + CONFUSION_WIDE + ", " + _dynamics_sql() + f"""
select d.loop_day,
  {_div('true_positives', 'true_positives + false_negative')} as recall,
  {_div('true_positives', 'true_positives + false_positive')} as precision,
  {_div('true_positives + true_negative',
        'true_positives + false_positive + false_negative + true_negative')} as accuracy,
  cast(d.newly_classified as bigint) as newly_classified, cast(d.fallen_out as bigint) as fallen_out,
  cast(d.total_classified as bigint) as total_classified,
  cast(coalesce(true_positives + false_positive + false_negative + true_negative, 0) as bigint) as total_companies
from dyn d left join cm on cm.loop_day = d.loop_day"""),
        Query("churn_set_dynamics", _dynamics,
              BT_PREDS + ", " + _dynamics_sql() + """
select loop_day, cast(predicted as bigint) as predicted, cast(newly_classified as bigint) as newly_classified,
       cast(total_classified as bigint) as total_classified, cast(fallen_out as bigint) as fallen_out
from dyn"""),
        Query("precision_by_cutoff", _cutoffs,
              BT_PREDS + f""", cuts as (select cast(c as double) as cutoff from (values {O.cutoffs_values()}) t(c)),
d1 as (select * from preds where loop_day = 1 and prediction = 1)
select cutoff, count(d1.customer_level) as predicted,
       cast(coalesce(sum(d1.indexedLabel), 0) as double) as correct,
       {_div('coalesce(sum(d1.indexedLabel), 0)', 'count(d1.customer_level)')} as precision
from cuts left join d1 on d1.total_sales > cuts.cutoff group by cutoff"""),
        Query("predicted_churners", _churners,
              BT_PREDS + """
select p.loop_day, p.customer_level as custno, p.total_sales, p.indexedLabel, p.prediction,
       r.CUSTCAT, r.CZTURNOVER
from preds p left join register r on r.CUSTNO = p.customer_level
where p.loop_day = 1 and p.prediction = 1"""),
        Query("class_balance", _class_balance,
              CUR + """
select 'predictions' as frame, 'prediction' as source_column, prediction as value, count(*) as count
from preds group by prediction
union all
select 'training' as frame, 'target_churn' as source_column, cast(target_churn as double) as value, count(*) as count
from tf group by target_churn"""),
        Query("predictions_enriched", _enriched, CUR + "select * from pe", REG_DATES),
        Query("top_churners", _top,
              CUR + "select * from pe where prediction = 1 order by total_sales desc, customer_level", REG_DATES),
        Query("customer_drilldown", _drilldown,
              CUR + "select * from pe where customer_level = (select customer_level from pe where prediction = 1 "
              "order by total_sales desc, customer_level limit 1)", REG_DATES),
        Query("prediction_audit", _audit,
              CUR + "select s.loop_day, s.customer_level, " + ", ".join(f"s.Month_{k}" for k in range(12)) + ", "
              + ", ".join(f"s.Week_{j}" for j in range(1, 7))
              + ", s.feature_days_customer, s.UNIQUE_TRANSREFNO_ACTIVE, s.total_sales, p.prediction "
              "from sf s left join preds p on p.loop_day = s.loop_day and p.customer_level = s.customer_level"),
        Query("customers_drilldown", _drilldown_several,
              CUR + "select * from pe where customer_level in (select customer_level from pe where prediction = 1 "
              "order by total_sales desc, customer_level limit 3)", REG_DATES),
        Query("company_predictions_enriched", lambda s, sf: _enriched(s, sf, "compid"),
              COMPANY + "select * exclude (COMPID) from pe", REG_DATES),
        Query("company_campaign_segments", lambda s, sf: _segments(s, sf, "compid"),
              COMPANY + _segments_sql("pe"), ("CREDATE",)),
        Query("company_prediction_audit", lambda s, sf: _audit(s, sf, "compid"),
              COMPANY + "select s.loop_day, s.customer_level, s.CUSTNO, " + ", ".join(f"s.Month_{k}" for k in range(12)) + ", "
              + ", ".join(f"s.Week_{j}" for j in range(1, 7))
              + ", s.feature_days_customer, s.UNIQUE_TRANSREFNO_ACTIVE, s.total_sales, p.prediction from sf s left join preds p "
              "on p.loop_day = s.loop_day and p.customer_level = s.customer_level and p.CUSTNO = s.CUSTNO"),
        Query("campaign_segments", _segments, CUR + _segments_sql("pe"), ("CREDATE",)),
        Query("segment_counts", _segment_counts,
              CUR + ", seg as (" + _segments_sql("pe") + "), names as (select * from (values "
              + ", ".join(f"('{r.segment}')" for r in fixture_segments()) + ") t(segment))\n"
              "select n.segment, cast(count(s.segment) as bigint) as count from names n "
              "left join seg s on s.segment = n.segment group by n.segment"),
        Query("drift_by_region", _drift_region, CUR + ", " + _drift_sql("REGION")),
        Query("drift_by_class_index", _drift_class,
              CUR + ", " + CLASS_LABELS + """
select ds as dataset, CUSTCLASS, coalesce(idx, (select n from nlab)) as CUSTCLASS_index, count(*) as count
from (select 'train' as ds, CUSTCLASS from tf union all select 'pred' as ds, CUSTCLASS from sf) u
left join lab using (CUSTCLASS) group by all"""),
        Query("campaign_csv_roundtrip", _csv_roundtrip, CUR + _segments_sql("pe"), ("CREDATE",)),
        Query("model_input_entries", _model_input_entries,
              O.with_base() + ", " + frame_cte("tf", TRAIN_DAYS) + _entries_sql()),
        Query("model_input_vectors", _model_input_vectors,
              O.with_base() + ", " + frame_cte("tf", TRAIN_DAYS) + _vectors_sql()),
        # Of fitted runs: what does not depend on the trees.
        Query("backtest_prediction_rows", lambda s, sf: _evaluate(s, sf, QUICK_GBT).predictions.select(
            "loop_day", "customer_level", "total_sales", "indexedLabel"),
              BT_PREDS + "select loop_day, customer_level, total_sales, indexedLabel from preds"),
        Query("evaluation_population", lambda s, sf: _evaluate(s, sf, QUICK_GBT).metrics.select("loop_day", "total_companies"),
              BT_PREDS + "select loop_day, count(*) as total_companies from preds group by loop_day"),
        Query("current_prediction_rows", lambda s, sf: _current(s, sf, QUICK_GBT).predictions.select(
            "loop_day", "customer_level", "total_sales"),
              CUR + "select loop_day, customer_level, total_sales from preds"),
        Query("feature_importance_slots", _importance_slots,
              O.with_base() + ", " + frame_cte("tf", PRED_TRAIN_DAYS, active_days=CHURN_DAYS) + _slots_sql()),
        # The model's own scores and importances against those worked out from its saved nodes.
        Query("backtest_predictions_by_nodes", _by_nodes, BT_PREDS + "select loop_day, customer_level, true as agrees from preds"),
        Query("feature_importance_by_nodes", _importance_by_nodes,
              O.with_base() + ", " + frame_cte("tf", TRAIN_DAYS) + _slots_sql().replace("\nselect", ", slots as (select", 1)
              + ") select slot, feature, true as agrees from slots"),
        # Model output: rows-only checks.
        Query("model_inputs", _model_inputs),
        Query("current_predictions", lambda s, sf: _current(s, sf).predictions),
        Query("feature_importance", lambda s, sf: (lambda cur: MD.feature_importance(cur.model, cur.training))(_current(s, sf))),
        Query("backtest_predictions", lambda s, sf: _evaluate(s, sf).predictions),
        Query("evaluation_end_to_end", lambda s, sf: _evaluate(s, sf).metrics),
    ]
    return {x.name: x for x in q}


CATALOG = build_catalog()
