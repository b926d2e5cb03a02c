"""DuckDB SQL that recomputes the named queries from the raw test tables.

Written independently of the Spark operators, in the direct form: one
``count(distinct ...)`` per bucket, explicit joins per as-of day.  Used by the
correctness gate (``__spark_entry__.oracle_sql``) and by the tests.

Presentation: dates are compared as ISO text and money as double in both
engines (see ``churnscope.plans.catalog.present``).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from churnscope.config import (
    ACTIVE_DAYS_EVALUATION,
    CHURN_DAYS,
    LAG_WINDOW_DAYS,
    MONTH_WINDOW_DAYS,
    N_MONTHS,
    N_WEEKS,
    SALES_CUTOFFS,
)

RAW_LEDGER = """
select o_custkey as CUSTNO, cast(o_orderdate as date) as POSTDATE,
       case when l_linenumber = 7 then null else l_orderkey end as TRANSREFNO,
       cast(l_extendedprice as decimal(18,2)) as SALES,
       case when l_orderkey % 20 = 0 then '20' else '10' end as COMPNO,
       cast(case l_returnflag when 'A' then 61 when 'N' then 66 else 99 end as integer) as OTYPE
from lineitem join orders on l_orderkey = o_orderkey
"""

_QUAL = "COMPNO = '10' and TRANSREFNO is not null and OTYPE in (61, 66)"

LEDGER = f"""
select CUSTNO, POSTDATE, TRANSREFNO, SALES from raw_ledger
 where POSTDATE < date '1997-01-01' and {_QUAL}
union all
select CUSTNO, POSTDATE, TRANSREFNO, SALES from raw_ledger
 where POSTDATE >= date '1997-01-01' and POSTDATE < date '2000-07-01'
   and POSTDATE < date '2000-01-01' and {_QUAL}
union all
select CUSTNO, POSTDATE, TRANSREFNO, SALES from raw_ledger
 where POSTDATE >= date '1999-07-01' and POSTDATE >= date '2000-01-01' and {_QUAL}
"""

REGISTER = """
select c_custkey as CUSTNO, cast(floor(c_custkey / 3) as bigint) as COMPID, c_name as NAME1,
       date '1995-01-01' + cast(c_custkey % 1500 as integer) as CREDATE,
       case when c_custkey % 10 = 0 then date '1999-01-01' + cast(c_custkey % 900 as integer) end as KILLDATE,
       c_mktsegment as CUSTCLASS, cast(n_regionkey as integer) as REGION,
       cast(c_nationkey as integer) as DISTRICT, cast(800 + c_custkey % 70 as integer) as CUSTCAT,
       cast(c_acctbal as double) as CZTURNOVER
from customer join nation on c_nationkey = n_nationkey
"""

REGISTER_COLUMNS = ("CUSTNO", "COMPID", "NAME1", "CREDATE", "KILLDATE", "CUSTCLASS", "REGION",
                    "DISTRICT", "CUSTCAT", "CZTURNOVER")

MONTHS = [f"Month_{k}" for k in range(N_MONTHS)]
WEEKS = [f"Week_{j}" for j in range(1, N_WEEKS + 1)]


def d(x: dt.date) -> str:
    return f"date '{x.isoformat()}'"


def windows(days: Sequence[tuple[int, dt.date | str]], active_days: int = ACTIVE_DAYS_EVALUATION) -> str:
    """As-of rows; an end may be a date or a SQL expression (e.g. derived
    from the newest posting)."""
    rows = " union all ".join(
        f"select {i} as loop_day, {d(e) if isinstance(e, dt.date) else e} as e" for i, e in days)
    return f"""
select cast(loop_day as integer) as loop_day, e,
       e - {MONTH_WINDOW_DAYS} as month_start, e - {LAG_WINDOW_DAYS} as lag_start,
       e - {active_days} as active_start, e + 1 as target_start, e + {CHURN_DAYS} as target_end
from ({rows}) t
"""


def with_base(days: Sequence[tuple[int, dt.date]] | None = None,
              active_days: int = ACTIVE_DAYS_EVALUATION, extra: str = "") -> str:
    ctes = [f"raw_ledger as ({RAW_LEDGER})", f"ledger as ({LEDGER})", f"register as ({REGISTER})"]
    if days is not None:
        ctes.append(f"windows as ({windows(days, active_days)})")
    if extra:
        ctes.append(extra)
    return "with " + ",\n".join(ctes) + "\n"


def level_key(level: str) -> str:
    return {"custno": "CUSTNO", "compid": "COMPID"}[level]


def entity_ledger(level: str) -> str:
    """Ledger lines with ``customer_level``."""
    if level == "custno":
        return "select *, CUSTNO as customer_level from ledger"
    return ("select l.*, r.COMPID, r.COMPID as customer_level from ledger l "
            "left join (select CUSTNO, COMPID from register) r on l.CUSTNO = r.CUSTNO")


def month_expr(month_mode: str = "calendar") -> str:
    if month_mode == "calendar":
        return "(month(w.e) - month(l.POSTDATE) + 12) % 12"
    return "least(cast(floor(date_diff('day', l.POSTDATE, w.e) / 30) as integer), 11)"


def year_rows(level: str = "custno", month_mode: str = "calendar") -> str:
    return f"""
select w.loop_day, w.e, w.lag_start, w.active_start, l.customer_level, l.POSTDATE, l.TRANSREFNO, l.SALES,
       {month_expr(month_mode)} as m, date_diff('day', l.POSTDATE, w.e) as age
from ({entity_ledger(level)}) l join windows w on l.POSTDATE between w.month_start and w.e
"""


def week_cond(j: int) -> str:
    return f"POSTDATE >= lag_start and age between {7 * (j - 1)} and {7 * j - 1}"


def feature_ctes(level: str = "custno", month_mode: str = "calendar") -> str:
    months = ",\n  ".join(f"count(distinct case when m = {k} then TRANSREFNO end) as Month_{k}"
                          for k in range(N_MONTHS))
    weeks = ",\n  ".join(f"count(distinct case when {week_cond(j)} then TRANSREFNO end) as Week_{j}"
                         for j in range(1, N_WEEKS + 1))
    return f"""
yr as ({year_rows(level, month_mode)}),
feat as (
 select loop_day, customer_level,
  {months},
  {weeks},
  cast(coalesce(sum(SALES), 0) as double) as total_sales,
  count(distinct case when POSTDATE >= active_start then TRANSREFNO end) as UNIQUE_TRANSREFNO_ACTIVE
 from yr group by loop_day, customer_level),
tgt as (
 select w.loop_day, l.customer_level, count(distinct l.TRANSREFNO) as UNIQUE_TRANSREFNO_TARGET
 from ({entity_ledger(level)}) l join windows w on l.POSTDATE between w.target_start and w.target_end
 group by w.loop_day, l.customer_level)
"""


def feature_frame_sql(days: Sequence[tuple[int, dt.date]], level: str = "custno", with_label: bool = True,
                      active_days: int = ACTIVE_DAYS_EVALUATION, month_mode: str = "calendar",
                      register: str = "register", live: str = "true") -> str:
    """The feature frame as one SQL statement (no trailing presentation)."""
    reg_cols = ", ".join(f"r.{c}" for c in REGISTER_COLUMNS)
    feat_cols = ", ".join(f"f.{c}" for c in MONTHS + WEEKS)
    label = ""
    tgt_join = ""
    if with_label:
        label = ("t.UNIQUE_TRANSREFNO_TARGET, "
                 "case when t.UNIQUE_TRANSREFNO_TARGET is null then 1 else 0 end as target_churn,")
        tgt_join = "left join tgt t on t.loop_day = f.loop_day and t.customer_level = f.customer_level"
    return with_base(days, active_days, feature_ctes(level, month_mode).strip().rstrip(",")) + f"""
select f.loop_day, f.customer_level, {reg_cols},
       case when r.KILLDATE < w.target_end then 1 else 0 end as killed,
       {feat_cols}, f.total_sales, f.UNIQUE_TRANSREFNO_ACTIVE, {label}
       cast(date_diff('day', r.CREDATE, w.e) + 1 as integer) as feature_days_customer
from feat f join windows w on w.loop_day = f.loop_day
join {register} r on r.{level_key(level)} = f.customer_level and {live}
{tgt_join}
where r.CREDATE <= w.e and (r.KILLDATE > w.e or r.KILLDATE is null) and f.UNIQUE_TRANSREFNO_ACTIVE > 0
"""


def free_frame_sql(rows: Sequence[dict]) -> str:
    """The feature frame of as-of rows with seven free dates: every window
    stands for itself."""
    names = ["month_start", "lag_start", "feature_end", "active_start", "active_end", "target_start", "target_end"]
    table = " union all ".join(
        f"select {r['loop_day']} as loop_day, " + ", ".join(f"{d(r[n])} as {n}" for n in names) for r in rows)
    months = ", ".join(f"count(distinct case when POSTDATE between month_start and feature_end and m = {k} then TRANSREFNO end) "
                       f"as Month_{k}" for k in range(N_MONTHS))
    weeks = ", ".join(f"count(distinct case when POSTDATE between lag_start and feature_end and age between {7 * j - 7} and {7 * j - 1} "
                      f"then TRANSREFNO end) as Week_{j}" for j in range(1, N_WEEKS + 1))
    reg_cols = ", ".join(f"r.{c}" for c in REGISTER_COLUMNS)
    feat_cols = ", ".join(f"f.{c}" for c in MONTHS + WEEKS)
    return with_base() + f""", windows as ({table}),
ln as (select w.*, l.CUSTNO as customer_level, l.POSTDATE, l.TRANSREFNO, l.SALES,
       (month(w.feature_end) - month(l.POSTDATE) + 12) % 12 as m, date_diff('day', l.POSTDATE, w.feature_end) as age
       from ledger l cross join windows w),
f as (select loop_day, customer_level, {months}, {weeks},
      cast(coalesce(sum(case when POSTDATE between month_start and feature_end then SALES end), 0) as double) as total_sales,
      count(distinct case when POSTDATE between active_start and active_end then TRANSREFNO end) as UNIQUE_TRANSREFNO_ACTIVE,
      nullif(count(distinct case when POSTDATE between target_start and target_end then TRANSREFNO end), 0) as target
      from ln group by loop_day, customer_level)
select cast(f.loop_day as integer) as loop_day, f.customer_level, {reg_cols},
       case when r.KILLDATE < w.target_end then 1 else 0 end as killed, {feat_cols}, f.total_sales, f.UNIQUE_TRANSREFNO_ACTIVE,
       f.target as UNIQUE_TRANSREFNO_TARGET, case when f.target is null then 1 else 0 end as target_churn,
       cast(date_diff('day', r.CREDATE, w.feature_end) + 1 as integer) as feature_days_customer
from f join windows w using (loop_day) join register r on r.CUSTNO = f.customer_level
where r.CREDATE <= w.feature_end and (r.KILLDATE > w.feature_end or r.KILLDATE is null) and f.UNIQUE_TRANSREFNO_ACTIVE > 0
"""


def cutoffs_values() -> str:
    return ", ".join(f"({c})" for c in SALES_CUTOFFS)
