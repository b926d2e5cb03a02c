"""Churn features as of any number of days, in one plan.

For every as-of day and customer (or company):

* ``Month_0..Month_11``: distinct transactions per relative month of the
  trailing 365 days,
* ``Week_1..Week_6``: distinct transactions per week counted back from the
  feature end,
* ``total_sales``: sales over the trailing 365 days,
* ``UNIQUE_TRANSREFNO_ACTIVE``: distinct transactions in the active window,
* (training) ``UNIQUE_TRANSREFNO_TARGET`` and ``target_churn``: distinct
  transactions in the following 365 days, churn = none,

joined to the customers live on that day.

Plan shape (``strategy="flags"``), several days::

    ledger scan (date span pushed down)
      -> per (entity, transaction): its posting dates as bits of a few longs,
         per (entity, posting date): sum of sales     [partial agg, shuffle 1]
      -> equi-join of their dates with the calendar, which tells the month,
         week, active and target flags of a date as of each day (no shuffle)
      -> per (day, entity, transaction): bit_or of packed longs (month, week,
         active, target bits)            [same partitioning: no shuffle]
      -> per (day, entity): sums of bits              [partial agg, shuffle 2]
      -> join register rows on the entity, live on the day

The first shuffle carries no day, so its size does not depend on how many
days are evaluated.  One day known on the driver needs no join and packs the
bits before the first shuffle.  At company level customers' rows are combined
first and meet their company after, so no raw line is shuffled for it.

All aggregations combine map-side, so a customer holding a third of all
lines reaches the final aggregation as one row per map task, not as its
lines.  Sales are summed as decimals, whatever the path.
``strategy="distinct"`` is the direct form (one conditional
``count_distinct`` per bucket); Spark expands every row once per distinct
bucket for it, so it serves as the cross-check and the bench's comparison.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnscope.config import MONTH_COLUMNS, N_MONTHS, N_WEEKS, WEEK_COLUMNS
from churnscope.functions.dates import (
    age_days,
    customer_age_days,
    in_window,
    is_live,
    killed_flag,
    relative_month,
    rolling_month,
    week_bucket,
)
from churnscope.operators.asof import RANGES, AsOf
from churnscope.sources.register import VALIDITY_COLUMNS, unique_keys

LEVELS = {"custno": "CUSTNO", "compid": "COMPID"}


def level_column(level: str) -> str:
    try:
        return LEVELS[level.lower()]
    except KeyError:
        raise ValueError(f"customer level must be one of {sorted(LEVELS)}") from None


def enrich_ledger(ledger: DataFrame, register: DataFrame) -> DataFrame:
    """Attach the company id of each line's customer (left join on CUSTNO).

    A customer number that the register holds twice fails the query (see
    :func:`~churnscope.sources.register.unique_keys`): it would copy ledger
    lines.  Only the two key columns of the register are shuffled, and AQE
    turns the join into a broadcast when that projection is small.
    """
    return ledger.join(unique_keys(register, "COMPID"), on="CUSTNO", how="left")


def entity_ledger(ledger: DataFrame, register: DataFrame | None, level: str) -> DataFrame:
    """Ledger lines with ``customer_level`` set to the chosen entity key."""
    key = level_column(level)
    if key not in ledger.columns:
        if register is None:
            raise ValueError(f"ledger has no {key}; pass the register to attach it")
        ledger = enrich_ledger(ledger, register)
    return ledger.withColumn("customer_level", F.col(key))


def exact_sales(ledger: DataFrame) -> Column:
    """``SALES`` as a decimal: as it is, or rounded to 6 places if it is not
    one (sums of doubles would depend on their order)."""
    sales = F.col("SALES")
    return sales if isinstance(ledger.schema["SALES"].dataType, T.DecimalType) else sales.cast("decimal(28,6)")


def _month_of(month_mode: str) -> callable:
    if month_mode == "calendar":
        return relative_month
    if month_mode == "rolling":
        return rolling_month
    raise ValueError("month_mode must be 'calendar' or 'rolling'")


# Packed flags of a transaction: word 0 holds months 0..11, the active and the
# target bit, and the first weeks; further words hold weeks alone.
_ACTIVE_BIT, _TARGET_BIT, _FIRST_WEEK_BIT = N_MONTHS, N_MONTHS + 1, N_MONTHS + 2
_WORD_BITS = 62
_WEEKS_IN_FIRST = _WORD_BITS - _FIRST_WEEK_BIT


def _week_place(week: int) -> tuple[int, int]:
    """(word, bit) of week 1, 2, ..."""
    if week <= _WEEKS_IN_FIRST:
        return 0, _FIRST_WEEK_BIT + week - 1
    rest = week - _WEEKS_IN_FIRST - 1
    return 1 + rest // _WORD_BITS, rest % _WORD_BITS


def _words(n_weeks: int) -> list[str]:
    return [f"bits_{k}" for k in range(_week_place(max(n_weeks, 1))[0] + 1)]


def _shift(position: Column | int) -> Column:
    pos = F.lit(position) if isinstance(position, int) else position
    return F.call_function("shiftleft", F.lit(1).cast("long"), pos)


def _bit(word: str, k: int) -> Column:
    return F.shiftright(F.col(word), k).bitwiseAND(F.lit(1))


def _window_tests(n_weeks: int, month_mode: str) -> dict[str, Column]:
    """Columns that tell which windows and buckets a line's date is in."""
    d, end = F.col("POSTDATE"), F.col("feature_end")
    in_month = in_window(d, "month_start", "feature_end")
    return {"month": F.when(in_month, _month_of(month_mode)(d, end)),
            "week": F.when(in_window(d, "lag_start", "feature_end"), week_bucket(d, end, n_weeks)),
            "in_month": in_month,
            "active": in_window(d, "active_from", "active_end"),
            "target": in_window(d, "target_start", "target_end")}


def _packed(n_weeks: int, month_mode: str, with_target: bool) -> list[Column]:
    """One long per word: every bucket that the line's date touches."""
    t, zero = _window_tests(n_weeks, month_mode), F.lit(0).cast("long")
    week = t["week"]
    out = []
    for k, word in enumerate(_words(n_weeks)):
        if k == 0:
            first = F.when(t["month"].isNotNull(), _shift(t["month"])).otherwise(zero)
            first = first.bitwiseOR(F.when(t["active"], _shift(_ACTIVE_BIT)).otherwise(zero))
            if with_target:
                first = first.bitwiseOR(F.when(t["target"], _shift(_TARGET_BIT)).otherwise(zero))
            weeks = F.when(week <= _WEEKS_IN_FIRST, _shift(week + (_FIRST_WEEK_BIT - 1))).otherwise(zero)
            out.append(first.bitwiseOR(weeks).alias(word))
        else:
            low = _WEEKS_IN_FIRST + (k - 1) * _WORD_BITS
            out.append(F.when((week > low) & (week <= low + _WORD_BITS), _shift(week - (low + 1))).otherwise(zero).alias(word))
    return out


def _read_windows(with_target: bool) -> tuple[str, ...]:
    return ("month", "lag", "active", "target") if with_target else ("month", "lag", "active")


def _merged(rows: DataFrame, keys: list[str], n_weeks: int) -> DataFrame:
    return rows.groupBy(*keys).agg(*(F.bit_or(w).alias(w) for w in _words(n_weeks)), F.sum("sales").alias("sales"))


def _customer_lines(ledger: DataFrame, register: DataFrame | None, level: str) -> tuple[DataFrame, DataFrame | None]:
    """Lines with ``customer_level``, and the (CUSTNO, COMPID) keys that still have to be met after combining."""
    key = level_column(level)
    if key in ledger.columns:
        return ledger.withColumn("customer_level", F.col(key)), None
    if register is None:
        raise ValueError(f"ledger has no {key}; pass the register to attach it")
    keys = unique_keys(register, key).select(F.col("CUSTNO").alias("customer_level"), F.col(key).alias("_company"))
    return ledger.withColumn("customer_level", F.col("CUSTNO")), keys


def _with_company(rows: DataFrame, keys: DataFrame | None) -> DataFrame:
    """Combined rows under their company (left join on the customer)."""
    if keys is None:
        return rows
    return rows.join(keys, "customer_level", "left").withColumn("customer_level", F.col("_company")).drop("_company")


def day_flags(lines: DataFrame, asof: AsOf, keys: DataFrame | None, with_target: bool, month_mode: str,
              n_weeks: int) -> DataFrame:
    """One day: per (entity, transaction) packed bits and the month window's
    sales, combined before the first shuffle."""
    met = asof.meet(lines, *_read_windows(with_target))
    sales = F.when(in_window("POSTDATE", "month_start", "feature_end"), exact_sales(lines))
    rows = met.select("customer_level", F.col("TRANSREFNO").alias("key"), F.lit(0).alias("kind"),
                      *_packed(n_weeks, month_mode, with_target), sales.alias("sales"))
    out = _merged(rows, ["customer_level", "kind", "key"], n_weeks)
    return out if keys is None else _merged(_with_company(out, keys), ["customer_level", "kind", "key"], n_weeks)


# Posting dates of a transaction: bit d % 63 of long word d // 63, d days after the first date that is read.
_DATE_WORD = 63


def _date_place(day: Column, first: dt.date) -> tuple[Column, Column]:
    """(word, bit) of a date."""
    days = F.unix_date(day) - F.unix_date(F.lit(first))
    return F.floor(days / _DATE_WORD).cast("int"), F.pmod(days, F.lit(_DATE_WORD))


def posting_dates(lines: DataFrame, asof: AsOf, keys: DataFrame | None, with_target: bool) -> DataFrame:
    """Per (entity, transaction) its posting dates (kind 0), and per (entity,
    posting date) the sum of sales (kind 1): nothing here depends on the days,
    but for the span that is read.

    The dates are bits of as many longs (``dates_0``, ...) as the span needs,
    so they are combined by ``bit_or`` in a plain hash aggregate, before the
    shuffle too.  Kind 1 has its date as ``on`` and no bits.  ``key`` is the
    transaction reference in its own type.
    """
    first, last = asof.span(*_read_windows(with_target))
    posted = F.col("POSTDATE")
    rows = lines.where((posted >= F.lit(first)) & (posted <= F.lit(last)))
    word, bit = _date_place(posted, first)
    words = [f"dates_{k}" for k in range((last - first).days // _DATE_WORD + 1)]
    none = F.lit(None)
    two = F.explode(F.array(
        F.struct(F.col("TRANSREFNO").alias("key"), none.cast("date").alias("on")),
        F.struct(none.cast(lines.schema["TRANSREFNO"].dataType).alias("key"), posted.alias("on"))))
    both = rows.select("customer_level", word.alias("word"), _shift(bit).alias("date"), exact_sales(lines).alias("sales"), two.alias("k"))
    is_line = F.col("k.on").isNull()
    dates = [F.when(is_line & (F.col("word") == k), F.col("date")).otherwise(F.lit(0).cast("long")).alias(w) for k, w in enumerate(words)]

    def combined(rows: DataFrame) -> DataFrame:
        return rows.groupBy("customer_level", "key", "on").agg(*(F.bit_or(w).alias(w) for w in words), F.sum("sales").alias("sales"))

    out = combined(both.select("customer_level", "k.key", "k.on", *dates, F.when(~is_line, F.col("sales")).alias("sales")))
    out = out if keys is None else combined(_with_company(out, keys))
    return out.withColumn("kind", F.when(F.col("on").isNull(), 0).otherwise(1))


def _dates_of(words: list[str]) -> Column:
    """The set bits of a row's date words, as days after the first date read.

    Nearly every transaction has one date, whose place is the number of bits
    below it; only words of several dates are looked through bit by bit.
    """
    def places(k: int, word: str) -> Column:
        w = F.col(word)
        several = F.filter(F.sequence(F.lit(0), F.lit(_DATE_WORD - 1)),
                           lambda i: F.call_function("shiftright", w, i).bitwiseAND(F.lit(1)) == 1)
        bits = F.when(F.bit_count(w) == 1, F.array(F.bit_count(w - 1))).otherwise(several)
        return F.when(w != 0, F.transform(bits, lambda i: i + k * _DATE_WORD)).otherwise(F.array().cast("array<int>"))

    return F.concat(*(places(k, w) for k, w in enumerate(words)))


def _calendar(asof: AsOf, with_target: bool, month_mode: str, n_weeks: int) -> DataFrame:
    """Per (as-of day, date of its windows) the packed flags, and whether the date's sales count."""
    windows = _read_windows(with_target)
    starts, ends = ([F.col(RANGES[w][k]) for w in windows] for k in (0, 1))
    days = asof.frame.withColumn("POSTDATE", F.explode(F.sequence(F.least(*starts), F.greatest(*ends))))
    tests = _window_tests(n_weeks, month_mode)
    in_any = reduce(Column.__or__, (F.col("POSTDATE").between(a, b) for a, b in zip(starts, ends, strict=True)))
    return days.where(in_any).select("loop_day", "POSTDATE", *_packed(n_weeks, month_mode, with_target), tests["in_month"].alias("counted"))


def days_flags(lines: DataFrame, asof: AsOf, keys: DataFrame | None, with_target: bool, month_mode: str,
               n_weeks: int) -> DataFrame:
    """Several days: packed bits and sales per (day, entity, transaction).

    Dates meet the days by an equi-join with the calendar, which holds the
    flags of each date, so nothing is worked out per line and day.
    """
    dated = posting_dates(lines, asof, keys, with_target)
    words = [c for c in dated.columns if c.startswith("dates_")]
    first = asof.span(*_read_windows(with_target))[0]
    held = F.when(F.col("on").isNull(), _dates_of(words)).otherwise(F.array(F.date_diff(F.col("on"), F.lit(first))))
    apart = dated.select("customer_level", "kind", "key", "on", "sales", F.explode(held).alias("day"))
    met = apart.withColumn("POSTDATE", F.date_add(F.lit(first), F.col("day"))).join(_calendar(asof, with_target, month_mode, n_weeks), "POSTDATE")
    is_line, zero = F.col("kind") == 0, F.lit(0).cast("long")
    bits = [F.when(is_line, F.col(w)).otherwise(zero).alias(w) for w in _words(n_weeks)]
    sales = F.when(F.col("counted"), F.col("sales"))
    rows = met.select("loop_day", "customer_level", "kind", "key", "on", *bits, sales.alias("sales"))
    return _merged(rows, ["loop_day", "customer_level", "kind", "key", "on"], n_weeks)


def entity_counts(flags: DataFrame, n_weeks: int = N_WEEKS) -> DataFrame:
    """Per (day, entity): distinct-transaction counts per bucket.

    Rows with a null transaction reference are not counted, but their sales
    are summed and they still mark the entity as present (as a grouping of
    the raw lines would).
    """
    valid = (F.col("kind") == 0) & F.col("key").isNotNull()

    def count_of(word: int, bit: int) -> Column:
        return F.sum(F.when(valid, _bit(f"bits_{word}", bit)).otherwise(F.lit(0))).cast("long")

    def any_of(mask: int, word: str = "bits_0") -> Column:
        return F.bit_or(F.col(word).bitwiseAND(F.lit(mask).cast("long")))

    weeks = [_week_place(j) for j in range(1, n_weeks + 1)]
    aggs = [count_of(0, k).alias(f"Month_{k}") for k in range(N_MONTHS)]
    aggs += [count_of(*place).alias(f"Week_{j}") for j, place in enumerate(weeks, 1)]
    aggs += [
        any_of((1 << N_MONTHS) - 1).alias("any_month"),
        F.sum("sales").alias("sales_sum"),
        count_of(0, _ACTIVE_BIT).alias("UNIQUE_TRANSREFNO_ACTIVE"),
        F.max(F.when(F.col("kind") == 0, _bit("bits_0", _TARGET_BIT))).alias("any_target"),
        count_of(0, _TARGET_BIT).alias("target_count"),
    ]
    return flags.groupBy(*_day_keys(flags, "customer_level")).agg(*aggs)


def _day_keys(df: DataFrame, *keys: str) -> list[str]:
    """Grouping keys, with ``loop_day`` first when the frame carries it
    (single-day frames have it added after; see ``entity_features``)."""
    return (["loop_day"] if "loop_day" in df.columns else []) + list(keys)


def _counts_by_distinct(rep: DataFrame, month_mode: str, n_weeks: int, with_target: bool) -> DataFrame:
    """Same columns as ``entity_counts`` from conditional count_distincts."""
    t, ref = _window_tests(n_weeks, month_mode), F.col("TRANSREFNO")
    target = t["target"] if with_target else F.lit(False)
    aggs = [F.count_distinct(F.when(t["month"] == k, ref)).alias(f"Month_{k}") for k in range(N_MONTHS)]
    aggs += [F.count_distinct(F.when(t["week"] == j, ref)).alias(f"Week_{j}") for j in range(1, n_weeks + 1)]
    aggs += [
        F.bit_or(F.when(t["in_month"], _shift(t["month"])).otherwise(F.lit(0).cast("long"))).alias("any_month"),
        F.sum(F.when(t["in_month"], exact_sales(rep))).alias("sales_sum"),
        F.count_distinct(F.when(t["active"], ref)).alias("UNIQUE_TRANSREFNO_ACTIVE"),
        F.max(F.when(target, 1).otherwise(0)).alias("any_target"),
        F.count_distinct(F.when(target, ref)).alias("target_count"),
    ]
    return rep.groupBy(*_day_keys(rep, "customer_level")).agg(*aggs)


def entity_features(ledger: DataFrame, asof: AsOf, level: str = "custno",
                    register: DataFrame | None = None, with_target: bool = True,
                    month_mode: str = "calendar", n_weeks: int = N_WEEKS,
                    strategy: str = "flags") -> DataFrame:
    """Per (day, entity) counts for every entity with a line in any window.

    The lag window is widened to hold ``n_weeks`` weeks.
    """
    asof = asof.reaching(7 * n_weeks - 1)
    if strategy == "flags":
        lines, keys = _customer_lines(ledger, register, level)
        flags = (day_flags if asof.single is not None else days_flags)(lines, asof, keys, with_target, month_mode, n_weeks)
        out = entity_counts(flags, n_weeks)
    elif strategy == "distinct":
        rep = asof.meet(entity_ledger(ledger, register, level), *_read_windows(with_target))
        # A constant day is left out of the grouping, so the aggregate stays
        # hash-partitioned on the entity alone.
        out = _counts_by_distinct(rep if asof.single is None else rep.drop("loop_day"), month_mode, n_weeks, with_target)
    else:
        raise ValueError("strategy must be 'flags' or 'distinct'")
    return out if asof.single is None else out.select(asof.day_literal(), "*")


def week_columns(n_weeks: int = N_WEEKS) -> list[str]:
    return [f"Week_{j}" for j in range(1, n_weeks + 1)] if n_weeks != N_WEEKS else list(WEEK_COLUMNS)


def live_customers(register: DataFrame, asof: AsOf, level: str = "custno",
                   extra: list[str] | None = None) -> DataFrame:
    """Register rows open on each as-of day, with ``killed`` (closes before
    the target window ends) and ``feature_days_customer``: one row per day and
    register row, so the as-of table meets the register on the live test
    itself, after literal bounds are pushed into the register scan.  Of a dated
    register (``sources.dated_register``) a day reads the snapshot it holds.
    """
    reg = _prefilter_register(register, asof)
    if asof.single is not None:
        j = asof.attach(reg).where(is_live("CREDATE", "KILLDATE", "feature_end"))
        j = j.where(_holds(j, F.col("feature_end")))
    else:
        w = asof.frame
        j = reg.join(w, is_live(reg["CREDATE"], reg["KILLDATE"], w["feature_end"]) & _holds(reg, w["feature_end"]), "inner")
    return j.select(
        "loop_day",
        F.col(level_column(level)).alias("customer_level"),
        *_register_columns(register),
        killed_flag("KILLDATE", "target_end").alias("killed"),
        customer_age_days("feature_end", "CREDATE").alias("feature_days_customer"),
        *(extra or []),
    )


def _prefilter_register(register: DataFrame, asof: AsOf) -> DataFrame:
    """Literal bounds every live row satisfies for some as-of day (pushed to
    the register scan)."""
    k = F.col("KILLDATE")
    bounds = (F.col("CREDATE") <= F.lit(asof.last_end)) & (k.isNull() | (k > F.lit(asof.first_end)))
    if _dated(register):
        bounds &= (F.col("VALID_FROM") <= F.lit(asof.last_end)) & (F.col("VALID_TO") > F.lit(asof.first_end))
    return register.where(bounds)


def _dated(register: DataFrame) -> bool:
    return set(VALIDITY_COLUMNS) <= set(register.columns)


def _holds(register: DataFrame, day: Column) -> Column:
    """Whether a register row is of the snapshot that ``day`` reads (true without dated snapshots)."""
    return (register["VALID_FROM"] <= day) & (register["VALID_TO"] > day) if _dated(register) else F.lit(True)


def _register_columns(register: DataFrame) -> list[Column]:
    """The register's own columns."""
    skip = VALIDITY_COLUMNS if _dated(register) else ()
    return [F.col(c) for c in register.columns if c not in skip]


def feature_frame(ledger: DataFrame, register: DataFrame, asof: AsOf, level: str = "custno",
                  with_label: bool = True, month_mode: str = "calendar", n_weeks: int = N_WEEKS,
                  strategy: str = "flags", latest: dt.date | None = None) -> DataFrame:
    """The model frame: one row per (as-of day, live register row) with
    activity in the active window.

    Columns: ``loop_day, customer_level``, every register column, ``killed``,
    ``Month_0..11``, ``Week_1..n``, ``total_sales`` (double),
    ``UNIQUE_TRANSREFNO_ACTIVE``, with a label also
    ``UNIQUE_TRANSREFNO_TARGET`` (null when no purchase) and ``target_churn``,
    then ``feature_days_customer``.

    At company level every register row of a live company gets its own row
    (the company's counts repeated), as in the analysed workload.

    With ``latest`` (newest posting date) and a label, ``label_mature`` marks
    rows whose whole target window lies within the data; a label is otherwise
    "no purchase yet", not "no purchase in a year".

    A dated register (``sources.dated_register``) gives every day the register
    columns of the snapshot it holds, at customer level.
    """
    if _dated(register) and level_column(level) != "CUSTNO":
        raise ValueError("a register of dated snapshots serves the customer level only")
    counts = (
        entity_features(ledger, asof, level, register, with_label, month_mode, n_weeks, strategy)
        .where(F.col("UNIQUE_TRANSREFNO_ACTIVE") > 0)
    )
    # Both sides meet on the entity; the day's dates come with the counts, and
    # the live test is part of the join.
    reg = _prefilter_register(register, asof).withColumn("_entity", F.col(level_column(level)))
    counts = asof.attach(counts.drop("loop_day")) if asof.single is not None else counts.join(asof.frame, "loop_day")
    live = is_live(reg["CREDATE"], reg["KILLDATE"], counts["feature_end"]) & _holds(reg, counts["feature_end"])
    j = (counts.join(reg, (counts["customer_level"] == reg["_entity"]) & live)
         .withColumn("killed", killed_flag("KILLDATE", "target_end"))
         .withColumn("feature_days_customer", customer_age_days("feature_end", "CREDATE")))
    label = []
    if with_label:
        label = [
            F.when(F.col("any_target") == 1, F.col("target_count")).cast("long")
            .alias("UNIQUE_TRANSREFNO_TARGET"),
            F.when(F.col("any_target") == 1, F.lit(0)).otherwise(F.lit(1)).alias("target_churn"),
        ]
        if latest is not None:
            label.append((F.col("target_end") <= F.lit(latest)).alias("label_mature"))
    return j.select(
        "loop_day",
        "customer_level",
        *_register_columns(register),
        "killed",
        *MONTH_COLUMNS,
        *week_columns(n_weeks),
        F.coalesce(F.col("sales_sum").cast("double"), F.lit(0.0)).alias("total_sales"),
        "UNIQUE_TRANSREFNO_ACTIVE",
        *label,
        "feature_days_customer",
    )


# ---------------------------------------------------------------------------
# The feature parts, as separate operators (long and wide forms).
# ---------------------------------------------------------------------------

def features_month(ledger: DataFrame, asof: AsOf, level: str = "custno",
                   register: DataFrame | None = None, month_mode: str = "calendar") -> DataFrame:
    """Wide month counts for every entity with a line in the trailing year
    (months without purchases are 0)."""
    c = entity_features(ledger, asof, level, register, False, month_mode)
    return c.where(F.col("any_month") != 0).select("loop_day", "customer_level", *MONTH_COLUMNS)


def features_week(ledger: DataFrame, asof: AsOf, level: str = "custno",
                  register: DataFrame | None = None, n_weeks: int = N_WEEKS) -> DataFrame:
    """Wide week counts for every entity with a line in the first weeks; reads
    those weeks only."""
    long = features_week_long(ledger, asof, level, register, n_weeks)
    return long.groupBy("loop_day", "customer_level").agg(*(
        F.coalesce(F.max(F.when(F.col("Week_variable") == j, F.col("UNIQUE_TRANSREFNO"))), F.lit(0)).cast("long").alias(f"Week_{j}")
        for j in range(1, n_weeks + 1)))


def total_sales(ledger: DataFrame, asof: AsOf, level: str = "custno",
                register: DataFrame | None = None) -> DataFrame:
    """Sales over the trailing year per entity (exact decimal sum)."""
    met = asof.meet(entity_ledger(ledger, register, level), "month")
    return met.groupBy("loop_day", "customer_level").agg(F.sum(exact_sales(met)).alias("total_sales"))


def active_customers(ledger: DataFrame, asof: AsOf, level: str = "custno",
                     register: DataFrame | None = None) -> DataFrame:
    """Entities with at least one transaction in the active window, with the
    distinct count."""
    met = asof.meet(entity_ledger(ledger, register, level), "active")
    return (
        met.where(F.col("TRANSREFNO").isNotNull())
        .groupBy("loop_day", "customer_level")
        .agg(F.count_distinct("TRANSREFNO").alias("UNIQUE_TRANSREFNO_ACTIVE"))
    )


def target_counts(ledger: DataFrame, asof: AsOf, level: str = "custno",
                  register: DataFrame | None = None) -> DataFrame:
    """Distinct transactions in each day's target window, per entity with
    any line there."""
    met = asof.meet(entity_ledger(ledger, register, level), "target")
    return met.groupBy("loop_day", "customer_level").agg(
        F.count_distinct("TRANSREFNO").alias("UNIQUE_TRANSREFNO_TARGET"))


def churn_labels(ledger: DataFrame, register: DataFrame, asof: AsOf, level: str = "custno") -> DataFrame:
    """Label of every live customer: churn = no purchase in the target window."""
    live = live_customers(register, asof, level).select("loop_day", "customer_level")
    tgt = target_counts(ledger, asof, level, register)
    return live.join(tgt, ["loop_day", "customer_level"], "left").select(
        "loop_day", "customer_level", "UNIQUE_TRANSREFNO_TARGET",
        F.when(F.col("UNIQUE_TRANSREFNO_TARGET").isNull(), F.lit(1)).otherwise(F.lit(0)).alias("target_churn"),
    )


def features_month_long(ledger: DataFrame, asof: AsOf, level: str = "custno",
                        register: DataFrame | None = None, month_mode: str = "calendar") -> DataFrame:
    """Distinct transactions per (day, entity, relative month)."""
    return (
        asof.meet(entity_ledger(ledger, register, level), "month")
        .select("loop_day", "customer_level", "TRANSREFNO",
                _month_of(month_mode)("POSTDATE", "feature_end").alias("Month_variable"))
        .groupBy("loop_day", "customer_level", "Month_variable")
        .agg(F.count_distinct("TRANSREFNO").alias("UNIQUE_TRANSREFNO"))
    )


def features_week_long(ledger: DataFrame, asof: AsOf, level: str = "custno",
                       register: DataFrame | None = None, n_weeks: int = N_WEEKS) -> DataFrame:
    """Distinct transactions per (day, entity, week bucket); the lag window is
    widened to hold ``n_weeks``, lines older than the last bucket are dropped."""
    return (
        asof.reaching(7 * n_weeks - 1).meet(entity_ledger(ledger, register, level), "lag")
        .select("loop_day", "customer_level", "TRANSREFNO",
                week_bucket("POSTDATE", "feature_end", n_weeks).alias("Week_variable"))
        .where(F.col("Week_variable").isNotNull())
        .groupBy("loop_day", "customer_level", "Week_variable")
        .agg(F.count_distinct("TRANSREFNO").alias("UNIQUE_TRANSREFNO"))
    )


def daily_lag_counts(ledger: DataFrame, asof: AsOf, level: str = "custno",
                     register: DataFrame | None = None, n_lags: int = 0) -> DataFrame:
    """Distinct transactions per (day, entity, lag in days) for lines in
    ``[lag_start, feature_end)`` — lags run from 1 to the lag window's length,
    at least ``n_lags``."""
    return (
        asof.reaching(n_lags).meet(entity_ledger(ledger, register, level), "lag")
        .where(F.col("POSTDATE") < F.col("feature_end"))
        .select("loop_day", "customer_level", "TRANSREFNO",
                age_days("feature_end", "POSTDATE").cast("int").alias("lag"))
        .groupBy("loop_day", "customer_level", "lag")
        .agg(F.count_distinct("TRANSREFNO").alias("UNIQUE_TRANSREFNO"))
    )


def daily_lag_wide(ledger: DataFrame, asof: AsOf, level: str = "custno",
                   register: DataFrame | None = None, n_lags: int = 50) -> DataFrame:
    """``lag_1..lag_n`` columns (explicit pivot values, no discovery job),
    missing lags 0."""
    long = daily_lag_counts(ledger, asof, level, register, n_lags)
    lags = list(range(1, n_lags + 1))
    wide = long.groupBy("loop_day", "customer_level").pivot("lag", lags).agg(F.first("UNIQUE_TRANSREFNO"))
    return wide.select("loop_day", "customer_level",
                       *[F.coalesce(F.col(str(k)), F.lit(0)).cast("long").alias(f"lag_{k}") for k in lags])
