"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed into cells (one for each combination of source, language and
topic); the cells' weights are raked to the targets of each dimension in turn,
no cell above the tokens it has, until they stand still; documents are then
sampled with their cell's calibrated probability.  Only
cells take part in the rounds, and only built-in functions run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnscope.llm.common import broadcast_if_small, materialize

DIMENSIONS = ("source", "lang", "topic")
TEMPERATURE = 0.5     # target share of a value: its tokens to this power, normalised
ROUNDS = 24           # at most; fewer where the weights stand still before
TOLERANCE = 1e-13     # weights (they sum to 1) that move less than this in a round stand still
ROUNDS_A_PLAN = 4
BUDGET = 0.5          # tokens wanted, as a share of all
REFILLS = 5
FULL = 1 - 1e-9        # a cell asked for this share of its tokens counts as full, whatever the last bits of the sums
WINDOW_CELLS = 200_000  # up to so many cells a value's cells are summed in one task, beyond by a map-side sum and a join
BROADCAST_CELLS = 200_000  # cells (some 50 bytes each) up to this many go to every task; more are joined by shuffle
SEED = "mix"


def token_count(text: Column) -> Column:
    """Words: one more than the blanks and line ends; 0 for an empty or null text."""
    blanks = F.length(text) - F.length(F.translate(text, " \n", ""))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(blanks + 1).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic by marks in the text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return (F.when(low.contains("license") | low.contains("copyright"), "legal")
            .when(low.contains("@"), "contact")
            .when(low.contains(" | "), "table")
            .when(token_count(text) < 100, "note")
            .otherwise("prose"))


def described(docs: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, kept: list[str] | None = None) -> DataFrame:
    """``row`` (the columns ``kept`` of ``docs``, all by default), ``id``, ``tokens`` and one string column ``d0``,
    ``d1``, ... a dimension (null: empty).

    The caller's columns stand inside ``row``, so they may have any names.  A
    dimension ``topic`` that ``docs`` lacks is derived by :func:`topic_of`.
    """
    text = F.col("text")
    value = lambda d: topic_of(text) if d == "topic" and "topic" not in docs.columns else F.col(d)
    row = F.struct(*(F.col(f"`{c}`") for c in (docs.columns if kept is None else kept)))
    return docs.select(row.alias("row"), F.col("doc_id").alias("id"), token_count(text).alias("tokens"),
                       *(F.coalesce(value(d).cast("string"), F.lit("")).alias(f"d{k}") for k, d in enumerate(dimensions)))


def _scaled(now: DataFrame, key: str, target: str, by_window: bool) -> DataFrame:
    """``weight`` scaled to the target share of each value of ``key``, no cell above its ``room`` (null: no bound)."""
    if by_window:
        summed = now.withColumn("have", F.sum("weight").over(Window.partitionBy(key)))
    else:  # sums combined map-side and joined back; read twice, so written
        now = materialize(now)
        summed = now.join(now.groupBy(key).agg(F.sum("weight").alias("have")), key)
    raised = F.when(F.col("have") > 0, F.col("weight") * F.col(target) / F.col("have")).otherwise(0.0)
    return summed.select(*(c for c in now.columns if c != "weight"), F.least(raised, F.col("room")).alias("weight"))


def rake(cells: DataFrame, keys: list[str], targets: list[str], rounds: int = ROUNDS, tolerance: float = TOLERANCE,
         window_cells: int = WINDOW_CELLS) -> DataFrame:
    """Adds ``weight`` (sums to 1): ``tokens`` scaled in turn to each key's target share until no weight moves.

    ``targets``: columns with the target share of the row's value of each key.
    ``room``, if there, is the most a cell's weight may be: a full cell stays
    at it and the others of its values are raked further.  Stops when the
    weights of two rounds differ by ``tolerance`` in all, or after ``rounds``.
    Cells without tokens keep weight 0.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    now = cells.withColumn("weight", F.col("tokens") / F.lit(float(total)))
    if "room" not in cells.columns:
        now = now.withColumn("room", F.lit(None).cast("double"))
    by_window = cells.count() <= window_cells
    for n in range(0, rounds, ROUNDS_A_PLAN):
        for last in range(min(ROUNDS_A_PLAN, rounds - n))[::-1]:
            if not last:
                now = now.withColumn("before", F.col("weight"))
            for key, target in zip(keys, targets, strict=True):
                now = _scaled(now, key, target, by_window)
        now = materialize(now)
        moved = now.agg(F.sum(F.abs(F.col("weight") - F.col("before")))).first()[0]
        now = now.drop("before")
        if not moved or moved <= tolerance:
            break
    return now if "room" in cells.columns else now.drop("room")


def with_targets(cells: DataFrame, keys: list[str], temperature: float, given: dict[int, dict[str, float]]) -> DataFrame:
    """Adds ``t0``, ``t1``, ...: the target share of the row's value of each key.

    A key with ``given`` weights has those, a value that is not named 0; other
    keys their values' tokens to the power ``temperature``.  Shares are
    normalised over the values that occur.
    """
    raised = cells
    for k, key in enumerate(keys):
        values = Window.partitionBy(key)
        share = F.pow(F.sum("tokens").over(values).cast("double"), F.lit(temperature))
        if k in given:
            named = cells.sparkSession.createDataFrame([(v or "", float(w)) for v, w in given[k].items()], f"{key} string, t{k} double")
            raised = raised.join(named, key, "left").withColumn(f"t{k}", F.coalesce(f"t{k}", F.lit(0.0)))
        else:
            raised = raised.withColumn(f"t{k}", share)
        raised = raised.withColumn(f"c{k}", F.count("*").over(values))
    raised = materialize(raised)
    totals = raised.agg(*(F.sum(F.col(f"t{k}") / F.col(f"c{k}")) for k in range(len(keys)))).first()
    return raised.select(*cells.columns, *((F.col(f"t{k}") / F.lit(totals[k] or 1.0)).alias(f"t{k}") for k in range(len(keys))))


def probabilities(rows: DataFrame, keys: list[str], budget: float = BUDGET, temperature: float = TEMPERATURE,
                  rounds: int = ROUNDS, given: dict[int, dict[str, float]] | None = None) -> DataFrame:
    """One row a cell: keys, ``tokens``, ``t0``, ..., ``weight``, ``probability`` that one of its documents is sampled.

    A cell gives at most the tokens it has: raking holds full cells there and
    moves the others.  Where the targets are out of reach the expected tokens
    are still ``budget`` of all as far as cells with a target above 0 hold them:
    the rest is asked of the open cells in proportion (``REFILLS`` times).
    """
    cells = materialize(rows.groupBy(*keys).agg(F.sum("tokens").alias("tokens")))
    wanted = float(budget * (cells.agg(F.sum("tokens")).first()[0] or 0))
    room = F.col("tokens") / F.lit(wanted or 1.0)
    targets = with_targets(cells, keys, temperature, given or {}).withColumn("room", room)
    raked = materialize(rake(targets, keys, [f"t{k}" for k in range(len(keys))], rounds))
    scale = wanted
    for _ in range(REFILLS):
        asked = F.col("weight") * F.lit(scale)
        full, rest = raked.agg(F.sum(F.when(asked >= F.col("tokens") * FULL, F.col("tokens")).otherwise(0)),
                               F.sum(F.when(asked < F.col("tokens") * FULL, F.col("weight")).otherwise(0.0))).first()
        if not rest:
            break
        scale = (wanted - full) / rest
    share = F.when(F.col("tokens") > 0, F.col("weight") * F.lit(scale) / F.col("tokens")).otherwise(0.0)
    return raked.select(*keys, "tokens", *(f"t{k}" for k in range(len(keys))), "weight",
                        F.least(F.lit(1.0), share).alias("probability"))


def chance(id_column: str, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    digest = F.md5(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), "UTF-8"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16 ** 13)


def _by_place(targets: dict[str, dict[str, float]] | None, dimensions: tuple[str, ...]) -> dict[int, dict[str, float]]:
    unknown = set(targets or {}) - set(dimensions)
    if unknown:
        raise ValueError(f"targets for {sorted(unknown)}, which are no dimensions")
    return {dimensions.index(d): weights for d, weights in (targets or {}).items()}


def _with_chances(rows: DataFrame, dimensions: tuple[str, ...], budget: float, temperature: float, rounds: int,
                  targets: dict[str, dict[str, float]] | None) -> DataFrame:
    """``rows`` of :func:`described` with their ``probability``."""
    keys = [f"d{k}" for k in range(len(dimensions))]
    cells = probabilities(rows.select(*keys, "tokens"), keys, budget, temperature, rounds, _by_place(targets, dimensions))
    return rows.join(broadcast_if_small(cells.select(*keys, "probability"), BROADCAST_CELLS), keys)


def sample(docs: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, budget: float = BUDGET,
           temperature: float = TEMPERATURE, rounds: int = ROUNDS, seed: str = SEED,
           targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """The sampled rows of ``docs``, with its own columns alone (any names); see :func:`sampled`."""
    rows = _with_chances(described(docs, dimensions), dimensions, budget, temperature, rounds, targets)
    return (rows.filter(chance("id", seed) < F.col("probability"))
            .select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns)))


def sampled(docs: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, budget: float = BUDGET,
            temperature: float = TEMPERATURE, rounds: int = ROUNDS, seed: str = SEED,
            targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """``doc_id``, the dimensions' values, ``tokens``, ``probability`` and ``kept`` of every row of ``docs``.

    ``targets`` gives weights of a dimension's values (``{"lang": {"en": 2, "de": 1}}``);
    dimensions without take their own tokens to the power ``temperature``.
    Null dimensions count as the empty value; an empty or null text has no
    tokens, and a cell without tokens is never sampled.  Rows with equal ids
    fare alike where their cells do.  Other columns are ignored.
    """
    rows = _with_chances(described(docs, dimensions, ["doc_id"]), dimensions, budget, temperature, rounds, targets)
    return rows.select("row.doc_id", *(F.col(f"d{k}").alias(d) for k, d in enumerate(dimensions)), "tokens",
                       "probability", (chance("id", seed) < F.col("probability")).alias("kept"))


def shares(docs: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, budget: float = BUDGET,
           temperature: float = TEMPERATURE, rounds: int = ROUNDS, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """``dimension, value, wanted, reached``: every value's target share and its share of the expected sampled tokens.

    Without tokens ``reached`` is null.
    """
    keys = [f"d{k}" for k in range(len(dimensions))]
    rows = described(docs, dimensions, ["doc_id"])
    cells = materialize(probabilities(rows.select(*keys, "tokens"), keys, budget, temperature, rounds, _by_place(targets, dimensions)))
    total = cells.agg(F.sum(F.col("tokens") * F.col("probability"))).first()[0] or None
    per_dimension = [cells.groupBy(F.col(f"d{k}").alias("value")).agg(
        F.max(f"t{k}").alias("wanted"), (F.sum(F.col("tokens") * F.col("probability")) / F.lit(total)).alias("reached"))
        .select(F.lit(d).alias("dimension"), "value", "wanted", "reached") for k, d in enumerate(dimensions)]
    return reduce(DataFrame.unionByName, per_dimension)


def oracle_sql(table: str = "documents", budget: float = BUDGET, temperature: float = TEMPERATURE, rounds: int = ROUNDS) -> str:
    """The sampling in DuckDB SQL: all ``rounds``, also where the operator stops before as the weights stand still."""
    words = "case when coalesce(length(text), 0) = 0 then 0 else length(text) - length(translate(text, ' ' || chr(10), '')) + 1 end"
    low = "lower(coalesce(text, ''))"
    steps = [
        f"""d as (select doc_id, coalesce(source, '') as d0, coalesce(lang, '') as d1, ({words})::bigint as tokens,
  case when contains({low}, 'license') or contains({low}, 'copyright') then 'legal' when contains({low}, '@') then 'contact'
       when contains({low}, ' | ') then 'table' when {words} < 100 then 'note' else 'prose' end as d2 from {table})""",
        "c as (select d0, d1, d2, sum(tokens)::double as tokens from d group by all)",
    ]
    for k in range(3):
        steps.append(f"m{k} as (select d{k}, pow(sum(tokens), {temperature}) as t from c group by all)")
        steps.append(f"t{k} as (select d{k}, t / (select sum(t) from m{k}) as t{k} from m{k})")
    inner = "w"
    for k in range(3):  # one round: the three dimensions in turn
        have = f"sum(w) over (partition by d{k})"
        inner = f"(select * exclude (w), case when {have} > 0 then least(w * t{k} / {have}, room) else 0 end as w from {inner})"
    steps.append(f"s0 as (select {budget} * sum(tokens) as wanted, {budget} * sum(tokens) as s from c)")
    steps.append("w0 as (select c.*, t0, t1, t2, 0 as round, tokens / (select wanted from s0) as room, "
                 "tokens / (select sum(tokens) from c) as w from c join t0 using (d0) join t1 using (d1) join t2 using (d2))")
    steps.append("w as (select d0, d1, d2, tokens, t0, t1, t2, round, room, w from w0 union all "
                 f"select d0, d1, d2, tokens, t0, t1, t2, round + 1, room, w from {inner} where round < {rounds})")
    steps.append(f"raked as materialized (select * from w where round = {rounds})")
    for r in range(REFILLS):
        steps.append(f"s{r + 1} as (select any_value(wanted) as wanted, case when sum(case when w * s < tokens * {FULL!r} then w else 0 end) > 0 then "
                     f"(any_value(wanted) - sum(case when w * s >= tokens * {FULL!r} then tokens else 0 end)) / sum(case when w * s < tokens * {FULL!r} then w "
                     f"else 0 end) else any_value(s) end as s from raked, s{r})")
    steps.append(f"p as (select d0, d1, d2, case when tokens > 0 then least(1, w * s / tokens) else 0 end as p from raked, s{REFILLS})")
    chance_sql = f"('0x' || substr(md5('{SEED}:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint / {float(16 ** 13)!r}::double"
    return ("with recursive " + ",\n".join(steps) + f"""
select doc_id, d2 as topic, d.tokens, round(p, 6) as probability, {chance_sql} < p as kept
from d join p using (d0, d1, d2)""")
