"""Operator 6: mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Token counts are summed by cell (source, language, topic). The cells' weights are then raked: scaled to the source
targets, to the language targets, to the topic targets, and again, until all three marginals hold. A document's weight is
that of its cell over the cell's tokens; its probability is that weight times a common factor, one at most, the factor
chosen so that the expected tokens meet the budget. A document stays when a hash of its id and text falls below it.

Targets not given are tempered shares: a category's share of all tokens to the power `temper`, scaled to one. Given ones
are scaled to one over the categories that occur; an occurring category without a target gets none of the mass. Targets
that no weights can meet, because cells they need don't occur, leave the nearest fit and a RuntimeWarning with its error;
so does a budget that the categories with a target don't hold.

Topics not given are learned: the TOPICS commonest words among those that at most MOST_SHARE of the documents hold (and
LEAST_SHARE at least) are anchors, and a document's topic is the first anchor in it, `other` without one. Words are runs
of anything but white space, as written; all documents are counted.

Any number of sources, languages and topics will do. Null source, language or topic is a category of its own (as the name
"\\0"). Null and blank texts have no tokens and weigh as their cell; a cell without tokens has weight 0. Repeated rows get the same
decision. Empty tables give empty results. Other columns stay in `mix`, whatever their names; `weighed` adds columns that
begin with `_ts_` and replaces others of those names.
"""

from __future__ import annotations

import json
import re
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name

SOURCE, LANG, TOPIC = DIMENSIONS = ("_ts_source", "_ts_lang", "_ts_topic")
SWEEPS, TOLERANCE = 100, 1e-6
#: Languages and topics up to which their factors are the driver's state; more of them are tables like the sources.
MAX_STATE = 100
MAX_BROADCAST_CELLS, MAX_BROADCAST_CHARS = 100_000, 8 << 20
TOPICS, LEAST_SHARE, MOST_SHARE = 24, 0.005, 0.1
_SPACE = r"[^\x20\x09-\x0D]+"


def anchor_words(docs: DataFrame) -> list[str]:
    """At most TOPICS words; the count of a word's documents folds before its exchange."""
    words = docs.select(F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("w")).where("w <> ''")
    df = words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    many = docs.count()
    top = df.where((F.col("n") > LEAST_SHARE * many) & (F.col("n") <= MOST_SHARE * many)).orderBy(F.desc("n"), "w").limit(TOPICS)
    return [r[0] for r in top.collect()]


def topic_of(text: Column, anchors: list[str]) -> Column:
    """The first of the anchors in a text; `other` without one."""
    if not anchors:
        return F.lit("other")
    found = F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?<!\S)({'|'.join(map(re.escape, anchors))})(?!\S)", 1)
    return F.when(found == "", "other").otherwise(found)


def cells_of(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """`docs` with `_ts_source`, `_ts_lang`, `_ts_topic` and `_ts_tokens`."""
    named = lambda c: F.coalesce(c.cast("string"), F.lit("\0"))
    topic = topic_of(F.col("text"), anchor_words(docs)) if topic is None else named(topic)
    return docs.withColumns({SOURCE: named(F.col("source")), LANG: named(F.col("lang")), TOPIC: topic, "_ts_tokens": F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(_SPACE)).cast("long")})


def _shares(sums: dict[str, float], given: dict[str, float] | None, temper: float) -> dict[str, float]:
    raw = {k: max(0.0, float(given.get(k, 0.0))) for k in sums} if given is not None else {k: float(v) ** temper if v else 0.0 for k, v in sums.items()}
    whole = sum(raw.values()) or 1.0
    return {k: v / whole for k, v in raw.items()}


def _of(values: dict[str, float], column: str | Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col(column) if isinstance(column, str) else column)


def _state(values: dict[str, float]) -> Column:
    """A map literal, as one expression whatever its size."""
    return F.from_json(F.lit(json.dumps(values)), "map<string,double>")


def rake(cells: DataFrame, targets: list[dict[str, float] | None], temper: float = 0.7) -> DataFrame:
    """`cells` (the three dimensions and their tokens t) with raked weights w, which sum to 1: t * a[source] * b[language] *
    c[topic].

    While languages and topics are few (MAX_STATE each), their factors are the state of the iteration: a source is one row
    with its cells, its factor follows from the others', and a sweep is one aggregation to a sum for each language and topic
    that occur together. With more of them all factors are tables, joined to the cells, and a sweep is a checkpoint. Both
    come to the same weights."""
    cells = cut(cells)
    small = [cells.groupBy(d).agg(F.sum("t")).limit(MAX_STATE + 1).collect() for d in (LANG, TOPIC)]
    if not small[0]:
        return cells.withColumn("w", F.lit(0.0))
    if max(map(len, small)) > MAX_STATE:
        out, off = _rake_tables(cells, targets, temper)
    else:
        out, off = _rake_state(cells, targets, temper, [{r[0]: float(r[1]) for r in x} for x in small])
    if off >= TOLERANCE:
        warnings.warn(f"the marginals are off by up to {off:.2g} after {SWEEPS} sweeps: cells that the targets need don't occur", RuntimeWarning, stacklevel=3)
    total = out.agg(F.sum("w")).first()[0] or 1.0
    return out.withColumn("w", F.col("w") / F.lit(float(total)))


def _rake_tables(cells: DataFrame, targets: list[dict[str, float] | None], temper: float) -> tuple[DataFrame, float]:
    spark, goals = cells.sparkSession, {}
    for d, given in zip(DIMENSIONS, targets):
        sums = cells.groupBy(d).agg(F.sum("t").cast("double").alias("s"))
        if given is None:
            raw = sums.select(d, F.when(F.col("s") > 0, F.pow("s", F.lit(temper))).otherwise(0.0).alias("raw"))
        else:
            table = spark.createDataFrame([(k, max(0.0, float(v))) for k, v in given.items()], f"{d} string, g double")
            raw = sums.join(table, d, "left").select(d, F.when(F.col("s") > 0, F.coalesce("g", F.lit(0.0))).otherwise(0.0).alias("raw"))
        whole = raw.agg(F.sum("raw")).first()[0] or 1.0
        goals[d] = cut(raw.select(d, (F.col("raw") / whole).alias("goal")))
    w, off = cells.withColumn("w", F.col("t").cast("double")), 1.0
    for _ in range(SWEEPS):
        for d in DIMENSIONS:
            factor = w.groupBy(d).agg(F.sum("w").alias("s")).join(goals[d], d).select(d, F.when(F.col("s") > 0, F.col("goal") / F.col("s")).otherwise(0.0).alias("f"))
            w = w.join(factor, d).select(*DIMENSIONS, "t", (F.col("w") * F.col("f")).alias("w"))
        w = cut(w)
        errors = [w.groupBy(d).agg(F.sum("w").alias("s")).join(goals[d], d).agg(F.max(F.abs(F.col("s") - F.col("goal")))).first()[0] for d in (SOURCE, LANG)]
        off = max(errors)
        if off < TOLERANCE:
            break
    return w, off


def _rake_state(cells: DataFrame, targets: list[dict[str, float] | None], temper: float, small: list[dict[str, float]]) -> tuple[DataFrame, float]:
    goal_b, goal_c = (_shares(x, g, temper) for x, g in zip(small, targets[1:]))
    rows = cells.groupBy(SOURCE).agg(F.sum("t").cast("double").alias("s"), F.collect_list(F.struct(F.col(LANG).alias("l"), F.col(TOPIC).alias("p"), F.col("t").cast("double").alias("t"))).alias("cells"))
    raw = F.pow("s", F.lit(temper)) if targets[0] is None else F.coalesce(_of(targets[0], SOURCE), F.lit(0.0)) if targets[0] else F.lit(0.0)
    rows = rows.withColumn("raw", F.when(F.col("s") > 0, raw).otherwise(0.0))
    many = cells.count()
    rows = cut(rows.coalesce(max(1, many // 50_000 + 1)))
    whole = rows.agg(F.sum("raw")).first()[0] or 1.0
    b, c, off = dict.fromkeys(goal_b, 1.0), dict.fromkeys(goal_c, 1.0), 1.0

    def fitted(b: dict, c: dict) -> DataFrame:
        """Cells with the factor `a` of their source, which fits sources under b and c."""
        fit = F.aggregate("cells", F.lit(0.0), lambda x, y: x + y["t"] * _state(b)[y["l"]] * _state(c)[y["p"]])
        a = F.when(fit > 0, F.col("raw") / whole / fit).otherwise(0.0)
        return rows.select(SOURCE, a.alias("a"), F.explode("cells").alias("x")).select(SOURCE, F.col("x.l").alias(LANG), F.col("x.p").alias(TOPIC), F.col("x.t").alias("t"), "a")

    for _ in range(SWEEPS):
        held = fitted(b, c).groupBy(LANG, TOPIC).agg(F.sum(F.col("a") * F.col("t"))).collect()
        got = dict.fromkeys(b, 0.0)
        for x, y, m in held:
            got[x] += m * b[x] * c[y]
        off = max(abs(got[k] - goal_b[k]) for k in b)
        b = {k: v * goal_b[k] / got[k] if got[k] > 0 else 0.0 for k, v in b.items()}
        got = dict.fromkeys(c, 0.0)
        for x, y, m in held:
            got[y] += m * b[x] * c[y]
        off = max(off, *(abs(got[k] - goal_c[k]) for k in c))
        c = {k: v * goal_c[k] / got[k] if got[k] > 0 else 0.0 for k, v in c.items()}
        if off < TOLERANCE:
            break
    return cut(fitted(b, c).select(*DIMENSIONS, "t", (F.col("a") * F.col("t") * _state(b)[F.col(LANG)] * _state(c)[F.col(TOPIC)]).alias("w"))), off


def common_factor(cells: DataFrame, budget: float) -> float:
    """The factor at which the cells' tokens, each kept with probability min(1, factor * w / t), come to the budget.

    It is at least the budget, since the weights sum to one, and at most the largest t / w, which keeps everything that has a
    weight; between them it is searched on grids of equal ratios."""
    t, w = F.col("t").cast("double"), F.col("w")
    high, holds = cells.where("w > 0").agg(F.max(t / w), F.coalesce(F.sum(t), F.lit(0.0))).first()
    if not high or not budget:
        return 0.0
    if holds < budget * (1 - 1e-9):
        warnings.warn(f"the cells with a weight hold {holds:.0f} tokens, the budget is {budget:.0f}: all of them are kept", RuntimeWarning, stacklevel=3)
        return high
    low = min(budget, high)
    for _ in range(4):
        grid = [low * (high / low) ** (k / 64) for k in range(65)]
        sums = cells.agg(*[F.coalesce(F.sum(F.least(t, w * F.lit(g))), F.lit(0.0)) for g in grid]).first()
        k = next((k for k in range(1, 65) if sums[k] >= budget), 64)
        low, high = grid[k - 1], grid[k]
    return high


def weighed(docs: DataFrame, source: dict | None = None, lang: dict | None = None, topic: dict | None = None, keep: float = 0.7, temper: float = 0.7, topic_column: Column | None = None, seed: int = 17) -> DataFrame:
    """`docs` with `_ts_tokens`, its cell, `_ts_weight`, `_ts_p` and `_ts_in`; `keep` is the budget's share of all tokens."""
    placed = cells_of(docs, topic_column)
    cells = rake(placed.groupBy(*DIMENSIONS).agg(F.sum("_ts_tokens").alias("t")), [source, lang, topic], temper)
    whole, many, chars = cells.agg(F.coalesce(F.sum("t"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(sum(F.length(d) for d in DIMENSIONS)), F.lit(0))).first()
    factor = common_factor(cells, keep * whole) if whole else 0.0
    weight = F.when(F.col("t") > 0, F.col("w") * F.lit(float(whole)) / F.col("t")).otherwise(0.0)
    table = cells.select(*DIMENSIONS, weight.alias("_ts_weight"), F.when(F.col("t") > 0, F.least(F.lit(1.0), F.lit(factor) * F.col("w") / F.col("t"))).otherwise(0.0).alias("_ts_p"))
    few = many <= MAX_BROADCAST_CELLS and chars <= MAX_BROADCAST_CHARS
    at = F.xxhash64("doc_id", "text", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    return placed.join(F.broadcast(table) if few else table, list(DIMENSIONS)).withColumn("_ts_in", at < F.col("_ts_p"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The sampled rows, with their own columns."""
    row = free_name(docs, "row")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), *[F.col(f"`{c}`") for c in docs.columns if not c.lower().startswith("_ts_")])
    return weighed(own, **options).where("_ts_in").select(f"{row}.*")
