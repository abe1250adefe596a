"""Prompt and task records: generators, matched joins, behaviour summaries, audits."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import DIGIT_TASKS, number_words, transform_digits

# Tasks, contexts, and the boundary targets of a smoke run.
WORD_TASKS = ("numeric_copy", "word_copy")
TASKS = (*DIGIT_TASKS, *WORD_TASKS)
CONTEXTS = (0, 1)
SMOKE = tuple(sorted({*range(1, 11), *(k * 10**e for k in range(1, 10) for e in (1, 2, 3)), 99, 999, 9999, 10_000}))
# The demonstrations of each context, for digit tasks and for copying.
DIGIT_DEMOS = ((1379, 4820, 6053, 7248, 9186, 3502, 8614, 2097), (2468, 9130, 5072, 3694, 8521, 4306, 7815, 1029))
COPY_DEMOS = ((7, 46, 234, 817, 3, 92, 506, 681), (9, 58, 361, 926, 2, 74, 405, 713))


def intervals_of(groups: DataFrame, half_width: int = 20) -> DataFrame:
    """(i, low, high): the numbers around 10 ** i that a group draws from; the first group has 1 to 39."""
    p = F.pow(F.lit(10.0), F.col("i")).cast("long")
    return groups.select("i", F.when(F.col("i") == 1, F.lit(1)).otherwise(p - half_width).cast("long").alias("low"), F.when(F.col("i") == 1, F.lit(2 * half_width)).otherwise(p + half_width).cast("long").alias("high"))


def numeral_prompts(spark: SparkSession, k: int = 30, examples: int = 4, groups: int = 4, context: str = "random", upper: int = 9999, seed: int = 0, half_width: int = 20) -> DataFrame:
    """(group, pos, numbers, target): k targets a group, all drawn before any context, then each with its examples.

    ``context``: `random` numbers up to ``upper`` for each prompt, the group's first targets (`same`), or the `fixed` 4, 54, 432, 9543.
    """
    if context not in ("random", "same", "fixed"):
        raise ValueError(f"unknown context {context}")
    rng = random.Random(seed)
    pool = lambda g: list(range(1, 2 * half_width) if g == 1 else range(10**g - half_width, 10**g + half_width))
    drawn = [(g, [rng.choice(pool(g)) for _ in range(k)]) for g in range(1, groups + 1)]
    rows = []
    for g, targets in drawn:
        for pos, t in enumerate(targets):
            given = {"fixed": [4, 54, 432, 9543][:examples], "same": targets[:examples]}.get(context)
            rows.append((g, pos, [*([rng.randint(0, upper) for _ in range(examples)] if given is None else given), t], float(t)))
    return spark.createDataFrame(rows, "group int, pos int, numbers array<int>, target double")


def ordered_records(prompts: DataFrame) -> DataFrame:
    """Dense ids from 0 in the order of group and position.

    Ids come from each group's count and a row number within it, so no task sees all rows.
    """
    sizes = prompts.groupBy("group").agg(F.count("*").alias("n"))
    base = sizes.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a group
    rank = F.row_number().over(Window.partitionBy("group").orderBy("pos"))
    return prompts.join(F.broadcast(base.select("group", "base")), "group").withColumn("point_id", F.col("base") + rank - 1).drop("base")


def records(spark: SparkSession, n: int = 10_000, seed: int = 42, only: tuple[int, ...] | None = None) -> DataFrame:
    """Full-range prompt records: every target of 1..n with demonstrations of one to four digits.

    Demonstrations are drawn in target order for all targets, also where only some are kept, so a smoke run has the same ones.
    """
    rng = random.Random(seed)
    demos = [(t, *[rng.randint(10**d if d else 1, 10 ** (d + 1) - 1) for d in range(4)]) for t in range(1, n + 1)]
    rows = spark.createDataFrame(demos, "target long, A int, B int, C int, D int")
    if only:
        rows = rows.where(F.col("target").isin(*only))
    four = F.array("A", "B", "C", "D")
    return rows.select(
        (F.col("target") - 1).alias("point_id"), "target", F.col("target").cast("string").alias("target_string"), F.left(F.col("target").cast("string"), F.lit(1)).cast("int").alias("leading_digit"),
        F.length(F.col("target").cast("string")).alias("digit_count"), F.struct("A", "B", "C", "D").alias("demonstrations"), F.transform(four, lambda x: F.length(x.cast("string"))).alias("demonstration_digit_lengths"),
        F.transform(four, lambda x: x == F.col("target")).alias("demonstration_equals_target"),
        F.concat(F.array_join(F.transform(four, lambda x: F.concat(x.cast("string"), F.lit("="), x.cast("string"))), ","), F.lit(","), F.col("target").cast("string"), F.lit("=")).alias("prompt"), F.lit(seed).alias("seed"),
    ).withColumn("character_count", F.length("prompt"))


def drawn(seed: int, low: Column, high: Column, *what: Column) -> Column:
    """A whole number of low..high, both included, drawn by the md5 of the seed and ``what``: alike on any cluster and engine."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[w.cast("string") for w in what])), 1, 8), 16, 10).cast("long")
    return low + F.pmod(h, high - low + 1)


def records_of(targets: DataFrame, seed: int = 42) -> DataFrame:
    """Full-range prompt records of a table's ``targets(target)``, of any number: demonstrations of one to four digits, drawn by hash in the tasks.

    Ids are the targets less one, as of a full range.  A repeated target has the same demonstrations each time.
    """
    t = F.col("target").cast("string")
    demos = F.array(*[drawn(seed, F.lit(10**d if d else 1).cast("long"), F.lit(10 ** (d + 1) - 1).cast("long"), F.col("target"), F.lit(d)) for d in range(4)])
    rows = targets.select(F.col("target").cast("long").alias("target")).withColumn("demonstrations", demos)
    shown = F.transform("demonstrations", lambda x: F.concat(x.cast("string"), F.lit("="), x.cast("string")))
    return rows.select(
        (F.col("target") - 1).alias("point_id"), "target", t.alias("target_string"), F.left(t, F.lit(1)).cast("int").alias("leading_digit"), F.length(t).alias("digit_count"), "demonstrations",
        F.transform("demonstrations", lambda x: F.length(x.cast("string"))).alias("demonstration_digit_lengths"), F.transform("demonstrations", lambda x: x == F.col("target")).alias("demonstration_equals_target"),
        F.concat(F.array_join(shown, ","), F.lit(","), t, F.lit("=")).alias("prompt"), F.lit(seed).alias("seed"),
    ).withColumn("character_count", F.length("prompt"))


def same_context_prompts(numbers: DataFrame, examples: int = 4) -> DataFrame:
    """(group, pos, target, prompt) of ``numbers(group, pos, target)``: every number of a group after the group's first ones, as equations.

    The first ones are a bounded number a group, so they reach the others by a join on the group that is broadcast where groups are few.
    """
    first = numbers.withColumn("r", F.row_number().over(Window.partitionBy("group").orderBy("pos"))).where(F.col("r") <= examples)
    first = first.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "target"))), lambda x: F.concat_ws("=", x["target"].cast("string"), x["target"].cast("string"))).alias("shown"))
    return numbers.join(first, "group").select("group", "pos", "target", F.concat(F.array_join("shown", ","), F.lit(","), F.col("target").cast("string"), F.lit("=")).alias("prompt"))


def four_digit_sample(targets: DataFrame, n: int = 1000, seed: int = 42) -> DataFrame:
    """(pos, target): n of a table's different four-digit ``targets(target)`` without the demonstrations, ascending.

    Dealt round the leading digits in the order of a hash, 1000 and 9999 first in theirs, so a smaller n is a subset of a larger; all, if fewer.
    """
    shown = sorted({x for demos in DIGIT_DEMOS for x in demos})
    pool = targets.select(F.col("target").cast("long").alias("target")).where(F.col("target").between(1000, 9999) & ~F.col("target").isin(*shown)).distinct()
    turn = F.row_number().over(Window.partitionBy(F.floor(F.col("target") / 1000)).orderBy(F.col("target").isin(1000, 9999).cast("int").desc(), F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("target").cast("string"))), "target"))
    dealt = pool.withColumn("turn", turn).where(F.col("turn") <= n).orderBy("turn", F.floor(F.col("target") / 1000)).limit(n)
    return dealt.withColumn("pos", F.row_number().over(Window.orderBy("target")) - 1).select("pos", "target")  # n rows


def bad_records(rows: DataFrame) -> DataFrame:
    """Records that break an invariant, with the first one they break."""
    t = F.col("target").cast("string")
    problem = (
        F.when(F.col("point_id") != F.col("target") - 1, "point_id").when(F.col("target_string") != t, "target_string").when(F.col("leading_digit") != F.left(t, F.lit(1)).cast("int"), "leading_digit")
        .when(F.col("digit_count") != F.length(t), "digit_count").when(F.col("demonstration_digit_lengths") != F.array(*map(F.lit, (1, 2, 3, 4))), "demonstrations").when(~F.col("prompt").endswith(F.concat(F.lit(","), t, F.lit("="))), "prompt")
    )
    return rows.select("point_id", problem.alias("problem")).where("problem IS NOT NULL")


def four_digit_targets(spark: SparkSession, n: int = 1000, seed: int = 42) -> DataFrame:
    """(pos, target): n of 1000..9999 without the demonstrations, ascending: dealt round the leading digits, 1000 and 9999
    first in theirs, so a smaller n is a subset of a larger."""
    shown = {x for demos in DIGIT_DEMOS for x in demos}
    if not 1 <= n <= 9000 - len(shown):
        raise ValueError(f"n must be between 1 and {9000 - len(shown)}")
    rng, turns = random.Random(seed), []
    for digit in range(1, 10):
        pool = [t for t in range(1000 * digit, 1000 * (digit + 1)) if t not in shown]
        rng.shuffle(pool)
        pool.sort(key=lambda t: t not in (1000, 9999))  # stable: the boundary to the front
        turns += [(turn, digit, t) for turn, t in enumerate(pool)]
    dealt = sorted(t for _, _, t in sorted(turns)[:n])
    return spark.createDataFrame(list(enumerate(dealt)), "pos long, target long")


def task_text(task: Column, target: Column) -> Column:
    return F.when(task == "word_copy", number_words(target)).otherwise(target.cast("string"))


def task_output(task: Column, target: Column) -> Column:
    """What a task makes of a target: digits permuted, or the text as it is."""
    return F.coalesce(F.when(task.isin(*DIGIT_TASKS), transform_digits(target.cast("string"), task)), task_text(task, target))


def task_dataset(targets: DataFrame, copies: int = 1000) -> DataFrame:
    """Every task, in two contexts, on its targets: the four-digit ``targets(pos, target)``, or 1 to ``copies``.

    A context's demonstrations make its prompts' beginning; ids run through tasks, contexts and targets in that order.
    """
    spark, n = targets.sparkSession, targets.count()
    heads, base = [], 0
    for task in TASKS:
        digits = task in DIGIT_TASKS
        for c, demos in enumerate(DIGIT_DEMOS if digits else COPY_DEMOS):
            heads.append((task, c, list(demos), digits, base))
            base += n if digits else copies
    head = spark.createDataFrame(heads, "task string, context_id int, demo_values array<long>, digits boolean, base long")  # a row a context
    shown = F.transform("demo_values", lambda d: F.concat(task_text(F.col("task"), d), F.lit("="), task_output(F.col("task"), d)))
    head = head.withColumn("prefix", F.array_join(shown, ","))
    every = targets.withColumn("digits", F.lit(True)).unionByName(spark.range(copies).select(F.col("id").alias("pos"), (F.col("id") + 1).alias("target"), F.lit(False).alias("digits")))
    t = every.join(F.broadcast(head), "digits").withColumn("input_text", task_text(F.col("task"), F.col("target"))).withColumn("expected_output", task_output(F.col("task"), F.col("target")))
    return t.select(
        (F.col("base") + F.col("pos")).alias("point_id"), "task", "context_id", "target", "input_text", "expected_output",
        F.concat_ws("", F.col("prefix"), F.lit(","), F.col("input_text"), F.lit("=")).alias("prompt"), "demo_values", F.array_contains("demo_values", F.col("target")).alias("demonstration_equals_target"),
        (F.col("input_text") != F.col("expected_output")).alias("transformation_changed"), F.col("expected_output").startswith("0").alias("output_starts_zero"),
    )


def pilot_rows(dataset: DataFrame, n: int = 32, keys: tuple[str, ...] = ("task", "context_id"), order: str = "point_id", value: str = "target") -> DataFrame:
    """n evenly spaced rows of each group: those numbered round(i (len - 1) / (n - 1)), halves to even.

    A group of which none holds a zero digit, though some row does, has its first such row in place of the inner pick nearest to it.
    """
    w = Window.partitionBy(*keys)
    r = dataset.withColumn("_r", (F.row_number().over(w.orderBy(order)) - 1).cast("long")).withColumn("_n", F.count("*").over(w))
    count = F.least(F.lit(n), F.col("_n").cast("int"))
    wanted = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.bround(i * (F.col("_n") - 1) / F.greatest(count - 1, F.lit(1))).cast("long"))
    zero = F.col(value).cast("string").contains("0")
    r = r.withColumn("_w", wanted).withColumn("_i", F.array_position("_w", F.col("_r")))
    r = r.withColumn("_has", F.max((F.col("_i") > 0) & zero).over(w)).withColumn("_zero", F.min(F.when(zero, F.col("_r"))).over(w))
    inner = F.slice("_w", F.lit(2), F.greatest(count - 2, F.lit(0)))
    near = F.array_sort(F.transform(inner, lambda x, k: F.struct(F.abs(x - F.col("_zero")).alias("d"), k.alias("k"), x.alias("x"))))[0]["x"]
    swap = ~F.col("_has") & F.col("_zero").isNotNull() & (count > 2)
    chosen = F.when(swap, ((F.col("_i") > 0) & (F.col("_r") != near)) | (F.col("_r") == F.col("_zero"))).otherwise(F.col("_i") > 0)
    return r.where(chosen).drop("_r", "_n", "_w", "_i", "_has", "_zero")


def matched(rows: DataFrame, left: str, right: str, key: tuple[str, ...] = ("context", "target"), task: str = "task") -> DataFrame:
    """(key, left_*, right_*): two tasks' rows joined on context and target, never on a row's number."""
    a, b = rows.where(F.col(task) == left).drop(task), rows.where(F.col(task) == right).drop(task)
    rest = [c for c in a.columns if c not in key]
    return a.select(*key, *[F.col(c).alias(f"left_{c}") for c in rest]).join(b.select(*key, *[F.col(c).alias(f"right_{c}") for c in rest]), list(key))


def unmatched(rows: DataFrame, left: str, right: str, key: tuple[str, ...] = ("context", "target"), task: str = "task") -> DataFrame:
    """(key, missing): keys that one of two tasks lacks."""
    a, b = (rows.where(F.col(task) == t).select(*key).distinct() for t in (left, right))
    j = a.withColumn("l", F.lit(1)).join(b.withColumn("r", F.lit(1)), list(key), "full")
    return j.where("l IS NULL OR r IS NULL").select(*key, F.when(F.col("l").isNull(), left).otherwise(right).alias("missing"))


def adopted(selected: DataFrame, sources: dict[str, DataFrame], style: str = "style", id_col: str = "point_id") -> tuple[DataFrame, DataFrame]:
    """Selected rows taken from the source their style names, and the rows whose shared fields differ, null-safely compared."""
    parts = None
    for name, df in sources.items():
        one = df.withColumn(style, F.lit(name))
        parts = one if parts is None else parts.unionByName(one)
    shared = [c for c in selected.columns if c in parts.columns and c not in (style, id_col)]
    j = selected.join(parts.select(style, id_col, *[F.col(c).alias(f"_{c}") for c in shared], *[c for c in parts.columns if c not in selected.columns]), [style, id_col])
    same = F.lit(True)
    for c in shared:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    hidden = [f"_{c}" for c in shared]
    return j.where(same).drop(*hidden), j.where(~same).drop(*hidden)


def behaviour_summary(rows: DataFrame) -> DataFrame:
    """Counts and accuracies by task and context, by task, and overall: one aggregation over grouping sets.

    Accuracies are NULL where no row qualifies; ``warning`` marks an accuracy below 0.8.
    """
    ok = F.col("exact_match").cast("double")
    part = lambda c: F.avg(F.when(c, ok))
    spread = rows.groupingSets([["task", "context"], ["task"], []], "task", "context")
    out = spread.agg(
        F.count("*").alias("n"), F.avg(ok).alias("accuracy"), F.count_if("changed").alias("changed_n"), part(F.col("changed")).alias("changed_accuracy"), part(~F.col("changed")).alias("unchanged_accuracy"),
        F.count_if("leading_zero").alias("zero_n"), part(F.col("leading_zero")).alias("zero_accuracy"), F.count_if("hit_limit").alias("limit_n"), F.grouping_id().alias("grouping"),
    )
    return out.withColumn("warning", F.col("accuracy") < 0.8)


def coverage_gaps(rows: DataFrame, keys: list[str], expected: int) -> DataFrame:
    """Groups that have another number of rows than expected, and how many they have."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") != expected)


def budget(ledger: DataFrame, limit: float, order: str = "started", cost: str = "reserved") -> DataFrame:
    """The ledger with its running total, and whether the reservation at that point is within the limit.

    Totals are summed by day first, so the window without a partition sees a row a day.
    """
    day = F.to_date(order)
    days = ledger.groupBy(day.alias("_day")).agg(F.sum(cost).alias("_sum"))
    before = days.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("_sum")
    w = Window.partitionBy("_day").orderBy(order, "job").rowsBetween(Window.unboundedPreceding, 0)
    run = ledger.withColumn("_day", day).join(F.broadcast(before), "_day").withColumn("total", F.col("_before") + F.sum(cost).over(w))
    return run.drop("_day", "_before").withColumn("admitted", F.col("total") <= limit)


def reservation_cost(seconds: Column, rate: Column, grace: float = 240.0, margin: float = 1.25) -> Column:
    return margin * (seconds + grace) * rate


def referential_audit(records: DataFrame, parts: DataFrame, key: str, part_key: str, fields: dict[str, tuple[str, float]], grid: tuple[str, str]) -> DataFrame:
    """(finding, id, n) of records and their parts, everything that doesn't fit together, counted by record.

    ``no_parts`` and ``no_record``: keys on one side of a full join only; ``repeated``: keys and part keys met more than once; ``field <name>``: records whose stored value is
    further from the sum over their parts than the room that ``fields`` (name: expression over the parts, room) gives; ``grid <value>``: combinations of the parts' two ``grid``
    columns that no part has, though each value is had, with the first value's number of parts.
    """
    sums = parts.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("n"), *[F.sum(F.expr(e)).alias(f"_{name}") for name, (e, _) in fields.items()])
    joined = records.join(sums, F.col(key) == F.col("_k"), "full")
    out = joined.where("_k IS NULL").select(F.lit("no_parts").alias("finding"), F.col(key).alias("id"), F.lit(0).cast("long").alias("n"))
    out = out.unionByName(joined.where(F.col(key).isNull()).select(F.lit("no_record").alias("finding"), F.col("_k").alias("id"), "n"))
    again = parts.groupBy(key, part_key).agg(F.count("*").alias("n")).where("n > 1")
    out = out.unionByName(again.select(F.lit("repeated").alias("finding"), F.col(key).alias("id"), "n"))
    for name, (_, room) in fields.items():
        off = joined.where(F.abs(F.col(name) - F.col(f"_{name}")) > room)
        out = out.unionByName(off.select(F.lit(f"field {name}").alias("finding"), F.col(key).alias("id"), "n"))
    a, b = (parts.groupBy(F.col(c).alias(c)).agg(F.count("*").alias(f"n_{c}")) for c in grid)
    had = parts.select(*grid).distinct()
    empty = a.join(F.broadcast(b), how="cross").join(had, list(grid), "left_anti")  # values are few: a row a combination
    return out.unionByName(empty.select(F.concat_ws(" ", F.lit("grid"), *[F.col(c).cast("string") for c in grid]).alias("finding"), F.lit(None).cast("long").alias("id"), F.col(f"n_{grid[0]}").alias("n")))
