"""Generators, prompt records, task datasets, matched joins, budgets, validations."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..functions import text
from ..operators import tasks
from ..sources.tables import behaviour, cube, points, table
from ..staging import staged
from .base import BEHAVIOUR, rounded

def g1_intervals(spark, d):
    """The numbers that each length of the orders' keys draws from, and how many keys are among them."""
    o = table(spark, d, "orders").select("o_orderkey", F.length(F.col("o_orderkey").cast("string")).alias("i"))
    low = tasks.intervals_of(o.select("i").distinct())  # a row a length
    inside = F.count_if(F.col("o_orderkey").between(F.col("low"), F.col("high") - 1))
    return o.join(F.broadcast(low), "i").groupBy("i", "low", "high").agg(inside.alias("keys"))


def g2_prompts(spark, d):
    """A prompt for every order: its customer's number, its key's last digits, and its key left open."""
    o = table(spark, d, "orders")
    return o.select("o_orderkey", text.equation_prompt(F.array("o_custkey", F.pmod("o_orderkey", F.lit(97)), "o_orderkey")).alias("prompt"))


def g4_targets(spark, d):
    p = g2_prompts(spark, d)
    return p.select("o_orderkey", text.prompt_target(F.col("prompt")).alias("target"))


def g3_numeral_prompts(spark, d):
    """Every order's key after its priority's first four, as equations."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("group"), F.col("o_orderkey").alias("pos"), F.col("o_orderkey").alias("target"))
    return tasks.same_context_prompts(o)


def g5_ordered_records(spark, d):
    """Dense ids of all orders in the order of priority and key."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("group"), F.col("o_orderkey").alias("pos"))
    return tasks.ordered_records(o)


def _keys(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("target"))


def g6_records(spark, d):
    """Records of every order's key: digits, and the lengths of its demonstrations."""
    return tasks.records_of(_keys(spark, d)).select("point_id", "target", "leading_digit", "digit_count", F.array_join(F.col("demonstration_digit_lengths").cast("array<string>"), ",").alias("lengths"), F.array_max("demonstration_equals_target").alias("shown"))


def g6_prompts(spark, d):
    return tasks.records_of(_keys(spark, d)).select("point_id", "prompt", "character_count")


def g7_smoke(spark, d):
    """The records of those orders whose keys are boundary targets."""
    return tasks.records_of(_keys(spark, d)).where(F.col("target").isin(*tasks.SMOKE)).select("target", "digit_count", "prompt")


def g8_number_words(spark, d):
    """Parts' keys, modulo 1001, in words."""
    return table(spark, d, "part").select("p_partkey", text.number_words(F.pmod("p_partkey", F.lit(1001))).alias("words"))


def g9_transform_digits(spark, d):
    """The digit tasks on every order's key; NULL but for four digits."""
    t = table(spark, d, "orders").select("o_orderkey", F.explode(F.array(*map(F.lit, text.DIGIT_TASKS))).alias("task"))
    return t.select("o_orderkey", "task", text.transform_digits(F.col("o_orderkey").cast("string"), F.col("task")).alias("output"))


def _targets(spark, d):
    """Four-digit numbers of the line items: part keys and order keys."""
    li = table(spark, d, "lineitem")
    return tasks.four_digit_sample(li.select(F.explode(F.array("l_partkey", "l_orderkey")).alias("target")))


def g10_targets(spark, d):
    return _targets(spark, d)


def _dataset(spark, d):
    return tasks.task_dataset(staged(_targets(spark, d), "targets"))


def g11_dataset(spark, d):
    """Every task and context on the targets: what goes in and what is to come out."""
    return _dataset(spark, d).select("point_id", "task", "context_id", "target", "input_text", "expected_output")


def g12_pilot(spark, d):
    return tasks.pilot_rows(_dataset(spark, d)).select("task", "context_id", "point_id", "target")


def g13_base26(spark, d):
    return table(spark, d, "nation").select("n_nationkey", text.base26(F.col("n_name")).alias("number"))


def g14_models(spark, d):
    """Nations that customers name, resolved against those of suppliers; the unknown are reported, not dropped."""
    known = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("name")).agg(F.count("*").alias("levels"), F.max("s_suppkey").alias("width"))
    asked = table(spark, d, "customer").select(F.col("c_nationkey").alias("name")).distinct()
    return asked.join(known, "name", "left").select("name", F.coalesce("levels", F.lit(0)).alias("levels"), F.coalesce("width", F.lit(0)).alias("width"), F.col("levels").isNull().alias("unknown"))


def s14_prefix(spark, d):
    """Whether the digits of a target start those of its order: the token prefix test on whole tables."""
    o = table(spark, d, "orders")
    return o.select("o_orderkey", "o_custkey", text.is_prefix(text.digits(F.col("o_custkey")), text.digits(F.col("o_orderkey"))).alias("prefix"))


def s17_answers(spark, d):
    """Generated texts up to the first comma or line break."""
    return table(spark, d, "documents").select("doc_id", text.answer(F.col("text")).alias("answer"))


def j6_matched(spark, d):
    b = behaviour(spark, d).groupBy("task", "context", "target").agg(F.count("*").alias("n"), F.count_if("exact_match").alias("hits"))
    return tasks.matched(b, "A", "N")


def j6_unmatched(spark, d):
    return tasks.unmatched(behaviour(spark, d), "A", "N")


def j10_adoption(spark, d):
    """Line items chosen by status from two sources by flag, every shared field compared null-safely."""
    li = table(spark, d, "lineitem")
    one = li.groupBy(F.col("l_orderkey").alias("point_id")).agg(F.max("l_quantity").alias("q"))
    chosen = one.withColumn("style", F.when(F.pmod("point_id", F.lit(2)) == 0, "even").otherwise("odd"))
    good, _ = tasks.adopted(chosen, {"even": one.withColumn("extra", F.lit(0)), "odd": one.withColumn("extra", F.lit(1)).withColumn("q", F.when(F.pmod("point_id", F.lit(3)) == 0, F.lit(None)).otherwise(F.col("q")))})
    return good.select("point_id", "style", "q", "extra")


def o9_bad_records(spark, d):
    """Records of the orders' keys whose stored digits are those of other columns: each that breaks an invariant, with the first it breaks."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("target"), F.col("o_custkey").cast("string").alias("c"))
    made = tasks.records_of(o).join(o, "target")
    return tasks.bad_records(made.withColumn("leading_digit", F.left("c", F.lit(1)).cast("int")).withColumn("digit_count", F.length("c")))


def o9_bad_vectors(spark, d):
    """The cube with the vectors of some labels spoilt: without a vector, with none of its components, too short, with a NULL."""
    c = cube(spark, d).join(points(spark, d).select("point_id", "label"), "point_id")
    spoilt = F.when(F.col("label") == 0, F.lit(None)).when(F.col("label") == 1, F.slice("vec", 1, 0)).when(F.col("label") == 2, F.slice("vec", 1, 15)).when(F.col("label") == 3, F.transform("vec", lambda x, i: F.when(i > 0, x))).otherwise(F.col("vec"))
    return schemas.bad_vectors(c.select("level", "point_id", spoilt.alias("vec")))


def s3_missing_ids(spark, d):
    """Ids that a level lacks, where a level holds the points its label allows."""
    held = cube(spark, d).join(points(spark, d).select("point_id", "label"), "point_id").where("label >= level")
    return schemas.missing_ids(held, points(spark, d))


def o10_budget(spark, d):
    """Orders as reservations: the running total in order of date and key, and what a limit admits."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("job"), F.round("o_totalprice").alias("reserved"), F.col("o_orderdate").alias("started"))
    return tasks.budget(o, 5e7).select("job", "total", "admitted")


def o16_coverage(spark, d):
    return tasks.coverage_gaps(table(spark, d, "lineitem"), ["l_orderkey"], 4)


def o16_referential(spark, d):
    """Orders against their line items: keys on one side only, repeated lines, totals that the lines don't give, and combinations of line number and flag that never occur."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("total")).withColumnRenamed("o_orderkey", "l_orderkey")
    return tasks.referential_audit(o, table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", {"total": ("l_extendedprice * (1 - l_discount) * (1 + l_tax)", 50_000.0)}, ("l_linenumber", "l_returnflag"))


def o17_forecast(spark, d):
    """The most seconds of a model times its levels, rate and margin."""
    li = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.max("l_quantity").alias("most"), F.countDistinct("l_linenumber").alias("levels"))
    return rounded(li.select("l_returnflag", (F.col("most") * F.col("levels") * 0.0005 * 1.5).alias("cost")))


def o18_migration(spark, d):
    """Rows that differ between a table and a copy of it in which some names were lower-cased, both ways."""
    a = table(spark, d, "supplier")
    b = a.repartition(3).withColumn("s_name", F.when(F.col("s_acctbal") < 0, F.lower("s_name")).otherwise(F.col("s_name")))
    return a.exceptAll(b).unionByName(b.exceptAll(a)).select("s_suppkey", "s_name")


def _sql_list(names):
    return "[" + ", ".join(f"'{x}'" for x in names) + "]"


_SMALL = f"CASE WHEN n % 100 < 20 THEN {_sql_list(text.ONES)}[n % 100 + 1] WHEN n % 10 = 0 THEN {_sql_list(text.TENS)}[n % 100 // 10 + 1] ELSE {_sql_list(text.TENS)}[n % 100 // 10 + 1] || '-' || {_sql_list(text.ONES)}[n % 10 + 1] END"
_WORDS = f"CASE WHEN n = 1000 THEN 'one thousand' WHEN n < 100 THEN {_SMALL} WHEN n % 100 = 0 THEN {_sql_list(text.ONES)}[n // 100 + 1] || ' hundred' ELSE {_sql_list(text.ONES)}[n // 100 + 1] || ' hundred and ' || {_SMALL} END"
_DIGITS = "CASE task WHEN 'copy4' THEN s WHEN 'reverse4' THEN reverse(s) WHEN 'swap_first4' THEN s[2] || s[1] || s[3] || s[4] WHEN 'swap_last4' THEN s[1] || s[2] || s[4] || s[3] END"
_SAMPLE = f"""pool AS (SELECT DISTINCT target FROM (SELECT l_partkey AS target FROM lineitem UNION ALL SELECT l_orderkey FROM lineitem) WHERE target BETWEEN 1000 AND 9999 AND target NOT IN ({", ".join(str(x) for demos in tasks.DIGIT_DEMOS for x in demos)})),
turns AS (SELECT target, row_number() OVER (PARTITION BY target // 1000 ORDER BY (target IN (1000, 9999))::INT DESC, md5('42:' || target), target) AS turn FROM pool),
dealt AS (SELECT target FROM turns ORDER BY turn, target // 1000 LIMIT 1000), sample AS (SELECT row_number() OVER (ORDER BY target) - 1 AS pos, target FROM dealt)"""
_DRAWN = lambda k: f"({10**k if k else 1} + ('0x' || substr(md5('42:' || o_orderkey || ':{k}'), 1, 8))::BIGINT % {10 ** (k + 1) - (10**k if k else 1)})"
_RECORDS = f"r AS (SELECT o_orderkey AS target, o_orderkey::VARCHAR AS s, [{', '.join(_DRAWN(k) for k in range(4))}] AS demos FROM orders), p AS (SELECT *, array_to_string(list_transform(demos, lambda x: x || '=' || x), ',') || ',' || s || '=' AS prompt FROM r)"
_DATASET = f"""{_SAMPLE}, size AS (SELECT count(*) AS n FROM sample), t AS (SELECT pos, target, target::VARCHAR AS s FROM sample), c AS (SELECT n - 1 AS pos, n AS target, n::VARCHAR AS s, {_WORDS} AS word FROM range(1, 1001) r(n)),
k AS (SELECT task, context_id, coalesce(sum(CASE WHEN task LIKE '%4' THEN n ELSE 1000 END) OVER (ORDER BY i, context_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM (SELECT unnest({_sql_list(tasks.TASKS)}) AS task, unnest(range({len(tasks.TASKS)})) AS i), unnest([0, 1]) b(context_id), size),
ds AS (SELECT base + pos AS point_id, task, context_id, target, s AS input_text, {_DIGITS} AS expected_output FROM k JOIN t ON task LIKE '%4'
UNION ALL SELECT base + pos, task, context_id, target, CASE task WHEN 'word_copy' THEN word ELSE s END, CASE task WHEN 'word_copy' THEN word ELSE s END FROM k JOIN c ON task NOT LIKE '%4')"""

QUERIES = {
    "g1_intervals": (g1_intervals, "WITH k AS (SELECT o_orderkey, length(o_orderkey::VARCHAR)::INT AS i FROM orders), b AS (SELECT *, CASE WHEN i = 1 THEN 1 ELSE (10 ** i)::BIGINT - 20 END::BIGINT AS low, CASE WHEN i = 1 THEN 40 ELSE (10 ** i)::BIGINT + 20 END::BIGINT AS high FROM k) SELECT i, low, high, count(*) FILTER (o_orderkey >= low AND o_orderkey < high) AS keys FROM b GROUP BY ALL"),
    "g2_prompts": (g2_prompts, "SELECT o_orderkey, o_custkey || '=' || o_custkey || ',' || (o_orderkey % 97) || '=' || (o_orderkey % 97) || ',' || o_orderkey || '=' AS prompt FROM orders"),
    "g3_numeral_prompts": (g3_numeral_prompts, "WITH f AS (SELECT o_orderpriority AS g, string_agg(o_orderkey || '=' || o_orderkey, ',' ORDER BY o_orderkey) AS shown FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 4 GROUP BY g) SELECT g AS \"group\", o_orderkey AS pos, o_orderkey AS target, shown || ',' || o_orderkey || '=' AS prompt FROM orders JOIN f ON g = o_orderpriority"),
    "g4_targets": (g4_targets, "SELECT o_orderkey, o_orderkey::DOUBLE AS target FROM orders"),
    "g5_ordered_records": (g5_ordered_records, "SELECT o_orderpriority AS \"group\", o_orderkey AS pos, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1 AS point_id FROM orders"),
    "g6_records": (g6_records, f"WITH {_RECORDS} SELECT target - 1 AS point_id, target, left(s, 1)::INT AS leading_digit, length(s)::INT AS digit_count, array_to_string(list_transform(demos, lambda x: length(x::VARCHAR)), ',') AS lengths, list_contains(demos, target) AS shown FROM r"),
    "g6_prompts": (g6_prompts, f"WITH {_RECORDS} SELECT target - 1 AS point_id, prompt, length(prompt)::INT AS character_count FROM p"),
    "g7_smoke": (g7_smoke, f"WITH {_RECORDS} SELECT target, length(s)::INT AS digit_count, prompt FROM p WHERE target IN ({', '.join(map(str, tasks.SMOKE))})"),
    "g8_number_words": (g8_number_words, f"SELECT p_partkey, {_WORDS} AS words FROM (SELECT p_partkey, p_partkey % 1001 AS n FROM part)"),
    "g9_transform_digits": (g9_transform_digits, f"SELECT o_orderkey, task, CASE WHEN length(s) = 4 THEN {_DIGITS} END AS output FROM (SELECT o_orderkey, o_orderkey::VARCHAR AS s, task FROM orders, unnest({_sql_list(text.DIGIT_TASKS)}) u(task))"),
    "g10_targets": (g10_targets, f"WITH {_SAMPLE} SELECT pos, target FROM sample"),
    "g11_dataset": (g11_dataset, f"WITH {_DATASET} SELECT * FROM ds"),
    "g12_pilot": (g12_pilot, f"""WITH {_DATASET}, z AS (SELECT *, row_number() OVER (PARTITION BY task, context_id ORDER BY point_id) - 1 AS r, count(*) OVER (PARTITION BY task, context_id) AS n FROM ds),
w AS (SELECT *, list_transform(range(least(32, n)), lambda i: round_even(i * (n - 1) / greatest(least(32, n) - 1, 1), 0)::BIGINT) AS picks FROM z),
h AS (SELECT *, list_contains(picks, r) AS chosen, max((list_contains(picks, r) AND contains(target::VARCHAR, '0'))::INT) OVER (PARTITION BY task, context_id) AS has, min(CASE WHEN contains(target::VARCHAR, '0') THEN r END) OVER (PARTITION BY task, context_id) AS zero FROM w)
SELECT task, context_id, point_id, target FROM h WHERE chosen AND (has = 1 OR zero IS NULL)"""),
    "g13_base26": (g13_base26, "SELECT n_nationkey, list_reduce(list_prepend(0::BIGINT, list_transform(list_filter(string_split(lower(n_name), ''), lambda c: c BETWEEN 'a' AND 'z'), lambda c: (ascii(c) - 97)::BIGINT)), lambda s, v: s * 26 + v) AS number FROM nation"),
    "g14_models": (g14_models, "WITH k AS (SELECT s_nationkey AS name, count(*) AS levels, max(s_suppkey) AS width FROM supplier GROUP BY ALL), a AS (SELECT DISTINCT c_nationkey AS name FROM customer) SELECT name, coalesce(levels, 0) AS levels, coalesce(width, 0) AS width, levels IS NULL AS unknown FROM a LEFT JOIN k USING (name)"),
    "s14_prefix": (s14_prefix, "SELECT o_orderkey, o_custkey, starts_with(o_orderkey::VARCHAR, o_custkey::VARCHAR) AS prefix FROM orders"),
    "s17_answers": (s17_answers, r"SELECT doc_id, trim(regexp_split_to_array(text, '[\n\r,]')[1]) AS answer FROM documents"),
    "s3_missing_ids": (s3_missing_ids, "SELECT l::INT AS level, vec_id AS point_id FROM embeddings, range(4) t(l) WHERE label < l"),
    "j6_matched": (j6_matched, f"WITH {BEHAVIOUR}, b AS (SELECT task, context, target, count(*) AS n, count(*) FILTER (exact_match) AS hits FROM behaviour GROUP BY ALL) SELECT a.context, a.target, a.n AS left_n, a.hits AS left_hits, b.n AS right_n, b.hits AS right_hits FROM b a JOIN b ON a.task = 'A' AND b.task = 'N' AND a.context = b.context AND a.target = b.target"),
    "j6_unmatched": (j6_unmatched, f"WITH {BEHAVIOUR}, a AS (SELECT DISTINCT context, target FROM behaviour WHERE task = 'A'), n AS (SELECT DISTINCT context, target FROM behaviour WHERE task = 'N') SELECT *, 'N' AS missing FROM (FROM a EXCEPT FROM n) UNION ALL SELECT *, 'A' FROM (FROM n EXCEPT FROM a)"),
    "j10_adoption": (j10_adoption, "SELECT l_orderkey AS point_id, CASE WHEN l_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS style, max(l_quantity) AS q, (l_orderkey % 2)::INT AS extra FROM lineitem WHERE l_orderkey % 2 = 0 OR l_orderkey % 3 <> 0 GROUP BY l_orderkey"),
    "o9_bad_records": (o9_bad_records, "SELECT o_orderkey - 1 AS point_id, CASE WHEN left(o_orderkey::VARCHAR, 1) <> left(o_custkey::VARCHAR, 1) THEN 'leading_digit' ELSE 'digit_count' END AS problem FROM orders WHERE left(o_orderkey::VARCHAR, 1) <> left(o_custkey::VARCHAR, 1) OR length(o_orderkey::VARCHAR) <> length(o_custkey::VARCHAR)"),
    "o9_bad_vectors": (o9_bad_vectors, "SELECT l::INT AS level, vec_id AS point_id, CASE label WHEN 0 THEN 'null' WHEN 1 THEN 'empty' WHEN 2 THEN 'length' ELSE 'non-finite' END AS problem FROM embeddings, range(4) t(l) WHERE label < 4"),
    "o10_budget": (o10_budget, "WITH t AS (SELECT o_orderkey AS job, sum(round(o_totalprice)) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS total FROM orders) SELECT job, total, total <= 5e7 AS admitted FROM t"),
    "o16_coverage": (o16_coverage, "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) <> 4"),
    "o16_referential": (o16_referential, """WITH s AS (SELECT l_orderkey AS k, count(*) AS n, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS t FROM lineitem GROUP BY ALL), j AS (SELECT * FROM orders FULL JOIN s ON o_orderkey = k),
a AS (SELECT l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL), b AS (SELECT DISTINCT l_returnflag FROM lineitem)
SELECT 'no_parts' AS finding, o_orderkey AS id, 0::BIGINT AS n FROM j WHERE k IS NULL UNION ALL SELECT 'no_record', k, n FROM j WHERE o_orderkey IS NULL UNION ALL SELECT 'repeated', l_orderkey, count(*) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'field total', o_orderkey, n FROM j WHERE abs(o_totalprice - t) > 50000 UNION ALL SELECT 'grid ' || l_linenumber || ' ' || l_returnflag, NULL, n FROM a, b WHERE (l_linenumber, l_returnflag) NOT IN (SELECT l_linenumber, l_returnflag FROM lineitem)"""),
    "o17_forecast": (o17_forecast, "SELECT l_returnflag, round(max(l_quantity) * count(DISTINCT l_linenumber) * 0.0005::DOUBLE * 1.5::DOUBLE, 6) AS cost FROM lineitem GROUP BY l_returnflag"),
    "o18_migration": (o18_migration, "SELECT s_suppkey, unnest([s_name, lower(s_name)]) AS s_name FROM supplier WHERE s_acctbal < 0 AND s_name <> lower(s_name)"),
}
