"""Prompt and digit functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# British English number names.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "zero ten twenty thirty forty fifty sixty seventy eighty ninety".split()
# The tasks on four digits.
DIGIT_TASKS = ("copy4", "reverse4", "swap_first4", "swap_last4")


def _name(names: list[str], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))


def number_words(n: Column) -> Column:
    """0 to 1000 in words: `two hundred and thirty-four`."""
    n = n.cast("int")
    rest, ten, one = F.pmod(n, F.lit(100)), F.floor(F.pmod(n, F.lit(100)) / 10), F.pmod(n, F.lit(10))
    small = F.when(rest < 20, _name(ONES, rest)).when(one == 0, _name(TENS, ten)).otherwise(F.concat_ws("-", _name(TENS, ten), _name(ONES, one)))
    hundred = F.concat(_name(ONES, F.floor(n / 100)), F.lit(" hundred"))
    return F.when(n == 1000, "one thousand").when(n < 100, small).when(rest == 0, hundred).otherwise(F.concat(hundred, F.lit(" and "), small))


def transform_digits(text: Column, task: Column) -> Column:
    """Copy, reverse, or swap the first or last two of four digits; NULL for other texts.  Leading zeros stay."""
    c = lambda i: F.substring(text, i, 1)
    done = F.when(task == "copy4", text).when(task == "reverse4", F.reverse(text)).when(task == "swap_first4", F.concat(c(2), c(1), c(3), c(4))).when(task == "swap_last4", F.concat(c(1), c(2), c(4), c(3)))
    return F.when(text.rlike("^[0-9]{4}$"), done)


def equation_prompt(numbers: Column) -> Column:
    """`a=a,b=b,c=` of an array whose last number is left open."""
    given = F.transform(F.slice(numbers, F.lit(1), F.size(numbers) - 1), lambda x: F.concat(x.cast("string"), F.lit("="), x.cast("string")))
    return F.array_join(F.concat(given, F.array(F.concat(F.element_at(numbers, -1).cast("string"), F.lit("=")))), ",")


def prompt_target(prompt: Column) -> Column:
    """The number before the last `=`."""
    return F.regexp_extract(prompt, "([^,=]*)=[^=]*$", 1).cast("double")


def answer(generated: Column) -> Column:
    """A generated text up to its first comma or line break, stripped."""
    return F.trim(F.element_at(F.split(generated, "[\\n\\r,]"), 1))


def base26(text: Column) -> Column:
    """Letters a to z as digits of a number."""
    return F.aggregate(F.filter(F.split(F.lower(text), ""), lambda c: c.rlike("[a-z]")), F.lit(0).cast("long"), lambda s, c: s * 26 + F.ascii(c) - 97)


def digits(n: Column) -> Column:
    return F.transform(F.filter(F.split(n.cast("string"), ""), lambda c: c != ""), lambda c: c.cast("int"))


def is_prefix(short: Column, long: Column) -> Column:
    """Whether an array starts another."""
    return F.slice(long, F.lit(1), F.size(short)) == short
