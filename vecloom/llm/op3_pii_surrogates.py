"""PII surrogates: each detected entity is replaced by a keyed, type-consistent one.

One pattern finds e-mail and IPv4 addresses, telephone, card, social security and bank account numbers, access keys and tokens, and
names of persons (a known first name before a capitalised word, that word, and a capitalised word after a form
of address).  An entity's canonical form (digits alone, lower case) is replaced through one table for the whole corpus:
mentions of one entity, in whatever format, get one surrogate, written in the format of the mention.
First names keep gender and script, family names script, numbers their grouping and first digits, cards whether
their check digit is right, e-mail addresses their shape.

The table is made in rounds.  A keyed hash proposes a surrogate; of entities that are offered the same one the least
keeps it, and none keeps one that is itself an entity of the corpus or taken before; the others try again with the
next round's hash, whose space is larger.  So different entities of a type always have different surrogates.

DataFrame operations only.  Documents without an entity are neither moved nor changed; of the others, each text is moved once.
Null text stays null, empty text empty.  Rows that repeat an id are replaced each.  Other columns are kept, whatever their
names: the number of entities takes underscores before its name where the table has one of that name.

An e-mail address has at most 64 characters before its @, as in the mail standards; what is longer is no address.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, staged, table

KEY = "surrogate-key-1"
#: Attempts after which a number, whose space may be full, is lengthened by hexadecimal digits.
FULL = 24
#: A hot entity's mentions meet its surrogate in so many tasks.
SALTS = 8
# First names by script and gender, family names by script, titles: what is detected and what replaces it.
MALE = "James Robert Michael William David Richard Thomas Charles Daniel Matthew Andrew Kenneth George Edward Hans Klaus Jürgen Wolfgang Pierre François Laurent Carlos Miguel Javier".split()
FEMALE = "Mary Patricia Jennifer Linda Elizabeth Susan Karen Sarah Margaret Sandra Ashley Emily Donna Michelle Heike Ursula Sabine Monika Sophie Camille Nathalie Carmen Lucía Isabel".split()
MALE_CYRILLIC = "Иван Пётр Сергей Николай Андрей Дмитрий Алексей Михаил Владимир Юрий".split()
FEMALE_CYRILLIC = "Анна Мария Ольга Наталья Елена Татьяна Ирина Светлана Екатерина Людмила".split()
FAMILY = "Smith Johnson Brown Miller Davis Wilson Anderson Taylor Moore Jackson Martin Thompson Harris Clark Lewis Walker Allen Young Wright Adams Baker Nelson Carter Mitchell Turner Phillips Campbell Parker Evans Edwards Becker Schulz Hoffmann Wagner Dubois Lambert Fontaine Navarro Romero Serrano".split()
FAMILY_CYRILLIC = "Иваненко Петренко Сидоренко Кравченко Ткаченко Шевченко Бондаренко Коваленко Мельниченко Савченко".split()
TITLES = r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame|Signor|Signora)\.?"

_first = "|".join([*MALE, *FEMALE, *MALE_CYRILLIC, *FEMALE_CYRILLIC])
_name = r"\p{Lu}\p{Ll}[\p{Ll}'’-]*"
_octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+",
    "key": r"\bAKIA[0-9A-Z]{16}\b",
    "token": r"(?=[A-Za-z0-9_-]{16})(?<=\b(?i:token|secret|password|api_key|apikey)\s{0,3}[=:]\s{0,3}[\"']?)[A-Za-z0-9_-]{16,}",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": rf"(?<![\d.])(?:{_octet}\.){{3}}{_octet}(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)[3-6]\d{3}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}(?!\d)",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{3}[ .-])\d{3}[ .-]?\d{4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)",
    # The look ahead first: looking behind costs most, and few places begin with a capital after a space.
    "name": rf"(?=\p{{Lu}}\p{{Ll}})(?:\b(?:{_first})(?= {_name})|(?<= )(?:(?<=\b(?:{_first}) )|(?<=\b{TITLES} )|(?<=\b{TITLES} \p{{Lu}}\p{{Ll}}{{1,60}} )){_name})",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def maybe(text: Column) -> Column:
    """Quick tests, of which every text with an entity passes one."""
    named = text.rlike(r"(?=\p{Lu}\p{Ll})(?:" + _first + "|" + TITLES + r") \p{Lu}")
    secret = (text.contains("=") | text.contains(":")) & text.rlike(r"(?i:token|secret|password|api_key|apikey)\s{0,3}[=:]")
    return text.rlike("[0-9@]") | named | secret | text.contains("AKIA")


def _in(c: Column, names: list[str]) -> Column:
    return c.isin(*names)


def kind(raw: Column) -> Column:
    """The type of a mention, from the mention alone."""
    full = lambda name: raw.rlike(f"^(?:{PATTERNS[name]})$")
    cyrillic = raw.rlike(r"\p{IsCyrillic}")
    digits = F.length(F.regexp_replace(raw, r"\D", ""))
    return (
        F.when(full("email"), "email").when(full("key"), "key").when(full("ip"), "ip").when(full("ssn"), "ssn")
        .when(raw.rlike(r"^[3-6][0-9 -]+$") & (digits >= 13), F.concat(F.lit("card"), digits))
        .when(raw.rlike(r"^[+(\d][\d ().+-]*$") & (digits < 16), F.concat(F.lit("phone"), F.least(digits, F.lit(10))))
        .when(full("iban"), F.concat(F.lit("iban"), F.length(F.regexp_replace(raw, " ", ""))))
        .when(_in(raw, MALE), "male").when(_in(raw, FEMALE), "female").when(_in(raw, MALE_CYRILLIC), "male_cyrillic").when(_in(raw, FEMALE_CYRILLIC), "female_cyrillic")
        .when(raw.rlike(r"^\p{Lu}[\p{Ll}'’-]+$"), F.when(cyrillic, "family_cyrillic").otherwise("family"))
        .otherwise("token")
    )


def canonical(kind_: Column, raw: Column) -> Column:
    return (
        F.when(kind_.rlike("^(?:ssn|card)"), F.regexp_replace(raw, r"\D", ""))
        .when(kind_.rlike("^phone"), F.right(F.regexp_replace(raw, r"\D", ""), F.lit(10)))  # with or without the country's code
        .when(kind_.rlike("^iban"), F.regexp_replace(raw, " ", ""))
        .when(kind_.isin("key", "token"), raw)
        .otherwise(F.lower(raw))
    )


def _byte(hash_: Column, i: Column) -> Column:
    """Byte i, counted round, of 64 hexadecimal digits."""
    return F.conv(F.substring(hash_, F.pmod(i, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(hash_: Column, at: int, names: list[str]) -> Column:
    n = F.conv(F.substring(hash_, at, 8), 16, 10).cast("long")
    return F.element_at(F.array(*[F.lit(x) for x in names]), (F.pmod(n, F.lit(len(names))) + 1).cast("int"))


def _shaped(text: Column, hash_: Column, keep: Column) -> Column:
    """The text with each letter and digit after the first ``keep`` characters replaced by one of its class."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    letters = lambda n, first: F.chr(n % F.when(text.rlike("^[0-9a-f]+$"), 6).otherwise(26) + first)

    def one(c: Column, i: Column) -> Column:
        b = _byte(hash_, i)
        return F.when(i < keep, c).when(c.rlike("[0-9]"), (b % 10).cast("string")).when(c.rlike("[a-z]"), letters(b, 97)).when(c.rlike("[A-Z]"), letters(b, 65)).otherwise(c)

    return F.array_join(F.transform(chars, one), "")


def _luhn(digits: Column) -> Column:
    """The sum that is a multiple of ten if the last digit checks the others."""
    n = F.length(digits)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.when((n - i) % 2 == 0, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.substring(digits, i, F.lit(1)).cast("int") + 1)))


def proposal(kind_: Column, canon: Column, attempt: Column, key: str = KEY) -> Column:
    """The surrogate that the keyed hash of this attempt offers, in canonical form but for the case of names."""
    hash_ = F.sha2(F.concat_ws("|", F.lit(key), F.sha2(F.concat_ws("|", F.lit(key), kind_, canon, attempt.cast("string")), 256)), 256)

    def names(first: list[str]) -> Column:
        one, two = _pick(hash_, 1, first), _pick(hash_, 9, first)
        # With every few attempts the space grows: one name, two, two and a made-up part.
        made = F.concat_ws("", *[F.concat(_pick(hash_, 17 + 8 * k, list("bdfgklmnprstv")), _pick(hash_, 21 + 8 * k, list("aeiou"))) for k in range(4)])
        made = made if first[0].isascii() else F.translate(made, "bdfgklmnprstvaeiou", "бдфгклмнпрствaеиоу".replace("a", "а"))
        return F.when(attempt < 4, one).when(attempt < 8, F.concat_ws("-", one, two)).otherwise(F.concat_ws("-", one, F.initcap(made)))

    luhn_ok = _luhn(canon) % 10 == 0
    number = _shaped(canon, hash_, F.lit(1))
    head = F.substring(number, F.lit(1), F.length(number) - 1)
    check = (10 - _luhn(F.concat(head, F.lit("0"))) % 10) % 10
    last = F.when(luhn_ok, check).otherwise((check + 1 + _byte(hash_, F.lit(31)) % 9) % 10)
    octets = F.concat_ws(".", *[(_byte(hash_, F.lit(i)) % 254 + 1).cast("string") for i in range(4)])
    local = _shaped(F.regexp_extract(canon, "^([^@]*)", 1), hash_, F.lit(0))
    email = F.concat(local, F.lit("@m"), F.substring(hash_, 49, 8), F.lit(".example."), _pick(hash_, 57, ["com", "org", "net"]))
    made = (
        F.when(kind_ == "email", email).when(kind_ == "ip", octets).when(kind_.startswith("card"), F.concat(head, last.cast("string")))
        .when(kind_.startswith("phone"), _shaped(canon, hash_, F.lit(0)))
        .when(kind_ == "key", _shaped(canon, hash_, F.lit(4))).when(kind_.startswith("iban"), _shaped(canon, hash_, F.lit(2)))
        .when(kind_ == "male", names(MALE)).when(kind_ == "female", names(FEMALE))
        .when(kind_ == "male_cyrillic", names(MALE_CYRILLIC)).when(kind_ == "female_cyrillic", names(FEMALE_CYRILLIC))
        .when(kind_ == "family", names(FAMILY)).when(kind_ == "family_cyrillic", names(FAMILY_CYRILLIC))
        .otherwise(_shaped(canon, hash_, F.lit(0)))
    )
    longer = (attempt >= FULL) & ~kind_.rlike("male|family")
    return F.when(longer, F.concat(made, F.when(kind_ == "ip", ".").otherwise(""), F.substring(hash_, 33, 16))).otherwise(made)


def surrogate_table(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, canon, surrogate) for distinct ``entities(kind, canon)``: a one-to-one table."""
    real = entities.select("kind", F.col("canon").alias("taken"))
    open_, done, attempt = entities, None, 0
    tasks = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:  # each round offers others, of a space that grows
        offered = staged(open_.repartition(tasks, "kind", "canon").withColumn("surrogate", proposal(F.col("kind"), F.col("canon"), F.lit(attempt), key)).withColumn("taken", F.lower("surrogate")), "op3-offered")
        first = offered.groupBy("kind", "taken").agg(F.min("canon").alias("canon"))
        used = real.withColumn("taken", F.lower("taken"))
        used = used if done is None else used.union(done.select("kind", F.lower("surrogate")))
        kept = offered.join(first, ["kind", "taken", "canon"], "left_semi").join(used, ["kind", "taken"], "left_anti")
        kept = staged(kept.select("kind", "canon", "surrogate"), "op3-kept")
        done = kept if done is None else done.unionByName(kept)
        attempt += 1
        open_ = staged(open_.join(kept, ["kind", "canon"], "left_anti"), "op3-open")
        if open_.isEmpty():
            return staged(done, "op3-done")


def written(kind_: Column, raw: Column, surrogate: Column) -> Column:
    """The surrogate in the format of the mention: its separators, and its case for e-mail addresses."""
    spaced = kind_.rlike("^(?:ssn|card|phone|iban)")
    chars = F.filter(F.split(raw, ""), lambda c: c != "")
    mark = lambda c: ~c.rlike("[0-9A-Za-z]")
    digits = F.regexp_replace(raw, r"\D", "")
    surrogate = F.when(kind_.rlike("^phone"), F.concat(F.substring(digits, F.lit(1), F.greatest(F.length(digits) - 10, F.lit(0))), surrogate)).otherwise(surrogate)
    taken = F.transform(chars, lambda c, i: F.when(mark(c), c).otherwise(F.substring(surrogate, i + 1 - F.size(F.filter(F.slice(chars, F.lit(1), i + 1), mark)), F.lit(1))))
    rest = F.substring(surrogate, F.size(chars) - F.size(F.filter(chars, mark)) + 1, F.length(surrogate))
    return F.when(spaced, F.concat(F.array_join(taken, ""), rest)).when((kind_ == "email") & (raw == F.upper(raw)), F.upper(surrogate)).otherwise(surrogate)


def replace_pii(docs: DataFrame, text_col: str = "text", key: str = KEY, count_col: str = "n_entities") -> DataFrame:
    """The table with its texts' entities replaced, and the number of them."""
    count_col = free_name(docs.columns, count_col)
    row, found, gaps = (free_name(docs.columns, n) for n in ("_row", "_found", "_gaps"))
    made, joined = (free_name(docs.columns, n) for n in ("_new", "_joined"))
    text = F.col(text_col)
    has = F.coalesce(maybe(text) & text.rlike(ENTITY), F.lit(False))
    clean = docs.where(~has).withColumn(count_col, F.lit(0).cast("long"))
    mentions = docs.where(has).withColumn(found, F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).withColumn(gaps, F.split(text, ENTITY, -1))
    mentions = staged(mentions.withColumn(row, F.monotonically_increasing_id()), "op3-mentions")
    each = mentions.select(F.col(row).alias("row"), F.posexplode(found).alias("pos", "raw"))
    each = each.withColumn("kind", kind(F.col("raw"))).withColumn("canon", canonical(F.col("kind"), F.col("raw")))
    each = staged(each, "op3-each")
    names = surrogate_table(staged(each.select("kind", "canon").distinct(), "op3-entities"), key)
    # A hot entity's mentions are dealt over several tasks, each with a copy of the table's row.
    names = names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    new = each.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(names, ["kind", "canon", "salt"]).select("row", F.struct("pos", written(F.col("kind"), F.col("raw"), F.col("surrogate")).alias("new")).alias("m"))
    new = new.groupBy("row").agg(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["new"]).alias(made)).withColumnRenamed("row", joined)
    changed = mentions.join(new.hint("merge"), F.col(row) == F.col(joined))
    built = F.array_join(F.flatten(F.transform(F.arrays_zip(F.col(gaps).alias("g"), F.concat(F.col(made), F.array(F.lit(""))).alias("n")), lambda p: F.array(p["g"], p["n"]))), "")
    changed = changed.select(*[built.alias(c) if c == text_col else F.col(c) for c in docs.columns], F.size(made).cast("long").alias(count_col))
    return clean.unionByName(changed)


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities")
