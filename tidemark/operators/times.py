"""Timestamps of many notations, precisions and zones as one UTC instant.

An ordered cascade of anchored patterns is applied to each value; the first pattern
that matches decides, and parsing is strict (a field out of range gives null, never a
rolled-over date). Everything is a built-in expression, so it stays in generated code.

Policy
* a wall time without zone is local to the source's default zone (from a lookup);
* numeric day/month order follows the source's ``date_order``;
* a zone abbreviation has its meaning in the source's zone;
* a date alone is its local midnight;
* an ambiguous local time is the earlier instant, a skipped one is read with the offset
  before the change (the JVM's ``LocalDateTime.atZone`` rule, which ``to_utc_timestamp``
  follows);
* an age counts back from the capture instant in exact hours, days or weeks;
* open or vague values ("30+ days ago", "recently") and null-like tokens are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# How the months are written (English, German, Spanish, French; short and whole).
_MONTH_WORDS = """jan january januar jänner ene enero janv janvier
feb february februar febrero févr février
mar march mär märz mrz marzo mars
apr april abr abril avr avril
may mai mayo
jun june juni junio juin
jul july juli julio juil juillet
aug august ago agosto août
sep sept september septiembre set setiembre septembre
oct october okt oktober octubre octobre
nov november noviembre novembre
dec december dez dezember dic diciembre déc décembre"""
MONTHS = {word: number for number, line in enumerate(_MONTH_WORDS.splitlines(), 1) for word in line.split()}
# How the days of the week are written; what else stands before a date is no date.
WEEKDAYS = (
    "monday mon tuesday tue tues wednesday wed thursday thu thur thurs friday fri saturday sat sunday sun montag mo dienstag di mittwoch mi donnerstag do freitag fr samstag sa sonnabend sonntag so "
    "lunes lun martes miércoles mié jueves jue viernes vie sábado sáb domingo dom lundi mardi mercredi mer jeudi jeu vendredi ven samedi sam dimanche dim"
).split()

# Minutes east of UTC of a zone abbreviation where the source's zone says nothing else.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "PKT": 300, "IST": 330, "AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "AWST": 480,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}

# Abbreviations that mean something else in a zone ("zone prefix|abbreviation").
LOCAL_ABBREVIATIONS = {
    "Australia|EST": 600, "Australia|EDT": 660, "Australia|CST": 570, "Australia|CDT": 630,
    "Europe/Dublin|IST": 60, "Asia/Jerusalem|IST": 120, "Asia/Dhaka|BST": 360, "Asia/Manila|PST": 480, "Asia/Shanghai|CST": 480,
}

_WEEKDAY = rf"(?:(?iu:{'|'.join(sorted(WEEKDAYS, key=len, reverse=True))})\.?,? )?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?: ?([AaPp])\.?[Mm]\.?)?(?: Uhr)?"
_ZONE = r"(?: ?(Z|[+-]\d{2}:?\d{2}|[+-]\d{2}|(?:UTC|GMT)[+-]\d{1,2}(?::?\d{2})?|[A-Z]{1,5}|[A-Z][A-Za-z_]+/[A-Za-z_/]+)(?:\[[^\]]+\])?)?"

# The cascade: name, anchored pattern, groups of year, month, day (0: none), first group of the clock (0: none).
YMD = rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:[T ]{_CLOCK}{_ZONE})?$"
COMPACT = r"^((?:19|20)\d{2})(\d{2})(\d{2})(?:T?(\d{2})(\d{2})(\d{2})?()()" + _ZONE + r")?$"
DAY_NAME = rf"^{_WEEKDAY}(\d{{1,2}})(?:\.|st|nd|rd|th)?[ -](?:de )?(\p{{L}}{{3,10}})\.?,?[ -](?:de )?(\d{{4}})(?:,? (?:at |um |a las )?{_CLOCK}{_ZONE})?$"
NAME_DAY = rf"^{_WEEKDAY}(\p{{L}}{{3,10}})\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})(?:,? (?:at )?{_CLOCK}{_ZONE})?$"
NUMERIC = rf"^(\d{{1,2}})[./-](\d{{1,2}})[./-](\d{{4}}|\d{{2}})(?:,? {_CLOCK}{_ZONE})?$"
AGE = r"(?i)^(?:posted |about )?(\d{1,5}|an?|one) ?(h|hrs?|hours?|d|days?|w|wks?|weeks?|m|mins?|minutes?) ago$"
EPOCH = r"^(\d{10})(?:\.(\d{1,9}))?$"
EPOCH_FINE = r"^(?:\d{13}|\d{16})$"


def _int(text: Column) -> Column:
    return F.when(text != "", text.try_cast("int"))


def _literal_map(values: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _offset_seconds(zone: Column, local_zone: Column) -> Column:
    """Seconds east of UTC that a written zone names, null for a region or an unknown one."""
    bare = F.regexp_replace(F.regexp_replace(zone, "^(UTC|GMT)(?=[+-])", ""), ":", "")
    sign = F.when(bare.startswith("-"), -1).otherwise(1)
    digits = F.substring(bare, 2, 4)
    number = digits.try_cast("int")
    seconds = F.when(F.length(digits) <= 2, number * 3600).otherwise(F.floor(number / 100) * 3600 + number % 100 * 60)
    area = F.substring_index(local_zone, "/", 1)
    local = _literal_map(LOCAL_ABBREVIATIONS)
    named = F.coalesce(
        F.element_at(local, F.concat(local_zone, F.lit("|"), zone)),
        F.element_at(local, F.concat(area, F.lit("|"), zone)),
        F.element_at(_literal_map(ABBREVIATIONS), zone),
    )
    return F.when(bare.rlike("^[+-]"), sign * seconds).otherwise(named * 60)


def _micros(fraction: Column) -> Column:
    return F.when(fraction == "", F.lit(0)).otherwise(F.rpad(fraction, 6, "0").try_cast("int"))


#: The cascade: kind, anchored pattern, and the groups of year, month and day in it.
CASCADE = (("iso", YMD, "$1|$2|$3"), ("iso", COMPACT, "$1|$2|$3"), ("name", DAY_NAME, "$3|$2|$1"), ("name", NAME_DAY, "$3|$1|$2"), ("numeric", NUMERIC, "$1|$2|$3"))


def with_instants(rows: DataFrame, value: str, out: str, zone: str = "__zone", order: str = "__order", captured: str = "captured_at") -> DataFrame:
    """Add ``out``: microseconds since 1970-01-01 UTC named by the string column ``value``, or null.

    ``zone`` and ``order`` (the source's default zone and ``date_order``) may be null: then
    only values that carry their own zone, or raise no day/month question, come out. Values
    of any length are matched whole: every pattern is anchored at both ends.

    Three narrow projections, so that generated code stays small: pick the pattern and write
    the fields in one order; split them; compute the instant.
    """
    v = F.trim(F.regexp_replace(F.col(value), r"[\s\u00a0]+", " "))
    fields = F.when(F.col("__v").isNull(), None)
    for kind, pattern, ymd in CASCADE:
        fields = fields.when(F.col("__v").rlike(pattern), F.regexp_replace("__v", pattern, f"{kind}|{ymd}|$4|$5|$6|$7|$8|$9"))
    fields = fields.when(F.col("__v").rlike(EPOCH), F.regexp_replace("__v", EPOCH, "epoch|$1|$2"))
    fields = fields.when(F.col("__v").rlike(EPOCH_FINE), F.concat(F.lit("fine|"), F.col("__v")))
    fields = fields.when(F.col("__v").rlike(AGE), F.regexp_replace(F.lower("__v"), AGE, "age|$1|$2"))
    # explode(array(x)) keeps the stages apart: a filter on the result is not copied into them.
    staged = rows.withColumn("__v", v).withColumn("__f", F.explode(F.array(F.split(fields, "[|]", -1))))
    f = lambda i: F.get(F.col("__f"), F.lit(i))
    kind, first, second, third = f(0), _int(f(1)), _int(f(2)), _int(f(3))
    month = F.element_at(_literal_map(MONTHS), F.lower(f(2)))
    rule = F.when((F.col(order) == "ymd") & (F.length(f(3)) == 4), F.lit("dmy")).otherwise(F.col(order))
    numeric = kind == "numeric"
    year = F.when(~numeric | (rule == "ymd"), first).otherwise(third)
    half = F.lower(f(8))
    hour = _int(f(4))
    staged = staged.select(
        "*",
        F.when(year < 70, year + 2000).when(year < 100, year + 1900).otherwise(year).alias("__y"),
        F.when(kind == "name", month).when(~numeric | rule.isin("dmy", "ymd"), second).when(rule == "mdy", first).alias("__m"),
        F.when(~numeric | (rule == "ymd"), third).when(rule == "mdy", second).when(rule == "dmy", first).alias("__d"),
        F.when(f(4) == "", F.lit(0)).when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0)).alias("__h"),
        F.coalesce(_int(f(5)), F.lit(0)).alias("__mi"),
        F.coalesce(_int(f(6)), F.lit(0)).alias("__s"),
        _micros(f(7)).alias("__us"),
        f(9).alias("__z"),
    )
    wall = F.try_make_timestamp(
        years=F.col("__y"), months=F.col("__m"), days=F.col("__d"), hours=F.col("__h"), mins=F.col("__mi"),
        secs=F.col("__s").cast("decimal(16,6)"), timezone=F.lit("UTC"),
    )
    staged = staged.withColumn("__w", F.when(kind.isin("iso", "name", "numeric"), wall))
    z = F.col("__z")
    region = F.when(z == "", F.col(zone)).when(z.contains("/"), z)
    local = F.when((z == "") | z.contains("/"), F.unix_micros(F.to_utc_timestamp("__w", region)))
    local = local.otherwise(F.unix_micros("__w") - _offset_seconds(z, F.col(zone)).cast("bigint") * 1_000_000)
    count = F.when(f(1).rlike("^[0-9]"), _int(f(1))).otherwise(F.lit(1)).cast("bigint")
    unit = F.substring(f(2), 1, 1)
    seconds = F.when(unit == "h", 3600).when(unit == "d", 86400).when(unit == "w", 604800).when(unit == "m", 60)
    instant = (
        F.when(kind == "epoch", f(1).try_cast("bigint") * 1_000_000 + _micros(f(2)))
        .when(kind == "fine", f(1).try_cast("bigint") * F.when(F.length(f(1)) == 13, 1000).otherwise(1))
        .when(kind == "age", F.unix_micros(captured) - count * seconds.cast("bigint") * 1_000_000)
        .otherwise(local + F.col("__us"))
    )
    return staged.withColumn(out, F.explode(F.array(instant))).drop("__v", "__f", "__y", "__m", "__d", "__h", "__mi", "__s", "__us", "__z", "__w")


TIME_FIELDS = ("date_posted", "posted_at", "expires_at", "first_seen_at")
CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"


def with_zone_rules(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Attach ``local_zone`` and ``date_order`` of each row's source; unknown sources get nulls.

    ``sources`` is the small lookup; whether it is broadcast is left to the planner, which
    knows its size.
    """
    rules = sources.select(
        F.lower(F.trim("platform")).alias("__source"), F.col("local_zone").alias("__zone"), F.col("date_order").alias("__order")
    ).dropDuplicates(["__source"])
    return rows.withColumn("__source", F.lower(F.trim("platform"))).join(rules, "__source", "left").drop("__source")


def found_instants(postings: DataFrame, sources: DataFrame, fields: tuple[str, ...] = TIME_FIELDS) -> DataFrame:
    """One row per determinable value that is not yet in canonical form.

    Nulls, blanks, null-like tokens, open and vague values give no row; an empty table gives
    an empty result; other columns of ``postings`` are not read.
    """
    narrow = postings.select("posting_no", "platform", "captured_at", *fields)
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    long = (
        with_zone_rules(narrow, sources)
        .select("posting_no", "captured_at", "__zone", "__order", F.explode(pairs).alias("p"))
        .where(F.col("p.value").isNotNull() & F.col("p.value").rlike(r"\d|(?i) ago\s*$") & ~F.col("p.value").rlike(CANONICAL))
    )
    long = long.select("posting_no", "captured_at", "__zone", "__order", F.col("p.field").alias("field"), F.col("p.value").alias("__value"))
    found = with_instants(long, "__value", "utc_us").select("posting_no", "field", "utc_us")
    return found.where(F.col("utc_us").isNotNull())
