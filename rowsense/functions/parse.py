"""Strict parsers as Column functions: a value that isn't wholly understood is null, never guessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import SPACE, bind, collapsed, no_space, norm_flag, trimmed

NUMBER = r"[+-]?(?:\d+(?:\.\d+)?|\.\d+)(?:[eE][+-]?\d+)?"
# Words of qualitative results.
NEGATIVE = ("absent", "negative", "not detected", "nil", "-", "阴性", "未检出")
POSITIVE = ("present", "positive", "+", "++", "+++", "阳性", "检出")
TRACE = ("trace", "±", "+/-", "微量")
# Words of printed flags.
HIGH = ("↑", "h", "hi", "high", "偏高", "增高", "升高", "高")
LOW = ("↓", "l", "lo", "low", "偏低", "降低", "减低", "低")
ABNORMAL = ("*", "!", "a", "异常")
#: What may stand between a high and a low flag.
JOINERS = ("", "/", "|", "-")
#: Chinese digits; 两 is a two as well.
ZH_DIGITS = "零一二三四五六七八九"


def _as(x: Column, kind: str = "double") -> Column:
    return F.nullif(x, F.lit("")).try_cast(kind)


def finite(x: Column) -> Column:
    return F.when(F.abs(x) < float("inf"), x)


def parse_value(x: Column) -> Column:
    """A plain signed decimal, as a whole."""
    bare = trimmed(x)
    return F.when(bare.rlike(r"^[+-]?\d+(\.\d+)?$"), finite(bare.try_cast("double")))


def parse_scalar(x: Column) -> Column:
    """A number in any notation, with flags at its end."""
    bare = trimmed(F.regexp_replace(trimmed(x), r"(?iu)[↑↓HL]+$", ""))
    return F.when(bare.rlike(f"^{NUMBER}$"), finite(bare.try_cast("double")))


def readings_of(bare: Column) -> Column:
    """The two-sided readings of a text without white space: with two dashes between the ends, and with one separator."""
    end = lambda by, i: finite(_as(F.regexp_extract(bare, f"^({NUMBER}){by}({NUMBER})$", i)))
    pair = lambda by: F.when(end(by, 1) <= end(by, 2), F.struct(end(by, 1).alias("low"), end(by, 2).alias("high")))
    both = F.array_distinct(F.array_compact(F.array(F.when(bare.contains("--"), pair("--")), pair("[-~–—]"))))
    # No digit or point before a separator, no range: most other texts end here.
    none = F.expr("cast(array() as array<struct<low:double,high:double>>)")
    return F.when(bare.isNull(), F.lit(None)).when(bare.rlike("[0-9.][-~–—]"), both).otherwise(none)


def range_of(bare: Column, two: Column) -> Column:
    """What parse_range gives for a text without white space and its two-sided readings."""
    none, no = F.lit(None).cast("double"), F.lit(False)
    made = lambda low, high, low_open, high_open: F.struct(low.alias("low"), high.alias("high"), low_open.alias("low_open"), high_open.alias("high_open"))
    bound, strict = finite(_as(F.regexp_extract(bare, f"^(?:[<＜>＞≤≥]=?)({NUMBER})$", 1))), ~(bare.rlike("^[≤≥]") | bare.rlike("^.="))
    upper, lower = bare.rlike("^[<＜≤]"), bare.rlike("^[>＞≥]")
    return F.when(F.size(two) == 1, made(two[0]["low"], two[0]["high"], no, no)).when((F.size(two) == 0) & upper & bound.isNotNull(), made(none, bound, no, strict)).when((F.size(two) == 0) & lower & bound.isNotNull(), made(bound, none, strict, no))


def range_readings(x: Column) -> Column:
    """Distinct two-sided readings with low <= high, as array<struct<low, high>>."""
    return readings_of(no_space(x))


def parse_range(x: Column) -> Column:
    """struct<low, high, low_open, high_open>: two-sided inclusive, or one-sided; null where there is no or more than one reading."""
    return bind(no_space(x), lambda bare: bind(readings_of(bare), lambda two: range_of(bare, two)))


#: Distinct texts up to which every task gets all of them.
FEW = 50_000


def few(texts: DataFrame) -> DataFrame:
    """Distinct texts for a join: few are sent to every task, so that rows stay where they are; many meet rows by their hashes."""
    return F.broadcast(texts) if texts.limit(FEW + 1).count() <= FEW else texts


def with_ranges(rows: DataFrame, printed: str, name: str = "of", among: DataFrame | None = None) -> DataFrame:
    """rows with parse_range(printed) as `name`, each distinct text parsed once: reports print few of them. Null stays null.
    among: rows that have all texts of `rows`, if these are cheaper to read."""
    texts = few((rows if among is None else among).select(F.col(printed).alias("_text")).filter("_text is not null").distinct())
    bare = texts.select("_text", no_space(F.col("_text")).alias("_bare"))
    two = bare.select("_text", "_bare", readings_of(F.col("_bare")).alias("_two"))
    of = two.select("_text", range_of(F.col("_bare"), F.col("_two")).alias(name))
    return rows.join(of, rows[printed] == of["_text"], "left").drop("_text")


def parse_value_range(x: Column) -> Column:
    """A value that is itself a range with both ends."""
    return bind(parse_range(x), lambda got: F.when(got["low"].isNotNull() & got["high"].isNotNull(), got))


def parse_qualitative(x: Column) -> Column:
    table = dict.fromkeys(NEGATIVE, "negative") | dict.fromkeys(POSITIVE, "positive") | dict.fromkeys(TRACE, "trace")
    return F.element_at(F.create_map(*(F.lit(v) for kv in table.items() for v in kv)), collapsed(x))


def flag_direction(x: Column) -> Column:
    """high, low or abnormal; a flag that says both is abnormal; other text is null."""
    mixed = [a + j + b for h in HIGH for lo in LOW for j in JOINERS for a, b in ((h, lo), (lo, h))]
    table = dict.fromkeys((*mixed, *ABNORMAL), "abnormal") | dict.fromkeys(HIGH, "high") | dict.fromkeys(LOW, "low")
    # One map literal for all, looked up once.
    literal = ", ".join(f"'{k}', '{v}'" for k, v in table.items())
    return F.element_at(F.expr(f"map({literal})"), norm_flag(x))


def chinese_number(x: Column) -> Column:
    """A half, a digit, or a number below 100 in tens and ones; digits with commas are read as such."""
    x = F.translate(x, "两", "二")
    digit = lambda c: F.nullif(F.instr(F.lit(ZH_DIGITS), c), F.lit(0)) - 1
    tens, ones = F.regexp_extract(x, "^(.?)十(.?)$", 1), F.regexp_extract(x, "^(.?)十(.?)$", 2)
    composed = F.when(tens == "", F.lit(1)).otherwise(digit(tens)) * 10 + F.when(ones == "", F.lit(0)).otherwise(digit(ones))
    bare = F.regexp_replace(x, ",", "")
    return F.when(x == "半", F.lit(0.5)).when(x.rlike(f"^[{ZH_DIGITS}]?十[{ZH_DIGITS}]?$"), composed.cast("double")).when(x.rlike(f"^[{ZH_DIGITS}]$"), digit(x).cast("double")).when(bare.rlike(r"^\d+(\.\d+)?$"), bare.try_cast("double"))


def bilingual_pair(x: Column) -> Column:
    """struct<cjk, latin> of exactly two words, one in each script."""
    words = F.split(trimmed(x), SPACE)
    cjk, latin = F.filter(words, lambda w: w.rlike(r"^[\u3400-\u4dbf\u4e00-\u9fff]+$")), F.filter(words, lambda w: w.rlike(r"^[A-Za-z][A-Za-z0-9#%._\-]*$"))
    return F.when((F.size(words) == 2) & (F.size(cjk) == 1) & (F.size(latin) == 1), F.struct(cjk[0].alias("cjk"), latin[0].alias("latin")))


def specimen_prefix(x: Column) -> Column:
    """struct<specimen, rest> of a name that begins with a word for blood."""
    rest = trimmed(F.regexp_extract(trimmed(x), "^(血清|血浆|全血)(.+)$", 2))
    return F.when(rest != "", F.struct(F.lit("blood").alias("specimen"), rest.alias("rest")))
