"""Scalar text functions as column expressions. Lengths and slices count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as script engines trim it, as the inside of a character class.
WHITE = r"\s\u000B\u00A0\uFEFF\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: Any character besides line ends.
NOT_LINE_END = r"[^\n\r\u2028\u2029]"
CJK_CLASS = r"一-鿿㐀-䶿"

# Function words that don't count as overlap between a fact and a paragraph.
STOPWORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might can shall to of in for "
    "on with at by from as into through during before after above below between under again further then once here there when "
    "where why how all both each few more most other some such no nor not only own same so than too very just now also within "
    "without this that these those it its he she they them we you i me my your his her our their and but or if while because "
    "until about what which who whom"
).split()

# Words that never shape a title constraint.
ENTITY_STOPWORDS = (
    "the a an of to in for on with by from as at and or not this that these those it its his her their them they he she we you our "
    "is are was were be been being have has had do does did will would can could shall should may might must "
    "maintain maintains maintained said says say state states stated claim claims claimed argue argues argued won win wins elected "
    "became become becomes according also but however under over about during after before between while through against into upon "
    "的 是 在 了 和 与 及 也 但 而 为 被 对 从 中 上 下 有 会 将 曾 已 该 此 这 那 等 以及 现任 表示 指出 认为 称 说 强调 宣布 当选 成为 赢得 主张 担任 主持 领导"
).split()


def strings(values: list[str]) -> Column:
    """An array literal."""
    return F.array(*[F.lit(v) for v in values])


def trim_white(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{WHITE}]+|[{WHITE}]+$", "")


def has_cjk(text: Column) -> Column:
    return text.rlike(f"[{CJK_CLASS}]")


def words(text: Column) -> Column:
    """Content words: lower-case ASCII words of two characters and more that are no stopwords, duplicates kept."""
    parts = F.split(F.lower(text), "[^a-z0-9]+")
    return F.filter(parts, lambda w: (F.length(w) > 1) & ~F.array_contains(strings(STOPWORDS), w))


def cjk_bigrams(text: Column) -> Column:
    """The distinct pairs of neighbouring ideographs once everything else is deleted."""
    chars = F.regexp_replace(text, f"[^{CJK_CLASS}]", "")
    pairs = F.transform(F.sequence(F.lit(1), F.length(chars) - 1), lambda i: F.substring(chars, i, F.lit(2)))
    return F.when(F.length(chars) >= 2, F.array_distinct(pairs)).when(text.isNotNull(), F.array().cast("array<string>"))


def entity_words(text: Column) -> Column:
    """Words of three characters and more that may shape a title constraint, duplicates kept."""
    parts = F.split(F.lower(text), "[^a-z0-9]+")
    return F.filter(parts, lambda w: (F.length(w) > 2) & ~F.array_contains(strings(ENTITY_STOPWORDS), w))


def strip_html(text: Column) -> Column:
    """Tags dropped, then five entities decoded in this order."""
    out = F.regexp_replace(text, "<[^>]+>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#039;", "'")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def article_url(title: Column, lang: Column) -> Column:
    """The address of an article; the title is percent-encoded as script engines do it."""
    coded = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    for was, now in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        coded = F.replace(coded, F.lit(was), F.lit(now))
    host = F.when(lang == "en", "en.wikipedia.org").otherwise("zh.wikipedia.org")
    return F.concat(F.lit("https://"), host, F.lit("/wiki/"), coded)


def percent(x: Column) -> Column:
    """A share as a whole percentage, halves rounded up."""
    return F.round(x * 100, 0).cast("bigint")


def shortened(text: Column, n: int = 80) -> Column:
    return F.concat(F.substring(text, 1, n), F.when(F.length(text) > n, "...").otherwise(""))


def model_label(name: Column) -> Column:
    return F.substring_index(F.substring_index(name, "-MLX", 1), "-oQ", 1)


def time_ago(seconds: Column) -> Column:
    """An age in words."""
    return (
        F.when(seconds < 5, "just now")
        .when(seconds < 60, F.concat(F.floor(seconds).cast("string"), F.lit("s ago")))
        .when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m ago")))
        .otherwise(F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h ago")))
    )


def escaped(text: Column) -> Column:
    """Text made safe for markup."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def routed_job(path: Column) -> Column:
    """The job of a page address, or ''."""
    return F.regexp_extract(path, r"^/job/([A-Za-z0-9_]+)$", 1)


# The hundredths of a second below their decimal value as binary fractions (others are above it or equal).
_BELOW = (0.15, 0.35, 0.85, 0.95)


def duration(ms: Column) -> Column:
    """A duration in seconds with one decimal, '' for none. Rounding goes by the binary value of the seconds, as in the number
    type of web pages: 0.15 is a little less than 0.15 and becomes 0.1; true halves go up."""
    whole = ms.cast("bigint")
    seconds = whole / F.lit(1000.0)
    rest = seconds - F.floor(seconds)
    half = (whole % 1000) / F.lit(1000.0)
    up = F.when(rest != half, rest > half).otherwise(~half.isin(*_BELOW))
    tenths = F.when(whole % 100 == 50, F.floor(whole / 100) + up.cast("bigint")).otherwise(F.floor((whole + 50) / 100)).cast("bigint")
    told = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("s"))
    return F.when(F.coalesce(whole, F.lit(0)) != 0, told).otherwise("")
