"""Reading facts from a judge's output: JSON lines, else one JSON value, else plain lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_white

_FACT = "struct<text:string,content:string,category:string>"


def unfenced(text: Column) -> Column:
    """The inside of a code fence that opens the text; without a closing fence the text as it is."""
    t = trim_white(text)
    last = F.length(t) - F.instr(F.reverse(t), "```") - 1  # 1-based start of the last fence
    closed = t.startswith("```") & (last > 4)
    inner = F.substring(t, F.instr(t, "\n") + 1, F.greatest(last - F.instr(t, "\n") - 1, F.lit(0)))
    return F.when(closed, trim_white(inner)).otherwise(t)


def strict_json(text: Column) -> Column:
    """The variant of a text that is exactly one JSON value, else null.

    Parsers here ignore what follows a value, so the text is parsed between brackets before a hash of itself; only if the
    hash comes second, nothing but the value stood there.
    """
    guard = F.concat(F.lit("x"), F.hex(F.xxhash64(text)))
    pair = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), guard, F.lit('"]')))
    return F.when(F.try_variant_get(pair, "$[1]", "string") == guard, pair)


def _usable(text: Column, content: Column) -> Column:
    """The text of a fact: the first of both that is truthy (no null, empty string, zero or false)."""

    def truthy(x: Column) -> Column:
        return F.when(x.isNotNull() & ~x.isin("", "0", "false"), x)

    return F.coalesce(truthy(text), truthy(content))


def _fact_of(raw: Column) -> Column:
    text = _usable(raw["text"], raw["content"])
    category = F.when(raw["category"] != "", raw["category"]).otherwise("claim")
    return F.when(text.isNotNull(), F.struct(text.alias("text"), category.alias("category")))


def parse(output: Column) -> Column:
    """``array<struct<id, text, category>>`` of the facts of a judge's output, by the first tier that finds any."""
    body = unfenced(output)
    lines = F.filter(F.transform(F.split(body, "\n"), trim_white), lambda x: x != "")

    def from_line(line: Column) -> Column:
        value = F.when(line.startswith("{"), strict_json(line))
        raw = F.struct(*[F.try_variant_get(value, f"$[0].{k}", "string").alias(k) for k in ("text", "content", "category")])
        return F.when(value.isNotNull(), _fact_of(raw))

    def kept(items: Column) -> Column:
        return F.filter(items, lambda x: x.isNotNull())

    by_line = kept(F.transform(lines, from_line))
    whole = strict_json(body)
    items = F.when(body.startswith("["), F.try_variant_get(whole, "$[0]", f"array<{_FACT}>"))
    single = F.when(body.startswith("{"), F.array(F.try_variant_get(whole, "$[0]", _FACT)))
    by_value = kept(F.transform(F.coalesce(items, single, F.array().cast(f"array<{_FACT}>")), _fact_of))
    plain = F.filter(lines, lambda x: (F.length(x) > 10) & ~x.rlike(r"^[\[\]{},\s]*$"))
    by_text = F.transform(plain, lambda x: F.struct(x.alias("text"), F.lit("claim").alias("category")))
    chosen = F.when(F.size(by_line) > 0, by_line).when(F.size(by_value) > 0, by_value).otherwise(by_text)
    return F.transform(chosen, lambda f, i: F.struct(F.concat(F.lit("fact-"), i.cast("string")).alias("id"), f["text"].alias("text"), f["category"].alias("category")))


#: The categories of facts.
CATEGORIES = ("event", "person", "date", "place", "statistic", "law-policy", "claim")


def prompt(response: Column, language: Column) -> Column:
    """A judge's prompt for the facts of an answer, in the answer's language."""
    kinds = ", ".join(CATEGORIES)
    english = f'List each verifiable statement of the text, one JSON object a line: {{"text": "...", "category": "..."}} and nothing else.\nCategories: {kinds}\n\nText:\n'
    chinese = f'请列出文本中每个可验证的事实，每行一个 JSON 对象：{{"text": "...", "category": "..."}}，不要输出其他内容。\n分类：{kinds}\n\n文本：\n'
    return F.concat(F.when(language == "zh", chinese).otherwise(english), response)


def exploded(df: DataFrame, output: str, keep: list[str]) -> DataFrame:
    """One row for each fact of each output."""
    return df.select(*keep, F.posexplode(parse(F.col(output))).alias("fact_no", "fact")).select(*keep, "fact_no", "fact.id", "fact.text", "fact.category")
