"""The queries of problem 1 in SQL, for a check by another engine.

The SQL has no look-behind, so signs and leading decimal points are marked first, together with what stands before them.
"""

from __future__ import annotations

_UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"


def _replace(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, '{pattern}', {by}, 'g')"


def _normal(text: str) -> str:
    """The letters and numbers of a text: chr(2) marks a sign, chr(3) a leading point, chr(1) stands around numbers."""
    plain = f"replace(replace(lower(translate({text}, chr(1) || chr(2) || chr(3), '   ')), 'ς', 'σ'), 'ß', 'ss')"
    signs = _replace(plain, rf"(^|[^\p{{L}}\p{{N}}\p{{M}}]|[{_UNSPACED}])([+\-−＋－])([.．]?\p{{Nd}})", r"'\1' || chr(2) || '\2\3'")
    points = _replace(signs, r"(^|[^\p{L}\p{N}\p{M}.．])([.．]\p{Nd})", r"'\1' || chr(3) || '\2'")
    numbers = _replace(points, r"((?:\x02[+\-−＋－])?(?:\x03[.．]\p{Nd}+|\p{Nd}+(?:[.．]\p{Nd}+)*))", r"chr(1) || '\1' || chr(1)")
    bare = _replace(numbers, r"(\x01[^\x01]*\x01)|[^\x01\p{L}\p{M}\p{N}]+", r"'\1'")
    return f"replace(replace({bare}, chr(2), ''), chr(3), '')"


_RECORDS = (
    "lines AS (SELECT fact_key, extracted_at, CASE WHEN json_valid(line) AND regexp_matches(line, '^\\s*\\{') THEN line::JSON END AS o FROM fact_line), "
    "read AS (SELECT fact_key, extracted_at, coalesce(nullif(json_extract_string(o, '$.text'), ''), nullif(json_extract_string(o, '$.content'), '')) AS text, json_extract_string(o, '$.category') AS category FROM lines), "
    "delivered AS (SELECT fact_key, extracted_at, true AS is_record, text, category FROM fact UNION ALL SELECT fact_key, extracted_at, text IS NOT NULL, text, category FROM read), "
    "once AS (SELECT * FROM delivered WHERE fact_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fact_key ORDER BY extracted_at DESC) = 1), "
    f"records AS (SELECT fact_key, text, category, {_normal('text')} AS t, {_normal('category')} AS c FROM once WHERE is_record), "
    "grouped AS (SELECT *, min(fact_key) OVER g AS first_key, count(*) OVER g AS n FROM records WINDOW g AS (PARTITION BY t, c))"
)


def statements() -> dict[str, str]:
    return {
        "p1_found": f"WITH {_RECORDS} SELECT first_key, fact_key AS copy_key FROM grouped WHERE fact_key > first_key",
        "p1_distinct": f"WITH {_RECORDS} SELECT first_key, text, category, n AS n_records FROM grouped WHERE fact_key = first_key",
    }
