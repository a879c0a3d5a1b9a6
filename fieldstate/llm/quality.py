"""Quality rules: a threshold table compiled into one Spark projection. Built-in functions only, no shuffle.

Ratios are compared as integers (100 * part against percent * whole), so no verdict hangs on rounding.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldstate.llm import common as C

#: Frequent function words of the four languages.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "on", "with", "as", "be", "at", "by", "this", "from",
    "der", "die", "und", "den", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "als",
    "le", "la", "les", "et", "de", "des", "du", "un", "une", "que", "qui", "dans", "pour", "par", "sur", "au", "en",
    "el", "los", "las", "del", "se", "por", "con", "para", "una", "y", "al", "lo", "no", "su",
)


@dataclass(frozen=True)
class Rule:
    """A document fails if 100 * ``part`` is above (or, with ``least``, below) ``percent`` * ``whole``."""

    name: str
    part: str
    whole: str
    percent: int
    least: bool = False


#: The threshold table. Measures are the columns of ``measures``.
RULES = (
    Rule("short_words", "word_chars", "n_words", 200, least=True),
    Rule("long_words", "word_chars", "n_words", 2000),
    Rule("symbols", "n_symbols", "n_words", 25),
    Rule("shouting", "n_marks", "n_words", 25),
    Rule("few_stop_words", "n_stop_words", "n_words", 2, least=True),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 50),
)


#: Columns of the steps between a text and its verdict.
STEPS = ("_t", "_w", "_l", "_n", "_tri", "_s", "_twice", "_m", "_b", "_f")


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` and a struct ``_m`` of counts. Each projection step names what the next reads more than once, so that no
    array is built again inside a lambda."""
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    tri = "concat_ws(' ', _w[i], _w[i + 1], _w[i + 2])"
    key = "substring({0}, 1, length({0}) - 9)"
    cover = "flatten(transform(_twice, x -> transform(sequence(0, 2), k -> cast(right(x, 9) as int) + k)))"
    return (
        docs.withColumn("_t", F.coalesce(F.col(text_col), F.lit("")))
        .withColumns({
            "_w": F.expr(r"filter(split(_t, '[\\x20\\x09-\\x0D]+', -1), w -> w <> '')"),
            "_l": F.expr(r"filter(split(_t, '\n', -1), l -> l rlike '[^\\x20\\x09-\\x0D]')"),
        })
        .withColumns({
            "_n": F.expr("size(_w)"),
            "_tri": F.expr(f"CASE WHEN size(_w) > 2 THEN transform(sequence(0, size(_w) - 3), i -> {tri}) ELSE array() END"),
        })
        # a tab stands in no word, so equal keys stay neighbours; nine digits hold any place in a string
        .withColumn("_s", F.expr(
            r"CASE WHEN size(array_distinct(_tri)) < size(_tri) "
            r"THEN sort_array(transform(_tri, (t, i) -> concat(t, '\t', lpad(cast(i as string), 9, '0')))) ELSE array() END"))
        .withColumn("_twice", F.expr(
            f"filter(_s, (x, i) -> (i > 0 AND {key.format('_s[i - 1]')} = {key.format('x')}) "
            f"OR (i + 1 < size(_s) AND {key.format('_s[i + 1]')} = {key.format('x')}))"))
        .withColumn("_m", F.struct(
            F.expr("cast(_n as long)").alias("n_words"),
            F.expr(r"cast(length(translate(_t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) as long)").alias("word_chars"),
            F.expr("cast(length(_t) - length(translate(_t, '#*$%&|<>', '')) as long)").alias("n_symbols"),
            F.expr("cast(length(_t) - length(translate(_t, '!?', '')) as long)").alias("n_marks"),
            F.expr("cast(size(_l) as long)").alias("n_lines"),
            F.expr("cast(size(_l) - size(array_distinct(_l)) as long)").alias("n_dup_lines"),
            F.expr(f"cast(size(array_distinct({cover})) as long)").alias("n_repeat_words"),
            F.expr(f"cast(size(filter(_w, w -> lower(w) IN ({stop}))) as long)").alias("n_stop_words"),
        ))
        .drop("_t", "_w", "_l", "_n", "_tri", "_s", "_twice")
    )


def base_failed(m: str = "_m") -> Column:
    return F.expr(f"{m}.n_words < 50 OR 100 * {m}.n_repeat_words > 50 * {m}.n_words")


def failed_rules(rules: tuple[Rule, ...] = RULES, m: str = "_m") -> Column:
    """Names of the rules that a document breaks, in the order of the table."""
    tests = [
        f"CASE WHEN 100 * {m}.{r.part} {'<' if r.least else '>'} {r.percent} * {m}.{r.whole} THEN '{r.name}' END" for r in rules
    ]
    return F.expr(f"filter(array({', '.join(tests)}), x -> x IS NOT NULL)")


def quality_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rows and columns of ``docs`` and a struct ``quality`` (counts, base_failed, failed array, kept).

    Null texts count as empty: no words, so they fail the base rule, as do all texts of fewer than 50 words. Repeated rows
    and ids are judged each for itself. An empty table gives an empty table; other columns pass through,
    whatever their names, but for one named ``quality``, which gives way to the result.
    """
    docs, names = C.aside(docs, *STEPS, "quality")
    m = measures(docs, names.get(text_col, text_col)).withColumns({"_b": base_failed(), "_f": failed_rules(rules)})
    kept = (~F.col("_b")) & (F.size("_f") == 0)
    verdict = F.struct("_m.*", F.col("_b").alias("base_failed"), F.col("_f").alias("failed"), kept.alias("kept"))
    # a generated column: a later filter on it must not be rewritten in terms of the arrays below, once for every mention
    return m.withColumn("quality", F.explode(F.array(verdict))).select(*C.given(names, "quality"), "quality")


def digest(docs: DataFrame) -> DataFrame:
    """The counts and verdict per document."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words", "n_marks", "n_lines")
    return quality_rules(docs.select("doc_id", "text")).select("doc_id", *(f"quality.{n}" for n in names))


def sql(table: str = "documents") -> str:
    """The same result for DuckDB."""
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    fails = " OR ".join(f"100 * {r.part} {'<' if r.least else '>'} {r.percent} * {r.whole}" for r in RULES)
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM {table}),
w AS (SELECT r, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
       list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) > 2),
k AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM g),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM k) WHERE n > 1),
c AS (SELECT r, count(DISTINCT i + o) AS n FROM d, (VALUES (0), (1), (2)) AS v(o) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
  CAST(length(t) - length(translate(t, '!?', '')) AS BIGINT) AS n_marks,
  CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS BIGINT) AS n_stop_words FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({fails}) AS kept, n_stop_words, n_marks, n_lines FROM b"""
