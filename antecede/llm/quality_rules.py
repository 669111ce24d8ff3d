"""Quality rules as a short-circuit cascade, ordered by rejections per unit of cost.

Measures and rules are column expressions. The order of the rules is estimated on a sample: the characters that a rule reads
of a row are its cost (the whole text for each time it names it, one for a measure), and the share it rejects is the selectivity.
Unlike run times, which at this size are mostly those of starting a job, both come out alike in every run. The
cascade then is one CASE expression, in which a row leaves at the first rule that rejects it. The
verdict is the same in any order; only the work differs.

Defined results: a null or empty text has no words and fails the base rule; rows are judged one by
one, so repeats and ties need no rule; extra columns pass through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from antecede.llm.common import BREAK_PATTERN, stored

SAMPLE_ROWS = 2000  # expected rows of the sample that orders the rules; it changes no verdict
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A named SQL condition over the text and its measures that rejects a document."""

    name: str
    rejects: str


BASE = Rule("base", f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")
RULES = (
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 30 * length(regexp_replace(text, '[^\\\\n]+', '')) + 30"),
    Rule("upper_case", "2 * length(regexp_replace(text, '[^\\\\p{Lu}]+', '')) > length(regexp_replace(text, '[^\\\\p{L}]+', ''))"),
    Rule("letters", "10 * length(regexp_replace(text, '[^\\\\p{L}]+', '')) < 6 * word_chars"),
)


def _repeated(words: Column) -> Column:
    """Words that lie in a three-word window found at least twice."""
    windows = F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))),
                      1, F.greatest(F.size(words) - 2, F.lit(0)))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.element_at(F.transform(F.array(ordered), lambda o: _width(F.array_sort(F.transform(F.filter(
            o, lambda e, i: F.coalesce(e["h"] == F.get(o, i - 1)["h"], F.lit(False))
            | F.coalesce(e["h"] == F.get(o, i + 1)["h"], F.lit(False))), lambda e: e["i"])))), 1)

    def _width(at: Column) -> Column:
        """Positions covered by three-word windows that start at the ordered positions ``at``."""
        return F.aggregate(at, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
                           lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"),
                                                   p.alias("last")))["n"]

    return F.element_at(F.transform(F.array(windows), lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h))), 1)


def measured(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the whole text."""
    text = F.coalesce("text", F.lit(""))
    split = docs.withColumns({
        "_words": F.filter(F.split(text, BREAK_PATTERN), lambda w: w != ""),
        "_lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    })
    return split.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": _repeated(F.col("_words")),
    }).drop("_words", "_lines")


def ordered_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, characters read of a row, rejected share), most rejections per character first."""
    total = docs.count()
    if total == 0:
        return [(r, 0.0, 0.0) for r in rules]
    sample = stored(measured(docs.select("text").sample(min(1.0, rows / total), seed=7)), "rule_sample")
    rejected = [F.count_if(F.expr(r.rejects)).alias(f"r{i}") for i, r in enumerate(rules)]
    row = sample.agg(F.count("*").alias("n"), F.avg(F.coalesce(F.length("text"), F.lit(0))).alias("size"), *rejected).first()
    found = []
    for i, rule in enumerate(rules):
        named = re.findall(r"[a-z_]+", re.sub(r"'[^']*'", "", rule.rejects))
        cost = sum((row.size or 0.0) if name == "text" else 1.0 for name in named if name in ("text", *MEASURES))
        found.append((rule, max(cost, 1.0), row[f"r{i}"] / max(row.n, 1)))
    return sorted(found, key=lambda f: (-f[2] / max(f[1], 1e-9), f[0].name))


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Add the measures, base_failed, kept, and the rule that rejected the document first."""
    order = [BASE, *(r for r, _, _ in ordered_rules(docs, rules, rows))]
    verdict = F.when(F.expr(order[0].rejects), F.lit(order[0].name))
    for rule in order[1:]:
        verdict = verdict.when(F.expr(rule.rejects), F.lit(rule.name))
    return measured(docs).withColumns({
        "base_failed": F.expr(BASE.rejects), "rejected_by": verdict,
    }).withColumn("kept", F.col("rejected_by").isNull())
