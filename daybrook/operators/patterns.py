"""Many patterns against many texts: automata over bounded parts of the pattern table.

Patterns are sorted and cut into parts of bounded size by prefix sums of their lengths, so a part
holds patterns with near first characters.  Each part travels to the tasks as one broadcast of that
bound and is searched with an automaton that reads every text once, whatever the number of patterns.
A regular expression is first reduced to text that every match must hold, of several such texts to the one
that the fewest expressions share; only texts in which it was found run the expression.
"""

from __future__ import annotations

import functools
import re
import warnings
from collections.abc import Iterator
from re import _constants as C
from re import _parser

import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, rows_within, spread
from . import numbering

#: Characters of a part; an automaton takes some forty bytes for each.
PART_CHARS = 2_000_000
#: Expressions, and texts of a search among many patterns, that one task reads.
RULES_A_SPLIT, TEXTS_A_SPLIT = 10_000, 2_000
#: First characters by which patterns are sought in the texts before any automaton, and by which places to look at are told.
HEAD_CHARS, START_CHARS, MOST_STARTS = 8, 3, 50_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class _Part:
    """A broadcast part, equal by its name so that a worker builds its automaton once."""

    def __init__(self, shared: Broadcast, name: str):
        self.shared, self.name = shared, name

    def __eq__(self, other) -> bool:
        return self.name == other.name

    def __hash__(self) -> int:
        return hash(self.name)


@functools.lru_cache(maxsize=1)
def _automaton(part: _Part):
    import ahocorasick
    tree = ahocorasick.Automaton()
    for pattern in part.shared.value:
        tree.add_word(pattern, pattern)
    tree.make_automaton()
    return tree


def _scanner(part: _Part, key: str, text: str, kind: pa.DataType):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = _automaton(part)
        for batch in batches:
            keys, found = [], []
            for one, value in zip(batch.column(key).to_pylist(), batch.column(text).to_pylist(), strict=True):
                if value is None:
                    continue
                hits = {pattern for _, pattern in tree.iter(value)}
                keys += [one] * len(hits)
                found += hits
                if len(keys) > 65_536:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(found, pa.string())], names=[key, "pattern"])
                    keys, found = [], []
            yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(found, pa.string())], names=[key, "pattern"])
    return scan


def _heads(text: str, starts: dict[int, frozenset[str]] | None, sizes: list[int]):
    """Distinct windows of the texts that can be the first characters of a pattern."""
    def windows(value: str) -> Iterator[str]:
        if starts is None:
            for size in sizes:
                yield from (value[i:i + size] for i in range(len(value) - size + 1))
            return
        for chars, known in starts.items():
            at = [i for i in range(len(value) - chars + 1) if value[i:i + chars] in known]
            for size in sizes:
                if size == chars or size > chars == START_CHARS:
                    yield from (value[i:i + size] for i in at if i + size <= len(value))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            for value in batch.column(text).to_pylist():
                seen.update(windows(value or ""))
                if len(seen) > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], names=["head"])
                    seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], names=["head"])
    return scan


def occurring(texts: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """The patterns of ``known(pattern)``, none of them empty, whose first characters are somewhere in the texts.

    Texts are read once, whatever the number of patterns: their windows meet the first characters of all
    patterns in one join.  Where patterns begin in few ways, only places that begin so are looked at.
    """
    start = F.substring("pattern", 1, START_CHARS)
    found = rows_within(known.select(start.alias("start")).distinct(), MOST_STARTS)
    starts = None
    if found is not None:
        starts = {n: frozenset(row["start"] for row in found if len(row["start"]) == n) for n in range(1, START_CHARS + 1)}
        starts = {n: some for n, some in starts.items() if some}
    headed = known.withColumn("head", F.substring("pattern", 1, HEAD_CHARS))
    # one row a length
    sizes = sorted(row["n"] for row in headed.select(F.length("head").alias("n")).distinct().collect())
    heads = texts.select(text).mapInArrow(_heads(text, starts, sizes), "head string").distinct()
    return headed.join(heads, "head", "left_semi").select("pattern")


def contains_join(texts: DataFrame, patterns: DataFrame, *, key: str, text: str = "text", part_chars: int | None = None) -> DataFrame:
    """``(key, pattern)`` for every text of ``texts(key, text)`` and each pattern of ``patterns(pattern)`` that it contains.

    Repeated patterns count once.  The empty pattern is in every text; null texts and patterns match nothing.
    Of a table with more than one part, only patterns whose first characters occur are kept.  A text is read
    once for each part of those.
    """
    spark, part_chars = texts.sparkSession, part_chars or PART_CHARS
    kind = pa.int64() if dict(texts.dtypes)[key] in ("bigint", "int") else pa.string()
    texts = texts.select(F.col(key).cast("long" if kind == pa.int64() else "string").alias(key), F.col(text).alias(text))
    known = materialize(patterns.select("pattern").where("pattern is not null").distinct(), "known-patterns")
    filled = known.where("pattern <> ''")
    if (filled.agg(F.sum(F.length("pattern") + 1)).first()[0] or 0) > part_chars:
        texts = materialize(texts, "searched")
        texts = spread(texts, TEXTS_A_SPLIT)
        filled = occurring(texts, filled, text)
    sized = numbering.before(filled, [F.col("pattern")], {"chars": F.length("pattern") + 1})
    parts = materialize(sized.select("pattern", F.floor(F.col("chars") / part_chars).cast("int").alias("part")), "patterns")
    out = texts.where(F.lit(not known.where("pattern = ''").isEmpty()) & F.col(text).isNotNull()).select(key, F.lit("").alias("pattern"))
    # one row a part
    for row in parts.select("part").distinct().orderBy("part").collect():
        own = [r["pattern"] for r in parts.where(F.col("part") == row["part"]).collect()]
        part = _Part(spark.sparkContext.broadcast(own), f"{parts.inputFiles()[0]} {row['part']}")
        out = out.unionByName(texts.mapInArrow(_scanner(part, key, text, kind), f"{key} {'long' if kind == pa.int64() else 'string'}, pattern string"))
    return out


# --- regular expressions ---------------------------------------------------------------

def _best(options: list[list[str]]) -> list[str]:
    return max(options, key=lambda texts: min(map(len, texts)), default=[])


def _needs(sequence) -> list[str]:
    """Texts of which every match of a parsed expression holds at least one; empty if there are none."""
    options, run = [], ""
    for kind, value in [*sequence, (None, None)]:
        if kind is C.LITERAL:
            run += chr(value)
            continue
        if run:
            options.append([run])
            run = ""
        if kind is C.SUBPATTERN:
            inner = _needs(value[3])
        elif kind in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            inner = _needs(value[2]) if value[0] else []
        elif kind is C.ATOMIC_GROUP:
            inner = _needs(value)
        elif kind is C.BRANCH:
            sides = [_needs(side) for side in value[1]]
            inner = [text for side in sides for text in side] if all(sides) else []
        else:
            inner = []
        if inner:
            options.append(inner)
    return _best(options)


def required_texts(pattern: str) -> list[str] | None:
    """Texts of which every match holds one, ASCII letters in lower case; ``[""]`` if nothing is certain, null for a bad pattern."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            re.compile(pattern)
            found = _needs(_parser.parse(pattern))
    except (re.error, RecursionError, OverflowError):
        return None
    return sorted({text.translate(str.maketrans(_UPPER, _LOWER)) for text in found}) or [""]


def java_regex(pattern: str) -> str:
    """Python's names of groups in Java's form."""
    return re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern.replace("(?P<", "(?<"))


def _parsed(pattern: str | None, known: bool = False):
    """A pattern's parse tree, null for an empty or bad one; a known one compiles."""
    if not pattern:
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            if not known:
                re.compile(pattern)
            return _parser.parse(pattern)
    except (re.error, RecursionError, OverflowError):
        return None


def _low(text: str) -> str:
    return text.translate(str.maketrans(_UPPER, _LOWER))


def _choices(sequence) -> list:
    """What every match holds, as a list of choices of which each one will do.

    A choice is a text, or a list with the choices of each side of a branch, one of which is met.
    """
    found, run = [], ""
    for kind, value in [*sequence, (None, None)]:
        if kind is C.LITERAL:
            run += chr(value)
            continue
        if run:
            found.append(_low(run))
            run = ""
        if kind is C.SUBPATTERN:
            found += _choices(value[3])
        elif kind in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            found += _choices(value[2]) if value[0] else []
        elif kind is C.ATOMIC_GROUP:
            found += _choices(value)
        elif kind is C.BRANCH:
            sides = [_choices(side) for side in value[1]]
            if all(sides):
                found.append(sides)
    return found


def _texts(choices: list) -> set[str]:
    return {text for choice in choices for text in ([choice] if isinstance(choice, str) else set().union(*map(_texts, choice)))}


def _rarest(choices: list, shared: dict[str, int]) -> tuple[int, int, set[str]]:
    """``(rules, length, texts)`` of the choice whose texts the fewest rules share, the longest of these; the length is negative."""
    def weigh(choice) -> tuple[int, int, set[str]]:
        if isinstance(choice, str):
            return shared[choice], -len(choice), {choice}
        sides = [_rarest(side, shared) for side in choice]
        return sum(side[0] for side in sides), max(side[1] for side in sides), set().union(*(side[2] for side in sides))
    return min(map(weigh, choices), key=lambda weighed: weighed[:2])


def _said(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All texts that a rule could be looked up by, as one list a rule; bad patterns leave."""
    for frame in frames:
        rows = [(rule, pattern, sorted(_texts(_choices(tree)))) for rule, pattern in zip(frame["rule"], frame["pattern"], strict=True) if (tree := _parsed(pattern)) is not None]
        yield pd.DataFrame(rows, columns=["rule", "source", "texts"])


def _split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for rule, pattern, texts, counts in zip(frame["rule"], frame["source"], frame["texts"], frame["counts"], strict=True):
            choices = _choices(_parsed(pattern, known=True))
            chosen = _rarest(choices, dict(zip(texts, map(int, counts), strict=True)))[2] if choices else {""}
            rows += [(rule, "(?i)" + java_regex(pattern), text) for text in sorted(chosen)]
        yield pd.DataFrame(rows, columns=["rule", "regex", "pattern"])


def looked_up(rules: DataFrame) -> DataFrame:
    """``rule, regex, pattern`` of ``rules(rule, pattern)``: texts of which every match of the rule holds one.

    Of the texts that a match must hold, those are taken that the fewest rules share: a word that all rules
    have in common would pair every text that holds it with every rule.
    """
    named = spread(materialize(rules.select(F.col("rule").cast("string").alias("rule"), "pattern").distinct(), "rules"), RULES_A_SPLIT)
    said = materialize(named.mapInPandas(_said, "rule string, source string, texts array<string>"), "rule-texts")
    each = said.select("rule", "source", F.explode("texts").alias("text"))
    counted = each.join(each.groupBy("text").agg(F.count("*").alias("n")), "text").groupBy("rule", "source").agg(F.collect_list(F.struct("text", "n")).alias("t"))
    plain = said.where(F.size("texts") == 0).select("rule", "source", "texts", F.array().cast("array<bigint>").alias("counts"))
    counted = materialize(counted.select("rule", "source", F.col("t.text").alias("texts"), F.col("t.n").alias("counts")).unionByName(plain), "rule-counts")
    return spread(counted, RULES_A_SPLIT).mapInPandas(_split, "rule string, regex string, pattern string")


def regex_join(texts: DataFrame, rules: DataFrame, *, key: str, text: str = "text") -> DataFrame:
    """``(key, rule)`` for every text in which an expression of ``rules(rule, pattern)`` is found, letters of ASCII in any case.

    Patterns that do not compile, and empty ones, match nothing.  A pattern without certain text is tried on every text.
    """
    split = materialize(looked_up(rules), "regexes")
    folded = texts.select(key, F.translate(F.col(text), _UPPER, _LOWER).alias(text))
    near = contains_join(folded, split.select("pattern"), key=key, text=text)
    tried = near.join(split, "pattern").select(key, "rule", "regex").distinct()
    # texts are as many as they are: a broadcast of them would pass the driver
    joined = tried.join(texts.select(key, F.col(text).alias("_text")).hint("merge"), key)
    return joined.where(F.regexp_like("_text", F.col("regex"))).select(key, "rule")
