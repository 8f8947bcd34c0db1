"""Operator 9: secret scans through a trigram inverted index."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.urls import lower_ascii


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of pattern whose group is least characters long, or longer."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The three base kinds in their order.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
# Further kinds that the method adds.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),  # no repeated group: Java's matcher recurses on those
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
)


class _Pattern:
    """Reads a pattern of literals, classes, groups, alternatives and repeats: a list of alternatives, each a list of (atom, least, most).

    An atom is a character, None for a class of them, or a list of alternatives again.  Anything else, such as anchors,
    look-around or back references, is refused.
    """

    def __init__(self, text: str):
        self.text, self.at = text, 0
        self.parts = self.alternatives()
        if self.at < len(text):
            raise ValueError(f"unbalanced ) in {text}")

    def peek(self, *marks: str) -> str | None:
        return next((m for m in marks if self.text.startswith(m, self.at)), None)

    def take(self, *marks: str) -> str | None:
        found = self.peek(*marks)
        self.at += len(found or "")
        return found

    def alternatives(self) -> list:
        out = [self.sequence()]
        while self.take("|"):
            out.append(self.sequence())
        return out

    def sequence(self) -> list:
        out = []
        while self.at < len(self.text) and not self.peek("|", ")"):
            atom = self.atom()
            out.append((atom, *self.repeat()))
        return out

    def atom(self):
        if self.take("(?:", "(?i:", "("):
            if self.peek("?", "*"):
                raise ValueError(f"unknown group in {self.text}")
            inner = self.alternatives()
            if not self.take(")"):
                raise ValueError(f"unbalanced ( in {self.text}")
            return inner
        if self.take("["):
            self.take("^")
            first = True
            while first or not self.peek("]"):
                first = False
                self.escape() if self.peek("\\") else self.character()
            self.at += 1
            return None
        if self.take("."):
            return None
        if self.peek("\\"):
            return self.escape()
        if self.peek("^", "$", "?", "*", "+", "{"):
            raise ValueError(f"{self.text[self.at]} without meaning in {self.text}")
        return self.character()

    def character(self) -> str:
        if self.at >= len(self.text):
            raise ValueError(f"unbalanced [ in {self.text}")
        self.at += 1
        return self.text[self.at - 1]

    def escape(self) -> str | None:
        """A character written with a backslash, or None for a class such as \\d."""
        self.at += 1
        c = self.character()
        if c == "x":
            self.at += 2
            return chr(int(self.text[self.at - 2 : self.at], 16))
        if c in "dDwWsS":
            return None
        if c.isalnum():
            raise ValueError(f"unknown escape {c} in {self.text}")
        return c

    def repeat(self) -> tuple[int, int | None]:
        mark = self.take("?", "*", "+", "{")
        if mark == "{":
            end = self.text.index("}", self.at)
            low, _, high = self.text[self.at : end].partition(",")
            bounds = int(low), (int(high) if high else None if "," in self.text[self.at : end] else int(low))
            self.at = end + 1
        else:
            bounds = {None: (1, 1), "?": (0, 1), "*": (0, None), "+": (1, None)}[mark]
        if mark:
            self.take("?", "+")
        return bounds


def trigram_query(pattern: str, most: int = 64) -> list[list[str]] | None:
    """Alternatives of lower-case trigrams: a match holds all trigrams of one alternative.

    None if some alternative has no mandatory trigram, so that every text must be scanned.
    """

    def closed(paths):
        return [(done | ({run} if len(run) >= 3 else frozenset()), "") for done, run in paths]

    def once(atom, paths):
        if atom is None:
            return closed(paths)
        if isinstance(atom, str):
            return [(done, run + atom.lower()) for done, run in paths]
        return [p for branch in atom for p in walk(branch, paths)]

    def walk(items, paths):
        for atom, low, high in items:
            if (low, high) == (1, 1):
                paths = once(atom, paths)
            elif (low, high) == (0, 1):
                paths = paths + once(atom, paths)
            elif low >= 1:
                paths = closed(once(atom, closed(paths)))
            else:
                paths = closed(paths)
            paths = list(dict.fromkeys(paths))
            if len(paths) > most:
                paths = [(frozenset(), "")]
        return paths

    out = []
    for runs, _ in closed(once(_Pattern(pattern).parts, [(frozenset(), "")])):
        grams = sorted({run[i : i + 3] for run in runs for i in range(len(run) - 2)})
        if not grams:
            return None
        out.append(grams)
    return out


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(numbers: Column, block: int = 512) -> Column:
    """Running sums of an array of long of one element or more: inside blocks, then over the blocks' sums.

    An array grows by copying, so one fold over many elements would copy with the square of their number.
    """

    def scan(some: Column) -> Column:
        none = F.array().cast("array<bigint>")
        return F.aggregate(some, none, lambda acc, x: F.concat(acc, F.array(x + F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0).cast("long")))))

    def joined(parts: Column) -> Column:
        before = scan(F.transform(parts, lambda p: F.element_at(p, -1)))
        return F.flatten(F.zip_with(parts, before, lambda p, b: F.transform(p, lambda x: x + b - F.element_at(p, -1))))

    places = F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / block).cast("int"))
    return _with(F.transform(places, lambda k: scan(F.slice(numbers, k * block + 1, block))), joined)


def _spans(text: Column, rule: Rule) -> Column:
    """array<struct<start,end>> of the matches that are long enough, in code points, end exclusive.

    Gaps between matches come from split, so that positions are running sums of lengths.
    """
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    value = whole if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    each = F.zip_with(
        F.zip_with(gaps, whole, lambda g, m: F.struct(F.length(g).cast("long").alias("g"), F.coalesce(F.length(m), F.lit(0)).cast("long").alias("m"))),
        value,
        lambda gm, v: F.struct(gm["g"].alias("g"), gm["m"].alias("m"), F.coalesce(F.length(v) >= rule.least, F.lit(False)).alias("ok")),
    )

    def placed(found: Column) -> Column:
        ends = _running(F.transform(found, lambda x: x["g"] + x["m"]))
        spans = F.zip_with(found, ends, lambda x, end: F.struct((end - x["m"]).alias("start"), end.alias("end"), x["ok"].alias("ok")))
        return F.transform(F.filter(spans, lambda s: s["ok"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    return F.when(F.coalesce(text.rlike(rule.pattern), F.lit(False)), _with(each, placed)).otherwise(none)


def postings(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(gram, key): the inverted index of docs for the trigrams that the rules ask for."""
    grams = sorted({g for r in rules for alt in trigram_query(r.pattern) or [] for g in alt})
    lowered = docs.select(F.col("doc_id").alias("key"), lower_ascii(F.col("text")).alias("low")).where("low is not null")
    found = F.filter(F.array(*[F.lit(g) for g in grams]).cast("array<string>"), lambda g: F.contains(F.col("low"), g))
    return lowered.select("key", F.explode(found).alias("gram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...], most_broadcast: int = 100_000) -> DataFrame:
    """(key, kinds): documents whose postings satisfy the Boolean query of a rule.

    The query has a row for each trigram of an alternative; beyond most_broadcast rows it is shuffled.
    """
    spark = docs.sparkSession
    asked = []
    for r in rules:
        for k, alt in enumerate(trigram_query(r.pattern) or []):
            if len(alt) > 62:
                alt = alt[:62]  # a weaker condition; matches are verified in any case
            asked += [(g, r.kind, k, 1 << i, (1 << len(alt)) - 1) for i, g in enumerate(alt)]
    query = spark.createDataFrame(asked, "gram string, kind string, alt int, bit long, whole long")
    if len(asked) <= most_broadcast:
        query = F.broadcast(query)
    return (
        postings(docs, rules)
        .join(query, "gram")
        .groupBy("key", "kind", "alt", "whole")
        .agg(F.bit_or("bit").alias("has"))
        .where("has = whole")
        .groupBy("key")
        .agg(F.collect_set("kind").alias("kinds"))
    )


def scan_secrets(docs: DataFrame, base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """One row per document: doc_id, n_<kind> of each base rule, base_sha256, spans.

    spans holds kind:start:end of all matches, comma-joined by start, then in the order of the rules;
    base_sha256 is the digest of that list for the base rules alone.  Null texts count as empty and
    have no spans.  Rows that repeat a doc_id are scanned each for itself (a text is scanned if any row
    of its doc_id is a candidate); null doc_ids keep their rows; an empty table gives an empty result;
    other columns are ignored.

    Patterns must mean the same in Python and Java and use no look-around, back references or anchors.
    Rules with mandatory trigrams are evaluated only where the index has a candidate, others everywhere.
    """
    rules = base + more
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    indexed = tuple(r for r in rules if trigram_query(r.pattern) is not None)
    met = texts.join(candidates(texts, indexed), F.col("doc_id").eqNullSafe(F.col("key")), "left") if indexed else texts.withColumn("kinds", F.array().cast("array<string>"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    for r in rules:
        spans = _spans(F.col("text"), r)
        if r in indexed:
            spans = F.when(F.coalesce(F.array_contains("kinds", r.kind), F.lit(False)), spans).otherwise(none)
        met = met.withColumn(f"s_{r.kind}", spans)
    met = met.drop("text", "kinds", "key")

    def tagged(place, kind):
        return F.transform(F.col(f"s_{kind}"), lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("o"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    def listed(some):
        return F.array_join(F.transform(F.array_sort(F.concat(*[tagged(i, r.kind) for i, r in enumerate(some)])), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    counts = [F.size(f"s_{r.kind}").cast("long").alias(f"n_{r.kind}") for r in base]
    return met.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(rules).alias("spans"))
