"""Personal data: fixed patterns, and contextual extraction bootstrapped from what they find. DataFrame functions only.

Seeds are the valid matches of the fixed patterns. The words before them are lexical patterns; a graph links patterns with
the distinct values that stand behind them anywhere in the corpus. Rounds score patterns by the share of their values that are
known as one kind, and values by the patterns that lead to them; values of confident patterns become known for the next
round, where they count for every pattern they stand behind, seeds or not. The last patterns mark further identifiers.

No match holds a line feed, and each pattern below starts only where a match of the plain form can start and never steps
back, so time is linear in the text; the plain forms are given beside.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.storage import stored

_LOCAL = r"[A-Za-z0-9._%+-]"
#: kind -> (pattern, quick test). The order of kinds is that of the output.
KINDS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": (rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: F.contains(t, F.lit("@"))),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", lambda t: F.rlike(t, F.lit(r"[0-9]\.[0-9]"))),
    # [0-9]([\x20-]?[0-9])+
    "card": (r"[0-9](?:[\x20-]?[0-9])++", lambda t: F.rlike(t, F.lit(r"[0-9](?:[\x20-]?[0-9]){12}"))),
    # as it is
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: F.contains(t, F.lit("+"))),
}
_ID = r"[A-Za-z0-9@._%+/#:-]"
#: Identifier-shaped values: a run of such characters with a digit or an at sign.
CANDIDATE = rf"(?<!{_ID}){_ID}*[0-9@]{_ID}*"
_EDGES = "._%/#:-"
#: Numbers written in groups: digits, some in parentheses, with one dot, slash, hyphen or space between. Two groups of seven
#: digits or more with a space between are two values of a list, and so is what stands before a parenthesis if it has four.
GROUPED = (r"(?<![A-Za-z0-9@._%+/-])(?<![0-9][:#])(?:\([0-9]++\)|\+?[0-9]++)(?:(?:(?:(?<=\))[ .-]?|[./-]|(?<![0-9]{7})[ ]|"
           r"[ ](?=[0-9]{1,6}(?![0-9])))[0-9]++|(?<![0-9]{4})[ .-]?\([0-9]++\))(?![._%/#:+-]*+[A-Za-z@]))++")

#: Rounds of scoring; least confidence of a pattern; least distinct known values behind it.
ROUNDS = 3
CONFIDENCE = 0.75
SUPPORT = 3
#: Characters before a value that its words are taken from.
CONTEXT_CHARS = 80

SPAN = "struct<kind: string, start: bigint, end: bigint, value: string, before: string>"
_MARK, _STAND_IN = "\u0001", "\u0002"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _small(part: Column) -> Column:
    """A digit string is at most 255."""
    short = F.regexp_replace(part, "^0+", "")
    return F.when(F.length(short) <= 3, F.coalesce(F.nullif(short, F.lit("")).cast("int"), F.lit(0)) <= 255).otherwise(False)


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, "\\."), _small),
    "card": lambda v: F.length(_digits(v)).between(13, 19) & F.call_function("luhn_check", _digits(v)),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}
#: What a value found by context must look like.
PLAUSIBLE: dict[str, Callable[[Column], Column]] = {
    "email": lambda v: F.contains(v, F.lit("@")),
    "ip": lambda v: (F.size(F.split(v, "[.:]")) >= 4) & ~F.contains(v, F.lit(" ")),
    "card": lambda v: F.length(_digits(v)) >= 8,
    "phone": lambda v: F.length(_digits(v)) >= 6,
}


def _empty() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def _found(text: Column, kind: str, pattern: str, maybe: Column, valid: Callable[[Column], Column], edges: str = "") -> Column:
    """Spans (code points, end exclusive) of the leftmost matches that do not overlap and are valid, in order.

    Each match is put between marks and the text split there, so parts are by turns what stands between matches and a match.
    A walk over the parts adds up their lengths and carries the last ``CONTEXT_CHARS`` code points, matches included.
    """
    marked = F.regexp_replace(F.translate(text, _MARK, _STAND_IN), pattern, f"{_MARK}$0{_MARK}")
    parts = F.split(marked, _MARK)

    def step(acc: Column, part: Column) -> Column:
        inner = F.regexp_replace(part, f"^[{edges}]+|[{edges}]+$", "") if edges else part
        lead = F.length(part) - F.length(F.regexp_replace(part, f"^[{edges}]+", "")) if edges else F.lit(0)
        start = acc["at"] + lead
        context = F.concat(acc["before"], F.left(part, lead)) if edges else acc["before"]
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(inner)).alias("end"),
                        inner.alias("value"), F.right(context, F.lit(CONTEXT_CHARS)).alias("before"))
        out = F.when(acc["hit"] & valid(inner), F.concat(acc["out"], F.array(span).cast(f"array<{SPAN}>"))).otherwise(acc["out"])
        before = F.right(F.concat(acc["before"], part), F.lit(CONTEXT_CHARS))
        return F.struct((acc["at"] + F.length(part)).alias("at"), (~acc["hit"]).alias("hit"), before.alias("before"), out.alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(False).alias("hit"), F.lit("").alias("before"), _empty().alias("out"))
    return F.when(maybe, F.aggregate(parts, zero, step, lambda acc: acc["out"])).otherwise(_empty())


def base_spans(text: Column | str) -> Column:
    """All valid matches of the fixed patterns, by kind, then start."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.concat(*[_found(t, k, p, maybe(t), VALID[k]) for k, (p, maybe) in KINDS.items()])


def _grouped(value: Column) -> Column:
    """Six digits or more; of more than a card has, only if no part could be a value by itself."""
    digits = F.length(_digits(value))
    return (digits >= 6) & ((digits <= 19) | ~F.rlike(value, F.lit("[^ ]{5}")))


def _apart(spans: Column, others: Column) -> Column:
    return F.filter(spans, lambda c: ~F.exists(others, lambda x: (x["start"] < c["end"]) & (c["start"] < x["end"])))


def candidates(text: Column | str, base: Column | str) -> Column:
    """Numbers in groups, and identifier-shaped values of five characters or more apart from these; none touches a base span."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    b = F.col(base) if isinstance(base, str) else base
    runs = _apart(_found(t, "", GROUPED, F.rlike(t, F.lit(r"[0-9)][ ./(-]{1,2}[0-9]")), _grouped), b)
    single = _found(t, "", CANDIDATE, F.rlike(t, F.lit("[0-9@]")), lambda v: F.length(v) >= 5, _EDGES)
    return F.concat(runs, _apart(_apart(single, b), runs))


def _valued(word: Column) -> Column:
    """A word that may be a value or a part of one, digits being 0."""
    return (F.rlike(word, F.lit("[0@]")) & (F.length(word) >= 5)) | F.rlike(word, F.lit("^[0().,;+/-]*0[0().,;+/-]*$"))


def contexts(span: Column) -> Column:
    """Lexical patterns of a span: the word before it, and the two words before it; none at the start of a text.

    A value in a list also has those before the list: words shaped like values right before it are passed over.
    """
    words = F.filter(F.split(F.regexp_replace(F.lower(span["before"]), "[0-9]", "0"), r"\s+"), lambda w: w != "")
    other = F.filter(F.transform(words, lambda w, i: F.when(~_valued(w), i + 1)), lambda i: i.isNotNull())

    def last(n: Column) -> list[Column]:
        return [F.when(n >= 1, F.concat(F.lit("1 "), F.get(words, n - 1))),
                F.when(n >= 2, F.concat(F.lit("2 "), F.get(words, n - 2), F.lit(" "), F.get(words, n - 1)))]

    every = F.array(*last(F.size(words)), *last(F.coalesce(F.array_max(other), F.lit(0))))
    return F.array_distinct(F.filter(every, lambda p: p.isNotNull()))


def _links(scanned: DataFrame, spans: str) -> DataFrame:
    """Distinct (pattern, value, kind) of a span column; combined before the shuffle."""
    each = scanned.select(F.explode(spans).alias("s"))
    return each.select("s.kind", F.lower("s.value").alias("value"), F.explode(contexts(F.col("s"))).alias("pattern")).distinct()


def confident_patterns(scanned: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """(pattern, kind, confidence) after the last round, from stored rows with ``base`` and ``candidates``.

    Copies of a text add nothing, since distinct values are counted. A pattern is confident of a kind if at least
    ``support`` distinct values behind it are known as it and their weight is at least ``confidence`` of all distinct
    values behind it, unknown and other kinds included. A value's weight is 1 for seeds, else that of its best pattern.
    """
    seeds = stored(_links(scanned, "base"), "seeds")
    # every pattern, since values that a round makes known may induce further ones
    graph = stored(seeds.select("pattern", "value").union(_links(scanned, "candidates").select("pattern", "value")).distinct(), "graph")
    values = graph.groupBy("pattern").agg(F.count("*").alias("n_values"))
    known = first = seeds.select("value", "kind").distinct().withColumn("weight", F.lit(1.0))
    for _ in range(rounds):
        scored = graph.join(known, "value").groupBy("pattern", "kind").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))
        patterns = stored(scored.join(values, "pattern").select(
            "pattern", "kind", "n", (F.col("weight") / F.col("n_values")).alias("confidence"))
            .where((F.col("n") >= support) & (F.col("confidence") >= confidence)), "patterns")
        led = graph.join(patterns, "pattern").where(_by_kind(PLAUSIBLE, F.col("kind"), F.col("value")))
        found = led.groupBy("value", "kind").agg(F.max("confidence").alias("weight")).join(first, ["value", "kind"], "left_anti")
        known = stored(first.union(found.select("value", "kind", "weight")), "known")
    best = patterns.groupBy("pattern").agg(F.max_by("kind", F.struct("confidence", "n", "kind")).alias("kind"), F.max("confidence").alias("confidence"))
    return best


def _by_kind(tests: dict[str, Callable[[Column], Column]], kind: Column, value: Column) -> Column:
    return reduce(lambda a, b: a | b, [(kind == k) & test(value) for k, test in tests.items()])


def _place(span: Column) -> Column:
    """Order of kinds, then start."""
    rank = reduce(lambda c, x: c.when(span["kind"] == x[1], x[0]), enumerate(KINDS), F.when(F.lit(False), -1))
    return F.struct(rank.alias("rank"), span["start"].alias("start"), span["end"].alias("end"), span["kind"].alias("kind"))


def annotate(docs: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """The rows with ``base`` (spans of the fixed patterns) and ``extra`` (array of places found by context).

    The scan is stored once, with a number for each row, so repeated rows and null ids stay apart. Rows without
    candidates never move; the others meet the patterns by a join on the pattern, whose hot keys adaptive execution splits.
    """
    base = docs.withColumn("base", base_spans("text"))
    scanned = stored(base.withColumn("candidates", candidates("text", "base")).withColumn("row", F.monotonically_increasing_id()), "scanned")
    patterns = confident_patterns(scanned, rounds, confidence, support)
    some = scanned.select("row", F.explode("candidates").alias("s")).select("row", "s", F.explode(contexts(F.col("s"))).alias("pattern"))
    hits = some.join(patterns, "pattern").withColumn("kind", patterns["kind"]) \
        .where(_by_kind(PLAUSIBLE, F.col("kind"), F.col("s.value")))
    # of several patterns before a value the most confident decides
    chosen = hits.groupBy("row", "s.start", "s.end").agg(F.max_by("kind", F.struct("confidence", "pattern")).alias("kind"))
    extra = chosen.groupBy("row").agg(F.sort_array(F.collect_list(_place(F.struct("kind", "start", "end")))).alias("extra"))
    joined = scanned.where(F.size("candidates") > 0).join(extra, "row", "left")
    none = extra.schema["extra"].dataType
    moved = joined.withColumn("extra", F.coalesce("extra", F.array().cast(none)))
    still = scanned.where(F.size("candidates") == 0).withColumn("extra", F.array().cast(none))
    return still.unionByName(moved).drop("candidates", "row")


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda x: x == kind


def _written(places: Column) -> Column:
    return F.array_join(F.transform(places, lambda p: F.concat_ws(":", p["kind"], p["start"].cast("string"), p["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row.

    A null text counts as empty: no spans. Repeated rows each get a row; an empty table gives no rows; other columns are
    left out.
    """
    rows = annotate(docs.select("doc_id", "text")).drop("text")
    base = F.transform("base", _place)
    counts = [F.size(F.filter("base.kind", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    every = F.sort_array(F.concat(base, F.col("extra")))
    return rows.select("doc_id", *counts, F.sha2(_written(base), 256).alias("base_sha256"), _written(every).alias("spans"))


def mask(docs: DataFrame) -> DataFrame:
    """The rows with all their columns, spans in ``text`` replaced by their kind in angle brackets (n_chars follows).

    Spans that overlap are replaced together under the first one's kind. Null texts stay null.
    """
    columns = docs.columns
    # names of the annotation must not meet the table's own columns
    rows = annotate(docs.select("text", F.struct(*columns).alias("own")))
    spans = F.sort_array(F.transform(F.concat(F.transform("base", _place), "extra"), lambda p: F.struct(p["start"], p["end"], p["kind"])))
    rows = rows.withColumn("spans", spans)

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], before, F.lit("<"), s["kind"], F.lit(">"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    masked = F.aggregate("spans", zero, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text"))))
    rows = rows.withColumn("masked", F.when(F.size("spans") > 0, masked).otherwise(F.col("text")))
    new = {"text": F.col("masked"), "n_chars": F.length("masked").cast("long")}
    return rows.select(*[new[c].alias(c) if c in new else F.col(f"own.`{c}`").alias(c) for c in columns])
