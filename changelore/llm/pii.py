"""Personal data by weak supervision: labelers vote on spans, their reliabilities are estimated, a classifier decides.

Base spans (email, ip, card, phone) follow fixed patterns and always stay.  Further candidates (access
keys, credentials, national ids, names, loose numbers) get votes from regex, gazetteer and context
labelers.  Expectation-maximisation over the counts of vote patterns estimates how often each labeler is
right and gives every pattern a soft label; a logistic span classifier is trained on those labels and on
the shape of the span, and accepts or refuses each pattern.

Everything is built-in columns.  Texts are worked on inside their row; only pattern counts are shuffled.
There are at most 3^6 vote patterns times 2^3 shapes, whatever the corpus holds, so the fit works on one
row of arrays and its verdict (the accepted patterns) is a literal list of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelore.llm.common import settled

BASE_KINDS = ["email", "ip", "card", "phone"]
ADDED_KINDS = ["key", "secret", "national_id", "name", "number"]

# The four base patterns.  Quantifiers are possessive and starts are limited to the first
# sign of a run, which finds the same matches without quadratic retries or deep recursion on long runs.
BASE_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A sign without which a pattern cannot match; spares most texts the regex.
GUARDS = {"email": "@", "phone": "+"}

CREDENTIAL_WORDS = ["api_key", "apikey", "auth", "passwd", "password", "pwd", "secret", "token"]
TITLES = ["Dr", "Frau", "Herr", "Madame", "Monsieur", "Mr", "Mrs", "Ms", "Señor", "Señora"]
GIVEN_NAMES = [
    "Ahmed", "Alice", "Ana", "Anna", "Anne", "Carlos", "Carmen", "Chen", "David", "Elena", "Emma", "Fatima",
    "Hans", "James", "Jean", "John", "José", "Juan", "Julia", "Karl", "Laura", "Luis", "Maria", "Marie",
    "Mary", "Michael", "Mohammed", "Paul", "Peter", "Pierre", "Robert", "Sarah", "Sofia", "Thomas", "Wei",
]
PRIVATE_CUES = [
    "account", "born", "call", "contact", "credential", "customer", "key", "login", "mobile", "name",
    "passport", "phone", "social security", "ssn", "tel",
]
PUBLIC_CUES = ["chapter", "figure", "isbn", "license", "page", "release", "section", "table", "version"]

_KEY = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])"
_SECRET = (
    r"(?i:\b(?:" + "|".join(CREDENTIAL_WORDS) + r"))[\x20]{0,2}[=:][\x20]{0,2}"
    r"(?:\"[A-Za-z0-9+/_.=-]{6,}+\"|[A-Za-z0-9+/_.=-]{6,}+)"
)
_NATIONAL_ID = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_NAME = r"\b(?:" + "|".join(TITLES) + r")\.?[\x20]\p{Lu}\p{Ll}{1,30}(?:[\x20]\p{Lu}\p{Ll}{1,30})?"
_NUMBER = r"(?<![0-9.])[0-9]{1,6}(?:[\x20./-][0-9]{1,6}){1,5}(?![0-9])"
SHAPES = {"key": _KEY, "secret": _SECRET, "national_id": _NATIONAL_ID, "name": _NAME, "number": _NUMBER}
CANDIDATE = "|".join(f"(?:{p})" for p in SHAPES.values())

BLOCK = 64
CONTEXT = 24
EM_ROUNDS = 30
FIT_ROUNDS = 300
ACCEPT = 0.5


def _sum(values: Column, zero: Column) -> Column:
    return F.aggregate(values, zero, lambda a, b: a + b)


def located(df: DataFrame, pattern: str, name: str, guard: str | None = None) -> DataFrame:
    """Add `name`: all leftmost non-overlapping matches of `_text` as (start, end, match), in code points.

    Matches and the text between them give the offsets; running sums go by blocks of 64, so a text
    with very many matches stays cheap.
    """
    found, pieces, steps, heads = f"_{name}_m", f"_{name}_p", f"_{name}_s", f"_{name}_h"
    zero = F.lit(0)
    matches = F.regexp_extract_all(F.col("_text"), F.lit(pattern), zero)
    if guard:
        matches = F.when(F.contains(F.col("_text"), F.lit(guard)), matches)
    n = F.size(found)
    some = F.coalesce(n, zero) > 0
    block = lambda i: F.floor(i / F.lit(BLOCK)).cast("int")
    step = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.char_length(F.get(F.col(pieces), i)) + F.char_length(F.get(F.col(found), i)),
    )
    sums = F.transform(
        F.sequence(F.lit(0), block(n - 1)),
        lambda b: _sum(F.slice(F.col(steps), b * BLOCK + 1, F.lit(BLOCK)), zero),
    )
    running = F.aggregate(sums, F.array(zero), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def span(i: Column) -> Column:
        before = F.get(F.col(heads), block(i)) + _sum(
            F.slice(F.col(steps), block(i) * BLOCK + 1, i % BLOCK), zero
        )
        start = before + F.char_length(F.get(F.col(pieces), i))
        match = F.get(F.col(found), i)
        return F.struct(
            start.alias("start"), (start + F.char_length(match)).alias("end"), match.alias("match")
        )

    empty = F.expr("array()").cast("array<struct<start:int,end:int,match:string>>")
    return (
        df.withColumn(found, matches)
        .withColumn(pieces, F.when(some, F.split("_text", pattern, -1)))
        .withColumn(steps, F.when(some, step))
        .withColumn(heads, F.when(some, running))
        .withColumn(
            name,
            F.when(some, F.transform(F.sequence(F.lit(0), n - 1), span)).otherwise(empty),
        )
        .drop(found, pieces, steps, heads)
    )


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)
    value = lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int")
    term = lambda i: F.when(i % 2 == 1, value(i)).otherwise(
        2 * value(i) - F.when(value(i) > 4, 9).otherwise(0)
    )
    return _sum(F.transform(F.sequence(F.lit(1), n), term), F.lit(0)) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = _digits(match)
    if kind == "ip":
        value = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(
            F.split(match, r"\."),
            lambda p: (F.char_length(value(p)) <= 3)
            & (F.coalesce(value(p).try_cast("int"), F.lit(999)) <= 255),
        )
    if kind == "card":
        return F.when(F.char_length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.char_length(digits).between(9, 15)
    return F.lit(True)


def with_base(df: DataFrame) -> DataFrame:
    """Add one array of (start, end, match) per base kind, of the matches that pass their check."""
    for kind in BASE_KINDS:
        df = located(df, BASE_PATTERNS[kind], f"_{kind}", GUARDS.get(kind))
        df = df.withColumn(f"_{kind}", F.filter(f"_{kind}", _checker(kind)))
    return df


def _checker(kind: str):
    return lambda s: _valid(kind, s["match"])


def _named(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def _votes(match: Column, before: Column) -> dict[str, Column]:
    """The labelers: 1 for private, -1 for public, 0 for no opinion."""
    lower, cue = F.lower(match), F.lower(before)
    any_of = lambda words: "|".join(words)
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    never = F.lit(False)
    n_digits = F.char_length(_digits(match))
    return {
        "shape": vote(
            match.rlike(f"^(?:{_KEY}|{_SECRET}|{_NATIONAL_ID})$"), match.rlike(r"^[0-9]{1,3}[./][0-9]{1,3}$")
        ),
        # only the first sign of a run starts a match, so a very long run is read once
        "random": vote(
            match.rlike(r"(?<![A-Za-z0-9])(?=[A-Za-z0-9]*[0-9][A-Za-z]|[A-Za-z0-9]*[A-Za-z][0-9])[A-Za-z0-9]{12,}+"), never
        ),
        "gazetteer": vote(
            lower.rlike(rf"\b(?:{any_of(CREDENTIAL_WORDS)})\b") | match.rlike(rf"\b(?:{any_of(GIVEN_NAMES)})\b"), never
        ),
        "title": vote(match.rlike(rf"^(?:{any_of(TITLES)})\b"), never),
        "context": vote(cue.rlike(rf"\b(?:{any_of(PRIVATE_CUES)})"), cue.rlike(rf"\b(?:{any_of(PUBLIC_CUES)})")),
        "length": vote((n_digits >= 9) & match.rlike("^[0-9]"), match.rlike("^[0-9]") & (n_digits < 7)),
    }


LABELERS = ["shape", "random", "gazetteer", "title", "context", "length"]


def with_candidates(df: DataFrame) -> DataFrame:
    """Add `_more`: candidates that overlap no base span, as (kind, start, end, pattern).

    The pattern is one digit per labeler (0 public, 1 none, 2 private), then three of the span's shape:
    holds letters, holds digits, longer than 15.
    """
    def free(b: Column) -> Column:
        block = F.slice(F.col("_cand"), b * BLOCK + 1, F.lit(BLOCK))
        low, high = F.element_at(block, 1)["start"], F.element_at(block, -1)["end"]
        near = F.filter("_base", lambda s: (s["start"] < high) & (low < s["end"]))
        return F.get(
            F.transform(
                F.array(near),  # binds the block's base spans once
                lambda near: F.filter(
                    block, lambda c: ~F.exists(near, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))
                ),
            ),
            0,
        )

    blocks = F.sequence(F.lit(0), F.floor((F.size("_cand") - 1) / F.lit(BLOCK)).cast("int"))
    def judged(c: Column) -> Column:
        match, start = c["match"], c["start"]
        before = F.substring(
            F.col("_text"), F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT))
        )
        votes = _votes(match, before)
        shape = [match.rlike("[A-Za-z]"), match.rlike("[0-9]"), F.char_length(match) > 15]
        pattern = F.concat(
            *[(votes[name] + 1).cast("string") for name in LABELERS], *[s.cast("int").cast("string") for s in shape]
        )
        kind = F.when(match.rlike(f"^(?:{_KEY})$"), "key")
        for name in ADDED_KINDS[1:]:
            kind = kind.when(match.rlike(f"^(?:{SHAPES[name]})$"), name)
        return F.struct(
            kind.otherwise("number").alias("kind"), start.alias("start"), c["end"].alias("end"), pattern.alias("pattern")
        )

    return (
        located(df, CANDIDATE, "_cand")
        .withColumn("_base", F.concat(*[F.col(f"_{k}") for k in BASE_KINDS]))
        .withColumn(
            "_free", F.when(F.size("_cand") > 0, F.flatten(F.transform(blocks, free))).otherwise(F.col("_cand"))
        )
        .withColumn("_more", F.transform("_free", judged))
        .drop("_cand", "_free", "_base")
    )


def fit(candidates: DataFrame) -> DataFrame:
    """Reliabilities and verdicts from candidate `pattern`s: one row (reliability, prior, weights, scored).

    `scored` lists every pattern with its soft label and the classifier's probability.  No candidates
    give no row.
    """
    m = len(LABELERS)
    counted = candidates.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    digit = lambda p, j: F.substring(p, j + 1, 1).cast("double")
    row = counted.agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "pattern",
                    F.array(*[digit(F.col("pattern"), j) - 1 for j in range(m)]).alias("v"),
                    F.array(
                        F.lit(1.0),
                        *[digit(F.col("pattern"), j) - 1 for j in range(m)],
                        *[digit(F.col("pattern"), m + j) for j in range(3)],
                    ).alias("f"),
                    F.col("n").cast("double").alias("n"),
                )
            )
        ).alias("p")
    ).where(F.size("p") > 0)
    zero = F.lit(0.0)
    sigmoid = lambda z: 1 / (1 + F.exp(-z))
    dot = lambda a, b: _sum(F.zip_with(a, b, lambda x, y: x * y), zero)
    odds = lambda r: F.log(r / (1 - r))
    posterior = lambda p, s: sigmoid(
        odds(s["prior"]) + dot(p["v"], F.transform(s["r"], odds))
    )
    clip = lambda r: F.greatest(F.least(r, F.lit(0.98)), F.lit(0.02))

    def em(s: Column, _: Column) -> Column:
        q = F.transform("p", lambda p: F.struct(p["v"].alias("v"), p["n"].alias("n"), posterior(p, s).alias("q")))
        bound = F.transform(  # binds q once for all labelers
            F.array(q),
            lambda q: F.struct(
                clip(_sum(F.transform(q, lambda p: p["n"] * p["q"]), zero) / _sum(F.transform(q, lambda p: p["n"]), zero)).alias("prior"),
                F.transform(
                    F.sequence(F.lit(0), F.lit(m - 1)),
                    lambda j: clip(
                        _sum(
                            F.transform(
                                q,
                                lambda p: p["n"]
                                * F.when(F.get(p["v"], j) > 0, p["q"]).when(F.get(p["v"], j) < 0, 1 - p["q"]).otherwise(0.0),
                            ),
                            F.lit(3.5),
                        )
                        / _sum(F.transform(q, lambda p: p["n"] * F.abs(F.get(p["v"], j))), F.lit(5.0))
                    ),
                ).alias("r"),
            ),
        )
        return F.get(bound, 0)

    start = F.struct(F.lit(0.5).alias("prior"), F.array_repeat(F.lit(0.7), m).alias("r"))
    total = _sum(F.transform("soft", lambda p: p["n"]), zero)

    def descend(w: Column, _: Column) -> Column:
        grad = F.aggregate(
            "soft",
            F.array_repeat(zero, m + 4),
            lambda g, p: F.zip_with(
                g, p["f"], lambda a, x: a + x * p["n"] * (sigmoid(dot(w, p["f"])) - p["q"])
            ),
        )
        return F.zip_with(w, grad, lambda a, g: a - 1.0 * (g / F.col("total") + 1e-4 * a))

    return (
        row.withColumn("em", F.aggregate(F.sequence(F.lit(1), F.lit(EM_ROUNDS)), start, em))
        .withColumn(
            "soft",
            F.transform(
                "p",
                lambda p: F.struct(
                    p["pattern"].alias("pattern"), p["f"].alias("f"), p["n"].alias("n"), posterior(p, F.col("em")).alias("q")
                ),
            ),
        )
        .withColumn("total", total)
        .withColumn(
            "weights",
            F.aggregate(F.sequence(F.lit(1), F.lit(FIT_ROUNDS)), F.array_repeat(zero, m + 4), descend),
        )
        .select(
            F.col("em.r").alias("reliability"),
            F.col("em.prior").alias("prior"),
            "weights",
            F.transform(
                "soft",
                lambda p: F.struct(
                    p["pattern"].alias("pattern"),
                    p["n"].alias("n"),
                    p["q"].alias("soft"),
                    sigmoid(dot(F.col("weights"), p["f"])).alias("probability"),
                ),
            ).alias("scored"),
        )
    )


def _of_kind(kind: str):
    return lambda c: c["kind"] == kind


def accepted_patterns(docs: DataFrame, text: str = "text") -> list[str]:
    """Fit on all candidates of `docs`; the patterns that the span classifier accepts (at most 5,832)."""
    prepared = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text"))
    # an inner explode would push a filter on the whole expression below it and work the texts twice
    more = with_candidates(with_base(prepared)).select(F.explode_outer("_more").alias("c"))
    more = more.select("c.pattern").where(F.col("pattern").isNotNull())
    # the one row is read as it is: a filter above the fit would be pushed into it and repeat the work
    row = fit(more).first()
    return sorted(s["pattern"] for s in row["scored"] if s["probability"] >= ACCEPT) if row else []


def find(docs: DataFrame, text: str = "text", accepted: list[str] | None = None) -> DataFrame:
    """Add `pii`: all spans as (kind, start, end), base kinds first in their order, then added ones, by start.

    Starts and ends are code points, ends exclusive.  NULL and empty texts have no spans; repeated rows
    are treated alike; a column named pii is replaced.
    """
    if accepted is None:
        accepted = accepted_patterns(docs, text)
    prepared = with_candidates(with_base(docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))))
    base = [F.transform(f"_{k}", _named(k)) for k in BASE_KINDS]
    good = F.filter("_more", lambda c: c["pattern"].isin(accepted) if accepted else F.lit(False))
    more = [F.transform(F.filter(good, _of_kind(k)), _named(k)) for k in ADDED_KINDS]
    found = prepared.withColumn("pii", F.concat(*base, *more)).drop("_text", "_more", *[f"_{k}" for k in BASE_KINDS])
    return settled(found, "pii")


def digest(spans: Column) -> Column:
    """`kind:start:end` of every span, joined by commas."""
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, shown), ",")


def masked(docs: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """`docs` with every span of the text replaced by its kind in brackets; overlapping spans become one.

    The first span of an overlapping run gives the name, of those with one start the longest.  NULL texts stay
    NULL; texts without spans stay as they are.
    """
    zero = F.lit(0)
    block = lambda i: F.floor(i / F.lit(BLOCK)).cast("int")
    top = lambda values: F.coalesce(F.array_max(F.transform(values, lambda s: s["end"])), zero)
    order = F.array_sort(
        F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"), (-s["end"]).alias("back"), s["end"].alias("end"), s["kind"].alias("kind")
            ),
        )
    )
    tops = F.transform(
        F.sequence(zero, block(F.size("_order") - 1)), lambda b: top(F.slice(F.col("_order"), b * BLOCK + 1, F.lit(BLOCK)))
    )
    heads = F.aggregate(tops, F.array(zero), lambda acc, x: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), x))))
    # the largest end of the spans before each one; a run begins where it is not above the start
    reach = F.transform(
        F.sequence(zero, F.size("_order")),
        lambda i: F.greatest(
            F.get(F.col("_heads"), block(i)), top(F.slice(F.col("_order"), block(i) * BLOCK + 1, i % BLOCK))
        ),
    )
    begins = F.filter(
        F.sequence(zero, F.size("_order") - 1), lambda i: F.get(F.col("_reach"), i) <= F.get(F.col("_order"), i)["start"]
    )
    runs = F.transform(
        "_begins",
        lambda i, k: F.struct(
            F.get(F.col("_order"), i)["start"].alias("start"),
            F.get(F.col("_reach"), F.coalesce(F.get(F.col("_begins"), k + 1), F.size("_order"))).alias("end"),
            F.get(F.col("_order"), i)["kind"].alias("kind"),
        ),
    )

    def piece(s: Column, i: Column) -> Column:
        after = F.when(i > 0, F.get(F.col("_runs"), i - 1)["end"]).otherwise(0)
        return F.concat(F.substring(F.col(text), after + 1, s["start"] - after), F.lit("["), F.upper(s["kind"]), F.lit("]"))

    rest = F.substring(F.col(text), F.element_at("_runs", -1)["end"] + 1, F.char_length(F.col(text)))
    changed = (
        docs.withColumn("_order", F.when(F.size(spans) > 0, order))
        .withColumn("_heads", F.when(F.col("_order").isNotNull(), heads))
        .withColumn("_reach", F.when(F.col("_order").isNotNull(), reach))
        .withColumn("_begins", F.when(F.col("_order").isNotNull(), begins))
        .withColumn("_runs", F.when(F.col("_order").isNotNull(), runs))
        .withColumn(
            text,
            F.when(F.size("_runs") > 0, F.concat(F.array_join(F.transform("_runs", piece), ""), rest)).otherwise(F.col(text)),
        )
        .drop("_order", "_heads", "_reach", "_begins", "_runs")
    )
    return settled(changed, text)
