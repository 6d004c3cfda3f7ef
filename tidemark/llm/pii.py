"""Personal data: fixed patterns, and wider candidates that boosted trees accept; SQL functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import once

# Fixed patterns of the base scan. Each is the plain pattern made safe for very long runs: a match can only
# begin where a run begins or where the last match ended, and no repetition gives back what it took.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
#: What a text has if the pattern can match with success, cheaper than the pattern itself.
GUARDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){12}", "phone": r"\+[0-9]"}

#: The high-recall generators, each over what the base scan and the earlier ones leave: addresses whose signs may be spelt out, dotted
#: numbers whose dots may be, runs of digits and separators, and the parts of such runs between spaces.
_AT = r"(?: ?@ ?| ?[\[({<] ?(?:at|AT|@) ?[\])}>] ?| (?:at|AT) )"
_DOT = r"(?:\.| ?[\[({<] ?(?:dot|DOT|\.) ?[\])}>] ?| (?:dot|DOT) )"
GENERATORS = {
    "address": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++",
    "dotted": rf"(?<![0-9])[0-9]{{1,3}}+(?:(?:{_DOT}| \. ?|\. )[0-9]{{1,3}}+){{3}}(?![0-9])",
    "number": r"[+(]{0,2}+[0-9](?:[ ()./-]{0,3}+[0-9])++",
    "part": r"[+(]{0,2}+[0-9](?:[()./-]{0,2}+[0-9])++",
}
ADDED = tuple(GENERATORS)
#: What a text has if some generator can match, cheaper than they are.
WORTH = r"[0-9][ ()./-]{0,3}[0-9]|@|(?:at|AT)[ \])}>]"
#: Text before a span that is looked at, in code points, at most back to the match before it.
CONTEXT = 24
CUES = r"phone|mobile|\btel|\bcall|fax|e-?mail|contact|whatsapp|reach|write to|card|visa|master|credit|iban|account|\bip\b|server|host|login"
OTHER = r"order|invoice|version|isbn|\bid\b|page|date|year|section|article|\bno\.|#|=|0x"
FEATURES = ("kind", "digits", "groups", "plus", "brackets", "luhn", "context", "glued", "signs", "parts", "ending")
ROUNDS, RATE, RIDGE = 24, 0.3, 1.0
#: Precision that each kind's threshold is set for on the half of the documents that the trees don't learn from.
PRECISION = 0.95
#: How base matches are altered to stand for personal data that the base scan misses: (base kind, pattern, replacement, kind).
ALTERED = (
    ("email", "@", " (at) ", "address"), ("email", "@", " at ", "address"), ("email", "@", " @ ", "address"),
    ("ip", r"\.", "[.]", "dotted"), ("ip", r"\.", " dot ", "dotted"), ("ip", r"\.", " . ", "dotted"),
    ("phone", r"^\+", "", "number"), ("phone", r"^\+[0-9]{1,3}[ .-]?", "", "number"), ("phone", r"^\+[0-9]{1,3}[ .-]?\(?([0-9]+)\)? ?", "0$1/", "part"),
    ("card", r"[0-9]{4}(?=.)", "$0.", "part"), ("card", r"[0-9]{4}(?=.)", "$0 / ", "number"),
)
#: Stands for a character of a span that is found already, and parts what is matched from what isn't. No pattern has either.
_GONE, _EDGE = "\x02", "\x01"
_BLOCK = 128


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _parts(text: Column, pattern: str) -> Column:
    """The text between matches and the matches, by turns; the first and the last are between."""
    clean = F.when(text.contains(_EDGE), F.translate(text, _EDGE, "\x03")).otherwise(text)
    return F.split(F.regexp_replace(clean, pattern, f"{_EDGE}$0{_EDGE}"), _EDGE, -1)


def _starts(lengths: Column) -> Column:
    """How much stands before each element of an array of lengths; sums of blocks keep a long array from being summed again and again."""
    count = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    blocks = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _BLOCK).cast("int")), lambda b: count(F.slice(xs, b * _BLOCK + 1, _BLOCK)))
    before = lambda sums: F.transform(sums, lambda _, b: count(F.slice(sums, F.lit(1), b)))

    def place(xs: Column, sums: Column) -> Column:
        block = lambda i: F.floor(i / _BLOCK).cast("int")
        return F.transform(xs, lambda _, i: F.get(sums, block(i)) + count(F.slice(xs, block(i) * _BLOCK + 1, i % _BLOCK)))

    return _let(blocks(lengths), lambda sums: _let(before(sums), lambda done: place(lengths, done)))


_SPAN = "array<struct<start:bigint,end:bigint,hit:string,before:string,after:string>>"


def _seen(parts: Column, i: Column) -> list[Column]:
    """A match and what stands around it."""
    return [F.get(parts, i).alias("hit"), F.right(F.get(parts, i - 1), F.lit(CONTEXT)).alias("before"), F.left(F.get(parts, i + 1), F.lit(1)).alias("after")]


def find(text: Column, pattern: str, guard: str) -> Column:
    """An array of (start, end, hit, before, after) for the leftmost non-overlapping matches, in code points.

    before and after are what stands around a match, as far as the matches next to it.
    """

    def spans(parts: Column) -> Column:
        def at(starts: Column) -> Column:
            def span(k: Column) -> Column:
                i = 2 * k + 1
                start = F.get(starts, i).cast("bigint")
                return F.struct(start.alias("start"), (start + F.length(F.get(parts, i))).alias("end"), *_seen(parts, i))

            return F.transform(F.sequence(F.lit(0), F.floor(F.size(parts) / 2).cast("int") - 1), span)

        some = _let(_starts(F.transform(parts, lambda p: F.length(p))), at)
        return F.when(F.size(parts) > 1, some.cast(_SPAN)).otherwise(F.expr(f"cast(array() as {_SPAN})"))

    found = _let(_parts(text, pattern), spans)
    return F.when(F.coalesce(text.rlike(guard), F.lit(False)), found).otherwise(F.expr(f"cast(array() as {_SPAN})"))


def blank(text: Column, pattern: str, guard: str, gone) -> Column:
    """The text with the matches for which gone(parts, index) is true replaced by signs that no pattern has, one for each code point."""

    def turned(parts: Column) -> Column:
        sign = lambda p, i: F.when((i % 2 == 1) & gone(parts, i), F.repeat(F.lit(_GONE), F.length(p))).otherwise(p)
        return F.array_join(F.transform(parts, sign), "")

    return F.when(F.coalesce(text.rlike(guard), F.lit(False)), _let(_parts(text, pattern), turned)).otherwise(text)


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    turned = F.transform(F.split(F.reverse(digits), ""), lambda c, i: c.cast("int") * (i % 2 + 1))
    total = F.aggregate(F.filter(turned, lambda v: v.isNotNull()), F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v))
    return total % 10 == 0


def _small_parts(hit: Column) -> Column:
    """Whether all parts of an address are at most 255."""
    return F.forall(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _valid(kind: str, hit: Column) -> Column:
    n = F.length(digits_of(hit))
    if kind == "ip":
        return _small_parts(hit)
    if kind == "card":
        return n.between(13, 19) & luhn(digits_of(hit))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}


def base_columns(text: Column) -> dict[str, Column]:
    """For each kind the array of its valid matches."""
    valid = lambda kind: lambda s: _valid(kind, s["hit"])
    return {k: F.filter(find(text, PATTERNS[k], GUARDS[k]), valid(k)) for k in KINDS}


def _features(kind: str, span: Column, *more: Column) -> Column:
    """The span with its features, each a small number, and more; the features depend on the span and its surroundings alone."""
    hit, before = span["hit"], F.lower(span["before"])
    number = kind in ("number", "part")
    digits = digits_of(hit)
    n = F.length(digits)
    zero = F.lit(0)
    signs = F.when(hit.rlike(r"[\[({<]"), 1).when(hit.rlike(" (?:at|AT|dot|DOT) "), 2).when(hit.contains(" "), 3).otherwise(0)
    last = F.lower(F.regexp_extract(hit, "([A-Za-z]+)$", 1))
    spaced = F.regexp_replace(hit, r"[^0-9]+", " ")
    return F.struct(
        span["start"].alias("start"), span["end"].alias("end"), F.lit(ADDED.index(kind)).alias("kind"),
        (F.when(n < 7, 0).when(n < 9, 1).when(n < 13, 2).when(n < 16, 3).when(n == 16, 4).when(n < 20, 5).otherwise(6) if number else zero).alias("digits"),
        (F.least(F.size(F.split(F.trim(spaced), " ")), F.lit(6)) if number else zero).alias("groups"),
        (hit.contains("+").cast("int") if number else zero).alias("plus"),
        (hit.contains("(").cast("int") if number else zero).alias("brackets"),
        (luhn(digits).cast("int") if number else zero).alias("luhn"),
        F.when(before.rlike(CUES), 1).when(before.rlike(OTHER), 2).otherwise(0).alias("context"),
        F.concat(F.right(span["before"], F.lit(1)), F.lit(" "), span["after"]).rlike("[A-Za-z0-9_]").cast("int").alias("glued"),
        (zero if number else signs).alias("signs"),
        (_small_parts(F.regexp_replace(F.trim(spaced), " ", ".")).cast("int") if kind == "dotted" else zero).alias("parts"),
        (F.when(last.rlike("^(?:com|org|net|edu|gov|info|io|eu|[a-z]{2})$"), 2).when(last.rlike("^[a-z]{2,6}$"), 1).otherwise(0) if kind == "address" else zero).alias("ending"), *more,
    )


_GUARD = {"address": r"@|(?:at|AT)[ \])}>]", "dotted": r"[0-9] ?[\[({<.d]", "number": r"[0-9]", "part": r"[0-9]"}


def _left_by_base(df: DataFrame) -> DataFrame:
    """With the column left, the text whose base matches are blanked; a projection a kind, so that no expression is written out twice."""
    valid = lambda kind: lambda parts, i: _valid(kind, F.get(parts, i))
    df = df.withColumn("left", F.when(F.col("text").rlike(WORTH), F.col("text")).otherwise(F.lit("")))
    for k in KINDS:
        df = df.withColumn("left", blank(F.col("left"), PATTERNS[k], GUARDS[k], valid(k)))
    return df


def candidates(text: Column, kind: str) -> Column:
    """An array of one generator's spans with their features."""
    return F.transform(_proposals(text, kind), lambda s: _features(kind, s))


def _proposals(text: Column, kind: str) -> Column:
    return F.filter(find(text, GENERATORS[kind], _GUARD[kind]), lambda s: _proposed(kind, s["hit"]))


def _proposed(kind: str, hit: Column) -> Column:
    return F.length(digits_of(hit)) >= 7 if kind in ("number", "part") else F.lit(True)


@dataclass(frozen=True)
class Tree:
    """A split, a split on either side and four leaves: (feature, most) goes left if feature <= most."""

    top: tuple[str, int]
    sides: tuple[tuple[str, int], tuple[str, int]]
    leaves: tuple[float, float, float, float]

    def value(self, x: dict) -> float:
        side = 0 if x[self.top[0]] <= self.top[1] else 1
        feature, most = self.sides[side]
        return self.leaves[2 * side + (0 if x[feature] <= most else 1)]

    def column(self, c: Column) -> Column:
        pick = lambda side: F.when(c[self.sides[side][0]] <= self.sides[side][1], self.leaves[2 * side]).otherwise(self.leaves[2 * side + 1])
        return F.when(c[self.top[0]] <= self.top[1], pick(0)).otherwise(pick(1))


def _best_split(cells: list[tuple[dict, float, float]]) -> tuple[str, int]:
    """The split of least loss; cells are (features, gradient, hessian)."""
    best = (-1.0, (FEATURES[0], 0))
    g_all, h_all = sum(c[1] for c in cells), sum(c[2] for c in cells)
    for feature in FEATURES:
        bins: dict[int, list[float]] = {}
        for x, g, h in cells:
            b = bins.setdefault(x[feature], [0.0, 0.0])
            b[0] += g
            b[1] += h
        g = h = 0.0
        for most in sorted(bins)[:-1]:
            g, h = g + bins[most][0], h + bins[most][1]
            gain = g * g / (h + RIDGE) + (g_all - g) ** 2 / (h_all - h + RIDGE) - g_all * g_all / (h_all + RIDGE)
            best = max(best, (gain, (feature, most)), key=lambda v: v[0])
    return best[1]


def boost(cells: list[tuple[dict, int, int]]) -> list[Tree]:
    """Gradient-boosted trees of depth two on cells of (features, positives, negatives)."""
    trees: list[Tree] = []
    scores = [0.0] * len(cells)
    for _ in range(ROUNDS if cells else 0):
        graded = []
        for (x, yes, no), s in zip(cells, scores, strict=True):
            p = 1 / (1 + math.exp(-s))
            graded.append((x, yes - (yes + no) * p, (yes + no) * p * (1 - p)))
        top = _best_split(graded)
        sides, leaves = [], []
        for side in (0, 1):
            mine = [c for c in graded if (c[0][top[0]] <= top[1]) == (side == 0)]
            split = _best_split(mine) if mine else (FEATURES[0], 0)
            sides.append(split)
            for low in (True, False):
                part = [c for c in mine if (c[0][split[0]] <= split[1]) == low]
                leaves.append(RATE * sum(c[1] for c in part) / (sum(c[2] for c in part) + RIDGE))
        trees.append(Tree(top, tuple(sides), tuple(leaves)))
        scores = [s + trees[-1].value(x) for (x, _, _), s in zip(cells, scores, strict=True)]
    return trees


def threshold(trees: list[Tree], cells: list[tuple[dict, int, int]]) -> float:
    """The least score from which upwards the cells hold PRECISION of positives; infinite if none does."""
    scored: dict[float, list[int]] = {}
    for x, yes, no in cells:
        both = scored.setdefault(round(sum(t.value(x) for t in trees), 9), [0, 0])
        both[0] += yes
        both[1] += no
    best, yes_sum, no_sum = math.inf, 0, 0
    for score in sorted(scored, reverse=True):  # cells of one score pass or fail together
        yes_sum, no_sum = yes_sum + scored[score][0], no_sum + scored[score][1]
        if yes_sum >= PRECISION * (yes_sum + no_sum) and scored[score][0]:
            best = score
    return best


@dataclass(frozen=True)
class Model:
    trees: tuple[Tree, ...]
    least: dict[str, float]  # the threshold of each kind of ADDED

    def accepts(self, c: Column, kind: str) -> Column:
        if not math.isfinite(self.least[kind]):
            return F.lit(False)
        return sum((t.column(c) for t in self.trees), F.lit(0.0)) >= F.lit(self.least[kind] - 1e-6)


def examples(documents: DataFrame) -> DataFrame:
    """Rows (half, y, features, n): how many candidates of each half have these features.

    Positive are valid base matches altered as ALTERED says, in their own surroundings, and candidates beyond the
    base that a cue precedes and whose form is possible. Negative are the candidates with another cue or none. All of them are
    counted by feature values where they are read, so little is shuffled and nothing grows with a document but its own spans.
    """
    text = F.col("text")
    kinds = base_columns(text)

    def altered(kind: str, pattern: str, new: str) -> Column:
        return F.transform(F.col(f"_{kind}"), lambda s: s.withField("hit", F.regexp_replace(s["hit"], pattern, new)).withField("own", F.lit(True)))

    def of_kind(kind: str) -> Column:
        own = [altered(*how[:3]) for how in ALTERED if how[3] == kind]
        found = F.transform(_proposals(F.col("left"), kind), lambda s: s.withField("own", F.lit(False)))
        return F.transform(F.concat(*own, found), lambda s: _features(kind, s, s["own"].alias("own")))

    read = (
        documents.select("doc_id", "text")
        .where(text.rlike(WORTH))
        .select(F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(2)).alias("half"), "text", *[c.alias(f"_{k}") for k, c in kinds.items()])
    )
    spans = _left_by_base(read).select("half", once(F.concat(*[of_kind(k) for k in ADDED])).alias("cs"))
    possible = (F.col("digits").between(1, 5) | ~F.col("kind").isin(ADDED.index("number"), ADDED.index("part"))) & (F.col("glued") == 0)
    return (
        spans.select("half", F.explode("cs").alias("c"))
        .select("half", "c.*")
        .select("half", *FEATURES, (F.col("own") | ((F.col("context") == 1) & possible)).cast("int").alias("y"))
        .groupBy("half", "y", *FEATURES)
        .agg(F.count("*").alias("n"))
    )


def fit(documents: DataFrame) -> Model:
    """Trees from the examples of one half of a table's documents and each kind's threshold from the other.

    The driver gets counts by feature values, of which there are some thousand at most.
    """
    rows = examples(documents).collect()
    halves: tuple[dict, dict] = ({}, {})
    for r in sorted(rows, key=lambda r: tuple(r[f] for f in FEATURES)):
        cell = halves[r["half"]].setdefault(tuple(r[f] for f in FEATURES), [0, 0])
        cell[0 if r["y"] else 1] += r["n"]
    learnt, other = ([(dict(zip(FEATURES, x, strict=True)), *n) for x, n in half.items()] for half in halves)
    trees = boost(learnt or other)
    of_kind = lambda cells, k: [c for c in cells if c[0]["kind"] == k]
    return Model(tuple(trees), {kind: threshold(trees, of_kind(other, k) or of_kind(learnt, k)) for k, kind in enumerate(ADDED)})


def _accepted(model: Model, kind: str):
    return lambda c: model.accepts(c, kind)


def _taken(model: Model, kind: str):
    """Whether a match is one that is accepted, told by the same features."""
    nowhere = [F.lit(0).cast("bigint").alias(c) for c in ("start", "end")]
    features = lambda parts, i: F.array(_features(kind, F.struct(*nowhere, *_seen(parts, i))))
    return lambda parts, i: _proposed(kind, F.get(parts, i)) & F.exists(features(parts, i), _accepted(model, kind))


def scan(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans.

    Spans are kind:start:end in code points. The base matches stay. The generators run in their order over what is
    left, and a candidate is added under its generator's name if the trees' score reaches the threshold of its kind; accepted ones are
    blanked before the next generator, so added spans overlap neither one another nor the base matches. Matches are
    numbered in time and memory near proportion to the text, so a text of any length is scanned whole. Nothing is
    shuffled but the counts that the trees learn from. A null text is empty and has no span; repeated and null doc
    ids keep a row each; columns of other names play no part; an empty table gives no row and fits nothing.
    """
    model = fit(documents)
    text = F.coalesce("text", F.lit(""))
    out = documents.select("doc_id", text.alias("text")).select("doc_id", "text", *[c.alias(k) for k, c in base_columns(F.col("text")).items()])
    out = _left_by_base(out)
    spoken = lambda kind: lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))
    wanted = [k for k in ADDED if math.isfinite(model.least[k])]
    for k in wanted:
        out = out.withColumn(f"_{k}", F.filter(candidates(F.col("left"), k), _accepted(model, k)))
        if k != wanted[-1]:
            out = out.withColumn("left", F.when(F.size(f"_{k}") > 0, blank(F.col("left"), GENERATORS[k], _GUARD[k], _taken(model, k))).otherwise(F.col("left")))
    none = F.expr("cast(array() as array<string>)")
    out = out.withColumns({
        "said": F.concat(none, *[F.transform(k, spoken(k)) for k in KINDS]),
        "more": F.concat(none, *[F.transform(f"_{k}", spoken(k)) for k in wanted]),
    })
    return out.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join("said", ","), 256).alias("base_sha256"),
        F.array_join(F.concat("said", "more"), ",").alias("spans"),
        F.size("more").cast("long").alias("n_added"),
        (F.size("said") + F.size("more")).cast("long").alias("n_spans"),
    )
