"""Quality rules with robust multivariate outliers (operator 4), DataFrame functions only.

Every text gets counts and a vector of PARTS transformed statistics (length,
word length, shares of punctuation with digits, of capitals and of different
words), rounded to 1/SCALE so that all sums are exact integers.  Per language
and source a minimum-covariance-determinant estimate is made: from each of
three deterministic STARTS, STEPS concentration steps take the SUBSET share of
rows of least Mahalanobis distance and renew centre and covariance; the start
that ends with the least determinant counts.  A step is one aggregation by
(group, start, bin of log distance) with the moments of each bin; the subset
ends at the bin that completes the share, and its moments are summed from the
bins.  So rows never gather: a group of any size is counts of a few hundred
bins, combined before the shuffle.

A source's moments are those of its subset with the mean moments of its
language as PRIOR further rows, a language's likewise with those of all texts,
and those of all texts with the quartiles' spreads: small groups lean on the
larger one, small tables on uncorrelated statistics, and there is no least size.
Distances are scaled down, where need be, to the median of a chi-squared
variable (the scale of a group leans on its language's in the same way).  A
text is rejected above CUTOFF, about the 1 - 1e-11 quantile of that variable;
it is that wide because shares in short texts have heavier tails.

Only texts that pass the base rules are estimated from.

Defined results: null or empty text has all counts 0 and fails the base rules;
null lang or source is the empty string; ties and repeated rows are rows of
their own; with no text that passes the base rules all distances are null;
empty tables give empty tables; further columns are kept by ``assess`` except
those named distance and kept.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialised

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MARKS = "!\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Counts for the vector alone, and the vector.
MORE = ["n_marks", "n_capitals", "n_different"]
PARTS = ["x0", "x1", "x2", "x3", "x4"]
P = len(PARTS)
SCALE, STEPS, SUBSET, PRIOR, BINS_PER_E = 512, 3, 0.75, 50, 16
#: The median of chi-squared with 5 degrees of freedom, and the squared
#: distance above which a text is rejected.
CHI_MEDIAN, CUTOFF = 4.351, 60.0
#: A pivot of the covariance is at least this share of the group's own
#: variance there, and that of the rounding to 1/SCALE.
RIDGE, ROUNDING = 1e-4, 1 / (12 * SCALE * SCALE)
STARTS = ("quartiles", "moments", "tanh")
#: Groups up to which their parameters (three rows each) are broadcast; above, they are joined.
SMALL_ROWS = 20_000
LOWER = [(i, j) for i in range(P) for j in range(i + 1)]


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, each word once."""
    last = F.size(words) - 3
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(w: Column) -> Column:
        pairs = F.array_sort(F.transform(w, lambda s, i: F.struct(s.alias("s"), i.alias("i"))))

        def marks(p: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(p, k)["s"] == x["s"], F.lit(False))
            hit = F.filter(F.transform(p, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"])), lambda i: i.isNotNull())
            return F.size(F.array_distinct(F.flatten(F.transform(hit, lambda i: F.array(i, i + 1, i + 2)))))

        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_let(pairs, marks))

    return F.when(last < 1, F.lit(0)).otherwise(_let(windows, covered))


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append COUNTS, MORE (long) and base_failed to ``docs``."""
    body = F.coalesce(F.col(text), F.lit(""))
    without = lambda c, chars: F.length(F.translate(c, chars, ""))
    lines = F.filter(F.split(body, "\n"), lambda x: without(x, SPACE) > 0)
    rows = docs.drop(*COUNTS, *MORE, "base_failed").withColumn("_words", F.filter(F.split(body, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    rows = rows.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": without(body, SPACE).cast("long"),
            "n_symbols": (F.length(body) - without(body, SYMBOLS)).cast("long"),
            "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": _repeat_words(F.col("_words")).cast("long"),
            "n_marks": (F.length(body) - without(body, MARKS)).cast("long"),
            "n_capitals": (F.length(body) - without(body, CAPITALS)).cast("long"),
            "n_different": F.size(F.array_distinct("_words")).cast("long"),
        }
    ).drop("_words")
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _vector() -> list[Column]:
    """PARTS of a row with COUNTS and MORE, as scaled integers."""
    share = lambda a, b, more=0: F.log((F.col(a) + more) / (F.greatest(F.col(b), F.lit(1 - more)) + more))
    raw = [F.log1p("n_words"), share("word_chars", "n_words"), share("n_marks", "word_chars", 1), share("n_capitals", "word_chars", 1), share("n_different", "n_words")]
    return [F.round(F.coalesce(v, F.lit(0.0)) * SCALE).cast("long").alias(k) for k, v in zip(PARTS, raw, strict=True)]


def _joined(rows: DataFrame, small: DataFrame, keys: list[str], few: bool, how: str = "inner") -> DataFrame:
    """Join of a table of parameters, broadcast only if it is known to be small."""
    return rows.join(F.broadcast(small) if few else small, keys, how)


def _total(columns) -> Column:
    return reduce(add, columns, F.lit(0.0))


def _distance() -> Column:
    """Squared Mahalanobis distance from the centre c and inverse factor w of ``par``."""
    away = [F.col(k) / SCALE - F.col(f"par.c{i}") for i, k in enumerate(PARTS)]
    return _total(F.pow(_total(F.col(f"par.w{i}_{j}") * away[j] for j in range(i + 1)), F.lit(2)) for i in range(P))


def _factored(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and par: centre, inverse of the lower Cholesky factor and log
    determinant, from centre c* and covariance a*_* (not scaled)."""
    out = rows
    left = lambda i, j: F.col(f"a{i}_{j}") - _total(F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") for k in range(j))
    for j in range(P):  # a column's pivot, then what is below it
        out = out.withColumn(f"l{j}_{j}", F.sqrt(F.greatest(left(j, j), RIDGE * F.col(f"a{j}_{j}"), F.lit(ROUNDING))))
        if j + 1 < P:
            out = out.withColumns({f"l{i}_{j}": left(i, j) / F.col(f"l{j}_{j}") for i in range(j + 1, P)})
    for d in range(P):  # the inverse, by distance from the diagonal
        rest = lambda i, j: -_total(F.col(f"l{i}_{k}") * F.col(f"w{k}_{j}") for k in range(j, i))
        out = out.withColumns({f"w{i}_{i - d}": (rest(i, i - d) if d else F.lit(1.0)) / F.col(f"l{i}_{i}") for i in range(d, P)})
    names = [*(f"c{i}" for i in range(P)), *(f"w{i}_{j}" for i, j in LOWER)]
    return out.select(*keys, F.struct(*names, _total(2 * F.log(f"l{i}_{i}") for i in range(P)).alias("logdet")).alias("par"))


def _sums(of=F.col) -> list[Column]:
    """Count, sums s* and products q*_* of the vector."""
    return [F.count(F.lit(1)).alias("n"), *(F.sum(of(k)).alias(f"s{i}") for i, k in enumerate(PARTS)), *(F.sum(of(PARTS[i]) * of(PARTS[j])).alias(f"q{i}_{j}") for i, j in LOWER)]


MOMENTS = [*(f"s{i}" for i in range(P)), *(f"q{i}_{j}" for i, j in LOWER)]


def _spread(rows: DataFrame, scale: float = SCALE) -> DataFrame:
    """Append c* and a*_* from mean moments."""
    out = rows.withColumns({f"c{i}": F.col(f"s{i}") / scale for i in range(P)})
    return out.withColumns({f"a{i}_{j}": F.col(f"q{i}_{j}") / (scale * scale) - F.col(f"c{i}") * F.col(f"c{j}") for i, j in LOWER})


def _leaning(moments: DataFrame, base: DataFrame) -> DataFrame:
    """Mean moments by (grp, start) of sums: PRIOR rows of the parent's are
    added, from the top down; those of all texts lean on ``base``."""
    rows = moments.withColumn("level", F.when(F.col("grp") == "[]", 0).when(F.col("parent") == "[]", 1).otherwise(2))
    out, above = None, base
    for level in (0, 1, 2):
        held = above.select(F.col("grp").alias("parent"), "start", *(F.col(m).alias(f"_{m}") for m in MOMENTS))
        mine = rows.where(F.col("level") == level).join(held, ["parent", "start"])
        above = mine.select("grp", "start", *(((F.col(m) + PRIOR * F.col(f"_{m}")) / (F.col("n") + PRIOR)).alias(m) for m in MOMENTS))
        out = above if out is None else out.unionByName(above)
    return out


def _binned(fit: DataFrame, params: DataFrame, few: bool) -> DataFrame:
    """Moments by (grp, start, bin of log distance) with the rows up to each bin and in all."""
    bin_ = F.floor(F.log(_distance() + 1e-9) * BINS_PER_E).alias("bin")
    rows = _joined(fit, params, ["grp"], few).select("grp", "parent", "start", bin_, *PARTS)
    bins = rows.groupBy("grp", "parent", "start", "bin").agg(*_sums())
    group = Window.partitionBy("grp", "start")
    return bins.withColumns({"upto": F.sum("n").over(group.orderBy("bin")), "total": F.sum("n").over(group)})


def _concentrated(bins: DataFrame) -> DataFrame:
    """The moments of the least distant SUBSET share."""
    inner = bins.where(F.col("upto") - F.col("n") < F.ceil(F.col("total") * SUBSET))
    return inner.groupBy("grp", "parent", "start").agg(F.sum("n").alias("n"), *(F.sum(m).alias(m) for m in MOMENTS))


def _starts(fit: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """grp, start, par: medians with quartiles' spreads; all rows' moments; and
    medians with the correlation of tanh of the standardised statistics.  Then
    the mean moments of the first for all texts (grp ''), for every start, and
    whether there are so few groups that their parameters can be broadcast."""
    quartiles = [F.percentile(k, F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias(k) for k in PARTS]
    held = materialised(fit.groupBy("grp").agg(*quartiles, *_sums()), "quality-starts")
    few = held.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    width = lambda i: F.sqrt(F.greatest(F.pow((F.col(PARTS[i])[2] - F.col(PARTS[i])[0]) / SCALE / 1.349, F.lit(2)), F.lit(ROUNDING)))
    middle = {f"c{i}": F.col(k)[1] / SCALE for i, k in enumerate(PARTS)}
    one = held.withColumns(middle | {f"a{i}_{j}": F.pow(width(i), F.lit(2)) if i == j else F.lit(0.0) for i, j in LOWER})
    two = _spread(held.select("grp", *((F.col(m) / F.col("n")).alias(m) for m in MOMENTS)))
    marks = held.select("grp", F.struct(*(F.col(k)[1].alias(f"m{i}") for i, k in enumerate(PARTS)), *((width(i) * SCALE).alias(f"d{i}") for i in range(P))).alias("par"))
    pressed = _joined(fit, marks, ["grp"], few).select("grp", *(F.tanh((F.col(k) - F.col(f"par.m{i}")) / F.col(f"par.d{i}")).alias(k) for i, k in enumerate(PARTS)))
    tanh = pressed.groupBy("grp").agg(*_sums())
    tanh = _spread(tanh.select("grp", *((F.col(m) / F.col("n")).alias(m) for m in MOMENTS)), 1.0).drop(*MOMENTS)
    sd = lambda i: F.sqrt(F.greatest(F.col(f"a{i}_{i}"), F.lit(ROUNDING)))
    three = tanh.join(held, "grp").select("grp", *(v.alias(k) for k, v in middle.items()), *((F.col(f"a{i}_{j}") / (sd(i) * sd(j)) * width(i) * width(j)).alias(f"a{i}_{j}") for i, j in LOWER))
    names = ["grp", *middle, *(f"a{i}_{j}" for i, j in LOWER)]
    parts = [d.select(*names, F.lit(s).alias("start")) for s, d in zip(STARTS, (one, two, three), strict=True)]
    sums = {f"s{i}": F.col(f"c{i}") * SCALE for i in range(P)} | {f"q{i}_{j}": (F.col(f"a{i}_{j}") + F.col(f"c{i}") * F.col(f"c{j}")) * (SCALE * SCALE) for i, j in LOWER}
    every = one.where("grp = '[]'").select(F.lit("").alias("grp"), F.explode(F.array(*map(F.lit, STARTS))).alias("start"), *(v.alias(k) for k, v in sums.items()))
    return _factored(reduce(DataFrame.unionByName, parts), ["grp", "start"]), every, few


def estimate(rows: DataFrame) -> tuple[DataFrame, bool]:
    """(lang, source, par, scale), and whether they are few.  ``rows`` has lang, source, PARTS and
    base_failed and is read STEPS + 4 times, so it should be a written table."""
    own, lang, every = F.to_json(F.array("lang", "source")), F.to_json(F.array("lang")), F.lit("[]")
    level = lambda g, p: F.struct(g.alias("grp"), p.alias("parent"))
    levels = F.array(level(own, lang), level(lang, every), level(every, F.lit("")))
    fit = rows.where(~F.col("base_failed")).select(F.explode(levels).alias("g"), *PARTS).select("g.*", *PARTS)
    params, base, few = _starts(fit)
    for _ in range(STEPS):
        moments = materialised(_concentrated(_binned(fit, params, few)), "quality-moments")
        params = _factored(_spread(_leaning(moments, base)), ["grp", "start"])
    best = params.groupBy("grp").agg(F.min_by(F.struct("start", "par"), F.struct("par.logdet", "start")).alias("b"))
    best = materialised(best.select("grp", "b.*"), "quality-params")
    half = _binned(fit, best, few).where(F.col("upto") >= F.col("total") / 2).groupBy("grp", "parent").agg(F.min("bin").alias("bin"), F.min("total").alias("n"))
    half = materialised(half.select("grp", "parent", "n", (F.log(F.lit(CHI_MEDIAN)) - (F.col("bin") + 0.5) / BINS_PER_E).alias("away")), "quality-scale")
    scale = half.where("grp = '[]'").select("grp", "away")
    for level in ("parent = '[]'", "parent NOT IN ('', '[]')"):
        above = scale.select(F.col("grp").alias("parent"), F.col("away").alias("over"))
        scale = half.where(level).join(above, "parent").select("grp", ((F.col("n") * F.col("away") + PRIOR * F.col("over")) / (F.col("n") + PRIOR)).alias("away"))
    scale = scale.select("grp", F.least(F.lit(1.0), F.exp("away")).alias("scale"))
    named = rows.select("lang", "source").distinct().withColumn("grp", own)
    return materialised(named.join(best.join(scale, "grp"), "grp").select("lang", "source", "par", "scale"), "quality-params"), few


def assess(counted: DataFrame) -> DataFrame:
    """Append distance (squared, scaled; null where nothing was estimated) and
    kept to ``counted``: a written table with the columns of ``with_counts``,
    lang and source.  A source of which no text passes the base rules has no estimate."""
    keys = [F.coalesce(F.col(k), F.lit("")).alias(k) for k in ("lang", "source")]
    params, few = estimate(counted.select(*keys, "base_failed", *_vector()))
    rows = counted.select(F.struct(*(F.col(f"`{c}`") for c in counted.columns)).alias("in"), "base_failed", *keys, *_vector())
    rows = _joined(rows, params, ["lang", "source"], few, "left").withColumn("distance", _distance() * F.col("scale"))
    verdict = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CUTOFF)
    passed = [F.col(f"in.`{c}`").alias(c) for c in counted.columns if c not in ("distance", "kept")]
    return rows.select(*passed, "distance", verdict.alias("kept"))


def documents_quality(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS, base_failed, distance and kept of every document."""
    counted = with_counts(docs.select("doc_id", "text", "lang", "source")).drop("text")
    return assess(materialised(counted, "quality-counts")).select("doc_id", *COUNTS, "base_failed", "kept", "distance")
