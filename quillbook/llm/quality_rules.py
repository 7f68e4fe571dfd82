"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Besides fixed base rules, every document gets a vector of transformed statistics.
For each language and source the minimum covariance determinant estimate of location
and scatter is found by concentration steps from three deterministic starts:
distances under the current estimate, the ``SUBSET`` share of smallest distances,
and the moments of that share, until the determinant falls no more; the start that
ends with the least determinant stays.  A document whose Mahalanobis distance
exceeds the cutoff goes.

A group counts ``PRIOR`` rows of its language's estimate among its own, and a
language as many of the estimate of all rows, and every variance has ``FLOOR`` added:
so a group of any size has an estimate, one of few rows leans on its language, and
steps still never raise the (regularised) determinant.

All rows count in every step, and a step is two aggregations by group: quantiles
come from histograms of fixed bucket width, scatter from mergeable moments, and the
Cholesky factor from column arithmetic.  No group is ever collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

SUBSET = 0.75
#: A start ends where the logarithm of its determinant falls by less than ``FALL``, or
#: after so many steps.
FALL, STEPS = 0.01, 12
#: Rows of the estimate above that a group counts among its own: five a dimension.
PRIOR = 25
#: Squared distances beyond this go: the 1 - 1e-6 quantile of the chi-square law
#: with five degrees of freedom.
CUTOFF = 35.9
#: Variance that every statistic has at least, so that one that hardly varies among
#: ordinary documents does not make small deviations decisive.
FLOOR = 0.16
#: Median of the chi-square law with five degrees of freedom.
_MEDIAN = 4.351
_DIMS = ("x1", "x2", "x3", "x4", "x5")
_SPACE = r"[\x20\x09-\x0D]+"
#: Distinct repeated windows up to which membership is tested by scanning.
_FEW = 32


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _covered(starts: Column) -> Column:
    """Words in windows of three words that begin at the ascending ``starts``."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        starts,
        zero,
        lambda s, at: F.struct(
            (at + 3).cast("int").alias("end"), (s["n"] + at + 3 - F.greatest(at, s["end"])).cast("long").alias("n")
        ),
        lambda s: s["n"],
    )


def _repeated(windows: Column) -> Column:
    """Words in windows whose hash occurs at least twice.

    Hashes are sorted as plain longs to find the repeated ones.  Where these are
    few, places are found by scanning; else by sorting hashes with their places.
    """

    def of(hashes: Column) -> Column:
        ordered = F.sort_array(hashes)
        twice = _bind(ordered, lambda o: F.array_distinct(F.filter(o, lambda x, i: x == F.get(o, i - 1))))

        def scanned(some: Column) -> Column:
            marked = F.transform(hashes, lambda x, i: F.when(F.array_contains(some, x), i))
            return F.filter(marked, lambda i: i.isNotNull())

        def sorted_() -> Column:
            pairs = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
            return _bind(
                pairs,
                lambda p: F.sort_array(
                    F.transform(
                        F.filter(p, lambda v, k: (v["x"] == F.get(p, k - 1)["x"]) | (v["x"] == F.get(p, k + 1)["x"])),
                        lambda v: v["i"],
                    )
                ),
            )

        return _bind(
            twice,
            lambda some: F.when(F.size(some) == 0, F.lit(0).cast("long"))
            .when(F.size(some) <= _FEW, _covered(scanned(some)))
            .otherwise(_covered(sorted_())),
        )

    return _bind(windows, of)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang, source`` and the counts ``n_points, n_words, word_chars,
    n_symbols, n_lines, n_dup_lines, n_repeat_words`` of every row.

    Words are runs without ASCII white space; lines are parts between line feeds
    that have a word.  ``n_repeat_words`` compares windows by 64-bit hashes.  Null
    text counts as empty; absent ``lang`` or ``source`` columns as null."""
    have = {c for c in ("lang", "source") if c in docs.columns}
    keys = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in ("lang", "source")]
    rows = docs.select(F.col(id_col).alias("doc_id"), *keys, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("*", F.array_remove(F.split("text", _SPACE, -1), "").alias("words"))
    windows = F.slice(
        F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))),
        1, F.greatest(F.size("words") - 2, F.lit(0)),
    )
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    duplicates = _bind(lines, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("distinct")))
    rows = rows.select(
        "doc_id", "lang", "source",
        F.char_length("text").cast("long").alias("n_points"),
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("text", _SPACE, "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        duplicates.alias("lines"),
        _repeated(windows).alias("n_repeat_words"),
    )
    return rows.select(
        "doc_id", "lang", "source", "n_points", "n_words", "word_chars", "n_symbols", F.col("lines.all").cast("long").alias("n_lines"),
        (F.col("lines.all") - F.col("lines.distinct")).cast("long").alias("n_dup_lines"), "n_repeat_words",
    )


def _vector() -> list[Column]:
    """Logarithms of the counts' rates: about symmetric among ordinary documents."""
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    return [
        F.log1p("n_words").alias("x1"),
        (2 * F.log((F.col("word_chars") + 1) / words)).alias("x2"),
        F.log1p(200 * F.col("n_symbols") / chars).alias("x3"),
        F.log1p(10 * F.col("n_dup_lines") / lines).alias("x4"),
        F.log1p(10 * F.col("n_repeat_words") / words).alias("x5"),
    ]


def _quantiles(rows: DataFrame, keys: list[str], value: Column, width: float, shares: dict[str, float]) -> DataFrame:
    """Quantiles by group, to within ``width``: from a histogram, which partial
    aggregation makes and whose size does not depend on the number of rows."""
    counts = rows.groupBy(*keys, F.floor(value / width).alias("bucket")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*keys)
    summed = counts.withColumn("upto", F.sum("n").over(whole.orderBy("bucket"))).withColumn("all", F.sum("n").over(whole))
    found = [F.min(F.when(F.col("upto") >= q * F.col("all"), (F.col("bucket") + 0.5) * width)).alias(name) for name, q in shares.items()]
    return summed.groupBy(*keys).agg(*found)


_PAIRS = [(i, j) for i in range(1, len(_DIMS) + 1) for j in range(1, i + 1)]
_MEANS, _SCATTER = [f"m{i}" for i in range(1, len(_DIMS) + 1)], [f"c{i}{j}" for i, j in _PAIRS]
_FACTOR = [f"l{i}{j}" for i, j in _PAIRS]
_SHAPE = [*_MEANS, *_SCATTER, *_FACTOR, "logdet"]


def _factors() -> list[str]:
    """The lower factor ``l11..l55`` of the scatter ``c11..c55`` and the logarithm of its
    determinant, as SELECT items that refer to the ones before."""
    out = []
    for j in range(1, len(_DIMS) + 1):
        for i in range(j, len(_DIMS) + 1):
            rest = " - ".join([f"c{i}{j}", *(f"l{i}{k} * l{j}{k}" for k in range(1, j))])
            out.append(f"sqrt(greatest({rest}, 1e-6D)) AS l{i}{j}" if i == j else f"({rest}) / l{j}{j} AS l{i}{j}")
    return [*out, f"2 * ({' + '.join(f'ln(l{i}{i})' for i in range(1, len(_DIMS) + 1))}) AS logdet"]


def _with_distance(rows: DataFrame, params: DataFrame, groups: int, *on: str) -> DataFrame:
    """``rows`` with ``d2``, the squared Mahalanobis distance in their group (null without one)."""
    on = on or ("group",)
    met = rows.join(scratch.small_side(params.select(*on, *_MEANS, *_FACTOR), groups), list(on), "left")
    solved = [f"({' - '.join([f'x{i} - m{i}', *(f'l{i}{k} * y{k}' for k in range(1, i))])}) / l{i}{i} AS y{i}" for i in range(1, len(_DIMS) + 1)]
    d2 = " + ".join(f"y{i} * y{i}" for i in range(1, len(_DIMS) + 1))
    return met.selectExpr(*(f"`{c}`" for c in rows.columns), *solved, f"{d2} AS d2").select(*rows.columns, "d2")


def _log_distance() -> Column:
    return F.log(F.greatest("d2", F.lit(1e-9)))


_MOMENTS = [
    "count(*) AS n", *(f"avg(x{i}) AS a{i}" for i in range(1, len(_DIMS) + 1)), *(f"covar_pop(x{i}, x{j}) AS s{i}{j}" for i, j in _PAIRS)
]


def _regularised(moments: DataFrame, above: DataFrame | None, prior: float, floor: float) -> DataFrame:
    """Location and scatter from the ``moments`` of rows and ``prior`` rows that have the
    location and scatter of the estimate ``above`` (a group's own is named by ``parent``)."""
    if above is None:
        names, own = [f"0.0D AS p{c}" for c in (*_MEANS, *_SCATTER)], "1.0D"
        met = moments.selectExpr("*", *names)
    else:
        names = above.selectExpr("group AS parent", *(f"{c} AS p{c}" for c in (*_MEANS, *_SCATTER)))
        met, own = moments.join(scratch.small_side(names), "parent"), f"n / (n + {float(prior)}D)"
    means = [f"own * a{i} + (1 - own) * pm{i} AS m{i}" for i in range(1, len(_DIMS) + 1)]
    # the scatter above has its floor already: what is added makes it whole
    mixed = [
        f"own * s{i}{j} + (1 - own) * pc{i}{j} + own * (1 - own) * (a{i} - pm{i}) * (a{j} - pm{j}){f' + own * {float(floor)}D' if i == j else ''} AS c{i}{j}"
        for i, j in _PAIRS
    ]
    return met.selectExpr("group", "start", "parent", f"{own} AS own", *means, *mixed, *_factors())


_STARTS = ("ranges", "tangents", "directions")


def _starts(rows: DataFrame, groups: int, floor: float) -> DataFrame:
    """``group, parent, start`` and estimates from which steps begin: medians with
    quartile ranges, and with those the correlations of hyperbolic tangents, and the
    scatter of directions from the median."""
    n = len(_DIMS)
    long = rows.selectExpr("group", "parent", f"stack({n}, {', '.join(f'{i}, x{i}' for i in range(1, n + 1))}) AS (dim, x)")
    spread = _quantiles(long, ["group", "parent", "dim"], F.col("x"), 1 / 256, {"low": 0.25, "mid": 0.5, "high": 0.75})
    dims = range(1, n + 1)
    middle = spread.groupBy("group", "parent").agg(
        *[F.expr(f"max(CASE WHEN dim = {i} THEN mid END) AS m{i}") for i in dims],
        *[F.expr(f"max(CASE WHEN dim = {i} THEN sqrt(power((high - low) / 1.349D, 2) + {float(floor)}D + 1e-9D) END) AS w{i}") for i in dims],
    )
    middle = scratch.table(middle, "medians")
    met = rows.select("group", *_DIMS).join(scratch.small_side(middle.drop("parent"), groups), "group")
    length = " + ".join(f"z{i} * z{i}" for i in dims)
    met = met.selectExpr(
        "group", *(f"(x{i} - m{i}) / w{i} AS z{i}" for i in dims), f"sqrt({length} + 1e-12D) AS length", *(f"tanh(z{i}) AS t{i}" for i in dims), *(f"z{i} / length AS u{i}" for i in dims)
    )
    sums = [F.expr(f"avg({k}{i} * {k}{j}) AS {k}{i}{j}") for k in "tu" for i, j in _PAIRS]
    shapes = middle.join(scratch.small_side(met.groupBy("group").agg(*sums), groups), "group")

    def start(name: str, kind: str | None) -> DataFrame:
        def entry(i: int, j: int) -> str:
            if i == j:
                return f"w{i} * w{i}"
            if kind is None:
                return "0.0D"
            spread = f"sqrt({kind}{i}{i} * {kind}{j}{j})"
            # shrunk a little, so that the factor exists
            return f"w{i} * w{j} * CASE WHEN {spread} > 1e-9D THEN 0.95D * {kind}{i}{j} / {spread} ELSE 0.0D END"

        return shapes.selectExpr("group", "parent", f"'{name}' AS start", *_MEANS, *(f"{entry(i, j)} AS c{i}{j}" for i, j in _PAIRS))

    every = reduce(DataFrame.unionByName, (start(name, kind) for name, kind in zip(_STARTS, (None, "t", "u"), strict=True)))
    return every.selectExpr("*", *_factors())


def estimate(
    rows: DataFrame, groups: int, above: DataFrame | None = None, subset: float = SUBSET, steps: int = STEPS, floor: float = FLOOR, prior: float = PRIOR
) -> DataFrame:
    """Minimum covariance determinant estimates of ``x1..x5`` by ``group`` (at most
    ``groups``; ``parent`` names the group of the estimates ``above`` on which it
    leans): location, scatter, its Cholesky factor and determinant, and ``scale``, by
    which squared distances are divided so that their median is that of the chi-square
    law (never below 1)."""
    keys = ["group", "start"]
    infinite, small = F.lit(float("inf")), 3 * groups <= scratch.rows_that_may_be_broadcast()
    now = scratch.table(_starts(rows, groups, floor).withColumn("logdet", infinite).withColumn("live", F.lit(True)), "scatter")
    for _ in range(steps):
        near = _with_distance(rows.withColumn("start", F.explode(F.array(*map(F.lit, _STARTS)))), now.where("live"), 3 * groups, *keys)
        near = near.where("d2 IS NOT NULL")
        bound = _quantiles(near, keys, _log_distance(), 1 / 64, {"bound": subset})
        inside = near.join(F.broadcast(bound) if small else bound, keys).where(_log_distance() <= F.col("bound") + 1 / 128)
        moved = _regularised(inside.groupBy(*keys, "parent").agg(*map(F.expr, _MOMENTS)), above, prior, floor)
        moved = moved.select(*keys, F.struct(*_SHAPE).alias("new"))
        # the least determinant of a start is kept; it ends where that falls no more
        met = now.join(F.broadcast(moved) if small else moved, keys, "left")
        falls, less = (F.coalesce(F.col("new.logdet") < F.col("logdet") - by, F.lit(False)) for by in (FALL, 0.0))
        best = F.when(less, F.col("new")).otherwise(F.struct(*_SHAPE)).alias("best")
        now = scratch.table(met.select(*keys, "parent", best, falls.alias("live")).select(*keys, "parent", "best.*", "live"), "scatter")
        scratch.let_go(rows.sparkSession)
        if now.where("live").isEmpty():
            break
    least = now.groupBy("group", "parent").agg(F.min_by(F.struct("start", *_SHAPE), F.struct("logdet", "start")).alias("best"))
    params = scratch.table(least.select("group", "parent", "best.*"), "least")
    middle = _quantiles(_with_distance(rows, params, groups), ["group"], _log_distance(), 1 / 64, {"middle": 0.5})
    scale = F.greatest(F.exp("middle") / _MEDIAN, F.lit(1.0)).alias("scale")
    return scratch.table(params.join(F.broadcast(middle.select("group", scale)) if small else middle.select("group", scale), "group"), "estimate")


def judge(docs: DataFrame, cutoff: float = CUTOFF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``distance`` and ``kept`` of every row.

    ``base_failed``: fewer than 50 words, or more than half of the words in repeated
    windows.  Documents that pass are the rows of the estimates; one of them goes
    if its squared distance in its language and source exceeds ``cutoff``.
    ``distance`` is null for failed rows.  Repeated rows and null ids stay; null
    languages and sources are groups of their own; an empty table gives an empty
    result.
    """
    rows = statistics(docs, id_col, text_col).select("*", *_vector())
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # a language, a source and all rows: keys that no value of another level can equal
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for c in ("lang", "source"))
    rows = rows.withColumns(
        {"base_failed": failed, "everything": F.lit("all"), "by_lang": F.to_json(F.struct(lang)), "group": F.to_json(F.struct(lang, source)), "none": F.lit("")}
    )
    rows = scratch.table(rows, "statistics")
    passed = rows.where("NOT base_failed")
    above = None
    for group, parent in (("everything", "none"), ("by_lang", "everything"), ("group", "by_lang")):
        level = passed.select(F.col(group).alias("group"), F.col(parent).alias("parent"), *_DIMS)
        groups = level.select("group").distinct().count()
        above = estimate(level, groups, above)
    met = _with_distance(rows, above, groups).join(scratch.small_side(above.select("group", "scale"), groups), "group", "left")
    distance = F.when(~F.col("base_failed"), F.col("d2") / F.col("scale"))
    return met.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", distance.alias("distance"),
        (~F.col("base_failed") & (F.coalesce(distance, F.lit(0.0)) <= cutoff)).alias("kept"),
    )
