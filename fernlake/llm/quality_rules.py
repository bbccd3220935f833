"""Quality rules by robust multivariate outliers, with DataFrame functions only.

Each document has counts of words, word characters, symbols, duplicate lines and
words in repeated three-word windows.  Documents that fail a base rule (few
words, or mostly repeated ones) go; of the others the logarithms of the length
and the rates form a vector.  For each language and source the
minimum-covariance-determinant estimate of its location and scatter is found by
concentration steps from a start of medians, and vectors of large Mahalanobis
distance go.

Vectors are integers (units of 1/SCALE), so sums are exact and the result does
not depend on the order of the work; distances are put into bins (64 per unit of
the logarithm) to find the nearest part of a group by counting, without sorting
a group or bringing it together.  Each coordinate's variance has a floor, so a
group where it is constant does no harm.  Sources with fewer than LEAST vectors
are pooled by language, languages so pooled with fewer are pooled together.

Null texts have no words.  Null languages and sources are groups of their own.
Repeated rows count each, and get equal results.  Columns other than doc_id,
text, lang and source are not read; if lang or source is missing it is null.
An empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fernlake.llm.common import materialise

SCALE = 1024
#: Coordinates: log words, log word length, log1p rates of symbols, duplicate lines and repeated words.
DIMENSIONS = 5
#: Least standard deviation of each coordinate.  One repeated line in a short clean text puts the
#: last two, which are constant in most groups, at 2.5 to 3.2; symbols have no such cause.
FLOORS = (0.3, 0.05, 0.25, 0.85, 0.85)
LEAST = 200
#: Part of a group that the estimate rests on, and concentration steps.
PART = 0.75
STEPS = 4
#: Median of chi-square with five degrees of freedom, and its 0.999 quantile, the squared distance beyond which vectors go.
CHI_MEDIAN = 4.3515
CUT = 20.515
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, lang, source and the base statistics of each document."""
    have = {c.lower() for c in docs.columns}
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *((F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in ("lang", "source")),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"),
    )
    base = base.select(
        "doc_id", "lang", "source",
        F.array_remove(F.split("t", "[ \\t\\n\\x0B\\f\\r]+"), "").alias("w"),
        F.filter(F.split("t", "\n"), lambda line: F.trim(line, F.lit(SPACE)) != "").alias("lines"),
        F.length(F.translate("t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    hashed = F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    base = base.select(
        "doc_id", "lang", "source", "word_chars", "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        hashed.alias("g"),
    )
    repeats = F.when(F.size(F.array_distinct("g")) < F.size("g"), covered(F.col("g"))).otherwise(F.lit(0))
    return base.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeats.cast("long").alias("n_repeat_words"))


def covered(windows: Column) -> Column:
    """Words in three-word windows whose value stands twice or more: sorted with their places, equal neighbours are repeats."""
    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        def repeated(x: Column, j: Column) -> Column:
            return (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"])

        return F.transform(F.filter(s, lambda x, j: F.coalesce(repeated(x, j), (F.get(s, j - 1)["h"] == x["h"]), (F.get(s, j + 1)["h"] == x["h"]), F.lit(False))), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))

    # The one-element array binds the sorted windows, so they are sorted once.
    return F.size(F.array_distinct(F.flatten(F.get(F.transform(F.array(ordered), places), F.lit(0)))))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector() -> list[Column]:
    n = F.col("n_words").cast("double")
    parts = [F.log(n), F.log(F.col("word_chars") / n), F.log1p(100 * F.col("n_symbols") / n), F.log1p(1000 * F.col("n_dup_lines") / n), F.log1p(100 * F.col("n_repeat_words") / n)]
    return [F.round(p * SCALE).cast("long").alias(f"x{i}") for i, p in enumerate(parts)]


def pooled(vectors: DataFrame) -> DataFrame:
    """Adds g, the group whose estimate a vector is held against."""
    key = F.struct("lang", "source")
    sizes = vectors.groupBy("lang", "source").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("g", F.when(F.col("n") >= LEAST, F.concat(F.lit("s"), F.to_json(key))).otherwise(F.concat(F.lit("l"), F.to_json(F.struct("lang")))))
    small = sizes.where(F.col("n") < LEAST).groupBy("g").agg(F.sum("n").alias("all")).where(F.col("all") < LEAST).select("g", F.lit("rest").alias("pool"))
    groups = materialise(sizes.join(small, "g", "left").select(F.col("lang").alias("lang_"), F.col("source").alias("source_"), F.coalesce("pool", "g").alias("g")), "groups")
    return vectors.join(groups, F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_"))).drop("lang_", "source_")


def nearest(binned: DataFrame, part: float, value: str = "bin") -> DataFrame:
    """g and the least bin that, with those below it, holds at least the given part of the group's rows."""
    per_bin = binned.groupBy("g", value).agg(F.count("*").alias("n"))
    # A group has some thousand bins at most, whatever its rows.
    listed = per_bin.groupBy("g").agg(F.sum("n").alias("all"), F.array_sort(F.collect_list(F.struct(F.col(value).alias("b"), "n"))).alias("bins"))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("cut"))

    def step(acc: Column, x: Column) -> Column:
        seen = acc["seen"] + x["n"]
        return F.struct(seen.alias("seen"), F.coalesce(acc["cut"], F.when(seen >= F.ceil(F.lit(part) * F.col("all")), x["b"].cast("long"))).alias("cut"))

    # Written, so that its size is known and rows meet it without being dealt out by group.
    return materialise(listed.select("g", F.aggregate("bins", start, step)["cut"].alias("cut")), "cuts")


def start(vectors: DataFrame) -> DataFrame:
    """g, m0.. (medians) and a00.. (inverse deviations on the diagonal) to begin with."""
    long = vectors.select(F.col("g").alias("own"), F.posexplode(F.array(*[F.col(f"x{i}") for i in range(DIMENSIONS)])).alias("i", "x"))
    long = long.select("own", "i", "x", F.to_json(F.struct("own", "i")).alias("g"), F.floor(F.col("x") / 16).alias("bin"))
    middle = nearest(long, 0.5).withColumnRenamed("cut", "median")
    spread = nearest(long.join(middle, "g").select("g", F.floor(F.abs(F.col("bin") - F.col("median"))).alias("bin")), 0.5)
    both = middle.join(spread, "g").select(F.get_json_object("g", "$.own").alias("g"), F.get_json_object("g", "$.i").cast("int").alias("i"), (F.col("median") * 16.0 + 8).alias("m"), F.col("cut").alias("d"))
    columns = []
    for i, floor in enumerate(FLOORS):
        own = F.when(F.col("i") == i, F.col("m"))
        columns.append(F.max(own).alias(f"m{i}"))
        deviation = F.greatest(F.col("d") * 16 * 1.4826, F.lit(floor * SCALE))
        columns += [F.max(F.when(F.col("i") == i, 1 / deviation)).alias(f"a{i}{i}")] + [F.lit(0.0).alias(f"a{i}{j}") for j in range(i)]
    return both.groupBy("g").agg(*columns)


def distance() -> Column:
    """Squared Mahalanobis distance: the length of the inverse Cholesky factor times the centred vector."""
    total = F.lit(0.0)
    for i in range(DIMENSIONS):
        z = sum((F.col(f"a{i}{j}") * (F.col(f"x{j}") - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0))
        total = total + z * z
    return total


def estimate(vectors: DataFrame) -> DataFrame:
    """Location and inverse Cholesky factor of each group's rows, from exact integer sums."""
    p = range(DIMENSIONS)
    pairs = [(i, j) for i in p for j in range(i + 1)]
    sums = vectors.groupBy("g").agg(F.count("*").alias("n"), *[F.sum(F.col(f"x{i}").cast("decimal(12,0)")).cast("double").alias(f"s{i}") for i in p], *[F.sum((F.col(f"x{i}") * F.col(f"x{j}")).cast("decimal(20,0)")).cast("double").alias(f"q{i}{j}") for i, j in pairs])
    out = sums.select("g", *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in p], *[((F.col(f"q{i}{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n")) / F.col("n") + F.lit((FLOORS[i] * SCALE) ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in pairs])
    for i in p:  # Cholesky factor l, then its inverse a, a column at a time
        for j in range(i):
            out = out.withColumn(f"l{i}{j}", (F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l{j}{j}"))
        out = out.withColumn(f"l{i}{i}", F.sqrt(F.col(f"c{i}{i}") - sum((F.col(f"l{i}{k}") * F.col(f"l{i}{k}") for k in range(i)), F.lit(0.0))))
    for i in p:
        for j in range(i):
            out = out.withColumn(f"a{i}{j}", -sum((F.col(f"l{i}{k}") * F.col(f"a{k}{j}") for k in range(j, i)), F.lit(0.0)) / F.col(f"l{i}{i}"))
        out = out.withColumn(f"a{i}{i}", 1 / F.col(f"l{i}{i}"))
    return out.select("g", *[f"m{i}" for i in p], *[f"a{i}{j}" for i, j in pairs])


def binned(vectors: DataFrame, parameters: DataFrame) -> DataFrame:
    return vectors.join(parameters, "g").withColumn("d", distance()).withColumn("bin", F.floor(64 * F.log1p("d")))


def mcd(vectors: DataFrame, part: float = PART, steps: int = STEPS) -> DataFrame:
    """Parameters of each group after the concentration steps, scaled so that the median distance is that of chi-square."""
    own = [f"x{i}" for i in range(DIMENSIONS)]
    parameters = materialise(start(vectors), "mcd")
    for _ in range(steps):
        placed = binned(vectors, parameters).select("g", "bin", *own)
        near = placed.join(nearest(placed, part), "g").where("bin <= cut")
        parameters = materialise(estimate(near), "mcd")
    middle = nearest(binned(vectors, parameters).select("g", "bin"), 0.5)
    scaled = parameters.join(middle, "g").withColumn("scale", F.greatest(F.exp((F.col("cut") + 0.5) / 64) - 1, F.lit(1e-3)) / CHI_MEDIAN)
    return materialise(scaled.drop("cut"), "mcd")


def judged(docs: DataFrame, text: str = "text", cut: float = CUT) -> DataFrame:
    """doc_id, the base statistics, base_failed, distance (null if not judged) and kept."""
    stats = materialise(counts(docs, text).withColumn("base_failed", base_failed()), "statistics")
    fit = pooled(stats.where("not base_failed").select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *vector()))
    fit = materialise(fit, "vectors")
    distances = binned(fit, mcd(fit)).withColumn("distance", F.col("d") / F.greatest("scale", F.lit(1.0)))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    good = distances.select(*columns, "distance", (F.col("distance") <= cut).alias("kept"))
    bad = stats.where("base_failed").select(*columns, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return good.union(bad)
