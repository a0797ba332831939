"""Secret scans (operator 1): fixed patterns and sliding-window entropy, in DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The base patterns by kind.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}"  # a run of 18 or more from its first AKIA on
HEX = "[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")
SHORTEST_VALUE = 12

WINDOW, SHORTEST_RUN = 20, 12
CANDIDATE = f"[A-Za-z0-9+/_-]{{{SHORTEST_RUN},}}"
#: The same matches as by ASSIGN and CANDIDATE for the scan: a position where none can begin costs one look at a character.
SCAN_ASSIGN = f"(?=[PpSsTtAa]){ASSIGN}"
SCAN_CANDIDATE = f"(?<![A-Za-z0-9+/_-]){CANDIDATE}+"
SCALE = 1 << 20
#: c * log2(c) in units of 1 / SCALE for counts up to a window: whole numbers add up alike in any order.
WEIGHTS = [round(c * math.log2(c) * SCALE) if c else 0 for c in range(WINDOW + 1)]
#: Character classes, the first whose patterns all match counts: patterns, size of the alphabet, shortest run.
CLASSES = (
    (("^[0-9]+$",), 10, WINDOW),
    (("^([0-9a-f]+|[0-9A-F]+)$",), 16, SHORTEST_RUN),
    (("^([A-Z2-7]+|[a-z2-7]+)$",), 32, SHORTEST_RUN),
    (("^([0-9a-z]+|[0-9A-Z]+)$",), 36, SHORTEST_RUN),
    (("[a-z]", "[A-Z]", "[0-9]", "^[^/_+-]*([/_+-][^/_+-]+){0,3}[/_+-]?$"), 64, SHORTEST_RUN),
)
OTHER_BITS = 4.0  # a window of runs of no class, such as paths and words joined by marks
SPREAD = 2.0  # standard deviations below the expected entropy of a window of random letters


def random_bits(letters: int, n: int) -> tuple[float, float]:
    """Mean and standard deviation of the entropy of ``n`` characters drawn at random from an alphabet of so many letters."""
    share = 1 / letters
    weight = [c * math.log2(c) if c else 0.0 for c in range(n + 1)]
    mean = letters * sum(math.comb(n, c) * share**c * (1 - share) ** (n - c) * weight[c] for c in range(2, n + 1))
    square = letters * sum(math.comb(n, c) * share**c * (1 - share) ** (n - c) * weight[c] ** 2 for c in range(2, n + 1))
    square += letters * (letters - 1) * sum(
        math.comb(n, c) * math.comb(n - c, d) * share ** (c + d) * (1 - 2 * share) ** (n - c - d) * weight[c] * weight[d] for c in range(2, n + 1) for d in range(2, n - c + 1)
    )
    return math.log2(n) - mean / n, math.sqrt(max(square - mean * mean, 0.0)) / n


def most_weight(bits: float, n: int = WINDOW) -> int:
    """The largest sum of weights of a window of ``n`` characters with at least so many bits of entropy."""
    return math.floor((math.log2(n) - bits) * n * SCALE)


def most_weights(letters: int, shortest: int) -> list[int]:
    """Largest sums of weights of windows of 0 to ``WINDOW`` characters of a class; -1 where no window is short enough."""
    sums = [-1] * shortest
    for n in range(shortest, WINDOW + 1):
        mean, deviation = random_bits(letters, n)
        sums.append(most_weight(mean - SPREAD * deviation, n))
    return sums


#: By class, the last for runs of none: largest sums of weights by length of the window.
MOST = [most_weights(letters, shortest) for _, letters, shortest in CLASSES] + [[-1] * WINDOW + [most_weight(OTHER_BITS)]]
#: Candidates that are no secrets: words, identifiers of words, runs of the alphabet, placeholders, UUIDs.
ALLOWED = (
    "^[A-Z]?[a-z]+$",
    "^[A-Z]+$",
    "^[A-Za-z]?[a-z]*([_/-][A-Za-z]?[a-z]*)+$",
    "(?i)example|placeholder|changeme|your_?key",
    "(?i)abcdefghij|0123456789",
    "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
)


def least_window_weight(run: Column) -> Column:
    """Smallest sum of c * log2(c) over all windows of an ASCII string: the window of highest entropy; a shorter string is one window.

    The window moves by one character at a time; how often the character that enters and the
    one that leaves stand in it is counted there, and the sum follows.
    """
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("long").alias("least"))
    at = lambda i, n: F.substring(run, i, n)
    times = lambda window, char: F.length(window) - F.length(F.replace(window, char, F.lit("")))

    def step(state: Column, i: Column) -> Column:
        full = i > WINDOW
        leaves = F.when(full, F.get(weights, times(at(i - WINDOW, F.lit(WINDOW)), at(i - WINDOW, F.lit(1)))) - F.get(weights, times(at(i - WINDOW, F.lit(WINDOW)), at(i - WINDOW, F.lit(1))) - 1)).otherwise(0)
        has = times(F.when(full, at(i - (WINDOW - 1), F.lit(WINDOW - 1))).otherwise(at(F.lit(1), i - 1)), at(i, F.lit(1)))
        total = (state["sum"] - leaves - F.get(weights, has) + F.get(weights, has + 1)).cast("long")
        return F.struct(total.alias("sum"), F.when(i >= F.least(F.length(run), F.lit(WINDOW)), F.least(state["least"], total)).alias("least"))

    return F.aggregate(F.sequence(F.lit(1), F.length(run)), start, step, lambda state: state["least"])


def _found(text: Column, kind: int, pattern: str) -> Column:
    """Matches of one kind in order: the characters since the last one, its length, its value and text where they matter.

    Texts are cut and searched once each: what a lambda names would be made again for every match.
    """
    gaps = F.transform(F.split(text, pattern, -1), F.length)  # one more than there are matches
    zipped = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), gaps, lambda m, gap: F.struct(m.alias("m"), gap.alias("gap")))
    if kind == 0:
        sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), F.length)
        zipped = F.zip_with(zipped, sizes, lambda z, v: F.struct(z["m"].alias("m"), z["gap"].alias("gap"), v.alias("value")))
    matches = F.transform(
        F.filter(zipped, lambda z: z["m"].isNotNull()),
        lambda z, i: F.struct(
            F.lit(kind).alias("kind"),
            i.alias("i"),
            z["gap"].alias("gap"),
            F.length(z["m"]).alias("size"),
            (z["value"] if kind == 0 else F.lit(0)).alias("value"),
            (z["m"] if kind == 3 else F.lit(None).cast("string")).alias("run"),
        ),
    )
    return F.when(text.rlike(pattern), matches)


def scan_secrets(docs: DataFrame, allowed: Sequence[str] = ALLOWED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans) of every whole text.

    Base spans are the leftmost non-overlapping matches of each base pattern. Entropy spans
    are maximal runs of key characters of twelve or more in which some window of twenty (the
    whole run if it is shorter) has an entropy of at most two standard deviations below that
    of random characters of the run's class: digits (from twenty on), hexadecimal digits,
    base 32, base 36, base 64; runs of no class count from twenty characters and 4.0 bits on.
    A run that an ``allowed`` pattern matches does not count. ``spans`` lists kind:start:end (code
    points, end exclusive) by start, then kind as in ``KINDS``; ``base_sha256`` is the hash
    of that list without entropy spans.

    Texts never leave the scan: only lengths and candidate runs are shuffled, by row. Null
    texts count as empty and have no spans; repeated rows and null ids each get a row; an
    empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    patterns = (SCAN_ASSIGN, ACCESS, HEX, SCAN_CANDIDATE)
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,size:int,value:int,run:string>>")
    found = F.concat(*[F.coalesce(_found(F.col("text"), k, p), none) for k, p in enumerate(patterns)])
    matches = rows.select("row", "doc_id", F.inline_outer(found)).repartition("row")
    so_far = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = matches.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far).cast("long"))
    suspect = F.col("run").isNotNull()
    for pattern in allowed:
        suspect = suspect & ~F.col("run").rlike(pattern)
    width = F.least(F.length("run"), F.lit(WINDOW))
    limit = F.get(F.array(*map(F.lit, MOST[-1])), width)
    for (patterns, *_), sums in reversed(list(zip(CLASSES, MOST))):
        fits = F.lit(True)
        for pattern in patterns:
            fits = fits & F.col("run").rlike(pattern)
        limit = F.when(fits, F.get(F.array(*map(F.lit, sums)), width)).otherwise(limit)
    kept = (F.col("kind").isin(1, 2)) | ((F.col("kind") == 0) & (F.col("value") >= SHORTEST_VALUE)) | ((F.col("kind") == 3) & F.when(suspect, least_window_weight(F.col("run")) <= limit).otherwise(False))
    span = F.struct((F.col("end") - F.col("size")).alias("start"), "kind", "end")
    listed = placed.withColumn("kept", F.coalesce(kept, F.lit(False))).groupBy("row", "doc_id").agg(
        *[F.count_if(F.col("kept") & (F.col("kind") == k)).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sort_array(F.collect_list(F.when(F.col("kept"), span))).alias("found"),
    )

    def text_of(spans: Column) -> Column:
        names = F.array(*[F.lit(k) for k in KINDS])
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])))

    base = text_of(F.filter("found", lambda s: s["kind"] < 3))
    return listed.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(base, 256).alias("base_sha256"), text_of(F.col("found")).alias("spans"))


def _sql_literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def scan_sql(allowed: Sequence[str] = ALLOWED) -> str:
    """The same result in DuckDB SQL over ``documents``."""
    patterns = (ASSIGN, ACCESS, HEX, CANDIDATE)
    kinds = " UNION ALL ".join(
        f"""SELECT doc_id, {k} AS kind, unnest(generate_series(1, len(m))) AS i, unnest(m) AS run, unnest(g[:len(m)]) AS gap, unnest(v) AS val
            FROM (SELECT doc_id, regexp_extract_all(text, {_sql_literal(p)}) AS m, string_split_regex(text, {_sql_literal(p)}) AS g, {f"regexp_extract_all(text, {_sql_literal(p)}, 2)" if k == 0 else f"regexp_extract_all(text, {_sql_literal(p)})"} AS v FROM d)"""
        for k, p in enumerate(patterns)
    )
    weights = "[" + ", ".join(map(str, WEIGHTS)) + "]"
    width = f"CAST(least(length(run), {WINDOW}) AS BIGINT)"
    limits = "CASE " + " ".join(
        f"WHEN {' AND '.join(f'regexp_matches(run, {_sql_literal(p)})' for p in patterns)} THEN {sums}[{width} + 1]" for (patterns, *_), sums in zip(CLASSES, MOST)
    ) + f" ELSE {MOST[-1]}[{width} + 1] END"
    banned = " AND ".join(f"NOT regexp_matches(run, {_sql_literal(p)})" for p in allowed)
    names = "['" + "', '".join(KINDS) + "']"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
hits AS ({kinds}),
placed AS (
  SELECT doc_id, kind, i, run, val, sum(length(gap) + length(run)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM hits),
suspects AS (SELECT DISTINCT run FROM placed WHERE kind = 3 AND {banned}),
letters AS (
  SELECT run, pos, substr(substr(run, CAST(pos AS BIGINT), {WINDOW}), CAST(k AS BIGINT), 1) AS c
  FROM (SELECT run, unnest(generate_series(1, greatest(length(run) - {WINDOW - 1}, 1))) AS pos FROM suspects), generate_series(1, {WINDOW}) AS s(k)
  WHERE k <= length(run)),
sums AS (SELECT run, pos, sum({weights}[n + 1]) AS total FROM (SELECT run, pos, c, count(*) AS n FROM letters GROUP BY run, pos, c) GROUP BY run, pos),
hot AS (
  SELECT run FROM sums GROUP BY run
  HAVING min(total) <= {limits}),
kept AS (
  SELECT doc_id, kind, stop - length(run) AS start, stop FROM placed
  WHERE kind IN (1, 2) OR (kind = 0 AND length(val) >= {SHORTEST_VALUE}) OR (kind = 3 AND run IN (SELECT run FROM hot)))
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_entropy,
  sha256(coalesce(string_agg({names}[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256,
  coalesce(string_agg({names}[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind), '') AS spans
FROM d LEFT JOIN kept USING (doc_id) GROUP BY d.doc_id"""
