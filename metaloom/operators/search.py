"""Page index and ranked retrieval.

The index is three tables: postings (path, token, tf), lengths (path, dl) and the term
statistics derived from them. Two retrieval modes share the scoring:

* whole-corpus search of one query (exact; ranks are computed with a distributed sort);
* bounded search of many queries at once (at most ``CANDIDATE_LIMIT`` candidates per query,
  read rare terms first), which is how queries are served.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..constants import (
    BM25_B, BM25_K1, CANDIDATE_LIMIT, CHANNEL_WEIGHTS, DENSE_FLOOR, FACET_ALIASES, GOVERNED_FACETS,
    MODEL_TYPES, RRF_OFFSET, UNTRUSTED,
)
from ..functions import text as T
from ..functions.vectors import concept_slots
from ..functions.words import word_counts
from ..scale import BROADCAST_BYTES, SALTS, cut_lineage, estimated_bytes, global_rank, maybe_broadcast, salted_join, top_per_group

IDENTIFIER = re.compile(r"[A-Za-z][A-Za-z0-9]*(?:[_:.][A-Za-z0-9]+)+")


# ----------------------------------------------------------------------------- index tables
def indexable(pages: DataFrame) -> DataFrame:
    """Inferred and candidate identities never enter an index."""
    return pages.where(~F.col("identity_status").isin(*UNTRUSTED))


def index_text(pages: DataFrame) -> Column:
    """Name, summaries and, where pages have them, aliases."""
    return F.concat_ws(" ", "name", "l0", "l1", *["aliases"] * ("aliases" in pages.columns))


def bears_name(pages: DataFrame, test) -> Column:
    """Whether ``test`` holds for the folded name, canonical id or, where pages have them, an alias."""
    named = test(F.lower(F.trim("name"))) | test(F.lower(F.trim("canonical_id")))
    if "aliases" in pages.columns:
        named = named | F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: test(F.lower(F.trim(a))))
    return named


def page_tokens(pages: DataFrame) -> DataFrame:
    return indexable(pages).select("path", T.tokens(index_text(pages)).alias("toks"))


def page_counts(pages: DataFrame) -> DataFrame:
    """(path, counts, dl): every page with its counted words; ``body`` tells whether the long text has one."""
    short = F.concat_ws(" ", *[c for c in ("name", "l0") if c in pages.columns], *["aliases"] * ("aliases" in pages.columns))
    return word_counts(indexable(pages), ["path"], short, F.col("l1"))


def counted_postings(counted: DataFrame) -> DataFrame:
    return counted.select("path", F.inline("counts")).select("path", "token", "tf")


def postings(pages: DataFrame) -> DataFrame:
    """(path, token, tf); a page is one row, so its tokens are counted inside it and nothing is shuffled."""
    return counted_postings(page_counts(pages))


def doc_lengths(pages: DataFrame) -> DataFrame:
    return page_counts(pages).select("path", "dl")


def term_stats(posts: DataFrame) -> DataFrame:
    return posts.groupBy("token").agg(F.count("*").alias("df"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: number of indexed documents and mean length (1 when empty)."""
    return lengths.agg(
        F.count("*").alias("n"),
        F.sum("dl").alias("total_length"),
        F.coalesce(F.nullif(F.sum("dl") / F.greatest(F.lit(1), F.count("*")), F.lit(0.0)), F.lit(1.0)).alias("avgdl"),
    )


@dataclass(frozen=True)
class PageIndex:
    """Index tables of a page corpus; build once, then search many times."""

    pages: DataFrame
    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    stats: DataFrame
    counted: DataFrame | None = None  # (path, counts, dl), a row a page


def build_index(pages: DataFrame, materialize: bool = True) -> PageIndex:
    """Tokenize once. The postings are written to the checkpoint folder unless told otherwise."""
    counted = page_counts(pages)
    if materialize:
        counted = cut_lineage(counted)
    posts = counted_postings(counted)
    lengths = posts.groupBy("path").agg(F.sum("tf").alias("dl"))
    n = indexable(pages).agg(F.count("*").alias("n")).scalar()
    stats = posts.agg(F.sum("tf").alias("total_length")).select(
        n.alias("n"),
        "total_length",
        F.coalesce(F.nullif(F.col("total_length") / F.greatest(F.lit(1), n), F.lit(0.0)), F.lit(1.0)).alias("avgdl"),
    )
    return PageIndex(pages, posts, lengths, term_stats(posts), stats, counted)


# ----------------------------------------------------------------------------- filters
def facet_of(name: str) -> str:
    return FACET_ALIASES.get(name, name)


def facet_matches(pages: DataFrame, facet: str, expected: str) -> Column:
    """Whether a page's facet, or a member of a list-valued one, equals the expected text; false where it is absent."""
    target = (expected or "").strip().lower()
    if not target or facet not in pages.columns:
        return F.lit(False)
    equal = lambda v: F.lower(F.trim(v.cast("string"))) == target
    found = F.exists(facet, equal) if isinstance(pages.schema[facet].dataType, ArrayType) else equal(F.col(facet))
    return F.coalesce(found, F.lit(False))


def eligible_pages(pages: DataFrame, types=None, scope=None) -> DataFrame:
    """Kind membership; governed facets are hard filters for models only."""
    kept = indexable(pages)
    if types:
        kept = kept.where(F.col("context_type").isin(*types))
    for key, value in (scope or {}).items():
        facet = facet_of(key)
        if facet in GOVERNED_FACETS:
            kept = kept.where(~F.col("context_type").isin(*MODEL_TYPES) | facet_matches(pages, facet, value))
    return kept


def query_tokens(query: str) -> list[str]:
    """Tokens of one query string given by the caller, by the tokenizer of the pages."""
    return SparkSession.active().range(1).select(T.tokens(F.lit(query))).first()[0]


def named_phrases(query: str) -> list[str]:
    """Every part of the query that stands between non-word borders."""
    q = query.lower().strip()
    word = [bool(re.match(r"\w", ch)) for ch in q]
    starts = [i for i in range(len(q)) if i == 0 or not word[i - 1]]
    ends = [i for i in range(1, len(q) + 1) if i == len(q) or not word[i]]
    return sorted({q[s:e].strip() for s in starts for e in ends if e > s} - {""})


def identifier_gate(pages: DataFrame, query: str, scope=None) -> DataFrame:
    """When a symbol is asked for, keep pages that contain it, bear it, or are named in the query."""
    symbol = (scope or {}).get("symbol")
    if not symbol and IDENTIFIER.fullmatch(query.strip()):
        symbol = query.strip()
    if not symbol:
        return pages
    token = str(symbol).lower()
    phrases = [token, *named_phrases(query)]
    # Only texts that hold the symbol as a stretch of characters are cut into words.
    holds = F.contains(F.lower(index_text(pages)), F.lit(token)) & F.array_contains(T.tokens(index_text(pages)), token)
    return pages.where(holds | bears_name(pages, lambda n: n.isin(*phrases)))


# ----------------------------------------------------------------------------- one-query channels
SCORE_DIGITS = 9  # distributed sums have no fixed order; rounding keeps equal texts exactly tied


def query_scan(pages: DataFrame, words: list[str]) -> DataFrame:
    """One pass over the texts: (path, dl, found), keeping only the query's words of each page."""
    base = indexable(pages).select("path", T.tokens(index_text(pages)).alias("toks"))
    return cut_lineage(
        base.select("path", F.size("toks").cast("long").alias("dl"), F.filter("toks", lambda x: x.isin(*words)).alias("found"))
    )


def query_hits(scan: DataFrame) -> DataFrame:
    """(path, dl, token, tf) of the scanned words."""
    found = scan.select("path", "dl", F.explode("found").alias("token"))
    return found.groupBy("path", "dl", "token").agg(F.count("*").alias("tf"))


def bm25_expr(n: Column, df: Column, tf: Column, dl: Column, avgdl: Column) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * (tf * (BM25_K1 + 1)) / (tf + BM25_K1 * ((1 - BM25_B) + BM25_B * dl / avgdl))


def bm25_channel(pages: DataFrame, query: str, eligible: DataFrame | None = None) -> DataFrame:
    """(path, score); statistics come from the whole index, not from the filtered pages."""
    words = sorted(set(query_tokens(query)))
    scan = query_scan(pages, words)
    hits, stats = query_hits(scan), corpus_stats(scan)
    dfs = hits.groupBy("token").agg(F.count("*").alias("df"))  # at most one row per query word
    scored = hits.join(F.broadcast(dfs), "token").withColumn(
        "part",
        bm25_expr(stats.select("n").scalar(), F.col("df"), F.col("tf"), F.col("dl"), stats.select("avgdl").scalar()),
    )
    result = scored.groupBy("path").agg(F.round(F.sum("part"), SCORE_DIGITS).alias("score"))
    if eligible is not None:
        result = result.join(eligible.select("path"), "path", "left_semi")
    return result


def exact_channel(eligible: DataFrame, query: str) -> DataFrame:
    phrases = named_phrases(query)
    return eligible.where(bears_name(eligible, lambda n: n.isin(*phrases))).select("path", F.lit(1.0).alias("score"))


def facet_channel(eligible: DataFrame, scope: dict | None, prior: float = 0.0) -> DataFrame:
    total = F.lit(float(prior))
    for key, value in (scope or {}).items():
        facet = facet_of(key)
        if facet in eligible.columns:
            total = total + facet_matches(eligible, facet, value).cast("double")
    return eligible.select("path", total.alias("score")).where(F.col("score") > 0)


def concept_channel(eligible: DataFrame, query: str) -> DataFrame:
    """Cosine over sparse concept slots; only slots the query uses leave the scan."""
    spark = eligible.sparkSession
    one = spark.createDataFrame([("q", query)], "k string, t string")
    asked = concept_slots(one, "k", "t").select("slot", F.col("w").alias("qw"))
    slots = concept_slots(eligible.select("path", F.concat_ws("\n", "l0", "l1").alias("t")), "path", "t")
    lengths = slots.groupBy("path").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = slots.join(F.broadcast(asked), "slot").groupBy("path").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
    qnorm = asked.agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn")).scalar()
    return (
        dots.join(lengths, "path")
        .select("path", F.round(F.col("dot") / (F.col("norm") * qnorm), SCORE_DIGITS).alias("score"))
        .where(F.col("score") >= DENSE_FLOOR)
    )


# ----------------------------------------------------------------------------- rank fusion
def fuse_channels(channels: dict[str, DataFrame], weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted reciprocal-rank fusion over whole-corpus channels: (path, score, channels)."""
    weights = weights or CHANNEL_WEIGHTS
    rows = None
    for name, frame in channels.items():
        part = frame.where(F.col("score") > 0).select("path", F.lit(name).alias("channel"), F.col("score").alias("raw"))
        rows = part if rows is None else rows.unionByName(part)
    ranked = global_rank(rows, ["channel"], [F.desc("raw"), F.asc("path")])
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return ranked.groupBy("path").agg(
        F.round(F.sum(F.try_element_at(weight, F.col("channel")) / (RRF_OFFSET + F.col("rank"))), 12).alias("score"),
        F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"),  # at most four names
    )


def hybrid_search(pages: DataFrame, query: str, types=None, scope=None, top_k: int = 8, vectors: bool = True) -> DataFrame:
    """Whole-corpus hybrid search of one query."""
    if top_k < 1:
        raise ValueError("top_k must be positive")
    eligible = identifier_gate(eligible_pages(pages, types, scope), query, scope)
    channels = {
        "exact": exact_channel(eligible, query),
        "bm25": bm25_channel(pages, query, eligible),
        "facet": facet_channel(eligible, scope),
    }
    if vectors:
        channels["dense"] = concept_channel(eligible, query)
    fused = fuse_channels(channels)
    return fused.orderBy(F.desc("score"), F.asc("path")).limit(top_k)


def baseline_search(pages: DataFrame, query: str, types=None, scope=None, top_k: int = 8) -> DataFrame:
    """Lexical baseline: repeated query words count again; exact and facet matches add fixed amounts."""
    counts = Counter(query_tokens(query))
    scope = scope or {}
    eligible = eligible_pages(pages, types, scope)
    words = sorted(counts)
    scan = query_scan(pages, words)
    hits = query_hits(scan)
    n = corpus_stats(scan).select(F.greatest(F.lit(1), F.col("n"))).scalar()
    dfs = hits.groupBy("token").agg(F.count("*").alias("df"))  # at most one row per query word
    times = F.create_map(*[F.lit(x) for kv in counts.items() for x in kv])
    lexical = (
        hits.join(F.broadcast(dfs), "token")
        .groupBy("path")
        .agg(
            F.sum(
                F.try_element_at(times, F.col("token")) * (1 + F.log("tf")) * (F.log((n + 1) / (1 + F.col("df"))) + 1)
            ).alias("lexical")
        )
    )
    whole = query.lower().strip()
    named = bears_name(pages, lambda n: n == whole) | (F.lower("path") == whole)
    bonus = F.when(named, F.lit(15.0)).otherwise(F.lit(0.0))
    for key, value in scope.items():
        facet = facet_of(key)
        if facet in GOVERNED_FACETS:
            bonus = bonus + F.when(facet_matches(pages, facet, value), F.lit(3.0)).otherwise(F.lit(0.0))
        else:
            inside = F.contains(F.lower("l1"), F.lit(str(value).lower()))
            bonus = bonus + F.when(facet_matches(pages, facet, value) | inside, F.lit(1.5)).otherwise(F.lit(0.0))
    return (
        eligible.select("path", bonus.alias("bonus"))
        .join(lexical, "path", "left")
        .select("path", F.round(F.col("bonus") + F.coalesce("lexical", F.lit(0.0)), SCORE_DIGITS).alias("score"))
        .where(F.col("score") > 0)
        .orderBy(F.desc("score"), F.asc("path"))
        .limit(top_k)
    )


# ----------------------------------------------------------------------------- bounded, many queries
def posting_heads(posts: DataFrame, limit: int = CANDIDATE_LIMIT) -> DataFrame:
    """First ``limit`` paths of each term's posting list; no query can ever read more of one list."""
    return top_per_group(posts.select("token", "path"), ["token"], [F.asc("path")], limit, "pos").drop("pos")


def wanted_postings(posts: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """Postings of the words that some query asks for."""
    return posts.join(maybe_broadcast(asked.select(*keys).distinct()), keys, "left_semi")


def query_words(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("token"))


def bounded_candidates(index: PageIndex, queries: DataFrame, limit: int = CANDIDATE_LIMIT, allowed: DataFrame | None = None) -> DataFrame:
    """Candidates read rare-term-first under one read budget per query.

    Reads rejected by ``allowed`` (query_id, path) still use budget; a path read twice keeps
    its first position.
    """
    asked = cut_lineage(salted_join(query_words(queries), index.terms, ["token"], ["query_id"]))
    # A list longer than the budget can never be read past it, so its head is enough.
    reads = salted_join(asked, posting_heads(wanted_postings(index.postings, asked, ["token"]), limit), ["token"], ["query_id"])
    w = Window.partitionBy("query_id").orderBy("df", "token", "path")
    reads = reads.withColumn("read", F.row_number().over(w)).where(F.col("read") <= limit)
    if allowed is not None:
        reads = reads.join(allowed, ["query_id", "path"], "left_semi")
    return reads.groupBy("query_id", "path").agg(F.min("read").cast("long").alias("first_read"))


def fill_candidates(recalled: DataFrame, queries: DataFrame, pages: DataFrame, limit: int = CANDIDATE_LIMIT) -> DataFrame:
    """Top up short candidate lists with the first indexed paths (at most ``limit`` of them)."""
    head = indexable(pages).select("path").orderBy("path").limit(limit)
    head = head.withColumn("pos", F.row_number().over(Window.orderBy("path")))
    filler = head.agg(F.array_sort(F.collect_list(F.struct("pos", "path"))).alias("filler"))  # <= limit members
    extra = queries.select("query_id").withColumn("filler", filler.scalar())
    extra = extra.select("query_id", F.explode("filler").alias("f")).select(
        "query_id", F.col("f.path").alias("path"), (F.col("f.pos") + limit).cast("long").alias("first_read")
    )
    both = recalled.unionByName(extra).groupBy("query_id", "path").agg(F.min("first_read").alias("first_read"))
    return top_per_group(both, ["query_id"], [F.asc("first_read")], limit, "position")


def candidate_words(index: PageIndex, queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, path, token, df, tf) for every query word a candidate holds.

    A popular document may be a candidate of a third of all queries, so the join is salted.
    """
    words = salted_join(query_words(queries), index.terms, ["token"], ["query_id"])
    # Each query's words travel as one array (bounded by the query text) to its candidates.
    packed = words.groupBy("query_id").agg(F.collect_list(F.struct("token", "df")).alias("words"))
    pairs = candidates.select("query_id", "path").join(packed, "query_id")
    pairs = pairs.select("query_id", "path", F.explode("words").alias("w")).select("query_id", "path", "w.token", "w.df")
    wanted = index.postings.join(candidates.select("path").distinct(), "path", "left_semi")
    return salted_join(pairs, wanted, ["path", "token"], ["query_id"])


def score_candidates(index: PageIndex, queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """BM25 of each (query, candidate) pair."""
    n, avgdl = index.stats.select("n").scalar(), index.stats.select("avgdl").scalar()
    matched = salted_join(candidate_words(index, queries, candidates), index.lengths, ["path"], ["query_id", "token"])
    part = bm25_expr(n, F.col("df"), F.col("tf"), F.col("dl"), avgdl)
    return matched.groupBy("query_id", "path").agg(F.round(F.sum(part), SCORE_DIGITS).alias("score"))


def score_overlap(index: PageIndex, queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Number of distinct query words each candidate holds."""
    return candidate_words(index, queries, candidates).groupBy("query_id", "path").agg(
        F.count("*").cast("double").alias("score")
    )


def score_all(index: PageIndex, queries: DataFrame) -> DataFrame:
    """BM25 of every (query, page) pair that shares a word: exact, without a read budget.

    Only postings of the queries' words are read; a word of a third of all pages meets its
    queries in salted buckets, and each task adds up its parts before the shuffle.
    """
    n, avgdl = index.stats.select("n").scalar(), index.stats.select("avgdl").scalar()
    asked = cut_lineage(salted_join(query_words(queries), index.terms, ["token"], ["query_id"]))
    held = salted_join(wanted_postings(index.postings, asked, ["token"]), index.lengths, ["path"], ["token"])
    part = bm25_expr(n, F.col("df"), F.col("tf"), F.col("dl"), avgdl)
    return salted_join(held, asked, ["token"], ["path"]).groupBy("query_id", "path").agg(F.round(F.sum(part), SCORE_DIGITS).alias("score"))


#: Pages and queries scored against each other at once: two million numbers.
PAGE_BLOCK, QUERY_BLOCK = 1024, 512


class _Block:
    """Some queries with all their words, and the best pages a task has seen for each of them."""

    def __init__(self, ids: range, rows: tuple[np.ndarray, np.ndarray, np.ndarray], tokens: list[str], idf: np.ndarray, top_k: int):
        query, word, times = rows
        used, at = np.unique(word, return_inverse=True)
        self.ids, self.tokens, self.top_k = ids, pa.array([tokens[i] for i in used], pa.string()), top_k
        self.weights, self.asked = np.zeros((len(used), len(ids))), len(used)
        np.add.at(self.weights, (at, query - ids.start), idf[word] * times)
        self.query, self.score, self.path = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object)
        self.least, self.last = np.full(len(ids), -1), [None] * len(ids)

    def meet(self, paths: np.ndarray, counts: pa.ListArray, lengths: np.ndarray, avgdl: float) -> None:
        """Score a block of pages in path order and keep the best ``top_k`` of every query."""
        ends = np.asarray(counts.offsets)
        items = counts.flatten()
        found = pc.index_in(items.field("token"), value_set=self.tokens)
        held = np.flatnonzero(np.asarray(found.is_valid()))
        if not len(held):
            return
        page = np.searchsorted(ends - ends[0], held, side="right") - 1
        tf = np.asarray(items.field("tf"))[held].astype(float)
        part = tf * (BM25_K1 + 1) / (tf + BM25_K1 * ((1 - BM25_B) + BM25_B * lengths[page] / avgdl))
        grid = np.zeros((len(paths), self.asked))
        np.add.at(grid, (page, np.asarray(found.drop_null()).astype(np.int64)), part)
        raw = grid @ self.weights
        # Whole numbers of 1e-9, the digits that count; pages without a common word stay below zero.
        score = np.where(raw > 0, np.rint(raw * 10**SCORE_DIGITS).astype(np.int64), -1)
        place = np.arange(len(paths))[:, None]
        before = np.array([len(paths) if p is None else np.searchsorted(paths, p) for p in self.last])
        good = (score > self.least) | ((score == self.least) & (score >= 0) & (place < before))
        if len(paths) > self.top_k:
            key = score * len(paths) + (len(paths) - 1 - place)
            good &= key >= np.partition(key, len(paths) - self.top_k, axis=0)[len(paths) - self.top_k]
        rows, columns = np.nonzero(good)
        if not len(rows):
            return
        query, score = np.concatenate([self.query, columns]), np.concatenate([self.score, score[rows, columns]])
        path = np.concatenate([self.path, paths[rows]])
        order = np.lexsort((np.unique(path, return_inverse=True)[1], -score, query))
        query, score, path = query[order], score[order], path[order]
        first = np.searchsorted(query, query)
        keep = np.arange(len(query)) - first < self.top_k
        self.query, self.score, self.path = query[keep], score[keep], path[keep]
        filled = np.arange(len(self.query)) - np.searchsorted(self.query, self.query) == self.top_k - 1
        for q, s, p in zip(self.query[filled], self.score[filled], self.path[filled]):
            self.least[q], self.last[q] = s, p

    def best(self) -> pa.RecordBatch:
        """(number, path, score) of the best pages seen."""
        columns = [pa.array(self.query + self.ids.start, pa.int64()), pa.array(self.path, pa.string()), pa.array(self.score / 10**SCORE_DIGITS, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, names=["number", "path", "score"])


def top_scored(index: PageIndex, queries: DataFrame, top_k: int) -> DataFrame:
    """BM25 (query_id, path, score) that holds the ``top_k`` best pages of every query, and few others: exact, without a read budget.

    While the queries' words are small they travel to the pages, every task scores its pages in
    blocks and lets go the best of each query, so that no (query, page) pair is ever written or
    shuffled. Longer tables of queries, and pages whose path repeats, meet in joins.
    """
    if index.counted is None:
        return score_all(index, queries)
    asked = cut_lineage(salted_join(query_words(queries), index.terms, ["token"], ["query_id"]).groupBy("query_id", "token", "df").agg(F.count("*").alias("times")))
    if estimated_bytes(asked) > BROADCAST_BYTES:
        return score_all(index, queries)
    repeated = cut_lineage(index.counted.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path"))
    alone = index.counted.where("path IS NOT NULL").join(maybe_broadcast(repeated), "path", "left_anti")
    best = _scored_blocks(alone, asked, index.stats.select("n", "avgdl").first(), top_k)
    if repeated.isEmpty():
        return best
    again = replace(index, postings=index.postings.join(repeated, "path", "left_semi"), lengths=index.lengths.join(repeated, "path", "left_semi"))
    return best.unionByName(score_all(again, queries))


def _scored_blocks(counted: DataFrame, asked: DataFrame, stats, top_k: int) -> DataFrame:
    rows = asked.collect()  # a broadcast of query words, below ``BROADCAST_BYTES``
    names = list(dict.fromkeys(r.query_id for r in rows))
    number = {q: i for i, q in enumerate(names)}
    tokens, idf, word = _word_weights(rows, stats.n)
    entries = np.array(sorted((number[r.query_id], word[r.token], r.times) for r in rows), np.int64).reshape(-1, 3)
    sent, avgdl = asked.sparkSession.sparkContext.broadcast((entries, tokens, idf)), stats.avgdl

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _blocks(*sent.value, range(len(names)), top_k)
        for batch in batches:
            _meet_all(blocks, batch, avgdl)
        for block in blocks:
            yield block.best()

    ids = asked.sparkSession.createDataFrame(list(enumerate(names)), StructType([StructField("number", LongType()), asked.schema["query_id"]]))
    found = counted.select("path", "counts", "dl").mapInArrow(score, BEST_SCHEMA)
    return found.join(F.broadcast(ids), "number").select("query_id", "path", "score")


BEST_SCHEMA = StructType([StructField("number", LongType()), StructField("path", StringType()), StructField("score", DoubleType())])


def _word_weights(rows: list, n: int) -> tuple[list[str], np.ndarray, dict[str, int]]:
    """Different words of collected (token, df) rows, their weights and their places."""
    df = {r.token: r.df for r in rows}
    return list(df), np.array([math.log(1 + (n - d + 0.5) / (d + 0.5)) for d in df.values()]), {t: i for i, t in enumerate(df)}


def _blocks(entries: np.ndarray, tokens: list[str], idf: np.ndarray, numbers: range, top_k: int) -> list[_Block]:
    """Blocks of the queries with these numbers; ``entries``: (query, word, times) in rising order of queries."""
    blocks = []
    for start in range(numbers.start, numbers.stop, QUERY_BLOCK):
        ids = range(start, min(start + QUERY_BLOCK, numbers.stop))
        mine = entries[slice(*np.searchsorted(entries[:, 0], (ids.start, ids.stop)))]
        blocks.append(_Block(ids, (mine[:, 0], mine[:, 1], mine[:, 2]), tokens, idf, top_k))
    return blocks


def _page_blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, pa.ListArray, np.ndarray]]:
    """(paths, counts, lengths) of some pages at a time, in path order; the last three columns of a batch."""
    path, counts, dl = batch.columns[-3:]
    for start in range(0, batch.num_rows, PAGE_BLOCK):
        paths = np.array(path.slice(start, PAGE_BLOCK).to_pylist(), dtype=object)
        order = np.argsort(paths)
        at = pa.array(order + start)
        yield paths[order], counts.take(at), np.asarray(dl.take(at)).astype(float)


def _meet_all(blocks: list[_Block], batch: pa.RecordBatch, avgdl: float) -> None:
    for paths, counts, lengths in _page_blocks(batch):
        for block in blocks:
            block.meet(paths, counts, lengths, avgdl)


def top_in_groups(index: PageIndex, queries: DataFrame, chosen: DataFrame, members: DataFrame, top_k: int) -> tuple[DataFrame, DataFrame] | None:
    """BM25 (query_id, branch_rank, path, score) holding the ``top_k`` best members of every chosen branch: exact, no (query, page) pair is shuffled.

    ``chosen``: (query_id, branch, branch_rank); ``members``: (branch, path). Members bring their
    counted words to their branch, whose queries score them in blocks. The second table, (path),
    has the pages this leaves out: their path repeats, in the index or in a branch. None where the
    queries' words or the choices are not small enough to travel or where a choice is not unique.
    """
    if index.counted is None:
        return None
    words = cut_lineage(salted_join(query_words(queries), index.terms, ["token"], ["query_id"]).groupBy("query_id", "token", "df").agg(F.count("*").alias("times")))
    pairs = cut_lineage(chosen.select("branch", "query_id", "branch_rank").where("query_id IS NOT NULL AND branch IS NOT NULL"))
    if estimated_bytes(words) > BROADCAST_BYTES or estimated_bytes(pairs) > BROADCAST_BYTES:
        return None
    asked = sorted(map(tuple, pairs.collect()), key=lambda r: r[0])
    if any(rank is None for _, _, rank in asked) or len({r[1:] for r in asked}) < len(asked):
        return None
    rows = words.where("query_id IS NOT NULL").collect()
    tokens, idf, word = _word_weights(rows, (stats := index.stats.select("n", "avgdl").first()).n)
    held: dict = {}
    for r in rows:
        held.setdefault(r.query_id, []).append((word[r.token], r.times))
    entries = np.array([(i, *w) for i, (_, query, _) in enumerate(asked) for w in held.get(query, ())], np.int64).reshape(-1, 3)
    spans: dict = {}
    for i, (branch, _, _) in enumerate(asked):
        spans[branch] = range(spans[branch].start if branch in spans else i, i + 1)
    spark = queries.sparkSession
    sent, avgdl = spark.sparkContext.broadcast((entries, tokens, idf, spans)), stats.avgdl

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, tokens, idf, spans = sent.value
        now, blocks = None, []
        for batch in batches:
            branches = np.array(batch.column(0).to_pylist(), dtype=object)
            starts = np.flatnonzero(np.concatenate(([True], branches[1:] != branches[:-1])))
            for start, end in zip(starts, [*starts[1:], len(branches)]):
                if branches[start] != now:
                    for block in blocks:
                        yield block.best()
                    now = branches[start]
                    blocks = _blocks(entries, tokens, idf, spans[now], top_k)
                _meet_all(blocks, batch.slice(start, end - start), avgdl)
        for block in blocks:
            yield block.best()

    wanted = members.where("branch IS NOT NULL AND path IS NOT NULL").select("branch", "path").join(F.broadcast(pairs.select("branch").distinct()), "branch", "left_semi")
    wanted = cut_lineage(wanted)
    again = index.counted.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path")
    again = cut_lineage(again.unionByName(wanted.groupBy("branch", "path").agg(F.count("*").alias("n")).where("n > 1").select("path")).where("path IS NOT NULL").distinct())
    pages = wanted.join(maybe_broadcast(again), "path", "left_anti").join(index.counted.hint("merge"), "path")
    # A branch may hold a large share of all pages, so several tasks take parts of it.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = pages.withColumn("part", F.pmod(F.xxhash64("path"), F.lit(SALTS))).repartition(tasks, "branch", "part").sortWithinPartitions("branch")
    best = dealt.select("branch", "path", "counts", "dl").mapInArrow(score, BEST_SCHEMA)
    ids = StructType([StructField("number", LongType()), pairs.schema["query_id"], pairs.schema["branch_rank"]])
    ids = spark.createDataFrame([(i, query, rank) for i, (_, query, rank) in enumerate(asked)], ids)
    return best.join(F.broadcast(ids), "number").select("query_id", "branch_rank", "path", "score"), again


def overlap_all(index: PageIndex, queries: DataFrame) -> DataFrame:
    """Number of distinct query words every page holds that holds any."""
    pairs = salted_join(index.postings.select("token", "path"), query_words(queries), ["token"], ["path"])
    return pairs.groupBy("query_id", "path").agg(F.count("*").cast("double").alias("score"))


def fuse_all(index: PageIndex, queries: DataFrame, top_k: int, weights=None) -> DataFrame:
    """Fusion of the BM25 and overlap ranks of all pages, the ``top_k`` best of each query: exact.

    The ``top_k``-th best page by BM25 alone scores w / (offset + ``top_k``) at least, and a page
    so far down that even the first overlap rank cannot make up for it is never returned. So the
    heads by BM25 are fused, and the pages before them by overlap are counted, not ranked. Queries
    that fewer pages answer, and tables whose words are not small enough to travel, rank all pages.
    """
    weights = weights or CHANNEL_WEIGHTS
    ranked = lambda q: fuse_many({"bm25": score_all(index, q), "facet": overlap_all(index, q)}, ["query_id"], top_k, weights)
    spare = weights["bm25"] / (RRF_OFFSET + top_k) - weights["facet"] / (RRF_OFFSET + 1)
    asked = cut_lineage(query_words(queries).groupBy("query_id", "token").agg(F.count("*").alias("times")))
    if index.counted is None or spare <= 0 or estimated_bytes(asked) > BROADCAST_BYTES:
        return ranked(queries)
    head = math.ceil(weights["bm25"] / spare * (1 + 1e-6)) - RRF_OFFSET + 1
    best = top_per_group(top_scored(index, queries, head).where("score > 0 AND query_id IS NOT NULL"), ["query_id"], [F.desc("score"), F.asc("path")], head, "place")
    best = cut_lineage(best.select("query_id", "path", "place"))
    whole = cut_lineage(best.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") == head).select("query_id"))
    heads = cut_lineage(score_overlap(index, queries, best.join(whole, "query_id", "left_semi")).join(best, ["query_id", "path"]))
    before = _pages_before(index, asked, heads)
    part = lambda name, rank: F.lit(weights[name]) / (RRF_OFFSET + F.col(rank))
    fused = heads.join(before, ["query_id", "path"], "left").withColumn("second", F.coalesce("before", F.lit(0)) + 1)
    fused = fused.select("query_id", "path", F.round(part("bm25", "place") + part("facet", "second"), 12).alias("score"))
    fused = top_per_group(fused, ["query_id"], [F.desc("score"), F.asc("path")], top_k)
    rest = cut_lineage(queries.join(whole, "query_id", "left_anti"))
    return fused if rest.isEmpty() else fused.unionByName(ranked(rest))


def _pages_before(index: PageIndex, asked: DataFrame, heads: DataFrame) -> DataFrame:
    """(query_id, path, before): how many pages stand before each of ``heads`` (query_id, path, score) by overlap, then path."""
    repeated = cut_lineage(index.counted.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path"))
    alone = index.counted.where("path IS NOT NULL").join(maybe_broadcast(repeated), "path", "left_anti")
    looked = heads.select("query_id", "path", F.col("score").cast("long").alias("score")).orderBy("query_id", "path").collect()  # some heads of each query
    number = {q: i for i, q in enumerate(dict.fromkeys(r.query_id for r in looked))}
    words = [r for r in asked.where("query_id IS NOT NULL").collect() if r.query_id in number]
    place = {t: i for i, t in enumerate(dict.fromkeys(r.token for r in words))}
    entries = np.array([(place[r.token], number[r.query_id], r.times) for r in words], np.int64).reshape(-1, 3)
    lines = np.array([(number[r.query_id], r.score) for r in looked], np.int64).reshape(-1, 2)
    spark = heads.sparkSession
    sent = spark.sparkContext.broadcast((entries, list(place), lines, [r.path for r in looked], len(number)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, tokens, lines, paths, size = sent.value
        weights, tokens, paths = np.zeros((len(tokens), size), np.float32), pa.array(tokens, pa.string()), np.array(paths, dtype=object)
        np.add.at(weights, (entries[:, 0], entries[:, 1]), entries[:, 2])
        before = np.zeros(len(lines), np.int64)
        for batch in batches:
            for some, counts, _ in _page_blocks(batch):
                ends = np.asarray(counts.offsets)
                found = pc.index_in(counts.flatten().field("token"), value_set=tokens)
                held = np.flatnonzero(np.asarray(found.is_valid()))
                grid = np.zeros((len(some), len(tokens)), np.float32)
                np.add.at(grid, (np.searchsorted(ends - ends[0], held, side="right") - 1, np.asarray(found.drop_null()).astype(np.int64)), 1)
                overlap = grid @ weights
                earlier = np.searchsorted(some, paths)
                for start in range(0, len(lines), QUERY_BLOCK):
                    mine = slice(start, start + QUERY_BLOCK)
                    other, own = overlap[:, lines[mine, 0]], lines[mine, 1]
                    tied = (other == own) & (np.arange(len(some))[:, None] < earlier[mine])
                    before[mine] += ((other > own) | tied).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(lines))), pa.array(before)], names=["number", "before"])

    counted = alone.select("path", "counts", "dl").mapInArrow(count, "number long, before long")
    names = StructType([StructField("number", LongType()), heads.schema["query_id"], heads.schema["path"]])
    names = spark.createDataFrame([(i, r.query_id, r.path) for i, r in enumerate(looked)], names)
    found = counted.groupBy("number").agg(F.sum("before").alias("before")).join(F.broadcast(names), "number").select("query_id", "path", "before")
    if repeated.isEmpty():
        return found
    again = index.postings.join(repeated, "path", "left_semi")
    again = again.join(F.broadcast(asked), "token").groupBy("query_id", "path").agg(F.sum("times").alias("held")).withColumnRenamed("path", "other")
    met = heads.join(again, "query_id").where((F.col("held") > F.col("score")) | ((F.col("held") == F.col("score")) & (F.col("other") < F.col("path"))))
    return found.unionByName(met.groupBy("query_id", "path").agg(F.count("*").alias("before"))).groupBy("query_id", "path").agg(F.sum("before").alias("before"))


def search_many(index: PageIndex, queries: DataFrame, top_k: int = 8, limit: int | None = None) -> DataFrame:
    """Serve a table of queries (query_id, text): BM25, top ``top_k`` each.

    Without ``limit`` every page that shares a word with a query is scored. With it a query
    reads at most ``limit`` postings, rare words first, and short lists are topped up.
    """
    if limit is None:
        scored = top_scored(index, queries, top_k)
    else:
        scored = score_candidates(index, queries, fill_candidates(bounded_candidates(index, queries, limit), queries, index.pages, limit))
    return top_per_group(scored, ["query_id"], [F.desc("score"), F.asc("path")], top_k)


def fuse_many(channels: dict[str, DataFrame], keys: list[str], top_k: int, weights=None) -> DataFrame:
    """Rank fusion per query when every channel holds at most the candidate budget per query."""
    weights = weights or CHANNEL_WEIGHTS
    fused = None
    for name, frame in channels.items():
        w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("path"))
        part = frame.where(F.col("score") > 0).select(
            *keys, "path", (F.lit(weights[name]) / (RRF_OFFSET + F.row_number().over(w))).alias("part")
        )
        fused = part if fused is None else fused.unionByName(part)
    total = fused.groupBy(*keys, "path").agg(F.round(F.sum("part"), 12).alias("score"))
    return top_per_group(total, keys, [F.desc("score"), F.asc("path")], top_k)
