"""Quality classifier (operator 10): document evidence with host and path posteriors by hierarchical empirical Bayes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from metaloom.llm.common import bounded_batches, give_back
from metaloom.scale import cut_lineage, maybe_broadcast

#: Marks that ordinary prose uses.
PROSE_MARKS = ".,;:'\"!?()-"
FEATURES = ("upper", "symbols", "lone_symbols", "repeats", "distinct", "log_words", "word_length")
LABELLED_ROWS = 20_000  # bound of the sample the classifier is fitted on
RIDGE = 1e-2
STEPS = 30
STRONGEST = 12.0  # log odds that one document's text can bring
NO_SPREAD = 1e9  # prior weight where groups do not differ
LEAST = 1e-6


def text_features(text: str) -> list[float] | None:
    """Shares of upper-case letters, rare marks, words of marks, and repeated neighbours; share of distinct words, their number and length."""
    words = text.split()
    n = len(words)
    if not n:
        return None
    joined = "".join(words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    small = joined.lower() if len(joined.lower()) == len(joined) else joined
    upper = float((codes != np.frombuffer(small.encode("utf-32-le", "surrogatepass"), "<u4")).mean())
    odd = ((codes < 48) | ((codes > 57) & (codes < 65)) | ((codes > 90) & (codes < 97)) | ((codes > 122) & (codes < 192))) & ~np.isin(codes, [ord(c) for c in PROSE_MARKS])
    lone = sum(len(w) < 3 and not w.isalnum() and not any(map(str.isalnum, w)) for w in words) / n
    repeats = sum(map(str.__eq__, words, words[1:])) / n
    return [upper, float(odd.mean()), lone, repeats, len(set(words)) / n, float(np.log(n)), len(joined) / n]


@F.pandas_udf(ArrayType(DoubleType()))
def features_of(texts: pd.Series) -> pd.Series:
    found = texts.map(text_features)
    give_back()
    return found


@dataclass
class Classifier:
    """Logistic regression on standardised features; ``bias`` alone where nothing could be learnt."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def log_odds(self, features: Column) -> Column:
        total = F.lit(float(self.bias))
        for i in range(len(FEATURES)):
            total = total + (F.get(features, F.lit(i)) - float(self.mean[i])) * float(self.weights[i] / self.scale[i])
        return F.greatest(F.least(total, F.lit(STRONGEST)), F.lit(-STRONGEST))


def fit_classifier(x: np.ndarray, y: np.ndarray) -> Classifier:
    """Ridge-penalised maximum likelihood by Newton steps."""
    k = len(FEATURES)
    share = (y.sum() + 1) / (len(y) + 2)
    if len(y) == 0 or y.min() == y.max():
        return Classifier(np.zeros(k), np.ones(k), np.zeros(k), float(np.log(share / (1 - share))))
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(k + 1)
    penalty = np.diag([RIDGE * len(x) ** 0.5] * k + [0.0])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + penalty, z.T @ (p - y) + penalty @ w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return Classifier(mean, scale, w[:k], float(w[k]))


def _spread(groups: int, rows: float, squares: float, within: float, between: float) -> float:
    """Weight of the prior in rows: variance inside groups over variance between them (method of moments)."""
    inside = max(within / max(rows - groups, 1), 1e-9)
    tau = (between - (groups - 1) * inside) / max(rows - squares, 1e-9)
    return min(inside / tau, NO_SPREAD) if tau > 0 else NO_SPREAD


@dataclass
class SiteModel:
    """Fitted classifier, prior share of good documents, prior weights of both levels, and sums by host and path."""

    classifier: Classifier
    prior: float
    host_weight: float
    path_weight: float
    sites: DataFrame  # host, path, n, s, host_n, host_s


def _log_odds(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - LEAST)), F.lit(LEAST))
    return F.log(p / (1 - p))


def _site_keys(docs: DataFrame, host_col: str, path_col: str) -> tuple[Column, Column]:
    """Host: the source up to its first slash; path: the whole source with the document's section."""
    source = docs[host_col].cast("string")
    return F.substring_index(source, "/", 1), F.concat_ws("|", source, docs[path_col].cast("string"))


def fit(
    docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang"
) -> SiteModel:
    """Learn from ``labels`` (doc_id, quality 0/1) and from the classifier's view of every document of each site.

    The classifier is fitted on at most ``labelled_rows`` labelled documents, those with the
    smallest hash of their id. Everything else covers all documents: their scores are summed
    by path, the paths by host (partial sums before the shuffle, so a hot host is a few rows),
    and two prior weights come from the sums by the method of moments.
    """
    host, path = _site_keys(docs, host_col, path_col)
    rows = cut_lineage(bounded_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), host.alias("host"), path.alias("path"), features_of(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("features")))
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    lessons = rows.where("features IS NOT NULL").join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_rows).select("features", "quality").toPandas()
    x = np.array(lessons["features"].tolist(), np.float64).reshape(len(lessons), len(FEATURES))
    classifier = fit_classifier(x, (lessons["quality"].to_numpy() > 0).astype(float))

    p = F.when(F.col("features").isNotNull(), 1 / (1 + F.exp(-classifier.log_odds(F.col("features")))))
    scored = rows.select("host", "path", p.alias("p")).where("p IS NOT NULL")
    paths = cut_lineage(scored.groupBy("host", "path").agg(F.count("p").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"), F.sum(F.col("n") * F.col("n")).alias("square"), F.count("*").alias("paths"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("path_fit"))
    hosts = cut_lineage(hosts)
    whole = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).first()
    n, prior = whole["n"] or 0, (whole["s"] / whole["n"]) if whole["n"] else 0.5
    level = hosts.where("host IS NOT NULL").agg(
        F.count("*").alias("hosts"), F.sum("paths").alias("paths"), F.sum("host_n").alias("n"),
        F.sum(F.col("host_n") * F.col("host_n")).alias("square"), F.sum(F.col("square") / F.col("host_n")).alias("path_square"),
        F.sum(F.col("host_s") * F.col("host_s") / F.col("host_n")).alias("host_fit"), F.sum("path_fit").alias("path_fit"),
        F.sum(F.col("host_n") * F.pow(F.col("host_s") / F.col("host_n") - prior, 2)).alias("between"),
    ).first()
    if not n or not level["n"]:
        return SiteModel(classifier, prior, NO_SPREAD, NO_SPREAD, paths.join(hosts, "host").select("host", "path", "n", "s", "host_n", "host_s"))
    host_weight = _spread(level["hosts"], level["n"], level["square"] / level["n"], whole["q"] - level["host_fit"], level["between"])
    path_weight = _spread(level["paths"] - level["hosts"] + 1, level["n"], level["path_square"], whole["q"] - level["path_fit"], level["path_fit"] - level["host_fit"])
    sites = cut_lineage(paths.where("host IS NOT NULL").join(maybe_broadcast(hosts), "host").select("host", "path", "n", "s", "host_n", "host_s"))
    return SiteModel(classifier, prior, host_weight, path_weight, sites)


def score(docs: DataFrame, model: SiteModel, text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """All columns of ``docs`` and a struct ``_quality`` of (text, host, path, score): probabilities that a document is good.

    A document's own score is left out of its site's sums. Host share: sums shrunk to the
    prior; path share: sums shrunk to the host's. The path's log odds over the prior's are
    added to the text's. Texts without words bring no evidence, documents without a host no
    site evidence. Scores are rounded to nine digits.
    """
    host, path = _site_keys(docs, host_col, path_col)
    text = features_of(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    rows = docs.select("*", F.struct(host.alias("host"), path.alias("path"), text.alias("features")).alias("_quality"))
    q = F.col("_quality")
    sites = model.sites.select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.struct("n", "s", "host_n", "host_s").alias("_site"))
    joined = rows.join(maybe_broadcast(sites), (q["host"] == F.col("_host")) & (q["path"] == F.col("_path")), "left")
    own_odds = F.when(q["features"].isNotNull(), model.classifier.log_odds(q["features"]))
    own = 1 / (1 + F.exp(-own_odds))
    mine, one = F.coalesce(own, F.lit(0.0)), F.when(own_odds.isNotNull(), 1).otherwise(0)
    site, prior = F.col("_site"), F.lit(float(model.prior))
    host_share = F.coalesce((site["host_s"] - mine + prior * model.host_weight) / (site["host_n"] - one + model.host_weight), prior)
    path_share = F.coalesce((site["s"] - mine + host_share * model.path_weight) / (site["n"] - one + model.path_weight), prior)
    odds = F.coalesce(own_odds, _log_odds(prior)) + _log_odds(path_share) - _log_odds(prior)
    result = F.struct(*[F.round(c, 9).alias(n) for n, c in (("text", own), ("host", host_share), ("path", path_share), ("score", 1 / (1 + F.exp(-odds))))])
    return joined.select(*[docs[c] for c in docs.columns], result.alias("_quality"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """(doc_id, keep, score, text_score, host_score, path_score) of every document; it is kept from ``threshold`` on.

    Null or empty texts are judged by their site alone; null sources by their text alone;
    labels of null quality or for unknown documents teach nothing, of several labels for one
    id the best counts; without both kinds of label every text gets the labelled share.
    Repeated rows each get a row; an empty table gives an empty result.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col, host_col=host_col, path_col=path_col)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), docs[host_col].alias("source"), docs[path_col].alias("lang"))
    q = F.col("_quality")
    return score(rows, model).select("doc_id", (q["score"] >= threshold).alias("keep"), q["score"].alias("score"), q["text"].alias("text_score"), q["host"].alias("host_score"), q["path"].alias("path_score"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, text_col: str = "text", host_col: str = "source", path_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with their own columns; texts are not shuffled while the table of sites is small."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, host_col=host_col, path_col=path_col)
    return score(docs, model, text_col, host_col, path_col).where(F.col("_quality")["score"] >= threshold).drop("_quality")
