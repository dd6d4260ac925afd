"""Ranked text search over product titles (and any text corpus), with structured filters.

Tokenizer (G1, the 'simple' configuration): lower case, tokens are maximal runs of letters and
digits, 1-based positions, no stemming, no stop words. Hyphenated compounds are not emitted (a
deviation from the reference's parser, stated in the README).

Query (G2, re-aimed from the web-style query text): clauses are given as arguments: ``all_of``
(AND), ``any_of`` (at least one), ``none_of`` (none may occur) and ``phrase`` (consecutive
positions). The match is evaluated over an inverted postings table (G5): only postings of the
query terms are read, grouped by document.

Rank (G4), default weights w = 0.1, no length normalization:
* OR form (one term, or any_of): for each distinct matched query term with n occurrences,
  w·Σ_{j=1..n} 1/j² / 1.64493406685; summed and divided by the number of query terms;
* AND form (two or more all_of / phrase terms): for each pair of occurrences of two different
  query terms at distance d ≥ 1, c = sqrt(w·w·wd(d)) with wd(d) = 1/(1.005 + 0.05·exp(d/1.5 − 2))
  (1e-30 beyond 100); rank = 1 − Π(1 − c).
Ranks are rounded to 9 decimals before ordering, so engines whose ``exp`` differs in the last
bit order candidates the same way. The rank only chooses which 1,000 matches survive.

Search (G6): candidates = matching products (filters on product category/brand), best rank then
id, capped at 1,000 *before* the offer join; then per candidate the in-stock best price and the
offer count over all offers; candidates without an in-stock offer drop; price band on the best
price (HAVING); order by id / price asc / price desc (id as tie-break); offset/limit page.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelake.functions.joins import broadcast_bounded

# Fixed values of the ranking function and of the search route.
RANK_WEIGHT = 0.1
ZETA2 = 1.64493406685
CANDIDATE_CAP = 1000
LIMIT_DEFAULT, LIMIT_MAX = 20, 100
OFFSET_MAX = 10_000
TOKEN_PATTERN = r"[\p{L}\p{N}]+"
RANK_DECIMALS = 9


@dataclass
class TextQuery:
    all_of: list[str] = field(default_factory=list)
    any_of: list[str] = field(default_factory=list)
    none_of: list[str] = field(default_factory=list)
    phrase: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        # terms go through the tokenizer of the documents: lower case, letters and digits
        for name in ("all_of", "any_of", "none_of", "phrase"):
            words = [w for t in getattr(self, name) for w in re.findall(r"[^\W_]+", t.lower())]
            setattr(self, name, words)

    def terms(self) -> list[str]:
        seen: list[str] = []
        for t in self.all_of + self.any_of + self.phrase + self.none_of:
            if t not in seen:
                seen.append(t)
        return seen

    def positive_terms(self) -> list[str]:
        return [t for t in self.terms() if t not in self.none_of]

    def and_form(self) -> bool:
        return not self.any_of and len(set(self.all_of + self.phrase)) >= 2

    def empty(self) -> bool:
        return not (self.all_of or self.any_of or self.phrase or self.none_of)

    def excludes_only(self) -> bool:
        """Only ``none_of``: every document without these terms matches, with rank 0."""
        return bool(self.none_of) and not (self.all_of or self.any_of or self.phrase)


def tokens(text: Column) -> Column:
    """G1: token array of ``text``."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), 0)


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The inverted index (token, doc id, 1-based position) of a text column."""
    return (docs.select(F.col(id_col).alias("doc_id"),
                        F.posexplode(tokens(F.col(text_col))).alias("pos0", "token"))
                .select("token", "doc_id", (F.col("pos0") + 1).cast("long").alias("pos")))


def write_postings(p: DataFrame, path: str, n_files: int | None = None) -> None:
    """G5 layout: range-partitioned and sorted by token, so a lookup of a few tokens reads only
    the row groups whose min/max token bounds contain them (parquet statistics)."""
    n = n_files or int(p.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p.repartitionByRange(n, "token").sortWithinPartitions("token", "doc_id", "pos") \
     .write.mode("overwrite").parquet(path)


def _wd(d: Column) -> Column:
    return F.when(d > 100, F.lit(1e-30)).otherwise(
        1.0 / (1.005 + 0.05 * F.exp(d / 1.5 - 2)))


def match_and_rank(post: DataFrame, q: TextQuery) -> DataFrame:
    """G2 + G3 + G4: (doc_id, rank) of documents matching ``q``, from the postings table."""
    terms = q.terms()
    hits = post.filter(F.col("token").isin(terms))
    per_term = hits.groupBy("doc_id", "token").agg(F.sort_array(F.collect_list("pos")).alias("ps"))
    by_doc = per_term.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(
        F.struct("token", "ps"))).alias("tp"))
    has = {t: F.col("tp")[t].isNotNull() for t in terms}
    cond = F.lit(True)
    for t in q.all_of + q.phrase:
        cond = cond & has[t]
    if q.any_of:
        anyc = F.lit(False)
        for t in q.any_of:
            anyc = anyc | has[t]
        cond = cond & anyc
    for t in q.none_of:
        cond = cond & ~has[t]
    if len(q.phrase) >= 2:
        first = q.phrase[0]
        ok = F.exists(F.col("tp")[first], lambda p: _phrase_at(p, q.phrase))
        cond = cond & ok
    matched = by_doc.filter(cond)
    return matched.select("doc_id", F.round(_rank(q), RANK_DECIMALS).alias("rank"))


def _phrase_at(p: Column, phrase: list[str]) -> Column:
    c = F.lit(True)
    for i, t in enumerate(phrase[1:], start=1):
        c = c & F.array_contains(F.coalesce(F.col("tp")[t], F.array().cast("array<int>")), p + i)
    return c


def _pair_product(a: Column, b: Column) -> Column:
    """Product of (1 − c) over all pairs of positions, by nested folds: no array of pairs is built."""
    def one(x: Column, y: Column) -> Column:
        return 1 - F.coalesce(F.sqrt(F.lit(RANK_WEIGHT * RANK_WEIGHT) * _wd(F.abs(x - y).cast("double"))), F.lit(0.0))

    def row(x: Column) -> Column:
        return F.aggregate(b, F.lit(1.0), lambda inner, y: inner * one(x, y))

    return F.aggregate(a, F.lit(1.0), lambda acc, x: acc * row(x))


def _rank(q: TextQuery) -> Column:
    tp = F.col("tp")
    w = RANK_WEIGHT
    pos_terms = q.positive_terms()
    if q.and_form():
        terms = [t for t in pos_terms]
        prod = F.lit(1.0)
        for i in range(len(terms)):
            for k in range(i):
                a = F.coalesce(tp[terms[i]], F.array().cast("array<int>"))
                b = F.coalesce(tp[terms[k]], F.array().cast("array<int>"))
                prod = prod * _pair_product(a, b)
        return 1 - prod
    acc = F.lit(0.0)
    for t in pos_terms:
        n = F.coalesce(F.size(tp[t]), F.lit(0))
        s = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0),
                        lambda a, j: a + 1.0 / (j * j).cast("double"))
        acc = acc + F.when(n > 0, w * s / ZETA2).otherwise(0.0)
    return acc / max(len(pos_terms), 1)


def search(products: DataFrame, offers: DataFrame, post: DataFrame | None,
           q: TextQuery | None = None, category: str = "", brand: str = "",
           min_price: int | None = None, max_price: int | None = None,
           sort: str = "", limit: int | None = LIMIT_DEFAULT, offset: int = 0,
           cap: int | None = CANDIDATE_CAP) -> DataFrame:
    """One search page. Returns id, title, brand, category, best_price_cents, offer_count,
    hit_count and truncated (hit_count = ``cap``). ``cap=None`` takes every match as a candidate
    and returns every result; then nothing is broadcast by hint."""
    limit = LIMIT_DEFAULT if limit is None or limit < 0 else min(limit, LIMIT_MAX)
    offset = 0 if offset is None or offset < 0 else min(offset, OFFSET_MAX)
    p = products.select("id", "title", "brand", "category")
    if category:
        p = p.filter(F.col("category") == category)
    if brand:
        p = p.filter(F.col("brand") == brand)
    if q is not None and q.excludes_only():
        out = post.filter(F.col("token").isin(q.none_of)).select(F.col("doc_id").alias("id")).distinct()
        cand, order = p.join(out, "id", "left_anti"), [F.col("id")]
    elif q is not None and not q.empty():
        ranked = match_and_rank(post, q).withColumnRenamed("doc_id", "id")
        cand, order = p.join(ranked, "id", "inner"), [F.col("rank").desc(), F.col("id")]
    else:
        cand, order = p, [F.col("id")]
    if cap is not None:      # at most cap rows from here on
        cand = broadcast_bounded(cand.orderBy(*order).limit(cap).select(p.columns))
    else:
        cand = cand.select(p.columns)
    n = cand.agg(F.count(F.lit(1)).alias("hit_count"))
    o = offers.select(F.col("product_id").alias("id"), "price_cents", "in_stock")
    j = o.join(cand, "id", "inner")
    agg = j.groupBy("id", "title", "brand", "category").agg(
        F.min(F.when(F.col("in_stock"), F.col("price_cents"))).alias("best_price_cents"),
        F.count(F.lit(1)).alias("offer_count"))
    having = F.col("best_price_cents").isNotNull()
    if min_price is not None:
        having = having & (F.col("best_price_cents") >= min_price)
    if max_price is not None:
        having = having & (F.col("best_price_cents") <= max_price)
    res = agg.filter(having).crossJoin(F.broadcast(n))   # one-row scalar (C7)
    if sort == "price_asc":
        order = [F.col("best_price_cents").asc(), F.col("id").asc()]
    elif sort == "price_desc":
        order = [F.col("best_price_cents").desc(), F.col("id").asc()]
    else:
        order = [F.col("id").asc()]
    page = res.orderBy(*order).offset(offset).limit(limit) if cap is not None else res
    return page.select("id", "title", "brand", "category", "best_price_cents",
                       F.col("offer_count").cast("long").alias("offer_count"), "hit_count",
                       (F.col("hit_count") == F.lit(-1 if cap is None else cap)).alias("truncated"))
